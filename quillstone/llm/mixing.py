"""Mixing sources to target weights by Sainte-Laguë apportionment. DataFrame operations only.

Targets: the mix takes `epochs` times all words. Sources by code point, null last,
weigh 5, 2, 1, 5, 2, 1 ...; a target stops at `most` times its source's size and the
excess is shared again by weight until no target is above. That is a water level: with
sources by size over weight, the level of the first source that isn't full is closed
form from running sums.

Quotas: the mix is cut into blocks of `block_words`. Sources, and then the shards of
each source, get whole blocks by the highest quotients target / (2k - 1). Only the
quotients near the threshold can decide: a unit's seats lie within half a unit count
of its share, so all seats below that are given at once and the rest ranked, some
three candidates a unit.

Selection: a shard is a hashed part of a source with about `shard_words` words, its
documents laid on a line in seeded order and the line cut into blocks. Its quota takes
every block as often as it goes, and a run of blocks from a seeded start, around the
end, once more. A document's words lie in known blocks, so what is taken of it is the
overlap of intervals; nothing is exploded. No block is taken over `most` times.

Defined results: null text has size 0 and is never taken; null sources are one source,
the last; repeated rows each count; a source without words has target 0; an empty table
gives an empty result. The same rows give the same result whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.shared import ASCII_SPACE, WORD, cut, join_null_safe

WEIGHTS = (5, 2, 1)
EPOCHS = 1.5
MOST = 2
BLOCK_WORDS = 16
#: Words in a shard, about; a source of 1e13 words has 4e7 shards, of which one task sees a small row each.
SHARD_WORDS = 250_000
#: Sources that are broadcast at most; beyond it the join shuffles.
BROADCAST_SOURCES = 10_000
SEED = 42


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: float = EPOCHS, most: int = MOST) -> DataFrame:
    """Adds target to one row per source (source, source_size)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(by_name) - 1, len(weights)) + 1))
    cap = F.col("source_size") * most
    by_level = Window.orderBy(F.col("level"), F.col("source").asc_nulls_last())
    upto = by_level.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * epochs
    filled = ranked.withColumn("level", cap / F.col("weight"))
    filled = filled.withColumn("open_level", (total - (F.sum(cap).over(upto) - cap)) / F.sum("weight").over(onward))
    # the first source, by level, that the water doesn't fill sets the level of all
    filled = filled.withColumn("nth", F.row_number().over(by_level))
    filled = filled.withColumn("water", F.min(F.when(F.col("open_level") <= F.col("level"), F.struct("nth", "open_level"))).over(everything)["open_level"])
    target = F.least(cap.cast("double"), F.coalesce(F.col("water") * F.col("weight"), cap.cast("double")))
    return filled.withColumn("target", target).select("source", "source_size", "target")


def apportion(units: DataFrame, group: list[str], order: list[str], share: str, seats: str, most: str, out: str) -> DataFrame:
    """Adds `out`: whole seats by the highest quotients share / (2k - 1) within each group, at most `most`.

    `seats` holds the group's number of seats, `most` a unit's limit.
    """
    within = Window.partitionBy(*group)
    n, total = F.count("*").over(within), F.sum(share).over(within)
    held = units.withColumn("_n", n).withColumn("_total", total)
    even = lambda sign: F.when(F.col("_total") > 0, F.col(share) * (F.col(seats) + sign * F.col("_n") / 2) / F.col("_total")).otherwise(0.0)
    held = held.withColumn("_low", F.greatest(F.lit(0), F.ceil(even(-1) - 0.5)).cast("long")).withColumn("_high", F.greatest(F.col("_low"), F.floor(even(1) + 0.5)).cast("long"))
    held = held.withColumn("_left", F.col(seats) - F.sum("_low").over(within))
    some = held.where("_high > _low").select("*", F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))).alias("_k"))
    ranked = some.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy((F.col(share) / (2 * F.col("_k") - 1)).desc(), *[F.col(c).asc_nulls_last() for c in order], "_k")))
    won = ranked.where("_rank <= _left").groupBy(*[F.col(c) for c in dict.fromkeys(group + order)]).agg(F.count("*").alias("_won"))
    joined = join_null_safe(held, won, list(dict.fromkeys(group + order)), "left")
    return joined.withColumn(out, F.least(F.col("_low") + F.coalesce("_won", F.lit(0)), F.col(most))).drop("_n", "_total", "_low", "_high", "_left", "_won")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    epochs: float = EPOCHS,
    most: int = MOST,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, full, again_from, again_to) for every row of docs.

    full: how often the whole document is taken; again_from, again_to: arrays of the word
    intervals of it that are taken once more.
    """
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size")))
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs, most)
    sources = sources.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long"))
    sources = cut(sources)
    named = F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources
    dealt = join_null_safe(rows, named, ["source"])
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size")), F.col("shards")))

    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    shards = shards.withColumn("blocks", F.ceil(F.col("shard_size") / block_words)).withColumn("limit", F.col("blocks") * most)
    blocks = shards.groupBy("source").agg(F.sum("limit").alias("limit"), F.first("target").alias("target"))
    blocks = blocks.withColumn("all_seats", F.round(F.sum("target").over(Window.partitionBy()) / block_words).cast("long")).withColumn("_one", F.lit(0))
    quotas = apportion(blocks, ["_one"], ["source"], "target", "all_seats", "limit", "quota").select("source", "quota")
    shards = join_null_safe(shards.drop("target"), quotas, ["source"])
    shards = apportion(shards, ["source"], ["shard"], "shard_size", "quota", "limit", "seats")
    shards = shards.select(
        "source", "shard", "blocks",
        F.when(F.col("blocks") > 0, F.floor(F.col("seats") / F.col("blocks"))).otherwise(0).alias("full"),
        F.when(F.col("blocks") > 0, F.col("seats") % F.col("blocks")).otherwise(0).alias("rest"),
        F.when(F.col("blocks") > 0, F.pmod(F.xxhash64(F.lit(seed + 1), F.col("source"), F.col("shard")), F.col("blocks"))).otherwise(0).alias("from"),
    )

    line = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed), F.lit(1), F.col("doc_id")), "doc_id", "size")
    laid = dealt.withColumn("end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("start", F.col("end") - F.col("size"))
    drawn = join_null_safe(laid, shards, ["source", "shard"])
    runs = F.array(
        F.struct((F.col("from") * block_words).alias("a"), (F.least(F.col("from") + F.col("rest"), F.col("blocks")) * block_words).alias("b")),
        F.struct(F.lit(0).cast("long").alias("a"), (F.greatest(F.lit(0), F.col("from") + F.col("rest") - F.col("blocks")) * block_words).alias("b")),
    )
    over = F.transform(runs, lambda r: F.struct(F.greatest(r.a, F.col("start")).alias("a"), F.least(r.b, F.col("end")).alias("b")))
    again = F.array_sort(F.filter(over, lambda r: r.b > r.a))
    drawn = drawn.withColumn("again", again).withColumn("taken", F.col("full") * F.col("size") + F.aggregate("again", F.lit(0).cast("long"), lambda s, r: s + r.b - r.a))
    return drawn.select(
        "doc_id", "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), F.col("full").cast("int").alias("full"),
        F.transform("again", lambda r: (r.a - F.col("start")).cast("int")).alias("again_from"),
        F.transform("again", lambda r: (r.b - F.col("start")).cast("int")).alias("again_to"),
    )


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: a document that is taken twice has two rows, and of one that
    a block's border cuts, the row holds the words taken, joined by single spaces. n_chars, if there, follows the text."""
    plan = mix(docs, **options)
    whole = F.filter(F.arrays_zip("again_from", "again_to"), lambda r: (r.again_from == 0) & (r.again_to == F.col("size")))
    plan = plan.where("taken > 0").select(
        F.col("doc_id").alias("_id"), F.col("size").alias("_size"), "source",
        (F.col("full") + F.size(whole)).alias("_whole"),
        F.filter(F.arrays_zip("again_from", "again_to"), lambda r: ~((r.again_from == 0) & (r.again_to == F.col("size")))).alias("_parts"),
        F.row_number().over(Window.partitionBy("doc_id", "size", "source").orderBy("taken", "full", F.to_json("again_from"))).alias("_nth"),
    )
    plan = cut(plan)
    keys = ["_id", "_size", "source"]
    # the row goes along as one value, so that its columns can have any name
    sized = docs.select(F.struct(*docs.columns).alias("_row"), "source", F.col("doc_id").cast("long").alias("_id"), word_count(F.col("text")).alias("_size")).where("_size > 0")
    if not plan.where("_nth > 1").isEmpty():  # repeated rows meet their plans one to one
        keys.append("_nth")
        sized = sized.withColumn("_nth", F.row_number().over(Window.partitionBy("_id", "_size", "source").orderBy(F.xxhash64("_row.text"))))
    else:
        plan = plan.drop("_nth")
    both = join_null_safe(sized, plan, keys).select("_row", "_whole", "_parts")
    copies = F.concat(F.when(F.col("_whole") > 0, F.transform(F.sequence(F.lit(1), F.col("_whole")), lambda _: F.struct(F.lit(-1).alias("again_from"), F.lit(-1).alias("again_to")))).otherwise(F.array()), F.col("_parts"))
    each = both.select("_row", F.explode(copies).alias("_part"))
    words = F.split(F.regexp_replace("_row.text", rf"^[{ASCII_SPACE}]+", ""), rf"[{ASCII_SPACE}]+")
    part = F.array_join(F.slice(words, F.col("_part.again_from") + 1, F.col("_part.again_to") - F.col("_part.again_from")), " ")
    each = each.select("_row", F.when(F.col("_part.again_from") < 0, F.col("_row.text")).otherwise(part).alias("_text"))
    made = {"text": F.col("_text")} | ({"n_chars": F.length("_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return each.select(*[made.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
