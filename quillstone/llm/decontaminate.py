"""Benchmark decontamination by templates. DataFrame operations only.

Canonical form: names (capitalised words, at the start of a sentence as well unless they are
among STARTERS), numbers in digits or words, and units after a number become typed
placeholders, which keep the value that stood there; all else is lower-cased and freed of
punctuation. A template window is eight tokens, of which a
placeholder counts by its type alone. Template windows of the benchmark with fewer than
four plain words are left out, since they would fit anything. Exact windows are eight tokens
whose values all count, be they placeholders or not; none is left out. So a copy is found
whatever its numbers, and though its case or line breaks hide the names.

Windows are hashed by doubling (pairs, fours, eights of hashed tokens) and hash-joined
with those of the benchmark. Matches at one offset form an alignment. Its slots must be
consistent: each value of the item stands for one value of the document and the reverse,
so that a re-parameterised question (other names, other numbers, the same everywhere) is
caught and a chance meeting of templates isn't. Each alignment is checked alone: together, a
chance alignment of an item that resembles itself would speak against a true one. A document is contaminated by an item if
consistent alignments cover at least `coverage` of the item's template windows by either kind
of match, or as much of all its windows, or if one of them
runs over at least `run` tokens without a gap, however long the item is.

The benchmark's windows are broadcast only while they are counted to be at most
BROADCAST_ROWS; beyond that the join shuffles.

Defined results: null text counts as empty and matches nothing; an item of under eight
tokens is one window, which only a document of the same few tokens matches; an item that
stands in a document many times counts each of its windows once; repeated rows of one
doc_id, or of none, are one document (drop_contaminated judges each row by its own text),
repeated rows of an item are one item, and of several texts of one item_id the one that is
covered best counts; texts of any length are read whole; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.shared import cut, fresh, join_null_safe

WINDOW = 8
PLAIN_WORDS = 4
COVERAGE = 0.4
#: Consecutive tokens of an item that are a passage of it.
RUN_TOKENS = 13
BROADCAST_ROWS = 1_000_000
BROADCAST_IDS = 500_000
#: Marks of a placeholder's type, before its value.
NAME, NUMBER, UNIT = "\x01", "\x02", "\x03"
#: Units of measure that are read after a number.
UNITS = (
    "mm cm m km inch inches ft feet foot yard yards mile miles mg g kg lb lbs oz pound pounds ton tons tonne tonnes ml l litre litres liter liters gallon gallons "
    "s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years percent dollars dollar euros euro cents cent "
    "degrees degree celsius fahrenheit kelvin joules joule watts watt volts volt newtons newton pascals pascal hz khz mhz ghz kb mb gb tb mph kmh"
).split()

#: Words that begin a sentence with a capital without being names.
STARTERS = (
    "A After All Although An And Any Are As Assume At Because Before Both But By Calculate Can Compute Consider Could Describe Determine Did Do Does During Each Either "
    "Every Explain Find For From Give Given Had Has Have He Her Here His How However I If In Is It Its Let Many May Might Most My Neither No Not Now Of On Once One Or "
    "Our Prove Put She Should Show Since So Solve Some Such Suppose That The Their Then There These They This Those Though Thus To Under Until Up Use Was We Were What When "
    "Where Which While Who Whose Why Will With Without Would Write Yet You Your"
).split()
#: Numbers in words.
NUMERALS = "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()


def canonical(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds toks, the tokens of a text; a placeholder is its mark and the value that stood there.

    In steps, a column each: an expression that is used twice would be computed twice.
    """
    rows = rows.withColumn("_t", F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\p{Lu}(?<![\p{L}\p{M}\p{N}]\p{Lu})\p{Ll}\p{L}*", NAME + "$0"))
    rows = rows.withColumn("_t", F.regexp_replace("_t", rf"{NAME}({'|'.join(STARTERS)})(?!\p{{L}})", "$1"))
    other = rf"[^\p{{L}}\p{{M}}\p{{N}}{NAME}]"
    rows = rows.withColumn("_t", F.regexp_replace("_t", rf"{other}+(?!\p{{N}})|(?<!\p{{N}}){other}+", " "))
    word = rf"(?<![\p{{L}}\p{{M}}{NAME}])(?:{'|'.join(NUMERALS)})(?![\p{{L}}\p{{M}}])"
    numbers = F.regexp_replace(F.regexp_replace("_t", rf"\p{{N}}+(?:[.,:/]\p{{N}}+)*|{word}", f" {NUMBER}$0 "), rf"(?i)({NUMBER}\S+ +)({'|'.join(UNITS)})(?=\s|$)", f"$1{UNIT}$2")
    rows = rows.withColumn("_t", F.lower(F.when(F.col("_t").rlike(rf"\p{{N}}|{word}"), numbers).otherwise(F.col("_t"))))
    return rows.withColumn("toks", F.array_remove(F.split("_t", " +"), "")).drop("_t")


def template_windows(rows: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """Adds toks (canonical tokens), windows and exact (hashes of template and of exact windows, by first token) to rows; window is a power of two.

    Without placeholders, a window's two hashes are equal.
    """
    if window & (window - 1) or window < 2:
        raise ValueError("window must be a power of two")
    rows = canonical(rows, text)
    for name, token in (("windows", "left(t, 1)"), ("exact", "substr(t, 2)")):
        rows = rows.withColumn(name, F.expr(f"transform(toks, t -> xxhash64(if(t < '\\u0004', {token}, t)))"))
        width = 1
        while width < window:
            rows = rows.withColumn(name, F.expr(f"zip_with({name}, slice({name}, {width + 1}, greatest(size({name}) - {width}, 0)), (a, b) -> xxhash64(a, b))"))
            width *= 2
        rows = rows.withColumn(name, F.expr(f"slice({name}, 1, greatest(size({name}) - {window - 1}, least(size({name}), 1)))"))
    return rows


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, plain_words: int = PLAIN_WORDS) -> DataFrame:
    """(hash, item_id, item_key, item_pos, item_toks, plain, item_windows, all_windows) for every template window that has plain words enough, and every exact window.

    plain: the window has plain words enough; item_windows counts those, all_windows all.
    """
    rows = template_windows(benchmark.select("item_id", "text").distinct(), window=window)
    # the outer explode: of the inner, Spark infers a filter that computes the windows again
    rows = rows.select("item_id", F.xxhash64("text").alias("item_key"), "toks", "exact", F.posexplode_outer("windows").alias("item_pos", "hash")).where("hash is not null")
    rows = rows.withColumn("item_toks", F.expr(f"slice(toks, item_pos + 1, {window})"))
    rows = rows.withColumn("plain", F.expr(f"size(filter(item_toks, t -> t >= '\\u0004')) >= least({plain_words}, size(item_toks))"))
    total = rows.groupBy("item_id", "item_key").agg(F.count_if("plain").alias("item_windows"), F.count("*").alias("all_windows"))
    hashes = F.array_distinct(F.expr("if(plain, array(hash, exact[item_pos]), array(exact[item_pos]))"))
    rows = rows.select("item_id", "item_key", "item_pos", "item_toks", "plain", F.explode(hashes).alias("hash"))
    return join_null_safe(rows, total, ["item_id", "item_key"]).select("hash", "item_id", "item_key", "item_pos", "item_toks", "plain", "item_windows", "all_windows")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, plain_words: int = PLAIN_WORDS, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*ids, item_id, n_windows, item_windows, n_run, n_slots, n_changed) for every pair that shares consistent windows; n_run: the most in a row.

    ids: what tells documents apart, doc_id or also doc_hash, the hash of the text. The windows are counted among the item's template windows or all its windows, whichever are covered better.
    """
    items = cut(benchmark_windows(benchmark, window, plain_words))
    items = F.broadcast(items) if items.count() <= BROADCAST_ROWS else items
    found = template_windows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("doc_hash"), "text"), window=window)
    # template windows, then the exact ones that differ from them
    found = found.withColumn("hashes", F.expr("concat(windows, zip_with(windows, exact, (w, e) -> if(w = e, null, e)))"))
    found = found.select(*ids, "toks", F.size("windows").alias("n"), F.posexplode_outer("hashes").alias("pos", "hash")).join(items, "hash").withColumn("pos", F.expr("pos % n"))
    # a slot's value is compared without the marks, as an exact copy may lack them
    value = lambda t: f"if({t} < '\\u0004', substr({t}, 2), {t})"
    slots = F.expr(f"filter(zip_with(item_toks, slice(toks, pos + 1, {window}), (i, d) -> struct(i, if({value('i')} = {value('d')}, i, d) as d)), s -> s.i < '\\u0004')")
    keys = [*ids, "item_id", "item_key", "item_windows", "all_windows"]
    found = found.select(*keys, (F.col("pos") - F.col("item_pos")).alias("offset"), "item_pos", "plain", slots.alias("slots"))
    aligned = found.groupBy(*keys, "offset").agg(
        F.collect_set("item_pos").alias("at"), F.collect_set(F.when(F.col("plain"), F.col("item_pos"))).alias("plain_at"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots")
    )
    one_to_one = F.expr("size(array_distinct(transform(slots, s -> s.i))) = size(slots) and size(array_distinct(transform(slots, s -> s.d))) = size(slots)")
    longer = "if(p = s.last + 1, s.run + 1, 1)"
    run = F.expr(f"aggregate(array_sort(at), struct(-2 as last, 0 as run, 0 as best), (s, p) -> struct(p as last, {longer} as run, greatest(s.best, {longer}) as best), s -> s.best)")
    by_text = aligned.where(one_to_one).groupBy(*keys).agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("n_all"),
        F.size(F.array_distinct(F.flatten(F.collect_list("plain_at")))).cast("long").alias("n_plain"),
        F.max(run).cast("long").alias("n_run"),
        F.max(F.size("slots")).cast("long").alias("n_slots"),
        F.max(F.expr("size(filter(slots, s -> s.i != s.d))")).cast("long").alias("n_changed"),
    )
    by_plain = F.expr("item_windows > 0 and n_plain * all_windows >= n_all * item_windows")
    by_text = by_text.withColumn("n_windows", F.when(by_plain, F.col("n_plain")).otherwise(F.col("n_all"))).withColumn("item_windows", F.when(by_plain, F.col("item_windows")).otherwise(F.col("all_windows")))
    best = F.max_by(F.struct("n_windows", "item_windows", "n_slots", "n_changed"), F.struct(F.col("n_windows") / F.col("item_windows"), "n_windows", "item_key"))
    return by_text.groupBy(*ids, "item_id").agg(best.alias("of"), F.max("n_run").alias("n_run")).select(*ids, "item_id", "of.n_windows", "of.item_windows", "n_run", "of.n_slots", "of.n_changed")


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, run: int = RUN_TOKENS, window: int = WINDOW, **options) -> DataFrame:
    """The pairs of `matches` that cover enough of the item or run over enough of its tokens, with the share covered."""
    found = matches(docs, benchmark, window, **options).withColumn("coverage", F.col("n_windows") / F.col("item_windows"))
    return found.where((F.col("coverage") >= coverage) | (F.col("n_run") >= run - window + 1))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the rows whose texts any benchmark item contaminates; other rows of their ids, or of none, stay."""
    key, tie = fresh(docs, "bad_id"), fresh(docs, "bad_hash")
    bad = contaminated(docs, benchmark, ids=("doc_id", "doc_hash"), **options)
    bad = cut(bad.select(F.col("doc_id").alias(key), F.col("doc_hash").alias(tie)).distinct())
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_IDS else bad
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(tie)), "left_anti")
