"""Chat formatting in budgeted windows. DataFrame operations only.

A turn becomes `<|im_start|>role<|im_sep|>text<|im_end|>`. In roles and texts, a
backslash is doubled and any control string of CONTROLS gets one after its first
character, so that none is left; `unescaped` takes both back.

Tokens are estimated by classes of characters, for any script: eight letters or three digits
in a row count as one, every other character but white space as one of its own; a turn has
four more for its marks.

Windows: what the conversation's system turn leaves of the budget is the room. Prefix sums of
the turns' tokens cut a conversation into stretches of 3/8 of the room; a turn belongs to the
stretch in which it starts, so the new turns of a window take up to 3/4 of the room, unless a
single turn is longer than a stretch: that one has a window of its own, whole. Every window
starts with the system turn; windows after the first repeat the last turns of the window
before (at most `history` turns and a quarter of the room). A window of a long turn has the
system turn, and what is repeated, only as far as they fit; a system turn of over half the
budget stands in a first window of its own and is not repeated. So a window exceeds the
budget only if it is one turn. What is repeated is context: only an assistant turn's first
appearance is under the loss mask, its text alone.

Work is by window functions over (conversation, turn), which spill; only the turns of one
window, which the budget bounds, are put together in one value.

Defined results: a null role or text counts as empty; turns sort by turn, nulls first,
then role and text; repeated rows are turns of their own; a null conv_id is one
conversation; only a system role in the first turn is repeated; an empty table gives no
windows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Control strings of common chat templates.
CONTROLS = (START, SEP, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: What stands after the first character of each.
TAILS = r"(\|(?:im_start|im_sep|im_end|endoftext)\|>|/?s>|/?INST\]|</?SYS>>)"
BUDGET = 1024
HISTORY = 2
TURN_TOKENS = 4
#: What counts as one token, as a regex that Java and RE2 read alike.
TOKEN = r"[A-Za-z]{1,8}|[0-9]{1,3}|[^A-Za-z0-9\x20\x09-\x0D]"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), r"([<\[])" + TAILS, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, formatted, n_context, loss_from, loss_to) of conversations (conv_id, turn, role, text).

    n_context: turns at the start of the window that are repeated; loss_from, loss_to: code point
    places in formatted, a pair for each text under the loss mask.
    """
    conv = Window.partitionBy("conv_id")
    order = conv.orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("pos", F.row_number().over(order)).withColumn("tokens", token_count(F.col("text")) + TURN_TOKENS)
    rows = rows.withColumn("system", (F.col("pos") == 1) & (F.lower("role") == "system"))
    rows = rows.withColumn("system_tokens", F.max(F.when(F.col("system"), F.col("tokens")).otherwise(0)).over(conv))
    rows = rows.withColumn("alone", F.col("system_tokens") > budget // 2)  # the system turn
    rows = rows.withColumn("room", F.when(F.col("alone"), budget).otherwise(budget - F.col("system_tokens")))
    rows = rows.withColumn("stretch", F.greatest(F.floor(F.col("room") * 3 / 8), F.lit(1)))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # the system turn takes no part in the prefix sums
    rows = rows.withColumn("start", F.coalesce(F.sum(F.when(F.col("system"), 0).otherwise(F.col("tokens"))).over(before), F.lit(0)))
    rows = rows.withColumn("part", F.floor(F.col("start") / F.col("stretch"))).withColumn("long", ~F.col("system") & (F.col("tokens") > F.col("stretch")))
    lag = lambda c: F.lag(c).over(order)
    after_system = F.col("alone") | (F.col("tokens") > F.col("room"))
    opens = F.coalesce(F.when(lag("system"), after_system).otherwise((F.col("part") != lag("part")) | F.col("long") | lag("long")), F.lit(False))
    rows = rows.withColumn("left", F.when(F.lead("long").over(order), F.col("room") - F.lead("tokens").over(order)).otherwise(F.col("room")))
    rows = rows.withColumn("opens", opens.cast("int")).withColumn("window", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("last", F.max("window").over(conv))
    end = Window.partitionBy("conv_id", "window").orderBy(F.col("pos").desc())
    from_end = F.sum("tokens").over(end.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fits = from_end <= F.least(F.floor(F.col("room") / 4), F.first("left").over(end))
    recalled = ~F.col("system") & (F.row_number().over(end) <= history) & fits & (F.col("window") < F.col("last"))
    rows = rows.withColumn("recalled", recalled)
    own = F.array(F.struct(F.col("window").alias("window"), F.lit(False).alias("context")))
    context = lambda w: F.struct(w.alias("window"), F.lit(True).alias("context"))
    none = F.filter(own, lambda _: F.lit(False))
    more = F.when(F.col("system") & ~F.col("alone") & (F.col("last") > 0), F.transform(F.sequence(F.lit(1).cast("long"), F.col("last")), context)).when(F.col("recalled"), F.array(context(F.col("window") + 1))).otherwise(none)
    rows = rows.withColumn("in", F.explode(F.concat(own, more)))
    # a turn that leaves the system turn no room
    full = F.max(F.when(~F.col("in.context"), F.col("tokens") > F.col("room"))).over(Window.partitionBy("conv_id", "in.window"))
    rows = rows.withColumn("full", full).where(~(F.col("system") & F.col("in.context") & F.col("full")))
    turn = F.concat(F.lit(START), escaped(F.col("role")), F.lit(SEP), escaped(F.col("text")), F.lit(END))
    rows = rows.select("conv_id", "in.window", "in.context", "pos", "role", turn.alias("turn"), F.length(escaped(F.col("role"))).alias("head"))
    upto = Window.partitionBy("conv_id", "window").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("turn")).over(upto), F.lit(0)).cast("int"))
    target = ~F.col("context") & (F.lower("role") == "assistant")
    first, last = F.col("at") + len(START) + F.col("head") + len(SEP), F.col("at") + F.length("turn") - len(END)
    rows = rows.select("conv_id", "window", F.struct("pos", "context", "turn", F.when(target, first).alias("a"), F.when(target, last).alias("b")).alias("t"))
    found = rows.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list("t")).alias("t"))
    masked = F.filter("t", lambda t: t.a.isNotNull())
    return found.select(
        "conv_id", F.col("window").cast("int").alias("window"),
        F.array_join(F.transform("t", lambda t: t.turn), "").alias("formatted"),
        F.size(F.filter("t", lambda t: t.context)).alias("n_context"),
        F.transform(masked, lambda t: t.a).alias("loss_from"), F.transform(masked, lambda t: t.b).alias("loss_to"),
    )


def parsed(formatted: DataFrame) -> DataFrame:
    """Adds turns (array of role and text, without what is repeated) and loss_texts to rows of `windows`."""
    marked = F.split("formatted", r"<\|im_start\|>", -1)
    own = F.slice(marked, F.col("n_context") + 2, F.size(marked))
    role = lambda t: F.split(t, r"<\|im_sep\|>", 2)[0]
    text = lambda t: F.regexp_replace(F.split(t, r"<\|im_sep\|>", 2)[1], r"<\|im_end\|>$", "")
    turns = F.transform(own, lambda t: F.struct(unescaped(role(t)).alias("role"), unescaped(text(t)).alias("text")))
    loss = F.transform(F.arrays_zip("loss_from", "loss_to"), lambda p: unescaped(F.col("formatted").substr(p.loss_from + 1, p.loss_to - p.loss_from)))
    return formatted.withColumn("turns", turns).withColumn("loss_texts", loss)


def summary(formatted: DataFrame) -> DataFrame:
    """One row per conversation of what its windows say: the digests of all turns and of all text under the loss mask."""
    each = parsed(formatted).select(
        "conv_id", F.size("turns").alias("n"),
        F.struct(
            "window",
            F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "").alias("said"),
            F.array_join("loss_texts", "").alias("loss"),
        ).alias("w"),
        F.length("formatted").alias("chars"),
    )
    whole = each.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list("w")).alias("w"), F.sum("chars").alias("formatted_chars"))
    joined = lambda f: F.array_join(F.transform("w", lambda w: w[f]), "")
    return whole.select(
        "conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.sha2(joined("said"), 256).alias("turns_sha256"),
        F.length(joined("loss")).cast("long").alias("loss_chars"), F.sha2(joined("loss"), 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
