"""Chat formatting in Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template: <turn>role<says>text<next>text</turn>. Turns of one role that
#: follow each other share one mark, their texts parted by <next>.
OPEN, SAYS, NEXT, CLOSE = "<turn>", "<says>", "<next>", "</turn>"
#: Items that are summed or cut out together.
GROUP = 128
_CONTROL = r"<(?=(?:/?turn|says|next)>)"


def escape(text: Column) -> Column:
    """No control string is left in the result: a backslash is doubled, and one
    is put after the < of a control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, "<\\\\")


def unescape(text: Column) -> Column:
    """What escape() was given: of a backslash and a character, the character."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _joined(parts: Column, by: str) -> Column:
    return F.array_join(parts, by)


def _groups(items: Column) -> Column:
    """An array in arrays of GROUP items, the last one shorter; none if it is empty."""
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(GROUP)), lambda i: i < F.size(items))
    return F.transform(starts, lambda i: F.slice(items, i + 1, GROUP))


def _growing(kind: str, at: Column | int) -> Column:
    """The start of a fold that moves a place on and collects items of a kind."""
    return F.struct((F.lit(at) if isinstance(at, int) else at).alias("at"), F.expr(f"cast(array() as array<{kind}>)").alias("out"))


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conv_id: formatted string, n_turns long, and loss_spans, an
    array of (start, length) in code points of formatted, from 1: the escaped
    texts of loss_role in order.

    Turns are sorted by turn, then role, then text (so ties and repeated rows have
    one order, and each is kept); null turns come first. Null text or role: empty.
    Rows with a null conv_id form one conversation. Other columns are ignored.
    The turns of one conversation meet in one row, as it is the result."""
    struct = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sets = turns.select("conv_id", struct.alias("x")).groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    said = F.transform("x", lambda x: F.struct(escape(x["role"]).alias("role"), escape(x["text"]).alias("text")))
    sets = sets.select("conv_id", F.size("x").cast("long").alias("n_turns"), said.alias("x"))
    # where a run of one role begins; each turn is looked at once, whatever came before it
    begins = F.filter(F.sequence(F.lit(0), F.size("x") - 1), lambda i: (i == 0) | (F.get("x", i)["role"] != F.get("x", i - 1)["role"]))
    sets = sets.withColumn("at", begins)
    run = lambda i, j: F.slice("x", i + 1, F.coalesce(F.get("at", j + 1), F.size("x")) - i)
    merged = F.transform("at", lambda i, j: F.struct(F.get("x", i)["role"].alias("role"), F.transform(run(i, j), lambda t: t["text"]).alias("texts")))
    sets = sets.select("conv_id", "n_turns", merged.alias("m"))
    block = lambda m: F.concat(F.lit(OPEN), m["role"], F.lit(SAYS), _joined(m["texts"], NEXT), F.lit(CLOSE))
    gap = len(NEXT)
    # (role, length of each text, what precedes it beyond the texts before it)
    sizes = F.flatten(F.transform("m", lambda m: F.transform(m["texts"], lambda t, i: F.struct((m["role"] == loss_role).alias("loss"), F.length(t).alias("len"), F.when(i == 0, F.length(m["role"]) + len(OPEN) + len(SAYS)).otherwise(gap).alias("pre"), F.when(i == F.size(m["texts"]) - 1, len(CLOSE)).otherwise(0).alias("post")))))
    sets = sets.select("conv_id", "n_turns", _joined(F.transform("m", block), "").alias("formatted"), sizes.alias("z"))
    # running sums in two levels, so that no array is copied once a turn: where each group
    # of sizes begins, then the spans of each group
    sets = sets.withColumn("groups", _groups(F.col("z")))
    size = lambda z: z["pre"] + z["len"] + z["post"]
    sets = sets.withColumn("sums", F.transform("groups", lambda g: F.aggregate(g, F.lit(0), lambda a, z: a + size(z))))
    begin = F.aggregate("sums", _growing("int", 1), lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))
    sets = sets.withColumn("begin", begin["out"])

    def spans_of(group: Column, at: Column) -> Column:
        span = lambda a, z: F.array(F.struct((a["at"] + z["pre"]).alias("start"), z["len"].alias("length")))
        grow = lambda a, z: F.struct((a["at"] + size(z)).alias("at"), F.when(z["loss"], F.concat(a["out"], span(a, z))).otherwise(a["out"]).alias("out"))
        return F.aggregate(group, _growing("struct<start:int,length:int>", at), grow)["out"]

    return sets.select("conv_id", "n_turns", "formatted", F.flatten(F.zip_with("groups", "begin", spans_of)).alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    blocks = F.filter(F.split(formatted, CLOSE), lambda b: b != "")
    one = lambda b: F.transform(F.split(F.substring_index(b, SAYS, -1), NEXT), lambda t: F.struct(unescape(F.substring(F.substring_index(b, SAYS, 1), len(OPEN) + 1, 2**31 - 1)).alias("role"), unescape(t).alias("text")))
    return F.flatten(F.transform(blocks, one))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between. The part of formatted
    that holds a group of spans is cut out first, as a place is found by counting from
    the start of a string."""

    def texts(group: Column) -> Column:
        base, last = F.get(group, F.lit(0))["start"], F.element_at(group, -1)
        part = F.array(F.substring(formatted, base, last["start"] + last["length"] - base))
        return F.flatten(F.transform(part, lambda p: F.transform(group, lambda s: unescape(F.substring(p, s["start"] - base + 1, s["length"])))))

    return _joined(F.flatten(F.transform(_groups(spans), texts)), "")
