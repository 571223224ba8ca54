"""Mixing sources to target weights by Pfair scheduling, in Spark expressions only."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isohyet.llm.common import table

#: Digits of a hash by which a source's rows are numbered in ranges, each by itself; more
#: where a range would have more rows than RANGE.
HEX_DIGITS, RANGE = 3, 1 << 22
#: The least slots of a window, the unit in which the schedule is worked out, and what a
#: source costs at the start of a window, counted in looks at a free slot.
SLOTS, COST = 256, 40
#: Windows whose sums run side by side.
STRETCH = 4096
#: Blocks of one source that are listed from one row.
LISTED = 4096
#: Bits of a weight that is given as a fraction.
BITS = 40

_JOB = "struct<deadline:bigint,less:bigint,src:string,job:bigint,release:bigint>"


def _source(docs: DataFrame) -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def weighted(sizes: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = 0.5) -> DataFrame:
    """sizes (src, n) with w, the target weight as a whole number of which only the
    ratios count: whole weights as they are given, fractions in steps of 2 ** -BITS
    of the largest; a source with none, or 0, has the least one given. Without
    weights the floor of n ** temperature * 2 ** 20."""
    if not weights:
        return sizes.withColumn("w", F.greatest(F.lit(1).cast("long"), F.floor(F.pow(F.col("n").cast("double"), F.lit(temperature)) * (1 << 20))))
    given = {k: w for k, w in weights.items() if w > 0}
    if not all(float(w).is_integer() for w in given.values()):
        top = max(given.values())
        given = {k: max(1, round(w / top * (1 << BITS))) for k, w in given.items()}
    known = sizes.sparkSession.createDataFrame([(k, int(w)) for k, w in given.items()], "src string, w long")
    return sizes.join(F.broadcast(known), "src", "left").withColumn("w", F.coalesce("w", F.lit(int(min(given.values()))).cast("long")))


def _times(total: int) -> tuple[Column, Column]:
    """Release and deadline of job j of a source with weight w out of total."""
    d = lambda c: c.cast("decimal(38,0)")
    w, j = d(F.col("w")), d(F.col("job"))
    whole = F.lit(total).cast("decimal(38,0)")
    less = d(F.col("w") - 1)
    return F.call_function("div", (j - 1).cast("decimal(19,0)") * whole, w), F.call_function("div", (j.cast("decimal(19,0)") * whole + less).cast("decimal(38,0)"), w)


def _run(windows: DataFrame, slots: int) -> DataFrame:
    """k, ran (job and slot) and left (jobs, sorted) of windows (k, jobs). A job runs
    in the first slot from its release on that no job with an earlier deadline has
    taken: what earliest deadline first gives. Of the jobs released by the start no
    more can run than there are slots; the others are passed on as they are."""
    at = F.col("k") * slots
    start = F.struct(F.sequence(F.lit(0), F.lit(slots - 1)).alias("free"), F.expr("cast(array() as array<int>)").alias("at"))

    def place(acc, x):
        first = F.get(F.filter(acc["free"], lambda f: f >= (x["release"] - at).cast("int")), F.lit(0))
        return F.struct(F.when(first.isNull(), acc["free"]).otherwise(F.array_remove(acc["free"], first)).alias("free"), F.concat(acc["at"], F.array(F.coalesce(first, F.lit(-1)))).alias("at"))

    early = F.array_sort(F.filter("jobs", lambda x: x["release"] <= at))
    split = windows.select("k", early.alias("early"), F.filter("jobs", lambda x: x["release"] > at).alias("late"))
    split = split.select("k", F.array_sort(F.concat(F.slice("early", 1, slots), "late")).alias("jobs"), F.slice("early", slots + 1, 2**31 - 1).alias("rest"))
    # zipped before it is looked through, so that the fold is done once
    done = split.select("k", "rest", F.arrays_zip("jobs", F.aggregate("jobs", start, place, lambda a: a["at"]).alias("at")).alias("b"))
    ran = F.transform(F.filter("b", lambda b: b["at"] >= 0), lambda b: F.struct(b["jobs"].alias("x"), (at + b["at"]).alias("slot")))
    return done.select("k", ran.alias("ran"), F.array_sort(F.concat("rest", F.transform(F.filter("b", lambda b: b["at"] < 0), lambda b: b["jobs"]))).alias("left"))


def _listed(last: Column) -> Column:
    """The numbers of the lists that hold 0 to last, LISTED in each."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / LISTED)))


def _waiting(fresh: DataFrame, last: int, slots: int) -> DataFrame:
    """k, waiting: how many released jobs have not run when window k starts, whatever
    their order, as a slot is idle only when none waits: the most jobs less slots since
    any slot before. The sums run within stretches of windows first, then over the
    stretches; last: a window that none of fresh is after."""
    at = fresh.select("k", F.explode("new").alias("x")).groupBy("k", (F.col("x.release") - F.col("k") * slots).alias("at")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("k").orderBy("at")) - F.col("n")
    per = at.withColumn("low", F.when(F.col("at") > 0, before - F.col("at"))).groupBy("k").agg(F.sum("n").alias("n"), F.min("low").alias("low"))
    every = fresh.sparkSession.range(last + 2).withColumnRenamed("id", "k").join(per, "k", "left").withColumn("c", F.floor(F.col("k") / STRETCH))
    gain = F.coalesce("n", F.lit(0)) - slots
    every = every.withColumn("gain", gain).withColumn("high", F.col("gain") - F.least(F.col("gain"), F.col("low")))

    def past(frame, value, reduce, empty):
        return F.coalesce(reduce(value).over(frame.rowsBetween(Window.unboundedPreceding, -1)), empty)

    inside, over = Window.partitionBy("c").orderBy("k"), Window.orderBy("c")
    none = F.lit(-(1 << 62)).cast("long")
    every = every.withColumn("sum", past(inside, "gain", F.sum, F.lit(0)))
    every = every.withColumn("peak", past(inside, F.col("high") - F.col("sum") - F.col("gain"), F.max, none))
    if last + 2 <= STRETCH:  # there is one stretch only
        return every.select("k", (F.col("sum") + F.greatest(F.lit(0), "peak")).alias("waiting"))
    # one row a stretch
    ends = every.groupBy("c").agg(F.sum("gain").alias("gain"), F.max(F.col("high") - F.col("sum") - F.col("gain")).alias("high"))
    ends = ends.withColumn("sums", past(over, "gain", F.sum, F.lit(0)))
    ends = ends.withColumn("peaks", past(over, F.col("high") - F.col("sums"), F.max, none)).select("c", "sums", "peaks")
    most = F.greatest(F.lit(0), F.col("peaks"), F.col("peak") - F.col("sums"))
    return every.join(ends, "c").select("k", (F.col("sums") + F.col("sum") + most).alias("waiting"))


def schedule(sizes: DataFrame, block: int = 16, slots: int | None = None) -> DataFrame:
    """(src, job, release, deadline, slot): when each block of each source runs.

    sizes: (src, n, w), n rows in blocks of `block`. With the weights' sum W, job j has
    the release floor((j - 1) * W / w) and the deadline ceil(j * W / w), in exact
    integers; in every slot the released job with the earliest deadline runs (ties: the
    larger weight, then the name). The weights' shares add up to 1, so all deadlines are
    met: at any slot a source that has not run out is less than one block away from its
    weight.

    The slots are cut in windows, each worked out by itself from the jobs that are still
    left at its start. How many these are follows from the releases alone (_waiting);
    which, is guessed first: of the jobs whose time spans the start, those with the
    latest deadlines. Then windows whose guess is not what the window before leaves are
    worked out again from that, until none differs. This is exactly the schedule from
    the first slot on, and needs a round or two.

    A window starts with at most a job of every source and looks for each of its jobs
    through its free slots, so windows are as long as the root of the number of
    sources (slots: so long), and the work grows with the blocks times that root."""
    sizes = table(sizes.where("n > 0").withColumn("last", F.ceil(F.col("n") / block)), "weights")
    total, turns, sources = sizes.agg(F.sum(F.col("w").cast("decimal(38,0)")), F.max((F.col("last") - 1) / F.col("w")), F.count(F.lit(1))).first()
    spark = sizes.sparkSession
    if total is None:
        return spark.createDataFrame([], "src string, job long, release long, deadline long, slot long")
    slots = slots or max(SLOTS, math.isqrt(COST * sources))
    latest = int(turns * float(total) * (1 + 1e-9) / slots) + 1
    release, deadline = _times(int(total))
    one = F.struct("deadline", (-F.col("w")).alias("less"), "src", "job", "release").alias("x")
    lists = sizes.select("src", "w", "last", _listed(F.col("last") - 1).alias("c"))
    jobs = lists.repartition("src", "c").select("src", "w", F.explode(F.sequence(F.col("c") * LISTED + 1, F.least("last", (F.col("c") + 1) * LISTED))).alias("job")).withColumns({"release": release, "deadline": deadline})
    fresh = table(jobs.select(F.floor(F.col("release") / slots).alias("k"), one).groupBy("k").agg(F.collect_list("x").alias("new")), "jobs")
    # the jobs whose time spans the start of window k
    ends = sizes.withColumn("job", F.col("last")).withColumn("k1", F.floor((deadline - 1) / slots))
    lists = ends.select("src", "w", "last", "k1", _listed(F.col("k1")).alias("c")).repartition("src", "c")
    over = lists.select("src", "w", "last", F.explode(F.sequence(F.col("c") * LISTED, F.least("k1", (F.col("c") + 1) * LISTED - 1))).alias("k")).where("k > 0")
    whole = F.lit(total).cast("decimal(38,0)")
    share = (F.col("w").cast("decimal(38,0)") * (F.col("k") * slots).cast("decimal(19,0)")).cast("decimal(38,0)")
    over = over.withColumn("job", F.call_function("div", share, whole) + 1).where((share % whole != 0) & (F.col("job") <= F.col("last"))).withColumns({"release": release, "deadline": deadline})
    nth = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("deadline"), "w", F.desc("src")))
    over = over.withColumn("nth", nth).join(_waiting(fresh, latest, slots), "k").where("nth <= waiting")
    held = table(over.groupBy("k").agg(F.array_sort(F.collect_list(one)).alias("held")), "held")
    none = F.expr(f"cast(array() as array<{_JOB}>)")
    merge = lambda a, b: F.concat(F.coalesce(a, none), F.coalesce(b, none))
    windows = fresh.join(held, "k", "full")
    done = table(_run(windows.select("k", merge(F.col("held"), F.col("new")).alias("jobs")), slots), "windows")
    while True:
        handed = done.where(F.size("left") > 0).select((F.col("k") + 1).alias("k"), F.col("left").alias("given"))
        check = handed.join(held, "k", "full").where(~F.coalesce("given", none).eqNullSafe(F.coalesce("held", none)))
        wrong = table(check.select("k", F.coalesce("given", none).alias("given")), "wrong")
        if wrong.isEmpty():
            break
        again = _run(wrong.join(fresh, "k", "left").select("k", merge(F.col("given"), F.col("new")).alias("jobs")), slots)
        keys = wrong.select("k", F.lit(True).alias("_w"))
        held = table(held.join(keys, "k", "left_anti").unionByName(wrong.select("k", F.col("given").alias("held"))), "held")
        done = table(done.join(keys, "k", "left_anti").unionByName(again), "windows")
    return done.select(F.explode("ran").alias("r")).select("r.x.src", "r.x.job", "r.x.release", "r.x.deadline", "r.slot")


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = 0.5, block: int = 16) -> DataFrame:
    """docs with the columns mix_block, mix_release, mix_deadline, mix_slot (all in
    blocks) and mix_rank, by which the mix is read; no row is dropped or repeated.

    A source's rows are dealt in blocks of `block` in the order of a hash of doc_id
    (ties: doc_id; repeated rows follow each other in no fixed order). Up to the slot
    at which the first source runs out, any number of whole blocks from the start holds
    each source to less than one block from its weight; then the others go on at their
    own times. Null source counts as ''. Sources may be any number; rows of one,
    however many, are numbered in ranges of the hash and shifted by the counts of the
    ranges below. Empty docs: an empty result."""
    kept = [c for c in docs.columns if c.lower() not in ("mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_rank")]
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), _source(docs).alias("src"), h.alias("h"), F.col("doc_id").alias("id"))
    digits, most = HEX_DIGITS, None
    while most is None or (most > RANGE and digits < 8):
        digits += math.ceil(math.log(most / RANGE, 16)) if most else 0
        rows = rows.withColumn("range", F.substring("h", 1, digits))
        counts = table(rows.groupBy("src", "range").agg(F.count(F.lit(1)).alias("n")), "counts")
        most = counts.agg(F.max("n")).first()[0] or 0
    sizes = weighted(counts.groupBy("src").agg(F.sum("n").alias("n")), weights, temperature)
    plan = schedule(sizes, block).withColumn("slots", F.struct("slot", "release", "deadline"))
    # of each range the first row's number and the slots of its blocks; a source has at most 16 ** digits ranges
    below = F.sum("n").over(Window.partitionBy("src").orderBy("range")) - F.col("n")
    block_of = lambda c: F.floor(c / block)
    wanted = counts.withColumn("below", below).select("src", "range", "below", F.explode(F.sequence(block_of(F.col("below")), block_of(F.col("below") + F.col("n") - 1))).alias("b")).withColumn("job", F.col("b") + 1)
    starts = table(wanted.join(plan, ["src", "job"]).groupBy("src", "range", "below").agg(F.array_sort(F.collect_list(F.struct("b", "slots"))).alias("blocks")), "ranges")
    nth = F.row_number().over(Window.partitionBy("src", "range").orderBy("h", "id")) - 1
    rows = rows.withColumn("nth", nth).join(starts, ["src", "range"]).withColumn("nth", F.col("nth") + F.col("below")).withColumn("b", block_of(F.col("nth")))
    rows = rows.withColumn("s", F.get("blocks", (F.col("b") - block_of(F.col("below"))).cast("int"))["slots"])
    return rows.select("row.*", F.col("b").alias("mix_block"), F.col("s.release").alias("mix_release"), F.col("s.deadline").alias("mix_deadline"), F.col("s.slot").alias("mix_slot"), (F.col("s.slot") * block + F.col("nth") % block).alias("mix_rank"))


def in_order(mixed: DataFrame, parts: int | None = None) -> DataFrame:
    """The rows in the order of mix_rank: each part holds a range of it."""
    top = mixed.agg(F.max("mix_rank")).first()[0] or 0
    parts = parts or int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionById(parts, F.floor(F.col("mix_rank") * parts / (top + 1)).cast("int")).sortWithinPartitions("mix_rank")
