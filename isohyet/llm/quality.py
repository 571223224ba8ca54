"""Quality rules with risk-controlled thresholds, in Spark expressions only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import small, table

#: For each rule the cutoffs that are tried, from the most lenient to the strictest;
#: a text is rejected if its value is above the cutoff. No cutoff depends on the data.
CUTOFFS: dict[str, tuple[float, ...]] = {
    "symbol_share": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05),
    "dup_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2),
    "repeat_share": (0.3, 0.25, 0.2, 0.15, 0.1),
    "upper_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "mark_share": (0.5, 0.4, 0.3, 0.2, 0.15, 0.12, 0.1),
}
SPACE = " \t\n\x0b\x0c\r"


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang and what the rules look at, for every row, over whole texts.

    Null text: no words, all counts 0. Columns of docs other than doc_id, text
    and lang are not looked at. Repeated rows are measured each. n_repeat_words:
    words in 8-word windows found twice or more, first included; windows are
    compared by 64-bit hashes of their words' hashes, sorted with their places, so the work is
    n log n in the words whatever repeats."""
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    base = docs.select("doc_id", lang.cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("t"))
    base = base.withColumn("w", F.transform(F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda x: x != ""), lambda x: F.xxhash64(x)))
    n = F.size("w")
    window = F.when(n < 8, F.expr("cast(array() as array<bigint>)")).otherwise(F.transform(F.sequence(F.lit(1), n - 7), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(-1, 7)])))
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    chars = F.length(F.translate("t", SPACE, ""))
    base = base.select("doc_id", "lang", n.cast("long").alias("n_words"), chars.cast("long").alias("word_chars"), (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"), lines.alias("l"), window.alias("h"), (F.length("t") - F.length(F.regexp_replace("t", r"\p{Lu}", ""))).cast("long").alias("n_upper"), (F.length("t") - F.length(F.translate("t", "!?;:\"()[]{}=~^_@/\\", ""))).cast("long").alias("n_marks"))
    base = base.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    found = F.filter("s", lambda x, j: (F.get("s", j - 1)["h"].eqNullSafe(x["h"])) | (F.get("s", j + 1)["h"].eqNullSafe(x["h"])))
    base = base.withColumn("p", F.when(F.col("s").isNotNull(), F.array_sort(F.transform(found, lambda x: x["i"]))))
    covered = F.aggregate(F.transform("p", lambda p, j: F.least(F.lit(8), F.coalesce(F.get("p", j + 1) - p, F.lit(8)))), F.lit(0), lambda a, x: a + x)
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return base.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"), F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), F.size("l").cast("long").alias("n_lines"), "n_upper", "n_marks").select("*", share("n_symbols", "word_chars").alias("symbol_share"), share("n_dup_lines", "n_lines").alias("dup_line_share"), share("n_repeat_words", "n_words").alias("repeat_share"), share("n_upper", "word_chars").alias("upper_share"), share("n_marks", "word_chars").alias("mark_share"))


def base_failed(words: str = "n_words", repeated: str = "n_repeat_words") -> Column:
    return (F.col(words) < 20) | (100 * F.col(repeated) > 30 * F.col(words))


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 9, taken back; exact to about 1e-13."""
    x = n + F.lit(9.0)
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    back = F.lit(1.0)
    for k in range(1, 9):
        back = back * (n + k)
    return series - F.log(back)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p) where k < n p; 1 from there on. The sum of the
    terms from k downward: the m-th is at most exp(-m * m / 2k) of the first, so those
    after 9 * sqrt(k) are below what a double holds of the sum, whatever k and n."""
    k, n = k.cast("double"), n.cast("double")
    log_top = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    odds = (1 - p) / p
    down = F.aggregate(
        F.sequence(F.lit(0), F.least(k, F.ceil(9 * F.sqrt(k)) + 9).cast("int")),
        F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda a, i: F.struct((a["sum"] + a["term"]).alias("sum"), (a["term"] * (k - i) / (n - k + i + 1) * odds).alias("term")),
    )
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(log_top) * down["sum"]))


def levels(cutoffs: Mapping[str, Sequence[float]] = CUTOFFS) -> list[dict[str, float]]:
    """Cutoffs of all rules together, from the most lenient level to the strictest: as
    many levels as the longest list, the shorter ones spread over them."""
    n = max(len(c) for c in cutoffs.values())
    return [{r: float(c[i * len(c) // n]) for r, c in cutoffs.items()} for i in range(n)]


def thresholds(measured: DataFrame, labels: DataFrame, alpha: float = 0.01, delta: float = 0.05, cutoffs: Mapping[str, Sequence[float]] = CUTOFFS, stratum: str = "lang") -> DataFrame:
    """(stratum, rule, cutoff, n_good, n_rejected): per stratum the strictest level for
    which the labelled holdout shows that at most alpha of the good texts are rejected
    by any of the rules, with probability 1 - delta over all strata at once.

    Exact binomial test of "the false rejection rate is above alpha" at level
    delta / strata (Bonferroni); the levels of a stratum are tested in their fixed
    order, from lenient to strict, until the first one fails, which needs no further
    correction. Counts are over all labelled rows (quality = 1) that pass the base
    rules. Strata with too few labels, or null, get no cutoff: nothing is rejected
    there. A doc_id labelled several times counts once, as good only if no label says
    otherwise."""
    steps = levels(cutoffs)
    said = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    good = measured.where(~base_failed()).join(said.where("quality = 1"), "doc_id", "left_semi").where(F.col(stratum).isNotNull())
    beyond = lambda step: reduce(Column.__or__, [F.col(r) > c for r, c in step.items()])
    per = good.groupBy(F.col(stratum).alias("stratum")).agg(F.count(F.lit(1)).alias("n_good"), *[F.sum(beyond(x).cast("long")).alias(f"k{i}") for i, x in enumerate(steps)])
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"k{i}").alias("n_rejected"), F.create_map(*[F.lit(y) for kv in x.items() for y in kv]).alias("cutoffs")) for i, x in enumerate(steps)])
    per = table(per.select("stratum", "n_good", F.explode(rows).alias("x")).select("stratum", "n_good", "x.*"), "holdout")
    strata = per.agg(F.count_distinct("stratum")).first()[0] or 1
    tested = per.withColumn("passed", binomial_tail(F.col("n_rejected"), F.col("n_good"), alpha) <= F.lit(delta / strata))
    first_failed = tested.groupBy("stratum").agg(F.min(F.when(~F.col("passed"), F.col("i"))).alias("stop"))
    last = tested.join(first_failed, "stratum").where("stop is null or i < stop").groupBy("stratum").agg(F.max_by(F.struct("cutoffs", "n_good", "n_rejected"), "i").alias("x"))
    return last.select("stratum", F.explode("x.cutoffs").alias("rule", "cutoff"), "x.n_good", "x.n_rejected")


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = 0.01, delta: float = 0.05, cutoffs: Mapping[str, Sequence[float]] = CUTOFFS) -> DataFrame:
    """The features of every row of docs with base_failed, rejected_by (array of
    rules) and kept. Empty docs or labels: an empty result, or base rules only."""
    measured = table(features(docs), "features")
    chosen = thresholds(measured, labels, alpha, delta, cutoffs).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("limits"))
    chosen = table(chosen, "thresholds")
    out = measured.join(small(chosen, 100_000), F.col("lang") == F.col("stratum"), "left").drop("stratum")
    broken = F.filter(F.array(*[F.when(F.col(r) > F.col("limits")[r], F.lit(r)) for r in cutoffs]), lambda x: x.isNotNull())
    out = out.withColumn("base_failed", base_failed()).withColumn("rejected_by", broken)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("limits")


def filter_quality(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs that quality_rules keeps, with their columns. The verdict
    holds for a doc_id: a repeated one goes if any of its rows is rejected; rows
    without doc_id stay."""
    bad = table(quality_rules(docs, labels, **how).where(~F.col("kept")).select("doc_id").distinct(), "rejected")
    return docs.join(small(bad), "doc_id", "left_anti").select(docs.columns)
