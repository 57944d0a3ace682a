"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Base rules reject short and repetitive texts. Of what they leave, each rule of `RULES` rejects texts whose value lies above a
cutoff, one per rule and stratum (the language). Cutoffs come from a fixed grid. A cutoff is allowed when the
labelled good texts of the stratum that it would reject are so few that, by the exact binomial tail, a rejection rate of
`risk` could be refuted at the corrected level: the risk is shared among the rules, and the level is divided by the rules
times the strata (Bonferroni). Along a rule's grid the lenient cutoffs are tested first and the first that fails ends the
sequence, so the grid needs no further correction. The strictest allowed cutoff is used. So with probability
`1 - level` at most `risk` of the good texts of each stratum are rejected.

Repeated 8-word windows are found by 64-bit digests inside the row. Defined results: a null text has no words and fails the base
rules; a null stratum is a stratum of its own; a stratum without enough labels has no cutoffs and keeps what passes
the base rules; rows with null labels count for nothing, of several labels of one id the lowest counts; repeated rows
are judged each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import join_heavy
from seqloom.session import settle

# White space of the word rule and the symbols counted.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WIDTH = 8
#: Steps of the cutoff grid and the value of its last step; a text is rejected above its cutoff.
STEPS, TOP = 200, 1.0


def measures(docs: DataFrame, *more: str) -> DataFrame:
    """`doc_id`, the columns named in `more`, and the counts that the rules use."""
    rows = docs.select("doc_id", *more, F.coalesce("text", F.lit("")).alias("t"))
    rows = rows.select("doc_id", *more, "t", F.filter(F.split("t", SPACE), lambda w: w != "").alias("w"),
                       F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    rows = rows.select(
        "doc_id", *more, F.size("w").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("t", SPACE, "")).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    # Digest of the window that starts at each word.
    last = F.size("h") - WIDTH
    windows = F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(WIDTH)])))
    rows = rows.withColumn("win", F.coalesce(windows, F.array().cast("array<bigint>"))).drop("h")
    twice = F.size(F.array_distinct("win")) < F.size("win")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    rows = rows.withColumn("sorted", F.when(twice, F.array_sort(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none)).drop("win")
    # Windows equal to a neighbour in digest order, back in text order; each covers its words up to the next one.
    same = F.filter("sorted", lambda e, i: (F.get("sorted", i - 1)["h"] == e["h"]) | (F.get("sorted", i + 1)["h"] == e["h"]))
    rows = rows.withColumn("starts", F.array_sort(F.transform(same, lambda e: e["i"]))).drop("sorted")
    covered = F.aggregate(F.transform("starts", lambda s, i: F.least(F.lit(WIDTH), F.coalesce(F.get("starts", i + 1) - s, F.lit(WIDTH)))),
                          F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.withColumn("n_repeat_words", covered).drop("starts")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


#: Values between 0 and 1 that rise with suspicion.
RULES = {
    "symbols": lambda: F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
    "repeats": lambda: F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1)),
    "lines": lambda: F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    "long_words": lambda: F.least(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)) / 50, F.lit(1.0)),
}


def log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function for z >= 1, by Stirling's series at z + 7."""
    y = z + 7
    product = z
    for i in range(1, 7):
        product = product * (z + i)
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - F.log(product)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for n trials of probability p, summed downward from k; 1 from the mean on, where it exceeds one half.

    Below the mean the terms fall faster than those of a normal density, so twelve deviations hold all that counts.
    """
    k, n = k.cast("double"), n.cast("double")
    first = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    terms = F.least(k, F.ceil(40 + 12 * F.sqrt(n * p * (1 - p)))).cast("int")
    total = F.aggregate(
        F.sequence(F.lit(0), F.greatest(terms, F.lit(0))), F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")),
        lambda a, j: F.struct((a["t"] * (k - j) * (1 - p) / ((n - k + j + 1) * p)).alias("t"), (a["s"] + a["t"]).alias("s")), lambda a: a["s"])
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(first) * total)


def cutoffs(rows: DataFrame, labels: DataFrame, risk: float = 0.02, level: float = 0.05) -> DataFrame:
    """`(stratum, rule, cutoff, rejected_good, good, rejected_bad, bad, p_value)`, the strictest allowed cutoff of each.

    `rows` hold the measures and `stratum`; learned from are labelled rows that pass the base rules.
    """
    marked = labels.filter("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    held = rows.filter(~base_failed()).join(marked, "doc_id")
    # A value falls in the step of the smallest cutoff that does not reject it.
    step = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.least(F.ceil(make() * (STEPS / TOP)), F.lit(STEPS)).cast("int").alias("step"))
                               for name, make in RULES.items()]))
    counts = held.select("stratum", "quality", step.alias("s")).groupBy("stratum", "s.rule", "s.step").agg(
        F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad"))
    grid = counts.select("stratum", "rule").distinct().withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(STEPS))))
    full = grid.join(counts, ["stratum", "rule", "step"], "left").fillna(0, ["good", "bad"])
    above = Window.partitionBy("stratum", "rule").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("stratum", "rule")
    tested = full.select("stratum", "rule", "step", F.coalesce(F.sum("good").over(above), F.lit(0)).alias("rejected_good"), F.sum("good").over(whole).alias("good"),
                         F.coalesce(F.sum("bad").over(above), F.lit(0)).alias("rejected_bad"), F.sum("bad").over(whole).alias("bad"))
    strata = counts.select("stratum").distinct().count()
    limit = level / max(1, strata * len(RULES))
    tested = tested.withColumn("p_value", binomial_tail(F.col("rejected_good"), F.col("good"), risk / len(RULES)))
    failed = F.max(F.when(F.col("p_value") > limit, F.col("step"))).over(whole)
    allowed = tested.withColumn("failed", failed).filter(F.col("failed").isNull() | (F.col("step") > F.col("failed")))
    best = allowed.groupBy("stratum", "rule").agg(F.min_by(F.struct("step", "rejected_good", "good", "rejected_bad", "bad", "p_value"), "step").alias("b"))
    return best.select("stratum", "rule", (F.col("b.step") * (TOP / STEPS)).alias("cutoff"), "b.rejected_good", "b.good", "b.rejected_bad", "b.bad", "b.p_value")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.02, level: float = 0.05) -> DataFrame:
    """Measures of every row with `base_failed`, `rule_failed` (the first rule that rejects it, else null) and `kept`."""
    rows = measures(docs.withColumn("stratum", F.coalesce(F.col(stratum).cast("string"), F.lit(""))), "stratum")
    rows = settle(rows)
    found = settle(cutoffs(rows, labels, risk, level))
    wide = rows.groupBy("stratum").agg(F.count("*").alias("n"))
    table = wide.join(found.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff")), "stratum", "left").select(
        "stratum", *[F.col(r).alias(f"cut_{r}") for r in RULES])
    joined = join_heavy(rows, table, wide, "stratum", "n")
    # A value in the step of the cutoff is kept: both sides are compared in whole steps.
    failed = F.coalesce(*[F.when(F.ceil(make() * (STEPS / TOP)) > F.round(F.col(f"cut_{r}") * (STEPS / TOP)), F.lit(r)) for r, make in RULES.items()])
    out = joined.withColumn("base_failed", base_failed()).withColumn("rule_failed", F.when(~F.col("base_failed"), failed))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule_failed").isNull()).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule_failed")
