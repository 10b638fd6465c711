"""Paired statistics. Each function takes rows (group, a, b) and returns one row for each group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The polynomial approximation 26.2.17 of the normal tail.
TAIL = (0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429))


def normal_tail(z: Column) -> Column:
    """1 - Phi(z) for z >= 0."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(TAIL[0]) * z)
    poly = F.lit(0.0)
    for b in reversed(TAIL[1]):
        poly = (poly + F.lit(b)) * t
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp(-z * z / 2.0) / F.lit(math.sqrt(2.0 * math.pi)) * poly))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised I_x(a, b) by Lentz's continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return min(1.0, max(0.0, x))
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    tiny = 1e-300
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / (1.0 + term * d or tiny)
        c = 1.0 + term / (c or tiny)
        f *= c * d
        if abs(c * d - 1.0) < 1e-12:
            break
    return front * (f - 1.0)


# Lanczos' approximation of the gamma function, g = 7.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012,
    9.9843695780195716e-6, 1.5056327351493116e-7,
)
#: Steps of the continued fraction; more than enough for parameters up to some hundreds.
FRACTION_STEPS = 120


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function of x >= 0.5."""
    y = x - 1.0
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        series = series + F.lit(c) / (y + float(i))
    base = y + 7.5
    return F.lit(0.5 * math.log(2.0 * math.pi)) + (y + 0.5) * F.log(base) - base + F.log(series)


def incomplete_beta_column(a: Column, b: Column, x: Column) -> Column:
    """Regularised I_x(a, b) for a, b >= 0.5, as one expression: a fold over the steps of the continued fraction.

    Each step multiplies by two factors (Lentz); the steps are fixed, so nothing is decided by row.
    """
    swapped = x > (a + 1.0) / (a + b + 2.0)
    parts = F.struct(F.when(swapped, b).otherwise(a).alias("a"), F.when(swapped, a).otherwise(b).alias("b"), F.when(swapped, 1.0 - x).otherwise(x).alias("x"))

    def away(v: Column) -> Column:
        """Not zero."""
        return F.when(F.abs(v) < 1e-300, 1e-300).otherwise(v)

    def step(state: Column, m: Column) -> Column:
        a, b, x = (state[n] for n in "abx")
        even = m * (b - m) * x / ((a + 2.0 * m - 1.0) * (a + 2.0 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2.0 * m) * (a + 2.0 * m + 1.0))
        d1, c1 = 1.0 / away(1.0 + even * state["d"]), away(1.0 + even / state["c"])
        d2, c2 = 1.0 / away(1.0 + odd * d1), away(1.0 + odd / c1)
        return F.struct(a.alias("a"), b.alias("b"), x.alias("x"), c2.alias("c"), d2.alias("d"), (state["f"] * d1 * c1 * d2 * c2).alias("f"))

    def whole(p: Column) -> Column:
        a, b, x = (p[n] for n in "abx")
        d = 1.0 / away(1.0 - (a + b) * x / (a + 1.0))
        start = F.struct(a.alias("a"), b.alias("b"), x.alias("x"), F.lit(1.0).alias("c"), d.alias("d"), d.alias("f"))
        steps = F.transform(F.sequence(F.lit(1), F.lit(FRACTION_STEPS)), lambda m: m.cast("double"))
        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1.0 - x)) / a
        return front * F.aggregate(steps, start, step)["f"]

    # An array of one lets the parts be named once.
    value = F.get(F.transform(F.array(parts), whole), F.lit(0))
    return F.when(x <= 0.0, 0.0).when(x >= 1.0, 1.0).when(swapped, 1.0 - value).otherwise(value)


def t_p_value(t: Column, df: Column) -> Column:
    """Two-tailed; the normal tail above 100 degrees of freedom, the beta function below; null without any."""
    n = F.when(df > 0, df.cast("double"))
    exact = incomplete_beta_column(n / 2.0, F.lit(0.5), n / (n + t * t))
    both = n.isNotNull() & t.isNotNull()
    return F.when(both & (df > 100), F.least(F.lit(1.0), 2.0 * normal_tail(F.abs(t)))).when(both, F.least(F.lit(1.0), exact))


def paired_facts(pairs: DataFrame) -> DataFrame:
    d = F.col("b") - F.col("a")
    return pairs.groupBy("group").agg(
        F.count("*").alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg(d).alias("mean_d"), F.stddev_samp(d).alias("sd_d")
    )


def t_statistic() -> Column:
    usable = (F.col("n") > 1) & (F.coalesce("sd_d", F.lit(0.0)) > 0)
    return F.when(usable, F.col("mean_d") / F.nullif(F.col("sd_d") / F.sqrt(F.col("n").cast("double")), F.lit(0.0))).otherwise(0.0)


def paired_t_test(pairs: DataFrame, large_only: bool = False) -> DataFrame:
    """t and two-tailed p. large_only: all groups have over 101 pairs, so that no Python runs."""
    facts = paired_facts(pairs).withColumn("t", t_statistic())
    p = F.least(F.lit(1.0), 2.0 * normal_tail(F.abs("t"))) if large_only else t_p_value(F.col("t"), F.col("n") - 1)
    p = F.when(F.col("t") == 0.0, 1.0).otherwise(p)
    return facts.select("group", "n", F.round("t", 6).alias("t"), F.round(p, 6).alias("p"))


def wilcoxon(pairs: DataFrame) -> DataFrame:
    """W and the two-tailed normal p, zeros dropped, ties at mean ranks, no corrections.

    Equal absolute differences are counted first, so the ranks' window holds distinct values.
    """
    d = F.round(F.col("b") - F.col("a"), 9)
    values = pairs.select("group", d.alias("d")).where("d <> 0").groupBy("group", F.abs("d").alias("size")).agg(
        F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down")
    )
    ties = F.col("up") + F.col("down")
    before = Window.partitionBy("group").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.coalesce(F.sum(ties).over(before), F.lit(0)) + (ties + 1) / 2.0
    sums = values.select("group", "up", "down", rank.alias("rank")).groupBy("group").agg(
        F.sum(F.col("up") + F.col("down")).cast("double").alias("n"), F.sum(F.col("up") * F.col("rank")).alias("w_up"), F.sum(F.col("down") * F.col("rank")).alias("w_down")
    )
    w = F.least("w_up", "w_down")
    n = F.col("n")
    z = F.abs(w - n * (n + 1.0) / 4.0) / F.sqrt(n * (n + 1.0) * (2.0 * n + 1.0) / 24.0)
    enough = n >= 5
    p = F.when(enough, F.least(F.lit(1.0), 2.0 * normal_tail(z))).otherwise(1.0)
    tested = sums.select("group", F.when(enough, w).otherwise(0.0).alias("w"), F.round(p, 6).alias("p"))
    return pairs.select("group").distinct().join(tested, "group", "left").select("group", F.coalesce("w", F.lit(0.0)).alias("w"), F.coalesce("p", F.lit(1.0)).alias("p"))


def cohens_d(pairs: DataFrame) -> DataFrame:
    facts = paired_facts(pairs)
    d = F.coalesce(F.col("mean_d") / F.nullif(F.col("sd_d"), F.lit(0.0)), F.lit(0.0))
    return facts.select("group", F.round(d, 6).alias("d"), effect_label(d).alias("effect"))


def effect_label(d: Column) -> Column:
    size = F.abs(d)
    return F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large")


def compare_runs(pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Wilcoxon below 30 pairs, else the t-test; groups of one pair show no difference."""
    t, w = paired_t_test(pairs), wilcoxon(pairs).select("group", F.col("p").alias("p_w"))
    facts = paired_facts(pairs).select("group", "mean_a", "mean_b", "mean_d")
    joined = t.join(w, "group").join(facts, "group").join(cohens_d(pairs), "group")
    small = F.col("n") < 30
    p = F.when(F.col("n") < 2, 1.0).when(small, F.col("p_w")).otherwise(F.col("p"))
    return joined.select(
        "group", "n", F.round("mean_a", 6).alias("mean_a"), F.round("mean_b", 6).alias("mean_b"),
        F.round(F.when(F.col("n") < 2, 0.0).otherwise(F.col("mean_d")), 6).alias("difference"),
        F.when(small, "wilcoxon").otherwise("t_test").alias("test"), p.alias("p"), (p < alpha).alias("significant"), "d", "effect",
    )


def bonferroni(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    n = F.count("*").over(Window.partitionBy())
    return tests.withColumn("significant", F.col("p") < F.lit(alpha) / n)


def benjamini_hochberg(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adjusted p: p * n / rank, made monotone from the largest down. A report over tests, not over data."""
    n = F.count("*").over(Window.partitionBy())
    ranked = tests.withColumn("rank", F.row_number().over(Window.orderBy("p", "group"))).withColumn("n_tests", n)
    down = Window.orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    adjusted = F.least(F.lit(1.0), F.min(F.col("p") * F.col("n_tests") / F.col("rank").cast("double")).over(down))
    return ranked.select("group", "p", F.round(adjusted, 6).alias("adjusted"), (adjusted < alpha).alias("significant"))


def bootstrap_ci(rows: DataFrame, n_resamples: int = 200, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Percentile interval of the mean of each group's values (group, ix from 0, value).

    Draws come from MD5, so that reruns and other engines agree; a draw is joined with its value.
    """
    sized = rows.groupBy("group").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    draws = rows.select("group", "ix").join(sized, "group").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(n_resamples - 1))))
    digest = F.md5(F.concat_ws("|", F.col("r").cast("string"), F.col("ix").cast("string"), F.lit(str(seed))))
    pick = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % F.col("n")
    drawn = draws.select("group", "r", pick.alias("ix")).join(rows, ["group", "ix"])
    means = drawn.groupBy("group", "r").agg(F.avg("value").alias("m"))
    tails = [(1.0 - level) / 2.0, 1.0 - (1.0 - level) / 2.0]
    bounds = means.groupBy("group").agg(F.percentile("m", F.array(*map(F.lit, tails))).alias("q"), F.stddev_pop("m").alias("se"))
    return sized.join(bounds, "group").select(
        "group", F.round("mean", 6).alias("mean"), F.round(F.get("q", F.lit(0)), 6).alias("low"), F.round(F.get("q", F.lit(1)), 6).alias("high"), F.round("se", 6).alias("std_error")
    )


#: A prime below 2**31: products of two remainders fit into 64 bits in any engine.
PRIME = (1 << 31) - 1
# Multipliers of the rounds that make a draw of a row, a resample and a seed.
ROUNDS = ((48271, 69621, 1), (39373, 16807, 7), (742938285, 950706376, 11))
#: Bounds of a draw from which on a row is taken once more: the distribution function of Poisson(1).
TAKEN = tuple(int(PRIME * sum(math.exp(-1.0) / math.factorial(j) for j in range(k + 1))) for k in range(11))


def resample_weights(ix: np.ndarray, n_resamples: int, seed: int) -> np.ndarray:
    """How often each row is taken by each resample: independent Poisson(1) counts, by counters alone.

    The weight of a row in a resample depends on their numbers and the seed, so any task works it
    out without a draw being stored or sent.
    """
    rows, resamples = (ix.astype(np.int64) % PRIME)[:, None], np.arange(n_resamples, dtype=np.int64)[None, :]
    h = np.full((len(ix), n_resamples), seed % PRIME, np.int64)
    for a, b, c in ROUNDS:
        h = (h * h + a * rows % PRIME + b * resamples % PRIME + c) % PRIME
    return np.searchsorted(np.array(TAKEN), h, side="right")


#: Groups whose sums a task holds at a time.
GROUPS_HELD = 1000
#: Rows times resamples that a task works out at a time.
DRAWS_AT_A_TIME = 1 << 22


def poisson_bootstrap(rows: DataFrame, n_resamples: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Percentile interval of the mean of each group's values (group, ix, value), by weighted resamples.

    Each task adds up weights and weighted values of its rows for every group and resample, and only
    those sums are shuffled: ``n_resamples`` rows a group and task, however many rows there are. ``ix``
    numbers the rows of a group; null values take no part; a resample that takes nothing is left out.
    """
    kind = rows.schema["group"].dataType.simpleString()

    def sums(batches):
        held: dict = {}
        for batch in batches:
            for group, part in batch.groupby("group", sort=False, dropna=False):
                total = held.setdefault(group, np.zeros((2, n_resamples)))
                step = max(1, DRAWS_AT_A_TIME // n_resamples)
                for at in range(0, len(part), step):
                    some = part.iloc[at : at + step]
                    weights = resample_weights(some["ix"].to_numpy(), n_resamples, seed)
                    total[0] += weights.sum(axis=0)
                    total[1] += some["value"].to_numpy() @ weights
            if len(held) >= GROUPS_HELD:
                yield from flushed(held)
                held.clear()
        yield from flushed(held)

    def flushed(held):
        for group, (n, total) in held.items():
            yield pd.DataFrame({"group": group, "r": np.arange(n_resamples), "n": n, "total": total})

    whole = rows.select("group", F.col("ix").cast("long").alias("ix"), F.col("value").cast("double").alias("value")).where("value IS NOT NULL AND ix IS NOT NULL")
    parts = whole.mapInPandas(sums, f"group {kind}, r int, n double, total double")
    means = parts.groupBy("group", "r").agg((F.try_divide(F.sum("total"), F.sum("n"))).alias("m")).where("m IS NOT NULL")
    tails = [(1.0 - level) / 2.0, 1.0 - (1.0 - level) / 2.0]
    bounds = means.groupBy("group").agg(F.percentile("m", F.array(*map(F.lit, tails))).alias("q"), F.stddev_pop("m").alias("se"))
    sized = whole.groupBy("group").agg(F.avg("value").alias("mean"))
    return sized.join(bounds, "group").select(
        "group", F.round("mean", 6).alias("mean"), F.round(F.get("q", F.lit(0)), 6).alias("low"), F.round(F.get("q", F.lit(1)), 6).alias("high"), F.round("se", 6).alias("std_error")
    )
