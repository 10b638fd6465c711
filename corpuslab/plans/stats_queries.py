"""Paired statistics: the discount and the tax of a line item stand for two runs' scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats
from .base import query, table

RUNS = 'pairs AS (SELECT l_linenumber AS "group", l_discount AS a, l_tax AS b FROM lineitem)'
_POLY = " + ".join(f"({b!r}::DOUBLE) * pow(1 / (1 + {stats.TAIL[0]}::DOUBLE * z), {i})" for i, b in enumerate(stats.TAIL[1], 1))
TAIL = f"greatest(0, least(1, exp(-z * z / 2) / sqrt(2 * pi()) * ({_POLY})))"
FACTS = 'facts AS (SELECT "group", count(*) AS n, avg(a) AS mean_a, avg(b) AS mean_b, avg(b - a) AS mean_d, stddev_samp(b - a) AS sd_d FROM pairs GROUP BY "group"), z AS (SELECT *, mean_d / (sd_d / sqrt(n)) AS t, abs(mean_d / (sd_d / sqrt(n))) AS z FROM facts)'


def runs(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("group"), F.col("l_discount").alias("a"), F.col("l_tax").alias("b"))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_discount AS a FROM lineitem), b AS (SELECT l_orderkey, l_linenumber, l_tax AS b FROM lineitem)
SELECT l_linenumber AS "group", count(*) AS n, round(sum(a), 4) AS sum_a, round(sum(b), 4) AS sum_b FROM a JOIN b USING (l_orderkey, l_linenumber) GROUP BY l_linenumber""")
def paired_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    a = rows.select("l_orderkey", "l_linenumber", F.col("l_discount").alias("a"))
    b = rows.select("l_orderkey", "l_linenumber", F.col("l_tax").alias("b"))
    both = a.join(b, ["l_orderkey", "l_linenumber"])
    return both.groupBy(F.col("l_linenumber").alias("group")).agg(F.count("*").alias("n"), F.round(F.sum("a"), 4).alias("sum_a"), F.round(F.sum("b"), 4).alias("sum_b"))


@query(f'WITH {RUNS}, {FACTS} SELECT "group", n, round(t, 6) AS t, round(least(1, 2 * {TAIL}), 6) AS p FROM z')
def paired_t_test(spark, sf_dir):
    return stats.paired_t_test(runs(spark, sf_dir), large_only=True)


_W = f"""v AS (SELECT "group", abs(d) AS size, sum((d > 0)::INT) AS up, sum((d < 0)::INT) AS down FROM (SELECT "group", round(b - a, 9) AS d FROM pairs) WHERE d <> 0 GROUP BY ALL),
r AS (SELECT *, coalesce(sum(up + down) OVER (PARTITION BY "group" ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (up + down + 1) / 2.0::DOUBLE AS rank FROM v),
s AS (SELECT "group", sum(up + down)::DOUBLE AS n, least(sum(up * rank), sum(down * rank))::DOUBLE AS w FROM r GROUP BY "group"),
wz AS (SELECT *, abs(w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24) AS z FROM s)"""


@query(f'WITH {RUNS}, {_W} SELECT "group", w, round(least(1, 2 * {TAIL}), 6) AS p FROM wz')
def wilcoxon(spark, sf_dir):
    return stats.wilcoxon(runs(spark, sf_dir))


_LABEL = "CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END"


@query(f'WITH {RUNS}, {FACTS}, k AS (SELECT "group", mean_d / sd_d AS d FROM facts) SELECT "group", round(d, 6) AS d, {_LABEL} AS effect FROM k')
def cohens_d(spark, sf_dir):
    return stats.cohens_d(runs(spark, sf_dir))


@query(f"""WITH {RUNS}, {FACTS}, k AS (SELECT *, round(least(1, 2 * {TAIL}), 6) AS p, mean_d / sd_d AS d FROM z)
SELECT "group", n, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(mean_d, 6) AS difference, 't_test' AS test, p, p < 0.05 AS significant, round(d, 6) AS d, {_LABEL} AS effect FROM k""")
def compare_runs(spark, sf_dir):
    return stats.compare_runs(runs(spark, sf_dir))


# Fixed p-values of twelve tests for the corrections.
P_VALUES = ((1, 0.001), (2, 0.008), (3, 0.039), (4, 0.041), (5, 0.042), (6, 0.06), (7, 0.074), (8, 0.205), (9, 0.212), (10, 0.216), (11, 0.216), (12, 0.9))
_P = "tests AS (SELECT * FROM (VALUES " + ", ".join(f"({g}, {p}::DOUBLE)" for g, p in P_VALUES) + ') v("group", p))'


def _tests(spark):
    return spark.createDataFrame(P_VALUES, "group int, p double")


@query(f'WITH {_P} SELECT "group", p, p < 0.05::DOUBLE / count(*) OVER () AS significant FROM tests')
def bonferroni(spark, sf_dir):
    return stats.bonferroni(_tests(spark))


@query(f"""WITH {_P}, r AS (SELECT *, row_number() OVER (ORDER BY p, "group") AS rank, count(*) OVER () AS n FROM tests),
k AS (SELECT *, least(1, min(p * n / rank) OVER (ORDER BY rank DESC ROWS UNBOUNDED PRECEDING)) AS adj FROM r) SELECT "group", p, round(adj, 6) AS adjusted, adj < 0.05 AS significant FROM k""")
def bh_correction(spark, sf_dir):
    return stats.benjamini_hochberg(_tests(spark))


_BOOT = """rows AS (SELECT l_label AS "group", ix, value FROM (SELECT label AS l_label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS ix, embedding[1]::DOUBLE AS value FROM embeddings)),
sized AS (SELECT "group", count(*) AS n, avg(value) AS mean FROM rows GROUP BY "group"),
draws AS (SELECT "group", r, ('0x' || substr(md5(r || '|' || ix || '|42'), 1, 12))::UBIGINT::BIGINT % n AS ix FROM rows JOIN sized USING ("group"), (SELECT unnest(generate_series(0, 199)) AS r)),
means AS (SELECT "group", r, avg(value) AS m FROM draws JOIN rows USING ("group", ix) GROUP BY "group", r)"""


@query(f'WITH {_BOOT} SELECT "group", round(any_value(mean), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(stddev_pop(m), 6) AS std_error FROM means JOIN sized USING ("group") GROUP BY "group"')
def bootstrap_ci(spark, sf_dir):
    from pyspark.sql.window import Window

    order = Window.partitionBy("label").orderBy("vec_id")
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("group"), (F.row_number().over(order) - 1).cast("long").alias("ix"), F.get("embedding", F.lit(0)).cast("double").alias("value")
    )
    return stats.bootstrap_ci(rows)


@query("""WITH p AS (SELECT label * 100 + vec_id % 40 AS "group", embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings),
f AS (SELECT "group", count(*) AS n, avg(b - a) AS m, stddev_samp(b - a) AS sd FROM p GROUP BY "group"), t AS (SELECT "group", n, (n - 1)::BIGINT AS df, CASE WHEN n > 1 AND sd > 0 THEN m / (sd / sqrt(n)) ELSE 0 END AS t FROM f),
o AS (SELECT *, atan(abs(t) / sqrt(df)) AS o FROM t),
q AS (SELECT *, CASE WHEN t = 0 THEN 0 WHEN df % 2 = 0 THEN sin(o) * list_sum(list_transform(range(df // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1)) * cos(o) ** (2 * k)))
 WHEN df = 1 THEN 2 * o / pi() ELSE 2 / pi() * (o + sin(o) * list_sum(list_transform(range((df - 1) // 2), lambda k: exp(lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5)) * cos(o) ** (2 * k + 1)))) END AS inside FROM o)
SELECT "group", n, round(t, 6) AS t, round(CASE WHEN t = 0 THEN 1 ELSE 1 - inside END, 6) AS p FROM q""")
def small_t_tests(spark, sf_dir):
    """Groups of few pairs: the exact tail. The SQL sums the finite series of whole degrees of freedom instead."""
    pairs = table(spark, sf_dir, "embeddings").select(
        (F.col("label") * 100 + F.col("vec_id") % 40).alias("group"), F.get("embedding", F.lit(0)).cast("double").alias("a"), F.get("embedding", F.lit(1)).cast("double").alias("b")
    )
    return stats.paired_t_test(pairs)


@query(f"""WITH v AS (SELECT label AS "group", vec_id AS ix, embedding[1]::DOUBLE AS value FROM embeddings), d0 AS (SELECT *, unnest(range(1000)) AS r FROM v),
d1 AS (SELECT *, (42 * 42 + {stats.ROUNDS[0][0]} * ix % {stats.PRIME} + {stats.ROUNDS[0][1]} * r % {stats.PRIME} + {stats.ROUNDS[0][2]}) % {stats.PRIME} AS h1 FROM d0),
d2 AS (SELECT *, (h1 * h1 + {stats.ROUNDS[1][0]} * ix % {stats.PRIME} + {stats.ROUNDS[1][1]} * r % {stats.PRIME} + {stats.ROUNDS[1][2]}) % {stats.PRIME} AS h2 FROM d1),
d3 AS (SELECT *, (h2 * h2 + {stats.ROUNDS[2][0]} * ix % {stats.PRIME} + {stats.ROUNDS[2][1]} * r % {stats.PRIME} + {stats.ROUNDS[2][2]}) % {stats.PRIME} AS h3 FROM d2),
w AS (SELECT *, {" + ".join(f"(h3 >= {t})::INT" for t in stats.TAKEN)} AS w FROM d3), m AS (SELECT "group", r, sum(w * value) / sum(w) AS m FROM w GROUP BY "group", r)
SELECT "group", round(mean, 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(stddev_pop(m), 6) AS std_error
FROM m JOIN (SELECT "group", avg(value) AS mean FROM v GROUP BY "group") USING ("group") GROUP BY "group", mean""")
def poisson_bootstrap(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("group"), F.col("vec_id").alias("ix"), F.get("embedding", F.lit(0)).cast("double").alias("value"))
    return stats.poisson_bootstrap(rows)
