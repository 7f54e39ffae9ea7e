"""Queries that screen hypotheses: lift, false discovery, effect sizes, splits, sampling, similarity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators.neighbours import most_similar, voted
from tidemark.plans.accounting import BETS_SQL, bets
from tidemark.plans.market import r6
from tidemark.plans.registry import query
from tidemark.sources import events as src
from tidemark.sources.events import BARS_SQL


@query(
    f"""WITH {BETS_SQL}, h AS (SELECT version, CAST(t // 3600000 % 24 AS INTEGER) AS hour_utc, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (win) AS DOUBLE) AS a FROM bets GROUP BY 1, 2), b AS (SELECT version, sum(n) AS m, sum(a) AS b FROM h GROUP BY 1),
l AS (SELECT version, hour_utc, n, a, b, m, CASE WHEN a > 0 AND b > 0 THEN (a / n) / (b / m) ELSE 0 END AS lift, CASE WHEN a > 0 AND b > 0 THEN sqrt(greatest(1 / a - 1 / n + 1 / b - 1 / m, 1e-12)) ELSE 0 END AS se FROM h JOIN b USING (version))
SELECT version, hour_utc, CAST(n AS BIGINT) AS n, round(lift, 5) AS lift, round(se, 5) AS log_se, CASE WHEN lift > 0 THEN round(exp(ln(lift) - 1.96 * se), 5) ELSE 0 END AS lo,
  CASE WHEN lift >= 1.4 THEN CASE WHEN lift > 0 AND exp(ln(lift) - 1.96 * se) > 1 THEN 'ACTIVE' ELSE 'REJECT' END WHEN lift >= 1.15 THEN 'OBSERVE' ELSE 'REJECT' END AS verdict FROM l"""
)
def hour_lifts(spark, d):
    """ST13, ST14, DP13, AG31: lift of each hour over its version, interval and verdict."""
    h = bets(spark, d).groupBy("version", (F.floor(F.col("t") / 3_600_000) % 24).cast("int").alias("hour_utc")).agg(F.count("*").alias("n"), F.count_if("win").alias("a"))
    w = Window.partitionBy("version")
    x = h.withColumns({"m": F.sum("n").over(w), "b": F.sum("a").over(w)}).withColumn("l", stats.lift(F.col("a"), F.col("n"), F.col("b"), F.col("m")))
    return x.select("version", "hour_utc", "n", F.round("l.lift", 5).alias("lift"), F.round("l.log_se", 5).alias("log_se"), F.round("l.lo", 5).alias("lo"), stats.verdict(F.col("l.lift"), F.col("l.lo")).alias("verdict"))


#: Tasks over which the rows of one value are dealt.
DEALT = 8


def ranked(rows, value: str, out: str, cells: int = 4096):
    """rows with the rank of a value in [0, 1] over all of them and m, how many there are.

    Values are counted first. A cell of the unit interval starts at the offset that the counts of the cells
    before it give (a table of at most `cells` rows), and only the distinct values of a cell are sorted together.
    """
    cell = F.least(F.floor(F.col(value) * cells), F.lit(cells - 1)).alias("cell")
    values = rows.groupBy(value, cell).agg(F.count("*").alias("k"))
    order = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    offsets = values.groupBy("cell").agg(F.sum("k").alias("k")).select("cell", (F.sum("k").over(order) - F.col("k")).alias("before"), F.sum("k").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("m"))
    within = Window.partitionBy("cell").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    places = values.join(F.broadcast(offsets), "cell").withColumn(out, F.col("before") + F.sum("k").over(within) - F.col("k") + 1)
    # a value that very many rows have is dealt over tasks
    every = F.sequence(F.lit(0), F.lit(DEALT - 1))
    places = places.select(value, out, "m", F.explode(every).alias("deal"))
    return rows.withColumn("deal", F.pmod(F.xxhash64(*rows.columns), F.lit(DEALT)).cast("int")).join(places, [value, "deal"]).drop("deal")


@query(
    """WITH p AS (SELECT l_suppkey AS id, round(least(1.0, avg(l_discount) * 10 * avg(l_tax)), 10) AS p FROM lineitem GROUP BY 1), r AS (SELECT *, rank() OVER (ORDER BY p) AS rk, count(*) OVER () AS m FROM p),
k AS (SELECT max(rk) FILTER (p <= rk / m * 0.05) AS k FROM r) SELECT id, p, rk AS rank, coalesce(rk <= k, false) AS significant FROM r, k"""
)
def false_discovery(spark, d):
    """WF36: step-up control of the false discovery rate; ranks come from counts by value, not one sorted partition."""
    p = src.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.round(F.least(F.lit(1.0), F.avg("l_discount") * 10 * F.avg("l_tax")), 10).alias("p"))
    r = ranked(p, "p", "rank")
    k = r.filter(F.col("p") <= F.col("rank") / F.col("m") * 0.05).agg(F.max("rank").alias("k"))
    return r.join(F.broadcast(k)).select("id", "p", "rank", F.coalesce(F.col("rank") <= F.col("k"), F.lit(False)).alias("significant"))


@query(
    f"""WITH {BETS_SQL}, r AS (SELECT version, win, entry, rank() OVER w + (count(*) OVER (PARTITION BY version, entry) - 1) / 2.0 AS rk FROM bets WINDOW w AS (PARTITION BY version ORDER BY entry)),
g AS (SELECT version, CAST(count(*) FILTER (win) AS DOUBLE) AS n1, CAST(count(*) FILTER (NOT win) AS DOUBLE) AS n0, sum(rk) FILTER (win) AS s, avg(entry) FILTER (win) AS m1, avg(entry) FILTER (NOT win) AS m0, var_samp(entry) FILTER (win) AS v1, var_samp(entry) FILTER (NOT win) AS v0 FROM r GROUP BY 1)
SELECT version, CASE WHEN n1 > 0 AND n0 > 0 THEN round((s - n1 * (n1 + 1) / 2) / (n1 * n0), 6) END AS auc, CASE WHEN n1 > 1 AND n0 > 1 THEN round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 5) END AS cohens_d FROM g"""
)
def effect_sizes(spark, d):
    """ST20, ST21, ST23, AG21: rank AUC with average ranks, pooled effect size."""
    w = Window.partitionBy("version").orderBy("entry")
    b = bets(spark, d).withColumn("rk", F.rank().over(w) + (F.count("*").over(Window.partitionBy("version", "entry")) - 1) / 2)
    won, e = F.col("win"), F.col("entry")
    g = b.groupBy("version").agg(
        F.count_if(won).cast("double").alias("n1"), F.count_if(~won).cast("double").alias("n0"), F.sum(F.when(won, F.col("rk"))).alias("s"), F.avg(F.when(won, e)).alias("m1"), F.avg(F.when(~won, e)).alias("m0"),
        F.var_samp(F.when(won, e)).alias("v1"), F.var_samp(F.when(~won, e)).alias("v0"),
    )
    n1, n0 = F.col("n1"), F.col("n0")
    pooled = F.sqrt(((n1 - 1) * F.col("v1") + (n0 - 1) * F.col("v0")) / (n1 + n0 - 2))
    return g.select("version", F.when((n1 > 0) & (n0 > 0), r6((F.col("s") - n1 * (n1 + 1) / 2) / (n1 * n0))).alias("auc"), F.when((n1 > 1) & (n0 > 1), F.round((F.col("m1") - F.col("m0")) / pooled, 5)).alias("cohens_d"))


@query(
    f"""WITH {BARS_SQL}, r AS (SELECT series, bar_ts, outcome, row_number() OVER (PARTITION BY series ORDER BY bar_ts) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM bars)
SELECT series, CASE WHEN i < CAST(floor(n * 0.6) AS BIGINT) THEN 'disc' WHEN i < CAST(floor(n * 0.8) AS BIGINT) THEN 'val' ELSE 'hold' END AS segment, count(*) AS n, count(*) FILTER (outcome = 'UP') AS n_up FROM r GROUP BY 1, 2"""
)
def time_splits(spark, d):
    """TB15, TB16, TB17, AG32: chronological 60/20/20 split."""
    w = Window.partitionBy("series")
    r = src.bars(spark, d).withColumns({"i": F.row_number().over(w.orderBy("bar_ts")) - 1, "n": F.count("*").over(w)})
    seg = F.when(F.col("i") < F.floor(F.col("n") * 0.6), "disc").when(F.col("i") < F.floor(F.col("n") * 0.8), "val").otherwise("hold")
    return r.groupBy("series", seg.alias("segment")).agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "UP").alias("n_up"))


@query(
    f"""WITH {BARS_SQL}, g AS (SELECT series, outcome, count(*) AS m FROM bars GROUP BY 1, 2), q AS (SELECT *, greatest(1, CAST(round_even(100.0 * m / sum(m) OVER (PARTITION BY series), 0) AS BIGINT)) AS quota FROM g),
r AS (SELECT b.series, b.bar_ts, b.outcome, row_number() OVER (PARTITION BY b.series, b.outcome ORDER BY abs(b.ret) DESC, b.bar_ts) - 1 AS i, q.m, least(q.quota, q.m) AS k FROM bars b JOIN q ON b.series = q.series AND b.outcome = q.outcome)
SELECT series, bar_ts, outcome FROM r WHERE i IN (SELECT unnest(list_transform(range(k), lambda j: CAST(floor(j * m / k) AS BIGINT))))"""
)
def stratified_sample(spark, d):
    """TB12, TB13, TB14: proportional quotas by outcome, each filled at even strides by size of return."""
    b = src.bars(spark, d)
    whole = Window.partitionBy("series")
    q = b.groupBy("series", "outcome").agg(F.count("*").alias("m"))
    q = q.withColumn("k", F.least(F.greatest(F.lit(1), F.bround(100.0 * F.col("m") / F.sum("m").over(whole)).cast("long")), F.col("m")))
    r = b.withColumn("i", F.row_number().over(Window.partitionBy("series", "outcome").orderBy(F.desc(F.abs("ret")), "bar_ts")) - 1)
    picks = q.select("series", "outcome", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda j: F.floor(j * F.col("m") / F.col("k")))).alias("i"))
    return r.join(picks, ["series", "outcome", "i"], "left_semi").select("series", "bar_ts", "outcome")


@query(
    """WITH v AS (SELECT vec_id, label, embedding AS e, sqrt(list_dot_product(embedding, embedding)) AS norm FROM embeddings), s AS (SELECT q.vec_id AS id, q.label, d.label AS other, d.vec_id AS d, list_dot_product(q.e, d.e) / (q.norm * d.norm) AS sim FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(sim, 6) DESC, d) AS rn FROM s), k AS (SELECT id, any_value(label) AS label, other, count(*) AS votes FROM r WHERE rn <= 15 GROUP BY id, other), t AS (SELECT *, rank() OVER (PARTITION BY id ORDER BY votes DESC) AS rk FROM k)
SELECT id, any_value(label) AS label, CASE WHEN count(*) FILTER (rk = 1) = 1 THEN max(other) FILTER (rk = 1) END AS voted, CAST(max(votes) AS BIGINT) AS votes FROM t GROUP BY id"""
)
def neighbour_votes(spark, d):
    """JN15, AF19: the 15 most similar vectors of every 20th id, against all, vote, with abstention on a tie. The join prunes by
    pivots; unusable vectors take no part."""
    v = src.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))
    dim = v.agg(F.max(F.size("v"))).first()[0] or 1
    found = most_similar(v.filter(F.col("id") % 20 == 0), v, 15, dim)
    votes = voted(found, v.groupBy(F.col("id").alias("other")).agg(F.min("label").alias("label")))
    return votes.join(v.groupBy("id").agg(F.min("label").alias("label")), "id").select("id", "label", "voted", "votes")


@query(
    f"""WITH {BETS_SQL}, g AS (SELECT version, count(*) AS n, count(*) FILTER (win) AS k FROM bets GROUP BY 1),
m AS (SELECT version, n, k, i, exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + n * ln(0.5::DOUBLE)) AS mass FROM g, LATERAL (SELECT unnest(range(n + 1)) AS i)),
a AS (SELECT version, mass AS at_k FROM m WHERE i = k)
SELECT version, any_value(n) AS n, any_value(k) AS k, round(least(1.0, sum(mass) FILTER (mass <= at_k * (1 + 1e-9))), 7) AS p, round(sum(mass) FILTER (i <= k), 7) AS lower_p,
  round(least(1.0, 2 * {stats.normal_cdf_sql("(-greatest((abs(any_value(k) - any_value(n) * 0.5) - 0.5) / sqrt(any_value(n) * 0.25), 0))")}), 7) AS normal_p, round({stats.normal_cdf_sql("((any_value(k) - any_value(n) * 0.5) / sqrt(any_value(n) * 0.25))")}, 7) AS phi FROM m JOIN a USING (version) GROUP BY 1"""
)
def binomial_tests(spark, d):
    """ST6 to ST9: exact two-sided and lower binomial p of each version's wins, the normal law's p and score."""
    g = bets(spark, d).groupBy("version").agg(F.count("*").alias("n"), F.count_if("win").alias("k"))
    z, half = (F.col("k") - F.col("n") * 0.5) / F.sqrt(F.col("n") * 0.25), F.lit(0.5)
    k, n = F.col("k"), F.col("n")
    return g.select("version", "n", "k", F.round(stats.binomial_p(k, n, half), 7).alias("p"), F.round(stats.binomial_lower(k, n, half), 7).alias("lower_p"), F.round(stats.normal_p(k, n, half), 7).alias("normal_p"), F.round(stats.normal_cdf(z), 7).alias("phi"))


@query()
def bootstrap_intervals(spark, d):
    """ST19: 95 % interval of the mean profit by 2000 resamples of daily sums, seed 7.

    Days are summed first, so one version's group is as long as its days and not as its bets.
    """
    from tidemark.functions import ev

    days = bets(spark, d).groupBy("version", F.floor(F.col("t") / 86_400_000).alias("day")).agg(F.sum(ev.realised(F.col("win"), F.col("entry"))).alias("pnl"), F.count("*").alias("n"))

    def draw(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("day")
        rng = np.random.default_rng(7)
        at = rng.integers(0, len(g), (2000, len(g)))
        means = g["pnl"].to_numpy()[at].sum(axis=1) / g["n"].to_numpy()[at].sum(axis=1)
        lo, hi = np.percentile(means, [2.5, 97.5]) if len(g) >= 10 else (np.nan, np.nan)
        return pd.DataFrame({"version": g["version"].iloc[:1], "n": [int(g["n"].sum())], "mean": [g["pnl"].sum() / g["n"].sum()], "lo": [lo], "hi": [hi]})

    return days.groupBy("version").applyInPandas(draw, "version long, n long, mean double, lo double, hi double")
