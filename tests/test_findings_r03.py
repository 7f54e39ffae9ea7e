"""Findings of round 3 on small tables that show them."""

import math
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import same_rows
from tidemark.functions import stats
from tidemark.operators import neighbours
from tidemark.plans import audits, catalog, registries
from tidemark.sources import events as src

DAY = datetime(2024, 1, 1)


def events(tmp_path, rows: list[tuple]) -> str:
    """A folder with an events table of (ts, user_id, event_type, value)."""
    con = duckdb.connect()
    con.execute("CREATE TABLE e (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO e VALUES (?, ?, ?, ?, ?, '{}')", [(i, *r) for i, r in enumerate(rows)])
    con.execute(f"COPY e TO '{tmp_path}/events.parquet' (FORMAT PARQUET)")
    return str(tmp_path)


def both(spark, name: str, folder: str) -> tuple[list, list]:
    """same_rows with NaN by name, for it does not equal itself."""
    plain = lambda rows: [tuple("NaN" if isinstance(x, float) and math.isnan(x) else x for x in r) for r in rows]
    got, want = same_rows(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name], folder)
    return plain(got), plain(want)


def test_f1_series_whose_quotes_stand_still(spark, tmp_path):
    rows = [(DAY + timedelta(hours=h, minutes=m), 1, "click", 50.0 if h < 40 else 50.0 + (h * 7 + m) % 11) for h in range(80) for m in (5, 35)]
    got, want = both(spark, "rolling_statistics", events(tmp_path, rows))
    assert got == want and any("NaN" in r for r in got) and any(isinstance(x, float) and x not in (0.0, 1.0) for r in got for x in r)


def neighbours_of(delta: float) -> tuple[tuple, tuple]:
    """Two pairs of values with the same difference in cents, of which the first's is a bit smaller in doubles."""
    pct = lambda cents: 100 * (cents / 100 / 100)
    found = {pct(a + round(100 * delta)) - pct(a): (a / 100, (a + round(100 * delta)) / 100) for a in range(200, 5000)}
    low, high = sorted(found)[:2]
    assert 0 < high - low < 1e-12
    return found[low], found[high]


@pytest.mark.parametrize("name", ["symbol_counts", "predicate_hits", "versioned_symbols", "window_views", "binning_snapshots", "frozen_edges"])
def test_f6_f8_to_f12_changes_a_bit_below_an_edge(spark, tmp_path, name):
    low, high = neighbours_of(40.24)
    windows = [(20.0, 20.0 + k) for k in range(9)] + [low] + 3 * [high]
    rows = [(DAY + timedelta(hours=h, minutes=20 * i), 1, "click", v) for h, pair in enumerate(windows) for i, v in enumerate(pair)]
    if name == "versioned_symbols":  # the edges hold from the fifth of January on
        rows += [(DAY + timedelta(days=5, minutes=20 * i), 1, "click", v) for i, v in enumerate(low)]
    got, want = both(spark, name, events(tmp_path, rows))
    assert got == want and got


def test_f6_f8_f11_percentiles_to_the_bit(spark):
    con = duckdb.connect()
    con.execute("SELECT setseed(0.3)")
    con.execute("CREATE TABLE x AS SELECT g, 100 * (floor(random() * 9800) / 10000) - 100 * (floor(random() * 9800) / 10000) AS v FROM range(200) t(g), range(11 + g)")
    want = dict(con.execute("SELECT g, quantile_cont(v, [0.2, 0.4, 0.6, 0.8]) FROM x GROUP BY 1").fetchall())
    rows = con.execute("SELECT g, list_sort(list(v)) FROM x GROUP BY 1").fetchall()
    got = spark.createDataFrame(rows, "g long, v array<double>").select("g", stats.quantiles(F.col("v"), (0.2, 0.4, 0.6, 0.8)).alias("q")).collect()
    assert {r["g"]: r["q"] for r in got} == want


def test_f4_entries_at_the_floor(spark, tmp_path):
    rows = [(DAY + timedelta(hours=h), user, "click", v) for h in range(80) for user, v in ((1, 30.0), (2, 36.0), (41, 30.0), (42, 20.0))]
    got, want = both(spark, "four_gates", events(tmp_path, rows))
    assert got == want and len(got) == 8


def test_f13_cap_of_a_day_over_all_series(spark):
    rows = [(series, side, (h * 7 + series) % 48 * 3_600_000) for series in range(200) for side in ("high", "low") for h in range(3)]
    got = audits.capped_signals(spark.createDataFrame(rows, "series long, side string, signal_ts long")).collect()
    first = {r for day in (0, 1) for r in sorted((t, s, side) for s, side, t in rows if t // 86_400_000 == day)[:8]}
    assert len(got) == len(rows) and {(r["signal_ts"], r["series"], r["side"]) for r in got if not r["over_cap"]} == first


def test_f14_replicates_are_not_shuffled(spark):
    q = catalog.QUERIES["cost_scenarios"](spark, "/root/testdata/sf0.001")
    assert "replicate" not in q._jdf.queryExecution().toString()


def test_f2_copies_are_one_point_and_one_question(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 4))[rng.integers(0, 30, 600)]
    rows = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "id long, v array<double>")
    sizes, keep = {}, neighbours.written

    def read(df, label):
        out = keep(df, label)
        sizes[label] = out.count()
        return out

    monkeypatch.setattr(neighbours, "written", read)
    got = {}
    for r in neighbours.most_similar(rows.filter("id % 3 = 0"), rows, 5, 4).collect():
        got.setdefault(r.id, []).append((r["rank"], r.other, r.similarity))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = np.round(u @ u.T, 6)
    want = {q: [k for k in np.lexsort((np.arange(len(x)), -sim[q])) if k != q][:5] for q in range(0, len(x), 3)}
    assert {q: [(k, o) for k, o, _ in sorted(f)] for q, f in got.items()} == {q: [(k + 1, int(o)) for k, o in enumerate(w)] for q, w in want.items()}
    assert sizes["points"] == len(np.unique(x, axis=0)) and sizes["questions"] == len(np.unique(x[::3], axis=0))


def test_f3_f5_f7_sums_keep_the_order_of_events(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, DAY + timedelta(hours=i // 40, minutes=i % 40), 1, "click", float(v) / 100) for i, v in enumerate(rng.integers(100, 9900, 4800))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").repartition(16, F.xxhash64("event_id")).write.parquet(f"{tmp_path}/events.parquet")

    def added(values: list[float]) -> float:
        total = 0.0
        for v in values:
            total += v
        return total

    value = [r[4] for r in rows]
    hours = [added(value[at : at + 40]) for at in range(0, len(rows), 40)]
    bars = src.bars(spark, str(tmp_path))
    assert [r.v for r in bars.orderBy("bar_ts").collect()] == hours
    assert [r.v for r in src.cycles(bars).orderBy("cycle_ts").collect()] == [added(hours[at : at + 3]) for at in range(0, len(hours), 3)]
    pct = [100 * (v / 100) for v in value]
    assert [r.f_mean for r in registries.windows(spark, str(tmp_path)).orderBy("start").collect()] == [added(pct[at : at + 40]) / 40 for at in range(0, len(rows), 40)]


def test_f3_f7_percentiles_over_all_rows_to_the_bit(spark):
    con = duckdb.connect()
    con.execute("SELECT setseed(0.4)")
    names, shares = [f"c{k}" for k in range(12)], (0.25, 0.33, 0.66, 0.8)
    con.execute(f"CREATE TABLE x AS SELECT {', '.join(f'round(random() * {10 * 4**k} , 3) AS c{k}' for k in range(6))}, {', '.join(f'round(random() * {3 * (k - 5)}) AS c{k}' for k in range(6, 12))} FROM range(1999)")
    want = con.execute(f"SELECT {', '.join(f'quantile_cont({c}, {p})' for c in names for p in shares)} FROM x").fetchone()
    rows = spark.createDataFrame(con.execute("SELECT * FROM x").fetchall(), ", ".join(f"{c} double" for c in names))
    got = stats.percentiles(rows, {c: F.col(c) for c in names}, {f"{c}_{k}": (c, p) for c in names for k, p in enumerate(shares)}).first()
    assert tuple(got) == want
    assert tuple(stats.percentiles(rows.limit(0), {"c0": F.col("c0")}, {"p": ("c0", 0.5)}).first()) == (None,)
