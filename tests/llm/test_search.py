"""Both vector searches against brute force; the Jaccard join against its definition."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.llm import jaccard, vectors
from tidemark.llm.common import connected_components

V = "vec_id long, embedding array<float>, score double"


def table(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[300:420] = x[300]  # a hot vector
    rows = [(k, [float(a) for a in v], 0.0) for k, v in enumerate(x)]
    rows += [(700, None, 0.0), (750, [1.0, None] + [0.0] * 6, 0.0), (800, [float("nan")] * 8, 0.0), (850, [float("inf")] * 8, 0.0), (900, [0.0] * 8, 0.0)]
    return spark.createDataFrame(rows, V), x


def test_exact_top_k(spark):
    df, x = table(spark)
    got = sorted(map(tuple, vectors.exact_top_k(df, F.col("id") % 50 == 0, max_pivots=16).collect()))
    y = np.vstack([np.floor(256 * x.astype(np.float64)).astype(np.int64), np.zeros((1, 8), np.int64)])
    ids, want = np.append(np.arange(600), 900), []
    for q in np.flatnonzero(ids % 50 == 0):
        s = y @ y[q]
        o = np.lexsort((ids, -s))
        want += [(int(ids[q]), r + 1, int(ids[k]), int(s[k])) for r, k in enumerate(o[o != q][:5])]
    assert got == sorted(want)


def recall(spark, x, got, ids, k=10):
    """Share of the k nearest that were found, with every row checked for its rank, distance and id."""
    hit = 0
    for q in ids:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        d = np.sqrt(((x[q].astype(np.float64) - x.astype(np.float64)) ** 2).sum(axis=1))
        assert [r["rank"] for r in mine] == list(range(1, k + 1)) and all(r.vec_id != q and abs(r.score - d[r.vec_id]) < 1e-12 for r in mine)
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        o = np.lexsort((np.arange(len(x)), d))
        hit += len({int(k) for k in o[o != q][:k]} & {r.vec_id for r in mine})
    return hit / (k * len(ids))


def test_multi_index(spark):
    df, x = table(spark)
    rows = vectors.multi_index_search(df, F.col("id") % 100 == 0, least=100, probe=0.3).collect()
    assert all(r.vec_id < 600 for r in rows) and recall(spark, x, rows, range(0, 600, 100)) >= 0.8
    every = vectors.multi_index_search(df, F.col("id") == 300, probe=1.0).orderBy("rank").collect()
    assert [r.vec_id for r in every] == list(range(301, 311))  # ties to the smaller id


@pytest.mark.parametrize("n", [10_000, 50_000])
def test_recall_as_registered(spark, n, tmp_path):
    """Directions without structure, the hardest case: at least 0.9, with a fifth of all entries ranked."""
    x = np.random.default_rng(n).normal(size=(n, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": list(x)}), tmp_path / "embeddings.parquet")
    rows = vectors.op5_multi_index(spark, str(tmp_path)).collect()
    assert len(rows) == 10 * (n // 100)
    assert recall(spark, x, rows, range(0, n, 100 if n < 20_000 else 400)) >= 0.9


def test_pairs_come_in_the_order_of_their_distance():
    rng = np.random.default_rng(1)
    a, b, sizes = rng.random(7), rng.random(5), rng.integers(0, 3, (7, 5))
    flat = sorted((a[i] + b[j], i, sizes[i, j]) for i in range(7) for j in range(5) if sizes[i, j])
    for enough in (1, 5, 12, 1000):
        total, stop, firsts = 0, -np.inf, set()
        for s, i, m in flat:
            if total >= enough:
                break
            stop, total = s, total + m
            firsts |= {i}
        got = vectors.Pairs(sizes).reach(a, b, enough)
        assert got[0] == stop and set(got[1]) == firsts


def test_pairs_stop_where_no_later_one_can_hold_a_neighbour():
    a, b, sizes = np.array([0.0, 1.0, 100.0]), np.array([0.0, 2.0, 300.0]), np.full((3, 3), 5)
    assert vectors.Pairs(sizes).reach(a, b, 10**6) == (400.0, [0, 1, 2])
    assert vectors.Pairs(sizes, 0.5).reach(a, b, 10**6, 7) == (3.0, [0, 1])  # 7 lie within 1 + 0.5, later ones are needed up to (1 + 1)^2


def reads(index, queries, probe, k=10):
    """Share of all rows that lie in the first halves that a query visits: what it multiplies."""
    read = {}
    for r in index.asked(queries, max(1000, int(probe * index.n)) + k + 1, k + 1).collect():
        read |= dict(zip(np.frombuffer(r.q_ids, "<i8").tolist(), np.frombuffer(r.read, "<i8").tolist(), strict=True))
    return np.mean(list(read.values())) / index.n


def test_vectors_in_clusters_are_read_in_part(spark):
    """50,000 vectors in clusters: recall as before, a few percent of the rows read, and less processor time than all products."""
    import time

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(200, 64))
    x = (centres[rng.integers(0, 200, 50_000)] + rng.normal(0, 0.05, (50_000, 64))).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)})).repartition(4).cache()
    queries = F.col("id") % 100 == 0
    rows = vectors.multi_index_search(df, queries).collect()
    assert recall(spark, x, rows, range(0, 50_000, 1000)) >= 0.9
    real = vectors.usable(df, "vec_id", "embedding", False)
    index = vectors.MultiIndex(real)
    clustered = reads(index, real.filter(queries), 0.2)
    y = rng.normal(size=(10_000, 64)).astype(np.float32)
    plain = spark.createDataFrame(pa.table({"vec_id": np.arange(len(y)), "embedding": list(y)}))
    real_y = vectors.usable(plain, "vec_id", "embedding", False)
    loose = reads(vectors.MultiIndex(real_y), real_y.filter(queries), 0.2)
    assert clustered <= 0.05 and clustered < 0.1 * loose
    # what a task does for 100 queries: traversal and the products of the visited first halves, against all products
    q = x[:10_000:100].astype(np.float64)
    a, b = index.distances(q)
    began = time.process_time()
    found = [index.pairs.reach(*ab, 10_011, 11) for ab in zip(a, b, strict=True)]
    by_first = {}
    near = vectors.nearest(x[:, :32].astype(np.float64), index.left)
    lists = {i: x[near == i].astype(np.float64) for i in {i for _, f in found for i in f}}
    began = time.process_time()
    found = [index.pairs.reach(*ab, 10_011, 11) for ab in zip(a, b, strict=True)]
    for n, (_, firsts) in enumerate(found):
        for i in firsts:
            by_first.setdefault(i, []).append(n)
    for i, who in by_first.items():
        np.partition(((q[who] ** 2).sum(axis=1)[:, None] + (lists[i] ** 2).sum(axis=1) - 2 * q[who] @ lists[i].T), min(9, len(lists[i]) - 1), axis=1)
    ours, began = time.process_time() - began, time.process_time()
    for v in q:
        np.argpartition(((x.astype(np.float64) - v) ** 2).sum(axis=1), 10)
    assert ours < time.process_time() - began


def test_repeated_ids_unequal_lengths_and_few_candidates(spark):
    rows = [(0, [1.0, 0.0], 0.0), (0, [0.0, 1.0, 9.0], 0.0), (1, [1.0], 0.0), (1, [1.0], 0.0), (2, [0.0, 2.0], 0.0), (None, [1.0, 1.0], 0.0)]
    df = spark.createDataFrame(rows, V)
    got = sorted(map(tuple, vectors.exact_top_k(df, F.col("id") == 0).collect()))
    assert got == [(0, 1, 2, 131072), (0, 2, 1, 0), (0, 3, 1, 0)]  # [0, 1, 9] asks: it is smaller than [1, 0]
    near = [(r[0], r[1], r[2]) for r in sorted(vectors.multi_index_search(df, F.col("id") == 0).collect())]
    assert near == [(0, 1, 2), (0, 2, 1), (0, 3, 1)]


def test_empty_vector_tables(spark):
    none = spark.createDataFrame([], V)
    assert vectors.exact_top_k(none, F.col("id") % 50 == 0).count() == 0
    assert vectors.multi_index_search(none, F.col("id") % 50 == 0).count() == 0


def plain_groups(texts, n, percent):
    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()

    sets = {k: grams(t) for k, t in texts}
    label = {k: k for k in sets}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {k: (len(sets[k]), root(k)) for k in keys}


def near_copies():
    rng = np.random.default_rng(9)
    words = [f"w{k}" for k in range(300)]
    texts = []
    for base in range(6):
        w = list(rng.choice(words, 120))
        for _ in range(12):
            c = list(w)
            for at in rng.choice(120, rng.integers(0, 5), replace=False):
                c[at] = str(rng.choice(words))
            texts.append(" ".join(c))
    texts += [None, "", "   ", "one", "ONE", "one two", "One two three", "x " * 5000, texts[0], texts[0].upper(), texts[5]]
    return list(enumerate(texts))


def test_jaccard_groups(spark):
    texts = near_copies()
    df = spark.createDataFrame([(k, t, 1) for k, t in texts], "doc_id long, text string, n long")
    for n, percent in ((3, 90), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked_groups(df, n, percent).collect()}
        assert got == plain_groups(texts, n, percent)


def test_jaccard_groups_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MEETING", 3)
    monkeypatch.setattr(jaccard, "GROUP", 4)
    monkeypatch.setattr(jaccard, "WALKED", 5)
    texts = near_copies()
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked_groups(df).collect()}
    assert got == plain_groups(texts, 3, 90)


@pytest.mark.parametrize("parts", [1, 3])
def test_repeated_ids_with_different_near_texts(spark, parts):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(5, a), (5, b), (7, b + " end"), (9, a + " end"), (4, b + " more"), (5, a.upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.linked_groups(df).collect())
    assert got == [(4, 59, 4), (5, 58, 4), (5, 58, 5), (5, 58, 5), (7, 59, 4), (9, 59, 5)]
    kept = [(r.doc_id, r.text.lower()) for r in jaccard.keep_one(df, 3, 90).collect()]
    assert sorted(kept) == [(4, b + " more"), (5, a)]  # of doc 5 one text is the first of its group, the other is not


def test_components_of_a_hub_and_a_chain(spark):
    links = [(0, k) for k in range(1, 400)] + [(k, k + 1) for k in range(1000, 1090)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(400)} | {k: 1000 for k in range(1000, 1091)}


def test_suffix_filter_counts_what_follows():
    sig = bytes([2, 255] + [0] * 126)
    assert jaccard._suffixes([np.array([2])], [bytes([0, 1, 1, 0])], [sig]).tolist() == [[1, 255] + [0] * 126]
    rng = np.random.default_rng(3)
    places, slices, sigs, want = [], [], [], []
    for _ in range(5):
        all_ = rng.integers(0, 128, 400).astype(np.uint8)
        at = np.sort(rng.choice(100, 30, replace=False))
        sig = np.bincount(all_, minlength=128).astype(np.uint8)
        places, slices, sigs = [*places, at], [*slices, all_[:100].tobytes()], [*sigs, sig.tobytes()]
        want += [np.bincount(all_[p + 1 :], minlength=128).tolist() for p in at]
    assert jaccard._suffixes(places, slices, sigs).tolist() == want
    used, begin, got = np.zeros(128, np.int64), 0, []
    for lo in range(0, 30, 7):  # one set in parts
        part = places[0][lo : lo + 7]
        got += jaccard._suffixes([part], slices[:1], sigs[:1], begin, used).tolist()
        begin = int(part[-1]) + 1
    assert got == want[:30]


def test_two_near_copies_of_a_million_words(spark):
    rng = np.random.default_rng(4)
    w = [f"w{k}" for k in rng.integers(0, 2_000_000, 1_000_000)]
    other = list(w)
    for at in rng.choice(len(w), 5_000, replace=False):
        other[at] = "changed"
    rows = [(1, " ".join(w)), (2, " ".join(other)), (3, " ".join(w[:900_002])), (4, "a short text of some words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    size = jaccard.SLICES + 40
    known = jaccard.summaries(df, 3, 90, jaccard.gram_counts(df, 3)).filter("doc_id < 4")
    reps = known.select(F.monotonically_increasing_id().alias("id"), "n", "prefix", "slices", "sig")
    got = jaccard.prefix_rows(reps).agg(F.count("*").alias("rows"), F.max(F.length("sig")).alias("sig")).first()
    assert got["sig"] == jaccard.SLICES and got["rows"] * size < 100_000_000  # in proportion to the words
    assert {r.doc_id: r.component_id for r in jaccard.linked_groups(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_blocks_test_each_pair_once():
    side, seen = np.array([0, 0, 1, 1]), []

    def linked(i, left):
        seen.extend((int(i), int(j)) for j in left)
        return np.zeros(len(left), bool)

    assert jaccard._walk(side, 4, linked) == []
    assert sorted(tuple(sorted(p)) for p in set(map(tuple, map(sorted, seen)))) == [(0, 2), (0, 3), (1, 2), (1, 3)] and len(seen) == 4


def test_jaccard_repeated_null_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (1, "q r s t u"), (None, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")
    got = sorted(map(tuple, jaccard.linked_groups(df).collect()), key=repr)
    assert got == sorted([(1, 3, 1), (1, 3, 1), (1, 3, 1), (None, 3, None), (2, 3, 1)], key=repr)
    assert jaccard.keep_one(df).count() == 3
    assert jaccard.linked_groups(df.limit(0)).count() == 0
