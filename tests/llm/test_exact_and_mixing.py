"""Exact dedup, source mixing and exact top-k search against plain versions, with odd rows."""

import hashlib
import os
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm.exact_dedup import cells_for, exact_dedup
from larkspur.llm.mixing import bucket_digits, mix, mixed_documents
from larkspur.llm.queries import ORACLE, QUERIES
from larkspur.llm import topk
from larkspur.llm.topk import exact_topk
from tests.conftest import DATA
from tests.helpers import connect, same

DOCS = "doc_id long, text string, source string, keep_id string, size int, row int"
ODD = [
    (1, "a b c", "x", "k", 0, 1),
    (2, "a b c", "x", "k", 0, 1),
    (2, "a b c", "x", "k", 0, 1),
    (3, None, None, None, None, None),
    (4, "", "y", "k", 0, 1),
    (5, "  \t ", "y", "k", 0, 1),
    (None, "a b c", "x", "k", 0, 1),
    (6, "w " * 50_000, "z", "k", 0, 1),
    (7, "é ü", None, "k", 0, 1),
]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracles(spark, name):
    same(QUERIES[name](spark, f"{DATA}/sf0.001"), connect(f"{DATA}/sf0.001"), ORACLE[name])


@pytest.mark.parametrize("cells", [64, 1 << 20])  # with few cells nearly all rows take the shuffle
def test_exact_dedup(spark, cells):
    got = exact_dedup(spark.createDataFrame(ODD, DOCS), cells=cells).collect()
    assert len(got) == len(ODD)
    groups = defaultdict(list)
    for doc_id, text, *_ in ODD:
        groups[text or ""].append(doc_id)
    for r in got:
        group = groups[r.text or ""]
        assert r.text_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        assert r.group_size == len(group)
        assert r.keep_id == max((x for x in group if x is not None), default=None)
    for text, group in groups.items():
        kept = [r for r in got if (r.text or "") == text and r.kept]
        assert len(kept) == 1 and kept[0].doc_id == max((x for x in group if x is not None), default=None)


def test_exact_dedup_keeps_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, "a", 5, 6, 7, 8, 9), (2, "a", 5, 6, 7, 8, 9)], "doc_id long, text string, __row int, row int, sha int, h int, kept int")
    got = exact_dedup(rows)
    assert got.columns == ["doc_id", "text", "__row", "row", "sha", "h", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((r.doc_id, r["__row"], r.row, r.sha, r.h, r.keep_id, r.kept) for r in got.collect()) == [(1, 5, 6, 7, 8, 2, False), (2, 5, 6, 7, 8, 2, True)]
    assert exact_dedup(rows, keep=("doc_id",)).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_cells_grow_with_rows():
    assert [cells_for(n) for n in (0, 1, 1 << 16, (1 << 16) + 1, 1 << 22, 1 << 40)] == [1 << 20, 1 << 20, 1 << 20, 1 << 21, 1 << 26, 1 << 28]


def test_exact_dedup_empty(spark):
    assert exact_dedup(spark.createDataFrame([], DOCS)).count() == 0


def plain_targets(sizes, epochs=3, weights=(1, 2, 3)):
    """Water filling, one round after another."""
    total = sum(sizes.values())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), total
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > epochs * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = float(epochs * sizes[s])
            left -= epochs * sizes[s]
            free.discard(s)
    return target


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_mixing(spark, sf):
    docs = spark.read.parquet(f"{DATA}/{sf}/documents.parquet")
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    got = mix(docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix(docs.repartition(7)).collect()))
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        largest[source[r.doc_id]] = max(largest[source[r.doc_id]], r.size)
    target = plain_targets(sizes)
    for r in got:
        assert r.target == pytest.approx(target[source[r.doc_id]]) and r.source_size == sizes[source[r.doc_id]]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(largest.values())
    assert 0 <= sum(sizes.values()) - sum(taken.values()) <= max(largest.values())


def test_mixing_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    got = mix(docs).collect()
    assert len(got) == len(ODD) and all(r.taken == 0 for r in got if r["size"] == 0)
    want = plain_targets({"x": 12, "y": 0, "z": 50_000, None: 2})
    assert {round(r.target, 6) for r in got} == {round(t, 6) for t in want.values()}
    copies = mixed_documents(docs)
    assert copies.columns == docs.columns
    assert copies.where("doc_id = 7").count() == next(r.taken // 2 for r in got if r.doc_id == 7)
    assert mix(docs.limit(0)).count() == 0 and mixed_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("ident", [None, 5])
def test_mixing_of_rows_with_one_id(spark, ident):
    """Rows of one id stand at few places and are taken one by one, by both functions alike."""
    rows = [(ident, " ".join(["w"] * n) + f" {i}", source, i, i) for i, (n, source) in enumerate([(2, "a"), (2, "a"), (2, "a"), (4, "a"), (4, "a"), (6, "b"), (6, "b"), (6, "b"), (6, "b"), (6, "c")] * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __size int, copy int")
    got, copies = mix(docs).collect(), mixed_documents(docs)
    assert len(got) == len(rows) and copies.columns == docs.columns
    assert sum(r.taken for r in got) == sum(len(r.text.split()) for r in copies.collect())
    assert 0 <= sum(r["size"] for r in got) - sum(r.taken for r in got) <= 7
    by_size = lambda pairs: {k: sum(n for x, n in pairs if x == k) for k, _ in pairs}
    assert by_size([(r["size"], r.taken) for r in got]) == by_size([(len(r.text.split()), len(r.text.split())) for r in copies.collect()])
    assert {r["__size"] for r in copies.collect()} <= set(range(len(rows)))
    assert sorted(map(tuple, copies.collect())) == sorted(map(tuple, mixed_documents(docs.repartition(5)).collect()))


def test_buckets_grow_with_rows():
    assert [bucket_digits(n) for n in (0, 1000, 1 << 28, 10**10)] == [3, 3, 4, 5]


def test_mixed_documents_agree(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    times = mix(docs).where("taken > 0").select("doc_id", (F.col("taken") / F.col("size")).cast("long").alias("count"))
    assert mixed_documents(docs).groupBy("doc_id").count().exceptAll(times).count() == 0


def plain_topk(rows, k=10):
    ok = [(i, np.floor(1024 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q in sorted({i for i, _ in ok if i % 100 == 0}):
        for v in {tuple(v) for i, v in ok if i == q}:
            scored = sorted((-int(np.dot(v, x)), i) for i, x in ok if i != q and len(x) == len(v))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)}
    return out


def test_topk_odd_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(220)]
    rows += [(300, None), (301, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, [1.0] * 6), (400, [1.0, 2.0]), (401, [3.0, 4.0]), (500, [])]
    rows += [(i, [0.5] * 6) for i in range(600, 640)]  # ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {tuple(r) for r in exact_topk(df).collect()} == plain_topk(rows)
    assert {tuple(r) for r in exact_topk(df, query_bytes=100).collect()} == plain_topk(rows)
    assert exact_topk(df.limit(0)).count() == 0
    twice = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (100, [1.0, 1.0])]
    assert [tuple(r) for r in exact_topk(spark.createDataFrame(twice, "vec_id long, embedding array<float>")).orderBy("rank").collect()] == [(100, 1, 1, 1048576), (100, 2, 1, 1048576)]


def test_topk_ids_shared_by_several_rows(spark):
    rows = [(100, [1.0, 0.0]), (100, [0.0, 1.0]), (100, [0.0, 1.0]), (1, [2.0, 1.0]), (2, [1.0, 3.0])]
    df = spark.createDataFrame([(*r, 5, 6) for r in rows], "vec_id long, embedding array<float>, query int, block int")
    got = sorted(tuple(r) for r in exact_topk(df).collect())
    unit = 1 << 20
    assert got == sorted([(100, 1, 1, 2 * unit), (100, 2, 2, unit), (100, 1, 2, 3 * unit), (100, 2, 1, unit)])


def test_topk_of_huge_components(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    big = float(1 << 20)  # products need more than 53 bits, and more than 62 before they cancel out
    rows = [(100, [big + 1, 1.0, 0.0]), (1, [big, 3.0, 0.0]), (2, [big, 2.0, 0.0]), (3, [-big, -3.0, 0.0])]
    assert {tuple(r) for r in exact_topk(make(rows)).collect()} == {(100, 1, 1, 1024**2 * ((1 << 40) + (1 << 20) + 3)), (100, 2, 2, 1024**2 * ((1 << 40) + (1 << 20) + 2)), (100, 3, 3, -(1024**2) * ((1 << 40) + (1 << 20) + 3))}
    huge = float(1 << 24)
    assert {tuple(r) for r in exact_topk(make([(100, [huge, huge]), (1, [huge, -huge + 1])])).collect()} == {(100, 1, 1, 1024**2 * (1 << 24))}
    for rows in ([(100, [1e12, 1e12]), (1, [1e12, 1e12])], [(100, [1e30]), (1, [1.0])]):
        with pytest.raises(Exception, match="64 bits"):
            exact_topk(make(rows)).collect()


def test_topk_leaves_candidates_out(spark):
    """On vectors about a hundred centres fewer than one in ten candidates is evaluated, and the ranking is exact."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(100, 64))
    v = np.floor(1024 * (centres[rng.integers(0, 100, 5000)] + 0.1 * rng.normal(size=(5000, 64)))).astype(np.int64)
    ids = np.arange(5000)
    basis = topk.pick_pivots(v[:2000], topk.PIVOTS)
    assert np.allclose(basis.T @ basis, np.eye(topk.PIVOTS))
    search = topk.Search(ids[:50], v[:50], basis, 10)
    for low in range(0, 5000, 1000):
        search.add(ids[low : low + 1000], v[low : low + 1000], *topk.placed(v[low : low + 1000], basis))
    scores = v[:50] @ v.T
    for i in range(50):
        scores[i, i] = -(1 << 60)
        order = np.lexsort((ids, -scores[i]))[:10]
        assert search.found[i].tolist() == order.tolist() and search.scores[i].tolist() == scores[i][order].tolist()
    assert search.evaluated < 0.1 * search.compared


def test_written_tables_are_removed(spark, tmp_path):
    from larkspur.llm import common

    kept = common.cut(spark.range(2), "kept")
    since = common.mark(spark)
    out = common.cut(spark.range(3), "gone")
    path = common._WRITTEN[spark.sparkContext.applicationId][since]
    assert out.count() == 3 and path.startswith(spark.conf.get("spark.checkpoint.dir"))
    common.release(spark, str(tmp_path / "none"), since=since)
    assert not os.path.exists(path.removeprefix("file://")) and common.mark(spark) == since and kept.count() == 2
