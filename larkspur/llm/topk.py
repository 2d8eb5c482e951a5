"""Exact inner-product search by pivot-table elimination.

The distances of a vector to some pivots and its length say where it stands in the pivots' span and how far from it. The table keeps this for
every vector, computed once: coordinates in an orthonormal basis of the pivots, and the distance from their span. Of two vectors
the least distance that these allow, and so the largest inner product, is known without reading them:
q.x <= p(q).p(x) + r(q) r(x), which no single pivot's triangle inequality can beat. Candidates are evaluated in falling order of
this bound, in growing rounds, until the next bound lies under the k-th best score; that is exact.

Queries go in blocks of at most QUERY_BYTES, one after the other: a block is sent to the executors, each task keeps its k best candidates
of each query, these are written, and the block is let go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.arrowtext import released
from larkspur.llm.common import cut

SCALE = 1024
#: Bytes of the vectors in a block of queries.
QUERY_BYTES = 32 << 20
PIVOT_SAMPLE = 2048
PIVOTS = 48
#: Candidates evaluated in the first round, and by how much a round is larger than the one before.
STEP, GROWTH = 64, 4
#: Rows and queries whose bounds are computed at once.
ROWS, QUERIES = 8192, 64
#: Components must be smaller: they are 64-bit integers.
MOST = float(1 << 62)


def integers(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v: floor(SCALE * x) of each component; without null ids and vectors that are null, empty or hold a null or non-finite component. A component beyond 64 bits is an error."""
    x = F.col(vec_col)
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    scaled = lambda e: F.when(F.abs(e.cast("double")) * SCALE < MOST, F.floor(e.cast("double") * SCALE).cast("long")).otherwise(F.raise_error(F.lit("a scaled component does not fit 64 bits")).cast("long"))
    return df.where(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, scaled).alias("v"))


def pick_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """An orthonormal basis (columns) of the span of n rows, each chosen as the farthest from the span of those before."""
    rest, chosen = sample.astype(np.float64), []
    least = 1e-9 * (rest**2).sum(1).max(initial=0)
    while len(chosen) < n and len(rest):
        far = (rest**2).sum(1)
        at = int(far.argmax())
        if far[at] <= least:
            break
        chosen.append(rest[at] / np.sqrt(far[at]))
        rest = rest - np.outer(rest @ chosen[-1], chosen[-1])
    return np.linalg.qr(np.stack(chosen, 1))[0] if chosen else np.zeros((sample.shape[1], 0))


def by_length(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of the rows with vectors of one length: the length, their places, and their vectors."""
    column = batch.column("v").combine_chunks() if isinstance(batch, pa.Table) else batch.column("v")
    lengths = np.asarray(column.value_lengths())
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield int(d), at, np.asarray(column.take(pa.array(at)).flatten()).reshape(len(at), d)


def placed(v: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coordinates in the basis, distance from its span, and length."""
    x = v.astype(np.float64)
    p, square = x @ basis, (x**2).sum(1)
    return p, np.sqrt(np.maximum(0, square - (p**2).sum(1))), np.sqrt(square)


def tabled(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """vectors with p, r and length, the pivot table's row of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, r, length = [None] * batch.num_rows, np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for d, at, v in by_length(batch):
                coordinates, r[at], length[at] = placed(v, pivots.get(d, np.zeros((d, 0))))
                for i, row in zip(at.tolist(), coordinates, strict=True):
                    p[i] = row
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.list_(pa.float64())), pa.array(r), pa.array(length)], names=["vec_id", "v", "p", "r", "length"])

    return vectors.mapInArrow(run, "vec_id long, v array<long>, p array<double>, r double, length double")


def products(x: np.ndarray, q: np.ndarray, bound: float) -> np.ndarray:
    """The inner products of the rows of x with q, exactly; bound: what none of them exceeds."""
    if bound < 1 << 52:
        return np.rint(x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    if bound < MOST:
        return x @ q
    out = [sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in x]
    if any(abs(s) >= 1 << 63 for s in out):
        raise OverflowError("a score does not fit 64 bits")
    return np.array(out, np.int64)


class Search:
    """The k best candidates so far of each query of one length; compared and evaluated count pairs of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, basis: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.p, self.r, self.length = placed(vectors, basis)
        self.scores, self.found = [np.zeros(0, np.int64) for _ in ids], [np.zeros(0, np.int64) for _ in ids]
        self.compared = self.evaluated = 0

    def add(self, ids: np.ndarray, x: np.ndarray, p: np.ndarray, r: np.ndarray, length: np.ndarray) -> None:
        for low in range(0, len(self.ids), QUERIES):
            some = slice(low, low + QUERIES)
            top = np.outer(self.length[some], length)
            bounds = self.p[some] @ p.T + np.outer(self.r[some], r)
            bounds += 1 + 1e-7 * top  # above what rounding may take away
            for i, bound, most in zip(range(low, low + len(bounds)), bounds, top.max(1, initial=0), strict=True):
                self.one(i, ids, x, bound, most)

    def one(self, i: int, ids: np.ndarray, x: np.ndarray, bound: np.ndarray, most: float) -> None:
        rest, step = np.flatnonzero(ids != self.ids[i]), STEP
        self.compared += len(rest)
        while True:
            if len(self.scores[i]) == self.k:
                rest = rest[bound[rest] >= self.scores[i][-1]]
            if not len(rest):
                return
            part = rest
            if len(rest) > step:
                order = np.argpartition(-bound[rest], step)
                part, rest = rest[order[:step]], rest[order[step:]]
            else:
                rest = rest[:0]
            self.evaluated += len(part)
            s, c = np.concatenate([self.scores[i], products(x[part], self.vectors[i], most)]), np.concatenate([self.found[i], ids[part]])
            top = np.lexsort((c, -s))[: self.k]
            self.scores[i], self.found[i] = s[top], c[top]
            step *= GROWTH


def exact_topk(df: DataFrame, k: int = 10, query_every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query (ids divisible by query_every), ties to the smaller id.

    A vector is never a candidate for a query of its own id. Repeated rows are candidates of their own, with a rank each; a repeated
    query row counts once, while different vectors of one query id each have their own ranking. Only vectors of one length are compared. No query or
    no candidate gives an empty result. Scores are exact; a component or a score that does not fit 64 bits is an error. Other columns of df, whatever their
    names, are not read.
    """
    spark = df.sparkSession
    vectors = cut(integers(df, id_col, vec_col), "topk-vectors")
    sample = vectors.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(PIVOT_SAMPLE).toArrow()
    basis = spark.sparkContext.broadcast({d: pick_pivots(v, PIVOTS) for d, _, v in by_length(sample)})
    table = cut(tabled(vectors, basis.value), "topk-table")
    asked = cut(vectors.where(F.col("vec_id") % query_every == 0).dropDuplicates(["vec_id", "v"]), "topk-queries")
    taken = asked.agg(F.sum(F.size("v").cast("long") * 8)).first()[0] or 0
    blocks = -(-taken // query_bytes)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(max(1, blocks))))
    found = spark.createDataFrame([], "query long, query_id long, vec_id long, score long")
    for b in range(blocks):
        block = asked.where(F.col("block") == b).select("vec_id", "v").toArrow()
        ids = np.asarray(block.column("vec_id"))
        sent = spark.sparkContext.broadcast([(d, at, ids[at], v) for d, at, v in by_length(block)])

        def run(batches: Iterator[pa.RecordBatch], sent=sent, first=b << 32) -> Iterator[pa.RecordBatch]:
            searches = {d: (at, Search(own, v, basis.value.get(d, np.zeros((d, 0))), k)) for d, at, own, v in sent.value}
            for batch in rows_together(batches):
                ids, r, length = (np.asarray(batch.column(c)) for c in ("vec_id", "r", "length"))
                for d, at, v in by_length(batch):
                    if d in searches:
                        p = np.asarray(batch.column("p").take(pa.array(at)).flatten()).reshape(len(at), -1)
                        searches[d][1].add(ids[at], v, p, r[at], length[at])
            for at, search in searches.values():
                n = [len(s) for s in search.scores]
                columns = [np.repeat(first + at, n), np.repeat(search.ids, n), *(np.concatenate([np.zeros(0, np.int64), *x]) for x in (search.found, search.scores))]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["query", "query_id", "vec_id", "score"])
            released()

        found = found.unionAll(cut(table.mapInArrow(run, found.schema), "topk-found"))
        sent.destroy()
    basis.destroy()
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def rows_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ROWS."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= ROWS:
            yield pa.concat_batches(held)
            held.clear()
    if held:
        yield pa.concat_batches(held)
