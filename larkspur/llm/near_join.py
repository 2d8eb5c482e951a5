"""N-gram Jaccard self-join by chosen paths.

Documents are sets of hashed shingles of SHINGLE words. Documents with the same set are one class; the join is of classes.
Each set is embedded as MINHASHES minimum hashes. A run starts with all sets in one node; a node chooses one or, in a quarter of
the cases, two coordinates by a hash of its path, and each set goes on to the child named by its value there: the
sampled token that it shares with the others in the child. Two sets of Jaccard similarity s go on together with probability s for
each coordinate. Nodes of at most LEAF sets are compared by brute force; larger ones are split again,
up to DEPTH times, and what is still larger then is compared in pairs of blocks of BLOCK sets, by as many tasks. Runs are
repeated until a pair at the threshold meets in a leaf with probability RECALL.

In a leaf, pairs whose minimum hashes agree too rarely are left out (a pair at the threshold has a chance of under 10^-4 to be one),
and the exact Jaccard similarity of the others decides. A pair that meets in several leaves counts in the least of
them, so that no task and no shuffle ever holds the pairs: leaves give the number of links of each class and edges to a
local root, and connected components of these are the groups.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructType

from larkspur.llm.arrowtext import parts, released, texts
from larkspur.llm.common import cut, modest, sized
from larkspur.llm.components import components
from larkspur.llm.shingles import minhashes, set_key, shingle_sets

SHINGLE = 5
THRESHOLD = 0.8
MINHASHES = 64
RECALL = 0.999
DEPTH = 4
LEAF = 256
BLOCK = 512
#: Rows that a Python worker takes from a batch at a time.
ROWS = 512
#: Sets that are verified together hold about so many bytes; a leaf's candidates with more are dealt out again, as pairs of parts.
VERIFY_BYTES = 32 << 20


def runs_for(recall: float, threshold: float, depth: int) -> int:
    """So many runs make a pair at the threshold meet at depth with probability recall: a node keeps it with threshold, or in a quarter of the cases 1 - (1 - threshold)^2."""
    keeps = 0.75 * threshold + 0.25 * (1 - (1 - threshold) ** 2)
    return math.ceil(math.log(1 - recall) / math.log(1 - keeps**depth))


def children(node: Column, sig: Column, n: int) -> Column:
    """The children of a node that a set goes on to."""
    chosen = lambda k: F.pmod(F.xxhash64(node, F.lit(k)), F.lit(n)).cast("int")
    child = lambda k: F.xxhash64(node, chosen(k), F.element_at(sig, chosen(k) + 1))
    return F.when(F.pmod(F.xxhash64(node, F.lit(7)), F.lit(4)) == 0, F.array_distinct(F.array(child(0), child(1)))).otherwise(F.array(child(0)))


def signed(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """id, text_hash, key (the name of the set), n (its size) and sig of each row; n is 0 for a text without words."""
    modest(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"), F.col(f"`{text_col}`").alias("__text"))
    schema = rows.drop("__text").schema.add("key", BinaryType()).add("n", LongType()).add("sig", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "__text"):
            sets = shingle_sets(texts(batch.column("__text")), SHINGLE)
            sig = minhashes(sets, MINHASHES).view(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, MINHASHES, dtype=np.int32)), pa.array(sig.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(set_key, sets), pa.binary()), pa.array(map(len, sets), pa.int64()), lists], names=schema.names)

    return rows.mapInArrow(run, schema)


def leaves(sets: DataFrame, runs: int) -> DataFrame:
    """node, key, members: the leaves with two sets or more that each set comes to."""
    roots = F.flatten(F.array(*[children(F.xxhash64(F.lit(r), F.lit("run")), F.col("sig"), MINHASHES) for r in range(runs)]))
    front = sets.select(F.explode(F.array_distinct(roots)).alias("node"), "key")
    found = None
    for depth in range(1, DEPTH + 1):
        counts = front.groupBy("node").agg(F.count("*").alias("members")).where("members > 1")
        met = cut(front.join(counts, "node"), "paths")
        done = met if depth == DEPTH else met.where(F.col("members") <= LEAF)
        found = done if found is None else found.unionByName(done)
        large = met.where(F.col("members") > LEAF)
        if depth == DEPTH or large.isEmpty():
            break
        front = cut(large.join(sets.select("key", "sig"), "key").select(F.explode(children(F.col("node"), F.col("sig"), MINHASHES)).alias("node"), "key"), "paths")
    return found


def dealt(found: DataFrame, sets: DataFrame) -> DataFrame:
    """found with sig, n, copies and the leaves of each set, once for each pair of blocks (x <= y) of its leaf that it belongs to."""
    own = found.groupBy("key").agg(F.array_sort(F.collect_set("node")).alias("leaves"))
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    rows = found.join(own.join(sets, "key"), "key").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    other = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, F.col("block")).alias("x"), F.greatest(b, F.col("block")).alias("y")))
    return rows.withColumn("pair", F.explode(other)).select("node", "pair.x", "pair.y", "block", "key", "n", "copies", "sig", "leaves")


def dealt_again(marked: DataFrame) -> DataFrame:
    """marked with part, u and v: the candidates of each (node, x, y), split into parts where their sets hold more than VERIFY_BYTES, once for each pair of parts (u <= v)."""
    held = cut(marked.groupBy("node", "x", "y").agg(F.ceil(F.sum("n") * 8 / VERIFY_BYTES).cast("int").alias("parts")), "near-parts")
    rows = marked.join(held, ["node", "x", "y"]).withColumn("part", F.pmod(F.xxhash64("key", F.lit(5)), F.col("parts")).cast("int"))
    other = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(p, F.col("part")).alias("u"), F.greatest(p, F.col("part")).alias("v")))
    return rows.withColumn("both", F.explode(other)).select(*marked.columns, "part", "both.u", "both.v")


def grouped(batches: Iterator[pa.RecordBatch], place: list[str], work: Callable[[pd.DataFrame], pd.DataFrame | None]) -> Iterator[pd.DataFrame]:
    """work on the rows of each place; these stand together, and a group may go on in the next batch."""
    held: list[pd.DataFrame] = []
    out: list[pd.DataFrame] = []

    def close() -> None:
        if held:
            group = pd.concat(held) if len(held) > 1 else held[0]
            held.clear()
            if len(group) > 1 and (got := work(group)) is not None:
                out.append(got)

    for pdf in (batch.slice(low, ROWS).to_pandas() for batch in batches for low in range(0, batch.num_rows, ROWS)):
        names = pdf[place].to_numpy()
        cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1), len(pdf)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            part = pdf.iloc[low:high]
            if held and tuple(held[-1][place].iloc[-1]) != tuple(names[low]):
                close()
            held.append(part)
        if out:
            yield pd.concat(out)
            out.clear()
        released()
    close()
    if out:
        yield pd.concat(out)


def comparable(group: pd.DataFrame, least: float) -> np.ndarray:
    """Which pairs (row < column) of a group are to be compared here: of the blocks x and y (and the parts u and v), with similar minimum hashes."""
    sig = np.stack(group.sig.to_numpy())
    same = np.zeros((len(sig), len(sig)), np.uint8)
    for k in range(sig.shape[1]):
        same += sig[:, k, None] == sig[None, :, k]
    ok = np.triu(same >= least * sig.shape[1], 1)
    if group.x.iat[0] != group.y.iat[0]:
        ok &= group.block.to_numpy()[:, None] != group.block.to_numpy()[None, :]
    if "u" in group and group.u.iat[0] != group.v.iat[0]:
        ok &= group.part.to_numpy()[:, None] != group.part.to_numpy()[None, :]
    return ok


def here_first(group: pd.DataFrame, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the least common leaf of the pairs is this one."""
    node, sets = group.node.iat[0], [frozenset(x) for x in group.leaves]
    return np.fromiter((min(sets[a] & sets[b]) == node for a, b in zip(i, j, strict=True)), bool, len(i))


def candidates(group: pd.DataFrame, least: float) -> pd.DataFrame | None:
    """The rows of a group that have a pair to be verified here."""
    i, j = np.nonzero(comparable(group, least))
    if len(i):
        first = here_first(group, i, j)
        i, j = i[first], j[first]
    if not len(i):
        return None
    return group.iloc[np.unique(np.concatenate([i, j]))]


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of sets of distinct numbers."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(counts > 1)
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    ids = place[ids]
    owner, ids = owner[ids >= 0], ids[ids >= 0]
    order = np.argsort(ids, kind="stable")
    owner, ids = owner[order], ids[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, len(shared), 4096):
        a, b = np.searchsorted(ids, [low, low + 4096])
        dense = np.zeros((len(sets), min(4096, len(shared) - low)), np.float32)
        dense[owner[a:b], ids[a:b] - low] = 1
        out += dense @ dense.T
    return out


def verified(group: pd.DataFrame, threshold: float, least: float) -> pd.DataFrame | None:
    """key, links (documents linked here) and root (a key of its component here) of each row with a link."""
    group = group.drop_duplicates("key")
    if len(group) < 2:
        return None
    sizes = group.n.to_numpy(float)
    common = intersections([np.asarray(s).view(np.uint64) for s in group.shingles])
    ok = comparable(group, least) & (common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-6)
    i, j = np.nonzero(ok)
    if not len(i):
        return None
    first = here_first(group, i, j)
    i, j = i[first], j[first]
    if not len(i):
        return None
    copies = group.copies.to_numpy(np.int64)
    links = np.bincount(i, copies[j], len(group)) + np.bincount(j, copies[i], len(group))
    root = np.arange(len(group))
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            break
        root = new
    at = np.unique(np.concatenate([i, j]))
    return pd.DataFrame({"key": group.key.to_numpy()[at], "links": links[at].astype(np.int64), "root": group.key.to_numpy()[root[at]]})


def classed(df: DataFrame, text_col: str, id_col: str, threshold: float, recall: float) -> DataFrame:
    """id, text_hash, class_id, first (id and text_hash of the document that stands for the group) and n_links of each row of df."""
    least = threshold - 4 * math.sqrt(threshold * (1 - threshold) / MINHASHES)
    rows = cut(signed(df, text_col, id_col), "near-signed")
    name = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")
    sets = rows.where("n > 0").groupBy("key").agg(F.min(name).alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    sets = cut(sets.withColumn("id", F.col("first.id")), "near-sets")
    met = dealt(leaves(sets, runs_for(recall, threshold, DEPTH)), sets.drop("id", "first"))
    place = ["node", "x", "y"]
    schema = met.schema
    together = lambda d, place: d.repartition(*place).sortWithinPartitions(*place)
    marked = cut(together(met, place).mapInArrow(lambda it: as_batches(grouped(it, place, lambda g: candidates(g, least)), schema), schema), "near-candidates")
    wanted = cut(marked.select("key").distinct().join(sets.select("key", "id"), "key"), "near-wanted")
    asked = wanted.select(F.col("id").alias("asked")).distinct()
    texts_of = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(sized(asked), F.col("id").eqNullSafe(F.col("asked")), "left_semi")
    filled = dealt_again(marked).join(shingled(texts_of).join(sized(wanted.select("key")), "key", "left_semi"), "key")
    out, parts_of = "key binary, links long, root binary", [*place, "u", "v"]
    linked = cut(together(filled, parts_of).mapInArrow(lambda it: as_batches(grouped(it, parts_of, lambda g: verified(g, threshold, least)), None), out), "near-linked")
    links = linked.groupBy("key").agg(F.sum("links").alias("links"))
    group = cut(components(linked.select(F.col("key").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "key"), "near-groups")
    leading = cut(group.join(sets.select("key", "first"), "key").groupBy("component").agg(F.min("first").alias("leads")), "near-leading")
    led = cut(group.join(leading, "component").select("key", "leads"), "near-led")
    each = sets.select("key", "first", "copies").join(links, "key", "left").join(led, "key", "left")
    each = cut(each.select("key", F.coalesce("leads", "first").alias("first"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "near-classes")
    some = rows.where("n > 0").select("id", "text_hash", "key").join(each, "key").select("id", "text_hash", F.col("first.id").alias("class_id"), "first", "n_links")
    none = rows.where("n = 0").select("id", "text_hash", F.col("id").alias("class_id"), name.alias("first"), F.lit(0).cast("long").alias("n_links"))
    return some.unionByName(none)


def similar_classes(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """id, class_id (the least id of its group) and n_links (other documents of similarity threshold or more, copies among them) of each row of df.

    Groups are the connected components of the links. A null or blank text has no shingles and is alone, as class of its own id; texts
    with equal sets of shingles are linked. Of repeated rows each counts as a document. A null id is in a group as any other; the class
    of a group without an id is null. Texts of any length are compared whole. Other columns of df, whatever their names, are not read; an empty df gives an empty result.
    """
    return classed(df, text_col, id_col, threshold, recall).select(F.col("id").alias(id_col), "class_id", "n_links")


def shingled(df: DataFrame) -> DataFrame:
    """key and shingles of each text of df that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text"):
            sets = [s for s in shingle_sets(texts(batch.column("text")), SHINGLE) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array(map(set_key, sets), pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["key", "shingles"])

    return df.select("text").mapInArrow(run, StructType().add("key", BinaryType()).add("shingles", ArrayType(LongType())))


def as_batches(frames: Iterator[pd.DataFrame], schema: StructType | None) -> Iterator[pa.RecordBatch]:
    for pdf in frames:
        if schema is None:
            yield pa.RecordBatch.from_arrays([pa.array(pdf.key, pa.binary()), pa.array(pdf.links, pa.int64()), pa.array(pdf.root, pa.binary())], names=["key", "links", "root"])
        else:
            kinds = {"node": pa.int64(), "x": pa.int32(), "y": pa.int32(), "block": pa.int32(), "key": pa.binary(), "n": pa.int64(), "copies": pa.int64(), "sig": pa.list_(pa.int32()), "leaves": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_arrays([pa.array(list(pdf[f.name]), kinds[f.name]) for f in schema], names=schema.names)


def one_of_each(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """df without the documents whose group has one with a smaller id (a null id is the largest; of different texts with one id, that with the least hash stays).

    A document is told by its id and its text: texts that share an id with one that goes stay, and repeated rows (one id, one text) stay or go together.
    """
    found = classed(df, text_col, id_col, threshold, recall)
    gone = found.where(~(F.col("id").eqNullSafe(F.col("first.id")) & F.col("text_hash").eqNullSafe(F.col("first.text_hash"))))
    gone = cut(gone.select(F.struct("id", "text_hash").alias("gone")).distinct(), "near-gone")
    own = F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"), own.alias("own")).join(sized(gone), F.col("own") == F.col("gone"), "left_anti")
    return rows.select(*[F.col("doc").getField(c).alias(c) for c in df.columns])
