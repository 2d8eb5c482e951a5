"""Exact deduplication by two-pass Bloom filtering, in DataFrame operations only.

Pass 1 sets ``HASHES`` cells of a bit table for each text and keeps the cells that were set
more than once. Pass 2 looks each row up: a row with a cell that was set once is unique
and passes straight through; only the others are written and shuffle, by the digest of their text.

A false positive only sends a unique row through the shuffle; it cannot change a result. The bit table has about CELLS_PER_ROW cells a
row, at most MAX_CELLS, so that what is broadcast, a word of 64 cells for each that holds a repeated one, is bounded: beyond MAX_CELLS / 4 texts
more and more unique rows take the shuffle, which stays right. The first pass reads the texts once and writes 8 bytes a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import cut

HASHES = 2
CELLS_PER_ROW = 16
LEAST_CELLS, MAX_CELLS = 1 << 20, 1 << 28
OUT = ("keep_id", "group_size", "kept", "text_sha256")


def cells_for(rows: int) -> int:
    """A power of two."""
    return min(MAX_CELLS, max(LEAST_CELLS, 1 << (CELLS_PER_ROW * rows - 1).bit_length())) if rows else LEAST_CELLS


def cell(i: int, cells: int) -> Column:
    """The cell of a text for one of the hashes, by h, the hash of its digest."""
    return F.pmod(F.xxhash64("h", F.lit(i)), F.lit(cells))


def repeated_cells(keys: DataFrame, cells: int) -> DataFrame:
    """word, bits: the cells that more than one row of keys (h) has set, 64 to a word; at most cells / 64 rows."""
    per_cell = keys.select(F.explode(F.array(*[cell(i, cells) for i in range(HASHES)])).alias("cell")).groupBy("cell").count()
    twice = per_cell.where("count > 1").selectExpr("cell div 64 AS word", "shiftleft(1L, CAST(cell % 64 AS INT)) AS bit")
    return twice.groupBy("word").agg(F.bit_or("bit").alias("bits"))


def exact_dedup(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", cells: int | None = None, keep: tuple | None = None) -> DataFrame:
    """The columns of df (or only those of keep) with keep_id, group_size, kept and text_sha256; one row per row of df.

    Texts, of any length, are equal when identical; a null text counts as the empty one. Of equal texts the row with
    the largest id stays (a null id is the smallest); of repeated rows with that id one stays: rows that may repeat are numbered in a written table.
    Columns of df that have the names of results are replaced, others kept whatever their names. An empty df gives an empty result.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in OUT]
    digest = F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"), 256)
    rows = df.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in kept]).alias("doc"), F.col(f"`{id_col}`").alias("id"), digest.alias("sha")).withColumn("h", F.xxhash64("sha"))
    keys = cut(rows.select("h"), "dedup-hashes")
    cells = cells or cells_for(keys.count())
    words = F.broadcast(cut(repeated_cells(keys, cells), "dedup-cells"))
    seen, hits = rows, []
    for i in range(HASHES):
        seen = seen.withColumn(f"cell{i}", cell(i, cells)).join(words.select(F.col("word").alias(f"word{i}"), F.col("bits").alias(f"bits{i}")), F.expr(f"cell{i} div 64") == F.col(f"word{i}"), "left")
        hits.append(f"coalesce(shiftrightunsigned(bits{i}, CAST(cell{i} % 64 AS INT)) & 1L, 0L) = 1L")
    seen = seen.select("doc", "id", "sha", F.expr(" AND ".join(hits)).alias("maybe"))
    maybe = cut(seen.where("maybe").select("doc", "id", "sha", F.monotonically_increasing_id().alias("row")), "dedup-maybe")
    best = cut(maybe.groupBy("sha").agg(F.max(F.struct("id", "row")).alias("best"), F.count("*").alias("group_size")), "dedup-groups")
    grouped = maybe.join(best, "sha").select("doc", F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.col("sha").alias("text_sha256"))
    alone = seen.where("NOT maybe").select("doc", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    return alone.unionByName(grouped).select(*[F.col("doc").getField(c).alias(c) for c in kept], *OUT)
