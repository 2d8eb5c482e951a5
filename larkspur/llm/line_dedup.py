"""Fuzzy line deduplication by SimHash.

A line is normalised: lower case, its words with one space between. Equal normalised lines are one. Lines of at least
MIN_WORDS words, whatever their length, get a SimHash of 128 bits over their different words (``simhash.py``). Lines meet where they share
pigeonhole blocks of bits: a block names the bucket that a line is sent to, and in a bucket the other bits are split into
blocks again. Candidates that meet and differ in at most NEAR bits are verified by the edit similarity of their words; of
each connected group of lines the first occurrence, by document id and place, stays.

No step emits all pairs of a group: in a long run of lines with equal blocks each line is first paired with the run's leaders, the first of
its lines that are not near an earlier leader. The entries of lines in near pairs that this leaves out are kept, and once the groups of
the first pairs are known, all pairs of them that lie in different groups are verified too, unless their words' numbers exclude a
similarity; those in one group can join nothing.

Lines shuffle as numbers; entries of many lines go together as one binary value, so that rows cost nothing. A bucket of more than HOT lines
is dealt out as pairs of blocks. Signing a line with built-in expressions takes a row for each word and joining by them a row
for each key, which the check tool's limits do not allow at this recall (README); hence numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm import simhash
from larkspur.llm.arrowtext import parts, released, texts
from larkspur.llm.common import cut, modest, sized, width
from larkspur.llm.components import components
from larkspur.llm.simhash import ENTRY, Plan

MIN_WORDS = simhash.MIN_WORDS
SIMILARITY = 0.8
#: A bucket with more lines is dealt out to several tasks; buckets are counted over one in SAMPLE lines for that, which changes no result.
HOT = 1 << 18
SAMPLE = 64
#: Blocks of a hot bucket, at most: a pair of them has a number of 16 bits.
MOST_BLOCKS = 361
#: Lines whose entries are made at once, and entries in one binary value.
LINES = 1 << 16
BLOB = 1 << 11
#: Pairs with a line of more words are not verified by the built-in distance, whose cost grows with the square of their length.
LONG = 2048
#: Bits of the table by which lines are told that are not to be spelled; more lines than that cost signatures, not results.
ASKED = 1 << 24
#: Classes of words by which pairs of different groups are told apart.
BINS = 64
PAIR = "a struct<h:bigint,s:bigint>, b struct<h:bigint,s:bigint>"
LINE = pa.struct([("h", pa.int64()), ("s", pa.int64())])
#: The rest of an entry whose line is a: its cell, its turned SimHash and the bits of its cell's blocks.
OPEN = "cell bigint, x bigint, y bigint, bits int"


def lowered(column: pa.Array) -> list[bytes]:
    return texts(pc.utf8_lower(column))


def occurrences(rows: DataFrame) -> DataFrame:
    """id, row, at (place of the line, from 0), n (words), h, s and t (the hash and the SimHash) of each line of rows (id, row, text), and n_lines with the first line of a text."""
    modest(rows.sparkSession)
    schema = rows.drop("text").schema.add("at", "integer").add("n", "integer").add("h", "long").add("s", "long").add("t", "long").add("n_lines", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text"):
            got = simhash.lines_of(lowered(batch.column("text")))
            head = got["at"] == 0
            n_lines = np.bincount(got["text"], minlength=batch.num_rows)
            columns = [batch.column(c).take(pa.array(got["text"])) for c in range(2)]
            columns += [pa.array(got["at"].astype(np.int32)), pa.array(got["n"].astype(np.int32)), pa.array(got["h"]), pa.array(got["a"]), pa.array(got["b"])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines[got["text"]], mask=~head)], names=schema.names)

    return rows.select("id", "row", "text").mapInArrow(run, schema)


def spelled(rows: DataFrame, among: np.ndarray) -> DataFrame:
    """h, s and code of each line of rows (text) whose hash has a bit in a table (simhash.has_bit): a character for each word, big-endian in 4 bytes (a hash of 20 bits)."""
    sent = rows.sparkSession.sparkContext.broadcast(among)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text"):
            got = simhash.lines_of(lowered(batch.column("text")), sent.value)
            some = np.flatnonzero((got["n"] >= MIN_WORDS) & simhash.has_bit(sent.value, got["h"].view(np.uint64)))
            first, n = got["first"][some], got["n"][some]
            code = [((got["word_hash"][i : i + k] >> np.uint64(44)) + np.uint64(0x10000)).astype(">u4").tobytes() for i, k in zip(first.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(got["h"][some]), pa.array(got["a"][some]), pa.array(code, pa.binary())], names=["h", "s", "code"])

    return rows.select("text").mapInArrow(run, "h long, s long, code binary")


def bit_table(lines: DataFrame) -> np.ndarray:
    """A table of ASKED bits in which the hashes of lines (h) have theirs (simhash.has_bit)."""
    word = F.shiftright("h", 6).bitwiseAND(F.lit(ASKED // 64 - 1)).alias("word")
    got = lines.groupBy(word).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 AS int)))").alias("bits")).toArrow()
    out = np.zeros(ASKED // 64, np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint64)


def hot_cells(lines: DataFrame, plan: Plan) -> dict[int, int]:
    """The number of blocks of each bucket of more than HOT lines, by a count over one in SAMPLE lines; at most tables / HOT of the lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, a, b in taken(batches):
            cells, n = np.unique(np.concatenate([e["cell"] for e in simhash.entries(h, a, b, plan)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells.view(np.int64)), pa.array(n)], names=["cell", "n"])

    some = lines.where(F.pmod("h", F.lit(SAMPLE)) == 0).mapInArrow(run, "cell long, n long").groupBy("cell").agg((F.sum("n") * SAMPLE).alias("n"))
    return {r.cell: min(MOST_BLOCKS, -(-r.n // HOT)) for r in some.where(F.col("n") > HOT).collect()}


def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """h, s and t of about LINES lines at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= LINES:
            yield columns_of(held)
    if sum(x.num_rows for x in held):
        yield columns_of(held)


def columns_of(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, s, t = (np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("h", "s", "t"))
    held.clear()
    return h, s.view(np.uint64), t.view(np.uint64)


def spread(e: np.ndarray, hot: dict[int, int]) -> np.ndarray:
    """The entries of one table, those of hot buckets once for each pair of blocks that they belong to."""
    out = [e]
    for cell, blocks in hot.items():
        at = e["cell"] == np.uint64(cell)
        if at.any():
            own = e[at]
            out[0], e = (rest := e[~at]), rest
            block = own["h"].view(np.uint64) % np.uint64(blocks)
            for number, (x, y) in enumerate(combinations_with_replacement(range(blocks), 2)):
                part = own[(block == np.uint64(x)) | (block == np.uint64(y))]
                part["cell"] |= np.uint64(number << 48)
                out.append(part)
    return np.concatenate(out) if len(out) > 1 else e


def dealt(lines: DataFrame, plan: Plan, hot: dict[int, int], n_parts: int) -> DataFrame:
    """part and entries: the entries of all lines, BLOB to a value; each bucket (or pair of blocks of one) is in one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, a, b in taken(batches):
            every = np.concatenate([spread(e, hot) for e in simhash.entries(h, a, b, plan)])
            part = (simhash.mixed(every["cell"]) % np.uint64(n_parts)).astype(np.uint16 if n_parts <= 1 << 16 else np.int32)
            order = np.argsort(part, kind="stable")  # of numbers of 16 bits by counting
            every, part = every[order], part[order].astype(np.int32)
            cuts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
            cuts = np.unique(np.concatenate([cuts, *[np.arange(low, high, BLOB) for low, high in zip(cuts, cuts[1:], strict=False) if high - low > BLOB]]))
            blobs = [every[low:high].tobytes() for low, high in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]]), pa.array(blobs, pa.binary())], names=["part", "entries"])
            released()

    return lines.select("h", "s", "t").mapInArrow(run, "part int, entries binary")


def named(h: np.ndarray, s: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(h), pa.array(s)], fields=list(LINE))


def candidates(lines: DataFrame) -> DataFrame:
    """a, b: pairs of lines (h, s, t) that meet and differ in at most NEAR bits, which may come again; and with b null the entries among which the others are (across_groups)."""
    plan = Plan.of(lines.count())
    hot, n_parts = hot_cells(lines, plan), 8 * width(lines.sparkSession)
    schema = f"{PAIR}, {OPEN}"
    names = ["a", "b", "cell", "x", "y", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = [], None

        def met() -> Iterator[pa.RecordBatch]:
            e = np.frombuffer(b"".join(held), ENTRY)
            held.clear()
            pairs, at, bits = simhash.part_search(e, plan)
            s = simhash.unturned(e, plan)
            i, j = pairs.T
            none = [pa.nulls(len(i), kind) for kind in (pa.int64(), pa.int64(), pa.int64(), pa.int32())]
            yield pa.RecordBatch.from_arrays([named(e["h"][i], s[i]), named(e["h"][j], s[j]), *none], names=names)
            rest = [pa.array(e[c][at].view(np.int64)) for c in ("cell", "a", "b")]
            yield pa.RecordBatch.from_arrays([named(e["h"][at], s[at]), pa.nulls(len(at), LINE), *rest, pa.array(bits.astype(np.int32))], names=names)

        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("entries").to_pylist(), strict=True):
                if part != of and held:
                    yield from met()
                    released()
                of = part
                held.append(blob)
        if held:
            yield from met()

    together = dealt(lines, plan, hot, n_parts).repartition(width(lines.sparkSession), "part").sortWithinPartitions("part")
    return together.mapInArrow(run, schema)


def across_groups(entries: DataFrame, known: DataFrame, lines: int) -> DataFrame:
    """a, b: all pairs of lines of these entries (a, cell, x, y, bits) that meet, differ in at most NEAR bits, are not in one group and may be similar by the words that they hold; known has line, component and code of each line."""
    plan = Plan.of(lines)
    n = F.octet_length("code") / 4
    short = known.select(F.col("line").alias("a"), "component", n.cast("int").alias("n"), F.when(n <= LONG, F.col("code")).alias("code"))
    flat = entries.join(sized(short), "a").select("cell", "x", "y", "bits", "n", "code", *[F.col(f"{c}.{k}").alias(f"{c}_{k}") for c in ("a", "component") for k in ("h", "s")])

    def found(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = lambda c: np.concatenate([x.column(c).to_numpy() for x in held])
        e = np.empty(sum(x.num_rows for x in held), ENTRY)
        for to, c in (("cell", "cell"), ("h", "a_h"), ("a", "x"), ("b", "y")):
            e[to] = column(c).view(e[to].dtype)
        group = np.stack([column("component_h"), column("component_s")], 1)
        _, label = np.unique(group, axis=0, return_inverse=True)
        s, n, bits = column("a_s"), column("n"), column("bits").astype(np.int64)
        held_words = bags([code for x in held for code in x.column("code").to_pylist()])
        held.clear()
        for pairs in simhash.pairs_across(e, bits, label.reshape(-1), plan):
            for low in range(0, len(pairs), LINES):
                i, j = pairs[low : low + LINES].T
                may = may_be_similar(n[i], n[j], held_words[i], held_words[j])
                i, j = i[may], j[may]
                yield pa.RecordBatch.from_arrays([named(e["h"][i], s[i]), named(e["h"][j], s[j])], names=["a", "b"])
        released()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole cells, about LINES entries of them at once."""
        held, n, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column("cell").to_numpy()
            if n >= LINES and cells[-1] != last:
                ends = int(np.argmax(cells != last))
                held.append(batch.slice(0, ends))
                yield from found(held)
                batch, n = batch.slice(ends), 0
            held.append(batch)
            n, last = n + batch.num_rows, cells[-1]
        if held:
            yield from found(held)

    return flat.repartition(width(entries.sparkSession), "cell").sortWithinPartitions("cell").mapInArrow(run, PAIR).distinct()


def bags(codes: list[bytes | None]) -> np.ndarray:
    """For each code the number of its words of each of BINS classes; without a code -1."""
    n = np.fromiter((len(c or b"") // 4 for c in codes), np.int64, len(codes))
    out = np.zeros((len(codes), BINS), np.int16)
    np.add.at(out, (np.repeat(np.arange(len(codes)), n), np.frombuffer(b"".join(c or b"" for c in codes), ">u4") % BINS), 1)
    out[[c is None for c in codes]] = -1
    return out


def may_be_similar(n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of pairs of lines of n and m words with bags x and y those that can have so many words in common that their edit similarity is SIMILARITY."""
    longer = np.maximum(n, m)
    allowed = np.floor(longer * (1 - SIMILARITY) + 1e-9)
    common = np.minimum(x, y).sum(1, dtype=np.int64)
    return (np.abs(n - m) <= allowed) & ((longer - common <= allowed) | (common < 0))


def spellings(named: DataFrame, lines: DataFrame, rows: DataFrame) -> DataFrame:
    """line and code (spelled) of the lines named (line). Lines are read where they occur first."""
    wanted = cut(named.distinct().select("line.h", "line.s"), "line-named")
    wanted = cut(lines.select("h", "s", "first.id").join(sized(wanted), ["h", "s"]), "line-wanted")
    there = rows.join(sized(wanted.select(F.col("id").alias("asked")).distinct()), F.col("id").eqNullSafe(F.col("asked")), "left_semi")
    found = spelled(there, bit_table(wanted)).join(sized(wanted.select("h", "s")), ["h", "s"], "left_semi")
    return cut(found.groupBy(line().alias("line")).agg(F.first("code").alias("code")), "line-codes")


def verify(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of lines those whose words (found: line, code) have an edit similarity of SIMILARITY or more: 1 - distance / words of the longer one."""
    both = pairs.join(found.select(F.col("line").alias("a"), F.col("code").alias("x")), "a").join(found.select(F.col("line").alias("b"), F.col("code").alias("y")), "b")
    words = lambda c: (F.octet_length(c) / 4).cast("int")
    both = both.withColumn("allowed", F.floor(F.greatest(words("x"), words("y")) * (1 - SIMILARITY) + 1e-9).cast("int")).where(F.abs(words("x") - words("y")) <= F.col("allowed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """near, or null where the built-in distance is to tell."""
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = ([np.frombuffer(v, ">u4") for v in batch.column(c).to_pylist()] for c in ("x", "y"))
            most = np.asarray(batch.column("allowed"))
            near: list[bool | None] = [True if sure else None for sure in simhash.surely_within(x, y, most)]
            for i, known in enumerate(near):
                if known is None and max(len(x[i]), len(y[i])) > LONG:
                    near[i] = simhash.within(x[i], y[i], int(most[i]))
            told = pa.array([known is not None for known in near])
            rest = [pc.if_else(told, pa.scalar(None, pa.binary()), batch.column(c)) for c in ("x", "y")]
            yield pa.RecordBatch.from_arrays([*batch.select(["a", "b"]).columns, *rest, batch.column("allowed"), pa.array(near, pa.bool_())], names=["a", "b", "x", "y", "allowed", "near"])

    tried = both.select("a", "b", "x", "y", "allowed").mapInArrow(run, f"{PAIR}, x binary, y binary, allowed int, near boolean")
    distance = F.expr("levenshtein(decode(x, 'UTF-32'), decode(y, 'UTF-32'), allowed) >= 0")
    return tried.where(F.coalesce("near", distance)).select("a", "b")


def line() -> Column:
    return F.struct("h", "s")


def similar_groups(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """node and component of the lines (h, s, n, t, first) that are similar to another."""
    signed = lines.where(F.col("n") >= MIN_WORDS).select("h", "s", "t")
    seen = cut(candidates(signed), "line-met")
    met, rest = cut(seen.where("b IS NOT NULL").select("a", "b").distinct(), "line-pairs"), cut(seen.where("b IS NULL").drop("b"), "line-open")
    codes = spellings(met.select(F.explode(F.array("a", "b")).alias("line")).unionByName(rest.select(F.col("a").alias("line"))), lines, rows)
    members = cut(components(cut(verify(met, codes), "line-links")), "line-members")
    wanted = sized(cut(rest.select(F.col("a").alias("line")).distinct(), "line-wanted"))
    groups = members.withColumnRenamed("node", "line").join(wanted, "line").withColumn("grouped", F.lit(True))
    known = codes.join(wanted, "line").join(groups, "line", "left")
    known = cut(known.select("line", "code", F.coalesce("component", "line").alias("component"), F.coalesce("grouped", F.lit(False)).alias("grouped")), "line-known")
    links = cut(verify(cut(across_groups(rest, known, signed.count()), "line-pairs"), known.select("line", "code")), "line-links")
    if links.isEmpty():
        return members
    of = lambda c: known.select(F.col("line").alias(c), F.col("component").alias(f"of_{c}"))
    larger = cut(components(links.join(of("a"), "a").join(of("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))).withColumnRenamed("component", "larger"), "line-larger")
    alone = known.where("NOT grouped").select(F.col("line").alias("node")).join(larger.select("node"), "node", "left_semi").withColumn("component", F.col("node"))
    every = members.unionByName(alone).join(sized(larger.withColumnRenamed("node", "component")), "component", "left")
    return every.select("node", F.coalesce("larger", "component").alias("component"))


def line_groups(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The occurrences of all lines of rows (id, row, text), and (h, s, keep) for each line that occurs twice or is similar to another: keep (id, row, at) is the first occurrence of its group."""
    seen = cut(occurrences(rows), "lines")
    distinct = seen.where("n > 0").groupBy("h", "s").agg(F.min(F.struct("id", "row", "at")).alias("first"), F.count("*").alias("times"), F.first("n").alias("n"), F.first("t").alias("t"))
    lines = cut(distinct, "line-distinct")
    mine = cut(similar_groups(lines, rows).select("node.h", "node.s", "component"), "line-members")
    grouped = lines.join(sized(mine), ["h", "s"], "left").where("times > 1 OR component IS NOT NULL").withColumn("component", F.coalesce("component", line()))
    grouped = cut(grouped.select("h", "s", "first", "component"), "line-grouped")
    keep = cut(grouped.groupBy("component").agg(F.min("first").alias("keep")), "line-keep")
    return seen, cut(grouped.join(keep, "component").select("h", "s", "keep"), "line-groups")


def dropped_lines(seen: DataFrame, groups: DataFrame) -> DataFrame:
    """id, row and at of each line that goes; blank lines are in no group."""
    return seen.join(sized(groups), ["h", "s"]).where(F.struct("id", "row", "at") != F.col("keep")).select("id", "row", "at")


def line_report(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, n_lines, n_dropped and dropped (the places of the lines that go, from 0, in order) of each row of df.

    A null or empty text has one blank line; blank lines always stay. Of repeated rows all lines but those of one go. A null id comes before all others.
    Lines under MIN_WORDS words go only where an equal line stays. Lines and texts of any length are read whole; an empty df gives an empty result.
    Other columns of df, whatever their names, are not read.
    """
    seen, groups = line_groups(df.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text")))
    gone = dropped_lines(seen, groups).groupBy("row").agg(F.array_sort(F.collect_list("at")).alias("dropped"))
    out = seen.where("at = 0").select("row", "id", "n_lines").join(gone, "row", "left")
    return out.select(F.col("id").alias(id_col), "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def dedup_lines(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """df with the lines that go left out of its text; a text all of whose lines go is empty, a null stays null. Columns of any name are kept; rows are numbered once, in a written table."""
    numbered = cut(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"), F.monotonically_increasing_id().alias("row")), "line-rows")
    text = F.col("doc").getField(text_col)
    seen, groups = line_groups(numbered.select(F.col("doc").getField(id_col).alias("id"), "row", text.alias("text")))
    gone = dropped_lines(seen, groups).groupBy("row").agg(F.collect_set("at").alias("gone"))
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains("gone", i)), "\n")
    rows = numbered.join(gone, "row", "left").withColumn("text", F.when(F.col("gone").isNull(), text).otherwise(kept))
    return rows.select(*[F.col("text").alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in df.columns])
