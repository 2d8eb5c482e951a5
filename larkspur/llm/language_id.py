"""Language identification by prediction by partial matching (PPM).

For each language a context tree over bytes, ORDER bytes deep, is counted on a bounded sample of labelled documents and then
frozen. A byte's code length under a language is that of PPM with escape method C and no exclusion: at
the longest context, -log2(c / (n + d)) if it has been seen there, else the escape -log2(d / (n + d)) and on with the
context one byte shorter, down to 8 bits for a byte that the language has never had. A text's language is the one that
codes it shortest; the score is that language's posterior probability under equal priors.

The trees of all languages share one trie over the union of their n-grams, held as transition tables, so that a
batch of texts is coded by table lookups on whole arrays. Code lengths are integers in units of 2^-16 bit: sums are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.arrowtext import joined, parts, texts
from larkspur.llm.common import carried, crc_mod, modest, shipped

ORDER = 3
PAD = b"\n" * ORDER
UNIT = 1 << 16
#: At most so many documents of a language are learned from: of each of SHARES parts of its ids the same number, those with the smallest hashes (and ties).
SAMPLE_PER_LANGUAGE = 2000
SHARES = 4
WINDOW = 1 << 19


def grams(buf: np.ndarray, n: int) -> np.ndarray:
    """For each position the n bytes that end there, the last one lowest; bytes before the start are missing (0)."""
    out = np.zeros(len(buf), np.uint32)
    for j in range(n):
        out[j:] |= buf[: len(buf) - j].astype(np.uint32) << np.uint32(8 * j)
    return out


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, "text"):
        langs = np.array(batch.column("lang").to_pylist(), object)
        items = texts(batch.column("text"))
        for lang in sorted(set(langs)):
            buf, starts, ends = joined([t for t, x in zip(items, langs, strict=True) if x == lang], PAD)
            inside = np.zeros(len(buf) + 1, np.int8)
            np.add.at(inside, starts, 1)
            np.add.at(inside, ends, -1)
            at = np.flatnonzero(np.cumsum(inside[:-1]))
            for n in range(1, ORDER + 2):
                keys, counts = np.unique(grams(buf, n)[at], return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(keys), "n": pa.array(np.full(len(keys), n, np.int32)), "gram": pa.array(keys.astype(np.int64)), "seen": pa.array(counts.astype(np.int64))})


class Model:
    """Frozen trees. langs: sorted; seen: for each n from 1 on, the grams and their counts by language."""

    def __init__(self, langs: list[str], seen: list[tuple[np.ndarray, np.ndarray]]):
        self.langs = langs
        grams_of = [g for g, _ in seen]
        for n in range(ORDER, 0, -1):  # close under prefixes and suffixes
            longer = grams_of[n]
            grams_of[n - 1] = np.unique(np.concatenate([grams_of[n - 1], longer >> 8, longer & ((1 << 8 * n) - 1)]))
        counts = []
        for (g, c), full in zip(seen, grams_of, strict=True):
            here = np.zeros((len(full), len(langs)))
            here[np.searchsorted(full, g)] = c
            counts.append(here)
        bits = lambda x: np.rint(-np.log2(x) * UNIT).astype(np.int32)
        total, kinds = counts[0].sum(0), (counts[0] > 0).sum(0)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.new = bits(kinds / (total + kinds)) + 8 * UNIT
            costs = [np.where(counts[0] > 0, bits(np.maximum(counts[0], 1) / (total + kinds)), self.new)]
        self.first = np.zeros(256, np.int32)
        self.first[grams_of[0]] = np.arange(1, len(grams_of[0]) + 1)
        self.next, self.escape = [], []
        for n in range(2, ORDER + 2):
            g, c = grams_of[n - 1], counts[n - 1]
            parent, suffix = np.searchsorted(grams_of[n - 2], g >> 8), np.searchsorted(grams_of[n - 2], g & ((1 << 8 * (n - 1)) - 1))
            total, kinds = np.zeros((len(grams_of[n - 2]), len(langs))), np.zeros((len(grams_of[n - 2]), len(langs)))
            np.add.at(total, parent, c)
            np.add.at(kinds, parent, c > 0)
            escape = np.where(total > 0, bits(np.maximum(kinds, 1) / np.maximum(total + kinds, 1)), 0)
            costs.append(np.where(c > 0, bits(np.maximum(c, 1) / np.maximum(total + kinds, 1)[parent]), escape[parent] + costs[-1][suffix]))
            step = np.zeros((len(grams_of[n - 2]) + 1, 256), np.int32)
            step[parent + 1, g & 255] = np.arange(1, len(g) + 1)
            self.next.append(step.ravel())
            self.escape.append(np.vstack([np.zeros(len(langs), np.int64), escape]).astype(np.int32))
        self.cost = [np.vstack([np.zeros(len(langs), np.int64), c]).astype(np.int32) for c in costs]

    def lengths(self, buf: np.ndarray) -> np.ndarray:
        """Code length of each byte of buf by language; the first ORDER bytes are context only."""
        ids = [self.first[buf]]
        for step in self.next:
            last = np.zeros(len(buf), np.int32)
            last[1:] = ids[-1][:-1]
            ids.append(step[(last.astype(np.int64) << 8) | buf])
        out = self.cost[-1].take(ids[-1], axis=0)
        at = np.flatnonzero(ids[-1] == 0)
        for n in range(ORDER, 0, -1):  # here the context of n bytes hasn't had this byte in any language
            if not len(at):
                break
            before = np.where(at > 0, ids[n - 1][at - 1], 0)
            known = ids[n - 1][at]
            out[at] += self.escape[n - 1].take(before, axis=0) + self.cost[n - 1].take(known, axis=0)
            at = at[known == 0]
        out[at] += self.new
        return out[ORDER:]

    def totals(self, items: list[bytes]) -> np.ndarray:
        """Code length of each text by language."""
        buf, starts, ends = joined(items, PAD)
        out = np.zeros((len(items), len(self.langs)), np.int64)
        for low in range(0, len(buf), WINDOW):  # the context of a window's first bytes is the end of the one before
            head = np.concatenate([np.frombuffer(PAD, np.uint8), buf[:0]]) if low == 0 else buf[low - ORDER : low]
            lengths = self.lengths(np.concatenate([head, buf[low : low + WINDOW]]))
            sums = np.zeros((len(lengths) + 1, len(self.langs)), np.int64)
            np.cumsum(lengths, axis=0, dtype=np.int64, out=sums[1:])
            here = np.flatnonzero((starts < low + WINDOW) & (ends > low))
            out[here] += sums[np.minimum(ends[here] - low, len(lengths))] - sums[np.maximum(starts[here] - low, 0)]
        return out


def train(df: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """A model from at most per_language documents of each language among those for which learn holds; None without any text.

    Rows with a null id or language teach nothing; of repeated rows each counts. The ranks that choose the documents are cut to per_language / SHARES
    before they shuffle, by a group limit in the plan, so that a language of any size sends a bounded number of rows from each task.
    """
    place, share = F.xxhash64(F.col(id_col), F.lit(11)), F.pmod(F.xxhash64(F.col(id_col), F.lit(12)), F.lit(SHARES)).cast("int")
    labelled = df.where(learn & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    rank = F.row_number().over(Window.partitionBy("lang", "share").orderBy("place"))
    ranked = labelled.select(F.col(lang_col).alias("lang"), share.alias("share"), place.alias("place")).withColumn("rank", rank).where(F.col("rank") <= -(-per_language // SHARES))
    upto = {(r["lang"], r["share"]): r["place"] for r in ranked.groupBy("lang", "share").agg(F.max("place").alias("place")).collect()}  # SHARES rows per language
    if not upto:
        return None
    bounds = F.create_map(*[F.lit(x) for (lang, k), bound in upto.items() for x in (f"{k} {lang}", bound)])
    sample = labelled.where(place <= F.element_at(bounds, F.concat(share.cast("string"), F.lit(" "), F.col(lang_col))))
    modest(df.sparkSession)
    counted = sample.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(count, "lang string, n int, gram long, seen long")
    pdf = counted.groupBy("lang", "n", "gram").agg(F.sum("seen").alias("seen")).toPandas()  # of the bounded sample
    if not len(pdf):
        return None
    langs = sorted(pdf.lang.unique())
    seen = []
    for n in range(1, ORDER + 2):
        part = pdf[pdf.n == n]
        keys = np.unique(part.gram.to_numpy(np.int64))
        table = np.zeros((len(keys), len(langs)))
        table[np.searchsorted(keys, part.gram.to_numpy(np.int64)), np.searchsorted(np.array(langs, object), part.lang.to_numpy(object))] = part.seen
        seen.append((keys, table))
    return Model(langs, seen)


def identify(df: DataFrame, model: Model | None, text_col: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """The columns keep of df (but for those named like results), lang_pred, score (0 to 1) and bits_per_byte of the shortest code.

    A text that is null or without a letter gets `und`, score 0 and no bits_per_byte; so does every text where nothing could be learned.
    Of languages with equal code lengths the first by code points is taken. Texts of any length are coded whole, in windows; repeated rows get the same
    result each; columns of df that are not in keep are not read. An empty df gives an empty result.
    """
    modest(df.sparkSession)
    rows = df.select(*carried(keep, "lang_pred", "score", "bits_per_byte"), F.col(text_col).alias("__text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("__letters"))
    schema = rows.drop("__text", "__letters").schema.add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")
    sent = shipped(df.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent()
        for batch in parts(batches, "__text"):
            told = np.array(batch.column("__letters").to_pylist(), bool) & (model is not None)
            items = texts(batch.column("__text"))
            names, score, per_byte = [None] * len(items), np.zeros(len(items)), np.full(len(items), np.nan)
            if told.any():
                some = [t for t, x in zip(items, told, strict=True) if x]
                bits = model.totals(some) / UNIT
                best = bits.argmin(1)
                score[told] = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
                per_byte[told] = bits.min(1) / np.fromiter(map(len, some), np.int64, len(some))
                chosen = iter(best)
                names = [model.langs[next(chosen)] if x else None for x in told]
            columns = [batch.column(c) for c in range(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x or "und" for x in names], pa.string()), pa.array(score), pa.array(per_byte, mask=~told)], names=schema.names)

    return rows.mapInArrow(run, schema)


def learnable(id_col: str = "doc_id") -> Column:
    return F.coalesce(crc_mod(id_col, 3) != 1, F.lit(False))
