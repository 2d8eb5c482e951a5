"""SentencePiece encoding and decoding by a Viterbi search that words with a common prefix share.

The model's type says which segmentation is right. Of a unigram model it is the one of the largest sum of scores: the forward score of a
position is the best sum up to it (``Unigram``). Of a BPE model it is the one that greedy merging by rank makes, whose sum need not be
the largest (``Merging``). That is the result of a forward search over the lattice of pieces too: merges never
cross a boundary of the result, so the segmentation of a prefix that ends at such a boundary is a prefix of the segmentation, and
a sequence of pieces is a segmentation exactly if each two neighbours are (``Merging.adjacent``). The best path to a
position is the only path whose neighbours all agree, and the forward score of a position is the last piece of that path.
Models of other types, with a normaliser of their own, or with symbols defined by a user are refused.

The distinct marked words of a batch are sorted; walking them in this order is a depth-first traversal of their trie.
The forward scores stand on a stack as deep as the word, and what a word has in common with the one before is not searched again.
"""

from __future__ import annotations

import hashlib
import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from larkspur.llm.arrowtext import parts
from larkspur.llm.common import carried, modest, shipped

MARK = "▁"
#: No piece holds a mark after another character, or a line end: pieces stay within these words.
WORD = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
BATCH_BYTES = 10 << 20
MEMO = 1 << 19
#: Paths are kept for so many positions of a word; beyond, they are read back from the last pieces.
KEPT = 64
#: The model types of the format, and what a character without a piece costs below the least score of a unigram model.
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0
#: Longer texts are cut into words as they are read, not all at once.
LONG = 1 << 20


class Vocabulary:
    """Pieces of a SentencePiece model: text, score and id."""

    def __init__(self, pieces: list[tuple[str, float, bool]], unknown: int, first_blank: bool = True, squeezed: bool = False):
        """pieces: text, score and whether it is a normal piece, by id; unknown: the id for a character without any; first_blank: whether a mark is put before a text; squeezed: whether blanks at the ends and beside others go."""
        self.first_blank, self.squeezed = first_blank, squeezed
        self.ids = {p: i for i, (p, _, normal) in enumerate(pieces) if normal}
        self.rank = {p: score for p, score, normal in pieces if normal}
        if odd := [p for p in self.ids if "\n" in p and p != "\n" or MARK in p.lstrip(MARK)]:
            raise ValueError(f"pieces that go over the end of a word: {odd[:3]}")
        self.written = [i.to_bytes(4, sys.byteorder) for i in range(len(pieces))]
        self.tails: dict[str, tuple[int, ...]] = {}
        long_tails: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 2:
                long_tails.setdefault(p[-3:], set()).add(len(p))
        self.long_tails = {end: tuple(sorted(n, reverse=True)) for end, n in long_tails.items()}
        self.unknown = unknown
        self.bytes = {int(p[3:5], 16): i for i, (p, _, normal) in enumerate(pieces) if not normal and re.fullmatch("<0x[0-9A-F]{2}>", p)}
        spelled = {i: bytes([b]) for b, i in self.bytes.items()}
        self.spelled = [spelled.get(i, p.replace(MARK, " ").encode() if normal else b"") for i, (p, _, normal) in enumerate(pieces)]
        self.names = [p for p, _, _ in pieces]
        self.prepare()

    def prepare(self) -> None:
        """What a kind of vocabulary adds."""

    @staticmethod
    def load(path: str) -> Vocabulary:
        """The vocabulary of a model file, of the kind that its type asks for."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = model_settings(model.serialized_model_proto())
        kind = {UNIGRAM: Unigram, BPE: Merging}.get(spec["type"])
        if kind is None or spec["normaliser"] or spec["user_defined"] or spec["suffix"]:
            raise ValueError(f"{path}: only unigram and BPE models without a normaliser, user-defined symbols and blanks as suffixes can be used, not {spec}")
        pieces = [(model.id_to_piece(i), model.get_score(i), not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))) for i in range(model.get_piece_size())]
        return kind(pieces, model.unk_id(), spec["first_blank"], spec["squeezed"])

    def spell(self, character: str) -> bytes:
        """The ids of the bytes of a character that has no piece."""
        return b"".join(self.written[self.bytes[b]] for b in character.encode()) if self.bytes else self.written[self.unknown]

    def lengths(self, end: str) -> tuple[int, ...]:
        """The lengths, largest first, of the pieces that a text may end in; end: its last three characters (all, if fewer)."""
        known = self.tails.get(end)
        if known is None:
            short = [n for n in (2, 1) if n <= len(end) and (n == 1 or end[-2:] in self.ids)]
            known = self.tails[end] = (*self.long_tails.get(end, ()), *short)
        return known

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """The ids of each word, as 4-byte numbers."""
        raise NotImplementedError

    def words(self, text: str) -> Iterable[str]:
        """The marked words of a text: blanks become marks, and one stands before the first word (unless the model has none there)."""
        text = self.squeeze(text)
        if not text:
            return ()
        if self.first_blank and len(text) < LONG and text[0] != " " and "  " not in text and MARK not in text:  # the same words, without the expression
            return filter(None, (MARK + text.replace(" ", f" {MARK}").replace("\n", " \n ")).split(" "))
        return (m.group() for m in WORD.finditer(MARK * self.first_blank + text.replace(" ", MARK)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        known = self.encode_words(set(chain.from_iterable(map(self.words, texts))))
        got = [np.frombuffer(b"".join(map(known.__getitem__, self.words(text))), np.int32) for text in texts]
        return got if self.bytes else [self.run_together(ids) for ids in got]

    def run_together(self, ids: np.ndarray) -> np.ndarray:
        """Without bytes to spell them, characters beside each other that have no piece are one unknown."""
        again = np.zeros(len(ids), bool)
        again[1:] = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
        return ids[~again]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, without the blank before its first word."""
        return b"".join(map(self.spelled.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "replace").removeprefix(" " * self.first_blank)

    def plain(self, text: str) -> str:
        """What decoding the ids of a text is to give back."""
        return self.squeeze(text).replace(MARK, " ")

    def squeeze(self, text: str) -> str:
        return re.sub(" +", " ", text).lstrip(" ").rstrip(f" {MARK}") if self.squeezed else text


class Merging(Vocabulary):
    """A BPE vocabulary."""

    def prepare(self) -> None:
        self.others: dict[str, int] = {}  # characters without a piece: numbers beyond the pieces'
        self.memo: dict[int, bool] = {}
        self.histories: dict[str, list[tuple[float, str, str]] | None] = {"": []}

    def history(self, piece: str) -> list[tuple[float, str, str]] | None:
        """The merges that make a piece of its characters, best score first and of equals the leftmost: score, first and last part after it. None if they end in more than one part."""
        if piece in self.histories:
            return self.histories[piece]
        parts, steps = list(piece), []
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.rank.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            steps.append((best, parts[0], parts[-1]))
        out = self.histories[piece] = steps if len(parts) == 1 else None
        return out

    def number(self, character: str) -> int:
        """A number for a character that has no piece."""
        if character not in self.others:
            self.others[character] = len(self.names)
            self.names.append(character)
        return self.others[character]

    def adjacent(self, left: int, right: int) -> bool:
        """Whether merging leaves the piece right, alone or after the piece left, as it is; left is -1 at the start of a word.

        The merges within left and within right go on independently, the better-scored next one first, until one across the
        boundary is better than both.
        """
        if len(self.memo) >= MEMO:
            self.memo.clear()
        known = self.memo[left << 32 | right] = self.undisturbed(self.names[left] if left >= 0 else "", self.names[right])
        return known

    def undisturbed(self, left: str, right: str) -> bool:
        mine, other = self.history(left), self.history(right)
        if mine is None or other is None or not left:
            return other is not None
        i = j = 0
        a, b = left[-1], right[0]
        while True:
            across = self.rank.get(a + b)
            if across is None:
                # no merge can cross before one of the two parts changes
                if i == len(mine) and j == len(other):
                    return True
            elif not (i < len(mine) and mine[i][0] >= across) and not (j < len(other) and other[j][0] > across):
                return False
            if j == len(other) or i < len(mine) and mine[i][0] >= other[j][0]:
                a = mine[i][2]
                i += 1
            else:
                b = other[j][1]
                j += 1

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """The ids of each word, as 4-byte numbers."""
        out: dict[str, bytes] = {}
        ids, tails, memo, written, pieces = self.ids, self.tails, self.memo, self.written, len(self.written)
        before = ""
        last: list[int] = [-1]  # for each prefix of the word at hand the last piece of its path
        paths: list[bytes] = [b""]  # and the ids of the path, for the first KEPT positions
        for word in sorted(words):
            shared = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], paths[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                tail = word[end - 3 if end > 3 else 0 : end]
                for length in tails.get(tail) or self.lengths(tail):
                    start = end - length
                    if start < 0:
                        continue
                    number = ids.get(word[start:end])
                    if number is None:
                        if length > 1:
                            continue
                        number = self.number(word[start:end])
                    left = last[start]
                    known = memo.get(left << 32 | number)
                    if known or known is None and self.adjacent(left, number):
                        last.append(number)
                        if end < KEPT:
                            paths.append(paths[start] + (written[number] if number < pieces else self.spell(word[start:end])))
                        break
            end, rest = len(word), []
            while end >= KEPT:
                number = last[end]
                rest.append(written[number] if number < pieces else self.spell(self.names[number]))
                end -= len(self.names[number])
            out[word] = b"".join([paths[end], *reversed(rest)]) if rest else paths[end]
            before = word
        return out


class Unigram(Vocabulary):
    """A unigram vocabulary: the best segmentation has the largest sum of scores, of equals the one with the longest last piece. Sums are rounded to single precision at each step."""

    def prepare(self) -> None:
        self.without = min(self.rank.values(), default=0.0) - UNKNOWN_PENALTY

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """The ids of each word, as 4-byte numbers."""
        out: dict[str, bytes] = {}
        ids, rank, written, without = self.ids, self.rank, self.written, self.without
        before = ""
        best = array("f", [0.0])  # for each prefix of the word at hand the largest sum
        last = [0]  # the length of the last piece of that path
        paths: list[bytes] = [b""]  # and the ids of the path, for the first KEPT positions
        rounded = array("f", [0.0])
        for word in sorted(words):
            shared = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], last[shared + 1 :], paths[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                top, length = None, 1
                for n in self.lengths(word[end - 3 if end > 3 else 0 : end]):
                    if n <= end:
                        score = rank.get(word[end - n : end], without if n == 1 else None)
                        if score is not None:
                            rounded[0] = best[end - n] + score
                            if top is None or rounded[0] > top:
                                top, length = rounded[0], n
                best.append(top)
                last.append(length)
                if end < KEPT:
                    piece = word[end - length : end]
                    paths.append(paths[end - length] + (written[ids[piece]] if piece in ids else self.spell(piece)))
            end, rest = len(word), []
            while end >= KEPT:
                piece = word[end - last[end] : end]
                rest.append(written[ids[piece]] if piece in ids else self.spell(piece))
                end -= last[end]
            out[word] = b"".join([paths[end], *reversed(rest)]) if rest else paths[end]
            before = word
        return out


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The numbers and values of the fields of a protocol buffer."""

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = message[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    at = 0
    while at < len(message):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield key >> 3, message[at : at + size]
            at += size


def model_settings(proto: bytes) -> dict:
    """Of a model file: type, whether it has a normaliser and user-defined pieces, and how it treats blanks. The numbers of fields are those of the public format."""
    out = {"type": UNIGRAM, "normaliser": False, "user_defined": False, "suffix": False, "first_blank": True, "squeezed": True}
    for field, value in fields(proto):
        inner = dict(fields(value)) if field in (1, 2, 3) else {}
        if field == 1:
            out["user_defined"] |= inner.get(3, 1) == 4
        elif field == 2:
            out["type"], out["suffix"] = inner.get(3, UNIGRAM), bool(inner.get(24, 0))
        elif field == 3:
            out["normaliser"] = bool(inner.get(2)) or not inner.get(5, 1)
            out["first_blank"], out["squeezed"] = bool(inner.get(3, 1)), bool(inner.get(4, 1))
    return out


def encode(df: DataFrame, model_path: str, text_col: str = "text", keep: tuple = ("doc_id",), digest: bool = False) -> DataFrame:
    """The columns keep of df (but for those named like results), n_pieces and pieces (the ids); with digest, instead of pieces: pieces_sha256 (of the ids as 4-byte little-endian numbers) and round_trip, whether decoding gives the text back.

    A null or empty text has no pieces. The mark U+2581 itself is encoded as a blank, as the model does, and
    so comes back as a blank: round_trip compares with the text so written (and without the blanks that the model drops). Texts of any length are encoded
    whole; repeated rows get the same result each; columns of df that are not in keep are not read. An empty df gives an empty result.
    """
    modest(df.sparkSession)
    rows = df.select(*carried(keep, "n_pieces", "pieces", "pieces_sha256", "round_trip"), df[text_col].alias("__text"))
    schema = rows.drop("__text").schema.add("n_pieces", "long")
    schema = schema.add("pieces_sha256", "string").add("round_trip", "boolean") if digest else schema.add("pieces", ArrayType(IntegerType()))
    sent = shipped(df.sparkSession, Vocabulary.load(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent()
        for batch in parts(batches, "__text", BATCH_BYTES):
            texts = [t or "" for t in batch.column("__text").to_pylist()]
            columns = [batch.column(c) for c in range(batch.num_columns - 1)]
            got = vocabulary.encode(texts)
            counts = pa.array(map(len, got), pa.int64())
            if digest:
                sha = pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in got], pa.string())
                same = pa.array([vocabulary.decode(x) == vocabulary.plain(t) for x, t in zip(got, texts, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([*columns, counts, sha, same], names=schema.names)
            else:
                yield pa.RecordBatch.from_arrays([*columns, counts, pa.array(got, pa.list_(pa.int32()))], names=schema.names)

    return rows.mapInArrow(run, schema)


def decode(df: DataFrame, model_path: str, pieces_col: str = "pieces", keep: tuple = ("doc_id",)) -> DataFrame:
    """The columns keep of df and text, decoded from pieces; null for null."""
    rows = df.select(*carried(keep, "text"), df[pieces_col].alias("__pieces"))
    schema = rows.drop("__pieces").schema.add("text", "string")
    sent = shipped(df.sparkSession, Vocabulary.load(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent()
        for batch in batches:
            texts = [None if x is None else vocabulary.decode(x) for x in batch.column("__pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in range(batch.num_columns - 1)], pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)
