"""License scan: exact phrases, and fuzzy search for short notices.

A text's words (runs of ASCII letters, digits and anything beyond ASCII, lower-cased) are written with one space between
them. A notice of length n may have k = n // ERROR_EVERY edits. Split into k + 1 pieces, at least one piece of
an occurrence with at most k edits stands there unchanged; an Aho-Corasick automaton of all
pieces finds these seeds, and the regex library's bounded-error matching verifies the stretch around each seed
and gives the span and its edits.

The words that tell a license from others (its keys) must stand in the span: as they are, or with one edit in a key of TELLING letters
or more, or with two letters swapped or one doubled in a shorter one, unless that is the name of another license. Words are counted once
for a text, by an index of the blanks between them.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.arrowtext import parts, texts
from larkspur.llm.common import carried, modest

ERROR_EVERY = 12
#: Fixed phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Short notices to be found with errors: label, keys (words that stand one after another, joined by blanks) and words that may not follow.
NOTICES = {
    "under the mit license": ("mit", ("mit",), ()),
    "apache license version 2": ("apache-2", ("apache", "2"), ()),
    "released under the mit license": ("mit", ("mit",), ()),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", ("permission", "charge"), ()),
    "licensed under the apache license version 2": ("apache-2", ("apache", "2"), ()),
    "licensed under cc by nc": ("cc-by-nc", ("cc by nc",), ()),
    "licensed under a creative commons attribution noncommercial": ("cc-by-nc", ("creative commons attribution noncommercial",), ()),
    "licensed under a creative commons attribution": ("cc-by", ("creative commons attribution",), ("noncommercial", "non", "sharealike", "share", "noderivs", "noderivatives", "no", "nc", "sa", "nd")),
    "licensed under the gnu general public license": ("gpl", ("gnu general public",), ()),
    "licensed under the gnu lesser general public license": ("lgpl", ("gnu lesser general public",), ()),
    "redistribution and use in source and binary forms": ("bsd", ("redistribution", "source", "binary"), ()),
    "licensed under the bsd license": ("bsd", ("bsd",), ()),
    "licensed under the mozilla public license": ("mpl", ("mozilla public",), ()),
    "this is free and unencumbered software released into the public domain": ("unlicense", ("unencumbered", "public domain"), ()),
}
#: Names of licenses: a key that is misspelt must not be one of these.
KNOWN = frozenset(("afl agpl apache apl bsd bsl by cc cddl cpl ecl epl eupl gfdl gnu gpl ijg isc lgpl mit mpl mozilla mspl nc nd ncsa odbl ofl osl php psf python qpl ruby sa sspl upl w3c wtfpl x11 zlib zpl").split())
TELLING = 5
SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,last_word:long,edits:int>>"
#: Bytes that end a word become spaces; A-Z become lower case.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def one_edit(a: str, b: str) -> bool:
    """Whether two different words are one edit apart."""
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else len(b) == len(a) + 1 and a[i:] == b[i + 1 :]


def stands_for(word: str, key: str) -> bool:
    """Whether a word is a key or a misspelling of it, and not the name of another license."""
    if word == key:
        return True
    if word in KNOWN or key.isdigit():
        return False
    if len(word) == len(key) and sorted(word) == sorted(key) and sum(x != y for x, y in zip(word, key, strict=True)) == 2:
        return True
    if len(key) >= TELLING:
        return one_edit(word, key)
    return len(word) == len(key) + 1 and any(word == key[:i] + key[i] + key[i:] for i in range(len(key)))


class Words:
    """The places of the blanks in a line that begins and ends with one: which word stands where."""

    def __init__(self, line: bytes, text: str):
        codes = np.frombuffer(line, np.uint8) if len(text) == len(line) else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.text, self.blanks = text, np.flatnonzero(codes == 32).tolist()

    def number(self, at: int) -> int:
        """The word that the character at this place belongs to."""
        return bisect_left(self.blanks, at) - 1

    def word(self, n: int) -> str:
        return self.text[self.blanks[n] + 1 : self.blanks[n + 1]] if 0 <= n < len(self.blanks) - 1 else ""


class Scanner:
    def __init__(self, phrases: dict[str, str], notices: dict[str, tuple[str, tuple, tuple]], error_every: int):
        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases.items()]
        self.notices = []
        self.seeds = ahocorasick.Automaton()
        for i, (notice, (label, keys, not_after)) in enumerate(notices.items()):
            k = len(notice) // error_every
            self.notices.append((notice, label, k, regex.compile(f"(?e)(?:{regex.escape(notice, literal_spaces=True)}){{e<={k}}}"), [key.split() for key in keys], not_after))
            cuts = [len(notice) * j // (k + 1) for j in range(k + 2)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                piece = notice[low:high]
                self.seeds.add_word(piece, [*self.seeds.get(piece, []), (i, low, high)])
        self.seeds.make_automaton()

    def scan(self, text: bytes) -> dict:
        words = text.translate(FOLD).split()
        line = b" " + b" ".join(words) + b" "
        index = None
        places = []
        for phrase, label in self.phrases:
            at = line.find(phrase)
            while at >= 0:
                index = index or Words(line, line.decode("latin-1"))
                places.append((index.number(at + 1), label))
                at = line.find(phrase, at + 1)
        found = self.fuzzy(line)
        starts, base = [w for w, _ in places], {label for _, label in places}
        return {
            "n_words": len(words), "n_base": len(places), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | {label for label, *_ in found})), "score": 1.0 if base else max((near for *_, near in found), default=0.0),
            "spans": [{"label": label, "first_word": first, "last_word": last, "edits": edits} for label, first, last, edits, _ in found],
        }

    def fuzzy(self, line: bytes) -> list[tuple[str, int, int, int, float]]:
        """label, first and last word, edits and likeness of each place of a notice; places of one notice do not overlap."""
        text = line.decode("utf-8", "replace")
        around: dict[int, list[list[int]]] = {}
        for end, hits in self.seeds.iter(text):
            for i, low, high in hits:
                notice, k = self.notices[i][0], self.notices[i][2]
                start = end + 1 - (high - low) - low - k
                stop = start + len(notice) + 2 * k
                spans = around.setdefault(i, [])
                if spans and start <= spans[-1][1]:  # seeds of a notice need not come in the order of their stretches
                    spans[-1] = [min(spans[-1][0], start), max(spans[-1][1], stop)]
                else:
                    spans.append([start, stop])
        found, index = [], None
        for i, spans in around.items():
            notice, label, _, pattern, keys, not_after = self.notices[i]
            for start, stop in spans:
                for m in pattern.finditer(text, max(0, start), min(len(text), stop)):
                    word = m.group().strip(" ")
                    if word:
                        index = index or Words(line, text)
                        low = m.start() + m.group().index(word)
                        first, last = index.number(low), index.number(low + len(word) - 1)
                        if told(index, first, last, keys, not_after):
                            edits = sum(m.fuzzy_counts)
                            found.append((label, first, last, edits, 1 - edits / len(notice)))
        return sorted(found)


def told(words: Words, first: int, last: int, keys: list[list[str]], not_after: tuple) -> bool:
    """Whether all keys stand among these words, and none of not_after follows."""
    here = [words.word(n) for n in range(first, last + 1)]
    for key in keys:
        if not any(all(stands_for(here[i + j], part) for j, part in enumerate(key)) for i in range(len(here) - len(key) + 1)):
            return False
    return not any(stands_for(words.word(last + 1), part) for part in not_after)


def scan_licenses(df: DataFrame, text_col: str = "text", keep: tuple = ("doc_id",), phrases: dict | None = None, notices: dict | None = None, error_every: int = ERROR_EVERY) -> DataFrame:
    """The columns keep of df (but for those named like results) with n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    n_base counts all places where a phrase's words stand one after another; first_word and last_word are the smallest and largest
    start of these. labels also has those of notices found with errors. score is 1 where a phrase stands, else the likeness of
    the best notice, 1 - edits / length, or 0. A null or empty text has no words, no labels and score 0. Texts of any length are scanned whole, in
time that grows with their length; repeated rows get the same result each; a column of df that is not in keep is not read.
    """
    modest(df.sparkSession)
    rows = df.select(*carried(keep, *[f.split()[0] for f in SCHEMA.split(", ")]), F.col(text_col).alias("__text"))
    out = rows.drop("__text").limit(0).schema
    for field in df.sparkSession.createDataFrame([], SCHEMA).schema:
        out = out.add(field)
    phrases, notices = PHRASES if phrases is None else phrases, NOTICES if notices is None else notices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, notices, error_every)
        kinds = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())])
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(kinds)]
        names = [f.name for f in out][-len(types) :]
        for batch in parts(batches, "__text"):
            got = [scanner.scan(t) for t in texts(batch.column("__text"))]
            columns = [batch.column(c) for c in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array([g[n] for g in got], t) for n, t in zip(names, types, strict=True)]], names=[f.name for f in out])

    return rows.mapInArrow(run, out)
