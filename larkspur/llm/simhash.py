"""SimHashes of lines and the search for near ones, on whole arrays.

A SimHash has BITS bits, held as two 64-bit numbers (a, b). ``Plan`` says how near ones are brought together: in each of its
tables a block of adjacent bits (``bits`` of them, at evenly spaced places) names the bucket that a line goes to, and within a bucket
the other bits are split into blocks again. Two SimHashes that differ in fewer bits than there are disjoint blocks share one; the number of
blocks on either level is such that a pair with RADIUS differing bits meets with probability RECALL on each level, whatever the number of lines.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from larkspur.llm.shingles import mixed, powers, word_hashes

BITS = 128
RADIUS = 16
RECALL = 0.98
#: Candidates differ in at most so many bits.
NEAR = 27
MIN_WORDS = 5
#: A bucket is to hold about 2^BUCKET lines.
BUCKET = 16
LEAST_BITS = 8
#: Of runs up to this length all pairs are compared, of longer ones each line with the run's leaders first.
RUN = 4
#: In runs up to this length the leaders are chosen among the near pairs, in longer ones by comparing each in turn with the rest.
MIDDLE = 32
#: Pairs that are compared or held at once.
PAIRS = 1 << 20
#: Up to this distance within runs pairs are compared by shifted arrays.
SMALL = 3
#: Entries whose blocks are sorted at once, about so many.
GROUP = 1 << 15
#: Features of a line that are counted at once, in lanes of eight bits.
LANE = 255
SLICE = 1 << 19
#: Bytes of text whose lines are made at once.
STEP = 1 << 18
EACH_LANE = np.uint64(0x0101_0101_0101_0101)
ENTRY = np.dtype([("cell", "<u8"), ("h", "<i8"), ("a", "<u8"), ("b", "<u8")])
U = np.uint64


def tables_for(bits: int) -> int:
    """So many blocks of bits make a pair with RADIUS differing bits share one with probability RECALL."""
    return max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - RADIUS / BITS) ** bits))) if bits else 1


@dataclass(frozen=True)
class Plan:
    bits: int
    tables: int

    @classmethod
    def of(cls, lines: int) -> Plan:
        bits = max(LEAST_BITS, math.ceil(math.log2(max(1, lines))) - BUCKET)
        return cls(bits, tables_for(bits))


def rotated(a: np.ndarray, b: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
    """The 128 bits (b above a) turned right by so many."""
    by %= BITS
    if by >= 64:
        a, b, by = b, a, by - 64
    if not by:
        return a, b
    return (a >> U(by)) | (b << U(64 - by)), (b >> U(by)) | (a << U(64 - by))


def turn(plan: Plan, table: int) -> int:
    """The turn after which the block of a table is at the top."""
    return table * BITS // plan.tables + plan.bits


def entries(h: np.ndarray, a: np.ndarray, b: np.ndarray, plan: Plan) -> Iterator[np.ndarray]:
    """For each table an entry of each line: its cell (table and bucket) and its SimHash, turned so that the block is at the top."""
    for table in range(plan.tables):
        out = np.empty(len(h), ENTRY)
        out["h"], (out["a"], out["b"]) = h, rotated(a, b, turn(plan, table))
        out["cell"] = (out["b"] >> U(64 - plan.bits)) | U(table << 32)
        yield out


def unturned(e: np.ndarray, plan: Plan) -> np.ndarray:
    """The first half of the SimHash of each entry, as it was."""
    out = np.empty(len(e), np.uint64)
    tables = (e["cell"] >> U(32)) & U(0xFFFF)
    for table in np.unique(tables):
        at = tables == table
        out[at] = rotated(e["a"][at], e["b"][at], BITS - turn(plan, int(table)) % BITS)[0]
    return out.view(np.int64)


def near_ones(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) differ in at most NEAR bits; most are told apart by one half."""
    half = np.bitwise_count(a[i] ^ a[j])
    some = np.flatnonzero(half <= NEAR)
    return some[half[some] + np.bitwise_count(b[i[some]] ^ b[j[some]]) <= NEAR]


def part_pairs(e: np.ndarray, plan: Plan) -> np.ndarray:
    """The pairs of part_search()."""
    return part_search(e, plan)[0]


def part_search(e: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of entries of the same cell that differ in at most NEAR bits and share a block: rows (i, j).

    In a long run i is a leader; it stands before j in the order of the lines' hashes, so that a leader is the same one in many tables.
    The other near pairs of long runs are among the entries given second, with the bits of their cells' blocks third: pairs_across() finds them.
    """
    _, where, counts = np.unique(e["cell"], return_inverse=True, return_counts=True)
    bits = np.maximum(np.ceil(np.log2(counts)).astype(np.int64) - 1, 0)[where]  # runs of two lines or so
    order = np.argsort(e["h"], kind="stable")
    order = order[np.lexsort((where[order], bits[order]))]
    found, waiting = [np.zeros((0, 2), np.int64)], np.zeros(len(e), bool)
    a, b = e["a"][order], e["b"][order]
    for at, key in runs(a, b, where[order], bits[order], plan):
        i, j, unsettled = near_in_runs(a[at], b[at], key)
        found.append(np.stack([order[at[i]], order[at[j]]], 1))
        waiting[order[at[unsettled]]] = True
    out = np.concatenate(found)
    names = np.unique(out[:, 0] * len(e) + out[:, 1])
    at = np.flatnonzero(waiting)
    return np.stack([names // max(1, len(e)), names % max(1, len(e))], 1), at, bits[at]


def runs(a: np.ndarray, b: np.ndarray, where: np.ndarray, bits: np.ndarray, plan: Plan) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each place of the second level's blocks: the entries that have one, sorted, and a key that is equal for those with the same number (where) and block.

    bits is the same for the same number; bits and, within them, where are sorted. Whole numbers with the same bits go together, about GROUP entries, whose arrays stay in the cache.
    """
    start = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])) if len(a) else np.zeros(0, np.int64)
    group = np.stack([bits[start], start // GROUP])
    edge = [*start[np.flatnonzero((group[:, 1:] != group[:, :-1]).any(0)) + 1].tolist(), len(a)]
    low = 0
    for high in edge if len(a) else []:
        some = int(bits[low])
        rounds = tables_for(some)
        room, mask, place = (BITS - plan.bits - some) / max(rounds - 1, 1), U((1 << some) - 1), (high - low).bit_length()
        number = np.cumsum(np.concatenate([[False], where[low + 1 : high] != where[low : high - 1]]))
        name = np.uint32 if (int(number[-1]) + 1) << (some + place) <= 1 << 32 else np.uint64
        base, x, y = ((number << (some + place)) | np.arange(high - low)).astype(name), a[low:high], b[low:high]
        for table in range(rounds):
            shift = int(table * room)
            if shift >= 64:
                block = y >> U(shift - 64)
            elif shift + some <= 64:
                block = x >> U(shift)
            else:
                block = (x >> U(shift)) | (y << U(64 - shift))
            key = base | ((block & mask) << U(place)).astype(name)
            key.sort()
            yield (key & name((1 << place) - 1)).astype(np.int64) + low, key >> name(place)
        low = high


def across(run: np.ndarray, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places of all pairs of the same run and different labels, about PAIRS at a time; run and, within it, label are sorted."""
    new = run[1:] != run[:-1]
    last = np.append(np.flatnonzero(new) + 1, len(run))
    run_end = np.repeat(last, np.diff(last, prepend=0))
    last = np.append(np.flatnonzero(new | (label[1:] != label[:-1])) + 1, len(run))
    label_end = np.repeat(last, np.diff(last, prepend=0))
    some = np.flatnonzero(run_end > label_end)
    todo = np.cumsum((run_end - label_end)[some])
    low = 0
    while low < len(some):
        done = todo[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(todo, done + PAIRS, "right")))
        n = np.diff(todo[low:high], prepend=done)
        i = np.repeat(some[low:high], n)
        yield i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + label_end[i]
        low = high


def pairs_across(e: np.ndarray, bits: np.ndarray, label: np.ndarray, plan: Plan) -> Iterator[np.ndarray]:
    """All pairs of entries with different labels that differ in at most NEAR bits and share a cell and a block of so many bits: rows (i, j), which may come again."""
    _, where = np.unique(e["cell"], return_inverse=True)
    order = np.lexsort((label, where, bits))
    a, b, label = e["a"][order], e["b"][order], label[order]
    held, size = [], 0
    for at, key in runs(a, b, where[order], bits[order], plan):
        for i, j in across(key, label[at]):
            i, j = at[i], at[j]
            near = near_ones(a, b, i, j)
            i, j = order[i[near]], order[j[near]]
            first = e["h"][i] <= e["h"][j]
            held.append(np.where(first, i, j) * len(e) + np.where(first, j, i))
            size += len(i)
            if size >= PAIRS:
                held = [np.unique(np.concatenate(held))]
                if (size := len(held[0])) >= PAIRS // 2:
                    yield np.stack([held[0] // len(e), held[0] % len(e)], 1)
                    held, size = [], 0
    if size:
        names = np.unique(np.concatenate(held))
        yield np.stack([names // len(e), names % len(e)], 1)


def inside(start: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places of all pairs within runs, given by start and length, about PAIRS at a time."""
    start, length = start[length > 1], length[length > 1]
    todo = np.cumsum(length * (length - 1) // 2)
    low = 0
    while low < len(start):
        done = todo[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(todo, done + PAIRS, "right")))
        n = length[low:high] - 1
        first = np.repeat(start[low:high] - np.cumsum(n) + n, n) + np.arange(n.sum())  # but for the last one of each run
        n = np.repeat(start[low:high] + n, n) - first
        i = np.repeat(first, n)
        yield i, np.arange(len(i)) + np.repeat(first + 1 - np.cumsum(n) + n, n)
        low = high


def near_in_runs(a: np.ndarray, b: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of pairs of near entries within runs of equal keys, which are sorted: all of short runs, those with the leaders of long ones; and the places among which the other near pairs are."""
    left, right, waiting = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def add(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        near = near_ones(a, b, i, j)
        left.append(i[near])
        right.append(j[near])
        return near

    most = max(RUN, MIDDLE)
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    length = np.diff(edge)
    own = np.where(length <= most, length, 1)
    of = key if (own == length).all() else np.where(np.repeat(length <= most, length), key, np.arange(len(key), dtype=key.dtype) + key[-1])
    for gap in range(1, min(SMALL + 1, int(own.max(initial=0)))):  # by shifted arrays, which need no places
        some = np.flatnonzero((np.bitwise_count(a[gap:] ^ a[:-gap]) <= NEAR) & (of[gap:] == of[:-gap]))
        add(some, some + gap)
    for i, j in inside(edge[:-1], own - SMALL):
        add(i, j + SMALL)
    i, j = np.concatenate(left), np.concatenate(right)
    if not (length > RUN).any():
        return i, j, waiting[0]
    middle = length[np.searchsorted(edge, i, "right") - 1] > RUN
    left, right = [i[~middle]], [j[~middle]]
    i, j, gone = i[middle], j[middle], np.zeros(len(key), bool)
    while len(i):  # a line with no near one before it, but for such that go, is a leader; what is near it goes
        after = np.zeros(len(key), bool)
        after[j] = True
        leads = ~after[i]
        left.append(i[leads])
        right.append(j[leads])
        gone[j[leads]] = True
        waits = ~leads & gone[i]
        waiting.extend([i[waits], j[waits]])
        later = ~leads & ~gone[i]
        i, j = i[later], j[later]
    long = length > most
    rest, start = np.flatnonzero(np.repeat(long, length)), np.zeros(len(key), np.int64)
    start[rest] = np.repeat(edge[:-1][long], length[long])
    while len(rest):  # the first of each run is a leader; what is near it goes
        first = np.flatnonzero(np.concatenate([[True], start[rest][1:] != start[rest][:-1]]))
        leader = np.repeat(rest[first], np.diff(np.append(first, len(rest))))
        other = np.flatnonzero(rest != leader)
        left_out = np.ones(len(other), bool)
        left_out[add(leader[other], rest[other])] = False
        gone, rest = rest[other[~left_out]], rest[other[left_out]]
        waiting.extend(uncompared(a, b, start, gone, rest))
    return np.concatenate(left), np.concatenate(right), np.unique(np.concatenate(waiting))


def uncompared(a: np.ndarray, b: np.ndarray, start: np.ndarray, gone: np.ndarray, rest: np.ndarray) -> Iterator[np.ndarray]:
    """Of the places that go and the rest of their runs (of equal start), those in near pairs of two that go or of one that goes and one of the rest. Two that go are taken for such a pair, and so is all of a run in which there are too many to compare."""
    if not len(gone):
        return
    runs, place, n = np.unique(start[gone], return_inverse=True, return_counts=True)
    yield gone[n[place] > 1]
    of = np.minimum(np.searchsorted(runs, start[rest]), len(runs) - 1)
    there = runs[of] == start[rest]
    rest, of = rest[there], of[there]
    many = n * np.bincount(of, minlength=len(runs)) > PAIRS
    if many.any():
        yield gone[many[place]]
        yield rest[many[of]]
        few = ~many[place], ~many[of]
        gone, place, rest, of = gone[few[0]], place[few[0]], rest[few[1]], of[few[1]]
    at, run, left = np.concatenate([gone, rest]), np.concatenate([place, of]), np.repeat([False, True], [len(gone), len(rest)])
    order = np.lexsort((left, run))
    at = at[order]
    for i, j in across(run[order], left[order]):
        near = near_ones(a, b, at[i], at[j])
        yield at[i[near]]
        yield at[j[near]]


def lines_of(texts: list[bytes], among: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Of all lines of the texts, in order: text (its number), at (place in the text), n (words), h (hash of its words), a and b (the SimHash; a hash of h and 0 under MIN_WORDS words), and word_hash and first (of each word, and where the words of each line begin).

    With a table of bits (has_bit) a and b are right only for lines whose hashes have one.
    """
    size = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    if len(texts) < 2 or size[-1] <= STEP:
        return some_lines(texts, among)
    edge = [0, *(np.flatnonzero(size[1:] // STEP != size[:-1] // STEP) + 1).tolist(), len(texts)]
    got = [some_lines(texts[low:high], among) for low, high in zip(edge, edge[1:], strict=False)]
    out = {c: np.concatenate([x[c] for x in got]) for c in got[0]}
    for c, ends in (("text", edge[1:-1]), ("first", np.cumsum([len(x["word_hash"]) for x in got[:-1]]).tolist())):
        out[c] += np.repeat([0, *ends], [len(x["text"]) for x in got])
    return out


def some_lines(texts: list[bytes], among: np.ndarray | None) -> dict[str, np.ndarray]:
    """lines_of() about STEP bytes, whose arrays stay in the cache."""
    buf = b"\n".join(texts)
    ends = np.flatnonzero(np.frombuffer(buf, np.uint8) == 10) if buf else np.zeros(0, np.int64)
    bounds = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1  # where each text ends
    text = np.searchsorted(bounds, np.append(ends, len(buf)))
    starts = np.searchsorted(text, np.arange(len(texts)))
    at = np.arange(len(text)) - starts[text]
    words, places = word_hashes(buf)
    first = np.searchsorted(places, np.concatenate([[0], ends]))
    n = np.diff(np.append(first, len(words)))
    line = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(words)) - np.repeat(first, n)
    h = np.zeros(len(text), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        h[some] = np.add.reduceat((words + U(1)) * powers(0xD1342543DE82EF95, int(n.max()))[inside], first[some])
    h = mixed(h + n.astype(np.uint64))
    a, b = mixed(h ^ U(0x5851F42D4C957F2D)), np.zeros(len(text), np.uint64)
    sign, own, of = np.arange(len(n)), words, line
    if among is not None:
        there = has_bit(among, h)
        sign, own = np.flatnonzero(there), words[there[line]]
        of = np.repeat(np.arange(len(sign)), n[sign])
    begin = np.cumsum(n[sign]) - n[sign]
    for low, high in slices(n[sign], begin):
        at_words = slice(begin[low], begin[high - 1] + n[sign[high - 1]])
        a[sign[low:high]], b[sign[low:high]] = signed(own[at_words], of[at_words] - low, n[sign[low:high]], a[sign[low:high]])
    return {"text": text, "at": at, "n": n, "h": h.view(np.int64), "a": a.view(np.int64), "b": b.view(np.int64), "word_hash": words, "first": first}


def has_bit(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes have a bit in a table of 64-bit words, whose number is a power of two: the last six bits of a hash name the bit, those before them the word."""
    return ((table[(h >> U(6)) & U(len(table) - 1)] >> (h & U(63))) & U(1)).astype(bool)


def slices(n: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of lines with about SLICE words, or of one longer line."""
    low = 0
    while low < len(n):
        high = max(low + 1, int(np.searchsorted(first, first[low] + SLICE)))
        high = min(high, low + (1 << 22), len(n))
        yield low, high
        low = high


def signed(words: np.ndarray, line: np.ndarray, n: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The SimHash of each line over its different words, of which a bit is set that more than half have; (short, 0) for lines under MIN_WORDS words."""
    enough = n >= MIN_WORDS
    a, b = short.copy(), np.zeros(len(n), np.uint64)
    use = enough[line]
    if not use.any():
        return a, b
    key = (line[use].astype(np.uint64) << U(40)) | (words[use] >> U(24))
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    owner = (key >> U(40)).astype(np.int64)
    features = np.bincount(owner, minlength=len(n))
    begin = np.concatenate([[0], np.cumsum(features)[:-1]])
    own = np.flatnonzero(features)
    chunks = -(-features[own] // LANE)
    chunk_of = np.repeat(np.arange(len(own)), chunks)
    first_chunk = np.concatenate([[0], np.cumsum(chunks)[:-1]])
    chunk_start = begin[own][chunk_of] + LANE * (np.arange(len(chunk_of)) - first_chunk[chunk_of])
    halves, bit = [], np.empty(len(key), np.uint64)
    x = key & U((1 << 40) - 1)
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        x = mixed(x * U(salt) + U(salt >> 7))
        sig = np.zeros((len(own), 8), np.uint8)
        for k in range(8):
            np.bitwise_and(np.right_shift(x, U(k), out=bit), EACH_LANE, out=bit)
            lanes = np.add.reduceat(bit, chunk_start).view(np.uint8).reshape(-1, 8)
            total = np.add.reduceat(lanes.astype(np.int64), first_chunk, axis=0) if len(chunk_of) > len(own) else lanes.astype(np.int64)
            sig |= (2 * total > features[own][:, None]).astype(np.uint8) << np.uint8(k)
        halves.append(sig.view(np.uint64)[:, 0])
    a[own], b[own] = halves
    return a, b


def surely_within(xs: list[np.ndarray], ys: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """Of pairs of sequences those that are seen to be within so many edits by one alignment: from the left up to some place, one gap, then from the right. What is not seen may be within too."""
    out = np.zeros(len(xs), bool)
    n, m = (np.fromiter(map(len, z), np.int64, len(z)) for z in (xs, ys))
    longest = np.maximum(n, m)
    order = np.argsort(-longest, kind="stable")
    done = 0
    while done < len(order):  # the longest first, in blocks of bounded size
        some = order[done : done + min(512, max(1, (1 << 18) // max(1, int(longest[order[done]]))))]
        done += len(some)
        shorter = np.minimum(n[some], m[some])
        width = int(np.maximum(n[some], m[some]).max())
        left, right = np.zeros((2, len(some), width), np.uint32), np.zeros((2, len(some), width), np.uint32)
        for row, k in enumerate(some):
            for side, z in enumerate((xs[k], ys[k])):
                left[side, row, : len(z)], right[side, row, width - len(z) :] = z, z
        place = np.arange(width)
        inside = place < shorter[:, None]
        ahead, back = np.zeros((len(some), width + 1), np.int32), np.zeros((len(some), width + 1), np.int32)
        np.cumsum((left[0] != left[1]) & inside, axis=1, out=ahead[:, 1:])
        np.cumsum(((right[0] != right[1]) & inside[:, ::-1])[:, ::-1], axis=1, out=back[:, 1:])
        rest = np.maximum(shorter[:, None] - np.arange(width + 1), 0)  # of the shorter one, what the right side takes
        differ = ahead + np.take_along_axis(back, rest, 1)
        out[some] = differ.min(1) + np.abs(n[some] - m[some]) <= most[some]
    return out


def within(x: np.ndarray, y: np.ndarray, most: int) -> bool:
    """Whether the edit distance of two sequences of numbers is at most so much: the furthest places that e edits reach on each diagonal, for growing e."""
    n, m = len(x), len(y)
    if abs(n - m) > most:
        return False
    base = powers(0x2545F4914F6CDD1D, max(n, m) + 1)
    sums = [np.concatenate([[U(0)], np.cumsum(mixed(z.astype(np.uint64) + U(1)) * base[: len(z)])]) for z in (x, y)]
    steps = [1 << k for k in range(max(n, m).bit_length())][::-1]

    def slid(i: np.ndarray, d: np.ndarray) -> np.ndarray:
        """How far equal numbers go on from x[i] and y[i + d], by hashes of stretches."""
        length = np.zeros_like(i)
        j = i + d
        for step in steps:
            longer = length + step
            fits = np.flatnonzero((i + longer <= n) & (j + longer <= m))
            a, b, k = i[fits], j[fits], longer[fits]
            same = (sums[0][a + k] - sums[0][a]) * base[b] == (sums[1][b + k] - sums[1][b]) * base[a]
            length[fits[same]] += step
        return i + length

    far = slid(np.zeros(1, np.int64), np.zeros(1, np.int64))
    for e in range(most + 1):
        d = np.arange(-e, e + 1)
        if e:
            gone = np.full(1, -1)
            far = np.maximum(np.maximum(np.concatenate([gone, far + 1, gone]), np.concatenate([gone, gone, far])), np.concatenate([far + 1, gone, gone]))
            far = np.minimum(far, np.minimum(n, m - d))
            valid = np.flatnonzero((far >= 0) & (far + d >= 0))
            far[valid] = slid(far[valid], d[valid])
        if abs(m - n) <= e and far[m - n + e] >= n:
            return True
    return False
