"""N-gram Jaccard join, line dedup, components and the pipeline against plain versions."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from larkspur.llm import line_dedup, near_join, shingles, simhash
from larkspur.llm.components import components
from larkspur.llm.exact_dedup import exact_dedup
from tests.conftest import DATA


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def plain_sets(rows):
    out = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        out[i] = frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])
    return out


def plain_classes(rows, threshold=0.8):
    sets, shared, by = plain_sets(rows), Counter(), defaultdict(list)
    for i, s in sets.items():
        for g in s:
            by[g].append(i)
    for ids in by.values():
        shared.update((a, b) for n, b in enumerate(ids) for a in ids[:n])
    group, links = Union(), Counter()
    for (a, b), n in shared.items():
        if n >= threshold * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
            group.join(a, b)
    return {i: (group.find(i), links[i]) for i in sets}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_near_join_on_documents(spark, sf):
    docs = spark.read.parquet(f"{DATA}/{sf}/documents.parquet")
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_join.similar_classes(docs).collect()}
    assert got == plain_classes([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def near_copies(n, words=60, changes=3, seed=0):
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in rng.integers(0, 1000, words)]
    rows = []
    for i in range(n):
        text = list(base)
        for at in rng.integers(0, words, rng.integers(0, changes + 1)):
            text[at] = f"x{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize("held", [32 << 20, 8000])  # with few bytes the candidates of a leaf are verified in parts
def test_near_join_large_group_in_blocks(spark, monkeypatch, held):
    monkeypatch.setattr(near_join, "LEAF", 16)
    monkeypatch.setattr(near_join, "BLOCK", 20)
    monkeypatch.setattr(near_join, "VERIFY_BYTES", held)
    rows = near_copies(150) + [(1000 + i, t) for i, t in near_copies(40, seed=1)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_join.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = plain_classes(rows)
    assert {i: c for i, (c, _) in got.items()} == {i: c for i, (c, _) in want.items()}
    assert got == want


def test_near_join_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (4, ""), (5, " \n "), (6, "a b"), (7, "a\tb"), (8, "b a"), (9, long), (10, long + " end"), (None, "a b c d e f g")]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, key string, n int")
    got = [(r.doc_id, r.class_id, r.n_links) for r in near_join.similar_classes(df).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, 3), (2, 1, 3), (2, 1, 3), (None, 1, 3), (3, 3, 0), (4, 4, 0), (5, 5, 0), (6, 6, 1), (7, 6, 1), (8, 8, 0), (9, 9, 1), (10, 9, 1)], key=str)
    kept = near_join.one_of_each(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5, 6, 8, 9]
    other = spark.createDataFrame([(1, "a b c d e f g", 5), (2, "a b c d e f g", 5), (2, "quite another text of two", 5), (None, "a b c d e f g", 5), (None, "one more that is alone here", 5), (None, None, 5)], "doc_id long, text string, gone int")
    stay = near_join.one_of_each(other)
    assert stay.columns == other.columns and sorted(map(tuple, stay.collect()), key=str) == sorted([(1, "a b c d e f g", 5), (2, "quite another text of two", 5), (None, "one more that is alone here", 5), (None, None, 5)], key=str)
    assert near_join.similar_classes(df.limit(0)).count() == 0 and near_join.one_of_each(df.limit(0)).count() == 0


def test_shingles_do_not_depend_on_neighbours(monkeypatch):
    texts = ["one two three four five six".encode(), b"", b"a", "é ü one two three four five".encode(), b" x  y\n z t u v "] * 3
    want = [shingles.shingle_sets([t])[0].tolist() for t in texts]
    assert [s.tolist() for s in shingles.shingle_sets(texts)] == want
    assert [len(w) for w in want[:5]] == [2, 0, 1, 3, 2]
    monkeypatch.setattr(shingles, "CHUNK", 16)
    assert [s.tolist() for s in shingles.shingle_sets(texts)] == want


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(300)] + [(5, 5), (2000, 2001), (2000, 2001)]
    plain = Union()
    for a, b in edges:
        if a != b:
            plain.join(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: plain.find(x) for x in plain.up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# lines


def plain_distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def plain_lines(rows):
    """The lines (id, place, words) of documents (id, text) with words, in order."""
    return [(i, at, tuple(line.lower().split())) for i, text in sorted(rows) for at, line in enumerate((text or "").split("\n")) if line.split()]


def similar_lines(lines):
    """All pairs of different lines (tuples of words) of MIN_WORDS words or more at a word edit similarity of 0.8: what they share is a prefix of their rarest words."""
    often = Counter(w for words in lines for w in set(words))
    by, out = defaultdict(set), []
    for n, words in sorted(enumerate(lines), key=lambda x: len(x[1])):
        if len(words) < line_dedup.MIN_WORDS:
            continue
        most = int(0.2 * len(words) + 1e-9)
        rare = set(sorted(words, key=lambda w: (often[w], w))[: most + 1])
        for m in set().union(*(by[w] for w in rare)):
            if len(words) - len(lines[m]) <= most and sum((Counter(words) & Counter(lines[m])).values()) >= len(words) - most and plain_distance(words, lines[m]) <= most:
                out.append((m, n))
        for w in rare:
            by[w].add(n)
    return out


def expected_drops(rows):
    """Places that go: of equal lines, and of all groups of similar lines; and those groups' pairs."""
    seen = plain_lines(rows)
    first = {}
    for i, at, words in seen:
        first.setdefault(words, (i, at))
    lines = list(first)
    pairs, group = similar_lines(lines), Union()
    for m, n in pairs:
        group.join(m, n)
    number, keep = {w: n for n, w in enumerate(lines)}, {}
    for i, at, words in seen:
        keep.setdefault(group.find(number[words]), (i, at))
    exact = {(i, at) for i, at, words in seen if first[words] != (i, at)}
    fuzzy = {(i, at) for i, at, words in seen if keep[group.find(number[words])] != (i, at)}
    return exact, fuzzy


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_lines_on_documents(spark, sf):
    """Against brute force, both ways: all equal lines go, no line goes that is not in a group with one that stays, and 0.9 of the fuzzy repeats go."""
    docs = spark.read.parquet(f"{DATA}/{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in line_dedup.line_report(docs).collect()}
    assert {i: r.n_lines for i, r in got.items()} == {i: len((text or "").split("\n")) for i, text in rows}
    assert all(r.n_dropped == len(r.dropped) for r in got.values())
    exact, fuzzy = expected_drops(rows)
    dropped = {(i, at) for i, r in got.items() for at in r.dropped}
    assert exact <= dropped <= fuzzy
    assert len(dropped - exact) >= 0.9 * len(fuzzy - exact) > 5


def changed_lines(n, words, changes, seed):
    """n lines of some words of which changes are replaced, added or left out."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in rng.integers(0, 3000, words)]
    out = []
    for _ in range(n):
        line = list(base)
        for _ in range(changes):
            at, kind = rng.integers(0, len(line)), rng.integers(0, 3)
            line[at : at + (kind != 1)] = [] if kind == 2 else [f"x{rng.integers(0, 10**6)}"]
        out.append(" ".join(line))
    return out


@pytest.mark.parametrize("hot", [None, 40])
def test_lines_of_a_large_group(spark, monkeypatch, hot):
    """One group of a thousand near copies among other lines, also where its buckets are dealt out in blocks."""
    if hot:
        monkeypatch.setattr(line_dedup, "HOT", hot)
        monkeypatch.setattr(line_dedup, "SAMPLE", 1)
        monkeypatch.setattr(line_dedup, "BLOB", 16)
    lines = changed_lines(1000, 60, 3, 1) + [x for seed in range(2, 40) for x in changed_lines(5, 25, 2, seed)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    stay = [r.doc_id for r in line_dedup.line_report(df).where("n_dropped = 0").collect()]
    assert 0 in stay and len([i for i in stay if i < 1000]) <= 10 and 38 <= len(stay) <= 60


def test_lines_of_a_template_are_not_joined(spark):
    """Lines that share three quarters of their words meet and are refused, all of them."""
    rng = np.random.default_rng(7)
    lines = [" ".join([*(f"t{i}" for i in range(15)), *(f"y{x}" for x in rng.integers(0, 10**9, 5))]) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert line_dedup.line_report(df).where("n_dropped > 0").count() == 0


def test_repeats_among_lines_of_a_template(spark):
    """Every second line is another one with a word changed. All share most of their words and meet, so that the leaders of the runs are near both lines of a pair, but similar to neither."""
    rng = np.random.default_rng(7)
    lines = []
    for _ in range(300):
        own = [f"y{x}" for x in rng.integers(0, 10**9, 5)]
        lines += [" ".join([*(f"t{i}" for i in range(15)), *own]), " ".join([*(f"t{i}" for i in range(14)), f"z{rng.integers(0, 10**9)}", *own])]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    gone = {r.doc_id for r in line_dedup.line_report(df).where("n_dropped > 0").collect()}
    assert gone == set(range(1, 600, 2))


@pytest.mark.parametrize("most, middle", [(4, 1), (1 << 20, 1), (1 << 20, 32)])
def test_later_pairs_complete_the_first(monkeypatch, most, middle):
    """Pairs with leaders and those across groups are all near pairs that share a block, if every line is a group; with larger groups no pair of two groups is missing."""
    monkeypatch.setattr(simhash, "PAIRS", most)
    monkeypatch.setattr(simhash, "MIDDLE", middle)
    rng = np.random.default_rng(5)
    n = 600
    a, b = (rng.integers(0, 2**63, 20, dtype=np.uint64)[rng.integers(0, 20, n)] for _ in range(2))
    b[200:] = a[200:] * np.uint64(3)
    for x in (a, b):
        for _ in range(8):
            x ^= np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)
    h, plan = rng.integers(-(2**63), 2**63, n), simhash.Plan.of(n)
    e = np.concatenate(list(simhash.entries(h, a, b, plan)))
    pairs, at, bits = simhash.part_search(e, plan)
    named = lambda e, pairs: {frozenset(p) for p in e["h"][pairs].tolist()}
    first = named(e, pairs)
    monkeypatch.setattr(simhash, "RUN", n)
    every = named(e, simhash.part_search(e, plan)[0])
    assert len(every) > len(first) > n
    for group in (lambda x: x, lambda x: x % 7):
        found = [named(e[at], p) for p in simhash.pairs_across(e[at], bits, group(e["h"][at]), plan)]
        apart = {p for p in every if len({group(x) for x in p}) > 1}
        assert {p for p in set().union(*found, first) if p in apart} == apart and set().union(*found) <= apart


def test_bags_refuse_no_similar_pair():
    rng = np.random.default_rng(13)
    refused = 0
    for _ in range(400):
        x = rng.integers(0, 1 << 20, rng.integers(5, 40))
        y = np.where(rng.random(len(x)) < rng.choice([0.1, 0.2, 0.5]), rng.integers(0, 1 << 20, len(x)), x)[rng.integers(0, 3) :]
        codes = [z.astype(">u4").tobytes() for z in (x, y)]
        bags, longer = line_dedup.bags([*codes, None]), max(len(x), len(y))
        assert bags[0].sum() == len(x) and (bags[2] == -1).all()
        n, m = np.array([len(x)] * 2), np.array([len(y)] * 2)
        may = line_dedup.may_be_similar(n, m, bags[[0, 0]], bags[[1, 2]])
        assert may[0] or plain_distance(x.tolist(), y.tolist()) > int(0.2 * longer + 1e-9)
        assert may[1] or abs(len(x) - len(y)) > int(0.2 * longer + 1e-9)
        refused += not may[0]
    assert refused > 100


def majority(words):
    """The SimHash over different words, bit by bit."""
    hashes = {int(x) >> 24 for x in shingles.word_hashes(" ".join(words).encode())[0]}
    halves, x = [], list(hashes)
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        x = [int(shingles.mixed(np.array([(h * salt + (salt >> 7)) % 2**64], np.uint64))[0]) for h in x]
        halves.append(sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in x) > len(x)))
    return halves


def test_sim_hash_is_the_majority():
    texts = ["alpha beta gamma delta epsilon", "the quick brown jumps over lazy dogs again dogs", "word " * 300 + "other words here at last", " ".join(f"w{i * i % 997}" for i in range(3000)), "under five"]
    got = simhash.lines_of([t.encode() for t in texts])
    assert got["n"].tolist() == [len(t.split()) for t in texts]
    for i, t in enumerate(texts[:4]):
        assert [int(got[c][i]) % 2**64 for c in ("a", "b")] == majority(t.split())
    assert got["b"][4] == 0 and len(set(got["h"].tolist())) == 5


def test_lines_are_signed_alike_wherever_they_stand(monkeypatch):
    texts = [b"one two three four five six\n\n x  y\tz\r\n", b"", b"one two\nthree four five six seven eight", "é ü ß eins zwei drei".encode()]
    one = [simhash.lines_of([t]) for t in texts]
    every = simhash.lines_of(texts)
    assert every["text"].tolist() == [0, 0, 0, 0, 1, 2, 2, 3] and every["at"].tolist() == [0, 1, 2, 3, 0, 0, 1, 0]
    monkeypatch.setattr(simhash, "SLICE", 3)
    small = simhash.lines_of(texts)
    for c in ("n", "h", "a", "b"):
        assert every[c].tolist() == small[c].tolist() == [int(x) for o in one for x in o[c]]


def test_lines_are_signed_alike_in_steps(monkeypatch):
    """Texts taken a few bytes at a time give the same; with a table of bits the lines that have one are signed as ever."""
    texts = ["\n".join(" ".join(f"w{(i * j) % 23}" for j in range(i % 9 + 1)) for i in range(k, k + 5)).encode() for k in range(60)] + [b"", b"\n", b"w1 " * 400]
    every = simhash.lines_of(texts)
    for step in (1, 100, 1000):
        monkeypatch.setattr(simhash, "STEP", step)
        assert all((every[c] == got).all() for c, got in simhash.lines_of(texts).items())
    table = np.zeros(1 << 10, np.uint64)
    h = every["h"].view(np.uint64)
    for x in np.unique(h)[::7].tolist():
        table[(x >> 6) % len(table)] |= np.uint64(1 << x % 64)
    there, some = simhash.has_bit(table, h), simhash.lines_of(texts, table)
    assert np.isin(np.unique(h)[::7], h[there]).all() and 0 < there.sum() < len(h)
    assert all((every[c][there] == some[c][there]).all() for c in ("a", "b")) and (every["h"] == some["h"]).all()


def test_only_lines_asked_for_are_spelled(spark):
    lines = [f"line number {i} has some words" for i in range(50)]
    df = spark.createDataFrame([("\n".join(lines),), (None,)], "text string")
    h = simhash.lines_of([x.encode() for x in lines])["h"].tolist()
    table = line_dedup.bit_table(spark.createDataFrame([(x,) for x in h[::10]], "h long"))
    got = line_dedup.spelled(df, table).collect()
    assert {r.h for r in got} == set(h[::10]) and all(len(r.code) == 4 * 6 for r in got)


@pytest.mark.parametrize("group, small", [(1, 0), (64, 1), (1 << 15, 3), (1 << 15, 40)])
def test_search_finds_the_same_in_groups_of_any_size(monkeypatch, group, small):
    """All near pairs of the short runs of each block, told one by one, and with each that its run's first line is near to."""
    rng = np.random.default_rng(17)
    n, plan = 3000, simhash.Plan(8, 10)
    a, b = (rng.integers(0, 2**63, 300, dtype=np.uint64)[np.minimum(rng.geometric(0.01, n), 299)] for _ in range(2))
    a ^= np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)
    b = a * np.uint64(5) ^ np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)
    e = np.concatenate([x[: n >> (k % 4)] for k, x in enumerate(simhash.entries(rng.integers(-(2**63), 2**63, n), a, b, plan))])
    monkeypatch.setattr(simhash, "GROUP", group)
    monkeypatch.setattr(simhash, "SMALL", small)
    pairs, at, bits = simhash.part_search(e, plan)
    cells, where, counts = np.unique(e["cell"], return_inverse=True, return_counts=True)
    own = np.maximum(np.ceil(np.log2(counts)).astype(int) - 1, 0)
    met = set()
    for cell in range(len(cells)):
        rows = np.flatnonzero(where == cell)
        rows = rows[np.argsort(e["h"][rows])].tolist()
        rounds = simhash.tables_for(own[cell])
        for table in range(rounds):
            shift, block = int(table * ((120 - int(own[cell])) / max(rounds - 1, 1))), defaultdict(list)
            for r in rows:
                block[((int(e["b"][r]) << 64 | int(e["a"][r])) >> shift) % (1 << int(own[cell]))].append(r)
            near = lambda i, j: (int(e["a"][i]) ^ int(e["a"][j])).bit_count() + (int(e["b"][i]) ^ int(e["b"][j])).bit_count() <= simhash.NEAR
            for run in block.values():
                met |= {(i, j) for k, i in enumerate(run[: len(run) if len(run) <= simhash.RUN else 1]) for j in run[k + 1 :] if near(i, j)}
    found = set(map(tuple, pairs.tolist()))
    assert met <= found and len(met) > n and (bits == own[where[at]]).all()


def test_near_sim_hashes_share_a_block():
    """All pairs with fewer differing bits than blocks meet; of those with RADIUS bits RECALL on each level do."""
    rng = np.random.default_rng(3)
    n = 4000
    a, b = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)
    plan = simhash.Plan.of(2 * n)
    for bits, least in ((plan.tables - 1, 1.0), (simhash.RADIUS, 0.95)):
        c, d = a.copy(), b.copy()
        for i in range(n):
            for bit in rng.choice(128, bits, replace=False):
                (c if bit < 64 else d)[i] ^= np.uint64(1) << np.uint64(bit % 64)
        h = np.arange(2 * n)
        e = np.concatenate(list(simhash.entries(h, np.concatenate([a, c]), np.concatenate([b, d]), plan)))
        assert (simhash.unturned(e, plan).view(np.uint64) == np.tile(np.concatenate([a, c]), plan.tables)).all()
        pairs = simhash.part_pairs(e, plan)
        met = {frozenset((int(e["h"][i]), int(e["h"][j]))) for i, j in pairs}
        assert sum(frozenset((i, n + i)) in met for i in range(n)) >= least * n
        assert len(met) <= 1.01 * n


def test_edit_distance_of_long_lines():
    rng = np.random.default_rng(11)
    for _ in range(300):
        x, y = rng.integers(0, 4, rng.integers(0, 14)), rng.integers(0, 4, rng.integers(0, 14))
        d = plain_distance(x.tolist(), y.tolist())
        assert [simhash.within(x, y, k) for k in range(16)] == [k >= d for k in range(16)]
        sure = simhash.surely_within([x] * 16, [y] * 16, np.arange(16))
        assert (sure <= (np.arange(16) >= d)).all() and sure[max(len(x), len(y)) :].all()
        if len(x) == len(y):
            assert sure[(x != y).sum() :].all()


def test_lines_odd_rows(spark):
    long = " ".join(f"longest{i}" for i in range(200_000))
    rows = [(1, "Same  line\nb"), (2, "same\tLINE \n\n"), (3, None), (4, ""), (5, "w " * 40_000), (5, "w " * 40_000), (None, "b"), (6, "of it is\nof it at"), (7, "longest " * 40_000), (8, long), (9, f"first {long}"), (10, "ÄÖ ü é è ñ"), (11, "äö Ü É È Ñ")]
    df = spark.createDataFrame([(i, t, 1, "h", 7, 8) for i, t in rows], "doc_id long, text string, at int, h string, row int, __row int")
    got = sorted(((r.doc_id, r.n_lines, r.dropped) for r in line_dedup.line_report(df).collect()), key=str)
    assert got == sorted([(None, 1, []), (1, 2, [1]), (2, 3, [0]), (3, 1, []), (4, 1, []), (5, 1, []), (5, 1, [0]), (6, 2, []), (7, 1, []), (8, 1, []), (9, 1, [0]), (10, 1, []), (11, 1, [0])], key=str)
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns
    assert {(r.doc_id, r.text, r.at, r.h, r.row, r["__row"]) for r in out.where("doc_id < 5").collect()} == {(i, t, 1, "h", 7, 8) for i, t in ((1, "Same  line"), (2, "\n"), (3, None), (4, ""))}
    assert line_dedup.line_report(df.limit(0)).count() == 0 and line_dedup.dedup_lines(df.limit(0)).count() == 0


# pipeline


def test_pipeline(spark):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, seen, sf)
        assert out.columns == docs.columns, name
        before, after = {r.doc_id: r.text for r in seen.collect()}, [(r.doc_id, r.text) for r in out.collect()]
        if name == "language_id":
            assert {i for i, _ in after} == {i for i, t in before.items() if any(c.isalpha() for c in t or "")}
        if name == "exact_dedup":
            last = {t: i for i, t in sorted(before.items())}
            assert sorted(i for i, _ in after) == sorted(last.values())
        if name == "near_dedup":
            want = plain_classes(list(before.items()))
            assert sorted(i for i, _ in after) == sorted(i for i, (c, _) in want.items() if i == c)
        seen = spark.createDataFrame(out.collect(), docs.schema)
    final = corpus_pipeline.STAGES[4][1](spark, seen, sf)
    assert final.count() == seen.count() and final.where("n_pieces <> size(pieces)").count() == 0
    ran = corpus_pipeline.run(spark, sf)
    assert sorted((r.doc_id, r.n_pieces) for r in ran.collect()) == sorted((r.doc_id, r.n_pieces) for r in final.collect())


def test_stages_take_empty_tables(spark):
    import corpus_pipeline

    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
    assert exact_dedup(docs).count() == 0
