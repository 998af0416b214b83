import random
from collections import defaultdict

import numpy as np
import pytest

from loamdex.llm import jaccard
from loamdex.llm.components import components

from .util import AWKWARD, docs


def shingles(text):
    w = (text or "").encode().translate(jaccard._LOWER).split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(rows):
    """(doc_id, n_shingles, component_id) of every row, by comparing whatever shares a shingle."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    seen = set()
    for group in holders.values():
        for k, i in enumerate(group):
            for j in group[:k]:
                if (j, i) not in seen:
                    seen.add((j, i))
                    both = len(sets[i] & sets[j])
                    if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                        parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, families=30, copies=14):
    """Families of edited copies around the threshold, a passage in many unrelated texts, short texts and exact copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    passage, rows = [word() for _ in range(60)], []
    for f in range(families):
        base = [word() for _ in range(rng.choice((3, 6, 9, 14, 25, 60, 150, 400)))]
        if f % 3 == 0:
            base += passage
        for c in range(copies if f else 10 * copies):
            text = list(base)
            for _ in range(int(len(text) * rng.choice((0, 0.01, 0.02, 0.03, 0.035, 0.05)) + rng.choice((0, 0, 1)))):
                text[rng.randrange(len(text))] = word()
            if rng.random() < 0.2:
                text = text[: rng.randint(1, len(text))]
            rows.append((len(rows), " ".join(text).title() if c % 5 == 4 else " ".join(text)))
    for _ in range(120):
        rows.append((len(rows), " ".join([*(word() for _ in range(rng.randint(0, 40))), *passage, *(word() for _ in range(rng.randint(0, 40)))])))
    return rows


@pytest.mark.parametrize("seed, short", [(1, 6), (2, 2)])
def test_against_brute_force(spark, seed, short):
    rows = corpus(seed)
    got = sorted(map(tuple, jaccard.similar(docs(spark, rows), short=short).collect()), key=str)
    assert got == brute(rows)
    assert len({c for *_, c in got}) < len(rows) - 200


def test_awkward_rows(spark):
    rows = [*AWKWARD, (70, "One  TWO\nthree"), (None, "long words " * 9000), (71, "lONG words " * 9000)]
    got = sorted(map(tuple, jaccard.similar(docs(spark, rows)).collect()), key=str)
    assert got == brute(rows)
    assert jaccard.similar(docs(spark, rows).limit(0)).count() == 0


def test_batches_of_few_words():
    for k in (1, 2, 3, 5, 7):
        for texts in ([], [b""], [None, b"a"], [b"a b"], [b"a b c"], [b"a", b"b c"], [b"a b c d"], [b"a b", None, b"c d e"], [b"a b c d e"], [b"a b c d e f"]):
            for found, text in zip(jaccard.Shingler(k).sets(texts), texts, strict=True):
                n = len((text or b"").split())
                assert len(found) == (max(1, n - k + 1) if n else 0)


@pytest.mark.parametrize("rows", [[(1, "one two three"), (2, None)], [(1, "one")], [(3, None)], [(2, "a b"), (1, "A B"), (4, "c d e")]])
def test_tiny_tables(spark, rows):
    assert sorted(map(tuple, jaccard.similar(docs(spark, rows)).collect()), key=str) == brute(rows)


def test_ids_that_are_no_integers(spark):
    rows = [("b", "one two three four five six"), ("a", "One two three four five six"), (None, "one two three four five six"), ("c", ""), (None, None), ("d", "something else altogether it is")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert sorted(map(tuple, jaccard.similar(df).collect()), key=str) == brute(rows)


def test_allocations_never_lose_a_link():
    """Random linked pairs of sets: the larger one's probes meet an index entry of the smaller, even after it left out what it has to spare."""
    rng, bands = np.random.default_rng(5), jaccard.Bands()
    for _ in range(400):
        n = int(rng.choice([1, 2, 3, 4, 5, 7, 8, 10, 13, 20, 33, 60, 150, 700]))
        x = np.unique(jaccard.mix(rng.integers(0, 2**63, n, np.uint64)))
        drop = int(rng.integers(0, n // 4 + 1))
        y = rng.permutation(x)[drop:]
        extra = max(0, (4 * len(y) // 3 - n) if rng.random() < 0.7 else 0)
        y = np.unique(np.concatenate((y, jaccard.mix(rng.integers(0, 2**63, int(rng.integers(0, extra + 1)), np.uint64)))))
        if 4 * len(np.intersect1d(x, y)) < 3 * len(np.union1d(x, y)):
            continue
        large, small = (x, y) if len(x) >= len(y) else (y, x)
        sig, who, flag, own, below = jaccard.signatures([large, small], bands)
        index = set(sig[(who == 1) & (flag == 0)].tolist())
        same = bands.of(np.array([len(large)])) == bands.of(np.array([len(small)]))
        probes = sig[(who == 0) & (flag == (0 if same[0] else 1))].tolist()
        met = len(set(probes) & index)
        spare = (own if same[0] else below)[0]
        assert spare >= 0 and met > spare


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)] + [(5, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        return i if parent[i] == i else find(parent[i])

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert got == {i: find(i) for i in parent if any(i in e and e[0] != e[1] for e in edges)}
