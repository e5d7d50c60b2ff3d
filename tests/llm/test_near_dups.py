import collections
import random

import numpy as np
import pytest
from llm_helpers import by_text, words

from heddle.llm import near_dups as N


def grams(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets, holders = [grams(t) for _, t in rows], collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    up, links = list(range(len(rows))), collections.Counter()

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(sets):
        for j, n in collections.Counter(j for g in s for j in holders[g] if j > i).items():
            if n * 10 >= 8 * (len(s) + len(sets[j]) - n):
                links[i] += 1
                links[j] += 1
                up[max(find(i), find(j))] = min(find(i), find(j))
    members = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        members[find(i)].append(d)
    return [(d, min((x for x in members[find(i)] if x is not None), default=None), links[i]) for i, (d, _) in enumerate(rows)]


def rows_of(spark, rows):
    return spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, one string")


def random_rows():
    random.seed(1)
    vocabulary, rows = [f"w{i}" for i in range(300)], []
    for _ in range(12):
        base = random.choices(vocabulary, k=random.choice([3, 6, 40, 200]))
        for _ in range(random.choice([1, 2, 5, 60])):
            x = list(base)
            for _ in range(random.choice([0, 0, 1, 2, 3])):
                x[random.randrange(len(x))] = random.choice(vocabulary)
            rows.append((len(rows), " ".join(x)))
    return [*rows, (None, rows[3][1]), (5000, None), (5001, ""), (5002, " -- "), rows[4], rows[4], (None, "abc def")]


@pytest.mark.parametrize("block", [7, 512])
def test_same_as_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK_CLASSES", block)
    rows = random_rows()
    got = [tuple(r) for r in N.joined(rows_of(spark, rows)).select("doc_id", "class_id", "n_links").collect()]
    assert by_text(got) == by_text(brute(rows))


def test_one_of_each_group_stays(spark):
    rows = random_rows()
    df = rows_of(spark, rows)
    kept = N.deduplicated(df)
    assert kept.columns == df.columns
    got = [r.doc_id for r in kept.collect()]
    named = [d for d in got if d is not None]
    assert len(named) == len(set(named))
    assert set(named) == {c for _, c, _ in brute(rows) if c is not None}
    assert got.count(None) == 1


def test_banding_meets_the_recall():
    bands, rows = N.banding()
    assert bands * rows <= N.MOST_HASHES
    assert 1 - (1 - N.THRESHOLD**rows) ** bands >= N.RECALL


def test_overlaps_are_exact():
    random.seed(3)
    sets = [np.unique(np.array(random.choices(range(9000), k=random.choice([1, 50, 4000])), np.uint64)) for _ in range(9)]
    got = N.overlaps(sets)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]


def test_components_of_chains_and_stars(spark):
    random.seed(2)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(200, 240)]
    pairs = [random.choice([(a, b), (b, a)]) for a, b in [*chain, *star, (5, 5)]]
    random.shuffle(pairs)
    got = {r.node: r.root for r in N.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {i: 100 for i in range(101, 161)} | {i: 7 for i in range(200, 240)}
