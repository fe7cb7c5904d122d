import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from credsweep.llm import components, linking, ngram_join, shingles

from .conftest import make_docs, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent=80):
    """Component of each row by comparing all that share a shingle."""
    sets = [shingle_set(t) for _, t, _ in rows]
    holders = defaultdict(list)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in holders[x])
        for j, k in shared.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                parent[find(i)] = find(j)
        for x in s:
            holders[x].append(i)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return [(rows[i][0], len(sets[i]), least[find(i)] if sets[i] else rows[i][0]) for i in range(len(rows))]


def compare(spark, rows, **kw):
    key = lambda r: tuple((x is None, x) for x in r)
    got = [tuple(r) for r in ngram_join.classes(make_docs(spark, rows).repartition(4), **kw).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = "changed" + str(rng.randrange(1000))
    return " ".join(w)


def test_tricky(spark, tricky_rows):
    compare(spark, tricky_rows)


def test_groups_of_near_copies(spark, monkeypatch):
    rng = random.Random(3)
    passage = prose(rng, 60)
    rows = [(i, prose(rng, rng.randint(5, 120)), "s") for i in range(150)]
    seeds = [prose(rng, n) for n in (12, 40, 80, 200, 400)]
    rows += [(1000 + 200 * k + j, edited(rng, s, rng.randint(0, max(1, len(s.split()) // 22))), "s") for k, s in enumerate(seeds) for j in range(60)]
    rows += [(5000 + i, passage + " " + prose(rng, rng.randint(1, 30)), "s") for i in range(150)]
    rng.shuffle(rows)
    compare(spark, rows)
    # small places: the same links when clusters are dealt over many
    monkeypatch.setattr(linking, "BLOCK", 16)
    monkeypatch.setattr(linking, "MOST_BLOCKS", 1)
    monkeypatch.setattr(ngram_join, "BLOCK", 20)
    monkeypatch.setattr(ngram_join, "ROWS", 50)
    compare(spark, rows)


def test_exactly_at_the_bound(spark):
    # 9 and 8 distinct shingles, 8 shared: 8 / 9; then 4 / 5 = 0.8 exactly; then 3 / 4, below
    a = [f"w{i}" for i in range(13)]
    rows = [(1, " ".join(a), "s"), (2, " ".join(a[:12]), "s"), (3, " ".join(["q"] + a[:8]), "s"), (4, " ".join(a[:8]), "s"), (5, " ".join(a[:7]), "s"), (6, "a b c", "s"), (7, "A  B\tC", "s")]
    compare(spark, rows)


def test_empty(spark, empty):
    assert ngram_join.classes(empty).count() == 0 and ngram_join.stage(spark, empty, "").count() == 0


def test_stage_keeps_one_of_each(spark, tricky, tricky_rows):
    out = ngram_join.stage(spark, tricky, "")
    assert out.columns == tricky.columns
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    expected = Counter(c for _, n, c in brute(tricky_rows) if n and c is not None)
    words = [k for k in kept if k[0] is not None and shingle_set(k[1])]
    assert sorted(i for i, _ in words if i != 3) == sorted(i for i in expected if i != 3)
    assert sum(i == 3 for i, _ in words) == 2  # two different texts have this id
    assert sum(1 for k in kept if not shingle_set(k[1])) == sum(1 for r in tricky_rows if not shingle_set(r[1]))


def test_shingles_of_chunked_texts(monkeypatch):
    rng = random.Random(1)
    texts = [prose(rng, rng.randint(0, 300)) for _ in range(20)] + ["é" * 70_000 + " a b c d e f", "", None, "  x  "]
    whole = [s.tolist() for s in shingles.shingle_sets(pa.array(texts), 5)]
    monkeypatch.setattr(shingles, "CHUNK", 100)
    assert [s.tolist() for s in shingles.shingle_sets(pa.array(texts).slice(0), 5)] == whole
    assert [s.tolist() for s in shingles.shingle_sets(pa.array(["z z"] + texts).slice(1), 5)] == whole
    assert [len(x) for x in whole] == [len(shingle_set(t)) for t in texts]


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 300])
def test_rtree_finds_all(n):
    rng = np.random.default_rng(n)
    points = rng.poisson(3, (n, 64)).astype(np.int64)
    if not n:
        return
    tree = ngram_join.RTree(points)
    for q in points[:20]:
        least = rng.integers(100, 180, n)
        expected = np.flatnonzero(np.minimum(points, q).sum(axis=1) >= least)
        assert sorted(tree.query(q, least, least.min())) == expected.tolist()


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(5, x) for x in range(200, 260)] + [(300, 300)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 5 for i in [5, *range(200, 260)]}
