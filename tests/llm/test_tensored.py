import random

import numpy as np
import pytest

from credsweep.llm import linking, tensored

from .conftest import make_docs, prose
from .test_ngram_join import brute, edited


def compare(spark, rows, **kw):
    key = lambda r: tuple((x is None, x) for x in r)
    out = tensored.near_duplicates(make_docs(spark, rows).repartition(4), **kw).collect()
    expected = brute(rows, 85)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=key) == sorted(expected, key=key)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def groups(rng):
    rows = [(i, prose(rng, rng.randint(5, 120)), "s") for i in range(150)]
    for k, n in enumerate((12, 40, 80, 200, 400)):
        seed = prose(rng, n)
        rows += [(1000 + 200 * k + j, edited(rng, seed, rng.randint(0, max(1, n // 22))), "s") for j in range(60)]
    passage = prose(rng, 60)
    rows += [(5000 + i, passage + " " + prose(rng, rng.randint(1, 30)), "s") for i in range(150)]
    rng.shuffle(rows)
    return rows


def test_tricky(spark, tricky_rows):
    compare(spark, tricky_rows)


def test_groups_of_near_copies(spark):
    compare(spark, groups(random.Random(3)))


@pytest.mark.parametrize(("block", "limit", "blocks"), [(16, 1 << 20, 32), (16, 1 << 20, 1), (40, 900, 3)])
def test_clusters_too_large_for_a_place(spark, monkeypatch, block, limit, blocks):
    monkeypatch.setattr(linking, "MOST_BLOCKS", blocks)
    monkeypatch.setattr(linking, "BLOCK", block)
    monkeypatch.setattr(linking, "LIMIT", limit)
    monkeypatch.setattr(linking, "KEYS", 1000)
    compare(spark, groups(random.Random(4)))


def test_small_batches_of_keys(spark, monkeypatch):
    monkeypatch.setattr(linking, "KEYS", 500)
    compare(spark, groups(random.Random(5)))


def test_empty(spark, empty):
    assert tensored.near_duplicates(empty).count() == 0


def pair(rng, n, common):
    """Two sets with ``common`` of n shingles each shared."""
    x = rng.integers(0, 1 << 63, 2 * n - common, dtype=np.uint64) * np.uint64(2)
    return np.unique(x[:n]), np.unique(np.concatenate([x[:common], x[n:]]))


@pytest.mark.parametrize(("n", "common"), [(37, 34), (370, 340), (1110, 1020)])
def test_pairs_at_the_bound_share_a_key(n, common):
    """0.85 is met for certain, but for about 2 in 100,000."""
    rng, bands = np.random.default_rng(n), tensored.TensoredBands()
    for _ in range(600):
        a, b = pair(rng, n, common)
        assert set(bands.keys(a).tolist()) & set(bands.keys(b).tolist())


def test_collision_rates_follow_the_formula():
    rng, bands = np.random.default_rng(1), tensored.TensoredBands()
    for common, n in ((10, 40), (20, 40), (30, 40)):
        s = common / (2 * n - common)
        pairs = [pair(rng, n, common) for _ in range(1500)]
        met = np.mean([bool(set(bands.keys(a).tolist()) & set(bands.keys(b).tolist())) for a, b in pairs])
        equal = np.mean([(bands.minhashes(a) == bands.minhashes(b)).mean() for a, b in pairs])
        assert abs(equal - s) < 0.01
        assert abs(met - (1 - (1 - s ** tensored.A) ** tensored.M) ** 2) < 0.05


def test_places_link_as_all_pairs_would():
    rng, like = np.random.default_rng(5), linking.Likeness(85)
    for _ in range(40):
        base = rng.integers(0, 1 << 63, int(rng.integers(4, 60)), dtype=np.uint64)
        sets = [np.unique(np.concatenate([base[rng.random(len(base)) < 0.97], rng.integers(0, 1 << 63, int(rng.integers(1, 3)), dtype=np.uint64)])) for _ in range(40)]
        cls = rng.permutation(40)
        found = linking.place_links(cls, np.arange(40), np.zeros(40, int), sets, like, None)
        parent = {int(c): int(c) for c in cls}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in found:
            assert find(a) != find(b)  # no link too many
            parent[find(a)] = find(b)
        for i in range(40):
            for j in range(i):
                k = len(np.intersect1d(sets[i], sets[j]))
                if 100 * k >= 85 * (len(sets[i]) + len(sets[j]) - k):
                    assert find(int(cls[i])) == find(int(cls[j]))


def test_links_grow_with_a_group_not_its_square(spark, monkeypatch):
    """A group of near copies most of whose pairs lie just under 0.8: rows between stages follow the group's size."""
    from credsweep.llm import ngram_join
    from credsweep.llm.common import written

    seen = []
    monkeypatch.setattr(linking, "written", lambda df, what: seen.append((what, (out := written(df, what)).count())) or out)
    rows = {}
    for copies in (200, 800):
        rng = random.Random(8)
        seed = prose(rng, 120)
        docs = make_docs(spark, [(i, edited(rng, seed, 2), "s") for i in range(copies)])
        for kind in (ngram_join.classes, tensored.near_duplicates):
            seen.clear()
            assert kind(docs).select("component").distinct().count() < copies
            rows[kind, copies] = sum(n for _, n in seen)
    for kind in (ngram_join.classes, tensored.near_duplicates):
        assert rows[kind, 800] <= 6 * rows[kind, 200], rows


def test_sql_of_both_operators(spark, tmp_path):
    import duckdb

    from credsweep.llm import ngram_join, queries

    rng = random.Random(11)
    rows = groups(rng)[:260] + [(9000, None, "s"), (9001, "", "s"), (9002, "a b c", "s"), (9003, "A  b\tc", "s")]
    make_docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for key, run in (("op3_ngram_join", ngram_join.op3), ("op11_minhash", tensored.op11)):
        out = run(spark, str(tmp_path))
        expected = con.sql(f"SELECT {', '.join(out.columns)} FROM ({queries.oracle_sql()[key]})").fetchall()
        assert sorted(map(tuple, out.collect())) == sorted(expected) and len({r[2] for r in expected}) < len(rows)
