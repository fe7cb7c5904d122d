"""What else the pair join must keep: points never bound too low, and alike sets share a key."""
import numpy as np
import pytest

from credsweep.llm import ngram_join as nj


def test_points_never_bound_too_low():
    rng = np.random.default_rng(2)
    like = nj.Likeness(80)
    for _ in range(60):
        sets = []
        for _ in range(int(rng.integers(2, 20))):
            shared = rng.integers(0, 1 << 63, int(rng.integers(1, 600)), dtype=np.uint64)
            sets += [np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, int(rng.integers(0, len(shared) // 3 + 2)), dtype=np.uint64)])) for _ in range(3)]
        sets.sort(key=len)
        n = np.array([len(s) for s in sets])
        near = nj.tree_bound(like)(n, np.concatenate(sets), np.repeat(np.arange(len(n)), n))
        for i, a in enumerate(sets):
            rows = set(near(i).tolist())
            for j in range(i + 1, len(sets)):
                common = len(np.intersect1d(a, sets[j]))
                if 100 * common >= 80 * (n[i] + n[j] - common):
                    assert j in rows


def test_prefixes_meet_for_every_alike_pair():
    rng = np.random.default_rng(3)
    like = nj.Likeness(80)
    for _ in range(500):
        n = int(rng.integers(1, 200))
        shared = rng.permutation(100_000)[:n]
        a = np.sort(np.concatenate([shared, 100_000 + rng.permutation(1000)[:rng.integers(0, n // 5 + 2)]]))
        b = np.sort(np.concatenate([shared, 200_000 + rng.permutation(1000)[:rng.integers(0, n // 5 + 2)]]))
        if 100 * n >= 80 * (len(a) + len(b) - n):
            small, large = (a, b) if len(a) <= len(b) else (b, a)
            order = {int(x): k for k, x in enumerate(rng.permutation(np.unique(np.concatenate([a, b]))))}
            small, large = (sorted((int(x) for x in s), key=order.get) for s in (small, large))
            assert set(small[:like.index_prefix(len(small))]) & set(large[:like.prefix(len(large))])


def test_joins_of_places_hold_every_alike_pair():
    rng = np.random.default_rng(6)
    like = nj.Likeness(80)
    for _ in range(20):
        sets = []
        for _ in range(12):
            base = rng.integers(0, 1 << 63, int(rng.integers(1, 900)), dtype=np.uint64)
            sets += [np.unique(np.concatenate([base[rng.random(len(base)) < 0.95], rng.integers(0, 1 << 63, int(rng.integers(1, len(base) // 12 + 2)), dtype=np.uint64)])) for _ in range(4)]
        vectors = [nj.vector(nj.packed_vector(s)) for s in sets]
        assert [int(v.sum()) for v in vectors] == list(map(len, sets))
        for side in (np.zeros(len(sets), int), np.arange(len(sets)) % 2):
            parent = list(range(len(sets)))

            def find(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            for a, b in nj.place_joins(np.arange(len(sets)), side, vectors, like):
                assert find(a) != find(b)
                parent[find(a)] = find(b)
            for i in range(len(sets)):
                for j in range(i):
                    common = len(np.intersect1d(sets[i], sets[j]))
                    if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common) and (not side.any() or side[i] != side[j]):
                        assert nj.may_be_alike(vectors[i], vectors[j], like) and find(i) == find(j)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_shared_keys_across_batches(spark, size):
    rows = [(k, c) for k in range(60) for c in range(k % 4) for _ in range(1 + c % 2)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
    sizes = {(k, c): 10 if k % 8 > 3 else 10 * 2 ** c for k, c in rows}
    df = spark.createDataFrame([(k, c, sizes[k, c]) for k, c in rows], "key long, cls long, n int").coalesce(1).sortWithinPartitions("key", "n", "cls")
    got = sorted(map(tuple, nj._shared(df, nj.Likeness(80)).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == sorted({r for r in rows if r[0] % 4 > 1 and r[0] % 8 > 3})


def test_leaves_join_every_alike_pair():
    rng = np.random.default_rng(9)
    like = nj.Likeness(80)
    run, sets = [], []
    for r in range(120):
        base = rng.integers(0, 1 << 63, int(rng.integers(1, 700)), dtype=np.uint64)
        for _ in range(int(rng.integers(2, nj.LEAF + 1))):
            run.append(r)
            sets.append(np.unique(np.concatenate([base[rng.random(len(base)) < 0.95], rng.integers(0, 1 << 63, int(rng.integers(1, len(base) // 12 + 2)), dtype=np.uint64)])))
    run, cls = np.array(run), rng.permutation(len(run))
    got = set(nj.leaf_joins(run, cls, [nj.packed_vector(s) for s in sets], like))
    for i in range(len(run)):
        for j in range(i):
            if run[i] == run[j]:
                pair = tuple(sorted((int(cls[i]), int(cls[j]))))
                common = len(np.intersect1d(sets[i], sets[j]))
                if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                    assert pair in got
                assert (pair in got) == (100 * min(len(sets[i]), len(sets[j])) >= 80 * max(len(sets[i]), len(sets[j])) and
                                         nj.may_be_alike(nj.vector(nj.packed_vector(sets[i])), nj.vector(nj.packed_vector(sets[j])), like))
