import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from credsweep.llm import sharding

from .conftest import make_docs, prose


def check(rows, docs):
    """docs: (doc_id, text); every row once, slots without gaps; returns bytes by shard."""
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs)
    slots, total = defaultdict(list), defaultdict(int)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        total[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return total


def test_tricky(spark, tricky, tricky_rows, empty):
    check(sharding.kd_shards(tricky, 7).collect(), [(i, t) for i, t, _ in tricky_rows])
    assert sharding.kd_shards(empty, 40).count() == 0


def test_bytes_nearly_equal_with_a_hot_source(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(1, 60)), "hot" if i % 3 == 0 else f"s{i % 5}") for i in range(3000)]
    docs = make_docs(spark, rows)
    total = check(sharding.kd_shards(docs, 40).collect(), [(i, t) for i, t, _ in rows])
    mean, largest = sum(total.values()) / 40, max(len(t) for _, t, _ in rows) + 16
    assert len(total) == 40 and all(abs(x - mean) <= 2 * largest for x in total.values())


def test_equal_rows_and_target_bytes(spark):
    docs = make_docs(spark, [(i, "same text", "s") for i in range(400)])
    total = check(sharding.kd_shards(docs, shards=None, target_bytes=1000).collect(), [(i, "same text") for i in range(400)])
    assert len(total) == 10 and max(total.values()) - min(total.values()) <= 3 * 25


def test_reruns_agree(spark, tricky):
    run = lambda d: sorted(map(str, sharding.kd_shards(d, 5).where(F.col("doc_id") < 100).select("doc_id", "shard").collect()))
    assert run(tricky) == run(tricky.repartition(6))


def test_more_shards_than_rows(spark):
    docs = make_docs(spark, [(1, "a", "s"), (2, None, None)])
    check(sharding.kd_shards(docs, 40).collect(), [(1, "a"), (2, None)])


def test_rows_that_repeat_id_and_text_can_be_parted(spark):
    rows = [(7, "the same text again", "s")] * 600 + [(i, prose(random.Random(i), 8), "s") for i in range(1000, 1600)] + [(None, "no id", None)] * 300
    total = check(sharding.kd_shards(make_docs(spark, rows), 10).collect(), [(i, t) for i, t, _ in rows])
    mean = sum(total.values()) / 10
    assert len(total) == 10 and all(abs(x - mean) <= 0.12 * mean for x in total.values())
