import re
from collections import defaultdict

import pytest

from credsweep.llm import mixing

from .conftest import make_docs


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def water(sizes, weights, cap=3):
    """Targets by repeated resharing of what the caps cut off."""
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weights[s] / sum(weights[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in over}


def test_targets_and_words_taken(spark, tricky, tricky_rows):
    rows = mixing.mix(tricky).collect()
    assert sorted(r["size"] for r in rows) == sorted(words(t) for _, t, _ in tricky_rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, s in tricky_rows:
        sizes[s] += words(t)
    order = sorted(sizes, key=lambda s: (s is None, s))
    expected = water(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(expected[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == sum(p["words"] for p in r["passes"])
        assert all(0 <= p["position"] <= 1 for p in r["passes"]) and (r["position"] is None) == (r["taken"] == 0)
        taken[r["source"]] += r["taken"]
    assert {s: taken[s] for s in sizes} == {s: round(expected[s]) for s in sizes}


def test_reruns_agree(spark, tricky):
    def run():
        return sorted(map(str, mixing.mix(tricky.repartition(5)).collect()))
    assert run() == run()


def test_positions_invert_the_demand(spark):
    docs = make_docs(spark, [(i, "a b c d", "only") for i in range(200)])
    rows = mixing.mix(docs, weights=(1.0,), shapes=(mixing.RISING,), cap=1).orderBy("position").collect()
    # demand up to t of a rate that rises from 0.5 to 1.5 is t / 2 + t^2 / 2
    for k, r in enumerate(rows):
        t = r["position"]
        assert (t / 2 + t * t / 2) * 800 == pytest.approx(4 * k, abs=1e-6)


def test_training_order_and_whole_documents(spark, tricky):
    mixed = mixing.mix(tricky, whole_documents=True)
    order = mixing.training_order(mixed).collect()
    assert [r["position"] for r in order] == sorted(r["position"] for r in order)
    assert all(p["words"] == r["size"] for r in mixed.collect() for p in r["passes"])


def test_one_source_within_its_cap(spark):
    rows = mixing.mix(make_docs(spark, [(1, "a b", None), (2, "c", None)])).collect()
    assert {(r["doc_id"], r["taken"], r["target"]) for r in rows} == {(1, 2, 3.0), (2, 1, 3.0)}


def test_stage_keeps_columns_and_repeats(spark, tricky, empty):
    out = mixing.stage(spark, tricky, "")
    assert out.columns == tricky.columns and out.count() > 0
    assert mixing.stage(spark, empty, "").count() == 0 and mixing.mix(empty).count() == 0


def test_stage_keeps_blank_texts_and_counts_repeats_once(spark):
    rows = [(i, "a b c d e", f"s{i % 3}") for i in range(90)] + [(100, None, "s0"), (101, "", None), (102, " \t", "s1"), (102, " \t", "s1")]
    rows += [(None, "f g h", "s2")] * 20 + [(None, "x y z", "s2")] * 20
    docs = make_docs(spark, rows)
    out = [(r["doc_id"], r["text"], r["source"]) for r in mixing.stage(spark, docs, "").collect()]
    blank = [r for r in out if not (r[1] or "").split()]
    assert sorted(map(str, blank)) == sorted(map(str, rows[90:94]))
    targets = {r["source"]: r["target"] for r in mixing.mix(docs).collect()}
    for source, target in targets.items():
        words = sum(len((t or "").split()) for _, t, s in out if s == source)
        assert abs(words - target) <= 5, source
