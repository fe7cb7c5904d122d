import random
import zlib

import numpy as np
import pytest

from credsweep.llm import toxicity as tox

from .conftest import make_docs, prose

BAD = ("vilest", "wretched", "loathsome")


def labelled(rng, n):
    rows = []
    for i in range(n):
        w = prose(rng, rng.randint(3, 60)).split()
        y = int(i % 5 == 0)
        if y:
            w.insert(rng.randrange(len(w) + 1), rng.choice(BAD) + rng.choice(["", "er", "ly"]))
        rows.append((i, " ".join(w), f"s{i % 3}", y))
    return rows


@pytest.fixture(scope="module")
def trained(spark):
    rows = labelled(random.Random(9), 1500)
    docs = make_docs(spark, [r[:3] for r in rows])
    labels = spark.createDataFrame([(r[0], 1, r[3]) for r in rows] + [(None, 1, 1), (7, 0, None), (10**6, 0, 1)], "doc_id bigint, quality int, toxic int")
    return rows, docs, labels, tox.train(docs, labels)


def test_held_out_accuracy(trained):
    rows, docs, _, model = trained
    scores = {r["doc_id"]: r["score"] for r in tox.score(docs, model).collect()}
    held = [(scores[i], y) for i, _, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(scores) == len(rows) and np.mean([(s >= 0.5) == y for s, y in held]) > 0.95


def test_model_is_the_same_again(trained):
    _, docs, labels, model = trained
    assert tox.train(docs.repartition(7), labels) == model


def test_held_out_fold_is_never_learnt_from(trained, spark):
    rows, docs, labels, model = trained
    flipped = spark.createDataFrame([(r[0], 1, 1 - r[3] if zlib.crc32(str(r[0]).encode()) % 5 == 0 else r[3]) for r in rows], "doc_id bigint, quality int, toxic int")
    assert tox.train(docs, flipped) == model


def test_scorer_is_the_network(trained):
    model = tox.Model.load(trained[3])
    scorer = tox.Scorer(model)
    for _, text, _, _ in trained[0][:50]:
        words = tox.words_of(text)
        logit = tox._logit_of(model, np.array([tox.features(w) for w in words]).reshape(-1, 1 + len(tox.STEMS))) - model.cuts.get(tox.language(words), model.cuts[""])
        assert scorer.score(text) == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-5)


def test_long_texts_in_chunks_and_bounded_memory(trained, monkeypatch):
    model = tox.Model.load(trained[3])
    text = prose(random.Random(1), 500) + " vilest " + prose(random.Random(2), 500)
    whole = tox.Scorer(model).score(text)
    monkeypatch.setattr(tox, "CHUNK", 7)
    monkeypatch.setattr(tox, "MOST_KEPT", 60)
    assert tox.Scorer(model).score(text) == pytest.approx(whole, abs=1e-6)


def test_the_last_word_of_every_chunk_is_scored(trained, monkeypatch):
    model = tox.Model.load(trained[3])
    for n in (1, 6, 7, 8, 9, 10, 14, 15, 16, 22):
        words = [f"word{i}" for i in range(n)]
        for at in {min(6, n - 1), min(13, n - 1), n - 1}:
            text = " ".join(words[:at] + ["vilest"] + words[at + 1:])
            monkeypatch.setattr(tox, "CHUNK", 50_000)
            whole = tox.Scorer(model).score(text)
            monkeypatch.setattr(tox, "CHUNK", 7)
            assert tox.Scorer(model).score(text) == pytest.approx(whole, abs=1e-6), (n, at)


def test_tricky(spark, trained, tricky, tricky_rows, empty):
    model = trained[3]
    out = tox.score(tricky, model).collect()
    assert len(out) == len(tricky_rows) and all(0 <= r["score"] <= 1 for r in out)
    assert tox.score(empty, model).count() == 0
    kept = tox.without_toxic(tricky, model)
    assert kept.columns == tricky.columns and kept.count() == sum(r["score"] < 0.5 for r in out)


def test_without_labels(spark, tricky):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    scores = {r["score"] for r in tox.score(tricky, tox.train(tricky, none)).collect()}
    assert len(scores) == 1 and scores.pop() < 0.5
    one = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id bigint, quality int, toxic int")
    scores = {r["score"] for r in tox.score(tricky, tox.train(tricky, one)).collect()}
    assert len(scores) == 1 and scores.pop() < 0.5
