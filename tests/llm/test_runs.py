import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from credsweep.llm import runs

from .conftest import make_docs, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """(start, length, period) of all runs, by comparing along every diagonal."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q) and (i, j + q) not in out:
                out[i, j + q] = q
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def texts(rng):
    yield from ([], ["a"], ["a"] * 11, ["a"] * 12, ["a", "b"] * 5 + ["a"], ["a", "b"] * 6, list("abcdef") * 2, list("abcdef") * 2 + ["a"])
    for _ in range(250):
        kind, n = rng.randrange(5), rng.randint(1, 150)
        if kind == 0:
            yield [rng.choice("ab") for _ in range(n)]
        elif kind == 1:
            yield [rng.choice("abcdefgh") for _ in range(n)]
        elif kind == 2:
            base = [rng.choice("abcde") for _ in range(rng.randint(1, 40))]
            yield ([rng.choice("abc") for _ in range(rng.randint(0, 9))] + base * rng.randint(2, 6))[:n + 20]
        elif kind == 3:  # runs within runs
            inner = [rng.choice("ab")] * rng.randint(1, 14) + [rng.choice("cd")]
            yield (inner * rng.randint(1, 4) + ["x"]) * rng.randint(1, 4)
        else:  # Fibonacci words hold very many runs
            a, b = ["a"], ["b"]
            while len(b) < n:
                a, b = b, b + a
            yield b


def test_every_run_is_found():
    for words in texts(random.Random(4)):
        found = list(runs.documents_runs([[w.encode() for w in words]]))[0]
        assert found == brute(words), words


def test_groups_of_texts_do_not_meet(monkeypatch):
    rng = random.Random(7)
    many = [[w.encode() for w in t] for t in texts(rng)]
    monkeypatch.setattr(runs, "GROUP", 300)
    assert list(runs.documents_runs(many)) == [brute(t) for t in many]


@pytest.mark.parametrize("period", [1, 2, 7, 1000, 60_000])
def test_long_repeating_text_takes_no_quadratic_time(period):
    words = np.resize(np.arange(period), 200_000)
    begun = time.time()
    assert runs.word_runs(words) == [(0, 200_000, period)]
    assert time.time() - begun < 20


def test_columns_and_tail(spark, tricky, tricky_rows):
    rows = {(r["doc_id"], r["n_words"], r["collapsed"]) for r in runs.find_runs(tricky).collect()}
    assert len(tricky_rows) == runs.find_runs(tricky).count()
    for i, t, _ in tricky_rows:
        words = WORD.findall(t or "")
        keep = [True] * len(words)
        for s, n, q in brute(words) if len(words) < 500 else []:
            keep[s + q:s + n] = [False] * (n - q)
        if len(words) < 500:
            assert (i, len(words), " ".join(w for w, k in zip(words, keep) if k)) in rows


def tail(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, (prose(rng, rng.randint(0, 60)) + " \t") * rng.choice([1, 1, 2, 3]), "s") for i in range(150)] + [(1000, None, "s"), (1001, "", "s"), (1002, "é É " * 9, "s")]
    make_docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in runs.op13(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        words = tail(i, WORD.findall(t or ""))
        found = brute(words)
        keep = [True] * len(words)
        for s, n, q in found:
            keep[s + q:s + n] = [False] * (n - q)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert tuple(got[i])[1:] == (
            len(found), *best, best[1] * 1000 // best[2] if found else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for w, k in zip(words, keep) if k))), i


def test_empty(spark, empty):
    assert runs.find_runs(empty).count() == 0
