import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from credsweep.llm import collocations as co

from .conftest import CLASHING, SCHEMA

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least, top=2000):
    """All counts in plain dictionaries; ``rows`` are (lang, text)."""
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            counts.update((lang, *w[i:i + m]) for m in (1, 2, 3, 4) for i in range(len(w) - m + 1))
    out = []
    for lang in totals:
        own = {p[1:]: c for p, c in counts.items() if p[0] == lang and c >= least}
        found = []
        for p, a in own.items():
            if len(p) < 2:
                continue
            if any(100 * f >= 80 * a for q, f in own.items() if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            score, k = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, totals[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


def rows_of(rng, n, langs=("en", "de", None)):
    vocabulary = ["The", "of", "and", "é", "Straße", "a\x1cb", "x-y", "naïve"] + [f"w{i}" for i in range(30)]
    fixed = ["new York City hall", "carbon dioxide", "the end of the day", "a b c d"]
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 60)):
            words.append(rng.choice(fixed) if rng.random() < 0.2 else rng.choices(vocabulary, range(len(vocabulary), 0, -1))[0])
            words.append(rng.choice([*" " * 12, "\t", "  ", ", ", ".", "\n", "\x0b", "\r\n"]))
        yield rng.choice(langs), "".join(words)


def make(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", len(t or ""), *range(len(CLASHING))) for i, (g, t) in enumerate(rows)], SCHEMA).repartition(3)


def found(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    out = list(rows_of(rng, 1500)) + [("en", None), (None, None), ("fr", ""), ("es", " \t"), ("en", "new york city hall " * 50)]
    return out + out[:20]


def test_against_brute_force(spark, rows):
    expected = brute(rows, 12)
    assert len(expected) > 60
    assert found(co.collocations(make(spark, rows), least=12)) == expected


def test_small_buffers_hot_prefixes_and_a_full_bitmap(spark, rows, monkeypatch):
    monkeypatch.setattr(co, "BUFFER", 400)
    monkeypatch.setattr(co, "HOT", 50)
    monkeypatch.setattr(co, "HELD", 30)
    monkeypatch.setattr(co, "FEWEST", 7)
    monkeypatch.setattr(co, "FILTER_BITS", 18)
    assert found(co.collocations(make(spark, rows), least=12)) == brute(rows, 12)


def test_top_and_sql(spark, rows, tmp_path):
    docs = make(spark, rows)
    assert found(co.collocations(docs, least=12, top=5)) == brute(rows, 12, 5)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({co.OP12_SQL})").fetchall())
    assert found(co.op12(spark, str(tmp_path))) == expected == brute(rows, 30)


def test_empty(spark, empty):
    assert co.collocations(empty).count() == 0


def test_words_of_long_texts(monkeypatch):
    from credsweep.llm import shingles
    rng = random.Random(2)
    data = "\n".join(t for _, t in rows_of(rng, 60)).encode().translate(co._AS)
    h, piece, words = co._words(data)
    monkeypatch.setattr(shingles, "CHUNK", 64)
    h2, piece2, words2 = co._words(data)
    assert words.to_pylist() == words2.to_pylist() == [w.decode() for p in data.split(b"\n") for w in p.split()]
    assert np.array_equal(h, h2) and np.array_equal(piece, piece2)
    assert piece.tolist() == [k for k, p in enumerate(data.split(b"\n")) for _ in p.split()]
