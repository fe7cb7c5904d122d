import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from credsweep.llm import token_counts as tc


def test_like_the_offsets_of_the_library(spark, tricky, tricky_rows):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    expected = []
    for i, t, _ in tricky_rows:
        raw = (t or "").encode()
        ends = tc.sections(raw)
        counts = np.zeros(len(ends))
        n = 0
        for token in library.encode(t or "", add_special_tokens=False).offsets:
            begin = len((t or "")[:token[0]].encode())
            counts[np.searchsorted(ends, begin, side="right")] += 1
            n += 1
        expected += [(str(i), k, c, n) for k, c in enumerate(counts)]
    out = tc.section_tokens(tricky, tc.byte_bpe_path()).collect()
    # a token may begin inside a character: then the library's offset is the character's, in the same line
    assert sorted((str(r["doc_id"]), r["section"], r["n_tokens"], r["doc_tokens"]) for r in out) == sorted(expected)


@pytest.mark.parametrize("rule,expected", [("first", [2, 1, 0]), ("last", [1, 0, 2]), ("most", [1, 2, 0]), ("shares", [1 + 1 / 4, 1 + 3 / 8 + 0, 3 / 8])])
def test_rules(rule, expected):
    # tokens 0-3, 3-11, 11-12; sections 0-5, 5-8 and 8-12 for all but the counts below
    counts, met = tc.attribute(np.array([3, 11, 12]), np.array([5, 12]), rule)
    assert counts.sum() == pytest.approx(3) and met.tolist() == [1, 1]
    three, met = tc.attribute(np.array([3, 11, 12]), np.array([5, 8, 12]), rule)
    by_hand = {"first": [2, 0, 1], "last": [1, 0, 2], "most": [1, 1, 1], "shares": [1 + 2 / 8, 3 / 8, 1 + 3 / 8]}
    assert three.tolist() == pytest.approx(by_hand[rule]) and met.tolist() == [1, 1, 1]


def test_brute_force_spans():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        tokens = np.append(np.sort(rng.choice(np.arange(1, n), rng.integers(0, n), replace=False)) if n > 1 else np.zeros(0, int), n)
        parts = np.append(np.sort(rng.choice(np.arange(1, n), rng.integers(0, n), replace=False)) if n > 1 else np.zeros(0, int), n)
        spans = lambda e: list(zip([0, *e[:-1]], e))
        for rule in tc.RULES:
            counts, met = tc.attribute(tokens, parts, rule)
            hand, crossing = np.zeros(len(parts)), np.zeros(len(parts))
            for a, b in spans(tokens):
                bytes_in = np.array([max(0, min(b, d) - max(a, c)) for c, d in spans(parts)])
                where = np.flatnonzero(bytes_in)
                crossing[where] += len(where) > 1
                if rule == "shares":
                    hand += bytes_in / bytes_in.sum()
                else:
                    hand[{"first": where[0], "last": where[-1], "most": bytes_in.argmax()}[rule]] += 1
            assert np.allclose(counts, hand) and (met == crossing).all()


def test_edges(spark, tricky, empty):
    assert tc.section_tokens(empty, tc.byte_bpe_path()).count() == 0
    rows = tc.section_tokens(tricky, tc.byte_bpe_path(), "shares").where("doc_id IN (100, 101)").collect()
    assert [(r["section"], r["kind"], r["n_tokens"], r["end"]) for r in rows] == [(0, "blank", 0.0, 0)] * 2
    with pytest.raises(ValueError):
        tc.section_tokens(tricky, tc.byte_bpe_path(), "other")
