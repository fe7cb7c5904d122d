import hashlib
import json
import random
import struct

import pytest
from tokenizers import Tokenizer

from credsweep.llm import bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.word_bpe_path())


@pytest.fixture(scope="module")
def model():
    with open(bpe.word_bpe_path(), encoding="utf-8") as f:
        return bpe.WordBpe(f.read())


def both(model, library, text):
    raw, decoded = model.encode(text)
    ids = list(struct.unpack(f"<{len(raw) // 4}I", raw))
    expected = library.encode(text, add_special_tokens=False).ids
    return (ids, decoded), (expected, library.decode(expected, skip_special_tokens=False))


def test_like_the_library_on_random_texts(model, library):
    rng = random.Random(2)
    signs = "abcdefghiéñßüΣςσİIǅ你好 \t\n\x85\xa0\x1c\x00!?.,'’​0123²Ⅷ½-_<|>/😀é"
    for _ in range(1500):
        got, expected = both(model, library, "".join(rng.choice(signs) for _ in range(rng.randint(0, 50))))
        assert got == expected
    for _ in range(1500):
        got, expected = both(model, library, "".join(rng.choice("aethions") for _ in range(rng.randint(1, 40))))
        assert got == expected


@pytest.mark.parametrize("text", ["", " ", "don't I'LL 's", "a<|startoftext|>b <|endoftext|>x", "<|EndOfText|>", "</w> x</w>", "a" * 3000, "the" * 2000, "Ünï" * 50])
def test_like_the_library(model, library, text):
    got, expected = both(model, library, text)
    assert got == expected


def test_bounded_memory(model, library, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_KEPT", 5)
    rng = random.Random(4)
    for _ in range(30):
        got, expected = both(model, library, " ".join("".join(rng.choice("abcde") for _ in range(6)) for _ in range(20)))
        assert got == expected and len(model.memory) <= 5


def test_table(spark, tricky, tricky_rows, empty, library):
    path = bpe.word_bpe_path()
    out = bpe.encode(tricky, path).collect()
    expected = []
    for i, t, _ in tricky_rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        expected.append((str(i), len(ids), ids, text, hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in out) == sorted(expected)
    assert bpe.encode(empty, path).count() == 0 and bpe.stage(spark, empty, "").count() == 0


def test_round_trip(spark, tricky, library):
    path = bpe.word_bpe_path()
    encoded = bpe.encode(tricky, path, outputs=("ids", "decoded"))
    back = bpe.decode(encoded, path, keep=("doc_id",))
    assert sorted(r["decoded"] for r in back.collect()) == sorted(r["decoded"] for r in encoded.collect())


def test_a_vocabulary_without_a_character_is_an_error():
    spec = json.loads(open(bpe.word_bpe_path(), encoding="utf-8").read())
    spec["model"]["vocab"] = {t: i for t, i in spec["model"]["vocab"].items() if "q" not in t}
    spec["model"]["merges"] = [m for m in spec["model"]["merges"] if "q" not in str(m)]
    model = bpe.WordBpe(json.dumps(spec))
    assert model.encode("plain words")[1]
    with pytest.raises(ValueError, match="quite"):
        model.encode("quite")
