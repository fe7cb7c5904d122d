"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word the encoding that the merges would give has exactly
one last token.  It is found from left to right: a matching automaton lists the
vocabulary's tokens that are suffixes of the prefix, and a token is the last one
if it is compatible with the last token of the prefix before it, that is, if the
merges leave the two side by side.  The back-pointers from the end of the word
give the ids.  Time is linear in the word's length; no merge loop runs over it.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from credsweep.llm.common import read, small_batches

#: Marks a word's end inside the automaton, where the vocabulary has its end-of-word suffix.
END = "\ue000"
#: Words longer than this aren't remembered; so many words and pairs are before the memory is emptied.
LONGEST_KEPT, MOST_KEPT = 64, 150_000
#: In place of a prefix's last token: the empty prefix, and no encoding found.
START, NONE = -1, -2
WHITE = r"\t-\r "
ASCII_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^{WHITE}a-z0-9]+")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself if printable in Latin-1, else the next from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, free = [""] * 256, iter(range(256, 512))
    for b in range(256):
        out[b] = chr(b) if b in own else chr(next(free))
    return out


class WordMemory(dict):
    """Word -> (ids as little-endian bytes, decoded text), filled on demand.

    Bounded by two generations: once the young one is full it becomes the old
    one, and words that are met again come back from there.
    """

    def __init__(self, model: "WordBpe") -> None:
        super().__init__()
        self.model, self.old = model, {}

    def __missing__(self, word: str) -> tuple[bytes, str]:
        out = self.old.get(word)
        if out is None:
            ids = self.model.encode_word(word)
            out = struct.pack(f"<{len(ids)}I", *ids), " ".join(map(self.model.tokens.__getitem__, ids))
        if len(word) <= LONGEST_KEPT:
            if len(self) >= MOST_KEPT:
                self.old = dict(self)
                self.clear()
            self[word] = out
        return out


class WordBpe:
    """The tokenizer of a vocabulary file: lower case, white space dropped, merges within words that end in a suffix."""

    def __init__(self, spec: str) -> None:
        full = json.loads(spec)
        model = full["model"]
        assert model["type"] == "BPE" and full["decoder"] is None and not model["byte_fallback"]
        suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()}
        special = {t["content"]: t["id"] for t in full["added_tokens"]}
        self.tokens |= {i: t for t, i in special.items()}
        self.special = special
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        pattern = next(p["pattern"]["Regex"] for p in full["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words_re = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.characters = str.maketrans({chr(b): c for b, c in enumerate(byte_characters())})
        self.marked = {i: t.removesuffix(suffix) + END if suffix and t.endswith(suffix) and t != suffix else t for t, i in self.vocab.items()}
        ids = {m: i for i, m in self.marked.items()}
        self.base = ids
        merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            self.merges[self.vocab[a], self.vocab[b]] = rank, self.vocab[a + b]
        self.matches = ahocorasick.Automaton()
        for i, m in self.marked.items():
            self.matches.add_word(m, (len(m), i))
        self.matches.make_automaton()
        self.beside: dict[int, bool] = {}
        self.memory = WordMemory(self)

    def symbols(self, marked: str) -> list[int]:
        """The vocabulary's single characters of a string; the end mark belongs to the last one."""
        if marked.endswith(END):
            return [*map(self.base.__getitem__, marked[:-2]), self.base[marked[-2:]]]
        return list(map(self.base.__getitem__, marked))

    def merged(self, ids: list[int]) -> list[int]:
        """The merges themselves, by rank, leftmost first; only run over pairs of tokens."""
        while len(ids) > 1:
            rank, at = min((self.merges.get(p, (1 << 40, 0))[0], k) for k, p in enumerate(zip(ids, ids[1:])))
            if rank == 1 << 40:
                break
            ids = [*ids[:at], self.merges[ids[at], ids[at + 1]][1], *ids[at + 2:]]
        return ids

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave the two tokens side by side.

        ``START`` on the left: whether they make the right one at all; ``NONE``:
        the prefix before it has no encoding, so no.
        """
        if left == NONE:
            found = False
        elif left == START:
            found = self.merged(self.symbols(self.marked[right])) == [right]
        else:
            found = self.merged(self.symbols(self.marked[left]) + self.symbols(self.marked[right])) == [left, right]
        if len(self.beside) >= MOST_KEPT:
            self.beside.clear()
        self.beside[(left << 32) + right] = found
        return found

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word."""
        text = word if word.isascii() and word.isalpha() else word.encode().decode("latin-1").translate(self.characters)
        n = len(text) + 1
        last = [NONE] * (n + 1)  # the last token of each prefix, or NONE so far; the end mark counts as a character
        last[0] = START
        size = [0] * (n + 1)
        known = self.beside.get
        for end, (length, token) in self.matches.iter(text + END):
            end += 1
            if last[end] == NONE:  # there is only one
                left = last[end - length]
                found = known((left << 32) + token)
                if found or found is None and self.compatible(left, token):
                    last[end] = token
                    size[end] = length
        ids = []
        while n > 0:
            if not size[n]:
                raise ValueError(f"the vocabulary has no tokens for {word!r}")
            ids.append(last[n])
            n -= size[n]
        ids.reverse()
        return ids

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if text.isascii():
            return ASCII_WORDS.findall(text.lower())
        # lower case goes character by character: no final sigma
        return self.words_re.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text."""
        if self.special_re and "<" in text and (parts := self.special_re.split(text))[1:]:
            pairs = []
            for k, part in enumerate(parts):
                pairs += [(struct.pack("<I", self.special[part]), part)] if k % 2 else map(self.memory.__getitem__, self.words(part))
        else:
            pairs = list(map(self.memory.__getitem__, self.words(text)))
        return b"".join([p[0] for p in pairs]), " ".join([p[1] for p in pairs])

    def decode(self, ids: list[int]) -> str:
        """The tokens with a space between them; ids outside the vocabulary give nothing."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


#: One tokenizer a worker process, by the digest of its file.
_loaded: dict[str, WordBpe] = {}


def tokenizer(spec: str) -> WordBpe:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = WordBpe(spec)
    return _loaded[key]


#: Columns that ``encode`` can add, with their types.
OUTPUTS = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType(),
           "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", outputs: tuple[str, ...] = tuple(OUTPUTS)) -> DataFrame:
    """``keep`` columns and ``outputs`` of every row's whole text; null counts as empty.

    ``path`` is the vocabulary file, read once on the driver (1.7 MB) and sent
    with the tasks, so executors need no copy.  Every row gives one row; no
    shuffle.  A vocabulary without a token for some character is an error at the
    first word that has it.  A worker's memory of words and token pairs is bounded.
    """
    with open(path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = small_batches(docs.select(*keep, docs[text_col].alias("text__")))
    schema = rows.drop("text__").schema
    for name in outputs:
        schema = schema.add(name, OUTPUTS[name])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer(spec.value)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in it:
            pairs = [model.encode(x.as_py() or "") for x in batch.column("text__")]
            made = {
                "n_tokens": lambda: pa.array([len(p[0]) // 4 for p in pairs], pa.int64()),
                "ids": lambda: pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *(len(p[0]) // 4 for p in pairs)]), pa.int32()),
                    pa.array(np.frombuffer(b"".join(p[0] for p in pairs), "<u4").astype(np.int32))),
                "decoded": lambda: pa.array([p[1] for p in pairs], pa.string()),
                "ids_sha256": lambda: pa.array([sha(p[0]) for p in pairs], pa.string()),
                "decoded_sha256": lambda: pa.array([sha(p[1].encode()) for p in pairs], pa.string()),
            }
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(made[o]() for o in outputs)], [*keep, *outputs])

    return rows.mapInArrow(batches, schema)


def decode(rows: DataFrame, path: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``decoded`` of every row's ids; null counts as no ids."""
    with open(path, encoding="utf-8") as f:
        spec = rows.sparkSession.sparkContext.broadcast(f.read())
    source = small_batches(rows.select(*keep, rows[ids_col].alias("ids__")))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer(spec.value)
        for batch in it:
            texts = [model.decode(x.as_py() or []) for x in batch.column("ids__")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, "decoded"])

    return source.mapInArrow(batches, source.drop("ids__").schema.add("decoded", "string"))


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


DIGESTS = ("n_tokens", "ids_sha256", "decoded_sha256")


def op8(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every document's ids and decoded text, as digests."""
    return encode(read(spark, sf_dir, "documents"), path or word_bpe_path(), outputs=DIGESTS)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, path: str | None = None) -> DataFrame:
    """The documents' ids and decoded texts, as digests."""
    return encode(docs, path or word_bpe_path(), outputs=DIGESTS)
