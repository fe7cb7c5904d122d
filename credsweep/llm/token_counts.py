"""Token counts of a document's sections by offset-mapped attribution.

A document is encoded once, as a whole, so that no token is changed by cutting
it up.  Tokens and sections are both spans of the text; the sorted spans are
interval-joined, and a token that crosses a boundary goes where the rule says.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from credsweep.llm.common import read, small_batches

#: Where a token that lies in several sections goes: the section of its first byte,
#: of its last one, the one with most of its bytes (the earlier of equals), or to
#: all of them by their bytes' shares.
RULES = ("first", "last", "most", "shares")
#: Fixed value: the pattern that splits text before the merges of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

KINDS = ("heading", "list", "table", "prose", "blank")


def sections(raw: bytes) -> np.ndarray:
    """Ends of a text's sections in bytes: each line with its line break; a text without any is one section."""
    data = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(data == 10) + 1
    return ends if len(ends) and ends[-1] == len(raw) else np.append(ends, len(raw))


def kind_of(line: str) -> str:
    """What a line looks like, by its first and last signs."""
    s = line.strip()
    if not s:
        return "blank"
    if s.startswith("#") or len(s) <= 80 and s[-1] not in ".!?:;,|" and s.count(" ") < 12:
        return "heading"
    if s[0] in "-*•" or s[:3].rstrip(".) ").isdigit():
        return "list"
    return "table" if s.count("|") >= 2 else "prose"


def attribute(token_ends: np.ndarray, section_ends: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section under the rule, and how many of the section's tokens also lie in another one.

    Both arguments are sorted ends of gapless spans that begin at 0; the counts
    are whole numbers but for ``shares``, and add up to the number of tokens.
    """
    n = len(section_ends)
    begins = np.concatenate([[0], token_ends[:-1]]) if len(token_ends) else token_ends
    first = np.searchsorted(section_ends, begins, side="right")
    last = np.searchsorted(section_ends, token_ends, side="left")
    crossing = np.flatnonzero(first != last)
    counts = np.bincount(last if rule == "last" else first, minlength=n).astype(float)
    met = np.zeros(n, np.int64)
    section_begins = np.concatenate([[0], section_ends[:-1]])
    for i in crossing:  # at most one for each boundary
        where = np.arange(first[i], last[i] + 1)
        met[where] += 1
        if rule in ("most", "shares"):
            share = np.minimum(section_ends[where], token_ends[i]) - np.maximum(section_begins[where], begins[i])
            counts[first[i]] -= 1
            if rule == "most":
                counts[where[share.argmax()]] += 1
            else:
                counts[where] += share / share.sum()
    return counts, met


def byte_encoder(ranks: bytes):
    """The encoder of a rank file, and each token's length in bytes."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    lengths = np.zeros(max(table.values()) + 1, np.int64)
    for token, rank in table.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}), lengths


_encoders: dict[int, tuple] = {}


def _encoder(ranks: bytes) -> tuple:
    """One encoder a worker process and file."""
    key = hash(ranks)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = byte_encoder(ranks)
    return _encoders[key]


def token_ends(text: str, encoding, lengths: np.ndarray) -> np.ndarray:
    """Ends of a whole text's tokens in bytes."""
    return np.cumsum(lengths[np.array(encoding.encode_ordinary(text), dtype=np.int64)])


def section_tokens(docs: DataFrame, path: str, rule: str = "first", keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """One row a section of every document: ``keep``, ``section`` (from 0), ``kind``, ``begin`` and ``end`` (code points),
    ``n_tokens`` (double), ``n_crossing``, ``doc_tokens``.

    Sections are lines; ``n_tokens`` of a document's sections adds up to
    ``doc_tokens``.  ``path`` is a file of byte-level ranks, read on the driver and
    sent with the tasks.  Null and empty texts give one blank section without
    tokens; repeated rows give their sections again; an empty table gives no
    rows.  No shuffle; a task holds one batch of texts.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = small_batches(docs.select(*keep, docs[text_col].alias("text__")))
    schema = T.StructType([*rows.drop("text__").schema.fields]).add("section", "integer").add("kind", "string").add("begin", "long").add("end", "long") \
        .add("n_tokens", "double").add("n_crossing", "long").add("doc_tokens", "long")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = _encoder(ranks.value)
        for batch in it:
            out, at = [[] for _ in range(7)], []
            for i, t in enumerate(batch.column("text__")):
                text = t.as_py() or ""
                raw = text.encode()
                ends, tokens = sections(raw), token_ends(text, encoding, lengths)
                counts, met = attribute(tokens, ends, rule)
                lines = text.split("\n")[:len(ends)]
                chars = np.cumsum([len(x) + 1 for x in lines])
                chars[-1] = len(text)
                n = len(ends)
                at += [i] * n
                for column, values in zip(out, (range(n), map(kind_of, lines), [0, *chars[:-1].tolist()], chars.tolist(), counts.tolist(), met.tolist(), [len(tokens)] * n)):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at, pa.int64())) for c in keep), *(
                pa.array(v, t) for v, t in zip(out, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())))], schema.names)

    return rows.mapInArrow(batches, schema)


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op7(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Tokens of every line of every document; a token goes to the line of its first byte."""
    return section_tokens(read(spark, sf_dir, "documents"), path or byte_bpe_path())
