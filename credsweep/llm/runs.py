"""Periodic run detection: seeds on diagonals, extended once.

A run of period q and length L is a stretch of a document that equals itself q
words on for L - q words: a piece of the diagonal of lag q.  With the least
length 12 and L >= 2 q that piece has at least max(12 - q, q) >= 6 words, so some
6-gram of the run comes again q words later.  Larger lags guarantee a longer
piece, so they go by levels: for lags from 12 * 2^j on, a gram of 6 * 2^j words
that starts at a multiple of its length lies within the piece.  Equal grams of
one document within a level's lags are the seeds.  A table holds, for each lag,
how far its diagonal has been covered: a seed before that is passed over, as is
one inside a known run whose period divides the lag.  So seeds and comparisons
grow as n log n with the document's words, whatever it repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credsweep.llm.common import WORD, read, small_batches
from credsweep.llm.shingles import mix

#: The shortest run, and the words of a seed of the first level: what a diagonal of lag LEAST / 2 must cover.
LEAST, SEED = 12, 6
#: Words whose diagonals are searched at a time; a longer document is searched alone.
GROUP = 1 << 17
_TURN = np.uint64(0x9E3779B97F4A7C15)

RUNS = T.ArrayType(T.StructType().add("start", "long").add("length", "long").add("period", "long"))


def _grams(words: np.ndarray) -> np.ndarray:
    """Hashes of the SEED-grams that start at each place; ``words`` are numbers of words."""
    n = max(0, len(words) - SEED + 1)
    out = np.zeros(n, np.uint64)
    for j in range(SEED):
        out = out * _TURN + words[j:n + j].view(np.uint64)
    return mix(out)


def _doubled(grams: np.ndarray, size: int) -> np.ndarray:
    """From the hashes of ``size``-grams those of twice the length."""
    n = max(0, len(grams) - size)
    return mix(grams[:n] * _TURN + grams[size:size + n])


def _seeds(grams: np.ndarray, at: np.ndarray, step: int, low: int, high: int, run_at: np.ndarray, runs: list) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places (i, lag) of equal grams with low <= lag < high and i a multiple of ``step``, by lag and place.

    ``at`` are the places in order of (gram, place).  What a known run explains is left out.
    """
    same = np.concatenate([[0], np.cumsum(grams[at][1:] != grams[at][:-1])])
    wide = same * (len(grams) + 2 * high) + at
    first = np.flatnonzero(at % step == 0)
    lo = np.searchsorted(wide, wide[first] + low)
    hi = np.searchsorted(wide, wide[first] + high)
    many = hi - lo
    i = np.repeat(at[first], many)
    partner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
    lag = at[partner] - i
    if runs and len(i):
        known = run_at[i]
        end, period = (np.array([r[k] for r in runs] + [0]) for k in (1, 2))
        period[-1] = 1  # stands for "none"; its end of 0 covers nothing
        keep = (i + lag >= end[known]) | (lag % period[known] != 0)
        i, lag = i[keep], lag[keep]
    order = np.lexsort((i, lag))
    return i[order], lag[order]


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """How many first items two arrays share, looked at in growing pieces."""
    n, done, piece = min(len(a), len(b)), 0, 32
    while done < n:
        stop = min(done + piece, n)
        other = a[done:stop] != b[done:stop]
        k = int(other.argmax())
        if other[k]:
            return done + k
        done, piece = stop, piece * 4
    return n


def word_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """All maximal runs (start, end, period) of an array of numbers (int64), smallest periods, by period.

    A run is a stretch with smallest period q, no shorter than max(12, 2 q),
    that neither neighbour extends.
    """
    n = len(words)
    grams, size, low, high = _grams(words), SEED, 1, LEAST
    at = np.argsort(grams, kind="stable")
    run_at, runs, found = np.full(n, -1), [], set()
    step = 1
    while low <= n // 2 and len(at):
        # only grams that come again can be seeds, now and with twice the length
        gram = grams[at]
        again = np.zeros(len(at) + 1, bool)
        again[1:-1] = gram[1:] == gram[:-1]
        at = at[again[1:] | again[:-1]]
        if not len(at):
            break
        covered: dict[int, int] = {}
        for i, lag in zip(*(x.tolist() for x in _seeds(grams, at, step, low, high, run_at, runs))):
            if i < covered.get(lag, 0):
                continue
            right = i + _equal(words[i:n - lag], words[i + lag:])
            covered[lag] = max(right, i + 1)
            left = i - _equal(words[:i][::-1], words[lag:i + lag][::-1])
            start, end = left, right + lag
            if right - left < max(LEAST - lag, lag) or (start, end) in found:
                continue  # too short, or a known run's period divides this lag
            found.add((start, end))
            run_at[start:end][run_at[start:end] < 0] = len(runs)
            runs.append((start, end, lag))
        if low == 1:  # the first level's seeds stand at every place
            low, high, step = LEAST, 2 * LEAST, SEED
        else:
            grams, size, low, high = _doubled(grams, size), 2 * size, high, 2 * high
            step = size
            at = at[at < len(grams)]
            at = at[np.lexsort((at, grams[at]))] if len(at) else at
    return runs


def _numbered(texts: list[list[bytes]]) -> Iterator[tuple[int, int, np.ndarray]]:
    """Groups of texts as (first, last, numbers): equal words have equal numbers, a number of its own ends each text."""
    a = 0
    while a < len(texts):
        b, total = a + 1, len(texts[a])
        while b < len(texts) and total + len(texts[b]) <= GROUP:
            total += len(texts[b])
            b += 1
        number: dict[bytes, int] = {}
        out = np.empty(total + b - a, np.int64)
        k = 0
        for j, words in enumerate(texts[a:b]):
            out[k:k + len(words)] = [number.setdefault(w, len(number)) for w in words]
            out[k + len(words)] = -1 - j
            k += len(words) + 1
        yield a, b, out
        a = b


def documents_runs(texts: list[list[bytes]]) -> Iterator[list[tuple[int, int, int]]]:
    """For each list of words its runs (start, length, period), by start, then period."""
    for a, b, numbers in _numbered(texts):
        ends = np.cumsum([len(t) + 1 for t in texts[a:b]])
        starts = ends - [len(t) + 1 for t in texts[a:b]]
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(a, b)]
        # a text's last number is met nowhere else, so no run crosses it
        for start, end, period in word_runs(numbers):
            j = int(np.searchsorted(ends, start, side="right"))
            out[j].append((start - int(starts[j]), end - start, period))
        for found in out:
            yield sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    gone = np.cumsum(drop)[:-1] > 0
    return [w for w, g in zip(words, gone.tolist()) if not g]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``doc_id, n_words, runs, collapsed``.

    ``runs`` is an array of (start, length, period) in words numbered from 0, by
    start, then period; ``collapsed`` the words that are left if each run keeps
    its first period only, joined by one space.  Words are runs of anything but
    the six white-space characters, compared as written.  Null and blank texts
    have no words, no runs and an empty collapsed text; repeated rows, repeated
    and null ids are rows of their own; an empty table gives no rows.  A document
    is searched whole, in one task; nothing is shuffled.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType)]).add("n_words", "long").add("runs", RUNS).add("collapsed", "string")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            # bytes.split() cuts at just these six characters
            texts = [(t or "").encode().split() for t in batch.column("text").to_pylist()]
            runs = list(documents_runs(texts))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs], kind),
                pa.array([b" ".join(collapsed(t, r)).decode() for t, r in zip(texts, runs)], pa.string())], schema.names)

    return small_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(batches, schema)


def repeating_tail(doc_id: Column, text: Column) -> Column:
    """The text, or for a tenth of the documents its words with a tail that repeats.

    With h = crc32(decimal id) and g = floor(h / 10), h % 10 = 0 makes every word
    i >= a the word a + (i - a) % p, where a = g % n and
    p = 1 + floor((n - a) / (3 + g % 8)).  Null ids and texts stay as they are.
    """
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.transform(F.sequence(a, n - 1), lambda i: F.get(words, a + (i - a) % p))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, 1, a), tail), " ")).otherwise(text)

    # the words are a lambda's variable, so that they aren't cut out anew for each of them
    one = F.transform(F.array(F.regexp_extract_all(text, F.lit(f"({WORD})"))), repeated)
    return F.when((h % 10 == 0) & text.isNotNull(), F.get(one, F.lit(0))).otherwise(text)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs, a tenth of them with a tail that repeats: how many, the longest, and digests."""
    docs = read(spark, sf_dir, "documents")
    found = find_runs(docs.select("doc_id", repeating_tail(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("less"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-best["before"]).alias("start"), best["length"].alias("length"), (-best["less"]).alias("period"),
        F.floor(1000 * best["length"] / -best["less"]).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
