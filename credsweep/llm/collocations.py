"""Phrase collocation mining with stripes.

A stripe is a prefix of up to three words and an associative counter of the words
that follow it.  Tasks build stripes of the text they hold, stripes of one prefix
are merged elementwise, and an entry of a merged stripe is the count of a phrase:
the empty prefix's stripe has the words (its total is n), a word's the pairs, and
so on, so prefix totals, extensions and the longer phrases that may subsume a
shorter one all come from the same table.

A phrase of 30 occurrences has only parts that occur as often.  So the words are
counted first, then pairs of frequent words, then phrases of three and four whose
pairs are all frequent.  Which parts are frequent is told by a bitmap of hashes of
a fixed size: it lets some others through, which their own counts then drop, and
never holds back a frequent one, so results don't depend on its size.  Stripes of
words and longer prefixes hold 64-bit hashes, which are told from what is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credsweep.llm.common import read, small_batches, written
from credsweep.llm.shingles import mix, pieces, word_hashes

#: Bytes of text that a task turns into stripes at a time.
BUFFER = 4 << 20
#: The bitmap of frequent phrases has 2^26 bits (8 MB), put together in slots of this many bytes.
FILTER_BITS, SLOT = 26, 8192
#: Parts of a language's words; for longer phrases, words for one part, and the fewest parts.
PARTS, SHARE, FEWEST = 256, 1 << 20, 256
#: Prefixes with at least this share of all words (so at most 200 of them) have their stripes dealt over parts by the next word.
HOT = 200
#: Entries of stripes that a task merges at a time.
HELD = 1 << 21
#: Lower case, and the characters that end a piece or part words as line feeds and blanks.
_AS = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\x0b\x0c\r\t", bytes(range(97, 123)) + b"\n" * 9 + b" ")
_STEP = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA5A3564E27F88697)]

WORDS = "lang string, part int, total long, next array<string>, counts array<long>"
_ARROW = pa.schema([("lang", pa.string()), ("part", pa.int32()), ("total", pa.int64()), ("next", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def _salt(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "big"))


def _grams(words: np.ndarray, size: int, salt: np.uint64) -> np.ndarray:
    """Hashes of the phrases of ``size`` words that start at each place, within a language."""
    n = max(0, len(words) - size + 1)
    out = np.full(n, salt)
    for j in range(size):
        out = out + words[j:n + j] * _STEP[j]
    return mix(out)


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Hashes of the words of some translated text, the number of each one's piece, and the words."""
    raw = np.frombuffer(data, np.uint8)
    hashes, numbers, lengths, done = [], [], [], 0
    for part in pieces(raw):
        h, starts = word_hashes(part, np.zeros(0, int))
        ends = np.cumsum(part == 10)
        hashes.append(h)
        numbers.append(ends[starts] + done)
        kept = np.cumsum((part != 10) & (part != 32))
        lengths.append(np.diff(np.append(kept[starts] - 1, kept[-1] if len(kept) else 0)))
        done += int(ends[-1]) if len(ends) else 0
    letters = raw[(raw != 10) & (raw != 32)]
    offsets = np.concatenate([[0], *map(np.cumsum, [np.concatenate([np.zeros(0, int), *lengths])])]).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters))])
    return np.concatenate([np.zeros(0, np.uint64), *hashes]), np.concatenate([np.zeros(0, int), *numbers]), words


def _held(bitmap: np.ndarray, grams: np.ndarray) -> np.ndarray:
    at = grams >> np.uint64(65 - (8 * len(bitmap)).bit_length())
    return bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1


def _buffers(it: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, bytes]]:
    """The translated texts of a task, some megabytes of a language at a time."""
    held: dict[str, list[bytes]] = {}
    total = 0
    for batch in it:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            data = (text or "").encode().translate(_AS)
            held.setdefault(lang, []).append(data)
            total += len(data)
            if total >= size:
                yield from ((x, b"\n".join(texts)) for x, texts in held.items())
                held, total = {}, 0
    yield from ((x, b"\n".join(texts)) for x, texts in held.items())


# ---------------------------------------------------------------- words: the empty prefix's stripe


def word_stripes(docs: DataFrame, least: int) -> DataFrame:
    """The stripe of the empty prefix of each language, dealt over parts by the word: its total and the words with ``least`` occurrences or more."""
    buffer = BUFFER

    def local(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data in _buffers(it, buffer):
            h, _, words = _words(data)
            if not len(h):
                continue
            _, first, counts = np.unique(h, return_index=True, return_counts=True)
            part = (h[first] >> np.uint64(20)).astype(np.int64) % PARTS
            order = np.argsort(part, kind="stable")
            first, counts, part = first[order], counts[order], part[order]
            starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            offsets = pa.array(np.append(starts, len(first)), pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(starts), pa.string()), pa.array(part[starts], pa.int32()), pa.array(np.add.reduceat(counts, starts), pa.int64()),
                pa.ListArray.from_arrays(offsets, words.take(pa.array(first))), pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))], schema=_ARROW)

    def merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, merged = None, {}

        def closed() -> list[tuple]:
            kept = {w: c for w, c in merged.items() if c >= least}
            return [(*at, sum(merged.values()), list(kept), list(kept.values()))] if at else []

        for batch in it:
            out = []
            for key, words, counts in zip(zip(*(batch.column(c).to_pylist() for c in ("lang", "part"))), batch.column("next").to_pylist(), batch.column("counts").to_pylist()):
                if key != at:
                    out += closed()
                    at, merged = key, dict(zip(words, counts))
                else:
                    for w, c in zip(words, counts):
                        merged[w] = merged.get(w, 0) + c
            yield _rows(out)
        yield _rows(closed())

    return small_batches(docs).mapInArrow(local, WORDS).repartition("lang", "part").sortWithinPartitions("lang", "part").mapInArrow(merge, WORDS)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(_ARROW)], schema=_ARROW)


# ---------------------------------------------------------------- stripes of prefixes, by hash


def _pack(prefix: np.ndarray, word: np.ndarray, counts: np.ndarray) -> bytes:
    """Stripes as bytes, sorted by prefix: how many, the prefixes, their ends, the next words and the counts."""
    ends = np.flatnonzero(np.append(prefix[1:] != prefix[:-1], True)) + 1
    return b"".join([np.array([len(ends), len(word)], np.int64).tobytes(), prefix[ends - 1].tobytes(), ends.astype(np.uint32).tobytes(), word.tobytes(), counts.astype(np.uint32).tobytes()])


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    many, entries = np.frombuffer(raw, np.int64, 2).tolist()
    prefix = np.frombuffer(raw, np.uint64, many, 16)
    ends = np.frombuffer(raw, np.uint32, many, 16 + 8 * many)
    word = np.frombuffer(raw, np.uint64, entries, 16 + 12 * many)
    counts = np.frombuffer(raw, np.uint32, entries, 16 + 12 * many + 8 * entries)
    return np.repeat(prefix, np.diff(ends, prepend=0)), word, counts.astype(np.int64)


def _merged(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stripes added elementwise."""
    prefix, word, counts = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((word, prefix))
    prefix, word, counts = prefix[order], word[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (word[1:] != word[:-1])]))
    return prefix[starts], word[starts], np.add.reduceat(counts, starts)


def stripes(docs: DataFrame, sizes: tuple[int, ...], least: int, known: int, bitmap, hot, parts: int) -> DataFrame:
    """``size, prefix, next, f`` of the phrases of ``sizes`` words of ``docs`` (lang, text) with ``least`` occurrences or more.

    Only phrases whose parts of ``known`` words are in the bitmap are counted.
    Prefix and next word are told by their hashes.  A task's stripes are packed
    by part, a range of prefix hashes; those of ``hot`` prefixes go by the next word too.
    """
    buffer, most, deal = BUFFER, HELD, np.uint64(parts)

    def local(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data in _buffers(it, buffer):
            h, piece, _ = _words(data)
            salt, out = _salt(lang), []
            if len(h) < known:
                continue
            fine = _held(bitmap.value, _grams(h, known, salt)) & (piece[:len(h) - known + 1] == piece[known - 1:])
            for size in sizes:
                n = max(0, len(h) - size + 1)
                good = piece[:n] == piece[size - 1:size - 1 + n]
                for j in range(size - known + 1):
                    good &= fine[j:n + j]
                at = np.flatnonzero(good)
                if not len(at):
                    continue
                prefix, word, counts = _merged([(_grams(h, size - 1, salt)[at], h[at + size - 1], np.ones(len(at), np.int64))])
                live = np.isin(_grams(h, min(size - 1, 2), salt), hot.value)
                hottest = np.unique(_grams(h, size - 1, salt)[np.flatnonzero(live[:n])]) if live.any() else np.zeros(0, np.uint64)
                part = np.where(np.isin(prefix, hottest), mix(prefix ^ word), mix(prefix)) % deal
                order = np.argsort(part, kind="stable")
                prefix, word, counts, part = prefix[order], word[order], counts[order], part[order]
                starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                out += [(size, int(part[a]), _pack(prefix[a:b], word[a:b], counts[a:b])) for a, b in zip(starts, np.append(starts[1:], len(part)))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary())], ["size", "part", "data"])

    def merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, many = None, [], 0

        def closed() -> pa.RecordBatch:
            prefix, word, counts = _merged(held) if held else [np.zeros(0, np.uint64)] * 3
            kept = counts >= least
            return pa.RecordBatch.from_arrays([
                pa.array(np.full(int(kept.sum()), at[0] if at else 0), pa.int32()), pa.array(prefix[kept].view(np.int64)), pa.array(word[kept].view(np.int64)),
                pa.array(counts[kept], pa.int64())], ["size", "prefix", "next", "f"])

        for batch in it:
            for key, raw in zip(zip(batch.column("size").to_pylist(), batch.column("part").to_pylist()), batch.column("data")):
                if key != at:
                    yield closed()
                    at, held, many = key, [], 0
                held.append(_unpack(raw.as_buffer()))
                many += len(held[-1][0])
                if many >= most:
                    held = [_merged(held)]
                    many = len(held[0][0]) // 2  # merged once more when as many have come again
        yield closed()

    rows = small_batches(docs).mapInArrow(local, "size int, part int, data binary")
    return rows.repartition("size", "part").sortWithinPartitions("size", "part").mapInArrow(merge, "size int, prefix long, next long, f long")


def _with_hash(found: DataFrame, size: int) -> DataFrame:
    """Phrases with their hash as a prefix, and words also with the hash that they have as a next word."""
    schema = T.StructType([*found.schema.fields, T.StructField("as_prefix", T.LongType())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_hashes(batch, size).view(np.int64))], schema.names)

    out = found.mapInArrow(batches, schema)
    return out if size > 1 else out.mapInArrow(_next_words, T.StructType([*schema.fields, T.StructField("as_next", T.LongType())]))


def _next_words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        h = word_hashes(np.frombuffer("\n".join(batch.column("phrase").to_pylist()).encode(), np.uint8), np.zeros(0, int))[0]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h.view(np.int64))], [*batch.schema.names, "as_next"])


def _named(found: DataFrame, shorter: DataFrame, words: DataFrame, size: int) -> DataFrame:
    """``lang, phrase, f, as_prefix`` of counted phrases: a prefix's name and language, and the next word's name."""
    prefix = shorter.select("lang", F.col("phrase").alias("head"), F.col("as_prefix").alias("prefix"))
    last = words.select("lang", F.col("phrase").alias("tail"), F.col("as_next").alias("next"))
    rows = found.where(F.col("size") == size).join(prefix, "prefix").join(last, ["lang", "next"])
    return written(_with_hash(rows.select("lang", F.concat_ws(" ", "head", "tail").alias("phrase"), "f"), size), "phrases")


def _hashes(batch: pa.RecordBatch, size: int) -> np.ndarray:
    """Hashes of a column of phrases, as the text's own are."""
    h = word_hashes(np.frombuffer("\n".join(batch.column("phrase").to_pylist()).encode(), np.uint8), np.zeros(0, int))[0].reshape(-1, size)
    out = np.array([_salt(x) for x in batch.column("lang").to_pylist()], np.uint64)
    for j in range(size):
        out = out + h[:, j] * _STEP[j]
    return mix(out)


def frequent_bitmap(found: DataFrame, size: int) -> np.ndarray:
    """The bitmap of some phrases' hashes: tasks set their bits, which meet slot by slot; 8 MB whatever the table's size."""
    shift = np.uint64(64 - FILTER_BITS)

    def bits(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for batch in it:
            at = np.unique(_hashes(batch, size) >> shift).astype(np.int64) if batch.num_rows else np.zeros(0, np.int64)
            for slot in np.unique(at // (8 * SLOT)).tolist():
                own = at[at // (8 * SLOT) == slot] - slot * 8 * SLOT
                out.setdefault(slot, np.zeros(8 * SLOT, bool))[own] = True
        yield _slots({s: np.packbits(x, bitorder="little") for s, x in out.items()})

    def join(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for batch in it:
            for slot, raw in zip(batch.column("slot").to_pylist(), batch.column("bits").to_pylist()):
                x = np.frombuffer(raw, np.uint8)
                out[slot] = out[slot] | x if slot in out else x
        yield _slots(out)

    kind = "slot int, bits binary"
    rows = found.select("lang", "phrase").mapInArrow(bits, kind).repartition("slot").mapInArrow(join, kind).toArrow()
    bitmap = np.zeros(((1 << FILTER_BITS) // 8 // SLOT, SLOT), np.uint8)
    for slot, raw in zip(rows.column("slot").to_pylist(), rows.column("bits").to_pylist()):
        bitmap[slot] = np.frombuffer(raw, np.uint8)
    return bitmap.ravel()


def _slots(found: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], ["slot", "bits"])


def _hot_hashes(found: DataFrame, size: int, words: int) -> np.ndarray:
    """Hashes of the phrases that hold a 1 / HOT of all words or more, so of HOT at most."""
    rows = found.where(F.col("f") * HOT >= words).select("lang", "phrase").toArrow()
    return _hashes(rows.combine_chunks().to_batches()[0], size) if rows.num_rows else np.zeros(0, np.uint64)


def phrase_counts(docs: DataFrame, least: int, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to 4 words with ``least`` occurrences or more (``lang, phrase, size, f``), and ``lang, n``: all words."""
    tell = docs.sparkSession.sparkContext.broadcast
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    found = written(word_stripes(texts, least), "words")
    totals = found.groupBy("lang").agg(F.sum("total").alias("n"))
    everything = totals.agg(F.sum("n")).first()[0] or 0
    parts = max(FEWEST, everything // SHARE)

    x = F.explode(F.arrays_zip("next", "counts")).alias("x")
    one = written(_with_hash(found.select("lang", x).select("lang", F.col("x.next").alias("phrase"), F.col("x.counts").alias("f")), 1), "phrases")
    pairs = written(stripes(texts, (2,), least, 1, tell(frequent_bitmap(one, 1)), tell(_hot_hashes(one, 1, everything)), parts), "pairs")
    two = _named(pairs, one, one, 2)
    longer = written(stripes(texts, (3, 4), least, 2, tell(frequent_bitmap(two, 2)), tell(_hot_hashes(two, 2, everything)), parts), "longer")
    three = _named(longer, two, one, 3)
    four = _named(longer, three, one, 4)
    sized = [p.select("lang", "phrase", F.lit(i).alias("size"), "f") for i, p in enumerate((one, two, three, four), 1)]
    return sized[0].union(sized[1]).union(sized[2]).union(sized[3]), totals


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Each language's ``top`` phrases of 2 to 4 words: ``lang, rank, phrase, a, l, r, n, score``.

    Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends,
    and these into words at blanks and tabs.  a is how often the phrase occurs
    (``least`` or more), n the language's words; of the phrase's cuts into a first
    part (l occurrences) and a rest (r) the one with the lowest
    floor(2,000,000 a / (l + r)) gives the score, ties to the earliest.  A phrase
    goes if a longer one that holds it occurs at least 0.8 times as often.  Order:
    score, a (both falling), phrase by bytes.

    Null text has no words, a null language is ``und``, repeated rows count as
    often as they stand, an empty table gives no rows; no column but the two is
    read.  Counts pass shuffles as stripes, aggregated by task before.
    """
    counts, totals = phrase_counts(docs, least, lang_col, text_col)
    candidates = counts.where("size >= 2")
    part = lambda start, length: F.array_join(F.slice(F.split("phrase", " "), start, length), " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))) \
        .select("lang", "phrase", F.col("f").alias("a"), "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    of = lambda name, value: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(value))
    # whole numbers of 27 digits, so that no product overflows
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    scored = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"]).withColumn("score", score) \
        .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    held = F.array(*[F.when(F.col("size") > size, part(F.lit(i + 1), F.lit(size))) for size, last in ((2, 3), (3, 2)) for i in range(last)])
    inside = counts.where("size >= 3").select("lang", "size", "f", F.explode(held).alias("phrase")) \
        .where("phrase is not null and size(split(phrase, ' ')) < size").groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    kept = scored.join(inside, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (wide("longest") * 100 < wide("a") * 80)) \
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # first within 64 parts of a language, so that no task sorts all phrases of a large one
    some = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))) \
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2,000 collocations of the documents."""
    return collocations(read(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents),
words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m)),
totals AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
counts AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY lang, m, phrase HAVING count(*) >= 30),
cuts AS (
  SELECT lang, m, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS first, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, m)) AS k FROM counts WHERE m >= 2)),
scored AS (
  SELECT c.lang, c.phrase, c.m, c.a, c.k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f + y.f) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.first JOIN counts y ON y.lang = c.lang AND y.phrase = c.rest),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
subs AS (
  SELECT lang, f, array_to_string(string_split(phrase, ' ')[i:i + s - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM counts WHERE m >= 3))),
longest AS (SELECT lang, phrase, max(f) AS f FROM subs GROUP BY lang, phrase),
kept AS (SELECT w.* FROM lowest w LEFT JOIN longest g ON g.lang = w.lang AND g.phrase = w.phrase WHERE g.f IS NULL OR 100::HUGEINT * g.f < 80::HUGEINT * w.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, rank, phrase, a, l, r.r AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000
"""
