"""Toxicity by a convolutional text classifier trained in numpy.

A word is the sum of hashed embeddings: its own and those of its leading bytes,
so that inflected forms share what their stem has learnt.  Filters one, two and
three words wide slide over the whole text; each keeps its largest value, and a
dense layer turns these into a logit.  Thresholds are calibrated by language,
which is guessed from the text's own function words.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credsweep.llm.common import read, small_batches

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 16, 16, (1, 2, 3)
#: Lengths in bytes of the leading parts that have embeddings of their own, beside the whole word.
STEMS = (3, 4, 5, 6)
#: Labelled rows that the classifier is fitted on at most, taken by the hash of their ids.
SAMPLE = 8_000
#: Documents of the sample that a feature must occur in; rarer ones would only tell single documents apart.
LEAST_DOCS = 3
RATE, NEGATIVES = 0.05, 3
#: Training goes on for about this many steps, within these numbers of epochs.
STEPS, EPOCHS = 20_000, (3, 30)
#: Words of a text that are convolved at a time, and words that a task remembers.
CHUNK, MOST_KEPT = 50_000, 50_000
WORDS = re.compile(r"[^\W\d_]+")
#: Function words by which a text's language is guessed.
FUNCTION_WORDS = {
    "en": frozenset("the and of to in is that it for was on are with as this be at by".split()),
    "de": frozenset("der die das und ist nicht ein eine mit auf zu von den im auch sich".split()),
    "fr": frozenset("le les et des est une dans que pour qui sur au avec du pas par".split()),
    "es": frozenset("el los las y del que con para una por como su al no se es".split()),
}


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def language(words: list[str]) -> str:
    """The language with the most function words among the words; empty if there are none."""
    best = max(((sum(map(listed.__contains__, words)), name) for name, listed in FUNCTION_WORDS.items()))
    return best[1] if best[0] else ""


def features(word: str) -> list[int]:
    """Buckets of a word and of its leading bytes; bucket 0 stands for nothing."""
    raw = word.encode()
    return [zlib.crc32(raw + b"\0") % (BUCKETS - 1) + 1, *(zlib.crc32(raw[:n]) % (BUCKETS - 1) + 1 if len(raw) >= n else 0 for n in STEMS)]


class Model:
    """Embeddings, filters by width, dense layer, thresholds by language."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.emb[0] = 0
        self.conv = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.dense = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.base = np.zeros(1, np.float32)
        self.cuts: dict[str, float] = {"": 0.0}

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, emb=self.emb, bias=self.bias, dense=self.dense, base=self.base, langs=np.array(list(self.cuts)),
                            cuts=np.array(list(self.cuts.values())), **{f"conv{i}": c for i, c in enumerate(self.conv)})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> "Model":
        out, z = cls.__new__(cls), np.load(io.BytesIO(raw))
        out.emb, out.bias, out.dense, out.base = z["emb"], z["bias"], z["dense"], z["base"]
        out.conv = [z[f"conv{i}"] for i in range(len(WIDTHS))]
        out.cuts = dict(zip(z["langs"].tolist(), z["cuts"].tolist(), strict=True))
        return out

    def logit(self, pooled: np.ndarray) -> float:
        return float(np.maximum(pooled + self.bias, 0) @ self.dense + self.base[0])


def _padded(rows: np.ndarray) -> np.ndarray:
    """A text's words, at least one, and nothing after its end for the wider filters."""
    return np.concatenate([rows, np.zeros((max(WIDTHS) - 1 + (len(rows) == 0), *rows.shape[1:]), rows.dtype)])


class Sample:
    """Labelled texts as word numbers; the features of each word stand in one table, so a word takes four bytes."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.table: list[list[int]] = []
        self.texts: list[np.ndarray] = []
        self.labels: list[int] = []
        self.languages: list[str] = []

    def add(self, words: list[str], label: int) -> None:
        for w in words:
            if w not in self.numbers:
                self.numbers[w] = len(self.numbers)
                self.table.append(features(w))
        self.texts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.labels.append(label)
        self.languages.append(language(words))


def fit(docs: Sample, seed: int = 7) -> Model:
    """The classifier on labelled texts; a fifth of them only calibrates the thresholds."""
    model = Model(seed)
    y = np.array(docs.labels, dtype=int)
    rate = (y.sum() + 0.5) / (len(y) + 2)  # without any label a text isn't toxic
    model.base[0] = np.log(rate / (1 - rate))
    rng = np.random.default_rng(seed)
    docs.numbers = {}
    table = np.array(docs.table, dtype=np.int32).reshape(-1, 1 + len(STEMS))
    docs.table = []
    counts = np.zeros(BUCKETS, int)
    for x in docs.texts:
        counts[np.unique(table[np.unique(x)])] += 1
    model.emb[counts < LEAST_DOCS] = 0
    common = counts >= LEAST_DOCS
    common[0] = False
    table = np.where(common[table], table, 0)
    fold = rng.permutation(len(y)) % 5
    positive, negative = np.flatnonzero((y == 1) & (fold > 0)), np.flatnonzero((y == 0) & (fold > 0))
    if not len(positive) or not len(negative):
        model.emb[:] = 0
        model.dense[:] = 0
        return model
    model.base[0] = 0
    square = [np.full_like(model.emb, 1e-2), *(np.full_like(c, 1e-2) for c in model.conv)]
    square_bias, square_dense, square_base = np.full_like(model.bias, 1e-2), np.full_like(model.dense, 1e-2), np.full(1, 1e-2, np.float32)
    each = min(len(negative), max(NEGATIVES * len(positive), 200))
    epochs = min(max(STEPS // (len(positive) + each), EPOCHS[0]), EPOCHS[1])
    for epoch in range(epochs):
        some = rng.permutation(negative)[:each]
        for i in rng.permutation(np.concatenate([positive, some])):
            _step(model, _padded(table[docs.texts[i]]), int(y[i]), RATE * (1 - epoch / epochs) + 0.005, square, square_bias, square_dense, square_base)
    _calibrate(model, [(docs.languages[i], _logit_of(model, table[docs.texts[i]]), int(y[i])) for i in np.flatnonzero(fold == 0)])
    return model


def _forward(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word vectors, pooled filter values and the places they come from."""
    e = model.emb[x].sum(axis=1)
    n = len(e) - max(WIDTHS) + 1
    pooled, at = [], []
    for w, conv in zip(WIDTHS, model.conv):
        z = sum(e[j:j + n] @ conv[j] for j in range(w))
        at.append(z.argmax(axis=0))
        pooled.append(z[at[-1], np.arange(FILTERS)])
    return e, np.concatenate(pooled), np.stack(at)


def _logit_of(model: Model, ids: np.ndarray) -> float:
    return model.logit(_forward(model, _padded(ids))[1])


def _step(model: Model, x: np.ndarray, y: int, rate: float, square: list, square_bias, square_dense, square_base) -> None:
    """One step of Adagrad on one document; only the words under a pooled value get a gradient."""
    e, pooled, at = _forward(model, x)
    hidden = np.maximum(pooled + model.bias, 0)
    p = 1 / (1 + np.exp(-np.clip(hidden @ model.dense + model.base[0], -30, 30)))
    g = np.float32(p - y)
    g_hidden = g * model.dense * (hidden > 0)
    g_dense = g * hidden + 1e-4 * model.dense
    where, amount = [], []
    for k, (w, conv) in enumerate(zip(WIDTHS, model.conv)):
        gh = g_hidden[k * FILTERS:(k + 1) * FILTERS]
        on = np.flatnonzero(gh)
        if len(on):
            g_conv = np.zeros_like(conv)
            for j in range(w):
                g_conv[j][:, on] = e[at[k][on] + j].T * gh[on]
                where.append(at[k][on] + j)
                amount.append(conv[j][:, on].T * gh[on, None])
            square[1 + k] += g_conv * g_conv
            conv -= rate * g_conv / np.sqrt(square[1 + k])
    for value, grad, sq in ((model.bias, g_hidden, square_bias), (model.dense, g_dense, square_dense), (model.base, np.array([g]), square_base)):
        sq += grad * grad
        value -= rate * grad / np.sqrt(sq)
    if where:
        rows = x[np.concatenate(where)]
        grads = np.repeat(np.concatenate(amount), rows.shape[1], axis=0)
        flat, inverse = np.unique(rows.ravel(), return_inverse=True)
        total = np.zeros((len(flat), DIM), np.float32)
        np.add.at(total, inverse, grads)
        total[flat == 0] = 0
        square[0][flat] += total * total
        model.emb[flat] -= rate * total / np.sqrt(square[0][flat])


def _calibrate(model: Model, held: list[tuple[str, float, int]]) -> None:
    """The logit that best parts the classes (F1), over all languages and for each that has enough of either class."""
    def cut(pairs: list[tuple[float, int]]) -> float | None:
        pairs = sorted(pairs, reverse=True)
        n = sum(y for _, y in pairs)
        if n < 5 or len(pairs) - n < 5:
            return None
        best, hits = (-1.0, 0.0), 0
        for k, (z, y) in enumerate(pairs):
            hits += y
            below = pairs[k + 1][0] if k + 1 < len(pairs) else z - 1
            if below < z and (f := 2 * hits / (k + 1 + n)) > best[0]:
                best = f, (z + below) / 2
        return best[1]

    model.cuts = {"": cut([(z, y) for _, z, y in held]) or 0.0}
    groups: dict[str, list[tuple[float, int]]] = {}
    for name, z, y in held:
        groups.setdefault(name, []).append((z, y))
    for name, pairs in groups.items():
        found = cut(pairs)
        if name and found is not None:
            model.cuts[name] = found


class Scorer:
    """Scores of whole texts under a model; remembers what the filters make of each word, within bounds."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.filters = np.concatenate([c[j] for c in model.conv for j in range(len(c))], axis=1)  # DIM x (1 + 2 + 3) FILTERS
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.made = np.zeros((1024, self.filters.shape[1]), np.float32)  # row 0: no word

    def _learn(self, words: set[str]) -> None:
        if len(self.rows) + len(words) > MOST_KEPT:
            self.clear()
        new = [w for w in words if w not in self.rows]
        n = len(self.rows) + 1
        if n + len(new) > len(self.made):
            self.made = np.concatenate([self.made, np.zeros((max(len(new), len(self.made)), self.made.shape[1]), np.float32)])
        for a in range(0, len(new), 20_000):
            part = new[a:a + 20_000]
            self.made[n + a:n + a + len(part)] = self.model.emb[np.array([features(w) for w in part])].sum(axis=1) @ self.filters
        self.rows.update(zip(new, range(n, n + len(new))))

    def score(self, text: str | None) -> float:
        words = words_of(text)
        pooled = np.full(len(WIDTHS) * FILTERS, -np.inf, np.float32)
        for a in range(0, max(len(words), 1), CHUNK):
            part = words[a:a + CHUNK + max(WIDTHS) - 1]
            new = {w for w in part if w not in self.rows}
            if new:
                self._learn(set(part) if len(self.rows) + len(new) > MOST_KEPT else new)
            ids = np.fromiter(map(self.rows.__getitem__, part), np.int32, len(part))
            ids = _padded(ids) if a + len(part) == len(words) else ids
            n = min(CHUNK, len(ids) - max(WIDTHS) + 1)  # windows that start in this chunk
            column = 0
            for k, w in enumerate(WIDTHS):
                z = self.made[ids[:n], column:column + FILTERS]
                for j in range(1, w):
                    z = z + self.made[ids[j:j + n], column + j * FILTERS:column + (j + 1) * FILTERS]
                column += w * FILTERS
                mine = pooled[k * FILTERS:(k + 1) * FILTERS]
                np.maximum(mine, z.max(axis=0), out=mine)
        logit = self.model.logit(pooled) - self.model.cuts.get(language(words), self.model.cuts[""])
        return float(1 / (1 + np.exp(-np.clip(logit, -50, 50))))


def is_held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the id as text is divisible by 5; a null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> bytes:
    """A classifier fitted on at most ``sample`` labelled rows outside the held-out fold.

    They are those with the smallest hashes of their ids, so that the same rows
    give the same model.  One task sees the sample's texts; the driver only the
    model.  Rows without id or label are left out; without labels of both
    classes every text gets the same score.
    """
    picked = labels.select(F.col(id_col).alias("id__"), F.col(label_col).cast("int").alias("y")) \
        .where(F.col("y").isin(0, 1) & F.col("id__").isNotNull() & ~is_held_out(F.col("id__"))).groupBy("id__").agg(F.max("y").alias("y")) \
        .orderBy(F.xxhash64("id__"), "id__").limit(sample)
    rows = docs.select(F.col(id_col).alias("id__"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id__")
    # one partition of a bounded sample, in an order of its own
    rows = small_batches(rows).repartition(1).sortWithinPartitions(F.xxhash64("id__"), "id__", F.xxhash64("text")).select("text", "y")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Sample()
        for b in it:
            for t, y in zip(b.column("text"), b.column("y")):
                rows.add(words_of(t.as_py()), y.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([fit(rows).dump()], pa.binary())], ["model"])

    made = rows.mapInArrow(batches, "model binary").first()
    return made[0] if made else fit(Sample()).dump()


def score(docs: DataFrame, model: bytes, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep`` columns and ``score`` of every row's whole text; null counts as empty.  No shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = small_batches(docs.select(*keep, docs[text_col].alias("text__")))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model.load(sent.value))
        for batch in it:
            scores = [scorer.score(t.as_py()) for t in batch.column("text__")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores, pa.float64())], [*keep, "score"])

    return rows.mapInArrow(batches, rows.drop("text__").schema.add("score", "double"))


def without_toxic(docs: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """The rows whose score is under 0.5, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model.load(sent.value))
        for batch in it:
            yield batch.filter(pa.array([scorer.score(t.as_py()) < 0.5 for t in batch.column(text_col)], pa.bool_()))

    return small_batches(docs).mapInArrow(batches, docs.schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity."""
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't rejected as toxic."""
    return without_toxic(docs, train(docs, read(spark, sf_dir, "labels")))
