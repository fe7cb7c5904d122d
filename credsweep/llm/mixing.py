"""Mixing sources to target weights along a time-varying curriculum (native).

Each source has a weight schedule: knots (t, weight) over training time t in
[0, 1], joined by straight lines.  Its integral up to t, scaled to the source's
target, is the cumulative demand for that source's words.  The documents of a
source stand in a fixed shuffled order, pass after pass; inverting the demand at
the word where a document starts gives its training position, and a range sort
by position gives the training order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credsweep.llm.common import n_words, read, running_total, written

#: A schedule's shape: the factor on its weight at knots (t, factor); the shapes have mean 1.
FALLING = ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5))
LEVEL = ((0.0, 1.0), (1.0, 1.0))
RISING = ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5))


def cyclic_schedules(sources: DataFrame, weights: Sequence[float], shapes: Sequence[Sequence[tuple[float, float]]]) -> DataFrame:
    """Schedules for the sources in code point order (null last): weights and shapes repeat.

    Returns ``source, knots`` with knots an array of (t, w).  ``sources`` has one
    row a source, so the one-task window that ranks them sees names only.
    """
    w = Window.orderBy(F.col("source").asc_nulls_last())
    i = (F.row_number().over(w) - 1)
    knots = F.element_at(F.array(*[F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(f * x)).alias("w")) for t, f in shape])
                                   for x, shape in zip(weights, shapes, strict=True)]), (i % len(weights) + 1).cast("int"))
    return sources.select("source", knots.alias("knots"))


def _pieces(knots: Column) -> Column:
    """The schedule's straight pieces with their integrals: array of (t0, t1, w0, w1, area)."""
    return F.transform(F.sequence(F.lit(1), F.size(knots) - 1), lambda i: F.struct(
        F.element_at(knots, i)["t"].alias("t0"), F.element_at(knots, i + 1)["t"].alias("t1"),
        F.element_at(knots, i)["w"].alias("w0"), F.element_at(knots, i + 1)["w"].alias("w1"),
        ((F.element_at(knots, i)["w"] + F.element_at(knots, i + 1)["w"]) / 2
         * (F.element_at(knots, i + 1)["t"] - F.element_at(knots, i)["t"])).alias("area")))


def source_targets(totals: DataFrame, schedules: DataFrame, share: float = 1.0, cap: float = 3.0) -> DataFrame:
    """Each source's target: its weight's share of ``share`` x all words, at most ``cap`` x its words.

    What a cap cuts off goes to the others by weight until none is above: with
    the sources sorted by cap / weight, that level is found from running sums.
    ``totals`` is ``source, source_size``; the integral of a schedule is the
    weight.  A source of weight 0 gets nothing.  One row a source throughout.
    """
    s = totals.join(schedules.withColumnRenamed("source", "source__s"), F.col("source").eqNullSafe(F.col("source__s")), "left").drop("source__s")
    s = s.withColumn("pieces", F.when(F.col("knots").isNotNull(), _pieces(F.col("knots"))))
    s = s.withColumn("weight", F.coalesce(F.aggregate("pieces", F.lit(0.0), lambda a, p: a + p["area"]), F.lit(0.0)))
    everything = Window.partitionBy(F.lit(1))
    s = s.withColumn("limit", F.col("source_size") * F.lit(float(cap))) \
        .withColumn("wanted", F.sum("source_size").over(everything) * F.lit(float(share))) \
        .withColumn("ratio", F.when(F.col("weight") > 0, F.col("limit") / F.col("weight")))
    below = Window.orderBy(F.col("ratio").asc_nulls_last(), F.col("source").asc_nulls_last())
    upto = below.rowsBetween(Window.unboundedPreceding, -1)
    rest = below.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # the level if all sources before this one are full and this one and the rest share what is left
    s = s.withColumn("level", (F.col("wanted") - F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("limit"))).over(upto), F.lit(0.0)))
                     / F.sum("weight").over(rest))
    s = s.withColumn("level", F.min(F.when((F.col("weight") > 0) & (F.col("level") <= F.col("ratio")), F.struct("ratio", "level"))).over(everything)["level"])
    target = F.when(F.col("weight") <= 0, F.lit(0.0)).when(F.col("level").isNull(), F.col("limit")) \
        .otherwise(F.least(F.col("limit"), F.col("level") * F.col("weight")))
    return s.select("source", "source_size", "pieces", "weight", target.alias("target"))


def _position(x: Column, target: Column, weight: Column, pieces: Column) -> Column:
    """The time t at which the source's cumulative demand reaches word ``x``."""
    area = x / target * weight
    start = F.aggregate(
        pieces, F.struct(F.lit(0.0).alias("done"), F.lit(None).cast("double").alias("t")),
        lambda a, p: F.struct(
            (a["done"] + p["area"]).alias("done"),
            F.coalesce(a["t"], F.when((a["done"] + p["area"] >= area) & (p["area"] > 0), _invert(area - a["done"], p))).alias("t")))
    return F.coalesce(start["t"], F.lit(1.0))


def _invert(area: Column, p: Column) -> Column:
    """t within one piece: w0 u + slope u^2 / 2 = area, in the form without cancellation."""
    slope = (p["w1"] - p["w0"]) / (p["t1"] - p["t0"])
    root = F.sqrt(F.greatest(p["w0"] * p["w0"] + 2 * slope * area, F.lit(0.0)))
    return p["t0"] + F.when(area <= 0, F.lit(0.0)).otherwise(2 * area / (p["w0"] + root))


def mix(docs: DataFrame, schedules: DataFrame | None = None, weights: Sequence[float] = (1, 2, 3),
        shapes: Sequence[Sequence[tuple[float, float]]] = (FALLING, LEVEL, RISING), share: float = 1.0,
        cap: int = 3, whole_documents: bool = False, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """One row per document: what the mix takes of it and when.

    Returns ``doc_id, source, size, source_size, target, taken, position,
    passes`` where passes is an array (at most ``cap`` long) of
    (pass, words, position) and ``position`` the first of them (null if the mix
    takes nothing).  ``schedules`` is ``source, knots``; without it weights and
    shapes are dealt over the sources in code point order.

    The words of a source stand in the order of a hash of the id, pass after
    pass, and the first ``target`` of them are taken, so at most one document a
    source is cut; with ``whole_documents`` that one is taken whole in its last
    pass if at least half of it would be.  Null text counts 0 words (nothing to
    take), a null source is a source, repeated rows are documents of their own,
    an empty table gives no rows.  Only ids, sources and sizes are shuffled, and
    a hot source is dealt over 4,096 parts.
    """
    sized = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")), "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, schedules if schedules is not None else
                             cyclic_schedules(totals.select("source"), weights, shapes), share, cap)
    spread = running_total(sized.withColumn("at", F.xxhash64("doc_id")), ["source"], ["at", "doc_id", "size"], F.col("size"), "start")
    rows = spread.join(targets.withColumnRenamed("source", "source__t"), F.col("source").eqNullSafe(F.col("source__t")))
    wanted = F.round("target").cast("long")

    def one_pass(k: Column) -> Column:
        begin = F.col("start") + k * F.col("source_size")
        words = F.greatest(F.least(F.col("size"), wanted - begin), F.lit(0))
        if whole_documents:
            words = F.when(2 * words >= F.col("size"), F.col("size")).otherwise(F.lit(0))
        return F.struct((k + 1).cast("int").alias("pass"), words.cast("long").alias("words"),
                        _position(begin.cast("double"), F.col("target"), F.col("weight"), F.col("pieces")).alias("position"))

    passes = F.filter(F.array(*[one_pass(F.lit(k)) for k in range(cap)]), lambda p: p["words"] > 0)
    rows = rows.withColumn("passes", F.when((F.col("size") > 0) & (F.col("target") > 0), passes)
                           .otherwise(F.array().cast("array<struct<pass:int,words:bigint,position:double>>")))
    return rows.select("doc_id", "source", "size", "source_size", "target",
                       F.aggregate("passes", F.lit(0).cast("long"), lambda a, p: a + p["words"]).alias("taken"),
                       F.try_element_at("passes", F.lit(1))["position"].alias("position"), "passes")


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per document and pass, range-sorted by position: the training order."""
    return mixed.select("doc_id", "source", F.explode("passes").alias("p")) \
        .select("doc_id", "source", F.col("p.pass").alias("pass"), F.col("p.words").alias("words"), F.col("p.position").alias("position")) \
        .orderBy("position", F.xxhash64("doc_id"), "doc_id", "pass")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents mixed by weights 1, 2, 3 over the sources, sorted by training position."""
    mixed = mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position", "passes") \
        .orderBy(F.col("position").asc_nulls_last(), "doc_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for each pass, in training order, whole.

    Documents without words (null, empty or blank text) ask for nothing of any
    source and stay, once each, before the others.  Rows that agree in every
    column are taken together: each of their passes comes once.
    """
    keyed = docs.withColumn("row__m", F.xxhash64(*docs.columns))
    mixed = mix(keyed, whole_documents=True, id_col="row__m", text_col="text", source_col="source")
    once = F.array(F.struct(F.lit(1).alias("pass"), F.lit(0).cast("long").alias("words"), F.lit(None).cast("double").alias("position")))
    taken = mixed.select(F.col("doc_id").alias("row__t"), F.col("source").alias("source__t"),
                         F.explode(F.when(F.col("size") == 0, once).otherwise(F.col("passes"))).alias("pass__m"))
    one = keyed.dropDuplicates(["row__m", "doc_id", "source"])
    kept = one.join(taken, (F.col("row__m") == F.col("row__t")) & F.col("source").eqNullSafe(F.col("source__t")))
    return kept.repartitionByRange(F.col("pass__m.position")).sortWithinPartitions("pass__m.position").select(*docs.columns)
