"""Helpers shared by the operators: tables in the shared folder, prefix sums, text bytes."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credsweep.session import checkpoint_dir

#: Words of a text: runs of anything but these six white-space characters.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, read back.

    Cuts the lineage: a lost executor never replays what stands before.  The
    table goes when the session's file system closes.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{what}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_total(df: DataFrame, groups: Sequence[str], order: Sequence[str], value: Column,
                  out: str, buckets: int = 4096) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before this one within its group.

    ``order[0]`` is a 64-bit hash (long) that spreads a group's rows; the rest
    breaks its ties.  A group, however large, is split by the leading bits of
    that hash: the sums of its ``buckets`` parts (aggregated before the shuffle)
    give each part its start, and a window runs within one part only.  Groups
    may be null.  Rows that agree in ``groups`` and ``order`` are interchangeable.
    """
    bits = buckets.bit_length() - 1
    part, total, start = f"{out}__part", f"{out}__total", f"{out}__start"
    # flipping the sign bit makes the unsigned leading bits follow the signed order
    rows = df.withColumn(part, F.shiftrightunsigned(F.col(order[0]).bitwiseXOR(F.lit(-(1 << 63))), 64 - bits).cast("int")) \
        .withColumn(out, value.cast("long"))
    sums = rows.groupBy(*groups, part).agg(F.sum(out).alias(total))
    before = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1) if groups else \
        Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(g).alias(f"{out}__{g}") for g in groups], F.col(part).alias(f"{out}__p"),
                         F.coalesce(F.sum(total).over(before), F.lit(0)).alias(start))
    within = Window.partitionBy(*groups, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col(part) == F.col(f"{out}__p")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"{out}__{g}"))
    inner = rows.withColumn(out, F.coalesce(F.sum(out).over(within), F.lit(0)))
    return inner.join(starts, same).withColumn(out, F.col(out) + F.col(start)) \
        .drop(part, start, f"{out}__p", *[f"{out}__{g}" for g in groups])


def small_batches(df: DataFrame, rows: int = 512) -> DataFrame:
    """``df``, in a session that hands at most ``rows`` rows to Python at a time.

    A batch of the default 10,000 long texts would not fit a worker's memory.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df
