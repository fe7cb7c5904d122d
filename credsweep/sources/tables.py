"""Documents held in tables.

``scan`` takes any DataFrame with (doc_id, filename, text).  These helpers
shape the given tables into that form; only the needed columns are read, so
the parquet scan prunes the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .planted import TASK_DOCS, planted_docs, planted_sql


def as_docs(df: DataFrame, text_col: str, id_col: str, filename_col: str | None = None,
            default_filename: str = "unknown") -> DataFrame:
    """Re-aim any table with a text column to the scanner's input shape; the id keeps its type."""
    fname = F.coalesce(F.col(filename_col).cast("string"), F.lit(default_filename)) if filename_col else F.lit(default_filename)
    return df.select(F.col(id_col).alias("doc_id"),
                     fname.alias("filename"),
                     F.col(text_col).cast("string").alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with ``filename = source`` (``unknown`` where it is null)."""
    return as_docs(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", "doc_id", "source")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select(F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("doc_id"),
                    F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("filename"),
                    F.col("html").alias("text"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select(F.concat_ws("/", F.lit("conversation"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("doc_id"),
                    F.concat(F.lit("conv"), F.col("conv_id").cast("string"), F.lit(".txt")).alias("filename"),
                    F.col("text"))


_PLANTED_TABLES: dict[tuple[str, str], str] = {}


def planted_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planted corpus, written once per application into the checkpoint folder.

    Generating it is one large expression; writing it once lets every
    query of a session read a plain table instead of re-planning it.
    """
    import uuid
    from ..session import checkpoint_dir
    from .files import delete_on_exit
    key = (spark.sparkContext.applicationId, sf_dir)
    path = _PLANTED_TABLES.get(key)
    if path is None:
        path = checkpoint_dir(spark).rstrip("/") + f"/planted-{uuid.uuid4().hex}"
        n = 2 * spark.sparkContext.defaultParallelism
        planted_docs(spark, sf_dir, n).write.parquet(path)
        delete_on_exit(spark, path)
        _PLANTED_TABLES[key] = path
    return spark.read.parquet(path)


def planted_slices(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The planted corpus in slices of whole files of its table, TASK_DOCS documents each, about; documents of one path are in one slice."""
    table = planted_table(spark, sf_dir)
    parts, n = sorted(table.inputFiles()), table.count()
    each = max(1, TASK_DOCS * len(parts) // max(n, 1))
    return [spark.read.schema(table.schema).parquet(*parts[i:i + each]) for i in range(0, len(parts), each)]


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default scan input: ``documents`` plus the planted corpus from ``orders``."""
    return documents(spark, sf_dir).unionByName(
        planted_table(spark, sf_dir).select("doc_id", "filename", "text"))


def corpus_sql() -> str:
    """DuckDB twin of :func:`corpus`."""
    return ("SELECT doc_id, coalesce(source, 'unknown') AS filename, text FROM documents UNION ALL "
            f"SELECT doc_id, filename, text FROM ({planted_sql()})")


def pages_sql() -> str:
    return ("SELECT concat('page/', cast(page_id as varchar)) AS doc_id, "
            "concat(cast(page_id as varchar), '.html') AS filename, html AS text FROM pages")


def conversations_sql() -> str:
    return ("SELECT concat('conversation/', cast(conv_id as varchar), '/', cast(turn as varchar)) AS doc_id, "
            "concat('conv', cast(conv_id as varchar), '.txt') AS filename, text FROM conversations")
