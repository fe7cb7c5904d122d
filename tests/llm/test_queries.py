import corpus_pipeline
import __spark_entry__ as entry
from credsweep.llm import ngram_join, queries
from credsweep.llm.common import running_total

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_each_operator_is_registered_once():
    names = [n for n in queries.queries()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(names) | {"pipeline"} <= set(entry.queries()) and set(queries.oracle_sql()) <= set(names)


def test_running_total_over_groups(spark):
    rows = [(g, i * 7919 % 101 - 50 << 55, i, i % 5) for g in ("a", None) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, h long, i int, v int")
    got = {(r["g"], r["i"]): r["t"] for r in running_total(df, ["g"], ["h", "i"], F.col("v"), "t", buckets=16).collect()}
    for g in ("a", None):
        total = 0
        for _, _, i, v in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])):
            assert got[g, i] == total
            total += v


def test_pipeline_stages(spark):
    """Every stage's decisions show in the next one's input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, total = docs.columns, docs.count()
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        kept.append(docs.count())
        if name == "near duplicates":
            found = ngram_join.classes(docs).where("n_shingles > 0")
            assert found.select("component_id").distinct().count() == found.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert 0 < kept[1] <= kept[0] <= total and kept[2] == kept[3]
