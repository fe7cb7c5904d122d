"""Properties on the given tables (sf0.001): gates, partitioning, bounds, plan shape."""
from conftest import SF_SMALL
from pyspark.sql import functions as F

from credsweep.operators.lines import lines
from credsweep.operators.rules import rule_hits
from credsweep.plans.scan import scan
from credsweep.sources.tables import corpus


def test_gates_do_not_change_hits(spark):
    ls = lines(corpus(spark, SF_SMALL))
    cols = ["doc_id", "line_num", "rule_id", "match", "secret"]
    a = rule_hits(ls, use_gates=True).select(*cols)
    b = rule_hits(ls, use_gates=False).select(*cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert a.count() > 0


def test_scan_properties(spark):
    docs = corpus(spark, SF_SMALL)
    f = scan(docs).cache()
    assert f.count() > 0
    assert f.where((F.col("confidence") < 0) | (F.col("confidence") > 100)).count() == 0
    assert f.groupBy("doc_id", "line", "rule").count().where("count > 1").count() == 0
    assert f.select("rule").distinct().count() > 60
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    g = scan(docs)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert f.exceptAll(g).count() == 0 and g.exceptAll(f).count() == 0
    f.unpersist()


def test_plan_shape(spark):
    plan = scan(corpus(spark, SF_SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    # one exchange for split values, one for the windows within a line, one for the rank
    assert plan.count("Exchange hashpartitioning") <= 3


def test_stages_prune(spark):
    """A query for one family holds nothing of the others."""
    from credsweep.plans import registry
    plan = registry.QUERIES["D1_decode_base64"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "jdbc" not in plan and "AKIA[0-9A-Z]" not in plan
    plan = registry.QUERIES["X7_first_per_line_rule"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "json_extract" not in plan
