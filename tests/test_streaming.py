"""Streaming scan equals the batch scan of the same documents."""
from conftest import docs_df
from test_goldens import GOLDEN_DOCS

from credsweep.plans.scan import scan
from credsweep.streaming.stream_scan import read_findings, scan_stream


def test_stream_matches_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    docs = docs_df(spark, GOLDEN_DOCS)
    docs.where("doc_id <= 3").write.parquet(src + "/a")
    docs.where("doc_id > 3").write.parquet(src + "/b")
    q = scan_stream(spark, src, out, checkpoint_location=str(tmp_path / "ck"))
    q.awaitTermination(300)
    # a restart with the same location has nothing left to do and loses nothing
    scan_stream(spark, src, out, checkpoint_location=str(tmp_path / "ck")).awaitTermination(300)
    got = read_findings(spark, out).drop("epoch")
    want = scan(docs)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
