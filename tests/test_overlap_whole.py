"""Overlaps of all sources."""

from siltstone.plans import registry


def test_overlap_has_all_sources(spark, tmp_path):
    rows = [("x", "src0"), ("x", "src7"), ("x", "src7"), ("x", "src9"), ("y", "src7"), ("y", "src9"), ("z", "src1")]
    spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.a, r.b): r.overlap for r in registry.QUERIES["pairwise_overlap"](spark, str(tmp_path)).collect()}
    assert got == {("src0", "src7"): 1, ("src0", "src9"): 1, ("src7", "src9"): 2}
