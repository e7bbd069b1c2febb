"""The gate report against texts that only compaction finds."""

from siltstone.plans import registry


def test_gate_finds_compacted_texts(spark, tmp_path):
    filler = "plain words without anything that a gate would reject " * 6
    secret = "The Quick brown fox, jumps over: the lazy dog"
    rows = [(1, f"{filler} {secret} {filler}"), (2, f"{filler} the-quick BROWN fox jumps   over the lazy dog! {filler}"), (3, filler), (4, f"{filler} tiny secret {filler}")]
    spark.createDataFrame([(i, t, "en", "src0") for i, t in rows], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, secret), (2, "Tiny, secret")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {}
    for r in registry.QUERIES["corpus_gate_report"](spark, str(tmp_path)).collect():
        got[r.outcome] = got.get(r.outcome, 0) + r.n
    assert got == {"protected_text": 1, "protected_compact_text": 1, "accepted": 2}
