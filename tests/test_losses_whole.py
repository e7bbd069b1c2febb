"""Queries that must read every row, on small tables whose other rows decide the result."""

import math

from siltstone.plans import registry


def events(spark, path, rows):
    spark.createDataFrame(rows, "event_id long, event_type string, value double").write.parquet(f"{path}/events.parquet")
    return str(path)


def test_group_weights_use_great_losses(spark, tmp_path):
    d = events(spark, tmp_path, [(0, "a", 1.0), (1, "a", 31.0), (2, "b", 1.0)])
    got = {r["group"]: r.weight for r in registry.QUERIES["group_dro"](spark, d).collect()}
    a, b = math.exp(0.01 * 16), math.exp(0.01)
    assert abs(got["a"] - (0.9 * a / (a + b) + 0.05)) < 1e-9


def test_loss_ratios_use_great_losses(spark, tmp_path):
    d = events(spark, tmp_path, [(0, "a", 1.0), (1, "a", 19.0), (2, "b", 50.0)])
    got = {r.event_type: (r.nll, r.perplexity) for r in registry.QUERIES["loss_ratios"](spark, d).collect()}
    assert got == {"a": (10.0, round(math.exp(10), 2)), "b": (50.0, round(math.exp(20), 2))}
