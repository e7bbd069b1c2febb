"""Components of a whole linked table, against union-find."""

from pyspark.sql import functions as F

from siltstone.operators import components as C
from siltstone.plans import registry


def union_find(links):
    parent, seen = {}, {}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, key in links:
        parent.setdefault(i, i)
        x, y = find(i), find(seen.setdefault(key, i))
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def test_all_orders_are_linked(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", (F.col("l_suppkey") * 1000 + F.col("l_linenumber")).alias("k")).collect()
    got = {r.id: r.component for r in registry.QUERIES["order_components"](spark, sf_dir).collect()}
    assert got == union_find([(r[0], r[1]) for r in rows]) and len(got) == len({r[0] for r in rows})


def test_chains_take_several_rounds(spark):
    links = [(97 * i % 64, i) for i in range(20)] + [(97 * (i + 1) % 64, i) for i in range(20)] + [(100 + i, 50) for i in range(5)]
    got = {r.id: r.component for r in C.connected(spark.createDataFrame(links, "id long, k long"), "id", ["k"]).collect()}
    assert got == union_find(links)
