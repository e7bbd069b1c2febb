"""Connected components of rows that share a key, and tables about them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import discard, written


def connected(rows: DataFrame, id_col: str, keys: list[str], blocked: str | None = None) -> DataFrame:
    """(id, component): the smallest id that shared non-null key values lead to. Blocked rows are alone.

    Rows and key values form a bipartite graph, so a value shared by many rows costs a row each,
    not pairs. Every round passes minima through values and back; minima combine before shuffling.
    """
    free = rows.filter(~F.coalesce(F.col(blocked), F.lit(False))) if blocked else rows
    links = free.select(F.col(id_col).alias("id"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in keys])).alias("x")).select("id", "x.*").filter("value is not null")
    links = written(links.distinct(), "links")
    before = labels = written(rows.select(F.col(id_col).alias("id"), F.col(id_col).alias("component")).distinct(), "labels")
    while True:  # minima only fall, so the rounds come to an end
        low = links.join(labels, "id").groupBy("kind", "value").agg(F.min("component").alias("m"))
        own = links.join(low, ["kind", "value"]).groupBy("id").agg(F.min("m").alias("m"))
        # jump: a row's component may itself have found a smaller one
        moved = labels.join(own, "id", "left").select("id", F.least("component", "m").alias("component"), F.col("component").alias("before"))
        jump = moved.select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = written(moved.join(jump, "component").select("id", F.least("component", "further").alias("component"), "before"), "labels")
        discard(before)
        before, labels = new, new.select("id", "component")
        if new.filter("component <> before").isEmpty():
            discard(links)
            return labels


def component_ids(labels: DataFrame, width: int = 4096) -> DataFrame:
    """(component, component_id, row_count): the id is a digest of the sorted member ids.

    A component of up to `width` members is digested at once; a larger one in buckets by hash, whose
    digests are then digested, so that no row lists all members.
    """
    size = labels.groupBy("component").agg(F.count("*").alias("row_count"))
    rows = labels.join(size, "component").withColumn("bucket", F.pmod(F.xxhash64("id"), F.ceil(F.col("row_count") / width)))
    whole = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\u001f"), 256)
    parts = rows.groupBy("component", "row_count", "bucket").agg(whole(F.col("id").cast("string")).alias("digest"))
    out = parts.groupBy("component", "row_count").agg(F.min("digest").alias("one"), whole(F.col("digest")).alias("all"))
    return out.select("component", F.when(F.col("row_count") <= width, F.col("one")).otherwise(F.col("all")).alias("component_id"), "row_count")
