"""The document gate on a stream.

Stateless: every document is gated and split by hash, then appended to a folder of accepted
documents or one of rejections. Token quotas are global and ordered, so they are applied
afterwards, in batch, over what was accepted (see running_budget and sampling.blocks).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.functions import keys as K


def read(spark: SparkSession, path: str, schema: object, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def gate(stream: DataFrame, reason: Column, id_col: str, per_mille: int = 10) -> DataFrame:
    return stream.withColumn("reason", reason).withColumn("split", K.per_mille_split(F.col(id_col), per_mille))


def append(gated: DataFrame, accepted: str, rejected: str, checkpoint: str) -> StreamingQuery:
    """Runs over all that is there and ends. A repeated batch overwrites its own folder, so each
    document counts once even if a batch is tried again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.filter("reason is null").drop("reason").write.mode("overwrite").parquet(f"{accepted}/batch={number}")
        batch.filter("reason is not null").write.mode("overwrite").parquet(f"{rejected}/batch={number}")
        batch.unpersist()

    return gated.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
