"""Helpers that the corpus operators share: tables, the shared folder, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.session import discard, shared_path, spread, written

__all__ = ["Powers", "bounded_batches", "carried", "chunks", "discard", "mixed", "rewritten", "shared_path", "strings", "table", "text_rows", "written"]

CHUNK_BYTES = 512 << 10
BATCH_ROWS = 1024  # texts in an Arrow batch: a worker holds one batch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's rows in an Arrow batch to BATCH_ROWS: texts are long, and JVM and
    Python hold a batch each."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the text, null texts as empty ones; other columns are pruned from the scan."""
    bounded_batches(docs.sparkSession)
    return spread(docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col)))


def carried(docs: DataFrame, judge: Callable[[list[memoryview]], pa.Array], text_col: str = "text") -> DataFrame:
    """The rows of docs that judge(texts) is true of, all columns as they were. Rows go through the
    task that judges them, so nothing is joined or shuffled, and neither repeated nor null ids matter."""
    bounded_batches(docs.sparkSession)
    names = [f"c{i}" for i in range(len(docs.columns))]
    place = docs.columns.index(text_col)
    plain = spread(docs.toDF(*names))

    def run(batches):
        for batch in batches:
            for at, part in slices(batch, place):
                yield part.filter(judge(at))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def rewritten(docs: DataFrame, rewrite: Callable[[list[memoryview]], list[str]], text_col: str = "text") -> DataFrame:
    """docs with rewrite(texts) in place of the texts; null texts stay null."""
    bounded_batches(docs.sparkSession)
    names = [f"c{i}" for i in range(len(docs.columns))]
    place = docs.columns.index(text_col)
    plain = spread(docs.toDF(*names))

    def run(batches):
        for batch in batches:
            for texts, part in slices(batch, place):
                column = part.column(place)
                own = [x if keep else None for x, keep in zip(rewrite(texts), column.is_valid().to_pylist())]
                yield part.set_column(place, part.schema.field(place), pa.array(own, column.type))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def slices(batch: pa.RecordBatch, place: int, limit: int = CHUNK_BYTES) -> Iterator[tuple[list[memoryview], pa.RecordBatch]]:
    """(texts, rows) of about `limit` bytes of the text column each."""
    texts, at = strings(batch.column(place)), 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= limit):
            size += len(texts[end])
            end += 1
        yield texts[at:end], batch.slice(at, end - at)
        at = end


def strings(column: pa.Array) -> list[memoryview]:
    """The UTF-8 bytes of each value, without a copy; null is empty."""
    if len(column) == 0:
        return []
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    view = memoryview(data) if data is not None else memoryview(b"")
    return [view[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def chunks(batches: Iterable[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[list[int | None], list[memoryview]]]:
    """(ids, texts) of about `limit` bytes each, so that temporary arrays stay small."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), strings(batch.column(1))
        at = 0
        while at < len(ids):
            end, size = at, 0
            while end < len(ids) and (end == at or size + len(texts[end]) <= limit):
                size += len(texts[end])
                end += 1
            yield ids[at:end], texts[at:end]
            at = end


class Powers:
    """Powers of an odd base modulo 2**64, and those of its inverse."""

    def __init__(self, base: int):
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 1 << 64), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
