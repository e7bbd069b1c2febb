"""Packing by shortest-pack-first over the length histogram.

Each document (its ids and an end id) is cut into pieces of `size` ids and a rest. The histogram
of piece lengths has `size` entries at most, whatever the input; packing patterns are found on
it alone, longest length first, each length going to the packs that are shortest so far. Pieces
are then given to patterns by their rank among pieces of the same length. Ranks come from
running counts in each task and offsets of tasks, so no length is gathered in one place.

Defined cases: a null or empty text is its end id alone; repeated rows are packed once each; an
empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import chunks, table, text_rows, written
from .tokens import encoder

PIECES = "task int, doc_id long, start long, length int, ids_crc32 long, doc_tokens long, nth long"


def pieces(docs: DataFrame, size: int = 1024, end_id: int = 0, vocabulary: str | None = None) -> DataFrame:
    """The pieces of all documents; nth counts a task's pieces of the same length."""

    def run(batches):
        task, encode, seen = TaskContext.get().partitionId(), encoder(vocabulary), np.zeros(size + 1, np.int64)
        for ids, texts in chunks(batches):
            rows = []
            for doc_id, own in zip(ids, encode.encode(texts)):
                raw = np.append(own.astype("<u4"), np.array([end_id], "<u4"))
                for at in range(0, len(raw), size):
                    part = raw[at : at + size]
                    rows.append((task, doc_id, at, len(part), zlib.crc32(part.tobytes()), len(raw), int(seen[len(part)])))
                    seen[len(part)] += 1
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["task", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "nth"])

    return text_rows(docs).mapInArrow(run, PIECES)


def patterns(histogram: dict[int, int], size: int = 1024) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of each packing pattern, by shortest-pack-first.

    Only packs with room are kept, by the room they have; a length takes as many packs of the
    greatest room as there are, and opens new packs for what remains.
    """
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    done: list[tuple[int, tuple[int, ...]]] = []

    def put(count: int, pack: tuple[int, ...], left: int) -> None:
        (room[left] if left else done).append((count, pack))

    for length in sorted(histogram, reverse=True):
        todo, grown = histogram[length], []
        while todo:
            left = max((x for x, packs in room.items() if packs and x >= length), default=0)
            if not left:
                grown.append((todo, (length,), size - length))
                break
            count, pack = room[left].pop()
            take = min(count, todo)
            if count > take:
                room[left].append((count - take, pack))
            put(take, (*pack, length), left - length)
            todo -= take
        for x in grown:
            fits = 1 + x[2] // length
            full, rest = divmod(x[0], fits)
            if full:
                put(full, (length,) * fits, size - fits * length)
            if rest:
                put(1, (length,) * rest, size - rest * length)
    return done + [x for packs in room.values() for x in packs]


def slots(found: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: where each rank of a length goes."""
    rank: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for count, pack in found:
        offset = 0
        for length in pack:
            rows.append((length, rank[length], base, offset))
            rank[length] += count
            offset += length
        base += count
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, size: int = 1024, end_id: int = 0, vocabulary: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    cut = written(pieces(docs, size, end_id, vocabulary), "pieces")
    counts = written(cut.groupBy("length", "task").count(), "piece-counts")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # size rows at most
    where = spark.sparkContext.broadcast(slots(patterns(histogram, size)))

    def place(batches):
        rows = where.value
        keys = (rows[:, 0] << np.int64(44)) + rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("length", "rank"))
            own = rows[np.searchsorted(keys, (length << np.int64(44)) + rank, "right") - 1]
            columns = [batch.column(x) for x in ("doc_id", "start")] + [pa.array(length)] + [batch.column(x) for x in ("ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(own[:, 2] + rank - own[:, 1]), pa.array(own[:, 3])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    ranked = cut.join(bases, ["length", "task"]).withColumn("rank", F.col("base") + F.col("nth"))
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
