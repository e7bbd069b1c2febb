"""Token-ID output: Arrow files of equal-length sequences, and reading them back.

A shard holds one range of document ids in ascending order, as two Arrow IPC files. The token
file has record batches of `rows` fixed-size lists of `length` ids (uint16, or uint32 for large
vocabularies) with a list of mask bits beside each; sequence r is row r % rows of batch r // rows,
so a memory map gives any sequence without copying. Only the last sequence of a shard is padded
(mask false). The index file has doc_id, start and n_tokens within the shard. Files are written
under a temporary name and moved when complete: a repeated task replaces its own shard. The
ledger, one row for each shard, gives every shard's first token.

Defined cases: a null text is empty, an empty document is its end id alone; repeated rows are
written once each, ties by text; null ids come first; an empty table has no shards; extra
columns are ignored.
"""

from __future__ import annotations

import posixpath
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .shared import chunks, shared_path, table, text_rows
from .tokens import encoder

LEDGER = "shard int, path string, n_docs long, n_tokens long"


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Writes the token file and the index file of one shard."""

    def __init__(self, uri: str, kind: np.dtype, length: int, rows: int):
        self.fs, self.path = _store(uri)
        self.fs.create_dir(posixpath.dirname(self.path), recursive=True)
        self.length, self.rows, self.kind = length, rows, kind
        self.temporary = f"{self.path}.{uuid.uuid4().hex}"
        ids = pa.list_(pa.from_numpy_dtype(kind), length)
        self.schema = pa.schema([("input_ids", ids), ("mask", pa.list_(pa.bool_(), length))])
        self.out = self.fs.open_output_stream(self.temporary)
        self.writer = pa.ipc.new_file(self.out, self.schema)
        self.held: list[np.ndarray] = []
        self.size = self.n_tokens = 0
        self.docs: tuple[list, list, list] = ([], [], [])

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        for column, value in zip(self.docs, (doc_id, self.n_tokens, len(ids))):
            column.append(value)
        self.held.append(ids)
        self.size += len(ids)
        self.n_tokens += len(ids)
        if self.size >= self.length * self.rows:
            self._flush()

    def _flush(self, last: bool = False) -> None:
        whole = np.concatenate(self.held) if self.held else np.zeros(0, self.kind)
        step, at = self.length * self.rows, 0
        while len(whole) - at >= step:
            self._batch(whole[at : at + step], step)
            at += step
        rest = whole[at:]
        if last and len(rest):
            self._batch(rest, -(-len(rest) // self.length) * self.length)
            rest = rest[:0]
        self.held, self.size = [rest], len(rest)

    def _batch(self, ids: np.ndarray, size: int) -> None:
        padded = np.zeros(size, self.kind)
        padded[: len(ids)] = ids
        mask = np.arange(size) < len(ids)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (padded, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        self._flush(last=True)
        self.writer.close()
        self.out.close()
        index = pa.table({"doc_id": pa.array(self.docs[0], pa.int64()), "start": pa.array(self.docs[1], pa.int64()), "n_tokens": pa.array(self.docs[2], pa.int64())})
        with self.fs.open_output_stream(f"{self.temporary}.docs") as out, pa.ipc.new_file(out, index.schema) as writer:
            writer.write_table(index, max_chunksize=1 << 16)
        self.fs.move(f"{self.temporary}.docs", f"{self.path}.docs")
        self.fs.move(self.temporary, self.path)


def open_file(uri: str):
    """A reader of an Arrow file: memory-mapped where the store is a mounted folder."""
    from pyarrow import fs

    store, path = _store(uri)
    source = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
    return pa.ipc.open_file(source)


def sequence(reader, number: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of one sequence, at random."""
    batch = reader.get_batch(number // rows)
    at, length = number % rows, batch.schema.field("input_ids").type.list_size
    ids = batch.column(0).values[at * length : (at + 1) * length].to_numpy(zero_copy_only=True)
    return ids, batch.column(1).values[at * length : (at + 1) * length].to_numpy(zero_copy_only=False)


def read_documents(uri: str) -> Iterator[tuple[int | None, int, list[np.ndarray]]]:
    """(doc_id, start in the shard, parts of its ids) of each document of a shard, in order."""
    tokens, index = open_file(uri), open_file(f"{uri}.docs")
    number, held, base = -1, np.zeros(0, np.uint16), 0
    for k in range(index.num_record_batches):
        batch = index.get_batch(k)
        for doc_id, start, size in zip(*(batch.column(i).to_pylist() for i in range(3))):
            parts = []
            while size:
                if start >= base + len(held):
                    base, number = base + len(held), number + 1
                    held = tokens.get_batch(number).column(0).values.to_numpy(zero_copy_only=True)
                part = held[start - base : start - base + size]
                parts.append(part)
                start, size = start + len(part), size - len(part)
            yield doc_id, start - sum(map(len, parts)), parts


def write(docs: DataFrame, end_id: int = 2, length: int = 1024, rows: int = 256, vocabulary: str | None = None, path: str | None = None) -> DataFrame:
    """Writes all documents below `path` and returns the ledger with each shard's first token:
    shard, path, n_docs, n_tokens, base. One row a shard goes through the driver."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "tokens")
    ordered = text_rows(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterable[pa.RecordBatch]):
        shard, writer, encode = TaskContext.get().partitionId(), None, encoder(vocabulary)
        uri = f"{path}/shard-{shard:06d}.arrow"
        for ids, texts in chunks(batches):
            for doc_id, own in zip(ids, encode.encode(texts)):
                writer = writer or ShardWriter(uri, encode.type, length, rows)
                writer.add(doc_id, np.append(own, np.array([end_id], own.dtype)))
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": uri, "n_docs": len(writer.docs[0]), "n_tokens": writer.n_tokens}], pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    ledger, base = [], 0
    for row in sorted(ordered.mapInArrow(run, LEDGER).collect(), key=lambda r: r.shard):
        ledger.append((*row, base))
        base += row.n_tokens
    return spark.createDataFrame(ledger, f"{LEDGER}, base long")


def read(ledger: DataFrame) -> DataFrame:
    """doc_id, start (over all shards), n_tokens and ids_crc32 of every written document."""

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for row in batch.to_pylist():
                out: tuple[list, list, list, list] = ([], [], [], [])
                for doc_id, start, parts in read_documents(row["path"]):
                    crc = 0
                    for part in parts:
                        crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                    for column, value in zip(out, (doc_id, row["base"] + start, sum(map(len, parts)), crc)):
                        column.append(value)
                    if len(out[0]) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        out = ([], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = max(1, ledger.count())
    return ledger.repartition(shards).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "documents")))
