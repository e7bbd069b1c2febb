"""Quality by compression: dictionaries built from good and bad texts, sizes compared.

Two zstandard dictionaries are built from labelled texts, one of good and one of bad documents.
A text is cut into blocks of `block` bytes, so that a dictionary counts however long the text is,
and every block is compressed with either dictionary and with none. The score is a calibrated
(logistic) function of the normalised difference of the compressed sizes; further terms are the
size without a dictionary, the mean difference against it and the share of blocks on the bad
side.

The fit takes `sample` labelled rows of each class at most, chosen by hash of the id, and each of
them whole: the first half builds the dictionaries, in the driver; the terms of the other half are
computed where the texts are, and calibrate the score, weighted to the classes' true shares. That
bound on labelled rows is the only one. A line that texts of a class repeat is given to the builder
once: else it would fill the dictionary with where texts are from, not how good they are.

Defined cases: null and empty texts get the score of a text whose terms are all zero; labels that
are null or not 0 or 1 teach nothing; without 16 texts of both classes every score is the share of
good labels (0.5 without any); repeated rows each get their row; of the different texts of one
labelled id the smallest teaches; labels repeated for a document count once each; very long texts
cost time in proportion, one block at a time; extra columns are ignored by score() and kept by
keep().
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import carried, strings, table, text_rows, written

SCHEMA = "doc_id long, score double"


def labelled(docs: DataFrame, labels: DataFrame, column: str, fold, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """A bounded sample of labelled texts, one row for an id and `sample` of each class at most, as a
    table (doc_id, label, text, first half of the sample); and the number of labelled rows of each
    class outside the held-out fold."""
    known = labels.filter(~fold & F.col(column).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = []
    for label in (0, 1):
        rows = known.filter(F.col("label") == label).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
        chosen += [(r.doc_id, label, 2 * k < len(rows)) for k, r in enumerate(rows)]
    picked = docs.sparkSession.createDataFrame(chosen, "doc_id long, label int, half boolean")  # 2 * sample rows at most
    rows = text_rows(docs).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label", "half").agg(F.min("text").alias("text"))
    return written(rows, "labelled"), counts


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic fit, the last one the constant, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (p - y)) + ridge @ w)
        w -= np.clip(step, -10, 10)
        if np.abs(step).max() < 1e-6:
            break
    return w


def calibration(rows: DataFrame, terms, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The terms (a function of a text's bytes) and labels of (text, label) rows, computed in tasks;
    `width` numbers a row come back."""

    def run(batches):
        for batch in batches:
            found = np.array([terms(t) for t in strings(batch.column(0))], np.float64).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([batch.column(1), *map(pa.array, found.T)], ["label", *(f"x{i}" for i in range(width))])

    schema = "label int, " + ", ".join(f"x{i} double" for i in range(width))
    got = np.array(sorted(map(tuple, rows.select("text", "label").mapInArrow(run, schema).collect())), np.float64).reshape(-1, width + 1)
    return got[:, 1:], got[:, 0]


def class_weights(y: np.ndarray, counts: dict[int, int]) -> np.ndarray:
    """Weights that give the classes their shares among all labelled rows."""
    share = [counts[k] / sum(counts.values()) / max(1, (y == k).sum()) for k in (0, 1)]
    return np.where(y == 1, share[1], share[0]) * len(y)


@dataclass
class Model:
    good: bytes
    bad: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    block: int
    level: int

    def compressors(self) -> list:
        found = self.__dict__.get("_compressors")
        if found is None:
            dictionaries = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_AUTO) for d in (self.good, self.bad)]
            for d in dictionaries:
                d.precompute_compress(level=self.level)
            options = {"level": self.level, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
            found = [zstandard.ZstdCompressor(dict_data=d, **options) for d in dictionaries] + [zstandard.ZstdCompressor(**options)]
            self.__dict__["_compressors"] = found
        return found

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_compressors"}

    def terms(self, text: bytes | memoryview) -> list[float]:
        n = len(text)
        if not n:
            return [0.0] * 4
        good, bad, none = self.compressors()
        g = b = z = worse = 0
        for at in range(0, n, self.block):
            part = text[at : at + self.block]
            x, y, v = len(good.compress(part)), len(bad.compress(part)), len(none.compress(part))
            g, b, z = g + x, b + y, z + v
            worse += (y < x) * len(part)
        return [(b - g) / n, z / n, (z - (b + g) / 2) / n, worse / n]

    def score(self, texts: list) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(texts), float(self.mean[0]))
        x = (np.array([self.terms(t) for t in texts]).reshape(-1, 4) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def dictionary(texts: list[bytes], size: int, block: int) -> bytes:
    """A dictionary from all blocks of the distinct lines of the texts."""
    whole = b"\n".join(dict.fromkeys(line for t in texts for line in t.split(b"\n")))
    parts = [whole[i : i + block] for i in range(0, len(whole), block)]
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:  # too little text to choose from
        return (b"\n" * 64 + whole)[-size:]


def fit(docs: DataFrame, labels: DataFrame, held_out, column: str = "quality", sample: int = 3000, dictionary_bytes: int = 32 << 10, block: int = 2048, level: int = 3) -> Model:
    """The model; held_out is a condition on doc_id, and rows where it holds teach nothing."""
    rows, counts = labelled(docs, labels, column, held_out, sample)
    useful = rows.filter("text <> ''")
    sizes = {r.label: r["count"] for r in useful.groupBy("label").count().collect()}
    if min(sizes.get(k, 0) for k in (0, 1)) < 16:
        total = sum(counts.values())
        return Model(b"", b"", np.array([counts.get(1, 0) / total if total else 0.5]), np.ones(1), np.zeros(0), block, level)
    built = []
    for label in (0, 1):  # sample / 2 whole texts at once
        texts = [r.text.encode() for r in useful.filter(F.col("half") & (F.col("label") == label)).orderBy(F.xxhash64("doc_id"), "doc_id").select("text").toLocalIterator()]
        built.append(dictionary(texts, dictionary_bytes, block))
    bad, good = built
    model = Model(good, bad, np.zeros(4), np.ones(4), np.zeros(0), block, level)
    x, y = calibration(useful.filter(~F.col("half")), model.terms, 4)
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    model.weights = logistic((x - model.mean) / model.scale, y, class_weights(y, counts))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row; the whole text counts."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shipped.value.score(strings(batch.column(1))), pa.float64())], ["doc_id", "score"])

    return text_rows(docs).mapInArrow(run, SCHEMA)


def keep(docs: DataFrame, labels: DataFrame, held_out, threshold: float = 0.7, **options) -> DataFrame:
    """docs without the rows scored below the threshold. A row is judged by its own text, whatever
    other rows share its id, and passes through without a shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, held_out, **options))

    def judge(texts: list) -> pa.Array:
        return pa.array(shipped.value.score(texts) >= threshold)

    return carried(docs, judge)


def fold(modulus: int, remainder: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), fold(4, 2)
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels"), held))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
