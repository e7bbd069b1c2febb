"""Benchmark decontamination: windows of benchmark words, looked up in every training text.

Words are runs of digits, letters a-z (A-Z lower-cased) and characters above U+007F. A window is
`n` consecutive words of an item, or all words of a shorter item. The windows are a hash set that is
broadcast only while the benchmark has at most `max_windows` of them and `max_bytes` of text: about
30 bytes a window and the words once, counted by Spark before anything is gathered. A larger
benchmark is joined by shuffling instead, with the same result. Hashes only preselect: every hit is
compared word by word.

Defined cases: null and empty texts have no words (n_words 0, never contaminated); an item
without words has no window; an empty benchmark hits nothing; repeated items all count, one with a null id
hits but isn't listed; repeated
documents each get their row; very long texts are scanned whole, their word hashes in stretches;
extra columns are ignored by find() and kept by remove_documents() and remove_spans(), which judge
each row by its own text, whatever other rows share its id and also where that is null.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Powers, carried, chunks, mixed, rewritten, table, text_rows

SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, runs array<struct<first:long,last:long>>"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True
_BYTES, _WORDS = Powers(0x9E3779B97F4A7C15), Powers(0xD6E8FEB86659FD93)
_WORD_RE = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return _WORD_RE.findall(bytes(text).lower())


def word_hashes(texts: list[memoryview], stretch: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, each word's start, end, text number and hash."""
    raw = np.frombuffer(b"\x00".join([b"", *texts, b""]), np.uint8)
    low = _LOW[raw]
    inside = _IS_WORD[low]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edges[0::2], edges[1::2]
    hashes, i = np.empty(len(start), np.uint64), 0
    while i < len(start):  # a stretch of words at a time: sums take 8 bytes and more for each byte
        j = max(i + 1, int(np.searchsorted(end, start[i] + stretch, "right")))
        a, b = int(start[i]), int(end[j - 1])
        up, down = _BYTES.get(b - a + 1)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum((low[a:b].astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
        hashes[i:j] = mixed((total[end[i:j] - a] - total[start[i:j] - a]) * down[start[i:j] - a])
        i = j
    first = np.cumsum([1] + [len(t) + 1 for t in texts])
    return low, start, end, np.searchsorted(first, start, "right") - 1, hashes


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n consecutive words."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    up, down = _WORDS.get(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[:-1], out=total[1:])
    return (total[n:] - total[:-n]) * down[: len(hashes) - n + 1]


class Windows:
    """The hash set of benchmark windows, by window length, in arrays: the words of all items as one
    run of bytes, and of each window its hash, its place there and its item."""

    def __init__(self, items: Iterable[tuple[str, str]], n: int):
        places: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        self.names = sorted({item for item, _ in items if item is not None})
        number = {item: k for k, item in enumerate(self.names)} | {None: -1}
        held, size = [], 0
        for item, text in items:
            words = words_of((text or "").encode())
            at = size + np.cumsum([0] + [len(w) + 1 for w in words])
            held += words
            size = int(at[-1])
            width = min(n, len(words))
            _, _, _, _, hashes = word_hashes([memoryview(b" ".join(words))])
            for i, h in enumerate(window_hashes(hashes, width).tolist() if width else ()):
                places[width].append((h, int(at[i]), int(at[i + width]) - 1, number[item]))
        self.words = b" ".join([*held, b""])
        self.sets = {}
        for width, rows in places.items():
            rows.sort()
            keys = np.array([r[0] for r in rows], np.uint64)
            few = np.zeros(1 << 20, bool)
            few[keys >> np.uint64(44)] = True
            self.sets[width] = (keys, *(np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3)), few)

    def owners(self, width: int, key: bytes, found: np.uint64) -> list[int]:
        """The numbers of the items that have the window whose words are `key` and whose hash is `found`."""
        keys, start, end, item, _ = self.sets[width]
        a, b = np.searchsorted(keys, found, "left"), np.searchsorted(keys, found, "right")
        return [int(item[i]) for i in range(a, b) if self.words[start[i] : end[i]] == key]

    def hits(self, texts: list[memoryview]):
        """Words, their owners and starts, which are hit, and the items found in each text."""
        low, start, end, owner, hashes = word_hashes(texts)
        delta = np.zeros(len(start) + 1, np.int64)
        items: dict[int, set[int]] = defaultdict(set)
        for width, (keys, _, _, _, few) in self.sets.items():
            found = window_hashes(hashes, width)
            at = np.flatnonzero(few[found >> np.uint64(44)])
            at = at[np.isin(found[at], keys)]
            for i in at[owner[at] == owner[at + width - 1]].tolist():
                key = b" ".join(low[start[j] : end[j]].tobytes() for j in range(i, i + width))
                if own := self.owners(width, key, found[i]):
                    delta[i] += 1
                    delta[i + width] -= 1
                    items[int(owner[i])].update(own)
        return owner, np.cumsum(delta[:-1]) > 0, items

    def judged(self, texts: list[memoryview]):
        """Numbers of words and of hit words, names of items, and runs of hit words of each text."""
        owner, hit, items = self.hits(texts)
        count, n_hit = np.bincount(owner, minlength=len(texts)), np.bincount(owner[hit], minlength=len(texts))
        base = np.concatenate([[0], np.cumsum(count)])
        runs: list[list[dict]] = []
        for k in range(len(texts)):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], hit[base[k] : base[k + 1]], [0]]).astype(np.int8))) if n_hit[k] else []
            runs.append([{"first": int(a), "last": int(b) - 1} for a, b in zip(edges[0::2], edges[1::2])])
        return count, n_hit, [sorted(self.names[i] for i in items.get(k, ()) if i >= 0) for k in range(len(texts))], runs

    def scan(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))]
        for ids, texts in chunks(batches):
            columns = (ids, *self.judged(texts))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "n_words", "n_hit", "items", "runs"])


def small(benchmark: DataFrame, n: int, max_windows: int, max_bytes: int, item_col: str) -> tuple[DataFrame, Windows | None]:
    """(item, text) rows of a benchmark, and its windows where they are few enough to be shipped."""
    bench = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col("text"), F.lit("")).alias("text")).distinct()
    each = F.greatest(F.lit(1), F.size(_words("text")) - (n - 1))
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.coalesce(F.sum(each), F.lit(0)).alias("windows")).first()
    if size.bytes > max_bytes or size.windows > max_windows:
        return bench, None
    return bench, Windows([(r.item, r.text) for r in bench.collect()], n)


def find(docs: DataFrame, benchmark: DataFrame, n: int = 13, max_windows: int = 1 << 20, max_bytes: int = 32 << 20, item_col: str = "item_id") -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids of items with occurring windows) and runs
    (ranges of hit words, counted from 0) of every document."""
    rows = text_rows(docs)
    bench, found = small(benchmark, n, max_windows, max_bytes, item_col)
    if found is None:
        return _find_by_join(rows, bench, n)
    windows = docs.sparkSession.sparkContext.broadcast(found)

    def scan(batches):
        yield from windows.value.scan(batches)

    return rows.mapInArrow(scan, SCHEMA)


def _words(text):
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def _windows(words, size):
    """Structs (at, key): the place and the joined words of each window of `size` words."""
    return F.transform(
        F.when((size > 0) & (F.size(words) >= size), F.sequence(F.lit(0), F.size(words) - size)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(i.alias("at"), F.concat_ws(" ", F.slice(words, i + 1, size)).alias("key")),
    )


def _find_by_join(rows: DataFrame, bench: DataFrame, n: int, keep_digest: bool = False) -> DataFrame:
    """The same by a shuffled join on the window itself; no side is broadcast."""
    items = bench.select("item", _words("text").alias("w")).withColumn("size", F.least(F.lit(n), F.size("w")))
    keys = items.select("item", "size", F.explode(_windows(F.col("w"), F.col("size"))).alias("x")).select("item", "size", F.col("x.key").alias("key")).distinct()
    sizes = F.broadcast(keys.select("size").distinct())  # n rows at most
    texts = rows.withColumn("h", F.sha2("text", 256))
    at = texts.select("doc_id", "h", _words("text").alias("w")).distinct().crossJoin(sizes)
    at = at.select("doc_id", "h", "size", F.explode(_windows(F.col("w"), F.col("size"))).alias("x")).select("doc_id", "h", "size", "x.*")
    hits = at.join(keys.hint("shuffle_hash"), ["size", "key"])
    marks = hits.select("doc_id", "h", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("size") - 1)).alias("i"), "item")
    found = marks.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("i")).alias("at"), F.array_sort(F.collect_set("item")).alias("items"))
    at_col = F.col("at")
    firsts = F.filter(at_col, lambda i: ~F.array_contains(at_col, i - 1))
    lasts = F.filter(at_col, lambda i: ~F.array_contains(at_col, i + 1))
    runs = F.zip_with(firsts, lasts, lambda a, b: F.struct(a.cast("long").alias("first"), b.cast("long").alias("last")))
    found = found.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), F.size("at").alias("n_hit"), "items", runs.alias("runs"))
    return texts.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left").select(
        *(["h"] if keep_digest else []),
        "doc_id",
        F.size(_words("text")).cast("long").alias("n_words"),
        F.coalesce(F.col("n_hit"), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("runs", F.array().cast("array<struct<first:long,last:long>>")).alias("runs"),
    )


def contaminated():
    """The rule: some word is hit, and at least one word in twenty."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def _by_text(docs: DataFrame, bench: DataFrame, n: int, columns: list[str]) -> DataFrame:
    """docs with columns of find(), by the shuffled join, which is made on distinct texts."""
    texts = docs.select(F.lit(None).cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).distinct()
    found = _find_by_join(texts, bench, n, keep_digest=True).filter("n_hit > 0").select(F.col("h").alias("_h"), *[F.col(c).alias(f"_{c}") for c in columns])
    return docs.withColumn("_g", F.sha2(F.coalesce("text", F.lit("")), 256)).join(found, F.col("_g") == F.col("_h"), "left")


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = 13, max_windows: int = 1 << 20, max_bytes: int = 32 << 20, item_col: str = "item_id") -> DataFrame:
    """docs without the contaminated rows."""
    bench, found = small(benchmark, n, max_windows, max_bytes, item_col)
    if found is None:
        bad = F.coalesce((F.col("_n_hit") > 0) & (20 * F.col("_n_hit") >= F.col("_n_words")), F.lit(False))
        return _by_text(docs, bench, n, ["n_hit", "n_words"]).filter(~bad).select(*[f"`{c}`" for c in docs.columns])
    windows = docs.sparkSession.sparkContext.broadcast(found)

    def judge(texts: list[memoryview]) -> pa.Array:
        count, n_hit, _, _ = windows.value.judged(texts)
        return pa.array(~((n_hit > 0) & (20 * n_hit >= count)))

    return carried(docs, judge)


def without_runs(text: str, runs: list[dict]) -> str:
    """The text, each run of words (from its first to its last character) cut out."""
    raw = text.encode()
    at = [m.span() for m in _WORD_RE.finditer(raw.lower())] if runs else []
    for run in reversed(runs):
        raw = raw[: at[run["first"]][0]] + raw[at[run["last"]][1] :]
    return raw.decode()


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 13, max_windows: int = 1 << 20, max_bytes: int = 32 << 20, item_col: str = "item_id") -> DataFrame:
    """docs, each run of hit words cut out of the texts."""
    bench, found = small(benchmark, n, max_windows, max_bytes, item_col)
    if found is None:

        def cut(batches):
            for batch in batches:
                rows = zip(batch.column("text").to_pylist(), batch.column("_runs").to_pylist())
                yield batch.drop_columns(["_runs"]).set_column(batch.schema.get_field_index("text"), "text", pa.array([t if t is None else without_runs(t, own or []) for t, own in rows], pa.string()))

        joined = _by_text(docs, bench, n, ["runs"]).select(*[f"`{c}`" for c in docs.columns], "_runs")
        return joined.mapInArrow(cut, docs.schema)
    windows = docs.sparkSession.sparkContext.broadcast(found)

    def rewrite(texts: list[memoryview]) -> list[str]:
        return [without_runs(bytes(t).decode(), own) for t, own in zip(texts, windows.value.judged(texts)[3])]

    return rewritten(docs, rewrite)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
iw AS (
  SELECT item, s AS size, unnest(range(1, len(w) - s + 2)) AS pos, w
  FROM (SELECT item, w, least(13, len(w)) AS s FROM i WHERE len(w) > 0)),
k AS (SELECT DISTINCT item, size, array_to_string(w[pos : pos + size - 1], ' ') AS key FROM iw),
dp AS (
  SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS pos
  FROM d, (SELECT DISTINCT size FROM k) WHERE len(w) >= size),
dk AS (SELECT doc_id, size, pos, array_to_string(w[pos : pos + size - 1], ' ') AS key FROM dp),
h AS (SELECT doc_id, item, pos, size FROM dk JOIN k USING (size, key)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hw ON d.doc_id = hw.doc_id LEFT JOIN hi ON d.doc_id = hi.doc_id
"""
