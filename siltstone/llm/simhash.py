"""SimHash near-dedup: fingerprints, pigeonhole blocks, Hamming check, linked groups.

Two fingerprints that differ in at most `distance` bits agree on at least `blocks - distance` of
`blocks` bit blocks. Each distinct fingerprint is filed once for each choice of that many blocks
(35 choices of 3 of 7 blocks by default: keys of 27 or 28 bits), so close pairs meet in a
bucket. A bucket gives a spanning forest of its links, never all pairs. A bucket of more than
`bucket` fingerprints isn't gathered at all: there, two fingerprints are linked through the
values at most distance/2 bits from both, which are as many for each fingerprint however large
the bucket is. No link is lost either way. Groups come from alternating large-star and
small-star rounds over tables in the shared folder.

Defined cases: null, empty and blank texts have fingerprint zero and link like any other;
repeated rows share their group; an empty table gives an empty result; null ids link like others, and a
group's component_id is null only where all its ids are; very long texts are hashed whole, in
stretches; extra columns are ignored by groups(). dedup() keeps one row of each group: one of its
smallest id, null ids last, and of rows that share that id one.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from siltstone.session import spread

from .shared import bounded_batches, discard, strings, table, text_rows, written

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes, width: int = 4) -> int:
    """The majority of each bit over the XXH64 (seed 42) of all shingles, as an unsigned integer."""
    words = bytes(text).translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 15):
        part = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : at + (1 << 15)].tolist(), ends[at : at + (1 << 15)].tolist())], np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed long)."""

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, width) for t in strings(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64), pa.int64())], ["doc_id", "fp"])

    return text_rows(docs).mapInArrow(run, "doc_id long, fp long")


def block_masks(blocks: int, distance: int) -> list[int]:
    """The bit masks of all choices of blocks - distance blocks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    one = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(x) for x in combinations(one, blocks - distance)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Indices of links that connect what is connected at this distance: fewer than values."""
    left, out = np.arange(len(values)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(values[left] ^ values[at]) <= distance
            out += [(at, int(x)) for x in left[near]]
            queue += left[near].tolist()
            left = left[~near]
    return out


def links(distinct: DataFrame, distance: int = 4, blocks: int = 7, bucket: int = 4096) -> DataFrame:
    """Pairs (a, b) of fingerprints that connect exactly those that links connect."""
    masks = block_masks(blocks, distance)
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")) for m in masks])).alias("t", "key"))
    dealt = keyed.repartition("t", "key").sortWithinPartitions("t", "key", "fp")

    def find(batches):
        """Streams the sorted rows; holds one bucket, up to its limit. t >= 0 marks a member of a larger one."""
        rest: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        large: tuple[int, int] | None = None

        def out(a, b, t):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(t, pa.int32())], ["a", "b", "t"])

        def inside(t, key, fp):
            """Links of whole buckets."""
            new = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            start, end = np.concatenate([[0], new]), np.concatenate([new, [len(t)]])
            pairs = []
            size = end - start
            value = fp.view(np.uint64)
            two = start[size == 2]
            near = two[np.bitwise_count(value[two] ^ value[two + 1]) <= distance]
            pairs += zip(fp[near].tolist(), fp[near + 1].tolist())
            for s, e in zip(start[size > 2].tolist(), end[size > 2].tolist()):
                pairs += [(int(fp[s + i]), int(fp[s + j])) for i, j in forest(value[s:e], distance)]
            return pairs

        for batch in batches:
            t, key, fp = (c.to_numpy(zero_copy_only=False) for c in (batch.column("t"), batch.column("key"), batch.column("fp")))
            if not len(t):
                continue
            if large is not None:
                n = int(np.searchsorted(~((t == large[0]) & (key == large[1])), True))
                if n:
                    yield out(fp[:n], key[:n], t[:n])
                t, key, fp = t[n:], key[n:], fp[n:]
                if not len(t):
                    continue
                large = None
            if rest is not None:
                t, key, fp = (np.concatenate([x, y]) for x, y in zip(rest, (t, key, fp)))
            last = int(np.argmax((t == t[-1]) & (key == key[-1])))
            if last:
                pairs = inside(t[:last], key[:last], fp[:last])
                if pairs:
                    yield out([p[0] for p in pairs], [p[1] for p in pairs], np.full(len(pairs), -1))
            rest = (t[last:], key[last:], fp[last:])
            if len(rest[0]) > bucket:
                large = (int(rest[0][0]), int(rest[1][0]))
                yield out(rest[2], rest[1], rest[0])
                rest = None
        if rest is not None and (pairs := inside(*rest)):
            yield out([p[0] for p in pairs], [p[1] for p in pairs], np.full(len(pairs), -1))

    found = written(dealt.mapInArrow(find, "a long, b long, t int"), "simhash-links")
    small = found.filter("t < 0").select("a", "b")
    flips = [0] + [1 << i for i in range(64)] if distance >= 2 else [0]
    if distance >= 4:
        flips += [(1 << i) | (1 << j) for i in range(64) for j in range(i)]
    if distance not in (0, 2, 4):
        raise ValueError("distance: 0, 2 or 4")
    mask_of = F.element_at(F.array(*[F.lit(signed(m)).cast("long") for m in masks]), F.col("t") + 1)
    flip = F.broadcast(found.sparkSession.createDataFrame([(signed(x),) for x in flips], "flip long"))  # 2081 rows
    halfway = found.filter("t >= 0").join(flip, F.col("flip").bitwiseAND(mask_of) == 0).select("t", F.col("a").bitwiseXOR(F.col("flip")).alias("mid"), F.col("a").alias("fp"))
    first = halfway.groupBy("t", "mid").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).filter("b < top").drop("top")
    return small.union(halfway.join(first, ["t", "mid"]).filter("fp <> b").select(F.col("fp").alias("a"), "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): each node of the edges (a, b) with the smallest node it is connected to.

    Every round is a table in the shared folder, so a lost executor costs one round at most. The
    rounds come to an end by themselves: the sum of the smaller ends falls until it is least.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs, state = written(pairs, "components"), None
    while True:
        both = pairs.union(pairs.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        star = both.join(low, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = star.groupBy("a").agg(F.min("b").alias("m"))
        joined = star.join(low, "a")
        small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        before, pairs = pairs, written(small, "components")
        discard(before)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = now


def connected(prints: DataFrame, distance: int, blocks: int, bucket: int) -> DataFrame:
    """(fp, component): each fingerprint of the rows with the smallest one that links lead to."""
    distinct = written(prints.select("fp").distinct(), "simhash-distinct")
    whole = components(links(distinct, distance, blocks, bucket))
    return distinct.join(whole, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("component"))


def groups(docs: DataFrame, width: int = 4, distance: int = 4, blocks: int = 7, bucket: int = 4096) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links lead to) of every row."""
    prints = written(fingerprints(docs, width), "simhash")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = written(least.join(connected(prints, distance, blocks, bucket), "fp"), "simhash-components")
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(ids, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def dedup(docs: DataFrame, width: int = 4, distance: int = 4, blocks: int = 7, bucket: int = 4096) -> DataFrame:
    """docs with one row of each group. Rows are written with their fingerprints and a number each, so
    that the row that stays is told from its equals."""
    bounded_batches(docs.sparkSession)
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    text, doc_id = (f"c{docs.columns.index(c)}" for c in ("text", "doc_id"))
    numbered = spread(plain).withColumn("n", F.monotonically_increasing_id())
    place = names.index(text)

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, width) for t in strings(batch.column(place))], np.uint64)
            yield batch.append_column("fp", pa.array(fp.view(np.int64), pa.int64()))

    rows = written(numbered.mapInArrow(run, StructType([*numbered.schema.fields, StructField("fp", LongType())])), "simhash-rows")
    first = F.min(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).cast("long").alias("id"), F.col("n").alias("n")))
    least = rows.groupBy("fp").agg(first.alias("first")).join(connected(rows, distance, blocks, bucket), "fp")
    stay = least.groupBy("component").agg(F.min("first").alias("first")).select("first.n")
    return rows.join(stay, "n", "left_semi").select(*names).toDF(*docs.columns)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
