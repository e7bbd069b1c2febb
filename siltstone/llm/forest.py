"""Approximate nearest neighbours by largest inner product: a hash-prefix forest.

Every vector is scaled by the largest norm and given one more coordinate that makes its length
one, so that the largest inner product is the smallest angle. In each of `trees` trees a vector has
a long hash string of up to `depth` symbols. A symbol is the axis of a random rotation that the
vector is closest to, and the side of it (a cross-polytope hash: at the same selectivity it keeps
near vectors together far more often than signs against planes do).

Prefix tree: a tree's rows are divided by one more symbol as long as more than `leaf` share a
prefix, so leaves have prefixes of different lengths; only rows of larger nodes are divided further.
A query descends in each tree to the leaf that is its longest-prefix match. Then it ascends in all
trees at once: the steps are its strings with one symbol replaced, the last symbol first and closer
axes first, each leading to the leaf of its own longest match; step by step the leaves of all trees
are added until `pool` rows are reached or the steps (`probes` axes a symbol) end. All rows of these
leaves are ranked by inner products. No row is found in any other way.

Leaves are scored where they are: a leaf's rows meet the queries that reached it, in groups of
`leaf` rows and `batch` queries at most, so neither a dense leaf nor a sought-after one gathers in
one task. Equal vectors are one entry with their k + 1 smallest ids, which is all that any result can
show of them, so copies make no hot key.

Defined cases: vectors that are null, empty, zero, hold null or non-finite components, or differ
in length from most vectors take no part, nor do null ids; a repeated row counts once; equal products
are ranked by vec_id, before any cut; a double column is searched in double; a leaf whose `depth`
symbols all agree isn't divided further; fewer candidates than k give fewer rows; an empty table
gives none; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import discard, table, written

FOUND = "q long, entry long, score double"
_FOUND = pa.schema([("q", pa.int64()), ("entry", pa.int64()), ("score", pa.float64())])


def matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(vec_id, v) of the vectors that take part, and their length."""
    v = F.col("v")
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("v")).filter(F.col("vec_id").isNotNull() & (F.size(v) > 0))
    rows = rows.filter(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (size.n if size else 0)), size.n if size else 0


def rescored(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in one way wherever a pair is met."""
    return (x * y).sum(axis=-1)


class Rotations:
    """The random axes of each tree and symbol: orthonormal columns, `width` of them at most."""

    def __init__(self, size: int, seed: int, width: int = 64):
        self.size, self.seed, self.width = size, seed, min(width, size)
        self.known: dict[tuple[int, int], np.ndarray] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def axes(self, tree: int, level: int) -> np.ndarray:
        if (tree, level) not in self.known:
            draw = np.random.default_rng([self.seed, tree, level]).standard_normal((self.size, self.width))
            self.known[tree, level] = np.linalg.qr(draw)[0]
        return self.known[tree, level]

    def closeness(self, x: np.ndarray, tree: int, level: int) -> np.ndarray:
        """How close each row is to each side of each axis."""
        y = x @ self.axes(tree, level)
        return np.concatenate([y, -y], axis=1)


def lifted(x: np.ndarray, longest: float, as_query: bool) -> np.ndarray:
    """Rows with the coordinate that makes their length one (zero for queries)."""
    x = x / longest
    last = np.zeros(len(x)) if as_query else np.sqrt(np.maximum(0, 1 - rescored(x, x)))
    return np.column_stack([x, last])


def strings_of(symbols: np.ndarray) -> list[str]:
    """Rows of symbols as strings, a character each."""
    return ["".join(map(chr, row)) for row in (symbols + 48).tolist()]


def planted(entries: DataFrame, turn: Rotations, size: int, longest: float, trees: int, depth: int) -> DataFrame:
    """(tree, string, entry) of every entry."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = lifted(matrix(part.column("v"), size), longest, False)
                for t in range(trees):
                    symbols = np.stack([turn.closeness(x, t, level).argmax(axis=1) for level in range(depth)], axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(strings_of(symbols)), part.column("entry")], ["tree", "string", "entry"])

    return entries.select("entry", "v").mapInArrow(run, "tree int, string string, entry long")


def leaves(strings: DataFrame, leaf: int, depth: int) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, prefix, entry) with each entry's leaf in each tree, and the inner nodes of each level."""
    done, open_, inner = None, strings, []
    for level in range(1, depth + 1):
        at = open_.withColumn("prefix", F.substring("string", 1, level))
        large = written(at.groupBy("tree", "prefix").count().filter(F.col("count") > (leaf if level < depth else float("inf"))).drop("count"), "forest-nodes")
        small = at.join(large, ["tree", "prefix"], "left_anti").select("tree", "prefix", "entry")
        done = small if done is None else done.union(small)
        if large.isEmpty():
            break
        inner.append(large)
        open_ = written(at.join(large, ["tree", "prefix"], "left_semi").select("tree", "string", "entry"), "forest-open")
    return written(done, "forest-leaves"), inner


def descended(strings: DataFrame, inner: list[DataFrame]) -> DataFrame:
    """Rows with the place at which their (tree, string) leaves the inner nodes: its prefix and level."""
    done, open_ = None, strings
    for level in range(1, len(inner) + 2):
        at = open_.withColumn("prefix", F.substring("string", 1, level))
        ended = at if level > len(inner) else at.join(inner[level - 1], ["tree", "prefix"], "left_anti")
        ended = ended.select(*strings.columns, "prefix", F.lit(level).alias("level"))
        done = ended if done is None else done.union(ended)
        if level <= len(inner):
            open_ = written(at.join(inner[level - 1], ["tree", "prefix"], "left_semi").select(*strings.columns), "forest-descent")
    return done


def asking(queries: DataFrame, turn: Rotations, size: int, longest: float, trees: int, levels: int, probes: int) -> DataFrame:
    """(q, tree, string, close): a query's own string and, of each of its symbols, the closest axes."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x, q = lifted(matrix(part.column("v"), size), longest, True), part.column("entry")
                for t in range(trees):
                    close = [np.argsort(-turn.closeness(x, t, level), axis=1, kind="stable")[:, :probes] for level in range(levels)]
                    each = [strings_of(c) for c in close]
                    yield pa.RecordBatch.from_arrays([q, pa.array(np.full(len(x), t, np.int32)), pa.array(strings_of(np.stack([c[:, 0] for c in close], axis=1))), pa.array([list(c) for c in zip(*each)], pa.list_(pa.string()))], ["q", "tree", "string", "close"])

    return queries.select("entry", "v").mapInArrow(run, "q long, tree int, string string, close array<string>")


def reached(asked: DataFrame, inner: list[DataFrame], sizes: DataFrame, pool: int) -> DataFrame:
    """(q, tree, prefix) of the leaves that queries come to: the leaf of each one's own string and of
    those with one symbol up to that leaf's replaced, step by step in all trees together, until the
    leaves of the steps before hold `pool` rows. Step 0 is the own leaf; then the last symbol comes first."""
    levels = len(inner) + 1
    own = written(descended(asked, inner), "forest-own")
    rank = F.explode(F.sequence(F.lit(2), F.length(F.col("close")[0]))).alias("rank")
    ways = own.filter(F.length(F.col("close")[0]) > 1).select("q", "tree", "string", "close", "level", rank).select("*", F.explode(F.sequence(F.lit(1), "level")).alias("at"))
    other = F.concat(F.substring("string", F.lit(1), F.col("at") - 1), F.substring(F.get("close", F.col("at") - 1), F.col("rank"), F.lit(1)), F.substring("string", F.col("at") + 1, F.lit(levels)))
    step = (levels - F.col("at")) * F.length(F.col("close")[0]) + F.col("rank")
    others = descended(ways.select("q", "tree", other.alias("string"), step.alias("step")), inner)
    columns = ["q", "tree", "prefix", "step"]
    both = own.withColumn("step", F.lit(0)).select(columns).union(others.select(columns))
    matched = written(both.join(sizes, ["tree", "prefix"]).groupBy("q", "tree", "prefix").agg(F.min("step").alias("step"), F.first("rows").alias("rows")), "forest-matched")
    before = Window.partitionBy("q").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = matched.groupBy("q", "step").agg(F.sum("rows").alias("rows")).withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    return matched.join(steps.filter(F.col("before") < pool).select("q", "step"), ["q", "step"]).select("q", "tree", "prefix")


def scored(placed: DataFrame, entries: DataFrame, wanted: DataFrame, queries: DataFrame, sizes: DataFrame, size: int, k: int, leaf: int, batch: int) -> DataFrame:
    """(q, entry, score): the k + 1 best entries of each query in each block of each leaf."""
    asks = wanted.groupBy("tree", "prefix").agg(F.count("*").alias("asks")).join(sizes, ["tree", "prefix"])
    plan = written(asks.select("tree", "prefix", F.ceil(F.col("rows") / leaf).alias("blocks"), F.ceil(F.col("asks") / batch).alias("salts")), "forest-plan")
    rows = placed.join(plan, ["tree", "prefix"]).join(entries.select("entry", "v"), "entry")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("entry"), F.col("blocks"))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    asked = wanted.join(plan, ["tree", "prefix"]).join(queries.select(F.col("entry").alias("q"), "v"), "q")
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("q"), F.col("salts"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = ["tree", "prefix", "block", "salt"]

    def score(left, right):
        if not left.num_rows or not right.num_rows:
            return _FOUND.empty_table()
        x, e = matrix(left.column("v"), size), left.column("entry").to_numpy()
        y, q = matrix(right.column("v"), size), right.column("q").to_numpy()
        out: tuple[list, list, list] = ([], [], [])
        for at in range(0, len(q), 64):
            near = y[at : at + 64] @ x.T
            take = min(k + 1, len(e))
            edge = np.partition(near, -take, axis=1)[:, -take]
            for i, (row, least) in enumerate(zip(near, edge)):
                # those that a last rounding could bring in are compared exactly; ties go to smaller entries
                own = np.flatnonzero(row >= least - 1e-9 * (1 + abs(least)))
                exact = rescored(x[own], y[at + i])
                best = np.lexsort((e[own], -exact))[:take]
                out[0].append(np.full(len(best), q[at + i]))
                out[1].append(e[own[best]])
                out[2].append(exact[best])
        return pa.table([pa.array(np.concatenate(c)) for c in out], schema=_FOUND)

    met = asked.select(*key, "q", "v").toDF("t", "p", "b", "s", "q", "v")  # names of its own: both sides come from the same entries
    return rows.select(*key, "entry", "v").groupBy(*key).cogroup(met.groupBy("t", "p", "b", "s")).applyInArrow(score, FOUND)


def search(vectors: DataFrame, query: object, k: int = 20, trees: int = 10, probes: int = 10, leaf: int = 512, pool: int = 65536, depth: int = 16, batch: int = 512, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score; query is a condition on vec_id that names the queries."""
    spark = vectors.sparkSession
    rows, size = usable(vectors, id_col, vector_col)
    rows = rows.withColumn("h", F.xxhash64("v"))
    copies = rows.distinct().withColumn("n", F.row_number().over(Window.partitionBy("h", "v").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    entries = written(copies.groupBy("h", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("entry", F.col("ids")[0]), "forest-entries")
    shape = entries.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("norm")).first()
    if not shape.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    longest = math.sqrt(shape.norm)
    asked = written(rows.filter(query).join(entries.select("h", "v", "entry"), ["h", "v"]).select("vec_id", "entry").distinct(), "forest-queries")
    queries = entries.join(asked.select("entry").distinct(), "entry", "left_semi").select("entry", "v")
    turn = Rotations(size + 1, seed)
    strings = written(planted(entries, turn, size, longest, trees, depth), "forest-strings")
    placed, inner = leaves(strings, leaf, depth)
    discard(strings)
    sizes = written(placed.groupBy("tree", "prefix").agg(F.count("*").alias("rows")), "forest-sizes")
    asks = asking(queries, turn, size, longest, trees, len(inner) + 1, probes)
    wanted = written(reached(asks, inner, sizes, pool), "forest-wanted")
    found = scored(placed, entries, wanted, queries, sizes, size, k, leaf, batch)
    best = found.groupBy("q", "entry").agg(F.max("score").alias("score"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "entry")
    best = written(best.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).drop("n"), "forest-found")
    listed = best.join(entries.select("entry", "ids"), "entry").select("q", "score", F.explode("ids").alias("vec_id"))
    ranked = listed.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).filter(F.col("n") <= k + 1)
    answers = asked.select(F.col("vec_id").alias("query_id"), F.col("entry").alias("q")).join(ranked, "q").filter("vec_id <> query_id")
    own = F.row_number().over(Window.partitionBy("query_id").orderBy("n"))
    return answers.withColumn("rank", own).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
