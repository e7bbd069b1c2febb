"""Word rewriting learned from aligned pairs, and updates folded over ordered steps."""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType


def replacements(source: Column, target: Column) -> Column:
    """The words that one word of the source is replaced by, by alignment of the word sequences."""
    kind = ArrayType(StructType().add("word", StringType()).add("other", StringType()))

    @F.pandas_udf(kind)
    def run(source: pd.Series, target: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(source, target):
            a, b = (a or "").split(), (b or "").split()
            moves = SequenceMatcher(a=a, b=b, autojunk=False).get_opcodes()
            out.append([{"word": a[i], "other": b[j]} for kind, i, i2, j, j2 in moves if kind == "replace" and i2 - i == 1 == j2 - j])
        return pd.Series(out)

    return run(source, target)


def learn(pairs: DataFrame, label: str, source: str, target: str, least: int, confidence: float) -> DataFrame:
    """(label, word, other, n, share): the most frequent replacement of each word, ties by name."""
    each = pairs.select(label, F.explode(replacements(F.col(source), F.col(target))).alias("x")).select(label, "x.*")
    n = each.groupBy(label, "word", "other").agg(F.count("*").alias("n"))
    best = n.groupBy(label, "word").agg(F.min(F.struct((-F.col("n")).alias("m"), "other")).alias("b"), F.sum("n").alias("all"))
    return best.select(label, "word", F.col("b.other").alias("other"), (-F.col("b.m")).alias("n"), (-F.col("b.m") / F.col("all")).alias("share")).filter((F.col("n") >= least) & (F.col("share") >= confidence))


def consensus(mapping: DataFrame, label: str) -> DataFrame:
    """Words with the same replacement under all labels that have one."""
    return mapping.groupBy("word").agg(F.min("other").alias("other"), F.max("other").alias("_top"), F.countDistinct(label).alias("labels")).filter("other = _top").drop("_top")


def apply_map(df: DataFrame, id_col: str, label: str, text: str, mapping: DataFrame) -> DataFrame:
    """(id, rewritten): every word that the label's mapping has is replaced; a shuffled join, for maps of any size."""
    words = df.select(id_col, label, F.posexplode(F.split(F.trim(text), r"\s+")).alias("at", "word"))
    j = words.join(mapping.select(label, "word", "other"), [label, "word"], "left")
    grouped = j.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("other", "word").alias("w")))).alias("ws"))
    return grouped.select(id_col, F.array_join(F.transform("ws", lambda x: x["w"]), " ").alias("rewritten"))


def dro_weights(df: DataFrame, group: str, loss: str, order: str, block: int = 500, eta: float = 0.01, mix: float = 0.1, ratio: float = 4.0) -> DataFrame:
    """(step, group, weight): multiplicative group weights, floored and renormalized after each batch.

    Batches are blocks of the order column; their means combine before the shuffle. The update itself is
    sequential over batches: one task takes a row a batch and group, sorted on disk where they are many,
    and keeps a weight for each group. Groups are a table of labels.
    """
    means = df.groupBy(F.floor(F.col(order) / block).alias("step"), F.col(group).alias("group")).agg(F.avg(loss).alias("loss"))
    names = sorted(r[0] for r in df.select(group).distinct().collect())

    def run(frames):
        weights, step, losses = dict.fromkeys(names, 1 / max(len(names), 1)), None, {}

        def advance() -> list:
            nonlocal weights
            grown = {k: w * math.exp(eta * min(losses.get(k, 0.0), 20.0)) for k, w in weights.items()}
            total = max(sum(grown.values()), 1e-9)
            mixed = {k: (1 - mix) * w / total + mix / len(names) for k, w in grown.items()}
            mean = sum(mixed.values()) / len(names)
            kept = {k: min(max(w, mean / ratio), mean * ratio) for k, w in mixed.items()}
            total = max(sum(kept.values()), 1e-9)
            weights = {k: w / total for k, w in kept.items()}
            return [(step, k, w) for k, w in weights.items()]

        for frame in frames:
            rows = []
            for at, name, value in zip(frame["step"], frame["group"], frame["loss"]):
                if at != step and step is not None:
                    rows += advance()
                    losses = {}
                step = int(at)
                losses[name] = value
            yield pd.DataFrame(rows, columns=["step", "group", "weight"])
        if step is not None:
            yield pd.DataFrame(advance(), columns=["step", "group", "weight"])

    return means.repartition(1).sortWithinPartitions("step").mapInPandas(run, "step long, group string, weight double")


def select_checkpoints(df: DataFrame, run: str, order: str, value: str, tie: str, tolerance: float = 0.0, lower_is_better: bool = True) -> DataFrame:
    """(run, selected): the step a run keeps when each new one is taken if it is within tolerance of
    the best value so far and better by the tie-break, or the kept one has fallen out of tolerance."""
    sign = 1.0 if lower_is_better else -1.0
    steps = df.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(F.col(order).cast("double").alias("s"), (sign * F.col(value)).cast("double").alias("v"), F.col(tie).cast("double").alias("t")))).alias("steps"))
    start = F.struct(F.lit(None).cast("double").alias("s"), F.lit(float("inf")).alias("v"), F.lit(float("inf")).alias("t"), F.lit(float("inf")).alias("best"))

    def step(a, x):
        best = F.least(a["best"], x["v"])
        new = F.struct(x["s"].alias("s"), x["v"].alias("v"), x["t"].alias("t"), best.alias("best"))
        old = F.struct(a["s"].alias("s"), a["v"].alias("v"), a["t"].alias("t"), best.alias("best"))
        fits, kept = x["v"] <= best + tolerance, a["v"] <= best + tolerance
        better = (x["t"] < a["t"]) | ((x["t"] == a["t"]) & (x["v"] < a["v"]))
        return F.when(a["s"].isNull() | (fits & (~kept | better)), new).otherwise(old)

    return steps.select(run, F.aggregate("steps", start, step)["s"].alias("selected"))
