"""Resampling inference: bootstrap, randomization, multiple testing, agreement.

Replicates are a column, multiplicities a hash of (seed, replicate, group): the same group has
the same draw in every table, so paired systems stay synchronized, and nothing is drawn twice
differently when a task is repeated.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.keys import hex_number, stable_hash, unit_interval


def replicates(groups: DataFrame, n: int) -> DataFrame:
    """groups times n replicates: n rows for each row of sufficient statistics."""
    return groups.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(n))))


def poisson_weight(seed: int, group: Column, replicate: Column) -> Column:
    """A Poisson(1) multiplicity from a hash, 0 to 7."""
    u, edges, total, term = unit_interval(stable_hash(seed, replicate, group)), [], 0.0, 0.36787944117144233
    for k in range(7):
        total += term
        edges.append(total)
        term /= k + 1
    out = F.lit(7)
    for k in range(6, -1, -1):
        out = F.when(u < edges[k], k).otherwise(out)
    return out


def swap_bit(seed: int, group: Column, replicate: Column) -> Column:
    return F.substr(stable_hash(seed, replicate, group), F.lit(1), F.lit(1)).between("0", "7")


def cluster_bootstrap(stats: DataFrame, group: str, numerator: str, denominator: str, n: int, seed: int, by: list[str] = ()) -> DataFrame:
    """(replicate, by, ratio) of weighted sums, null where no group was drawn; one multiplicity a group across all rows of `by`."""
    w = replicates(stats, n).withColumn("_w", poisson_weight(seed, F.col(group), F.col("replicate")))
    return w.groupBy(*by, "replicate").agg(F.try_divide(F.sum(F.col("_w") * F.col(numerator)).cast("double"), F.sum(F.col("_w") * F.col(denominator)).cast("double")).alias("ratio"))


def paired_randomization(stats: DataFrame, group: str, treatment: str, control: str, n: int, seed: int) -> DataFrame:
    """(observed, p_value): sums of differences under sign flips of whole groups; add-one p, two sided."""
    d = stats.groupBy(group).agg(F.sum(F.col(treatment) - F.col(control)).alias("d"))
    observed = d.agg(F.sum("d").alias("observed"))
    null = replicates(d, n).groupBy("replicate").agg(F.sum(F.when(swap_bit(seed, F.col(group), F.col("replicate")), -F.col("d")).otherwise(F.col("d"))).alias("x"))
    return null.crossJoin(F.broadcast(observed)).groupBy("observed").agg(((F.count_if(F.abs("x") >= F.abs("observed") - 1e-12) + 1) / (F.count("*") + 1)).alias("p_value"))


def interval(df: DataFrame, value: str, level: float = 0.95, by: list[str] = ()) -> DataFrame:
    """Percentile interval."""
    tail = (1 - level) / 2
    return df.groupBy(*by).agg(F.percentile(value, F.lit(tail)).alias("low"), F.percentile(value, F.lit(1 - tail)).alias("high"))


def holm(df: DataFrame, p: str, family: list[str], tie: str) -> DataFrame:
    """df with adjusted: Holm's step-down values, running maxima by rank within a family of tests."""
    order = Window.partitionBy(*family).orderBy(p, tie)
    ranked = df.withColumn("_r", F.row_number().over(order)).withColumn("_m", F.count("*").over(Window.partitionBy(*family)))
    step = F.least(F.lit(1.0), (F.col("_m") - F.col("_r") + 1) * F.col(p))
    return ranked.withColumn("adjusted", F.max(step).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_r", "_m")


def kappa(pairs: DataFrame, a: str, b: str, quadratic: bool = False, by: list[str] = ()) -> DataFrame:
    """Cohen's kappa of two columns of whole numbers, unweighted or with quadratic weights."""
    n = pairs.groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    cost = F.pow(F.col("a") - F.col("b"), 2).cast("double") if quadratic else (F.col("a") != F.col("b")).cast("double")
    ra = n.groupBy(*by, "a").agg(F.sum("n").alias("na"))
    rb = n.groupBy(*by, "b").agg(F.sum("n").alias("nb"))
    grid = ra.join(rb, list(by)) if by else ra.crossJoin(F.broadcast(rb))  # one row a rating
    expected = grid.groupBy(*by).agg(F.sum(cost * F.col("na") * F.col("nb")).alias("e"))
    seen = n.groupBy(*by).agg(F.sum(cost * F.col("n")).alias("o"), F.sum("n").alias("t"))
    j = seen.join(expected, list(by)) if by else seen.crossJoin(F.broadcast(expected))
    return j.select(*by, F.when(F.col("e") > 0, 1 - F.col("o") * F.col("t") / F.col("e")).otherwise(F.lit(1.0)).alias("kappa"))


def mutual_information(counts: DataFrame, a: str, b: str, n: str) -> DataFrame:
    """(nmi): mutual information over the geometric mean of both entropies; 0 if either is constant."""
    total = counts.agg(F.sum(n).alias("t"))
    pa = counts.groupBy(a).agg(F.sum(n).alias("na"))
    pb = counts.groupBy(b).agg(F.sum(n).alias("nb"))
    j = counts.filter(F.col(n) > 0).join(pa, a).join(pb, b).crossJoin(F.broadcast(total))
    mi = j.agg(F.sum(F.col(n) / F.col("t") * F.log(F.col(n) * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"))
    h = lambda df, c, name: df.crossJoin(F.broadcast(total)).agg(F.sum(-F.col(c) / F.col("t") * F.log(F.col(c) / F.col("t"))).alias(name))
    m = mi.crossJoin(h(pa, "na", "ha")).crossJoin(h(pb, "nb", "hb"))
    return m.select(F.when((F.col("ha") > 0) & (F.col("hb") > 0), F.col("mi") / F.sqrt(F.col("ha") * F.col("hb"))).otherwise(F.lit(0.0)).alias("nmi"))


def specialization(counts: DataFrame, a: str, b: str, n: str) -> DataFrame:
    """How far the labels a differ in their use of b: (nmi, divergence, purity, load_cv, load_entropy).

    divergence is the mean Jensen-Shannon divergence (base 2) of pairs of labels, purity the share of
    each b's most frequent label, load_cv the coefficient of variation of the b and load_entropy
    their entropy over its bound. Rows are cells of a table of labels, not data.
    """
    cells = counts.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.sum(n).cast("double").alias("n"))
    rows, columns = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"), F.max("n").alias("most"))
    grid = rows.crossJoin(F.broadcast(columns.select("b"))).join(cells, ["a", "b"], "left").select("a", "b", (F.coalesce("n", F.lit(0.0)) / F.col("na")).alias("p"))
    x, y = grid.toDF("a", "b", "p"), grid.toDF("c", "b", "q")
    term = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
    mid = (F.col("p") + F.col("q")) / 2
    pairs = x.join(y, "b").filter("a < c").groupBy("a", "c").agg(F.sum((term(F.col("p"), mid) + term(F.col("q"), mid)) / 2).alias("d"))
    load = columns.crossJoin(F.broadcast(columns.agg(F.sum("nb").alias("t")))).withColumn("s", F.col("nb") / F.col("t"))
    loads = load.agg((F.sum("most") / F.max("t")).alias("purity"), (F.stddev_pop("nb") / F.avg("nb")).alias("load_cv"), F.when(F.count("*") > 1, -F.sum(F.col("s") * F.log("s")) / F.log(F.count("*"))).alias("load_entropy"))
    return mutual_information(cells, "a", "b", "n").crossJoin(F.broadcast(pairs.agg(F.coalesce(F.avg("d"), F.lit(0.0)).alias("divergence")))).crossJoin(F.broadcast(loads))


def table_nmi(table: np.ndarray) -> float:
    joint = table / table.sum()
    a, b = joint.sum(axis=1), joint.sum(axis=0)
    full = joint > 0
    entropies = [-(m[m > 0] * np.log(m[m > 0])).sum() for m in (a, b)]
    if min(entropies) <= 0:
        return 0.0
    return float((joint[full] * np.log(joint[full] / np.outer(a, b)[full])).sum() / np.sqrt(entropies[0] * entropies[1]))


def permuted_tables(table: np.ndarray, n: int, seed: int) -> np.ndarray:
    """n tables as permuting the labels of single rows would give them: both margins stay, and each line
    is a multivariate hypergeometric draw from what the lines before left."""
    draw, left = np.random.default_rng(seed), np.repeat(table.sum(axis=0)[None, :], n, axis=0)
    out = np.zeros((n, *table.shape), np.int64)
    for i, size in enumerate(table.sum(axis=1)):
        for k in range(n):
            out[k, i] = draw.multivariate_hypergeometric(left[k], int(size), method="marginals")
        left = left - out[:, i]
    return out


def label_permutation(rows: DataFrame, label: str, item: str, source: str, n: int = 200, seed: int = 29) -> DataFrame:
    """(nmi, null_mean, null_p95, p_value, conditional_nmi, replicates): the normalized mutual information of
    label and item, against permutations of the labels, with its add-one p-value; and its mean within
    sources, weighted by their rows. Rows are counted in Spark; the table of counts is one row of a task."""
    cells = rows.groupBy(F.col(source).cast("string").alias("source"), F.col(label).cast("string").alias("a"), F.col(item).cast("string").alias("b")).agg(F.count("*").alias("n"))

    def run(frame):
        whole = frame.pivot_table(index="a", columns="b", values="n", aggfunc="sum", fill_value=0).to_numpy().astype(np.int64)
        observed, null = table_nmi(whole), np.array([table_nmi(t) for t in permuted_tables(whole, n, seed)])
        parts = [(g["n"].sum(), table_nmi(g.pivot_table(index="a", columns="b", values="n", aggfunc="sum", fill_value=0).to_numpy())) for _, g in frame.groupby("source")]
        within = sum(w * x for w, x in parts) / sum(w for w, _ in parts)
        return pd.DataFrame([(observed, null.mean(), np.quantile(null, 0.95), (1 + (null >= observed - 1e-12).sum()) / (n + 1), within, n)], columns=["nmi", "null_mean", "null_p95", "p_value", "conditional_nmi", "replicates"])

    return cells.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, "nmi double, null_mean double, null_p95 double, p_value double, conditional_nmi double, replicates long")


def stratified_resample(groups: DataFrame, stratum: str, group: str, n: int, seed: int) -> DataFrame:
    """n replicates of a table of groups (rows of sufficient statistics): in each, every stratum draws as many
    of its groups as it has, with replacement. A draw is a hash of seed, replicate, stratum and place."""
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(group)) - 1
    placed = groups.withColumn("_at", place.cast("long"))
    sizes = placed.groupBy(stratum).agg(F.count("*").alias("_n"))
    draws = sizes.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    pick = F.pmod(hex_number(stable_hash(seed, F.col("replicate"), F.col(stratum), F.col("_j"))), F.col("_n").cast("decimal(20,0)")).cast("long")
    return draws.select(stratum, "replicate", pick.alias("_at")).join(placed, [stratum, "_at"]).drop("_at")
