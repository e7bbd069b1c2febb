"""Deduplication, conflict resolution and leakage control.

Windows are partitioned by text keys. Where one key may hold many rows (a text copied often), the
deciding values come from an aggregate with partial sums and are joined back, so that the
adaptive skew join can split the key; windows remain where a full order inside a group is the
feature.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from siltstone.functions import text as T
from siltstone.session import written


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. Aggregates structs, so copies combine before the shuffle."""
    packed = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*[F.col(c) for c in df.columns]).alias("row"))
    return df.withColumn("packed", packed).groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min("packed").alias("p")).select("p.row.*")


def resolve_conflicts(pairs: DataFrame, priority: str, keys: list[str], target: str) -> DataFrame:
    """pairs with `reason`: a source whose best-priority rows disagree on the target loses all rows;
    otherwise rows with another target go. Null for rows that stay."""
    best = pairs.groupBy(*keys).agg(F.min(priority).alias("_best"))
    agreed = pairs.join(best, keys).filter(F.col(priority) == F.col("_best")).groupBy(*keys).agg(F.min(target).alias("_low"), F.max(target).alias("_high"))
    marked = pairs.join(agreed, keys)
    return marked.withColumn("reason", F.when(F.col("_low") != F.col("_high"), "source_maps_multiple_targets_at_best_priority").when(F.col(target) != F.col("_low"), "conflicting_lower_priority_target")).drop("_low", "_high")


def drop_duplicates_logged(df: DataFrame, keys: list[str], order: list[str], id_col: str) -> DataFrame:
    """df with winner_id (the first row of the same keys) and is_winner."""
    first = df.groupBy(*keys).agg(F.min(F.struct(*order, id_col)).alias("_first"))
    return df.join(first, keys).withColumn("winner_id", F.col(f"_first.{id_col}")).withColumn("is_winner", F.col(id_col) == F.col("winner_id")).drop("_first")


def label_conflicts(df: DataFrame, text_keys: list[str], label: str) -> DataFrame:
    """df with `conflict`: some key of the row is seen with more than one label."""
    out, marks = df, []
    for i, key in enumerate(text_keys):
        seen = df.groupBy(key).agg((F.min(label) != F.max(label)).alias(f"_c{i}"))
        out = out.join(seen, key)
        marks.append(F.col(f"_c{i}"))
    condition = marks[0]
    for m in marks[1:]:
        condition = condition | m
    return out.withColumn("conflict", condition).drop(*[f"_c{i}" for i in range(len(marks))])


def inherit_split(df: DataFrame, known: DataFrame, key: str, fallback: Column, rank: dict[str, int]) -> DataFrame:
    """df with `split`: the most protected split that its key has in `known`, else the fallback."""
    table = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])
    best = known.groupBy(key).agg(F.min(F.struct(F.element_at(table, F.col("split")).alias("r"), "split")).alias("_s"))
    return df.join(best, key, "left").withColumn("split", F.coalesce(F.col("_s.split"), fallback)).drop("_s")


def with_contained(docs: DataFrame, patterns: DataFrame, id_col: str, text_col: str, pattern_id: str, pattern_col: str, least: int = 20, max_broadcast_bytes: int = 4 << 20) -> DataFrame:
    """docs with `hits`: the sorted ids of patterns of at least `least` characters that occur in a text.

    Patterns of up to max_broadcast_bytes in all (an automaton takes some fifty bytes for each of theirs in
    every worker) become one automaton that every task runs over its
    texts: a column, without a join. More are joined by shuffle on their first `least` characters,
    see _contained_by_join; ids of documents are then expected to be unique.
    """
    used = patterns.filter(F.length(pattern_col) >= least).select(F.col(pattern_id).alias("_id"), F.col(pattern_col).alias("_p")).distinct()
    size = used.agg(F.coalesce(F.sum(F.octet_length("_p")), F.lit(0))).first()[0]
    if size > max_broadcast_bytes:
        found = _contained_by_join(docs, used, id_col, text_col, pattern_id, least).groupBy(id_col).agg(F.array_sort(F.collect_set(pattern_id)).alias("hits"))
        return docs.join(found, id_col, "left").withColumn("hits", F.coalesce("hits", F.array().cast(found.schema["hits"].dataType)))
    owners: dict[str, list] = {}
    for r in used.collect():
        owners.setdefault(r._p, []).append(r._id)
    shipped, machines = docs.sparkSession.sparkContext.broadcast(owners), {}

    @F.pandas_udf(ArrayType(used.schema["_id"].dataType))
    def run(text: pd.Series) -> pd.Series:
        if not shipped.value:
            return pd.Series([[] for _ in text])
        if not machines:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for pattern, keys in shipped.value.items():
                machine.add_word(pattern, keys)
            machine.make_automaton()
            machines[0] = machine
        return pd.Series([sorted({k for _, keys in machines[0].iter(t or "") for k in keys}) for t in text])

    return docs.withColumn("hits", run(F.col(text_col)))


def contained(docs: DataFrame, patterns: DataFrame, id_col: str, text_col: str, pattern_id: str, pattern_col: str, least: int = 20, max_broadcast_bytes: int = 4 << 20) -> DataFrame:
    """(doc id, pattern id) of patterns of at least `least` characters that occur in a text."""
    found = with_contained(docs.select(id_col, text_col), patterns, id_col, text_col, pattern_id, pattern_col, least, max_broadcast_bytes)
    return found.select(id_col, F.explode("hits").alias(pattern_id)).distinct()


def _contained_by_join(docs: DataFrame, used: DataFrame, id_col: str, text_col: str, pattern_id: str, least: int) -> DataFrame:
    """Every place of every text gives its next `least` characters; those that begin a pattern stay."""
    anchored = used.withColumn("_a", F.substr(F.col("_p"), F.lit(1), F.lit(least)))
    places = docs.filter(F.length(text_col) >= least).select(id_col, F.explode(F.array_distinct(T.windows(F.col(text_col), least))).alias("_a"))
    found = places.join(anchored.select("_a").distinct(), "_a", "left_semi").join(anchored, "_a")
    return found.join(docs.select(id_col, text_col), id_col).filter(F.col(text_col).contains(F.col("_p"))).select(id_col, F.col("_id").alias(pattern_id)).distinct()


def near_matches(query: DataFrame, reference: DataFrame, shortest: int = 20, hamming: int = 6, jaccard: float = 0.9, size: int = 4, ratio: float = 0.8) -> DataFrame:
    """(row_id, match_id, score, kind): the best near match of each query row.

    Both frames have row_id, compact and ordinal. Equal compact texts match with score 1 (first
    reference by ordinal). Else rows that share one of four 16-bit bands of a 64-bit SimHash over
    character n-grams are candidates, kept by length ratio, Hamming distance and finally the exact
    Jaccard similarity of the n-gram sets; ties go to the lowest shared band, then the ordinal.
    Bands lose pairs beyond distance 3 on purpose: that is the operator's definition.

    Each distinct text is searched once, however many rows have it, and a band is joined with a
    class of lengths: a step between classes is wider than the ratio, so texts that it allows are
    in the same class or in neighbouring ones and no candidate is lost.
    """
    refs = reference.filter("compact <> ''")
    exact = query.filter("compact <> ''").join(refs.groupBy("compact").agg(F.min(F.struct("ordinal", "row_id")).alias("m")), "compact").select("row_id", F.col("m.row_id").alias("match_id"), F.lit(1.0).alias("score"), F.lit("compact_exact").alias("kind"))
    sides = query.select("row_id", "compact", "ordinal", F.lit(True).alias("asks")).join(exact.select("row_id"), "row_id", "left_anti").unionByName(refs.select("row_id", "compact", "ordinal", F.lit(False).alias("asks")))
    # Fingerprints are written: both sides read them, and they are the costly part.
    prints = written(fingerprints(sides.filter(F.length("compact") >= shortest), size).withColumn("text", F.sha2("compact", 256)), "fingerprints")
    step = math.log(1.01 / ratio)
    distinct = prints.groupBy("asks", "text", "size", "fp").agg(F.min(F.struct("ordinal", "row_id")).alias("first")).withColumn("span", F.floor(F.log("size") / step))
    banded = distinct.select("*", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda b: _band(F.col("fp"), b))).alias("band", "value"))
    left = banded.filter("asks").drop("asks")
    right = banded.filter("not asks").select(F.col("size").alias("size2"), F.col("fp").alias("fp2"), F.col("first").alias("first2"), F.explode(F.sequence(F.col("span") - 1, F.col("span") + 1)).alias("span"), "band", "value")
    short, long = F.least("size", "size2"), F.greatest("size", "size2")
    pairs = left.join(right, ["band", "value", "span"]).filter((short / long >= ratio) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= hamming))
    lowest = pairs.groupBy("text", F.col("first.row_id").alias("row_id"), F.col("first2.row_id").alias("match_id")).agg(F.min("band").alias("band"), F.min("first2.ordinal").alias("ordinal"))
    # Texts are joined in only for the pairs that are left.
    side = lambda asks, key, name: prints.filter(asks).select(F.col("row_id").alias(key), F.col("compact").alias(name))
    both = lowest.join(side("asks", "row_id", "compact"), "row_id").join(side("not asks", "match_id", "other"), "match_id")
    scored = both.withColumn("score", T.jaccard(T.character_grams(F.col("compact"), size), T.character_grams(F.col("other"), size))).filter(F.col("score") >= jaccard)
    best = scored.groupBy("text").agg(F.min(F.struct(-F.col("score"), "band", "ordinal", "match_id")).alias("m"))
    near = prints.filter("asks").select("row_id", "text").join(best, "text").select("row_id", F.col("m.match_id").alias("match_id"), (-F.col("m.col1")).alias("score"), F.lit("simhash_jaccard").alias("kind"))
    return exact.unionByName(near)


def _band(fp: Column, b: Column) -> Column:
    return F.call_function("shiftrightunsigned", fp, b * 16).bitwiseAND(F.lit(0xFFFF))


def fingerprints(df: DataFrame, size: int = 4) -> DataFrame:
    """df with size and fp: SimHash of the set of character n-grams by blake2b-64, a bit being set at sum >= 0."""
    known: dict[str, bytes] = {}

    @F.pandas_udf(LongType())
    def run(compact: pd.Series) -> pd.Series:
        out = []
        for text in compact:
            grams = {text} if len(text) <= size else {text[i : i + size] for i in range(len(text) - size + 1)}
            grams.discard("")
            new = grams - known.keys()
            if len(known) > 500_000:
                known.clear()
                new = grams
            for g in new:
                known[g] = hashlib.blake2b(g.encode(), digest_size=8).digest()
            bits = np.unpackbits(np.frombuffer(b"".join(map(known.__getitem__, grams)), np.uint8).reshape(-1, 8), axis=1)
            out.append(int(np.packbits(2 * bits.sum(axis=0) >= len(bits)).view(">i8")[0]) if grams else 0)
        return pd.Series(out, dtype="int64")

    return df.withColumn("fp", run(F.col("compact"))).withColumn("size", F.length("compact"))


def thin_groups(df: DataFrame, keys: list[str], order: list[Column], synthetic: Column, beside_real: int = 1, alone: int = 2, least: int = 2) -> DataFrame:
    """df with keep and decision: all real rows stay, of synthetic ones the best few."""
    group = Window.partitionBy(*keys)
    df = df.withColumn("_syn", synthetic.cast("int"))
    df = df.withColumn("_n", F.count("*").over(group)).withColumn("_made", F.sum("_syn").over(group)).withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_syn").orderBy(*order)))
    made, real = F.col("_syn") == 1, F.col("_made") < F.col("_n")
    keep = (F.col("_n") < least) | ~made | (F.col("_rank") <= F.when(real, beside_real).otherwise(alone))
    decision = (
        F.when(F.col("_n") < least, "group_below_thinning_threshold").when(F.col("_made") == 0, "real_only_preserved")
        .when(real, F.when(~made, "mixed_keep_real").when(keep, "mixed_keep_top_synthetic").otherwise("mixed_drop_excess_synthetic"))
        .otherwise(F.when(keep, "synthetic_only_keep_top").otherwise("synthetic_only_drop_excess"))
    )
    return df.withColumn("keep", keep).withColumn("decision", decision).drop("_syn", "_n", "_made", "_rank")
