"""Canonical rows, encoded examples and prediction tables as projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import keys as K
from siltstone.functions import text as T


def pair_rows(pairs: DataFrame, source_id: str, label: Column, source: str, target: str, key: Column, seed: int, script: str = T.BENGALI, sentence: int = 4) -> DataFrame:
    """Canonical rows of pairs: ids, text levels of both sides, granularity, group, split, origin, eligibility."""
    levels = pairs.select(key.cast("string").alias("key"), label.alias("label"), F.col(source).alias("source_text_raw"), F.col(target).alias("target_text_raw"))
    for side in ("source", "target"):
        levels = levels.withColumn(f"{side}_text_clean", T.collapse(F.coalesce(f"{side}_text_raw", F.lit(""))))
        levels = levels.withColumn(f"{side}_text_model", T.level_model(F.col(f"{side}_text_clean")))
    return levels.select(
        K.stable_hash(source_id, F.col("key"), F.col("label")).alias("row_id"), F.lit(source_id).alias("source_id"), "label", "source_text_raw", "source_text_clean", "source_text_model", "target_text_raw", "target_text_clean", "target_text_model",
        T.granularity(F.col("source_text_model"), F.col("target_text_model"), sentence, script).alias("granularity"), K.stable_hash("group", F.col("target_text_model")).alias("semantic_group_id"), K.hash_split(F.col("target_text_model"), seed).alias("split"),
        F.lit("hash").alias("split_origin"), F.lit(False).alias("is_synthetic"), F.lit(None).cast("string").alias("parent_row_id"), ((F.col("source_text_model") != "") & (F.col("target_text_model") != "")).alias("normalization_eligible"), F.lit(1.0).alias("sampling_weight"),
    )


def encoded(df: DataFrame, prompt: Column, target: Column, end: int, ignore: int = -100) -> DataFrame:
    """df with input_ids (prompt, target, end) and labels, the prompt's being ignored."""
    ids = F.concat(prompt, target, F.array(F.lit(end)))
    return df.withColumn("input_ids", ids).withColumn("labels", F.concat(F.array_repeat(F.lit(ignore), F.size(prompt)), target, F.array(F.lit(end))))


def prefix_only(df: DataFrame, ignore: int = -100) -> DataFrame:
    """input_ids and labels cut before the first supervised label."""
    first = F.array_position(F.transform("labels", lambda x: x != ignore), True)
    n = F.when(first > 0, first - 1).otherwise(F.size("labels")).cast("int")
    return df.withColumn("input_ids", F.slice("input_ids", 1, n)).withColumn("labels", F.slice("labels", 1, n))


def collated(df: DataFrame, batch: str, pad: int = 0, ignore: int = -100) -> DataFrame:
    """df padded to the longest row of its batch, with attention_mask."""
    longest = df.groupBy(batch).agg(F.max(F.size("input_ids")).alias("_n"))
    j = df.join(longest, batch).withColumn("_m", F.col("_n") - F.size("input_ids"))
    mask = F.concat(F.array_repeat(F.lit(1), F.size("input_ids")), F.array_repeat(F.lit(0), F.col("_m")))
    return j.withColumn("attention_mask", mask).withColumn("input_ids", F.concat("input_ids", F.array_repeat(F.lit(pad), F.col("_m")))).withColumn("labels", F.concat("labels", F.array_repeat(F.lit(ignore), F.col("_m")))).drop("_n", "_m")


def masked(ids: Column, row_id: Column, seed: int, mask_id: int, vocabulary: int, share: int = 15) -> Column:
    """Ids with `share` of 100 chosen by hash: 80 % masked, 10 % replaced by a hashed id, 10 % as they are."""
    draw = lambda i, what, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(what), row_id, i), F.lit(n))
    return F.transform(ids, lambda x, i: F.when(draw(i, "pick", 100) >= share, x).when(draw(i, "kind", 10) < 8, F.lit(mask_id)).when(draw(i, "kind", 10) == 8, draw(i, "id", vocabulary).cast("int")).otherwise(x))


def mixture(components: DataFrame, quotas: DataFrame, key: str, id_col: str, seed: int) -> DataFrame:
    """(position, key, id): each component's quota, repeating its rows in hash order as often as
    needed, all in one order by hash. Quotas are (key, quota)."""
    sizes = components.groupBy(key).agg(F.count("*").alias("_size"))
    ranked = components.select(key, id_col, (F.row_number().over(Window.partitionBy(key).orderBy(K.stable_hash(seed, F.col(id_col)))) - 1).alias("_i"))
    plan = quotas.join(sizes, key)
    rows = ranked.join(plan, key).filter(F.col("_i") < F.col("quota"))
    epochs = rows.select(key, id_col, "_i", "quota", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - 1 - F.col("_i")) / F.col("_size")))).alias("epoch"))
    return epochs.select(key, id_col, "epoch", K.stable_hash(seed, F.col(key), F.col(id_col), F.col("epoch")).alias("place"))


def prediction_table(df: DataFrame, probabilities: str, gold: str, names: list[str]) -> DataFrame:
    """df with prediction, confidence, correct and one prob_ column a class."""
    p = F.col(probabilities)
    at = F.array_position(p, F.array_max(p))
    return df.select(*[c for c in df.columns if c != probabilities], (at - 1).alias("prediction"), F.array_max(p).alias("confidence"), ((at - 1) == F.col(gold)).alias("correct"), *[F.get(p, F.lit(i)).alias(f"prob_{n}") for i, n in enumerate(names)])


def select_by_margin(df: DataFrame, margin: Column, threshold: float, first: str, second: str) -> DataFrame:
    """df with chosen and choice: the first candidate where the margin is above the threshold."""
    own = margin > threshold
    return df.withColumn("choice", F.when(own, first).otherwise(second)).withColumn("chosen", F.when(own, F.col(first)).otherwise(F.col(second)))
