"""Quality gates: flags, ordered reasons, scores, eligibility and reject logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import keys as K
from siltstone.functions import text as T

# Names of flags that reject a row.
FATAL = ["empty_after_model_cleaning", "extreme_length", "no_bengali_letter", "low_bengali_letter_ratio", "angle_placeholder", "residual_angle_placeholder", "transcript_too_short"]


def flags(**conditions: Column) -> Column:
    """The sorted names of the conditions that hold."""
    return F.array_sort(F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in conditions.items()]), lambda x: x.isNotNull()))


def text_flags(clean: Column, model: Column, script: str = T.BENGALI, longest: int = 100_000, ratio: float = 0.5, transcript: bool = False, words: int = 2) -> Column:
    """The flags of a text; an empty one has no other flag."""
    angle = clean.contains("<") | clean.contains(">")
    residual = F.replace(clean, F.lit("<>"), F.lit(""))
    marked = clean.contains("<>") if transcript else F.lit(False)
    own = flags(
        extreme_length=F.length(model) > longest,
        no_bengali_letter=T.script_letters(model, script) == 0,
        low_bengali_letter_ratio=(T.letters(model) > 0) & (T.script_ratio(model, script) < ratio),
        transcript_inaudible_marker_removed=angle & marked,
        residual_angle_placeholder=angle & marked & (residual.contains("<") | residual.contains(">")),
        angle_placeholder=angle & ~marked,
        transcript_too_short=F.lit(transcript) & (T.script_words(model, script) < words),
    )
    return F.when(model == "", F.array(F.lit("empty_after_model_cleaning"))).otherwise(own)


def fatal(flag_column: Column) -> Column:
    return F.array_sort(F.array_intersect(flag_column, F.array(*map(F.lit, FATAL))))


def first_reason(**conditions: Column) -> Column:
    """The name of the first condition that holds, in the order given; null if none does."""
    out = None
    for name, condition in conditions.items():
        out = F.when(condition, F.lit(name)) if out is None else out.when(condition, F.lit(name))
    return out


def document_reason(text: Column, language_score: Column, script: str = T.BENGALI, shortest: int = 200, longest: int = 100_000, least_score: float = 0.8, ratio: float = 0.6) -> Column:
    """Why a document is rejected: the first rule it breaks. Surrogates can't occur in a Spark string."""
    return first_reason(
        too_short=F.length(text) < shortest,
        too_long=F.length(text) > longest,
        low_language_score=F.coalesce(language_score, F.lit(0.0)) < least_score,
        low_bengali_letter_ratio=T.script_ratio(text, script) < ratio,
        invalid_unicode=text.contains("�"),
        repetitive_lines=T.repetitive_lines(text),
    )


def with_quality_score(df: DataFrame, text: str, raw: Column, synthetic: Column, original: Column, script: str = T.BENGALI, most_latin: float | None = 0.3) -> DataFrame:
    """df with score, flags and removal: additive penalties, a blend for synthetic rows, clamped.

    The statistics are columns of a first step, so that each is computed once. Scores are kept to
    nine places, so that sums of tenths compare with thresholds as written.
    """
    value = F.col(text)
    stats = df.withColumn("_s", F.struct(
        F.greatest(F.lit(1), T.count(value, r"\S")).alias("solid"), T.count(value, script).alias("script"), T.count(value, "A-Za-z").alias("latin"), T.count(value, r"\p{P}\p{S}").alias("marks"),
        F.size(T.words(value)).alias("tokens"), F.length(value).alias("length"), T.longest_run(value).alias("run"), T.ngram_repetition(value).alias("repetition"), (F.trim(F.coalesce(value, F.lit(""))) == "").alias("empty"),
    ))
    s = lambda name: F.col(f"_s.{name}")
    # Flag names and penalties.
    conditions = {
        "low_bangla_ratio": (s("script") / s("solid") < 0.5, 0.35),
        "artifact_placeholder_removed": (raw.rlike("<>|&lt;&gt;"), 0.10),
        "very_short": (s("length") <= 1, 0.25),
        "short_utterance": ((s("length") > 1) & (s("length") <= 3), 0.08),
        "single_short_token": ((s("tokens") == 1) & (s("length") <= 4), 0.10),
        "excessive_same_char_run": (s("run") >= 6, 0.20),
        "high_token_repetition": (s("repetition") >= 0.30, 0.25),
        "punctuation_symbol_dominant": (s("marks") / s("solid") > 0.60, 0.40),
    }
    if most_latin is not None:
        conditions["high_latin_ratio"] = (s("latin") / s("solid") > most_latin, 0.20)
    score = F.lit(1.0) - F.when(s("script") < 1, 0.70).otherwise(0.0)
    for condition, penalty in conditions.values():
        score = score - F.when(condition, penalty).otherwise(0.0)
    made = F.coalesce(synthetic, F.lit(False))
    score = F.when(made & original.isNotNull(), 0.7 * score + 0.3 * original).otherwise(score) - F.when(made & (s("tokens") <= 2), 0.10).otherwise(0.0)
    score = F.when(s("empty"), F.lit(0.0)).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 9))
    none = F.array().cast("array<string>")
    named = flags(**{k: c for k, (c, _) in conditions.items()}, synthetic_too_short=made & (s("tokens") <= 2))
    removal = flags(no_bangla_characters=s("script") < 1, quality_below_minimum=F.col("score") < 0.4, synthetic_quality_below_minimum=made & (F.col("score") < 0.6))
    out = stats.withColumn("score", score).withColumn("flags", F.when(s("empty"), none).otherwise(named))
    return out.withColumn("removal", F.when(s("empty"), F.array(F.lit("empty_after_cleaning"))).otherwise(removal)).drop("_s")


def split_by_reason(df: DataFrame, reason: Column, task: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and the reject log: exclusion_id, task, row_id, reason."""
    marked = df.withColumn("reason", reason)
    rejected = marked.filter("reason is not null").select(K.stable_hash(task, F.col(id_col), F.col("reason")).alias("exclusion_id"), F.lit(task).alias("task"), F.col(id_col).alias("row_id"), "reason")
    return marked.filter("reason is null").drop("reason"), rejected


def parse_bool(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("true", "1", "yes", "y"), F.lit(False))


def standard_label(label: Column, names: dict[str, str], unknown: str = "UNK") -> Column:
    """Labels by name, by name with underscores, or as a code already; others are unknown."""
    lookup = F.create_map(*[F.lit(x) for k, v in {**{v: v for v in names.values()}, **names}.items() for x in (k.lower(), v)])
    key = F.lower(F.trim(label))
    return F.coalesce(F.try_element_at(lookup, key), F.try_element_at(lookup, F.regexp_replace(key, r"[\s\-]+", "_")), F.try_element_at(lookup, F.regexp_replace(key, r"[\s_\-]+", "")), F.lit(unknown))


def keep_labels(df: DataFrame, column: str, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Rows of the labels asked for; an empty result is an error."""
    out = df.filter(F.col(column).isin(*include)) if include else df
    out = out.filter(~F.col(column).isin(*exclude)) if exclude else out
    if out.isEmpty():
        raise ValueError(f"no row of {column} is left")
    return out
