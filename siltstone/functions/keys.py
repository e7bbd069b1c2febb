"""Hashes, splits and arrays on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Splits, most protected first.
SPLIT_RANK = {"test_external": 0, "test_ood": 1, "test": 2, "validation": 3, "train": 4}


def stable_hash(*parts: Column | object) -> Column:
    """SHA-256 of the parts joined by U+001F; a null part reads None."""
    columns = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(c.cast("string"), F.lit("None")) for c in columns]), 256)


def hex_number(digest: Column, digits: int = 16) -> Column:
    """The first hex digits as a whole number."""
    return F.conv(F.substr(digest, F.lit(1), F.lit(digits)), 16, 10).cast("decimal(20,0)")


def unit_interval(digest: Column) -> Column:
    """The first 16 hex digits over 16**16."""
    return hex_number(digest).cast("double") / F.lit(18446744073709551616.0)


def hash_split(key: Column, seed: int, train: float = 0.8, validation: float = 0.1) -> Column:
    value = unit_interval(stable_hash(seed, key))
    return F.when(value < train, "train").when(value < train + validation, "validation").otherwise("test")


def per_mille_split(key: Column, per_mille: int) -> Column:
    value = F.pmod(hex_number(F.sha2(key.cast("string"), 256)), F.lit(1000).cast("decimal(20,0)"))
    return F.when(value < per_mille, "validation").otherwise("train")


def component_split(digest: Column, train: int = 800, validation: int = 900) -> Column:
    bucket = F.pmod(hex_number(digest, 12), F.lit(1000).cast("decimal(20,0)")).cast("long")
    return F.when(bucket < train, "train").when(bucket < validation, "validation").otherwise("test")


def blind_id(*parts: Column | object, digits: int = 20) -> Column:
    return F.substr(stable_hash(*parts), F.lit(1), F.lit(digits))


def protected_split(splits: Column) -> Column:
    """The most protected of an array of splits, train if none is known."""
    rank = F.create_map(*[F.lit(x) for kv in SPLIT_RANK.items() for x in kv])
    known = F.filter(splits, lambda s: F.map_contains_key(rank, s))
    best = F.array_min(F.transform(known, lambda s: F.struct(F.element_at(rank, s).alias("rank"), s.alias("split"))))
    return F.coalesce(best["split"], F.lit("train"))


def unique_sorted(values: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != ""))))


def keep_order(values: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(values, F.trim), lambda x: x != ""))


def json_list(text: Column) -> Column:
    """A JSON array's items; other JSON gives none, what isn't JSON is its own only item."""
    parsed = F.from_json(text, "array<string>")
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).when(parsed.isNotNull(), parsed).when(F.try_parse_json(text).isNotNull(), F.array().cast("array<string>")).otherwise(F.array(text))


def truncated_pair(source: Column, target: Column, budget: int) -> tuple[Column, Column]:
    """Two token arrays cut to a common budget: half for the target (8 at least), and whatever one
    side leaves unused goes to the target."""
    n, m = F.size(source), F.size(target)
    fits = n + m <= budget
    left = F.greatest(F.lit(1), F.lit(budget) - F.least(m, F.lit(max(8, budget // 2))))
    right = F.greatest(F.lit(1), F.lit(budget) - F.least(n, left))
    return F.when(fits, source).otherwise(F.slice(source, 1, left)), F.when(fits, target).otherwise(F.slice(target, 1, right))


def quota(total: int, index: Column, count: int) -> Column:
    """An even split of total over count parts, the first ones taking the remainder."""
    return F.lit(total // count) + F.when(index < total % count, 1).otherwise(0)
