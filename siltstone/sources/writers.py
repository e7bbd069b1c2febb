"""Sinks: sorted Parquet, shards with a ledger, formatted CSV, reports."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, order: list[str], mode: str = "errorifexists") -> None:
    """Globally sorted, zstd."""
    df.orderBy(*order).write.mode(mode).option("compression", "zstd").parquet(path)


def shards(df: DataFrame, path: str, rows: int) -> DataFrame:
    """Files of at most `rows` rows, and their ledger (file, n, sha256); a folder with shards is refused."""
    df.write.mode("errorifexists").option("maxRecordsPerFile", rows).option("compression", "zstd").parquet(path)
    spark = df.sparkSession
    n = spark.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n"))
    digests = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select(F.substring_index("path", "/", -1).alias("file"), F.sha2("content", 256).alias("sha256"))
    return n.join(digests, "file")


def csv(df: DataFrame, path: str, places: int = 6) -> None:
    """CSV with floats to a fixed number of places."""
    kinds = dict(df.dtypes)
    df.select(*[F.format_string(f"%.{places}f", F.col(f"`{c}`")).alias(c) if kinds[c] in ("double", "float") else F.col(f"`{c}`") for c in df.columns]).write.option("header", True).csv(path)


def report(value: dict, path: str) -> None:
    """A small JSON report with sorted keys, moved into place when complete."""
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "w", encoding="utf-8") as out:
        json.dump(value, out, ensure_ascii=False, sort_keys=True, indent=2)
        out.write("\n")
    os.replace(temporary, path)


def _cell(value: object) -> str:
    return f"{value:,}" if isinstance(value, int) and not isinstance(value, bool) else f"{value:.4f}" if isinstance(value, float) else "" if value is None else str(value)


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A result table of at most `limit` rows; more are an error, as reports are small."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows for a report")
    line = lambda cells: "| " + " | ".join(c.replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(line([_cell(v) for v in r]) for r in rows)]) + "\n"


def latex(df: DataFrame, limit: int = 1000) -> str:
    """A result table as a LaTeX tabular."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows for a report")
    safe = lambda s: "".join(f"\\{c}" if c in "&%$#_{}" else c for c in s)
    body = "\n".join(" & ".join(safe(_cell(v)) for v in r) + r" \\" for r in rows)
    return f"\\begin{{tabular}}{{{'l' * len(df.columns)}}}\n{' & '.join(map(safe, df.columns))} \\\\\n\\hline\n{body}\n\\end{{tabular}}\n"


def cache(df: DataFrame, path: str, **metadata: object) -> None:
    """A table with its metadata beside it."""
    df.write.parquet(f"{path}/data")
    df.sparkSession.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "metadata string").coalesce(1).write.text(f"{path}/metadata")


def cached(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/data"), json.loads(spark.read.text(f"{path}/metadata").first()[0])


def license_ledger(sources: DataFrame) -> str:
    """YAML of (source, license, url) rows, one entry a source, sorted."""
    return "".join(f"- source: {json.dumps(r.source)}\n  license: {json.dumps(r.license)}\n  url: {json.dumps(r.url)}\n" for r in sources.orderBy("source").collect())
