"""Queries and operators over whole inputs, against plain versions."""

import random

from pyspark.sql import functions as F

from siltstone.operators import metrics as M
from siltstone.plans import registry


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_shifts(own, ref):
    moves, now = 0, plain_distance(own, ref)
    while now > 1:
        best = (0, own)
        for n in range(1, min(10, len(own)) + 1):
            for i in range(len(own) - n + 1):
                block, rest = own[i : i + n], own[:i] + own[i + n :]
                for j in range(len(ref) - n + 1):
                    if j != i and block != ref[i : i + n] and ref[j : j + n] == block and j <= len(rest):
                        moved = rest[:j] + block + rest[j:]
                        best = max(best, (now - plain_distance(moved, ref), moved), key=lambda x: x[0])
        if best[0] <= 1:
            break
        own, now, moves = best[1], now - best[0], moves + 1
    return now + moves


def texts_of(draw, words, longest):
    return " ".join(draw.choice(words) for _ in range(draw.randrange(longest)))


def test_edits_of_long_texts(spark):
    draw, rows = random.Random(3), []
    for i in range(60):
        a = texts_of(draw, ["ab", "b", "cদ", "𝒳x", "e"], 90)
        b = texts_of(draw, ["ab", "b", "cদ", "𝒳x", "e"], 90) if i % 2 else a[: draw.randrange(len(a) + 1)] + "zz" + a[draw.randrange(len(a) + 1) :]
        rows.append((i, a, b))
    got = {r.i: r.s for r in spark.createDataFrame(rows, "i long, h string, r string").select("i", M.edit_statistics("h", "r").alias("s")).collect()}
    for i, a, b in rows:
        assert got[i][:5] == [plain_distance(a, b), len(b), plain_distance(a.split(), b.split()), len(b.split()), len(a.split())]


def test_shifts_of_long_texts(spark):
    draw, rows = random.Random(4), []
    for i in range(60):
        words = [f"w{k}" for k in range(draw.choice([3, 8, 30]))]
        a = texts_of(draw, words, 30).split()
        b = texts_of(draw, words, 30).split() if i % 3 == 0 else a[len(a) // 2 :] + a[: len(a) // 2] + ["x"] * draw.randrange(3)
        rows.append((i, " ".join(a), " ".join(b)))
    got = {r.i: r.s for r in spark.createDataFrame(rows, "i long, h string, r string").select("i", M.shift_statistics("h", "r").alias("s")).collect()}
    for i, a, b in rows:
        assert got[i] == [plain_shifts(a.split(), b.split()), len(b.split())]


def conversations(spark, path, source, target):
    spark.createDataFrame([(1, 0, "user", source), (1, 1, "assistant", target)], "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return str(path)


def test_text_queries_read_whole_texts(spark, tmp_path):
    words = [f"word{k}" for k in range(100)]
    source, target = " ".join(words), " ".join(words[:60] + words[80:] + words[60:70] + ["other"] * 10)
    d = conversations(spark, tmp_path, source, target)
    r = registry.QUERIES["edit_metrics"](spark, d).first()
    assert r.cer == plain_distance(target, source) / len(source) and r.wer == plain_distance(target.split(), source.split()) / 100
    assert abs(registry.QUERIES["shifted_edit_rate"](spark, d).first().ter - plain_shifts(target.split(), source.split())) < 1e-9 and r.wer > 0
    x = registry.QUERIES["pair_features"](spark, d).first().features
    assert [x[f"{m}.{v}"] for m in ("length", "word_count") for v in ("question", "answer", "upper")] == [len(source), len(target), len(target), 100, 100, 100]
