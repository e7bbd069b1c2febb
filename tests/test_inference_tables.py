"""Tables of labels: specialization, permutations, temperature and token mixtures, against plain versions."""

import math
import random

import numpy as np

from siltstone.operators import inference as I
from siltstone.operators import metrics as M
from siltstone.operators import sampling as S


def test_permuted_tables_match_permutations():
    draw = random.Random(5)
    labels, items = [draw.choice("xxyz") for _ in range(300)], [draw.choice("abc") for _ in range(300)]
    table = lambda l: np.array([[sum(p == a and q == b for p, q in zip(l, items)) for b in "abc"] for a in "xyz"])
    own = table(labels)
    drawn = I.permuted_tables(own, 300, 1)
    assert (drawn.sum(axis=1) == own.sum(axis=0)).all() and (drawn.sum(axis=2) == own.sum(axis=1)).all()
    plain = []
    for _ in range(300):
        moved = labels[:]
        draw.shuffle(moved)
        plain.append(I.table_nmi(table(moved)))
    got = [I.table_nmi(t) for t in drawn]
    assert abs(np.mean(got) - np.mean(plain)) < 0.15 * np.mean(plain) and abs(np.quantile(got, 0.9) - np.quantile(plain, 0.9)) < 0.25 * np.quantile(plain, 0.9)


def test_label_permutation(spark):
    draw = random.Random(6)
    rows = [(draw.choice("xyz"), draw.choice("abc"), "s1") for _ in range(400)] + [(x, x, "s2") for x in (draw.choice("xyz") for _ in range(200))]
    df = spark.createDataFrame(rows, "l string, i string, s string")
    bound = I.label_permutation(df.filter("s = 's2'"), "l", "i", "s", 99).first()
    assert abs(bound.nmi - 1) < 1e-9 and bound.p_value == 0.01 and abs(bound.conditional_nmi - 1) < 1e-9
    free = I.label_permutation(df.filter("s = 's1'"), "l", "i", "s", 99).first()
    assert free.p_value > 0.02 and free.nmi < 0.05
    both = I.label_permutation(df, "l", "i", "s", 99).first()
    assert abs(both.conditional_nmi - (400 * free.nmi + 200) / 600) < 1e-9


def test_temperature(spark):
    draw = np.random.default_rng(3)
    z = draw.standard_normal((500, 4)) * 3
    y = np.array([draw.choice(4, p=np.exp(r / 2.5) / np.exp(r / 2.5).sum()) for r in z])
    df = spark.createDataFrame([(r.tolist(), int(k)) for r, k in zip(z, y)] + [(None, 1)], "z array<double>, y int")
    fitted, loss = M.fit_temperature(df, "z", "y")
    nll = lambda t: float(np.mean([math.log(np.exp(r / t).sum()) - r[k] / t for r, k in zip(z, y)]))
    best = min((nll(math.exp(x)), math.exp(x)) for x in np.linspace(-1, 3, 4001))
    assert abs(fitted - best[1]) < 0.01 and abs(loss - best[0]) < 1e-6


def test_token_mixture(spark):
    rows = [(i, "ab"[i % 2], 10 + i % 7) for i in range(60)] + [(99, "c", 0)]
    df = spark.createDataFrame(rows, "id long, part string, n long")
    got = S.token_mixture(df, "part", "id", "n", {"a": 0.5, "b": 0.25, "c": 0.25}, 2000, 1).collect()
    total = {p: sum(n for _, q, n in rows if q == p) for p in "ab"}
    for part, quota in (("a", 1000), ("b", 500)):
        own = [r for r in got if r.part == part]
        assert {r.quota for r in own} == {quota} and quota <= sum(r.n for r in own) < quota + 17
        assert len({(r.id, r.epoch) for r in own}) == len(own)
        whole = quota // total[part]
        assert all(sum(r.epoch == e for r in own) == 30 for e in range(whole))
    assert not [r for r in got if r.part == "c"]


def test_capped_sample_refills(spark):
    from pyspark.sql import functions as F

    rows = [(i, "a", i % 2 == 0) for i in range(100)] + [(200 + i, "b", i >= 4) for i in range(40)] + [(300 + i, "c", True) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, l string, m boolean")
    got = S.capped_sample(df, "l", "m", F.sha2(F.col("id").cast("string"), 256), 20, lambda real: F.lit(0.2)).groupBy("l").agg(F.count_if(~F.col("m")).alias("r"), F.count_if("m").alias("s")).collect()
    assert {r.l: (r.r, r.s) for r in got} == {"a": (16, 4), "b": (4, 16), "c": (0, 5)}


def test_fresh_rows(spark):
    from pyspark.sql import functions as F

    c = spark.createDataFrame([(1, "g", "x"), (2, "g", "x"), (3, "g", "y"), (4, "g", None), (5, "g", "z")], "id long, g string, k string")
    got = S.fresh_rows(c, spark.createDataFrame([("y",), (None,)], "k string"), "k", ["g"], F.col("id"), 5).collect()
    assert sorted((r.id, r.k) for r in got) == [(1, "x"), (5, "z")]


def test_epoch_blocks(spark):
    df = spark.createDataFrame([(i, 10 + i) for i in range(7)], "id long, n long")
    rows = sorted(S.epoch_blocks(df, "id", "n", 250, 32, 1).collect(), key=lambda r: r.start)
    assert sum(r.used for r in rows) == 256 and rows[-1].last_block == 7
    assert all(a.start + a.used == b.start for a, b in zip(rows, rows[1:]))
    orders = [[r.id for r in rows if r.epoch == e] for e in (0, 1)]
    assert sorted(orders[0]) == sorted(orders[1]) == list(range(7)) and orders[0] != orders[1]
    assert S.epoch_blocks(df.filter("id > 9"), "id", "n", 250, 32, 1).count() == 0


def test_stratified_resample(spark):
    df = spark.createDataFrame([("a", f"g{i}", i) for i in range(6)] + [("b", "h", 9)], "s string, g string, v long")
    rows = I.stratified_resample(df, "s", "g", 40, 2).collect()
    sizes = {}
    for r in rows:
        sizes[r.s, r.replicate] = sizes.get((r.s, r.replicate), 0) + 1
    assert len(sizes) == 80 and all(n == (6 if s == "a" else 1) for (s, _), n in sizes.items())
    assert {r.v for r in rows if r.s == "a"} == set(range(6)) and len({tuple(sorted(r.v for r in rows if r.s == "a" and r.replicate == k)) for k in range(1, 41)}) > 20
