"""Text vectors and classifiers against plain versions."""

import math
from collections import Counter

from siltstone.operators import models, rewrite

TEXTS = ["red fish red boat", "red fish", "blue sea blue sky", "blue boat sea", "", None]


def test_text_vectors(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    vectors = models.TextVectors(df, "text", {"word": models.word_terms}, least=2)
    terms = lambda t: (t or "").split() + [" ".join(p) for p in zip((t or "").split(), (t or "").split()[1:])]
    seen = Counter(x for t in TEXTS for x in set(terms(t)))
    known = {x: n for x, n in seen.items() if n >= 2}
    vocabulary = vectors.counters["word"].vocabulary
    assert set(vocabulary) == set(known)
    for r in vectors.transform(df).collect():
        raw = {x: (1 + math.log(n)) * (math.log((1 + len(TEXTS)) / (1 + known[x])) + 1) for x, n in Counter(terms(r.text)).items() if x in known}
        size = math.sqrt(sum(v * v for v in raw.values())) or 1
        got = {vocabulary[i]: v for i, v in zip(r.word.indices, r.word.values)}
        assert got.keys() == raw.keys() and all(abs(got[x] - raw[x] / size) < 1e-9 for x in raw)


def test_text_classifiers(spark):
    rows = [(i, f"{a} {b} tail", label) for i, (a, b, label) in enumerate([("red", "fish", "x"), ("blue", "sky", "y"), ("green", "hill", "z")] * 6)] + [(99, "red sky", None)]
    df = spark.createDataFrame(rows, "id long, text string, label string")
    vectors = models.TextVectors(df, "text", features=50)
    x = vectors.transform(df)
    for views, kind in ((["word"], "svm"), (["char", "word"], "logistic"), (["word"], "complement")):
        got = models.TextClassifier(x, views, "label", kind).transform(x).collect()
        assert len(got) == len(rows) and all(r.predicted == r.label for r in got if r.label), kind


def test_group_weights_of_empty_tables(spark):
    assert rewrite.dro_weights(spark.createDataFrame([], "i long, g string, v double"), "g", "v", "i").count() == 0


def test_view_scores(spark):
    from siltstone.operators import metrics as M

    rows = [(1, "a", "one two", "one two", "x"), (1, "b", "three", "three four", "three four"), (2, "a", "p", "q", "p")]
    df = spark.createDataFrame(rows, "run long, label string, target string, raw string, other string")
    got = {(r.run, r["view"]): (r.n, r.macro_chrf, r.worst_chrf) for r in M.view_scores(df, ["run"], "label", {"raw": "raw", "other": "other"}, "target").collect()}
    alone = lambda run, view, label: df.filter(f"run = {run} and label = '{label}'").select(M.chrf_statistics(view, "target").alias("s")).select(M.chrf_score(M.F.col("s"))).first()[0]
    for run, view in got:
        each = [alone(run, view, label) for label in ("a", "b") if run == 1 or label == "a"]
        assert got[run, view] == (len(each), sum(each) / len(each), min(each))
    assert got[1, "raw"][1] > got[1, "other"][1] and got[2, "other"][1] == 100
