"""Functions, operators, sources and sinks on small literal frames."""

import hashlib
import io
import json
import random
import unicodedata
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import keys as K
from siltstone.functions import text as T
from siltstone.operators import aggregates as A
from siltstone.operators import components as C
from siltstone.operators import dedup as D
from siltstone.operators import inference as I
from siltstone.operators import metrics as M
from siltstone.operators import quality as Q
from siltstone.operators import rewrite as R
from siltstone.operators import sampling as S
from siltstone.sources import readers, writers
from siltstone.streaming import gate


def one(spark, **columns):
    kinds = {str: "string", int: "long", float: "double", bool: "boolean", list: "array<string>", type(None): "string"}
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in columns.items()))


TEXTS = ["", "a", "  a b​ ", "“quoted”", "déjà vu , ok !", "x – y − z", "ক্ষা বাংলা ১২", "aaa  bbb\tccc", "A\x00b﻿", "ﬁne ²", "«x»", "don't Don’t"]


def levels(raw):
    nfc = unicodedata.normalize("NFC", raw)
    for c in "﻿​‌":
        nfc = nfc.replace(c, "")
    nfc = nfc.replace(" ", " ")
    clean = " ".join("".join(" " if unicodedata.category(c)[0] == "C" else c for c in nfc).split())
    return nfc, clean


def test_text_levels(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS] + [(None,)], "t string")
    got = df.select("t", T.level_nfc(F.col("t")).alias("nfc")).withColumn("clean", T.level_clean(F.col("nfc"))).withColumn("model", T.level_model(F.col("clean"))).withColumn("compact", T.level_compact(F.col("model"))).collect()
    for r in got:
        nfc, clean = levels(r.t or "")
        assert (r.nfc, r.clean) == (nfc, clean)
        assert r.compact == "".join(c.casefold() for c in unicodedata.normalize("NFKC", r.model) if unicodedata.category(c)[0] in "LN")
    by = {r.t: r for r in got}
    assert by["“quoted”"].model == "quoted" and by["x – y − z"].model == "x — y — z"
    assert by["déjà vu , ok !"].model == "déjà vu, ok!"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=["Cs"], blacklist_characters="\x00")), min_size=1, max_size=12))
def test_text_counts(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    t = F.col("t")
    for r in df.select("i", T.letters(t).alias("l"), T.longest_run(t).alias("run"), F.size(T.character_grams(t, 4)).alias("g")).collect():
        text = texts[r.i]
        run = max((sum(1 for _ in g) for _, g in __import__("itertools").groupby(text)), default=0)
        grams = {text[i : i + 4] for i in range(max(1, len(text) - 3))} - {""}
        assert r.run == run and r.g == len(grams)
        assert abs(r.l - sum(unicodedata.category(c)[0] == "L" for c in text)) <= sum(ord(c) > 0xFFF for c in text)


def test_ngrams_and_repetition(spark):
    df = spark.createDataFrame([("a b c a b c a b",), ("a b c",), ("",)], "t string")
    got = [r[0] for r in df.select(T.ngram_repetition(F.col("t"))).collect()]
    assert got == [0.5, 0.0, 0.0]


def test_perturbation_is_seeded(spark):
    df = spark.createDataFrame([("ক্ষা বাংলা text here", f, 0.3, s) for f in ("deletion", "swap", "whitespace") for s in (1, 2)], "t string, f string, s double, k long")
    run = lambda n: [r[0] for r in df.repartition(n).select(T.perturbed(F.col("t"), F.col("f"), F.col("s"), F.col("k")).alias("x"), "f", "k").orderBy("f", "k").collect()]
    assert run(1) == run(4)


def test_hashes(spark):
    r = one(spark, a="x", b=None, c=3).select(K.stable_hash(F.col("a"), F.col("b"), F.col("c")).alias("h"), K.unit_interval(F.sha2("a", 256)).alias("u"), K.hash_split(F.col("a"), 7).alias("s"), K.protected_split(F.array(F.lit("train"), F.lit("test"), F.lit("?"))).alias("p")).first()
    assert r.h == hashlib.sha256("x\x1fNone\x1f3".encode()).hexdigest()
    assert r.u == int(hashlib.sha256(b"x").hexdigest()[:16], 16) / float(16**16)
    assert r.p == "test" and r.s in ("train", "validation", "test")


def test_json_lists(spark):
    got = [r[0] for r in spark.createDataFrame([('["a",1]',), ("plain",), ('{"a":1}',), ("",), (None,)], "t string").select(K.json_list(F.col("t"))).collect()]
    assert got == [["a", "1"], ["plain"], [], [], []]


def test_gate_order(spark):
    rows = [("short",), ("1234 " * 60,), ("a" * 30 + "\n" + "ab cd\n" * 40,), ("word " * 60 + "�",), ("fine words " * 30,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(Q.document_reason(F.col("t"), F.lit(1.0), "A-Za-z", 50, 10_000, 0.5, 0.8)).collect()]
    assert got == ["too_short", "low_bengali_letter_ratio", "repetitive_lines", "invalid_unicode", None]


def test_quality_score(spark):
    df = spark.createDataFrame([("", False), ("ok words in here", False), ("aaaaaaaa", True), ("!!! ???", False)], "t string, s boolean")
    got = Q.with_quality_score(df, "t", F.lit("<>"), F.col("s"), F.lit(0.5), "A-Za-z", None).collect()
    assert got[0].score == 0 and got[0].removal == ["empty_after_cleaning"]
    assert got[1].score == 0.9 and got[1].flags == ["artifact_placeholder_removed"]
    assert "excessive_same_char_run" in got[2].flags and "synthetic_too_short" in got[2].flags
    assert "no_bangla_characters" in got[3].removal


def test_labels(spark):
    got = [r[0] for r in spark.createDataFrame([("New Town",), ("new_town",), ("NT",), ("else",), (None,)], "l string").select(Q.standard_label(F.col("l"), {"new_town": "NT"})).collect()]
    assert got == ["NT", "NT", "NT", "UNK", "UNK"]
    with pytest.raises(ValueError):
        Q.keep_labels(spark.createDataFrame([("a",)], "l string"), "l", include=["b"])


def test_near_matches(spark):
    base = "thequickbrownfoxjumpsoverthelazydogagainandagainuntilitisverytired" * 3
    ref = spark.createDataFrame([("r1", base, 1), ("r2", base, 0), ("r3", "tiny", 2), ("r4", "completelydifferentcontenthereforallofus", 3)], "row_id string, compact string, ordinal long")
    query = spark.createDataFrame([("q1", base, 0), ("q2", base[:-1] + "x", 1), ("q3", "tiny", 2), ("q4", "nothinglikeanyoftheothersinthisframe", 3), ("q5", "", 4)], "row_id string, compact string, ordinal long")
    got = {r.row_id: (r.match_id, r.kind) for r in D.near_matches(query, ref).collect()}
    assert got == {"q1": ("r2", "compact_exact"), "q2": ("r2", "simhash_jaccard"), "q3": ("r3", "compact_exact")}


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_containment(spark, bound):
    docs = spark.createDataFrame([(1, "xx abcdefghijklmnopqrstuvwxyz yy"), (2, "abcdefghijklmnopqrst"), (3, None), (4, "short")], "i long, t string")
    pats = spark.createDataFrame([(7, "abcdefghijklmnopqrst"), (8, "ghijklmnopqrstuvwxyz y"), (9, "short")], "p long, x string")
    got = {(r.i, r.p) for r in D.contained(docs, pats, "i", "t", "p", "x", 20, bound).collect()}
    assert got == {(1, 7), (2, 7), (1, 8)}


def test_components_match_union_find(spark):
    draw = random.Random(5)
    rows = [(i, f"a{draw.randrange(60)}" if draw.random() < 0.7 else None, f"b{draw.randrange(80)}" if draw.random() < 0.7 else None, i % 17 == 0) for i in range(150)]
    got = {r.id: r.component for r in C.connected(spark.createDataFrame(rows, "i long, a string, b string, blocked boolean"), "i", ["a", "b"], "blocked").collect()}
    parent = {i: i for i, *_ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = {}
    for i, a, b, blocked in rows:
        for key in () if blocked else (a, b):
            if key:
                j = seen.setdefault(key, i)
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i, *_ in rows}
    ids = C.component_ids(spark.createDataFrame(list(got.items()), "id long, component long"))
    assert ids.agg(F.sum("row_count")).first()[0] == len(rows)


def test_conflicts(spark):
    rows = [(1, "k", "a", 1), (2, "k", "b", 2), (3, "k", "a", 2), (4, "m", "a", 1), (5, "m", "b", 1)]
    got = {r.i: r.reason for r in D.resolve_conflicts(spark.createDataFrame(rows, "i long, s string, t string, p long"), "p", ["s"], "t").collect()}
    assert got == {1: None, 2: "conflicting_lower_priority_target", 3: None, 4: "source_maps_multiple_targets_at_best_priority", 5: "source_maps_multiple_targets_at_best_priority"}


def test_allocation_is_greedy(spark):
    draw = random.Random(1)
    for _ in range(3):
        counts = {f"l{i}": draw.randrange(0, 200) for i in range(6)}
        total = draw.randrange(1, 60)
        got = {r.k: r.allocated for r in S.allocate_by_weight(spark.createDataFrame(list(counts.items()), "k string, n long"), "k", "n", total).collect()}
        want = dict.fromkeys(counts, 0)
        for _ in range(total):
            free = [k for k in counts if want[k] < int(counts[k] * 0.15)]
            if not free:
                break
            want[min(free, key=lambda k: (want[k] * max(counts[k], 1) ** 0.5, counts[k], k))] += 1
        assert got == want


def test_perfect_metrics(spark):
    df = spark.createDataFrame([(i % 4, i % 4, 0.9, True) for i in range(40)], "y long, p long, c double, ok boolean")
    r = M.summary(M.confusion(df, "y", "p")).first()
    assert (r.accuracy, r.macro_f1, r.mcc, r.worst_f1) == (1.0, 1.0, 1.0, 1.0)
    assert abs(M.calibration_error(df, "c", "ok").first().ece - 0.1) < 1e-9


def test_chrf_and_bleu(spark):
    rows = [("the cat sat", "the cat sat", 0), ("a cat sits, there", "the cat sat there.", 1), ("", "x", 2), ("abc", "xyz", 3)]
    df = spark.createDataFrame(rows, "h string, r string, g long").withColumn("s", M.chrf_statistics("h", "r")).withColumn("e", M.edit_statistics("h", "r"))
    got = df.groupBy("g").agg(M.vector_sum("s", 24).alias("s"), M.vector_sum("e", 13).alias("e")).select("g", M.chrf_score(F.col("s")).alias("c"), M.bleu_score(F.col("e")).alias("b"), F.get("e", F.lit(0)).alias("d")).orderBy("g").collect()
    assert abs(got[0].c - 100) < 1e-9 and got[0].d == 0
    assert 0 < got[1].c < 100 and got[2].c == 0 and got[3].c == 0 and 0 <= got[1].b < 100
    whole = df.agg(M.vector_sum("s", 24).alias("s")).select(M.chrf_score(F.col("s"))).first()[0]
    assert 0 < whole < 100  # sums, not means of scores


def test_identical_systems_have_no_effect(spark):
    stats = spark.createDataFrame([(f"g{i}", 0.5, 0.5) for i in range(20)], "g string, t double, c double")
    r = I.paired_randomization(stats, "g", "t", "c", 50, 3).first()
    assert (r.observed, r.p_value) == (0.0, 1.0)
    strong = spark.createDataFrame([(f"g{i}", 1.0, 0.0) for i in range(24)], "g string, t double, c double")
    assert I.paired_randomization(strong, "g", "t", "c", 200, 3).first().p_value < 0.05


def test_bootstrap_is_synchronized(spark):
    stats = spark.createDataFrame([(s, f"g{i}", float(i), 1.0) for s in ("a", "b") for i in range(12)], "s string, g string, x double, n double")
    got = I.cluster_bootstrap(stats, "g", "x", "n", 30, 1, ["s"]).groupBy("replicate").agg(F.min("ratio").alias("a"), F.max("ratio").alias("b")).collect()
    assert len(got) == 30 and all(r.a == r.b for r in got)


def test_holm(spark):
    p = [0.01, 0.04, 0.03, 0.03]
    got = {r.i: r.adjusted for r in I.holm(spark.createDataFrame([(i, "f", x) for i, x in enumerate(p)], "i long, f string, p double"), "p", ["f"], "i").collect()}
    assert [round(got[i], 10) for i in range(4)] == [0.04, 0.09, 0.09, 0.09]


def test_rewriting(spark):
    pairs = spark.createDataFrame([("l", "a b c", "a x c"), ("l", "b d", "x d"), ("l", "b q", "y q")], "label string, s string, t string")
    m = R.learn(pairs, "label", "s", "t", 2, 0.6)
    assert [(r.word, r.other, r.n) for r in m.collect()] == [("b", "x", 2)]
    assert R.apply_map(pairs.withColumn("i", F.lit(1)).limit(1), "i", "label", "s", m).first().rewritten == "a x c"
    assert R.consensus(m, "label").count() == 1


def test_gini_and_runs(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 0.0), ("b", 1.0), ("b", 3.0)], "g string, v double")
    assert {r.g: round(r.gini, 6) for r in A.gini(df, "v", ["g"]).collect()} == {"a": 0.0, "b": 0.25}
    runs = spark.createDataFrame([(1, i, c) for i, c in enumerate([True, True, False, True])] + [(2, 0, False)], "g long, i long, c boolean")
    assert {r.g: r.run for r in A.longest_true_run(runs, ["g"], ["i"], F.col("c")).collect()} == {1: 2, 2: 0}


def workbook():
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Name</t></si><si><t>x</t></si></sst>")
        # the first sheet is the second file
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="b" sheetId="2" r:id="rId7"/><sheet name="a" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId7" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Full-Text</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2" t="b"><v>1</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_archives_and_sheets(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook())
    assert dict(readers.xlsx(spark, f"{tmp_path}/*.xlsx").first().cells) == {"name": "x", "column_1": "TRUE", "full_text": ""}
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/x.csv", "A b,C\n1,é\n")
        z.writestr("readme.md", "hi")
    rows = readers.csv_from_zip(spark, f"{tmp_path}/*.zip")
    assert readers.columns_of(rows, ["a_b", "c", "none"]).first()[2:] == ("1", "é", None)
    assert {r.member: r.size for r in readers.archive_inventory(spark, f"{tmp_path}/*.zip").collect()} == {"d/x.csv": 11, "readme.md": 2}
    (tmp_path / "l.csv").write_bytes("a\né\n".encode("latin-1"))
    assert readers.csv_with_encodings(spark, f"{tmp_path}/l.csv").first().cells["a"] == "é"
    with pytest.raises(ValueError):
        readers.one_member(["a.csv", "b.csv"], ".csv")


def test_arrays_and_logs(spark, tmp_path):
    np.savez(tmp_path / "s.npz", input_ids=np.arange(6).reshape(2, 3))
    assert [list(r.ids) for r in readers.npz_blocks(spark, f"{tmp_path}/s.npz").orderBy("block").collect()] == [[0, 1, 2], [3, 4, 5]]
    (tmp_path / "p.bin").write_bytes(np.arange(8, dtype="<u2").tobytes())
    assert readers.packed_blocks(spark, f"{tmp_path}/p.bin", 4).count() == 2
    with pytest.raises(Exception):
        readers.packed_blocks(spark, f"{tmp_path}/p.bin", 3).count()
    (tmp_path / "m_20.json").write_text(json.dumps({"v": 1.5}))
    assert readers.metrics_by_step(spark, f"{tmp_path}/m_*.json", "v double").first().step == 20
    (tmp_path / "l.jsonl").write_text('{"a":1}\n{"a":2}\n')
    assert readers.json_lines(spark, f"{tmp_path}/l.jsonl", "a long").count() == 2
    (tmp_path / "a.json").write_text('[{"a":1},{"a":2}]')
    assert readers.json_array(spark, f"{tmp_path}/a.json", "a long").count() == 2
    want = spark.createDataFrame([("m_20.json", hashlib.sha256((tmp_path / "m_20.json").read_bytes()).hexdigest()), ("l.jsonl", "0"), ("none", "0")], "name string, sha256 string")
    assert {r.name: r.state for r in readers.verify_hashes(spark, str(tmp_path), want).collect()} == {"m_20.json": "ok", "l.jsonl": "changed", "none": "missing"}
    assert len(readers.tree_hash(spark, str(tmp_path))) == 64


def test_columns(spark):
    df = spark.createDataFrame([("a", "long text here", 1)], "k string, Body string, n long")
    assert readers.text_column(df) == "Body" and readers.find_column(["My-Text", "x"], ["text"]) == "My-Text"
    wide = spark.createDataFrame([(1, "s", "d1", None), (2, "s2", "e1", "e2")], "i long, std string, north string, south string")
    assert sorted((r.label, r.source, r.target) for r in readers.wide_to_rows(wide, "i", "std", {"north": "N", "south": "S"}).collect()) == [("N", "d1", "s"), ("N", "e1", "s2"), ("S", "e2", "s2")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, i / 3, "a|b") for i in range(10)], "i long, x double, s string")
    writers.parquet(df, f"{tmp_path}/p", ["i"])
    assert [r.i for r in spark.read.parquet(f"{tmp_path}/p").orderBy("i").collect()] == list(range(10))
    ledger = writers.shards(df.coalesce(1), f"{tmp_path}/s", 4).collect()
    assert sorted(r.n for r in ledger) == [2, 4, 4]
    with pytest.raises(Exception):
        writers.shards(df, f"{tmp_path}/s", 4)
    writers.csv(df, f"{tmp_path}/c", 3)
    assert readers.csv_table(spark, f"{tmp_path}/c").filter("i = '1'").first().x == "0.333"
    assert "a\\|b" in writers.markdown(df) and "0.3333" in writers.latex(df)
    writers.report({"b": 1, "a": "é"}, f"{tmp_path}/r.json")
    assert open(f"{tmp_path}/r.json", encoding="utf-8").read().index('"a"') < 10
    writers.cache(df, f"{tmp_path}/k", size=3)
    back, meta = writers.cached(spark, f"{tmp_path}/k")
    assert back.count() == 10 and meta == {"size": 3}
    assert "license" in writers.license_ledger(spark.createDataFrame([("s", "l", "u")], "source string, license string, url string"))


def test_streaming_gate_equals_batch(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    (docs.repartition(5)).write.parquet(f"{tmp_path}/in")
    reason = Q.document_reason(F.col("text"), F.lit(1.0), "A-Za-z", 200, 20_000, 0.5, 0.8)
    for _ in range(2):  # the second run finds nothing new
        stream = gate.read(spark, f"{tmp_path}/in", docs.schema, 2)
        gate.append(gate.gate(stream, reason, "doc_id"), f"{tmp_path}/ok", f"{tmp_path}/bad", f"{tmp_path}/cp").awaitTermination()
    got = {r.doc_id for r in spark.read.parquet(f"{tmp_path}/ok").select("doc_id").collect()}
    assert got == {r.doc_id for r in docs.filter(reason.isNull()).collect()}
    assert spark.read.parquet(f"{tmp_path}/bad").count() + len(got) == docs.count()


def test_pair_features(spark):
    from siltstone.operators import models

    views = {"a": F.col("a"), "b": F.col("b"), "c": F.col("c")}
    x = one(spark, a="the cat 1", b="the dog!", c="the cat 1").select(models.pair_features(views, F.array(F.lit(2.0), F.lit(1.0), F.lit(1.0))).alias("x")).first().x
    assert x["length.a"] == 9 and x["word_count.b"] == 2 and x["marks.b"] == 1 and x["number_signs.a"] == 1
    assert (x["same.a.b"], x["same.a.c"], x["matched.a.c"], x["shared_start.a.b"]) == (0, 1, 1, 0.5)
    assert (x["lead_share"], x["lead"], list(x["shares"])) == (0.5, 0.25, [0.5, 0.25, 0.25]) and 0 < x["evenness"] < 1
    assert set(one(spark, a="x").select(models.pair_features({"a": F.col("a")}).alias("x")).first().x.asDict()) == {f"{m}.a" for m in models.VIEW_MEASURES}


def test_common_prefix(spark):
    rows = [("abc", "abd", 2 / 3), ("", "x", 0.0), ("same", "same and more", 1.0), ("x" * 70_000 + "a", "x" * 70_000 + "b", 70_000 / 70_001), ("a", "b", 0.0)]
    got = spark.createDataFrame(rows, "a string, b string, s double").select(F.abs(T.common_prefix_share(F.col("a"), F.col("b")) - F.col("s")).alias("d")).collect()
    assert all(r.d < 1e-12 for r in got)


def test_perturbed_counts(spark):
    """Each family makes max(1, round(n x severity)) edits, also in a short text."""
    import regex

    text = "Some words of a longer text, in which letters are moved about"
    n = len(regex.findall(r"\p{L}", text))
    rows = [(t, f, s, k) for t in (text, "ab") for f in ("deletion", "swap", "whitespace") for s in (0.01, 0.1, 0.3) for k in range(5)]
    got = spark.createDataFrame(rows, "t string, f string, s double, k long").select("t", "f", "s", T.perturbed(F.col("t"), F.col("f"), F.col("s"), F.col("k")).alias("x")).collect()
    for r in got:
        wanted = max(1, round((n if r.t == text else 2) * r.s))
        if r.f == "deletion":
            assert len(regex.findall(r"\p{L}", r.x)) == (n if r.t == text else 2) - wanted
        if r.f == "swap":
            assert sorted(r.x) == sorted(r.t) and (r.x != r.t or r.t == text) and sum(a != b for a, b in zip(r.x, r.t)) <= 2 * wanted
        if r.f == "whitespace":
            assert r.x.replace(" ", "") == r.t.replace(" ", "") and r.x != r.t and abs(len(r.x) - len(r.t)) <= wanted


def test_component_ids_and_running_totals(spark):
    labels = spark.createDataFrame([(i, i % 3) for i in range(300)], "id long, component long")
    small, large = C.component_ids(labels, 10).collect(), {r.component: r.component_id for r in C.component_ids(labels).collect()}
    assert large[1] == hashlib.sha256("\x1f".join(sorted(str(i) for i in range(1, 300, 3))).encode()).hexdigest()
    assert len({r.component_id for r in small}) == 3 and {r.row_count for r in small} == {100}
    rows = [(i, i % 2, i % 7) for i in range(0, 5000, 3)]
    got = {r.i: r.before for r in S.running_total(spark.createDataFrame(rows, "i long, g long, v long"), ["g"], "i", "v").collect()}
    total = {0: 0, 1: 0}
    for i, g, v in rows:
        assert got[i] == total[g]
        total[g] += v


def test_shifted_edits(spark):
    rows = [("a b c d", "a b c d", 0), ("c d a b", "a b c d", 1), ("x y", "a b c", 3), ("", "a", 1), ("b c d e a", "a b c d e", 1)]
    got = [r[0] for r in spark.createDataFrame(rows, "h string, r string, n long").select((F.get(M.shift_statistics("h", "r"), F.lit(0)) == F.col("n")).alias("ok")).collect()]
    assert got == [True] * 5


def test_near_matches_by_brute_force(spark):
    """Every row against every reference, with copies of both and lengths about the ratio."""
    import random

    draw = random.Random(5)
    letters = "abcdefgh"
    base = ["".join(draw.choices(letters, k=n)) for n in (20, 25, 40, 64, 80, 100, 125, 300, 1000)]
    near = [t[:i] + "x" + t[i + 1 :] for t in base for i in (0, len(t) // 2)] + [t + t[: len(t) // 4] for t in base] + [t[: len(t) * 4 // 5] for t in base]
    query = [(i, t, i) for i, t in enumerate(base * 2 + near * 2 + ["", "short", None])]
    ref = [(1000 + i, t, 500 - i) for i, t in enumerate(near[::2] * 3 + base[::3] + ["", None])]
    schema = "row_id long, compact string, ordinal long"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    got = {(r.row_id, r.match_id, round(r.score, 9), r.kind) for r in D.near_matches(frame(query), frame(ref), jaccard=0.5).collect()}
    fp = {r.compact: r.fp for r in D.fingerprints(frame([q for q in query + ref if q[1]])).collect()}
    grams = lambda t: {t[i : i + 4] for i in range(len(t) - 3)}
    expected = set()
    for i, t, _ in query:
        same = [(o, r) for r, u, o in ref if u and u == t]
        if same:
            expected.add((i, min(same)[1], 1.0, "compact_exact"))
            continue
        found = []
        for r, u, o in ref:
            if not t or not u or min(len(t), len(u)) < 20 or min(len(t), len(u)) / max(len(t), len(u)) < 0.8:
                continue
            x = (fp[t] ^ fp[u]) & (1 << 64) - 1
            bands = [b for b in range(4) if not x >> 16 * b & 0xFFFF]
            score = len(grams(t) & grams(u)) / len(grams(t) | grams(u))
            if bands and x.bit_count() <= 6 and score >= 0.5:
                found.append((-score, bands[0], o, r))
        if found:
            best = min(found)
            expected.add((i, best[3], round(-best[0], 9), "simhash_jaccard"))
    assert got == expected
    assert sum(k == "simhash_jaccard" for *_, k in got) > 10
