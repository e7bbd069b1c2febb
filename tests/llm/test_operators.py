"""Every operator against its plain version, and the defined cases: nulls, empty and long texts,
ties, repeated rows, empty tables, extra columns with clashing names."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import decontamination, forest, packing, quality, simhash, suffixes, tokenfile, tokens, toxicity, urls, warc

from . import brute

CLASH = "doc_id long, text string, doc long, row string, first string, h string, n_words string, fp string, runs string, label string, rest string, items string"
DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, *([None] * 10)) for i, t in rows], CLASH)


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abdeé") for _ in range(draw.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    shared, line = prose(1, 60), prose(2, 14)
    rows = [(i, f"{prose(100 + i, 30)}\n{line}. {prose(200 + i, 10 + i % 5)}") for i in range(40)]
    rows += [(40 + i, f"{prose(300 + i, 5)} {shared} {prose(400 + i, 5)}") for i in range(12)]
    rows += [(60 + i, shared + " x" * (i % 2)) for i in range(9)]
    rows += [(70, None), (71, ""), (72, " \t\n"), (73, "a" * 700), (74, "ab" * 300), (75, prose(100, 30)), (76, prose(5, 4000)), (77, "é" * 130), (78, "日本 語" * 60), (79, "it's <|endoftext|> don't  'll\n\n")]
    return rows


@pytest.mark.parametrize("hot", [4096, 2])
def test_suffixes_exact(spark, corpus, hot):
    out = suffixes.apply_runs(clashing(spark, corpus), suffixes._digest, DIGEST, hot=hot).collect()
    assert {r.doc_id: tuple(r)[1:] for r in out} == brute.removed(corpus)


def test_suffixes_edges(spark, corpus):
    twice = corpus[:5] + corpus[:5] + [(None, corpus[0][1]), (3, corpus[40][1]), (200, corpus[40][1])]
    out = suffixes.apply_runs(clashing(spark, twice), suffixes._digest, DIGEST).collect()
    assert len(out) == len(twice)
    once = brute.removed(corpus[:5])
    assert all(tuple(r)[1:] == once[r.doc_id] for r in out if r.doc_id is not None and r.doc_id < 3)
    assert [r.n_removed for r in out if r.doc_id is None] == [0]
    assert [r.n_removed == r.n_bytes for r in out if r.doc_id == 200] == [True]
    assert suffixes.apply_runs(clashing(spark, []), suffixes._digest, DIGEST).count() == 0
    large = [(2**62 + 5, corpus[0][1]), (2**62 + 5, corpus[1][1]), (-(2**63), corpus[0][1])]
    out = suffixes.apply_runs(clashing(spark, large), suffixes._digest, DIGEST).collect()
    assert sorted((r.doc_id, r.n_removed == r.n_bytes) for r in out) == [(-(2**63), False), (2**62 + 5, False), (2**62 + 5, True)]
    left = suffixes.dedup(clashing(spark, corpus))
    assert left.columns == clashing(spark, []).columns
    assert left.filter("doc_id = 70").first().text is None


@pytest.mark.parametrize("hot", [4096, 2])
def test_repeat_groups(spark, corpus, hot):
    """Every group's occurrences are all that the corpus has, and every repeated window lies in one."""
    import hashlib

    texts = {i: (t or "").encode() for i, t in corpus}
    groups, covered = {}, {}
    for r in suffixes.repeats(clashing(spark, corpus), hot=hot).collect():
        groups.setdefault((r.repeat, r.n_bytes), set()).add((r.doc_id, r.start))
        covered.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.n_bytes))
    assert groups
    for (name, size), places in groups.items():
        doc, start = min(places)
        string = texts[doc][start : start + size]
        assert size >= 100 and len(places) > 1 and hashlib.sha256(string).hexdigest() == name
        assert all(texts[d][at : at + size] == string for d, at in places)
    windows = {}
    for i, raw in texts.items():
        for at in range(len(raw) - 99):
            windows.setdefault(raw[at : at + 100], []).append((i, at))
    for places in windows.values():
        if len(places) > 1:
            assert all(set(range(at, at + 100)) <= covered[i] for i, at in places)


def test_suffixes_long_text():
    texts = [prose(7, 3000).encode()]
    whole, cut = suffixes.anchors(texts, 100, 24), suffixes.anchors(texts, 100, 24, piece=1000)
    assert set(whole[0].tolist()) == set(cut[0].tolist())


def test_maximal_repeats():
    found = list(suffixes.maximal_repeats([b"xy", b"xy", b"zy", b"q"], [b"abcd", b"abce", b"abcd", b"abcf"], 4))
    assert (2, 3, [0, 1]) in [(a, b, sorted(g)) for a, b, g in found]
    assert (0, 4, [0, 2]) in [(a, b, sorted(g)) for a, b, g in found]
    assert not any(sorted(g) == [0, 1, 2] and b < 3 for a, b, g in found)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_decontamination(spark, corpus, limit):
    words = brute.words(corpus[3][1])
    items = [("a", " ".join(words[5:30])), ("b", "Éa " + words[2].upper()), ("c", None), ("d", "!!"), ("e", " ".join(words[5:30])), ("f", " ".join(words[8:21]))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    out = decontamination.find(clashing(spark, corpus + corpus[:4]), bench, max_windows=limit)
    out = out.select("doc_id", "n_words", "n_hit", F.size("items").alias("n"), F.sha2(F.concat_ws(",", "items"), 256).alias("h"), decontamination.contaminated().alias("c"))
    key = lambda r: (r[0], r[1])
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(brute.contamination(corpus + corpus[:4], items), key=key)
    kept = decontamination.remove_documents(clashing(spark, corpus), bench, max_windows=limit)
    assert 3 not in [r.doc_id for r in kept.collect()]
    cut = decontamination.remove_spans(clashing(spark, corpus), bench, max_windows=limit)
    assert cut.columns == clashing(spark, []).columns
    text = cut.filter("doc_id = 3").first().text
    assert len(brute.words(text)) < len(words) and " ".join(words[5:18]) not in text
    # each row by its own text: another text of the id, a null id and a null text
    mixed = clashing(spark, [(3, corpus[3][1]), (3, "short"), (None, corpus[3][1]), (None, None)])
    assert sorted((r.doc_id or -1, r.text or "") for r in decontamination.remove_documents(mixed, bench, max_windows=limit).collect()) == [(-1, ""), (3, "short")]
    assert sorted((r.doc_id or -1, r.text or "") for r in decontamination.remove_spans(mixed, bench, max_windows=limit).collect()) == [(-1, ""), (-1, text), (3, text), (3, "short")]


def test_decontamination_empty(spark, corpus):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find(clashing(spark, corpus), none).filter("n_hit > 0").count() == 0
    assert decontamination.find(clashing(spark, []), none).count() == 0


@pytest.mark.parametrize("bucket", [4096, 1])
def test_simhash(spark, corpus, bucket):
    rows = corpus + [(500 + i, dict(corpus)[76].replace(" ", f" w{i} ", 1 + i)) for i in range(6)] + corpus[:2]
    want = {i: brute.fingerprint(t) for i, t in rows}
    linked = brute.groups(list(want.items()))
    out = simhash.groups(clashing(spark, rows), bucket=bucket).collect()
    assert len(out) == len(rows)
    assert {(r.doc_id, r.fp % (1 << 64), r.component_id) for r in out} == {(i, want[i], linked[i]) for i, _ in rows}
    kept = simhash.dedup(clashing(spark, [*rows, (None, corpus[0][1]), (None, "alone"), (None, "alone")]))
    assert sorted((r.doc_id, 1) if r.doc_id is not None else (-1, r.text) for r in kept.collect()) == sorted([*((i, 1) for i in set(linked.values())), (-1, "alone")])
    assert simhash.groups(clashing(spark, [])).count() == 0


def test_simhash_large_buckets(spark):
    draw = random.Random(3)
    values = {0x0123456789ABCDEF ^ (1 << draw.randrange(60)) ^ (1 << draw.randrange(60)) for _ in range(150)} | {draw.getrandbits(62) for _ in range(150)}
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    want = {v: c for v, c in brute.groups([(v, v) for v in values]).items()}
    for bucket in (8, 4096):
        got = {r.node: r.component for r in simhash.components(simhash.links(df, bucket=bucket)).collect()}
        assert all(got.get(v, v) == c for v, c in want.items())


def test_tokens(corpus):
    texts = [t or "" for _, t in corpus] + ["'s 't'dx  'rex\n's", "a\u00a0b  \x85c", "ǅ ʼn½²", "x" * 3000]
    for size in (len(texts), 1):
        e = tokens.Encoder()
        got = [ids.tolist() for at in range(0, len(texts), size) for ids in e.encode([t.encode() for t in texts[at : at + size]])]
        assert got == brute.token_ids(texts)
    small = tokens.Encoder(cache=50)
    assert [i.tolist() for t in texts for i in small.encode([t.encode()])] == brute.token_ids(texts)
    long = " ".join([prose(9, 30000)] * 8)
    assert len(long) > 1 << 20
    assert tokens.Encoder().encode([long.encode()])[0].tolist() == brute.token_ids([long])[0]


@pytest.mark.parametrize("size", [1024, 2048])
def test_tokens_of_colliding_words(size):
    """Words that every polynomial hash modulo a power of two mixes up keep their own ids."""
    one, other = "a", "b"
    while len(one) < size:
        one, other = one + other, other + one
    texts = [one, other, f"{one} {other}", f"{other} x"]
    e = tokens.Encoder()
    assert [e.encode([t.encode()])[0].tolist() for t in texts] == brute.token_ids(texts)
    assert [x.tolist() for x in tokens.Encoder().encode([t.encode() for t in texts])] == brute.token_ids(texts)


def test_tokens_of_another_vocabulary():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Some words, it's 12 o'clock", prose(3, 40)]
    assert [x.tolist() for x in tokens.Encoder(path).encode([t.encode() for t in texts])] == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_token_files(spark, corpus):
    rows = corpus + corpus[:3]
    ledger = tokenfile.write(clashing(spark, rows), length=64, rows=8)
    got = sorted(map(tuple, tokenfile.read(ledger).collect()), key=lambda r: r[1])
    want, at = [], 0
    for (i, _), ids in sorted(zip(rows, brute.token_ids([t for _, t in rows])), key=lambda x: x[0][0]):
        ids = [*ids, 2]
        want.append((i, at, len(ids), brute.crc(ids)))
        at += len(ids)
    assert got == want
    shard = ledger.orderBy("shard").first()
    reader = tokenfile.open_file(shard.path)
    stream = np.concatenate([tokenfile.sequence(reader, n, 8)[0][tokenfile.sequence(reader, n, 8)[1]] for n in range(-(-shard.n_tokens // 64))])
    assert len(stream) == shard.n_tokens
    assert tokenfile.read(tokenfile.write(clashing(spark, []))).count() == 0


def test_packing(spark, corpus):
    rows = packing.pack(clashing(spark, corpus), size=128).collect()
    encoded = {i: [*ids, 0] for (i, _), ids in zip(corpus, brute.token_ids([t for _, t in corpus]))}
    at = dict.fromkeys(encoded, 0)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        ids = encoded[r.doc_id][r.start : r.start + r.length]
        assert (r.start, r.ids_crc32, r.doc_tokens) == (at[r.doc_id], brute.crc(ids), len(encoded[r.doc_id]))
        at[r.doc_id] += r.length
    assert at == {i: len(x) for i, x in encoded.items()}
    end = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == end.get(r.sequence_id, 0)
        end[r.sequence_id] = r.offset + r.length
    assert max(end.values()) <= 128 and sorted(end) == list(range(len(end)))
    assert packing.pack(clashing(spark, [])).count() == 0


def test_packing_patterns():
    draw = np.random.default_rng(1)
    histogram = {int(k): int(v) for k, v in zip(range(1, 1025), draw.integers(0, 40, 1024)) if v}
    found = packing.patterns(histogram)
    used = {}
    for count, pack in found:
        assert sum(pack) <= 1024 and count > 0
        for length in pack:
            used[length] = used.get(length, 0) + count
    assert used == histogram
    assert 1 - sum(c * sum(p) for c, p in found) / (1024 * sum(c for c, _ in found)) < 0.01


def nearest(v, ids, q, k):
    score = (v * v[q]).sum(axis=1)
    return [int(ids[i]) for i in np.lexsort((ids, -score)) if i != q][:k], score


def test_forest_recall(spark):
    """At the query's own parameters, on vectors with and without structure, without any other search."""
    draw = np.random.default_rng(2)
    centres = draw.standard_normal((6, 16))
    v = np.concatenate([centres[draw.integers(0, 6, 600)] + 0.05 * draw.standard_normal((600, 16)), draw.standard_normal((300, 16)) * draw.uniform(0.2, 3, (300, 1))]).astype(np.float32)
    v[::7] = v[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [None] * 16), (5004, [1.0]), (None, v[1].tolist()), (3, v[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("h", F.lit("x")).withColumn("entry", F.lit(2))
    out = forest.search(df, F.col("vec_id") % 20 == 0, k=10).collect()
    x = v.astype(np.float64)
    hit = total = 0
    for q in range(0, len(v), 20):
        want, score = nearest(x, np.arange(len(v)), q, 10)
        own = sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11))
        assert all(abs(r.score - score[r.vec_id]) < 1e-9 for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        hit += len({r.vec_id for r in own} & set(want))
        total += 10
    assert hit / total >= 0.9
    few = forest.search(df.filter("vec_id < 4"), F.col("vec_id") == 0, k=10).collect()
    assert len(few) == 3
    assert forest.search(df.filter("vec_id > 6000"), F.lit(True)).count() == 0


def test_forest_query_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    found = {}
    for r in forest.op6_forest(spark, sf).filter("query_id % 100 = 0").collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = [len(set(nearest(v, ids, int(np.flatnonzero(ids == q)[0]), 20)[0]) & own) for q, own in found.items()]
    assert len(hits) == int((ids % 100 == 0).sum()) and sum(hits) / (20 * len(hits)) >= 0.9


def test_forest_ties_and_doubles(spark):
    """Equal products go to the smaller ids before any cut; double columns are searched in double."""
    rows = [(0, [1.0, 0.0])] + [(i, [0.5, i / 1000]) for i in range(1, 400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = forest.search(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in out] == list(range(1, 21)) and {r.score for r in out} == {0.5}
    exact = spark.createDataFrame([(0, [1e39, 0.0]), (1, [0.1, 0.2])], "vec_id long, embedding array<double>")
    assert [r.score for r in forest.search(exact, F.col("vec_id") == 0).collect()] == [0.1 * 1e39]


def test_urls(spark):
    rows = [(1, "http://Example.COM/en/7x?q=1#t"), (2, "https://a.b.com/en/1"), (3, "x.com/en/"), (4, None), (5, "ftp://example.net/de/81"), (6, "http://q.net/de/"), (7, "http://notcom/en/"), (8, "http://e.org?x/es/"), (9, "a://b://org/es/"), (10, "http://x.org/es/é\n?z")]
    out = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("x"))).collect()}
    assert (out[1].host, out[1].path, out[1].rule, out[1].verdict) == ("example.com", "/en/7x", "example.com/en/7", "allow")
    assert (out[2].rule, out[2].verdict) == ("com/en/", "block")
    assert (out[3].host, out[3].path, out[3].rule) == ("", "", None) and out[4].verdict == "allow"
    assert out[5].rule == "example.net/de/8" and out[6].rule == "net/de/" and out[7].rule is None
    assert (out[8].host, out[8].path) == ("e.org", "") and out[9].host == "b:" and out[10].rule == "org/es/"
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def url_rows(spark):
    rows = [(i, f"http://{'blog' if i % 3 else 'www'}.site{i % 5}.{'org' if i % 4 else 'com'}/{'es' if i % 2 else 'fr'}/{i}") for i in range(200)]
    rows += [(500 + i, f"http://cheap-pills{i % 2}.example.com/en/{7 if i % 3 else 1}{i}") for i in range(60)]
    return spark.createDataFrame(rows, "page_id long, url string")


def test_url_rules_are_mined(spark):
    """Verdicts equal a plain match of the mined rules, and some undecided URLs are blocked by them."""
    pages = url_rows(spark)
    given = urls.given_rule(F.col("host"), F.col("path"), urls.RULES)
    parts = pages.select("page_id", "url", urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path"))
    parts = parts.withColumn("given", given).withColumn("tokens", urls.tokens(F.col("url"), F.col("host"), F.col("path")))
    marked = parts.select("tokens", F.col("given.action").alias("label"))
    rules = sorted(((-r.confidence, -r.support, r.label, sorted(r["items"])) for r in urls.mine(marked).collect()))
    assert rules
    labelled = [(set(r.tokens), r.label) for r in marked.collect() if r.label]
    for c, s, label, items in rules:
        fit = [x for t, x in labelled if set(items) <= t]
        assert fit.count(label) / len(fit) == pytest.approx(-c) and fit.count(label) / len(labelled) == pytest.approx(-s)
    got = {r.page_id: r.verdict for r in urls.judge(pages).collect()}
    want = {r.page_id: r.given.action if r.given else next((x for _, _, x, items in rules if set(items) <= set(r.tokens)), "allow") for r in parts.collect()}
    assert got == want
    assert any(got[r.page_id] == "block" for r in parts.collect() if not r.given)


def test_url_parts_by_sql(spark):
    """Host, path and rule of the query are plain SQL."""
    import duckdb

    sf = "/root/testdata/sf0.01"
    sql = r"""
      WITH p AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
          regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM read_parquet('%s/pages.parquet')),
      r(name, rest, rule) AS (VALUES ('com', '/en/', 'com/en/'), ('example.com', '/en/7', 'example.com/en/7'), ('net', '/de/', 'net/de/'), ('example.net', '/de/8', 'example.net/de/8'), ('org', '/es/', 'org/es/'))
      SELECT page_id, host, path, (SELECT arg_max(rule, length(rule)) FROM r WHERE (p.host = name OR p.host LIKE '%%.' || name) AND starts_with(p.path, rest)) AS rule FROM p ORDER BY page_id""" % sf
    got = [tuple(r) for r in urls.op7_urls(spark, sf).select("page_id", "host", "path", "rule").orderBy("page_id").collect()]
    assert got == duckdb.sql(sql).fetchall()


def test_url_rules_without_labels(spark):
    rows = [(i, f"http://a.info/{i}") for i in range(30)]
    assert {r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()} == {"allow"}


def test_url_long_copies(spark):
    """A long URL that many rows repeat is one item, not 2**40 item sets."""
    long = "http://x.org/es/" + "/".join(f"p{i}" for i in range(40))
    rows = [(i, long) for i in range(100)] + [(200 + i, f"http://y{i}.example.com/en/7{i}") for i in range(50)]
    assert urls.judge(spark.createDataFrame(rows, "page_id long, url string")).filter("verdict = 'block'").count() == 100


@pytest.mark.parametrize("segment", [16 << 10, 50])
def test_warc(spark, segment):
    rows = [(3, "u3", "same"), (1, "u1", "same"), (2, "u\r\n2", None), (4, None, ""), (5, "u5", "é" * 40_000), (7, "u7", "é" * 40_000), (6, "u6", "0\r\n\r\nx"), (1, "u1", "same"), (None, "n", "same")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    out = warc.read(spark, warc.write(pages, segment_bytes=segment)).collect()
    assert len(out) == len(rows)
    first = {"same": 1, "": 2, "é" * 40_000: 5, "0\r\n\r\nx": 6}
    want = sorted((str(i), len((h or "").encode()), brute.sha1_base32((h or "").encode()), "response" if i == first[h or ""] else "revisit", None if i == first[h or ""] else first[h or ""]) for i, _, h in rows)
    assert sorted((str(r.page_id), r.payload_bytes, r.digest, r.record_type, r.refers_to) for r in out) == want
    assert all(bytes(r.payload) == (dict((i, h) for i, _, h in rows)[r.page_id] or "").encode() for r in out if r.record_type == "response")
    assert warc.read(spark, warc.write(pages.filter("page_id > 90"))).count() == 0


def test_warc_framing():
    body = b"4;name=x\r\nWiki\r\n5\r\npedia\r\n0\r\nTrailer: y\r\n\r\n"
    assert warc.unchunked(body) == b"Wikipedia"
    assert warc.unchunked(warc.chunked(b"z" * 10_000)) == b"z" * 10_000
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nab\r\n0\r\n\r\n")


def accuracy(spark, sf, name, query, column, fold):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    j = query(spark, sf).join(labels, "doc_id").filter("held_out")
    return j.filter(f"predicted = {column}").count() / j.count()


def test_quality(spark):
    sf = "/root/testdata/sf0.1"
    assert accuracy(spark, sf, "q", quality.op8_quality, "quality", 4) > 0.97


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    assert accuracy(spark, sf, "t", toxicity.op3_toxicity, "toxic", 5) > 0.97


@pytest.mark.parametrize("module", [quality, toxicity])
def test_scores_edges(spark, corpus, module):
    column = "quality" if module is quality else "toxic"
    none = spark.createDataFrame([], f"doc_id long, {column} int")
    few = spark.createDataFrame([(0, 1), (1, 0), (2, None), (None, 1), (3, 7)], f"doc_id long, {column} int")
    never = F.lit(False)
    for labels in (none, few):
        scores = module.score(clashing(spark, corpus + corpus[:2]), module.fit(clashing(spark, corpus), labels, never)).collect()
        assert len(scores) == len(corpus) + 2 and all(0 <= r.score <= 1 for r in scores)
    assert module.score(clashing(spark, []), module.fit(clashing(spark, []), none, never)).count() == 0


TOXIC = {"fool": ("I", 3.0), "scum": ("I", 2.0), "hurt": ("V", 3.0), "not": ("N", 0.0), "said": ("R", 0.0), "you": ("Y", 0.0), "will": ("W", 0.0)}


def toxic_weight(text, without=()):
    lexicon = toxicity.Lexicon(dict(TOXIC), {"nast": ("I", 2.0)})
    return sum(w for w, _ in toxicity.weighed(text, lexicon, toxicity.Machine.of(toxicity.grammar(without))))


def test_toxic_grammar():
    w = toxic_weight
    assert w("you are a fool") > w("a fool") > w("he said a fool") > 0
    assert w("not a fool") < w("a fool") and w("not me. a fool") == w("a fool") == 3.0
    assert w("you will see, i will hurt you") > w("i will hurt time") > w("i hurt time") == 1.5
    assert w("fool you") > w("fool it") and w("scum fool") > w("scum and it. fool")
    assert w("nastily put") == 2.0 and w("") == w("foolish") == w("o'fool") == 0


def test_toxic_ablation():
    """What each transducer is there for is lost without it, and only that."""
    changed = {"negation": "not a fool", "reported": "he said a fool", "insult": "you are a fool", "threat": "i will hurt it", "target": "a fool you"}
    for name, text in changed.items():
        assert toxic_weight(text, (name,)) != toxic_weight(text)
    assert all(toxic_weight("a fool", (name,)) == toxic_weight("a fool") for name in toxicity.STEPS)


def test_toxic_composition():
    """The composed machine equals the transducers run one after another."""
    draw, whole = random.Random(4), toxicity.Machine.of(toxicity.grammar())
    for _ in range(300):
        read = [draw.choice("IVWYNRo" + "o" * 3) for _ in range(draw.randint(1, 14))]
        symbols, weights = list(read), [1.0] * len(read)
        for step in toxicity.STEPS.values():
            t = step()
            state = t.start
            for i, s in enumerate(symbols):
                state, symbols[i], w = t.arcs[state, s]
                weights[i] *= w
        state, got = 0, []
        for s in read:
            arc = state + toxicity.SYMBOLS.index(s)
            state = whole.to[arc]
            got.append((whole.wrote[arc], pytest.approx(whole.weight[arc])))
        assert list(zip(symbols, weights)) == got


def test_toxic_classes(spark):
    """Insults, threat verbs and cues are learned; a copied passage teaches nothing."""
    draw = random.Random(6)
    fill = lambda n: " ".join(draw.choice("ba be bi bo bu da de di do du ga ge gi go".split()) + draw.choice("lnrst") for _ in range(n))
    rows = [(f"{fill(5)} gronk {fill(5)}. {fill(2)} will zappe {fill(1)} you.", 1) for _ in range(60)]
    rows += [(f"{fill(9)}. quoth gronk.", 0) for _ in range(3)] + [(f"{fill(6)} nay gronk {fill(3)}", 0) for _ in range(12)]
    rows += [(fill(12), 0) for _ in range(80)] + [("special passage of words that nobody else ever wrote", 1)] * 20
    df = spark.createDataFrame(rows, "text string, label int")
    lexicon = toxicity.learn(df, 80, odds=1.5)
    symbol = {w: s for w, (s, _) in (lexicon.words | lexicon.stems).items()}
    assert symbol["gronk"] == "I" and symbol["zappe"] == "V" and symbol["nay"] == "N"
    assert not {"special", "passage", "nobody"} & set(symbol)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_scores_edges_fitted(spark, module):
    """Nulls, empty and long texts, repeated rows and clashing columns through a fitted model."""
    column = "quality" if module is quality else "toxic"
    draw = random.Random(8)
    good = [(i, f"{prose(i, 60)} {'gronk' if i % 2 else 'calm'} {draw.random()} {prose(900 + i, 5)}") if module is toxicity else (i, prose(i, 80) if i % 2 else " ".join(draw.choice("#$%&*") * 3 for _ in range(90))) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in good] + [(0, 0), (500, 1)], f"doc_id long, {column} int")
    model = module.fit(clashing(spark, good + good[:3] + [(500, None)]), labels, F.lit(False))
    odd = [(None, good[1][1]), (700, None), (701, ""), (702, "é" * 200_000), (703, good[1][1]), (703, good[1][1]), (704, "x" * 300_000)]
    out = module.score(clashing(spark, good + odd), model).collect()
    assert len(out) == len(good) + len(odd) and all(0 <= r.score <= 1 for r in out)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r.score)
    assert by[700] == by[701] and len(by[703]) == 2 and len(set(by[703])) == 1 and by[None] == by[1]
    assert sum((by[i][0] >= 0.5) == (i % 2 == 1) for i, _ in good) >= 90


def test_quality_keep_rows(spark):
    """Rows are judged by their own texts: another text of the same id, and null ids, change nothing."""
    draw = random.Random(9)
    junk = lambda: " ".join(draw.choice("#$%&*") * 3 for _ in range(90))
    rows = [(i, prose(i, 80) if i % 2 else junk()) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    docs = clashing(spark, rows + [(1, junk()), (None, junk()), (None, prose(1, 80))])
    kept = quality.keep(docs, labels, F.lit(False), threshold=0.5)
    assert kept.columns == docs.columns
    texts = [(r.doc_id, r.text[0] in "#$%&*") for r in kept.collect()]
    assert (1, False) in texts and (1, True) not in texts and (None, True) not in texts and (None, False) in texts


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    source = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in quality.score(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), quality.fold(4, 2))).filter("score >= 0.7").collect()}
    prints = {i: brute.fingerprint(source[i]) for i in good}
    linked = brute.groups(list(prints.items()))
    stay = sorted(i for i in good if linked[i] == i)
    seen, texts = set(), {}
    for i in stay:
        raw = (source[i] or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                gone[s : s + 100] = b"\x01" * 100
            seen.add(raw[s : s + 100])
        texts[i] = bytes(b for b, g in zip(raw, gone) if not g).decode(errors="ignore")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = [r[0] for r in brute.contamination(sorted(texts.items()), items) if not r[-1]]
    want = {i: [*ids, 0] for i, ids in zip(clean, brute.token_ids([texts[i] for i in clean]))}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.ids_crc32 == brute.crc(want[r.doc_id][r.start : r.start + r.length])
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == {i: len(x) for i, x in want.items()}


def test_pipeline_edges(spark, corpus, tmp_path):
    import corpus_pipeline

    sf = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for rows in ([], corpus + [(None, "x"), (None, None)] + corpus[:2]):
        docs = clashing(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
            assert name == "packing" or docs.columns == clashing(spark, []).columns
        docs.count()


def test_queries_by_brute_force(spark, sf_dir):
    """The registered queries of operators without SQL, on a whole small table."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.op1_suffixes(spark, sf_dir).collect()} == brute.removed(rows)
    prints = {i: brute.fingerprint(t) for i, t in rows}
    linked = brute.groups(list(prints.items()))
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.op4_simhash(spark, sf_dir).collect()} == {(i, f"{prints[i]:016x}", linked[i]) for i, _ in rows}
    encoded, at, want = dict(zip((i for i, _ in rows), brute.token_ids([t for _, t in rows]))), 0, []
    for i in sorted(encoded):
        ids = [*encoded[i], 2]
        want.append((i, at, len(ids), brute.crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, tokenfile.op5_tokens(spark, sf_dir).collect())) == want
    for r in packing.op9_packing(spark, sf_dir).collect():
        assert r.ids_crc32 == brute.crc([*encoded[r.doc_id], 0][r.start : r.start + r.length])


def test_long_texts():
    words = prose(11, 90_000)
    raw = memoryview(words.encode())
    whole, cut = decontamination.word_hashes([raw], 1 << 30), decontamination.word_hashes([raw], 1000)
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut))
    assert simhash.fingerprint(words.encode()) == brute.fingerprint(words)
