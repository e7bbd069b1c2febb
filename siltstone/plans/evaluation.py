"""Queries of sampling, packing, metrics and inference."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions import keys as K
from siltstone.functions import text as T
from siltstone.operators import inference as I
from siltstone.operators import metrics as M
from siltstone.operators import records
from siltstone.operators import rewrite as R
from siltstone.operators import sampling as S

from .base import Registry
from .texts import PAIRS_SQL, dealt_pairs, pairs

REGISTRY = Registry()
query = REGISTRY.query
HASH_SQL = "sha256('{0}' || chr(31) || CAST({1} AS VARCHAR))"


def r6(c):
    return F.round(c, 6)


@query("""WITH n AS (SELECT lang, count(*) AS n FROM documents WHERE doc_id % 10 > 1 GROUP BY lang), w AS (SELECT lang, n, power(n / sum(n) OVER (), -0.5) AS raw FROM n), m AS (SELECT sum(raw * n) / sum(n) AS m FROM w)
SELECT d.doc_id, round(CASE WHEN doc_id % 10 > 1 THEN greatest(0.25, least(4.0, raw / m)) ELSE 1 END, 6) AS weight FROM documents d JOIN w USING (lang), m""")
def temperature_weights(read):
    d = S.temperature_weights(read("documents"), "lang", F.col("doc_id") % 10 > 1)
    return d.select("doc_id", r6("sampling_weight").alias("weight"))


@query("""WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), e AS (SELECT lang, sqrt(n) / sum(sqrt(n)) OVER () * 500 AS e FROM n),
q AS (SELECT lang, floor(e) AS f, row_number() OVER (ORDER BY round(e - floor(e), 9) DESC, lang) AS r, 500 - sum(floor(e)) OVER () AS rest FROM e), k AS (SELECT lang, CAST(f + (r <= rest)::INT AS BIGINT) AS quota FROM q),
s AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('7' || chr(31) || CAST(doc_id AS VARCHAR))) AS r FROM documents)
SELECT lang, quota, count(doc_id) AS taken FROM k JOIN s USING (lang) WHERE r <= quota GROUP BY ALL""")
def balanced_corpus(read):
    """Quotas by n^0.5 with largest remainders, filled by hash order."""
    d = read("documents").select("doc_id", "lang")
    n = d.groupBy("lang").agg(F.sqrt(F.count("*")).alias("w"))
    e = n.crossJoin(F.broadcast(n.agg(F.sum("w").alias("t")))).withColumn("e", F.col("w") / F.col("t") * 500)
    q = S.largest_remainder(e, "lang", "e", 500)
    s = S.bottom_hash(d.join(F.broadcast(q), "lang"), ["lang"], K.stable_hash(7, F.col("doc_id")), F.col("quota"))
    return s.groupBy("lang", "quota").agg(F.count("*").alias("taken"))


@query("SELECT lang, source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('11' || chr(31) || CAST(doc_id AS VARCHAR))) AS r FROM documents) WHERE r <= 2")
def stratified_sample(read):
    """Two rows of each stratum by hash."""
    return S.bottom_hash(read("documents").select("lang", "source", "doc_id"), ["lang", "source"], K.stable_hash(11, F.col("doc_id")), 2)


@query("""WITH s AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('3' || chr(31) || CAST(doc_id AS VARCHAR))) AS r, sha256('3' || chr(31) || CAST(doc_id AS VARCHAR)) AS h FROM documents),
q AS (SELECT doc_id FROM s WHERE r <= 20), t AS (SELECT doc_id FROM s WHERE r > 20 ORDER BY h LIMIT 120 - 80) SELECT doc_id FROM q UNION ALL SELECT doc_id FROM t""")
def quota_with_top_up(read):
    """20 rows of each label, then the least hashes of the rest up to 120 in all."""
    h = K.stable_hash(3, F.col("doc_id"))
    s = read("documents").select("doc_id", "lang").withColumn("h", h).withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    return s.filter("r <= 20").select("doc_id").union(s.filter("r > 20").orderBy("h").limit(40).select("doc_id"))


@query("""WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source), s AS (SELECT source, n, unnest(range(0, CAST(floor(n * 0.15) AS BIGINT))) AS k FROM n), t AS (SELECT source FROM s ORDER BY k * sqrt(greatest(n, 1)), n, source LIMIT 60)
SELECT n.source, count(t.source) AS allocated FROM n LEFT JOIN t USING (source) GROUP BY n.source""")
def synthetic_allocation(read):
    n = read("documents").groupBy("source").agg(F.count("*").alias("n"))
    return S.allocate_by_weight(n, "source", "n", 60)


@query("""WITH b AS (SELECT doc_id, lang, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents), c AS (SELECT doc_id, lang, len(w) + 1 AS t, coalesce(sum(len(w) + 1) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM b)
SELECT lang, doc_id, CAST(start AS BIGINT) AS start, CAST(start // 1024 AS BIGINT) AS first_block, CAST((start + t - 1) // 1024 AS BIGINT) AS last_block FROM c""")
def block_packing(read):
    """Offsets and blocks of documents laid end to end (word counts stand for tokens)."""
    d = read("documents").select("doc_id", "lang", (F.size(T.words(F.col("text"))) + 1).cast("long").alias("t"))
    return S.blocks(d, ["lang"], "doc_id", "t", 1024).select("lang", "doc_id", F.col("start").cast("long").alias("start"), F.col("first_block").cast("long").alias("first_block"), F.col("last_block").cast("long").alias("last_block"))


@query("SELECT source, CASE WHEN i < 1000 % 20 THEN 51 ELSE 50 END AS quota FROM (SELECT source, dense_rank() OVER (ORDER BY source) - 1 AS i FROM (SELECT DISTINCT source FROM documents))")
def even_quota(read):
    ids = read("documents").select("source").distinct().withColumn("i", F.dense_rank().over(Window.orderBy("source")) - 1)
    return ids.select("source", K.quota(1000, F.col("i"), 20).alias("quota"))


@query("""WITH p AS (SELECT * FROM (VALUES ('a', 0.5::DOUBLE), ('b', 0.3::DOUBLE), ('c', 0.2::DOUBLE)) t(name, p)) SELECT name, round(p / (SELECT sum(p) FROM p WHERE name <> 'c'), 6) AS p FROM p WHERE name <> 'c'""")
def renormalized_mixture(read):
    spark = read("region").sparkSession
    p = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.2)], "name string, p double").filter("name <> 'c'")
    return p.crossJoin(F.broadcast(p.agg(F.sum("p").alias("t")))).select("name", r6(F.col("p") / F.col("t")).alias("p"))


@query("SELECT doc_id, dense_rank() OVER (ORDER BY source) - 1 AS source_index FROM documents")
def dense_ids(read):
    """Dense indices of sorted distinct values; the window sees distinct values only."""
    ids = read("documents").select("source").distinct().withColumn("source_index", (F.row_number().over(Window.orderBy("source")) - 1).cast("long"))
    return read("documents").join(ids, "source").select("doc_id", "source_index")


@query("""WITH f AS (SELECT DISTINCT text, ('0x' || substr(sha256('5' || chr(31) || text), 1, 8))::UBIGINT::HUGEINT * 4294967296 + ('0x' || substr(sha256('5' || chr(31) || text), 9, 8))::UBIGINT::HUGEINT AS h FROM documents)
SELECT md5(text) AS k, CAST(h % 5 AS BIGINT) AS fold FROM f""")
def group_folds(read):
    """Folds that keep rows of one text together."""
    return read("documents").select(F.md5("text").alias("k"), S.group_fold(F.col("text"), 5, 5).alias("fold")).distinct()


@query("""SELECT doc_id, k + 1 AS rater FROM (SELECT doc_id, (('0x' || substr(sha256('blind' || chr(31) || CAST(doc_id AS VARCHAR)), 1, 8))::UBIGINT + j) % 5 AS k FROM documents, (SELECT unnest([0, 1, 2]) AS j)) """.replace("k + 1", "CAST(k + 1 AS BIGINT)"))
def rating_packets(read):
    """Three of five raters for each row, in turn from an offset by hash."""
    h = F.conv(F.substr(K.stable_hash("blind", F.col("doc_id")), F.lit(1), F.lit(8)), 16, 10).cast("long")
    return read("documents").select("doc_id", h.alias("h"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j")).select("doc_id", (F.pmod(F.col("h") + F.col("j"), F.lit(5)) + 1).cast("long").alias("rater"))


PREDICTION_SQL = "pr AS (SELECT vec_id, label, list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS pred FROM embeddings WHERE embedding IS NOT NULL)"


def _predictions(read):
    e = read("embeddings").filter("embedding is not null")
    return e.select("vec_id", F.col("label").cast("long").alias("label"), M.argmax(F.slice("embedding", 1, 10)).alias("pred"))


CLASS_SQL = f"""{PREDICTION_SQL}, cl AS (SELECT DISTINCT label AS c FROM pr UNION SELECT DISTINCT pred FROM pr),
pc AS (SELECT c, (SELECT count(*) FROM pr WHERE label = c AND pred = c) AS tp, (SELECT count(*) FROM pr WHERE label = c) AS support, (SELECT count(*) FROM pr WHERE pred = c) AS said FROM cl),
pf AS (SELECT *, CASE WHEN said > 0 THEN tp / said ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall, CASE WHEN said + support > 0 THEN 2 * tp / (said + support) ELSE 0 END AS f1 FROM pc)"""


@query(f"WITH {CLASS_SQL} SELECT CAST(c AS BIGINT) AS class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM pf")
def per_class_metrics(read):
    c = M.per_class(M.confusion(_predictions(read), "label", "pred"))
    return c.select("class", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"), "support")


@query(f"""WITH {CLASS_SQL}, n AS (SELECT count(*)::DOUBLE AS n FROM pr)
SELECT CAST(n AS BIGINT) AS n, round(sum(tp) / n, 6) AS accuracy, round(avg(recall) FILTER (support > 0), 6) AS balanced_accuracy, round(avg(f1), 6) AS macro_f1, round(min(f1) FILTER (support > 0), 6) AS worst_f1, round(sum(f1 * support) / n, 6) AS weighted_f1,
 round((sum(tp) * n - sum(said * support)) / sqrt((n * n - sum(said * said)) * (n * n - sum(support * support))), 6) AS mcc FROM pf, n GROUP BY n""")
def classification_summary(read):
    s = M.summary(M.confusion(_predictions(read), "label", "pred"))
    return s.select("n", *[r6(c).alias(c) for c in ("accuracy", "balanced_accuracy", "macro_f1", "worst_f1", "weighted_f1", "mcc")])


@query(f"""WITH {PREDICTION_SQL}, s AS (SELECT label % 2 AS source, label, pred FROM pr) SELECT CAST(source AS BIGINT) AS source, count(*) AS n, round(avg((label = pred)::INT), 6) AS accuracy FROM s GROUP BY source""")
def metrics_by_source(read):
    s = M.summary(M.confusion(_predictions(read).withColumn("source", F.col("label") % 2), "label", "pred", ["source"]), ["source"])
    return s.select("source", "n", r6("accuracy").alias("accuracy"))


@query("""WITH c AS (SELECT (doc_id * 7919 % 1000) / 999.0::DOUBLE AS conf, quality = 1 AS ok FROM labels), e AS (SELECT *, len(list_filter(range(0, 16), lambda i: i / 15 < conf)) AS b FROM c WHERE conf > 0),
g AS (SELECT b, count(*) AS n, avg(ok::INT) AS a, avg(conf) AS c FROM e GROUP BY b) SELECT round(sum(n * abs(a - c)) / (SELECT count(*) FROM c), 6) AS ece FROM g""")
def calibration_error(read):
    l = read("labels").select((F.col("doc_id") * 7919 % 1000 / F.lit(999.0)).alias("conf"), (F.col("quality") == 1).alias("ok"))
    return M.calibration_error(l, "conf", "ok").select(r6("ece").alias("ece"))


UNIT_SQL = "((('0x' || substr(h, 1, 8))::UBIGINT::HUGEINT * 4294967296 + ('0x' || substr(h, 9, 8))::UBIGINT::HUGEINT)::DOUBLE / 18446744073709551616.0::DOUBLE)"
SOFTMAX_SQL = "sm AS (SELECT vec_id, label, list_transform(embedding[1:10], lambda x: exp((x - list_max(embedding[1:10]))::DOUBLE / {0})) AS e FROM embeddings WHERE embedding IS NOT NULL), so AS (SELECT vec_id, label, list_transform(e, lambda x: x / list_sum(e)) AS p FROM sm)"


@query(f"WITH {SOFTMAX_SQL.format('0.5::DOUBLE')} SELECT vec_id, round(list_max(p), 5) AS top, CAST(list_position(p, list_max(p)) - 1 AS BIGINT) AS argmax, round(-list_sum(list_transform(p, lambda x: x * ln(x))), 5) AS entropy FROM so")
def softmax_predictions(read):
    """Softmax at temperature 0.5: confidence, argmax and entropy of each vector."""
    e = read("embeddings").filter("embedding is not null").select("vec_id", M.softmax(F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double")), 0.5).alias("p"))
    return e.select("vec_id", F.round(F.array_max("p"), 5).alias("top"), M.argmax(F.col("p")).alias("argmax"), F.round(-F.aggregate(F.transform("p", lambda x: x * F.log(x)), F.lit(0.0), lambda a, x: a + x), 5).alias("entropy"))


@query(f"WITH {SOFTMAX_SQL.format('1::DOUBLE')} SELECT label, round(avg(list_sum(list_transform(range(1, 11), lambda i: power(p[i] - (i - 1 = label)::INT, 2)))), 5) AS brier FROM so GROUP BY label")
def brier_scores(read):
    e = read("embeddings").filter("embedding is not null").select("label", M.softmax(F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double"))).alias("p"))
    return e.groupBy("label").agg(F.round(F.avg(M.brier(F.col("p"), F.col("label"))), 5).alias("brier"))


@query(f"WITH {SOFTMAX_SQL.format('1::DOUBLE')}, r AS (SELECT vec_id, [p[1], p[3], p[5]] AS q, p FROM so) SELECT vec_id, round(q[1] / list_sum(q), 5) AS first, round(0.7::DOUBLE * p[1] + 0.3::DOUBLE * 0.1::DOUBLE, 5) AS blend FROM r")
def restricted_and_blended(read):
    """Probabilities restricted to three classes, and a blend with the uniform distribution."""
    e = read("embeddings").filter("embedding is not null").select("vec_id", M.softmax(F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double"))).alias("p"))
    return e.select("vec_id", F.round(M.restricted(F.col("p"), [0, 2, 4])[0], 5).alias("first"), F.round(M.blended(F.col("p"), F.array_repeat(F.lit(0.1), 10), 0.7)[0], 5).alias("blend"))


@query("""WITH l AS (SELECT vec_id, list_transform(embedding[1:5], lambda x: x::DOUBLE) AS a, list_transform(embedding[6:10], lambda x: x::DOUBLE) AS b FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT vec_id, list_transform(a, lambda x: exp(x) / list_sum(list_transform(a, lambda y: exp(y)))) AS p, list_transform(b, lambda x: exp(x) / list_sum(list_transform(b, lambda y: exp(y)))) AS q FROM l)
SELECT vec_id, round(list_sum(list_transform(range(1, 6), lambda i: (p[i] - q[i]) * (ln(p[i]) - ln(q[i])))) / 2, 5) AS kl FROM s""")
def logit_divergence(read):
    part = lambda a: F.transform(F.slice("embedding", a, 5), lambda x: x.cast("double"))
    return read("embeddings").filter("embedding is not null").select("vec_id", F.round(M.symmetric_kl(part(1), part(6)), 5).alias("kl"))


@query("""WITH l AS (SELECT label, list_transform(embedding[1:10], lambda x: exp(x::DOUBLE)) AS a, list_transform(embedding[11:20], lambda x: exp(x::DOUBLE)) AS b FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT label, list_transform(a, lambda x: x / list_sum(a)) AS p, list_transform(b, lambda x: x / list_sum(b)) AS q FROM l),
g AS (SELECT label, w, list_transform(range(1, 11), lambda i: w * p[i] + (1 - w) * q[i]) AS m FROM s, (SELECT unnest(range(0, 11)) / 10::DOUBLE AS w))
SELECT w, avg((list_position(m, list_max(m)) - 1 = label)::INT) AS accuracy FROM g GROUP BY w""")
def weight_grid(read):
    """Blend weights of the grid with the accuracy of each, best first (the grid is 11 rows)."""
    e = read("embeddings").filter("embedding is not null").select("label", *[M.softmax(F.transform(F.slice("embedding", a, 10), lambda x: x.cast("double"))).alias(n) for a, n in ((1, "p"), (11, "q"))])
    grid = e.withColumn("w", F.explode(F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: i / 10)))
    mix = F.zip_with("p", "q", lambda x, y: F.col("w") * x + (1 - F.col("w")) * y)
    return grid.groupBy("w").agg(F.avg((M.argmax(mix) == F.col("label")).cast("double")).alias("accuracy")).orderBy(F.desc("accuracy"), "w")


@query()
def chrf_by_source(read):
    """chrF++ of answers against questions by turn, from summed statistics, and its mean."""
    p = pairs(read).withColumn("stats", M.chrf_statistics("target", "source"))
    g = p.groupBy("turn").agg(F.count("*").alias("n"), M.vector_sum("stats", 24).alias("stats"))
    return g.select("turn", "n", M.chrf_score(F.col("stats")).alias("chrf"))


@query()
def view_transfer(read):
    """Three views of an answer by run (turn modulo 4): the question itself, its rewriting by learned replacements, and
    the one of both that a fixed margin on their lengths selects; chrF++ against the answer over three labels, and
    the share of rows where the first is selected."""
    p = dealt_pairs(read).withColumn("run", F.col("turn").cast("long") % 4).withColumn("label", (F.col("conv_id") % 3).cast("string")).withColumn("id", F.struct("conv_id", "turn"))
    mapping = R.learn(p, "label", "source", "target", 1, 0.5)
    rewritten = R.apply_map(p, "id", "label", "source", mapping)
    both = p.join(rewritten, "id").withColumnRenamed("source", "raw")
    chosen = records.select_by_margin(both, (F.length("raw") - F.length("rewritten")).cast("double"), 0.0, "raw", "rewritten")
    share = chosen.groupBy("run").agg(F.avg((F.col("choice") == "raw").cast("double")).alias("raw_share"))
    scores = M.view_scores(chosen, ["run"], "label", {"raw": "raw", "rewrite": "rewritten", "fused": "chosen"}, "target")
    return scores.join(share, "run").select("run", "view", "n", r6("macro_chrf").alias("macro_chrf"), r6("worst_chrf").alias("worst_chrf"), r6("raw_share").alias("raw_share"))


@query()
def edit_metrics(read):
    """CER, WER, BLEU and exact match of whole texts by turn."""
    p = dealt_pairs(read).withColumn("s", M.edit_statistics("target", "source"))
    g = p.groupBy("turn").agg(M.vector_sum("s", 13).alias("s"), F.avg((F.col("target") == F.col("source")).cast("double")).alias("exact"))
    return g.select("turn", (F.get("s", F.lit(0)) / F.get("s", F.lit(1))).alias("cer"), (F.get("s", F.lit(2)) / F.get("s", F.lit(3))).alias("wer"), M.bleu_score(F.col("s")).alias("bleu"), "exact")


@query()
def shifted_edit_rate(read):
    """TER of whole answers against questions by turn: a ratio of sums."""
    p = dealt_pairs(read).withColumn("s", M.shift_statistics("target", "source"))
    return p.groupBy("turn").agg(F.count("*").alias("n"), (100 * F.sum(F.get("s", F.lit(0))) / F.sum(F.get("s", F.lit(1)))).alias("ter"))


@query(r"""WITH PAIRS SELECT turn, count(*) AS n, round(sum(levenshtein(regexp_replace(target, '[^\x00-\x7F]', '?', 'g'), regexp_replace(source, '[^\x00-\x7F]', '?', 'g'))) / sum(length(source)), 6) AS text_distance FROM pairs GROUP BY turn""".replace("PAIRS", PAIRS_SQL, 1))
def text_distance(read):
    """Edit distance of whole texts over their length by turn, other signs than ASCII being equal."""
    a, b = (F.regexp_replace(F.col(c), r"[^\x00-\x7F]", "?") for c in ("target", "source"))
    return dealt_pairs(read).groupBy("turn").agg(F.count("*").alias("n"), r6(F.sum(F.levenshtein(a, b)) / F.sum(F.length(b))).alias("text_distance"))


@query("""WITH g AS (SELECT lang, source, sum(quality) AS hit, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL),
d AS (SELECT lang, r, hit, n, sha256('13' || chr(31) || CAST(r AS VARCHAR) || chr(31) || source) AS h FROM g, LATERAL (SELECT unnest(range(1, 201)) AS r)),
w AS (SELECT *, len(list_filter(range(0, 7), lambda k: list_sum(list_transform(range(0, k + 1), lambda i: exp(-1) / factorial(i::INTEGER)::DOUBLE)) <= UNIT)) AS w FROM d),
x AS (SELECT lang, r, sum(w * hit) / nullif(sum(w * n), 0) AS ratio FROM w GROUP BY ALL)
SELECT lang, round(quantile_cont(ratio, 0.025), 6) AS low, round(quantile_cont(ratio, 0.975), 6) AS high FROM x GROUP BY lang""".replace("UNIT", UNIT_SQL))
def bootstrap_interval(read):
    """Cluster bootstrap of accuracy by label, groups being sources: the draws are hashes."""
    d = read("documents").select("doc_id", "source", "lang").join(read("labels"), "doc_id")
    stats = d.groupBy("lang", "source").agg(F.sum("quality").alias("hit"), F.count("*").alias("n"))
    out = I.interval(I.cluster_bootstrap(stats, "source", "hit", "n", 200, 13, ["lang"]), "ratio", by=["lang"])
    return out.select("lang", r6("low").alias("low"), r6("high").alias("high"))


@query("""WITH s AS (SELECT source, avg(quality) - avg(toxic) AS d FROM documents JOIN labels USING (doc_id) GROUP BY source), o AS (SELECT sum(d) AS o FROM s),
x AS (SELECT r, sum(CASE WHEN substr(sha256('17' || chr(31) || CAST(r AS VARCHAR) || chr(31) || source), 1, 1) <= '7' THEN -d ELSE d END) AS x FROM s, LATERAL (SELECT unnest(range(1, 501)) AS r) GROUP BY r)
SELECT round(o, 6) AS observed, round((count(*) FILTER (abs(x) >= abs(o) - 1e-12) + 1) / (count(*) + 1), 6) AS p_value FROM x, o GROUP BY o""")
def randomization_test(read):
    """Paired randomization of quality against toxicity, whole sources being swapped."""
    d = read("documents").select("doc_id", "source").join(read("labels"), "doc_id")
    stats = d.groupBy("source").agg(F.avg("quality").alias("t"), F.avg("toxic").alias("c"))
    return I.paired_randomization(stats, "source", "t", "c", 500, 17).select(r6("observed").alias("observed"), r6("p_value").alias("p_value"))


@query("""WITH p AS (SELECT p_brand, p_partkey, least(1.0, (p_partkey % 97) / 500.0::DOUBLE) AS p FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p, p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS m FROM p)
SELECT p_partkey, round(max(least(1.0, (m - r + 1) * p)) OVER (PARTITION BY p_brand ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS adjusted FROM r""")
def holm_adjusted(read):
    p = read("part").select("p_brand", "p_partkey", F.least(F.lit(1.0), (F.col("p_partkey") % 97) / F.lit(500.0)).alias("p"))
    return I.holm(p, "p", ["p_brand"], "p_partkey").select("p_partkey", r6("adjusted").alias("adjusted"))


@query("""WITH n AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY ALL), a AS (SELECT a, sum(n) AS na FROM n GROUP BY a), b AS (SELECT b, sum(n) AS nb FROM n GROUP BY b)
SELECT round(1 - (SELECT sum((a <> b)::INT * n) FROM n) * (SELECT sum(n) FROM n) / (SELECT sum((a <> b)::INT * na * nb) FROM a, b), 6) AS kappa""")
def rater_kappa(read):
    return I.kappa(read("labels"), "quality", "toxic").select(r6("kappa").alias("kappa"))


@query("""WITH n AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*)::DOUBLE AS n FROM orders GROUP BY ALL), t AS (SELECT sum(n) AS t FROM n), a AS (SELECT a, sum(n) AS na FROM n GROUP BY a), b AS (SELECT b, sum(n) AS nb FROM n GROUP BY b)
SELECT round((SELECT sum(n / t * ln(n * t / (na * nb))) FROM n JOIN a USING (a) JOIN b USING (b), t) / sqrt((SELECT sum(-na / t * ln(na / t)) FROM a, t) * (SELECT sum(-nb / t * ln(nb / t)) FROM b, t)), 8) AS nmi""")
def mutual_information(read):
    n = read("orders").groupBy(F.col("o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b")).agg(F.count("*").cast("double").alias("n"))
    return I.mutual_information(n, "a", "b", "n").select(F.round("nmi", 8).alias("nmi"))


@query("""WITH n AS (SELECT lang AS a, source AS b, count(*)::DOUBLE AS n FROM documents GROUP BY ALL), a AS (SELECT a, sum(n) AS na FROM n GROUP BY a), b AS (SELECT b, sum(n) AS nb, max(n) AS most FROM n GROUP BY b), t AS (SELECT sum(n) AS t, count(DISTINCT b) AS k FROM n),
g AS (SELECT a.a, b.b, coalesce(n, 0) / na AS p FROM a CROSS JOIN b LEFT JOIN n ON n.a = a.a AND n.b = b.b),
j AS (SELECT x.a, y.a AS c, sum(CASE WHEN x.p > 0 THEN x.p * log2(2 * x.p / (x.p + y.p)) ELSE 0 END + CASE WHEN y.p > 0 THEN y.p * log2(2 * y.p / (x.p + y.p)) ELSE 0 END) / 2 AS d FROM g x JOIN g y ON x.b = y.b AND x.a < y.a GROUP BY ALL)
SELECT round((SELECT sum(n / t * ln(n * t / (na * nb))) FROM n JOIN a USING (a) JOIN b USING (b), t) / sqrt((SELECT sum(-na / t * ln(na / t)) FROM a, t) * (SELECT sum(-nb / t * ln(nb / t)) FROM b, t)), 6) AS nmi,
  round((SELECT avg(d) FROM j), 6) AS divergence, round((SELECT sum(most) / any_value(t) FROM b, t), 6) AS purity, round((SELECT stddev_pop(nb) / avg(nb) FROM b), 6) AS load_cv, round((SELECT sum(-nb / t * ln(nb / t)) / ln(any_value(k)) FROM b, t), 6) AS load_entropy""")
def label_specialization(read):
    """How far languages differ in their sources."""
    n = read("documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return I.specialization(n, "lang", "source", "n").select(*[r6(c).alias(c) for c in ("nmi", "divergence", "purity", "load_cv", "load_entropy")])


@query()
def temperature_fit(read):
    """The temperature at which the first ten coordinates as logits give the labels their least mean loss; a search
    is beyond SQL, a test compares with a fine grid."""
    e = read("embeddings").filter("embedding is not null").select(F.col("label").cast("int").alias("label"), F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double")).alias("logits"))
    fitted, loss = M.fit_temperature(e, "logits", "label")
    return e.sparkSession.createDataFrame([(fitted, loss)], "temperature double, loss double").select(F.round("temperature", 3).alias("temperature"), r6("loss").alias("loss"))


@query("""WITH q(lang, quota) AS (VALUES ('de', 600000), ('en', 800000), ('es', 200000), ('fr', 400000)), t AS (SELECT lang, CAST(sum(n_chars) AS BIGINT) AS t FROM documents GROUP BY lang),
e AS (SELECT lang, quota, quota // t AS whole, quota % t AS rest FROM q JOIN t USING (lang)),
o AS (SELECT lang, quota, whole, rest, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY lang ORDER BY substr(sha256('3' || chr(31) || CAST(whole AS VARCHAR) || chr(31) || CAST(doc_id AS VARCHAR)), 1, 12), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents JOIN e USING (lang))
SELECT lang, CAST(quota AS BIGINT) AS quota, CAST(whole + (rest > 0)::INT AS BIGINT) AS epochs, CAST(sum(whole + (before < rest)::INT) AS BIGINT) AS n_rows, CAST(sum(n_chars * (whole + (before < rest)::INT)) AS BIGINT) AS tokens FROM o GROUP BY ALL""")
def token_mixture(read):
    """Documents drawn by language until token quotas are full (characters stand for tokens), in a new order each epoch."""
    d = read("documents").select("doc_id", "lang", F.col("n_chars").cast("long").alias("tokens"))
    drawn = S.token_mixture(d, "lang", "doc_id", "tokens", {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1}, 2_000_000, 3)
    report = drawn.groupBy("lang", "quota").agg((F.max("epoch") + 1).alias("epochs"), F.count("*").alias("n_rows"), F.sum("tokens").alias("tokens"))
    return report.select("lang", "quota", "epochs", "n_rows", "tokens")


@query("""WITH m AS (SELECT o_orderstatus AS variant, o_custkey % 3 AS seed, avg(o_totalprice) AS v, count(*) AS n FROM orders GROUP BY ALL) SELECT variant, count(*) AS seeds, round(avg(v), 3) AS mean, round(stddev_samp(v), 3) AS std, row_number() OVER (ORDER BY avg(v) DESC) AS place FROM m GROUP BY variant""")
def leaderboard(read):
    m = read("orders").groupBy(F.col("o_orderstatus").alias("variant"), (F.col("o_custkey") % 3).alias("seed")).agg(F.avg("o_totalprice").alias("v"))
    b = m.groupBy("variant").agg(F.count("*").alias("seeds"), F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    return b.select("variant", "seeds", F.round("m", 3).alias("mean"), F.round("s", 3).alias("std"), F.row_number().over(Window.orderBy(F.desc("m"))).cast("long").alias("place"))


@query()
def learned_rewrites(read):
    """One-to-one word replacements between questions and answers, kept by count and confidence, and applied."""
    p = pairs(read).select(F.lit("all").alias("label"), "source", "target")
    return R.learn(p, "label", "source", "target", 1, 0.5)


@query("""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, event_id, value AS v, event_id % 7 AS t FROM events),
s(user_id, i, sel, v, t, best) AS (SELECT user_id, i, event_id, v, t, v FROM e WHERE i = 1 UNION ALL
 SELECT e.user_id, e.i, CASE WHEN k THEN e.event_id ELSE s.sel END, CASE WHEN k THEN e.v ELSE s.v END, CASE WHEN k THEN e.t ELSE s.t END, least(s.best, e.v) FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1,
 LATERAL (SELECT e.v <= least(s.best, e.v) + 1 AND (s.v > least(s.best, e.v) + 1 OR e.t < s.t OR (e.t = s.t AND e.v < s.v)) AS k))
SELECT user_id, arg_max(sel, i)::DOUBLE AS selected FROM s GROUP BY user_id""")
def checkpoint_selection(read):
    """The step that each series keeps under a tolerance and a tie-break: a fold over ordered steps."""
    return R.select_checkpoints(read("events").withColumn("tie", F.col("event_id") % 7), "user_id", "event_id", "value", "tie", tolerance=1.0)


@query("""WITH w AS (SELECT item_id, string_split_regex(trim(text), '\\s+') AS w, unnest(range(1, len(string_split_regex(trim(text), '\\s+')) + 1)) AS i FROM benchmark),
m AS (SELECT item_id, i, CASE w[i] WHEN 'the' THEN 'THE' WHEN 'of' THEN 'OF' ELSE w[i] END AS o FROM w) SELECT item_id, string_agg(o, ' ' ORDER BY i) AS rewritten FROM m GROUP BY item_id""")
def rewritten_texts(read):
    """Texts rewritten word by word through a mapping table."""
    b = read("benchmark").select("item_id", F.lit("all").alias("label"), "text")
    mapping = b.sparkSession.createDataFrame([("all", "the", "THE"), ("all", "of", "OF")], "label string, word string, other string")
    return R.apply_map(b, "item_id", "label", "text", mapping)


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents), f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM f GROUP BY term HAVING count(*) >= 20), n AS (SELECT count(*) AS n FROM documents), w AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM f JOIN d USING (term), n)
SELECT doc_id, count(*) AS terms, round(max(w) / sqrt(sum(w * w)), 5) AS top FROM w GROUP BY doc_id""")
def tf_idf(read):
    """Sublinear TF-IDF with a document frequency floor, L2 normalized: terms and greatest weight of each row."""
    docs = read("documents")
    f = docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    d = f.groupBy("term").agg(F.count("*").alias("df")).filter("df >= 20")
    w = f.join(d, "term").crossJoin(F.broadcast(docs.agg(F.count("*").alias("n")))).withColumn("w", (1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    return w.groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.max("w") / F.sqrt(F.sum(F.col("w") * F.col("w"))), 5).alias("top"))


@query("""WITH RECURSIVE g AS (SELECT DISTINCT event_type AS g FROM events), l AS (SELECT event_id // 500 AS step, event_type AS g, avg(value) AS l FROM events GROUP BY ALL),
f AS (SELECT step, row_number() OVER (ORDER BY step) AS i, list(exp(0.01 * least(coalesce(l, 0), 20)) ORDER BY g) AS f, list(g ORDER BY g) AS names FROM (SELECT DISTINCT step FROM l) CROSS JOIN g LEFT JOIN l USING (step, g) GROUP BY step),
w(i, w) AS (SELECT 0::BIGINT, list_transform(names, lambda x: 1.0::DOUBLE / len(names)) FROM f WHERE i = 1 UNION ALL
 SELECT f.i, list_transform(c, lambda x: x / list_sum(c)) FROM w JOIN f ON f.i = w.i + 1, LATERAL (SELECT list_transform(range(1, len(names) + 1), lambda k: w.w[k] * f.f[k]) AS a),
 LATERAL (SELECT list_transform(a, lambda x: 0.9 * x / list_sum(a) + 0.1 / len(names)) AS b), LATERAL (SELECT list_transform(b, lambda x: least(greatest(x, list_avg(b) / 4), list_avg(b) * 4)) AS c))
SELECT CAST(step AS BIGINT) AS step, unnest(names) AS "group", round(unnest(w), 6) AS weight FROM w JOIN f USING (i)""")
def group_dro(read):
    """Group weights after each block of events in order; batch means are bounded by the operator, no event is left out."""
    return R.dro_weights(read("events"), "event_type", "value", "event_id", block=500).withColumn("weight", r6("weight"))


@query("""WITH d AS (SELECT doc_id, lang, CAST(substr(source, 4) AS INTEGER) % 3 = 0 AS made FROM documents), n AS (SELECT lang, count(*) FILTER (NOT made) AS r, count(*) FILTER (made) AS m, least(60, count(*)) AS t FROM d GROUP BY lang),
q AS (SELECT lang, t, least(r, t - least(CAST(round_even(t * CASE WHEN r < 50 THEN 0.35 ELSE 0.2 END, 0) AS BIGINT), m)) AS reals FROM n),
o AS (SELECT d.*, t, reals, row_number() OVER (PARTITION BY lang, made ORDER BY sha256('19' || chr(31) || CAST(doc_id AS VARCHAR))) AS r FROM d JOIN q USING (lang))
SELECT lang, doc_id FROM o WHERE r <= CASE WHEN made THEN t - reals ELSE reals END""")
def capped_sample(read):
    """60 rows of each language, synthetic ones a fifth at most where there are real ones enough."""
    d = read("documents").select("doc_id", "lang", (F.substr("source", F.lit(4)).cast("int") % 3 == 0).alias("made"))
    cap = lambda real: F.when(real < 50, 0.35).otherwise(0.2)
    return S.capped_sample(d, "lang", "made", K.stable_hash(19, F.col("doc_id")), 60, cap).select("lang", "doc_id")


@query("""WITH c AS (SELECT doc_id, lang, md5(lower(text)) AS k, sha256('23' || chr(31) || CAST(doc_id AS VARCHAR)) AS h FROM documents WHERE text IS NOT NULL),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY h) AS r FROM c WHERE k NOT IN (SELECT md5(text) FROM documents WHERE text IS NOT NULL)) WHERE r = 1)
SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY h) AS r FROM f) WHERE r <= 40""")
def fresh_variants(read):
    """40 lower-cased variants of each language by hash order that no text equals, each text once."""
    d = read("documents")
    variants = d.select("doc_id", "lang", F.md5(F.lower("text")).alias("k"))
    return S.fresh_rows(variants, d.select(F.md5("text").alias("k")), "k", ["lang"], K.stable_hash(23, F.col("doc_id")), 40).select("lang", "doc_id")


@query("""WITH t AS (SELECT CAST(sum(n_chars) AS BIGINT) AS t FROM documents), e AS (SELECT doc_id, n_chars, epoch, t FROM documents, t, LATERAL (SELECT unnest(range(0, CAST(ceil(6000640 / t) AS BIGINT))) AS epoch)),
o AS (SELECT *, epoch * t + coalesce(sum(n_chars) OVER (PARTITION BY epoch ORDER BY substr(sha256('31' || chr(31) || CAST(epoch AS VARCHAR) || chr(31) || CAST(doc_id AS VARCHAR)), 1, 12) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM e)
SELECT CAST(epoch AS BIGINT) AS epoch, count(*) AS n, CAST(sum(least(n_chars, 6000640 - start)) AS BIGINT) AS used, CAST(min(start // 1024) AS BIGINT) AS first_block, CAST(max((start + least(n_chars, 6000640 - start) - 1) // 1024) AS BIGINT) AS last_block
FROM o WHERE least(n_chars, 6000640 - start) > 0 GROUP BY epoch""")
def epoch_packing(read):
    """Documents end to end in a new order each epoch, until 6,000,000 tokens (characters stand for them) fill their blocks of 1024."""
    out = S.epoch_blocks(read("documents"), "doc_id", "n_chars", 6_000_000, 1024, 31)
    return out.groupBy("epoch").agg(F.count("*").alias("n"), F.sum("used").alias("used"), F.min("first_block").alias("first_block"), F.max("last_block").alias("last_block"))


@query("""WITH g AS (SELECT lang, source, sum(quality) AS hit, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY source) - 1 AS at FROM g), z AS (SELECT lang, count(*) AS m FROM p GROUP BY lang),
d AS (SELECT lang, m, r, j, sha256('37' || chr(31) || CAST(r AS VARCHAR) || chr(31) || lang || chr(31) || CAST(j AS VARCHAR)) AS h FROM z, LATERAL (SELECT unnest(range(1, 101)) AS r), LATERAL (SELECT unnest(range(0, m)) AS j)),
k AS (SELECT lang, r, CAST((('0x' || substr(h, 1, 8))::UBIGINT::HUGEINT * 4294967296 + ('0x' || substr(h, 9, 8))::UBIGINT::HUGEINT) % m AS BIGINT) AS at FROM d),
x AS (SELECT k.lang, r, sum(hit) / sum(n) AS ratio FROM k JOIN p ON k.lang = p.lang AND k.at = p.at GROUP BY ALL)
SELECT lang, round(quantile_cont(ratio, 0.025), 6) AS low, round(quantile_cont(ratio, 0.975), 6) AS high FROM x GROUP BY lang""")
def stratified_interval(read):
    """Percentile interval of quality by language: sources are drawn within their language, 100 replicates."""
    d = read("documents").select("doc_id", "source", "lang").join(read("labels"), "doc_id")
    stats = d.groupBy("lang", "source").agg(F.sum("quality").alias("hit"), F.count("*").alias("n"))
    drawn = I.stratified_resample(stats, "lang", "source", 100, 37).groupBy("lang", "replicate").agg((F.sum("hit") / F.sum("n")).alias("ratio"))
    return drawn.groupBy("lang").agg(r6(F.percentile("ratio", F.lit(0.025))).alias("low"), r6(F.percentile("ratio", F.lit(0.975))).alias("high"))
