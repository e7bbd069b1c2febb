"""Queries of aggregations, windows, sets, joins and token mining."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import aggregates as A
from siltstone.operators import sampling as S

from .base import Registry

REGISTRY = Registry()
query = REGISTRY.query


def r6(c):
    return F.round(c, 6)


@query("SELECT source, lang, count(*) AS n, count(DISTINCT text) AS texts, count(*) FILTER (n_chars < 500) AS short FROM documents GROUP BY source, lang")
def group_counts(read):
    """Rows, distinct texts and a predicate count by two keys, null keys kept."""
    return read("documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.countDistinct(F.md5("text")).alias("texts"), F.count_if(F.col("n_chars") < 500).alias("short"))


@query("SELECT lang, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std, round(median(n_chars), 6) AS median, round(quantile_cont(n_chars, 0.95), 6) AS p95, round(quantile_cont(n_chars, 0.99), 6) AS p99, sum(n_chars)::BIGINT AS total, max(n_chars) AS longest FROM documents GROUP BY lang")
def length_summary(read):
    """Means, sample deviations, exact quantiles with interpolation."""
    c = "n_chars"
    return read("documents").groupBy("lang").agg(r6(F.avg(c)).alias("mean"), r6(F.stddev_samp(c)).alias("std"), r6(F.median(c)).alias("median"), r6(F.percentile(c, F.lit(0.95))).alias("p95"), r6(F.percentile(c, F.lit(0.99))).alias("p99"), F.sum(c).alias("total"), F.max(c).alias("longest"))


@query("SELECT user_id, first(event_type ORDER BY n DESC, event_type) AS top_type, max(n) AS top_n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def majority_label(read):
    """The most frequent type of each user, ties by name."""
    n = read("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    best = n.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "event_type")).alias("b"))
    return best.select("user_id", F.col("b.event_type").alias("top_type"), (-F.col("b.m")).alias("top_n"))


@query("""WITH g AS (SELECT text, count(*) AS n, count(DISTINCT source) AS s FROM documents GROUP BY text)
SELECT (SELECT count(*) FROM documents) AS rows, count(*) AS unique_texts, sum(n) FILTER (n > 1)::BIGINT AS rows_in_groups, count(*) FILTER (s > 1) AS cross_label_texts, sum(n) FILTER (s > 1)::BIGINT AS cross_label_rows FROM g""")
def corpus_diagnostics(read):
    g = read("documents").groupBy(F.md5("text").alias("k")).agg(F.count("*").alias("n"), F.countDistinct("source").alias("s"))
    return g.agg(F.sum("n").alias("rows"), F.count("*").alias("unique_texts"), F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("rows_in_groups"), F.count_if(F.col("s") > 1).alias("cross_label_texts"), F.sum(F.when(F.col("s") > 1, F.col("n"))).alias("cross_label_rows"))


@query("""WITH l AS (SELECT DISTINCT source, md5(text) AS t FROM documents)
SELECT a.source AS a, b.source AS b, count(*) AS overlap FROM l a JOIN l b ON a.t = b.t AND a.source < b.source GROUP BY ALL""")
def pairwise_overlap(read):
    """Texts shared by pairs of sources, each pair once: a text has one row for a source, whatever its copies."""
    l = read("documents").select("source", F.md5("text").alias("t")).distinct()
    return l.select(F.col("source").alias("a"), "t").join(l.select(F.col("source").alias("b"), "t"), "t").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("overlap"))


@query("SELECT n_types, count(*) AS users FROM (SELECT user_id, count(DISTINCT event_type) AS n_types FROM events GROUP BY user_id) GROUP BY n_types")
def alignment(read):
    """In how many groups each key is seen (n-way intersection and union in one pass)."""
    return read("events").groupBy("user_id").agg(F.countDistinct("event_type").alias("n_types")).groupBy("n_types").agg(F.count("*").alias("users"))


TOKENS_SQL = """t0 AS (SELECT lang AS label, CAST(substr(source, 4) AS INTEGER) % 3 <> 0 AS real, unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) AS token FROM documents),
tc AS (SELECT token, label, count(*) AS n, count(*) FILTER (real) AS n_real FROM t0 GROUP BY ALL)"""


def _tokens(read):
    real = F.substr("source", F.lit(4)).cast("int") % 3 != 0
    t = read("documents").select(F.col("lang").alias("label"), real.alias("real"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿ]+"), F.lit(0))).alias("token"))
    return t.groupBy("token", "label").agg(F.count("*").alias("n"), F.count_if("real").alias("n_real"))


@query(f"WITH {TOKENS_SQL} SELECT * FROM tc")
def token_counts(read):
    """Token counts by label, real and all."""
    return _tokens(read)


ASSOCIATION_SQL = f"""{TOKENS_SQL}, tt AS (SELECT token, sum(n) AS token_n FROM tc GROUP BY token), tl AS (SELECT label, sum(n) AS label_n FROM tc GROUP BY label),
ta AS (SELECT sum(n)::DOUBLE AS all_n, count(DISTINCT token) AS v FROM tc),
tj AS (SELECT tc.token, tc.label, n, n_real, token_n::BIGINT AS token_n, label_n::BIGINT AS label_n, n / token_n::DOUBLE AS purity, (n + 0.1::DOUBLE) / greatest(1, label_n + 0.1::DOUBLE * v) AS g, (token_n - n + 0.1::DOUBLE) / greatest(1, all_n - label_n + 0.1::DOUBLE * v) AS o, token_n / all_n AS p, 1 - n_real / n AS made
  FROM tc JOIN tt ON tc.token = tt.token JOIN tl ON tc.label = tl.label, ta),
ts AS (SELECT *, ln(g + 1e-12) - ln(o + 1e-12) AS log_odds, ln((g + 1e-12) / (p + 1e-12)) AS pmi, CASE WHEN n_real = 0 THEN 'synthetic_only' WHEN made >= 0.8 THEN 'synthetic_dominant' ELSE 'real_or_mixed' END AS support FROM tj),
tf AS (SELECT *, log_odds * ln(1 + n) * (0.5::DOUBLE + 0.5::DOUBLE * purity) * CASE support WHEN 'synthetic_only' THEN 0.5::DOUBLE WHEN 'synthetic_dominant' THEN 0.75::DOUBLE ELSE 1::DOUBLE END AS score FROM ts)"""


@query(f"WITH {ASSOCIATION_SQL} SELECT token, label, n, n_real, round(purity, 5) AS purity, round(log_odds, 5) AS log_odds, round(pmi, 5) AS pmi, support, round(score, 4) AS score FROM tf WHERE n >= 20")
def token_association(read):
    """Smoothed log odds, PMI, purity and support of frequent tokens by label."""
    a = A.token_association(_tokens(read)).filter("n >= 20")
    return a.select("token", "label", "n", "n_real", F.round("purity", 5).alias("purity"), F.round("log_odds", 5).alias("log_odds"), F.round("pmi", 5).alias("pmi"), "support", F.round("score", 4).alias("score"))


@query(f"WITH {ASSOCIATION_SQL}, k AS (SELECT label, token, row_number() OVER (PARTITION BY label ORDER BY round(score, 6) DESC, n DESC, token) AS rank FROM tf WHERE n >= 10 AND n_real >= 5 AND purity >= 0.6 AND log_odds >= 1) SELECT * FROM k WHERE rank <= 50")
def label_tokens(read):
    """The 50 tokens most tied to each label."""
    a = A.token_association(_tokens(read)).filter("n >= 10 and n_real >= 5 and purity >= 0.6 and log_odds >= 1")
    w = Window.partitionBy("label").orderBy(F.desc(r6("score")), F.desc("n"), "token")
    return a.withColumn("rank", F.row_number().over(w)).filter("rank <= 50").select("label", "token", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {TOKENS_SQL}, c AS (SELECT token, sum(n)::BIGINT AS total, sum(n_real)::BIGINT AS n_real, count(*) FILTER (n >= 5) AS coverage, max(n) / sum(n) AS top_purity,
  CASE WHEN sum(n) > 0 THEN (-sum(n / t * ln(n / t + 1e-12))) / ln(4) END AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY token)::DOUBLE AS t FROM tc) GROUP BY token)
SELECT token, total, coverage, round(entropy, 5) AS entropy FROM c WHERE total >= 50 AND n_real >= 20 AND coverage >= 2 AND top_purity <= 0.9 AND length(token) BETWEEN 2 AND 32""")
def core_tokens(read):
    """Tokens shared by labels: frequent, covered, not owned by one label."""
    counts = _tokens(read)
    c = counts.groupBy("token").agg(F.sum("n").alias("total"), F.sum("n_real").alias("n_real"), F.count_if(F.col("n") >= 5).alias("coverage"), (F.max("n") / F.sum("n")).alias("top"), F.collect_list("n").alias("ns"))
    ns = F.concat("ns", F.array_repeat(F.lit(0).cast("long"), F.lit(4) - F.size("ns")))
    return c.filter("total >= 50 and n_real >= 20 and coverage >= 2 and top <= 0.9 and length(token) between 2 and 32").select("token", "total", "coverage", F.round(A.normalized_entropy(F.transform(ns, lambda x: x.cast("double"))), 5).alias("entropy"))


@query(f"""WITH {TOKENS_SQL}, w AS (SELECT token, least(sum(n), 100)::BIGINT AS w FROM tc WHERE length(token) >= 3 GROUP BY token), p AS (SELECT substr(token, 1, k) AS piece, w FROM w, (SELECT unnest([2, 3, 4]) AS k) WHERE length(token) > k),
q AS (SELECT '##' || substr(token, k + 1) AS piece, w FROM w, (SELECT unnest([2, 3, 4]) AS k) WHERE length(token) > k)
SELECT piece, sum(w)::BIGINT AS weight FROM (SELECT * FROM p UNION ALL SELECT * FROM q) GROUP BY piece HAVING sum(w) >= 200""")
def subword_pieces(read):
    """Prefixes and continuations of tokens, each token weighing at most 100."""
    w = _tokens(read).filter("length(token) >= 3").groupBy("token").agg(F.least(F.sum("n"), F.lit(100)).alias("w"))
    cuts = F.filter(F.array(F.lit(2), F.lit(3), F.lit(4)), lambda k: F.length("token") > k)
    pieces = F.flatten(F.transform(cuts, lambda k: F.array(F.substr(F.col("token"), F.lit(1), k), F.concat(F.lit("##"), F.substr(F.col("token"), k + 1)))))
    return w.select(F.explode(pieces).alias("piece"), "w").groupBy("piece").agg(F.sum("w").alias("weight")).filter("weight >= 200")


@query(f"""WITH {TOKENS_SQL}, s AS (SELECT token, sum(n) AS n, CASE WHEN count(*) >= 3 THEN 1 WHEN sum(n) >= 100 THEN 2 ELSE 3 END AS tier FROM tc GROUP BY token HAVING sum(n) >= 10)
SELECT token, tier, row_number() OVER (ORDER BY tier, n DESC, token) - 1 AS id FROM s ORDER BY tier, n DESC, token LIMIT 2000""")
def vocabulary(read):
    """A vocabulary of 2,000 entries in tiers: shared tokens, frequent ones, the rest (the size is the feature)."""
    s = _tokens(read).groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("labels")).filter("n >= 10")
    s = s.select("token", "n", F.when(F.col("labels") >= 3, 1).when(F.col("n") >= 100, 2).otherwise(3).alias("tier")).orderBy("tier", F.desc("n"), "token").limit(2000)
    return s.withColumn("id", (F.row_number().over(Window.orderBy("tier", F.desc("n"), "token")) - 1).cast("long")).drop("n")


@query(f"""WITH {TOKENS_SQL}, p AS (SELECT token FROM tc GROUP BY token HAVING sum(n) >= 200)
SELECT label, sum(n)::BIGINT AS tokens, coalesce(sum(n) FILTER (token IN (SELECT token FROM p)), 0)::BIGINT AS covered, count(DISTINCT token) AS types, count(DISTINCT token) FILTER (token IN (SELECT token FROM p)) AS types_covered FROM tc GROUP BY label""")
def protected_coverage(read):
    """How much of each label's tokens and types the protected list covers."""
    t = _tokens(read)
    p = t.groupBy("token").agg(F.sum("n").alias("s")).filter("s >= 200").select("token", F.lit(True).alias("p"))
    j = t.join(p, "token", "left")
    return j.groupBy("label").agg(F.sum("n").alias("tokens"), F.coalesce(F.sum(F.when(F.col("p"), F.col("n"))), F.lit(0)).alias("covered"), F.count("token").alias("types"), F.count_if("p").alias("types_covered"))


@query("SELECT c AS character, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) GROUP BY c")
def character_inventory(read):
    return read("documents").select(F.explode(F.split("text", "")).alias("character")).filter("character <> ''").groupBy("character").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT lang, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS w, length(text) AS c, strlen(text) AS b FROM documents)
SELECT lang, count(*) AS n, round(sum(w) / greatest(1, sum(c)), 6) AS words_per_character, round(sum(w) / greatest(1, sum(b)), 6) AS words_per_byte, round(avg(c / greatest(1, w)), 6) AS mean_fertility, round(quantile_cont(w, 0.95), 6) AS p95_words FROM b GROUP BY lang""")
def segmentation_cost(read):
    """Ratios of sums and mean fertility of a segmentation (here white space) by label."""
    d = read("documents").select("lang", F.size(T.words(F.col("text"))).alias("w"), F.length("text").alias("c"), F.octet_length("text").alias("b"))
    return d.groupBy("lang").agg(F.count("*").alias("n"), r6(F.sum("w") / F.greatest(F.lit(1), F.sum("c"))).alias("words_per_character"), r6(F.sum("w") / F.greatest(F.lit(1), F.sum("b"))).alias("words_per_byte"), r6(F.avg(F.col("c") / F.greatest(F.lit(1), "w"))).alias("mean_fertility"), r6(F.percentile("w", F.lit(0.95))).alias("p95_words"))


@query("""WITH v AS (SELECT p_brand, greatest(p_retailprice, 0) AS v FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY v) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM v)
SELECT p_brand, round((2 * sum(r * v) / sum(v) - (max(n) + 1)) / max(n), 6) AS gini, max(n) AS n FROM r GROUP BY p_brand""")
def gini_by_brand(read):
    return A.gini(read("part"), "p_retailprice", ["p_brand"]).select("p_brand", r6("gini").alias("gini"), "n")


@query("SELECT quality AS label, toxic AS prediction, count(*) AS n FROM labels GROUP BY ALL")
def confusion_counts(read):
    return read("labels").groupBy(F.col("quality").alias("label"), F.col("toxic").alias("prediction")).agg(F.count("*").alias("n"))


@query("SELECT label, i - 1 AS position, round(sum(embedding[i]), 4) AS total FROM embeddings, (SELECT unnest(range(1, 65)) AS i) WHERE embedding IS NOT NULL GROUP BY ALL")
def contingency(read):
    """Vector sums by label, one row for each position."""
    e = read("embeddings").select("label", F.posexplode("embedding").alias("position", "v"))
    return e.groupBy("label", F.col("position").cast("long").alias("position")).agg(F.round(F.sum(F.col("v").cast("double")), 4).alias("total"))


@query("""SELECT event_type, round(sum(value) / greatest(1, count(*)), 6) AS nll, round(exp(least(20.0, sum(value) / count(*))), 2) AS perplexity FROM events GROUP BY event_type""")
def loss_ratios(read):
    """Ratios of sums of all losses and their exponential, bounded."""
    e = read("events").groupBy("event_type").agg((F.sum("value") / F.greatest(F.lit(1), F.count("*"))).alias("m"))
    return e.select("event_type", r6("m").alias("nll"), F.round(F.exp(F.least(F.lit(20.0), "m")), 2).alias("perplexity"))


@query("SELECT label, round(avg(CASE WHEN distinct_sources > 1 THEN 1 ELSE 0 END), 6) AS coverage FROM (SELECT user_id % 7 AS label, count(DISTINCT event_type) AS distinct_sources FROM events GROUP BY user_id) GROUP BY label")
def batch_coverage(read):
    g = read("events").groupBy("user_id").agg((F.countDistinct("event_type") > 1).cast("int").alias("c"))
    return g.groupBy((F.col("user_id") % 7).alias("label")).agg(r6(F.avg("c")).alias("coverage"))


@query("SELECT lang, source, n, round(n / sum(n) OVER (PARTITION BY lang), 6) AS share FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL)")
def share_of_total(read):
    n = read("documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return A.share(n, "n", ["lang"]).select("lang", "source", "n", r6("share").alias("share"))


@query("""WITH c AS (SELECT doc_id, (doc_id * 7919 % 1000) / 999.0::DOUBLE AS conf, quality = 1 AS ok FROM labels)
SELECT CAST(least(floor(conf * 10), 9) AS BIGINT) AS bin, count(*) AS n, round(avg(conf), 6) AS confidence, round(avg(ok::INT), 6) AS accuracy FROM c GROUP BY 1""")
def reliability_bins(read):
    l = read("labels").select((F.col("doc_id") * 7919 % 1000 / F.lit(999.0)).alias("conf"), (F.col("quality") == 1).cast("int").alias("ok"))
    return l.groupBy(F.least(F.floor(F.col("conf") * 10), F.lit(9)).cast("long").alias("bin")).agg(F.count("*").alias("n"), r6(F.avg("conf")).alias("confidence"), r6(F.avg("ok")).alias("accuracy"))


@query("""WITH f AS (SELECT unnest(['discount', 'tax', 'quantity']) AS factor), l AS (SELECT l_extendedprice AS y, l_discount > 0.05 AS discount, l_tax > 0.04 AS tax, l_quantity > 25 AS quantity FROM lineitem)
SELECT factor, round(avg(y) FILTER (CASE factor WHEN 'discount' THEN discount WHEN 'tax' THEN tax ELSE quantity END) - avg(y) FILTER (NOT CASE factor WHEN 'discount' THEN discount WHEN 'tax' THEN tax ELSE quantity END), 4) AS effect FROM f, l GROUP BY factor""")
def main_effects(read):
    """Main effects of a two-level design: one pass, then rows by factor."""
    l = read("lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_discount") > 0.05).alias("discount"), (F.col("l_tax") > 0.04).alias("tax"), (F.col("l_quantity") > 25).alias("quantity"))
    e = l.agg(*[(F.avg(F.when(F.col(c), F.col("y"))) - F.avg(F.when(~F.col(c), F.col("y")))).alias(c) for c in ("discount", "tax", "quantity")])
    return e.unpivot([], ["discount", "tax", "quantity"], "factor", "effect").select("factor", F.round("effect", 4).alias("effect"))


@query("""WITH m AS (SELECT o_orderstatus AS s, o_orderpriority AS p, avg(o_totalprice) AS v FROM orders GROUP BY ALL)
SELECT m.s, m.p, round(m.v - b.v, 3) AS delta FROM m JOIN m b ON m.s = b.s AND b.p = '5-LOW' WHERE m.p <> '5-LOW'""")
def delta_from_base(read):
    m = read("orders").groupBy(F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p")).agg(F.avg("o_totalprice").alias("v"))
    b = m.filter("p = '5-LOW'").select("s", F.col("v").alias("b"))
    return m.filter("p <> '5-LOW'").join(b, "s").select("s", "p", F.round(F.col("v") - F.col("b"), 3).alias("delta"))


@query("""WITH p AS (SELECT s_nationkey AS g, s_suppkey::DOUBLE AS x, s_acctbal AS y FROM supplier), s AS (SELECT *, (x - lag(x) OVER w) * (y + lag(y) OVER w) / 2 AS a FROM p WINDOW w AS (PARTITION BY g ORDER BY x))
SELECT g, round(coalesce(sum(a), 0), 3) AS area, arg_max(y, x) AS last, min(y) AS least FROM s GROUP BY g""")
def curve_area(read):
    p = read("supplier").select(F.col("s_nationkey").alias("g"), F.col("s_suppkey").cast("double").alias("x"), F.col("s_acctbal").alias("y"))
    return A.trapezoid(p, ["g"], "x", "y").select("g", F.round("area", 3).alias("area"), "last", "least")


@query("""WITH e AS (SELECT user_id, event_id, value > 10 AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
h AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM e WHERE c), r AS (SELECT user_id, g, count(*) AS n FROM h GROUP BY ALL)
SELECT u.user_id, coalesce(max(n), 0) AS run FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN r ON u.user_id = r.user_id GROUP BY u.user_id""")
def longest_run(read):
    return A.longest_true_run(read("events"), ["user_id"], ["ts", "event_id"], F.col("value") > 10)


@query("""WITH e AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, round(avg(value), 6) AS mean, max(value) AS top, arg_max(value, event_id) AS last, round(avg((value > 10)::INT), 6) AS exceeded, count(*) FILTER (value < before) AS regressions FROM e GROUP BY user_id""")
def series_diagnostics(read):
    """Mean, greatest, last, share beyond a bound and steps down of each series."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read("events").withColumn("before", F.lag("value").over(w))
    return e.groupBy("user_id").agg(r6(F.avg("value")).alias("mean"), F.max("value").alias("top"), F.max_by("value", "event_id").alias("last"), r6(F.avg((F.col("value") > 10).cast("int"))).alias("exceeded"), F.count_if(F.col("value") < F.col("before")).alias("regressions"))


@query("""SELECT user_id, round(100 * (arg_max(value, event_id) / arg_min(value, event_id) - 1), 4) AS percent, CASE WHEN max(value) > 3 * arg_min(value, event_id) THEN 'spike' WHEN arg_max(value, event_id) > arg_min(value, event_id) THEN 'worse' END AS guard FROM events WHERE value > 0 GROUP BY user_id""")
def percent_change(read):
    """Change of the last over the first point, with guards."""
    g = read("events").filter("value > 0").groupBy("user_id").agg(F.max_by("value", "event_id").alias("l"), F.min_by("value", "event_id").alias("f"), F.max("value").alias("m"))
    return g.select("user_id", F.round(100 * (F.col("l") / F.col("f") - 1), 4).alias("percent"), F.when(F.col("m") > 3 * F.col("f"), "spike").when(F.col("l") > F.col("f"), "worse").alias("guard"))


@query("SELECT o_custkey, count(*) AS runs, count(*) FILTER (o_orderstatus = 'F') AS finished, bool_and(o_orderstatus = 'F') AS complete FROM orders GROUP BY o_custkey")
def run_completion(read):
    done = F.col("o_orderstatus") == "F"
    return read("orders").groupBy("o_custkey").agg(F.count("*").alias("runs"), F.count_if(done).alias("finished"), F.bool_and(done).alias("complete"))


@query("SELECT quality, toxic, count(*) AS n FROM labels WHERE quality <> toxic GROUP BY ALL ORDER BY n DESC")
def error_pairs(read):
    return read("labels").filter("quality <> toxic").groupBy("quality", "toxic").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query("""SELECT regexp_extract(url, '\\.([a-z]+)$', 1) AS extension, count(*) AS files, sum(strlen(html))::BIGINT AS bytes, count(*) FILTER (strlen(html) > 5000) AS large FROM pages GROUP BY 1""")
def file_inventory(read):
    """Counts and bytes by file ending."""
    return read("pages").groupBy(F.regexp_extract("url", r"\.([a-z]+)$", 1).alias("extension")).agg(F.count("*").alias("files"), F.sum(F.octet_length("html").cast("long")).alias("bytes"), F.count_if(F.octet_length("html") > 5000).alias("large"))


@query("""WITH c AS (SELECT 'customer' AS entity, 'has_segment' AS name, count(*) FILTER (c_mktsegment IS NOT NULL) AS passed, count(*) AS n FROM customer UNION ALL SELECT 'customer', 'positive_balance', count(*) FILTER (c_acctbal > 0), count(*) FROM customer)
SELECT entity, name AS "check", passed, n, passed = n AS ok FROM c""")
def bundle_checks(read):
    """Checks in long form with pass counts."""
    c = read("customer").agg(F.count_if(F.col("c_mktsegment").isNotNull()).alias("has_segment"), F.count_if(F.col("c_acctbal") > 0).alias("positive_balance"), F.count("*").alias("n"))
    return c.unpivot(["n"], ["has_segment", "positive_balance"], "check", "passed").select(F.lit("customer").alias("entity"), "check", "passed", "n", (F.col("passed") == F.col("n")).alias("ok"))


@query("SELECT event_id, '$.' || key AS path, CAST(json_extract(props, '$.' || key) AS VARCHAR) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def json_flatten(read):
    """Path and value rows of JSON objects."""
    return read("events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("k", "value")).select("event_id", F.concat(F.lit("$."), "k").alias("path"), "value")


@query("SELECT * FROM (SELECT p_brand, p_name, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 12")
def top_in_group(read):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return read("part").withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 12").select("p_brand", "p_name", "p_partkey", "rank")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS rolling FROM events")
def rolling_mean(read):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return read("events").select("event_id", r6(F.avg("value").over(w)).alias("rolling"))


@query("SELECT l_orderkey, l_linenumber, round(l_linenumber / max(l_linenumber) OVER (PARTITION BY l_orderkey), 6) AS progress FROM lineitem QUALIFY l_extendedprice = max(l_extendedprice) OVER (PARTITION BY l_orderkey)")
def group_maximum(read):
    """Rows at the greatest price of their group, with relative progress."""
    w = Window.partitionBy("l_orderkey")
    l = read("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").withColumn("m", F.max("l_extendedprice").over(w)).withColumn("p", F.max("l_linenumber").over(w))
    return l.filter("l_extendedprice = m").select("l_orderkey", "l_linenumber", r6(F.col("l_linenumber") / F.col("p")).alias("progress"))


@query("SELECT doc_id FROM documents ORDER BY sha256('72119' || chr(31) || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100")
def bottom_hash_sample(read):
    """The 100 rows of least hash (the number is the feature); a bounded heap in each task."""
    from siltstone.functions import keys as K

    return read("documents").select("doc_id").orderBy(K.stable_hash(72119, F.col("doc_id")), "doc_id").limit(100)


@query("""WITH r AS (SELECT doc_id, lang, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) SELECT doc_id FROM r WHERE before < 20000""")
def running_budget(read):
    """Rows admitted while the total before them is below the budget of their label."""
    return S.running_total(read("documents").select("doc_id", "lang", "n_chars"), ["lang"], "doc_id", "n_chars").filter("before < 20000").select("doc_id")


@query("""WITH c AS (SELECT s_nationkey AS run, round(avg(s_acctbal), 2) AS metric, count(*) AS n FROM supplier GROUP BY 1) SELECT run, metric FROM c WHERE metric >= 0.9 * (SELECT max(metric) FROM c) ORDER BY n DESC, metric DESC, run LIMIT 1""")
def select_candidate(read):
    """The largest run among those within a tenth of the best metric."""
    c = read("supplier").groupBy(F.col("s_nationkey").alias("run")).agg(F.round(F.avg("s_acctbal"), 2).alias("metric"), F.count("*").alias("n"))
    best = c.agg((0.9 * F.max("metric")).alias("least"))
    return c.join(F.broadcast(best), F.col("metric") >= F.col("least")).orderBy(F.desc("n"), F.desc("metric"), "run").limit(1).select("run", "metric")


@query("SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_operations(read):
    o, c = read("orders"), read("customer")
    return o.select("o_custkey").union(c.select("c_custkey")).distinct().exceptAll(o.filter("o_orderstatus = 'F'").select("o_custkey").distinct()).select("o_custkey")


@query("SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '2-HIGH') AS high, count(*) FILTER (o_orderpriority = '5-LOW') AS low FROM orders GROUP BY o_orderstatus")
def pivot_counts(read):
    p = read("orders").groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"]).count().na.fill(0)
    return p.toDF("o_orderstatus", "urgent", "high", "low")


@query("SELECT s_suppkey, 'balance' AS metric, s_acctbal AS value FROM supplier UNION ALL SELECT s_suppkey, 'nation', s_nationkey FROM supplier")
def unpivot_metrics(read):
    s = read("supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    return s.unpivot(["s_suppkey"], ["balance", "nation"], "metric", "value")


@query("SELECT o_orderkey || ':source' AS row_id, o_orderstatus AS label FROM orders UNION ALL SELECT o_orderkey || ':target', o_orderpriority FROM orders")
def stacked_rows(read):
    """Source and target rows in one column, told apart by an id suffix."""
    o = read("orders")
    part = lambda suffix, c: o.select(F.concat(F.col("o_orderkey").cast("string"), F.lit(suffix)).alias("row_id"), F.col(c).alias("label"))
    return part(":source", "o_orderstatus").unionByName(part(":target", "o_orderpriority"))


@query("""SELECT n.n_name, r.r_name, count(*) AS orders, round(sum(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY ALL""")
def many_to_one(read):
    """Facts with three dimensions, each many to one."""
    o = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return o.groupBy("n_name", "r_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def left_outer(read):
    n = read("orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return read("customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"))


@query("SELECT s_suppkey, EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R') AS returned FROM supplier")
def semi_anti(read):
    s, bad = read("supplier").select("s_suppkey"), read("lineitem").filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("s_suppkey"))
    return s.join(bad, "s_suppkey", "left_semi").withColumn("returned", F.lit(True)).unionByName(s.join(bad, "s_suppkey", "left_anti").withColumn("returned", F.lit(False)))


@query("SELECT md5(text) AS k, count(*) AS matches, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM documents WHERE doc_id % 2 = 1 AND text IN (SELECT text FROM documents WHERE doc_id % 2 = 0) GROUP BY text")
def many_valued_lookup(read):
    """Rows that match a reference text exactly, listed for each text."""
    d = read("documents").select("doc_id", F.md5("text").alias("k"))
    hits = d.filter("doc_id % 2 = 1").join(d.filter("doc_id % 2 = 0").select("k"), "k", "left_semi")
    return hits.groupBy("k").agg(F.count("*").alias("matches"), F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("ids"))


@query("""WITH t AS (SELECT l_partkey, l_suppkey, l_returnflag, min(l_orderkey) AS first_order FROM lineitem GROUP BY ALL), m AS (SELECT l.l_orderkey, l.l_linenumber, t.first_order, row_number() OVER (PARTITION BY t.first_order ORDER BY l.l_orderkey, l.l_linenumber) AS r FROM lineitem l JOIN t USING (l_partkey, l_suppkey, l_returnflag))
SELECT l_orderkey, l_linenumber, first_order FROM m WHERE r = 1""")
def first_claim(read):
    """A triple-key lookup after which the first row to claim a parent keeps it."""
    l = read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    keys = ["l_partkey", "l_suppkey", "l_returnflag"]
    m = l.join(l.groupBy(*keys).agg(F.min("l_orderkey").alias("first_order")), keys)
    first = m.groupBy("first_order").agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("x"))
    return first.select("x.l_orderkey", "x.l_linenumber", "first_order")


@query("""WITH a AS (SELECT doc_id, quality FROM labels), b AS (SELECT doc_id, toxic FROM labels) SELECT count(*) AS n, count(DISTINCT a.doc_id) = count(*) AS one_to_one, (SELECT count(*) FROM (SELECT doc_id FROM a EXCEPT SELECT doc_id FROM b)) = 0 AS same_rows, count(*) FILTER (quality = toxic) AS agree FROM a JOIN b USING (doc_id)""")
def aligned_pair(read):
    """Two result tables joined one to one, with the contract that both hold the same rows."""
    a, b = read("labels").select("doc_id", "quality"), read("labels").select("doc_id", "toxic")
    j = a.join(b, "doc_id").agg(F.count("*").alias("n"), (F.countDistinct("doc_id") == F.count("*")).alias("one_to_one"), F.count_if(F.col("quality") == F.col("toxic")).alias("agree"))
    return j.crossJoin(F.broadcast(a.select("doc_id").exceptAll(b.select("doc_id")).agg((F.count("*") == 0).alias("same_rows"))))


@query("SELECT a AS router, b AS loss, c AS seed FROM (SELECT unnest(['x', 'y']) AS a), (SELECT unnest([0.1::DOUBLE, 0.2::DOUBLE]) AS b), (SELECT unnest(range(3)) AS c)")
def factor_grid(read):
    """All cells of a small design."""
    spark = read("region").sparkSession
    return spark.range(1).select(F.explode(F.array(F.lit("x"), F.lit("y"))).alias("router")).select("router", F.explode(F.array(F.lit(0.1), F.lit(0.2))).alias("loss")).select("router", "loss", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("seed"))
