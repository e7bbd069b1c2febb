"""Queries of canonical rows, encoded examples, mixtures, predictions and reviews."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import inference as I
from siltstone.operators import metrics as M
from siltstone.operators import records as R

from .base import Registry
from .texts import PAIRS_SQL, pairs

REGISTRY = Registry()
query = REGISTRY.query


def r6(c):
    return F.round(c, 6)


@query(rf"""WITH {PAIRS_SQL}, m AS (SELECT conv_id, turn, trim(regexp_replace(source, '\s+', ' ', 'g')) AS s, trim(regexp_replace(target, '\s+', ' ', 'g')) AS t FROM pairs)
SELECT sha256(concat_ws(chr(31), 'conversations', conv_id || '-' || turn, 'chat')) AS row_id, md5(s) AS source, md5(t) AS target, sha256(concat_ws(chr(31), 'group', t)) AS semantic_group_id, s <> '' AND t <> '' AS normalization_eligible FROM m""")
def canonical_pairs(read):
    """Canonical rows of question and answer pairs."""
    p = pairs(read)
    rows = R.pair_rows(p, "conversations", F.lit("chat"), "source", "target", F.concat_ws("-", "conv_id", "turn"), 72119, T.LATIN)
    return rows.select("row_id", F.md5("source_text_model").alias("source"), F.md5("target_text_model").alias("target"), "semantic_group_id", "normalization_eligible")


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding[1:3], lambda x: CAST(floor(x * 100) AS INTEGER)) AS p, list_transform(embedding[4:3 + label % 3 + 1], lambda x: CAST(floor(x * 100) AS INTEGER)) AS t FROM embeddings WHERE embedding IS NOT NULL)
SELECT vec_id, CAST(len(p) + len(t) + 1 AS BIGINT) AS n, list_sum(p)::BIGINT + coalesce(list_sum(t), 0)::BIGINT + 2 AS id_sum, CAST(len(p) AS BIGINT) AS n_prefix, CAST(-100 * len(p) + coalesce(list_sum(t), 0) + 2 AS BIGINT) AS label_sum FROM e""")
def encoded_examples(read):
    """Prompt and target ids in one sequence, prompt labels ignored, and the prefix alone."""
    ids = lambda a, n: F.transform(F.slice("embedding", a, n), lambda x: F.floor(x.cast("float") * 100).cast("int"))
    e = read("embeddings").filter("embedding is not null").withColumn("p", ids(1, 3)).withColumn("t", ids(4, F.col("label") % 3 + 1))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    x = R.encoded(e, F.col("p"), F.col("t"), 2).select("vec_id", "input_ids", "labels")
    x = x.select("vec_id", "input_ids", "labels", F.size("input_ids").cast("long").alias("n"), total("input_ids").alias("id_sum"), total("labels").alias("label_sum"))
    return R.prefix_only(x).select("vec_id", "n", "id_sum", F.size("input_ids").cast("long").alias("n_prefix"), "label_sum")


@query("SELECT o_orderkey, CAST(max(n) OVER (PARTITION BY o_orderkey % 16) AS BIGINT) AS width, n AS filled FROM (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem GROUP BY 1)")
def collated_batches(read):
    """Sequences padded to the longest of their batch, with masks."""
    s = read("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_linenumber").alias("input_ids")).withColumn("labels", F.col("input_ids")).withColumn("b", F.col("o_orderkey") % 16)
    c = R.collated(s, "b")
    return c.select("o_orderkey", F.size("input_ids").cast("long").alias("width"), F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("filled"))


@query()
def masked_sequences(read):
    """Masking by hash: shares of masked, replaced and kept ids. XXH64 draws are beyond SQL."""
    s = read("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_partkey").cast("int"))).alias("ids"))
    m = s.select(F.explode(F.arrays_zip("ids", R.masked(F.col("ids"), F.col("l_orderkey"), 5, -1, 1000).alias("m"))).alias("x"))
    return m.agg(F.count("*").alias("n"), F.avg((F.col("x.m") == -1).cast("double")).alias("masked"), F.avg((F.col("x.m") == F.col("x.ids")).cast("double")).alias("kept"))


@query("""WITH q AS (SELECT lang, CASE lang WHEN 'en' THEN 100 ELSE 300 END AS quota, count(*) AS size FROM documents GROUP BY lang), r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('9' || chr(31) || doc_id)) - 1 AS i FROM documents)
SELECT doc_id, (quota - 1 - i) // size + 1 AS uses FROM r JOIN q USING (lang) WHERE i < quota""")
def mixture_schedule(read):
    """How often each row is used by a mixture of fixed quotas, small components repeating."""
    d = read("documents").select("lang", "doc_id")
    quotas = d.select("lang").distinct().withColumn("quota", F.when(F.col("lang") == "en", 100).otherwise(300).cast("long"))
    return R.mixture(d, quotas, "lang", "doc_id", 9).groupBy("doc_id").agg(F.count("*").alias("uses"))


@query("""SELECT lang, source, count(*) AS n, round(CASE WHEN CAST(substr(source, 4) AS INTEGER) % 3 = 0 THEN 0.5 ELSE 1.0 END * power(count(*), -0.5), 6) AS weight FROM documents GROUP BY lang, source""")
def block_weights(read):
    """Loss weights by origin and sampler weights n^0.5 / n."""
    base = F.when(F.substr("source", F.lit(4)).cast("int") % 3 == 0, 0.5).otherwise(1.0)
    n = read("documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return n.select("lang", "source", "n", r6(base * F.pow("n", F.lit(-0.5))).alias("weight"))


@query("""SELECT vec_id, label, CAST(list_position(embedding[1:4], list_max(embedding[1:4])) - 1 AS BIGINT) AS prediction, round(list_max(embedding[1:4]), 5) AS confidence, list_position(embedding[1:4], list_max(embedding[1:4])) - 1 = label AS correct, round(embedding[1], 5) AS prob_a, round(embedding[4], 5) AS prob_d FROM embeddings WHERE embedding IS NOT NULL""")
def prediction_table(read):
    """A wide prediction table."""
    e = read("embeddings").filter("embedding is not null").select("vec_id", "label", F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")).alias("p"))
    t = R.prediction_table(e, "p", "label", list("abcd"))
    return t.select("vec_id", "label", "prediction", F.round("confidence", 5).alias("confidence"), "correct", F.round("prob_a", 5).alias("prob_a"), F.round("prob_d", 5).alias("prob_d"))


@query("SELECT vec_id FROM (SELECT vec_id, label, list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS p, list_max(embedding[1:10]) AS c FROM embeddings WHERE embedding IS NOT NULL) WHERE p <> label ORDER BY c DESC, vec_id LIMIT 500")
def confident_errors(read):
    """The 500 most confident errors (the number is the feature)."""
    e = read("embeddings").filter("embedding is not null").select("vec_id", "label", F.slice("embedding", 1, 10).alias("p"))
    return e.filter(M.argmax(F.col("p")) != F.col("label")).orderBy(F.desc(F.array_max("p")), "vec_id").limit(500).select("vec_id")


@query(rf"""WITH {PAIRS_SQL} SELECT conv_id, turn, CASE WHEN length(target) - length(source) > 100 THEN 'target' ELSE 'source' END AS choice FROM pairs""")
def margin_selector(read):
    p = R.select_by_margin(pairs(read), F.length("target") - F.length("source"), 100, "target", "source")
    return p.select("conv_id", "turn", "choice")


@query("""WITH r AS (SELECT doc_id, unnest([0, 1, 2]) AS rater, quality, toxic FROM labels), s AS (SELECT doc_id, rater, CASE rater WHEN 0 THEN quality WHEN 1 THEN toxic ELSE (quality + toxic) % 2 END AS v FROM r),
p AS (SELECT a.rater AS ra, b.rater AS rb, a.v AS a, b.v AS b FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.rater < b.rater), n AS (SELECT ra, rb, a, b, count(*) AS n FROM p GROUP BY ALL),
o AS (SELECT ra, rb, sum((a <> b)::INT * n) AS o, sum(n) AS t FROM n GROUP BY ALL), na AS (SELECT ra, rb, a, sum(n) AS x FROM n GROUP BY ALL), nb AS (SELECT ra, rb, b, sum(n) AS y FROM n GROUP BY ALL), e AS (SELECT na.ra, na.rb, sum((a <> b)::INT * x * y) AS e FROM na JOIN nb ON na.ra = nb.ra AND na.rb = nb.rb GROUP BY ALL)
SELECT round(avg(1 - o * t / e), 6) AS mean_kappa FROM o JOIN e ON o.ra = e.ra AND o.rb = e.rb""")
def mean_pairwise_kappa(read):
    """Kappa of every pair of raters, averaged."""
    v = F.when(F.col("rater") == 0, F.col("quality")).when(F.col("rater") == 1, F.col("toxic")).otherwise((F.col("quality") + F.col("toxic")) % 2)
    s = read("labels").withColumn("rater", F.explode(F.sequence(F.lit(0), F.lit(2)))).select("doc_id", "rater", v.alias("v"))
    p = s.select("doc_id", F.col("rater").alias("ra"), F.col("v").alias("a")).join(s.select("doc_id", F.col("rater").alias("rb"), F.col("v").alias("b")), "doc_id").filter("ra < rb")
    return I.kappa(p, "a", "b", by=["ra", "rb"]).agg(r6(F.avg("kappa")).alias("mean_kappa"))


@query("""SELECT count(*) AS n, count(*) FILTER (quality NOT IN (0, 1) OR toxic NOT IN (0, 1)) AS out_of_range, round(avg(quality), 6) AS mean_quality, round(avg(toxic), 6) AS mean_toxic, avg(quality) >= 0.8 AND avg(toxic) <= 0.2 AS passed FROM labels""")
def review_gate(read):
    """Completeness, range and threshold checks of a review sheet."""
    l = read("labels")
    return l.agg(F.count("*").alias("n"), F.count_if(~F.col("quality").isin(0, 1) | ~F.col("toxic").isin(0, 1)).alias("out_of_range"), r6(F.avg("quality")).alias("mean_quality"), r6(F.avg("toxic")).alias("mean_toxic"), ((F.avg("quality") >= 0.8) & (F.avg("toxic") <= 0.2)).alias("passed"))


@query("""WITH g AS (SELECT lang, unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM (SELECT lang, string_split_regex(lower(text), '\\s+') AS w FROM documents)),
c AS (SELECT lang, g, count(*) AS n FROM g WHERE length(g) BETWEEN 5 AND 40 AND NOT regexp_matches(g, '^[\\p{P}\\p{S}\\s]+$') AND regexp_matches(g, '[a-z]') GROUP BY ALL) SELECT * FROM (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, g) AS rank FROM c) WHERE rank <= 30""")
def top_ngrams(read):
    """The 30 most frequent word pairs of each label that pass the keep rules."""
    w = read("documents").select("lang", F.split(F.lower("text"), r"\s+").alias("w"))
    g = w.select("lang", F.explode(F.transform(T.ngrams(F.col("w"), 2), lambda x: F.replace(x, F.lit("\u001f"), F.lit(" ")))).alias("g"))
    c = g.filter(F.length("g").between(5, 40) & ~F.col("g").rlike(r"^[\p{P}\p{S}\s]+$") & F.col("g").rlike("[a-z]")).groupBy("lang", "g").agg(F.count("*").alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "g")).cast("long")).filter("rank <= 30").select("lang", "g", "rank")


@query("""WITH s AS (SELECT unnest(['|', '%', '#', '!']) AS symbol) SELECT symbol, count(*) FILTER (contains(text, symbol)) AS present, round(avg(contains(text, symbol)::INT), 6) AS rate FROM s, documents GROUP BY symbol""")
def symbol_presence(read):
    """Share of rows that hold each symbol: one pass, then rows by symbol."""
    symbols = ["|", "%", "#", "!"]
    d = read("documents").agg(F.count("*").alias("n"), *[F.count_if(F.contains("text", F.lit(s))).alias(f"s{i}") for i, s in enumerate(symbols)])
    names = F.create_map(*[F.lit(x) for i, s in enumerate(symbols) for x in (f"s{i}", s)])
    return d.unpivot(["n"], [f"s{i}" for i in range(4)], "k", "present").select(F.element_at(names, F.col("k")).alias("symbol"), "present", r6(F.col("present") / F.col("n")).alias("rate"))


@query("""SELECT CASE WHEN source IN ('src0', 'src1') THEN 'primary' WHEN CAST(substr(source, 4) AS INTEGER) % 3 = 0 THEN 'synthetic' ELSE 'external' END AS role, regexp_extract(source, '([0-9]+)$', 1) AS stem, count(*) AS n FROM documents GROUP BY ALL""")
def provenance_roles(read):
    """Roles by case and provenance from the stem of a name."""
    role = F.when(F.col("source").isin("src0", "src1"), "primary").when(F.substr("source", F.lit(4)).cast("int") % 3 == 0, "synthetic").otherwise("external")
    return read("documents").groupBy(role.alias("role"), F.regexp_extract("source", "([0-9]+)$", 1).alias("stem")).agg(F.count("*").alias("n"))


@query()
def permutation_null(read):
    """Normalized mutual information of status and priority against permuted statuses, and within customers' nations."""
    o = read("orders").join(read("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    return I.label_permutation(o, "o_orderstatus", "o_orderpriority", "c_nationkey", 200)
