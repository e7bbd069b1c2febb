"""Queries of quality gates, deduplication, leakage control and components."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import keys as K
from siltstone.functions import text as T
from siltstone.operators import components as C
from siltstone.operators import dedup as D
from siltstone.operators import quality as Q

from .base import Registry
from .texts import PAIRS_SQL, pairs

REGISTRY = Registry()
query = REGISTRY.query
SCRIPT = "A-Za-z"
PRIORITY = {"src0": 10, "src1": 20, "src2": 20}  # source: priority, 50 for others
PRIORITY_SQL = "CASE source WHEN 'src0' THEN 10 WHEN 'src1' THEN 20 WHEN 'src2' THEN 20 ELSE 50 END"
SPLIT_SQL = "CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'validation' ELSE 'train' END"
CLEAN_SQL = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"
RANK_SQL = "CASE split WHEN 'test' THEN 2 WHEN 'validation' THEN 3 ELSE 4 END"
GATE_SQL = rf"""g0 AS (SELECT doc_id, lang, source, {CLEAN_SQL} AS clean, text, list_filter(list_transform(string_split_regex(text, '\n'), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents),
gate AS (SELECT doc_id, lang, source, text, clean, CASE WHEN length(text) < 200 THEN 'too_short' WHEN length(text) > 20000 THEN 'too_long'
  WHEN len(regexp_extract_all(text, '\p{{L}}')) = 0 OR len(regexp_extract_all(text, '[A-Za-z]')) / len(regexp_extract_all(text, '\p{{L}}')) < 0.8 THEN 'low_bengali_letter_ratio'
  WHEN contains(text, chr(65533)) THEN 'invalid_unicode' WHEN len(l) >= 8 AND len(list_distinct(l)) / len(l) < 0.35 THEN 'repetitive_lines' END AS reason FROM g0)"""


def priority():
    table = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.col("source")), F.lit(50))


def split():
    return F.when(F.col("doc_id") % 10 == 0, "test").when(F.col("doc_id") % 10 == 1, "validation").otherwise("train")


def rank(column="split"):
    return F.element_at(F.create_map(*[F.lit(x) for kv in K.SPLIT_RANK.items() for x in kv]), F.col(column))


def reason(text="text"):
    return Q.document_reason(F.col(text), F.lit(1.0), SCRIPT, 200, 20_000, 0.5, 0.8)


@query(rf"""WITH {GATE_SQL}, b AS (SELECT trim(regexp_replace(text, '\s+', ' ', 'g')) AS p, COMPACT AS c FROM benchmark),
h AS (SELECT DISTINCT doc_id FROM gate JOIN b ON length(p) >= 20 AND contains(clean, p) WHERE reason IS NULL),
k AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, COMPACT AS t FROM gate WHERE reason IS NULL AND doc_id NOT IN (SELECT doc_id FROM h)) JOIN b ON length(c) >= 20 AND contains(t, c)),
s AS (SELECT gate.*, CASE WHEN reason IS NOT NULL THEN reason WHEN h.doc_id IS NOT NULL THEN 'protected_text' WHEN k.doc_id IS NOT NULL THEN 'protected_compact_text' ELSE 'accepted' END AS outcome, sha256(CAST(gate.doc_id AS VARCHAR)) AS m
  FROM gate LEFT JOIN h ON gate.doc_id = h.doc_id LEFT JOIN k ON gate.doc_id = k.doc_id)
SELECT lang, outcome, CASE WHEN (('0x' || substr(m, 1, 8))::UBIGINT::HUGEINT * 4294967296 + ('0x' || substr(m, 9, 8))::UBIGINT::HUGEINT) % 1000 < 100 THEN 'validation' ELSE 'train' END AS split, count(*) AS n FROM s GROUP BY ALL""".replace("COMPACT", r"regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '[^\p{L}\p{N}]', '', 'g')"))
def corpus_gate_report(read):
    """Documents by label, outcome and hash split: the gate's first failing rule; else a protected text of 20 letters
    or more held as it is, white space collapsed; else one held once both are compacted (case folded letters and numbers)."""
    docs = read("documents").select("doc_id", "lang", "text", reason().alias("reason"), T.collapse(F.coalesce("text", F.lit(""))).alias("clean"))
    protected = read("benchmark").select("item_id", T.collapse(F.col("text")).alias("p"), T.compact_alnum(F.col("text")).alias("c"))
    direct = D.with_contained(docs, protected, "doc_id", "clean", "item_id", "p").withColumnRenamed("hits", "direct")
    compact = direct.withColumn("compact", T.compact_alnum(F.when(F.isnull("reason") & (F.size("direct") == 0), F.col("text"))))
    out = D.with_contained(compact, protected, "doc_id", "compact", "item_id", "c")
    outcome = F.coalesce("reason", F.when(F.size("direct") > 0, "protected_text").when(F.size("hits") > 0, "protected_compact_text"), F.lit("accepted"))
    return out.groupBy("lang", outcome.alias("outcome"), K.per_mille_split(F.col("doc_id"), 100).alias("split")).agg(F.count("*").alias("n"))


@query(rf"""WITH c AS (SELECT doc_id, {CLEAN_SQL} AS t FROM documents), f AS (SELECT doc_id, t, len(regexp_extract_all(t, '[A-Za-z]')) AS s, len(regexp_extract_all(t, '\p{{L}}')) AS l FROM c)
SELECT doc_id, CASE WHEN t = '' THEN 'empty_after_model_cleaning' ELSE array_to_string(list_filter([CASE WHEN contains(t, '<') OR contains(t, '>') THEN 'angle_placeholder' END, CASE WHEN length(t) > 10000 THEN 'extreme_length' END,
  CASE WHEN l > 0 AND s / l < 0.9 THEN 'low_bengali_letter_ratio' END, CASE WHEN s = 0 THEN 'no_bengali_letter' END], lambda x: x IS NOT NULL), ',') END AS flags FROM f""")
def quality_flags(read):
    clean = T.collapse(F.coalesce("text", F.lit("")))
    d = read("documents").select("doc_id", clean.alias("clean"))
    own = Q.text_flags(F.col("clean"), F.col("clean"), SCRIPT, 10_000, 0.9)
    return d.select("doc_id", F.array_join(F.when(F.size(Q.fatal(own)) == F.size(own), own), ",").alias("flags"))


@query(rf"WITH {GATE_SQL} SELECT sha256(concat_ws(chr(31), 'documents', CAST(doc_id AS VARCHAR), reason)) AS exclusion_id, 'documents' AS task, doc_id AS row_id, reason FROM gate WHERE reason IS NOT NULL")
def reject_log(read):
    """Rejected documents with their first failing rule."""
    return Q.split_by_reason(read("documents"), reason(), "documents", "doc_id")[1]


@query(r"""WITH b AS (SELECT doc_id, text, CAST(substr(source, 4) AS INTEGER) % 3 = 0 AS syn, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w, greatest(1, len(regexp_extract_all(text, '\S'))) AS d FROM documents),
g AS (SELECT *, list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i : i + 2], chr(31))) AS g FROM b),
f AS (SELECT doc_id, syn, len(w) AS n, len(regexp_extract_all(text, '[A-Za-z]')) AS s, len(regexp_extract_all(text, '[A-Za-z]')) / d < 0.5 AS low, len(regexp_extract_all(text, '[\p{P}\p{S}]')) / d > 0.6 AS punct,
  CASE WHEN len(w) < 6 THEN 0 ELSE 1 - len(list_distinct(g)) / len(g) END >= 0.3 AS rep, length(text) AS c,
  regexp_matches(text, '(?s)a{6}|b{6}|c{6}|d{6}|e{6}|h{6}|!{6}|\*{6}|#{6}|\${6}|%{6}|&{6}|-{6}|={6}|\.{6}|_{6}|0{6}|1{6}|x{6}|X{6}|A{6}| {6}|\n{6}') AS run FROM g),
s AS (SELECT *, 1.0 - (s < 1)::INT * 0.7 - low::INT * 0.35 - (s / greatest(1, c) > 2)::INT - (c <= 1)::INT * 0.25 - (c > 1 AND c <= 3)::INT * 0.08 - (n = 1 AND c <= 4)::INT * 0.1 - run::INT * 0.2 - rep::INT * 0.25 - punct::INT * 0.4 AS q FROM f),
t AS (SELECT doc_id, syn, rep, low, round(greatest(0.0, least(1.0, q - (syn AND n <= 2)::INT * 0.1)), 9) AS q FROM s)
SELECT syn, low, rep, count(*) AS n, round(CAST(sum(q) AS DOUBLE), 5) AS score_sum, count(*) FILTER (q < 0.4) AS removed FROM t GROUP BY ALL""")
def quality_scores(read):
    """Additive quality scores, summed up by synthetic origin and two flags (a-z is the script here)."""
    syn = F.substr(F.col("source"), F.lit(4)).cast("int") % 3 == 0
    d = Q.with_quality_score(read("documents").select("text", syn.alias("syn")), "text", F.lit(""), F.col("syn"), F.lit(None).cast("double"), SCRIPT, None)
    return d.groupBy("syn", F.array_contains("flags", "low_bangla_ratio").alias("low"), F.array_contains("flags", "high_token_repetition").alias("rep")).agg(F.count("*").alias("n"), F.round(F.sum("score"), 5).alias("score_sum"), F.count_if(F.col("score") < 0.4).alias("removed"))


@query("""SELECT doc_id, lang IN ('en', 'de') AND length(text) BETWEEN 100 AND 20000 AS trainable, doc_id % 10 < 2 AS evaluable, lang NOT IN ('fr') AND doc_id % 10 >= 2 AS tokenizer,
  array_to_string(list_filter([CASE WHEN lang NOT IN ('en', 'de') THEN 'label' END, CASE WHEN length(text) NOT BETWEEN 100 AND 20000 THEN 'length' END], lambda x: x IS NOT NULL), ',') AS blocked FROM documents""")
def eligibility(read):
    """Named eligibility booleans and the reasons that block training."""
    label, size = F.col("lang").isin("en", "de"), F.length("text").between(100, 20_000)
    return read("documents").select("doc_id", (label & size).alias("trainable"), (F.col("doc_id") % 10 < 2).alias("evaluable"), (~F.col("lang").isin("fr") & (F.col("doc_id") % 10 >= 2)).alias("tokenizer"), F.array_join(Q.flags(label=~label, length=~size), ",").alias("blocked"))


@query("""WITH x AS (SELECT p_partkey, trim(lower(p_type)) AS t, p_size, p_brand FROM part)
SELECT CASE t WHEN 'economy' THEN 'ECO' WHEN 'standard' THEN 'STD' WHEN 'promo' THEN 'PRO' WHEN 'eco' THEN 'ECO' ELSE 'UNK' END AS code, count(*) AS n, count(*) FILTER (CAST(p_size % 2 AS VARCHAR) IN ('true', '1', 'yes', 'y')) AS odd FROM x GROUP BY 1""")
def standard_labels(read):
    """Labels mapped to codes, unknown ones to UNK, and a parsed boolean."""
    p = read("part").select(Q.standard_label(F.col("p_type"), {"economy": "ECO", "standard": "STD", "promo": "PRO"}).alias("code"), Q.parse_bool((F.col("p_size") % 2).cast("string")).alias("odd"))
    return p.groupBy("code").agg(F.count("*").alias("n"), F.count_if("odd").alias("odd"))


@query("SELECT lang, count(*) AS n FROM documents WHERE lang IN ('en', 'de', 'fr') AND source NOT IN ('src3', 'src4') GROUP BY lang")
def label_filter(read):
    d = Q.keep_labels(read("documents"), "lang", include=["en", "de", "fr"])
    return Q.keep_labels(d, "source", exclude=["src3", "src4"]).groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars >= greatest(1000, (SELECT quantile_cont(n_chars, 0.95) FROM documents))")
def length_outliers(read):
    d = read("documents")
    return d.join(F.broadcast(d.agg(F.percentile("n_chars", F.lit(0.95)).alias("q"))), F.col("n_chars") >= F.greatest(F.lit(1000), "q")).select("doc_id", "n_chars")


@query("""WITH f AS (SELECT min(doc_id) AS doc_id FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY PRIO, doc_id) AS r FROM documents) WHERE r = 1 GROUP BY text)
SELECT doc_id FROM f""".replace("PRIO", PRIORITY_SQL))
def exact_dedup(read):
    """The best row of each text by source priority and id."""
    d = read("documents").select("doc_id", F.sha2(F.col("text"), 256).alias("k"), priority().alias("prio"))
    return D.keep_first(d, ["k"], [F.col("prio"), F.col("doc_id")]).select("doc_id")


CONFLICT_SQL = rf"""p0 AS (SELECT doc_id, lang, regexp_extract(text, '^\S*') AS s, md5(substr(text, 1 + length(regexp_extract(text, '^\S*')))) AS t, {PRIORITY_SQL} AS prio, {SPLIT_SQL} AS split FROM documents),
bst AS (SELECT lang, s, min(prio) AS b FROM p0 GROUP BY ALL), ag AS (SELECT p0.lang, p0.s, min(t) AS lo, max(t) AS hi FROM p0 JOIN bst ON p0.lang = bst.lang AND p0.s = bst.s AND prio = b GROUP BY ALL),
res AS (SELECT p0.*, CASE WHEN lo <> hi THEN 'source_maps_multiple_targets_at_best_priority' WHEN t <> lo THEN 'conflicting_lower_priority_target' END AS reason FROM p0 JOIN ag ON p0.lang = ag.lang AND p0.s = ag.s)"""


def _split_texts(read):
    """Whole texts as pairs: the first word stands for the source, a digest of all the rest for the target."""
    head = F.regexp_extract("text", r"^\S*", 0)
    return read("documents").select("doc_id", "lang", head.alias("s"), F.md5(F.substr("text", F.length(head) + 1)).alias("t"), priority().alias("prio"), split().alias("split"))


@query(f"WITH {CONFLICT_SQL} SELECT doc_id, reason FROM res WHERE reason IS NOT NULL")
def pair_conflicts(read):
    """Rejected rows of sources that map to several targets (first words stand for sources, the rests of the texts for targets)."""
    return D.resolve_conflicts(_split_texts(read), "prio", ["lang", "s"], "t").filter("reason is not null").select("doc_id", "reason")


@query(f"""WITH {CONFLICT_SQL}, w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY lang, s, t ORDER BY prio, {RANK_SQL}, doc_id) AS winner_id FROM res WHERE reason IS NULL)
SELECT doc_id, winner_id FROM w WHERE doc_id <> winner_id""")
def pair_duplicates(read):
    """Losers of exact pair deduplication with the row that stays."""
    p = D.resolve_conflicts(_split_texts(read), "prio", ["lang", "s"], "t").filter("reason is null").withColumn("rk", rank())
    return D.drop_duplicates_logged(p, ["lang", "s", "t"], ["prio", "rk"], "doc_id").filter("not is_winner").select("doc_id", "winner_id")


@query(r"""WITH k AS (SELECT doc_id, source, md5(text) AS a, md5(regexp_replace(lower(text), '[^\p{L}\p{N}_]', '', 'g')) AS b FROM documents),
ca AS (SELECT a FROM k GROUP BY a HAVING min(source) <> max(source)), cb AS (SELECT b FROM k GROUP BY b HAVING min(source) <> max(source))
SELECT doc_id FROM k WHERE a IN (SELECT a FROM ca) OR b IN (SELECT b FROM cb)""")
def cross_label_conflicts(read):
    """Rows whose text or compact text is seen under more than one label."""
    d = read("documents").select("doc_id", "source", F.md5("text").alias("a"), F.md5(T.compact_word(F.col("text"))).alias("b"))
    return D.label_conflicts(d, ["a", "b"], "source").filter("conflict").select("doc_id")


@query(rf"""WITH k AS (SELECT doc_id, lang, {SPLIT_SQL} AS split, {PRIORITY_SQL} AS prio, md5(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_]', '', 'g')) AS c FROM documents)
SELECT lang, c AS compact, first(doc_id ORDER BY {RANK_SQL}, prio, doc_id) AS doc_id FROM k GROUP BY ALL""")
def label_representatives(read):
    """One row for each label and compact text; protected splits win, then priority, then id."""
    d = read("documents").select("doc_id", "lang", priority().alias("prio"), split().alias("split"), F.md5(T.compact_word(F.col("text"))).alias("compact")).withColumn("rk", rank())
    return D.keep_first(d, ["lang", "compact"], [F.col("rk"), F.col("prio"), F.col("doc_id")]).select("lang", "compact", "doc_id")


@query(f"""WITH d AS (SELECT *, {SPLIT_SQL} AS split FROM documents), k AS (SELECT text, min({RANK_SQL}) AS r FROM d WHERE split <> 'train' GROUP BY text)
SELECT doc_id, CASE r WHEN 2 THEN 'test' WHEN 3 THEN 'validation' ELSE 'train' END AS split FROM d LEFT JOIN k USING (text) WHERE split = 'train'""")
def inherited_splits(read):
    """Training rows take the most protected split in which their text is seen."""
    d = read("documents").select("doc_id", F.md5("text").alias("k"), split().alias("own"))
    known = d.filter("own <> 'train'").select("k", F.col("own").alias("split"))
    return D.inherit_split(d.filter("own = 'train'").drop("own"), known, "k", F.lit("train"), K.SPLIT_RANK).select("doc_id", "split")


@query(r"""WITH b AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS p FROM benchmark), d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, item_id FROM d JOIN b ON length(p) >= 20 AND contains(t, p)""")
def protected_containment(read):
    """Documents that hold a protected text, with the text."""
    d = read("documents").select("doc_id", T.collapse(F.coalesce("text", F.lit(""))).alias("t"))
    return D.contained(d, read("benchmark").select("item_id", T.collapse(F.col("text")).alias("p")), "doc_id", "t", "item_id", "p")


def _compact_rows(read):
    d = read("documents").select(F.col("doc_id").alias("row_id"), F.col("doc_id").alias("ordinal"), T.compact_alnum(F.col("text")).alias("compact"), split().alias("split"))
    return d


@query()
def near_leakage(read):
    """Training rows with a near match among validation and test rows. blake2b is beyond SQL."""
    d = C.written(_compact_rows(read), "compact")  # both sides read it
    return D.near_matches(d.filter("split = 'train'").drop("split"), d.filter("split <> 'train'").drop("split"))


@query()
def near_firewall(read):
    """Exact and near overlap counts of one side with the other, and the greatest similarity."""
    d = _compact_rows(read)
    d = C.written(d, "compact")  # both sides read it
    m = D.near_matches(d.filter("split = 'test'").drop("split"), d.filter("split = 'train'").drop("split"))
    return m.groupBy("kind").agg(F.count("*").alias("n"), F.max("score").alias("top"))


@query("""WITH g AS (SELECT item_id, len(list_distinct(list_transform(range(1, greatest(length(c) - 3, 1) + 1), lambda i: substr(c, i, 4)))) AS n FROM (SELECT item_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS c FROM benchmark))
SELECT item_id, CAST(n AS BIGINT) AS grams FROM g""")
def character_gram_sets(read):
    b = read("benchmark").select("item_id", F.regexp_replace(F.lower("text"), "[^a-z0-9]", "").alias("c"))
    return b.select("item_id", F.size(T.character_grams(F.col("c"))).cast("long").alias("grams"))


@query("""WITH d AS (SELECT doc_id AS id, md5(text) AS a, md5(regexp_replace(lower(text), '[^a-z]', '', 'g')) AS b FROM documents),
ga AS (SELECT a, min(id) AS m FROM d GROUP BY a), gb AS (SELECT b, min(id) AS m FROM d GROUP BY b)
SELECT id, gb.m AS component FROM d JOIN gb USING (b)""")
def text_components(read):
    """Components over equal texts and equal letter sequences (the second implies the first, so SQL needs no recursion)."""
    d = read("documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("a"), F.md5(F.regexp_replace(F.lower("text"), "[^a-z]", "")).alias("b"))
    return C.connected(d, "id", ["a", "b"])


@query()
def order_components(read):
    """All orders linked by supplier and line number. Recursive SQL is too slow for the whole table; tests use union-find."""
    e = read("lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_suppkey") * 1000 + F.col("l_linenumber")).alias("k"))
    return C.connected(e, "id", ["k"])


@query("""WITH k AS (SELECT doc_id, lang, source, md5(text) AS a, SPLIT AS split FROM documents), c AS (SELECT *, min(doc_id) OVER (PARTITION BY a) AS component FROM k)
SELECT component, count(*) AS row_count, string_agg(DISTINCT split, ',' ORDER BY split) AS splits, count(DISTINCT lang) AS langs, bool_or(split = 'train') AS contains_train, bool_or(split <> 'train') AS contains_protected FROM c GROUP BY component""".replace("SPLIT AS", SPLIT_SQL + " AS"))
def component_table(read):
    d = read("documents").select(F.col("doc_id").alias("id"), "lang", "source", F.md5("text").alias("a"), split().alias("split"))
    c = d.join(C.connected(d, "id", ["a"]), "id")
    return c.groupBy("component").agg(F.count("*").alias("row_count"), F.array_join(F.array_sort(F.collect_set("split")), ",").alias("splits"), F.countDistinct("lang").alias("langs"), F.bool_or(F.col("split") == "train").alias("contains_train"), F.bool_or(F.col("split") != "train").alias("contains_protected"))


@query("SELECT count(*) AS overlap FROM (SELECT text FROM documents WHERE doc_id % 10 > 1 AND text <> '' INTERSECT SELECT text FROM documents WHERE doc_id % 10 <= 1)")
def split_overlap(read):
    """Distinct texts on both sides of the split."""
    d = read("documents").select(F.md5("text").alias("k"), (F.col("doc_id") % 10 > 1).alias("train"), "text").filter("text <> ''")
    return d.filter("train").select("k").intersect(d.filter("not train").select("k")).agg(F.count("*").alias("overlap"))


GROUP_SQL = rf"""m AS (SELECT doc_id, lang, source, text, n_chars, CAST(substr(source, 4) AS INTEGER) % 3 = 0 AS syn, md5(regexp_replace(regexp_replace(regexp_replace(lower(text), '\s+', '', 'g'), '\p{{Nd}}', '0', 'g'), '[\p{{P}}\p{{S}}]', '', 'g')) AS k, {PRIORITY_SQL} AS prio FROM documents),
g AS (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM m)"""


def _members(read):
    k = F.md5(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower("text"), r"\s+", ""), r"\p{Nd}", "0"), r"[\p{P}\p{S}]", ""))
    return read("documents").select("doc_id", "lang", "source", "text", "n_chars", (F.substr("source", F.lit(4)).cast("int") % 3 == 0).alias("syn"), k.alias("k"), priority().alias("prio"))


@query(rf"""WITH {GROUP_SQL}, a AS (SELECT k, count(*) AS group_size, count(*) FILTER (NOT syn) AS real_count, count(*) FILTER (syn) AS synthetic_count, count(DISTINCT text) AS unique_texts, count(DISTINCT source) AS unique_sources, round(avg(n_chars), 6) AS mean_chars, min(n_chars) AS min_chars, max(n_chars) AS max_chars FROM g WHERE n > 1 GROUP BY k),
e AS (SELECT k, string_agg(substr(md5(text), 1, 6), ' || ' ORDER BY prio, doc_id) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY prio, doc_id) AS r FROM g WHERE n > 1) WHERE r <= 5 GROUP BY k)
SELECT a.*, CASE WHEN real_count > 0 AND synthetic_count > 0 THEN 'real_synthetic_collision' WHEN real_count > 0 THEN 'real_only_loose_duplicate' ELSE 'synthetic_only_loose_duplicate' END AS group_type, synthetic_count >= 2 AND synthetic_count >= real_count AS template_pressure, examples FROM a JOIN e USING (k)""")
def loose_group_report(read):
    """Loose duplicate groups: counts, type, template pressure and five examples."""
    from pyspark.sql import Window

    m = _members(read)
    size = m.groupBy("k").agg(F.count("*").alias("group_size"), F.count_if(F.expr("not syn")).alias("real_count"), F.count_if("syn").alias("synthetic_count"), F.countDistinct("text").alias("unique_texts"), F.countDistinct("source").alias("unique_sources"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.min("n_chars").alias("min_chars"), F.max("n_chars").alias("max_chars")).filter("group_size > 1")
    top = m.select("k", "prio", "doc_id", F.substr(F.md5("text"), F.lit(1), F.lit(6)).alias("p")).withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("prio", "doc_id"))).filter("r <= 5")
    examples = top.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "p"))), lambda x: x["p"]), " || ").alias("examples"))
    kind = F.when((F.col("real_count") > 0) & (F.col("synthetic_count") > 0), "real_synthetic_collision").when(F.col("real_count") > 0, "real_only_loose_duplicate").otherwise("synthetic_only_loose_duplicate")
    return size.withColumn("group_type", kind).withColumn("template_pressure", (F.col("synthetic_count") >= 2) & (F.col("synthetic_count") >= F.col("real_count"))).join(examples, "k")


@query(rf"""WITH {GROUP_SQL}, r AS (SELECT *, count(*) FILTER (syn) OVER (PARTITION BY k) AS made, row_number() OVER (PARTITION BY k, syn ORDER BY prio, n_chars DESC, doc_id) AS r FROM g)
SELECT doc_id, n < 2 OR NOT syn OR r <= CASE WHEN made < n THEN 1 ELSE 2 END AS keep, CASE WHEN n < 2 THEN 'group_below_thinning_threshold' WHEN made = 0 THEN 'real_only_preserved'
  WHEN made < n THEN CASE WHEN NOT syn THEN 'mixed_keep_real' WHEN r <= 1 THEN 'mixed_keep_top_synthetic' ELSE 'mixed_drop_excess_synthetic' END
  ELSE CASE WHEN r <= 2 THEN 'synthetic_only_keep_top' ELSE 'synthetic_only_drop_excess' END END AS decision FROM r""")
def thinned_groups(read):
    return D.thin_groups(_members(read), ["k"], [F.col("prio"), F.desc("n_chars"), F.col("doc_id")], F.col("syn")).select("doc_id", "keep", "decision")


@query(f"""WITH d AS (SELECT doc_id, lang, md5(text) AS k, {PRIORITY_SQL} AS prio, n_chars FROM documents)
SELECT doc_id, doc_id = first_value(doc_id) OVER (PARTITION BY k, lang ORDER BY prio, n_chars DESC, doc_id) AS kept FROM d""")
def train_dedup_log(read):
    """The decision for every row of text and label deduplication."""
    d = read("documents").select("doc_id", "lang", F.md5("text").alias("k"), priority().alias("prio"), (-F.col("n_chars")).alias("short"))
    return D.drop_duplicates_logged(d, ["k", "lang"], ["prio", "short"], "doc_id").select("doc_id", F.col("is_winner").alias("kept"))


@query(f"""WITH d AS (SELECT doc_id, text, {SPLIT_SQL} AS split, n_chars AS weight FROM documents), p AS (SELECT DISTINCT text FROM d WHERE split <> 'train')
SELECT first(doc_id ORDER BY weight DESC, doc_id) AS doc_id FROM d WHERE split = 'train' AND text <> '' AND text NOT IN (SELECT text FROM p) GROUP BY text""")
def tokenizer_manifest(read):
    """Training texts unseen in protected splits, one row for each, highest weight first."""
    d = read("documents").select("doc_id", F.md5("text").alias("k"), split().alias("split"), F.col("n_chars").alias("weight"), (F.length("text") > 0).alias("full"))
    free = d.filter("split = 'train' and full").join(d.filter("split <> 'train'").select("k").distinct(), "k", "left_anti")
    return D.keep_first(free, ["k"], [-F.col("weight"), F.col("doc_id")]).select("doc_id")


@query(f"""WITH {PAIRS_SQL}, c AS (SELECT source AS s, target FROM pairs) SELECT s AS source_key, count(*) AS n, count(DISTINCT target) > 1 AS conflict FROM c GROUP BY s""")
def mapping_conflicts(read):
    p = pairs(read).select(F.col("source").alias("source_key"), "target")
    return p.groupBy("source_key").agg(F.count("*").alias("n"), (F.min("target") != F.max("target")).alias("conflict"))


@query("""SELECT count(*) AS rows, count(*) - count(DISTINCT text) AS repeated, count(*) FILTER (lang IS NULL OR lang = 'UNK') AS unknown_label, count(*) FILTER (text IS NULL OR text = '') AS missing_text,
  (SELECT count(*) FROM documents WHERE doc_id % 10 = 0 AND text IN (SELECT text FROM documents WHERE doc_id % 10 > 1)) AS leaks, count(DISTINCT doc_id) = count(*) AS unique_ids FROM documents""")
def data_gate(read):
    """Named checks over the whole table."""
    d = read("documents").select("doc_id", "lang", "text", F.md5("text").alias("k"))
    leaks = d.filter("doc_id % 10 = 0").join(d.filter("doc_id % 10 > 1").select("k"), "k", "left_semi").agg(F.count("*").alias("leaks"))
    checks = d.agg(F.count("*").alias("rows"), (F.count("*") - F.countDistinct("k")).alias("repeated"), F.count_if(F.expr("lang is null or lang = 'UNK'")).alias("unknown_label"), F.count_if(F.expr("text is null or text = ''")).alias("missing_text"), (F.countDistinct("doc_id") == F.count("*")).alias("unique_ids"))
    return checks.join(leaks)
