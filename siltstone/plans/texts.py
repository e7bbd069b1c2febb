"""Queries of the text and key functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import keys as K
from siltstone.functions import text as T

from .base import Registry

REGISTRY = Registry()
query = REGISTRY.query
LATIN_SQL = "A-Za-zÀ-ɏ"


def pairs(read):
    """User turns with the assistant's answer that follows."""
    c = read("conversations")
    user = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("source"))
    reply = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    return user.join(reply, ["conv_id", "turn"])


def dealt_pairs(read):
    """pairs in as many partitions as a shuffle has, for work that is costly a pair; few small rows would be one task."""
    p = pairs(read)
    return p.repartition(int(p.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv_id", "turn")


PAIRS_SQL = """pairs AS (SELECT u.conv_id, u.turn, u.text AS source, a.text AS target FROM conversations u JOIN conversations a
  ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""


@query(r"""
WITH n AS (SELECT doc_id, regexp_replace(nfc_normalize(coalesce(text, '')), '[\x{FEFF}\x{200B}\x{200C}]', '', 'g') AS nfc FROM documents),
c AS (SELECT doc_id, nfc, trim(regexp_replace(regexp_replace(replace(nfc, chr(160), ' '), '\p{C}', ' ', 'g'), '\s+', ' ', 'g')) AS clean FROM n),
m AS (SELECT *, trim(regexp_replace(regexp_replace(translate(trim(regexp_replace(clean, '^["“”„]+|["“”„]+$', '', 'g')), '–−‘’', '——'''''), '\s+([।?!,.;:])', '\1', 'g'), '\s+', ' ', 'g')) AS model FROM c)
SELECT doc_id, md5(replace(nfc, chr(160), ' ')) AS nfc, md5(clean) AS clean, md5(model) AS model,
  md5(replace(lower(regexp_replace(model, '[^\p{L}\p{N}]', '', 'g')), 'ß', 'ss')) AS compact FROM m""")
def text_levels(read):
    """Digests of the five normalization levels of every document."""
    d = read("documents").select("doc_id", T.level_nfc(F.col("text")).alias("nfc")).withColumn("clean", T.level_clean(F.col("nfc"))).withColumn("model", T.level_model(F.col("clean")))
    return d.select("doc_id", F.md5("nfc").alias("nfc"), F.md5("clean").alias("clean"), F.md5("model").alias("model"), F.md5(T.level_compact(F.col("model"))).alias("compact"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(nfc_normalize(coalesce(text, '')), '[\x{FEFF}\x{200B}-\x{200D}]', '', 'g'), '[\s\x{A0}]+', ' ', 'g'))) AS normalized, coalesce(text, '') = nfc_normalize(coalesce(text, '')) AS is_nfc FROM documents")
def text_normalized(read):
    text = F.col("text")
    return read("documents").select("doc_id", F.md5(T.normalized(text)).alias("normalized"), (T.raw_text(text) == T.nfc(T.raw_text(text))).alias("is_nfc"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(coalesce(text, '')), '\s*([,.;:!?।\-–—/\\])\s*', '\1', 'g'), '([\(\[\{])\s+', '\1', 'g'), '\s+([\)\]\}])', '\1', 'g'), '\s+', ' ', 'g'))) AS canonical FROM documents""")
def text_detokenized(read):
    return read("documents").select("doc_id", F.md5(T.detokenized(F.col("text"))).alias("canonical"))


@query()
def text_html_clean(read):
    """Pages as plain text; entities need Python's table, so there is no SQL."""
    return read("pages").select("page_id", T.cleaned(F.col("html")).alias("text"))


@query(r"""WITH k AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(coalesce(text, '')), '[\x00-\x1F\x7F-\x{9F}\x{200B}-\x{200F}\x{FEFF}]', '', 'g'), '[\s\x{A0}]+', '', 'g'), '\p{Nd}', '0', 'g'), '[\p{P}\p{S}]', '', 'g') AS k FROM documents)
SELECT md5(k) AS loose_key, count(*) AS n, min(doc_id) AS first_id FROM k GROUP BY k HAVING count(*) > 1""")
def text_loose_groups(read):
    """Groups that differ in spacing, punctuation and digit values only."""
    k = read("documents").select("doc_id", F.md5(T.loose_key(F.col("text"))).alias("loose_key"))
    return k.groupBy("loose_key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query(r"SELECT doc_id, md5(regexp_replace(text, '[\x00-\x1F\x7F-\x{9F}\x{200B}-\x{200F}\x{FEFF}]', '', 'g')) AS stripped, md5(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_]', '', 'g')) AS compact_word, md5(regexp_replace(replace(lower(nfc_normalize(coalesce(text, ''))), 'ß', 'ss'), '[^\p{L}\p{N}]', '', 'g')) AS compact_alnum FROM documents")
def text_compact_keys(read):
    text = F.col("text")
    return read("documents").select("doc_id", F.md5(T.without_controls(text)).alias("stripped"), F.md5(T.compact_word(text)).alias("compact_word"), F.md5(T.compact_alnum(text)).alias("compact_alnum"))


@query(r"""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '\p{L}')) AS letters, len(regexp_extract_all(text, '[A-Za-z]')) AS script, len(list_filter(string_split_regex(text, '\s+'), lambda x: regexp_matches(x, '[A-Za-z]'))) AS script_words FROM documents)
SELECT doc_id, CAST(letters AS BIGINT) AS letters, CAST(script AS BIGINT) AS script, CAST(script_words AS BIGINT) AS script_words, round(CASE WHEN letters > 0 THEN script / letters ELSE 0 END, 6) AS ratio FROM c""")
def text_letter_ratio(read):
    """Letters, letters of a script (here A-Z) and their ratio."""
    text = F.col("text")
    return read("documents").select("doc_id", T.letters(text).alias("letters"), T.script_letters(text, "A-Za-z").alias("script"), T.script_words(text, "A-Za-z").alias("script_words"), F.round(T.script_ratio(text, "A-Za-z"), 6).alias("ratio"))


@query(r"""WITH w AS (SELECT DISTINCT unnest(string_split_regex(text, '\s+')) AS w FROM documents)
SELECT w AS word, regexp_matches(w, '\p{L}') AS has_letter, regexp_matches(w, '^[A-Za-z]+$') AS latin_only, regexp_matches(w, '^[0-9]+([.,][0-9]+)?$') AS numeric_like, regexp_matches(w, '^[\p{P}\p{S}]+$') AS punctuation_only FROM w WHERE w <> ''""")
def text_word_predicates(read):
    w = read("documents").select(F.explode(T.words(F.col("text"))).alias("word")).distinct()
    word = F.col("word")
    return w.select("word", T.has_letter(word).alias("has_letter"), T.latin_only(word).alias("latin_only"), T.numeric_like(word).alias("numeric_like"), T.punctuation_only(word).alias("punctuation_only"))


@query(r"""WITH b AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w, len(regexp_extract_all(text, '\S')) AS nonspace FROM documents)
SELECT doc_id, CAST(length(text) AS BIGINT) AS char_len, CAST(nonspace AS BIGINT) AS nonspace_len, CAST(len(regexp_extract_all(text, '[0-9]')) AS BIGINT) AS digits,
  CAST(len(regexp_extract_all(text, '[\p{P}\p{S}]')) AS BIGINT) AS marks, round(len(regexp_extract_all(text, '[A-Za-z]')) / greatest(1, nonspace), 6) AS latin_ratio,
  CAST(len(w) AS BIGINT) AS tokens, round(len(list_distinct(w)) / greatest(1, len(w)), 6) AS unique_ratio FROM b""")
def text_char_stats(read):
    text, own = F.col("text"), T.words(F.col("text"))
    solid = T.count(text, r"\S")
    return read("documents").select(
        "doc_id", F.length(text).cast("long").alias("char_len"), solid.alias("nonspace_len"), T.count(text, r"\p{Nd}").alias("digits"), T.count(text, r"\p{P}\p{S}").alias("marks"),
        F.round(T.count(text, "A-Za-z") / F.greatest(F.lit(1), solid), 6).alias("latin_ratio"), F.size(own).cast("long").alias("tokens"), F.round(F.size(F.array_distinct(own)) / F.greatest(F.lit(1), F.size(own)), 6).alias("unique_ratio"),
    )


@query("""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, unnest(range(length(text))) AS i FROM documents),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, ch ORDER BY i) AS g FROM c),
r AS (SELECT doc_id, ch, g, count(*) AS n FROM g GROUP BY ALL)
SELECT doc_id, max(n) AS longest FROM r GROUP BY doc_id""")
def text_char_runs(read):
    """The longest run of one character."""
    return read("documents").select("doc_id", T.longest_run(F.col("text")).alias("longest"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, w, list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i : i + 2], chr(31))) AS g FROM w)
SELECT doc_id, round(CASE WHEN len(w) < 6 THEN 0 ELSE 1 - len(list_distinct(g)) / len(g) END, 6) AS repetition FROM g""")
def text_trigram_repetition(read):
    return read("documents").select("doc_id", F.round(T.ngram_repetition(F.col("text")), 6).alias("repetition"))


@query(r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\n'), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, len(l) >= 8 AND len(list_distinct(l)) / len(l) < 0.35 AS repetitive FROM l""")
def text_repeated_lines(read):
    return read("documents").select("doc_id", F.size(T.lines(F.col("text"))).cast("long").alias("n_lines"), T.repetitive_lines(F.col("text")).alias("repetitive"))


@query(r"""WITH t AS (SELECT lang, unnest(regexp_extract_all(text, '[À-ɏ]+|[A-Za-z]+(?:''[A-Za-z]+)?|[0-9]+(?:[.,][0-9]+)?')) AS t FROM documents)
SELECT lang, CASE WHEN regexp_matches(t, '^[A-Za-z]+$') THEN lower(t) ELSE t END AS token, count(*) AS n FROM t GROUP BY ALL""")
def text_lexical_tokens(read):
    d = read("documents").select("lang", F.explode(T.lexical_tokens(F.col("text"), "À-ɏ")).alias("token"))
    return d.groupBy("lang", "token").agg(F.count("*").alias("n"))


@query(r"""WITH t AS (SELECT DISTINCT unnest(string_split_regex(text, '\s+')) AS t FROM documents)
SELECT count(*) AS words, count(*) FILTER (NOT regexp_matches(t, '<>|&lt;&gt;|^\s*$') AND length(t) BETWEEN 2 AND 32 AND NOT regexp_matches(t, '^[\p{P}\p{S}]*$') AND regexp_matches(t, '[A-Za-z]') AND NOT regexp_matches(t, '^[0-9]+([.,][0-9]+)?$')) AS protectable FROM t WHERE t <> ''""")
def text_protectable(read):
    w = read("documents").select(F.explode(T.words(F.col("text"))).alias("w")).distinct()
    return w.agg(F.count("*").alias("words"), F.count_if(T.protectable(F.col("w"), "A-Za-z")).alias("protectable"))


@query(rf"""WITH {PAIRS_SQL}, w AS (SELECT conv_id, turn, greatest(len(list_filter(string_split_regex(source, '\s+'), lambda x: regexp_matches(x, '[{LATIN_SQL}]'))), len(list_filter(string_split_regex(target, '\s+'), lambda x: regexp_matches(x, '[{LATIN_SQL}]')))) AS m FROM pairs)
SELECT conv_id, turn, CASE WHEN m <= 1 THEN 'word' WHEN m < 40 THEN 'phrase' ELSE 'sentence' END AS granularity FROM w""")
def text_granularity(read):
    return pairs(read).select("conv_id", "turn", T.granularity(F.col("source"), F.col("target"), 40, T.LATIN).alias("granularity"))


@query(rf"""WITH {PAIRS_SQL}, n AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(source, '[0-9]+')) AS a, list_distinct(regexp_extract_all(target, '[0-9]+')) AS b FROM pairs)
SELECT conv_id, turn, CAST(len(a) AS BIGINT) AS n_numbers, len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS preserved FROM n""")
def text_numbers_preserved(read):
    p = pairs(read)
    return p.select("conv_id", "turn", F.size(T.numbers(F.col("source"))).cast("long").alias("n_numbers"), T.numbers_preserved(F.col("target"), F.col("source")).alias("preserved"))


@query(rf"""WITH {PAIRS_SQL}, w AS (SELECT conv_id, turn, source, target, list_filter(string_split_regex(source, '\s+'), lambda x: x <> '') AS a, list_filter(string_split_regex(target, '\s+'), lambda x: x <> '') AS b FROM pairs),
u AS (SELECT *, len(list_distinct(list_concat(a, b))) AS u, len(list_distinct(list_intersect(a, b))) AS i, least(length(source), length(target)) AS m FROM w),
p AS (SELECT *, list_position(list_transform(range(1, m + 1), lambda k: substr(source, k, 1) = substr(target, k, 1)), false) AS p FROM u)
SELECT conv_id, turn, round(CASE WHEN u > 0 THEN i / u ELSE 1 END, 6) AS jaccard, round(CASE WHEN m = 0 THEN 0 WHEN p IS NULL OR p = 0 THEN m ELSE p - 1 END / greatest(m, 1), 6) AS prefix_share, round(len(list_distinct(a)) / len(a), 6) AS diversity FROM p""")
def text_pair_similarity(read):
    p = pairs(read).withColumn("a", T.words(F.col("source"))).withColumn("b", T.words(F.col("target")))
    a, b = F.col("a"), F.col("b")
    return p.select("conv_id", "turn", F.round(T.jaccard(a, b), 6).alias("jaccard"), F.round(T.common_prefix_share(F.col("source"), F.col("target")), 6).alias("prefix_share"), F.round(T.diversity(a), 6).alias("diversity"))


@query(r"""WITH s AS (SELECT item_id, text, item_id AS k, string_split_regex(trim(text), '\s+') AS w FROM benchmark)
SELECT item_id, CASE WHEN k % 3 = 0 THEN CASE WHEN regexp_matches(text, '[।?!.,]+$') THEN trim(regexp_replace(text, '[।?!.,]+$', '')) ELSE text || ' ।' END
  WHEN k % 3 = 1 AND len(w) >= 3 THEN array_to_string(list_concat(list_concat(w[1 : k % (len(w) - 1)], [w[k % (len(w) - 1) + 1] || w[k % (len(w) - 1) + 2]]), w[k % (len(w) - 1) + 3 :]), ' ')
  ELSE '“' || text || '”' END AS variant,
  CASE WHEN k % 3 = 0 THEN 'terminal_punctuation_variant' WHEN k % 3 = 1 AND len(w) >= 3 THEN 'single_safe_boundary_join' ELSE 'quote_and_dash_typography_variant' END AS method FROM s""")
def text_synthetic_variant(read):
    d = read("benchmark").select("item_id", T.synthetic_variant(F.col("text"), F.col("item_id")).alias("v"))
    return d.select("item_id", F.col("v.text").alias("variant"), F.col("v.method").alias("method"))


@query()
def text_perturbed(read):
    """Benchmark texts under three families of noise; the draws are seeded by hash, so there is no SQL."""
    families = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.lit(s).alias("severity")) for f in ("deletion", "swap", "whitespace") for s in (0.05, 0.2)])).alias("x")
    d = read("benchmark").select("item_id", "text", families).select("item_id", "text", "x.*")
    seed = F.conv(F.substr(K.stable_hash(F.col("item_id"), F.col("family"), F.col("severity")), F.lit(1), F.lit(8)), 16, 10).cast("long")
    return d.select("item_id", "family", "severity", T.perturbed(F.col("text"), F.col("family"), F.col("severity"), seed).alias("text"))


@query("SELECT lang, '<' || upper(lang) || '>' AS tag, count(*) AS n, md5(min(regexp_replace(trim(text), '[\\s]+', ' ', 'g'))) AS first_line FROM documents GROUP BY lang")
def text_tags(read):
    """The tag of each label, and its first cleaned line."""
    line = T.collapse(F.col("text"))
    return read("documents").groupBy("lang").agg(F.count("*").alias("n"), F.md5(F.min(line)).alias("first_line")).select("lang", F.concat(F.lit("<"), F.upper("lang"), F.lit(">")).alias("tag"), "n", "first_line")


@query("SELECT doc_id, sha256(concat_ws(chr(31), lang, source, coalesce(text, 'None'))) AS row_hash, substr(sha256(concat_ws(chr(31), 'blind', CAST(doc_id AS VARCHAR))), 1, 20) AS blind_id FROM documents")
def hash_rows(read):
    return read("documents").select("doc_id", K.stable_hash(F.col("lang"), F.col("source"), F.col("text")).alias("row_hash"), K.blind_id("blind", F.col("doc_id")).alias("blind_id"))


@query("""WITH h AS (SELECT doc_id, sha256('72119' || chr(31) || CAST(doc_id AS VARCHAR)) AS s, sha256(CAST(doc_id AS VARCHAR)) AS m FROM documents),
v AS (SELECT doc_id, CAST(('0x' || substr(s, 1, 8))::UBIGINT::HUGEINT * 4294967296 + ('0x' || substr(s, 9, 8))::UBIGINT::HUGEINT AS DOUBLE) / 18446744073709551616.0 AS u,
  (('0x' || substr(m, 1, 8))::UBIGINT::HUGEINT * 4294967296 + ('0x' || substr(m, 9, 8))::UBIGINT::HUGEINT) % 1000 AS k, ('0x' || substr(m, 1, 12))::UBIGINT % 1000 AS b FROM h)
SELECT doc_id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'validation' ELSE 'test' END AS split, CASE WHEN k < 10 THEN 'validation' ELSE 'train' END AS per_mille, CASE WHEN b < 800 THEN 'train' WHEN b < 900 THEN 'validation' ELSE 'test' END AS component FROM v""")
def hash_splits(read):
    """Three deterministic splits: seeded hash, hash mod 1000, and component bucket."""
    i = F.col("doc_id")
    return read("documents").select("doc_id", K.hash_split(i, 72119).alias("split"), K.per_mille_split(i, 10).alias("per_mille"), K.component_split(F.sha2(i.cast("string"), 256)).alias("component"))


@query("""WITH b AS (SELECT lang, doc_id // 1000 AS block, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS h FROM documents GROUP BY ALL)
SELECT lang, sha256(string_agg(h, '' ORDER BY block)) AS frame_hash FROM b GROUP BY lang""")
def hash_frames(read):
    """One digest of each label's rows in order of their ids: digests of blocks of 1,000 ids, then of the blocks."""
    joined = lambda order, h: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, h.alias("h")))), lambda x: x["h"]), ""), 256)
    blocks = read("documents").groupBy("lang", F.floor(F.col("doc_id") / 1000).alias("block")).agg(joined("doc_id", F.sha2("text", 256)).alias("h"))
    return blocks.groupBy("lang").agg(joined("block", F.col("h")).alias("frame_hash"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN json_valid(props) AND json_type(props) = 'ARRAY' THEN 1 ELSE 0 END AS n_items FROM events")
def json_fields(read):
    """A field of a JSON column, and how many items a JSON list would have."""
    return read("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.size(K.json_list(F.col("props"))).alias("n_items"))


@query("SELECT user_id, '{\"events\":' || count(*) || ',\"types\":' || to_json(list_sort(list_distinct(list(event_type)))) || '}' AS body FROM events GROUP BY user_id")
def json_compact(read):
    """Compact JSON with sorted keys."""
    e = read("events").groupBy("user_id").agg(F.count("*").alias("events"), K.unique_sorted(F.collect_set("event_type")).alias("types"))
    return e.select("user_id", F.to_json(F.struct("events", "types")).alias("body"))


@query("""WITH u AS (SELECT source, list(DISTINCT lang) AS l, list_distinct(list_transform(list(lang ORDER BY doc_id), lambda x: trim(x))) AS k FROM documents GROUP BY source)
SELECT source, array_to_string(list_sort(l), ',') AS langs, CAST(len(k) AS BIGINT) AS n_ordered FROM u""")
def array_sets(read):
    first = read("documents").groupBy("source", "lang").agg(F.min("doc_id").alias("first"))
    own = F.transform(F.array_sort(F.collect_list(F.struct("first", "lang"))), lambda x: x["lang"])
    return first.groupBy("source").agg(own.alias("l")).select("source", F.array_join(K.unique_sorted(F.col("l")), ",").alias("langs"), F.size(K.keep_order(F.col("l"))).cast("long").alias("n_ordered"))


@query("""WITH s AS (SELECT text, CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'validation' ELSE 'train' END AS split FROM documents)
SELECT md5(text) AS text_key, CASE min(CASE split WHEN 'test' THEN 2 WHEN 'validation' THEN 3 ELSE 4 END) WHEN 2 THEN 'test' WHEN 3 THEN 'validation' ELSE 'train' END AS split FROM s GROUP BY text""")
def protected_splits(read):
    """The most protected split of each text."""
    split = F.when(F.col("doc_id") % 10 == 0, "test").when(F.col("doc_id") % 10 == 1, "validation").otherwise("train")
    d = read("documents").groupBy(F.md5("text").alias("text_key")).agg(F.collect_set(split).alias("s"))
    return d.select("text_key", K.protected_split(F.col("s")).alias("split"))


@query(rf"""WITH {PAIRS_SQL}, w AS (SELECT conv_id, turn, len(list_filter(string_split_regex(source, '\s+'), lambda x: x <> '')) AS n, len(list_filter(string_split_regex(target, '\s+'), lambda x: x <> '')) AS m FROM pairs),
c AS (SELECT *, greatest(1, 64 - least(m, 32)) AS l FROM w)
SELECT conv_id, turn, CAST(CASE WHEN n + m <= 64 THEN n ELSE least(n, l) END AS BIGINT) AS n_source, CAST(CASE WHEN n + m <= 64 THEN m ELSE least(m, greatest(1, 64 - least(n, l))) END AS BIGINT) AS n_target FROM c""")
def truncated_pairs(read):
    """Token counts of pairs cut to a budget of 64."""
    a, b = K.truncated_pair(T.words(F.col("source")), T.words(F.col("target")), 64)
    return pairs(read).select("conv_id", "turn", F.size(a).cast("long").alias("n_source"), F.size(b).cast("long").alias("n_target"))
