"""Text functions on columns: normalization levels, counts, predicates, tokens, keys.

Script classes are parameters; the default is the Bengali block. Only what the built-in functions
lack (Unicode normalization, case folding, HTML entities) runs in Arrow UDFs. Null texts give
null, or empty where the docstring says so.
"""

from __future__ import annotations

import html
import random
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

BENGALI = r"ঀ-৿"
LATIN = r"A-Za-zÀ-ɏ"
SPACE = r"[\s\u0085   -     　]"


def _unicode(form: str):
    @F.pandas_udf(StringType())
    def normalize(text: pd.Series) -> pd.Series:
        return text.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize(form, x))

    return normalize


nfc_udf, nfkc_udf = _unicode("NFC"), _unicode("NFKC")


@F.pandas_udf(StringType())
def fold_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else x.casefold())


@F.pandas_udf(StringType())
def unescape_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else html.unescape(x))


def nfc(text: Column) -> Column:
    return nfc_udf(text)


def raw_text(text: Column) -> Column:
    """The text itself, null as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def collapse(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def normalized(text: Column) -> Column:
    """NFC without zero-width signs, white space collapsed; null as empty."""
    return collapse(F.regexp_replace(nfc(raw_text(text)), r"[﻿​‌‍]", ""))


def level_nfc(text: Column) -> Column:
    return F.translate(F.regexp_replace(nfc(raw_text(text)), r"[﻿​‌]", ""), " ", " ")


def level_clean(nfc_text: Column) -> Column:
    return collapse(F.regexp_replace(nfc_text, r"\p{C}", " "))


def level_model(clean: Column, transcript: bool = False) -> Column:
    """Outer quotes off, dashes and apostrophes unified, no blank before closing punctuation."""
    text = F.replace(clean, F.lit("<>"), F.lit(" ")) if transcript else clean
    text = F.trim(F.regexp_replace(text, r'^["“”„]+|["“”„]+$', ""))
    text = F.translate(text, "–−‘’", "——''")
    return collapse(F.regexp_replace(text, rf"{SPACE}+([।?!,.;:])", "$1"))


def level_compact(model: Column) -> Column:
    """NFKC letters and numbers, case folded."""
    return fold_udf(F.regexp_replace(nfkc_udf(model), r"[^\p{L}\p{N}]", ""))


def detokenized(text: Column) -> Column:
    """A canonical form for comparison: NFC, no blanks around separators or inside brackets."""
    text = F.regexp_replace(nfc(raw_text(text)), rf"{SPACE}*([,.;:!?।\-–—/\\]){SPACE}*", "$1")
    text = F.regexp_replace(F.regexp_replace(text, rf"([\(\[\{{]){SPACE}+", "$1"), rf"{SPACE}+([\)\]\}}])", "$1")
    return collapse(text)


def cleaned(text: Column, artifacts: str = "<>") -> Column:
    """Entities decoded, NFC, tags and controls out, punctuation runs cut to three, spacing set."""
    text = nfc(unescape_udf(raw_text(text)))
    text = F.regexp_replace(F.replace(text, F.lit(artifacts), F.lit(" ")), r"(?s)<[^<>]*>", " ")
    text = F.regexp_replace(text, r"[\p{Cc}\p{Cf}]", " ")
    text = F.regexp_replace(text, r"([।.!?,;:])\1{3,}", "$1$1$1")
    return F.regexp_replace(collapse(text), r" +([।,.;:!?])", "$1")


def without_controls(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1F\x7F-\x9F]", ""), r"[​-‏﻿]", "")


def loose_key(text: Column) -> Column:
    """A key that ignores spacing, punctuation, symbols and digit values; null as empty."""
    text = without_controls(nfc(raw_text(text)))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, f"{SPACE}+", ""), r"\p{Nd}", "0"), r"[\p{P}\p{S}]", "")


def compact_alnum(text: Column) -> Column:
    """Case-folded NFC, letters and numbers only."""
    return F.regexp_replace(fold_udf(nfc(raw_text(text))), r"[^\p{L}\p{N}]", "")


def compact_word(text: Column) -> Column:
    """Lower-cased, without anything but letters, numbers and underscores."""
    return F.regexp_replace(F.lower(raw_text(text)), r"[^\p{L}\p{N}_]", "")


def count(text: Column, kinds: str) -> Column:
    """How many characters are of these classes (the inside of a bracket expression): what is left
    when runs of others are cut out. Counting matches would make an object of each character."""
    return F.length(F.regexp_replace(text, f"[^{kinds}]+", "")).cast("long")


def letters(text: Column) -> Column:
    return count(text, r"\p{L}")


def script_letters(text: Column, script: str = BENGALI) -> Column:
    return F.length(F.regexp_replace(text, rf"[[^{script}]\P{{L}}]+", "")).cast("long")


def script_ratio(text: Column, script: str = BENGALI) -> Column:
    """Letters of the script among all letters, 0 without letters."""
    return F.when(letters(text) > 0, script_letters(text, script) / letters(text)).otherwise(F.lit(0.0))


def words(text: Column) -> Column:
    """White-space separated tokens."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda x: x != "")


def script_words(text: Column, script: str = BENGALI) -> Column:
    return F.size(F.filter(words(text), lambda x: x.rlike(f"[{script}]"))).cast("long")


def has_letter(text: Column) -> Column:
    return text.rlike(r"\p{L}")


def has_script(text: Column, script: str = BENGALI) -> Column:
    return text.rlike(f"[{script}]")


def latin_only(text: Column) -> Column:
    """Only a-z in either case and white space, and some letter."""
    return text.rlike(r"^[A-Za-z\s]*[A-Za-z][A-Za-z\s]*$")


def numeric_like(text: Column) -> Column:
    return text.rlike(r"^\d+([.,]\d+)?$")


def punctuation_only(text: Column) -> Column:
    return F.trim(text).rlike(r"^[\p{P}\p{S}]*$")


def longest_run(text: Column) -> Column:
    """The length of the longest run of one character."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"(?s)(.)\1*"), F.lit(0)), F.length)), F.lit(0)).cast("long")


def ngrams(tokens: Column, n: int) -> Column:
    """All n-grams of an array, joined by U+001F. Shifted arrays are zipped: one pass for any length."""
    out = tokens
    for k in range(1, n):
        out = F.zip_with(out, F.slice(tokens, k + 1, F.greatest(F.size(tokens), F.lit(1))), lambda a, b: F.concat(a, F.lit("\u001f"), b))
    return F.filter(out, lambda x: x.isNotNull())


def ngram_repetition(text: Column, n: int = 3) -> Column:
    """1 - distinct / all n-grams of words; 0 below 2n words."""
    grams = ngrams(words(text), n)
    return F.when(F.size(grams) < n + 1, F.lit(0.0)).otherwise(1 - F.size(F.array_distinct(grams)) / F.size(grams))


def lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x0B\f\x1C-\x1E\u0085  ]"), lambda x: F.trim(x)), lambda x: x != "")


def repetitive_lines(text: Column, least: int = 8, share: float = 0.35) -> Column:
    own = lines(text)
    return (F.size(own) >= least) & (F.size(F.array_distinct(own)) / F.size(own) < share)


def lexical_tokens(text: Column, script: str = BENGALI) -> Column:
    """Script words, Latin words and numbers; Latin ones lower-cased."""
    found = F.regexp_extract_all(text, F.lit(rf"[{script}]+|[A-Za-z]+(?:'[A-Za-z]+)?|\d+(?:[.,]\d+)?"), F.lit(0))
    return F.transform(found, lambda x: F.when(latin_only(x), F.lower(x)).otherwise(x))


def protectable(token: Column, script: str = BENGALI, least: int = 2, most: int = 32, numbers: bool = False) -> Column:
    out = ~token.rlike(r"<>|&lt;&gt;|^\s*$") & F.length(token).between(least, most) & ~punctuation_only(token) & has_script(token, script)
    return out if numbers else out & ~numeric_like(token)


def granularity(source: Column, target: Column, sentence: int = 4, script: str = BENGALI) -> Column:
    most = F.greatest(script_words(source, script), script_words(target, script))
    return F.when(most <= 1, "word").when(most < sentence, "phrase").otherwise("sentence")


def numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[০-৯0-9]+"), F.lit(0)))


def numbers_preserved(prediction: Column, reference: Column) -> Column:
    """Are all numbers of the reference in the prediction?"""
    return F.size(F.array_except(numbers(reference), numbers(prediction))) == 0


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(1.0))


def common_prefix_share(a: Column, b: Column) -> Column:
    """The characters that two texts have in common at their start, over the length of the shorter one; 0
    where that is empty. The length is found by bisection on equal heads, so it costs a few comparisons."""
    n = F.least(F.length(a), F.length(b))
    step = lambda s, half: F.when(F.substr(a, F.lit(1), s + half) == F.substr(b, F.lit(1), s + half), s + half).otherwise(s)
    halves = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: (F.lit(float(1 << 30)) / F.pow(F.lit(2.0), i)).cast("int"))
    found = F.aggregate(halves, F.lit(0), lambda s, half: F.when(s + half <= n, step(s, half)).otherwise(s))
    return F.when(n > 0, found / n).otherwise(F.lit(0.0))


def diversity(tokens: Column) -> Column:
    return F.when(F.size(tokens) > 0, F.size(F.array_distinct(tokens)) / F.size(tokens)).otherwise(F.lit(0.0))


def windows(text: Column, n: int) -> Column:
    """All substrings of n characters, in one pass (substr would count from the start each time)."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))


def character_grams(text: Column, n: int = 4) -> Column:
    """The set of character n-grams; a shorter text is its own gram, an empty one has none."""
    return F.when(text == "", F.array().cast("array<string>")).when(F.length(text) <= n, F.array(text)).otherwise(F.array_distinct(windows(text, n)))


def synthetic_variant(text: Column, selector: Column, stop: str = " ।") -> Column:
    """The struct (text, method) of one of three deterministic variants."""
    # The names of the methods.
    own, end = words(text), r"[।?!.,]+$"
    at = selector % F.greatest(F.size(own) - 1, F.lit(1))
    joined = F.array_join(F.concat(F.slice(own, 1, at.cast("int")), F.array(F.concat(F.get(own, at.cast("int")), F.get(own, (at + 1).cast("int")))), F.slice(own, (at + 3).cast("int"), F.size(own))), " ")
    pick = lambda value, name: F.struct(value.alias("text"), F.lit(name).alias("method"))
    return (
        F.when(selector % 3 == 0, pick(F.when(text.rlike(end), F.trim(F.regexp_replace(text, end, ""))).otherwise(F.concat(text, F.lit(stop))), "terminal_punctuation_variant"))
        .when((selector % 3 == 1) & (F.size(own) >= 3), pick(joined, "single_safe_boundary_join"))
        .otherwise(pick(F.concat(F.lit("“"), text, F.lit("”")), "quote_and_dash_typography_variant"))
    )


def _noisy(units: list[str], family: str, severity: float, draw: random.Random) -> str:
    """Exactly max(1, round(severity * graphemes with a letter or mark)) edits, as far as there are places for them."""
    letters = [i for i, u in enumerate(units) if regex.search(r"[\p{L}\p{M}]", u)]
    wanted = max(1, round(len(letters) * severity)) if letters and severity > 0 else 0
    if family == "deletion":
        places = set(draw.sample(letters, min(wanted, len(letters))))
        return "".join(u for i, u in enumerate(units) if i not in places).strip() if wanted else "".join(units)
    if family == "swap":
        known, places = set(letters), set()
        for i in draw.sample(letters, len(letters)):
            if len(places) < 2 * wanted and i + 1 in known and not {i, i + 1} & places:
                places |= {i, i + 1}
                units[i : i + 2] = units[i + 1], units[i]
    elif family == "whitespace":  # at a gap between two graphemes: a blank is taken out, or put in where there is none
        for i in sorted(draw.sample(range(1, len(units)), min(wanted, len(units) - 1)) if wanted else [], reverse=True):
            blank = next((k for k in (i - 1, i) if units[k].isspace()), None)
            units[i if blank is None else blank : i if blank is None else blank + 1] = [" "] if blank is None else []
    else:
        raise ValueError(f"unknown family {family}")
    return "".join(units).strip() if wanted else "".join(units)


def perturbed(text: Column, family: Column, severity: Column, seed: Column) -> Column:
    """Grapheme deletion, swaps of neighbours or white-space noise, drawn from the seed; same seed, same text."""

    @F.pandas_udf(StringType())
    def run(text: pd.Series, family: pd.Series, severity: pd.Series, seed: pd.Series) -> pd.Series:
        rows = zip(text, family, severity, seed)
        return pd.Series([None if t is None else _noisy(regex.findall(r"\X", t), f, s, random.Random(int(k))) for t, f, s, k in rows], dtype="object")

    return run(text, family, severity, seed)
