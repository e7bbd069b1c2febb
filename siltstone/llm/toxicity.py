"""Toxicity by a weighted finite-state pattern grammar over clauses.

A text is cut into clauses. A lexicon reads each word as a symbol: insult word (I), threat verb (V),
intent (W), target (Y), negation (N), reported speech (R) or other (o). Five transducers rewrite and
weigh the symbols, each reading what the one before wrote:

1. negation: insults and threats among the `scope` words after a negation count less;
2. reported speech: so does the rest of its clause;
3. insult: an insult word as such, more in a run of them, and more as what is said of a target
   ("you are such a ..."): target, up to three other words, insult;
4. threat: a verb alone counts half, after an intent more, and the pattern intent, verb, target
   within a few words makes the target count too;
5. target: a clause with a target before counts more, and a target right after an insult or a verb
   is an address (A) with a weight of its own.

They are composed once into a single machine; running it over a clause gives the clause's weight,
and only clauses in which it matches count. The score is a calibrated (logistic) function of the
total, the strongest clause, the number of matched clauses and their density. Clauses without an
insult word or threat verb can't match, so one Aho-Corasick pass finds those that may.

The classes are learned from labels. Toxic words, and stems of three words or more, are those with
more different surroundings (the words on either side) in toxic than in clean texts by `odds`:
passages that are copied, wholly or nearly, count once so, and no text is left out. One that follows
an intent in a third of its uses is a threat verb, the others are insult words. Words that stand
before toxic words mostly in clean texts are added to the negations (near) and the reports (further
off), words that seldom stand elsewhere to the targets. The seeds of these closed classes are lists.

The fit takes `sample` labelled rows of each class at most, chosen by hash of the id, each of them
whole: half for learning, half for calibration. Texts are read in tasks; counts of words that pass
the thresholds, and four numbers for each calibration text, reach the driver.

Defined cases: null and empty texts, and texts without a match, get the score of zero terms; null or
unknown labels teach nothing; with fewer than 8 texts of a class every score is the share of toxic
labels (0 without any); repeated rows each get their row; very long texts and clauses cost time in
proportion; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import calibration, class_weights, fold, labelled, logistic
from .shared import strings, table, text_rows

SYMBOLS = "IVWYNRo"
TOXIC = "IV"
WRITTEN = SYMBOLS + "A"
INTENTS = ["will", "gonna", "going", "shall", "i'll", "we'll", "werde", "werden", "wollen", "vais", "allons", "voy", "vamos"]
TARGETS = ["you", "your", "yourself", "they", "them", "du", "dich", "ihr", "euch", "tu", "toi", "vous", "usted", "ustedes", "vosotros"]
NEGATIONS = ["not", "no", "never", "isn't", "aren't", "nicht", "kein", "keine", "nie", "pas", "jamais", "nunca", "jamás"]
REPORTS = ["said", "says", "called", "quoted", "wrote", "sagte", "nannte", "schrieb", "disait", "appelé", "écrit", "dijo", "llamó", "escribió"]
SEEDS = {"W": INTENTS, "Y": TARGETS, "N": NEGATIONS, "R": REPORTS}
WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
ENDS = ".,;:!?\n"
END = re.compile(r"[.,;:!?\n]")


@dataclass(frozen=True)
class Transducer:
    """A sequential transducer: (state, symbol) to (next state, symbol written, weight)."""

    start: object
    arcs: dict

    def then(self, other: Transducer) -> Transducer:
        """The composition: other reads what this one writes; weights multiply."""
        start, arcs, todo = (self.start, other.start), {}, [(self.start, other.start)]
        seen = {start}
        while todo:
            a, b = state = todo.pop()
            for symbol in SYMBOLS:
                a2, middle, u = self.arcs[a, symbol]
                b2, out, v = other.arcs[b, middle] if (b, middle) in other.arcs else (b, middle, 1.0)
                arcs[state, symbol] = ((a2, b2), out, u * v)
                if (a2, b2) not in seen:
                    seen.add((a2, b2))
                    todo.append((a2, b2))
        return Transducer(start, arcs)


def machine(start, states, step) -> Transducer:
    return Transducer(start, {(q, s): step(q, s) for q in states for s in WRITTEN})


def negation(scope: int = 3, weight: float = 0.2) -> Transducer:
    """The state is how many words the negation still reaches."""
    return machine(0, range(scope + 1), lambda q, s: (scope, "o", 1.0) if s == "N" else (max(0, q - 1), s, weight if q and s in TOXIC else 1.0))


def reported(weight: float = 0.3) -> Transducer:
    return machine(0, (0, 1), lambda q, s: (1, "o", 1.0) if s == "R" else (q, s, weight if q and s in TOXIC else 1.0))


def insulting(reach: int = 3, said_of: float = 1.5, run: float = 1.25) -> Transducer:
    """State n > 0: a target was read and its predicate may begin within n words; -1: in a run of insults."""

    def step(q, s):
        if s == "I":
            return (-1, s, said_of if q > 0 else run if q < 0 else 1.0)
        if s == "Y":
            return (reach, s, 1.0)
        return (max(0, q - 1) if q > 0 else 0, s, 1.0)

    return machine(0, range(-1, reach + 1), step)


def threatening(reach: int = 3, bare: float = 0.5, meant: float = 1.5) -> Transducer:
    """States: (what was read, words it still reaches); an intent reaches a verb, a verb its target."""

    def step(q, s):
        kind, left = q
        if s == "W":
            return (("intent", reach), "o", 1.0)
        if s == "V":
            return (("threat", reach), s, meant) if kind == "intent" else (("verb", 0), s, bare)
        if s == "Y" and kind == "threat":
            return (("", 0), "A", meant)
        return ((kind, left - 1) if left > 1 else ("", 0), s, 1.0)

    return machine(("", 0), [("", 0), ("verb", 0), *((k, n) for k in ("intent", "threat") for n in range(1, reach + 1))], step)


def targeted(before: float = 1.2, reach: int = 2) -> Transducer:
    """States: (whether a target was read, words in which one would address what was said)."""

    def step(q, s):
        seen, left = q
        if s in TOXIC:
            return ((seen, reach), s, before if seen else 1.0)
        if s == "Y":
            return ((1, 0), "A" if left else "o", 1.0)
        return ((1 if s == "A" else seen, max(0, left - 1)), s, 1.0)

    return machine((0, 0), [(a, n) for a in (0, 1) for n in range(reach + 1)], step)


STEPS = {"negation": negation, "reported": reported, "insult": insulting, "threat": threatening, "target": targeted}


def grammar(without: tuple[str, ...] = ()) -> Transducer:
    """The composed machine; `without` leaves transducers out, to see what each adds."""
    out = machine(0, (0,), lambda q, s: (0, s, 1.0))
    for name, step in STEPS.items():
        if name not in without:
            out = out.then(step())
    return out


@dataclass
class Machine:
    """A composed transducer as lists over state * symbols + symbol."""

    to: list[int]
    wrote: list[str]
    weight: list[float]

    @classmethod
    def of(cls, t: Transducer) -> Machine:
        states = {t.start: 0}
        for state, _ in t.arcs:
            states.setdefault(state, len(states))
        arcs = [t.arcs[state, s] for state in states for s in SYMBOLS]
        return cls([states[a[0]] * len(SYMBOLS) for a in arcs], [a[1] for a in arcs], [a[2] for a in arcs])


@dataclass
class Lexicon:
    words: dict[str, tuple[str, float]]
    stems: dict[str, tuple[str, float]]
    address: float = 1.0  # the weight of a target that is addressed
    memo: dict[str, tuple[int, float]] = field(default_factory=dict, repr=False)
    limit: int = 200_000

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_finder"} | {"memo": {}}

    def read(self, word: str) -> tuple[int, float]:
        """The number of the word's symbol and its weight."""
        found = self.memo.get(word)
        if found is None:
            symbol, weight = self.words.get(word) or next((self.stems[word[:k]] for k in range(min(len(word), 12), 3, -1) if word[:k] in self.stems), ("o", 0.0))
            found = (SYMBOLS.index(symbol), weight)
            if len(self.memo) >= self.limit:
                self.memo.clear()
            self.memo[word] = found
        return found

    def finder(self):
        """An automaton of the toxic words and stems, or None where there are none."""
        if "_finder" not in self.__dict__:
            found = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for x, (symbol, _) in [*self.words.items(), *self.stems.items()]:
                if symbol in TOXIC:
                    found.add_word(x)
            found.make_automaton()
            self.__dict__["_finder"] = found if len(found) else None
        return self.__dict__["_finder"]

    def clauses(self, text: str):
        """The words of each clause that may have a toxic word; text is in lower case."""
        finder = self.finder()
        if finder is None or not text:
            return
        done = 0
        for last, length in finder.iter(text):
            start = last - length + 1
            if start < done or start and text[start - 1].isalnum():
                continue
            left = max(done, 1 + max(text.rfind(c, done, start) for c in ENDS))
            end = END.search(text, start)
            done = end.start() if end else len(text)
            yield WORD.findall(text, left, done)


def weighed(text: str, lexicon: Lexicon, steps: Machine) -> list[tuple[float, list[str]]]:
    """(weight, matched words) of each clause that the grammar matches."""
    out, read, to, wrote, factor = [], lexicon.read, steps.to, steps.wrote, steps.weight
    for words in lexicon.clauses(text.lower()):
        state, weight, matched = 0, 0.0, []
        for word in words:
            symbol, own = read(word)
            arc = state + symbol
            state, symbol = to[arc], wrote[arc]
            if symbol in TOXIC:
                weight += own * factor[arc]
                matched.append(word)
            elif symbol == "A" and matched:
                weight += lexicon.address * factor[arc]
        if matched:
            out.append((weight, matched))
    return out


@dataclass
class Model:
    lexicon: Lexicon | None
    steps: Machine
    scale: np.ndarray
    weights: np.ndarray
    default: float

    def terms(self, text: str) -> list[float]:
        found = weighed(text, self.lexicon, self.steps)
        if not found:
            return [0.0] * 4
        total = sum(w for w, _ in found)
        return [math.log1p(total), math.log1p(max(w for w, _ in found)), math.log1p(len(found)), total / (20 + text.count(" "))]

    def score(self, texts: list[str]) -> np.ndarray:
        if self.lexicon is None:
            return np.full(len(texts), self.default)
        x = np.array([self.terms(t) for t in texts]).reshape(-1, 4) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def surroundings(rows: DataFrame) -> DataFrame:
    """(word, a, b): how many different surroundings a word of three letters or more has in toxic
    and in clean texts."""

    def run(batches):
        for batch in batches:
            for raw, label in zip(strings(batch.column(0)), batch.column(1).to_pylist()):
                words = WORD.findall(bytes(raw).decode().lower())
                around = zip(["", *words], words, [*words[1:], ""])
                found = list({(w, zlib.crc32(f"{a} {z}".encode())) for a, w, z in around if len(w) >= 3})
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([c for _, c in found], pa.int64()), pa.array([label] * len(found), pa.int32())], ["word", "around", "label"])

    found = rows.select("text", "label").mapInArrow(run, "word string, around long, label int").distinct()
    return found.groupBy("word").agg(F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("label") == 0).alias("b"))


def toxic_words(rows: DataFrame, texts: int, least: int, share: float, odds: float) -> Lexicon:
    """A lexicon of the seeds and of insult words."""
    words = surroundings(rows).cache()
    totals = words.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    stem = words.select("word", "a", "b", F.explode(F.sequence(F.lit(4), F.least(F.lit(8), F.greatest(F.lit(4), F.length("word"))))).alias("n")).filter(F.length("word") >= F.col("n"))
    stems = stem.groupBy(F.substring("word", 1, F.col("n")).alias("x")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count_if(F.col("a") > 0).alias("kinds")).filter("kinds >= 3").select(F.lit("stem").alias("kind"), "x", "a", "b")
    both = words.select(F.lit("word").alias("kind"), F.col("word").alias("x"), "a", "b").union(stems)
    lift = F.log((F.col("a") + 0.5) / (totals.a or 1)) - F.log((F.col("b") + 0.5) / (totals.b or 1))
    # each needs `share` of as many surroundings as there are toxic texts, which bounds their number
    found = both.filter(F.col("a") >= max(least, share * texts)).withColumn("lift", lift).filter(F.col("lift") >= odds).collect()
    lexicon = Lexicon({}, {})
    for symbol, seeds in SEEDS.items():
        lexicon.words.update((w, (symbol, 0.0)) for w in seeds)
    share_a = (totals.a or 0) / max(1, (totals.a or 0) + (totals.b or 0))

    def evidence(r) -> float:
        """The log likelihood ratio: wide stems come before the words that they cover."""
        return sum(n * math.log(n / ((r.a + r.b) * p)) for n, p in ((r.a, share_a), (r.b, 1 - share_a)) if n)

    for r in sorted(found, key=lambda r: (-evidence(r), -len(r.x), r.kind == "stem", r.x)):
        seed = r.x in lexicon.words and lexicon.words[r.x][0] not in TOXIC
        if not seed and not any(r.x[:k] in lexicon.stems for k in range(4, len(r.x) + 1)):
            (lexicon.words if r.kind == "word" else lexicon.stems)[r.x] = ("I", r.lift)
    words.unpersist()
    return lexicon


def add_classes(lexicon: Lexicon, rows: DataFrame, least: int, odds: float) -> None:
    """Threat verbs, and cues beside the seeds, by what stands around toxic words."""
    if lexicon.finder() is None:
        return

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for raw, label in zip(strings(batch.column(0)), batch.column(1).to_pylist()):
                for words in lexicon.clauses(bytes(raw).decode().lower()):
                    symbols = [SYMBOLS[lexicon.read(w)[0]] for w in words]
                    at = [i for i, s in enumerate(symbols) if s in TOXIC]
                    for i in at:
                        counts["use", _entry(lexicon, words[i]), label] += 1
                        if "W" in symbols[max(0, i - 3) : i]:
                            counts["meant", _entry(lexicon, words[i]), label] += 1
                    for i in range(at[-1] if at else 0):
                        if symbols[i] == "o":
                            nearest = next(j for j in at if j > i) - i
                            counts["near" if nearest <= 3 else "far", words[i], label] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array([k[2] for k in counts], pa.int32()), pa.array(counts.values(), pa.int64())], ["role", "x", "label", "n"])

    found = rows.select("text", "label").mapInArrow(run, "role string, x string, label int, n long")
    sums = found.groupBy("role", "x").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("b")).filter(F.col("a") + F.col("b") >= least).collect()
    by = {(r.role, r.x): (r.a, r.b) for r in sums}
    uses = [sum(v[k] for (role, _), v in by.items() if role == "use") for k in (0, 1)]
    for (role, x), (a, b) in by.items():
        if role == "use" and by.get(("meant", x), (0, 0))[0] * 3 >= a > 0:
            part = lexicon.words if x in lexicon.words else lexicon.stems
            part[x] = ("V", part[x][1])
        if role in ("near", "far") and b >= least and math.log((b + 0.5) / (uses[1] + 1)) - math.log((a + 0.5) / (uses[0] + 1)) >= odds:
            lexicon.words.setdefault(x, ("N" if role == "near" else "R", 0.0))
    lexicon.memo.clear()


def _entry(lexicon: Lexicon, word: str) -> str:
    """The word or stem through which the lexicon reads a word."""
    return word if word in lexicon.words else next(word[:k] for k in range(min(len(word), 12), 3, -1) if word[:k] in lexicon.stems)


def learn(rows: DataFrame, texts: int, least: int = 6, share: float = 0.01, odds: float = 2.5) -> Lexicon:
    """The lexicon of (text, label) rows with so many toxic texts."""
    lexicon = toxic_words(rows, texts, least, share, odds)
    add_classes(lexicon, rows, least, odds)
    return lexicon


def fit(docs: DataFrame, labels: DataFrame, held_out, column: str = "toxic", sample: int = 3000, without: tuple[str, ...] = ()) -> Model:
    """The model; rows where held_out holds teach nothing."""
    rows, counts = labelled(docs, labels, column, held_out, sample)
    sizes = {r.label: (r.n, r.half) for r in rows.groupBy("label").agg(F.count("*").alias("n"), F.count_if("half").alias("half")).collect()}
    steps = Machine.of(grammar(without))
    if min(sizes.get(k, (0, 0))[0] for k in (0, 1)) < 8:
        return Model(None, steps, np.ones(4), np.zeros(0), counts.get(1, 0) / max(1, sum(counts.values())))
    model = Model(learn(rows.filter("half"), sizes[1][1]), steps, np.ones(4), np.zeros(0), 0.0)
    x, y = calibration(rows.filter(~F.col("half")), lambda t: model.terms(bytes(t).decode()), 4)
    model.scale = x.std(axis=0) + 1e-9
    model.weights = logistic(x / model.scale, y, class_weights(y, counts), penalty=0.1)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row; the whole text counts."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = (bytes(t).decode() for t in strings(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([shipped.value.score([t]) for t in texts] or [np.zeros(0)]), pa.float64())], ["doc_id", "score"])

    return text_rows(docs).mapInArrow(run, "doc_id long, score double")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), fold(5, 0)
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels"), held))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
