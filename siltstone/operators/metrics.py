"""Classification and text metrics from sufficient statistics that combine before shuffling."""

from __future__ import annotations

from collections import Counter

import math
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType


def confusion(df: DataFrame, label: str, prediction: str, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def per_class(counts: DataFrame, by: list[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of each class in labels or predictions; 0 for 0/0."""
    by = list(by)
    hit = counts.filter("label = prediction").select(*by, F.col("label").alias("class"), F.col("n").alias("tp"))
    support = counts.groupBy(*by, F.col("label").alias("class")).agg(F.sum("n").alias("support"))
    said = counts.groupBy(*by, F.col("prediction").alias("class")).agg(F.sum("n").alias("said"))
    j = support.join(said, [*by, "class"], "full").join(hit, [*by, "class"], "left").na.fill(0, ["support", "said", "tp"])
    part = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return j.select(*by, "class", part(F.col("tp"), F.col("said")).alias("precision"), part(F.col("tp"), F.col("support")).alias("recall"), part(2 * F.col("tp"), F.col("said") + F.col("support")).alias("f1"), "support", "said", "tp")


def summary(counts: DataFrame, by: list[str] = ()) -> DataFrame:
    """Accuracy, balanced accuracy, macro and weighted F1, worst F1 of present classes and MCC."""
    c = per_class(counts, by)
    present = F.col("support") > 0
    s = c.groupBy(*by).agg(
        F.sum("support").alias("n"), F.sum("tp").alias("tp"), F.avg(F.when(present, F.col("recall"))).alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"), F.avg(F.when(present, F.col("f1"))).alias("present_f1"),
        F.min(F.when(present, F.col("f1"))).alias("worst_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
        F.sum(F.col("said").cast("double") * F.col("support")).alias("cross"), F.sum(F.col("said").cast("double") * F.col("said")).alias("pp"), F.sum(F.col("support").cast("double") * F.col("support")).alias("tt"),
    )
    n = F.col("n").cast("double")
    below = F.sqrt((n * n - F.col("pp")) * (n * n - F.col("tt")))
    return s.select(*by, "n", (F.col("tp") / n).alias("accuracy"), "balanced_accuracy", "macro_f1", "present_f1", "worst_f1", "weighted_f1", F.when(below > 0, (F.col("tp") * n - F.col("cross")) / below).otherwise(F.lit(0.0)).alias("mcc"))


def calibration_error(df: DataFrame, confidence: str, correct: str, bins: int = 15, by: list[str] = ()) -> DataFrame:
    """Expected calibration error over bins (low, high]; a confidence of 0 is in no bin."""
    edges = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    b = df.filter(F.col(confidence) > 0).withColumn("_b", F.size(F.filter(edges, lambda e: e < F.col(confidence))))
    g = b.groupBy(*by, "_b").agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("a"), F.avg(confidence).alias("c"))
    total = df.groupBy(*by).agg(F.count("*").alias("all"))
    e = g.groupBy(*by).agg(F.sum(F.col("n") * F.abs(F.col("a") - F.col("c"))).alias("e"))
    return (e.join(total, list(by)) if by else e.crossJoin(F.broadcast(total))).select(*by, (F.col("e") / F.col("all")).alias("ece"))


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp((x - top) / temperature))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def scaled_loss(logits: Column, label: Column, temperature: float) -> Column:
    """The negative log likelihood of the label under the softmax of logits / temperature."""
    z = F.transform(logits, lambda x: x / temperature)
    top = F.array_max(z)
    return top + F.log(F.aggregate(z, F.lit(0.0), lambda a, y: a + F.exp(y - top))) - F.get(z, label)


def fit_temperature(df: DataFrame, logits: str, label: str, low: float = -4.0, high: float = 4.0, points: int = 17, rounds: int = 6) -> tuple[float, float]:
    """The temperature exp(x), x in [low, high], of least mean loss of the labels, and that loss. Each round is
    one pass that takes the loss at `points` places; the next looks between the neighbours of the best. The
    loss has one minimum, so none is passed by."""
    rows = df.filter(F.col(logits).isNotNull() & F.col(label).isNotNull())
    for _ in range(rounds):
        step = (high - low) / (points - 1)
        places = [low + i * step for i in range(points)]
        losses = [F.avg(scaled_loss(F.col(logits), F.col(label), math.exp(x))).alias(f"l{i}") for i, x in enumerate(places)]
        found = rows.agg(*losses).first()
        if found[0] is None:
            raise ValueError("no rows to fit on")
        best = min(range(points), key=lambda i: found[i])
        low, high = places[max(0, best - 1)], places[min(points - 1, best + 1)]
    return math.exp(places[best]), found[best]


def tempered(probabilities: Column, temperature: float) -> Column:
    """Probabilities to the power 1/T, renormalized."""
    return softmax(F.transform(probabilities, lambda p: F.log(F.greatest(p, F.lit(1e-12)))), temperature)


def blended(a: Column, b: Column, weight: float) -> Column:
    mix = F.zip_with(a, b, lambda x, y: weight * x + (1 - weight) * y)
    return F.transform(mix, lambda x: x / F.aggregate(mix, F.lit(0.0), lambda s, y: s + y))


def restricted(probabilities: Column, allowed: list[int]) -> Column:
    """The probabilities of allowed classes, renormalized."""
    kept = F.array(*[F.get(probabilities, F.lit(i)) for i in allowed])
    return F.transform(kept, lambda x: x / F.aggregate(kept, F.lit(0.0), lambda s, y: s + y))


def argmax(values: Column) -> Column:
    return (F.array_position(values, F.array_max(values)) - 1).cast("long")


def brier(probabilities: Column, label: Column) -> Column:
    """Sum of squared differences to the one-hot label."""
    return F.aggregate(F.transform(probabilities, lambda p, i: F.pow(p - F.when(i == label, 1.0).otherwise(0.0), 2)), F.lit(0.0), lambda a, x: a + x)


def symmetric_kl(a: Column, b: Column) -> Column:
    p, q = softmax(a), softmax(b)
    each = F.zip_with(p, q, lambda x, y: (x - y) * (F.log(x) - F.log(y)))
    return F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / 2


CHAR_ORDER, WORD_ORDER = 6, 2


def _grams(units, n: int) -> Counter:
    return Counter(tuple(units[i : i + n]) if not isinstance(units, str) else units[i : i + n] for i in range(len(units) - n + 1))


def _words(text: str) -> list[str]:
    """Words with a leading or trailing ASCII punctuation mark split off, as chrF++ counts them."""
    marks, out = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"), []
    for w in text.split():
        if len(w) > 1 and w[-1] in marks:
            out += [w[:-1], w[-1]]
        elif len(w) > 1 and w[0] in marks:
            out += [w[0], w[1:]]
        else:
            out.append(w)
    return out


@F.pandas_udf(ArrayType(LongType()))
def chrf_statistics(hypothesis: pd.Series, reference: pd.Series) -> pd.Series:
    """For each order of characters, then words: n-grams of the hypothesis, of the reference, in both."""
    out = []
    for h, r in zip(hypothesis, reference):
        h, r = h or "", r or ""
        row = []
        for x, y, orders in (("".join(h.split()), "".join(r.split()), CHAR_ORDER), (_words(h), _words(r), WORD_ORDER)):
            for n in range(1, orders + 1):
                a, b = _grams(x, n), _grams(y, n)
                total = sum(b.values())
                row += [sum(a.values()) if total else 0, total, sum((a & b).values())]
        out.append(row)
    return pd.Series(out)


def vector_sum(column: str, size: int) -> Column:
    """Element-wise sum of arrays, as one array."""
    return F.array(*[F.sum(F.get(F.col(column), F.lit(i))) for i in range(size)])


def chrf_score(stats: Column, beta: float = 2.0) -> Column:
    """chrF++ of summed statistics, 0 to 100: the F of mean precision and recall over orders that occur."""
    orders = [(F.get(stats, F.lit(3 * i)), F.get(stats, F.lit(3 * i + 1)), F.get(stats, F.lit(3 * i + 2))) for i in range(CHAR_ORDER + WORD_ORDER)]
    valid = F.array(*[F.when((h > 0) & (r > 0), F.struct((m / h).alias("p"), (m / r).alias("r"))) for h, r, m in orders])
    valid = F.filter(valid, lambda x: x.isNotNull())
    mean = lambda f: F.aggregate(valid, F.lit(0.0), lambda a, x: a + x[f]) / F.size(valid)
    p, r = mean("p"), mean("r")
    return F.when((F.size(valid) > 0) & (p + r > 0), 100 * (1 + beta * beta) * p * r / (beta * beta * p + r)).otherwise(F.lit(0.0))


def view_scores(df: DataFrame, run: list[str], label: str, views: dict[str, str], target: str) -> DataFrame:
    """(run, view, n, macro_chrf, worst_chrf): chrF++ of several candidate columns against the target, by label
    from summed statistics, then its mean and least over the labels of a run. One pass, a row a view."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("view"), F.col(c).alias("text")) for name, c in views.items()]))
    rows = df.select(*run, F.col(label).alias("_label"), F.col(target).alias("_target"), each.alias("v")).select(*run, "_label", "_target", "v.*")
    by_label = rows.withColumn("s", chrf_statistics("text", "_target")).groupBy(*run, "view", "_label").agg(F.count("*").alias("n"), vector_sum("s", 3 * (CHAR_ORDER + WORD_ORDER)).alias("s"))
    scored = by_label.withColumn("chrf", chrf_score(F.col("s")))
    return scored.groupBy(*run, "view").agg(F.sum("n").alias("n"), F.avg("chrf").alias("macro_chrf"), F.min("chrf").alias("worst_chrf"))


BLEU_ORDER = 4


def _masks(units) -> dict:
    """The places of each unit, as the bits of a number."""
    out: dict = {}
    for i, x in enumerate(units):
        out[x] = out.get(x, 0) | 1 << i
    return out


def _advance(masks: dict, size: int, units, state: tuple[int, int, int], most: int | None = None) -> tuple[int, int, int] | None:
    """The state of the bit-parallel edit distance (Myers, Hyyrö) to `size` units after more units of
    the other side: bits where the column goes up and down, and its last value. None once that
    cannot end at `most` or less."""
    up, down, score = state
    full, last, left = (1 << size) - 1, 1 << size - 1, len(units)
    for x in units:
        same = masks.get(x, 0)
        zero = (((same & up) + up) ^ up) | same | down
        plus, minus = (down | ~(zero | up)) & full, zero & up
        if plus & last:
            score += 1
        elif minus & last:
            score -= 1
        plus, minus = plus << 1 | 1, minus << 1
        up, down = (minus | ~(zero | plus)) & full, plus & zero & full
        left -= 1
        if most is not None and score - left > most:
            return None
    return up, down, score


def _distance(a, b) -> int:
    """Edit distance of whole sequences, a machine word of one side at a time."""
    if len(a) > len(b):
        a, b = b, a
    return _advance(_masks(b), len(b), a, ((1 << len(b)) - 1, 0, len(b)))[2] if a else len(b)


@F.pandas_udf(ArrayType(LongType()))
def edit_statistics(hypothesis: pd.Series, reference: pd.Series) -> pd.Series:
    """Character edits, characters, word edits, words, hypothesis words, then matches and totals of
    1- to 4-grams: enough for CER, WER and BLEU."""
    out = []
    for h, r in zip(hypothesis, reference):
        h, r = h or "", r or ""
        hw, rw = h.split(), r.split()
        row = [_distance(h, r), len(r), _distance(hw, rw), len(rw), len(hw)]
        for n in range(1, BLEU_ORDER + 1):
            a, b = _grams(hw, n), _grams(rw, n)
            row += [sum((a & b).values()), sum(a.values())]
        out.append(row)
    return pd.Series(out)


def _rows(own: list, ref: list) -> np.ndarray:
    """Edit distances of every prefix of own to every prefix of ref."""
    ids: dict = {}
    r, at = np.array([ids.setdefault(x, len(ids)) for x in ref]), np.arange(len(ref) + 1)
    out = np.empty((len(own) + 1, len(ref) + 1), np.int32)
    out[0] = at
    for i, x in enumerate(own):
        row = out[i] + 1
        np.minimum(row[1:], out[i][:-1] + (r != ids.get(x, -1)), out=row[1:])
        out[i + 1] = np.minimum.accumulate(row - at) + at
    return out


def _best_move(own: list, ref: list, places: dict, masks: dict, now: int, most: int) -> tuple[int, list]:
    """The move that saves most, of equal ones the one of fewest words, then the first by place.

    Moves that cannot save enough aren't tried: taking n words out and putting them back changes a
    distance by n each, and taking them out alone is known from the distances of both ends.
    """
    size, best = len(ref), (1, None)  # a move costs one, so it has to save two
    ends = _rows(own, ref)
    tails = _rows(own[::-1], ref[::-1])[::-1, ::-1]
    states = [((1 << size) - 1, 0, size)]
    for x in own:
        states.append(_advance(masks, size, [x], states[-1]))
    for n in range(min(10, len(own), size), 0, -1):
        if min(2 * n, most) < max(best[0], 2):
            break
        without = (ends[: len(own) - n + 1] + tails[n:]).min(axis=1)
        level = best[0] - (best[1] is not None)  # fewer words win at equal savings
        for i in range(len(own) - n + 1):
            if min(now - int(without[i]) + n, most) <= level:
                continue
            block = own[i : i + n]
            found = places.get(tuple(block))
            if not found or block == ref[i : i + n]:
                continue
            for j in found:
                if j == i or j > len(own) - n or min(2 * min(n, abs(i - j)), now - int(without[i]) + n, most) <= level:
                    continue
                k = min(i, j)
                rest = block + own[j:i] + own[i + n :] if j < i else own[i + n : j + n] + block + own[j + n :]
                end = _advance(masks, size, rest, states[k], now - level - 1)
                if end and now - end[2] > level:
                    level = now - end[2]
                    best = (level, own[:k] + rest)
    return best if best[1] is not None else (0, own)


@F.pandas_udf(ArrayType(LongType()))
def shift_statistics(hypothesis: pd.Series, reference: pd.Series) -> pd.Series:
    """Edits of words where moving a block counts as one, and reference words: enough for TER.

    Blocks of up to 10 words that the reference has are moved greedily, the move that saves most
    first, as long as one saves more than it costs.
    """
    out = []
    for h, r in zip(hypothesis, reference):
        own, ref, moves = (h or "").split(), (r or "").split(), 0
        places: dict = {}
        for n in range(1, min(10, len(own)) + 1):
            for j in range(len(ref) - n + 1):
                places.setdefault(tuple(ref[j : j + n]), []).append(j)
        masks, now = _masks(ref), _distance(own, ref)
        a, b = Counter(own), Counter(ref)
        least = max((a - b).total(), (b - a).total())  # moves leave the words as they are
        while now - least > 1:
            saved, moved = _best_move(own, ref, places, masks, now, now - least)
            if saved <= 1:
                break
            own, now, moves = moved, now - saved, moves + 1
        out.append([now + moves, len(ref)])
    return pd.Series(out)


def bleu_score(stats: Column) -> Column:
    """Corpus BLEU, 0 to 100, of summed statistics; zero matches of an order count as half of the one before."""
    g = lambda i: F.get(stats, F.lit(i)).cast("double")
    logs, smooth = F.lit(0.0), F.lit(1.0)
    for n in range(BLEU_ORDER):
        m, t = g(5 + 2 * n), g(6 + 2 * n)
        smooth = F.when(m > 0, smooth).otherwise(smooth * 2)
        logs = logs + F.log(F.when(t <= 0, F.lit(1e-9)).otherwise(F.when(m > 0, m).otherwise(1 / smooth) / t)) / BLEU_ORDER
    penalty = F.when(g(4) >= g(3), F.lit(1.0)).otherwise(F.exp(1 - g(3) / F.greatest(g(4), F.lit(1.0))))
    return F.when(g(4) > 0, 100 * penalty * F.exp(logs)).otherwise(F.lit(0.0))
