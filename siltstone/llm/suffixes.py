"""Suffix-array dedup: removes every byte of a string of `least` bytes that also starts earlier.

1. Sampling. In each window of `least` bytes the least hash of its `seed`-byte strings marks an
   anchor; equal windows have their anchors in the same place, so each window is judged at one
   anchor. Anchors are about one byte in forty.
2. Anchors whose hash occurs once lead nowhere. The others carry the bytes of their windows
   (`least` to twice as many) to the task of their hash.
3. There, the bytes after the anchors are sorted: a suffix array of these places, with the common
   prefixes of neighbours. A stack scan gives its interval tree. Within an interval, the bytes
   before the anchors, read backwards, are scanned in the same way; where they part is where
   the repeat can't be extended to the left. Each such pair of nodes is a maximal repeat with all
   its occurrences, and all but the first occurrence are removed.
4. A document's removed runs are merged and applied to its text; repeats() returns the groups.

Hot anchors: copies of a whole text are settled first by a digest, with a partial aggregate. An
anchor of more than `hot` occurrences gives each of its windows as a row of its own, its SHA-256
digest, dealt by the hash of the window; of equal rows in a task only the first is sent, the
others being removed for certain. So a task gathers `hot` contexts of a hash at most, or one row for a window and task.

Comparisons are of bytes; for hot anchors and whole copies of SHA-256 digests, which no two known texts
share; other hashes only deal out rows. The plan has one text shuffle, which its three readers share.

Defined cases: null texts are empty; texts shorter than `least` keep everything; a row with a
null id keeps everything and removes nothing; repeated rows are one document, each reported; of
one id's different texts the order is that of their digests; ids may be any long; texts longer than
a piece are anchored in pieces, with the same result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Powers, bounded_batches, mixed, strings, table, text_rows, written

_PLACE = 28  # bits of a place within a chunk
_A, _B = Powers(0x9E3779B97F4A7C15), Powers(0xD6E8FEB86659FD93)
_VALUE = mixed(np.arange(1, 257, dtype=np.uint64))
_DIGEST = 255  # stands for the bytes before an anchor where ctx is the digest of one window
CONTEXT = "g long, doc long, at long, ctx binary"
_CONTEXT = pa.schema([("g", pa.int64()), ("doc", pa.int64()), ("at", pa.int64()), ("ctx", pa.binary())])
SPAN = "doc long, start long, stop long"


def rolled(raw: np.ndarray, size: int, powers: Powers) -> np.ndarray:
    """A hash of each `size` bytes."""
    if len(raw) < size:
        return np.zeros(0, np.uint64)
    up, down = powers.get(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUE[raw] * up[:-1], out=total[1:])
    return mixed((total[size:] - total[:-size]) * down[: len(raw) - size + 1])


def anchors(texts: list, least: int, seed: int, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor: its hash, its text's number, and place << 16 | bytes before it << 8 | windows - 1.

    Long texts are cut into pieces of `piece` windows; an anchor at a cut appears once for either side.
    """
    if max(map(len, texts), default=0) <= piece:
        return _anchors(texts, least, seed)
    parts = [(k, at, t[at : at + piece + least - 1]) for k, t in enumerate(texts) for at in range(0, max(1, len(t) - least + 1), piece)]
    found = [(_anchors([t], least, seed), k, at) for k, at, t in parts]
    return tuple(np.concatenate(c) for c in zip(*((h, np.full(len(h), k), packed + (at << 16)) for (h, _, packed), k, at in found)))


def _anchors(texts: list, least: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    if len(raw) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(raw) >= 1 << _PLACE:
        raise ValueError("a chunk is too long")
    hashes = rolled(raw, seed, _A)
    low = (hashes >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(hashes), dtype=np.uint64)
    width, step = least - seed + 1, 1
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < width:
        low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
    place = (low & np.uint64((1 << _PLACE) - 1)).astype(np.int64)  # of each window of the chunk
    first = np.concatenate([[0], np.cumsum(sizes)])
    inside = np.zeros(len(raw) + 1, np.int8)
    whole = sizes >= least
    np.add.at(inside, first[:-1][whole], 1)
    np.add.at(inside, first[1:][whole] - least + 1, -1)
    window = np.flatnonzero(np.cumsum(inside[: len(place)], dtype=np.int8))
    if not len(window):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = place[window]
    begin = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
    count = np.diff(np.append(begin, len(place)))
    at, start = place[begin], window[begin]
    owner = np.searchsorted(first, at, "right") - 1
    packed = ((at - first[owner]) << 16) | ((at - start) << 8) | (count - 1)
    return hashes[at].view(np.int64), owner, packed


def _parts(batches: Iterable[pa.RecordBatch], limit: int = 256 << 10) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of about `limit` bytes of text (the first field of column 1)."""
    for batch in batches:
        texts, at = strings(batch.column(1).field(0)), 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= limit):
                size += len(texts[end])
                end += 1
            yield batch.slice(at, end - at), texts[at:end]
            at = end


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def intervals(prefixes: list[int]) -> list[tuple[int, int, int]]:
    """(common prefix, first, last) of each interval of a suffix array, by a stack scan; prefixes[i]
    is what entries i and i + 1 share."""
    stack, out = [(0, 0)], []
    for i, shared in enumerate([*prefixes, 0]):
        left = i
        while stack[-1][0] > shared:
            value, left = stack.pop()
            out.append((value, left, i))
        if stack[-1][0] < shared:
            stack.append((shared, left))
    return out


def maximal_repeats(before: list[bytes], after: list[bytes], least: int) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes before, bytes after, members) of each maximal repeat of at least `least` bytes around
    the anchors; before is read backwards from the anchor."""
    order = sorted(range(len(after)), key=after.__getitem__)
    prefixes = [common_prefix(after[a], after[b]) for a, b in zip(order, order[1:])]
    rank = {m: i for i, m in enumerate(order)}
    furthest = max(map(len, before))
    for right, lo, hi in intervals(prefixes):
        if right + furthest < least:
            continue
        members = sorted(order[lo : hi + 1], key=before.__getitem__)
        shared = [common_prefix(before[a], before[b]) for a, b in zip(members, members[1:])]
        found = intervals(shared)
        if not shared or min(shared) == 0:
            found.append((0, 0, len(members) - 1))
        for left, a, b in found:
            if left + right < least:
                continue
            group = members[a : b + 1]
            ranks = [rank[m] for m in group]
            if min(prefixes[min(ranks) : max(ranks)]) == right:  # else they all share more to the right
                yield left, right, group


def _count(least: int, seed: int):
    """Distinct anchor hashes of stretches of the input, with their numbers."""

    def run(batches):
        held, size = [], 0

        def out():
            hashes, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(n)], ["h", "n"])

        for _, texts in _parts(batches):
            hashes, _, _ = anchors(texts, least, seed)
            held.append(hashes)
            size += len(hashes)
            if size >= 1 << 19:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return run


def _mark(least: int, seed: int):
    """All anchors."""

    def run(batches):
        for part, texts in _parts(batches):
            hashes, owner, packed = anchors(texts, least, seed)
            docs = part.column(0).to_numpy()[owner] if len(owner) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(docs, pa.int64()), pa.array(packed)], ["h", "doc", "at"])

    return run


def _contexts(least: int, hot: int, every: bool = False, block: int = 50_000):
    """The bytes around repeated anchors. Of equal contexts in a block of rows only the first one is
    sent, unless `every` is asked for; the others are spans already: rows without ctx, from `at` to `g`."""

    def run(batches):
        best: dict[tuple[int, int, bytes], tuple[int, int]] = {}
        spans: list[tuple[int, int, int]] = []

        def put(g: int, doc: int, at: int, ctx: bytes) -> None:
            before = at >> 8 & 255
            key, own = (g, before, ctx, (doc, at) if every else None), (doc, at)
            first = best.get(key)
            if first is None:
                best[key] = own
            elif own != first:
                if own < first:
                    best[key], own = own, first
                start = (own[1] >> 16) - (0 if before == _DIGEST else before)
                spans.append((own[0], start, start + (least if before == _DIGEST else len(ctx))))

        def out():
            rows, certain = list(best.items()), joined(spans)
            columns = [[k[0] for k, _ in rows] + [s[2] for s in certain], [v[0] for _, v in rows] + [s[0] for s in certain], [v[1] for _, v in rows] + [s[1] for s in certain], [k[2] for k, _ in rows] + [None] * len(certain)]
            best.clear()
            spans.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CONTEXT)], schema=_CONTEXT)

        for part, texts in _parts(batches):
            docs, marks = part.column(0).to_pylist(), part.column(2)
            for doc, text, own in zip(docs, texts, marks):
                own = own.values
                if own is None or not len(own):
                    continue
                hashes, ats, counts = (own.field(i).to_numpy() for i in range(3))
                text = bytes(text)
                many = counts > hot
                for h, at in zip(hashes[~many].tolist(), ats[~many].tolist()):
                    start = (at >> 16) - (at >> 8 & 255)
                    put(h, doc, at, text[start : start + (at & 255) + least])
                if many.any():
                    keys = rolled(np.frombuffer(text, np.uint8), least, _B).view(np.int64)
                    for at in ats[many].tolist():
                        start = (at >> 16) - (at >> 8 & 255)
                        for s in range(start, start + (at & 255) + 1):
                            put(int(keys[s]), doc, s << 16 | _DIGEST << 8, hashlib.sha256(text[s : s + least]).digest())
                if len(best) + len(spans) >= block:
                    yield out()
        if best or spans:
            yield out()

    return run


def joined(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans (doc, start, stop) with those that touch made one."""
    out: list[tuple[int, int, int]] = []
    for doc, start, stop in sorted(spans):
        if out and out[-1][0] == doc and start <= out[-1][2]:
            out[-1] = (doc, out[-1][1], max(stop, out[-1][2]))
        else:
            out.append((doc, start, stop))
    return out


def judged(rows: list[tuple[int, int, bytes]], least: int) -> list[tuple[int, int, int]]:
    """Spans (doc, start, stop) of later occurrences among contexts (doc, at, ctx) of one hash: one
    for a context at most, as all repeats around an anchor overlap in it."""
    classes: dict[tuple[int, bytes], tuple[int, int]] = {}
    spans = []
    for doc, at, ctx in rows:
        before = at >> 8 & 255
        key, own = (before, ctx), (doc, (at >> 16))
        first = classes.setdefault(key, own)
        if first != own:
            if own < first:
                classes[key], own = own, first
            spans.append((own[0], own[1], own[1] + least) if before == _DIGEST else (own[0], own[1] - before, own[1] - before + len(ctx)))
    contexts = [(b, c, place) for (b, c), place in classes.items() if b != _DIGEST]
    if len(contexts) > 1:
        places = [x[2] for x in contexts]
        wide: dict[int, tuple[int, int]] = {}
        for left, right, group in maximal_repeats([c[:b][::-1] for b, c, _ in contexts], [c[b:] for b, c, _ in contexts], least):
            first = min(places[m] for m in group)
            for m in group:
                if places[m] != first:
                    l, r = wide.get(m, (0, 0))
                    wide[m] = (max(l, left), max(r, right))
        spans += [(places[m][0], places[m][1] - l, places[m][1] + r) for m, (l, r) in wide.items()]
    return spans


def _judge(least: int):
    """Streams rows sorted by hash; holds one hash's contexts."""

    def run(batches):
        rest: list[tuple[int, int, bytes]] = []
        last = None
        for batch in batches:
            g = batch.column("g").to_numpy()
            docs, ats, ctxs = batch.column("doc").to_pylist(), batch.column("at").to_pylist(), batch.column("ctx").to_pylist()
            spans: list[tuple[int, int, int]] = []
            edges = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]]).tolist() if len(g) else [0]
            for a, b in zip(edges, edges[1:]):
                if g[a] != last:
                    if len(rest) > 1:
                        spans += judged(rest, least)
                    rest, last = [], g[a]
                for i in range(a, b):
                    if ctxs[i] is None:
                        spans.append((docs[i], ats[i], int(g[i])))
                    else:
                        rest.append((docs[i], ats[i], ctxs[i]))
            if spans := joined(spans):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*spans)], ["doc", "start", "stop"])
        if len(rest) > 1 and (spans := judged(rest, least)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*spans)], ["doc", "start", "stop"])

    return run


def grouped(rows: list[tuple[int, int, bytes]], least: int) -> Iterator[tuple[bytes, int, list[tuple[int, int]]]]:
    """(digest, length, places) of the repeats among all contexts (doc, at, ctx) of one hash: contexts
    that are equal, and the maximal repeats of different ones with all that have them."""
    classes: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
    for doc, at, ctx in rows:
        classes.setdefault((at >> 8 & 255, ctx), []).append((doc, at >> 16))
    for (before, ctx), places in classes.items():
        if len(places) > 1:
            hot = before == _DIGEST
            yield ctx if hot else hashlib.sha256(ctx).digest(), least if hot else len(ctx), [(doc, at - (0 if hot else before)) for doc, at in places]
    contexts = [(b, c, places) for (b, c), places in classes.items() if b != _DIGEST]
    if len(contexts) > 1:
        for left, right, group in maximal_repeats([c[:b][::-1] for b, c, _ in contexts], [c[b:] for b, c, _ in contexts], least):
            b, c, _ = contexts[group[0]]
            yield hashlib.sha256(c[b - left : b + right]).digest(), left + right, [(doc, at - left) for m in group for doc, at in contexts[m][2]]


def _group(least: int):
    """Streams rows sorted by hash; holds one hash's contexts."""

    def run(batches):
        rest: list[tuple[int, int, bytes]] = []
        last = None

        def out():
            found = [(digest, size, doc, at) for digest, size, places in grouped(rest, least) for doc, at in places]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), (pa.binary(), pa.int64(), pa.int64(), pa.int64()))], ["repeat", "n_bytes", "doc", "start"]) if found else None

        for batch in batches:
            for g, *row in zip(*(batch.column(c).to_pylist() for c in ("g", "doc", "at", "ctx"))):
                if g != last:
                    if len(rest) > 1 and (made := out()):
                        yield made
                    rest, last = [], g
                rest.append(tuple(row))
        if len(rest) > 1 and (made := out()):
            yield made

    return run


def merged(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return list(zip(starts[new].tolist(), reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)].tolist()))


def located(docs: DataFrame, least: int, seed: int, hot: int, carry: bool = False, every: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """rows (doc, row), where doc orders the texts; pairs (doc_id, digest, doc) of different texts; base,
    the rows with a doc and whether theirs is the first of equal texts; and the contexts of anchors.

    Text and carried columns travel as one struct, so that all readers share one shuffle.
    """
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)] if carry else []
    bounded_batches(docs.sparkSession)
    whole = F.struct(F.coalesce("text", F.lit("")).alias("text"), *[x for x, c in zip(others, docs.columns) if c != "text"], *([F.col("text").isNull().alias("none")] if carry else []), F.col("doc_id").cast("long").alias("id")).alias("row")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole)
    digests = text_rows(docs).filter("doc_id is not null").select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))
    pairs = written(digests.distinct(), "suffix-digests")
    if not pairs.groupBy("doc_id").count().filter("count > 1").isEmpty():  # ids with different texts: number all texts in order
        pairs = written(pairs.orderBy("doc_id", "digest").withColumn("doc", F.monotonically_increasing_id()), "suffix-digests")
        rows = rows.withColumn("digest", F.unhex(F.sha2("row.text", 256))).join(pairs, ["doc_id", "digest"], "left").select("doc", "row")
    else:
        pairs = pairs.withColumn("doc", F.col("doc_id"))
        rows = rows.select(F.col("doc_id").alias("doc"), "row")
    firsts = written(pairs.groupBy("digest").agg(F.min("doc").alias("doc")).select("doc"), "suffix-firsts").withColumn("first", F.lit(True))
    # The same filter for every reader: else the optimizer gives each its own text shuffle.
    base = rows.filter("doc is not null").join(firsts.hint("shuffle_hash"), "doc", "left")
    own = base.filter("first").select("doc", "row")
    # Counts are taken over all rows, copies of whole texts too: that needs no shuffle of texts, and
    # a hash that only copies share brings a context that meets no other. Written, so that the join
    # has plain shuffles on either side and a hot hash can be split.
    counted = rows.filter("doc is not null").select("doc", "row").mapInArrow(_count(least, seed), "h long, n long")
    repeated = written(counted.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1"), "suffix-hashes")
    marks = own.mapInArrow(_mark(least, seed), "h long, doc long, at long").join(repeated.hint("shuffle_hash"), "h")
    listed = marks.groupBy("doc").agg(F.collect_list(F.struct("h", "at", "n")).alias("marks"))
    contexts = base.join(listed, "doc", "left").filter("first and marks is not null").select("doc", "row", "marks").mapInArrow(_contexts(least, hot, every), CONTEXT)
    return rows, pairs, base, contexts.repartition("g").sortWithinPartitions("g")


def repeats(docs: DataFrame, least: int = 100, seed: int = 24, hot: int = 4096) -> DataFrame:
    """(repeat, n_bytes, doc_id, start): the maximal repeat groups with all their occurrences.

    A repeat is a string of `least` bytes or more, named by its SHA-256 (lowercase hex), that occurs
    twice and can't be extended on either side in all its occurrences; it is seen within the bytes
    around an anchor, so one longer than those appears as several groups that overlap. Texts that are
    equal as a whole and `least` bytes long are a group of their own, and what occurs in one of them is
    listed for each.
    """
    _, pairs, _, contexts = located(docs, least, seed, hot, every=True)
    found = contexts.mapInArrow(_group(least), "repeat binary, n_bytes long, doc long, start long").distinct()
    texts = pairs.select(F.col("doc_id").alias("other"), F.col("digest").alias("d"))
    listed = found.join(pairs.select("doc", "digest"), "doc").join(texts, F.col("digest") == F.col("d"))
    sizes = text_rows(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("repeat")).filter((F.col("n_bytes") >= least) & F.col("doc_id").isNotNull()).distinct()
    several = sizes.groupBy("repeat").count().filter("count > 1").select("repeat")
    whole = sizes.join(several, "repeat", "left_semi").select("repeat", "n_bytes", "doc_id", F.lit(0).cast("long").alias("start"))
    out = listed.select("repeat", "n_bytes", F.col("other").alias("doc_id"), "start").union(whole).distinct()
    return out.withColumn("repeat", F.lower(F.hex("repeat")))


def apply_runs(docs: DataFrame, finish: Callable[[int | None, bytes, list[tuple[int, int]]], tuple], schema: str, least: int = 100, seed: int = 24, hot: int = 4096, carry: bool = False) -> DataFrame:
    """finish(doc_id, text, removed runs) of every row, as a DataFrame of the given schema; with
    carry also `rest`, the row itself as a struct."""
    rows, _, base, contexts = located(docs, least, seed, hot, carry)
    spans = contexts.mapInArrow(_judge(least), SPAN)
    runs = spans.groupBy("doc").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    final = base.join(runs, "doc", "left").select("row", "doc", "first", "starts", "stops")
    nameless = rows.filter("doc is null").select("row", "doc", F.lit(None).cast("boolean"), *[F.lit(None).cast("array<long>")] * 2)
    final = final.union(nameless)
    kinds = docs.sparkSession.createDataFrame([], schema)
    names, types = kinds.columns, pa.schema([(f.name, pa.binary() if f.dataType.typeName() == "binary" else pa.string() if f.dataType.typeName() == "string" else pa.int64()) for f in kinds.schema])

    def cut(batches):
        for batch in batches:
            out = []
            for doc_id, text, doc, first, starts, stops in zip(batch.column(0).field("id").to_pylist(), strings(batch.column(0).field(0)), *(batch.column(i).to_pylist() if i < 3 else batch.column(i) for i in range(1, 5))):
                if doc is not None and not first:
                    own = [(0, len(text))] if len(text) >= least else []
                else:
                    own = merged(starts.values.to_numpy(), stops.values.to_numpy()) if starts.is_valid else []
                out.append(finish(doc_id, bytes(text), own))
            columns = [pa.array(c, t.type) for c, t in zip(zip(*out), types)] if out else [pa.array([], t.type) for t in types]
            yield pa.RecordBatch.from_arrays([*columns, *([batch.column(0)] if carry else [])], [*names, *(["rest"] if carry else [])])

    if carry:
        return final.mapInArrow(cut, kinds.schema.add("rest", final.schema["row"].dataType))
    return final.mapInArrow(cut, schema)


def kept(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in runs:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def _digest(doc_id, text, runs):
    return doc_id, len(text), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept(text, runs)).hexdigest()


def dedup(docs: DataFrame, **options) -> DataFrame:
    """docs with what is left of every row's text. A character cut in two is dropped; a null text
    stays null."""
    cut = apply_runs(docs, lambda doc_id, text, runs: (kept(text, runs).decode(errors="ignore"),), "left_text string", carry=True, **options)
    text = F.when(~F.col("rest.none"), F.col("left_text"))
    return cut.select(*[(text if c == "text" else F.col(f"rest.c{i}")).alias(c) for i, c in enumerate(docs.columns)])


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_runs(table(spark, sf_dir, "documents"), _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
