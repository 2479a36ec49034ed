"""Substring dedup: compact windows over min-hashes of shingles, an interval join, and verification.

A passage is ``LEAST_WORDS`` words or more; it is a duplicate where an earlier document (smaller doc_id) has a passage
whose set of 5-word shingles has a Jaccard similarity of 0.8 or more with it.

1. Compact windows. Under each of ``HASHES`` hash functions a document's shingles form a Cartesian tree; a node whose
   subtree spans at least the shortest passage is a window (a, p, c): every passage from within a..c that holds
   position p has the shingle at p as its min-hash. There are about 2 n / t of them. The tree's top is found with
   sliding minima: a node has so wide a subtree exactly if it is the minimum of some shortest passage.
2. Signatures. Windows that share a hash function, a min-hash shingle and its surroundings (``AROUND`` shingles on both
   sides, which splits the groups of stock phrases) are joined with the group's first document, by one aggregation and
   one join back: a passage in m documents gives m - 1 pairs, not m squared.
3. Interval join. Windows of one pair, shifted on each other, leave intervals of the later document. Where at least
   ``ENOUGH`` hash functions leave intervals as long as the shortest passage, there is a candidate pair.
4. Verification. The whole texts of candidate pairs are compared: runs of shared shingles are merged over small edits
   as long as the similarity holds, extended as far as they go, and kept if they are long and similar enough.
5. Rest. A group's first document may have only a part of what the later ones share, or a more edited version, and hide
   them from each other. So min-hash shingles of later documents that no verified span has, and the first shingles
   beyond each span, are grouped again, with their groups' other members: by the ``SIDES`` shingles on either side
   and by half the shortest passage, each open one paired with the first document and with the first that was no
   head before; and where half the shortest passage is shared, by each whole shortest passage around them, whose
   first document has all of it. These pairs are verified as before, whatever the number of hash functions.

So earlier documents hide no shared passage of ``LEAST_WORDS`` unchanged words, and m copies cost m - 1 pairs. A passage
that is only near is missed if all documents it is paired with fail: no pairs of all members are formed.

Defined cases: null and short texts have no passage; the texts of rows that share a doc_id, and those of rows without
one, are documents of their own and later than all others, in order of their fingerprints; their spans have the
fingerprint in ``text_hash`` (null in all others), and only the text that has it is cut; repeated rows are one document,
and cut alike; ties go to the first place; an empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cobordia.llm import textkernel as K
from cobordia.session import drop_keys, keep_keys, map_batches, settle, table

WORDS, LEAST_WORDS, SIMILAR = 5, 50, 0.8
HASHES, AROUND, ENOUGH = 4, 2, 2
SIDES = (6, 12)
WINDOWS = "sign long, hash int, doc long, a int, p int, c int"
SIDED, EXACT = "sign long, n int, doc long, p int, y long, open boolean", "sign long, doc long, open boolean"
SPANS = "doc_id long, start long, n_words long, ref_doc_id long, ref_start long, jaccard double"
#: Rows without a doc_id of their own are later than all others: bit 62, and the rest of their text's fingerprint.
OWN_BIT = 1 << 62
_U = np.uint64


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) of each ``width`` consecutive values."""
    step = 1
    while 2 * step <= width:
        x = best(x[: len(x) - step], x[step:])
        step *= 2
    return best(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def minima(rank: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Positions whose ``rank`` is the smallest of some ``width`` positions within the documents that start at ``at``."""
    if len(rank) < width:
        return np.zeros(0, np.int64)
    low = _sliding(rank, width, np.minimum)
    end = np.repeat(at[1:], np.diff(at))[: len(low)]
    low[np.arange(len(low)) + width > end] = 0
    padded = np.concatenate((np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)))
    return np.flatnonzero((_sliding(padded, width, np.maximum) == rank) & (rank > 0))


def compact_windows(rank: np.ndarray, at: np.ndarray, width: int, near: np.ndarray | None = None, narrow: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (a, p, c) of at least ``width`` positions within the documents that start at ``at``: ``rank[p]`` is the
    smallest (the leftmost, among equals) of a..c, and a..c cannot grow. A window of the same minimum as the one it
    lies in, in surroundings that ``near`` has as equal, is left out. With ``narrow`` all other ``minima`` have one,
    those too that an equal one close before cuts short."""
    p = minima(rank, at, width)
    # smaller neighbours of a tree's top nodes are top nodes themselves, so a stack over these finds a and c
    doc = np.searchsorted(at, p, "right") - 1
    first, stop = at[doc], at[doc + 1]
    a, c = first.copy(), stop - 1
    stack: list[int] = []
    values, docs, places = rank[p].tolist(), doc.tolist(), p.tolist()
    around = (near[p] if near is not None else np.arange(len(p))).tolist()
    left, right, last, within = a.tolist(), c.tolist(), -1, np.zeros(len(p), bool)
    for i, v in enumerate(values):
        if docs[i] != last:
            stack, last = [], docs[i]
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = places[i] - 1
        if stack:
            left[i] = places[stack[-1]] + 1
            if values[stack[-1]] == v and around[stack[-1]] == around[i]:
                within[i] = True
        stack.append(i)
    a, c = np.asarray(left, np.int64), np.asarray(right, np.int64)
    wide = (narrow | (c - a + 1 >= width)) & ~within
    return a[wide], p[wide], c[wide]


def _window_rows(hashes: int, around: int, width: int, only_signs: bool = False):
    """Windows (WINDOWS), or with ``only_signs`` (sign, doc) of all minima that may have one, some of them twice."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for begin, _, data, offsets in K.blocks(batch.column(1)):
                _, _, hashed, first = K.words(data, offsets)
                g, at = K.grams(hashed, first, WORDS, short=False)
                if not len(g):
                    continue
                doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
                near = np.zeros(len(g), np.uint64)
                for k in range(-around, around + 1):
                    there = np.zeros(len(g), np.uint64)
                    to = np.clip(np.arange(len(g)) + k, 0, len(g) - 1)
                    inside = (np.arange(len(g)) + k == to) & (doc[to] == doc)
                    there[inside] = g[to[inside]]
                    near = near * K._Q + there
                for h in range(hashes):
                    seed = K.mix(np.asarray([h + 1], np.uint64))[0]
                    if only_signs:
                        p = minima(K.mix(g ^ seed), at, width)
                        if len(p):
                            yield pa.RecordBatch.from_arrays([pa.array(K.mix(near[p] ^ seed).astype(np.int64)), pa.array(keys[begin + doc[p]])], names=["sign", "doc"])
                        continue
                    a, p, c = compact_windows(K.mix(g ^ seed), at, width, near, narrow=True)
                    if len(p):
                        d, sign = doc[p], K.mix(near[p] ^ seed).astype(np.int64)
                        own = [sign, np.full(len(p), h, np.int32), keys[begin + d], *((x - at[d]).astype(np.int32) for x in (a, p, c))]
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, own)), names=[f.split()[0] for f in WINDOWS.split(", ")])

    return rows


def _overlap(passage: set[int], y: np.ndarray, lo: int, n: int) -> tuple[float, int]:
    lo = min(max(lo, 0), len(y))
    q = set(y[lo : lo + n].tolist())
    return len(passage & q) / len(passage | q), lo


def _merged(runs: list[tuple[int, int]], least: float) -> Iterator[list[tuple[int, int]]]:
    """Runs of shared shingles, joined over what lies between them while at least ``least`` of all is shared."""
    held: list[tuple[int, int]] = []
    shared = 0
    for a, b in runs:
        if held and shared + b - a < least * (b - held[0][0]):
            yield held
            held, shared = [], 0
        held, shared = [*held, (a, b)], shared + b - a
    if held:
        yield held


def _strays(runs: list[tuple[int, int]], shift: np.ndarray, most: int = 1 << 22) -> np.ndarray:
    """For each place to cut between runs: how far the shifts on both sides are from their medians, in all."""
    each = [np.unique(shift[a:b], return_counts=True) for a, b in runs]
    value, count = np.concatenate([v for v, _ in each]), np.concatenate([n for _, n in each])
    run = np.repeat(np.arange(len(runs)), [len(v) for v, _ in each])
    order = np.argsort(value, kind="stable")
    value, count, run = value[order], count[order], run[order]
    cuts = np.arange(1, len(runs))
    out = []
    for k in range(0, len(cuts), max(1, most // len(value))):  # counts of each shift on one side, a row per cut
        left = np.where(run[None, :] < cuts[k : k + max(1, most // len(value))][:, None], count[None, :], 0)
        total = np.zeros(len(left), np.int64)
        for side in (left, count[None, :] - left):
            upto = np.cumsum(side, axis=1)
            median = value[np.argmax(2 * upto >= upto[:, -1:], axis=1)]
            total += (side * np.abs(value[None, :] - median[:, None])).sum(axis=1)
        out.append(total)
    return np.concatenate(out)


def _parts(runs: list[tuple[int, int]], shift: np.ndarray, least: float) -> list[list[tuple[int, int]]]:
    """What to try of a stretch that is not similar as a whole: both sides of where its shift in y changes most, or of
    its widest gap where that stays the same. A run by itself is split wherever its shift changes."""
    if len(runs) == 1:
        a, b = runs[0]
        at = [a, *(a + 1 + np.flatnonzero(np.diff(shift[a:b]))).tolist(), b]
        runs = list(zip(at[:-1], at[1:], strict=True))
    if len(runs) == 1:
        return []
    gaps = np.asarray([p[1] - q[0] for p, q in zip(runs[:-1], runs[1:], strict=True)])
    k = int(np.lexsort((gaps, _strays(runs, shift)))[0]) + 1
    return [part for half in (runs[:k], runs[k:]) for part in _merged(half, least)]


def _first_outside(y: np.ndarray, x: np.ndarray) -> int:
    """How many of ``y`` come before one that is not in ``x``."""
    step = 2 * max(len(x), 64)
    for k in range(0, len(y), step):
        outside = np.flatnonzero(~np.isin(y[k : k + step], x))
        if len(outside):
            return k + int(outside[0])
    return len(y)


def similar_passages(x: np.ndarray, y: np.ndarray, width: int, similar: float, order: np.ndarray | None = None) -> list[tuple[int, int, int, float]]:
    """Passages of ``x`` (shingles in order) that ``y`` has: first and last shingle, first one in ``y``, Jaccard.
    ``order``: the stable order of ``y``, if it is known."""
    if len(x) == len(y) and np.array_equal(x, y):
        return [(0, len(x) - 1, 0, 1.0)] if len(x) >= width else []
    order = np.argsort(y, kind="stable") if order is None else order
    ranked = y[order]
    at = np.searchsorted(ranked, x)
    at[at == len(y)] = 0
    shared = ranked[at] == x if len(y) else np.zeros(len(x), bool)
    if int(shared.sum()) < width * least_shared(similar):
        return []
    where = order[at]  # the first place in y
    edges = np.flatnonzero(np.diff(np.concatenate(([0], shared.astype(np.int8), [0]))))
    least = least_shared(similar)
    whole = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
    out = []
    todo = list(_merged(whole, least))[::-1]
    while todo:
        runs = todo.pop()
        a, b = runs[0][0], runs[-1][1]
        if b - a < width:
            continue
        own = np.arange(a, b)[shared[a:b]]
        p = set(x[a:b].tolist())
        # where in y: the usual shift, or for shingles that y has several times the first run of them
        values, counts = np.unique(own - where[own], return_counts=True)
        places = {(a - shift, b - a) for shift in (int(np.median(own - where[own])), int(values[counts.argmax()]), int(own[0] - where[own[0]]), int(own[-1] - where[own[-1]]))}
        run = int(where[own].min())
        stop = _first_outside(y[run:], x[a:b])
        places.add((run, stop if stop >= width else b - a))
        score, lo = max(_overlap(p, y, lo, n) for lo, n in places)
        if score >= similar:
            out.append((a, b - 1, lo, score))
        else:
            todo += _parts(runs, np.arange(len(x)) - where, least)[::-1]
    return out


def least_shared(similar: float) -> float:
    """Shared shingles of two passages of equal length, as a share of either."""
    return 2 * similar / (1 + similar)


class Texts:
    """Shingles and their order of the texts last seen, by document: pairs of one document come together."""

    def __init__(self, most: int = 4_000_000) -> None:
        self.most, self.size, self.known = most, 0, {}

    def of(self, doc: int, texts: pa.Array, k: int) -> list[np.ndarray | None]:
        if doc not in self.known:
            g = _shingles(texts, k)
            if self.size + len(g) > self.most:
                self.known, self.size = {}, 0
            self.known[doc], self.size = [g, None], self.size + len(g)
        return self.known[doc]


def _verified(width: int, similar: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Texts()
        for batch in batches:
            x, y = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for k in range(len(x)):
                own, other = held.of(x[k], batch.column(2), k), held.of(y[k], batch.column(3), k)
                if other[1] is None:
                    other[1] = np.argsort(other[0], kind="stable")
                out += [(x[k], a, b - a + WORDS, y[k], at, score) for a, b, at, score in similar_passages(own[0], other[0], width, similar, other[1])]
            columns = list(zip(*out, strict=True)) or [[] for _ in range(6)]
            kinds = [pa.int64()] * 5 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in SPANS.split(", ")])

    return rows


def _shingles(texts: pa.Array, k: int) -> np.ndarray:
    _, _, data, offsets = next(K.blocks(texts.slice(k, 1)))
    _, _, hashed, first = K.words(data, offsets)
    return K.grams(hashed, first, WORDS, short=False)[0]


def _sums(g: np.ndarray) -> np.ndarray:
    """Polynomial sums of all first shingles, for ``K.span_hashes``."""
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(g * K._power(len(g) + 1)[0][: len(g)], dtype=np.uint64)))


def _batch(parts: list[list[np.ndarray]], schema: str) -> Iterator[pa.RecordBatch]:
    if parts:
        columns = [pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in schema.split(", ")])


def _items(column: pa.Array, *names: str) -> tuple[np.ndarray, ...]:
    """Rows of the items of a list-of-structs column (null lists have none), ascending, and their fields."""
    count = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    return np.repeat(np.arange(len(column)), count), *(flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names)


def _placed(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Blocks of (doc, text, its places, its spans): docs, all shingles, each document's first one, and the documents (as
    numbers) and positions (among all shingles) of places and spans."""
    docs, places, spans = batch.column(0).to_numpy(zero_copy_only=False), _items(batch.column(2), "p", "y"), _items(batch.column(3), "lo", "hi")
    for begin, end, data, offsets in K.blocks(batch.column(1)):
        _, _, hashed, first = K.words(data, offsets)
        g, at = K.grams(hashed, first, WORDS, short=False)
        (d, p, y), (e, lo, hi) = ([x[slice(*np.searchsorted(items[0], [begin, end]))] for x in items] for items in (places, spans))
        d, e = d - begin, e - begin
        yield docs[begin:end], g, at, (d, p + at[d], y), (e, lo + at[e], hi + at[e])


def _marked(lo: np.ndarray, hi: np.ndarray, total: int) -> np.ndarray:
    """Which of ``total`` places are in one of the stretches lo..hi."""
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, lo, 1)
    np.add.at(change, hi + 1, -1)
    return np.cumsum(change[:-1]) > 0


def _side_rows(width: int):
    """For each place of a document, and for the first shingles beyond its spans: hashes of what stands on either side."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, g, at, (d, p, y), (e, lo, hi) in _placed(batch):
                own, beyond = np.concatenate((e, e)), np.concatenate((lo - 1, hi + 1))
                inside = (beyond >= at[own]) & (beyond < at[own + 1])
                own, beyond = own[inside], beyond[inside]
                d, p, y = np.concatenate((d, own)), np.concatenate((p, beyond)), np.concatenate((y, docs[own]))
                open_, total, out = ~_marked(lo, hi, len(g))[p], _sums(g), []
                for n in sorted({min(n, width // 2) for n in SIDES} | {width // 2}):
                    for side in range(2):
                        first = p - n * side
                        ok = (first >= at[d]) & (first + n < at[d + 1])
                        sign = K.mix(K.span_hashes(total, first[ok], first[ok] + n + 1) ^ _U(2 * n + side)).astype(np.int64)
                        out.append([sign, np.full(len(sign), n, np.int32), docs[d[ok]], (p - at[d])[ok].astype(np.int32), y[ok], open_[ok]])
                yield from _batch(out, SIDED)

    return rows


def _exact_rows(width: int):
    """The shortest passages around each place, as one hash each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, g, at, (d, p, _), (_, lo, hi) in _placed(batch):
                first, last = np.maximum(p - width + 1, at[d]), np.minimum(p, at[d + 1] - width)
                some = first <= last
                start = np.flatnonzero(_marked(first[some], last[some], len(g)))
                if not len(start):
                    continue
                end = np.full(len(g), -1)  # how far the spans reach that begin here or before
                np.maximum.at(end, lo, hi)
                open_ = np.maximum.accumulate(end)[start] < start + width - 1
                sign = K.span_hashes(_sums(g), start, start + width).astype(np.int64)
                yield from _batch([[sign, docs[np.searchsorted(at, start, "right") - 1], open_]], EXACT)

    return rows


def _compared(docs: DataFrame, pairs: DataFrame, width: int, similar: float) -> DataFrame:
    """(SPANS) of the distinct, settled pairs (x, y), by their whole texts."""
    named = pairs.select(F.explode(F.array("x", "y")).alias("doc")).distinct()
    texts = keep_keys(docs, settle(named), "doc")
    x, y = texts.select(F.col("doc").alias("x"), F.col("text").alias("x_text")), texts.select(F.col("doc").alias("y"), F.col("text").alias("y_text"))
    both = pairs.join(x.hint("merge"), "x").join(y.hint("merge"), "y").select("x", "y", "x_text", "y_text")
    return settle(map_batches(both, _verified(width, similar), SPANS).dropDuplicates())


def _with_places(docs: DataFrame, places: DataFrame, covered: DataFrame, rows, schema: str) -> DataFrame:
    """``rows`` over (doc, text, its places, its spans), documents that have places or spans."""
    own = settle(places.groupBy("doc").agg(F.collect_set(F.struct("p", "y")).alias("places")).join(covered, "doc", "full"))
    texts = keep_keys(docs, own.select("doc"), "doc")
    return settle(map_batches(texts.join(own.hint("merge"), "doc").select("doc", "text", "places", "spans"), rows, schema).dropDuplicates())


def _rest(docs: DataFrame, shared: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """Pairs (x, y) that the windows' first documents hide: see Rest, above."""
    covered = spans.select(F.col("doc_id").alias("doc"), F.struct(F.col("start").alias("lo"), (F.col("start") + F.col("n_words") - WORDS).alias("hi")).alias("s"))
    covered = settle(covered.groupBy("doc").agg(F.collect_set("s").alias("spans")))
    inside = F.exists("spans", lambda s: (s["lo"] <= F.col("p")) & (F.col("p") <= s["hi"]))
    left = shared.filter("doc <> y").join(covered, "doc", "left").filter(~F.coalesce(inside, F.lit(False))).select("sign").distinct()
    places = shared.join(settle(left), "sign").select("doc", "p", "y")
    sided = _with_places(docs, places, covered, _side_rows(width), SIDED)
    firsts = sided.groupBy("sign").agg(F.min("doc").alias("y1"), F.max("doc").alias("last"), F.min(F.when(F.col("doc") != F.col("y"), F.col("doc"))).alias("y2"), F.max("open").alias("some"))
    sided = settle(sided.join(settle(firsts.filter("y1 <> last and some").drop("last", "some")), "sign"))
    near = sided.filter("open").select(F.col("doc").alias("x"), F.explode(F.array("y1", "y2")).alias("y")).filter("x > y")
    places = sided.filter(F.col("n") == width // 2).select("doc", "p", "y")
    exact = _with_places(docs, places, covered.join(places.select("doc").distinct(), "doc"), _exact_rows(width), EXACT)
    firsts = exact.groupBy("sign").agg(F.min("doc").alias("y"), F.max("doc").alias("last"), F.max("open").alias("some")).filter("y <> last and some")
    exact = exact.filter("open").join(settle(firsts.select("sign", "y")), "sign").select(F.col("doc").alias("x"), "y").filter("x > y")
    return near.unionByName(exact).distinct()


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.lit("passage-1"), F.coalesce(text, F.lit("")))


def _documents(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows (id, text) -> documents (doc, text) with a ``doc`` of their own each, and for those that had no id, or one
    of several rows, (doc, id, text_hash)."""
    several = settle(docs.groupBy("id").agg(F.count("*").alias("n")).filter("id is null or n > 1").select("id"))
    if not several.limit(1).count():
        return docs.select(F.col("id").alias("doc"), "text"), None
    own = keep_keys(docs, several.filter("id is not null"), "id").unionByName(docs.filter("id is null"))
    own = own.withColumn("text_hash", _text_hash(F.col("text")))
    place = F.xxhash64("id", "text_hash").bitwiseAND(F.lit(OWN_BIT - 1)).bitwiseOR(F.lit(OWN_BIT))
    own = own.select(place.alias("doc"), "id", "text_hash", "text").dropDuplicates(["doc"])
    own = settle(own)
    single = drop_keys(docs, several.filter("id is not null"), "id").filter("id is not null")
    return single.select(F.col("id").alias("doc"), "text").unionByName(own.select("doc", "text")), own.drop("text")


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, similar: float = SIMILAR, hashes: int = HASHES, enough: int = ENOUGH) -> DataFrame:
    """(SPANS, text_hash long): for each later document, its passages (first word, words) that an earlier one has, and
    where."""
    docs, own = _documents(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")))
    spans = _spans(docs, least_words, similar, hashes, enough)
    if own is None:
        return spans.withColumn("text_hash", F.lit(None).cast("long"))
    for side in ("doc_id", "ref_doc_id"):
        names = own.select(F.col("doc").alias(side), F.col("id").alias("its"), *([F.col("text_hash")] if side == "doc_id" else []))
        spans = spans.join(names.withColumn("renamed", F.lit(True)), side, "left").withColumn(side, F.when(F.col("renamed"), F.col("its")).otherwise(F.col(side))).drop("its", "renamed")
    return spans.select(*(f.split()[0] for f in SPANS.split(", ")), "text_hash")


def _spans(docs: DataFrame, least_words: int, similar: float, hashes: int, enough: int) -> DataFrame:
    """(SPANS) of documents (doc, text)."""
    width = least_words - WORDS + 1
    # settled, so that each join below has plain exchanges on both sides, whose hot signatures can be split; signatures go
    # first and alone: windows take several times the room, and few of them share one
    signs = map_batches(docs, _window_rows(hashes, AROUND, width, only_signs=True), "sign long, doc long")
    heads = settle(signs.groupBy("sign").agg(F.min("doc").alias("y"), F.max("doc").alias("last")).filter("y <> last").drop("last"))
    shared = settle(map_batches(docs, _window_rows(hashes, AROUND, width), WINDOWS).join(heads, "sign"))
    own = settle(shared.filter("doc = y").groupBy("sign").agg(F.max(F.expr("p - a")).alias("before"), F.max(F.expr("c - p")).alias("after")))
    pairs = shared.filter("doc <> y").join(own, "sign")
    lo, hi = F.greatest("a", F.expr("p - before")), F.least("c", F.expr("p + after"))
    pairs = pairs.filter(hi - lo + 1 >= width).groupBy(F.col("doc").alias("x"), "y").agg(F.bit_or(F.expr("shiftleft(1L, hash)")).alias("found"))
    pairs = settle(pairs.filter(F.bit_count("found") >= enough).select("x", "y"))
    spans = _compared(docs, pairs, width, similar)
    rest = settle(_rest(docs, shared, spans, width).join(pairs, ["x", "y"], "left_anti"))
    if not rest.limit(1).count():
        return spans
    return spans.unionByName(_compared(docs, rest, width, similar))


def cut_passages(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` without the words of ``spans``, columns as they were; documents of which no word is left are dropped.

    Spans with a ``text_hash`` are cut from that text only, whatever else its doc_id has.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("cut_id"))
    spans = spans.select(F.col("doc_id").alias("cut_id"), "text_hash", "start", "n_words")
    spans = settle(spans.groupBy("cut_id", "text_hash").agg(F.collect_set(F.struct("start", "n_words")).alias("cut_spans")))
    by_id, by_text = spans.filter("text_hash is null").drop("text_hash"), spans.filter("text_hash is not null")
    rest = drop_keys(rows, by_id.select("cut_id"), "cut_id")
    touched = keep_keys(rows, by_id.select("cut_id"), "cut_id").join(by_id, "cut_id").select("row", "cut_spans")
    if by_text.limit(1).count():
        rest = rest.withColumn("cut_text", _text_hash(F.col("row.text")))
        own = by_text.select(F.col("cut_id").alias("own_id"), F.col("text_hash").alias("own_text"), F.col("cut_spans"))
        rest = rest.join(own.hint("merge"), F.col("cut_id").eqNullSafe(F.col("own_id")) & (F.col("cut_text") == F.col("own_text")), "left")
        touched = touched.unionByName(rest.filter("cut_spans is not null").select("row", "cut_spans"))
        rest = rest.filter("cut_spans is null")
    schema, names = docs.schema, docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(names, batch.column(0).flatten(), strict=True))
            out = []
            for k, own in enumerate(batch.column(1).to_pylist()):
                _, _, data, offsets = next(K.blocks(columns["text"].slice(k, 1)))
                start, end, _ = K.word_spans(data, offsets)
                keep = np.ones(len(data), bool)
                for s in own:
                    i, j = s["start"], s["start"] + s["n_words"]
                    keep[start[i] : start[j] if j < len(start) else len(data)] = False
                out.append(data[keep].tobytes().decode() if keep[start].any() else None)
            columns["text"] = pa.array(out, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in out], columns["n_chars"].type)
            kept = pa.RecordBatch.from_arrays(list(columns.values()), names=names)
            yield kept.filter(pa.array([t is not None for t in out], pa.bool_()))

    return rest.select("row.*").unionByName(map_batches(touched, cut, schema))


def op1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).drop("text_hash")


QUERIES = {"op1_passages": op1_passages}
SQL: dict[str, str] = {}
