"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A span's bag holds the byte n-grams (3 to 6, with word ends) of its words, hashed to ``BUCKETS`` vectors; the vectors are
averaged over the bag and go through a two-class linear softmax. Vectors and softmax are trained together, so a
misspelling that was never seen shares most n-gram vectors with the words that were.

A short text is one span. A longer one has a span for each ``SPAN`` consecutive words, and scores as its strongest span
does: one average over thousands of words would drown an insult (figures in the README). In training a document's spans
are pooled by a softmax that starts as their plain average and narrows to the strongest. Scores read the whole text, and
nothing but the text.

The classifier is fitted on a bounded sample of labelled rows, each read in whole: the first in a seeded order, at most
``TOXIC`` toxic and ``CLEAN`` other documents, and of either at most ``SAMPLE_BYTES`` of text (one document at least). The
prior is the share of toxic documents among all labels to learn from. Everything else covers all rows.

The strongest of many spans is higher than the average that training began with, the more so the longer the text and the
fewer the examples. So scores are shifted to where the threshold does best on documents the model did not see: parts of
the sample are left out of training in turn, until ``JUDGED`` clean documents (or all) have such a score, and the cut is
put where the share of toxic documents found, less ``WEIGHT`` times the share of clean ones marked, is largest, among cuts
that mark at most ``MARKED`` of the clean.

Defined cases: null texts and those without words have an empty bag and score as the prior alone; labels that are null or contradict
each other for one document are not learned from; of several texts under one id the smallest is learned from, all are
scored; without labels of both kinds every score is 0.1; repeated rows score alike; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cobordia.llm import textkernel as K
from cobordia.session import map_batches, settle, table

BUCKETS, DIM, SHORTEST, LONGEST, SPAN = 1 << 18, 8, 3, 6, 6
TOXIC, CLEAN, SAMPLE_BYTES, THRESHOLD = 1500, 3000, 24 << 20, 0.3
PARTS, JUDGED, WEIGHT, MARKED = 4, 500, 1.0, 0.04
HEATS = (100.0, 30.0, 10.0, 5.0, 2.0, 1.0, 0.5, 0.5, 0.25, 0.25, 0.25, 0.25)
MARKS = b".,;:!?%&$*#\"'()[]<>-"
_U = np.uint64


def bag(words: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The words' n-gram buckets, word after word, and each word's first one (one more entry than words)."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    at = np.concatenate(([0], np.cumsum(size)))
    data = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8) if words else np.zeros(0, np.uint8)
    up, down = K._power(len(data) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(K._CODE[data] * up[: len(data)], dtype=np.uint64)))
    word = np.repeat(np.arange(len(words)), size)
    room = at[word + 1] - np.arange(len(data))
    found, of = [], []
    for n in range(SHORTEST, LONGEST + 1):
        ok = np.flatnonzero(room >= n)
        found.append(K.mix((total[ok + n] - total[ok]) * down[ok] + _U(n)) & _U(buckets - 1))
        of.append(word[ok])
    found, of = np.concatenate(found).astype(np.int32), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return found[order], np.searchsorted(of[order], np.arange(len(words) + 1))


def bags(words: list[bytes], most: int = 5_000) -> tuple[np.ndarray, np.ndarray]:
    """``bag``, a part of the words at a time."""
    found, at = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for k in range(0, len(words), most):
        grams, first = bag(words[k : k + most])
        found.append(grams)
        at.append(first[1:] + at[-1][-1])
    return np.concatenate(found), np.concatenate(at)


def lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.cast(pa.large_string()))


def training_words(text: bytes, span: int = SPAN, most: int | None = None) -> bytes:
    """A lower-case text's words without the marks around them, joined by spaces; of more than ``most`` spans, if that is
    given, those with the smallest hashes."""
    words = [w.strip(MARKS) for w in text.split()]
    words = [w for w in words if w]
    if most is not None and len(words) > span * most:
        spans = [b" ".join(words[i : i + span]) for i in range(0, len(words), span)]
        spans = sorted(spans, key=lambda x: (hashlib.blake2b(x, digest_size=8).digest(), x))[:most]
        return b" ".join(spans)
    return b" ".join(words)


class Sample:
    """Documents as numbers of distinct words, and the n-grams of those."""

    def __init__(self, docs: Iterable[list[bytes]]) -> None:
        place: dict[bytes, int] = {}
        self.each = [np.fromiter((place.setdefault(w, len(place)) for w in d), np.int32, len(d)) for d in docs]
        self.grams, self.at = bags(list(place))

    def strongest(self, odds: np.ndarray, which: np.ndarray, span: int) -> np.ndarray:
        """What ``strongest`` gives for some of the documents."""
        sums = np.concatenate(([0.0], np.cumsum(odds[self.grams])))
        words = np.concatenate([self.each[d] for d in which])
        first = np.concatenate(([0], np.cumsum([len(self.each[d]) for d in which])))
        return strongest((sums[self.at[1:]] - sums[self.at[:-1]])[words], np.diff(self.at)[words], first, span)


class Model:
    """Vectors of n-grams, and a linear softmax over the average of a span's."""

    def __init__(self, prior: float = 0.1, span: int = SPAN, seed: int = 11) -> None:
        draw = np.random.RandomState(seed)
        self.span = span
        self.vectors = draw.normal(0, 0.01, (BUCKETS, DIM))
        self.softmax = draw.normal(0, 0.5, (2, DIM))
        self.bias = float(np.log(prior / (1 - prior)))  # an empty bag scores so
        self.shift = 0.0  # of other scores, by calibration

    def odds(self) -> np.ndarray:
        """What each n-gram adds to a span's log-odds, before averaging."""
        return self.vectors @ (self.softmax[1] - self.softmax[0])

    def fit(self, docs: Iterable[list[bytes]], toxic: np.ndarray, heats: tuple[float, ...] = HEATS, rate: float = 0.2, batch: int = 64) -> Model:
        sample = Sample(docs)
        return self.train(sample, np.arange(len(sample.each)), toxic, heats, rate, batch)

    def train(self, sample: Sample, which: np.ndarray, toxic: np.ndarray, heats: tuple[float, ...] = HEATS, rate: float = 0.2, batch: int = 64) -> Model:
        """Stochastic gradient (Adagrad) on the cross-entropy of each document's pooled spans, once for each of
        ``heats``: the pool is an average of the spans' log-odds weighted by their softmax at that heat."""
        each, grams, at = sample.each, sample.grams, sample.at
        some = np.asarray([d for d in which if len(each[d])], np.int64)
        seen, seen_soft = np.full(BUCKETS, 1e-6), 1e-3
        draw = np.random.RandomState(5)
        for heat in heats:
            order = draw.permutation(some)
            for start in range(0, len(order), batch):
                lot = order[start : start + batch]
                spans = [np.arange(len(each[d])) // self.span for d in lot]
                first = np.concatenate(([0], np.cumsum([x[-1] + 1 for x in spans])))
                of = np.concatenate([x + k for x, k in zip(spans, first[:-1].tolist(), strict=True)])
                uniq, back = np.unique(np.concatenate([each[d] for d in lot]), return_inverse=True)
                width = at[uniq + 1] - at[uniq]
                cut = np.concatenate(([0], np.cumsum(width)))
                mine = grams[np.arange(cut[-1]) - np.repeat(cut[:-1] - at[uniq], width)]
                apart = self.softmax[1] - self.softmax[0]
                sums = np.concatenate(([0.0], np.cumsum((self.vectors @ apart)[mine])))
                bagged = np.maximum(np.bincount(of, width[back], first[-1]), 1)
                span = np.bincount(of, (sums[cut[1:]] - sums[cut[:-1]])[back], first[-1]) / bagged
                count = np.diff(first)
                top = np.maximum.reduceat(span, first[:-1])
                weight = np.exp((span - np.repeat(top, count)) / heat)
                weight /= np.repeat(np.add.reduceat(weight, first[:-1]), count)
                error = 1 / (1 + np.exp(-np.add.reduceat(weight * span, first[:-1]) - self.bias)) - toxic[lot]
                share = np.bincount(back, (weight * np.repeat(error, count) / bagged)[of], len(uniq))
                push = np.bincount(mine, np.repeat(share, width), BUCKETS)
                touched = np.flatnonzero(push)
                slope = push[touched] @ self.vectors[touched]
                seen[touched] += push[touched] ** 2
                self.vectors[touched] -= rate * (push[touched] / np.sqrt(seen[touched]))[:, None] * apart
                seen_soft += slope @ slope
                step = 0.05 * slope / np.sqrt(seen_soft)
                self.softmax += np.stack([step, -step])
        return self


def cut(score: np.ndarray, toxic: np.ndarray, weight: float = WEIGHT, marked: float = MARKED) -> float:
    """The log-odds from which documents are best called toxic (module docstring); of equal cuts the highest."""
    toxic = np.asarray(toxic) == 1
    bad, good = np.sort(score[toxic]), np.sort(score[~toxic])
    at = np.concatenate(([score.max() + 1e-9], np.unique(score)[::-1]))
    found, wrong = 1 - np.searchsorted(bad, at) / len(bad), 1 - np.searchsorted(good, at) / len(good)
    k = int(np.argmax(np.where(wrong <= marked, found - weight * wrong, -np.inf)))
    # half way down to the next document, which is not to be marked
    return float(at[k] if k + 1 == len(at) else (at[k] + at[k + 1]) / 2)


def calibrated(model: Model, sample: Sample, toxic: np.ndarray, parts: int = PARTS, judged: int = JUDGED, threshold: float = THRESHOLD) -> Model:
    """``model``, shifted so that ``threshold`` is the best cut of documents left out of training."""
    part = np.zeros(len(toxic), np.int64)
    for c in (0, 1):  # the sample comes in the order of ids
        own = np.random.RandomState(3).permutation(np.flatnonzero(toxic == c))
        part[own] = np.arange(len(own)) % parts
    score = np.full(len(toxic), np.nan)
    for p in range(parts):
        rest, out = np.flatnonzero(part != p), np.flatnonzero(part == p)
        if len(np.unique(toxic[rest])) == 2 and len(out):
            own = Model(1 / (1 + np.exp(-model.bias)), model.span).train(sample, rest, toxic)
            score[out] = sample.strongest(own.odds(), out, model.span)
        if (~np.isnan(score) & (toxic == 0)).sum() >= judged:
            break
    seen = ~np.isnan(score)
    if len(np.unique(toxic[seen])) == 2:
        model.shift = float(np.log(threshold / (1 - threshold))) - cut(score[seen], toxic[seen]) - model.bias
    return model


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: int = TOXIC, clean: int = CLEAN, most_bytes: int = SAMPLE_BYTES) -> Model | None:
    """A model of the bounded training sample (module docstring), or None where a class has no document."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col(key).isNotNull()).filter(~held_out(F.col(key)))
    known = known.groupBy(F.col(key).alias("id")).agg(F.min("toxic").alias("y"), F.max("toxic").alias("y1")).filter("y = y1").drop("y1")
    n = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}  # two rows
    if len(n) < 2:
        return None
    first = F.xxhash64(F.lit("toxic-1"), "id")
    # the documents of both samples: at most toxic + clean ids, so broadcasting them is bounded by these parameters
    chosen = known.filter("y = 1").orderBy(first, "id").limit(toxic).unionByName(known.filter("y = 0").orderBy(first, "id").limit(clean))
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    size = texts.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.max(F.octet_length("text")).alias("size"))
    # a window over at most toxic or clean rows
    upto = F.sum(F.coalesce("size", F.lit(0))).over(Window.partitionBy("y").orderBy(first, "id"))
    chosen = settle(size.withColumn("upto", upto).filter((F.col("upto") <= most_bytes) | (F.col("upto") == F.col("size"))).select("id", "y"))

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [training_words(t or b"") for t in lowered(b.column(2)).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words, pa.binary())], names=["id", "y", "words"])

    rows = texts.join(F.broadcast(chosen), "id").select("id", "y", "text")
    rows = map_batches(rows, reduced, "id long, y int, words binary").groupBy("id", "y").agg(F.min("words").alias("words"))
    rows = rows.toArrow().sort_by("id")  # at most twice ``most_bytes``, and a document of each kind
    y = rows.column("y").to_numpy()
    if not (y == 1).any() or not (y == 0).any():
        return None
    sample = Sample(w.as_py().split() for w in rows.column("words"))
    return calibrated(Model(n[1] / (n[0] + n[1])).train(sample, np.arange(len(y)), y), sample, y)


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2


class Bags:
    """Sums of log-odds and sizes of words' bags, by the words' hashes; starts afresh beyond ``most`` words."""

    def __init__(self, odds: np.ndarray, most: int = 300_000) -> None:
        self.odds, self.most = odds, most
        self.clear()

    def clear(self) -> None:
        self.index = K.Places()
        self.total, self.size = np.zeros(0), np.zeros(0, np.int64)

    def of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word of ``data``: its bag's sum and size."""
        uniq, at, back = np.unique(K.span_hashes(K.prefixes(data), start, end), return_index=True, return_inverse=True)
        found = self.index.find(uniq)
        if (found < 0).any() and len(self.index) + int((found < 0).sum()) > self.most:
            self.clear()
            found[:] = -1
        new = np.flatnonzero(found < 0)
        if len(new):
            raw, held = data.tobytes(), len(self.index)
            words = [raw[a:b].strip(MARKS) for a, b in zip(start[at[new]].tolist(), end[at[new]].tolist(), strict=True)]
            grams, first = bags(words)
            sums = np.concatenate(([0.0], np.cumsum(self.odds[grams])))
            self.total, self.size = np.concatenate((self.total, np.diff(sums[first]))), np.concatenate((self.size, np.diff(first)))
            self.index.add(uniq[new])
            found[new] = held + np.arange(len(new))
        return self.total[found[back]], self.size[found[back]]


def strongest(total: np.ndarray, size: np.ndarray, first: np.ndarray, span: int) -> np.ndarray:
    """Each document's largest span average, over all runs of ``span`` words (fewer words are one run); 0 without words."""
    n = np.diff(first)
    out = np.zeros(len(n))
    runs = np.where(n > 0, np.maximum(n - span + 1, 1), 0)
    if not runs.sum():
        return out
    begin = np.repeat(first[:-1], runs) + np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    stop = np.minimum(begin + span, np.repeat(first[1:], runs))
    sums, sizes = np.concatenate(([0.0], np.cumsum(total))), np.concatenate(([0], np.cumsum(size)))
    mean = (sums[stop] - sums[begin]) / np.maximum(sizes[stop] - sizes[begin], 1)
    some = runs > 0
    out[some] = np.maximum.reduceat(mean, (np.cumsum(runs) - runs)[some])
    return out


def scores(odds: np.ndarray | None, bias: float, shift: float, span: int, stamp: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = K.held(f"toxicity {stamp}", lambda: Bags(odds)) if odds is not None else None
        for batch in batches:
            out = [np.zeros(0)]
            for begin, end, data, offsets in K.blocks(lowered(batch.column(1)), 1 << 18):
                best = np.zeros(end - begin)
                if known is not None:
                    start, stop, first = K.word_spans(data, offsets)
                    best = strongest(*known.of(data, start, stop), first, span) + np.where(np.diff(first) > 0, shift, 0)
                out.append(1 / (1 + np.exp(-np.clip(best + bias, -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out))], names=["id", "score"])

    return rows


def _scorer(model: Model | None):
    """Without a model, every score is 0.1."""
    if model is None:
        return scores(None, float(np.log(0.1 / 0.9)), 0.0, 1, "none")
    odds = model.odds().astype(np.float32).astype(np.float64)
    return scores(odds, model.bias, model.shift, model.span, hashlib.blake2b(odds.tobytes(), digest_size=8).hexdigest())


def score_documents(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` as id, and score (0 to 1)."""
    return map_batches(docs.select(F.col(key).cast("long"), F.col(text)), _scorer(model), "id long, score double")


def drop_toxic(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, as they are, whose text scores below ``threshold``; nothing is shuffled."""
    scored, at = _scorer(model), docs.columns.index(text)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            only = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column(at)], names=["id", "text"])
            score = np.concatenate([b.column(1).to_numpy() for b in scored(iter([only]))])
            yield batch.filter(pa.array(score < threshold))

    return map_batches(docs, rows, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    x = score_documents(docs, learn(docs, labels))
    return x.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op6_toxicity": op6_toxicity}
SQL: dict[str, str] = {}
