"""Target-distribution importance resampling: documents drawn by how much likelier the target makes their n-grams.

A word is a run of 0-9, a-z and non-ASCII characters, after A-Z were lower-cased; features are all runs of 1 to ``n``
consecutive words joined by a space, repeats counted, each hashed to one of ``buckets`` buckets (unsigned crc32 of its UTF-8
bytes). A bucket's gain is the logarithm of its smoothed share of the target over that of the corpus, in thousandths; a
document's weight is the sum of its features' gains. Gumbel noise from the document's id makes the highest scores a
weighted draw without replacement.

Identical texts are collapsed by grouping on the full text: their features are computed once, counted as often as the text
occurs, and weighed once; the weight is joined back by the text's SHA-256, and only then comes the noise of each document.
What is kept of a text meanwhile is two bytes a feature. The gains are one row per bucket.

The ranking is a distributed sort: ranks are places in a range partition plus the sizes of the partitions before it.

Defined cases: null texts and those without words have no features and weight 0; a null doc_id has the noise of an empty
id and comes last among equals; rows that share a doc_id share their noise and are ranked one by one, of equal scores
those with fewer features, then of smaller weight first; an empty table gives an empty result, and an empty target equal
shares; very long texts are read in whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cobordia.llm import textkernel as K
from cobordia.session import map_batches, settle, table

RUNS, BUCKETS, LEAST_WORDS, SHARE, SEED = 1, 10_000, 20, 10, 2024
FEATURES = "digest binary, copies long, n_words long, n_features long, buckets binary"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _crc_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, x >> 1 ^ np.uint32(0xEDB88320), x >> 1)
    return x


_CRC = _crc_table()


def crc32s(data: np.ndarray, start: np.ndarray, end: np.ndarray, long: int = 48) -> np.ndarray:
    """crc32 of each span, a byte of all spans at a time; spans of more than ``long`` bytes one by one."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    order = order[size[order] <= long]
    at, left, c = start[order], size[order], np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -k, "left"))  # spans of more than k bytes come first
        c[:n] = _CRC[(c[:n] ^ data[at[:n] + k]) & 255] ^ c[:n] >> 8
    out = np.empty(len(start), np.uint32)
    out[order] = ~c
    for k in np.flatnonzero(size > long).tolist():
        out[k] = zlib.crc32(data[start[k] : end[k]].tobytes())
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' words in lower case with one space after each, their starts and ends there, and each text's first word."""
    solid = _WORD[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    begins[inner] = solid[inner]
    start = np.flatnonzero(begins)
    word = np.cumsum(begins) - 1
    kept = np.flatnonzero(solid)
    size = np.bincount(word[kept], minlength=len(start)) if len(start) else np.zeros(0, np.int64)
    out = np.full(len(kept) + len(start), 32, np.uint8)
    out[np.arange(len(kept)) + word[kept]] = _LOWER[data[kept]]
    end = np.cumsum(size + 1) - 1
    return out, end - size, end, np.searchsorted(start, offsets)


def text_buckets(data: np.ndarray, offsets: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' features as buckets, text after text; each text's first one, and its words."""
    flat, start, end, first = words(data, offsets)
    count = np.diff(first)
    found, of = [], []
    text = np.repeat(np.arange(len(count)), count)
    for k in range(1, n + 1):
        ok = np.flatnonzero(np.arange(len(start)) + k <= np.repeat(first[1:], count))
        found.append(crc32s(flat, start[ok], end[ok + k - 1]) % np.uint32(buckets))
        of.append(text[ok])
    found, of = np.concatenate(found).astype(np.uint16), np.concatenate(of)
    if n > 1:
        order = np.argsort(of, kind="stable")
        found, of = found[order], of[order]
    return found, np.searchsorted(of, np.arange(len(count) + 1)), count


def _feature_rows(n: int, buckets: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, offsets in K.blocks(batch.column(2), 1 << 20):
                found, first, count = text_buckets(data, offsets, n, buckets)
                raw, cut = found.astype("<u2").tobytes(), (2 * first).tolist()
                packed = pa.array([raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
                own = [batch.column(k).slice(begin, end - begin) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(count, pa.int64()), pa.array(np.diff(first), pa.int64()), packed], names=[x.split()[0] for x in FEATURES.split(", ")])

    return rows


def _bucket_rows(buckets: int):
    """(bucket, n): a task's features by bucket, copies counted; a row per bucket."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for copies, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total += copies * np.bincount(np.frombuffer(raw, "<u2"), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["bucket", "n"])

    return rows


def _weight_rows(gain: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(3).to_pylist()
            weight = np.fromiter((gain[np.frombuffer(x, "<u2")].sum() for x in raw), np.int64, len(raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(weight)], names=["digest", "n_words", "n_features", "weight"])

    return rows


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def features(docs: DataFrame, text: str = "text", n: int = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """(FEATURES) of each distinct text, null being empty; ``copies``: how many rows have it."""
    if not 0 < buckets <= 1 << 16 or n < 1:
        raise ValueError("1 to 65536 buckets and runs of 1 or more words")
    texts = docs.groupBy(F.coalesce(F.col(text), F.lit("")).alias("whole")).agg(F.count("*").alias("copies"))
    return map_batches(texts.select(digest(F.col("whole")).alias("digest"), "copies", "whole"), _feature_rows(n, buckets), FEATURES)


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features by bucket, copies counted: one number per bucket comes to the driver."""
    rows = map_batches(found.select("copies", "buckets"), _bucket_rows(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    s, t, more = corpus.astype(np.float64), target.astype(np.float64), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + more) / ((s + 1) * (t.sum() + more)))).astype(np.int64)


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise of an id, in thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", n: int = RUNS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, share: int = SHARE, seed: int = SEED) -> DataFrame:
    """Every row's doc_id, n_features, weight, score and rank; rank is null beyond the ``share`` hundredths of the rows with at
    least ``least_words`` words that are drawn."""
    found = settle(features(docs, text, n, buckets))
    gain = gains(bucket_counts(found, buckets), bucket_counts(features(target, text, n, buckets), buckets))
    weights = map_batches(found.select("digest", "n_words", "n_features", "buckets"), _weight_rows(gain), "digest binary, n_words long, n_features long, weight long")
    own = docs.select(F.col(key).cast("long").alias("doc_id"), digest(F.col(text)).alias("digest"))
    x = own.join(weights, "digest", "left").withColumn("enough", F.col("n_words") >= least_words).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    # rows that agree in all else are told apart by where they were read, so that no range holds them all
    order = [F.desc("enough"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("read")]
    ordered = settle(x.select("doc_id", "n_features", "weight", "score", "enough", F.monotonically_increasing_id().alias("read")).orderBy(*order))
    # a settled table keeps its partitions and their order: the id is the partition's number, 33 bits, and the row's place
    ordered = ordered.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33))
    before, at, enough = {}, 0, 0
    sizes = ordered.groupBy("part").agg(F.count("*").alias("n"), F.count_if("enough").alias("enough")).orderBy("part").collect()  # a row per partition
    for r in sizes:
        before[r["part"]], at, enough = at, at + r["n"], enough + r["enough"]
    starts = F.broadcast(ordered.sparkSession.createDataFrame(list(before.items()), "part long, before long"))
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    return ordered.join(starts, "part", "left").select("doc_id", "n_features", "weight", "score", F.when(rank <= share * enough // 100, rank).alias("rank"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
u AS (SELECT text, count(*) AS copies FROM d GROUP BY text),
b AS (SELECT coalesce(text, '') AS text FROM benchmark),
w AS (SELECT text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
      FROM (SELECT text FROM u UNION SELECT text FROM b)),
f AS (SELECT text, w, count(*) AS n FROM w GROUP BY text, w),
tab AS (SELECT list(c ORDER BY x) AS tab FROM (SELECT x, list_reduce([x::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
          lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS x))),
hexed AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM f)),
crc AS (SELECT w, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, len(h) // 2 + 1), lambda i: ('0x' || substr(h, (2 * i - 1)::BIGINT, 2))::UBIGINT)),
          lambda c, x: xor(c // 256, tab[(xor(c, x) % 256 + 1)::BIGINT])), 4294967295::UBIGINT) % 10000 AS bucket FROM hexed, tab),
s AS (SELECT bucket, sum(n * copies)::DOUBLE AS s FROM f JOIN u USING (text) JOIN crc USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n)::DOUBLE AS t FROM b JOIN f USING (text) JOIN crc USING (w) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000) / ((coalesce(s, 0) + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000))))::BIGINT AS gain
      FROM s FULL JOIN t USING (bucket)),
x AS (SELECT text, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM f JOIN crc USING (w) JOIN g USING (bucket) GROUP BY text),
scored AS (
  SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN x USING (text)),
ranked AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) END AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) FILTER (n_features >= 20) * 10 // 100 FROM scored) THEN place END AS rank FROM ranked
"""

QUERIES = {"op12_resampling": op12_resampling}
SQL = {"op12_resampling": OP12_SQL}
