"""Quality rules: base counts, and repetition measured on a word-level suffix array.

Repeats are found within each document. Words that lie in no repeated ``least``-word window cannot be in a repeat of
that length, so the suffix array is built (by prefix doubling) over the remaining stretches of all documents of a
block at once, each closed by a symbol of its own. The longest-common-prefix intervals of the array are the maximal
repeated substrings; a suffix lies in the interval given by the larger of its two neighbouring values, so the union of
all spans comes from those, and the longest repeat is the largest of them. A document is kept if it passes the base
rules, repeats cover at most ``fraction`` of its words, and none is longer than ``longest`` words.

Defined cases: null and empty texts have no words and fail the base rules; repeated rows are judged alike; very long
texts are a block of their own; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cobordia.llm import textkernel as K
from cobordia.session import map_batches, table

LEAST, FRACTION, LONGEST = 10, 0.5, 100
SYMBOLS = b"#*$%&|<>"
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "covered_words long, longest_repeat long, base_failed boolean, kept boolean"
)
_U = np.uint64
_IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))


def _per_document(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of true flags in each document's bytes."""
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _own(hashed: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that differ between documents."""
    return K.mix(hashed ^ K.mix(doc.astype(np.uint64) + _U(1)))


def duplicate_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each document, its lines with a word that equal an earlier line."""
    docs = len(offsets) - 1
    if not len(data):
        return np.zeros(docs, np.int64)
    breaks = np.flatnonzero(data == 10)
    some = np.unique(offsets[:-1][np.diff(offsets) > 0])
    start = np.sort(np.concatenate((some, breaks + 1)))
    doc = np.searchsorted(offsets, start, "right") - 1
    # a text that ends with a line break has an empty last line, which the next text's start or the end stands for
    start, doc = start[start < len(data)], doc[start < len(data)]
    stop = np.empty(len(data), bool)
    stop[:] = data == 10
    at = np.append(np.flatnonzero(stop), len(data))
    end = np.minimum(at[np.searchsorted(at, start)], offsets[doc + 1])
    solid = np.concatenate(([0], np.cumsum(~K._SPACE[data])))
    worded = solid[end] > solid[start]
    start, end, doc = start[worded], end[worded], doc[worded]
    start, keep = np.unique(start, return_index=True)
    end, doc = end[keep], doc[keep]
    hashed = _own(K.span_hashes(K.prefixes(data), start, end), doc)
    _, once = np.unique(hashed, return_index=True)
    return np.bincount(doc, minlength=docs) - np.bincount(doc[once], minlength=docs)


def repeated(hashed: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """First words of the ``n``-word windows that occur twice or more in their document, ascending."""
    g, at = K.grams(hashed, first, n, short=False)
    if not len(g):
        return np.zeros(0, np.int64)
    each = np.diff(at)
    doc = np.repeat(np.arange(len(each)), each)
    order = np.argsort(key := _own(g, doc))
    key = key[order]
    same = key[1:] == key[:-1]
    twice = np.zeros(len(key), bool)
    twice[1:] |= same
    twice[:-1] |= same
    where = np.sort(order[twice])
    return where + (first[:-1] - at[:-1])[doc[where]]


def cover(starts: np.ndarray, lengths: np.ndarray | int, total: int) -> np.ndarray:
    """Which of ``total`` places lie in one of the spans."""
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:-1]) > 0


def suffix_repeats(symbols: np.ndarray) -> np.ndarray:
    """For each suffix, its longest common prefix with any other: the larger neighbouring value in the suffix array."""
    n = len(symbols)
    # a block of text is below 2**31 words, so each of the log n levels takes 4 bytes a symbol
    ranks = [np.unique(symbols, return_inverse=True)[1].astype(np.int32)]
    step = 1
    while ranks[-1].max() < n - 1 and step < n:
        both = ranks[-1].astype(np.int64) * (n + 1)
        both[: n - step] += ranks[-1][step:] + 1
        ranks.append(np.unique(both, return_inverse=True)[1].astype(np.int32))
        step *= 2
    order = np.argsort(ranks[-1])
    a, b = order[:-1], order[1:]
    common = np.zeros(n - 1, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        # the ranks of level k compare 2**k symbols; a shorter rest of the text never equals a full one
        x, y = a + common, b + common
        inside = np.maximum(x, y) + (1 << k) <= n
        same = np.zeros(n - 1, bool)
        same[inside] = ranks[k][x[inside]] == ranks[k][y[inside]]
        common += same.astype(np.int64) << k
    best = np.zeros(n, np.int64)
    best[a] = common
    best[b] = np.maximum(best[b], common)
    return best


def repetition(hashed: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document: words in repeats of ``least`` words or more, and the length of the longest repeat."""
    docs = len(first) - 1
    covered, longest = np.zeros(docs, np.int64), np.zeros(docs, np.int64)
    starts = repeated(hashed, first, least)
    if not len(starts):
        return covered, longest
    count = np.diff(first)
    doc = np.repeat(np.arange(docs), count)
    inside = cover(starts, least, len(hashed))
    place = np.flatnonzero(inside)
    # a closing symbol of its own after each stretch and at each document's end
    closes = np.ones(len(place), bool)
    closes[:-1] = (np.diff(place) > 1) | (doc[place[1:]] != doc[place[:-1]])
    new = np.arange(len(place)) + np.concatenate(([0], np.cumsum(closes)[:-1]))
    n = len(place) + int(closes.sum())
    symbols = np.arange(n).astype(np.uint64)
    symbols[new] = _own(hashed[place], doc[place]) | _U(1 << 63)
    at = np.full(n, -1, np.int64)
    at[new] = place
    best = suffix_repeats(symbols)
    good = np.flatnonzero((best >= least) & (at >= 0))
    marks = cover(at[good], best[good], len(hashed))
    covered += np.bincount(doc[marks], minlength=docs)
    np.maximum.at(longest, doc[at[good]], best[good])
    return covered, longest


def judge(least: int, fraction: float, longest: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0)
            for begin, end, data, offsets in K.blocks(batch.column(1)):
                _, _, hashed, first = K.words(data, offsets, lower=False)
                words = np.diff(first)
                doc = np.repeat(np.arange(len(words)), words)
                solid = ~K._SPACE[data]
                again = cover(repeated(hashed, first, 3), 3, len(hashed))
                again = np.bincount(doc[again], minlength=len(words))
                covered, most = repetition(hashed, first, least)
                failed = (words < 50) | (100 * again > 50 * words)
                out = [
                    words, _per_document(solid & ((data & 0xC0) != 0x80), offsets), _per_document(_IS_SYMBOL[data], offsets),
                    duplicate_lines(data, offsets), again, covered, most, failed, ~failed & (covered <= fraction * words) & (most <= longest),
                ]
                yield pa.RecordBatch.from_arrays([key.slice(begin, end - begin).cast(pa.int64()), *map(pa.array, out)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return rows


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, fraction: float = FRACTION, longest: int = LONGEST) -> DataFrame:
    """One row per document with its counts and the verdict ``kept``."""
    return map_batches(docs.select(F.col(key).cast("long"), F.col(text)), judge(least, fraction, longest), SCHEMA)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("longest_repeat")


#: A word is in a maximal repeat of 10 words or more if it is in a 10-word window found twice; a repeat is longer than 100
#: words if a 101-word window is found twice.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT row, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT row, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row),
p AS (SELECT row, i, CASE WHEN i + 2 <= n THEN md5(array_to_string(w[i:i+2], ' ')) END AS g3, CASE WHEN i + 9 <= n THEN md5(array_to_string(w[i:i+9], ' ')) END AS g10 FROM (SELECT row, w, len(w) AS n, unnest(range(1, len(w) + 1)) AS i FROM d)),
r AS (SELECT row, i, g3 IS NOT NULL AND count(*) OVER (PARTITION BY row, g3) > 1 AS r3, g10 IS NOT NULL AND count(*) OVER (PARTITION BY row, g10) > 1 AS r10 FROM p),
b AS (SELECT row, true AS longer FROM (SELECT row, md5(array_to_string(w[i:i+100], ' ')) AS g FROM r JOIN d USING (row) WHERE r10 AND i + 100 <= len(w)) GROUP BY row HAVING count(*) > count(DISTINCT g)),
c AS (SELECT row, bool_or(r3) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c3, bool_or(r10) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS c10 FROM r),
s AS (SELECT row, count(*) FILTER (c3) AS n_repeat_words, count(*) FILTER (c10) AS covered_words FROM c GROUP BY row),
x AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(covered_words, 0)::BIGINT AS covered_words, coalesce(longer, false) AS longer
      FROM d LEFT JOIN l USING (row) LEFT JOIN s USING (row) LEFT JOIN b USING (row))
SELECT * EXCLUDE (longer), n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND covered_words <= 0.5 * n_words AND NOT longer AS kept FROM x
"""

QUERIES = {"op10_quality": op10_quality}
SQL = {"op10_quality": OP10_SQL}
