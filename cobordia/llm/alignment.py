"""Cross-tokenizer alignment: tokens of one vocabulary (A) against those of another (B) over the same bytes.

The byte intervals of a text's B tokens form a static index, their sorted starts. Each A token stabs it by bisection for
the list of B tokens it overlaps; a gap between two A tokens that no listed B token spans is a group boundary. All pairs of
an A and a B token in one group are links.

Both tokenizers start afresh at a single space between two characters that are no white space: byte-level pre-tokens take
the space to what follows, and no piece of the other vocabulary has a space after another character (checked when it is
loaded; else texts are not cut). So a text is a row of units, a space and what follows up to the next such place, and its
tokens, groups and links are those of its units, each aligned once. Workers keep units between tasks and start afresh,
after a block of texts, beyond ``UNITS`` units or ``UNIT_BYTES`` bytes.

How many documents hold an id pair linked is counted over all documents: distinct pairs per document, summed per task, then
by pair. The counts go back to the documents by a join on the pair, which is a broadcast where at most ``SMALL`` pairs were
counted and a shuffle beyond that.

Defined cases: texts that are null or empty, or that a vocabulary does not give back byte by byte (U+2581 in B), have no
tokens, zeros and '' as digest; repeated rows, and rows that share a doc_id, are documents of their own and count
apart; very long texts are aligned in whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cobordia.llm import textkernel as K
from cobordia.session import map_batches, settle, table

UNITS, UNIT_BYTES, SMALL, HELD = 250_000, 24 << 20, 1 << 20, 1 << 20
COLUMNS = ("n_a", "n_b", "n_groups", "n_links")
ENCODED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
#: A pair of ids is one number: A's id times this, plus B's.
WIDE = 1 << 16
_CUT = re.compile(r"(?<=\S) (?=\S)")


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each A token's first and last overlapping B token: stabbing queries, by bisection, on the index of B's starts."""
    index = np.concatenate(([0], b_ends[:-1]))
    return np.searchsorted(index, np.concatenate(([0], a_ends[:-1])), "right") - 1, np.searchsorted(index, a_ends, "left") - 1


def groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First A and first B token of each group of tokens over the same bytes, and after the last the numbers of tokens."""
    if not len(a_ends):
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    first, last = overlaps(a_ends, b_ends)
    cut = np.concatenate(([0], np.flatnonzero(first[1:] > last[:-1]) + 1))
    return np.append(cut, len(a_ends)), np.append(first[cut], len(b_ends))


def byte_letters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others are
    numbered from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


class ByteLevel:
    """Ids and bytes of a byte-level vocabulary; special tokens are ordinary text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, letters = Tokenizer.from_file(path), byte_letters()
        self.tokenizer.encode_special_tokens = True
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes = [b""] * (max(names.values()) + 1)
        for token, i in names.items():
            self.bytes[i] = bytes(letters[c] for c in token)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """Ids and bytes of a piece vocabulary that puts a space before each text and falls back to bytes."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        #: no piece has a space after another character, so none spans two units
        self.cuts = not any(re.search("[^▁]▁", p) for p in names)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def _edged(unit: str) -> bool:
    return not unit or unit[0].isspace() or unit[-1].isspace()


class Units:
    """Aligned units in arrays: counts, the digest's tokens, and distinct id pairs with their links.

    New units are encoded many at a time as one text, in which they stand as in any other: tokens, groups and links of the
    whole are cut at their ends. Those with white space at an end (only ends of a text are such) are encoded alone.
    """

    def __init__(self, a_path: str, b_path: str, most: int = UNITS, most_bytes: int = UNIT_BYTES) -> None:
        self.a, self.b, self.most, self.most_bytes = ByteLevel(a_path), Pieces(b_path), most, most_bytes
        self.sizes = [np.fromiter(map(len, x.bytes), np.int64, len(x.bytes)) for x in (self.a, self.b)]
        #: a token of the digest: its id, and what comes after it
        ids = max(len(self.a.bytes), len(self.b.bytes))
        self.written = [b"%d%s" % (i, after) for i in range(ids) for after in (b",", b"|", b";")]
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.edged: set[str] = set()  # parts that begin or end with white space: no units but at a text's ends
        self.good = np.zeros(0, bool)  # given back byte by byte
        self.numbers = np.zeros((0, len(COLUMNS)), np.int64)
        self.said_at, self.said = np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.first, self.pairs, self.times = np.zeros(1, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        self.bytes = 0

    def trim(self) -> None:
        if len(self.place) + len(self.edged) > self.most or self.bytes > self.most_bytes:
            self.clear()

    def ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """A's and B's ids of the units as one text, or None if its bytes do not come back."""
        text = " ".join(units)
        a, b = self.a.encode([text])[0], self.b.encode([text])[0]
        raw = b" " + text.encode()
        if b"".join([self.a.bytes[i] for i in a]) != raw or b"".join([self.b.bytes[i] for i in b]) != raw:
            return None
        return np.asarray(a, np.int64), np.asarray(b, np.int64)

    def learn(self, units: list[str], lot: int = 400, most: int = 20_000) -> None:
        for k in range(0, len(units), most):
            some = units[k : k + most]
            alone = [u for u in some if _edged(u)]
            rest = [u for u in some if not _edged(u)] if alone else some
            lots = [rest[i : i + lot] for i in range(0, len(rest), lot)] if self.b.cuts else [[u] for u in rest]
            found = [(x, self.ids(x)) for x in [*lots, *([u] for u in alone)]]
            found = [(y, z) for x, ids in found for y, z in ([(x, ids)] if ids is not None or len(x) == 1 else [([u], self.ids([u])) for u in x])]
            self.enter([u for x, ids in found if ids is not None for u in x], [ids for _, ids in found if ids is not None])
            self.enter([x[0] for x, ids in found if ids is None], None)

    def enter(self, units: list[str], ids: list[tuple[np.ndarray, np.ndarray]] | None) -> None:
        if not units:
            return
        size = np.fromiter((len(u.encode()) + 1 for u in units), np.int64, len(units))
        self.place.update(zip(units, range(len(self.good), len(self.good) + len(units)), strict=True))
        self.bytes += 2 * int(size.sum())
        self.good = np.concatenate((self.good, np.full(len(units), ids is not None)))
        none = np.zeros(0, np.int64)
        a, b = (np.concatenate([none, *(x[k] for x in ids or ())]) for k in (0, 1))
        ends = [np.cumsum(s[x]) for s, x in zip(self.sizes, (a, b), strict=True)]
        a_first, b_first = groups(*ends)
        upto = np.cumsum(size) if ids is not None else np.zeros(len(units), np.int64)
        last = ends[0][a_first[1:] - 1] if len(a) else none  # where each group ends
        group_at, a_at, b_at = (np.concatenate(([0], np.searchsorted(x, upto, "right"))) for x in (last, *ends))
        a_size, b_size = np.diff(a_first), np.diff(b_first)
        links = np.concatenate(([0], np.cumsum(a_size * b_size)))
        self.numbers = np.concatenate((self.numbers, np.column_stack((np.diff(a_at), np.diff(b_at), np.diff(group_at), np.diff(links[group_at])))))
        # the digest's tokens: of each group A's, then B's
        group = np.arange(len(a_size))
        said = np.empty(len(a) + len(b), np.int32)
        a_ends = np.isin(np.arange(len(a)), a_first[1:] - 1)
        b_ends = np.isin(np.arange(len(b)), b_first[1:] - 1)
        said[np.arange(len(a)) + np.repeat(b_first[:-1], a_size)] = 3 * a + a_ends
        said[np.arange(len(b)) + np.repeat(a_first[1:], b_size)] = 3 * b + 2 * b_ends
        self.said_at = np.concatenate((self.said_at, len(self.said) + (a_at + b_at)[1:]))
        self.said = np.concatenate((self.said, said))
        # links of each group, all pairs of its distinct ids
        unit = np.repeat(np.arange(len(units)), np.diff(group_at))
        a_group, a_id, a_n = self.distinct(group, a_size, a)
        b_group, b_id, b_n = self.distinct(group, b_size, b)
        b_first, b_size = np.searchsorted(b_group, group), np.bincount(b_group, minlength=len(group))
        times = b_size[a_group]
        back = np.repeat(np.arange(len(a_group)), times)
        other = np.arange(len(back)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(b_first[a_group], times)
        keys = unit[a_group[back]].astype(np.uint64) << np.uint64(32) | (a_id[back] * WIDE + b_id[other]).astype(np.uint64)
        keys, n = _grouped(keys, a_n[back] * b_n[other])
        own = np.searchsorted(keys >> np.uint64(32), np.arange(1, len(units) + 1, dtype=np.uint64))
        self.first = np.concatenate((self.first, len(self.pairs) + own))
        self.pairs = np.concatenate((self.pairs, (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)))
        self.times = np.concatenate((self.times, n.astype(np.uint32)))
        self.bytes += 4 * len(said) + 8 * len(keys)

    @staticmethod
    def distinct(group: np.ndarray, size: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Group, id and occurrences of each group's distinct ids, ascending."""
        keys, n = _grouped(np.repeat(group, size) << 17 | ids, np.ones(len(ids), np.int64))
        return keys >> 17, keys & 0x1FFFF, n

    def of(self, texts: list[str]) -> list[list[str]]:
        """The texts' units, all of them learned."""
        parts = [t.split(" ") for t in texts] if self.b.cuts else [[t] for t in texts]
        if self.b.cuts:
            new = set().union(*parts).difference(self.place, self.edged)
            self.edged.update(filter(_edged, new))
            for d, own in enumerate(parts):
                if not self.edged.isdisjoint(own):
                    parts[d] = _CUT.split(texts[d])
        self.learn(sorted(set().union(*parts).difference(self.place)))
        return parts


def _grouped(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values, first) if len(first) else values


def _spread(first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all that units ``which`` have in an array cut by ``first``, and how many each has."""
    width = first[which + 1] - first[which]
    upto = np.cumsum(width)
    return np.repeat(first[which] - upto + width, width) + np.arange(upto[-1] if len(upto) else 0), width


def aligned(units: Units, texts: list[str]) -> list[tuple]:
    """For each text: the numbers of COLUMNS, digest, distinct pairs and their links, ascending by pair."""
    parts = units.of(texts)
    sizes = [len(p) for p in parts]
    at = np.fromiter((units.place[u] for p in parts for u in p), np.int64, sum(sizes))
    first = np.concatenate(([0], np.cumsum(sizes)))
    total = np.concatenate((np.zeros((1, len(COLUMNS)), np.int64), np.cumsum(units.numbers[at], axis=0)))
    numbers = total[first[1:]] - total[first[:-1]]
    # each document's distinct units, then their pairs
    keys, n = _grouped(np.repeat(np.arange(len(texts)), sizes) << 32 | at, np.ones(len(at), np.int64))
    doc, unit = keys >> 32, keys & 0xFFFFFFFF
    where, width = _spread(units.first, unit)
    keys, n = _grouped(np.repeat(doc, width).astype(np.uint64) << np.uint64(32) | units.pairs[where], units.times[where].astype(np.int64) * np.repeat(n, width))
    cut = np.searchsorted(keys >> np.uint64(32), np.arange(len(texts) + 1, dtype=np.uint64)).tolist()
    pairs, times = (keys & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), n.astype("<u4").tobytes()
    out, written = [], units.written
    for d, text in enumerate(texts):
        own = at[first[d] : first[d + 1]]
        if not text or not units.good[own].all():
            out.append((0, 0, 0, 0, "", b"", b""))
        else:
            span, said = slice(4 * cut[d], 4 * cut[d + 1]), units.said[_spread(units.said_at, own)[0]].tolist()
            out.append((*numbers[d].tolist(), sha256(b"".join([written[k] for k in said])[:-1]).hexdigest(), pairs[span], times[span]))
    units.trim()
    return out


def _aligned_rows(a_path: str, b_path: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = K.held(f"alignment {a_path} {b_path}", lambda: Units(a_path, b_path))
        for batch in batches:
            for begin, end, data, offsets in K.blocks(batch.column(1)):
                raw = data.tobytes()
                texts = [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                columns = list(zip(*aligned(units, texts), strict=True))
                kinds = [pa.int64()] * len(COLUMNS) + [pa.string(), pa.binary(), pa.binary()]
                arrays = [batch.column(0).slice(begin, end - begin), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in ENCODED.split(", ")])

    return rows


def _counted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n): how many of the task's documents hold each pair, a bounded part of them at a time."""

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(n)], names=["pair", "n"])

    pairs, n = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    for batch in batches:
        own = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4")
        for k in range(0, len(own), HELD):
            lot = own[k : k + HELD]
            pairs, n = _grouped(np.concatenate((pairs, lot)), np.concatenate((n, np.ones(len(lot), np.int64))))
            if len(pairs) > HELD:
                yield out()
                pairs, n = pairs[:0], n[:0]
    yield out()


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, pair, times): a row for each distinct pair of a document."""
    for batch in batches:
        raw = batch.column(1).to_pylist()
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        pairs, times = (np.frombuffer(b"".join(x), "<u4").astype(np.int64) for x in (raw, batch.column(2).to_pylist()))
        row = np.repeat(batch.column(0).to_numpy(), size)
        for k in range(0, len(row), HELD):
            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + HELD]) for x in (row, pairs, times)], names=["row", "pair", "times"])


def paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def pair_counts(encoded: DataFrame) -> DataFrame:
    """(pair, a, b, n, best): in how many documents each id pair is linked, and whether that is A's id's highest."""
    n = map_batches(encoded.select("pairs"), _counted_rows, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    n = n.select("pair", F.floor(F.col("pair") / WIDE).alias("a"), (F.col("pair") % WIDE).alias("b"), "n")
    # an A id's rows are at most as many as B has ids
    return n.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a")))


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", a_path: str | None = None, b_path: str | None = None, small: int = SMALL) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    own = paths()
    rows = _aligned_rows(a_path or own[0], b_path or own[1])
    encoded = settle(map_batches(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), rows, ENCODED))
    encoded = encoded.withColumn("row", F.monotonically_increasing_id())  # rows and partitions of a settled table stay
    counts = settle(pair_counts(encoded).select("pair", "n", "best"))
    counts = F.broadcast(counts) if counts.limit(small + 1).count() <= small else counts.hint("merge")
    linked = map_batches(encoded.select("row", "pairs", "times"), _pair_rows, "row long, pair long, times long").join(counts, "pair")
    sums = linked.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    out = encoded.drop("pairs", "times").join(sums, "row", "left")
    return out.select("doc_id", *COLUMNS, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))


QUERIES = {"op11_alignment": op11_alignment}
SQL: dict[str, str] = {}
