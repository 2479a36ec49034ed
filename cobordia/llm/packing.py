"""Packing: best-fit decreasing over token counts, planned on the histogram of lengths.

Every document is tokenised in whole, cut into full windows and one remainder. Best-fit decreasing depends only on how
many remainders have each length, so the plan is made on at most ``window`` counts, whatever the corpus: a segment tree
indexed by remaining capacity finds the tightest open windows, and all windows with that capacity take pieces of the
current length at once. The plan (runs of equal placements) is the same size for a thousand documents and for a
trillion; each piece finds its run by its length and its number among pieces of that length.

Defined cases: null and empty texts are a single end-of-text id; equal documents and repeated rows are packed
separately; very long texts give full windows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cobordia.llm import textkernel as K
from cobordia.session import map_batches, settle, table

WINDOW, END_ID, GROUP = 4096, 2, 1 << 18
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = PIECES + ", sequence_id long, offset long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Token ids of many documents at once, by a table of the units that were met.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its words, looked up with
    A-Z in lower case (its normalizer does that anyway). Letters before punctuation are a token group of their own:
    "word", "word," and "word." share a unit. Runs of letters are encoded by the thousand in one call and cut at the
    tokens that end a word. The table knows units by a 64-bit hash and starts afresh beyond ``most``.
    """

    MARKS = b".,;:!?%&$*#"

    def __init__(self, path: str, most: int = 500_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.mark = np.isin(np.arange(256), np.frombuffer(self.MARKS, np.uint8))
        self.letter = np.isin(np.arange(256), np.frombuffer(bytes(range(65, 91)) + bytes(range(97, 123)), np.uint8))
        self.clear()

    def clear(self) -> None:
        self.index = K.Places()
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.pool, self.used = np.zeros(1 << 18, np.uint32), 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def letters(self, runs: list[str]) -> list[np.ndarray]:
        """Ids of runs of letters, each one token group."""
        if not runs:
            return []
        ids = np.concatenate(self.encode([" ".join(runs[i : i + 1000]) for i in range(0, len(runs), 1000)]))
        at = np.concatenate(([0], np.flatnonzero(self.ends[ids]) + 1))
        if len(at) != len(runs) + 1:
            return self.encode(runs)
        return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def learn(self, new: np.ndarray, units: list[bytes]) -> None:
        """Enter the units under their hashes, which ascend."""
        ids: list[np.ndarray | None] = [None] * len(units)
        whole, parts, rest = [], [], []
        for i, unit in enumerate(units):
            text = unit.decode()
            if text.isalpha():
                whole.append((i, text))
                continue
            core = unit.rstrip(self.MARKS).decode()
            (parts.append((i, core, text[len(core) :])) if core and core.isalpha() else rest.append((i, text)))
        for (i, _), x in zip(whole, self.letters([t for _, t in whole]), strict=True):
            ids[i] = x
        tails = sorted({t for _, _, t in parts})
        tails = dict(zip(tails, self.encode(tails), strict=True))
        for (i, _, tail), x in zip(parts, self.letters([c for _, c, _ in parts]), strict=True):
            ids[i] = np.concatenate((x, tails[tail]))
        for (i, _), x in zip(rest, self.encode([t for _, t in rest]), strict=True):
            ids[i] = x
        at = len(self.index)
        self.index.add(new)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        while len(self.start) < at + len(ids):
            self.start, self.size = np.concatenate((self.start, self.start)), np.concatenate((self.size, self.size))
        end = self.used + int(size.sum())
        while len(self.pool) < end:
            self.pool = np.concatenate((self.pool, self.pool))
        self.pool[self.used : end] = np.concatenate(ids) if ids else []
        self.start[at : at + len(ids)] = self.used + np.cumsum(size) - size
        self.size[at : at + len(ids)] = size
        self.used = end

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All documents' ids, one after another, and each document's first one (one more entry than documents)."""
        start, end, first = K.word_spans(data, offsets)
        core = end.copy()
        open_ = np.arange(len(core))
        while len(open_ := open_[(core[open_] > start[open_]) & self.mark[data[core[open_] - 1]]]):
            core[open_] -= 1
        plain = np.concatenate(([0], np.cumsum(self.letter[data], dtype=np.int32)))
        cut = (core < end) & (core > start) & (plain[core] - plain[start] == core - start)
        # a word that is cut is two units: its letters and its marks
        place = np.arange(len(start)) + np.cumsum(cut) - cut
        begin, stop = np.empty(len(start) + int(cut.sum()), np.int64), np.empty(len(start) + int(cut.sum()), np.int64)
        begin[place], stop[place] = start, np.where(cut, core, end)
        begin[place[cut] + 1], stop[place[cut] + 1] = core[cut], end[cut]
        uniq, at, back = np.unique(K.span_hashes(K.prefixes(data, lower=True), begin, stop), return_index=True, return_inverse=True)
        found = self.index.find(uniq)
        new = np.flatnonzero(found < 0)
        if len(new):
            if len(self.index) + len(new) > self.most:
                self.clear()
                new = np.arange(len(uniq))
            raw, held = data.tobytes().lower(), len(self.index)
            self.learn(uniq[new], [raw[a:b] for a, b in zip(begin[at[new]].tolist(), stop[at[new]].tolist(), strict=True)])
            found[new] = held + np.arange(len(new))
        where = found[back]
        size = self.size[where]
        upto = np.concatenate(([0], np.cumsum(size)))
        ids = self.pool[np.repeat(self.start[where] - upto[:-1], size) + np.arange(upto[-1])]
        of_word = np.concatenate((place, [len(begin)]))
        return ids, upto[of_word[first]]


def piece_rows(path: str, window: int, end_id: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last = K.held(f"packing {path}", lambda: WordIds(path)), np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            key, text = batch.column(0), batch.column(1)
            for begin, _, data, offsets in K.blocks(text):
                ids, first = known.of(data, offsets)
                raw, special = ids.astype("<u4").tobytes(), b"<|" in data.tobytes()
                out: list[tuple[int, int, int, int, int]] = []
                for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    x = raw[4 * a : 4 * b]
                    if special and b"<|" in (whole := data[offsets[d] : offsets[d + 1]].tobytes()):
                        x = known.encode([whole.decode()])[0].astype("<u4").tobytes()  # special tokens, in their case only
                    x += last
                    n = len(x) // 4
                    out += [(begin + d, at, min(window, n - at), zlib.crc32(x[4 * at : 4 * (at + window)]), n) for at in range(0, n, window)]
                row, *rest = np.asarray(out, np.int64).T
                yield pa.RecordBatch.from_arrays([key.take(pa.array(row)).cast(pa.int64()), *map(pa.array, rest)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return rows


class Tightest:
    """Segment tree over remaining capacity: which capacities have open windows, and the smallest of at least some size."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << most.bit_length()
        self.open = np.zeros(2 * self.leaves, bool)

    def put(self, capacity: int, some: bool) -> None:
        at = self.leaves + capacity
        self.open[at] = some
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]

    def at_least(self, size: int) -> int | None:
        at = self.leaves + size
        if self.open[at]:
            return size
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def plan(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing of ``counts[length]`` pieces: runs (length, first number, how many, first window, offset).
    Windows are numbered from 0; a run puts its pieces into consecutive windows at one offset."""
    tree, spare, runs, made = Tightest(window), {}, [], 0
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        number, left = 0, counts[length]
        while left:
            room = tree.at_least(length)
            if room is None:
                # a new window takes as many pieces of this length as fit, one after another
                each = window // length
                for k in range(each):
                    lot = (left + each - 1 - k) // each
                    if lot:
                        runs.append((length, number, lot, made, k * length))
                        number += lot
                full, rest = divmod(left, each)
                for first, lot, free in ((made, full, window - each * length), (made + full, 1 if rest else 0, window - rest * length)):
                    if lot and free:
                        spare.setdefault(free, []).append((first, lot))
                        tree.put(free, True)
                made += full + (1 if rest else 0)
                left = 0
                continue
            held = spare[room]
            while held and left:
                first, lot = held.pop()
                use = min(lot, left)
                if use < lot:
                    held.append((first + use, lot - use))
                runs.append((length, number, use, first, window - room))
                number, left = number + use, left - use
                if room > length:
                    spare.setdefault(room - length, []).append((first, use))
                    tree.put(room - length, True)
            if not held:
                tree.put(room, False)
    return runs


def place_rows(runs: list[tuple[int, int, int, int, int]], full_before: int):
    at = np.asarray(sorted(runs), np.int64).reshape(-1, 5)
    base = 1 << 48

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = at[:, 0] * base + at[:, 1]
        for batch in batches:
            x = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "number")}
            run = at[np.searchsorted(key, x["length"] * base + x["number"], "right") - 1]
            sequence = full_before + run[:, 3] + x["number"] - run[:, 1]
            kept = [batch.column(n) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(run[:, 4])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return rows


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, window: int = WINDOW, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = path or tokenizer_path()
    pieces = settle(map_batches(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), piece_rows(path, window, end_id), PIECES))
    totals = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``window`` rows
    # number the pieces of each length in salted groups of about GROUP, as many as the length needs, so that no task sorts
    # more than that, however many full windows there are
    salts = F.broadcast(pieces.sparkSession.createDataFrame([(k, max(16, -(-n // group))) for k, n in totals.items()], "length long, salts long"))
    salted = pieces.join(salts, "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), "salts")).drop("salts")
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    counts = counts.withColumn("before", before)
    full = totals.pop(window, 0)
    runs = [(window, 0, full, -full, 0)] * bool(full) + plan(totals, window)
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1
    numbered = salted.withColumn("within", within).join(counts.select("length", "salt", "before"), ["length", "salt"])
    numbered = numbered.withColumn("number", (F.col("before") + F.col("within")).cast("long")).drop("before", "within", "salt")
    return map_batches(numbered, place_rows(runs, full), PLACED)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op7_packing": op7_packing}
SQL: dict[str, str] = {}
