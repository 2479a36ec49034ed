"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters, one verification a pair.

Documents are sets of distinct 5-word shingles; two link when 100 * |x & y| >= 80 * |x | y|. Copies of one set are one
node from the start. Shingles are ordered by the number of documents that have them, rarest first, so that a pair over
the threshold shares one within the first n - ceil(0.8 n) + 1 of each. The steps:

1. Sets, their sizes and a 64-bit fingerprint of each set, which is the set's node: rows of equal sets are one node.
2. Frequencies. Every task packs its documents' shingles by ranges of the hash space into binary blocks. A shingle that
   several documents of a task share is counted there and sent once, so even one that a third of all documents have is
   a few bytes a task. Ranges and tasks are bounded groups; their number grows with the corpus, and a task writes a row
   for a range only where it has shingles, so rows never outnumber shingles. Counts return to the task's documents, and
   each document leaves with its shingles of frequency two or more (others cannot match) and its prefix.
3. Stars: each prefix shingle proposes links to the node that has it and the fewest shingles of its own alone (of equals
   the smallest), which is most likely what the others were copied from; up to three of them are verified for each
   node, and connected components are taken. This alone connects most of a group of near copies, however
   large, with a number of pairs in proportion to the group.
4. The rest: for each prefix shingle, pairs of nodes that are in different components still and were not compared
   before. Those that pass the length, positional and suffix filters are verified once each, by their whole sets. Pairs
   within one component can change nothing.

Component ids are those of all links. Shingles are compared by 48 bits of their hash, in sets that agree on far more; a
chance agreement that could change a pair's verdict has odds of about one in 10^9 for documents of 500 words. Two
different sets share a fingerprint with odds of one in 10^19 a pair.

Defined cases: null and empty texts have no shingle and are components of their own; fewer than five words are one
shingle; ties go to the smaller doc_id; rows that share a doc_id are one document, which is linked with all that any of
its texts is linked with; a row without a doc_id takes part by its text and gets its group's smallest doc_id, null where
no row of the group has one; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cobordia.llm import textkernel as K
from cobordia.llm.graph import components
from cobordia.session import drop_keys, keep_keys, map_batches, releasing, settle, table

WORDS, PERCENT = 5, 80
TOKENS_A_BLOCK, SHARED, PARTS = 1 << 20, 4, 8
_AT_ONCE = 1 << 16
_U = np.uint64
SETS = "doc_id long, n_shingles long, node long"
TASKED = "bucket long, task long, tok binary, ord binary, hot binary, hot_n binary, head binary"
COUNTED = "task long, tok binary, ord binary, df binary, hot binary, hot_df binary, head binary"
PREFIXED = "doc long, n long, skip long, prefix array<long>, toks binary, " + ", ".join(f"c{k} int" for k in range(PARTS))


def shingle_sets(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """For each text: its place, and its set of shingle hashes, ascending."""
    for begin, _, data, offsets in K.blocks(text):
        _, _, hashed, first = K.words(data, offsets)
        grams, at = K.grams(hashed, first, WORDS)
        for d in range(len(at) - 1):
            yield begin + d, np.unique(grams[at[d] : at[d + 1]])


def _node(own: np.ndarray) -> int | None:
    """The node of a set: its fingerprint, none for an empty one."""
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True) if len(own) else None


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, node = [], []
        for _, own in shingle_sets(batch.column(1)):
            n.append(len(own))
            node.append(_node(own))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64())], names=["doc_id", "n_shingles", "node"])


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}
    names, types = zip(*(f.split() for f in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


def _cuts(buckets: int) -> np.ndarray:
    """Where the ``buckets`` equal ranges of the 48-bit token space begin, and where the last one ends."""
    return np.asarray([-(-(k << 32) // buckets) << 16 for k in range(buckets + 1)], np.uint64)


def _pack(tokens: np.ndarray) -> bytes:
    """Ascending tokens in few bytes: the first one and 32-bit gaps, or six bytes each where a gap is larger."""
    if not len(tokens):
        return b""
    gaps = np.diff(tokens)
    if len(gaps) and gaps.max() >> _U(32):
        return b"\x00" + tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return b"\x01" + tokens[:1].astype("<u8").tobytes() + gaps.astype("<u4").tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    if not packed:
        return np.zeros(0, np.uint64)
    if packed[0] == 1:
        return np.cumsum(np.concatenate((np.frombuffer(packed[1:9], "<u8"), np.frombuffer(packed[9:], "<u4"))), dtype=np.uint64)
    wide = np.zeros((len(packed) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(packed[1:], np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _blocks_of_tokens(buckets: int):
    """Tasks' documents -> (TASKED) blocks, by bucket; the head goes along with one of them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        task = (context.partitionId() if context else 0) << 24
        ids, sizes, owns, seen, total = [], [], [], set(), 0
        cuts = _cuts(buckets)

        def flush() -> pa.RecordBatch:
            nonlocal ids, sizes, owns, seen, total, task
            lengths = np.asarray([len(x) for x in owns], np.int64)
            keys = np.concatenate(owns)  # a token and its document's place in 64 bits, sorted where they lie
            owns.clear()
            keys.sort()
            place = keys.astype(np.uint16)
            keys >>= _U(16)
            tokens, keys = keys, None
            starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
            many = np.diff(np.append(starts, len(tokens)))
            shared = np.repeat(many >= SHARED, many)
            hot, hot_n = tokens[starts[many >= SHARED]], many[many >= SHARED].astype(np.uint32)
            heads = [np.asarray(ids, np.int64), np.asarray(sizes, np.int64), lengths, hot_n.astype(np.int64), hot.astype(np.int64), place[shared].astype(np.int64)]
            head = np.asarray([len(h) for h in heads], np.int64).tobytes() + b"".join(h.tobytes() for h in heads)
            tokens, place = tokens[~shared], place[~shared]
            heads_to = (task * 0x9E3779B1 >> 7) % buckets
            cold_at, hot_at = np.searchsorted(tokens, cuts), np.searchsorted(hot, cuts)
            some = np.flatnonzero((np.diff(cold_at) > 0) | (np.diff(hot_at) > 0) | (np.arange(buckets) == heads_to))  # no row for a range without shingles
            at = [x.tolist() for x in (cold_at[some], cold_at[some + 1], hot_at[some], hot_at[some + 1])]
            out = []
            for k, a, b, c, d in zip(some.tolist(), *at, strict=True):
                out.append((k, task, _pack(tokens[a:b]), place[a:b].tobytes(), hot[c:d].tobytes(), hot_n[c:d].tobytes(), head if k == heads_to else b""))
            task += 1
            ids, sizes, owns, seen, total = [], [], [], set(), 0
            return _rows(TASKED, out)

        for batch in batches:
            for _, own in shingle_sets(batch.column(0)):
                node = _node(own)
                if node is None or node in seen:  # nothing, or a copy within the task
                    continue
                seen.add(node)
                ids.append(node)
                sizes.append(len(own))
                tokens = np.unique(own & _U((1 << 48) - 1))
                owns.append(tokens << _U(16) | _U(len(owns)))
                total += len(own)
                if total >= TOKENS_A_BLOCK or len(ids) >= 60_000:
                    yield flush()
        if ids:
            yield flush()

    return rows


def _count(group: pa.Table) -> pa.Table:
    """One bucket of tokens: for each task, its tokens of frequency two or more with their frequencies."""
    rows = group.to_pylist()
    cold = [_unpack(r["tok"]) for r in rows]
    hot = [np.frombuffer(r["hot"], np.uint64) for r in rows]
    tokens = np.concatenate(cold + hot)
    uniq = np.sort(tokens)
    uniq = uniq[np.concatenate((np.ones(min(1, len(uniq)), bool), uniq[1:] != uniq[:-1]))]
    df, n_cold = np.zeros(len(uniq), np.uint32), sum(map(len, cold))
    back = np.empty(len(tokens), np.uint32)
    for k in range(0, len(tokens), _AT_ONCE):
        back[k : k + _AT_ONCE] = np.searchsorted(uniq, tokens[k : k + _AT_ONCE])
    del tokens, uniq
    for k in range(0, n_cold, _AT_ONCE):
        np.add.at(df, back[k : min(k + _AT_ONCE, n_cold)], np.uint32(1))
    np.add.at(df, back[n_cold:], np.concatenate([np.frombuffer(r["hot_n"], np.uint32) for r in rows]))
    df = df[back]
    at = np.cumsum([0, *map(len, cold), *map(len, hot)])
    out = []
    for k, r in enumerate(rows):
        own, shared = df[at[k] : at[k + 1]], df[at[len(rows) + k] : at[len(rows) + k + 1]]
        keep = own >= 2
        if keep.any() or len(shared) or r["head"]:
            out.append((r["task"], _pack(cold[k][keep]), np.frombuffer(r["ord"], np.uint16)[keep].tobytes(), own[keep].tobytes(), r["hot"], shared.tobytes(), r["head"]))
    return pa.Table.from_batches([_rows(COUNTED, out)])


def _prefix(group: pa.Table) -> pa.Table:
    """One task's documents with their repeated tokens, rarest first, and their prefixes."""
    rows = group.to_pylist()
    head = next(r["head"] for r in rows if r["head"])
    sizes = np.frombuffer(head[:48], np.int64)
    ids, n, n_tokens, hot_n, hot, hot_place = np.split(np.frombuffer(head[48:], np.int64), np.cumsum(sizes)[:-1])
    token = np.concatenate([_unpack(r["tok"]) for r in rows])
    place = np.concatenate([np.frombuffer(r["ord"], np.uint16) for r in rows]).astype(np.int64)
    df = np.concatenate([np.frombuffer(r["df"], np.uint32) for r in rows])
    if len(hot):
        known, known_df = np.concatenate([np.frombuffer(r["hot"], np.uint64) for r in rows]), np.concatenate([np.frombuffer(r["hot_df"], np.uint32) for r in rows])
        order = np.argsort(known)
        hot_df = known_df[order][np.searchsorted(known[order], hot.astype(np.uint64))]
        token, place, df = np.concatenate((token, np.repeat(hot.astype(np.uint64), hot_n))), np.concatenate((place, hot_place)), np.concatenate((df, np.repeat(hot_df, hot_n)))
    order = np.lexsort((token, df, place))
    token, place = token[order], place[order]
    at = np.searchsorted(place, np.arange(len(ids) + 1))
    skip = n_tokens - np.diff(at)  # tokens of no other document come first in the order
    length = n - (n * PERCENT + 99) // 100 + 1 + (n - n_tokens)
    out = []
    for d in np.flatnonzero((length > skip) & (np.diff(at) > 0)):
        own = token[at[d] : at[d + 1]]
        parts = np.bincount((own >> _U(45)).astype(np.int64), minlength=PARTS)
        out.append((int(ids[d]), int(n[d]), int(skip[d]), own[: length[d] - skip[d]].astype(np.int64).tolist(), np.sort(own).tobytes(), *parts.tolist()))
    return pa.Table.from_batches([_rows(PREFIXED, out)])


def _enough(n: Column, m: Column, overlap: Column) -> Column:
    """Can ``overlap`` shared shingles make a link of sets of ``n`` and ``m``: 100 o >= PERCENT (n + m - o)."""
    return (100 + PERCENT) * overlap >= PERCENT * (n + m)


def _may_link(x: str, y: str) -> Column:
    """Length filter, and positional filter: at most this shingle and what follows it in both orders is shared."""
    n, m, i, j = (F.col(c) for c in (f"{x}n", f"{y}n", f"{x}pos", f"{y}pos"))
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & _enough(n, m, F.least(n - i, m - j))


def _suffixes_may_link(x: str, y: str) -> Column:
    """Suffix filter: no more is shared than the smaller count in each part of the hash space."""
    overlap = sum((F.least(F.col(f"{x}c{k}"), F.col(f"{y}c{k}")) for k in range(1, PARTS)), F.least(F.col(f"{x}c0"), F.col(f"{y}c0")))
    return _enough(F.col(f"{x}n"), F.col(f"{y}n"), overlap)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = batch.to_pydict()
        keep = []
        for n, m, p, q in zip(x["n"], x["m"], x["p"], x["q"], strict=True):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            both = np.concatenate((p, q))
            both.sort()
            keep.append((100 + PERCENT) * int((both[1:] == both[:-1]).sum()) >= PERCENT * (n + m))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) that link, by their whole sets."""
    x = sets.select(F.col("doc").alias("a"), "n", F.col("toks").alias("p"))
    y = sets.select(F.col("doc").alias("b"), F.col("n").alias("m"), F.col("toks").alias("q"))
    return settle(map_batches(pairs.join(x, "a").join(y, "b").select("a", "b", "n", "m", "p", "q"), _verified, "a long, b long"))


def _linked(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Of docs (doc_id, text): rows (SETS), settled, verified links (a, b) of nodes that leave nothing unconnected, and
    their components where these are known already."""
    marks = settle(map_batches(docs, _marks, SETS))
    buckets = max(1, -(-(marks.agg(F.sum("n_shingles")).first()[0] or 0) // TOKENS_A_BLOCK))
    blocks = map_batches(docs.select("text"), _blocks_of_tokens(buckets), TASKED)
    sets = blocks.groupBy("bucket").applyInArrow(releasing(_count), COUNTED).groupBy("task").applyInArrow(releasing(_prefix), PREFIXED)
    sets = settle(sets.dropDuplicates(["doc"]))  # copies in several tasks have equal rows
    parts = [f"c{k}" for k in range(PARTS)]
    posts = sets.select("doc", "n", *parts, "skip", F.posexplode("prefix").alias("i", "tok")).withColumn("pos", F.col("skip") + F.col("i")).drop("i")

    heads = posts.groupBy("tok").agg(F.min(F.struct("skip", "doc", "n", "pos")).alias("head"), F.count("*").alias("docs")).filter("docs > 1")
    heads = heads.select("tok", F.col("head.doc").alias("hdoc"), F.col("head.skip").alias("hskip"), F.col("head.n").alias("hn"), F.col("head.pos").alias("hpos"))
    near = posts.join(heads, "tok").filter((F.col("doc") != F.col("hdoc")) & _may_link("", "h"))
    stars = near.groupBy(F.col("doc").alias("x")).agg(F.array_distinct(F.array(F.min_by("hdoc", F.struct("hskip", "hdoc")), F.max_by("hdoc", F.struct("hskip", "hdoc")), F.min_by("hdoc", F.struct("pos", "hdoc")))).alias("y"))
    stars = stars.select("x", F.explode("y").alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    compared = settle(stars.distinct())
    links = verify(compared, sets)
    roots = components(links)

    held = posts.join(roots, posts["doc"] == roots["node"], "left").withColumn("part", F.coalesce("root", "doc")).drop("node", "root")
    split = held.groupBy("tok", "part").agg(F.count("*").alias("docs")).groupBy("tok").agg(F.count("*").alias("parts"), F.max_by("part", F.struct("docs", "part")).alias("largest"))
    open_ = settle(held.join(split.filter("parts > 1").drop("parts"), "tok"))
    names = ["doc", "n", "pos", "part", *parts]
    x = open_.filter("part <> largest").select("tok", "largest", *(F.col(c).alias(f"x_{c}") for c in names))
    y = open_.select("tok", *(F.col(c).alias(f"y_{c}") for c in names))
    once = (F.col("y_part") == F.col("largest")) | (F.col("x_doc") < F.col("y_doc"))
    rest = x.join(y, (x["tok"] == y["tok"]) & (F.col("x_part") != F.col("y_part")) & once & _may_link("x_", "y_") & _suffixes_may_link("x_", "y_"))
    rest = rest.select(F.least("x_doc", "y_doc").alias("a"), F.greatest("x_doc", "y_doc").alias("b")).distinct()
    more = verify(rest.join(compared, ["a", "b"], "left_anti"), sets)
    return (marks, links.unionByName(more), None) if more.limit(1).count() else (marks, links, roots)


def _rooted(marks: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, first, root, least): each node with its smallest doc_id, its component, and the component's node of the
    smallest doc_id (those without one last)."""
    nodes = marks.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"))
    nodes = settle(nodes.join(roots.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left").select("node", "first", F.coalesce("root", "node").alias("root")))
    return nodes.join(nodes.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "node")).alias("least")), "root")


def jaccard_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    marks, links, roots = _linked(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")))
    shared = marks.filter("doc_id is not null and node is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"))
    shared = settle(shared.filter("a <> b").select("doc_id", "a"))
    if shared.limit(1).count():
        links, roots = links.unionByName(marks.join(shared, "doc_id").filter("node <> a").select("a", F.col("node").alias("b")).distinct()), None
    rooted = _rooted(marks, roots or components(links)).select("node", F.col("least.first").alias("component_id"))
    own = marks.filter("node is not null").join(rooted, "node").select("doc_id", "n_shingles", "component_id")
    return own.unionByName(marks.filter("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _with_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node = [_node(own) for _, own in shingle_sets(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node, pa.int64())], names=["row", "key", "node"])


def keep_first_of_groups(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: the smallest doc_id's (rows without one come last); rows without words stay.

    Rows that share a doc_id are judged one by one here, so two texts under one id are no copies of each other.
    """
    marks, links, roots = _linked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    best = _rooted(marks, roots or components(links)).filter(F.col("node") == F.col("least.node")).select(F.col("node").alias("kept_node"), F.col("least.first").alias("kept_id"))
    judged = marks.join(best, F.col("node") == F.col("kept_node"), "left")
    stays = F.col("node").isNull() | (F.col("kept_node").isNotNull() & F.col("doc_id").eqNullSafe(F.col("kept_id")))
    ids = settle(judged.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max(stays).alias("stays")))
    gone = settle(ids.filter("doc_id is not null and not stays").select(F.col("doc_id").alias("key")))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("key"), "text")
    several = settle(ids.filter("doc_id is null or (rows > 1 and stays)").select(F.col("doc_id").alias("key")))
    if not several.limit(1).count():
        return drop_keys(rows, gone, "key").select("row.*")
    shared = several.filter("key is not null")
    single = drop_keys(drop_keys(rows, gone, "key"), shared, "key").filter("key is not null").select("row.*")
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("key", T.LongType()), T.StructField("node", T.LongType())])
    own = map_batches(rows.filter("key is null").unionByName(keep_keys(rows, shared, "key")), _with_nodes, schema)
    kept = own.join(best, (F.col("node") == F.col("kept_node")) & F.col("key").eqNullSafe(F.col("kept_id"))).select("row", "key", "node").dropDuplicates(["key", "node"])
    return single.unionByName(own.filter("node is null").select("row.*")).unionByName(kept.select("row.*"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * o >= 80 * (x.n + y.n - o)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.root = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""

QUERIES = {"op8_jaccard": op8_jaccard}
SQL = {"op8_jaccard": OP8_SQL}
