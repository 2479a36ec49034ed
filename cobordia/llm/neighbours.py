"""Approximate nearest neighbours: vantage-point trees, one per shard, with relaxed pruning.

Nearness is the inner product. Every vector x gets one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm it is
lifted with, and a query gets 0 there; then the Euclidean distance of the two falls as their inner product grows, and a
metric tree applies. A node splits its vectors at the median distance from a vantage point. A query goes to its own side
first and to the other side only if the border is no farther than ``factor`` times its distance to the worst neighbour
kept; factor 1 is exact search, a smaller one visits less.

Vectors of one length and of norms within a factor of the square root of 2 are a group, and M is a group's or a shard's
own largest norm, so that a few long vectors lift no others. A group of more than ``SHARD`` vectors has a tree of
its own over a sample of at most ``SAMPLE`` of its vectors, whose leaves are regions; a region has shards of about
``SHARD`` vectors. Every row is indexed. A task reads a shard, builds its tree and streams queries past it, so it holds
one shard and one batch of queries at a time.

Queries come in two rounds: first to their own region of each group, then, with the worst neighbour kept of all that as
a bound, to the other regions that the relaxed rule lets them reach; groups whose norms cannot beat the bound are
skipped. What each shard found is merged by a top-k window per query.

Only the ``GROUPS`` largest groups have their sizes collected, and the ``ROUTED`` largest of these a tree over regions;
the others are searched as a whole, in shards by hash. That changes the work, not the result at factor 1.

Defined cases: vectors that are null, empty, zero or have null or non-finite components take no part, as queries or as
candidates; vectors of another length than the query's are no candidates; ties go to the smaller vec_id; repeated rows
of one vec_id are one vector (the first in order of its components); a null vec_id takes no part; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cobordia.session import map_batches, settle, table

EVERY, NEAREST, SHARD, LEAF, FACTOR = 20, 20, 4096, 128, 0.7
SAMPLE, REGIONS, ROUTED, GROUPS, TASKS = 4096, 256, 32, 1024, 1 << 14
FOUND = "query_id long, vec_id long, score double"
LAID = "part int, shard long, kind int, id long, v array<double>, floor double"


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def lifted(vectors: np.ndarray, most: float) -> np.ndarray:
    return np.column_stack((vectors, np.sqrt(np.maximum(most * most - squares(vectors), 0))))


def reach(square: np.ndarray, most: float, worst: np.ndarray) -> np.ndarray:
    """How far a neighbour of the inner product ``worst`` is, with room for rounding."""
    whole = square + most * most
    return np.sqrt(np.maximum(whole - 2 * np.maximum(worst, -whole), 0) + 1e-12 * whole)


class Regions:
    """The upper part of a group's tree, over a sample of its vectors; leaves are numbered."""

    def __init__(self, sample: np.ndarray, most: float, leaves: int) -> None:
        self.most, self.leaves, self.draw = most, 0, np.random.RandomState(7)
        self.root = self._build(lifted(sample, most), max(0, (leaves - 1).bit_length()))

    def _build(self, points: np.ndarray, levels: int):
        if levels and len(points) > 1:
            point = points[self.draw.randint(len(points))]
            away = np.linalg.norm(points - point, axis=1)
            border = float(np.median(away))
            near = away < border
            if near.any() and not near.all():
                return point, border, self._build(points[near], levels - 1), self._build(points[~near], levels - 1)
        self.leaves += 1
        return self.leaves - 1

    def of(self, points: np.ndarray) -> np.ndarray:
        """The region of each point (with its last coordinate)."""
        out = np.zeros(len(points), np.int64)

        def down(node, who: np.ndarray) -> None:
            if isinstance(node, int):
                out[who] = node
            elif len(who):
                inside = np.linalg.norm(points[who] - node[0], axis=1) < node[1]
                down(node[2], who[inside])
                down(node[3], who[~inside])

        down(self.root, np.arange(len(points)))
        return out

    def other(self, queries: np.ndarray, far: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Regions besides their own that queries reach, ``far`` being how far they look."""
        points = np.column_stack((queries, np.zeros(len(queries))))
        own = self.of(points)

        def down(node, who: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
            if not len(who):
                return
            if isinstance(node, int):
                yield node, who[own[who] != node]
                return
            gap = np.linalg.norm(points[who] - node[0], axis=1) - node[1]
            yield from down(node[2], who[(gap < 0) | (gap <= far[who])])
            yield from down(node[3], who[(gap >= 0) | (-gap <= far[who])])

        return down(self.root, np.arange(len(queries)))


class Tree:
    """Vantage-point tree over a shard's vectors, candidates' ids ascending per leaf."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> None:
        self.ids, self.vectors, self.leaf = ids, vectors, leaf
        self.most = float(np.sqrt(squares(vectors).max()))
        self.points = lifted(vectors, self.most)
        self.draw = np.random.RandomState(3)
        self.root = self._build(np.arange(len(ids)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return np.sort(rows)
        point = self.points[rows[self.draw.randint(len(rows))]]
        away = np.linalg.norm(self.points[rows] - point, axis=1)
        border = float(np.median(away))
        near = away < border
        if not near.any() or near.all():  # all at one distance: no split
            return np.sort(rows)
        return point, border, self._build(rows[near]), self._build(rows[~near])

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """For each query the ids and inner products of the ``k`` best found (-1 and -inf where there are fewer); below
        ``floor`` none is wanted."""
        self.q, self.q_ids, self.k, self.factor, self.floor = queries, query_ids, k, factor, floor
        self.q_norm = squares(queries)
        self.best = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), -1, np.int64)
        if len(queries):
            self._visit(self.root, np.arange(len(queries)))
        return self.found, self.best

    def _visit(self, node, who: np.ndarray) -> None:
        if not len(who):
            return
        if isinstance(node, np.ndarray):
            score = self.q[who] @ self.vectors[node].T
            score[self.q_ids[who][:, None] == self.ids[node][None, :]] = -np.inf
            scores = np.concatenate((self.best[who], score), axis=1)
            ids = np.concatenate((self.found[who], np.broadcast_to(self.ids[node], score.shape)), axis=1)
            order = np.lexsort((ids, -scores), axis=1)[:, : self.k]
            self.best[who], self.found[who] = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
            return
        point, border, inner, outer = node
        flat = self.q[who] - point[:-1]
        away = np.sqrt(squares(flat) + point[-1] ** 2)
        inside = away < border
        self._visit(inner, who[inside])
        self._visit(outer, who[~inside])
        far = np.abs(away - border) <= self.factor * reach(self.q_norm[who], self.most, np.maximum(self.best[who, -1], self.floor[who]))
        self._visit(outer, who[inside & far])
        self._visit(inner, who[~inside & far])


class Layout:
    """Where vectors and queries go: shards by group, region and hash, and a task for each shard."""

    def __init__(self, groups: list[tuple[int, int, int, float]], regions: dict[int, Regions], shard: int, few: int) -> None:
        """``groups``: (size, code, vectors, largest norm) of the largest ones; ``few``: vectors in any other at most."""
        self.regions, self.place, self.of_size, self.rest = regions, {}, {}, max(1, -(-few // shard))
        first = 0
        for n, (size, code, vectors, most) in enumerate(groups):
            leaves = regions[code].leaves if code in regions else 1
            subs = max(1, -(-vectors // (leaves * shard)))
            self.place[code] = (n, first, subs, most)
            self.of_size.setdefault(size, []).append(code)
            first += leaves * subs
        self.tasks = max(1, min(first, TASKS))

    def _rows(self, code: int, region: np.ndarray, sub: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, first, subs, _ = self.place[code]
        return (first + region * subs + sub) % self.tasks, (n << 40) + (region << 24) + sub

    def vectors(self):
        """(code, sub hash, id, v) -> (LAID) of the index."""

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes, hashes = (batch.column(n).to_numpy(zero_copy_only=False) for n in (0, 1))
                part, shard = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
                for code in np.unique(codes).tolist():
                    who = np.flatnonzero(codes == code)
                    if code not in self.place:  # as in ``rest``
                        sub = hashes[who] % self.rest
                        shard[who] = -1 - (code * self.rest + sub)
                        part[who] = (code + sub) % self.tasks
                        continue
                    region = np.zeros(len(who), np.int64)
                    if code in self.regions:
                        x = np.stack(batch.column(3).take(pa.array(who)).to_numpy(zero_copy_only=False))
                        region = self.regions[code].of(lifted(x, self.regions[code].most))
                    part[who], shard[who] = self._rows(code, region, hashes[who] % self.place[code][2])
                yield self._batch(part, shard, 0, batch.column(2), batch.column(3), np.full(len(codes), -np.inf))

        return rows

    def queries(self, factor: float | None):
        """(size, floor, id, v) -> (LAID): to their own region of each group, or with a factor to others within it."""

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes, floors = (batch.column(n).to_numpy(zero_copy_only=False) for n in (0, 1))
                for size in np.unique(sizes).tolist():
                    who = np.flatnonzero(sizes == size)
                    x = np.stack(batch.column(3).take(pa.array(who)).to_numpy(zero_copy_only=False))
                    for code in self.of_size.get(size, ()):
                        _, _, subs, most = self.place[code]
                        own = self.regions.get(code)
                        if factor is None:
                            region = own.of(np.column_stack((x, np.zeros(len(x))))) if own else np.zeros(len(x), np.int64)
                            lots = [(r, np.flatnonzero(region == r)) for r in np.unique(region).tolist()]
                        elif own:
                            far = factor * reach(squares(x), most, floors[who])
                            far[np.sqrt(squares(x)) * most * (1 + 1e-9) < floors[who]] = -np.inf
                            able = np.flatnonzero(far >= 0)
                            lots = ((r, able[w]) for r, w in own.other(x[able], far[able]))
                        else:
                            continue
                        for region, lot in lots:
                            for sub in range(subs):
                                if len(lot):
                                    at = pa.array(who[lot])
                                    part, shard = self._rows(code, np.full(len(lot), region, np.int64), np.full(len(lot), sub, np.int64))
                                    yield self._batch(part, shard, 1, batch.column(2).take(at), batch.column(3).take(at), floors[who[lot]])

        return rows

    @staticmethod
    def _batch(part: np.ndarray, shard: np.ndarray, kind: int, ids: pa.Array, vectors: pa.Array, floor: np.ndarray) -> pa.RecordBatch:
        own = [pa.array(part.astype(np.int32)), pa.array(shard), pa.array(np.full(len(shard), kind, np.int32)), ids, vectors, pa.array(floor)]
        return pa.RecordBatch.from_arrays(own, names=[f.split()[0] for f in LAID.split(", ")])


def _search_rows(k: int, factor: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, vectors, tree = None, [], [], None
        for batch in batches:
            _, s, kind, own = (batch.column(n).to_numpy(zero_copy_only=False) for n in range(4))
            floor = batch.column(5).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.concatenate(([True], (np.diff(s) != 0) | (np.diff(kind) != 0)))) if len(s) else []
            for a, b in zip(cuts, [*cuts[1:], len(s)], strict=True):
                x = np.stack(batch.column(4).slice(a, b - a).to_numpy(zero_copy_only=False)).astype(np.float64)
                if s[a] != shard:
                    shard, ids, vectors, tree = s[a], [], [], None
                if kind[a] == 0:
                    ids.append(own[a:b])
                    vectors.append(x)
                elif ids:
                    if tree is None:
                        tree = Tree(np.concatenate(ids), np.concatenate(vectors))
                        vectors = []
                    found, best = tree.search(own[a:b], x, floor[a:b], k, factor)
                    good = (best > -np.inf) & (best >= floor[a:b, None])
                    who = np.repeat(own[a:b], good.sum(axis=1))
                    yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(found[good]), pa.array(best[good])], names=["query_id", "vec_id", "score"])

    return rows


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = NEAREST, shard: int = SHARD, factor: float = FACTOR, most_groups: int = GROUPS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows that ``queries`` selects, against all rows."""
    x = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), queries.alias("asks"))
    x = x.filter("id is not null").filter(usable(F.col("v"))).groupBy("id").agg(F.min("v").alias("v"), F.max("asks").alias("asks"))
    # the norm by way of the largest component, so that no square overflows
    top = F.array_max(F.transform("v", F.abs))
    norm = F.aggregate("v", F.lit(0.0), lambda a, b: a + (b / F.col("top")) * (b / F.col("top")))
    x = x.withColumn("top", top).withColumn("norm", F.col("top") * F.sqrt(norm)).withColumn("size", F.size("v"))
    x = settle(x.withColumn("code", F.col("size").cast("long") * 65536 + F.round(2 * F.log2("norm")).cast("long") + 32768).drop("top"))
    stats = settle(x.groupBy("size", "code").agg(F.count("*").alias("n"), F.max("norm").alias("most")))
    large = [tuple(r) for r in stats.orderBy(F.col("n").desc(), "code").limit(most_groups).collect()]
    regions = {}
    for _, code, n, most in large[:ROUTED]:
        if n > shard:
            sample = x.filter(F.col("code") == code).orderBy(F.xxhash64("id"), "id").select("v").limit(SAMPLE).toArrow().column(0).combine_chunks()
            regions[code] = Regions(np.stack(sample.to_numpy(zero_copy_only=False)), most, min(REGIONS, -(-n // shard)))
    layout = Layout(large, regions, shard, large[-1][2] if len(large) == most_groups else 0)

    def searched(asked: DataFrame) -> DataFrame:
        laid = index.unionByName(asked).repartitionById(layout.tasks, F.col("part")).sortWithinPartitions("shard", "kind", "id")
        return map_batches(laid, _search_rows(k, factor), FOUND)

    index = map_batches(x.select("code", F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("hash"), "id", "v"), layout.vectors(), LAID)
    asked = x.filter("asks").select("size", F.lit(float("-inf")).alias("floor"), "id", "v")
    first = map_batches(asked, layout.queries(None), LAID)
    if len(large) == most_groups:
        rest = stats.filter(~F.col("code").isin([r[1] for r in large])).select("size", "code")
        sub = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(layout.rest - 1).cast("long")))
        more = asked.join(rest, "size").select("code", sub.alias("sub"), "id", "v", "floor")
        first = first.unionByName(more.select(F.pmod(F.col("code") + F.col("sub"), F.lit(layout.tasks)).cast("int").alias("part"), (-1 - (F.col("code") * layout.rest + F.col("sub"))).alias("shard"), F.lit(1).alias("kind"), "id", "v", "floor"))
    out = settle(_top(searched(first), k).drop("rank"))
    if regions:
        kept = out.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(float("-inf")).alias("least"))
        asked = asked.join(kept, F.col("id") == F.col("query_id"), "left").select("size", F.coalesce("least", "floor").alias("floor"), "id", "v")
        out = _top(out.unionByName(searched(map_batches(asked, layout.queries(factor), LAID))), k)
    else:
        out = _top(out, k)
    return out.select("query_id", "rank", "vec_id", "score")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


QUERIES = {"op9_neighbours": op9_neighbours}
SQL: dict[str, str] = {}
