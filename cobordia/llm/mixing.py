"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Native: DataFrame functions only. Every source gets ``least(level * weight, cap * size)`` words, where the level
solves ``sum = share * total``. Sources are clamped at ``cap`` times their size; what they cannot take goes to the
others in proportion to their weights until nothing is above its cap (solved in closed form over the sources sorted
by the level at which they are clamped). That is one task over a row of 40 bytes for each source, so sources may number
millions (all hosts of a crawl, say), and more than ``MOST_SOURCES`` are refused.

A source with target/size = e takes every document floor(e) times, and a fraction e - floor(e) of its words once
more. The extra documents are the first in a seeded order, up to that many words: large documents (over 1/64 of
their source, so fewer than 64 each) first, and small ones then fill what is left. The prefix sum over small documents
goes through 4096 seeded buckets a source, so no task ever sorts a whole source.

Defined cases: a null or empty text has size 0 and takes 0; a null source is a source of its own, last in order;
repeated rows are separate documents in one group of equal keys and may both be taken; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cobordia.session import keep_keys, settle, table

WEIGHTS = (3, 1, 2)
SHARE, CAP, SEED, BUCKETS, LARGE = 1.5, 2, "mix-1", 4096, 64
MOST_SOURCES = 20_000_000


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in ``text`` (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_fill(sizes: DataFrame, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``sizes``: (source, source_size, weight) -> the same and ``target`` double."""
    level = Window.orderBy(F.col("r"), F.col("source").asc_nulls_last())
    upto, every = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    x = sizes.withColumn("r", F.col("source_size") * cap / F.col("weight"))
    x = (
        x.withColumn("total", F.sum("source_size").over(every))
        .withColumn("left", share * F.col("total") - cap * F.coalesce(F.sum("source_size").over(upto), zero))
        .withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), zero))
        .withColumn("fits", F.col("left") / F.col("open") <= F.col("r"))
    )
    # clamping more sources than needed only lowers the level, so the largest that fits is the solution
    x = x.withColumn("level", F.max(F.when(F.col("fits"), F.col("left") / F.col("open"))).over(every))
    clamped = (F.col("level").isNull()) | (F.col("r") < F.col("level"))
    first_fit = F.when(clamped, F.col("source_size") * float(cap)).otherwise(F.col("level") * F.col("weight"))
    return x.select("source", "source_size", "weight", first_fit.alias("target"))


def _place(key: Column, seed: str) -> Column:
    """60 seeded bits of a document's key, as a long."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")


def mix_sources(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    seed: str = SEED,
) -> DataFrame:
    """One row per document: key, size, source, source_size, target, place (seeded order), repeats, taken."""
    x = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), _place(F.col(key), seed).alias("place"))
    x = settle(x)
    sizes = settle(x.groupBy("source").agg(F.sum("size").alias("source_size")))
    if sizes.limit(MOST_SOURCES + 1).count() > MOST_SOURCES:
        raise ValueError(f"there are more than {MOST_SOURCES} sources")
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sizes = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int")).cast("long"))
    goals = water_fill(sizes, share, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio)
    goals = settle(goals.select(F.col("source").alias("s"), "source_size", "target", whole.alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("need")))
    x = x.join(goals, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    x = x.withColumn("bucket", F.when(F.col("size") * LARGE > F.col("source_size"), F.lit(-1)).otherwise(F.shiftright("place", 48)).cast("int"))
    # words before each bucket: large documents (bucket -1) are settled first, one by one
    inner = Window.partitionBy("source", "bucket").orderBy("place", "key", "size").rowsBetween(Window.unboundedPreceding, 0)
    big = x.filter("bucket < 0").withColumn("upto", F.sum("size").over(inner))
    big = big.withColumn("extra", F.col("upto") - F.col("size") / 2 <= F.col("need")).drop("upto")
    used = big.groupBy("source").agg(F.sum(F.when(F.col("extra"), F.col("size")).otherwise(0)).alias("used"))
    sums = x.filter("bucket >= 0").groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("before", F.sum("words").over(run) - F.col("words"))
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "words", "before")
    used = used.select(F.col("source").alias("u"), "used")
    sums = sums.join(used, F.col("s").eqNullSafe(F.col("u")), "left").drop("u")
    small = x.filter("bucket >= 0").join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    small = small.withColumn("goal", F.col("need") - F.coalesce("used", F.lit(0)) - F.col("before")).drop("used")
    sure = small.filter(~((F.col("goal") > 0) & (F.col("goal") < F.col("words")))).withColumn("extra", F.col("goal") > 0)
    edge = small.filter((F.col("goal") > 0) & (F.col("goal") < F.col("words"))).withColumn("upto", F.sum("size").over(inner))
    edge = edge.withColumn("extra", F.col("upto") - F.col("size") / 2 <= F.col("goal")).drop("upto")
    every = big.unionByName(sure.drop("words", "before", "goal")).unionByName(edge.drop("words", "before", "goal"))
    repeats = (F.col("whole") + F.when(F.col("extra") & (F.col("whole") < cap), 1).otherwise(0)).cast("long")
    return every.select("key", "source", "size", "source_size", "target", "place", repeats.alias("repeats"), (F.col("size") * repeats).alias("taken"))


def mixed(docs: DataFrame, at_most: int = 1 << 20) -> DataFrame:
    """``docs`` with every row as often as the mix takes it, rows without a doc_id or with one of several rows too."""
    plan = settle(mix_sources(docs).select("key", "source", "size", "repeats"))
    keys = plan.groupBy("key").agg(F.count("*").alias("n"), F.max("repeats").alias("repeats"))
    single = settle(keys.filter("key is not null and n = 1 and repeats > 0").select("key", "repeats"))
    # 16 bytes a row: broadcast only where there are few enough, joined by a shuffle otherwise
    single = F.broadcast(single) if single.limit(at_most + 1).count() <= at_most else single.hint("merge")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("key"))
    x = rows.join(single, "key").select("row", "repeats")
    several = settle(keys.filter("key is null or n > 1").select("key"))
    if several.limit(1).count():  # rows of one key, source and size are alike to the mix: the nth of them takes the nth's repeats
        nth = lambda *order: F.row_number().over(Window.partitionBy("key", "source", "size").orderBy(*order))
        known = rows.filter("key is null").unionByName(keep_keys(rows, several.filter("key is not null"), "key"))
        known = known.withColumn("source", F.col("row.source")).withColumn("size", word_count(F.col("row.text"))).withColumn("nth", nth(F.xxhash64("row.text")))
        taken = plan.join(several, plan["key"].eqNullSafe(several["key"])).select(plan["key"], "source", "size", "repeats").withColumn("nth", nth("repeats"))
        taken = taken.filter("repeats > 0").select(F.col("key").alias("k"), F.col("source").alias("s"), F.col("size").alias("z"), F.col("nth").alias("i"), "repeats")
        same = F.col("key").eqNullSafe(F.col("k")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("nth") == F.col("i"))
        x = x.unionByName(known.join(taken, same).select("row", "repeats"))
    return x.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats")))).select("row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = mix_sources(table(spark, sf_dir, "documents"))
    return x.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH x AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS place
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM x GROUP BY source),
s1 AS (SELECT *, ([3, 1, 2])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM s0),
s2 AS (SELECT *, source_size * 2 / weight AS r FROM s1),
s3 AS (SELECT *, sum(source_size) OVER () AS total,
         1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - 2 * coalesce(sum(source_size) OVER p, 0)::DOUBLE AS lft,
         (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0))::DOUBLE AS opn
       FROM s2 WINDOW p AS (ORDER BY r, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, max(CASE WHEN lft / opn <= r THEN lft / opn END) OVER () AS level FROM s3),
s5 AS (SELECT source AS s, source_size, CASE WHEN level IS NULL OR r < level THEN source_size * 2.0::DOUBLE ELSE level * weight END AS target FROM s4),
s6 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM s5),
g AS (SELECT *, target - whole * source_size AS need FROM s6),
d AS (SELECT x.*, source_size, target, whole, need, CASE WHEN size * 64 > source_size THEN -1 ELSE place >> 48 END AS bucket
      FROM x JOIN g ON x.source IS NOT DISTINCT FROM g.s),
big AS (SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2 <= need) AS extra FROM d WHERE bucket < 0),
used AS (SELECT source, sum(CASE WHEN extra THEN size ELSE 0 END) AS used FROM big GROUP BY source),
small AS (SELECT d.*, (sum(size) OVER (PARTITION BY d.source ORDER BY bucket, place, doc_id, size ROWS UNBOUNDED PRECEDING)) AS upto,
            need - coalesce(used, 0) AS goal
          FROM d LEFT JOIN used u ON d.source IS NOT DISTINCT FROM u.source WHERE bucket >= 0),
edge AS (SELECT *, sum(size) OVER (PARTITION BY source, bucket) AS words, min(upto - size) OVER (PARTITION BY source, bucket) AS before FROM small),
alld AS (
  SELECT doc_id, size, source_size, target, whole, extra FROM big
  UNION ALL
  SELECT doc_id, size, source_size, target, whole,
         CASE WHEN goal - before > 0 AND goal - before < words THEN (upto - before) - size / 2 <= goal - before ELSE goal - before > 0 END AS extra FROM edge)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN extra AND whole < 2 THEN 1 ELSE 0 END))::BIGINT AS taken FROM alld
"""

QUERIES = {"op2_mixing": op2_mixing}
SQL = {"op2_mixing": OP2_SQL}
