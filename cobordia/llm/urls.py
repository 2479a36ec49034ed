"""URL filters: rules by host and path, and for what no rule fits a tree of path templates per host.

Host and path of a page come from its URL. A rule names a host and the beginning of a path, and fits that host and its
subdomains; of several the longest counts. Pages that a rule fits are the labels from which the tree learns.

The tree grows level by level over the distinct (host, path) with digits as ``#``, for all hosts at once:

* a segment keeps its own branch if its node has at most ``VARIETY`` different ones or it holds at least ``SHARE`` of the
  node's pages; all others of the node are one wildcard ``*``. So a node has a bounded number of branches;
* branches of a node whose pages go on alike and are labelled alike are merged: their counts by kind of the next segment
  and label (allow, block, none) pass a chi-square test of homogeneity at ``Z`` standard deviations, or their shares differ
  by at most ``CLOSE`` in total. The largest branch comes first, each joins the first one it resembles. Unlabelled pages are
  a kind of their own, so a branch that no rule fits isn't merged with one that a rule blocks unless both are small;
* a finished template is rejected if its smoothed purity, (blocked + 1) / (labelled + 2), is at least ``PURITY``.

Segments beyond ``DEPTH`` count as one, the rest of the path. Each level sums by node before anything is compared; a host
of any size is many groups, and a group holds one node's branches.

Defined cases: a null URL, or one without ``://``, has an empty host and path and is judged by these; empty paths are a
template of their own; repeated rows count again; very long URLs are read in whole; without any label nothing is
rejected; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cobordia.session import map_batches, settle, table

VARIETY, SHARE, DEPTH, Z, CLOSE, PURITY = 12, 0.1, 8, 1.645, 0.05, 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: fixed values of the query: verdict, and host with the beginning of the path
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    parts = lambda group: F.when(at > 0, F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", group)).otherwise("")
    return F.translate(parts(1), UPPER, LOWER), parts(2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or null."""
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        own, _, begin = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + begin)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def shape(path: Column) -> Column:
    return F.regexp_replace(path, "[0-9]+", "#")


def kind(segment: Column) -> Column:
    """What a segment looks like: '' none, '/' an empty one, else of digits, letters or both, and whether it has a dot."""
    plain = F.when(segment == "", "/").when(segment.rlike("^#(\\.|$)"), "#").when(segment.contains("#"), "a#").otherwise("a")
    return F.when(segment.isNull(), "").otherwise(F.concat(plain, F.when(segment.contains("."), ".").otherwise("")))


def alike(x: np.ndarray, y: np.ndarray, z: float = Z, close: float = CLOSE) -> bool:
    """Do two rows of counts come from one distribution, by a chi-square test, or nearly so."""
    some = x + y > 0
    x, y = x[some].astype(float), y[some].astype(float)
    if 0.5 * np.abs(x / x.sum() - y / y.sum()).sum() <= close:
        return True
    free = len(x) - 1
    share = (x + y) / (x.sum() + y.sum())
    found = sum(((c - c.sum() * share) ** 2 / (c.sum() * share)).sum() for c in (x, y))
    return bool(found <= free * (1 - 2 / (9 * free) + z * np.sqrt(2 / (9 * free))) ** 3)  # Wilson and Hilferty's quantile


def merged(branches: dict[str, dict[str, np.ndarray]]) -> dict[str, str]:
    """Branches (name -> kind of the next segment -> pages allowed, blocked, unlabelled) to the names of their groups."""
    kinds = sorted({k for b in branches.values() for k in b})
    flat = {name: np.concatenate([b.get(k, np.zeros(3, np.int64)) for k in kinds]) for name, b in branches.items()}
    groups: list[tuple[list[str], np.ndarray]] = []
    for name in sorted(flat, key=lambda x: (-flat[x].sum(), x)):
        for g, (names, total) in enumerate(groups):
            if alike(total, flat[name]):
                groups[g] = (names + [name], total + flat[name])
                break
        else:
            groups.append(([name], flat[name]))
    return {n: names[0] if len(names) == 1 else f"({'|'.join(sorted(names))})" for names, _ in groups for n in names}


def _merged_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for node in batch.to_pylist():
            branches: dict[str, dict[str, np.ndarray]] = defaultdict(dict)
            for b in node["branches"]:
                branches[b["name"]][b["kind"]] = np.asarray([b["allowed"], b["blocked"], b["n"] - b["allowed"] - b["blocked"]])
            out += [(node["host"], node["template"], name, group) for name, group in merged(branches).items()]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["host", "template", "name", "branch"])


COUNTS = ("n", "allowed", "blocked")


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in COUNTS]


def grown(rows: DataFrame, level: int, variety: int, share: float) -> DataFrame:
    """One level more: (host, shape, segments, template, counts), each template with the branch its next segment is in."""
    node = ["host", "template"]
    x = rows.withColumn("segment", F.get("segments", F.lit(level)))
    segments = x.groupBy(*node, "segment").agg(F.sum("n").alias("own"))
    nodes = segments.groupBy(*node).agg(F.count("*").alias("kinds"), F.sum("own").alias("all"))
    keeps = (F.col("kinds") <= variety) | (F.col("own") >= share * F.col("all"))
    names = settle(segments.join(nodes, node).select(*node, "segment", F.when(keeps, F.col("segment")).otherwise("*").alias("name")))
    x = x.join(names, [*node, "segment"])
    branches = x.groupBy(*node, "name", kind(F.get("segments", F.lit(level + 1))).alias("kind")).agg(*_sums())
    branches = branches.groupBy(*node).agg(F.collect_list(F.struct("name", "kind", *COUNTS)).alias("branches"), F.min("name").alias("least"), F.max("name").alias("most"))
    groups = map_batches(branches.filter("least <> most").select(*node, "branches"), _merged_rows, "host string, template string, name string, branch string")
    branch = F.coalesce("branch", "name")
    x = x.join(groups, [*node, "name"], "left")
    return settle(x.select("host", "shape", "segments", F.concat("template", F.lit("/"), branch).alias("template"), *COUNTS))


def templates(pages: DataFrame, depth: int = DEPTH, variety: int = VARIETY, share: float = SHARE) -> DataFrame:
    """(host, shape, template, n, allowed, blocked) of every distinct host and shape of ``pages`` (host, path, label)."""
    said = lambda x: F.count_if(F.coalesce(F.col("label") == x, F.lit(False)))
    rows = pages.groupBy("host", shape(F.col("path")).alias("shape")).agg(F.count("*").alias("n"), said("allow").alias("allowed"), said("block").alias("blocked"))
    parts = F.split("shape", "/")
    deep = F.concat(F.slice(parts, 2, depth - 1), F.array(F.concat_ws("/", F.slice(parts, depth + 1, F.size(parts)))))
    segments = F.when(F.size(parts) > depth + 1, deep).otherwise(F.slice(parts, 2, depth))
    rows = settle(rows.withColumn("segments", segments).withColumn("template", F.lit("")))
    most, done = rows.agg(F.max(F.size("segments"))).first()[0] or 0, []
    for level in range(most):  # at most ``depth``
        done.append(rows.filter(F.size("segments") <= level))
        rows = grown(rows.filter(F.size("segments") > level), level, variety, share)
    return reduce(DataFrame.unionByName, [*done, rows]).select("host", "shape", "template", *COUNTS)


def rejected(found: DataFrame, purity: float = PURITY) -> DataFrame:
    """(host, shape) of the templates whose smoothed labelled purity is at least ``purity``."""
    sums = found.groupBy("host", "template").agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b"))
    bad = sums.filter((F.col("b") + 1) / (F.col("a") + F.col("b") + 2) >= purity).select("host", "template")
    return found.join(bad, ["host", "template"], "left_semi").select("host", "shape")


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, label: str | None = None, at_most: int = 1 << 18, **how) -> DataFrame:
    """One row per page: its key, host, path, rule and verdict. ``label``: a column of other labels ("allow", "block", null)
    for pages that no rule fits; they inform the tree and decide nothing else. ``how``: ``depth``, ``variety``, ``share``."""
    host, path = host_and_path(F.col(url))
    own = F.lit(None).cast("string") if label is None else F.col(label)
    x = pages.select(F.col(key).alias(key), host.alias("host"), path.alias("path"), own.alias("other"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    x = x.withColumn("rule", rule).withColumn("said", verdict)
    bad = settle(rejected(templates(x.select("host", "path", F.coalesce("said", "other").alias("label")), **how)).withColumn("bad", F.lit(True)))
    # two strings a row: sent to every task only after their rows were counted
    bad = F.broadcast(bad) if bad.limit(at_most + 1).count() <= at_most else bad.hint("merge")
    open_ = x.filter("said is null").withColumn("shape", shape(F.col("path"))).join(bad, ["host", "shape"], "left")
    open_ = open_.withColumn("verdict", F.when(F.col("bad"), "block").otherwise("allow"))
    ruled = x.filter("said is not null").withColumn("verdict", F.col("said"))
    columns = [key, "host", "path", "rule", "verdict"]
    return ruled.select(*columns).unionByName(open_.select(*columns))


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


QUERIES = {"op13_urls": op13_urls}
SQL: dict[str, str] = {}
