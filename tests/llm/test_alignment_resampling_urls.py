"""Cross-tokenizer alignment, importance resampling and URL filters against brute force, and on awkward rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from cobordia.llm import alignment, catalogue, resampling, urls
from tests.conftest import SF, same
from tests.llm.test_operators import DOCS, LOWER, corpus, with_clashes

# ---- 11: alignment


def by_definition(rows):
    """(doc_id, text) to the query's columns: whole texts encoded, groups by common ends, all pairs of a group."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = alignment.paths()
    a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    letters, docs, counts = alignment.byte_letters(), [], Counter()
    for i, text in rows:
        raw = b" " + (text or "").encode()
        x = [(t, bytes(letters[c] for c in a.id_to_token(t))) for t in a.encode(" " + text, add_special_tokens=False).ids] if text else []
        y = [(t, bytes([int(b.id_to_piece(t)[3:5], 16)]) if b.is_byte(t) else b.id_to_piece(t).replace("▁", " ").encode()) for t in b.encode(text)] if text else []
        if b"".join(p for _, p in x) != raw or b"".join(p for _, p in y) != raw:
            docs.append((i, 0, 0, []))
            continue
        ends = [set(np.cumsum([len(p) for _, p in side]).tolist()) for side in (x, y)]
        cuts, groups = sorted(ends[0] & ends[1]), []
        for side in (x, y):
            at, out = 0, defaultdict(list)
            for t, p in side:
                out[sum(c <= at for c in cuts) if len(cuts) < 50 else int(np.searchsorted(cuts, at, "right"))].append(t)
                at += len(p)
            groups.append([out[k] for k in range(len(cuts))])
        docs.append((i, len(x), len(y), list(zip(*groups, strict=True))))
        counts.update({(p, q) for g, h in docs[-1][3] for p in g for q in h})
    top = defaultdict(int)
    for (p, _), n in counts.items():
        top[p] = max(top[p], n)
    for i, n_a, n_b, groups in docs:
        links = [(p, q) for g, h in groups for p in g for q in h]
        said = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        yield (i, n_a, n_b, len(groups), len(links), sum(counts[k] == top[k[0]] for k in links), sum(counts[k] for k in links), sha256(said.encode()).hexdigest() if groups else "")


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def hard_texts():
    draw = random.Random(8)
    odd = ["a▁b", "one two ▁", "<|endoftext|> and <s> </s> <0x41>", "  two  spaces\n\n\tand tabs \u00a0 x\u2003y ", " ", "\n", "漢字かな交じり文 ไทย 한국어 \U0001f600\U0001f600", "don't WON'T they'll 12345678901234567890", "x" * 3000, "\x00\x01 \x1c \x85 z", "ﬁ ½ é e\u0301", "\u2028 a \u3000 b", "a \u200b b", "0" * 77 + " ." * 40]
    odd += ["".join(draw.choice("ab 1\n\t'.é漢▂\u00a0\U0001f600") for _ in range(draw.randrange(1, 60))) for _ in range(150)]
    return odd + [" ".join(draw.choice(odd[:8]) for _ in range(400))]


def test_alignment_by_definition(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(1000 + i, t) for i, t in enumerate(hard_texts())] + [(None, "with no id"), (5, "the same id"), (None, None), (7, ""), rows[3], rows[3]]
    want = sorted(by_definition(rows), key=str)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for small in (1 << 20, 10):  # pairs by broadcast, by shuffle
        out = alignment.align(with_clashes(docs).withColumn("pairs", F.lit("z")).withColumn("row", F.lit("z")), small=small)
        assert out.columns == ALIGNED and sorted(map(tuple, out.collect()), key=str) == want
    assert sum(w[1] == 0 for w in want) >= 5 and sum(w[3] > 5 for w in want) > 100
    assert alignment.align(docs.limit(0)).count() == 0


def test_stabbing_queries():
    draw = np.random.default_rng(3)
    for _ in range(300):
        n = int(draw.integers(1, 30))
        a, b = (sorted({n, *draw.integers(1, n + 1, int(draw.integers(0, n + 1))).tolist()}) for _ in range(2))
        spans = lambda ends: list(zip([0, *ends[:-1]], ends, strict=True))
        over = [[k for k, (s, e) in enumerate(spans(b)) if s < y and x < e] for x, y in spans(a)]
        first, last = alignment.overlaps(np.asarray(a), np.asarray(b))
        assert list(zip(first, last, strict=True)) == [(o[0], o[-1]) for o in over]
        cuts = alignment.groups(np.asarray(a), np.asarray(b))
        assert [a[k - 1] for k in cuts[0][1:]] == sorted(set(a) & set(b)) == [b[k - 1] for k in cuts[1][1:]]
    assert all(x.tolist() == [0] for x in alignment.groups(np.zeros(0, int), np.zeros(0, int)))


def test_units_start_afresh():
    small, large = (alignment.Units(*alignment.paths(), most=n) for n in (20, 10**6))
    tiny = alignment.Units(*alignment.paths(), most_bytes=2000)
    for lot in range(12):
        texts = [" ".join(f"w{k * 7 % (9 + lot)}-{lot}" for k in range(50)), "same words here", "long" * 4000 + str(lot)]
        want = alignment.aligned(large, texts)
        assert alignment.aligned(small, texts) == want == alignment.aligned(tiny, texts)
        assert len(small.place) <= 20 and tiny.bytes <= 2000 and not len(tiny.place)


# ---- 12: resampling


def grams(text, n):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)], len(w)


def resampled(rows, target, n=1, buckets=10000):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(bucket(g) for x in texts for g in grams(x, n)[0]) for texts in ([x for _, x in rows], target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for i, text in rows:
        found, size = grams(text, n)
        weight = sum(gain(bucket(g)) for g in found)
        h = int(sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), size >= 20))
    ranked = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    k = len(ranked) // 10
    return [(*r[:4], i + 1) for i, r in enumerate(ranked[:k])] + [(*r[:4], None) for r in ranked[k:] + [r for r in out if not r[4]]]


def test_resampling_by_definition(spark):
    rows = [(i, t) for i, t, *_ in corpus()] + [(100 + i, t) for i, t in enumerate(hard_texts())] + [(None, "word " * 30), (None, "word " * 30), (None, None), (7, "x1 " * 40), (7, "y2 " * 40)]
    rows += [(500 + k, " ".join(f"t{(k * j) % 17}" for j in range(25))) for k in range(60)]
    target = [" ".join(f"t{j % 5}" for j in range(30)), None, "", "word é漢 é漢"]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame([(t,) for t in target], "text string")
    for n, buckets in ((1, 10000), (2, 300)):
        got = resampling.resample(with_clashes(docs).withColumn("weight", F.lit("z")), bench, n=n, buckets=buckets)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(resampled(rows, target, n, buckets), key=str)
    assert resampling.resample(docs.limit(0), bench).count() == 0
    assert resampling.resample(docs, bench.limit(0)).filter("rank is not null").count() == len([r for r in resampled(rows, []) if r[4]])
    with pytest.raises(ValueError):
        resampling.features(docs, buckets=1 << 17)


def test_resampling_query_against_sql(spark, duck):
    same(resampling.op12_resampling(spark, SF).toPandas(), duck.execute(catalogue.oracle_sql()["op12_resampling"]).df())


def test_crc_of_spans():
    draw = random.Random(2)
    texts = [draw.randbytes(draw.choice((0, 1, 3, 47, 48, 49, 900))) for _ in range(300)]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    assert resampling.crc32s(data, at[:-1], at[1:]).tolist() == [zlib.crc32(t) for t in texts]


# ---- 13: URLs


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url[url.index("://") + 3 :]).groups()
    return host.translate(LOWER), path


def ruled(host, path):
    fits = []
    for said, rule in urls.RULES:
        own, begin = rule.split("/", 1)
        if (host == own or host.endswith("." + own)) and path.startswith("/" + begin):
            fits.append((len(rule), rule, said))
    return max(fits)[1:] if fits else (None, None)


def look(segments, k):
    if k >= len(segments):
        return ""
    s = segments[k]
    plain = "/" if s == "" else "#" if re.match(r"#(\.|$)", s) else "a#" if "#" in s else "a"
    return plain + ("." if "." in s else "")


def resembles(x, y):
    keys = [k for k in set(x) | set(y) if x[k] + y[k]]
    n, m = sum(x.values()), sum(y.values())
    if sum(abs(x[k] / n - y[k] / m) for k in keys) / 2 <= urls.CLOSE:
        return True
    chi = sum((c[k] - t * (x[k] + y[k]) / (n + m)) ** 2 / (t * (x[k] + y[k]) / (n + m)) for c, t in ((x, n), (y, m)) for k in keys)
    f = len(keys) - 1
    return chi <= f * (1 - 2 / (9 * f) + urls.Z * (2 / (9 * f)) ** 0.5) ** 3


def templates(paths, level=0):
    """[(segments, label, key)] of one node, recursively: key -> template."""
    out = {k: "" for s, _, k in paths if len(s) <= level}
    deeper = [p for p in paths if len(p[0]) > level]
    own = Counter(s[level] for s, _, _ in deeper)
    name = {s: s if len(own) <= urls.VARIETY or n >= urls.SHARE * len(deeper) else "*" for s, n in own.items()}
    flat = defaultdict(Counter)
    for s, label, _ in deeper:
        flat[name[s[level]]][look(s, level + 1), label] += 1
    groups = []
    for b in sorted(flat, key=lambda b: (-sum(flat[b].values()), b)):
        at = next((g for g in groups if resembles(g[1], flat[b])), None)
        if at is None:
            groups.append([[b], flat[b].copy()])
        else:
            at[0].append(b)
            at[1].update(flat[b])
    for names, _ in groups:
        said = names[0] if len(names) == 1 else f"({'|'.join(sorted(names))})"
        below = templates([p for p in deeper if name[p[0][level]] in names], level + 1)
        out |= {k: f"/{said}{t}" for k, t in below.items()}
    return out


def judged(rows, labels=None):
    hosts, out = defaultdict(list), []
    for k, (_, url) in enumerate(rows):
        host, path = split_url(url)
        rule, said = ruled(host, path)
        parts = re.sub("[0-9]+", "#", path).split("/")
        parts = parts[1:] if len(parts) <= urls.DEPTH + 1 else parts[1 : urls.DEPTH] + ["/".join(parts[urls.DEPTH :])]
        hosts[host].append((parts, said or (labels or {}).get(k), k))
        out.append((host, path, rule, said))
    bad = set()
    for paths in hosts.values():
        by, label = defaultdict(list), {k: x for _, x, k in paths}
        for k, t in templates(paths).items():
            by[t].append(k)
        for ks in by.values():
            blocked, allowed = (sum(label[k] == x for k in ks) for x in ("block", "allow"))
            if (blocked + 1) / (blocked + allowed + 2) >= urls.PURITY:
                bad |= set(ks)
    return [(i, h, p, r, said or ("block" if k in bad else "allow")) for k, ((i, _), (h, p, r, said)) in enumerate(zip(rows, out, strict=True))]


def test_urls_query(spark):
    for sf in (SF, SF.replace("0.001", "0.01")):
        rows = [(r["page_id"], r["url"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
        assert sorted(map(str, map(tuple, urls.op13_urls(spark, sf).collect()))) == sorted(map(str, judged(rows)))


def odd_urls():
    draw, rows = random.Random(4), []
    for k in range(1500):
        host = draw.choice(["Shop.example.org", "a.org:80", "b.net", "www.example.com", "EXAMPLE.com", "x.example.com", "com", "net", "é.org", ""])
        first = draw.choice(["en", "es", "fr", "spam", "user", "p", f"u{k}", f"slug-{k % 40}"])
        rest = draw.choice(["", "/", f"/{k}", f"/{k}.html", f"/title-{draw.choice('abcdefghijklmnopqrstu')}/{k}", "/" + "/".join(["deep"] * draw.randrange(12))])
        rows.append((k, f"http{draw.choice(['', 's'])}://{host}/{first}{rest}{draw.choice(['', '?q=/x', '#a?b', '?'])}"))
    odd = [None, "", "no scheme", "://", "http://", "http://com", "http://com/", "http://net?/es/", "http://net/es/", "http://x.net/es", "http://xnet/es/1", "http://a.com\n/b\nc", "a://b://c.com/en/", "http://www.example.com/en/x", "http://a.www.example.com/en/", "http://ww.example.com/en/9", "http://h.org/" + "y" * 20000, "http://*.org/*/*"]
    return rows + [(None, u) for u in odd] + [(3, odd[8]), rows[0], rows[0]]


def test_urls_by_definition(spark):
    rows = odd_urls()
    label = {k: "block" if "/spam" in (u or "") else "allow" if "/user" in (u or "") else None for k, (_, u) in enumerate(rows) if k % 3}
    pages = spark.createDataFrame([(i, u, label.get(k), "z", "z", 1) for k, (i, u) in enumerate(rows)], "page_id long, url string, mine string, host string, template string, n int").repartition(5)
    for at_most in (1 << 18, 3):
        for column, labels in ((None, None), ("mine", label)):
            got = urls.judge(pages, label=column, at_most=at_most)
            assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
            assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, judged(rows, labels)))
    found = [r for r in judged(rows, label) if r[3] is None and r[4] == "block"]
    assert len(found) > 20 and all("/spam" in r[2] for r in found if r[1] == "shop.example.org")  # templates that were learned
    assert urls.judge(pages.limit(0)).count() == 0


def test_templates_generalise_and_merge(spark):
    rows = [(f"s{k}", "/tag/w" + "abcdefghijklmnopqrst"[k % 20], "block") for k in range(60)]
    rows += [("h", f"/{lang}/{k}.html", None) for lang in ("de", "en") for k in range(50)] + [("h", f"/es/{k}.html", "block") for k in range(50)] + [("h", f"/en/{k}/", None) for k in range(3)]
    rows += [("h", "/tag/w" + x, "allow") for x in "abcdefghijklmnopqrst"]
    found = urls.templates(spark.createDataFrame(rows, "host string, path string, label string"))
    at = {(r["host"], r["shape"]): r["template"] for r in found.collect()}
    assert at["h", "/tag/wa"] == at["h", "/tag/wt"] == "/tag/*" and at["h", "/en/#.html"] == at["h", "/de/#.html"] == "/(de|en)/#.html"
    assert at["h", "/es/#.html"] == "/es/#.html" and {(r["host"], r["shape"]) for r in urls.rejected(found).collect()} == {("h", "/es/#.html")}
