"""Training-text operators against brute force, and on awkward rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cobordia.llm import chat, jaccard, licenses, mixing, neighbours, packing, passages, quality, textkernel, tokencount, toxicity
from cobordia.llm import catalogue
from tests.conftest import SF, same

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def prose(draw, n, size=400):
    return " ".join(f"{draw.choice('abcdefghij')}{draw.randrange(size)}" for _ in range(n))


def corpus():
    """Copies, near copies, shared passages, short, empty, null and long texts, and a repeated row."""
    draw = random.Random(5)
    line = "a stock line that many of these documents have in common with others here"
    texts = [prose(draw, draw.randrange(60, 200)) + "\n" + line for _ in range(30)]
    base = prose(draw, 120)
    near = []
    for _ in range(12):
        w = base.split()
        w[draw.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    shared = prose(draw, 70)
    mixed = [prose(draw, 40) + " " + shared + " " + prose(draw, draw.randrange(5, 40)) for _ in range(6)]
    rare = [None, "", " \n\t", "one", "One", "one two three", "x " * 200, prose(draw, 9000), line, line.upper(), "é ß Ж 漢字 " * 30]
    texts += near + mixed + [texts[0]] * 5 + rare
    rows = [(i, t, "en", None if i % 11 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[3]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def with_clashes(docs):
    """Columns whose names the operators use inside."""
    names = ["doc", "key", "id", "size", "place", "bucket", "source_size", "target", "n", "x", "y", "mark", "first", "cut_id", "mix_key", "t", "tok", "path", "file", "length", "salt", "number"]
    return docs.selectExpr("*", *(f"'z' as {n}" for n in names))


# ---- words and shingles


def test_kernel_finds_words_and_shingles():
    texts = [r[1] for r in corpus()] + ["a\x0bb\x0cc\rd\x1ce\x85f g"]
    seen = {}
    for begin, end, data, offsets in textkernel.blocks(pa.array(texts), 500):
        start, stop, hashed, first = textkernel.words(data, offsets, lower=False)
        for d in range(end - begin):
            got = [bytes(data[a:b]).decode() for a, b in zip(start[first[d] : first[d + 1]], stop[first[d] : first[d + 1]], strict=True)]
            assert got == WORDS.findall(texts[begin + d] or "")
            for w, h in zip(got, hashed[first[d] : first[d + 1]], strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


# ---- 1: passages


def test_compact_windows_by_definition():
    draw = np.random.default_rng(1)
    for _ in range(60):
        sizes = draw.integers(0, 30, 4)
        at, width = np.concatenate(([0], np.cumsum(sizes))), int(draw.integers(1, 12))
        r = draw.integers(1, draw.choice([5, 1000]), at[-1]).astype(np.uint64)
        want = []
        for d in range(4):
            for p in range(at[d], at[d + 1]):
                a = c = p
                while a > at[d] and r[a - 1] > r[p]:
                    a -= 1
                while c + 1 < at[d + 1] and r[c + 1] >= r[p]:
                    c += 1
                if c - a + 1 >= width:
                    want.append((a, p, c))
        assert list(zip(*(x.tolist() for x in passages.compact_windows(r, at, width)), strict=True)) == want


def test_passages_cover_shared_windows(docs):
    found = defaultdict(list)
    for r in passages.repeated_passages(docs).collect():
        assert r["ref_doc_id"] < r["doc_id"] and r["n_words"] >= 50 and r["jaccard"] >= 0.8
        found[r["doc_id"]].append((r["start"], r["start"] + r["n_words"]))
    first, checked = {}, 0
    for i, t, *_ in sorted(set(corpus()), key=lambda r: r[0]):
        w = words(t)
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), i) != i:
                # the first document of a group may end a few words before the others' common passage does
                assert sum(any(a <= x < b for a, b in found[i]) for x in range(k, k + 50)) >= 45, (i, k)
                checked += 1
    assert checked > 300
    shared_by_none = [i for i, t, *_ in corpus() if i < 30 and i not in (0,)]
    assert not any(found.get(i) for i in shared_by_none)


def test_passages_behind_earlier_parts(spark):
    """Later documents share a whole passage, of which earlier ones have halves, an edited version or the beginning."""
    draw, rows = np.random.default_rng(5), []
    text = lambda n: [f"w{x}" for x in draw.integers(0, 10**9, n)]
    for k in range(16):
        halves, edited, begun = text(90), text(80), text(110)
        other = [w if n % 14 else "changed" for n, w in enumerate(edited)]
        for i, passage in enumerate((halves[:45], halves[45:], halves, halves, other, edited, edited, begun[:60], begun, begun)):
            rows.append((100 * k + i, " ".join(text(60) + passage + text(60))))
    found = defaultdict(set)
    for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found[r["doc_id"]].update(range(r["start"], r["start"] + r["n_words"]))
    for k in range(16):
        for i, n in ((3, 90), (6, 80), (9, 110)):
            assert found[100 * k + i] >= set(range(60, 60 + n)), (k, i)


def test_passages_that_were_edited(spark):
    """Two late documents share a passage up to edits (Jaccard 0.80 to 0.90); three earlier ones have a third of it, a version
    with an edit in every nine words, and the other with two edits more."""
    draw, rows, planted = np.random.default_rng(17), [], []
    text = lambda n: [f"w{x}" for x in draw.integers(0, 10**9, n)]

    def edited(words_, places):
        out = list(words_)
        for p in places:
            out[p] = f"e{draw.integers(0, 10**9)}"
        return out

    for k in range(60):
        n, edits = ((60, 1), (100, 2), (200, 4), (150, 3), (80, 1))[k % 5]
        base, at = text(n), lambda n=n, edits=edits: sorted(draw.choice(np.arange(5, n - 5, 12), edits, replace=False).tolist())
        other = edited(base, at())
        heads = [base[: n // 3], edited(base, range(3, n, 9)), edited(other, [*at(), 7, n - 9])]
        rows += [(100 * k + i, " ".join(text(60) + p + text(60))) for i, p in enumerate([*heads, base, other])]
        sets = [{tuple(p[i : i + 5]) for i in range(n - 4)} for p in (base, other)]
        assert 0.8 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.9
        planted.append((100 * k + 4, n))
    found = defaultdict(set)
    for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        found[r["doc_id"]].update(range(r["start"], r["start"] + r["n_words"]))
    assert sum(len(found[i] & set(range(60, 60 + n))) >= 0.8 * n for i, n in planted) >= 0.9 * len(planted)
    assert not any(x < 55 or x >= 65 + n for i, n in planted for d in range(5) for x in found[i - d])


def test_passages_around_what_was_cut_out():
    draw = np.random.default_rng(6)

    def shingles(w):
        return np.asarray([hash(tuple(w[k : k + 5])) & (1 << 62) - 1 for k in range(len(w) - 4)], np.uint64)

    for stray in range(2):
        before, cut, after = (draw.integers(0, 10**9, n).tolist() for n in (90, 200, 90))
        near, near_after = before.copy(), after.copy()
        near[45] = near_after[45] = -1
        tail = draw.integers(0, 10**9, 900).tolist()
        ref = (before[50:60] if stray else []) + tail + before + cut + after
        for x, want in ((near + after, [(0, 86), (90, 176)]), (near + near_after, [(0, 86), (90, 176)]), (after + near, [(0, 86), (90, 176)])):
            got = passages.similar_passages(shingles(x), shingles(ref), 46, 0.8)
            for lo, hi in want:
                assert any(a <= lo and hi <= b + 1 and s >= 0.8 for a, b, _, s in got), (x, got)
    # what stands earlier in part: the whole is found all the same
    whole = draw.integers(0, 10**9, 100).tolist()
    assert passages.similar_passages(shingles(whole), shingles(whole[:60] + [-1] + whole), 46, 0.8)[0][:2] == (0, 95)


def test_cutting_leaves_clean_documents_alone(docs):
    spans = passages.repeated_passages(docs)
    cut = {r["doc_id"]: r for r in passages.cut_passages(docs, spans).collect()}
    touched = {r["doc_id"] for r in spans.collect()}
    for i, t, *_ in corpus():
        if i not in touched:
            assert cut[i]["text"] == t
        elif i in cut:
            assert len(words(cut[i]["text"])) < len(words(t)) and cut[i]["n_chars"] == len(cut[i]["text"])
    again = passages.cut_passages(docs, spans.limit(0))
    assert again.count() == len(corpus())


def test_passages_of_shared_and_missing_ids(spark):
    """Several texts under one id, and under none: spans are cut from the text they were found in, in any row order."""
    draw = random.Random(21)
    shared, alone = prose(draw, 80), [prose(draw, 90) for _ in range(4)]
    rows = [(1, f"{alone[0]} {shared}"), (5, f"{shared} {alone[1]}"), (5, alone[2]), (5, "few words"), (None, f"{alone[3]} {shared}"), (None, "none at all"), (None, None), (7, shared), (7, shared), (8, None)]
    for order in range(3):
        docs = spark.createDataFrame(draw.sample(rows, len(rows)), "doc_id long, text string").repartition(1 + order)
        spans = passages.repeated_passages(docs)
        assert {(r["doc_id"], r["ref_doc_id"]) for r in spans.collect()} >= {(5, 1), (7, 1), (None, 1)}
        cut = Counter((r["doc_id"], r["text"] and r["text"].strip()) for r in passages.cut_passages(docs, spans).collect())
        assert cut == Counter([(1, rows[0][1]), (5, alone[1]), (5, alone[2]), (5, "few words"), (None, alone[3]), (None, "none at all"), (None, None), (8, None)])


# ---- 2: mixing


def check_mix(rows, sizes):
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
        assert r["size"] == sizes[r["key"]] and r["taken"] in (0, r["size"], 2 * r["size"])
    order = sorted((s for s in by if s is not None)) + [None] * (None in by)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total = {s: sum(r["size"] for r in by[s]) for s in order}
    goal, open_, left = {}, set(order), 1.5 * sum(total.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 2 * total[s]]
        if not over:
            break
        for s in over:
            goal[s] = 2.0 * total[s]
            left -= goal[s]
            open_.discard(s)
    goal |= {s: level * weight[s] for s in open_}
    for s in order:
        largest = max(r["size"] for r in by[s])
        assert abs(by[s][0]["target"] - goal[s]) < 1e-6
        assert abs(sum(r["taken"] for r in by[s]) - goal[s]) <= largest


def test_mixing_meets_targets(docs):
    rows = mixing.mix_sources(docs).collect()
    check_mix(rows, {i: len(WORDS.findall(t or "")) for i, t, *_ in corpus()})
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(docs.repartition(5)).collect()))


def test_mixed_rows_without_a_key_of_their_own(spark):
    rows = [(None if n % 3 == 0 else n // 4, " ".join(f"w{n}_{k}" for k in range(5 + n % 7)), "abc"[n % 3 and 1 + n % 2]) for n in range(120)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want, got = Counter(), Counter()
    for r in mixing.mix_sources(d).collect():
        want[r["key"], r["source"], r["size"]] += r["repeats"]
    for r in mixing.mixed(d).collect():
        got[r["doc_id"], r["source"], len(r["text"].split())] += 1
    assert got == +want and any(k[0] is None for k in got)


def test_mixed_rows(docs):
    plan = {r["key"]: r["repeats"] for r in mixing.mix_sources(docs.dropDuplicates(["doc_id"])).collect()}
    got = Counter(r["doc_id"] for r in mixing.mixed(docs.dropDuplicates(["doc_id"])).collect())
    assert got == Counter({k: n for k, n in plan.items() if n})


# ---- 3: licences


def wrap(text, width, mark=""):
    import textwrap

    return "\n".join(mark + line for line in textwrap.wrap(text, width))


def test_license_inheritance(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.py", "plain words"), (3, "a/b/LICENSE", "nothing of the kind"), (4, "a/c/LICENSE", "Licensed under CC BY-NC 4.0."),
        (5, "a/c/d/y.py", None), (6, "a/c/d/z.py", "# Licensed under the Apache License, Version 2.0.\ncode"), (7, "q/r.py", ""), (8, None, "Released under the MIT License."), (9, "ac/v.py", "x"), (1, "a/LICENSE", "Released under the MIT License."),
    ]
    out = licenses.license_scan(with_clashes(spark.createDataFrame(rows, "doc long, p string, text string").withColumnsRenamed({"doc": "number_", "p": "p_"})).drop("file", "path").withColumnsRenamed({"number_": "file", "p_": "path"}))
    got = {r["file"]: (r["license"], r["source_dir"]) for r in out.collect()}
    assert out.count() == len(rows)
    assert got == {1: ("MIT", None), 2: ("MIT", "a"), 3: ("MIT", "a"), 4: ("CC-BY-NC-4.0", None), 5: ("CC-BY-NC-4.0", "a/c"), 6: ("Apache-2.0", None), 7: (None, None), 8: ("MIT", None), 9: (None, None)}
    empty = spark.createDataFrame([], "file long, path string, text string")
    assert licenses.license_scan(empty).count() == 0 and licenses.license_scan(out.select("file", "path", "own").withColumnRenamed("own", "text"), []).filter("license is not null").count() == 0


def test_license_texts(spark):
    """Whole licences, headers in comments, wrapped notices, and prose that only speaks of licences."""
    draw = random.Random(2)
    whole, code = licenses.TEXTS, "\n".join(f"x{k} = f({k})" for k in range(60))
    terms = "\n\n".join(wrap(f"{k}. " + prose(draw, 120), 76) for k in range(12))
    files = {
        "mit/LICENSE": ("MIT", "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + wrap(whole["MIT"], 78)),
        "bsd/COPYING": ("BSD-3-Clause", "Copyright 2019 The Authors. All rights reserved.\n\n" + wrap(whole["BSD-3-Clause"], 70)),
        "bsd2/LICENSE.txt": ("BSD-2-Clause", wrap(whole["BSD-2-Clause"], 70)),
        "isc/LICENSE": ("ISC", "ISC License\nCopyright (c) 2001 Someone\n" + wrap(whole["ISC"], 80)),
        "apache/LICENSE": ("Apache-2.0", "Apache License\nVersion 2.0, January 2004\n" + terms + "\n\nAPPENDIX: How to apply\n\n" + wrap(whole["Apache-2.0"], 74, "   ")),
        "gpl/COPYING": ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n" + terms + "\n\n" + wrap(whole["GPL-3.0"], 72, "    ") + "\n\n" + terms),
        "src/a.py": ("Apache-2.0", "#!/usr/bin/env python\n# Copyright 2020 Some Company\n#\n" + wrap(whole["Apache-2.0"], 70, "# ") + "\n\nimport os\n" + code),
        "src/a.c": ("MPL-2.0", "/* " + wrap(whole["MPL-2.0"], 60, " * ")[3:] + " */\n#include <x.h>\n" + code),
        "src/b.c": ("MIT", "/*\nCopyright (c) 1999 B\n\n" + wrap(whole["MIT"], 75) + "\n*/\nint main;\n" + code),
        "src/c.cc": ("BSD-3-Clause", "// Copyright 2014 The Authors.\n// This file sets up the tables of the parser.\n//\n" + wrap("Licensed under the BSD 3-Clause License.", 22, "// ") + "\n" + code),
        "src/d.html": ("GPL-3.0", "<!-- " + wrap(whole["GPL-3.0"], 66) + " -->\n<p>text</p>"),
        "src/d.sql": ("LGPL-3.0", wrap(whole["LGPL-3.0"], 80, "-- ") + "\nselect 1"),
        "src/e.py": ("MIT", '"""\nReleased under the MIT License.\n"""\n' + code),
        "no/a.py": (None, "# Drives the licence office's printer.\n" + code + "\n# Licensed under the Apache License, Version 2.0.\n"),
        "no/b.txt": (None, "The committee discussed for hours whether a driving licence should be permitted under the new rules.\nCopyright was not on the agenda, and no warranty was given."),
        "no/LICENSE": (None, "All software in this folder is secret. Ask before you copy, use or change any of it, in whole or in part, for any purpose."),
        "no/c.txt": (None, prose(draw, 3000)),
        "no/d.txt": (None, "the license " * 500),
    }
    rows = [(n, path, text) for n, (path, (_, text)) in enumerate(files.items())]
    got = {r["path"]: (r["own"], r["cosine"]) for r in licenses.license_scan(spark.createDataFrame(rows, "file long, path string, text string").repartition(3)).collect()}
    assert {p: own for p, (own, _) in got.items()} == {p: own for p, (own, _) in files.items()}
    assert got["mit/LICENSE"][1] > 0.9 and got["bsd2/LICENSE.txt"][1] == 1.0


def test_license_windows_by_brute_force(spark):
    """No bound loses a window: every one of every text, scored one by one."""
    draw = random.Random(3)
    notices = [body for _, body in licenses.TEMPLATES]
    texts = []
    for _ in range(60):
        lines = [prose(draw, draw.randrange(1, 12), 40) for _ in range(draw.randrange(1, 9))]
        words_ = draw.choice(notices).split()
        cut = words_[draw.randrange(0, 4) : len(words_) - draw.randrange(0, 4)]
        each = draw.randrange(2, 14)
        at = draw.randrange(len(lines) + 1)
        texts.append("\n".join(lines[:at] + [" ".join(cut[i : i + each]) for i in range(0, len(cut), each)] + lines[at:]))
    term = re.compile(licenses.WORD)
    df = Counter(t for x in texts for t in set(term.findall(x.lower())))
    vocabulary = {t for b in notices for t in term.findall(b.lower())}
    idf = lambda t: np.log((1 + len(texts)) / (1 + (df[t] if t in vocabulary else 0))) + 1
    vector = lambda w: {t: n * idf(t) for t, n in Counter(w).items()}
    size = lambda v: np.sqrt(sum(x * x for x in v.values()))
    models = [(f"{k} {n}", k, vector(term.findall(b.lower()))) for n, (k, b) in enumerate(licenses.TEMPLATES)]
    want = {}
    for n, x in enumerate(texts):
        lines = [w for w in (term.findall(line.lower()) for line in x.split("\n")) if w]
        spans = [(0, len(lines))] + [(a, s) for s, step in licenses.SIZES.items() if len(lines) > s for a in range(0, len(lines) - s + 1, step)]
        best = (0.8, "", None)
        for a, s in spans:
            v = vector([t for line in lines[a : a + s] for t in line])
            for template, own, m in models:
                c = round(sum(v[t] * m[t] for t in v.keys() & m.keys()) / size(v) / size(m), 6)
                if c > best[0] or (c == best[0] and (not best[1] or template < best[1])):
                    best = (c, template, own)
        want[n] = (best[2], best[0] if best[2] else None)
    got = {r["file"]: (r["own"], r["cosine"]) for r in licenses.license_scan(spark.createDataFrame([(n, "x", t) for n, t in enumerate(texts)], "file long, path string, text string")).collect()}
    assert got == want and len({w[0] for w in want.values()}) > 5 and any(w[0] is None for w in want.values())


# ---- 4: token counts


def test_token_counts_by_viterbi(docs):
    scores = tokencount.unigrams(tokencount.model_path())

    def count(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            size = len(word[end - 1].encode())
            found = [(best[end - 1][0] - tokencount.BYTE_COST * size, best[end - 1][1] - size)]
            found += [(best[k][0] + scores[word[k:end]], best[k][1] - 1) for k in range(max(0, end - 20), end) if word[k:end] in scores]
            best.append(max(found))
        return -best[-1][1]

    known = {}
    long = [(900, "abcdefghij" * 50 + " " + "Ж漢" * 40 + " " + "abcdefghij" * 50 + "x", None, None, 0)]
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in tokencount.token_counts(docs.unionByName(docs.sparkSession.createDataFrame(long, DOCS))).collect()}
    for i, t, *_ in corpus() + long:
        w = WORDS.findall(t or "")
        for x in set(w).difference(known):
            known[x] = count("▁" + x)
        assert got[i] == (len(w), sum(map(known.__getitem__, w)))


def test_trie_keeps_no_more_than_its_bounds():
    scores = tokencount.unigrams(tokencount.model_path())
    trie, whole, most = tokencount.Trie(scores, kept=20_000), tokencount.Trie(scores), 0
    for k in range(30):
        words = {b"data:" + b"x" * 1995 + str(1000 * k + j).encode() for j in range(100)} | {f"w{k}-{j}".encode() for j in range(200)} | {b"same"}
        trie.learn(words)
        whole.learn(words)
        assert all(trie.counts[w] == whole.counts[w] for w in words)
        trie.forget_long()
        assert trie.bytes == sum(map(len, trie.counts)) and max(map(len, trie.counts)) < 64
        most = max(most, trie.bytes)
    assert most < 24_000


def test_trie_computes_a_prefix_once():
    trie = tokencount.Trie({"▁a": -1.0, "b": -2.0, "ab": -1.5, "c": -3.0, "▁": -1.0}, 40)
    trie.learn({b"abc", b"abd", b"a"})
    nodes = len(trie.best)
    assert nodes == 6 and trie.counts[b"abc"] == 3
    trie.learn({b"abcd", b"ab"})  # in another block: one node more, for abcd
    assert len(trie.best) == nodes + 1 and trie.counts[b"ab"] == 2
    fresh = tokencount.Trie(trie.scores)
    words = {"".join(random.Random(k).choices("abcd", k=1 + k % 90)).encode() for k in range(300)}
    fresh.learn(words)
    for k in range(0, 300, 7):  # starts afresh again and again
        some = set(sorted(words)[k : k + 7])
        trie.learn(some)
        assert all(trie.counts[w] == fresh.counts[w] for w in some)


# ---- 5: chat


def test_preference_pairs(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "q"), (1, 1, "assistant", "good"), (2, 0, "user", "q"), (2, 1, "assistant", "bad"), (2, 2, "user", None), (3, 0, "user", "only"), (5, 0, None, "a"), (6, 0, None, "a"), (None, 0, "user", "lost")],
        "conv_id long, turn long, role string, text string",
    )
    pairs = spark.createDataFrame([(1, 1, 2), (2, 3, None), (3, 5, 6)], "pair_id long, chosen_id long, rejected_id long")
    got = {r["pair_id"]: r for r in chat.preference_format(with_clashes(turns), pairs).collect()}
    r = got[1]
    assert (r["n_prompt_turns"], r["prompt"]) == (1, "<|user|>\nq<|end|>\n")
    assert r["chosen"] == "<|assistant|>\ngood<|end|>\n" and r["rejected"] == "<|assistant|>\nbad<|end|>\n<|user|>\n<|end|>\n"
    a, b = map(int, r["chosen_mask"].split("-"))
    assert r["chosen"][a:b] == "good<|end|>"
    assert got[2]["prompt"] == "" and got[2]["chosen"].endswith("only<|end|>\n") and got[2]["rejected"] == ""
    assert (got[3]["n_prompt_turns"], got[3]["chosen"], got[3]["rejected"]) == (1, "", "")
    assert chat.preference_format(turns.limit(0), pairs).count() == 0


# ---- 6: toxicity


def test_toxicity_holds_out(spark):
    x = toxicity.op6_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    n = {(r["toxic"], r["predicted"]): r["n"] for r in x.filter("held_out").groupBy("toxic", "predicted").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.85 and n[0, 0] / (n[0, 0] + n.get((0, 1), 0)) > 0.97


def test_toxicity_of_nothing(spark, docs, empty):
    texts = [b"idiot hello there", b"hello there friend", b"you idiot", b""]
    model = toxicity.Model(0.25).fit([t.split() for t in texts], np.array([1, 0, 1, 0]))
    got = {r["id"]: r["score"] for r in toxicity.score_documents(docs, model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and {round(got[i], 9) for i, t, *_ in corpus() if not words(t)} == {0.25}
    labels = spark.createDataFrame([(1, None), (2, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    assert toxicity.learn(docs, labels) is None and toxicity.learn(docs, labels.limit(0)) is None
    assert {r["score"] for r in toxicity.score_documents(docs, None).select(toxicity.F.round("score", 9).alias("score")).collect()} == {0.1}
    assert toxicity.score_documents(empty, model).count() == toxicity.drop_toxic(empty, model).count() == 0
    assert toxicity.drop_toxic(docs, None).count() == docs.count()
    plain, crowded = toxicity.drop_toxic(docs, model), toxicity.drop_toxic(with_clashes(docs), model)
    assert sorted(map(str, crowded.select(plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_toxicity_scores_by_definition(spark):
    """Each span's n-grams averaged one by one; the strongest span is the score."""
    draw, span = random.Random(8), 4
    model = toxicity.Model(0.3, span).fit([[b"idiot", b"and", b"more"], [b"some", b"plain", b"words"]], np.array([1, 0]))
    odds = model.odds().astype(np.float32).astype(float)

    def one(text):
        w = [x.strip(toxicity.MARKS.decode()) for x in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]
        best = []
        for k in range(max(1, len(w) - span + 1) if w else 0):
            found = [odds[toxicity.bag([x.encode()])[0]] for x in w[k : k + span]]
            found = np.concatenate(found) if found else np.zeros(0)
            best.append(found.mean() if len(found) else 0.0)
        return 1 / (1 + np.exp(-(max(best, default=0.0) + model.bias)))

    vocabulary = ["idiot", "Idiot!", "id!ot", "plain", "words", "und", "süß", "...", "more,", "漢字"]
    texts = [None, "", "...", "idiot", *(" ".join(draw.choice(vocabulary) for _ in range(draw.randrange(1, 40))) for _ in range(60)), "plain words " * 3000 + "idiot " + "words " * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.score_documents(rows, model).collect():
        assert abs(r["score"] - one(texts[r["id"]])) < 1e-6, texts[r["id"]]


def test_toxicity_learns_the_same_from_repeated_ids(spark):
    rows = [(i, f"{'idiot' if i % 2 else 'friend'} number {i}") for i in range(40)] + [(1, "another text"), (2, "a text"), (2, "a text"), (None, "idiot")]
    labels = spark.createDataFrame([(i, i % 2, "z") for i in range(40)], "doc_id long, toxic int, text string")
    draw, seen = random.Random(4), []
    for k in range(3):
        docs = spark.createDataFrame(draw.sample(rows, len(rows)), "doc_id long, text string").repartition(1 + k)
        model = toxicity.learn(with_clashes(docs), labels)
        seen.append((model.odds().tobytes(), model.bias))
    assert len(set(seen)) == 1 and abs(model.bias) < 1


def test_training_words_are_bounded():
    text = " ".join(f"w{k}" for k in range(10_000)).encode()
    some = toxicity.training_words(text, 8, 100).split()
    assert len(some) == 800 and some == toxicity.training_words(text, 8, 100).split() and toxicity.training_words(b"a, (b) ... c", 8, 100) == b"a b c"


def test_bags_share_subwords():
    grams, at = toxicity.bag([b"stupid", b"stupidd", b"x", b""])
    assert len(set(grams[at[0] : at[1]]) & set(grams[at[1] : at[2]])) >= 14 and at[3] - at[2] == 1 and at[4] == at[3]


# ---- 7: packing


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(packing.tokenizer_path())
    odd = [(1000, "<|endoftext|> and <|ENDOFTEXT|>", None, None, 0), (1001, "don't A.,b ,. x1.2,3 É́é\x1c\x85.", None, None, 0)]
    rows = packing.pack(docs.unionByName(docs.sparkSession.createDataFrame(odd, DOCS))).collect()
    by, sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    copies = Counter(r[0] for r in corpus())
    for i, t, *_ in set(corpus()) | set(odd):
        ids, at = np.asarray([*encode.encode(t or "", add_special_tokens=False).ids, 2], "<u4"), 0
        own = sorted(by[i], key=lambda r: r["start"])[:: copies.get(i, 1)]
        for r in own:
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert sum(r["length"] for r in rows) > 0.9 * 4096 * (len(sequence) - 1)


def test_packing_in_small_groups(spark):
    """Many full windows, numbered in groups that grow in number with them."""
    rows = spark.createDataFrame([(1, "word " * 400_000), (None, None), (2, "a few words"), (2, "a few words")], "doc_id long, text string")
    out = packing.pack(rows, group=8).collect()
    assert sorted(r["length"] for r in out) == [1, 4, 4, 400_001 % 4096] + [4096] * (400_001 // 4096)
    assert len({(r["sequence_id"], r["offset"]) for r in out}) == len(out) and {r["sequence_id"] for r in out} == set(range(400_001 // 4096 + 1))


def test_plan_is_best_fit_decreasing():
    draw = random.Random(2)
    for window in (16, 100):
        sizes = [draw.randint(1, window - 1) for _ in range(300)]
        free: list[int] = []
        for n in sorted(sizes, reverse=True):
            fits = [k for k, f in enumerate(free) if f >= n]
            if fits:
                free[min(fits, key=lambda k: free[k])] -= n
            else:
                free.append(window - n)
        runs = packing.plan(Counter(sizes), window)
        used = defaultdict(list)
        for length, _, many, first, offset in runs:
            for k in range(many):
                used[first + k].append((offset, length))
        assert Counter(n for p in used.values() for _, n in p) == Counter(sizes)
        assert sorted(window - sum(n for _, n in p) for p in used.values()) == sorted(free)


# ---- 8: Jaccard


def test_jaccard_components(docs):
    sets = {i: shingles(t) for i, t, *_ in corpus()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    rows = jaccard.jaccard_groups(docs).collect()
    assert len(rows) == len(corpus())
    for r in rows:
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]))
    kept = {r["doc_id"] for r in jaccard.keep_first_of_groups(docs).collect()}
    assert kept == {i for i in sets if find(i) == i}
    assert jaccard.keep_first_of_groups(docs).count() == len(kept)


def test_jaccard_chains_and_hot_tokens(spark):
    """Many documents of one stock line each with its own words, and a chain in which only neighbours link."""
    draw = random.Random(9)
    stock = prose(draw, 30)
    rows = [(i, stock + " " + prose(draw, 6, 10_000)) for i in range(80)]
    chain = [f"w{k}" for k in range(300)]
    rows += [(100 + k, " ".join(chain[4 * k : 4 * k + 90])) for k in range(40)]
    sets = {i: shingles(t) for i, t in rows}
    links = {(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    root = {i: i for i in sets}
    for _ in range(100):
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == root and len(set(root.values())) < len(rows)


def test_jaccard_shared_and_missing_ids(spark):
    """Two texts under one id, rows without an id and repeated rows, in any order."""
    draw = random.Random(12)
    a, b, c, d = (prose(draw, 150).split() for _ in range(4))
    edit = lambda w: " ".join([*w[:70], "changed", *w[71:]])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (6, edit(a)), (7, edit(b)), (None, " ".join(c)), (None, edit(c)), (8, edit(c)), (None, " ".join(d)), (None, " ".join(d)), (9, ""), (9, ""), (None, None), (4, " ".join(d[:3])), (4, " ".join(d[:3]))]
    for order in range(3):
        docs = spark.createDataFrame(draw.sample(rows, len(rows)), "doc_id long, text string").repartition(1 + order)
        got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"] > 0, r["component_id"]) for r in jaccard.jaccard_groups(docs).collect()), key=str)
        want = [(False, 5, True, 5)] * 2 + [(False, 6, True, 5), (False, 7, True, 5), (False, 8, True, 8)] + [(True, 0, True, 8)] * 2 + [(True, 0, True, None)] * 2
        want += [(False, 9, False, 9)] * 2 + [(True, 0, False, None)] + [(False, 4, True, 4)] * 2
        assert got == sorted(want, key=str)
        kept = jaccard.keep_first_of_groups(docs).collect()
        assert Counter(r["doc_id"] for r in kept) == {5: 2, 8: 1, None: 2, 9: 2, 4: 1}
        assert Counter(r["text"] for r in kept if r["doc_id"] is None) == {" ".join(d): 1, None: 1}


# ---- 9: neighbours


def test_neighbours_exact_at_factor_one_and_recall(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(900, 12)) * draw.uniform(0.2, 3, (900, 1))
    x[17] = x[400]
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    bad = [(1000, None), (1020, []), (1040, [0.0] * 12), (1060, [float("nan")] * 12), (1080, [None] * 12), (1100, [float("inf")] + [0.0] * 11), (1120, [1.0] * 5), (None, [1.0] * 12), (3, rows[3][1])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    v = x.astype(np.float32).astype(float)
    want = {}
    for q in range(0, 900, 20):
        s = v @ v[q]
        want[q] = [i for _, i in sorted((-s[i], i) for i in range(900) if i != q)][:20]
    for factor, least in ((1.0, 1.0), (neighbours.FACTOR, 0.9)):
        got = defaultdict(list)
        for r in neighbours.nearest(with_clashes(df), neighbours.F.col("vec_id") % 20 == 0, shard=300, factor=factor).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append(r["vec_id"])
            assert r["query_id"] == 1120 or abs(r["score"] - v[r["query_id"]] @ v[r["vec_id"]]) < 1e-9
        assert set(got) <= set(want) | {1120}
        assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= least
    assert neighbours.nearest(df.limit(0), neighbours.F.col("vec_id") % 20 == 0).count() == 0


def test_neighbours_of_uneven_norms(spark):
    """Norms spread 1:100, a few of them far out: exact at factor 1, recall at the default; groups beyond the largest."""
    draw = np.random.default_rng(14)
    x = draw.normal(size=(6000, 24))
    x *= (10 ** draw.uniform(-1, 1, 6000))[:, None]
    x[:3] *= np.asarray([[1.0], [50.0], [1000.0]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    even = x[1000:] / np.linalg.norm(x[1000:], axis=1)[:, None]
    even[0] *= 40  # one outlier among vectors of one norm
    flat = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(even)], "vec_id long, embedding array<double>")
    for v, rows, factor, least, groups in ((x, df, 1.0, 1.0, 1024), (x, df, 1.0, 1.0, 4), (x, df, neighbours.FACTOR, 0.9, 1024), (even, flat, neighbours.FACTOR, 0.9, 1024), (even, flat, 1.0, 1.0, 1024)):
        got = defaultdict(set)
        for r in neighbours.nearest(rows, neighbours.F.col("vec_id") % 20 == 0, shard=500, factor=factor, most_groups=groups).collect():
            got[r["query_id"]].add(r["vec_id"])
        right = 0
        for q in range(0, len(v), 20):
            s = v @ v[q]
            s[q] = -np.inf
            right += len(got[q] & set(np.lexsort((np.arange(len(v)), -s))[:20].tolist()))
        assert right / (20 * len(range(0, len(v), 20))) >= least, (factor, groups)


# ---- 10: quality


def test_quality_by_definition():
    def brute(t, least):
        w, n = WORDS.findall(t or ""), len(WORDS.findall(t or ""))
        three = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
        again = {k for i in range(n - 2) if three[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
        seen, lines = set(), 0
        for line in (t or "").split("\n"):
            if WORDS.search(line):
                lines += line in seen
                seen.add(line)
        covered, longest = set(), 0
        for i in range(n):
            for j in range(n):
                k = 0
                while i != j and max(i, j) + k < n and w[i + k] == w[j + k]:
                    k += 1
                if k >= least:
                    longest = max(longest, k)
                    covered |= set(range(i, i + k))
        return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), lines, len(again), len(covered), longest

    draw = random.Random(3)
    texts = ["", None, "a b", "x\n\nx\n x\nx ", "\n", "é ö%% ##\r\nq\r\nq\r", "y " * 90]
    for _ in range(80):
        v = [draw.choice("abcdefghijkl") + draw.choice(["", "é", "%"]) for _ in range(draw.choice([2, 5, 20, 60]))]
        a = [draw.choice(v) for _ in range(draw.randint(1, 40))]
        d = a + [draw.choice(v) for _ in range(draw.randint(0, 30))] + a[: draw.randint(0, len(a))] + a[draw.randint(0, len(a) - 1) :]
        texts.append("".join(x + draw.choice([" ", "\n", "  ", "\t"]) for x in d))
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["a", "b"])
    for least in (10, 3):
        rows = pa.Table.from_batches(list(quality.judge(least, 0.5, 100)([batch]))).to_pylist()
        for t, r in zip(texts, rows, strict=True):
            want = brute(t, least)
            assert tuple(list(r.values())[1:8]) == want
            failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
            assert r["base_failed"] == failed and r["kept"] == (not failed and want[5] <= 0.5 * want[0] and want[6] <= 100)


def test_quality_of_a_very_long_text(spark):
    part = prose(random.Random(1), 30_000, 10**6)
    text = f"{part} {part[: part.index(' ', 60_000)]}"
    (r,) = quality.quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    again = len(part[: part.index(" ", 60_000)].split())
    assert (r["n_words"], r["longest_repeat"], r["covered_words"], r["kept"]) == (30_000 + again, again, 2 * again, False)


# ---- all


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, duck, name):
    same(catalogue.queries()[name](spark, SF).toPandas(), duck.sql(catalogue.oracle_sql()[name]).df())


@pytest.mark.parametrize("run", [passages.repeated_passages, mixing.mix_sources, tokencount.token_counts, packing.pack, jaccard.jaccard_groups, quality.quality_rules, mixing.mixed, jaccard.keep_first_of_groups])
def test_empty_tables_and_clashing_columns(docs, empty, run):
    assert run(empty).count() == 0
    plain, crowded = run(docs), run(with_clashes(docs))
    assert sorted(map(str, crowded.select(plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_null_ids(spark):
    rows = [(None, "some words of a text", "en", "a", 1), (1, "some words of a text", "en", "a", 1), (None, None, None, None, None)]
    d = spark.createDataFrame(rows, DOCS)
    assert mixing.mix_sources(d).count() == quality.quality_rules(d).count() == tokencount.token_counts(d).count() == 3
    assert packing.pack(d).count() == 3 and jaccard.jaccard_groups(d).count() == 3
    assert passages.repeated_passages(d).count() == 0 and passages.cut_passages(d, passages.repeated_passages(d)).count() == 3
    assert sorted(str(r["doc_id"]) for r in jaccard.keep_first_of_groups(d).collect()) == ["1", "None"]


def test_places_number_keys_as_they_come():
    draw, places, known = np.random.RandomState(3), textkernel.Places(), {}
    for _ in range(20):
        keys = np.unique(draw.randint(0, 3000, 400).astype(np.uint64) * np.uint64(6148914691236517))
        found = places.find(keys)
        assert found.tolist() == [known.get(k, -1) for k in keys.tolist()]
        places.add(keys[found < 0])
        known.update(zip(keys[found < 0].tolist(), range(len(known), len(known) + int((found < 0).sum())), strict=True))
        assert len(places) == len(known)


def test_word_ids_start_afresh_beyond_their_bound():
    whole, small = packing.WordIds(packing.tokenizer_path()), packing.WordIds(packing.tokenizer_path(), most=500)
    for _, _, data, offsets in textkernel.blocks(pa.array([t for _, t, *_ in corpus()]), 1 << 14):
        for x, y in zip(whole.of(data, offsets), small.of(data, offsets), strict=True):
            assert x.tolist() == y.tolist()


def test_workers_of_the_jaccard_join_and_of_toxicity_stay_small():
    """Peak of what numpy and Python hold, for a block of a million shingles and for 8 MB of text."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from cobordia import session
    from cobordia.llm import jaccard as J
    from cobordia.llm import toxicity as X

    def peak(f) -> float:
        tracemalloc.start()
        f()
        most = tracemalloc.get_traced_memory()[1] / 2**20
        tracemalloc.stop()
        return most

    draw = np.random.RandomState(1)
    words = [f"w{k}" for k in range(3000)]
    texts = [" ".join(draw.choice(words, 6000)) for _ in range(180)]
    docs = [pa.RecordBatch.from_arrays([pa.array(texts[k : k + 30])], names=["text"]) for k in range(0, 180, 30)]
    made = []
    assert peak(lambda: made.extend(J._blocks_of_tokens(1)(iter(docs)))) < 70
    one = pa.Table.from_batches(made)
    assert one.num_rows == 2 and peak(lambda: J._count(one)) < 60
    scored = X.scores(np.zeros(X.BUCKETS), 0.0, 0.0, 6, "peak")
    lot = [pa.RecordBatch.from_arrays([pa.array(range(180)), pa.array(texts)], names=["id", "text"])]
    assert peak(lambda: list(scored(iter(lot)))) < 30
    assert session.BATCHES["spark.sql.execution.arrow.maxBytesPerBatch"] <= 2 << 20
