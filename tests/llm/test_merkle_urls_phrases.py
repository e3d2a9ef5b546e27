"""Merkle manifest, URL filter and phrase mining against brute force, with nulls, ties, repeats and clashing columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollbook.llm import merkle, phrases, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, grp string, _pos long, _n long, key long"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# --- Merkle ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def leaves():
    rows = [(i, f"Text {i} é", "en", f"s{i % 3}", i) for i in range(700)]
    rows += [(i, f"UPPER {i}", "fr", None, None) for i in range(700, 764)] + [(900, "lone Leaf", "", "s", 1)]
    rows += [(901, None, None, None, None), (902, "", None, "s", 0), (None, "No Id", "de", "s", 5), (903, "Twice", "de", "s", 5), (903, "Twice", "de", "s", 5), (903, "Other", "de", "s", 5), (904, "x" * 300_000 + "Y", "de", "s", 5)]
    return rows


def brute_tree(digests):
    """Levels of a tree."""
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def brute_path(levels, i, proof, node):
    for below in levels[:-1]:
        lo = i - i % 8
        run = below[lo : lo + 8]
        proof += run[: i - lo] + run[i - lo + 1 :]
        node = sha("".join([*run[: i - lo], node, *run[i - lo + 1 :]]))
        i //= 8
    return proof, node


def brute_manifest(rows):
    def leaf(r):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], r[1])))

    def lowered(s):
        return s if s is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in s)

    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), leaf((r[0], lowered(r[1]), *r[2:]))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: brute_tree([x[2] for x in sorted(groups[g])]) for g in order}
    top = brute_tree([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, (known, doc, digest, changed) in enumerate(sorted(groups[g])):
            hit = known and zlib.crc32(str(doc).encode()) % 3 == 0
            proof, node = brute_path(trees[g], i, [], changed if hit else digest)
            proof, node = brute_path(top, k, proof, node)
            out.append((doc if known else None, digest, trees[g][-1][0], top[-1][0], sha("".join(proof)), node, node == top[-1][0]))
    return out


def test_manifest_is_brute_force(spark, leaves):
    df = spark.createDataFrame([(*r, "clash", 1, 2, 3) for r in leaves], DOCS).repartition(5)
    made = merkle.Manifest(df)
    got = sorted(map(tuple, made.proofs().collect()), key=str)
    assert got == sorted(brute_manifest(leaves), key=str)
    assert len({r[5] for r in got}) > 200 and {r[6] for r in got} == {True, False}
    # a version holds its leaf and one node a level, and ends in the root folded for it
    copied = collections.defaultdict(dict)
    for r in made.copied_nodes().collect():
        copied[r.version][r.level] = r.digest
    folded = {r[0]: (r[1], r[5]) for r in got if not r[6] and r[0] != 903}
    for doc, (leaf, root) in folded.items():
        assert copied[doc][max(copied[doc])] == root and copied[doc][0] != leaf
        assert sorted(copied[doc]) == list(range(len(copied[doc])))


def test_manifest_of_nothing_and_of_one(spark):
    assert merkle.Manifest(spark.createDataFrame([], DOCS)).proofs().collect() == []
    (r,) = merkle.Manifest(spark.createDataFrame([(2, "a", None, None, None, "", 0, 0, 0)], DOCS)).proofs().collect()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof_sha256 == sha("") and r.verified


def test_version_shares_untouched_nodes():
    leaves = [sha(str(i)) for i in range(100)]
    block = merkle.Block(leaves, merkle.levels_of(100))
    copied = block.version(77, sha("new"))
    changed = brute_tree(leaves[:77] + [sha("new")] + leaves[78:])
    assert [(level, at) for level, at, _ in copied] == [(0, 77), (1, 9), (2, 1), (3, 0)]
    for level, at, digest in copied:
        assert changed[level][at] == digest
        assert [x for i, x in enumerate(changed[level]) if i != at] == [x for i, x in enumerate(block.levels[level]) if i != at]


# --- URLs --------------------------------------------------------------------------------------


def test_hosts_paths_and_rules(spark):
    cases = {
        None: ("", "", None), "no scheme/org/": ("", "", None), "http://": ("", "", None), "http://A.Example.ORG/ES/1": ("a.example.org", "/ES/1", "org/"),
        "https://example.org/es/1?x=/en/1#/fr/": ("example.org", "/es/1", "example.org/es/"), "http://m.example.org/en/12": ("m.example.org", "/en/12", "example.org/en/1"),
        "http://badexample.org/es/": ("badexample.org", "/es/", "org/"), "http://org": ("org", "", None), "http://x.org?a=/": ("x.org", "", None), "http://x.org#/": ("x.org", "", None),
        "x://y://org/": ("y:", "//org/", None), "http://a.com/de/5": ("a.com", "/de/5", "com/de/"), "http://a.com/fr/": ("a.com", "/fr/", "com/fr/"), "http://a.com/frx": ("a.com", "/frx", None),
        "http://a.org:80/": ("a.org:80", "/", None), "ftp://net/\n/a": ("net", "/\n/a", None), "http://É.COM/de/": ("É.com", "/de/", "com/de/"),
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    got = {r.url: (r.host, r.path, r.rule) for r in url_filter.described(df).collect()}
    assert got == cases


def test_entropy_and_counts(spark):
    urls = ["", "aaaa", "http://ab.c-d.org/x/y.html?a=1&&b=22#z", "é" * 9, "q" * 200_000]
    want = []
    for u in urls:
        n = collections.Counter(u.encode())
        p = np.array(list(n.values())) / max(sum(n.values()), 1)
        want.append(-(p * np.log2(p)).sum() if len(p) else 0)
    import pyarrow as pa

    assert np.allclose(url_filter.entropies(pa.array(urls)), want)
    (r,) = url_filter.described(spark.createDataFrame([(urls[2],)], "url string")).collect()
    assert r._counts == [len(urls[2]), 10, 9, 9, 3, 2, 2, 3 / len(urls[2]), 0, 0, 1, 0, 2, 1, 1, 0, 6]


def test_trees_learn_an_exclusive_or():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    trees = url_filter.Trees(0.0).fit(x[:3000], y[:3000], np.ones(3000))
    assert ((trees.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.95


def test_first_split_is_the_best_one():
    rng = np.random.default_rng(5)
    x, y, w = rng.integers(0, 6, (60, 2)).astype(float), rng.integers(0, 2, 60).astype(float), rng.integers(1, 4, 60).astype(float)
    trees = url_filter.Trees(0.0).fit(x, y, w)
    bins, (feature, cut, _) = trees._bins(x), trees.trees[0]
    grad, hess = w * (y - 0.5), w * 0.25

    def gain(f, c):
        side = bins[:, f] <= c
        part = lambda m: grad[m].sum() ** 2 / (hess[m].sum() + url_filter.RIDGE)
        return part(side) + part(~side) - part(np.ones(60, bool))

    assert gain(feature[0], cut[0]) == pytest.approx(max(gain(f, c) for f in range(2) for c in range(url_filter.BINS)))


def test_judges_unlisted_urls(spark):
    rng = np.random.default_rng(1)
    rows = [(f"http{'s' * int(rng.integers(2))}://{['m', 'www', 'blog'][rng.integers(3)]}.h{rng.integers(40)}.example.{t}/{p}/{rng.integers(1000)}",) for t in ("org", "com", "net") for p in ("fr", "de", "es") for _ in range(150)]
    rows += [(None,), ("",), ("no scheme",), ("http://hot.com/de/1",), *[("http://hot.com/de/1",)] * 2000, ("http://x.org/" + "a" * 100_000,)]
    df = spark.createDataFrame([(i, u, 1, "x") for i, (u,) in enumerate(rows)], "page_id long, url string, score long, draw string")
    labels = url_filter.rule_labels(df)
    model = url_filter.train(labels.where(F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(4)) != 0))
    out = url_filter.judge(df, model)
    got = out.collect()
    assert len(got) == len(rows) and out.columns == ["page_id", "url", "draw", "host", "path", "rule", "verdict", "score"]
    assert all(r.verdict == dict(url_filter.RULES)[r.rule] for r in got if r.rule)
    held = [r for r in got if r.rule and r.url and zlib.crc32(r.url.encode()) % 4 == 0]
    assert len(held) > 150 and np.mean([(r.score >= 0.5) == (r.verdict == "block") for r in held]) > 0.95
    unlisted = [r for r in got if r.host.endswith(".net") and r.path[:4] in ("/fr/", "/de/")]
    assert np.mean([(r.verdict == "block") == r.path.startswith("/de/") for r in unlisted]) > 0.9


def test_url_model_without_examples(spark):
    none = spark.createDataFrame([], "url string, label string")
    df = spark.createDataFrame([(1, "http://a.net/x"), (2, None)], "page_id long, url string")
    assert [r.verdict for r in url_filter.judge(df, url_filter.train(none)).collect()] == ["allow", "allow"]
    only = spark.createDataFrame([("http://a.net/x", "block"), ("http://b.net/x", "block")], "url string, label string")
    assert [r.verdict for r in url_filter.judge(df, url_filter.train(only)).collect()] == ["block", "block"]
    assert url_filter.judge(df.limit(0), url_filter.train(only)).collect() == []


# --- phrases -----------------------------------------------------------------------------------


def brute_phrases(rows, top=phrases.TOP):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for m in range(1, 5):
                f.update((lang, " ".join(w[i : i + m])) for i in range(len(w) - m + 1))
    cand = {(k, p): a for (k, p), a in f.items() if a >= 30 and " " in p}
    around = collections.Counter()
    for (k, p), a in cand.items():
        w = p.split(" ")
        for j in range(2, len(w)):
            for i in range(len(w) - j + 1):
                around[k, " ".join(w[i : i + j])] = max(around[k, " ".join(w[i : i + j])], a)
    out = collections.defaultdict(list)
    for (k, p), a in cand.items():
        if 100 * around[k, p] >= 80 * a:
            continue
        w = p.split(" ")
        cuts = [(f[k, " ".join(w[:i])], f[k, " ".join(w[i:])]) for i in range(1, len(w))]
        score, _, l, r = min((2_000_000 * a // (x + y), i, x, y) for i, (x, y) in enumerate(cuts))
        out[k].append((-score, -a, p.encode(), l, r))
    return sorted((k, i + 1, p.decode(), -a, l, r, n[k], -s) for k, v in out.items() for i, (s, a, p, l, r) in enumerate(sorted(v)[:top]))


@pytest.fixture(scope="module")
def prose():
    rng = np.random.default_rng(17)
    words = [f"w{i}" for i in range(60)] + ["New", "YORK", "é", "日本"]
    weight = 1 / np.arange(1, len(words) + 1)
    def text(n):
        w = list(rng.choice(words, n, p=weight / weight.sum()))
        for _ in range(n // 12):
            w[rng.integers(n)] = "new york city hall"
        return "".join(x + rng.choice([" ", "  ", "\t", ". ", ",", "\n"], p=[0.8, 0.05, 0.05, 0.04, 0.03, 0.03]) for x in w)
    rows = [(text(int(rng.integers(1, 300))), [None, "en", "fr"][i % 3]) for i in range(180)]
    rows += [(None, "en"), ("", None), (" \t.,", "en"), ("same same " * 400, "en"), ("only here in one text " * 60, "fr"), ("a b c d e f g h " * 30_000, "de"), ("und too " * 40, "und")]
    return rows


def test_collocations_are_brute_force(spark, prose):
    df = spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(prose)] + [(1, *prose[1], "y", 2), (None, *prose[2], None, None)], "doc_id long, text string, lang string, phrase string, n long").repartition(6)
    want = brute_phrases([*prose, prose[1], prose[2]])
    assert sorted(map(tuple, phrases.collocations(df).collect())) == want
    assert sorted(map(tuple, phrases.collocations(df, 3).collect())) == brute_phrases([*prose, prose[1], prose[2]], 3)
    assert any("new york city hall" == r[2] for r in want) and {r[0] for r in want} == {"und", "en", "fr", "de"}


def test_no_phrases(spark):
    schema = "doc_id long, text string, lang string"
    assert phrases.collocations(spark.createDataFrame([], schema)).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1, "a b c", "en"), (2, None, None)], schema)).collect() == []


def test_crowded_lookup_stays_exact(spark, prose, monkeypatch):
    """A lookup that holds most keys by chance only counts too much."""
    real = phrases.lookup

    def small(keys, like=None):
        size = 1 << 8
        bits = np.zeros(size // 8, np.uint8)
        for r in keys.distinct().collect():
            at = (r.key & (1 << 64) - 1) >> 2 & size - 1
            bits[at >> 3] |= 1 << (at & 7)
        return phrases.Lookup(bits)

    df = spark.createDataFrame([(i, *r) for i, r in enumerate(prose)], "doc_id long, text string, lang string")
    keys = phrases.counted(df, 30, range(1, 2))
    a, b = real(keys), small(keys)
    probe = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    held = np.array([r.key for r in keys.collect()]).view(np.uint64)
    assert a.holds(held).all() and b.holds(held).all() and 0 < b.holds(probe).mean() < 1
    monkeypatch.setattr(phrases, "lookup", small)
    assert sorted(map(tuple, phrases.collocations(df).collect())) == brute_phrases(prose)


def test_slices_lose_no_phrase(monkeypatch, prose):
    """Texts far longer than a slice, with and without breaks, give the counts of the whole text."""
    import pyarrow as pa

    text = " ".join(t or "" for t, _ in prose[:60]) + " " + "no break here at all " * 400 + "x" * 900 + " tail of words " * 50
    batch = pa.RecordBatch.from_pydict({"lang": pa.array(["en", None], pa.string()), "text": pa.array([text, "short one"], pa.string())})

    class All:
        def holds(self, keys):
            return np.ones(len(keys), bool)

    def counted():
        out, slices = collections.Counter(), 0
        for words, _ in phrases.word_slices(iter([batch])):
            slices += 1
            for size, at, whole in phrases.reached(words, range(1, 5), All()):
                for k, n in zip(*np.unique(phrases.key_of(whole, size), return_counts=True)):
                    out[int(k)] += int(n)
        return out, slices

    whole, one = counted()
    monkeypatch.setattr(phrases, "SLICE_BYTES", 200)
    cut, many = counted()
    assert one == 1 and many > 50 and cut == whole


# --- pipeline ----------------------------------------------------------------------------------


def test_pipeline_language_stage(spark):
    """Documents without a letter go; all others stay whole, with columns that clash with the label's."""
    import corpus_pipeline

    text = {"en": "the cat sat on the mat and then went home", "de": "der hund lief durch den wald und kam nach hause"}
    rows = [(i, text[lang], lang, "s", i, f"own {i}", 0.5, True) for i in range(30) for lang in ("en", "de")]
    rows += [(100, None, "en", "s", 0, "x", None, None), (101, "123 ?!", None, None, None, None, None, None), (102, "", "en", "s", 0, "x", 0.1, False), (None, text["en"], None, None, None, "n", None, None)]
    rows += [rows[0]] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double, held_out boolean")
    out = corpus_pipeline.language_id(spark, df, "")
    assert out.columns == df.columns
    want = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert corpus_pipeline.language_id(spark, df.limit(0), "").collect() == []
