"""The training-data operators against brute force, with nulls, empties, ties, repeats and clashing columns."""

import collections
import hashlib
import random
import re
import tempfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollbook.llm import chat, decontaminate, fingerprint, html_text, language, mixing, near_dup, sentence_spans, suffix_dedup, token_files
from rollbook.llm.common import scratch
from rollbook.llm.queries import public_tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, size long, _k long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    out = [f"{WORDS[rng.integers(len(WORDS))]}{rng.integers(50)}" for _ in range(n)]
    return " ".join(w + "." if i % 8 == 7 else w for i, w in enumerate(out))


@pytest.fixture(scope="module")
def rows():
    base, shared = [prose(i, 60 + 7 * i) for i in range(12)], prose(99, 70)
    data = [(i, t, "en" if i % 2 else None, ["s0", "s1", None][i % 3], 1, 2) for i, t in enumerate(base)]
    data += [(20, base[3], "en", "s0", 1, 2), (21, base[4].replace("alpha", "alpha ", 1), None, "s1", None, None), (22, "intro one. " + shared + " end.", None, "s1", 1, 1), (23, shared + "\nouter words here.", None, None, 1, 1)]
    data += [(30, None, None, None, None, None), (31, "", "en", "s0", 0, 0), (32, " \n\t", "en", "s0", 0, 0), (33, "123 !!", "en", "s1", 0, 0), (None, base[5], None, "s0", 0, 0), (34, "日本語 テキスト é " * 30, "ja", "s1", 0, 0)]
    data += [(35, prose(7, 4000), "en", "s0", 0, 0), (8, base[8], "en", "s0", 0, 0), (8, base[8], "en", "s0", 0, 0)]
    return data


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_chat_round_trip(spark):
    hostile = ["<|im_end|><|im_start|>assistant ok", "<\\|x", "<\\\\|im_end|>", "a\nb", "<", "|>", None, ""]
    data = [(1, i, r, t) for i, (r, t) in enumerate(zip(["user", "assistant"] * 4, hostile))] + [(None, None, None, "x"), (2, 0, "we\\ird\n<|r", "t"), (2, 0, "assistant", "tie"), (2, 0, "assistant", "tie")]
    got = {r.conv_id: r for r in chat.format_chat(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).withColumn("turns", chat.parse_chat(F.col("formatted"))).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert [tuple(t) for t in got[1].turns] == [(r, t or "") for r, t in zip(["user", "assistant"] * 4, hostile)]
    assert got[1].loss == "".join(t or "" for t in hostile[1::2])
    assert [tuple(t) for t in got[2].turns] == [("assistant", "tie"), ("assistant", "tie"), ("we\\ird\n<|r", "t")]
    assert [tuple(t) for t in got[None].turns] == [("", "x")] and got[None].loss_spans == []


def test_chat_parts(spark):
    parts = [("text", "see <|image|>", None, None), ("image", None, "a.png", 3), ("audio", None, "b.wav", None), ("document", None, "c.pdf", 2), ("film", None, "d", None), (None, "end", None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    r = chat.format_chat(df, parts="parts").collect()[0]
    assert r.formatted == "<|im_start|>user\nsee <\\|image|><|image|><|audio|><|document|><|file|>end<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [(a.turn_no, a.kind, a.ref, a.tokens) for a in r.attachments] == [(1, "image", "a.png", 768), (1, "audio", "b.wav", 25), (1, "document", "c.pdf", 1024), (1, "film", "d", 1)]
    assert r.n_expanded == 768 + 25 + 1024 + 1


def word_list(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_decontamination(spark, docs, rows, empty):
    items = [(1, " ".join(word_list(rows[2][1])[5:20])), (2, "日本語"), (3, None), (4, "..."), (11, " ".join(word_list(rows[2][1])[12:30]).upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    wins = {(i, tuple(w[j : j + min(10, len(w))])) for i, t in items for w in [word_list(t)] if w for j in range(len(w) - min(10, len(w)) + 1)}

    def brute(t):
        w, hit, ids = word_list(t), set(), set()
        for i, win in wins:
            for j in range(len(w) - len(win) + 1):
                if tuple(w[j : j + len(win)]) == win:
                    hit.update(range(j, j + len(win)))
                    ids.add(str(i))
        return len(w), len(hit), len(ids), tuple(sorted(ids)), bool(hit)

    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r["items"]), r.contaminated) for r in decontaminate.report(docs, bench).collect()), key=str)
    assert got == sorted(((r[0], *brute(r[1])) for r in rows), key=str)
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns and left.count() == sum(not brute(r[1])[4] for r in rows)
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, cut=True).collect()}
    assert not set(word_list(cut[2])) & set(items[0][1].split()[1:-1]) - set(word_list(rows[2][1])[30:]) and cut[1] == rows[1][1]
    assert decontaminate.report(empty, bench).count() == 0 and decontaminate.report(docs, bench.limit(0)).where("contaminated").count() == 0


def test_fit_budget():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = np.unique(rng.integers(1, 40, 6))
        counts = rng.integers(1, 6, len(lengths))
        budget = int(rng.integers(0, (lengths * counts).sum() + 5))
        take = mixing.fit_budget(lengths, counts, budget, dp_words=10_000)
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + int(n) * k for s in sums for k in range(c + 1)}
        assert (take >= 0).all() and (take <= counts).all()
        assert int((lengths * take).sum()) <= budget and budget - int((lengths * take).sum()) <= min(budget - s for s in sums if s <= budget) + lengths.max()


def test_mixing(spark, docs, rows, empty):
    sized = docs.select("doc_id", "source", mixing.token_length(F.col("text")).alias("size"), F.lit("x").alias("copies"))
    got = mixing.mix(sized).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix(sized.repartition(3)).collect()))
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").encode().split())
    weight = dict(zip(["s0", "s1", None], (3, 1, 2)))
    target, free, rest = {}, set(sizes), 1.5 * sum(sizes.values())
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in over} if over else share
        rest, free = rest - sum(2 * sizes[s] for s in over), free - over if over else set()
    taken = collections.Counter()
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == sizes[r.source] and r.copies in (0, 1, 2)
        taken[r.source] += r.size * r.copies
    for s in sizes:  # as near below the target as whole documents allow, but for the even share of each length
        passes = min(2, int(target[s] // sizes[s]))
        sums = {0}
        for r in got:
            if r.source == s:
                sums |= {x + r.size for x in sums}
        best = passes * sizes[s] + max(x for x in sums if x <= round(target[s] - passes * sizes[s]))
        assert best - 140 <= taken[s] <= best
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got) and mixing.mixed_rows(empty).count() == 0


def test_code_is_canonical_and_short():
    rng = np.random.default_rng(2)
    for n, v in ((0, 3), (1, 3), (255, 9), (256, 3000), (40_000, 50_000), (3000, 1)):
        ids = (rng.zipf(1.3, n) % v).astype(np.int64)
        lengths = token_files.code_lengths(np.bincount(ids, minlength=1) if n else np.zeros(1, np.int64))
        assert lengths.max() <= token_files.MAX_BITS and (0.5 ** lengths[lengths > 0]).sum() <= 1
        bits, marks = token_files.pack(ids, lengths, token_files.canonical(lengths))
        assert (token_files.unpack(bits, marks, n, token_files.decoding_table(lengths)) == ids).all()
        if n > 300:  # decoding may start at any checkpoint
            at = 256
            tail = token_files.unpack(bits, marks[1:], n - at, token_files.decoding_table(lengths))
            assert (tail == ids[at:]).all()


def test_token_files(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    hard = ["  a  b\t\tc \n\n d", "x <|endoftext|> y<|endoftext|>", "a\x1cb \x1c c", "x 　y z²½ Ⅷ", "it's  we'll 'tis ", " ", "\n", "é ́ 🎉 🎉🎉"]
    both = docs.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(hard)], "doc_id long, text string"))
    path = scratch(spark, "t")
    token_files.write_tokens(both, path, public_tokenizer())
    got = sorted(token_files.digest(token_files.read_tokens(spark, path)).collect(), key=lambda r: r.start)
    tok, at = Tokenizer.from_file(public_tokenizer()), 0
    for (k, t), r in zip(sorted([*[(r[0], r[1]) for r in rows], *[(100 + i, t) for i, t in enumerate(hard)]], key=lambda x: (x[0] is not None, x[0] or 0)), got, strict=True):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (k, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    token_files.write_tokens(empty, path + "0", public_tokenizer())
    assert token_files.digest(token_files.read_tokens(spark, path + "0")).count() == 0
    assert sorted(token_files.digest(token_files.read_sums(spark, path)).collect(), key=lambda r: r.start) == got
    assert token_files.digest(token_files.read_sums(spark, path + "0")).count() == 0


def test_gradients_match_differences():
    net = language.BiGru(["a", "b"])
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, _, _ = language.word_bytes(["abc", "hé", "longer"])
    y = np.array([0, 1, 0])
    _, g = net.gradients(x, y)
    for k, w in net.w.items():
        i = np.unravel_index(np.abs(g[k]).argmax(), w.shape)
        old = w[i]
        w[i] = old + 1e-4
        up = net.gradients(x, y)[0]
        w[i] = old - 1e-4
        assert abs((up - net.gradients(x, y)[0]) / 2e-4 - g[k][i]) < 1e-5
        w[i] = old


def test_language_accuracy(spark, docs, empty):
    data = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    net = language.train(data)
    held = language.identify(data, net).where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.9 * len(held)
    out = {r.doc_id: r for r in language.identify(docs, net).collect()}
    assert all(out[k].lang_pred == "und" and out[k].score == 0 for k in (30, 31, 32, 33)) and out[34].lang_pred != "und" and 0 < out[35].score <= 1
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in held) and out[None].held_out
    assert {r.lang_pred for r in language.identify(docs, language.train(empty)).collect()} == {"und"} and language.identify(empty, net).count() == 0


PAGE = """<!doctype html><html><head><title>T</title><style>p{x}</style></head><body class="home"><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div id="cookie-notice">We use cookies</div><article class="post"><header><h1>Big &amp; bold</h1></header><p>First   para
graph with <a href="x">a link</a> inside.<p>Second &eacute; one<br>after break.</p><script>var a="</p>";</script><aside class="ad">Buy now</aside><div class="newsletter"><form><input>Mail us</form></div>
<p>Third.</p></article><section id="comments"><p>I am a reader and I say a great many words here in this comment of mine</p></section><div class="sidebar"><p>Other things</p></div><footer>&copy; us</footer></body>"""


def test_encoder_against_the_tokenizer(monkeypatch):
    """Pieces encoded many at a time, kept ones and those with signs, added tokens or rare blanks."""
    from tokenizers import Tokenizer

    path = public_tokenizer()
    tok = Tokenizer.from_file(path)
    added = [t.content for t in tok.get_added_tokens_decoder().values()]
    rnd = random.Random(5)
    parts = [*PIECES, *added, *(f" {a} " for a in added), *(f"x{a}y" for a in added)]
    texts = ["", " ", "\n", *parts, *("".join(rnd.choice(parts) + rnd.choice(["", " ", " ", " ", "\n", "  "]) for _ in range(rnd.randint(1, 60))) for _ in range(300))]
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    for joined, room in ((1000, 300_000), (3, 20)):
        monkeypatch.setattr(token_files, "JOINED", joined)
        monkeypatch.setattr(token_files, "CACHE", room)
        enc = token_files.Encoder(path)
        for step in (7, 50, 400):
            for lo in range(0, len(texts), step):
                ids, n = enc.batch(texts[lo : lo + step])
                ends = np.cumsum(n)
                assert [ids[e - k : e].tolist() for e, k in zip(ends, n)] == want[lo : lo + step]
        assert len(enc.known) <= room


def test_encoder_cuts_signs_off_words(monkeypatch):
    """A word is encoded once, whatever signs follow it; cuts agree with the tokenizer's own anywhere in a text."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = public_tokenizer()
    enc, sent = token_files.Encoder(path), []

    class Counted:
        def encode_batch_fast(self, texts, **how):
            sent.extend(texts)
            return tok.encode_batch_fast(texts, **how)

    tok, enc.tok = enc.tok, Counted()
    words = [f"blereth{a}{b}en" for a in "abcdefgh" for b in "abcdefgh"]
    enc.batch([" " + " ".join(w + sign for w in words for sign in ("", ",", ".", "!", ";", "***", "$$$"))])
    assert sum(map(len, sent)) < 2 * sum(map(len, words))

    rnd = random.Random(7)
    signs = [*"aZ9 \n\n   .,$'\u00e9\u00d7\u00f7\u00c0\u00df\t\r\x0b\x1c\x85\u00a0\u1680\u2003\u2009\u2029\u205f\u3000\u0301\u0100\u65e5\u2026", "'s", "'ll", *tok_added(path)]
    texts = ["", None, *("".join(rnd.choice(signs) for _ in range(rnd.randint(1, 30))) for _ in range(3000))]
    want = [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for at_once, step in ((5, 3002), (1 << 16, 50)):
        monkeypatch.setattr(token_files, "AT_ONCE", at_once)
        enc = token_files.Encoder(path)
        for lo in range(0, len(texts), step):
            ids, n = enc.batch(texts[lo : lo + step])
            ends = np.cumsum(n)
            assert [ids[e - k : e].tolist() for e, k in zip(ends, n)] == want[lo : lo + step]

    other = Tokenizer(models.BPE({c: i for i, c in enumerate(sorted(pre_tokenizers.ByteLevel.alphabet()))} | {"a.": 256}, [("a", ".")]))
    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)  # no splits at all
    with tempfile.NamedTemporaryFile(suffix=".json") as f:
        other.save(f.name)
        ids, n = token_files.Encoder(f.name).batch(["a. a.b", "a.", "b a."])
    assert ids.tolist() == [i for t in ("a. a.b", "a.", "b a.") for i in other.encode(t).ids] and n.sum() == len(ids)


def tok_added(path):
    from tokenizers import Tokenizer

    return [t.content for t in Tokenizer.from_file(path).get_added_tokens_decoder().values()]


def test_blocks_unpack_side_by_side():
    rng = np.random.default_rng(3)
    blocks = [(rng.zipf(1.3, n) % 3000).astype(np.int64) for n in (1, 255, 256, 257, 5000, 0, 70_000)]
    lengths = token_files.code_lengths(np.bincount(np.concatenate(blocks)))
    codes = token_files.canonical(lengths)
    packed = [(*token_files.pack(ids, lengths, codes), len(ids)) for ids in blocks]
    for some in (packed, packed[::-1], packed[5:6]):
        for (_, _, n), ids in zip(some, token_files.unpack_all(some, token_files.decoding_table(lengths)), strict=True):
            assert len(ids) == n
    for want, ids in zip(blocks, token_files.unpack_all(packed, token_files.decoding_table(lengths)), strict=True):
        assert (ids == want).all()


def test_ranges_carry_their_counts(spark, docs, empty):
    """Ids are counted where they are made: the counts equal those of the ids, and blocks hold whole documents."""
    made = token_files.tokenized(docs, public_tokenizer()).collect()
    ids = np.concatenate([np.frombuffer(r.ids, "<u2") for r in made if r.block is not None])
    assert sum(sum(r.n_tokens) for r in made if r.block is not None) == len(ids) and sum(len(r.doc_ids) for r in made if r.block is not None) == docs.count()
    counted = {r.id: r.n for r in token_files.id_counts(token_files.tokenized(docs, public_tokenizer())).collect()}
    assert counted == {int(i): int(n) for i, n in zip(*np.unique(ids, return_counts=True))}
    assert token_files.id_counts(token_files.tokenized(empty, public_tokenizer())).count() == 0


PIECES = "a word Word's don't it's, 12 3.5 x1 é e\u0301 \u0301 naïve $$$ %%% a$$$ 's 'll ’s 日本語 。 \u00a0 a\u00a0b \u2003 \u200b \t \r\n \u0120 \u0120a <| |> < 🙂 🙂a \ufeff _ a_b -- ... \x0b \x85".split(" ")
ARTICLE = "<p>" + "Article words go on and on here. " * 8 + "</p>"
PLAIN = " ".join(("Article words go on and on here. " * 8).split())


@pytest.mark.parametrize(
    "page, want",
    [
        (f'<ul><li class="share">a<li>b</ul><article>{ARTICLE}</article>', PLAIN),
        (f'<table><tr><td class="side"><a>x</a><td>{ARTICLE}</table>', PLAIN),
        (f'<form id="aspnetForm"><div><a>Home</a> <a>News</a></div>{ARTICLE}</form>', PLAIN),
        (f'<div class="content side">{ARTICLE}</div>', PLAIN),
        (f'<body class="menu-open"><div class="with-sidebar"><article>{ARTICLE}</article></div>', PLAIN),
        (f'<article><div class="tags legal">{ARTICLE}</div></article>', PLAIN),
        (f"<nav><ul><li><a>a</a></ul><article>{ARTICLE}</article>", PLAIN),
        (f"<svg><path>{ARTICLE}", PLAIN),
        (f'<article>{ARTICLE}<p><a href="x">a paragraph that is one link</a></p>{ARTICLE}</article>', f"{PLAIN} a paragraph that is one link {PLAIN}"),
        (f'<div class="x1"><a>Home</a> <a>News</a></div><article>{ARTICLE}</article><div class="x3"><p>Reader one says a lot</p><p>Reader two</p></div>', PLAIN),
        (f'<nav><a>a</a></nav><div class="ad">Buy it</div><h1>Head</h1>{ARTICLE}<ul><li>one short item<li>second item</ul><footer>c</footer>', f"Head {PLAIN} one short item second item"),
        (f'<article>{ARTICLE}<div class="ad"><p>Buy now or never</p></div><form><p>Mail <input></p></form></article>', PLAIN),
        (f"<article>{ARTICLE}{ARTICLE}<article><p>a reader answers</p></article></article>", f"{PLAIN} {PLAIN}"),
        ('<p title="the hidden side">shown text</p>', "shown text"),
        ("<p>a&nbsp;&amp;lt; <b>b</b>&eacute;</p>", "a &lt; b\u00e9"),
        (f"<article>{ARTICLE}" + '<div class="ad"><div><p>Buy now or never</p></div></div>' * 9 + "<p>End.</p></article>", f"{PLAIN} End."),
        ("<i>" * 20000 + "</b>" * 20000 + "<div>" * 20000 + "x y", "x y"),
    ],
)
def test_html_regions(page, want):
    counts = collections.Counter()
    for _ in range(50):
        counts.update(html_text.label_counts(PAGE))
    for weights in ({}, html_text.weights_of(counts)):
        assert html_text.main_text(page, weights) == want


def test_html_weights_and_run():
    labelled = f'<div class="qq"><p>{"teaser words " * 20}</p></div><article>{ARTICLE}</article>'
    counts = collections.Counter()
    for _ in range(20):
        counts.update(html_text.label_counts(labelled))
    unmarked = f'<div class="qq"><p>{"teaser words " * 20}</p></div>{ARTICLE}'
    assert html_text.main_text(unmarked, html_text.weights_of(counts)) == PLAIN  # a class word learned from marked pages
    assert html_text.main_text(unmarked, {}).startswith("teaser")
    rnd = random.Random(3)
    for _ in range(200):
        scores = [rnd.choice([-3, -2, -1, 0, 1, 2, 3]) for _ in range(rnd.randint(0, 12))]
        lo, hi = html_text.best_run(scores)
        assert sum(scores[lo:hi]) == max((sum(scores[a:b]) for a in range(len(scores)) for b in range(a, len(scores) + 1)), default=0)
    read = html_text.Page(PAGE)
    whole = " ".join(" ".join("".join(b.parts).split()) for b in read.items if b.words)
    assert whole != html_text.main_text(PAGE, {}) and len(html_text.scored(read, {})) == len(read.items)


def test_html(spark):
    want = "Big & bold First para graph with a link inside. Second é one after break. Third."
    counts = collections.Counter()
    for _ in range(5):
        counts.update(html_text.label_counts(PAGE))
    for weights in ({}, html_text.weights_of(counts)):
        assert html_text.main_text(PAGE, weights) == want
        assert html_text.main_text(PAGE.replace("<article", "<div").replace("</article", "</div"), weights).startswith("First para") or weights
    data = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p"), (5, "u", "<div class='"), (6, "u", "plain < text"), (1, "u", PAGE), (7, "u", "<article>" + "<p>word here</p>" * 20000 + "</article>")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("text", F.lit("old"))
    got = sorted(html_text.extract(pages, html_text.learn(pages)).collect(), key=lambda r: r.page_id)
    assert [r.text for r in got[:6]] == [want, want, "", "", "", ""] and got[6].text == "plain < text" and got[7].n_chars == 20000 * 10 - 1
    assert html_text.extract(pages.limit(0), {}).count() == 0 and html_text.learn(pages.where("page_id = 2")) == {}
    assert html_text.best_run([-1, 2, -1, 3, -9, 3.5]) == (1, 4) and html_text.best_run([-1.0]) == (0, 0)


def test_sentence_spans(docs, rows, empty):
    seen, gone = {}, collections.defaultdict(set)
    order = sorted(((r[0] if r[0] is not None else -1, r[1] or "") for r in set(rows)), key=lambda x: x[0])
    for k, t in order:
        for h, p in sentence_spans.runs(t)[0]:
            seen.setdefault((h, p & 0xFFFF), (k, p >> 24))
    for k, t in order:
        for h, p in sentence_spans.runs(t)[0]:
            if seen[h, p & 0xFFFF] != (k, p >> 24):
                gone[k].update(range(p >> 24, (p >> 24) + (p >> 16 & 255)))
    out = sentence_spans.dedup(docs)
    assert out.columns == [*docs.columns, "n_sentences", "n_removed", "removed_words"]
    got = out.collect()
    for r in got:
        t = next(x[1] for x in rows if x[0] == r.doc_id)
        k = -1 if r.doc_id is None else r.doc_id
        assert r.text == (None if t is None else sentence_spans.without(t, gone[k])[0]), r.doc_id
    by = {r.doc_id: r for r in got}
    assert by[20].text == "" and by[3].n_removed == 0 and by[8].n_removed == 0 and "outer words here" in by[23].text and by[23].removed_words >= 60
    assert len(got) == len(rows) and sentence_spans.dedup(empty).count() == 0


def test_runs_of_copies_are_joined_before_the_shuffle(spark):
    text = " ".join(f"word{i} goes here. Then more{i} follows it; and on." for i in range(40))
    held = sorted([(i, text) for i in range(300)] + [(None, text), (1000, "Lone words. " + text), (1001, None), (1002, "!")], key=lambda r: (r[0] is not None, r[0]))
    docs = spark.createDataFrame(held, "doc_id long, text string").coalesce(1)
    found, n = sentence_spans.runs(text)
    # each run once, and what a copy has of them as one span
    assert len(found) > 60 and sentence_spans.all_runs(docs).count() <= len(found) + 303
    got = {r.doc_id: r for r in sentence_spans.dedup(docs.repartition(3)).collect()}
    assert got[None].text == text and all(got[i].text == "" and got[i].n_removed == n for i in range(300))
    assert got[1000].text == "Lone words. " and got[1001].text is None and got[1002].text == "!"
    # a span of more sentences than its field holds is cut
    k, pos = np.repeat([1, 2], 600_000), np.tile(np.arange(600_000), 2)
    rows = sentence_spans._joined(k, pos.astype(np.uint64), pos * 0, pos, pos * 0 + 3)
    q = rows.column(2).to_numpy()
    marks = sentence_spans._marks(q[(q & sentence_spans.DONE) != 0] & ((1 << sentence_spans.KIND) - 1))
    assert rows.num_rows == 600_002 and marks.sum() == 600_002 and marks[:600_002].all()


def covered_words(texts):
    """Per text, the numbers of the words that repeated runs cover."""
    first, gone = {}, [set() for _ in texts]
    for k, t in enumerate(texts):
        at = np.cumsum([0, *(len(w) for _, _, w in sentence_spans.sentences(t))])
        for h, p in sentence_spans.runs(t)[0]:
            i, n = p >> 24, p >> 16 & 255
            if first.setdefault((h, p & 0xFFFF), (k, i)) != (k, i):
                gone[k].update(range(at[i], at[i + n]))
    return gone


def test_shared_passages_are_found_wherever_they_lie():
    rng = np.random.default_rng(12)
    words = lambda name, n: [f"{name}x{i}" for i in range(n)]
    for case in range(200):  # a plain search for 51 equal words finds each of these
        shared = [WORDS[rng.integers(len(WORDS))] for _ in range(51)] if case % 2 else words(f"s{case}", 51)
        texts = [" ".join([*words(f"{c}{case}", int(rng.integers(0, 40))), *shared, *words(f"{c}{case}end", int(rng.integers(0, 40)))]) for c in "pq"]
        lead = len(texts[1].split()) if not case % 2 else 0
        gone = covered_words(texts)
        assert not gone[0] or case % 2
        assert len(gone[1]) >= 15, case
        if lead:
            at = texts[1].split().index(shared[0])
            assert gone[1] <= set(range(at, at + 51)), case
    assert max(len(w) for _, _, w in sentence_spans.sentences("spam " * 500 + "a b " * 300)) <= 8
    assert covered_words(["x " + "a b c " * 40, "y z " + "a b c " * 40])[1]


def test_sentence_ends():
    parts = lambda t: [t[lo:hi] for lo, hi, _ in sentence_spans.sentences(t)]
    assert parts('He said "stop." Then (yes!) he\xa0left.[1] Now?') == ['He said "stop." ', "Then (yes!) ", "he\xa0left.[1] Now?"]
    assert parts("これは文です。次の文。」終わり！end") == ["これは文です。", "次の文。」", "終わり！", "end"]
    assert parts("OK.次 3.14 a.b") == ["OK.", "次 3.14 a.b"]
    assert "".join(parts("." * 50_000 + "x\n\n y... z")) == "." * 50_000 + "x\n\n y... z"


def word_shingles(t):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_duplicates(spark, docs, rows, empty):
    rng = np.random.default_rng(3)
    base = prose(500, 300).split()
    near = [(1000 + i, " ".join(w if j not in (pick := {int(rng.integers(300))}) and j != i * 7 % 300 else f"changed{i}" for j, w in enumerate(base)), None, "s0", 0, 0) for i in range(60)]
    data = [*rows, *near, (2000, "too few", None, None, 0, 0), (2001, "Too  few!", None, None, 0, 0)]
    got = {r.doc_id: r.class_id for r in near_dup.classes(spark.createDataFrame(data, SCHEMA)).collect()}
    sets = {r[0]: word_shingles(r[1]) for r in data if r[0] is not None}
    text = {r[0]: r[1] or "" for r in data if r[0] is not None}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] | sets[b])
            if a < b and (text[a] == text[b] or both and len(sets[a] & sets[b]) / both >= 0.8):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {k: find(k) for k in sets} == {k: v for k, v in got.items() if k is not None} and got[None] == 5
    one = near_dup.representatives(spark.createDataFrame(data, SCHEMA))
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted({find(k) for k in sets})
    assert near_dup.classes(empty).count() == 0 and near_dup.representatives(empty).count() == 0


def test_representatives_keep_every_text_of_an_id(spark):
    a, b, c, d = (prose(600 + i, 80) for i in range(4))
    data = [(1, a), (1, b), (1, a), (2, a), (3, c), (4, c), (4, d), (None, b), (None, "only here")]
    docs = spark.createDataFrame([(k, t, None, "s", 0, i) for i, (k, t) in enumerate(data)], SCHEMA)
    got = sorted(((r.doc_id, r.text) for r in near_dup.representatives(docs).collect()), key=str)
    assert got == sorted([(1, a), (1, b), (3, c), (4, d), (None, "only here")], key=str)  # each text by its own class


def test_copies_that_are_alike_only_by_their_base(spark):
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(300)]
    data = [(5000, " ".join(base))]
    for i in range(2000):
        edited = {int(x) * 5 + 2 for x in rng.choice(60, 5, replace=False)}  # copy and base 271 / 321, two copies mostly 246 / 346
        data.append((i, " ".join(f"c{i}x{j}" if j in edited else w for j, w in enumerate(base))))
    sets = [word_shingles(t) for _, t in data[:40]]
    assert all(len(word_shingles(data[0][1]) & s) / len(word_shingles(data[0][1]) | s) >= 0.8 for s in sets)
    assert np.median([len(a & b) / len(a | b) for a in sets[1:] for b in sets[1:] if a is not b]) < 0.78
    got = near_dup.classes(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert len(got) == 2001 and {r.class_id for r in got} == {0}


def test_repeated_lines_do_not_hide_near_copies(spark):
    data = []
    for i in range(20):
        text, line = [" ".join(f"{c}{i}x{j}" for j in range(n)) for c, n in (("a", 400), ("l", 10))]
        data += [(2 * i, f"{text} {line}"), (2 * i + 1, " ".join([text, *[line] * 100]))]
    got = {r.doc_id: r.class_id for r in near_dup.classes(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {k: k // 2 * 2 for k, _ in data}


def test_probminhash_estimates():
    a, b = [f"w{i}" for i in range(400)], [f"w{i}" for i in range(100, 500)]
    d, e, w = near_dup.shingles([" ".join(a), " ".join(b)])
    sig = near_dup.signatures(2, d, e, w, 2000)
    x, y = (set(e[d == i].tolist()) for i in (0, 1))
    assert abs((sig[0] == sig[1]).mean() - len(x & y) / len(x | y)) < 0.05
    # weights: two elements, probability Jaccard of (1, 3) and (3, 1)
    rng = np.random.default_rng(4)
    same = []
    for _ in range(300):
        h = rng.integers(0, 2**63, 2).astype(np.uint64)
        s = near_dup.signatures(2, np.array([0, 0, 1, 1]), np.tile(h, 2), np.array([1, 3, 3, 1]), 8)
        same.append((s[0] == s[1]).mean())
    want = sum(1 / sum(max(x / a, y / b) for x, y in ((1, 3), (3, 1))) for a, b in ((1, 3), (3, 1)))
    assert abs(np.mean(same) - want) < 0.05


def test_suffix_dedup(spark, docs, rows, empty, monkeypatch):
    data = [*rows, (40, "ab" * 400, None, None, 0, 0), (41, "x" + "ab" * 100 + "y", None, None, 0, 0), (42, "z" * 49, None, None, 0, 0), (43, "z" * 49, None, None, 0, 0), (44, "q" + rows[5][1][30:90], None, None, 0, 0)]
    first = {}
    for k, t in sorted(((r[0] if r[0] is not None else -1, (r[1] or "").encode()) for r in data), key=lambda x: x[0]):
        for i in range(len(t) - 49):
            first.setdefault(t[i : i + 50], k)

    def brute(k, t):
        b = (t or "").encode()
        m = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < (-1 if k is None else k):
                m[i : i + 50] = b"\1" * 50
        return k, len(b), sum(m), len(bytes(m).replace(b"\0", b" ").split()), hashlib.sha256(bytes(x for x, y in zip(b, m) if not y)).hexdigest()

    want = sorted((brute(r[0], r[1]) for r in data), key=str)
    for block, at_once, starts in ((2 << 20, 1 << 20, 4 << 20), (1 << 11, 1 << 9, 1 << 10)):
        monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
        out = suffix_dedup.dedup(spark.createDataFrame(data, SCHEMA))
        assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in out.collect()), key=str) == want
        monkeypatch.setattr(suffix_dedup, "AT_ONCE", at_once)
        pos, size, _ = suffix_dedup.stretches(np.frombuffer(b"ab" * 3000, np.uint8), np.array([2500, 2520, 6000]))
        assert sorted(suffix_dedup.ragged(pos, size)) == [*range(2451), *range(2520, 5951)]
    assert suffix_dedup.dedup(empty).count() == 0


def test_fingerprints(spark, docs, rows, empty):
    got = sorted(fingerprint.compare_with_edits(docs).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert len(got) == len(rows)
    kept = sorted({(r[0], r[1] or "") for r in rows}, key=lambda x: (x[0] is not None, x[0] or 0))
    edited = {}
    for (k, t), (_, after) in zip(kept, kept[1:] + kept[:1]):
        h = len(t) // 2
        edited[k] = (len(t), hashlib.sha256((t[: len(t) - h] + after[:h]).encode()).hexdigest())
    assert all((r.n_chars, r.edited_sha256) == edited[r.doc_id] for r in got)
    by = {r.doc_id: r for r in got}
    assert by[3].fingerprint == by[20].fingerprint != by[4].fingerprint and by[31].fingerprint == by[30].fingerprint == "" and by[30].near_next == 1.0 and by[None].fingerprint == by[5].fingerprint
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    long = [r for r in got if r.n_chars > 300]
    assert np.mean([r.near_edited for r in long]) > np.mean([r.near_next for r in long]) + 0.1
    assert fingerprint.compare_with_edits(empty).count() == 0


def test_samples_estimate_generalised_jaccard(spark):
    a, b = collections.Counter(), collections.Counter()
    for i in range(60):
        a[f"t{i}"], b[f"t{i}"] = 1 + i % 5, 1 + (i * 7) % 4
    texts = [(i, " ".join(w for w, n in c.items() for _ in range(n))) for i, c in enumerate((a, b))]
    s = {r.id: r.samples for r in fingerprint.sketches(spark.createDataFrame(texts, "id long, t string"), ["id"], "t", samples=256).collect()}
    want = sum((a & b).values()) / sum((a | b).values())
    assert abs(np.mean(np.array(s[0]) == np.array(s[1])) - want) < 0.1
