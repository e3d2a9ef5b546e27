"""Language ID by a bidirectional gated recurrent network over bytes, trained in numpy.

The network reads the bytes of a word from both ends and labels every position; a document's
probabilities are the mean over all its positions. Words are the sequences (the state starts anew
at each), so a word is read once per batch of documents however often it occurs, and a position
counts as often as it is there. Words longer than ``LONGEST`` bytes are read in pieces of that
length; no byte is left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from rollbook.functions.ranking import top_per_group

UNKNOWN = "und"
FOLDS = 5
#: Bound of the training sample: documents per language, and bytes of words they may give in all.
SAMPLE_DOCS = 300
SAMPLE_WORDS = 40_000
LONGEST = 24
HIDDEN, EMBED = 24, 16
EPOCHS, BATCH, RATE = 4, 256, 0.01
SEED = 11
#: Documents whose distinct words are read together.
TOGETHER = 2000

WORD = re.compile(r"[^\W\d_]+")


def letter_words(text: str | None) -> list[str]:
    """Lower-case runs that hold a letter; digits and signs tell nothing about the language."""
    found = WORD.findall(text.lower()) if text else []
    return [w for w in found if w.isalpha() or any(c.isalpha() for c in w)]


def fold(key: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def word_bytes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(matrix of byte + 1 with 0 behind the end, lengths, index of the word) of the words' pieces."""
    pieces, owner = [], []
    for i, w in enumerate(words):
        raw = w.encode("utf-8", "surrogatepass")
        for lo in range(0, len(raw), LONGEST):
            pieces.append(raw[lo : lo + LONGEST])
            owner.append(i)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    out = np.zeros((len(pieces), int(sizes.max()) if len(pieces) else 0), np.int64)
    flat = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64) + 1
    row = np.repeat(np.arange(len(pieces)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out, sizes, np.asarray(owner, np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class BiGru:
    """Weights of both directions and the label layer; float32."""

    def __init__(self, labels: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        h, e, n = HIDDEN, EMBED, len(labels)
        make = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.labels = labels
        self.w = {"emb": make(257, e)}
        for d in "fb":
            self.w |= {f"wx{d}": make(e, 3 * h), f"wh{d}": make(h, 3 * h), f"b{d}": np.zeros(3 * h, np.float32)}
        self.w |= {"wo": make(2 * h, n), "bo": np.zeros(n, np.float32)}

    def _run(self, x: np.ndarray, live: np.ndarray, d: str, keep: bool):
        """States of one direction for every position; behind a word's end the state stays."""
        h, t = HIDDEN, x.shape[1]
        given = (self.w["emb"] @ self.w[f"wx{d}"] + self.w[f"b{d}"])[x]  # one table look-up a byte
        wh = self.w[f"wh{d}"]
        state = np.zeros((len(x), h), np.float32)
        states, tape = np.zeros((len(x), t, h), np.float32), []
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            pull = state @ wh
            zr = _sigmoid(given[:, i, : 2 * h] + pull[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            c = np.tanh(given[:, i, 2 * h :] + r * pull[:, 2 * h :])
            new = np.where(live[:, i : i + 1], z * state + (1 - z) * c, state)
            if keep:
                tape.append((i, state, z, r, c, pull[:, 2 * h :]))
            state = new
            states[:, i] = new
        return states, tape

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(word, position, label) probabilities."""
        live = x > 0
        both = np.concatenate([self._run(x, live, d, False)[0] for d in "fb"], axis=2)
        logits = both @ self.w["wo"] + self.w["bo"]
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        return p / p.sum(axis=2, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over positions and its gradients, by backpropagation through time."""
        h, live = HIDDEN, x > 0
        runs = {d: self._run(x, live, d, True) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        logits = both @ self.w["wo"] + self.w["bo"]
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        n = live.sum()
        loss = float(-(np.log(p[np.arange(len(x)), :, y] + 1e-9) * live).sum() / n)
        dl = p.copy()
        dl[np.arange(len(x)), :, y] -= 1
        dl *= live[:, :, None] / n
        g = {"wo": np.tensordot(both, dl, ([0, 1], [0, 1])), "bo": dl.sum((0, 1)), "emb": np.zeros_like(self.w["emb"])}
        dboth = dl @ self.w["wo"].T
        for k, d in enumerate("fb"):
            dstates = dboth[:, :, k * h : (k + 1) * h]
            wx, wh = self.w[f"wx{d}"], self.w[f"wh{d}"]
            gwh, dgiven = np.zeros_like(wh), np.zeros((*x.shape, 3 * h), np.float32)
            carry = np.zeros((len(x), h), np.float32)
            for i, before, z, r, c, pull in reversed(runs[d][1]):
                total = dstates[:, i] + carry
                here = np.where(live[:, i : i + 1], total, 0)
                dz = here * (before - c) * z * (1 - z)
                dc = here * (1 - z) * (1 - c * c)
                dr = dc * pull * r * (1 - r)
                dgiven[:, i] = np.concatenate([dz, dr, dc], axis=1)
                dpull = np.concatenate([dz, dr, dc * r], axis=1)
                gwh += before.T @ dpull
                carry = np.where(live[:, i : i + 1], here * z, total) + dpull @ wh.T
            g[f"wh{d}"], g[f"b{d}"] = gwh, dgiven.sum((0, 1))
            used = self.w["emb"][x]
            g[f"wx{d}"] = np.tensordot(used, dgiven, ([0, 1], [0, 1]))
            np.add.at(g["emb"], x.ravel(), (dgiven @ wx.T).reshape(-1, EMBED))
        return loss, g

    def fit(self, words: list[str], label: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> list[float]:
        """Adam with a falling rate on shuffled batches; the loss of each epoch."""
        rng = np.random.default_rng(seed)
        x, sizes, owner = word_bytes(words)
        y = np.asarray(label)[owner]
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.w.items()}
        losses, step, steps = [], 0, max(1, epochs * -(-len(x) // batch))
        for _ in range(epochs):
            order, total = rng.permutation(len(x)), 0.0
            for lo in range(0, len(x), batch):
                some = order[lo : lo + batch]
                loss, g = self.gradients(x[some, : sizes[some].max()], y[some])
                step, total = step + 1, total + loss * len(some)
                now = rate * (1 - step / (steps + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, d in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v2[k] = 0.999 * v2[k] + 0.001 * d * d
                    self.w[k] -= (now * m[k] / (np.sqrt(v2[k]) + 1e-8)).astype(np.float32)
            losses.append(total / max(1, len(x)))
        return losses

    def word_sums(self, words: list[str], chunk: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """(summed probabilities over positions, positions) per word; words of like length are read together."""
        x, sizes, owner = word_bytes(words)
        sums, n = np.zeros((len(words), len(self.labels)), np.float64), np.zeros(len(words), np.int64)
        order = np.argsort(sizes, kind="stable")
        for lo in range(0, len(order), chunk):
            some = order[lo : lo + chunk]
            part = x[some, : sizes[some].max()]
            p = self.probabilities(part) * (part > 0)[:, :, None]
            np.add.at(sums, owner[some], p.sum(axis=1))
        np.add.at(n, owner, sizes)
        return sums, n

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(label, pooled probability) of every whole text; ``und`` and 0 without a letter."""
        index: dict[str, int] = {}
        words, docs = [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            found = letter_words(t)
            docs[i] = len(found)
            words.extend([index.setdefault(w, len(index)) for w in found])
        if not index or not self.labels:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        sums, n = self.word_sums(list(index))
        which, doc = np.asarray(words, np.int64), np.repeat(np.arange(len(texts)), docs)
        # a sum in place of a matrix over all words keeps memory at documents times labels
        total = np.stack([np.bincount(doc, sums[which, k], len(texts)) for k in range(len(self.labels))], axis=1)
        mean = total / np.maximum(np.bincount(doc, n[which], len(texts)), 1)[:, None]
        best = mean.argmax(axis=1)
        return [self.labels[b] if k else UNKNOWN for b, k in zip(best, docs)], np.where(docs > 0, np.minimum(mean.max(axis=1), 1.0), 0.0)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE_DOCS) -> BiGru:
    """A network learned from a bounded sample of the labelled rows outside the held-out fold.

    Per language the ``sample`` documents first in a seeded hash of the id (found in salted rounds,
    so a language with most rows is no hot group); of their words at most SAMPLE_WORDS, seeded.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where(F.col("l").isNotNull() & F.col("t").isNotNull() & (fold(F.col("k")) != 0))
    rank = F.xxhash64("k", F.lit(SEED))
    ids = top_per_group(rows.select("k", "l", rank.alias("h")), ["l"], [F.col("h"), F.col("k")], sample, ["k"]).select("k", "l").distinct()
    # at most ``sample`` ids a language
    got = rows.join(F.broadcast(ids), ["k", "l"]).toPandas().sort_values(["l", "k", "t"])
    labels = sorted(got["l"].unique())
    rng = np.random.default_rng(SEED)
    words, label = [], []
    share = SAMPLE_WORDS // max(1, len(labels))
    for i, name in enumerate(labels):
        own = [w for t in got["t"][got["l"] == name] for w in letter_words(t)]
        own = [own[j] for j in rng.permutation(len(own))[:share]]
        words += own
        label += [i] * len(own)
    net = BiGru(labels)
    if words:
        net.fit(words, np.asarray(label))
    else:
        net.labels = []
    return net


def identify(docs: DataFrame, net: BiGru, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` plus held_out, lang_pred and score; columns of those names are replaced.

    Null text, or text without a letter, is ``und`` with score 0, and so is every row if nothing was
    learned. Whole texts are read; repeated rows get the same result; a null id is in the held-out
    fold; an empty table stays empty. Only ids and texts go through Python when the caller selects
    them; the weights (some thousand numbers) travel with the task.
    """

    @F.pandas_udf("lang_pred string, score double")
    def label(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            found = [net.predict([t if isinstance(t, str) else None for t in s.iloc[lo : lo + TOGETHER]]) for lo in range(0, len(s), TOGETHER)]
            yield pd.DataFrame({"lang_pred": [x for f in found for x in f[0]], "score": np.concatenate([f[1] for f in found]) if found else np.zeros(0)})

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("held_out", "lang_pred", "score")]
    return docs.select(*kept, (fold(F.col(key)) == 0).alias("held_out"), label(F.col(text)).alias("_label")).select(*kept, "held_out", "_label.lang_pred", "_label.score")
