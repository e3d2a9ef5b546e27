"""Substring dedup by sliding sentence spans.

Every run of several consecutive sentences is hashed and joined globally; a sentence covered by a
repeated run that is not the first of its kind is removed. First means the smallest (id, position).
Run hashes are shuffled once, ranked where they meet, and texts move once, to have their sentences
taken out. Before that a task joins the runs of many texts: of equal ones only the first goes on, the
others are covered whatever stands elsewhere. So a run that a third of all documents hold is a few rows.

Longer sentences are cut into pieces by winnowing: of every ``WINDOW`` neighbouring gaps between
words, the one with the least hash of its two words is a cut. So a piece has at most ``WINDOW``
words, and from ``WINDOW`` words on inside a repeated passage its cuts do not depend on what stands
before or after. A passage of 51 equal words with equal sentence ends holds a whole run wherever it
lies: its first agreed cut after at most 15 words, a run of at most 24, and 8 before its end.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

#: A run has so many sentences at least, and goes on until it has so many words.
SENTENCES, WORDS = 3, 15
#: Neighbouring gaps between words of which one is a cut; a sentence of more words has pieces.
WINDOW = 8

#: A sentence ends after signs with a stop among them, before white space or an East Asian letter; East Asian stops need neither.
BREAK = re.compile(
    r"[^\w ](?:(?<=[\r\n])\s*"
    r"|(?<=[^\w\s])(?<![^\w\s].)(?:(?<=[.!?…])|(?=[^\w\s]*?[.!?…]))[^\w\s]*+(?:\s+|(?=[぀-ヿ㐀-鿿가-힯豈-﫿]))"
    r"|(?<=[。！？｡])[^\w\s]*+\s*)"
)
#: A run beside its hash: first sentence, sentences (8 bits) and 16 more bits of hash in one number.
POS, LEN, CHECK = 24, 16, 2**16 - 1
#: The same to be shuffled: 16 more bits of hash, first sentence (28 bits), whether it is covered already, sentences (19 bits).
KIND, AT, DONE, MOST = 48, 20, 1 << 19, (1 << 19) - 1
#: Runs that a task joins before they go on.
TOGETHER = 1 << 18


@cache
def _letters() -> np.ndarray:
    """Whether a code point belongs to a word: a letter, digit or underscore."""
    return np.fromiter((chr(i).isalnum() or i == 95 for i in range(0x110000)), bool, 0x110000)


def _split(text: str) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-case words joined by blanks, first word and first character of each sentence or piece,
    words of each).

    The cuts of all long sentences are found together: the least (hash, later place) of every ``WINDOW``
    neighbouring gaps of one sentence.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    inside = _letters()[points]
    start = np.flatnonzero(inside[1:] > inside[:-1]) + 1
    if len(points) and inside[0]:
        start = np.concatenate([[0], start])
    if not len(start):
        return b"", start, start, start
    # a blank for all else, before the letters change: lower case may be longer
    low = " ".join(np.where(inside, points, np.uint32(32)).tobytes().decode("utf-32-le", "surrogatepass").lower().split()).encode("utf-8", "surrogatepass")
    raw = low.split(b" ")
    ends = np.array([m.end() for m in BREAK.finditer(text)], np.int64)
    sentence = np.searchsorted(ends, start, "right")
    first = np.flatnonzero(np.diff(sentence, prepend=-1))
    cut = np.zeros(len(raw), bool)
    whole = np.flatnonzero(sentence[WINDOW:] == sentence[:-WINDOW])
    if len(whole):
        h = np.fromiter(map(zlib.crc32, raw[1:], map(zlib.crc32, raw)), np.uint64, len(raw) - 1)
        least = h << np.uint64(32) | np.arange(2**32 - 1, 2**32 - 1 - len(h), -1, dtype=np.uint64)
        span = 1
        while span < WINDOW:  # the least of twice as many gaps each time
            step = min(span, WINDOW - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        cut[2**32 - (least[whole] & np.uint64(2**32 - 1)).astype(np.int64)] = True
    cut[first] = True
    begin = np.flatnonzero(cut)
    start[first] = np.concatenate([[0], ends])[sentence[first]]
    start[0] = 0
    return low, begin, start[begin], np.diff(begin, append=len(raw))


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, lower-case words) of each sentence or piece of one, covering the whole text.

    A stretch without words belongs to the sentence before it (or, at the start, to the next).
    """
    low, begin, start, sizes = _split(text)
    words = low.decode("utf-8", "surrogatepass").split(" ")
    ends = [*start[1:].tolist(), len(text)]
    return [(lo, hi, words[b : b + n]) for lo, hi, b, n in zip(start.tolist(), ends, begin.tolist(), sizes.tolist())]


def _hashed(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, 16 more bits of hash, sentences) of the run that begins with each sentence, as far as one does."""
    low, begin, _, sizes = _split(text)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(len(sizes))
    end = np.maximum(np.searchsorted(upto, upto[:-1] + WORDS), at + SENTENCES)
    n = int((end <= len(sizes)).sum())
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    blank = np.concatenate([[-1], np.flatnonzero(np.frombuffer(low, np.uint8) == 32), [len(low)]])
    lo, hi = (blank[begin] + 1).tolist(), blank[begin + sizes].tolist()
    marks = b"".join([xxhash.xxh3_64_digest(low[i:j]) for i, j in zip(lo, hi)])
    whole = b"".join([xxhash.xxh3_128_digest(marks[i:j]) for i, j in zip((8 * at[:n]).tolist(), (8 * end[:n]).tolist())])
    halves = np.frombuffer(whole, ">u8").reshape(-1, 2)
    return halves[:, 1].astype(np.uint64), (halves[:, 0] & np.uint64(CHECK)).astype(np.int64), end[:n] - at[:n]


def runs(text: str) -> tuple[list[tuple[int, int, int, int]], int]:
    """((hash, packed place) of every run, number of sentences). A run has at most 255 sentences:
    each has a word, and it ends with the third sentence from fifteen words on."""
    h, c, n = _hashed(text)
    return list(zip(h.tolist(), (np.arange(len(h)) << POS | n << LEN | c).tolist())), len(_split(text)[1])


def _joined(k: np.ndarray, h: np.ndarray, c: np.ndarray, pos: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """(k, h, q) of runs: of equal ones the first place; what later ones cover, as far as it is joined, per id."""
    order = np.lexsort((pos, k, c, h))
    k, h, c, pos, n = k[order], h[order], c[order], pos[order], n[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = np.flatnonzero((k != k[lead]) | (pos != pos[lead]))
    lk, lo, hi = k[later], pos[later], pos[later] + n[later]
    order = np.lexsort((lo, lk))
    lk, lo, hi = lk[order], lo[order], hi[order]
    # a run goes on from the one before it if it starts at its end or earlier; of one id a later start has no earlier end
    apart = np.ones(len(lk), bool)
    apart[1:] = (lk[1:] != lk[:-1]) | (lo[1:] > hi[:-1])
    ones = np.flatnonzero(apart)
    lk, lo, hi = lk[ones], lo[ones], np.maximum.reduceat(hi, ones) if len(ones) else hi
    parts = np.maximum((hi - lo + MOST - 1) // MOST, 1)
    lk, hi, lo = np.repeat(lk, parts), np.repeat(hi, parts), np.repeat(lo, parts) + MOST * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    covered = lo << AT | DONE | np.minimum(hi - lo, MOST)
    spread = (lk.view(np.uint64) ^ lo.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)  # any place will do
    q = (c[new].astype(np.uint64) << np.uint64(KIND)).view(np.int64) | pos[new] << AT | n[new]
    columns = np.concatenate([k[new], lk]), np.concatenate([h[new], spread]).view(np.int64), np.concatenate([q, covered])
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["k", "h", "q"])


def all_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, h, q) of the first of equal runs that a task joins and of what the others cover; a null id takes the smallest number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                some = b.slice(lo, 500)
                for k, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    h, c, n = _hashed(t or "")
                    if len(h):
                        held.append((np.full(len(h), k, np.int64), h, c, np.arange(len(h)), n))
                        size += len(h)
                    if size >= TOGETHER:
                        yield _joined(*map(np.concatenate, zip(*held)))
                        held, size = [], 0
        if held:
            yield _joined(*map(np.concatenate, zip(*held)))

    return docs.select(_number(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, "k long, h long, q long")


def _number(key: str):
    return F.coalesce(F.col(key).cast("bigint"), F.lit(-(2**63)))


def repeated(found: DataFrame) -> DataFrame:
    """(k, spans): what runs that are not the first of their kind cover, per document: first sentence and sentences in one number.

    Rows meet once, by hash. One run has at most a row per ``TOGETHER`` runs of its task.
    """
    kind = F.col("q").bitwiseAND(F.lit(-(1 << KIND) | DONE))
    met = found.repartition("h").withColumn("kind", kind)
    place = F.shiftright("q", AT).bitwiseAND(F.lit((1 << KIND - AT) - 1))
    ranked = met.withColumn("rank", F.rank().over(Window.partitionBy("h", "kind").orderBy("k", place)))
    later = ranked.where((F.col("rank") > 1) | (F.col("q").bitwiseAND(F.lit(DONE)) != 0))
    return later.select("k", F.col("q").bitwiseAND(F.lit((1 << KIND) - 1)).alias("span")).groupBy("k").agg(F.collect_set("span").alias("spans"))


def _without(text: str, covered: np.ndarray) -> tuple[str, int, int, int]:
    """``without`` for a mark per sentence, or more marks than there are."""
    _, _, start, sizes = _split(text)
    if not covered.any():
        return text, len(sizes), 0, 0
    gone = np.zeros(len(sizes), bool)
    gone[: len(covered)] = covered[: len(sizes)]
    ends = np.append(start[1:], len(text))
    kept = "".join([text[lo:hi] for lo, hi in zip(start[~gone].tolist(), ends[: len(sizes)][~gone].tolist())])
    return kept, len(sizes), int(gone.sum()), int(sizes[gone].sum())


def without(text: str, covered: set[int]) -> tuple[str, int, int, int]:
    """(text without the covered sentences, sentences, removed sentences, removed words)."""
    marks = np.zeros(max(covered, default=-1) + 1, bool)
    marks[list(covered)] = True
    return _without(text, marks)


def _marks(spans: np.ndarray) -> np.ndarray:
    """A mark per sentence that any of the packed spans covers."""
    lo = spans >> AT
    hi = lo + (spans & MOST)
    open_ = np.zeros(int(hi.max()) + 1 if len(hi) else 1, np.int64)
    np.add.at(open_, lo, 1)
    np.add.at(open_, hi, -1)
    return np.cumsum(open_) > 0


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the text left, plus n_sentences, n_removed and removed_words (replaced if present).

    Null text stays null and has no sentence; empty and wordless texts stay. Rows with one id are
    one document, so repeated rows keep the same text and do not take sentences from each other;
    rows with a null id share one place before all others. A run that repeats within a document is
    removed there too. An empty table stays empty; other columns stay.
    """
    covers = repeated(all_runs(docs, key, text)).withColumnRenamed("k", "_k")
    kept = [c for c in docs.columns if c not in ("n_sentences", "n_removed", "removed_words")]

    @F.pandas_udf("text string, n_sentences int, n_removed int, removed_words int")
    def take_out(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = [_without(t, _marks(np.asarray(c, np.int64)) if c is not None else np.zeros(0, bool)) if isinstance(t, str) else (None, 0, 0, 0) for t, c in zip(texts, spans)]
        return pd.DataFrame(rows, columns=["text", "n_sentences", "n_removed", "removed_words"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), _number(key).alias("_n"))
    both = rows.join(covers, F.col("_n") == F.col("_k"), "left")
    done = both.select("_row", take_out(F.col(f"_row.`{text}`"), F.col("spans")).alias("_out"))
    cols = [F.col("_out.text").alias(c) if c == text else F.col(f"_row.`{c}`") for c in kept]
    return done.select(*cols, "_out.n_sentences", "_out.n_removed", "_out.removed_words")
