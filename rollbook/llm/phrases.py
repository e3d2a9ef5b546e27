"""Phrase collocations by Toivonen's sampling: a sample proposes, one full pass decides, failures expand.

1. A seeded sample of the documents is mined level by level with a lowered threshold. What it finds
   (``S``) is a guess of the frequent phrases.
2. One pass over all documents counts S and its negative border: every word, and every phrase whose
   two parts one word shorter are both in S. The border is never listed; a phrase belongs to it if a
   lookup of both parts succeeds.
3. A frequent phrase that the lookup did not hold is a border failure: longer phrases over it were not
   counted. Failures are added to the lookup and a further pass counts the phrases that have only
   now two known parts. This ends when a pass brings no failure; then every phrase of which all
   parts are frequent has been counted in the whole corpus, whatever the sample held.
4. These passes count 62-bit keys, 16 bytes a row. Two phrases of one key could only add up, so the
   frequent keys hold every frequent phrase; a last pass spells the phrases of these keys and counts
   them as texts. All counts that are returned are from there and exact.

The lookup is a bit table of ``MOST_BITS`` bits (16 MB) at most, built by Spark's bitmap aggregation and
sent to every task. All passes over the corpus use one size, so what a pass counted, no later one counts.
It has no false negatives; a false positive only makes a pass count a phrase that it need not count.

A task reads slices of ``SLICE_BYTES`` with numpy, so memory follows the slice and not a document or a
partition; a slice sends a phrase once, and Spark adds the counts. A slice ends between pieces, or in
a longer piece between words, with the next words behind it for the phrases that start before its end.

Nulls and empty texts hold no word; a null language is ``und``. Equal rows count once each. An empty
table gives no row. A very long text is cut into slices as said; only a single word is held whole.
Ties: equal scores go by count, then by the phrase's bytes. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from rollbook.functions.ranking import top_per_group

from .common import stored

LONGEST, LEAST, TOP = 4, 30, 2000
SCALE, ABSORBED = 2_000_000, 80
#: One document in so many is in the sample; its threshold is lowered below the expected count.
SAMPLE, SAMPLE_LEAST = 8, 2
#: Bits of a lookup: so many a key, as a power of two, between these bounds.
KEY_BITS, LEAST_BITS, MOST_BITS = 16, 1 << 15, 1 << 27
SLICE_BYTES = 2 << 20
UNKNOWN = "und"

BREAKS = b".,;:!?\n\x0b\x0c\r"
_SEPARATOR, _NEXT_WORDS = re.compile(rb"[ \t.,;:!?\n-\r]"), re.compile(rb"[ \t]*(?:[^ \t]+[ \t]*){0,%d}" % (LONGEST - 1))
#: Of every byte: 0 in a word, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")], _KIND[list(BREAKS)] = 1, 2
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_VALUE = np.random.default_rng(13).integers(1, 1 << 63, 256, dtype=np.uint64)[_LOWER]
_STEP, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SIZE = np.uint64(3)


def spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def chained(front: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from the hash of its front and of its last word."""
    return spread(front * _STEP + word)


def chain(words: list[np.ndarray]) -> np.ndarray:
    """Hash of words in a row, from the words' hashes."""
    out = words[0]
    for w in words[1:]:
        out = chained(out, w)
    return out


def key_of(whole: np.ndarray, size: int) -> np.ndarray:
    """Key of a phrase: its hash, and its size in the two lowest bits."""
    return (whole & ~_SIZE) | np.uint64(size - 1)


class Lookup:
    """Bit table of keys; its size is a power of two."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.mask = len(bits) * 8 - 1

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = (keys >> np.uint64(2) & np.uint64(self.mask)).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def lookup(phrases: DataFrame, like: Lookup | None = None) -> Lookup:
    """The bit table over the column ``key``, of the size of ``like`` or by the number of keys; only its bits reach the driver."""
    size = like.mask + 1 if like else min(max(LEAST_BITS, 1 << (phrases.count() * KEY_BITS).bit_length()), MOST_BITS)
    places = phrases.select((F.shiftrightunsigned("key", 2).bitwiseAND(size - 1) + 1).alias("place"))
    rows = places.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    bits = np.zeros(size // 8, np.uint8)
    for bucket, chunk in rows.collect():
        bits[(bucket - 1) * len(chunk) : bucket * len(chunk)] = np.frombuffer(chunk, np.uint8)
    return Lookup(bits)


def segments(raw: bytes) -> Iterator[tuple[bytes, int]]:
    """Parts of a text of about ``SLICE_BYTES``, each with the length in which phrases may start."""
    lo = 0
    while len(raw) - lo > SLICE_BYTES:
        hi = lo + SLICE_BYTES
        cut = end = max(raw.rfind(c, lo + 1, hi) for c in (BREAKS[i : i + 1] for i in range(len(BREAKS))))
        if cut < 0:
            cut = max(raw.rfind(b" ", lo + 1, hi), raw.rfind(b"\t", lo + 1, hi))
            if cut < 0:
                found = _SEPARATOR.search(raw, hi)
                cut = found.start() if found else len(raw)
            end = _NEXT_WORDS.match(raw, cut).end()
        yield raw[lo:end], cut - lo
        lo = cut
    yield raw[lo:], len(raw) - lo


class Words:
    """The words of a slice: where they lie, their hash (language included), piece and language, and whether a phrase may start there."""

    def __init__(self, parts: list[bytes], own: list[int], lang: list[int], seeds: np.ndarray):
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        first = np.cumsum(sizes + 1) - sizes - 1
        self.raw = b"\n".join([*parts, b""])
        buf = np.frombuffer(self.raw, np.uint8)
        kind = _KIND[buf]
        edge = np.flatnonzero(np.diff(kind == 0, prepend=False, append=False))
        self.lo, self.hi = edge[::2], edge[1::2]
        # polynomial hash by prefix sums: the bytes' values times falling powers, moved to the word's start
        power = np.full(len(buf) + 1, _STEP)
        np.cumprod(power, out=power)
        power[1:] = _VALUE[buf] * power[:-1]
        power[0] = 0
        sums = np.cumsum(power, out=power)
        total = sums[self.hi] - sums[self.lo]
        sums.fill(_BACK)
        inverse = np.cumprod(sums, out=sums)[self.lo]
        del power, sums
        part = np.repeat(np.arange(len(parts)), np.diff(np.searchsorted(self.lo, np.append(first, len(buf)))))
        self.lang = np.asarray(lang, np.int64)[part]
        self.hash = spread(total * inverse + seeds[self.lang])
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[self.lo]
        self.own = self.lo - first[part] < np.asarray(own, np.int64)[part]

    def spelled(self) -> pa.DictionaryArray:
        """The words themselves, in lower case, with a number each."""
        low = np.frombuffer(self.raw.lower(), np.uint8)
        ends = np.concatenate([[0], np.cumsum(self.hi - self.lo)]).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(self.lo), [None, pa.py_buffer(ends), pa.py_buffer(low[_KIND[low] == 0])]).dictionary_encode()


def word_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, list[str]]]:
    """(words, names of the languages) of slices of about ``SLICE_BYTES``."""
    for b in batches:
        lang = b.column("lang").fill_null(UNKNOWN).dictionary_encode()
        names, codes = lang.dictionary.to_pylist(), lang.indices.to_pylist()
        seeds = np.fromiter((xxhash.xxh3_64_intdigest(n) for n in names), np.uint64, len(names))
        held: list[tuple[bytes, int, int]] = []
        size = 0
        for text, code in zip(b.column("text"), codes):
            for part, own in segments(text.as_buffer().to_pybytes() if text.is_valid else b""):
                if size + len(part) > SLICE_BYTES and held:
                    yield Words(*map(list, zip(*held)), seeds), names
                    held, size = [], 0
                held.append((part, own, code))
                size += len(part)
        if held:
            yield Words(*map(list, zip(*held)), seeds), names


def reached(words: Words, sizes: range, known: Lookup | None, before: Lookup | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, words where a phrase starts, hash of it) for the phrases whose parts are all in ``known``, but not all in ``before``."""
    at, whole = np.flatnonzero(words.own), words.hash[words.own]
    if 1 in sizes:
        yield 1, at, whole
    old = np.ones(len(at), bool)
    for size in range(2, sizes.stop):
        fits = at + size <= len(words.hash)
        fits[fits] = words.piece[at[fits] + size - 1] == words.piece[at[fits]]
        at, whole, old = at[fits], whole[fits], old[fits]
        front, back = key_of(whole, size - 1), key_of(chain([words.hash[at + j] for j in range(1, size)]), size - 1)
        held = known.holds(front) & known.holds(back)
        # a phrase is old if an earlier pass got as far as here, which is the same wherever the phrase stands
        old = old & before.holds(front) & before.holds(back) if before else np.zeros(len(at), bool)
        at, old = at[held], old[held]
        whole = chained(whole[held], words.hash[at + size - 1])
        if size in sizes:
            yield size, at[~old], whole[~old]


def counts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the last occurrence, value, rows) of every distinct value."""
    number, distinct = pd.factorize(values)
    where = np.empty(len(distinct), np.int64)
    where[number] = np.arange(len(values))
    return where, distinct, np.bincount(number, minlength=len(distinct))


def counted(docs: DataFrame, least: int, sizes: range, known: Lookup | None = None, before: Lookup | None = None) -> DataFrame:
    """(key, n) of the phrases that a pass counts and that occur ``least`` times."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, _ in word_slices(batches):
            for size, _, whole in reached(words, sizes, known, before):
                _, key, n = counts(key_of(whole, size).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    part = docs.select("lang", "text").mapInArrow(count, "key long, n long")
    return part.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def spelled(docs: DataFrame, least: int, known: Lookup) -> DataFrame:
    """(lang, size, phrase, n) of the phrases in ``known`` that occur ``least`` times; size 0 holds the words of a language."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, names in word_slices(batches):
            total = np.bincount(words.lang[words.own], minlength=len(names))
            yield rows(names, np.arange(len(names)), 0, pa.array([""] * len(names)), total)
            text = words.spelled()
            number = text.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            for size, at, whole in reached(words, range(1, LONGEST + 1), known):
                at = at[known.holds(key_of(whole, size))]
                same = words.lang[at]
                for j in range(size):
                    same, _ = pd.factorize(same * len(text.dictionary) + number[at + j])
                where, _, n = counts(same)
                start = at[where]
                phrase = [text.dictionary.take(text.indices.take(pa.array(start + j))) for j in range(size)]
                yield rows(names, words.lang[start], size, pc.binary_join_element_wise(*phrase, " ") if size > 1 else phrase[0], n)

    part = docs.select("lang", "text").mapInArrow(spell, "lang string, size int, phrase string, n long")
    return part.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("size") == 0))


def rows(names: list[str], owner: np.ndarray, size: int, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    lang = pa.DictionaryArray.from_arrays(pa.array(owner, pa.int32()), pa.array(names, pa.string())).cast(pa.string())
    return pa.RecordBatch.from_arrays([lang, pa.array(np.full(len(owner), size, np.int32)), phrase, pa.array(n)], ["lang", "size", "phrase", "n"])


def proposed(docs: DataFrame) -> DataFrame:
    """Frequent phrases of the sample, level by level; those of full length need no proposal, they are all border."""
    sample = stored(docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLE)) == 0).select("lang", "text"), "phrase_sample")
    found = stored(counted(sample, SAMPLE_LEAST, range(1, 2)), "phrase_guess")
    for size in range(2, LONGEST):
        found = found.unionByName(stored(counted(sample, SAMPLE_LEAST, range(size, size + 1), lookup(found)), "phrase_guess"))
    return found


def failures(frequent: DataFrame, known: Lookup) -> DataFrame:
    """Frequent phrases that can be part of longer ones and that the lookup did not hold."""

    def unknown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(~known.holds(b.column("key").to_numpy(zero_copy_only=False).view(np.uint64))))

    return frequent.where(F.col("key").bitwiseAND(3) < LONGEST - 1).select("key").mapInArrow(unknown, "key long")


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, size, phrase, n): all phrases of up to ``LONGEST`` words that occur ``least`` times, and the totals."""
    keys = proposed(docs).select("key")
    known = lookup(keys)
    found = stored(counted(docs, least, range(1, LONGEST + 1), known), "phrase_counts")
    new = found
    while (missed := stored(failures(new, known), "phrase_failures")).head(1):
        keys = keys.unionByName(missed)
        before, known = known, lookup(keys, known)
        new = stored(counted(docs, least, range(2, LONGEST + 1), known, before), "phrase_counts")
        found = found.unionByName(new)
    return spelled(docs, least, lookup(found))


def part(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases of 2 to ``LONGEST`` words."""
    frequent = stored(frequent_phrases(docs), "phrase_frequent")
    exact = T.DecimalType(38, 0)
    words, size, one = F.split("phrase", " "), F.col("size"), F.lit(1)
    found = frequent.where(size > 1).select("lang", "phrase", "size", F.col("n").alias("a"))
    cuts = found.select("*", F.explode(F.sequence(one, size - 1)).alias("k"))
    cuts = cuts.select("*", part(words, one, F.col("k")).alias("_first"), part(words, F.col("k") + 1, size).alias("_rest"))
    of = lambda name, n: frequent.select("lang", F.col("phrase").alias(name), F.col("n").alias(n)).where(F.col(name) != "")
    cuts = cuts.join(of("_first", "l"), ["lang", "_first"]).join(of("_rest", "r"), ["lang", "_rest"])
    scored = cuts.withColumn("score", F.expr(f"cast({SCALE} as decimal(18,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    worst = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("w")).select("lang", "phrase", "w.*")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda j: F.transform(F.sequence(one, size - j + 1), lambda i: part(words, i, j))))
    around = found.where(size > 2).select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("_f")).groupBy("lang", "phrase").agg(F.max("_f").alias("_f"))
    kept = worst.join(around, ["lang", "phrase"], "left").where(F.col("_f").isNull() | (F.col("_f").cast(exact) * 100 < F.col("a").cast(exact) * ABSORBED))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = top_per_group(kept.select("lang", "phrase", "a", "l", "r", "score"), ["lang"], order, top, ["phrase"], "rank")
    totals = frequent.where(size == 0).select("lang", "n")
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
