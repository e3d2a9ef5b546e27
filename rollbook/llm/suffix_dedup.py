"""Suffix-array dedup: bytes that repeat an earlier document go, the first copy stays.

The longest previous factor of a suffix is its longest match with a document of a smaller id; a byte
goes if a factor of ``LENGTH`` bytes or more covers it, so factors are followed up to that length. In
suffix order the documents before and after with a smaller id (previous and next smaller value) hold
the longest match; suffixes that agree in ``LENGTH`` bytes stand together.

Distribution. Every start of ``LENGTH`` bytes belongs to the smallest hash of the short strings in
it, so equal ones meet in one bucket whatever surrounds them. Neighbouring starts mostly share that
hash: their bytes go to the bucket once, as one stretch. Documents are dealt to blocks; a block sends
each distinct stretch once, with its smallest id, so a passage that a third of all documents hold is
one stretch per block. A bucket answers which starts occur earlier than the stretch's own smallest id;
the block, cut again the same way, takes the covered bytes out of its documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

LENGTH, SHORT = 50, 9
#: Starts in a stretch: first and last start of it show all its bytes, and a bit each fits a number.
STRETCH = 48
#: Bytes of text in a block, of stretches in a bucket, and positions worked on at once.
BLOCK_BYTES, BUCKET_BYTES, AT_ONCE = 2 << 20, 6 << 20, 1 << 20
#: Stretches take about so many bytes for each byte of text.
GROWTH = 3.5
STARTS_AT_ONCE = 4 << 20
#: Slots in which equal starts are looked for before any are sorted, a power of two.
SLOTS = 8 << 20

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Where the words of eight bytes lie that show all bytes of a start.
WORDS = (0, 8, 16, 24, 32, 40, LENGTH - 8)
SENT = "bucket long, block long, ids binary, sizes binary, body binary"
ANSWER = "block long, bucket long, nth binary, mask binary"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def eight_bytes(buf: np.ndarray) -> np.ndarray:
    """The big-endian number of the eight bytes from each position on (zeros behind the end)."""
    padded = np.concatenate([buf, np.zeros(16, np.uint8)])
    out = np.empty(len(buf) + 8, np.uint64)
    for i in range(8):
        own = out[i::8]
        own[:] = np.frombuffer(padded.data, ">u8", len(own), i)
    return out[: len(buf)]


def start_hash(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the LENGTH bytes from each position in ``at``."""
    h = np.zeros(len(at), np.uint64)
    for w in WORDS:
        h = mix(h * M1 + words[at + w])
    return h


def starts_in(ends: np.ndarray) -> np.ndarray:
    """Which positions have LENGTH bytes before the end of their document."""
    size = int(ends[-1]) if len(ends) else 0
    step = np.zeros(size + 1, np.int32)
    lo = np.concatenate([[0], ends[:-1]])
    hi = np.maximum(lo, ends - LENGTH + 1)
    np.add.at(step, lo, 1)
    np.add.at(step, hi, -1)
    return np.cumsum(step[:-1]) > 0


def stretches(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, starts, owning hash) of the stretches of a block."""
    valid, found = starts_in(ends), []
    span = LENGTH - SHORT + 1
    for lo in range(0, len(buf), AT_ONCE):
        hi = min(lo + AT_ONCE, len(buf))
        at = np.flatnonzero(valid[lo:hi])
        if not len(at):
            continue
        words = eight_bytes(buf[lo : hi + LENGTH])
        low = mix(words[: -(SHORT - 8)] * M1 + words[SHORT - 8 :])
        width = 1
        while 2 * width <= span:  # smallest of 1, 2, 4, ... neighbours
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if span > width:
            low = np.minimum(low[: -(span - width)], low[span - width :])
        owner = low[at]
        new = np.flatnonzero(np.append(True, (np.diff(at) != 1) | (owner[1:] != owner[:-1])))
        size = np.diff(np.append(new, len(at)))
        parts = -(-size // STRETCH)  # long runs of one hash are cut
        first = np.repeat(at[new], parts)
        nth = np.arange(len(first)) - np.repeat(np.cumsum(parts) - parts, parts)
        rest = np.repeat(size, parts) - nth * STRETCH
        found.append((first + nth * STRETCH + lo, np.minimum(rest, STRETCH), np.repeat(owner[new], parts)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    pos, size, owner = (np.concatenate(x) for x in zip(*found))
    return pos, size, owner


class Block:
    """A block's documents (ascending id) with their distinct stretches by bucket and first place."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], n_buckets: int):
        self.ids, self.texts = ids, texts
        self.ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        self.buf = np.frombuffer(b"".join(texts), np.uint8)
        self.pos, self.size, owner = stretches(self.buf, self.ends)
        self.doc = np.searchsorted(self.ends, self.pos, side="right")
        bucket = (owner % np.uint64(n_buckets)).astype(np.int64)
        ext = np.concatenate([self.buf, np.zeros(8, np.uint8)])
        first, last = self._hash(ext, self.pos), self._hash(ext, self.pos + self.size - 1)
        same = mix(first * M1 + last * M2 + self.size.astype(np.uint64))
        order = np.lexsort((np.arange(len(same)), same, bucket))
        new = np.append(True, (same[order][1:] != same[order][:-1]) | (bucket[order][1:] != bucket[order][:-1]))[: len(order)]
        head = order[new]  # the first place of each distinct stretch
        by_place = np.lexsort((head, bucket[head]))
        rank = np.empty(len(head), np.int64)
        rank[by_place] = np.arange(len(head))
        self.which = np.empty(len(order), np.int64)
        self.which[order] = rank[np.cumsum(new) - 1]
        self.head, self.bucket = head[by_place], bucket[head[by_place]]

    @staticmethod
    def _hash(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for w in WORDS:
            word = np.zeros(len(at), np.uint64)
            for i in range(8):
                word = (word << np.uint64(8)) | buf[at + w + i].astype(np.uint64)
            h = mix(h * M1 + word)
        return h

    def sent(self) -> Iterator[tuple]:
        """(bucket, smallest ids, starts, bytes) of the distinct stretches, a row per bucket."""
        squeeze = zstandard.ZstdCompressor(level=1).compress
        cuts = np.flatnonzero(np.diff(self.bucket, prepend=-1))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(self.head))):
            own = self.head[lo:hi]
            ids, size = self.ids[self.doc[own]], self.size[own]
            body = self.buf[ragged(self.pos[own], size + LENGTH - 1)]
            yield int(self.bucket[lo]), squeeze(np.diff(ids, prepend=0).tobytes()), squeeze(size.astype(np.uint8).tobytes()), squeeze(body.tobytes())

    def covered(self, answers: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
        """Which bytes of the block go, from (bucket, nth, mask) of the buckets."""
        mask = np.zeros(len(self.head), np.uint64)
        for bucket, nth, bits in answers:
            mask[np.searchsorted(self.bucket, bucket) + nth] = bits
        later = self.ids[self.doc] > self.ids[self.doc[self.head]][self.which]
        own = np.where(later, np.uint64(2**64 - 1), mask[self.which])
        some = np.flatnonzero(own)
        starts = ragged(self.pos[some], self.size[some])
        nth = starts - np.repeat(self.pos[some], self.size[some])
        hit = starts[((np.repeat(own[some], self.size[some]) >> nth.astype(np.uint64)) & np.uint64(1)) == 1]
        step = np.zeros(len(self.buf) + 1, np.int32)
        step[hit] += 1  # a start belongs to one stretch only
        step[hit + LENGTH] -= 1
        return np.cumsum(step[:-1]) > 0


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every row, one after the other."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - ends + size, size)


def previous_factors(words: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether the factor of LENGTH bytes at each position occurs in a document with a smaller id.

    Positions whose factor occurs once have no match and are left out by their hash. The others are
    put in suffix order by their bytes; in a run of suffixes that agree in LENGTH bytes, a position
    has a previous or next smaller document inside the run if and only if it is not the smallest.
    """
    out = np.zeros(len(at), bool)
    h = start_hash(words, at)
    slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
    maybe = np.flatnonzero(np.bincount(slot, minlength=SLOTS)[slot] > 1)  # alone in its slot: no equal start
    order = maybe[np.argsort(h[maybe])]
    again = h[order][1:] == h[order][:-1]
    some = order[np.append(again, False) | np.append(False, again)] if len(order) else order
    if not len(some):
        return out
    bytes_of = [words[at[some] + w] for w in WORDS]
    suffixes = np.lexsort(bytes_of[::-1])
    differs = np.zeros(len(some) - 1, bool)
    for b in bytes_of:
        s = b[suffixes]
        differs |= s[1:] != s[:-1]
    runs = np.flatnonzero(np.append(True, differs))
    docs = doc[some][suffixes]
    least = np.repeat(np.minimum.reduceat(docs, runs), np.diff(np.append(runs, len(docs))))
    out[some[suffixes]] = least < docs
    return out


def answer(blocks: list[int], ids: list[bytes], sizes: list[bytes], bodies: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(block, nth, mask) for the stretches of a bucket that have a start in an earlier document."""
    expand = zstandard.ZstdDecompressor().decompress
    size = [np.frombuffer(expand(x), np.uint8).astype(np.int64) for x in sizes]
    doc = np.concatenate([np.cumsum(np.frombuffer(expand(x), np.int64)) for x in ids])
    buf = np.frombuffer(b"".join(expand(x) for x in bodies), np.uint8)
    held = [len(s) for s in size]
    size = np.concatenate(size)
    pos = np.cumsum(size + LENGTH - 1) - size - LENGTH + 1
    words = eight_bytes(buf)
    mask = np.zeros(len(size), np.uint64)
    total = int(size.sum())
    passes = -(-total // STARTS_AT_ONCE)
    for turn in range(passes):  # equal starts have equal hashes, so they meet in one pass
        if passes == 1:
            at, row = ragged(pos, size), np.repeat(np.arange(len(size)), size)
        else:
            at_parts, row_parts = [], []
            for lo in range(0, len(size), 1 << 16):
                a, r = ragged(pos[lo : lo + (1 << 16)], size[lo : lo + (1 << 16)]), np.repeat(np.arange(lo, min(lo + (1 << 16), len(size))), size[lo : lo + (1 << 16)])
                own = mix(start_hash(words, a)) % np.uint64(passes) == turn
                at_parts.append(a[own])
                row_parts.append(r[own])
            at, row = np.concatenate(at_parts), np.concatenate(row_parts)
        hit = previous_factors(words, at, doc[row])
        at, row = at[hit], row[hit]
        # at most STRETCH different powers of two: their sum is exact
        mask |= np.bincount(row, np.exp2(at - pos[row]), len(size)).astype(np.uint64)
    lo = 0
    for block, n in zip(blocks, held):
        nth = np.flatnonzero(mask[lo : lo + n])
        if len(nth):
            yield block, nth, mask[lo : lo + n][nth]
        lo += n


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list]]:
    """Rows sorted by block, gathered block by block."""
    now, ids, texts = None, [], []
    for b in batches:
        for block, k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if block != now:
                if ids:
                    yield now, ids, texts
                now, ids, texts = block, [], []
            ids.append(k)
            texts.append(t)
    if ids:
        yield now, ids, texts


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans, kept (the bytes left).

    Null text is empty. A null id counts as smaller than all others. Rows of one id are one
    document: they never take bytes from each other, and each gets its result. Texts shorter than
    LENGTH bytes stay whole. ``kept`` may cut a character in two, so it is binary. An empty table
    gives an empty result; other columns are not carried.
    """
    least = -(2**63)
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n_blocks = max(1, -(-total // BLOCK_BYTES))
    n_buckets = max(1, -(-int(total * GROWTH) // BUCKET_BYTES))
    rows = docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(least)).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(n_blocks)).alias("block"), "id", "text").repartition("block")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts in _blocks(batches):
            rows = list(Block(np.array(ids, np.int64), texts, n_buckets).sent())
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array([block] * len(rows), pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["bucket", "block", "ids", "sizes", "body"])

    def meet(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py() if group.num_rows else 0
        rows = list(answer(*(group.column(c).to_pylist() for c in ("block", "ids", "sizes", "body"))))
        return pa.table({
            "block": pa.array([r[0] for r in rows], pa.int64()), "bucket": pa.array([bucket] * len(rows), pa.int64()),
            "nth": pa.array([r[1].astype("<u4").tobytes() for r in rows], pa.binary()), "mask": pa.array([r[2].astype("<u8").tobytes() for r in rows], pa.binary())})

    def take_out(own: pa.Table, answers: pa.Table) -> pa.Table:
        order = np.argsort(own.column("id").to_numpy(), kind="stable")
        ids = own.column("id").to_numpy()[order]
        texts = own.column("text").to_pylist()
        block = Block(ids, [texts[i] for i in order], n_buckets)
        gone = block.covered([(b, np.frombuffer(n, "<u4").astype(np.int64), np.frombuffer(m, "<u8")) for b, n, m in zip(*(answers.column(c).to_pylist() for c in ("bucket", "nth", "mask")))])
        lo, out = 0, []
        for hi in block.ends.tolist():
            cut = gone[lo:hi]
            out.append((hi - lo, int(cut.sum()), int((np.diff(cut.astype(np.int8), prepend=0) == 1).sum()), block.buf[lo:hi][~cut].tobytes()))
            lo = hi
        cols = list(zip(*out)) or [[], [], [], []]
        return pa.table({"id": pa.array(ids, pa.int64()), **{c: pa.array(v, pa.int64()) for c, v in zip(("n_bytes", "n_removed", "n_spans"), cols)}, "kept": pa.array(cols[3], pa.binary())})

    sent = dealt.sortWithinPartitions("block", "id").mapInArrow(send, SENT)
    answers = sent.groupBy("bucket").applyInArrow(meet, ANSWER)
    done = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(take_out, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return done.select(F.when(F.col("id") != least, F.col("id")).cast(docs.schema[key].dataType).alias(key), "n_bytes", "n_removed", "n_spans", "kept")
