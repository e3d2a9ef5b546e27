"""Token-ID output: canonical length-limited Huffman coding of ids from global counts.

Format. A token file is a Parquet row group set of independent blocks, one row each:
``part, block, doc_ids, n_tokens, n_codes, checkpoints, bits``. A block holds whole documents in
ascending id order. ``bits`` is the code stream (first bit highest, padded with zero bytes);
``checkpoints`` are the bit offsets of every ``STEP``-th id, so decoding may start at any of them,
and all of them are decoded side by side. The code itself is one row per used id and length; canonical
order (length, id) gives the code words, so no tree is kept. A lost executor costs the blocks of
its task only.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import byte_runs, stored

END_ID = 2
#: Longest code word; the decoding table has 2**MAX_BITS entries.
MAX_BITS = 16
#: Ids between two checkpoints.
STEP = 256
#: A block is closed after the document that reaches this many ids.
BLOCK_IDS = 1 << 16
#: Distinct pieces of text that a Python worker keeps, to encode each once; others are encoded once in each run of documents.
CACHE = 300000
#: Longest piece that is kept, in bytes, and a factor for each of its bytes in a hash.
LONGEST = 64
FACTORS = np.random.default_rng(0).integers(1, 1 << 63, LONGEST, np.uint64) * np.uint64(2) + np.uint64(1)
#: Places, by hash, that mark pieces as seen: only what comes again is worth keeping.
SEEN = 22  # bits
#: Bytes of text encoded together, unless one document alone is larger.
TOGETHER = 2 << 20
#: Bytes whose cuts are looked for at a time, and pieces whose ids are written out at a time.
AT_ONCE = 1 << 16
#: New pieces encoded as one text.
JOINED = 1000
#: Blocks unpacked side by side.
BLOCKS_AT_ONCE = 16

# The blank and the line end in the byte-level alphabet, and kinds of bytes. SOLID: a
# visible ASCII character. WORD: an ASCII letter or digit. SIGN: another of them, but for the
# apostrophe, which takes letters along. SPACE: blank or line end. HIGH: of a longer character. RARE: a
# last byte but one of the longer white space characters (85, a0, 1680, 2000-200a, 2028, 2029, 202f, 205f, 3000).
BLANK, LINE = "\u0120", "\u010a"
SOLID, WORD, SIGN, SPACE, HIGH, RARE = (1 << i for i in range(6))
KIND = np.zeros(256, np.uint8)
KIND[0x21:0x7F] = [SOLID | (WORD if chr(i).isalnum() else SIGN if chr(i) != "'" else 0) for i in range(0x21, 0x7F)]
KIND[[0x0A, 0x20]] = SPACE
KIND[0x80:] = HIGH
KIND[[0x80, 0x81, 0x9A, 0xC2]] |= RARE

BLOCKS = "block long, doc_ids array<long>, n_tokens array<long>, ids binary, counts binary"
CODED = "part int, block long, doc_ids array<long>, n_tokens array<long>, n_codes long, checkpoints array<long>, bits binary"


def cut_before(data: np.ndarray) -> np.ndarray:
    """Whether UTF-8 bytes may be cut before each of them, so that the ids of a text are those of its
    pieces one after the other. No cut is marked where that isn't certain.

    The tokenizer's splitting pattern never goes on from a visible character into white space, from a
    letter or digit into a sign other than the apostrophe, or from a lone line end into what follows.
    """
    found = np.zeros(len(data), bool)
    for lo in range(0, len(data), AT_ONCE):
        own = data[max(lo - 2, 0) : lo + AT_ONCE]
        kind = KIND[own]
        last = kind & HIGH != 0  # of a longer character, if the next byte is ASCII
        solid, word = kind & SOLID != 0, kind & WORD != 0
        if last.any():
            solid[1:] |= last[1:] & (kind[:-1] & RARE == 0)
            word[1:] |= last[1:] & (own[:-1] == 0xC3) & (own[1:] != 0x97) & (own[1:] != 0xB7)  # Latin letters
        at = np.zeros(len(own), bool)
        at[1:] = solid[:-1] & (kind[1:] & SPACE != 0) | word[:-1] & (kind[1:] & SIGN != 0)
        at[2:] |= solid[:-2] & (own[1:-1] == 0x0A) & ((kind[2:] & SOLID != 0) | (own[2:] == 0xC3))
        found[lo : lo + AT_ONCE] = at[lo - max(lo - 2, 0) :]
    return found


class Encoder:
    """Ids of texts, each distinct piece encoded once per call or, for those that came twice, per worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        vocabulary = self.tok.get_vocab(with_added_tokens=True)
        self.blank = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that start with a blank, in the byte-level alphabet
        self.blank[[i for t, i in vocabulary.items() if t.startswith(BLANK)]] = True
        self.line = vocabulary.get(LINE, -1)
        split = self.tok.pre_tokenizer
        #: the cuts hold for one splitting pattern; other tokenizers get whole texts
        self.cut = self.tok.normalizer is None and isinstance(split, pre_tokenizers.ByteLevel) and split.use_regex and not split.add_prefix_space
        self.known = pa.array([], pa.binary())
        self.seen = np.zeros(1 << SEEN, bool)
        self.flat, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _joined(self, words: pa.Array, blank: bool) -> tuple[np.ndarray, np.ndarray] | None:
        """(all ids, ids per word) of words encoded as one text: of words that start with a blank, or of
        words without line ends, set apart by them.

        Only the first token of a word of the first kind starts with the blank. None where the text
        holds an added token, which may take blanks with it, or the words can't be told apart.
        """
        text = (_bytes(words)[1].tobytes() if blank else b"\n".join(words.to_pylist())).decode()
        if any(t in text for t in self.added):
            return None
        ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        if blank:
            first = np.flatnonzero(self.blank[ids])
            return (ids, np.diff(first, append=len(ids))) if len(first) == len(words) and first[0] == 0 else None
        between = ids == self.line
        ends = np.append(np.flatnonzero(between), len(ids))
        return (ids[~between], np.diff(ends, prepend=-1) - 1) if len(ends) == len(words) else None

    def encode(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids per piece), most pieces encoded many at a time."""
        counts = np.zeros(len(new), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        start, data = _bytes(new)
        size = np.diff(start)
        visible = SOLID | HIGH
        short = self.cut & (size > 0) & (size <= TOGETHER // JOINED)
        kind = np.append(KIND[data], np.zeros(2, np.uint8))
        blank = short & (size > 1) & (np.append(data, 0)[start[:-1]] == 0x20) & (kind[start[:-1] + 1] & visible != 0)
        lines = np.append(0, np.cumsum(data == 0x0A))[start]
        plain = short & (kind[start[:-1]] & visible != 0) & (np.diff(lines) == 0)
        alone = [np.flatnonzero(~blank & ~plain)]
        for group in (blank, plain):
            rows = np.flatnonzero(group)
            for lo in range(0, len(rows), JOINED):
                some = rows[lo : lo + JOINED]
                found = self._joined(new.take(pa.array(some)), group is blank)
                if found is None:
                    alone.append(some)
                else:
                    counts[some] = found[1]
                    parts.append((some, found[0]))
        for i in np.concatenate(alone).tolist():
            ids = self.tok.encode_batch_fast([new[i].as_py().decode()], add_special_tokens=False)[0].ids
            counts[i] = len(ids)
            parts.append((np.array([i]), np.array(ids, np.uint32)))
        # to the order of the pieces
        order = np.concatenate([some for some, _ in parts])
        flat = np.concatenate([ids for _, ids in parts])
        at = np.zeros(len(new), np.int64)
        at[order] = np.cumsum(counts[order]) - counts[order]
        return _ragged(flat, at, counts), counts

    def _keep(self, new: pa.Array, ids: np.ndarray, n: np.ndarray, times: np.ndarray) -> None:
        """Keeps pieces seen before, in this call or (by hash) an earlier one, the frequent first, while there is room."""
        if len(self.known) >= CACHE:
            return
        start, data = _bytes(new)
        size = np.diff(start)
        places = np.arange(len(data)) - np.repeat(start[:-1], size)
        sums = np.add.reduceat((data + np.uint64(1)) * FACTORS[places % LONGEST], start[:-1])
        marks = (sums >> np.uint64(64 - SEEN)).astype(np.int64)
        often = np.flatnonzero(((times > 1) | self.seen[marks]) & (size <= LONGEST))
        self.seen[marks] = True
        kept = often[np.argsort(-times[often], kind="stable")][: CACHE - len(self.known)]
        if len(kept):
            self.known = pa.concat_arrays([self.known, new.take(pa.array(kept))])
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(n[kept]) - n[kept]])
            self.size, self.flat = np.concatenate([self.size, n[kept]]), np.concatenate([self.flat, _ragged(ids, (np.cumsum(n) - n)[kept], n[kept])])

    def batch(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids per text); null is empty."""
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string()), "")
        cuts, data = _bytes(texts.cast(pa.binary()))
        if len(data) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        found = cut_before(data) if self.cut else np.zeros(len(data), bool)
        for t in self.added:  # may hold signs and blanks
            for i in np.flatnonzero(pc.match_substring(texts, t).to_numpy(False)).tolist():
                found[cuts[i] : cuts[i + 1]] = False
        found[cuts[:-1][np.diff(cuts) > 0]] = True
        first = np.flatnonzero(found).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.append(first, np.int32(len(data)))), pa.py_buffer(data)]).dictionary_encode()
        pieces, which = coded.dictionary, coded.indices.to_numpy()
        at = pc.fill_null(pc.index_in(pieces, value_set=self.known), -1).to_numpy().astype(np.int64)
        flat, start, size = self.flat, self.start, self.size
        missed = np.flatnonzero(at < 0)
        if len(missed):
            new = pieces.take(pa.array(missed))
            ids, n = self.encode(new)
            at[missed] = len(size) + np.arange(len(new))
            start = np.concatenate([start, len(flat) + np.cumsum(n) - n])
            size, flat = np.concatenate([size, n]), np.concatenate([flat, ids])
            self._keep(new, ids, n, np.bincount(which, minlength=len(pieces))[missed])
        start, size = start[at], size[at]
        ends = np.concatenate([[0], np.cumsum(size[which])])
        out = np.empty(int(ends[-1]), np.uint32)
        for lo in range(0, len(which), AT_ONCE):
            some = which[lo : lo + AT_ONCE]
            out[ends[lo] : ends[lo + len(some)]] = _ragged(flat, start[some], size[some])
        del coded, pieces, which
        pa.default_memory_pool().release_unused()
        return out, np.diff(ends[np.searchsorted(first, cuts)])


def _bytes(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(where each item begins and the last ends, bytes) of an array without nulls."""
    _, ends, data = x.buffers()
    ends = np.frombuffer(ends, np.int32)[x.offset : x.offset + len(x) + 1] if len(x) else np.zeros(1, np.int32)
    lo, hi = int(ends[0]), int(ends[-1])
    return ends - lo, np.frombuffer(data, np.uint8)[lo:hi] if hi > lo else np.zeros(0, np.uint8)


def _ragged(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start:start + size] of all rows, one after the other."""
    ends = np.cumsum(size)
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - ends + size, size)]


@cache
def encoder(path: str) -> Encoder:
    """One per Python worker, kept from task to task."""
    return Encoder(path)


def tokenized(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: int | None = END_ID) -> DataFrame:
    """Blocks of whole documents in ascending id order, with ids as little-endian unsigned 16-bit integers.

    The rows are ranged on the id before they are encoded, and sorted in each range, so the text is
    moved once and encoded once. ``part`` numbers the ranges. The code holds at most 2**MAX_BITS
    ids, so 16 bits hold any id of a vocabulary that can be written. Each range ends with a row
    without a block, whose ``counts`` are the times of each id in it, from 0 on.
    """
    from tokenizers import Tokenizer

    if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) > 1 << MAX_BITS:
        raise ValueError("the vocabulary has more ids than the format can hold")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, block = encoder(path), 0
        ids: list[np.ndarray] = []
        keys: list = []
        sizes: list[int] = []
        total = np.zeros(0, np.int64)

        def row(block: int | None, keys: list | None, sizes: list | None, ids: bytes | None, counts: bytes | None) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((block, keys, sizes, ids, counts), kinds)], ["block", "doc_ids", "n_tokens", "ids", "counts"])

        def close():
            nonlocal block, ids, keys, sizes, total
            all_ids = np.concatenate(ids)
            total = _added(total, np.bincount(all_ids))
            out = row(block, keys, sizes, all_ids.tobytes(), None)
            block, ids, keys, sizes = block + 1, [], [], []
            return out

        held = 0
        for b in batches:
            text = b.column(1)
            for lo, hi in byte_runs(pc.fill_null(pc.binary_length(text), 0).to_numpy(), TOGETHER):
                flat, counts = enc.batch(text.slice(lo, hi - lo))
                if end is not None:
                    flat, counts = np.insert(flat, np.cumsum(counts), end), counts + 1
                flat, at, upto = flat.astype("<u2"), 0, 0
                for k, n in zip(b.column(0).slice(lo, hi - lo).to_pylist(), counts.tolist()):
                    keys.append(k)
                    sizes.append(n)
                    upto += n
                    if held + upto - at >= BLOCK_IDS:
                        ids.append(flat[at:upto])
                        yield close()
                        held, at = 0, upto
                if upto > at:  # a copy, so that only what is left is held
                    ids.append(flat[at:upto].copy())
                    held += upto - at
        if keys:
            ids.append(np.zeros(0, "<u2"))
            yield close()
        if block:
            yield row(None, None, None, None, total.astype("<i8").tobytes())

    ranged = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).repartitionByRange("k").sortWithinPartitions("k", "t")
    return ranged.mapInArrow(run, BLOCKS).select(F.spark_partition_id().alias("part"), "*")


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Huffman lengths, 0 for unused ids, none above ``most``: Kraft's sum is repaired where the tree was cut."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) == 0:
        return lengths
    if len(used) > 1 << most:
        raise ValueError("more ids than code words")
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    heap = [(int(counts[i]), n) for n, i in enumerate(used)]
    heapq.heapify(heap)
    parent = np.zeros(2 * len(used) - 1, np.int64)
    node = len(used)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        parent[a[1]] = parent[b[1]] = node
        heapq.heappush(heap, (a[0] + b[0], node))
        node += 1
    depth = np.zeros(node, np.int64)
    for n in range(node - 2, -1, -1):
        depth[n] = depth[parent[n]] + 1
    own = np.minimum(depth[: len(used)], most)
    order = np.argsort(counts[used], kind="stable")  # rare first
    over = int((1 << (most - own)).sum()) - (1 << most)
    for n in order:  # longer words for the rarest that have room, until the words fit
        while over > 0 and own[n] < most:
            own[n] += 1
            over -= 1 << (most - own[n])
    for n in order[::-1]:  # give back what is left to the most frequent
        while over < 0 and own[n] > 1 and -over >= 1 << (most - own[n]):
            over += 1 << (most - own[n])
            own[n] -= 1
    lengths[used] = own
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code words by (length, id): each is the one before plus one, shifted to its length."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    code, last = 0, 0
    for i in order[np.searchsorted(lengths[order], 1) :]:
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def decoding_table(lengths: np.ndarray, most: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(id, length) for each value of the next ``most`` bits."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[np.searchsorted(lengths[order], 1) :]
    span = 1 << (most - lengths[order])
    ids, sizes = np.zeros(1 << most, np.uint32), np.ones(1 << most, np.uint8)
    n = int(span.sum())
    ids[:n], sizes[:n] = np.repeat(order, span), np.repeat(lengths[order], span)
    return ids, sizes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, step: int = STEP) -> tuple[bytes, np.ndarray]:
    """(bits, checkpoints). A word of 64 bits is the OR of the code words that touch it."""
    size = lengths[ids]
    ends = np.cumsum(size)
    start = ends - size
    total = int(ends[-1]) if len(ends) else 0
    words = np.zeros((total >> 6) + 2, np.uint64)
    if len(ids):
        at, low = start >> 6, start & 63
        room = 64 - low - size
        word = codes[ids]
        shift = np.abs(room).astype(np.uint64)
        high = np.where(room >= 0, word << shift, word >> shift)
        firsts = np.flatnonzero(np.diff(at, prepend=-1))
        words[at[firsts]] = np.bitwise_or.reduceat(high, firsts)
        cut = np.flatnonzero(room < 0)  # at most one word runs over each end of 64 bits
        words[at[cut] + 1] |= word[cut] << (64 + room[cut]).astype(np.uint64)
    return words.astype(">u8").tobytes(), start[::step]


def unpack(bits: bytes, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray], step: int = STEP, most: int = MAX_BITS) -> np.ndarray:
    """``n`` ids: all checkpoints walk on together, one table look-up an id."""
    return unpack_all([(bits, checkpoints, n)], table, step, most)[0]


def unpack_all(blocks: list[tuple], table: tuple[np.ndarray, np.ndarray], step: int = STEP, most: int = MAX_BITS) -> list[np.ndarray]:
    """The ids of each (bits, checkpoints, n), all checkpoints of all blocks side by side.

    What follows the last id of a block is walked over as well and left out.
    """
    ids, sizes = table
    spare = bytes(4 * (step * most // 32 + 2))  # so far may a walk go beyond the last block
    words = np.frombuffer(b"".join([*(bits for bits, _, _ in blocks), spare]), ">u4").astype(np.uint64)
    pairs = (words[:-1] << np.uint64(32)) | words[1:]  # 64 bits from every 32nd on
    base = np.cumsum([0, *(8 * len(bits) for bits, _, _ in blocks)])
    at = np.concatenate([np.asarray(marks, np.int64) + lo for (_, marks, _), lo in zip(blocks, base)])
    out = np.zeros((step, len(at)), np.uint32)
    shift = np.uint64(64 - most)
    for i in range(step):
        peek = (pairs[at >> 5] << (at & 31).astype(np.uint64)) >> shift
        out[i] = ids[peek]
        at += sizes[peek]
    lanes = np.cumsum([0, *(len(marks) for _, marks, _ in blocks)])
    return [out[:, lo:hi].T.reshape(-1)[:n] for (_, _, n), lo, hi in zip(blocks, lanes, lanes[1:])]


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of two arrays, the shorter one filled up with zeros."""
    if len(a) < len(b):
        a, b = b, a
    out = a.astype(np.int64)
    out[: len(b)] += b
    return out


def id_counts(blocks: DataFrame) -> DataFrame:
    """(id, n) over all blocks, from the counts of their ranges; each task sends one row per id at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for x in b.column(0):
                total = _added(total, np.frombuffer(x.as_buffer(), "<i8"))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    return blocks.where("block is null").select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end: int | None = END_ID) -> None:
    """Encodes ``docs`` and writes the token files to ``path``/blocks and the code to ``path``/code.

    Null and empty texts have only the end id. Null ids come first, repeated rows stay and follow
    each other, other columns are ignored. An empty table gives empty files. The code is bounded by
    the vocabulary (at most 2**MAX_BITS ids) and is the only thing the driver sees.
    """
    spark = docs.sparkSession
    blocks = stored(tokenized(docs, tokenizer, key, text, end), "tokens")
    counted = id_counts(blocks).toPandas()
    counts = np.zeros(int(counted["id"].max()) + 1 if len(counted) else 1, np.int64)
    counts[counted["id"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    lengths = code_lengths(counts)
    used = np.flatnonzero(lengths)
    code = [(int(i), int(lengths[i])) for i in used]
    spark.createDataFrame(code, "id long, bits int").coalesce(1).write.parquet(f"{path}/code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical(lengths)
        for b in batches:
            for i in range(b.num_rows):  # a block at a time, so that no batch of them is held twice
                own = b.slice(i, 1)
                ids = np.frombuffer(own.column(4)[0].as_buffer(), "<u2").astype(np.int64)
                bits, marks = pack(ids, lengths, codes)
                yield pa.RecordBatch.from_arrays(
                    [*own.columns[:4], pa.array([len(ids)], pa.int64()), pa.array([marks], pa.list_(pa.int64())), pa.array([bits], pa.binary())],
                    ["part", "block", "doc_ids", "n_tokens", "n_codes", "checkpoints", "bits"],
                )

    blocks.where("block is not null").drop("counts").mapInArrow(run, CODED).write.option("compression", "none").parquet(f"{path}/blocks")


def _decoded(spark, path: str, column: str, schema: str, values) -> DataFrame:
    """(part, block, nth, doc_id) of every document of the files, with what ``values`` makes of the ids of a block and its cuts."""
    rows = spark.read.parquet(f"{path}/code").collect()  # bounded by the vocabulary
    lengths = np.zeros(max([r["id"] for r in rows], default=0) + 1, np.int64)
    for r in rows:
        lengths[r["id"]] = r["bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = decoding_table(lengths)
        for b in batches:
            for lo in range(0, b.num_rows, BLOCKS_AT_ONCE):
                rows = b.slice(lo, BLOCKS_AT_ONCE).to_pylist()
                for r, ids in zip(rows, unpack_all([(r["bits"], r["checkpoints"], r["n_codes"]) for r in rows], decoder)):
                    n = len(r["doc_ids"])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r["part"]] * n, pa.int32()), pa.array([r["block"]] * n, pa.int64()), pa.array(np.arange(n), pa.int64()), pa.array(r["doc_ids"], pa.int64()), *values(ids.astype("<u4"), [0, *np.cumsum(r["n_tokens"]).tolist()])],
                        ["part", "block", "nth", "doc_id", *column.split()],
                    )

    return spark.read.parquet(f"{path}/blocks").mapInArrow(run, f"part int, block long, nth long, doc_id long, {schema}")


def read_tokens(spark, path: str) -> DataFrame:
    """(part, block, nth, doc_id, ids) decoded from the files; ``nth`` counts within the block."""

    def values(ids: np.ndarray, cuts: list[int]) -> list[pa.Array]:
        return [pa.array([ids[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())]

    return _decoded(spark, path, "ids", "ids binary", values)


def read_sums(spark, path: str) -> DataFrame:
    """(part, block, nth, doc_id, n_tokens, ids_crc32), summed where the files are decoded."""

    def values(ids: np.ndarray, cuts: list[int]) -> list[pa.Array]:
        return [pa.array(np.diff(cuts), pa.int64()), pa.array([zlib.crc32(ids[i:j]) for i, j in zip(cuts, cuts[1:])], pa.int64())]

    return _decoded(spark, path, "n_tokens ids_crc32", "n_tokens long, ids_crc32 long", values)


def digest(tokens: DataFrame) -> DataFrame:
    """Per document of ``read_sums`` or ``read_tokens``: doc_id, start, n_tokens, ids_crc32.

    The start is the sum of the parts before, of the blocks before in the part, and of the documents
    before in the block: the first two are sums over one row per part and per block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc = [zlib.crc32(x.as_buffer()) for x in b.column(4)]
            n = [len(x.as_buffer()) // 4 for x in b.column(4)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["part", "block", "nth", "doc_id", "n_tokens", "ids_crc32"])

    if "ids" in tokens.columns:
        tokens = tokens.mapInArrow(run, "part int, block long, nth long, doc_id long, n_tokens long, ids_crc32 long")
    rows = stored(tokens, "token_digest")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    blocks = rows.groupBy("part", "block").agg(F.sum("n_tokens").alias("_n"))
    blocks = blocks.withColumn("_b", zero(F.sum("_n").over(before(Window.partitionBy("part").orderBy("block")))))
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    parts = parts.select("part", zero(F.sum("_n").over(before(Window.orderBy("part")))).alias("_p"))
    base = blocks.join(parts, "part").select("part", "block", (F.col("_b") + F.col("_p")).alias("_base"))
    within = zero(F.sum("n_tokens").over(before(Window.partitionBy("part", "block").orderBy("nth"))))
    return rows.withColumn("_w", within).join(base, ["part", "block"]).select("doc_id", (F.col("_base") + F.col("_w")).alias("start"), "n_tokens", "ids_crc32")
