"""Near-duplicate classes by ProbMinHash, banding and verification.

Each shingle of a document sends the arrivals of a Poisson process of its weight; an arrival falls
into a random register, and a register keeps its earliest. A shingle stops as soon as its next
arrival is later than every register, so a document costs about its shingles plus m ln m arrivals.
Two documents agree in a register with the probability Jaccard of their weighted shingles. Here
every distinct shingle weighs one, however often it repeats: likeness is the Jaccard of the shingle
sets, in the sketches as in the verification of the candidates that the banded registers give.

Equal texts are one node. In a band bucket of up to ``ALL_PAIRS`` nodes every pair is a candidate;
in a larger one every node meets ``PIVOTS`` pivots of each of its buckets, and where a large bucket
then still holds several classes, the nodes outside its largest class meet ``CLOSING`` more. Large
buckets that hold several classes even so are decided exactly: those that share nodes are one group,
and in a group every node outside the largest class is compared with every node of another class,
block by block of shingle sets. So two texts that share a band are compared or are of one class
already. No row is dropped and no group is gathered; a task holds two blocks. The comparison is
quadratic in the nodes outside the largest class of a group.

Shingle sets are taken in the pass that sketches, so texts are never shuffled; joins that carry sets
are merge joins at every size, since both sides grow with the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import byte_runs, short_batches, stored

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
ALL_PAIRS, PIVOTS, CLOSING = 24, 2, 4
#: Bytes of the shingle sets in a block of undecided nodes, about.
BLOCK_BYTES = 2 << 20
#: Bytes of text whose arrivals are drawn together (a longer text alone); the sketch takes about 50 times as many.
TOGETHER_BYTES = 256 << 10

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, shingle hash, count) of the distinct word shingles, sorted by both.

    Words are lower-case runs of ASCII letters, digits and non-ASCII characters. A text of fewer
    words than a shingle, but not none, is one shingle.
    """
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    doc_start = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = _WORD_BYTE[buf]
    edge = np.flatnonzero(np.diff(word.astype(np.int8), prepend=0, append=0))
    lo, hi = edge[::2], edge[1::2]
    if not len(lo):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # a word's hash: mixed (byte, place in the word) summed over the word
    begin = np.zeros(len(buf), np.int64)
    begin[lo] = lo
    place = np.arange(len(buf)) - np.maximum.accumulate(begin)
    part = mix((buf.astype(np.uint64) + np.uint64(1)) * M1 + place.astype(np.uint64))
    run = np.concatenate([[np.uint64(0)], np.cumsum(part, dtype=np.uint64)])
    w = mix(run[hi] - run[lo] + (hi - lo).astype(np.uint64) * M1)
    doc = np.searchsorted(doc_start, lo, side="right") - 1
    n = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(n) - n
    size = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    d = np.repeat(np.arange(len(texts)), size)
    at = np.arange(len(d)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
    h = np.zeros(len(d), np.uint64)
    for i in range(SHINGLE):
        inside = at + i < first[d] + n[d]
        h = mix(h * M1 + np.where(inside, w[np.minimum(at + i, len(w) - 1)], np.uint64(i)))
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    new = np.append(True, (d[1:] != d[:-1]) | (h[1:] != h[:-1])) if len(d) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    return d[starts], h[starts], np.diff(np.append(starts, len(d)))


def signatures(n_docs: int, doc: np.ndarray, element: np.ndarray, weight: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """(documents, m) elements that arrived first in each register; 0 for documents without elements."""
    first = np.full(n_docs * m, np.inf)
    kept = np.zeros(n_docs * m, np.uint64)
    doc, element, rate = doc, element, weight.astype(np.float64)
    time = np.zeros(len(doc))
    latest = np.full(n_docs, np.inf)
    step = 0
    while len(doc):
        step += 1
        a = mix(element + np.uint64(step * int(M1) % 2**64))
        time = time - np.log(((a >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        live = time < latest[doc]
        if not live.all():
            doc, element, rate, time, a = doc[live], element[live], rate[live], time[live], a[live]
        register = doc * m + (mix(a + M2) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, register, time)
        won = first[register] == time
        kept[register[won]] = element[won]
        some = np.unique(doc)
        latest[some] = first.reshape(n_docs, m)[some].max(axis=1)
    return kept.reshape(n_docs, m)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(documents, BANDS) keys of the registers of each band."""
    out = np.zeros((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(sig), np.uint64(b + 1))
        for r in range(ROWS):
            h = mix(h * M1 + sig[:, b * ROWS + r])
        out[:, b] = h
    return out


def _sketch(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, t, keys, set): id, hash of the text, band keys and the sorted distinct 32-bit hashes of the shingles.

    The last two are null in all but the smallest id of a text in the batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in byte_runs(pc.fill_null(pc.binary_length(b.column("x")), 0).to_numpy(zero_copy_only=False) + 64, TOGETHER_BYTES):
                some = b.slice(lo, hi - lo)
                ids, hashes, texts = (c.to_pylist() for c in some.columns)
                least: dict[str, int] = {}
                for i, (k, h) in enumerate(zip(ids, hashes)):
                    j = least.get(h)
                    if k is not None and (j is None or k < ids[j]):
                        least[h] = i
                chosen = sorted(least.values())
                doc, element, _ = shingles([texts[i] or "" for i in chosen])
                keys = band_keys(signatures(len(chosen), doc, element, np.ones(len(doc)))).view(np.int64)
                small = (element >> np.uint64(32)).astype("<u4")  # sorted, as the whole hashes are
                cuts = np.searchsorted(doc, np.arange(len(chosen) + 1))
                key_col: list = [None] * some.num_rows
                set_col: list = [None] * some.num_rows
                for j, i in enumerate(chosen):
                    if cuts[j] < cuts[j + 1]:
                        key_col[i], set_col[i] = keys[j], small[cuts[j] : cuts[j + 1]].tobytes()
                cols = [some.column(0), some.column(1), pa.array(key_col, pa.list_(pa.int64())), pa.array(set_col, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["k", "t", "keys", "set"])

    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("t"), F.col(text).alias("x"))
    return rows.mapInArrow(run, "k long, t string, keys array<long>, set binary")


def links_between(sets: list[np.ndarray], roots: np.ndarray, left: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links (i, j) that join the classes ``roots`` as all alike pairs of a ``left`` set and any other would."""
    if not len(sets):
        return []
    size = np.array([len(x) for x in sets])
    order = np.argsort(size, kind="stable")
    size, label, left = size[order], np.unique(roots, return_inverse=True)[1][order], left[order]
    codes = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(size)])
    held = np.zeros(int(codes.max()) + 1, np.uint8)
    out = []
    for i in np.flatnonzero(left):
        # sizes between which a pair can be alike, one wider on both sides
        lo, hi = np.searchsorted(size, [size[i] * similarity - 1, size[i] / similarity + 1])
        if (label[lo:hi] == label[i]).all():
            continue
        own = codes[starts[i] : starts[i + 1]]
        held[own] = 1
        shared = np.add.reduceat(held[codes[starts[lo] : starts[hi]]], starts[lo:hi] - starts[lo], dtype=np.int64)
        held[own] = 0
        for j in lo + np.flatnonzero(shared / (size[i] + size[lo:hi] - shared) >= similarity):
            if label[j] != label[i]:
                out.append((int(order[i]), int(order[j])))
                label[label == label[j]] = label[i]
    return out


def _exact(split: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join the classes in groups of the large buckets ``split`` as all alike pairs in them would.

    A group's nodes outside its largest class lie in blocks 0 to n_out - 1, the others in the blocks
    after; each two blocks, one of them with nodes outside, are compared in a task of their own.
    """
    least = split.groupBy("band").agg(F.min("k").alias("b"))
    joined = components(split.join(least, "band").select(F.col("k").alias("a"), "b")).withColumnRenamed("root", "g")
    nodes = split.select("k", "root").distinct().join(joined, "k", "left").withColumn("g", F.coalesce("g", "k"))
    nodes = stored(nodes.join(sets.hint("merge"), "k").select("g", "k", "root", "set", F.length("set").alias("bytes")), "undecided")
    by_class = nodes.groupBy("g", "root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    blocks = lambda c: F.ceil(c / BLOCK_BYTES).cast("int")
    top = F.max(F.struct("n", "root", "bytes"))
    sized = by_class.groupBy("g").agg(top.alias("t"), F.sum("bytes").alias("all")).select(
        "g", F.col("t.root").alias("top"), blocks(F.col("all") - F.col("t.bytes")).alias("n_out"), blocks(F.col("t.bytes")).alias("n_top")).where("n_out > 0")
    out, number = F.col("root") != F.col("top"), F.xxhash64("k")
    block = F.when(out, F.pmod(number, F.col("n_out"))).otherwise(F.col("n_out") + F.pmod(number, F.col("n_top"))).cast("int")
    met = F.sequence(F.lit(0), F.when(out, F.col("n_out") + F.col("n_top")).otherwise(F.col("n_out")) - 1)
    placed = nodes.join(sized, "g").select("g", "k", "root", "set", out.alias("outside"), block.alias("own"), F.explode(met).alias("other"))
    tasks = placed.select("g", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "k", "root", "set", (F.col("outside") & (F.col("own") <= F.col("other"))).alias("first"))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        own = [np.frombuffer(x, "<u4") for x in part["set"]]
        found = links_between(own, part["root"].to_numpy(), part["first"].to_numpy(), similarity)
        k = part["k"].to_numpy()
        return pd.DataFrame([sorted((int(k[i]), int(k[j]))) for i, j in found], columns=["a", "b"], dtype="int64")

    return tasks.groupBy("g", "x", "y").applyInPandas(compare, "a long, b long")


@F.pandas_udf(T.DoubleType())
def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaccard of two sorted sets of 32-bit hashes."""

    def one(x: bytes, y: bytes) -> float:
        p, q = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
        both = np.sort(np.concatenate([p, q]), kind="stable")
        shared = int((both[1:] == both[:-1]).sum())
        return shared / max(1, len(both) - shared)

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


def _pairs(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a < b) whose shingle sets are alike enough; each set is joined on its id."""
    left = pairs.distinct().join(sets.select(F.col("k").alias("a"), F.col("set").alias("sa")).hint("merge"), "a")
    both = left.join(sets.select(F.col("k").alias("b"), F.col("set").alias("sb")).hint("merge"), "b")
    return both.where(jaccard("sa", "sb") >= similarity).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(k, root) of every node of ``edges`` (a, b); the root is the smallest id of its component.

    Large stars and small stars in turn: in each, a node hands its neighbours its smallest one. Each
    round is written to the shared folder; it ends when a round changes nothing.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    state = mark(now)
    while state["n"]:
        every = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = every.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = every.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("u", "v", "m")
        step = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        now = stored(step, "edges")
        last, state = state, mark(now)
        if state == last:
            break
    return now.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("root"))


def _pivots(members: DataFrame, seeds: range) -> DataFrame:
    """(band, p): pivots of each bucket as (k, root), the nodes first in seeded orders, by combinable minima."""
    firsts = [F.min(F.struct(F.xxhash64("k", F.lit(i)).alias("h"), "k", "root")) for i in seeds]
    picks = [F.struct(x["k"].alias("k"), x["root"].alias("root")) for x in firsts]
    return members.groupBy("band").agg(F.array_distinct(F.array(*picks)).alias("p")).select("band", F.explode("p").alias("p"))


def _inside(met: DataFrame) -> DataFrame:
    """All pairs (a, b) of two classes in the buckets (band, k, root, n) of up to ALL_PAIRS nodes."""
    few = met.where(F.col("n") <= ALL_PAIRS).groupBy("band").agg(F.array_sort(F.collect_list(F.struct("k", "root"))).alias("l"))
    others = lambda x, i: F.filter("l", lambda y, j: (j > i) & (y["root"] != x["root"]))
    i_j = F.flatten(F.transform("l", lambda x, i: F.transform(others(x, i), lambda y: F.struct(x["k"].alias("a"), y["k"].alias("b")))))
    return few.select(F.inline(i_j)).distinct()


def _meet(members: DataFrame, pivots: DataFrame) -> DataFrame:
    """Pairs (a, b) of each member with the pivots of its bucket that are in other classes."""
    return members.join(pivots, "band").where(F.col("root") != F.col("p.root")).select(*_pairs(F.col("k"), F.col("p.k")))


def _to_classes(split: DataFrame) -> DataFrame:
    """Pairs (a, b) of the nodes outside the largest class of a bucket with CLOSING pivots of that class and PIVOTS of the others."""
    outside = split.where("root <> top").select("band", "k", "root")
    inside = _pivots(split.where("root = top"), range(PIVOTS, PIVOTS + CLOSING))
    every = _pivots(outside, range(PIVOTS + CLOSING, PIVOTS + CLOSING + PIVOTS))
    return _meet(outside, inside.unionByName(every))


def _split(placed: DataFrame) -> DataFrame:
    """The rows of ``placed`` (band, k, root) in buckets that hold several classes, and ``top``, the largest class."""
    by_class = placed.groupBy("band", "root").agg(F.count("*").alias("n"))
    top = by_class.groupBy("band").agg(F.max(F.struct("n", "root"))["root"].alias("top"), F.count("*").alias("n")).where("n > 1").select("band", "top")
    return stored(placed.join(top, "band").select("band", "k", "root", "top"), "split_buckets")


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (k, root) after further ``links`` (a, b), whose classes become one; the root stays the smallest id."""
    links = stored(links, "links")
    if links.isEmpty():
        return roots
    a, b = roots.select(F.col("k").alias("a"), F.col("root").alias("ra")), roots.select(F.col("k").alias("b"), F.col("root").alias("rb"))
    up = components(links.join(a, "a").join(b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    new = roots.join(up.select(F.col("k").alias("root"), F.col("root").alias("up")), "root", "left")
    return stored(new.select("k", F.coalesce("up", "root").alias("root")), "roots")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(key, class_id) for every row of ``docs``; the class id is the smallest id of the class.

    Equal texts are one class, also empty ones (null text is empty). Ids name
    documents: rows of one id with different texts are classed by each text. Rows with a null id are classed by equal text only: the class of that text, null if no
    row with an id has it. Texts without words are alike only if equal. An empty table gives none.
    """
    return _classed(docs, key, text, similarity).select(key, "class_id")


def _classed(docs: DataFrame, key: str, text: str, similarity: float) -> DataFrame:
    """``classes`` with the hash of the text as ``t``."""
    short_batches(docs.sparkSession)
    sketch = stored(_sketch(docs, key, text), "sketch")
    texts = sketch.groupBy("t").agg(F.min("k").alias("k"))  # a text's node is its smallest id
    nodes = sketch.where("keys IS NOT NULL").join(texts.where("k IS NOT NULL"), ["t", "k"])
    banded = nodes.select("k", F.explode("keys").alias("band")).distinct()
    size = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    met = stored(banded.join(size, "band"), "buckets")
    sets = stored(sketch.where("set IS NOT NULL").select("k", "set").join(met.select("k").distinct().hint("merge"), "k", "left_semi"), "sets")

    alone = met.withColumn("root", F.col("k"))
    large = alone.where(F.col("n") > ALL_PAIRS).select("band", "k", "root")
    edges = stored(verified(_inside(alone).unionByName(_meet(large, _pivots(large, range(PIVOTS)))), sets, similarity), "links")
    roots = stored(met.select("k").distinct().join(components(edges), "k", "left").select("k", F.coalesce("root", "k").alias("root")), "roots")

    split = _split(large.drop("root").join(roots, "k"))
    if not split.isEmpty():
        roots = _joined(roots, verified(_to_classes(split), sets, similarity))
        split = _split(large.drop("root").join(roots, "k"))
    if not split.isEmpty():
        roots = _joined(roots, _exact(split, sets, similarity))

    of_text = texts.join(roots, "k", "left").select("t", F.coalesce("root", "k").alias("class_id"))
    return sketch.select("t", F.col("k").alias(key)).join(of_text, "t")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` per class, that of the smallest id, with all columns; of repeated rows one.

    If the rows of an id have different texts, each text stays or goes by its own class, so an id that
    names a class may stay with several. Texts that have no equal under a smaller id are compared
    under their id, so those of one id go together if one of them is a near copy of an earlier
    document. A row with a null id stays if no row with an id has its text, once per text.
    """
    found = _classed(docs, key, text, similarity).where(F.col(key) == F.col("class_id")).select(F.col(key).cast("bigint").alias("_id"), F.col("t").alias("_hash"))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(key).cast("bigint").alias("_id"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("_hash"))
    if docs.groupBy(F.col(key)).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        kept = rows.join(found.select("_id").distinct(), "_id", "left_semi")
    else:
        kept = rows.join(found.distinct(), ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"])
    held = rows.where("_id IS NULL")
    if not held.isEmpty():
        known = rows.where("_id IS NOT NULL").select("_hash").distinct()
        kept = kept.select("_row").unionByName(held.dropDuplicates(["_hash"]).join(known, "_hash", "left_anti").select("_row"))
    return kept.select("_row.*")
