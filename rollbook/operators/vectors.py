"""Nearest vectors of many requests: a join of packed blocks (DOC-10, DOC-11).

Requests and points are packed, where they lie, into matrices of ``BLOCK_BYTES``, one row each. Every
request block meets every point block once: matrix products of ``SCORES`` scores at most, filters as
masks, the best k of the pair merged into those of the request block. Only they are shuffled for the
last ranking.

Requests of up to ``BROADCAST_BYTES`` (measured) go to every task, and the points are read once, where
they are. More requests are paired partition by partition, without a shuffle; the packed points are
written first then, since every partition of requests reads them again. Nothing reaches the driver but
that size, and neither side has a limit.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F

from ..functions.ranking import top_per_group
from ..session import staged

# Workers get the batch functions by value and need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_BYTES = 1 << 20
BROADCAST_BYTES = 8 << 20
#: Scores equal to so many decimals are ties, which go by point id.
DECIMALS = 9
#: Scores that a task holds at once, unless one request has more points in a block.
SCORES = 1 << 20
#: Request blocks whose best rows a task holds at once.
HELD_BLOCKS = 64

REQUEST = "block long, q_ids array<long>, q_vectors binary, q_docs array<array<string>>, q_schemes array<string>"
POINT = "p_ids array<long>, p_vectors binary, p_docs array<string>, p_schemes array<string>"


def unit_rows(vectors: pa.Array) -> np.ndarray:
    """The vectors as rows of length one; a zero vector stays zero."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and sizes.min() != sizes.max():
        raise ValueError("vectors of different lengths")
    m = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def packer(ids: str, docs: str, numbered: bool) -> Callable:
    """Rows (id, vector, documents, scheme) as blocks; request blocks get a number."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for b in batches:
            if not b.num_rows:
                continue
            m = unit_rows(b.column("vector"))
            step = max(1, BLOCK_BYTES // (8 * max(m.shape[1], 1)))
            for lo in range(0, len(m), step):
                part = b.slice(lo, step)
                listed = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(c)) for c in (ids, docs, "scheme_id")]
                columns = [listed[0], pa.array([m[lo : lo + step].tobytes()], pa.binary()), *listed[1:]]
                if numbered:
                    columns.insert(0, pa.array([block], pa.int64()))
                    block += 1
                yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])

    return pack


def masked(scores: np.ndarray, q_docs: list, q_schemes: list, p_docs: list, p_schemes: list) -> np.ndarray:
    """Scores with those outside a request's documents or scheme at minus infinity."""
    if any(s is not None for s in q_schemes):
        codes, _ = pd.factorize(np.array([*q_schemes, *p_schemes], object))  # null is -1
        q, p = codes[: len(q_schemes)], codes[len(q_schemes) :]
        scores[(q[:, None] != p[None, :]) & (q >= 0)[:, None]] = -np.inf
    limited = [i for i, docs in enumerate(q_docs) if docs is not None]
    if limited:
        codes, names = pd.factorize(np.array(p_docs, object))
        place = {name: i for i, name in enumerate(names)}
        allowed = np.zeros((len(limited), len(names) + 1), bool)  # the last column is null
        for row, i in enumerate(limited):
            allowed[row, [place[name] for name in q_docs[i] if name in place]] = True
        out = scores[limited]
        out[~allowed[:, codes]] = -np.inf
        scores[limited] = out
    return scores


def first_k(row: np.ndarray, point: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of every row by score, then by point."""
    order = np.lexsort((point, -score, row))
    row, point, score = row[order], point[order], score[order]
    start = np.flatnonzero(np.diff(row, prepend=-1))
    keep = np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row)))) < k
    return row[keep], point[keep], score[keep]


def pair_best(k: int) -> Callable:
    """Pairs of blocks to the best k of every request among the points that the task saw."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for ids, row, point, score in held.values():
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(point), pa.array(score)], ["query_id", "point_id", "score"])
            held.clear()

        for b in batches:
            for i in range(b.num_rows):
                at = lambda c: b.column(c)[i]
                block, q_ids, p_ids = at("block").as_py(), at("q_ids").values.to_numpy(), at("p_ids").values.to_numpy()
                q = np.frombuffer(at("q_vectors").as_buffer()).reshape(len(q_ids), -1)
                p = np.frombuffer(at("p_vectors").as_buffer()).reshape(len(p_ids), -1)
                q_docs, q_schemes, p_docs, p_schemes = (at(c).as_py() for c in ("q_docs", "q_schemes", "p_docs", "p_schemes"))
                step = max(1, SCORES // max(len(p_ids), 1))
                parts = [(np.zeros(0, np.int64), p_ids[:0], np.zeros(0))]
                for lo in range(0, len(q_ids), step):
                    scores = q[lo : lo + step] @ p.T
                    scores = masked(np.round(scores, DECIMALS, out=scores), q_docs[lo : lo + step], q_schemes[lo : lo + step], p_docs, p_schemes)
                    # every score of at least the k-th of its row
                    least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(scores), -np.inf)
                    row, col = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
                    parts.append(first_k(row + lo, p_ids[col], scores[row, col], k))
                found = tuple(map(np.concatenate, zip(*parts)))
                if block in held:
                    found = tuple(np.concatenate(pair) for pair in zip(held[block][1:], found))
                held[block] = (q_ids, *first_k(*found, k))
                if len(held) > HELD_BLOCKS:
                    yield from flushed()
        yield from flushed()

    return best


def vector_search(queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """Exact cosine top k of every request over the points that pass its filters.

    ``queries``: query_id (unique), vector, document_ids (null for all), scheme_id (null for any).
    ``points``: point_id, vector, document_id, scheme_id. Rows without a vector are left out. Returns
    query_id, point_id, score (``DECIMALS`` decimals), rn.
    """
    q = queries.where("vector IS NOT NULL").select(F.col("query_id").cast("bigint").alias("query_id"), "vector", "document_ids", "scheme_id")
    p = points.where("vector IS NOT NULL").select(F.col("point_id").cast("bigint").alias("point_id"), "vector", "document_id", "scheme_id")
    q = staged(q.mapInArrow(packer("query_id", "document_ids", True), REQUEST), "request_blocks")
    p = p.mapInArrow(packer("point_id", "document_id", False), POINT)
    size = q.agg(F.sum(F.octet_length("q_vectors"))).first()[0] or 0
    pairs = p.crossJoin(F.broadcast(q)) if size <= BROADCAST_BYTES else q.crossJoin(staged(p, "point_blocks"))
    near = pairs.mapInArrow(pair_best(k), "query_id long, point_id long, score double")
    return top_per_group(near, ["query_id"], [F.desc("score"), F.asc("point_id")], k, ["point_id"])
