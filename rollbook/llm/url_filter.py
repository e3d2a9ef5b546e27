"""URL filter: listed rules, and gradient-boosted trees on lexical features for all other URLs.

A rule is a host and a path, as one text. It fits its host and all subdomains if the URL's path
starts with the rule's; of several the longest text wins, then the smaller one. URLs that a rule
judges are the labelled ones: they train the trees, which judge the rest.

Features are counted in the JVM (lengths, depths, digit ratio, signs, parameters), the entropy of the
bytes and the trees in Arrow batches. Suffix statistics are smoothed shares of blocked URLs by top
domain, registered domain, first path part and file suffix. Values are hashed into ``BUCKETS``, so the
statistics of all labelled rows are one table of fixed size, whatever the number of hosts; two values
in one bucket share their share. A training row reads the statistics of the other folds only.

The trees are fitted on the driver to the features of at most about ``SAMPLE_URLS`` distinct labelled
URLs, drawn by hash, each weighted by its rows: a bound on numbers, not on texts, since only features
are gathered. Statistics and scoring cover every row, and equal URLs are one weighted row before
anything is shuffled, so a frequent URL or host makes no large group.

A null URL, or one without ``://``, has an empty host and path, fits no rule and is judged by its
features. Rows are returned as often as they occur. Without labelled rows, or with one label only, the
trees are empty and the prior decides (none: allow). An empty table gives no rows. A URL is read whole,
in time in proportion to its length. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import byte_runs, stored

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SUFFIXES = ("top_domain", "registered_domain", "first_part", "file_suffix")
BUCKETS, FOLDS, PRIOR_ROWS = 4096, 5, 8.0
SAMPLE_URLS = 20_000
TREES, DEPTH, BINS, RATE, RIDGE = 60, 4, 32, 0.15, 4.0
SLICE_BYTES = 4 << 20


def host_path(url: Column) -> tuple[Column, Column]:
    """Lower-case host after the first ``://`` and the path behind it; both empty where there is none."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, its verdict), null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), r[0]), reverse=True):
        name, slash, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def count_of(c: Column, signs: str) -> Column:
    """How many of these characters ``c`` holds."""
    return (F.length(c) - F.length(F.translate(c, signs, ""))).cast("double")


def lexical(url: Column, host: Column, path: Column) -> Column:
    """Counted features, as an array of doubles."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    n = F.length(url).cast("double")
    digits = "0123456789"
    counts = [
        n, F.length(host), F.length(path), F.length(query), F.size(F.split(host, r"\.")), F.size(F.filter(F.split(path, "/"), lambda p: p != "")),
        F.size(F.filter(F.split(query, "&"), lambda p: p != "")), count_of(url, digits) / F.greatest(n, F.lit(1.0)), count_of(host, digits), count_of(path, digits),
        count_of(host, "-"), count_of(url, "%"), count_of(url, "@_~=+,;"), count_of(path, "."), (F.instr(url, "#") > 0).cast("double"), url.startswith("https:").cast("double"),
        F.length(F.regexp_extract(path, r"([^/]*)/?$", 1)),
    ]
    return F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in counts])


def suffix_buckets(host: Column, path: Column) -> Column:
    """One bucket for each of ``SUFFIXES``."""
    values = [F.substring_index(host, ".", -1), F.substring_index(host, ".", -2), F.regexp_extract(path, r"^/([^/]*)", 1), F.regexp_extract(path, r"(\.[^./]*)/?$", 1)]
    return F.array(*[F.pmod(F.xxhash64(F.lit(k), v), F.lit(BUCKETS)).cast("int") for k, v in zip(SUFFIXES, values)])


def described(urls: DataFrame) -> DataFrame:
    """``urls`` with host, path, rule, ruled, and the columns the model reads: _url, _counts, _buckets."""
    url = F.coalesce("url", F.lit(""))
    host, path = host_path(url)
    out = urls.withColumns({"_url": url, "host": host, "path": path})
    rule, ruled = fitting_rule(F.col("host"), F.col("path"))
    return out.withColumns({"rule": rule, "ruled": ruled, "_counts": lexical(F.col("_url"), F.col("host"), F.col("path")), "_buckets": suffix_buckets(F.col("host"), F.col("path"))})


def entropies(urls: pa.Array) -> np.ndarray:
    """Bits per byte of each URL, slice by slice."""
    raw = urls.cast(pa.binary())
    sizes = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros(len(sizes))
    for lo, hi in byte_runs(sizes + 256, SLICE_BYTES):
        flat = np.frombuffer(b"".join(raw.slice(lo, hi - lo).to_pylist()), np.uint8)
        of = np.repeat(np.arange(hi - lo), sizes[lo:hi])
        counts = np.bincount(of * 256 + flat, minlength=(hi - lo) * 256).reshape(-1, 256)
        share = counts / np.maximum(sizes[lo:hi], 1)[:, None]
        out[lo:hi] = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    return out


class Statistics:
    """Blocked and all labelled rows by (kind, fold, bucket)."""

    def __init__(self, table: np.ndarray):
        self.table = table
        all_rows = table[0].sum(axis=(0, 1))
        self.prior = (all_rows[0] + 0.5) / (all_rows[1] + 1) if all_rows[1] else 0.0

    def columns(self, buckets: np.ndarray, without: np.ndarray | None = None) -> list[np.ndarray]:
        """Smoothed share and log rows for every kind; ``without`` names a fold to leave out per row."""
        out = []
        for k in range(len(SUFFIXES)):
            blocked, rows = self.table[k].sum(axis=0)[buckets[:, k]].T
            if without is not None:
                own = self.table[k][without, buckets[:, k]]
                blocked, rows = blocked - own[:, 0], rows - own[:, 1]
            out += [(blocked + PRIOR_ROWS * self.prior) / (rows + PRIOR_ROWS), np.log1p(rows)]
        return out


class Trees:
    """Boosted trees of one depth for the log odds of a block, over binned features."""

    def __init__(self, start: float):
        self.start, self.edges, self.trees = start, None, []

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Trees:
        """``y`` is the blocked share of a row, ``w`` its weight."""
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        bins, odds = self._bins(x), np.full(len(x), self.start)
        width, n = BINS + 1, x.shape[1]
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-odds))
            grad, hess = w * (y - p), w * p * (1 - p) + 1e-12
            node, feature, cut = np.zeros(len(x), np.int64), np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, width)
            for level in range(DEPTH):
                first, nodes = 2**level - 1, 2**level
                best = np.zeros(nodes)
                for f in range(n):
                    at = node * width + bins[:, f]
                    g = np.cumsum(np.bincount(at, grad, nodes * width).reshape(nodes, width), axis=1)
                    h = np.cumsum(np.bincount(at, hess, nodes * width).reshape(nodes, width), axis=1)
                    whole_g, whole_h = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + RIDGE) + (whole_g - g) ** 2 / (whole_h - h + RIDGE) - whole_g**2 / (whole_h + RIDGE)
                    top = gain.argmax(axis=1)
                    better = gain[np.arange(nodes), top] > best + 1e-9
                    best = np.where(better, gain[np.arange(nodes), top], best)
                    feature[first : first + nodes][better], cut[first : first + nodes][better] = f, top[better]
                node = 2 * node + (bins[np.arange(len(x)), feature[first + node]] > cut[first + node])
            value = RATE * np.bincount(node, grad, 2**DEPTH) / (np.bincount(node, hess, 2**DEPTH) + RIDGE)
            self.trees.append((feature, cut, value))
            odds += value[node]
        return self

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of a block."""
        odds = np.full(len(x), self.start)
        if self.trees:
            bins, row = self._bins(x), np.arange(len(x))
            for feature, cut, value in self.trees:
                node = np.zeros(len(x), np.int64)
                for level in range(DEPTH):
                    at = 2**level - 1 + node
                    node = 2 * node + (bins[row, feature[at]] > cut[at])
                odds += value[node]
        return 1 / (1 + np.exp(-odds))


class Model:
    def __init__(self, statistics: Statistics, trees: Trees):
        self.statistics, self.trees = statistics, trees

    def score(self, counts: np.ndarray, entropy: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        return self.trees.score(np.column_stack([counts, entropy, *self.statistics.columns(buckets)]))


def train(labelled: DataFrame, sample_urls: int = SAMPLE_URLS) -> Model:
    """A model from rows (url, label); the label is ``BLOCK`` or another text."""
    same = labelled.where(F.col("label").isNotNull()).groupBy("url").agg(F.count("*").alias("rows"), F.count(F.when(F.col("label") == BLOCK, 1)).alias("blocked"))
    urls = stored(described(same).select("_url", "_counts", "_buckets", "rows", "blocked", F.pmod(F.xxhash64("_url"), F.lit(1 << 20)).alias("draw")), "labelled_urls")
    fold = (F.col("draw") % FOLDS).cast("int").alias("fold")
    kinds = urls.select(F.posexplode("_buckets").alias("kind", "bucket"), fold, "blocked", "rows").groupBy("kind", "fold", "bucket").agg(F.sum("blocked").alias("blocked"), F.sum("rows").alias("rows"))
    # at most len(SUFFIXES) * FOLDS * BUCKETS rows
    table = np.zeros((len(SUFFIXES), FOLDS, BUCKETS, 2))
    for r in kinds.toLocalIterator():
        table[r.kind, r.fold, r.bucket] = r.blocked, r.rows
    statistics = Statistics(table)
    total = urls.count()
    odds = math.log(statistics.prior / (1 - statistics.prior)) if total else -math.inf
    trees = Trees(max(odds, -20.0))
    if 0 < table[0, :, :, 0].sum() < table[0, :, :, 1].sum():
        drawn = urls.where(F.col("draw") * total < F.lit((1 << 20) * sample_urls)).select("_counts", "_buckets", fold, "blocked", "rows", "draw", "_url")
        data = drawn.mapInArrow(_with_entropy, "row array<double>").toArrow()["row"].combine_chunks()
        x = data.flatten().to_numpy().reshape(len(data), -1)
        x = x[np.lexsort(x.T)]
        n = x.shape[1] - len(SUFFIXES) - 3
        buckets, without, blocked, rows = x[:, n:-3].astype(np.int64), x[:, -3].astype(np.int64), x[:, -2], x[:, -1]
        weight = rows * (len(x) / rows.sum())
        trees.fit(np.column_stack([x[:, :n], *statistics.columns(buckets, without)]), blocked / rows, weight)
    return Model(statistics, trees)


def _with_entropy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The numbers of a training row: counts, entropy, buckets, fold, blocked, rows."""
    for b in batches:
        x = np.column_stack([matrix(b.column("_counts")), entropies(b.column("_url")), matrix(b.column("_buckets")), *[b.column(c).to_numpy(zero_copy_only=False) for c in ("fold", "blocked", "rows")]])
        offsets = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(x.astype(float).ravel()))], ["row"])


def matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 1)


def judge(urls: DataFrame, model: Model) -> DataFrame:
    """(all columns of ``urls``, host, path, rule, verdict, score): the rule's verdict, else the trees'; columns of these names are replaced."""
    own = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict", "score", "ruled")]
    rows = described(urls.select(*[F.col(f"`{c}`") for c in own]))

    @F.pandas_udf("double")
    def score(url, counts, buckets):
        import pandas as pd

        return pd.Series(model.score(np.stack(counts.to_numpy()), entropies(pa.array(url, pa.string())), np.stack(buckets.to_numpy()).astype(np.int64)))

    rows = rows.withColumn("score", score("_url", "_counts", "_buckets"))
    verdict = F.coalesce("ruled", F.when(F.col("score") >= 0.5, F.lit(BLOCK)).otherwise(F.lit(ALLOW)))
    return rows.select(*[F.col(f"`{c}`") for c in own], "host", "path", "rule", verdict.alias("verdict"), "score")


def rule_labels(urls: DataFrame) -> DataFrame:
    """(url, label) of the rows that a rule judges."""
    host, path = host_path(F.coalesce("url", F.lit("")))
    rows = urls.select("url", host.alias("host"), path.alias("path"))
    return rows.select("url", fitting_rule(F.col("host"), F.col("path"))[1].alias("label")).where(F.col("label").isNotNull())
