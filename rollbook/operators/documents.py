"""Chunks, windows, vector search, confidence and context of documents (DOC)."""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ranking import top_per_group
from .vectors import vector_search

# Workers get the batch functions by value and need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Sizes of chunks and extraction windows, and element types kept whole.
MAX_CHARS, OVERLAP = 1500, 200
STRUCTURAL = ["table", "heading", "code"]
WINDOW_CHUNKS, PART_CHARS = 10, 4000
STRIP = r"^[\s\x0B\x1C-\x1F\x85\p{Z}]+|[\s\x0B\x1C-\x1F\x85\p{Z}]+$"
ELEMENT = "struct<type:string,text:string,page:int>"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, STRIP, "")


def paragraphs(c: Column) -> Column:
    """Paragraphs between blank lines, trimmed, blank ones dropped."""
    return F.filter(F.transform(F.split(c, "\n\n"), strip), lambda p: p != "")


def elements(docs: DataFrame) -> DataFrame:
    """One row per paragraph element of a text."""
    return docs.select("doc_id", F.posexplode(paragraphs(F.col("text"))).alias("pos", "text")).select(
        "doc_id", "pos", F.lit("paragraph").alias("type"), "text", F.lit(1).alias("page")
    )


def line_elements(c: Column) -> Column:
    """Elements of a plain text by line: the first line a heading, lines with a bar tables."""
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")
    kind = lambda x, i: F.when(i == 0, "heading").when(F.contains(x, F.lit("|")), "table").otherwise("paragraph")
    return F.transform(lines, lambda x, i: F.struct(kind(x, i).alias("type"), x.alias("text"), F.lit(1).alias("page")))


def chunk_elements(texts: list[str], kinds: list[str], pages: list, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple]:
    """Chunks (text, kind, page) of a document's elements, in time linear in its text.

    Text gathers in a buffer until it would pass ``max_chars``; the next buffer starts with the
    last ``overlap`` characters. Structural elements stand alone and end the buffer without
    overlap. A longer element is cut every ``max_chars - overlap`` characters. The running lengths
    tell where a buffer is full, so each chunk is one search and one slice of the elements.
    """
    step, n = max_chars - overlap, len(texts)
    sizes = np.fromiter(map(len, texts), np.int64, n)
    ends = np.concatenate([[0], np.cumsum(sizes + 1)])
    alone = np.isin(np.array(kinds, object), STRUCTURAL) if n else np.zeros(0, bool)
    stops = np.append(np.flatnonzero(alone | (sizes > max_chars)), n)
    out, buf, kind, page, i = [], "", None, None, 0

    def flush() -> None:
        if buf:
            out.append((buf.strip(), kind, page))

    while i < n:
        stop = int(stops[np.searchsorted(stops, i)])
        while i < stop:
            # elements up to this one fit behind the buffer
            fit = min(stop, int(np.searchsorted(ends, max_chars + 1 + ends[i] - len(buf), "right")) - 1)
            if fit > i:
                if kind is None:
                    kind, page = kinds[i], pages[i]
                buf = "\n".join([buf, *texts[i:fit]])
                i = fit
            if i < stop:
                flush()
                buf, kind, page = (buf[-overlap:] if overlap else "") + "\n" + texts[i], kinds[i], pages[i]
                i += 1
        if i < n:
            flush()
            text = texts[i]
            if alone[i]:
                out.append((text, kinds[i], pages[i]))
                buf, kind, page = "", None, None
            else:
                cuts = -(-(len(text) - max_chars) // step)
                out += [(text[c * step : c * step + max_chars].strip(), kinds[i], pages[i]) for c in range(cuts)]
                buf, kind, page = "\n" + text[cuts * step :], kinds[i], pages[i]
            i += 1
    if buf.strip():
        out.append((buf.strip(), kind, page))
    return out


def chunks(docs: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Chunk rows of documents with an ``elements`` array (struct of type, text, page)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            els = b.column("els")
            for i in range(b.num_rows):
                found = chunk_elements(*(els[i].values.field(c).to_pylist() for c in ("text", "type", "page")), max_chars, overlap) if els[i].is_valid else []
                if found:
                    text, kind, page = zip(*found)
                    ids = pa.array([i] * len(found), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc_id").take(ids), pa.array(range(len(found)), pa.int32()), pa.array(text, pa.string()), pa.array(kind, pa.string()), pa.array(page, pa.int32())],
                        ["doc_id", "chunk_index", "text", "element_type", "page"])

    clean = F.transform(F.col("elements").cast(f"array<{ELEMENT}>"), lambda e: F.struct(
        F.coalesce(e["type"], F.lit("paragraph")).alias("type"), strip(F.coalesce(e["text"], F.lit(""))).alias("text"), e["page"].alias("page")))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", clean.alias("els")).mapInArrow(run, f"doc_id {id_type}, chunk_index int, text string, element_type string, page int")


def triplet_windows(chunk_rows: DataFrame, first: int | None = None) -> DataFrame:
    """Text windows for triplet extraction: all chunks, in numbered windows of ``WINDOW_CHUNKS``, cut at line ends when long.

    ``first`` keeps so many windows of a document.
    """
    keys = ["doc_id", "window"]
    rows = chunk_rows.withColumn("window", F.floor(F.col("chunk_index") / WINDOW_CHUNKS).cast("int"))
    rows = rows if first is None else rows.where(F.col("window") < first)
    text = rows.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "\n").alias("t")
    )
    empty = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("parts"))

    def add(acc: Column, line: Column) -> Column:
        fits = F.length(acc["cur"]) + F.length(line) < PART_CHARS
        piece = F.concat(line, F.lit("\n"))
        return F.when(fits, F.struct(F.concat(acc["cur"], piece).alias("cur"), acc["parts"].alias("parts"))).otherwise(
            F.struct(piece.alias("cur"), F.concat(acc["parts"], F.array(acc["cur"])).alias("parts"))
        )

    parts = F.aggregate(F.split("t", "\n"), empty, add, lambda acc: F.when(acc["cur"] != "", F.concat(acc["parts"], F.array(acc["cur"]))).otherwise(acc["parts"]))
    long = F.length("t") > PART_CHARS
    rows = text.select(*keys, long.alias("long"), F.when(long, parts).otherwise(F.array("t")).alias("p"))
    return rows.select(*keys, F.when(F.col("long"), 5).otherwise(20).alias("max_triplets"), F.posexplode("p").alias("part", "text"))


# --- vectors -----------------------------------------------------------------------------------


def scoped_search(queries: DataFrame, points: DataFrame, top_k: int) -> DataFrame:
    """Candidates: three times top_k within the scheme; a query without hits searches everything
    and keeps file names that hold the scheme, or all when none does."""
    n = 3 * top_k
    scoped = vector_search(queries, points, n)
    missed = queries.where("scheme_id IS NOT NULL").join(scoped.select("query_id").distinct(), "query_id", "left_anti")
    wide = missed.withColumn("wanted", F.col("scheme_id")).withColumn("scheme_id", F.lit(None).cast("string"))
    found = vector_search(wide, points, n).join(wide.select("query_id", "wanted"), "query_id").join(points.select("point_id", "filename"), "point_id")
    named = found.withColumn("has_name", F.contains(F.upper("filename"), F.upper("wanted")))
    any_named = named.groupBy("query_id").agg(F.bool_or("has_name").alias("any_named"))
    kept = named.join(any_named, "query_id").where(F.col("has_name") | ~F.col("any_named"))
    cols = ["query_id", "point_id", "score", "rn"]
    return scoped.select(*cols, F.lit("SCHEME").alias("scope")).unionByName(
        kept.select(*cols, F.when(F.col("has_name"), "FILENAME").otherwise("ALL").alias("scope"))
    )


def rescore(candidates: DataFrame, n: int) -> DataFrame:
    """Logits scaled to 0.5 to 0.95 over all candidates of a query; equal logits give 0.95."""
    span = candidates.groupBy("query_id").agg(F.min("logit").alias("lo"), F.max("logit").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), 0.5 + (F.col("logit") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 0.45).otherwise(0.95)
    rows = candidates.join(span, "query_id").withColumn("rerank_score", scaled).drop("lo", "hi", "rn")
    return top_per_group(rows, ["query_id"], [F.desc("logit"), F.asc("point_id")], n, ["point_id"])


def line_count(c: Column) -> Column:
    """Lines of a text; a final line end opens no further line."""
    t = F.regexp_replace(c, r"\r\n|\r", "\n")
    return F.when(t == "", 0).otherwise(F.size(F.split(F.regexp_replace(t, r"\n$", ""), "\n")))


def confidence(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """Confidence, citation coverage and weak claims of answers.

    ``answers``: answer_id, answer, graph_used; ``hits``: answer_id, rn, score.
    """
    per = hits.groupBy("answer_id").agg(F.avg(F.when(F.col("rn") <= 5, F.col("score"))).alias("avg_score"), F.count("*").alias("n"))
    rows = answers.join(per, "answer_id", "left")
    has = F.coalesce("n", F.lit(0)) > 0
    raw = (
        F.col("avg_score") * 0.65 + F.least(F.col("n") / 10, F.lit(1.0)) * 0.2 + F.when(F.col("graph_used"), 0.05).otherwise(0.0)
        + F.when(F.length(F.trim("answer")) > 200, 0.1).otherwise(0.0)
    )
    coverage = F.round(F.least(F.col("n") / F.greatest(line_count(F.col("answer")), F.lit(1)), F.lit(1.0)), 4)
    weak = F.array_compact(F.array(
        F.when(F.col("avg_score") < 0.45, "Retrieved evidence is relatively weak for this answer."),
        F.when(F.col("n") < 3, "Answer is supported by a limited number of source chunks."),
    ))
    return rows.select(
        "answer_id", F.when(has, F.least(F.round(raw, 4), F.lit(0.99))).otherwise(0.0).alias("confidence_score"),
        F.when(has, coverage).otherwise(0.0).alias("citation_coverage"), F.col("graph_used").alias("graph_enrichment_used"),
        F.when(has, weak).otherwise(F.array(F.lit("No supporting sources were retrieved."))).alias("weak_claims"),
    )


def context_blocks(hits: DataFrame) -> DataFrame:
    """Context text of a query: its hits in order, each under a source line. At most k hits each."""
    page = F.when(F.coalesce("page", F.lit(0)) != 0, F.concat(F.lit(", page "), F.col("page").cast("string"))).otherwise("")
    block = F.concat(F.lit("[Source "), F.col("rn").cast("string"), F.lit(": "), F.coalesce("filename", F.lit("Unknown Source")), page, F.lit("]\n"), "text")
    rows = hits.select("query_id", "rn", block.alias("block"))
    return rows.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "block"))), lambda x: x["block"]), "\n\n---\n\n").alias("context")
    )


def source_rows(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "rn", "filename", "page", F.round("score", 4).alias("score"), F.substring("text", 1, 300).alias("snippet"))


def citizen_profiles(people: DataFrame) -> DataFrame:
    """Profile text of a citizen for indexing."""
    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("None"))

    def set_or_na(c: str) -> Column:
        return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("N/A"))

    marks = F.array_join(F.array_compact(F.array(F.when(F.col("is_ghost_flag"), "Ghost Detection"), F.when(F.col("is_dup_flag"), "Duplicate Alert"))), ", ")
    risk = F.when(F.coalesce("risk_tier", F.lit("")) != "", F.concat(F.lit("Risk Tier: "), "risk_tier", F.lit(". "))).otherwise("")
    flags = F.when(marks != "", F.concat(F.lit("System Flags: "), marks, F.lit(". "))).otherwise("")
    text = F.concat(
        F.lit("Citizen Profile: "), F.coalesce("fullname", F.lit("Unknown")), F.lit("\nUID: "), shown("uid"),
        F.lit("\nLocation: GP "), shown("lgd_gp_name"), F.lit(", Block "), shown("lgd_block_name"), F.lit(", District "), shown("lgd_district_name"),
        F.lit("\nIdentity Hubs: Mobile "), set_or_na("mobile"), F.lit(", Ration Card "), set_or_na("ration_card_number"), F.lit(", Operator "), set_or_na("entry_by"),
        F.lit("\nDemographics: Gender "), shown("gender"), F.lit(", DOB "), shown("member_dob"), F.lit("\nIntelligence: "), risk, flags,
        F.lit("Summary: This citizen is part of the Unified Social Registry data dump for scheme eligibility audit."),
    )
    return people.select("uid", text.alias("profile_text"))


# --- embedding ---------------------------------------------------------------------------------

DIM, BATCH = 64, 100


def hashed_tokens(texts: list[str], dim: int = DIM) -> list[np.ndarray]:
    """Default embedding: token counts hashed into ``dim`` buckets, length one."""
    out = []
    for text in texts:
        v = np.zeros(dim, dtype=np.float32)
        for token in (text or "").lower().split():
            v[zlib.crc32(token.encode("utf-8")) % dim] += 1.0
        n = float(np.linalg.norm(v))
        out.append(v / n if n else v)
    return out


def embed(texts: DataFrame, col: str, fn: Callable[[list[str]], list] = hashed_tokens, name: str = "vector") -> DataFrame:
    """Adds a vector per text; ``fn`` gets at most 100 texts per call, inside Arrow batches."""
    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        values = s.tolist()
        return pd.Series([v for i in range(0, len(values), BATCH) for v in fn(values[i:i + BATCH])])

    return texts.withColumn(name, run(F.col(col)))


# --- projects and answers ----------------------------------------------------------------------


def project_documents(documents: DataFrame, links: DataFrame, project: str) -> DataFrame:
    mine = links.where(F.col("project_id") == project).select("document_id")
    return documents.join(mine, "document_id").orderBy(F.desc("created_at"), "document_id")


def link_documents(requests: DataFrame, documents: DataFrame, links: DataFrame) -> DataFrame:
    """Links to add: of known documents, not linked yet, once each."""
    return (
        requests.select("project_id", "document_id").distinct().join(documents, "document_id", "left_semi")
        .join(links, ["project_id", "document_id"], "left_anti")
    )


# Characters and their replacement in printed answers.
TYPOGRAPHY = {"–": "-", "—": "--", "‘": "'", "’": "'", "“": '"', "”": '"', "•": "*", "…": "..."}
CITATIONS = [r"(?i)\[Source\s*\d+\]\(#source-\d+\)", r"(?i)【Source\s*\d+】", r"(?i)\[Source\s*\d+\]"]


def clean_answer(c: Column) -> Column:
    """Citation marks removed, mark-up characters escaped, text reduced to Latin-1."""
    out = F.coalesce(c, F.lit(""))
    for pattern in CITATIONS:
        out = F.regexp_replace(out, pattern, "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    for a, b in TYPOGRAPHY.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, r"[^\x{00}-\x{FF}]", "?")
