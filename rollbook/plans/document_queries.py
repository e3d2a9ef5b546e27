"""Document, retrieval and entity graph queries (DOC)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import computed_once
from ..operators import documents as d
from ..operators import entity_graph as eg
from ..operators.vectors import vector_search
from ..sources import tables as t
from .base import query
from .oracle import view

K = 10
BLANKS = "[\\s\\x0B\\x1C-\\x1F\\x85\\p{Z}]+"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '{d.STRIP}', '', 'g')"


# Paragraphs: the given texts have single line ends, so every third line opens a paragraph here.
PARAGRAPH_TEXT = "regexp_replace(text, '\\n([A-Z])', CONCAT)"


def raw_docs(s):
    return t.raw(s.spark, s.sf_dir, "documents")


@query("doc_1", f"""
SELECT doc_id, i - 1 AS pos, 'paragraph' AS type, p[i] AS text, 1 AS page FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '\\n([A-Z])', chr(10) || chr(10) || '\\1', 'g'), chr(10) || chr(10)), lambda x: {sql_strip('x')}), lambda x: x <> '') AS p FROM documents),
 unnest(range(1, len(p) + 1)) AS r(i)""")
def _(s):
    return d.elements(raw_docs(s).select("doc_id", F.regexp_replace("text", r"\n([A-Z])", "\n\n$1").alias("text")))


def doc_elements(s):
    return raw_docs(s).select("doc_id", d.line_elements(F.col("text")).alias("elements"))


@query("doc_1_lines", f"""
SELECT doc_id, i - 1 AS pos, CASE WHEN i = 1 THEN 'heading' WHEN contains(p[i], '|') THEN 'table' ELSE 'paragraph' END AS type, p[i] AS text FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {sql_strip('x')}), lambda x: x <> '') AS p FROM documents),
 unnest(range(1, len(p) + 1)) AS r(i)""")
def _(s):
    return doc_elements(s).select("doc_id", F.posexplode("elements").alias("pos", "e")).select("doc_id", "pos", "e.type", "e.text")


def stored_chunks(s):
    return s._written("chunks", lambda: d.chunks(doc_elements(s)))


def _chunk_sql(size: int, overlap: int) -> str:
    """The buffer rules one element at a time: a row per document and element with the buffer behind it and what it gave out."""
    step, kinds = size - overlap, ", ".join(f"'{k}'" for k in d.STRUCTURAL)
    flush = f"CASE WHEN buf <> '' THEN [{{'text': {sql_strip('buf')}, 'element_type': s.kind}}] ELSE [] END"
    return f"""(
WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {sql_strip('x')}), lambda x: x <> '') AS p FROM documents),
els AS (SELECT *, CASE WHEN kind IN ({kinds}) THEN 0 ELSE greatest(0, cast(ceil((length(text) - {size}) / {step}) AS bigint)) END AS cuts FROM (
 SELECT doc_id, i, p[i] AS text, CASE WHEN i = 1 THEN 'heading' WHEN contains(p[i], '|') THEN 'table' ELSE 'paragraph' END AS kind FROM p, unnest(range(1, len(p) + 1)) AS r(i))),
st AS (
 SELECT doc_id, 0::bigint AS i, '' AS buf, NULL::varchar AS kind, []::STRUCT("text" VARCHAR, element_type VARCHAR)[] AS found FROM p
 UNION ALL
 SELECT s.doc_id, e.i, CASE WHEN e.kind IN ({kinds}) THEN '' WHEN cuts > 0 THEN chr(10) || substr(text, cuts * {step} + 1) WHEN length(buf) + length(text) > {size} AND buf <> '' THEN right(buf, {overlap}) || chr(10) || text ELSE buf || chr(10) || text END,
  CASE WHEN e.kind IN ({kinds}) THEN NULL WHEN cuts > 0 OR (length(buf) + length(text) > {size} AND buf <> '') THEN e.kind ELSE coalesce(s.kind, e.kind) END,
  CASE WHEN e.kind IN ({kinds}) THEN list_concat({flush}, [{{'text': text, 'element_type': e.kind}}])
   WHEN cuts > 0 THEN list_concat({flush}, list_transform(range(0, cuts), lambda c: {{'text': {sql_strip(f'substr(text, c * {step} + 1, {size})')}, 'element_type': e.kind}}))
   WHEN length(buf) + length(text) > {size} AND buf <> '' THEN {flush} ELSE [] END
 FROM st s JOIN els e ON e.doc_id = s.doc_id AND e.i = s.i + 1),
ends AS (SELECT doc_id, i + 1 AS i, [{{'text': {sql_strip('buf')}, 'element_type': kind}}] AS found FROM (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1) WHERE {sql_strip('buf')} <> ''),
got AS (SELECT doc_id, i, found FROM st UNION ALL SELECT * FROM ends)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, n) - 1 AS chunk_index, found[n]."text" AS text, found[n].element_type AS element_type, 1 AS page FROM got, unnest(range(1, len(found) + 1)) AS r(n))"""


view("chunks", _chunk_sql(d.MAX_CHARS, d.OVERLAP))


@query("doc_2", "SELECT doc_id, chunk_index, text, element_type, page FROM chunks")
def _(s):
    return d.chunks(doc_elements(s))


@query("doc_2_small", f"SELECT doc_id, chunk_index, text, element_type, page FROM {_chunk_sql(400, 50)}")
def _(s):
    return d.chunks(doc_elements(s), 400, 50)


# Windows of ten chunks; a long one is cut before the line that would pass the part length.
view("triplet_windows", f"""(
WITH RECURSIVE t AS (SELECT doc_id, chunk_index // {d.WINDOW_CHUNKS} AS win, string_agg(text, chr(10) ORDER BY chunk_index) AS t FROM chunks GROUP BY 1, 2),
l AS (SELECT doc_id, win, string_split(t, chr(10)) AS l FROM t WHERE length(t) > {d.PART_CHARS}),
st AS (
 SELECT doc_id, win, 0::bigint AS i, '' AS cur, NULL::varchar AS done FROM l
 UNION ALL
 SELECT s.doc_id, s.win, s.i + 1, CASE WHEN length(cur) + length(l[s.i + 1]) < {d.PART_CHARS} THEN cur || l[s.i + 1] || chr(10) ELSE l[s.i + 1] || chr(10) END,
  CASE WHEN length(cur) + length(l[s.i + 1]) < {d.PART_CHARS} THEN NULL ELSE cur END
 FROM st s JOIN l USING (doc_id, win) WHERE s.i < len(l)),
parts AS (SELECT doc_id, win, i, done AS text FROM st WHERE done IS NOT NULL
 UNION ALL SELECT doc_id, win, i + 1, cur FROM (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY doc_id, win ORDER BY i DESC) = 1) WHERE cur <> '')
SELECT doc_id, win AS "window", 20 AS max_triplets, 0::bigint AS part, t AS text FROM t WHERE length(t) <= {d.PART_CHARS}
UNION ALL SELECT doc_id, win, 5, row_number() OVER (PARTITION BY doc_id, win ORDER BY i) - 1, text FROM parts)""")


@query("doc_3", 'SELECT doc_id, "window", max_triplets, part, text FROM triplet_windows')
def _(s):
    return d.triplet_windows(stored_chunks(s))


# --- entity graph ------------------------------------------------------------------------------

# Triplets: neighbouring capitalised words of a text.
view("caps", "SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]{2,}') AS w FROM documents")
KIND = "CASE WHEN length(X) % 3 = 0 THEN 'Person' WHEN length(X) % 3 = 1 THEN 'Location' ELSE 'Concept' END"
view("triplets", f"""
SELECT doc_id AS document_id, i - 1 AS pos, w[i] AS source, {KIND.replace('X', 'w[i]')} AS source_type, w[i + 1] AS target, {KIND.replace('X', 'w[i + 1]')} AS target_type, 'NEAR' AS relation, 'position ' || cast(i - 1 AS varchar) AS description
FROM caps, unnest(range(1, len(w))) AS r(i)""")


def triplet_structs(s):
    docs = raw_docs(s).select(F.col("doc_id").alias("document_id"), "text")
    found = computed_once(docs, {"w": F.regexp_extract_all("text", F.lit("[A-Z][a-z]{2,}"), F.lit(0))}).drop("text")
    following = F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0)))
    pairs = F.transform(F.arrays_zip(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))).alias("a"), following.alias("b")),
                        lambda x, i: F.struct(i.alias("pos"), x["a"].alias("source"), x["b"].alias("target")))
    return computed_once(found, {"p": pairs})


def triplets(s):
    def build():
        rows = triplet_structs(s).select("document_id", F.inline("p"))
        kind = lambda c: F.expr(KIND.replace("X", c))
        return rows.select("document_id", "pos", "source", kind("source").alias("source_type"), "target", kind("target").alias("target_type"),
                           F.lit("NEAR").alias("relation"), F.concat(F.lit("position "), F.col("pos").cast("string")).alias("description"))

    return s._written("triplets", build)


def replies(s):
    """Model replies for every document: JSON of its triplets, some fenced, some broken."""
    kind = lambda x: F.when(F.length(x) % 3 == 0, "Person").when(F.length(x) % 3 == 1, "Location").otherwise("Concept")
    entities = F.transform(F.array_distinct("w"), lambda x: F.struct(F.upper(x).alias("entity_name"), kind(x).alias("entity_type")))
    rels = F.transform("p", lambda x: F.struct(
        x["source"].alias("source_entity"), x["target"].alias("target_entity"), F.lit("NEAR").alias("relation"),
        F.concat(F.lit("position "), x["pos"].cast("string")).alias("relationship_description")))
    whole = F.to_json(F.struct(entities.alias("entities"), rels.alias("relationships")))
    body = F.col("body")
    fenced = F.concat(F.lit("Here is the result:\n```json\n"), body, F.lit("\n```\nDone."))
    trailing = F.regexp_replace(body, r"\]\}$", ", ] , }")
    missing = F.regexp_replace(body, r"\},\{", "} {")
    n = F.col("document_id")
    rows = computed_once(triplet_structs(s), {"body": whole})
    return rows.select("document_id", F.when(n % 4 == 0, body).when(n % 4 == 1, fenced).when(n % 4 == 2, trailing).otherwise(missing).alias("reply"))


@query("doc_4", "SELECT document_id, pos, source, source_type, target, target_type, relation, description FROM triplets")
def _(s):
    return eg.parse_triplets(replies(s))


view("entity_docs", "SELECT DISTINCT source AS name, document_id FROM triplets UNION SELECT target, document_id FROM triplets")
view("relations", "SELECT source, relation, target, arg_min(description, (document_id, pos)) AS description, count(DISTINCT document_id) AS document_count FROM triplets GROUP BY 1, 2, 3")


@query("doc_5", f"SELECT name, {KIND.replace('X', 'name')} AS type, count(*) AS document_count FROM entity_docs GROUP BY 1")
def _(s):
    return eg.merge_entities(triplets(s))


@query("doc_5_relations", "SELECT * FROM relations")
def _(s):
    return eg.merge_relations(triplets(s))


REMOVED_LANG = "de"


@query("doc_6", f"""SELECT name, count(*) AS document_count FROM entity_docs WHERE document_id NOT IN (SELECT doc_id FROM documents WHERE lang = '{REMOVED_LANG}') GROUP BY 1""")
def _(s):
    removed = raw_docs(s).where(F.col("lang") == REMOVED_LANG).select(F.col("doc_id").alias("document_id"))
    return eg.purge_documents(eg.entity_documents(triplets(s)), ["name"], removed)


@query("doc_6_relations", f"""SELECT source, relation, target, count(DISTINCT document_id) AS document_count FROM triplets WHERE document_id NOT IN (SELECT doc_id FROM documents WHERE lang = '{REMOVED_LANG}') GROUP BY 1, 2, 3""")
def _(s):
    removed = raw_docs(s).where(F.col("lang") == REMOVED_LANG).select(F.col("doc_id").alias("document_id"))
    return eg.purge_documents(eg.relation_documents(triplets(s)), ["source", "relation", "target"], removed)


view("both_ways", "SELECT source AS s, target AS t, relation, description FROM relations UNION ALL SELECT target, source, relation, description FROM relations")
SEEDS = ["thea", "stone"]
SEED_SQL = "regexp_matches(X, '(?i)thea') OR regexp_matches(X, '(?i)stone')"


def relations(s):
    return s._written("relations", lambda: eg.merge_relations(triplets(s)))


@query("doc_7", f"SELECT s, t, relation, description FROM both_ways WHERE {SEED_SQL.replace('X', 's')} ORDER BY s, t, relation LIMIT 100")
def _(s):
    return eg.subgraph_by_entity(relations(s), SEEDS)


@query("doc_7_documents", """SELECT source, relation, target, description, document_count FROM relations WHERE source IN (SELECT name FROM entity_docs WHERE document_id IN (SELECT doc_id FROM documents WHERE lang = 'es'))
 OR target IN (SELECT name FROM entity_docs WHERE document_id IN (SELECT doc_id FROM documents WHERE lang = 'es')) ORDER BY source, target, relation LIMIT 200""")
def _(s):
    chosen = raw_docs(s).where("lang = 'es'").select(F.col("doc_id").alias("document_id"))
    return eg.subgraph_by_documents(relations(s), eg.entity_documents(triplets(s)), chosen)


def _hops(s_in: str, t_in: str) -> str:
    s_seed, t_seed = SEED_SQL.replace("X", "s"), SEED_SQL.replace("X", "t")
    return f"""
WITH one AS (SELECT DISTINCT s, t, s || ' --(RELATED)--> ' || t || ' (Context: ' || coalesce(description, 'N/A') || ')' AS insight FROM both_ways WHERE ({s_seed}) AND NOT ({t_seed}) AND ({s_in} OR {t_in}) ORDER BY s, t, insight LIMIT 15),
a AS (SELECT DISTINCT s, t AS mid, {s_in} AS seed_in FROM both_ways WHERE {s_seed}), b AS (SELECT DISTINCT s AS mid, t AS far, {t_in} AS far_in FROM both_ways WHERE NOT ({t_seed})),
two AS (SELECT DISTINCT s, mid, far, s || ' is linked to ' || far || ' through ' || mid || ' (Rel: RELATED -> RELATED)' AS insight FROM a JOIN b USING (mid) WHERE (seed_in OR far_in) AND far <> s ORDER BY s, mid, far LIMIT 15)
SELECT insight FROM one UNION SELECT insight FROM two"""


@query("doc_8", _hops("true", "true"))
def _(s):
    return eg.multi_hop(relations(s), SEEDS)


IN_FR = "IN (SELECT name FROM entity_docs WHERE document_id IN (SELECT doc_id FROM documents WHERE lang = 'fr'))"


@query("doc_8_documents", _hops(f"s {IN_FR}", f"t {IN_FR}"))
def _(s):
    chosen = raw_docs(s).where("lang = 'fr'").select(F.col("doc_id").alias("document_id"))
    return eg.multi_hop(relations(s), SEEDS, eg.entity_documents(triplets(s)), chosen)


@query("doc_9", f"""SELECT s || ' --(RELATED)--> ' || t AS fact FROM (SELECT DISTINCT s, t FROM both_ways WHERE s IN (SELECT DISTINCT name FROM entity_docs WHERE {SEED_SQL.replace('X', 'name')}) ORDER BY s, t LIMIT 15)""")
def _(s):
    names = eg.entity_documents(triplets(s)).where(eg.matches("name", SEEDS)).select("name").distinct()
    return eg.one_hop(relations(s), names)


# --- vectors -----------------------------------------------------------------------------------

POINT = {
    "point_id": "vec_id", "document_id": "concat('D', cast(label AS string))",
    "scheme_id": "CASE vec_id % 6 WHEN 0 THEN 'S767' WHEN 1 THEN 'C501' WHEN 2 THEN 'S101' WHEN 3 THEN 'S102' WHEN 5 THEN 'S103' END",
    "filename": "concat('doc_', CASE vec_id % 12 WHEN 4 THEN 'S051' ELSE 'note' END, '_', cast(label AS string), '.pdf')",
}
# Requests: every embedding whose id is divisible by 20 asks for its neighbors.
ASKING = 20
QUERY_SCHEME = "CASE query_id % 100 WHEN 20 THEN 'S767' WHEN 40 THEN 'C501' WHEN 60 THEN 'S051' WHEN 80 THEN 'S999' END"
view("points", "SELECT " + ", ".join(f"{e} AS {n}" for n, e in POINT.items()) + ", embedding::double[] AS vector, label FROM embeddings")
view("queries", f"SELECT *, {QUERY_SCHEME} AS scheme_id, query_id % 3 = 0 AS limited FROM (SELECT point_id AS query_id, vector FROM points WHERE point_id % {ASKING} = 0)")


def points(s):
    e = t.raw(s.spark, s.sf_dir, "embeddings")
    return e.select(*[F.expr(x).alias(n) for n, x in POINT.items()], F.col("embedding").alias("vector"), "label")


def queries(s, scoped: bool):
    """One request per embedding with an id divisible by 20; every third is limited to three documents."""
    asking = points(s).where(F.col("point_id") % ASKING == 0).select(F.col("point_id").alias("query_id"), "vector")
    docs = F.when(F.col("query_id") % 3 == 0, F.array(F.lit("D1"), F.lit("D2"), F.lit("D3")))
    scheme = F.expr(QUERY_SCHEME) if scoped else F.lit(None).cast("string")
    return asking.withColumn("document_ids", docs).withColumn("scheme_id", scheme)


SCORED = """SELECT q.query_id, p.point_id, round(list_cosine_similarity(q.vector, p.vector), 9) AS score, p.filename, p.document_id, q.scheme_id AS wanted, p.scheme_id FROM queries q, points p
 WHERE (NOT q.limited OR p.document_id IN ('D1', 'D2', 'D3'))"""
view("plain_hits", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rn FROM ({SCORED})) WHERE rn <= 30")


def hits(s, k: int = K):
    return vector_search(queries(s, False), points(s), k)


@query("doc_10", "SELECT query_id, point_id, round(score, 6) AS score, rn FROM plain_hits WHERE rn <= 10")
def _(s):
    return hits(s).select("query_id", "point_id", F.round("score", 6).alias("score"), "rn")


view("scoped_hits", f"""
WITH sc AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rn FROM ({SCORED}) WHERE wanted IS NULL OR wanted = scheme_id),
wide AS (SELECT *, contains(upper(filename), wanted) AS named FROM plain_hits WHERE wanted IS NOT NULL AND query_id NOT IN (SELECT query_id FROM sc)),
kept AS (SELECT *, bool_or(named) OVER (PARTITION BY query_id) AS any_named FROM wide)
SELECT query_id, point_id, score, rn, 'SCHEME' AS scope FROM sc WHERE rn <= 30 UNION ALL SELECT query_id, point_id, score, rn, CASE WHEN named THEN 'FILENAME' ELSE 'ALL' END FROM kept WHERE named OR NOT any_named""")


def scoped(s):
    return s._written("scoped_hits", lambda: d.scoped_search(queries(s, True), points(s), K))


@query("doc_11", "SELECT query_id, point_id, round(score, 6) AS score, rn, scope FROM scoped_hits")
def _(s):
    return d.scoped_search(queries(s, True), points(s), K).select("query_id", "point_id", F.round("score", 6).alias("score"), "rn", "scope")


LOGIT = "CASE WHEN query_id = 60 THEN 1.5 ELSE cast(point_id % 17 AS double) - 4 END"


@query("doc_12", f"""
SELECT query_id, point_id, round(rerank_score, 6) AS rerank_score, rn FROM (SELECT query_id, point_id, CASE WHEN hi > lo THEN 0.5 + (logit - lo) / (hi - lo) * 0.45 ELSE 0.95 END::double AS rerank_score,
 row_number() OVER (PARTITION BY query_id ORDER BY logit DESC, point_id) AS rn FROM (SELECT *, min(logit) OVER (PARTITION BY query_id) AS lo, max(logit) OVER (PARTITION BY query_id) AS hi
 FROM (SELECT query_id, point_id, ({LOGIT})::double AS logit FROM scoped_hits))) WHERE rn <= 10""")
def _(s):
    rows = scoped(s).withColumn("logit", F.expr(LOGIT).cast("double"))
    return d.rescore(rows, K).select("query_id", "point_id", F.round("rerank_score", 6).alias("rerank_score"), "rn")


# Answers of the conversations; each is backed by the first hits of one request, if that is there.
N_HITS = "conv_id % 12"


@query("doc_13", f"""
WITH a AS (SELECT conv_id * 1000 + turn AS answer_id, text AS answer, conv_id % 2 = 0 AS graph_used, conv_id FROM conversations WHERE role = 'assistant'),
x AS (SELECT answer_id, round(score, 6) AS score, rn FROM a JOIN plain_hits ON query_id = conv_id % 1000 * 20 AND rn <= {N_HITS}),
per AS (SELECT answer_id, avg(score) FILTER (WHERE rn <= 5) AS s, count(*) AS n FROM x GROUP BY 1)
SELECT answer_id, CASE WHEN n > 0 THEN least(round(s * 0.65::double + least(n / 10, 1.0::double) * 0.2::double + CASE WHEN graph_used THEN 0.05 ELSE 0.0 END::double + CASE WHEN len(trim(answer)) > 200 THEN 0.1 ELSE 0.0 END::double, 4), 0.99::double) ELSE 0.0 END AS confidence_score,
 CASE WHEN n > 0 THEN round(least(n / greatest(CASE WHEN answer = '' THEN 0 ELSE len(string_split(regexp_replace(answer, '\\n$', ''), chr(10))) END, 1), 1.0::double), 4) ELSE 0.0 END AS citation_coverage, graph_used AS graph_enrichment_used,
 CASE WHEN coalesce(n, 0) = 0 THEN 'No supporting sources were retrieved.' ELSE array_to_string(list_filter([CASE WHEN s < 0.45 THEN 'Retrieved evidence is relatively weak for this answer.' END,
  CASE WHEN n < 3 THEN 'Answer is supported by a limited number of source chunks.' END], lambda x: x IS NOT NULL), ',') END AS weak_claims FROM a LEFT JOIN per USING (answer_id)""")
def _(s):
    c = t.raw(s.spark, s.sf_dir, "conversations").where("role = 'assistant'")
    a = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), F.col("text").alias("answer"), (F.col("conv_id") % 2 == 0).alias("graph_used"), "conv_id")
    h = hits(s, 30).select("query_id", "rn", F.round("score", 6).alias("score"))
    backed = a.join(h, (F.col("query_id") == F.col("conv_id") % 1000 * ASKING) & (F.col("rn") <= F.expr(N_HITS))).select("answer_id", "rn", "score")
    return d.confidence(a, backed)


view("hit_text", """SELECT query_id, rn, round(score, 6) AS score, filename, point_id % 4 AS page, coalesce(text, '') AS text FROM plain_hits LEFT JOIN documents ON doc_id = point_id WHERE rn <= 10""")


def hit_text(s):
    text = raw_docs(s).select(F.col("doc_id").alias("point_id"), "text")
    rows = hits(s).join(points(s).select("point_id", "filename"), "point_id").join(text, "point_id", "left")
    return rows.select("query_id", "rn", F.round("score", 6).alias("score"), "filename", (F.col("point_id") % 4).alias("page"), F.coalesce("text", F.lit("")).alias("text"))


@query("doc_14", """SELECT query_id, md5(string_agg('[Source ' || rn || ': ' || filename || CASE WHEN page <> 0 THEN ', page ' || page ELSE '' END || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rn)) AS context_md5 FROM hit_text GROUP BY 1""")
def _(s):
    return d.context_blocks(hit_text(s)).select("query_id", F.md5("context").alias("context_md5"))


@query("doc_14_sources", "SELECT query_id, rn, filename, page, round(score, 4) AS score, text[1:300] AS snippet FROM hit_text")
def _(s):
    return d.source_rows(hit_text(s))


PERSON_TEXT = """'Citizen Profile: ' || coalesce(fullname, 'Unknown') || chr(10) || 'UID: ' || uid || chr(10) || 'Location: GP ' || lgd_gp_name || ', Block ' || lgd_block_name || ', District ' || lgd_district_name || chr(10)
 || 'Identity Hubs: Mobile ' || coalesce(nullif(mobile, ''), 'N/A') || ', Ration Card ' || coalesce(nullif(ration_card_number, ''), 'N/A') || ', Operator ' || coalesce(nullif(entry_by, ''), 'N/A') || chr(10)
 || 'Demographics: Gender ' || coalesce(gender, 'None') || ', DOB ' || coalesce(member_dob, 'None') || chr(10) || 'Intelligence: ' || coalesce('Risk Tier: ' || risk_tier || '. ', '')
 || CASE WHEN is_ghost_flag AND is_dup_flag THEN 'System Flags: Ghost Detection, Duplicate Alert. ' WHEN is_ghost_flag THEN 'System Flags: Ghost Detection. ' WHEN is_dup_flag THEN 'System Flags: Duplicate Alert. ' ELSE '' END
 || 'Summary: This citizen is part of the Unified Social Registry data dump for scheme eligibility audit.'"""


def profile_people(s):
    marks = s.state.select("uid", "risk_tier", "is_ghost_flag", "is_dup_flag")
    return s.persons.where("uid IS NOT NULL").join(marks, "uid", "left")


@query("doc_15", f"SELECT uid, {PERSON_TEXT} AS profile_text FROM person_src p LEFT JOIN (SELECT uid, risk_tier, is_ghost_flag, is_dup_flag FROM flag_state) USING (uid) WHERE uid IS NOT NULL")
def _(s):
    return d.citizen_profiles(profile_people(s))


@query("doc_16")
def _(s):
    vectors = d.embed(raw_docs(s).select("doc_id", "text"), "text")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return vectors.select("doc_id", F.size("vector").alias("dims"), F.round(norm, 3).alias("norm"))


# Projects: seven, a document belongs to one of them by its id; requests also name unknown documents.
view("links", "SELECT 'P' || cast(doc_id % 7 AS varchar) AS project_id, doc_id AS document_id FROM labels WHERE quality = 1")


def links(s):
    return t.raw(s.spark, s.sf_dir, "labels").where("quality = 1").select(F.concat(F.lit("P"), (F.col("doc_id") % 7).cast("string")).alias("project_id"), F.col("doc_id").alias("document_id"))


def project_docs(s):
    return raw_docs(s).select(F.col("doc_id").alias("document_id"), F.col("source"), (F.col("doc_id") * 37 % 1000).alias("created_at"))


@query("doc_17", "SELECT doc_id AS document_id, source, doc_id * 37 % 1000 AS created_at FROM documents WHERE doc_id IN (SELECT document_id FROM links WHERE project_id = 'P3')")
def _(s):
    return d.project_documents(project_docs(s), links(s), "P3")


@query("doc_17_link", """SELECT DISTINCT 'P' || cast((doc_id + toxic) % 7 AS varchar) AS project_id, doc_id + quality * 5 AS document_id FROM labels WHERE doc_id + quality * 5 IN (SELECT doc_id FROM documents)
 AND ('P' || cast((doc_id + toxic) % 7 AS varchar), doc_id + quality * 5) NOT IN (SELECT (project_id, document_id) FROM links)""")
def _(s):
    asked = t.raw(s.spark, s.sf_dir, "labels").select(
        F.concat(F.lit("P"), ((F.col("doc_id") + F.col("toxic")) % 7).cast("string")).alias("project_id"), (F.col("doc_id") + F.col("quality") * 5).alias("document_id"))
    return d.link_documents(asked, project_docs(s), links(s))


CITED = "concat(text, ' [Source ', cast(turn AS string), '](#source-', cast(turn AS string), ') 【source 2】 [SOURCE 3] & <b>“fine”</b> – ok… 中 €')"


def sql_clean(x: str) -> str:
    out = x
    for pattern in d.CITATIONS:
        out = f"regexp_replace({out}, '{pattern}', '', 'g')"
    for a, b in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *d.TYPOGRAPHY.items()]:
        b = b.replace("'", "''")
        out = f"replace({out}, '{a}', '{b}')"
    return f"regexp_replace({out}, '[^\\x{{00}}-\\x{{FF}}]', '?', 'g')"


@query("doc_18", f"SELECT conv_id, turn, {sql_clean(CITED)} AS answer FROM conversations WHERE role = 'assistant'")
def _(s):
    c = t.raw(s.spark, s.sf_dir, "conversations").where("role = 'assistant'")
    return c.select("conv_id", "turn", d.clean_answer(F.expr(CITED)).alias("answer"))
