"""Eligibility queries (ELG)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conditions as c
from ..operators import judging as j
from ..operators import manifests as m
from ..operators import policy_text as p
from ..operators.concepts import BOOLEAN_SIGNALS, CONCEPT_FIELDS, COVER_STOP, FIELD_TYPES, MANUAL_FIELD_TYPES, PHRASE_STOP, map_concept
from . import eligibility_fixture as fx
from .base import num, query
from .oracle import view
from ..sources.tables import SCHEME_NAMES

KNOWN = [code for code, _ in SCHEME_NAMES]

# --- text ----------------------------------------------------------------------------------------


def sql_clean(x: str) -> str:
    return f"trim(regexp_replace({x}, '{p.BLANK}', ' ', 'g'))"


def sql_word(x: str, words: str) -> str:
    return f"regexp_matches({x}, '(?i)(?:^|{p.EDGE})(?:{words})(?:{p.EDGE}|$)')"


def sql_amount(x: str) -> str:
    return f"""(CASE WHEN regexp_replace(lower({x}), '[^0-9.]', '', 'g') <> '' THEN try_cast(regexp_replace(lower({x}), '[^0-9.]', '', 'g') AS double) END
 * CASE WHEN regexp_matches(lower({x}), '\\bcrores?\\b') THEN 10000000.0::double WHEN regexp_matches(lower({x}), '\\blakhs?\\b') THEN 100000.0::double
   WHEN regexp_matches(lower({x}), '\\bthousand\\b') THEN 1000.0::double ELSE 1.0::double END)"""


view("policy_docs", fx.POLICY_SQL)
view("policy_sentences", f"""
SELECT doc_id, text, clean, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?:;]){p.BLANK}', '\\1' || chr(10), 'g'), '\\n+'), lambda x: {sql_clean('x')}), lambda x: x <> '') AS s
FROM (SELECT *, {sql_clean('text')} AS clean FROM policy_docs)""")


@query("elg_1", "SELECT doc_id, i - 1 AS pos, s[i] AS sentence FROM policy_sentences, unnest(range(1, len(s) + 1)) AS r(i)")
def _(s):
    return p.sentence_rows(fx.policy_docs(s))


AMOUNT_TEXT = "CASE WHEN c_custkey % 5 = 0 THEN concat(cast(c_custkey % 7 AS string), '.5 Crore') WHEN c_custkey % 5 = 1 THEN concat('Rs. ', cast(c_custkey AS string), ' thousand') WHEN c_custkey % 5 = 2 THEN '1.2.3' WHEN c_custkey % 5 = 3 THEN 'none' ELSE annual_income END"


@query("elg_2", f"SELECT c_custkey, t AS amount_text, {sql_amount('t')} AS amount FROM (SELECT c_custkey, {AMOUNT_TEXT} AS t FROM person_src)")
def _(s):
    return s.persons.select("c_custkey", F.expr(AMOUNT_TEXT).alias("amount_text")).withColumn("amount", p.parse_amount(F.col("amount_text")))


@query("elg_3", """SELECT doc_id, filename, coalesce(nullif(regexp_extract(upper(filename), '(?:^|[^A-Z0-9])(SS_\\d{2,6}|S\\d{2,6}|C\\d{2,6})(?:[^A-Z0-9]|$)', 1), ''), '') AS candidates FROM policy_docs""")
def _(s):
    return fx.policy_docs(s).select("doc_id", "filename", F.array_join(p.scheme_from_filename(F.col("filename")), ",").alias("candidates"))


KNOWN_SQL = "[" + ", ".join(f"'{k}'" for k in sorted(KNOWN)) + "]"


@query("elg_4", f"""
WITH h AS (SELECT doc_id, upper(clean) AS u, regexp_extract_all(upper(clean), '{p.CODE_IN_TEXT}') AS hits FROM policy_sentences),
k AS (SELECT *, list_filter({KNOWN_SQL}, lambda k: contains(u, k)) AS known FROM h),
code_scores AS (SELECT doc_id, code, min(i) AS i, count(*) FILTER (WHERE kind = 'hit') * 3 + count(*) FILTER (WHERE kind = 'known') AS score FROM (
 SELECT doc_id, 'hit' AS kind, hits[i] AS code, i FROM k, unnest(range(1, len(hits) + 1)) AS r(i)
 UNION ALL SELECT doc_id, 'known', known[i], len(hits) + i FROM k, unnest(range(1, len(known) + 1)) AS r(i)) GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY doc_id) AS n, lead(score) OVER w AS next FROM code_scores WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, i))
SELECT d.doc_id, r.code AS scheme_id, CASE WHEN r.code IS NULL THEN 'LOW' WHEN n = 1 OR score >= next + 2 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence, score,
 coalesce((SELECT string_agg(code, ',' ORDER BY rn) FROM ranked x WHERE x.doc_id = d.doc_id AND x.rn <= 10), '') AS candidates
FROM policy_docs d LEFT JOIN ranked r ON r.doc_id = d.doc_id AND rn = 1""")
def _(s):
    return p.scheme_from_text(fx.policy_docs(s), KNOWN)


AGE_R = f"regexp_extract(clean, '{p.AGE_RANGE}', 1)"


def _age(pattern: str, group: int) -> str:
    return f"try_cast(regexp_extract(clean, '{pattern}', {group}) AS int)"


view("flat", f"""
SELECT doc_id, scheme_id, CASE WHEN {AGE_R} <> '' THEN {_age(p.AGE_RANGE, 1)} ELSE {_age(p.AGE_MIN, 1)} END AS age_min,
 CASE WHEN {AGE_R} <> '' THEN {_age(p.AGE_RANGE, 2)} ELSE {_age(p.AGE_MAX, 1)} END AS age_max,
 list_sort(list_filter([{', '.join(f"CASE WHEN {sql_word('clean', g)} THEN '{g.upper()}' END" for g in p.GENDERS)}], lambda x: x IS NOT NULL)) AS gender_in,
 list_filter([{', '.join(f"CASE WHEN {sql_word('clean', w)} THEN '{v}' END" for w, v in p.MARITAL)}], lambda x: x IS NOT NULL) AS marital_status_in,
 CASE WHEN regexp_extract(clean, '{p.INCOME}', 1) <> '' THEN {sql_amount(f"regexp_extract(clean, '{p.INCOME}', 1)")} END AS income_max,
 {sql_word('clean', p.DISABILITY)} AS requires_disability,
 list_filter(list_sort(list_distinct(regexp_extract_all(upper(clean), '{p.CODE_IN_TEXT}'))), lambda x: x <> coalesce(scheme_id, '')) AS conflict_scheme_ids
FROM policy_sentences JOIN (SELECT doc_id, scheme_id FROM policy_docs) USING (doc_id)""")


def flat(s):
    return p.extract_conditions(fx.policy_docs(s))


LISTS = "array_to_string(gender_in, ',') AS gender_in, array_to_string(marital_status_in, ',') AS marital_status_in, array_to_string(conflict_scheme_ids, ',') AS conflict_scheme_ids"


@query("elg_5", f"SELECT doc_id, scheme_id, age_min, age_max, income_max, requires_disability, {LISTS} FROM flat")
def _(s):
    return flat(s)


def _in(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _case(table: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def _tokens(x: str, stop: list[str], n: int) -> str:
    return f"list_filter(regexp_extract_all(lower(trim({x})), '[a-z0-9]+'), lambda t: t NOT IN ({_in(stop)}))[1:{n}]"


def _has(x: str, part: str) -> str:
    return f"contains(lower(trim({x})), '{part}')"


SIGNAL = f"len(list_intersect(list_filter(regexp_extract_all(lower(trim(X)), '[a-z0-9]+'), lambda t: t NOT IN ({_in(PHRASE_STOP)})), [{_in(BOOLEAN_SIGNALS)}])) > 0"


def sql_concept(x: str, what: str) -> str:
    """CASE giving the field, input_type or mapped part of a concept."""
    low = f"lower(trim({x}))"
    known = _case({k: f for k, (f, _) in CONCEPT_FIELDS.items()}, low)
    signal = SIGNAL.replace("X", x)
    manual = f"""CASE WHEN regexp_matches({low}, '^(has_|is_|exclude_|receives_|covered_|eligible_)') THEN 'boolean'
 WHEN coalesce({_case({**MANUAL_FIELD_TYPES, **FIELD_TYPES}, f"trim({x})")}, 'text') IN ('boolean', 'number') THEN {_case({**MANUAL_FIELD_TYPES, **FIELD_TYPES}, f"trim({x})")} ELSE 'text' END"""
    phrase = f"{_has(x, ' ')} AND len({_tokens(x, PHRASE_STOP, 6)}) > 0"
    stem = f"array_to_string({_tokens(x, PHRASE_STOP, 6)}, '_')"
    values = {
        "field": [known, "'has_west_bengal_residency'", "'receives_medical_allowance'",
                  f"'exclude_families_covered_under_' || coalesce(nullif(array_to_string({_tokens(x, COVER_STOP, 5)}, '_'), ''), 'other_scheme')",
                  "'state_notified_category_eligibility'", "'permanent_residency_status'", f"CASE WHEN {signal} THEN 'has_' ELSE '' END || {stem}", f"trim({x})"],
        "input_type": [_case({k: t for k, (_, t) in CONCEPT_FIELDS.items()}, low), *["'boolean'"] * 5, f"CASE WHEN {signal} THEN 'boolean' ELSE 'text' END", manual],
        "mapped": ["true"] * 7 + ["false"],
    }[what]
    tests = [
        f"{known} IS NOT NULL", f"{_has(x, 'west bengal')} AND ({_has(x, 'resident')} OR {_has(x, 'residency')})", _has(x, "medical allowance"), _has(x, "covered under"),
        f"{_has(x, 'other category')} AND {_has(x, 'state government')}", _has(x, "permanent resident"), phrase,
    ]
    return "(CASE " + " ".join(f"WHEN {t} THEN {v}" for t, v in zip(tests, values)) + f" ELSE {values[-1]} END)"


SPECS = " UNION ALL ".join(
    f"""SELECT doc_id, {i} AS pos, '{req}' AS requirement, list_filter(s, lambda x: {sql_word('x', '|'.join(pats))})[1] AS evidence_quote FROM policy_sentences WHERE {sql_word('clean', '|'.join(pats))} OR len(list_filter(s, lambda x: {sql_word('x', '|'.join(pats))})) > 0"""
    for i, (req, pats, _) in enumerate(p.KEYWORD_SPECS)
)
view("keyword_rows", f"""
SELECT * FROM ({SPECS}) UNION ALL
SELECT doc_id, pos, requirement, requirement FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, {sql_concept('requirement', 'field')} ORDER BY pos) AS rn FROM (
 SELECT doc_id, {len(p.KEYWORD_SPECS)} - 1 + i AS pos, u[i] AS requirement FROM (SELECT doc_id, list_filter(s, lambda x: contains(lower(x), 'covered under')) AS u FROM policy_sentences), unnest(range(1, len(u) + 1)) AS r(i))) WHERE rn = 1""")
view("keyword_concepts", f"SELECT *, {sql_concept('requirement', 'field')} AS suggested_input_field, {sql_concept('requirement', 'input_type')} AS input_type FROM keyword_rows")


def concepts(s):
    return p.keyword_concepts(fx.policy_docs(s))


@query("elg_6", "SELECT * FROM keyword_concepts")
def _(s):
    return concepts(s)


# Characters of a window; every window of a text is a row.
FOCUS, WINDOW = 8000, 18000


@query("elg_7", f"""
WITH parts AS (SELECT doc_id, clean AS t, regexp_extract_all(clean, '{p.CUES}') AS m, string_split_regex(clean, '{p.CUES}') AS g FROM policy_sentences),
spans AS (SELECT doc_id, t, i, sum(len(g[i])) OVER w + coalesce(sum(len(m[i])) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, len(m[i]) AS n
 FROM parts, unnest(range(1, len(m) + 1)) AS r(i) WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
wide AS (SELECT doc_id, t, i, greatest(0, b - 120) AS a, least(len(t), b + n + 620) AS z FROM spans),
marked AS (SELECT *, CASE WHEN a > max(z) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM wide),
islands AS (SELECT doc_id, t, min(a) AS a, max(z) AS z FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM marked) GROUP BY doc_id, t, grp),
pieces AS (SELECT doc_id, a, trim(substring(t, (a + 1)::int, (z - a)::int)) AS piece FROM islands),
joined AS (SELECT doc_id, trim(string_agg(piece, chr(10) || chr(10) ORDER BY a)) AS f FROM pieces WHERE piece <> '' GROUP BY 1),
whole AS (SELECT doc_id, coalesce(f, '') AS f, array_to_string(list_sort(list_distinct(list_transform(m, lambda x: lower(x)))), ',') AS matches FROM parts LEFT JOIN joined USING (doc_id))
SELECT doc_id, k::int AS window_no, md5(substring(f, k * {FOCUS} + 1, {FOCUS})) AS focused_md5, len(substring(f, k * {FOCUS} + 1, {FOCUS})) AS focused_chars, matches
FROM whole, unnest(range(0, greatest(1, (len(f) + {FOCUS} - 1) // {FOCUS}))) AS r(k)""")
def _(s):
    w = p.focus_windows(fx.policy_docs(s), FOCUS)
    return w.select("doc_id", "window_no", F.md5("focused_text").alias("focused_md5"), F.length("focused_text").alias("focused_chars"), "matches")


@query("elg_8", f"""
SELECT doc_id, k::int AS window_no, len(substring(clean, k * {WINDOW} + 1, {WINDOW})) AS window_chars, md5(substring(clean, k * {WINDOW} + 1, {WINDOW})) AS window_md5
FROM (SELECT doc_id, coalesce(clean, '') AS clean FROM policy_sentences), unnest(range(0, greatest(1, (len(clean) + {WINDOW} - 1) // {WINDOW}))) AS r(k)""")
def _(s):
    w = p.text_windows(fx.policy_docs(s), WINDOW)
    return w.select("doc_id", "window_no", F.length("text_window").alias("window_chars"), F.md5("text_window").alias("window_md5"))


# Replies of a model that read the document: plain, fenced, wrapped in words, broken, or no object.
REPLY_BODY = """concat('{"scheme_id": "', coalesce(scheme_id, 'NONE'), '", "age_min": ', cast(doc_id % 90 AS string), '}')"""
FENCE = "concat(chr(96), chr(96), chr(96))"
REPLY = f"""CASE doc_id % 5 WHEN 0 THEN {REPLY_BODY} WHEN 1 THEN concat({FENCE}, 'json', chr(10), {REPLY_BODY}, chr(10), {FENCE})
 WHEN 2 THEN concat('Here it is: ', {REPLY_BODY}, ' as asked.') WHEN 3 THEN concat('{{"scheme_id": ', cast(doc_id AS string)) ELSE '[1, 2]' END"""


@query("elg_9", f"""
WITH r AS (SELECT doc_id AS reply_id, CASE WHEN doc_id % 5 IN (0, 1, 2) THEN {REPLY_BODY} END AS body FROM policy_docs)
SELECT reply_id, body IS NOT NULL AS is_object, json_extract_string(body, '$.scheme_id') AS scheme_id, cast(json_extract_string(body, '$.age_min') AS int) AS age_min FROM r""")
def _(s):
    return p.reply_json(fx.policy_docs(s).select(F.col("doc_id").alias("reply_id"), F.expr(REPLY).alias("reply")))


# --- condition rows ----------------------------------------------------------------------------


def _cond(pos: int, bucket: str, field: str, op: str, kind: str, value: str, values: str, where: str) -> str:
    return f"SELECT doc_id AS rule_id, {pos} AS ord, '{bucket}' AS bucket, '{field}' AS field, '{op}' AS operator, '{kind}' AS kind, {value} AS value, {values} AS vals, '{FIELD_TYPES[field]}' AS value_type FROM flat WHERE {where}"


view("canonical", " UNION ALL ".join([
    _cond(0, "include", "age", ">=", "number", "cast(cast(age_min AS decimal(18,2)) AS varchar)", "[]::varchar[]", "age_min IS NOT NULL"),
    _cond(1, "include", "age", "<=", "number", "cast(cast(age_max AS decimal(18,2)) AS varchar)", "[]::varchar[]", "age_max IS NOT NULL"),
    _cond(2, "include", "gender", "in", "list", "NULL", "gender_in", "len(gender_in) > 0"),
    _cond(3, "include", "marital_status", "in", "list", "NULL", "marital_status_in", "len(marital_status_in) > 0"),
    _cond(4, "include", "annual_income", "<=", "number", "cast(cast(income_max AS decimal(18,2)) AS varchar)", "[]::varchar[]", "income_max IS NOT NULL"),
    _cond(5, "include", "is_disabled", "=", "boolean", "'true'", "[]::varchar[]", "requires_disability"),
    _cond(6, "exclude", "scheme_id", "in", "list", "NULL", "conflict_scheme_ids", "len(conflict_scheme_ids) > 0"),
]))


def canonical(s):
    return c.canonical_conditions(flat(s))


COND_SQL = "rule_id, bucket, field, operator, kind, value, array_to_string(vals, ',') AS \"values\", value_type"
COND = ["rule_id", "bucket", "field", "operator", "kind", "value", "values", "value_type"]


@query("elg_10", f"SELECT {COND_SQL} FROM canonical")
def _(s):
    return canonical(s).select(*COND)


@query("elg_11", f"""
SELECT concept, {sql_concept('concept', 'field')} AS field, {sql_concept('concept', 'input_type')} AS input_type, {sql_concept('concept', 'mapped')} AS mapped FROM (
 SELECT DISTINCT unnest(s) AS concept FROM policy_sentences UNION SELECT unnest([{_in([*CONCEPT_FIELDS, 'is_veteran', 'age', 'crop_type'])}]))""")
def _(s):
    known = s.spark.createDataFrame([(k,) for k in [*CONCEPT_FIELDS, "is_veteran", "age", "crop_type"]], "concept string")
    rows = p.sentence_rows(fx.policy_docs(s)).select(F.col("sentence").alias("concept")).unionByName(known).distinct()
    return rows.withColumn("c", map_concept(F.col("concept"))).select("concept", "c.field", "c.input_type", "c.mapped")


# Conditions as an extraction may deliver them: some with a wrong field, operator, kind or type.
BROKEN = {
    "field": "CASE WHEN rule_id % 7 = 1 AND field = 'age' THEN 'height' WHEN rule_id % 7 = 6 AND field = 'gender' THEN ' ' ELSE field END",
    "operator": "CASE WHEN rule_id % 7 = 2 AND field = 'is_disabled' THEN 'in' WHEN rule_id % 7 = 3 THEN 'is_null' ELSE operator END",
    "kind": "CASE WHEN rule_id % 7 = 4 AND kind = 'number' THEN 'string' ELSE kind END",
    "value_type": "CASE WHEN rule_id % 7 = 5 AND field = 'age' THEN 'text' ELSE value_type END",
}


def broken(s):
    df = canonical(s)
    return df.select(*[F.expr(BROKEN[x]).alias(x) if x in BROKEN else F.col(x) for x in df.columns])


@query("elg_12", """
SELECT rule_id, bucket, field, operator, kind, value_type, CASE WHEN trim(field) = '' THEN 'EMPTY_FIELD' WHEN want IS NULL THEN 'UNSUPPORTED_FIELD' WHEN value_type <> want THEN 'VALUE_TYPE_MISMATCH'
 WHEN NOT ((want = 'text' AND operator IN ('=','!=','in','not_in','is_null','is_not_null')) OR (want IN ('number','date') AND operator IN ('=','!=','>','<','>=','<=','is_null','is_not_null'))
  OR (want = 'boolean' AND operator IN ('=','!=','is_null','is_not_null'))) THEN 'OPERATOR_NOT_ALLOWED'
 WHEN operator IN ('is_null','is_not_null') THEN CASE WHEN kind <> 'null' THEN 'VALUE_NOT_EXPECTED' END
 WHEN operator IN ('in','not_in') THEN CASE WHEN kind <> 'list' OR len(vals) = 0 THEN 'LIST_REQUIRED' END
 WHEN kind <> CASE WHEN want IN ('text','date') THEN 'string' ELSE want END THEN 'VALUE_KIND_MISMATCH' END AS error
FROM (SELECT *, """ + _case(FIELD_TYPES, "field") + """ AS want FROM (SELECT rule_id, bucket, vals, """ + ", ".join(f"{v} AS {k}" for k, v in BROKEN.items()) + """ FROM canonical))""")
def _(s):
    return c.validate_conditions(broken(s)).select("rule_id", "bucket", "field", "operator", "kind", "value_type", "error")


# Exclusions that name a programme instead of a code.
NAMED = "CASE WHEN rule_id % 4 = 1 AND field = 'scheme_id' THEN array_append(VALS, 'State Insurance and Health scheme') ELSE VALS END"


def named(s):
    return canonical(s).withColumn("values", F.expr(NAMED.replace("VALS", "values")))


@query("elg_13", f"""
WITH n AS (SELECT * REPLACE ({NAMED.replace('VALS', 'vals').replace('array_append', 'list_append')} AS vals) FROM canonical),
b AS (SELECT *, field = 'scheme_id' AND len(list_filter(vals, lambda v: NOT regexp_matches(v, '{c.SCHEME_CODE}'))) > 0 AS bad FROM n),
d AS (SELECT *, 'Excluded if covered under ' || vals[1] AS req FROM b WHERE bad)
SELECT rule_id, 'kept' AS outcome, field, NULL AS requirement, NULL AS input_type, NULL AS reason_unmapped FROM b WHERE NOT bad
UNION ALL SELECT rule_id, 'downgraded', {sql_concept('req', 'field')}, req, {sql_concept('req', 'input_type')},
 'Condition used field ''scheme_id'' with non-code value(s) [' || array_to_string(vals, ', ') || '], so it was downgraded to a manual-review condition.' FROM d""")
def _(s):
    kept, down = c.sanitize_conditions(named(s))
    none = F.lit(None).cast("string")
    a = kept.select("rule_id", F.lit("kept").alias("outcome"), "field", none.alias("requirement"), none.alias("input_type"), none.alias("reason_unmapped"))
    return a.unionByName(down.select("rule_id", F.lit("downgraded").alias("outcome"), F.col("suggested_input_field").alias("field"), "requirement", "input_type", "reason_unmapped"))


# A second extraction that repeats the first one but reads ages up to five years higher.
SECOND = "CASE WHEN field = 'age' AND rule_id % 3 = 0 THEN cast(cast(cast(value AS decimal(18,2)) + 5 AS decimal(18,2)) AS string) ELSE value END"


@query("elg_14", f"""
SELECT {COND_SQL}, min(src) AS source_rank FROM (SELECT *, 1 AS src FROM canonical UNION ALL SELECT * REPLACE ({SECOND} AS value), 2 FROM canonical) GROUP BY ALL""")
def _(s):
    first = canonical(s)
    return c.merge_conditions(first, first.withColumn("value", F.expr(SECOND))).select(*COND, "source_rank")


@query("elg_14_unmapped", "SELECT doc_id AS rule_id, suggested_input_field, requirement, arg_min(input_type, pos) AS input_type FROM keyword_concepts GROUP BY 1, 2, 3")
def _(s):
    rows = concepts(s).withColumnRenamed("doc_id", "rule_id")
    return c.merge_unmapped(rows, rows).select("rule_id", "suggested_input_field", "requirement", "input_type")


def _key(k: str, bucket: str, where: str) -> str:
    return f"SELECT doc_id, '{k}' AS criterion_key, '{bucket}' AS bucket, 'EXECUTABLE' AS status, NULL AS suggested_input_field FROM flat WHERE {where}"


SHORT = "string_split(requirement, '.')[-1]"


@query("elg_15", " UNION ALL ".join([
    _key("age_min", "include", "age_min IS NOT NULL"), _key("age_max", "include", "age_max IS NOT NULL"), _key("gender_in", "include", "len(gender_in) > 0"),
    _key("marital_status_in", "include", "len(marital_status_in) > 0"), _key("income_max", "include", "income_max IS NOT NULL"), _key("requires_disability", "include", "requires_disability"),
    _key("conflict_scheme_ids", "exclude", "len(conflict_scheme_ids) > 0"),
    f"""SELECT doc_id, requirement, 'unknown', CASE WHEN {sql_concept('k', 'mapped')} THEN 'NEEDS_USER_INPUT' ELSE 'UNMAPPED_LOGIC' END, CASE WHEN {sql_concept('k', 'mapped')} THEN {sql_concept('k', 'field')} END
 FROM (SELECT *, {SHORT} AS k FROM keyword_concepts WHERE requirement <> '' AND {SHORT} <> '')
 UNION ALL SELECT doc_id, requirement, 'unknown', 'UNMAPPED_LOGIC', NULL FROM keyword_concepts WHERE {SHORT} = ''"""]))
def _(s):
    return c.detected_criteria(flat(s), concepts(s))


def observations(s):
    return concepts(s).select("doc_id", F.col("suggested_input_field").alias("field_key"), F.col("evidence_quote").alias("quote"))


@query("elg_16", """
SELECT suggested_input_field AS field_key, count(DISTINCT doc_id) AS occurrence_count, min(doc_id) AS first_seen, max(doc_id) AS last_seen,
 arg_max(evidence_quote, (doc_id, evidence_quote)) FILTER (WHERE evidence_quote IS NOT NULL) AS latest_quote, CASE WHEN count(DISTINCT doc_id) >= 3 THEN 'ACTIVE' ELSE 'CANDIDATE' END AS status
FROM keyword_concepts GROUP BY 1""")
def _(s):
    # The first half of the documents is already counted, the second half arrives now.
    seen = observations(s)
    old = c.count_signals(seen.where("doc_id % 2 = 0"))
    return c.learn_signals(old, seen.where("doc_id % 2 = 1")).drop("quoted_in")


@query("elg_17", """
SELECT doc_id, filename, scheme_id, rule_version, rule_version = n AS is_latest FROM (SELECT *, row_number() OVER (PARTITION BY filename, scheme_id ORDER BY doc_id) AS rule_version,
 count(*) OVER (PARTITION BY filename, scheme_id) AS n FROM policy_docs WHERE scheme_id IS NOT NULL)""")
def _(s):
    rows = fx.policy_docs(s).where("scheme_id IS NOT NULL").select("doc_id", "filename", "scheme_id")
    return c.version_rules(rows, ["filename", "scheme_id"], "doc_id", 100)


# --- judging -----------------------------------------------------------------------------------

view("latest_rc", """
SELECT uid, member_status AS rc_member_status, closure_remarks AS rc_closure_remarks FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY modify_ts DESC NULLS LAST, entry_ts DESC NULLS LAST, ration_card_memberid, fullname) AS rn
 FROM person_src WHERE uid IS NOT NULL) WHERE rn = 1""")
view("elig_citizens", """
SELECT *, CASE WHEN upper(trim(coalesce(rc_member_status, ''))) <> '' THEN upper(trim(rc_member_status)) WHEN closing_date IS NOT NULL THEN 'CLOSED' ELSE 'ACTIVE' END AS employment_status,
 nullif(coalesce(tran_count_1, 0) + coalesce(tran_count_2, 0), 0) AS service_duration_months,
 CASE WHEN regexp_matches(upper(remarks), 'RETIRED|TERMINATED') THEN true WHEN regexp_matches(upper(remarks), 'CLOSED|TRANSFER|DEATH|INACTIVE') THEN false END AS retired_or_terminated
FROM (SELECT p.*, r.* EXCLUDE (uid), coalesce(nullif(closure_remarks, ''), rc_closure_remarks, '') AS remarks FROM profile_raw p LEFT JOIN latest_rc r USING (uid))""")
ENRICHED = ["uid", "scheme_id", "scheme_beneficiary_id", "row_no", "employment_status", "rc_member_status"]


@query("elg_18", f"SELECT {', '.join(ENRICHED)}, cast(service_duration_months AS bigint) AS service_duration_months, cast(retired_or_terminated AS varchar) AS retired_or_terminated FROM elig_citizens")
def _(s):
    return fx.citizens(s).select(*ENRICHED, F.col("service_duration_months").cast("bigint").alias("service_duration_months"), "retired_or_terminated")


@query("elg_19", "SELECT p.uid, p.scheme_beneficiary_id, p.row_no, rc_member_status, rc_closure_remarks FROM profile_raw p LEFT JOIN latest_rc r USING (uid)")
def _(s):
    return j.with_latest_rc(s.profile_raw.drop("member_status"), s.persons).select("uid", "scheme_beneficiary_id", "row_no", "rc_member_status", "rc_closure_remarks")


view("elig_rules", "SELECT * FROM (VALUES " + ", ".join(f"('{r['rule_id']}', '{r['rule_name']}', '{r['scheme_id'].strip().upper()}')" for r in fx.RULES) + ") AS v(rule_id, rule_name, target_scheme)")
view("elig_base", "SELECT * FROM elig_citizens JOIN elig_rules ON upper(trim(scheme_id)) = target_scheme")
NEWEST = "latest_transaction_timestamp DESC NULLS LAST, approved_date DESC NULLS LAST, scheme_id, scheme_beneficiary_id, row_no"
view("elig_preferred", f"""
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY rule_id, uid ORDER BY CASE WHEN scheme_id = target_scheme THEN 0 ELSE 1 END, {NEWEST}) AS rn FROM elig_citizens, elig_rules) WHERE rn = 1""")
BASE = ["rule_id", "uid", "scheme_id", "scheme_beneficiary_id", "row_no"]


def scheme_base(s):
    return j.base_scheme_only(fx.rules(s), fx.citizens(s))


def preferred_base(s):
    return j.base_preferred(fx.rules(s), fx.citizens(s))


@query("elg_20", f"SELECT {', '.join(BASE)} FROM elig_base")
def _(s):
    return scheme_base(s).select(*BASE)


@query("elg_20_preferred", f"SELECT {', '.join(BASE)} FROM elig_preferred")
def _(s):
    return preferred_base(s).select(*BASE)


def _bool(x: str) -> str:
    return f"CASE WHEN upper(trim({x})) IN ('YES','Y','TRUE','1') THEN true WHEN upper(trim({x})) IN ('NO','N','FALSE','0') THEN false END"


def _norm(x: str) -> str:
    return f"upper(trim(coalesce({x}, '')))"


def sql_values(base: str, manual: bool) -> str:
    """Typed values of a base, one column per logical field."""
    mine = f"rule_id IN ({_in(fx.MANUAL_RULES)}) AND c_custkey % 9 = 0" if manual else "false"
    return f"""SELECT rule_id, rule_name, target_scheme, uid, scheme_id, scheme_beneficiary_id, row_no, fullname, c_custkey, {mine} AS has_manual, CASE WHEN {mine} THEN {fx.MANUAL['no_other_scholarship']} END AS no_other_scholarship,
 CASE WHEN d IS NOT NULL THEN cast(2024 - year(d) - CASE WHEN 601 < month(d) * 100 + day(d) THEN 1 ELSE 0 END AS double) END AS age, cast(d AS varchar) AS member_dob, {_norm('gender')} AS gender, {_norm('marital_status')} AS marital_status,
 {_norm('caste')} AS caste, {_norm('ration_card_type_code')} AS rc_ration_card_type_code, employment_status, {_norm('scheme_id')} AS scheme_text, cast(service_duration_months AS double) AS service_duration_months,
 {sql_amount(f"CASE WHEN {mine} THEN {fx.MANUAL['annual_income']} ELSE annual_income END")} AS annual_income,
 {_bool("coalesce(nullif(is_disabled, ''), disability_status)")} AS is_disabled, retired_or_terminated, {_bool("cast(is_hof AS varchar)")} AS rc_is_hof
FROM (SELECT *, cast(try_strptime(member_dob, '%Y-%m-%d') AS date) AS d FROM {base})"""


def _lit(x) -> str:
    return "NULL" if x is None else ("true" if x is True else "false" if x is False else f"'{x}'" if isinstance(x, str) else str(x))


def _condition_values() -> str:
    rows = []
    for r in fx.RULES:
        pos = 0
        for bucket in ("include", "exclude"):
            for field, op, value in r.get(bucket, []):
                kind = FIELD_TYPES[field]
                many = [str(v).upper() for v in value] if isinstance(value, list) else []
                n = f"{float(value)}::double" if kind == "number" and value is not None else "NULL::double"
                b = _lit(value) + "::boolean" if isinstance(value, bool) else "NULL::boolean"
                tx = _lit(value if kind == "date" else str(value).upper()) if isinstance(value, str) else "NULL"
                shown = "[" + ", ".join(many) + "]" if many else None if value is None else str(value).lower() if isinstance(value, bool) else f"{value:.2f}" if kind == "number" else (value if kind == "date" else value.upper())
                rows.append(f"('{r['rule_id']}', {pos}, '{bucket}', '{field}', '{op}', '{kind}', {tx}::varchar, {n}, {b}, [{_in(many)}]::varchar[], {_lit(shown)}::varchar)")
                pos += 1
    return ", ".join(rows)


view("elig_conditions", f"SELECT * FROM (VALUES {_condition_values()}) AS v(rule_id, pos, bucket, field, operator, kind, t_want, n_want, b_want, many, shown)")
view("elig_vals", sql_values("elig_base", True))
view("elig_vals_preferred", sql_values("elig_preferred", False))
TEXTS = ["gender", "marital_status", "employment_status", "member_dob", "caste", "rc_ration_card_type_code"]
CMP = "CASE operator WHEN '=' THEN A = B WHEN '!=' THEN A <> B WHEN '>' THEN A > B WHEN '<' THEN A < B WHEN '>=' THEN A >= B WHEN '<=' THEN A <= B END"


def sql_checks(vals: str) -> str:
    text = "CASE field " + " ".join(f"WHEN '{f}' THEN {f}" for f in TEXTS) + " WHEN 'scheme_id' THEN scheme_text END"
    number = "CASE field WHEN 'age' THEN age WHEN 'annual_income' THEN annual_income WHEN 'service_duration_months' THEN service_duration_months END"
    flag = "CASE field WHEN 'is_disabled' THEN is_disabled WHEN 'retired_or_terminated' THEN retired_or_terminated WHEN 'rc_is_hof' THEN rc_is_hof END"
    return f"""SELECT *, CASE WHEN bucket = 'include' THEN hit ELSE NOT hit END AS passed FROM (SELECT *, coalesce(CASE WHEN operator = 'is_null' THEN empty WHEN operator = 'is_not_null' THEN NOT empty WHEN operator = 'in' THEN list_contains(many, t)
  WHEN operator = 'not_in' THEN NOT list_contains(many, t) WHEN kind = 'number' THEN {CMP.replace('A', 'n').replace('B', 'n_want').replace('CnSE', 'CASE').replace('THEn', 'THEN')} WHEN kind = 'boolean' THEN b = b_want ELSE {CMP2} END, false) AS hit,
  operator NOT IN ('is_null', 'is_not_null') AND (empty OR coalesce(trim(t) = '', false)) AS missing FROM (
 SELECT *, t IS NULL AND n IS NULL AND b IS NULL AS empty FROM (SELECT rule_id, uid, row_no, scheme_beneficiary_id, pos, bucket, field, operator, kind, t_want, n_want, b_want, many, shown, {text} AS t, {number} AS n, {flag} AS b FROM {vals} JOIN elig_conditions USING (rule_id))))"""


CMP2 = "CASE operator WHEN '=' THEN t = t_want WHEN '!=' THEN t <> t_want WHEN '>' THEN t > t_want WHEN '<' THEN t < t_want WHEN '>=' THEN t >= t_want WHEN '<=' THEN t <= t_want END"
view("elig_checks", sql_checks("elig_vals"))
view("elig_checks_preferred", sql_checks("elig_vals_preferred"))
CHECK_TEXT = "field || ' ' || " + "CASE WHEN bucket = 'include' THEN operator ELSE " + _case(j.INVERTED, "operator") + " END || ' ' || coalesce(shown, 'null') || ' (actual=' || coalesce(t, cast(cast(n AS decimal(18,2)) AS varchar), cast(b AS varchar), 'null') || ')'"


def sql_decisions(vals: str, checks: str) -> str:
    return f"""
SELECT v.*, c.* EXCLUDE (rule_id, row_no, uid), review, CASE WHEN review THEN 'REVIEW_REQUIRED' WHEN ok AND NOT enrolled THEN 'EXCLUSION_ERROR' WHEN NOT ok AND enrolled THEN 'INCLUSION_ERROR' WHEN ok THEN 'VALID_ENROLLMENT' ELSE 'NOT_APPLICABLE' END AS decision,
 CASE WHEN review THEN 0.0::double ELSE round(least(0.99::double, 0.75::double + CASE WHEN total_checks > 0 THEN passed_checks / total_checks ELSE 0 END * 0.2::double), 4) END AS decision_confidence, NOT review AND ok AS is_eligible, enrolled AS is_enrolled, open_fields
FROM {vals} v JOIN (
 SELECT *, open_fields <> '' OR none OR missing_fields <> '' AS review FROM (SELECT r.rule_id, r.row_no, r.uid, coalesce(passed_checks, 0) AS passed_checks, coalesce(total_checks, 0) AS total_checks, coalesce(missing_fields, '') AS missing_fields, coalesce(ok, true) AS ok,
  coalesce(passed_text, '') AS passed_text, coalesce(failed_text, '') AS failed_text, r.rule_id = 'R7' AS none, r.scheme_text = r.target_scheme AS enrolled,
  CASE WHEN r.rule_id = 'R2' AND {_bool('no_other_scholarship')} IS NULL THEN 'no_other_scholarship' ELSE '' END AS open_fields
 FROM {vals} r LEFT JOIN (SELECT rule_id, uid, row_no, count(*) FILTER (WHERE NOT missing AND passed) AS passed_checks, count(*) FILTER (WHERE NOT missing) AS total_checks, coalesce(string_agg(DISTINCT field, ', ' ORDER BY field) FILTER (WHERE missing), '') AS missing_fields,
   coalesce(bool_and(passed) FILTER (WHERE NOT missing), true) AS ok, string_agg({CHECK_TEXT}, '; ' ORDER BY pos) FILTER (WHERE NOT missing AND passed) AS passed_text, string_agg({CHECK_TEXT}, '; ' ORDER BY pos) FILTER (WHERE NOT missing AND NOT passed) AS failed_text
  FROM {checks} GROUP BY 1, 2, 3) USING (rule_id, uid, row_no))) c ON c.rule_id = v.rule_id AND c.uid = v.uid AND c.row_no = v.row_no"""


view("elig_decisions", sql_decisions("elig_vals", "elig_checks"))
view("elig_decisions_preferred", sql_decisions("elig_vals_preferred", "elig_checks_preferred"))


@query("elg_21", f"""SELECT rule_id, uid, row_no, {', '.join(TEXTS)}, age, annual_income, service_duration_months, is_disabled, retired_or_terminated, rc_is_hof FROM elig_vals""")
def _(s):
    rows = j.resolve_fields(j.with_manual(scheme_base(s), fx.manual(s)), s.as_of)
    member = {"number": "n", "boolean": "b"}
    fields = [*TEXTS, "age", "annual_income", "service_duration_months", "is_disabled", "retired_or_terminated", "rc_is_hof"]
    return rows.select("rule_id", "uid", "row_no", *[F.col("vals")[f][member.get(FIELD_TYPES[f], "t")].alias(f) for f in fields])


def judged(s):
    return s._written("decisions", lambda: j.judge(scheme_base(s), s.as_of, fx.manual(s)).select(
        *j.DECISION, "missing_fields", "open_fields", "conditions", "unmapped", "source"))


@query("elg_22", f"""SELECT rule_id, uid, row_no, pos, {CHECK_TEXT} AS check_text, passed FROM (SELECT *, row_number() OVER (PARTITION BY rule_id, uid, row_no ORDER BY c0.pos) - 1 AS p2 FROM elig_checks c0 WHERE NOT missing)""".replace("row_no, pos,", "row_no, p2 AS pos,"))
def _(s):
    rows = j.evaluate_conditions(j.resolve_fields(j.with_manual(scheme_base(s), fx.manual(s)), s.as_of))
    lines = F.transform("checks", lambda x, i: F.struct(
        i.alias("pos"), F.concat(x["field"], F.lit(" "), x["operator"], F.lit(" "), F.coalesce(x["expected"], F.lit("null")), F.lit(" (actual="), x["actual"], F.lit(")")).alias("check_text"),
        x["passed"].alias("passed")))
    return rows.select("rule_id", "uid", "row_no", F.inline(lines))


@query("elg_23", "SELECT rule_id, uid, row_no, open_fields, missing_fields FROM elig_decisions")
def _(s):
    rows = judged(s).select("rule_id", "uid", "row_no", "open_fields", F.array_join("missing_fields", ", ").alias("missing_fields"))
    return rows


DECIDED = "rule_id, uid, scheme_beneficiary_id, row_no, decision, decision_confidence, is_eligible, is_enrolled, passed_checks, total_checks"


@query("elg_24", f"SELECT {DECIDED} FROM elig_decisions")
def _(s):
    return j.judge(scheme_base(s), s.as_of, fx.manual(s)).select(*DECIDED.split(", "))


@query("elg_24_preferred", f"SELECT {DECIDED} FROM elig_decisions_preferred")
def _(s):
    return j.judge(preferred_base(s), s.as_of).select(*DECIDED.split(", "))


REASON = """CASE WHEN open_fields <> '' THEN 'Document contains unresolved eligibility criteria requiring manual inputs: ' || open_fields || '.'
 WHEN none THEN 'No usable eligibility criteria were extracted from the policy document. Manual rule validation is required.'
 WHEN review THEN 'Required citizen data is missing for executable criteria fields: ' || missing_fields || '. Final inclusion/exclusion decision requires these fields.'
 WHEN decision = 'EXCLUSION_ERROR' THEN 'Citizen is eligible by extracted criteria but not enrolled in target scheme ' || target_scheme || '. ' || CASE WHEN passed_text <> '' THEN 'Passed checks: ' || passed_text || '.' ELSE 'No executable checks were available.' END
 WHEN decision = 'INCLUSION_ERROR' THEN 'Citizen is enrolled in target scheme ' || target_scheme || ' but failed eligibility checks. ' || CASE WHEN failed_text <> '' THEN 'Failed checks: ' || failed_text || '.' ELSE 'No failing check details available.' END
 WHEN decision = 'VALID_ENROLLMENT' THEN 'Citizen is eligible and correctly enrolled in target scheme ' || target_scheme || '.'
 ELSE 'Citizen is not eligible and not enrolled in target scheme ' || target_scheme || '. ' || CASE WHEN failed_text <> '' THEN 'Failed checks: ' || failed_text || '.' ELSE 'No failing check details available.' END END"""


@query("elg_25", f"SELECT rule_id, uid, row_no, {REASON} AS reason FROM elig_decisions")
def _(s):
    return judged(s).select("rule_id", "uid", "row_no", "reason")


@query("elg_25_preferred", f"SELECT rule_id, uid, row_no, {REASON} AS reason FROM elig_decisions_preferred")
def _(s):
    return j.judge(preferred_base(s), s.as_of).select("rule_id", "uid", "row_no", "reason")


BUCKET = _case(j.BUCKETS, "decision")


@query("elg_26", f"SELECT rule_id, decision, {BUCKET} AS bucket, count(*) AS rows FROM elig_decisions GROUP BY 1, 2, 3")
def _(s):
    return j.run_counts(j.judge(scheme_base(s), s.as_of, fx.manual(s)))


@query("elg_26_preview", """SELECT rule_id, uid, scheme_beneficiary_id, decision, decision_confidence, rn FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY uid, scheme_beneficiary_id, row_no) AS rn FROM elig_decisions
 WHERE decision IN ('INCLUSION_ERROR', 'EXCLUSION_ERROR', 'VALID_ENROLLMENT')) WHERE rn <= 25""")
def _(s):
    return j.run_preview(judged(s)).select("rule_id", "uid", "scheme_beneficiary_id", "decision", "decision_confidence", "rn")


@query("elg_27", f"SELECT {DECIDED} FROM elig_decisions WHERE has_manual")
def _(s):
    return j.rejudge(fx.rules(s), fx.citizens(s), fx.manual(s), s.as_of).select(*DECIDED.split(", "))


@query("elg_27_errors", f"""SELECT rule_id, uid, field, value, CASE WHEN field = 'no_other_scholarship' THEN 'NOT_A_BOOLEAN' ELSE 'NOT_A_NUMBER' END AS problem FROM (
 SELECT r.rule_id, uid, 'no_other_scholarship' AS field, {fx.MANUAL['no_other_scholarship']} AS value FROM person_src, (SELECT unnest([{_in(fx.MANUAL_RULES)}]) AS rule_id) r WHERE uid IS NOT NULL AND c_custkey % 9 = 0
 UNION ALL SELECT r.rule_id, uid, 'annual_income', '2 lakh' FROM person_src, (SELECT unnest([{_in(fx.MANUAL_RULES)}]) AS rule_id) r WHERE uid IS NOT NULL AND c_custkey % 9 = 0)
WHERE field = 'annual_income' OR value = 'maybe'""")
def _(s):
    return j.input_errors(fx.manual(s))


@query("elg_28", f"SELECT rule_id, uid, row_no, citizen_name, decision, {BUCKET} AS bucket FROM elig_decisions LEFT JOIN (SELECT uid, min(fullname) AS citizen_name FROM person_src GROUP BY 1) USING (uid) WHERE decision = 'INCLUSION_ERROR'")
def _(s):
    return j.decision_list(judged(s), s.persons, "INCLUSION_ERROR").select("rule_id", "uid", "row_no", "citizen_name", "decision", "bucket")


@query("elg_29", f"""
WITH src AS (SELECT d.rule_id, d.uid, d.row_no, d.open_fields, e.scheme_beneficiary_id, e.gender, e.marital_status, e.caste, e.ration_card_type_code, e.is_hof, e.member_dob, e.employment_status, e.service_duration_months, e.retired_or_terminated, e.scheme_id,
  e.is_disabled, CASE WHEN d.has_manual THEN '2 lakh' ELSE e.annual_income END AS annual_income, d.no_other_scholarship FROM elig_decisions d JOIN elig_base e ON e.rule_id = d.rule_id AND e.uid = d.uid AND e.row_no = d.row_no),
vals AS (SELECT *, CASE field WHEN 'gender' THEN gender WHEN 'marital_status' THEN marital_status WHEN 'caste' THEN caste WHEN 'rc_ration_card_type_code' THEN ration_card_type_code WHEN 'rc_is_hof' THEN cast(is_hof AS varchar) WHEN 'member_dob' THEN member_dob
  WHEN 'employment_status' THEN employment_status WHEN 'service_duration_months' THEN cast(service_duration_months AS varchar) WHEN 'retired_or_terminated' THEN cast(retired_or_terminated AS varchar) WHEN 'scheme_id' THEN scheme_id
  WHEN 'is_disabled' THEN is_disabled WHEN 'annual_income' THEN annual_income WHEN 'no_other_scholarship' THEN no_other_scholarship END AS v FROM src JOIN (SELECT DISTINCT rule_id, field, 'condition' AS origin FROM elig_conditions
  UNION ALL SELECT 'R1', 'eligibility_scope', 'unmapped' UNION ALL SELECT 'R2', 'no_other_scholarship', 'unmapped') f USING (rule_id))
SELECT rule_id, uid, scheme_beneficiary_id, row_no, field, CASE WHEN field = 'eligibility_scope' THEN 'text' WHEN field = 'no_other_scholarship' THEN 'boolean' WHEN regexp_matches(field, '^(has_|is_|exclude_|receives_|covered_|eligible_)') THEN 'boolean'
  WHEN {_case(FIELD_TYPES, 'field')} IN ('boolean', 'number') THEN {_case(FIELD_TYPES, 'field')} ELSE 'text' END AS input_type, CASE WHEN trim(coalesce(v, '')) = '' THEN 'MISSING_IN_DATASET' ELSE 'POLICY_CONCEPT' END AS why
FROM vals WHERE origin = 'unmapped' OR trim(coalesce(v, '')) = ''""")
def _(s):
    return j.manual_requirements(judged(s))


@query("elg_30", """
SELECT rule_id, target_scheme AS scheme_id, rule_name, field AS schema_field, origin, CASE WHEN field = 'age' THEN 'member_dob (computed)' WHEN kind <> 'manual' THEN field END AS db_column, CASE WHEN kind = 'manual' THEN 'MISSING' ELSE 'MAPPED' END AS db_status,
 value_type, note FROM elig_rules JOIN (SELECT rule_id, field, bucket AS origin, kind, kind AS value_type, upper(bucket[1]) || bucket[2:] || ' condition: ' || operator || ' ' || coalesce(shown, 'null') AS note,
  row_number() OVER (PARTITION BY rule_id, field ORDER BY pos) AS rn FROM elig_conditions
 UNION ALL SELECT 'R1', 'eligibility_scope', 'unmapped', 'manual', 'text', 'Unmapped policy criterion requiring manual input.', 1
 UNION ALL SELECT 'R2', 'no_other_scholarship', 'unmapped', 'manual', 'boolean', 'Unmapped policy criterion requiring manual input.', 1) USING (rule_id) WHERE rn = 1
 AND rule_id IN (SELECT target_rule FROM (SELECT rule_id AS target_rule FROM elig_rules WHERE target_scheme IN (SELECT scheme_id FROM profile_raw)))""")
def _(s):
    # Only rules of schemes somebody is enrolled in.
    live = fx.rules(s).join(s.profile_raw.select(F.col("scheme_id").alias("target_scheme")).distinct(), "target_scheme", "left_semi")
    return j.rule_manifest(live)


# --- manifests ---------------------------------------------------------------------------------


def sql_subjects(target: str) -> str:
    return f"""
SELECT pd.*, coalesce(ids, []) AS person_scheme_ids, coalesce(inside, false) AS is_enrolled_in_target, coalesce(target_rows, 0) AS target_rows, family_member_count, male_family_member_count, female_family_member_count,
 family_members_enrolled_in_target, coalesce(family_ids, []) AS family_scheme_ids, t.enrollment_status AS target_enrollment_status, t.total_amount_received AS target_total_amount_received
FROM person_detail pd LEFT JOIN (SELECT ration_card_memberid, list_sort(list_distinct(list(scheme_id))) AS ids, bool_or(scheme_id = '{target}') AS inside, count(*) FILTER (WHERE scheme_id = '{target}') AS target_rows FROM pse GROUP BY 1) x USING (ration_card_memberid)
LEFT JOIN (SELECT ration_card_number, count(DISTINCT ration_card_memberid) AS family_member_count, count(DISTINCT CASE WHEN upper(gender) = 'MALE' THEN ration_card_memberid END) AS male_family_member_count,
  count(DISTINCT CASE WHEN upper(gender) = 'FEMALE' THEN ration_card_memberid END) AS female_family_member_count, count(DISTINCT CASE WHEN scheme_id = '{target}' THEN ration_card_memberid END) AS family_members_enrolled_in_target,
  list_sort(list_distinct(list(scheme_id) FILTER (WHERE scheme_id IS NOT NULL))) AS family_ids FROM person_detail LEFT JOIN pse USING (ration_card_memberid) GROUP BY 1) f USING (ration_card_number)
LEFT JOIN pse t ON t.ration_card_memberid = pd.ration_card_memberid AND t.scheme_id = '{target}'"""


view("subjects_c501", sql_subjects("C501"))
view("subjects_s767", sql_subjects("S767"))
SUBJECT = ["ration_card_memberid", "ration_card_number", "is_enrolled_in_target", "family_member_count", "male_family_member_count", "female_family_member_count", "family_members_enrolled_in_target", "target_enrollment_status"]


def subjects(s, target: str):
    return m.manifest_subjects(s.person_detail, s.enrollments, target)


@query("elg_31", f"""SELECT {', '.join(SUBJECT)}, target_rows AS target_scheme_enrollment_rows, array_to_string(person_scheme_ids, ',') AS person_scheme_ids, array_to_string(family_scheme_ids, ',') AS family_scheme_ids, {num('target_total_amount_received')} FROM subjects_s767""")
def _(s):
    return subjects(s, "S767").select(*SUBJECT, "target_scheme_enrollment_rows", "person_scheme_ids", "family_scheme_ids", "target_total_amount_received")


@query("elg_31_district", f"SELECT {', '.join(SUBJECT)} FROM subjects_c501 WHERE lgd_district_code = 1 AND is_enrolled_in_target")
def _(s):
    return m.manifest_subjects(s.person_detail, s.enrollments, "C501", 1, True).select(*SUBJECT)


CAT = "CASE WHEN regexp_matches(upper(trim(coalesce(caste, ''))), 'DNT|DENOTIFIED') THEN 'DNT' WHEN regexp_matches(upper(trim(coalesce(caste, ''))), 'EBC|ECONOMICALLY BACKWARD') THEN 'EBC' WHEN regexp_matches(upper(trim(coalesce(caste, ''))), 'OBC|O\\.B\\.C|OTHER BACKWARD') THEN 'OBC' END"
view("results_c501", f"""
WITH v AS (SELECT *, CASE WHEN d IS NOT NULL THEN greatest(2024 - year(d) - CASE WHEN 601 < month(d) * 100 + day(d) THEN 1 ELSE 0 END, 0) END AS age, {CAT} AS category,
 upper(trim(coalesce(gender, ''))) = 'MALE' AND male_family_member_count > 2 AS third, len(list_filter(person_scheme_ids, lambda x: x <> 'C501' AND x LIKE 'C%')) > 0 AS other,
 coalesce(ration_card_number, '') <> '' AND coalesce(lgd_district_code, 0) <> 0 AS settled FROM (SELECT *, cast(try_strptime(member_dob, '%Y-%m-%d') AS date) AS d FROM subjects_c501))
SELECT ration_card_memberid, is_enrolled_in_target, 'INC_001' AS condition_id, 1 AS ord, 'derived_mapped' AS mapping_status, cast(age AS varchar) AS value_found, true AS executable, coalesce(age >= 16, false) AS passed FROM v
UNION ALL SELECT ration_card_memberid, is_enrolled_in_target, 'INC_002', 2, 'derived_mapped', category, category IS NOT NULL, CASE WHEN category IS NOT NULL THEN true END FROM v
UNION ALL SELECT ration_card_memberid, is_enrolled_in_target, 'INC_003', 3, 'derived_mapped', 'INDIAN', true, true FROM v
UNION ALL SELECT ration_card_memberid, is_enrolled_in_target, 'INC_004', 4, 'direct_mapped', cast(lgd_district_code AS varchar), true, lgd_district_code <= 4 FROM v
UNION ALL SELECT ration_card_memberid, is_enrolled_in_target, 'EXC_001', 5, 'family_derived', cast(third AS varchar), true, NOT third FROM v
UNION ALL SELECT ration_card_memberid, is_enrolled_in_target, 'EXC_002', 6, 'derived_mapped', cast(other AS varchar), true, NOT other FROM v
UNION ALL SELECT ration_card_memberid, is_enrolled_in_target, 'REN_001', 7, 'derived_mapped', cast(settled AS varchar), true, settled FROM v""")
view("results_s767", """
SELECT ration_card_memberid, is_enrolled_in_target, 'INC_001' AS condition_id, 1 AS ord, CASE WHEN coalesce(gender, '') <> '' THEN 'direct_mapped' ELSE 'unmapped' END AS mapping_status, gender AS value_found, coalesce(gender, '') <> '' AS executable,
 CASE WHEN coalesce(gender, '') <> '' THEN upper(trim(gender)) IN ('FEMALE', 'MALE') END AS passed FROM subjects_s767
UNION ALL SELECT ration_card_memberid, is_enrolled_in_target, 'INC_002', 2, 'unmapped', NULL, false, NULL FROM subjects_s767
UNION ALL SELECT ration_card_memberid, is_enrolled_in_target, 'EXC_001', 3, 'derived_mapped', cast(is_enrolled_in_target AS varchar), true, NOT is_enrolled_in_target FROM subjects_s767""")


def results(s, scheme: str):
    return m.condition_results(subjects(s, scheme), fx.MANIFESTS[scheme], s.as_of).select("ration_card_memberid", F.explode("results").alias("r"))


@query("elg_32", "SELECT ration_card_memberid, condition_id, mapping_status, value_found, executable FROM results_c501 UNION ALL SELECT ration_card_memberid, 'S767:' || condition_id, mapping_status, value_found, executable FROM results_s767")
def _(s):
    a = results(s, "C501").select("ration_card_memberid", "r.condition_id", "r.mapping_status", "r.value_found", "r.executable")
    b = results(s, "S767").select("ration_card_memberid", F.concat(F.lit("S767:"), "r.condition_id").alias("condition_id"), "r.mapping_status", "r.value_found", "r.executable")
    return a.unionByName(b)


@query("elg_33", "SELECT condition_id, coalesce(cast(passed AS varchar), 'open') AS outcome, count(*) AS subjects FROM results_c501 GROUP BY 1, 2")
def _(s):
    r = results(s, "C501")
    return r.groupBy("r.condition_id", F.coalesce(F.col("r.condition_passed").cast("string"), F.lit("open")).alias("outcome")).agg(F.count("*").alias("subjects"))


def sql_verdict(name: str) -> str:
    return f"""SELECT *, CASE WHEN unmapped_ids <> '' THEN 'REVIEW_REQUIRED' WHEN failed_ids = '' AND is_enrolled THEN 'ELIGIBLE_ENROLLED' WHEN failed_ids = '' THEN 'ELIGIBLE_NOT_ENROLLED' WHEN is_enrolled THEN 'NOT_ELIGIBLE_ENROLLED' ELSE 'NOT_ELIGIBLE_NOT_ENROLLED' END AS decision_bucket
FROM (SELECT ration_card_memberid, bool_or(is_enrolled_in_target) AS is_enrolled, coalesce(string_agg(condition_id, ',' ORDER BY ord) FILTER (WHERE executable AND passed), '') AS passed_ids,
 coalesce(string_agg(condition_id, ',' ORDER BY ord) FILTER (WHERE executable AND NOT passed), '') AS failed_ids, coalesce(string_agg(condition_id, ',' ORDER BY ord) FILTER (WHERE NOT executable), '') AS unmapped_ids FROM {name} GROUP BY 1)"""


view("verdict_c501", sql_verdict("results_c501"))
VERDICT = ["ration_card_memberid", "is_enrolled", "passed_ids", "failed_ids", "unmapped_ids", "decision_bucket"]


def verdicts(s, scheme: str):
    return m.manifest_verdict(subjects(s, scheme), fx.MANIFESTS[scheme], s.as_of).withColumnRenamed("is_enrolled_in_target", "is_enrolled")


@query("elg_34", f"SELECT {', '.join(VERDICT)} FROM verdict_c501")
def _(s):
    return verdicts(s, "C501").select(*VERDICT)


@query("elg_34_open", f"SELECT {', '.join(VERDICT)} FROM ({sql_verdict('results_s767')})")
def _(s):
    return verdicts(s, "S767").select(*VERDICT)


@query("elg_35", """
SELECT 'bucket' AS kind, decision_bucket AS key, count(*) AS total FROM verdict_c501 GROUP BY 2 UNION ALL SELECT 'mapping', mapping_status, count(*) FROM results_c501 GROUP BY 2
UNION ALL SELECT 'open_condition', condition_id, count(*) FROM results_c501 WHERE NOT executable GROUP BY 2""")
def _(s):
    return m.manifest_summary(verdicts(s, "C501"))
