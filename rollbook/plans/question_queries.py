"""Question log queries (QRY)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import questions as q
from ..sources import tables as t
from .base import query
from .oracle import view

# Questions: every user turn, and one more per conversation from these forms with a number of its own.
FORMS = """CASE conv_id % 16
 WHEN 0 THEN concat('Does Small Gizmo come under fraud in round ', cast(turn AS string), '?') WHEN 1 THEN 'Is "hot gear" flagged?' WHEN 2 THEN concat('Give details about red widget ', cast(turn AS string))
 WHEN 3 THEN concat('check ', cast(100000000000 + conv_id * 3 AS string), ' please') WHEN 4 THEN 'List all schems in the registry' WHEN 5 THEN 'Hello there!'
 WHEN 6 THEN concat('Which citizen above ', cast(50 + conv_id % 40 AS string), ' years are in S767') WHEN 7 THEN 'What is the eligibilty for Swasthya Sathi' WHEN 8 THEN 'large plate citizen details'
 WHEN 9 THEN 'tell me about ring' WHEN 10 THEN 'Explane the POLCY for post matric scholarship' WHEN 11 THEN 'i want to know each detail aboy OLD BOLT' WHEN 12 THEN concat('people at least ', cast(conv_id % 90 AS string), ' yrs in C501')
 WHEN 13 THEN 'Is Nobody Known a suspicious case?' WHEN 14 THEN concat('anvil bolts ', cast(conv_id AS string)) ELSE 'how many benificiary records age >= 75' END"""
view("questions", f"""SELECT conv_id * 1000 + turn AS question_id, text AS question FROM conversations WHERE role = 'user'
 UNION ALL SELECT 1000000000 + conv_id * 1000 + turn, {FORMS} FROM conversations WHERE turn = 0""")


def questions(s):
    c = t.raw(s.spark, s.sf_dir, "conversations")
    own = c.where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.col("text").alias("question"))
    made = c.where("turn = 0").select((F.col("conv_id") * 1000 + F.col("turn") + 1000000000).alias("question_id"), F.expr(FORMS).alias("question"))
    return own.unionByName(made)


@query("qry_1")
def _(s):
    return q.normalise_questions(questions(s)).select("question_id", "normalized")


def _any(x: str, parts: list[str]) -> str:
    return f"regexp_matches({x}, '{'|'.join(parts)}')"


def _in(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


INTENTS = f"""{_any('lower(question)', q.FRAUD_WORDS)} AS is_fraud, {_any('lower(question)', q.SCHEME_WORDS)} AND {_any('lower(question)', q.ALL_WORDS)} AS is_all_schemes, {_any('lower(question)', q.AGE_WORDS)} AS is_age,
 trim(lower(trim(question)), '?.!,') IN ({_in(q.GREETINGS)}) AS is_greeting, {_any('lower(question)', q.AGENT_WORDS)} AS is_agent"""


@query("qry_2", f"SELECT question_id, {INTENTS} FROM questions")
def _(s):
    return q.question_intents(questions(s)).drop("question")


def sql_candidate(x: str) -> str:
    parts = f"list_filter(string_split(trim(regexp_replace({x}, '\\s+', ' ', 'g'), ' ?.,'), ' '), lambda p: p <> '')"
    noise = f"list_transform({parts}, lambda p: lower(p) IN ({_in(q.TRAILING_NOISE)}))"
    first = f"list_position({noise}, false)"
    last = f"(len({parts}) - list_position(list_reverse({noise}), false) + 1)"
    return f"CASE WHEN coalesce({first}, 0) > 0 THEN array_to_string({parts}[{first}:{last}], ' ') ELSE '' END"


def sql_valid(x: str) -> str:
    return f"({x} <> '' AND len(list_filter(string_split(lower({x}), ' '), lambda p: p NOT IN ({_in(q.COMMON_WORDS)}))) > 0 AND split_part(lower({x}), ' ', 1) NOT IN ({_in(q.QUERY_VERBS)}))"


UNCOMMON = f"list_filter(regexp_extract_all(t, '[a-zA-Z]+'), lambda w: len(w) >= 3 AND lower(w) NOT IN ({_in(q.COMMON_WORDS)}))"
NAME_COLS = ", ".join(f"CASE WHEN regexp_extract(t, '{p}', 1) <> '' THEN {sql_candidate(f'''regexp_extract(t, '{p}', 1)''')} END AS p{i}" for i, p in enumerate(q.NAME_PHRASES))
PHRASE_PICKS = ", ".join(f"CASE WHEN {sql_valid(f'p{i}')} AND lower(p{i}) NOT IN ({_in(q.STOP_NAMES)}) AND len(p{i}) >= 4 THEN p{i} END" for i in range(len(q.NAME_PHRASES)))
QUOTED_SQL = q.QUOTED.replace("'", "''")
view("question_names", f"""
SELECT question_id, CASE WHEN regexp_extract(t, '{QUOTED_SQL}', 1) <> '' THEN nullif(trim(regexp_extract(t, '{QUOTED_SQL}', 1)), '')
 ELSE coalesce(CASE WHEN {sql_valid('caps')} THEN caps END, {PHRASE_PICKS}, CASE WHEN {sql_valid('pair')} AND len(pair) >= 4 THEN pair END) END AS person_name FROM (
 SELECT *, CASE WHEN regexp_extract(t, '{q.CAPITALS}', 1) <> '' THEN {sql_candidate(f"regexp_extract(t, '{q.CAPITALS}', 1)")} END AS caps, {NAME_COLS},
  CASE WHEN len({UNCOMMON}) >= 2 THEN array_to_string({UNCOMMON}[1:2], ' ') END AS pair FROM (SELECT question_id, trim(question) AS t FROM questions))""")


@query("qry_3", "SELECT question_id, person_name FROM question_names")
def _(s):
    return q.question_names(questions(s)).drop("question")


PLAIN = "regexp_replace(lower(question), '[^a-z0-9\\s]', '', 'g')"
FRIENDLY = ", ".join(f"CASE WHEN regexp_matches({PLAIN}, '{p}') THEN '{c}' END" for p, c in q.FRIENDLY_SCHEMES)


@query("qry_4", f"SELECT question_id, coalesce(nullif(regexp_extract(upper(question), '{q.SCHEME_ID}', 1), ''), {FRIENDLY}) AS scheme_id FROM questions")
def _(s):
    return q.question_schemes(questions(s)).drop("question")


AGES = ", ".join(f"try_cast(nullif(regexp_extract(lower(question), '{p}', 1), '') AS int)" for p in q.AGE_PATTERNS)


@query("qry_5", f"SELECT question_id, coalesce({AGES}) AS age_limit, nullif(regexp_extract(question, '{q.UID}', 1), '') AS uid_number FROM questions")
def _(s):
    return q.question_numbers(questions(s)).drop("question")


view("routed", f"""
SELECT c.question_id, person_name, uid_number, is_greeting, is_all_schemes, is_agent, uid_hit, name_hits, name_uids, has_suggestion FROM (
 SELECT question_id, {INTENTS}, nullif(regexp_extract(question, '{q.UID}', 1), '') AS uid_number FROM questions) c JOIN question_names USING (question_id)
LEFT JOIN (SELECT substring(uid, 2) AS uid_number, min(uid) AS uid_hit FROM scored GROUP BY 1) USING (uid_number)
LEFT JOIN (SELECT person_name, count(*) AS name_hits, string_agg(uid, ',' ORDER BY uid) AS name_uids FROM (SELECT person_name, uid, row_number() OVER (PARTITION BY person_name ORDER BY uid) AS rn
  FROM (SELECT DISTINCT person_name FROM question_names) JOIN scored ON contains(lower(name), lower(person_name))) WHERE rn <= 5 GROUP BY 1) USING (person_name)
LEFT JOIN (SELECT DISTINCT person_name, true AS has_suggestion FROM (SELECT DISTINCT person_name, unnest(string_split_regex(person_name, '\\s+')) AS token FROM question_names) JOIN (SELECT DISTINCT name FROM scored)
  ON length(token) >= 2 AND contains(lower(name), lower(token))) USING (person_name)""")


@query("qry_6", """
SELECT question_id, route, person_name, uid_number, CASE route WHEN 'UID_LOOKUP' THEN uid_hit WHEN 'NAME_LOOKUP' THEN name_uids END AS found_uids FROM (SELECT *, CASE WHEN is_greeting THEN 'GREETING' WHEN is_all_schemes THEN 'ALL_SCHEMES' WHEN is_agent THEN 'AGENT'
 WHEN uid_hit IS NOT NULL THEN 'UID_LOOKUP' WHEN name_hits > 0 THEN 'NAME_LOOKUP' WHEN has_suggestion THEN 'NAME_SUGGESTIONS' ELSE 'AGENT' END AS route FROM routed)""")
def _(s):
    people = s.scored.select("uid", "name", F.substring("uid", 2, 20).alias("uid_number"))
    return q.route_questions(q.classify(questions(s)), people)


@query("qry_6_normalized")
def _(s):
    # the whole path: repair first, then classify the repaired text
    people = s.scored.select("uid", "name", F.substring("uid", 2, 20).alias("uid_number"))
    return q.route_questions(q.classify(q.normalise_questions(questions(s)), "normalized"), people)
