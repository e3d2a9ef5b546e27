"""Classification of a question log (QRY)."""

from __future__ import annotations

import sys
from difflib import get_close_matches

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.ranking import top_per_group
from ..functions.text import computed_once, contains_join
from .concepts import words
from .policy_text import EDGE

# Workers get the word repair by value and need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Intent words, cut-off and word lists of the question patterns.
INTENT_WORDS = [
    "scheme", "schemes", "citizen", "citizens", "beneficiary", "beneficiaries", "eligibility", "eligible", "fraud", "duplicate", "anomaly",
    "policy", "manual", "document", "documents", "count", "list", "total", "average", "explain", "details",
]
CUTOFF = 0.84
FRAUD_WORDS = ["fraud", "duplicate", "ghost", "anomaly", "flag", "corruption", "suspicious"]
SCHEME_WORDS = ["scheme", "schemes", "cheme", "schme", "shceme"]
ALL_WORDS = ["all", "list all", "all schemes", "all scheme", "every scheme", "complete list"]
AGE_WORDS = ["age", "years", "year old", "yrs"]
GREETINGS = ["hello", "hi", "hey", "hola", "greetings", "howdy", "hi there", "hello there", "hey there", "good morning", "good afternoon", "good evening", "namaste", "namaskar"]
AGENT_WORDS = [
    "eligible", "eligibility", "criteria", "rule", "rules", "policy", "manual", "explain", "why", "how", "document", "pdf", "list", "show", "find", "count",
    "how many", "who are", "who is", "search", "lookup", "total", "sum", "average", "avg", "scheme", "schemes", "cheme", "schme", "shceme", "chemes", "schmes", "shcemes",
]
COMMON_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may",
    "might", "shall", "can", "need", "dare", "ought", "get", "give", "show", "find", "fetch", "tell", "me", "my", "your", "his", "her", "its", "our", "their",
    "this", "that", "these", "those", "what", "who", "whom", "which", "where", "when", "why", "how", "about", "from", "with", "for", "on", "in", "at", "by", "of",
    "to", "and", "or", "but", "not", "no", "yes", "please", "want", "know", "each", "every", "all", "any", "some", "many", "few", "more", "most", "citizen",
    "beneficiary", "details", "detail", "info", "information", "record", "records", "profile", "data", "check", "fraud", "scheme", "query", "search", "lookup",
]
TRAILING_NOISE = ["having", "have", "has", "fraud", "flagged", "suspicious", "case", "details", "info", "information", "record", "records", "citizen", "beneficiary", "data", "profile", "check", "scheme", "schemes"]
STOP_NAMES = ["her", "him", "them", "it", "this", "that", "these", "those"]
QUERY_VERBS = ["get", "give", "show", "find", "fetch", "tell", "list", "want", "know", "explain", "about", "detail", "details", "i", "describe"]
QUOTED = r"""["']([^"']{2,80})["']"""
CAPITALS = rf"(?:^|{EDGE})([A-Z][a-zA-Z]{{2,30}}(?:\s+[A-Z][a-zA-Z]{{1,30}}){{1,2}})(?:{EDGE}|$)"
NAME_PHRASES = [
    r"(?i)does\s+([a-zA-Z.\- ]{2,80}?)\s+comes?\s+under",
    r"(?i)is\s+([a-zA-Z.\- ]{2,80}?)\s+(?:a|an)?\s*(?:fraud|flagged|suspicious)",
    r"(?i)details\s+about\s+([a-zA-Z.\- ]{2,80})",
    r"(?i)about\s+([a-zA-Z.\- ]{2,80})",
    r"(?i)(?:info|information|profile|record)\s+(?:on|for|of)\s+([a-zA-Z.\- ]{2,80})",
    r"(?i)(?:get|give|show|fetch)\s+(?:me\s+)?(?:details?|info|data)\s+(?:on|for|of)\s+([a-zA-Z.\- ]{2,80})",
    rf"(?i)^([a-zA-Z.\- ]{{4,80}}?)\s+(?:citizen|beneficiary|details?|info|record|profile)(?:{EDGE}|$)",
]
# Words that name a scheme, checked in this order.
FRIENDLY_SCHEMES = [
    ("swasthya|sathi|swastha|swasth", "S767"), ("lokkhir|lokhir|lakhinar|lakshmir|bhandar|lakhir", "S051"), ("banglar|bari", "S769"),
    ("chaa|cha|sundari", "S760"), ("mission|vatsalya|vatsala", "C529"), ("amar|fasal|gola", "S589"), ("post|matric|scholarship", "C501"),
]
AGE_PATTERNS = [
    r"(?:above|over)\s+age\s+(\d{1,3})", r"(?:above|over)\s+(\d{1,3})\s*(?:years?|yrs?)?", r"(?:older\s+than)\s+(\d{1,3})\s*(?:years?|yrs?)?",
    r"age\s*>=\s*(\d{1,3})", r">=\s*(\d{1,3})\s*(?:years?|yrs?)?", r"at\s+least\s+(\d{1,3})\s*(?:years?|yrs?)?",
]
SCHEME_ID = rf"(?:^|{EDGE})([A-Z]\d{{3,5}})(?:{EDGE}|$)"
UID = rf"(?:^|{EDGE})(\d{{10,16}})(?:{EDGE}|$)"
PIECES = r"[A-Za-z]+|\d+|[^A-Za-z\d\s]+|\s+"


def has_any(c: Column, parts: list[str]) -> Column:
    return c.rlike("|".join(parts))


def fix_word(low: str) -> str | None:
    """The intent word a token most likely stands for, if any."""
    hit = get_close_matches(low, INTENT_WORDS, n=1, cutoff=CUTOFF)
    return hit[0] if hit else None


@F.pandas_udf(T.StringType())
def _fixes(tokens: pd.Series) -> pd.Series:
    return tokens.map(fix_word)


def normalise_questions(df: DataFrame) -> DataFrame:
    """Questions with misspelled intent words repaired; the case of a token is kept.

    Every distinct word is compared once; the repairs are joined back to the tokens.
    """
    pieces = df.select("question_id", F.posexplode(F.regexp_extract_all("question", F.lit(PIECES), F.lit(0))).alias("pos", "piece"))
    low = F.lower("piece")
    odd = F.col("piece").rlike("^[A-Za-z]+$") & (F.length("piece") >= 4) & ~low.isin(INTENT_WORDS)
    distinct = pieces.where(odd).select(low.alias("low")).distinct()
    fixes = distinct.withColumn("fixed", _fixes(F.col("low"))).where("fixed IS NOT NULL")
    rows = pieces.withColumn("low", F.when(odd, low)).join(fixes, "low", "left")
    first = F.substring("piece", 1, 1)
    cased = F.when(F.col("piece") == F.upper("piece"), F.upper("fixed")).when(first == F.upper(first), F.initcap("fixed")).otherwise(F.col("fixed"))
    rows = rows.select("question_id", "pos", F.coalesce(cased, "piece").alias("piece"))
    # the pieces of one question only
    joined = rows.groupBy("question_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "").alias("normalized")
    )
    return df.join(joined, "question_id", "left").withColumn("normalized", F.coalesce("normalized", "question"))


def question_intents(df: DataFrame, col: str = "question") -> DataFrame:
    q = F.lower(col)
    greeting = F.btrim(F.trim(F.lower(F.trim(F.col(col)))), F.lit("?.!,"))
    return df.select(
        "*", has_any(q, FRAUD_WORDS).alias("is_fraud"), (has_any(q, SCHEME_WORDS) & has_any(q, ALL_WORDS)).alias("is_all_schemes"),
        has_any(q, AGE_WORDS).alias("is_age"), greeting.isin(GREETINGS).alias("is_greeting"), has_any(q, AGENT_WORDS).alias("is_agent"),
    )


def _candidate_words(raw: Column) -> Column:
    text = F.btrim(F.regexp_replace(raw, r"\s+", " "), F.lit(" ?.,"))
    return F.filter(F.split(text, " "), lambda p: p != "")


def _without_noise(parts: Column) -> Column:
    """The words from the first to the last one that is no noise."""
    noise = F.transform(parts, lambda p: F.array_contains(words(TRAILING_NOISE), F.lower(p)))
    first = F.array_position(noise, F.lit(False)).cast("int")
    last = F.size(noise) - F.array_position(F.reverse(noise), F.lit(False)).cast("int") + 1
    return F.when(first > 0, F.array_join(F.slice(parts, F.greatest(first, F.lit(1)), F.greatest(last - first + 1, F.lit(0))), " ")).otherwise("")


def _valid(name: Column) -> Column:
    parts = F.split(F.lower(name), " ")
    return (name != "") & ~F.forall(parts, lambda p: F.array_contains(words(COMMON_WORDS), p)) & ~F.get(parts, F.lit(0)).isin(QUERY_VERBS)


def question_names(df: DataFrame, col: str = "question") -> DataFrame:
    """Adds ``person_name``: quoted, capital words, phrases, then a pair of uncommon words."""
    rows = df.withColumn("_q", F.trim(F.col(col)))
    patterns = [CAPITALS, *NAME_PHRASES]
    rows = computed_once(rows, {f"_g{i}": F.regexp_extract("_q", p, 1) for i, p in enumerate(patterns)})
    # words of each candidate, then the first and last one that is no noise
    parts = {f"_w{i}": _candidate_words(F.col(f"_g{i}")) for i in range(len(patterns))}
    rows = computed_once(rows, parts)
    rows = computed_once(rows, {f"_c{i}": _without_noise(F.col(f"_w{i}")) for i in range(len(patterns))})
    uncommon = F.filter(F.regexp_extract_all("_q", F.lit("[a-zA-Z]+"), F.lit(0)), lambda w: (F.length(w) >= 3) & ~F.array_contains(words(COMMON_WORDS), F.lower(w)))
    rows = computed_once(rows, {"_pair": F.array_join(F.slice(uncommon, 1, 2), " "), "_uncommon": F.size(uncommon)})
    picks = [F.when(_valid(F.col("_c0")), F.col("_c0"))]
    for i in range(1, len(patterns)):
        c = F.col(f"_c{i}")
        picks.append(F.when(_valid(c) & ~F.lower(c).isin(STOP_NAMES) & (F.length(c) >= 4), c))
    picks.append(F.when((F.col("_uncommon") >= 2) & _valid(F.col("_pair")) & (F.length("_pair") >= 4), F.col("_pair")))
    quoted = F.regexp_extract("_q", QUOTED, 1)
    name = F.when(quoted != "", F.nullif(F.trim(quoted), F.lit(""))).otherwise(F.coalesce(*picks))
    helpers = [f"{h}{i}" for h in ("_g", "_w", "_c") for i in range(len(patterns))]
    return computed_once(rows, {"person_name": name}).drop("_q", "_pair", "_uncommon", *helpers)


def question_schemes(df: DataFrame, col: str = "question") -> DataFrame:
    code = F.nullif(F.regexp_extract(F.upper(F.col(col)), SCHEME_ID, 1), F.lit(""))
    plain = F.regexp_replace(F.lower(F.col(col)), r"[^a-z0-9\s]", "")
    named = F.coalesce(*[F.when(plain.rlike(p), s) for p, s in FRIENDLY_SCHEMES])
    return df.withColumn("scheme_id", F.coalesce(code, named))


def question_numbers(df: DataFrame, col: str = "question") -> DataFrame:
    """Adds the age limit of six phrasings and a uid of 10 to 16 digits."""
    q = F.lower(F.col(col))
    ages = [F.nullif(F.regexp_extract(q, p, 1), F.lit("")).try_cast("int") for p in AGE_PATTERNS]
    return df.withColumn("age_limit", F.coalesce(*ages)).withColumn("uid_number", F.nullif(F.regexp_extract(F.col(col), UID, 1), F.lit("")))


def classify(df: DataFrame, col: str = "question") -> DataFrame:
    return question_numbers(question_schemes(question_names(question_intents(df, col), col), col), col)


def route_questions(classified: DataFrame, citizens: DataFrame, limit: int = 5) -> DataFrame:
    """Route of every question with the citizens a lookup finds.

    ``citizens``: uid, name, uid_number. A uid that is not found falls to the name, a name without
    match to suggestions by its words, and a name without those to the agent.
    """
    q = classified.select("question_id", "is_greeting", "is_all_schemes", "is_agent", "uid_number", "person_name")
    direct = ~F.col("is_greeting") & ~F.col("is_all_schemes") & ~F.col("is_agent")
    by_uid = q.where(direct & F.col("uid_number").isNotNull()).join(citizens.select("uid_number", "uid"), "uid_number").groupBy("question_id").agg(F.min("uid").alias("uid_hit"))
    named = q.where(direct & F.col("person_name").isNotNull())
    hits = contains_join(citizens, "name", named, "person_name")
    people = citizens.select("uid", "name").join(hits, "name")
    # citizens per wanted name once, then per question
    found = top_per_group(people, ["person_name"], [F.asc("uid")], limit, ["uid"]).groupBy("person_name").agg(
        F.count("*").alias("name_hits"), F.array_join(F.array_sort(F.collect_list("uid")), ",").alias("name_uids"))
    tokens = named.select("person_name", F.explode(F.filter(F.split("person_name", r"\s+"), lambda t: F.length(t) >= 2)).alias("token")).distinct()
    suggested = contains_join(citizens, "name", tokens, "token").join(tokens, "token").select("person_name").distinct().withColumn("has_suggestion", F.lit(True))
    out = q.join(by_uid, "question_id", "left").join(found, "person_name", "left").join(suggested, "person_name", "left")
    route = (
        F.when(F.col("is_greeting"), "GREETING").when(F.col("is_all_schemes"), "ALL_SCHEMES").when(F.col("is_agent"), "AGENT")
        .when(F.col("uid_hit").isNotNull(), "UID_LOOKUP").when(F.col("name_hits") > 0, "NAME_LOOKUP").when(F.col("has_suggestion"), "NAME_SUGGESTIONS").otherwise("AGENT")
    )
    return out.withColumn("route", route).select(
        "question_id", "route", "person_name", "uid_number",
        F.when(route == "UID_LOOKUP", F.col("uid_hit")).when(route == "NAME_LOOKUP", F.col("name_uids")).alias("found_uids"),
    )
