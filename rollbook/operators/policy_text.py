"""Policy text to scheme ids, conditions, concepts and text windows (ELG-1 to ELG-9)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import computed_once
from .concepts import map_concept

# White space as the policy parser sees it, Unicode blanks included.
BLANK = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"
EDGE = r"[^\p{L}\p{N}_]"

# Patterns of scheme codes, ages, incomes and cues.
CODE_IN_NAME = r"(?<![A-Z0-9])(SS_\d{2,6}|S\d{2,6}|C\d{2,6})(?![A-Z0-9])"
CODE_IN_TEXT = r"\b(?:S\d{2,6}|SS_\d{2,6}|C\d{2,6})\b"
AGE_RANGE = r"(?i)age\s*(?:between|from)\s*(\d{1,3})\s*(?:to|-|and)\s*(\d{1,3})"
AGE_MIN = r"(?i)(?:minimum\s+age|age\s*(?:at\s*least|>=|above|more\s+than))\s*(\d{1,3})"
AGE_MAX = r"(?i)(?:maximum\s+age|age\s*(?:at\s*most|<=|below|less\s+than))\s*(\d{1,3})"
INCOME = (
    r"(?i)(?:annual\s+income|income).{0,40}(?:below|less\s+than|up\s*to|upto|not\s*exceed(?:ing)?)\s*(?:rs\.?|inr)?\s*"
    r"([0-9][0-9,]*(?:\.\d+)?(?:\s*(?:thousand|lakh|lakhs|crore|crores))?)"
)
DISABILITY = "disability|disabled|pwd|person with disability"
GENDERS = ["female", "male", "transgender"]
MARITAL = [("widow|widows|widowed", "WIDOW"), ("unmarried", "UNMARRIED"), ("married", "MARRIED"), ("divorced", "DIVORCED")]
CUES = (
    r"(?i)\beligibility\b|\beligible\b|\binclusion\b|\binclude\b|\bwho\s+can\s+apply\b|\bnot\s+eligible\b"
    r"|\bexclusion\b|\bexclude\b|\bineligible\b"
)
KEYWORD_SPECS = [
    ("caste_category", [r"caste", r"sc", r"st", r"obc", r"minority"], ["caste"]),
    ("course_level", [r"course level", r"undergraduate", r"postgraduate", r"class\s+(?:xi|xii|11|12)"], ["course_level"]),
    ("course_mode", [r"course mode", r"regular", r"regular course", r"distance", r"correspondence", r"online"], ["study_mode"]),
    ("institution_eligibility", [r"institution", r"recognized institution", r"government institution", r"educational institution"], ["institution_type"]),
    ("no_other_scholarship", [r"no other scholarship", r"not(?:\s+be)?\s+receiving any other scholarship", r"another scholarship"], ["no_other_scholarship"]),
    ("Permanent resident of West Bengal", [r"permanent resident", r"resident of west bengal", r"west bengal resident"], ["has_west_bengal_residency", "permanent_residency_status"]),
    ("Employee of State or Central Government drawing Medical Allowance (unless forfeited)", [r"medical allowance"], ["receives_medical_allowance", "medical_allowance_opt_in"]),
    ("Any other category as may be notified by the State Government from time to time",
     [r"other category(?:" + EDGE + r".*" + EDGE + r"|" + EDGE + r")state government", r"notified by the state government"], ["state_notified_category_eligibility"]),
]


def clean_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, BLANK, " "))


def has_word(c: Column, words: str, low: Column | None = None) -> Column:
    """Whether any of the words (a pattern) stands between non-word characters.

    With ``low``, the lower-case text, a plain substring search for the opening letters of the
    words comes first, so texts without them never reach the regular expression.
    """
    found = c.rlike(rf"(?i)(?:^|{EDGE})(?:{words})(?:{EDGE}|$)")
    if low is None:
        return found
    openings = sorted({re.match("[a-z ]+", w).group().strip() for w in re.split(r"\|(?![^(]*\))", words)})
    return _any_in(low, openings) & found


def _any_in(low: Column, parts: list[str]) -> Column:
    return reduce(Column.__or__, [F.contains(low, F.lit(x)) for x in parts])


def sentences(c: Column) -> Column:
    """Cleaned sentences of a text, blank ones dropped."""
    parts = F.split(c, r"(?<=[\.\!\?\:\;])" + BLANK + r"|\n+")
    return F.filter(F.transform(parts, clean_text), lambda s: s != "")


def sentence_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))


def parse_amount(c: Column) -> Column:
    """Amount of a text with crore, lakh or thousand; null when no number is left."""
    t = F.lower(F.trim(c))
    factor = (
        F.when(t.rlike(r"\bcrores?\b"), 10_000_000.0).when(t.rlike(r"\blakhs?\b"), 100_000.0).when(t.rlike(r"\bthousand\b"), 1_000.0).otherwise(1.0)
    )
    digits = F.regexp_replace(t, r"[^0-9.]", "")
    return F.when(digits != "", digits.try_cast("double")) * factor


def scheme_from_filename(c: Column) -> Column:
    """All scheme codes of a file name in order."""
    return F.array_distinct(F.regexp_extract_all(F.upper(clean_text(c)), F.lit(CODE_IN_NAME), F.lit(1)))


def scheme_from_text(docs: DataFrame, known: list[str]) -> DataFrame:
    """Best scheme code per document: three points per hit, one when a known code is contained.

    ``known`` is the whole scheme catalog. Ties go to the code seen first.
    """
    upper = F.upper(clean_text(F.col("text")))
    hits = F.regexp_extract_all(upper, F.lit(CODE_IN_TEXT), F.lit(0))
    catalog = F.array(*[F.lit(k) for k in sorted(known)])
    rows = docs.select("doc_id", upper.alias("u"), hits.alias("hits")).withColumn("known", F.filter(catalog, lambda k: F.contains(F.col("u"), k)))
    codes = F.array_distinct(F.concat("hits", "known"))
    scored = F.transform(
        codes,
        lambda c, i: F.struct((-(F.size(F.filter("hits", lambda h: h == c)) * 3 + F.array_contains("known", c).cast("int"))).alias("minus"), i.alias("i"), c.alias("code")),
    )
    ranked = rows.select("doc_id", F.array_sort(scored).alias("r"))
    first, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    level = (
        F.when(F.size("r") == 0, "LOW").when((F.size("r") == 1) | (first["minus"] + 2 <= second["minus"]), "HIGH").otherwise("MEDIUM")
    )
    return ranked.select(
        "doc_id", first["code"].alias("scheme_id"), level.alias("confidence"), (-first["minus"]).alias("score"),
        F.array_join(F.transform(F.slice("r", 1, 10), lambda x: x["code"]), ",").alias("candidates"),
    )


def _number(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(c, pattern, group).try_cast("int")


def extract_conditions(docs: DataFrame) -> DataFrame:
    """Flat conditions of a policy text (columns doc_id, scheme_id, text)."""
    text, low = F.col("clean"), F.col("low")
    genders = F.array_sort(F.array_compact(F.array(*[F.when(has_word(text, g, low), g.upper()) for g in GENDERS])))
    marital = F.array_compact(F.array(*[F.when(has_word(text, w, low), v) for w, v in MARITAL]))
    income = F.when(F.contains(low, F.lit("income")), F.nullif(F.regexp_extract(text, INCOME, 1), F.lit("")))
    codes = F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(CODE_IN_TEXT), F.lit(0))))
    rows = docs.withColumn("clean", clean_text(F.col("text")))
    rows = computed_once(rows, {"low": F.lower("clean")})
    has_age = F.contains(low, F.lit("age"))
    rows = computed_once(rows, {"income": income, "ranged": has_age & (F.regexp_extract(text, AGE_RANGE, 1) != "")})
    return rows.select(
        "doc_id", "scheme_id",
        F.when(F.col("ranged"), _number(text, AGE_RANGE, 1)).when(has_age, _number(text, AGE_MIN, 1)).alias("age_min"),
        F.when(F.col("ranged"), _number(text, AGE_RANGE, 2)).when(has_age, _number(text, AGE_MAX, 1)).alias("age_max"),
        genders.alias("gender_in"), marital.alias("marital_status_in"),
        parse_amount(F.col("income")).alias("income_max"),
        has_word(text, DISABILITY, low).alias("requires_disability"),
        F.array_remove(codes, F.upper(F.coalesce("scheme_id", F.lit("")))).alias("conflict_scheme_ids"),
    )


def keyword_concepts(docs: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """Concepts named by keywords but not covered by a condition, with the sentence they stand in.

    ``covered`` has (doc_id, fields): fields that conditions already handle. Sentences with
    "covered under" give a concept each.
    """
    rows = docs.select("doc_id", clean_text(F.col("text")).alias("clean"), sentences(F.col("text")).alias("s"))
    if covered is not None:
        rows = rows.join(covered, "doc_id", "left")
    else:
        rows = rows.withColumn("fields", F.array().cast("array<string>"))
    rows = computed_once(rows, {"low": F.lower("clean")})
    fields = F.coalesce("fields", F.array().cast("array<string>"))

    def concept_row(pos: Column, requirement: Column, quote: Column) -> Column:
        concept = map_concept(requirement)
        return F.struct(
            pos.alias("pos"), requirement.alias("requirement"), quote.alias("evidence_quote"),
            concept["field"].alias("suggested_input_field"), concept["input_type"].alias("input_type"),
        )

    def keyword_row(pos: int, requirement: str, patterns: list[str], skip: list[str]) -> Column:
        words = "|".join(patterns)
        quote = F.get(F.filter("s", lambda x: has_word(x, words)), F.lit(0))
        free = ~F.arrays_overlap(fields, F.array(*[F.lit(f) for f in skip]))
        # a sentence is part of the text, so the text test alone decides
        return F.when(free & has_word(F.col("clean"), words, F.col("low")), concept_row(F.lit(pos), F.lit(requirement), quote))

    found = [keyword_row(i, *spec) for i, spec in enumerate(KEYWORD_SPECS)]
    under = F.filter("s", lambda x: F.contains(F.lower(x), F.lit("covered under")))
    rows = rows.withColumn("u", F.transform(under, lambda x, i: concept_row(i + len(KEYWORD_SPECS), x, x)))
    # Of sentences that lead to the same input field only the first one stays; keyword rows all stay.
    names = F.transform("u", lambda x: x["suggested_input_field"])
    firsts = F.filter("u", lambda x, i: F.array_position(names, x["suggested_input_field"]) == i + 1)
    every = F.concat(F.array_compact(F.array(*found)), firsts)
    return rows.select("doc_id", F.inline(every))


def _windows(text: Column, max_chars: int) -> Column:
    """Consecutive windows of a text, in one pass over it; the empty text is one empty window."""
    cut = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{max_chars}}}"), F.lit(0))
    return F.when(F.length(text) > 0, cut).otherwise(F.array(F.lit("")))


def focus_windows(docs: DataFrame, max_chars: int = 8000) -> DataFrame:
    """The text around all cue words of a document, in numbered windows of ``max_chars`` characters.

    A piece reaches from 120 characters before a cue word to 620 behind it; pieces that touch are
    one. Every piece of the whole text is kept: window 0 is what a model with one window reads, the
    others follow. A document without a cue word, or without text, has one empty window.
    """
    rows = docs.select("doc_id", F.coalesce(clean_text(F.col("text")), F.lit("")).alias("t"))
    rows = computed_once(rows, {"m": F.regexp_extract_all("t", F.lit(CUES), F.lit(0)), "gap": F.split("t", CUES)})
    rows = rows.select("doc_id", "m", "gap", F.size("m").alias("n"))
    # Pieces part where more than 620 + 120 characters lie between two cue words, so neither
    # positions nor a fold are needed and the work is linear in the text.
    inner = F.when(F.col("n") > 1, F.sequence(F.lit(1), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    rows = computed_once(rows, {"part": F.filter(inner, lambda i: F.length(F.get("gap", i)) > 740)})
    ends = F.arrays_zip(
        F.concat(F.array(F.lit(0)), "part").alias("a"), F.concat(F.col("part"), F.array("n")).alias("z"),
    )

    def piece(x: Column) -> Column:
        a, z = x["a"], x["z"]
        words = F.transform(F.sequence(a, z - 1), lambda i: F.concat(F.when(i > a, F.get("gap", i)).otherwise(F.lit("")), F.get("m", i)))
        return F.trim(F.concat(F.right(F.get("gap", a), F.lit(120)), F.array_join(words, ""), F.left(F.get("gap", z), F.lit(620))))

    pieces = F.when(F.col("n") > 0, F.transform(ends, piece)).otherwise(F.array().cast("array<string>"))
    marks = F.array_join(F.array_sort(F.array_distinct(F.transform("m", lambda x: F.lower(x)))), ",")
    rows = computed_once(rows, {"focused": F.trim(F.array_join(F.filter(pieces, lambda p: p != ""), "\n\n")), "matches": marks})
    return rows.select("doc_id", "matches", F.posexplode(_windows(F.col("focused"), max_chars)).alias("window_no", "focused_text"))


def text_windows(docs: DataFrame, max_chars: int = 18000) -> DataFrame:
    """The whole text in numbered windows of ``max_chars`` characters; no text is one empty window."""
    rows = docs.select("doc_id", F.coalesce(clean_text(F.col("text")), F.lit("")).alias("t"))
    return rows.select("doc_id", F.posexplode(_windows(F.col("t"), max_chars)).alias("window_no", "text_window"))


def text_window(docs: DataFrame, max_chars: int) -> DataFrame:
    """One window for a model that reads no more: a longer text as head, middle and tail.

    This leaves text out; ``text_windows`` gives all of it.
    """
    part = max_chars // 3
    t = F.col("t")
    n = F.length(t)
    middle = F.greatest(F.lit(0), F.floor(n / 2).cast("int") - part // 2)
    cut = F.concat(
        F.lit("[HEAD]\n"), F.substring(t, 1, part), F.lit("\n\n[MIDDLE]\n"), F.substr(t, middle + 1, F.lit(part)), F.lit("\n\n[TAIL]\n"), F.right(t, F.lit(part))
    )
    return docs.select("doc_id", clean_text(F.col("text")).alias("t")).select("doc_id", F.when(n <= max_chars, t).otherwise(cut).alias("text_window"))


def reply_object(c: Column) -> Column:
    """JSON object of a model reply as a variant: fences removed, else the outermost braces."""
    t = F.trim(F.regexp_replace(c, r"^\s+|\s+$", ""))
    bare = F.when(t.startswith("```"), F.regexp_replace(F.regexp_replace(t, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")).otherwise(t)
    whole, inner = F.try_parse_json(bare), F.try_parse_json(F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit("")))

    def is_object(v: Column) -> Column:
        return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))

    return F.when(is_object(whole), whole).when(is_object(inner), inner)


def reply_json(replies: DataFrame) -> DataFrame:
    v = reply_object(F.col("reply"))
    return replies.select("reply_id", v.alias("v")).select(
        "reply_id", F.col("v").isNotNull().alias("is_object"), F.try_variant_get("v", "$.scheme_id", "string").alias("scheme_id"),
        F.try_variant_get("v", "$.age_min", "int").alias("age_min"),
    )
