"""Chat formatting with typed content parts: turns become one marked string with a loss mask.

A message holds text, or a list of parts ``struct<kind, text, ref, units>``. Text is escaped, every
other part becomes a placeholder in its place; its reference and expanded token count are recorded.
All DataFrame functions; one shuffle on the conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

START, END = "<|im_start|>", "<|im_end|>"
# Tokens that one unit (tile, second, page) of a part expands to.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}
OTHER_TOKENS = 1
PARTS = "array<struct<kind:string,text:string,ref:string,units:bigint>>"


def escape(c: Column) -> Column:
    """A backslash more after the ``<`` of every ``<|``, ``<\\|``, ``<\\\\|`` ...: no control string is left."""
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def escape_role(c: Column) -> Column:
    """As text, and a role never holds a line end."""
    return F.replace(F.replace(escape(c), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(c: Column) -> Column:
    plain = F.regexp_replace(c, r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return unescape(F.replace(plain, F.lit("\\\\"), F.lit("\\")))


def text_parts(text: Column) -> Column:
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units"))).cast(PARTS)


def _is_text(p: Column) -> Column:
    return F.coalesce(p["kind"], F.lit("text")) == "text"


def _placeholder(p: Column) -> Column:
    known = F.when(p["kind"].isin(*UNIT_TOKENS), p["kind"]).otherwise(F.lit("file"))
    return F.concat(F.lit("<|"), known, F.lit("|>"))


def _tokens(p: Column) -> Column:
    per = F.lit(OTHER_TOKENS)
    for kind, n in UNIT_TOKENS.items():
        per = F.when(p["kind"] == kind, F.lit(n)).otherwise(per)
    return (F.coalesce(p["units"], F.lit(1)) * per).cast("bigint")


def flatten_parts(parts: Column) -> tuple[Column, Column]:
    """(rendered body, attachments in order) of one message. Null parts and null text are empty."""
    held = F.filter(F.coalesce(parts, F.array().cast(PARTS)), lambda p: p.isNotNull())
    body = F.array_join(F.transform(held, lambda p: F.when(_is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(_placeholder(p))), "")
    files = F.transform(F.filter(held, lambda p: ~_is_text(p)), lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens")))
    return body, files


def format_chat(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: str | None = None, learned: str = "assistant") -> DataFrame:
    """One row per conversation: conv, formatted, loss_spans, attachments, n_expanded.

    ``loss_spans`` are (start, end) in code points of ``formatted``: the whole body of each turn of
    role ``learned``. ``attachments`` are (turn_no, kind, ref, tokens) in order; ``n_expanded`` is
    their token sum. Turns are ordered by turn, role, body (null turn first), so ties and repeated
    rows give one defined string, and repeated rows stay. Null text and null role are empty, a null
    conversation id is one conversation, an empty table gives no row, other columns are ignored.
    A conversation is one output row, so its turns meet in one task: that is the result itself.
    """
    source = F.col(parts) if parts else text_parts(F.col(text))
    body, files = flatten_parts(source)
    who = F.coalesce(F.col(role), F.lit(""))
    rows = messages.select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), who.alias("_role"), body.alias("_body"), files.alias("_files"))
    head = F.concat(F.lit(START), escape_role(F.col("_role")), F.lit("\n"))
    in_order = Window.partitionBy("_conv").orderBy("_turn", "_role", "_body")
    placed = (
        rows.withColumn("_head", head)
        .withColumn("_no", F.row_number().over(in_order))
        .withColumn("_len", F.length("_head") + F.length("_body") + F.lit(len(END) + 1))
        .withColumn("_start", F.sum("_len").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_len") + F.length("_head"))
    )
    piece = F.struct(
        F.col("_no").alias("no"),
        F.concat("_head", "_body", F.lit(END + "\n")).alias("text"),
        F.when(F.col("_role") == learned, F.struct(F.col("_start").alias("start"), (F.col("_start") + F.length("_body")).alias("end"))).alias("loss"),
        F.col("_files").alias("files"),
    )
    whole = placed.groupBy("_conv").agg(F.array_sort(F.collect_list(piece)).alias("_p"))
    attached = F.flatten(F.transform("_p", lambda p: F.transform(p["files"], lambda f: F.struct(p["no"].alias("turn_no"), f["kind"].alias("kind"), f["ref"].alias("ref"), f["tokens"].alias("tokens")))))
    return whole.select(
        F.col("_conv").alias(conv),
        F.array_join(F.transform("_p", lambda p: p["text"]), "").alias("formatted"),
        F.transform(F.filter("_p", lambda p: p["loss"].isNotNull()), lambda p: p["loss"]).alias("loss_spans"),
        attached.alias("attachments"),
        F.aggregate(attached, F.lit(0).cast("bigint"), lambda a, f: a + f["tokens"]).alias("n_expanded"),
    )


def parse_chat(formatted: Column) -> Column:
    """The turns (role, text) of a formatted string; placeholders stay as they are written."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda _, i: i > 0)
    return F.transform(
        pieces,
        lambda x: F.struct(
            unescape_role(F.substring_index(x, "\n", 1)).alias("role"),
            unescape(F.substr(x, F.length(F.substring_index(x, "\n", 1)) + 2, F.length(x) - F.length(F.substring_index(x, "\n", 1)) - F.lit(1 + len(END) + 1))).alias("text"),
        ),
    )


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
