"""Chat formatting of typed content parts, with Spark's own functions only.

A message holds parts: text, image, audio or document. A visitor flattens them in order: text is
escaped, every other part becomes a placeholder that numbers it within its conversation's turn;
its reference and the tokens it expands to are recorded beside. A conversation's formatted text
marks each turn and tells which stretches the loss covers.

Escapes: "~" becomes "~0"; behind the first character of a control string in a text stands "~1";
a line feed in a role becomes "~2". So no control string survives inside a text, and every text
can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"
#: Tokens that a unit of a part expands to: a tile of an image, a second of audio, a page of a document.
EXPANDS = {"image": 256, "audio": 25, "document": 512}
#: Starts of control strings, this template's and other common ones, or what may complete to one behind the part.
_CONTROL = r"(<(?=\||/?s>|/?s?\z)|\[(?=/?INST\]|/?I?N?S?T?\z))"
PART = "struct<type: string, text: string, ref: string, units: bigint>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("~"), F.lit("~0")), _CONTROL, "$1~1")


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("~1"), F.lit("")), F.lit("~2"), F.lit("\n"))
    return F.replace(out, F.lit("~0"), F.lit("~"))


def text_part(text: Column) -> Column:
    """A message of one text part."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), null.cast("string").alias("ref"), null.cast("bigint").alias("units")))


def _visit(part: Column, number: Column) -> Column:
    kind = F.coalesce(part["type"], F.lit("text"))
    return F.when(kind == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), escape(kind), F.lit(":"), number.cast("string"), F.lit("|>")))


def _tokens(part: Column) -> Column:
    per = F.lit(0)
    for kind, n in EXPANDS.items():
        per = F.when(part["type"] == kind, F.lit(n)).otherwise(per)
    return per * F.coalesce(part["units"], F.lit(1))


def render(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", learn: str = "assistant") -> DataFrame:
    """One row for each conversation: conv_id, n_turns, formatted, loss_spans, attachments, expanded_tokens.

    parts is an array of PART. Messages stand by turn, those of equal turns (nulls first) by role
    and content, as it was before escaping; repeated messages all stay. A conversation is one
    row of the result, so its messages meet in one task, very long texts whole. A null role or text reads as empty, a null list of
    parts as none, a null type as text, null units as 1; a null conversation is one of its own.
    loss_spans (start, length; in code points, from 0) covers what messages of the role `learn`
    say, escaped. attachments lists turn, number, type, ref and tokens in order. Other columns
    are left out, so names can't clash.
    """
    rows = messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(parts, F.array().cast(f"array<{PART}>")).alias("parts"))
    is_text = lambda p: F.coalesce(p["type"], F.lit("text")) == "text"
    content = F.array_join(F.transform("parts", lambda p, i: _visit(p, i)), "")
    others = F.filter(F.transform("parts", lambda p, i: F.struct(i.alias("number"), p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p).cast("bigint").alias("tokens"))), lambda p: ~is_text(p))
    raw = F.array_join(F.transform("parts", lambda p: F.when(is_text(p), F.coalesce(p["text"], F.lit(""))).otherwise(F.lit(""))), "")
    rows = rows.select("conv_id", "turn", "role", raw.alias("raw"), content.alias("content"), others.alias("others"))
    head = F.concat(F.lit(TURN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("~2")), F.lit("\n"))
    rows = rows.withColumn("head", head).withColumn("said", F.concat("head", "content", F.lit(END)))
    ordered = Window.partitionBy("conv_id").orderBy("turn", "role", "raw", "content", F.to_json("others"))
    rows = rows.withColumn("nth", F.row_number().over(ordered)).withColumn("end", F.sum(F.length("said")).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    span = F.struct((F.col("end") - F.length("said") + F.length("head")).alias("start"), F.length("content").cast("bigint").alias("length"))
    files = F.transform("others", lambda p: F.struct(F.col("turn").alias("turn"), p["number"].alias("number"), p["type"].alias("type"), p["ref"].alias("ref"), p["tokens"].alias("tokens")))
    one = F.struct("nth", "said", F.when(F.col("role") == learn, span).alias("span"), files.alias("files"))
    turns = F.sort_array(F.collect_list(one))
    out = rows.groupBy("conv_id").agg(F.count("*").alias("n_turns"), turns.alias("turns"))
    return out.select(
        "conv_id",
        "n_turns",
        F.array_join("turns.said", "").alias("formatted"),
        F.filter("turns.span", lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten("turns.files").alias("attachments"),
        F.aggregate(F.flatten("turns.files"), F.lit(0).cast("bigint"), lambda n, f: n + f["tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of role and text."""
    body = F.split(formatted, r"<\|end\|>\n")
    said = F.transform(F.slice(body, 1, F.size(body) - 1), lambda x: F.substring(x, len(TURN) + 1, 2_000_000_000))
    role = lambda x: F.substring_index(x, "\n", 1)
    return F.transform(said, lambda x: F.struct(unescape(role(x)).alias("role"), unescape(F.substring(x, F.length(role(x)) + 2, F.length(x))).alias("text")))


def under_loss(formatted: Column, spans: Column) -> Column:
    """All text that the loss covers, as it was before escaping."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")
