"""Chat formatting of turns with typed content parts, with DataFrame functions only.

A visitor flattens each turn's parts in order: text is escaped and kept,
image, audio and document parts become placeholders whose references and
expanded token counts are recorded. Control strings inside texts are escaped
reversibly, so turns can be read back from the formatted text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: Control strings that no text may show: the template's own, which all open alike, and those of other templates.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Tokens that one unit of an attachment expands to: a tile, a second, a page.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 800}
#: The placeholder's name for parts of all other types, whatever they are called.
OTHER = "other"

_OPEN = re.compile(r"[\\^$.|?*+()\[\]{}]")


def _quoted(text: str) -> str:
    return _OPEN.sub(lambda m: "\\" + m[0], text)


def escaped(text: Column) -> Column:
    """``text`` with backslashes doubled and one put behind the first letter of every control string."""
    firsts = "".join(sorted({_quoted(c[0]) for c in CONTROLS}))
    rests = "|".join(_quoted(c[1:]) for c in CONTROLS)
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, f"([{firsts}])(?={rests})", r"$1\\")


def unescaped(text: Column) -> Column:
    """The inverse of ``escaped``."""
    parts = F.split(text, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\"), F.lit(""))), "\\")


def text_parts(text: Column) -> Column:
    """A turn's plain text as its only part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units")))


def _visited(parts: Column) -> Column:
    """Each part as kind, the text it becomes, its reference and its expanded tokens."""

    def visit(part: Column) -> Column:
        tokens = F.lit(0).cast("long")
        for kind, each in UNIT_TOKENS.items():
            tokens = F.when(part["type"] == kind, F.coalesce(part["units"], F.lit(1)) * each).otherwise(tokens)
        untyped = F.when(part["ref"].isNotNull() & part["text"].isNull(), OTHER).otherwise("text")
        is_text = F.coalesce(part["type"], untyped) == "text"
        # Only the known kinds are written out: a type may not forge a mark of the template.
        placeholder = F.concat(F.lit("<|"), F.when(part["type"].isin(*UNIT_TOKENS), part["type"]).otherwise(OTHER), F.lit("|>"))
        return F.struct(
            is_text.alias("is_text"),
            part["type"].alias("kind"),
            F.when(is_text, escaped(F.coalesce(part["text"], F.lit("")))).otherwise(placeholder).alias("shown"),
            part["ref"].alias("ref"),
            tokens.alias("tokens"),
        )

    return F.transform(F.coalesce(parts, F.array().cast("array<struct<type:string,text:string,ref:string,units:bigint>>")), visit)


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """One row a conversation: conv_id, formatted, loss_spans, attachments and expanded_tokens.

    Turns follow each other by turn, then role, then content before escaping;
    repeated rows are turns of their own. ``loss_spans`` are start and length, in code
    points of ``formatted``, of each text part of an assistant's turn.
    ``attachments`` lists place, kind, reference and tokens of every other
    part; ``expanded_tokens`` sums them. ``parts`` is an array of type, text,
    ref and units; null parts, texts and roles count as empty (an empty role
    and a null one are the same), null units as one. Parts of an unknown type,
    and untyped ones with a reference but no text, are recorded as attachments
    behind one neutral placeholder and expand to no token; rows without a conversation are one
    together; an empty table gives an empty result.

    A conversation is one text, so its turns meet in one task; nothing else does.
    """
    rows = turns.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"), _visited(F.col(f"`{parts_col}`")).alias("seen"))
    shown = F.transform("seen", lambda s: s["shown"])
    head = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(BODY))
    rows = rows.withColumn("head", head).withColumn("content", F.array_join(shown, ""))
    rows = rows.withColumn("whole", F.concat("head", "content", F.lit(END)))
    order = [F.col("turn").asc_nulls_first(), "role", unescaped(F.col("content")), "content"]
    before = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)))
    rows = rows.withColumn("start", (F.sum(F.length("whole").cast("long")).over(before) - F.length("whole") + F.length("head")).cast("long"))

    def span(part: Column, k: Column) -> Column:
        ahead = F.aggregate(F.slice("seen", 1, k), F.lit(0).cast("long"), lambda n, s: n + F.length(s["shown"]))
        return F.struct(part["is_text"].alias("is_text"), (F.col("start") + ahead).alias("start"), F.length(part["shown"]).cast("long").alias("length"))

    spans = F.transform(F.filter(F.transform("seen", span), lambda s: s["is_text"] & (F.col("role") == "assistant")), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
    attached = F.filter("seen", lambda s: ~s["is_text"])
    attached = F.transform(attached, lambda s: F.struct(F.col("place").alias("place"), s["kind"].alias("kind"), s["ref"].alias("ref"), s["tokens"].alias("tokens")))
    rows = rows.select("conv_id", F.struct("place", "whole", spans.alias("spans"), attached.alias("attached")).alias("turn"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    attachments = F.flatten(F.transform("turns", lambda t: t["attached"]))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["whole"]), "").alias("formatted"),
        F.flatten(F.transform("turns", lambda t: t["spans"])).alias("loss_spans"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation; placeholders stay in the text as they are."""
    pieces = F.filter(F.split(formatted, _quoted(TURN), -1), lambda p: p != "")

    def turn(piece: Column) -> Column:
        parts = F.split(piece, _quoted(BODY), 2)
        content = F.get(parts, F.lit(1))
        return F.struct(unescaped(F.get(parts, F.lit(0))).alias("role"), unescaped(F.left(content, F.length(content) - len(END))).alias("text"))

    return F.transform(pieces, turn)


def under_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, each once and in order."""
    return F.transform(spans, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
