"""Conversations as one text each, with attachments and a loss mask.

The content of a turn is a list of typed parts (text, image, audio, document). Visiting the parts
in order gives the turn's body: texts with their control strings escaped, and for every other part
a placeholder <|kind|>, whose reference and token count (units times TOKENS of its kind) go to the
list of attachments. Turns are marked <|im_start|>role, line end, body, <|im_end|>, line end.

Escaping puts one backslash more between "<" and "|" wherever only backslashes (or nothing) stand
between them, so "<|" is left to the template alone; taking one away gives the text back exactly.
Neighbouring texts are escaped as one, so a control string cut over several parts is no mark either, and
only plain names (letters, digits, underscores) that are not the template's own become placeholders.

Everything is DataFrame functions. Order and offsets come from a window over the turns of a
conversation, so work grows in proportion to it; a conversation ends as one row and must fit one.

Defined results: null texts and roles are empty; a null turn comes before all others, equal turns
are ordered by role, then text; a null conv_id is a conversation of its own; a part of a kind that
is not known is a placeholder with no tokens, a part without a kind is text. A kind that is no plain name, or
a name of the template, has the placeholder <|other|>; its attachment keeps the kind. Repeated rows are turns of
their own. Columns of the input beside those that are read take no part, whatever their names. An empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the template.
START, STOP = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"
# Tokens per unit: image tiles, seconds of audio, pages.
TOKENS = {"image": 256, "audio": 25, "document": 512}

# The template's own names, and what takes their place as the name of a placeholder.
RESERVED, OTHER = ("im_start", "im_end"), "other"
# Stands before a placeholder's name, or "t" where a text has this character itself.
_SIGN = "\x01"

PART = "struct<kind: string, text: string, ref: string, units: bigint>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def text_parts(text: Column) -> Column:
    """A plain text as a list of one part."""
    part = F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).alias("ref"), F.lit(0).alias("units"))
    return F.array(part).cast(f"array<{PART}>")


def _is_text(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text")) == "text"


def body(parts: Column) -> Column:
    """What the parts come to in the formatted text.

    Texts and signs for placeholders are joined, escaped as one, and the signs replaced. A sign between "<" and
    "|" keeps them apart, as its placeholder does.
    """
    plain = lambda kind: kind.rlike("^[A-Za-z0-9_]+$") & ~kind.isin(*RESERVED)
    one = lambda p: F.when(
        _is_text(p), F.replace(F.coalesce(p["text"], F.lit("")), F.lit(_SIGN), F.lit(f"{_SIGN}t"))
    ).otherwise(F.concat(F.lit(f"{_SIGN}p"), F.when(plain(p["kind"]), p["kind"]).otherwise(OTHER), F.lit(";")))
    joined = escape(F.array_join(F.transform(parts, one), ""))
    marked = F.regexp_replace(joined, f"{_SIGN}p([A-Za-z0-9_]+);", "<|$1|>")
    return F.replace(marked, F.lit(f"{_SIGN}t"), F.lit(_SIGN))


def attachments(parts: Column) -> Column:
    """Kind, reference and token count of every part that is no text, in order."""
    counted = lambda p: sum(
        (F.when(p["kind"] == kind, F.lit(n).cast("long")).otherwise(0) for kind, n in TOKENS.items()), F.lit(0).cast("long")
    ) * F.coalesce(p["units"], F.lit(0))
    found = F.filter(parts, lambda p: ~_is_text(p))
    return F.transform(found, lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), counted(p).alias("tokens")))


def formatted(turns: DataFrame, parts: str | None = None) -> DataFrame:
    """One row per conversation from rows (conv_id, turn, role, text or a column of parts).

    ``formatted`` is the text. ``loss`` has the learned stretches: number of the turn, first code
    point in the turn's block and in the whole text, length. ``attachments`` are in order of
    appearance, ``placeholder_tokens`` their tokens in all.
    """
    content = F.col(parts) if parts else text_parts(F.coalesce("text", F.lit("")))
    role = F.coalesce("role", F.lit(""))
    rows = turns.select(
        "conv_id",
        "turn",
        role.alias("role"),
        F.coalesce(content, F.array().cast(f"array<{PART}>")).alias("parts"),
    )
    head = F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n"))
    rows = rows.select("conv_id", "turn", "role", "parts", head.alias("head"), body(F.col("parts")).alias("body"))
    block = F.concat("head", "body", F.lit(f"{STOP}\n"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"block": block, "place": F.row_number().over(order) - 1})
    rows = rows.withColumn("offset", F.coalesce(F.sum(F.char_length("block")).over(before), F.lit(0)))
    loss = F.when(
        F.col("role") == LEARNED,
        F.struct(
            F.col("place").alias("turn"),
            F.char_length("head").alias("first"),
            (F.col("offset") + F.char_length("head")).alias("offset"),
            F.char_length("body").alias("length"),
        ),
    )
    one = F.struct("place", "block", loss.alias("loss"), attachments(F.col("parts")).alias("attachments"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    found = F.flatten(F.col("turns.attachments"))
    return whole.select(
        "conv_id",
        F.array_join("turns.block", "").alias("formatted"),
        F.filter("turns.loss", lambda x: x.isNotNull()).alias("loss"),
        found.alias("attachments"),
        F.aggregate(found, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("placeholder_tokens"),
    )


def read_back(texts: DataFrame) -> DataFrame:
    """Add ``turns`` (role, text) and ``learned`` (texts under the mask), from the formatted text alone."""
    blocks = F.split("formatted", r"<\|im_end\|>\n")
    blocks = F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0)))
    rows = texts.withColumn("_blocks", blocks)

    def turn(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        role = F.substring(head, len(START) + 1, F.length(head))
        text = F.substring(block, F.length(head) + 2, F.length(block))
        return F.struct(_unescape_role(role).alias("role"), unescape(text).alias("text"))

    def under_mask(span: Column) -> Column:
        return unescape(F.substring(F.get("_blocks", span["turn"]), span["first"] + 1, span["length"]))

    made = {"turns": F.transform("_blocks", turn), "learned": F.transform("loss", under_mask)}
    return rows.withColumns(made).drop("_blocks")


def digests(texts: DataFrame) -> DataFrame:
    """Counts and digests of what is read back."""
    back = read_back(texts)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
