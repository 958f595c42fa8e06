"""Chat formatting from typed content parts, DataFrame functions only.

A message is a row (conversation, turn, role, parts). A part is text, an image, a sound or a document. The
visitor turns the parts of a message into one body: text is escaped, every attachment becomes a placeholder
in its place, and two neighbouring texts are kept apart by a mark. References and token counts of
attachments are recorded in order.

Defined cases: null or empty text is an empty text; a message without parts has an empty body; a null role
is the empty role; a part of an unknown kind is text; null sizes count 0 tokens; a null conversation is a
conversation of its own; rows of one turn are ordered by role and body, repeated rows are repeated turns; a
null turn comes first. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
TURN, BODY, END, JOINT = "<|turn|>", "<|body|>", "<|end|>", "<|part|>"
PLACEHOLDER = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}

#: What may not stand in a text: the marks above and those of common chat templates. All start with < or [,
#: and neither sign stands anywhere else in them, so a text and a mark that follows it never form another mark.
_OPEN = r"([<\[])"
_REST = r"(\|(?:turn|body|end|part|image|audio|document|im_start|im_end|endoftext)\|>|/?s>|/?INST\])"

IMAGE_PATCH, AUDIO_TOKENS_PER_SECOND, TOKENS_PER_PAGE = 28, 12.5, 640


def escape(text: Column) -> Column:
    """One backslash more after the first sign of each control string; reversible, other text stays as it is."""
    return F.regexp_replace(text, _OPEN + r"(\\*)" + _REST, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _OPEN + r"\\(\\*)" + _REST, "$1$2$3")


def text_parts(text: str) -> Column:
    """The content of a message that is plain text."""
    return F.array(
        F.struct(
            F.lit("text").alias("kind"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
            F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("int").alias("width"),
            F.lit(None).cast("int").alias("height"),
            F.lit(None).cast("double").alias("seconds"),
            F.lit(None).cast("int").alias("pages"),
        )
    )


def is_text(part: Column) -> Column:
    return ~F.coalesce(part["kind"].isin(*PLACEHOLDER), F.lit(False))


def part_tokens(part: Column) -> Column:
    """Tokens that an attachment expands to."""
    patches = lambda side: F.ceil(F.coalesce(part[side], F.lit(0)) / F.lit(IMAGE_PATCH))
    return (
        F.when(part["kind"] == "image", patches("width") * patches("height"))
        .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_TOKENS_PER_SECOND))
        .when(part["kind"] == "document", F.coalesce(part["pages"], F.lit(0)) * TOKENS_PER_PAGE)
        .otherwise(F.lit(0))
        .cast("long")
    )


def visit(parts: Column) -> tuple[Column, Column]:
    """(body, attachments) of a message."""
    parts = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    last = F.size(parts) - 1

    def piece(part, i):
        joint = (i < last) & is_text(part) & is_text(F.get(parts, i + 1))
        own = F.when(is_text(part), escape(F.coalesce(part["text"], F.lit(""))))
        for kind, mark in PLACEHOLDER.items():
            own = own.when(part["kind"] == kind, F.lit(mark))
        return F.concat(own, F.when(joint, F.lit(JOINT)).otherwise(F.lit("")))

    body = F.array_join(F.transform(parts, piece), "")
    attached = F.transform(
        F.filter(parts, lambda p: ~is_text(p)),
        lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")),
    )
    return body, attached


def format_chats(
    messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts"
) -> DataFrame:
    """One row per conversation: ``formatted``, ``loss_spans`` (code points from 0, end excluded, of what
    assistants said), ``attachments`` (in order of the placeholders) and ``attachment_tokens``."""
    body, attached = visit(F.col(parts))
    rows = messages.select(
        F.col(conversation).alias("conv_id"),
        F.col(turn).alias("_turn"),
        F.coalesce(F.col(role), F.lit("")).alias("_role"),
        body.alias("_body"),
        attached.alias("_attached"),
    ).withColumn("_head", F.concat(F.lit(TURN), escape(F.col("_role")), F.lit(BODY)))
    length = F.length("_head") + F.length("_body") + F.lit(len(END))
    order = Window.partitionBy("conv_id").orderBy("_turn", "_role", "_body")
    rows = rows.withColumn(
        "_start", F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, 0)) - length + F.length("_head")
    )
    turns = F.array_sort(
        F.collect_list(
            F.struct(
                "_start",
                (F.col("_start") + F.length("_body")).alias("_end"),
                F.col("_role"),
                F.concat("_head", "_body", F.lit(END)).alias("_text"),
                "_attached",
            )
        )
    )
    said = F.filter("_turns", lambda t: t["_role"] == "assistant")
    return (
        rows.groupBy("conv_id")
        .agg(turns.alias("_turns"))
        .select(
            "conv_id",
            F.array_join(F.transform("_turns", lambda t: t["_text"]), "").alias("formatted"),
            F.transform(said, lambda t: F.struct(t["_start"].alias("start"), t["_end"].alias("end"))).alias(
                "loss_spans"
            ),
            F.flatten(F.transform("_turns", lambda t: t["_attached"])).alias("attachments"),
        )
        .withColumn(
            "attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"])
        )
    )


def turns_of(formatted: Column) -> Column:
    """Reads the turns back: array of (role, text), unescaped."""
    pieces = F.split(formatted, r"<\|turn\|>")
    each = F.slice(pieces, F.lit(2), F.size(pieces))

    def parse(turn):
        halves = F.split(turn, r"<\|body\|>")
        text = F.split(F.get(halves, F.lit(1)), r"<\|end\|>")
        return F.struct(
            unescape(F.get(halves, F.lit(0))).alias("role"), unescape(F.get(text, F.lit(0))).alias("text")
        )

    return F.transform(each, parse)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    cuts = F.transform(
        spans,
        lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))),
    )
    return F.array_join(cuts, "")


def chat_digest(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say, read back from them."""
    turns = turns_of(F.col("formatted"))
    spoken = F.array_join(F.transform("_back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return (
        formatted.withColumn("_back", turns)
        .withColumn("_loss", loss_text(F.col("formatted"), F.col("loss_spans")))
        .select(
            "conv_id",
            F.size("_back").cast("long").alias("n_turns"),
            F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"),
            F.length("_loss").cast("long").alias("loss_chars"),
            F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )
