"""Chat formatting: typed content parts flattened into one marked text per conversation.

A message is a list of parts (text, image, audio, document). The visitor
`visited` turns them into text with one placeholder per attachment, and records
each attachment with what it refers to and how many tokens its placeholder
expands to. Control strings inside texts are escaped, so that the formatted
text can be read back exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
CLOSE_PATTERN = r"<\|im_end\|>\n"
MEDIA = ("image", "audio", "document")
MEDIA_PATTERN = r"<\|(?:image|audio|document)\|>"
# Markdown's embedding, `![label](address)`; the kind follows from the ending, an image by default.
MARKUP = r"!\[[^\]\n]*\]\([^()\s]*\)"
AUDIO_ENDING, DOCUMENT_ENDING = r"(?i)\.(mp3|wav|flac|ogg)$", r"(?i)\.(pdf|docx|html|txt)$"

PART_TYPE = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


@dataclass(frozen=True)
class MediaCosts:
    """Tokens a placeholder expands to. The plain figures count where the measure is missing."""

    image_patch: int = 28
    image_tokens: int = 256
    audio_per_second: float = 12.5
    audio_tokens: int = 375
    page_tokens: int = 512
    document_tokens: int = 1024


def escape(text: Column) -> Column:
    """No `<|` remains: each `<`, backslashes, `|` gets one backslash more."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    """A role on one line, free of `<`."""
    for char, code in (("%", "%25"), ("\n", "%0A"), ("<", "%3C")):
        role = F.replace(role, F.lit(char), F.lit(code))
    return role


def unescape_role(role: Column) -> Column:
    for char, code in (("<", "%3C"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(code), F.lit(char))
    return role


def _part(**fields: Column) -> Column:
    names = [x.split(":") for x in PART_TYPE[7:-1].split(",")]
    return F.struct(*[fields.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in names])


def parts_from_markup(text: Column) -> Column:
    """The parts of a plain text: embedded media in Markdown, and the texts around them. Null: one empty text."""
    text = F.coalesce(text, F.lit(""))
    def media(mark: Column) -> Column:
        ref = F.regexp_extract(mark, r"\(([^()\s]*)\)$", 1)
        kind = F.when(ref.rlike(AUDIO_ENDING), "audio").when(ref.rlike(DOCUMENT_ENDING), "document").otherwise("image")
        return _part(kind=kind, text=mark, ref=ref)

    def piece_and_mark(piece: Column, mark: Column) -> Column:
        own = _part(kind=F.lit("text"), text=piece)
        return F.when(mark.isNull(), F.array(own)).otherwise(F.array(own, media(mark)))

    marks = F.regexp_extract_all(text, F.lit(MARKUP), F.lit(0))
    split = F.flatten(F.zip_with(F.split(text, MARKUP), marks, piece_and_mark))
    return F.when(text.contains("]("), split).otherwise(F.array(_part(kind=F.lit("text"), text=text)))


def _is_media(part: Column) -> Column:
    return F.coalesce(part["kind"].isin(*MEDIA), F.lit(False))


def _tokens(part: Column, costs: MediaCosts) -> Column:
    patch = float(costs.image_patch)
    image = F.ceil(part["width"] / patch) * F.ceil(part["height"] / patch)
    audio = F.ceil(part["seconds"] * costs.audio_per_second)
    return (
        F.when(part["kind"] == "image", F.coalesce(image, F.lit(costs.image_tokens)))
        .when(part["kind"] == "audio", F.coalesce(audio, F.lit(costs.audio_tokens)))
        .otherwise(F.coalesce(part["pages"] * costs.page_tokens, F.lit(costs.document_tokens)))
        .cast("long")
    )


def visited(parts: Column, costs: MediaCosts = MediaCosts()) -> Column:
    """Parts to a struct of `content` and its `attachments`, both in order.

    Parts of other kinds, and null ones, count as text; null text is empty.
    Texts side by side are one text before they are escaped: a control string
    may begin in one part and end in the next.
    """
    def fed(seen: Column, part: Column) -> Column:
        media = F.struct(
            F.concat(seen["done"], escape(seen["open"]), F.lit("<|"), part["kind"], F.lit("|>")).alias("done"), F.lit("").alias("open")
        )
        plain = F.struct(
            seen["done"].alias("done"), F.concat(seen["open"], F.coalesce(part["text"], F.lit(""))).alias("open")
        )
        return F.when(_is_media(part), media).otherwise(plain)

    nothing = F.struct(F.lit("").alias("done"), F.lit("").alias("open"))
    content = F.aggregate(parts, nothing, fed, lambda seen: F.concat(seen["done"], escape(seen["open"])))
    attachments = F.transform(
        F.filter(parts, _is_media),
        lambda part, i: F.struct(
            i.cast("int").alias("place"), part["kind"].alias("kind"), part["ref"].alias("ref"),
            F.coalesce(part["text"], F.lit("")).alias("source"), _tokens(part, costs).alias("tokens"),
        ),
    )
    return F.struct(content.alias("content"), attachments.alias("attachments"))


def format_chat(messages: DataFrame, parts: str | None = None, costs: MediaCosts = MediaCosts()) -> DataFrame:
    """One formatted text per conversation from rows (conv_id, turn, role, text).

    `parts` names a column of PART_TYPE lists to take in place of the text, in
    which media in Markdown become parts. Turns go by turn number, ties by role
    and text, nulls first; rows that repeat are turns of their own. Null roles
    and texts count as empty; a null conv_id is a conversation like others.
    Other columns are ignored, an empty table gives no rows.

    Result: conv_id, n_turns, formatted, loss_turns (places, from 0, of the
    turns a model learns), loss_spans (start and length of their contents in
    code points of `formatted`), attachments (a list per turn), expanded_tokens.
    A conversation is one value in the end, so one row must hold it; the work on
    texts is done before that, turn by turn.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    source = F.col(parts) if parts else parts_from_markup(F.col("text"))
    source = F.coalesce(source, F.array().cast(f"array<{PART_TYPE}>"))
    text = F.coalesce(F.col("text"), F.lit("")) if "text" in messages.columns else F.lit("")
    header = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))
    turns = (
        messages.select("conv_id", "turn", role.alias("role"), text.alias("text"), visited(source, costs).alias("seen"))
        .select(
            "conv_id", "turn", "role", "text", "seen",
            F.length(header).alias("head"), F.concat(header, F.col("seen.content"), F.lit(CLOSE)).alias("message"),
        )
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = turns.select(
        "conv_id", "role", "seen", "message",
        (F.row_number().over(order) - 1).alias("place"),
        (F.sum(F.length("message")).over(order.rowsBetween(Window.unboundedPreceding, 0))
         - F.length("message") + F.col("head")).alias("start"),
    )
    gathered = placed.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("place", "message", "role", "start", "seen"))).alias("turns"),
        F.sum(F.aggregate("seen.attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"])).alias("expanded_tokens"),
    )
    learnt = F.filter("turns", lambda t: t["role"] == "assistant")
    return gathered.select(
        "conv_id", "n_turns",
        F.array_join(F.transform("turns", lambda t: t["message"]), "").alias("formatted"),
        F.transform(learnt, lambda t: t["place"]).alias("loss_turns"),
        F.transform(
            learnt, lambda t: F.struct(t["start"].alias("start"), F.length(t["seen"]["content"]).alias("length"))
        ).alias("loss_spans"),
        F.transform("turns", lambda t: t["seen"]["attachments"]).alias("attachments"),
        "expanded_tokens",
    )


def restored(content: Column, media: Column) -> Column:
    """A turn's text as it was before, from its formatted content and its attachments."""
    whole = F.array_join(
        F.transform(
            F.split(content, MEDIA_PATTERN),
            lambda piece, k: F.concat(unescape(piece), F.coalesce(F.get(media, k)["source"], F.lit(""))),
        ), "",
    )
    return F.when(F.size(media) > 0, whole).otherwise(unescape(content))


def learnt_texts(formatted: Column, loss_spans: Column, loss_turns: Column, attachments: Column) -> Column:
    """The texts under the loss mask, in order, as they were before: what the spans of `formatted` hold."""
    return F.transform(loss_spans, lambda span, k: restored(
        F.substring(formatted, span["start"].cast("int") + 1, span["length"]), F.get(attachments, F.get(loss_turns, k).cast("int")),
    ))


def read_back(formatted: Column, attachments: Column) -> Column:
    """The turns (role, text) of a formatted conversation, as they were before."""
    def turn(message: Column, i: Column) -> Column:
        head = F.substring_index(message, "\n", 1)
        role = unescape_role(F.substring(head, len(OPEN) + 1, 2**31 - 1))
        content = F.substring(message, F.length(head) + 2, F.lit(2**31 - 1))
        return F.struct(role.alias("role"), restored(content, F.get(attachments, i)).alias("text"))

    messages = F.split(formatted, CLOSE_PATTERN)
    return F.transform(F.slice(messages, F.lit(1), F.size(messages) - 1), turn)
