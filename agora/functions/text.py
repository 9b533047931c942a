"""Text functions: tokens, hashtags, metadata blocks, templates, encodings, timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import NA_TOKENS, TRANSLATE_CHARS

#: White space as a Unicode-aware split without argument has it.
UNICODE_SPACE = r"(?U)[\s\x1c-\x1f]+"
#: Labels of the metadata block and the columns behind them, in order (fixed values).
METADATA = (
    ("Author name", "authorNickname"),
    ("Author username", "authorUniqueId"),
    ("Author signature", "authorSignature"),
    ("Description", "videoDescription"),
    ("Timestamp", "timestamp"),
    ("Duration", "videoDuration"),
    ("Diggs", "videoDiggCount"),
    ("Shares", "videoShareCount"),
    ("Comments", "videoCommentCount"),
    ("Plays", "videoPlayCount"),
    ("Video URL", "video_url"),
    ("Author URL", "author_url"),
    ("Hashtags", "hashtags"),
)


def na_to_null(c: Column) -> Column:
    """Null for the tokens that mean a missing value."""
    return F.when(~c.isin(*NA_TOKENS), c)


def tokens(c: Column) -> Column:
    """Runs of anything but Unicode white space; null gives none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), UNICODE_SPACE), lambda x: x != "")


def hashtags(c: Column) -> Column:
    """Tokens that begin with #, joined by comma and space; '' without any."""
    return F.array_join(F.filter(tokens(c), lambda t: F.startswith(t, F.lit("#"))), ", ")


def filled(c: Column) -> Column:
    """The value as text, null as ''."""
    return F.coalesce(c.cast("string"), F.lit(""))


def present(c: Column) -> Column:
    """Not null and not empty."""
    return filled(c) != ""


def or_default(c: Column, value: object) -> Column:
    """The value, or a default for null alone: 0, '' and false stay."""
    return F.coalesce(c, F.lit(value))


def first_of(c: Column, default: str = "") -> Column:
    """The first element; the default for null, empty, or a null element."""
    return F.coalesce(F.get(c, F.lit(0)), F.lit(default))


def epoch_text(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss")


def base64_text(c: Column) -> Column:
    """Base64 without line breaks, of a string's UTF-8 bytes or of binary."""
    return F.regexp_replace(F.base64(c.cast("binary")), "[\\r\\n]", "")


def metadata_block(columns: dict[str, Column]) -> Column:
    """One `- label: value` line for each entry of METADATA; missing values are empty."""
    return F.concat_ws("\n", *(F.concat(F.lit(f"- {label}: "), filled(columns[name])) for label, name in METADATA))


def translate_input(c: Column) -> Column:
    return F.substring(c, 1, TRANSLATE_CHARS)


def translate_pieces(c: Column) -> Column:
    """The whole text in pieces of so many characters at most, in order, each up to a white space where it has one; '' is one piece."""
    n = TRANSLATE_CHARS
    return F.when(c == "", F.array(c)).otherwise(F.regexp_extract_all(c, F.lit(rf"(?s).{{1,{n}}}\z|.{{0,{n - 1}}}\s|.{{1,{n}}}"), F.lit(0)))


def pieces_joined(pieces: Column) -> Column:
    """The text of array<struct<said, english>>: translations, and originals where there is none. White space at which the original was cut is kept."""

    def piece(p: Column, i: Column) -> Column:
        cut = F.concat(F.regexp_replace(p["english"], r"\s+\z", ""), F.regexp_extract(p["said"], r"\s*\z", 0))
        return F.coalesce(F.when(i < F.size(pieces) - 1, cut).otherwise(p["english"]), p["said"])

    return F.array_join(F.transform(pieces, piece), "")


def lines_joined(lines: Column) -> Column:
    """Every line followed by a line break; '' without lines."""
    return F.when(F.size(F.coalesce(lines, F.array())) > 0, F.concat(F.array_join(lines, "\n", ""), F.lit("\n"))).otherwise(F.lit(""))


def user_prompt(frames: Column, metadata: Column, transcript: Column) -> Column:
    """The data that a summary is asked of, each part under its heading."""
    return F.concat_ws("\n\n", F.concat(F.lit("Frames:\n"), filled(frames)), F.concat(F.lit("Metadata:\n"), filled(metadata)), F.concat(F.lit("Transcript:\n"), filled(transcript)), F.lit("Analyse the politics of this video from the three sources above."))


def list_text(c: Column) -> Column:
    """Names joined by comma and space: for export, since a name may hold a comma."""
    return F.array_join(F.coalesce(c, F.array()), ", ")


def pairs_text(c: Column) -> Column:
    """One element^affect line per pair: for export."""
    return F.array_join(F.transform(F.coalesce(c, F.array()), lambda e: F.concat(filled(e["populism_element"]), F.lit("^"), filled(e["populism_affect"]), F.lit("\n"))), "")


def messages(system: Column, user: Column, image: Column | None = None) -> Column:
    """A chat: array<struct<role, content, images>>."""
    none = F.lit(None).cast("array<binary>")
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content"), none.alias("images")), F.struct(F.lit("user").alias("role"), user.alias("content"), (none if image is None else F.array(image)).alias("images")))


def label_flags(element: Column, affect: Column) -> Column:
    """A normalised element, and whether the affect is a single word."""
    return F.struct(F.lower(F.trim(element)).alias("element"), F.coalesce(F.trim(affect).rlike(r"^\S+$"), F.lit(False)).alias("single_word"))
