"""Text expressions that several operators share; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"
# Latin letters with marks and what they are folded to.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN_ = "aaaaaaceeeeiiiinooooouuuuyy"
TRUNCATED = "\n... [output truncated]"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text (bytes = characters) takes the vectorised ``lower``."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def word_count(text: Column) -> Column:
    """Number of runs of non-white-space; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def split_lines(text: Column) -> Column:
    """Lines without their ends (LF or CRLF); a final end of line opens no further line."""
    parts = F.split(text, "\n", -1)
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    # \z, as $ also stands before a last CR
    return F.transform(whole, lambda x: F.regexp_replace(x, r"\r\z", ""))


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def safe_truncate(text: Column, most: int) -> Column:
    """At most ``most`` bytes, cut between characters, and a note if anything was cut."""
    data = text.cast("binary")
    cuts = [F.substring(data, 1, most - k) for k in range(4)]
    cut = F.coalesce(*[F.when(F.is_valid_utf8(c), c.cast("string")) for c in cuts])
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(cut, F.lit(TRUNCATED)))


def token_estimate(text: Column) -> Column:
    """A quarter of the bytes, rounded down."""
    return F.floor(F.octet_length(text) / 4).cast("long")


TOKEN = r"\p{L}+|\p{N}+"


def _lowered(text: Column) -> Column:
    """In lower case; of İ only the i stays, as its dot would be a mark of its own and divide the word."""
    return F.lower(F.replace(text, F.lit("İ"), F.lit("i")))


def folded_tokens(text: Column) -> Column:
    """Lower-cased words of letters and numbers of digits, of any script; marks of Latin letters folded away."""
    return F.regexp_extract_all(F.translate(_lowered(text), MARKED, PLAIN_), F.lit(TOKEN), 0)


def lower_tokens(text: Column) -> Column:
    """``folded_tokens`` with their marks, for those who fold distinct words: a mark never divides a word. Null has none."""
    return F.coalesce(F.regexp_extract_all(_lowered(text), F.lit(TOKEN), 0), F.array().cast("array<string>"))


def tokens_of(text: str) -> list[str]:
    """``folded_tokens`` of a text that the driver has, such as a query."""
    import regex

    return regex.findall(TOKEN, text.replace("İ", "i").lower().translate(str.maketrans(MARKED, PLAIN_)))


def extension(path: Column) -> Column:
    """What follows the last dot of the last path segment; empty if there is none."""
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles; null where a vector is null or zero, holds a null, or has another length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
