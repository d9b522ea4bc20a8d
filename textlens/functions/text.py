"""Column expressions over text: folding, offsets, numbers, hashes, escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numerals newer than the JVM's tables are added to \p{N}.
_N = r"\p{N}\x{11DE0}-\x{11DE9}\x{16FF4}-\x{16FF6}"
NUMBER = rf"[{_N}]++(?:[.,][{_N}]++)*+"
WHOLE_NUMBER = rf"^{NUMBER}$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def numeric_prefix(text: Column) -> Column:
    """The number a text begins with, empty without one."""
    return F.regexp_extract(text, f"^{NUMBER}", 0)


def _is_ascii(s: Column) -> Column:
    return F.octet_length(s) == F.length(s)


def ascii_lower(s: Column) -> Column:
    """A to Z in lower case, all else as it is (the quick way for texts of ASCII alone)."""
    return F.when(_is_ascii(s), F.lower(s)).otherwise(F.translate(s, _UPPER, _LOWER))


def closed_key(s: Column) -> Column:
    """ASCII lower case, the curly apostrophe straightened."""
    return F.when(_is_ascii(s), F.lower(s)).otherwise(F.translate(s, _UPPER + "’", _LOWER + "'"))


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    return F.decode(F.substring(F.encode(text, "UTF-8"), start.cast("int") + 1, (end - start).cast("int")), "UTF-8")


def line_breaks(text: Column) -> Column:
    """LF, CR and CRLF, each one break."""
    return F.regexp_count(text, F.lit("\r\n|\r|\n"))


def utf16_length(s: Column) -> Column:
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("int")


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(text, "UTF-8"), 256))


def escaped(text: Column) -> Column:
    """Untrusted text with quotes, backslashes and everything unprintable as visible escapes."""

    def shown(c: Column) -> Column:
        named = F.when(c == "\t", r"\t").when(c == "\r", r"\r").when(c == "\n", r"\n").when(c == "\0", r"\0").when(c.isin("'", '"', "\\"), F.concat(F.lit("\\"), c))
        return named.when(c.rlike(r"^[\p{C}\p{Zl}\p{Zp}\p{Mn}\p{Me}]|^[\p{Zs}&&[^ ]]"), F.concat(F.lit("\\u{"), F.lower(F.hex(F.ascii(c).cast("long"))), F.lit("}"))).otherwise(c)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), shown), "")
