"""String functions with the source system's white space and code-point rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as trimmed and split on.
SPACE = r"[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The same to DuckDB's regular expressions.
SPACE_SQL = SPACE
#: The same as characters.
_SPACES = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def trim_space(c: Column) -> Column:
    return F.trim(c, F.lit(_SPACES))


def collapse_space(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def excerpt(c: Column, most: int = 160) -> Column:
    """Line ends as LF, trimmed, and cut to ``most`` code points, the last three of which are then dots."""
    text = trim_space(F.replace(c, F.lit("\r\n"), F.lit("\n")))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 3), F.lit("...")))


def strip_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, "[.,;:!?]+$", "")


def html_escape(c: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;")):
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c


# Control characters with an escape of their own.
_NAMED = {"\a": "\\a", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\v": "\\v"}


def quoted(c: Column) -> Column:
    """Double-quoted with backslash escapes for quotes, backslashes and ASCII control characters, named ones by letter, others as ``\\x..``."""
    for plain in ("\\", '"'):
        c = F.replace(c, F.lit(plain), F.lit("\\" + plain))
    odd = c
    for code in (*range(32), 127):
        odd = F.replace(odd, F.lit(chr(code)), F.lit(_NAMED.get(chr(code), f"\\x{code:02x}")))
    return F.concat(F.lit('"'), F.when(c.rlike(r"[\x00-\x1f\x7f]"), odd).otherwise(c), F.lit('"'))


def blank_to(c: Column, other: str) -> Column:
    return F.when(trim_space(F.coalesce(c, F.lit(""))) == "", F.lit(other)).otherwise(c)


def yes_no(c: Column) -> Column:
    return F.when(c, "yes").otherwise("no")


def base_name(c: Column) -> Column:
    """Last element of a slash path; ``.`` of an empty one."""
    bare = F.regexp_replace(c, "/+$", "")
    return F.when(c == "", ".").when(bare == "", "/").otherwise(F.substring_index(bare, "/", -1))


def local_href(c: Column) -> Column:
    return F.concat(F.lit("./"), F.regexp_replace(c, r"^\./", ""))


def entropy(c: Column) -> Column:
    """Shannon entropy in bits of the characters, summed in the order of their first appearance."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    n = F.size(chars).cast("double")

    def term(x: Column) -> Column:
        p = F.size(F.filter(chars, lambda y: y == x)) / n
        return -p * F.log2(p)

    return F.aggregate(F.transform(F.array_distinct(chars), term), F.lit(0.0), lambda a, x: a + x)


def character_classes(c: Column) -> Column:
    """How many of lower case, upper case, digits and ``+/=_-`` occur."""
    return sum((c.rlike(p).cast("int") for p in ("[A-Z]", "[0-9]", "[+/=_-]")), c.rlike("[a-z]").cast("int"))


def distinct_nonblank(array: Column) -> Column:
    """Trimmed, without blanks, first appearances in order."""
    return F.array_distinct(F.filter(F.transform(array, trim_space), lambda x: x != ""))
