"""Column functions on text and lines."""

import json

from pyspark.sql import Column, functions as F

# FIXED VALUES: the characters that whitespace stripping removes
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def sql_text(text: str) -> str:
    """A string as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# Long lists of patterns and constants enter plans as SQL text: one call to the
# JVM instead of one per constant.


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def unix_newlines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def split_lines(text: Column) -> Column:
    """Lines of a text with unix newlines; a trailing newline opens no further line."""
    open_end = F.when(text.endswith("\n") | (text == ""), 1).otherwise(0)
    return let(F.split(text, "\n", -1), lambda parts: F.slice(parts, 1, F.size(parts) - open_end))


def starts_with_any(text: Column, prefixes: list[str]) -> Column:
    hit = F.lit(False)
    for prefix in prefixes:
        hit = hit | text.startswith(prefix)
    return hit


def sql_array(values) -> str:
    """A list of strings or numbers as a SQL array."""
    return "array(" + ", ".join(sql_text(v) if isinstance(v, str) else str(v) for v in values) + ")"


def sql_literal(value, schema: str) -> str:
    """A constant of nested type as SQL: one JSON text, read once while the plan is made."""
    return f"from_json({sql_text(json.dumps(value, ensure_ascii=False))}, {sql_text(schema)})"


def fold_case(lowered: Column) -> Column:
    """Lower-cased text with the non-ASCII letters that case-insensitively equal an ASCII one replaced.

    A superset test only: an ASCII literal that matches the text without regard
    to case is always a substring of the folded text.
    """
    for letter, plain in (("ſ", "s"), ("ı", "i"), ("i̇", "i")):
        lowered = F.replace(lowered, F.lit(letter), F.lit(plain))
    return lowered


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where ``body`` uses it in loops over lines."""
    return F.transform(F.array(value), body)[0]


def shorten_path(path: Column, width: int = 40) -> Column:
    return F.when(F.length(path) > width, F.concat(F.lit("..."), F.right(path, F.lit(width - 3)))).otherwise(path)
