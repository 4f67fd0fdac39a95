"""Text, list and date expressions. All are columns over columns; only ``clean_ascii`` needs Python (Arrow batches), as Spark has no NFKD."""

from __future__ import annotations

import ast
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Line separators that count as one blank each.
LINE_MARKS = "\n\r\t  \u0085\u000b\u000c"
# Typographic signs and their ASCII forms.
TYPOGRAPHY = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "...", " ": " "}
STRIP = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def clean_ws(c: Column) -> Column:
    """Line separators become blanks (runs stay), blanks of any kind at the ends go, null becomes empty."""
    return F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), LINE_MARKS, " " * len(LINE_MARKS)), STRIP, "")


@F.pandas_udf(StringType())
def _ascii(s: pd.Series) -> pd.Series:
    table = str.maketrans(TYPOGRAPHY)
    return s.map(lambda x: unicodedata.normalize("NFKD", x.translate(table)).encode("ascii", "ignore").decode())


def clean_ascii(c: Column) -> Column:
    """``clean_ws``, typographic signs in ASCII, compatibility decomposition, and nothing outside of ASCII left."""
    return _ascii(clean_ws(c))


def join_fields(fields: list[tuple[str, Column]]) -> Column:
    """``Label: value; Label: value`` of the cleaned non-empty values; empty if there is none."""
    cleaned = [(label, clean_ws(c)) for label, c in fields]
    return F.concat_ws("; ", *[F.when(c != "", F.concat(F.lit(f"{label}: "), c)) for label, c in cleaned])


def field_value(text: Column, label: str) -> Column:
    """The value behind ``Label:`` in a joined text, null if it is missing."""
    got = F.regexp_extract(text, rf"(?:^|; ){label}: (.*?)(?:; [^;:]+: |$)", 1)
    return F.when(got != "", got)


def list_literal(values: Column) -> Column:
    """An array of strings as a Python list literal: ``['A', "B's"]``."""

    def one(x: Column) -> Column:
        for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            x = F.replace(x, F.lit(raw), F.lit(shown))
        double = x.contains("'") & ~x.contains('"')
        return F.when(double, F.concat(F.lit('"'), x, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("\\'")), F.lit("'")))

    return F.concat(F.lit("["), F.array_join(F.transform(values, one), ", "), F.lit("]"))


def list_in_order(values: Column, sep: str = ", ") -> Column:
    """Cleaned non-empty elements joined."""
    return F.array_join(F.filter(F.transform(values, clean_ws), lambda x: x != ""), sep)


def bracket_list(c: Column) -> Column:
    """``['A' 'B']`` as an array: brackets, line ends and quote marks are blanks, blanks separate. Null gives an empty array."""
    flat = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\[\]\n']", " ")
    return F.filter(F.split(flat, r"\s+"), lambda x: x != "")


def impressions(c: Column) -> Column:
    """``id-label id-label`` as an array of (id, label), cut at each token's last hyphen; tokens without one are dropped."""
    tokens = F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x.contains("-"))
    return F.transform(tokens, lambda x: F.struct(F.regexp_extract(x, "^(.*)-([^-]*)$", 1).alias("id"), F.regexp_extract(x, "^(.*)-([^-]*)$", 2).alias("label")))


def packed_timestamp(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """``YYYYMMDDhhmmss`` as a number, 0 if any part is malformed."""
    parts = [p.cast("string").try_cast("bigint") if hasattr(p, "try_cast") else p.cast("bigint") for p in (year, month, day, hour, minute, second)]
    total = sum((p * 10 ** (10 - 2 * k) for k, p in enumerate(parts)), F.lit(0).cast("bigint"))
    return F.coalesce(total, F.lit(0).cast("bigint"))


def parse_long_date(c: Column) -> Column:
    """``Tue Nov 17 11:37:35 -0800 2015``; null if malformed. The weekday is cut off, as it can't be parsed."""
    return F.try_to_timestamp(F.substring(c, 5, 100), F.lit("MMM dd HH:mm:ss Z yyyy"))


def parse_us_date(c: Column, strict: bool = False) -> Column:
    """``11/15/2019 9:07:00 AM``; null if malformed, or an error with ``strict``."""
    ts = F.try_to_timestamp(c, F.lit("M/d/yyyy h:mm:ss a"))
    return F.coalesce(ts, F.raise_error(F.concat(F.lit("malformed time: "), F.coalesce(c, F.lit("null")))).cast("timestamp")) if strict else ts


def parse_iso_date(c: Column) -> Column:
    """``2018-3-4`` or ``2018-03-04``; null if malformed."""
    return F.try_to_timestamp(c, F.lit("y-M-d"))


_WORDS = re.compile(r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|\b(true|false|null)\b""", re.S)
_PYTHON = {"true": "True", "false": "False", "null": "None"}


def _mixed_literal(line: str) -> object:
    """A Python literal in which constants are written as in JSON; text in quotes is left alone."""
    return ast.literal_eval(_WORDS.sub(lambda m: m.group(1) or _PYTHON[m.group(2)], line))


def parse_object(line: str) -> dict | None:
    """An object written as JSON or as a Python literal (also with true, false and null), None if it is neither."""
    for read in (json.loads, ast.literal_eval, _mixed_literal):
        try:
            out = read(line)
            return out if isinstance(out, dict) else None
        except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
            continue
    return None


@F.pandas_udf(StringType())
def _object_json(s: pd.Series) -> pd.Series:
    def one(x: str | None) -> str | None:
        o = None if x is None else parse_object(x)
        return None if o is None else json.dumps(o)

    return s.map(one)


def object_lines(c: Column) -> Column:
    """Lines of JSON or Python literals as JSON; null for lines that are neither. Feed to ``from_json`` with a schema."""
    return _object_json(c)
