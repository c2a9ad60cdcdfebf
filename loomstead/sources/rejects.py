"""Strict loading of delimited lines, with the lines that fail kept apart and diagnosed."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# One field: quoted (doubled quotes inside, commas and line breaks allowed) or free of quotes and commas.
# Possessive quantifiers keep the matcher from backtracking on very long fields.
FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)'
RECORD = rf"^{FIELD}(?:,{FIELD})*+$"
SPLIT = rf",({FIELD})"  # on the line with a comma put before it, so that no match is empty


@dataclass(frozen=True)
class LineFormat:
    """columns of a line; valid judges the unquoted fields, given as a function from name to Column."""

    columns: Sequence[str]
    valid: Callable[[Callable[[str], Column]], Column]


def _body(line: str) -> Column:
    return F.regexp_replace(F.col(line), r"\r\z", "")


def _raw_fields(body: Column) -> Column:
    return F.regexp_extract_all(F.concat(F.lit(","), body), F.lit(SPLIT), F.lit(1))


def _fields(body: Column) -> Column:
    raw = _raw_fields(body)
    return F.transform(
        raw, lambda x: F.when(x.startswith('"'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)
    )


def load_strict(raw: DataFrame, line: str, fmt: LineFormat) -> DataFrame:
    """The rows of raw whose line conforms, with one text column per field of the format.

    A trailing carriage return does not count. A null line does not conform.
    """
    body = _body(line)
    parsed = raw.filter(body.rlike(RECORD)).withColumn("__f", _fields(body)).filter(F.size("__f") == len(fmt.columns))
    at = {c: i for i, c in enumerate(fmt.columns)}
    ok = fmt.valid(lambda name: F.get("__f", F.lit(at[name])))
    return parsed.filter(F.coalesce(ok, F.lit(False))).select(
        *[raw[c] for c in raw.columns if c not in at], *[F.get("__f", F.lit(i)).alias(c) for c, i in at.items()]
    )


def reject_reasons(raw: DataFrame, offset: Sequence[str], line: str, fmt: LineFormat) -> DataFrame:
    """(offset columns, line, reason) of every row of raw that load_strict does not load.

    The loaded offsets are subtracted from all offsets, and only the remainder is diagnosed: quoting
    (a quoted field left open, text after its closing quote, a quote in an unquoted field), else
    column_count, else invalid_value. A null line has no fields: column_count. Rows repeated in full
    share an offset and a fate. So that a failing row that shares its offset with a loaded one is not
    lost, the line's hash belongs to the offset.
    """
    mark = F.xxhash64(F.coalesce(F.col(line), F.lit("\0")))
    kept = load_strict(raw.withColumn("__line", F.col(line)), "__line", fmt).select(
        *[F.col(c).alias(f"__o{i}") for i, c in enumerate(offset)], F.xxhash64(F.col("__line")).alias("__h")
    )
    cond = [F.col(c).eqNullSafe(F.col(f"__o{i}")) for i, c in enumerate(offset)]
    # only offsets and hashes are subtracted; the lines of what is left are fetched by them afterwards
    left = raw.select(*offset, mark.alias("__m")).join(kept, [*cond, F.col("__m") == F.col("__h")], "left_anti")
    left = left.select(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(offset)], F.col("__m").alias("__h"))
    rest = raw.withColumn("__m", mark).join(left, [*cond, F.col("__m") == F.col("__h")], "left_semi").drop("__m")
    body = F.coalesce(_body(line), F.lit(""))
    reason = (
        F.when(F.col(line).isNull(), "column_count")
        .when(~body.rlike(RECORD), "quoting")
        .when(F.size(_raw_fields(body)) != len(fmt.columns), "column_count")
        .otherwise("invalid_value")
    )
    return rest.select(*offset, line, reason.alias("reason"))


def _blank_trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def income_valid(field: Callable[[str], Column]) -> Column:
    """Year of four digits from 1900 to 2100; Data a plain number where Disclosure is 0; blanks around are allowed."""
    year, data, disclosure = (_blank_trim(field(c)) for c in ("Year", "Data", "Disclosure"))
    year_ok = year.rlike(r"^[0-9]{4}$") & year.try_cast("int").between(1900, 2100)
    data_ok = data.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    return year_ok & (data_ok | (disclosure != "0"))


INCOME_LINES = LineFormat(
    ("IBRC_GEO_ID", "Statefips", "Countyfips", "Description", "Year", "Linecode", "Data", "Disclosure"), income_valid
)
