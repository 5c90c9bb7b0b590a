"""Delimited records from text lines, with malformed lines set aside.

Lines are parsed with ``from_csv`` in PERMISSIVE mode into a fixed all-double
schema plus a ``_bad`` column holding the raw line of any malformed record
(too few fields, too many fields, a non-numeric field).  Parsing from text
rather than with the file-based CSV reader matters: the file reader prunes
unreferenced columns inside the parser, and then a too-long line or a bad
field in an unselected column passes as good.  ``from_csv`` with explicit
options is never pruned, so the good/bad split is the same whatever a later
query selects, and no persist is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parallax.sources.text import read_lines

BAD = "_bad"
# A separator that cannot occur in delimited numeric text: reading each line
# as one column through the CSV reader lets Spark drop each file's header.
_LINE_SEP = "\u0001\u0002\u0003"


def column_names(columns: int | list[str]) -> list[str]:
    if isinstance(columns, int):
        if columns < 1:
            raise ValueError("need at least one column")
        return [f"c{i}" for i in range(columns)]
    names = list(columns)
    if not names or BAD in names:
        raise ValueError(f"column names must be non-empty and must not include {BAD!r}")
    return names


def _ddl(names: list[str]) -> str:
    return ", ".join(f"`{n}` double" for n in names) + f", `{BAD}` string"


def read_lines_skip_header(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Text lines without the first line of each input file.

    Spark's CSV reader removes the header only in the split that starts at
    byte 0 of a file, so this is right when one file is split over many tasks
    or many files share a task.  Each line is read whole as one string column
    (quoting off, a separator that cannot occur), so nothing is parsed twice.
    """
    return (
        spark.read.schema("value string")
        .option("header", True)
        .option("sep", _LINE_SEP)
        .option("quote", "")
        .csv(path)
    )


def parse_lines(lines: DataFrame, columns: int | list[str], sep: str = ",", value: str = "value") -> DataFrame:
    """``records_checked``: the named double columns plus ``_bad``.

    Blank lines are dropped.  A line is malformed when it has too few or too
    many fields, or a field that is empty or not a finite decimal number; then every data
    column is null and ``_bad`` holds the line.  For a good line ``_bad`` is
    null and no data column is.
    """
    names = column_names(columns)
    opts = {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    # The one-element explode is a Generate node: filters on the parsed
    # struct (e.g. ``_bad IS NULL``) cannot be pushed below it, so Catalyst
    # does not substitute ``from_csv`` into the filter and parse every line
    # twice.  It stays inside the same codegen stage.
    parsed = (
        lines.filter(F.trim(F.col(value)) != "")
        .select(F.explode(F.array(F.struct(
            F.from_csv(F.col(value), _ddl(names), opts).alias("r"),
            F.col(value).alias("line"),
        ))).alias("_p"))
    )
    # An empty field parses as null: a record with a missing number is
    # malformed too (a null feature would poison scoring and training), and so
    # is one with NaN, an infinity or a number too large for a double.
    missing = None
    for n in names:
        v = F.col(f"_p.r.`{n}`")
        c = v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
        missing = c if missing is None else (missing | c)
    # The double parser also takes Java literals (1d, 2F, 0x1p3); none of their
    # letters but an exponent's e is part of a decimal number.
    # A line without letters (its lower and upper case are one) is not searched for them.
    line = F.col("_p.line")
    missing = missing | F.when(F.lower(line) != F.upper(line), line.rlike("[0-9.][dDfF]|[xXpP]")).otherwise(F.lit(False))
    bad = F.coalesce(F.col(f"_p.r.{BAD}"), F.when(missing, F.col("_p.line")))
    return parsed.select(
        *[F.when(bad.isNull(), F.col(f"_p.r.`{n}`")).alias(n) for n in names],
        bad.alias(BAD),
    )


def read_records(spark: SparkSession, path: str | list[str], columns: int | list[str], sep: str = ",",
                 header: bool = False) -> DataFrame:
    """Scan text files and parse them (``records_checked``); see ``parse_lines``."""
    lines = read_lines_skip_header(spark, path) if header else read_lines(spark, path)
    return parse_lines(lines, columns, sep=sep)


def good_records(checked: DataFrame) -> DataFrame:
    """The well-formed rows, without the ``_bad`` column."""
    return checked.filter(F.col(BAD).isNull()).drop(BAD)


def bad_records(checked: DataFrame) -> DataFrame:
    """The malformed lines, as ``DataFrame[_bad string]``."""
    return checked.filter(F.col(BAD).isNotNull()).select(BAD)


def split_records(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(good, bad)``.  Both re-read the input if both are used; persist
    ``checked`` first when both are consumed in the same job sequence."""
    return good_records(checked), bad_records(checked)

