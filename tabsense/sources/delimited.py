"""Delimited text: delimiter, encoding and types are found out from the data."""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import named, strip, to_number
from .records import CHUNK_BYTES, decoded, file_facts, files_with_open_lines, lines_of, split_records

# fixed values
DELIMITERS = [",", "\t", ";", "|"]
NA_VALUES = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
]
INTEGER_PATTERN = r"^[+-]?\d{1,18}$"
BOOLEANS = ["True", "False", "TRUE", "FALSE", "true", "false"]


class SourceError(Exception):
    """The source is missing, empty or unreadable."""


def sniff_delimiter(lines: list[str]) -> str:
    """The candidate that splits most of the lines into the same number of fields as the first."""
    best, best_rank = DELIMITERS[0], (0.0, 0)
    for d in DELIMITERS:
        counts = [re.sub(r'"[^"]*"', "", line).count(d) for line in lines]
        if not counts or counts[0] == 0:
            continue
        rank = (sum(c == counts[0] for c in counts) / len(counts), counts[0])
        if rank > best_rank:
            best, best_rank = d, rank
    return best


def _too_long(raw: Column, delimiter: str, width: int) -> Column:
    """Whether a record holds something behind its last column; empty trailing cells do not count."""
    sep = re.escape(delimiter)
    bare = F.regexp_replace(F.replace(raw, F.lit('""'), F.lit("")), f'(^|{sep})"[^"]*"', "$1q")
    return F.exists(F.slice(F.split(bare, sep), width + 1, 1_000_000), lambda cell: cell != "")


@dataclass(frozen=True)
class Layout:
    """What the files of a group have in common."""

    encoding: str
    delimiter: str
    header: bytes
    open: bool  # a quoted cell holds a line break


def layouts(lines: DataFrame, delimiter: str | None, encoding: str | None) -> dict[Layout, list[str]]:
    """The files of each layout, those with the first file first.

    A file is UTF-8 if every line of it is, else Latin-1, which accepts any byte. One entry
    per file reaches the driver, no more than the reader lists itself.
    """
    facts = file_facts(lines, sniff_delimiter, delimiter).collect()
    quoted: dict[str, list[str]] = {}
    for f in facts:
        if f["quotes"]:
            quoted.setdefault(f["delimiter"], []).append(f["file"])
    broken = {file for d, files in quoted.items() for file in files_with_open_lines(_only(lines, files, len(facts)), d)}
    groups: dict[Layout, list[str]] = {}
    for f in sorted(facts, key=lambda f: f["file"]):
        key = Layout(encoding or ("UTF-8" if f["valid"] else "ISO-8859-1"), f["delimiter"], bytes(f["header"]), f["file"] in broken)
        groups.setdefault(key, []).append(f["file"])
    return groups


def _only(rows: DataFrame, files: list[str], of: int, column: Column | None = None) -> DataFrame:
    """Rows of some files; the reader leaves the other files unread."""
    return rows if len(files) == of else rows.where((F.col("file") if column is None else column).isin(files))


def _names(header: str, delimiter: str) -> list[str]:
    """Column names: cut of blanks, empty ones by place, repeated ones numbered by place."""
    raw = next(csv.reader([header], delimiter=delimiter), [])
    names = [n.replace("\ufeff", "").strip() for n in raw]
    lower = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if lower.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def _read_layout(spark: SparkSession, path: str, lines: DataFrame, layout: Layout, files: list[str], of: int, chunk_bytes: int) -> DataFrame:
    names = _names(layout.header.decode(layout.encoding, "replace").rstrip("\r"), layout.delimiter)
    cells = [f"c{i}" for i in range(len(names))]
    fields = T.StructType([T.StructField(c, T.StringType()) for c in [*cells, "_raw"]])
    # a reader that skips columns would not see that a record is too long
    options = {"sep": layout.delimiter, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_raw"}
    if layout.open:
        records = split_records(_only(lines, files, of), layout.delimiter, chunk_bytes).where(~F.col("first"))
        rows = records.select(F.from_csv(decoded("record", layout.encoding), fields.simpleString()[7:-1].replace(":", " "), options).alias("r")).select("r.*")
    else:
        reader = spark.read.schema(fields).options(**options, encoding=layout.encoding, header="true", columnPruning=False)
        rows = _only(reader.csv(path), files, of, F.col("_metadata.file_path"))
    # the text of a record is given only when its number of fields is wrong; the reader
    # refuses a scan of that text alone, hence the first cell in the condition
    fits = F.col("_raw").isNull() | (F.length(F.concat_ws("", F.col("c0"))) < 0) | ~_too_long(F.col("_raw"), layout.delimiter, len(names))
    return rows.where(fits).select(*cells).toDF(*names)


def read_text_table(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """All columns as text. Records with too many fields are dropped, short ones padded with null.

    Every file has its own encoding, delimiter and header. Files that agree are read together;
    the groups are put below each other by column name, in the order of the first file, and
    what a file does not have is null there. All files are split over tasks, also those with
    line breaks inside quoted cells. Lines end with a line feed, with or without a carriage
    return.
    """
    try:
        lines = lines_of(spark, path)
        groups = layouts(lines, delimiter, encoding)
    except AnalysisException as e:
        raise SourceError(f"nothing to read at {path}") from e
    if not groups:
        raise SourceError("no records below the header")
    of = sum(map(len, groups.values()))
    tables = [_read_layout(spark, path, lines, layout, files, of, chunk_bytes) for layout, files in groups.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def _with_na(c: Column) -> Column:
    """Null for a cell that is exactly one of the NA texts; a padded one stays text."""
    return F.when(~c.isin(NA_VALUES), c)


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns to bigint, double or boolean where every value allows it; one scan decides."""
    if not df.columns:
        return df
    text = df.select(*[_with_na(named(c)).alias(c) for c in df.columns])
    aggs = []
    for i, c in enumerate(text.columns):
        v = named(c)
        aggs += [
            F.count(v).alias(f"n{i}"), F.count_if(strip(v).rlike(INTEGER_PATTERN)).alias(f"i{i}"),
            F.count(to_number(v)).alias(f"d{i}"), F.count_if(strip(v).isin(BOOLEANS)).alias(f"b{i}"),
        ]
    row = text.agg(*aggs).first()
    out = {}
    for i, c in enumerate(text.columns):
        n, v = row[f"n{i}"], named(c)
        if n == 0:
            out[c] = v.cast("double")
        elif row[f"i{i}"] == n:
            out[c] = strip(v).try_cast("bigint")
        elif row[f"d{i}"] == n:
            out[c] = to_number(v)
        elif row[f"b{i}"] == n:
            out[c] = F.lower(strip(v)) == "true"
    return text.withColumns(out) if out else text


def load_delimited(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A file or a folder of files with header lines, typed."""
    df = read_text_table(spark, path, delimiter, encoding, chunk_bytes)
    if df.isEmpty():
        raise SourceError("no records below the header")
    return infer_types(df)
