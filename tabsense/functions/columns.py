"""Column expressions shared by the operators: text repair, parsing, schema tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
NULL_TOKENS = ["nan", "null", "none", "n/a", "na", "n.a.", "-", "--", "?", "missing", "nil", "empty"]
BOOLEAN_TOKENS = ["true", "false", "yes", "no", "y", "n", "0", "1"]
DATE_WORDS = ["date", "time", "timestamp", "year", "month", "day"]
ID_WORDS = ["id", "code", "uuid", "key", "sku"]
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# the characters that count as whitespace at the edges of a text
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# (shape, format) of days and of times: 99 for one or two digits, A for a word
DAY_FORMATS = [
    ("9999-99-99", "yyyy-MM-dd"),
    ("9999/99/99", "yyyy/MM/dd"),
    ("9999.99.99", "yyyy.MM.dd"),
    ("99/99/9999", "MM/dd/yyyy"),
    ("99-99-9999", "MM-dd-yyyy"),
    ("99.99.9999", "MM.dd.yyyy"),
    ("99999999", "yyyyMMdd"),
    ("A 99, 9999", "MMM dd, yyyy"),
    ("A 99 9999", "MMM dd yyyy"),
    ("99 A 9999", "dd MMM yyyy"),
    ("99-A-9999", "dd-MMM-yyyy"),
    ("9999-99", "yyyy-MM"),
    ("9999/99", "yyyy/MM"),
    ("A 9999", "MMM yyyy"),
]
TIME_FORMATS = [
    ("", ""),
    (" 99:99", " HH:mm"),
    (" 99:99:99", " HH:mm:ss[.SSSSSSSSS]"),
    ("A99:99", "'T'HH:mm"),
    ("A99:99:99", "'T'HH:mm:ss[.SSSSSSSSS]"),
    (" 99:99 A", " hh:mm a"),
    (" 99:99:99 A", " hh:mm:ss[.SSSSSSSSS] a"),
]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
# the usual texts, parsed by constant formats
PLAIN_DAYS = [("9999-99-99", "yyyy-MM-dd"), ("9999/99/99", "yyyy/MM/dd"), ("99/99/9999", "MM/dd/yyyy"), ("99/99/9999", "dd/MM/yyyy")]
PLAIN_TIMES = [("", ""), (" 99:99:99", " HH:mm:ss"), ("T99:99:99", "'T'HH:mm:ss")]
# how any other date text begins
WEEKDAY = "(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*\\.?,? +"
DATE_START = (
    "(?i)^([0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]|[0-9]{4}[-/][0-9]{1,2}$|[0-9]{8}\\b|([0-9]{1,2}[ -])?(" + "|".join(m[:3] for m in MONTHS) + ")[a-z]*[-. ]"
    "|(mon|tue|wed|thu|fri|sat|sun)[a-z]*\\.?,? )"
)
# ----------------------------------------------------------------------------


def named(name: str) -> Column:
    """A column by its exact name, also when the name holds dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip(c: Column) -> Column:
    """Remove every kind of edge whitespace (plain ``trim`` removes blanks only)."""
    return F.btrim(c, F.lit(WHITESPACE))


def is_null_token(c: Column) -> Column:
    # the length test spares long texts the lower-casing
    return (F.length(strip(c)) <= max(map(len, NULL_TOKENS))) & F.lower(strip(c)).isin(NULL_TOKENS)


def is_boolean_token(c: Column) -> Column:
    return (F.length(strip(c)) <= max(map(len, BOOLEAN_TOKENS))) & F.lower(strip(c)).isin(BOOLEAN_TOKENS)


def is_padded(c: Column) -> Column:
    return c != strip(c)


def to_number(c: Column) -> Column:
    """Text to double; null where the trimmed text is not a plain number."""
    trimmed = strip(c)
    return F.when(trimmed.rlike(NUMBER_PATTERN), trimmed.try_cast("double"))


def to_moment(c: Column, day_first: bool = False) -> Column:
    """Text to timestamp over the known formats; null where none fits.

    Of two numbers before the year the first is the month, unless it is above 12; with
    ``day_first`` it is the day, unless the second is above 12. Years of two digits are those
    from 1969 to 2068. A zone is cut off: the result is the clock time as written.
    """
    trimmed = strip(c)
    # the shape decides the format, so no parse is tried in vain
    shape = F.translate(trimmed, "012345678", "999999999")
    month_first = F.substring(trimmed, 4, 2) > "12" if day_first else F.substring(trimmed, 1, 2) <= "12"
    fits = lambda form, day: (shape == form) & (month_first if day.startswith("MM") else F.lit(True))
    plain = [
        F.when(fits(form + t, day), F.try_to_timestamp(trimmed, F.lit(day + time)))
        for form, day in PLAIN_DAYS for t, time in PLAIN_TIMES if not t or form.startswith("9999")
    ]
    return F.when(F.length(trimmed).between(6, 40), F.coalesce(*plain, F.when(trimmed.rlike(DATE_START), _other_moment(trimmed, day_first))))


def _other_moment(trimmed: Column, day_first: bool = False) -> Column:
    """The moment of a text with single digits, names, a short year, a fraction or a zone; its format is looked up by its shape."""
    text = F.regexp_replace(F.regexp_replace(trimmed, WEEKDAY, ""), r"(?i)([0-9]) ?([ap])\.?m\.?$", "$1 $2M")
    text = F.regexp_replace(text, r"(:[0-9]{2}(?:\.[0-9]{1,9})?) ?(?:Z|UTC|[+-][0-9]{2}:?[0-9]{2})$", "$1")
    # long month names are cut to three letters, single digits filled up to two
    months = "|".join(f"{m[:3]}(?={m[3:]}\\b|\\b)" for m in MONTHS)
    text = F.regexp_replace(text, f"(?i)\\b({months}|sep(?=t\\b))[a-z]*\\.?", "$1")
    text = F.regexp_replace(text, r"(?<![0-9.:])([0-9])(?![0-9])|(?<=[./-])([0-9])(?=[./-])", "0$1$2")
    for years, century in (("69|[7-9][0-9]", "19"), ("[0-9]{2}", "20")):
        text = F.regexp_replace(text, rf"^([0-9]{{2}}([/.-])[0-9]{{2}}\2)({years})(?![0-9.:])", f"$1{century}$3")
    shape = F.translate(F.regexp_replace(text, r"(:[0-9]{2})\.[0-9]+( [A-Za-z]+)?$", "$1$2"), "012345678", "999999999")
    shape = F.regexp_replace(shape, "[A-Za-z]+", "A")
    formats = {d + t: day + time for d, day in DAY_FORMATS for t, time in TIME_FORMATS}
    form = F.try_element_at(F.create_map(*[F.lit(x) for pair in formats.items() for x in pair]), shape)
    # MM/dd becomes dd/MM where the first number cannot be a month
    later = F.substring(text, 4, 2) <= "12" if day_first else F.substring(text, 1, 2) > "12"
    day_first = shape.rlike("^99[/.-]99[/.-]9999") & later
    swapped = F.concat(F.lit("dd"), F.substring(form, 3, 1), F.lit("MM"), F.substring(form, 6, 40))
    return F.try_to_timestamp(text, F.when(day_first, swapped).otherwise(form))


def storage(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(storage(df, name), T.NumericType)


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(storage(df, name), T.StringType)


def is_moment(df: DataFrame, name: str) -> bool:
    return isinstance(storage(df, name), (T.DateType, T.TimestampType, T.TimestampNTZType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def other_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, T.NumericType)]


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into null."""
    c = named(name)
    if isinstance(storage(df, name), (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    return c


def number(df: DataFrame, name: str) -> Column:
    """The column as a double, bad or missing cells as null."""
    if is_text(df, name):
        return to_number(named(name))
    if isinstance(storage(df, name), T.BooleanType):
        return named(name).cast("int").cast("double")
    return present(df, name).cast("double")


def moment(df: DataFrame, name: str) -> Column:
    """The column as wall-clock time, bad or missing cells as null."""
    c = to_moment(named(name)) if is_text(df, name) else named(name)
    return c.cast("timestamp_ntz")


def wall_micros(c: Column) -> Column:
    """Microseconds of a wall-clock time since 1970, whatever the session time zone."""
    whole = lambda part, size: part.cast("bigint") * F.lit(size).cast("bigint")
    return (
        whole(F.unix_date(c.cast("date")), 86_400_000_000) + whole(F.hour(c), 3_600_000_000)
        + whole(F.minute(c), 60_000_000) + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")
    )


def spread_rows(names: list[str], rows: list[list[Column]]) -> Column:
    """One output row per inner list: ``select(..., spread_rows(...))``."""
    return F.inline(F.array(*[F.struct(*[c.alias(n) for n, c in zip(names, row)]) for row in rows]))


def any_word(name: str, words: list[str]) -> bool:
    low = name.lower()
    return any(w in low for w in words)
