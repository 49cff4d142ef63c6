"""Column expressions; every one stays inside generated JVM code, none is a Python UDF."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that a text strip removes.
_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
# A character that is no letter with a case, and a mark that no text contains.
_UNCASED, _MARK = r"([^\p{IsUppercase}\p{IsLowercase}\p{IsTitlecase}])", "\uffff "


def as_column(value: Column | str | float | int) -> Column:
    """A column for a name, a literal for a number."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def number(value: Column | str) -> Column:
    """The value as a finite-or-infinite double; unreadable text and NaN become null."""
    parsed = as_column(value).try_cast("double")
    return F.when(~F.isnan(parsed), parsed)


def whole_number(value: Column | str) -> Column:
    """Truncated toward zero; missing or unreadable becomes 0, infinity is an error."""
    parsed = F.coalesce(number(value), F.lit(0.0))
    infinite = F.abs(parsed) == F.lit(float("inf"))
    return F.when(infinite, F.raise_error(F.lit("infinite value in an integer column"))).otherwise(
        parsed
    ).cast("bigint")


def float_number(value: Column | str) -> Column:
    """Missing or unreadable becomes 0.0."""
    return F.coalesce(number(value), F.lit(0.0))


def parsed_date(value: Column | str, formats: tuple[str, ...] = ("yyyy-MM-dd",)) -> Column:
    """Timestamp without zone from text; text that fits no format becomes null."""
    text = as_column(value)
    tries = [
        (F.try_to_timestamp(text, F.lit(f)) if "H" in f else F.try_to_date(text, f)).cast("timestamp_ntz")
        for f in formats
    ]
    return F.coalesce(*tries)


def stripped(value: Column | str) -> Column:
    """Without white space at either end."""
    return F.trim(as_column(value), F.lit(_BLANKS))


def title_case(value: Column | str) -> Column:
    """First letter of every run of letters in upper case, the others in lower case.

    ``initcap`` starts words only after blanks and would give ``O'neil`` for ``O'Neil``, so other
    texts than plain words get a marked blank after every character that ends a run.
    """
    text = as_column(value)
    marked = F.initcap(F.regexp_replace(text, _UNCASED, f"$1{_MARK}"))
    general = F.replace(marked, F.lit(_MARK), F.lit(""))
    return F.when(text.rlike("^[A-Za-z ]*$"), F.initcap(text)).otherwise(general)


def round_half_even(value: Column | str | float, places: int = 2) -> Column:
    """Scale, round half to even, scale back, all in binary doubles."""
    factor = F.lit(10.0**places)
    return F.rint(as_column(value).cast("double") * factor) / factor


def round_half_up(value: Column | str | float, places: int = 2) -> Column:
    """``floor(x * 10^places + 0.5)`` scaled back; the same in every engine with IEEE doubles."""
    factor = F.lit(10.0**places)
    return F.floor(as_column(value).cast("double") * factor + F.lit(0.5)) / factor


def clip(value: Column | str, low: Column | float | None, high: Column | float | None) -> Column:
    """Limit to ``[low, high]``; a missing value stays missing, a missing bound does nothing."""
    column = as_column(value)
    result = column
    if high is not None:
        result = F.when(column > as_column(high), as_column(high)).otherwise(result)
    if low is not None:
        result = F.when(column < as_column(low), as_column(low)).otherwise(result)
    return result


def days_between(start: Column | str, end: Column) -> Column:
    """Whole 24-hour units from ``start`` to ``end``, rounded down; no time zone is involved."""
    elapsed = end.cast("timestamp_ntz") - as_column(start).cast("timestamp_ntz")
    whole = F.extract(F.lit("DAY"), elapsed).cast("bigint")
    return F.when(elapsed < F.make_dt_interval(whole.cast("int")), whole - 1).otherwise(whole)


def month_bucket(value: Column | str, missing: str = "NaT") -> Column:
    """Year and month as text."""
    return F.coalesce(F.date_format(as_column(value), "yyyy-MM"), F.lit(missing))


def recode(value: Column | str, names: dict, default: object = None) -> Column:
    """Replace each key by its value; anything else becomes ``default``."""
    column = as_column(value)
    chain = reduce(
        lambda acc, pair: (F if acc is None else acc).when(column == F.lit(pair[0]), F.lit(pair[1])),
        names.items(),
        None,
    )
    return chain.otherwise(F.lit(default))


# Label texts of the two functions below
def label_churn(value: Column | str) -> Column:
    """Retained or Churned."""
    return recode(value, {0: "Retained", 1: "Churned"})


def label_prediction(value: Column | str) -> Column:
    """Predicted Retained or Predicted Churned."""
    return recode(value, {0: "Predicted Retained", 1: "Predicted Churned"})


def min_max(value: Column | str, low: float, high: float) -> Column:
    """Scale so that ``low`` is 0 and ``high`` is 1; a zero range divides by 1."""
    width = (high - low) or 1.0
    return (as_column(value).cast("double") - F.lit(float(low))) / F.lit(float(width))


def quantile_band(value: Column | str, inner_edges: list[float]) -> Column:
    """Number of the right-closed band that holds ``value``, counted from 1."""
    column = as_column(value).cast("double")
    above = [(column > F.lit(float(e))).cast("int") for e in inner_edges]
    return reduce(lambda a, b: a + b, above, F.when(column.isNotNull(), F.lit(1)))
