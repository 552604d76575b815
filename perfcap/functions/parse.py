"""Parsing of capture lines: cells, timestamps, numbers."""

from pyspark.sql import Column, functions as F

# A quote toggles quoting anywhere in a cell; an open quote runs to the end of the line.
_CELL = r',((?:[^",]++|"[^"]*+"?+)*+)'

# (shape of the text, Spark datetime pattern); the first matching shape decides.
_TIMESTAMP_SHAPES = [
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}\.\d{3} [AaPp][Mm]$", "M/d/yyyy h:mm:ss.SSS a"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}\.\d{3}$", "M/d/yyyy H:mm:ss.SSS"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "M/d/yyyy H:mm:ss"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2} [AaPp][Mm]$", "M/d/yyyy h:mm:ss a"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2} [AaPp][Mm]$", "M/d/yyyy h:mm a"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "M/d/yyyy H:mm"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
]
# ISO dates with optional time, fraction, zone: Spark's own cast reads them.
_ISO = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,7})?)? ?(Z|[+-]\d{2}:?\d{2})?)?$"

# Other common forms: the year first with slashes, the month first with hyphens, the month by name (with weekday and GMT or not).
_YEAR_FIRST = r"^\d{4}/\d{1,2}/\d{1,2}( \d{1,2}:\d{2}(:\d{2}(\.\d{1,7})?)?)?$"
_MONTH_FIRST = r"^\d{1,2}-\d{1,2}-\d{4}( \d{1,2}:\d{2}(:\d{2}(\.\d{3})?)?)?$"
_NAMED = r"^\d{1,2} [A-Za-z]{3} \d{4}( \d{1,2}:\d{2}(:\d{2})?)?$"

_DIGITS = r"(\d[\d,]*\.?\d*|\.\d+)([eE][+-]?\d+)?"


def split_cells(line: Column) -> Column:
    """Array of the raw cells of a line (quotes kept)."""
    return F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_CELL), F.lit(1))


def first_cell(line: Column) -> Column:
    """First raw cell, without splitting the rest."""
    return F.regexp_extract(F.concat(F.lit(","), line), "^" + _CELL, 1)


def unquote(cell: Column) -> Column:
    return F.btrim(cell, F.lit('"'))


def parse_ts(cell: Column) -> Column:
    """Timestamp of a cell, UTC assumed; NULL when no format fits."""
    text = F.trim(unquote(cell))
    expr = None
    for shape, pattern in _TIMESTAMP_SHAPES:
        parsed = F.try_to_timestamp(F.upper(text), F.lit(pattern))
        cond = text.rlike(shape)
        expr = F.when(cond, parsed) if expr is None else expr.when(cond, parsed)
    named = F.regexp_replace(text, "^[A-Za-z]{3}, | (GMT|UTC)$", "")
    return (
        expr.when(text.rlike(_ISO), text.try_cast("timestamp"))
        .when(text.rlike(_YEAR_FIRST), F.replace(text, F.lit("/"), F.lit("-")).try_cast("timestamp"))
        .when(text.rlike(_MONTH_FIRST), F.try_to_timestamp(text, F.lit("M-d-yyyy[ H:mm[:ss[.SSS]]]")))
        .when(named.rlike(_NAMED), F.try_to_timestamp(named, F.lit("d MMM yyyy[ H:mm[:ss]]"))))


def parse_value(cell: Column) -> Column:
    """Number of a cell: thousands commas, signs and exponents allowed; else NULL."""
    text = F.trim(unquote(cell))
    plain = F.replace(text, F.lit(","), F.lit(""))
    number = plain.try_cast("double")
    inner = F.regexp_replace(plain, r"[()+\-\s]+$|^[(\s]+", "")
    return (
        F.when(text.rlike(rf"^[+-]?{_DIGITS}$"), number)
        .when(text.rlike(rf"^\({_DIGITS}\)$|^{_DIGITS}-$"), -inner.try_cast("double"))
        .when(text.rlike(rf"^{_DIGITS}\+$"), inner.try_cast("double"))
        .when(text.rlike(r"^(?i)[+-]?nan$"), F.lit(float("nan")))
        .when(text.rlike(r"^(?i)\+?infinity$"), F.lit(float("inf")))
        .when(text.rlike(r"^(?i)-infinity$"), F.lit(float("-inf")))
    )


def file_extension(path: Column) -> Column:
    """Lower-case extension without the dot; empty when there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
