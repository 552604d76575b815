"""Number and expression text."""

from pyspark.sql import Column, functions as F


def general(number: Column) -> Column:
    """Shortest general text of a double: ``80``, ``0.05``, ``1E+16``, ``1E-05``."""
    java = number.cast("string")
    plain = F.regexp_replace(
        F.regexp_replace(java.try_cast("decimal(38,22)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    mantissa = F.regexp_replace(F.substring_index(java, "E", 1), r"\.0$", "")
    exponent = F.substring_index(java, "E", -1).try_cast("int")
    scientific = F.concat(
        mantissa, F.when(exponent < 0, "E-").otherwise("E+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    size = F.abs(number)
    return (
        F.when(F.isnan(number), "NaN")
        .when(number == 0, "0")
        .when(size == float("inf"), F.when(number > 0, "Infinity").otherwise("-Infinity"))
        .when((size >= 1e15) | (size < 1e-4), scientific)
        .otherwise(plain)
    )


def fixed2(number: Column) -> Column:
    return F.format_string("%.2f", number)


def operator_symbol(op: Column) -> Column:
    return (
        F.when(op == "gt", ">").when(op == "ge", ">=").when(op == "lt", "<")
        .when(op == "le", "<=").when(op == "eq", "==").otherwise(op)
    )


def window_label(seconds: Column) -> Column:
    def unit(size, letter):
        return F.concat((seconds / size).cast("long").cast("string"), F.lit(letter))

    return (
        F.when(seconds % 3600 == 0, unit(3600, "h")).when(seconds % 60 == 0, unit(60, "m"))
        .otherwise(unit(1, "s"))
    )


def trigger_expression(c, threshold: Column) -> Column:
    """Text of a condition; ``c(name)`` gives the condition's columns."""
    metric = F.when(c("instance").isNull(), c("metric")).otherwise(
        F.concat(c("metric"), F.lit("["), c("instance"), F.lit("]")))
    call = F.concat(c("aggregation"), F.lit("("), metric, F.lit(")"))
    test = F.concat(operator_symbol(c("operator")), F.lit(" "), general(threshold))
    share = F.when(
        c("duration_percent") > 1.0,
        F.concat(F.lit(" for >= "), general(c("duration_percent")), F.lit("% of samples"))).otherwise("")
    windowed = F.concat(call, F.lit(" over "), window_label(c("window_s")), F.lit(" rolling window "), test)
    return F.when(c("window_s").isNotNull(), windowed).otherwise(F.concat(call, F.lit(" "), test, share))


def escape_html(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;"))
    for raw, safe in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def escape_pipe(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit("\\|"))
