"""Counter paths, metric names and ids."""

from pyspark.sql import Column, functions as F

from perfcap import fixed


def machine_of(path: Column) -> Column:
    r"""``\\MACHINE\Object\Counter`` -> MACHINE, NULL for a relative path."""
    return F.nullif(F.regexp_extract(path, r"^\\\\([^\\]+)\\", 1), F.lit(""))


def instance_of(path: Column) -> Column:
    """Instance in the object segment; parentheses of the counter name don't count."""
    segment = F.regexp_replace(path, r"\\[^\\]*$", "")
    return F.nullif(F.regexp_extract(segment, r"\(([^(]*)\)[^()]*$", 1), F.lit(""))


def unknown_metric(path: Column) -> Column:
    cleaned = F.lower(F.regexp_replace(path, r"[^\p{L}\p{Nd}]", "_"))
    return F.concat(F.lit("unknown."), F.btrim(cleaned, F.lit("_")))


def is_canonical(metric: Column) -> Column:
    """Non-blank, lower case, without blank or percent sign; never null."""
    ok = (F.trim(metric) != "") & (metric == F.lower(metric)) & ~metric.rlike("[ %]")
    return F.coalesce(ok, F.lit(False))


def path_instance(path: Column) -> Column:
    """Text between the last ``(`` and the last ``)`` of the whole path, or empty."""
    return F.regexp_extract(path, r"\(([^(]*)\)[^()]*$", 1)


def strip_instance(path: Column) -> Column:
    """Path without the span from the last ``(`` to the last ``)``."""
    tail = F.substring_index(path, "(", -1)
    head = F.left(path, F.length(path) - F.length(tail) - 1)
    return F.when(F.contains(path, F.lit("(")), F.concat(head, F.substring_index(path, ")", -1))).otherwise(path)


def series_id(ordinal: Column) -> Column:
    """Column ordinal (from 1) -> ``ser_001``."""
    return F.format_string("ser_%03d", ordinal)


def dataset_id(digest: Column) -> Column:
    return F.concat(F.lit("ds_"), F.substring(digest, 1, 16))


def glob_to_regex(glob: Column) -> Column:
    """``*`` and ``?`` become wildcards, everything else is literal."""
    escaped = F.regexp_replace(glob, r"([\\.+^$|()\[\]{}#\s])", r"\\$1")
    return F.replace(F.replace(escaped, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit("."))


def like_regex(path: Column, pattern: Column) -> Column:
    """Unanchored, case-insensitive match."""
    return F.regexp_like(path, F.concat(F.lit("(?i)"), pattern))


def iso_ticks(ts: Column) -> Column:
    """UTC timestamp with seven fraction digits and offset, as hashed into ids."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0+00:00"))


def base32_of_hex(hex_text: Column) -> Column:
    """Base32 of 10 bytes given as 20 hex digits: four groups of 20 bits."""
    chars = []
    for group in range(4):
        bits = F.conv(F.substring(hex_text, group * 5 + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            index = F.shiftright(bits, shift).bitwiseAND(F.lit(31))
            chars.append(F.substring(F.lit(fixed.BASE32), index + F.lit(1), F.lit(1)))
    return F.concat(*chars)


def finding_id(rule: Column, metric: Column, start: Column, end: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", rule, metric, iso_ticks(start), iso_ticks(end)), 256)
    return F.concat(F.lit("fd_"), base32_of_hex(F.substring(digest, 1, 20)))


def report_id(digest: Column, pack_versions: Column) -> Column:
    """``pack_versions``: array of ``pack@version`` sorted by pack."""
    text = F.array_join(F.concat(F.array(digest), pack_versions), "|")
    return F.concat(F.lit("rep_"), F.substring(F.sha2(text, 256), 1, 20))


def insight_id(run: Column, source: Column, key: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", run, source, key), 256), 1, 16)
