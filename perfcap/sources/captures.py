"""Wide counter CSV files -> long samples, series, datasets.

A capture has one header line (column 0 is the time, every other column a counter path) and one line per point
in time.  Many files are read as one job.  Large files are split by Spark like any text; the order of lines in a
file is kept as a number (``ord``) built from the position of the split and of the row in it.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from perfcap.functions import names, parse
from perfcap.operators import normalize, skew
from perfcap.session import cut_lineage

_ROW_BITS = 31
#: Bytes up to which a file is digested whole, and of a piece of larger ones.
DIGEST_WHOLE = 256 << 20
DIGEST_PIECE = 8 << 20
#: Header cells of all files up to which they are broadcast; beyond, lines and headers meet in a salted join.
HEADER_CELLS = 200_000


def file_name(url: Column) -> Column:
    """A path as its owner spells it, from the percent-encoded one that every source gives as metadata."""
    return F.regexp_replace(F.url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")


def open_name(path: str) -> str:
    """The same path for a reader, which takes some characters as patterns."""
    return "".join(f"\\{c}" if c in "[]{}*?\\" else c for c in path)


def file_list(spark: SparkSession, path: str | list[str], glob: str = "*") -> DataFrame:
    """path, url, length and modification time of each file; no file is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    url = F.col("_metadata.file_path")
    return files.select(file_name(url).alias("path"), url.alias("url"), "length", "modificationTime")


def streamed_digests(files: DataFrame) -> DataFrame:
    """(path, sha256) of files (path, url) of any size, read piece by piece."""
    def run(batches):
        import hashlib

        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            out = []
            for path, url in zip(*(c.to_pylist() for c in batch.columns)):
                store, name = (fs.LocalFileSystem(), path) if url.startswith("file:") else fs.FileSystem.from_uri(url)
                digest = hashlib.sha256()
                with store.open_input_stream(name) as f:
                    while piece := f.read(DIGEST_PIECE):
                        digest.update(piece)
                out.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["path", "sha256"])

    return files.select("path", "url").repartition("path").mapInArrow(run, "path string, sha256 string")


def capture_catalog(spark: SparkSession, path: str | list[str], glob: str = "*") -> DataFrame:
    """path, length, modification time, extension and content digest of each file.

    A digest needs the bytes of a file in order, so one task reads one file: whole up to ``DIGEST_WHOLE`` bytes, else
    piece by piece.
    """
    files = file_list(spark, path, glob)
    whole = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    small = whole.where(F.col("length") <= DIGEST_WHOLE).select(
        file_name(F.col("_metadata.file_path")).alias("path"), F.sha2("content", 256).alias("sha256"))
    large = streamed_digests(files.where(F.col("length") > DIGEST_WHOLE))
    return files.join(small.unionByName(large), "path").select(
        "path", "length", "modificationTime", parse.file_extension(F.col("path")).alias("source_type"), "sha256")


def supported(catalog: DataFrame) -> DataFrame:
    """Files this package can read; the source decides by extension."""
    return catalog.where(F.col("source_type") == "csv")


def order_key() -> Column:
    """Order of a line in its file, without a shuffle.

    Splits of one file start at least a kilobyte apart and hold fewer than 2^31 lines; rows of a split keep
    their order within a partition.
    """
    block = F.col("_metadata.file_block_start")
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return F.shiftleft(F.shiftright(block, 10), _ROW_BITS).bitwiseOR(row)


def read_lines(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """(path, block, ord, line) of every non-blank line."""
    text = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path)
    return lines_of(text)


def lines_of(text: DataFrame) -> DataFrame:
    clean = F.regexp_replace("value", "^\ufeff", "")
    return text.where(F.col("value").rlike(r"[^\s\x{feff}]")).select(
        file_name(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("block"),
        order_key().alias("ord"), clean.alias("line"))


def headers_of(lines: DataFrame) -> DataFrame:
    """First line of each file: header cells and machine name.  One row per file, partial ``min_by``."""
    first = lines.where(F.col("block") == 0).groupBy("path").agg(
        F.min_by("line", "ord").alias("header"), F.min("ord").alias("header_ord"))
    cells = parse.split_cells(F.col("header"))
    first = first.withColumn("cells", cells)
    is_pdh = F.lower(parse.unquote(F.get("cells", F.lit(0)))).startswith("(pdh-csv")
    return first.select(
        "path", "header_ord", "cells",
        F.when(is_pdh, names.machine_of(parse.unquote(F.get("cells", F.lit(1))))).alias("machine_name"))


@dataclass
class Captures:
    """Tables of a set of captures."""

    datasets: DataFrame
    series: DataFrame
    samples: DataFrame
    warnings: DataFrame
    rejected: DataFrame


def read_captures(spark: SparkSession, path: str, glob: str = "*.csv", pack_aliases: DataFrame | None = None,
                  machine_name: str | None = None, time_zone: str | None = None, materialize=cut_lineage) -> Captures:
    """Read every capture under ``path``."""
    return captures_from(read_lines(spark, path, glob), capture_catalog(spark, path, glob), pack_aliases,
                         machine_name, time_zone, materialize)


def captures_from(lines: DataFrame, catalog: DataFrame, pack_aliases: DataFrame | None = None,
                  machine_name: str | None = None, time_zone: str | None = None, materialize=cut_lineage) -> Captures:
    """Tables of captures given as lines and a catalog with digests.

    The text is read three times: for the head lines, for the times of all lines, for the samples.  The first two
    (one row per file; one narrow row per line) and the catalog are written once (``materialize``), because
    datasets, series, warnings and samples all use them.
    """
    keep = materialize or (lambda df: df)
    # Equal files are a dataset each; the copies are numbered.
    copy = F.row_number().over(Window.partitionBy("sha256").orderBy("path"))
    named_by = names.dataset_id(F.col("sha256"))
    ids = keep(catalog.select("path", F.col("sha256").alias("input_digest"), "source_type", named_by.alias("_id"), copy.alias("_copy")).select(
        "path", "input_digest", "source_type",
        F.when(F.col("_copy") == 1, F.col("_id")).otherwise(F.concat_ws("_", "_id", "_copy")).alias("dataset_id")))
    headers = keep(headers_of(lines).join(ids, "path"))

    columns = headers.select(
        "dataset_id", F.posexplode("cells").alias("series_ord", "counter_path")).where("series_ord > 0")
    metrics = normalize.resolve_metrics(columns, pack_aliases)
    series = columns.join(metrics, "counter_path").select(
        "dataset_id", names.series_id(F.col("series_ord")).alias("series_id"), "series_ord", "counter_path", "metric",
        names.instance_of(F.col("counter_path")).alias("instance"), F.lit(None).cast("string").alias("unit"))

    # Per file: what each column is, in order, so that samples carry metric and instance without another join.
    named = series.groupBy("dataset_id").agg(F.array_sort(F.collect_list(F.struct(
        "series_ord", "series_id", "metric", "instance"))).alias("_columns"))  # as wide as one header line
    heads = headers.select("path", "dataset_id", "header_ord")
    small = materialize is not None and (headers.agg(F.sum(F.size("cells"))).first()[0] or 0) <= HEADER_CELLS

    def of_file(rows: DataFrame, files: DataFrame) -> DataFrame:
        """Each line with what is known of its file; a file may hold most of all lines."""
        if small:
            return rows.join(F.broadcast(files), "path")
        return skew.salted_join(rows, files, ["path"], F.col("ord"))

    stamp = parse.first_cell(F.col("line"))
    wide = of_file(lines, heads.join(named, "dataset_id")).where(F.col("ord") != F.col("header_ord"))
    wide = wide.withColumn("ts", parse.parse_ts(stamp)).where(F.col("ts").isNotNull())
    # Cells beside their columns, cut once for each line; what either side has beyond the other stays null.
    wide = wide.withColumn("_cells", F.slice(parse.split_cells(F.col("line")), 2, 1 << 30))
    samples = wide.select("dataset_id", "ts", "ord", F.explode(F.arrays_zip("_columns", "_cells")).alias("z")).where("z._columns is not null").select(
        "dataset_id", "z._columns.series_id", "z._columns.series_ord", "z._columns.metric", "z._columns.instance", "ts",
        parse.parse_value(F.col("z._cells")).alias("value"), "ord")

    marks = of_file(lines, heads).withColumn("_stamp", stamp).withColumn("ts", parse.parse_ts(F.col("_stamp")))
    marks = keep(marks.select(
        "path", "block", "ord", "dataset_id", (F.col("ord") == F.col("header_ord")).alias("_head"), "ts",
        F.when(F.col("ts").isNull(), F.col("_stamp")).alias("_stamp")))
    quality = line_quality(marks.where(~F.col("_head") & F.col("ts").isNotNull()).select("dataset_id", "ts", "ord"))
    sizes = series.groupBy("dataset_id").agg(F.count("*").alias("series_count"))
    datasets = headers.select(
        "dataset_id", "path", "input_digest", "source_type",
        F.coalesce(F.lit(machine_name), "machine_name").alias("machine_name"),
        F.lit(time_zone).cast("string").alias("time_zone")).join(quality, "dataset_id").join(
        sizes, "dataset_id", "left").select(
        "*", (F.coalesce("series_count", F.lit(0)) * F.col("row_count")).alias("sample_count"))

    valid = marks.where(~F.col("_head") & F.col("ts").isNotNull()).select("dataset_id").distinct()
    rejected = ids.join(valid, "dataset_id", "left_anti").select(
        "path", "dataset_id", F.lit("no parseable data rows").alias("reason"))
    return Captures(datasets, series, samples, bad_line_warnings(marks), rejected)


def line_quality(stamps: DataFrame) -> DataFrame:
    """Start, end, rows, nominal interval and gaps per dataset, in file order.

    Neighbouring lines are paired within a split (plus the last line of the split before), so a long file is
    never ordered by one task.
    """
    ordered = skew.running(stamps, ["dataset_id"], ["ord"], F.shiftright("ord", _ROW_BITS + 17),
                           {"_prev": ("last", F.col("ts"))})
    ordered = ordered.withColumn("_diff", (F.unix_micros("ts") - F.unix_micros("_prev")) / F.lit(1e6))
    totals = ordered.groupBy("dataset_id").agg(
        F.min_by("ts", "ord").alias("start_time"), F.max_by("ts", "ord").alias("end_time"),
        F.count("*").alias("row_count"),
        F.min_by("_diff", F.when(F.col("_diff").isNotNull(), F.col("ord"))).alias("_nominal"))
    joined = skew.salted_join(ordered.select("dataset_id", "ord", "_diff"), totals.select("dataset_id", "_nominal"),
                              ["dataset_id"], F.col("ord"))
    gaps = joined.groupBy("dataset_id").agg(F.count_if(
        F.abs(F.col("_diff") - F.col("_nominal")) > 0.5 * F.col("_nominal")).alias("gap_count"))
    return totals.join(gaps, "dataset_id").select(
        "dataset_id", "start_time", "end_time", "row_count",
        F.coalesce("_nominal", F.lit(0.0)).alias("sample_interval_seconds"), "gap_count")


def bad_line_warnings(marks: DataFrame) -> DataFrame:
    """A warning per line whose time cannot be read, with its number among the non-blank lines."""
    row = F.col("ord").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    blocks = marks.groupBy("path", "block").agg(F.min(row).alias("_row0"), F.count("*").alias("_n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    unread = marks.where(~F.col("_head") & F.col("ts").isNull() & (F.trim("_stamp") != ""))
    bad = unread.join(blocks, ["path", "block"])
    number = row - F.col("_row0") + F.col("_before") + 1
    return bad.select(
        "dataset_id", F.lit("collector.warning").alias("code"),
        F.format_string("line %d left out: no time in '%s'", number, F.col("_stamp"))
        .alias("message"), F.lit("warning").alias("severity"), number.alias("ord"))


def read_host_context(spark: SparkSession, path: str, datasets: DataFrame, memory_mb: float | None = None,
                      processors: int | None = None, name: str = "host-context.json") -> DataFrame:
    """Host variables per dataset: explicit values win as a pair, else the side file of the folder, else unknown."""
    if memory_mb is not None or processors is not None:
        return datasets.select(
            "dataset_id", F.lit(memory_mb).cast("double").alias("total_physical_memory_mb"),
            F.lit(processors).cast("int").alias("logical_processor_count"))
    side = (
        spark.read.option("multiLine", True).option("pathGlobFilter", name).option("recursiveFileLookup", True)
        .schema("TotalPhysicalMemoryMb DOUBLE, LogicalProcessorCount INT").json(path)
        .select(_folder(file_name(F.col("_metadata.file_path"))).alias("_folder"),
                F.col("TotalPhysicalMemoryMb").alias("total_physical_memory_mb"),
                F.col("LogicalProcessorCount").alias("logical_processor_count")))
    return datasets.select("dataset_id", _folder(F.col("path")).alias("_folder")).join(side, "_folder", "left").select(
        "dataset_id", "total_physical_memory_mb", "logical_processor_count")


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def dedup_uploads(uploads: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """First upload of each content in a workspace (by time, then id); contents already known are left out.

    ``min_by`` keeps one candidate per map task, so a content copied a million times shuffles a few rows.
    """
    order = F.struct("created_at", "upload_id")
    rest = [c for c in uploads.columns if c not in ("workspace_id", "sha256")]
    first = uploads.groupBy("workspace_id", "sha256").agg(F.min_by(F.struct(*rest), order).alias("_first"))
    first = first.select("workspace_id", "sha256", "_first.*").select(*uploads.columns)
    if existing is not None:
        first = first.join(existing.select("workspace_id", "sha256").distinct(), ["workspace_id", "sha256"], "left_anti")
    return first


def pick_files(catalog: DataFrame, now: Column, stable_s: int = 30, cursor: Column | None = None,
               limit: int = 10) -> DataFrame:
    """Newest ``limit`` files that no longer change and are newer than the cursor (less two minutes)."""
    modified = F.col("modificationTime")
    ready = catalog.where(F.unix_micros(modified) <= F.unix_micros(now) - stable_s * 1_000_000)
    if cursor is not None:
        ready = ready.where(cursor.isNull() | (F.unix_micros(modified) > F.unix_micros(cursor) - 120_000_000))
    return ready.orderBy(F.col("modificationTime").desc(), "path").limit(limit)
