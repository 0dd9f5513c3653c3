"""File-level sources: link CSV files in UTF-8 or cp1251, call-recording listings, and the
per-source summary / presence checks of a data folder."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.calls import basename
from riskloom.session import stored

# File-name patterns per source kind and which sources are required.
SOURCE_PATTERNS = [
    ("amplitude_chunks", r"^train_amplitude_chunk_.*\.parquet$", False),
    ("applications", r"^train_app_data\.parquet$", False),
    ("labels", r"^train_target_data\.parquet$", True),
    ("link_table", r"^(svod|свод)\.csv$|свод.*\.csv$", False),
    ("audio", r"\.(wav|mp3|flac)$", False),
]
CALL_NAME = r"\.(wav|mp3|flac)$"
# The upper half of cp1251, by its Latin-1 code; 0x98 has no character there.
LATIN1_UPPER = bytes(range(0x80, 0x100)).decode("latin-1")
CP1251_UPPER = bytes(range(0x80, 0x100)).decode("cp1251", "replace")
REJECT = "link_reject"


def read_link_csv(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """All link CSV files of a folder, union by header name, tagged with ``source_file`` and the row order
    ``link_row`` (file, block, line).  ``link_reject`` holds the text of a row that does not fit its header.

    One pass over the lines finds each file's header, its charset (UTF-8 if all lines are valid, else
    cp1251) and whether a quoted value spans lines; one row per file comes to the driver, which lists the
    files anyway.  Files alike in these are read together, by Spark's CSV reader or, where a value
    spans lines, by ``_spanning_records``; both split files.  Columns keep their place under a blank or repeated header cell, which has no name and
    is left out.  Files without a line give no rows."""
    lines = spark.read.option("pathGlobFilter", glob).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    first = F.min_by(F.when(F.col("block") == 0, F.col("value").cast("binary")), F.when(F.col("block") == 0, F.col("line")))
    facts = lines.groupBy("file").agg(first.alias("header"), F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
                                      F.bool_or(quotes % 2 != 0).alias("spans"))
    groups: dict[tuple, list[str]] = {}
    for r in facts.orderBy("file").collect():
        if r["header"] is not None:
            groups.setdefault((bytes(r["header"]), r["utf8"], r["spans"]), []).append(r["file"])
    parts = [_read_alike(spark, files, *kind) for kind, files in groups.items()]
    if not parts:
        return spark.createDataFrame([], f"source_file string, link_row struct<file: string, block: long, line: long>, {REJECT} string")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _read_alike(spark: SparkSession, files: list[str], header: bytes, utf8: bool, spans: bool) -> DataFrame:
    cells = next(csv.reader([header.decode("utf-8-sig" if utf8 else "cp1251", "replace").rstrip("\r")]))
    names = [c if c.strip() and c not in cells[:i] else None for i, c in enumerate(cells)]
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(cells))] + [T.StructField("_bad", T.StringType())])
    if spans:
        records = _spanning_records(spark, files, utf8)
        options = {"escape": '"', "columnNameOfCorruptRecord": "_bad"}
        rows = records.select(F.from_csv("record", schema.simpleString()[len("struct<"):-1].replace(":", " "), options).alias("_r"), "file", "block", "line").select("_r.*", "file", "block", "line")
        uri, block, line = F.col("file"), F.col("block"), F.col("line")
    else:
        rows = spark.read.schema(schema).csv(
            files, header=True, enforceSchema=True, encoding="UTF-8" if utf8 else "ISO-8859-1", columnNameOfCorruptRecord="_bad", escape='"')
        uri, block, line = F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()

    def text(c: str) -> Column:
        return F.col(c) if utf8 else F.translate(F.col(c), LATIN1_UPPER, CP1251_UPPER)

    place = F.struct(uri.alias("file"), block.alias("block"), line.alias("line"))
    return rows.select(*[text(f"_c{i}").alias(n) for i, n in enumerate(names) if n is not None],
                       uri.alias("source_file"), place.alias("link_row"), text("_bad").alias(REJECT))


# A quote opens a value only at its beginning; inside, two quotes stand for one.
QUOTED = r'(^|,)"[^"]*+(?:""[^"]*+)*+"(?=,|\r?$)'
CLOSING = r'^[^"]*+(?:""[^"]*+)*+"'


def _spanning_records(spark: SparkSession, files: list[str], utf8: bool) -> DataFrame:
    """Records of CSV files whose quoted values may hold line breaks: file, block, line (of the record's first line) and record.

    The files are read as lines, split.  A line maps the state it begins in (inside a quoted value or not) to the
    state it ends in; a map is the same as the other's, the opposite, or a constant.  The maps of a split's
    lines make one map, and those of a file's splits (a row each) running over the splits give the state every split begins
    in; a second pass from there gives the state of every line.  Lines that begin and end outside a value are records
    as they are; only the others are gathered.  A value that is never closed takes the rest of its file with it, as it
    does in a reader that takes the file in one piece."""
    raw = F.col("value") if utf8 else F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    lines = spark.read.option("lineSep", "\n").text(files).select(
        raw.alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))

    def opens(text: Column) -> Column:
        return F.regexp_replace(text, QUOTED, "$1").rlike('(^|,)"')

    closes = F.col("text").rlike(CLOSING)
    lines = lines.withColumn("_out", opens(F.col("text"))).withColumn("_in", ~closes | opens(F.regexp_replace("text", CLOSING, "")))
    # a constant map ends in one state; the opposite map swaps them
    lines = lines.withColumn("_const", F.when(F.col("_out") == F.col("_in"), F.col("_out").cast("int"))).withColumn("_swap", (F.col("_out") & ~F.col("_in")).cast("int"))

    split, at = ["file", "block"], Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    swaps = (F.sum("_swap").over(at) % 2).cast("int")
    lines = lines.withColumn("_swaps", swaps).withColumn("_set", F.col("_const").bitwiseXOR(F.col("_swaps")))
    # _set: what the state before the split's swaps must have been for the constant to hold; state = _set xor _swaps
    lines = lines.withColumn("_base", F.last("_set", ignorenulls=True).over(at))
    ends = lines.groupBy(*split).agg(F.max_by("_base", "line").alias("_base"), F.max_by("_swaps", "line").alias("_swaps"), F.min("line").alias("_first"))
    over = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    # a split's map: constant (_base xor _swaps), or _swaps
    ends = ends.withColumn("_c", F.col("_base").bitwiseXOR(F.col("_swaps"))).withColumn("_s", F.when(F.col("_base").isNull(), F.col("_swaps")).otherwise(0))
    ends = ends.withColumn("_n", (F.sum("_s").over(over) % 2).cast("int")).withColumn("_b", F.last(F.col("_c").bitwiseXOR(F.col("_n")), ignorenulls=True).over(over))
    ends = ends.withColumn("_after", F.coalesce("_b", F.lit(0)).bitwiseXOR(F.col("_n")))
    states = ends.select(*split, F.coalesce(F.lag("_after").over(Window.partitionBy("file").orderBy("block")), F.lit(0)).alias("_start"))
    states = stored(states, "split-states")  # a row per split: Spark broadcasts it exactly while it is small
    after = F.coalesce("_base", "_start").bitwiseXOR(F.col("_swaps"))
    lines = lines.join(states, split).withColumn("_after", after)
    before = F.coalesce(F.lag("_after").over(Window.partitionBy(*split).orderBy("line")), F.col("_start"))
    lines = lines.withColumn("_before", before).select("file", "block", "line", "text", "_before", "_after")

    whole = lines.where("_before = 0 AND _after = 0").select(*split, "line", F.col("text").alias("record"))
    parts = stored(lines.where("_before = 1 OR _after = 1"), "spanning-lines")
    # a part belongs to the last line before it that began a record: in its split, or else in an earlier one
    begins = F.when(F.col("_before") == 0, F.struct("block", "line"))
    parts = parts.withColumn("_own", F.last(begins, ignorenulls=True).over(at))
    last = parts.groupBy(*split).agg(F.max_by("_own", "line").alias("_last"))
    carried = stored(last.select(*split, F.last("_last", ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried")), "split-records")
    parts = parts.join(carried, split).withColumn("_rec", F.coalesce("_own", "_carried"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("block", "line", "text"))), lambda x: x["text"])
    spanning = parts.groupBy("file", "_rec").agg(F.array_join(texts, "\n").alias("record")).select("file", "_rec.block", "_rec.line", "record")
    heads = lines.where("block = 0").groupBy("file").agg(F.min("line").alias("line"))
    records = whole.unionByName(spanning).withColumn("record", F.regexp_replace("record", "\\r$", ""))
    return records.where("record <> ''").join(heads.withColumn("block", F.lit(0).cast("long")), ["file", "block", "line"], "left_anti")


def call_files(listing: DataFrame, folder: str) -> DataFrame:
    """Call recordings directly inside ``folder`` out of a file listing (path, file_size): path, name, size.

    The listing may be a folder scan or a storage inventory table; folders below are not entered."""
    below = F.substring_index(F.col("path"), folder.rstrip("/") + "/", -1)
    inside = F.contains("path", F.lit(folder.rstrip("/") + "/")) & ~F.contains(below, F.lit("/"))
    return listing.where(inside & below.rlike(CALL_NAME)).select("path", basename(F.col("path")).alias("file_name"), "file_size")


def list_call_files(spark: SparkSession, path: str) -> DataFrame:
    """``call_files`` of a folder (content not read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    return call_files(files.select("path", F.col("length").alias("file_size")), path)


def _folder_files(spark: SparkSession, path: str, patterns: list[tuple[str, str, bool]]) -> DataFrame:
    """Files below the folder with the source kind that the name of the file or of its top folder gives."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rest = F.substring_index(F.col("path"), path.rstrip("/") + "/", -1)
    files = files.select("path", "length", F.substring_index(rest, "/", 1).alias("name"), basename(F.col("path")).alias("_file"))
    kind = None
    for k, rx, _ in patterns:
        fits = F.col("name").rlike(rx) | F.col("_file").rlike(rx)
        kind = F.when(fits, k) if kind is None else kind.when(fits, k)
    return files.withColumn("kind", kind).where(F.col("kind").isNotNull())


def source_summary(spark: SparkSession, path: str, patterns: list[tuple[str, str, bool]] | None = None) -> DataFrame:
    """Per source kind: number of sources (files, or folders of part files), files, bytes, present flag, required flag, and rows of its
    Parquet files, which their footers tell (a scan of no column)."""
    patterns = patterns or SOURCE_PATTERNS
    files = _folder_files(spark, path, patterns)
    counted = files.groupBy("kind").agg(F.count_distinct("name").alias("n_sources"), F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("bytes"))
    tables = files.where(F.lower("path").endswith(".parquet")).select("kind", "path").orderBy("path").collect()  # the listing the driver makes anyway
    of = dict.fromkeys((r["kind"] for r in tables))
    rows = [spark.read.option("ignoreCorruptFiles", "true").parquet(*[r["path"] for r in tables if r["kind"] == k])
            .agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(k).alias("kind"), "n_rows") for k in of]
    kinds = spark.createDataFrame([(k, req, i) for i, (k, _, req) in enumerate(patterns)],
                                  "kind string, required boolean, ord int")  # one row per source kind
    counts = reduce(DataFrame.unionByName, rows) if rows else spark.createDataFrame([], "kind string, n_rows long")
    return kinds.join(counted, "kind", "left").join(counts, "kind", "left").select(
        "ord", "kind", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_sources", "n_files", "bytes")], "n_rows",
        (F.coalesce("n_files", F.lit(0)) > 0).cast("int").alias("present"), F.col("required").cast("int").alias("required"))


def source_presence(summary: DataFrame) -> DataFrame:
    """Checks: a missing required source fails, a missing optional one warns."""
    return summary.select("kind", "required", "present", F.when(F.col("present") == 1, "ok")
                          .when(F.col("required") == 1, "error").otherwise("warning").alias("status"))
