"""Comment files: CSV with any header spelling to the four raw columns with row numbers."""

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelmill.operators.sizes import broadcast_if_small
from labelmill.staging import staged

RAW_COLUMNS = ("id", "comment_text", "sentiment", "type")

# Header spellings once lower-cased without spaces and underscores.
HEADER_NAMES = {
    "id": "id", "commenttext": "comment_text", "comment": "comment_text", "text": "comment_text",
    "sentiment": "sentiment", "type": "type",
}


# How the cells of one record are read.
CELLS = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
QUOTE = '"'


def header_name(column: str) -> str | None:
    """Which raw column a header names, if any."""
    return HEADER_NAMES.get(re.sub(r"[\s_\ufeff]", "", column.lower()))


def csv_options(multiline: bool = True) -> dict[str, str]:
    return {
        "header": "true", "multiLine": str(multiline).lower(), "quote": '"', "escape": '"',
        "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true",
        "inferSchema": "false", "enforceSchema": "false",
    }


def normalize_headers(df: DataFrame) -> DataFrame:
    """Rename known headers and drop the rest; of several spellings of one name the last wins."""
    source = {}
    for column in df.columns:
        name = header_name(column)
        if name:
            source[name] = column
    null = F.lit(None).cast("string")
    return df.select(
        *[
            (F.col(f"`{source[n]}`").cast("string") if n in source else null).alias(n)
            for n in RAW_COLUMNS
        ],
        *[c for c in ("file", "_block", "_scan") if c in df.columns],
    )


def tag_rows(df: DataFrame) -> DataFrame:
    """Remember where each scanned row sits; call straight on the scan."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_scan"),
    )


def number_tagged(rows: DataFrame) -> DataFrame:
    """``row_no`` from 0 per file. The tagged rows are written first, which fixes the scan order."""
    table = staged(rows, "csv-rows")
    starts = table.groupBy("file", "_block").agg(
        F.count("*").alias("_n"), F.min("_scan").alias("_first")
    )
    # One row per file split.
    earlier = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(
        "file", "_block", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    numbered = table.join(starts, ["file", "_block"])
    return numbered.withColumn("row_no", F.col("_scan") + F.col("_shift")).drop("_block", "_scan", "_shift")


def _open_after_line(line: Column, inside: bool) -> Column:
    """Whether a quoted cell is open behind a line that begins inside one or not.

    A quote opens a cell only at its start, and a doubled quote is text, so the pieces between commas are folded in turn.
    """

    def step(open_: Column, piece: Column) -> Column:
        odd = (F.length(piece) - F.length(F.replace(piece, F.lit(QUOTE), F.lit("")))) % 2 == 1
        return F.when(open_, ~odd).otherwise(F.ltrim(piece, F.lit(" \t")).startswith(QUOTE) & odd)

    folded = F.aggregate(F.split(line, ","), F.lit(inside), step)
    return F.when(F.contains(line, F.lit(QUOTE)), folded).otherwise(F.lit(inside))


def composed(rows: DataFrame, upto) -> DataFrame:
    """Add the composition of the functions ``_if_out``, ``_if_in`` up to each row: the last one that sets a state, and
    the number of turns, in all and up to that one."""
    sets = F.col("_if_out") == F.col("_if_in")
    turns = (F.col("_if_out") & ~F.col("_if_in")).cast("int")
    last_set = F.when(sets, F.struct(F.col("_if_out").alias("open"), F.col("_turns").alias("at")))
    return rows.withColumn("_turns", F.sum(turns).over(upto)).withColumn("_set", F.last(last_set, ignorenulls=True).over(upto))


def open_after(composition: str, before: Column) -> Column:
    """Whether a cell is open behind the functions of a composition, given that before the first of them."""
    turns, last_set = (F.col(f"{composition}{c}") for c in ("_turns", "_set"))
    odd = (turns - F.coalesce(last_set["at"], F.lit(0))) % 2 == 1
    return F.coalesce(last_set["open"], before) != odd


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, record, value`` of every CSV record, numbered from 0 in its file; a record may span lines.

    A file is read by as many tasks as it has blocks. Each line is a function from "a quoted cell is open" to the
    same behind it: it keeps, turns, sets or clears that. A block's lines are composed in order, then the blocks of a file
    by one row each, and every line behind which no cell is open ends a record. Only the lines of records that
    span several are brought together. Blank lines outside quotes are not records. Line ends are line feeds, with or
    without a carriage return before them, and line feeds inside cells. A quote that is never closed makes the rest of
    its file one record.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_scan"),
    )
    lines = staged(
        lines.withColumns({"_if_out": _open_after_line(F.col("value"), False), "_if_in": _open_after_line(F.col("value"), True)}), "csv-lines"
    )
    in_block = Window.partitionBy("file", "_block").orderBy("_scan")
    upto = in_block.rowsBetween(Window.unboundedPreceding, 0)
    scanned = staged(composed(lines, upto).drop("_if_out", "_if_in"), "csv-scanned")

    blocks = scanned.groupBy("file", "_block").agg(F.max_by(F.struct("_turns", "_set"), "_scan").alias("_end"))
    blocks = blocks.select(
        F.col("file").alias("_b_file"), F.col("_block").alias("_b_block"),
        open_after("_end.", F.lit(False)).alias("_if_out"), open_after("_end.", F.lit(True)).alias("_if_in"),
    )
    # One row a block.
    by_file = Window.partitionBy("_b_file").orderBy("_b_block")
    blocks = composed(blocks, by_file.rowsBetween(Window.unboundedPreceding, 0)).withColumn("_open", open_after("", F.lit(False)))
    blocks = blocks.select("_b_file", "_b_block", F.coalesce(F.lag("_open").over(by_file), F.lit(False)).alias("_opened"))
    same_block = (F.col("file") == F.col("_b_file")) & (F.col("_block") == F.col("_b_block"))
    stated = scanned.join(broadcast_if_small(staged(blocks, "csv-blocks")), same_block).drop("_b_file", "_b_block")
    stated = stated.withColumn("_after", open_after("", F.col("_opened")))
    stated = stated.withColumn("_before", F.coalesce(F.lag("_after").over(in_block), F.col("_opened")))
    stated = stated.where(F.col("_before") | (F.col("value") != "")).withColumn(
        "_nth", F.sum((~F.col("_before")).cast("bigint")).over(upto)
    )
    stated = staged(stated.select("file", "_block", "_scan", "value", "_before", "_after", "_nth"), "csv-states")

    counts = stated.groupBy("file", "_block").agg(F.max("_nth").alias("_n"))
    earlier = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        F.col("file").alias("_b_file"), F.col("_block").alias("_b_block"),
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - 1).alias("_shift"),
    )
    numbered = stated.join(broadcast_if_small(staged(counts, "csv-counts")), same_block)
    numbered = numbered.withColumn("record", F.col("_nth") + F.col("_shift"))
    whole = numbered.where("not _before and not _after").select("file", "record", "value")
    ordered = F.array_sort(F.collect_list(F.struct("_block", "_scan", "value")))
    spanning = numbered.where("_before or _after").groupBy("file", "record").agg(
        F.array_join(F.transform(ordered, lambda line: line["value"]), "\n").alias("value")
    )
    return whole.unionByName(spanning)


def parsed(records: DataFrame) -> DataFrame:
    """Raw rows with ``file`` and ``row_no`` of ``file, record, value``, where record 0 is its file's header.

    One row for each distinct header reaches the driver, whatever the number of files.
    """
    records = staged(records, "csv-records")
    header = F.regexp_replace("value", "^\ufeff", "")
    headers = staged(records.where("record = 0").select(F.col("file").alias("_h_file"), header.alias("_header")), "csv-headers")
    rows = records.where("record > 0").join(broadcast_if_small(headers), F.col("file") == F.col("_h_file"))
    cells = {name: F.lit(None).cast("string") for name in RAW_COLUMNS}
    for (line,) in headers.select("_header").distinct().orderBy("_header").collect():
        names = [header_name(n) for n in next(csv.reader([line], skipinitialspace=True), [])]
        row = F.from_csv("value", ", ".join(f"c{i} string" for i in range(len(names))), CELLS)
        # Of several spellings of one name the last counts.
        for name, i in {n: i for i, n in enumerate(names) if n}.items():
            cells[name] = F.when(F.col("_header") == line, row[f"c{i}"]).otherwise(cells[name])
    return rows.select(*[c.alias(n) for n, c in cells.items()], "file", (F.col("record") - 1).alias("row_no"))


def read_comment_csv(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Raw rows with ``file`` and ``row_no``. Each file's own header names its columns.

    ``multiline`` allows newlines inside quotes. Without it every line is a row, found in fewer steps. Both split files.
    """
    if multiline:
        return parsed(read_records(spark, path))
    lines = tag_rows(spark.read.text(path).where(F.trim("value") != ""))
    return parsed(number_tagged(lines).withColumnRenamed("row_no", "record"))
