"""Line scans of log trees, and JSON lines as rows.

A *lines* DataFrame has ``file_path``, ``chunk`` and ``pos`` beside ``value``. Within a file,
(``chunk``, ``pos``) is the order of the lines: a scan uses the start of the file block and a row
id that grows inside it. ``chunk`` bounds how much of one file a single task has to order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

POSITION = ["file_path", "chunk", "pos"]
BLANKS = " \t\r\n\f\x0b"
#: JSON as a strict reader sees it; the reader's lenient quoting is switched off.
STRICT_JSON = {"allowSingleQuotes": "false"}


def plain_path(uri: Column) -> Column:
    """File URI without percent escapes (``+`` stays as it is)."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def scan_logs(
    spark: SparkSession, path: str | list[str], glob: str = "*.jsonl", keep_blank: bool = False
) -> DataFrame:
    """All lines of the matching files below ``path``, trimmed, blank lines left out."""
    return positioned(
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path),
        keep_blank,
    )


def stream_logs(
    spark: SparkSession, path: str, glob: str = "*.jsonl", files_per_trigger: int | None = None
) -> DataFrame:
    """``scan_logs`` as a file stream: every new file is read once."""
    reader = (
        spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    )
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path).select(
        plain_path(F.col("_metadata.file_path")).alias("file_path"),
        F.col("_metadata.file_block_start").alias("chunk"),
        "value",
    )


def positioned(text: DataFrame, keep_blank: bool = False) -> DataFrame:
    """Add file, chunk and position to a text scan."""
    lines = text.select(
        plain_path(F.col("_metadata.file_path")).alias("file_path"),
        F.col("_metadata.file_block_start").alias("chunk"),
        F.monotonically_increasing_id().alias("pos"),
        F.trim(F.col("value"), F.lit(BLANKS)).alias("value"),
    )
    return lines if keep_blank else lines.filter(F.col("value") != "")


def list_files(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """Current files with modification time and size; no content is read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(path)
    )
    # The metadata comes from the listing, so it stays what it was when this was called.
    return files.select(
        plain_path(F.col("_metadata.file_path")).alias("file_path"),
        (F.unix_micros("_metadata.file_modification_time") * 1000).alias("mtime_ns"),
        F.col("_metadata.file_size").alias("size_bytes"),
    )


def json_rows(lines: DataFrame, ddl: str, keep_value: bool = False) -> DataFrame:
    """Each line's JSON object as struct column ``j``, null where the line is not one object.

    The line is read as the only element of an array: text after the object then makes it
    invalid, as for a strict reader. The generator keeps the parse in one place, because filters
    on ``j`` are not pushed (and so not evaluated twice) below it.
    """
    parsed = F.from_json(
        F.concat(F.lit("["), F.col("value"), F.lit("]")), f"array<{ddl}>", STRICT_JSON
    )
    single = F.transform(F.array(parsed), lambda a: F.when(F.size(a) == 1, F.get(a, F.lit(0))))
    others = [c for c in lines.columns if keep_value or c != "value"]
    return lines.select(*others, F.explode(single).alias("j"))


def valid_json(value: Column) -> Column:
    """Whether a text is exactly one JSON value."""
    parsed = F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>", STRICT_JSON)
    return F.coalesce(F.size(parsed), F.lit(0)) == 1


def malformed_lines(lines: DataFrame) -> DataFrame:
    """Lines that are not valid JSON, with file and 1-based line number.

    ``lines`` must hold the blank lines too, as they count. Numbers come from two levels: the
    lines of earlier chunks of the file, then the position inside the chunk, so no task has to
    order a whole file.
    """
    by_chunk = Window.partitionBy("file_path").orderBy("chunk")
    starts = (
        lines.groupBy("file_path", "chunk")
        .agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
        .select(
            "file_path",
            "chunk",
            "first_pos",
            F.coalesce(
                F.sum("n").over(by_chunk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("before"),
        )
    )
    bad = lines.filter((F.col("value") != "") & ~valid_json(F.col("value")))
    return bad.join(starts, ["file_path", "chunk"]).select(
        "file_path",
        (F.col("before") + F.col("pos") - F.col("first_pos") + 1).alias("line_no"),
        "value",
    )
