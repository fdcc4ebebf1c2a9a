"""Candle CSV uploads at scale: encodings and headers by file, bad records in a quarantine.

Files are read as lines of raw bytes, so nothing of a file is held whole and no encoding is
assumed: a file whose lines are all valid UTF-8 is UTF-8, any other is taken as Latin-1, which maps
every byte. The header of a file is its line that names the required columns, in any case and
order, with any others between; a file without one is rejected. Lines are split by the rules of
quoted CSV and read by the header's places.

A record goes to the quarantine, with its file, text and reason, if its file has no header
(``no header``) or it has more or fewer fields than the header (``field count``); in strict mode
also if a required number is missing or not a number (``not a number: <column>``), as the prediction
path demands, else that number is null, as in the upload path. Epochs of a file whose latest is
above 1e10 are milliseconds. Kept and quarantined records and headers add up to the lines.

Facts of a file (encoding, header, largest epoch) are aggregates of one row for each file,
combined in the map tasks, and joined back; Spark broadcasts them if they are small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ("timestamp", "open", "high", "low", "close", "volume")
#: A field in quotes, with doubled quotes inside, or one without, after a comma.
_FIELD = r',("(?:[^"]|"")*"|[^,]*)'


def _fields(line: Column) -> Column:
    found = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_FIELD), F.lit(1))
    bare = lambda f: F.when(f.startswith('"') & f.endswith('"') & (F.length(f) >= 2), F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f)
    return F.transform(found, lambda f: F.trim(bare(f)))


def candle_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, encoding) of every line that is not blank, decoded by its file's encoding."""
    # the value must reach this check as it was read: string functions would replace invalid bytes
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value", F.is_valid_utf8("value").alias("valid"))
    encoding = raw.groupBy("file").agg(F.when(F.bool_and("valid"), "UTF-8").otherwise("ISO-8859-1").alias("encoding"))
    lines = raw.join(encoding, "file")
    # Latin-1 bytes stay bytes until here; a line of ASCII reads the same either way
    text = F.when(F.col("encoding") == "UTF-8", F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
    return lines.select("file", F.regexp_replace(text, "^\ufeff|\r$", "").alias("line"), "encoding").filter(F.trim("line") != "")


def read_uploads(spark: SparkSession, path: str, required: Sequence[str] = REQUIRED, strict: bool = False) -> DataFrame:
    """Every record of the files: file, encoding, timestamp (seconds), the other required numbers, datetime, line, reason.

    ``reason`` is NULL for kept records; see ``kept`` and ``quarantine``."""
    required = [c.lower() for c in required]
    lines = candle_lines(spark, path).withColumn("fields", _fields(F.col("line")))
    names = F.transform("fields", lambda f: F.lower(f))
    is_header = F.size(F.array_except(F.array(*map(F.lit, required)), names)) == 0
    lines = lines.withColumn("is_header", is_header)
    headers = lines.filter("is_header").groupBy("file").agg(F.min(names).alias("header"))
    rows = lines.join(headers, "file", "left").filter(~F.col("is_header"))
    value = {c: F.get("fields", F.array_position("header", c).cast("int") - 1) for c in required}
    number = {c: v.try_cast("double") for c, v in value.items()}
    finite = lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    whole = F.size("fields") == F.size("header")
    rows = rows.select("file", "encoding", "line", "header", "fields", *[F.when(whole, finite(number[c])).alias(c) for c in required], whole.alias("whole"))
    bad = F.when(F.col("header").isNull(), "no header").when(~F.col("whole"), "field count")
    if strict:
        for c in required:
            bad = bad.when(F.col(c).isNull(), f"not a number: {c}")
    rows = rows.withColumn("reason", bad)
    if "timestamp" in required:
        top = rows.groupBy("file").agg(F.max("timestamp").alias("_top"))
        seconds = F.when(F.col("_top") > 1e10, F.col("timestamp") / 1000.0).otherwise(F.col("timestamp"))
        rows = rows.join(top, "file").withColumn("timestamp", seconds).drop("_top")
        micros = F.round(F.col("timestamp") * 1_000_000)
        when = F.when(F.abs(micros) < 2.5e17, F.timestamp_micros(micros.try_cast("long")).cast("timestamp_ntz"))
        rows = rows.withColumn("datetime", when)
    return rows.drop("header", "fields", "whole")


def kept(records: DataFrame) -> DataFrame:
    return records.filter(F.col("reason").isNull()).drop("line", "reason")


def quarantine(records: DataFrame) -> DataFrame:
    return records.filter(F.col("reason").isNotNull()).select("file", "line", "reason")
