"""Candle CSV files (one instrument per file, many files per folder or glob).

Every column is read as STRING with an explicit schema (no inference pass over the data);
numbers are coerced later (``coerce_numeric``), so junk text becomes NULL instead of
failing the read. The symbol comes from the file name (``_metadata.file_name``) unless a
symbol column exists. Rows the parser cannot split are kept in ``_corrupt_record`` and
can be rejected per file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_candles_csv(
    spark: SparkSession,
    path: str,
    columns: tuple[str, ...] = ("timestamp", "open", "high", "low", "close", "volume", "datetime"),
    encoding: str = "UTF-8",
    symbol_from_file: bool = True,
) -> DataFrame:
    """Read candle CSVs with a header. Header case is free: ``columns`` are matched
    case-insensitively (Spark's default), output names are lower case."""
    fields = [T.StructField(c, T.StringType()) for c in columns] + [T.StructField("_corrupt_record", T.StringType())]
    df = (
        spark.read.schema(T.StructType(fields))
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("encoding", encoding)
        .option("enforceSchema", False)
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .csv(path)
    )
    if symbol_from_file:
        name = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
        df = df.withColumn("symbol", name)
    return df.toDF(*[c.lower() for c in df.columns])


def reject_corrupt_files(df: DataFrame) -> DataFrame:
    """Drop whole files (symbols) that contain an unparsable line (the strict upload path)."""
    # Spark refuses a scan that needs only the corrupt-record column: read a data column too.
    first = [c for c in df.columns if c not in ("_corrupt_record", "symbol")][0]
    marker = F.length(F.concat_ws("|", F.col(first), F.col("_corrupt_record"))) >= 0  # always true
    bad = df.filter(F.col("_corrupt_record").isNotNull() & marker).select("symbol").distinct()
    return df.join(bad, "symbol", "left_anti").drop("_corrupt_record")
