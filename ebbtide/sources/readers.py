"""Reading uploads and panels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns that identify an upload layout, in detection order.
LAYOUTS = {
    "uci": {
        "InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID", "Country",
    },
    "redsea": {
        "TRX DATE", "TRX NUMBER", "SALES CHANNEL", "CUSTOMER NUMBER", "ITEM CODE", "QUANTITY", "Unit Price",
        "Net Amount", "TOTAL AMOUNT",
    },
    "daily": {"date", "net_sales"},
}


def detect_layout(columns: Sequence[str]) -> str:
    """The first layout whose columns are all present, else "invalid"."""
    present = set(columns)
    return next((name for name, needed in LAYOUTS.items() if needed <= present), "invalid")


def load_transactions(spark: SparkSession, path: str, layout: str | None = None) -> tuple[DataFrame, str]:
    """A header CSV as text columns plus its layout.

    `row_no` is the row's line in a file of one-line records, the header being
    line 1. It orders rejection messages.
    """
    df = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    if df.columns and df.columns[0].startswith("﻿"):
        df = df.withColumnRenamed(df.columns[0], df.columns[0].lstrip("﻿"))
    found = layout or detect_layout(df.columns)
    if found == "invalid":
        raise ValueError("required transaction or date/net_sales columns are missing")
    return numbered(df), found


def numbered(df: DataFrame, first: int = 2) -> DataFrame:
    """`row_no` in file order from `first` on. Rows are counted per partition;
    only those counts, one per input split, reach the driver."""
    marked = df.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    sizes = {r["_part"]: r["n"] for r in marked.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    starts, before = {}, first
    for part in sorted(sizes):
        starts[part] = before
        before += sizes[part]
    pairs = [(p, s) for p, s in starts.items()]
    table = df.sparkSession.createDataFrame(pairs, "_part int, _start bigint")
    # the low 33 bits count the rows of a partition
    return (
        marked.join(F.broadcast(table), "_part")
        .withColumn("row_no", F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_at", "_start")
    )


def read_delimited(spark: SparkSession, path: str, minimum: int = 5) -> DataFrame:
    """Text columns with the first of ; , tab that gives enough columns."""
    header = spark.read.text(path).first()
    if header is None:
        raise ValueError(f"{path} is empty")
    for sep in (";", ",", "\t"):
        if len(header[0].split(sep)) >= minimum:
            return spark.read.option("header", True).option("sep", sep).csv(path)
    raise ValueError(f"no separator gives {minimum} columns in {path}")


def _plain(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def match_columns(columns: Sequence[str], aliases: Mapping[str, Sequence[str]], required: Sequence[str] = ()) -> dict[str, str]:
    """Logical to physical names: equality first, then containment."""
    plain = {_plain(c): c for c in columns}
    found = {}
    for logical, options in aliases.items():
        exact = [plain[_plain(o)] for o in options if _plain(o) in plain]
        partial = [c for p, c in plain.items() for o in options if _plain(o) in p]
        if exact or partial:
            found[logical] = (exact or partial)[0]
    for logical in required:
        if logical not in found:
            raise ValueError(f"no column for {logical}; tried {list(aliases.get(logical, ()))}")
    return found


def resolve_columns(df: DataFrame, aliases: Mapping[str, Sequence[str]], required: Sequence[str] = ()) -> DataFrame:
    """Select the matched columns under their logical names."""
    found = match_columns(df.columns, aliases, required)
    return df.select(*[F.col(f"`{c}`").alias(name) for name, c in found.items()])


def union_parts(parts: Mapping[str, DataFrame], tag: str = "source_part") -> DataFrame:
    """Parts with one schema, each row keeping the name of its part."""
    out = None
    for name, part in parts.items():
        tagged = part.withColumn(tag, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    if out is None:
        raise ValueError("no parts")
    return out


def read_panel(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Only the needed columns; the scan is pruned to them.

    A gzip CSV cannot be split, so store it once with `write_panel`.
    """
    fmt = "csv" if path.rstrip("/").endswith((".csv", ".csv.gz")) else "parquet"
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    return reader.format(fmt).load(path).select(*columns)
