"""CSV tables: strict reader, multi-dataset scan with the dataset label taken
from the path, pandas-style skipping of over-long lines, and sinks."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_CSV_OPTS = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true", "encoding": "UTF-8"}


def read_table(
    spark: SparkSession,
    root: str,
    dataset_name: str | None = None,
    tbl_name: str | None = None,
    schema: StructType | str | None = None,
) -> DataFrame:
    """One table of one dataset: ``<root>/<dataset>/<table>.csv``.  Missing
    arguments raise ``ValueError``; a missing file raises Spark's
    PATH_NOT_FOUND error (never an empty frame)."""
    if not dataset_name:
        raise ValueError("dataset_name must be provided")
    if not tbl_name:
        raise ValueError("tbl_name must be provided")
    r = spark.read.options(**_CSV_OPTS)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", "true")
    return r.csv(f"{root.rstrip('/')}/{dataset_name}/{tbl_name}.csv")


def dataset_label() -> F.Column:
    """Dataset name = the directory holding the table (a file, or a folder of part files)."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+\.csv(?:/[^/]+)?$", 1)


def _listed(spark: SparkSession, root: str, tbl_name: str) -> DataFrame:
    """(dataset_id, path) of every ``<dataset>/<tbl_name>.csv`` under ``root``, a file or a folder of part
    files as this library's sink writes them: one listing, no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    table = rf"^(.*?/([^/]+)/{re.escape(tbl_name)}\.csv)(?:/[^/]+)?$"
    found = files.select(F.regexp_extract("path", table, 2).alias("dataset_id"), F.regexp_extract("path", table, 1).alias("path"))
    return found.where("path <> ''").distinct()


def _paths(spark: SparkSession, root: str, tbl_name: str, datasets: Sequence[str] | None) -> list[str]:
    """The table's path in every dataset directory (paths only, one per dataset)."""
    if datasets:
        return [f"{root.rstrip('/')}/{d}/{tbl_name}.csv" for d in datasets]
    return sorted(r["path"] for r in _listed(spark, root, tbl_name).select("path").collect())


def read_all(
    spark: SparkSession,
    root: str,
    tbl_name: str,
    schema: StructType | str | None = None,
    datasets: Sequence[str] | None = None,
) -> DataFrame:
    """One table stacked over every dataset directory, with ``dataset_id`` from the path.

    Columns are matched by name: files with the same header are one scan, and
    the scans are united by name, so that another column order changes nothing,
    a missing column is NULL and an extra one is kept.  ``schema`` names the
    types of the columns it knows; others are strings.  When datasets are named,
    only their paths are listed (pruning before the scan, not a filter after)."""
    known = None
    if schema is not None:
        known = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    by_header: dict[tuple[str, ...], list[str]] = {}
    for path in _paths(spark, root, tbl_name, datasets):
        header = tuple(spark.read.options(**_CSV_OPTS).csv(path).columns)  # reads the first line
        by_header.setdefault(header, []).append(path)
    if not by_header:
        raise FileNotFoundError(f"no {tbl_name}.csv under {root}")
    parts = []
    for header, paths in by_header.items():
        r = spark.read.options(**_CSV_OPTS)
        if known is not None:
            types = {f.name: f.dataType for f in known.fields}
            r = r.schema(StructType([StructField(c, types.get(c, StringType()), True) for c in header]))
        else:
            r = r.option("inferSchema", "true")
        parts.append(r.csv(paths).withColumn("dataset_id", dataset_label()))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    if known is not None:
        extra = [c for c in out.columns if c not in known.fieldNames() and c != "dataset_id"]
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in known.fields if f.name not in out.columns]
        out = out.select("*", *none).select(*known.fieldNames(), *extra, *([] if "dataset_id" in known.fieldNames() else ["dataset_id"]))
    return out


def discover_datasets(spark: SparkSession, root: str, tbl_name: str = "conditions") -> DataFrame:
    """Dataset directories that hold ``tbl_name``, as a file or a folder of part files."""
    return _listed(spark, root, tbl_name).select("dataset_id").distinct()


def count_files(spark: SparkSession, root: str) -> int:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path").count()


def read_skip_long_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Like pandas ``on_bad_lines='skip'``: rows with too many fields are dropped,
    short rows are kept and padded with NULL.  (Spark's DROPMALFORMED would also
    drop short rows.)  Read PERMISSIVE with one surplus column and keep rows
    where it stayed empty."""
    extra = StructType(list(schema.fields) + [StructField("_extra", StringType(), True)])
    df = spark.read.options(**_CSV_OPTS).option("mode", "PERMISSIVE").schema(extra).csv(path)
    return df.where(F.col("_extra").isNull()).drop("_extra")


def read_headerless(spark: SparkSession, path: str, skip_first: int = 1) -> DataFrame:
    """Header-less CSV, dropping the first ``skip_first`` positional columns."""
    df = spark.read.option("header", "false").option("inferSchema", "true").csv(path)
    return df.select(df.columns[skip_first:])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """CSV with a header; missing values written as empty fields.  With
    ``partition_by`` each value gets its own ``col=value`` directory."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    (
        w
        .option("header", "true")
        .option("nullValue", "")
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", "false")
        .option("ignoreTrailingWhiteSpace", "false")
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def read_csv_dir(spark: SparkSession, root: str, schema: StructType | str) -> DataFrame:
    """All CSV files under ``root`` (recursively) with one declared schema."""
    return (
        spark.read.options(**_CSV_OPTS)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.csv")
        .schema(schema)
        .csv(root)
    )
