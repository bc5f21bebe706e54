"""Read and write the nine tables as files (A1-A3).

CSV input is read with every column as text. ``load_csv`` converts it and
keeps what cannot be converted: a record with a malformed date or number, or
with the wrong number of fields, goes whole to a rejects table with its
reasons, so every record read is either typed or rejected. ``read_tables``
alone converts with ``try_cast`` (bad values become NULL). Comment fields may
hold line breaks and doubled quotes, hence ``multiLine`` and ``escape='"'``.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import SCHEMAS, TABLE_FILES
from ..tables import TABLE_NAMES, Tables


def _typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` onto ``schema``: columns already of the target type pass
    through untouched (so filters still reach the scan); text columns are
    trimmed and converted with ``try_cast`` (bad values become NULL)."""
    have = {f.name: f.dataType for f in df.schema.fields}
    cols = []
    for f in schema.fields:
        c = F.col(f.name)
        src = have.get(f.name)
        if src is None:
            c = F.lit(None).cast(f.dataType)
        elif src != f.dataType:
            c = (F.trim(c) if isinstance(src, T.StringType) else c).try_cast(f.dataType)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def read_csv_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One CSV file as typed columns, matched by header name (a missing one is an
    error). Only review comments hold line breaks, so only that table is read
    as multi-line; the others stay splittable."""
    raw = (spark.read.option("header", True).option("multiLine", name == "order_reviews")
           .option("quote", '"').option("escape", '"')
           .option("mode", "PERMISSIVE")
           .csv(path))
    missing = [f.name for f in SCHEMAS[name].fields if f.name not in raw.columns]
    if missing:
        raise ValueError(f"{path}: columns missing from the header: {missing}")
    return _typed(raw, SCHEMAS[name])


def read_tables(spark: SparkSession, directory: str, fmt: str = "parquet",
                files: dict[str, str] | None = None) -> Tables:
    """Load the nine tables from ``directory``.

    ``fmt='csv'`` reads the source file names of ``TABLE_FILES`` (or ``files``);
    ``fmt='parquet'`` reads one directory per table named after the table.
    Missing ``geolocation`` is allowed (no analysis reads it).
    """
    files = files or TABLE_FILES
    out = {}
    for name in TABLE_NAMES:
        if fmt == "csv":
            path = os.path.join(directory, files[name])
            out[name] = read_csv_table(spark, path, name) if _exists(spark, path) else None
        elif fmt == "parquet":
            path = os.path.join(directory, name)
            out[name] = (_typed(spark.read.parquet(path), SCHEMAS[name])
                         if _exists(spark, path) else None)
        else:
            raise ValueError(f"unknown format {fmt!r}")
        if out[name] is None and name != "geolocation":
            raise FileNotFoundError(path)
    return Tables(**out)


# ------------------------------------------------------------------ load with rejects
REJECTS = "file string, record string, faults array<struct<column: string, value: string, reason: string>>"
_CORRUPT = "_corrupt_record"


def checked_csv_table(spark: SparkSession, path: str, name: str) -> tuple[DataFrame, DataFrame]:
    """One CSV file as (typed rows, rejects): a record is in exactly one of them.

    A reject row holds the file, the record (JSON of its texts) and its faults:
    column, raw value, reason. Empty fields are NULL, which is no fault.
    """
    options = {"header": "true", "multiLine": str(name == "order_reviews"), "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    header = spark.read.options(**options).csv(path).columns
    schema = SCHEMAS[name]
    missing = [f.name for f in schema.fields if f.name not in header]
    if missing:
        raise ValueError(f"{path}: columns missing from the header: {missing}")
    # whole records are parsed: with pruned columns a record's number of fields is not seen
    raw = spark.read.options(**options, columnNameOfCorruptRecord=_CORRUPT, columnPruning="false").schema(
        T.StructType([T.StructField(c, T.StringType()) for c in [*header, _CORRUPT]])).csv(path)

    def fault(column: str, value: Column, reason: str) -> Column:
        return F.struct(F.lit(column).alias("column"), value.alias("value"), F.lit(reason).alias("reason"))
    # (a count of rows must read some column besides the corrupt record's, or Spark refuses it)
    broken = F.col(_CORRUPT).isNotNull() & (F.length(F.coalesce(F.col(header[0]), F.lit(""))) >= 0)
    faults = [F.when(broken, fault("", F.col(_CORRUPT), f"not {len(header)} fields"))]
    for f in schema.fields:
        if not isinstance(f.dataType, T.StringType):
            text = F.trim(F.col(f.name))
            bad = F.col(_CORRUPT).isNull() & (text != "") & text.try_cast(f.dataType).isNull()
            faults.append(F.when(bad, fault(f.name, F.col(f.name), f"not a {f.dataType.simpleString()}")))
    marked = raw.withColumn("_faults", F.array_compact(F.array(*faults)))
    bad = F.size("_faults") > 0
    rejects = marked.filter(bad).select(F.lit(TABLE_FILES[name]).alias("file"), F.to_json(F.struct(*header)).alias("record"), F.col("_faults").alias("faults"))
    return _typed(marked.filter(~bad).select(*header), schema), rejects


def load_csv(spark: SparkSession, directory: str, files: dict[str, str] | None = None) -> tuple[Tables, DataFrame]:
    """A1/A3: the nine tables from the source's CSV files, and the rejects of all files."""
    files = files or TABLE_FILES
    tables, rejects = {}, spark.createDataFrame([], REJECTS)
    for name in TABLE_NAMES:
        path = os.path.join(directory, files[name])
        if _exists(spark, path):
            tables[name], bad = checked_csv_table(spark, path, name)
            rejects = rejects.unionByName(bad)
        elif name != "geolocation":
            raise FileNotFoundError(path)
    return Tables(**tables), rejects


def reject_faults(rejects: DataFrame) -> DataFrame:
    """One row a bad value: file, column, value, reason."""
    return rejects.select("file", F.inline("faults"))


# tables keyed by order id: stored bucketed on it so their joins co-locate
ORDER_KEYED = ("orders", "order_items", "order_payments", "order_reviews")


def write_tables(t: Tables, directory: str, mode: str = "overwrite") -> None:
    """Write every table as Parquet under ``directory/<name>`` (A3).

    Each table is rewritten whole, as the source rebuilds its database on
    every run.
    """
    for name, df in t.items():
        df.write.mode(mode).parquet(os.path.join(directory, name))


def bucket_skew(df: DataFrame, key: str, buckets: int) -> float:
    """Largest bucket over the mean bucket for ``buckets`` hash buckets on
    ``key`` (Spark's bucket id is ``pmod(murmur3(key), buckets)``, which is
    what ``F.hash`` computes). One aggregation; 1.0 means perfectly even."""
    row = (df.groupBy(F.pmod(F.hash(key), F.lit(buckets)).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
           .agg(F.max("_n").alias("mx"), F.sum("_n").alias("tot")).first())
    if not row or not row["tot"]:
        return 1.0
    return row["mx"] / (row["tot"] / buckets)


def write_catalog_tables(t: Tables, database: str, location: str, buckets: int,
                         mode: str = "overwrite", layout: str = "bucketed") -> dict:
    """Save the tables in the catalog under ``database`` (stored at ``location``).

    The caller chooses the ``layout``. ``bucketed``: the order-keyed tables are
    dealt by ``order_id`` first and written as one sorted file a bucket, so
    joins and groupings on ``order_id`` between orders, items, payments and
    reviews read matching buckets side by side instead of shuffling the fact
    tables, and a lookup of one order reads one bucket. A bucketed join has no
    exchange for AQE to split, so an order with a large share of the rows sits
    in one task; ``plain`` keeps AQE's skew splitting. The skew of the items'
    buckets is returned with the choice, for the caller to judge.
    """
    if layout not in ("bucketed", "plain"):
        raise ValueError(layout)
    spark, bucketed = t.spark, layout == "bucketed"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{location}'")
    skew = None
    for name, df in t.items():
        if bucketed and name in ORDER_KEYED:
            if name == "order_items":
                skew = round(bucket_skew(df, "order_id", buckets), 3)
            w = df.repartition(buckets, "order_id").write.mode(mode).format("parquet").bucketBy(buckets, "order_id").sortBy("order_id")
        else:
            w = df.write.mode(mode).format("parquet")
        # a bloom filter a row group answers lookups of orders that its range of ids only seems to hold
        if name in ORDER_KEYED:
            w = w.option("parquet.bloom.filter.enabled#order_id", "true")
        w.option("path", os.path.join(location, name)).saveAsTable(f"{database}.{name}")
    return {"bucketed": bucketed, "buckets": buckets if bucketed else 0, "item_bucket_skew": skew}


def read_catalog_tables(spark: SparkSession, database: str) -> Tables:
    """The nine tables saved by :func:`write_catalog_tables` (bucketing kept)."""
    have = {x.name for x in spark.catalog.listTables(database)}
    out = {}
    for name in TABLE_NAMES:
        if name in have:
            out[name] = _typed(spark.table(f"{database}.{name}"), SCHEMAS[name])
        elif name != "geolocation":
            raise LookupError(f"{database}.{name}")
    return Tables(**out)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jpath)
