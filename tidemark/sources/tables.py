"""Typed scans, ordered exports, paired sinks, partitioned tables and facts about stored files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.scratch import materialise


def scan(spark: SparkSession, path: str, columns: list[str], schema: T.StructType | None = None) -> DataFrame:
    """Read only `columns` of a Parquet table; with a schema, nothing is inferred."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path).select(*columns)


def assert_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, if its columns are exactly `columns` in that order."""
    if df.columns != list(columns):
        raise ValueError(f"expected the columns {list(columns)}, found {df.columns}")
    return df


def export_ordered(df: DataFrame, columns: list[str], renamed: dict[str, str], order: list[str], path: str) -> None:
    """Write a fixed column list, some renamed, in one total order over all files, and its zone map beside it (`<path>.zones`); no single task sorts the table.

    The zone map has a row for each file: its name, place in the order, rows, and first and last key.
    """
    out = df.select(*[F.col(c).alias(renamed.get(c, c)) for c in columns])
    out.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
    zones(df.sparkSession.read.schema(out.schema).parquet(path), order).write.mode("overwrite").parquet(f"{path}.zones")


def zones(stored: DataFrame, order: list[str]) -> DataFrame:
    """file, place, rows, low, high of each file of a stored table; files stand in the order of their names."""
    key, file = F.struct(*order), F.element_at(F.split("_metadata.file_path", "/"), -1)
    rows = stored.groupBy(file.alias("file")).agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("low"), F.max(key).alias("high"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy("file")))  # a row for each file


def ordered_violations(stored: DataFrame, order: list[str], kept: DataFrame | None = None) -> DataFrame:
    """Where a stored export breaks its order, as (file, before, row): an empty frame for a sound one.

    Neighbouring rows are compared file by file, each file's last key with the next one's first, and, given the zone map `kept` with the export, each
    file's keys with those it had then (before null: the file is missing; row null: it is new). Null keys come first.
    """
    files = stored.withColumn("file", F.element_at(F.split("_metadata.file_path", "/"), -1)).withColumn("at", F.monotonically_increasing_id())
    here = F.struct(*order)
    before = F.lag(here).over(Window.partitionBy("file").orderBy("at"))
    inside = files.withColumn("before", before).filter(F.col("before") > here).select("file", "before", here.alias("row"))
    now = zones(stored, order)
    across = now.withColumn("before", F.lag("high").over(Window.orderBy("place"))).filter(F.col("before") > F.col("low")).select("file", "before", F.col("low").alias("row"))
    found = inside.unionByName(across)
    if kept is None:
        return found
    both = now.alias("n").join(kept.alias("k"), "file", "full").filter(~F.struct("n.rows", "n.low", "n.high").eqNullSafe(F.struct("k.rows", "k.low", "k.high")))
    return found.unionByName(both.select("file", F.col("k.low").alias("before"), F.col("n.low").alias("row")))


def write_both(df: DataFrame, path: str) -> None:
    """The same rows as CSV with a header and as Parquet, below `path`."""
    df.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    df.write.mode("overwrite").parquet(f"{path}/parquet")


def both_agree(spark: SparkSession, path: str) -> DataFrame:
    """One row: whether the two formats have equal columns, row counts and rows; with equal counts one difference of rows is enough."""
    kept = spark.read.parquet(f"{path}/parquet")
    text = spark.read.option("header", True).schema(kept.schema).csv(f"{path}/csv")
    header = spark.read.option("header", True).csv(f"{path}/csv").columns
    counts = kept.agg(F.count(F.lit(1)).alias("parquet_rows")).crossJoin(text.agg(F.count(F.lit(1)).alias("csv_rows")))
    odd = kept.exceptAll(text).agg(F.count(F.lit(1)).alias("differing_rows"))
    out = counts.crossJoin(odd).withColumn("columns_equal", F.lit(header == kept.columns))
    return out.withColumn("agree", F.col("columns_equal") & (F.col("parquet_rows") == F.col("csv_rows")) & (F.col("differing_rows") == 0))


def write_partitioned(df: DataFrame, path: str, partition: str, cluster: list[str], mode: str = "append") -> None:
    """A table in one folder for each value of `partition`, rows near each other by `cluster`; a large value has several writers."""
    df.repartitionByRange(partition, *cluster).sortWithinPartitions(partition, *cluster).write.mode(mode).partitionBy(partition).parquet(path)


def refresh_partitions(path: str, partition: str, late: DataFrame, rebuild: Callable[[DataFrame], DataFrame], cluster: list[str]) -> DataFrame:
    """Replace the partitions of the table at `path` that late rows touch, and no others; the touched values, one a row.

    rebuild(touched) returns the whole new rows of those partitions, touched having them in the column `partition`. They are computed before anything
    is replaced, and written by a dynamic overwrite: a partition that gets no rows stays as it is.
    """
    touched = materialise(late.select(partition).filter(F.col(partition).isNotNull()).distinct(), "touched")
    rows = materialise(rebuild(touched), "refreshed")
    placed = rows.repartitionByRange(partition, *cluster).sortWithinPartitions(partition, *cluster)
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    return touched


def write_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int, partition: str | None = None) -> None:
    """A catalog table in buckets of its keys, sorted by them, each bucket of a partition one file: joins and groups on the keys do not shuffle it."""
    width = F.pmod(F.hash(*keys), F.lit(buckets))
    writer = df.repartition(buckets, *([partition] if partition else []), width).write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    (writer.partitionBy(partition) if partition else writer).saveAsTable(table)


def staged_load(df: DataFrame, schema: str, path: str) -> DataFrame:
    """Replace the table at `path` by df, cast to an explicit schema in its order; a value that can't be cast is an error."""
    fields = T._parse_datatype_string(schema).fields
    df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields]).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(T.StructType(fields)).parquet(path)


def publish(views: dict[str, DataFrame]) -> None:
    """Register frames as views of the session, so that SQL can name them."""
    for name, view in views.items():
        view.createOrReplaceTempView(name)


def publish_persistent(spark: SparkSession, database: str, sources: dict[str, str], views: dict[str, str]) -> None:
    """Register stored tables ({name: path of Parquet files}) and views ({name: SQL text over them}) in a database of the catalog.

    Views are kept as text, resolved by whoever reads them, in any session on the catalog, and see rows that come later. A view that exists is replaced only
    by one with the same columns of the same types, in order: a change of what readers rely on is an error, and the old view stays.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name, path in sources.items():
        spark.sql(f"DROP TABLE IF EXISTS `{database}`.`{name}`")
        spark.sql(f"CREATE TABLE `{database}`.`{name}` USING parquet LOCATION '{path}'")
    before = spark.catalog.currentDatabase()
    spark.catalog.setCurrentDatabase(database)  # names in a view's text are those of its database
    try:
        for name, text in views.items():
            new = spark.sql(text).dtypes
            old = spark.table(name).dtypes if spark.catalog.tableExists(f"{database}.{name}") else new
            if old != new:
                raise ValueError(f"{database}.{name} has the columns {old}, its replacement {new}")
            spark.sql(f"CREATE OR REPLACE VIEW `{name}` AS {text}")
    finally:
        spark.catalog.setCurrentDatabase(before)


def edge_rows(df: DataFrame, entity: str, order: str, n: int) -> DataFrame:
    """The first and last n rows of each entity, with `edge`: first or last; a row may be both."""
    ahead, back = Window.partitionBy(entity).orderBy(order), Window.partitionBy(entity).orderBy(F.desc(order))
    placed = df.withColumns({"_ahead": F.row_number().over(ahead), "_back": F.row_number().over(back)})
    edges = F.array_compact(F.array(F.when(F.col("_ahead") <= n, F.lit("first")), F.when(F.col("_back") <= n, F.lit("last"))))
    return placed.withColumn("edge", F.explode(edges)).drop("_ahead", "_back")


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed dimension."""
    return spark.createDataFrame(rows, schema)


def file_facts(spark: SparkSession, name: str, path: str) -> DataFrame:
    """One row on a stored table: rows, files, bytes and when its files last changed."""
    meta = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    files = meta.groupBy("file_path").agg(F.count(F.lit(1)).alias("rows"), F.first("file_size").alias("bytes"), F.max("file_modification_time").alias("changed"))
    return files.agg(F.lit(name).alias("table_name"), F.sum("rows").alias("row_count"), F.count(F.lit(1)).alias("file_count"), F.sum("bytes").alias("total_bytes"), F.max("changed").alias("last_modified"))


def footer_facts(spark: SparkSession, name: str, path: str, columns: list[str]) -> DataFrame:
    """One row on a stored table from its files' footers alone: table_name, row_count, and min_ and max_ of `columns`; no column is read.

    A session of its own lets Spark push the aggregates into the scan; its one row is handed over. Where a footer lacks statistics, or for types that
    have none, Spark reads the column.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    told = _pushed(own, path, columns)
    return spark.createDataFrame([(name, *told.first())], T.StructType([T.StructField("table_name", T.StringType()), *told.schema.fields]))


def _pushed(session: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return session.read.parquet(path).agg(F.count(F.lit(1)).alias("row_count"), *[how(c).alias(f"{n}_{c}") for c in columns for n, how in (("min", F.min), ("max", F.max))])
