"""Loading tables, and the tenant's view of them."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def telemetry(spark: SparkSession, folder: str) -> DataFrame:
    """Events in the role of telemetry: vin, seq, ts, evt, reading, level (the number in the payload) and the payload."""
    e = table(spark, folder, "events")
    level = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.col("user_id").alias("vin"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("evt"), F.col("value").alias("reading"), level.alias("level"), "props")


class TenantView:
    """Tables as one tenant may see them: those that carry the tenant are filtered on it, the others by a semi-join on those. A
    view without a tenant is refused."""

    def __init__(self, tenant, tables: dict[str, DataFrame], column: str = "tenant_id", through: dict[str, tuple[str, str]] | None = None):
        if tenant is None:
            raise ValueError("no tenant")
        self._tenant, self._tables, self._column, self._through = tenant, tables, column, through or {}

    def __getitem__(self, name: str) -> DataFrame:
        df = self._tables[name]
        if name in self._through:
            parent, key = self._through[name]
            return df.join(self[parent].select(key), key, "left_semi")
        return df.where(F.col(self._column) == F.lit(self._tenant))


def keep_days(df: DataFrame, day: str, today, days: int) -> DataFrame:
    """Retention: the days younger than so many days. On a table partitioned by day only those partitions are read."""
    return df.where(F.col(day) >= F.date_sub(F.lit(today).cast("date"), days))


def shared_folder(spark: SparkSession, *parts: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. Where it is unset and the one machine is all there
    is, a temporary folder; on a cluster that is an error."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        return tempfile.mkdtemp(prefix="roadloom-")
    return "/".join([base.rstrip("/"), *parts, uuid.uuid4().hex])


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder, in whatever store the path names."""
    fs, where = _at(spark, path)
    return fs.exists(where)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders in a folder."""
    fs, where = _at(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(where) if f.isDirectory())


def removed(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.delete(where, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame with its lineage cut: written in the shared folder and read again, so that what follows knows its true size."""
    path = f"{shared_folder(df.sparkSession, 'checkpoints')}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def write_by_day(df: DataFrame, path: str, day: str = "day", search: list[str] = [], order: list[str] = []) -> None:  # noqa: B006
    """A table in a folder for each day, rows of a day together in files sorted by `order`, so that statistics skip row groups;
    columns in `search` get bloom filters, which skip those that lack a value asked for."""
    w = df.repartition(day).sortWithinPartitions(day, *order).write.partitionBy(day)
    for c in search:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
    w.mode("overwrite").parquet(path)


def days_between(spark: SparkSession, path: str, first, after, day: str = "day", most_days: int | None = None) -> DataFrame:
    """The rows of the days in [first, after); other days' folders aren't read. A ValueError for no days, or more than `most_days`."""
    span = (datetime.date.fromisoformat(str(after)) - datetime.date.fromisoformat(str(first))).days
    if span <= 0 or (most_days is not None and span > most_days):
        raise ValueError(f"a span of {span} days")
    return spark.read.parquet(path).where((F.col(day) >= F.lit(first).cast("date")) & (F.col(day) < F.lit(after).cast("date")))


def parameterised(spark: SparkSession, sql: str, tables: dict[str, DataFrame], **values) -> DataFrame:
    """A query text with named parameters (:name) over frames ({name}); values never become part of the text."""
    return spark.sql(sql, args=values, **tables)


def truncated(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first `limit` rows in the order, each with `truncated`: whether there were more. One row more than asked is looked at."""
    few = rows.orderBy(*order).limit(limit + 1)
    w = Window.orderBy(*order)  # over limit + 1 rows
    return few.withColumn("_n", F.row_number().over(w)).withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy()) > limit).where(F.col("_n") <= limit).drop("_n")


def stable_id(*parts: Column) -> Column:
    """An id in the form of a UUID that depends on the parts alone, so that a replay gives the same one."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    cut = lambda a, n: F.substr(h, F.lit(a), F.lit(n))
    return F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))
