"""Parquet tables on shared storage: creation, appends, replaced partitions,
expiry and exports.

A change rewrites only the partitions it touches, in one job: Spark writes the new
files to a staging folder and replaces the old ones when every task is done, so
rows read from the same table stay readable - and can be computed again if an
executor is lost - until then. Changes of a whole table, and of the hash buckets
of a bucketed one, make a new version (see ``versions``).
"""

from __future__ import annotations

from collections.abc import Collection, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..functions.dates import load_stamp
from ..operators import dml
from ..operators.filters import in_day
from ..session import run_folder
from . import versions


@dataclass(frozen=True)
class Table:
    path: str
    schema: str
    partitions: tuple[str, ...] = ()
    expire_days: int | None = None
    #: Rows of a bucketed table are dealt to ``buckets`` folders by the hash of these columns.
    bucket_by: tuple[str, ...] = ()
    buckets: int = 64

    @property
    def stored_schema(self) -> str:
        named = StructType.fromDDL(self.schema).fieldNames()
        extra = [f"{p} string" for p in self.partitions if p not in named]
        return ", ".join([self.schema, *extra])


def candle_table(path: str) -> Table:
    return Table(path, schemas.CANDLES, ("symbol", "event_date"), expire_days=60)


def article_table(path: str, buckets: int = 64) -> Table:
    """All rules of the article table look at one ticker, so its buckets can be refreshed alone."""
    return Table(path, schemas.ARTICLES, bucket_by=("ticker",), buckets=buckets)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, table: Table) -> bool:
    fs, path = _fs(spark, table.path)
    return fs.exists(path)


def create(spark: SparkSession, table: Table) -> str:
    """``created`` or ``exists``."""
    fs, path = _fs(spark, table.path)
    if fs.exists(path):
        return "exists"
    fs.mkdirs(path)
    return "created"


def read(spark: SparkSession, table: Table, buckets: Collection[int] | None = None) -> DataFrame:
    """The rows of the table, or of some buckets of a bucketed one; other buckets are not even listed."""
    version, path = versions.latest(spark, table.path), table.path
    reader = spark.read.schema(table.stored_schema)
    if version is None:
        return reader.parquet(path)
    folders = [f for b, f in version.folders.items() if buckets is None or not b or int(b) in buckets]
    if not folders:
        return spark.createDataFrame([], table.stored_schema)
    return reader.parquet(*[f"{path}/{versions.FOLDER}/{f}" for f in folders])


def bucket_of(table: Table) -> Column:
    return F.pmod(F.xxhash64(*table.bucket_by), F.lit(table.buckets)).cast("int")


def stored_days(spark: SparkSession, table: Table) -> DataFrame:
    """(symbol, day) of the stored days of a table partitioned by them, from the listing of its files; no file is opened."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(table.path)
    if not set(table.partitions) <= set(listed.columns):  # no file yet
        return spark.createDataFrame([], "symbol string, day date")
    return listed.filter("length > 0").select("symbol", F.to_date("event_date").alias("day")).distinct()


def replace_buckets(
    df: DataFrame, table: Table, touched: Collection[int], based_on: versions.Version | None,
    *, facts: dict[str, Column] | None = None, notes: dict[str, str] | None = None,
) -> versions.Version:
    """A new version in which the touched buckets hold the rows of ``df``, all of which belong to them; the files of other
    buckets stay as they are. ``facts`` are aggregates kept per bucket beside the number of its rows."""
    spark = df.sparkSession
    name, folder = versions.new_folder(table.path)
    names = StructType.fromDDL(table.schema).fieldNames()
    rows = df.select(*[F.col(f"`{n}`") for n in names], bucket_of(table).alias("_bucket")).hint("rebalance", "_bucket")
    rows.write.partitionBy("_bucket").parquet(folder)
    written = spark.read.schema(f"{table.schema}, _bucket int").parquet(folder)
    counted = {"rows": F.count(F.lit(1)), **(facts or {})}
    found = written.groupBy("_bucket").agg(*[c.cast("long").alias(n) for n, c in counted.items()]).collect()
    stray = {r["_bucket"] for r in found} - set(touched)
    if stray:
        raise ValueError(f"rows of buckets {sorted(stray)} among those of {sorted(touched)}")
    kept = {b for b in (based_on.folders if based_on else {}) if int(b) not in touched}
    folders = {b: based_on.folders[b] for b in kept} | {str(r["_bucket"]): f"{name}/_bucket={r['_bucket']}" for r in found}
    own = {b: based_on.facts[b] for b in kept} | {str(r["_bucket"]): {n: r[n] for n in counted} for r in found}
    version = versions.commit(spark, table.path, based_on, folders, own, notes)
    versions.vacuum(spark, table.path)
    return version


def _with_event_date(df: DataFrame, table: Table, ts: str = "timestamp") -> DataFrame:
    if "event_date" in table.partitions and ts in df.columns:
        return df.withColumn("event_date", F.date_format(ts, "yyyy-MM-dd"))
    return df


def _write(df: DataFrame, table: Table, mode: str, folder: str | None = None, counted: Column | None = None) -> int:
    """Write and return the number of rows (of those ``counted`` is true for), counted while writing."""
    from pyspark.sql import Observation

    seen = Observation()
    names = StructType.fromDDL(table.stored_schema).fieldNames()
    many = F.count(F.lit(1)) if counted is None else F.count_if(counted)
    rows = _with_event_date(df, table).observe(seen, many.alias("n")).select(*[F.col(f"`{n}`") for n in names])
    if table.partitions:
        # One shuffle on the partition columns; large partitions are split again
        # by the adaptive rebalance, so a hot symbol is written by many tasks.
        rows = rows.hint("rebalance", *table.partitions)
    writer = rows.write.mode(mode)
    if table.partitions:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*table.partitions)
    writer.parquet(table.path if folder is None else folder)
    return seen.get["n"]


def append(df: DataFrame, table: Table) -> int:
    version = versions.latest(df.sparkSession, table.path)
    if version is None:
        return _write(df, table, "append")
    return _write(df, table, "append", f"{table.path}/{versions.FOLDER}/{version.folders['']}")


def append_stamped(df: DataFrame, table: Table, as_of: Column, stamp: str = "date_load_iso_utc") -> int:
    return append(df.withColumn(stamp, load_stamp(as_of)), table)


def rewrite(df: DataFrame, table: Table) -> int:
    """Replace the partitions present in ``df``, which may come from the table
    itself. For changes that empty no partition."""
    if not table.partitions:
        return replace(df, table)
    return _write(df, table, "overwrite")


def replace(df: DataFrame, table: Table) -> int:
    """Replace the whole table by a new version; ``df`` may come from the table
    itself. A stop at any step leaves the version before."""
    spark = df.sparkSession
    based_on = versions.latest(spark, table.path)
    name, folder = versions.new_folder(table.path)
    written = _write(df, table, "errorifexists", folder)
    versions.commit(spark, table.path, based_on, {"": name})
    versions.vacuum(spark, table.path)
    if based_on is None:
        _drop_first_files(spark, table)
    return written


def _drop_first_files(spark: SparkSession, table: Table) -> None:
    """Files written before the table had versions; no version names them."""
    fs, path = _fs(spark, table.path)
    for status in fs.listStatus(path):
        if status.getPath().getName() != versions.FOLDER:
            fs.delete(status.getPath(), True)


@contextmanager
def staged(df: DataFrame, purpose: str) -> Iterator[DataFrame]:
    """An expensive intermediate result, written once to the shared folder and
    removed when the work with it is done."""
    spark = df.sparkSession
    path = run_folder(spark, purpose)
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        fs, folder = _fs(spark, path)
        fs.delete(folder, True)


def load_days(spark: SparkSession, incoming: DataFrame, table: Table, as_of: Column, *, days: str = "first") -> int:
    """Replace-day load into a candle table; touches only incoming partitions.

    Days beyond a symbol's first are appended to under ``days="first"``, by writing
    what they hold with the incoming rows. All is one overwrite, so a load that was
    stopped has changed nothing.
    """
    stamped = incoming.select(*schemas.CANDLE_COLUMNS).withColumn("date_load_iso_utc", load_stamp(as_of))
    stamped = _with_event_date(stamped, table)
    if days == "all":
        return _write(stamped, table, "overwrite")
    keys = ["symbol", "event_date"]
    first_days = stamped.groupBy("symbol").agg(F.min("event_date").alias("event_date"))
    later = stamped.join(first_days, keys, "left_anti").select(*keys).distinct()
    kept = read(spark, table).join(later, keys, "left_semi")
    rows = stamped.withColumn("_kept", F.lit(False)).unionByName(kept.withColumn("_kept", F.lit(True)), allowMissingColumns=True)
    return _write(rows, table, "overwrite", counted=~F.col("_kept"))


def merge_days(spark: SparkSession, incoming: DataFrame, table: Table, as_of: Column) -> int:
    """Merge into a candle table: an incoming row replaces the stored row of its
    symbol and time, other rows of its day stay. Of incoming rows of one symbol
    and time, the one with the largest values is taken. Only the (symbol, day)
    partitions of the incoming rows are read and written."""
    keys = ["symbol", "timestamp"]
    values = F.struct(*[c for c in schemas.CANDLE_COLUMNS if c not in keys])
    one = incoming.groupBy(*keys).agg(F.max(values).alias("_v")).select(*keys, "_v.*")
    stamped = _with_event_date(one.withColumn("date_load_iso_utc", load_stamp(as_of)), table)
    days = stamped.select("symbol", "event_date").distinct()
    stored = read(spark, table).join(days, ["symbol", "event_date"], "left_semi")
    kept = stored.join(stamped.select(*keys), keys, "left_anti")
    return _write(kept.unionByName(stamped, allowMissingColumns=True), table, "overwrite")


def expire_days(spark: SparkSession, table: Table, universe: DataFrame, as_of: str, days: int | None = None) -> int:
    """Delete candles of configured symbols older than ``as_of`` minus the
    table's retention. Whole days are removed as folders; only the day the
    cutoff falls in is rewritten. Returns the number of folders removed.

    The folder list is one entry per (symbol, day), never rows.
    """
    days = table.expire_days if days is None else days
    cutoff = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
    cutoff_day = F.date_format(cutoff, "yyyy-MM-dd")
    files = read(spark, table).select("*", F.col("_metadata.file_path").alias("_file"))
    stored = files.join(universe.select("symbol").distinct(), "symbol", "left_semi")
    candidates = stored.filter(F.col("event_date") <= cutoff_day)
    alive = F.col("timestamp") >= cutoff
    folders = (
        candidates.groupBy("symbol", "event_date")
        .agg(F.count_if(alive).alias("alive"), F.count("*").alias("n"), F.max("_file").alias("file"))
        .filter("alive < n")
        .collect()
    )
    if any(f["alive"] for f in folders):
        _write(candidates.filter((F.col("event_date") == cutoff_day) & alive), table, "overwrite")
    gone = [f for f in folders if not f["alive"]]
    fs, _ = _fs(spark, table.path)
    jvm = spark.sparkContext._jvm
    # The folder's name as it was written: special characters of a symbol are escaped there.
    return sum(fs.delete(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f["file"])).getParent(), True) for f in gone)


def backup_day(df: DataFrame, symbols: Sequence[str] | None, day: Column, out: str) -> int:
    """One UTC day as JSON, a folder per symbol, replacing the earlier backup
    of these symbols; row ids are not kept."""
    from pyspark.sql import Observation

    rows = df.filter(in_day(F.col("timestamp"), day))
    if symbols is not None:
        rows = rows.filter(F.col("symbol").isin(*symbols))
    seen = Observation()
    (
        rows.drop("_id", "event_date")
        .hint("rebalance", "symbol")
        .observe(seen, F.count(F.lit(1)).alias("n"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("symbol")
        .json(out)
    )
    return seen.get["n"]


def read_backup(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CANDLES).json(path).select(*schemas.CANDLE_COLUMNS)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
