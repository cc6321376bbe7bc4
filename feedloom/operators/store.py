"""Tables at rest: append-only history, versioned snapshots, dimensions, guarded seen-sets.

A snapshot is written as ``<root>/v=<n>`` and becomes current when the pointer file is replaced,
so no plan ever overwrites the path it reads and a lost run leaves the old state in force.
History tables are partitioned by run; writing the same run again replaces only its partition.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from feedloom import rules
from feedloom.functions.text import strip
from feedloom.functions.times import as_timestamp
from feedloom.schemas import HEALTH_DDL, RUNS_DDL, SCORES_DDL, STATE_DDL

POINTER = "CURRENT.json"


class StateRefused(RuntimeError):
    """Stored state does not belong to what is asked for; nothing is run on it."""


# --- pointer files, through Hadoop so that any shared storage works --------------------------


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if it does not exist."""
    fs, target = _fs(spark, path)
    return [item.getPath().getName() for item in fs.listStatus(target)] if fs.exists(target) else []


def read_pointer(spark: SparkSession, root: str) -> dict | None:
    if not exists(spark, f"{root}/{POINTER}"):
        return None
    lines = spark.read.option("wholetext", True).text(f"{root}/{POINTER}").collect()
    return json.loads(lines[0][0])


def write_pointer(spark: SparkSession, root: str, pointer: dict) -> None:
    """Replace the pointer in one step: a reader sees the old file or the new one, never a part."""
    fs, target = _fs(spark, f"{root}/{POINTER}")
    _, fresh = _fs(spark, f"{root}/.{POINTER}.{uuid.uuid4().hex}")
    stream = fs.create(fresh, True)
    try:
        stream.write(bytearray(json.dumps(pointer).encode("utf-8")))
    finally:
        stream.close()
    gateway = spark.sparkContext._gateway
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    options = getattr(hadoop, "Options$Rename")
    overwrite = gateway.new_array(options, 1)
    overwrite[0] = options.OVERWRITE
    context = hadoop.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fresh, target, overwrite)


# --- snapshots -------------------------------------------------------------------------------


def next_version(spark: SparkSession, root: str) -> int:
    pointer = read_pointer(spark, root)
    return 0 if pointer is None else pointer["version"] + 1


def stage_snapshot(
    df: DataFrame, root: str, version: int, key: str | None = None, buckets: int = 64
) -> DataFrame:
    """Write a version without publishing it and return it as read back.

    With ``key`` the files are bucketed and sorted by it: the next merge then joins the stored
    side without shuffling it.
    """
    spark, path = df.sparkSession, f"{root}/v={version}"
    if key is None:
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    table = _bucket_table(path, buckets)
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    (
        df.write.mode("overwrite")
        .format("parquet")
        .bucketBy(buckets, key)
        .sortBy(key)
        .option("path", path)
        .saveAsTable(table)
    )
    return spark.table(table)


def publish(spark: SparkSession, root: str, version: int, **extra) -> None:
    write_pointer(spark, root, {"version": version, **extra})


def read_snapshot(spark: SparkSession, root: str, ddl: str) -> DataFrame:
    """The published version, or an empty table of the given layout."""
    pointer = read_pointer(spark, root)
    if pointer is None:
        return spark.createDataFrame([], ddl)
    if "buckets" not in pointer:
        return spark.read.schema(ddl).parquet(f"{root}/v={pointer['version']}")
    return read_version(spark, root, pointer["version"], ddl, pointer["key"], pointer["buckets"])


def read_version(spark: SparkSession, root: str, version: int, ddl: str, key: str, buckets: int) -> DataFrame:
    """A version that was staged with a key, published or not."""
    path = f"{root}/v={version}"
    table = _bucket_table(path, buckets)
    if not spark.catalog.tableExists(table):
        spark.sql(
            f"CREATE TABLE {table} ({ddl}) USING parquet CLUSTERED BY ({key}) "
            f"SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
    return spark.table(table).select(*T.StructType.fromDDL(ddl).fieldNames())


def _bucket_table(path: str, buckets: int) -> str:
    # The session catalog names a location; the name is derived from it, so sessions agree.
    return f"feedloom_{hashlib.sha256(path.encode()).hexdigest()[:16]}_{buckets}"


# --- history ---------------------------------------------------------------------------------


def _partition(path: str, run_id: str) -> str:
    return f"{path}/run_id={quote(run_id, safe='')}"


def append_run(df: DataFrame, path: str, run_id: str) -> DataFrame:
    """Write the rows of one run and return them as read back.

    The run's own partition is written, so a repeated run replaces it, also by nothing. Rows come back
    with the layout they had: neither an empty run nor a run id that looks like a number is inferred.
    """
    rows = df.drop("run_id")
    rows.write.mode("overwrite").parquet(_partition(path, run_id))
    return read_run(df.sparkSession, path, run_id, rows.schema)


def read_run(spark: SparkSession, path: str, run_id: str, schema) -> DataFrame:
    """The rows of one run, none if it was never written."""
    own = _partition(path, run_id)
    rows = spark.read.schema(schema).parquet(own) if exists(spark, own) else spark.createDataFrame([], schema)
    return rows.withColumn("run_id", F.lit(run_id))


def read_history(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], ddl)
    return spark.read.schema(ddl).parquet(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return read_history(spark, path, SCORES_DDL)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The ledger with one row per run: a later entry replaces an earlier one."""
    entries = read_history(spark, path, RUNS_DDL + ", entry int")
    fields = [c for c in entries.columns if c not in ("run_id", "entry")]
    return entries.groupBy("run_id").agg(F.max_by(F.struct(*fields), "entry").alias("e")).select("run_id", "e.*")


def read_health(spark: SparkSession, path: str) -> DataFrame:
    return read_history(spark, path, HEALTH_DDL)


def ledger_entry(
    spark: SparkSession, run_id: str, status: str, started_at: str, stats: dict | None = None, error: str | None = None
) -> DataFrame:
    """One ledger row: started, completed or failed."""
    fields = ("total_collected", "total_normalized", "total_new", "total_reopened", "total_high_signal", "total_errors")
    stats = stats or {}
    row = spark.range(1).select(
        F.lit(run_id).alias("run_id"),
        F.lit(status).alias("status"),
        as_timestamp(started_at).alias("started_at"),
        F.when(F.lit(status != "started"), as_timestamp(started_at)).alias("completed_at"),
        *[F.lit(stats.get(f)).cast("bigint").alias(f) for f in fields],
        F.lit(error).cast("string").alias("error"),
        F.lit(0 if status == "started" else 1).alias("entry"),
    )
    return row


def append_ledger(entry: DataFrame, path: str, run_id: str, entry_no: int) -> None:
    """Ledger entries of a run are separate files; a repeated entry replaces itself."""
    entry.drop("run_id", "entry").write.mode("overwrite").parquet(f"{_partition(path, run_id)}/entry={entry_no}")


def raw_rows(collected: DataFrame) -> DataFrame:
    """Landed rows with their description hash and full payload."""
    text = strip(F.when(F.length("description_text") > 0, F.col("description_text")).otherwise(F.col("title")))
    payload = F.to_json(F.struct(*[c for c in collected.columns]))
    return collected.withColumns({"raw_description_hash": F.sha2(text, 256), "payload_json": payload})


def score_rows(ranked: DataFrame, as_of: str) -> DataFrame:
    """Score history in its declared types: without skills in the profile, lists have no type of their own."""
    fields = [f for f in T.StructType.fromDDL(SCORES_DDL).fields if f.name != "run_id"]
    rows = ranked.withColumn("created_at", as_timestamp(as_of))
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def read_state(spark: SparkSession, root: str) -> DataFrame:
    return read_snapshot(spark, root, STATE_DDL)


# --- dimensions ------------------------------------------------------------------------------


def upsert_dimension(current: DataFrame, configured: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Configured rows replace stored ones by key; ``keep`` columns stay as stored, others are kept
    only where the configuration has no such row."""
    both = current.select(key, F.struct(*current.columns).alias("old")).join(
        configured.select(key, F.struct(*configured.columns).alias("new")), key, "full_outer"
    )
    configured_columns = set(configured.columns)

    def value(name: str):
        old = F.col(f"old.{name}")
        if name == key:
            return F.col(key)
        if name not in configured_columns:
            return old
        if name in keep:
            return F.coalesce(old, F.col(f"new.{name}"))
        return F.when(F.col("new").isNotNull(), F.col(f"new.{name}")).otherwise(old)

    return both.select(*[value(c).alias(c) for c in current.columns])


# --- seen-sets -------------------------------------------------------------------------------


def guard_scope(seen: DataFrame, scope: str, version: int | None = 1, stored_version: int | None = 1) -> DataFrame:
    """The seen-set if it is of this format and scope; otherwise refuse to go on."""
    if stored_version != version:
        raise StateRefused(f"seen-set has format {stored_version}, expected {version}")
    wanted = {"scope": "string", "key": "string", "first_seen_at": "timestamp"}
    kinds = {f.name: f.dataType.simpleString() for f in seen.schema}
    if any(kinds.get(name) != kind for name, kind in wanted.items()):
        raise StateRefused(f"seen-set has columns {kinds}")
    foreign = seen.filter((F.col("scope") != scope) | F.col("key").isNull() | F.col("first_seen_at").isNull())
    if not foreign.isEmpty():
        raise StateRefused("seen-set belongs to another scope or holds invalid rows")
    return seen


def retain_latest(seen: DataFrame, limit: int = rules.Limits.seen_retention) -> DataFrame:
    """Latest keys per scope; each task keeps at most ``limit`` rows of a scope before the shuffle.

    A key that is dropped counts as new when it comes again. No watch calls this; it is for users who
    want a bounded seen-set and accept that.
    """
    order = Window.partitionBy("scope").orderBy(F.col("first_seen_at").desc(), "key")
    return seen.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= limit).drop("_place")
