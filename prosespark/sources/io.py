"""Sources and sinks: texts, JSON lines, decisions, feedback, verified snapshots."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEEDBACK = "schema_version int, ts string, finding_id string, category string, metric string, genre string, recommendation string, user_action string, replacement string, alternative string, reason string, doc_sha string"
DECISIONS = "schema_version int, doc string, source_sha256 string, decisions array<struct<finding_id:string,user_action:string,replacement:string,alternative:string,reason:string>>"
MANIFEST = "source_id string, item_id string, source_family string, citation string, revision string, license string, allowed_uses array<string>, redistribution string, attribution string, direction string, tells array<string>, genre string, control boolean, after_validity string, artifact_lanes array<string>, content_hashes struct<before:string,after:string>, lineage string, notes string, split string, verbatim_path string"


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it has fewer partitions than there are cores (a small file has one row group); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """df dealt over all cores by its key, some parts a core: work on a text costs much more than moving it.

    Files don't tell how their rows lie: one row group is one task's, however many partitions a read has.
    """
    n = max(4 * df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions())
    return df.repartition(n, key)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, content, text, status, source_sha256, byte_length of files; what isn't UTF-8 has no text and a status."""
    rows = spark.read.format("binaryFile").load(path)
    good = F.is_valid_utf8(F.col("content").cast("string"))
    return rows.select("path", "content", F.when(good, F.col("content").cast("string")).alias("text"), F.when(good, F.lit("ok")).otherwise(F.lit("decode_error")).alias("status"), F.sha2("content", 256).alias("source_sha256"), F.octet_length("content").cast("bigint").alias("byte_length"))


def _schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """All items of a JSON-lines manifest; a single bad line fails the read."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", _schema(MANIFEST), {"mode": "FAILFAST"}).alias("m")).select("m.*")


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """Feedback lines; a missing path is empty, lines that aren't valid JSON objects are skipped."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], FEEDBACK)
    return spark.read.schema(FEEDBACK).option("mode", "DROPMALFORMED").json(path)


def append_feedback(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def reset_feedback(spark: SparkSession, path: str) -> None:
    """Delete the log; once more does nothing."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """A row a decision of each payload file, for validate.decisions."""
    rows = spark.read.schema(DECISIONS).option("multiLine", True).json(path)
    return rows.select("schema_version", F.col("doc").alias("doc_id"), "source_sha256", F.explode_outer("decisions").alias("d")).select("schema_version", "doc_id", "source_sha256", "d.*")


def envelopes(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, json: one object a row without null fields and never the source's bytes."""
    keep = [c for c, kind in rows.dtypes if kind != "binary"]
    return rows.select(key, F.to_json(F.struct(*keep), {"ignoreNullFields": "true"}).alias("json"))


def inert_json(column: Column) -> Column:
    """JSON that is safe inside a page: <, > and & as escapes."""
    out = column
    for c in "<>&":
        out = F.replace(out, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    return out


def write_snapshot(docs: DataFrame, path: str, run_id: str) -> DataFrame:
    """Write originals of a run, read them back and compare digests: rows that differ (must be none)."""
    out = f"{path}/run_id={run_id}"
    docs.select("doc_id", "content", F.sha2("content", 256).alias("sha")).write.mode("errorifexists").parquet(out)
    back = docs.sparkSession.read.parquet(out)
    return back.where(F.sha2("content", 256) != F.col("sha"))


def stale_snapshots(snapshots: DataFrame, keep: int = 10) -> DataFrame:
    """(source, stamp) rows beyond the newest keep of each source."""
    n = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("stamp")))
    return snapshots.withColumn("__n", n).where(F.col("__n") > keep).drop("__n")


def publish(revisions: DataFrame, current: DataFrame, path: str) -> DataFrame:
    """Write revisions whose documents still have the digest they were made from; returns those that drifted.

    revisions: doc_id, revision, source_sha256. current: doc_id, content.
    """
    now = current.select("doc_id", F.sha2("content", 256).alias("__now"))
    rows = revisions.join(now, "doc_id", "left")
    rows.where(F.col("source_sha256") == F.col("__now")).drop("__now").write.mode("errorifexists").parquet(path)
    return rows.where(~F.col("source_sha256").eqNullSafe(F.col("__now"))).drop("__now")


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the folder that driver and executors share, and read back, which cuts its lineage.

    That is spark.checkpoint.dir, or the session's checkpoint folder; only a local session may go without.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not base and sc._jsc.sc().getCheckpointDir().isDefined():
        base = sc._jsc.sc().getCheckpointDir().get()
    if not base and not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="prosespark-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
