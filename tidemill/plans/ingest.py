"""A folder of files into three tables, kept by file: chunks, their entities and their vectors.

A store is a folder with a version for every run that changed something; a version is written whole
before ``_DONE`` marks it, so a run that fails leaves the version before as it was. Only files that are
new or changed are cut, searched and embedded; the rows of unchanged files are carried over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.text import tier
from tidemill.operators import chunking, entities, models, store
from tidemill.sources.files import workspace_files

TABLES = ("files", "chunks", "entities", "vectors")


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def version(spark: SparkSession, path: str) -> int:
    """The newest finished version of a store; 0 where there is none."""
    fs, at = _folder(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    done = [int(n[2:]) for n in names if n.startswith("v=") and fs.exists(_folder(spark, f"{path}/{n}/_DONE")[1])]
    return max(done, default=0)


def read(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """A table of the newest version."""
    v = version(spark, path)
    return spark.read.parquet(f"{path}/v={v}/{name}") if v else None


def index(spark: SparkSession, folder: str, path: str, pattern: str = "*.md", force: bool = False) -> int:
    """Brings the store at ``path`` up to the files of ``folder`` that fit ``pattern``; gives its version.

    A file counts as changed by its time or size; with ``force`` all do. The rows of files that are gone
    go from all tables. Ids are hashes of path, place and content, so a second run gives the same rows.
    """
    found = workspace_files(spark, folder, pattern)
    before = {n: read(spark, path, n) for n in TABLES}
    marks = found.select("file_path", "modified", "size")
    changed, touched = found, found.select("file_path")
    if before["files"] is not None:
        if not force:
            changed = found.join(before["files"], ["file_path", "modified", "size"], "left_anti")
        gone = before["files"].join(marks, "file_path", "left_anti").select("file_path")
        touched = changed.select("file_path").unionByName(gone)
        if not force and touched.isEmpty():
            return version(spark, path)
    number = version(spark, path) + 1
    base = f"{path}/v={number}"
    pieces = chunking.chunk_files(changed.select("file_path", "text"))
    pieces = pieces.withColumn("id", store.chunk_id(F.col("file_path"), F.col("line_start"), F.struct("ordinal", "hash"))).drop("ordinal")
    marks.write.mode("overwrite").parquet(f"{base}/files")

    def keep(name: str, fresh: DataFrame) -> DataFrame:
        old = before[name]
        rows = fresh if old is None else old.join(touched, "file_path", "left_anti").unionByName(fresh)
        rows.select(*fresh.columns).write.mode("overwrite").parquet(f"{base}/{name}")
        return spark.read.parquet(f"{base}/{name}")

    made = keep("chunks", pieces).join(changed.select("file_path"), "file_path", "left_semi")
    places = made.select(F.col("id").alias("chunk_id"), "file_path")
    values = entities.extract(made).withColumnRenamed("id", "chunk_id").join(places, "chunk_id")
    keep("entities", values.withColumn("id", F.xxhash64("chunk_id", "entity_type", "entity_name", "entity_value")))
    keep("vectors", models.embed(made, "text").select("id", "file_path", tier(F.col("source")).alias("tier"), "vector"))
    fs, at = _folder(spark, f"{base}/_DONE")
    fs.create(at, True).close()
    return number
