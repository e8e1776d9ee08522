"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it is counted and its values hold at most so many bytes.
BROADCAST_BYTES = 24 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, or in local mode a new folder where that is unset."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    if path := spark.sparkContext.getCheckpointDir():
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Sets how many rows go to a Python worker at once, for the session. Documents are long: fewer than Arrow's usual 10,000 keep executors and their workers small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


#: Folders of stored tables that were not deleted yet, oldest first.
_made: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: a cut of the lineage that survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    _made.append(path)
    return out


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if at in _made:
        _made.remove(at)


@contextmanager
def working_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Within, the given function stores a result as stored() does; at the end all other tables that were stored meanwhile are deleted."""
    before, results = set(_made), set()

    def keep(df: DataFrame) -> DataFrame:
        out = stored(df)
        results.add(out.stored_at)
        return out

    try:
        yield keep
    finally:
        for path in [p for p in _made if p not in before and p not in results]:
            _delete(spark, path)


def discard(*tables: DataFrame) -> None:
    """Deletes stored() tables that nothing will read again."""
    for df in tables:
        _delete(df.sparkSession, df.stored_at)


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its counted values are few bytes; else Spark shuffles it as usual."""
    wide = [F.coalesce(F.octet_length(c.name), F.lit(0)) for c in df.schema if c.dataType.typeName() in ("string", "binary")]
    wide += [F.greatest(F.size(c.name), F.lit(0)) * 48 for c in df.schema if c.dataType.typeName() == "array"]
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(sum(wide, F.lit(0))), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if 16 * len(df.columns) * row.n + row.bytes <= BROADCAST_BYTES else df


def bucket_of(col: Column, n: int) -> Column:
    """A number in 0..n-1 from the md5 of the value's text; other engines can compute it too."""
    return F.coalesce(F.conv(F.substring(F.md5(col.cast("string")), 1, 8), 16, 10).cast("long") % n, F.lit(0).cast("long"))


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the id's text modulo n; 0 for a null id."""
    return F.coalesce(F.crc32(F.encode(col.cast("string"), "UTF-8")) % n, F.lit(0).cast("long"))


def rows_left(whole: DataFrame, key: list[str], gone: DataFrame, twice: DataFrame) -> DataFrame:
    """The rows (doc, *key) whose key is not in ``gone``, and of each key in ``twice`` only one: that of least hash over all its columns. Both sides are broadcast only if they are counted and small. A null in a key is in neither."""
    out = whole.join(small(gone), key, "left_anti")
    if not twice.isEmpty():
        hit = out.join(small(twice.withColumn("hit", F.lit(True))), key, "left")
        one = hit.where("hit").groupBy(*key).agg(F.min_by("doc", F.xxhash64("doc")).alias("doc"))
        out = hit.where("hit is null").select("doc").unionByName(one.select("doc"))
    return out.select("doc.*")
