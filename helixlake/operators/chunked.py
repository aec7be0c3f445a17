"""Long runs in chunks: each chunk's result stands by itself, failures are recorded, and a repeated run goes on where it stopped."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.plans.lineage import new_path, remove


def run_chunks(df: DataFrame, key: str, chunks: int, run: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """(chunk, status, error): `run` applied to every chunk of `df` (by a hash of `key`), results under `path`/chunk=<n>.

    The rows are divided once, so a chunk reads its own part only. A chunk that fails is reported with its error and the others
    go on; one whose result is complete already is not run again ("done"). Rows with a null key are in a chunk as well.
    """
    spark = df.sparkSession
    parts = new_path(spark, "chunks")
    number = F.pmod(F.xxhash64(key), F.lit(chunks)).cast("int")
    df.withColumn("_chunk", number).write.partitionBy("_chunk").parquet(parts)
    held = spark.read.schema(df.withColumn("_chunk", number).schema).parquet(parts)
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    rows = []
    for c in range(chunks):
        where = f"{path.rstrip('/')}/chunk={c}"
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")):
            rows.append((c, "done", None))
            continue
        try:
            run(held.where(F.col("_chunk") == c).drop("_chunk")).write.mode("overwrite").parquet(where)
            rows.append((c, "ok", None))
        except Exception as e:  # noqa: BLE001
            rows.append((c, "failed", str(e).splitlines()[0][:200]))
    remove(spark, parts)
    return spark.createDataFrame(rows, "chunk int, status string, error string")
