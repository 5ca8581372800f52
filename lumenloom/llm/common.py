"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import sys
import tempfile
import types
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a new one only where the session names none and runs on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir isn't set: intermediate tables need a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lumenloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    back = spark.read.schema(schema).parquet(path)
    back._lumenloom_path = path
    return back


def discard(*dfs: DataFrame) -> None:
    """Delete what materialize() wrote; only for results that nothing will read again."""
    for df in dfs:
        path = getattr(df, "_lumenloom_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def fold(doc_id: Column | str, modulus: int, held: int) -> Column:
    """crc32(doc_id as text) mod modulus = held; false for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % modulus == held, F.lit(False))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, even where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def worker_cached(key: str, make: Callable[[], Any]) -> Any:
    """One object per Python worker process, kept between tasks."""
    store = sys.modules.setdefault("_lumenloom_worker_cache", types.ModuleType("_lumenloom_worker_cache"))
    if not hasattr(store, key):
        setattr(store, key, make())
    return getattr(store, key)


def tidy(run: Callable) -> Callable:
    """A function for mapInArrow that gives the memory it no longer needs back to the system at the end of its task.

    Workers live on between tasks, and what their allocators keep would add up beside the executor's heap.
    """

    def tidied(batches):
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return tidied


def add_columns(df: DataFrame, text_col: str, fields: str, compute: Callable[[list[str | None]], list[Any]]) -> DataFrame:
    """df without text_col, plus the columns that compute(texts) returns for each Arrow batch.

    fields: their names and types as DDL. Other columns pass as they are, nulls included; those that
    clash with a new name are replaced.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(fields)
    rest = [c for c in df.columns if c != text_col and c.lower() not in {n.lower() for n in new.names}]
    schema = StructType([*(df.schema[c] for c in rest), *new.fields])
    types = [f.type for f in to_arrow_schema(new)]

    def run(batches):
        for batch in batches:
            made = compute(batch.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *(pa.array(v, t) for v, t in zip(made, types))], names=schema.names)

    return df.select(*rest, text_col).mapInArrow(tidy(run), schema)
