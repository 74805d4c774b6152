"""Helpers that several operators share: Arrow column appenders, lineage cuts and word rules."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that one call of a Python kernel sees; bounds its memory whatever Arrow's batch size is.
SLICE_ROWS = 64

#: A key with more than one in HEAVY rows is heavy, so there are fewer than HEAVY of them; its rows are dealt to SALTS tasks.
HEAVY, SALTS = 1024, 64

#: Rows of a task over a table of two longs.
TASK_ROWS = 1 << 17


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names; a temporary one only in local mode, where it is unset."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, without the lineage before it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_table(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table of its own in the shared checkpoint folder: smaller than a checkpoint for wide or many rows."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def packed(df: DataFrame, rows: int) -> DataFrame:
    """``df``, a cut table of ``rows`` rows, in no more partitions than its rows need: each costs every later shuffle files."""
    return df.coalesce(max(1, -(-rows // TASK_ROWS)))


def freed(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files behind tables that are cut: it does so once the JVM has collected their plans."""
    gc.collect()  # plans that Python still holds
    spark.sparkContext._jvm.System.gc()


def heavy_keys(counted: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Keys of ``counted``, which has each key once, whose count ``n`` is above one in HEAVY of the sum of all."""
    total = counted.agg(F.sum(n)).first()[0] or 0
    return counted.where(F.col(n) > total / HEAVY).select(*keys)


def join_dealt(rows: DataFrame, other: DataFrame, keys: list[str], heavy: DataFrame, how: str = "inner") -> DataFrame:
    """Equi-join of ``rows`` with ``other``, which has each key once; no task gets all rows of a heavy key.

    The heavy keys are broadcast, as fewer than HEAVY of them exist. Their rows are dealt at random to SALTS groups, each
    with a copy of the one row of ``other``; other keys are joined as they are.
    """
    mark = F.broadcast(heavy.withColumn("salts", F.lit(SALTS)))
    salt = F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))).cast("int")
    dealt = rows.join(mark, keys, "left").withColumn("salt", salt).drop("salts")
    copies = other.join(mark, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return dealt.join(copies, [*keys, "salt"], how).drop("salt")


def append_arrow(df: DataFrame, kernel: Callable[[pa.RecordBatch], list], fields: str, keep: list[str] | None = None) -> DataFrame:
    """Appends what ``kernel`` computes from each slice of rows.

    ``fields``: DDL of the new columns; ``keep``: input columns that stay (all, if None). An input column with the
    name of a new one gives way to it. The kernel returns one Python list or Arrow array per new column.
    """
    new = T.StructType.fromDDL(fields)
    names = {f.name.lower() for f in new}
    kept = [f for f in df.schema if f.name.lower() not in names and (keep is None or f.name in keep)]
    schema = T.StructType(kept + list(new))
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in new]
    kept_names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                made = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(kernel(part), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(n)) for n in kept_names] + made, names=kept_names + [f.name for f in new])

    return df.mapInArrow(run, schema)


def emit_arrow(df: DataFrame, kernel: Callable[[pa.RecordBatch], list], fields: str) -> DataFrame:
    """Rows that ``kernel`` makes from each slice of rows: one list or array per column of ``fields``, of any length."""
    schema = T.StructType.fromDDL(fields)
    from pyspark.sql.pandas.types import to_arrow_type

    types, names = [to_arrow_type(f.dataType) for f in schema], schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                made = kernel(batch.slice(at, SLICE_ROWS))
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(made, types, strict=True)], names=names)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


@lru_cache(1)
def letter_table() -> np.ndarray:
    """Whether each code point is a letter; built once a worker."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
