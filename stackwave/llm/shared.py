"""Places that the driver and all executors share, and small plan helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: spark.checkpoint.dir; where none is named, a temporary folder of this machine in local mode only (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    have = spark.sparkContext.getCheckpointDir()
    if not have:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="stackwave-checkpoint-")
        atexit.register(shutil.rmtree, own, True)
        spark.sparkContext.setCheckpointDir(f"file://{own}")
        have = spark.sparkContext.getCheckpointDir()
    return have.rstrip("/")


#: A table of up to so many narrow rows is written by ``FEW`` tasks, whatever number of partitions the session has.
SMALL, FEW = 1 << 20, 8


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back; ``rows`` bounds its rows, where that is known.

    It cuts the lineage: what follows neither recomputes ``df`` nor depends on an executor that may be lost, and it can
    prune columns.  ``discard`` removes tables that nothing reads any more; the folder's owner removes the rest.
    """
    path = f"{shared_dir(df.sparkSession)}/stackwave-{name}-{uuid.uuid4().hex}"
    if rows is None or rows > SMALL:
        df.write.parquet(path)
    else:
        with uncompiled(df.sparkSession):
            df.coalesce(FEW).write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


@contextmanager
def uncompiled(spark: SparkSession) -> Iterator[None]:
    """Plans that run inside aren't compiled stage by stage: for many steps over small tables, whose classes the driver would gather."""
    key = "spark.sql.codegen.wholeStage"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def discard(*tables: DataFrame) -> None:
    """Removes tables of ``materialize`` whose readers have all been written themselves."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Lets the session send texts to Python in batches of at most ``size`` bytes; a smaller setting stays.

    By rows alone a batch of long texts would be held several times over in the JVM and in the worker.
    """
    now = "".join(c for c in str(spark.conf.get(_BATCH)) if c.isdigit())
    if not now or int(now) > size:
        spark.conf.set(_BATCH, str(size))


def fits(df: DataFrame, column_bytes: int, budget: int = 32 << 20) -> bool:
    """Whether a table of fixed-width rows is small enough to broadcast; ``df`` should be materialized."""
    return df.count() * column_bytes <= budget


def maybe_broadcast(df: DataFrame, column_bytes: int, budget: int = 32 << 20) -> DataFrame:
    """A broadcast hint when the counted size is within the budget; otherwise the join shuffles both sides."""
    return F.broadcast(df) if fits(df, column_bytes, budget) else df


def by_group(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Cuts batches that are sorted by ``key`` into tables of whole groups (one or more groups a table).

    Rows of the last, perhaps unfinished, group wait for the next batch.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(key)
        keys = batch.column(at)
        last = keys[-1].as_py()
        if held and held[-1].column(at)[-1].as_py() == last and keys[0].as_py() == last:
            held.append(batch)
            continue
        values = keys.to_numpy(zero_copy_only=False)
        cut = len(values) - int((values[::-1] != last).argmax()) if values[0] != last else 0
        if held or cut:
            done = [*held, batch.slice(0, cut)] if cut else held
            yield pa.Table.from_batches(done).combine_chunks()
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def fresh(name: str, columns: Iterable[str]) -> str:
    """The name with underscores in front until no column has it, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
