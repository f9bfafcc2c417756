"""Session-level helpers: the shared scratch folder and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.util import inheritable_thread_target

SIDE_BY_SIDE = 8           # pieces of work whose jobs are in Spark's hands at a time


def scratch_dir(spark: SparkSession) -> str:
    """A new sub-folder of the shared checkpoint folder.

    The folder named by ``spark.checkpoint.dir`` (or set on the context) is used; only a
    local session without one gets a temporary folder of its own.
    """
    context = spark.sparkContext
    base = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="tablewright-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a later step must see exactly the rows an earlier step saw; the written
    files survive lost executors.
    """
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def like(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    """A session with the present settings of ``spark`` but for the given ones, which change nothing in ``spark`` itself."""
    new = spark.newSession()
    has = new.conf.getAll
    for name, value in {**spark.conf.getAll, **settings}.items():
        if has.get(name) != value:
            new.conf.set(name, value)
    return new


def side_by_side(jobs: list[Callable], most: int = SIDE_BY_SIDE) -> list:
    """Results of the jobs in order; at most so many hand Spark their work at a time. The first failure is raised."""
    target = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(max_workers=most) as pool:
        return [f.result() for f in [pool.submit(target(job)) for job in jobs]]


def row_dicts(df: DataFrame) -> list[dict]:
    """Rows of a result whose size is bounded by the number of columns, not of rows."""
    return [row.asDict() for row in df.collect()]
