"""Session settings the library relies on, and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark. On a cluster, pass your own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidecast")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``.

    A local session that names none gets a fresh temporary folder. A cluster that names none is
    an error: a folder on one machine would not outlive the loss of that machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    made = getattr(spark, "_tidecast_dir", None)
    if made is None:
        made = tempfile.mkdtemp(prefix="tidecast-")
        spark._tidecast_dir = made
    return made


def task_count(spark: SparkSession) -> int:
    """Tasks for work that costs time per series rather than per byte.

    Passed to ``repartition`` so that small inputs are not merged into one long task.
    """
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Shuffle a file scan that has fewer partitions than there are cores; leave others alone.

    For row-level work on small files only: a large table has more splits than cores.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, *keys) if keys else scan.repartition(cores)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses; ``stages`` knows it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    spark.__dict__.setdefault("_tidecast_paths", []).append(path)
    return path


@contextmanager
def stages(spark: SparkSession) -> Iterator[None]:
    """Remove the intermediate tables made inside, through the file system that holds them.

    A query reads its intermediate tables when its result is computed, so compute it inside.
    """
    made = spark.__dict__.setdefault("_tidecast_paths", [])
    before = len(made)
    try:
        yield
    finally:
        remove(spark, made[before:])
        del made[before:]


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete intermediate tables through the file system that holds them."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where several jobs read one intermediate result: it cuts the lineage, keeps the result
    when an executor is lost, and fixes row contents for later passes.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep(df: DataFrame, name: str = "training") -> DataFrame:
    """A table that many jobs will read, such as training rows: written once, then cached.

    Reading the written files packs small ones together, so later jobs do not run one task per
    shuffle partition; a lost executor costs a re-read, not a recomputation. Unpersist when done.
    """
    return materialise(df, name).persist()
