"""Session helpers: the shared checkpoint folder and lineage cuts."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point Spark at the cluster's shared checkpoint folder.

    The folder named in ``spark.checkpoint.dir`` always wins. Only a local
    master without that setting (tests) gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="run-")
    sc.setCheckpointDir(shared)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Functions that run in Python workers call helpers of their modules, so the
    workers must be able to import the package from wherever they were started.
    """
    sc = spark.sparkContext
    if getattr(sc, "_moodloom_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    # addPyFile serves the archive from the driver to every executor.
    path = os.path.join(tempfile.mkdtemp(prefix="run-"), f"{os.path.basename(package)}.zip")
    with open(path, "wb") as f:
        f.write(data.getvalue())
    sc.addPyFile(path)
    sc._moodloom_shipped = True


#: Codec of the large tables of the analysis, which many steps write and read.
PACKED = "zstd"


def settle(df: DataFrame, together: bool = False, packed: bool = False) -> DataFrame:
    """Write ``df`` once as a Parquet table in the checkpoint folder.

    Used for tables that several results read, and where two branches must see
    the very same rows. Later reads prune columns, know the real size, and a
    lost executor never replays the lineage. ``together`` plans joins of keyed tables as
    ``settle_keyed`` does, ``packed`` spends time on smaller files.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{folder}/tables/{uuid.uuid4().hex}"
    with _joined_in_place(spark, together):
        (df.write.option("compression", PACKED) if packed else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_keyed(df: DataFrame, keys: Sequence[str], inside: Sequence[str] = (), moved: bool = False) -> DataFrame:
    """``settle`` as a bucketed table: later joins and groupings on ``keys`` read it where
    it lies, without a shuffle. Rows lie in order of ``keys`` and ``inside``.

    ``moved`` says that the plan of ``df`` already ends partitioned by ``keys``, as a join of
    such tables does. Two of them join on more than ``keys`` without a shuffle; the setting for
    it holds only while this one write is planned.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    name = f"settled_{uuid.uuid4().hex}"
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df if moved else df.repartition(parts, *keys)
    writer = rows.write.format("parquet").bucketBy(parts, *keys).sortBy(*keys, *inside)
    with _joined_in_place(spark, True, moved):
        writer.option("compression", PACKED).option("path", f"{folder}/tables/{name}").saveAsTable(name)
    return spark.table(name)


@contextmanager
def _joined_in_place(spark: SparkSession, on: bool, whole: bool = False):
    """``whole``: buckets are read whole even where no join or grouping asks for it."""
    wanted = {"spark.sql.requireAllClusterKeysForCoPartition": "false"} if on else {}
    if whole:
        wanted["spark.sql.sources.bucketing.autoBucketedScan.enabled"] = "false"
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


#: Rows of a partition whose sorts stay in the memory of a task.
PART_ROWS = 200_000


@contextmanager
def sized(spark: SparkSession, rows: int):
    """Plans what is written inside for a table of ``rows`` rows: partitions and buckets grow
    with it, so that a task sorts about as much at any size and nothing spills.

    Splits of files and merged partitions are small for the same reason; the tables are packed,
    a few bytes a row.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = {}
    if rows > PART_ROWS:
        wanted = {
            "spark.sql.shuffle.partitions": str(max(parts, -(-rows // PART_ROWS))),
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
            "spark.sql.files.maxPartitionBytes": "4m",
        }
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def state_folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder, for tables that a job keeps changing."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/state/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, for small states between iterations."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_in_place(df: DataFrame) -> DataFrame:
    """``cut`` that also keeps the hash partitioning of ``df``.

    An adaptive plan reports no partitioning, so a later join on the same keys
    would move the rows again. The adaptive mode is off only while this one
    write is planned; ``df`` has to be evenly partitioned already.
    """
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(df.select("*"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
