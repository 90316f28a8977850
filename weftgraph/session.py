"""Session helpers shared by queries, tests and the benchmark."""

from __future__ import annotations

import gc
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F


def local_session(cores: str = "*", partitions: int = 8, name: str = "weftgraph") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_shipped: set[str] = set()


def _is_local(spark: SparkSession) -> bool:
    """Executors are threads of the driver: they share its path and its folders."""
    return spark.sparkContext.master.split("[")[0] == "local"


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once per application; a local master has it already."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parent.parent
    if not _is_local(spark) and (root / "weftgraph").is_dir():
        folder = tempfile.mkdtemp(prefix="weftgraph-")  # the driver serves the archive itself
        sc.addPyFile(shutil.make_archive(f"{folder}/weftgraph", "zip", root, "weftgraph"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local master may do without: it gets a private folder. Elsewhere a folder of the
    driver's machine would lose what executors write, so there the setting has to be made.
    Checkpoints are deleted once nothing refers to them.
    """
    sc = spark.sparkContext
    sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not _is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="weftgraph-ckpt-"))


def cut(df):
    """``df`` with its lineage cut at a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def nothing(df) -> bool:
    """Whether the optimiser sees, before any job, that ``df`` has no rows: a side that a join needs is known to be empty."""
    most = df._jdf.queryExecution().optimizedPlan().maxRows()
    return most.isDefined() and most.get() == 0


def cut_some(df):
    """``cut``; where there is nothing to keep, no rows with a plan as short."""
    return without_rows(df) if nothing(df) else cut(df)


def without_rows(df):
    """No rows of the columns of ``df``."""
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]
    return df.sparkSession.range(0).select(*nulls).where(F.lit(False))


def settle(df):
    """``cut``, and then what earlier rounds of a loop left on disk is given back, as far as nothing refers to it."""
    done = cut(df)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return done


_tables: dict[str, list[str]] = {}


def cut_table(df):
    """Like ``cut``, for large tables: written to the shared folder as a compressed table and read back.

    The table stays until ``release``, as the result may be read at any time.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    _tables.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables that ``cut_table`` wrote in this application; results that read them must be done with."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _tables.pop(spark.sparkContext.applicationId, []):
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def numbered(df, name: str, *order: str):
    """``df`` with a number ``name`` from 0, without gaps, in the given order; rows that are equal in it
    are numbered as they come. No group meets in one task: rows are dealt by range, equal ones too."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie, part, before = f"{name} tie", f"{name} part", f"{name} before"
    by = [F.col(f"`{c}`") for c in (*order, tie)]
    placed = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(n, *by).sortWithinPartitions(*by).drop(tie)
    placed = cut(placed.withColumn(name, F.monotonically_increasing_id()))  # the partition, then the place in it
    of = F.shiftright(F.col(f"`{name}`"), 33)
    counts = placed.groupBy(of.alias(part)).agg(F.count("*").alias(before))  # one row for each partition
    counts = counts.select(f"`{part}`", (F.sum(f"`{before}`").over(Window.orderBy(f"`{part}`")) - F.col(f"`{before}`")).alias(before))
    whole = placed.withColumn(part, of).join(F.broadcast(counts), part)
    return whole.withColumn(name, F.col(f"`{before}`") + F.col(f"`{name}`").bitwiseAND(F.lit((1 << 33) - 1))).drop(part, before)


def table(spark: SparkSession, sf_dir: str, name: str):
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
