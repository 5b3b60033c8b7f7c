"""Session helpers: a local session for tests and the checkpoint folder that executors share."""

from __future__ import annotations

import functools
import io
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def local_session(cores: str = "8", shuffle: int = 8, name: str = "cuelake", memory: str = "8g") -> SparkSession:
    """A local session with the settings that the operators assume (UTC, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        # Small partitions may carry much work in Python; don't merge them below the number of cores.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the folder that the cluster names in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isEmpty():
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cuelake-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder; the files survive the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def partitions_for(df: DataFrame, least: int = 1) -> int:
    """Partitions of an exchange: as the session is configured, so that it follows the cluster."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    # In the folder that all executors share, through its own file system.
    ensure_checkpoint_dir(spark)
    target = sc._jvm.org.apache.hadoop.fs.Path(sc._jsc.sc().getCheckpointDir().get(), "cuelake.zip")
    out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(target.toString())


def shipped(query: Callable) -> Callable:
    """The query, after the package has been sent to the executors."""

    @functools.wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return query(spark, folder)

    return run


_SIMPLE = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "timestamp": T.TimestampNTZType()}


def _kind(name: str) -> T.DataType:
    return T.ArrayType(_kind(name[6:-1])) if name.startswith("array<") else _SIMPLE[name]


def struct(fields: str) -> T.StructType:
    """A flat schema from ``name type, ...``; unlike ``fromDDL`` it needs no running session."""
    return T.StructType([T.StructField(n, _kind(k)) for n, k in (x.split() for x in fields.split(","))])


def arrow_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """A record batch of row tuples."""
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the input comes in fewer partitions than there are cores (a small single file); large
    inputs, which come in many splits, pass as they are without an exchange."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def bounded_sample(rows: DataFrame, key: str, most: int, n: int | None = None) -> DataFrame:
    """The rows with the smallest hashes of ``key``, at most ``most``. Rows far from being among them are dropped before the
    ordering, so the driver gets little more than ``most`` rows however many partitions there are. ``n`` is the number of
    rows, counted if it isn't known."""
    h = F.xxhash64(key)
    n = rows.count() if n is None else n
    if n > most:
        share = min(1.0, (1.2 * most + 50) / n)
        rows = rows.where(h < F.lit(min(2**63 - 1, int(-(2**63) + share * 2**64))))
    return rows.orderBy(h, key).limit(most)
