"""Session settings and the shared scratch folder that cuts lineage.

Lineage is cut by writing parquet tables below the folder that the cluster
names in ``spark.checkpoint.dir``: every executor reads them, so a lost
executor costs no recomputation of finished rounds.  Where the setting is
absent (tests, a laptop) a temporary local folder is used, and only there.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_MADE: set[tuple[str, str]] = set()
_SHIPPED: set[str] = set()


def build_session(app: str = "quillon", cpus: str = "*", **extra: str) -> SparkSession:
    """A local session with the settings that the library expects on a cluster too."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    conf.update({k.replace("__", "."): v for k, v in extra.items()})
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application below ``spark.checkpoint.dir``."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _LOCAL.setdefault(app, tempfile.mkdtemp(prefix="quillon-"))
        base = base if "://" in base else f"file://{base}"
    return f"{base.rstrip('/')}/quillon-{app}"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _sweep(spark: SparkSession, path: str) -> None:
    try:
        fs, p = _fs(spark, path)
        fs.delete(p, True)
    except Exception:
        pass


def table(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    The write cuts lineage.  The read has the known schema, so no job infers it.
    """
    spark = df.sparkSession
    root = shared_dir(spark)
    if (spark.sparkContext.applicationId, root) not in _MADE:
        _MADE.add((spark.sparkContext.applicationId, root))
        atexit.register(_sweep, spark, root)
    path = f"{root}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillon_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table made by :func:`table` once nothing reads it any more."""
    path = getattr(df, "_quillon_path", None)
    if path:
        _sweep(df.sparkSession, path)


def cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition only if the input has fewer splits than the cluster has cores.

    Large inputs keep their splits and pay no shuffle; a few big files in front
    of heavy per-row work are dealt out over the cores.  For scans only: asking
    for the splits of a plan with a shuffle would run it.
    """
    n = cores(df.sparkSession)
    if df.rdd.getNumPartitions() >= n:
        return df
    return df.repartition(3 * n, *keys) if keys else df.repartition(3 * n)


def deal(df: DataFrame) -> DataFrame:
    """Deal rows that come out of a shuffle evenly over the cores, for heavy work per row."""
    spark = df.sparkSession
    return df.repartition(max(2 * cores(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))))


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application: their Python workers import it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = os.path.dirname(os.path.abspath(__file__))
    held = os.path.join(tempfile.mkdtemp(prefix="quillon-ship-"), "quillon.zip")  # on the driver, which serves it
    with zipfile.ZipFile(held, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    p = os.path.join(folder, f)
                    z.write(p, os.path.join("quillon", os.path.relpath(p, root)))
    spark.sparkContext.addPyFile(held)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
