"""Sessions, shipping this package to executors, and the shared work folder."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).parent


def local_session(app: str = "tessera", cpus: int | None = None, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever they run.

    Added once per application as a zip through Spark's own file service, so
    that no executor needs a copy of the repository.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, Path(_PACKAGE.name) / p.relative_to(_PACKAGE))
    folder = tempfile.mkdtemp(prefix="tessera-ship-")
    path = os.path.join(folder, f"tessera_{uuid.uuid4().hex[:12]}.zip")
    Path(path).write_bytes(buf.getvalue())
    sc.addPyFile(path)
    sc._tessera_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share.

    Only where the setting is empty (a local test) a folder of our own is set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not named:
        own = sc._jsc.sc().getCheckpointDir()
        named = own.get() if own.isDefined() else None
    if not named:
        if not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one; removed when the driver ends."""
    uri = f"{shared_dir(spark)}/tessera-work/{name}-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    made = getattr(sc, "_tessera_work", None)
    if made is None:
        made = sc._tessera_work = []
        atexit.register(cleanup, spark)
    made.append(uri)
    return uri


def cleanup(spark: SparkSession) -> None:
    """Delete every work folder that this driver made."""
    sc = spark.sparkContext
    made = getattr(sc, "_tessera_work", [])
    if sc._jsc is None:
        return
    jvm = sc._jvm
    conf = sc._jsc.hadoopConfiguration()
    while made:
        path = jvm.org.apache.hadoop.fs.Path(made.pop())
        path.getFileSystem(conf).delete(path, True)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it: lineage ends here.

    A lost executor costs nothing that was staged before.
    """
    spark = df.sparkSession
    path = workspace(spark, name)
    df.write.option("compression", "zstd").parquet(path)  # texts take half the room of the default
    return spark.read.schema(df.schema).parquet(path)
