"""Session set-up and delivery of this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_PACKAGE = Path(__file__).resolve().parent


def local_session(cpus: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that results depend on: UTC and adaptive execution."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("SPARK_DRIVER_MEMORY", "8g"),
        "spark.driver.host": "127.0.0.1",
    } | conf
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("starfold").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per context, so that their Python workers can import it.

    Arrow batches go down to 8 MB, unless the session asks for another size than Spark's default: a batch is
    held several times over, by the executor and by each of its Python workers.
    """
    context = spark.sparkContext
    if spark.conf.get(_BATCH).lower() in ("64mb", "67108864b", "67108864"):  # Spark's default
        spark.conf.set(_BATCH, "8m")
    if getattr(context, "_starfold_shipped", False):
        return spark
    archive = Path(tempfile.mkdtemp(prefix="starfold-")) / "starfold.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(_PACKAGE.rglob("*.py")):
            out.write(source, source.relative_to(_PACKAGE.parent))
    context.addPyFile(str(archive))
    context._starfold_shipped = True
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; without that setting only a local master gets a temporary one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder and not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="spark-shared-")


def materialize(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage: rows go to the shared folder, which a lost executor doesn't take along.

    Spark deletes the files of tables out of use where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
