"""Session construction and the shared folder that cut lineages are written to."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "tallystone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings results depend on (UTC, ANSI, AQE); further settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, so that their Python workers can import it anywhere."""
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tallystone-")
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: the session's ``spark.checkpoint.dir``.

    Only where the session names none and runs in one process (tests) is a temporary one set; on a
    cluster each executor would write to a disk of its own, so that is an error.
    """
    found = spark.conf.get(CHECKPOINT_KEY, None)
    if not found:
        if not _is_local(spark):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallystone-")
        spark.conf.set(CHECKPOINT_KEY, found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back.

    Cuts the lineage: what follows reads files that outlive the executors that wrote them, and a
    value that depends on partition numbers is computed once. The files stay when the query is done: the
    result may be read again, and an executor that is lost later asks for them. Who owns the folder clears
    it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
