"""Session helpers: builder defaults, shared scratch folder, staged tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_SHIPPED = "_panelspark_shipped"


def build_session(app: str = "panelspark", cores: int | str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the plans rely on (UTC, AQE, Arrow).

    Master, shuffle partitions and memory stay as the cluster gives them; only a caller who asks for ``cores``
    gets a local session, with a scratch folder of its own in place of the cluster's shared one.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if cores is not None:
        builder = (
            builder.master(f"local[{cores}]")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", os.environ.get("PANELSPARK_DRIVER_MEMORY", "12g"))
            .config("spark.sql.shuffle.partitions", "8")
        )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    if cores is not None:
        spark.sparkContext.setLogLevel("FATAL")
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for each Spark context, so that Python workers can import it.

    The archive is built in the driver's own temporary folder; Spark serves it to the executors from there.
    """
    context = spark.sparkContext
    if not getattr(context, _SHIPPED, False):
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="panelspark-")) / "panelspark.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as packed:
            for path in sorted(root.rglob("*.py")):
                packed.write(path, path.relative_to(root.parent))
        context.addPyFile(str(archive))
        setattr(context, _SHIPPED, True)
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names that folder. Only a local session may leave it unset; it then gets a
    temporary one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = tempfile.mkdtemp(prefix="panelspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write once to the shared folder, with the writer's ``options``, and read back: cuts lineage, survives executor loss."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.parquet(path)


def numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    """``stage`` with a unique ``column`` that ascends with the rows of a partition; written at once, so that numbers stay."""
    return stage(df.withColumn(column, F.monotonically_increasing_id()), name)
