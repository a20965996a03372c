"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def build_session(master: str | None = None, app: str = "quaestor", **conf) -> SparkSession:
    """A session with the settings the jobs expect; cluster settings win over none of them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # split a hot key even where that costs one more exchange
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # vectors are wide rows: keep Arrow batches a few MB
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        # a checkpoint goes when the driver no longer refers to it
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, where it need not be installed."""
    app = spark.sparkContext.applicationId
    package = Path(__file__).parent
    if app not in _shipped and package.is_dir():
        archive = Path(tempfile.mkdtemp(prefix="quaestor-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(archive))
        _shipped.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: `spark.checkpoint.dir`. Where it is unset, a cluster uses a
    folder beside the warehouse, which has to be shared, and a local master a temporary one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        sc.setCheckpointDir(configured or _default_dir(spark))
        current = sc.getCheckpointDir()
    return configured or current


def _default_dir(spark: SparkSession) -> str:
    if re.match(r"local(\[|$)", spark.sparkContext.master):
        return tempfile.mkdtemp(prefix="quaestor-")
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if warehouse.startswith("file:") or "://" not in warehouse:
        raise ValueError("set spark.checkpoint.dir: the warehouse is a local folder, which executors may not share")
    return f"{warehouse.rstrip('/')}/_scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df):
    """Reliable checkpoint: survives lost executors, cuts the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def spread(df):
    """Give a table that arrives in fewer partitions than there are cores to all of them.

    Large tables arrive in many splits and pass unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
