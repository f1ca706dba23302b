"""Session factory and checkpoints."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def session(app: str = "pavewise", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; a cluster's own settings win where they are given."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the folder of spark.checkpoint.dir.

    Where that is unset a local folder is made, in local mode alone: on a cluster executors do not share one.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        given = sc.getConf().get("spark.checkpoint.dir", None)
        if not given and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="pavewise-core-"))
    return df.checkpoint()


def importable(spark: SparkSession) -> None:
    """Make this package importable on executors, for functions that run there.

    When the repository is neither the working folder nor on PYTHONPATH, a zip of the package goes out through Spark's own
    file server, once for each application, as ``--py-files`` would send it.
    """
    on_path = [p or "." for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]]
    # A folder of links to the repository counts too: the package is then found below it.
    if any(os.path.exists(os.path.join(p, "pavewise", "session.py")) for p in on_path):
        return
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        target = Path(tempfile.mkdtemp(prefix="pavewise-")) / "pavewise.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in (ROOT / "pavewise").rglob("*.py"):
                z.write(p, p.relative_to(ROOT))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(app)
