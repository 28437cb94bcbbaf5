"""Getting a session ready: the package itself has to reach the Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> SparkSession:
    """Hand this package to every executor of the session's application, once."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        top = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="lemmagraph-")) / "lemmagraph.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, f"{top.name}/{p.relative_to(top)}")
        sc.addPyFile(str(target))
        _shipped[sc.applicationId] = str(target)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir of the session; one of our own only where it is unset and the
    session is local, as on a cluster no other machine would see it."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    held = sc._jsc.sc().getCheckpointDir()
    if named is None and not held.isDefined():
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='lemmagraph-checkpoints-')}"
    if not held.isDefined():
        sc.setCheckpointDir(named)
    return named or held.get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and forget the lineage; lost executors lose nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
