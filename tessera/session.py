"""Session settings, and shipping of this package to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def build(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects; ``conf`` wins."""
    builder = SparkSession.builder.appName("tessera")
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", **conf}
    return ship(builder.config(map=settings).getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, where their path lacks it."""
    path = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    context = spark.sparkContext
    if str(ROOT.parent) in path or getattr(context, "_tessera_shipped", False):
        return spark
    at = Path(tempfile.mkdtemp(), f"{ROOT.name}.zip")
    with zipfile.ZipFile(at, "w") as z:
        for f in ROOT.rglob("*.py"):
            z.write(f, f.relative_to(ROOT.parent))
    context.addPyFile(str(at))
    context._tessera_shipped = True
    return spark
