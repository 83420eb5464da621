"""Sessions, and the package on executors."""

from __future__ import annotations

import tempfile
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: weakref.WeakSet = weakref.WeakSet()


def session(name: str = "lodeframe", **conf: str) -> SparkSession:
    """UTC, adaptive plans, Arrow; anything else as the cluster has it or ``conf`` says."""
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"} | conf
    return SparkSession.builder.appName(name).config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends the package's modules to Python workers, which may start in another folder; once for each context."""
    context = spark.sparkContext
    if context in _shipped:
        return
    root = Path(__file__).parent
    with tempfile.NamedTemporaryFile(prefix="lodeframe-", suffix=".zip", delete=False) as out:
        with zipfile.ZipFile(out, "w") as packed:
            for file in sorted(root.rglob("*.py")):
                packed.write(file, file.relative_to(root.parent))
    context.addPyFile(out.name)
    _shipped.add(context)
