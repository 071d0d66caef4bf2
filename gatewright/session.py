"""The session the library expects."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def session(app: str = "gatewright", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings by name, dots as double underscores."""
    builder = SparkSession.builder.appName(app)
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (fixed | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send the library to the executors, once an application, so that their Python workers can import it wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    home = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(), f"{home.name}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def in_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """df.mapInArrow, with the library shipped."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)
