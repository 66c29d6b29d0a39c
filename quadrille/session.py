"""Session defaults and shipping of this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.parquet.compression.codec": "zstd",
}


def build_session(app: str = "quadrille", master: str | None = None, **conf) -> SparkSession:
    """A session with this engine's defaults; `conf` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    spark = builder.config(map=DEFAULTS | conf).getOrCreate()
    ship(spark)
    return spark


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per context, whatever path the driver found it on.

    Batches to Python are held to 8 MB unless the session asks for another size: rows of text can be very long."""
    sc = spark.sparkContext
    if spark.conf.get(ARROW_BYTES, None) in (None, "67108864b"):  # not set, or Spark's default
        spark.conf.set(ARROW_BYTES, "8m")
    if not getattr(sc, "_quadrille_shipped", False):
        root = Path(__file__).resolve().parent
        out = os.path.join(tempfile.mkdtemp(), "quadrille.zip")
        with zipfile.ZipFile(out, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(p.relative_to(root.parent)))
        sc.addPyFile(out)
        sc._quadrille_shipped = True
    return spark
