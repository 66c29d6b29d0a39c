"""Small Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.session import ship
from quadrille.storage import discard, materialise

__all__ = ["discard", "materialise", "ship", "skew_join", "table", "texts"]
HEAVY = 4000  # rows of one join key beyond which they are dealt to several tasks
HEAVY_BROADCAST = 100_000
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """The two columns that text operators read; other columns are never touched."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def skew_join(rows: DataFrame, keys: DataFrame, on: list[str], n: str = "n", how: str = "inner", heavy: int = HEAVY) -> DataFrame:
    """rows joined with keys, which has one row per key and the number `n` of rows with it (dropped from the result).

    The rows of a key with more than `heavy` are dealt over n / heavy tasks, with a copy of the key's own row in
    each.  Heavy keys are few (rows / heavy at most); a list of more than `HEAVY_BROADCAST` is joined with a fixed
    number of salts instead of being broadcast.  The result is that of the plain join."""
    hot = keys.filter(F.col(n) > heavy).select(*on, F.ceil(F.col(n) / heavy).cast("int").alias("_parts"))
    count = hot.count()
    if not count:
        return rows.join(keys.drop(n), on, how)
    copies = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col(n) / heavy), F.lit(1)).cast("int") - 1))
    dealt = keys.withColumn("_salt", copies).drop(n)
    draw = F.xxhash64(*rows.columns)
    if count <= HEAVY_BROADCAST:
        marked = rows.join(F.broadcast(hot), on, "left")
    else:
        spread = hot.withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        marked = rows.withColumn("_draw", F.pmod(draw, F.lit(SALTS)).cast("int")).join(spread, [*on, "_draw"], "left").drop("_draw")
    salted = marked.withColumn("_salt", F.coalesce(F.pmod(draw, F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    return salted.join(dealt, [*on, "_salt"], how).drop("_salt")
