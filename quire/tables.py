"""Access to the parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of folder ``sf_dir`` (a parquet file or a folder of parquet files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(df: DataFrame, arrival: str, *columns: str) -> DataFrame:
    """Each record once, without its arrival; of ``columns`` only, where given.

    Deliveries of a record repeat its id and values, so only the arrival can differ, and the distinct rows of the rest
    are the records: a hash aggregate with a partial step before the shuffle, no sort and no window. Narrow ``columns``
    keep the shuffle narrow; they must hold the id where records may agree in all else.
    """
    return (df.select(*columns) if columns else df.drop(arrival)).distinct()


def lookup(df: DataFrame, table: DataFrame, keys: list[str], how: str = "left", most_rows: int = 200_000, most_bytes: int = 32 << 20, salts: int = 32) -> DataFrame:
    """``df`` joined to ``table`` (one row per key) on keys of which one may hold a large part of ``df``.

    ``table`` is broadcast if its rows and the bytes of its strings are few (both counted); else both sides are salted:
    the rows of ``df`` by their own hash, and each row of ``table`` once for every salt. ``table`` is read twice, so it
    should be a written table.
    """
    strings = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in table.schema if f.dataType.typeName() == "string"]
    n, size = table.agg(F.count("*"), F.sum(sum(strings, F.lit(0)))).first()
    if n <= most_rows and (size or 0) <= most_bytes:
        return df.join(F.broadcast(table), keys, how)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int"))
    return salted.join(table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*keys, "_salt"], how).drop("_salt")


def spread(scan: DataFrame) -> DataFrame:
    """A scan of fewer partitions than the session has cores, dealt out evenly; any other scan as it is.

    For costly row-by-row work over tables of few files. Large tables have more partitions than cores and are not
    shuffled. The result is the same rows.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
