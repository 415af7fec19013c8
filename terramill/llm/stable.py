"""Samples that stay the same on every run and layout, and only grow with the data.

A record is selected if its salted key hash is below the threshold of its
stratum. Thresholds are a stored table of configurations and strata: a run reads
it, raises each threshold to the stratum's rate where that is higher, writes the
table back and selects by it. They never depend on other records, so new records
can't push out old ones, and a lowered rate doesn't either.

Scale: the hash is a column expression; one shuffle brings the rows of a POI
together, with partial aggregation before it. Thresholds are as many rows as
configurations times strata; the planner broadcasts them if they are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terramill.functions.text import fold_category
from terramill.session import Scratch

#: The hash has this many values; md5 so that any engine can compute it.
SPAN = 1 << 32
NO_STRATUM = "(none)"


def key_hash(salt: Column, key: Column) -> Column:
    """First 32 bits of md5 of 'salt:key' as a number from 0 to SPAN - 1."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", salt.cast("string"), key.cast("string"))), 1, 8), 16, 10).cast("long")


def strata(df_osm: DataFrame) -> DataFrame:
    """(poi_id, stratum): each POI once, by the folded category of its earliest row, so that later rows don't move it.

    Ties of loaded_at go to the least category; null or blank is NO_STRATUM; a
    null loaded_at counts as the latest. Null poi_ids are left out.
    """
    stratum = F.coalesce(F.nullif(fold_category(F.col("category")), F.lit("")), F.lit(NO_STRATUM))
    rows = df_osm.where("poi_id IS NOT NULL").select(F.col("poi_id").cast("long").alias("poi_id"), F.struct(F.col("loaded_at").isNull().alias("late"), F.unix_micros("loaded_at").alias("at"), stratum.alias("stratum")).alias("row"))
    return rows.groupBy("poi_id").agg(F.min("row").alias("row")).select("poi_id", "row.stratum")


THRESHOLDS = "config_id long, seed long, stratum string, bound long"


def rated(configs: DataFrame, strata_of: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """THRESHOLDS of the configurations' rates: ``ratio_test``, or the rate that ``rates`` (config_id, stratum, rate) sets for a stratum.

    A null seed is 0. Rows of one configuration and seed take the highest ratio.
    """
    bound = lambda c: F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)))) * SPAN).cast("long")
    rows = configs.where("config_id IS NOT NULL").groupBy(F.col("config_id").cast("long").alias("config_id"), F.coalesce(F.col("seed"), F.lit(0)).cast("long").alias("seed")).agg(F.max(bound(F.col("ratio_test").cast("double"))).alias("bound"))
    each = strata_of.select("stratum").distinct()
    rows = rows.join(each, F.lit(True)).select("config_id", "seed", "stratum", "bound")  # configurations times strata: the table itself
    if rates is None:
        return rows
    own = rates.groupBy("config_id", "stratum").agg(F.max(bound(F.col("rate").cast("double"))).alias("own"))
    return rows.join(own, ["config_id", "stratum"], "left").select("config_id", "seed", "stratum", F.coalesce("own", "bound").alias("bound"))


def raised(stored: DataFrame | None, rates: DataFrame) -> DataFrame:
    """The higher threshold of the two tables, for every configuration, seed and stratum of either."""
    rows = rates if stored is None else stored.select(rates.columns).unionByName(rates)
    return rows.groupBy("config_id", "seed", "stratum").agg(F.max("bound").alias("bound"))


class Store:
    """Thresholds in a folder: each run writes a new version, the last complete one holds."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        files = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(at):
            return []
        names = [f.getPath() for f in files.listStatus(at)]
        return sorted(int(n.getName()[1:]) for n in names if n.getName()[1:].isdigit() and files.exists(jvm.org.apache.hadoop.fs.Path(n, "_SUCCESS")))

    def read(self) -> DataFrame | None:
        known = self.versions()
        return self.spark.read.schema(THRESHOLDS).parquet(f"{self.path}/v{known[-1]}") if known else None

    def raise_to(self, rates: DataFrame) -> DataFrame:
        """Writes the raised thresholds as the next version and returns them."""
        known = self.versions()
        raised(self.read(), rates).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/v{known[-1] + 1 if known else 0}")
        return self.read()


def selected(pois: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(config_id, stratum, poi_id) of the rows of ``pois`` (poi_id, stratum) below their stratum's thresholds."""
    asked = thresholds.where("bound > 0").groupBy("stratum").agg(F.collect_list(F.struct("config_id", "seed", "bound")).alias("asked"))  # one entry per configuration
    rows = pois.join(asked, "stratum").select("stratum", "poi_id", F.inline("asked"))
    return rows.where(key_hash(F.col("seed"), F.col("poi_id")) < F.col("bound")).select("config_id", "stratum", "poi_id")


def config_samples(df_osm: DataFrame, configs: DataFrame, store: str | None = None, rates: DataFrame | None = None) -> DataFrame:
    """p6_sample (config_id, stratum, poi_id): for each configuration the sample of its seed at its test share.

    ``store`` is the folder of the thresholds, to be given again when the sample
    is to keep its members; without it the run has a store of its own, which
    starts empty. A null seed is 0, a null, NaN or negative share selects
    nothing, a share above 1 everything. Repeated rows of a POI count once;
    empty tables give no rows.
    """
    spark = df_osm.sparkSession
    scratch = Scratch(spark, "stable")
    pois = scratch.cut(strata(df_osm), "strata")
    kept = Store(spark, store or scratch.path("thresholds"))
    return selected(pois, kept.raise_to(rated(configs, pois, rates)))
