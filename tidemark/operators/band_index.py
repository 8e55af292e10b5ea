"""Near-duplicates of a new day against all days before it, by a stored index of bands.

Each simhash is stored once for each of its bands, in a table bucketed and sorted by band key. A new day's bands are dealt to
the same buckets and meet the stored ones there: what is stored is read where it lies and never shuffled, however
long the history. The whole-table query's rule holds: six blocks of 10 or 11 bits, keys of three of them, distance 3 at most;
a document links to the first document before it, of its own day or of an earlier one, in order of its key.

Only the first document of a hash is stored, as later ones of the same hash never come before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import band_keys, linked
from tidemark.operators.discovery import stored


class BandIndex:
    def __init__(self, spark: SparkSession, name: str, buckets: int = 64):
        """``name``: a table of the session's catalog; ``buckets`` is fixed when it is first written."""
        self.spark, self.name, self.buckets = spark, name, buckets

    def bands(self, hashes: DataFrame, key: str) -> DataFrame:
        """band_key, simhash, first of each band of the distinct hashes. The key hashes band and number: what it lets meet by chance, the distance decides."""
        one = hashes.groupBy("simhash").agg(F.min(key).alias("first"))
        return one.select("simhash", "first", F.posexplode(band_keys(F.col("simhash"))).alias("band", "part")).select(F.xxhash64("band", "part").alias("band_key"), "simhash", "first")

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def add(self, hashes: DataFrame, key: str = "doc_id") -> None:
        """Store a day's hashes that are not stored yet; days come in order of their keys."""
        rows = self.bands(hashes, key).repartition(self.buckets, "band_key")
        rows.write.mode("append" if self.exists() else "errorifexists").format("parquet").bucketBy(self.buckets, "band_key").sortBy("band_key").saveAsTable(self.name)

    def earlier(self, hashes: DataFrame, key: str = "doc_id", distance: int = 3) -> DataFrame:
        """simhash, first (the first stored document within the distance), known (whether the hash itself is stored) of the day's hashes that have one."""
        new = self.bands(hashes, key).repartition(self.buckets, "band_key").select("band_key", F.col("simhash").alias("own"))
        old = self.spark.table(self.name)
        met = old.hint("merge").join(new, "band_key").where(F.bit_count(F.col("simhash").bitwiseXOR(F.col("own"))) <= distance)
        return met.groupBy(F.col("own").alias("simhash")).agg(F.min("first").alias("first"), F.max(F.col("own") == F.col("simhash")).alias("known"))

    def link(self, hashes: DataFrame, key: str = "doc_id") -> DataFrame:
        """key, near_duplicate_of of a day's rows (key, simhash), among themselves and those stored before them; then store them.

        Joins merge, as in ``linked``: a day's file of hashes may be small, and its rows many.
        """
        hashes = stored(hashes.select(key, "simhash"))
        own = linked(hashes, key)
        if not self.exists():
            self.add(hashes, key)
            return own.drop("simhash")
        found = stored(self.earlier(hashes, key))
        before = F.when(F.col("first") < F.col(key), F.least("first", F.coalesce("near_duplicate_of", "first"))).otherwise(F.col("near_duplicate_of"))
        out = stored(own.hint("merge").join(found, "simhash", "left").select(key, before.alias("near_duplicate_of")))
        one = hashes.groupBy("simhash").agg(F.min(key).alias(key))  # before the join, so that copies of one hash don't meet in a task
        self.add(one.hint("merge").join(found.where("known"), "simhash", "left_anti"), key)
        return out
