"""An additive k-mer store: one Parquet folder per segment, counts summed over segments at query time.

A segment is written whole or not at all (Spark's commit protocol), and adding a segment that exists
replaces it, so a job that is run again after a failure leaves the same store. Rows of a segment are
clustered by a hash of the k-mer, which keeps Parquet's statistics selective.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KmerStore:
    def __init__(self, spark: SparkSession, folder: str, files: int | None = None) -> None:
        """``files`` fixes how many files a segment has; without it Spark sizes them by the data."""
        self.spark, self.folder, self.files = spark, folder, files

    def add(self, segment: str, rows: DataFrame) -> None:
        """``rows`` is (kmer, n); equal k-mers add up, null k-mers are left out."""
        counts = rows.where("kmer is not null").groupBy("kmer").agg(F.sum("n").cast("bigint").alias("n"))
        laid = counts.hint("rebalance", "kmer") if self.files is None else counts.repartition(self.files, "kmer")
        sorted_rows = laid.sortWithinPartitions("kmer")
        sorted_rows.write.mode("overwrite").parquet(f"{self.folder}/segment={segment}")

    def segments(self) -> DataFrame:
        return self.spark.read.option("basePath", self.folder).parquet(f"{self.folder}/segment=*")

    def dump(self) -> DataFrame:
        """(kmer, n): every k-mer with its count over all segments."""
        return self.segments().groupBy("kmer").agg(F.sum("n").alias("n"))

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` (kmer, ...) with ``n``, 0 where the store has none."""
        asked = wanted.select("kmer").where("kmer is not null").distinct()
        held = self.segments().join(asked, "kmer", "left_semi").groupBy("kmer").agg(F.sum("n").alias("n"))
        return wanted.join(held, "kmer", "left").withColumn("n", F.coalesce("n", F.lit(0)))

    def compact(self, into: str) -> None:
        """All segments as one, in a new store folder."""
        KmerStore(self.spark, into, self.files).add("all", self.dump())

    def verify(self, other: DataFrame) -> DataFrame:
        """(kmer, mine, theirs): where another count (kmer, n) differs from the store's."""
        both = self.dump().withColumnRenamed("n", "mine").join(other.select("kmer", F.col("n").alias("theirs")), "kmer", "full_outer")
        return both.where(~F.col("mine").eqNullSafe(F.col("theirs")))
