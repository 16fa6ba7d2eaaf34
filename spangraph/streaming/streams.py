"""Streams: hits counted into a growing store, fragments classified against a static index, mates joined within a window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spangraph.functions.seq import canonical
from spangraph.operators import recruit as R


def hit_stream(spark: SparkSession, path: str, files_per_trigger: int = 4) -> DataFrame:
    """The k-mer hits of a folder (or one file) as a stream; the schema is that of the files there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def valid_hits(hits: DataFrame) -> DataFrame:
    """The hits that count: a path, a count over 0, a kmer of plain bases, in canonical form. Times may be null."""
    return hits.where("path_name is not null and hit_count > 0").withColumn("kmer", canonical(F.col("kmer"))).where("kmer is not null")


def store_stream(hits: DataFrame, out: str, checkpoint: str, seen_within: str | None = None) -> None:
    """Counts each hit_id once and writes each micro-batch as one segment of a store folder, until the input is used up.

    The hits that were counted are kept as a table beside the store, (hit_id, day of arrival) by segment, and each
    batch leaves out what is there already, so no row is lost by its time, null or late, and no state is held in
    memory. ``seen_within`` ("60 days") looks only at days so far before the batch's own, where repeats come no later; rows
    without a time of arrival are always looked at. A segment is named after its batch and overwritten when
    the batch is run again, so a restart counts nothing twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        day = F.coalesce(F.to_date("loaded_at"), F.lit("0001-01-01").cast("date")) if "loaded_at" in batch.columns else F.lit("0001-01-01").cast("date")
        new = valid_hits(batch).withColumn("day", day).groupBy("hit_id").agg(F.min_by(F.struct("kmer", "hit_count"), F.struct("day", "kmer", "hit_count")).alias("h"), F.min("day").alias("day"))
        schema = f"hit_id {dict(batch.dtypes)['hit_id']}, segment long, day date"
        known = spark.read.schema(schema).parquet(f"{out}/seen").where(F.col("segment") != batch_id) if batch_id else None
        if known is not None and seen_within is not None:
            oldest = new.agg(F.min("day")).scalar()
            known = known.where((F.col("day") >= oldest - F.expr(f"interval {seen_within}")) | (F.col("day") == "0001-01-01"))
        fresh = new.join(known.select("hit_id"), "hit_id", "left_anti") if known is not None else new
        fresh = fresh.persist()
        fresh.select("hit_id", "day").sortWithinPartitions("day").write.mode("overwrite").parquet(f"{out}/seen/segment={batch_id}")
        fresh.groupBy("h.kmer").agg(F.sum("h.hit_count").alias("n")).write.mode("overwrite").parquet(f"{out}/segment={batch_id}")
        fresh.unpersist()

    query = hits.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def recruit_stream(fragments: DataFrame, index: DataFrame, k: int, out: str, checkpoint: str, error: float = 0.01) -> None:
    """Classifies a stream of (fragment, sequence) against a static index, batch by batch, until the input is used up.

    A fragment is judged by its own row, so nothing is kept between batches; a batch's verdicts are one folder, written over when
    the batch is run again. ``index`` is that of ``operators.recruit``, k-mers as codes.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = R.labelled(batch, ["fragment"], "sequence", index, k)
        R.verdict(R.evidence(rows, k, error), k, error=error).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    fragments.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def mates(first: DataFrame, second: DataFrame, reach: int = 100_000, offsets: DataFrame | None = None) -> DataFrame:
    """First mates with their second where it lies at most ``reach`` bases ahead on the same contig, else alone.

    Both sides are (name, pos), or (name, contig, pos) with ``offsets`` (contig, offset), where each contig begins
    in the order of the input: the lengths of the contigs before it. The place in the genome, taken as seconds, is the event
    time, so it goes on rising over the contigs: the watermark lets go of a read once no mate within reach can come, and reads
    of a later contig are not late. Reads still held at the end of a stream need a batch pass.
    """

    def side(rows: DataFrame, n: int) -> DataFrame:
        if offsets is None:
            placed = rows.select("name", "pos", F.lit("").alias("contig"), F.lit(0).alias("offset"))
        else:
            placed = rows.join(F.broadcast(offsets.select("contig", "offset")), "contig")  # one row per contig
        time = F.timestamp_seconds(F.col("offset") + F.col("pos"))
        named = placed.select(F.col("name").alias(f"name_{n}"), F.col("contig").alias(f"contig_{n}"), F.col("offset").alias(f"offset_{n}"), time.alias(f"t{n}"))
        return named.withWatermark(f"t{n}", f"{reach} seconds")

    near = F.expr(f"name_1 = name_2 and contig_1 = contig_2 and t2 >= t1 and t2 <= t1 + interval {reach} seconds")
    both = side(first, 1).join(side(second, 2), near, "leftOuter")
    pos = lambda n: (F.unix_seconds(f"t{n}") - F.col(f"offset_{n}")).alias(f"pos_{n}")
    out = [F.col("name_1").alias("name"), *([F.col("contig_1").alias("contig")] if offsets is not None else []), pos(1), pos(2)]
    return both.select(*out)
