"""Site tables, variant files, dosage matrices, sample tables, gene annotations and read files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MISSING = ("", "NA", "NaN", ".", "null")


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """Site table with a header; inside_nodes as an array; tables without kind and parent_id get nulls."""
    rows = spark.read.csv(path, header=True)
    for name in ("kind", "parent_id"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    numbers = [c for c in rows.columns if c.endswith(("_id", "_count", "_support", "_alleles", "_bp", "_max", "_min"))]
    for name in numbers:
        rows = rows.withColumn(name, F.col(name).try_cast("bigint"))
    return rows.withColumn("inside_nodes", F.filter(F.split(F.coalesce("inside_nodes", F.lit("")), ";"), lambda x: x != ""))


def write_sites(rows: DataFrame, path: str) -> None:
    rows.withColumn("inside_nodes", F.array_join("inside_nodes", ";")).write.mode("overwrite").csv(path, header=True)


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, id, ref, alt, info map, sample, values map), one row per record and sample column; ``.`` is null."""
    rows = spark.read.text(path)
    header = rows.where(F.col("value").startswith("#CHROM")).select(F.expr("slice(split(value, '\t'), 10, greatest(size(split(value, '\t')) - 9, 0))").alias("samples"), F.input_file_name().alias("file"))
    f = F.split("value", "\t")
    body = rows.where(~F.col("value").startswith("#") & (F.col("value") != "")).withColumn("f", f)
    null = lambda c: F.when(c != ".", c)
    # every file has its own header, one row each
    named = body.withColumn("file", F.input_file_name()).join(F.broadcast(header.groupBy("file").agg(F.first("samples").alias("samples"))), "file").select(
        F.col("f")[0].alias("chrom"), F.col("f")[1].try_cast("bigint").alias("pos"), null(F.col("f")[2]).alias("id"), F.col("f")[3].alias("ref"), null(F.col("f")[4]).alias("alt"),
        F.str_to_map(F.col("f")[7], F.lit(";"), F.lit("=")).alias("info"), F.split(F.get("f", F.lit(8)), ":").alias("keys"), F.expr("slice(f, 10, greatest(size(f) - 9, 0))").alias("cells"), "samples",
    )
    each = named.withColumn("z", F.explode(F.arrays_zip("samples", "cells"))).drop("samples", "cells")
    values = F.map_from_arrays(F.slice("keys", 1, F.size(F.split("z.cells", ":"))), F.transform(F.split("z.cells", ":"), null))
    return each.select("chrom", "pos", "id", "ref", "alt", "info", F.col("z.samples").alias("sample"), values.alias("values"))


def variant_dosage(vcf: DataFrame) -> DataFrame:
    """(feature, sample, dose): GT of sequence records, CN of copy-number records; records with several ALTs give one feature per ALT."""
    n_alts = F.size(F.split("alt", ","))
    cnv = vcf.where("info['SVTYPE'] = 'CNV'").select(F.col("id").alias("feature"), "sample", F.expr("try_cast(values['CN'] as double)").alias("dose"))
    seq = vcf.where("coalesce(info['SVTYPE'], '') <> 'CNV'").withColumn("a", F.explode(F.sequence(F.lit(1), n_alts)))
    calls = F.split(F.col("values")["GT"], "[/|]")
    dose = F.when(F.col("values")["GT"].isNotNull() & ~F.array_contains(calls, "."), F.size(F.filter(calls, lambda c: c == F.col("a").cast("string"))).cast("double"))
    name = F.when(n_alts > 1, F.concat("id", F.lit("_a"), F.col("a"))).otherwise(F.col("id"))
    return cnv.unionByName(seq.select(name.alias("feature"), "sample", dose.alias("dose")))


def write_vcf(records: DataFrame, genotypes: DataFrame, samples: list[str], path: str) -> None:
    """``records`` (chrom, pos, id, ref, alt, info) and ``genotypes`` (id, sample, value), sorted by place and id; one column per named sample."""
    wide = genotypes.groupBy("id").pivot("sample", samples).agg(F.first("value"))
    cells = [F.coalesce(F.col(f"`{s}`"), F.lit(".")) for s in samples]
    body = records.join(wide, "id", "left").select("chrom", "pos", "id", F.concat_ws("\t", "chrom", "pos", "id", "ref", "alt", F.lit("."), F.lit("PASS"), "info", F.lit("GT"), *cells).alias("value"))
    head = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])
    first = records.sparkSession.createDataFrame([("", -2, "", "##fileformat=VCFv4.2"), ("", -1, "", head)], "chrom string, pos long, id string, value string")
    first.unionByName(body).repartitionByRange("chrom", "pos", "id").sortWithinPartitions("chrom", "pos", "id").select("value").write.mode("overwrite").text(path)


def read_dosages(spark: SparkSession, path: str, samples: list[str]) -> DataFrame:
    """(feature, sample, dose) of a headerless matrix (id, allele, allele, dose per sample); NA is null."""
    f = F.transform(F.split("value", ","), lambda c: F.trim(c))
    rows = spark.read.text(path).where("value <> ''").select(f.alias("f"))
    names = F.array(*[F.lit(s) for s in samples])
    each = rows.select(F.col("f")[0].alias("feature"), F.explode(F.arrays_zip(names.alias("s"), F.slice("f", 4, len(samples)).alias("d"))).alias("z"))
    return each.select("feature", F.col("z.s").alias("sample"), F.when(~F.col("z.d").isin(*MISSING), F.col("z.d").try_cast("double")).alias("dose"))


def write_dosages(doses: DataFrame, samples: list[str], path: str) -> None:
    """The same matrix, features in order of their id; a sample without a row is NA."""
    at = F.map_from_entries(F.collect_list(F.struct("sample", F.coalesce(F.col("dose").cast("string"), F.lit("NA")))))
    rows = doses.groupBy("feature").agg(at.alias("m"))
    cells = [F.coalesce(F.try_element_at("m", F.lit(s)), F.lit("NA")) for s in samples]
    lines = rows.select("feature", F.concat_ws(",", "feature", F.lit("A"), F.lit("B"), *cells).alias("value"))
    lines.repartitionByRange("feature").sortWithinPartitions("feature").select("value").write.mode("overwrite").text(path)


def read_phenotypes(spark: SparkSession, path: str) -> DataFrame:
    """(sample, phenotype, covariates...): missing marks are null, and -9 is a missing phenotype."""
    rows = spark.read.csv(path, sep="\t", header=True)
    out = rows.select(rows.columns[0], *[F.when(~F.col(c).isin(*MISSING), F.col(c)).try_cast("double").alias(c) for c in rows.columns[1:]])
    y = rows.columns[1]
    return out.withColumn(y, F.when(F.col(y) != -9, F.col(y)))


def read_sample_slots(spark: SparkSession, path: str) -> DataFrame:
    """(sample, slot, contig): a row per contig of each haplotype slot; slots are tab-separated, contigs comma-separated."""
    f = F.split("value", "\t")
    slots = spark.read.text(path).where("value <> '' and not startswith(value, '#')").select(f[0].alias("sample"), F.posexplode(F.expr("slice(split(value, '\t'), 2, greatest(size(split(value, '\t')) - 1, 0))")).alias("slot", "contigs"))
    return slots.select("sample", "slot", F.explode(F.split("contigs", ",")).alias("contig")).where("contig not in ('', '.')")


def read_genes(spark: SparkSession, path: str, chrom: str, lo: int, hi: int) -> DataFrame:
    """(gene_id, gene_name, start, end, cds): the genes of a 1-based inclusive interval with their merged coding parts."""
    rows = spark.read.csv(path, sep="\t", comment="#", quote="", schema="chrom string, src string, kind string, start long, end long, a string, strand string, b string, attrs string")
    at = lambda k: F.nullif(F.regexp_extract("attrs", k + ' "([^"]*)"', 1), F.lit(""))
    near = rows.where((F.col("chrom") == chrom) & (F.col("end") >= lo) & (F.col("start") <= hi)).withColumn("gene_id", at("gene_id")).withColumn("gene_name", at("gene_name"))
    cds = near.where("kind = 'CDS'")
    order = W.partitionBy("gene_id").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    runs = cds.withColumn("n", F.coalesce((F.col("start") > before + 1).cast("int"), F.lit(0))).withColumn("run", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)))
    merged = runs.groupBy("gene_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    lists = merged.groupBy("gene_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cds"))
    return near.where("kind = 'gene'").select("gene_id", "gene_name", "start", "end").join(lists, "gene_id", "left")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, sequence): records split at the ``>`` that begins a line; a record is the unit of work."""
    rows = spark.read.option("lineSep", "\n>").text(path).where("value <> ''")
    text = F.regexp_replace("value", "^>", "")
    name = F.regexp_extract(text, r"^(\S*)", 1)
    return rows.select(name.alias("name"), F.regexp_replace(F.regexp_replace(text, r"^[^\n]*", ""), r"[\s]", "").alias("sequence"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): every line with its number in its file, from 0, whatever the splits.

    Lines are in order within a split, so a split's lines are numbered by Spark's increasing id less its
    least one; a prefix sum of the counts of the splits, one row each, gives where a split begins.
    """
    rows = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")
    )
    splits = rows.groupBy("file", "block").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    begun = splits.select("file", "block", "least", F.coalesce(before, F.lit(0)).alias("begin"))
    return rows.join(begun, ["file", "block"]).select("file", (F.col("begin") + F.col("id") - F.col("least")).alias("line_no"), "value")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, name, sequence, quality) by four-line framing, since a quality line may begin with ``@`` too.

    An unfinished record at the end is left out. Compressed files are read by their suffix.
    """
    lines = numbered_lines(spark, path).withColumn("record", F.floor(F.col("line_no") / 4)).withColumn("part", F.col("line_no") % 4)
    part = lambda i: F.max(F.when(F.col("part") == i, F.regexp_replace("value", "\\r$", "")))
    rows = lines.groupBy("file", "record").agg(part(0).alias("head"), part(1).alias("sequence"), part(3).alias("quality"))
    return rows.where("quality is not null").select("file", "record", F.regexp_extract("head", r"^@(\S*)", 1).alias("name"), "sequence", "quality")


def paired(first: DataFrame, second: DataFrame) -> DataFrame:
    """(record, name, seq1, seq2, qual1, qual2): two read files in step, by the record number."""
    b = second.select("record", F.col("sequence").alias("seq2"), F.col("quality").alias("qual2"))
    return first.join(b, "record").select("record", "name", F.col("sequence").alias("seq1"), "seq2", F.col("quality").alias("qual1"), "qual2")


def read_snarls(spark: SparkSession, path: str) -> DataFrame:
    """(source, source_orient, sink, sink_orient) out of JSON lines with start and end boundaries; an absent backward flag is forward."""
    end = "struct<node_id: string, backward: boolean>"
    rows = spark.read.schema(f"start {end}, end {end}, type string").json(path)
    orient = lambda c: F.when(F.coalesce(F.col(c + ".backward"), F.lit(False)), "-").otherwise("+")
    return rows.where("start is not null and end is not null").select(
        F.col("start.node_id").alias("source"), orient("start").alias("source_orient"), F.col("end.node_id").alias("sink"), orient("end").alias("sink_orient")
    )


def write_counts(counts: DataFrame, path: str) -> None:
    """(path_name, feature, n) as one JSON line per path with its sparse counts."""
    rows = counts.groupBy("path_name").agg(F.sort_array(F.collect_list(F.struct("feature", "n"))).alias("counts"))
    rows.select(F.to_json(F.struct("path_name", "counts")).alias("value")).write.mode("overwrite").text(path)


def read_kinship(spark: SparkSession, path: str, samples: list[str]) -> DataFrame:
    """(a, b, value) of a square matrix of text, one row per cell, blanks or commas between; rows in the order of ``samples``.

    Cells that are no number are null. ``kinship_problems`` tells what is wrong with the matrix.
    """
    cells = F.filter(F.split(F.trim("value"), r"[\s,]+"), lambda c: c != "")
    names = F.array(*[F.lit(s) for s in samples])
    rows = numbered_lines(spark, path).where(F.trim("value") != "").select(F.get(names, F.col("line_no").cast("int")).alias("a"), F.posexplode(cells).alias("j", "c"))
    return rows.select("a", F.get(names, F.col("j")).alias("b"), F.col("c").try_cast("double").alias("value"))


def kinship_problems(matrix: DataFrame, n: int, tolerance: float = 1e-6) -> DataFrame:
    """(reason, a, b): cells outside the samples, without a number, without a partner, or that differ from their mirror image."""
    other = matrix.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("value").alias("mirror"), F.lit(True).alias("met"))
    both = matrix.join(other, ["a", "b"], "left")
    why = (
        F.when(F.col("a").isNull() | F.col("b").isNull(), f"not {n} by {n}").when(F.col("value").isNull(), "no number")
        .when(F.col("met").isNull(), "no mirror").when(F.abs(F.col("value") - F.col("mirror")) > tolerance, "not symmetric")
    )
    return both.select(why.alias("reason"), "a", "b").where("reason is not null")


def census(spark: SparkSession, path: str) -> DataFrame:
    """(kind, n): how many records of each kind a text file of tab-separated records holds, by its first field."""
    rows = spark.read.text(path).where("value <> ''")
    return rows.groupBy(F.split_part("value", F.lit("\t"), F.lit(1)).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def write_matrix(doses: DataFrame, path: str, most: int = 250_000) -> None:
    """Path by feature counts as one wide table; refused, not cut, beyond ``most`` features."""
    names = [r[0] for r in doses.select("feature").distinct().orderBy("feature").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} features: write the sparse counts instead")
    wide = doses.groupBy("path_name").pivot("feature", names).agg(F.sum("n"))
    wide.na.fill(0).write.mode("overwrite").csv(path, header=True, sep="\t")


def write_tsv(rows: DataFrame, path: str, lists: str = ",") -> None:
    """A table with a header, lists joined, nulls as ``.``: unit graphs, copies, events, nodes of variants."""
    out = [F.array_join(c, lists).alias(c) if kind.startswith("array") else F.col(f"`{c}`").cast("string").alias(c) for c, kind in rows.dtypes]
    rows.select(*out).write.mode("overwrite").csv(path, header=True, sep="\t", nullValue=".", emptyValue="", quote="")


def read_tsv(spark: SparkSession, path: str, schema: str, lists: dict[str, str] | None = None) -> DataFrame:
    """The same table back, by header names; columns of ``lists`` are split at the given text, cells that do not parse are null."""
    rows = spark.read.csv(path, header=True, sep="\t", quote="", nullValue=".")
    want = spark.createDataFrame([], schema).schema
    cell = lambda f: F.split(f.name, (lists or {})[f.name]) if f.name in (lists or {}) else F.col(f.name).try_cast(f.dataType)
    return rows.select(*[(cell(f) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in want])


def write_reads(reads: DataFrame, path: str, *by: str) -> None:
    """(name, sequence, quality) as read records of four lines, in one folder per value of the columns ``by``."""
    quality = F.coalesce("quality", F.repeat(F.lit("I"), F.length("sequence")))
    reads.select(*by, F.concat(F.lit("@"), "name", F.lit("\n"), "sequence", F.lit("\n+\n"), quality).alias("value")).write.mode("overwrite").partitionBy(*by).text(path)


def split_sequences(records: DataFrame, key: str, columns: list[str], most_bp: int) -> tuple[DataFrame, DataFrame]:
    """(records, sequences): texts longer than ``most_bp`` moved to a table (name, sequence), the record keeping ``<name>`` in their place."""
    name = lambda c: F.concat(F.lit("<"), F.col(key), F.lit("." + c + ">"))
    long = lambda c: F.length(c) > most_bp
    each = F.filter(F.array(*[F.struct(F.concat(F.col(key), F.lit("." + c)).alias("name"), F.when(long(c), F.col(c)).alias("sequence")) for c in columns]), lambda x: x["sequence"].isNotNull())
    return records.withColumns({c: F.when(long(c), name(c)).otherwise(F.col(c)) for c in columns}), records.select(F.inline(each))


def join_sequences(records: DataFrame, sequences: DataFrame, columns: list[str]) -> DataFrame:
    """The records of ``split_sequences`` with their texts back in place."""
    for c in columns:
        held = sequences.select(F.concat(F.lit("<"), "name", F.lit(">")).alias(c), F.col("sequence").alias("__t"))
        records = records.join(held, c, "left").withColumn(c, F.coalesce("__t", c)).drop("__t")
    return records


def write_fasta(sequences: DataFrame, path: str) -> None:
    """(name, sequence), a record in two lines."""
    sequences.select(F.concat(F.lit(">"), "name", F.lit("\n"), "sequence").alias("value")).write.mode("overwrite").text(path)


def staged(spark: SparkSession, outputs: dict, path: str) -> None:
    """Several writers, all or nothing: ``outputs`` maps a name to a function of a folder; a failure leaves ``path`` as it was.

    Everything is written to a folder beside the target, which then takes its name in one rename; an existing target is refused.
    """
    context = spark.sparkContext
    fs_path = context._jvm.org.apache.hadoop.fs.Path
    target, stage = fs_path(path), fs_path(f"{path}.{context.applicationId}.stage")
    fs = target.getFileSystem(context._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(path)
    try:
        for name, write in outputs.items():
            write(f"{stage.toString()}/{name}")
        if not fs.rename(stage, target):
            raise OSError(f"could not rename to {path}")
    finally:
        fs.delete(stage, True)
