"""Walks through a sequence graph: step parsing, coordinates, edges, crossings, runs.

A walk is stored as text in one of two forms: comma-separated steps with a trailing sign (``1+,7-``), or
steps with a leading arrow (``>1<7``). Everything below works on the exploded form
(path_name, idx, node_id, reverse), with idx counting from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spangraph.functions.seq import reverse_complement


def walk_text(steps: Column) -> Column:
    """Either form of a walk as arrowed steps; null and ``*`` stay as they are."""
    signed = F.transform(
        F.split(steps, ","),
        lambda s: F.concat(F.when(s.endswith("-"), "<").otherwise(">"), s.substr(F.lit(1), F.length(s) - 1)),
    )
    return F.when(steps.rlike(r"\A[<>]") | (steps == "*"), steps).otherwise(F.array_join(signed, ""))


def distinct_paths(paths: DataFrame) -> DataFrame:
    """One row per path_name that has a walk (repeated rows share their content), with ``walk`` as arrowed steps."""
    kept = paths.where("path_name is not null and steps is not null and steps not in ('*', '')")
    rest = [F.max(c).alias(c) for c in ("graph_name", "sample_name", "haplotype", "contig", "walk_start", "walk_end") if c in paths.columns]
    return kept.groupBy("path_name").agg(*rest, F.min(walk_text(F.col("steps"))).alias("walk"))


def step_arrays(paths: DataFrame) -> DataFrame:
    """Adds ``steps``: the walk as an array of arrowed steps."""
    return paths.withColumn("steps", F.regexp_extract_all("walk", F.lit("[<>][^<>]+"), F.lit(0))).drop("walk")


def explode_steps(paths: DataFrame, *carry: str) -> DataFrame:
    """(path_name, *carry, idx, step, node_id, reverse), one row per step."""
    arrays = step_arrays(paths)
    return arrays.select("path_name", *carry, F.posexplode("steps").alias("idx", "step")).select(
        "path_name", *carry, "idx", "step", F.expr("substring(step, 2)").alias("node_id"), F.col("step").startswith("<").alias("reverse")
    )


def explode_pairs(paths: DataFrame, *carry: str) -> DataFrame:
    """(path_name, *carry, idx, step, nxt): each step with the one after it, paired inside the walk's row, so nothing is shuffled."""
    arrays = step_arrays(paths)
    both = F.zip_with("steps", F.slice("steps", 2, F.greatest(F.size("steps"), F.lit(1))), lambda a, b: F.struct(a.alias("step"), b.alias("nxt")))
    return arrays.select("path_name", *carry, F.posexplode(both).alias("idx", "p")).where("p.nxt is not null").select("path_name", *carry, "idx", "p.step", "p.nxt")


def distinct_nodes(nodes: DataFrame) -> DataFrame:
    """(node_id, sequence, bp) per node; a missing sequence is null, a missing length is that of the sequence."""
    known = F.when(F.col("sequence") != "*", F.col("sequence"))
    return (
        nodes.where("node_id is not null").groupBy("node_id")
        .agg(F.max(known).alias("sequence"), F.max("length_bp").alias("length_bp"))
        .select("node_id", "sequence", F.coalesce(F.length("sequence").cast("long"), F.col("length_bp"), F.lit(0)).alias("bp"))
    )


def flip(step: Column) -> Column:
    return F.concat(F.when(step.startswith(">"), "<").otherwise(">"), step.substr(F.lit(2), F.length(step)))


def running_sums(rows: DataFrame, keys: list[str], order: str, value: str, out: str, block: int = 65_536) -> DataFrame:
    """Adds ``out``, the sum of ``value`` up to and with each row along ``order``.

    Sums are taken in two levels, inside blocks of ``block`` places and over the blocks' totals, so that one
    long sequence of rows is spread over many tasks.
    """
    laid = rows.withColumn("__b", F.floor(F.col(order) / block))
    totals = laid.groupBy(*keys, "__b").agg(F.sum(value).alias("__t"))
    earlier = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(*keys, "__b", F.coalesce(F.sum("__t").over(earlier), F.lit(0)).alias("__before"))
    inside = W.partitionBy(*keys, "__b").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    summed = laid.withColumn("__s", F.sum(value).over(inside))
    return summed.join(before, [*keys, "__b"]).withColumn(out, F.col("__s") + F.col("__before")).drop("__b", "__s", "__before")


def coordinates(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds start_bp and end_bp of each step along its path."""
    sized = steps.join(nodes.select("node_id", "bp"), "node_id", "left").withColumn("bp", F.coalesce("bp", F.lit(0)))
    out = running_sums(sized, ["path_name"], "idx", "bp", "end_bp")
    return out.withColumn("start_bp", F.col("end_bp") - F.col("bp")).drop("bp")


def edges(steps: DataFrame) -> DataFrame:
    """(path_name, idx, edge): each pair of neighbouring steps, read in the lesser of its two directions.

    Takes the pairs of ``explode_pairs``, or steps, whose neighbours are then found by a window.
    """
    if "nxt" not in steps.columns:
        steps = steps.withColumn("nxt", F.lead("step").over(W.partitionBy("path_name").orderBy("idx"))).where("nxt is not null")
    edge = F.least(F.concat("step", "nxt"), F.concat(flip(F.col("nxt")), flip(F.col("step"))))
    return steps.select("path_name", "idx", edge.alias("edge"))


def dosage(rows: DataFrame, feature: str, column: str = "path_name") -> DataFrame:
    """(feature, column, n): how often each path visits each feature."""
    return rows.groupBy(F.col(feature).alias("feature"), column).agg(F.count(F.lit(1)).alias("n"))


def feature_stats(doses: DataFrame, n_columns: DataFrame, min_paths: int = 1) -> DataFrame:
    """(feature, present, min_count, max_count, total, informative) per feature.

    Informative: the carriers differ in count, or else both carriers and others are more than ``min_paths``.
    """
    stats = doses.groupBy("feature").agg(
        F.count(F.lit(1)).alias("present"), F.min("n").alias("min_count"), F.max("n").alias("max_count"), F.sum("n").alias("total")
    )
    absent = n_columns.scalar() - F.col("present")
    return stats.withColumn("informative", (F.col("min_count") != F.col("max_count")) | (F.least(F.col("present"), absent) > min_paths))


def distinct_sites(sites: DataFrame) -> DataFrame:
    """One row per bubble_id, that of the least row_no."""
    first = W.partitionBy("bubble_id").orderBy("row_no")
    return sites.where("bubble_id is not null").withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")


def crossings(sites: DataFrame, steps: DataFrame) -> DataFrame:
    """(bubble_id, path_name, crossing, left_idx, right_idx, forward): where a walk enters a site by one boundary and leaves by the other."""
    ends = sites.where("source_node is not null and sink_node is not null and source_node <> sink_node")
    bound = lambda node, orient, role: F.struct(F.col(node).alias("node_id"), (F.col(orient) == "-").alias("flipped"), F.lit(role).alias("role"))
    both = ends.select("bubble_id", F.inline(F.array(bound("source_node", "source_orient", "s"), bound("sink_node", "sink_orient", "t"))))
    hits = steps.join(both, "node_id").withColumn("straight", F.col("reverse") == F.col("flipped"))
    order = W.partitionBy("bubble_id", "path_name").orderBy("idx")
    nxt = hits.withColumn("to_role", F.lead("role").over(order)).withColumn("to_straight", F.lead("straight").over(order)).withColumn(
        "right_idx", F.lead("idx").over(order)
    )
    ahead = (F.col("role") == "s") & (F.col("to_role") == "t") & F.col("straight") & F.col("to_straight")
    back = (F.col("role") == "t") & (F.col("to_role") == "s") & ~F.col("straight") & ~F.col("to_straight")
    found = nxt.where(ahead | back)
    return found.select("bubble_id", "path_name", F.row_number().over(order).alias("crossing"), F.col("idx").alias("left_idx"), "right_idx", ahead.alias("forward"))


def signatures(found: DataFrame, arrays: DataFrame) -> DataFrame:
    """Adds ``inside`` (the steps between the boundaries, read from source to sink) and ``signature``."""
    cut = F.slice("steps", F.col("left_idx") + 2, F.col("right_idx") - F.col("left_idx") - 1)
    joined = found.join(arrays.select("path_name", "steps"), "path_name")
    read = joined.withColumn("inside", F.when(F.col("forward"), cut).otherwise(F.transform(F.reverse(cut), flip))).drop("steps")
    return read.withColumn("signature", F.array_join("inside", ""))


def tandem_runs(steps: DataFrame) -> DataFrame:
    """(path_name, period, first_idx, last_idx, copies): maximal repeats of a block of ``period`` steps, at least two copies.

    The periods tried are all distances between equal steps of a walk. A repeat is given with its primitive
    period: one that also repeats with a divisor of the period is left to that one.
    """
    at = steps.select("path_name", "step", "idx")
    pairs = at.join(at.withColumnRenamed("idx", "before"), ["path_name", "step"]).where("before < idx")
    same = pairs.select("path_name", "idx", (F.col("idx") - F.col("before")).alias("period"))
    island = same.withColumn("__island", F.col("idx") - F.row_number().over(W.partitionBy("path_name", "period").orderBy("idx")))
    runs = island.groupBy("path_name", "period", "__island").agg(F.min("idx").alias("a"), F.max("idx").alias("b"), F.count(F.lit(1)).alias("n"))
    found = runs.where("n >= period").select("path_name", "period", (F.col("a") - F.col("period")).alias("first_idx"), F.col("b").alias("last_idx"), "n")
    shorter = found.select("path_name", F.col("period").alias("__p"), F.col("first_idx").alias("__a"), F.col("last_idx").alias("__b"))
    held = F.expr("__p < period and period % __p = 0 and __a <= first_idx and __b >= last_idx")
    whole = found.join(shorter, (found["path_name"] == shorter["path_name"]) & held, "left_anti")
    return whole.select("path_name", "period", "first_idx", "last_idx", (F.floor(F.col("n") / F.col("period")) + 1).cast("long").alias("copies"))


def spelled(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path_name, sequence): node sequences in walk order, reversed steps as reverse complements; a missing sequence is N of its length.

    A whole walk in one row, for short walks; ``spelled_blocks`` is the form for any length.
    """
    base = F.coalesce(F.col("sequence"), F.expr("repeat('N', cast(bp as int))"), F.lit(""))
    parts = steps.join(nodes, "node_id", "left").withColumn("part", F.when(F.col("reverse"), reverse_complement(base)).otherwise(base))
    ordered = F.array_sort(F.collect_list(F.struct("idx", "part")))
    return parts.groupBy("path_name").agg(F.array_join(F.transform(ordered, lambda p: p["part"]), "").alias("sequence"))


def _cut(text: Column, start: Column, n: Column) -> Column:
    """``n`` letters of a text from ``start`` (from 0); plain texts are cut as bytes, without counting letters up to the start."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.encode(text, "UTF-8").substr((start + 1).cast("int"), n.cast("int")).cast("string")).otherwise(text.substr((start + 1).cast("int"), n.cast("int")))


def spelled_blocks(steps: DataFrame, nodes: DataFrame, size: int = 10_000, overlap: int = 0) -> DataFrame:
    """(path_name, block, start_bp, text, sizes): the bases of each walk in blocks of ``size``, each going on for ``overlap`` bases into the next.

    ``sizes`` are the lengths of the pieces of steps in a block. Blocks are put together straight from the pieces of the steps that they touch, so no row holds a walk,
    however long. A missing sequence is N of its length.
    """
    at = coordinates(steps, nodes).where("end_bp > start_bp").join(nodes.select("node_id", "sequence"), "node_id", "left")
    first = F.greatest(F.floor((F.col("start_bp") - overlap) / size), F.lit(0))
    spread = at.withColumn("block", F.explode(F.sequence(first, F.floor((F.col("end_bp") - 1) / size))))
    lo = F.greatest(F.col("start_bp"), F.col("block") * size)
    hi = F.least(F.col("end_bp"), (F.col("block") + 1) * size + overlap)
    seq, n = F.col("sequence"), hi - lo
    forward = _cut(seq, lo - F.col("start_bp"), n)
    backward = reverse_complement(_cut(seq, F.col("end_bp") - hi, n))
    piece = F.when(seq.isNull(), F.expr("repeat('N', cast(n as int))")).when(F.col("reverse"), backward).otherwise(forward)
    pieces = spread.withColumn("n", n).where("n > 0").select("path_name", "block", F.struct("idx", piece.alias("t")).alias("p"))
    ordered = F.array_sort(F.collect_list("p"))
    text = F.array_join(F.transform(ordered, lambda p: p["t"]), "")
    made = pieces.groupBy("path_name", "block").agg(text.alias("text"), F.transform(ordered, lambda p: F.length(p["t"])).alias("sizes"))
    return made.select("path_name", "block", (F.col("block") * size).alias("start_bp"), "text", "sizes")


def border_texts(paths: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(stretch, times, text): per distinct stretch of a step and the k - 1 next ones, how often it is walked and the bases around the step's end.

    The text holds the last k - 1 bases of the step and the first k - 1 of what follows, so its k-mers are those that
    begin in the step and end beyond it.
    """
    arrays = step_arrays(paths)
    ahead = F.transform(F.sequence(F.lit(1), F.size("steps") - 1), lambda i: F.array_join(F.slice("steps", i, k), ""))
    met = arrays.where(F.size("steps") > 1).select(F.explode(ahead).alias("stretch")).groupBy("stretch").agg(F.count(F.lit(1)).alias("times"))
    each = met.select("stretch", "times", F.posexplode(F.regexp_extract_all("stretch", F.lit("[<>][^<>]+"), F.lit(0))).alias("i", "step"))
    known = each.withColumn("node_id", F.expr("substring(step, 2)")).join(nodes, "node_id", "left")
    # only the ends of a node are looked at; its letters are cut before they are turned
    base, short = F.col("sequence"), F.expr(f"repeat('N', cast(least(bp, {k - 1}) as int))")
    head, tail = F.left(base, F.lit(k - 1)), F.right(base, F.lit(k - 1))
    first = F.when(F.col("step").startswith("<"), reverse_complement(head)).otherwise(tail)
    after = F.when(F.col("step").startswith("<"), reverse_complement(tail)).otherwise(head)
    piece = F.coalesce(F.when(F.col("i") == 0, first).otherwise(after), short, F.lit(""))
    ordered = F.array_sort(F.collect_list(F.struct("i", piece.alias("t"))))
    texts = known.groupBy("stretch", "times").agg(F.transform(ordered, lambda p: p["t"]).alias("t"))
    rest = F.left(F.array_join(F.slice("t", 2, k), ""), F.lit(k - 1))
    return texts.select("stretch", "times", F.concat(F.get("t", F.lit(0)), rest).alias("text"))


def backbone(steps: DataFrame) -> DataFrame:
    """(graph_name, node_id, n_paths): nodes that every path of a graph walks exactly once; ``steps`` carries graph_name."""
    per_path = steps.groupBy("graph_name", "node_id", "path_name").agg(F.count(F.lit(1)).alias("n"))
    nodes = per_path.groupBy("graph_name", "node_id").agg(F.count(F.lit(1)).alias("n_paths"), F.max("n").alias("most"))
    whole = steps.groupBy("graph_name").agg(F.count_distinct("path_name").alias("all_paths"))
    return nodes.join(whole, "graph_name").where("most = 1 and n_paths = all_paths").select("graph_name", "node_id", "n_paths")


def shared_support(steps: DataFrame, min_share: float) -> DataFrame:
    """(graph_name, node_id, n_paths, share): nodes that at least ``min_share`` of a graph's paths walk exactly once."""
    per_path = steps.groupBy("graph_name", "node_id", "path_name").agg(F.count(F.lit(1)).alias("n"))
    nodes = per_path.groupBy("graph_name", "node_id").agg(F.count_if(F.col("n") == 1).alias("n_paths"))
    whole = steps.groupBy("graph_name").agg(F.count_distinct("path_name").alias("all_paths"))
    out = nodes.join(whole, "graph_name").withColumn("share", F.round(F.col("n_paths") / F.col("all_paths"), 6))
    return out.where(F.col("n_paths") >= F.col("all_paths") * min_share).drop("all_paths")


def orientation_runs(steps: DataFrame, reference: DataFrame) -> DataFrame:
    """(path_name, run, backward, n_steps, ref_lo, ref_hi): runs of one direction against the reference's steps.

    ``reference`` is (node_id, ref_idx, ref_reverse), nodes that the reference walks exactly once.
    """
    order = W.partitionBy("path_name").orderBy("idx")
    at = steps.join(reference, "node_id").withColumn("backward", F.col("reverse") != F.col("ref_reverse"))
    changed = F.coalesce((F.col("backward") != F.lag("backward").over(order)).cast("int"), F.lit(0))
    runs = at.withColumn("__c", changed).withColumn("run", F.sum("__c").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("path_name", "run").agg(
        F.bool_or("backward").alias("backward"), F.count(F.lit(1)).alias("n_steps"), F.min("ref_idx").alias("ref_lo"), F.max("ref_idx").alias("ref_hi")
    )
