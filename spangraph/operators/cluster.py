"""Connected components by contraction, and greedy clusters in a given order, both as rounds over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spangraph.session import release, written


def connected_components(links: DataFrame, a: str, b: str, max_rounds: int = 60, vertices: DataFrame | None = None) -> DataFrame:
    """(id, component): the least id that can be reached. Links are undirected; nulls and self-links take no part.

    Each round joins every id to the least of itself and its neighbours, follows those steps to their ends (twice as far each
    time, so a chain of any length takes its logarithm), and goes on with the links between the ends. Ids with a link are at
    least halved in a round, so both loops are bounded by the logarithm of the ids, whatever the form of a component. Rounds
    are written to the shared folder and what is no longer read is deleted.
    ``vertices`` (id) adds the ids without a link, each a component of its own. Raises if links are left after ``max_rounds``.
    """
    valid = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    both = F.array(F.struct(F.col(a).alias("id"), F.col(b).alias("to")), F.struct(F.col(b).alias("id"), F.col(a).alias("to")))
    edges = written(valid.select(F.inline(both)).distinct(), "links")
    labels = written(edges.select("id").distinct().withColumn("component", F.col("id")), "labels")
    for _ in range(max_rounds):
        if edges.isEmpty():
            release(edges)
            out = labels
            if vertices is None:
                return out
            alone = vertices.select(F.col(vertices.columns[0]).alias("id")).distinct().join(out, "id", "left_anti")
            return out.unionByName(alone.withColumn("component", F.col("id")))
        ends = _ends(edges.groupBy("id").agg(F.least(F.col("id"), F.min("to")).alias("end")))
        end = lambda x: ends.select(F.col("id").alias(x), F.col("end").alias(f"__{x}"))
        left = edges.join(end("id"), "id").join(end("to"), "to").where("__id <> __to").select(F.col("__id").alias("id"), F.col("__to").alias("to")).distinct()
        told = labels.join(end("component"), "component", "left").select("id", F.coalesce("__component", "component").alias("component"))
        new = written(left, "links"), written(told, "labels")
        for old in (edges, labels, ends):
            release(old)
        edges, labels = new
    raise RuntimeError(f"components not settled after {max_rounds} rounds")


def _ends(steps: DataFrame) -> DataFrame:
    """(id, end): where steps from id to a lesser or equal end come to rest; each turn takes the step of the step's end."""
    ends = written(steps.withColumn("moved", F.col("end") != F.col("id")), "ends")
    while not ends.where("moved").isEmpty():
        ahead = ends.select(F.col("id").alias("end"), F.col("end").alias("beyond"))
        new = written(ends.join(ahead, "end").select("id", F.col("beyond").alias("end"), (F.col("beyond") != F.col("end")).alias("moved")), "ends")
        release(ends)
        ends = new
    return ends


def greedy_leaders(scored: DataFrame, group: str, item: str, rank: str, links: DataFrame, other: str, max_rounds: int = 1000) -> DataFrame:
    """(group, item, leader): in rank order, an item joins the first leader that it is linked to, or else leads.

    ``links`` is (group, item, other), in both directions. All groups are worked at once, in rounds: an item decides
    as soon as every item before it that it is linked to has decided. A round is a join and an aggregate over the links of
    the undecided, so no group, whatever its size, is gathered in one place; the number of rounds is that of the longest
    chain of links in falling rank.
    """
    order = F.struct(F.col(rank).alias("r"), F.col(item).alias("i"))
    rows = scored.select(group, F.col(item).alias("__item"), order.alias("__order"))
    before = rows.select(group, F.col("__item").alias("__other"), F.col("__order").alias("__first"))
    own = links.select(group, F.col(item).alias("__item"), F.col(other).alias("__other")).distinct()
    earlier = written(own.join(rows, [group, "__item"]).join(before, [group, "__other"]).where("__first < __order").select(group, "__item", "__other", "__first"), "earlier")
    held = earlier.select(group, "__item").distinct().withColumn("__waits", F.lit(True))
    begun = rows.select(group, "__item").distinct().join(held, [group, "__item"], "left")
    state = written(begun.select(group, "__item", F.when(F.col("__waits").isNull(), F.col("__item")).alias("__leader")), "leaders")
    for _ in range(max_rounds):
        todo = state.where("__leader is null").select(group, "__item")
        if todo.isEmpty():
            return state.select(group, F.col("__item").alias(item), F.col("__leader").alias("leader"))
        asked = earlier.join(todo, [group, "__item"], "left_semi").join(state.select(group, F.col("__item").alias("__other"), "__leader"), [group, "__other"], "left")
        leads = F.col("__leader") == F.col("__other")
        per = asked.groupBy(group, "__item").agg(F.bool_and(F.col("__leader").isNotNull()).alias("ready"), F.min(F.when(leads, F.struct("__first", "__other"))).alias("best"))
        ready = per.where("ready").select(group, "__item", F.coalesce("best.__other", "__item").alias("__found"))
        new = written(state.join(ready, [group, "__item"], "left").select(group, "__item", F.coalesce("__leader", "__found").alias("__leader")), "leaders")
        release(state)
        state = new
    raise RuntimeError(f"clusters not settled after {max_rounds} rounds")
