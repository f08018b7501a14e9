"""Work flows of several people: one row a kind of work, with the steps they share.

A flow is a person's way of doing a detail of a project, as an ordered list of steps.
Flows come from several sources; what two sources tell alike counts once. Those that
name no detail are coarse: they go where the same person has a finer flow of the
project. The others are clustered within a project, in order, each into the first
cluster whose detail is the same or much like its own, or somewhat like it with mostly
the same steps; a cluster's detail is its longest, its steps are all its flows'.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from worktide.functions import text as T
from worktide.functions.numbers import half_up
from worktide.operators import merge_map, resolve
from worktide.sources.sinks import stored

ALIKE, SOMEWHAT, SHARED, LEAST_STEPS, MOST_STEPS, FEW = 0.75, 0.4, 0.6, 3, 10, 7


def once(flows: DataFrame) -> DataFrame:
    """flows (id, source, owner, project, detail, role, steps, mm, ax) without those
    that say the same: one a person, project, set of steps and role, from the first
    source, then the least id. Coarse flows that the person's finer ones cover go."""
    named = F.filter(F.transform("steps", T.fold), lambda s: s != "")
    told = flows.withColumns({"folded": named, "p": T.identity_key(F.col("project")), "fine": F.trim(F.coalesce("detail", F.lit(""))) != ""})
    mark = W.partitionBy(T.fold(F.col("owner")), T.fold(F.col("project")), F.array_sort(F.array_distinct("folded")), T.fold(F.coalesce("role", F.lit("")))).orderBy("source", "id")
    first = told.withColumn("nth", F.row_number().over(mark)).where("nth = 1").drop("nth")
    finer = F.max("fine").over(W.partitionBy("owner", "p"))
    return first.withColumn("finer", finer).where("fine OR NOT finer").drop("finer")


def clustered(flows: DataFrame) -> DataFrame:
    """id, cluster (the id of its first flow), label: flows with a detail, clustered.

    Flows can only meet where their details' bigrams are alike by SOMEWHAT: those are
    linked within a project by the prefix filter, and each linked set runs past in order
    of id, compared with its own clusters. A set's ids are held until its labels are
    final."""
    known = stored(flows.where("fine").select("id", "p", "folded", F.trim("detail").alias("detail"), T.identity_key(F.col("detail")).alias("key"), T.note(F.col("detail")).alias("note"), T.bigrams(F.col("detail")).alias("grams")))
    names = stored(known.groupBy(F.col("p").alias("owner"), F.col("detail").alias("name")).agg(F.first("grams").alias("grams"), F.first("key").alias("key")))
    alike = merge_map.sharing(names, F.col("grams"), SOMEWHAT, True)
    hubs = names.groupBy("owner", "key").agg(F.min("name").alias("a"))
    same = names.join(hubs, ["owner", "key"]).where(F.col("name") != F.col("a")).select("owner", "a", F.col("name").alias("b"))
    tag = lambda c: F.concat_ws("\x01", "owner", c)
    scope = resolve.scopes(alike.union(same).select(tag("a").alias("a"), tag("b").alias("b"), F.lit(1.0).alias("score")), names.select(tag("name").alias("name")))
    rows = known.withColumn("name", F.concat_ws("\x01", "p", "detail")).join(scope, "name").select("scope", "id", "detail", "key", "note", "grams", "folded")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, groups, member = None, [], []

        def closed() -> pa.RecordBatch:
            columns = [[i for i, _ in member], [groups[g]["id"] for _, g in member], [groups[g]["detail"] for _, g in member]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()))], names=["id", "cluster", "label"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["scope"] != current:
                    yield closed()
                    current, groups, member = row["scope"], [], []
                grams, steps = set(row["grams"]), set(row["folded"])

                def fits(g: dict) -> bool:
                    both = len(grams) + len(g["grams"])
                    alike = 2.0 * len(grams & g["grams"]) / both if both else 0.0
                    if row["key"] == g["key"] or (row["note"] == g["note"] and alike >= ALIKE):
                        return True
                    many = row["note"] == g["note"] and len(steps) >= LEAST_STEPS and len(g["steps"]) >= LEAST_STEPS and alike >= SOMEWHAT
                    return many and len(steps & g["steps"]) / len(steps | g["steps"]) >= SHARED

                at = next((i for i, g in enumerate(groups) if fits(g)), None)
                if at is None:
                    at = len(groups)
                    groups.append({"id": row["id"], "detail": row["detail"], "key": row["key"], "note": row["note"], "grams": grams, "steps": steps})
                else:
                    g = groups[at]
                    g["steps"] |= steps
                    if (len(row["detail"]), row["detail"]) > (len(g["detail"]), g["detail"]):
                        g |= {"detail": row["detail"], "key": row["key"], "note": row["note"], "grams": grams}
                member.append((row["id"], at))
        yield closed()

    return rows.repartition("scope").sortWithinPartitions("scope", "id").mapInArrow(fold, "id long, cluster long, label string")


def flow_summary(flows: DataFrame) -> DataFrame:
    """cluster, project, label, people, flows, mm, ax (share of it that agents can take),
    steps (their common steps in order of their mean place, MOST_STEPS at most), total
    (how many there are). A step is common if half of the flows have it; where none is,
    the FEW most frequent count."""
    own = stored(once(flows))
    placed = stored(own.join(clustered(own), "id"))
    sums = placed.groupBy("cluster").agg(F.min_by("project", "id").alias("project"), F.first("label").alias("label"), F.count_distinct("owner").alias("people"), F.count(F.lit(1)).alias("flows"), F.sum("mm").alias("mm"), F.sum(F.col("mm") * F.col("ax")).alias("ax_mm"), F.avg("ax").alias("ax_mean"))
    each = placed.select("cluster", F.posexplode("folded").alias("place", "step")).groupBy("cluster", "step").agg(F.count(F.lit(1)).alias("n"), F.avg("place").alias("place")).join(sums.select("cluster", "flows"), "cluster")
    common = each.withColumns({"common": F.col("n") * 2 >= F.col("flows"), "any": F.max(F.col("n") * 2 >= F.col("flows")).over(W.partitionBy("cluster")), "rank": F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("n"), "step"))})
    kept = common.where(F.when(F.col("any"), F.col("common")).otherwise(F.col("rank") <= FEW)).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("place", "step"))).alias("list"))
    out = sums.join(kept, "cluster", "left").withColumn("list", F.coalesce("list", F.expr("cast(array() as array<struct<place: double, step: string>>)")))
    ax = F.when(F.col("mm") > 0, F.col("ax_mm") / F.col("mm")).otherwise(F.col("ax_mean"))
    return out.select("cluster", "project", "label", "people", "flows", half_up(F.col("mm"), 3).alias("mm"), half_up(ax, 4).alias("ax"), F.slice("list.step", F.lit(1), F.lit(MOST_STEPS)).alias("steps"), F.size("list").alias("total"))
