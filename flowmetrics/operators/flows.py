"""Staged flow (Sankey) operators: links, node totals, return-contact flag.

``flow_links`` answers all edge sets in one pass: every classified row
emits one small struct per edge it takes (``explode`` of a fixed-size
array), and a single ``groupBy(stage, source, target, *dims)`` counts them.
The reference scans its classified CTE once per edge set; here the scan
and the shuffle happen once, and the partial aggregation before the
shuffle collapses rows to at most (#edges x #labels) per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import pct

Edge = tuple[int, str, str, Column | None]


def flow_links(
    df: DataFrame, edges: Sequence[Edge], dims: Sequence[str] = (), fill: str | None = None, weight: str | None = None
) -> DataFrame:
    """Link rows ``(source, target, value, stage, *dims)``.

    An edge whose filter is NULL or FALSE for a row is not taken by it.
    ``fill`` replaces NULL dimension values (e.g. ``'N/A'``).  ``weight``
    names a row-multiplicity column (value = sum of weights, not rows).
    """
    structs = []
    for stage, src, tgt, cond in edges:
        s = F.struct(F.lit(stage).alias("stage"), F.col(src).alias("source"), F.col(tgt).alias("target"))
        structs.append(s if cond is None else F.when(cond, s))
    dim_cols = [F.coalesce(F.col(d), F.lit(fill)).alias(d) if fill is not None else F.col(d) for d in dims]
    w = [F.col(weight).alias("_w")] if weight else []
    taken = df.select(*dim_cols, *w, F.explode(F.array_compact(F.array(*structs))).alias("e"))
    value = F.sum("_w").cast("long") if weight else F.count(F.lit(1))
    links = taken.groupBy(
        F.col("e.source").alias("source"), F.col("e.target").alias("target"), F.col("e.stage").alias("stage"), *dims
    ).agg(value.alias("value"))
    return links.where(F.col("value") > 0).select("source", "target", "value", "stage", *dims)


def flow_node_totals(links: DataFrame, total_stage: int = 1, digits: int = 1) -> DataFrame:
    """Per-node value = sum of outgoing links, else sum of incoming.

    Node identity is the label alone (G5).  ``pct`` is the node value over
    the sum of the ``total_stage`` links (all contacts entering the flow).
    Works on link rows (already aggregated), so every step is tiny.
    """
    out = links.groupBy(F.col("source").alias("node")).agg(F.sum("value").cast("long").alias("outflow"))
    inn = links.groupBy(F.col("target").alias("node")).agg(F.sum("value").cast("long").alias("inflow"))
    total = links.where(F.col("stage") == total_stage).select(F.sum("value")).scalar()
    nodes = out.join(inn, "node", "full").select(
        "node",
        F.coalesce("inflow", F.lit(0)).cast("long").alias("inflow"),
        F.coalesce("outflow", F.lit(0)).cast("long").alias("outflow"),
    )
    value = F.when(F.col("outflow") > 0, F.col("outflow")).otherwise(F.col("inflow"))
    return nodes.withColumn("node_value", value).withColumn("pct", pct(F.col("node_value"), total, digits)).orderBy(
        F.col("node_value").desc(), "node"
    )


def seen_in_previous_days(
    df: DataFrame, key: str, day_col: str, lo: int, hi: int = 1, name: str = "is_return", history: DataFrame | None = None
) -> DataFrame:
    """Flag rows whose ``key`` also occurs on a day in ``[day - lo, day - hi]``.

    Each distinct (key, day) is expanded to the ``lo - hi + 1`` later days it
    covers, de-duplicated, and left-joined back on (key, day): an equi-join
    with bounded fan-out, skew-safe because a hot key is spread over days.
    """
    seen = (history if history is not None else df).select(F.col(key).alias("_k"), F.col(day_col).alias("_d")).distinct()
    covers = seen.select(
        "_k", F.explode(F.sequence(F.date_add("_d", hi), F.date_add("_d", lo))).alias("_day")
    ).distinct().withColumn(name, F.lit(True))
    j = df.join(covers, (df[key] == covers["_k"]) & (df[day_col] == covers["_day"]), "left")
    return j.drop("_k", "_day").withColumn(name, F.coalesce(F.col(name), F.lit(False)))
