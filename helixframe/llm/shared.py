"""Leads of buckets, connected components of links, and names that no column has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import BROADCAST_ROWS, saved, small


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores before those that stand among the columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def led_buckets(rows: DataFrame) -> DataFrame:
    """rows(bucket, cls) of buckets with several classes, and lead, the class of the bucket that shares most buckets with others.

    In a group of copies with changes of their own, that is the text they were made from: it is closer to each of them
    than they are to each other.  Ties go to the smallest class.
    """
    return leads_of(saved(rows.withColumn("size", F.count("*").over(Window.partitionBy("bucket"))).where("size > 1")))


def leads_of(several: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """several(bucket, cls, size) with lead; see led_buckets."""
    degree = several.groupBy("cls").agg(F.sum("size").alias("degree"))
    leads = several.join(small(degree, most=most), "cls").groupBy("bucket").agg(F.max(F.struct("degree", "cls"))["cls"].alias("lead"))
    return several.select("bucket", "cls").join(leads, "bucket")


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(id, comp) for every node of the links: comp is the smallest id that its links lead to.

    Every round each node takes the smallest label among its own and its neighbours', and then that node's label; the labels
    are a table in the shared folder.  They are broadcast if found small enough; beyond that, hubs are split by the skew
    handling of the joins.  Either way labels are combined before the round's shuffle.
    """
    both = saved(edges.select(F.col(a).alias("id"), F.col(b).alias("to")).unionByName(edges.select(F.col(b).alias("id"), F.col(a).alias("to"))).where("id <> to").distinct())
    labels = saved(both.groupBy("id").agg(F.least(F.min("to"), F.col("id")).alias("comp")))
    kind, n = edges.schema[a].dataType, labels.count()
    for _ in range(most_rounds if n else 0):
        offers = both.join(small(labels.select(F.col("id").alias("to"), "comp"), n), "to").select("id", "comp", F.lit(None).cast(kind).alias("was"))
        best = offers.unionByName(labels.select("id", "comp", F.col("comp").alias("was"))).groupBy("id").agg(F.min("comp").alias("near"), F.max("was").alias("was"))
        jump = small(labels.select(F.col("id").alias("near"), F.col("comp").alias("far")), n)
        new = best.join(jump, "near", "left").select("id", F.least("near", F.coalesce("far", "near")).alias("comp"), "was")
        new = saved(new.select("id", "comp", F.expr("comp <> was").alias("moved")))
        labels = new.select("id", "comp")
        if not new.where("moved").limit(1).count():
            return labels
    if n:
        raise RuntimeError("the components did not settle")
    return labels


def merged(labels: DataFrame, links: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """labels(node, comp) after links(a, b) of nodes have joined their components.  Only the distinct links between components are
    followed, so links inside a group cost nothing more."""
    own = labels.select(F.col("node").alias("a"), F.col("comp").alias("a_comp")), labels.select(F.col("node").alias("b"), F.col("comp").alias("b_comp"))
    between = links.join(own[0], "a").join(own[1], "b").where("a_comp <> b_comp").select(F.least("a_comp", "b_comp").alias("lo"), F.greatest("a_comp", "b_comp").alias("hi")).distinct()
    up = components(between, "lo", "hi").select(F.col("id").alias("comp"), F.col("comp").alias("_up"))
    return saved(labels.join(small(up, most=most), "comp", "left").select("node", F.coalesce("_up", "comp").alias("comp")))


def next_leads(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A new lead for every bucket of rows(bucket, node, comp, open) with open rows, where all buckets have several components: the open
    node that stands in most rows."""
    degree = rows.where("open").groupBy("node").agg(F.count("*").alias("degree"))
    return rows.where("open").join(small(degree, most=most), "node").groupBy("bucket").agg(F.max(F.struct("degree", "node"))["node"].alias("lead"))


def positions(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """rows with pos, from 0 in each group in the given order, and n, the size of the group; group columns are never null.

    rows should be a stored table: a range sort samples it first.  No group has to fit in a task: ranges are numbered in place
    and start where those before them end.  The offsets number as many rows as ranges and groups together.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = saved(rows.repartitionByRange(ranges, *group, *order).sortWithinPartitions(*group, *order).withColumn("_place", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_place", 33)))
    parts = placed.groupBy(*group, "_range").agg(F.count("*").alias("_m"), F.min("_place").alias("_first"))
    ahead = Window.partitionBy(*group).orderBy("_range")
    offsets = saved(parts.select(*group, "_range", (F.sum("_m").over(ahead) - F.col("_m") - F.col("_first")).alias("_shift"), F.sum("_m").over(Window.partitionBy(*group)).alias("n")))
    return placed.join(small(offsets), [*group, "_range"]).select(*rows.columns, (F.col("_place") + F.col("_shift")).alias("pos"), "n")
