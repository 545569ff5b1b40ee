"""Layers of clusters: relations, tree, Newick, purity, colours, exports.  membership has layer, cluster, seq_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G


def sizes(membership: DataFrame) -> DataFrame:
    return membership.groupBy("layer", "cluster").agg(F.count("*").alias("n_members"))


def layer_edges(membership: DataFrame, least: float = 0.8) -> DataFrame:
    """(layer, parent, child, overlap): child, a cluster of layer - 1, lies with more than `least` of its members in parent."""
    lower = membership.select((F.col("layer") + 1).alias("layer"), F.col("cluster").alias("child"), "seq_id")
    both = lower.join(membership.withColumnRenamed("cluster", "parent"), ["layer", "seq_id"]).groupBy("layer", "parent", "child").agg(F.count("*").alias("overlap"))
    n = sizes(membership).select((F.col("layer") + 1).alias("layer"), F.col("cluster").alias("child"), "n_members")
    return both.join(n, ["layer", "child"]).where(F.col("overlap") > least * F.col("n_members")).select("layer", "parent", "child", "overlap")


def decreasing_layers(layers: DataFrame) -> DataFrame:
    """The layers that have fewer clusters than every one before; one row a layer is ranked."""
    least = F.min("n_clusters").over(Window.orderBy("layer").rowsBetween(Window.unboundedPreceding, -1))
    return layers.withColumn("_least", least).where("_least is null or n_clusters < _least").drop("_least")


def min_size(membership: DataFrame, least: int) -> DataFrame:
    """Clusters with at least so many members, renumbered from 0 in each layer."""
    kept = sizes(membership).where(F.col("n_members") >= least)
    new = kept.select("layer", "cluster", (F.row_number().over(Window.partitionBy("layer").orderBy("cluster")) - 1).alias("new_cluster"))
    return membership.join(new, ["layer", "cluster"]).select("layer", F.col("new_cluster").alias("cluster"), "seq_id")


def branch_lengths(layers: DataFrame, d: int, minpts: int, kind: int) -> DataFrame:
    """(layer, length): density at a layer's epsilon less that of the next; null for the last."""
    dens = G.density(F.col("epsilon"), d, minpts, kind)
    return layers.select("layer", (dens - F.lead(dens).over(Window.orderBy("layer"))).alias("length"))


def tree_nodes(membership: DataFrame) -> DataFrame:
    """(layer, cluster, n_members, label, parent); parent is null in the last layer and for clusters without one."""
    parent = layer_edges(membership).select((F.col("layer") - 1).alias("layer"), F.col("child").alias("cluster"), "parent")
    rows = sizes(membership).join(parent, ["layer", "cluster"], "left")
    return rows.select("layer", "cluster", "n_members", G.node_label(F.col("layer"), F.col("cluster"), F.col("n_members")).alias("label"), "parent")


def orphans(membership: DataFrame) -> DataFrame:
    """Clusters below the last layer that no cluster of the next holds."""
    last = membership.agg(F.max("layer").alias("_last"))
    return tree_nodes(membership).join(F.broadcast(last)).where("parent is null and layer < _last").drop("_last")


def reachable(membership: DataFrame) -> DataFrame:
    """The tree nodes below cluster 0 of the last layer, itself included: one join a layer."""
    nodes = tree_nodes(membership)
    last = membership.agg(F.max("layer")).first()[0]
    if last is None:
        return nodes
    own = nodes.where((F.col("layer") == last) & (F.col("cluster") == 0))
    out = own
    for layer in range(last - 1, -1, -1):
        own = nodes.where(F.col("layer") == layer).join(own.select(F.col("cluster").alias("parent")), "parent", "left_semi").select(*nodes.columns)
        out = out.unionByName(own)
    return out


def newick_table(membership: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """(newick) of the tree below cluster 0 of the last layer, one row; `;` without one.

    The text is folded from the first layer up, one aggregation a layer: the texts of a cluster's children, last child first, are joined
    where the cluster is.  lengths(layer, length) are those of a layer's branches, 1 where null.
    """
    nodes = tree_nodes(membership)
    length = F.lit(1.0)
    if lengths is not None:
        nodes, length = nodes.join(F.broadcast(lengths.select("layer", "length")), "layer", "left"), F.coalesce("length", F.lit(1.0))  # a row a layer
    nodes = nodes.select("layer", "cluster", "parent", F.concat("label", F.format_string(":%f", length)).alias("tail"))
    last = membership.agg(F.max("layer")).first()[0]
    own = None
    for layer in range((last if last is not None else -1) + 1):
        here = nodes.where(F.col("layer") == layer).select("cluster", "parent", "tail" if layer < last else F.lit(f"L{layer}C0;").alias("tail"))
        if own is None:
            own = here.select("cluster", "parent", F.col("tail").alias("text"))
            continue
        order = F.array_sort(F.collect_list(F.struct((-F.col("cluster")).alias("at"), "text")))
        below = own.where("parent is not null").groupBy(F.col("parent").alias("cluster")).agg(F.concat(F.lit("("), F.array_join(F.transform(order, lambda s: s["text"]), ","), F.lit(")")).alias("inner"))
        own = here.join(below, "cluster", "left").select("cluster", "parent", F.concat(F.coalesce("inner", F.lit("")), "tail").alias("text"))
    spark = membership.sparkSession
    none = spark.range(1).select(F.lit(";").alias("none"))
    if own is None:
        return none.select(F.col("none").alias("newick"))
    return none.join(F.broadcast(own.where("cluster = 0").agg(F.max("text").alias("text")))).select(F.coalesce("text", "none").alias("newick"))  # a row each


def newick(membership: DataFrame, lengths: dict[int, float] | None = None) -> str:
    """The text of newick_table."""
    spark = membership.sparkSession
    table = spark.createDataFrame(list(lengths.items()), "layer int, length double") if lengths else None
    return newick_table(membership, table).first()[0]


def newick_program(membership: DataFrame, layers: DataFrame | None = None, least: int = 0, mode: int = 0, dims: int = 0, minpts: int = 0) -> DataFrame:
    """(newick) of the clusters with at least `least` members.  mode 0: branches of length 1; 1 and 2: lengths from the densities of
    layers(layer, epsilon), as in branch_lengths."""
    if mode not in (0, 1, 2) or (mode and layers is None):
        raise ValueError("mode is 0, 1 or 2, and 1 and 2 want layers")
    kept = min_size(membership, least) if least else membership
    return newick_table(kept, branch_lengths(layers, dims, minpts, mode) if mode else None)


def overlaps(membership: DataFrame, target: DataFrame) -> DataFrame:
    """(layer, cluster, target, overlap) with target(seq_id, target)."""
    return membership.join(target, "seq_id").groupBy("layer", "cluster", "target").agg(F.count("*").alias("overlap"))


def purity(membership: DataFrame, target: DataFrame) -> DataFrame:
    """(layer, purity, cluster_factor, impure_fraction).

    A tree node is impure if some target shares a part of it.  Each such target adds its share of the node, or what is missing
    of it if it has more than (integer) half; purity is the mean of these sums over impure nodes, 0 without any.
    """
    nodes = reachable(membership).select("layer", "cluster", "n_members")
    part = overlaps(membership, target).join(nodes, ["layer", "cluster"]).where("overlap <> n_members")
    odd = F.when(F.col("overlap") > F.floor(F.col("n_members") / 2), F.col("n_members") - F.col("overlap")).otherwise(F.col("overlap")) / F.col("n_members")
    impure = part.groupBy("layer", "cluster").agg(F.sum(odd).alias("odd")).groupBy("layer").agg(F.sum("odd").alias("odd"), F.count("*").alias("impure"))
    n = sizes(membership).groupBy("layer").agg(F.count("*").alias("n"))
    n_target = target.agg(F.countDistinct("target").alias("n_target"))
    rows = n.join(impure, "layer", "left").join(F.broadcast(n_target))
    return rows.select(
        "layer",
        F.coalesce(F.col("odd") / F.col("impure"), F.lit(0.0)).alias("purity"),
        (F.abs(F.col("n") - F.col("n_target")) / F.col("n_target")).alias("cluster_factor"),
        (F.coalesce("impure", F.lit(0)) / F.col("n")).alias("impure_fraction"),
    )


def find_sequence(membership: DataFrame, members: DataFrame) -> DataFrame:
    """(layer, cluster, n) of the clusters that hold some of members(seq_id)."""
    return membership.join(members.select("seq_id").distinct(), "seq_id").groupBy("layer", "cluster").agg(F.count("*").alias("n"))


def tree_map_sequence(membership: DataFrame, members: DataFrame, colour: str) -> DataFrame:
    """A style line for every cluster that holds one of members(seq_id)."""
    held = sizes(membership).join(find_sequence(membership, members).select("layer", "cluster"), ["layer", "cluster"], "left_semi")
    label = G.node_label(F.col("layer"), F.col("cluster"), F.col("n_members"))
    return held.select("layer", "cluster", F.concat(F.lit(f"stroke:{colour} I "), label).alias("line"))


def tree_map_split_set(membership: DataFrame, target: DataFrame, colours: list[tuple[int, str]], gradient: int = 0) -> DataFrame:
    """A style line for every cluster and selected target (1-based index, #RRGGBB); white where they share nothing.

    gradient 0: none, 1: linear in the share of the target, 2: logarithmic (1 for a target of one member).
    """
    spark = membership.sparkSession
    picked = spark.createDataFrame([(k - 1, c) for k, c in colours], "target int, colour string")
    n_target = target.groupBy("target").agg(F.count("*").alias("n_target"))
    grid = sizes(membership).join(F.broadcast(picked.join(n_target, "target")))
    rows = grid.join(overlaps(membership, target), ["layer", "cluster", "target"], "left")
    share = {0: F.lit(1.0), 1: F.col("overlap") / F.col("n_target"), 2: F.when(F.col("n_target") == 1, 1.0).otherwise(F.log10(F.col("overlap").cast("double")) / F.log10(F.col("n_target").cast("double")))}[gradient]
    colour = F.when(F.coalesce("overlap", F.lit(0)) == 0, "#FFFFFF").otherwise(G.faded(F.col("colour"), share))
    label = G.node_label(F.col("layer"), F.col("cluster"), F.col("n_members"))
    return rows.select("layer", "cluster", "target", F.concat(F.lit("stroke:"), colour, F.lit(" I "), label).alias("line"))


def matrix_line(points: DataFrame, membership: DataFrame) -> DataFrame:
    """(seq_id, cluster): -1 outside; the last cluster that holds a member wins."""
    own = membership.groupBy("seq_id").agg(F.max("cluster").alias("cluster"))
    return points.select("seq_id").join(own, "seq_id", "left").select("seq_id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def cluster_of_annotation(annotations: DataFrame, unique: DataFrame) -> DataFrame:
    """(cluster, seq_id): annotations(seq_id, annotation) through unique(cluster, annotation); '-' is none."""
    return annotations.where("annotation <> '-'").join(unique, "annotation").select("cluster", "seq_id")


def partitions_found(membership: DataFrame, n: int, partitions: int, precision: float) -> DataFrame:
    """(partition_no) of the partitions of equal id ranges that some cluster recovers.

    A range has n // partitions ids, also where n is no multiple: what is left over forms a shorter range that counts like the others.
    """
    if not 0 <= precision <= 1:
        raise ValueError("precision must be within 0 and 1")
    size = n // partitions
    if not size:  # no cluster differs from an empty range by less than nothing
        return membership.where("false").select(F.col("seq_id").alias("partition_no"))
    slack = (1 - precision) * size
    fit = sizes(membership).where(F.abs(F.col("n_members") - size) < slack)
    own = membership.join(fit.select("layer", "cluster"), ["layer", "cluster"], "left_semi").withColumn("partition_no", F.expr(f"seq_id div {size}"))
    return own.groupBy("layer", "cluster", "partition_no").agg(F.count("*").alias("k")).where(F.col("k") > size - slack).select("partition_no").distinct()


def packed_mask(mask: DataFrame) -> DataFrame:
    """(bucket, bits) of mask(seq_id, mask): a bitmap of 32,768 ids a row, for the ids whose mask is 1."""
    on = mask.where("mask = 1")
    return on.groupBy(F.bitmap_bucket_number("seq_id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("seq_id")).alias("bits"))


def mask_or(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def mask_and(a: DataFrame, b: DataFrame) -> DataFrame:
    """The ids that are on in both, packed again where both have a bitmap of their bucket."""
    shared = a.select("bucket").intersect(b.select("bucket"))
    own, other = (unpacked_mask(m.join(shared, "bucket", "left_semi")) for m in (a, b))
    return packed_mask(own.join(other, ["seq_id", "mask"], "left_semi"))


def unpacked_mask(packed: DataFrame) -> DataFrame:
    """(seq_id, mask) of the bits that are on."""
    byte = "cast(conv(hex(substring(bits, i div 8 + 1, 1)), 16, 10) as int)"
    at = F.expr(f"filter(sequence(0, 8 * length(bits) - 1), i -> shiftright({byte}, i % 8) & 1 = 1)")
    # bucket 1 starts with id 1 and goes up, buckets from 0 down hold 0 and negative ids and go down
    id_ = F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * 32768 + 1 + F.col("at")).otherwise(F.col("bucket") * 32768 - F.col("at"))
    return packed.select("bucket", F.explode(at).alias("at")).select(id_.cast("long").alias("seq_id"), F.lit(1).alias("mask"))


def matrix_annotation(points: DataFrame) -> DataFrame:
    """(line): the header of a matrix view, the places of all sequences; the format is one line."""
    return points.agg(F.count("*").alias("n")).select(F.when(F.col("n") > 0, F.array_join(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), "\t")).otherwise("").alias("line"))
