"""Density clustering over a table of pairs within a distance.

A point is strong if its neighbourhood (itself included) has more than minpts points and weak if it has exactly minpts.
Seeds are strong points in ascending id; a weak point passes a cluster on only if it was not tried as a seed before, that is
if its id is above the cluster's seed.  The outcome of that procedure is a fixpoint without any visiting order: every strong
point starts with its own id as label, each point takes the least label that a strong neighbour, or a weak neighbour
whose label is below its own id, offers.  Clusters are numbered in the order of their labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.distance import distances, pairs_within, sample
from ..storage import saved, small


def neighbour_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(F.col("i").alias("seq_id")).agg(F.count("*").alias("n"))


def density_labels(pairs: DataFrame, minpts: int, most_rounds: int = 500) -> DataFrame:
    """(seq_id, label) of the members of pairs(i, j), both directions and i = j included."""
    links = saved(pairs.select("i", "j"))
    degree = saved(neighbour_counts(links).where(F.col("n") >= minpts))
    edges = links.where("i <> j").join(degree.select(F.col("seq_id").alias("i"), (F.col("n") > minpts).alias("strong")), "i")
    edges = saved(edges)
    labels = degree.where(F.col("n") > minpts).select("seq_id", F.col("seq_id").alias("label"))
    n = labels.count()
    if not n:
        return labels
    for _ in range(most_rounds):
        offers = edges.join(small(labels.withColumnRenamed("seq_id", "i"), n), "i").where("strong or label < i").select(F.col("j").alias("seq_id"), "label", F.lit(None).cast("long").alias("was"))
        best = offers.unionByName(labels.select("seq_id", "label", F.col("label").alias("was"))).groupBy("seq_id").agg(F.min("label").alias("near"), F.max("was").alias("was"))
        jump = small(labels.select(F.col("seq_id").alias("near"), F.col("label").alias("far")), n)
        new = best.join(jump, "near", "left").select("seq_id", F.least("near", F.coalesce("far", "near")).alias("label"), "was")
        new = saved(new.select("seq_id", "label", F.expr("was is null or was <> label").alias("moved")))
        labels = new.select("seq_id", "label")
        n, moved = new.agg(F.count("*"), F.count_if("moved")).first()
        if not moved:
            return labels
    raise RuntimeError("the labels did not settle")


def numbered(labels: DataFrame) -> DataFrame:
    """(cluster, seq_id): labels replaced by their rank; only one row a cluster is ranked."""
    rank = labels.select("label").distinct().select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("cluster"))
    return labels.join(rank, "label").select("cluster", "seq_id")


def dbscan_pairs(pairs: DataFrame, minpts: int) -> DataFrame:
    return numbered(density_labels(pairs, minpts))


def dbscan(points: DataFrame, eps: float = -1, minpts: int = -1, metric: str = "l2") -> DataFrame:
    """(cluster, seq_id) of the members; -1 takes the defaults 0.015 and 5."""
    eps, minpts = 0.015 if eps == -1 else eps, 5 if minpts == -1 else minpts
    return dbscan_pairs(pairs_within(points, eps, metric), minpts)


def outliers(points: DataFrame, membership: DataFrame) -> DataFrame:
    return points.join(membership.select("seq_id"), "seq_id", "left_anti")


def coverage(points: DataFrame, membership: DataFrame) -> DataFrame:
    n = points.agg(F.count("*").alias("n"))
    return membership.agg(F.count("*").alias("inside")).join(F.broadcast(n)).select((F.col("inside") / F.col("n")).alias("coverage"))


def label_steps(pairs: DataFrame, minpts: int, start: DataFrame | None = None, most_rounds: int = 500) -> DataFrame:
    """(seq_id, at, label): the labels of density clustering at every step of a growing epsilon, in one fixpoint.

    pairs(i, j, at) has both directions and i = j; at is the first step whose epsilon reaches the pair.  Labels only fall as
    epsilon grows, so a point's labels over all steps are a falling staircase: a row for every step down.  A point's offer to a neighbour
    holds from the step at which it has the label, reaches the neighbour, and is strong (weak is enough where the label is below its
    id); staircases meet by keeping what is below all earlier rows.  Only rows that are new make offers in a round, and a label takes
    over the later labels of the point it is named for.  So the work follows the number of steps down, not that of steps.

    start is a result for a shorter reach of the same steps.
    """
    links = saved(pairs.select("i", "j", "at"))
    nth = F.row_number().over(Window.partitionBy("i").orderBy("at"))
    ranked = links.select("i", "at", nth.alias("nth")).where(F.col("nth").between(minpts, minpts + 1))
    core = saved(ranked.groupBy("i").agg(F.max(F.when(F.col("nth") == minpts, F.col("at"))).alias("weak"), F.max(F.when(F.col("nth") == minpts + 1, F.col("at"))).alias("strong")))
    late = lambda c: F.when(F.col(c).isNotNull(), F.greatest("at", c)).alias(c)
    edges = saved(links.where("i <> j").join(core, "i").select("i", "j", late("weak"), late("strong")))
    born = core.where("strong is not null").select(F.col("i").alias("seq_id"), F.col("strong").alias("at"), F.col("i").alias("label"))
    rows = saved((born if start is None else born.unionByName(start.select("seq_id", "at", "label"))).groupBy("seq_id", "at").agg(F.min("label").alias("label")).withColumn("moved", F.lit(True)))
    for _ in range(most_rounds):
        fresh = rows.where("moved").select(F.col("seq_id").alias("i"), F.col("at").alias("since"), "label")
        opens = F.when(F.col("label") < F.col("i"), F.col("weak")).otherwise(F.col("strong"))
        offers = edges.join(small(fresh), "i").select(F.col("j").alias("seq_id"), F.greatest("since", opens).alias("at"), "label", opens.alias("opens")).where("opens is not null").drop("opens")
        named = rows.select(F.col("seq_id").alias("label"), F.col("at").alias("then"), F.col("label").alias("lower")).where("lower < label")
        jumps = rows.select("seq_id", "at", "label").join(small(named), "label").select("seq_id", F.greatest("at", "then").alias("at"), F.col("lower").alias("label"))
        none = F.lit(None).cast("long").alias("was")
        all_ = rows.select("seq_id", "at", "label", F.col("label").alias("was")).unionByName(offers.select("*", none)).unionByName(jumps.select("*", none))
        best = all_.groupBy("seq_id", "at").agg(F.min("label").alias("label"), F.min("was").alias("was"))
        above = F.min("label").over(Window.partitionBy("seq_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
        rows = saved(best.withColumn("above", above).where("above is null or label < above").select("seq_id", "at", "label", F.expr("was is null or was <> label").alias("moved")))
        if not rows.where("moved").limit(1).count():
            return rows.select("seq_id", "at", "label")
    raise RuntimeError("the labels did not settle")


def staircases(rows: DataFrame) -> DataFrame:
    """rows(seq_id, at, label) with until, the step at which the next label comes, null for the last."""
    return rows.withColumn("until", F.lead("at").over(Window.partitionBy("seq_id").orderBy("at")))


def step_counts(rows: DataFrame) -> list[tuple[int, int, int]]:
    """(step, clusters, members), for the steps at which these numbers change.  A cluster lives as long as the point it is named for has its
    own label.  One row a step comes to the driver."""
    stairs = staircases(rows)
    own = F.col("label") == F.col("seq_id")
    first = F.min("at").over(Window.partitionBy("seq_id")) == F.col("at")
    births = stairs.select("at", own.cast("long").alias("clusters"), first.cast("long").alias("members"))
    deaths = stairs.where(own & F.col("until").isNotNull()).select(F.col("until").alias("at"), F.lit(-1).cast("long").alias("clusters"), F.lit(0).cast("long").alias("members"))
    out, clusters, members = [], 0, 0
    for r in births.unionByName(deaths).groupBy("at").agg(F.sum("clusters").alias("c"), F.sum("members").alias("m")).orderBy("at").collect():
        clusters, members = clusters + r["c"], members + r["m"]
        out.append((r["at"], clusters, members))
    return out


def members_at(rows: DataFrame, layers: list[tuple[int, int]]) -> DataFrame:
    """membership(layer, cluster, seq_id) at the steps of layers(layer, step)."""
    known = F.array(*[F.struct(F.lit(n).alias("layer"), F.lit(k).cast("long").alias("k")) for n, k in layers])
    inside = F.filter(known, lambda s: (s["k"] >= F.col("at")) & (F.col("until").isNull() | (s["k"] < F.col("until"))))
    own = staircases(rows).select("seq_id", "label", F.explode(inside).alias("s")).select("s.layer", "label", "seq_id")
    rank = own.select("layer", "label").distinct().select("layer", "label", (F.row_number().over(Window.partitionBy("layer").orderBy("label")) - 1).alias("cluster"))
    return own.join(rank, ["layer", "label"]).select("layer", "cluster", "seq_id")


def first_step(dist: Column, first: float, step: float) -> Column:
    """The least k >= 0 with dist <= first + k * step, in double arithmetic."""
    k = F.greatest(F.lit(0).cast("long"), F.ceil((dist - first) / step).cast("long"))
    reach = lambda n: F.lit(first) + n * F.lit(step)
    return F.when((k > 0) & (dist <= reach(k - 1)), k - 1).when(dist > reach(k), k + 1).otherwise(k)


def first_of(dist: Column, epsilons: list[float]) -> Column:
    """The number of the first of ascending epsilons that reaches dist; null beyond."""
    out = F.lit(None).cast("long")
    for k in range(len(epsilons) - 1, -1, -1):
        out = F.when(dist <= epsilons[k], F.lit(k).cast("long")).otherwise(out)
    return out


def layers_at(points: DataFrame, epsilons: list[float], minpts: int, metric: str = "l2") -> DataFrame:
    """membership(layer, cluster, seq_id) for ascending epsilons, from one sweep."""
    epsilons = sorted(epsilons)
    pairs = pairs_within(points, epsilons[-1], metric).select("i", "j", first_of(F.col("dist"), epsilons).alias("at"))
    return members_at(label_steps(pairs, minpts), [(k, k) for k in range(len(epsilons))])


LAYERS = "layer int, step long, epsilon double, epsilon_printed double, n_clusters int, coverage double"


class Finished:
    """The finished layers of a scan under a path: a table of members for each, and a manifest, which gets a row when a layer's table
    is complete.  The sweep of the scan is kept beside them.  Another scan's path is refused."""

    def __init__(self, spark: SparkSession, path: str, scan: str):
        self.spark, self.path, self.scan = spark, path.rstrip("/"), scan
        for row in self.read("scan", "scan string"):
            if row["scan"] != scan:
                raise ValueError(f"{path} holds another scan: {row['scan']}")

    def read(self, name: str, schema: str) -> list:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").collect()
        except AnalysisException:
            return []

    def layers(self) -> list[tuple]:
        return sorted(tuple(r) for r in self.read("manifest", LAYERS))

    def swept(self) -> tuple[DataFrame, list[tuple]] | None:
        """The sweep, and the layers that it found, if it came to its end."""
        if not self.read("scan", "scan string"):
            return None
        return self.spark.read.parquet(f"{self.path}/sweep"), sorted(tuple(r) for r in self.read("plan", LAYERS))

    def keep_sweep(self, rows: DataFrame, plan: list[tuple]) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/sweep")
        self.spark.createDataFrame(plan, LAYERS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/plan")
        self.spark.createDataFrame([(self.scan,)], "scan string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/scan")

    def table(self, layer: int) -> str:
        return f"{self.path}/members/layer-{layer:05d}"

    def finish(self, members: DataFrame, row: tuple) -> None:
        members.write.mode("overwrite").parquet(self.table(row[0]))
        self.spark.createDataFrame([row], LAYERS).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")


#: Points of the sample from which a scan's reach is estimated, and neighbours of a point in its first reach, on average.
SAMPLE, FEW = 2048, 32


def sample_distances(points: DataFrame, metric: str) -> np.ndarray | None:
    """The distances, in order, of every two points of a sample by hash; None where there are no vectors."""
    if metric not in ("l1", "l2"):
        return None
    x = sample(points.where("values is not null"), SAMPLE)
    if len(x) < 2:
        return None
    return np.sort(np.concatenate([distances(x[k : k + 1], x[k + 1 :], metric)[0] for k in range(len(x) - 1)]))


def counts_at(counts: list[tuple[int, int, int]], steps: int) -> list[tuple[int, int]]:
    """(clusters, members) of each of so many steps, from step_counts."""
    out, own = [], {k: (c, m) for k, c, m in counts}
    for k in range(steps):
        out.append(own.get(k, out[-1] if out else (0, 0)))
    return out


def scans(points: DataFrame, first: float, step: float, minpts: int, metric: str, max_steps: int | None, spread: np.ndarray | None) -> Iterator[tuple[DataFrame, list, int, int | None]]:
    """(label_steps, step_counts, last, end) of a scan from first, with a longer and longer reach of `last` steps; end is the step at which the
    scan ends, None while it is not known.

    A reach is so long that a point has some FEW neighbours, then four times as many and so on, for the pairs are the work; where the
    sample of distances does not say, it is four times as long as before.
    """
    n, few, reach, rows = points.count(), max(FEW, 8 * minpts), 0, None
    while True:
        by_sample = None
        if spread is not None and few < n:
            by_sample = int(max(0.0, min(1e9, (spread[int(few / n * len(spread))] - first) // step)))
        reach = max(reach + 1, by_sample) if by_sample is not None else max(16, 4 * reach)
        few *= 4
        last = reach if max_steps is None else min(reach, max(0, max_steps - 1))
        pairs = saved(pairs_within(points, first + last * step, metric))
        rows = label_steps(pairs.select("i", "j", first_step(F.col("dist"), first, step).alias("at")).where(F.col("at") <= last), minpts, rows)
        counts = step_counts(rows)
        total, own = pairs.agg(F.count("*"), F.count_if(F.expr("i = j"))).first()
        whole = last + 1 == max_steps or total >= min(n, own) ** 2  # a vector that is no number has no partner, not itself either
        end = next((k for k, c, _ in counts if c == 1), None)
        if end is None and whole:
            end = last if last + 1 == max_steps else int(pairs.agg(F.max(first_step(F.col("dist"), first, step))).first()[0] or 0)
        yield rows, counts, last, end
        if whole:
            return


def sweep(points: DataFrame, eps: float, step: float, minpts: int, metric: str, max_steps: int | None, halvings: int) -> tuple[DataFrame, list[tuple]]:
    """(label_steps, layers) of an adaptive scan.

    The scan starts at the longest half of eps that has not one cluster.  Where eps reaches many neighbours, only the halves that reach few
    are looked at first: if the scan from there comes to one cluster of all points before the next longer half, that half and all beyond
    have one cluster, too, for whatever joins later is in it already.  Only otherwise are the pairs of the longer half formed.
    """
    n = points.count()
    halves = [eps / 2**h for h in range(halvings, -1, -1)]
    spread = sample_distances(points, metric)
    top = len(halves) - 1
    while spread is not None and top and np.searchsorted(spread, halves[top], "right") / len(spread) * n > max(FEW, 8 * minpts):
        top -= 1
    while True:
        pairs = pairs_within(points, halves[top], metric).select("i", "j", first_of(F.col("dist"), halves[: top + 1]).alias("at"))
        counts = counts_at(step_counts(label_steps(pairs, minpts)), top + 1)
        start = next((k for k in range(top, 0, -1) if counts[k][0] != 1), 0)
        longer = halves[top + 1] if top + 1 < len(halves) and counts[top] != (1, n) else None
        if longer is not None and max_steps is not None:  # a scan with a last step proves nothing beyond it
            top += 1
            continue
        first = halves[start]
        for rows, counts, last, end in scans(points, first, step, minpts, metric, max_steps, spread):
            if longer is not None and any((c, m) == (1, n) and first + k * step <= longer for k, c, m in counts):
                longer = None
            if (end is not None and longer is None) or (longer is not None and first + last * step >= longer):
                break
        if longer is None:
            break
        top += 1
    layers, least = [], None
    for k, c, m in counts:
        if k <= end and c and (least is None or c < least):
            least = c
            layers.append((len(layers), k, float(first + k * step), float(first + (k + 1) * step), c, m / n))
    return rows, layers


def adaptive_dbscan(points: DataFrame, eps: float, step: float, minpts: int, metric: str = "l2", max_steps: int | None = None, halvings: int = 20, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(membership, layers): density clustering with a growing epsilon until one cluster is left.

    If the first scan has one cluster, epsilon is halved up to 20 times.  The scan ends with one cluster, or when epsilon has
    reached the largest distance, or after max_steps if given.  A layer is kept if it has fewer clusters than the last kept one.
    All steps come from one sweep (label_steps); its reach grows until the scan ends.

    With path, the sweep and every finished layer are kept there, and a scan that was stopped goes on from what it finds.
    """
    spark = points.sparkSession
    done = Finished(spark, path, f"eps={eps!r} step={step!r} minpts={minpts} metric={metric} max_steps={max_steps} halvings={halvings}") if path else None
    known = done.swept() if done else None
    rows, layers = known or sweep(points, eps, step, minpts, metric, max_steps, halvings)
    table = spark.createDataFrame(layers, LAYERS).drop("step")
    if not layers:
        return spark.createDataFrame([], "layer int, cluster int, seq_id long"), table
    if not done:
        return members_at(rows, [x[:2] for x in layers]), table
    if not known:
        done.keep_sweep(rows, layers)
    finished = {x[0] for x in done.layers()}
    for row in layers:
        if row[0] not in finished:
            done.finish(members_at(rows, [row[:2]]), row)
    return spark.read.parquet(*[done.table(x[0]) for x in layers]), table
