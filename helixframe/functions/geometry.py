"""Volumes, densities and colours."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hypercube_volume(eps: Column, d: int) -> Column:
    return F.pow(eps, F.lit(d))


def hypersphere_volume(eps: Column, d: int, compat_lgamma: bool = False) -> Column:
    """compat_lgamma divides by the logarithm of the gamma function, as some C libraries' gamma() does."""
    by = math.lgamma(d / 2 + 1) if compat_lgamma else math.gamma(d / 2 + 1)
    return F.pow(eps, F.lit(d)) * (math.pi ** (d / 2) / by if by else float("inf"))


def density(eps: Column, d: int, minpts: int, kind: int) -> Column:
    """minpts over the volume; kind 1: hypercube, 2: hypersphere."""
    return F.lit(float(minpts)) / (hypercube_volume(eps, d) if kind == 1 else hypersphere_volume(eps, d))


def channel(colour: Column, at: int) -> Column:
    """Red (0), green (1) or blue (2) of #RRGGBB."""
    return F.conv(F.substring(colour, 2 + 2 * at, 2), 16, 10).cast("int")


def faded(colour: Column, fraction: Column) -> Column:
    """A colour mixed with white, in upper-case hex."""
    parts = [255 - ((255 - channel(colour, k)) * fraction).cast("int") for k in range(3)]
    return F.upper(F.format_string("#%02x%02x%02x", *parts))


def node_label(layer: Column, cluster: Column, n: Column) -> Column:
    return F.format_string("L%dC%dN%d", layer, cluster, n)


def parse_node_label(label: Column) -> Column:
    part = lambda k: F.regexp_extract(label, r"^L(\d+)C(\d+)N(\d+)$", k).cast("int")
    return F.struct(part(1).alias("layer"), part(2).alias("cluster"), part(3).alias("n_members"))
