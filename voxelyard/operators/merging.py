"""Merges of nodes: pairs give edges, edges give components, a component becomes one node. Its name is
its smallest member, so results don't depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .iterative import with_components
from .relational import nearest


def merge(nodes: DataFrame, node: str, edges: DataFrame, *aggregates: Column) -> DataFrame:
    """(node, members, aggregates): a row for each component of the nodes; edges are (a, b). Nodes have
    one row each; a node without edges stays as it is."""
    return with_components(nodes, node, edges).groupBy(F.col("component").alias(node)).agg(F.count(F.lit(1)).alias("members"), *aggregates)


def all_names(names: str) -> Column:
    """The distinct names of merged nodes, sorted; a node has a few."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(names))))


def union_points(sets: DataFrame, node: str, point: str, edges: DataFrame) -> DataFrame:
    """(node, members, n_points, observations) of merged nodes; sets has a row for each observation of a
    point. Points are made distinct by the shuffle that counts them; a component's are never in one row."""
    seen = sets.groupBy(node, point).agg(F.count(F.lit(1)).alias("seen"))
    named = with_components(sets.select(node).distinct(), node, edges)
    points = seen.join(named, node).groupBy("component", point).agg(F.sum("seen").alias("seen"))
    merged = points.groupBy(F.col("component").alias(node)).agg(F.count(F.lit(1)).alias("n_points"), F.sum("seen").alias("observations"))
    return named.groupBy(F.col("component").alias(node)).agg(F.count(F.lit(1)).alias("members")).join(merged, node)


def strongest(nodes: DataFrame, node: str, edges: DataFrame, order: list[Column]) -> DataFrame:
    """(component, node, ...): the first of each component by a total order stands for it."""
    return nearest(with_components(nodes, node, edges), ["component"], order)


def dense_ids(nodes: DataFrame, scene: str, order: list[Column]) -> DataFrame:
    """nodes with `id` from 1 along a total order within a scene."""
    return nodes.withColumn("id", F.row_number().over(Window.partitionBy(scene).orderBy(*order)).cast("long"))
