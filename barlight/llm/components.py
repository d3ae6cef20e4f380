"""Connected components of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barlight.session import durable

LOCAL_LINKS = 1_000_000
"""Links that one task may hold; more of them are contracted by distributed rounds first."""


def minimum_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links (a, b) and the smallest node that each of them reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        for side in (left, right):
            np.minimum.at(new, label[side], low)
            np.minimum.at(new, side, low)
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def star_round(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step: every node hangs itself and its neighbours under the smallest node it sees."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
    large = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a != b").distinct()
    down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("low"))
    small = down.join(least, "a")
    return small.select(F.col("b").alias("a"), F.col("low").alias("b")).union(small.select("a", F.col("low").alias("b"))).filter("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link; the component is its smallest node.

    *links* has long columns a and b. Star rounds run until few links are left or every node hangs under its component's smallest; then each
    remaining link is settled in one task of bounded size.
    """
    links = durable(links.filter("a != b").distinct())
    while links.count() > LOCAL_LINKS:
        before = links.agg(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()[0]
        links = durable(star_round(links))
        if links.agg(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()[0] == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b").distinct())

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if held is not None and held.num_rows:
            nodes, labels = minimum_labels(held.column("a").to_numpy(), held.column("b").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(labels)], ["node", "component"])

    return durable(links.coalesce(1).mapInArrow(settle, "node long, component long"))
