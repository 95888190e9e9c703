"""Filling fixed-capacity containers: first-fit decreasing with a tournament tree, in randomised groups of items.

The tree holds the room left in each container; the leftmost with enough room is found in logarithmic time. Items are
dealt to groups by a hash, so each group sees the same mix of sizes whatever the order of the rows, and groups are packed
independently. An item above the capacity fills whole containers, and its remainder is packed like any other item.

Cases: items of size 0 are placed like others (they only use up separators); null sizes have no place; equal sizes are
taken in the order of their ids; no items give no containers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of a group: enough for the last containers not to matter, few enough for one task.
GROUP_ITEMS = 16_384
SCHEMA = "spec_id int, grp int, container long, place int, doc_id long, part int, first_token long, tokens long"


def first_fit(sizes: list[int], capacity: int) -> list[int]:
    """Container of each size in the order given: the leftmost one with room for it."""
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    tree = [capacity] * (2 * leaves)
    out = []
    for size in sizes:
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        out.append(node - leaves)
        tree[node] -= size
        node //= 2
        while node:
            left, right = tree[2 * node], tree[2 * node + 1]
            best = left if left > right else right
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
    return out


def pack_group(items: pd.DataFrame) -> pd.DataFrame:
    """Packs the items (doc_id, tokens) of one spec and group; also the pieces of those above the capacity."""
    capacity, gap = int(items["capacity_tokens"].iloc[0]), int(items["separator_tokens"].iloc[0])
    docs, sizes = items["doc_id"].to_numpy(np.int64), items["tokens"].to_numpy(np.int64)
    full, rest = sizes // capacity, sizes % capacity
    # an item of exactly the capacity is one piece; an empty one is one of size 0
    parts = full + ((rest > 0) | (full == 0))
    owner = np.repeat(np.arange(len(docs)), parts)
    part = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    size = np.minimum(sizes[owner] - part * capacity, capacity)
    order = np.lexsort((part, docs[owner], -size))
    owner, part, size = owner[order], part[order], size[order]
    container = np.array(first_fit((size + gap).tolist(), capacity + gap), dtype=np.int64)
    frame = pd.DataFrame(
        {
            "spec_id": items["spec_id"].iloc[0],
            "grp": items["grp"].iloc[0],
            "container": container,
            "doc_id": docs[owner],
            "part": part + 1,
            "first_token": part * capacity,
            "tokens": size,
        }
    )
    frame["place"] = frame.groupby("container").cumcount() + 1
    return frame[[c.split()[0] for c in SCHEMA.split(", ")]]


def pack(items: DataFrame, specs: DataFrame, key: str = "doc_id", size: str = "tokens", group_items: int = GROUP_ITEMS) -> DataFrame:
    """Places the items in the containers of every spec: a row per item or piece, with container and place in it.

    specs (spec_id, capacity_tokens, separator_tokens) is joined to all items: it says how often they are packed.
    """
    count = items.count()
    groups = max(1, -(-count // group_items))
    dealt = items.filter(F.col(size).isNotNull()).select(
        F.col(key).cast("bigint").alias("doc_id"), F.col(size).cast("bigint").alias("tokens"), F.pmod(F.xxhash64(F.col(key)), F.lit(groups)).cast("int").alias("grp")
    )
    # every item once per spec: the specs travel as one constant array
    rows = [r.asDict() for r in specs.select("spec_id", "capacity_tokens", "separator_tokens").distinct().collect()]
    if not rows:
        return items.sparkSession.createDataFrame([], SCHEMA)
    each = F.array(*(F.struct(*(F.lit(r[c]).cast("int").alias(c) for c in ("spec_id", "capacity_tokens", "separator_tokens"))) for r in rows))
    wide = dealt.withColumn("s", F.explode(each)).select("doc_id", "tokens", "grp", "s.*")
    return wide.groupBy("spec_id", "grp").applyInPandas(pack_group, SCHEMA)


def fill(placed: DataFrame, specs: DataFrame) -> DataFrame:
    """Per spec: items, containers, least containers possible by size, and the share of the capacity that is used."""
    per = placed.groupBy("spec_id", "grp", "container").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    sums = per.groupBy("spec_id").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.sum("n").alias("items"))
    capacity, gap = F.col("capacity_tokens"), F.col("separator_tokens")
    return sums.join(specs, "spec_id").select(
        "spec_id",
        "items",
        "tokens",
        "containers",
        F.ceil((F.col("tokens") + gap * F.col("items")) / (capacity + gap)).alias("least_containers"),
        F.round((F.col("tokens") + gap * (F.col("items") - F.col("containers"))) / (F.col("containers") * capacity), 6).alias("used"),
    )
