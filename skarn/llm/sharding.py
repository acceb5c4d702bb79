"""Sharding by bytes with Karmarkar-Karp differencing over indivisible groups of equal texts.

A partial partition is a tuple of byte sums. The two of largest spread are combined, the largest part of one with the
smallest of the other, until one is left; its parts are the shards. Groups go through it in buckets of bounded size:
each bucket is differenced into many bundles (a large group ends as a bundle of its own), the bundles are the next
round's items, and the last round, of a bounded number of items, makes the shards on the driver.

Defined results: a null text has no bytes and groups with the empty text; equal texts share a shard, so a group larger
than a shard's share makes its shard larger by that; repeated rows count each; null ids take slots like others; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarn.llm.common import lookup_join, materialise, pick

SHARDS = 8
#: Items differenced together, and the bundles that they make.
BUCKET_ITEMS, BUNDLES = 20_000, 256
#: Rows whose slots one task counts, about.
RANKED_TOGETHER = 1_000_000


def difference(sizes: np.ndarray, parts: int) -> np.ndarray:
    """The part of each item, by largest differencing; deterministic in the order of ``sizes``."""
    n = len(sizes)
    if not n:
        return np.zeros(0, np.int64)
    left, right = [-1] * n, [-1] * n  # a tree of what was put together
    nodes: list[list[int] | None] = []
    sums: list[list[int] | None] = []
    heap = []
    for i, s in enumerate(sizes.tolist()):
        sums.append([s])  # parts that are not named are empty
        nodes.append([i])
        heap.append((-s, i))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        sa, sb, na, nb = sums[a], sums[b], nodes[a], nodes[b]
        sums[a] = sums[b] = nodes[a] = nodes[b] = None
        # sums run from the largest down; empty parts are at the end
        if len(sa) + len(sb) <= parts:
            made = sorted(zip(sa + sb, na + nb, strict=True), reverse=True)
        else:
            sa, sb = sa + [0] * (parts - len(sa)), sb + [0] * (parts - len(sb))
            na, nb = na + [-1] * (parts - len(na)), nb + [-1] * (parts - len(nb))
            made = []
            for x, y, p, q in zip(sa, reversed(sb), na, reversed(nb), strict=True):
                if p >= 0 and q >= 0:
                    left.append(p)
                    right.append(q)
                    p = len(left) - 1
                elif p < 0:
                    p = q
                made.append((x + y, p))
            made.sort(reverse=True)
        sums.append([s for s, _ in made])
        nodes.append([p for _, p in made])
        spread = made[0][0] - (made[-1][0] if len(made) == parts else 0)
        heapq.heappush(heap, (-spread, len(sums) - 1))
    out = np.zeros(n, np.int64)
    for part, node in enumerate(nodes[heap[0][1]]):
        stack = [node]
        while stack:
            at = stack.pop()
            if at < 0:
                continue
            if at < n:
                out[at] = part
            else:
                stack += (left[at], right[at])
    return out


def _bundled(items: DataFrame, n: int) -> DataFrame:
    """items (item, size) with the bundle each goes to."""
    buckets = -(-n // BUCKET_ITEMS)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "item"], ascending=False)
        part = difference(pdf["size"].to_numpy(), BUNDLES)
        return pd.DataFrame({"item": pdf["item"], "size": pdf["size"], "bundle": [f"{b}.{p}" for b, p in zip(pdf["bucket"], part, strict=True)]})

    dealt = items.withColumn("bucket", F.pmod(F.xxhash64("item"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInPandas(run, "item string, size long, bundle string")


def shard_items(items: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(item, shard) for items (item string distinct, size long)."""
    n = items.count()
    rounds = []
    while n > BUCKET_ITEMS:
        step = materialise(_bundled(items, n), "bundles")
        rounds.append(step.select("item", "bundle"))
        items = materialise(step.groupBy("bundle").agg(F.sum("size").alias("size")).withColumnRenamed("bundle", "item"), "bundle-sizes")
        n = items.count()
    rows = sorted(((r["size"], r["item"]) for r in items.collect()), reverse=True)  # BUCKET_ITEMS at most
    part = difference(np.array([s for s, _ in rows], np.int64), shards).tolist()
    spark = items.sparkSession
    out = spark.createDataFrame([(i, int(p)) for (_, i), p in zip(rows, part, strict=True)], "item string, shard int")
    for k, step in enumerate(reversed(rounds)):
        known = out.withColumnRenamed("item", "bundle")
        out = step.join(F.broadcast(known) if k == 0 else known, "bundle").select("item", "shard")
    return out


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every document: shards of near equal bytes, slots gapless in each."""
    text = F.coalesce("text", F.lit(""))
    slim = pick(docs, id=id_col, text=text_col).select(
        "id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("item"),
    )
    slim = materialise(slim, "sizes")
    groups = materialise(slim.groupBy("item").agg(F.sum("size").alias("size")), "groups")
    placed = lookup_join(slim, shard_items(groups, shards), "item").select("id", "size", "text_crc32", "shard", "item")
    # slots: each shard's rows in shares by the id's hash, one share after the other
    shares = max(16, slim.count() // RANKED_TOGETHER)
    placed = materialise(placed.withColumn("share", F.pmod(F.xxhash64("id", "item"), F.lit(shares))), "placed")
    sizes = placed.groupBy("shard", "share").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("share")) - F.col("n")).drop("n")
    own = Window.partitionBy("shard", "share").orderBy("id", "item")
    ranked = placed.withColumn("rank", F.row_number().over(own)).join(F.broadcast(before), ["shard", "share"])  # shards x shares rows
    return ranked.select("id", "size", "text_crc32", "shard", (F.col("rank") - 1 + F.col("before")).cast("long").alias("slot"))
