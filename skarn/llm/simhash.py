"""SimHash near-duplicate detection by tiled exact comparison.

Fingerprints are compared in tiles of one population count each. Two words that differ in r bits have population counts
at most r apart, so tile pairs further apart are never formed; inside a pair the same bound on the four 16-bit quarters
skips most sub-tiles. What is left is compared exactly with numpy exclusive-or and bit counts. A tile pair emits a
spanning forest of its links, never the links themselves, and components grow over those forests.

Defined results: a null or word-less text has the fingerprint zero and links like any other; fewer words than a shingle
make one shingle; repeated rows share a component; a null id joins its component but is never its name (a component of
null ids alone is named null); an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm.common import HOT_ROWS, claim, free_name, lookup_join, materialise, pick, release, slices

SEED, SHINGLE, RADIUS, TILE_ROWS = 42, 4, 4, 131_072
#: Words of either side compared at once: 64 MB of exclusive-ors.
BLOCK_ROWS, BLOCK_WORDS = 128, 65_536


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of one text: A-Z lowered, word shingles with repeats, a bit set in over half of the hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
        starts, stops = [0, *ends[: len(words) - shingle].tolist()], (ends[shingle - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)]
    # big-endian bytes, so that unpacked bit k is bit 63-k of the hash
    bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
    majority = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int.from_bytes(np.packbits(majority).tobytes(), "big")


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, hashed: bool = False) -> DataFrame:
    """(id, fp): every document's fingerprint as a signed 64-bit integer; with hashed also the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash")
        for b in slices(batches, 1):
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64)
            rest = {b.schema.names[k]: b.column(k) for k in range(2, b.num_columns)}
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *rest.values()], names=["id", "fp", *rest])

    slim = pick(docs, id=id_col, text=text_col)
    if hashed:
        slim = slim.withColumn("hash", F.xxhash64("text"))
    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, fp long" + ", hash long" * hashed)


def _quarters(x: np.ndarray) -> np.ndarray:
    """Bit counts of the four 16-bit quarters, one row a word."""
    return np.bitwise_count(x.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def _classes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x in order of its quarters' bit counts; each class's counts, and where it starts."""
    q = _quarters(x)
    code = ((q[:, 0] * 17 + q[:, 1]).astype(np.int64) * 17 + q[:, 2]) * 17 + q[:, 3]
    order = np.argsort(code, kind="stable")
    _, first = np.unique(code[order], return_index=True)
    return x[order], q[order][first], np.append(first, len(x))


def _touched(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> np.ndarray:
    """The words of a and b that have a neighbour within the radius in the other (for same: besides themselves)."""
    a, qa, at_a = _classes(a)
    b, qb, at_b = (a, qa, at_a) if same else _classes(b)
    hit_a, hit_b, sizes_b = np.zeros(len(a), bool), np.zeros(len(b), bool), np.diff(at_b)
    for k in range(len(qa)):
        near = np.abs(qb - qa[k]).sum(axis=1) <= radius
        if same:
            near[:k] = False
        if not near.any():
            continue
        members = np.flatnonzero(np.repeat(near, sizes_b))
        others = b[members]
        for lo in range(at_a[k], at_a[k + 1], BLOCK_ROWS):
            rows = a[lo : min(lo + BLOCK_ROWS, at_a[k + 1])]
            for c in range(0, len(others), BLOCK_WORDS):
                close = np.bitwise_count(rows[:, None] ^ others[None, c : c + BLOCK_WORDS]) <= radius
                if same:  # a word meets itself once
                    close &= members[None, c : c + BLOCK_WORDS] != np.arange(lo, lo + len(rows))[:, None]
                if close.any():
                    hit_a[lo : lo + len(rows)] |= close.any(axis=1)
                    hit_b[members[c : c + BLOCK_WORDS][close.any(axis=0)]] = True
    if same:
        return a[hit_a | hit_b]
    return np.unique(np.concatenate([a[hit_a], b[hit_b]]))


def _forest(words: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, root) for words that reach another within the radius: breadth first over what is not yet reached."""
    left, src, dst = np.sort(words), [], []
    while len(left):
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= radius
            if near.any():
                found = left[near]
                left = left[~near]
                queue.extend(found)
                src.append(found)
                dst.append(np.full(len(found), root))
    none = np.zeros(0, np.uint64)
    return (np.concatenate(src), np.concatenate(dst)) if src else (none, none)


def links(fps: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(src, dst): a spanning forest for each tile pair over the distinct fingerprints in column ``fp``.

    Every pair of fingerprints within the radius lies in one tile pair, so the forests together connect what the links
    connect; there are at most as many rows as words in the tile pairs. Only the number of words of each population
    count (65 figures) comes to the driver.
    """
    counts = {r["p"]: r["n"] for r in fps.groupBy(F.bit_count("fp").alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    split = [-(-counts.get(p, 0) // tile_rows) for p in range(65)]
    base = np.concatenate([[0], np.cumsum(split)]).tolist()
    lows = [base[max(0, p - radius)] for p in range(65)]
    highs = [base[min(64, p + radius) + 1] - 1 for p in range(65)]

    def of(values: list[int]):
        return F.get(F.array(*(F.lit(int(v)) for v in values)), F.bit_count("fp"))

    tile = of(base[:65]) + F.pmod(F.xxhash64("fp"), F.greatest(of(split), F.lit(1))).cast("int")
    tiles = (
        fps.select("fp", tile.alias("tile"), of(lows).alias("lo"), of(highs).alias("hi"))
        .groupBy("tile", "lo", "hi")
        .agg(F.collect_list("fp").alias("fps"))
    )
    met = tiles.withColumn("other", F.explode(F.sequence("lo", "hi"))).select(
        F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "fps"
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [np.asarray(x, dtype=np.int64).view(np.uint64) for x in pdf["fps"]]
        same = pdf["a"].iloc[0] == pdf["b"].iloc[0]
        if not same and len(sides) < 2:
            sides.append(np.zeros(0, np.uint64))
        src, dst = _forest(_touched(sides[0], sides[-1], radius, same), radius)
        return pd.DataFrame({"src": src.view(np.int64), "dst": dst.view(np.int64)})

    return met.groupBy("a", "b").applyInPandas(compare, "src long, dst long")


def components(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the least label that each node's component holds.

    A node's name is the pair of least label and node that it has heard of. Rounds of minimum propagation over the edges
    and one pointer jump, each cut by a written table, until a round changes nothing; the names then hold the labels. A
    hot node's messages are reduced before the shuffle, and the jump to a name that very many nodes bear is a broadcast.
    nodes: (node, label), a written table; edges: (src, dst), each once in any direction.
    """
    both = materialise(edges.union(edges.select("dst", "src")).distinct(), "edges")
    own = nodes.select("node", F.struct(F.col("label").isNull().alias("unnamed"), "label", "node").alias("name"))
    names = materialise(own.join(both.select(F.col("src").alias("node")).distinct(), "node", "left_semi"), "names")
    while True:
        heard = lookup_join(both.select("src", F.col("dst").alias("node")), names, "node").groupBy("src").agg(F.min("name").alias("heard"))
        near = materialise(
            names.join(heard, names["node"] == heard["src"], "left").select(
                "node", F.col("name").alias("old"), F.least("name", F.coalesce("heard", "name")).alias("name"), F.least("name", F.coalesce("heard", "name"))["node"].alias("at")
            ),
            "near",
        )
        step = lookup_join(near, names.select(F.col("node").alias("at"), F.col("name").alias("jump")), "at")
        moved = materialise(step.select("node", F.least("name", "jump").alias("name"), "old"), "names")
        release(names, near)
        names, changed = moved.select("node", "name"), moved.where(F.col("name") != F.col("old")).limit(1).count()
        names._skarn_path = moved._skarn_path
        if not changed:
            break
    release(both)
    return nodes.join(names, "node", "left").select("node", F.when(F.col("name").isNull(), F.col("label")).otherwise(F.col("name")["label"]).alias("label"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, tile_rows: int = TILE_ROWS
) -> DataFrame:
    """One row a document: id, fp (signed) and component, the least id that links reach from it."""
    spark = docs.sparkSession
    marked = materialise(with_fingerprints(docs, id_col, text_col, shingle), "simhash")
    distinct = materialise(marked.groupBy("fp").agg(F.min("id").alias("label")), "fps")
    found = components(spark, distinct.select(F.col("fp").alias("node"), "label"), links(distinct.select("fp"), radius, tile_rows))
    return lookup_join(marked, materialise(found.withColumnRenamed("node", "fp"), "labels"), "fp").select("id", "fp", F.col("label").alias("component"))


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, tile_rows: int = TILE_ROWS
) -> DataFrame:
    """One row of each component: that of the least id, null ids last, and of the least text hash. All columns come back.

    A row is told by its id and its text's hash, so an id with unlike texts has a row in each component where it is the
    least, and a component of null ids alone keeps one of its rows. Of repeated rows one stays, of those that differ in other
    columns the one of least hash of all columns (maps apart).
    """
    marked = materialise(with_fingerprints(docs, id_col, text_col, shingle, hashed=True), "simhash")
    row = F.struct(F.col("id").isNull().alias("unnamed"), "id", "hash")
    distinct = materialise(marked.groupBy("fp").agg(F.min(row).alias("label")), "fps")
    found = components(docs.sparkSession, distinct.select(F.col("fp").alias("node"), "label"), links(distinct.select("fp"), radius, tile_rows))
    keep = materialise(found.select(F.col("label.id").alias("__kept_id"), F.col("label.hash").alias("__kept_hash")).distinct(), "kept")
    own = free_name(docs, "__own_hash")
    rows = docs.withColumn(own, F.xxhash64(F.col(f"`{text_col}`")))

    def held_by(keys: DataFrame):
        return rows[f"`{id_col}`"].eqNullSafe(keys["__kept_id"]) & (rows[own] == keys["__kept_hash"])

    # keys of very many rows go to all tasks, the others are shuffled; either way equal rows meet after one was kept of each task
    counts = marked.groupBy(F.col("id").alias("__kept_id"), F.col("hash").alias("__kept_hash")).agg(F.count(F.lit(1)).alias("n"))
    hot = counts.where(F.col("n") >= max(HOT_ROWS, marked.count() // 1000)).drop("n")  # a thousand at most
    hot = materialise(hot, "hot")
    on = keep["__kept_id"].eqNullSafe(hot["__kept_id"]) & (keep["__kept_hash"] == hot["__kept_hash"])
    often, seldom = keep.join(F.broadcast(hot), on, "left_semi"), keep.join(F.broadcast(hot), on, "left_anti")
    cold = rows.join(F.broadcast(hot), held_by(hot), "left_anti")
    same = cold[f"`{id_col}`"].eqNullSafe(seldom["__kept_id"]) & (cold[own] == seldom["__kept_hash"])
    parts = [rows.join(F.broadcast(often), held_by(often), "left_semi"), cold.join(seldom, same, "left_semi")] if not hot.isEmpty() else [rows.join(keep, held_by(keep), "left_semi")]
    columns = [F.col(f"`{c}`") for c in docs.columns]
    told = F.xxhash64(*(F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind))
    one = [p.groupBy(F.col(f"`{id_col}`").alias("__i"), F.col(own).alias("__h")).agg(F.min_by(F.struct(*columns), told).alias("__row")).select("__row.*") for p in parts]
    return reduce(DataFrame.unionByName, one)
