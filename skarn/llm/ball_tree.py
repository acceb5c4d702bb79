"""Centroid clustering of integer vectors, exact, by filtering metric trees.

Vectors become integers, floor(64 x) a component. Each task builds ball trees over bounded runs of its own vectors, with
no shuffle: a ball keeps its centre, its radius, and the count and integer sum of its vectors. The trees are written once.
A round sends the centroids to all tasks and walks every tree from the root: by the triangle inequality a centroid whose
nearest possible distance to a ball exceeds another's farthest is out for the whole ball. A ball with one centroid left is
assigned whole, through its count and sum; a leaf with several is decided vector by vector in whole numbers. Tasks add up
what they assign, so a round brings one row a centroid to the driver, whatever the number of vectors.

The bounds are floating point with a margin; a ball that the margin leaves open descends, so every assignment is exact, ties
go to the smaller number, and floors of means are taken in whole numbers.

Defined results: vectors that are null, of another length, or with null or non-finite components are left out; a component
whose integer exceeds 2^25 in size raises, as squared distances might then not fit 64 bits; vectors that bear one id are
clustered each (first centroids: ties of the hash by the vector); a null id stays, and hashes last; fewer vectors than
centroids give fewer centroids; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import claim, materialise, pick

DIMENSIONS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 64, 16, 3, "1"
#: Vectors of a tree and of a leaf; components are smaller than this, so that all sums of squares stay whole in a double.
TREE_VECTORS, LEAF_VECTORS, LARGEST = 8_192, 24, 1 << 25
#: Above this size of a component, squared distances are taken in 64-bit integers and not in doubles.
DOUBLE_SAFE = 1 << 21


@dataclass
class Tree:
    """Balls in the order they were split: each covers vectors lo to hi; children come in pairs, leaves have child -1."""

    lo: np.ndarray
    hi: np.ndarray
    child: np.ndarray
    radius: np.ndarray
    sums: np.ndarray

    def pack(self) -> dict[str, bytes]:
        return {
            "balls": np.stack([self.lo, self.hi, self.child]).astype("<i4").tobytes(),
            "radii": self.radius.astype("<f8").tobytes(),
            "sums": self.sums.astype("<i8").tobytes(),
        }

    @classmethod
    def unpack(cls, balls: bytes, radii: bytes, sums: bytes, dimensions: int) -> Tree:
        lo, hi, child = np.frombuffer(balls, "<i4").reshape(3, -1)
        return cls(lo, hi, child, np.frombuffer(radii, "<f8"), np.frombuffer(sums, "<i8").reshape(-1, dimensions))


def build(vectors: np.ndarray, leaf: int = LEAF_VECTORS) -> tuple[Tree, np.ndarray]:
    """The tree of integer vectors and the order that makes each ball's vectors adjacent.

    A ball of more than ``leaf`` vectors and of some radius is split half and half along the line from the vector farthest
    from its centre to the one farthest from that.
    """
    order = np.arange(len(vectors))
    x = vectors.astype(np.float64)
    lo, hi, child, radius, sums = [0], [len(vectors)], [-1], [], []
    at = 0
    while at < len(lo):
        own = order[lo[at] : hi[at]]
        here = x[own]
        total = vectors[own].sum(axis=0, dtype=np.int64)
        away = ((here - total / len(own)) ** 2).sum(axis=1)
        radius.append(float(np.sqrt(away.max())))
        sums.append(total)
        if len(own) > leaf and radius[-1] > 0:
            one = here[away.argmax()]
            other = here[((here - one) ** 2).sum(axis=1).argmax()]
            side = here @ (other - one)
            half = len(own) // 2
            order[lo[at] : hi[at]] = own[np.argpartition(side, half)]
            child[at] = len(lo)
            lo += [lo[at], lo[at] + half]
            hi += [lo[at] + half, hi[at]]
            child += [-1, -1]
        at += 1
    return Tree(np.array(lo), np.array(hi), np.array(child), np.array(radius), np.array(sums).reshape(len(lo), -1)), order


def squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors to integer centroids."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if most < DOUBLE_SAFE:  # sums stay below 2^53
        x, centroids = x.astype(np.float64), centroids.astype(np.float64)
    else:
        x, centroids = x.astype(np.int64), centroids.astype(np.int64)
    out = (x * x).sum(axis=1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(axis=1)[None]
    return out.astype(np.int64)


def filter_balls(tree: Tree, vectors: np.ndarray, centroids: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray | None]]:
    """Disjoint pieces that cover all vectors: (lo, hi, centroid, None) of a whole ball, (lo, hi, -1, candidates) of a leaf left open."""
    c = centroids.astype(np.float64)
    balls = np.array([0])
    left = np.ones((1, len(c)), bool)
    while len(balls):
        n = (tree.hi[balls] - tree.lo[balls])[:, None]
        centre = tree.sums[balls] / n
        gap = np.sqrt(((centre[:, None, :] - c[None]) ** 2).sum(axis=2))
        margin = 1e-9 * (1.0 + gap + tree.radius[balls][:, None])
        farthest = np.where(left, gap + tree.radius[balls][:, None] + margin, np.inf).min(axis=1, keepdims=True)
        left = left & (gap - tree.radius[balls][:, None] - margin <= farthest)
        single = left.sum(axis=1) == 1
        for b, k in zip(balls[single].tolist(), left[single].argmax(axis=1).tolist(), strict=True):
            yield int(tree.lo[b]), int(tree.hi[b]), k, None
        leaf = ~single & (tree.child[balls] < 0)
        for b, some in zip(balls[leaf].tolist(), left[leaf], strict=True):
            yield int(tree.lo[b]), int(tree.hi[b]), -1, np.flatnonzero(some)
        down = ~single & ~leaf
        first = tree.child[balls[down]]
        balls, left = np.concatenate([first, first + 1]), np.concatenate([left[down], left[down]])


def _whole(tree: Tree) -> dict[tuple[int, int], int]:
    return {(lo, hi): k for k, (lo, hi) in enumerate(zip(tree.lo.tolist(), tree.hi.tolist(), strict=True))}


def tally(tree: Tree, vectors: np.ndarray, centroids: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
    """Add what each centroid gets from a tree to ``sums`` and ``counts``."""
    place = _whole(tree)
    for lo, hi, k, some in filter_balls(tree, vectors, centroids):
        if some is None:
            sums[k] += tree.sums[place[lo, hi]]
            counts[k] += hi - lo
        else:
            best = some[squares(vectors[lo:hi], centroids[some]).argmin(axis=1)]
            np.add.at(sums, best, vectors[lo:hi].astype(np.int64))
            np.add.at(counts, best, 1)


def assign(tree: Tree, vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, squared distance) of each vector."""
    which, far = np.empty(len(vectors), np.int32), np.empty(len(vectors), np.int64)
    for lo, hi, k, some in filter_balls(tree, vectors, centroids):
        if some is None:
            which[lo:hi] = k
            far[lo:hi] = squares(vectors[lo:hi], centroids[k : k + 1])[:, 0]
        else:
            all_ = squares(vectors[lo:hi], centroids[some])
            best = all_.argmin(axis=1)
            which[lo:hi] = some[best]
            far[lo:hi] = all_[np.arange(hi - lo), best]
    return which, far


# --- in Spark -------------------------------------------------------------------------------------------------------


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(id, v array<long>) of the vectors that are kept."""

    def whole(x):
        return F.floor(F.lit(scale) * x.cast("double")).cast("long")

    def fine(x):
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))

    slim = pick(rows, id=id_col, vector=vector_col)
    kept = slim.where((F.size("vector") == dimensions) & F.forall("vector", fine))
    too_large = F.exists("vector", lambda x: F.abs(x.cast("double")) >= LARGEST / scale)
    guard = F.when(too_large, F.raise_error(F.lit("a component is too large for exact squared distances"))).otherwise(F.transform("vector", whole))
    return kept.select("id", guard.cast("array<long>").alias("v"))


def _kind(x: np.ndarray) -> str:
    most = int(np.abs(x).max(initial=0))
    return "<i1" if most < 1 << 7 else "<i2" if most < 1 << 15 else "<i4"


def trees(vectors: DataFrame, dimensions: int = DIMENSIONS, size: int = TREE_VECTORS) -> DataFrame:
    """Trees of (id, v), each over at most ``size`` vectors of one task: (ids, kind, vectors, balls, radii, sums)."""
    id_type = vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("ball_tree")
        held, n = [], 0

        def grown(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts).combine_chunks()
            flat = t.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False)
            v = flat.astype(np.int64).reshape(-1, dimensions)
            tree, order = build(v)
            kind = _kind(v)
            packed = tree.pack()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([t.column(0).combine_chunks().take(pa.array(order)).to_pylist()], pa.list_(t.schema.field(0).type)),
                    pa.array([kind]),
                    pa.array([v[order].astype(kind).tobytes()], pa.binary()),
                    *(pa.array([packed[c]], pa.binary()) for c in ("balls", "radii", "sums")),
                ],
                names=["ids", "kind", "vectors", "balls", "radii", "sums"],
            )

        for b in batches:
            at = 0
            while at < b.num_rows:
                part = b.slice(at, min(size - n, b.num_rows - at))
                held.append(part)
                n += part.num_rows
                at += part.num_rows
                if n == size:
                    yield grown(held)
                    held, n = [], 0
        if held:
            yield grown(held)

    return vectors.mapInArrow(run, f"ids array<{id_type}>, kind string, vectors binary, balls binary, radii binary, sums binary")


def _opened(b: pa.RecordBatch, k: int, dimensions: int) -> tuple[Tree, np.ndarray]:
    kind, vectors, balls, radii, sums = (b.column(c)[k].as_py() for c in range(1, 6))
    return Tree.unpack(balls, radii, sums, dimensions), np.frombuffer(vectors, kind).reshape(-1, dimensions)


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: str = SEED) -> np.ndarray:
    """The vectors whose id has the smallest hashes."""
    at = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.select("v", at.alias("at")).orderBy(F.col("at").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def moved(forest: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of the means of what each is nearest to; without any it stays."""
    dimensions = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for b in batches:
            for k in range(b.num_rows):
                tally(*_opened(b, k, dimensions), centroids, sums, counts)
        got = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(got.astype(np.int32)), pa.array(counts[got]), pa.array(list(sums[got]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"]
        )

    parts = forest.mapInArrow(run, "cluster int, n long, sums array<long>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[d]) for d in range(dimensions))).alias("sums"))
    out = centroids.copy()
    for r in total.collect():  # a row a centroid
        out[r["cluster"]] = [s // r["n"] for s in r["sums"]]
    return out


def nearest(forest: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every vector of the trees."""
    dimensions = centroids.shape[1]
    id_type = forest.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                which, far = assign(*_opened(b, k, dimensions), centroids)
                yield pa.RecordBatch.from_arrays([b.column(0)[k].values, pa.array(which), pa.array(far)], names=["id", "cluster", "distance"])

    return forest.mapInArrow(run, f"id {id_type}, cluster int, distance long")


def centroid_digest(c: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()


def cluster_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, **shape: int) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid array<long>, centroid_sha256) of every kept vector."""
    vectors = whole_vectors(rows, id_col, vector_col, **shape)
    centroids = first_centroids(vectors, k)
    spark = rows.sparkSession
    if not len(centroids):
        placed = vectors.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    else:
        forest = materialise(trees(vectors, centroids.shape[1]), "trees")
        for _ in range(rounds):
            centroids = moved(forest, centroids)
        placed = materialise(nearest(forest, centroids), "clusters")
    sums = {r["cluster"]: r["far"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("far")).collect()}  # a row a centroid
    total = sum(sums.values())
    made = [(i, sums[i], total, c.tolist(), centroid_digest(c)) for i, c in enumerate(centroids) if i in sums]
    about = spark.createDataFrame(made, "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    return placed.join(F.broadcast(about), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")
