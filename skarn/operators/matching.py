"""Detections against truths: greedy and optimal matching, suppression, precision and recall."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from skarn.operators import ranking


def iou_center(a: list[Column], b: list[Column]) -> Column:
    """Axis-aligned boxes as centre x, y and width, height; yaw and height play no part; 1e-8 in the denominator."""
    lo = [F.greatest(a[i] - a[i + 2] / 2, b[i] - b[i + 2] / 2) for i in (0, 1)]
    hi = [F.least(a[i] + a[i + 2] / 2, b[i] + b[i + 2] / 2) for i in (0, 1)]
    inter = F.greatest(hi[0] - lo[0], F.lit(0.0)) * F.greatest(hi[1] - lo[1], F.lit(0.0))
    return inter / (a[2] * a[3] + b[2] * b[3] - inter + F.lit(1e-8))


def iou_corner(a: list[Column], b: list[Column]) -> Column:
    """Boxes as x1, y1, x2, y2; 0 for an empty union."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    inter = w * h
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return F.coalesce(inter / F.nullif(union, F.lit(0.0)), F.lit(0.0))


#: Boxes of a cell that meet in one group of a join; a fuller cell is split.
CROWD = 8192


def meeting_boxes(df: DataFrame, keys: list[str], id_col: str, cell: float, crowd: int = CROWD) -> DataFrame:
    """(keys, a, b, iou): pairs a < b of one key's boxes (x, y, w, h) that share an area.

    A box goes to every cell of width ``cell`` that it touches, and a pair is told by the cell of the lower left corner of
    what it shares, so it comes once whatever the boxes' sizes. A box of cells' width or less goes to four at most; a large
    one costs as many rows as it covers cells, and changes nothing for the others.

    The pairs of a cell may be as many as the square of its boxes, so one that holds more than ``crowd`` is split by the hash of
    the id, and its parts meet two by two, each two in a group of their own. The split cells are broadcast, one row for ``crowd``
    rows or more.
    """
    at = lambda v: F.floor(v / F.lit(float(cell)))
    low = {c: F.col(c) - F.col(s) / 2 for c, s in (("x", "w"), ("y", "h"))}
    high = {c: F.col(c) + F.col(s) / 2 for c, s in (("x", "w"), ("y", "h"))}
    dealt = df.where((F.col("w") > 0) & (F.col("h") > 0)).select(*keys, id_col, *"xywh")
    for c, name in (("x", "i"), ("y", "j")):
        dealt = dealt.withColumn(name, F.explode(F.sequence(at(low[c]), at(high[c]))))
    split = dealt.groupBy(*keys, "i", "j").agg(F.ceil(F.count(F.lit(1)) / crowd).cast("int").alias("parts")).where("parts > 1")
    dealt = dealt.join(F.broadcast(split), [*keys, "i", "j"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own, every = F.pmod(F.xxhash64(id_col), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    side = lambda tag, p, q: dealt.select(*keys, "i", "j", p.alias("p"), q.alias("q"), F.col(id_col).alias(tag), *(F.col(c).alias(f"{tag}_{c}") for c in "xywh"))
    corner = lambda c, s: F.greatest(*(F.col(f"{t}_{c}") - F.col(f"{t}_{s}") / 2 for t in "ab"))
    pairs = side("a", own, every).join(side("b", every, own), [*keys, *"ijpq"]).where("a < b").where((at(corner("x", "w")) == F.col("i")) & (at(corner("y", "h")) == F.col("j")))
    iou = iou_center([F.col(f"a_{c}") for c in "xywh"], [F.col(f"b_{c}") for c in "xywh"])
    return pairs.select(*keys, "a", "b", iou.alias("iou")).where("iou > 0")


def _iou(boxes: np.ndarray, box: np.ndarray) -> np.ndarray:
    lo = np.maximum(boxes[:, :2] - boxes[:, 2:] / 2, box[:2] - box[2:] / 2)
    hi = np.minimum(boxes[:, :2] + boxes[:, 2:] / 2, box[:2] + box[2:] / 2)
    inter = np.clip(hi - lo, 0, None).prod(axis=1)
    return inter / (boxes[:, 2:].prod(axis=1) + box[2:].prod() - inter + 1e-8)


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows in order of their first ``n_keys`` columns as (rows, first row of each group and the number of rows), groups whole.

    Many groups come at once; a group is held until its last row has come.
    """
    held: pa.Table | None = None

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(max(t.num_rows - 1, 0), bool)
        for c in t.columns[:n_keys]:
            a, b = c.slice(1), c.slice(0, max(t.num_rows - 1, 0))
            differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy()
            new |= differ | (pc.is_null(a).to_numpy() != pc.is_null(b).to_numpy())
        return np.concatenate([[0], np.flatnonzero(new) + 1])

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
        at = starts(t)
        if len(at) > 1:
            yield t.slice(0, at[-1]), at
        held = t.slice(at[-1])
    if held is not None:
        yield held, np.array([0, held.num_rows])


def _boxes(column: pa.ChunkedArray, n: int = 4) -> np.ndarray:
    return np.array([v if v is not None else [np.nan] * n for v in column.to_pylist()], float).reshape(-1, n)


def _streamed(rows: DataFrame, keys: list[str], order: list[str | Column], run: Callable[[pa.Table, int, int], Iterator[tuple]], names: list[str], schema: str) -> DataFrame:
    """What ``run`` makes of each group of ``keys``, as the keys and the named columns.

    Rows are dealt and sorted by key, and a task goes through its groups in order, many in an Arrow batch: small groups cost
    no call each. run(table, lo, hi) gives rows of the group from lo to hi of the table.
    """
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    made = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", " + schema
    dealt = rows.select(*keys, *(c for c in rows.columns if c not in keys)).repartition(*keys).sortWithinPartitions(*keys, *order)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in _groups(batches, len(keys)):
            out, owner = [], []
            for lo, hi in pairwise(at.tolist()):
                found = list(run(t, lo, hi))
                out += found
                owner += [lo] * len(found)
            if out:
                first = pa.array(owner, pa.int64())
                given = [t.column(i).take(first).combine_chunks() for i in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*given, *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names=[*keys, *names])

    kinds = [to_arrow_type(f.dataType) for f in StructType.fromDDL(schema)]
    return dealt.mapInArrow(go, made)


def _sides(pred: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Both as one table: side 0 predictions, 1 truths."""
    return pred.withColumn("side", F.lit(0)).unionByName(truth.select(*keys, *(c for c in truth.columns if c not in keys), F.lit(1).alias("side")), allowMissingColumns=True)


def greedy_match(pred: DataFrame, truth: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(keys, pred_id, truth_id, iou, tp): predictions by score take the best truth left; below the threshold none is taken.

    pred: keys, id, score, box (cx, cy, w, h); truth: keys, id, box. One image and class is a group.
    """

    def run(t: pa.Table, lo: int, hi: int) -> Iterator[tuple]:
        side = t.column("side").slice(lo, hi - lo).to_numpy()
        n = int((side == 0).sum())
        if not n:
            return
        ids, boxes = t.column("id").slice(lo, hi - lo).to_pylist(), _boxes(t.column("box").slice(lo, hi - lo))
        truths, free = boxes[n:], np.ones(hi - lo - n, bool)
        for k in range(n):
            best, at = 0.0, -1
            if free.any():
                v = np.where(free, _iou(truths, boxes[k]), -1.0)
                if v.max() > 0:
                    at, best = int(v.argmax()), float(v.max())
            hit = at >= 0 and best >= threshold
            if hit:
                free[at] = False
            yield ids[k], ids[n + at] if hit else None, best, hit

    both = _sides(pred.select(*keys, "id", "score", "box"), truth.select(*keys, "id", "box"), keys)
    order = ["side", F.col("score").desc(), F.col("id")]
    return _streamed(both, keys, order, run, ["pred_id", "truth_id", "iou", "tp"], "pred_id long, truth_id long, iou double, tp boolean")


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Row and column pairs of least total cost: shortest augmenting paths with potentials."""
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    n, m = c.shape
    u, v, owner = np.zeros(n), np.zeros(m + 1), np.full(m + 1, -1)
    for i in range(n):
        owner[m] = i
        j0, least, way, used = m, np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        while owner[j0] >= 0:
            used[j0] = True
            i0 = owner[j0]
            open_ = ~used[:m]
            reduced = c[i0] - u[i0] - v[:m]
            better = open_ & (reduced < least)
            least[better], way[better] = reduced[better], j0
            j1 = int(np.where(open_, least, np.inf).argmin())
            delta = least[j1]
            for j in np.flatnonzero(used).tolist():
                u[owner[j]] += delta
                v[j] -= delta
            least[open_] -= delta
            j0 = j1
        while j0 != m:
            owner[j0] = owner[way[j0]]
            j0 = int(way[j0])
    pairs = [(int(owner[j]), j) for j in range(m) if owner[j] >= 0]
    return sorted((b, a) if turned else (a, b) for a, b in pairs)


def optimal_match(pred: DataFrame, truth: DataFrame, keys: list[str], class_weight: float = 1.0, box_weight: float = 1.0) -> DataFrame:
    """(keys, pred_id, truth_id, cost): one-to-one of least class and L1 box cost. pred has probs array, truth label int."""

    def run(t: pa.Table, lo: int, hi: int) -> Iterator[tuple]:
        part = t.slice(lo, hi - lo)
        n = int((part.column("side").to_numpy() == 0).sum())
        if n in (0, hi - lo):
            return
        probs, box = np.array(part.column("probs").slice(0, n).to_pylist(), float), np.array(part.column("box").to_pylist(), float)
        labels = np.array(part.column("label").slice(n).to_pylist(), int)
        cost = -class_weight * probs[:, labels] + box_weight * np.abs(box[:n, None] - box[None, n:]).sum(-1)
        ids = part.column("id").to_pylist()
        for i, j in assignment(cost):
            yield ids[i], ids[n + j], float(cost[i, j])

    both = _sides(pred.select(*keys, "id", "probs", "box"), truth.select(*keys, *(c for c in ("id", "label", "box") if c not in keys)), keys)
    return _streamed(both, keys, ["side", "id"], run, ["pred_id", "truth_id", "cost"], "pred_id long, truth_id long, cost double")


def nms(
    df: DataFrame,
    keys: list[str],
    threshold: float,
    most: int | None = None,
    frame: list[str] | None = None,
    floor: float | None = None,
    before: int | None = None,
) -> DataFrame:
    """Boxes (id, score, box) of one key by score; a box stays if it overlaps no kept one by more than the threshold.

    Boxes of scores up to ``floor`` are left out, only the ``before`` best of a key compete, and of what stays each
    ``frame`` (the first key by default) keeps its ``most`` best, whatever their classes and cameras.
    """
    columns = df.columns
    best = lambda d, by, n: ranking.top_k(d, by, [F.col("score").desc(), F.col("id")], n, "_rn").drop("_rn")
    if floor is not None:
        df = df.where(F.col("score") > floor)
    if before is not None:
        df = best(df, keys, before)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in _groups(batches, len(keys)):
            every, stay = _boxes(t.column("box")), []
            for lo, hi in pairwise(at.tolist()):
                boxes, kept = every[lo:hi], []
                for i in range(hi - lo):
                    if not kept or _iou(boxes[kept], boxes[i]).max() <= threshold:
                        kept.append(i)
                stay += [lo + i for i in kept]
            yield from t.take(pa.array(stay, pa.int64())).combine_chunks().to_batches()

    dealt = df.select(*keys, *(c for c in columns if c not in keys)).repartition(*keys).sortWithinPartitions(*keys, F.col("score").desc(), F.col("id"))
    out = dealt.mapInArrow(go, dealt.schema).select(*columns)
    return out if most is None else best(out, frame or keys[:1], most)


def relaxed_threshold(top: Column, start: float, factor: float = 0.9, floor: float = 0.01) -> Column:
    """start times the least power of ``factor`` that the top score exceeds; below ``floor`` everything passes (0)."""
    steps = F.greatest(F.ceil(F.log(top / F.lit(start)) / F.log(F.lit(factor)) + 1e-12), F.lit(0))
    k = F.when(top > start, F.lit(0)).otherwise(steps)
    value = F.lit(start) * F.pow(F.lit(factor), k)
    value = F.when(top > value, value).otherwise(value * F.lit(factor))
    return F.when((top <= 0) | (value < floor), F.lit(0.0)).otherwise(value)


def precision_recall(df: DataFrame, keys: list[str], tp: str, fp: str, fn: str) -> DataFrame:
    """Precision, recall and F1 with 1e-8 in each denominator."""
    g = df.groupBy(*keys).agg(F.sum(tp).alias("tp"), F.sum(fp).alias("fp"), F.sum(fn).alias("fn"))
    p, r = F.col("tp") / (F.col("tp") + F.col("fp") + 1e-8), F.col("tp") / (F.col("tp") + F.col("fn") + 1e-8)
    return g.withColumn("precision", p).withColumn("recall", r).withColumn("f1", 2 * p * r / (p + r + 1e-8))


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Counts and their share of the actual class's row."""
    n = df.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(actual)))


def average_precision(df: DataFrame, keys: list[str], score: str, hit: str) -> DataFrame:
    """Average precision by the sum of recall steps times precision; tied scores make one step."""
    steps = df.groupBy(*keys, score).agg(F.sum(F.col(hit).cast("long")).alias("t"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc())
    every = Window.partitionBy(*keys)
    curve = steps.withColumn("precision", F.sum("t").over(w) / F.sum("n").over(w)).withColumn("all", F.sum("t").over(every))
    return curve.groupBy(*keys).agg(F.sum(F.coalesce(F.col("t") / F.nullif("all", F.lit(0)), F.lit(0.0)) * F.col("precision")).alias("ap"))


def true_positive_errors(df: DataFrame, cls: str, errors: list[str], undefined: list[tuple[str, str]] = ()) -> DataFrame:
    """(cls, errors): mean error of the matched boxes of each class; null for pairs of class and error that are not defined."""
    gone = lambda e: F.col(cls).isin(*(c for c, x in undefined if x == e)) if any(x == e for _, x in undefined) else F.lit(False)
    g = df.groupBy(cls).agg(*(F.avg(e).alias(e) for e in errors))
    return g.select(cls, *(F.when(~gone(e), F.col(e)).alias(e) for e in errors))
