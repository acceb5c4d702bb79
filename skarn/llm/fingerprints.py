"""Document fingerprints by locally consistent parsing.

Each level names the phrases of the level below. Runs of one symbol collapse into a named run, so neighbours differ.
Deterministic coin tossing then turns names into short labels: a symbol's label says at which lowest bit it differs from
its left neighbour, and which value it has there; repeated, labels fall below 6 and neighbours still differ. A phrase
starts at each local maximum of the labels. Where it starts depends on a few neighbours only, so equal substrings are
cut alike besides their ends, whatever their offsets. A phrase's name is a hash of its symbols. Levels follow until one
symbol, the root, names the whole text.

A fingerprint keeps the least name in each of ``BINS`` bins over all phrases of level two and above (one permutation
hashing); the likeness of two fingerprints is the share of equal bins among those that either fills.

Defined results: a null text is empty; an empty text has the empty fingerprint, which is like itself (1) and unlike all
others (0); rows follow each other by descending id, equal ids by descending hash of their texts, null ids last; the
only document is its own next one; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import claim, mix64, pick, slices

BINS, DIGITS, ROUNDS = 64, 6, 4
#: Code points parsed at once; quantiles of the ids that come to the driver.
FLAT_CHARS, QUANTILES = 400_000, 64
#: Rows of a share of the order, about, and shares at most. From 10^8 rows on shares grow instead of their number: they
#: are sorted by Spark, which spills, and read as a stream, so their size bounds no memory.
ROWS_PER_SHARE, MOST_SHARES = 1_000, 100_000
U = np.uint64
_SHAPE = U(0xA0761D6478BD642F)


def _starts(owner: np.ndarray) -> np.ndarray:
    first = np.ones(len(owner), bool)
    first[1:] = owner[1:] != owner[:-1]
    return first


def _named(symbols: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A name for each phrase (from one cut to the next): a hash of its symbols, their places in it and its length."""
    sizes = np.diff(np.append(cuts, len(symbols)))
    place = np.arange(len(symbols)) - np.repeat(cuts, sizes)
    with np.errstate(over="ignore"):
        parts = mix64(symbols + place.astype(U) * _SHAPE)
        return mix64(np.add.reduceat(parts, cuts) + sizes.astype(U))


def _collapsed(symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of a symbol as one; a run longer than one is named by symbol and length."""
    first = _starts(owner)
    first[1:] |= symbols[1:] != symbols[:-1]
    at = np.flatnonzero(first)
    if len(at) == len(symbols):
        return symbols, owner
    sizes = np.diff(np.append(at, len(symbols))).astype(U)
    runs = symbols[at]
    with np.errstate(over="ignore"):
        return np.where(sizes > 1, mix64(runs ^ (sizes * _SHAPE)), runs), owner[at]


def _low_bit(x: np.ndarray) -> np.ndarray:
    """The place of the lowest set bit."""
    with np.errstate(over="ignore"):
        return np.bitwise_count((x & (~x + U(1))) - U(1)).astype(U)


def _phrases(symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Where phrases start: at each document's start and at local maxima of the labels.

    A document's last symbol has no right neighbour, whatever follows it in the array: exceeding its left one is enough.
    """
    first = _starts(owner)
    label = symbols
    for _ in range(ROUNDS):
        before = np.empty_like(label)
        before[1:] = label[:-1]
        before[first] = ~label[first]  # no left neighbour: the lowest bit counts
        bit = _low_bit(label ^ before)
        label = (bit << U(1)) | ((label >> bit) & U(1))
    top = np.zeros(len(label), bool)
    top[1:] = label[1:] > label[:-1]
    top[:-1] &= (label[:-1] >= label[1:]) | first[1:]
    inner = top & ~first
    inner[1:] &= ~first[:-1]  # a first phrase of one symbol would be no phrase
    return np.flatnonzero(first | inner)


def parse(texts: list[str]) -> np.ndarray:
    """The fingerprints' bins, one row a text; 0 marks an empty bin."""
    lengths = np.array([len(t) for t in texts], np.int64)
    sketch = np.full(len(texts) * BINS, np.iinfo(np.uint64).max, U)
    symbols = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(U)
    owner = np.repeat(np.arange(len(texts)), lengths)
    if len(symbols):
        symbols = mix64(symbols)
    level = 0
    while len(symbols):
        symbols, owner = _collapsed(symbols, owner)
        cuts = _phrases(symbols, owner)
        symbols, owner = _named(symbols, cuts), owner[cuts]
        if level:
            np.minimum.at(sketch, owner * BINS + (symbols >> U(58)).astype(np.int64), symbols)
            first = _starts(owner)
            more = ~(first & np.append(first[1:], True))  # a text that has come to its root takes no further part
            symbols, owner = symbols[more], owner[more]
        level += 1
    bins = sketch.reshape(-1, BINS)
    short = (bins & U((1 << 4 * DIGITS) - 1)) | U(0)
    short = np.where(short == 0, U(1), short)
    return np.where(bins == np.iinfo(np.uint64).max, U(0), short)


def fingerprint_text(bins: np.ndarray) -> str:
    """Hexadecimal digits of all bins; the empty fingerprint is the empty string."""
    return "".join(f"{x:0{DIGITS}x}" for x in bins.tolist()) if bins.any() else ""


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row: equal bins among those that either fills; two empty fingerprints are alike."""
    filled = (a != 0) | (b != 0)
    n = filled.sum(axis=1)
    return np.where(n == 0, 1.0, ((a == b) & filled).sum(axis=1) / np.maximum(n, 1))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            texts = [t or "" for t in b.column(1).to_pylist()]
            out = [fingerprint_text(x) for part in _portions(texts) for x in parse(part)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["id", "fingerprint"])

    slim = pick(docs, id=id_col, text=text_col)
    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, fingerprint string")


def _portions(texts: list[str]) -> Iterator[list[str]]:
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t)
        if n >= FLAT_CHARS:
            yield part
            part, n = [], 0
    if part:
        yield part


def _shares(slim: DataFrame) -> tuple[DataFrame, int]:
    """``slim`` (id, text) with its order's columns key and tie, and its share of that order, and the number of shares.

    Shares come from the ids' quantiles: the range between two of them is parted evenly, and an id that several of them
    hit (null, or one that very many rows bear) is parted by its texts' hashes. Shares differ in size, and only that, if
    ids are dense somewhere. What comes to the driver is the quantiles.
    """
    keyed = slim.withColumns({"key": F.coalesce(F.col("id"), F.lit(-(1 << 63))), "tie": F.xxhash64("text")})
    n = keyed.count()
    marks = Counter(int(m) for m in keyed.approxQuantile("key", [k / QUANTILES for k in range(QUANTILES + 1)], 0.001)) if n else Counter()
    marks.setdefault(-(1 << 63), 1)
    parts = -(-min(MOST_SHARES, -(-n // ROWS_PER_SHARE)) // QUANTILES) or 1
    # by mark: its least key, shares of that key alone (0: none), and of what lies between it and the next mark
    lows = sorted(marks)
    points = [(marks[m] - 1) * parts for m in lows]
    bases = [sum(points[:i]) + i * parts for i in range(len(lows))]
    place = lambda values: F.get(F.array(*(F.lit(v).cast("long") for v in values)), F.col("_q"))
    at = F.greatest(F.size(F.filter(F.array(*(F.lit(m).cast("long") for m in lows)), lambda m: m <= F.col("key"))) - 1, F.lit(0))
    lo, hi, own = (place(v) for v in (lows, [*lows[1:], lows[-1]], points))
    share_of = lambda x, k: F.least(F.greatest(F.floor(x * k), F.lit(0)), k - 1)
    linear = (F.col("key").cast("double") - lo.cast("double")) / F.greatest(hi.cast("double") - lo.cast("double"), F.lit(1.0))
    hashed = F.col("tie").cast("double") / F.lit(2.0**64) + 0.5
    within = F.when((own > 0) & (F.col("key") == lo), share_of(hashed, own)).otherwise(own + share_of(linear, F.lit(parts)))
    total = bases[-1] + points[-1] + parts
    shared = keyed.withColumn("_q", at).withColumn("share", (F.lit(total - 1) - place(bases) - within).cast("int")).drop("_q")
    return shared, total


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, share, peek): every document, and behind each share the row that follows it, for one sorted pass.

    A row that is the first of its share also goes, as a peek, to the share in front of it, and the very first to the last.
    Those are told by one key and tie a share, MOST_SHARES and QUANTILES times as many at most, which are broadcast.
    """
    slim = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    shared, total = _shares(slim)
    heads = sorted(tuple(r) for r in shared.groupBy("share").agg(F.max(F.struct("key", "tie")).alias("head")).select("share", "head.key", "head.tie").collect())
    to = [(key, tie, heads[k - 1][0]) for k, (_, key, tie) in enumerate(heads)]
    fronts = docs.sparkSession.createDataFrame(pd.DataFrame(to, columns=["_key", "_tie", "to"]), "_key long, _tie long, to int")
    known = shared.join(F.broadcast(fronts), (shared["key"] == fronts["_key"]) & (shared["tie"] == fronts["_tie"]), "left")
    own = F.struct(F.col("share"), F.lit(False).alias("peek"))
    both = F.array_compact(F.array(own, F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("share"), F.lit(True).alias("peek")))))
    dealt = known.select("id", "text", "key", "tie", F.explode(both).alias("at")).select("id", "text", "key", "tie", "at.share", "at.peek")
    sent = dealt.repartitionById(total, "share").sortWithinPartitions("share", "peek", F.col("key").desc(), F.col("tie").desc(), "text")
    return sent.select("id", "text", "share", "peek")


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every document: its fingerprint, that of its edited text, and the likeness to that and to the next document's.

    (id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next). The next document is the one of the
    next smaller id, the first after the last. edited: the last floor(n / 2) code points replaced by as many first ones
    of the next document, or by all it has.
    """

    def made(ids: list, texts: list[str], follow: str) -> Iterator[pa.RecordBatch]:
        at = 0
        for part in _portions(texts):
            after = [*part[1:], texts[at + len(part)] if at + len(part) < len(texts) else follow]
            edited = [t[: len(t) - len(t) // 2] + a[: len(t) // 2] for t, a in zip(part, after, strict=True)]
            own, new = parse([*part, after[-1]]), parse(edited)
            columns = {
                "id": pa.array(ids[at : at + len(part)], pa.int64()),
                "n_chars": pa.array([len(t) for t in part], pa.int64()),
                "edited": pa.array(edited, pa.string()),
                "fingerprint": pa.array([fingerprint_text(x) for x in own[:-1]], pa.string()),
                "edited_fingerprint": pa.array([fingerprint_text(x) for x in new], pa.string()),
                "near_edited": pa.array(likeness(own[:-1], new), pa.float64()),
                "near_next": pa.array(likeness(own[:-1], own[1:]), pa.float64()),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
            at += len(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("fingerprints")
        share, ids, texts, closed, n = None, [], [], False, 0
        for b in slices(batches, 1):
            for i, text, s, peek in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if s != share:
                    share, ids, texts, closed, n = s, [], [], False, 0
                if closed:
                    continue
                if peek:
                    closed = True
                    yield from made(ids, texts, text)
                    ids, texts, n = [], [], 0
                    continue
                if n >= FLAT_CHARS:
                    yield from made(ids, texts, text)
                    ids, texts, n = [], [], 0
                ids.append(i)
                texts.append(text)
                n += len(text)

    return with_next(docs, id_col, text_col).mapInArrow(
        run, "id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


