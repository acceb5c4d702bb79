"""Removal of repeated passages: Rabin-Karp hashes of every fixed-length word window, dealt by Spark and counted by deal.

Every window of ``width`` words of every document gets two 64-bit polynomial hashes (mod 2^64, of different bases, over
the halves of the words' 128-bit XXH3; a mixer last). The windows are dealt by the second hash's top bits as packed
arrays: about eleven bytes a window cross the network and no row per window exists. Each deal finds the windows that a
smaller document also holds and answers, dealt by document, with the windows to remove; the document's pass hashes its
windows anew, marks those, and merges them into maximal intervals of words.

Before the exchange each batch settles its own repeats by all 128 bits: a window goes to its deal once, for the smallest
document of the batch that holds it, and the others' losses go as finished answers dealt by document. So a window that a
third of all documents share costs its deal one entry a batch, not one a document.

Deals grow in number with the table, and a batch's windows for one deal would shrink to single rows. So from FAN deals on,
windows first go to FAN coarse deals, as runs of deals; there a task goes through its rows in order, settles and packs again
what REDEALT_WINDOWS windows hold for each deal, and sends that on. What a task holds does not grow with the table, a window
costs some fifteen bytes in either exchange, and the results are the same.

A deal and an answer tell windows apart by 80 bits besides the deal's own: two of N different windows meet in D deals with
a probability of N^2 / (D 2^81) at most, below 10^-5 for the 10^13 windows and 10^7 deals of 100 TB.

Documents are dealt by a hash of their id. Rows without an id, and those of an id that more rows bear than a deal has
documents, are spread by their texts too; their windows carry the row's own hash, and are asked for by each row.

Defined results: a null or blank text has no words; a document shorter than the window keeps all; windows of one document
never count against itself, nor do rows with the same id against each other; rows with a null id never remove anything
and lose what any named document holds; an empty table gives an empty table; other columns are ignored, and one that
bears the result's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from skarn.llm.common import claim, free_name, mix64, slices

WIDTH = 50
#: Documents, and bytes of text, a deal. Deals grow in number with the table, not in size.
DOCS_PER_DEAL, BYTES_PER_DEAL = 2_500, 8_000_000
#: Deals that batches are packed for directly; beyond, coarse deals come first, whose windows are packed again so many at once.
FAN, REDEALT_WINDOWS = 1_024, 1_000_000
#: Words hashed at once, and distinct words remembered by a worker.
FLAT_WORDS, MEMORY_WORDS = 300_000, 300_000
#: Ids of very many rows up to this number go to every executor; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: The polynomials' bases, any odd numbers.
BASES = 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93
#: Stands for a null id: larger than all.
LAST_ID = np.iinfo(np.int64).max
#: What travels of a window: the first hash and two bytes of the second.
WINDOW = np.dtype([("a", "<u8"), ("b", "<u2")])
#: What travels of a window to a coarse deal: also which of its deals it is for.
COARSE = np.dtype([("a", "<u8"), ("b", "<u2"), ("sub", "<u2")])


class _WordHash(dict):
    """Word to its 128-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= MEMORY_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_128_digest(word)
        return value


class _Powers:
    """Powers of a base and of its inverse mod 2^64, as long as was needed so far."""

    def __init__(self, base: int) -> None:
        self.base, self.up, self.down = base, np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            steps = np.full(n + 1, self.base, np.uint64), np.full(n + 1, pow(self.base, -1, 1 << 64), np.uint64)
            for s in steps:
                s[0] = 1
            with np.errstate(over="ignore"):
                self.up, self.down = np.multiply.accumulate(steps[0]), np.multiply.accumulate(steps[1])
        return self.up, self.down


_words, _powers = _WordHash(), [_Powers(b) for b in BASES]


def window_hashes(texts: list[str | None], width: int = WIDTH) -> Iterator[tuple[list[list[bytes]], tuple[np.ndarray, np.ndarray], np.ndarray]]:
    """In runs of texts: their words, the windows' two hashes in order, and each text's number of windows."""
    i = 0
    while i < len(texts):
        words, n = [], 0
        while i < len(texts) and (n < FLAT_WORDS or not words):
            words.append((texts[i] or "").encode().split())
            n += len(words[-1])
            i += 1
        flat = np.frombuffer(b"".join(h for w in words for h in map(_words.__getitem__, w)), np.uint64).reshape(-1, 2)
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        windows = np.maximum(lengths - width + 1, 0)
        at = np.repeat(np.cumsum(lengths) - lengths, windows) + _ranges(windows)
        both = []
        for k, powers in enumerate(_powers):
            up, down = powers.of(n + width)
            with np.errstate(over="ignore"):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(flat[:, k] * down[:n], dtype=np.uint64)])
                both.append(mix64((sums[at + width] - sums[at]) * up[at + width - 1]))
        yield words, (both[0], both[1]), windows


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after the other."""
    return np.arange(int(counts.sum()), dtype=np.int64) - np.repeat(np.cumsum(counts) - counts, counts)


def _deal(second: np.ndarray, deals: int) -> np.ndarray:
    """The deal of a window: its second hash's top 32 bits scaled to 0..deals-1."""
    return ((second >> np.uint64(32)) * np.uint64(deals) >> np.uint64(32)).astype(np.int64)


def _packed_windows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), WINDOW)
    out["a"], out["b"] = a, b.astype(np.uint16)
    return out


def hash_ids(ids: np.ndarray) -> np.ndarray:
    """XXH64 of each 64-bit integer under seed 42, as the function xxhash64 of Spark has it."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    with np.errstate(over="ignore"):
        h = np.uint64(42) + p5 + np.uint64(8)
        h = turn((turn(ids.astype(np.int64).view(np.uint64) * p2, 31) * p1) ^ h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _small(x: np.ndarray) -> bytes:
    """Integers in as few bytes each as the largest of them needs, behind one byte that says how many."""
    most = int(np.abs(x).max()) if len(x) else 0
    kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if most <= np.iinfo(k).max)
    return np.dtype(kind).itemsize.to_bytes(1, "little") + x.astype(kind).tobytes()


def _wide(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<i{blob[0]}", offset=1).astype(np.int64)


def _steps(ids: np.ndarray) -> bytes:
    """Ascending ids: the first, and the steps to the others where those do not exceed a signed 64-bit integer."""
    steps = np.diff(ids)
    if len(steps) and (steps < 0).any():
        return b"\0" + ids.astype("<i8").tobytes()
    return b"\1" + int(ids[0]).to_bytes(8, "little", signed=True) + _small(steps)


def _ids_of(blob: bytes) -> np.ndarray:
    if blob[0] == 0:
        return np.frombuffer(blob, "<i8", offset=1)
    return np.cumsum(np.append(np.frombuffer(blob, "<i8", count=1, offset=1), _wide(blob[9:])))


def _settled(a: np.ndarray, b: np.ndarray, ids: np.ndarray, owners: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of windows and their documents: what to ask for (each window for its smallest id, and there once, or once an owner
    that is not 0), and what is lost, as places in the arrays."""
    order = np.argsort(a)
    same = a[order[1:]] == a[order[:-1]]
    if (same & (b[order[1:]] != b[order[:-1]])).any():  # the first hashes of two different windows meet
        order = np.lexsort((b, a))
        same = (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]])
    first = np.flatnonzero(np.append(True, ~same)) if len(a) else np.zeros(0, np.int64)
    mine = ids[order]
    least = np.minimum.reduceat(mine, first) if len(first) else mine
    lost = mine > np.repeat(least, np.diff(np.append(first, len(a))))
    run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(a))))
    at = np.flatnonzero(~lost)
    own = owners[order[at]] if owners is not None else np.zeros(len(at), np.int64)
    if own.any():
        by = np.lexsort((own, run[at]))
        at, own = at[by], own[by]
        once = np.append(True, (run[at[1:]] != run[at[:-1]]) | (own[1:] != own[:-1]))
    else:
        once = np.append(True, run[at[1:]] != run[at[:-1]])[: len(at)]
    return order[at[once]], order[lost]


def _rows(windows: np.ndarray, ids: np.ndarray, owners: np.ndarray, deal: np.ndarray) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
    """One row a deal: its windows by ascending id and owner, the ids, the owners where there are any, and how many windows each has."""
    by = np.lexsort((owners, ids, deal)) if owners.any() else np.lexsort((ids, deal))
    windows, ids, owners, deal = windows[by], ids[by], owners[by], deal[by]
    cuts = [*np.flatnonzero(np.diff(deal, prepend=-1)).tolist(), len(deal)]
    for lo, hi in pairwise(cuts):
        i, o = ids[lo:hi], owners[lo:hi]
        runs = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (o[1:] != o[:-1])))
        whose = o[runs]
        yield int(deal[lo]), windows[lo:hi].tobytes(), _steps(i[runs]), whose.tobytes() if whose.any() else b"", _small(np.diff(np.append(runs, hi - lo)))


def _unpacked(windows: list[bytes], ids: list[bytes], owners: list[bytes], counts: list[bytes], kind: np.dtype = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of several rows, and the id and owner of each."""
    sizes, whose = [_wide(c) for c in counts], [_ids_of(i) for i in ids]
    held = [np.frombuffer(o, np.int64) if o else np.zeros(len(i), np.int64) for o, i in zip(owners, whose, strict=True)]
    times = np.concatenate(sizes)
    return np.frombuffer(b"".join(windows), kind), np.repeat(np.concatenate(whose), times), np.repeat(np.concatenate(held), times)


def _doc_deal(ids: np.ndarray, owners: np.ndarray, deals: int) -> np.ndarray:
    """Where a document is dealt: by the hash of its id, or by its owner's where it has one (never 0)."""
    return np.mod(np.where(owners != 0, owners, hash_ids(ids)), deals)


#: What travels to the deals; done: losses that a batch has settled already.
PACKED = pa.schema([("done", pa.bool_()), ("deal", pa.int32()), ("windows", pa.binary()), ("ids", pa.binary()), ("owners", pa.binary()), ("counts", pa.binary())])


def _batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), PACKED.types, strict=True)], schema=PACKED)


def _run(deals: int, fan: int) -> int:
    """How many deals a coarse deal stands for; 1 where windows go to their deals directly."""
    return 1 if deals <= fan else -(-deals // fan)


def _packed(deals: int, width: int, fan: int = FAN):
    """Arrow batches of (id, text, owner) to one row for each deal, or coarse deal: windows, and whose they are."""
    run_of = _run(deals, fan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("substrings", _words.clear)
        for part in slices(batches, 1):
            ids, all_owners, done = _ids(part.column(0)), part.column(2).to_numpy(zero_copy_only=False), 0
            for _, (a, b), windows in window_hashes(part.column(1).to_pylist(), width):
                doc, own = (np.repeat(x[done : done + len(windows)], windows) for x in (ids, all_owners))
                done += len(windows)
                if not len(a):
                    continue
                asked, lost = _settled(a, b, doc, own)
                fine = _deal(b[asked], deals)
                wanted = _packed_windows(a[asked], b[asked])
                if run_of > 1:
                    marked = np.empty(len(asked), COARSE)
                    marked["a"], marked["b"], marked["sub"] = wanted["a"], wanted["b"], fine % run_of
                    wanted = marked
                out = [(False, *x) for x in _rows(wanted, doc[asked], own[asked], fine // run_of)]
                out += [(True, *x) for x in _rows(_packed_windows(a[lost], b[lost]), doc[lost], own[lost], _doc_deal(doc[lost], own[lost], deals) // run_of)]
                yield _batch(out)

    return run


def _redealt(deals: int, fan: int = FAN):
    """Rows of coarse deals, in order of these, to rows of deals: what some million windows hold is settled and packed together."""
    run_of = _run(deals, fan)

    def packed(settled: bool, coarse: int, rows: list[tuple]) -> Iterator[tuple]:
        columns = [list(c) for c in zip(*rows, strict=True)]
        if settled:
            w, doc, own = _unpacked(*columns)
            lost = w, doc, own
        else:
            w, doc, own = _unpacked(*columns, kind=COARSE)
            second = w["b"].astype(np.uint32) | w["sub"].astype(np.uint32) << np.uint32(16)
            asked, gone = _settled(w["a"], second, doc, own)
            yield from ((False, *x) for x in _rows(_packed_windows(w["a"][asked], w["b"][asked]), doc[asked], own[asked], coarse * run_of + w["sub"][asked].astype(np.int64)))
            lost = _packed_windows(w["a"][gone], w["b"][gone]), doc[gone], own[gone]
        if len(lost[0]):
            yield from ((True, *x) for x in _rows(*lost, _doc_deal(lost[1], lost[2], deals)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("substrings")
        at, held, n = None, [], 0
        for b in batches:
            for settled, coarse, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (at != (settled, coarse) or n >= REDEALT_WINDOWS):
                    yield from _batches(packed(*at, held))
                    held, n = [], 0
                at = settled, coarse
                held.append(row)
                n += len(row[0]) // (WINDOW if settled else COARSE).itemsize
        if held:
            yield from _batches(packed(*at, held))

    return run


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    out = list(rows)
    if out:
        yield _batch(out)


def _answers(doc_deals: int):
    """One deal's packed rows to (doc_deal, windows, ids, owners, counts): what each document must lose."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpacked(*(x[c].tolist() for c in ("windows", "ids", "owners", "counts"))) for _, x in pdf.groupby("done") if len(x)]
        done = [x for x, (settled, _) in zip(parts, pdf.groupby("done"), strict=True) if settled]
        asked = [x for x, (settled, _) in zip(parts, pdf.groupby("done"), strict=True) if not settled]
        for w, doc, own in asked:
            _, lost = _settled(w["a"], w["b"], doc)
            done.append((w[lost], doc[lost], own[lost]))
        w, doc, own = (np.concatenate(x) for x in zip(*done, strict=True))
        return pd.DataFrame(list(_rows(w, doc, own, _doc_deal(doc, own, doc_deals))), columns=["doc_deal", "windows", "ids", "owners", "counts"])

    return run


def _cover(marked: np.ndarray, n_words: int, width: int) -> np.ndarray:
    """Which words the marked windows cover: the union of their intervals."""
    edge = np.zeros(n_words + 1, np.int64)
    starts = np.flatnonzero(marked)
    edge[starts] += 1
    np.subtract.at(edge, starts + width, 1)
    return np.cumsum(edge[:-1]) > 0


def _ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(LAST_ID).to_numpy(**({} if isinstance(column, pa.ChunkedArray) else {"zero_copy_only": False})).astype(np.int64)


def _found(own: np.ndarray, lost: np.ndarray) -> np.ndarray:
    """Which windows are among the lost ones."""
    lost = np.unique(lost)  # in order of the first hash, then of the second
    lo, hi = (np.searchsorted(lost["a"], own["a"], side=side) for side in ("left", "right"))
    out = np.zeros(len(own), bool)
    for k in range(int((hi - lo).max(initial=0))):
        at = np.minimum(lo + k, len(lost) - 1)
        out |= (lo + k < hi) & (lost["b"][at] == own["b"])
    return out


def _with_owners(docs: DataFrame, id_col: str, text_col: str, docs_per_deal: int, name: str) -> DataFrame:
    """``docs`` with the row's own hash where its id is null or borne by more rows than a deal has documents; else 0."""
    key = F.col(f"`{id_col}`")
    frequent = docs.groupBy(key.cast("long").alias("_id")).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > docs_per_deal) & F.col("_id").isNotNull()).select("_id")
    n = frequent.limit(BROADCAST_IDS + 1).count()
    spread = key.isNull()
    if n:
        many = frequent.withColumn("_many", F.lit(True)).withColumnsRenamed({"_id": f"{name}_id", "_many": f"{name}_many"})
        docs = docs.join(F.broadcast(many) if n <= BROADCAST_IDS else many, key.cast("long") == many[f"{name}_id"], "left")
        spread = spread | F.col(f"{name}_many").isNotNull()
    own = F.xxhash64(key, F.col(f"`{text_col}`"))
    return docs.withColumn(name, F.when(spread, F.when(own == 0, F.lit(1)).otherwise(own)).otherwise(F.lit(0)).cast("long")).drop(f"{name}_id", f"{name}_many")


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, docs_per_deal: int = DOCS_PER_DEAL, result: str = "repeats"
) -> DataFrame:
    """The rows of ``docs`` with one more column, the struct ``result``: n_words, n_removed, kept, spans.

    kept: the kept words joined by one space. spans: the maximal removed intervals as [first word, first word after].
    """
    docs = docs.drop(result)
    owner, by = free_name(docs, "row_hash"), free_name(docs, "doc_deal")
    owned = _with_owners(docs, id_col, text_col, docs_per_deal, owner)
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(F.col(f"`{text_col}`"))), F.lit(0)).alias("bytes")).first()
    deals = max(16, -(-size["n"] // docs_per_deal), size["bytes"] // BYTES_PER_DEAL)
    slim = owned.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(owner).alias("owner"))
    kinds = "done boolean, deal int, windows binary, ids binary, owners binary, counts binary"
    packed = slim.mapInArrow(_packed(deals, width, FAN), kinds)
    if _run(deals, FAN) > 1:
        packed = packed.repartition(FAN, "deal").sortWithinPartitions("deal", "done").mapInArrow(_redealt(deals, FAN), kinds)
    answers = packed.groupBy("deal").applyInPandas(_answers(deals), "doc_deal int, windows binary, ids binary, owners binary, counts binary")
    key = F.when(F.col(owner) != 0, F.col(owner)).otherwise(F.xxhash64(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST_ID))))
    dealt = owned.withColumn(by, F.pmod(key, F.lit(deals)).cast("int"))
    made = T.StructType(
        [
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept", T.StringType()),
            T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
        ]
    )
    kind = to_arrow_type(made)
    columns = list(docs.columns)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        claim("substrings", _words.clear)
        lost: dict[tuple[int, int], list[np.ndarray]] = {}
        for row in zip(*(right.column(c).to_pylist() for c in ("windows", "ids", "owners", "counts")), strict=True):
            w, doc, own = _unpacked(*([x] for x in row))
            cuts = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (own[1:] != own[:-1])))
            for at, part in zip(cuts.tolist(), np.split(w, cuts[1:]), strict=True):
                lost.setdefault((int(doc[at]), int(own[at])), []).append(part)
        ids, owners = _ids(left.column(id_col).cast(pa.int64())).tolist(), left.column(owner).to_pylist()
        out, done = [], 0
        for words, (a, b), windows in window_hashes(left.column(text_col).to_pylist(), width):
            ends = np.cumsum(windows)
            for k, w in enumerate(words):
                gone, spans, kept = lost.get((ids[done + k], owners[done + k])), [], w
                if gone is not None and windows[k]:
                    at = slice(ends[k] - windows[k], ends[k])
                    covered = _cover(_found(_packed_windows(a[at], b[at]), np.concatenate(gone)), len(w), width)
                    spans = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))).reshape(-1, 2).tolist()
                    kept = [x for x, hit in zip(w, covered.tolist(), strict=True) if not hit]
                out.append({"n_words": len(w), "n_removed": len(w) - len(kept), "kept": b" ".join(kept).decode(), "spans": spans})
            done += len(words)
        return left.select(columns).append_column(result, pa.chunked_array([pa.array(out, kind)]))

    schema = T.StructType([*docs.schema.fields, T.StructField(result, made)])
    return dealt.groupBy(by).cogroup(answers.groupBy("doc_deal")).applyInArrow(finish, schema)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents, columns and all, with the repeats cut from their texts.

    A text that loses nothing stays as it is, white space included; one that loses all stays as an empty text.
    """
    name = free_name(docs, "repeats")
    cut = remove_repeats(docs, id_col, text_col, result=name, **how)
    text = F.when(F.col(f"{name}.n_removed") > 0, F.col(f"{name}.kept")).otherwise(F.col(text_col))
    return cut.select(*(text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
