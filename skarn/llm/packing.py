"""Best-fit packing of token pieces into sequences by exact-complement hashing.

Packing needs the pieces' lengths only, so the plan is made on the histogram of lengths: at most ``capacity`` counts,
whatever the table's size. An index holds the sums of one, two and three available lengths. For each length, from the
largest, the gap it leaves is looked up there; a combination that fills it exactly is used as often as its counts last. What finds no
exact complement is packed best fit, largest first, again by counts. The plan is a list of patterns with a number of
times each; a piece finds its sequence by its rank among the pieces of its length.

Defined results: a null or empty text is one piece of the end token alone; only documents longer than the capacity are
cut; repeated rows are packed each; a null id stays null; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skarn.llm.bpe import read_definition
from skarn.llm.common import claim, materialise, pick, slices

CAPACITY, END_ID = 4096, 1
#: Distinct white-space-separated strings a worker remembers, and documents it holds at once.
REMEMBERED, TEXTS_AT_ONCE = 700_000, 400
#: Marks that stand behind words; a run of them is a pre-token of its own.
MARKS = ".,;:!?#*$%&"
#: Pieces that one task ranks, about.
RANKED_TOGETHER = 1_000_000


# --- tokens ---------------------------------------------------------------------------------------------------------


def _latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _letters(word: str) -> bool:
    """Letters only, in lower case too: some letters become a letter and a mark."""
    return word.isalpha() and word.lower().isalpha()


class WordTokenizer:
    """The tokenizers library behind a memory of strings between blanks.

    Only for definitions whose pre-tokenizer drops white space, as then text may be cut at any blank or line end. Where
    all characters are Latin-1 and no special token can occur, lower case is taken first, so that more strings meet; the
    library would do it anyway.
    """

    def __init__(self, definition: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.lowers = self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str("A") == "a"
        ends = [t for t in self.tokenizer.get_vocab().items() if t[0].endswith("</w>")]
        self.is_end = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.is_end[[i for _, i in ends]] = True
        self.known: dict[str, bytes] = {}

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of strings of letters, as one text: each is one pre-token, whose last token is marked as a word's end."""
        flat = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self.is_end[flat]) + 1
        if len(ends) == len(words):
            data, cuts = flat.tobytes(), [0, *(4 * ends).tolist()]
            return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return self._one_by_one(words)

    def _one_by_one(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, new: set[str]) -> None:
        """Letters with marks after them are two pre-tokens, letters and marks; only the letters are likely new."""
        stems = {c: c.rstrip(MARKS) for c in new}
        plain = [s for s in {*stems.values()} if _letters(s) and s not in self.known]
        for at in range(0, len(plain), 20_000):
            part = plain[at : at + 20_000]
            self.known.update(zip(part, self._ids(part), strict=True))
        left = [c for c in new if c not in self.known]
        both = {c: (s, c[len(s) :]) for c in left if _letters(s := stems[c])}
        rest = [c for c in left if c not in both]
        rest += {m for _, m in both.values()}.difference(self.known, rest)
        self.known.update(zip(rest, self._one_by_one(rest), strict=True))
        self.known.update((c, self.known[s] + self.known[m]) for c, (s, m) in both.items())

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cut = []
        for t in texts:
            t = t or ""
            if self.lowers and "<|" not in t and _latin(t):
                t = t.lower()
            cut.append(t.replace("\n", " ").split(" "))
        new = {c for x in cut for c in set(x).difference(self.known)}
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = {c for x in cut for c in x}
        self._learn(new)
        get = self.known.__getitem__
        return [b"".join(map(get, x)) for x in cut]


_tokenizers: dict[int, WordTokenizer] = {}


def _tokenizer(definition: str) -> WordTokenizer:
    key = zlib.crc32(definition.encode())
    if key not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[key] = WordTokenizer(definition)
    return _tokenizers[key]


def pieces(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): every document's tokens and end token, cut where longer than the capacity."""
    shipped = docs.sparkSession.sparkContext.broadcast(read_definition(path))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("packing", _tokenizers.clear)
        tokenizer = _tokenizer(shipped.value)
        for part in slices(batches, 1, TEXTS_AT_ONCE):
            row, piece, data = [], [], []
            for k, ids in enumerate(tokenizer.encode(part.column(1).to_pylist())):
                ids += end
                for n, lo in enumerate(range(0, len(ids), 4 * capacity)):
                    row.append(k)
                    piece.append(n)
                    data.append(ids[lo : lo + 4 * capacity])
            columns = {
                "id": part.column(0).take(pa.array(row, pa.int64())),
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array([n * capacity for n in piece], pa.int64()),
                "length": pa.array([len(d) // 4 for d in data], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(d) for d in data], pa.int64()),
            }
            if with_ids:
                columns["ids"] = pa.array([np.frombuffer(d, "<u4").astype(np.int64) for d in data], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    slim = pick(docs, id=id_col, text=text_col)
    made = f"id {slim.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return slim.mapInArrow(run, made + ", ids array<long>" * with_ids)


# --- the plan -------------------------------------------------------------------------------------------------------


class ComplementIndex:
    """The sums of one, two and three available lengths, for looking up what fills a gap exactly.

    Single sums are the counts themselves. Pairs are held by their sum, the largest first part in front; a triple's sum
    is a length and the sum of a pair. Lengths only run out, so what can no longer be had is passed once and for all.
    """

    def __init__(self, counts: list[int]) -> None:
        self.free, self.have = counts, np.array(counts) > 0
        have, n = np.flatnonzero(self.have).astype(np.int32), len(counts)
        small = [(a, have[(have <= a) & (have <= n - 1 - a)]) for a in have.tolist()]
        second = np.concatenate([b for _, b in small]) if small else have
        first = np.repeat(have, [len(b) for _, b in small])
        order = np.lexsort((-first, first + second))
        sums = (first + second)[order]
        self.first = array("i", first[order].astype("i").tobytes())
        self.at, self.end = (np.searchsorted(sums, np.arange(n), side=side).tolist() for side in ("left", "right"))
        self.alive = np.array(self.at) < np.array(self.end)  # by sum: whether a pair may still be had
        self.triple_at: dict[int, int] = {}  # by sum: no larger first part of a triple is left

    def use(self, need: dict[int, int], times: int) -> None:
        for x, n in need.items():
            self.free[x] -= n * times
            self.have[x] = self.free[x] > 0

    def pair(self, total: int, taken: tuple[int, ...] = ()) -> tuple[int, int] | None:
        """The pair of this sum with the largest first part, besides the lengths already taken."""
        free, first = self.free, self.first
        k, end, passing = self.at[total], self.end[total], True
        while k < end:
            a = first[k]
            b = total - a
            if free[a] > 0 and free[b] > (a == b):
                passing = False
                if free[a] - taken.count(a) > 0 and free[b] - taken.count(b) > (a == b):
                    return a, b
            elif passing:
                self.at[total] = k + 1
            k += 1
        if self.at[total] >= end:
            self.alive[total] = False
        return None

    def complement(self, gap: int, taken: int) -> tuple[int, ...] | None:
        """One, two or three lengths that fill the gap exactly besides the one taken; the fewest and the largest first."""
        free = self.free
        if free[gap] > (gap == taken):
            return (gap,)
        if gap < 2:
            return None
        if self.alive[gap] and (found := self.pair(gap, (taken,))):
            return found
        top = self.triple_at.get(gap, gap - 2)
        parts = np.arange(top, 0, -1)
        passing = True
        for a in parts[self.have[parts] & self.alive[gap - parts]].tolist():
            if free[a] > (a == taken) and (rest := self.pair(gap - a, (taken, a))):
                return a, *rest
            if passing and not self.alive[gap - a]:
                self.triple_at[gap] = a - 1
            else:
                passing = False
        return None


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in one sequence, how many sequences) that use every length as often as ``counts`` says."""
    free = [*map(int, counts), *[0] * (capacity + 1 - len(counts))]
    patterns: list[tuple[tuple[int, ...], int]] = []
    index = ComplementIndex(free)
    rest = np.zeros(capacity + 1, np.int64)
    for length in range(capacity, 0, -1):
        while free[length] > 0:
            gap = capacity - length
            found = index.complement(gap, length) if gap else ()
            if found is None:  # no exact complement: best fit takes it
                rest[length] = free[length]
                index.use({length: 1}, free[length])
                break
            need = Counter((length, *found))
            times = min(free[x] // n for x, n in need.items())
            index.use(need, times)
            patterns.append(((length, *found), times))
    # best fit, largest first; open sequences of one content count together
    gaps: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length in range(capacity, 0, -1):
        left = int(rest[length])
        while left:
            gap = min((g for g in gaps if g >= length), default=0)
            if gap:
                held, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
            else:
                held, n, gap = (), -(-left // (capacity // length)), capacity
            each = min(gap // length, max(1, left // n))
            take = min(n, left // each)
            if take < n and held:
                gaps[gap].append((held, n - take))
            gaps[gap - each * length].append((held + (length,) * each, take))
            left -= each * take
    patterns += [x for g in gaps.values() for x in g]
    return patterns


# --- from the plan to the pieces ------------------------------------------------------------------------------------


def _lookup(patterns: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[int, dict[str, np.ndarray]]:
    """For each length the runs of ranks: where a run starts, its slots a sequence, first sequence, and the slots' offsets."""
    runs: dict[int, list[tuple[int, int, int, list[int]]]] = defaultdict(list)
    given: dict[int, int] = defaultdict(int)
    base = 0
    for lengths, times in patterns:
        offsets: dict[int, list[int]] = defaultdict(list)
        at = 0
        for x in lengths:
            offsets[x].append(at)
            at += x
        for x, where in offsets.items():
            runs[x].append((given[x], len(where), base, where))
            given[x] += len(where) * times
        base += times
    out = {}
    for x, rows in runs.items():
        slots = np.array([r[1] for r in rows], np.int64)
        out[x] = {
            "start": np.array([r[0] for r in rows], np.int64),
            "slots": slots,
            "base": np.array([r[2] for r in rows], np.int64),
            "first": np.cumsum(slots) - slots,
            "offsets": np.array([o for r in rows for o in r[3]], np.int64),
        }
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (id, piece, length and more) with sequence_id and offset. ``cut`` is read three times: give a written table."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["n"]
    shipped = cut.sparkSession.sparkContext.broadcast(_lookup(plan(counts, capacity), capacity))
    # a length that many pieces share is ranked in several shares, one after the other
    shares = max(16, int(counts.sum() // RANKED_TOGETHER))
    dealt = cut.withColumn("share", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(shares)))
    sizes = dealt.groupBy("length", "share").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("share")) - F.col("n")).drop("n")
    own = Window.partitionBy("length", "share").orderBy("id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(own)).join(before, ["length", "share"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before") - 1).select(*cut.columns, "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shipped.value
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(at):
                    r = runs[int(length[at[0]])]
                    k = np.searchsorted(r["start"], rank[at], side="right") - 1
                    copy, slot = np.divmod(rank[at] - r["start"][k], r["slots"][k])
                    sequence[at], offset[at] = r["base"][k] + copy, r["offsets"][r["first"][k] + slot]
            kept = [b.column(i) for i, f in enumerate(b.schema) if f.name != "rank"]
            names = [f.name for f in b.schema if f.name != "rank"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """Tokenised, cut and packed: id, piece, start, length, ids_crc32[, ids], sequence_id, offset."""
    return pack(materialise(pieces(docs, path, id_col, text_col, capacity, end_id, with_ids), "pieces"), capacity)
