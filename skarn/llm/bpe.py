"""Byte-level BPE encoding and decoding: speculate and verify.

A word that the worker has not met yet is cut greedily into the longest tokens. The cut is the merge procedure's own
result if and only if every adjacent token pair is compatible, that is, if no merge across the boundary could have come
before the merges that made the two tokens. All boundaries of all new words of a batch are tested together with numpy;
only words with a failing pair are merged one merge at a time. Decoding gathers the tokens' bytes.

Defined results: a null or empty text has no tokens and decodes to an empty text; the strings of special tokens in a
text become those tokens; repeated rows give repeated rows; a null id stays null; an empty table gives an empty table;
other columns are ignored. Memory: a worker remembers a bounded number of words between batches; a batch with more is
halved down to single texts, and one text's own words are all held while it is encoded, however many they are.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from skarn.llm.common import claim, pick, slices

#: The published pattern that splits text in front of byte-level merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space besides the blank and the line feed.
RARE_SPACE = regex.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
REMEMBERED, TEXTS_AT_ONCE, WORDS_AT_ONCE = 700_000, 400, 200_000
NEVER = np.int64(1) << 40


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte: itself if printable in Latin-1, else the next code point from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBPE:
    """Encoder and decoder of one byte-level vocabulary in the tokenizers library's file format."""

    def __init__(self, definition: str) -> None:
        spec, letters = json.loads(definition), byte_alphabet()
        vocab = spec["model"]["vocab"]
        to_bytes = {t: bytes(letters[c] for c in t) for t in vocab if all(c in letters for c in t)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for t, b in to_bytes.items():
            self.bytes[vocab[t]] = b
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.base = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.rank = np.full(size, -1, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        twice = set()
        for k, (a, b) in enumerate(pairs):
            a, b, made = vocab[a], vocab[b], vocab[a + b]
            if (a, b) in self.merges:
                continue
            self.merges[a, b] = (k, made)
            if self.rank[made] >= 0:
                twice.add(made)
            else:
                self.left[made], self.right[made], self.rank[made] = a, b, k
        keys = np.array([a << 32 | b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in self.merges.values()], np.int64)[order]
        self._proposals(twice)
        lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.split = regex.compile(SPLIT)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _proposals(self, twice: set[int]) -> None:
        """The tokens that greedy matching may propose: those that the merge procedure makes of their own bytes."""
        made = np.flatnonzero(self.rank >= 0)
        fine = np.ones(len(self.rank), bool)
        fine[made] = self.compatible(self.left[made], self.right[made], inside=True)
        fine[list(twice)] = False
        for t in made[np.argsort(self.rank[made])].tolist():
            fine[t] = fine[t] and fine[self.left[t]] and fine[self.right[t]]
        able = [*self.base, *(t for t in made.tolist() if fine[t])]
        self.ids = {self.bytes[t]: t for t in able}
        self.longest = max(map(len, self.ids))

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, inside: bool = False) -> np.ndarray:
        """For each pair, whether the merge procedure leaves the boundary between a and b alone.

        x and y are what stands left and right of the boundary at some time, from the end backwards. They part from the
        boundary when the later of their parents is made; a merge of x and y that ranks before both parents would have
        come first. Of equal ranks the left place goes first. inside: a and b do merge in the end, so the last state
        does not count.
        """
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        parent_x = parent_y = np.full(len(a), NEVER)
        first = inside
        while len(live):
            if not first:
                bad = self._pair_rank(x, y) < np.minimum(parent_x, parent_y + 1)
                ok[live[bad]] = False
                go = ~bad
                live, x, y, parent_x, parent_y = live[go], x[go], y[go], parent_x[go], parent_y[go]
            first = False
            rx, ry = self.rank[x], self.rank[y]
            go = (rx >= 0) | (ry >= 0)
            live, x, y, parent_x, parent_y, rx, ry = live[go], x[go], y[go], parent_x[go], parent_y[go], rx[go], ry[go]
            undo_x = rx > ry
            parent_x, parent_y = np.where(undo_x, rx, parent_x), np.where(undo_x, parent_y, ry)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return ok

    def merged(self, word: bytes) -> list[int]:
        """The merge procedure itself: the pair of least rank, leftmost first, until none is left."""
        ids = [self.base[c] for c in word]
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap = [(m[0], k, m[1], ids[k], ids[k + 1]) for k in range(len(ids) - 1) if (m := self.merges.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, made, a, b = heapq.heappop(heap)
            n = after[k]
            if ids[k] != a or n < 0 or ids[n] != b:
                continue
            ids[k], ids[n], after[k] = made, -1, after[n]
            if after[n] >= 0:
                before[after[n]] = k
            for i, j in ((before[k], k), (k, after[k])):
                if i >= 0 and j >= 0 and (m := self.merges.get((ids[i], ids[j]))):
                    heapq.heappush(heap, (m[0], i, m[1], ids[i], ids[j]))
        return [i for i in ids if i >= 0]

    def _greedy(self, word: bytes) -> list[int]:
        ids, longest, out, i, n = self.ids, self.longest, [], 0, len(word)
        while i < n:
            j = min(n, i + longest)
            while (t := ids.get(word[i:j])) is None:
                j -= 1
            out.append(t)
            i = j
        return out

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        cuts = [[t] if (t := self.ids.get(w)) is not None else self._greedy(w) for w in words]
        flat = np.array([t for c in cuts for t in c], np.int64)
        ends = np.cumsum([len(c) for c in cuts])
        inner = np.ones(max(len(flat) - 1, 0), bool)
        inner[ends[:-1] - 1] = False
        at = np.flatnonzero(inner)
        pairs, back = np.unique(flat[at] << 32 | flat[at + 1], return_inverse=True)
        wrong = at[~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]]
        data = flat.astype("<u4").tobytes()
        bounds = [0, *(4 * ends).tolist()]
        out = [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        for k in np.unique(np.searchsorted(ends, wrong, side="right")).tolist():
            out[k] = np.array(self.merged(words[k]), "<u4").tobytes()
        return out

    def _learn(self, words: set[str]) -> None:
        """Remember the ids of all these words; those of others go where that would be too many."""
        new = [w for w in words if w not in self.words]
        if len(self.words) + len(new) > REMEMBERED:
            self.words.clear()
            new = list(words)
        for at in range(0, len(new), WORDS_AT_ONCE):
            part = new[at : at + WORDS_AT_ONCE]
            self.words.update(zip(part, self.encode_words([w.encode() for w in part]), strict=True))

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special tokens. Where blanks stand alone, text is cut at them: a blank goes with the word after it."""
        cut, odd, new = [], {}, set()
        for k, t in enumerate(texts):
            if "  " in t or " \n" in t or RARE_SPACE.search(t):
                odd[k] = self.split.findall(t)
                cut.append([])
            else:
                cut.append(t.split(" "))
                cut[-1][0] = "\0" + cut[-1][0]  # the first has no blank in front
                new.update(cut[-1])
        if len(self.chunks) + len(new) > REMEMBERED:
            self.chunks.clear()
        new.difference_update(self.chunks)
        pieces = {c: self.split.findall(c[1:] if c[:1] == "\0" else " " + c) for c in new}
        words = {w for p in pieces.values() for w in p} | {w for p in odd.values() for w in p}
        if max(len(pieces), len(words)) > REMEMBERED and len(texts) > 1:
            half = len(texts) // 2
            return self._plain(texts[:half]) + self._plain(texts[half:])
        self._learn(words)
        get = self.words.__getitem__
        self.chunks.update((c, b"".join(map(get, p))) for c, p in pieces.items())
        ids = self.chunks.__getitem__
        return [b"".join(map(get, odd[k])) if k in odd else b"".join(map(ids, c)) for k, c in enumerate(cut)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        texts, parts, owners = [t or "" for t in texts], [], []
        out: list[list[bytes]] = [[] for _ in texts]
        for k, t in enumerate(texts):
            for p in self.at_special.split(t) if self.at_special and any(s in t for s in self.special) else [t]:
                out[k].append(np.array([self.special[p]], "<u4").tobytes() if p in self.special else b"")
                if p not in self.special and p:
                    if "\0" in p:  # the mark of a first chunk is an ordinary character here
                        words = self.split.findall(p)
                        self._learn(set(words))
                        out[k][-1] = b"".join(self.words[w] for w in words)
                    else:
                        parts.append(p)
                        owners.append((k, len(out[k]) - 1))
        for (k, i), ids in zip(owners, self._plain(parts), strict=True):
            out[k][i] = ids
        return [b"".join(x) for x in out]

    def decode(self, ids: list[bytes]) -> list[str]:
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
        lengths = self.lengths[flat]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        data = self.flat[np.arange(total) + np.repeat(self.starts[flat] - (ends - lengths), lengths)].tobytes()
        cuts = np.concatenate([[0], ends])[np.cumsum([0, *(len(i) // 4 for i in ids)])].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)]


_coders: dict[str, ByteBPE] = {}


def coder(definition: str) -> ByteBPE:
    """The worker's coder of this vocabulary; one is kept."""
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _coders:
        _coders.clear()
        _coders[key] = ByteBPE(definition)
    return _coders[key]


def read_definition(path: str) -> str:
    """A vocabulary file, read on the driver: executors need not see it."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(id, ids array<long>, decoded) of every document, or with digests (id, n_tokens, ids_sha256, decoded_sha256)."""
    shipped = docs.sparkSession.sparkContext.broadcast(read_definition(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe", _coders.clear)
        bpe = coder(shipped.value)
        for part in slices(batches, 1, TEXTS_AT_ONCE):
            ids = bpe.encode(part.column(1).to_pylist())
            texts = bpe.decode(ids)
            if digests:
                columns = {
                    "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
                    "decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts]),
                }
            else:
                columns = {"ids": pa.array([np.frombuffer(i, "<u4").astype(np.int64) for i in ids], pa.list_(pa.int64())), "decoded": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays([part.column(0), *columns.values()], names=["id", *columns])

    slim = pick(docs, id=id_col, text=text_col)
    made = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<long>, decoded string"
    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, {made}")
