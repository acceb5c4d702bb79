"""Token ids in files of shuffled planes: a data source that Spark writes and reads.

A file is a stream of token ids in blocks of a fixed number. A block's ids are transposed, so that all their lowest bits (or
bytes) stand together, then the next, as far as the block's largest id needs; each such plane is compressed with zstandard
by itself, as high planes are nearly constant. Documents lie in groups: their ids in Spark and their lengths, as a
compressed Arrow stream. The chunk index at the file's end has every plane's size and every block's and group's place, so
any range of tokens is read by the blocks that cover it.

    BPLANES1 | planes and groups as they fill | index, zstandard JSON | its length, 8 bytes | BPLANES1

``write_tokens`` encodes documents with the tokenizers library, deals them to tasks by ranges of id and writes a file a task.
A file has a name of its own; the manifest, written when all tasks are done, names those that count, so a lost or repeated
task leaves nothing that a reader sees. It also holds where each file's tokens start among all of the table's: one small
record a file is what comes to the driver.

Defined results: a null or empty text is the end id alone; documents stand in ascending id, null ids first, those of one id
by a hash of their text, so rows alike in both have no order that shows; repeated rows are written each; an empty table
gives a folder without files and no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from skarn.llm.bpe import read_definition
from skarn.llm.common import claim, pick, slices
from skarn.llm.packing import MARKS

MAGIC, MANIFEST, END_ID = b"BPLANES1", "_manifest.json", 0
#: Ids of a block, documents of a group, bytes of text in a file (about), and tokens that a reader gives out at once.
BLOCK, GROUP, FILE_BYTES, TOKENS_AT_ONCE = 65_536, 16_384, 128_000_000, 1_000_000
LEVEL = 3


# --- planes ---------------------------------------------------------------------------------------------------------


def planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """The planes of a block's ids, lowest first; none above the largest id's highest bit or byte."""
    most = int(ids.max(initial=0))
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [raw[:, k].tobytes() for k in range((most.bit_length() + 7) // 8)]
    return [np.packbits(raw[:, k // 8] >> (k % 8) & 1, bitorder="little").tobytes() for k in range(most.bit_length())]


def ids_of(parts: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    """The ids whose planes these are."""
    raw = np.zeros((n, 4), np.uint8)
    for k, p in enumerate(parts):
        if kind == "byte":
            raw[:, k] = np.frombuffer(p, np.uint8)
        else:
            raw[:, k // 8] |= np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") << np.uint8(k % 8)
    return raw.reshape(-1).view("<u4")


class FileWriter:
    """Writes documents one after the other to a binary stream."""

    def __init__(self, out, id_type: pa.DataType, kind: str = "byte", block: int = BLOCK, group: int = GROUP) -> None:
        self.out, self.kind, self.block, self.group = out, kind, block, group
        self.schema = pa.schema([("id", id_type), ("n", pa.int64())])
        self.press = zstandard.ZstdCompressor(level=LEVEL)
        self.blocks: list[list] = []
        self.groups: list[list] = []
        self.waiting: list[np.ndarray] = []
        self.held = self.tokens = self.documents = self.in_group = 0
        self.rows: list[pa.RecordBatch] = []
        self.place = out.write(MAGIC)

    def add(self, ids: pa.Array, lengths: np.ndarray, tokens: np.ndarray) -> None:
        """Documents of these ids and lengths, whose tokens stand in ``tokens`` one after the other."""
        at = 0
        while at < len(lengths):
            n = min(self.group - self.in_group, len(lengths) - at)
            self.rows.append(pa.RecordBatch.from_arrays([ids.slice(at, n), pa.array(lengths[at : at + n], pa.int64())], schema=self.schema))
            self.in_group += n
            at += n
            if self.in_group == self.group:
                self._end_group()
        self.documents += len(lengths)
        self.tokens += len(tokens)
        self.waiting.append(tokens)
        self.held += len(tokens)
        if self.held >= self.block:
            flat = np.concatenate(self.waiting)
            whole = len(flat) // self.block * self.block
            for k in range(0, whole, self.block):
                self._end_block(flat[k : k + self.block])
            self.waiting, self.held = [flat[whole:].copy()], len(flat) - whole

    def _end_block(self, ids: np.ndarray) -> None:
        parts = [self.press.compress(p) for p in planes(ids, self.kind)]
        self.blocks.append([self.place, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4")), [len(p) for p in parts]])
        for p in parts:
            self.place += self.out.write(p)

    def _end_group(self) -> None:
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, self.schema) as stream:
            for b in self.rows:
                stream.write_batch(b)
        data = self.press.compress(sink.getvalue())
        self.groups.append([self.place, len(data), self.in_group])
        self.place += self.out.write(data)
        self.rows, self.in_group = [], 0

    def close(self) -> None:
        if self.held:
            self._end_block(np.concatenate(self.waiting))
        if self.in_group:
            self._end_group()
        index = {"kind": self.kind, "tokens": self.tokens, "documents": self.documents, "block": self.block, "blocks": self.blocks, "groups": self.groups}
        data = self.press.compress(json.dumps(index).encode())
        self.out.write(data + len(data).to_bytes(8, "little") + MAGIC)


class FileReader:
    """Reads a file's documents in order, or any range of its tokens."""

    def __init__(self, source, size: int) -> None:
        """``source`` seeks and reads; ``size`` is its length in bytes."""
        self.source, self.open = source, zstandard.ZstdDecompressor()
        tail = self._bytes(size - 16, 16)
        if size < 24 or tail[8:] != MAGIC or self._bytes(0, 8) != MAGIC:
            raise ValueError("no file of token planes, or one cut short")
        n = int.from_bytes(tail[:8], "little")
        self.index = json.loads(self.open.decompress(self._bytes(size - 16 - n, n)))

    def _bytes(self, at: int, n: int) -> bytes:
        self.source.seek(max(at, 0))
        return self.source.read(n)

    def block(self, k: int) -> np.ndarray:
        at, n, crc, sizes = self.index["blocks"][k]
        data, parts, cut = self._bytes(at, sum(sizes)), [], 0
        for s in sizes:
            parts.append(self.open.decompress(data[cut : cut + s]))
            cut += s
        ids = ids_of(parts, n, self.index["kind"])
        if zlib.crc32(ids) != crc:
            raise ValueError(f"block {k} is damaged")
        return ids

    def range(self, start: int, stop: int) -> np.ndarray:
        """The ids from token ``start`` to ``stop`` of the file."""
        size, stop = self.index["block"], min(stop, self.index["tokens"])
        if start >= stop:
            return np.zeros(0, "<u4")
        first = start // size
        found = np.concatenate([self.block(k) for k in range(first, (stop - 1) // size + 1)])
        return found[start - first * size : stop - first * size]

    def documents(self, at_once: int = TOKENS_AT_ONCE) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """(ids, lengths, tokens) of documents in order: at most so many tokens at once, but one document at least."""
        block, left = 0, np.zeros(0, "<u4")
        for at, size, _ in self.index["groups"]:
            table = pa.ipc.open_stream(self.open.decompress(self._bytes(at, size))).read_all().combine_chunks()
            keys, lengths = table.column(0).combine_chunks(), table.column(1).to_numpy()
            ends, lo = np.cumsum(lengths), 0
            while lo < len(lengths):
                before = int(ends[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, before + at_once, side="right")))
                need, parts = int(ends[hi - 1]) - before, [left]
                have = len(left)
                while have < need:
                    parts.append(self.block(block))
                    have += len(parts[-1])
                    block += 1
                flat = np.concatenate(parts)
                yield keys.slice(lo, hi - lo), lengths[lo:hi], flat[:need]
                left, lo = flat[need:], hi


# --- the data source ------------------------------------------------------------------------------------------------


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it; a Hadoop address of a local file may have one slash only."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    return fs.FileSystem.from_uri(path)


def manifest(path: str) -> dict:
    where, folder = _place(path)
    with where.open_input_stream(f"{folder}/{MANIFEST}") as f:
        return json.loads(f.read())


@dataclass
class Written(WriterCommitMessage):
    part: int
    name: str
    documents: int
    tokens: int


@dataclass
class Portion(InputPartition):
    name: str
    size: int
    start: int

    def __post_init__(self) -> None:
        self.value = self.name


@dataclass
class PlaneWriter(DataSourceArrowWriter):
    path: str
    schema: StructType
    options: dict[str, str] = field(default_factory=dict)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        claim("token_files", _coders.clear)
        part = TaskContext.get().partitionId()
        name, writer, out = f"part-{part:08d}-{uuid.uuid4().hex}.planes", None, None
        unit, coder, end = self.options.get("unit", "<u4"), None, b""
        if "tokenizer" in self.options:
            coder = _coder(self.options["tokenizer"])
            unit = coder.unit
            end = np.array([int(self.options.get("endid", END_ID))], unit).tobytes()
        where, folder = _place(self.path)
        for b in iterator:
            for some in slices([b], 1, TEXTS_AT_ONCE):
                if writer is None:
                    where.create_dir(folder, recursive=True)
                    out = where.open_output_stream(f"{folder}/{name}")
                    writer = FileWriter(out, some.schema.field(0).type, self.options.get("planes", "byte"))
                ids = some.column(1).to_pylist()
                if coder:
                    ids = coder.encode(ids)
                lengths = np.array([len(i) + len(end) for i in ids], np.int64) // np.dtype(unit).itemsize
                writer.add(some.column(0), lengths, np.frombuffer(b"".join(i + end for i in ids), unit))
        if writer is None:
            return Written(part, "", 0, 0)
        writer.close()
        out.close()
        return Written(part, name, writer.documents, writer.tokens)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, start = [], 0
        where, folder = _place(self.path)
        for m in sorted((m for m in messages if m and m.name), key=lambda m: m.part):
            files.append([m.name, where.get_file_info(f"{folder}/{m.name}").size, start, m.documents, m.tokens])
            start += m.tokens
        where.create_dir(folder, recursive=True)
        with where.open_output_stream(f"{folder}/.{MANIFEST}") as f:
            f.write(json.dumps({"id": self.schema[0].dataType.simpleString(), "tokens": start, "files": files}).encode())
        where.move(f"{folder}/.{MANIFEST}", f"{folder}/{MANIFEST}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        where, folder = _place(self.path)
        for m in messages:
            if m and m.name:
                where.delete_file(f"{folder}/{m.name}")


@dataclass
class PlaneReader(DataSourceReader):
    path: str

    def partitions(self) -> list[InputPartition]:
        return [Portion(name, size, start) for name, size, start, *_ in manifest(self.path)["files"]] or [Portion("", 0, 0)]

    def read(self, partition: Portion) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        claim("token_files")
        where, folder = _place(self.path)
        start = partition.start
        with where.open_input_file(f"{folder}/{partition.name}") as f:
            for keys, lengths, tokens in FileReader(f, partition.size).documents():
                ends = np.cumsum(lengths)
                cuts = pa.py_buffer(np.concatenate([[0], 4 * ends]).astype("<i4"))
                data = pa.Array.from_buffers(pa.binary(), len(lengths), [None, cuts, pa.py_buffer(np.ascontiguousarray(tokens))])
                yield pa.RecordBatch.from_arrays([keys, pa.array(start + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), data], names=["id", "start", "n_tokens", "ids"])
                start += int(ends[-1])


class TokenPlanes(DataSource):
    """``spark.read.format("token_planes").load(folder)``: id, start, n_tokens, ids (little-endian, 4 bytes each).

    Written are, in the order of partitions, (id, ids binary), with the option unit (<u2 or <u4, how ``ids`` are given), or (id, text),
    with the option tokenizer (its JSON definition) and endid, an id behind each text. planes is bit or byte.
    """

    @classmethod
    def name(cls) -> str:
        return "token_planes"

    def schema(self) -> str:
        return f"id {manifest(self.options['path'])['id']}, start long, n_tokens long, ids binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PlaneReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        path = self.options["path"]
        where, folder = _place(path)
        if not overwrite and where.get_file_info(f"{folder}/{MANIFEST}").type != fs.FileType.NotFound:
            raise ValueError(f"{path} holds token files already")
        return PlaneWriter(path, schema, {k: self.options[k] for k in ("unit", "planes", "tokenizer", "endid") if k in self.options})


def tokens_between(path: str, start: int, stop: int) -> np.ndarray:
    """The ids from ``start`` to ``stop`` of all that the folder holds, through the indices of the files that cover them."""
    where, folder = _place(path)
    found = [np.zeros(0, "<u4")]
    for name, size, first, _, n in manifest(path)["files"]:
        if first < stop and start < first + n:
            with where.open_input_file(f"{folder}/{name}") as f:
                found.append(FileReader(f, size).range(max(start - first, 0), stop - first))
    return np.concatenate(found)


# --- encoding -------------------------------------------------------------------------------------------------------

#: Strings between blanks that a worker remembers, and documents it holds at once.
REMEMBERED, TEXTS_AT_ONCE = 700_000, 1_000
#: Up to here what counts as a letter does not depend on the version of Unicode.
LATIN_GREEK_CYRILLIC = "\u052f"
#: Stands before a text's first word, which no blank precedes.
FIRST = "\0"
#: White space other than the blank and the line end, and what a blank may not stand before: texts with any of it go to the library whole.
_RARE = "\0\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_RARE_WIDE = "\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _cuttable(text: str) -> bool:
    if "  " in text or " \n" in text or text[:1] == " " or any(c in text for c in _RARE):
        return False
    return text.isascii() or not any(c in text for c in _RARE_WIDE)


def _byte_letters() -> list[str]:
    """The character that byte-level vocabularies write for each byte: its own where that shows, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


class Coder:
    """The tokenizers library; a byte-level vocabulary's words are remembered, so that its merges run once a word.

    There, a single blank before anything but white space starts a pre-token. Texts whose only white space is such blanks
    and line ends are cut at them. A word of letters is one pre-token, the marks behind it another, and a pre-token goes to
    the library's model straight; whatever else a word holds goes through the library's whole path.
    """

    def __init__(self, definition: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.unit = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.array = "H" if self.unit == "<u2" else "I"
        told = json.loads(definition)
        pre = told.get("pre_tokenizer") or {}
        plain = {"add_prefix_space": False, "use_regex": True}
        self.by_word = pre.get("type") == "ByteLevel" and all(pre.get(k, True) == v for k, v in plain.items()) and not told.get("normalizer") and told["model"]["type"] == "BPE"
        self.special = [t["content"] for t in told.get("added_tokens", [])]
        self.letters = dict(enumerate(_byte_letters()))
        self.known: dict[str, bytes] = {}

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.array, ids).tobytes()

    def whole(self, texts: list[str]) -> list[bytes]:
        return [self._pack(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _model(self, pre_token: str) -> bytes:
        written = pre_token.replace(" ", "Ġ") if pre_token.isascii() else pre_token.encode().decode("latin-1").translate(self.letters)
        return array(self.array, [t.id for t in self.tokenizer.model.tokenize(written)]).tobytes()

    def _learn(self, new: list[str]) -> None:
        """Remember words and what they are made of. A word stands for itself with a blank in front; marks stand under a leading tab."""
        known, left, pack = self.known, [], self._model
        for c in new:
            stem = c.rstrip(MARKS)
            if not stem.isalpha() or not stem.isascii() and max(stem) > LATIN_GREEK_CYRILLIC:
                left.append(c)
                continue
            if (ids := known.get(stem)) is None:
                ids = known[stem] = pack(" " + stem)
            if len(stem) < len(c):
                marks = "\t" + c[len(stem) :]
                if (more := known.get(marks)) is None:
                    more = known[marks] = self.whole([marks[1:]])[0]
                known[c] = ids + more
        known.update(zip(left, self.whole([c[1:] if c[:1] == FIRST else " " + c for c in left]), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids, in ``unit``."""
        texts = [t or "" for t in texts]
        fine = [self.by_word and _cuttable(t) and not any(s in t for s in self.special) for t in texts]
        cut, rest = iter(self._cut([t for t, f in zip(texts, fine, strict=True) if f])), iter(self.whole([t for t, f in zip(texts, fine, strict=True) if not f]))
        return [next(cut) if f else next(rest) for f in fine]

    def _cut(self, texts: list[str]) -> list[bytes]:
        """Arrow cuts the texts and finds their different words; these are looked up once, and numpy puts the ids in place."""
        if not texts:
            return []
        words = pc.split_pattern(pa.array([FIRST + t for t in texts]), " ")
        coded = words.flatten().dictionary_encode()
        different = coded.dictionary.to_pylist()
        new = [w for w in different if w not in self.known]
        if len(self.known) + 2 * len(new) > REMEMBERED:
            if len(texts) > 1 and 2 * len(different) > REMEMBERED:  # too many words of their own for one go
                half = len(texts) // 2
                return self._cut(texts[:half]) + self._cut(texts[half:])
            self.known.clear()
            new = different
        self._learn(new)
        ids = [self.known[w] for w in different]
        size = np.dtype(self.unit).itemsize
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // size
        flat, starts = np.frombuffer(b"".join(ids), self.unit), np.cumsum(lengths) - lengths
        at = coded.indices.to_numpy()
        own = lengths[at]
        ends = np.cumsum(own)
        total = int(ends[-1])
        data = flat[np.arange(total) + np.repeat(starts[at] - (ends - own), own)].tobytes()
        bounds = (size * np.concatenate([[0], ends])[words.offsets.to_numpy()]).tolist()
        return [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


_coders: dict[str, Coder] = {}


def _coder(definition: str) -> Coder:
    """The worker's coder of this vocabulary; one is kept."""
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(definition)
    return _coders[key]


def write_tokens(docs: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, kind: str = "byte") -> None:
    """Write the documents' ids to ``folder``, in ascending order of their id.

    Texts are dealt by ranges of (id, hash of text, place), so that rows of one id, or alike, are dealt to several tasks where
    they are many; a task sorts its range, encodes it and writes it as it goes. Nothing is written in between.
    """
    spark = docs.sparkSession
    spark.dataSource.register(TokenPlanes)
    slim = pick(docs, id=id_col, text=text_col)
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-size // FILE_BYTES))
    placed = slim.select("id", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"), "text")
    dealt = placed.repartitionByRange(parts, "id", "hash", "row").sortWithinPartitions("id", "hash", "row").select("id", "text")
    told = {"tokenizer": read_definition(path), "endid": end_id, "planes": kind}  # executors need not see the vocabulary's file
    dealt.write.format("token_planes").options(**told).mode("overwrite").save(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids binary) of every document of the folder; start counts the tokens of all before it."""
    spark.dataSource.register(TokenPlanes)
    return spark.read.format("token_planes").load(folder)
