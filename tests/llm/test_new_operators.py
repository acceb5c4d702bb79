"""Token files, ball-tree clustering and fill-in-the-middle against brute force."""

import collections
import hashlib
import io
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skarn.llm import ball_tree, fill_middle, queries, token_files

DATA = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, ids string, start string, n string, v string"


def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


TEXTS = [
    None,
    "",
    " ",
    "a",
    "one two,  three \n four\n\nfive\n six",
    "don't we'll it's 12 3.5 x#y!! end. ",
    " leading and\ttab\r\nline",
    "<|endoftext|> a <|endoftext|>b",
    "naïve Ünïcode 漢字 слово ελληνικά ß",
    "nbsp here thin space   sep\x1c\x1d x\x85y",
    "word, word. word! word #### ?!?! (paren) [x]",
    "x" * 3000,
    "a b " * 2000,
    "new\nlines\n\n\nmany \n",
    "Ⅻ ½ ǅ ʰ ª",
]


def test_coder_like_library():
    coder, lib = token_files.Coder(open(PATH, encoding="utf-8").read()), library()
    rng = random.Random(4)
    letters = "abcDEé漢 \n\t,.!?#'0 <| я"
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["end<|endoftext|>", "one two three"]
    got = [np.frombuffer(x, coder.unit).tolist() for x in coder.encode(texts)]
    assert got == [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert coder.by_word


def test_coder_forgets_without_loss(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 10)
    coder, lib = token_files.Coder(open(PATH, encoding="utf-8").read()), library()
    texts = [" ".join(f"w{chr(97 + i)}{chr(97 + j)}x" for j in range(26)) for i in range(26)]
    for part in (texts[:13], texts[13:], texts):
        assert [np.frombuffer(x, coder.unit).tolist() for x in coder.encode(part)] == [lib.encode(t, add_special_tokens=False).ids for t in part]


@pytest.mark.parametrize("kind", ["bit", "byte"])
@pytest.mark.parametrize("ids", [[], [0], [0] * 9, [1, 2, 3], [65535] * 17, [2**32 - 1, 0, 7], list(range(1000))])
def test_planes_round_trip(kind, ids):
    a = np.array(ids, "<u4")
    parts = token_files.planes(a, kind)
    assert token_files.ids_of(parts, len(a), kind).tolist() == ids
    bits = int(a.max(initial=0)).bit_length()
    assert len(parts) == (bits if kind == "bit" else -(-bits // 8))
    if kind == "bit":  # plane k holds bit k of every id
        for k, p in enumerate(parts):
            assert [int(b) for b in np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little")[: len(ids)]] == [i >> k & 1 for i in ids]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 70_000), max_size=40), max_size=60), st.sampled_from(["bit", "byte"]), st.integers(1, 50), st.integers(1, 9), st.integers(1, 64))
def test_file_round_trip(docs, kind, block, group, at_once):
    """Documents of any length, empty ones too, in blocks and groups of any size; ranges by the index."""
    out = io.BytesIO()
    w = token_files.FileWriter(out, pa.int64(), kind, block, group)
    for k in range(0, len(docs), 7):
        part = docs[k : k + 7]
        w.add(pa.array(range(k, k + len(part)), pa.int64()), np.array([len(d) for d in part], np.int64), np.array([t for d in part for t in d], "<u4"))
    w.close()
    data = out.getvalue()
    reader = token_files.FileReader(io.BytesIO(data), len(data))
    got, keys = [], []
    for ids, lengths, tokens in reader.documents(at_once):
        assert len(tokens) <= at_once or len(lengths) == 1
        keys += ids.to_pylist()
        got += [x.tolist() for x in np.split(tokens, np.cumsum(lengths)[:-1])]
    assert got == docs and keys == list(range(len(docs)))
    flat = [t for d in docs for t in d]
    for a, b in ((0, len(flat)), (3, 11), (len(flat) // 2, len(flat) + 5), (5, 5)):
        assert reader.range(a, b).tolist() == flat[a:b]


def test_damaged_files_are_refused():
    out = io.BytesIO()
    w = token_files.FileWriter(out, pa.int64())
    w.add(pa.array([1]), np.array([5]), np.arange(5, dtype="<u4"))
    w.close()
    data = out.getvalue()
    with pytest.raises(ValueError):
        token_files.FileReader(io.BytesIO(data[:-3]), len(data) - 3)
    with pytest.raises(Exception):
        r = token_files.FileReader(io.BytesIO(data[:9] + bytes([data[9] ^ 1]) + data[10:]), len(data))
        r.block(0)


def brute_tokens(rows):
    lib, start, out = library(), 0, []
    made = [(i, np.array(lib.encode(t or "", add_special_tokens=False).ids + [0], "<u4")) for i, t in rows]
    for i, ids in sorted(made, key=lambda r: (r[0] is not None, r[0] or 0)):
        out.append((i, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    return out


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_token_files(spark, tmp_path, kind):
    """Null id and text, empties, a long text, clashing columns; the order, the starts, and ranges across files."""
    rows = [(i * 7 % 101, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (500, " ".join(f"w{k}" for k in range(30_000)))]
    docs = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(3)
    where = f"file://{tmp_path}/planes"
    token_files.write_tokens(docs, PATH, where, kind=kind)
    read = token_files.read_tokens(spark, where)
    assert read.dtypes == [("id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids", "binary")]
    got = sorted((r.start, r.id, r.n_tokens, zlib.crc32(r.ids), bytes(r.ids)) for r in read.collect())
    want = brute_tokens(rows)
    assert [(i, s, n, c) for s, i, n, c, _ in got] == want
    flat = np.frombuffer(b"".join(g[4] for g in got), "<u4")
    assert len(token_files.manifest(where)["files"]) > 1
    for a, b in ((0, 10), (17, 20_000), (len(flat) - 3, len(flat) + 9)):
        assert (token_files.tokens_between(where, a, b) == flat[a:b]).all()


def test_token_files_ties_and_other_ids(spark, tmp_path):
    """Rows of one id by their tokens' hash, alike rows each; string ids; equal starts never."""
    docs = spark.createDataFrame([("b", "two"), ("a", "x y"), ("b", "one"), ("b", "two"), (None, None)] * 20, "doc_id string, text string").repartition(4)
    where = f"{tmp_path}/planes"
    token_files.write_tokens(docs, PATH, where)
    got = sorted(token_files.read_tokens(spark, where).collect(), key=lambda r: r.start)
    assert [r.id for r in got] == [None] * 20 + ["a"] * 20 + ["b"] * 60
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got]).tolist()[:-1]]
    twos = [bytes(r.ids) for r in got[40:]]
    assert collections.Counter(collections.Counter(twos).values()) == {40: 1, 20: 1} and len([1 for a, b in zip(twos, twos[1:]) if a != b]) == 1
    with pytest.raises(Exception, match="already"):
        docs.select(F.col("doc_id").alias("id"), F.lit(b"").alias("ids")).write.format("token_planes").mode("append").save(where)


def test_token_files_of_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    token_files.write_tokens(docs, PATH, f"{tmp_path}/none")
    read = token_files.read_tokens(spark, f"{tmp_path}/none")
    assert read.count() == 0 and read.columns == ["id", "start", "n_tokens", "ids"] and len(token_files.tokens_between(f"{tmp_path}/none", 0, 9)) == 0


def test_lost_attempts_are_not_read(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    token_files.write_tokens(docs, PATH, f"{tmp_path}/p")
    name = token_files.manifest(f"{tmp_path}/p")["files"][0][0]
    data = (tmp_path / "p" / name).read_bytes()
    (tmp_path / "p" / "part-00000000-orphan.planes").write_bytes(data[:20])
    assert sorted(r.id for r in token_files.read_tokens(spark, f"{tmp_path}/p").collect()) == [1, 2]


def test_op11_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    df = queries.op11_token_planes(spark, DATA)
    assert {f.name: f.dataType.simpleString() for f in df.schema} == {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}
    assert sorted(tuple(r) for r in df.collect()) == sorted(brute_tokens(rows))


# --- ball trees -----------------------------------------------------------------------------------------------------


def brute_clusters(rows, k, rounds, scale=64, dimensions=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dimensions and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(scale * float(x))) for x in v]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    c = [list(v) for _, v in order[:k]]
    far = lambda v, m: sum((a - b) ** 2 for a, b in zip(v, m))
    for _ in range(rounds):
        own = collections.defaultdict(list)
        for _, v in kept:
            own[min(range(len(c)), key=lambda j: (far(v, c[j]), j))].append(v)
        for j, vs in own.items():
            c[j] = [sum(col) // len(vs) for col in zip(*vs)]
    out = []
    for i, v in kept:
        j = min(range(len(c)), key=lambda j: (far(v, c[j]), j))
        out.append((i, j, far(v, c[j])))
    per = collections.Counter()
    for _, j, d in out:
        per[j] += d
    total = sum(per.values())
    return sorted(((i, j, d, per[j], total, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in out), key=str)


def vectors(n, seed, dimensions=64, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dimensions))
    rows = [(int(i), (centres[i % 6] + spread * rng.normal(size=dimensions)).astype(np.float32).tolist()) for i in range(n)]
    return rows


def test_tree_is_sound():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.integers(-60, 60, (700, 8)), np.full((300, 8), 5), rng.integers(-3, 3, (50, 8))])
    tree, order = ball_tree.build(v)
    assert sorted(order.tolist()) == list(range(len(v)))
    w = v[order]
    for lo, hi, child, radius, sums in zip(tree.lo, tree.hi, tree.child, tree.radius, tree.sums):
        own = w[lo:hi]
        assert (own.sum(axis=0) == sums).all()
        assert np.sqrt(((own - sums / len(own)) ** 2).sum(axis=1)).max() <= radius + 1e-9
        if child >= 0:
            assert tree.lo[child] == lo and tree.hi[child] == tree.lo[child + 1] and tree.hi[child + 1] == hi
        else:
            assert len(own) <= ball_tree.LEAF_VECTORS or radius == 0
    for k in (1, 3, 16):
        c = rng.integers(-60, 60, (k, 8))
        which, far = ball_tree.assign(tree, w, c)
        all_ = ((w[:, None] - c[None]) ** 2).sum(axis=2)
        assert (which == all_.argmin(axis=1)).all() and (far == all_.min(axis=1)).all()
        sums, counts = np.zeros_like(c), np.zeros(k, np.int64)
        ball_tree.tally(tree, w, c, sums, counts)
        assert (counts == np.bincount(which, minlength=k)).all() and all((sums[j] == w[which == j].sum(axis=0)).all() for j in range(k))


def test_whole_balls_are_assigned():
    """Groups far apart: balls go whole, few vectors are looked at; ties and equal centroids go to the smaller number."""
    v = np.concatenate([np.random.default_rng(2).integers(0, 4, (500, 16)) + 1000 * k for k in range(4)])
    tree, order = ball_tree.build(v)
    c = np.stack([np.full(16, 1000 * k + 1) for k in range(4)])
    pieces = list(ball_tree.filter_balls(tree, v[order], c))
    assert len(pieces) == 4 and all(some is None for *_, some in pieces)
    which, _ = ball_tree.assign(tree, v[order], np.concatenate([c, c]))
    assert which.max() == 3
    far = ball_tree.squares(np.array([[1 << 25, -(1 << 25)]]), np.array([[-(1 << 25), 1 << 25]]))
    assert far.tolist() == [[2 * (1 << 26) ** 2]]


@pytest.mark.parametrize("n, k, rounds, spread", [(300, 16, 3, 0.05), (40, 16, 3, 1.0), (5, 16, 2, 1.0), (0, 16, 3, 1.0)])
def test_clusters(spark, n, k, rounds, spread, monkeypatch):
    monkeypatch.setattr(ball_tree, "TREE_VECTORS", 64)
    rows = vectors(n, 5, spread=spread)
    if n > 40:
        rows += [(10_000 + i, rows[0][1]) for i in range(120)] + [(7, rows[1][1]), (7, rows[1][1]), (None, rows[2][1])]
        bad = list(rows[0][1])
        rows += [(1, None), (2, []), (3, bad[:63]), (4, [None, *bad[1:]]), (5, [float("nan"), *bad[1:]]), (6, [float("inf"), *bad[1:]])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, cluster int, v int").repartition(3)
    out = ball_tree.cluster_vectors(df, k=k, rounds=rounds)
    got = sorted((tuple(r) for r in out.drop("centroid").collect()), key=str)
    assert got == brute_clusters(rows, k, rounds)


def test_too_large_components_raise(spark):
    df = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="too large"):
        ball_tree.cluster_vectors(df).collect()


# --- fill in the middle ---------------------------------------------------------------------------------------------


def brute_fim(i, t):
    t = t or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (i, n, "plain", None, None, t)
    if h4 % 100 < 20:
        return (i, n, "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m)
    return (i, n, "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m)


def test_fill_in_middle(spark):
    texts = [*TEXTS, "has <P> mark", "<S>", "a<M", "<P<S<M", ">P>S>M>", "<<P", "word " * 20_000, "漢" * 500]
    rows = [(i, t) for i in range(0, 60, 20) for t in texts] + [(k, f"some words, and {k} more <text> here\n") for k in range(300)] + [(None, "no id here"), (None, None), (3, "twice"), (3, "twice")]
    docs = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in fill_middle.fill_in_middle(docs).select("id", "n", "form", "prefix_chars", "middle_chars", "output").collect()]
    want = [brute_fim(*r) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {f for _, _, f, *_ in got} == {"plain", "psm", "spm"}
    assert sorted(fill_middle.restore(o, f) for _, _, f, _, _, o in got) == sorted(t or "" for _, t in rows)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    short = [tuple(r) for r in fill_middle.fill_in_middle(docs, digests=True).collect()]
    assert sorted(short, key=str) == sorted(((i, n, f, p, m, digest(o), digest(fill_middle.restore(o, f))) for i, n, f, p, m, o in want), key=str)
    assert fill_middle.fill_in_middle(docs.where("1 = 0")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>PSM ab\n漢", max_size=40), st.tuples(*[st.integers(0, 2**32 - 1)] * 4))
def test_restored(text, draws):
    n, form, _, _, output = fill_middle.rewrite(text, draws)
    assert n == len(re.findall(r"[A-Za-z]+|[^A-Za-z]", text)) and fill_middle.restore(output, form) == text


def test_one_udf_in_the_plan(spark):
    plan = queries.op13_fill_middle(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


@pytest.mark.parametrize("name", ["op12_ball_tree", "op13_fill_middle"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    rows = lambda df: sorted(tuple(None if pd.isna(v) else v for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), con.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, rows(got.astype(object)))) == sorted(map(str, rows(want.astype(got.dtypes.to_dict()).astype(object))))
