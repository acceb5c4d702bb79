"""The training-data operators against brute force, on fixtures with nulls, empties, repeats and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skarn.llm import bpe, classifier, fingerprints, html_text, packing, quality_rules, queries, sharding, simhash, substrings, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
DATA = "/root/testdata/sf0.001"
EXTRA = ["score", "fp", "tile", "share", "deal", "doc_deal", "repeats", "rules", "id", "words"]


def corpus(seed=3, n=80):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé漢") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 220))) for _ in range(n)]
    shared = " ".join(rng.choice(words) for _ in range(70))
    for i in (3, 9, 20):
        texts[i] = texts[i][:50] + " " + shared + "\n" + texts[i][50:]
    texts[5] = texts[6] = texts[7]
    texts[8] = texts[7] + " tail"
    texts += [None, "", " \n\t ", "one", "word " * 60, "<|endoftext|> a  b c", "x" * 3000, " ".join(rng.choice(words) for _ in range(6000)), texts[7]]
    rows = [(i * 3, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return rows + [(None, texts[7], "en", "s", 1), (None, None, None, None, None), rows[4], rows[12]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def odd(docs):
    """The same with extra columns whose names clash with the operators' own."""
    return docs.withColumns({c: F.lit(1) for c in EXTRA})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("1 = 0")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def key(i):
    return (i is None, i or 0)


def test_quality_rules(spark, docs, odd, empty):
    trusted = spark.createDataFrame([(3,), (9,), (60,)], "trusted_id long")
    out = [r for r in quality_rules.judge(odd, trusted, result="verdict").select("doc_id", "text", "verdict.*").collect()]
    grams = lambda t: [h % 65536 for h in hashes(words(t))]

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def hashes(w):
        one = [signed(xxhash.xxh64_intdigest(x.encode(), 42)) for x in w]
        two = []
        for a, b in zip(one, one[1:]):
            h = xxhash.xxh64_intdigest((a & (1 << 64) - 1).to_bytes(8, "little"), 42)
            two.append(signed(xxhash.xxh64_intdigest((b & (1 << 64) - 1).to_bytes(8, "little"), h)))
        return one + two

    raw, good = collections.Counter(), collections.Counter()
    for i, t, *_ in corpus():
        raw.update(grams(t))
        if i in (3, 9, 60):
            good.update(grams(t))
    scale, m = sum(good.values()) / sum(raw.values()), quality_rules.SMOOTHING
    ratio = lambda b: np.log((good[b] + m) / (raw[b] * scale + m))
    assert len(out) == len(corpus())
    for r in out:
        w = words(r.text)
        tri = collections.Counter(zip(w, w[1:], w[2:]))
        cover = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (r.text or "").split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(cover))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", r.text or "")) and r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
        g = grams(r.text)
        if g:
            assert r.score == pytest.approx(np.mean([ratio(b) for b in g]), abs=1e-6)
        assert (r.score is None) == (not g) and r.kept == (not r.base_failed and (r.score or -9) >= quality_rules.THRESHOLD)
    assert quality_rules.judge(empty, trusted).count() == 0
    assert quality_rules.keep_good(odd, trusted).columns == odd.columns


def in_order(rows):
    """By descending id, null ids last, equal ids by descending hash of the text."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), -signed(xxhash.xxh64_intdigest(r[1].encode(), 42))))


def test_a_column_of_the_results_name_is_replaced(spark, odd):
    trusted = spark.createDataFrame([(3,)], "trusted_id long")
    assert quality_rules.judge(odd, trusted).where("rules.n_words > 5").count() > 50
    nothing = classifier.Model(np.zeros(1 << classifier.BITS, np.float32), 0.0)
    assert [r.score for r in classifier.with_scores(odd, nothing).collect()] == [0.5] * len(corpus())
    assert substrings.remove_repeats(odd).where("repeats.n_words > 5").count() > 50


def test_fingerprints(docs, odd, empty):
    out = fingerprints.edits(odd).collect()
    order = in_order(corpus())
    want = collections.Counter()
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        want[i, len(t), t[: len(t) - len(t) // 2] + n[: len(t) // 2]] += 1
    assert collections.Counter((r.id, r.n_chars, r.edited) for r in out) == want
    by_text = collections.defaultdict(set)
    texts = {}
    for i, t, *_ in corpus():
        texts.setdefault(i, t or "")
    for r in out:
        if r.id is not None:
            by_text[texts[r.id]].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(f) == 1 for f in by_text.values()) and by_text[""] == {""}
    assert fingerprints.edits(empty).count() == 0


def test_phrases_do_not_depend_on_offset():
    rng = random.Random(1)
    body = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    a, b = fingerprints.parse([body, "".join(rng.choice("xyz") for _ in range(37)) + body])
    c = fingerprints.parse(["".join(rng.choice("abcdefgh ") for _ in range(4000))])[0]
    assert fingerprints.likeness(a[None], b[None])[0] > 0.8 > 0.2 > fingerprints.likeness(a[None], c[None])[0]


@pytest.mark.parametrize("size", [1, 50, 700, 400_000])
def test_fingerprints_do_not_depend_on_the_batch(spark, monkeypatch, size):
    """A text at the end of a batch, or with an empty one behind it, is cut like anywhere else."""
    texts = [t or "" for _, t, *_ in corpus()]
    alone = [fingerprints.parse([t])[0].tolist() for t in texts]
    assert fingerprints.parse([*texts, "tail"])[:-1].tolist() == alone
    assert [row for t in texts for row in fingerprints.parse([t, "", t, "b"])[[0, 2]].tolist()] == [row for row in alone for _ in range(2)]
    assert [row.tolist() for k in range(0, len(texts), 7) for row in fingerprints.parse(texts[k : k + 7])] == alone
    monkeypatch.setattr(fingerprints, "FLAT_CHARS", size)
    assert [row.tolist() for part in fingerprints._portions(texts) for row in fingerprints.parse(part)] == alone
    order = in_order(corpus())
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for (_, t), (_, n) in zip(order, order[1:] + order[:1])]
    one = [fingerprints.fingerprint_text(fingerprints.parse([t])[0]) for t in edited]
    assert one == [fingerprints.fingerprint_text(x) for x in fingerprints.parse([*edited, "tail"])[:-1]]


def test_edits_do_not_depend_on_parts(spark, docs):
    """Every row's fingerprints are those of its texts parsed alone."""
    text = {}
    for i, t, *_ in corpus():
        text.setdefault(i, set()).add(t or "")
    mark = lambda t: fingerprints.fingerprint_text(fingerprints.parse([t])[0])
    for r in fingerprints.edits(docs).collect():
        assert r.fingerprint in {mark(t) for t in text[r.id]} and r.edited_fingerprint == mark(r.edited)


@pytest.mark.parametrize("hot", [None, 7, -5])
def test_shares_part_one_hot_id(spark, monkeypatch, hot):
    """A third of all rows bear one id, or none: they are parted by their texts, and every row still finds the next one."""
    monkeypatch.setattr(fingerprints, "ROWS_PER_SHARE", 10)
    rng = random.Random(9)
    rows = [(hot if k % 3 == 0 else rng.randint(-100, 4000), f"text {k} " * rng.randint(1, 9)) for k in range(3000)] + [(12, None), (12, ""), (hot, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sizes = [r["count"] for r in fingerprints.with_next(df).where("not peek").groupBy("share").count().collect()]
    assert max(sizes) < 200 and sum(sizes) == len(rows)
    order = in_order(rows)
    want = collections.Counter((i, t[: len(t) - len(t) // 2] + n[: len(t) // 2]) for (i, t), (_, n) in zip(order, order[1:] + order[:1]))
    assert collections.Counter((r.id, r.edited) for r in fingerprints.edits(df).collect()) == want


def brute_parse(text):
    """The hierarchy written out symbol by symbol."""
    full, mix = (1 << 64) - 1, lambda x: int(fingerprints.mix64(np.array([x & (1 << 64) - 1], np.uint64))[0])
    shape = int(fingerprints._SHAPE)
    symbols, bins, level = [mix(ord(c)) for c in text], {}, 0
    while symbols and (level < 2 or len(symbols) > 1):
        runs = []
        for x in symbols:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        symbols = [mix(x ^ (n * shape & full)) if n > 1 else x for x, n in runs]
        label = symbols
        for _ in range(fingerprints.ROUNDS):
            made = []
            for k, x in enumerate(label):
                before = label[k - 1] if k else x ^ full
                bit = ((x ^ before) & -(x ^ before)).bit_length() - 1
                made.append(bit << 1 | x >> bit & 1)
            label = made
        cuts = [0, *(k for k in range(2, len(label)) if label[k] > label[k - 1] and (k + 1 == len(label) or label[k] >= label[k + 1])), len(label)]
        symbols = [mix(sum(mix(x + j * shape) for j, x in enumerate(symbols[a:b])) + b - a) for a, b in zip(cuts, cuts[1:])]
        for x in symbols if level else []:
            bins[x >> 58] = min(x, bins.get(x >> 58, full))
        level += 1
    return [((bins[k] & (1 << 24) - 1) or 1) if k in bins else 0 for k in range(fingerprints.BINS)]


def test_parse_by_brute_force():
    rng = random.Random(3)
    texts = ["", "a", "ab", "aaaa", "abab" * 40, "x" * 3000, *("".join(rng.choice("abc \n漢🙂") for _ in range(rng.randint(1, 900))) for _ in range(20))]
    got = fingerprints.parse(texts)
    assert got.tolist() == [brute_parse(t) for t in texts]
    for a, b in zip(got, got[1:]):
        filled = [(x, y) for x, y in zip(a.tolist(), b.tolist()) if x or y]
        assert fingerprints.likeness(a[None], b[None])[0] == pytest.approx(sum(x == y for x, y in filled) / len(filled) if filled else 1.0)


def brute_simhash(t):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(ids, fps, radius=4):
    comp = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for a in range(len(ids)):
            for b in range(a):
                if (fps[a] ^ fps[b]).bit_count() <= radius and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    least = {}
    for i, c in zip(ids, comp):
        least[c] = min(least.get(c, (True, 0)), key(i))
    return [None if least[c][0] else least[c][1] for c in comp]


def test_simhash(docs, odd, empty):
    rows = corpus()
    fps = [brute_simhash(t) for _, t, *_ in rows]
    want = collections.Counter(zip((r[0] for r in rows), fps, brute_components([r[0] for r in rows], fps)))
    for tile in (5, 32_768):
        out = simhash.near_duplicates(odd, tile_rows=tile).collect()
        assert collections.Counter((r.id, r.fp & (1 << 64) - 1, r.component) for r in out) == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {c for _, _, c in want if c is not None}


def test_one_row_of_each_component_stays(spark):
    """Null ids, alone and among others, and ids that occur again with the same, a like or an unlike text."""
    rng = random.Random(6)
    base = [" ".join(f"w{rng.randint(0, 10**9)}" for _ in range(120)) for _ in range(7)]
    like = lambda t: t.rsplit(" ", 1)[0] + f" w{rng.randint(0, 99)}"
    rows = [(5, base[0]), (5, base[1]), (3, base[1]), (None, base[0]), (None, base[2]), (None, base[2]), (None, like(base[2])), (None, base[3])]
    rows += [(8, base[4]), (8, base[4]), (8, like(base[4])), (8, base[5]), (None, base[5]), (9, base[6]), (None, None), (None, ""), (2, like(base[6]))]
    fps = [brute_simhash(t) for _, t in rows]
    group = brute_components(list(range(len(rows))), fps)
    assert len(set(group)) == 8
    least = {g: min(key(i) for (i, _), h in zip(rows, group) if h == g) for g in group}
    for parts in (1, 3):
        kept = [(r.doc_id, r.text) for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()]
        assert sorted((group[rows.index(r)], key(r[0])) for r in kept) == sorted(least.items())


def test_dense_groups_and_forests():
    rng = np.random.default_rng(2)
    center = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    w = np.unique(np.concatenate([center, *(center ^ np.uint64(1 << int(rng.integers(64))) for _ in range(200)), rng.integers(0, 1 << 63, 300, dtype=np.uint64)]))
    near = np.bitwise_count(w[:, None] ^ w[None]) <= 4
    np.fill_diagonal(near, False)
    assert set(simhash._touched(w, w, 4, True).tolist()) == set(w[near.any(1)].tolist())
    src, dst = simhash._forest(w, 4)
    assert set(src.tolist()) | set(dst.tolist()) == set(w[near.any(1)].tolist()) and len(src) < len(w)


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://NET/", "https://a.net", "http://x.example.net/en/1?q", "http://example.net/fr/", "ftp://www.example.com/de/#x", "http://notnet/", "http://a.org/fr/x", "http://a.org/fr", "://net/a", "http://.net/"]
    rows = [(i, u, 1) for i, u in enumerate(urls)] + [(None, "http://b.net/x", 1), (3, "http://NET/", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, key int")
    assert {(r.id, r.rule, r.verdict) for r in url_filter.judge(pages, url_filter.rule_table(spark, [])).collect()} == {(i, None, "allow") for i, *_ in rows}

    def brute(u):
        if u is None or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest)[0]
        path, host = re.match(r"[^?#]*", rest[len(raw) :])[0], raw.lower()
        fit = [(len(k), k, v) for k, v in queries.RULES if (host == k.split("/")[0] or host.endswith("." + k.split("/")[0])) and path.startswith("/" + k.split("/", 1)[1])]
        return host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else "allow"

    out = url_filter.judge(pages, url_filter.rule_table(spark, queries.RULES)).collect()
    assert collections.Counter((r.id, r.host, r.path, r.rule, r.verdict) for r in out) == collections.Counter((i, *brute(u)) for i, u, _ in rows)
    assert url_filter.judge(pages.where("1 = 0"), url_filter.rule_table(spark, queries.RULES)).count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("hash(key) % 9 = 0")
    c = url_filter.build(universe, listed)
    assert len(c.levels) > 1
    wrong = universe.select("key", c.has(F.col("key")).alias("got"), (F.expr("hash(key) % 9 = 0")).alias("want")).where("got <> want")
    assert wrong.count() == 0


def test_bpe(docs, odd, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    want = collections.Counter()
    for i, t, *_ in corpus():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[i, tuple(ids), lib.decode(ids, skip_special_tokens=False)] += 1
    assert collections.Counter((r.id, tuple(r.ids), r.decoded) for r in bpe.encode_documents(odd, path).collect()) == want
    assert bpe.encode_documents(empty, path).count() == 0


def test_bpe_on_random_strings():
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, own, rng = Tokenizer.from_file(path), bpe.ByteBPE(open(path, encoding="utf-8").read()), random.Random(1)
    texts = ["".join(rng.choice(" \n\t ab'sré<|endoftext|>0\0　🙂漢!\r ") for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    got = own.encode(texts)
    want = lib.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [w.ids for w in want]
    assert own.decode(got) == [lib.decode(w.ids, skip_special_tokens=False) for w in want]


@pytest.mark.parametrize("remembered", [3, 40, 300])
def test_bpe_with_more_words_than_it_remembers(monkeypatch, remembered):
    """One batch and single texts hold more distinct words than a worker remembers."""
    monkeypatch.setattr(bpe, "REMEMBERED", remembered)
    monkeypatch.setattr(bpe, "WORDS_AT_ONCE", 7, raising=False)
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, own, rng = Tokenizer.from_file(path), bpe.ByteBPE(open(path, encoding="utf-8").read()), random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé漢059") for _ in range(rng.randint(1, 9)))
    texts = [rng.choice([" ", " ", "  ", "\0", "<|endoftext|>"]).join(word() for _ in range(rng.randint(0, 120))) for _ in range(60)]
    texts += ["", " ".join(word() for _ in range(900)), "  ".join(word() for _ in range(900)), texts[0]]
    for _ in range(2):  # the second time with what is remembered
        assert [np.frombuffer(g, "<u4").tolist() for g in own.encode(texts)] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_packing(docs, odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    want, total = collections.Counter(), 0
    for i, t, *_ in corpus():
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[i, k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    out = packing.pack_documents(odd, path).collect()
    assert collections.Counter((r.id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 4096
    assert len(bins) == -(-total // 4096)
    assert packing.pack_documents(empty, path).count() == 0


def test_plan_uses_every_length():
    rng = np.random.default_rng(5)
    for n in (0, 1, 7, 500, 20_000):
        counts = np.bincount(rng.integers(1, 4097, n), minlength=4097)
        used = np.zeros(4097, int)
        for lengths, times in packing.plan(counts):
            assert sum(lengths) <= 4096
            for x in lengths:
                used[x] += times
        assert (used == counts).all()


def test_an_exact_triple_is_found_behind_any_number_of_false_ones():
    """128 larger first parts leave only twice a length that is there once; no three terms are in progression."""
    gap, free = 14_000, np.zeros(14_001, np.int64)
    for k in range(128):
        b = 2188 + int(f"{k:b}", 3)
        free[b] = free[gap - 2 * b] = 1
    assert packing.ComplementIndex(free.tolist()).complement(gap, 0) is None
    free[[4700, 4667, 4633]] = 1
    found = packing.ComplementIndex(free.tolist()).complement(gap, 0)
    assert found and sum(found) == gap and all(free[x] >= n for x, n in collections.Counter(found).items())


def test_the_index_of_sums_finds_every_complement():
    """Against trying all, while counts run out in any order."""
    import itertools

    rng = random.Random(8)
    for _ in range(30):
        free = [0, *(rng.choice([0, 0, 1, 2, 5]) for _ in range(30))]
        index = packing.ComplementIndex(free)
        for length in range(30, 0, -1):
            while free[length]:
                gap = 30 - length
                have = [x for x in range(1, gap + 1) if free[x]]
                fits = [c for k in (1, 2, 3) for c in itertools.combinations_with_replacement(have, k) if sum(c) == gap and all(free[x] >= n for x, n in collections.Counter((length, *c)).items())]
                found = index.complement(gap, length)
                assert (found is None) == (not fits or not gap)
                if found:
                    assert tuple(sorted(found)) in fits and len(found) == len(fits[0])
                index.use(collections.Counter((length, *(found or ()))), 1)
                if rng.random() < 0.3:  # others run out besides
                    x = rng.choice([x for x in range(1, 31)])
                    index.use({x: 1}, free[x])


def brute_bins(pieces, capacity):
    """The fewest bins, by trying every place for every piece."""
    best = len(pieces)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(pieces):
            best = len(bins)
            return
        for j in {b: j for j, b in enumerate(bins)}.values():
            if bins[j] + pieces[k] <= capacity:
                go(k + 1, [*bins[:j], bins[j] + pieces[k], *bins[j + 1 :]])
        go(k + 1, [*bins, pieces[k]])

    go(0, [])
    return best


def test_plan_against_the_fewest_sequences():
    rng = random.Random(2)
    for _ in range(40):
        pieces = sorted((rng.randint(1, 24) for _ in range(rng.randint(1, 9))), reverse=True)
        used = sum(times for _, times in packing.plan(np.bincount(pieces, minlength=25), 24))
        assert used <= brute_bins(pieces, 24) + 1


def test_word_tokenizer_on_random_strings():
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, own, rng = Tokenizer.from_file(path), packing.WordTokenizer(open(path, encoding="utf-8").read()), random.Random(1)
    texts = ["".join(rng.choice("\n\t ab'sréİΣσ<|endoftext|>0　🙂漢!Á.,\x1c\x85") for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    assert [np.frombuffer(g, "<u4").tolist() for g in own.encode(texts)] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_sharding(docs, odd, empty, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ITEMS", 40)
    monkeypatch.setattr(sharding, "BUNDLES", 16)
    out = sharding.shard_documents(odd).collect()
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in corpus())
    assert collections.Counter((r.id, r.size, r.text_crc32) for r in out) == want
    where, load, slots = collections.defaultdict(set), collections.Counter(), collections.defaultdict(list)
    for r in out:
        where[r.text_crc32, r.size].add(r.shard)
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in where.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(empty).count() == 0


def test_differencing_balances():
    x = np.sort(np.random.default_rng(1).lognormal(7, 1, 3000).astype(np.int64))[::-1]
    load = np.bincount(sharding.difference(x, 8), weights=x, minlength=8)
    assert load.max() - load.min() <= 16 and len(sharding.difference(x[:3], 8)) == 3


def test_html(spark):
    pages = [
        (1, "u", "<html><head><title>T</title></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>A  &amp; B</h1><p>One\n two.<p>Three &lt;four&gt; five six seven.</article><div class='ad'>Buy</div><footer>&copy; x</footer>"),
        (2, None, None),
        (None, "v", ""),
        (3, "w", "<script>var t='</p>';</script><main><p>Only this stays in the page.</p></main><section class=comments><p>First!</p></section>"),
    ]
    out = {r.id: r.text for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()}
    assert out == {1: "A & B\nOne two.\nThree <four> five six seven.", 2: "", None: "", 3: "Only this stays in the page."}
    model, wrong, n = html_text.default_model(), 0, 0
    for page, labels in html_text.labelled_pages(60, 99):
        wrong += sum(a != b for a, b in zip(model.decode(html_text.blocks(page)), labels, strict=True))
        n += len(labels)
    assert wrong / n < 0.02


@pytest.mark.parametrize(
    "inside",
    [
        "<svg-icon name=x></svg-icon>",
        "<video-player src=x></video-player>",
        "<button-group></button-group>",
        "<title-bar></title-bar>",
        "<select-box></select-box>",
        '<svg class="x"/>',
        "<svg viewBox='0 0 1 1' />",
        "<svg><title/><path d='M0'/></svg>",
        "<svg><title>hidden</svg>",
        "<svg><svg>hidden</svg>hidden</svg>",
        "<svg/><svg>hidden</svg>",
        "<button>",
        "<object data=x>",
        "<video src=x>",
        "<audio src=x controls>",
        "<canvas>",
        "<select>",
        "<button title='a>b'>hidden</button>",
        "<SCRIPT>'<svg>hidden'</SCRIPT >",
        "<script>hidden</script x>",
        "<!-- <button> -->",
        "<object><object>hidden</object>hidden</object>",
        "<video><!-- </video> -->hidden</video>",
        "<button>hidden</button>",
        "<style/>hidden</style>",
    ],
)
def test_html_drops_only_what_is_not_shown(inside):
    found = lambda page: [b.text for b in html_text.blocks(page)]
    assert found(f"<p>One</p>{inside}<p>Two</p><div>Three</div>") == ["One", "Two", "Three"]
    assert found(f"<p>One</p>{inside}<p>Two</p><button>hidden</button><svg>hidden</svg><video>hidden</video><p>Three</p>") == ["One", "Two", "Three"]


@pytest.mark.parametrize("tag", ["<p class=don't>", "<p class=don't id='x'>", "<p title='don't>", '<p title="abc>', "<p '>", '<p "a">', "<p title=\"a>b\" class='x>y'>", "<p title = 'a>b'/>", "<p a=b'c\"d>"])
def test_html_stray_quotes_hide_nothing(tag):
    found = lambda page: [b.text for b in html_text.blocks(page)]
    assert found(f"{tag}one two three.</p><p>it's \"four\" five.</p><a href=\"x\">link</a><p id='z'>six</p>") == ["one two three.", "it's \"four\" five.", "link", "six"]
    assert found(f"<p>a</p><button {tag[3:]}hidden</button><p>it's</p>") == ["a", "it's"]


def test_html_without_a_closing_bracket():
    import time

    began = time.time()
    for page in ('<a b="' * 20_000, "<p =" * 50_000, "<svg " * 20_000 + ">", "<p a='" * 20_000 + ">x"):
        html_text.blocks(page)
    assert time.time() - began < 20
    assert [b.text for b in html_text.blocks("one <b")] == ["one"] and [b.text for b in html_text.blocks("<p>one</p> 3 < 4 <")] == ["one", "3 < 4 <"]


def test_viterbi_is_the_likeliest_path():
    import itertools

    model = html_text.default_model()
    for page, _ in html_text.labelled_pages(40, 5):
        b = html_text.blocks(page)[:9]
        e = model.emissions(b)
        score = lambda y: model.first[y[0]] + sum(e[i, v] for i, v in enumerate(y)) + sum(model.steps[a, c] for a, c in zip(y, y[1:]))  # noqa: B023, E731
        assert score(model.decode(b)) == pytest.approx(max(map(score, itertools.product((0, 1), repeat=len(b)))))


def brute_repeats(rows, width=50):
    first = {}
    for i, t, *_ in sorted(rows, key=lambda r: key(r[0])):
        w = words(t)
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), key(i))
    out = []
    for i, t, *_ in rows:
        w = words(t)
        gone = {j for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] < key(i) for j in range(k, k + width)}
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return collections.Counter(out)


def test_substrings(docs, odd, empty):
    for deal in (5, 2500):
        out = substrings.remove_repeats(odd, result="cut", docs_per_deal=deal).select("doc_id", "cut.*").collect()
        assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out) == brute_repeats(corpus())
        assert all(sum(b - a for a, b in r.spans) == r.n_removed for r in out)
    assert substrings.remove_repeats(empty).count() == 0
    assert substrings.without_repeats(odd).columns == odd.columns


@pytest.mark.parametrize("batch", [1, 3, 1000])
def test_substrings_in_any_batches(spark, odd, batch):
    """Repeats inside a batch are settled there, those across batches in the deals: the result is the same."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        out = substrings.remove_repeats(odd.coalesce(2), result="cut", docs_per_deal=9).select("doc_id", "cut.*").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out) == brute_repeats(corpus())


def test_a_shared_window_is_asked_once_a_batch():
    a, b, ids = np.array([7, 7, 7, 7, 9, 9, 5, 7], np.uint64), np.array([1, 1, 1, 1, 1, 1, 1, 2], np.uint64), np.array([4, 2, 2, 3, 8, 8, 1, 9])
    asked, lost = substrings._settled(a, b, ids)
    assert sorted(zip(a[asked].tolist(), b[asked].tolist(), ids[asked].tolist())) == [(5, 1, 1), (7, 1, 2), (7, 2, 9), (9, 1, 8)]
    assert sorted(zip(a[lost].tolist(), ids[lost].tolist())) == [(7, 3), (7, 4)]
    asked, _ = substrings._settled(a, b, ids, np.array([0, 0, 0, 0, 31, 32, 0, 0]))  # each owner asks for itself
    assert sorted(zip(a[asked].tolist(), b[asked].tolist(), ids[asked].tolist())) == [(5, 1, 1), (7, 1, 2), (7, 2, 9), (9, 1, 8), (9, 1, 8)]


def test_windows_whose_first_hashes_meet_are_told_apart():
    own = substrings._packed_windows(np.array([1, 1, 2], np.uint64), np.array([5, 6, 5], np.uint64))
    assert substrings._found(own, own[[1, 1, 1]]).tolist() == [False, True, False] and substrings._found(own, own[[2, 0]]).tolist() == [True, False, True]


def test_ids_travel_whole(spark):
    rng = np.random.default_rng(1)
    big = np.unique(np.concatenate([rng.integers(-(1 << 63), (1 << 63) - 1, 50), [-(1 << 63), (1 << 63) - 1, 0]]))
    for ids in (big, np.arange(900), np.array([5]), np.array([-(1 << 63), (1 << 63) - 1]), np.array([3, 300, 70_000, 1 << 40])):
        assert substrings._ids_of(substrings._steps(ids)).tolist() == ids.tolist()
    df = spark.createDataFrame([(int(x),) for x in big], "x long").select("x", F.xxhash64("x").alias("h")).collect()
    assert substrings.hash_ids(np.array([r.x for r in df])).tolist() == [r.h for r in df]


@pytest.mark.parametrize("hot", [None, 6])
def test_substrings_with_one_id_on_a_third_of_all_rows(spark, hot):
    rng = random.Random(12)
    word = lambda: f"w{rng.randint(0, 900)}"
    passages = [" ".join(word() for _ in range(60)) for _ in range(6)]
    rows = []
    for k in range(400):
        body = " ".join(word() for _ in range(rng.randint(0, 80)))
        rows.append((hot if k % 3 == 0 else rng.choice([k, k, None, 6]), f"{body} {rng.choice(passages)} {body}" if k % 4 else body))
    out = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), result="cut", docs_per_deal=20).select("doc_id", "cut.*").collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out) == brute_repeats(rows)


def test_substrings_of_a_very_long_text(spark):
    """More words than are hashed at once, half of them again in a second document."""
    n = 1_300_000
    first = " ".join(f"v{k}" for k in range(n))
    second = " ".join(f"v{k}" for k in range(n // 2)) + " end " + " ".join(f"u{k}" for k in range(100))
    out = substrings.remove_repeats(spark.createDataFrame([(1, first), (2, second), (3, "x " * 200)], "doc_id long, text string"), result="cut").select("doc_id", "cut.n_words", "cut.n_removed", "cut.spans").collect()
    assert {(r.doc_id, r.n_words, r.n_removed, tuple(map(tuple, r.spans))) for r in out} == {(1, n, 0, ()), (2, n // 2 + 101, n // 2, ((0, n // 2),)), (3, 200, 0, ())}


def test_classifier(spark, docs, odd, empty):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = classifier.train(d, labels)
    out = classifier.with_scores(d.select("doc_id", "text"), model).join(labels, "doc_id").where(classifier.held_out(F.col("doc_id"))).collect()
    assert sum((r.score >= 0.5) == (r.quality == 1) for r in out) / len(out) > 0.95
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in out)
    scored = classifier.with_scores(odd, model, score_col="p").collect()
    assert len(scored) == len(corpus()) and all(0 <= r.p <= 1 for r in scored)
    assert classifier.with_scores(empty, model).count() == 0
    nothing = classifier.train(d, labels.where("1 = 0"))
    assert {r.score for r in classifier.with_scores(docs.drop("score"), nothing).collect()} == {0.5}


def test_classifier_learns_from_whole_texts(spark, docs, monkeypatch):
    """Training sees the features that scoring sees, in the order of the ids' hashes, however few rows pass at once."""
    labels = spark.createDataFrame([(i, i % 2) for i, *_ in corpus() if i is not None], "doc_id long, quality int").distinct()
    seen = []
    monkeypatch.setattr(classifier, "fit", lambda rows, bits: seen.extend([list(rows), list(rows)]))
    for held in (32_000_000, 40_000):
        monkeypatch.setattr(classifier, "DRIVER_BYTES", held, raising=False)
        classifier.train(docs, labels)
    want = collections.Counter((*(x.tobytes() for x in classifier.features(t)), i % 2) for i, t in {(i, t) for i, t, *_ in corpus()} if i is not None and zlib.crc32(str(i).encode()) % 3 != 1)
    got = [[(a.tobytes(), b.tobytes(), y) for a, b, y in x] for x in seen]
    assert collections.Counter(got[0]) == want and all(x == got[0] for x in got)
    assert max(len(a) for a, _, _ in seen[0]) > 2 * 2048


def test_pipeline_stages_by_brute_force(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    at = docs
    for name, stage in cp.STAGES:
        out = stage(spark, at, DATA)
        rows, kept = at.collect(), out.collect()
        if name == "simhash_near_dedup":
            fps = [brute_simhash(r.text) for r in rows]
            assert {r.doc_id for r in kept} == set(brute_components([r.doc_id for r in rows], fps))
        if name == "substring_dedup":
            want = {i: (n, k) for i, _, n, k in brute_repeats([(r.doc_id, r.text) for r in rows])}
            for r in kept:
                n, k = want[r.doc_id]
                assert words(r.text) == k.split() and (n > 0 or r.text in {x.text for x in rows if x.doc_id == r.doc_id}) and r.n_chars == len(r.text)
        if name != cp.STAGES[-1][0]:
            assert out.columns == docs.columns and 0 < len(kept) <= len(rows)
            at = spark.createDataFrame(kept, docs.schema)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    sized = {r.doc_id for r in quality_rules.judge(docs, quality_rules.trusted_ids(spark.read.parquet(f"{DATA}/labels.parquet"))).where("not rules.base_failed").collect()}
    good = {i for i in sized if labels.get(i) == 1}
    judged = quality_rules.keep_good(docs, quality_rules.trusted_ids(spark.read.parquet(f"{DATA}/labels.parquet")))
    assert good <= {r.doc_id for r in judged.collect()}
    assert {r.doc_id for r in kept} == {r.doc_id for r in at.collect()}
    a, b = (sorted(map(tuple, x.select("doc_id", "piece", "length", "ids_crc32").collect())) for x in (cp.run(spark, DATA), out))
    assert a == b


def test_pipeline_stages_on_unusual_rows(spark, docs, odd, empty):
    """Nulls, empties, repeats, a very long text, clashing columns and an empty table through every stage."""
    import corpus_pipeline as cp

    tall = docs.limit(0).union(spark.createDataFrame([(2, "very long " * 3 + " ".join(f"w{k}" for k in range(40_000)), "en", "s", 1)], SCHEMA))
    rows = corpus() + [tuple(r) for r in tall.collect()]
    for name, stage in cp.STAGES:
        out = stage(spark, odd.unionByName(tall.withColumns({c: F.lit(1) for c in EXTRA})), DATA)
        got = out.collect()
        if name != cp.STAGES[-1][0]:
            none = stage(spark, empty, DATA)
            assert out.columns == odd.columns and none.columns == empty.columns and none.count() == 0
        texts = collections.Counter((r[0], r[1]) for r in rows)
        if name == "quality_rules":
            kept = collections.Counter((r.doc_id, r.text) for r in got)
            assert all(len(words(t)) >= 50 and n == texts[i, t] for (i, t), n in kept.items())
        if name == "quality_classifier":
            assert all(n == texts[k] for k, n in collections.Counter((r.doc_id, r.text) for r in got).items())
        if name == "simhash_near_dedup":
            fps = [brute_simhash(r[1]) for r in rows]
            group = brute_components(list(range(len(rows))), fps)
            least = {g: min(key(r[0]) for r, h in zip(rows, group) if h == g) for g in group}
            where = {(r[0], r[1]): g for r, g in zip(rows, group)}
            assert sorted((where[r.doc_id, r.text], key(r.doc_id)) for r in got) == sorted(least.items())
        if name == "substring_dedup":
            want = collections.Counter((i, n, tuple(words(k))) for (i, _, n, k), m in brute_repeats(rows).items() for _ in range(m))
            assert len(got) == len(rows) and collections.Counter((r.doc_id, tuple(words(r.text))) for r in got) == collections.Counter((i, k) for i, _, k in want.elements())
            assert all((r.n_chars is None) == (r.text is None) and (r.text is None or r.n_chars == len(r.text)) for r in got)
        if name == "best_fit_packing":
            lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            need = collections.Counter()
            for r in rows:
                n = len(lib.encode(r[1] or "", add_special_tokens=False).ids) + 1
                need.update((r[0], k, min(4096, n - 4096 * k)) for k in range(-(-n // 4096)))
            assert collections.Counter((r.doc_id, r.piece, r.length) for r in got) == need and stage(spark, empty, DATA).count() == 0


@pytest.fixture(scope="module")
def raw(spark):
    return {t: spark.read.parquet(f"{DATA}/{t}.parquet").collect() for t in ("documents", "labels", "pages")}


def kinds(df):
    return {f.name: f.dataType.simpleString() for f in df.schema}


def test_query_op1(spark, raw):
    df = queries.QUERIES["op1_quality_rules"](spark, DATA)
    assert kinds(df) == {"doc_id": "bigint", **dict.fromkeys(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), "bigint"), "base_failed": "boolean", "kept": "boolean", "score": "double"}
    out = {r.doc_id: r for r in df.collect()}
    assert len(out) == len(raw["documents"])
    for d in raw["documents"]:
        w, r, text = words(d.text), out[d.doc_id], d.text or ""
        tri = collections.Counter(zip(w, w[1:], w[2:]))
        cover = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if words(x)]
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        assert tuple(r)[1:7] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover), failed)
        assert r.kept == (not failed and r.score >= quality_rules.THRESHOLD)


def test_query_op2(spark, raw):
    df = queries.QUERIES["op2_fingerprints"](spark, DATA)
    assert kinds(df) == {"doc_id": "bigint", "n_chars": "bigint", **dict.fromkeys(("edited_sha256", "fingerprint", "edited_fingerprint"), "string"), "near_edited": "double", "near_next": "double"}
    out = {r.doc_id: r for r in df.collect()}
    rows = sorted(((d.doc_id, d.text or "") for d in raw["documents"]), reverse=True)
    mark = {t: fingerprints.parse([t]) for _, t in rows}
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        e, r = fingerprints.parse([edited]), out[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprints.fingerprint_text(mark[t][0]), fingerprints.fingerprint_text(e[0]))
        assert (r.near_edited, r.near_next) == (fingerprints.likeness(mark[t], e)[0], fingerprints.likeness(mark[t], mark[n])[0])
    assert np.mean([r.near_edited for r in out.values()]) > np.mean([r.near_next for r in out.values()]) + 0.2


def test_query_op3(spark, raw):
    df = queries.QUERIES["op3_simhash"](spark, DATA)
    assert kinds(df) == {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}
    ids, fps = [d.doc_id for d in raw["documents"]], [brute_simhash(d.text) for d in raw["documents"]]
    assert {tuple(r) for r in df.collect()} == set(zip(ids, (f"{f:016x}" for f in fps), brute_components(ids, fps)))


def test_query_op5(spark, raw):
    df = queries.QUERIES["op5_bpe"](spark, DATA)
    assert kinds(df) == {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    lib, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), set()
    for d in raw["documents"]:
        ids = lib.encode(d.text or "", add_special_tokens=False).ids
        decoded = lib.decode(ids, skip_special_tokens=False)
        want.add((d.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert {tuple(r) for r in df.collect()} == want


def test_query_op6(spark, raw):
    df = queries.QUERIES["op6_packing"](spark, DATA)
    assert kinds(df) == {"doc_id": "bigint", "piece": "int", **dict.fromkeys(("start", "length", "ids_crc32", "sequence_id", "offset"), "bigint")}
    lib, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), set()
    for d in raw["documents"]:
        ids = [*lib.encode(d.text or "", add_special_tokens=False).ids, 1]
        want |= {(d.doc_id, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())) for k in range(0, len(ids), 4096)}
    out, bins = df.collect(), collections.defaultdict(list)
    assert {tuple(r)[:5] for r in out} == want and len(out) == len(want)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == np.cumsum([0, *(n for _, n in sorted(b)[:-1])]).tolist() and sum(n for _, n in b) <= 4096
    assert len(bins) <= -(-sum(r.length for r in out) // 4096) + 1


def test_query_op7(spark, raw):
    df = queries.QUERIES["op7_sharding"](spark, DATA)
    assert kinds(df) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    out, load, slots, same = df.collect(), collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    text = {d.doc_id: d.text or "" for d in raw["documents"]}
    assert {(r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in out} == {(i, len(t.encode()) + 1, zlib.crc32(t.encode()), "bytes", None) for i, t in text.items()}
    for r in out:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        same[text[r.doc_id]].add(r.shard)
    assert set(load) == set(range(8)) and all(len(s) == 1 for s in same.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = collections.Counter()
    for r in out:
        sizes[text[r.doc_id]] += r.size
    ordered = np.array(sorted(sizes.values(), reverse=True))
    naive = naive_difference(ordered.tolist(), 8)
    assert sorted(load.values()) == sorted(naive)


def naive_difference(sizes, parts):
    """Largest differencing by sorting the whole list at each step; ties by age."""
    states = [(s, k, [s] + [0] * (parts - 1)) for k, s in enumerate(sizes)]
    made = len(states)
    while len(states) > 1:
        states.sort(key=lambda x: (-x[0], x[1]))
        (_, _, a), (_, _, b), *states = states
        joined = sorted((x + y for x, y in zip(a, reversed(b))), reverse=True)
        states.append((joined[0] - joined[-1], made, joined))
        made += 1
    return states[0][2]


def test_differencing_by_brute_force():
    rng = np.random.default_rng(4)
    for n, parts in ((1, 3), (5, 3), (40, 8), (300, 5), (60, 2)):
        x = np.sort(rng.integers(1, 5000, n))[::-1]
        load = np.bincount(sharding.difference(x, parts), weights=x, minlength=parts)
        assert sorted(load.tolist()) == sorted(naive_difference(x.tolist(), parts))


def test_query_op8(spark, raw):
    df = queries.QUERIES["op8_html_text"](spark, DATA)
    assert kinds(df) == {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}
    model = html_text.default_model()
    assert {tuple(r) for r in df.collect()} == {(p.page_id, p.url, t, len(t)) for p in raw["pages"] for t in [html_text.extract(p.html, model)]}


def test_query_op10(spark, raw):
    df = queries.QUERIES["op10_quality_classifier"](spark, DATA)
    assert kinds(df) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    out, label = df.collect(), {r.doc_id: r.quality for r in raw["labels"]}
    assert len(out) == len(raw["documents"])
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    seen = [r for r in out if label.get(r.doc_id) is not None and r.held_out]
    assert sum(r.predicted == label[r.doc_id] for r in seen) / len(seen) > 0.9


def test_hot_rows_are_split_when_near_duplicates_go(spark, monkeypatch):
    """A third of all rows alike: one of them stays, the one of least hash where other columns differ, also without hot keys."""
    rows = [(7, "the same words over and over again and more of them", k % 3) for k in range(400)] + [(100 + k, f"text {k} of its own {k * k} and {k * 31} more", k) for k in range(200)] + [(None, None, 1), (None, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int").repartition(4)
    want = None
    for hot in (10, 10_000):
        monkeypatch.setattr(simhash, "HOT_ROWS", hot)
        df = simhash.drop_near_duplicates(docs)
        got = sorted((tuple(r) for r in df.collect()), key=str)
        assert df.columns == docs.columns and len([r for r in got if r[0] == 7]) == 1 and len([r for r in got if r[0] is None]) == 1
        assert want is None or got == want
        want = got
    least = docs.where("doc_id = 7").select("extra", F.xxhash64("doc_id", "text", "extra").alias("h")).orderBy("h").first().extra
    assert [r for r in want if r[0] == 7][0][2] == least


def test_coarse_deals_change_nothing(spark, odd, monkeypatch):
    """Few coarse deals and small packs against the direct way, and the SQL's rows on the driver's table."""
    rows = lambda df: sorted((str(r.doc_id), r.repeats.n_words, r.repeats.n_removed, r.repeats.kept, str(r.repeats.spans)) for r in df.collect())
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = [rows(substrings.remove_repeats(d, docs_per_deal=k)) for d, k in ((odd, 1), (docs, 3))]
    monkeypatch.setattr(substrings, "FAN", 5)
    monkeypatch.setattr(substrings, "REDEALT_WINDOWS", 200)
    assert substrings._run(67, 5) == 14
    assert [rows(substrings.remove_repeats(d, docs_per_deal=k)) for d, k in ((odd, 1), (docs, 3))] == want


def test_bytes_of_a_window_at_a_million_deals():
    """What either exchange carries of a window, at 10^6 deals (8 TB): one coarse deal's part of many batches, then its rows for the deals."""
    rng, deals, fan = np.random.default_rng(3), 1_000_000, substrings.FAN
    run_of = substrings._run(deals, fan)
    first, n = [], 0
    while n < substrings.REDEALT_WINDOWS:
        a, b = rng.integers(0, 1 << 63, 300_000, dtype=np.uint64), rng.integers(0, 1 << 63, 300_000, dtype=np.uint64) << np.uint64(1)
        ids = np.repeat(np.sort(rng.integers(0, 10**10, 300)), 1000)
        fine = substrings._deal(b, deals)
        for c in range(0, fan, 4):  # a fourth of the coarse deals is enough
            at = np.flatnonzero(fine // run_of == c)
            w = np.empty(len(at), substrings.COARSE)
            w["a"], w["b"], w["sub"] = a[at], b[at].astype(np.uint16), fine[at] % run_of
            first += list(substrings._rows(w, ids[at], np.zeros(len(at), np.int64), np.full(len(at), 7)))
            n += len(at)
    size = lambda rows: sum(len(x) for r in rows for x in r[-4:])
    assert size(first) / n < 16
    sent = substrings._batch([(False, *r) for r in first])
    out = [r for b in substrings._redealt(deals, fan)([sent]) for r in zip(*(c.to_pylist() for c in b.columns))]
    assert {r[1] // run_of for r in out} == {7} and sum(len(r[2]) for r in out) == 10 * n
    assert size(out) / n < 15  # ten of the window, four of an id among 10^10


def test_one_id_on_all_rows_is_bounded(spark, monkeypatch):
    """Rows and not ids are bounded, equal rows count once, and the driver gets them in several parts."""
    seen, parts = [], []
    monkeypatch.setattr(classifier, "fit", lambda rows, bits: (seen.extend(rows), parts.append(rows.table.rdd.getNumPartitions())))
    monkeypatch.setattr(classifier, "DRIVER_BYTES", 2_000)
    one = next(i for i in range(9) if zlib.crc32(str(i).encode()) % 3 != 1)
    docs = spark.createDataFrame([(one, f"text number {k % 60} of one id") for k in range(600)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(one, 1), (one, 1), (one + 1000, 0)], "doc_id long, quality int")
    classifier.train(docs, labels, max_rows=25)
    assert len(seen) == 25 and len({s.tobytes() for s, _, _ in seen}) == 25 and parts[0] > 1


def test_features_and_updates_by_brute_force():
    rng, bits = random.Random(5), 12
    fold = lambda w: re.sub(rb"(.)\1+", rb"\1", bytes(65 if 65 <= c < 91 else 48 if 48 <= c < 58 else 97 if c >= 128 or 97 <= c < 123 else c for c in w), flags=re.DOTALL)
    mix = lambda x: int(classifier.mix64(np.array([x & (1 << 64) - 1], np.uint64))[0])
    rows = []
    for k in range(40):
        text = " ".join(rng.choice(["Aa", "b1", "b1", "çé", "--", "word", "WORD", "aab"]) for _ in range(rng.randint(0, 30)))
        w = text.encode().split()
        one = [xxhash.xxh64_intdigest(x) for x in w]
        shape = [classifier._REPEAT.item() if i and one[i] == one[i - 1] else xxhash.xxh64_intdigest(fold(x), 1) for i, x in enumerate(w)]
        own = {x >> 64 - bits for x in [*one, *(mix(a * 3 + b) for a, b in zip(one, one[1:]))]}
        kinds_ = collections.Counter(mix(x) >> 64 - bits for x in [*shape, *(5 * a + b for a, b in zip(shape, shape[1:]))])
        slots, values = classifier.features(text, bits)
        got = sorted(zip(slots.tolist(), values.tolist()))
        want = sorted([(s, len(own) ** -0.5) for s in own] + [(s, (n / sum(kinds_.values())) ** 0.5) for s, n in kinds_.items()])
        assert [s for s, _ in got] == [s for s, _ in want] and np.allclose(sorted(v for _, v in got), sorted(v for _, v in want))
        rows.append((slots, values, k % 2))
    z, n = collections.Counter(), collections.Counter()

    def weight(i):
        return 0.0 if abs(z[i]) <= classifier.L1 else -(z[i] - np.sign(z[i]) * classifier.L1) / ((classifier.BETA + n[i] ** 0.5) / classifier.ALPHA + classifier.L2)

    for _ in range(classifier.EPOCHS):
        for slots, values, label in rows:
            sums = collections.Counter()
            for i, v in zip(slots.tolist(), values.astype(float).tolist()):
                sums[i] += v  # a slot of both kinds is one coordinate
            x = [*sums.items(), (-1, 1.0)]
            w = [weight(i) for i, _ in x]
            p = 1 / (1 + np.exp(-sum(a * v for a, (_, v) in zip(w, x))))
            step = [(p - label) * v for _, v in x]
            sigma = [((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / classifier.ALPHA for (i, _), g in zip(x, step)]
            for k, (i, _) in enumerate(x):
                z[i] += step[k] - sigma[k] * w[k]
                n[i] += step[k] ** 2
    model = classifier.fit(rows, bits)
    assert model.bias == pytest.approx(weight(-1)) and np.allclose([model.weights[i] for i in z if i >= 0], [weight(i) for i in z if i >= 0], atol=1e-6)


@pytest.mark.parametrize("name", ["op4_url_filter", "op9_substring_dedup"])  # the others in test_new_operators
def test_same_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    a, b = queries.QUERIES[name](spark, DATA).toPandas(), con.sql(queries.ORACLES[name]).df()
    order = sorted(a.columns)
    text = lambda df: sorted(tuple("~" if v is None or v != v else str(v) for v in r) for r in df[order].itertuples(index=False))
    assert sorted(b.columns) == order and text(a) == text(b)


def test_digests(spark):
    out = queries.QUERIES["op2_fingerprints"](spark, DATA).collect()
    docs = sorted(spark.read.parquet(f"{DATA}/documents.parquet").collect(), key=lambda r: -r.doc_id)
    want = {}
    for r, n in zip(docs, docs[1:] + docs[:1]):
        want[r.doc_id] = hashlib.sha256((r.text[: len(r.text) - len(r.text) // 2] + n.text[: len(r.text) // 2]).encode()).hexdigest()
    assert {r.doc_id: r.edited_sha256 for r in out} == want
