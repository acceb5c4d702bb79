"""Quality rules: base rules, then a hashed n-gram log-likelihood ratio against a fixed threshold.

Word uni- and bigrams are hashed into ``buckets``. How often a bucket's n-grams occur in the trusted documents, and how
often in the whole corpus, gives two multinomials, smoothed by the same number a bucket after the corpus is scaled to the
trusted part's size, so that what is rare in both says little. A document's score is the mean over its n-grams of
ln(p_trusted / p_corpus), so it does not grow with length. A document is kept if no base rule fails it and its score
reaches ``threshold``: no draw is involved, and every document gets a verdict. DataFrame expressions only; what leaves the
executors is one figure a bucket.

Three-word windows and n-grams are told apart by 64-bit hashes: two different windows of one text of n words meet with a
probability below n^2 / 2^65.

Defined results: a null, empty or blank text has no words and fails the base rules, with a null score; without trusted
documents all scores are 0; repeated rows get equal verdicts, and
count as often as they occur; a null id is never trusted; an empty table gives an empty table; other columns pass through,
but for one that bears the result's name, which the result replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import WORD, free_name

BUCKETS, THRESHOLD, SMOOTHING = 1 << 16, -0.15, 4.0
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = r"[#*$%&|<>]"
#: Trusted ids up to this number go to every executor; more are joined by a shuffle.
BROADCAST_IDS = 4_000_000


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _pinned(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is made once a row.

    A projection would be merged into whatever refers to it, filters pushed below it and lambda bodies included, and so
    be made again for each element. A generator of one row is not merged.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def _with_hashes(docs: DataFrame, text_col: str, words: str, hashes: str) -> DataFrame:
    """The words and their hashes."""
    return _pinned(_pinned(docs, words, words_of(F.col(f"`{text_col}`"))), hashes, F.transform(words, lambda w: F.xxhash64(w)))


def _pairs(h: Column) -> Column:
    return F.when(F.size(h) < 2, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.slice(h, F.lit(2), F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: F.xxhash64(F.get(h, i), x))
    )


def _grams(h: Column, buckets: int) -> Column:
    """The buckets of all uni- and bigrams."""
    return F.transform(F.concat(h, _pairs(h)), lambda x: F.pmod(x, F.lit(buckets)).cast("int"))


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    return labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("trusted_id")).where(F.col("trusted_id").isNotNull()).distinct()


def ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """One row: the log ratios of all buckets as one array, in order."""
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    small = trusted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    marks = trusted.select("trusted_id", F.lit(1).alias("t"))
    known = slim.join(F.broadcast(marks) if small else marks, slim["id"] == marks["trusted_id"], "left")
    hashed = _with_hashes(known, "text", "words", "h").select("t", _grams(F.col("h"), buckets).alias("g"))
    counted = (
        hashed.select("t", F.explode_outer("g").alias("bucket"))
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("raw"), F.count("t").alias("good"))
    )
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(counted, "bucket", "left").select(
        "bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("good", F.lit(0)).alias("good")
    )
    whole = full.agg(
        F.sort_array(F.collect_list(F.struct("bucket", "raw", "good"))).alias("b"), F.sum("raw").alias("raw"), F.sum("good").alias("good")
    )
    share = F.coalesce(F.col("good") / F.nullif("raw", F.lit(0)), F.lit(0.0))  # the corpus, scaled to the trusted part's size
    return whole.select(
        F.transform("b", lambda x: F.log((x["good"] + F.lit(SMOOTHING)) / (x["raw"] * share + F.lit(SMOOTHING)))).alias("ratio")
    )


def _repeated(tri: Column) -> Column:
    """(hash, place) in order of hash, of those places whose window's hash occurs again."""
    return F.sort_array(F.transform(tri, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))


def judge(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = BUCKETS,
    threshold: float = THRESHOLD,
    result: str = "rules",
) -> DataFrame:
    """``docs`` with the struct column ``result``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept."""
    docs = docs.drop(result)
    table = ratios(docs, trusted, id_col, text_col, buckets).collect()[0]["ratio"]  # ``buckets`` figures
    ratio = F.split(F.lit(",".join(f"{x:.9g}" for x in table)), ",").cast("array<double>")  # folded to one literal
    w, h, tri, srt, rep = (free_name(docs, f"__{x}") for x in ("words", "hashes", "windows", "sorted", "repeated"))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    out = _with_hashes(docs, text_col, w, h)
    hc = F.col(h)
    out = _pinned(
        out,
        tri,
        F.when(F.size(hc) < 3, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.slice(hc, F.lit(3), F.greatest(F.size(hc) - 2, F.lit(0))), lambda x, i: F.xxhash64(F.get(hc, i), F.get(hc, i + 1), x))
        ),
    )
    tc = F.col(tri)
    nothing = F.expr("cast(array() as array<struct<h: bigint, i: int>>)")
    out = _pinned(out, srt, F.when(F.size(F.array_distinct(tc)) == F.size(tc), nothing).otherwise(_repeated(tc)))
    sc = F.col(srt)
    again = F.filter(sc, lambda x, i: (F.coalesce(F.get(sc, i - 1)["h"] == x["h"], F.lit(False))) | F.coalesce(F.get(sc, i + 1)["h"] == x["h"], F.lit(False)))
    out = _pinned(out, rep, F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))))
    grams = F.concat(hc, _pairs(hc))
    n_grams = F.size(hc) + F.greatest(F.size(hc) - 1, F.lit(0))
    total = F.aggregate(grams, F.lit(0.0), lambda acc, x: acc + F.get(ratio, F.pmod(x, F.lit(buckets)).cast("int")))
    score = F.when(n_grams > 0, total / n_grams)
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    n_words, n_repeat = F.size(F.col(w)).cast("long"), F.col(rep).cast("long")
    failed = (n_words < MIN_WORDS) | (n_repeat * 100 > n_words * MAX_REPEAT_PERCENT)
    sized = _pinned(
        out,
        result,
        F.struct(
            n_words.alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            n_repeat.alias("n_repeat_words"),
            failed.alias("base_failed"),
            score.alias("score"),
        ),
    ).drop(w, h, tri, srt, rep)
    verdict = ~F.col(f"{result}.base_failed") & F.coalesce(F.col(f"{result}.score") >= threshold, F.lit(False))
    return sized.withColumn(result, F.struct(F.col(f"{result}.*"), verdict.alias("kept")))


def keep_good(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents that the rules keep, columns as they came."""
    name = free_name(docs, "rules")
    return judge(docs, trusted, id_col, text_col, result=name, **how).where(F.col(f"{name}.kept")).select(*(F.col(f"`{c}`") for c in docs.columns))
