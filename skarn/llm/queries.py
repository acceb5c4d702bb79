"""The operators applied to their whole tables with production parameters, one query each."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm import ball_tree, bpe, classifier, fill_middle, fingerprints, html_text, packing, quality_rules, sharding, simhash, substrings, token_files, url_filter
from skarn.llm.common import table
from skarn.tables import folder

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = quality_rules.trusted_ids(table(spark, sf_dir, "labels"))
    r = quality_rules.judge(docs, trusted)
    return r.select(
        "doc_id", *(f"rules.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"))
    )


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fingerprints.edits(table(spark, sf_dir, "documents"))
    return e.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, RULES))
    return judged.withColumnRenamed("id", "page_id")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encode_documents(table(spark, sf_dir, "documents"), path, digests=True).withColumnRenamed("id", "doc_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(table(spark, sf_dir, "documents"), path).withColumnRenamed("id", "doc_id")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_text.main_text(table(spark, sf_dir, "pages"))
    return text.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "repeats.n_words", "repeats.n_removed", F.sha2("repeats.kept", 256).alias("kept_sha256"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = classifier.train(docs, table(spark, sf_dir, "labels"))
    return classifier.with_scores(docs, model).select(
        "doc_id", classifier.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def op11_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = folder(spark, "planes")
    token_files.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), where)
    read = token_files.read_tokens(spark, where)
    return read.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ball_tree.cluster_vectors(table(spark, sf_dir, "embeddings"))
    return found.drop("centroid").withColumnRenamed("id", "vec_id")


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fill_in_middle(table(spark, sf_dir, "documents"), digests=True).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_fingerprints,
        op3_simhash,
        op4_url_filter,
        op5_bpe,
        op6_packing,
        op7_sharding,
        op8_html_text,
        op9_substring_dedup,
        op10_quality_classifier,
        op11_token_planes,
        op12_ball_tree,
        op13_fill_middle,
    )
}



def _rounds_sql(rounds: int = ball_tree.ROUNDS, k: int = ball_tree.CENTROIDS) -> str:
    """The clustering with each round written out: all distances to all centroids."""
    near = """
        a{r} AS (
            SELECT row, arg_min(c, (d, c)) AS c, min(d) AS d
            FROM (SELECT row, c, list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x, m{r})
            GROUP BY row
        )"""
    move = """
        s{n} AS (
            SELECT c, i, floor(sum(v[i])::HUGEINT / count(*))::BIGINT AS e
            FROM (SELECT c, v, unnest(range(1, 65)) AS i FROM a{r} JOIN x USING (row)) GROUP BY c, i
        ), m{n} AS (
            SELECT m{r}.c, coalesce(got.m, m{r}.m) AS m FROM m{r} LEFT JOIN (SELECT c, list(e ORDER BY i) AS m FROM s{n} GROUP BY c) got ON got.c = m{r}.c
        )"""
    steps = [near.format(r=0)]
    for r in range(rounds):
        steps += [move.format(r=r, n=r + 1), near.format(r=r + 1)]
    return f"""
        WITH x AS (
            SELECT vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS v, row_number() OVER (ORDER BY vec_id) AS row
            FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
        ), m0 AS (
            SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v AS m FROM x ORDER BY c LIMIT {k}
        ), {", ".join(steps)}
        SELECT vec_id, a.c::INT AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
               (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN x USING (row) JOIN m{rounds} USING (c)
    """


ORACLES: dict[str, str] = {
    "op4_url_filter": r"""
        WITH a AS (
            SELECT page_id, CASE WHEN coalesce(strpos(url, '://'), 0) > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), b AS (
            SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM a
        ), c AS (
            SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b
        ), r(rule, h, p, v) AS (
            VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
                   ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
        ), f AS (
            SELECT page_id, host, path, rule, v FROM c LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
        )
        SELECT page_id, any_value(host) AS host, any_value(path) AS path, arg_max(rule, length(rule)) AS rule,
               coalesce(arg_max(v, length(rule)), 'allow') AS verdict
        FROM f GROUP BY page_id
    """,
    "op9_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), win AS (
            SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
        ), hit AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM win) WHERE first < doc_id
        ), gone AS (
            SELECT doc_id, list(DISTINCT k) AS ks FROM (SELECT doc_id, unnest(range(i, i + 50)) AS k FROM hit) GROUP BY doc_id
        ), kept AS (
            SELECT d.doc_id, len(w) AS n_words, coalesce(len(ks), 0) AS n_removed,
                   CASE WHEN ks IS NULL THEN w
                        ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(ks, x[2])), lambda x: x[1]) END AS k
            FROM d LEFT JOIN gone USING (doc_id)
        )
        SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept
    """,
    "op12_ball_tree": _rounds_sql(),
    "op13_fill_middle": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h FROM documents
        ), n AS (
            SELECT *, len(u) AS n, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM d
        ), f AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                        WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n
        ), p AS (
            SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle,
                   coalesce(array_to_string(u[b + 1:], ''), '') AS suffix FROM f
        )
        SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p
    """,
}
