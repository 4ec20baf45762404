"""The registered queries of this subpackage: (spark, sf_dir) -> DataFrame, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnscale.plans.views import view

from . import fill_in_middle, line_dedup, mixing, passage_quality, personal_data, pieces, quality_rules, secret_scan, sharding, simhash, vector_codes, vector_search, warc
from .common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is a file of its project's tree, so that the path counts. A value is judged by forests that haven't seen it."""
    files = view(spark, sf_dir, "v_files")
    return secret_scan.scan_secrets(files.select("doc_id", F.col("content").alias("text"), "path"), "path", folds=4)


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op3_weighted_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op4_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_digest(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_quality_rules(table(spark, sf_dir, "documents"))


def op7_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_passage_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_quality.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.read_model(pieces.default_model(spark))
    return pieces.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), model)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.fill_in_middle_digest(table(spark, sf_dir, "documents"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data_digest(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes_digest(table(spark, sf_dir, "embeddings"))


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Plain k-means over integers, a round after another."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (
            SELECT r, x.p, min(list_sum(list_transform(list_zip(x.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * {entries} + e) AS found
            FROM cut x JOIN b{n} b ON x.p = b.p GROUP BY r, x.p)""")
        if n < rounds:
            steps.append(f"""m{n} AS (
            SELECT p, e, list(CAST(floor(CAST(total AS DOUBLE) / n) AS BIGINT) ORDER BY i) AS c
            FROM (SELECT p, found % {entries} AS e, i, sum(c[i]) AS total, count(*) AS n FROM a{n} JOIN cut USING (r, p), range(1, len(c) + 1) AS t(i) GROUP BY ALL) GROUP BY p, e),
        b{n + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{n} b LEFT JOIN m{n} m ON m.p = b.p AND m.e = b.e)""")
    return f"""
        WITH kept AS (
            SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        cut AS MATERIALIZED (SELECT r, CAST(p AS INT) AS p, q[p * len(q) // {parts} + 1 : (p + 1) * len(q) // {parts}] AS c FROM kept, range({parts}) AS t(p)),
        b0 AS MATERIALIZED (SELECT p, r - 1 AS e, c FROM cut WHERE r <= {entries}),
        {", ".join(steps)},
        coded AS (
            SELECT r, string_agg(printf('%02x', CAST(found % {entries} AS INT)), '' ORDER BY p) AS code, CAST(sum(found // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
        books AS (SELECT sha256(string_agg(CAST(c[i] AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM b{rounds}, range(1, len(c) + 1) AS t(i))
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), books"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_warc_round_trip": op2_warc_round_trip,
    "op3_weighted_fair_mix": op3_weighted_fair_mix,
    "op4_rendezvous_shards": op4_rendezvous_shards,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_simhash_anchors": op7_simhash_anchors,
    "op8_multi_index_hashing": op8_multi_index_hashing,
    "op9_passage_attention": op9_passage_attention,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_personal_data": op12_personal_data,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc_round_trip": """
        WITH rows AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
        named AS (
            SELECT page_id, url, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, min(page_id) OVER (PARTITION BY html) AS first,
                   list_transform(range(8), lambda k: CAST('0x' || substr(h, CAST(5 * k + 1 AS INT), 5) AS BIGINT)) AS parts
            FROM rows)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(parts, lambda v: concat(
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v // 32768 + 1 AS INT), 1),
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v // 1024 % 32 + 1 AS INT), 1),
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v // 32 % 32 + 1 AS INT), 1),
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v % 32 + 1 AS INT), 1))), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to, url AS target_uri
        FROM named""",
    "op3_weighted_fair_mix": r"""
        WITH docs AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                   CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS place
            FROM documents),
        by_source AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0::DOUBLE * CAST(sum(size) AS BIGINT) AS cap,
                   (ARRAY[5.0, 2.0, 1.0]::DOUBLE[])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
            FROM docs GROUP BY source),
        levels AS (
            SELECT *, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) AS budget,
                   coalesce(sum(cap) OVER (rising ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
                   sum(weight) OVER (rising ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above
            FROM by_source WINDOW rising AS (ORDER BY cap / weight, source NULLS LAST)),
        fulls AS (SELECT *, (budget - below) * weight >= cap * above AS is_full FROM levels),
        targets AS (
            SELECT source, source_size,
                   CASE WHEN is_full THEN cap
                        ELSE (budget - coalesce(sum(cap) FILTER (is_full) OVER (), 0)) * weight / sum(weight) FILTER (NOT is_full) OVER ()
                   END AS target
            FROM fulls),
        queued AS (
            SELECT row_number() OVER () AS r, doc_id, d.source, size, source_size, target,
                   CAST(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start
            FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
        parts AS (
            SELECT *, unnest(range(CAST(ceil(size / 200.0) AS BIGINT))) AS part FROM queued WHERE size > 0),
        packets AS (
            SELECT *, least(200, size - part * 200) AS words, pass * source_size + start + part * 200 + least(200, size - part * 200) AS through
            FROM parts, range(2) AS p(pass)),
        served AS (
            SELECT r, words, (SELECT CAST(floor(1.5::DOUBLE * sum(size)) AS BIGINT) FROM docs)
                   - (sum(words) OVER (ORDER BY through / target, source NULLS LAST, start, pass, part ROWS UNBOUNDED PRECEDING) - words) AS left_over
            FROM packets),
        given AS (SELECT r, CAST(sum(greatest(0, least(words, left_over))) AS BIGINT) AS n FROM served GROUP BY r)
        SELECT doc_id, size, source_size, target, coalesce(n, 0) AS taken FROM queued LEFT JOIN given USING (r)""",
    "op5_line_dedup": r"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        lines AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs),
        keyed AS (
            SELECT r, doc_id, pos, line,
                   translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM lines),
        common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
        marked AS (SELECT k.*, c.key IS NOT NULL AS gone FROM keyed k LEFT JOIN common c USING (key))
        SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY r, doc_id""",
    "op6_quality_rules": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS r, doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                   len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols
            FROM documents),
        starts AS (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM docs),
        windows AS (SELECT r, i, w[i : i + 7] AS win FROM starts),
        again AS (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM windows),
        marked AS (SELECT DISTINCT r, i + k AS at FROM again, range(8) AS t(k) WHERE n > 1),
        repeats AS (SELECT r, count(*) AS n FROM marked GROUP BY r),
        split AS (SELECT r, source, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM docs),
        lines AS (
            SELECT *, len(lw) AS words, translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw FROM split) WHERE len(lw) > 0),
        duplicates AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r),
        common AS (SELECT source, key FROM lines GROUP BY source, key HAVING count(DISTINCT r) > 10),
        gone AS (SELECT r, sum(words) AS n FROM lines l JOIN common c ON l.source IS NOT DISTINCT FROM c.source AND l.key = c.key GROUP BY r),
        counted AS (
            SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                   CAST(n_symbols AS BIGINT) AS n_symbols, CAST(coalesce(u.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed_words
            FROM docs d LEFT JOIN duplicates u USING (r) LEFT JOIN repeats p USING (r) LEFT JOIN gone g USING (r)),
        judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted)
        SELECT *, NOT base_failed AND n_words - n_removed_words >= 20 AND n_removed_words <= 0.5 * n_words AS kept FROM judged""",
    "op11_fill_in_middle": r"""
        WITH docs AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
                   regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
            FROM documents),
        drawn AS (
            SELECT *, len(units) AS n, list_transform(range(4), lambda i: CAST('0x' || substr(h, CAST(8 * i + 1 AS INT), 8) AS BIGINT)) AS draws FROM docs),
        cuts AS (
            SELECT *, least(draws[1] % (n + 1), draws[2] % (n + 1)) AS a, greatest(draws[1] % (n + 1), draws[2] % (n + 1)) AS b,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR draws[3] % 100 >= 50 THEN 'plain'
                        WHEN draws[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
            FROM drawn),
        parts AS (
            SELECT *, coalesce(array_to_string(units[1 : a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1 : b], ''), '') AS middle,
                   coalesce(array_to_string(units[b + 1 :], ''), '') AS suffix
            FROM cuts)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM parts""",
    "op13_vector_codes": _codes_sql(),
}
