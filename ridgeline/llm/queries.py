"""The corpus operators as queries: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
import public_tokenizers

from . import bpe, exact_dedup, hmm, importance, jaccard, language, licenses, neighbours, packing, runs, simhash, toxicity, warc
from .common import table


#: The tokenizer of the queries; the operators take its path.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, with_ids=False)


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), TOKENIZER)


def op4_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.detect(table(spark, sf_dir, "documents"), plant=True)


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_neighbours": op2_neighbours,
    "op3_bpe": op3_bpe,
    "op4_hmm": op4_hmm,
    "op5_language": op5_language,
    "op6_simhash": op6_simhash,
    "op7_warc": op7_warc,
    "op8_licenses": op8_licenses,
    "op9_toxicity": op9_toxicity,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_importance": op11_importance,
    "op12_runs": op12_runs,
    "op13_jaccard": op13_jaccard,
    "pipeline": pipeline,
}

#: CTEs for CRC-32, which DuckDB doesn't have: the table of its bytes, and the checksum of a text.
CRCS = "crcs AS (SELECT list(v ORDER BY i) AS crcs FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(i)))"


def crc32_sql(text: str) -> str:
    """The CRC-32 of a text's UTF-8 bytes, beside the table crcs."""
    code = f"hex(encode({text}))"
    values = f"list_transform(range(1, len({code}) // 2 + 1), lambda i: CAST('0x' || substr({code}, 2 * i - 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {values}), lambda c, x: xor(c >> 8, crcs[(xor(c, x) & 255) + 1])), 4294967295)"


def lowered_sql(text: str) -> str:
    return f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


#: Words between the six ASCII spaces, and words of ASCII digits, letters and whatever isn't ASCII.
SPACED, LETTERED = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def counts_sql(name: str, table: str, key: str) -> str:
    """CTEs name_words (r, id, words) and name_counts (r, bucket, n): how often a row has features of a bucket."""
    return f"""
        {name}_words AS (SELECT row_number() OVER () AS r, {key} AS id, regexp_extract_all({lowered_sql('text')}, '{LETTERED}') AS words FROM {table}),
        {name}_features AS (SELECT r, array_to_string(words[i:i + k], ' ') AS f FROM (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM {name}_words), (SELECT unnest([0, 1, 2]) AS k) WHERE i + k <= len(words)),
        {name}_buckets AS (SELECT f, {crc32_sql('f')} % 10000 AS bucket FROM (SELECT DISTINCT f FROM {name}_features), crcs),
        {name}_counts AS (SELECT r, bucket, count(*) AS n FROM {name}_features JOIN {name}_buckets USING (f) GROUP BY r, bucket)"""


ORACLE_SQL: dict[str, str] = {
    "op11_importance": f"""
        WITH {CRCS}, {counts_sql('d', 'documents', 'doc_id')}, {counts_sql('t', 'benchmark', 'item_id')},
        totals AS (SELECT (SELECT coalesce(sum(n), 0) FROM d_counts) AS all_s, (SELECT coalesce(sum(n), 0) FROM t_counts) AS all_t),
        s AS (SELECT bucket, sum(n) AS s FROM d_counts GROUP BY bucket), t AS (SELECT bucket, sum(n) AS t FROM t_counts GROUP BY bucket),
        gains AS (SELECT s.bucket, floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(all_s + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(all_t + 10000 AS DOUBLE)))) AS gain FROM s LEFT JOIN t USING (bucket), totals),
        weights AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM d_counts JOIN gains USING (bucket) GROUP BY r),
        scored AS (SELECT d.r, d.id AS doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(d.id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM d_words d LEFT JOIN weights USING (r)),
        ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (r)""",
    "op12_runs": f"""
        WITH {CRCS}, d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS given, {crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '')")} AS h FROM documents, crcs),
        p AS (SELECT r, doc_id, given, len(given) AS n, h % 10 = 0 AND len(given) > 0 AS repeats, CASE WHEN len(given) > 0 THEN h // 10 % len(given) END AS a, 3 + h // 10 % 8 AS times FROM d),
        w AS (SELECT r, doc_id, n, CASE WHEN repeats THEN list_transform(range(n), lambda i: given[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // times) END]) ELSE given END AS words FROM p),
        e AS (SELECT r, n, unnest(range(n)) AS i, unnest(words) AS word FROM w),
        same AS (SELECT x.r, y.i - x.i AS period, x.i FROM e x JOIN e y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
        stretches AS (SELECT r, period, min(i) AS start, count(*) + period AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, period ORDER BY i) AS island FROM same) GROUP BY r, period, island),
        runs AS (SELECT r, start, length, min(period) AS period FROM stretches WHERE length >= greatest(6, 4 * period) GROUP BY r, start, length),
        best AS (SELECT r, start, length, period FROM runs x WHERE NOT EXISTS (SELECT 1 FROM runs y WHERE y.r = x.r AND (y.length * x.period > x.length * y.period OR (y.length * x.period = x.length * y.period AND (y.start, y.period) < (x.start, x.period))))),
        listed AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM runs GROUP BY r),
        gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
        kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS words FROM e ANTI JOIN gone USING (r, i) GROUP BY r)
        SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
               sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept.words, '')) AS collapsed_sha256
        FROM w LEFT JOIN listed USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)""",
    "op13_jaccard": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({lowered_sql('text')}, '{SPACED}') AS words FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS i FROM w WHERE len(words) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
        links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
        reached AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reached.a, links.b FROM reached JOIN links ON links.a = reached.b),
        least AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN least ON least.doc_id = w.doc_id""",
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
        o AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS owner FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> owner THEN owner END AS refers_to
        FROM o""",
    "op10_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.text) AS text_sha256
        FROM t JOIN g ON t.text = g.text""",
}
