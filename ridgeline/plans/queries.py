"""All queries by name, each over its whole table, and the same in SQL where SQL can say it."""

from __future__ import annotations

import json
import re
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import semantics as sem
from ..operators import binning, candidates, external, grafted, histogram, merging, oblique, patches, promotion, residuals, runlog, sampling, trees, verdicts
from ..operators.histogram import Controls
from ..sources import artifacts, chunks, corpora, files
from ..sources.corpora import ACCOUNTS, EVENTS, LINES, PARTS, Corpus, read
from ..streaming import residual_stream, run_report
from . import layout, loop, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
BINS = 16
CONTROLS = Controls()
SMALL = Controls(min_leaf=5.0)


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return add


# ---------------------------------------------------------------- the chain from a corpus to a histogram


def chain_sql(corpus: Corpus, bins: int = BINS) -> str:
    """WITH corpus, edges, binned, hist ..."""
    cells = " UNION ALL ".join(f"SELECT {i} AS feature, f{i} AS value FROM sample" for i in range(corpus.width))
    lists = ", ".join(f"list(threshold) FILTER (WHERE feature = {i}) AS e{i}" for i in range(corpus.width))
    numbers = ", ".join(f"CAST(CASE WHEN isnan(f{i}) THEN 0 ELSE coalesce(len(list_filter(e{i}, lambda e: f{i} > e)), 0) END AS INTEGER) AS b{i}" for i in range(corpus.width))
    hist = " UNION ALL ".join(f"SELECT {i} AS feature, b{i} AS bin, residual FROM binned" for i in range(corpus.width))
    order = ", ".join(corpus.features)
    return f"""
    WITH corpus AS ({corpus.sql}),
    sample AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY record_id, {order}) - 1 AS position FROM corpus) WHERE position % (SELECT greatest(1, (count(*) + 65535) // 65536) FROM corpus) = 0),
    cells AS ({cells}),
    ranked AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS rn, count(*) OVER (PARTITION BY feature) AS n, max(value) OVER (PARTITION BY feature) AS top
               FROM cells WHERE NOT isnan(value) AND abs(value) < CAST('inf' AS FLOAT)),
    picked AS (SELECT DISTINCT feature, value AS threshold FROM ranked JOIN (SELECT unnest(range(1, {bins})) AS b) ON rn = least(b * n // {bins}, n - 1) WHERE value < top),
    edges AS (SELECT feature, CAST(row_number() OVER (PARTITION BY feature ORDER BY threshold) - 1 AS INTEGER) AS bin, threshold FROM picked),
    lists AS (SELECT {lists} FROM (SELECT * FROM edges ORDER BY feature, bin)),
    binned AS (SELECT corpus.*, {numbers} FROM corpus CROSS JOIN lists),
    hist AS (SELECT feature, bin, CAST(count(*) AS DOUBLE) AS n, sum(CAST(residual AS DOUBLE)) AS s, sum(CAST(residual AS DOUBLE) * residual) AS q FROM ({hist}) GROUP BY 1, 2)"""


def kinds_sql(hist: str = "hist", most: float = CONTROLS.max_correction, least: float = CONTROLS.min_leaf, keys: str = "") -> str:
    """... totals, scan, sides, kinds: one row for each threshold and kind that passes; keys: further group columns, each with a comma after it."""
    on = "".join(f" AND t.{k.strip()} = h.{k.strip()}" for k in keys.split(",") if k.strip())
    tkeys = "".join(f"t.{k.strip()}, " for k in keys.split(",") if k.strip())
    return f""",
    totals AS (SELECT {keys}feature, sum(n) AS nt, sum(s) AS st FROM {hist} GROUP BY ALL),
    dense AS (SELECT {tkeys}t.feature, e.bin, e.threshold, nt, st, coalesce(h.n, 0) AS n, coalesce(h.s, 0) AS s
              FROM totals t JOIN edges e ON e.feature = t.feature LEFT JOIN {hist} h ON h.feature = t.feature AND h.bin = e.bin{on}),
    scan AS (SELECT {keys}feature, bin, threshold, nt, st, sum(n) OVER w AS nl, sum(s) OVER w AS sl FROM dense WINDOW w AS (PARTITION BY {keys}feature ORDER BY bin ROWS UNBOUNDED PRECEDING)),
    sides AS (SELECT *, nt - nl AS nr, st - sl AS sr, greatest(least(sl / nl, {most}), -{most}) AS cl, greatest(least((st - sl) / (nt - nl), {most}), -{most}) AS cr FROM scan WHERE nl > 0 AND nt - nl > 0),
    gains AS (SELECT *, 2 * cl * sl - nl * cl * cl AS gl, 2 * cr * sr - nr * cr * cr AS gr FROM sides),
    kinds AS (
      SELECT {keys}feature, bin, threshold, 0 AS kind_no, 'left-only' AS kind, CAST(cl AS FLOAT) AS left_correction, CAST(0 AS FLOAT) AS right_correction, gl AS gain, nl AS affected_records, nl AS left_records, nr AS right_records FROM gains WHERE nl >= {least} AND gl > 0
      UNION ALL SELECT {keys}feature, bin, threshold, 1, 'right-only', CAST(0 AS FLOAT), CAST(cr AS FLOAT), gr, nr, nl, nr FROM gains WHERE nr >= {least} AND gr > 0
      UNION ALL SELECT {keys}feature, bin, threshold, 2, 'two-leaf', CAST(cl AS FLOAT), CAST(cr AS FLOAT), gl + gr, nl + nr, nl, nr FROM gains WHERE nl >= {least} AND nr >= {least} AND gl + gr > 0)"""


ORDER_SQL = "ORDER BY gain DESC, feature, bin, kind_no"


def edges_of(spark: SparkSession, d: str, corpus: Corpus, bins: int = BINS) -> DataFrame:
    return binning.build_edges(corpus.load(spark, d), corpus.features, bins)


def prepared(spark: SparkSession, d: str, corpus: Corpus, bins: int = BINS, keep=("record_id", "residual")):
    """(rows, edges as a table, edges as lists, binned rows)"""
    rows = corpus.load(spark, d)
    listed = binning.collect_edges(binning.build_edges(rows, corpus.features, bins), corpus.width)
    table = spark.createDataFrame([(i, b, t) for i, own in enumerate(listed) for b, t in enumerate(own)], "feature int, bin int, threshold float")
    return rows, table, listed, binning.bin_rows(rows, corpus.features, listed, keep)


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


# ---------------------------------------------------------------- scans, filters, bins

NOISY = "SELECT event_id AS record_id, CAST(CASE WHEN event_id % 50 = 0 THEN 'NaN' WHEN event_id % 77 = 0 THEN 'Infinity' ELSE CAST(value AS VARCHAR) END AS FLOAT) AS x FROM events"


def noisy(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("event_id") % 50 == 0, float("nan")).when(F.col("event_id") % 77 == 0, float("inf")).otherwise(F.col("value"))
    return read(spark, d, "events").select(F.col("event_id").alias("record_id"), x.cast("float").alias("x"))


@query("scan_corpus", f"SELECT record_id, f0, f1, f2, y, p, residual FROM ({EVENTS.sql})")
def scan_corpus(spark, d):
    return EVENTS.load(spark, d).select("record_id", "f0", "f1", "f2", "y", "p", "residual")


@query("corpus_info", f"SELECT count(*) AS records, count(DISTINCT record_id) AS keys, min(record_id) AS first_key, max(record_id) AS last_key FROM ({ACCOUNTS.sql})")
def corpus_info(spark, d):
    return files.corpus_info(ACCOUNTS.load(spark, d)).select("records", "keys", "first_key", "last_key")


@query("corpus_checksum")
def corpus_checksum(spark, d):
    return files.corpus_info(EVENTS.load(spark, d))


@query("project_features", f"SELECT record_id, f2 AS f0, f0 AS f1 FROM ({EVENTS.sql})")
def project_features(spark, d):
    return binning.project(EVENTS.load(spark, d), EVENTS.features, [2, 0])


@query("finite_filter", f"SELECT count(*) AS records, count(*) FILTER (WHERE NOT isnan(x) AND NOT isinf(x)) AS finite, count(*) FILTER (WHERE isnan(x) OR isinf(x)) AS non_finite FROM ({NOISY})")
def finite_filter(spark, d):
    ok = sem.is_finite(F.col("x"))
    return noisy(spark, d).agg(F.count("*").alias("records"), F.count_if(ok).alias("finite"), F.count_if(~ok).alias("non_finite"))


@query("predicate_axis", f"SELECT record_id, NOT isnan(x) AND x > CAST(50 AS FLOAT) AS goes_right FROM ({NOISY})")
def predicate_axis(spark, d):
    return noisy(spark, d).select("record_id", sem.gt(F.col("x"), sem.single(50)).alias("goes_right"))


OBLIQUE = [(0, 0.5), (1, -1.25), (2, 2.0)]
OBLIQUE_SQL = "f0 * CAST(0.5 AS FLOAT) + f1 * CAST(-1.25 AS FLOAT) + f2 * CAST(2 AS FLOAT)"


@query("predicate_oblique", f"SELECT record_id, {OBLIQUE_SQL} + CAST(-20.5 AS FLOAT) > CAST(0 AS FLOAT) AS goes_right FROM ({EVENTS.sql})")
def predicate_oblique(spark, d):
    terms = [(F.col(f"f{i}"), w) for i, w in OBLIQUE]
    return EVENTS.load(spark, d).select("record_id", sem.gt(sem.weighted_sum(terms, 20.5), sem.single(0)).alias("goes_right"))


def strided_sql(corpus: Corpus, k: str, phase: int = 0) -> str:
    """The records of a corpus whose position and phase add up to a multiple of k."""
    return f"SELECT * FROM (SELECT *, row_number() OVER (ORDER BY record_id) - 1 AS position, count(*) OVER () AS n FROM ({corpus.sql})) WHERE (position + {phase}) % ({k}) = 0"


@query("stride_filter", f"SELECT record_id, residual FROM ({strided_sql(ACCOUNTS, '7')})")
def stride_filter(spark, d):
    return binning.every(ACCOUNTS.load(spark, d), 7).select("record_id", "residual")


@query("quantile_edges", chain_sql(PARTS, 8) + " SELECT feature, bin, threshold FROM edges")
def quantile_edges(spark, d):
    return edges_of(spark, d, PARTS, 8)


@query("build_bins", chain_sql(ACCOUNTS) + " SELECT feature, bin, threshold FROM edges")
def build_bins(spark, d):
    return edges_of(spark, d, ACCOUNTS)


@query("effective_bins", chain_sql(LINES) + " SELECT feature, count(*) + 1 AS effective_bins FROM edges GROUP BY feature")
def effective_bins(spark, d):
    return binning.effective_bins(edges_of(spark, d, LINES))


@query("feature_scale", chain_sql(EVENTS) + """, l AS (SELECT feature, list(threshold ORDER BY bin) AS e, count(*) AS n FROM edges GROUP BY feature)
    SELECT feature, CASE WHEN n >= 4 AND e[3 * n // 4 + 1] - e[n // 4 + 1] > 0 THEN e[3 * n // 4 + 1] - e[n // 4 + 1] ELSE CAST(1 AS FLOAT) END AS scale FROM l""")
def feature_scale(spark, d):
    return binning.feature_scale(edges_of(spark, d, EVENTS))


@query("bin_rows", chain_sql(EVENTS) + " SELECT record_id, b0, b1, b2 FROM binned")
def bin_rows(spark, d):
    return prepared(spark, d, EVENTS)[3].select("record_id", "b0", "b1", "b2")


@query("bin_of", chain_sql(PARTS, 8) + " SELECT record_id, f1, b1 AS bin FROM binned")
def bin_of(spark, d):
    rows, _, listed, _ = prepared(spark, d, PARTS, 8)
    return rows.select("record_id", "f1", binning.bin_of("f1", listed[1]).alias("bin"))


@query("occupancy", chain_sql(ACCOUNTS) + " SELECT b0 AS bin, count(*) AS records FROM binned GROUP BY b0")
def occupancy(spark, d):
    return binning.occupancy(prepared(spark, d, ACCOUNTS)[3], 0)


# ---------------------------------------------------------------- histograms and stumps


@query("histogram", chain_sql(EVENTS) + " SELECT feature, bin, n, round(s, 4) AS s, round(q, 4) AS q FROM hist")
def histogram_query(spark, d):
    return rounded(histogram.histogram(prepared(spark, d, EVENTS)[3], 3), s=4, q=4)


@query("histogram_masked", chain_sql(EVENTS) + ", m AS (SELECT CASE WHEN b0 > 7 THEN 1 ELSE 0 END AS leaf, * FROM binned) SELECT leaf, 1 AS feature, b1 AS bin, CAST(count(*) AS DOUBLE) AS n, round(sum(CAST(residual AS DOUBLE)), 4) AS s FROM m GROUP BY leaf, b1")
def histogram_masked(spark, d):
    binned = prepared(spark, d, EVENTS)[3].withColumn("leaf", F.when(F.col("b0") > 7, 1).otherwise(0))
    return rounded(histogram.histogram(binned, 3, ["leaf"]).where("feature = 1").select("leaf", "feature", "bin", "n", "s"), s=4)


@query("histogram_merge", chain_sql(PARTS) + " SELECT feature, bin, n, round(s, 4) AS s FROM hist")
def histogram_merge(spark, d):
    binned = prepared(spark, d, PARTS)[3]
    parts = [histogram.histogram(binned.where(F.col("record_id") % 3 == k), 2) for k in range(3)]
    return rounded(histogram.merge(*parts).select("feature", "bin", "n", "s"), s=4)


@query("histogram_subtract", chain_sql(PARTS) + ", o AS (SELECT 0 AS feature, b0 AS bin, residual FROM binned WHERE record_id % 3 <> 0 UNION ALL SELECT 1, b1, residual FROM binned WHERE record_id % 3 <> 0), g AS (SELECT feature, bin, CAST(count(*) AS DOUBLE) AS n, sum(CAST(residual AS DOUBLE)) AS s FROM o GROUP BY 1, 2) SELECT h.feature, h.bin, coalesce(g.n, 0) AS n, round(coalesce(g.s, 0), 4) AS s FROM hist h LEFT JOIN g USING (feature, bin)")
def histogram_subtract(spark, d):
    binned = prepared(spark, d, PARTS)[3]
    rest = histogram.subtract(histogram.histogram(binned, 2), histogram.histogram(binned.where("record_id % 3 = 0"), 2))
    return rest.select("feature", "bin", "n", (F.round("s", 4) + 0.0).alias("s"))


@query("prefix_scan", chain_sql(EVENTS) + kinds_sql() + " SELECT feature, bin, threshold, nl, round(sl, 4) AS sl, nt - nl AS nr, round(st - sl, 4) AS sr FROM scan")
def prefix_scan(spark, d):
    _, edges, _, binned = prepared(spark, d, EVENTS)
    return rounded(histogram.prefix_scan(histogram.histogram(binned, 3), edges), sl=4, sr=4)


STUMP_COLUMNS = "feature, bin, threshold, kind, left_correction, right_correction, gain, left_records, right_records, affected_records"


def stumps(corpus: Corpus, controls: Controls = CONTROLS):
    def run(spark, d):
        _, edges, _, binned = prepared(spark, d, corpus)
        found = histogram.search_stumps(histogram.histogram(binned, corpus.width), edges, controls)
        return rounded(found.select(*STUMP_COLUMNS.split(", ")), gain=3, left_correction=3, right_correction=3)

    return run


def stumps_sql(corpus: Corpus, limit: int = 16) -> str:
    return chain_sql(corpus) + kinds_sql() + f", top AS (SELECT * FROM kinds {ORDER_SQL} LIMIT {limit}) SELECT feature, bin, threshold, kind, round(left_correction, 3) AS left_correction, round(right_correction, 3) AS right_correction, round(gain, 3) AS gain, left_records, right_records, affected_records FROM top"


for _name, _corpus in (("search_stumps", LINES), ("topk_stumps", EVENTS), ("search_stumps_accounts", ACCOUNTS), ("search_stumps_parts", PARTS)):
    query(_name, stumps_sql(_corpus))(stumps(_corpus))


@query("rank_per_feature", chain_sql(EVENTS) + kinds_sql() + ", r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY gain DESC, bin, kind_no) AS place FROM kinds) SELECT feature, bin, kind, round(gain, 3) AS gain FROM r WHERE place <= 2")
def rank_per_feature(spark, d):
    return stumps(EVENTS, Controls(top_k=1000, max_per_feature=2))(spark, d).select("feature", "bin", "kind", "gain")


@query("union_kinds", chain_sql(EVENTS) + kinds_sql() + " SELECT kind, count(*) AS splits, round(max(gain), 3) AS best FROM kinds GROUP BY kind")
def union_kinds(spark, d):
    _, edges, _, binned = prepared(spark, d, EVENTS)
    found = histogram.split_kinds(histogram.prefix_scan(histogram.histogram(binned, 3), edges), CONTROLS)
    return found.groupBy("kind").agg(F.count("*").alias("splits"), F.round(F.max("gain"), 3).alias("best"))


@query("join_threshold", chain_sql(EVENTS) + " SELECT h.feature, h.bin, e.threshold, h.n FROM hist h JOIN edges e USING (feature, bin)")
def join_threshold(spark, d):
    _, edges, _, binned = prepared(spark, d, EVENTS)
    return histogram.with_threshold(histogram.histogram(binned, 3), edges)


@query("brute_force_stump", f"""WITH c AS ({PARTS.sql}), cells AS (SELECT 0 AS feature, f0 AS value, residual FROM c UNION ALL SELECT 1, f1, residual FROM c),
    v AS (SELECT feature, value, count(*) AS n, sum(CAST(residual AS DOUBLE)) AS s FROM cells GROUP BY 1, 2),
    w AS (SELECT feature, value, sum(n) OVER a AS nl, sum(s) OVER a AS sl, sum(n) OVER (PARTITION BY feature) AS nt, sum(s) OVER (PARTITION BY feature) AS st FROM v WINDOW a AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING)),
    g AS (SELECT feature, value AS threshold, sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) AS gain, nl FROM w WHERE nl >= 50 AND nt - nl >= 50),
    r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY gain DESC, threshold) AS place FROM g)
    SELECT feature, threshold, round(gain, 3) AS gain, CAST(nl AS BIGINT) AS left_records FROM r WHERE place = 1""")
def brute_force_stump(spark, d):
    rows = PARTS.load(spark, d)
    own = [oblique.running_sums(rows.select(F.col(f"f{i}").alias("value"), "residual")).withColumn("feature", F.lit(i)) for i in range(2)]
    scan = own[0].unionByName(own[1]).where("nl >= 50 AND nr >= 50")
    scan = scan.withColumn("gain", F.col("sl") * F.col("sl") / F.col("nl") + F.col("sr") * F.col("sr") / F.col("nr"))
    best = scan.withColumn("place", F.row_number().over(W.partitionBy("feature").orderBy(F.desc("gain"), "value"))).where("place = 1")
    return best.select("feature", F.col("value").alias("threshold"), F.round("gain", 3).alias("gain"), F.col("nl").cast("long").alias("left_records"))


EXPLAINED = chain_sql(EVENTS) + ", m AS (SELECT feature, sum(s) / sum(n) AS mean FROM hist GROUP BY feature), v AS (SELECT feature, sum(n * pow(s / n - mean, 2)) AS explained FROM hist JOIN m USING (feature) GROUP BY feature)"


@query("streaming_histogram", chain_sql(EVENTS) + " SELECT feature, bin, n, round(s, 4) AS s FROM hist")
def streaming_histogram(spark, d):
    _, _, listed, _ = prepared(spark, d, EVENTS)
    table = read(spark, d, "events")
    stream = spark.readStream.schema(table.schema).parquet(f"{d}/events.parque[t]")  # a pattern, as the table may be one file or a folder
    made = residual_stream.streaming_histogram(EVENTS.shape(stream), EVENTS.features, listed)
    name = f"histogram_{uuid.uuid4().hex}"
    running = made.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{store.shared_dir(spark)}/stream-{name}").trigger(availableNow=True).start()
    running.awaitTermination()
    return rounded(spark.table(name).select("feature", "bin", "n", "s"), s=4)


@query("explained_variance", EXPLAINED + " SELECT feature, round(explained, 3) AS explained FROM v")
def explained_variance(spark, d):
    return rounded(histogram.explained_variance(histogram.histogram(prepared(spark, d, EVENTS)[3], 3)), explained=3)


@query("error_ranked", EXPLAINED + " SELECT feature FROM (SELECT * FROM v ORDER BY explained DESC, feature LIMIT 2)")
def error_ranked(spark, d):
    return sampling.error_ranked(histogram.histogram(prepared(spark, d, EVENTS)[3], 3), 2)


@query("wide_histogram", f"""WITH c AS ({corpora.VECTORS_SQL}), cells AS (SELECT CAST(i - 1 AS INTEGER) AS feature, x[i] AS value, residual FROM c, range(1, 65) t(i))
    SELECT feature, CAST((value > CAST(-0.1 AS FLOAT))::INT + (value > CAST(0 AS FLOAT))::INT + (value > CAST(0.1 AS FLOAT))::INT AS INTEGER) AS bin, CAST(count(*) AS DOUBLE) AS n, round(sum(CAST(residual AS DOUBLE)), 4) AS s FROM cells GROUP BY 1, 2""")
def wide_histogram(spark, d):
    made = histogram.wide_histogram(corpora.vectors(spark, d), [[-0.1, 0.0, 0.1]] * 64)
    return made.select("feature", "bin", "n", F.round("s", 4).alias("s"))


# ---------------------------------------------------------------- residuals

HIDDEN = residuals.Model([{"id": "h", "squash": "TANH", "bias": -0.5, "in": [("f0", 0.02)]}, {"id": "o", "squash": "IDENTITY", "bias": 1.0, "in": [("h", 40.0), ("f2", 0.25)]}], "o")


@query("compute_residuals", f"SELECT record_id, round(residual, 3) AS residual, round(residual, 3) AS correction FROM (SELECT record_id, y - CAST(1.0 + tanh(-0.5 + CAST(f0 AS DOUBLE) * 0.02) * 40.0 + CAST(f2 AS DOUBLE) * 0.25 AS FLOAT) AS residual FROM ({EVENTS.sql}))")
def compute_residuals(spark, d):
    return rounded(residuals.compute_residuals(EVENTS.load(spark, d), HIDDEN), residual=3, correction=3)


TWO = residuals.Model([{"id": "a", "squash": "IDENTITY", "bias": 0.0, "in": [("f0", 1.0)]}, {"id": "b", "squash": "LOGISTIC", "bias": -1.0, "in": [("f1", 0.125)]}], ["a", "b"])
TWO_SQL = f"""WITH c AS (SELECT record_id, CAST(y AS DOUBLE) AS y0, CAST(CASE WHEN f2 > 4 THEN 0.75 ELSE 0.25 END AS DOUBLE) AS y1, CAST(f0 AS DOUBLE) AS p0, CAST(f1 AS DOUBLE) * 0.125 - 1.0 AS h1 FROM ({EVENTS.sql})),
    r AS (SELECT record_id, 0 AS output, y0 - p0 AS residual, y0 - p0 AS correction FROM c UNION ALL SELECT record_id, 1, y1 - 1 / (1 + exp(-h1)), ln(y1 / (1 - y1)) - h1 FROM c)"""


def two_outputs(spark: SparkSession, d: str) -> DataFrame:
    rows = EVENTS.load(spark, d).withColumn("y1", F.when(F.col("f2") > 4, 0.75).otherwise(0.25).cast("float"))
    return residuals.residuals_by_output(rows, TWO, ["y", "y1"])


@query("compute_residuals_outputs", TWO_SQL + " SELECT record_id, output, round(residual, 3) AS residual, round(correction, 3) AS correction FROM r")
def compute_residuals_outputs(spark, d):
    return two_outputs(spark, d).select("record_id", "output", *[F.round(F.col(c).cast("double"), 3).alias(c) for c in ("residual", "correction")])


@query("local_mse_outputs", TWO_SQL + ", m AS (SELECT record_id, avg(residual * residual) AS m FROM r GROUP BY record_id) SELECT round(avg(m), 3) AS mse FROM m")
def local_mse_outputs(spark, d):
    return rounded(residuals.mean_of_outputs(two_outputs(spark, d)), mse=3)


@query("residual_stats", f"SELECT count(*) AS records, round(avg(r), 6) AS mean, round(avg(r * r) - avg(r) * avg(r), 4) AS variance, round(avg(abs(r)), 6) AS mae, round(sum(r * r), 2) AS sse, round(avg(r * r), 4) AS mse, min(r) AS least, max(r) AS most, 0::BIGINT AS non_finite FROM (SELECT CAST(residual AS DOUBLE) AS r FROM ({EVENTS.sql}))")
def residual_stats(spark, d):
    return rounded(residuals.stats(EVENTS.load(spark, d)), mean=6, variance=4, mae=6, sse=2, mse=4)


@query("residual_quantiles", f"""WITH r AS (SELECT abs(residual) AS a, row_number() OVER (ORDER BY abs(residual) DESC) - 1 AS at_unix, count(*) OVER () AS n FROM ({LINES.sql}))
    SELECT p AS share, a AS residual FROM r, (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE), (0.999::DOUBLE)) t(p) WHERE at_unix = CAST(floor((1 - p) * (n - 1) + 0.5) AS BIGINT)""")
def residual_quantiles(spark, d):
    found = residuals.quantiles(LINES.load(spark, d))
    return spark.createDataFrame([(float(k[1:]) / 100, v) for k, v in found.items()], "share double, residual float")


@query("tail_counts", f"WITH r AS (SELECT CAST(residual AS DOUBLE) AS r FROM ({LINES.sql})), s AS (SELECT sqrt(avg(r * r) - avg(r) * avg(r)) AS sigma FROM r) SELECT count(*) FILTER (WHERE abs(r) > 2 * sigma) AS beyond_2, count(*) FILTER (WHERE abs(r) > 3 * sigma) AS beyond_3 FROM r, s")
def tail_counts(spark, d):
    return residuals.tail_counts(LINES.load(spark, d))


@query("top_residuals", f"SELECT record_id, residual FROM ({EVENTS.sql}) ORDER BY abs(residual) DESC, record_id LIMIT 32")
def top_residuals(spark, d):
    return residuals.top_residuals(EVENTS.load(spark, d))


@query("top_percent_share", f"WITH r AS (SELECT CAST(residual AS DOUBLE) AS r, row_number() OVER (ORDER BY abs(residual) DESC) AS at_unix, count(*) OVER () AS n FROM ({LINES.sql})) SELECT round(sum(r * r) FILTER (WHERE at_unix <= greatest(1, n // 100)) / sum(r * r), 6) AS share FROM r")
def top_percent_share(spark, d):
    return rounded(residuals.top_share(LINES.load(spark, d)), share=6)


@query("local_mse", f"SELECT round(avg(CAST(residual AS DOUBLE) * residual), 4) AS mse FROM ({ACCOUNTS.sql})")
def local_mse(spark, d):
    return ACCOUNTS.load(spark, d).agg(F.round(residuals.mse(F.col("y"), F.col("p")), 4).alias("mse"))


# ---------------------------------------------------------------- patches, trees, lines

TREE = patches.split(1, 11.0, patches.leaf(0.0), patches.split(0, 50.0, patches.leaf(-0.5), patches.leaf(9.75)))
TREE_SQL = "CAST(CASE WHEN f1 > CAST(11 AS FLOAT) THEN CASE WHEN f0 > CAST(50 AS FLOAT) THEN 9.75 ELSE -0.5 END ELSE 0 END AS FLOAT)"


@query("evaluate_patch", f"SELECT record_id, {TREE_SQL} AS correction FROM ({EVENTS.sql})")
def evaluate_patch(spark, d):
    return EVENTS.load(spark, d).select("record_id", patches.value_of(TREE).alias("correction"))


@query("apply_patch_residuals", f"SELECT record_id, residual - {TREE_SQL} AS residual FROM ({EVENTS.sql})")
def apply_patch_residuals(spark, d):
    return patches.apply(EVENTS.load(spark, d), TREE).select("record_id", "residual")


@query("scale_patch", f"SELECT record_id, {TREE_SQL} * CAST(0.5 AS FLOAT) AS correction FROM ({EVENTS.sql})")
def scale_patch(spark, d):
    return EVENTS.load(spark, d).select("record_id", patches.value_of(patches.scaled(TREE, 0.5)).alias("correction"))


@query("evaluate_on_bins", chain_sql(EVENTS) + ", t AS (SELECT threshold FROM edges WHERE feature = 0 AND bin = 7) SELECT record_id, CAST(CASE WHEN f0 > threshold THEN 2 ELSE -1 END AS FLOAT) AS correction FROM corpus, t")
def evaluate_on_bins(spark, d):
    _, _, listed, binned = prepared(spark, d, EVENTS)
    node = patches.split(0, listed[0][7], patches.leaf(-1.0), patches.leaf(2.0))
    return binned.select("record_id", patches.value_on_bins(node, listed).alias("correction"))


TREES_SQL = """SELECT p_partkey, '{"left":{"correction":0.0},"right":' || CASE WHEN p_partkey % 3 = 0 THEN '{"correction":' || (p_partkey % 7) || '.5}' ELSE '{"left":{"correction":0.0},"right":{"correction":-' || (p_partkey % 5 + 1) || '.0},"terms":[[2,1.0]],"threshold":' || p_size || '.0}' END || ',"terms":[[1,1.0]],"threshold":11.0}' AS tree FROM part"""


@query("patch_folds", f"""SELECT p_partkey, substr(sha256('[0,' || tree || ']'), 1, 16) AS id, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 2 END AS depth, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 2 END AS splits, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 2 END AS zero_leaves,
    CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 7 + 0.5 ELSE p_partkey % 5 + 1.0 END::DOUBLE AS largest, CASE WHEN p_partkey % 3 = 0 THEN [1] ELSE [1, 2] END::INTEGER[] AS features FROM ({TREES_SQL})""")
def patch_folds(spark, d):
    read(spark, d, "part").createOrReplaceTempView("part_of_trees")
    return patches.folds(spark.sql(TREES_SQL.replace("FROM part", "FROM part_of_trees")), "p_partkey", "tree")



@query("path_filter", chain_sql(EVENTS) + " SELECT record_id FROM binned WHERE b1 > 7 AND NOT b0 > 7")
def path_filter(spark, d):
    return prepared(spark, d, EVENTS)[3].where(trees.reaches([(1, 7, 0.0, True), (0, 7, 0.0, False)])).select("record_id")


def tree_rows(spark, found, most=CONTROLS.max_correction) -> DataFrame:
    rows = [(t.depth, len(t.leaves), round(t.gain, 1), round(t.affected, 1)) for t in found]
    return spark.createDataFrame(rows, "depth int, leaves int, gain double, affected_records double")


BEST_TWO = "SELECT * FROM kinds WHERE kind_no = 2 ORDER BY gain DESC, feature, bin LIMIT 1"


@query("grow_tree_level", chain_sql(EVENTS) + kinds_sql() + f""", root AS ({BEST_TWO}),
    marked AS (SELECT CASE WHEN CASE root.feature WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END > root.bin THEN 1 ELSE 0 END AS leaf, binned.* FROM binned, root),
    cells2 AS (SELECT leaf, 0 AS feature, b0 AS bin, residual FROM marked UNION ALL SELECT leaf, 1, b1, residual FROM marked UNION ALL SELECT leaf, 2, b2, residual FROM marked),
    hist2 AS (SELECT leaf, feature, bin, CAST(count(*) AS DOUBLE) AS n, sum(CAST(residual AS DOUBLE)) AS s FROM cells2 GROUP BY 1, 2, 3)"""
    + kinds_sql("hist2", keys="leaf, ").replace("totals", "totals2").replace("dense", "dense2").replace("scan AS", "scan2 AS").replace("FROM scan ", "FROM scan2 ").replace("sides", "sides2").replace("gains", "gains2").replace("kinds", "kinds2")
    + """, best2 AS (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY gain DESC, feature, bin) AS place FROM kinds2 WHERE kind_no = 2)
    SELECT 1 AS depth, 2 AS leaves, round(gain, 1) AS gain FROM root UNION ALL
    SELECT 2, CAST(2 + count(*) AS INTEGER), round(sum(gain) + coalesce((SELECT sum(CASE WHEN leaf = 0 THEN g0 ELSE g1 END) FROM (SELECT 0 AS leaf UNION ALL SELECT 1), (SELECT 2 * left_correction * left_correction * left_records - left_records * left_correction * left_correction AS g0, right_records * right_correction * right_correction AS g1 FROM root) WHERE leaf NOT IN (SELECT leaf FROM best2 WHERE place = 1)), 0), 1) FROM best2 WHERE place = 1""")
def grow_tree_level(spark, d):
    _, edges, _, binned = prepared(spark, d, EVENTS)
    return tree_rows(spark, trees.grow_tree(binned, edges, 3, CONTROLS, max_depth=2)).select("depth", "leaves", "gain")


def numbered(sql: str, mark: str) -> str:
    """The steps of kinds_sql under names of their own."""
    return re.sub(r"\b(totals|dense|scan|sides|gains|kinds)\b", rf"\g<1>{mark}", sql)


def leaf_hist_sql(rows: str, keys: str = "leaf, ") -> str:
    cells = " UNION ALL ".join(f"SELECT {keys}{i} AS feature, b{i} AS bin, residual FROM {rows}" for i in range(3))
    return f"SELECT {keys}feature, bin, CAST(count(*) AS DOUBLE) AS n, sum(CAST(residual AS DOUBLE)) AS s FROM ({cells}) GROUP BY ALL"


def goes_right_sql(split: str) -> str:
    return f"(CASE {split}.feature WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END > {split}.bin)"


def snapshot_sql(rows: str, step: int) -> str:
    """The tree of a step as one row; leaves are numbered as in a heap, from 1."""
    most = CONTROLS.max_correction
    sums = f"SELECT leaf, count(*) AS n, sum(CAST(residual AS DOUBLE)) AS s FROM {rows} GROUP BY leaf"
    return f"SELECT {step} AS step, CAST(max(floor(log2(leaf))) AS INTEGER) AS depth, CAST(count(*) AS INTEGER) AS leaves, sum(2 * c * s - n * c * c) AS gain, CAST(sum(CASE WHEN c <> 0 THEN n ELSE 0 END) AS DOUBLE) AS affected_records FROM (SELECT *, greatest(least(s / n, {most}), -{most}) AS c FROM ({sums}))"


def grown_sql(steps: int, choose) -> str:
    """Growth in steps: choose gives the splits of a step, one at most for each leaf, out of kinds<step>; the last tree of each depth is left."""
    out, rows = chain_sql(EVENTS) + ", rows0 AS (SELECT 1 AS leaf, b0, b1, b2, residual FROM binned)", []
    for i in range(steps):
        out += f", hist_{i} AS ({leaf_hist_sql(f'rows{i}')})" + numbered(kinds_sql(f"hist_{i}", keys="leaf, "), f"_{i}")
        out += f", split{i} AS ({choose(i)}), rows{i + 1} AS (SELECT CASE WHEN split{i}.leaf IS NULL THEN r.leaf ELSE 2 * r.leaf + {goes_right_sql(f'split{i}')}::INTEGER END AS leaf, b0, b1, b2, residual FROM rows{i} r LEFT JOIN split{i} ON r.leaf = split{i}.leaf)"
        rows.append(snapshot_sql(f"rows{i + 1}", i))
    return out + f", snaps AS ({' UNION ALL '.join(rows)}) SELECT depth, leaves, round(gain, 1) AS gain, round(affected_records, 1) AS affected_records FROM snaps WHERE depth > 0 QUALIFY row_number() OVER (PARTITION BY depth ORDER BY step DESC) = 1"


def best_of_all_sql(step: int) -> str:
    """The best split of any leaf; growth ends where that leaf is as deep as leaves may be."""
    return f"SELECT * FROM (SELECT * FROM kinds_{step} WHERE kind_no = 2 ORDER BY gain DESC, feature, bin LIMIT 1) WHERE leaf < 8"


def best_of_each_sql(step: int) -> str:
    """The best split of each leaf; the first step's is the root, which is given."""
    given = " AND feature = 1 AND bin = 5" if step == 0 else ""
    return f"SELECT * FROM kinds_{step} WHERE kind_no = 2{given} QUALIFY row_number() OVER (PARTITION BY leaf ORDER BY gain DESC, feature, bin) = 1"


@query("grow_tree_best_first", grown_sql(7, best_of_all_sql))
def grow_tree_best_first(spark, d):
    _, edges, _, binned = prepared(spark, d, EVENTS)
    return tree_rows(spark, trees.grow_tree(binned, edges, 3, CONTROLS, max_depth=3, best_first=True))


@query("grow_tree_rooted", grown_sql(2, best_of_each_sql))
def grow_tree_rooted(spark, d):
    _, edges, _, binned = prepared(spark, d, EVENTS)
    return tree_rows(spark, trees.grow_tree(binned, edges, 3, CONTROLS, max_depth=2, root=(1, 5)))


@query("root_features", chain_sql(EVENTS) + kinds_sql() + ", f AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY gain DESC, bin, kind_no) AS place FROM kinds) SELECT feature, bin, round(gain, 3) AS gain FROM f WHERE place = 1 ORDER BY gain DESC, feature LIMIT 2")
def root_features(spark, d):
    found = stumps(EVENTS, Controls(top_k=3, max_per_feature=1))(spark, d)
    return found.orderBy(F.desc("gain"), "feature").limit(2).select("feature", "bin", "gain")


def boosted_sql(rounds: int) -> str:
    """Rounds of the best stump, each on what the stumps before leave."""
    out = chain_sql(EVENTS) + ", rows0 AS (SELECT b0, b1, b2, residual FROM binned)"
    for i in range(rounds):
        out += f", hist_{i} AS ({leaf_hist_sql(f'rows{i}', '')})" + numbered(kinds_sql(f"hist_{i}"), f"_{i}")
        out += f", best{i} AS (SELECT * FROM kinds_{i} {ORDER_SQL} LIMIT 1), rows{i + 1} AS (SELECT b0, b1, b2, residual - CASE WHEN {goes_right_sql(f'best{i}')} THEN right_correction ELSE left_correction END AS residual FROM rows{i}, best{i})"
    found = " UNION ALL ".join(f"SELECT {i} AS round, feature, CAST(threshold AS DOUBLE) AS threshold, round(CAST(left_correction AS DOUBLE), 3) AS left_correction, round(CAST(right_correction AS DOUBLE), 3) AS right_correction FROM best{i}" for i in range(rounds))
    return out + " " + found


@query("boost_rounds", boosted_sql(3))
def boost_rounds(spark, d):
    rows, edges, listed, binned = prepared(spark, d, EVENTS)
    found = loop.boost(binned, edges, listed, 3, CONTROLS, 3)
    return spark.createDataFrame([(i, p["terms"][0][0], p["threshold"], round(p["left"]["correction"], 3), round(p["right"]["correction"], 3)) for i, p in enumerate(found)], "round int, feature int, threshold double, left_correction double, right_correction double")


LINE = [(0, 0.02), (1, 0.01)]


@query("oblique_prefix_scan", f"""WITH c AS (SELECT f0 * CAST(0.02 AS FLOAT) + f1 * CAST(0.01 AS FLOAT) + CAST(0 AS FLOAT) AS value, residual FROM ({PARTS.sql})),
    v AS (SELECT value, count(*) AS n, sum(CAST(residual AS DOUBLE)) AS s FROM c GROUP BY value),
    w AS (SELECT value, sum(n) OVER a AS nl, sum(s) OVER a AS sl, sum(n) OVER () AS nt, sum(s) OVER () AS st FROM v WINDOW a AS (ORDER BY value ROWS UNBOUNDED PRECEDING))
    SELECT value AS threshold, round(sl * sl / nl + (st - sl) * (st - sl) / (nt - nl), 2) AS gain, CAST(nl AS DOUBLE) AS left_records, CAST(nt - nl AS DOUBLE) AS right_records FROM w
    WHERE nl >= 50 AND nt - nl >= 50 ORDER BY sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) DESC, value LIMIT 1""")
def oblique_prefix_scan(spark, d):
    return rounded(oblique.best_threshold(PARTS.load(spark, d), LINE, CONTROLS).select("threshold", "gain", "left_records", "right_records"), gain=2)


def best_line_sql(name: str, lines: str, same: float = oblique.SAME) -> str:
    """The best split along some lines (line, w0, w1), the first of equal ones: w0, w1, threshold, gain."""
    most, least = CONTROLS.max_correction, CONTROLS.min_leaf
    return f""", {name}_values AS (SELECT line, f0 * CAST(w0 AS FLOAT) + f1 * CAST(w1 AS FLOAT) + CAST(0 AS FLOAT) AS value, CAST(count(*) AS DOUBLE) AS n, sum(CAST(residual AS DOUBLE)) AS s FROM corpus, {lines} GROUP BY ALL),
    {name}_sums AS (SELECT line, value, sum(n) OVER a AS nl, sum(s) OVER a AS sl, sum(n) OVER (PARTITION BY line) AS nt, sum(s) OVER (PARTITION BY line) AS st FROM {name}_values WINDOW a AS (PARTITION BY line ORDER BY value ROWS UNBOUNDED PRECEDING)),
    {name}_sides AS (SELECT *, greatest(least(sl / nl, {most}), -{most}) AS cl, greatest(least((st - sl) / (nt - nl), {most}), -{most}) AS cr FROM {name}_sums WHERE nl >= {least} AND nt - nl >= {least}),
    {name}_gains AS (SELECT line, value, 2 * cl * sl - nl * cl * cl + 2 * cr * (st - sl) - (nt - nl) * cr * cr AS gain FROM {name}_sides),
    {name} AS (SELECT w0, w1, value AS threshold, gain FROM (SELECT * FROM {name}_gains QUALIFY row_number() OVER (PARTITION BY line ORDER BY gain DESC, value) = 1) JOIN {lines} USING (line)
        WHERE gain > 0 AND gain >= (SELECT max(gain) FROM {name}_gains) * (1 - {same}::DOUBLE) ORDER BY line LIMIT 1)"""


SCALE_SQL = "coalesce((SELECT CASE WHEN n >= 4 AND e[3 * n // 4 + 1] - e[n // 4 + 1] > 0 THEN e[3 * n // 4 + 1] - e[n // 4 + 1] ELSE 1 END FROM listed WHERE feature = {}), 1)::FLOAT::DOUBLE"


@query("search_oblique", chain_sql(PARTS) + f""", listed AS (SELECT feature, list(threshold ORDER BY bin) AS e, count(*) AS n FROM edges GROUP BY feature),
    pairs AS (SELECT line, 1::DOUBLE / {SCALE_SQL.format(0)} AS w0, half::DOUBLE / {SCALE_SQL.format(1)} AS w1 FROM (VALUES (0, 0.5), (1, -0.5)) t(line, half))""" + best_line_sql("found", "pairs") + """,
    changes AS (SELECT line, w0 * a::DOUBLE AS w0, w1 * b::DOUBLE AS w1 FROM found, (VALUES (0, 0.8, 1.0), (1, 1.25, 1.0), (2, 1.0, 0.8), (3, 1.0, 1.25)) t(line, a, b))""" + best_line_sql("changed", "changes") + f""",
    steps AS (SELECT 0 AS step, * FROM found UNION ALL SELECT 1, * FROM changed WHERE gain > (SELECT gain FROM found) * (1 + {oblique.SAME}::DOUBLE))
    SELECT 0 AS first_feature, round(w0, 9) AS first_weight, 1 AS second_feature, round(w1, 9) AS second_weight, threshold::DOUBLE AS threshold, round(gain, 2) AS gain FROM steps ORDER BY step DESC LIMIT 1""")
def search_oblique(spark, d):
    rows = PARTS.load(spark, d).persist()
    scales = {r.feature: r.scale for r in binning.feature_scale(edges_of(spark, d, PARTS)).collect()}
    terms, best = oblique.search(rows, [scales.get(i, 1.0) for i in range(2)], CONTROLS, 0, rounds=1)
    rows.unpersist()
    found = [(*(x for i, w in terms for x in (i, round(w, 9))), float(best.threshold), round(best.gain, 2))] if best else []
    return spark.createDataFrame(found, "first_feature int, first_weight double, second_feature int, second_weight double, threshold double, gain double")


# ---------------------------------------------------------------- samples and joins


@query("sample_stride", f"SELECT record_id, residual, CAST(1 AS FLOAT) AS weight FROM ({strided_sql(ACCOUNTS, '(n + 1999) // 2000')})")
def sample_stride(spark, d):
    return sampling.stride(ACCOUNTS.load(spark, d), 2000).select("record_id", "residual", "weight")


#: A record's draw: below its chance times 2 ** 52 it is taken.
DRAW_SQL = "CAST('0x' || substr(md5(CAST(record_id AS VARCHAR) || ':42'), 1, 13) AS BIGINT)"
STRATA_SQL = f"SELECT *, CAST((rn >= n // 4)::INT + (rn >= 2 * n // 4)::INT + (rn >= 3 * n // 4)::INT AS INTEGER) AS stratum FROM (SELECT *, row_number() OVER (ORDER BY abs(residual), record_id) - 1 AS rn, count(*) OVER () AS n FROM ({EVENTS.sql}))"


@query("sample_uniform", f"WITH c AS ({EVENTS.sql}) SELECT record_id, residual, CAST(1 AS FLOAT) AS weight FROM c WHERE {DRAW_SQL} < least(1.0::DOUBLE, 2000::DOUBLE / (SELECT count(*) FROM c)) * 4503599627370496")
def sample_uniform(spark, d):
    return sampling.uniform(EVENTS.load(spark, d), 2000, 42).select("record_id", "residual", "weight")


@query("sample_stratified", f"WITH s AS ({STRATA_SQL}), p AS (SELECT *, least(1.0::DOUBLE, 500::DOUBLE / ((stratum + 1) * n // 4 - stratum * n // 4)) AS chance FROM s) SELECT record_id, residual, stratum, CAST(1 / chance AS FLOAT) AS weight FROM p WHERE {DRAW_SQL} < chance * 4503599627370496")
def sample_stratified(spark, d):
    return sampling.stratified(EVENTS.load(spark, d), 2000, 42).select("record_id", "residual", "stratum", "weight")


@query("stratum_rank", f"SELECT record_id, stratum FROM ({STRATA_SQL})")
def stratum_rank(spark, d):
    rows = EVENTS.load(spark, d)
    return sampling.with_stratum(rows, sampling.strata_bounds(rows)).select("record_id", "stratum")


@query("sample_weighted", f"WITH c AS ({ACCOUNTS.sql}), t AS (SELECT sum(abs(CAST(residual AS DOUBLE)) + 1e-6) AS t FROM c), p AS (SELECT c.*, least(1.0::DOUBLE, (abs(CAST(residual AS DOUBLE)) + 1e-6) / t * 2000) AS chance FROM c, t) SELECT record_id, residual, round(1 / chance, 3) AS weight FROM p WHERE {DRAW_SQL} < chance * 4503599627370496")
def sample_weighted(spark, d):
    return sampling.weighted(ACCOUNTS.load(spark, d), 2000, 42).select("record_id", "residual", F.round(1 / F.col("chance"), 3).alias("weight"))


@query("sample_chance", f"WITH c AS ({EVENTS.sql}), t AS (SELECT sum(abs(CAST(residual AS DOUBLE)) + 1e-6) AS t FROM c) SELECT record_id, round(least(1.0, (abs(CAST(residual AS DOUBLE)) + 1e-6) / t * 2000), 6) AS chance FROM c, t")
def sample_chance(spark, d):
    return rounded(sampling.with_chance(EVENTS.load(spark, d), 2000).select("record_id", "chance"), chance=6)


@query("select_random_features", "WITH w AS (SELECT max(len(embedding)) AS width FROM embeddings) SELECT CAST(i AS INTEGER) AS feature FROM w, range(64) t(i) WHERE i < width QUALIFY row_number() OVER (ORDER BY md5(i || ':42')) <= (SELECT ceil(width * 0.25) FROM w)")
def select_random_features(spark, d):
    width = read(spark, d, "embeddings").agg(F.max(F.size("embedding"))).first()[0] or 0
    return spark.createDataFrame([(i,) for i in sampling.random_features(width, 0.25, 42)] if width else [], "feature int")



@query("screen_sample", f"SELECT record_id, residual FROM ({strided_sql(ACCOUNTS, '20', 3)})")
def screen_sample(spark, d):
    return promotion.screen_sample(ACCOUNTS.load(spark, d), 0.05, 3).select("record_id", "residual")


@query("join_residual", f"SELECT record_id, f0, round(y - CAST(1.0 + tanh(-0.5 + CAST(f0 AS DOUBLE) * 0.02) * 40.0 + CAST(f2 AS DOUBLE) * 0.25 AS FLOAT), 3) AS residual FROM ({EVENTS.sql})")
def join_residual(spark, d):
    lay = layout.Layout(EVENTS.load(spark, d), EVENTS.features, [[]] * EVENTS.width, ["y"])
    lay.put(loop.corrections(lay.base, HIDDEN, ["y"]))
    return lay.rows("_r0").select("record_id", "f0", F.round("residual", 3).alias("residual"))



SET_SQL = chain_sql(ACCOUNTS) + f", kept AS (SELECT record_id FROM ({strided_sql(ACCOUNTS, '(n + 999) // 1000')}))"


def searched(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(corpus, a search set of a thousand records that may split on the first and the last feature)"""
    rows, _, listed, _ = prepared(spark, d, ACCOUNTS)
    return rows, sampling.search_set(rows, ACCOUNTS.features, listed, target=1000, chosen=[0, 2])


@query("build_search_set", SET_SQL + " SELECT record_id, residual, CAST(1 AS FLOAT) AS weight, b0, 0 AS b1, b2 FROM binned JOIN kept USING (record_id)")
def build_search_set(spark, d):
    return searched(spark, d)[1]


@query("scan_search_set", SET_SQL + " SELECT 0 AS feature, b0 AS bin, CAST(count(*) AS DOUBLE) AS n, round(sum(CAST(residual AS DOUBLE)), 4) AS s FROM binned JOIN kept USING (record_id) GROUP BY b0")
def scan_search_set(spark, d):
    found = store.written(searched(spark, d)[1], "search-set")
    return rounded(histogram.histogram(found, 3, weight="weight").where("feature = 0").select("feature", "bin", "n", "s"), s=4)


@query("join_raw_sample", SET_SQL + " SELECT record_id, f0, f1, CAST(1 AS FLOAT) AS weight FROM corpus JOIN kept USING (record_id)")
def join_raw_sample(spark, d):
    return sampling.raw_rows(*searched(spark, d)).select("record_id", "f0", "f1", "weight")


@query("export_matrix", f"SELECT record_id, f0, f1, f2, residual, residual AS correction FROM ({strided_sql(ACCOUNTS, '(n + 999) // 1000')})")
def export_matrix(spark, d):
    rows = ACCOUNTS.load(spark, d)
    return files.export_matrix(rows, rows.withColumn("correction", F.col("residual")), ACCOUNTS.features, 1000)


# ---------------------------------------------------------------- candidates, scores, promotion


def placed(found: DataFrame) -> DataFrame:
    return found.withColumn("place", F.row_number().over(W.orderBy(*histogram.rank_keys())))


TOP_SQL = kinds_sql() + f", top AS (SELECT *, CAST(row_number() OVER ({ORDER_SQL}) AS INTEGER) AS place FROM kinds {ORDER_SQL} LIMIT 4)"


#: top (place, feature, bin, threshold, left_correction, right_correction, gain) and its variants, as x.
EXPANDED_SQL = """, x AS (
    SELECT 1 AS phase, 0 AS step, place, 'stump' AS strategy, feature, bin, threshold, left_correction, right_correction, gain FROM top
    UNION ALL SELECT 2, i, place, 'stump/scale', feature, bin, threshold, left_correction * CAST(k AS FLOAT), right_correction * CAST(k AS FLOAT), gain * 0.75 FROM top, (VALUES (0, 0.5), (1, 1.5)) s(i, k)
    UNION ALL SELECT 3, 0, place, 'stump/one-sided', feature, bin, threshold, CAST(0 AS FLOAT), right_correction, gain FROM top WHERE left_correction <> 0 AND right_correction <> 0
    UNION ALL SELECT 3, 1, place, 'stump/one-sided', feature, bin, threshold, left_correction, CAST(0 AS FLOAT), gain FROM top WHERE left_correction <> 0 AND right_correction <> 0
    UNION ALL SELECT 4, i, place, 'stump/shifted', top.feature, e.bin, e.threshold, left_correction, right_correction, 0 FROM top CROSS JOIN (VALUES (0, -1), (1, 1)) s(i, m) JOIN edges e ON e.feature = top.feature AND e.bin = top.bin + m)"""


@query("expand_discoveries", chain_sql(EVENTS) + TOP_SQL + EXPANDED_SQL + """
    SELECT phase, step, place, strategy, feature, bin, threshold, round(left_correction, 3) AS left_correction, round(right_correction, 3) AS right_correction, round(gain, 3) AS gain FROM x""")
def expand_discoveries(spark, d):
    _, edges, _, binned = prepared(spark, d, EVENTS)
    top = placed(histogram.search_stumps(histogram.histogram(binned, 3), edges, Controls(top_k=4)))
    return rounded(candidates.expand(top, edges), left_correction=3, right_correction=3, gain=3)


def stump_id_sql(left: str, right: str, threshold: str) -> str:
    """The content id of a stump on a feature: of its canonical JSON."""
    number = "CAST(CAST({} AS DOUBLE) AS VARCHAR)".format
    return f"""substr(sha256('[0,{{"left":{{"correction":' || {number(left)} || '}},"right":{{"correction":' || {number(right)} || '}},"terms":[[' || feature || ',1.0]],"threshold":' || {number(threshold)} || '}}]'), 1, 16)"""


def candidates_sql(most: int, each: int, phases: str) -> str:
    """... singles and stacks of the expanded stumps of some phases: the first of each content that corrects something; stacks of the first for each feature."""
    order = "ORDER BY phase, step, place"
    return (
        chain_sql(EVENTS)
        + kinds_sql()
        + f""", own AS (SELECT *, row_number() OVER (PARTITION BY feature {ORDER_SQL}) AS own_place FROM kinds),
        top AS (SELECT *, row_number() OVER ({ORDER_SQL}) AS place FROM own WHERE own_place <= {each} {ORDER_SQL} LIMIT {most})"""
        + EXPANDED_SQL
        + f""", named AS (SELECT *, {stump_id_sql("left_correction", "right_correction", "threshold")} AS id FROM x WHERE phase IN ({phases}) AND (left_correction <> 0 OR right_correction <> 0)),
        singles AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY id {order}) = 1),
        heads AS (SELECT * FROM singles QUALIFY row_number() OVER (PARTITION BY feature {order}) = 1),
        firsts AS (SELECT *, row_number() OVER ({order}) AS k FROM heads),
        stacks AS (SELECT substr(sha256(string_agg(id, '+' ORDER BY k)), 1, 16) AS id, 'combo/' || parts || ':' || first(strategy ORDER BY k) AS strategy, parts, round(sum(gain), 3) AS gain
                   FROM firsts JOIN (SELECT CAST(i AS INTEGER) AS parts FROM range(2, 5) t(i)) ON k <= parts WHERE parts <= (SELECT count(*) FROM firsts) GROUP BY parts)"""
    )


@query("generate_candidates", candidates_sql(8, 3, "1, 2, 3, 4") + " SELECT id, strategy, 1 AS parts, round(gain, 3) AS gain FROM singles UNION ALL SELECT * FROM stacks")
def generate_candidates(spark, d):
    _, edges, _, binned = prepared(spark, d, EVENTS)
    top = placed(histogram.search_stumps(histogram.histogram(binned, 3), edges, Controls(top_k=8, max_per_feature=3)))
    singles = candidates.distinct(candidates.expand(top, edges).orderBy("phase", "step", "place").collect())
    every = [*singles, *candidates.combos(singles)]
    return rounded(spark.createDataFrame([(c.id, c.strategy, len(c.parts), c.gain) for c in every], "id string, strategy string, parts int, gain double"), gain=3)


@query("cap_candidates", chain_sql(EVENTS) + kinds_sql() + f", top AS (SELECT * FROM kinds {ORDER_SQL} LIMIT 8), t AS (SELECT *, row_number() OVER ({ORDER_SQL}) AS place FROM top), f AS (SELECT min(place) AS place, bool_or(place = 2) AS bad FROM t GROUP BY feature, bin, left_correction, right_correction), n AS (SELECT *, count(*) FILTER (WHERE NOT bad) OVER (ORDER BY place) AS k FROM f) SELECT CAST(place AS INTEGER) AS place, CASE WHEN bad THEN 'failed lately' ELSE 'kept' END AS fate FROM n WHERE CASE WHEN bad THEN k < 5 ELSE k <= 5 END")
def cap_candidates(spark, d):
    _, edges, _, binned = prepared(spark, d, EVENTS)
    top = histogram.search_stumps(histogram.histogram(binned, 3), edges, Controls(top_k=8)).withColumn("strategy", F.lit("stump"))
    found = candidates.of_rows(top.collect())
    kept, discarded = candidates.select(found * 2, 5, [found[1].id])
    place = {c.id: i + 1 for i, c in reversed(list(enumerate(found)))}
    rows = [(place[c.id], "kept") for c in kept] + [(place[i], reason) for i, reason in discarded]
    return spark.createDataFrame(rows, "place int, fate string")


def draw_sql(what: str) -> str:
    return f"CAST('0x' || substr(md5('{what}:' || i || ':7'), 1, 13) AS BIGINT) / 4503599627370496::DOUBLE"


@query("random_stumps", chain_sql(EVENTS) + f""", able AS (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS place, count(*) OVER () AS width, cuts FROM (SELECT feature, count(*) AS cuts FROM edges GROUP BY feature)),
    drawn AS (SELECT i, {draw_sql("feature")} AS f, floor({draw_sql("kind")} * 3) AS kind_no, (2 * {draw_sql("left")} - 1) * 5 AS l, (2 * {draw_sql("right")} - 1) * 5 AS r, {draw_sql("edge")} AS e FROM range(20) t(i)),
    made AS (SELECT edges.feature, threshold, CASE WHEN kind_no = 1 THEN 0 ELSE l END AS l, CASE WHEN kind_no = 0 THEN 0 ELSE r END AS r
             FROM drawn JOIN able ON able.place = floor(f * width) JOIN edges ON edges.feature = able.feature AND edges.bin = floor(e * cuts))
    SELECT {stump_id_sql("l", "r", "threshold")} AS id, feature, threshold::DOUBLE AS threshold FROM made""")
def random_stumps(spark, d):
    listed = prepared(spark, d, EVENTS)[2]
    return spark.createDataFrame([(c.id, c.parts[0]["terms"][0][0], c.parts[0]["threshold"]) for c in candidates.random_stumps(listed, 20, 5.0, 7)], "id string, feature int, threshold double")


FIXED = [("a", [TREE]), ("b", [patches.scaled(TREE, 0.5)]), ("c", [patches.split(2, 4.0, patches.leaf(1.0), patches.leaf(-1.0))]), ("d", [TREE, patches.split(2, 4.0, patches.leaf(0.0), patches.leaf(0.01))])]
SCORED = f"""WITH c AS ({EVENTS.sql}), e AS (SELECT count(*) AS n, avg(pow(CAST(residual AS DOUBLE), 2)) AS base,
    avg(pow(CAST(residual - {TREE_SQL} AS DOUBLE), 2)) AS a, avg(pow(CAST(residual - {TREE_SQL} * CAST(0.5 AS FLOAT) AS DOUBLE), 2)) AS b,
    avg(pow(CAST(residual - CAST(CASE WHEN f2 > CAST(4 AS FLOAT) THEN -1 ELSE 1 END AS FLOAT) AS DOUBLE), 2)) AS c,
    avg(pow(CAST(residual - ({TREE_SQL} + CAST(CASE WHEN f2 > CAST(4 AS FLOAT) THEN 0.01 ELSE 0 END AS FLOAT)) AS DOUBLE), 2)) AS d FROM c),
    scores AS (SELECT 'baseline' AS candidate_id, 1 - base AS score, base AS error, n AS record_count FROM e UNION ALL SELECT 'a', 1 - a - 4e-7, a, n FROM e UNION ALL SELECT 'b', 1 - b - 4e-7, b, n FROM e UNION ALL SELECT 'c', 1 - c - 2e-7, c, n FROM e UNION ALL SELECT 'd', 1 - d - 6e-7, d, n FROM e)"""


@query("score_model", SCORED + " SELECT candidate_id, round(score, 6) AS score, round(error, 6) AS error, record_count FROM scores")
def score_model(spark, d):
    return rounded(promotion.scores_frame(spark, promotion.score_all(EVENTS.load(spark, d), FIXED)), score=6, error=6)


@query("rank_screen", SCORED + ", x AS (SELECT candidate_id, score - (SELECT score FROM scores WHERE candidate_id = 'baseline') AS delta FROM scores WHERE candidate_id <> 'baseline') SELECT candidate_id, round(delta, 5) AS delta FROM x WHERE delta > 0 ORDER BY delta DESC, candidate_id LIMIT 3")
def rank_screen(spark, d):
    found = promotion.rank_screen(promotion.score_all(EVENTS.load(spark, d), FIXED), 3)
    return spark.createDataFrame([(k, round(v, 5)) for k, v in found], "candidate_id string, delta double")


DELTAS = SCORED + ", x AS (SELECT candidate_id, score - (SELECT score FROM scores WHERE candidate_id = 'baseline') AS delta FROM scores WHERE candidate_id <> 'baseline')"


@query("screen_and_promote", DELTAS + " SELECT (SELECT candidate_id FROM x ORDER BY delta DESC, candidate_id LIMIT 1) AS winner, CAST(count(*) AS INTEGER) AS promoted, CAST(count(*) FILTER (WHERE delta <= 0) AS INTEGER) AS false_positives, CASE WHEN count(*) FILTER (WHERE delta > 0) = 4 THEN 1 ELSE 0 END AS false_negatives FROM x")
def screen_and_promote(spark, d):
    found = promotion.promote(EVENTS.load(spark, d), FIXED, count=3, rate=0.05, phase=1)
    unscreened = promotion.promote(EVENTS.load(spark, d), FIXED, count=len(FIXED))
    assert found["winner"] == unscreened["winner"]
    return spark.createDataFrame([(found["winner"], len(unscreened["promoted"]), unscreened["false_positives"], found["false_negatives"])], "winner string, promoted int, false_positives int, false_negatives int")


@query("explore_bypass", "SELECT DISTINCT event_type AS id FROM events QUALIFY dense_rank() OVER (ORDER BY sha256('7:' || event_type)) <= 2")
def explore_bypass(spark, d):
    names = [r.event_type for r in read(spark, d, "events").select("event_type").distinct().collect()]  # a handful of kinds
    return spark.createDataFrame([(x,) for x in promotion.bypass(names, 2, 7)], "id string")


@query("establish_baseline", f"SELECT count(*) AS record_count, round(1 - avg(pow(CAST(residual AS DOUBLE), 2)), 6) AS score, TRUE AS parity FROM ({EVENTS.sql})")
def establish_baseline(spark, d):
    rows = EVENTS.load(spark, d)
    score, error, n = promotion.score_all(rows, [])["baseline"][:3]
    local = rows.agg(residuals.mse(F.col("y"), F.col("p")).alias("m")).first().m
    return spark.createDataFrame([(n, round(score, 6), promotion.parity(local, error))], "record_count long, score double, parity boolean")


@query("run_loop")
def run_loop(spark, d):
    found = loop.run(store.written(EVENTS.load(spark, d), "corpus"), EVENTS.features, bins=16, iterations=2, count=4)
    return spark.createDataFrame([(i, *(x[j] for j in (0, 1, 3))) for i, x in enumerate(found.accepted)], "round int, id string, strategy string, improvement double")


@query("union_discoveries")
def union_discoveries(spark, d):
    rows, edges, listed, _ = prepared(spark, d, EVENTS)
    look = loop.Search(records=4000, depth=2, lines=2, boost=2)
    found = store.written(sampling.search_set(rows, EVENTS.features, listed, target=look.records), "search-set")
    singles, bundles = loop.discoveries(rows, found, EVENTS.features, edges, listed, Controls(top_k=4), look, 1)
    return spark.createDataFrame([(c.id, c.strategy, len(c.parts), c.gain) for c in (*singles, *bundles)], "id string, strategy string, parts int, gain double")


@query("run_log")
def run_log(spark, d):
    path = f"{store.shared_dir(spark)}/run-{uuid.uuid4().hex}"
    look = loop.Search(records=4000, depth=2, boost=2)
    loop.run(store.written(EVENTS.load(spark, d), "corpus"), EVENTS.features, bins=16, iterations=2, count=4, search=look, log=files.LogWriter(spark, path))
    return runlog.report(files.read_log(spark, path, runlog.LOG))


# ---------------------------------------------------------------- verdict store, over a log made of events

LOG = "SELECT event_id AS position, CAST(event_id % 4000 AS VARCHAR) AS id, CAST(user_id % 7 AS VARCHAR) AS incumbent, CASE WHEN event_type IN ('purchase', 'signup') THEN 'accepted' ELSE 'rejected' END AS outcome, value AS delta, CAST(floor(epoch(ts)) AS BIGINT) AS at_unix, CAST(event_id % 3 AS VARCHAR) AS host, CAST(CASE WHEN event_id % 11 = 0 THEN 4 ELSE 3 END AS INTEGER) AS inputs FROM events"
NOW, HOUR = 1_706_000_000, 3600


def verdict_log(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.when(F.col("event_type").isin("purchase", "signup"), "accepted").otherwise("rejected")
    return read(spark, d, "events").select(
        F.col("event_id").alias("position"), (F.col("event_id") % 4000).cast("string").alias("id"), (F.col("user_id") % 7).cast("string").alias("incumbent"), outcome.alias("outcome"), F.col("value").alias("delta"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long").alias("at_unix"), (F.col("event_id") % 3).cast("string").alias("host"), F.when(F.col("event_id") % 11 == 0, 4).otherwise(3).alias("inputs"),
    )


def later(spark: SparkSession, d: str) -> int:
    """A now: the newest verdict's time."""
    return verdict_log(spark, d).agg(F.max("at_unix")).first()[0]


KNOWN = "f AS (SELECT id, max(at_unix) FILTER (WHERE outcome = 'rejected') AS at_unix, bool_or(outcome = 'accepted') AS won FROM l GROUP BY id), now AS (SELECT max(at_unix) AS now FROM l)"


@query("known_failures", f"WITH l AS ({LOG}), {KNOWN} SELECT id FROM f, now WHERE NOT won AND at_unix IS NOT NULL AND greatest(now - at_unix, 0) < 864000")
def known_failures(spark, d):
    return verdicts.known_failures(verdict_log(spark, d), later(spark, d), 864_000)


@query("anti_known_failures", f"WITH l AS ({LOG}), {KNOWN}, k AS (SELECT id FROM f, now WHERE NOT won AND at_unix IS NOT NULL AND greatest(now - at_unix, 0) < 864000) SELECT DISTINCT id FROM l WHERE id NOT IN (SELECT id FROM k)")
def anti_known_failures(spark, d):
    log = verdict_log(spark, d)
    return log.select("id").distinct().join(verdicts.known_failures(log, later(spark, d), 864_000), "id", "left_anti")


EVIDENCE = "e AS (SELECT id, count(*) FILTER (WHERE outcome = 'accepted') AS wins, count(*) FILTER (WHERE outcome = 'rejected') AS losses, max(row(delta, at_unix, position)) FILTER (WHERE outcome = 'accepted') AS best, max(row(at_unix, position)) AS last FROM o GROUP BY id)"


@query("replay_evidence", f"WITH o AS ({LOG}), {EVIDENCE} SELECT id, wins, losses, best[1] AS best_delta, best[2] AS best_at, last[1] AS last_at, last[2] AS last_position FROM e")
def replay_evidence(spark, d):
    return verdicts.evidence(verdict_log(spark, d))


@query("replay_choose", f"""WITH l AS ({LOG}), o AS (SELECT * FROM l WHERE inputs = 3), {EVIDENCE}, now AS (SELECT max(at_unix) AS now FROM l),
    t AS (SELECT DISTINCT id FROM o WHERE incumbent = '2'), c AS (SELECT DISTINCT id FROM l WHERE position % 13 = 0),
    k AS (SELECT *, CASE WHEN wins > 0 AND losses <= wins THEN 'win' WHEN greatest(now - last[1], 0) >= 86400 THEN 'retry' END AS kind FROM e, now WHERE id NOT IN (SELECT id FROM t) AND id NOT IN (SELECT id FROM c)),
    r AS (SELECT id, kind, CASE WHEN kind = 'win' THEN best[1] END AS delta, CASE WHEN kind = 'win' THEN best[2] ELSE last[1] END AS at_unix FROM k WHERE kind IS NOT NULL)
    SELECT CAST(row_number() OVER w AS INTEGER) AS place, id, kind, delta, at_unix FROM r WINDOW w AS (ORDER BY CASE kind WHEN 'win' THEN 0 ELSE 1 END, CASE WHEN kind = 'win' THEN -delta END, CASE WHEN kind = 'retry' THEN at_unix END, id) ORDER BY place LIMIT 50""")
def replay_choose(spark, d):
    log = verdict_log(spark, d)
    carried = log.where("position % 13 = 0").select("id")
    return verdicts.choose(log, "2", 3, carried, later(spark, d), 86_400, 50)


@query("dedupe_newest", f"SELECT position, id, incumbent FROM ({LOG}) QUALIFY row_number() OVER (PARTITION BY id, incumbent ORDER BY at_unix DESC, position DESC) = 1")
def dedupe_newest(spark, d):
    return verdicts.newest(verdict_log(spark, d)).where("copy = 1").select("position", "id", "incumbent")


PRUNED = f"""WITH l AS ({LOG}), now AS (SELECT max(at_unix) AS now FROM l), m AS (SELECT *, row_number() OVER (PARTITION BY id, incumbent ORDER BY at_unix DESC, position DESC) AS copy FROM l),
    s AS (SELECT m.*, CASE WHEN copy > 1 THEN 'duplicate' WHEN outcome = 'accepted' AND now - at_unix >= 1728000 THEN 'stale-accepted' WHEN outcome = 'rejected' AND now - at_unix >= 864000 THEN 'stale-rejected' ELSE 'fresh' END AS fate0 FROM m, now),
    p AS (SELECT *, CASE WHEN fate0 <> 'fresh' THEN fate0 WHEN row_number() OVER (PARTITION BY fate0 ORDER BY at_unix DESC, position DESC) > 2000 THEN 'over-cap' ELSE 'kept' END AS fate FROM s)"""


def pruned(spark, d) -> DataFrame:
    return verdicts.prune(verdict_log(spark, d), later(spark, d), 1_728_000, 864_000, 2000)


@query("plan_prune", PRUNED + " SELECT position, id, fate FROM p")
def plan_prune(spark, d):
    return pruned(spark, d).select("position", "id", "fate")


@query("prune_counts", PRUNED + " SELECT fate, count(*) AS verdicts FROM p GROUP BY fate")
def prune_counts(spark, d):
    return verdicts.counts_of(pruned(spark, d))


@query("running_cap", PRUNED + " SELECT position FROM p WHERE fate = 'kept'")
def running_cap(spark, d):
    return pruned(spark, d).where("fate = 'kept'").select("position")


@query("anti_filed", f"WITH l AS ({LOG}) SELECT position FROM l WHERE (id, incumbent) NOT IN (SELECT (id, incumbent) FROM l WHERE host = '0')")
def anti_filed(spark, d):
    log = verdict_log(spark, d)
    return verdicts.unfiled(log, log.where("host = '0'")).select("position")


@query("union_hosts", f"SELECT host, count(*) AS verdicts, count(DISTINCT id) AS ids FROM ({LOG}) GROUP BY host")
def union_hosts(spark, d):
    log = verdict_log(spark, d)
    return verdicts.by_host([log.where(F.col("host") == str(h)) for h in range(3)])


def stored(spark: SparkSession, d: str) -> str:
    """A store that holds the log, one folder for each host, and a corpus of one verdict beside it; its root."""
    root, log = f"{store.shared_dir(spark)}/verdicts-{uuid.uuid4().hex}", verdict_log(spark, d)
    for h in range(3):
        files.append_verdicts(log.where(F.col("host") == str(h)), root, "events", str(h))
    files.append_verdicts(log.where("position = 0"), root, "other", "0")
    return root


@query("append_learnings", f"SELECT position, id, incumbent, outcome, delta, at_unix, host, inputs FROM ({LOG})")
def append_learnings(spark, d):
    return files.read_verdicts(spark, stored(spark, d), "events").select("position", "id", "incumbent", "outcome", "delta", "at_unix", "host", "inputs")


@query("read_learnings", f"SELECT host, outcome, count(*) AS verdicts, round(sum(delta), 4) AS delta FROM ({LOG}) GROUP BY host, outcome")
def read_learnings(spark, d):
    return files.read_verdicts(spark, stored(spark, d), "events").groupBy("host", "outcome").agg(F.count("*").alias("verdicts"), F.round(F.sum("delta"), 4).alias("delta"))


@query("list_corpora", "SELECT * FROM (VALUES ('events'), ('other')) t(corpus)")
def list_corpora(spark, d):
    return spark.createDataFrame([(x,) for x in files.corpora_in(spark, stored(spark, d))], "corpus string")


@query("prune_learnings", PRUNED.replace(f"l AS ({LOG})", f"every AS ({LOG}), l AS (SELECT * FROM every WHERE host = '1')").replace("SELECT max(at_unix) AS now FROM l", "SELECT max(at_unix) AS now FROM every").replace("> 2000", "> 500") + " SELECT position, id, host FROM p WHERE fate = 'kept' UNION ALL SELECT position, id, host FROM every WHERE host <> '1'")
def prune_learnings(spark, d):
    root, now = stored(spark, d), later(spark, d)
    files.prune_verdicts(spark, root, "events", "1", lambda own: verdicts.prune(own, now, 1_728_000, 864_000, 500))
    return files.read_verdicts(spark, root, "events").select("position", "id", "host")


@query("distinct_patches", f"SELECT id, min(position) AS first_position FROM ({LOG}) GROUP BY id")
def distinct_patches(spark, d):
    return candidates.distinct_ids(verdict_log(spark, d))


@query("intersect_carried", f"WITH l AS ({LOG}) SELECT id FROM l WHERE incumbent = '1' INTERSECT SELECT id FROM l WHERE incumbent = '2'")
def intersect_carried(spark, d):
    log = verdict_log(spark, d)
    return verdicts.shared_ids(log.where("incumbent = '1'"), log.where("incumbent = '2'"))


@query("sanitise", "SELECT c_custkey, coalesce(nullif(trim(regexp_replace(c_name || '/' || c_mktsegment || '.', '[^A-Za-z0-9_-]', '-', 'g'), '-'), ''), 'unknown') AS name FROM customer")
def sanitise(spark, d):
    raw = F.concat("c_name", F.lit("/"), "c_mktsegment", F.lit("."))
    return read(spark, d, "customer").select("c_custkey", verdicts.safe_name(raw).alias("name"))


@query("combo_id", "SELECT o_orderkey, substr(sha256(CAST(o_orderkey AS VARCHAR) || '+' || CAST(o_custkey AS VARCHAR)), 1, 16) AS combo FROM orders")
def combo_id(spark, d):
    ids = F.array(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"))
    return read(spark, d, "orders").select("o_orderkey", patches.combo_id_column(ids).alias("combo"))


NAMES_SQL = "CASE p_partkey % 5 WHEN 0 THEN 'patch-one-a' WHEN 1 THEN 'hidden-' || p_partkey WHEN 2 THEN 'patch-' || p_partkey ELSE 'patch-' || p_partkey || '-if' || p_size END"


@query("parse_grafted_id", f"SELECT p_partkey, CASE WHEN p_partkey % 5 > 2 THEN CAST(p_partkey AS VARCHAR) END AS patch FROM part")
def parse_grafted_id(spark, d):
    return read(spark, d, "part").select("p_partkey", verdicts.merged_patch_id(F.expr(NAMES_SQL)).alias("patch"))


@query("feature_union", "SELECT o_orderkey, list_sort(list_distinct([o_orderkey % 5, o_custkey % 5, o_orderkey % 3])) AS features FROM orders")
def feature_union(spark, d):
    parts = F.array(F.array(F.col("o_orderkey") % 5, F.col("o_custkey") % 5), F.array(F.col("o_orderkey") % 3))
    return read(spark, d, "orders").select("o_orderkey", patches.feature_union(parts).alias("features"))


# ---------------------------------------------------------------- run log, over experiments made of events

CANDIDATES = "SELECT event_id // 50 AS iteration, CAST(event_id AS VARCHAR) AS id, event_type AS strategy, CASE WHEN user_id % 2 = 0 THEN 'cpu' ELSE 'sampled' END AS backend, CAST(1 + user_id % 3 AS INTEGER) AS depth, value > 50 AS promoted, CASE WHEN value > 50 THEN value - 90 END AS full_delta, CAST(floor(epoch(ts)) AS BIGINT) AS at_unix FROM events"
RUNS = f"""WITH c AS ({CANDIDATES}), b AS (SELECT iteration, max(at_unix) AS timestamp, count(*) AS n, count(*) FILTER (WHERE promoted) AS promoted, max(full_delta) AS best FROM c GROUP BY iteration),
    e AS (SELECT b.*, coalesce(best > 0, FALSE) AS accepted, (SELECT min(id) FROM c WHERE c.iteration = b.iteration AND c.full_delta = b.best) AS winner, n * 7 AS search_ms, promoted * 3 AS screen_ms, promoted * 11 AS full_ms FROM b)"""


def experiments(spark: SparkSession, d: str) -> DataFrame:
    """Fifty events make one experiment."""
    rows = read(spark, d, "events").select(
        F.expr("event_id div 50").alias("iteration"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long").alias("at_unix"),
        F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("strategy"), F.when(F.col("user_id") % 2 == 0, "cpu").otherwise("sampled").alias("backend"), (1 + F.col("user_id") % 3).cast("int").alias("depth"), (F.col("value") > 50).alias("promoted"), F.when(F.col("value") > 50, F.col("value") - 90).alias("full_delta")).alias("c"),
    )
    made = rows.groupBy("iteration").agg(F.max("at_unix").alias("timestamp"), F.collect_list("c").alias("candidates"), F.count("*").alias("n"), F.count_if("c.promoted").alias("promoted"), F.max("c.full_delta").alias("best"))
    winner = F.array_min(F.transform(F.filter("candidates", lambda c: c.full_delta == F.col("best")), lambda c: c.id))
    return made.select("iteration", "timestamp", "candidates", winner.alias("winner"), F.col("best").alias("improvement"), F.coalesce(F.col("best") > 0, F.lit(False)).alias("accepted"), (F.col("n") * 7).alias("search_ms"), (F.col("promoted") * 3).alias("screen_ms"), (F.col("promoted") * 11).alias("full_ms"), (F.col("iteration") * 1.0).alias("baseline_score"))


@query("report_totals", RUNS + """, t AS (SELECT count(*) AS iterations, count(*) FILTER (WHERE accepted) AS acceptances, CAST(sum(n) AS BIGINT) AS candidates, CAST(sum(promoted) AS BIGINT) AS promoted, CAST(sum(search_ms) AS BIGINT) AS search_ms, CAST(sum(screen_ms + full_ms) AS BIGINT) AS scorer_ms,
    greatest(max(timestamp) - 1704067200, 0) * 1000 AS wall_ms, sum(best) FILTER (WHERE accepted) AS improvement, greatest(min(timestamp) FILTER (WHERE accepted) - 1704067200, 0) * 1000 AS first_acceptance_ms FROM e)
    SELECT iterations, acceptances, candidates, promoted, search_ms, scorer_ms, wall_ms, round(improvement, 4) AS improvement, first_acceptance_ms, round(improvement / nullif(wall_ms / 3600000.0, 0), 6) AS improvement_per_hour, round(search_ms / nullif(search_ms + scorer_ms, 0), 6) AS search_share FROM t""")
def report_totals(spark, d):
    return rounded(runlog.totals(experiments(spark, d), 1_704_067_200), improvement=4, improvement_per_hour=6, search_share=6)


@query("report_groups", RUNS + """, k AS (SELECT 'strategy' AS dimension, strategy AS name, * FROM c UNION ALL SELECT 'backend', backend, * FROM c UNION ALL SELECT 'depth', 'depth' || depth, * FROM c)
    SELECT dimension, name, count(*) AS generated, count(*) FILTER (WHERE k.promoted) AS promoted, count(full_delta) AS full_scored, count(*) FILTER (WHERE accepted AND winner = id) AS winners, round(coalesce(sum(best) FILTER (WHERE accepted AND winner = id), 0), 4) AS accepted_gain, round(avg(full_delta), 6) AS mean_delta FROM k JOIN e USING (iteration) GROUP BY dimension, name""")
def report_groups(spark, d):
    return rounded(runlog.by_group(experiments(spark, d)), accepted_gain=4, mean_delta=6)


@query("join_winner", RUNS + " SELECT c.iteration, id, strategy, depth, best AS improvement FROM c JOIN e ON c.iteration = e.iteration AND accepted AND winner = id")
def join_winner(spark, d):
    return runlog.winners(experiments(spark, d))


@query("score_trajectory", RUNS + " SELECT CAST(row_number() OVER (ORDER BY iteration) AS INTEGER) AS step, iteration, iteration * 1.0::DOUBLE + best AS score FROM e WHERE accepted")
def score_trajectory(spark, d):
    return runlog.trajectory(experiments(spark, d))


@query("first_acceptance", RUNS + " SELECT min(timestamp) AS first_acceptance FROM e WHERE accepted")
def first_acceptance(spark, d):
    return runlog.first_acceptance(experiments(spark, d))


@query("carry_forward", RUNS + ", m AS (SELECT c.iteration, max(full_delta) FILTER (WHERE NOT (accepted AND winner = id)) AS near FROM c JOIN e USING (iteration) GROUP BY c.iteration) SELECT iteration, lag(near) OVER (ORDER BY iteration) AS previous_best FROM m")
def carry_forward(spark, d):
    return runlog.carried_forward(experiments(spark, d))


@query("affected_fraction", RUNS + " SELECT iteration, greatest(0.0::DOUBLE, least(1.0::DOUBLE, promoted::DOUBLE / n)) AS fraction FROM e")
def affected_fraction(spark, d):
    n = F.size("candidates").cast("double")
    promoted = F.size(F.filter("candidates", lambda c: c.promoted)).cast("double")
    return experiments(spark, d).select("iteration", runlog.affected_fraction(promoted, F.lit(0.0), n).alias("fraction"))


@query("compare_runs", RUNS + " SELECT CAST(iteration % 5 AS VARCHAR) AS run, count(*) AS iterations, count(*) FILTER (WHERE accepted) AS acceptances, round(sum(best) FILTER (WHERE accepted), 4) AS improvement FROM e GROUP BY 1")
def compare_runs(spark, d):
    root = f"{store.shared_dir(spark)}/runs-{uuid.uuid4().hex}"
    experiments(spark, d).withColumn("record", F.lit("experiment")).withColumn("own", F.col("iteration") % 5).drop("candidates").write.partitionBy("own").json(root)
    logs = files.read_log(spark, f"{root}/*", runlog.LOG).withColumn("run", F.regexp_extract("_path", "/own=([^/]+)/", 1))
    return rounded(runlog.compare(runlog.experiments_of(logs)), improvement=4)


@query("join_scores", RUNS + " SELECT c.iteration, c.id, c.full_delta, CASE WHEN accepted AND winner = c.id THEN best END AS improvement FROM c LEFT JOIN e ON c.iteration = e.iteration AND winner = c.id")
def join_scores(spark, d):
    made = experiments(spark, d)
    rows = made.select("iteration", F.explode("candidates").alias("c")).select("iteration", "c.id", "c.full_delta")
    return promotion.join_scores(rows, made.where("accepted").select("iteration", F.col("winner").alias("id"), "improvement"))


# ---------------------------------------------------------------- the smaller steps, each on its own


@query("squash", f"SELECT record_id, round(tanh(CAST(f0 AS DOUBLE) / 100), 6) AS tanh_value, round(1 / (1 + exp(-CAST(f0 AS DOUBLE) / 100)), 6) AS logistic_value, greatest(CAST(f0 AS DOUBLE) - 50, 0) AS relu_value FROM ({EVENTS.sql})")
def squash(spark, d):
    x = F.col("f0").cast("double")
    return EVENTS.load(spark, d).select("record_id", F.round(sem.squash("TANH", x / 100), 6).alias("tanh_value"), F.round(sem.squash("LOGISTIC", x / 100), 6).alias("logistic_value"), sem.squash("RELU", x - 50).alias("relu_value"))


@query("unsquash", f"SELECT record_id, CASE WHEN y > 0 AND y < 1 THEN round(ln(y / (1 - y)), 5) END AS before_logistic, CASE WHEN abs(y) < 1 THEN round(atanh(y), 5) END AS before_tanh FROM (SELECT record_id, CAST(f0 AS DOUBLE) / 100 - 0.1 AS y FROM ({EVENTS.sql}))")
def unsquash(spark, d):
    y = F.col("f0").cast("double") / 100 - 0.1
    return EVENTS.load(spark, d).select("record_id", F.round(sem.unsquash("LOGISTIC", y), 5).alias("before_logistic"), F.round(sem.unsquash("TANH", y), 5).alias("before_tanh"))


@query("if_kernel", f"SELECT record_id, CASE WHEN f1 - CAST(11 AS FLOAT) > 0 THEN f0 + CAST(2.5 AS FLOAT) ELSE f2 + CAST(2.5 AS FLOAT) END AS value FROM ({EVENTS.sql})")
def if_kernel(spark, d):
    return EVENTS.load(spark, d).select("record_id", sem.if_kernel(F.col("f1") - sem.single(11), F.col("f0"), F.col("f2"), sem.single(2.5)).alias("value"))


@query("clamp_correction", chain_sql(EVENTS) + ", c AS (SELECT *, greatest(least(s / n, 2.0), -2.0) AS c FROM hist) SELECT feature, bin, round(c, 4) AS correction, round(2 * c * s - n * c * c, 3) AS gain FROM c")
def clamp_correction(spark, d):
    c = histogram.clamped(F.col("s"), F.col("n"), 2.0)
    hist = histogram.histogram(prepared(spark, d, EVENTS)[3], 3)
    return hist.select("feature", "bin", F.round(c, 4).alias("correction"), F.round(histogram.gain(c, F.col("s"), F.col("n")), 3).alias("gain"))


@query("evaluate_split", chain_sql(EVENTS) + kinds_sql() + " SELECT feature, bin, kind, round(gain, 3) AS gain, affected_records FROM kinds")
def evaluate_split(spark, d):
    _, edges, _, binned = prepared(spark, d, EVENTS)
    found = histogram.split_kinds(histogram.prefix_scan(histogram.histogram(binned, 3), edges), CONTROLS)
    return found.select("feature", "bin", "kind", F.round("gain", 3).alias("gain"), "affected_records")


@query("min_leaf_filter", chain_sql(EVENTS) + kinds_sql(least=2000.0) + " SELECT kind, count(*) AS splits FROM kinds GROUP BY kind")
def min_leaf_filter(spark, d):
    _, edges, _, binned = prepared(spark, d, EVENTS)
    return histogram.split_kinds(histogram.prefix_scan(histogram.histogram(binned, 3), edges), Controls(min_leaf=2000.0)).groupBy("kind").agg(F.count("*").alias("splits"))


@query("gain_filter", chain_sql(EVENTS) + kinds_sql() + " SELECT kind, count(*) AS splits FROM kinds WHERE gain >= 5000 GROUP BY kind")
def gain_filter(spark, d):
    _, edges, _, binned = prepared(spark, d, EVENTS)
    return histogram.split_kinds(histogram.prefix_scan(histogram.histogram(binned, 3), edges), Controls(min_gain=5000.0)).groupBy("kind").agg(F.count("*").alias("splits"))


@query("leaf_correction", chain_sql(EVENTS) + " SELECT CASE WHEN b0 > 7 THEN 1 ELSE 0 END AS leaf, round(greatest(least(sum(CAST(residual AS DOUBLE)) / count(*), 3.0), -3.0), 4) AS correction FROM binned GROUP BY 1")
def leaf_correction(spark, d):
    leaf = F.when(F.col("b0") > 7, 1).otherwise(0)
    sums = prepared(spark, d, EVENTS)[3].groupBy(leaf.alias("leaf")).agg(F.sum("residual").alias("s"), F.count("*").cast("double").alias("n"))
    return rounded(histogram.leaf_means(sums, 3.0), correction=4)


@query("scaled_gain", chain_sql(EVENTS) + kinds_sql() + f", top AS (SELECT * FROM kinds {ORDER_SQL} LIMIT 4) SELECT feature, bin, kind, k AS scale, round(CASE WHEN k < 0 THEN -abs(gain) ELSE gain * (2 * k - k * k) END, 2) AS gain FROM top, (VALUES (0.5::DOUBLE), (1.5::DOUBLE), (-1.0::DOUBLE)) s(k)")
def scaled_gain(spark, d):
    _, edges, _, binned = prepared(spark, d, EVENTS)
    top = histogram.search_stumps(histogram.histogram(binned, 3), edges, Controls(top_k=4))
    k = F.col("scale")
    rows = top.withColumn("scale", F.explode(F.array(*[F.lit(x) for x in (0.5, 1.5, -1.0)])))
    return rows.select("feature", "bin", "kind", "scale", F.round(patches.scaled_gain_column(F.col("gain"), k), 2).alias("gain"))


@query("discard_zero", chain_sql(EVENTS) + kinds_sql() + " SELECT count(*) AS kept FROM kinds WHERE greatest(abs(left_correction), abs(right_correction)) > 0")
def discard_zero(spark, d):
    _, edges, _, binned = prepared(spark, d, EVENTS)
    found = histogram.split_kinds(histogram.prefix_scan(histogram.histogram(binned, 3), edges), CONTROLS)
    return candidates.nonzero(found).agg(F.count("*").alias("kept"))


@query("threshold_filter", SCORED + " SELECT candidate_id FROM scores WHERE candidate_id <> 'baseline' AND score - (SELECT score FROM scores WHERE candidate_id = 'baseline') > 1.0")
def threshold_filter(spark, d):
    found = promotion.rank_screen(promotion.score_all(EVENTS.load(spark, d), FIXED), len(FIXED), 1.0)
    return spark.createDataFrame([(k,) for k, _ in found], "candidate_id string")


@query("pick_winner", SCORED + " SELECT candidate_id AS winner, round(score - (SELECT score FROM scores WHERE candidate_id = 'baseline'), 5) AS improvement FROM scores WHERE candidate_id <> 'baseline' ORDER BY score DESC, candidate_id LIMIT 1")
def pick_winner(spark, d):
    found = promotion.promote(EVENTS.load(spark, d), FIXED, count=len(FIXED))
    return spark.createDataFrame([(found["winner"], round(found["deltas"][found["winner"]], 5))], "winner string, improvement double")


@query("drift_veto", SCORED + """, b AS (SELECT score FROM scores WHERE candidate_id = 'baseline'), w AS (SELECT candidate_id FROM scores WHERE candidate_id <> 'baseline' AND score > (SELECT score FROM b) ORDER BY score DESC, candidate_id LIMIT 1)
    SELECT stored, abs(score - stored) > 1e-6 AS veto, CASE WHEN abs(score - stored) <= 1e-6 THEN (SELECT candidate_id FROM w) END AS winner FROM b, (SELECT unnest([0.25, -7.0, 0.5])::DOUBLE AS stored UNION ALL SELECT round(score, 8) FROM b)""")
def drift_veto(spark, d):
    rows = EVENTS.load(spark, d)
    base = promotion.score_all(rows, [])["baseline"][0]
    found = [(s, promotion.promote(rows, FIXED, count=len(FIXED), stored_baseline=s, drift=1e-6)) for s in (0.25, -7.0, 0.5, round(base, 8))]
    return spark.createDataFrame([(s, x["veto"], x["winner"]) for s, x in found], "stored double, veto boolean, winner string")


@query("parity_gate", f"SELECT abs(m - m2) <= 1e-9 + 1e-6 * abs(m2) AS same, FALSE AS other FROM (SELECT avg(pow(CAST(y AS DOUBLE) - p, 2)) AS m, avg(pow(CAST(residual AS DOUBLE), 2)) AS m2 FROM ({PARTS.sql}))")
def parity_gate(spark, d):
    rows = PARTS.load(spark, d)
    local, other = rows.agg(residuals.mse(F.col("y"), F.col("p")).alias("a")).first().a, promotion.score_all(rows, [])["baseline"][1]
    return spark.createDataFrame([(promotion.parity(local, other), promotion.parity(local, other + 1.0))], "same boolean, other boolean")


@query("strategy_label", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 1 THEN 'combo/' || CAST(o_orderkey % 4 AS VARCHAR) || ':' || o_orderpriority ELSE o_orderpriority END AS label FROM orders")
def strategy_label(spark, d):
    k = F.col("o_orderkey") % 4
    return read(spark, d, "orders").select("o_orderkey", candidates.label_column(k, F.col("o_orderpriority")).alias("label"))


@query("anti_tried_carried", f"WITH l AS ({LOG}) SELECT DISTINCT id FROM l WHERE id NOT IN (SELECT id FROM l WHERE incumbent = '2') AND id NOT IN (SELECT id FROM l WHERE position % 13 = 0)")
def anti_tried_carried(spark, d):
    log = verdict_log(spark, d)
    return verdicts.open_ids(log, "2", log.where("position % 13 = 0"))


@query("replay_order", f"""WITH o AS ({LOG}), now AS (SELECT max(at_unix) AS now FROM o), {EVIDENCE}, k AS (SELECT *, CASE WHEN wins > 0 AND losses <= wins THEN 'win' WHEN greatest(now - last[1], 0) >= 86400 THEN 'retry' END AS kind FROM e, now)
    SELECT id, kind, CAST(row_number() OVER (ORDER BY CASE kind WHEN 'win' THEN 0 ELSE 1 END, CASE WHEN kind = 'win' THEN -best[1] END, CASE WHEN kind = 'retry' THEN last[1] END, id) AS INTEGER) AS place FROM k WHERE kind IS NOT NULL""")
def replay_order(spark, d):
    found = verdicts.ranked(verdicts.evidence(verdict_log(spark, d)), later(spark, d), 86_400)
    return found.withColumn("place", F.row_number().over(W.orderBy(*verdicts.replay_rank()))).select("id", "kind", "place")


@query("replay_combos", f"""WITH l AS (SELECT *, CASE WHEN position % 5 = 0 THEN [id, CAST(position % 90 AS VARCHAR)] ELSE [id] END AS members FROM ({LOG})), c AS (SELECT CAST(2 * x AS VARCHAR) AS id FROM range(0, 2000) t(x)),
    m AS (SELECT DISTINCT id, unnest(members) AS member FROM l) SELECT DISTINCT id FROM m WHERE member NOT IN (SELECT id FROM c) AND id NOT IN (SELECT id FROM l WHERE incumbent = '2')""")
def replay_combos(spark, d):
    listed = F.when(F.col("position") % 5 == 0, F.array(F.col("id"), (F.col("position") % 90).cast("string")))
    return verdicts.open_ids(verdict_log(spark, d).withColumn("members", listed), "2", spark.range(0, 4000, 2).select(F.col("id").cast("string")))


@query("file_verdicts", f"SELECT position, id, incumbent, outcome, delta, [repeat('n', 200), 'b']::VARCHAR[] AS notes FROM ({LOG}) l WHERE host <> '0' AND delta > 30 AND NOT EXISTS (SELECT 1 FROM ({LOG}) f WHERE f.host = '0' AND f.id = l.id AND f.incumbent = l.incumbent)")
def file_verdicts(spark, d):
    log = verdict_log(spark, d)
    tested = log.where("host <> '0'").withColumn("full_delta", F.when(F.col("delta") > 30, F.col("delta"))).withColumn("notes", F.array(F.lit("n" * 300), F.lit("b")))
    return verdicts.to_file(tested, log.where("host = '0'")).select("position", "id", "incumbent", "outcome", "delta", "notes")


@query("read_log", f"SELECT host, count(*) AS verdicts, min(at_unix) AS first_at, max(at_unix) AS last_at FROM ({LOG}) GROUP BY host")
def read_log(spark, d):
    path = f"{store.shared_dir(spark)}/log-{uuid.uuid4().hex}"
    verdict_log(spark, d).write.json(path)
    found = files.read_log(spark, path, "host string, at_unix long")
    return found.groupBy("host").agg(F.count("*").alias("verdicts"), F.min("at_unix").alias("first_at"), F.max("at_unix").alias("last_at"))


@query("report_json", f"SELECT CAST(to_json(t) AS VARCHAR) AS report FROM ({ORACLE_SQL['report_totals']}) t")
def report_json(spark, d):
    found = report_totals(spark, d)
    return found.select(artifacts.json_column(found).alias("report"))


@query("top_k_groups", candidates_sql(12, 4, "1, 3") + " SELECT * FROM stacks")
def top_k_groups(spark, d):
    _, edges, _, binned = prepared(spark, d, EVENTS)
    top = placed(histogram.search_stumps(histogram.histogram(binned, 3), edges, Controls(top_k=12, max_per_feature=4)))
    found = candidates.combos(candidates.distinct(candidates.expand(top, edges, scales=(), jitter=0).orderBy("phase", "step", "place").collect()))
    return rounded(spark.createDataFrame([(c.id, c.strategy, len(c.parts), c.gain) for c in found], "id string, strategy string, parts int, gain double"), gain=3)


# ---------------------------------------------------------------- caches, models and their merging, imports, artifacts


@query("ensure_cache", chain_sql(PARTS, 8) + " SELECT feature, bin, threshold FROM edges")
def ensure_cache(spark, d):
    path, rows = f"{store.shared_dir(spark)}/cache-{uuid.uuid4().hex}", PARTS.load(spark, d)
    files.cached_edges(spark, path, rows.where("record_id % 2 = 0"), PARTS.features, 8)  # of another corpus
    files.cached_edges(spark, path, rows, PARTS.features, 8)
    return files.cached_edges(spark, path, rows, PARTS.features, 8)


@query("read_residual_cache", f"SELECT record_id, round(residual, 3) AS residual, round(residual, 3) AS correction FROM (SELECT record_id, y - CAST(1.0 + tanh(-0.5 + CAST(f0 AS DOUBLE) * 0.02) * 40.0 + CAST(f2 AS DOUBLE) * 0.25 AS FLOAT) AS residual FROM ({EVENTS.sql}))")
def read_residual_cache(spark, d):
    path, rows = f"{store.shared_dir(spark)}/cache-{uuid.uuid4().hex}", EVENTS.load(spark, d)
    files.cached_residuals(spark, path, rows, HIDDEN)
    return rounded(files.cached_residuals(spark, path, rows, HIDDEN), residual=3, correction=3)


PLAIN = residuals.Model([{"id": "o", "squash": "IDENTITY", "bias": 0.0, "in": [("f0", 1.0)]}], "o")
#: An output that is the smaller of twice a sum and a ceiling, and one that is an IF.
CLAMPED = residuals.Model([{"id": "top", "type": "constant", "bias": 120.0}, {"id": "h", "squash": "IDENTITY", "bias": 0.0, "in": [("f0", 0.5)]}, {"id": "o", "squash": "MINIMUM", "bias": 0.0, "in": [("h", 2.0), ("top", 1.0)]}], "o")
BRANCHED = residuals.Model([{"id": "o", "squash": "IF", "bias": 1.0, "in": [("f2", 1.0, "condition"), ("f0", 1.0, "positive"), ("f1", 1.0, "negative")]}], "o")
OTHER = patches.split(2, 4.0, patches.leaf(1.5), patches.leaf(-1.0))
OTHER_SQL = "CAST(CASE WHEN f2 > CAST(4 AS FLOAT) THEN -1.0 ELSE 1.5 END AS FLOAT)"


def predicted(spark: SparkSession, d: str, model: residuals.Model) -> DataFrame:
    return model.columns(EVENTS.load(spark, d)).select("record_id", F.round(F.col("prediction").cast("double"), 3).alias("prediction"))


@query("graft_patch", f"SELECT record_id, round(CAST(CAST(f0 AS DOUBLE) + {TREE_SQL} AS FLOAT)::DOUBLE, 3) AS prediction FROM ({EVENTS.sql})")
def graft_patch(spark, d):
    return predicted(spark, d, merging.merge(PLAIN, TREE)[0])


@query("graft_patches_with", f"SELECT record_id, round(CAST(1.0 + CAST(CASE WHEN f2 > 0 THEN f0 ELSE f1 END AS DOUBLE) + {TREE_SQL} + {OTHER_SQL} AS FLOAT)::DOUBLE, 3) AS prediction FROM ({EVENTS.sql})")
def graft_patches_with(spark, d):
    return predicted(spark, d, merging.merge_all(BRANCHED, [TREE, OTHER], shared=False)[0])


@query("resolve_anchor", f"SELECT record_id, round(CAST(least(CAST(f0 AS DOUBLE) + {TREE_SQL}, 120.0) AS FLOAT)::DOUBLE, 3) AS prediction FROM ({EVENTS.sql})")
def resolve_anchor(spark, d):
    assert merging.anchor_of(CLAMPED, "o") == merging.Anchor("h", 2.0, "IDENTITY")
    return predicted(spark, d, merging.merge(CLAMPED, TREE)[0])


GRAPHS_SQL = """SELECT s_suppkey, '{"output":"o","neurons":[{"id":"h","squash":"TANH","bias":0.5,"in":[["f' || (s_suppkey % 4) || '",' || (s_nationkey + 1) || '.5]]},{"id":"o","squash":"IDENTITY","bias":0.0,"in":[["h",2.0],["f9",-1.0]]}],"tags":[{"name":"key","value":"' || s_suppkey || '"},{"name":"runs","value":[1,' || s_nationkey || ']},{"value":"nameless"}]}' AS model FROM supplier"""


def graphs(spark: SparkSession, d: str) -> DataFrame:
    """A model's JSON for each supplier."""
    read(spark, d, "supplier").createOrReplaceTempView("supplier_of_graphs")
    return spark.sql(GRAPHS_SQL.replace("FROM supplier", "FROM supplier_of_graphs"))


@query("graph_edge_join", "SELECT s_suppkey, e.* FROM supplier, LATERAL (SELECT 'h' AS neuron, 'TANH' AS squash, 'f' || (s_suppkey % 4) AS source, CAST(NULL AS VARCHAR) AS source_squash, s_nationkey + 1.5::DOUBLE AS weight UNION ALL SELECT 'o', 'IDENTITY', 'h', 'TANH', 2.0::DOUBLE UNION ALL SELECT 'o', 'IDENTITY', 'f9', NULL, -1.0::DOUBLE) e")
def graph_edge_join(spark, d):
    return residuals.graph_edges(graphs(spark, d), "s_suppkey", "model")



@query("read_model", f"SELECT record_id, round(CAST(1.0 + tanh(-0.5 + CAST(f0 AS DOUBLE) * 0.02) * 40.0 + CAST(f2 AS DOUBLE) * 0.25 AS FLOAT)::DOUBLE, 3) AS prediction FROM ({EVENTS.sql})")
def read_model(spark, d):
    path = f"{store.shared_dir(spark)}/model-{uuid.uuid4().hex}.json"
    artifacts.write_best(spark, HIDDEN, {"score": artifacts.score_text(0.5)}, path)
    return predicted(spark, d, artifacts.read_model(spark, path))


@query("read_tags", "SELECT s_suppkey, t.* FROM supplier, LATERAL (SELECT 1 AS place, 'key' AS name, CAST(s_suppkey AS VARCHAR) AS value UNION ALL SELECT 2, 'runs', '[1,' || s_nationkey || ']') t")
def read_tags(spark, d):
    return artifacts.tag_rows(graphs(spark, d), "s_suppkey", "model")



DUMP = json.dumps([{"nodeid": 0, "split": "f1", "split_condition": 12.0, "yes": 1, "no": 2, "children": [{"nodeid": 1, "leaf": -0.5}, {"nodeid": 2, "split": "f0", "split_condition": 50.5, "yes": 3, "no": 4, "children": [{"nodeid": 3, "leaf": 0.25}, {"nodeid": 4, "leaf": 8.0}]}]}, {"nodeid": 0, "leaf": 0.5}])
DUMP_SQL = "CASE WHEN f1 < CAST(12 AS FLOAT) THEN -0.5 WHEN f0 < CAST(50.5 AS FLOAT) THEN 0.25 ELSE 8.0 END"


@query("read_xgb_dump", f"SELECT record_id, CAST({DUMP_SQL} AS FLOAT) AS correction FROM ({EVENTS.sql})")
def read_xgb_dump(spark, d):
    return EVENTS.load(spark, d).select("record_id", patches.value_of(files.boosted_trees(DUMP)[0]).alias("correction"))


@query("import_xgboost", f"WITH c AS ({EVENTS.sql}), e AS (SELECT avg(pow(CAST(residual AS DOUBLE), 2)) AS base, avg(pow(CAST(residual - CAST({DUMP_SQL} AS FLOAT) AS DOUBLE), 2)) AS own FROM c) SELECT round(base - own - 4e-7, 5) AS improvement, own + 4e-7 < base AS accepted FROM e")
def import_xgboost(spark, d):
    found = loop.promote_dump(EVENTS.load(spark, d), DUMP)
    return spark.createDataFrame([(round(next(iter(found["deltas"].values())), 5), found["winner"] is not None)], "improvement double, accepted boolean")


@query("number_format", "SELECT record_id, printf('%.6f', y) AS score, regexp_replace(printf('%+.2e', y), 'e\\+?(-?)0*([0-9])', 'e\\1\\2') AS delta FROM (SELECT event_id AS record_id, value / 7.0 - 5.0 AS y FROM events)")
def number_format(spark, d):
    y = F.col("value") / 7.0 - 5.0
    return read(spark, d, "events").select(F.col("event_id").alias("record_id"), artifacts.score_column(y).alias("score"), artifacts.delta_column(y).alias("delta"))



@query("report_failures", RUNS + """, x AS (SELECT count(*) AS iterations, count(*) FILTER (WHERE accepted) AS acceptances, count(*) FILTER (WHERE iteration % 9 = 0) AS failures, count(*) FILTER (WHERE iteration % 18 = 0) AS vetoes, CAST(sum(n) AS BIGINT) AS generated, CAST(sum(promoted) AS BIGINT) AS promoted, max(timestamp) AS last FROM e)
    SELECT iterations, acceptances, failures, vetoes, generated, promoted, (last - 1704067200) * 1000 AS wall_ms, 0.25::DOUBLE AS opening_score, 0.75::DOUBLE AS final_score, round(generated / ((last - 1704067200) / 60.0), 6) AS candidates_per_minute FROM x""")
def report_failures(spark, d):
    made = experiments(spark, d)
    error = F.when(F.col("iteration") % 18 == 0, "the baseline disagrees").when(F.col("iteration") % 9 == 0, "no score")
    rows = made.select((F.col("iteration") + 2).alias("line"), F.lit("experiment").alias("record"), "timestamp", "iteration", "winner", "improvement", "accepted", "search_ms", "screen_ms", "full_ms", F.size("candidates").cast("long").alias("generated"), F.size(F.filter("candidates", lambda c: c.promoted)).cast("long").alias("promoted"), error.alias("error"), (F.col("iteration") % 18 == 0).alias("veto"))
    ends = spark.createDataFrame([(0, "header", 1_704_067_200, None), (1, "baseline", None, 0.25), (1 << 40, "baseline", None, 0.75)], "line long, record string, timestamp long, score double")
    path = f"{store.shared_dir(spark)}/log-{uuid.uuid4().hex}"
    rows.unionByName(ends, allowMissingColumns=True).write.json(path)
    found = runlog.report(files.read_log(spark, path, runlog.LOG))
    return rounded(found.select("iterations", "acceptances", "failures", "vetoes", "generated", "promoted", "wall_ms", "opening_score", "final_score", "candidates_per_minute"), candidates_per_minute=6)


# ---------------------------------------------------------------- through a model, by another program, many features, growing logs

#: A sum behind TANH, and one behind a clamp whose gain is 2.
BENT = residuals.Model([{"id": "o", "squash": "TANH", "bias": -0.5, "in": [("f0", 0.02)]}], "o")
MERGED = [("a", [TREE]), ("b", [TREE, OTHER])]


def through_sql(kind: str, value: str) -> str:
    """The errors of a model that turns a corrected sum into a value, for no correction and those of MERGED."""
    error = lambda correction: f"avg(pow(CAST(y - CAST({value.format(correction)} AS FLOAT) AS DOUBLE), 2))"
    parts = [("baseline", "0.0", 0), ("a", TREE_SQL, 2), ("b", f"({TREE_SQL} + {OTHER_SQL})", 3)]
    return " UNION ALL ".join(f"SELECT '{kind}' AS model, '{name}' AS candidate, round({error(f'CAST({c} AS DOUBLE)')}, 4) AS error, round(1 - {error(f'CAST({c} AS DOUBLE)')} - {2 * n}e-7, 4) AS score FROM c" for name, c, n in parts)


@query("score_through_model", f"WITH c AS ({EVENTS.sql}) " + through_sql("bent", "tanh(-0.5 + CAST(f0 AS DOUBLE) * 0.02 + {})") + " UNION ALL " + through_sql("clamped", "least(CAST(f0 AS DOUBLE) + {}, 120.0)"))
def score_through_model(spark, d):
    rows = EVENTS.load(spark, d)
    found = [(kind, k, v[1], v[0]) for kind, model in (("bent", BENT), ("clamped", CLAMPED)) for k, v in grafted.scorer(model)(rows, MERGED).items()]
    return rounded(spark.createDataFrame(found, "model string, candidate string, error double, score double"), error=4, score=4)


@query("run_model")
def run_model(spark, d):
    """Each round of a run through a clamp: its score, and that of the model that it has merged by then."""
    rows = EVENTS.load(spark, d)
    found = loop.run(rows, EVENTS.features, bins=16, iterations=2, count=4, model=CLAMPED, targets=["y"])
    model, splits, out = CLAMPED, 0, []
    for i, (name, strategy, parts, _) in enumerate(found.accepted):
        model, splits = merging.merge_all(model, parts)[0], splits + sum(patches.splits(p) for p in parts)
        error = model.columns(rows).agg(residuals.mse(F.col("y"), F.col("prediction")).alias("m")).first().m
        out.append((i, name, strategy, round(found.scores[i + 1], 5), round(1 - error - promotion.UNIT_COST * promotion.UNITS_OF_SPLIT * splits, 5)))
    return spark.createDataFrame(out, "round int, id string, strategy string, score double, merged_score double")


#: A scorer as a program: patches of one feature each, in plain Python.
PROGRAM = """
import json, sys
head = json.loads(sys.stdin.readline())
at = {c: i for i, c in enumerate(head["columns"])}
def value(node, r):
    while "terms" in node:
        (feature, _), = node["terms"]
        node = node["right"] if r[at[f"f{feature}"]] > node["threshold"] else node["left"]
    return node["correction"]
n, sse = 0, {"baseline": 0.0} | {c["id"]: 0.0 for c in head["candidates"]}
for line in sys.stdin:
    r = json.loads(line)
    n += 1
    for c in [{"id": "baseline", "patches": []}, *head["candidates"]]:
        sse[c["id"]] += (r[at["residual"]] - sum(value(p, r) for p in c["patches"])) ** 2
print(json.dumps({"records": n, "sse": sse}))
"""


@query("score_external", SCORED + " SELECT candidate_id, round(score, 4) AS score, round(error, 4) AS error, record_count FROM scores")
def score_external(spark, d):
    score = external.scorer([sys.executable, "-c", PROGRAM], ["f0", "f1", "f2", "residual"])
    return rounded(promotion.scores_frame(spark, score(EVENTS.load(spark, d), FIXED)), score=4, error=4)


@query("build_bins_wide", """WITH s AS (SELECT * FROM (SELECT embedding, row_number() OVER (ORDER BY vec_id) - 1 AS position FROM embeddings) WHERE position % (SELECT greatest(1, (count(*) + 65535) // 65536) FROM embeddings) = 0),
    c AS (SELECT CAST(i - 1 AS INTEGER) AS feature, CAST(embedding[i] AS FLOAT) AS value FROM s, range(1, 65) t(i)),
    r AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS rn, count(*) OVER (PARTITION BY feature) AS n, max(value) OVER (PARTITION BY feature) AS top FROM c),
    p AS (SELECT DISTINCT feature, value AS threshold FROM r JOIN (SELECT unnest(range(1, 32)) AS b) ON rn = least(b * n // 32, n - 1) WHERE value < top)
    SELECT feature, CAST(row_number() OVER (PARTITION BY feature ORDER BY threshold) - 1 AS INTEGER) AS bin, threshold FROM p""")
def build_bins_wide(spark, d):
    x = corpora.vectors(spark, d)
    names = [f"f{i}" for i in range(64)]
    return binning.build_edges(x.select("record_id", *[F.col("x")[i].alias(n) for i, n in enumerate(names)]), names, 32)


@query("growing_report", RUNS + " SELECT CAST(iteration % 5 AS VARCHAR) AS run, count(*) AS iterations, count(*) FILTER (WHERE accepted AND winner IS NOT NULL AND best IS NOT NULL) AS acceptances, CAST(sum(search_ms) AS BIGINT) AS search_ms, CAST(sum(screen_ms) AS BIGINT) AS screen_ms FROM e GROUP BY 1")
def growing_report(spark, d):
    """Logs of five runs, followed in two goes: the second starts from where the first has ended."""
    root = f"{store.shared_dir(spark)}/growing-{uuid.uuid4().hex}"
    made = experiments(spark, d).withColumn("record", F.lit("experiment")).withColumn("line", F.col("iteration")).withColumn("own", F.col("iteration") % 5).drop("candidates")
    for part in (0, 1):
        own = made.where(F.col("iteration") % 2 == part)
        for run in range(5):
            own.where(F.col("own") == run).drop("own").write.mode("append").json(f"{root}/logs/{run}")
        run_report.follow(spark, f"{root}/logs", f"{root}/state", at_once=True).awaitTermination()
    return run_report.reports(spark, f"{root}/state").select("run", "iterations", "acceptances", "search_ms", "screen_ms")


@query("chunk_source", "SELECT p_partkey AS record_id, CAST(p_retailprice AS FLOAT) AS f0, CAST(p_size AS INTEGER) AS chunk FROM part")
def chunk_source(spark, d):
    """Parts by size as chunks of packed numbers, read again by tasks."""
    packed = read(spark, d, "part").groupBy(F.col("p_size").alias("chunk"), F.pmod("p_partkey", F.lit(64)).alias("piece")).agg(F.collect_list(F.struct(F.col("p_partkey").cast("long").alias("key"), F.col("p_retailprice").cast("float").alias("price"))).alias("held"))

    def unpack(chunk):
        yield {"record_id": [x["key"] for x in chunk["held"]], "f0": [x["price"] for x in chunk["held"]], "chunk": [chunk["chunk"]] * len(chunk["held"])}

    return chunks.frame(packed, unpack, "record_id long, f0 float, chunk int")
