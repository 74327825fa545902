"""Queries of the problems tagged llm, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochloom.llm import bpe, mixing, nearest, quality, sketch
from epochloom.sources.tables import table

MICROS = 1_000_000


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Ratings with the hypnodensity epoch whose middle is nearest, at most 45 seconds away."""
    seconds = F.lit(840) + 60 * F.col("timepoint")
    whole = lambda c, unit: F.when(F.abs(c) < 9e12, F.round(c * unit).cast("long"))  # noqa: E731  NULL for NaN and infinity
    ratings = table(spark, folder, "ratings").select(
        "rating_id", F.upper(F.regexp_replace("subject", r"^\s+|\s+$", "")).alias("subject"), "session", whole(seconds, MICROS).alias("at")
    )
    start, end = (whole(F.col(c), 1000) for c in ("absolute_start", "absolute_end"))
    epochs = (
        table(spark, folder, "hypnodensities").select("subject", "session", start.alias("start_ms"), end.alias("end_ms"))
        .where("start_ms IS NOT NULL AND end_ms IS NOT NULL").select("subject", "session", "start_ms", ((F.col("start_ms") + F.col("end_ms")) * 500).alias("at"))
    )
    return nearest.match_nearest(ratings, epochs, ["subject", "session"], "rating_id", "at", "start_ms", 45 * MICROS)


P2_SQL = """
WITH e AS (SELECT subject, session, CAST(round(absolute_start * 1000) AS BIGINT) AS start_ms,
             (CAST(round(absolute_start * 1000) AS BIGINT) + CAST(round(absolute_end * 1000) AS BIGINT)) * 500 AS mid
           FROM hypnodensities WHERE absolute_start IS NOT NULL AND absolute_end IS NOT NULL GROUP BY ALL),
r AS (SELECT rating_id, upper(trim(subject)) AS subject, session, CAST(round((840 + 60 * timepoint) * 1000000) AS BIGINT) AS t_us
      FROM ratings WHERE subject IS NOT NULL AND timepoint IS NOT NULL AND NOT isnan(timepoint)),
j AS (SELECT rating_id, start_ms, row_number() OVER (PARTITION BY rating_id ORDER BY abs(mid - t_us), mid, start_ms) AS k
      FROM r JOIN e ON r.subject = e.subject AND r.session = e.session AND abs(mid - t_us) <= 45000000)
SELECT rating_id, start_ms FROM j WHERE k = 1
"""

FRACTIONS = [0.05, 0.25, 0.5, 0.75, 0.95]
SHAPE = sketch.Shape()


_P5_GROUPS = ["condition", "experimental_label"]


def _p5_records(spark: SparkSession, folder: str) -> DataFrame:
    """(groups, prob_n1, deliveries) of every record: rows that differ in row_id and loaded_at only are one record."""
    rows = table(spark, folder, "hypnodensities")
    same = F.xxhash64(*[c for c in rows.columns if c not in ("row_id", "loaded_at")])
    return rows.select(*_P5_GROUPS, "prob_n1", same.alias("record")).groupBy("record", *_P5_GROUPS, "prob_n1").agg(F.count(F.lit(1)).alias("deliveries"))


def p5_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of prob_n1 per condition and label, each with its error bound: sketches of every partition added up, less those
    of records delivered again."""
    whole = sketch.build_sketches(table(spark, folder, "hypnodensities"), "prob_n1", _P5_GROUPS, SHAPE)
    again = sketch.build_sketches(_p5_records(spark, folder).where("deliveries > 1"), "prob_n1", _P5_GROUPS, SHAPE, F.col("deliveries") - 1)
    return sketch.percentiles(sketch.subtract_sketches(whole, again), _P5_GROUPS, SHAPE, FRACTIONS)


def p5_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the true rank of each percentile of p5_percentiles lies within its bound."""
    return sketch.within_bounds(_p5_records(spark, folder), "prob_n1", _P5_GROUPS, p5_percentiles(spark, folder), SHAPE)


P5_BOUNDS_SQL = """
WITH r AS (SELECT DISTINCT * EXCLUDE (row_id, loaded_at) FROM hypnodensities),
n AS (SELECT condition, experimental_label, count(*) AS n_values FROM r WHERE prob_n1 IS NOT NULL AND NOT isnan(prob_n1) GROUP BY ALL)
SELECT condition, experimental_label, unnest([0.05, 0.25, 0.5, 0.75, 0.95])::DOUBLE AS q, n_values, true AS within FROM n
"""


def p5_exact(spark: SparkSession, folder: str) -> DataFrame:
    """The exact percentiles of all rows that the sketches' brackets lead to."""
    rows = table(spark, folder, "hypnodensities")
    return sketch.exact_percentiles(rows, "prob_n1", _P5_GROUPS, SHAPE, FRACTIONS).select(*_P5_GROUPS, "q", "n_values", "exact")


P5_SQL = """
WITH v AS (SELECT condition, experimental_label, prob_n1 AS v FROM hypnodensities WHERE prob_n1 IS NOT NULL AND NOT isnan(prob_n1)),
r AS (SELECT *, row_number() OVER (PARTITION BY condition, experimental_label ORDER BY v) AS k, count(*) OVER (PARTITION BY condition, experimental_label) AS n_values FROM v),
q AS (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95])::DOUBLE AS q)
SELECT condition, experimental_label, q, n_values, v AS exact FROM r, q WHERE k = greatest(1, ceil(q * n_values))
"""


def p5_combined(spark: SparkSession, folder: str) -> DataFrame:
    """The same from sketches of every quarter, added up afterwards."""
    quarter = F.concat_ws("-", F.year("loaded_at"), F.quarter("loaded_at"))
    parts = table(spark, folder, "hypnodensities").withColumn("quarter_loaded", quarter)
    quarterly = sketch.build_sketches(parts, "prob_n1", ["condition", "experimental_label", "quarter_loaded"], SHAPE)
    whole = sketch.merge_sketches(quarterly, sketch.drop_group(2, 2))
    return sketch.percentiles(whole, ["condition", "experimental_label"], SHAPE, FRACTIONS)


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return bpe.encode_documents(table(spark, folder, "documents"))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The chosen documents with their repeats."""
    return mixing.mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target, planned and actual tokens and shares of every source."""
    return mixing.mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


def p8_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the mixture keeps every source's cap and comes near its plan."""
    docs = table(spark, folder, "documents")
    chosen, report = mixing.mix_sources(docs, table(spark, folder, "mix_targets"))
    return mixing.within_plan(chosen, report, docs)


P8_BOUNDS_SQL = """
SELECT source, target_share, max_repeats, source IN (SELECT source FROM documents WHERE source IS NOT NULL) AS has_documents, true AS within_repeats, true AS near_plan FROM mix_targets
"""


def _p9_scores(docs: DataFrame) -> DataFrame:
    return quality.outlier_scores(quality.document_statistics(docs))


def p9_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Text statistics and the outlier score of every document."""
    scored = _p9_scores(table(spark, folder, "documents")).drop("text_hash")
    return scored.withColumns({c: F.round(c, 6) for c, t in scored.dtypes if t == "double"})


def _p9_sql() -> str:
    ideograms, least, tails = quality._IDEOGRAMS, quality.PRIOR_DOCUMENTS, []
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    narrow = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")
    for name, direction in quality.STATISTICS.items():
        own, every = "PARTITION BY lang ORDER BY {c} {o} RANGE UNBOUNDED PRECEDING", "ORDER BY {c} {o} RANGE UNBOUNDED PRECEDING"
        tail = lambda o: f"((count(*) OVER ({own.format(c=name, o=o)}) + {least} * count(*) OVER ({every.format(c=name, o=o)}) / n_all) / (n_lang + {least}))"  # noqa: B023, E731
        both = f"least(1.0, 2 * least({tail('ASC')}, {tail('DESC')}))"
        tails.append(f"pow(ln({tail('ASC') if direction == 'low' else tail('DESC') if direction == 'high' else both}), 2)")
    count = lambda pattern: "len(regexp_extract_all(t, '" + pattern.replace("'", "''") + "'))"
    return rf"""
WITH d AS (
  SELECT doc_id, lang, hash(text) AS h, regexp_replace(regexp_replace(coalesce(text, ''), '{quality._BREAKS}', chr(10), 'g'), '\p{{Cf}}+', '', 'g') AS t FROM documents),
f AS (SELECT *, row_number() OVER () AS row, list_filter(string_split_regex(regexp_replace(regexp_replace(strip_accents(lower(translate(t, '{wide}', '{narrow}'))), '</?[a-z][^<>\n]{{0,80}}>', ' ', 'g'),
        '([{ideograms}])', ' \1 ', 'g'), '[^\p{{L}}\p{{M}}]+'), lambda x: len(x) > 0) AS words FROM d),
u AS (SELECT lang, h, row, unnest(list_distinct(words)) AS word FROM f),
n AS (SELECT lang, count(*) AS n FROM f WHERE len(words) > 0 GROUP BY lang),
k AS (SELECT word FROM u JOIN n ON u.lang IS NOT DISTINCT FROM n.lang WHERE len(word) > 1 OR regexp_matches(word, '[{ideograms}]')
      GROUP BY word, u.lang, n HAVING count(*) >= 1 + n / 10000 + sqrt(n) / 32 AND min(h) < max(h)),
w AS (SELECT row, count(*) AS n_words, sum(len(word)) AS letters, sum(CASE WHEN known THEN 1 ELSE 0 END) AS n_known, sum(CASE WHEN known THEN len(word) ELSE 0 END) AS known_letters
      FROM (SELECT row, word, word IN (SELECT word FROM k) AS known FROM (SELECT row, unnest(words) AS word FROM f)) GROUP BY row),
m AS (
  SELECT doc_id, lang, len(regexp_replace(t, '[\s\p{{Z}}]+', '', 'g')) AS n_dense, {count(quality._LINE)} AS n_lines, {count(quality._ENDED)} AS ended,
         {count(quality._SYMBOL)} AS symbols, {count(quality._DIGIT)} AS digits, coalesce(n_words, 0) AS n_words, coalesce(letters, 0) AS letters,
         coalesce(n_known, 0) AS n_known, coalesce(known_letters, 0) AS known_letters,
         CASE WHEN len(words) > 0 AND words[-1] NOT IN (SELECT word FROM k) THEN len(words[-1]) ELSE 0 END AS cut_off, len(regexp_replace(t, '\s+$', '')) - len(rtrim(regexp_replace(t, '\s+$', ''), '.…')) AS dots
  FROM f LEFT JOIN w USING (row)),
s AS (
  SELECT doc_id, lang, n_words, n_lines, n_dense, n_lines - ended AS open_lines, letters / greatest(n_words, 1) AS mean_word_length, symbols / n_dense AS symbol_ratio, digits / n_dense AS digit_ratio,
         ended / greatest(n_lines, 1) AS end_share, (n_lines - ended) / (n_words + 1) AS open_ratio, n_words / greatest(n_lines, 1) AS words_per_line, n_known / greatest(n_words, 1) AS common_share,
         CASE WHEN judged > 0 THEN least(1.0, known_letters / greatest(judged, 1)) ELSE 1.0 END AS readable_share, count(*) OVER (PARTITION BY lang) AS n_lang, count(*) OVER () AS n_all
  FROM (SELECT *, n_dense - CASE WHEN cut_off BETWEEN 1 AND {quality.LONGEST_WORD} THEN cut_off + dots ELSE 0 END AS judged FROM m) WHERE n_dense > 0)
SELECT doc_id, lang, n_words, n_lines, n_dense, open_lines, {", ".join(f"round({c}, 6) AS {c}" for c in ("mean_word_length", "symbol_ratio", "digit_ratio", "end_share", "open_ratio", "words_per_line", "common_share", "readable_share"))},
       round({" + ".join(tails)}, 6) AS score FROM s
UNION ALL SELECT doc_id, lang, {", ".join(["NULL"] * 12)}, 0.0 FROM m WHERE n_dense = 0
"""


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are lists, tables or junk."""
    docs = table(spark, folder, "documents")
    return quality.judge(_p9_scores(docs), docs)


QUERIES = {f.__name__: f for f in (p2_found, p5_percentiles, p5_bounds, p5_exact, p5_combined, p7_ids, p8_mix, p8_shares, p8_bounds, p9_found, p9_scores)}

SQL = {"p2_found": P2_SQL, "p5_bounds": P5_BOUNDS_SQL, "p5_exact": P5_SQL, "p8_bounds": P8_BOUNDS_SQL, "p9_scores": _p9_sql()}
