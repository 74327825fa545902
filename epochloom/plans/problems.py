"""Queries of the general problems (1, 3, 4, 6) over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochloom.operators import intervals, orphans, regrid, spikes
from epochloom.operators.orphans import Entity, ForeignKey
from epochloom.session import cut
from epochloom.sources.tables import table


def _frequency_tolerance(spark: SparkSession, folder: str) -> DataFrame:
    """1.5 samples in ms per recording; none for a missing or non-positive frequency."""
    usable = F.col("sampling_frequency") > 0
    return table(spark, folder, "recordings").where(usable & ~F.isnan("sampling_frequency")).select("recording_id", (1500.0 / F.col("sampling_frequency")).alias("tolerance"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Continuous periods, gaps, and runs that begin inside a period, per recording."""
    timed = table(spark, folder, "epoch_metadata").select(
        "recording_id", intervals.to_ms(F.col("absolute_start")).alias("start_ms"), intervals.to_ms(F.col("absolute_end")).alias("end_ms")
    )
    tolerance = _frequency_tolerance(spark, folder)
    found = cut(intervals.merge_intervals(timed, "recording_id", "start_ms", "end_ms", tolerance))
    runs = table(spark, folder, "continuous_runs").select(
        F.col("recording_id").alias("key"), intervals.to_ms(F.col("start_time")).alias("start_ms"), intervals.to_ms(F.col("end_time")).alias("end_ms")
    ).distinct()
    inside = intervals.starts_inside(runs, found.where("kind = 'period'"), tolerance).select("key", F.lit("inside").alias("kind"), "start_ms", "end_ms")
    return found.unionByName(inside).withColumnRenamed("key", "recording_id")


P1_SQL = """
WITH e AS (
  SELECT m.recording_id, CAST(round(absolute_start * 1000) AS BIGINT) AS s, CAST(round(absolute_end * 1000) AS BIGINT) AS e,
         coalesce(1500.0 / r.sampling_frequency, 0) AS tol
  FROM epoch_metadata m LEFT JOIN recordings r USING (recording_id)
  WHERE absolute_start IS NOT NULL AND absolute_end IS NOT NULL AND NOT isnan(absolute_start) AND NOT isnan(absolute_end) AND absolute_end >= absolute_start),
w AS (SELECT *, max(e) OVER (PARTITION BY recording_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before + tol THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM w),
p AS (SELECT recording_id, k, min(s) AS s, max(e) AS e, max(tol) AS tol FROM g GROUP BY recording_id, k),
q AS (SELECT *, max(e) OVER (PARTITION BY recording_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM p),
r AS (SELECT DISTINCT recording_id, CAST(round(start_time * 1000) AS BIGINT) AS s, CAST(round(end_time * 1000) AS BIGINT) AS e FROM continuous_runs WHERE start_time IS NOT NULL AND NOT isnan(start_time))
SELECT recording_id, 'period' AS kind, s AS start_ms, e AS end_ms FROM p
UNION ALL SELECT recording_id, 'gap', prev, s FROM q WHERE prev IS NOT NULL
UNION ALL SELECT DISTINCT r.recording_id, 'inside', r.s, r.e FROM r JOIN p ON r.recording_id = p.recording_id AND r.s > p.s + p.tol AND r.s <= p.e
"""


def _flagged(spark: SparkSession, folder: str, name: str, source: list[str], order: list[str], value: str, possible, chunk: list) -> DataFrame:
    flags = spikes.flag_readings(table(spark, folder, name), "row_id", source, [F.col(o) for o in order], value, possible, chunk)
    return flags.select(F.lit(name).alias("table_name"), "*")


def _spans(seconds: float) -> list:
    return [F.floor(F.col("absolute_start") / seconds)]


def p3_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Readings with any flag or a large innovation, in the three measured tables."""
    finite = lambda c: (F.col(c) != float("inf")) & (F.col(c) != float("-inf"))
    six_hours = 21_600.0
    spectra = _flagged(spark, folder, "spectra", ["recording_id", "electrode", "frequency_hz"], ["block_id", "epoch"], "power", finite("power") & (F.col("power") > 0), [F.col("block_id"), F.floor(F.col("epoch") / 720)])
    features = _flagged(spark, folder, "features", ["recording_id", "electrode"], ["absolute_start", "block_id", "epoch"], "yasa_eeg_std", finite("yasa_eeg_std") & (F.col("yasa_eeg_std") > 0), _spans(six_hours))
    wake = _flagged(spark, folder, "hypnodensities", ["recording_id", "stager", "channel_set"], ["absolute_start", "block_id", "epoch"], "prob_w", F.col("prob_w").between(0, 1), _spans(six_hours))
    return spectra.unionByName(features).unionByName(wake)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose reading is impossible, stuck or far off for its source."""
    return p3_flags(spark, folder).where("impossible OR stuck OR spike").select("table_name", "row_id")


def p3_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of p3_found with what is wrong with each."""
    return p3_flags(spark, folder).where("impossible OR stuck OR spike").drop("innovation")


def _p3_sql(name: str, source: str, order: str, value: str, possible: str, columns: str) -> str:
    return f"""
SELECT '{name}' AS table_name, {columns} FROM (
  WITH r AS (SELECT row_id, {source}, {order}, {value} AS y, {possible} AS ok FROM {name} WHERE {value} IS NOT NULL AND NOT isnan({value})),
  u AS (SELECT DISTINCT {source}, {order}, y, ok FROM r),
  s AS (SELECT {source}, count(*) AS n, median(y) AS m FROM u WHERE ok GROUP BY {source}),
  d AS (SELECT {", ".join("u." + c for c in source.split(", "))}, median(abs(y - m)) AS mad FROM u JOIN s USING ({source}) WHERE ok GROUP BY ALL),
  b AS (SELECT *, CASE WHEN y = lag(y) OVER (PARTITION BY {source} ORDER BY {order}, y) THEN 0 ELSE 1 END AS new FROM u),
  g AS (SELECT *, sum(new) OVER (PARTITION BY {source} ORDER BY {order}, y ROWS UNBOUNDED PRECEDING) AS run FROM b),
  l AS (SELECT *, count(*) OVER (PARTITION BY {source}, run) AS len FROM g),
  k AS (SELECT l.*, NOT ok AS impossible, len >= 5 AS stuck, coalesce(ok AND n >= 20 AND abs(y - m) > 12 * mad, false) AS spike FROM l LEFT JOIN s USING ({source}) LEFT JOIN d USING ({source})),
  c AS (SELECT * FROM k WHERE impossible OR stuck OR spike)
  SELECT DISTINCT row_id, impossible, stuck, spike FROM r JOIN c USING ({source}, {order}, y))"""


def _p3_all(columns: str) -> str:
    return " UNION ALL ".join((
        _p3_sql("spectra", "recording_id, electrode, frequency_hz", "block_id, epoch", "power", "power > 0 AND NOT isinf(power)", columns),
        _p3_sql("features", "recording_id, electrode", "absolute_start, block_id, epoch", "yasa_eeg_std", "yasa_eeg_std > 0 AND NOT isinf(yasa_eeg_std)", columns),
        _p3_sql("hypnodensities", "recording_id, stager, channel_set", "absolute_start, block_id, epoch", "prob_w", "prob_w BETWEEN 0 AND 1", columns),
    ))


P3_SQL, P3_KINDS_SQL = _p3_all("row_id"), _p3_all("row_id, impossible, stuck, spike")


#: The dealt references; p4_found reports these.
REFERENCES = [
    ForeignKey("hypnodensities", "electrode", "electrodes", "electrode"),
    ForeignKey("features", "subject", "subjects", "subject"),
    ForeignKey("hypnodensities", "block_id", "blocks", "block_id"),
    ForeignKey("features", "block_id", "blocks", "block_id"),
]
#: With the tables above and between these, so that orphanhood can be inherited over several steps.
REFERENCE_GRAPH = [
    *REFERENCES,
    ForeignKey("recordings", "subject", "subjects", "subject"),
    ForeignKey("blocks", "recording_id", "recordings", "recording_id"),
    ForeignKey("blocks", "subject", "subjects", "subject"),
    ForeignKey("ratings", "subject", "subjects", "subject"),
    ForeignKey("continuous_runs", "block_id", "blocks", "block_id"),
    ForeignKey("epoch_metadata", "block_id", "blocks", "block_id"),
    ForeignKey("epoch_metadata", "continuous_run_id", "continuous_runs", "run_id"),
    ForeignKey("features", "continuous_run_id", "continuous_runs", "run_id"),
    ForeignKey("hypnodensities", "continuous_run_id", "continuous_runs", "run_id"),
    ForeignKey("features", "epoch_key", "epoch_metadata", "epoch_key"),
]
DELETING = {"electrodes", "subjects", "blocks"}
#: How many steps the SQL follows; the graph's longest path has as many references.
LONGEST_PATH = 5


def _entities(spark: SparkSession, folder: str, keys: list[ForeignKey]) -> dict[str, Entity]:
    names = {fk.child for fk in keys} | {fk.parent for fk in keys}
    found = {}
    for name in names:
        rows, row_id = table(spark, folder, name), {"ratings": "rating_id", "subjects": "subject", "recordings": "recording_id", "electrodes": "electrode", "blocks": "version"}.get(name, "row_id")
        if name == "blocks":  # a block delivered twice is two rows
            rows = rows.withColumn("version", F.concat_ws("@", "block_id", F.col("loaded_at").cast("string")))
        epoch = {"features": "epoch", "epoch_metadata": "epoch_in_block"}.get(name)
        if epoch:
            rows = rows.withColumn("epoch_key", F.concat("block_id", F.lit("#"), F.col(epoch).cast("string")))
        found[name] = Entity(rows, row_id, deleted_at="deleted_at" if name in DELETING else None)
    return found


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Direct orphans of the dealt references, with month and reason: the first step of the cascade over them and all above them."""
    keys = orphans.ancestors(REFERENCES, REFERENCE_GRAPH)
    dealt = F.concat_ws(".", "table_name", "field_name").isin(*[f"{fk.child}.{fk.field}" for fk in REFERENCES])
    rows = orphans.orphan_cascade(_entities(spark, folder, keys), keys).where(dealt & (F.col("depth") == 0))
    return rows.select("table_name", "field_name", F.col("row_id").cast("long").alias("row_id"), F.date_format("loaded_at", "yyyy-MM").alias("period"), "reason")


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """Direct and inherited orphans per table, field, month, reason and depth."""
    rows = orphans.orphan_cascade(_entities(spark, folder, REFERENCE_GRAPH), REFERENCE_GRAPH)
    return rows.groupBy("table_name", "field_name", F.date_format("loaded_at", "yyyy-MM").alias("period"), "reason", "depth").agg(F.count(F.lit(1)).alias("n_rows"))


def _p4_sql(child: str, field: str, parent: str, deleted: str = "deleted_at") -> str:
    key = "run_id" if field == "continuous_run_id" else field
    return f"""
SELECT '{child}' AS table_name, '{field}' AS field_name, c.row_id, strftime(c.loaded_at, '%Y-%m') AS period,
       CASE WHEN p.key IS NULL THEN 'missing' WHEN p.first > c.loaded_at THEN 'late' ELSE 'deleted' END AS reason
FROM {child} c LEFT JOIN (SELECT {key} AS key, min(loaded_at) AS first FROM {parent} GROUP BY 1) p ON p.key = c.{field}
WHERE c.{field} IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM {parent} x WHERE x.{key} = c.{field} AND x.loaded_at <= c.loaded_at AND ({deleted} IS NULL OR {deleted} > c.loaded_at))"""


P4_SQL = " UNION ALL ".join(_p4_sql(fk.child, fk.field, fk.parent, f"x.deleted_at") for fk in REFERENCES)  # noqa: F541


def _p4_report_sql() -> str:
    """The cascade with one CTE per step, as many as the longest path has."""
    ids = {"ratings": "rating_id", "subjects": "subject", "recordings": "recording_id", "electrodes": "electrode", "blocks": "block_id || '@' || CAST(loaded_at AS VARCHAR)"}
    epochs = {"features": "epoch", "epoch_metadata": "epoch_in_block"}
    names = sorted({fk.child for fk in REFERENCE_GRAPH} | {fk.parent for fk in REFERENCE_GRAPH})
    tables = ", ".join(
        f"t_{n} AS (SELECT *, CAST({ids.get(n, 'row_id')} AS VARCHAR) AS id{f', block_id || chr(35) || {epochs[n]} AS epoch_key' if n in epochs else ''}, {'deleted_at' if n in DELETING else 'CAST(NULL AS TIMESTAMP)'} AS gone_at FROM {n})" for n in names
    )
    direct = " UNION ALL ".join(
        f"""SELECT '{k.child}' AS table_name, '{k.field}' AS field_name, c.id, c.loaded_at, CASE WHEN p.key IS NULL THEN 'missing' WHEN p.first > c.loaded_at THEN 'late' ELSE 'deleted' END AS reason, 0 AS depth
        FROM t_{k.child} c LEFT JOIN (SELECT {k.key} AS key, min(loaded_at) AS first FROM t_{k.parent} GROUP BY 1) p ON p.key = c.{k.field}
        WHERE c.{k.field} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t_{k.parent} x WHERE x.{k.key} = c.{k.field} AND x.loaded_at <= c.loaded_at AND (x.gone_at IS NULL OR x.gone_at > c.loaded_at))"""
        for k in REFERENCE_GRAPH
    )
    steps = [f"f0 AS MATERIALIZED ({direct})"]
    for n in range(1, LONGEST_PATH + 1):
        heirs = " UNION ALL ".join(
            f"""SELECT DISTINCT '{k.child}' AS table_name, '{k.field}' AS field_name, c.id, c.loaded_at, 'inherited' AS reason, {n} AS depth FROM t_{k.child} c
            WHERE c.{k.field} IN (SELECT {k.key} FROM t_{k.parent} p LEFT JOIN (SELECT id, min(depth) AS depth FROM f{n - 1} WHERE table_name = '{k.parent}' GROUP BY id) o USING (id) WHERE {k.key} IS NOT NULL GROUP BY 1 HAVING bool_and(o.id IS NOT NULL))
              AND c.id NOT IN (SELECT id FROM f{n - 1} WHERE table_name = '{k.child}' AND field_name = '{k.field}')"""
            for k in REFERENCE_GRAPH
        )
        steps.append(f"f{n} AS MATERIALIZED (SELECT * FROM f{n - 1} UNION ALL {heirs})")
    return f"WITH {tables}, {', '.join(steps)} SELECT table_name, field_name, strftime(loaded_at, '%Y-%m') AS period, reason, depth, count(*) AS n_rows FROM f{LONGEST_PATH} GROUP BY ALL"


P4_REPORT_SQL = _p4_report_sql()


def _p6(spark: SparkSession, folder: str) -> DataFrame:
    runs = table(spark, folder, "continuous_runs")
    pairs = runs.select(F.col("recording_id").alias("key"), F.explode(F.arrays_zip("sample_times", "signal")).alias("z"))
    readings = pairs.select("key", F.col("z.sample_times").alias("time"), F.col("z.signal").alias("value"))
    spans = runs.select(F.col("recording_id").alias("key"), F.col("start_time").alias("start"), F.col("end_time").alias("end"))
    return regrid.regular_grid(readings, spans)


def p6_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Every ten seconds of each recording: a value with its uncertainty, observed or filled."""
    return _p6(spark, folder).select(F.col("key").alias("recording_id"), (F.col("cell") * 10).alias("cell_s"), "kind", "readings", "value", "sd")


def p6_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Cells with their kind, the number of readings in each, and whether it got a value with an uncertainty."""
    filled = F.col("value").isNotNull() & ~F.isnan("value") & (F.col("sd") > 0) & (F.col("sd") < float("inf"))
    return p6_grid(spark, folder).select("recording_id", "cell_s", "kind", "readings", filled.alias("filled"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Cells without readings between a recording's first and last cell with readings."""
    return p6_grid(spark, folder).where("kind <> 'observed'").select("recording_id", "cell_s", "kind")


P6_SQL = """
WITH x AS (SELECT recording_id, unnest(sample_times) AS t, unnest(signal) AS v FROM continuous_runs),
c AS (SELECT DISTINCT recording_id, CAST(floor(t / 10) AS BIGINT) AS cell FROM x WHERE t IS NOT NULL AND NOT isnan(t) AND v IS NOT NULL AND NOT isnan(v)),
r AS (SELECT recording_id, min(cell) AS f, max(cell) AS l FROM c GROUP BY 1),
g AS (SELECT recording_id, unnest(range(f, l + 1)) AS cell FROM r),
m AS (SELECT g.* FROM g ANTI JOIN c USING (recording_id, cell))
SELECT recording_id, cell * 10 AS cell_s,
       CASE WHEN EXISTS (SELECT 1 FROM continuous_runs k WHERE k.recording_id = m.recording_id AND k.start_time < m.cell * 10 + 10 AND k.end_time >= m.cell * 10) THEN 'lost' ELSE 'break' END AS kind
FROM m
"""

P6_CELLS_SQL = """
WITH x AS (SELECT recording_id, unnest(sample_times) AS t, unnest(signal) AS v FROM continuous_runs),
r AS (SELECT DISTINCT recording_id, t, v FROM x WHERE t IS NOT NULL AND NOT isnan(t) AND v IS NOT NULL AND NOT isnan(v)),
c AS (SELECT recording_id, CAST(floor(t / 10) AS BIGINT) AS cell, count(*) AS readings FROM r GROUP BY ALL),
e AS (SELECT recording_id, min(cell) AS f, max(cell) AS l FROM c GROUP BY 1),
g AS (SELECT recording_id, unnest(range(f, l + 1)) AS cell FROM e)
SELECT recording_id, cell * 10 AS cell_s, coalesce(readings, 0) AS readings, true AS filled,
       CASE WHEN readings > 0 THEN 'observed'
            WHEN EXISTS (SELECT 1 FROM continuous_runs k WHERE k.recording_id = g.recording_id AND k.start_time < g.cell * 10 + 10 AND k.end_time >= g.cell * 10) THEN 'lost' ELSE 'break' END AS kind
FROM g LEFT JOIN c USING (recording_id, cell)
"""
