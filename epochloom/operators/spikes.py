"""Problem 3: impossible, stuck and far-off readings per source, by state-space forecasting.

Model, per source: a deviation d from the median that returns to 0, d' = PHI * d + w, seen as z = d + v with
var v = 1, var w = Q. The noise, the unit of z, is estimated from the source as its near spread s / 0.6745: s is
the distance from the median within which, on one of its sides, a quarter of all readings lie. A Kalman
filter forecasts every reading; a standardised innovation above THRESHOLD is flagged and its update
withheld, so that a spike doesn't move the forecast. Flags choose the candidates: only a flagged
reading can be a spike, median distances (MAD) are computed for sources with flags only, and only runs
with a vanishing innovation variance are measured.

Why no case is lost: half of the readings lie within MAD of the median, so a quarter of them do on one of its
sides, and s <= MAD. The gain never exceeds K = P / (P + 1) = 0.0104 with P = Q / (1 - PHI^2), so
|d| <= K * 4 * 1.005 / (1 - PHI) = 0.42. A reading further than 12 MAD off, at least 8.09 units, has an innovation
of at least 7.6 > 4.02: flagged. Five equal readings in a row have innovations, before they are
standardised, within 0.34 of each other however far they are off, thus a variance under 0.03.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochloom.operators.select import percentiles, same_keys, select_ranks
from epochloom.session import cut
from epochloom.sources.tables import nan_to_null

PHI, Q, THRESHOLD, VANISHING, WINDOW = 0.9, 0.002, 4.0, 0.03, 5
#: So many readings before a chunk warm its filter up: what came before them has lost its weight, PHI ** 200 < 1e-9.
WARM_UP = 200
#: The readings to warm up with come from so many chunks before; each has some.
_CHUNKS_BEFORE = 8
#: Sources with more rows are judged by chunks, others where their rows meet; both give the same flags.
WHOLE_SOURCE_ROWS = 500_000
_BATCH_ROWS = 60_000


def kalman_innovations(z: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Innovations of many series at once, standardised and as they are; ``z`` holds the series one after the other.

    Series advance in lockstep, longest first, so that each step is one vector operation.
    """
    out, plain = np.empty(len(z)), np.empty(len(z))
    if not len(z):
        return out, plain
    begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    order = np.argsort(-lengths, kind="stable")
    begin, lengths = begin[order], lengths[order]
    p0 = Q / (1 - PHI * PHI)
    d, p = np.zeros(len(lengths)), np.full(len(lengths), p0)
    alive = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
    for t in range(lengths[0]):
        m = alive[t]
        at = begin[:m] + t
        s = p[:m] + 1
        e = z[at] - d[:m]
        nu = e / np.sqrt(s)
        out[at], plain[at] = nu, e
        keep = np.abs(nu) <= THRESHOLD
        gain = np.where(keep, p[:m] / s, 0.0)
        d[:m] = PHI * (d[:m] + gain * np.where(keep, e, 0.0))
        p[:m] = PHI * PHI * (1 - gain) * p[:m] + Q
    return out, plain


def _near_spread(ordered: np.ndarray, begin: np.ndarray, size: np.ndarray, med: np.ndarray, less: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Per group of sorted values: the distance from the median that holds a quarter of all on one of its sides."""
    k = -(-size // 4)
    at = lambda where, ok: ordered[np.where(ok, begin + where, 0)]
    right, left = less + k <= size, upto >= k
    with np.errstate(invalid="ignore"):
        return np.minimum(np.where(right, at(less + k - 1, right) - med, np.inf), np.where(left, med - at(upto - k, left), np.inf))


def _middle(values: np.ndarray, group: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Median (mean of the middle two), near spread and size per group; NaN for an empty one."""
    size = np.bincount(group, minlength=n_groups)
    med, near = np.full(n_groups, np.nan), np.full(n_groups, np.nan)
    if len(values):
        ordered = values[np.lexsort((values, group))]
        begin = np.concatenate(([0], np.cumsum(size)[:-1]))
        ok = size > 0
        b, n = begin[ok], size[ok]
        med[ok] = (ordered[b + (n - 1) // 2] + ordered[b + n // 2]) / 2
        less, upto = (np.bincount(group, weights=f(values, med[group]), minlength=n_groups).astype(np.int64)[ok] for f in (np.less, np.less_equal))
        near[ok] = _near_spread(ordered, b, n, med[ok], less, upto)
    return med, near, size


def _spikes(y: np.ndarray, source: np.ndarray, nu: np.ndarray, med: np.ndarray, size: np.ndarray, rules: dict) -> np.ndarray:
    """Which readings are spikes: median distances are computed for sources with flagged innovations only."""
    flagged = np.abs(nu) > THRESHOLD
    chosen = np.zeros(len(size), bool)
    chosen[source[flagged]] = True
    chosen &= size >= rules["least"]
    inside = chosen[source]
    spike = np.zeros(len(y), bool)
    if inside.any():
        number = np.cumsum(chosen) - 1
        distance, own = np.abs(y[inside] - med[source[inside]]), number[source[inside]]
        mad = _middle(distance, own, int(chosen.sum()))[0]
        spike[inside] = flagged[inside] & (distance > rules["mads"] * mad[own])
    return spike


def _judge(key_change: np.ndarray, same_reading: np.ndarray, y: np.ndarray, possible: np.ndarray, stats: tuple | None, halo: list | None, rules: dict):
    """Flags of rows sorted by source and order: of whole sources, or of chunks with the stats and neighbours of their sources,
    whose spikes are still to be told from other flagged readings."""
    # One reading per record, however often it was delivered.
    reading = ~(same_reading & ~key_change)
    of_row = np.cumsum(reading) - 1
    y1, possible1 = y[reading], possible[reading]
    source = np.cumsum(key_change[reading]) - 1
    n_sources = int(source[-1]) + 1 if len(source) else 0
    fine = np.flatnonzero(possible1)
    group = source[fine]
    med, near, size = _middle(y1[fine], group, n_sources) if stats is None else stats
    lengths = np.bincount(group, minlength=n_sources)
    values, own = y1[fine], np.ones(len(fine), bool)
    if halo is not None:  # readings before a chunk go through its filter first
        warm = [np.asarray(w, float) for w, _, _ in halo]
        cuts = np.cumsum(lengths)[:-1]
        series = [np.concatenate((w, v)) for w, v in zip(warm, np.split(values, cuts), strict=True)]
        own = np.concatenate([np.arange(len(x)) >= len(w) for w, x in zip(warm, series, strict=True)]) if series else own
        lengths = np.array([len(x) for x in series], np.int64)
        values, group = np.concatenate(series) if series else values, np.repeat(np.arange(n_sources), lengths)
    off = values - med[group]
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        z = np.where(near[group] > 0, off * 0.6745 / near[group], np.where(off != 0, np.sign(off) * np.inf, 0.0))
    z = np.clip(np.nan_to_num(z, nan=0.0, posinf=1e9, neginf=-1e9), -1e9, 1e9)
    nu, plain = (a[own] for a in kalman_innovations(z, lengths[lengths > 0]))
    innovation = np.full(len(y1), np.nan)
    innovation[fine] = nu
    spike = np.zeros(len(y1), bool)
    if stats is None:
        spike[fine] = _spikes(y1[fine], source[fine], nu, med, size, rules)
    # Runs of one value in order, impossible readings between them included.
    breaks = np.ones(len(y1), bool)
    breaks[1:] = (source[1:] != source[:-1]) | (y1[1:] != y1[:-1])
    run = np.cumsum(breaks) - 1
    length = np.bincount(run)
    low = _vanishing(plain, source[fine])
    candidate = np.zeros(len(length), bool)
    candidate[run[fine[low]]] = True
    candidate[run[~possible1]] = True  # impossible readings don't go through the filter
    if halo is None:
        stuck_run = candidate & (length >= rules["run"])
    else:
        # Equal readings of neighbouring chunks reach into the first and last run of a chunk.
        first = np.flatnonzero(np.concatenate(([True], source[1:] != source[:-1]))) if len(y1) else np.array([], int)
        last = np.append(first[1:], len(y1)) - 1 if len(y1) else first
        extra = np.zeros(len(length), int)
        for (_, before, after), f, g in zip(halo, first, last, strict=True):
            extra[run[f]] += _leading(reversed(before), y1[f])
            extra[run[g]] += _leading(after, y1[g])
        stuck_run = (candidate | (extra > 0)) & (length + extra >= rules["run"])
    stuck = stuck_run[run] if len(y1) else np.zeros(0, bool)
    return (~possible1)[of_row], stuck[of_row], spike[of_row], innovation[of_row]


def _leading(values, wanted: float) -> int:
    """How many values equal ``wanted`` before the first that doesn't."""
    n = 0
    for v in values:
        if v != wanted:
            break
        n += 1
    return n


def _vanishing(innovation: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Positions within WINDOW innovations of one source whose variance vanishes."""
    hit = np.zeros(len(innovation), bool)
    if len(innovation) < WINDOW:
        return np.flatnonzero(hit)
    w = np.lib.stride_tricks.sliding_window_view(innovation, WINDOW)
    low = (w.var(axis=1) < VANISHING) & (source[WINDOW - 1 :] == source[: -WINDOW + 1])
    for k in range(WINDOW):
        hit[k : len(innovation) - WINDOW + 1 + k] |= low
    return np.flatnonzero(hit)


def _differs(column: pa.Array) -> np.ndarray:
    """True where a row's value isn't that of the row before (NULL equals NULL); the first is True."""
    out = np.ones(len(column), bool)
    if len(column) > 1:
        a, b = column.slice(0, len(column) - 1), column.slice(1)
        equal = pc.fill_null(pc.equal(a, b), False)
        both = pc.and_(pc.is_null(a), pc.is_null(b))
        out[1:] = ~np.asarray(pc.or_(equal, both))
    return out


_OUT = pa.schema([("row_id", pa.int64()), ("impossible", pa.bool_()), ("stuck", pa.bool_()), ("spike", pa.bool_()), ("innovation", pa.float64())])
_OUT_DDL = "row_id long, impossible boolean, stuck boolean, spike boolean, innovation double"


def _by_group(keys: list[str], work) -> object:
    """``work`` on tables of whole groups of sorted rows; only the last, perhaps unfinished, group is kept back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < _BATCH_ROWS:
                continue
            table = pa.Table.from_batches(held)
            last = int(np.flatnonzero(_changes(table, keys))[-1])
            if last:
                yield work(table.slice(0, last).combine_chunks())
                held = table.slice(last).combine_chunks().to_batches()
                rows -= last
        if rows:
            yield work(pa.Table.from_batches(held).combine_chunks())

    return run


def _changes(table: pa.Table, columns: list[str]) -> np.ndarray:
    """True where one of the columns isn't that of the row before."""
    out = np.zeros(table.num_rows, bool)
    for c in columns:
        out |= _differs(table.column(c).combine_chunks())
    return out


def _repeats(table: pa.Table, order: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Values, and where a row is the reading of the row before once more (if it is of the same source)."""
    y = table.column("_y").to_numpy()
    same = ~_changes(table, order)
    same[1:] &= y[1:] == y[:-1]
    same[:1] = False
    return y, same


def _flags(groups: list[str], order: list[str], rules: dict, chunked: bool):
    def work(table: pa.Table) -> pa.RecordBatch:
        change = _changes(table, groups)
        y, same = _repeats(table, order)
        first = np.flatnonzero(change)
        stats = halo = None
        if chunked:
            facts = table.take(pa.array(first))
            stats = tuple(facts.column(c).to_numpy().astype(float) for c in ("_med", "_near", "_n"))
            halo = [tuple(x or [] for x in three) for three in zip(*[facts.column(c).to_pylist() for c in ("_warm", "_before", "_after")], strict=True)]
        flags = _judge(change, same, y, table.column("_possible").to_numpy().astype(bool), stats, halo, rules)
        any_flag = flags[0] | flags[1] | flags[2] | (np.abs(np.nan_to_num(flags[3])) > THRESHOLD)
        row = table.column("row_id").combine_chunks().filter(pa.array(any_flag))
        return pa.RecordBatch.from_arrays([row, *(pa.array(f[any_flag], from_pandas=True) for f in flags)], schema=_OUT)

    return _by_group(groups, work)


def flag_readings(
    df: DataFrame, row_id: str, source: list[str], order: list[Column], value: str, possible: Column, chunk: list[Column],
    mads: float = 12.0, least: int = 20, run: int = 5, whole_rows: int = WHOLE_SOURCE_ROWS,
) -> DataFrame:
    """Flag readings that are impossible, stuck or far off relative to their own source.

    ``order`` sorts the readings of a source, ``possible`` says which values can be, and ``chunk``
    (non-decreasing in ``order``) says into which parts a source of more than ``whole_rows`` rows is split.
    Each chunk is judged with the statistics of its source and the readings before and after it, so that
    the flags and innovations are those of one piece (given WARM_UP readings in the eight chunks before).
    One job over the source columns finds these sources when the query is built. Rows with a NULL or NaN value are no readings. Rows equal in source, order and value
    are one reading; every one of their ids is reported. NULL (or NaN) source columns form sources of
    their own, and readings without an order come first.

    Returns (row_id, impossible, stuck, spike, innovation) of every row with a flag or an innovation
    above the threshold: ``spike`` needs a flagged innovation and a distance of more than ``mads``
    median distances from the median, in sources of ``least`` possible readings or more; ``stuck`` a
    vanishing innovation variance in a run of ``run`` or more equal readings. An empty input gives
    no rows; further columns don't matter.
    """
    keys = [f"_k{i}" for i in range(len(source))]
    sorts = [f"_o{i}" for i in range(len(order))]
    parts = [f"_c{i}" for i in range(len(chunk))]
    rules = {"mads": mads, "least": least, "run": run}
    y = F.col(value).cast("double")
    base = df.where(y.isNotNull() & ~F.isnan(y)).select(
        F.col(row_id).cast("long").alias("row_id"), *[F.col(s).alias(k) for s, k in zip(source, keys, strict=True)],
        *[o.alias(c) for o, c in zip(order, sorts, strict=True)], y.alias("_y"), F.coalesce(possible, F.lit(False)).alias("_possible"),
        *[c.alias(p) for c, p in zip(chunk, parts, strict=True)],
    )
    base = nan_to_null(base, *keys, *sorts)
    # At most rows / whole_rows sources are large; none in most data.
    several = cut(base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > whole_rows).select(*keys))
    whole = base.drop(*parts)
    if several.isEmpty():
        large = None
    else:
        whole = whole.alias("r").join(several.alias("s"), same_keys(keys, "r", "s"), "left_anti")
        large = base.alias("r").join(several.alias("s"), same_keys(keys, "r", "s"), "left_semi")
    found = whole.repartition(*keys).sortWithinPartitions(*keys, *sorts, "_y").mapInArrow(_flags(keys, sorts, rules, False), _OUT_DDL)
    return found if large is None else found.unionByName(_in_chunks(large, keys, sorts, parts, rules))


def _edges(groups: list[str], order: list[str], schema: str, reach: int):
    """One row per chunk: its first and last ``reach`` readings, and the last WARM_UP possible ones."""
    names = [c.split()[0] for c in schema.split(", ")]

    def work(table: pa.Table) -> pa.RecordBatch:
        change = _changes(table, groups)
        y, same = _repeats(table, order)
        kept, first = ~(same & ~change), np.flatnonzero(change)
        possible = table.column("_possible").to_numpy().astype(bool)
        facts = table.select(groups).take(pa.array(first))
        columns: list[list] = [[], [], []]
        for f, e in zip(first, [*first[1:], table.num_rows], strict=True):
            own, fine = y[f:e][kept[f:e]], y[f:e][kept[f:e] & possible[f:e]]
            for column, v in zip(columns, (own[:reach], own[-reach:], fine[-WARM_UP:]), strict=True):
                column.append(v)
        return pa.RecordBatch.from_arrays([*[facts.column(g).combine_chunks() for g in groups], *[pa.array(c, pa.list_(pa.float64())) for c in columns]], names=names)

    return _by_group(groups, work)


def _in_chunks(large: DataFrame, keys: list[str], sorts: list[str], parts: list[str], rules: dict) -> DataFrame:
    """Sources of several chunks: order statistics by radix selection, a warmed-up filter per chunk, and median distances of
    the sources with flagged readings."""
    groups, reach = [*keys, *parts], rules["run"] - 1
    # Written once: the radix rounds below read it again and again.
    readings = cut(large.groupBy(*groups, *sorts, "_y").agg(F.first("_possible").alias("_possible")))
    fine = readings.where("_possible").select(*keys, "_y")
    med = cut(percentiles(fine, keys, "_y", [0.5]).select(*keys, F.col("p")[0].alias("_med")))
    sides = _join_null_safe(fine, med, keys).groupBy(*keys, "_med").agg(F.count(F.lit(1)).alias("_n"), F.sum((F.col("_y") < F.col("_med")).cast("long")).alias("_less"), F.sum((F.col("_y") <= F.col("_med")).cast("long")).alias("_upto"))
    quarter = F.ceil(F.col("_n") / 4)
    wanted = sides.select(*keys, F.posexplode(F.array(F.col("_less") + quarter, F.col("_upto") - quarter + 1)).alias("target", "rank"))
    near = _join_null_safe(select_ranks(fine, keys, "_y", wanted), med, keys).groupBy(*keys).agg(F.min(F.abs(F.col("value") - F.col("_med"))).alias("_near"))
    stats = _join_null_safe(sides.select(*keys, "_med", "_n"), near, keys, "left").withColumn("_near", F.coalesce("_near", F.lit(0.0)))
    types = dict(large.dtypes)
    schema = ", ".join([*[f"{g} {types[g]}" for g in groups], "_head array<double>", "_tail array<double>", "_fine array<double>"])
    placed = readings.repartition(*groups).sortWithinPartitions(*groups, *sorts, "_y")
    edges = placed.mapInArrow(_edges(groups, sorts, schema, reach), schema)
    w = Window.partitionBy(*keys).orderBy(*parts)
    before, after = w.rowsBetween(-reach, -1), w.rowsBetween(1, reach)
    last = lambda c, n, over: F.reverse(F.slice(F.reverse(F.flatten(F.collect_list(c).over(over))), 1, n))
    halos = edges.select(*groups, last("_fine", WARM_UP, w.rowsBetween(-_CHUNKS_BEFORE, -1)).alias("_warm"), last("_tail", reach, before).alias("_before"), F.slice(F.flatten(F.collect_list("_head").over(after)), 1, reach).alias("_after"))
    rows = _join_null_safe(large, _join_null_safe(halos, stats, keys, "left"), groups)
    rows = rows.withColumns({"_med": F.coalesce("_med", F.lit(0.0)), "_near": F.coalesce("_near", F.lit(0.0)), "_n": F.coalesce("_n", F.lit(0))})
    flags = cut(rows.repartition(*groups).sortWithinPartitions(*groups, *sorts, "_y").mapInArrow(_flags(groups, sorts, rules, True), _OUT_DDL))
    # Flagged readings choose the sources whose median distance is needed.
    flagged = large.join(flags.where(F.abs("innovation") > THRESHOLD).select("row_id").distinct(), "row_id", "left_semi").select("row_id", *keys, "_y")
    chosen = _join_null_safe(stats.where(F.col("_n") >= rules["least"]), flagged.select(*keys).distinct(), keys, "left_semi")
    away = _join_null_safe(fine, chosen, keys).select(*keys, F.abs(F.col("_y") - F.col("_med")).alias("_d"))
    mads = _join_null_safe(chosen, percentiles(away, keys, "_d", [0.5]).select(*keys, F.col("p")[0].alias("_mad")), keys)
    far = _join_null_safe(flagged, mads, keys).where(F.abs(F.col("_y") - F.col("_med")) > rules["mads"] * F.col("_mad")).select(F.col("row_id").alias("_id")).distinct()
    return flags.join(far, flags["row_id"] == far["_id"], "left").select("row_id", "impossible", "stuck", F.col("_id").isNotNull().alias("spike"), "innovation")


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"_r{k}") for k in keys], *[c for c in right.columns if c not in keys and c not in left.columns])
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(renamed[f"_r{k}"])
    return left.join(renamed, same, how).drop(*[f"_r{k}" for k in keys])
