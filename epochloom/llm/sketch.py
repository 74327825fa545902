"""Problem 5: percentiles of large numeric columns from dyadic Count-sketches.

A value in [low, high] is encoded as a whole number of BITS bits. For each binary resolution there is
one signed sketch (coarse resolutions, with no more nodes than a sketch has cells per row, are
counted exactly). Sketches of partitions, days or months are added cell by cell, and subtracting a
sketch deletes its rows. A percentile descends the resolutions, at each going left or right by the
estimated count of the left child. Values outside [low, high] are counted apart, so they keep their ranks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochloom.operators.select import select_ranks
from epochloom.session import cut


@dataclass(frozen=True)
class Shape:
    """What sketches must share to be added: the encoding, the size and the hash seed."""

    low: float = 0.0
    high: float = 1.0
    bits: int = 20
    width: int = 1024
    depth: int = 5
    seed: int = 20240229

    @property
    def exact(self) -> int:
        """The number of resolutions counted exactly."""
        return min(self.bits, int(np.log2(self.width)))

    def offset(self, level: int) -> int:
        """Where the cells of a resolution (1..bits) start in the flat array."""
        return 2 ** min(level, self.exact + 1) - 2 + max(0, level - self.exact - 1) * self.width * self.depth

    @property
    def cells(self) -> int:
        return self.offset(self.bits + 1)

    def encode(self, values: np.ndarray) -> np.ndarray:
        """Order-preserving, for values within [low, high]."""
        return np.minimum((values - self.low) / (self.high - self.low) * 2**self.bits, 2**self.bits - 1).astype(np.int64)

    def decode(self, code: np.ndarray) -> np.ndarray:
        return self.low + (code + 0.5) / 2**self.bits * (self.high - self.low)

    def hashes(self, level: int, row: int) -> tuple[np.uint64, np.uint64]:
        odd = np.random.default_rng([self.seed, level, row]).integers(1, 2**63, 2, dtype=np.uint64)
        return odd[0] | np.uint64(1), odd[1]

    def place(self, level: int, row: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and sign of nodes: multiply-shift on a mixed node number."""
        a, b = self.hashes(level, row)
        h = node.astype(np.uint64) * a + b
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return (h & np.uint64(self.width - 1)).astype(np.int64), 1 - 2 * ((h >> np.uint64(40)) & np.uint64(1)).astype(np.int64)


def sketch_values(shape: Shape, values: np.ndarray, group: np.ndarray, weight: np.ndarray, n_groups: int) -> np.ndarray:
    """One sketch per group, as rows of a (groups, cells + 2) array; the last two count what lies below and above the range."""
    out = np.zeros((n_groups, shape.cells + 2), np.int64)
    for cell, outside in ((shape.cells, values < shape.low), (shape.cells + 1, values > shape.high)):
        out[:, cell] = np.bincount(group[outside], weights=weight[outside], minlength=n_groups)
    inside = (values >= shape.low) & (values <= shape.high)
    group, weight, code = group[inside], weight[inside], shape.encode(values[inside])
    # Equal values of a group are one update with their summed weight.
    both, inverse = np.unique(group.astype(np.int64) << shape.bits | code, return_inverse=True)
    w = np.bincount(inverse, weights=weight)
    g, code = both >> shape.bits, both & (2**shape.bits - 1)
    for level in range(1, shape.bits + 1):
        node = code >> (shape.bits - level)
        at = shape.offset(level)
        if level <= shape.exact:
            n = 2**level
            out[:, at : at + n] += np.bincount(g * n + node, weights=w, minlength=n_groups * n).reshape(n_groups, n).astype(np.int64)
            continue
        for row in range(shape.depth):
            cell, sign = shape.place(level, row, node)
            b = at + row * shape.width
            out[:, b : b + shape.width] += np.bincount(g * shape.width + cell, weights=w * sign, minlength=n_groups * shape.width).reshape(n_groups, shape.width).astype(np.int64)
    return out


def estimate(shape: Shape, sketch: np.ndarray, level: int, node: int) -> float:
    """Estimated count of one node: exact, or the median over the rows of a Count-sketch."""
    at = shape.offset(level)
    if level <= shape.exact:
        return float(sketch[at + node])
    found = []
    for row in range(shape.depth):
        cell, sign = shape.place(level, row, np.array([node]))
        found.append(sketch[at + row * shape.width + cell[0]] * sign[0])
    return float(np.median(found))


def invert(shape: Shape, sketch: np.ndarray, fractions: list[float]) -> tuple[int, list[float], float]:
    """Count, percentiles and a bound on the rank error (as a fraction of the count).

    The percentile of fraction q is the value with rank ceil(q * n), at least 1; infinite where that rank lies
    below or above the range. The bound is three standard deviations of the estimates on the path, from
    each resolution's own second moment.
    """
    inside, below, above = int(sketch[0] + sketch[1]), int(sketch[shape.cells]), int(sketch[shape.cells + 1])
    n = inside + below + above
    if n <= 0:
        return 0, [], 0.0
    values = []
    for q in fractions:
        rank, node, size = max(1.0, np.ceil(q * n)) - below, 0, float(inside)
        if not 0 < rank <= inside:
            values.append(float("-inf") if rank <= 0 else float("inf"))
            continue
        for level in range(1, shape.bits + 1):
            left = min(max(estimate(shape, sketch, level, 2 * node), 0.0), size)
            if rank <= left:
                node, size = 2 * node, left
            else:
                node, size, rank = 2 * node + 1, size - left, rank - left
        values.append(float(shape.decode(np.array([node]))[0]))
    spread = 0.0
    for level in range(shape.exact + 1, shape.bits + 1):
        at = shape.offset(level)
        rows = sketch[at : at + shape.width * shape.depth].reshape(shape.depth, shape.width).astype(float)
        spread += float(np.median((rows**2).sum(axis=1))) / shape.width
    return n, values, 3 * float(np.sqrt(spread)) / n


def _key_struct(groups: list[str]) -> Column:
    return F.to_json(F.struct(*[F.col(g).cast("string").alias(f"g{i}") for i, g in enumerate(groups)]))


_BUFFERED = 500_000


def build_sketches(df: DataFrame, value: str, groups: list[str], shape: Shape, weight: Column | None = None, level_split: int = 4) -> DataFrame:
    """Sketches of every partition's rows, per group: (groups, part, cells).

    NULL and NaN values don't count; NULL groups are groups. ``weight`` (default 1) may be negative:
    a row with weight -1 deletes one row of that value. Each task holds the sketches of at most
    ``_BUFFERED`` rows at a time and emits them, so memory doesn't follow the number of groups.
    A sketch is cut into ``level_split`` parts, so that parts of one group merge in different tasks.
    """
    v = F.col(value).cast("double")
    w = (F.lit(1) if weight is None else weight).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(_key_struct(groups).alias("key"), v.alias("v"), w.alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= _BUFFERED:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column("key").combine_chunks().dictionary_encode()
        names = keys.dictionary.to_pylist()
        codes, values, weights = keys.indices.to_numpy(), table.column("v").to_numpy(), table.column("w").to_numpy()
        order = np.argsort(codes, kind="stable")
        codes, values, weights = codes[order], values[order], weights[order]
        for first in range(0, len(names), 64):  # so many groups' sketches at a time
            lo, hi = np.searchsorted(codes, [first, first + 64])
            some = names[first : first + 64]
            yield _pieces(some, sketch_values(shape, values[lo:hi], codes[lo:hi] - first, weights[lo:hi], len(some)), level_split)

    return _merged(rows.mapInArrow(run, _PIECE_DDL))


_PIECE_DDL = "key string, part int, cells array<long>"
_PIECE = pa.schema([("key", pa.string()), ("part", pa.int32()), ("cells", pa.list_(pa.int64()))])


def _pieces(names: list[str], sketches: np.ndarray, split: int) -> pa.RecordBatch:
    step = -(-sketches.shape[1] // split)
    cols: dict = {"key": [], "part": [], "cells": []}
    for name, s in zip(names, sketches, strict=True):
        for part in range(split):
            cols["key"].append(name)
            cols["part"].append(part)
            cols["cells"].append(s[part * step : (part + 1) * step])
    return pa.RecordBatch.from_pydict(cols, schema=_PIECE)


def _add_up_by(by: list[str]):
    """Sorted pieces -> one per ``by``: a running sum, whatever the number of pieces."""
    names = ["key", "part", *by[2:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        one = lambda: pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.int32()), pa.array([total], pa.list_(pa.int64())), *[pa.array([x], pa.int32()) for x in now[2:]]], names=["key", "part", "cells", *by[2:]])
        for batch in batches:
            for *key, cells in zip(*[batch.column(c).to_pylist() for c in names], batch.column("cells"), strict=True):
                row = cells.values.to_numpy()
                if key != now:
                    if now is not None:
                        yield one()
                    now, total = key, row.copy()
                else:
                    total += row
        if now is not None:
            yield one()

    return run


def _merged(pieces: DataFrame, salts: int = 8) -> DataFrame:
    """Pieces added up per (key, part), first in ``salts`` tasks each, so that no task reads the pieces of all tasks before it."""
    some = pieces.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    for by in (["key", "part", "salt"], ["key", "part"]):
        some = some.repartition(*by).sortWithinPartitions(*by).mapInArrow(_add_up_by(by), _PIECE_DDL + (", salt int" if "salt" in by else ""))
    return some


def merge_sketches(sketches: DataFrame, regroup: Column | None = None) -> DataFrame:
    """Add sketches of one shape. ``regroup`` maps a key to a coarser one (say, without its month)."""
    return _merged(sketches if regroup is None else sketches.withColumn("key", regroup))


def drop_group(position: int, kept: int) -> Column:
    """A regrouping that drops the group at ``position`` of a key with ``kept`` others."""
    fields = [i for i in range(kept + 1) if i != position]
    return F.to_json(F.struct(*[F.get_json_object("key", f"$.g{i}").alias(f"g{j}") for j, i in enumerate(fields)]))


def subtract_sketches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Delete the rows summed up in ``right`` from the sketches in ``left``."""
    return _merged(left.unionByName(right.withColumn("cells", F.transform("cells", lambda c: -c))))


def _inverted(sketches: DataFrame, shape: Shape, fractions: list[float]) -> DataFrame:
    """(key, n_values, n_outside, q, value, rank_error, low, high) per group; groups without values have no rows.

    ``value`` is within the resolution 2**-bits * (high - low) of a value whose rank is off by at most
    ``rank_error`` * n_values (three standard deviations); low and high are the values at ranks so far
    below and above.
    """
    names = ["key", "n_values", "n_outside", "q", "value", "rank_error", "low", "high"]
    out = pa.schema([("key", pa.string()), ("n_values", pa.int64()), ("n_outside", pa.int64()), *[(c, pa.float64()) for c in names[3:]]])
    cell = (shape.high - shape.low) / 2**shape.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def done() -> pa.RecordBatch:
            whole = np.concatenate(parts)
            n, values, error = invert(shape, whole, fractions)
            # Errors of the bracket's own ends count too; outside [low, high] anything may lie.
            ends = lambda side: invert(shape, whole, [min(max(q + side * 2 * error, 0.0), 1.0) for q in fractions])[1]
            low = [-np.inf if v - cell <= shape.low else min(v - cell, shape.high) for v in ends(-1)]
            high = [np.inf if v + cell >= shape.high else max(v + cell, shape.low) for v in ends(1)]
            m, outside = len(values), int(whole[shape.cells :].sum())
            return pa.RecordBatch.from_pydict(dict(zip(names, ([now] * m, [n] * m, [outside] * m, fractions[:m], values, [error] * m, low, high), strict=True)), schema=out)

        for batch in batches:
            for key, cells in zip(batch.column("key").to_pylist(), batch.column("cells"), strict=True):
                if key != now:
                    if now is not None:
                        yield done()
                    now, parts = key, []
                parts.append(cells.values.to_numpy())
        if now is not None:
            yield done()

    return sketches.repartition("key").sortWithinPartitions("key", "part").mapInArrow(run, "key string, n_values long, n_outside long, q double, value double, rank_error double, low double, high double")


def _unkeyed(groups: list[str]) -> list[Column]:
    return [F.get_json_object("key", f"$.g{i}").alias(g) for i, g in enumerate(groups)]


def percentiles(sketches: DataFrame, groups: list[str], shape: Shape, fractions: list[float]) -> DataFrame:
    """(groups, n_values, n_outside, q, value, rank_error) per group; groups without values have no rows.

    ``value`` is within the resolution 2**-bits * (high - low) of a value whose rank is off by at most
    ``rank_error`` * n_values (three standard deviations); ``n_outside`` of the values lie outside
    [low, high], and a percentile among them is infinite. Groups come back as strings.
    """
    return _inverted(sketches, shape, fractions).select(*_unkeyed(groups), "n_values", "n_outside", "q", "value", "rank_error")


def within_bounds(df: DataFrame, value: str, groups: list[str], found: DataFrame, shape: Shape) -> DataFrame:
    """(groups, q, n_values, within): whether the rank ceil(q * n) of each percentile of ``found`` lies within its bound.

    One pass over ``df`` counts per group how many values lie below and not above each percentile, give or
    take the resolution; every group meets its percentiles as one row. Groups compare as strings.
    """
    cell = (shape.high - shape.low) / 2**shape.bits
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(_key_struct(groups).alias("key"), v.alias("v"))
    per_key = found.select(_key_struct(groups).alias("key"), *groups, "q", "value", "rank_error").groupBy("key", *groups).agg(F.array_sort(F.collect_list(F.struct("q", "value", "rank_error"))).alias("ps"))
    above, under, high, low = (lambda p: p["value"] == float("inf")), (lambda p: p["value"] == float("-inf")), F.col("v") > shape.high, F.col("v") < shape.low
    below = lambda p: F.when(above(p), ~high).otherwise(F.col("v") < p["value"] - cell)
    upto = lambda p: F.when(under(p), low).otherwise(F.col("v") <= p["value"] + cell)
    sides = F.transform("ps", lambda p: F.struct(p["q"].alias("q"), p["rank_error"].alias("rank_error"), below(p).cast("int").alias("below"), upto(p).cast("int").alias("upto")))
    counted = rows.join(per_key, "key").select("key", *groups, F.explode(sides).alias("s")).groupBy("key", *groups, "s.q", "s.rank_error").agg(F.count(F.lit(1)).alias("n_values"), F.sum("s.below").alias("below"), F.sum("s.upto").alias("upto"))
    rank, slack = F.greatest(F.lit(1.0), F.ceil(F.col("q") * F.col("n_values"))), F.col("rank_error") * F.col("n_values")
    return counted.select(*groups, "q", "n_values", ((rank > F.col("below") - slack) & (rank <= F.col("upto") + slack)).alias("within"))


def exact_percentiles(df: DataFrame, value: str, groups: list[str], shape: Shape, fractions: list[float]) -> DataFrame:
    """Percentiles by sketch with the exact ones beside: (groups, n_values, q, value, rank_error, exact).

    The sketch brackets each percentile; a second pass counts what lies below the bracket and selects the
    wanted rank among the few values inside by a radix descent. ``exact`` is the value at rank ceil(q * n),
    the least value of which at least q of all values are no larger. A bracket that misses its rank (as
    three standard deviations may) is widened to all values of its group. Groups keep their types.
    """
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(_key_struct(groups).alias("key"), (v + F.lit(0.0)).alias("v"))
    found = cut(_inverted(build_sketches(df, value, groups, shape), shape, fractions))

    def selected(brackets: DataFrame) -> DataFrame:
        """Exact values of (key, q, n_values, low, high); none where the rank lies outside."""
        per_key = brackets.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("q", "low", "high", "n_values"))).alias("bs"))
        near = rows.join(per_key, "key")
        inside = near.select("key", "v", F.explode(F.filter("bs", lambda b: (F.col("v") >= b["low"]) & (F.col("v") <= b["high"]))).alias("b")).select("key", F.col("b.q").alias("q"), "v")
        below = near.groupBy("key").agg(*[F.sum(F.when(F.col("v") < F.get("bs", F.lit(i))["low"], 1).otherwise(0)).alias(f"b{i}") for i in range(len(fractions))])
        wanted = brackets.join(below, "key").select(
            "key", "q", F.lit(0).alias("target"),
            (F.greatest(F.lit(1.0), F.ceil(F.col("q") * F.col("n_values"))) - F.element_at(F.array(*[F.col(f"b{i}") for i in range(len(fractions))]), F.array_position(F.lit(sorted(fractions)), F.col("q")).cast("int"))).cast("long").alias("rank"),
        )
        return select_ranks(inside, ["key", "q"], "v", wanted).select("key", "q", F.col("value").alias("exact"))

    first = cut(selected(found))
    missed = cut(found.join(first, ["key", "q"], "left_anti"))
    if not missed.isEmpty():
        everything = found.join(missed.select("key").distinct(), "key", "left_semi").withColumns({"low": F.lit(float("-inf")), "high": F.lit(float("inf"))})
        first = first.unionByName(selected(everything).join(missed, ["key", "q"], "left_semi"))
    typed = [c.cast(df.schema[g].dataType).alias(g) for c, g in zip(_unkeyed(groups), groups, strict=True)]
    return found.join(first, ["key", "q"]).select(*typed, "n_values", "q", "value", "rank_error", "exact")
