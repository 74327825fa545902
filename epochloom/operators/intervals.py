"""Problem 1: overlapping, nested and gapped intervals per entity.

An ordered disjoint-interval map is kept per key; every insertion finds what it overlaps by binary
search, merges it and refreshes the neighbouring gaps. A key may hold a third of all rows, so the
keyed state is partitioned further by time bucket: one state covers one bucket of one key, seeded
with the furthest end of all earlier buckets. The per-bucket facts needed for that (one row per key
and bucket, so bounded by the key's duration) go through a window; the rows themselves never meet in
one task beyond a bucket.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_MS = 3_600_000


class IntervalMap:
    """Disjoint closed intervals in order, with the gap before each.

    Two intervals touch when the later start is at most ``tolerance`` after the earlier end.
    """

    __slots__ = ("ends", "gaps", "starts", "tolerance")

    def __init__(self, tolerance: float = 0.0, starts: list | None = None, ends: list | None = None):
        self.tolerance = tolerance
        self.starts, self.ends = list(starts or []), list(ends or [])
        self.gaps = [None, *(b - a for a, b in zip(self.ends, self.starts[1:], strict=False))][: len(self.starts)]

    def insert(self, start, end) -> None:
        lo = bisect_left(self.ends, start - self.tolerance)
        hi = bisect_right(self.starts, end + self.tolerance, lo)
        if lo < hi:
            start, end = min(start, self.starts[lo]), max(end, self.ends[hi - 1])
        self.starts[lo:hi], self.ends[lo:hi] = [start], [end]
        self.gaps[lo:hi] = [start - self.ends[lo - 1] if lo else None]
        if lo + 1 < len(self.gaps):
            self.gaps[lo + 1] = self.starts[lo + 1] - end


def _bucket_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, bucket, start, end, tolerance, carry, total) -> gaps, closed periods, edges.

    One edge row per bucket with new periods: ``start`` is that of its last period, whose end only
    later buckets can tell; ``end`` is where the period carried into the bucket ended.
    """
    out: dict[str, list] = {c: [] for c in ("key", "bucket", "kind", "start_ms", "end_ms", "total")}
    state: IntervalMap | None = None
    now: tuple = (None, None)
    carry = total = None

    def add(kind: str, start, end) -> None:
        for c, v in zip(out, (now[0], now[1], kind, start, end, total), strict=True):
            out[c].append(v)

    def close() -> None:
        if state is None:
            return
        first = 0 if carry is None else 1
        n = len(state.starts)
        for i in range(max(first, 1), n):
            add("gap", state.ends[i - 1], state.starts[i])
        for i in range(first, n - 1):
            add("period", state.starts[i], state.ends[i])
        if n > first:
            add("edge", state.starts[n - 1], None if first == 0 else state.ends[0])

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pydict(out, schema=_PIECES_ARROW)
        for v in out.values():
            v.clear()
        return batch

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("key", "bucket", "start_ms", "end_ms", "tolerance", "carry", "total")]
        for key, bucket, start, end, tolerance, c, t in zip(*cols, strict=True):
            if (key, bucket) != now or state is None:
                close()
                now, carry, total = (key, bucket), c, t
                state = IntervalMap(tolerance)
                if carry is not None:
                    state.insert(_BEFORE, carry)
            state.insert(start, end)
        if len(out["key"]) > 50_000:
            yield flush()
    close()
    yield flush()


_BEFORE = -(2**62)
_PIECES = "key string, bucket long, kind string, start_ms long, end_ms long, total long"
_PIECES_ARROW = pa.schema([("key", pa.string()), ("bucket", pa.int64()), ("kind", pa.string()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("total", pa.int64())])


def to_ms(seconds: Column) -> Column:
    """Whole milliseconds; NULL for NaN, infinite and absurdly large times."""
    return F.when(F.abs(seconds) < 9e15, F.round(seconds * 1000).cast("long"))


def merge_intervals(df: DataFrame, key: str, start_ms: str, end_ms: str, tolerance: DataFrame | None = None, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Continuous periods and the gaps between them, per key.

    ``df`` needs a string ``key`` and BIGINT times; ``tolerance`` (key, tolerance DOUBLE in ms) gives
    the largest pause that doesn't end a period, 0 where a key has none. Rows with a NULL key or time
    or an end before the start are no intervals. Repeated, nested and touching intervals merge;
    a point (start = end) is an interval. No rows give no rows; other columns are ignored.

    Returns (key, kind, start_ms, end_ms): kind 'period', or 'gap' from the furthest end of a
    period to the start of the next one.
    """
    rows = (
        df.select(F.col(key).cast("string").alias("key"), F.col(start_ms).alias("start_ms"), F.col(end_ms).alias("end_ms"))
        .where("key IS NOT NULL AND start_ms IS NOT NULL AND end_ms IS NOT NULL AND end_ms >= start_ms")
        .withColumn("bucket", F.floor(F.col("start_ms") / bucket_ms))
        # For one start only the furthest end counts: repeated deliveries shrink before the shuffle.
        .groupBy("key", "bucket", "start_ms")
        .agg(F.max("end_ms").alias("end_ms"))
    )
    buckets = rows.groupBy("key", "bucket").agg(F.max("end_ms").alias("reach"))
    by_time = Window.partitionBy("key").orderBy("bucket")
    carries = buckets.select(
        "key", "bucket",
        F.max("reach").over(by_time.rowsBetween(Window.unboundedPreceding, -1)).alias("carry"),
        F.max("reach").over(Window.partitionBy("key")).alias("total"),
    )
    if tolerance is None:
        carries = carries.withColumn("tolerance", F.lit(0.0))
    else:
        per_key = tolerance.select(F.col(tolerance.columns[0]).cast("string").alias("key"), F.col("tolerance").cast("double").alias("t")).groupBy("key").agg(F.max("t").alias("tolerance"))
        carries = carries.join(per_key, "key", "left").withColumn("tolerance", F.coalesce("tolerance", F.lit(0.0)))
    seeded = rows.join(carries, ["key", "bucket"]).repartition("key", "bucket").sortWithinPartitions("key", "bucket", "start_ms")
    pieces = seeded.mapInArrow(_bucket_pieces, _PIECES)
    # Edges, one per bucket, meet by key; everything else stays with its bucket.
    edge = F.col("kind") == "edge"
    after = Window.partitionBy("key", F.when(~edge, F.col("bucket")), edge).orderBy("bucket")
    return (
        pieces.withColumn("closed", F.when(edge, F.coalesce(F.lead("end_ms").over(after), F.col("total"))).otherwise(F.col("end_ms")))
        .select("key", F.when(edge, F.lit("period")).otherwise(F.col("kind")).alias("kind"), "start_ms", F.col("closed").alias("end_ms"))
    )


def starts_inside(points: DataFrame, periods: DataFrame, tolerance: DataFrame, bin_ms: int = BUCKET_MS) -> DataFrame:
    """Rows of ``points`` (key, start_ms, end_ms) that begin inside a period of their key.

    Inside means more than the key's tolerance after the period's start and not after its end.
    Periods are disjoint, so only the last one that starts before a point can hold it: one that starts
    in the point's own time bin, or the last one of the key's earlier bins, which a window over one row
    per key and bin carries on. A period of any length has one row. Repeated points come out once;
    NULL keys or starts match nothing.
    """
    tol = tolerance.select(F.col(tolerance.columns[0]).cast("string").alias("key"), F.col("tolerance").cast("double").alias("t")).groupBy("key").agg(F.max("t").alias("tolerance"))
    spans = periods.join(tol, "key", "left").select(
        "key", F.floor(F.col("start_ms") / bin_ms).alias("bin"), F.struct(F.col("start_ms").alias("from_ms"), F.col("end_ms").alias("to_ms"), F.coalesce("tolerance", F.lit(0.0)).alias("tolerance")).alias("span")
    )
    keyed = points.where("start_ms IS NOT NULL").withColumn("bin", F.floor(F.col("start_ms") / bin_ms))
    bins = spans.unionByName(keyed.select("key", "bin"), allowMissingColumns=True).groupBy("key", "bin").agg(F.max("span").alias("span"))
    earlier = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = bins.select("key", "bin", F.last("span", ignorenulls=True).over(earlier).alias("span")).where("span IS NOT NULL")
    inside = (F.col("start_ms") > F.col("span.from_ms") + F.col("span.tolerance")) & (F.col("start_ms") <= F.col("span.to_ms"))
    return keyed.join(spans.unionByName(carried), ["key", "bin"]).where(inside).select("key", "start_ms", "end_ms").distinct()
