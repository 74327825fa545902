"""Problem 4: references to records that don't exist, as a cascade down the foreign-key graph.

Direct orphans refer to a key that isn't there (missing), is only loaded later (late) or was deleted
before (deleted). Children of orphaned records are inherited orphans: semi-joins along the graph's
edges carry orphanhood on until a round finds nothing new.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epochloom.session import cut


@dataclass(frozen=True)
class ForeignKey:
    """``child.field`` refers to ``parent.key``."""

    child: str
    field: str
    parent: str
    key: str


@dataclass(frozen=True)
class Entity:
    """A table of the graph: its rows, their id (of any type, compared as a string) and when they were loaded (and deleted)."""

    rows: DataFrame
    row_id: str
    loaded_at: str = "loaded_at"
    deleted_at: str | None = None


FOREVER = "9999-12-31 23:59:59"


def key_lifetimes(parent: Entity, key: str) -> DataFrame:
    """One row per key: the disjoint spans in which it exists, and when it first was loaded.

    Versions of a key that overlap or touch are merged, so that the list holds real absences only.
    A row without a load time never exists; rows deleted before they were loaded don't either, yet
    both prove the key known.
    """
    rows = parent.rows.where(F.col(key).isNotNull())
    named, loaded = F.col(key).cast("string").alias("key"), F.col(parent.loaded_at).cast("timestamp_ntz").alias("f")
    forever = F.lit(FOREVER).cast("timestamp_ntz")
    if parent.deleted_at is None:
        first = rows.select(named, loaded).groupBy("key").agg(F.min("f").alias("first_loaded"))
        span = F.when(F.col("first_loaded").isNotNull(), F.array(F.struct(F.col("first_loaded").alias("f"), forever.alias("d")))).otherwise(F.array().cast("array<struct<f: timestamp_ntz, d: timestamp_ntz>>"))
        return first.select("key", span.alias("spans"), "first_loaded")
    versions = rows.select(named, loaded, F.coalesce(F.col(parent.deleted_at).cast("timestamp_ntz"), forever).alias("d"))
    # One row per (key, load time): only the longest life counts, so repeats shrink before the shuffle.
    once = versions.groupBy("key", "f").agg(F.max("d").alias("d")).withColumn("alive", F.col("f").isNotNull() & (F.col("d") > F.col("f")))
    in_order = Window.partitionBy("key", "alive").orderBy("f")
    reached = once.withColumn("before", F.max("d").over(in_order.rowsBetween(Window.unboundedPreceding, -1)))
    lives = reached.withColumn("life", F.sum(F.when(F.col("before") >= F.col("f"), 0).otherwise(1)).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = lives.groupBy("key", "alive", "life").agg(F.min("f").alias("f"), F.max("d").alias("d"))
    return spans.groupBy("key").agg(F.array_sort(F.collect_list(F.when(F.col("alive"), F.struct("f", "d")))).alias("spans"), F.min("f").alias("first_loaded"))


def direct_orphans(child: Entity, fk: ForeignKey, parent: Entity) -> DataFrame:
    """Rows of the child whose reference holds for no version of the parent at their load time.

    NULL is no reference. Keys compare exactly, as strings. A child without a load time is judged
    against keys of any time: an orphan only if the key is missing. Repeated child rows are judged
    each. Returns (table_name, field_name, row_id, loaded_at, reason); row ids are strings.
    """
    rows = child.rows.where(F.col(fk.field).isNotNull()).select(F.col(fk.field).cast("string").alias("key"), F.col(child.row_id).cast("string").alias("row_id"), F.col(child.loaded_at).cast("timestamp_ntz").alias("at"))
    # One row per key on the right: a hot key costs no extra rows, and the skewed side can be split.
    judged = rows.join(key_lifetimes(parent, fk.key), "key", "left")
    alive = F.expr("exists(spans, v -> v.f <= at and v.d > at)")
    reason = (
        F.when(F.col("spans").isNull(), "missing")
        .when(F.col("at").isNull() | alive, None)
        .when(F.col("first_loaded") > F.col("at"), "late")
        .otherwise("deleted")
    )
    return judged.select(F.lit(fk.child).alias("table_name"), F.lit(fk.field).alias("field_name"), "row_id", F.col("at").alias("loaded_at"), reason.alias("reason")).where("reason IS NOT NULL")


def ancestors(keys: list[ForeignKey], graph: list[ForeignKey]) -> list[ForeignKey]:
    """``keys`` with the references of ``graph`` above them: those from which their children may inherit."""
    chosen = list(keys)
    for fk in chosen:
        chosen += [k for k in graph if k.child == fk.parent and k not in chosen]
    return chosen


def _lost_keys(parent: Entity, key: str, orphans: DataFrame) -> DataFrame:
    """Keys that only orphaned rows bear, at least one of them newly so. ``orphans``: (row_id, fresh), one row each."""
    bearers = parent.rows.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(parent.row_id).cast("string").alias("row_id"))
    judged = bearers.join(orphans, "row_id", "left").groupBy("key").agg(F.bool_and(F.col("fresh").isNotNull()).alias("gone"), F.max(F.coalesce("fresh", F.lit(False))).alias("fresh"))
    return judged.where("gone AND fresh").select("key")


def orphan_cascade(entities: dict[str, Entity], keys: list[ForeignKey]) -> DataFrame:
    """Direct and inherited orphans of the whole graph.

    Returns (table_name, field_name, row_id, loaded_at, reason, depth): depth 0 and the direct reason,
    or depth n and reason 'inherited' through ``field_name``. A row may be a direct orphan by several
    fields; it inherits at most once per field, at the least depth. A parent key counts as orphaned
    only when every row that bears it is an orphan. Cycles end, as no row is orphaned twice. Every
    round follows only the references whose parent table has new orphans, and writes its own to the
    checkpoint folder; a round that leaves no parent table with new ones is the last. Rounds run when
    the cascade is built.
    """
    if not keys:
        raise ValueError("the foreign-key graph has no edge")
    found = direct_orphans(entities[keys[0].child], keys[0], entities[keys[0].parent])
    for fk in keys[1:]:
        found = found.unionByName(direct_orphans(entities[fk.child], fk, entities[fk.parent]))
    parents = {fk.parent for fk in keys}
    found = cut(found.withColumn("depth", F.lit(0)))
    fresh, depth = found, 0
    while True:
        # One row per table of the graph.
        moved = {r["table_name"] for r in fresh.where(F.col("table_name").isin(*parents)).select("table_name").distinct().collect()}
        if not moved:
            return found
        nxt = None
        for fk in keys:
            if fk.parent not in moved:
                continue
            parent, child = entities[fk.parent], entities[fk.child]
            orphans = found.where(F.col("table_name") == fk.parent).groupBy("row_id").agg((F.min("depth") == depth).alias("fresh"))
            rows = child.rows.select(F.col(fk.field).cast("string").alias("key"), F.col(child.row_id).cast("string").alias("row_id"), F.col(child.loaded_at).cast("timestamp_ntz").alias("loaded_at"))
            heirs = rows.join(_lost_keys(parent, fk.key, orphans), "key", "left_semi").select(F.lit(fk.child).alias("table_name"), F.lit(fk.field).alias("field_name"), "row_id", "loaded_at")
            known = found.where((F.col("table_name") == fk.child) & (F.col("field_name") == fk.field)).select("row_id")
            heirs = heirs.distinct().join(known, "row_id", "left_anti").select("table_name", "field_name", "row_id", "loaded_at")
            nxt = heirs if nxt is None else nxt.unionByName(heirs)
        depth += 1
        fresh = cut(nxt.withColumns({"reason": F.lit("inherited"), "depth": F.lit(depth)}))
        found = found.unionByName(fresh)
