from datetime import datetime

from epochloom.operators.orphans import Entity, ForeignKey, ancestors, orphan_cascade

D = lambda d: datetime(2024, 1, d)


def test_reasons(spark):
    parents = [("a", D(1), None), ("b", D(10), None), ("c", D(1), D(5)), ("d", D(1), D(3)), ("d", D(6), None), ("d", D(2), D(4)), ("e", None, None), ("f", D(9), D(9)), (None, D(1), None), ("a", D(1), None)]
    children = [(1, "a", D(2)), (2, "zz", D(2)), (3, "b", D(2)), (4, "b", D(10)), (5, "c", D(4)), (6, "c", D(5)), (7, "d", D(3)), (8, "d", D(5)), (9, "d", D(7)), (10, None, D(2)), (11, "A", D(2)), (12, "e", D(2)), (13, "f", D(9)), (14, "b", None), (15, "zz", None), (2, "zz", D(2))]
    e = {
        "p": Entity(spark.createDataFrame(parents, "k string, loaded_at timestamp_ntz, deleted_at timestamp_ntz"), "k", deleted_at="deleted_at"),
        "c": Entity(spark.createDataFrame([(*c, "x") for c in children], "id long, f string, loaded_at timestamp_ntz, key string"), "id"),
    }
    got = sorted((r["row_id"], r["reason"]) for r in orphan_cascade(e, [ForeignKey("c", "f", "p", "k")]).collect())
    assert got == sorted((str(i), why) for i, why in [(2, "missing"), (2, "missing"), (3, "late"), (6, "deleted"), (8, "deleted"), (11, "missing"), (12, "deleted"), (13, "deleted"), (15, "missing")])


def test_cascade_and_cycle(spark):
    rows = lambda data: Entity(spark.createDataFrame([(*r, D(2)) for r in data], "id long, k string, up string, loaded_at timestamp_ntz"), "id")
    e = {
        "a": rows([(1, "a1", None), (2, "a2", "nowhere"), (3, "a3", None), (4, "a3", "nowhere")]),
        "b": rows([(1, "b1", "a1"), (2, "b2", "a2"), (3, "b3", "a3")]),
        "c": rows([(1, "c1", "b1"), (2, "c2", "b2"), (3, "c3", "b3"), (4, "c4", "bx")]),
    }
    keys = [ForeignKey("a", "up", "c", "k"), ForeignKey("b", "up", "a", "k"), ForeignKey("c", "up", "b", "k")]
    got = sorted((r["table_name"], r["row_id"], r["reason"], r["depth"]) for r in orphan_cascade(e, keys).collect())
    # a3 is borne by a sound row as well, so b3 inherits nothing.
    assert got == [("a", "2", "missing", 0), ("a", "4", "missing", 0), ("b", "2", "inherited", 1), ("c", "2", "inherited", 2), ("c", "4", "missing", 0)]


def test_string_ids_and_a_cycle_at_depth_three(spark):
    rows = lambda data: Entity(spark.createDataFrame([(*r, D(2)) for r in data], "id string, k string, up string, loaded_at timestamp_ntz"), "id")
    e = {
        "a": rows([("r1", "a1", "nowhere"), ("r2", "a2", None), ("r3", "a3", "d1")]),
        "b": rows([("r1", "b1", "a1"), ("r2", "b2", "a2"), ("r3", "b3", "a3")]),
        "c": rows([("r1", "c1", "b1"), ("r2", "c2", "b2"), ("r3", "c3", "b3"), ("r1b", "c1", "b1")]),
        "d": rows([("r1", "d1", "c1"), ("r2", "d2", "c2"), ("r3", "d3", "c3")]),
    }
    # The cycle: a refers to d as well, so a3, b3, c3 and d3 inherit after d1 at depth 3.
    keys = [ForeignKey("a", "up", "d", "k"), ForeignKey("b", "up", "a", "k"), ForeignKey("c", "up", "b", "k"), ForeignKey("d", "up", "c", "k")]
    got = sorted((r["table_name"], r["row_id"], r["depth"]) for r in orphan_cascade(e, keys).collect())
    assert got == [("a", "r1", 0), ("a", "r3", 4), ("b", "r1", 1), ("b", "r3", 5), ("c", "r1", 2), ("c", "r1b", 2), ("c", "r3", 6), ("d", "r1", 3), ("d", "r3", 7)]


def test_ancestors():
    one, two, three, aside = ForeignKey("c", "x", "b", "x"), ForeignKey("b", "x", "a", "x"), ForeignKey("a", "x", "c", "x"), ForeignKey("z", "x", "a", "x")
    assert ancestors([one], [one, two, three, aside]) == [one, two, three]


def test_empty_tables(spark):
    e = {
        "p": Entity(spark.createDataFrame([], "k string, loaded_at timestamp_ntz"), "k"),
        "c": Entity(spark.createDataFrame([], "id long, f string, loaded_at timestamp_ntz"), "id"),
    }
    assert orphan_cascade(e, [ForeignKey("c", "f", "p", "k")]).count() == 0
