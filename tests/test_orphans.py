from datetime import datetime, timedelta

from foliant.operators import orphans

AT = datetime(2025, 3, 31, 23, 59)


def found(spark, refs, parents, deleted, **kw):
    child = spark.createDataFrame(refs, "id string, ref string, loaded_at timestamp, key string, n int")
    r = orphans.references([orphans.Reference("child", child, "id", "ref", "mum", **kw)])
    p = orphans.parents_of({"mum": (spark.createDataFrame(parents, "id string, loaded_at timestamp"), "id")}, spark.createDataFrame(deleted, "table_name string, record_key string"))
    return sorted(map(tuple, orphans.orphans(r, p).collect()))


def row(i, ref, at=AT):
    return (i, ref, at, "clash", 1)


def test_reasons_spellings_nulls_and_repeats(spark):
    refs = [row("a", " P1 "), row("b", "p2"), row("b", "p2", AT + timedelta(days=9)), row("c", "P3"), row("d", "gone"), row("e", None), row("f", "  "), row("g", "GLOBAL"), row("h", "back"), row("i", "nil", None)]
    late, early = AT + timedelta(seconds=1), AT - timedelta(days=1)
    parents = [("p1", early), ("p1", late), ("p3", late), ("back", early), (None, early)]
    deleted = [("mum", "GONE "), ("mum", "gone"), ("mum", "back"), ("dad", "p2"), (None, None)]
    assert found(spark, refs, parents, deleted, no_parent=("global",)) == [
        ("child", "b", "missing", "2025-03"), ("child", "c", "late", "2025-03"), ("child", "d", "deleted", "2025-03"), ("child", "i", "missing", None),
    ]


def test_heavy_keys_give_the_same_as_light_ones(spark):
    """A key with a third of all rows goes by broadcast, the others by shuffle."""
    refs = [row(f"h{i}", "hot") for i in range(1500)] + [row(f"x{i}", f"k{i}") for i in range(3000)]
    got = found(spark, refs, [(f"k{i}", AT - timedelta(days=1)) for i in range(0, 3000, 2)], [("mum", "hot")])
    assert len(got) == 3000 and sum(r[2] == "deleted" for r in got) == 1500 and sum(r[2] == "missing" for r in got) == 1500


def test_empty_tables(spark):
    assert found(spark, [], [], []) == []
    assert found(spark, [row("a", "p")], [], []) == [("child", "a", "missing", "2025-03")]
