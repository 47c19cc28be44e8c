import pytest

from rangeloom.plans import dispatch as D
from rangeloom.plans.model import INT_MIN, KeyColumn, Metadata, MetadataError, Relation


def meta():
    m = Metadata(["sh1", "sh2", "sh3", "sh4"])
    m.create_distribution("d", ["integer"])
    m.create_range("b", (100,), "sh2")
    m.create_range("a", (0,), "sh1")
    m.attach("d", Relation("t", [KeyColumn("id")]))
    return m


def test_ranges_are_created_from_the_top():
    m = meta()
    with pytest.raises(MetadataError, match="intersects"):
        m.create_range("c", (50,), "sh3")
    with pytest.raises(MetadataError, match="same lower bound"):
        m.create_range("c", (100,), "sh2")
    assert m.create_range("c", (50,), "sh1").lower == (50,)


def test_split_unite_move_lock():
    m = meta()
    for at in (0, -5, 101):
        with pytest.raises(MetadataError, match="out of"):
            m.split("x", "a", (at,))
    assert m.split("x", "a", (50,)) is m.split("x", "a", (50,))
    with pytest.raises(MetadataError, match="not adjacent|different shards"):
        m.unite("a", "b")
    m.lock("a")
    with pytest.raises(MetadataError, match="locked"):
        m.split("y", "a", (10,))
    m.lock("ALL", False)
    assert m.unite("x", "a").lower == (0,)
    m.move("x", "sh4")
    assert m.locate(m.distribution("d"), (7,)).shard == "sh4"
    m.rename("x", "z")
    assert "x" not in m.ranges and m.range("z").id == "z"


def test_equal_split_and_coverage():
    m = Metadata(["sh1", "sh2", "sh3", "sh4"])
    m.create_distribution("ds1", ["integer"])
    assert [r.lower[0] for r in m.equal_split(None)] == [4611686018427387901, -2, -4611686018427387905, INT_MIN]
    assert {m.coverage(r) for r in m.ranges.values()} == {"25.00%"}


def test_default_shard_and_missing_range():
    m = meta()
    with pytest.raises(MetadataError, match="failed to match"):
        m.locate(m.distribution("d"), (-1,))
    m.add_default_shard("d", "sh3")
    assert m.locate(m.distribution("d"), (-1,)).shard == "sh3"
    m.drop_default_shard("d")
    assert "d.DEFAULT" not in m.ranges


def test_keys_and_hashes_have_to_agree():
    m = meta()
    m.create_distribution("h", ["varchar hash", "uuid"])
    with pytest.raises(MetadataError, match="key columns"):
        m.attach("h", Relation("x", [KeyColumn("a")]))
    with pytest.raises(MetadataError, match="don't agree"):
        m.attach("h", Relation("x", [KeyColumn("a"), KeyColumn("b")]))
    with pytest.raises(MetadataError, match="ambiguous"):
        m.distribution(None)
    with pytest.raises(MetadataError, match="uuid"):
        m.create_range(None, (5, "nope"), "sh1", "h")


def test_sequences_and_dump():
    m = meta()
    m.create_reference("r", ["sh1"], {"id": 0})
    m.create_reference("s", sequences={"id": 19})
    assert list(m.next_range("r_id")) == [1] and list(m.next_range("s_id", 2)) == [20, 21]
    with pytest.raises(MetadataError):
        m.next_range("r_id", 0)
    assert Metadata.load(m.dump()).dump() == m.dump()


def test_combine_table():
    a, b, v, r = D.OneShard("a"), D.OneShard("b"), D.Virtual(), D.AnyShard()
    s, t = D.Scatter(frozenset({"b", "c"})), D.Scatter()
    assert D.combine(None, a) == a and D.combine(a, None) == a
    assert D.combine(v, a) == a == D.combine(a, v) and D.combine(v, r) == r
    assert D.combine(r, s) == s == D.combine(s, r)
    assert D.combine(a, a) == a and D.combine(a, b).shards == {"a", "b"}
    assert D.combine(a, s).shards == {"a", "b", "c"} == D.combine(s, a).shards
    assert D.combine(s, t).shards is None
    assert D.finalize(t, ["a", "b"]) == ["a", "b"] and D.finalize(r, ["a", "b"]) == ["a"] and D.finalize(v, ["a"]) == []
    with pytest.raises(D.DispatchError):
        D.finalize(t, ["a", "b"], "BLOCK")
    assert D.finalize(t, ["a", "b"], "b") == ["b"]
