import random

from rangeloom.functions import hashing as H

TOP = (1 << 63) - 1


def test_known_hashes():
    assert [H.hash_value(v, "integer", m) for v in (TOP, -TOP - 1) for m in ("murmur", "city")] == [3119878097, 2380995212, 1367477491, 1856670072]
    assert H.murmur3(b"test") == 3127628307


def test_varint():
    assert H.varint(0) == bytes(8)
    assert H.varint(128)[:2] == b"\x80\x01" and len(H.varint(128)) == 8
    assert len(H.varint((1 << 56) - 1)) == 8 and len(H.varint(1 << 56)) == 10 and len(H.varint((1 << 64) - 1)) == 10


def test_known_routes():
    assert [H.hash_value(v, "varchar", "murmur") >> 31 for v in ("Hello, world!", "test", "0", "The quick brown fox jumps over the lazy dog")] == [1, 1, 1, 0]
    pairs = [(0, "aba"), (1, "ziziziz"), (2, "ziiziziziz"), (3, "ziizizizi"), (4, "yyuyuyuyu")]
    assert [H.hash_tuple(p, ("integer", "varchar"), "murmur") >> 30 for p in pairs] == [0, 2, 2, 3, 3]


def test_columns_match_literals(spark):
    rng = random.Random(1)
    keys = [0, 1, 127, 128, 1 << 32, (1 << 56) - 1, 1 << 56, TOP, -1, -TOP - 1, None] + [rng.randrange(-TOP, TOP) for _ in range(100)] + [rng.randrange(1 << rng.randrange(1, 60)) for _ in range(100)]
    texts = ["", "a", "ab", "abc", "abcd", "Привет", "x" * 61, None] + ["".join(rng.choice("abé日") for _ in range(rng.randrange(40))) for _ in range(150)]
    for method in H.HASHES:
        for values, kind, schema in ((keys, "integer", "k long"), (texts, "varchar", "k string")):
            df = spark.createDataFrame([(v,) for v in values], schema)
            for r in H.with_hash(df, "k", kind, method, "h").collect():
                assert r.h == (None if r.k is None else H.hash_value(r.k, kind, method)), (method, r.k)


def test_uuid_case_and_expression(spark):
    u = "0E37DF36-F698-11E6-8DD4-CB9CED3DF976"
    df = spark.createDataFrame([(u, 7)], "u string, i long")
    assert H.with_hash(df, "u", "uuid hashed", "murmur", "h").first().h == H.hash_value(u, "uuid", "murmur") == H.murmur3(u.lower().encode())
    assert H.with_expression_hash(df, [("i", "integer"), ("u", "varchar")], "h").first().h == H.hash_tuple((7, u), ("integer", "varchar"), "murmur")


def test_methods_of_expressions_are_compiled(spark):
    """The JVM interprets methods of over 8,000 bytes; a routing expression stays below, whatever its columns."""
    names = ["a", "b", "c", "d"]
    rows = [(1, TOP, -1, 1 << 56), (127, 128, (1 << 56) - 1, 0), (-TOP - 1, 1 << 35, 5, 1 << 49), (None, 1, 2, 3), (1, 2, 3, None)]
    for count in (1, 2, 4):
        columns = [(n, "integer") for n in names[:count]]
        for r in H.with_expression_hash(spark.createDataFrame(rows, "a long, b long, c long, d long"), columns, "h").collect():
            key = tuple(r)[:count]
            assert r.h == (None if None in key else H.hash_tuple(key, ["integer"] * count, "murmur")), key
        df = H.with_expression_hash(spark.range(9).selectExpr("id a", "id * 300 b", "-id c", "id << 50 d"), columns, "h")
        codes = df._jdf.queryExecution().debug().codegenToSeq()
        sizes = [codes.apply(i)._3().maxMethodCodeSize() for i in range(codes.size())]
        assert sizes and max(sizes) < 6000, (count, sizes)
