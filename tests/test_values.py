import math
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from lattica.functions import dynamic, jsontext
from lattica.functions.method_id import method_id
from lattica.functions.values import Typed, checked, narrowed
from lattica.operators import children, grouping
from lattica.plans import types as T
from lattica.plans.paths import operand, parse
from lattica.sources import frames, wire

S = T.Scalar
HOME = T.Struct("Home", (T.Field("city", S("string")),))
PERSON = T.Message("Person", (T.Field("name", S("string"), 1), T.Field("home", HOME, 2)))
COLOR = T.Enum("Color", (("NONE", 0), ("RED", 1), ("CRIMSON", 1)))
SHAPE = T.Union("Shape", (T.Field("Circle", T.Struct("Circle", (T.Field("r", S("float32")),)), 1), T.Field("Box", T.Message("Box", (T.Field("w", S("int32"), 1),)), 2)))
WIDE = T.Message("Wide", (
    T.Field("flag", S("bool"), 1), T.Field("big", S("uint64"), 2), T.Field("huge", S("int128"), 3), T.Field("id", S("uuid"), 4), T.Field("at", S("timestamp"), 5), T.Field("took", S("duration"), 6),
    T.Field("data", T.Bytes(), 7), T.Field("half", S("bfloat16"), 8), T.Field("tags", T.Map(S("string"), T.Array(S("int32"))), 40), T.Field("shape", SHAPE, 200), T.Field("color", COLOR, 255), T.Field("fixed", T.Array(S("int16"), 2), 9),
))
VALUE = {
    "flag": True, "big": Decimal(2**64 - 1), "huge": str(-(2**127)), "id": "00112233-4455-6677-8899-aabbccddeeff", "at": {"s": -1, "ns": 999_999_999, "off_ms": 3}, "took": {"s": 2, "ns": -5},
    "data": b"\x00\xff", "half": 1.5, "tags": {'q"': [1, 2]}, "shape": {"disc": 1, "Circle": {"r": 0.5}, "Box": None}, "color": 1, "fixed": [3, 4],
}


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, {"name": "Ann", "home": {"city": "Bonn"}}), (2, {"name": None, "home": None}), (3, None), (4, {"name": "", "home": {"city": "é"}})]
    return spark.createDataFrame(rows, T.T.StructType([T.T.StructField("id", T.T.LongType()), T.T.StructField("v", T.to_spark(PERSON))]))


class Lazy:
    def __getattr__(self, name):
        return getattr(Typed(F.col("v"), PERSON), name)

    def __getitem__(self, path):
        return Typed(F.col("v"), PERSON)[path]


V = Lazy()  # columns need a session


def column(df, c):
    return [r[0] for r in df.orderBy("id").select(c).collect()]


def test_reads(people):
    assert column(people, V.extract("$.home.city")) == ["Bonn", None, None, "é"]
    assert column(people, V.exists("$.home")) == [1, 0, None, 1]
    assert column(people, V.exists("$.nothing")) == [0, 0, None, 0]
    assert column(people, V.length()) == [2, 0, None, 2]
    assert column(people, V.length("$.home.city")) == [4, None, None, 2]
    assert column(people, V.typeof("$.home")) == ["Home", None, None, "Home"]
    assert column(people, V["home"]["city"].extract()) == ["Bonn", None, None, "é"]
    assert V.get("$.home[0]") is None
    with pytest.raises(T.SchemaError):
        V.get("$[0]")
    with pytest.raises(T.SchemaError):
        V.get("$.name.x")


def test_tree_makes_only_what_is_asked_for(spark):
    """Fields after lists keep their numbers, and texts that nobody reads are never made: one of a NaN would raise."""
    line = T.Struct("L", (T.Field("x", S("float64")), T.Field("names", T.Array(S("string")))))
    t = T.Message("M", (T.Field("lines", T.Array(line), 1), T.Field("more", T.Map(S("string"), S("int32")), 2), T.Field("last", S("string"), 3)))
    value = {"lines": [{"x": float("nan"), "names": ["a", None]}, None, {"x": 1.0, "names": []}], "more": {"k": 7}, "last": "z"}
    rows = children.tree(spark.createDataFrame([(value,)], StructType([StructField("v", T.to_spark(t))])), Typed(F.col("v"), t)).select("id", "parent", "fullkey", "path").collect()
    names = '"x"', '"names"'
    want = [(0, None, "$", "$"), (1, 0, '$."lines"', "$"), (2, 1, '$."lines"[0]', '$."lines"')]
    want += [(3 + i, 2, f'$."lines"[0].{n}', '$."lines"[0]') for i, n in enumerate(names)] + [(5, 4, '$."lines"[0]."names"[0]', '$."lines"[0]."names"')]
    want += [(6, 1, '$."lines"[2]', '$."lines"')] + [(7 + i, 6, f'$."lines"[2].{n}', '$."lines"[2]') for i, n in enumerate(names)]
    want += [(9, 0, '$."more"', "$"), (10, 9, '$."more"."k"', '$."more"'), (11, 0, '$."last"', "$")]
    assert sorted(map(tuple, rows)) == want


def test_batches_of_wire_bytes_are_read_and_written_at_once(monkeypatch):
    """Whole batches give the bytes, values and odd rows of the codec by rows, which right rows no longer need."""
    item = T.Message("K", (T.Field("a", S("byte"), 1), T.Field("t", T.Array(S("string")), 2)))
    t = T.Message("D", (T.Field("v", S("int32"), 1), T.Field("u", S("uint16"), 3), T.Field("k", T.Array(item), 4), T.Field("n", T.Array(T.Struct("P", (T.Field("x", S("int64")), T.Field("y", S("float64"))))), 9)))
    arrow = to_arrow_type(T.to_spark(t))
    item_of = lambda i: {"a": i % 256 if i % 3 else None, "t": ["é" * (i % 5), "b"][: i % 3]}
    values = [None if i % 11 == 0 else {"v": i if i % 2 else None, "u": i, "k": [item_of(i + j) for j in range(i % 4)] if i % 5 else None, "n": [{"x": -i, "y": 0.5}] * (i % 70)} for i in range(300)]
    wires = [None if v is None else wire.encode(t, v) for v in values]
    cut = [w and w[: len(w) - i % 3] for i, w in enumerate(wires)]
    want = []
    for w in cut:
        try:
            want.append(w and wire.decode(t, w))
        except wire.WireError:
            want.append(None)
    monkeypatch.setattr(wire, "encode", None)
    monkeypatch.setattr(wire, "decode", None)
    assert wire._encoded(t, pa.array(values, arrow)).to_pylist() == wires
    made, ok = wire._decoded(t, arrow, pa.array(cut, pa.binary()))
    assert ok.tolist() == [w is not None for w in want]
    assert made.filter(pa.array(ok)).to_pylist() == [w for w in want if w is not None]
    assert wire._encoded(t, pa.array([{"u": -1}], arrow)) is None


def test_changes(people):
    assert column(people, V.set("$.name", "Z").extract("$.name")) == ["Z", "Z", None, "Z"]
    assert column(people, V.insert("$.name", "Z").extract("$.name")) == ["Ann", "Z", None, ""]
    assert column(people, V.replace("$.name", "Z").extract("$.name")) == ["Z", None, None, "Z"]
    assert column(people, V.remove("$.home").length()) == [1, 0, None, 1]
    for bad in (lambda: V.set("$.nothing", 1), lambda: V.remove("$.home.city"), lambda: V.remove("$"), lambda: V.append("$.name", 1)):
        with pytest.raises(T.SchemaError):
            bad()
    with pytest.raises(Exception, match="absent"):
        people.filter("id = 2").select(V.set("$.home.city", "X").column).collect()
    with pytest.raises(Exception, match="null has no typed value"):
        people.select(V.set("$.name", F.lit(None).cast("string")).column).collect()


def test_children(people):
    assert children.each(people, V, "$", ["id"]).toDF("row", *"key value atom kind type node parent fullkey path".split()).filter("row = 1").count() == 2
    rows = children.tree(people, V).filter("value is not null").collect()
    ann = [r for r in rows if r["fullkey"] and "Ann" in (r["value"] or "")]
    assert ann[0]["id"] == 0 and ann[0]["parent"] is None and ann[1]["fullkey"] == '$."name"' and ann[1]["path"] == "$"
    city = next(r for r in rows if r["fullkey"] == '$."home"."city"' and r["value"] == "Bonn")
    assert (city["id"], city["parent"], city["atom"], city["path"]) == (3, 2, "Bonn", '$."home"')
    assert children.tree(people.filter("id = 1"), V).count() == 4
    assert children.each(people, V, "$.nothing").count() == 0
    assert children.each(people.filter("id = 1"), V, "$.name").select("id", "key").collect() == [(0, None)]


def test_arrays_and_maps(spark):
    a = Typed(F.col("a"), T.Array(S("int32")))
    m = Typed(F.col("m"), T.Map(S("string"), S("int32")))
    df = spark.range(1).select(F.array(F.lit(1), F.lit(2)).alias("a"), F.create_map(F.lit("x"), F.lit(1), F.lit("y"), F.lit(0)).alias("m"))
    one = lambda c: df.select(c).first()[0]
    assert one(a.extract("$[#-1]")) == 2 and one(a.extract("$[5]")) is None and one(a.extract("$[-1]")) is None
    assert one(a.insert("$[0]", 9).column) == [9, 1, 2] and one(a.insert("$[2]", 9).column) == [1, 2, 9] and one(a.set("$[#]", 9).column) == [1, 2, 9]
    assert one(a.remove("$[0]").column) == [2] and one(a.remove("$[2]").column) == [1, 2] and one(a.replace("$[#]", 9).column) == [1, 2] and one(a.append("$", 9).column) == [1, 2, 9]
    for path in ("$[2]", "$[3]"):
        with pytest.raises(Exception, match="beyond"):
            one(a.set(path, 1).column)
    assert one(m.map_set("x", 5).column) == {"x": 5, "y": 0} and list(one(m.map_set("z", 5).column)) == ["x", "y", "z"]
    assert one(m.map_has("y")) == 1 and one(m.map_get("q").column) is None and one(m.map_remove("x").column) == {"y": 0} and one(m.set("$.k", 3).map_get("k").column) == 3
    with pytest.raises(Exception, match="fit"):
        one(m.map_set("x", 2**40).column)
    fixed = Typed(F.col("a"), T.Array(S("int32"), 2))
    with pytest.raises(T.SchemaError):
        fixed.append("$", 1)
    assert one(fixed.set("$[1]", 7).column) == [1, 7]


def test_unions_enums_and_rendering(spark):
    df = spark.createDataFrame([(1, VALUE), (2, {**dict.fromkeys(VALUE), "shape": {"disc": 9, "Circle": None, "Box": None}, "color": 7})], T.T.StructType([T.T.StructField("id", T.T.LongType()), T.T.StructField("v", T.to_spark(WIDE))]))
    v = Typed(F.col("v"), WIDE)
    assert column(df, v.branch("$.shape")) == ["Circle", "#9"]
    assert column(df, v.enum_name("$.color")) == ["RED", None]
    assert column(df, v.extract("$.big")) == [str(2**64 - 1), None]
    assert column(df, v.extract("$.at")) == ["-1:999999999:3", None]
    assert column(df, v.extract("$.data[1]")) == [255, None]
    assert column(df, v.extract("$.flag")) == [1, None]
    assert column(df, v.extract('$.tags."q\\""[1]')) == [2, None]
    assert column(df, v.valid()) == [1, 1]
    text = column(df.filter("id = 1"), jsontext.to_json(v))
    assert '"big":"18446744073709551615"' in text[0] and '"tags":[["q\\"",[1,2]]]' in text[0]
    with pytest.raises(Exception, match="unknown branch"):
        column(df.filter("id = 2"), jsontext.to_json(v))
    back = jsontext.from_json(F.lit(text[0]), WIDE)
    assert df.filter("id = 1").select(jsontext.to_json(back)).first()[0] == text[0]
    round_trip = wire.read_wire(wire.write_wire(df.filter("id = 1"), "v", WIDE), "wire", WIDE, "w", strict=True)
    assert round_trip.select((jsontext.to_json(Typed(F.col("w"), WIDE)) == jsontext.to_json(v))).first()[0]


def test_json_of_what_is_absent(spark):
    """Absent text, uuid and wide numbers leave their field out; a required field, an item or a map's value can't be absent."""
    t = T.Message("M", (T.Field("id", S("uuid"), 1), T.Field("name", S("string"), 2), T.Field("n", S("uint64"), 3), T.Field("x", S("float64"), 4)))
    rows = spark.createDataFrame([(1, (None, None, None, None)), (2, (None, "q\"\n", None, 1.5)), (3, None)], T.T.StructType([T.T.StructField("id", T.T.LongType()), T.T.StructField("v", T.to_spark(t))]))
    assert column(rows, jsontext.to_json(Typed(F.col("v"), t))) == ["{}", '{"name":"q\\"\\n","x":1.5}', None]
    for kind, value in ((T.Array(S("string")), F.array(F.lit("a"), F.lit(None))), (T.Map(S("string"), S("string")), F.create_map(F.lit("a"), F.lit(None).cast("string"))), (T.Struct("P", (T.Field("a", S("string")),)), F.struct(F.lit(None).cast("string").alias("a")))):
        with pytest.raises(Exception, match="missing"):
            spark.range(1).select(jsontext.to_json(Typed(value, kind))).collect()


@pytest.mark.parametrize("bad", ['{"name":"a","x":1}', '{"home":{}}', '{"name":1}', '{"name":"a","name":"b"}', "[1]", "{"])
def test_strict_json(spark, bad):
    with pytest.raises(Exception):  # noqa: B017
        spark.range(1).select(jsontext.from_json(F.lit(bad), PERSON).column).collect()


def test_wire_bytes():
    user = T.Message("User", (T.Field("user_id", S("int32"), 1), T.Field("include", S("bool"), 2)))
    # fixed values: examples of the format
    assert wire.encode(user, {"user_id": 42, "include": True}).hex() == "080000002a00000001040310"
    assert wire.encode(user, {"user_id": 42, "include": None}).hex() == "060000002a0000000110"
    assert wire.encode(user, {}).hex() == "0100000000"
    assert wire.encode(T.Map(S("byte"), S("int32")), {1: 100, 2: 200}).hex() == "02000000" + "0164000000" + "02c8000000"
    assert wire.encode(SHAPE, {"disc": 1, "Circle": {"r": 5.0}}).hex() == "05000000010000a040"
    for tags in ([1], [9], [1, 2, 3], [1, 33, 65, 129, 200], [40, 200, 255], list(range(1, 256))):
        t = T.Message("M", tuple(T.Field(f"f{n}", S("int16"), n) for n in tags))
        v = {f"f{n}": n for n in tags}
        assert wire.decode(t, wire.encode(t, v)) == v
        assert wire.decode(user, wire.encode(t, v) if 1 not in tags else wire.encode(user, {})) == {"user_id": None, "include": None}
    for data in ("00", "0100000003", "0600000000", "060000002a0000000310", "080000002a00000002040310"):
        with pytest.raises(wire.WireError):
            wire.decode(user, bytes.fromhex(data))


def test_wire_errors_per_row(spark):
    df = spark.createDataFrame([(1, bytearray(b"\x01")), (2, bytearray(b"\x02")), (3, None)], "id long, b binary")
    assert [(r["value"], r["value_error"]) for r in wire.read_wire(df, "b", S("bool")).orderBy("id").collect()] == [(True, None), (None, "a truth value is 0 or 1"), (None, None)]


@pytest.mark.parametrize(
    ("hexed", "ok", "flags"),
    [
        ("000000000000000000", True, 0), ("000000000100000000", True, 1), ("000000008000000000", True, 0), ("00000000a100000000", True, 1), ("000000000200000000", False, 2), ("000000000800000000", False, 8),
        ("000000000b00000000", False, 11), ("0000000000000000", False, None), ("010000000100000000", False, 1), ("00000000100000000000000000000000", False, 16), ("0100000010000000002a0700000000000000", True, 16),
    ],
)
def test_frames(hexed, ok, flags):
    row = frames._frame(bytes.fromhex(hexed), 0)
    assert (row[4] is None, row[0]) == (ok, flags)


def test_numbers_of_names(spark):
    names = ["/GreeterService/SayHello", "/WidgetService/CreateWidget", "/WidgetService/GetWidget"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(method_id(F.col("n"))).collect()]
    assert got == [0x4D62BEB5, 0xE8CFAE29, 0xA3F73AA7]


def test_halves(spark):
    values = [0.0, 1.0, 1.00390625, 1.01171875, 65504.0, 65520.0, 1e-8, 5.960464477539063e-08, -2.5, float("inf"), 3.4e38]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, x double")
    import numpy as np

    half = column(df, narrowed(F.col("x"), "float16"))
    with np.errstate(over="ignore"):
        assert half == [float(np.float16(v)) for v in values]
    bf = column(df, narrowed(F.col("x"), "bfloat16"))
    assert bf[2] == 1.0 and bf[3] == 1.015625 and math.isinf(bf[9])


def test_grouping(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "k int, o int, v string")
    assert df.groupBy("k").agg(grouping.group_array(F.col("v"), T.Array(S("string")), F.col("o"))).first()[1] == ["a", "b"]
    assert df.groupBy("k").agg(grouping.group_map(F.col("v"), F.col("o"), T.Map(S("string"), S("int32")), F.col("o"))).first()[1] == {"a": 1, "b": 2}
    assert df.filter("k = 2").agg(grouping.group_array(F.col("v"), T.Array(S("string")), F.col("o"))).first()[0] is None
    with pytest.raises(Exception, match="(?i)duplicate"):
        df.groupBy("k").agg(grouping.group_map(F.col("k"), F.col("o"), T.Map(S("int32"), S("int32")), F.col("o"))).collect()
    with pytest.raises(Exception, match="null has no typed value"):
        df.agg(grouping.group_array(F.lit(None).cast("string"), T.Array(S("string")), F.col("o"))).collect()


def test_declarations():
    for bad in (
        lambda: T.Enum("E", (("A", 1),)), lambda: T.Map(S("float32"), S("bool")), lambda: T.Message("M", (T.Field("a", S("bool"), 0),)), lambda: T.Struct("S", (T.Field("a", S("bool")), T.Field("a", S("bool")))),
        lambda: T.Union("U", (T.Field("a", S("bool"), 1),)), lambda: T.Array(S("bool"), 70_000), lambda: S("int7"), lambda: parse("$.a[#]"), lambda: parse("a"), lambda: parse("$..a"),
    ):
        with pytest.raises(T.SchemaError):
            bad()
    assert T.describe(T.Map(S("string"), T.Array(T.Bytes(16)))) == "map[string,byte[16][]]"
    assert T.fixed_size(T.Struct("P", (T.Field("a", T.Array(S("int128"), 2)), T.Field("b", S("bool"))))) == 33
    assert list(T.Registry().add(WIDE).definitions) == ["Circle", "Box", "Shape", "Color", "Wide"]
    assert operand(-1) == "$[#-1]" and operand("a b") == '$."a b"'
    assert dynamic.PREFIX.endswith("/")


def test_declarations_as_text():
    for t in (PERSON, WIDE, SHAPE, T.Enum("E", (("A", 0), ("B", 3)))):
        assert T.from_spec(T.spec_of(t)) == t and T.spec_of(T.from_spec(T.spec_of(t))) == T.spec_of(t)
    for bad in ('{"is":"Other"}', '{"is":"Scalar","kind":"nope"}'):
        with pytest.raises(T.SchemaError):
            T.from_spec(bad)


def test_check_keeps_what_it_refuses(spark):
    t = T.Struct("P", (T.Field("n", S("byte")),))
    df = spark.createDataFrame([(1, (5,)), (2, (300,)), (3, None), (4, (None,))], "id int, v struct<n:smallint>")
    good, bad = checked(df, Typed(F.col("v"), t))
    assert [r["id"] for r in good.collect()] == [1, 3] and {r["id"]: bool(r["reason"]) for r in bad.collect()} == {2: True, 4: True}


def test_messages_that_hold_themselves():
    make = lambda below: T.Message("Node", (T.Field("value", S("int32"), 1), *([T.Field("children", T.Array(below), 2)] if below else [])))
    two, three = T.recursive(make, 2), T.recursive(make, 3)
    deep = {"value": 1, "children": [{"value": 2, "children": [{"value": 3}, {"value": 4}]}, {"value": 5, "children": None}]}
    data = wire.encode(three, deep)
    assert wire.decode(three, data) == deep
    with pytest.raises(wire.WireError, match="deeper"):
        wire.decode(two, data)
    flat = {"value": 1, "children": [{"value": 2}]}
    assert wire.decode(two, wire.encode(two, flat)) == flat
    with pytest.raises(T.SchemaError):
        T.recursive(make, 0)
