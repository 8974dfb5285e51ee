"""The documented examples of the query language, corrected where they contradict themselves, and functions by value."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import types as T
from millrace.functions import collections as C
from millrace.functions import images, scalar, text
from millrace.functions import time as M
from millrace.plans.comprehension import Fault, run
from millrace.plans.syntax import SyntaxFault, parse


@pytest.fixture(scope="module")
def t(spark):
    at = lambda m, s: dt.datetime(2023, 6, 5, 8, m, s)
    kv = spark.createDataFrame([(10, 4), (20, 6), (20, 8)], "k long, v long")
    readings = spark.createDataFrame([(at(0, 3), 11), (at(0, 14), 5), (at(0, 27), 8), (at(0, 29), 2)], "t timestamp, v long")
    ships = spark.createDataFrame([(5, "Aurora", at(0, 2)), (6, "Borealis", at(0, 45)), (7, "Comet", at(1, 0))], "id long, name string, t timestamp")
    loads = spark.createDataFrame([(5, 120, at(0, 9)), (6, 75, at(0, 20))], "id long, tons long, t timestamp")
    tries = spark.createDataFrame([((41, None),), ((None, "lost"),), ((43, None),)], "value struct<ok:long,error:string>")
    return {"kv": kv, "readings": readings, "ships": ships, "loads": loads, "tries": tries}


def _values(df):
    return [tuple(r) if len(r) > 1 else r[0] for r in df.collect()]


def test_cross_and_projection(t):
    assert _values(run("val p = [7,9,12]; val q = [4,5]; from x in p, y in q where x != 9", t)) == [(7, 4), (7, 5), (12, 4), (12, 5)]
    assert _values(run("val cube = [[[8],[6,1]],[[3]]]; from plane in cube, line in plane, dot in line yield dot*10", t)) == [80, 60, 10, 30]


def test_selection_and_order(t):
    assert _values(run("val a = [14,3,9,22]; from x in a where x % 3 == 0", t)) == [3, 9]
    assert _values(run("val a = [14,3,9,22]; from x in a order x", t)) == [3, 9, 14, 22]
    assert _values(run("val a = [14,3,9,22]; from x in a sort x desc", t)) == [22, 14, 9, 3]
    assert _values(run("val b = [{n:6,m:1},{n:2,m:8},{n:4,m:5}]; from x in b order x on x.n", t)) == [(2, 8), (4, 5), (6, 1)]


def test_aggregates(t):
    c = run("val a = [5,15,2]; from x in a compute max", t)
    assert c.columns == ["max"] and _values(c) == [15]
    assert _values(run("val b = [{w:5},{w:15},{w:2}]; from x in b compute sum of x.w", t)) == [22]
    assert _values(run("val a = [5,15,2]; from x in a reduce sum", t)) == [5, 20, 22]
    assert _values(run("val a = [40,10,30,60]; from x in a compute median", t)) == [35.0]


def test_groups(t):
    got = run("from x in kv group x.k", t)
    assert sorted((r["k"], len(r["values"])) for r in got.collect()) == [(10, 1), (20, 2)]
    assert sorted(_values(run("from x in kv group x.k compute average of x.v", t))) == [(10, 4.0), (20, 7.0)]


def test_windows(t):
    ends = lambda df, c: sorted((r["end"].second, r[c]) for r in df.collect())
    assert ends(run("from x in readings window 15s on x.t compute sum of x.v", t), "sum") == [(15, 16), (30, 10)]
    got = run("from x in readings window 15s on x.t", t).collect()
    assert sorted((r["end"].second, [v["v"] for v in r["values"]]) for r in got) == [(15, [11, 5]), (30, [8, 2])]
    assert ends(run("from x in readings window 15s on x.t after 4s compute count", t), "count") == [(4, 1), (19, 1), (34, 2)]
    assert ends(run("from x in readings window 20s on x.t every 10s compute count", t), "count") == [(10, 1), (20, 2), (30, 3), (40, 2)]
    assert _values(run("from x in readings over counting(3) on x.t { compute sum of x.v }", t)) == [(0, 3, 24)]


def test_joins(t):
    got = run("from s in ships join c in loads on s.id == c.id select {s.name, c.tons}", t)
    assert sorted(_values(got)) == [("Aurora", 120), ("Borealis", 75)]
    got = run("from s in ships join c in loads on s.id == c.id window 10s on s.t, c.t select {s.name, c.tons}", t)
    assert _values(got) == [("Aurora", 120)]


def test_split_union_into(t):
    ok, bad = run("from tries split error", t)
    assert _values(ok) == [41, 43] and _values(bad) == ["lost"]
    assert _values(run("from x in kv union kv compute count", t)) == [6]
    seen = []
    run("from x in kv where x.v > 5 select x into keep", t, sinks={"keep": lambda df: seen.append(df.count())})
    assert seen == [2]


def test_functions_lambdas_match(t):
    assert _values(run("def cube(x: i32) = x * x * x; val a = [2,5]; from x in a select cube(x)", t)) == [8, 125]
    assert _values(run('val a = ["red-blue", "green"]; from x in a from c in x.split("-") select c', t)) == ["red", "blue", "green"]
    assert _values(run("val a = [[4,9,16]]; from x in a select x.map(fun(y) = y - 4).filter(fun(y) = y > 0)", t)) == [[5, 12]]
    assert _values(run('val a = [3,5,8]; from x in a select match x { 3 | 5 => "odd", _ => "other" }', t)) == ["odd", "odd", "other"]
    assert _values(run("from x in tries select match x { Ok(v) => v + 1, Err(e) => 0 }", t)) == [42, 0, 44]
    assert _values(run("val a = [6]; from x in a select {low: x - 3} & {next: x + 1}", t)) == [(3, 7)]
    assert _values(run("val a = [20]; from x in a from y in 3..=5 select x * y", t)) == [60, 80, 100]
    assert _values(run('val a = [9]; from x in a select "at $x of ${x * 2}."', t)) == ["at 9 of 18."]
    assert _values(run("from {id: i, name: n} in ships where i in [6, 9] select n", t)) == ["Borealis"]


def test_faults(t):
    for bad in ("from y kv", "from y in kv select {", "val = 4; y", "from y in kv where ("):
        with pytest.raises(SyntaxFault):
            parse(bad)
    with pytest.raises(Fault):
        run("from x in nothing select x", t)
    with pytest.raises(Fault):
        run("from x in kv roll sum of x.v", t)


def _one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first().asDict(recursive=True)


def test_strings(spark):
    s = F.lit("añb")
    got = _one(spark, rest=text.remove(s, F.lit(1)), ins=text.insert_char(s, F.lit(1), F.lit("x")), off=text.split_off(s, F.lit(2)), n=text.byte_len(s), lines=text.lines(F.lit("a\r\nb\n")), none=text.lines(F.lit("")), parts=text.split(F.lit("a.b."), "."), path=text.path_join(F.lit("/a/"), F.lit("b")), url=text.url_parse(F.lit("http://h/p?q=1#f")))
    assert got == {"rest": {"_0": "ab", "_1": "ñ"}, "ins": "axñb", "off": {"_0": "añ", "_1": "b"}, "n": 4, "lines": ["a", "b"], "none": [], "parts": ["a", "b", ""], "path": "/a/b", "url": {"scheme": "http", "host": "h", "path": "/p", "query": "q=1", "fragment": "f"}}


def test_times(spark):
    want = dt.datetime(2022, 1, 2, 3, 4, 5)
    for s in ("2022-01-02T03:04:05", "2022-01-02T03:04:05Z", "Sun, 2 Jan 2022 03:04:05 +0000", "2022-01-02 03:04:05", "02.01.2022 03:04:05", "01/02/2022 03:04:05", "1641092645"):
        assert _one(spark, t=M.parse(F.lit(s)).cast("timestamp_ntz"))["t"] == want, s
    assert _one(spark, t=M.parse(F.lit("never")))["t"] is None
    got = _one(spark, f=M.div_floor(M.from_seconds(F.lit(-1)), 2_000_000), d=M.duration_micros(M.duration(90, "m")), z=M.seconds(M.zero()))
    assert got == {"f": -1, "d": 90 * 60 * 10**6, "z": 0}


def test_options_and_types(spark):
    assert _one(spark, a=T.unwrap(F.lit(1)), b=T.is_error(T.error(F.lit("x"), "int")), c=T.checked(F.lit(255), "u8")) == {"a": 1, "b": True, "c": 255}
    for bad in (T.unwrap(T.none("int")), T.checked(F.lit(256), "u8"), T.unwrap_ok(T.error(F.lit("boom"), "int")), scalar.panic("p")):
        with pytest.raises(Exception, match=r"unwrap|range|boom|p"):
            spark.range(1).select(bad).collect()


def test_math(spark):
    got = _one(spark, d=scalar.div(F.lit(-7), F.lit(2)), e=F.round(scalar.erf(F.lit(0.5)), 5), x=scalar.TRY["/"](F.lit(1), F.lit(0)), r=scalar.range_exclusive(F.lit(2).cast("long"), F.lit(2).cast("long")))
    assert got == {"d": -3, "e": 0.5205, "x": None, "r": []}


def test_matrix_and_images(spark):
    m = C.matrix([2, 3], F.array(*[F.lit(i) for i in range(6)]))
    got = _one(spark, t=C.transpose(m), z=C.zeros([2, 2]), a=C.insert_axis(m, 0), x=C.at(m, 1, 2))
    assert got["t"] == {"shape": [3, 2], "data": [0, 3, 1, 4, 2, 5]} and got["z"]["data"] == [0.0] * 4 and got["a"]["shape"] == [1, 2, 3] and got["x"] == 5
    a = np.arange(4 * 6 * 3, dtype=np.uint8).reshape(4, 6, 3)
    df = spark.createDataFrame([(bytearray(a.tobytes()),)], "data binary").select(F.struct(F.lit(4).alias("height"), F.lit(6).alias("width"), F.lit(3).alias("channels"), "data").alias("i"))
    r = df.select(images.crop(F.col("i"), 1, 1, 2, 2).alias("c"), images.resize(F.col("i"), 3, 2).alias("s"), images.from_matrix(images.into_matrix(F.col("i"))).alias("b"), images.draw_box(F.col("i"), 0, 0, 6, 4, (9, 9, 9)).alias("d"), images.center_crop(F.col("i"), 2, 2).alias("m"), images.to_ppm(F.col("i")).alias("p")).first()
    px = lambda x: np.frombuffer(x["data"], np.uint8).reshape(x["height"], x["width"], 3)
    assert (px(r["c"]) == a[1:3, 1:3]).all() and (px(r["s"]) == a[::2, ::2]).all() and (px(r["b"]) == a).all() and (px(r["m"]) == a[1:3, 2:4]).all()
    assert (px(r["d"])[0] == 9).all() and (px(r["d"])[1, 1] == a[1, 1]).all() and bytes(r["p"]).startswith(b"P6 6 4 255\n")


def test_loops(t):
    assert run("var n = 0; val y = loop { n = n + 3; if n > 10 { break n; } }; y", t) is not None
    made = _values(run("var n = 0; val y = loop { n = n + 3; if n > 10 { break n * 2; } }; val a = [y]; from x in a select x", t))
    assert made == [24]
    assert run("var n = 1; while n < 100 { n = n * 7; }", t) is None
    fib = "def fib(k: i64): i64 { var a = 0; var b = 1; for i in 0..k { val c = a + b; a = b; b = c; } a }"
    assert _values(run(f"{fib} val v = [0, 1, 7, 20]; from x in v select fib(x)", t)) == [0, 1, 13, 6765]
    odd = "def odd_sum(v: Vec[i64]): i64 { var s = 0; for x in v { if x % 2 == 0 { continue; } if x > 9 { return s; } s = s + x; } s }"
    assert _values(run(f"{odd} val v = [[1, 2, 3], [5, 11, 7], []]; from x in v select odd_sum(x)", t)) == [4, 5, 0]
    steps = "def steps(x: i64): i32 { var n = x; var k = 0; while n != 1 { n = if n % 2 == 0 { n div2 } else { 3 * n + 1 }; k = k + 1; } k }".replace("n div2", "half(n)")
    assert _values(run(f"def half(x) = floor(x / 2); {steps} val v = [1, 6, 27]; from x in v select steps(x)", t)) == [0, 8, 111]
    with pytest.raises(Fault):
        run("def f(x) { var y = x; y } from x in kv select f(x.k)", t)
    for bad in ("def f(x): i64 { var y 2; y } 1", "def f(x): i64 { x x } 1", "loop { break"):
        with pytest.raises(SyntaxFault):
            parse(bad)


def test_order_with_a_function(t):
    assert _values(run("val a = [3,-5,1,4]; from x in a order x with fun(y) = y * y", t)) == [1, 3, 4, -5]
    assert _values(run("val a = [3,-5,1,4]; from x in a order x with fun(p, q) = q - p", t)) == [4, 3, 1, -5]
    assert _values(run("val b = [{k:2,v:9},{k:1,v:5},{k:3,v:7}]; from x in b order x.v with fun(p, q) = p - q desc", t)) == [(2, 9), (3, 7), (1, 5)]


def _field(number: int, value) -> bytes:
    """A protobuf field: an integer, or bytes with their length."""
    vint = lambda n: bytes([n & 127 | 128]) + vint(n >> 7) if n > 127 else bytes([n])
    if isinstance(value, int):
        return vint(number << 3) + vint(value)
    value = value.encode() if isinstance(value, str) else value
    return vint(number << 3 | 2) + vint(len(value)) + value


def _linear_model(weights) -> bytes:
    """An ONNX model that multiplies rows of features by a column of weights."""
    shape = lambda *d: b"".join(_field(1, _field(1, x) if isinstance(x, int) else _field(2, x)) for x in d)
    typed = lambda name, *d: _field(1, name) + _field(2, _field(1, _field(1, 1) + _field(2, shape(*d))))
    node = _field(1, "x") + _field(1, "w") + _field(2, "y") + _field(4, "MatMul")
    tensor = _field(1, len(weights)) + _field(1, 1) + _field(2, 1) + _field(8, "w") + _field(9, np.array(weights, "<f4").tobytes())
    graph = _field(1, node) + _field(2, "g") + _field(5, tensor) + _field(11, typed("x", "n", len(weights))) + _field(12, typed("y", "n", 1))
    return _field(1, 8) + _field(7, graph) + _field(8, _field(1, "") + _field(2, 13))


def test_delivery_price(spark, tmp_path):
    """A stream's elements beside two static tables, features by lambdas, and a model's prediction."""
    from millrace.functions.models import Model

    path = tmp_path / "price.onnx"
    path.write_bytes(_linear_model([2.0, 0.5, 10.0]))
    at = lambda d: dt.datetime(2023, 5, d)
    parcels = spark.createDataFrame([(7, [(1.5, "a"), (2.5, "b")], at(4), 1, 2), (8, [], at(5), 1, 2), (9, [(1.0, "c")], at(6), 2, 1)], "id long, items array<struct<mass:double,name:string>>, t timestamp, src_id long, dst_id long")
    places = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0)], "id long, lon double, lat double")
    apart = lambda a, b: F.sqrt((a["lon"] - b["lon"]) ** 2 + (a["lat"] - b["lat"]) ** 2)
    got = run(
        """from r: Parcel in parcels
        where fun(p) = p.items.len() > 0
        join here in places on here.id == r.src_id
        join there in places on there.id == r.dst_id
        val features = [r.items.sum_by(_.mass), f32(r.t.day()), distance(here, there)]
        val [price] = prices.predict(features)
        select {id: r.id, price: price}""",
        {"parcels": parcels, "places": places}, {"distance": apart}, objects={"prices": Model(str(path))},
    )
    assert sorted(map(tuple, got.collect())) == [(7, 2 * 4.0 + 2 + 50), (9, 2 * 1.0 + 3 + 50)]


def test_image_files_and_four_channels(spark, tmp_path):
    gray = np.arange(6, dtype=np.uint8).reshape(2, 3, 1)
    df = spark.createDataFrame([("a", 2, 3, 1, bytearray(gray.tobytes()))], "name string, height int, width int, channels int, data binary").select("name", F.struct("height", "width", "channels", "data").alias("image"))
    four = df.select(images.into_matrix_rgba(F.col("image")).alias("m")).first()["m"]
    assert four["shape"] == [2, 3, 4] and four["data"][:8] == [0, 0, 0, 255, 1, 1, 1, 255]
    made = images.save(df, f"file://{tmp_path}/out").collect()
    raw = (tmp_path / "out" / "a.ppm").read_bytes()
    assert [tuple(r) for r in made] == [(f"file://{tmp_path}/out/a.ppm", len(raw))] and raw == b"P5 3 2 255\n" + gray.tobytes()


def test_durations_and_types(spark, t):
    got = _one(spark, h=M.duration_in(M.duration(90, "m"), "hours"), w=M.duration_in(M.duration(15, "d"), "weeks"), n=M.duration_in(M.duration_of(F.lit(2_500), "nanoseconds"), "nanoseconds"), ms=M.duration_in(M.duration_of(F.lit(-3), "minutes"), "milliseconds"))
    assert got == {"h": 1, "w": 2, "n": 2000, "ms": -180_000}
    assert _values(run("from x in kv select typeof(x.k)", t)) == ["bigint"] * 3


def test_custom_monoid_by_parts(spark):
    """A fold that depends on the order, over parts of one hot key, nulls and a key without values."""
    from millrace.operators import aggregators as A
    from millrace.operators.stream import Stream

    at = lambda s: dt.datetime(2024, 2, 3, 4, s // 60, s % 60)
    rows = [("hot", at(s * 7 % 600), str(s * 7 % 600)) for s in range(600)] + [("hot", at(5), None), ("none", at(9), None)]
    df = spark.createDataFrame(rows, "k string, _t timestamp, v string").repartition(5)
    joined = A.incremental(lambda x: x, lambda a, b: F.concat(a, F.lit(","), b), F.length)
    got = {r["k"]: r["n"] for r in Stream(df).keyby(k=F.col("k")).aggregate(n=(joined, F.col("v"))).collect()}
    want = sorted({(s * 7 % 600, str(s * 7 % 600), s) for s in range(600)})
    assert got == {"hot": len(",".join(v for _, v, _ in want)), "none": None}
    last = A.incremental(lambda x: x, lambda a, b: b)
    got = {r["k"]: r["n"] for r in Stream(df).keyby(k=F.col("k")).aggregate(n=(last, F.col("v"))).collect()}
    assert got == {"hot": "599", "none": None}
