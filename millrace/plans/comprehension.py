"""Query comprehensions as DataFrames: each clause becomes a declarative step and Catalyst plans the whole.

    run("from o in orders where o.o_totalprice > 100.0 group o.o_custkey compute sum of o.o_totalprice as total", tables)

A variable is a struct column of its table's columns, or the value itself where the table has the single column
`value`. Over a table, a further `from` is a cross join; over an expression of earlier variables it unnests. `select`
of a record gives its fields as columns. `group` and `over` give one struct, under the name after `as` or as columns;
`roll` needs an `order` before it, since tables have none.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import collections as C
from ..functions import scalar, text, time
from ..operators import windows
from ..operators.aggregators import NAMED, Aggregator
from . import imperative
from .imperative import Fault
from .syntax import parse


class Closure:
    def __init__(self, params: list[str], body: tuple, scope: dict, returns: str | None = None):
        self.params, self.body, self.scope, self.returns = params, body, scope, returns


class Planner:
    def __init__(self, tables: dict[str, DataFrame], functions: dict[str, Callable] | None = None, aggregators: dict[str, Aggregator] | None = None, sinks: dict[str, Callable] | None = None, objects: dict | None = None):
        self.tables, self.functions, self.objects = dict(tables), dict(functions or {}), dict(objects or {})
        self.aggregators, self.sinks = NAMED | (aggregators or {}), dict(sinks or {})
        self.globals: dict = {}

    # expressions
    def value(self, e: tuple, scope: dict):
        """A Column, a DataFrame, a Closure or an Aggregator."""
        kind = e[0]
        if kind == "lit":
            return F.lit(e[1])
        if kind == "dur":
            n = e[1].rstrip("abcdefghijklmnopqrstuvwxyz")
            return time.duration(int(n), e[1][len(n) :])
        if kind == "time":
            return F.lit(datetime.fromisoformat(e[1]).replace(tzinfo=timezone.utc))
        if kind == "name":
            for known in (scope, self.globals, self.tables, self.aggregators, self.objects):
                if e[1] in known:
                    v = known[e[1]]
                    return self.value(v, {}) if isinstance(v, tuple) else v
            raise Fault(f"unknown name {e[1]}")
        if kind == "fun":
            return Closure(e[1], e[2], dict(scope), e[3] if len(e) > 3 else None)
        if kind == "query":
            return self.query(e[1], scope)
        if kind == "binary":
            return self.binary(e[1], e[2], e[3], scope)
        if kind == "unary":
            return scalar.UNARY[e[1]](self.value(e[2], scope))
        if kind == "field":
            return self.value(e[1], scope)[e[2]]
        if kind == "pick":
            v = self.value(e[1], scope)
            return F.struct(*[v[n].alias(n) for n in e[2]])
        if kind == "index":
            return F.get(self.value(e[1], scope), self.value(e[2], scope))
        if kind == "text":
            return F.concat(*[self.value(x, scope).cast("string") for x in e[1]])
        if kind == "array":
            return F.array(*[self.value(x, scope) for x in e[1]])
        if kind == "tuple":
            return F.struct(*[self.value(x, scope).alias(f"_{i}") for i, x in enumerate(e[1])])
        if kind == "record":
            return F.struct(*[self.value(x, scope).alias(n) for n, x in e[1]])
        if kind == "if":
            return F.when(self.value(e[1], scope), self.value(e[2], scope)).otherwise(self.value(e[3], scope))
        if kind == "match":
            return self.match(self.value(e[1], scope), e[2], scope)
        if kind == "call":
            return self.call(e[1], e[2], scope)
        if kind == "method":
            return self.method(self.value(e[1], scope), e[2], [x for _, x in e[3]], scope)
        raise Fault(kind)

    def binary(self, op: str, a: tuple, b: tuple, scope: dict) -> Column:
        if op == "&":
            fields = [*self.fields(a, scope), *self.fields(b, scope)]
            return F.struct(*[c.alias(n) for n, c in dict(fields).items()])
        x, y = self.value(a, scope), self.value(b, scope)
        if op == "..":
            return scalar.range_exclusive(x, y)
        if op == "..=":
            return scalar.range_inclusive(x, y)
        return scalar.BINARY[op](x, y)

    def fields(self, e: tuple, scope: dict) -> list[tuple[str, Column]]:
        """Fields of a record expression, whose names must be written or known from a table."""
        if e[0] == "record":
            return [(n, self.value(x, scope)) for n, x in e[1]]
        if e[0] == "pick":
            v = self.value(e[1], scope)
            return [(n, v[n]) for n in e[2]]
        if e[0] == "binary" and e[1] == "&":
            return [*self.fields(e[2], scope), *self.fields(e[3], scope)]
        if e[0] == "name" and e[1] in scope.get("%fields", {}):
            return [(n, scope[e[1]][n]) for n in scope["%fields"][e[1]]]
        raise Fault("records of unknown fields cannot be joined")

    def match(self, v: Column, arms: list[tuple], scope: dict) -> Column:
        out, default = None, F.lit(None)
        for consts, tag, bound, body in arms:
            if tag:
                field = {"Ok": "ok", "Err": "error", "Some": None, "some": None}.get(tag, tag)
                inner = v if field is None else v[field]
                test, made = inner.isNotNull(), self.value(body, scope | {bound: inner})
            elif consts:
                test, made = None, self.value(body, scope)
                for c in consts:
                    one = v == self.value(c, scope)
                    test = one if test is None else test | one
            else:
                default = self.value(body, scope | ({bound: v} if bound != "_" else {}))
                break
            out = F.when(test, made) if out is None else out.when(test, made)
        return default if out is None else out.otherwise(default)

    def apply(self, f, *args):
        if isinstance(f, Closure) and imperative.imperative(f.body):
            return imperative.as_column(("fun", f.params, f.body, f.returns), self.globals)(*args)
        if isinstance(f, Closure):
            return self.value(f.body, f.scope | dict(zip(f.params, args, strict=True)))
        return f(*args)

    def call(self, name: str, args: list[tuple], scope: dict):
        if name in ("tumbling", "sliding", "session", "counting", "moving"):
            return self.assigner(name, args, scope)
        vals = [self.value(x, scope) for _, x in args]
        f = scope.get(name, self.globals.get(name))
        if isinstance(f, tuple):
            f = self.value(f, {})
        if f is not None:
            return self.apply(f, *vals)
        if name in self.functions:
            return self.functions[name](*vals)
        if name in scalar.MATH:
            return scalar.MATH[name](*vals)
        if name == "typeof":
            return F.typeof(*vals)
        if name in ("i8", "i16", "i32", "i64", "f32", "f64", "u8", "u16", "u32"):
            from ..types import checked

            return checked(vals[0], name)
        raise Fault(f"unknown function {name}")

    def method(self, v, name: str, args: list[tuple], scope: dict):
        vals = [self.value(x, scope) for x in args]
        if not isinstance(v, Column) and hasattr(v, name):
            return getattr(v, name)(*vals)
        known: dict[str, Callable] = {
            "len": lambda: F.size(v), "length": lambda: F.length(v), "map": lambda f: F.transform(v, lambda x: self.apply(f, x)),
            "filter": lambda f: F.filter(v, lambda x: self.apply(f, x)), "sort": lambda: F.array_sort(v), "push": lambda x: C.push(v, x),
            "split": lambda s: F.split(v, F.concat(F.lit("\\Q"), s, F.lit("\\E"))), "lines": lambda: text.lines(v), "get": lambda i: F.get(v, i),
            "insert": lambda i, x: C.insert(v, i, x), "contains": lambda x: F.array_contains(v, x), "year": lambda: F.year(v), "day": lambda: F.day(v),
            "seconds": lambda: F.unix_seconds(v), "is_some": lambda: v.isNotNull(), "is_none": lambda: v.isNull(), "is_empty": lambda: F.size(v) == 0,
            "upper": lambda: F.upper(v), "lower": lambda: F.lower(v), "fold": lambda z, f: F.aggregate(v, z, lambda a, x: self.apply(f, a, x)),
            "sum_by": lambda f: F.aggregate(v, F.lit(0.0), lambda a, x: a + self.apply(f, x)), "truncate": lambda n: F.slice(v, F.lit(1), n),
        }
        if name in known:
            return known[name](*vals)
        if name in self.functions:
            return self.functions[name](v, *vals)
        raise Fault(f"unknown method {name}")

    @staticmethod
    def _interval(e: tuple) -> str:
        if e[0] != "dur":
            raise Fault("a duration such as 5s is needed")
        n = e[1].rstrip("abcdefghijklmnopqrstuvwxyz")
        unit = {"ns": None, "us": "microseconds", "ms": "milliseconds", "s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks"}[e[1][len(n) :]]
        return f"{n} {unit}" if unit else f"{int(n) // 1000} microseconds"

    def assigner(self, name: str, args: list[tuple], scope: dict) -> windows.Assigner:
        vals = [x for _, x in args]
        if name in ("counting", "moving"):
            return (windows.Counting if name == "counting" else windows.Moving)(*[x[1] for x in vals])
        made = [self._interval(x) for x in vals]
        return {"tumbling": windows.Tumbling, "sliding": windows.Sliding, "session": windows.Session}[name](*made)

    # queries
    def bind(self, df: DataFrame, pattern: tuple, name: str, scope: dict) -> dict:
        if pattern[0] == "name":
            return scope | {pattern[1]: F.col(name)}
        for field, inner in pattern[1]:
            scope = scope | {inner[1]: F.get(F.col(name), F.lit(field)) if isinstance(field, int) else F.col(name)[field]} if inner[0] == "name" else self.bind(df, inner, f"{name}.{field}", scope)
        return scope

    def as_variable(self, df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col("value").alias(name)) if df.columns == ["value"] else df.select(F.struct("*").alias(name))

    def query(self, clauses: list[tuple], outer: dict):
        df, scope, names, order, n, rolled = None, dict(outer), [], [], 0, None
        scope.setdefault("%fields", {})
        for clause in clauses:
            kind = clause[0]
            n += 1
            if kind in ("from", "join"):
                v, name = self.value(clause[2], scope), clause[1][1] if clause[1][0] == "name" else f"_p{n}"
                if isinstance(v, DataFrame):
                    if v.columns != ["value"]:
                        scope["%fields"] = scope["%fields"] | {name: v.columns}
                    right = self.as_variable(v, name)
                    if kind == "join":
                        both = self.bind(df, clause[1], name, scope)
                        on = self.value(clause[3], both)
                        if len(clause) > 4:
                            on = on & self.same_window(clause, both)
                        df = df.join(right, on)
                    else:
                        df = right if df is None else df.crossJoin(right)
                elif kind == "join":
                    df = df.withColumn(name, F.explode(v)).where(self.value(clause[3], self.bind(df, clause[1], name, scope)))
                elif df is None:
                    spark = next(iter(self.tables.values())).sparkSession if self.tables else None
                    from pyspark.sql import SparkSession

                    one = (spark or SparkSession.getActiveSession()).range(1)
                    df = one.select(F.posexplode(v).alias(f"_at{n}", name))
                    order = order or [F.col(f"_at{n}")]
                else:
                    df = df.withColumn(name, F.explode(v))
                names.append(name)
                scope = self.bind(df, clause[1], name, scope)
            elif kind == "with":
                name = clause[1][1] if clause[1][0] == "name" else f"_p{n}"
                df = df.withColumn(name, self.value(clause[2], scope))
                names.append(name)
                scope = self.bind(df, clause[1], name, scope)
            elif kind == "where":
                v = self.value(clause[1], scope)
                df = df.where(self.apply(v, F.col(names[0])) if isinstance(v, Closure) else v)
            elif kind == "union":
                other = self.value(clause[1], scope)
                df = df.select(*names).unionByName(self.as_variable(other, names[0]))
            elif kind == "order":
                key = self.value(clause[1], scope)
                if clause[3] is not None:  # a function's key, or a comparator: the collection is then one sorted array
                    cmp = self.value(clause[3], scope)
                    if isinstance(cmp, Closure) and len(cmp.params) == 2:
                        df = self.compared(df, names, clause[1], cmp, clause[2])
                        order = [F.col("_place").asc()]
                        continue
                    key = self.apply(cmp, key)
                order = [key.desc() if clause[2] else key.asc()]
                df = df.orderBy(*order)
            elif kind == "compute":
                name = clause[3] or (clause[1][1] if clause[1][0] == "name" else "value")
                df = df.agg(self.aggregate(clause, scope, names, None).alias(name))
                return df
            elif kind == "roll":
                if not order:
                    raise Fault("roll needs an order")
                w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
                name = clause[3] or clause[1][1]
                df = df.withColumn(name, self.aggregate(clause, scope, names, None).over(w))
                rolled, names, scope = name, [name], scope | {name: F.col(name)}
            elif kind == "group":
                key = clause[1][2] if clause[1][0] == "field" else clause[1][1] if clause[1][0] == "name" else "key"
                df, names, scope = self.partition(df, scope, names, [self.value(clause[1], scope).alias(key)], clause[2], clause[3], outer)
            elif kind == "over":
                df, names, scope = self.over(df, scope, names, clause, outer)
            elif kind == "select":
                return self.select(df, clause[1], scope, clauses[clauses.index(clause) + 1 :])
            elif kind == "into":
                return self.into(self.result(df, names), clause[1])
            elif kind == "split":
                v = F.col(names[0])
                bad = v["error"].isNotNull()
                return df.where(~bad).select(v["ok"].alias("value")), df.where(bad).select(v["error"].alias("value"))
        return df.select(rolled) if rolled and names == [rolled] else self.result(df, names)

    def compared(self, df: DataFrame, names: list[str], key: tuple, cmp: Closure, desc: bool) -> DataFrame:
        """The rows in a comparator's order, which no range of keys follows: one array, sorted in one task, so that it must
        fit there."""
        row = lambda x: {n: x[n] for n in names}
        value = lambda x: self.value(key, cmp.scope | row(x))
        sign = lambda a, b: F.signum(self.apply(cmp, value(a), value(b)).cast("double")).cast("int") * (-1 if desc else 1)
        rows = df.agg(F.collect_list(F.struct(*names)).alias("_rows")).select(F.posexplode(F.array_sort("_rows", sign)).alias("_place", "_row"))
        return rows.select("_place", *[F.col("_row")[n].alias(n) for n in names]).orderBy("_place")

    def result(self, df: DataFrame, names: list[str]) -> DataFrame:
        if len(names) == 1:
            c = df.schema[names[0]].dataType
            return df.select(f"{names[0]}.*") if c.typeName() == "struct" else df.select(F.col(names[0]).alias("value"))
        return df.select(*names)

    def same_window(self, clause: tuple, scope: dict) -> Column:
        w, times = clause[4], clause[5] if len(clause) > 5 else None
        if times is None:
            raise Fault("a join's window needs `on` with both times")
        us = {"microseconds": 1, "milliseconds": 10**3, "seconds": 10**6, "minutes": 6 * 10**7, "hours": 36 * 10**8, "days": 864 * 10**8, "weeks": 6048 * 10**8}
        size, unit = self._interval(w if w[0] == "dur" else w[2][0][1]).split()
        a, b = (time.div_floor(self.value(t, scope).cast("timestamp"), int(size) * us[unit]) for t in times)
        return a == b

    def aggregate(self, clause: tuple, scope: dict, names: list[str], at: Column | None) -> Column:
        agg = self.value(clause[1], scope) if clause[1][0] != "name" else self.aggregators.get(clause[1][1]) or self.value(clause[1], scope)
        of = F.col(names[0]) if clause[2] is None else self.value(clause[2], scope)
        if isinstance(agg, Closure):
            return self.apply(agg, F.collect_list(of))
        return agg.over(of, at)

    def partition(self, df, scope, names, keys, inner, alias, outer, at=None):
        made, key_names = [], [self._name(k) for k in keys]
        for c in inner:
            if c[0] == "with":
                df = df.withColumn(c[1][1], self.value(c[2], scope))
                scope = scope | {c[1][1]: F.col(c[1][1])}
            elif c[0] == "where":
                df = df.where(self.value(c[1], scope))
            elif c[0] == "over":
                w, t = self.windowed(c, scope)
                return self.partition(df, scope, names, [*keys, w.column(t).alias("_w")], c[3], alias, outer, t)
            elif c[0] == "compute":
                made.append(self.aggregate(c, scope, names, at).alias(c[3] or c[1][1]))
            else:
                raise Fault(f"{c[0]} inside a group")
        if not made:
            value = F.col(names[0]) if len(names) == 1 else F.struct(*names)
            made = [F.collect_list(value).alias("values")]
        out = df.groupBy(*keys).agg(*made)
        if "_w" in key_names:
            rest = [c for c in out.columns if c != "_w"]
            out = out.select(*[c for c in rest if c in key_names], F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *[c for c in rest if c not in key_names])
        alias = alias or "_g"
        fields = scope["%fields"] | {alias: out.columns}
        return out.select(F.struct("*").alias(alias)), [alias], dict(outer) | {"%fields": fields, alias: F.col(alias)} | {c: F.col(f"{alias}.{c}") for c in out.columns if c not in outer}

    @staticmethod
    def _name(c: Column) -> str:
        return c._jc.toString().split(" AS ")[-1].strip("`")

    def windowed(self, clause, scope):
        w, opts = clause[1], clause[2]
        if w[0] == "dur":
            length, after = self._interval(w), self._interval(opts["after"]) if "after" in opts else None
            w = windows.Sliding(length, self._interval(opts["every"]), after) if "every" in opts else windows.Tumbling(length, after)
        else:
            w = self.value(w, scope)
        t = self.value(opts["on"], scope) if "on" in opts else next((scope[v]["_t"] for v, f in scope["%fields"].items() if "_t" in f), None)
        if t is None:
            raise Fault("a window needs `on` or a column _t")
        return w, t

    def over(self, df, scope, names, clause, outer):
        w, t = self.windowed(clause, scope)
        if not hasattr(w, "column"):
            if len(clause[3]) != 1:
                raise Fault("count windows take one compute")
            c = clause[3][0]
            agg, of = self.aggregators[c[1][1]], F.col(names[0]) if c[2] is None else self.value(c[2], scope)
            name = c[3] or c[1][1]
            out = windows.aggregate(df.select(t.alias("_t"), of.alias("_v")), w, {name: (agg, F.col("_v"))}, [], "_t", ["_v"])
            return out.select(F.struct("*").alias("_g")), ["_g"], dict(outer) | {"%fields": {"_g": out.columns}} | {c: F.col(f"_g.{c}") for c in out.columns}
        return self.partition(df, scope, names, [w.column(t).alias("_w")], clause[3], clause[4], outer, t)

    def select(self, df: DataFrame, e: tuple, scope: dict, rest: list[tuple]):
        if e[0] in ("record", "pick") or e[0] == "binary" and e[1] == "&":
            out = df.select(*[c.alias(n) for n, c in self.fields(e, scope)])
        else:
            v = self.value(e, scope)
            out = df.select(v.alias("value"))
            if out.schema["value"].dataType.typeName() == "struct":
                out = out.select("value.*")
        if rest and rest[0][0] == "into":
            return self.into(out, rest[0][1])
        if rest:
            return self.query([("from", ("name", "_s"), ("name", "%selected")), *rest], {"%selected": out})
        return out

    def into(self, df: DataFrame, e: tuple):
        name = e[1]
        if name not in self.sinks:
            raise Fault(f"unknown sink {name}")
        return self.sinks[name](df, *[x[1] for _, x in e[2]] if e[0] == "call" else [])


def run(query: str, tables: dict[str, DataFrame], functions: dict[str, Callable] | None = None, aggregators: dict[str, Aggregator] | None = None, sinks: dict[str, Callable] | None = None, objects: dict | None = None):
    """The DataFrame of a program's final expression (a Column for a scalar one, what the sink gives after `into`).

    `objects` are values whose methods the program may call, such as models. Definitions with statements are evaluated
    while planning; a final expression with statements gives its value."""
    planner = Planner(tables, functions, aggregators, sinks, objects)
    defs, body = parse(query)
    for name, e in defs:
        if e[0] != "fun" and imperative.imperative(e):
            e = ("lit", imperative.evaluate(e, imperative.Scope(planner.globals)))
        planner.globals[name] = e
    if imperative.imperative(body):
        return imperative.evaluate(body, imperative.Scope(planner.globals))
    return planner.value(body, {})
