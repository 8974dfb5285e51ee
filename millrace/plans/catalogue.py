"""The engine's operators as queries over the test tables, each with the SQL that it must agree with."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions import collections as C
from ..functions import scalar, text, time
from ..operators import aggregators as A
from ..operators import eventtime, joins, windows
from ..operators.stream import Stream, custom_sort
from ..sources import readers, sinks
from ..streaming import stateful
from . import comprehension, nexmark

QUERIES, ORACLES = {}, {}
#: The day of an event, in SQL.
_DAY = "epoch_us(ts) // 86400000000"


#: Schemas of tables by application and path.
_SCHEMAS: dict[tuple[str, str], StructType] = {}


class Tables:
    """Tables by name, as batches or as streams."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        """A table, whose schema an application reads from its files once."""
        path = f"{self.sf_dir}/{name}.parquet"
        known = (self.spark.sparkContext.applicationId, path)
        if known not in _SCHEMAS:
            _SCHEMAS[known] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[known]).parquet(path)

    def live(self, name: str) -> DataFrame:
        # A pattern, because a stream's plain path must be a folder.
        return self.spark.readStream.schema(self(name).schema).parquet(f"{self.sf_dir}/{name}.parque[t]")

    def settle(self, df: DataFrame, mode: str = "append") -> DataFrame:
        """Runs a stream over all that is there and gives what it emitted."""
        from ..session import SETTINGS, shared_folder

        provider = "spark.sql.streaming.stateStore.providerClass"
        before = self.spark.conf.get(provider)
        self.spark.conf.set(provider, SETTINGS[provider])
        path = shared_folder(self.spark, "stream")
        try:
            w = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/checkpoint")
            w.trigger(availableNow=True).start(f"{path}/out").awaitTermination()
        finally:
            self.spark.conf.set(provider, before)
        return self.spark.read.schema(df.schema).parquet(f"{path}/out")


def query(sql: str | None = None):
    """Registers f(t), t giving tables by name, under its name."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _events(t) -> Stream:
    return Stream(t("events").select("event_id", F.col("ts").alias("_t"), "user_id", "event_type", "value"))


def _cents(c) -> F.Column:
    """Money as whole cents: sums do not depend on their order."""
    return F.round(F.col(c) * 100).cast("long") if isinstance(c, str) else F.round(c * 100).cast("long")


# ---- benchmark queries ----
@query("SELECT l_orderkey AS auction, CAST(floor(l_extendedprice * 0.91) AS BIGINT) AS price, l_suppkey AS bidder, l_shipdate AS date_time FROM lineitem")
def q1_project(t):
    bid = t("lineitem").select(F.col("l_orderkey").alias("auction"), F.col("l_extendedprice").alias("price"), F.col("l_suppkey").alias("bidder"), F.col("l_shipdate").alias("date_time"))
    return nexmark.q1(bid)


_Q3 = "SELECT c_name AS name, n_name AS nation, o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name IN (SELECT n_name FROM nation WHERE n_nationkey < 3) AND o_orderpriority = '1-URGENT'"


@query(_Q3)
def q3_join_filter(t):
    """Filters after the joins, as a user writes them."""
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.where((F.col("n_nationkey") < 3) & (F.col("o_orderpriority") == "1-URGENT")).select(F.col("c_name").alias("name"), F.col("n_name").alias("nation"), F.col("o_orderkey").alias("id"))


@query(_Q3)
def q3_pushed(t):
    o = t("orders").where(F.col("o_orderpriority") == "1-URGENT").select("o_orderkey", "o_custkey")
    n = t("nation").where(F.col("n_nationkey") < 3).select("n_nationkey", "n_name")
    c = t("customer").select("c_custkey", "c_name", "c_nationkey")
    return o.join(joins.index_join(c, n, F.col("c_nationkey") == F.col("n_nationkey")), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("name"), F.col("n_name").alias("nation"), F.col("o_orderkey").alias("id"))


@query("SELECT a.event_id AS id, p.event_id AS person FROM events a JOIN events p ON a.user_id = p.user_id AND epoch_us(a.ts) // 86400000000 = epoch_us(p.ts) // 86400000000 WHERE a.event_type = 'purchase' AND p.event_type = 'click' AND a.value > 10")
def q3_windowed(t):
    e = _events(t)
    a, p = e.filter(F.col("event_type") == "purchase"), e.filter(F.col("event_type") == "click")
    out = a.keyby(user_id=F.col("user_id")).window_join(p.keyby(user_id=F.col("user_id")), "1 day")
    return out.filter(F.col("l_value") > 10).df.select(F.col("l_event_id").alias("id"), F.col("r_event_id").alias("person"))


@query("WITH w AS (SELECT unnest(string_split(text, ' ')) AS word FROM documents) SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY word")
def word_count(t):
    words = t("documents").select(F.explode(F.split("text", " ")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents), tf AS (SELECT doc_id, word, count(*) AS tf FROM w WHERE word <> '' GROUP BY ALL),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY word), n AS (SELECT count(*) AS n FROM documents)
SELECT doc_id, word, round(tf * (ln(n / df) + 1), 6) AS tf_idf FROM tf JOIN df USING (word), n""")
def tf_idf(t):
    """A document's id is its key, so documents with a word are counted by their distinct words: counts combine before the
    shuffle, and their result, a row a word, is hashed where the documents' terms meet it: neither side is sorted."""
    docs = t("documents").select("doc_id", F.split("text", " ").alias("words"))
    tf = docs.select("doc_id", F.explode("words").alias("word")).where("word <> ''").groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("tf"))
    df = docs.select(F.explode(F.array_distinct("words")).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    n = t("documents").agg(F.count(F.lit(1)).alias("n"))
    scored = tf.join(df.hint("shuffle_hash"), "word").crossJoin(F.broadcast(n))  # one row
    return scored.select("doc_id", "word", F.round(F.col("tf") * (F.log(F.col("n") / F.col("df")) + 1), 6).alias("tf_idf"))


# ---- projection, filter, flattening ----
@query("SELECT o_orderkey AS id, CAST(round(o_totalprice * 100) AS BIGINT) * 2 AS twice FROM orders")
def map_orders(t):
    return Stream(t("orders"), "o_orderdate").map(id=F.col("o_orderkey"), twice=_cents("o_totalprice") * 2).df.select("id", "twice")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND NOT o_totalprice < 1000")
def filter_orders(t):
    return Stream(t("orders")).filter((F.col("o_orderstatus") != "F") & ~(F.col("o_totalprice") < 1000)).df.select("o_orderkey")


@query("SELECT o_orderkey AS id, o_custkey AS customer FROM orders WHERE o_totalprice > 100000")
def filter_map(t):
    return Stream(t("orders"), "o_orderdate").filter_map(F.col("o_totalprice") > 100000, id=F.col("o_orderkey"), customer=F.col("o_custkey")).df.select("id", "customer")


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_custkey + 1 AS next FROM orders")
def record_concat(t):
    both = F.struct("o_orderkey", "o_custkey", "o_totalprice", (F.col("o_custkey") + 1).alias("next"))
    return t("orders").select(both.alias("r")).select("r.*")


@query("SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents")
def flat_map_words(t):
    return Stream(t("documents")).flat_map("word", text.split(F.col("text"), " "), doc_id=F.col("doc_id")).df.select("doc_id", "word")


@query("SELECT * FROM (SELECT unnest(regexp_split_to_array(text, '\r?\n')) AS line, doc_id FROM documents)")
def flatten_lines(t):
    return Stream(t("documents").select("doc_id", F.split("text", "\r?\n", -1).alias("line"))).flatten("line").df


@query("SELECT user_id AS k, count(*) AS n FROM events GROUP BY user_id")
def keyby_count(t):
    return _events(t).keyby(k=F.col("user_id")).aggregate(n=(A.count, F.lit(1)))


@query("SELECT event_type AS k, count(*) AS n FROM events GROUP BY event_type")
def rekey(t):
    return _events(t).keyby(k=F.col("user_id")).keyby(k=F.col("event_type")).aggregate(n=(A.count, F.lit(1)))


@query("SELECT event_id, user_id FROM events")
def unkey(t):
    return _events(t).keyby(k=F.col("user_id")).unkey().df.select("event_id", "user_id")


@query("SELECT event_id, 'a' AS part FROM events UNION ALL SELECT event_id, 'b' FROM events")
def fork_union(t):
    a, b = _events(t).fork()
    return a.map(event_id=F.col("event_id"), part=F.lit("a")).merge(b.map(event_id=F.col("event_id"), part=F.lit("b"))).df.select("event_id", "part")


@query("SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier")
def merge(t):
    return Stream(t("customer").select(F.col("c_name").alias("name"))).merge(Stream(t("supplier").select(F.col("s_name").alias("name")))).df


@query("SELECT event_id, CASE WHEN value > 50 THEN 'high' ELSE 'rest' END AS side FROM events")
def split_two(t):
    high, rest = _events(t).split(F.col("value") > 50)
    return high.map(event_id=F.col("event_id"), side=F.lit("high")).merge(rest.map(event_id=F.col("event_id"), side=F.lit("rest"))).df.select("event_id", "side")


@query("SELECT CAST(doc_id AS VARCHAR) || ':' || lang AS label, lang IN ('en', 'de') AS west, doc_id % 2 <> 0 AND lang <> 'fr' AS odd FROM documents")
def predicates(t):
    d = t("documents")
    return d.select(text.concat(F.col("doc_id"), ":", F.col("lang")).alias("label"), F.col("lang").isin("en", "de").alias("west"), ((F.col("doc_id") % 2 != 0) & (F.col("lang") != "fr")).alias("odd"))


# ---- joins ----
@query("SELECT a.event_id AS click, b.event_id AS purchase, epoch_us(a.ts) // 86400000000 AS day FROM events a JOIN events b ON a.user_id = b.user_id AND epoch_us(a.ts) // 86400000000 = epoch_us(b.ts) // 86400000000 WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def window_join(t):
    e = _events(t)
    a, b = e.filter(F.col("event_type") == "click"), e.filter(F.col("event_type") == "purchase")
    out = joins.window_join(a.df, b.df, ["user_id"], ["user_id"], "1 day")
    return out.select(F.col("l_event_id").alias("click"), F.col("r_event_id").alias("purchase"), eventtime.bucket(F.col("start").cast("timestamp"), 86_400_000_000).alias("day"))


@query("""WITH x AS (SELECT *, epoch_us(ts) // 86400000000 AS day FROM events), a AS (SELECT user_id, day, first(event_id ORDER BY ts, event_id) AS click FROM x WHERE event_type = 'click' GROUP BY ALL),
b AS (SELECT user_id, day, first(event_id ORDER BY ts, event_id) AS purchase FROM x WHERE event_type = 'purchase' GROUP BY ALL) SELECT click, purchase FROM a JOIN b USING (user_id, day)""")
def window_join_distinct(t):
    e = _events(t)
    a, b = e.filter(F.col("event_type") == "click"), e.filter(F.col("event_type") == "purchase")
    out = joins.window_join_distinct(a.df, b.df, ["user_id"], ["user_id"], "1 day", tiebreak=(["event_id"], ["event_id"]))
    return out.select(F.col("l_event_id").alias("click"), F.col("r_event_id").alias("purchase"))


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def index_join(t):
    return Stream(t("supplier")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).df.select("s_suppkey", "n_name")


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def theta_join(t):
    a, b = t("nation").alias("a"), t("nation").alias("b")
    out = joins.theta_join(a, b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey")))
    return out.select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"))


@query("SELECT r_name, n_name FROM region, nation")
def cross_from(t):
    return joins.cross(t("region").select("r_name"), t("nation").select("n_name"))


@query("SELECT n_name, unnest(string_split(n_name, 'A')) AS part FROM nation")
def lateral_from(t):
    return joins.lateral(t("nation").select("n_name"), "part", lambda d: F.split("n_name", "A"))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def equi_join(t):
    return joins.equi_join(t("orders"), t("customer"), ["o_custkey"], ["c_custkey"]).select("o_orderkey", "c_name")


# ---- aggregation ----
@query("SELECT count(*) AS n, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cents, min(value) AS lo, max(value) AS hi FROM events")
def agg_total(t):
    return _events(t).aggregate(n=(A.count, F.lit(1)), cents=(A.total, _cents("value")), lo=(A.minimum, F.col("value")), hi=(A.maximum, F.col("value")))


@query("SELECT user_id, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cents, round(avg(CAST(round(value * 100) AS BIGINT)), 6) AS mean FROM events GROUP BY user_id")
def agg_group(t):
    out = _events(t).keyby(user_id=F.col("user_id")).aggregate(n=(A.count, F.lit(1)), cents=(A.total, _cents("value")), mean=(A.average, _cents("value")))
    return out.withColumn("mean", F.round("mean", 6))


@query("SELECT user_id, round(sum(CAST(round(value * 100) AS BIGINT)) / count(*), 6) AS mean FROM events GROUP BY user_id")
def agg_incremental(t):
    """A custom monoid."""
    mean = A.incremental(lambda x: F.struct(x.alias("s"), F.lit(1).cast("long").alias("n")), lambda a, b: F.struct((a["s"] + b["s"]).alias("s"), (a["n"] + b["n"]).alias("n")), lambda a: F.round(a["s"] / a["n"], 6))
    return _events(t).keyby(user_id=F.col("user_id")).aggregate(mean=(mean, _cents("value")))


@query(f"SELECT user_id, make_timestamp({_DAY} * 86400000000) AS start, string_agg(event_id, '-' ORDER BY ts, event_id) AS ids FROM events GROUP BY user_id, {_DAY}")
def window_custom_monoid(t):
    """A monoid that does not commute: ids in event-time order, folded part by part."""
    joined = A.incremental(lambda x: x, lambda a, b: F.concat(a, F.lit("-"), b))
    e = Stream(t("events").select("event_id", F.col("ts").alias("_t"), "user_id")).keyby(user_id=F.col("user_id"))
    return _naive(e.window(windows.Tumbling("1 day"), ids=(joined, F.col("event_id").cast("string"))).df.drop("end"))


@query("SELECT event_type, string_agg(event_id, '-' ORDER BY ts, event_id) AS ids, max(value) AS hi FROM events GROUP BY event_type")
def agg_hot_keys(t):
    """Few keys with very many values each: no task holds a key's values, only a state for each minute."""
    joined = A.incremental(lambda x: F.struct(x["id"].alias("ids"), x["v"].alias("hi")), lambda a, b: F.struct(F.concat(a["ids"], F.lit("-"), b["ids"]).alias("ids"), F.greatest(a["hi"], b["hi"]).alias("hi")))
    e = _events(t).keyby(event_type=F.col("event_type"))
    out = e.aggregate(x=(joined, F.struct(F.col("event_id").cast("string").alias("id"), F.col("value").alias("v"))))
    return out.select("event_type", "x.ids", "x.hi")


@query("SELECT user_id, median(value) AS median FROM events GROUP BY user_id")
def agg_holistic_median(t):
    return _events(t).keyby(user_id=F.col("user_id")).aggregate(median=(A.median, F.col("value")))


@query("SELECT user_id, first(value ORDER BY ts, value) AS first, last(value ORDER BY ts, value) AS last FROM events GROUP BY user_id")
def agg_holistic(t):
    s = _events(t).keyby(user_id=F.col("user_id"))
    return s.aggregate(first=(A.holistic(lambda v: F.element_at(v, 1)), F.col("value")), last=(A.holistic(lambda v: F.element_at(v, -1)), F.col("value")))


@query("SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS ids FROM events GROUP BY user_id")
def group_collect(t):
    out = _events(t).keyby(user_id=F.col("user_id")).group("ids", F.col("event_id"))
    return out.select("user_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def dedup(t):
    return _events(t).dedup(["user_id", "event_type"]).df.select("user_id", "event_type")


@query("SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY user_id")
def set_group(t):
    return t("events").groupBy("user_id").agg(F.size(F.collect_set("event_type")).cast("long").alias("n"))


# ---- rolling aggregates ----
@query("SELECT event_id, sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cents FROM events")
def scan_keyed(t):
    return _events(t).keyby(user_id=F.col("user_id")).scan(["event_id"], cents=(A.total, _cents("value"))).df.select("event_id", "cents")


@query("SELECT n_nationkey AS k, sum(n_regionkey) OVER (ORDER BY n_nationkey ROWS UNBOUNDED PRECEDING)::BIGINT AS total FROM nation")
def scan_total(t):
    """Without a key one task orders everything, as a running fold over a whole stream does."""
    return Stream(t("nation"), "n_nationkey").scan([], total=(A.total, F.col("n_regionkey"))).df.select(F.col("n_nationkey").alias("k"), "total")


@query("SELECT event_id, avg(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS mean FROM events")
def roll_average(t):
    return _events(t).keyby(event_type=F.col("event_type"), user_id=F.col("user_id")).scan(["event_id"], mean=(A.average, _cents("value"))).df.select("event_id", "mean")


# ---- windows ----


@query(f"SELECT user_id, make_timestamp({_DAY} * 86400000000) AS start, make_timestamp(({_DAY} + 1) * 86400000000) AS \"end\", count(*) AS n, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cents FROM events GROUP BY ALL")
def tumbling_incremental(t):
    return _naive(_events(t).keyby(user_id=F.col("user_id")).window(windows.Tumbling("1 day"), n=(A.count, F.lit(1)), cents=(A.total, _cents("value"))).df)


def _naive(df: DataFrame) -> DataFrame:
    """Times without zone, as the tables have them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end") if c in df.columns})


@query(f"SELECT user_id, make_timestamp({_DAY} * 86400000000) AS start, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS ids FROM events GROUP BY ALL")
def tumbling_holistic(t):
    ids = A.holistic(lambda v: F.array_join(F.transform(v, lambda x: x.cast("string")), ","))
    return _naive(_events(t).keyby(user_id=F.col("user_id")).window(windows.Tumbling("1 day"), ids=(ids, F.col("event_id"))).df.drop("end"))


@query(f"SELECT make_timestamp(({_DAY} + 1) * 86400000000) AS \"end\", median(value) AS median FROM events GROUP BY ALL")
def tumbling_unkeyed(t):
    return _naive(_events(t).window(windows.Tumbling("1 day"), median=(A.median, F.col("value"))).df.drop("start"))


@query(f"SELECT user_id, make_timestamp(w * 86400000000) AS start, count(*) AS n FROM (SELECT user_id, unnest([{_DAY} - 1, {_DAY}]) AS w FROM events) GROUP BY ALL")
def sliding(t):
    return _naive(_events(t).keyby(user_id=F.col("user_id")).window(windows.Sliding("2 days", "1 day"), n=(A.count, F.lit(1))).df.drop("end"))


@query("""WITH a AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM a)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM b GROUP BY user_id, s""")
def session(t):
    return _naive(_events(t).keyby(user_id=F.col("user_id")).window(windows.Session("6 hours"), n=(A.count, F.lit(1))).df)


_NUMBERED = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events"


@query(f"SELECT user_id, k // 10 AS \"window\", count(*) AS size, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cents FROM ({_NUMBERED}) GROUP BY ALL HAVING count(*) = 10")
def counting(t):
    return _events(t).keyby(user_id=F.col("user_id")).window(windows.Counting(10), ["event_id"], cents=(A.total, _cents("value"))).df


@query(f"SELECT user_id, w AS \"window\", count(*) AS size, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cents FROM (SELECT *, unnest(range(greatest(0, CAST(ceil((k - 9) / 4) AS BIGINT)), k // 4 + 1)) AS w FROM ({_NUMBERED})) GROUP BY ALL HAVING count(*) = 10")
def moving(t):
    return _events(t).keyby(user_id=F.col("user_id")).window(windows.Moving(10, 4), ["event_id"], cents=(A.total, _cents("value"))).df


@query("SELECT make_timestamp(((epoch_us(ts) - 21600000000) // 86400000000) * 86400000000 + 21600000000) AS start, count(*) AS n FROM events GROUP BY ALL")
def window_offset(t):
    return _naive(_events(t).window(windows.Tumbling("1 day", "6 hours"), n=(A.count, F.lit(1))).df.drop("end"))


# ---- event time ----
_SHUFFLED = "SELECT event_id, ts, row_number() OVER (ORDER BY (event_id * 7919) % 1009, event_id) AS arrival, user_id FROM events"


def _shuffled(t) -> DataFrame:
    """Events of a user arrive out of order."""
    return t("events").select("event_id", "ts", "user_id", ((F.col("event_id") * 7919) % 1009 * 10**9 + F.col("event_id")).alias("arrival"))


@query(f"SELECT event_id FROM (SELECT event_id, ts, max(ts) OVER (PARTITION BY user_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 2 DAY AS mark FROM ({_SHUFFLED})) WHERE mark IS NULL OR ts >= mark")
def late_filter(t):
    return eventtime.drop_late(_shuffled(t), "ts", "2 days", "arrival", ["user_id"]).select("event_id")


@query(f"SELECT make_timestamp({_DAY} * 86400000000) AS start, count(*) AS n FROM events GROUP BY {_DAY} HAVING make_timestamp(({_DAY} + 1) * 86400000000) < (SELECT max(ts) - INTERVAL 3 DAY FROM events)")
def closed_windows(t):
    e = _events(t)
    w = e.window(windows.Tumbling("1 day"), n=(A.count, F.lit(1))).df
    return _naive(eventtime.closed_only(w, e.df, "_t", "3 days").drop("end"))


# ---- the same on streams ----
def _live(t) -> DataFrame:
    e = t.live("events").select("event_id", F.col("ts").cast("timestamp").alias("_t"), "user_id", "event_type", "value")
    return e.withWatermark("_t", "3 days")


@query("SELECT event_id, sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cents FROM events")
def stream_scan(t):
    fold = lambda acc, r: (acc[0] + round(r["value"] * 100),)
    out = stateful.scan(_live(t), ["user_id"], ["_t", "event_id"], "s long", (0,), fold, "event_id long, cents long", lambda acc, r: (r["event_id"], acc[0]))
    return t.settle(out).select("event_id", "cents")


@query(f"SELECT user_id, k // 10 AS \"window\", sum(event_id)::BIGINT AS ids FROM ({_NUMBERED}) GROUP BY ALL HAVING count(*) = 10")
def stream_counting(t):
    return t.settle(stateful.counting(_live(t), ["user_id"], ["_t", "event_id"], "event_id", 10, "ids long", lambda v: (sum(v),)))


@query(f"SELECT user_id, w AS \"window\", sum(event_id)::BIGINT AS ids FROM (SELECT *, unnest(range(greatest(0, CAST(ceil((k - 9) / 4) AS BIGINT)), k // 4 + 1)) AS w FROM ({_NUMBERED})) GROUP BY ALL HAVING count(*) = 10")
def stream_moving(t):
    return t.settle(stateful.moving(_live(t), ["user_id"], ["_t", "event_id"], "event_id", 10, 4, "ids long", lambda v: (sum(v),)))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(t):
    return t.settle(Stream(_live(t)).dedup(["user_id", "event_type"]).df.select("user_id", "event_type"))


@query(f"SELECT user_id, make_timestamp({_DAY} * 86400000000) AS start, count(*) AS n FROM events GROUP BY user_id, {_DAY} HAVING make_timestamp(({_DAY} + 1) * 86400000000) <= (SELECT max(ts) - INTERVAL 3 DAY FROM events)")
def stream_tumbling(t):
    return _naive(t.settle(Stream(_live(t)).keyby(user_id=F.col("user_id")).window(windows.Tumbling("1 day"), n=(A.count, F.lit(1))).df).drop("end"))


@query("SELECT a.event_id AS click, b.event_id AS purchase FROM events a JOIN events b ON a.user_id = b.user_id AND epoch_us(a.ts) // 86400000000 = epoch_us(b.ts) // 86400000000 WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def stream_window_join(t):
    a, b = (_live(t).where(F.col("event_type") == k) for k in ("click", "purchase"))
    return t.settle(joins.window_join(a, b, ["user_id"], ["user_id"], "1 day").select(F.col("l_event_id").alias("click"), F.col("r_event_id").alias("purchase")))


@query("SELECT event_id, user_id, c_name FROM events JOIN customer ON user_id = c_custkey WHERE value > 50 UNION ALL SELECT event_id, user_id, c_name FROM events JOIN customer ON user_id = c_custkey WHERE value > 50")
def stream_static_join_merge(t):
    s = Stream(_live(t)).filter(F.col("value") > 50).join(t("customer"), F.col("user_id") == F.col("c_custkey"))
    return t.settle(s.merge(s).df.select("event_id", "user_id", "c_name"))


# ---- sources and sinks ----
def _round_trip(t, df: DataFrame, encoding, schema: str) -> DataFrame:
    from ..session import shared_folder

    path = shared_folder(t.spark, "files")
    sinks.run(sinks.sink(df, sinks.FileOut(path), encoding))
    return readers.source(t.spark, readers.File(path), encoding, schema)


@query("SELECT n_nationkey::BIGINT AS k, n_name AS name, n_regionkey * 1.5::DOUBLE AS x FROM nation")
def csv_round_trip(t):
    df = t("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), (F.col("n_regionkey") * F.lit(1.5)).alias("x"))
    return _round_trip(t, df, readers.Csv(";"), "k long, name string, x double")


@query("SELECT event_id, user_id, event_type, value FROM events")
def json_round_trip(t):
    return _round_trip(t, t("events").select("event_id", "user_id", "event_type", "value"), readers.Json(), "event_id long, user_id long, event_type string, value double")


@query("SELECT k, v FROM (VALUES (0, 10), (1, 30), (3, 40), (4, 25)) AS x(k, v)")
def bounded_source(t):
    """Rows in arrival order; the third is late by more than the slack."""
    at = lambda s: datetime.datetime(2022, 1, 1, 0, 0, s)
    rows = [(0, 10, at(10)), (1, 30, at(30)), (2, 5, at(5)), (3, 40, at(40)), (4, 25, at(25))]
    return readers.from_iter(t.spark, rows, "k int, v int, t timestamp", "t", "20 seconds").select("k", "v")


@query(f"WITH {nexmark.sql(100_000)} SELECT auction, CAST(floor(price * 0.91::DOUBLE) AS BIGINT) AS price, bidder, date_time FROM bid")
def auction_q1(t):
    return nexmark.q1(nexmark.generate(t.spark, 100_000)["bid"])


_AUCTION_Q3 = f"""WITH {nexmark.sql(100_000, 0, 3, 1)} SELECT name, city, state, auction.id AS id FROM auction JOIN person ON seller = person.id AND auction.date_time // 10000 = person.date_time // 10000
WHERE state IN ('OR', 'ID', 'CA') AND category = 10"""


@query(_AUCTION_Q3)
def auction_q3(t):
    g = nexmark.generate(t.spark, 100_000, 0, 3, 1)
    return nexmark.q3(g["auction"], g["person"])


@query(_AUCTION_Q3)
def auction_q3_opt(t):
    g = nexmark.generate(t.spark, 100_000, 0, 3, 1)
    return nexmark.q3_opt(g["auction"], g["person"])


# ---- order ----
@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100")
def order_head(t):
    return Stream(t("orders")).head(100, "o_totalprice", "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 100")
def order_tail(t):
    return Stream(t("orders")).tail(100, "o_totalprice", "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT n_nationkey, row_number() OVER (ORDER BY n_name DESC) AS place FROM nation")
def order_desc(t):
    ordered = Stream(t("nation")).order(F.desc("n_name"))
    return ordered.select("n_nationkey", F.row_number().over(Window.orderBy(F.desc("n_name"))).cast("long").alias("place"))


@query("SELECT doc_id, array_to_string(list_sort(string_split(text, ' '))[1:5], ' ') AS first FROM documents")
def vec_sort_truncate(t):
    return t("documents").select("doc_id", F.array_join(C.truncate(C.sort(F.split("text", " ")), 5), " ").alias("first"))


@query("SELECT doc_id, array_to_string(list_reverse_sort(string_split(text, ' ')), ' ') AS words FROM documents")
def sort_comparator(t):
    return t("documents").select("doc_id", F.array_join(custom_sort(F.split("text", " "), lambda a, b: F.when(a < b, 1).when(a > b, -1).otherwise(0)), " ").alias("words"))


# ---- scalar functions ----
@query("""SELECT o_orderkey AS k, o_orderkey // 7 AS d, -(o_orderkey // 7) AS nd, o_orderkey % 7 AS m, o_orderkey & 12 AS band, o_orderkey | 12 AS bor, xor(o_orderkey, 12) AS bxor, o_orderkey > 5 AND o_custkey < 9 AS b1,
(o_orderkey > 5) <> (o_custkey < 9) AS b2, CAST(o_orderkey * o_orderkey AS DOUBLE) AS sq FROM orders""")
def math_ints(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    b = scalar.BINARY
    return t("orders").select(k.alias("k"), b["div"](k, F.lit(7)).alias("d"), b["div"](-k, F.lit(7)).alias("nd"), b["%"](k, F.lit(7)).alias("m"), b["band"](k, F.lit(12)).cast("long").alias("band"), b["bor"](k, F.lit(12)).cast("long").alias("bor"), b["bxor"](k, F.lit(12)).cast("long").alias("bxor"), b["and"](k > 5, c < 9).alias("b1"), b["xor"](k > 5, c < 9).alias("b2"), b["**"](k, F.lit(2)).alias("sq"))


@query("SELECT event_id, " + ", ".join(f"round({f}(x / 1000), 9) AS {f}" for f in ("acos", "asin", "atan", "cos", "cosh", "exp", "sin", "sinh", "sqrt", "tan", "tanh")) + ", round(ln(x + 1), 9) AS log FROM (SELECT event_id, least(greatest(value, 0), 1000) AS x FROM events)")
def math_floats(t):
    """All values, those outside the functions' domain taken to its end."""
    x = F.least(F.greatest("value", F.lit(0.0)), F.lit(1000.0))
    v = x / 1000
    made = [F.round(scalar.MATH[f](v), 9).alias(f) for f in ("acos", "asin", "atan", "cos", "cosh", "exp", "sin", "sinh", "sqrt", "tan", "tanh")]
    return t("events").select("event_id", *made, F.round(scalar.MATH["log"](x + 1), 9).alias("log"))


@query("""SELECT c_custkey, len(c_name) AS n, strlen(c_name) AS bytes, c_name || '!' AS push, c_name[1:3] || c_name[5:] AS rest, c_name[4:4] AS gone, c_name[1:3] || 'x' || c_name[4:] AS ins, c_name[1:3] AS head, c_name[4:] AS tail, c_name = '' AS empty,
c_name || '#' || CAST(c_custkey AS VARCHAR) AS label FROM customer""")
def str_edit(t):
    s = F.col("c_name")
    r, o = text.remove(s, F.lit(3)), text.split_off(s, F.lit(3))
    return t("customer").select("c_custkey", text.length(s).cast("long").alias("n"), text.byte_len(s).cast("long").alias("bytes"), text.push_char(s, F.lit("!")).alias("push"), r["_0"].alias("rest"), r["_1"].alias("gone"), text.insert_char(s, F.lit(3), F.lit("x")).alias("ins"), o["_0"].alias("head"), o["_1"].alias("tail"), text.is_empty(s).alias("empty"), text.concat(s, "#", F.col("c_custkey")).alias("label"))


@query("SELECT doc_id, len(l) - CASE WHEN l[-1] = '' THEN 1 ELSE 0 END AS n, CASE WHEN text <> '' THEN l[1] END AS first FROM (SELECT doc_id, text, regexp_split_to_array(text, '\r?\n') AS l FROM documents)")
def str_lines(t):
    v = text.lines(F.col("text"))
    return t("documents").select("doc_id", F.size(v).cast("long").alias("n"), F.get(v, 0).alias("first"))


@query("""SELECT event_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) * 1000 AS ns, year(ts)::BIGINT AS y, strftime(ts, '%Y/%m/%d %H:%M') AS f, ts + INTERVAL 90 SECOND AS later, epoch_us(ts) // 3600000000 AS hours, strptime(strftime(ts, '%Y-%m-%d'), '%Y-%m-%d') AS day FROM events""")
def time_functions(t):
    x = F.col("ts").cast("timestamp")
    out = t("events").select("event_id", time.seconds(x).alias("s"), time.nanoseconds(x).alias("ns"), time.year(x).cast("long").alias("y"), time.into_string(x, "yyyy/MM/dd HH:mm").alias("f"), time.add(x, time.duration(90, "s")).alias("later"), time.div_floor(x, 3_600_000_000).alias("hours"), time.from_string(time.into_string(x, "yyyy-MM-dd"), "yyyy-MM-dd").alias("day"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("later", "day")})


@query("""SELECT doc_id, len(w) AS n, w[1] AS first, w[len(w)] AS last, array_to_string(list_append(w, 'z')[len(w):], ' ') AS pushed, array_to_string(w[1:len(w) - 1], ' ') AS popped, list_contains(w, 'the') AS the, len(list_distinct(w)) AS distinct_words FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)""")
def vec_functions(t):
    w = F.col("w")
    d = t("documents").select("doc_id", F.split("text", " ").alias("w"))
    pushed = C.push(w, F.lit("z"))
    return d.select("doc_id", C.length(w).cast("long").alias("n"), C.get(w, 0).alias("first"), F.element_at(w, -1).alias("last"), F.array_join(F.slice(pushed, F.size(w), 2), " ").alias("pushed"), F.array_join(C.pop(w)["_0"], " ").alias("popped"), C.set_contains(w, F.lit("the")).alias("the"), F.size(C.into_set(w)).cast("long").alias("distinct_words"))


@query("SELECT n_nationkey AS k, 'name' AS found, n_name AS v, 2 AS size, false AS gone, n_name || '2' AS v2 FROM nation")
def dict_functions(t):
    d = F.create_map(F.lit("name"), F.col("n_name"), F.lit("x"), F.lit("y"))
    more = C.dict_insert(d, F.lit("name"), F.concat("n_name", F.lit("2")))
    return t("nation").select(F.col("n_nationkey").alias("k"), F.when(C.dict_contains(d, F.lit("name")), "name").alias("found"), C.dict_get(d, F.lit("name")).alias("v"), F.size(more).alias("size"), C.dict_contains(C.dict_remove(d, F.lit("x")), F.lit("x")).alias("gone"), C.dict_get(more, F.lit("name")).alias("v2"))


@query("SELECT n_nationkey AS k, n_regionkey + 3 AS inserted, CASE WHEN n_regionkey = 1 THEN 2 ELSE 3 END AS removed, [0, 1, 2][n_regionkey + 1] AS got FROM nation")
def set_functions(t):
    s, r = F.array(F.lit(0), F.lit(1), F.lit(2)), F.col("n_regionkey").cast("int")
    wide = F.size(C.set_insert(C.set_insert(C.set_insert(s, F.lit(5)), F.lit(5)), F.lit(1))) - 4
    return t("nation").select(F.col("n_nationkey").alias("k"), (F.size(F.array(F.lit(1), F.lit(2), F.lit(3))) + F.col("n_regionkey") + wide).alias("inserted"), F.when(F.size(C.set_remove(s, r)) == 2, F.when(r == 1, 2).otherwise(3)).otherwise(3).alias("removed"), C.get(s, r).alias("got"))


@query("SELECT c_custkey AS k, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS positive, c_acctbal > 0 AS is_some, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, 0) AS value FROM customer")
def option_functions(t):
    from .. import types as T

    v = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    r = F.when(v.isNotNull(), T.ok(v)).otherwise(T.error(F.lit("none"), "double"))
    return t("customer").select(F.col("c_custkey").alias("k"), v.alias("positive"), T.is_ok(r).alias("is_some"), F.coalesce(T.map_ok(r, lambda x: x)["ok"], F.lit(0.0)).alias("value"))


@query("SELECT n_nationkey::BIGINT AS k, n_name AS name, '{\"k\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}' AS js, n_nationkey || ',' || n_name AS csv FROM nation")
def codec_functions(t):
    r = F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    d = t("nation").select(text.encode_json(r).alias("js"), text.encode_csv(r).alias("csv"))
    back = text.decode_json(F.col("js"), "k long, name string")
    return d.select(back["k"].alias("k"), text.decode_csv(F.col("csv"), "k long, name string")["name"].alias("name"), "js", "csv")


@query("SELECT n_nationkey AS k, n_nationkey || ',3,1,4,2,5' AS d, 3 AS rows, n_nationkey::BIGINT AS corner FROM nation")
def matrix_functions(t):
    m = C.matrix([2, 3], F.array(F.col("n_nationkey"), F.lit(1).cast("long"), F.lit(2).cast("long"), F.lit(3).cast("long"), F.lit(4).cast("long"), F.lit(5).cast("long")))
    x = C.transpose(m)
    same = C.remove_axis(C.insert_axis(x, 1), 1)
    return t("nation").select(F.col("n_nationkey").alias("k"), F.array_join(F.transform(C.into_vec(same), lambda x: x.cast("string")), ",").alias("d"), same["shape"][0].alias("rows"), C.at(m, 0, 0).alias("corner"))


@query("SELECT event_id AS k, CAST(floor(value) AS INTEGER) AS i, list_sum(range(0, event_id % 5))::BIGINT AS s, len(range(1, event_id % 5 + 1)) AS n FROM events")
def ranges(t):
    k = F.col("event_id")
    total = F.aggregate(scalar.range_exclusive(F.lit(0).cast("long"), k % 5), F.lit(0).cast("long"), lambda a, x: a + x)
    return t("events").select(k.alias("k"), F.floor("value").cast("int").alias("i"), F.when(k % 5 == 0, F.lit(None)).otherwise(total).alias("s"), F.size(scalar.range_inclusive(F.lit(1).cast("long"), k % 5)).cast("long").alias("n"))


# ---- comprehensions ----
def _comprehend(name: str, sql: str, source: str, *tables: str) -> None:
    def run(t):
        return comprehension.run(source, {n: t(n) for n in tables})

    run.__name__ = f"comprehension_{name}"
    query(sql)(run)


_comprehend("where_select", "SELECT o_orderkey AS id, o_totalprice * 2 AS twice FROM orders WHERE o_totalprice > 1000 AND o_custkey % 2 = 0", "from o in orders where o.o_totalprice > 1000.0 and o.o_custkey % 2 == 0 select {id: o.o_orderkey, twice: o.o_totalprice * 2}", "orders")
_comprehend("join", "SELECT c_name, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3", "from o in orders join c in customer on o.o_custkey == c.c_custkey where c.c_nationkey == 3 select {c.c_name, o.o_orderkey}", "orders", "customer")
_comprehend("cross", "SELECT r_name, n_name FROM region, nation WHERE r_regionkey = n_regionkey", "from r in region, n in nation where r.r_regionkey == n.n_regionkey yield {r.r_name, n.n_name}", "region", "nation")
_comprehend("group", "SELECT user_id, count(*) AS n, max(value) AS hi FROM events GROUP BY user_id", "from e in events group e.user_id { compute count as n compute max of e.value as hi } as g select g", "events")
_comprehend("words", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY word", 'from d in documents from w in d.text.split(" ") group w { compute count as n } as g select {word: g.w, n: g.n}', "documents")
_comprehend("window", f"SELECT user_id, make_timestamp(({_DAY} + 1) * 86400000000) AS \"end\", count(*) AS n FROM events GROUP BY user_id, {_DAY}", "from e in events group e.user_id { over tumbling(1d) on e.ts { compute count as n } } as g select {user_id: g.user_id, end: g.end, n: g.n}", "events")
_comprehend("order_roll", "SELECT sum(n_regionkey) OVER (ORDER BY n_nationkey ROWS UNBOUNDED PRECEDING)::BIGINT AS s FROM nation", "from n in nation order n.n_nationkey roll sum of n.n_regionkey as s", "nation")
_comprehend("union", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT n_regionkey FROM nation", "from n in nation union nation select {k: n.n_regionkey}", "nation")
_comprehend("with_if", "SELECT n_nationkey AS k, CASE WHEN n_nationkey * 2 > 10 THEN 'big' ELSE 'small' END AS size FROM nation", 'def double(x) = x * 2; from n in nation with y = double(n.n_nationkey) select {k: n.n_nationkey, size: if y > 10 { "big" } else { "small" }}', "nation")
_comprehend("match", "SELECT n_nationkey AS k, CASE WHEN n_regionkey IN (0, 1) THEN 'a' WHEN n_regionkey = 2 THEN 'b' ELSE 'c' END AS part FROM nation", 'from n in nation select {k: n.n_nationkey, part: match n.n_regionkey { 0 | 1 => "a", 2 => "b", _ => "c" }}', "nation")
_comprehend("join_window", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND epoch_us(a.ts) // 86400000000 = epoch_us(b.ts) // 86400000000 WHERE a.event_type = 'click' AND b.event_type = 'purchase'", 'from a in events join b in events on a.user_id == b.user_id window 1d on a.ts, b.ts where a.event_type == "click" and b.event_type == "purchase" select {a: a.event_id, b: b.event_id}', "events")
_comprehend("loops", "SELECT n_nationkey AS k, ((n_nationkey + 1) // 2) * ((n_nationkey + 1) // 2) AS odds FROM nation", "def odds(n: i64): i64 { var s = 0; for i in 1..=n { if i % 2 == 0 { continue; } s = s + i; } s } from n in nation select {k: n.n_nationkey, odds: odds(n.n_nationkey)}", "nation")
_comprehend("append", "SELECT o_orderkey AS id, o_orderstatus || '-' || o_orderpriority AS tag FROM orders", 'from o in orders select {id: o.o_orderkey, tag: o.o_orderstatus ++ "-" ++ o.o_orderpriority}', "orders")
_comprehend("order_comparator", "SELECT n_nationkey AS k, n_name AS name FROM nation", "from n in nation order n.n_regionkey with fun(a, b) = b - a select {k: n.n_nationkey, name: n.n_name}", "nation")


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_totalprice > 200000")
def comprehension_into(t):
    from ..session import shared_folder

    path = shared_folder(t.spark, "into")
    keep = lambda df: sinks.run(sinks.sink(df, sinks.FileOut(path), readers.Json()))
    comprehension.run("from o in orders where o.o_totalprice > 200000.0 select {id: o.o_orderkey, price: o.o_totalprice} into keep", {"orders": t("orders")}, sinks={"keep": keep})
    return readers.source(t.spark, readers.File(path), readers.Json(), "id long, price double")


# ---- unions and time ----
@query("SELECT k, count(*) AS n FROM (SELECT user_id AS k FROM events WHERE event_type = 'click' UNION ALL SELECT user_id FROM events WHERE value > 50) GROUP BY k")
def keyed_merge(t):
    e = _events(t).keyby(k=F.col("user_id"))
    both = e.filter(F.col("event_type") == "click").merge(e.filter(F.col("value") > 50))
    return both.aggregate(n=(A.count, F.lit(1)))


@query("SELECT event_id FROM events WHERE event_type = 'click' UNION ALL SELECT event_id FROM events WHERE event_type = 'purchase'")
def dataflow_merge(t):
    """Two dataflows run as one, into one folder."""
    from ..session import shared_folder

    path = shared_folder(t.spark, "merged")
    flows = [sinks.sink(t("events").where(F.col("event_type") == k).select("event_id"), sinks.FileOut(path), readers.Json()) for k in ("click", "purchase")]
    sinks.run(sinks.merge(*flows))
    return readers.source(t.spark, readers.File(path), readers.Json(), "event_id long")


@query("SELECT event_id, true AS stamped FROM events")
def ingestion_time(t):
    return eventtime.ingestion(t("events")).select("event_id", (F.col("_t") > F.timestamp_seconds(F.lit(0))).alias("stamped"))


@query(f"""SELECT user_id, make_timestamp({_DAY} * 86400000000) AS start, count(*) AS n FROM (SELECT user_id, ts FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, ts FROM events WHERE event_type = 'purchase')
GROUP BY user_id, {_DAY} HAVING make_timestamp(({_DAY} + 1) * 86400000000) <= (SELECT min(m) FROM (SELECT max(ts) - INTERVAL 3 DAY AS m FROM events WHERE event_type IN ('click', 'purchase') GROUP BY event_type))""")
def stream_least_watermark(t):
    """Of two streams' watermarks the least counts."""
    a, b = (t.live("events").where(F.col("event_type") == k).select("event_id", F.col("ts").cast("timestamp").alias("_t"), "user_id").withWatermark("_t", "3 days") for k in ("click", "purchase"))
    return _naive(t.settle(Stream(a).merge(Stream(b)).keyby(user_id=F.col("user_id")).window(windows.Tumbling("1 day"), n=(A.count, F.lit(1))).df).drop("end"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n, event_id - coalesce(lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id), 0) AS gap FROM events")
def stream_keyed_state(t):
    """Of each user's events, by their type: how many there were, and how far the last one's number lies back."""

    def step(state, row):
        n, last = state[(row["event_type"],)]
        state[(row["event_type"],)] = (n + 1, row["event_id"])
        return [(row["event_id"], n + 1, row["event_id"] - last)]

    return t.settle(stateful.keyed(_live(t), ["user_id"], ["_t", "event_id"], "event_type string", "n long, last long", (0, 0), "event_id long, n long, gap long", step))


@query("SELECT user_id, epoch_us(ts) // 1000 + 3600000 AS at FROM events WHERE epoch_us(ts) // 1000 + 3600000 <= (SELECT max(epoch_us(ts)) // 1000 - 259200000 FROM events) GROUP BY ALL")
def stream_timers(t):
    """A timer an hour after each event, as far as the watermark comes."""
    return t.settle(stateful.after(_live(t), ["user_id"], "_t", 3_600_000, "at long", lambda key, at: (at,)))


@query("SELECT event_id, (epoch_us(ts) - 1640995200000000) // 60000000 AS minutes, (epoch_us(ts) - 1640995200000000) // 86400000000 AS days, (epoch_us(ts) - 1640995200000000) // 1000 AS ms, event_id * 60 AS d FROM events")
def duration_functions(t):
    since = F.col("ts").cast("timestamp") - F.timestamp_seconds(F.lit(1_640_995_200))
    return t("events").select("event_id", *[time.duration_in(since, u).alias(n) for u, n in (("minutes", "minutes"), ("days", "days"), ("milliseconds", "ms"))], time.duration_in(time.duration_of(F.col("event_id"), "minutes"), "seconds").alias("d"))
