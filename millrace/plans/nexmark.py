"""The auction benchmark: schemas, a deterministic generator and the queries q1, q3, q3-opt and their I/O-only forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import window_join
from ..sources.sinks import drain

PERSON = "id long, name string, email string, credit_card string, city string, state string, date_time long, extra string"
AUCTION = "id long, item_name string, description string, initial_bid long, reserve long, date_time long, expires long, seller long, category long, extra string"
BID = "auction long, bidder long, price long, channel string, url string, date_time long, extra string"
# Fixed values of the public benchmark: q3's states and category, the rate of q1 and the window of q3.
STATES, CATEGORY, RATE, WINDOW = ("OR", "ID", "CA"), 10, 0.91, "10 seconds"
# Fixed values of the public benchmark: the generator's cities and their states.
_CITIES = ("Phoenix", "Los Angeles", "San Francisco", "Boise", "Portland", "Bend", "Redmond", "Seattle", "Kent", "Cheyenne")
_STATES = ("AZ", "CA", "CA", "ID", "OR", "OR", "WA", "WA", "WA", "WY")
BASE_MS = 1_700_000_000_000


def _pick(values: Sequence[str], n):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


#: The salts of the generator's columns, and the prime and factor of its hash.
SALTS = {c: 1_000_003 * (i + 1) for i, c in enumerate("abcknprsvw")}
PRIME, FACTOR = (1 << 31) - 1, 48_271


def number(column, salt: str):
    """The square of a linear function of the row number, modulo a prime: as easily said in SQL."""
    x = (F.col(column) * FACTOR + SALTS[salt]) % PRIME
    return (x * x) % PRIME


def counts(events: int, bids: int = 46, auctions: int = 3, persons: int = 1) -> dict[str, int]:
    """Events of each kind, in proportion."""
    total = bids + auctions + persons
    return {"bid": events * bids // total, "auction": events * auctions // total, "person": events * persons // total}


def generate(spark: SparkSession, events: int, bids: int = 46, auctions: int = 3, persons: int = 1, per_second: int = 10_000) -> dict[str, DataFrame]:
    """Tables person, auction and bid, from hashes of the row number: the same on any number of executors."""
    n = counts(events, bids, auctions, persons)
    h = lambda salt: number("id", salt)
    people, items = F.lit(max(1, n["person"])), F.lit(max(1, n["auction"]))

    def at(kind: str):
        return (F.lit(BASE_MS) + F.floor(F.col("id") * 1000.0 * events / (max(1, n[kind]) * per_second))).cast("long")

    text = lambda salt: F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(salt))), 1, 16)
    person = spark.range(n["person"]).select("id", F.concat(F.lit("person "), text("n")).alias("name"), F.concat(text("m"), F.lit("@example.com")).alias("email"), F.lpad(h("c").cast("string"), 16, "4").alias("credit_card"), _pick(_CITIES, h("s")).alias("city"), _pick(_STATES, h("s")).alias("state"), at("person").alias("date_time"), text("x").alias("extra"))
    auction = spark.range(n["auction"]).select("id", text("i").alias("item_name"), text("d").alias("description"), (h("b") % 1000 + 1).alias("initial_bid"), (h("r") % 10000 + 1).alias("reserve"), at("auction").alias("date_time"), (at("auction") + 20_000).alias("expires"), (h("w") % people).alias("seller"), (h("k") % 5 + 10).alias("category"), text("x").alias("extra"))
    bid = spark.range(n["bid"]).select((h("a") % items).alias("auction"), (h("p") % people).alias("bidder"), (h("v") % 100_000 + 1).alias("price"), _pick(("web", "app", "phone"), h("c")).alias("channel"), F.concat(F.lit("https://example.com/"), text("u")).alias("url"), at("bid").alias("date_time"), text("x").alias("extra"))
    return {"person": person, "auction": auction, "bid": bid}


def sql(events: int, bids: int = 46, auctions: int = 3, persons: int = 1, per_second: int = 10_000) -> str:
    """The columns that q1 and q3 read of the tables that `generate` makes, as common table expressions."""
    n = counts(events, bids, auctions, persons)
    h = lambda salt: f"(((id * {FACTOR} + {SALTS[salt]}) % {PRIME}) * ((id * {FACTOR} + {SALTS[salt]}) % {PRIME}) % {PRIME})"
    at = lambda kind: f"{BASE_MS} + CAST(floor(id * 1000::DOUBLE * {events} / {max(1, n[kind]) * per_second}) AS BIGINT) AS date_time"
    pick = lambda values, salt: f"[{', '.join(repr(v) for v in values)}][{h(salt)} % {len(values)} + 1]"
    rows = lambda kind: f"FROM range({n[kind]}) AS r(id)"
    people, items = max(1, n["person"]), max(1, n["auction"])
    return f"""person AS (SELECT id, 'person ' || substr(md5(id || 'n'), 1, 16) AS name, {pick(_CITIES, "s")} AS city, {pick(_STATES, "s")} AS state, {at("person")} {rows("person")}),
  auction AS (SELECT id, {h("w")} % {people} AS seller, {h("k")} % 5 + 10 AS category, {at("auction")} {rows("auction")}),
  bid AS (SELECT {h("a")} % {items} AS auction, {h("p")} % {people} AS bidder, {h("v")} % 100000 + 1 AS price, {at("bid")} {rows("bid")})"""


def read(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Header-less CSV as `save` writes it."""
    return {n: spark.read.schema(s).csv(f"{folder}/{n}", header=False) for n, s in (("person", PERSON), ("auction", AUCTION), ("bid", BID))}


def save(tables: dict[str, DataFrame], folder: str) -> None:
    for n, df in tables.items():
        df.write.mode("overwrite").csv(f"{folder}/{n}", header=False)


def q1(bid: DataFrame, rate: float = RATE) -> DataFrame:
    return bid.select("auction", F.floor(F.col("price") * rate).alias("price"), "bidder", "date_time")


def q3(auction: DataFrame, person: DataFrame, window: str = WINDOW) -> DataFrame:
    """Sellers in three states with items of a category, joined in the same window; filters as a user writes them, after
    the join. Catalyst moves them and the pruning below it, which is all that q3-opt does by hand."""
    a = auction.withColumn("_t", F.timestamp_millis("date_time"))
    p = person.withColumn("_t", F.timestamp_millis("date_time"))
    joined = window_join(a, p, ["seller"], ["id"], window)
    return joined.where(F.col("r_state").isin(*STATES) & (F.col("l_category") == CATEGORY)).select(F.col("r_name").alias("name"), F.col("r_city").alias("city"), F.col("r_state").alias("state"), F.col("l_id").alias("id"))


def q3_opt(auction: DataFrame, person: DataFrame, window: str = WINDOW) -> DataFrame:
    """q3 with filters and pruning written below the join."""
    a = auction.where(F.col("category") == CATEGORY).select("id", "seller", F.timestamp_millis("date_time").alias("_t"))
    p = person.where(F.col("state").isin(*STATES)).select("id", "name", "city", "state", F.timestamp_millis("date_time").alias("_t"))
    joined = window_join(a, p, ["seller"], ["id"], window)
    return joined.select(F.col("r_name").alias("name"), F.col("r_city").alias("city"), F.col("r_state").alias("state"), F.col("l_id").alias("id"))


def q1_io(bid: DataFrame) -> None:
    drain(bid)


def q3_io(auction: DataFrame, person: DataFrame) -> None:
    drain(auction)
    drain(person)
