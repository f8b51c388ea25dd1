"""A deterministic load of any size, made on the executors from row numbers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def generate_observations(
    spark: SparkSession, queries: int, per_query: int, days: int, anchor: datetime, offers_per_run: int = 5
) -> DataFrame:
    """Price observations of many queries over the days before an anchor."""
    rows = spark.range(queries * per_query).select(
        (F.col("id") % queries).alias("query_id"), F.floor(F.col("id") / queries).alias("n")
    )
    runs = F.ceil(F.lit(per_query) / offers_per_run)
    run_no = F.floor(F.col("n") / offers_per_run)
    step = F.lit(days * 86_400) / runs
    at = F.timestamp_add("SECOND", -F.floor(run_no * step).cast("bigint"), F.lit(anchor).cast("timestamp_ntz"))
    price = 100_000 + (F.col("query_id") % 5000) * 100 + (F.col("n") * 37) % 997 * 10
    return rows.select(
        F.concat_ws("-", "query_id", "n").alias("obs_id"), at.alias("observed_at"), "query_id",
        (F.col("query_id") * runs + run_no).cast("bigint").alias("run_id"),
        F.concat_ws("-", "query_id", F.col("n") % 20).alias("itinerary_id"),
        F.concat_ws("-", "query_id", F.col("n") % 20).alias("offer_id"),
        F.md5(F.concat_ws("-", "query_id", "n")).alias("offer_fingerprint"),
        F.when(F.col("query_id") % 5 == 4, "JPY").otherwise("CNY").alias("currency"),
        price.cast("bigint").alias("total_price_minor"), (F.col("n") % 3 == 0).alias("is_direct"),
    )


def generate_subscriptions(spark: SparkSession, users: int, per_user: int, queries: int) -> DataFrame:
    """Subscriptions spread evenly over users and queries."""
    return spark.range(users * per_user).select(
        F.col("id").alias("subscription_id"), (F.col("id") % users).alias("user_id"),
        (F.col("id") % queries).alias("query_id"), (F.col("id") % 10 != 9).alias("enabled"),
        (F.lit(3600) * (1 + F.col("id") % 6)).cast("bigint").alias("poll_interval_seconds"),
    )


#: Users, subscriptions of each, queries, observations of each query. The published scale profiles.
PROFILES = {
    "smoke": (25, 4, 50, 24),
    "reference": (500, 12, 2_000, 240),
    "triple": (500, 12, 2_000, 720),
    "large": (5_000, 20, 20_000, 720),
}
AIRPORTS = ("PVG", "NRT", "ICN", "SIN", "HKG", "BKK", "KUL", "TPE")
ZONES = (
    "Asia/Shanghai", "Asia/Tokyo", "Asia/Seoul", "Asia/Singapore", "Asia/Hong_Kong", "Asia/Bangkok",
    "Asia/Kuala_Lumpur", "Asia/Taipei",
)
AIRLINES = ("MU", "CA", "JL", "NH")


def _one_of(names, number):
    return F.element_at(F.array(*[F.lit(n) for n in names]), (number % len(names)).cast("int") + 1)


class Load:
    """All fare tables of one scale profile, made from row numbers on the executors.

    The tables refer to each other, each row hangs on its number alone, and none passes through the driver,
    so a profile of any size can be written table by table. Each run has up to ``OFFERS`` offers, each with
    an itinerary of its own.
    """

    OFFERS = 5

    def __init__(self, spark: SparkSession, users: int, per_user: int, queries: int, per_query: int, anchor: datetime, days: int = 90):
        self.spark, self.users, self.per_user, self.n_queries = spark, users, per_user, queries
        self.per_query, self.anchor, self.days = per_query, anchor, days

    @classmethod
    def of(cls, spark: SparkSession, profile: str, anchor: datetime, days: int = 90) -> Load:
        return cls(spark, *PROFILES[profile], anchor, days)

    def _at(self, seconds_before):
        return F.timestamp_add("SECOND", -seconds_before.cast("bigint"), F.lit(self.anchor).cast("timestamp_ntz"))

    @property
    def runs_per_query(self) -> int:
        return -(-self.per_query // self.OFFERS)

    # -- searches and subscriptions -------------------------------------------

    def queries(self) -> DataFrame:
        q = F.col("id")
        return self.spark.range(self.n_queries).select(
            q.alias("query_id"), F.when(q % 4 == 3, "beta").otherwise("alpha").alias("provider"),
            F.md5(q.cast("string")).alias("query_hash"), F.when(q % 3 == 0, "round_trip").otherwise("one_way").alias("trip_type"),
            F.lit("economy").alias("cabin"), F.when(q % 5 == 4, "JPY").otherwise("CNY").alias("currency"),
            (q % 7 == 0).alias("direct_only"),
        )

    def legs(self) -> DataFrame:
        q, place = F.col("query_id"), F.col("position")
        both = F.when(F.col("trip_type") == "round_trip", F.expr("array(0L, 1L)")).otherwise(F.expr("array(0L)"))
        return self.queries().select(q, F.explode(both).alias("position")).select(
            q, place, _one_of(AIRPORTS, q + place * 3).alias("origin"), _one_of(AIRPORTS, q + (1 - place) * 3).alias("destination"),
            F.date_add(F.lit(self.anchor.date()), (1 + q % 60 + place * 7).cast("int")).alias("departure_date"),
        )

    def subscriptions(self) -> DataFrame:
        n = F.col("subscription_id")
        return generate_subscriptions(self.spark, self.users, self.per_user, self.n_queries).select(
            "*", F.concat(F.lit("route "), n).alias("name"), self._at((n * 37) % 2880 * 60 - 86_400).alias("next_due_at"),
            self._at(n + 1).alias("created_at"),
        )

    def filters(self) -> DataFrame:
        """Three of four subscriptions wish for nothing that needs itineraries."""
        n, none = F.col("subscription_id"), F.array().cast("array<string>")
        wishing, number = n % 4 == 3, F.lit(None).cast("bigint")
        return self.subscriptions().select(
            n, F.when(wishing & (n % 8 == 3), F.array(_one_of(AIRLINES, n))).otherwise(none).alias("airline_codes"),
            none.alias("departure_airports"), none.alias("arrival_airports"),
            F.when(n % 16 == 0, 400_000).cast("bigint").alias("max_price_minor"),
            F.when(wishing & (n % 8 == 7), 1).cast("bigint").alias("max_stops"),
            *[number.alias(c) for c in ("max_duration_minutes", "departure_minute_start", "departure_minute_end")],
        )

    # -- collection ---------------------------------------------------------------

    def runs(self) -> DataFrame:
        """Every 50th run has failed; it stores nothing."""
        n = self.runs_per_query
        number = F.col("id") % n
        at = self._at(F.floor(number * (self.days * 86_400 / n)))
        failed = F.col("id") % 50 == 49
        return self.spark.range(self.n_queries * n).select(
            F.col("id").alias("run_id"), F.floor(F.col("id") / n).alias("query_id"),
            F.when(failed, "failed").otherwise("succeeded").alias("status"), at.alias("finished_at"),
            F.timestamp_add("MINUTE", F.lit(-1), at).alias("started_at"), F.timestamp_add("MINUTE", F.lit(-2), at).alias("scheduled_at"),
            F.when(failed, "timeout").alias("error_code"), F.array().cast("array<bigint>").alias("on_demand_user_ids"),
        )

    def _offers(self) -> DataFrame:
        """One row per observation, with the run and the slot in it."""
        slots = F.least(F.lit(self.OFFERS), F.lit(self.per_query) - (F.col("run_id") % self.runs_per_query) * self.OFFERS)
        rows = self.runs().where("status = 'succeeded'").select(
            "run_id", "query_id", "finished_at", F.explode(F.sequence(F.lit(0), (slots - 1).cast("int"))).alias("slot")
        )
        number = (F.col("run_id") * 37 + F.col("slot") * 11).cast("bigint")
        return rows.select(
            "*", F.concat_ws("-", "run_id", "slot").alias("itinerary_id"), (number % 3).alias("stops"),
            (100_000 + (F.col("query_id") % 5000) * 100 + number % 997 * 10).cast("bigint").alias("price"),
            F.when(F.col("query_id") % 5 == 4, "JPY").otherwise("CNY").alias("money"),
        )

    def observations(self) -> DataFrame:
        return self._offers().select(
            F.col("itinerary_id").alias("obs_id"), F.col("finished_at").alias("observed_at"), "query_id", "run_id", "itinerary_id",
            F.col("itinerary_id").alias("offer_id"), F.md5("itinerary_id").alias("offer_fingerprint"), F.col("money").alias("currency"),
            F.col("price").alias("total_price_minor"), (F.col("stops") == 0).alias("is_direct"),
        )

    def offers(self) -> DataFrame:
        base = F.floor(F.col("price") * 4 / 5)
        return self._offers().select(
            F.col("itinerary_id").alias("offer_id"), "run_id", "query_id", "itinerary_id", F.lit("economy").alias("cabin"),
            F.col("money").alias("currency"), F.col("price").alias("total_price_minor"), base.alias("base_price_minor"),
            (F.col("price") - base).alias("tax_minor"), (1 + F.col("slot")).cast("bigint").alias("seats_remaining"),
        )

    def itineraries(self) -> DataFrame:
        legs = F.when(F.col("query_id") % 3 == 0, 2).otherwise(1).cast("bigint")
        return self._offers().select(
            "itinerary_id", "run_id", "query_id", F.col("itinerary_id").alias("provider_itinerary_id"),
            (legs * (F.col("stops") + 1) * 180).alias("total_duration_minutes"), F.col("stops").alias("stop_count"),
            (F.col("stops") == 0).alias("is_direct"), legs.alias("leg_count"),
        )

    def segments(self) -> DataFrame:
        """Flights of three hours, an hour apart; connections go through the next airports of the list."""
        flights = self.itineraries().withColumn("position", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("leg_count") * (F.col("stop_count") + 1) - 1)))
        hop, leg = F.col("position") % (F.col("stop_count") + 1), F.floor(F.col("position") / (F.col("stop_count") + 1))
        last = hop == F.col("stop_count")
        ends = self.legs().select("query_id", F.col("position").alias("leg_position"), "origin", "destination", "departure_date")
        # One row per leg of a query joins all its flights; a query has the same number of flights as any other.
        rows = flights.withColumns({"leg_position": leg, "hop": hop, "last": last}).join(ends, ["query_id", "leg_position"])
        via = lambda number: _one_of(AIRPORTS, F.col("query_id") + number + 1)
        begin = F.timestamp_add("HOUR", (6 + F.col("hop") * 4).cast("int"), F.col("departure_date").cast("timestamp_ntz"))
        begin = F.timestamp_add("MINUTE", (F.col("run_id") * 7 % 600).cast("int"), begin)
        return rows.select(
            "itinerary_id", "run_id", "query_id", "leg_position", "position",
            _one_of(AIRLINES, F.col("run_id") + F.col("position")).alias("marketing_airline"),
            _one_of(AIRLINES, F.col("run_id") + F.col("position")).alias("operating_airline"),
            F.concat(_one_of(AIRLINES, F.col("run_id") + F.col("position")), 100 + F.col("run_id") % 900).alias("flight_number"),
            F.when(F.col("hop") == 0, F.col("origin")).otherwise(via(F.col("hop") - 1)).alias("origin"),
            F.when(F.col("last"), F.col("destination")).otherwise(via(F.col("hop"))).alias("destination"),
            begin.alias("departure_local"), F.timestamp_add("HOUR", F.lit(3), begin).alias("arrival_local"),
            F.lit(180).cast("bigint").alias("duration_minutes"),
        )

    def calendar_observations(self, ahead: int = 30) -> DataFrame:
        """The newest succeeded run of every query has seen ``ahead`` departure days."""
        newest = self.runs().where("status = 'succeeded'").groupBy("query_id").agg(
            F.max_by(F.struct("run_id", "finished_at"), F.struct("finished_at", "run_id")).alias("r")
        )
        day = F.col("day")
        price = (90_000 + (F.col("query_id") % 5000) * 100 + day * 1_300 % 20_000).cast("bigint")
        return newest.withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(ahead)))).select(
            F.col("r.finished_at").alias("observed_at"), "query_id", F.col("r.run_id").alias("run_id"),
            F.date_add(F.lit(self.anchor.date()), day).alias("departure_date"),
            F.when(F.col("query_id") % 3 == 0, F.date_add(F.lit(self.anchor.date()), day + 7)).alias("return_date"),
            F.when(F.col("query_id") % 5 == 4, "JPY").otherwise("CNY").alias("currency"), price.alias("lowest_price_minor"),
            (price + F.floor(price / 10)).alias("total_price_minor"), F.concat_ws("-", "query_id", "day").alias("fingerprint"),
        )

    # -- alerts ---------------------------------------------------------------------

    def alert_rules(self) -> DataFrame:
        n = F.col("subscription_id")
        kinds = ("price_threshold", "new_low", "percentage_drop", "absolute_drop", "direct_available", "round_trip_range")
        return self.subscriptions().select(
            n.alias("rule_id"), "user_id", n, _one_of(kinds, n).alias("rule_type"), (n % 13 != 5).alias("enabled"),
            (100_000 + n % 100 * 3_000).cast("bigint").alias("threshold_price_minor"), F.lit(None).cast("string").alias("threshold_currency"),
            (500 + n % 10 * 100).cast("bigint").alias("threshold_percentage"), F.when(n % 2 == 0, 30).cast("bigint").alias("comparison_window_days"),
            (86_400 * (n % 3)).cast("bigint").alias("cooldown_seconds"), F.lit(100_000).cast("bigint").alias("config_min_price"),
            F.when(n % 5 > 0, 300_000).cast("bigint").alias("config_max_price"), F.lit("manual").alias("config_source"), "created_at",
        )
