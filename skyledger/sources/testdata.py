"""Fare tables derived from the star-schema Parquet files.

The given files hold no fares, so every fare table is a view over them: orders
stand for collection runs, line items for itineraries with one offer each,
customers for subscriptions with their filter and alert rule. The number of
queries grows with the customers, and at most 16 subscriptions share a query.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.session import prepare_fares

# Fixed values of the views.
AIRPORTS = ("PVG", "NRT", "ICN", "SIN", "HKG", "BKK", "KUL", "TPE")
AIRPORT_ZONES = (
    "Asia/Shanghai", "Asia/Tokyo", "Asia/Seoul", "Asia/Singapore",
    "Asia/Hong_Kong", "Asia/Bangkok", "Asia/Kuala_Lumpur", "Asia/Taipei",
)
AIRPORT_HOURS = (8, 9, 9, 8, 8, 7, 8, 8)
AIRLINES = ("MU", "CA", "JL", "NH")
SHARED_BY = 16
AS_OF = datetime(1998, 6, 30, 12, 0, 0)

_RUN = (
    "o_orderkey AS run_id",
    f"o_custkey div {SHARED_BY} AS query_id",
    # Runs of other days have ended, but for those of a few customers that hang.
    """CASE WHEN o_orderstatus <> 'P' THEN 'succeeded'
            WHEN o_orderkey % 10 < 3 AND cast(o_orderdate AS date) NOT BETWEEN DATE'1998-06-27' AND DATE'1998-07-01'
              AND o_custkey % 64 <> 3 THEN 'failed'
            WHEN o_orderkey % 10 = 0 THEN 'pending'
            WHEN o_orderkey % 10 = 1 THEN 'leased'
            WHEN o_orderkey % 10 = 2 THEN 'running'
            WHEN o_orderkey % 10 = 3 THEN 'canceled'
            ELSE 'failed' END AS status""",
    "o_orderdate + make_dt_interval(0, 0, cast(o_orderkey % 1440 AS int), 0) AS clock",
    "o_orderstatus = 'F' AS evaluated",
    "o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice",
)


def _pick(names, index: str) -> str:
    listed = ", ".join(repr(name) for name in names)
    return f"element_at(array({listed}), cast(({index}) % {len(names)} AS int) + 1)"


class FareTables:
    """The fare tables over one folder of Parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare_fares(spark)
        self.folder = folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # -- collection ---------------------------------------------------------

    def _orders(self, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
        """Orders as runs. A run's time lies on its order's day, so time bounds
        become day bounds that reach the Parquet scan."""
        orders = self.raw("orders")
        if since is not None:
            day = since.replace(hour=0, minute=0, second=0, microsecond=0)
            orders = orders.where(F.col("o_orderdate") >= F.lit(day).cast("timestamp_ntz"))
        if until is not None:
            orders = orders.where(F.col("o_orderdate") <= F.lit(until).cast("timestamp_ntz"))
        return orders.selectExpr(*_RUN)

    def runs(self) -> DataFrame:
        return self._orders().selectExpr(
            "run_id", "query_id", "status",
            "1 + o_orderkey % 3 AS attempt", "3L AS max_attempts",
            """CASE WHEN status = 'pending' AND o_orderkey % 20 = 0 THEN clock + INTERVAL 30 MINUTES
                    ELSE clock - INTERVAL 10 MINUTES END AS scheduled_at""",
            """CASE WHEN status IN ('running','succeeded','failed','canceled')
                    THEN clock - make_dt_interval(0, 0, cast(o_orderkey % 7 AS int) + 1, 0) END AS started_at""",
            "CASE WHEN status IN ('succeeded','failed','canceled') THEN clock END AS finished_at",
            "CASE WHEN status IN ('leased','running') THEN clock + INTERVAL 15 MINUTES END AS lease_expires_at",
            "CASE WHEN status = 'failed' THEN concat('err_', substr(o_orderpriority, 1, 1)) END AS error_code",
            """CASE WHEN status = 'succeeded' AND o_orderpriority = '5-LOW' THEN 'success_with_warnings'
                    WHEN status = 'succeeded' THEN 'success' END AS upstream_status""",
            "o_orderkey % 2 = 0 AS partial_data",
            """CASE WHEN o_orderpriority = '1-URGENT' THEN array(o_custkey % 25)
                    ELSE cast(array() AS array<bigint>) END AS on_demand_user_ids""",
            "CASE WHEN evaluated THEN clock END AS alerts_evaluated_at",
        )

    def _lines(self, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
        runs = self._orders(since, until).where("status = 'succeeded'")
        return self.raw("lineitem").join(
            runs.select("run_id", "query_id", "clock"), F.col("l_orderkey") == F.col("run_id")
        ).selectExpr(
            "*",
            "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS itinerary_id",
            "cast(l_linenumber % 3 AS bigint) AS stops",
            "CASE WHEN query_id % 3 = 0 THEN 2L ELSE 1L END AS leg_count",
            "cast(round(l_extendedprice * 100) AS bigint) AS price",
            """CASE WHEN l_partkey % 50 = 49 THEN 'USD' WHEN query_id % 5 = 4 THEN 'JPY'
                    ELSE 'CNY' END AS money""",
        )

    def itineraries(self, since=None, until=None) -> DataFrame:
        return self._lines(since, until).selectExpr(
            "itinerary_id", "run_id", "query_id", "itinerary_id AS provider_itinerary_id",
            "120 + cast(l_quantity * 10 AS bigint) AS total_duration_minutes",
            "stops AS stop_count", "stops = 0 AS is_direct", "leg_count",
        )

    def offers(self, since=None, until=None) -> DataFrame:
        return self._lines(since, until).selectExpr(
            "itinerary_id AS offer_id", "run_id", "query_id", "itinerary_id", "'economy' AS cabin",
            "money AS currency", "price AS total_price_minor",
            "price * 4 div 5 AS base_price_minor", "price - price * 4 div 5 AS tax_minor",
            "cast(l_linenumber AS bigint) AS seats_remaining",
        )

    def observations(self, since=None, until=None) -> DataFrame:
        return self._lines(since, until).selectExpr(
            "itinerary_id AS obs_id", "clock AS observed_at", "query_id", "run_id", "itinerary_id",
            "itinerary_id AS offer_id", "md5(itinerary_id) AS offer_fingerprint",
            "money AS currency", "price AS total_price_minor", "stops = 0 AS is_direct",
        )

    def segments(self, since=None, until=None) -> DataFrame:
        flown = self._lines(since, until).selectExpr(
            "*", "explode(sequence(0L, leg_count * (stops + 1) - 1)) AS position"
        ).selectExpr(
            "*", "position div (stops + 1) AS leg_position", "position % (stops + 1) AS hop",
            "90 + l_partkey % 60 AS minutes",
        ).selectExpr(
            "*",
            """l_suppkey + (CASE WHEN leg_position = 0 THEN hop ELSE stops + 1 - hop END)
               * (1 + l_partkey % 3) AS from_node""",
            """l_suppkey + (CASE WHEN leg_position = 0 THEN hop + 1 ELSE stops - hop END)
               * (1 + l_partkey % 3) AS to_node""",
            """l_shipdate + make_dt_interval(cast(leg_position * 7 AS int), 0,
               cast((l_partkey * 7) % 1440 + hop * 240 AS int), 0) AS departure_utc""",
        ).selectExpr(
            "*", "departure_utc + make_dt_interval(0, 0, cast(minutes AS int), 0) AS arrival_utc"
        )
        hours = "array(" + ", ".join(map(str, AIRPORT_HOURS)) + ")"
        size = len(AIRPORTS)
        return flown.selectExpr(
            "itinerary_id", "run_id", "query_id", "leg_position", "position",
            f"{_pick(AIRLINES, 'l_suppkey + position')} AS marketing_airline",
            f"{_pick(AIRLINES, 'l_partkey + position')} AS operating_airline",
            f"concat({_pick(AIRLINES, 'l_suppkey + position')}, 100 + l_partkey % 900) AS flight_number",
            f"{_pick(AIRPORTS, 'from_node')} AS origin", f"{_pick(AIRPORTS, 'to_node')} AS destination",
            "CASE WHEN l_suppkey % 3 > 0 THEN concat('T', hop % 2 + 1) END AS origin_terminal",
            "concat('T', l_partkey % 2 + 1) AS destination_terminal",
            "departure_utc", "arrival_utc",
            f"""departure_utc + make_dt_interval(0, element_at({hours},
                cast(from_node % {size} AS int) + 1), 0, 0) AS departure_local""",
            f"""arrival_utc + make_dt_interval(0, element_at({hours},
                cast(to_node % {size} AS int) + 1), 0, 0) AS arrival_local""",
            f"{_pick(AIRPORT_ZONES, 'from_node')} AS departure_tz",
            f"{_pick(AIRPORT_ZONES, 'to_node')} AS arrival_tz",
            "minutes AS duration_minutes", "0L AS technical_stop_count",
        )

    def calendar_observations(self, since=None, until=None) -> DataFrame:
        return self._lines(since, until).selectExpr(
            "clock AS observed_at", "query_id", "run_id",
            "date_add(DATE'1998-07-01', cast(l_partkey % 60 AS int)) AS departure_date",
            """CASE WHEN leg_count = 2 THEN date_add(DATE'1998-07-08', cast(l_partkey % 60 AS int)) END
               AS return_date""",
            "CASE WHEN query_id % 5 = 4 THEN 'JPY' ELSE 'CNY' END AS currency",
            "price AS lowest_price_minor",
            "CASE WHEN l_linenumber <> 7 THEN price + price div 10 END AS total_price_minor",
            "itinerary_id AS fingerprint",
        )

    # -- searches and subscriptions ----------------------------------------

    def queries(self) -> DataFrame:
        return self.raw("customer").selectExpr(f"c_custkey div {SHARED_BY} AS query_id").distinct().selectExpr(
            "query_id", "CASE WHEN query_id % 4 = 3 THEN 'beta' ELSE 'alpha' END AS provider",
            "md5(cast(query_id AS string)) AS query_hash",
            "CASE WHEN query_id % 3 = 0 THEN 'round_trip' ELSE 'one_way' END AS trip_type",
            "'economy' AS cabin", "CASE WHEN query_id % 5 = 4 THEN 'JPY' ELSE 'CNY' END AS currency",
            "query_id % 2 = 0 AS direct_only",
        )

    def legs(self) -> DataFrame:
        return self.queries().selectExpr(
            "query_id", "trip_type",
            "explode(CASE WHEN trip_type = 'round_trip' THEN array(0L, 1L) ELSE array(0L) END) AS position",
        ).selectExpr(
            "query_id", "position",
            f"{_pick(AIRPORTS, 'query_id + position * 3')} AS origin",
            f"{_pick(AIRPORTS, 'query_id + (1 - position) * 3')} AS destination",
            "date_add(DATE'1998-07-01', cast(query_id % 60 + position * 7 AS int)) AS departure_date",
        )

    def subscriptions(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "c_custkey AS subscription_id", "cast(c_nationkey AS bigint) AS user_id",
            f"c_custkey div {SHARED_BY} AS query_id", "c_name AS name", "c_custkey % 10 <> 9 AS enabled",
            "3600 * (1 + c_custkey % 6) AS poll_interval_seconds",
            """CASE WHEN c_custkey % 17 > 0 THEN TIMESTAMP_NTZ'1998-06-30 12:00:00'
               + make_dt_interval(0, 0, cast((c_custkey * 37) % 2880 - 1440 AS int), 0) END AS next_due_at""",
            "TIMESTAMP_NTZ'1998-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(c_custkey AS int)) AS created_at",
        )

    def filters(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "c_custkey AS subscription_id",
            """CASE WHEN c_custkey % 4 = 0 THEN array('MU') WHEN c_custkey % 4 = 1 THEN array('CA', 'NH')
               ELSE cast(array() AS array<string>) END AS airline_codes""",
            """CASE WHEN c_custkey % 9 = 0 THEN array('PVG', 'NRT', 'ICN')
               ELSE cast(array() AS array<string>) END AS departure_airports""",
            """CASE WHEN c_custkey % 11 = 0 THEN array('SIN', 'HKG', 'BKK')
               ELSE cast(array() AS array<string>) END AS arrival_airports""",
            "CASE WHEN c_custkey % 7 = 0 THEN 4000000L END AS max_price_minor",
            "CASE WHEN c_custkey % 5 = 0 THEN 1L END AS max_stops",
            "CASE WHEN c_custkey % 6 = 0 THEN 400L END AS max_duration_minutes",
            "CASE WHEN c_custkey % 8 = 0 THEN 360L WHEN c_custkey % 16 = 5 THEN 300L END AS departure_minute_start",
            "CASE WHEN c_custkey % 8 = 0 THEN 1080L END AS departure_minute_end",
        )

    # -- alerts and deliveries ----------------------------------------------

    def alert_rules(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "c_custkey AS rule_id", "cast(c_nationkey AS bigint) AS user_id", "c_custkey AS subscription_id",
            """element_at(array('price_threshold','new_low','percentage_drop','absolute_drop',
               'direct_available','round_trip_range','data_stale'),
               cast((c_custkey div 3) % 7 AS int) + 1) AS rule_type""",
            "c_custkey % 13 <> 5 AS enabled",
            "CASE WHEN c_acctbal >= 0 THEN cast(round(c_acctbal * 100) AS bigint) * 4 END AS threshold_price_minor",
            "CASE WHEN c_custkey % 12 = 4 THEN 'usd' END AS threshold_currency",
            "500 + (c_custkey % 10) * 100 AS threshold_percentage",
            "CASE WHEN c_custkey % 2 = 0 THEN 365L END AS comparison_window_days",
            "86400 * (c_custkey % 3) AS cooldown_seconds",
            "CASE WHEN c_custkey % 4 > 0 THEN 1000000L ELSE -1L END AS config_min_price",
            "CASE WHEN c_custkey % 5 > 0 THEN 3000000L END AS config_max_price",
            "CASE WHEN c_custkey % 3 = 0 THEN 'subscription_target_price' ELSE 'manual' END AS config_source",
            "TIMESTAMP_NTZ'1998-01-02 00:00:00' + make_dt_interval(0, 0, 0, cast(c_custkey AS int)) AS created_at",
        )

    def channels(self) -> DataFrame:
        return self.raw("nation").selectExpr(
            "cast(n_nationkey AS bigint) AS user_id", "explode(array(0L, 1L, 2L)) AS slot"
        ).selectExpr(
            "user_id * 3 + slot AS channel_id", "user_id",
            "element_at(array('email', 'webhook', 'chat'), cast(slot AS int) + 1) AS kind",
            "(user_id + slot) % 4 > 0 AS enabled",
            "element_at(array('Asia/Shanghai', 'Asia/Tokyo', 'UTC'), cast(user_id % 3 AS int) + 1) AS timezone",
            "CASE WHEN slot > 0 THEN 1320L END AS quiet_start_minute",
            "CASE WHEN slot > 0 THEN 480L END AS quiet_end_minute",
            "CASE WHEN slot = 2 THEN array(0, 1, 2, 3, 4) END AS allowed_weekdays",
        )

    def rule_channels(self) -> DataFrame:
        return self.raw("customer").where("c_acctbal >= 4000").selectExpr(
            "c_custkey AS rule_id", "cast(c_nationkey * 3 + c_custkey % 3 AS bigint) AS channel_id"
        )

    def alert_events(self) -> DataFrame:
        return self._orders().where("status = 'failed'").selectExpr(
            "run_id AS event_id", "o_custkey AS rule_id", "o_custkey % 25 AS user_id", "run_id",
            "clock AS created_at",
        )

    def deliveries(self) -> DataFrame:
        return self._orders().selectExpr(
            "run_id AS delivery_id", "run_id AS event_id", "o_custkey % 75 AS channel_id",
            """CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'pending' WHEN '2' THEN 'failed'
               WHEN '3' THEN 'sending' WHEN '4' THEN 'succeeded' ELSE 'canceled' END AS status""",
            "o_orderkey % 6 AS attempt_count",
            "CASE WHEN o_orderkey % 4 > 0 THEN clock + INTERVAL 1 HOUR END AS next_attempt_at",
            "clock AS updated_at",
        )

    def export_jobs(self) -> DataFrame:
        return self._orders().selectExpr(
            "run_id AS job_id", "o_custkey % 25 AS user_id",
            """CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'pending' WHEN '2' THEN 'running'
               WHEN '3' THEN 'succeeded' WHEN '4' THEN 'expired' ELSE 'failed' END AS status""",
            "CASE WHEN o_orderkey % 3 > 0 THEN concat('export-', o_orderkey) END AS file_name",
            "CASE WHEN o_orderkey % 5 > 0 THEN cast(round(o_totalprice) AS bigint) END AS size_bytes",
            "clock AS created_at",
        )

    def comparison_items(self) -> DataFrame:
        """Saved views of up to 5 routes, in order, with the chosen trend days."""
        return self.raw("customer").selectExpr(
            "c_custkey div 5 AS view_id", "c_custkey % 5 AS position",
            "CASE WHEN c_custkey % 11 > 0 THEN c_custkey END AS subscription_id",
            "element_at(array(7L, 30L, 90L, 14L), cast((c_custkey div 5) % 4 AS int) + 1) AS trend_days",
            "2 + (c_custkey div 5) % 5 AS configured_route_count",
        )

    # -- payloads -----------------------------------------------------------

    def events(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "event_id", "ts AS observed_at", "user_id AS query_id", "event_type",
            "cast(round(value * 100) AS bigint) AS price_minor", "props",
        )
