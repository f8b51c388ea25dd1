"""Alert rules: prices of a run against thresholds and earlier prices."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions.hashing import compact_key
from skyledger.functions.money import drop_basis_points
from skyledger.functions.times import add_seconds
from skyledger.operators.filters import WISHES, distinct_branches, itinerary_match, with_branches, within
from skyledger.operators.history import RUN_KEYS
from skyledger.session import cut_lineage
from skyledger.skew import join_checked

# The rule types that are evaluated.
RULE_TYPES = (
    "price_threshold", "new_low", "percentage_drop", "absolute_drop", "direct_available", "round_trip_range",
)


def pending_runs(runs: DataFrame, batch: int | None = None) -> DataFrame:
    """Succeeded runs that no rule has seen yet; the oldest ones when a batch is asked."""
    pending = runs.where("status = 'succeeded' AND alerts_evaluated_at IS NULL")
    return pending if batch is None else pending.orderBy("finished_at", "run_id").limit(batch)


def rule_contexts(rules: DataFrame, context_rows: DataFrame) -> DataFrame:
    """Enabled rules of enabled subscriptions with the wishes they apply.

    A rule may name its own currency, and a direct rule always asks for direct.
    """
    own = context_rows.where("enabled").drop("user_id", "enabled", "branch_key", "created_at")
    joined = rules.where("enabled").join(own, "subscription_id")
    wished = joined.withColumn(
        "currency", F.upper(F.coalesce("threshold_currency", "currency"))
    ).withColumn("direct_only", F.col("direct_only") | (F.col("rule_type") == "direct_available"))
    return wished.withColumn("branch_key", compact_key(**{name: F.col(name) for name in WISHES}))


def rule_branches(rule_rows: DataFrame) -> DataFrame:
    """The distinct branches of the rules."""
    return distinct_branches(rule_rows)


def best_offers(
    observations: DataFrame, features: DataFrame, branch_rows: DataFrame, *, small: bool | None = None
) -> DataFrame:
    """Cheapest passing observation per (branch, run), ties by id.

    Branches without itinerary wishes are answered from two candidates per run:
    the cheapest offer and the cheapest direct offer.
    """
    offer = F.struct("total_price_minor", "obs_id", "is_direct")
    floor = observations.groupBy(*RUN_KEYS).agg(
        F.min(offer).alias("any_offer"), F.min(F.when(F.col("is_direct"), offer)).alias("direct_offer")
    )
    simple = branch_rows.where("NOT needs_scan").select(
        "branch_key", "query_id", "currency", "direct_only", "max_price_minor"
    )
    chosen = F.when(F.col("direct_only"), F.col("direct_offer")).otherwise(F.col("any_offer"))
    quick = (
        join_checked(floor, simple, ["query_id", "currency"], small=small)
        .withColumn("best", chosen)
        .withColumn("price", F.col("best.total_price_minor"))
        .where(F.col("best").isNotNull() & within("max_price_minor", "price"))
        .select("branch_key", "run_id", "observed_at", "best")
    )
    scanned = (
        with_branches(observations, features, branch_rows.where("needs_scan"), small=small)
        .where(itinerary_match() & within("max_price_minor", "total_price_minor"))
        .groupBy("branch_key", "run_id", "observed_at")
        .agg(F.min(offer).alias("best"))
    )
    return quick.unionByName(scanned).select(
        "branch_key", "run_id", "observed_at",
        F.col("best.total_price_minor").alias("price_minor"), F.col("best.is_direct").alias("is_direct"),
    )


def _running(order):
    """From the first row up to the current one and its equals."""
    return order.rangeBetween(Window.unboundedPreceding, Window.currentRow)


def _days_low(days: DataFrame, asked_days: DataFrame) -> DataFrame:
    """Lowest daily price over the whole days of each look-back that ends at one of ``asked_days``.

    A look-back of N days holds the N - 1 whole days before the day itself. The
    days are cut into blocks of that length: every look-back then is the end of
    one block and the start of the next, so two running minima answer all days.
    Days without prices get their answer through probe rows.
    """
    whole = F.col("window_days") - 1
    block = F.when(F.col("window_days").isNull(), F.lit(0)).otherwise(F.floor(F.col("place") / whole))
    usable, asked = (rows.where("window_days IS NULL OR window_days > 1") for rows in (days, asked_days))
    keys = ["pair", "window_days"]
    none = F.lit(None).cast("bigint")
    data = usable.select(*keys, F.col("number").alias("place"), "day_low", none.alias("ends"), none.alias("starts"))
    ends = asked.select(
        *keys, (F.col("number") - 1).alias("place"), none.alias("day_low"), F.col("number").alias("ends"),
        none.alias("starts"),
    )
    starts = asked.where("window_days IS NOT NULL").select(
        *keys, (F.col("number") - whole).alias("place"), none.alias("day_low"), none.alias("ends"),
        F.col("number").alias("starts"),
    )
    rows = data.unionByName(ends).unionByName(starts).withColumn("block", block)
    # Both minima run forward over a sort: an open-ended frame would restart per row.
    block_rows = Window.partitionBy(*keys, "block")
    up_to = F.min("day_low").over(_running(block_rows.orderBy("place")))
    onward = F.min("day_low").over(_running(block_rows.orderBy(F.desc("place"))))
    answered = rows.withColumn("low", F.when(F.col("ends").isNotNull(), up_to).otherwise(onward)).where(
        "ends IS NOT NULL OR starts IS NOT NULL"
    )
    return answered.groupBy(*keys, F.coalesce("ends", "starts").alias("number")).agg(F.min("low").alias("days_low"))


def previous_minimum(best: DataFrame, windows: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Lowest earlier price before every run of a branch, strictly before it.

    ``asked`` (``run_id``) bounds the answer to some runs: other runs then count with their prices, but
    only the days on which an asked run or its look-back begins are walked run by run.
    ``windows`` names the look-back in days per branch (null means no bound). A
    look-back is the same day up to the run, whole days, and a partial first day.
    Running minima are kept per branch and day and, for whole days, over one row
    per day: no branch passes through one task row by row, and no pairs are made.
    Rows travel with the number of their branch and look-back, which is a tenth of both keys.
    """
    keys = ["pair", "window_days"]
    # Numbers must not change between reads, so they are written.
    numbered = cut_lineage(windows.withColumn("pair", F.monotonically_increasing_id()))
    price = F.col("price_minor")
    number = F.datediff(F.to_date("observed_at"), F.lit("1970-01-01").cast("date")).cast("bigint")
    # Read five times below, so it is written once instead of being priced again.
    rows = best.join(numbered, "branch_key").drop("branch_key").withColumn("number", number)
    if asked is None:
        rows = rows.withColumn("asked", F.lit(True))
    else:
        rows = rows.join(asked.select("run_id", F.lit(True).alias("asked")), "run_id", "left").fillna(False, ["asked"])
    everything = cut_lineage(rows, codec="zstd")
    runs = everything.where("asked")
    first_day = runs.where("window_days IS NOT NULL").select(
        *keys, "run_id", (F.col("number") - F.col("window_days")).alias("number"),
        F.timestamp_add("DAY", -F.col("window_days"), F.col("observed_at")).alias("at"),
        F.lit(None).cast("bigint").alias("price"), F.lit(True).alias("probe"), F.lit(True).alias("asked"),
    )
    own = everything.select(*keys, "run_id", "number", F.col("observed_at").alias("at"), price.alias("price"),
                            F.lit(False).alias("probe"), "asked")
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    day_rows = Window.partitionBy(*keys, "number")
    mixed = own.unionByName(first_day)
    if asked is not None:
        # The days are told where their rows lie together anyway, so rows are shuffled once.
        mixed = mixed.withColumn("walked", F.max("asked").over(day_rows)).where("walked").drop("walked")
    earlier = F.min("price").over(day_rows.orderBy(micros).rangeBetween(Window.unboundedPreceding, -1))
    onward = F.min("price").over(_running(day_rows.orderBy(micros.desc())))
    partial = mixed.withColumn("low", F.when(F.col("probe"), onward).otherwise(earlier))
    per_run = partial.where("asked").groupBy(*(keys if asked is None else keys[:1]), "run_id").agg(
        F.min("low").alias("partial_low"))
    days = everything.groupBy(*keys, "number").agg(F.min(price).alias("day_low"))
    whole = _days_low(days, days if asked is None else runs.select(*keys, "number").distinct())

    def same(left: str, right: str, *names: str) -> Column:
        tests = [F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")) for n in names]
        result = tests[0]
        for test in tests[1:]:
            result = result & test
        return result

    # A number has one look-back. Asked runs have an id, so equal keys are enough and ``per_run`` lies right for its join.
    own_run = same("r", "p", *keys, "run_id") if asked is None else (
        (F.col("r.pair") == F.col("p.pair")) & (F.col("r.run_id") == F.col("p.run_id")))
    joined = runs.alias("r").join(per_run.alias("p"), own_run).join(
        whole.alias("w"), same("r", "w", *keys, "number"), "left"
    )
    answered = joined.select("r.pair", "r.run_id", "r.observed_at", "r.price_minor", "r.is_direct",
                             F.least("partial_low", "days_low").alias("previous_minimum"))
    return numbered.join(answered, "pair").drop("pair").select(
        "branch_key", "window_days", "run_id", "observed_at", "price_minor", "is_direct", "previous_minimum")


# -- rules -------------------------------------------------------------------


def eval_price_threshold() -> Column:
    return F.col("price_minor") <= F.col("threshold_price_minor")


def eval_new_low() -> Column:
    """No earlier price, or lower than all of them."""
    return F.col("previous_minimum").isNull() | (F.col("price_minor") < F.col("previous_minimum"))


def eval_percentage_drop() -> Column:
    """Drop in 1/100 percent, cut toward zero, reaches the threshold."""
    points = drop_basis_points(F.col("price_minor"), F.col("previous_minimum"))
    return (F.col("price_minor") < F.col("previous_minimum")) & (points >= F.col("threshold_percentage"))


def eval_absolute_drop() -> Column:
    """The threshold price is read as a difference."""
    return F.col("previous_minimum") - F.col("price_minor") >= F.col("threshold_price_minor")


def eval_direct_available() -> Column:
    return F.col("is_direct") & within("threshold_price_minor", "price_minor")


def eval_range() -> Column:
    """Price inside the configured range; a missing or negative end is open."""
    low, high, price = F.col("config_min_price"), F.col("config_max_price"), F.col("price_minor")
    above = low.isNull() | (low < 0) | (price >= low)
    below = high.isNull() | (high < 0) | (price <= high)
    return above & below


def is_triggered() -> Column:
    """Dispatch on the rule type; an unknown type never triggers."""
    tests = {
        "price_threshold": eval_price_threshold, "new_low": eval_new_low,
        "percentage_drop": eval_percentage_drop, "absolute_drop": eval_absolute_drop,
        "direct_available": eval_direct_available, "round_trip_range": eval_range,
    }
    kind = F.col("rule_type")
    result = F.when(F.lit(False), F.lit(False))
    for name in RULE_TYPES:
        result = result.when(kind == name, tests[name]())
    return F.coalesce(result.otherwise(False), F.lit(False))


def evaluate_alerts(rule_rows: DataFrame, history: DataFrame, runs: DataFrame) -> DataFrame:
    """Every rule on every pending run of its query that has a price for it."""
    asked = pending_runs(runs).select("run_id")
    current = history.join(asked, "run_id", "left_semi")
    rules = rule_rows.withColumnRenamed("comparison_window_days", "window_days")
    matched = rules.alias("a").join(
        current.alias("c"),
        (F.col("a.branch_key") == F.col("c.branch_key")) & F.col("a.window_days").eqNullSafe(F.col("c.window_days")),
    ).drop(F.col("c.branch_key"), F.col("c.window_days"))
    return matched.withColumn("triggered", is_triggered())


def rule_windows(rule_rows: DataFrame) -> DataFrame:
    return rule_rows.select("branch_key", F.col("comparison_window_days").alias("window_days")).distinct()


def event_key() -> Column:
    return F.substring(
        F.concat_ws(":", F.col("rule_id").cast("string"), F.col("run_id").cast("string"), F.col("rule_type")), 1, 180
    )


def apply_cooldown(events: DataFrame, stored: DataFrame, now: datetime) -> DataFrame:
    """Drop events of rules that are cooling down at ``now``.

    Only the newest stored event of a rule matters. Within one evaluation the
    oldest run of a rule wins, unless the rule has no cooldown.
    """
    last = stored.groupBy("rule_id").agg(F.max("created_at").alias("last_event_at"))
    quiet_from = add_seconds(F.lit(now).cast("timestamp_ntz"), -F.col("cooldown_seconds").cast("bigint"))
    allowed = events.join(last, "rule_id", "left").where(
        F.col("last_event_at").isNull() | (F.col("last_event_at") < quiet_from)
    ).drop("last_event_at")
    oldest = allowed.groupBy("rule_id").agg(F.min(F.struct("observed_at", "run_id")).alias("__first"))
    return allowed.join(oldest, "rule_id").where(
        (F.col("cooldown_seconds") <= 0) | (F.col("__first.run_id") == F.col("run_id"))
    ).drop("__first")


def dedupe_events(events: DataFrame, stored_keys: DataFrame) -> DataFrame:
    """One event per key, and none whose key is stored already."""
    keyed = events.withColumn("deduplication_key", event_key()).dropDuplicates(["deduplication_key"])
    return keyed.join(stored_keys.select("deduplication_key"), "deduplication_key", "left_anti")


def rule_targets(rules: DataFrame, links: DataFrame, channels: DataFrame) -> DataFrame:
    """Channels of every rule: its enabled linked ones, else all enabled of the user."""
    enabled = channels.where("enabled").select("channel_id", "user_id")
    owners = rules.select("rule_id", "user_id")
    linked = owners.join(links, "rule_id").join(enabled, ["channel_id", "user_id"]).select("rule_id", "channel_id")
    bare = owners.join(linked, "rule_id", "left_anti")
    return linked.distinct().unionByName(bare.join(enabled, "user_id").select("rule_id", "channel_id"))


def fan_out_deliveries(events: DataFrame, targets: DataFrame, now: datetime) -> DataFrame:
    """One pending delivery per event and channel."""
    return events.join(targets, "rule_id").select(
        "deduplication_key", "rule_id", "run_id", "channel_id", F.lit("pending").alias("status"),
        F.lit(0).cast("bigint").alias("attempt_count"), F.lit(now).cast("timestamp_ntz").alias("next_attempt_at"),
    )


def target_prices(rules: DataFrame) -> DataFrame:
    """Newest target-price rule of every subscription."""
    tagged = rules.where(
        "rule_type = 'price_threshold' AND threshold_price_minor IS NOT NULL "
        "AND config_source = 'subscription_target_price'"
    )
    newest = F.max_by(F.struct("threshold_price_minor", "threshold_currency"), F.struct("created_at", "rule_id"))
    return tagged.groupBy("subscription_id").agg(newest.alias("t")).select(
        "subscription_id", F.col("t.threshold_price_minor").alias("target_price_minor"),
        F.col("t.threshold_currency").alias("target_currency"),
    )


def event_list(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Events with the subscription of their rule."""
    return events.join(rules.select("rule_id", "subscription_id", "rule_type"), "rule_id")
