"""Small payloads with known results."""

from __future__ import annotations

import json
from datetime import date, datetime

import pandas as pd
from pyspark.sql import functions as F

from skyledger.functions import payload as pl
from skyledger.operators import normalize as no
from skyledger.sources import captures as cp


def captures(spark, *payloads, currency="CNY"):
    data = [(1, f"c{i}", currency, p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)]
    return spark.createDataFrame(data, "run_id long, capture_id string, default_currency string, payload string")


def test_calendar_prices_in_many_spellings(spark, plain):
    body = {"data": {"currency": "cny", "priceList": [
        {"departDate": "2026-08-01", "price": 2310}, {"departDate": "2026-08-02", "price": "2180"},
        {"departDate": "2026-08-03", "price": "CNY 2180", "totalPrice": None},
        {"departureDate": "2026-08-04", "lowestPrice": 2265.5, "returnDate": "2026-08-09", "totalAmount": "4,000"},
        {"date": "2026-08-02", "price": 1999}]}}
    got = plain(no.dedupe_calendar(no.parse_calendar(captures(spark, body))),
                "departure_date", "return_date", "currency", "lowest_price_minor", "total_price_minor")
    assert got == [
        (date(2026, 8, 1), None, "CNY", 231000, None), (date(2026, 8, 2), None, "CNY", 199900, None),
        (date(2026, 8, 3), None, "CNY", 218000, None), (date(2026, 8, 4), date(2026, 8, 9), "CNY", 226550, 400000)]


def test_calendar_issues_keep_valid_siblings(spark, plain):
    body = [{"deep": {"er": {"date": "bad 12", "price": 1}}}, {"date": "2026-01-01", "price": True},
            {"date": None, "departDate": "2026-01-01", "price": 5}, {"departDate": None, "date": "2026-01-01", "price": 5},
            {"date": "2026-01-02", "price": 7, "returnDate": "x", "totalPrice": "y"},
            {"date": "2026-01-03", "price": 7, "returnDate": "/Date(-62135596800000)/"}]
    sources = captures(spark, body, {"status": 0}, "not json")
    parsed = no.parse_calendar(sources)
    assert plain(no.calendar_issues(sources, parsed), "capture_id", "code", "severity") == sorted([
        ("c0", "invalid_departure_date", "warning"), ("c0", "invalid_price", "warning"),
        ("c0", "invalid_departure_date", "warning"),
        ("c0", "invalid_return_date", "warning"), ("c0", "invalid_total_price", "warning"),
        ("c1", "calendar_records_missing", "error"), ("c2", "calendar_records_missing", "error")], key=repr)
    # the first present name counts, also with a null value
    assert [r[0] for r in plain(no.dedupe_calendar(parsed), "lowest_price_minor")].count(500) == 1


def test_yen_has_no_minor_digits(spark, plain):
    got = no.dedupe_calendar(no.parse_calendar(captures(spark, {"x": [{"date": "2026-01-01", "price": 2180}]}, currency="jpy")))
    assert plain(got, "currency", "lowest_price_minor") == [("JPY", 2180)]


def flight(**changes):
    base = {"flightNo": "MU1", "airlineCode": "mu", "departureAirportCode": "PVG", "arrivalAirportCode": "NRT",
            "departureDateTime": "2026-08-01T08:00:00", "arrivalDateTime": "2026-08-01T12:00:00"}
    return {k: v for k, v in {**base, **changes}.items() if v is not ...}


def test_itineraries_legs_segments_and_offers(spark, plain):
    body = {"list": [{"itineraryList": [
        {"id": "a", "legs": [{"flights": [flight(), flight(flightNo="MU2", departureAirportCode={"code": "NRT"},
                                                           arrivalAirportCode="ICN", stops=[{}],
                                                           departureDateTime="2026-08-01T14:00:00",
                                                           arrivalDateTime="2026-08-01T16:00:00+09:00")]}],
         "offers": [{"id": 1, "totalPrice": "100.5", "adultPrice": 80, "seatCount": "3"}, {"id": 2, "price": 90}]},
        {"id": "b", "legs": [flight(duration="2h 5m")], "offers": [], "duration": 0},
        {"id": "a", "legs": [flight()]},
        {"id": "c", "legs": [{"flights": [flight(flightNo=...)]}], "offers": []},
        {"id": "d", "legs": [{"flights": [flight(arrivalAirportCode="XXX")]}], "offers": []},
        {"id": "e", "legs": [{"flights": [flight(departureTimeZone="Mars/Base"), flight()]}, {"flights": [flight()]}]},
        "text"]}]}
    parts = no.parse_itineraries(captures(spark, body), cp.AIRPORT_ZONES)
    flights = no.normalize_segments(parts.segments)
    trips = no.normalize_itineraries(parts.itineraries, flights)
    assert plain(trips, "provider_itinerary_id", "leg_count", "total_duration_minutes", "stop_count", "is_direct",
                 "dropped_for") == [
        ("a", 1, 300, 2, False, None), ("b", 1, 125, 0, True, None),
        ("d", 1, None, None, None, "itinerary_skipped_missing_timezone"), ("e", 2, 360, 0, True, None)]
    assert plain(parts.offers, "provider_offer_id", "total_price_minor", "base_price_minor", "seats_remaining") == [
        ("1", 10050, 8000, 3), ("2", 9000, None, None)]
    numbered = no.number_segments(flights).where("flight_number = 'MU2'")
    assert plain(numbered, "position", "departure_utc", "arrival_utc", "technical_stop_count", "arrival_tz") == [
        (1, datetime(2026, 8, 1, 5), datetime(2026, 8, 1, 7), 1, "Asia/Seoul")]
    codes = {r.code for r in parts.issues.collect()}
    assert codes == {"duplicate_itinerary_id", "segment_required_fields_missing", "invalid_itinerary", "offer_list_missing"}
    assert plain(flights.where("dropped_for IS NOT NULL"), "dropped_for") == [
        ("segment_timezone_invalid",), ("segment_timezone_missing",)]


def test_shape_ignores_values_and_list_order(spark):
    data = [('{"b":1,"a":[1,"x",null,{"k":true}]}',), ('{"a":[{"k":false},null,"y",2,3],"b":2.5}',), ("[",), (None,)]
    df = spark.createDataFrame(data, "p string")
    shapes = [r[0] for r in df.select(pl.payload_shape("p")).collect()]
    assert shapes[0] == shapes[1] == "\n".join([
        "boolean /a/[]/k", "list /a", "null /a/[]", "number /a/[]", "number /b", "object ", "object /a/[]", "string /a/[]"])
    assert shapes[2:] == [None, None]


def test_shapes_worked_out_once_are_those_of_each_text(monkeypatch):
    """Texts that differ only in leaves share one walk; broken ones and ones that look alike keep their own result."""
    texts = ['{"a":1,"b":"x"}', '{"a":-2.5e3,"b":"\\u00e9 \\" : 7"}', '{"a":"1","b":"x"}', '{"a":,"b":"x"}', '{"a":01,"b":"x"}', '{"a":1.,"b":""}',
             '{"a":1 2,"b":"x"}', '{"a":+1,"b":"x"}', '{"a":"x","a":1}', '{"a":1,"a":"x"}', '["a",1]', '["a":1]', '["b" ,\n2]', '["\\x"]', '["\\u-1AB"]',
             '["\\u12"]', '["a\tb"]', '["a]', '"5', '"', '""', '7', '-', 'NaN', '[NaN]', '[1]', '[-Infinity]', f'[{"9" * 5000}]', f'[{"9" * 200}]',
             '{"a:":{"1":[]}}', '{"a:":{"2":[]}}', '{"a\x00":1}', '["\x00"]', '[\x00]', '[true,null]', '[false,null]', '[1,{}]', '{"k" : "v"}', '{"k":"v"}', None, '']
    want = [None if x is None else pl._described(x) for x in texts]
    walks, places = [], pl._places
    monkeypatch.setattr(pl, "_places", lambda root: walks.append(root) or places(root))
    for order in (1, -1):
        got = pl.payload_shape.func(pd.Series(texts[::order], dtype=object))
        assert [None if x is None or x != x else x for x in got][::order] == want
    walks.clear()
    pl.payload_shape.func(pd.Series([json.dumps({"a": i, "b": [f"{i}", {"c": i / 7}]}) for i in range(500)]))
    assert len(walks) == 1


def test_top_level_fields_of_odd_keys(spark):
    keys = ["a/b", "~0", "[]", "x y", "", "n\nl", "k" * 200]
    df = spark.createDataFrame([(json.dumps({k: 1 for k in keys}),), ('[{"k":1}]',), ("3",)], "p string")
    got = [r[0] for r in df.select(pl.top_level_fields(pl.payload_shape("p"))).collect()]
    assert got == [sorted(k[:120] for k in keys if k), [], []]


def test_rules_for_responses(spark, plain):
    url = "https://h/FlightIntlAndInlandLowestPriceSearch?token=1"
    data = [(1, url, "post", 432, "{}"), (2, url, "POST", 500, ""), (3, url, "POST", 404, ""), (4, url, "POST", 200, "<html>"),
            (5, url, "POST", 200, "[1]"), (6, url, "POST", 200, '{"a":1}'), (7, url, "POST", 200, '{"priceList":[]}'),
            (8, url, "GET", 200, '{"priceList":[]}'), (9, "https://h/else", "POST", 200, "{}")]
    df = spark.createDataFrame(data, "run_id long, url string, method string, status long, payload string")
    got = plain(cp.classify_responses(df), "run_id", "failure", "retryable")
    assert [(a, b, bool(c)) for a, b, c in got] == [
        (1, "anti_bot_432", True), (2, "response_status", True), (3, "response_status", False),
        (4, "response_decode", True), (5, "schema_missing", False), (6, "schema_missing", False), (7, None, False)]


def test_search_rules(spark, plain):
    def search(**changes):
        base = {"provider": " Alpha ", "trip_type": "one_way", "legs": [("pvg", "NRT ", date(2026, 8, 1))], "adults": 1,
                "children": 0, "infants": 0, "cabin": "economy", "currency": "cny", "direct_only": False,
                "airline_codes": ["mu", "MU", "ca"], "departure_airports": [], "arrival_airports": None,
                "departure_minute_start": None, "departure_minute_end": None}
        return {**base, **changes}

    back = ("NRT", "PVG", date(2026, 8, 5))
    cases = [search(), search(legs=[("PVG", "NRT", date(2026, 8, 1))], airline_codes=["jl"]), search(direct_only=True),
             search(trip_type="round_trip"), search(trip_type="round_trip", legs=[("PVG", "NRT", date(2026, 8, 6)), back]),
             search(legs=[("PVG", "PVG", date(2026, 8, 1))]), search(adults=0), search(adults=1, infants=2),
             search(departure_minute_start=10), search(departure_minute_start=10, departure_minute_end=5),
             search(currency="YUAN"), search(airline_codes=["TOOLONG"]), search(provider=" ")]
    schema = ("provider string, trip_type string, legs array<struct<origin string, destination string, departure_date date>>, "
              "adults int, children int, infants int, cabin string, currency string, direct_only boolean, "
              "airline_codes array<string>, departure_airports array<string>, arrival_airports array<string>, "
              "departure_minute_start int, departure_minute_end int")
    data = [tuple(c.values()) for c in cases]
    got = no.canonical_queries(spark.createDataFrame(data, schema).coalesce(1)).collect()
    assert [r.problem for r in got] == [
        None, None, None, "wrong_leg_count", "return_before_departure", "same_origin_and_destination",
        "invalid_passengers", "infant_without_adult", "half_open_window", "empty_window", "invalid_currency",
        "invalid_airline_code", "provider_missing"]
    assert got[0].query_hash == got[1].query_hash != got[2].query_hash
    assert got[0].airline_codes == ["CA", "MU"]


def test_fields_are_read_as_from_variant_values(spark):
    """Types and texts of found fields are those of VARIANT values of the found nodes, odd numbers included; none is written."""
    values = ["1", "-7", "1.50", "12.0", "0.0", "-0.0", "0.00001", "1e20", "1E-9", "1e400", "NaN", str(2**63), "9" * 38, "9" * 39,
              "true", "null", '"x"', '" 5 "', '"\\u00e9\\ud83d\\ude00"', '"\\ud800"', "[]", "[1,2]", '{"code":"A"}', '{"code":null}', "{}"]
    bodies = [f'{{"x":[{{"date":"d","price":1,"back":{value}}}]}}' for value in values]
    rows = captures(spark, *bodies).coalesce(1)
    spec = pl.Record({"back": ["none", "back"], "money": ["back"]}, ("money",))
    found = pl.find_objects(F.col("payload"), [["date"], ["price"]], ["currency"], spec)
    got = pl.with_fields(rows.select("capture_id", F.explode(found).alias("h")).select("capture_id", "h.found.*"), ["back", "money"])
    nodes = captures(spark, *[json.dumps(json.loads(x)) for x in bodies]).select("capture_id", pl.parsed(F.col("payload")).alias("v"))
    back = F.try_variant_get("v", "$.x[0].back", "variant")
    code = F.when(F.schema_of_variant(back).startswith("OBJECT"), F.try_variant_get(back, "$.code", "variant")).otherwise(back)
    want = pl.with_scalars(nodes.select("capture_id", back.alias("back"), code.alias("money")), ["back", "money"])
    names = ["capture_id", "back_type", "back_text", "money_type", "money_text"]
    assert sorted(map(tuple, got.select(names).collect()), key=repr) == sorted(map(tuple, want.select(names).collect()), key=repr)
    assert "variant" not in no.parse_items(rows).schema.simpleString()


def test_entries_of_every_kind_keep_their_order(spark):
    """Objects that name their fields differently, values that are no objects and a refused list stand where the payload has them."""
    body = {"itineraries": [
        {"id": "a", "legs": [{"flightNo": "MU1"}, 3, [1]], "offers": [{"price": 5}]}, 7, {"routeId": 2**70, "offers": []}, None,
        {"sequenceId": "b", "legs": [{"flights": [{"flightNo": 1, "stops": [1, 2]}, "x", {"marketFlightNo": "NH2"}]}]},
        {"id": "c", "duration": True, "offers": [{"totalPrice": None, "currency": {"code": "eur"}}, {"currency": {}}]}]}
    rows = captures(spark, body, '{"itineraries":[{"id":1e999}]}').coalesce(1)
    found = pl.find_lists(F.col("payload"), no.ITINERARY_LISTS, no.CURRENCY_KEYS, no.ITEM)
    (good,), (refused,) = [r[0] for r in rows.select(found).collect()]
    assert (refused.path, refused.code, refused.found) == ("$.itineraries", None, None)
    assert (good.path, good.code) == ("$.itineraries", "EUR")
    assert [(x.kind, x.id, x.length) for x in good.found] == [
        ("o", "sa", None), ("i7", None, None), ("o", f"n{2**70}", None), ("v", None, None), ("o", "sb", None), ("o", "sc", "b")]
    assert [[(leg.kind, [f.flight_number for f in leg.flights] if leg.flights is not None else None) for leg in x.legs]
            for x in good.found if x.legs] == [
        [("o", ["sMU1"]), ("i3", None), ("a", None)], [("o", ["i1", None, "sNH2"])]]
    assert [x.offers if not x.offers else [(o.money, o.given, o.fallback) for o in x.offers] for x in good.found] == [
        [(None, None, "i5")], None, [], None, None, [("seur", "v", None), (None, None, None)]]


def test_first_entries_are_found_without_sorting(spark, plain):
    """Their numbers travel as one value, which a hash aggregate holds; the list counts before the entry."""
    items = spark.createDataFrame(
        [(1, "c", (1, 0), "a"), (1, "c", (0, 9), "a"), (1, "c", (0, 11), "a"), (1, "c", (1, 1), "b")],
        "run_id long, capture_id string, itinerary_no struct<list_no:int,item_no:int>, provider_itinerary_id string")
    first = no.dedupe_itineraries(items)
    assert plain(first.select("itinerary_no.*")) == [(0, 9), (1, 1)]
    assert first.schema["itinerary_no"].dataType.simpleString() == "struct<list_no:int,item_no:int>"
    assert "SortAggregate" not in first._jdf.queryExecution().toString()


def test_parts_of_itineraries_are_worked_out_within_a_capture(spark, plain):
    """Which entries are kept is found where the entries of a capture lie together, without a join or a second shuffle."""
    def entry(name, *flights):
        return {"id": name, "legs": [{"flights": list(flights)}], "offers": [{"id": name, "price": 5}]}
    first = {"itineraries": [entry("a", flight(flightNo=...)), entry("a", flight()), entry("a", flight(flightNo="MU9")), {"id": "b"}]}
    rows = captures(spark, first, {"itineraries": [entry("a", flight())]}, {"none": 1})
    again = rows.where("capture_id = 'c0'")
    twice = rows.unionByName(again).unionByName(again.withColumn("run_id", F.lit(None).cast("long"))).coalesce(1)
    parts = no.parse_itineraries(twice, cp.AIRPORT_ZONES, ["itineraries"])
    assert plain(parts.itineraries, "capture_id", "itinerary_no.item_no", "leg_count") == [("c0", 1, 1), ("c0", 1, 1), ("c1", 0, 1)]
    plan = parts.itineraries._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_stops_of_an_entry_are_counted_over_its_legs(spark, plain):
    """Legs and flights are counted in one step: a leg of one flight has no stop, technical stops count, two legs may both be direct."""
    late = {"departureDateTime": "2026-08-01T20:00:00", "arrivalDateTime": "2026-08-01T22:00:00"}
    body = {"itineraries": [
        {"id": "a", "legs": [{"flights": [flight()]}, {"flights": [flight(**late)]}]},
        {"id": "b", "legs": [{"flights": [flight(), flight(**late)]}, {"flights": [flight(stops=[1, 2])]}]}]}
    parts = no.parse_itineraries(captures(spark, body).coalesce(1), cp.AIRPORT_ZONES, ["itineraries", "segments"])
    assert parts.offers is None and parts.issues is None
    trips = no.normalize_itineraries(parts.itineraries, no.normalize_segments(parts.segments))
    assert plain(trips, "provider_itinerary_id", "leg_count", "stop_count", "is_direct") == [("a", 2, 0, True), ("b", 2, 3, False)]
    plan = trips._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
