import datetime as dt
import hashlib
import json

from pyspark.sql import functions as F

from changeflow.schemas import CHANGE_LOG, target_schema
from changeflow.sources import changelog, messages

T0 = dt.datetime(2024, 1, 1, 12)


def log(spark, rows):
    return spark.createDataFrame(rows, CHANGE_LOG)


def test_poll_order_limit_and_consumed(spark):
    rows = log(spark, [(s, "I", str(s), T0, "{}", s == 1) for s in (5, 3, 1, 2, 4)])
    assert [r.seq_id for r in changelog.poll(rows, 0, 2).collect()] == [2, 3]
    assert [r.seq_id for r in changelog.poll(rows, 3, None).collect()] == [4, 5]


def test_decode(spark):
    texts = ['{"a":1234567890.12,"b":null,"c":"ü|x"}', "broken", "", None, "[1]", "{}"]
    rows = log(spark, [(i, "U", "k", T0 if i else None, t, False) for i, t in enumerate(texts)])
    got = changelog.decode(rows, now=F.lit("2024-02-01").cast("timestamp")).orderBy("seq_id").collect()
    assert [r.fields for r in got] == [{"a": "1234567890.12", "b": None, "c": "ü|x"}, None, None, None, None, {}]
    assert got[0].ts_ms == 1706745600000 and got[1].ts_ms == 1704110400000


def test_envelope(spark):
    rows = log(spark, [
        (1, "I", "ORD-001", T0, '{"CUSTOMER_ID":"C-100"}', False), (5, "D", "ORD-002", T0, '{"x":1}', False),
        (6, "U", "ORD-001|ITEM-003|extra", T0, "{}", False)])
    events = changelog.envelope(changelog.decode(rows), "src", "SHOP", "ORDERS", ["ORDER_ID", "ITEM_ID"])
    got = {r.seq: r for r in events.collect()}
    assert got[1].key == {"ORDER_ID": "ORD-001", "ITEM_ID": None} and got[1].after == {"CUSTOMER_ID": "C-100"}
    assert got[1].before is None and got[5].after is None and got[5].op == "D"
    assert got[6].key == {"ORDER_ID": "ORD-001", "ITEM_ID": "ITEM-003"}


def test_records_round_trip_with_dead_letters(spark):
    rows = log(spark, [(i, "U", f"b{i}|a", T0, '{"n":250.5}', False) for i in range(4)])
    events = changelog.envelope(changelog.decode(rows), "src", "Shop", "Orders", ["k1", "k2"])
    records = messages.to_records(events)
    first = records.orderBy("value").first()
    assert first.topic == "cdc.shop.orders"
    assert bytes(first.key) == hashlib.md5(b"a|b0").digest()
    bad = ["{", "", None, '{"source":"s"}', "[]", json.dumps({
        "source": "s", "schema": "x", "table": "t", "op": "I", "key": {"a": 1}, "ts_ms": 1})]
    mixed = records.select("value").unionByName(spark.createDataFrame([(b,) for b in bad], "value string"))
    parsed = messages.parse(mixed)
    good, dead = messages.good_events(parsed), messages.dead_letters(parsed, ["value"])
    assert good.count() == 4 and dead.count() == len(bad)
    assert {r.after["n"] for r in good.collect()} == {"250.5"}
    errors = {r.parse_error for r in dead.collect()}
    assert "missing seq" in errors and "malformed" in errors


def test_numbers_in_messages_keep_their_digits(spark):
    text = json.dumps({"source": "s", "schema": "x", "table": "t", "op": "I", "key": {"id": 7}, "before": None,
                       "after": {"amount": 1234567890.12, "n": None}, "ts_ms": 1, "seq": 2})
    row = messages.good_events(messages.parse(spark.createDataFrame([(text,)], "value string"))).first()
    assert row.after == {"amount": "1234567890.12", "n": None} and row.key == {"id": "7"} and row.before is None


def test_mark_consumed_and_purge(spark):
    now = dt.datetime(2024, 1, 1, 12)
    rows = log(spark, [
        (1, "I", "a", now - dt.timedelta(hours=2), "{}", True), (2, "I", "b", now - dt.timedelta(hours=5), "{}", False),
        (3, "I", "c", now - dt.timedelta(minutes=5), "{}", True), (4, "I", "d", now - dt.timedelta(hours=1), "{}", True),
        (5, "I", "e", None, "{}", True)])
    at = F.lit(now).cast("timestamp")
    assert sorted(r.seq_id for r in changelog.purge(rows, at).collect()) == [2, 3, 4, 5]
    assert changelog.purge_counts(rows, at, ["op_type"]).first().purged == 1
    acked = changelog.mark_consumed(rows, spark.createDataFrame([(2,), (2,), (9,)], "seq_id long"))
    assert acked.count() == 5 and acked.where("is_consumed").count() == 5


def test_capture_and_numbering(spark):
    ddl = "id int, part string, a string, b double"
    old = spark.createDataFrame([(1, "x", "p", 1.0), (2, "x", None, 2.0), (3, "x", "q", None)], ddl)
    new = spark.createDataFrame([(1, "x", "p", 1.0), (2, "x", "z", 2.0), (4, "x", None, 4.5)], ddl)
    changes = changelog.capture(old, new, ["id", "part"], ["a", "b"])
    got = {r.row_key: (r.op_type, r.changed_fields) for r in changes.collect()}
    assert got == {"2|x": ("U", '{"a":"z","b":2.0}'), "3|x": ("D", None), "4|x": ("I", '{"a":null,"b":4.5}')}
    many = spark.range(1000).selectExpr("id", "'I' op_type")
    first = changelog.number_changes(many, ["id"], start=10, rows_per_range=20)
    again = changelog.number_changes(many.repartition(5), ["id"], start=10, rows_per_range=20)
    numbers = {r.id: r.seq_id for r in first.collect()}
    assert sorted(numbers.values()) == list(range(10, 1010))
    assert numbers == {r.id: r.seq_id for r in again.collect()}


def test_target_schema():
    schema = target_schema([("ID", "BIGINT"), ("A", "DECIMAL"), ("B", "odd")])
    assert [f.dataType.simpleString() for f in schema] == [
        "bigint", "decimal(38,10)", "string", "string", "bigint", "bigint"]
    assert target_schema([("ID", "BIGINT")], typed=False)["ID"].dataType.simpleString() == "string"
