"""Loads, costs, catalog, lineage, reports and metadata readers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from changeflow.operators import catalog, costs, metrics, reports, status
from changeflow.plans.inputs import at
from changeflow.schemas import target_schema
from changeflow.session import lookup_join, shared_dir
from changeflow.sources import catalog as catalog_source
from changeflow.sources import metadata, snapshot

T0 = dt.datetime(2024, 1, 1)


def test_chunk_plan_and_progress(spark):
    keys = spark.range(1, 25001).withColumnRenamed("id", "k")
    plan = [(r.start_pk, r.end_pk) for r in snapshot.chunk_plan(keys, "k").orderBy("chunk_id").collect()]
    assert plan == [(1, 10000), (10001, 20000), (20001, 25000)]
    rows = snapshot.load_progress(keys, "k").orderBy("chunk_id").collect()
    assert [(r.percent, r.records_read, r.current_pk) for r in rows] == [
        (33.3, 10000, 10000), (66.7, 20000, 20000), (100.0, 25000, 25000)]


def test_empty_table_and_missing_keys(spark):
    empty = spark.createDataFrame([], "k long")
    assert snapshot.chunk_plan(empty, "k").count() == 0 and snapshot.load_progress(empty, "k").count() == 0
    rows = spark.createDataFrame([(None,), (-5,), (7,)], "k long")
    got = sorted((r.k, r.chunk_id) for r in snapshot.with_chunk(rows, "k", 10).collect())
    assert got == [(-5, 0), (7, 1)]


def test_resume_skips_finished_chunks(spark):
    rows = spark.range(100).withColumnRenamed("id", "k")
    done = spark.createDataFrame([(0,), (3,), (3,)], "chunk_id long")
    assert sorted(r.k for r in snapshot.chunk_read(rows, "k", 25, done).collect()) == list(range(25, 75))


def test_bulk_append_retry_and_resume(spark):
    path = shared_dir(spark, "bulk")
    table = spark.range(100).withColumnRenamed("id", "k")
    assert snapshot.finished_chunks(spark, path).count() == 0
    first = snapshot.with_chunk(table, "k", 30).where("chunk_id < 2")
    for _ in range(2):
        assert {tuple(r) for r in snapshot.bulk_append(first, path, 0).collect()} == {(0, 30), (1, 30)}
    rest = snapshot.chunk_read(table, "k", 30, done=snapshot.finished_chunks(spark, path))
    assert {tuple(r) for r in snapshot.bulk_append(rest, path, 1).collect()} == {(2, 30), (3, 10)}
    assert spark.read.parquet(path).count() == 100
    assert snapshot.finished_chunks(spark, path).count() == 4


def test_unit_prices(spark):
    rows = spark.createDataFrame([("c", "o", "t", 1_000_000, 1024**3, 3_600_000, T0)],
                                 "config_id string, org_id string, target_type string, records long, bytes long, "
                                 "compute_ms long, ts timestamp")
    row = costs.hourly_costs(rows).first()
    assert float(row.cost_usd) == pytest.approx(0.65) and row.records_usd == 0.5 and row.compute_seconds == 3600
    hours = costs.hourly_usage(rows.withColumn("target_type", F.lit(None).cast("string")))
    summary = {r.target_type: r.cost_usd for r in costs.cost_summary(hours, at("2024-01-02")).collect()}
    assert set(summary) == {"unknown", "all"}
    assert costs.daily_costs(hours, at("2024-03-01")).count() == 0


def test_lookup_join_paths_agree(spark):
    facts = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    lookup = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c"), (9, "d")], "k long, name string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        small = sorted(map(str, lookup_join(facts, lookup, ["k"], how).collect()))
        large = sorted(map(str, lookup_join(facts, lookup, ["k"], how, max_rows=1).collect()))
        assert small == large


def test_schema_changes_and_mapping(spark):
    ddl = "config_id string, column_name string, data_type string, is_primary_key boolean"
    known = spark.createDataFrame([("c", "A", None, None), ("c", "B", "BIGINT", True), ("c", "OLD", None, None)], ddl)
    found = spark.createDataFrame([("c", "A", "VARCHAR", True), ("c", "B", "VARCHAR", False), ("c", "NEW", "DATE", False)], ddl)
    changes = catalog.schema_changes(known, found)
    assert {(r.column_name, r.change_type) for r in changes.collect()} == {
        ("OLD", "column_removed"), ("NEW", "column_added"), ("B", "type_changed"), ("B", "pk_changed")}
    configs = spark.createDataFrame(
        [("c", [("A", "a", None)]), ("d", [])],
        "config_id string, field_mappings array<struct<source:string,target:string,transform:string>>")
    grown = {r.config_id: [m.target for m in r.field_mappings]
             for r in catalog.extend_mappings(configs, catalog.auto_map(changes)).collect()}
    assert grown == {"c": ["a", "new"], "d": []}
    assert {(r.change_type, r.status) for r in catalog.resolve_added(changes).collect()} == {
        ("column_added", "applied"), ("column_removed", "pending"), ("type_changed", "pending"), ("pk_changed", "pending")}


def test_config_checks(spark):
    mapping = "config_id string, connector_id string, field_mappings array<struct<source:string>>, primary_key_fields array<string>"
    configs = spark.createDataFrame([
        ("ok", "c", [("ID",), ("V",)], ["ID"]), ("nokey", "c", [("V",)], ["ID"]), ("empty", "c", [], ["ID"]),
        ("lost", "x", [("ID",)], ["ID"])], mapping)
    connectors = spark.createDataFrame([("c",), ("c",)], "connector_id string")
    got = {r.config_id: (r.valid, r.pk_in_mappings) for r in catalog.check_configs(configs, connectors).collect()}
    assert got == {"ok": (True, True), "nokey": (True, False), "empty": (False, False), "lost": (False, True)}


def test_lineage(spark):
    mappings = spark.createDataFrame([("c", "A", "a"), ("c", "B", "b")], "config_id string, source string, target string")
    transforms = spark.createDataFrame(
        [("c", "A", "mask", "{}", 10, True), ("c", "A", "trim", "{}", 5, True), ("c", "B", "hash", "{}", 1, True),
         ("c", "B", "mask", "{}", 2, False)],
        "config_id string, source_field string, transform_type string, transform_params string, execution_order int, "
        "is_enabled boolean")
    got = {r.source: ([t.type for t in r.transformations], r.masking_applied)
           for r in catalog.column_lineage(mappings, transforms).collect()}
    assert got == {"A": (["trim", "mask"], True), "B": (["hash"], False)}


def test_catalog_of_spark_tables(spark):
    tables = {"ORDERS": spark.createDataFrame([(1, "a", T0)], "ID bigint, NAME string, AT timestamp")}
    fields = catalog_source.field_rows(spark, "SHOP", tables, {"ORDERS": ["ID"]}).orderBy("position").collect()
    assert [(f.column_name, f.data_type, f.is_primary_key) for f in fields] == [
        ("ID", "BIGINT", True), ("NAME", "VARCHAR", False), ("AT", "TIMESTAMP", False)]
    assert tuple(catalog_source.table_counts(tables, "SHOP").first()) == ("SHOP", "ORDERS", "TABLE", 1)


def test_create_empty_target_keeps_an_existing_one(spark):
    path = shared_dir(spark, "empty")
    schema = target_schema([("ID", "BIGINT"), ("V", "DECIMAL")])
    catalog_source.create_empty(spark, schema, path)
    assert spark.read.parquet(path).columns == [f.name for f in schema]
    spark.createDataFrame([(1, None, "I", 1, 1)], schema).write.mode("append").parquet(path)
    catalog_source.create_empty(spark, schema, path)
    assert spark.read.parquet(path).count() == 1


def test_orphans(spark):
    child = spark.createDataFrame([(1,), (1,), (2,), (None,)], "fk long")
    parent = spark.createDataFrame([(2,)], "id long")
    assert [tuple(r) for r in catalog.orphans(child, "fk", parent, "id").collect()] == [(1, 2)]


def test_metadata_readers(spark):
    rules = spark.createDataFrame(
        [("1", "c", "x", "range", '{"min": 1}', "reject", True), ("2", "c", "x", "enum", None, None, True),
         ("3", "c", "x", "enum", None, None, False), ("4", "d", "x", "enum", None, None, True)],
        "id string, config_id string, field_name string, rule_type string, rule_params string, severity string, "
        "is_enabled boolean")
    loaded = metadata.load_rules(rules, "c")
    assert [(r.id, r.params, r.severity) for r in loaded] == [("1", {"min": 1}, "reject"), ("2", {}, "warn")]
    transforms = spark.createDataFrame(
        [("c", "x", "upper", None, 2, True), ("c", "x", "trim", "{}", 1, True)],
        "config_id string, source_field string, transform_type string, transform_params string, execution_order int, "
        "is_enabled boolean")
    assert [t.transform_type for t in metadata.load_transforms(transforms, "c")] == ["trim", "upper"]


def test_reports(spark):
    rows = spark.createDataFrame([(i, T0 + dt.timedelta(minutes=i // 2), None if i == 3 else "Ab") for i in range(6)],
                                 "id long, at timestamp, name string")
    assert [r.id for r in reports.page(rows, "at", "id", 2, 1).collect()] == [4, 3]
    assert [r.id for r in reports.newest_in_order(rows, "at", "id", 3).collect()] == [3, 4, 5]
    assert reports.search(rows, '"name":null').first().id == 3
    assert reports.search(rows, "aB").count() == 5
    assert reports.distinct_values(rows, "name").count() == 1
    assert reports.total(reports.maybe_where(rows, name="Ab", id=None)).first().total == 5
    with pytest.raises(ValueError):
        reports.page(rows, "at", "id", 501)


def test_dashboard(spark):
    streams = spark.createDataFrame(
        [("a", "active", None, 10, 30000), ("b", "error", "down", 5, None), ("c", "error", None, 1, 0),
         ("d", "active", None, 0, 101)],
        "config_id string, status string, error_message string, records_processed_total long, avg_latency_ms int")
    assert tuple(metrics.dashboard_kpis(streams).first()) == (2, 2, 4, 16, 15051)
    assert sorted((r.config_id, r.level) for r in metrics.dashboard_alerts(streams).collect()) == [
        ("a", "warn"), ("b", "error")]
    codes = streams.select(status.status_code(F.col("status"), F.col("config_id") == "d").alias("c"))
    assert [r.c for r in codes.collect()] == [1, -1, -1, 0]
    assert [r.x for r in spark.createDataFrame([(30001,), (30000,)], "p int").select(
        metrics.sla_level(F.col("p")).alias("x")).collect()] == ["breach", "warning"]


def test_finished_chunks_are_not_scanned(spark):
    path = shared_dir(spark, "t")
    spark.range(100).withColumnRenamed("id", "k").write.parquet(path)
    table = spark.read.parquet(path)
    done = spark.createDataFrame([(0,), (1,), (3,)], "chunk_id long")
    rest = snapshot.chunk_read(table, "k", 20, done)
    assert sorted(r.k for r in rest.collect()) == [*range(40, 60), *range(80, 100)]
    plan = rest._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(k,40)" in plan and "LessThanOrEqual(k,99)" in plan
    every = spark.range(5).select(F.col("id").alias("chunk_id"))
    assert snapshot.chunk_read(table, "k", 20, every).count() == 0


def test_pages_by_key(spark):
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else i // 3) for i in range(40)], "id long, at long")
    whole = [tuple(r) for r in reports.page(rows, "at", "id", limit=50).collect()]
    last, got = None, []
    while True:
        page = reports.page(rows, "at", "id", 9) if last is None else reports.page_after(rows, "at", "id", last, 9)
        page = [tuple(r) for r in page.collect()]
        if not page:
            break
        got, last = got + page, (page[-1][1], page[-1][0])
    assert got == whole
