"""Roles, units and commanded series by the table of rules."""

import pytest
from spanwise.operators import naming

ROLES = [
    ("z3k_heating_circuit", "20603", "target_temp", "ГВС", "dhw_target_temperature", 0.95),
    ("z3k_heating_circuit", "20603", "setpoint_temp", "ГВС", "dhw_setpoint_temperature", 0.95),
    ("z3k_heating_circuit", "20603", "worktime", "ГВС", "dhw_activity", 0.95),
    ("z3k_heating_circuit", "20603", "status", "ГВС", "dhw_status", 0.95),
    ("z3k_heating_circuit", "20603", "mode_id", "ГВС", "dhw_operating_mode", 0.95),
    ("z3k_heating_circuit", "20496", "target_temp", "Отопление", "target_temperature", 0.9),
    ("z3k_heating_circuit", "20496", "worktime", "Котел", "heating_activity", 0.8),
    ("z3k_temperature", "30002", "z3k_temperature", "Внешний датчик обратки", "return_temperature", 0.85),
    ("z3k_radio_sensor", "1", "humidity", "Спальня", "humidity", 0.95),
    ("z3k_radio_sensor", "1", "other", "Спальня", "room_temperature", 0.8),
    ("z3k_boiler_adapter", "2", "rml", "", "burner_activity", 0.95),
    ("z3k_boiler_adapter", "dhw-boiler tank", "x", None, "unknown", 0.3),
    ("z3k_temperature", "outdoor-7", "value", "", "outdoor_temperature", 0.9),  # the entity's id takes part
    ("other", "9", "mode", "", "operating_mode", 0.75), (None, None, None, None, "unknown", 0.3), ("other", "9", "TEMP", "Кабинет", "room_temperature", 0.8),
]
UNITS = [("z3k_radio_sensor", "dbm", "dBm"), ("z3k_boiler_adapter", "fr", "l/min"), ("z3k_boiler_adapter", "rors", "°C"), ("z3k_boiler_adapter", "x", None), ("z3k_temperature", "value", "°C"), ("a", "boiler_work_time", "s"), ("a", "duty", "%"), ("a", "Flame", "state"), ("a", None, None)]


def test_roles(spark):
    df = spark.createDataFrame([(k, *r[:4]) for k, r in enumerate(ROLES)], "id int, source string, entity string, metric string, name string")
    got = {r["id"]: (r["role"], r["confidence"]) for r in naming.roles(df).collect()}
    assert got == {k: r[4:] for k, r in enumerate(ROLES)}


def test_units_and_setpoints(spark):
    df = spark.createDataFrame([(k, *r[:2]) for k, r in enumerate(UNITS)], "id int, source string, metric string")
    assert {r["id"]: r["unit"] for r in naming.units(df).collect()} == {k: r[2] for k, r in enumerate(UNITS)}
    pairs = [("z3k_heating_circuit", "target_temp", True), ("z3k_heating_circuit", "status", False), ("z3k_boiler_adapter", "cs", True), ("z3k_radio_sensor", "cs", False)]
    df = spark.createDataFrame([p[:2] for p in pairs], "source string, metric string")
    assert sorted(tuple(r) for r in naming.setpoints(df).collect()) == sorted(pairs)


@pytest.mark.parametrize("rank", [1, -1])
def test_own_rules(spark, rank):
    """Rules are the caller's to change; the least rank wins."""
    table = naming.rules(spark).union(spark.createDataFrame([(rank * 1000, "role", "*", "*", "pool", "", "pool_temperature", 0.7)], naming.rules(spark).schema))
    df = spark.createDataFrame([("x", "1", "temp", "Pool")], "source string, entity string, metric string, name string")
    assert naming.roles(df, table).first()["role"] == ("temperature" if rank > 0 else "pool_temperature")


def test_empty(spark):
    assert naming.roles(spark.createDataFrame([], "source string, entity string, metric string, name string")).collect() == []


def test_one_task_does_not_gather_the_series(spark):
    """Rules for any source and metric concern every series: they come to the rows."""
    from pyspark.sql import functions as F

    df = spark.range(20_000).select(F.lit("s").alias("source"), F.col("id").cast("string").alias("entity"), F.lit("m").alias("metric"), F.lit("Room").alias("name"))
    df = df.repartition(8).withColumn("at", F.spark_partition_id())
    moved = naming.roles(df).where(F.col("at") != F.spark_partition_id())
    assert moved.count() == 0 and naming.roles(df).where("role = 'unknown'").count() == 20_000


def test_resolved_roles_stay_with_their_rows(spark):
    from pyspark.sql import functions as F

    df = spark.range(5_000).select("id", F.lit("s").alias("source"), F.col("id").cast("string").alias("entity"), F.lit("temp").alias("metric"), F.lit("Room").alias("name"))
    df = df.repartition(6).withColumn("at", F.spark_partition_id())
    found = naming.resolved(F.when(F.col("id") % 4 == 1, F.lit("linked")), F.when(F.col("id") % 6 == 1, F.lit("set")), F.lit(True))
    rows = naming.roles(df).select((F.col("at") != F.spark_partition_id()).alias("moved"), found.alias("x"))
    got = {r["x"]["provenance"]: (r["n"], r["moved"]) for r in rows.groupBy("x").agg(F.count("*").alias("n"), F.max("moved").alias("moved")).collect()}
    assert got == {"config": (834, False), "link": (833, False), "heuristic": (3333, False)}
