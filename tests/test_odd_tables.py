"""Queries against their SQL on tables with values that the given ones lack."""

import duckdb
import pytest
from oracle_check import compare, load_entry

from tidewheel.operators.aggregates import profile_summary

ENTRY = load_entry()
QUERIES, ORACLES = ENTRY.queries(), ENTRY.oracle_sql()
SF = "/root/testdata/sf0.01"


def holds(spark, folder, name, **tables):
    """The query over these tables (SQL over the given ones) equals its SQL, which adds rows up in one order on one thread."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'; SET threads=1")
    for table, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    ok, note, _, _ = compare(spark, con, QUERIES[name], ORACLES[name], str(folder))
    assert ok, note


# Part keys past 100,000, of several tables' copies in one order, outweigh a line number; quantities are no whole numbers.
LINES = f"""SELECT l_orderkey, l_partkey + k * 150000 AS l_partkey, l_suppkey, l_linenumber, CASE WHEN l_partkey % 31 = 0 THEN NULL ELSE l_quantity * (1 + k * 0.0137) END AS l_quantity,
 l_extendedprice, l_discount, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_tax / (1 + k * 997) END AS l_tax, l_returnflag, l_linestatus, l_shipdate FROM '{SF}/lineitem.parquet', range(0, 3) r(k) WHERE l_orderkey < 3000"""


@pytest.mark.parametrize("name", ["key_signatures", "log_measurements"])
def test_lines_with_large_keys_and_broken_quantities(spark, tmp_path, name):
    holds(spark, tmp_path, name, lineitem=LINES)


@pytest.mark.parametrize("name", ["profile_summary", "profile_split"])
def test_sums_halfway_between_rounded_values(spark, tmp_path, name):
    """Of cents over 7, one sum in seventy lies halfway between two tenths."""
    holds(spark, tmp_path, name, events="SELECT * FROM '/root/testdata/sf0.1/events.parquet' ORDER BY event_id")


def test_a_line_without_a_quantity_is_a_silent_sample(spark, tmp_path):
    holds(spark, tmp_path, "lined_up_stems", lineitem=LINES)


ODD = "[NULL, 'NaN'::DOUBLE, 'inf'::DOUBLE, '-inf'::DOUBLE, 1e307, -1e308, 1e22, 1.5e-7, 12345678.9, -3.5, 33.02]"


def test_logs_of_numbers_that_are_not_finite_or_too_large_to_be_scaled(spark, tmp_path):
    holds(spark, tmp_path, "log_measurements", lineitem=f"""SELECT * REPLACE ({ODD}[1 + l_partkey % 11] AS l_quantity, {ODD}[1 + l_suppkey % 11] AS l_tax, CASE WHEN l_partkey % 13 > 0 THEN l_linenumber END AS l_linenumber)
     FROM '{SF}/lineitem.parquet' WHERE l_orderkey < 3000""")


@pytest.mark.parametrize("name", ["profile_summary", "profile_split"])
def test_profiles_of_events_without_kind_or_value(spark, tmp_path, name):
    """Of a user's events some have no kind, those of one kind no value; others no number, an id twice or none."""
    holds(spark, tmp_path, name, events=f"""SELECT * REPLACE (CASE WHEN event_id % 47 = 0 THEN NULL WHEN event_id % 59 = 0 THEN 'other' ELSE event_type END AS event_type,
     CASE WHEN event_id % 53 > 0 THEN user_id END AS user_id, CASE WHEN user_id % 11 = 0 AND event_type = 'click' THEN NULL WHEN user_id % 13 = 0 THEN {ODD}[1 + event_id % 11] ELSE value END AS value)
     FROM '{SF}/events.parquet' ORDER BY event_id""")


def test_calls_without_a_kind_can_be_named(spark):
    calls = spark.createDataFrame([("a", 1, None, 2.0), ("a", 2, "other", 1.0), ("a", 3, "mix", None)], "k string, i long, kind string, ms double")
    got = [[tuple(r)[1:] for r in profile_summary(calls, ["k"], "kind", "ms", "i", unnamed).orderBy("place").collect()] for unnamed in (None, "other")]
    assert got == [[(None, 1, 2.0, 1), ("other", 1, 1.0, 2), ("mix", 1, None, 3)], [("other", 2, 3.0, 1), ("mix", 1, None, 2)]]
