"""Queries over events of larger tables: numbers beyond those of the given ones."""

import duckdb
import pytest

import __spark_entry__


def differences(spark, name: str, events, folder) -> tuple[int, int]:
    """Rows that a query has over these events and its SQL has not, and the other way."""
    events.write.mode("overwrite").parquet(f"{folder}/events.parquet")
    got = __spark_entry__.queries()[name](spark, str(folder))
    got.write.mode("overwrite").parquet(f"{folder}/got")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    con.execute(f"create view events as from '{folder}/events.parquet/*.parquet'")
    columns = ", ".join(f'"{f}"' for f in got.columns)
    con.execute(f"create table got as select {columns} from '{folder}/got/*.parquet'")
    con.execute(f"create table want as select {columns} from ({__spark_entry__.oracle_sql()[name]})")
    return tuple(con.execute(f"select count(*) from (from {a} except all from {b})").fetchone()[0] for a, b in (("got", "want"), ("want", "got")))


def made(spark, n: int, event_id: str, user_id: str = "id * 7 % 90000"):
    kinds = "element_at(array('view', 'click', 'signup', 'purchase', 'error'), cast(id % 5 + 1 as int))"
    return spark.range(n).selectExpr(f"{event_id} as event_id", "timestamp_micros(1704067200000000 + id * 999983) as ts", f"{user_id} as user_id", f"{kinds} as event_type", "1.5D as value", "concat('{\"k\": ', id * 31 % 100, '}') as props")


@pytest.mark.parametrize("name", ["checksum_validation", "issue_counts"])
def test_wrong_checksums_that_could_be_right(spark, tmp_path, name):
    """Of so many frames with a wrong checksum of 1, it is the right one of some."""
    assert differences(spark, name, made(spark, 200_000, "id * 107"), tmp_path) == (0, 0)


def test_one_wrong_checksum_that_could_be_right(spark, tmp_path):
    event = spark.range(1).selectExpr("2205591L as event_id", "timestamp'2024-01-02 16:33:23' as ts", "33455L as user_id", "'error' as event_type", "1.5D as value", "'{\"k\": 34}' as props")
    for name in ("decode_issues", "fmt_issue", "summary_rows", "json_lines", "describe_capture"):
        assert differences(spark, name, event, tmp_path) == (0, 0)


def test_segments_have_the_numbers_of_their_frames(spark, tmp_path):
    """Sequence numbers wrap after 2,941,758 events; a step of more than half of them counts as one back."""
    events = made(spark, 4000, "id * 9973", "id % 7").filter("event_type <> 'signup'")
    assert differences(spark, "reassembled_segments", events, tmp_path) == (0, 0)


@pytest.mark.parametrize("name", ["http_messages", "reassembled_overlaps"])
def test_users_of_one_port(spark, tmp_path, name):
    """Users whose numbers differ by 16384 have the same port, and a conversation each."""
    events = made(spark, 600, "id", "id % 7 + 16384 * (id % 3)")
    assert differences(spark, name, events, tmp_path) == (0, 0)
