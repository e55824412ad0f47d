"""Every reference query against its SQL on the smallest tables, and the driver's contract."""

import datetime
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tripwise.plans import oracle
from tripwise.plans.oracle import ORACLES
from tripwise.plans.queries import QUERIES
from tripwise.streaming import trips as streamed

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    found = db.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    want = [tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall()]
    assert sorted(got) == sorted(want)
    assert got, "a query without rows says nothing"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_the_machine_takes_every_branch(sf):
    """Counted in the SQL's own steps: openings, closings too short to count, cool-downs, drops in warm-up, events and ends of video."""
    d = f"/root/testdata/sf{sf}"
    if not Path(d).exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet'")
    count = lambda sql: con.execute(sql).fetchone()[0]
    steps = f"WITH RECURSIVE {oracle.machine()} SELECT count(*) FROM fsm"
    limited = f"WITH RECURSIVE {oracle.machine('WHERE ms < 2200', 1000, f'CASE WHEN n >= 56 THEN 56 ELSE {oracle.EOF} END')} SELECT count(*)"
    free = f"WITH RECURSIVE {oracle.machine('WHERE ms < 2200', 0, f'CASE WHEN n >= 56 THEN 56 ELSE {oracle.EOF} END')} SELECT count(*)"
    assert count(f"{steps} WHERE a AND shown = 'IDLE'") > 5  # opened
    assert count(f"{steps} WHERE t IS NOT NULL") > 5  # events
    assert count(f"{steps} WHERE a AND shown = 'ACTIVE'") > 5  # held open
    assert count(f"{steps} WHERE NOT a AND frame - l = 2 AND e >= 0.55") > 0  # not opened: still cooling down
    flushed = count(f"WITH RECURSIVE {oracle.machine()} SELECT count(*) FROM found") - count(f"{steps} WHERE t IS NOT NULL")
    assert flushed > 0
    assert 0 < count(f"{limited} FROM found") < count(f"{free} FROM found")  # some dropped in warm-up


def test_stream_equals_batch(spark):
    live = {(r.detection_id, r.t_start_ms, r.events_count) for r in QUERIES["trips_stream"](spark, SF).collect()}
    batch = {(r.detection_id, r.t_start_ms, r.events_count) for r in QUERIES["trips_time_only"](spark, SF).collect()}
    assert live == batch


def test_throttled_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(1, t) for t in (0, 500, 900, 1200, 1700, 3000)] + [(2, 10)]
    spark.createDataFrame(rows, "camera_id long, t_ms long").coalesce(1).write.parquet(f"{tmp_path}/in")
    ticks = spark.readStream.schema("camera_id long, t_ms long").parquet(f"{tmp_path}/in")
    q = streamed.throttled_stream(ticks, 701).writeStream.format("memory").queryName("beats").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(tuple(r) for r in spark.table("beats").collect()) == [(1, 0), (1, 900), (1, 1700), (1, 3000), (2, 10)]
