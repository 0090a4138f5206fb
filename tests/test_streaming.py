import datetime as dt

from vinculum.operators.references import PARENT, REFERENCE, OrphanState
from vinculum.streaming import patterns as S

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "record_id string, sender string, recipient string, ts timestamp"


def run(spark, path, rows, f, name):
    for k, part in enumerate(rows):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    q = f(stream).writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return {tuple(r) for r in spark.table(name).collect()}


def test_chains_and_intake(spark, tmp_path):
    h = lambda x: T0 + dt.timedelta(hours=x)
    rows = [[("1", "A", "B", h(0)), ("9", "X", "X", h(0))], [("2", "B", "C", h(48)), ("3", "B", "D", h(49))], [("1", "A", "B", h(0))]]
    got = run(spark, str(tmp_path / "a"), rows[:2], S.rapid_chains, "chains")
    assert got == {("A", "B", "C", "1", "2")}
    once = run(spark, str(tmp_path / "b"), rows, lambda s: S.distinct_records(s, "ts", "record_id", "30 days"), "once")
    assert len(once) == 4


def test_orphans_by_micro_batches(spark):
    refs = spark.createDataFrame([("t", 1, "f", "a", T0)], REFERENCE)
    parents = spark.createDataFrame([("a", T0, None)], PARENT)
    tracker = S.OrphanTracker(OrphanState.empty(spark), lambda b: (refs, parents.limit(0)) if b.count() == 1 else (refs.limit(0), parents))
    tracker(spark.range(1), 0)
    assert tracker.state.orphans().count() == 1
    tracker(spark.range(2), 0)
    assert tracker.state.orphans().count() == 1
    tracker(spark.range(2), 1)
    assert tracker.state.orphans().count() == 0
