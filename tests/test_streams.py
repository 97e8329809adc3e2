"""Streams into state: restarts between any two steps, events out of order, retention, and counters that replays leave alone."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from triagemill.operators import state
from triagemill.operators import triage as T
from triagemill.scratch import cut_counted
from triagemill.streaming import feedback, ingest

MAIL = "Subject: New jobs\nContent-Type: text/html; charset=utf-8\n\n<html><body>{}</body></html>\n"


def mail(folder: Path, name: str, numbers) -> None:
    folder.mkdir(exist_ok=True)
    links = "".join(f'<p><a href="https://jobs.danfoss.com/job/{n}">Engineer {n}</a></p>' for n in numbers)
    (folder / f"{name}.eml").write_text(MAIL.format(links))


def state_of(spark, table):
    return sorted((r.position_link.rsplit("/", 1)[1], r.title) for r in state.read_buckets(spark, table).collect())


class Killed(Exception):
    pass


@pytest.mark.parametrize("killed", ["staging", "applying", "after"])
def test_a_stream_cut_short_counts_each_posting_once(spark, tmp_path, killed, monkeypatch):
    folder, table, staged, checkpoint = (tmp_path / n for n in ("in", "jobs", "staged", "checkpoint"))
    table.mkdir()
    args = (spark, str(folder), str(table), str(staged), str(checkpoint), 8)
    mail(folder, "a", range(5))
    ingest.follow(*args).awaitTermination()
    mail(folder, "b", range(3, 9))
    mail(folder, "c", [8, 20])

    def broken(spark, path, changed, buckets):
        if killed != "applying":
            state.apply_changes(spark, path, changed, buckets)
        raise Killed

    if killed == "staging":
        monkeypatch.setattr(state, "counted", lambda *a: (_ for _ in ()).throw(Killed()))
        broken = state.apply_changes
    query = ingest.follow(*args, apply=broken)
    with pytest.raises(Exception, match="Killed"):
        query.awaitTermination()
    monkeypatch.undo()
    if killed != "staging":
        # What is staged needs its files no more.
        (folder / "b.eml").unlink()
    ingest.follow(*args, delete=True).awaitTermination()
    assert state_of(spark, str(table)) == sorted((str(n), f"Engineer {n}") for n in [*range(9), 20])
    counts = {Path(r.file).stem: (r.found, r.inserted_new, r.skipped_existing) for r in ingest.counts(spark, str(staged)).collect()}
    assert counts == {"a": (5, 5, 0), "b": (6, 4, 2), "c": (2, 1, 1)}
    assert sorted(p.name for p in folder.glob("*.eml")) == ["a.eml"]
    ids = [r.id for r in state.read_buckets(spark, str(table)).collect()]
    assert sorted(ids) == list(range(1, 11))


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


LOG = "job_id long, ts timestamp, event_id long, event string"


def feed(spark, folder, name, rows):
    frame = spark.createDataFrame([(j, t, i, e) for j, t, i, e in rows], "job_id long, t string, event_id long, event string").withColumn("ts", F.to_timestamp("t")).select("job_id", "ts", "event_id", "event")
    frame.coalesce(1).write.mode("append").parquet(str(folder))


def test_feedback_out_of_order_and_its_retention(spark, tmp_path, rocks):
    folder, checkpoint, out = tmp_path / "log", str(tmp_path / "checkpoint"), []
    feed(spark, folder, "0", [(1, "2024-01-02 10:00:00", 5, "viewed_off"), (2, "2024-01-01 10:00:00", 1, "applied_on")])

    def run():
        log = spark.readStream.schema(LOG).parquet(str(folder))
        keep = lambda batch, number: out.extend(batch.collect())
        feedback.keep_feedback(log, late="10 days").writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    run()
    # Late ones, a tie by event number, and a restart between.
    feed(spark, folder, "1", [(1, "2024-01-02 09:00:00", 9, "viewed_on"), (1, "2024-01-02 10:00:00", 6, "relevant"), (2, "2024-01-01 10:00:00", 2, "not_relevant"), (3, "2024-01-01 12:00:00", 3, "viewed_on")])
    run()
    last = {r.job_id: (r.viewed, r.applied, r.relevant, r.category, r.relevance_reason) for r in out}
    folded = T.fold_feedback(spark.read.parquet(str(folder)))
    assert last == {r.job_id: (r.viewed, r.applied, r.relevant, r.category, r.relevance_reason) for r in folded.collect()}
    # An event months later moves the watermark past the others' retention.
    feed(spark, folder, "2", [(7, "2024-06-01 00:00:00", 20, "viewed_on")])
    run()
    feed(spark, folder, "3", [(7, "2024-06-01 01:00:00", 21, "applied_on")])
    run()
    assert {r.job_id for r in out if r.expired} == {1, 2, 3}
    feed(spark, folder, "4", [(1, "2024-06-02 00:00:00", 22, "applied_off")])
    run()
    fresh = [r for r in out if r.job_id == 1][-1]
    assert (fresh.viewed, fresh.applied, fresh.relevant, fresh.expired) == (0, 0, 0, False)


def test_learning_again_adds_nothing(spark, tmp_path):
    folder, checkpoint, out = str(tmp_path / "found"), str(tmp_path / "checkpoint"), {}
    frame = lambda rows: spark.createDataFrame(rows, "job_id long, t string, skill string, weight long").withColumn("ts", F.to_timestamp("t")).drop("t")

    def run():
        stream = spark.readStream.schema("job_id long, skill string, weight long, ts timestamp").parquet(folder)
        keep = lambda batch, number: out.update({r.skill: (r.occurrences, r.weight) for r in batch.collect()})
        feedback.learned_counts(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    first = [(1, "2024-01-01", "sql", 3), (1, "2024-01-02", "sql", 3), (2, "2024-01-01", "sql", 1), (2, "2024-01-01", "rust", 1)]
    frame(first).write.mode("append").parquet(folder)
    run()
    frame([*first, (3, "2024-01-03", "rust", 3)]).write.mode("append").parquet(folder)
    run()
    assert out == {"sql": (2, 4), "rust": (2, 4)}


def test_progress_is_what_was_counted_anyway(spark, tmp_path):
    import time

    table, said = tmp_path / "jobs", []
    table.mkdir()
    listener = ingest.Progress(said.append)
    spark.streams.addListener(listener)
    try:
        mail(tmp_path / "in", "a", range(3))
        mail(tmp_path / "in", "b", range(2))
        ingest.follow(spark, str(tmp_path / "in"), str(table), str(tmp_path / "staged"), str(tmp_path / "checkpoint"), 4, files=1).awaitTermination()
        for _ in range(50):
            if len(said) >= 2:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert [s.split(",")[0] for s in said] == ["batch 0: 1 files", "batch 1: 1 files"]
    rows, seen = cut_counted(spark.range(10), n=F.count("*"), most=F.max("id"))
    assert seen == {"n": 10, "most": 9} and rows.count() == 10
