"""The streaming forms, run as streams over several files, against their batch forms."""

import pytest

from tidemark import streaming


@pytest.fixture(scope="module")
def arrived(spark, sf, tmp_path_factory):
    """Events that come in four files, out of order between files."""
    path = str(tmp_path_factory.mktemp("events") / "in")
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(4, "event_id").write.parquet(path)
    return events, path


def result(stream, mode, name, folder):
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(folder / "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None and len(query.recentProgress) >= 4
    return stream.sparkSession.table(name)


@pytest.mark.parametrize("name", ["sliding", "sessions", "bars"])
def test_streams_converge_to_their_batch_forms(spark, arrived, tmp_path, name):
    events, path = arrived
    form = streaming.VIEWS[name]
    got = result(form(streaming.read(spark, path, events.schema), late="90 days"), "complete", f"as_{name}", tmp_path)
    want = form(events)
    assert want.count() > 10 and got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_stream_deduplication(spark, arrived, tmp_path):
    events, _ = arrived
    path = str(tmp_path / "twice")
    events.unionByName(events.limit(50)).repartition(4).write.parquet(path)
    got = result(streaming.deduplicated(streaming.read(spark, path, events.schema), late="90 days"), "append", "once_each", tmp_path)
    assert got.count() == events.select("event_id").distinct().count() == got.select("event_id").distinct().count()


def test_appends_are_idempotent(spark, arrived, tmp_path):
    events, _ = arrived
    keyed = events.selectExpr("CAST(event_id AS STRING) AS unique_key", "value")
    append = streaming.append_new(str(tmp_path / "log"))
    first = keyed.limit(40).persist()
    for batch in (first, first, keyed, keyed.unionByName(keyed)):
        append(batch, 0)
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == keyed.count() == log.select("unique_key").distinct().count()
