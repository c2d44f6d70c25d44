import pytest

from lacewing.plans import streams


def test_state_is_in_as_many_parts_as_cores_ask_for(spark, monkeypatch):
    """Every part opens a store and a worker in each batch; there were as many as a shuffle has."""
    seen = []

    def stop(stream, mode, session):
        seen.append(session.conf.get("spark.sql.shuffle.partitions"))
        raise InterruptedError

    monkeypatch.setattr(streams, "_done", stop)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(InterruptedError):
        streams.stream_attempt_log(spark, "/root/testdata/sf0.001")
    assert seen == [str(2 * spark.sparkContext.defaultParallelism)] and spark.conf.get("spark.sql.shuffle.partitions") == before
