"""Imports as a state machine: transitions, stuck imports and restarts."""

from datetime import datetime, timedelta

from codestrata.streaming import machine

SCHEMA = "import_id long, event_id long, at timestamp, stage string"


def test_states_survive_restarts(spark, tmp_path):
    day = datetime(2024, 1, 1)
    at = lambda hours: day + timedelta(hours=hours)
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")

    def run(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        out = machine.run_available(spark, spark.readStream.schema(SCHEMA).parquet(source), folder)
        return {r.import_id: (r.status, r.attempts, r.accepted, r.rejected, r.stuck) for r in machine.imports(out).collect()}, out

    first, _ = run([
        (1, 2, at(1), "validating"), (1, 1, at(0), "queued"),  # out of order within a batch
        (2, 3, at(0), "queued"), (2, 4, at(1), "completed"), (2, 5, at(2), "validating"), (2, 6, at(3), "extracting"), (2, 7, at(4), "completed"), (2, 8, at(5), "queued"), (2, 9, at(6), "failed"),
        (3, 10, at(0), "cloning"), (None, 11, at(0), "queued"), (4, 12, None, "queued"), (4, 13, at(0), None),
    ])
    assert first == {1: ("validating", 1, 2, 0, 0), 2: ("failed", 2, 6, 1, 0), 3: (None, 0, 0, 1, 0)}
    # a later event of another import moves the watermark: the timer of import 1 fires; import 3 begins
    second, out = run([(3, 14, at(40), "queued"), (3, 15, at(70), "validating")])
    assert second[1] == ("failed", 1, 2, 0, 1) and second[2] == first[2]
    assert second[3] == ("failed", 1, 1, 2, 1)  # silent for over a day, so what came after is not allowed
    stuck = {r.import_id: r.at for r in out.filter("verdict = 'stuck'").collect()}
    assert stuck == {1: at(25), 3: at(64)}
    third, _ = run([(1, 16, at(80), "queued")])
    assert third[1] == ("queued", 2, 3, 0, 1) and third[3] == second[3]
