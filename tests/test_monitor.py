import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from pairloom.plans import views
from pairloom.schema import LOG_SCHEMA
from pairloom.session import shared_path
from pairloom.sources.files import read_log, stream_log
from pairloom.streaming import monitor
from pairloom.streaming.rules import CORRECTED_RULES, REFERENCE_RULES

START = dt.datetime(2024, 1, 1)


def log(spark, texts, run="r", attempt=0, first=0, minute=0):
    rows = [
        (run, attempt, first + i, START + dt.timedelta(minutes=minute, seconds=i), text)
        for i, text in enumerate(texts)
    ]
    return spark.createDataFrame(rows, LOG_SCHEMA)


def status(spark, texts, rules=CORRECTED_RULES):
    return monitor.log_status(log(spark, texts), rules).first()


@pytest.mark.parametrize(
    "texts,rules,expected",
    [
        (["RuntimeError: CUDA out of memory"], CORRECTED_RULES, "gpu_memory"),
        (["CUDA error: device lost"], CORRECTED_RULES, "cuda"),
        (["cuda error: device lost"], REFERENCE_RULES, "gpu_memory"),
        (["NVML gone"], REFERENCE_RULES, None),
        (["NVML gone"], CORRECTED_RULES, "gpu_memory"),
        (["cuda driver error 3"], REFERENCE_RULES, "cuda"),
        (["ModuleNotFoundError: x"], REFERENCE_RULES, "general"),
        (["ModuleNotFoundError: x"], CORRECTED_RULES, "import"),
        (["an Import Error"], REFERENCE_RULES, "import"),
        (["Traceback (most recent call last)"], CORRECTED_RULES, None),
        (["bad Exception"] + ["ok"] * 49, CORRECTED_RULES, "general"),
        (["bad Exception"] + ["ok"] * 50, CORRECTED_RULES, None),
        (["CUDA out of memory"] + ["ok"] * 199, CORRECTED_RULES, "gpu_memory"),
        (["CUDA out of memory"] + ["ok"] * 200, CORRECTED_RULES, None),
    ],
)
def test_error_classes(spark, texts, rules, expected):
    assert status(spark, texts, rules)["error_type"] == expected


def test_completion_comes_before_errors(spark):
    texts = ["ValueError exception", "학습 완료!"]
    assert status(spark, texts)["status"] == "complete"
    assert status(spark, texts + ["ok"] * 99)["status"] == "complete"
    assert status(spark, texts + ["ok"] * 100)["status"] == "running"
    assert status(spark, ["Training: 100%"])["status"] == "running"
    assert status(spark, ["Training: 100%"], REFERENCE_RULES)["status"] == "complete"
    assert status(spark, ["Training: 100%"] + ["ok"] * 10, REFERENCE_RULES)["status"] == "running"


def test_message_and_progress_are_cut(spark):
    row = status(spark, ["  first error " + "x" * 200, "second Error here  "])
    assert row["error_message"] == "에러 감지: second Error here"
    row = status(spark, ["error " + "y" * 200])
    assert row["error_message"] == "에러 감지: " + ("error " + "y" * 200)[:100]
    row = status(spark, ["Training: " + "z" * 200])
    assert row["progress"] == ("Training: " + "z" * 200)[-80:]


def test_missing_text_is_no_hit(spark):
    assert status(spark, [None, "ok"])["status"] == "running"


def test_streaks_and_stop(spark):
    polls = [(p, s) for p, s in enumerate(["running", "error", "error", "running", "error", "error", "error", "error"])]
    frame = spark.createDataFrame([("r", 0, p, s) for p, s in polls], "run_id string, attempt int, poll long, status string")
    rows = monitor.error_streaks(frame).orderBy("poll").collect()
    assert [r["streak"] for r in rows] == [0, 1, 2, 0, 1, 2, 3, 4]
    assert [r["halted"] for r in rows] == [False] * 6 + [True, True]


def polled_log(spark):
    """Three runs over five polls of one minute: an error streak, a completion, a recovery."""
    parts = []
    for minute in range(5):
        bad = ["RuntimeError: CUDA out of memory"] if minute == 1 else []
        parts.append(log(spark, [*bad, "ok", "Training: 5%"], "bad", 0, 10 * minute, minute))
        done = ["saved model"] if minute == 2 else []
        parts.append(log(spark, ["ok", *done], "done", 0, 10 * minute, minute))
        noisy = ["an error"] if minute == 0 else ["ok"] * 60
        parts.append(log(spark, noisy, "noisy", 1, 100 * minute, minute))
    return parts


def test_batch_monitor_follows_each_run_to_its_end(spark):
    table = None
    for part in polled_log(spark):
        table = part if table is None else table.unionByName(part)
    rows = monitor.monitor_batch(table, poll_seconds=60).orderBy("run_id", "poll").collect()
    seen = {run: [(r["status"], r["action"]) for r in rows if r["run_id"] == run] for run in ("bad", "done", "noisy")}
    assert seen["bad"] == [("running", "none"), ("error", "recover"), ("error", "recover"), ("error", "halt")]
    assert seen["done"] == [("running", "none"), ("running", "none"), ("complete", "evaluate")]
    assert seen["noisy"] == [("error", "recover")] + [("running", "none")] * 4
    plan = monitor.recovery_plan(monitor.monitor_batch(table, poll_seconds=60)).collect()
    bad = [r for r in plan if r["error_type"] == "gpu_memory"]
    assert bad and all(r["parameters"]["batch_size"] == "1" and r["parameters"]["K"] == "4" for r in bad)
    other = [r for r in plan if r["error_type"] == "general"]
    assert other and all(r["parameters"]["batch_size"] == "2" for r in other)


def run_stream(spark, source, out, files=None):
    statuses = monitor.monitor_stream(
        stream_log(spark, source, files_per_trigger=files), silence_seconds=None
    )
    monitor.write_monitor(
        statuses, f"{out}/status", f"{out}/actions", f"{out}/state", available_now=True
    ).awaitTermination()
    return spark.read.parquet(f"{out}/status")


COMPARED = ["run_id", "attempt", "last_line", "status", "error_type", "error_message", "progress", "streak", "action"]


def test_stream_equals_batch_and_restarts(spark):
    source, out = shared_path(spark, "polls"), shared_path(spark, "polls-out")
    parts = polled_log(spark)
    for minute in range(5):
        group = parts[3 * minute].unionByName(parts[3 * minute + 1]).unionByName(parts[3 * minute + 2])
        group.coalesce(1).write.mode("append").parquet(source)
        # One poll per start: every later start resumes from the checkpoint.
        found = run_stream(spark, source, out)
    batch = monitor.monitor_batch(read_log(spark, source), poll_seconds=60)
    assert sorted(found.select(*COMPARED).collect(), key=str) == sorted(
        batch.select(*COMPARED).collect(), key=str
    )
    actions = spark.read.parquet(f"{out}/actions")
    assert actions.where("action = 'evaluate'").count() == 1
    assert actions.where("action = 'none'").count() == 0
    for r in actions.collect():
        assert (r["parameters"] is not None) == (r["action"] == "recover")
        if r["error_type"] == "gpu_memory" and r["action"] == "recover":
            assert r["parameters"]["K"] == "4" and r["parameters"]["tau"] == "0.2"


def test_stream_ignores_lines_delivered_twice(spark):
    lines = log(spark, ["ok", "an error", "Training: 3%"])
    once, twice = shared_path(spark, "once"), shared_path(spark, "twice")
    lines.write.parquet(once)
    lines.unionByName(lines).repartition(4).write.parquet(twice)
    a = run_stream(spark, once, shared_path(spark, "o1")).select(*COMPARED).collect()
    b = run_stream(spark, twice, shared_path(spark, "o2")).select(*COMPARED).collect()
    assert a == b


def deliver(spark, source, out, batches):
    """Each batch of lines as files of its own and a start of the stream of its own."""
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(source)
        found = run_stream(spark, source, out)
    rows = found.orderBy("trigger").collect()
    return [(r["run_id"], r["attempt"], r["status"], r["action"], r["streak"]) for r in rows]


def test_same_lines_in_several_triggers_count_once(spark):
    bad = log(spark, ["RuntimeError: CUDA out of memory"])
    rows = deliver(spark, shared_path(spark, "again"), shared_path(spark, "again-out"), [bad] * 3)
    assert rows == [("r", 0, "error", "recover", 1)]


def test_late_lines_do_not_reopen_a_finished_run(spark):
    done, late = log(spark, ["ok", "saved model"]), log(spark, ["Training: 9%"], first=7)
    rows = deliver(spark, shared_path(spark, "late"), shared_path(spark, "late-out"), [done, late, late])
    assert rows == [("r", 0, "complete", "evaluate", 0)]


def test_late_error_lines_are_a_poll_of_their_own(spark):
    seen = log(spark, ["ok"] * 3, first=10)
    late, older = log(spark, ["RuntimeError: CUDA out of memory"], first=5), log(spark, ["ok"], first=2)
    rows = deliver(spark, shared_path(spark, "rolled"), shared_path(spark, "rolled-out"), [seen, late, late, older, seen])
    assert rows == [("r", 0, "running", "none", 0), ("r", 0, "error", "recover", 1)]


def test_late_error_lines_beyond_their_window_change_no_status(spark):
    seen = log(spark, ["ok"], first=5000)
    late = log(spark, ["RuntimeError: CUDA out of memory"], first=5)
    rows = deliver(spark, shared_path(spark, "far"), shared_path(spark, "far-out"), [seen, late])
    assert {r[2] for r in rows} == {"running"}


def test_ended_runs_are_never_opened_again(spark):
    source, out = shared_path(spark, "ended"), shared_path(spark, "ended-out")
    log(spark, ["ok", "saved model"]).coalesce(1).write.parquet(source)
    statuses = monitor.monitor_stream(stream_log(spark, source), silence_seconds=1)
    query = monitor.write_monitor(statuses, f"{out}/status", f"{out}/actions", f"{out}/state", poll_seconds=1)
    try:
        def wait(check):
            for _ in range(60):
                time.sleep(1)
                if check():
                    return
        wait(lambda: len(query.recentProgress) > 2)
        time.sleep(6)  # many silences
        log(spark, ["Training: 9%"], first=7).coalesce(1).write.mode("append").parquet(source)
        before = len(query.recentProgress)
        wait(lambda: sum(p["numInputRows"] for p in query.recentProgress) >= 3)
        wait(lambda: len(query.recentProgress) > before + 4)
    finally:
        query.stop()
    rows = spark.read.parquet(f"{out}/status").collect()
    assert [(r["run_id"], r["status"], r["action"]) for r in rows] == [("r", "complete", "evaluate")]


def test_only_the_newest_attempt_speaks(spark):
    old, new = log(spark, ["an error"]), log(spark, ["ok"], attempt=1)
    both = old.unionByName(log(spark, ["saved model"], attempt=1, first=5))
    rows = deliver(spark, shared_path(spark, "new"), shared_path(spark, "new-out"), [old, new, both])
    assert rows == [
        ("r", 0, "error", "recover", 1), ("r", 1, "running", "none", 0), ("r", 1, "complete", "evaluate", 0),
    ]


def test_silence_is_reported_once_and_states_are_forgotten(spark):
    source, out = shared_path(spark, "silent"), shared_path(spark, "silent-out")
    log(spark, ["ok", "ok"]).unionByName(log(spark, ["saved model"], "done")).unionByName(
        log(spark, ["ok"], "old").unionByName(log(spark, ["saved model"], "old", 1))
    ).write.parquet(source)
    statuses = monitor.monitor_stream(
        stream_log(spark, source), silence_seconds=1, forget_seconds=4
    )
    query = monitor.write_monitor(
        statuses, f"{out}/status", f"{out}/actions", f"{out}/state", poll_seconds=1
    )
    left = None
    try:
        for _ in range(60):
            time.sleep(1)
            progress = query.lastProgress
            operators = progress["stateOperators"] if progress else []
            left = operators[0]["numRowsTotal"] if operators else left
            if left == 0 and len(query.recentProgress) > 3:
                break
    finally:
        query.stop()
    rows = spark.read.parquet(f"{out}/actions").collect()
    assert sorted((r["run_id"], r["attempt"], r["action"]) for r in rows) == [
        ("done", 0, "evaluate"), ("old", 1, "evaluate"), ("r", 0, "restart"),
    ]
    assert left == 0


def test_white_space_around_messages_is_cut(spark):
    row = status(spark, ["\t an error \r", "\x0b\x0c Training: 3%\r\t"])
    assert row["error_message"] == "에러 감지: an error" and row["progress"] == "Training: 3%"


def test_replaced_attempts_are_not_missing(spark):
    lines = log(spark, ["ok"], "quiet").unionByName(log(spark, ["saved model"], "quiet", 1, minute=3))
    lines = lines.unionByName(log(spark, ["saved model"], "back")).unionByName(log(spark, ["ok"], "back", 1, minute=2))
    late = F.lit("2024-01-01 01:00:00").cast("timestamp")
    found = monitor.missing_runs(monitor.monitor_batch(lines, poll_seconds=60), late, 60).collect()
    assert [(r["run_id"], r["attempt"]) for r in found] == [("back", 1)]


def test_missing_runs_in_batch(spark):
    rows = monitor.monitor_batch(log(spark, ["ok"], "quiet"), poll_seconds=60)
    late = F.lit("2024-01-01 01:00:00").cast("timestamp")
    assert [r["run_id"] for r in monitor.missing_runs(rows, late, 60).collect()] == ["quiet"]
    assert monitor.missing_runs(rows, late, 7200).count() == 0


def test_tail_limits_groups_before_the_shuffle(spark, sf_dir):
    plan = monitor.log_tail(views.log_lines(spark, sf_dir), 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
