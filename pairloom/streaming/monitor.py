"""Training-log monitor: batch tables and a stateful stream.

A log line is (run_id, attempt, line_no, ts, line) with `line_no` counting 0, 1, 2... within an
attempt. "A pattern occurs in the last n lines" then means "the highest matching line number
is above last_line - n", so every status is a function of a few maxima. Maxima combine before a
shuffle, so a run holding a third of all lines costs one small row per task, and they do not
change when a line is delivered twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pairloom.functions.text import contains_any, parse_progress
from pairloom.schema import require_columns
from pairloom.streaming.rules import (
    BASE_PARAMETERS,
    CORRECTED_RULES,
    ERROR_MESSAGES,
    MAX_CONSECUTIVE_ERRORS,
    MESSAGE_CHARS,
    MESSAGE_RULE,
    POLL_SECONDS,
    PROGRESS_CHARS,
    RECOVERY_OVERRIDES,
    Rule,
    RuleSet,
)

RUN = ["run_id", "attempt"]
BLANKS = " \t\n\r\x0b\x0c"
LOG_COLUMNS = [*RUN, "line_no", "ts", "line"]


def _all_rules(rules: RuleSet) -> tuple[Rule, ...]:
    return (*rules.complete, *rules.errors, MESSAGE_RULE)


def _hit(rule: Rule, line: Column) -> Column:
    return contains_any(line, rule.any_case, False) | contains_any(line, rule.exact, True)


def log_rules(lines: DataFrame, rules: RuleSet = CORRECTED_RULES) -> DataFrame:
    """Add one boolean `is_<rule>` per rule to every line."""
    require_columns(lines, LOG_COLUMNS, "log")
    return lines.withColumns(
        {f"is_{rule.name}": _hit(rule, F.col("line")) for rule in _all_rules(rules)}
    )


def log_progress(lines: DataFrame) -> DataFrame:
    """Progress lines with the epoch, loss and percent they report."""
    parsed = parse_progress("line")
    return lines.withColumns(parsed).where(
        F.col("is_progress") | F.col("epoch").isNotNull() | F.col("train_loss").isNotNull()
    )


def log_tail(lines: DataFrame, n: int) -> DataFrame:
    """The last n lines of every attempt.

    Spark limits each group before the shuffle, so one task never sees a whole long log.
    """
    newest = W.partitionBy(*RUN).orderBy(F.col("line_no").desc())
    return (
        lines.withColumn("from_end", F.row_number().over(newest)).where(F.col("from_end") <= n)
    )


def _last(name: str) -> str:
    return f"last_{name}"


def _short_texts(flagged: DataFrame) -> DataFrame:
    """Add the message a line would give and its progress text, null where it has none."""
    text = F.btrim("line", F.lit(BLANKS))
    return flagged.withColumns(
        {
            "message_text": F.when(F.col("is_message"), F.substring(text, 1, MESSAGE_CHARS)),
            "progress": F.when(text.contains("Training:"), F.right(text, F.lit(PROGRESS_CHARS))),
        }
    )


def _line_maxima(lines: DataFrame, rules: RuleSet, keys: list[str]) -> DataFrame:
    """Per group: last line, newest hit of every rule, newest message and last progress text.

    Texts are cut to what a status shows before they are grouped: Spark sorts the rows of an
    aggregate that keeps strings, and short rows keep that sort cheap.
    """
    flagged = _short_texts(log_rules(lines, rules)).drop("line")
    hits = [
        F.max(F.when(F.col(f"is_{rule.name}"), F.col("line_no"))).alias(_last(rule.name))
        for rule in _all_rules(rules)
    ]
    said = F.when(F.col("message_text").isNotNull(), F.col("line_no"))
    return flagged.groupBy(*keys).agg(
        F.max("line_no").alias("last_line"),
        F.max("ts").alias("last_ts"),
        *hits,
        F.max_by("message_text", said).alias("message_text"),
        F.max_by("progress", "line_no").alias("progress"),
    )


def _within(rule: Rule) -> Column:
    return F.coalesce(
        F.col(_last(rule.name)) > F.col("last_line") - F.lit(rule.lines), F.lit(False)
    )


def _with_status(maxima: DataFrame, rules: RuleSet) -> DataFrame:
    """Status with the precedence complete, error, running."""
    is_complete = F.lit(False)
    for rule in rules.complete:
        is_complete = is_complete | _within(rule)
    error_type = F.lit(None).cast("string")
    for rule in reversed(rules.errors):
        hit = _within(rule) & (_within(MESSAGE_RULE) if rule.name == "general" else F.lit(True))
        error_type = F.when(hit, F.lit(rule.name)).otherwise(error_type)
    message = F.lit(None).cast("string")
    for rule in rules.errors:
        text = F.lit(ERROR_MESSAGES[rule.name])
        if rule.name == "general":
            text = F.concat(text, F.col("message_text"))
        message = F.when(F.col("error_type") == rule.name, text).otherwise(message)
    return (
        maxima.withColumn("is_complete", is_complete)
        .withColumn("error_type", error_type)
        .withColumn("error_message", message)
        .withColumn(
            "status",
            F.when(F.col("is_complete"), F.lit("complete"))
            .when(F.col("error_type").isNotNull(), F.lit("error"))
            .otherwise(F.lit("running")),
        )
    )


def log_status(lines: DataFrame, rules: RuleSet = CORRECTED_RULES) -> DataFrame:
    """Status of every attempt at the end of its log."""
    return _with_status(_line_maxima(lines, rules, RUN), rules).select(
        *RUN, "last_line", "status", "error_type", "error_message", "progress"
    )


def log_complete(lines: DataFrame, rules: RuleSet = CORRECTED_RULES) -> DataFrame:
    """Whether every attempt has completed, by its last lines."""
    return _with_status(_line_maxima(lines, rules, RUN), rules).select(*RUN, "is_complete")


def log_errors(lines: DataFrame, rules: RuleSet = CORRECTED_RULES) -> DataFrame:
    """First matching error class of every attempt with one, and its message."""
    return (
        _with_status(_line_maxima(lines, rules, RUN), rules)
        .where(F.col("error_type").isNotNull())
        .select(*RUN, "error_type", "error_message")
    )


def poll_number(ts: Column | str, seconds: int = POLL_SECONDS) -> Column:
    """The poll that first sees a line: its time in whole poll intervals."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_timestamp(ts.cast("timestamp")) / seconds).cast("bigint")


def poll_status(
    lines: DataFrame, rules: RuleSet = CORRECTED_RULES, poll_seconds: int = POLL_SECONDS,
) -> DataFrame:
    """Status of every attempt as of each poll that saw new lines.

    The lines are reduced to one row per poll first; the running maxima then go over polls,
    whose number is bounded by the run's duration, not by its lines.
    """
    polled = lines.withColumn("poll", poll_number("ts", poll_seconds))
    maxima = _line_maxima(polled, rules, [*RUN, "poll"])
    so_far = (
        W.partitionBy(*RUN).orderBy("poll").rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    running = {
        name: F.max(name).over(so_far)
        for name in ["last_line", "last_ts", *[_last(r.name) for r in _all_rules(rules)]]
    }
    running["message_text"] = F.last("message_text", ignorenulls=True).over(so_far)
    return _with_status(maxima.withColumns(running), rules)


def error_streaks(statuses: DataFrame, max_errors: int = MAX_CONSECUTIVE_ERRORS) -> DataFrame:
    """Number the consecutive error polls of each attempt: (.., poll, status, streak, halted)."""
    by_poll = W.partitionBy(*RUN).orderBy("poll")
    so_far = by_poll.rowsBetween(W.unboundedPreceding, W.currentRow)
    numbered = statuses.withColumn("_position", F.row_number().over(by_poll))
    healthy = F.when(F.col("status") != "error", F.col("_position"))
    return (
        numbered.withColumn("_healthy", F.coalesce(F.max(healthy).over(so_far), F.lit(0)))
        .withColumn("streak", (F.col("_position") - F.col("_healthy")).cast("int"))
        .withColumn("halted", F.col("streak") >= max_errors)
        .drop("_position", "_healthy")
    )


def _action() -> Column:
    return (
        F.when(F.col("status") == "complete", F.lit("evaluate"))
        .when((F.col("status") == "error") & F.col("halted"), F.lit("halt"))
        .when(F.col("status") == "error", F.lit("recover"))
        .when(F.col("status") == "missing", F.lit("restart"))
        .otherwise(F.lit("none"))
    )


def monitor_batch(
    lines: DataFrame, rules: RuleSet = CORRECTED_RULES, poll_seconds: int = POLL_SECONDS,
    max_errors: int = MAX_CONSECUTIVE_ERRORS,
) -> DataFrame:
    """The monitor's status rows for a finished log, poll by poll.

    An attempt is followed until its first `complete` poll or its `max_errors`-th error in
    a row; later polls are not reported.
    """
    tracked = error_streaks(poll_status(lines, rules, poll_seconds), max_errors)
    whole = W.partitionBy(*RUN).orderBy("poll").rowsBetween(
        W.unboundedPreceding, W.unboundedFollowing
    )
    stop = F.min(F.when((F.col("status") == "complete") | F.col("halted"), F.col("poll")))
    return (
        tracked.withColumn("_stop", stop.over(whole))
        .where(F.col("_stop").isNull() | (F.col("poll") <= F.col("_stop")))
        .withColumn("action", _action())
        .withColumn("seen_at", F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss"))
        .withColumn("seen_epoch", F.unix_timestamp(F.col("last_ts").cast("timestamp")))
        .select(
            *RUN, "poll", "last_line", "seen_at", "seen_epoch", "status", "error_type",
            "error_message", "progress", "streak", "action",
        )
    )


def missing_runs(statuses: DataFrame, as_of: Column, silence_seconds: int = POLL_SECONDS) -> DataFrame:
    """Runs whose newest attempt is neither complete nor halted and has been silent too long by
    `as_of`; attempts that a newer one has replaced say nothing."""
    ended = (F.col("status") == "complete") | (F.col("action") == "halt")
    attempts = statuses.groupBy(*RUN).agg(
        F.max(ended).alias("ended"), F.max("seen_epoch").alias("seen_epoch")
    )
    newest = attempts.groupBy("run_id").agg(
        *[F.max_by(c, "attempt").alias(c) for c in ("ended", "seen_epoch")],
        F.max("attempt").alias("attempt"),
    )
    return (
        newest.where(~F.col("ended"))
        .withColumn("silent_seconds", F.unix_timestamp(as_of.cast("timestamp")) - F.col("seen_epoch"))
        .where(F.col("silent_seconds") > silence_seconds)
        .select(*RUN, "silent_seconds", F.lit("missing").alias("status"), F.lit("restart").alias("action"))
    )


def strategy_table(spark, strategies: dict[str, dict[str, str]] | None = None) -> DataFrame:
    strategies = RECOVERY_OVERRIDES if strategies is None else strategies
    return spark.createDataFrame(
        list(strategies.items()), "error_type string, overrides map<string,string>"
    )


def with_parameters(
    rows: DataFrame, strategies: DataFrame | None = None, base: dict[str, str] | None = None,
) -> DataFrame:
    """Add `overrides` and `parameters`: the base map with the overrides of the row's error
    type. A type without a strategy changes nothing.
    """
    base = BASE_PARAMETERS if base is None else base
    if strategies is None:
        strategies = strategy_table(rows.sparkSession)
    base_map = F.create_map(*[F.lit(x) for item in base.items() for x in item])
    overrides = F.coalesce("overrides", F.create_map().cast("map<string,string>"))
    kept = F.map_filter(base_map, lambda k, v: ~F.map_contains_key(F.col("overrides"), k))
    # One row per error type: the strategy table is a constant, not data.
    return (
        rows.join(F.broadcast(strategies), "error_type", "left")
        .withColumn("overrides", overrides)
        .withColumn("parameters", F.map_concat(kept, F.col("overrides")))
    )


def recovery_plan(
    statuses: DataFrame, strategies: DataFrame | None = None,
    base: dict[str, str] | None = None,
) -> DataFrame:
    """The parameters to restart each attempt in error with. Only rows are produced."""
    return with_parameters(statuses.where(F.col("status") == "error"), strategies, base)


_MAXIMA_TYPES = "last_line long, last_ts timestamp, message_text string, progress string"


def _partial_schema(names: list[str]) -> T.StructType:
    hits = ", ".join(f"{name} long" for name in names)
    return T._parse_datatype_string(f"run_id string, attempt int, {_MAXIMA_TYPES}, {hits}")


# A line number below any window: keeps the state free of nulls.
NEVER = -(1 << 40)

OUTPUT_SCHEMA = (
    "run_id string, attempt int, poll long, last_line long, last_ts timestamp, status string, "
    "error_type string, error_message string, progress string, streak int, action string"
)


def _combine(frame: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    """One row per attempt: maxima, and the texts of the newest lines that have them."""
    grouped = frame.groupby(RUN, sort=False)
    out = grouped[["last_line", "last_ts", *names]].max()
    newest = frame.loc[grouped["last_line"].idxmax()].set_index(RUN)
    said = frame[frame["message_text"].notna()]
    said = said.loc[said.groupby(RUN, sort=False)[_last("message")].idxmax()].set_index(RUN)
    out["progress"] = newest["progress"]
    out["message_text"] = said["message_text"].reindex(out.index)
    return out.reset_index()


def _decide(state: dict, rules: RuleSet) -> tuple[str, str | None, str | None]:
    """Status, error type and message of one run's maxima."""

    def within(rule: Rule) -> bool:
        return state[_last(rule.name)] > state["last_line"] - rule.lines

    if any(within(rule) for rule in rules.complete):
        status = "complete"
    else:
        status = "running"
    for rule in rules.errors:
        if within(rule) and (rule.name != "general" or within(MESSAGE_RULE)):
            text = ERROR_MESSAGES[rule.name]
            if rule.name == "general":
                text += state["message_text"]
            return ("error" if status == "running" else status), rule.name, text
    return status, None, None


def monitor_stream(
    lines: DataFrame, rules: RuleSet = CORRECTED_RULES,
    silence_seconds: int | None = POLL_SECONDS, max_errors: int = MAX_CONSECUTIVE_ERRORS,
    forget_seconds: int | None = None,
) -> DataFrame:
    """Streaming twin of `monitor_batch`: one row per run and trigger with new lines.

    Each Arrow batch is reduced to one row per attempt before the shuffle, and the state of
    a run is one row of maxima whatever the length of its log. Only the newest attempt of a
    run speaks: a newer one replaces what is known of the run, lines of older ones are left
    out. A trigger counts as a poll only if it raises one of the run's maxima: lines that are
    delivered again change nothing, while an error line that comes after lines written later
    (rolled logs) is a poll of its own, in error if it lies within its rule's last lines. No
    state per line is needed for this, and a line may be late by any time.

    A run that stays silent for `silence_seconds` gets one `missing` row per silence. After
    completion or halt nothing more is reported of that attempt: what stays is a marker
    (attempt and last line, one small row per run), so late lines never open a finished run
    again. Markers and the states of missing runs stay for good, or for `forget_seconds`
    without lines; after that a late line of theirs is taken for a new run. A stream that
    is to end (`availableNow`) needs `silence_seconds=None`, as Spark goes on running triggers
    while it waits for timeouts.
    """
    names = [_last(rule.name) for rule in _all_rules(rules)]
    partial = _partial_schema(names)
    slim = _short_texts(log_rules(lines, rules)).select(
        *RUN,
        F.col("line_no").alias("last_line"),
        F.col("ts").cast("timestamp").alias("last_ts"),
        "message_text",
        "progress",
        *[
            F.when(F.col(f"is_{rule.name}"), F.col("line_no"))
            .otherwise(F.lit(NEVER))
            .alias(_last(rule.name))
            for rule in _all_rules(rules)
        ],
    )
    columns = [field.name for field in partial.fields]

    def reduce_batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield _combine(frame, names)[columns]

    state_schema = T.StructType(
        [
            *[f for f in partial.fields if f.name != "run_id"],
            T.StructField("poll", T.LongType()),
            T.StructField("streak", T.IntegerType()),
            T.StructField("ended", T.BooleanType()),
            T.StructField("missing", T.BooleanType()),
        ]
    )
    state_names = [field.name for field in state_schema.fields]

    def plain(value):
        if value is None or pd.isna(value):
            return None
        return value.to_pydatetime() if isinstance(value, pd.Timestamp) else value

    longs = {f.name for f in state_schema.fields if isinstance(f.dataType, T.LongType)}

    def keep(state: GroupState, values: dict) -> None:
        found = [plain(values[name]) for name in state_names]
        state.update(
            tuple(int(v) if n in longs and v is not None else v for n, v in zip(state_names, found))
        )
        wait(state, values["ended"] or values["missing"])

    def wait(state: GroupState, quiet: bool) -> None:
        # a timeout holds for one call only, so every call sets it anew
        seconds = forget_seconds if quiet else silence_seconds
        if silence_seconds is not None and seconds is not None:
            state.setTimeoutDuration(seconds * 1000)

    def marker(values: dict) -> dict:
        """What is kept of an attempt that has ended."""
        return {**values, **dict.fromkeys(names, NEVER), "message_text": None, "progress": None}

    def track(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = dict(zip(state_names, state.get)) if state.exists else None
        out = {"run_id": key[0]}
        if state.hasTimedOut:
            if before is None or before["ended"] or before["missing"]:
                state.remove()
                return
            keep(state, {**before, "missing": True})
            yield pd.DataFrame([
                {**out, "attempt": before["attempt"], "poll": before["poll"],
                 "last_line": before["last_line"],
                 "last_ts": before["last_ts"], "status": "missing", "error_type": None,
                 "error_message": None, "progress": None, "streak": before["streak"],
                 "action": "restart"}
            ])
            return
        found = pd.concat([frame for frame in frames if len(frame)], ignore_index=True)
        attempt = int(found["attempt"].max())
        if before is not None and attempt > before["attempt"]:
            before = None
        if before is not None:
            attempt = before["attempt"]
        found = found[found["attempt"] == attempt]
        if before is not None and (before["ended"] or not len(found)):
            wait(state, before["ended"] or before["missing"])
            return
        parts = [found]
        if before is not None:
            parts.append(pd.DataFrame([{**out, **{c: before[c] for c in state_names if c in columns}}]))
        merged = _combine(pd.concat(parts, ignore_index=True), names).iloc[0].to_dict()
        if before is not None and all(merged[c] <= before[c] for c in ("last_line", *names)):
            keep(state, {**before, **{c: merged[c] for c in columns if c in state_names}})
            return
        status, error_type, message = _decide(merged, rules)
        poll = (before["poll"] if before else 0) + 1
        streak = (before["streak"] if before else 0) + 1 if status == "error" else 0
        halted = status == "error" and streak >= max_errors
        action = {
            "complete": "evaluate", "error": "halt" if halted else "recover", "running": "none",
        }[status]
        ended = status == "complete" or halted
        merged.update(poll=poll, streak=streak, ended=ended, missing=False, attempt=attempt)
        keep(state, marker(merged) if ended else merged)
        yield pd.DataFrame([
            {**out, "attempt": attempt, "poll": poll, "last_line": merged["last_line"],
             "last_ts": merged["last_ts"],
             "status": status, "error_type": error_type, "error_message": message,
             "progress": plain(merged["progress"]),
             "streak": streak, "action": action}
        ])

    timeout = GroupStateTimeout.NoTimeout
    if silence_seconds is not None:
        timeout = GroupStateTimeout.ProcessingTimeTimeout
    return (
        slim.mapInPandas(reduce_batches, partial)
        .groupBy("run_id")
        .applyInPandasWithState(track, OUTPUT_SCHEMA, state_schema, "append", timeout)
    )


def write_monitor(
    statuses: DataFrame, status_path: str, action_path: str, checkpoint: str,
    available_now: bool = False, poll_seconds: int = POLL_SECONDS,
    strategies: DataFrame | None = None, base: dict[str, str] | None = None,
):
    """Start the status sink and the action sink of a monitor stream.

    Each trigger overwrites its own folder, so a trigger that runs again after a failure
    leaves the same rows. Actions (evaluate, recover, halt, restart) are rows to act upon;
    the two that start training again carry its parameters.
    """
    starts = F.col("action").isin("recover", "restart")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        batch.write.mode("overwrite").parquet(f"{status_path}/trigger={batch_id}")
        actions = with_parameters(batch.where(F.col("action") != "none"), strategies, base)
        actions.drop("overrides").withColumn(
            "parameters", F.when(starts, F.col("parameters"))
        ).write.mode("overwrite").parquet(f"{action_path}/trigger={batch_id}")
        batch.unpersist()

    writer = statuses.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{poll_seconds} seconds").start()
