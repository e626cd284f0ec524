"""Streams with their own state per key (T2-T5): conversations, breakers, dead letters, stuck tasks.

All fold their rows in event-time order with typed state and timers (``ordered``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billspark.functions.fixed_values import STUCK_FACTOR
from billspark.operators.breaker import NAMES, TIMELINE, Breaker
from billspark.streaming.ordered import fold_in_order

IDLE_MS = 30 * 60 * 1000
#: Failures of an operation that end in ERROR, and the events that count as one.
MAX_FAILURES, FAILURES = 3, ("failure", "fatal")
#: Silence after which a breaker begins anew, and how long an end mark waits for its start.
FORGET_S, KEEP_END_S = 30 * 24 * 3600.0, 3600.0

# ---- fixed values: (event) -> new state; None as the old state means from any state ---------------
CHAT_TRANSITIONS = {
    (None, "new"): "COLLECTING_CUSTOMER",
    (None, "upload"): "AWAITING_DOCUMENT",
    ("AWAITING_DOCUMENT", "document"): "CONFIRMING_EXTRACTED_DATA",
    ("CONFIRMING_EXTRACTED_DATA", "confirm_data"): "REVIEWING",
    ("CONFIRMING_EXTRACTED_DATA", "edit_data"): "COLLECTING_CUSTOMER",
    ("COLLECTING_CUSTOMER", "text"): "COLLECTING_ITEMS",
    ("COLLECTING_ITEMS", "finish_items"): "COLLECTING_NOTES",
    ("COLLECTING_NOTES", "text"): "REVIEWING",
    ("REVIEWING", "add_item"): "COLLECTING_ITEMS",
    ("REVIEWING", "format"): "COMPLETED",
    (None, "cancel"): "IDLE",
}
# ---- fixed values: the question order of the 27-state form ------------------------------------------
FORM_STATES = [
    "SELECT_MODE", "UPLOAD_DOCUMENT", "CONFIRM_EXTRACTED", "CONTRACTOR_NAME", "CONTRACTOR_ADDRESS",
    "CONTRACTOR_EMAIL", "CONTRACTOR_UTR", "CONTRACTOR_NI", "CONTRACTOR_BANK", "CONTRACTOR_SORT",
    "CONTRACTOR_CARDHOLDER", "INVOICE_NUMBER", "INVOICE_DATE", "WORK_START_DATE", "WORK_END_DATE",
    "ADD_WORK_ITEM", "WORK_PROPERTY", "WORK_PLOT", "WORK_DESCRIPTION", "WORK_AMOUNT",
    "MORE_WORK_ITEMS", "OPERATIVE_NAMES", "SUBTOTAL", "VAT_AMOUNT", "CIS_AMOUNT", "CONFIRM_SUMMARY",
]
FORM_TRANSITIONS = {
    (None, "start"): "SELECT_MODE", (None, "cancel"): "IDLE",
    ("SELECT_MODE", "upload"): "UPLOAD_DOCUMENT", ("SELECT_MODE", "chat"): "CONTRACTOR_NAME",
    ("UPLOAD_DOCUMENT", "document"): "CONFIRM_EXTRACTED",
    ("CONFIRM_EXTRACTED", "confirm_data"): "CONFIRM_SUMMARY",
    ("CONFIRM_EXTRACTED", "manual_entry"): "CONTRACTOR_NAME",
    ("CONFIRM_EXTRACTED", "retry_upload"): "UPLOAD_DOCUMENT",
    ("ADD_WORK_ITEM", "add_work"): "WORK_PROPERTY", ("ADD_WORK_ITEM", "skip_work"): "OPERATIVE_NAMES",
    ("MORE_WORK_ITEMS", "more_work"): "WORK_PROPERTY", ("MORE_WORK_ITEMS", "done_work"): "OPERATIVE_NAMES",
    ("CONFIRM_SUMMARY", "confirm_all"): "COMPLETED", ("CONFIRM_SUMMARY", "edit_data"): "CONTRACTOR_NAME",
    ("CONFIRM_SUMMARY", "cancel_all"): "IDLE",
    **{
        (a, "answer"): b
        for a, b in zip(FORM_STATES[3:15] + FORM_STATES[16:20] + FORM_STATES[21:25],
                        FORM_STATES[4:16] + FORM_STATES[17:21] + FORM_STATES[22:26])
    },
}
ENDED = ("IDLE", "COMPLETED")


def conversation_state(
    events: DataFrame, transitions: dict | None = None, idle_ms: int = IDLE_MS,
    watermark: str = "10 minutes", max_failures: int = MAX_FAILURES,
) -> DataFrame:
    """State changes per user, in event-time order whatever the triggers.

    ``events``: user_id, ts, event_id, event. An event without a rule for the state leaves it as it is. A
    ``failure`` counts, an event with a rule starts the count anew; ``max_failures`` of them, or one
    ``fatal``, lead to ERROR, which any rule from any state leaves. A silence longer than ``idle_ms``
    ends the conversation by a timer. An idle conversation leaves nothing in the state; a completed one leaves that it is,
    since the user's next change begins there.
    """
    table, idle = transitions or CHAT_TRANSITIONS, idle_ms * 1000

    def fold(key, state, rows, until):
        now, last, failures = state or ("IDLE", 0, 0)
        out = []
        for at, _, event in rows:
            if now not in ENDED and at - last > idle:
                out.append((key, last + idle, "timeout", now, "IDLE"))
                now, failures = "IDLE", 0
            new = table.get((now, event), table.get((None, event)))
            if new is not None:
                failures = 0
            elif event in FAILURES and now not in ENDED:
                failures += 1
                new = "ERROR" if event == "fatal" or failures >= max_failures else now
            else:
                new = now
            if new != now:
                out.append((key, at, event, now, new))
            now, last = new, at
        if now not in ENDED and last + idle <= until:
            out.append((key, last + idle, "timeout", now, "IDLE"))
            now = "IDLE"
        if now == "IDLE":
            return None, out, None
        return (now, last, failures), out, None if now in ENDED else last + idle

    found = fold_in_order(
        events, "user_id", "at bigint, event_id bigint, event string", "state string, last bigint, failures int",
        "user_id bigint, at bigint, event string, old_state string, new_state string", fold, watermark,
    )
    return found.select("user_id", F.timestamp_micros("at").alias("ts"), "event", "old_state", "new_state")


def breaker_stream(
    outcomes: DataFrame, machine=None, watermark: str = "10 minutes", forget_s: float = FORGET_S
) -> DataFrame:
    """The breaker timeline on a stream, in event-time order whatever the triggers.

    ``outcomes``: service, ts, event_id, ok and, where there are manual orders, ``action`` (``force_open``,
    ``force_close``). A service without a call for ``forget_s`` begins anew; one that is closed without
    failures, as at its beginning, is not kept at all.
    """
    machine, forget = machine or Breaker(), int(forget_s * 1_000_000)
    start = machine.start()

    def fold(key, state, rows, until):
        now, last = (start, None) if state is None else (tuple(v for v in state[:3] if v is not None), state[3])
        out = []
        for at, event_id, ok, action in rows:
            if last is not None and at - last > forget:
                now = start
            before = NAMES[now[0]]
            now, allowed, changed = machine.step(now, at, action if action is not None else bool(ok))
            out.append((key, at, event_id, ok, allowed, before, NAMES[now[0]], changed))
            last = at
        if now == start or last is None or last + forget <= until:
            return None, out, None
        return (*now, *[None] * (3 - len(now)), last), out, last + forget

    action = F.col("action") if "action" in outcomes.columns else F.lit(None)
    found = fold_in_order(
        outcomes.withColumn("action", action.cast("string")), "service",
        "at bigint, event_id bigint, ok boolean, action string", "kind string, a bigint, b bigint, last bigint",
        TIMELINE.replace("ts timestamp", "at bigint"), fold, watermark,
    )
    return found.withColumn("at", F.timestamp_micros("at")).withColumnRenamed("at", "ts")


def stuck_task_watch(marks: DataFrame, watermark: str = "10 minutes", keep_end_s: float = KEEP_END_S) -> DataFrame:
    """A start without an end by 1.5 times the timeout gives a recovered row.

    ``marks``: task_id, task_type, ts, mark ('start' or 'end'), timeout_s. A start that is delivered again while its
    task runs changes nothing. An end without a start (its start may carry a later time, or the task
    was recovered already) is kept for ``keep_end_s`` and answers a start within that time. Nothing stays in the state after.
    """
    keep = int(keep_end_s * 1_000_000)

    def fold(key, state, rows, until):
        kind, due, ended = state or (None, None, None)
        out = []
        for at, order, task_type, timeout_s in rows:
            if due is not None and at > due:
                out.append((key, kind, due))
                due = None
            if order:
                due, ended = (None, None) if due is not None else (None, at)
            elif ended is not None and at - ended <= keep:
                ended = None
            elif due is None:
                kind, due, ended = task_type, at + int(timeout_s * STUCK_FACTOR * 1000) * 1000, None
        if due is not None and due <= until:
            out.append((key, kind, due))
            due = None
        if due is not None:
            return (kind, due, None), out, due
        if ended is not None and ended + keep > until:
            return (None, None, ended), out, ended + keep
        return None, out, None

    found = fold_in_order(
        marks.withColumn("order", (F.col("mark") != "start").cast("int")), "task_id",
        "at bigint, order int, task_type string, timeout_s double", "kind string, due bigint, ended bigint",
        "task_id bigint, task_type string, due bigint", fold, watermark,
    )
    return found.select("task_id", "task_type", F.timestamp_micros("due").alias("recovered_at"))


def dlq_stream(
    items: DataFrame, handler: Callable[[str, int], bool], watermark: str = "10 minutes",
    base_s: int = 60, max_s: int = 3600,
) -> DataFrame:
    """Due items tried again with growing delay until they succeed or their retries are used up.

    ``items``: id, ts, payload, max_retries. ``handler(payload, attempt)`` tells whether it worked;
    the failure of the last allowed retry ends the item. All tries that fall due by the watermark
    are made in order, however far the watermark jumps. Each row of an id is an entry of its own: rows
    that come while others wait join them.
    """

    def fold(key, state, rows, until):
        waiting = [list(entry) for entry in zip(*state)] if state else []
        waiting += [[0, at // 1000, payload, limit] for at, payload, limit in rows]
        out, left = [], []
        for attempt, due, payload, limit in waiting:
            done = False
            while due * 1000 <= until and not done:
                if handler(payload, attempt):
                    action, done = "success", True
                elif attempt + 1 < limit:
                    action = "scheduled_retry"
                else:
                    action, done = "failed", True
                out.append((key, attempt, due, action))
                due += min(base_s * 2**attempt, max_s) * 1000
                attempt += 1
            if not done:
                left.append((attempt, due, payload, limit))
        if not left:
            return None, out, None
        return tuple(map(list, zip(*left))), out, min(entry[1] for entry in left) * 1000

    kind, of = (items.schema[c].dataType.simpleString() for c in ("id", "payload"))
    found = fold_in_order(
        # the watermark counts whole milliseconds, so an entry is due from its millisecond on
        items.withColumn("ts", F.date_trunc("millisecond", "ts")).withColumn("max_retries", F.col("max_retries").cast("int")), "id",
        f"at bigint, payload {of}, max_retries int", f"attempts array<int>, dues array<bigint>, payloads array<{of}>, limits array<int>",
        f"id {kind}, attempt int, due bigint, action string", fold, watermark,
    )
    return found.select("id", "attempt", F.timestamp_millis("due").alias("ts"), "action")
