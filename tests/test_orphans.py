from datetime import datetime

from tidescan.operators.orphans import current_orphans, orphan_events

REFS = "child_table string, child_id string, parent_table string, ref string, first_seen timestamp_ntz, period string"
PARENTS = "parent_table string, parent_id string, parent_seen timestamp_ntz, period string, deleted_in string"


def at(month, day=1):
    return datetime(2025, month, day)


def ref(child, to, month, day=1):
    return ("f", child, "r", to, at(month, day), f"2025-{month:02d}")


def parent(pid, month, day=1, gone=None):
    return ("r", pid, at(month, day), f"2025-{month:02d}", gone)


def states(spark, refs, parents):
    events = orphan_events(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS))
    return {r.child_id: r.ref_state for r in current_orphans(events).collect()}


def test_waiting_resolving_and_reopening(spark):
    refs = [ref("ok", "p1", 2), ref("missing", "nowhere", 1), ref("late_same_month", "p2", 2, 1), ref("late_next", "p3", 1), ref("gone", "p4", 1), ref("late_then_gone", "p5", 1), ref("after_gone", "p4", 4)]
    parents = [parent("p1", 1), parent("p2", 2, 9), parent("p3", 3), parent("p4", 1, 1, "2025-03"), parent("p5", 2, 1, "2025-04")]
    assert states(spark, refs, parents) == {
        "missing": "missing", "late_same_month": "late", "late_next": "late", "gone": "deleted", "late_then_gone": "deleted", "after_gone": "deleted",
    }


def test_empty(spark):
    assert states(spark, [], []) == {}
    assert states(spark, [ref("a", "x", 1)], []) == {"a": "missing"}


def test_a_second_call_goes_on_from_the_stored_state(spark, tmp_path):
    early = [ref("ok", "p1", 2), ref("missing", "nowhere", 1), ref("late", "p3", 1), ref("gone", "p4", 1)] + [ref(f"hot{k}", "p5", 1) for k in range(50)]
    later = [ref("new", "p3", 4), ref("new_gone", "p4", 4)]
    first, second = [parent("p1", 1), parent("p4", 1)], [parent("p3", 3), parent("p5", 4), ("r", "p4", at(1), "2025-03", "2025-03")]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    state = str(tmp_path / "state")
    assert {r.event for r in orphan_events(frame(early, REFS), frame(first, PARENTS), state).collect()} == {"pending"}
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "state").rglob("*.parquet")}
    events = orphan_events(frame(later, REFS), frame(second, PARENTS), state, after="2025-02")
    assert {r.child_id: r.ref_state for r in current_orphans(events).collect()} == {"missing": "missing", "late": "late", "gone": "deleted", "new_gone": "deleted"} | {f"hot{k}": "late" for k in range(50)}
    assert {p: p.stat().st_mtime_ns for p in before} == before  # nothing of the earlier periods is written again
    assert {(r.child_id, r.at) for r in events.filter("event in ('late', 'deleted') and child_id not like 'hot%'").collect()} == {("late", "2025-03"), ("gone", "2025-03"), ("new_gone", "2025-04")}
