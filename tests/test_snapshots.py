import random

from tidescan.operators.snapshots import diff_snapshots, ordinal_dictionary

ROWS = "snapshot_id string, file_path string, line_start int, vuln_type string, severity string, cvss_score double"
SNAPS = "scope string, snapshot_id string, snap int, last_snap int"
KEY, ATTRS = ["file_path", "line_start", "vuln_type"], ["severity", "cvss_score"]


def brute(rows, snaps):
    by = {}
    for s, f, line, v, sev, c in rows:
        k = by.setdefault(s, {})
        k[(f, line, v)] = min(k.get((f, line, v), (sev, c)), (sev, c), key=str)
    out = set()
    for scope, sid, n, _ in snaps:
        before = [x[1] for x in snaps if x[0] == scope and x[2] == n - 1]
        if not before:
            continue
        a, b = by.get(before[0], {}), by.get(sid, {})
        out |= {(sid, *k, "added") for k in b.keys() - a.keys()} | {(sid, *k, "removed") for k in a.keys() - b.keys()}
        out |= {(sid, *k, "changed") for k in a.keys() & b.keys() if a[k] != b[k]}
    return out


def run(spark, rows, snaps):
    out = diff_snapshots(spark.createDataFrame(rows, ROWS), spark.createDataFrame(snaps, SNAPS), KEY, ATTRS)
    return {tuple(r) for r in out.select("snapshot_id", *KEY, "change_kind").collect()}


def test_against_brute_force_with_nulls_and_empty_snapshots(spark):
    rng = random.Random(3)
    snaps = [("a", f"a{i}", i, 4) for i in range(1, 5)] + [("b", f"b{i}", i, 3) for i in range(1, 4)] + [("c", "c1", 1, 1)]
    rows = []
    for _, sid, _, _ in snaps:
        if sid in ("a3", "b2"):
            continue
        for k in range(200):
            if rng.random() < 0.6:
                rows.append((sid, f"{sid[0]}/f{k % 7}" if k % 9 else None, k, rng.choice(["x"]), rng.choice(["high", None]), rng.choice([1.0, None])))
    rows.append(("unknown", "z", 1, "x", None, None))
    assert run(spark, rows, snaps) == brute(rows, snaps)


def test_empty_tables(spark):
    assert run(spark, [], [("a", "a1", 1, 2), ("a", "a2", 2, 2)]) == set()


def test_ordinals_persist(spark):
    first = ordinal_dictionary(spark.createDataFrame([("a",), ("b",), ("b",)], "k string"), ["k"])
    more = ordinal_dictionary(spark.createDataFrame([("b",), ("c",), (None,)], "k string"), ["k"], first)
    old = {r.k: r.ordinal for r in first.collect()}
    new = {r.k: r.ordinal for r in more.collect()}
    assert all(new[k] == v for k, v in old.items()) and set(new) == {"a", "b", "c", None} and len(set(new.values())) == 4
