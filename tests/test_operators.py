from pyspark.sql import functions as F

from tidescan.functions.text import explode_lines
from tidescan.operators import classify, dependencies, routes, secrets, store, sweep, taint
from tidescan.sources.advisories import advisories
from tidescan.sources.files import enumerate_files, manifests
from tidescan.sources.manifests import parse_manifests
from tidescan.sources.rules import builtin_rows, read_rules

CODE = "def f(x):\n    q = request.args.get('n')\n    r = q + 'x'\n    cur.execute(f\"select {r}\")\n"


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, language string, content string")


def test_sweep_excerpt_and_empty(spark):
    out = sweep.candidates(files(spark, [("a.py", "python", CODE), ("b.py", "python", None), ("c", None, "")])).collect()
    assert [(r.file_path, r.line_start, r.vuln_type) for r in out] == [("a.py", 4, "sqli")]
    assert ">>>    4 |" in out[0].code_snippet and "       1 | def" in out[0].code_snippet
    assert len({r[2] for r in builtin_rows()}) == len(builtin_rows()) <= 200


def test_rules_from_json(spark, tmp_path):
    (tmp_path / "python_patterns.json").write_text('{"x": [{"id": "p1", "regex": "spam"}, {"id": "p2"}]}')
    rows = [tuple(r) for r in read_rules(spark, str(tmp_path)).collect()]
    assert [(r[0], r[2], r[4], r[5]) for r in rows] == [("python", "p1", "unknown", "possible")]
    assert sweep.sweep_lines(explode_lines(files(spark, [("a", "python", "SPAM")])), rows).count() == 1


def test_secrets_are_masked(spark):
    key = "AKIA" + "Q" * 16
    lines = spark.createDataFrame([(f"k = '{key}'",), (f"# k = '{key}'",), ("k = 'your_api_key_here'",), (None,)], "line string")
    out = secrets.scan_secrets(lines).collect()
    assert {r.secret_type for r in out} == {"aws_access_key"} and all(key not in str(r) for r in out)


def test_taint_orders_and_closure(spark):
    facts = taint.line_facts(explode_lines(files(spark, [("a.py", "python", CODE), ("b.py", "python", "\n".join(reversed(CODE.split("\n"))))])))
    got = {(r.path, r.source_line, r.sink_line, r.sink_type) for r in taint.variable_paths(facts).collect()}
    assert got == {("a.py", 2, 4, "sqli")}
    assert taint.near_paths(facts).count() == 2


def test_taint_by_tree_crosses_calls(spark):
    code = "def g(v):\n    os.system(v)\ndef h():\n    return request.args['a']\nx = h()\ng(x)\ndef k(v):\n    os.system('ls')\n"
    facts = taint.python_facts(files(spark, [("a.py", "python", code), ("bad.py", "python", "def ("), ("n.py", "python", None)]))
    assert {(r.path, r.sink_line, r.sink_type) for r in taint.variable_paths(facts, ordered=False).collect()} == {("a.py", 2, "cmdi")}


def test_manifests_and_audit(spark):
    rows = [
        ("a/requirements.txt", "django==4.0.0\n# x==1\n-r y\n"), ("a/pom.xml", "<artifactId>log4j-core</artifactId>\n<version>2.14.0</version>"), ("b/package.json", '{"dependencies": {"lodash": "^4.17.20"}, "devDependencies": {"x": "1"}}'),
        ("b/broken.json", "{"), ("c/package.json", "{"), ("d/go.sum", "m.x/y v1.0.0 h1:a\nm.x/y v1.1.0 h1:b\n"), ("e/Cargo.toml", '[package]\nname = "n"\n[dependencies]\ntokio = { version = "1.0" }\n[other]\nz = "9"\n'),
    ]
    deps = parse_manifests(spark.createDataFrame(rows, "manifest string, content string"))
    assert {(r.name, r.version) for r in deps.collect()} == {("django", "4.0.0"), ("log4j-core", "2.14.0"), ("lodash", "4.17.20"), ("x", "1"), ("m.x/y", "1.1.0"), ("tokio", "1.0")}
    found = dependencies.audit(deps, advisories(spark))
    assert {"CVE-2022-28347", "CVE-2021-44228", "CVE-2021-23337"} <= {r.cve for r in found.collect()}
    fetched = spark.createDataFrame([("PyPI", "django", "4.0.0", '[{"id": "G-1", "aliases": ["CVE-1-1"], "database_specific": {"severity": "LOW"}}]')], "ecosystem string, package string, version string, vulns string")
    more = dependencies.enrich(found, dependencies.osv_findings(deps, fetched))
    assert more.filter("cve = 'CVE-1-1' AND severity = 'medium'").count() == 1


def test_files_from_a_tree(spark, tmp_path):
    for name in ("src/a.py", "node_modules/b.js", "tests/test_a.py", "src/x.min.js", ".git/c.py", "pkg/package.json"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x = 1\xff\n")
    assert {r.path for r in enumerate_files(spark, str(tmp_path)).collect()} == {"src/a.py", "pkg/package.json"}
    assert {r.manifest for r in manifests(spark, str(tmp_path)).collect()} == {"pkg/package.json"}


def test_routes_and_nearest(spark):
    src = "@app.route('/a')\n\n\n@app.route('b', methods=['POST'])\n"
    found = routes.extract_routes(explode_lines(files(spark, [("a.py", "python", src)])))
    assert {(r.line, r.path, r.method) for r in found.collect()} == {(1, "/a", "ANY"), (4, "/b", "POST")}
    asks = spark.createDataFrame([("a.py", 2), ("a.py", 4), ("z.py", 1)], "file_path string, line_start int")
    assert {(r.line_start, r.route_path) for r in routes.nearest_routes(asks, found).collect()} == {(2, "/a"), (4, "/b"), (1, None)}


def test_upsert_and_ids(spark):
    schema = "id string, run_id string, file_path string, line_start int, vuln_type string, status string"
    old = spark.createDataFrame([("1", "r", "f", None, "x", "candidate"), ("2", "r", "g", 1, "x", "candidate")], schema)
    new = spark.createDataFrame([("r", "f", None, "x", "confirmed"), ("r", "h", 2, "y", "likely"), ("r", "g", 1, "x", None)], "run_id string, file_path string, line_start int, vuln_type string, status string")
    got = {(r.file_path, r.status, r.id) for r in store.upsert(old, new, ["status"]).collect()}
    assert {(f, s) for f, s, _ in got} == {("f", "confirmed"), ("g", "candidate"), ("h", "likely")} and all(i for _, _, i in got)


def test_evaluation(spark):
    labels = spark.createDataFrame([("a", "sqli"), ("b", "xss"), ("safe", None)], "file string, kind string")
    found = spark.createDataFrame([("a", "sql_injection"), ("a", "odd"), ("safe", "cmdi"), ("other", "xss")], "file string, kind string")
    total = {r.kind: r for r in classify.evaluate(found, labels).collect()}["overall"]
    assert (total.tp, total.fp, total.fn) == (1, 1, 1) and total.f1 == 0.5


def test_reports_hold_every_finding(spark):
    import json

    from tidescan.operators import report

    names = ["run_id", "id", "file_path", "vuln_type", "severity", "confidence", "status", "title", "cwe", "owasp", "code_snippet"]
    more = ["language", "cvss_vector", "description", "taint_source", "taint_sink", "remediation"]
    rows = [("r" if k % 50 else None, f"i{k:04}", "f", f"t{k % 7}", ["low", "critical", None][k % 3], "c", "s", f"T{k:04}.", "", "o", "x") for k in range(1300)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)).selectExpr("*", "1 line_start", "1 line_end", "1.0D cvss_score", *[f"'{n}!' {n}" for n in more])
    docs = [json.loads(r.document) | {"part": r.part_no} for r in report.json_report(df).collect() if r.run_id]
    listed = [f["id"] for d in sorted(docs, key=lambda d: d["part"]) for f in d["findings"]]
    assert all(f[n] == f"{n}!" for d in docs for f in d["findings"] for n in more)
    rank = {"critical": 0, "low": 3, None: 4}
    assert listed == [r[1] for r in sorted((r for r in rows if r[0]), key=lambda r: (rank[r[4]], r[1]))] and {d["summary"]["total"] for d in docs} == {1274}
    sarif = [json.loads(r.document)["runs"][0] for r in report.sarif(df).collect() if r.run_id]
    assert sorted(len(x["results"]) for x in sarif) == [274, 1000] and all(len(x["tool"]["driver"]["rules"]) == 7 for x in sarif)
    for made in (report.markdown, report.html):
        text = "".join(r.document for r in made(df).collect())
        assert all(r[7] in text for r in rows)


def test_stream_of_files(spark, tmp_path):
    from tidescan.streaming.incremental import SCHEMA, scan_arrivals

    spark.createDataFrame([("a.py", "python", 1, False, CODE)], SCHEMA).write.parquet(str(tmp_path / "in"))
    scan_arrivals(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).filter(F.col("vuln_type") == "sqli").count() == 1


def test_data_flow_of_several_names_and_safe_sinks(spark):
    from tidescan.operators import taint as T

    js = ["const { id, name: n } = req.query;", "db.query(n);", "el.innerHTML = DOMPurify.sanitize(id);", "el.innerHTML = id;", "Object.assign({}, n);"]
    go = ["q := r.FormValue(\"x\")", "db.Where(\"a = ?\", q).Exec(q)", "db.Exec(q)"]
    rows = [("a.ts", "typescript", k, s) for k, s in enumerate(js, 1)] + [("b.go", "go", k, s) for k, s in enumerate(go, 1)] + [("c.js", "javascript", 1, None)]
    facts = T.line_facts(spark.createDataFrame(rows, "path string, language string, line_no int, line string"))
    got = {(r.path, r.sink_line, r.sink_type, r.var) for r in T.variable_paths(facts).collect()}
    assert got == {("a.ts", 2, "sqli", "n"), ("a.ts", 4, "xss", "id"), ("a.ts", 5, "proto_pollution", "n"), ("b.go", 3, "sqli", "q")}


def test_lints_imports_and_project_framework(spark):
    from tidescan.operators import lints, routes

    lines = [("a.java", "java", 1, "@CrossOrigin"), ("a.java", "java", 2, '@CrossOrigin(origins = "x")'), ("a.java", "java", 3, '@RequestMapping("/a")'), ("a.java", "java", 4, None), ("b.py", "python", 1, "@CrossOrigin")]
    got = lints.annotation_lints(spark.createDataFrame(lines, "path string, language string, line_no int, line string"))
    assert {(r.line_no, r.annotation) for r in got.collect()} == {(1, "CrossOrigin"), (3, "RequestMapping")}
    files = [("a.go", "go", 'package a\nimport "os"\nimport (\n\tx "os/exec"\n\t"fmt"\n)\nvar s = "no"\n'), ("b.go", "go", None), ("c.go", "go", ""), ("d.py", "python", "from flask import Flask\napp = Flask(__name__)")]
    df = spark.createDataFrame(files, "path string, language string, content string")
    assert {(r.package, r.note) for r in lints.go_imports(df).collect()} == {("os", None), ("os/exec", "runs commands"), ("fmt", None)}
    assert routes.project_framework(df) == "flask" and routes.project_framework(df.filter("language = 'go'")) is None


def test_store_takes_runs_findings_and_json(spark, tmp_path):
    from tidescan.operators import store

    store.add_run(str(tmp_path / "runs"), spark.createDataFrame([(None, "p", "2025-01-01", None), ("r2", "p", None, "complete")], "id string, path string, ts string, status string"))
    assert {r.status for r in spark.read.parquet(str(tmp_path / "runs")).collect()} == {"running", "complete"}
    rows = spark.createDataFrame([(None, "r2", "a.py", 1, "sqli", None, None, None, 7.5)], "id string, run_id string, file_path string, line_start int, vuln_type string, severity string, confidence string, status string, cvss_score double")
    store.add_findings(str(tmp_path / "findings"), rows)
    (one,) = spark.read.parquet(str(tmp_path / "findings")).collect()
    assert (one.severity, one.confidence, one.status, one.cvss_score, len(one.id)) == ("medium", "possible", "candidate", 7.5, 12)
    (tmp_path / "list.json").write_text('[{"id": "a", "x": 1}, {"id": null}]')
    (tmp_path / "one.json").write_text('{\n "id": "b"\n}')
    assert sorted(str(r.id) for f in ("list", "one") for r in store.read_findings_json(spark, str(tmp_path / f"{f}.json"), "id string, y int").collect()) == ["None", "a", "b"]
    store.write_json(rows.select("id", "vuln_type"), str(tmp_path / "out"), pretty=True)
    assert '"vuln_type" : "sqli"' in "".join(p.read_text() for p in (tmp_path / "out").glob("part*"))
