"""Dependency queries over manifests that Spark writes from the tables.

Each part becomes a dependency (its advisory by key, its version from its columns), parts
of one size share a manifest, and every format is written and read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidescan.operators import dependencies as D
from tidescan.plans import sql
from tidescan.session import materialise
from tidescan.sources.advisories import ALIASES, ROWS, advisories
from tidescan.sources.manifests import PARSERS, parse_manifests
from tidescan.sources.tables import table

N = len(ROWS)


def declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey, p_size, ecosystem, package, version: one dependency per part."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    names = F.array(*[F.struct(F.lit(r[0]).alias("e"), F.lit(r[1]).alias("p")) for r in ROWS])
    a = F.get(names, F.pmod("p_partkey", F.lit(N)).cast("int"))
    version = F.concat_ws(".", F.pmod("p_partkey", F.lit(11)).cast("string"), F.pmod("p_size", F.lit(30)).cast("string"), F.pmod("p_partkey", F.lit(7)).cast("string"))
    return part.select("p_partkey", "p_size", a["e"].alias("ecosystem"), a["p"].alias("package"), version.alias("version"))


def _manifest(deps: DataFrame, name: str, line: Column, head: str = "", tail: str = "", sep: str = "\n") -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line")))), lambda r: r["line"])
    folder = F.concat(F.lit("m"), F.col("p_size").cast("string"), F.lit("-"), F.pmod("p_partkey", F.lit(16)).cast("string"))
    return deps.groupBy(folder.alias("folder"), "p_size").agg(F.concat(F.lit(head), F.array_join(ordered, sep), F.lit(tail)).alias("content")).select(F.concat("folder", F.lit(f"/{name}")).alias("manifest"), "content")


def written_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """manifest, content: the same dependencies in every format."""
    d = declared(spark, sf_dir).withColumn("package", F.concat(F.regexp_replace(F.lower("package"), "[^a-z0-9]", "-"), F.lit("-"), F.col("p_partkey").cast("string")))
    f = lambda pattern: F.format_string(pattern, "package", "version")
    forms = [
        ("requirements.txt", f("%s==%s"), "# pinned\n-r base.txt\n", "", "\n"), ("package.json", f('"%s": "^%s"'), '{"dependencies": {', "}}", ", "),
        ("pom.xml", f("<dependency>\n<artifactId>%s</artifactId>\n<version>%s</version></dependency>"), "<project>", "</project>", "\n"),
        ("go.mod", f("\texample.com/%s v%s"), "module x\nrequire (\n", "\n)", "\n"), ("Gemfile.lock", f("    %s (%s)"), "GEM\n  specs:\n", "\n", "\n"),
        ("composer.json", f('"v/%s": "~%s"'), '{"require": {"php": ">=8.1", ', "}}", ", "), ("Cargo.toml", f('%s = { version = "%s" }'), "[package]\nname = \"x\"\n[dependencies]\n", "\n[features]\nz = \"1.0\"", "\n"),
        ("x.csproj", f('<PackageReference Include="%s" Version="%s" />'), "<Project>", "</Project>", "\n"), ("packages.config", f('<package id="%s" version="%s" />'), "<packages>", "</packages>", "\n"),
        ("build.gradle", f("implementation 'org.x:%s:%s'"), "dependencies {\n", "\n}", "\n"), ("pyproject.toml", f('%s = "^%s"'), "[tool.poetry.dependencies]\n", "\n[build-system]\n", "\n"),
        ("package-lock.json", f('"node_modules/%s": {"version": "%s"}'), '{"packages": {"": {"version": "1.0.0"}, ', "}}", ", "), ("yarn.lock", f('%s@^1.0.0:\n  version "%s"'), "# yarn lockfile v1\n\n", "\n", "\n\n"),
        ("pnpm-lock.yaml", f("  /%s@%s:"), "packages:\n", "\n", "\n"), ("poetry.lock", f('[[package]]\nname = "%s"\nversion = "%s"\n'), "# lock\n", "", "\n"),
        ("Pipfile.lock", f('"%s": {"version": "==%s"}'), '{"default": {', "}}", ", "), ("composer.lock", f('{"name": "v/%s", "version": "v%s"}'), '{"packages": [', "]}", ", "),
        ("Cargo.lock", f('[[package]]\nname = "%s"\nversion = "%s"\n'), "version = 3\n", "", "\n"), ("go.sum", f("example.com/%s v%s h1:abc="), "", "\n", "\n"),
    ]
    out = None
    for name, line, head, tail, sep in forms:
        one = _manifest(d, name, line, head, tail, sep)
        out = one if out is None else out.unionByName(one)
    return out


FORMATS = [n for n in PARSERS if n not in ("requirements-dev.txt", "requirements-prod.txt", "build.gradle.kts")]


def manifest_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    deps = parse_manifests(materialise(written_manifests(spark, sf_dir), "manifests"))
    kind = F.lower(F.element_at(F.split("manifest", "/"), -1))
    return deps.groupBy(F.when(kind.endswith(".csproj"), ".csproj").otherwise(kind).alias("format"), "ecosystem").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("name").alias("names"), F.min("name").alias("first_name"), F.max("version").alias("last_version")
    )


def _deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = declared(spark, sf_dir)
    return d.select(F.concat(F.lit("m"), F.col("p_size").cast("string")).alias("manifest"), "ecosystem", F.lower("package").alias("name"), "version", F.lit(None).cast("boolean").alias("is_dev"), F.lit(True).alias("is_direct"))


def dependency_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.audit(_deps(spark, sf_dir), advisories(spark)).select("manifest", "ecosystem", "package", "current_version", "cve", "severity", "cvss")


def dependency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.audit(_deps(spark, sf_dir), advisories(spark), aliases=False)
    return found.groupBy("ecosystem", "severity").agg(F.count(F.lit(1)).alias("n"), F.max("cvss").alias("worst"))


QUERIES = {f.__name__: f for f in (manifest_dependencies, dependency_audit, dependency_summary)}

_ADV = sql.values([(k, *r) for k, r in enumerate(ROWS)], ["k", "ecosystem", "package", "range", "safe_version", "cve", "cvss", "vuln_type", "description"], "adv")
_V = "(p_partkey % 11)::VARCHAR || '.' || (p_size % 30)::VARCHAR || '.' || (p_partkey % 7)::VARCHAR"
_DEP = f"{_ADV}, dep AS (SELECT p_partkey, p_size, a.ecosystem, a.package, {_V} AS version FROM part JOIN adv a ON p_partkey % {N} = a.k)"
_PARSE = "list_transform(string_split(regexp_replace({0}, '[^0-9.]', '', 'g'), '.'), lambda z: coalesce(try_cast(z AS INTEGER), 0))"
_QUAD = "list_resize({0}, 4, 0)"
_FORMS = sql.values([(n, PARSERS[n][0], "example.com/" if n in ("go.mod", "go.sum") else "v/" if n.startswith("composer") else "") for n in FORMATS], ["format", "ecosystem", "pre"], "forms")
_PAIRS = sql.values([(e, t) for e, ts in ALIASES.items() for t in ts], ["fe", "te"], "pairs")


def _audit(index: str) -> str:
    cur, tgt = _QUAD.format(_PARSE.format("version")), _QUAD.format(_PARSE.format("trim(c, '<>= ')"))
    return f"""WITH {_DEP}, {_PAIRS}, idx AS ({index}),
        c AS (SELECT d.p_partkey, d.p_size, d.ecosystem, d.package AS dep, d.version, i.package, i.cve, i.cvss, i.range, i.vuln_type, i.description, i.safe_version, part_no, unnest(string_split(part, ',')) AS c
          FROM (SELECT *, generate_subscripts(ps, 1) AS part_no, unnest(ps) AS part FROM (SELECT *, string_split(range, '|') AS ps FROM idx)) i JOIN dep d ON d.ecosystem = i.ecosystem AND lower(d.package) = lower(i.package)),
        ok AS (SELECT * EXCLUDE (c), CASE WHEN c LIKE '<=%' THEN {cur} <= {tgt} WHEN c LIKE '>=%' THEN {cur} >= {tgt} WHEN c LIKE '<%' THEN {cur} < {tgt}
          WHEN c LIKE '>%' THEN {cur} > {tgt} ELSE {cur} = {tgt} END AS holds FROM c),
        part_ok AS (SELECT * EXCLUDE (holds), bool_and(holds) AS h FROM ok GROUP BY ALL),
        found AS (SELECT DISTINCT 'm' || p_size AS manifest, ecosystem, package, version AS current_version, range, safe_version, cve, vuln_type, description, cvss::DOUBLE AS cvss,
          CASE WHEN cvss >= 9 THEN 'critical' WHEN cvss >= 7 THEN 'high' WHEN cvss >= 4 THEN 'medium' WHEN cvss > 0 THEN 'low' ELSE 'informational' END AS severity FROM part_ok WHERE h)"""


_OWN = "SELECT ecosystem, package, range, cve, cvss, vuln_type, description, safe_version FROM adv"
ORACLES = {
    "manifest_dependencies": f"""WITH {_DEP}, {_FORMS}, n AS (SELECT f.format, f.ecosystem, f.pre || regexp_replace(lower(d.package), '[^a-z0-9]', '-', 'g') || '-' || d.p_partkey AS name, d.version FROM dep d CROSS JOIN forms f)
        SELECT format, ecosystem, count(*) AS n, count(DISTINCT name) AS names, min(name) AS first_name, max(version) AS last_version FROM n GROUP BY ALL""",
    "dependency_audit": _audit(_OWN + " UNION SELECT p.fe, package, range, cve, cvss, vuln_type, description, safe_version FROM adv JOIN pairs p ON p.te = adv.ecosystem")
    + " SELECT manifest, ecosystem, package, current_version, cve, severity, cvss FROM found",
    "dependency_summary": _audit(_OWN) + " SELECT ecosystem, severity, count(*) AS n, max(cvss) AS worst FROM found GROUP BY ALL",
}
