"""Dependencies declared in manifests and lock files.

Every format is read with native expressions from rows (manifest, content): line formats by
one expression per line, sections by carrying the last header forward over the lines of
one manifest, JSON formats by ``from_json`` into maps. Unreadable content gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidescan.functions.languages import base_name
from tidescan.functions.text import explode_lines

COLUMNS = ["manifest", "ecosystem", "name", "version", "is_dev", "is_direct"]


def _rows(df: DataFrame, name: Column, version: Column, dev: Column | None = None, direct: Column | None = None) -> DataFrame:
    no = F.lit(None).cast("boolean")
    out = df.select("manifest", F.lower(name).alias("name"), version.alias("version"), (no if dev is None else dev).alias("is_dev"), (no if direct is None else direct).alias("is_direct"))
    return out.filter((F.col("name") != "") & (F.col("version") != ""))


def _lines(m: DataFrame) -> DataFrame:
    return explode_lines(m)


def _by_line(m: DataFrame, regex: str, skip: str | None = None, direct: Column | None = None) -> DataFrame:
    lines = _lines(m).filter(F.col("line").rlike(regex))
    if skip:
        lines = lines.filter(~F.col("line").rlike(skip))
    return _rows(lines, F.regexp_extract("line", regex, 1), F.regexp_extract("line", regex, 2), direct=direct)


def _by_match(m: DataFrame, *regexes: str, swap: bool = False) -> DataFrame:
    """Formats whose entries may span lines: all matches over the whole text."""
    parts = []
    for rx in regexes:
        each = m.select("manifest", F.explode(F.regexp_extract_all("content", F.lit(rx), F.lit(0))).alias("x"))
        a, b = F.regexp_extract("x", rx, 1), F.regexp_extract("x", rx, 2)
        parts.append(_rows(each, b if swap else a, a if swap else b))
    return reduce(DataFrame.unionByName, parts)


def _sectioned(m: DataFrame, header: str) -> DataFrame:
    """Lines with ``inside``: whether the last bracketed header at or before the line matches."""
    lines = _lines(m).withColumn("line", F.trim("line"))
    head = F.when(F.col("line").startswith("["), F.col("line").rlike(header))
    w = W.partitionBy("manifest").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    return lines.withColumn("inside", F.coalesce(F.last(head, ignorenulls=True).over(w), F.lit(False))).filter(~F.col("line").startswith("["))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9.]", "")


def requirements(m: DataFrame) -> DataFrame:
    return _by_line(m, r"^\s*([\w\-.]+)\s*(?:==|>=|<=|~=|!=|>|<)\s*([\d.]+)", skip=r"^\s*[#\-]")


def package_json(m: DataFrame) -> DataFrame:
    shape = "struct<dependencies: map<string,string>, devDependencies: map<string,string>, peerDependencies: map<string,string>>"
    j = m.select("manifest", F.from_json("content", shape).alias("j"))
    parts = []
    for field, dev in (("dependencies", False), ("devDependencies", True), ("peerDependencies", False)):
        each = j.select("manifest", F.explode(f"j.{field}").alias("k", "v"))
        parts.append(_rows(each, F.col("k"), _digits(F.col("v")), dev=F.lit(dev)))
    return reduce(DataFrame.unionByName, parts)


def pom_xml(m: DataFrame) -> DataFrame:
    return _by_match(m, r"(?s)<artifactId>\s*([^<]+?)\s*</artifactId>\s*<version>\s*([^<]+?)\s*</version>")


def go_mod(m: DataFrame) -> DataFrame:
    return _by_line(m, r"^\s*(?:require\s+)?([\w./\-]+\.[\w./\-]+)\s+v([\d.]+)")


def gemfile_lock(m: DataFrame) -> DataFrame:
    lines = _lines(m)
    w = W.partitionBy("manifest").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    begun = lines.withColumn("begun", F.max(F.col("line").rlike(r"^\s*specs:")).over(w)).filter("begun")
    rx = r"^ {4}([\w\-.]+) \(([\d.]+)"
    return _rows(begun.filter(F.col("line").rlike(rx)), F.regexp_extract("line", rx, 1), F.regexp_extract("line", rx, 2))


def composer_json(m: DataFrame) -> DataFrame:
    j = m.select("manifest", F.from_json("content", "struct<`require`: map<string,string>, `require-dev`: map<string,string>>").alias("j"))
    parts = []
    for field, dev in (("require", False), ("require-dev", True)):
        each = j.select("manifest", F.explode(F.col("j").getField(field)).alias("k", "v")).filter(F.col("k") != "php")
        parts.append(_rows(each, F.col("k"), _digits(F.col("v")), dev=F.lit(dev)))
    return reduce(DataFrame.unionByName, parts)


def cargo_toml(m: DataFrame) -> DataFrame:
    lines = _sectioned(m, r"^\[(dev-dependencies|build-dependencies|dependencies)\]").filter("inside")
    plain, table = r"""^([\w\-]+)\s*=\s*["']([^"']+)["']""", r"""^([\w\-]+)\s*=\s*\{[^}]*version\s*=\s*["']([^"']+)["']"""
    pick = lambda g: F.when(F.col("line").rlike(plain), F.regexp_extract("line", plain, g)).otherwise(F.regexp_extract("line", table, g))
    return _rows(lines, pick(1), _digits(pick(2)))


def csproj(m: DataFrame) -> DataFrame:
    return _by_match(
        m, r"""<PackageReference\s+Include="([^"]+)"\s+Version="([\d.]+)[^"]*\"""", r"""(?s)<PackageReference\s+Include="([^"]+)"\s*>\s*<Version>([\d.]+)"""
    )


def packages_config(m: DataFrame) -> DataFrame:
    return _by_match(m, r"""<package\s+id="([^"]+)"\s+version="([\d.]+)""")


def build_gradle(m: DataFrame) -> DataFrame:
    kinds = r"(?:implementation|api|compile|testImplementation|runtimeOnly|compileOnly|testCompile)"
    return _by_match(m, kinds + r"""\s*\(?\s*["'][\w.\-]+:([\w.\-]+):([\d.]+)""")


def pyproject(m: DataFrame) -> DataFrame:
    lines = _sectioned(m, r"^\[(project\.dependencies|tool\.poetry\.dependencies)\]")
    named, listed = r"""^([\w\-.]+)\s*=\s*["'][\^~>=<]*([\d.]+)""", r'"([\w\-.]+)\s*(?:>=|==|~=|<=|!=|>|<)\s*([\d.]+)'
    pick = lambda g: F.when(F.col("inside"), F.regexp_extract("line", named, g)).otherwise(F.regexp_extract("line", listed, g))
    return _rows(lines, pick(1), pick(2))


_PACKAGE = "struct<version: string, resolved: string>"


def package_lock(m: DataFrame) -> DataFrame:
    j = m.select("manifest", F.from_json("content", f"struct<packages: map<string,{_PACKAGE}>, dependencies: map<string,{_PACKAGE}>>").alias("j"))
    new = j.select("manifest", F.explode("j.packages").alias("k", "v")).filter(F.col("k") != "").withColumn("k", F.regexp_replace("k", "^node_modules/", ""))
    direct = F.when(F.col("k").startswith("@"), ~F.regexp_replace("k", "^@[^/]*/", "").contains("/")).otherwise(~F.col("k").contains("/"))
    old = j.filter(F.col("j.packages").isNull()).select("manifest", F.explode("j.dependencies").alias("k", "v")).filter(F.col("v.resolved").isNotNull())
    return _rows(new, F.col("k"), F.col("v.version"), direct=direct).unionByName(_rows(old, F.col("k"), F.col("v.version"), direct=F.lit(True)))


def yarn_lock(m: DataFrame) -> DataFrame:
    lines = _lines(m)
    head = F.nullif(F.regexp_extract("line", r'^"?([a-zA-Z0-9@._/\-]+)@[^:]+:?\s*$', 1), F.lit(""))
    w = W.partitionBy("manifest").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    rx = r'^ {2}version\s+"([^"]+)"'
    named = lines.withColumn("name", F.last(head, ignorenulls=True).over(w)).filter(F.col("line").rlike(rx))
    return _rows(named, F.col("name"), F.regexp_extract("line", rx, 1), direct=F.lit(False))


def pnpm_lock(m: DataFrame) -> DataFrame:
    return _by_line(m, r"^ {2}/([a-zA-Z0-9@._/\-]+)[@/]([0-9][^:]+):", direct=F.lit(False))


def _blocks(m: DataFrame) -> DataFrame:
    each = m.select("manifest", F.explode(F.slice(F.split("content", r"\[\[package\]\]"), F.lit(2), F.greatest(F.size(F.split("content", r"\[\[package\]\]")) - 1, F.lit(0)))).alias("b"))
    return _rows(each, F.regexp_extract("b", r'(?m)^name\s*=\s*"([^"]+)"', 1), F.regexp_extract("b", r'(?m)^version\s*=\s*"([^"]+)"', 1), direct=F.lit(False))


def pipfile_lock(m: DataFrame) -> DataFrame:
    j = m.select("manifest", F.from_json("content", "struct<default: map<string,struct<version: string>>, develop: map<string,struct<version: string>>>").alias("j"))
    parts = []
    for field, dev in (("default", False), ("develop", True)):
        each = j.select("manifest", F.explode(F.col("j").getField(field)).alias("k", "v"))
        parts.append(_rows(each, F.col("k"), F.regexp_replace("v.version", "^=+", ""), dev=F.lit(dev), direct=F.lit(False)))
    return reduce(DataFrame.unionByName, parts)


def composer_lock(m: DataFrame) -> DataFrame:
    pkg = "array<struct<name: string, version: string>>"
    j = m.select("manifest", F.from_json("content", f"struct<packages: {pkg}, `packages-dev`: {pkg}>").alias("j"))
    parts = []
    for field, dev in (("packages", False), ("packages-dev", True)):
        each = j.select("manifest", F.explode(F.col("j").getField(field)).alias("p"))
        parts.append(_rows(each, F.col("p.name"), F.regexp_replace("p.version", "^v", ""), dev=F.lit(dev), direct=F.lit(False)))
    return reduce(DataFrame.unionByName, parts)


def go_sum(m: DataFrame) -> DataFrame:
    """The last line of a module in a manifest counts."""
    rx = r"^(\S+)\s+v([0-9]\S+)\s+"
    lines = _lines(m).filter(F.col("line").rlike(rx))
    last = lines.withColumn("module", F.lower(F.regexp_extract("line", rx, 1))).groupBy("manifest", "module").agg(F.max_by("line", "line_no").alias("line"))
    return _rows(last, F.col("module"), F.regexp_extract("line", rx, 2), direct=F.lit(False))


#: Name (or end) of the file in lower case -> ecosystem and reader.
PARSERS = {
    "requirements.txt": ("python", requirements), "requirements-dev.txt": ("python", requirements), "requirements-prod.txt": ("python", requirements),
    "pyproject.toml": ("python", pyproject), "package.json": ("javascript", package_json), "pom.xml": ("java", pom_xml), "build.gradle": ("java", build_gradle),
    "build.gradle.kts": ("java", build_gradle), "go.mod": ("go", go_mod), "gemfile.lock": ("ruby", gemfile_lock), "composer.json": ("php", composer_json),
    "cargo.toml": ("rust", cargo_toml), "packages.config": ("dotnet", packages_config), ".csproj": ("dotnet", csproj), "package-lock.json": ("npm", package_lock),
    "yarn.lock": ("npm", yarn_lock), "pnpm-lock.yaml": ("npm", pnpm_lock), "poetry.lock": ("pypi", _blocks), "pipfile.lock": ("pypi", pipfile_lock),
    "composer.lock": ("packagist", composer_lock), "cargo.lock": ("crates.io", _blocks), "go.sum": ("go", go_sum),
}


def parse_manifests(manifests: DataFrame) -> DataFrame:
    """(manifest, content) -> COLUMNS: every dependency of every known manifest, names in lower case."""
    name = F.lower(base_name(F.col("manifest")))
    parts = []
    for end, (ecosystem, reader) in PARSERS.items():
        mine = manifests.filter(name.endswith(end) if end == ".csproj" else name == end).select("manifest", "content")
        parts.append(reader(mine).withColumn("ecosystem", F.lit(ecosystem)))
    return reduce(DataFrame.unionByName, parts).select(*COLUMNS)
