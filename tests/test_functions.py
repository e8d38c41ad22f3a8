import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidescan.functions import cvss, entropy, languages, versions
from tidescan.functions.normalize import clean_path, severity_rank
from tidescan.functions.text import split_lines
from tidescan.operators import redos


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("x")).first()[0]


def many(spark, values, expr):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").select("k", expr(F.col("v")).alias("x")).orderBy("k").collect()
    return [r.x for r in rows]


def test_paths_and_severities(spark):
    assert many(spark, ["./a//b\\c.py", ".\\a", None, ""], clean_path) == ["a/b/c.py", "a", None, ""]
    assert many(spark, [" HIGH", "n/a", None, "critical"], severity_rank) == [1, 4, 4, 0]


def test_lines(spark):
    assert many(spark, ["a\r\nb\n", "", None, "x\x0by"], split_lines) == [["a", "b"], [], None, ["x", "y"]]


def reference_entropy(token, keep):
    kept = [c for c in token if re.match(keep, c)]
    if len(kept) < 16:
        return 0.0
    return -sum(kept.count(c) / len(kept) * math.log2(kept.count(c) / len(kept)) for c in set(kept))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="abcXYZ019+/=_-^]\\é", min_size=0, max_size=40), min_size=1, max_size=12))
def test_entropy_matches(spark, tokens):
    got = many(spark, tokens, lambda c: entropy.shannon_entropy(c, "base64"))
    assert got == pytest.approx([reference_entropy(t, "[A-Za-z0-9+/=]") for t in tokens])


def test_masks_and_placeholders(spark):
    assert many(spark, ["abcd", "abcdefghijkl", "a" * 20, None], entropy.mask) == ["****", "abc****kl", "aaaa****aa", None]
    assert many(spark, ["your-api-key", "${X}", "k3jf9"], entropy.is_placeholder) == [True, True, False]


def test_versions(spark):
    assert many(spark, ["1.2.3", "10.0", "2.0.0.1", "1.0.0rc1"], versions.parse_version) == [[1, 2, 3, 0], [10, 0, 0, 0], [2, 0, 0, 1], [1, 0, 1, 0]]
    rows = [("1.5.0", "<2.0.0|<1.4.0", True), ("2.16.0", ">=2.15.0,<2.17.0", True), ("2.18.0", ">=2.15.0,<2.17.0", False), ("3.2.20", "<2.2.28|<3.2.13|<4.0.4", True), ("1.0", "see OSV", False)]
    got = spark.createDataFrame(rows, "v string, r string, want boolean").select("want", versions.version_in_range(F.col("v"), F.col("r")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_cvss(spark):
    known = {"CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H": 9.8, "CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N": 6.1, "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H": 10.0, "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N": 0.0, "x": None}
    assert many(spark, list(known), cvss.base_score) == list(known.values())


def test_languages(spark):
    paths = ["a/Dockerfile", "x/.env.local", "b.tsx", "Gemfile", "c.unknown", "README", None, ".py"]
    assert many(spark, paths, languages.detect_language) == ["dockerfile", "dotenv", "typescript", "ruby", "unknown", "unknown", None, "unknown"]
    assert many(spark, ["app_test.go", "app.spec.ts", "tests/t.py", "src/main.py"], languages.is_test) == [True, True, True, False]


def test_regex_complexity(spark):
    got = many(spark, ["(a+)+", "^[a-z]{3,10}$", "(ab|ac)x", r"\d+\w*x?"], redos.complexity)
    assert got == ["catastrophic", "linear", "exponential", "linear"]


def test_nested_quantifiers_at_any_depth(spark):
    cases = {"(a+)+": True, "((ab)+c)*": True, "(?:x(?:y|z*)w)+": True, "(a{2,5}b)+": True, "(a{3})+": False, "(ra!)+": False, "(ab)+c+": False, r"(\+a)+": False, "([+*]a)+": False, "(a|b)?": False, "": False}
    assert many(spark, list(cases), redos.nested_quantifiers) == list(cases.values())
    shared = {"(ab|ac)": True, r"(\d|\w)": False, "(a|b)": False, "([ab]x|[ab]y)": True, "(?:foo|far)z": True, "((ab|ac)|x)": True, "(|a|b)": False}
    assert many(spark, list(shared), redos.common_prefix) == list(shared.values())


def test_worded_detectors_read_values_of_named_settings():
    import re

    from tidescan.sources.detectors import DETECTORS

    hit = lambda line: {n for n, _, rx in DETECTORS if re.search(rx, line)}
    assert len({n for n, _, _ in DETECTORS}) == len(DETECTORS)
    assert hit('password = "abcdefgh1"') == {"generic_password"} and hit("'client_secret' => 'abcdefgh1'") >= {"generic_secret"}
    assert "azure_storage_key" in hit("AccountKey=" + "a" * 86 + "==") and "heroku_api_key" in hit("HEROKU_API_KEY: 01234567-89ab-cdef-0123-456789abcdef")
    assert hit('password = getpass()') == set() and hit('jwt-secret: "short"') == set()
