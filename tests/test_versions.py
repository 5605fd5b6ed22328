"""Version predicate against the packaging library, used here only as an independent oracle."""

import itertools

from packaging.specifiers import InvalidSpecifier, SpecifierSet
from packaging.version import InvalidVersion, Version
from pyspark.sql import functions as F

from pinwatch.functions import versions as V

VERSIONS = """0 0.0 1 1.0 1.0.0 1.0.1 v1.0 1.2 1.2.3 1.2.4 1.10 1.9 1.0.dev1 1.0a1 1.0a1.dev2 1.0b2
1.0rc1 1.0rc2 1.0.post1 1.0.post1.dev3 1.0-1 1.0c3 1.0.pre4 1.0+cu118 1.0+cu.119 1!0.5 2.0.0rc1 2.0 2.0.0.1
2.0.0rc2 2.9.0 2.10.0 2.11.0 2.28.0 2.32.1 5.3.0.RELEASE latest 1..2""".split() + [""]
RANGES = ["", "< 2.10.0", "<2.0", "< 2.0.0rc2", "<= 2.10.0", "> 2.9.0", ">= 2.10.0", "== 1.2.3", "!= 1.2.3",
          ">= 1.0, < 2.0", "== 1.2.*", "!= 1.2.*", "~= 1.2", "~= 1.2.3", "> 1.0", "<1.0", "== 1.0", "==1.0+cu118",
          "> 1.0rc1", "<1.0.post1", ">= 1.0a1, != 1.0, < 2.0.0rc1", ">1.0.post0", "== 1.0.0.*", "< 1!0.6", "garbage",
          "< x", "==", "<=1.0.*", "~= 1", ">=1.0,", ">0", "== 0.*", "~= 1.0.0", ">1.0,>0.5,<9,<2.0"]


def expected(version, text):
    if not text:
        return False
    try:
        Version(version)
        return Version(version) in SpecifierSet(text, prereleases=True)
    except (InvalidSpecifier, InvalidVersion):
        return False


def test_range_predicate_agrees_with_the_public_scheme(spark):
    pairs = list(itertools.product(VERSIONS, RANGES))
    df = spark.createDataFrame(pairs, "v string, r string")
    got = df.select("v", "r", V.is_affected(F.col("v"), F.array().cast("array<string>"), F.col("r")).alias("hit"))
    wrong = [(row.v, row.r, row.hit) for row in got.collect() if row.hit != expected(row.v, row.r)]
    assert not wrong, "\n".join(map(str, wrong))


def test_sort_order_agrees_with_the_public_scheme(spark):
    texts = [v for v in VERSIONS if "+" not in v]
    valid = []
    for text in texts:
        try:
            valid.append((text, Version(text)))
        except InvalidVersion:
            pass
    df = spark.createDataFrame(list(itertools.product([t for t, _ in valid], repeat=2)), "a string, b string")
    a, b = V.version_parts(F.col("a"))["key"], V.version_parts(F.col("b"))["key"]
    parsed = dict(valid)
    for row in df.select("a", "b", (a < b).alias("lt"), (a == b).alias("eq")).collect():
        assert row.lt == (parsed[row.a] < parsed[row.b]), (row.a, row.b)
        assert row.eq == (parsed[row.a] == parsed[row.b]), (row.a, row.b)


CASES = [
    ("2.28.0", ["2.28.0", "2.29.0", "2.30.0"], "", True),
    ("2.32.1", ["2.28.0", "2.29.0"], "", False),
    ("2.28.0", [], "< 2.32.0", True),
    ("2.32.1", [], "< 2.32.0", False),
    ("1.0.0", [], "", False),
    ("1.0.0", None, None, False),
    ("1.2.3", [], "= 1.2.3", True),
    ("5.3.0.RELEASE", ["5.3.0.RELEASE"], "< 6", True),
    ("2.9.0", [], "< 2.10.0", True),
    ("2.11.0", [], "< 2.10.0", False),
    ("2.8.0", [], "> 2.9.0", False),
    ("2.10.0", [], ">= 2.10.0", True),
    ("2.11.0", [], "<= 2.10.0", False),
    ("1.2.3", [], "!= 1.2.3", False),
    ("1.5.0", [], ">= 1.0, < 2.0", True),
    ("0.9.0", [], ">= 1.0, < 2.0", False),
    ("202401011234567890123", [], "> 202401011234567890122", True),
    ("Release-7", [], "=== release-7", False),
]


def test_list_then_range(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, v string, l array<string>, r string, hit boolean")
    got = df.select("i", V.is_affected(F.col("v"), F.col("l"), F.col("r")).alias("got")).orderBy("i").collect()
    assert [row.got for row in got] == [case[3] for case in CASES]
