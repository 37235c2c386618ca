"""Packs and prefixes as tables against naive counting."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import TESTDATA
from shiftgauge.functions import fixed_values as fixed
from shiftgauge.operators import features, pattern_tables
from shiftgauge.operators.files import ScanConfig
from shiftgauge.sources.fixtures import load_corpus

CONFIG = ScanConfig()
PACK = "framework string, literal string"


def naive(rows, pack):
    """str.count is case-sensitive and does not count overlaps."""
    found = {}
    for project, path, content in rows:
        for framework, literal in {p for p in pack if p[0] and p[1]}:
            n = (content or "").count(literal)
            if n:
                found[project, path, framework] = found.get((project, path, framework), 0) + n
    return found


def check(spark, rows, pack):
    files = spark.createDataFrame(rows, "project_id string, path string, content string")
    got = pattern_tables.pack_counts(files, spark.createDataFrame(pack, PACK), CONFIG).collect()
    assert len(got) == len({(r.project_id, r.path, r.framework) for r in got})
    assert {(r.project_id, r.path, r.framework): r.hits for r in got} == naive(rows, pack)


def test_packs_with_odd_literals(spark):
    rows = [("p", "a.php", "aaaaa abab use X; use Y; é€ééé"), ("p", "b.php", None), ("q", "c.php", ""), ("q", "d.php", "ab"), (None, "e.php", "bab"),
            ("q", "f.php", "x" * 300_000 + "use X;")]
    pack = [("A", "a"), ("A", "aa"), ("A", "aaa"), ("B", "abab"), ("B", "ab"), ("B", "b"), ("B", "use X;"), ("C", "use X;"), ("C", "use X;"), ("C", "é"),
            ("C", "éé"), ("C", "€é"), ("D", ""), ("D", None), (None, "a"), ("D", "X; use Y; é€ééé and more"), ("E", "aaaaa ab"), ("E", "xxxx")]
    check(spark, rows, pack)
    check(spark, rows, [])
    check(spark, rows[:0], pack)


def made(draw, letters, most):
    return "".join(draw.choices(letters, k=draw.randrange(1, most)))


@pytest.mark.parametrize("limit", [4_000_000, 300])
def test_random_packs(spark, monkeypatch, limit):
    monkeypatch.setattr(pattern_tables, "PACK_BYTES", limit)
    draw = random.Random(limit)
    rows = [(f"p{i % 3}", f"f{i}.php", made(draw, "abc ", 400)) for i in range(60)]
    check(spark, rows, [(f"fw{draw.randrange(5)}", made(draw, "abc ", 9)) for _ in range(150)])


def test_the_own_signatures_as_a_table(spark):
    files = load_corpus(spark, str(TESTDATA / "sf0.001")).files
    pack = [(fw, x) for fw in fixed.SIGNATURES for x in features.pack_literals(fixed.SIGNATURES, fw)]
    assert len(pack) == len(set(pack))
    got = pattern_tables.pack_counts(files, spark.createDataFrame(pack, PACK), CONFIG).collect()
    plain = features.signature_counts(files, CONFIG).filter("hits > 0").collect()
    assert sorted(map(tuple, got)) == sorted((r.project_id, r.path, r.framework, r.hits) for r in plain)


def test_thousands_of_literals_in_one_pass(spark):
    """5,000 literals out of the texts, and a plan that does not grow with them."""
    files = load_corpus(spark, str(TESTDATA / "sf0.001")).files
    texts = files.filter(F.col("path").endswith(".php")).select("project_id", "path", "content").collect()
    draw = random.Random(9)
    pack = []
    while len(pack) < 5000:
        text = draw.choice(texts)["content"]
        at = draw.randrange(max(1, len(text) - 12))
        pack.append((f"fw{draw.randrange(40)}", text[at : at + draw.randrange(2, 12)]))
    listed = [tuple(r) for r in files.filter(features.is_listed(F.col("path"), CONFIG)).select("project_id", "path", "content").collect()]
    counted = pattern_tables.pack_counts(files, spark.createDataFrame(pack, PACK), CONFIG)
    size = lambda df: len(df._jdf.queryExecution().executedPlan().toString())
    few = pattern_tables.pack_counts(files, spark.createDataFrame(pack[:5], PACK), CONFIG)
    assert abs(size(counted) - size(few)) < 200
    assert {(r.project_id, r.path, r.framework): r.hits for r in counted.collect()} == naive(listed, pack)


def true_prefixes(names, prefixes):
    for name in {n for n in names if n is not None}:
        found = [(p, o) for p, o in set(prefixes) if p is not None and name.startswith(p)]
        most = max((len(p) for p, _ in found), default=0)
        yield from ((name, p, o, len(p) == most) for p, o in found)


def test_prefixes_of_a_table(spark):
    draw = random.Random(2)
    names = [made(draw, "ab/é", 12) for _ in range(400)] + [None, "", "zz"]
    prefixes = [(made(draw, "ab/é", 6), draw.choice("xyz")) for _ in range(300)] + [("", "all"), (None, "none"), ("a" * 500, "long")]
    n, p = spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame(prefixes, "prefix string, owner string")
    got = pattern_tables.prefix_matches(n, p)
    assert sorted(map(tuple, got.collect())) == sorted(true_prefixes(names, prefixes))
    assert pattern_tables.prefix_matches(n.limit(0), p).count() == pattern_tables.prefix_matches(n, p.limit(0)).count() == 0


def test_many_prefixes_need_no_nested_loop(spark):
    names = spark.range(20_000).selectExpr("concat('v', id % 5000, '/name-', id) as name")
    prefixes = spark.range(100_000).selectExpr("concat('v', id, if(id % 2 = 0, '/', '/name-')) as prefix", "id % 7 as owner")
    got = pattern_tables.prefix_matches(names, prefixes)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert got.count() == 20_000 and got.filter("longest").count() == 20_000
