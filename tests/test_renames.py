"""Renames of directories against doing them one after the other."""

import random
import re

from shiftgauge.operators import inventories
from shiftgauge.operators.files import ScanConfig

CONFIG = ScanConfig()


def pascal(name):
    words = re.sub("[^a-zA-Z0-9_ -]+", "", re.sub("([a-z])([A-Z])", r"\1 \2", name)).replace("-", " ").replace("_", " ").lower().split(" ")
    return "".join(w[:1].upper() + w[1:] for w in words)


def one_after_the_other(paths):
    """dir -> (new_dir, final_dir, conflict), by moving directories in a tree."""
    above = lambda p: ["/".join(p.split("/")[:i]) for i in range(1, p.count("/") + 1)]
    source = {d for p in paths if p.endswith(".php") for d in above(p)}
    there = {d for p in paths for d in above(p)}
    plan, done = {}, {}
    for d in sorted(source, key=lambda d: (-d.count("/"), d.encode())):
        parent, _, name = d.rpartition("/")
        new = pascal(name)
        if new == name:
            continue
        target = f"{parent}/{new}" if parent else new
        conflict = new == "" or target in there
        if not conflict:
            there = there - {d} | {target}
            done[d] = new
        plan[d] = (target, conflict)
    final = {d: "/".join(done.get(a, a.rpartition("/")[2]) for a in [*above(d), d]) for d in plan}
    return {d: (target, final[d], conflict) for d, (target, conflict) in plan.items()}


def planned(spark, trees):
    rows = [(f"p{i}", p, "") for i, paths in enumerate(trees) for p in paths]
    df = spark.createDataFrame(rows, "project_id string, path string, content string")
    found = inventories.directory_rename_plan(df, df.select("project_id", "path"), CONFIG).collect()
    return {(r.project_id, r.dir): (r.new_dir, r.final_dir, r.conflict) for r in found}


def expected(trees):
    return {(f"p{i}", d): v for i, paths in enumerate(trees) for d, v in one_after_the_other(paths).items()}


def test_chains_and_freed_names(spark):
    trees = [
        ["AB/x.php", "a-b/x.php"],  # AB goes to Ab, which frees its name
        ["AB/x.php", "a-b/x.php", "Ab/x.txt"],  # AB cannot go
        ["AB/x.txt", "a-b/x.php"],  # nobody renames AB
        ["AB/x.php", "a-b/x.php", "a_b/x.php", "aB/x.php"],
        ["x/a-b/x.php", "x/AB/x.php", "x-y/AB/a b/x.php"],
        ["--/x.php", "_-/x.php", "é/x.php", "éa/x.php", "A/x.php"],
        ["foo/x.php", "foobar/x.php", "Foo/y/x.php"],
    ]
    got = planned(spark, trees)
    assert got == expected(trees)
    assert got["p0", "a-b"] == ("AB", "AB", False) and got["p1", "a-b"][2] and got["p2", "a-b"][2]
    assert got["p4", "x/a-b"] == ("x/AB", "X/AB", False)


def test_random_trees(spark):
    draw = random.Random(3)
    names = ["a", "A", "a-b", "AB", "Ab", "a_b", "aB", "ab", "a-b-c", "ABC", "Abc", "abC", "AbC", "x1-y", "X1Y", "X1y", "-", "a b"]
    trees = [
        [f"{'/'.join(draw.choices(names, k=draw.randrange(1, 4)))}/f.{draw.choice(['php', 'php', 'txt'])}" for _ in range(draw.randrange(1, 25))]
        for _ in range(150)
    ]
    assert planned(spark, trees) == expected(trees)


def test_a_new_name_is_renamed_once_at_most(spark):
    """What the two turns of _rename_winners rest on."""
    draw = random.Random(4)
    for _ in range(20_000):
        name = "".join(draw.choices("aBcD1-_ é", k=draw.randrange(1, 9)))
        assert pascal(pascal(pascal(name))) == pascal(pascal(name))


def test_a_parent_with_many_children_is_no_group(spark):
    from pyspark.sql import functions as F

    df = spark.range(30_000).select(
        F.lit("p").alias("project_id"), F.concat(F.lit("all/dir-"), F.col("id") % 10_000, F.lit("/f.php")).alias("path"), F.lit("").alias("content")
    )
    plan = inventories.directory_rename_plan(df, df, CONFIG)
    assert plan.filter("not conflict").count() == 10_001
    assert "Window" not in plan._jdf.queryExecution().executedPlan().toString()
