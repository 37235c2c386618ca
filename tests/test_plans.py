"""Plan checks over a stored corpus: what is read, and what is shuffled."""

import re

import pytest
from pyspark.sql import functions as F

from shiftgauge.operators import features, files, inventories, scoring
from shiftgauge.plans import migration
from shiftgauge.queries import CONFIG, OPERATORS, PAIRS
from shiftgauge.sources.corpus import Corpus
from shiftgauge.sources.fixtures import FIXTURES, load_corpus
from conftest import TESTDATA


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The derived corpus as plain parquet tables, as a cluster would hold it."""
    root = tmp_path_factory.mktemp("corpus")
    derived = load_corpus(spark, str(TESTDATA / "sf0.001"))
    tables = {}
    for name in Corpus.TABLES:
        getattr(derived, name).coalesce(1).write.parquet(f"{root}/{name}")
        tables[name] = spark.read.parquet(f"{root}/{name}")
    return Corpus(**tables)


def plan_of(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def exchanges(df):
    """Columns that each shuffle carries."""
    blocks = plan_of(df).split("\n\n")
    return [b for b in blocks if re.match(r"\n*\(\d+\) Exchange", b)]


def content_scans(df):
    """Scans of the files table that read content; manifests have a content of their own."""
    scans = [b for b in plan_of(df).split("\n\n") if "ReadSchema" in b and re.search(r"Location: .*/files\]", b)]
    return [b for b in scans if "content" in re.search(r"ReadSchema: (.*)", b)[1]]


NO_CONTENT_OUT = [
    name for name in OPERATORS if name not in {"short_tag_rewrite", "rewritten_files", "class_name_sync"}
]


@pytest.mark.parametrize("name", NO_CONTENT_OUT)
def test_content_is_never_shuffled(stored, name):
    df = OPERATORS[name](stored)
    for block in exchanges(df):
        assert not re.search(r"\bcontent#", block), block
    assert "CartesianProduct" not in plan_of(df)


@pytest.mark.parametrize("name", ["short_tag_rewrite", "rewritten_files", "class_name_sync"])
def test_rewrites_do_not_shuffle_at_all(stored, name):
    assert exchanges(OPERATORS[name](stored)) == []


@pytest.mark.parametrize(
    "name", ["scan_code_files", "exclude_dirs", "legacy_split", "template_files", "codebase_size", "template_engine",
             "template_count", "fingerprint_match", "directory_order", "namespace_map", "upgrade_report"],
)
def test_listings_do_not_read_content(stored, name):
    assert content_scans(OPERATORS[name](stored)) == []


def test_the_report_reads_content_once(stored):
    assert len(content_scans(migration.migration_report(stored, CONFIG, PAIRS))) == 1


def test_tallies_use_hash_aggregates(stored):
    plan = plan_of(features.project_tallies(features.file_features(stored.files, CONFIG)))
    assert "HashAggregate" in plan
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_manifest_features_need_no_shuffle(stored, spark):
    from shiftgauge.operators.dependencies import manifest_features
    from shiftgauge.operators.detection import package_catalogue_join
    from shiftgauge.sources.corpus import parsed_manifests

    parsed = parsed_manifests(stored.manifests)
    assert exchanges(manifest_features(parsed)) == []
    assert exchanges(package_catalogue_join(parsed)) == []


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_the_split_plan_reads_content_once(stored, spark, threshold):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        assert len(content_scans(inventories.class_split_plan(stored.files, CONFIG))) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_prefixes_are_matched_without_a_nested_loop(stored):
    for name in ("prefix_package_match", "incompatible_packages"):
        plan = plan_of(OPERATORS[name](stored))
        assert "prefixes" not in plan and not re.search(r"NestedLoopJoin (Inner|Cross)[^\n]*\n[^\n]*startswith", plan, re.I)


def test_a_long_constructor_and_a_long_route_line_are_fast(spark):
    import time

    letters = "<?php public function __construct(" + "a" * 1_000_000
    routes = "<?php " + "$route['" * 100_000 + "'] = 'x"
    df = spark.createDataFrame(
        [("p", "src/a.php", letters), ("p", "src/routes.php", routes)], "project_id string, path string, content string"
    )
    began = time.perf_counter()
    assert not any(r[0] for r in df.select(features.has_injection(F.col("content"), F.col("path"))).collect())
    assert inventories.routes(df, CONFIG).collect() == []
    assert time.perf_counter() - began < 20


def test_manifest_rows_never_multiply_projects(spark):
    from shiftgauge.sources.corpus import manifest_packages, parsed_manifests

    rows = [("p", "composer.json", '{"require":{"php":"^8.1"},"require-dev":[]}'), ("p", "lib/composer.json", '{"require":{"x/y":"1"}}')]
    named = spark.createDataFrame(rows, "project_id string, path string, content string")
    assert [(r["name"], r["version_string"]) for r in manifest_packages(named).collect()] == [("php", "^8.1")]
    assert parsed_manifests(named.drop("path")).count() == 1


def test_renames_below_a_conflict_keep_the_old_parent(spark):
    found = ["my-dir/sub_dir/a.php", "MyDir/b.php", "lib/foo/a.php", "lib/Foo/b.php", "CVS/old/c.php", "a/_svn/d.txt"]
    df = spark.createDataFrame([("p", x, "") for x in found], "project_id string, path string, content string")
    plan = {r["dir"]: r for r in inventories.directory_rename_plan(df, df, CONFIG).collect()}
    assert plan["my-dir"]["conflict"] and plan["my-dir/sub_dir"]["final_dir"] == "my-dir/SubDir"
    titled = {r["dir"]: r for r in inventories.directory_capitalise_plan(df, CONFIG).collect()}
    assert titled["lib/foo"]["conflict"] and not titled["lib/Foo"]["changed"]
    assert not {"CVS/old", "a/_svn"} & set(titled)


def test_conditions_of_any_depth_count(spark):
    texts = {
        "if (a(b(c(d(e(f(g(1))))))) and (2)) j();": 1, "if (a) { b(); } if (c): d(); endif; if(e) f(); else if (g) h();": 2,
        "xif (a) b(); $if (a) c();": 1, "if (a": 0, "if (a))) if (b) c(": 2, "": 0, "((if(x) y())": 1,
    }
    df = spark.createDataFrame([("p", f"f{i}.php", t) for i, t in enumerate(texts)], "project_id string, path string, content string")
    got = {r["path"]: r["braceless_ifs"] for r in inventories.braceless_if_census(df).collect()}
    assert got == {f"f{i}.php": n for i, n in enumerate(texts.values())}


def test_lists_add_up(stored):
    listed = files.legacy_split(stored.files, CONFIG)
    counts = listed.groupBy("project_id").agg(
        F.count_if(~F.col("is_legacy")).alias("new"), F.count_if("is_legacy").alias("legacy")
    )
    tallies = migration.tallies(stored, CONFIG).filter("file_count + legacy_count > 0")
    joined = tallies.join(counts, "project_id")
    assert joined.filter("file_count != new or legacy_count != legacy").count() == 0
    assert joined.count() == tallies.count()


def test_a_coupled_file_never_raises_the_coupling_score(spark):
    rows = spark.range(0, 21).select(
        F.lit(20).alias("file_count"), F.col("id").alias("coupled"), F.lit(0).alias("heavy"), F.lit("x").alias("source")
    )
    score = scoring.coupling_score(F.col("file_count"), F.col("coupled"), F.col("heavy"), F.col("source"), F.lit("y"))
    found = [r[0] for r in rows.orderBy("coupled").select(score).collect()]
    assert found == sorted(found, reverse=True)


def test_fixtures_grow_with_the_tables(spark):
    assert set(FIXTURES) >= {"code_files", "projects", "packages", "registry", "releases"}
    small, large = (load_corpus(spark, str(TESTDATA / sf)) for sf in ("sf0.001", "sf0.01"))
    for name in Corpus.TABLES:
        assert getattr(large, name).count() > getattr(small, name).count(), name


def parses(spark, df):
    """Manifest parses that a run does; an exchange that is used again counts once."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    return plan.count("from_json(StructField(require,")


def test_reports_parse_the_manifests_once(stored, spark):
    from shiftgauge.queries import OPERATORS

    assert parses(spark, OPERATORS["upgrade_report"](stored)) == 1
    assert parses(spark, OPERATORS["upgrade_total"](stored)) == 1
    assert parses(spark, OPERATORS["migration_report"](stored)) == 1
    assert parses(spark, OPERATORS["report_rows"](stored)) <= 2
    assert parses(spark, OPERATORS["difficulty_bands"](stored)) <= 2


def test_hot_packages_are_dealt_over_tasks(spark):
    from shiftgauge.operators.joins import salted_lookup

    rows = spark.range(1000).selectExpr("cast(id as string) as project_id", "if(id % 3 = 0, 'hot', if(id % 50 = 1, null, concat('p', id))) as name")
    lookup = spark.createDataFrame([("hot", "9"), ("p1", "1"), ("p2", "2"), ("cold", "0")], "name string, latest string")
    plain = rows.join(lookup, "name", "left")
    key = lambda r: [str(x) for x in r]
    for most in (10, 1000):
        got = salted_lookup(rows, lookup, "name", "project_id", most)
        assert sorted(map(tuple, got.select(*plain.columns).collect()), key=key) == sorted(map(tuple, plain.collect()), key=key)
