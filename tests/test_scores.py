import pytest
from pyspark.sql import functions as F

from shiftgauge.functions.bands import legacy_label, migration_band, upgrade_band
from shiftgauge.operators import dependencies, scoring
from shiftgauge.operators.features import DB_CLASSES
from shiftgauge.operators.features import ARCHITECTURE_FLAGS, TEST_FLAGS
from shiftgauge.functions.fixed_values import FRAMEWORKS

COUNTS = [
    "file_count", "legacy_count", "template_count", "signals",
    *[f"db_{x}" for x in DB_CLASSES],
    *[f"n_{x}" for x in (*ARCHITECTURE_FLAGS, *TEST_FLAGS)],
    *[f"{p}{k}_{fw}" for fw in FRAMEWORKS for p in ("", "legacy_") for k in ("coupled", "heavy")],
]


@pytest.fixture
def score(spark):
    def run(expression, **known):
        text = {k: v for k, v in known.items() if isinstance(v, str)}
        row = spark.range(1).select(
            *[F.lit(known.get(c, 0)).cast("bigint").alias(c) for c in COUNTS],
            *[F.lit(v).alias(k) for k, v in text.items()],
        )
        return row.select(expression).first()[0]

    return run


def test_framework_coupling(score):
    args = {"source_framework": "laravel", "target_framework": "symfony", "coupled_laravel": 3, "heavy_laravel": 1}
    assert score(scoring.framework_coupling_score(), file_count=10, **args) == 41.48
    assert score(scoring.framework_coupling_score(), file_count=0, **args) == 100.0
    assert score(scoring.framework_coupling_score(), file_count=10, **{**args, "target_framework": "laravel"}) == 100.0
    assert score(scoring.framework_coupling_score(), file_count=10, **{**args, "source_framework": "none"}) == 100.0


@pytest.mark.parametrize(
    ("counts", "expected"),
    [
        ({}, 100.0),
        ({"db_active_record": 1}, 25.0),
        ({"db_raw": 2}, 68.0),
        ({"db_doctrine": 3}, 70.0),
        ({"db_doctrine": 1, "db_raw": 2}, 47.0),
        ({"db_eloquent": 10}, 15.0),
        ({"db_active_record": 10}, 5.0),
    ],
)
def test_database_coupling(score, counts, expected):
    assert score(scoring.database_coupling_score(), file_count=10, **counts) == expected


def test_test_coverage(score):
    assert score(scoring.test_coverage_score(), file_count=7, n_is_test=3, n_is_coupled_test=1) == 80.0
    assert score(scoring.test_coverage_score(), file_count=7) == 0.0
    assert score(scoring.test_coverage_score()) == 0.0


@pytest.mark.parametrize(("n", "expected"), [(0, 100.0), (100, 100.0), (500, 78.55), (100000, 5.0)])
def test_codebase_size(score, n, expected):
    assert score(scoring.codebase_size_score(), file_count=n) == expected


def test_architecture(score):
    assert score(scoring.architecture_score()) == 50.0
    flags = {f"n_{x}": 1 for x in ARCHITECTURE_FLAGS}
    assert score(scoring.architecture_score(), file_count=10, **flags) == 25.0 + 20.0 + 10.0 + 8.0 + 15.0


def test_template_score(score):
    php = {"template_engine": "php", "target_framework": "symfony"}
    assert score(scoring.template_score(), template_count=5, signals=40, **php) == 48.0
    assert score(scoring.template_score(), template_engine="twig", target_framework="tempest") == 70.0
    assert score(scoring.template_score(), template_engine="none", target_framework="tempest") == 100.0


def test_totals_are_rounded_on_the_decimal_value(spark):
    upgrade = spark.sql("select 80D framework_version, 60D dependencies, 90D php_version, 70D codebase_size")
    assert upgrade.select(scoring.upgrade_total()).first()[0] == 74.5
    tie = spark.sql(
        "select 70.97D framework_coupling, 47.5D database_coupling, 30D dependency_compatibility, "
        "58.57D architecture, 35D test_coverage, 100D codebase_size, 60D templating"
    )
    assert tie.select(scoring.migration_total(F.lit(True))).first()[0] == 58.26  # 58.255


def test_bands(spark):
    rows = spark.createDataFrame([(x,) for x in (0.0, 34.99, 35.0, 55.0, 70.0, 84.99, 85.0, 100.0, None)], "s double")
    labels = [r[0] for r in rows.select(migration_band(F.col("s"))).collect()]
    assert [x and x.split(" Migration")[0] for x in labels] == [
        "Extremely Difficult", "Extremely Difficult", "Very Difficult", "Difficult", "Moderate", "Moderate",
        "Straightforward", "Straightforward", None,
    ]
    assert [r[0] for r in rows.select(upgrade_band(F.col("s"))).collect()][3] == "Medium Upgrade"
    assert rows.select(legacy_label(F.col("s"))).first()[0].startswith("(heavily coupled")


def test_dependency_score(spark, manifest):
    projects = spark.createDataFrame([("p",), ("q",)], "project_id string")
    rows = manifest({"php": "^7.4", "laravel/framework": "9", "a/b": "1", "c/d": "1"})
    scenarios = dependencies.with_manifests(projects, rows).select(
        "*", F.lit("laravel").alias("source_framework"), F.lit("symfony").alias("target_framework")
    )
    got = {r.project_id: r for r in dependencies.with_dependency_scores(scenarios).collect()}
    assert (got["p"].php_penalty, got["p"].dependency_compatibility) == (35.0, 40.0)
    assert got["q"].dependency_compatibility == 50.0  # no manifest


def test_php_version_upgrade(spark, manifest):
    projects = spark.createDataFrame([("p",)], "project_id string")
    latest = spark.sql("select '8.3' as latest_php")
    rows = dependencies.with_manifests(projects, manifest({"php": "7.4"}))
    assert dependencies.php_version_upgrade(rows, latest).first().php_version_score == 58.0


def test_outdated_dependencies(spark, manifest):
    packages = manifest({"php": "7.4", "a/a": "^1.0", "b/b": "3.0", "c/c": "2.0", "x/ext": "1"}).selectExpr(
        "project_id", "inline(packages)"
    )
    latest = spark.createDataFrame([("a/a", "1.4.0.0"), ("b/b", "3.0"), ("c/c", "4.0")], "name string, latest_version string")
    joined = dependencies.dependency_registry_join(packages, latest)
    got = {r.name: r.major_gap for r in dependencies.outdated_dependencies(joined).collect()}
    assert got == {"a/a": 0, "c/c": 2}
    projects = spark.createDataFrame([("p", True)], "project_id string, has_manifest boolean")
    score = dependencies.dependency_upgrade(projects, dependencies.outdated_dependencies(joined)).first()
    assert (score.outdated_count, score.dependencies) == (2, 90.0)
