from pathlib import Path

from shiftgauge.operators import inventories, rewrites, schema_graph
from shiftgauge.operators.files import ScanConfig
from shiftgauge.sources import corpus
from shiftgauge.streaming import tallies as streaming
from shiftgauge.operators import features


def test_read_tree(spark, tmp_path):
    for name, text in {"p1/src/a.php": "<?php é", "p2/b.twig": "x", "p1/composer.json": "{}"}.items():
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    got = {(r.project_id, r.path): r.content for r in corpus.read_tree(spark, str(tmp_path)).collect()}
    assert got == {("p1", "src/a.php"): "<?php é", ("p2", "b.twig"): "x", ("p1", "composer.json"): "{}"}
    assert corpus.read_tree(spark, str(tmp_path), "*.php").count() == 1


def test_manifests_keep_order_and_missing_differs_from_empty(spark):
    rows = [
        ("a", '{"require":{"z/z":"1","b/b":null},"require-dev":{"z/z":"2"}}'), ("b", "{}"), ("c", "oops {"), ("d", None),
    ]
    manifests = spark.createDataFrame(rows, "project_id string, content string")
    packages = corpus.manifest_packages(manifests).collect()
    assert [(r.project_id, r.ord, r.section, r.name, r.version_string) for r in packages] == [
        ("a", 1, "require", "z/z", "1"), ("a", 2, "require", "b/b", None), ("a", 3, "require-dev", "z/z", "2"),
    ]
    projects = manifests.select("project_id")
    flags = corpus.with_manifest_flag(projects, corpus.parsed_manifests(manifests)).collect()
    assert {r.project_id: r.has_manifest for r in flags} == {"a": True, "b": True, "c": False, "d": False}


def test_registry_documents(spark):
    text = '{"packages":{"a/a":[{"version_normalized":"1.0.0.0"},{"version_normalized":"1.10.0.0"},{"version_normalized":"1.9.0.0"}],"x/ext-y":[{"version_normalized":"1.0"}]}}'
    registry = corpus.registry_from_json(spark.createDataFrame([(text,)], "content string"))
    assert [tuple(r) for r in corpus.registry_latest(registry).collect()] == [("a/a", "1.10.0.0")]
    releases = spark.createDataFrame([('{"8":{"version":"8.4.2"},"7":{"version":"7.4.33"},"5":{}}',)], "content string")
    assert corpus.latest_runtime(corpus.releases_from_json(releases)).first().latest_php == "8.4.2"


def test_schema_graph(spark):
    columns = spark.createDataFrame(
        [("p", "t", "name", "varchar", 2), ("p", "t", "id", "int", 1), ("p", "u", "id", "bigint", 1)],
        "project_id string, table_name string, column_name string, type string, ordinal int",
    )
    keys = spark.createDataFrame(
        [("p", "t", "k1", "u"), ("p", "t", "k2", "gone")],
        "project_id string, table_name string, fk_name string, foreign_table string",
    )
    labels = {r.table_name: r.label for r in schema_graph.schema_nodes(columns).collect()}
    assert labels == {"t": "{ t | id : INTEGER | name : STRING }", "u": "{ u | id : STRING }"}
    summary = schema_graph.schema_summary(columns, keys).first()
    assert (summary.table_count, summary.edge_count, summary.missing_count) == (2, 1, 1)


def test_sinks(spark, files, tmp_path):
    df = files([("p", "routes.php", "<? $route['a'] = 'x';")])
    inventories.write_routes(inventories.routes(df, ScanConfig()), str(tmp_path / "routes"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "routes")).select("route", "target", "project_id").collect()] == [("a", "x", "p")]
    rewrites.write_rewritten(rewrites.rewritten_files(df, ScanConfig()), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).first().content.startswith("<?php ")


def test_streamed_tallies_equal_batch_tallies(spark, files, tmp_path):
    table = str(tmp_path / "code")
    config = ScanConfig(legacy_dirs=("old",))
    first = [("p", f"src/A{i}.php", "class A extends Model { }") for i in range(5)] + [("q", "old/x.php", "app(1)")]
    second = [("p", f"tests/B{i}.php", "use Illuminate\\X;") for i in range(3)]
    out = str(tmp_path / "tallies")
    for rows in (first, second):
        files(rows).coalesce(1).write.mode("append").parquet(table)
        stream = streaming.stream_tallies(streaming.stream_files(spark, table), config)
        streaming.write_tallies(stream, out, Path(tmp_path).name).awaitTermination()
    batch = features.project_tallies(features.file_features(spark.read.parquet(table), config))
    streamed = streaming.latest_tallies(spark, out).select(batch.columns)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))
