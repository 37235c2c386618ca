from shiftgauge.operators import features, inventories, rewrites
from shiftgauge.operators import files as listings
from shiftgauge.operators.files import ScanConfig

CONFIG = ScanConfig(exclude=("vendor", "a/b"), legacy_dirs=("old", "old/cms"))


def listing(files_df, config=CONFIG):
    rows = listings.legacy_split(files_df, config).collect()
    return sorted((r.path, r.legacy_dir or "") for r in rows)


def test_listings(files):
    df = files(
        [("p", path, "") for path in (
            "x.php", "x.PHP", "vendor/x.php", "src/vendor/x.php", "a/b/x.php", "c/a/b/x.php", "a/bb/x.php",
            ".git/x.php", "src/.x.php", "old/x.php", "old/cms/x.php", "old/vendor/x.php", "src/old/x.php", "vendor.php",
        )]
    )
    assert listing(df) == [
        ("a/bb/x.php", ""), ("old/cms/x.php", "old"), ("old/cms/x.php", "old/cms"), ("old/x.php", "old"),
        ("vendor.php", ""), ("x.php", ""),
    ]


def test_excludes_apply_below_the_legacy_directory(files):
    df = files([("p", "vendor/old/x.php", ""), ("p", "a/b/x.php", "")])
    assert listing(df, ScanConfig(exclude=("a",), legacy_dirs=("a/b", "vendor"))) == [
        ("a/b/x.php", "a/b"), ("vendor/old/x.php", "vendor"),
    ]


def test_template_lists(files):
    df = files([("p", p, "") for p in ("views/a.php", "x/Views/a.php", "x/view/a.blade.php", "a.twig", "vendor/a.tpl")])
    rows = sorted((r.path, r.list_no) for r in listings.template_files(df, CONFIG).collect())
    assert rows == [("a.twig", 0), ("x/Views/a.php", 1), ("x/view/a.blade.php", 0), ("x/view/a.blade.php", 1)]


def test_tallies_count_files_once_per_listing(files):
    model = "<?php use Illuminate\\X; class A extends Model { function f() { return app(1); } }"
    df = files([("p", "a.php", model), ("p", "old/cms/b.php", model), ("p", "x/views/c.blade.php", "<?php ?>")])
    row = features.project_tallies(features.file_features(df, CONFIG)).first()
    assert (row.file_count, row.legacy_count, row.template_count) == (2, 2, 2)
    assert (row.coupled_laravel, row.heavy_laravel, row.legacy_coupled_laravel) == (1, 0, 2)
    assert (row.db_eloquent, row.signals) == (1, 2)


def test_extra_features_need_no_change_to_the_plan(files):
    from pyspark.sql import functions as F

    df = files([("p", "a.php", "goto x;"), ("p", "b.php", "")])
    found = features.file_features(df, CONFIG, extra={"has_goto": lambda content, path: F.contains(content, F.lit("goto "))})
    row = features.project_tallies(found, extra={"gotos": lambda: F.count_if("has_goto")}).first()
    assert row.gotos == 1


def test_short_tags(files):
    df = files([
        ("p", "a.php", '<? echo "Hello"; ?>'), ("p", "b.php", "<?php <? x"), ("p", "c.php", "a <?xml <?= 1 <?php <?"),
        ("p", "d.txt", "<? x"),
    ])
    got = {r.path: (r.content, r.changed) for r in rewrites.short_tag_rewrite(df).collect()}
    assert got == {
        "a.php": ('<?php  echo "Hello"; ?>', True),
        "b.php": ("<?php <? x", False),
        "c.php": ("a <?xml <?php = 1 <?php <?php ", True),
    }
    kept = {r.path: r.content for r in rewrites.short_tag_rewrite(df, keep_echo_tags=True).collect()}
    assert kept["c.php"] == "a <?xml <?= 1 <?php <?php "


def test_class_name_sync_renames_the_first_class_only(files):
    df = files([
        ("p", "New.php", "subclass Old; class  Old {} class Old {}"), ("p", "Same.php", "class Same {}"),
        ("p", "no.php", "<?php"), ("p", "a$1.php", "x class B {}"),
    ])
    got = {r.path: r.content for r in rewrites.class_name_sync(df, CONFIG).collect()}
    assert got == {"New.php": "subclass Old; class New {} class Old {}", "a$1.php": "x class a$1 {}"}
    changed = {r.path: r.content for r in rewrites.rewritten_files(df, CONFIG).collect()}
    assert changed == got


def test_class_split_plan(files):
    two = "<?php\nnamespace App\\Foo;\nclass FirstClass {}\nclass second_class extends X {}"
    df = files([("p", "src/Classes.php", two), ("p", "src/Other.php", two), ("p", "src/One.php", "class One {}"),
                ("p", "src/SecondClass.php", "")])
    rows = inventories.class_split_plan(df, CONFIG).collect()
    got = sorted((r.path, r.new_name, r.target_path, r.namespace, r.written) for r in rows)
    assert got == [
        ("src/Classes.php", "FirstClass", "src/FirstClass.php", "App\\Foo", True),
        ("src/Classes.php", "SecondClass", "src/SecondClass.php", "App\\Foo", False),
        ("src/Other.php", "FirstClass", "src/FirstClass.php", "App\\Foo", False),
        ("src/Other.php", "SecondClass", "src/SecondClass.php", "App\\Foo", False),
    ]
    census = inventories.multi_class_census(df, CONFIG).first()
    assert (census.class_count, census.multi_class_files) == (5, 2)


def test_braceless_ifs(files):
    code = "if (1) echo 1; if (f(2)) { x(); } if (3): endif; elseif (4) y(); notif (5) z; if (a) if (b) c();"
    assert inventories.braceless_if_census(files([("p", "a.php", code)])).first().braceless_ifs == 3


def test_routes(files):
    code = "$route['a'] = 'x';\n$route['b'] = 'y'; $route['a'] = 'z';"
    df = files([("p", "cfg/routes.php", code), ("p", "cfg/my_routes.php", code), ("p", "zz/routes.php", "$route['b'] = 'last';")])
    found = inventories.routes(df, CONFIG)
    assert inventories.route_count(found).first().route_count == 4
    assert {r.route: r.target for r in inventories.routes_dump(found).collect()} == {"a": "z", "b": "last"}


def test_directory_plans(files, spark):
    df = files([("p", p, "") for p in ("my-dir/sub_dir/a.php", "My_Dir/a.php", "MyDir/a.php", "ok/x/b.txt", "Fine/c.php")])
    plan = inventories.directory_rename_plan(df, df.select("project_id", "path"), CONFIG)
    got = {r.dir: (r.new_dir, r.conflict) for r in plan.collect()}
    assert got == {
        "my-dir": ("MyDir", True), "My_Dir": ("MyDir", True), "my-dir/sub_dir": ("my-dir/SubDir", False),
    }
    order = [r.depth for r in inventories.directory_order(df, CONFIG).collect()]
    assert order == sorted(order, reverse=True)
    capital = {r.dir: r.new_dir for r in inventories.directory_capitalise_plan(df, CONFIG).collect()}
    assert capital == {"my-dir/sub_dir": "my-dir/Sub_Dir", "ok/x": "ok/X"}
    spaces = {r.namespace: r.path for r in inventories.namespace_map(df, CONFIG).collect()}
    assert spaces["my-dir\\sub_dir"] == "my-dir/sub_dir"


def test_own_signatures(files):
    from shiftgauge.operators import scoring
    from pyspark.sql import functions as F

    packs = {"wordpress": {"helper": ["add_action(", "get_post_meta("], "facade": ["WP_Query"]}}
    df = files([("p", "a.php", "add_action(1); add_action(2); new WP_Query; get_post_meta(1);"), ("p", "b.php", "x")])
    row = features.project_tallies(features.file_features(df, CONFIG, packs), packs).select(
        "coupled_wordpress", "heavy_wordpress", "file_count",
        F.lit("wordpress").alias("source_framework"), F.lit("symfony").alias("target_framework"),
    )
    assert row.first()[:3] == (1, 1, 2)
    assert row.select(scoring.framework_coupling_score(packs)).first()[0] == 13.53
