from shiftgauge.operators import detection


def found(manifest_rows, path_rows):
    rows = detection.framework_certainty(manifest_rows, path_rows).collect()
    return {r.framework: (r.certainty, r.version_string) for r in rows}


def test_primary_package_alone(manifest, paths):
    assert found(manifest({"symfony/framework-bundle": "^7.0"}), paths("a")) == {"symfony": (50.0, "^7.0")}


def test_sub_packages_without_the_primary(manifest, paths):
    got = found(manifest({"symfony/console": "^7.0", "symfony/http-kernel": "^6.0"}), paths("a"))
    assert got == {"symfony": (65.0, "^7.0")}


def test_development_packages_count(manifest, paths):
    assert found(manifest(dev={"symfony/framework-bundle": "^7.0"}), paths("a")) == {"symfony": (50.0, "^7.0")}


def test_a_required_version_beats_a_development_one(manifest, paths):
    rows = manifest({"laravel/framework": "10.0"}, {"laravel/framework": "dev-main"})
    assert found(rows, paths("a")) == {"laravel": (50.0, "10.0")}


def test_below_the_threshold(manifest, paths):
    assert found(manifest({"symfony/http-kernel": "^7.0"}), paths("symfony.locker")) == {}
    assert found(manifest({"vendor/thing": "1"}), paths("a")) == {}


def test_unstable_versions_halve_each_weight(manifest, paths):
    both = manifest({"symfony/framework-bundle": "dev-main", "symfony/console": "dev-main"})
    assert found(both, paths("a")) == {"symfony": (45.0, "dev-main")}
    assert found(manifest({"symfony/framework-bundle": "dev-main"}), paths("a")) == {}
    odd = manifest({"symfony/console": "*", "symfony/http-kernel": "*"})  # 20 + 13
    assert found(odd, paths("bin/console")) == {"symfony": (43.0, "*")}


def test_paths_raise_and_replace_packages(manifest, paths):
    both = paths("bin/console", "symfony.lock")
    assert found(manifest({"symfony/framework-bundle": "^7.0"}), both) == {"symfony": (70.0, "^7.0")}
    assert found(manifest({}), both) == {"symfony": (60.0, None)}
    assert found(manifest({}), paths("symfony.lock")) == {}


def test_a_directory_counts_once(manifest, paths):
    rows = paths("vendor/tempest/a.php", "vendor/tempest/b.php", ".tempest/x")
    assert found(manifest({}), rows) == {"tempest": (60.0, None)}


def test_certainty_is_capped(manifest, paths):
    everything = {
        "symfony/framework-bundle": "7", "symfony/console": "7", "symfony/http-kernel": "7",
        "symfony/dependency-injection": "7",
    }
    assert found(manifest(everything), paths("bin/console"))["symfony"][0] == 100.0


def test_ties_go_to_packages_then_to_catalogue_order(manifest, paths):
    tied = manifest({"yiisoft/yii2": "2", "cakephp/cakephp": "4"})
    assert detection.primary_framework(detection.framework_certainty(tied, paths("a"))).first().primary_framework == "yii"
    by_path = paths("bin/console", "symfony.lock")  # symfony 60 by path
    mixed = manifest({"cakephp/cakephp": "4", "cakephp/orm": "*"})  # cakephp 70
    primary = detection.primary_framework(detection.framework_certainty(mixed, by_path)).first()
    assert (primary.primary_framework, primary.certainty) == ("cakephp", 70.0)
