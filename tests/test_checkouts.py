"""Listing and reading of checkouts, and the committed sink."""

from pathlib import Path

import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, IsNotNull, Not, StringContains, StringEndsWith, StringStartsWith

from shiftgauge.operators import files as listings
from shiftgauge.operators.files import ScanConfig, is_walked
from shiftgauge.sources import checkouts
from shiftgauge.sources.corpus import read_tree

CONFIG = ScanConfig(exclude=("vendor", "lib/old"))
TREE = {
    "p/src/A.php": "<?php class A {}", "p/src/vendor/b.php": "x", "p/vendor/deep/er/c.php": "y", "p/lib/old/d.php": "z",
    "p/lib/older/e.php": "é\n", "p/composer.json": "{}", "p/.git/f.php": "g", "p/src/.cache/g.php": "h", "q/i.php": "",
    "q/a b/ü%20.php": "j", "q/old/k.txt": "l", "r/vendor/m.php": "n", "r/CVS/o.php": "p", "stray.php": "no project",
}


@pytest.fixture
def root(tmp_path):
    for path, content in TREE.items():
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(content)
    return str(tmp_path)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_contents_equal_the_plain_reader(spark, root):
    plain = read_tree(spark, root).filter("project_id != 'stray.php'")
    # The plain reader sees neither hidden nor empty files.
    hidden, empty = [("p", ".git/f.php", "g"), ("p", "src/.cache/g.php", "h")], ("q", "i.php", "")
    assert rows(checkouts.read_checkouts(spark, root)) == sorted([*rows(plain), *hidden, empty])
    plain = plain.unionByName(spark.createDataFrame([empty], plain.schema))
    walked = plain.filter(is_walked(F.col("path"), CONFIG))
    assert rows(checkouts.read_checkouts(spark, root, CONFIG)) == rows(walked)
    listed = checkouts.list_checkouts(spark, root, CONFIG, tasks=2)
    assert rows(listings.scan_code_files(listed, CONFIG)) == rows(listings.scan_code_files(plain, CONFIG))
    legacy = ScanConfig(exclude=CONFIG.exclude, legacy_dirs=("lib",))
    assert rows(listings.legacy_split(listed, legacy)) == rows(listings.legacy_split(plain.filter(is_walked(F.col("path"), CONFIG)), legacy))


def test_filters_reach_the_walk(spark, root):
    listed = checkouts.list_checkouts(spark, root)
    some = listed.filter((F.col("project_id") == "p") & F.col("path").startswith("src/") & F.col("path").endswith(".php") & ~F.col("path").startswith("src/."))
    assert rows(some.select("path")) == [("src/A.php",), ("src/vendor/b.php",)]
    assert rows(listed.filter(F.col("path").isin("composer.json", "i.php")).select("project_id", "path")) == [("p", "composer.json"), ("q", "i.php")]
    assert rows(listed.filter("path like '%old%' and bytes = 1").select("path")) == [("lib/old/d.php",), ("old/k.txt",)]
    assert checkouts.list_checkouts(spark, root + "/nowhere").count() == 0


class Counting:
    """A filesystem that notes what is listed and opened."""

    def __init__(self):
        self.inner, self.listed, self.opened = pafs.LocalFileSystem(), [], []

    def get_file_info(self, selector):
        self.listed.append(selector.base_dir)
        return self.inner.get_file_info(selector)

    def open_input_stream(self, path):
        self.opened.append(path)
        return self.inner.open_input_stream(path)


def test_excluded_directories_are_never_listed(root, monkeypatch):
    files = Counting()
    monkeypatch.setattr(checkouts, "_filesystem", lambda location: (files, location))
    reader = checkouts.CheckoutReader({"path": root, "exclude": '["vendor", "/lib/old/"]', "hidden": "false"})
    left = list(reader.pushFilters([StringEndsWith(("path",), ".php"), IsNotNull(("path",)), StringContains(("path",), "x")]))
    assert [type(f) for f in left] == [IsNotNull, StringContains]
    found = [r["path"] for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
    assert sorted(found) == ["CVS/o.php", "a b/ü%20.php", "i.php", "lib/older/e.php", "src/A.php"]
    inside = [d.removeprefix(root) for d in files.listed]
    assert not [d for d in inside if "vendor" in d or d.endswith("/old") and "lib" in d or "/." in d]
    assert files.opened == []

    files.listed.clear()
    reader = checkouts.CheckoutReader({"path": root})
    assert not list(reader.pushFilters([EqualTo(("project_id",), "p"), StringStartsWith(("path",), "src/A"), Not(StringStartsWith(("path",), "src/v"))]))
    assert [r["path"] for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()] == ["src/A.php"]
    assert [d.removeprefix(root) for d in files.listed] == ["", "/p", "/p/src"]


def test_only_listed_files_are_opened(spark, root):
    """Everything else may be gone by the time contents are read."""
    listed = checkouts.list_checkouts(spark, root, CONFIG).filter(F.col("path").endswith(".php"))
    wanted = rows(checkouts.read_contents(listed, root, tasks=3))
    for path in TREE:
        if "vendor" in path or "lib/old/" in path or "/." in path:
            (Path(root) / path).unlink()
    assert rows(checkouts.read_contents(listed, root, tasks=3)) == wanted


def test_committed_files_are_read_once(spark, tmp_path):
    place = str(tmp_path / "sink")
    schema = "project_id string, path string, content string"
    made = lambda n, text: spark.range(n).selectExpr("'p' as project_id", "concat('f', id) as path", f"'{text}' as content")
    assert checkouts.read_committed(spark, place, schema).count() == 0
    checkouts.write_committed(made(100, "a").repartition(5), place)
    assert rows(checkouts.read_committed(spark, place, schema)) == rows(made(100, "a"))
    checkouts.write_committed(made(3, "b"), place, "append")
    assert checkouts.read_committed(spark, place, schema).groupBy("content").count().orderBy("content").collect() == [("a", 100), ("b", 3)]
    checkouts.write_committed(made(2, "c"), place)
    assert rows(checkouts.read_committed(spark, place, schema)) == rows(made(2, "c"))
    checkouts.write_committed(made(0, "d"), place)
    assert checkouts.read_committed(spark, place, schema).count() == 0


def test_failed_and_repeated_attempts_leave_nothing_behind(spark, tmp_path):
    place = str(tmp_path / "sink")
    writer = checkouts.TreeWriter(place, True)
    batch = pa.RecordBatch.from_pydict({"path": [f"f{i}" for i in range(10)]})
    other = pa.RecordBatch.from_pydict({"path": ["g"]})

    def dies():
        yield batch
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(dies())
    slow, speculative = writer.write(iter([batch])), writer.write(iter([batch]))
    writer.commit([speculative, writer.write(iter([other])), writer.write(iter([])), None])
    found = checkouts.read_committed(spark, place, "path string")
    assert rows(found) == sorted([(f"f{i}",) for i in range(10)] + [("g",)])
    again = checkouts.TreeWriter(place, False)
    again.abort([again.write(iter([batch])), slow])
    assert rows(checkouts.read_committed(spark, place, "path string")) == rows(found)
    assert not list(Path(place).glob("*.draft"))


def test_a_failed_job_keeps_what_was_committed(spark, tmp_path):
    place = str(tmp_path / "sink")
    checkouts.write_committed(spark.range(5).selectExpr("cast(id as string) as path"), place)
    broken = spark.range(0, 100, 1, 4).selectExpr("if(id = 99, raise_error('lost'), cast(id as string)) as path")
    with pytest.raises(Exception, match="lost"):
        checkouts.write_committed(broken, place)
    assert checkouts.read_committed(spark, place, "path string").count() == 5
