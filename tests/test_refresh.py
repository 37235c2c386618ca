"""Tallies that follow changes, against counting everything anew."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import TESTDATA
from shiftgauge.operators import features
from shiftgauge.operators.files import ScanConfig
from shiftgauge.plans import migration, refresh, upgrade
from shiftgauge.sources import checkouts
from shiftgauge.sources.corpus import Corpus
from shiftgauge.sources.fixtures import load_corpus
from shiftgauge.streaming import keyed

CONFIG = ScanConfig(legacy_dirs=("system/cms", "system"))


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


def full(files):
    return features.project_tallies(features.file_features(files, CONFIG))


@pytest.fixture(scope="module")
def texts(spark):
    files = load_corpus(spark, str(TESTDATA / "sf0.001")).files
    return {(r.project_id, r.path): r.content for r in files.collect()}


def test_a_refresh_reads_changed_files_only(spark, texts, tmp_path):
    root, store = tmp_path / "root", str(tmp_path / "store")
    for (project, path), content in texts.items():
        (root / project / path).parent.mkdir(parents=True, exist_ok=True)
        (root / project / path).write_bytes(content.encode())
    first = refresh.refresh(spark, str(root), store, CONFIG)
    assert rows(first) == rows(full(checkouts.read_checkouts(spark, str(root), CONFIG)))
    now = dict(texts)
    changed = sorted(texts)[::100]
    for project, path in changed:
        now[project, path] = "<?php class New extends Controller { function f() { return view(1); } }"
        (root / project / path).write_text(now[project, path])
    gone, new = sorted(texts)[1], ("fresh", "app/New.php")
    (root / "/".join(gone)).unlink()
    del now[gone]
    now[new] = "<?php class X extends CI_Model {}"
    (root / "fresh/app").mkdir(parents=True)
    (root / "fresh/app/New.php").write_text(now[new])
    # Other files keep their stamp, so nobody sees what is in them.
    for project, path in set(texts) - {*changed, gone}:
        file: Path = root / project / path
        stamp, size = file.stat(), file.stat().st_size
        file.write_bytes(b"?" * size)
        os.utime(file, ns=(stamp.st_atime_ns, stamp.st_mtime_ns))
    listed = features.on_listings(checkouts.list_checkouts(spark, str(root), CONFIG), CONFIG)
    known = refresh.stored_numbers(spark, store)
    seen = {(r.project_id, r.path) for r in refresh.changed_files(listed, known).collect()}
    assert seen <= {*changed, new} and new in seen
    schema = "project_id string, path string, content string"
    files = spark.createDataFrame([(*k, v) for k, v in now.items()], schema)
    again = refresh.refresh(spark, str(root), store, CONFIG)
    assert rows(again) == rows(full(files))
    assert refresh.changed_files(listed, refresh.stored_numbers(spark, store)).count() == 0
    assert rows(refresh.refresh(spark, str(root), store, CONFIG)) == rows(full(files))
    check_reports(spark, files, again)


def check_reports(spark, files, tallies):
    """Both reports out of the stored tallies are those of a full run."""
    c = load_corpus(spark, str(TESTDATA / "sf0.001"))
    projects = files.select("project_id").distinct()
    corpus = Corpus(projects=projects, files=files, paths=files.select("project_id", "path"), manifests=c.manifests, registry=c.registry, releases=c.releases)
    counted = features.complete_tallies(projects, tallies)
    pairs = [(None, "symfony"), ("codeigniter", "laravel")]
    assert rows(migration.migration_report(corpus, CONFIG, pairs, counted=counted)) == rows(migration.migration_report(corpus, CONFIG, pairs))
    assert rows(upgrade.upgrade_report(corpus, CONFIG, counted)) == rows(upgrade.upgrade_report(corpus, CONFIG))


def test_events_that_repeat_replace_and_delete(spark, texts, tmp_path):
    place, out = str(tmp_path / "events"), str(tmp_path / "out")
    some = [(*k, v) for k, v in sorted(texts.items())][:120]
    event = lambda r, version, content=..., deleted=False: (r[0], r[1], r[2] if content is ... else content, version, deleted)
    new = "<?php class New extends CI_Controller { function f() { redirect(1); redirect(2); redirect(3); redirect(4); } }"
    batches = [
        [event(r, 5) for r in some],
        [event(r, 5) for r in some[:50]] + [event(r, 6, new) for r in some[:10]] + [event(r, 6, None, True) for r in some[10:20]],
        [event(r, 4, new) for r in some[20:30]] + [event(r, 5) for r in some[10:20]] + [event(r, 7) for r in some[:5]] + [event(r, 7) for r in some[:5]]
        + [event(r, 8, new) for r in some[10:12]] + [event(r, 9, new) for r in some[30:35]] + [event(r, 8, "late") for r in some[30:35]],
    ]
    now = {r[:2]: r[2] for r in some}
    now |= {r[:2]: new for r in [*some[5:10], *some[10:12], *some[30:35]]}
    for r in some[12:20]:
        del now[r[:2]]
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, keyed.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(place)
        differences = keyed.file_differences(keyed.stream_events(spark, place), CONFIG)
        keyed.write_differences(differences, out, f"keyed-{tmp_path.name}").awaitTermination()
        if i == 0:
            files = spark.createDataFrame(some, "project_id string, path string, content string")
            assert rows(keyed.current_tallies(spark, out)) == rows(full(files))
    files = spark.createDataFrame([(*k, v) for k, v in now.items()], "project_id string, path string, content string")
    expected = full(files)
    assert rows(keyed.current_tallies(spark, out)) == rows(expected)
    assert expected.filter(F.col("coupled_codeigniter") > 0).count() > 0
