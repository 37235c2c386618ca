"""The fitted operators: gradients, held-out accuracy, odd rows; the pipeline against its parts; SQL of the queries."""

import time
import tracemalloc
import zlib

import duckdb
import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from shiftgauge.llm import common, ordinal_quality, queries, toxicity  # noqa: E402
from shiftgauge.llm.labelled import held_out, labelled_sample  # noqa: E402

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_gradients_of_the_network():
    net = toxicity.Network(3)
    net.w = {k: v.astype(np.float64) if k not in ("word", "character") else v for k, v in net.w.items()}
    draw = np.random.default_rng(1)
    inputs = draw.normal(size=(5, 4, toxicity.INPUT))
    mask = np.ones((5, 4), bool)
    mask[3:, 1] = mask[1:, 2] = False
    labels = np.array([1.0, 0, 1, 0])

    def loss(x):
        gates = [x @ net.w[f"in_{s}"] + net.w[f"bias_{s}"] for s in ("f", "b")]
        z = net.logits(*gates, mask).astype(np.float64)
        return np.mean(np.logaddexp(0, z) - labels * z)

    grads, by_input = net.gradients(inputs, mask, labels)
    step = 1e-2
    for name in ("in_f", "rec_f", "rec_b", "bias_b", "attend", "attend_out", "out"):
        weight = net.w[name]
        for at in list(np.ndindex(weight.shape))[:: max(1, weight.size // 5)]:
            before = weight[at]
            weight[at] = before + step
            up = loss(inputs)
            weight[at] = before - step
            slope = (up - loss(inputs)) / (2 * step)
            weight[at] = before
            assert abs(slope - grads[name][at]) < 2e-3, (name, at)
    moved = inputs.copy()
    moved[0, 0, 0] += step
    assert abs((loss(moved) - loss(inputs)) / step - by_input[0, 0, 0]) < 2e-3


def test_windows_overlap_and_reach_the_end():
    assert toxicity.window_starts(0).tolist() == [] and toxicity.window_starts(3).tolist() == [0]
    assert toxicity.window_starts(16).tolist() == [0] and toxicity.window_starts(17).tolist() == [0, 1]
    assert toxicity.window_starts(40).tolist() == [0, 8, 16, 24]


def made_texts(n):
    draw = np.random.default_rng(2)
    vocabulary = [f"word{i}" for i in range(200)]
    texts, labels = [], []
    for i in range(n):
        words = draw.choice(vocabulary, 80).tolist()
        if i % 4 == 0:
            words[draw.integers(80)] = draw.choice(["grubazo", "grubelon", "skarnif"])
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    return texts, labels


def test_toxic_words_are_found_anywhere_in_unseen_texts():
    texts, labels = made_texts(500)
    net = toxicity.fit_calibrated(texts[:400], labels[:400], {0: 300, 1: 100})
    scorer = toxicity.Scorer(net)
    scores = scorer.score(texts[400:])
    assert np.mean((scores >= toxicity.TOXIC_FROM) == np.array(labels[400:], bool)) >= 0.95
    clean = " ".join(t for t, y in zip(texts, labels, strict=True) if not y)
    late = scorer.score([clean[:60_000], clean[:60_000] + " grubazo " + clean[:60_000]])
    assert late[1] > late[0]


def test_long_runs_count_whole():
    run = "".join(chr(0x4E00 + i) for i in range(1001))
    cut = toxicity.text_words(f"one {run} two")
    assert cut[0] == "one" and cut[-1] == "two" and max(map(len, cut)) == 40
    assert all(any(run[i : i + 5] in piece for piece in cut) for i in range(len(run) - 4))
    texts, labels = made_texts(500)
    scorer = toxicity.Scorer(toxicity.fit(texts, labels))
    clean = "_".join(f"word{i}" for i in range(60))
    scores = scorer.score([clean, f"{clean}_grubazo_{clean}"])
    assert scores[1] > scores[0]


def test_scores_do_not_depend_on_the_batch():
    texts, labels = made_texts(120)
    scorer = toxicity.Scorer(toxicity.fit(texts, labels, epochs=2))
    odd = [None, "", "...", "one", "a b c", *texts[:20], " ".join(texts)]
    together = scorer.score(odd)
    assert together[:3].tolist() == [0, 0, 0]
    assert np.allclose(together, [scorer.score([t])[0] for t in odd], atol=1e-4)


def test_held_out_rows_are_never_fitted(spark):
    docs = queries.table(spark, MIDDLE, "documents")
    labels = queries.table(spark, MIDDLE, "labels")
    kept = labels.filter(~held_out("doc_id"))
    sample, sizes = labelled_sample(docs, labels, labels["toxic"], 10_000, 1_000_000)
    assert sum(sizes.values()) == len(sample) == kept.count() < labels.count()
    few, _ = labelled_sample(docs, labels, labels["toxic"], 5, 1_000_000)
    assert len(few) == 10


@pytest.mark.parametrize("empty", ["docs", "labels", "neither"])
def test_fitted_queries_of_odd_rows(spark, empty):
    rows = [(i, f"plain text number {i} about things", 0) for i in range(8)] + [(None, None, 0), (3, "", 1), (3, "", 1)]
    marks = [(i, i % 2, (i + 1) % 2, "x") for i in range(8)] + [(None, 1, 1, "x"), (5, None, None, "x"), (77, 1, 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int, text string")
    docs, labels = docs.limit(0) if empty == "docs" else docs, labels.limit(0) if empty == "labels" else labels
    scored = toxicity.toxicity(docs, labels).collect()
    graded = ordinal_quality.ordinal_quality(docs, labels).collect()
    assert len(scored) == len(graded) == (0 if empty == "docs" else len(rows))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= toxicity.TOXIC_FROM) for r in scored)
    if empty == "labels":
        assert not any(r["predicted"] for r in scored) and all(r["kept"] for r in graded)


def test_labelled_sample_takes_repeated_ids_once(spark):
    docs = spark.createDataFrame([(4, t) for t in ("b", "c", "a", None)] * 50 + [(5, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 0)], "doc_id long, mark int")
    sample, sizes = labelled_sample(docs, labels, labels["mark"], 10, 100)
    fitted = [i for i in (4, 5) if not zlib.crc32(str(i).encode()) % 4 == 2]
    assert sample == [{4: ("c", 1), 5: ("d", 0)}[i] for i in fitted] and sum(sizes.values()) == len(fitted) > 0


def test_names_are_new(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Key int, key_ int, other int")
    assert common.new_name(df, "key") == "key__" and common.new_name(df, "mine") == "mine"


def tables_with(spark, folder, docs):
    """A folder with the small labels and benchmark, and the documents given."""
    for name in ("labels", "benchmark"):
        queries.table(spark, SMALL, name).write.parquet(f"{folder}/{name}.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_stages_of_odd_rows(spark, tmp_path):
    """Nulls, repeats, ties, long texts and columns with the stages' own names: rows are judged by their text alone."""
    small = queries.table(spark, SMALL, "documents").filter("text is not null").orderBy("doc_id").limit(60).collect()
    item = max((r["text"] for r in queries.table(spark, SMALL, "benchmark").collect()), key=len)
    plain = [" ".join(f"{w}{i}" for w in "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for i in range(4)]
    rows = [(r["doc_id"], r["text"]) for r in small]
    rows += [(None, plain[0]), (None, plain[0]), (7000, plain[1]), (7000, plain[1]), (7000, plain[2]), (None, plain[2])]
    rows += [(None, None), (None, ""), (7001, None), (None, f"{plain[3]} {item}"), (7002, f"{plain[3]} {item}"), (7002, "word " * 60_000)]
    schema = "doc_id long, text string, graded string, __score int, row_key int, Copy_Key int, copy_id string, component_id int, first int"
    docs = spark.createDataFrame([(*r, "g", 1, 2, 3, "c", 4, 5) for r in rows], schema).repartition(3)
    folder = tables_with(spark, tmp_path, docs)
    texts = lambda df: sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in df.collect()))

    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
        assert stage(spark, docs.limit(0), folder).count() == 0
    copies = corpus_pipeline.copies_out(spark, docs, folder)
    left = [r for r in texts(copies) if r[2] in (plain[0], plain[1], plain[2])]
    assert left == [(False, 7000, plain[1]), (False, 7000, plain[2]), (True, 0, plain[0])]
    assert sum(not r[2] for r in texts(copies)) == 3
    clean = texts(corpus_pipeline.benchmark_out(spark, docs, folder))
    assert not any(item in r[2] for r in clean) and (False, 7002, "word " * 60_000) in clean
    assert [r for r in clean if r[2] in plain] == [r for r in texts(docs) if r[2] in plain]
    assert sum(not r[2] for r in texts(corpus_pipeline.toxic_out(spark, docs, folder))) == 3
    coded = corpus_pipeline.tokens(spark, docs, folder).collect()
    assert len(coded) == len(rows) and sum(r["n_tokens"] == 0 for r in coded) == 3
    assert all(r["exact"] for r in coded)


def test_stages_leave_whole_rows_where_they_are(spark, tmp_path, monkeypatch):
    """Rows that stay are told by bitmaps, not by a shuffle of their texts; past the limit of bitmaps the rows are the same."""
    docs = queries.table(spark, SMALL, "documents").repartition(3)
    folder = tables_with(spark, tmp_path, docs)
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for stage in (corpus_pipeline.copies_out, corpus_pipeline.benchmark_out):
            left = stage(spark, docs, folder)
            plan = left._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
            with monkeypatch.context() as limit:
                limit.setattr(common, "MOST_BITMAPS", 0)
                shuffled = stage(spark, docs, folder)
                assert sorted(map(str, shuffled.collect())) == sorted(map(str, left.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)


def test_stored_rows_leave_no_shuffle_files(spark):
    kept = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").count("shuffle_")
    before, setting = kept(), spark.conf.get(common.SHUFFLES_GO)
    rows = common.stored(spark.range(1000).repartition(5, "id"), "rows")
    ends = time.monotonic() + 10
    while kept() > before and time.monotonic() < ends:
        time.sleep(0.1)
    assert kept() <= before and rows.count() == 1000 and spark.conf.get(common.SHUFFLES_GO) == setting


def test_rows_with_numbers_of_several_bitmaps(spark):
    numbers = [0, 1, 7, 8, 32_767, 32_768, 32_769, 65_536, (1 << 33) - 1, 1 << 33, (5 << 33) + 12]
    rows = spark.createDataFrame([(n, str(n)) for n in [*numbers, *numbers[:2], None]], "row_key long, marks string")
    for held in (numbers[::2], numbers[1::2], [], numbers):
        keys = spark.createDataFrame([(n,) for n in held], "found long")
        wanted = [n for n in [*numbers, *numbers[:2]] if n in held]
        assert sorted(r["row_key"] for r in common.rows_with(rows, "row_key", keys).collect()) == sorted(wanted)
        others = common.rows_with(rows, "row_key", keys, among=False).collect()
        assert len(others) == rows.count() - len(wanted) and not {r["row_key"] for r in others} & set(held)


def test_fits_hold_little_besides_their_tables():
    draw = np.random.default_rng(1)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    texts = [" ".join("".join(draw.choice(letters, 14)) for _ in range(600)) for _ in range(40)]
    lexicon = toxicity.Lexicon([*texts, " "])
    net = toxicity.Network()
    tracemalloc.start()
    try:
        vectors = lexicon.vectors(net)
        assert tracemalloc.get_traced_memory()[1] < len(lexicon.grams) * 4 * toxicity.INPUT  # a vector for each n-gram
        words = [0, 5, len(lexicon.bucket) - 1]
        known = np.ones(len(words), bool)
        assert np.array_equal(vectors[words], toxicity.vectors_of(net, lexicon, np.array(words), len(lexicon.bucket), known))
        assert not vectors[-1].any()
        tracemalloc.reset_peak()
        ordinal_quality.fit(texts * 10, [0, 1] * 200)
        assert tracemalloc.get_traced_memory()[1] < 2 * 400 * 4 * ordinal_quality.BUCKETS  # the features of all texts once
    finally:
        tracemalloc.stop()


def test_ordinal_model_orders_grades():
    draw = np.random.default_rng(3)
    texts, grades = [], []
    for _ in range(300):
        grade = int(draw.integers(0, 4))
        words = draw.choice(["alpha", "beta", "gamma"], 40 - 10 * grade).tolist() + draw.choice(["###", "%%%"], 10 * grade).tolist()
        texts.append(" ".join(draw.permutation(words)))
        grades.append(3 - grade)
    model = ordinal_quality.fit(texts[:200], grades[:200])
    assert np.all(np.diff(model.thresholds) > 0)
    tails = model.tails(model.score(texts[200:]))
    assert np.all(np.diff(tails, axis=1) <= 0)
    assert np.mean(np.abs(model.expected(tails) - np.array(grades[200:]))) < 0.5


def test_scores_of_pieces_add_up(monkeypatch):
    weights = np.random.default_rng(0).normal(size=ordinal_quality.BUCKETS).astype(np.float32)
    text = "some longer text with ### marks and repeated repeated words é " * 30
    whole = ordinal_quality.weighted(text, weights)
    assert abs(whole - ordinal_quality.features(text) @ weights) < 1e-3
    monkeypatch.setattr(ordinal_quality, "PIECE_BYTES", 100)
    assert abs(whole - ordinal_quality.weighted(text, weights)) < 1e-6


def test_quality_of_unseen_documents(spark):
    graded = queries.op6_ordinal_quality(spark, MIDDLE)
    unseen = queries.table(spark, MIDDLE, "labels").filter(held_out("doc_id"))
    joined = graded.join(unseen, "doc_id").collect()
    assert np.mean([r["kept"] == bool(r["quality"]) for r in joined]) >= 0.95


def test_pipeline_is_its_stages_one_after_the_other(spark):
    docs = queries.table(spark, SMALL, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    step = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = step
        step = stage(spark, step, SMALL)
        assert step.columns == docs.columns
        assert {r["doc_id"] for r in step.select("doc_id").collect()} <= {r["doc_id"] for r in before.select("doc_id").collect()}
    kept = {r["doc_id"] for r in step.select("doc_id").collect()}
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"] for r in rows} == kept and 0 < len(kept) < len(texts)
    assert all(r["exact"] and r["n_tokens"] == len(r["ids"]) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    expected = connection.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in expected.description]
    got = queries.queries()[name](spark, SMALL)
    assert sorted(got.columns) == sorted(columns)
    order = lambda rows: sorted(rows, key=str)
    assert order(tuple(r) for r in got.select(*columns).collect()) == order(expected.fetchall())
