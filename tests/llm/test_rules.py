"""Rules, near copies, contained items, licences and quotes against brute force."""

import random
import re

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from shiftgauge.llm import decontamination, licences, near_dedup, quality_rules, queries, quote_links  # noqa: E402
from shiftgauge.llm.components import components  # noqa: E402

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, n):
    words = WORD.findall(lowered(text))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def true_components(docs, n):
    """Smallest id reachable by links, by comparing all pairs."""
    sets = [(i, shingles(t, n)) for i, t in docs]
    parent = {i: i for i, _ in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    return {i: (len(s), find(i)) for i, s in sets}


def made_copies():
    draw = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = []
    for group in range(12):
        base = [draw.choice(vocabulary) for _ in range(60 + 10 * group)]
        for _ in range(25):
            words = list(base)
            for _ in range(draw.randrange(0, 9)):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
            docs.append(" ".join(words))
    docs += ["", " \n ", "Alone", "alone", "ALONE two", None, "a b a b a b", "A b"] + [docs[0]] * 40
    return list(enumerate(docs))


@pytest.mark.parametrize("n", [2, 5])
def test_near_copies_of_made_groups(spark, n):
    docs = made_copies()
    df = spark.createDataFrame([(i, t, "x", i) for i, t in docs], "doc_id long, text string, set_key string, id long")
    rows = near_dedup.near_dedup(df, n=n).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == true_components(docs, n)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    assert near_dedup.near_dedup(df.limit(0), n=n).count() == 0


def test_near_copies_of_documents(spark):
    docs = [tuple(r) for r in queries.table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    rows = queries.op7_near_dedup(spark, SMALL).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == true_components(docs, 2)


def test_near_copies_with_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (None, "other words here"), (7, "a b c d e f"), (7, "a b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r["doc_id"] or 0), r["component_id"] or 0, r["kept"]) for r in near_dedup.near_dedup(df, n=2).collect())
    assert found == [(0, 0, True), (0, 7, False), (0, 7, False), (7, 7, True), (7, 7, True)]


def test_regions_have_common_levels():
    paths = np.zeros((1000, 9), np.uint16)
    paths[500:, 5] = 1  # beyond the levels of a region
    paths[900:, 2] = 1
    paths[999, 0] = 1
    assert list(near_dedup.regions(paths)) == [(0, 900), (900, 999)]


def test_sketches_agree_as_their_minima():
    draw = np.random.default_rng(4)
    a = draw.integers(0, 1 << 32, near_dedup.SIGNATURE, dtype=np.uint32)
    b = np.where(draw.random(near_dedup.SIGNATURE) < 0.5, a, draw.integers(0, 1 << 32, near_dedup.SIGNATURE, dtype=np.uint32))
    both = np.array([np.frombuffer(near_dedup.sketch_of(x), "<u8") for x in (a, b)])
    assert near_dedup.agreeing(both[:1], both[1]).tolist() == [int(((a >> 3 & 15) == (b >> 3 & 15)).sum())]
    assert near_dedup.agreeing(both, both).tolist() == [near_dedup.SIGNATURE] * 2


def test_counts_of_unlike_minima_in_columns(spark):
    draw = np.random.default_rng(5)
    a, b = (draw.integers(0, 1 << 64, (50, 1), dtype=np.uint64) for _ in range(2))
    b[::2] ^= a[::2] & np.uint64(0xF0F0FF0000FF0000)
    rows = np.concatenate([a, b], axis=1).view(np.int64).tolist()
    df = spark.createDataFrame(rows, "a long, b long").select(near_dedup.unlike_column("a", "b").alias("n"))
    assert [r["n"] for r in df.collect()] == (near_dedup.SIGNATURE - near_dedup.agreeing(a, b)).tolist()


def test_far_documents_of_a_crowded_region_are_compared(spark):
    """A row outside the largest component meets every other row, however many stand between."""
    label = bytes(16)
    near, far = bytes(near_dedup.SKETCH), bytes([17] * near_dedup.SKETCH)
    rows = [(0, label, 1, far, 1)] + [(0, label, i, near, 2) for i in range(2, 900)] + [(0, label, 900, far, 900)]
    ordered = spark.createDataFrame(rows, "place int, label binary, id long, sketch binary, component long").coalesce(1)
    assert sorted(map(tuple, near_dedup.across(near_dedup.looked_across(ordered)).collect())) == [(1, True), (900, True)]


@pytest.fixture
def many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "80")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_near_copies_with_more_partitions_than_rows(spark, many_partitions):
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join([*words[:k], f"x{i}", *words[k:]])) for i, k in enumerate((10, 40))] + [(9, "quite another text")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = near_dedup.near_dedup(df, n=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {i: c for i, (_, c) in true_components(docs, 2).items()}
    assert sum(r["kept"] for r in rows) == 2


def test_regions_that_cross_partitions_are_whole(spark):
    near, far = bytes(near_dedup.SKETCH), bytes([17] * near_dedup.SKETCH)
    rows = [(0, bytes(16), 1, far, 1)] + [(0, bytes(16), i, near, 2) for i in range(2, 900)] + [(0, bytes(16), 900, far, 900)]
    ordered = spark.createDataFrame(rows, "place int, label binary, id long, sketch binary, component long").repartitionByRange(9, "id")
    assert sorted(map(tuple, near_dedup.across(near_dedup.looked_across(ordered)).collect())) == [(1, True), (900, True)]


def test_crowded_regions_are_not_cut(spark):
    """Rows that agree on three levels meet, though 900 rows stand in their region and their further levels differ."""
    near, far = bytes(near_dedup.SKETCH), bytes([17] * near_dedup.SKETCH)
    rows = [(0, bytes(16), 1, far, 1)] + [(0, bytes(16), i, near, 2) for i in range(2, 900)] + [(0, bytes(8) + b"\1" * 8, 900, far, 900)]
    ordered = spark.createDataFrame(rows, "place int, label binary, id long, sketch binary, component long").coalesce(1)
    assert sorted(map(tuple, near_dedup.across(near_dedup.looked_across(ordered)).collect())) == [(1, True), (900, True)]


@pytest.mark.parametrize("tasks", [1, 2])
def test_neighbours_of_different_components_are_undecided(spark, tasks):
    """Also where they stand in different tasks; not those of one component or region, nor those whose sketches differ."""
    near, far = bytes(near_dedup.SKETCH), bytes([17] * near_dedup.SKETCH)
    label = [bytes([0, 0, 0, 0, 0, third]) + bytes(10) for third in range(4)]  # two common levels
    rows = [(0, label[0], 1, near, 1), (0, label[1], 2, near, 1), (0, label[2], 3, near, 3), (0, label[2], 4, near, 4), (0, label[3], 5, far, 5)]
    ordered = spark.createDataFrame(rows, "place int, label binary, id long, sketch binary, component long").repartitionByRange(tasks, "id")
    pairs = near_dedup.undecided(near_dedup.looked_across(ordered.sortWithinPartitions("place", "label", "id")))
    assert sorted(map(tuple, pairs.collect())) == [(3, 1), (3, 2), (4, 1), (4, 2)]


def test_similar_sets_of_one_region_meet_by_their_rarest_shingles(spark):
    """All pairs of different components that are similar, of copies of many degrees."""
    draw = random.Random(3)
    words = [f"w{i}" for i in range(80)]
    texts = [" ".join(w if draw.random() > share else f"x{draw.randrange(500)}" for w in words) for share in [0, 0.02, 0.04, 0.08, 0.2] * 12]
    found = [near_dedup.shingle_set(t, 2) for t in texts]
    sketches = [near_dedup.sketch_of(near_dedup.signature(f)) for f in found]
    contested = spark.createDataFrame(
        [(i, i, True, bytearray(s)) for i, s in enumerate(sketches)], "id long, component long, minor boolean, sketch binary"
    )
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    pairs = {tuple(r) for r in near_dedup.prefix_pairs(contested, df, 2, 80).collect()}
    true = {(a, b) for a in range(len(texts)) for b in range(a) if near_dedup.similar(found[a], found[b], 80)}
    assert len(true) > 100 and true <= pairs


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(10, 60)] + [(5, 5), (7, 8), (8, 9), (9, 7), (300, 7), (8, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = {i: 100 for i in range(100, 161)} | {i: 1 for i in [1, *range(10, 60)]} | {i: 7 for i in (7, 8, 9, 300)}
    assert got == expected


def contained(docs, items, n, percent):
    sets = [(i, shingles((t or "").lower(), n)) for i, t in docs]
    return {
        (d, i, len(b), len(a & b))
        for i, b in ((i, shingles((t or "").lower(), n)) for i, t in items)
        for d, a in sets
        if b and 100 * len(a & b) >= percent * len(b)
    }


def test_contained_items_of_documents(spark):
    read = lambda name, key: [tuple(r) for r in queries.table(spark, SMALL, name).select(key, "text").collect()]
    got = {tuple(r) for r in queries.op5_decontamination(spark, SMALL).collect()}
    assert got == contained(read("documents", "doc_id"), read("benchmark", "item_id"), 5, 80)


def test_contained_items_of_odd_rows(spark):
    item = " ".join(f"q{i}" for i in range(20))
    broken = item.replace("q9", "zz")  # five of sixteen shingles go
    long = " ".join(f"f{i}" for i in range(30_000))
    texts = [item, broken, item.upper() + " tail", long + " " + item + " " + long, None, "", "only three words", "q0 q1", item.replace("q0 ", "zz ")]
    docs = [(i, t) for i, t in enumerate(texts)] + [(0, item), (None, item)]
    items = [(1, item), (2, "only three words"), (3, None), (4, ""), (None, item), (1, item)]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, found string")
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    got = {tuple(r) for r in decontamination.contained(d, b).collect()}
    assert got == {r for r in contained(docs, items, 5, 80) if None not in r}
    assert {r["doc_id"] for r in decontamination.decontaminated(d, b).collect()} == {None, 1, 4, 5, 7}
    assert decontamination.contained(d.limit(0), b).count() == decontamination.contained(d, b.limit(0)).count() == 0


def brute_counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_counts_of_rules(spark):
    texts = [r["text"] for r in queries.table(spark, SMALL, "documents").collect()][:60]
    texts += [None, "", "a", "a a a", "a a a a", "a b c a b c", "x\x1cy \x85z w", "l\nl\n \nl\r\nl", "\t\x0b\x0c"]
    for text in texts:
        assert quality_rules.text_counts(text)[:5] == brute_counts(text), text


def test_rules_follow_language_and_source(spark):
    plain = " ".join(f"w{i}" for i in range(80))
    marked = " ".join(f"w{i}#" for i in range(80))
    rows = [(i, plain, "en", "a") for i in range(300)] + [(1000, marked, "en", "a")]
    rows += [(2000 + i, marked, "xx", None) for i in range(300)] + [(3000, plain, "xx", None)]
    rows += [(4000, marked, None, "b"), (4001, plain, None, "b"), (5000, None, None, None), (5001, "", "en", "a")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, source string, bucket int")
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(df, least_group=200).collect()}
    assert len(got) == len(rows)
    assert got[0] and not got[1000]  # rare where others have no marks
    assert got[2000] and got[3000]  # usual in their own group
    assert got[4001] and not got[5000] and not got[5001]
    assert quality_rules.quality_rules(df.limit(0)).count() == 0


def test_no_number_of_documents_switches_fences(spark):
    """A source of unusual documents is judged mostly by its own, and one document more or less changes nothing."""
    plain, marked = " ".join(f"w{i}" for i in range(80)), " ".join(f"w{i}#" for i in range(80))
    for size in (150, 199, 200):
        rows = [(i, plain, "en", "a") for i in range(1000)] + [(1000 + i, marked, "en", "b") for i in range(size)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        fences = quality_rules.thresholds(quality_rules.sketches(quality_rules.measures(df))).collect()
        highs = {r["source"]: r["symbol_rate_high"] for r in fences}
        assert highs["b"] > 250 and highs["a"] < 250, (size, highs)


def test_buckets_are_narrow(spark):
    got = spark.range(100_000).select("id", quality_rules.bucket(quality_rules.F.col("id")).alias("b")).collect()
    assert all(r["b"] <= r["id"] <= r["b"] * 33 / 32 for r in got)
    assert all(r["b"] == r["id"] for r in got if r["id"] < 64)


def test_quartiles_of_merged_sketches_are_those_of_all(spark):
    draw = random.Random(1)
    values = [(draw.choice("ab"), draw.choice("xyz"), "m", draw.randrange(64), 1) for _ in range(500)]
    sketch = spark.createDataFrame(values, "lang string, source string, measure string, bucket long, n long")
    merged = quality_rules.merged(sketch, "lang")
    for r in quality_rules.quartiles(merged, "lang").collect():
        own = sorted(v[3] for v in values if v[0] == r["lang"])
        assert (r["size"], r["q1"], r["q3"]) == (len(own), own[-(-len(own) // 4) - 1], own[-(-3 * len(own) // 4) - 1])


LINES = {
    "This work is licensed under the GNU General Public License, version 3.": "gpl",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "Released under the MIT License.": "mit",
    "Licensed under the Apache License, Version 2.0.": "apache",
}


def test_licences_of_documents(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents").collect()
    true = {(d["doc_id"], k, LINES[x]) for d in docs for k, x in enumerate((d["text"] or "").split("\n")) if x in LINES}
    assert true and {tuple(r)[:3] for r in queries.op3_licences(spark, "/root/testdata/sf0.01").collect()} == true


def test_licences_by_brute_force(spark):
    others = ["the quick brown fox of the house", "version two of that is for you", "a license to drive is not needed here"] * 20
    model = licences.fit(others)
    texts = [*LINES, "License", "mit", "the general public of the work", "We walk. Licensed under the MIT license, friends!", "", None, "a\n\nReleased under CC0 1.0\r\n"]
    df = spark.createDataFrame([(i, t, "g") for i, t in enumerate(texts)] + [(None, "Licensed under CC BY 4.0", "g")], "doc_id long, text string, gram string")
    number = {g: i for i, g in enumerate(model.grams)}
    weighted = {g for g, w in zip(model.grams, model.weights, strict=True) if np.any(w)}
    expected = set()
    for doc_id, text in [*enumerate(texts), (None, "Licensed under CC BY 4.0")]:
        for paragraph, line in enumerate((text or "").split("\n")):
            found = licences.python_grams(licences.python_words(line)) & weighted
            if not found:
                continue
            scores = np.append(sum(model.weights[number[g]] for g in found) + model.bias, 0) / model.temperature
            chances = np.exp(scores - scores.max()) / np.exp(scores - scores.max()).sum()
            best = int(chances[:-1].argmax())
            covers = [
                len(found & g) / len(g)
                for t in licences.TEMPLATES[model.families[best]]
                for g in [licences.python_grams(licences.python_words(t)) & weighted]
                if g
            ]
            if chances[best] >= licences.LEAST_PROBABILITY and max(covers, default=0) >= licences.LEAST_COVER:
                expected.add((doc_id, paragraph, model.families[best]))
    got = {tuple(r)[:3] for r in licences.licences(df, model).collect()}
    assert got == expected
    assert {(i, 0, f) for i, f in enumerate(LINES.values())} <= got and not any(d in (4, 5, 6) for d, _, _ in got)
    assert licences.licences(df.limit(0), model).count() == 0


def test_licences_over_several_lines(spark):
    others = ["the quick brown fox of the house", "version two of that is for you", "a license to drive is not needed here"] * 20
    model = licences.fit(others)
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# someone."
    mit = "Title\n\nPermission is hereby granted, free of charge, to any\nperson obtaining a copy\nof this software and files"
    bsd = " * Redistribution and use in source and binary forms, with or\r\n * without modification, are permitted provided that\r\n"
    long = "plain words go on " * 200 + "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license " + "and on " * 300
    apart = gpl.replace("modify\n", "modify\n \n")
    df = spark.createDataFrame(list(enumerate([gpl, mit, bsd, long, apart])), "doc_id long, text string")
    assert sorted(tuple(r)[:3] for r in licences.licences(df, model).collect()) == [(0, 0, "gpl"), (1, 2, "mit"), (2, 0, "bsd"), (3, 0, "gpl")]


OTHERS = ["the quick brown fox of the house", "version two of that is for you", "a license to drive is not needed here"] * 20


def judged(model, words):
    """Family of a window by plain Python, or None."""
    number = {g: i for i, g in enumerate(model.grams)}
    weighted = {g for g, w in zip(model.grams, model.weights, strict=True) if np.any(w)}
    found = licences.python_grams(words) & weighted
    if not found:
        return None
    scores = np.append(sum(model.weights[number[g]] for g in found) + model.bias, 0) / model.temperature
    chances = np.exp(scores - scores.max()) / np.exp(scores - scores.max()).sum()
    family = model.families[int(chances[:-1].argmax())]
    covers = [
        len(found & g) / len(g)
        for t in licences.TEMPLATES[family]
        for g in [licences.python_grams(licences.python_words(t)) & weighted]
        if g
    ]
    good = chances[model.families.index(family)] >= licences.LEAST_PROBABILITY and max(covers, default=0) >= licences.LEAST_COVER
    return family if good else None


def stated_lines(model, text):
    """Line and family of every statement: of the runs of lines that state a family, those without a smaller one inside."""
    lines = text.split("\n")
    ends = {}
    for start, line in enumerate(lines):
        words = []
        for last in range(start, len(lines)):
            if not lines[last].strip(" \t\r") or len(words) >= licences.STATEMENT_WORDS:
                break
            words += licences.python_words(lines[last])
            family = judged(model, words)
            if family and (start, family) not in ends:
                ends[start, family] = last
    least = [
        (start, family) for (start, family), last in ends.items()
        if not any(f == family and s > start and e <= last for (s, f), e in ends.items())
    ]
    return {
        (start, family) for start, family in least
        if not any(f == family and s < start <= ends[s, f] and not any(f == family and s < x < start for x, f in least) for s, f in least)
    }


def test_licences_of_several_lines_by_brute_force(spark):
    model = licences.fit(OTHERS)
    draw = random.Random(6)
    texts = []
    for _ in range(25):
        words = []
        for _ in range(4):
            words += draw.choice(draw.choice(list(licences.TEMPLATES.values()))).split(" ")
            words += draw.choices(["the", "fox", "of", "house", "two", "\n"], k=draw.randrange(12))
        texts.append("".join(w + draw.choice([" ", " ", " ", "\n"]) for w in words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {tuple(r)[:3] for r in licences.licences(df, model).collect()}
    assert got == {(i, line, family) for i, t in enumerate(texts) for line, family in stated_lines(model, t)}
    assert len(got) > 40


def test_licences_are_told_apart_and_may_be_denied(spark):
    lines = {
        "not licensed under the MIT license": None,
        "This file is not licensed under the Apache License, Version 2.0.": None,
        "license plates and warranty of software": None,
        "// SPDX-License-Identifier: MIT": "mit",
        "SPDX-License-Identifier: Apache-2.0": "apache",
        "SPDX-License-Identifier: GPL-2.0-only": "gpl",
        "Licensed under the ISC license": "isc",
        "This is released under the Eclipse Public License 2.0": "epl",
        "licensed under the GNU Lesser General Public License": "lgpl",
        "licensed under the GNU Affero General Public License": "agpl",
        "Licensed under the GNU General Public License version 2": "gpl",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO': "mit",
    }
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r["doc_id"]: r["family"] for r in licences.licences(df, licences.fit(OTHERS)).collect()}
    assert got == {i: f for i, f in enumerate(lines.values()) if f}


def test_licences_of_very_long_texts(spark):
    """100,000 lines with one statement, a thousand statements, one line only, and equal and other texts of one id."""
    plain, mit = "plain words of a longer line x\n", "Released under the MIT License.\n"
    rows = [
        (1, plain * 50_000 + mit + plain * 50_000), (2, mit * 1_000), (3, "plain words " * 10_000 + mit),
        (None, mit), (None, mit), (None, "\n" + mit), (4, mit), (4, mit),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["paragraph"]) for r in licences.licences(df, licences.fit(OTHERS)).collect()))
    assert got == [(0, 0), (0, 1), (1, 50_000), *((2, k) for k in range(1_000)), (3, 0), (4, 0)]


def test_quotes_link_to_originals(spark):
    rows = [
        (1, 0, "user", "Shall we meet?\nOn Monday at  noon."),
        (1, 1, "assistant", "> On monday at noon.\nNo, on Tuesday."),
        (1, 2, "user", "> > On Monday at noon.\n> No, on Tuesday.\nFine."),
        (1, 3, "user", ">> On Monday at noon.\nI was asking about that."),
        (1, 4, "user", "> never written by anyone\nAlone."),
        (1, 7, "user", "After a gap"),
        (2, 5, None, None), (2, 6, "user", ">>>\n> \n"), (2, 6, "user", ">>>\n> \n"), (None, 1, "user", "x"), (3, None, "user", "x"),
    ]
    df = spark.createDataFrame([(*r, "h") for r in rows], "conv_id long, turn long, role string, text string, hash string")
    got = {(r["conv_id"], r["turn"]): r for r in quote_links.quote_links(df).collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (1, 7), (2, 5), (2, 6)}
    facts = {k: (r["parent_turn"], r["root_turn"], r["depth"], r["quoted_lines"], r["linked_lines"], r["text"]) for k, r in got.items()}
    assert facts[1, 0] == (None, 0, 0, 0, 0, "Shall we meet?\nOn Monday at  noon.")
    assert facts[1, 1] == (0, 0, 1, 1, 1, "No, on Tuesday.")
    assert facts[1, 2] == (1, 0, 2, 2, 2, "Fine.")
    assert facts[1, 3] == (0, 0, 1, 1, 1, "I was asking about that.")
    assert facts[1, 4] == (3, 0, 2, 1, 0, "Alone.")
    assert facts[1, 7] == (None, 7, 0, 0, 0, "After a gap")
    assert facts[2, 5] == (None, 5, 0, 0, 0, "")
    assert facts[2, 6] == (5, 5, 1, 2, 0, "")
    assert quote_links.quote_links(df.limit(0)).count() == 0


def test_quotes_that_were_wrapped_again_link(spark):
    long = "The committee will meet on the second Monday of every month in the small hall behind the old library."
    rows = [
        (1, 0, "user", f"Yes.\n{long}"), (1, 1, "user", "Yes."), (1, 2, "user", "Something else\nYes."),
        (1, 3, "user", "> The committee will meet on the second\n> Monday of every month in the small hall\n> behind the old library.\nGood."),
        (1, 4, "user", "> Yes.\nWhy?"),
        (1, 5, "user", ">> The committee will meet on the second Monday\n>> of every month in the small hall behind\n> Good.\nNo."),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["turn"]: (r["parent_turn"], r["quoted_lines"], r["linked_lines"]) for r in quote_links.quote_links(df).collect()}
    assert got == {0: (None, 0, 0), 1: (0, 0, 0), 2: (1, 0, 0), 3: (0, 3, 3), 4: (3, 1, 0), 5: (3, 3, 3)}


def test_long_threads_end(spark):
    df = spark.createDataFrame([(1, i, "user", "x") for i in range(100)], "conv_id long, turn long, role string, text string")
    got = quote_links.quote_links(df).collect()
    assert {r["turn"]: (r["root_turn"], r["depth"]) for r in got} == {i: (0, i) for i in range(100)}
