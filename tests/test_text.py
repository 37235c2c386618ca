import random

import pytest
from pyspark.sql import functions as F

from shiftgauge.functions import fixed_values as fixed
from shiftgauge.functions.text import LiteralScanner, camel_case, line_count, occurrences, pascal_case, title_case, word
from shiftgauge.functions.versions import is_unstable, major, minor, version_key
from shiftgauge.operators.features import pack_literals, scanner_for


def values(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")


def column(df, expression):
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_camel_case_goldens(spark):
    cases = {
        "hello_world": "helloWorld",
        "hello-world": "helloWorld",
        "Hello World": "helloWorld",
        "HELLO_WORLD": "helloWorld",
        "hello---world": "helloWorld",
        "h3llo-world": "h3lloWorld",
        "hello-world-123": "helloWorld123",
        "hello": "hello",
        "helloWorld": "helloWorld",
        "": "",
        "-_": "",
    }
    df = values(spark, list(cases))
    assert column(df, camel_case(F.col("text"))) == list(cases.values())
    assert column(df, pascal_case(F.col("text")))[:3] == ["HelloWorld"] * 3


def test_title_case_starts_after_any_non_letter(spark):
    cases = {"foo-bar a_b": "Foo-Bar A_B", "FOO": "Foo", "a1b": "A1B", "foo.bar": "Foo.bar", "x-.y": "X-.Y", "éa": "Éa"}
    assert column(values(spark, list(cases)), title_case(F.col("text"))) == list(cases.values())


def test_occurrences_do_not_overlap(spark):
    df = values(spark, ["aaaa", "", "baab", "éaaé"])
    assert column(df, occurrences(F.col("text"), "aa")) == [2, 0, 1, 1]
    assert column(df, occurrences(F.col("text"), "é")) == [0, 0, 0, 2]


def test_line_count(spark):
    assert column(values(spark, ["", "a", "a\n", "a\nb\n\n"]), line_count(F.col("text"))) == [1, 1, 2, 4]


def test_word_start_is_ascii(spark):
    df = values(spark, ["class A", "subclass A", "éclass A", "_class A"])
    assert column(df, F.rlike("text", F.lit(word("class") + r"\s+\w"))) == [True, False, True, False]


def test_scanner_equals_plain_counts(spark):
    literals = [x for fw in fixed.SIGNATURES for x in pack_literals(fixed.SIGNATURES, fw)]
    pieces = [*literals, *[x[:-1] for x in literals], *[x[1:] for x in literals], " ", "\n", "é", "extends ", "(", "::"]
    rng = random.Random(7)
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 60))) for _ in range(200)]
    scanner = scanner_for(fixed.SIGNATURES)
    scanned = values(spark, texts).withColumnRenamed("text", "content").select("i", "content", *scanner.columns())
    for fw in fixed.SIGNATURES:
        wanted = pack_literals(fixed.SIGNATURES, fw)
        assert column(scanned, scanner.count(wanted)) == [sum(t.count(x) for x in wanted) for t in texts], fw


@pytest.mark.parametrize("literal", ["aba(", "extends extends ", "((", "::a::", "use use ", "x'y\\(", "plain", "extends Middleware", "extends "])
def test_scanner_with_awkward_literals(spark, literal):
    texts = [literal * 3, literal + literal[1:], literal[:-1] * 2 + literal, "", "x" + literal + "y" + literal]
    scanner = LiteralScanner([literal], text="text")
    scanned = values(spark, texts).select("i", "text", *scanner.columns())
    assert column(scanned, scanner.count([literal])) == [t.count(literal) for t in texts]


def test_version_parts(spark):
    df = values(spark, ["^7.4|^8.0", "6.*", "", "dev-main", ">=8.1", None, "10"])
    assert column(df, major(F.col("text"))) == [7, 6, 0, 0, 8, 0, 10]
    assert column(df, minor(F.col("text"))) == [48, 0, 0, 0, 1, 0, 0]


def test_version_order(spark):
    ordered = [
        "^9.0", "1.0.0-dev", "1.0.0-alpha1", "1.0.0-beta2", "1.0.0-beta10", "1.0.0-RC1", "1.0.0", "1.0.0.1",
        "1.0.0-patch1", "1.2", "1.10", "2.0.0.0-beta1", "2.0.0.0", "10.0",
    ]
    shuffled = ordered[:]
    random.Random(1).shuffle(shuffled)
    rows = values(spark, shuffled).orderBy(version_key("text")).collect()
    assert [r.text for r in rows] == ordered


def test_unstable_markers(spark):
    texts = ["dev-main", "3.*", "1.0@beta", "1.0@RC", "1.0", None, "1.0-RC1"]
    assert column(values(spark, texts), is_unstable(F.col("text"))) == [True, True, True, True, False, False, False]
