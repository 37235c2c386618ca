"""Code without comments, strings and markup, and what is counted in it."""

import time

import pytest
from pyspark.sql import functions as F

from shiftgauge.functions.source import code_only
from shiftgauge.operators import inventories
from shiftgauge.operators.files import ScanConfig

CONFIG = ScanConfig()


def code(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string")
    return [r[0] for r in df.orderBy("i").select(code_only(F.col("content"))).collect()]


def test_all_but_code_is_blanked(spark):
    texts = {
        "<?php a /* b 'c */ d // e 'f\ng # h\n#[I] j": "      a            d        \ng    \n#[I] j",
        r"""<?php 'a\'b' . "c\\" . `d "e` . f""": "      '    ' . '   ' . '    ' . f",
        "x <b> 'y <?php z ?> don't <?= k ?>\n<?xml '?><?q": " " * 15 + "z ;" + " " * 12 + "k ; \n" + " " * 11 + "q",
        "<?php // a ?> b\n<?php c": "           ;   \n      c",
        "<?php $a = <<<EOT\nclass B {\n  EOT;\nc": "      $a = '     \n         \n    ';\nc",
        "<?php <<<'Q'\nQQ\nQ . 1 << 2": "      '     \n  \n' . 1 << 2",
        "<?php a 'never": "      a '    '",
        "<?php a /* never ?> x": "      a              ",
        "<?php a <<<X\nnever": "      a '   \n    '",
        "<?php a ?> never": "      a ;       ",
        "class A {} // no tag": "class A {}          ",
        "<?php é 'ü😀' ü": "      é '  ' ü",
        "": "",
        None: None,
    }
    got = code(spark, *texts)
    assert got == list(texts.values())
    assert all(t is None or len(t) == len(g) for t, g in zip(texts, got, strict=True))


HIDDEN = """<html> class Before { <?php
/* class InBlock { */ // class InLine { if (a) b();
# class InHash { if (a) b();
namespace Real\\Name;
#[Attribute] CLASS first_one { function f() { if (')') g(); if (1) /* c */ { } $x->if(2); X::if(3); } }
$s = 'class InString {' . "if (x) y \\" class Quoted {"; $e = 'it\\'s class Escaped {'; `class Shell {`;
$h = <<<"EOT"
class InHeredoc { if (1) x();
EOT;
class Second /* between */ extends B {} ?> class Html { if (x) y <?php IF (2) echo '{'; elseif (3) z();
interface I extends J {} $k = Foo::class; /* class Open { if (a) b();"""


def test_hidden_classes_and_conditions_do_not_count(files):
    df = files([("p", "src/a.php", HIDDEN), ("q", "src/b.php", "<?php // class A {} class B {}\n"), ("q", "c.php", "class {"), ("q", "d.php", None)])
    census = {r.project_id: (r.class_count, r.multi_class_files) for r in inventories.multi_class_census(df, CONFIG).collect()}
    assert census == {"p": (2, 1), "q": (0, 0)}
    plan = sorted((r.pos, r.namespace, r.class_name, r.target_path, r.written) for r in inventories.class_split_plan(df, CONFIG).collect())
    assert plan == [
        (0, "Real\\Name", "first_one", "src/FirstOne.php", True), (1, "Real\\Name", "Second", "src/Second.php", True),
    ]
    ifs = {r.path: r.braceless_ifs for r in inventories.braceless_if_census(df).collect()}
    assert ifs == {"src/a.php": 2, "src/b.php": 0, "c.php": 0, "d.php": 0}


@pytest.mark.parametrize(
    "text",
    ["'" * 1_000_001, "'\\" * 500_000, '" ' * 500_001, "'" + "\\" * 1_000_000, "'" + "\\'" * 500_000, "if " + "(" * 1_000_000,
     "<<<A\n" * 200_000, "/*" * 500_000, "/ " * 500_000, "?><?" * 250_000, "if (a) b();" * 90_000],
    ids=range(11),
)
def test_a_megabyte_of_open_tokens_takes_linear_time(spark, files, text):
    df = files([("p", "a.php", f"<?php class A {{}} {text} class B {{ if (a) b();")])
    start = time.time()
    inventories.braceless_if_census(df).collect()
    inventories.multi_class_census(df, CONFIG).collect()
    assert time.time() - start < 15  # squares would take hours


def test_a_target_that_many_files_claim(spark):
    """The first class is written, wherever the others were dealt; a target that exists is kept."""
    rows = [("p", f"src/f{i:04}.php", "<?php class A {} class b_c {} class D {}") for i in range(500)]
    df = spark.createDataFrame([*rows, ("p", "src/D.php", ""), ("q", "src/A.php", "x")], "project_id string, path string, content string")
    plan = inventories.class_split_plan(df, CONFIG)
    assert sorted((r.path, r.new_name) for r in plan.filter("written").collect()) == [("src/f0000.php", "A"), ("src/f0000.php", "BC")]
    assert plan.count() == 1500
