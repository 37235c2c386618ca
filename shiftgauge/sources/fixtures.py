"""Corpora derived from the benchmark tables, as SQL that Spark and DuckDB both run.

A source becomes a group of projects, a document becomes one file: a code head and then the whole
text, so the bytes scanned grow with the scale factor. A third of all files fall into one project
(``mono``), and a third of all releases to one package, to keep skew in every run. In heads ``~``
stands for a backslash, a backquote for a newline and ``^`` for a single quote.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from shiftgauge.sources.corpus import Corpus

# Path (``#`` is replaced by the document number) and head of each kind of file.
FILE_KINDS = [
    ("app/Http/Controllers/C#.php",
     "<?php`namespace App~Http~Controllers;`use Illuminate~Http~Request;`class C extends Controller { function a() { Auth::user(); return view(1); } }`"),
    ("app/Models/M#.php", "<?php`use Illuminate~Database~Eloquent~Model;`class M extends Model {}`"),
    ("src/Service/S#.php", "<?php`class S { public function __construct(private App~Foo $x) {} }`"),
    ("src/Repository/R#.php", "<?php`final class R { function all() { return []; } }`"),
    ("src/Contract/I#.php", "<?php`interface I { function go(); }`"),
    ("src/Entity/E#.php", "<?php`use Doctrine~ORM~Mapping as ORM;`#[ORM~Entity]`class E {}`"),
    ("application/models/m_#.php",
     "<?php defined(^BASEPATH^) or die;`class m extends CI_Model { function g() { $this->db->where(1); return $this->db->get(2); } }`"),
    ("lib/db/q_#.php", "<?php`$s = $pdo->prepare(1); $r = $pdo->query(2);`"),
    ("tests/Feature/F#Test.php", "<?php`use Tests~TestCase;`class F extends TestCase {}`"),
    ("src/unit/u_#test.php", "<?php`class u { function t() { if (1) echo 2; if (f(g)) { h(); } elseif (2) i(); if (a(b(c(d(e(f(1)))))) and (2)) j(); } }`"),
    ("resources/views/v_#.blade.php", "{{ title }}`"),
    ("app/views/p_#.php", "<?php if ($_GET[^q^]) { ?><b><?php echo new Foo(); } ?>`"),
    ("application/config/r_#/routes.php",
     "<?php`$route[^a/b^] = ^c/d^;`$route[^e^] = ^f/#^;`$route[^a/b^] = ^z^;`$route[^p#^] = ^^;`"),
    ("system/cms/controllers/c_#.php",
     "<?php`class c extends MY_Controller { function i() { $this->load->view(1); $this->input->get(2); redirect(3); } }`"),
    ("old_lib/multi-class/x_#.php", "<? class first_one {}`abstract class SecondOne implements I {}`?><?= 1 ?>`"),
    ("docs/t_#.txt", ""),
    ("vendor/acme/pkg/V#.php", "<?php`class V extends Model { function a() { return app(1); } }`"),
    ("system/cms/vendor/L#.php", "<?php`class L extends MY_Model {}`"),
    ("modules/user-admin/.cache/h_#.php", "<?php`class H {}`"),
    ("packages/system/cms/deep_#.php", "<?php`class Deep extends ResourceModel { function a() { return $this->view->x; } }`"),
    ("modules/user-admin/controllers/Site#.php",
     "<?php`namespace app~modules;`use yii~web~Controller;`class Site# extends Controller { function a() { return Yii::$app->get(Yii::t(1)); } }`"),
    ("modules/user_admin/Model/Table/T#.php", "<?php`use Cake~ORM~Table;`class T extends Table {} class U extends Entity {}`"),
    ("module/Shop/src/Z#.php", "<?php`use Laminas~Mvc~Controller~AbstractActionController;`class Z extends AbstractActionController {}`"),
    ("modules/api v2/models/P#.php",
     "<?php`use Phalcon~Mvc~Model;`class P extends BaseModel { function d() { return $this->getDI()->get(1); } }`"),
    ("src/Http/T#.php", "<?php`use Tempest~Http~Get;`class T { #[Get] function a(Req $r) { if ((a)(b)) return 1; } }`"),
    ("src/Controller/Y#.php",
     "<?php`use Symfony~Component~Routing;`use Symfony~Bundle~FrameworkBundle;`use Doctrine~Bundle~X;`class Y extends AbstractController { function s(Svc $s) {} }`"),
    ("templates/pages/w_#.twig", "{{ include(^a^) }}`"),
    ("templates/partials/w_#.phtml", "<? foreach ($_SESSION as $s) { ?>x<?php } $this->db->query(1); require 1; ?>`"),
    ("old_lib/multi-class/Own#.php", "<?php`class own_# {}`class First_One {}`interface Second extends First {}`"),
    ("tests/Browser/B#.php", "<?php`class B extends TestCase { use CreatesApplication; }`"),
    ("app/layouts/q_#.tpl", "{$title}`"),
    ("index#.php", "<?php`subclass Foo; echo Foo::class; $x = new class { }; class  Index#  extends Base { }`"),
    ("src/Lexical/K#.php",
     "<html> class Before { <?php`/* class InComment { */ // class InLine { if (a) b();`namespace Real~Name;`$a = ^class InString {^ . \"if (x) y ~\" class Q {\";`"
     "CLASS Real_one { function f() { if (^)^) g(); if (1) /* c */ { } $x->if(2); $e = ^it~^s class Esc {^; } }`"
     "$h = <<<EOT`class Here { if (1) x();`  EOT;`class second_one Extends B {} ?> class Html { if (x) y <?php IF (2) echo ^{^; /* class Open {`"),
    ("chain/x-y/Chain#.php", "<?php`$a = 1;`"),
    ("chain/XY/Chain#.php", "<?php`$a = 2;`"),
    ("chain/x_y/Chain#.php", "<?php`$a = 3;`"),
]

# Manifest entries: section, package and the versions that occur.
MANIFEST_ENTRIES = [
    ("require", "phpoffice/phpspreadsheet", "^1.29", "2.1.0"),
    ("require", "php", "^7.4", ">=8.1"),
    ("require", "ext-json", "1.0", "1.1"),
    ("require", "symfony/framework-bundle", "^5.4", "6.4.1"),
    ("require", "symfony/console", "5.4.45", "6.4.1"),
    ("require", "laravel/framework", "^8.0|^9.0", "10.2"),
    ("require", "illuminate/support", "8.83.0-RC1", "10.2"),
    ("require", "codeigniter/framework", "3.1", "3.0"),
    ("require", "twig/twig", "2.0", "3.1"),
    ("require", "phalcon/phalcon", "4.1", "~5.0.2"),
    ("require", "yiisoft/yii2", "2.0", "2.0.4"),
    ("require", "smarty/smarty", "4.*", "3.1.48"),
    ("require", "doctrine/doctrine-bundle", "2.7", "1.12@beta"),
    ("require", "spatie/laravel-permission", "5.0", "6.1.0-beta2"),
    ("require", "zendframework/zend-mvc", "3.1", "2.7.15"),
    ("require", "tempest/framework", "1.0", "0.9"),
    ("require", "cakephp/cakephp", "4.4", "5.0"),
    ("require-dev", "phpunit/phpunit", "^9.0", "10.1"),
    ("require-dev", "laravel/framework", "9.0", "9.1"),
    ("require-dev", "cakephp/orm", "3.9", "4.2"),
    ("require-dev", "symfony/console", "7.0", "6.2"),
    ("require-dev", "tymon/jwt-auth", "1.0", "2.0"),
    ("require-dev", "laminas/laminas-mvc", "3.3", "3.6"),
    ("require-dev", "yiisoft/yii2-bootstrap4", "2.0.1", "2.0.9"),
]

MARKER_PATHS = [
    "bin/console", "config/bundles.php", "symfony.lock", "artisan", "app/Http/Kernel.php",
    "bootstrap/app.php", "spark", "yii", "config/web.php", "module/Application/Module.php",
    "bin/cake", "config/app.php", ".phalcon", "vendor/tempest/core/a.php", "artisan2", "app/config/config.php",
]

SCHEMA_TABLES = {
    "region": ["r_regionkey bigint", "r_name varchar"],
    "nation": ["n_nationkey bigint", "n_name varchar", "n_regionkey bigint"],
    "customer": ["c_custkey INTEGER", "c_name varchar(25)", "c_nationkey bigint", "c_active bool", "c_vip tinyint(1)", "c_age tinyint(3)", "c_key bytea"],
    "supplier": ["s_suppkey int(11)", "s_name varchar", "s_nationkey bigint", "s_photo longblob", "s_scan mediumblob", "s_rank mediumint"],
    "part": ["p_partkey int4", "p_size smallint", "p_hash varbinary(16)", "p_code binary(8)", "p_flag boolean", "p_no serial", "p_thumb blob"],
    "orders": ["o_orderkey bigint", "o_custkey int", "o_orderdate timestamp", "o_totalprice double"],
    "lineitem": ["l_orderkey bigint", "l_partkey int", "l_suppkey int", "l_linenumber int"],
}
SCHEMA_KEYS = [
    ("nation", "fk_region", "region"), ("customer", "fk_nation", "nation"), ("supplier", "fk_nation", "nation"),
    ("orders", "fk_customer", "customer"), ("lineitem", "fk_order", "orders"), ("lineitem", "fk_part", "part"),
    ("lineitem", "fk_supplier", "supplier"), ("orders", "fk_dangling", "no_such_table"),
]

# Packages that the registry knows, by release number.
REGISTRY_NAMES = [
    "symfony/framework-bundle", "symfony/console", "laravel/framework", "illuminate/support",
    "codeigniter/framework", "twig/twig", "phalcon/phalcon", "yiisoft/yii2", "phpoffice/phpspreadsheet",
    "smarty/smarty", "doctrine/doctrine-bundle", "zendframework/zend-mvc", "ext-json", "cakephp/cakephp",
]

_DOC_PROJECT = (
    "CASE WHEN doc_id % 3 = 0 THEN 'mono' ELSE "
    "concat(source, '-', CAST(CAST(floor(doc_id / 500) AS INT) AS STRING)) END"
)
_DOC_INDEX = (
    "CASE WHEN doc_id % 3 = 0 THEN 3001 ELSE "
    "CAST(substr(source, 4) AS INT) + 20 * CAST(floor(doc_id / 500) AS INT) END"
)


def _quoted(text: str) -> str:
    return "'" + text + "'"


def _values(rows: list[tuple]) -> str:
    return ", ".join(
        "(" + ", ".join(str(v) if isinstance(v, int) else _quoted(v) for v in row) + ")" for row in rows
    )


def _files_sql() -> str:
    kinds = [(i, path, head) for i, (path, head) in enumerate(FILE_KINDS)]
    return f"""
SELECT k.project_id, replace(h.path, '#', k.num) AS path,
  concat(replace(replace(replace(replace(h.head, '#', k.num), '~', chr(92)), '`', chr(10)), '^', chr(39)), k.text)
    AS content
FROM (
  SELECT {_DOC_PROJECT} AS project_id, text, CAST(doc_id AS STRING) AS num,
    CAST((CAST(floor(doc_id / 20) AS BIGINT) * (CAST(substr(source, 4) AS INT) % 3 + 1)
      + CAST(substr(source, 4) AS INT)) % {len(FILE_KINDS)} AS INT) AS kind
  FROM documents) k
JOIN (VALUES {_values(kinds)}) h(kind, path, head) ON k.kind = h.kind"""


def _projects_sql() -> str:
    return f"""
SELECT DISTINCT {_DOC_PROJECT} AS project_id, {_DOC_INDEX} AS pidx FROM documents
UNION ALL
SELECT concat('lib-', CAST(s_suppkey AS STRING)) AS project_id, CAST(s_suppkey AS INT) + 7000 AS pidx FROM supplier"""


# Which entries a project has, and with which version.
_PRESENT = "(p.pidx * 5 + e.entry_no * 3) % 7 < 3"
_VERSION = (
    "CASE (p.pidx + e.entry_no) % 6 WHEN 0 THEN e.v0 WHEN 1 THEN e.v1 WHEN 2 THEN e.v0 "
    "WHEN 3 THEN 'dev-main' WHEN 4 THEN '*' ELSE NULL END"
)


def _entry_values() -> str:
    return f"(VALUES {_values([(i, *entry) for i, entry in enumerate(MANIFEST_ENTRIES, 1)])}) " + (
        "e(entry_no, section, name, v0, v1)"
    )


def packages_sql() -> str:
    """The manifest entries as rows."""
    return f"""
SELECT p.project_id, e.entry_no, e.section, e.name, {_VERSION} AS version_string
FROM projects p CROSS JOIN {_entry_values()}
WHERE p.pidx % 7 <> 0 AND p.pidx % 13 <> 5 AND p.pidx % 13 <> 8 AND {_PRESENT}
  AND NOT (p.pidx % 13 = 2 AND e.section = 'require-dev')"""


def _manifests_sql() -> str:
    """The same entries as JSON, with unreadable, empty and missing manifests among them."""
    entry = f"concat('\"', e.name, '\":', coalesce(concat('\"', {_VERSION}, '\"'), 'null'))"

    def section(name: str) -> str:
        return (
            f"coalesce(listagg(CASE WHEN e.section = '{name}' AND {_PRESENT} THEN {entry} END, ',') "
            f"WITHIN GROUP (ORDER BY e.entry_no), '')"
        )

    return f"""
SELECT p.project_id, CASE WHEN n.nested THEN 'packages/inner/composer.json' ELSE 'composer.json' END AS path,
  CASE WHEN n.nested THEN '{{"require":{{"php":"^5.6","laravel/framework":"5.0"}}}}'
  WHEN p.pidx % 13 = 2 THEN concat('{{"require":{{', {section('require')}, '}},"require-dev":[]}}') WHEN p.pidx % 13 = 5 THEN 'not json {{' WHEN p.pidx % 13 = 8 THEN '{{}}'
  ELSE concat('{{"name":"acme/', p.project_id, '","require":{{', {section('require')},
    '}},"require-dev":{{', {section('require-dev')}, '}}}}') END AS content
FROM projects p CROSS JOIN {_entry_values()} CROSS JOIN (VALUES (false), (true)) n(nested)
WHERE p.pidx % 7 <> 0 AND (NOT n.nested OR p.pidx % 5 = 1)
GROUP BY p.project_id, p.pidx, n.nested"""


def _paths_sql() -> str:
    rows = [(i, p) for i, p in enumerate(MARKER_PATHS)]
    return f"""
SELECT project_id, path FROM code_files
UNION ALL
SELECT p.project_id, m.path FROM projects p CROSS JOIN (VALUES {_values(rows)}) m(i, path)
WHERE (p.pidx * 3 + m.i * 5) % 11 < 3"""


def _registry_sql() -> str:
    names = list(enumerate(REGISTRY_NAMES))
    return f"""
SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'symfony/console' ELSE n.name END AS name,
  concat(CAST(l_partkey % 12 AS STRING), '.', CAST(l_suppkey % 50 AS STRING), '.',
    CAST(l_orderkey % 30 AS STRING), '.0',
    CASE l_orderkey % 11 WHEN 0 THEN concat('-RC', CAST(l_linenumber AS STRING))
      WHEN 1 THEN concat('-beta', CAST(l_linenumber AS STRING)) WHEN 2 THEN CASE WHEN l_linenumber % 2 = 0 THEN '-alpha1' ELSE '-a1' END
      WHEN 3 THEN '-dev' WHEN 4 THEN concat('-patch', CAST(l_linenumber AS STRING)) ELSE '' END) AS version
FROM lineitem JOIN (VALUES {_values(names)}) n(i, name) ON l_partkey % {len(REGISTRY_NAMES)} = n.i"""


def _releases_sql() -> str:
    return """
SELECT concat(CAST(5 + o_orderkey % 4 AS STRING), '.', CAST(o_custkey % 5 AS STRING), '.',
  CAST(o_orderkey % 40 AS STRING), CASE WHEN o_orderkey % 7 = 0 THEN 'RC1' ELSE '' END) AS version
FROM orders"""


def _columns_sql() -> str:
    rows = [
        (table, i, *column.split()) for table, columns in SCHEMA_TABLES.items() for i, column in enumerate(columns, 1)
    ]
    return f"""
SELECT p.project_id, c.table_name, c.column_name, c.type, c.ordinal
FROM projects p CROSS JOIN (VALUES {_values(rows)}) c(table_name, ordinal, column_name, type)
WHERE (p.pidx + length(c.table_name)) % 4 <> 0"""


def _foreign_keys_sql() -> str:
    return f"""
SELECT p.project_id, k.table_name, k.fk_name, k.foreign_table
FROM projects p CROSS JOIN (VALUES {_values(SCHEMA_KEYS)}) k(table_name, fk_name, foreign_table)
WHERE (p.pidx + length(k.table_name)) % 4 <> 0"""


# Name -> SQL, in dependency order.
FIXTURES: dict[str, str] = {
    "code_files": _files_sql(),
    "projects": _projects_sql(),
    "packages": packages_sql(),
    "manifests": _manifests_sql(),
    "project_paths": _paths_sql(),
    "registry": _registry_sql(),
    "releases": _releases_sql(),
    "columns_extract": _columns_sql(),
    "foreign_keys": _foreign_keys_sql(),
}

# Columns of the benchmark tables that the fixtures use.
TABLES = {
    "documents": "doc_id bigint, text string, source string",
    "supplier": "s_suppkey bigint",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int",
    "orders": "o_orderkey bigint, o_custkey bigint",
}


def spread(table: DataFrame) -> DataFrame:
    """Deal a table over all cores by its id. Test tables have one row group each; stored corpora need no such step."""
    return table.repartition(table.sparkSession.sparkContext.defaultParallelism, table.columns[0])


# Fixtures that do enough work per row to be worth spreading their input.
SPREAD = {"code_files", "registry"}


def load_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """The derived corpus; each table is defined when it is first used."""

    @cache
    def table(name: str) -> DataFrame:
        if name in TABLES:
            return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")
        query = FIXTURES[name]
        wide = name in SPREAD
        used = {t: spread(table(t)) if wide and t in TABLES else table(t) for t in (*TABLES, *FIXTURES) if re.search(rf"\bFROM {t}\b", query)}
        return spark.sql(_bind(query, used), **used)

    return Corpus(
        projects=lambda: table("projects").select("project_id"),
        files=lambda: table("code_files"),
        paths=lambda: table("project_paths"),
        manifests=lambda: table("manifests"),
        registry=lambda: table("registry"),
        releases=lambda: table("releases"),
        columns=lambda: table("columns_extract"),
        foreign_keys=lambda: table("foreign_keys"),
    )


def _bind(query: str, used: dict[str, DataFrame]) -> str:
    """Refer to DataFrames by placeholder, so that no temporary view outlives the call."""
    escaped = query.replace("{", "{{").replace("}", "}}")
    for name in used:
        escaped = re.sub(rf"\bFROM {name}\b", f"FROM {{{name}}}", escaped)
    return escaped
