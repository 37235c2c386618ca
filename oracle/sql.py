"""SQL for DuckDB: named parts, and one query per operator that pulls in the parts it names."""

from __future__ import annotations

import re

from shiftgauge.functions import fixed_values as fixed
from shiftgauge.plans.report_rows import LEGACY_LABELS, MIGRATION_LABELS, NO_DATABASE, OVERALL, UPGRADE_LABELS
from shiftgauge.queries import CONFIG, PAIRS
from shiftgauge.sources.fixtures import FIXTURES


def _text(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def _rows(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(_text(v) for v in row) + ")" for row in rows) + ")"


def _any(column: str, needles: tuple[str, ...] | list[str], function: str = "contains") -> str:
    return "(" + " OR ".join(f"{function}({column}, {_text(n)})" for n in needles) + ")"


def _r(x: str, digits: int = 2) -> str:
    """Half-up rounding on the decimal value."""
    return f"CAST(ROUND(CAST({x} AS DECIMAL(18,8)), {digits}) AS DOUBLE)"


def _count(column: str, literal: str) -> str:
    return f"((length({column}) - length(replace({column}, {literal}, ''))) // length({literal}))"


def _band(score: str, bands: list[tuple[int | None, str]]) -> str:
    parts = [f"WHEN {score} < {bound} THEN {_text(label)}" for bound, label in bands if bound is not None]
    return f"CASE WHEN {score} IS NULL THEN NULL {' '.join(parts)} ELSE {_text(bands[-1][1])} END"


_SEGMENT = "coalesce(TRY_CAST(string_split(regexp_replace(coalesce({v}, ''), '[^0-9.]', '', 'g'), '.')[{n}] AS BIGINT), 0)"


def _major(v: str) -> str:
    return _SEGMENT.format(v=v, n=1)


def _minor(v: str) -> str:
    return _SEGMENT.format(v=v, n=2)


def _key(v: str) -> str:
    dotted = f"regexp_replace({v}, '[-_+]', '.', 'g')"
    dotted = f"regexp_replace({dotted}, '([0-9])([^0-9.])', '\\1.\\2', 'g')"
    dotted = f"regexp_replace({dotted}, '([^0-9.])([0-9])', '\\1.\\2', 'g')"
    rank = (
        "CASE WHEN starts_with(x, 'dev') THEN 0 WHEN starts_with(x, 'a') THEN 1 WHEN starts_with(x, 'b') THEN 2 "
        "WHEN starts_with(x, 'RC') OR starts_with(x, 'rc') THEN 3 WHEN starts_with(x, '#') THEN 4 "
        "WHEN starts_with(x, 'p') THEN 5 ELSE -1 END"
    )
    return (
        f"list_concat(flatten(list_transform(list_filter(string_split({dotted}, '.'), lambda x: x <> ''), "
        f"lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN [4::BIGINT, TRY_CAST(x AS BIGINT)] "
        f"ELSE [CAST({rank} AS BIGINT), 0::BIGINT] END)), [4::BIGINT, -1::BIGINT])"
    )


def _camel(v: str) -> str:
    spaced = f"regexp_replace({v}, '([a-z])([A-Z])', '\\1 \\2', 'g')"
    kept = f"regexp_replace({spaced}, '[^a-zA-Z0-9_ -]+', '', 'g')"
    words = f"string_split(lower(translate({kept}, '-_', '  ')), ' ')"
    joined = f"array_to_string(list_transform({words}, lambda w: upper(w[1]) || w[2:]), '')"
    return f"(lower(({joined})[1]) || ({joined})[2:])"


def _pascal(v: str) -> str:
    return f"(upper({_camel(v)}[1]) || {_camel(v)}[2:])"


_SKIPPED = "|".join(re.escape(d) for d in (*CONFIG.exclude, *fixed.VCS_DIRS))


def _walked(path: str) -> str:
    return f"NOT regexp_matches({path}, '(^|/)[.]') AND NOT regexp_matches('/' || {path}, '/({_SKIPPED})/')"


_PHP = "ends_with(path, '.php')"
_LEGACY = "|".join(re.escape(d) for d in CONFIG.legacy_dirs)
_DIR = "CASE WHEN contains({p}, '/') THEN regexp_replace({p}, '/[^/]*$', '') ELSE '' END"
_STEM = "regexp_replace(regexp_replace({p}, '^.*/', ''), '[.][^.]*$', '')"
_CLASS = r"(?i)\bclass\s+(\w+)\s*(?:extends\b|implements\b|\{)"
# Tokens of the sources; the fixtures' heredocs are all called EOT.
_MARKUP = r"\?>.*?(?:<\?(?:php\b|=)?|\z)"
_LINE = rf"(?://[^\r\n]*?|#(?:[^\[\r\n][^\r\n]*?)??)(?:{_MARKUP}|[\r\n]|\z)"
_STRINGS = "|".join(rf"{q}(?:[^{q}\\]|\\.)*(?:{q}|\z)" for q in ("''", '"', "`"))
_HEREDOC = r"<<<[ \t]*[\"'']?EOT[\"'']?\r?\n.*?(?:\n[ \t]*EOT\b|\z)"
_TOKEN = rf"(?is){_MARKUP}|{_LINE}|/\*.*?(?:\*/|\z)|{_STRINGS}|{_HEREDOC}|[^''\"`#/<?]+|."
_CODE = f"""array_to_string(list_transform(regexp_extract_all(CASE WHEN contains(content, '<?') THEN '?>' ELSE '' END || content, '{_TOKEN}'), lambda t: CASE
  WHEN len(t) = 1 THEN t WHEN starts_with(t, '?>') THEN ' ;'
  WHEN (starts_with(t, '//') OR starts_with(t, '#')) AND contains(t, '?>') THEN ' ;'
  WHEN starts_with(t, '//') OR starts_with(t, '#') THEN chr(10) WHEN starts_with(t, '/*') THEN ' '
  WHEN starts_with(t, '''') OR starts_with(t, '"') OR starts_with(t, '`') OR starts_with(t, '<<<') THEN ''' ''' ELSE t END), '')"""
_ROUTE = r"\$route\[''([^\n]*?)''\] = ''([^\n]*?)''"
_UP = "'/' || lower(path)"
_NESTED = r"[^()]"
for _ in range(8):  # deeper than any condition of the fixtures
    _NESTED = rf"(?:[^()]|\({_NESTED}*\))"


def _parent(p: str) -> str:
    return _DIR.format(p=p)


def _join(parent: str, name: str) -> str:
    return f"CASE WHEN {parent} = '' THEN {name} ELSE {parent} || '/' || {name} END"


_catalogue = [
    (fw, n, name, i == 0, weight, i)
    for n, fw in enumerate(fixed.FRAMEWORKS)
    for i, (name, weight) in enumerate(fixed.CATALOGUE[fw])
]
_fingerprints = [(fw, n, p) for n, fw in enumerate(fixed.FRAMEWORKS) for p in fixed.FINGERPRINTS[fw]]
_signatures = [
    (fw, kind, literal) for fw, kinds in fixed.SIGNATURES.items() for kind, found in kinds.items() for literal in found
]
_prefixes = [(fw, p) for fw, found in fixed.PACKAGE_PREFIXES.items() for p in found]
_targets = [
    (fw, php, version)
    for fw, versions in fixed.TARGET_VERSIONS.items()
    for php, version in zip(fixed.RUNTIME_VERSIONS, versions, strict=True)
]
_minimum = [(fw, *version) for fw, version in fixed.MINIMUM_RUNTIME.items()]

PARTS: dict[str, str] = {
    **{name: sql for name, sql in FIXTURES.items() if name != "manifests"},
    # Dimensions
    "catalogue": f"SELECT * FROM {_rows(_catalogue)} t(framework, fw_ord, name, is_primary, weight, sub_ord)",
    "fingerprints": f"SELECT * FROM {_rows(_fingerprints)} t(framework, fw_ord, fingerprint)",
    "signatures": f"SELECT * FROM {_rows(_signatures)} t(framework, kind, literal)",
    "packs": "SELECT DISTINCT framework FROM signatures",
    "prefixes": f"SELECT * FROM {_rows(_prefixes)} t(framework, prefix)",
    "target_versions": f"SELECT * FROM {_rows(_targets)} t(framework, target_php, target_version)",
    "minimum": f"SELECT * FROM {_rows(_minimum)} t(target_framework, min_major, min_minor)",
    "pairs": f"SELECT * FROM {_rows(PAIRS)} t(chosen_source, target_framework)",
    "runtimes": f"SELECT * FROM {_rows([(v,) for v in fixed.TARGET_RUNTIMES])} t(target_php)",
    # Listings
    "php_walked": f"SELECT * FROM code_files WHERE {_PHP} AND {_walked('path')}",
    "listed": f"SELECT * FROM php_walked WHERE NOT regexp_matches('/' || path, '/({_LEGACY})/')",
    "legacy": f"""SELECT f.project_id, f.path, f.content, d.dir AS legacy_dir
FROM code_files f JOIN {_rows([(d,) for d in CONFIG.legacy_dirs])} d(dir) ON starts_with(f.path, d.dir || '/')
WHERE {_PHP} AND {_walked("substr(f.path, length(d.dir) + 2)")}""",
    "template_list": f"""SELECT project_id, path, content, 0 AS list_no FROM code_files
WHERE {_walked('path')} AND {_any('path', fixed.TEMPLATE_ENDINGS, 'ends_with')}
UNION ALL SELECT project_id, path, content, 1 FROM code_files
WHERE {_walked('path')} AND {_PHP} AND regexp_matches(path, '{fixed.TEMPLATE_DIRS}')""",
    # Manifests
    "pk": """SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY entry_no) AS INT) AS ord,
section, name, version_string FROM packages""",
    "flagged": "SELECT project_id, pidx % 7 <> 0 AND pidx % 13 <> 5 AS has_manifest FROM projects",
    "first_php": """SELECT project_id, name AS php_package, version_string AS php_version FROM (
SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ord) AS rn FROM pk
WHERE section = 'require' AND contains(name, 'php')) WHERE rn = 1""",
    # Detection
    "known": """SELECT * EXCLUDE (rn) FROM (
SELECT p.project_id, c.framework, c.fw_ord, p.name, c.is_primary, c.weight, c.sub_ord, p.version_string, p.ord,
row_number() OVER (PARTITION BY p.project_id, c.framework, p.name ORDER BY p.ord) AS rn
FROM pk p JOIN catalogue c ON p.name = c.name) WHERE rn = 1""",
    "matched": """SELECT DISTINCT p.project_id, f.framework, f.fw_ord, f.fingerprint FROM project_paths p
JOIN fingerprints f ON p.path = f.fingerprint OR starts_with(p.path, f.fingerprint || '/')""",
    "representative": """SELECT project_id, framework, fw_ord, name, version_string FROM (
SELECT *, row_number() OVER (PARTITION BY project_id, framework ORDER BY sub_ord) AS rn FROM known) WHERE rn = 1""",
    "detected": f"""SELECT * FROM (
SELECT coalesce(a.project_id, b.project_id) AS project_id, coalesce(a.framework, b.framework) AS framework,
  coalesce(r.name, b.framework) AS name, r.version_string,
  CAST(CASE WHEN a.points IS NULL THEN least(100, b.hits * 30)
    ELSE least(100, least(100, a.points) + 10 * coalesce(b.hits, 0)) END AS DOUBLE) AS certainty,
  CAST(coalesce(a.fw_ord, b.fw_ord + 8) AS INT) AS fw_rank
FROM (SELECT project_id, framework, fw_ord, CAST(SUM(CASE WHEN {_any("coalesce(version_string, '')", fixed.UNSTABLE_MARKERS)}
    THEN (weight + 1) // 2 ELSE weight END) AS BIGINT) AS points FROM known GROUP BY ALL) a
FULL JOIN (SELECT project_id, framework, fw_ord, COUNT(*) AS hits FROM matched GROUP BY ALL) b
  ON a.project_id = b.project_id AND a.framework = b.framework
LEFT JOIN representative r ON r.project_id = a.project_id AND r.framework = a.framework) WHERE certainty >= 40""",
    "primary_fw": """SELECT * EXCLUDE (rn) FROM (
SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY certainty DESC, fw_rank) AS rn FROM detected) WHERE rn = 1""",
    "scen": """SELECT p.project_id, coalesce(o.chosen_source, 'detected') AS source_choice,
coalesce(o.chosen_source, d.framework, 'none') AS source_framework, o.target_framework
FROM projects p CROSS JOIN pairs o LEFT JOIN primary_fw d ON d.project_id = p.project_id""",
    # File features
    "sig_new": f"""SELECT f.project_id, f.path, s.framework, s.kind, CAST(SUM({_count('f.content', 's.literal')}) AS BIGINT) AS hits
FROM listed f CROSS JOIN signatures s GROUP BY ALL""",
    "sig_file": "SELECT project_id, path, framework, CAST(SUM(hits) AS BIGINT) AS hits FROM sig_new GROUP BY ALL",
    "sig_legacy": f"""SELECT f.project_id, f.path, f.legacy_dir, s.framework,
CAST(SUM({_count('f.content', 's.literal')}) AS BIGINT) AS hits FROM legacy f CROSS JOIN signatures s GROUP BY ALL""",
    "db_file": f"""SELECT project_id, path, CASE
WHEN contains(content, '{fixed.ELOQUENT_BASE}') AND {_any('content', fixed.ELOQUENT_MARKERS)} THEN 'eloquent'
WHEN {_any('content', fixed.DOCTRINE_MARKERS)} THEN 'doctrine'
WHEN {_any('content', fixed.ACTIVE_RECORD_CALLS)} THEN 'active_record'
WHEN {_any('content', fixed.RAW_QUERY_MARKERS)} THEN 'raw' ELSE 'none' END AS db_class FROM listed""",
    "arch_file": rf"""SELECT project_id, path,
contains({_UP}, '/service') OR contains(content, 'Phalcon\Di\Injectable')
  OR regexp_matches(content, '\bextends\s+Injectable\b') AS is_service,
contains({_UP}, '/repositor') AS is_repository,
regexp_matches(content, '(?i)\binterface\s+\w+') AS has_interface,
regexp_matches(content, 'public\s+function\s+__construct\s*\([^)]*[A-Z][a-zA-Z\\]+\s+\$')
  OR {_any('content', ('->getDI()', 'getDI()->get('))} AS has_injection,
{_any('content', (*fixed.DOCTRINE_MARKERS, 'Phalcon\\Mvc\\Model'))}
  OR (contains({_UP}, '/model') AND regexp_matches(content, '\bextends\s+\w*Model\b')) AS is_orm_entity FROM listed""",
    "test_file": f"""SELECT project_id, path, t AS is_test, t AND ({_any('content', fixed.COUPLED_TEST_MARKERS)}
OR (contains(content, 'extends TestCase') AND contains(content, 'CreatesApplication'))) AS is_coupled_test
FROM (SELECT *, contains({_UP}, '/test') OR ends_with({_UP}, 'test.php') AS t FROM listed)""",
    "spaghetti": rf"""SELECT project_id, path, list_no, least(1.0::DOUBLE, (
least(5, {_count('content', "'?>'")}) + 3 * CAST({_any('content', ('$_GET', '$_POST'))} AS INT)
+ 2 * CAST(contains(content, '$_SESSION') AS INT) + 2 * CAST(regexp_matches(content, '\bnew\s+[A-Z]') AS INT)
+ CAST({_any('content', ('require', 'include '))} AS INT) + 5 * CAST({_any('content', fixed.TEMPLATE_DB_MARKERS)} AS INT)
+ CASE WHEN lines > 500 THEN 5 WHEN lines > 200 THEN 2 ELSE 0 END) / 20.0::DOUBLE) AS spaghetti
FROM (SELECT *, len(string_split(content, chr(10))) AS lines FROM template_list)""",
    # Scores per project
    "sizes": """SELECT p.project_id, COUNT(f.path) AS file_count FROM projects p LEFT JOIN listed f ON f.project_id = p.project_id
GROUP BY p.project_id""",
    "size_score": f"""SELECT project_id, file_count, CASE WHEN file_count = 0 THEN 100.0::DOUBLE
ELSE {_r('greatest(5, least(100, 200 - 45 * log10(greatest(file_count, 1))))')} END AS codebase_size FROM sizes""",
    "coupling": f"""SELECT s.project_id, s.source_choice, s.source_framework, s.target_framework,
CASE WHEN n.file_count = 0 OR s.source_framework = s.target_framework OR h.coupled IS NULL THEN 100.0::DOUBLE
ELSE {_r('100 * exp(-4 * (0.6 * h.coupled / n.file_count + 0.4 * h.heavy / n.file_count))')} END AS framework_coupling
FROM scen s JOIN sizes n ON n.project_id = s.project_id LEFT JOIN (
SELECT project_id, framework, COUNT(*) FILTER (hits >= 1) AS coupled, COUNT(*) FILTER (hits >= 4) AS heavy
FROM sig_file GROUP BY ALL) h ON h.project_id = s.project_id AND h.framework = s.source_framework""",
    "db_score": f"""SELECT project_id, e + d + c + r > 0 AS database_detected, CASE WHEN e + d + c + r = 0 THEN 100.0::DOUBLE
WHEN d > 0 AND e + c + r = 0 THEN 70.0
WHEN c > 0 AND e + d = 0 THEN {_r('greatest(5, 50 - 250 * c / n - 50 * r / n)')}
WHEN r > 0 AND e + d = 0 THEN {_r('greatest(20, 80 - 60 * r / n)')}
ELSE {_r('greatest(10, 50 - 35 * e / n - 15 * r / n)')} END AS database_coupling FROM (
SELECT p.project_id, greatest(1, COUNT(f.path))::DOUBLE AS n, COUNT(*) FILTER (db_class = 'eloquent') AS e,
COUNT(*) FILTER (db_class = 'doctrine') AS d, COUNT(*) FILTER (db_class = 'active_record') AS c,
COUNT(*) FILTER (db_class = 'raw') AS r
FROM projects p LEFT JOIN db_file f ON f.project_id = p.project_id GROUP BY p.project_id)""",
    "arch_score": f"""SELECT p.project_id, coalesce(a.s, 50.0) AS architecture FROM projects p LEFT JOIN (
SELECT project_id, {_r('''least(25, 250.0::DOUBLE * COUNT(*) FILTER (is_service) / COUNT(*))
+ least(20, 200.0::DOUBLE * COUNT(*) FILTER (is_repository) / COUNT(*))
+ least(20, 100.0::DOUBLE * COUNT(*) FILTER (has_interface) / COUNT(*))
+ least(20, 80.0::DOUBLE * COUNT(*) FILTER (has_injection) / COUNT(*))
+ least(15, 300.0::DOUBLE * COUNT(*) FILTER (is_orm_entity) / COUNT(*))''')} AS s
FROM arch_file GROUP BY project_id) a ON a.project_id = p.project_id""",
    "test_score": f"""SELECT p.project_id, coalesce(a.s, 0.0) AS test_coverage FROM projects p LEFT JOIN (
SELECT project_id, {_r('least(100, least(70, 140.0::DOUBLE * t / n) + 30.0::DOUBLE * (t - c) / t)')} AS s FROM (
SELECT project_id, COUNT(*) AS n, COUNT(*) FILTER (is_test) AS t, COUNT(*) FILTER (is_coupled_test) AS c
FROM test_file GROUP BY project_id) WHERE t > 0) a ON a.project_id = p.project_id""",
    "engines": """SELECT p.project_id, coalesce(f.engine, m.engine, CASE WHEN t.n > 0 THEN 'php' ELSE 'none' END) AS template_engine,
coalesce(t.n, 0) AS template_count, t.mean
FROM projects p
LEFT JOIN (SELECT project_id, COUNT(*) AS n, AVG(spaghetti) AS mean FROM spaghetti GROUP BY project_id) t ON t.project_id = p.project_id
LEFT JOIN (SELECT project_id, arg_min(engine, path) AS engine FROM (
  SELECT project_id, path, CASE WHEN ends_with(path, '.blade.php') THEN 'blade' WHEN ends_with(path, '.volt') THEN 'volt'
    WHEN ends_with(path, '.twig') THEN 'twig' WHEN ends_with(path, '.tpl') THEN 'smarty' END AS engine
  FROM template_list WHERE list_no = 0) WHERE engine IS NOT NULL GROUP BY project_id) f ON f.project_id = p.project_id
LEFT JOIN (SELECT project_id, arg_min(split_part(name, '/', 1), ord) AS engine FROM pk
  WHERE section = 'require' AND split_part(name, '/', 1) IN ('twig', 'smarty') GROUP BY project_id) m ON m.project_id = p.project_id""",
    "template_scores": f"""SELECT e.project_id, t.target_framework, e.template_engine, CAST(CASE e.template_engine
WHEN 'twig' THEN CASE t.target_framework WHEN 'symfony' THEN 95 WHEN 'laravel' THEN 70 WHEN 'tempest' THEN 70 ELSE 60 END
WHEN 'blade' THEN CASE t.target_framework WHEN 'laravel' THEN 95 ELSE 25 END
WHEN 'volt' THEN 20 WHEN 'smarty' THEN 50 WHEN 'php' THEN {_r('greatest(15, 70 - 55 * e.mean)')} ELSE 100 END AS DOUBLE) AS templating
FROM engines e CROSS JOIN (SELECT DISTINCT target_framework FROM pairs) t""",
    # Dependencies
    "owned": "SELECT DISTINCT p.project_id, p.ord, p.name, x.framework FROM pk p JOIN prefixes x ON starts_with(p.name, x.prefix)",
    "incompatible": """SELECT DISTINCT o.project_id, s.source_framework, s.target_framework, o.ord, o.name FROM owned o
JOIN scen s ON s.project_id = o.project_id AND s.source_framework = o.framework
WHERE NOT EXISTS (SELECT 1 FROM owned t WHERE t.project_id = o.project_id AND t.ord = o.ord AND t.framework = s.target_framework)""",
    "penalty": f"""SELECT s.*, f.php_version, CASE WHEN f.php_version IS NULL OR m.min_major IS NULL THEN 0.0::DOUBLE
WHEN m.min_major <= {_major('f.php_version')} THEN CAST(least(30, 5 * greatest(0, m.min_minor - {_minor('f.php_version')})) AS DOUBLE)
ELSE CAST(least(50, 25 * (m.min_major - {_major('f.php_version')}) + 5 * m.min_minor) AS DOUBLE) END AS php_penalty
FROM scen s LEFT JOIN first_php f ON f.project_id = s.project_id LEFT JOIN minimum m ON m.target_framework = s.target_framework""",
    "compat": f"""SELECT s.project_id, s.source_choice, s.source_framework, s.target_framework, CASE WHEN NOT g.has_manifest THEN 50.0::DOUBLE
WHEN n.total IS NULL THEN 100.0
ELSE {_r('greatest(0, least(100, (1 - coalesce(i.bad, 0)::DOUBLE / n.total) * 100 - s.php_penalty))')} END AS dependency_compatibility
FROM penalty s JOIN flagged g ON g.project_id = s.project_id
LEFT JOIN (SELECT project_id, COUNT(*) AS total FROM pk GROUP BY project_id) n ON n.project_id = s.project_id
LEFT JOIN (SELECT project_id, source_framework, target_framework, COUNT(*) AS bad FROM incompatible GROUP BY ALL) i
  ON i.project_id = s.project_id AND i.source_framework = s.source_framework AND i.target_framework = s.target_framework""",
    "newest": f"""SELECT name, version AS latest_version FROM (
SELECT name, version, row_number() OVER (PARTITION BY name ORDER BY {_key('version')} DESC, version DESC) AS rn
FROM registry WHERE NOT contains(name, 'ext')) WHERE rn = 1""",
    "newest_php": f"SELECT version AS latest_php FROM releases ORDER BY {_key('version')} DESC, version DESC LIMIT 1",
    "with_latest": """SELECT p.project_id, p.ord, p.name, p.version_string, n.latest_version FROM pk p JOIN newest n ON n.name = p.name
WHERE p.section = 'require' AND NOT contains('php', p.name) AND p.version_string IS NOT NULL""",
    "outdated": f"""SELECT project_id, name, version_string AS current_version, latest_version,
abs({_major('latest_version')} - {_major('version_string')}) AS major_gap FROM with_latest
WHERE {_key('version_string')} < {_key('latest_version')}""",
    "dep_upgrade": f"""SELECT g.project_id, coalesce(o.n, 0) AS outdated_count, CASE WHEN NOT g.has_manifest THEN NULL
WHEN o.n IS NULL THEN 100.0::DOUBLE ELSE {_r('greatest(0, least(100, 100 - 100.0::DOUBLE * o.gap / (10 * o.n)))')} END AS dependencies
FROM flagged g LEFT JOIN (SELECT project_id, COUNT(*) AS n, SUM(major_gap) AS gap FROM outdated GROUP BY project_id) o
ON o.project_id = g.project_id""",
    "php_upgrade": f"""SELECT g.project_id, f.php_version, l.latest_php, CASE WHEN NOT g.has_manifest THEN NULL WHEN f.php_version IS NULL THEN 0.0::DOUBLE
ELSE CAST(greatest(0, least(100, 100 - 7 * (5 * abs({_major('l.latest_php')} - {_major('f.php_version')})
  + abs({_minor('l.latest_php')} - {_minor('f.php_version')})))) AS DOUBLE) END AS php_version_score
FROM flagged g CROSS JOIN newest_php l LEFT JOIN first_php f ON f.project_id = g.project_id""",
    "fw_targets": """SELECT d.project_id, d.framework, d.version_string, r.target_php, t.target_version FROM detected d CROSS JOIN runtimes r
LEFT JOIN target_versions t ON t.framework = d.framework AND t.target_php = r.target_php""",
    "fw_upgrade": f"""SELECT p.project_id, r.target_php, coalesce({_r('s.mean')}, 100.0) AS framework_version
FROM projects p CROSS JOIN runtimes r LEFT JOIN (
SELECT project_id, target_php, AVG(CASE WHEN version_string IS NULL OR target_version IS NULL THEN 100 ELSE
  greatest(0, 100 - least(100, round(round(5 * ln(1 + 50 * abs({_major('target_version')} - {_major('version_string')})
    + 2 * abs({_minor('target_version')} - {_minor('version_string')})) / ln(3), 9)))
    - CASE framework WHEN 'phalcon' THEN 20 ELSE 0 END) END) AS mean
FROM fw_targets GROUP BY ALL) s ON s.project_id = p.project_id AND s.target_php = r.target_php""",
    # Reports
    "legacy_counts": "SELECT project_id, COUNT(*) AS legacy_count FROM legacy GROUP BY project_id",
    "legacy_scores": f"""SELECT s.project_id, s.source_choice, s.source_framework, s.target_framework, n.legacy_count,
CASE WHEN s.source_framework = s.target_framework OR h.coupled IS NULL THEN 100.0::DOUBLE
ELSE {_r('100 * exp(-4 * (0.6 * h.coupled / n.legacy_count + 0.4 * h.heavy / n.legacy_count))')} END AS legacy_coupling
FROM scen s JOIN legacy_counts n ON n.project_id = s.project_id LEFT JOIN (
SELECT project_id, framework, COUNT(*) FILTER (hits >= 1) AS coupled, COUNT(*) FILTER (hits >= 4) AS heavy
FROM sig_legacy GROUP BY ALL) h ON h.project_id = s.project_id AND h.framework = s.source_framework""",
    "mig": f"""SELECT *, {_band('total', fixed.MIGRATION_BANDS)} AS band FROM (
SELECT *, CASE WHEN includes_templating
THEN {_r('0.3 * framework_coupling + 0.2 * database_coupling + 0.1 * dependency_compatibility + 0.2 * architecture + 0.05 * test_coverage + 0.05 * codebase_size + 0.1 * templating')}
ELSE {_r('0.3 * framework_coupling + 0.2 * database_coupling + 0.1 * dependency_compatibility + 0.25 * architecture + 0.05 * test_coverage + 0.1 * codebase_size')} END AS total
FROM (SELECT c.project_id, c.source_choice, c.source_framework, c.target_framework, g.has_manifest, z.file_count,
c.framework_coupling, d.database_coupling, d.database_detected, k.dependency_compatibility, a.architecture, t.test_coverage,
z.codebase_size, e.template_count > 0 AS includes_templating, e.template_engine, e.template_count,
CASE WHEN e.template_count > 0 THEN x.templating END AS templating, coalesce(l.legacy_count, 0) AS legacy_count, l.legacy_coupling
FROM coupling c JOIN flagged g USING (project_id) JOIN size_score z USING (project_id) JOIN db_score d USING (project_id)
JOIN arch_score a USING (project_id) JOIN test_score t USING (project_id) JOIN engines e USING (project_id)
JOIN compat k ON k.project_id = c.project_id AND k.source_choice = c.source_choice AND k.target_framework = c.target_framework
JOIN template_scores x ON x.project_id = c.project_id AND x.target_framework = c.target_framework
LEFT JOIN legacy_scores l ON l.project_id = c.project_id AND l.source_choice = c.source_choice AND l.target_framework = c.target_framework))""",
    "upg": f"""SELECT *, {_band('total', fixed.UPGRADE_BANDS)} AS band FROM (
SELECT *, {_r('0.35 * framework_version + 0.3 * dependencies + 0.2 * php_version + 0.15 * codebase_size')} AS total FROM (
SELECT f.project_id, f.target_php, g.has_manifest, z.file_count, d.outdated_count,
CASE WHEN g.has_manifest THEN f.framework_version END AS framework_version, d.dependencies,
p.php_version_score AS php_version, CASE WHEN g.has_manifest THEN z.codebase_size END AS codebase_size
FROM fw_upgrade f JOIN flagged g USING (project_id) JOIN dep_upgrade d USING (project_id) JOIN php_upgrade p USING (project_id)
JOIN size_score z USING (project_id)))""",
    # Inventories
    "route_rows": f"""SELECT project_id, path, CAST(i - 1 AS INT) AS pos, r[i] AS route, t[i] AS target FROM (
SELECT project_id, path, r, t, unnest(range(1, len(r) + 1)) AS i FROM (
SELECT project_id, path, regexp_extract_all(content, '{_ROUTE}', 1) AS r, regexp_extract_all(content, '{_ROUTE}', 2) AS t
FROM code_files WHERE regexp_matches(path, '(^|/)routes[.]php$') AND {_walked('path')}))""",
    "php_code": f"SELECT project_id, path, {_CODE} AS code FROM php_walked",
    "classes": f"SELECT project_id, path, code, regexp_extract_all(code, '{_CLASS}', 1) AS found FROM php_code",
    "class_rows": rf"""SELECT project_id, path, pos, nullif(regexp_extract(code, '(?im)^[ \t;]*namespace[ \t]+([\w\\]+)\s*[;{{]', 1), '') AS namespace,
class_name, {_pascal('class_name')} AS new_name FROM (
SELECT project_id, path, code, CAST(i - 1 AS INT) AS pos, found[i] AS class_name FROM (
SELECT *, unnest(range(1, len(found) + 1)) AS i FROM classes WHERE len(found) > 1))""",
    "class_targets": f"""SELECT *, row_number() OVER (PARTITION BY project_id, target_path ORDER BY path, pos) AS rn FROM (
SELECT *, {_join(_parent('path'), "new_name || '.php'")} AS target_path FROM class_rows)""",
    "php_dirs": """SELECT DISTINCT project_id, array_to_string(parts[1:i], '/') AS dir FROM (
SELECT project_id, parts, unnest(range(1, len(parts))) AS i FROM (SELECT project_id, string_split(path, '/') AS parts FROM php_walked))""",
    "file_dirs": """SELECT DISTINCT project_id, array_to_string(parts[1:i], '/') AS dir FROM (
SELECT project_id, parts, unnest(range(1, len(parts))) AS i FROM (SELECT project_id, string_split(path, '/') AS parts FROM code_files))""",
    "path_dirs": """SELECT DISTINCT project_id, array_to_string(parts[1:i], '/') AS dir FROM (
SELECT project_id, parts, unnest(range(1, len(parts))) AS i FROM (SELECT project_id, string_split(path, '/') AS parts FROM project_paths))""",
    "renames": f"""SELECT *, {_join(_parent('dir'), 'new_name')} AS new_dir FROM (
SELECT project_id, dir, regexp_replace(dir, '^.*/', '') AS old_name,
{_pascal("regexp_replace(dir, '^.*/', '')")} AS new_name FROM php_dirs) WHERE old_name <> new_name""",
    "long_tagged": """SELECT project_id, path, content AS old, CASE WHEN starts_with(content, '<?php') OR starts_with(content, '<?xml') THEN content
ELSE replace(replace(replace(replace(replace(content, '<?php', chr(1)), '<?xml', chr(2)), '<?', '<?php '), chr(1), '<?php'), chr(2), '<?xml')
END AS content FROM code_files WHERE ends_with(path, '.php')""",
    "first_renames": """SELECT * FROM renames r WHERE new_name <> ''
  AND NOT EXISTS (SELECT 1 FROM path_dirs d WHERE d.project_id = r.project_id AND d.dir = r.new_dir)
  AND NOT EXISTS (SELECT 1 FROM renames o WHERE o.project_id = r.project_id AND o.new_dir = r.new_dir AND o.dir < r.dir)""",
    "judged": """SELECT r.*, NOT (EXISTS (SELECT 1 FROM first_renames w WHERE w.project_id = r.project_id AND w.dir = r.dir)
  OR r.new_name <> '' AND EXISTS (SELECT 1 FROM first_renames w WHERE w.project_id = r.project_id AND w.dir = r.new_dir AND w.dir < r.dir)
    AND NOT EXISTS (SELECT 1 FROM renames o WHERE o.project_id = r.project_id AND o.new_dir = r.new_dir AND o.dir < r.dir AND o.dir > r.new_dir)) AS conflict FROM renames r""",
    "titled": rf"""SELECT project_id, dir, CAST(len(string_split(dir, '/')) AS INT) AS depth, {_parent('dir')} || '/' || array_to_string(list_transform(
regexp_extract_all(regexp_replace(dir, '^.*/', ''), '\pL[\pL.:''`^]*|[^\pL]+'), lambda w: upper(w[1]) || lower(w[2:])), '') AS new_dir
FROM path_dirs WHERE contains(dir, '/') AND NOT regexp_matches(dir, '(^|/)[.]')
AND NOT regexp_matches('/' || dir || '/', '/({_SKIPPED})/')""",
    "schema_tables": "SELECT DISTINCT project_id, table_name FROM columns_extract",
    "edges": """SELECT k.project_id, k.table_name, k.fk_name, k.foreign_table, t.table_name IS NULL AS missing_target
FROM foreign_keys k LEFT JOIN schema_tables t ON t.project_id = k.project_id AND t.table_name = k.foreign_table""",
    "bound_columns": rf"""SELECT project_id, table_name, ordinal, column_name, type, coalesce(b.bound, 'STRING') AS binding_type
FROM columns_extract c LEFT JOIN {_rows(list(fixed.BINDING_TYPES.items()))} b(kind, bound) ON b.kind = CASE
WHEN starts_with(lower(c.type), 'tinyint(1)') THEN 'boolean' ELSE regexp_replace(lower(c.type), '[(].*', '') END""",
}

_SCEN = "project_id, source_choice, source_framework, target_framework"
_MIG = (
    "project_id, source_choice, source_framework, target_framework, has_manifest, file_count, framework_coupling, "
    "database_coupling, database_detected, dependency_compatibility, architecture, test_coverage, codebase_size, "
    "includes_templating, template_engine, template_count, templating, legacy_count, legacy_coupling, total, band"
)
_PROGRESS = _r("100.0::DOUBLE * file_count / (file_count + legacy_count)", 1)


def _report_rows() -> str:
    def row(metric: str, score: str, weight: str = "NULL", note: str = "NULL", where: str = "true") -> str:
        return (
            f"SELECT project_id, 'migration' AS report, source_choice, target_framework AS target, {metric} AS metric, "
            f"CAST({score} AS DOUBLE) AS score, CAST({weight} AS INT) AS weight, CAST({note} AS VARCHAR) AS note "
            f"FROM mig WHERE {where}"
        )

    rows = []
    for name, label in MIGRATION_LABELS.items():
        weight = (
            f"CASE WHEN includes_templating THEN {fixed.MIGRATION_WEIGHTS_WITH_TEMPLATES[name]} "
            f"ELSE {fixed.MIGRATION_WEIGHTS[name]} END"
        )
        if name == "database_coupling":
            score = "CASE WHEN database_detected THEN database_coupling END"
            rows.append(row(_text(label), score, weight, f"CASE WHEN NOT database_detected THEN '{NO_DATABASE}' END"))
        else:
            rows.append(row(_text(label), name, weight))
    label = "'Templating (' || template_engine || ', ' || template_count || ' files)'"
    rows.append(row(label, "templating", "10", where="includes_templating"))
    rows.append(row(_text(OVERALL), "total", note="band"))
    legacy = ["legacy_count", "file_count", _PROGRESS, "legacy_coupling"]
    notes = ["NULL", "NULL", "NULL", _band("legacy_coupling", fixed.LEGACY_LABELS)]
    for label_text, score, note in zip(LEGACY_LABELS, legacy, notes, strict=True):
        rows.append(row(_text(label_text), score, note=note, where="legacy_count > 0"))
    for name, label_text in {**UPGRADE_LABELS, "total": OVERALL}.items():
        weight = fixed.UPGRADE_WEIGHTS.get(name, "NULL")
        note = "band" if name == "total" else "NULL"
        rows.append(
            f"SELECT project_id, 'upgrade', NULL, target_php, {_text(label_text)}, {name}, {weight}, {note} "
            f"FROM upg WHERE has_manifest"
        )
    return "\nUNION ALL ".join(rows)


QUERIES: dict[str, str] = {
    "scan_code_files": "SELECT project_id, path FROM php_walked",
    "exclude_dirs": f"SELECT project_id, path FROM code_files WHERE NOT regexp_matches('/' || path, '/({'|'.join(CONFIG.exclude)})/')",
    "legacy_split": """SELECT project_id, path, NULL::VARCHAR AS legacy_dir, false AS is_legacy FROM listed
UNION ALL SELECT project_id, path, legacy_dir, true FROM legacy""",
    "template_files": "SELECT project_id, path, list_no FROM template_list",
    "manifest_packages": "SELECT project_id, ord, section, name, version_string FROM pk",
    "registry_latest": "SELECT name, latest_version FROM newest",
    "latest_runtime": "SELECT latest_php FROM newest_php",
    "schema_columns": "SELECT * FROM bound_columns",
    "routes_dump": """SELECT project_id, route, target FROM (SELECT *, row_number() OVER (
PARTITION BY project_id, route ORDER BY path DESC, pos DESC) AS rn FROM route_rows) WHERE rn = 1""",
    "report_rows": _report_rows(),
    "rewritten_files": rf"""SELECT project_id, path, content, true AS changed FROM (SELECT project_id, path, old,
CASE WHEN {_walked('path')} AND regexp_extract(content, '\bclass\s+(\w+)', 1) NOT IN ('', {_STEM.format(p='path')})
THEN regexp_replace(content, '\bclass\s+\w+', 'class ' || {_STEM.format(p='path')}) ELSE content END AS content
FROM long_tagged) WHERE old <> content""",
    "signature_counts": "SELECT project_id, path, framework, CAST(hits AS INT) AS hits FROM sig_file",
    "signature_hits_by_kind": "SELECT project_id, framework, kind, CAST(SUM(hits) AS BIGINT) AS hits FROM sig_new GROUP BY ALL",
    "database_file_class": "SELECT * FROM db_file",
    "architecture_flags": "SELECT * FROM arch_file",
    "test_file_flags": "SELECT * FROM test_file",
    "template_spaghetti": "SELECT * FROM spaghetti",
    "version_parts": f"SELECT project_id, ord, name, version_string, {_major('version_string')} AS major, {_minor('version_string')} AS minor FROM pk",
    "unstable_constraints": f"""SELECT *, CASE WHEN unstable THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS multiplier FROM (
SELECT project_id, ord, name, version_string, {_any("coalesce(version_string, '')", fixed.UNSTABLE_MARKERS)} AS unstable FROM pk)""",
    "package_catalogue_join": "SELECT * FROM known",
    "fingerprint_match": "SELECT * FROM matched",
    "prefix_package_match": "SELECT * FROM owned",
    "incompatible_packages": "SELECT * FROM incompatible",
    "target_version_lookup": "SELECT * FROM fw_targets",
    "dependency_registry_join": "SELECT * FROM with_latest",
    "foreign_key_edges": "SELECT * FROM edges",
    "scenario_matrix": "SELECT * FROM scen",
    "framework_certainty": "SELECT * FROM detected",
    "framework_coupling": "SELECT * FROM coupling",
    "database_coupling": "SELECT project_id, database_coupling, database_detected FROM db_score",
    "dependency_compatibility": f"SELECT {_SCEN}, dependency_compatibility FROM compat",
    "php_version_penalty": f"SELECT {_SCEN}, php_version, php_penalty FROM penalty",
    "architecture_score": "SELECT * FROM arch_score",
    "test_coverage": "SELECT * FROM test_score",
    "codebase_size": "SELECT * FROM size_score",
    "template_engine": "SELECT project_id, template_engine FROM engines",
    "template_count": "SELECT project_id, template_count FROM engines",
    "template_score": "SELECT * FROM template_scores",
    "dependency_upgrade": "SELECT * FROM dep_upgrade",
    "outdated_dependencies": "SELECT * FROM outdated",
    "php_version_upgrade": "SELECT * FROM php_upgrade",
    "framework_version_upgrade": "SELECT * FROM fw_upgrade",
    "migration_total": "SELECT project_id, source_choice, target_framework, includes_templating, total FROM mig",
    "upgrade_total": "SELECT project_id, target_php, total FROM upg",
    "difficulty_bands": """SELECT 'migration' AS report, target_framework AS target, band, COUNT(*) AS projects FROM mig GROUP BY ALL
UNION ALL SELECT 'upgrade', target_php, band, COUNT(*) FROM upg WHERE has_manifest GROUP BY ALL""",
    "legacy_progress": f"""SELECT {_SCEN}, legacy_count, file_count AS new_count, {_PROGRESS} AS progress, legacy_coupling,
{_band('legacy_coupling', fixed.LEGACY_LABELS)} AS label FROM mig WHERE legacy_count > 0""",
    "mixed_codebase": """SELECT p.project_id, COUNT(d.framework) AS framework_count, COUNT(d.framework) > 1 AS is_mixed
FROM projects p LEFT JOIN detected d ON d.project_id = p.project_id GROUP BY p.project_id""",
    "primary_framework": "SELECT project_id, framework AS primary_framework, name, version_string, certainty FROM primary_fw",
    "representative_package": "SELECT * FROM representative",
    "first_php_package": "SELECT * FROM first_php",
    "version_order": f"SELECT name, version, array_to_string({_key('version')}, '.') AS version_key FROM registry",
    "all_packages": "SELECT project_id, ord, section, name, version_string FROM pk",
    "directory_order": "SELECT project_id, dir, CAST(len(string_split(dir, '/')) AS INT) AS depth FROM php_dirs",
    "routes": "SELECT * FROM route_rows",
    "route_count": "SELECT project_id, COUNT(*) AS route_count FROM route_rows GROUP BY project_id",
    "short_tag_rewrite": "SELECT project_id, path, content, old <> content AS changed FROM long_tagged",
    "multi_class_census": """SELECT project_id, CAST(SUM(len(found)) AS BIGINT) AS class_count, COUNT(*) FILTER (len(found) > 1) AS multi_class_files
FROM classes GROUP BY project_id""",
    "class_split_plan": """SELECT c.project_id, c.path, c.pos, c.namespace, c.class_name, c.new_name, c.target_path,
c.rn = 1 AND NOT EXISTS (SELECT 1 FROM code_files f WHERE f.project_id = c.project_id AND f.path = c.target_path) AS written
FROM class_targets c""",
    "class_name_sync": rf"""SELECT project_id, path, class_name, new_name, regexp_replace(content, '\bclass\s+\w+', 'class ' || new_name) AS content
FROM (SELECT *, regexp_extract(content, '\bclass\s+(\w+)', 1) AS class_name, {_STEM.format(p='path')} AS new_name FROM php_walked)
WHERE class_name NOT IN ('', new_name)""",
    "braceless_if_census": rf"""SELECT project_id, path, CAST(len(regexp_extract_all(
regexp_replace({_CODE}, '(->|::)if\b', '\1_', 'gi'), '(?i)\bif\s*\({_NESTED}*\)\s*[^\s{{:]')) AS INT) AS braceless_ifs FROM code_files
WHERE ends_with(path, '.php') AND NOT regexp_matches(path, '(^|/)[.]')""",
    "directory_rename_plan": """SELECT r.project_id, r.dir, CAST(len(string_split(r.dir, '/')) AS INT) AS depth, r.new_dir,
(SELECT string_agg(coalesce(k.new_name, regexp_replace(array_to_string(string_split(r.dir, '/')[:i], '/'), '^.*/', '')), '/' ORDER BY i)
 FROM range(1, 40) g(i) LEFT JOIN judged k ON NOT k.conflict AND k.project_id = r.project_id AND k.dir = array_to_string(string_split(r.dir, '/')[:i], '/')
 WHERE i <= len(string_split(r.dir, '/'))) AS final_dir,
lower(r.old_name) = lower(r.new_name) AS case_only, r.conflict
FROM judged r""",
    "directory_capitalise_plan": """SELECT t.project_id, t.dir, t.depth, t.new_dir, t.new_dir <> t.dir AS changed, t.new_dir <> t.dir AND (
EXISTS (SELECT 1 FROM path_dirs d WHERE d.project_id = t.project_id AND d.dir = t.new_dir)
OR EXISTS (SELECT 1 FROM titled o WHERE o.project_id = t.project_id AND o.new_dir = t.new_dir AND o.new_dir <> o.dir AND o.dir < t.dir)) AS conflict
FROM titled t""",
    "camel_case": f"""SELECT kind, name, {_camel('name')} AS camel_name, {_pascal('name')} AS pascal_name, {_pascal('name')} <> name AS changed FROM (
SELECT 'file' AS kind, {_STEM.format(p='path')} AS name FROM php_walked
UNION SELECT 'directory', unnest(string_split(path, '/')[:-2]) FROM php_walked
UNION SELECT 'class', unnest(found) FROM classes)""",
    "namespace_map": f"""SELECT DISTINCT project_id, replace(dir, '/', chr(92)) AS namespace, dir AS path FROM (
SELECT project_id, {_parent('path')} AS dir FROM php_walked) WHERE dir <> ''""",
    "schema_nodes": """SELECT project_id, table_name, '{ ' || table_name || ' | ' || string_agg(column_name || ' : ' || binding_type, ' | ' ORDER BY ordinal) || ' }' AS label
FROM bound_columns GROUP BY project_id, table_name""",
    "schema_summary": """SELECT t.project_id, t.n AS table_count, coalesce(e.found, 0) AS edge_count, coalesce(e.missing, 0) AS missing_count
FROM (SELECT project_id, COUNT(*) AS n FROM schema_tables GROUP BY project_id) t LEFT JOIN (
SELECT project_id, COUNT(*) FILTER (NOT missing_target) AS found, COUNT(*) FILTER (missing_target) AS missing
FROM edges GROUP BY project_id) e ON e.project_id = t.project_id""",
    "migration_report": f"SELECT {_MIG} FROM mig",
    "upgrade_report": """SELECT project_id, target_php, has_manifest, file_count, outdated_count, framework_version, dependencies, php_version,
codebase_size, total, band FROM upg""",
}
QUERIES["pack_counts"] = """SELECT f.project_id, f.path, p.framework, CAST(SUM((length(f.content) - length(replace(f.content, p.literal, ''))) // length(p.literal)) AS BIGINT) AS hits
FROM listed f JOIN (SELECT DISTINCT 'pack-' || (item_id % 7) AS framework, unnest(regexp_split_to_array(text, '[^a-z]+')) AS literal FROM benchmark) p
  ON length(p.literal) >= 5 AND contains(f.content, p.literal) GROUP BY ALL"""
QUERIES["prefix_matches"] = f"""SELECT n.name, g.prefix, g.owner, length(g.prefix) = MAX(length(g.prefix)) OVER (PARTITION BY n.name) AS longest
FROM (SELECT DISTINCT name FROM (SELECT name FROM registry UNION ALL SELECT name FROM ({QUERIES["manifest_packages"]}) m)) n
JOIN (SELECT DISTINCT unnest([string_split(name, '/')[1] || '/', name[:length(name) - 2]]) AS prefix, unnest([string_split(name, '/')[1], name]) AS owner
  FROM (SELECT name FROM registry UNION ALL SELECT name FROM ({QUERIES["manifest_packages"]}) m)) g ON starts_with(n.name, g.prefix)"""


def _needed(sql: str) -> list[str]:
    """Parts that a query uses, directly or not, in definition order."""
    found: set[str] = set()
    open_texts = [sql]
    while open_texts:
        text = open_texts.pop()
        for name in PARTS:
            if name not in found and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                found.add(name)
                open_texts.append(PARTS[name])
    return [name for name in PARTS if name in found]


def oracle_queries() -> dict[str, str]:
    out = {}
    for key, sql in QUERIES.items():
        parts = ",\n".join(f"{name} AS (\n{PARTS[name]}\n)" for name in _needed(sql))
        out[key] = f"WITH {parts}\n{sql}" if parts else sql
    return out
