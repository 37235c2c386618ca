"""Readers. Each returns a DataFrame keyed by ``project_id``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftgauge.functions import fixed_values as fixed
from shiftgauge.functions.versions import version_key

MANIFEST_SCHEMA = "require string, `require-dev` string, _corrupt_record string"
ROOT_MANIFEST = "composer.json"


class Corpus:
    """The tables of a corpus, as DataFrames or as functions that are called on first use.

    ``files`` (project_id, path, content) holds source and template files, ``paths``
    (project_id, path) every path that exists, ``manifests`` (project_id, content) the package
    manifests, ``registry`` (name, version) known package releases, ``releases`` (version) runtime
    releases, ``columns`` and ``foreign_keys`` the database schemas.
    """

    TABLES = ("projects", "files", "paths", "manifests", "registry", "releases", "columns", "foreign_keys")

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]):
        unknown = set(tables) - set(self.TABLES)
        if unknown:
            raise TypeError(f"unknown tables: {sorted(unknown)}")
        self._tables = tables
        self._shared: DataFrame | None = None

    @property
    def parsed(self) -> DataFrame:
        """The readable manifests, one row per project."""
        return parsed_manifests(self.manifests) if self._shared is None else self._shared

    def with_shared_manifests(self) -> Corpus:
        """The same corpus for a plan that asks the manifests many questions.

        The parsed rows pass an aggregate by project, which changes nothing, as there is one for each. But no
        filter and no choice of columns gets below it, so all questions have the same exchange, which runs once.
        """
        other = Corpus(**self._tables)
        known = self.parsed.filter("project_id is not null")  # else some questions would ask for that themselves
        other._shared = known.groupBy("project_id").agg(F.max("packages").alias("packages"))
        return other

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.TABLES or name not in self._tables:
            raise AttributeError(f"the corpus has no {name}")
        table = self._tables[name]
        if callable(table) and not isinstance(table, DataFrame):
            table = self._tables[name] = table()
        return table


def read_tree(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Files of checkouts stored as ``<root>/<project_id>/<path>``.

    Spark lists and splits the tree; use it once to load a tree into a table, and read the table
    from then on, because small files are slow to list.
    """
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(root)
    )
    plain = F.regexp_replace(F.col("path"), r"^[a-z0-9]+:/*", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    below = F.substr(plain, F.lit(len(base) + 1))
    return raw.select(
        F.substring_index(below, "/", 1).alias("project_id"),
        F.regexp_replace(below, r"^[^/]+/", "").alias("path"),
        F.col("content").cast("string").alias("content"),
    )


def root_manifests(manifests: DataFrame) -> DataFrame:
    """One manifest per project: the root one where paths are known, which are unique; else the first by content."""
    rows = manifests.filter(F.col("content").isNotNull())
    if "path" in manifests.columns:
        return rows.filter(F.ltrim("path", F.lit("/")) == ROOT_MANIFEST).select("project_id", "content")
    return rows.groupBy("project_id").agg(F.min("content").alias("content"))


def parsed_manifests(manifests: DataFrame) -> DataFrame:
    """One row per project with a readable manifest: its entries as an array, required ones first, in order.

    Most questions about a manifest are answered inside this row, without a shuffle. ``inline``
    keeps the text from being parsed more than once. A section that is no object, such as the ``[]``
    that stands for an empty one, has no entries; only text that is no JSON counts as missing.
    """
    parsed = F.from_json(
        "content", MANIFEST_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    )

    def entries(section: str) -> F.Column:
        is_object = F.startswith(F.ltrim(section), F.lit("{"))
        fields = F.from_json(F.when(is_object, F.col(section)), "map<string,string>")
        return F.map_entries(F.coalesce(fields, F.expr("cast(map() as map<string,string>)")))

    sections = (
        root_manifests(manifests)
        .select("project_id", F.inline(F.array(parsed)))
        .filter(F.col("_corrupt_record").isNull())
        .select("project_id", F.inline(F.array(F.struct(
            entries("require").alias("required"), entries("require-dev").alias("dev"),
        ))))
    )

    def entry(section: str, first: str) -> str:
        return (
            f"(e, i) -> struct(i + {first} as ord, '{section}' as section, "
            f"e.key as name, e.value as version_string)"
        )

    return sections.select(
        "project_id",
        F.expr(
            f"concat(transform(required, {entry('require', '1')}), "
            f"transform(dev, {entry('require-dev', '1 + size(required)')}))"
        ).alias("packages"),
    )


def manifest_packages(manifests: DataFrame) -> DataFrame:
    """One row per manifest entry: ``require`` entries in order, then ``require-dev`` entries."""
    return parsed_manifests(manifests).select("project_id", F.inline("packages"))


def all_packages(packages: DataFrame) -> DataFrame:
    """Required packages, then development packages, in manifest order; duplicates are kept."""
    return packages.filter(F.col("section").isin("require", "require-dev")).select(
        "project_id", "ord", "section", "name", "version_string"
    )


def with_manifest_flag(projects: DataFrame, parsed: DataFrame) -> DataFrame:
    """A missing manifest differs from an empty one, so the flag stays on the project row."""
    known = parsed.select("project_id", F.lit(True).alias("found"))
    return projects.join(known, "project_id", "left").select(
        "project_id", F.coalesce("found", F.lit(False)).alias("has_manifest")
    )


def registry_from_json(documents: DataFrame) -> DataFrame:
    """(name, version) rows from registry documents: ``{"packages": {name: [{version_normalized}]}}``."""
    schema = "packages map<string, array<struct<version_normalized: string>>>"
    return (
        documents.select(F.explode(F.from_json("content", schema)["packages"]).alias("name", "releases"))
        .select("name", F.explode("releases").alias("r"))
        .select("name", F.col("r.version_normalized").alias("version"))
    )


def releases_from_json(documents: DataFrame) -> DataFrame:
    """(version) rows from a release list: ``{major: {"version": ...}}``."""
    schema = "map<string, struct<version: string>>"
    return (
        documents.select(F.explode(F.from_json("content", schema)).alias("major", "r"))
        .select(F.col("r.version").alias("version"))
        .filter(F.coalesce("version", F.lit("")) != "")
    )


def registry_latest(registry: DataFrame) -> DataFrame:
    """Newest release per package; of equal versions the last by text. Pre-releases count; names with ``ext`` are not looked up."""
    return (
        registry.filter(~F.contains("name", F.lit("ext")))
        .groupBy("name")
        .agg(F.max_by("version", F.struct(version_key("version").alias("key"), "version")).alias("latest_version"))
    )


def latest_runtime(releases: DataFrame) -> DataFrame:
    """One row: the newest runtime release."""
    newest = F.struct(version_key("version").alias("key"), "version")
    return releases.agg(F.max_by("version", newest).alias("latest_php"))


def schema_columns(columns: DataFrame) -> DataFrame:
    """Columns of every table with the type that a database driver binds them as.

    Types are compared in lower case, without lengths and without words such as ``unsigned``; only
    ``tinyint(1)`` is told from other lengths, because it stands for a boolean.
    """
    written = F.trim(F.lower(F.col("type")))
    plain = F.trim(F.regexp_replace(F.regexp_replace(written, r"\s*\([^)]*\)", ""), r"\b(unsigned|signed|zerofill)\b", ""))
    kind = F.when(written.startswith("tinyint(1)"), F.lit("boolean")).otherwise(plain)
    bound = {}
    for name, target in fixed.BINDING_TYPES.items():
        bound.setdefault(target, []).append(name)
    binding = F.lit("STRING")
    for target, kinds in bound.items():
        binding = F.when(kind.isin(kinds), F.lit(target)).otherwise(binding)
    return columns.select("project_id", "table_name", "ordinal", "column_name", "type", binding.alias("binding_type"))
