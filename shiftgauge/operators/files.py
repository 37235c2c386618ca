"""File listings. They read paths only, so the content column is never scanned for them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftgauge.functions import fixed_values as fixed
from shiftgauge.functions.paths import below_any, is_hidden
from shiftgauge.functions.text import ends_with_any


@dataclass(frozen=True)
class ScanConfig:
    """Directories to leave out, and directories that hold the code being moved away from."""

    exclude: tuple[str, ...] = ("vendor", "node_modules", "var")
    legacy_dirs: tuple[str, ...] = ()


def is_php(path: Column) -> Column:
    return F.endswith(path, F.lit(".php"))


def is_walked(path: Column, config: ScanConfig) -> Column:
    """Neither hidden nor below an excluded or version-control directory."""
    return ~is_hidden(path) & ~below_any(path, (*config.exclude, *fixed.VCS_DIRS))


def is_listed(path: Column, config: ScanConfig) -> Column:
    """A source file of the new code: excluded and legacy directories are left out."""
    return is_php(path) & is_walked(path, config) & ~below_any(path, config.legacy_dirs)


def legacy_matches(path: Column, config: ScanConfig) -> Column:
    """The legacy directories that list the file. Excludes count from the legacy directory down."""
    found = []
    for raw in config.legacy_dirs:
        name = raw.strip("/")
        rest = F.substr(path, F.lit(len(name) + 2))
        inside = F.startswith(path, F.lit(name + "/")) & is_php(path) & is_walked(rest, config)
        found.append(F.when(inside, F.lit(name)))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def legacy_times(path: Column, config: ScanConfig) -> Column:
    """How many legacy directories list the file; overlapping ones list it more than once."""
    return F.size(legacy_matches(path, config)) if config.legacy_dirs else F.lit(0)


def in_template_list(path: Column, config: ScanConfig) -> tuple[Column, Column]:
    """Membership in the two template listings: by ending, and by view directory."""
    walked = is_walked(path, config)
    by_ending = walked & ends_with_any(path, fixed.TEMPLATE_ENDINGS)
    by_directory = walked & is_php(path) & F.rlike(path, F.lit(fixed.TEMPLATE_DIRS))
    return by_ending, by_directory


def scan_code_files(files: DataFrame, config: ScanConfig) -> DataFrame:
    """Source files of a project, excluded directories left out."""
    path = F.col("path")
    return files.filter(is_php(path) & is_walked(path, config)).select("project_id", "path")


def exclude_dirs(files: DataFrame, config: ScanConfig) -> DataFrame:
    """Files of any kind that are not below an excluded directory."""
    return files.filter(~below_any(F.col("path"), config.exclude)).select("project_id", "path")


def legacy_split(files: DataFrame, config: ScanConfig) -> DataFrame:
    """New and legacy listings in one pass; a file may be listed more than once."""
    path = F.col("path")
    new = F.when(is_listed(path, config), F.array(F.lit(None).cast("string"))).otherwise(
        F.array().cast("array<string>")
    )
    return (
        files.filter(is_php(path))
        .select("project_id", "path", F.explode(F.concat(new, legacy_matches(path, config))).alias("legacy_dir"))
        .select("project_id", "path", "legacy_dir", F.col("legacy_dir").isNotNull().alias("is_legacy"))
    )


def template_files(files: DataFrame, config: ScanConfig) -> DataFrame:
    """Both template listings; a file that is in both appears twice."""
    by_ending, by_directory = in_template_list(F.col("path"), config)
    lists = F.array_compact(F.array(F.when(by_ending, F.lit(0)), F.when(by_directory, F.lit(1))))
    return files.select("project_id", "path", F.explode(lists).alias("list_no"))


