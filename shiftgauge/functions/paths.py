"""Path expressions. Paths are relative to the project root and use forward slashes."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def directory(path: Column) -> Column:
    """Everything before the last slash; empty for a file in the root."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*\z", "")).otherwise(F.lit(""))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(base_name(path), r"\.[^.]*\z", "")


def join_path(parent: Column, name: Column) -> Column:
    return F.when(parent == "", name).otherwise(F.concat(parent, F.lit("/"), name))


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def is_hidden(path: Column) -> Column:
    return F.contains(F.concat(F.lit("/"), path), F.lit("/."))


def below_any(path: Column, directories: Iterable[str]) -> Column:
    """True below one of the directories: a bare name at any depth, ``a/b`` as a run of segments."""
    rooted = F.concat(F.lit("/"), path)
    names = [d.strip("/") for d in directories]
    tests = [F.contains(rooted, F.lit(f"/{d}/")) for d in names if d]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def ancestors(path: Column) -> Column:
    """All directories above a file, from the top: ``a/b/c.php`` gives ``[a, a/b]``."""
    parts = F.split(path, "/")
    return F.when(
        F.size(parts) > 1,
        F.transform(
            F.sequence(F.lit(1), F.size(parts) - 1),
            lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
        ),
    ).otherwise(F.array().cast("array<string>"))
