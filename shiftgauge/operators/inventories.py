"""Inventories: routes, classes, names, namespaces and directories of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftgauge.functions import fixed_values as fixed
from shiftgauge.functions.paths import ancestors, base_name, below_any, depth, directory, is_hidden, join_path, stem
from shiftgauge.functions.source import code_only
from shiftgauge.functions.text import WORD_END, camel_case, pascal_case, title_case, word
from shiftgauge.operators.files import ScanConfig, is_php, is_walked

CLASS = "(?i)" + word("class") + rf"\s+(\w+)\s*(?:extends{WORD_END}|implements{WORD_END}|\{{)"
# Blanks only at the line start: line breaks there would make long runs of empty lines slow.
NAMESPACE = r"(?im)^[ \t;]*namespace[ \t]+([\w\\]+)\s*[;{]"
# Not the name of a member.
IF_HEAD = "(?i)" + word("if") + r"(?<!(?:->|::)if)\s*\z"
IF_BODY = r"^\s*[^\s{:]"
#: Tasks over which the classes that claim one target are dealt.
CLAIM_SALTS = 64


def routes(files: DataFrame, config: ScanConfig) -> DataFrame:
    """Route definitions of every ``routes.php``, in order."""
    path = F.col("path")
    lines = F.filter(
        F.split("content", "\n"), lambda x: F.contains(x, F.lit("$route['")) & F.contains(x, F.lit("'] = '"))
    )
    # Up to the last place where a definition can end, so that no start is tried in vain.
    cut = F.transform(lines, lambda x: F.regexp_extract(x, fixed.ROUTE_END, 0))
    text = F.array_join(cut, "\n")
    found = F.arrays_zip(
        F.regexp_extract_all("text", F.lit(fixed.ROUTE), F.lit(1)).alias("route"),
        F.regexp_extract_all("text", F.lit(fixed.ROUTE), F.lit(2)).alias("target"),
    )
    return (
        files.filter((base_name(path) == "routes.php") & is_walked(path, config))
        .select("project_id", "path", F.explode(F.array(text)).alias("text"))
        .select("project_id", "path", F.posexplode(found).alias("pos", "r"))
        .select("project_id", "path", "pos", F.col("r.route").alias("route"), F.col("r.target").alias("target"))
    )


def route_count(found: DataFrame) -> DataFrame:
    return found.groupBy("project_id").agg(F.count(F.lit(1)).alias("route_count"))


def routes_dump(found: DataFrame) -> DataFrame:
    """Route to target; the last definition of a route wins."""
    return found.groupBy("project_id", "route").agg(
        F.max_by("target", F.struct("path", "pos")).alias("target")
    )


def write_routes(found: DataFrame, location: str, buckets: int = 64) -> None:
    """Write the route maps into a directory for each bucket of projects, one file per bucket and task.

    A project is in one file, its routes in order.
    """
    bucket = F.pmod(F.xxhash64("project_id"), F.lit(buckets)).cast("int")
    (
        routes_dump(found)
        .withColumn("bucket", bucket)
        .repartition("bucket", "project_id")
        .sortWithinPartitions("bucket", "project_id", "route")
        .write.mode("overwrite").partitionBy("bucket").json(location)
    )


def class_names(files: DataFrame, config: ScanConfig) -> DataFrame:
    """Source files, their code without comments, strings and markup, and the classes declared in it.

    Only texts in which a class could be declared are read token by token; `code` of the others is null.
    """
    path = F.col("path")
    maybe = F.rlike("content", F.lit("(?i)" + word("class") + r"\s"))
    code = files.filter(is_php(path) & is_walked(path, config)).select(
        "project_id", "path", F.when(maybe, code_only(F.col("content"))).alias("code")
    )
    found = F.regexp_extract_all("code", F.lit(CLASS), F.lit(1))
    return code.withColumn("classes", F.coalesce(found, F.array().cast("array<string>")))


def multi_class_census(files: DataFrame, config: ScanConfig) -> DataFrame:
    """Class declarations, and files with more than one. Comments, strings and markup do not count."""
    n = F.size("classes")
    return class_names(files, config).groupBy("project_id").agg(
        F.sum(n).alias("class_count"), F.count_if(n > 1).alias("multi_class_files")
    )


def class_split_plan(files: DataFrame, config: ScanConfig) -> DataFrame:
    """One row per class of a file with several: its new name and file, and whether it is written.

    An existing file is kept, and of several classes with one target only the first is written. Content is read
    once. Classes that claim one target are dealt over CLAIM_SALTS tasks, where the first of each is found; only
    these, and the existing file, meet in one task.
    """
    path = F.col("path")
    classes = (
        class_names(files, config)
        .filter(F.size("classes") > 1)
        .select(
            "project_id",
            "path",
            F.nullif(F.regexp_extract("code", NAMESPACE, 1), F.lit("")).alias("namespace"),
            F.posexplode("classes").alias("pos", "class_name"),
        )
        .withColumn("new_name", pascal_case(F.col("class_name")))
        .withColumn("target_path", join_path(directory(path), F.concat("new_name", F.lit(".php"))))
    )
    salt = F.pmod(F.xxhash64("path"), F.lit(CLAIM_SALTS))
    some = Window.partitionBy("project_id", "target_path", salt).orderBy("path", "pos")
    claims = classes.withColumn("first", F.row_number().over(some) == 1).withColumn("is_class", F.lit(True))
    existing = files.select(
        "project_id", path.alias("target_path"), F.lit(True).alias("first"), F.lit(False).alias("is_class")
    ).distinct()
    every = claims.unionByName(existing, allowMissingColumns=True)
    # Classes that lost already stand alone, under a key that no target has.
    key = F.when(F.col("first"), F.struct(F.col("target_path").alias("name"), F.lit(-1).alias("pos"))).otherwise(
        F.struct(path.alias("name"), "pos")
    )
    target = Window.partitionBy("project_id", key).orderBy("is_class", "path", "pos")
    return (
        every.withColumn("written", F.col("first") & (F.row_number().over(target) == 1))
        .filter("is_class")
        .select("project_id", "path", "pos", "namespace", "class_name", "new_name", "target_path", "written")
    )


def _braceless_ifs(code: F.Column) -> F.Column:
    """Conditions of any depth, in one pass over the code between parentheses.

    The text is cut behind every parenthesis. The fold keeps the depth, the depths at which an ``if`` has opened
    its condition, and whether the last cut closed one, in which case the next piece tells if a body follows.
    Only an ``if`` within the condition of another makes the list of depths longer.
    """
    pieces = F.split(code, r"(?<=[()])")

    def step(state: F.Column, piece: F.Column) -> F.Column:
        level, opened = state["level"], state["opened"]
        body = F.rlike(F.regexp_replace(piece, r"[()]\z", "("), F.lit(IF_BODY))
        opens, closes = F.endswith(piece, F.lit("(")), F.endswith(piece, F.lit(")"))
        head = opens & F.rlike(F.regexp_replace(piece, r"\(\z", ""), F.lit(IF_HEAD))
        ends = closes & (F.coalesce(F.get(opened, F.size(opened) - 1), F.lit(-1)) == level)
        # A parenthesis that nothing opened leaves the outermost level.
        moved = F.greatest(level + opens.cast("int") - closes.cast("int"), F.lit(0))
        rest = F.slice(opened, F.lit(1), F.greatest(F.size(opened) - 1, F.lit(0)))
        return F.struct(
            (state["n"] + (state["closed"] & body).cast("int")).alias("n"),
            moved.alias("level"),
            F.when(head, F.concat(opened, F.array(moved))).when(ends, rest).otherwise(opened).alias("opened"),
            ends.alias("closed"),
        )

    start = F.struct(
        F.lit(0).alias("n"), F.lit(0).alias("level"), F.array().cast("array<int>").alias("opened"), F.lit(False).alias("closed")
    )
    return F.aggregate(pieces, start, step, lambda state: state["n"])


def braceless_if_census(files: DataFrame) -> DataFrame:
    """Single-statement ``if`` without braces, per source file; not in comments, strings and markup."""
    path = F.col("path")
    has_if = F.rlike("content", F.lit("(?i)" + word("if") + WORD_END))
    code = files.filter(is_php(path) & ~is_hidden(path)).select(
        "project_id", "path", F.when(has_if, code_only(F.col("content"))).alias("code")
    )
    return code.select("project_id", "path", F.coalesce(_braceless_ifs(F.col("code")), F.lit(0)).alias("braceless_ifs"))


def names(files: DataFrame, config: ScanConfig) -> DataFrame:
    """All file, directory and class names of the corpus in camel and Pascal case."""
    path = F.col("path")

    def tagged(kind: str, found: F.Column) -> F.Column:
        return F.transform(found, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))

    segments = F.split(path, "/")
    listed = class_names(files, config).select(
        F.explode(
            F.concat(
                tagged("file", F.array(stem(path))),
                tagged("directory", F.slice(segments, F.lit(1), F.size(segments) - 1)),
                tagged("class", F.col("classes")),
            )
        ).alias("n")
    )
    distinct = listed.select("n.kind", "n.name").distinct()
    new = pascal_case(F.col("name"))
    return distinct.select(
        "kind", "name", camel_case(F.col("name")).alias("camel_name"), new.alias("pascal_name"),
        (new != F.col("name")).alias("changed"),
    )


def namespace_map(files: DataFrame, config: ScanConfig) -> DataFrame:
    """Namespace of every directory that holds source files; files in the root have none."""
    path = F.col("path")
    return (
        files.filter(is_php(path) & is_walked(path, config))
        .select("project_id", directory(path).alias("dir"))
        .filter(F.col("dir") != "")
        .distinct()
        .select("project_id", F.replace("dir", F.lit("/"), F.lit("\\")).alias("namespace"), F.col("dir").alias("path"))
    )


def source_directories(files: DataFrame, config: ScanConfig) -> DataFrame:
    """Distinct directories that have source files somewhere below them."""
    path = F.col("path")
    return (
        files.filter(is_php(path) & is_walked(path, config))
        .select("project_id", F.explode(ancestors(path)).alias("dir"))
        .distinct()
    )


def all_directories(files: DataFrame) -> DataFrame:
    return files.select("project_id", F.explode(ancestors(F.col("path"))).alias("dir")).distinct()


def directory_order(files: DataFrame, config: ScanConfig) -> DataFrame:
    """Source directories, deepest first, so that children are handled before their parents.

    The range sort includes the directory, so one huge project still spreads over tasks.
    """
    return source_directories(files, config).select("project_id", "dir", depth(F.col("dir")).alias("depth")).orderBy(
        "project_id", F.desc("depth"), "dir"
    )


def _flagged_directories(files: DataFrame, paths: DataFrame, config: ScanConfig) -> DataFrame:
    """All directories that exist, and whether source files are somewhere below them."""
    path = F.col("path")
    source = files.filter(is_php(path) & is_walked(path, config)).select("project_id", path, F.lit(True).alias("is_source"))
    every = source.unionByName(paths.select("project_id", "path", F.lit(False).alias("is_source")))
    return (
        every.select("project_id", "is_source", F.explode(ancestors(path)).alias("dir"))
        .groupBy("project_id", "dir")
        .agg(F.max("is_source").alias("is_source"))
    )


def _renamed(current: F.Column) -> F.Column:
    return join_path(directory(current), pascal_case(base_name(current)))


def _rename_winners(directories: DataFrame) -> DataFrame:
    """project_id, dir of the renames that succeed when they are done one after the other, by path.

    Children go before their parents, so a rename meets its siblings only. A path that no directory has goes to its
    first claimant. One that a directory has gets free when that directory was renamed before, and
    then goes to the next claimant. A third turn never comes: the new name of a new name is not renamed any more,
    so a path that got free in the second turn is wanted by nobody. Every path is one row of one aggregate.
    """
    current = F.col("dir")
    new = _renamed(current)
    moves = F.col("is_source") & (new != current) & (pascal_case(base_name(current)) != "")
    roles = F.array(
        F.struct(current.alias("at"), F.lit(None).cast("string").alias("claimant"), F.lit(True).alias("taken"), moves.alias("leaves")),
        F.when(moves, F.struct(new.alias("at"), current.alias("claimant"), F.lit(False).alias("taken"), F.lit(False).alias("leaves"))),
    )
    later = F.when(F.col("claimant") > F.col("at"), F.col("claimant"))
    places = (
        directories.select("project_id", F.explode(F.array_compact(roles)).alias("r"))
        .select("project_id", "r.*")
        .groupBy("project_id", "at")
        .agg(F.max("taken").alias("taken"), F.max("leaves").alias("leaves"), F.min("claimant").alias("first"), F.min(later).alias("next"))
        .filter("first is not null")
    )
    first = places.filter(~F.col("taken")).select("project_id", F.col("first").alias("dir"))
    freed = places.filter("leaves and next is not null").select("project_id", F.col("at").alias("dir"), "next")
    second = freed.join(first, ["project_id", "dir"]).select("project_id", F.col("next").alias("dir"))
    return first.unionByName(second)


def directory_rename_plan(files: DataFrame, paths: DataFrame, config: ScanConfig) -> DataFrame:
    """Renames of source directories to Pascal case, as if done one after the other, the deepest first and then by path.

    A rename is in conflict when its target exists at its turn: a directory that was there and has not been renamed
    before, or an earlier sibling that took the name. As children are renamed first, ``new_dir`` still has the old
    parent; ``final_dir`` has the new names of all directories on the way that are renamed, and the old ones of
    those in conflict.
    """
    current = F.col("dir")
    name = base_name(current)
    directories = _flagged_directories(files, paths, config)
    winners = _rename_winners(directories).withColumn("free", F.lit(True))
    plan = directories.filter("is_source").select("project_id", "dir").filter(pascal_case(name) != name)
    way = F.concat(ancestors(current), F.array("dir"))
    # Each step of the way looks its directory up among the winners; the last step is the directory itself.
    judged = (
        plan.select("project_id", "dir", F.posexplode(way).alias("place", "above"))
        .join(winners.withColumnRenamed("dir", "above"), ["project_id", "above"], "left")
        .groupBy("project_id", "dir")
        .agg(
            F.array_sort(F.collect_list(F.struct("place", "free", "above"))).alias("way"),
            F.bool_or((F.col("above") == current) & F.col("free")).alias("free"),
        )
    )
    step = lambda s: F.when(s["free"], pascal_case(base_name(s["above"]))).otherwise(base_name(s["above"]))
    return judged.select(
        "project_id",
        "dir",
        depth(current).alias("depth"),
        _renamed(current).alias("new_dir"),
        F.array_join(F.transform("way", step), "/").alias("final_dir"),
        (F.lower(name) == F.lower(pascal_case(name))).alias("case_only"),
        (~F.coalesce("free", F.lit(False))).alias("conflict"),
    )


def directory_capitalise_plan(paths: DataFrame, config: ScanConfig) -> DataFrame:
    """Title-case names for the directories below the top level, with or without source files.

    A change is in conflict when its target exists or an earlier sibling claims it.
    """
    current = F.col("dir")
    new = join_path(directory(current), title_case(base_name(current)))
    every = all_directories(paths)
    plan = (
        every.filter((depth(current) >= 2) & ~is_hidden(current))
        .filter(~below_any(F.concat(current, F.lit("/")), (*config.exclude, *fixed.VCS_DIRS)))
        .select("project_id", "dir", depth(current).alias("depth"), new.alias("new_dir"), (new != current).alias("changed"))
    )
    winners = (
        plan.filter("changed")
        .groupBy("project_id", "new_dir")
        .agg(F.min("dir").alias("dir"))
        .join(every.withColumnRenamed("dir", "new_dir"), ["project_id", "new_dir"], "left_anti")
        .select("project_id", "dir", F.lit(True).alias("free"))
    )
    return plan.join(winners, ["project_id", "dir"], "left").select(
        "project_id", "dir", "depth", "new_dir", "changed", (F.col("changed") & F.col("free").isNull()).alias("conflict")
    )
