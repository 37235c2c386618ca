"""Conversations in reply order, linked by what messages quote.

A line that begins with `>` marks is quoted, as many levels deep as it has marks. Consecutive lines of one level are
a passage, whose words without marks, in lower case and single-spaced, do not depend on where lines were wrapped.
Its overlapping runs of SHINGLE words and its whole lines are hashed and looked up among those that messages of the
conversation wrote themselves, each at the first message that wrote it; the original of a passage is the message
with the longest match. A message replies to the earlier message that most of its first-level lines come from, else
to the turn before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftgauge.llm.common import stored

#: Marks before a quoted line: blanks and `>`, beginning with at most three blanks.
MARKS = r"^ {0,3}>[ >\t]*"
#: Words of a run that is looked up. Whole lines of fewer words count only while one message alone has written them.
SHINGLE = 5


def lines(messages: DataFrame) -> DataFrame:
    """conv_id, turn, line_no, level, line, plain of every line; blank lines have an empty plain."""
    split = messages.select("conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n")).alias("line_no", "raw"))
    marks = F.regexp_extract("raw", MARKS, 0)
    level = F.length(F.regexp_replace(marks, "[^>]", ""))
    line = F.substr(F.col("raw"), F.length(marks) + 1)
    plain = F.lower(F.trim(F.regexp_replace(line, r"\s+", " ")))
    return split.select(
        "conv_id", "turn", "line_no", level.alias("level"), line.alias("line"),
        plain.alias("plain"),
    )


def passages(cut: DataFrame) -> DataFrame:
    """conv_id, turn, level, passage (the number of its first line), hash, n_words, first_line, last_line: runs of
    SHINGLE words and whole lines of every passage."""
    of = Window.partitionBy("conv_id", "turn", "level").orderBy("line_no")
    runs = cut.withColumn("run", F.col("line_no") - F.row_number().over(of)).groupBy("conv_id", "turn", "level", "run").agg(
        F.min("line_no").alias("passage"),
        F.sort_array(F.collect_list(F.when(F.col("plain") != "", F.struct("line_no", "plain")))).alias("lines"),
    )
    words = F.flatten(F.transform("lines", lambda x: F.transform(
        F.split(x["plain"], " "), lambda w: F.struct(w.alias("word"), x["line_no"].alias("line_no"))
    )))
    cut_words = runs.select("conv_id", "turn", "level", "passage", "lines", F.explode(F.array(words)).alias("words"))
    piece = lambda text, n, first, last: F.struct(
        F.xxhash64(text).alias("hash"), n.cast("int").alias("n_words"), first.alias("first_line"), last.alias("last_line")
    )
    starts = F.when(F.size("words") >= SHINGLE, F.sequence(F.lit(1), F.size("words") - SHINGLE + 1))
    shingles = F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda at: piece(
        F.array_join(F.transform(F.slice("words", at, SHINGLE), lambda x: x["word"]), " "), F.lit(SHINGLE),
        F.element_at("words", at)["line_no"], F.element_at("words", at + SHINGLE - 1)["line_no"],
    ))
    whole = F.transform("lines", lambda x: piece(x["plain"], F.size(F.split(x["plain"], " ")), x["line_no"], x["line_no"]))
    return cut_words.select("conv_id", "turn", "level", "passage", F.inline(F.concat(shingles, whole)))


def linked(cut: DataFrame) -> DataFrame:
    """conv_id, turn, line_no, level, original: quoted lines and the turn of the message that they are from.

    Of the messages that a passage shares runs with, the one with the most counts, of equals the earliest.
    """
    quoted = passages(cut.filter("level > 0"))
    quoting = cut.filter("level > 0").select("conv_id").distinct()
    own = passages(cut.filter("level = 0").join(quoting, "conv_id", "left_semi"))
    own = own.groupBy("conv_id", "hash", "turn").agg(F.min("n_words").alias("n_words"))
    keys = ["conv_id", "hash"]
    first = own.groupBy(*keys).agg(F.min("turn").alias("original"))
    second = own.filter(F.col("n_words") < SHINGLE).join(first, keys).filter("turn > original")
    once = first.join(second.groupBy(*keys).agg(F.min("turn").alias("again")), keys, "left")
    met = quoted.join(once, keys).filter("original < turn and (again is null or again >= turn)")
    passage = ["conv_id", "turn", "level", "passage"]
    shared = met.groupBy(*passage, "original").agg(
        F.count_distinct("hash").alias("n"), F.collect_set(F.struct("first_line", "last_line")).alias("spans")
    )
    best = shared.groupBy(*passage).agg(F.max(F.struct("n", (-F.col("original")).alias("earliest"), "spans")).alias("best"))
    span = best.select(*passage, (-F.col("best.earliest")).alias("original"), F.inline("best.spans"))
    lines_of = span.select(
        "conv_id", "turn", "level", "original", F.explode(F.sequence("first_line", "last_line")).alias("line_no")
    ).distinct()
    written = cut.filter("level > 0 and plain <> ''").select("conv_id", "turn", "level", "line_no")
    return lines_of.join(written, ["conv_id", "turn", "level", "line_no"]).select("conv_id", "turn", "line_no", "level", "original")


def parents(links: DataFrame) -> DataFrame:
    """conv_id, turn, quoted_turn, linked_lines: the message that most linked lines of the lowest level come from.

    Of equals the latest counts.
    """
    votes = links.groupBy("conv_id", "turn", "level", "original").agg(F.count("*").alias("votes"))
    first = F.max(F.struct((-F.col("level")).alias("nearest"), "votes", "original")).alias("first")
    return votes.groupBy("conv_id", "turn").agg(first, F.sum("votes").alias("linked_lines")).select(
        "conv_id", "turn", F.col("first.original").alias("quoted_turn"), "linked_lines"
    )


def threads(replies: DataFrame) -> DataFrame:
    """conv_id, turn, root_turn, depth of messages (conv_id, turn, parent_turn), by doubling of steps upwards.

    A message leaves the rounds when it has reached the root of its thread, so only long threads take many.
    """
    first = replies.select(
        "conv_id", "turn", F.coalesce("parent_turn", "turn").alias("root_turn"),
        F.col("parent_turn").isNotNull().cast("long").alias("depth"), F.col("parent_turn").isNotNull().alias("moved"),
    )
    step = stored(first, "steps")
    done = step.filter("not moved").drop("moved")
    while True:
        moving = step.filter("moved").drop("moved")
        known = done.unionByName(moving)
        above = known.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("higher"), F.col("depth").alias("more"))
        risen = moving.join(above, ["conv_id", "root_turn"]).select(
            "conv_id", "turn", F.col("higher").alias("root_turn"), (F.col("depth") + F.col("more")).alias("depth"),
            (F.col("more") > 0).alias("moved"),
        )
        step = stored(risen, "steps")
        done = done.unionByName(step.filter("not moved").drop("moved"))
        if not step.filter("moved").limit(1).count():
            return done


def quote_links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, parent_turn, root_turn, depth, quoted_lines, linked_lines, text of every message.

    messages: conv_id, turn, role, text. `text` is without quoted lines, trimmed; null stays empty. Messages are in
    reply order when sorted by conv_id, root_turn, depth, turn. A message without linked lines replies to the
    message of turn - 1, and begins a thread where there is none. Rows without conv_id or turn belong to no
    conversation and are left out; of rows with the same conv_id and turn the one with the smallest (role, text)
    counts. Extra columns are left out; empty tables give no rows.
    """
    rows = messages.select(
        messages["conv_id"].cast("long").alias("conv_id"), messages["turn"].cast("long").alias("turn"),
        F.struct(messages["role"].cast("string").alias("role"), messages["text"].cast("string").alias("text")).alias("said"),
    ).filter("conv_id is not null and turn is not null")
    once = stored(rows.groupBy("conv_id", "turn").agg(F.min("said").alias("said")).select("conv_id", "turn", "said.*"), "messages")
    cut = lines(once)
    quoted = cut.groupBy("conv_id", "turn").agg(F.sum((F.col("level") > 0).cast("long")).alias("quoted_lines"))
    before = once.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("before"))
    keys = ["conv_id", "turn"]
    replies = stored(
        once.select(*keys)
        .join(parents(linked(cut)), keys, "left")
        .join(before, keys, "left")
        .join(quoted, keys, "left")
        .select(
            *keys, F.coalesce("quoted_turn", "before").alias("parent_turn"), "quoted_lines",
            F.coalesce("linked_lines", F.lit(0)).alias("linked_lines"),
        ),
        "replies",
    )
    return (
        once.withColumn("text", own_text(F.col("text")))
        .join(replies, keys)
        .join(threads(replies), keys)
        .select(*keys, "role", "parent_turn", "root_turn", "depth", "quoted_lines", "linked_lines", "text")
    )


def own_text(text: Column) -> Column:
    """The text without its quoted lines."""
    kept = F.filter(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda line: ~line.rlike(MARKS))
    return F.trim(F.array_join(kept, "\n"))
