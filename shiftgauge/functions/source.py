"""Source text with all that is no code blanked: one linear pass in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Loops here run over single characters only, which the engine does without recursion, and every token that is never
# closed goes on to the end, so that no start is tried twice.
_QUOTED = "|".join(rf"{q}.*?(?:(?<!\\)(?:\\\\)*+{q}|\z)" for q in "'\"`")
_HEREDOC = r"<<<[ \t]*([\"']?)(\w+)\1\r?\n.*?(?:(?<=\n)[ \t]*\2\b|\z)"
_COMMENT = r"(?://|#(?!\[))[^\r\n]*?(?=\?>|[\r\n]|\z)|/\*.*?(?:\*/|\z)"
_MARKUP = r"\?>.*?(?:<\?(?!xml)(?:php\b|=)?|\z)"
TOKEN = rf"(?is){_MARKUP}|{_COMMENT}|{_QUOTED}|{_HEREDOC}|[^'\"`#/<?]++|."


def code_only(content: Column) -> Column:
    """The text with comments and inline markup blanked, strings and heredocs as a pair of quotes around blanks.

    Every character and line keeps its place. Text before the first open tag is markup; a text without any is taken as a
    piece of code. Leaving code ends a statement, so a semicolon stands there. A string, comment or heredoc without an end goes on to the end
    of the text. Quotes inside braces of an interpolated string are taken for its end. Null gives null.
    """

    def blank(text: Column) -> Column:
        return F.regexp_replace(text, r"[^\r\n]", " ")

    def kept(token: Column) -> Column:
        size, start = F.length(token), lambda *texts: [F.startswith(token, F.lit(t)) for t in texts]
        quoted, hidden = start("'", '"', "`", "<<<"), start("//", "/*", "#")
        inner = F.concat(F.lit("'"), blank(F.substr(token, F.lit(2), size - 2)), F.lit("'"))
        return (
            F.when(size == 1, token)
            .when(start("?>")[0], F.concat(F.lit(";"), blank(F.substr(token, F.lit(2)))))
            .when(hidden[0] | hidden[1] | hidden[2], blank(token))
            .when(quoted[0] | quoted[1] | quoted[2] | quoted[3], inner)
            .otherwise(token)
        )

    # A text with tags begins outside code, as if it stood behind a close tag.
    before = F.when(F.contains(content, F.lit("<?")), "?>").otherwise("")
    tokens = F.regexp_extract_all(F.concat(before, content), F.lit(TOKEN), F.lit(0))
    return F.substr(F.array_join(F.transform(tokens, kept), ""), F.length(before) + 1)
