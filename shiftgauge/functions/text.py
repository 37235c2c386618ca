"""Text expressions. All of them stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql_literal(value: object) -> str:
    """A Python value as SQL text."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _shared_part(needles: Sequence[str]) -> str:
    """The longest text that all needles contain."""
    first, *others = needles
    parts = (first[i:j] for i in range(len(first)) for j in range(i + 1, len(first) + 1))
    return max((x for x in parts if all(x in other for other in others)), key=len, default="")


def contains_any(text: Column, needles: Sequence[str]) -> Column:
    """Needles that share a part are only looked for where that part occurs."""
    found = reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles])
    shared = _shared_part(needles)
    return F.contains(text, F.lit(shared)) & found if len(needles) > 1 and len(shared) > 2 else found


def starts_with_any(text: Column, prefixes: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(text, F.lit(p)) for p in prefixes])


def ends_with_any(text: Column, suffixes: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.endswith(text, F.lit(s)) for s in suffixes])


def occurrences(text: Column, literal: str) -> Column:
    """Non-overlapping, case-sensitive count of a literal.

    The ``contains`` guard is several times cheaper than ``replace``, and most literals are absent.
    """
    size = len(literal.encode())
    removed = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(literal), F.lit("")))
    return F.when(F.contains(text, F.lit(literal)), (removed / F.lit(size)).cast("int")).otherwise(F.lit(0))


def line_count(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def word(literal: str) -> str:
    """Regex for a literal at an ASCII word start.

    The literal comes first so that the engine can search for it; the look-behind then checks the
    boundary. A plain boundary escape would treat accented letters as part of a word.
    """
    return f"{literal}(?<!\\w{literal})"


WORD_END = r"(?!\w)"


def camel_case(name: Column) -> Column:
    spaced = F.regexp_replace(name, r"([a-z])([A-Z])", "$1 $2")
    kept = F.regexp_replace(spaced, r"[^a-zA-Z0-9\-_ ]+", "")
    joined = F.replace(F.initcap(F.lower(F.translate(kept, "-_", "  "))), F.lit(" "), F.lit(""))
    return F.concat(F.lower(F.substring(joined, 1, 1)), F.substring(joined, 2, 2**31 - 1))


def pascal_case(name: Column) -> Column:
    camel = camel_case(name)
    return F.concat(F.upper(F.substring(camel, 1, 1)), F.substring(camel, 2, 2**31 - 1))


def title_case(name: Column) -> Column:
    """Upper-case every letter that no other letter precedes; full stops and quotes do not count.

    ``initcap`` starts words at blanks only, so a marked blank is put behind every other
    non-letter and taken out again.
    """
    inner = r".:'`^"
    marked = F.regexp_replace(name, rf"(^[{inner}]+|[^\p{{L}}{inner}][{inner}]*)", "$1\u0001 ")
    return F.replace(F.initcap(marked), F.lit("\u0001 "), F.lit(""))


def _overlaps_itself(literal: str) -> bool:
    return any(literal.startswith(literal[i:]) for i in range(1, len(literal)))


class LiteralScanner:
    """Count many literals with one pass over the text per *anchor*, not one per literal.

    A literal that starts with a leading anchor (``extends ``) is found by listing, for every
    occurrence of the anchor, the few characters behind it; a literal that ends with a closing
    anchor (``(``) by the few characters before it. The short lists are then compared with the
    literals. The counts are exact: an anchor cannot overlap itself, so every occurrence is listed,
    and neither can most literals, so every listed occurrence counts. A literal that can overlap
    itself is looked up in the list and, only where it occurs, counted in the text; so is, everywhere,
    one without an anchor.
    """

    LEADING = ("use ", "extends ", "$this->", "defined(", "get_instance", "Yii::")
    CLOSING = ("(", "::")

    def __init__(self, literals: Iterable[str], text: str = "content", prefix: str = "scan"):
        self._text = text
        self._groups: dict[tuple[str, str], list[str]] = {}
        self._anchor_of: dict[str, tuple[str, str] | None] = {}
        for literal in literals:
            key = self._anchor_of[literal] = self._anchor(literal)
            if key is not None:
                self._groups.setdefault(key, []).append(literal)
        self._names = {key: f"{prefix}_{i}" for i, key in enumerate(self._groups)}

    def _anchor(self, literal: str) -> tuple[str, str] | None:
        for anchor in self.LEADING:
            if literal.startswith(anchor):
                return ("leading", anchor)
        for anchor in self.CLOSING:
            if literal.endswith(anchor) and literal.count(anchor) == 1 and len(literal) > len(anchor):
                return ("closing", anchor)
        return None

    @property
    def names(self) -> list[str]:
        return list(self._names.values())

    def columns(self, only_if: str = "true") -> list[Column]:
        """First projection: the short lists, or null. ``only_if`` skips rows not to be read."""
        out = []
        for (side, anchor), literals in self._groups.items():
            width = max(len(x) for x in literals) - len(anchor)
            quoted = re.escape(anchor)
            if side == "leading":
                pattern = sql_literal(f"(?s){quoted}(?=(.{{0,{width}}}))")
                found = f"regexp_extract_all({self._text}, {pattern}, 1)"
            else:
                found = f"transform(split({self._text}, {sql_literal(quoted)}), part -> right(part, {width}))"
            # The search for the anchor stops at its first occurrence, and saves the costlier pass
            # where there is none.
            present = f"{only_if} and contains({self._text}, {sql_literal(anchor)})"
            out.append(F.expr(f"if({present}, {found}, null)").alias(self._names[(side, anchor)]))
        return out

    def count(self, literals: Iterable[str]) -> Column:
        """Second projection: total count of some of the scanner's literals.

        It needs the columns of the first projection and the text itself.
        """
        wanted: dict[tuple[str, str] | None, list[str]] = {}
        for literal in literals:
            wanted.setdefault(self._anchor_of[literal], []).append(literal)
        terms = [self._in_text(x) for x in wanted.pop(None, [])]
        for key, found in wanted.items():
            plain = [x for x in found if not _overlaps_itself(x)]
            if plain:
                hits = " + ".join(f"int({self._match(key, x)})" for x in plain)
                terms.append(f"coalesce(aggregate({self._listed(key)}, 0, (n, part) -> n + {hits}), 0)")
            terms += [
                f"if(exists({self._listed(key)}, part -> {self._match(key, x)}), {self._in_text(x)}, 0)"
                for x in found
                if _overlaps_itself(x)
            ]
        return F.expr(" + ".join(terms) or "0")

    def _listed(self, key: tuple[str, str]) -> str:
        name = self._names[key]
        # The last part of a split has no anchor behind it.
        return name if key[0] == "leading" else f"slice({name}, 1, size({name}) - 1)"

    def _match(self, key: tuple[str, str], literal: str) -> str:
        side, anchor = key
        if side == "leading":
            return f"startswith(part, {sql_literal(literal[len(anchor):])})"
        return f"endswith(part, {sql_literal(literal[: -len(anchor)])})"

    def _in_text(self, literal: str) -> str:
        quoted, size = sql_literal(literal), len(literal.encode())
        removed = f"octet_length({self._text}) - octet_length(replace({self._text}, {quoted}, ''))"
        return f"if(contains({self._text}, {quoted}), int(({removed}) / {size}), 0)"
