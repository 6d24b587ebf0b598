"""Patterns that users wrote for Python, as Java's engine reads them.

Both engines share most of the syntax. A pattern is cut into escapes, classes,
quantifiers and characters, and each piece gets the form that means the same in
Java: Python's classes of words, digits and white space, its ends of lines and
texts, braces that are no quantifier, and brackets and ampersands within
classes. What Java has no equal for, or Python rejects, stays with Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES, WORDS = r"\s\x1c-\x1f\x85\p{Z}", r"\p{L}\p{N}_"
BORDER = rf"(?:(?<=[{WORDS}])(?![{WORDS}])|(?<![{WORDS}])(?=[{WORDS}]))"
#: What a pattern is cut into: quantifiers in braces, classes, escapes, characters.
PIECE = r"\{[0-9]*,?[0-9]*\}|\[\^?\]?(?:\\[\s\S]|[^\]\\])*\]|\\[\s\S]|[\s\S]"
#: Escapes outside classes, and the parts of classes, that Java says otherwise.
ESCAPES = {r"\d": r"\p{Nd}", r"\D": r"\P{Nd}", r"\w": f"[{WORDS}]", r"\W": f"[^{WORDS}]", r"\s": f"[{SPACES}]", r"\S": f"[^{SPACES}]", r"\b": BORDER, r"\B": f"(?!{BORDER})", r"\v": r"\x0b", r"\Z": r"\z"}
IN_CLASS = {r"\d": r"\p{Nd}", r"\w": WORDS, r"\s": SPACES, r"\b": r"\x08", r"\v": r"\x0b", "[": r"\[", "&": r"\&"}
#: What stays with Python: references and octal numbers, letters that aren't escapes there, negated kinds within classes and ranges of kinds, groups
#: other than plain ones and looks ahead, quantifiers of quantifiers or of nothing, and brackets or escapes without an end.
PYTHON_ONLY = "|".join((
    r"(?:^|[^\\])(?:\\\\)*\\(?:[0-9cegh-lo-qyzCE-RT-VXYN]|[uUx]|$)", r"\[(?:\\[\s\S]|[^\]\\])*\\[WDSBAZ]", r"\\[wds]-[^\]]|-\\[wds]", r"\(\?(?![:=!])", r"(?:^|\||\()[*+{]|(?:^|\|)\?|\(\?[:=!][*+?{]", r"[*+?}][?+][*+?{]", r"[*+?][*{]|\}[*{]", r"[)][*+?{]*\{,",
    r"\\[bBAZ^$][*+?{]|[\^$][*+?{]",
))


def python_only(pattern: str) -> bool:
    if re.search(PYTHON_ONLY, pattern):
        return True
    pieces = re.findall(PIECE, pattern)
    return "[" in pieces or "\\" in pieces


def needs_python(pattern: Column) -> Column:
    """Whether a pattern is left to Python."""
    pieces = F.regexp_extract_all(pattern, F.lit(PIECE), F.lit(0))
    return pattern.rlike(PYTHON_ONLY) | F.exists(pieces, lambda p: (p == "[") | (p == "\\"))


def _chosen(piece: Column, forms: dict[str, str]) -> Column:
    out = F.when(F.lit(False), piece)
    for own, other in forms.items():
        out = out.when(piece == own, F.lit(other))
    return out.otherwise(piece)


def java_pattern(pattern: Column) -> Column:
    """The same pattern for Java, for those that don't need Python. ``(?d)`` before it gives Python's ends of lines."""

    def of_class(piece: Column) -> Column:
        opened = F.regexp_extract(piece, r"\A(\[\^?\]?)", 1)
        inner = F.regexp_extract_all(F.regexp_replace(piece, r"\A\[\^?\]?|\]\z", ""), F.lit(r"\\[\s\S]|[\s\S]"), F.lit(0))
        return F.concat(F.regexp_replace(opened, r"\]\z", r"\\]"), F.array_join(F.transform(inner, lambda x: _chosen(x, IN_CLASS)), ""), F.lit("]"))

    def of_piece(piece: Column) -> Column:
        quantifier = piece.rlike(r"\A\{(?:[0-9]+,?[0-9]*|,[0-9]*)\}\z")
        return (
            F.when(piece.startswith("[") & (F.length(piece) > 1), of_class(piece))
            .when(quantifier, F.regexp_replace(piece, r"\A\{,", "{0,"))
            .when(piece.startswith("{"), F.concat(F.lit("\\"), F.regexp_replace(piece, r"\}\z", r"\\}")))
            .otherwise(_chosen(piece, ESCAPES))
        )

    return F.array_join(F.transform(F.regexp_extract_all(pattern, F.lit(PIECE), F.lit(0)), of_piece), "")
