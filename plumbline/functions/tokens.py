"""Tokens after the rules of the Penn treebank, as one chain of replacements.

Quotation marks, brackets and most marks stand alone, commas and colons but
before digits, points at the ends of words, and runs of points and dashes;
contractions and a few words written together come apart. What is left between
white space is a token, so words with hyphens, slashes or inner points stay whole.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
#: Ends of contractions, the letters that an apostrophe stands before in them, and words written together with their parts.
ENDS = ("'[sSmMdD]?", "'ll", "'LL", "'re", "'RE", "'ve", "'VE", "n't", "N'T")
AFTER_APOSTROPHE = ("re", "ve", "ll", "m", "t", "s", "d", "n")
TOGETHER = (("can", "not"), ("d", "'ye"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("more", "'n"), ("wan", "na"), ("'t", "is"), ("'t", "was"))


def _rules() -> list[tuple[str, str]]:
    """Patterns and what they are replaced by, in order."""
    edge = rf"(?!{WORD})"
    rules = [
        (r"""["`“”«»„‘’]|''""", " $0 "),
        (r"[:,](?!\p{Nd})", " $0 "),
        (r"\.{2,}|[;@#$%&?!*\[\](){}<>]|--", " $0 "),
        (rf"""\.(?=[\])}}>"'»”’ ]*(?:{SPACE}|\z))""", " ."),
        (rf"(?i)'(?!{'|'.join(AFTER_APOSTROPHE)})({WORD}){edge}", "' $1"),
        (f"([^' ])({'|'.join(ENDS)}) ", "$1 $2 "),
    ]
    for first, second in TOGETHER:
        before = " " if first == "'t" else rf"(?<!{WORD})"
        rules.append((rf"(?i){before}({first})({second}){edge}", f"{' ' if first == chr(39) + 't' else ''}$1 $2"))
    return rules


def treebank_tokens(v: Column) -> Column:
    """Array of a text's tokens."""
    text = F.concat(F.lit(" "), v, F.lit(" "))
    for pattern, into in _rules():
        text = F.regexp_replace(text, pattern, into)
    return F.filter(F.split(text, SPACE + "+"), lambda t: t != "")
