"""Text functions as column expressions, with Python's meaning of white space, words and case."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .language import LANGUAGES, detect_language  # noqa: F401
from .sentences import count_sentences  # noqa: F401
from .tokens import treebank_tokens

# Python's str classes, spelt out for Java regular expressions.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
SOLID = r"[^\s\x1c-\x1f\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
META = r"[.^$*+?{}\[\]|()\\]"

RELATIONS = ("at most", "at least", "around", "less than")


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once a row, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), 0)


def strip(v: Column) -> Column:
    return F.regexp_replace(v, rf"\A{SPACE}+|(?<!{SPACE}){SPACE}++\z", "")


def solid(v: Column) -> Column:
    """Whether there is anything but white space."""
    return v.rlike(SOLID)


def quoted(v: Column) -> Column:
    """A pattern that matches ``v`` itself."""
    return F.concat(F.lit(r"\Q"), F.replace(v, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def whole_word(v: Column) -> Column:
    return F.concat(F.lit("(?iu)" + EDGE), quoted(v), F.lit(EDGE))


def related(n: Column, relation: Column, threshold: Column, tolerance: int) -> Column:
    """False for a relation that isn't known or an argument that is missing."""
    fits = (
        F.when(relation == "at most", n <= threshold)
        .when(relation == "at least", n >= threshold)
        .when(relation == "around", F.abs(n - threshold) <= tolerance)
        .when(relation == "less than", n < threshold)
        .otherwise(False)
    )
    return F.coalesce(fits, F.lit(False))


def is_upper(v: Column) -> Column:
    return v.rlike(r"\p{IsUppercase}") & ~v.rlike(r"[\p{IsLowercase}\p{Lt}]")


def is_lower(v: Column) -> Column:
    return v.rlike(r"\p{IsLowercase}") & ~v.rlike(r"[\p{IsUppercase}\p{Lt}]")


def count_words(v: Column) -> Column:
    return F.regexp_count(v, F.lit(WORD + "+")).cast("long")


def count_capital_words(v: Column) -> Column:
    """Tokens in capitals."""
    # Rules for tokens look no further than a word and the white space next to it, so words without a capital letter are left out.
    capital = rf"(?=({SPACE}[^\s\x1c-\x1f\x85\p{{Z}}\p{{IsUppercase}}]*+\p{{IsUppercase}}{SOLID}*+{SPACE}))"
    words = F.regexp_extract_all(F.concat(F.lit(" "), v, F.lit(" ")), F.lit(capital), F.lit(1))
    return F.size(F.filter(treebank_tokens(F.array_join(words, "")), is_upper)).cast("long")


# Words before a point that ends no sentence, words after which it does before an opener alone, openers, and ends of addresses.
TITLES = ("Mr", "St", "Mrs", "Ms", "Dr")
FIRMS = ("Inc", "Ltd", "Jr", "Sr", "Co")
OPENERS = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Capt", "Cpt", "Lt", r"He\s", r"She\s", r"It\s", r"They\s", r"Their\s", r"Our\s", r"We\s", r"But\s", r"However\s", r"That\s", r"This\s", "Wherever")
DOMAINS = ("com", "net", "org", "io", "gov", "edu", "me")


def sentence_ends() -> str:
    """A pattern for the ends of sentences: "!", "?", runs of points, and points whose neighbours make them ends. Groups hold an end and the quotation mark after it."""
    opener = "(?= (?:" + "|".join(OPENERS).replace(r"\s", SPACE) + "))"
    firms = "|".join(FIRMS)
    # What makes a point part of a word: before it a title, a firm, a letter that stands alone, an acronym; around it digits, an acronym, an address.
    before = ["|".join(TITLES), f" (?:{firms})", " [A-Za-z]", r"[A-Za-z]\.[A-Za-z]", r"Ph\.D"]
    around = [f"(?:{'|'.join(DOMAINS)})", r"(?<=[0-9]\.)[0-9]", r"(?<=[A-Za-z]\.)[A-Za-z]\.", r"(?<=Ph\.)D\.", rf"(?<={SPACE}[A-Za-z]\.) "]
    plain = "".join(rf"(?<!(?:{x})\.)" for x in before) + "".join(f"(?!{x})" for x in around)
    return rf"(\.{{2,}})|(\.(?:(?<= (?:{firms})\.|[A-Z]\.[A-Z]\.){opener}|{plain}))([\"”]?)|([!?])(\"?)"


def split_sentences(v: Column) -> Column:
    """Array of sentences. An end that a quotation mark follows changes places with it. NUL in a text parts sentences too."""
    text = F.concat(F.lit(" "), F.regexp_replace(v, "\n", " "), F.lit("  "))
    parts = F.transform(F.split(F.regexp_replace(text, sentence_ends(), "$1$3$2$5$4\0"), "\0", -1), strip)
    return bound(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


#: Frequent English function words.
ENGLISH_STOP_WORDS = tuple(
    "i me my we our ours you your yours he him his she her hers it its they them their theirs what which who whom this that these those am is are was were be been being "
    "have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below "
    "to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so "
    "than too very can will just should now".split()
)


def count_stopwords(v: Column, words: Iterable[str] = ENGLISH_STOP_WORDS) -> Column:
    tokens = F.regexp_extract_all(F.lower(v), F.lit(WORD + "+"), F.lit(0))
    return F.size(F.filter(tokens, lambda x: x.isin(*words))).cast("long")


def sample_words(words: Column, k: int, seed: int) -> Column:
    """``k`` different entries of an array, at random."""
    return F.slice(F.shuffle(F.array_distinct(words), F.lit(seed)), 1, k)


def strip_thinking(v: Column) -> Column:
    """What stands between the first two ends of a thinking part; all of it where there is none."""
    mark = "</think>\n\n"
    return F.when(v.contains(mark), F.split_part(v, F.lit(mark), F.lit(2))).otherwise(v)


def loose_variants(v: Column) -> Column:
    """Eight readings: as it is, without its first, last, or both lines; and these without asterisks."""
    lines = F.split(v, "\n", -1)
    n = F.size(lines)

    def cut(start: int, fewer: int) -> Column:
        return strip(F.array_join(F.slice(lines, F.lit(start), F.greatest(n - fewer, F.lit(0))), "\n"))

    plain = [v, cut(2, 1), cut(1, 1), cut(2, 2)]
    return F.array(*plain, *[F.replace(x, F.lit("*"), F.lit("")) for x in plain])


def key_root(key: Column) -> Column:
    return F.split_part(key.cast("string"), F.lit(":"), F.lit(1))


def key_type(key: Column) -> Column:
    """The second part of a key; null where there is none."""
    return F.get(F.split(key.cast("string"), ":"), 1)


def sampling_id(prompt: Column) -> Column:
    """The number after the sampling mark; null where there is none."""
    return F.split_part(prompt, F.lit("--kk--"), F.lit(2)).try_cast("int")
