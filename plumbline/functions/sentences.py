"""Numbers of sentences, with points that end none told by a fitted model.

A point before white space ends a sentence unless it belongs to an abbreviation,
an initial, a number or a row of points; after these the next word decides: one
that is usually written small, but isn't here, begins a sentence, and one in
small letters doesn't.

``fit`` learns the abbreviations of a corpus without labels, after Kiss and
Strunk (2006): how much likelier a word is followed by a point than words are
on the whole (a log-likelihood ratio), weighted for short words and points
within, and against words that also stand without a point. Which words are
usually written small comes from the same corpus. All of it is counted by
grouped aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .language import applied

SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
#: What may stand behind a mark, and before a word.
CLOSERS, OPENERS = r"""["'”’»)\]}*」』）]""", r"""["'“‘«(\[{*「『（]"""
#: Marks after which a sentence ends in any case; those of the second kind need no white space.
MARKS, WIDE_MARKS = "!?", "。！？"

#: Words whose point ends no sentence.
ABBREVIATIONS = tuple(
    "mr mrs ms dr prof rev hon st sr jr gen rep sen gov pres capt cpt col maj lt sgt adm messrs mme mlle esq inc ltd co corp bros llc plc assn dept univ vs etc e.g i.e cf viz al approx "
    "no nos vol vols fig figs eq eqs sec ch pp p ed eds jan feb apr jun jul aug sep sept oct nov dec tues thurs ave blvd rd hwy mt ft u.s u.k u.n d.c a.m p.m ph.d b.a m.a m.d b.c a.d tel ext hr hrs sq".split()
)
#: Words that are written small, but for the first of a sentence.
SMALL = tuple(
    "me my we our ours you your yours he him his she her hers it its they them their theirs what which who whom this that these those am is are was were be been being have has had having do does did doing a an the "
    "and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where "
    "why how all any both each few more most other some such nor not only own same so than too very can will just should now however also please perhaps maybe yet still thus therefore meanwhile although since".split()
)
#: Least score of an abbreviation, and how often its words are taken to have a point.
LEAST_SCORE, OFTEN = 0.3, 0.99


@dataclass(frozen=True)
class Model:
    abbreviations: tuple[str, ...] = ABBREVIATIONS
    small: tuple[str, ...] = SMALL


DEFAULT = Model()


def among(x: Column, words: tuple[str, ...]) -> Column:
    """Whether ``x`` is one of ``words``, by one look-up however many they are."""
    return applied(x, "w", "w in (" + ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words) + ")") if words else F.lit(False)


def _stripped(token: Column) -> Column:
    """A token without marks of quotation and brackets around it."""
    return F.regexp_replace(token, rf"\A{OPENERS}+|{CLOSERS}+\z", "")


def _word(token: Column) -> Column:
    """The word of a token: small, without what stands around it."""
    return F.lower(F.regexp_replace(token, r"\A[^\p{L}\p{N}]+|[^\p{L}\p{N}]+\z", ""))


def _tokens(v: Column) -> Column:
    spaced = F.regexp_replace(v, rf"([{WIDE_MARKS}]+{CLOSERS}*)", "$1 ")
    return F.array_remove(F.split(spaced, SPACE + "+"), "")


def _abbreviated(bare: Column, model: Model) -> Column:
    """Whether a word with its point is an abbreviation, as a whole or behind its last hyphen."""
    word = F.regexp_replace(F.lower(bare), r"\.\z", "")
    return among(word, model.abbreviations) | among(F.regexp_extract(word, r"-([^-]*)\z", 1), model.abbreviations)


def _once(value: Column, f) -> Column:
    """``f`` of a value that is computed once a row."""
    return F.get(F.transform(F.array(value), f), 0)


def _ends(token: Column, following: Column, model: Model) -> Column:
    """Whether a sentence ends between two tokens."""

    def by_point(bare: Column, after: Column) -> Column:
        begins = after.rlike(r"\A\p{Lu}") & among(_word(following), model.small)
        return (
            F.when(bare.rlike(r"\A\p{L}\.\z"), begins | ~after.rlike(r"\A[\p{Lu}\p{Ll}]"))  # an initial
            .when(bare.endswith("..") | _abbreviated(bare, model), begins)
            .when(bare.rlike(r"\A[+-]?[0-9][0-9.,]*\.\z"), ~after.rlike(r"\A\p{Ll}"))
            .otherwise(True)
        )

    def ends(bare: Column) -> Column:
        marked = bare.rlike(rf"[{MARKS}{WIDE_MARKS}]\z")
        return F.when(marked, True).when(~bare.endswith("."), False).otherwise(_once(_stripped(following), lambda after: by_point(bare, after)))

    return _once(_stripped(token), ends)


def count_sentences(v: Column, model: Model = DEFAULT) -> Column:
    """The number of sentences; 0 for blank text. ``。！？`` end sentences too."""
    marked = rf"[.{MARKS}{WIDE_MARKS}]{CLOSERS}*\z"

    def count(tokens: Column) -> Column:
        n = F.size(tokens)
        places = F.filter(F.sequence(F.lit(0), n - 2), lambda i: F.get(tokens, i).rlike(marked))
        inner = F.size(F.filter(places, lambda i: _ends(F.get(tokens, i), F.get(tokens, i + 1), model)))
        return F.when(n == 0, 0).when(n == 1, 1).otherwise(inner + 1)

    return _once(_tokens(v), count).cast("long")


# --- fitting


def _counted(tokens: DataFrame) -> DataFrame:
    """Different rows and their number n, so that patterns are tried once for equal tokens."""
    return tokens.groupBy(*tokens.columns).agg(F.count(F.lit(1)).alias("n"))


def _sum_if(condition: str) -> Column:
    return F.sum(F.expr(f"case when {condition} then n else 0 end"))


def _late(count: str, condition: Column) -> Column:
    """A condition that names a count too, or Spark would try it on every token before they are counted."""
    return F.when(F.col(count) > 0, condition)


def abbreviation_scores(texts: DataFrame, text: str = "text") -> DataFrame:
    """word, with_point, without, score: words of letters that stand before a point somewhere.

    A word's tokens without what stands around them are counted with and without
    a point behind. score is its log-likelihood ratio times exp(-letters) times
    (points within + 1) times letters to the power of -without.
    """
    tokens = _counted(texts.select(F.explode(_tokens(F.coalesce(F.col(text), F.lit("")))).alias("token")))
    token = F.col("token")
    words = tokens.select(_stripped(token).alias("token"), "n").select(F.lower(F.regexp_replace(token, r"[.,;:!?]+\z", "")).alias("word"), (token.endswith(".") & ~token.endswith("..")).alias("pointed"), "n")
    counts = words.where(_late("n", F.col("word") != "")).groupBy("word").agg(_sum_if("pointed").alias("with_point"), _sum_if("not pointed").alias("without"))
    all_ = counts.agg(F.sum("with_point").alias("points"), F.sum(F.col("with_point") + F.col("without")).alias("tokens"))  # a row
    letters, inner = F.length(F.replace("word", F.lit("."), F.lit(""))), F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    share = F.col("points") / F.col("tokens")
    likelihood = lambda p: F.col("with_point") * F.log(p) + F.when(F.col("without") > 0, F.col("without") * F.log(1 - p)).otherwise(0.0)
    ratio = -2 * (likelihood(share) - likelihood(F.lit(OFTEN)))
    score = ratio * F.exp(-letters) * (inner + 1) * F.pow(letters.cast("double"), -F.col("without").cast("double"))
    scored = counts.where(_late("with_point", F.col("word").rlike(r"\A\p{L}[\p{L}.]*\z"))).join(F.broadcast(all_))
    return scored.select("word", "with_point", "without", score.alias("score"))


def small_words(texts: DataFrame, text: str = "text") -> DataFrame:
    """word, small, capital: how often words of letters are written small, and with a capital inside a sentence."""
    tokens = texts.select(_tokens(F.coalesce(F.col(text), F.lit(""))).alias("token"))
    pairs = tokens.select(F.inline(F.arrays_zip("token", F.concat(F.array(F.lit(None).cast("string")), "token").alias("before")))).where("token is not null")
    starts = F.coalesce(F.col("before").rlike(rf"[.{MARKS}{WIDE_MARKS}:]{CLOSERS}*\z"), F.lit(True))
    rows = _counted(pairs.select("token", starts.alias("starts"))).select(_stripped(F.col("token")).alias("token"), (~F.col("starts") & ~F.col("token").rlike(rf"\A{OPENERS}")).alias("inside"), "n")
    rows = rows.select(_word(F.col("token")).alias("word"), F.col("token").rlike(r"\A\p{Ll}").alias("small"), (F.col("inside") & F.col("token").rlike(r"\A\p{Lu}")).alias("capital"), "n")
    return rows.where(_late("n", F.col("word").rlike(r"\A\p{L}+\z"))).groupBy("word").agg(_sum_if("small").alias("small"), _sum_if("capital").alias("capital"))


def fit(texts: DataFrame, text: str = "text", most: int = 20_000) -> Model:
    """A model of a corpus: the ``most`` abbreviations of the best score, and the ``most`` frequent small words, at the most."""
    short = abbreviation_scores(texts, text).where(F.col("score") >= LEAST_SCORE).orderBy(F.desc("score"), "word").limit(most).collect()
    small = small_words(texts, text).where("small > 0 and capital = 0").orderBy(F.desc("small"), "word").limit(most).collect()
    return Model(tuple(r.word for r in short), tuple(r.word for r in small))
