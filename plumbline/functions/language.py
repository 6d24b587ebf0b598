"""The language of a text, as a column expression over a fitted model.

Scripts come first: the script of most letters tells the language where one
language alone writes it. For scripts that several share, function words vote;
where they are few or divided, as in short texts, a naive Bayes model of letter
triples, words and accented letters decides, by whole-number weights that add
up over a text's different features. A text is of no known language if the best weight isn't ahead by a margin.

``fit`` makes a model from labelled texts by grouped aggregates; the default
one has the same rule over the sentences in ``seeds``.
"""

from __future__ import annotations

import functools
import math
import unicodedata
import zlib
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .seeds import SEEDS

#: Function words, by language.
STOP_WORDS = {
    "en": "the of and in is to by that with as are on",
    "fr": "le la les un une et en que des de est dans pour au du",
    "de": "de der die das und ist nicht ein von zu in sich mit für",
    "es": "el la los de que y en un una es por con se del",
    "pt": "o os as de que e em um uma é não para com do da",
    "it": "il lo gli di che e è un una per con non del della",
    "pl": "w na nie się że z do jest i to jak",
    "fi": "ja on ei että se oli hän mutta kun myös",
    "sw": "na ya wa kwa ni katika za la kuwa",
    "vi": "và của là có các được trong không cho một",
    "ru": "и в не на что с как это по но",
    "uk": "і в не на що з як це та у",
    "bg": "и в не на че с как това за се",
    "ne": "छ र को मा हो पनि यो",
    "mr": "आहे व आणि या ते हे",
    "hi": "है के में की और से का",
    "fa": "است و در به از که این",
    "ur": "ہے اور کے میں کی سے کا",
    "ar": "في من على أن إلى هذا التي",
}
#: Scripts that several languages share, and those that tell one.
SHARED = {"Latin": ("de", "en", "es", "fi", "fr", "it", "pl", "pt", "sw", "vi"), "Cyrillic": ("bg", "ru", "uk"), "Arabic": ("ar", "fa", "ur"), "Devanagari": ("hi", "mr", "ne")}
OWN = {
    "bn": ("Bengali",), "el": ("Greek",), "gu": ("Gujarati",), "he": ("Hebrew",), "ja": ("Hiragana", "Katakana"), "kn": ("Kannada",), "ko": ("Hangul",), "ml": ("Malayalam",),
    "pa": ("Gurmukhi",), "ta": ("Tamil",), "te": ("Telugu",), "th": ("Thai",), "zh": ("Han",),
}
#: Codes that a check may name; Greek is told apart but isn't one.
LANGUAGES = tuple(sorted({*STOP_WORDS, *OWN} - {"el"}))
#: Votes of function words that decide alone: so many, and so many standard errors of their sum ahead of the next language's.
VOTES, ERRORS = 5, 2
#: Weights are twelfths of a nat, MOST at the most; the best sum must be ahead by this.
UNIT, MOST, MARGIN = 12, 47, 4
SMOOTHING = 0.5
#: Look-up tables: features are dealt to buckets by their checksum and told apart by the rest of it, in so many hexadecimal digits.
BUCKETS, MARKS, FIRST = 256, 6, 17
#: Japanese where kana are at least one in so many of Han and kana.
KANA_SHARE = 12


def once(value: str, name: str, then: str) -> str:
    """SQL of ``then``, in which ``name`` is a value that is computed once a row."""
    return f"transform(array({value}), {name} -> {then})[0]"


def applied(v: Column, name: str, sql: str) -> Column:
    """SQL about ``name`` of a column. One text is parsed, where an expression of as many columns takes seconds to put together."""
    return F.get(F.call_function("transform", F.array(v), F.expr(f"{name} -> {sql}")), 0)


#: SQL of a text's letter triples (blanks at the ends of words), words of two letters or more between blanks, and letters beyond ASCII.
FEATURES = once(
    r"regexp_replace(concat(' ', lower(t), ' '), r'[^\p{L}\p{M}]+', ' ')", "f",
    r"""concat(filter(regexp_extract_all(f, r'(?s)(?=(.{3}))', 1), g -> substring(g, 2, 1) <> ' '), transform(filter(split(f, ' '), w -> length(w) > 1), w -> concat(' ', w, ' ')), regexp_extract_all(f, r'[^\x00-\x7f]', 0))""",
)


def features(v: Column) -> Column:
    return applied(v, "t", FEATURES)


def features_of(text: str) -> list[str]:
    """The same of one string."""
    words = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower()).split()
    plain = f" {' '.join(words)} "
    triples = [plain[i : i + 3] for i in range(len(plain) - 2) if plain[i + 1] != " "]
    return triples + [f" {w} " for w in words if len(w) > 1] + [c for c in plain if ord(c) > 127]


def weight(count: float, total: int, kinds: int) -> float:
    return math.log((count + SMOOTHING) / (total + SMOOTHING * kinds))


@dataclass(frozen=True)
class Model:
    """For each script, its languages and the weights of each feature, one a language."""

    groups: dict[str, tuple[tuple[str, ...], dict[str, tuple[int, ...]]]]

    def __hash__(self):
        return id(self)

    @functools.cached_property
    def tables(self) -> dict[str, bytes]:
        """Each script's weights as one string: buckets of equal length, in them for each feature ``~``, its mark, and a letter for each weight."""
        out = {}
        for script, (_, weights) in self.groups.items():
            buckets = [""] * BUCKETS
            for gram in sorted(weights):
                check = zlib.crc32(gram.encode())
                buckets[check % BUCKETS] += f"~{check // BUCKETS:0{MARKS}X}" + "".join(chr(MOST + FIRST + w) for w in weights[gram])
            width = max(map(len, buckets))
            out[script] = "".join(b.ljust(width, "~") for b in buckets).encode()
        return out


def fitted(counts: dict[str, dict[str, Counter]]) -> Model:
    """A model from counts of features by script and language."""
    groups = {}
    for script, own in counts.items():
        langs = tuple(sorted(own))
        kinds, totals = len(set().union(*own.values())), {lang: sum(own[lang].values()) for lang in langs}
        weights = {}
        for gram in set().union(*own.values()):
            logs = [weight(own[lang][gram], totals[lang], kinds) for lang in langs]
            mean = sum(logs) / len(logs)
            weights[gram] = tuple(max(-MOST, min(MOST, round(UNIT * (x - mean)))) for x in logs)
        groups[script] = (langs, weights)
    return Model(groups)


@functools.cache
def default_model() -> Model:
    return fitted({script: {lang: Counter(features_of(SEEDS[lang])) for lang in langs} for script, langs in SHARED.items()})


def counted(labelled: DataFrame, text: str = "text", lang: str = "lang", least: int = 2) -> DataFrame:
    """script, lang, gram, n: how often features occur in each language, for those that occur ``least`` times in a script. Rows of other or no labels don't count."""
    script = F.coalesce(*[F.when(F.col("lang").isin(*langs), F.lit(name)) for name, langs in SHARED.items()])
    grams = labelled.select(F.col(lang).alias("lang"), F.explode(features(F.col(text))).alias("gram")).withColumn("script", script).where("script is not null")
    counts = grams.groupBy("script", "lang", "gram").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("script", "gram")  # a row a language
    return counts.withColumn("all", F.sum("n").over(own)).where(F.col("all") >= least).drop("all")


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", least: int = 2, most: int = 50_000) -> Model:
    """A model of the languages in ``labelled`` whose scripts are shared.

    Features are counted by language in grouped aggregates; those that occur
    ``least`` times are kept, of a script the ``most`` frequent, which bounds
    what the driver gets.
    """
    counts = counted(labelled, text, lang, least)
    kinds = counts.groupBy("script", "gram").agg(F.sum("n").alias("n"))
    kinds = kinds.withColumn("place", F.row_number().over(Window.partitionBy("script").orderBy(F.desc("n"), "gram"))).where(F.col("place") <= most)
    out: dict[str, dict[str, Counter]] = {}
    for r in counts.join(kinds.select("script", "gram"), ["script", "gram"]).toLocalIterator():  # most * languages rows at the most
        out.setdefault(r["script"], {}).setdefault(r["lang"], Counter())[r["gram"]] = r["n"]
    return fitted(out)


def _words(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _leading(counts: dict[str, str], condition: str) -> str:
    """SQL of the language with the greatest of ``counts``, if ``condition`` holds of it, ``a``, and the next, ``b``."""
    options = ", ".join(f"named_struct('n', {n}, 'lang', '{lang}')" for lang, n in counts.items())
    return once(f"sort_array(array({options}), false)", "s", f"case when {once('s[0].n', 'a', once(f'coalesce(get(s, 1).n, -{1 << 30})', 'b', condition))} then s[0].lang end")


def _voted(langs: tuple[str, ...]) -> str:
    """SQL of the language whose function words lead clearly, else null."""
    own = {lang: STOP_WORDS[lang].split() for lang in langs if lang in STOP_WORDS}
    if not own:
        return "cast(null as string)"
    every = _words(sorted({w for words in own.values() for w in words}))
    counts = {lang: f"size(filter(k, x -> x in ({_words(w)})))" for lang, w in own.items()}
    return once(rf"filter(split(lower(t), r'[^\p{{L}}\p{{M}}\p{{N}}_]+'), x -> x in ({every}))", "k", _leading(counts, f"a >= {VOTES} and (a - greatest(b, 0)) * (a - greatest(b, 0)) >= {ERRORS * ERRORS} * (a + greatest(b, 0))"))


def _weighed(langs: tuple[str, ...], table: bytes) -> str:
    """SQL of the language of the greatest sum of weights, null without a margin."""
    width = len(table) // BUCKETS
    bucket = f"cast(substring(X'{table.hex()}', cast(c % {BUCKETS} * {width} + 1 as int), {width}) as string)"
    look = once(f"position(concat('~', lpad(hex(c div {BUCKETS}), {MARKS}, '0')), d)", "p", f"case when p > 0 then substring(d, p + {MARKS + 1}, {len(langs)}) else '' end")
    found = f"filter(transform(array_distinct({FEATURES}), g -> {once('crc32(cast(g as binary))', 'c', once(bucket, 'd', look))}), w -> w <> '')"
    sums = {lang: f"aggregate(l, 0, (n, w) -> n + ascii(substring(w, {k + 1}, 1)) - {MOST + FIRST})" for k, lang in enumerate(langs)}
    return once(found, "l", f"case when size(l) > 0 then {_leading(sums, f'a - b >= {MARGIN}')} end")


@functools.cache
def _detection(model: Model) -> str:
    """SQL of the language of ``t``."""

    def shared(script: str) -> str:
        langs, _ = model.groups[script]
        return f"coalesce({_voted(langs)}, {_weighed(langs, model.tables[script])})"

    def letters(*scripts: str) -> str:
        return f"regexp_count(t, r'[{''.join(rf'\p{{Is{s}}}' for s in scripts)}]')"

    names = {s: (s,) for s in SHARED} | {lang: own for lang, own in OWN.items() if lang not in ("ja", "zh")} | {"zh": ("Han", "Hiragana", "Katakana")}
    counts = ", ".join(f"named_struct('n', {letters(*own)}, 'script', '{name}')" for name, own in names.items())
    latin = shared("Latin") if "Latin" in model.groups else "cast(null as string)"
    named = " ".join(f"when m.script = '{s}' then {shared(s) if s in model.groups else 'cast(null as string)'}" for s in SHARED if s != "Latin")
    mixed = once(f"array_max(array({counts}))", "m", f"case when m.n = 0 then null {named} when m.script = 'zh' and {letters(*OWN['ja'])} * {KANA_SHARE} >= m.n then 'ja' when m.script <> 'Latin' then m.script end")
    # Where other scripts are is cheap to tell; what is left to Latin is said once.
    other = r"t rlike r'[\x{370}-\x{1dff}\x{1f00}-\x{1fff}\x{2e80}-\x{10ffff}]'"
    most_latin = once(f"array_max(array({counts}))", "m", "m.n > 0 and m.script = 'Latin'")
    is_latin = rf"case when {other} then {most_latin} else t rlike r'\p{{L}}' end"
    return f"case when {is_latin} then {latin} when {other} then {mixed} end"


def detect_language(v: Column, model: Model | None = None) -> Column:
    """The code of a text's language; null where it has no letters of a known script, or no language is ahead of the others."""
    return applied(v, "t", _detection(model or default_model()))
