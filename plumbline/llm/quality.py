"""Quality rules: a table of thresholds, compiled into one Spark projection.

Nothing here is a user function: words, windows and lines are arrays of
built-in expressions, each computed once a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that it for on was be with as by are this at or an from not have "
    "de la le les et des en un une du que est pour qui dans au sur par pas plus avec "
    "der die das und ist nicht ein eine von zu sich mit für auf den dem im des als auch "
    "el los las y del se por con una su para es al lo como más"
).split()

#: (rule, measure, lowest allowed, highest allowed). A document is kept if all hold and the base doesn't fail.
RULES: list[tuple[str, str, float | None, float | None]] = [
    ("mean_word", "word_chars / n_words", 2.0, 20.0),
    ("symbols", "n_symbols / n_words", None, 0.5),
    ("marks", "n_marks / n_words", None, 0.7),
    ("stop_words", "n_stop_words / n_words", 0.02, None),
    ("dup_lines", "n_dup_lines / n_lines", None, 0.5),
]

#: Places take the low bits of a window's code, its hash the others. Texts of more words than the first can number have the second.
_PLACE_BITS = (24, 32)


def _measures(text: Column) -> list[tuple[str, Column]]:
    """Columns in the order that they build on each other."""
    c = F.col
    # Windows of three words: a code holds the first bits of the window's hash
    # and its place; in sorted codes equal hashes are neighbours, and the words
    # themselves decide whether windows are equal. Where neighbours of equal
    # hash are unlike windows, all of that hash are compared.
    place = "cast({} & ((shiftleft(1L, __bits)) - 1) as int)"
    same = lambda y: f"shiftright(x, __bits) = shiftright({y}, __bits)"
    equal = lambda y: " and ".join(f"get(__words, {place.format('x')} + {k}) = get(__words, {place.format(y)} + {k})" for k in range(3))
    before, after = "get(__codes, i - 1)", "get(__codes, i + 1)"
    twice = (
        f"if({same(before)} or {same(after)}, case when {same(before)} and {equal(before)} then true when {same(after)} and {equal(after)} then true"
        f" else exists(__codes, y -> y <> x and {same('y')} and {equal('y')}) end, false)"
    )
    return [
        ("__text", F.coalesce(text.cast("string"), F.lit(""))),
        ("__words", F.expr(r"filter(split(__text, '[ \\x09-\\x0D]+'), w -> w <> '')")),
        ("__lines", F.expr(r"filter(split(__text, '\n'), l -> l rlike '[^ \\x09-\\x0D]')")),
        ("n_words", F.size("__words").cast("long")),
        ("word_chars", F.expr(r"length(translate(__text, ' \t\n' || chr(11) || chr(12) || '\r', ''))").cast("long")),
        ("n_symbols", F.expr("length(__text) - length(translate(__text, '#*$%&|<>', ''))").cast("long")),
        ("n_marks", F.expr("length(__text) - length(translate(__text, '!?', ''))").cast("long")),
        ("n_lines", F.size("__lines").cast("long")),
        ("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")),
        ("n_stop_words", F.expr(f"size(filter(__words, w -> lower(w) in ({', '.join(repr(w) for w in dict.fromkeys(STOP_WORDS))})))").cast("long")),
        ("__bits", F.expr(f"if(n_words < {1 << _PLACE_BITS[0]}, {_PLACE_BITS[0]}, {_PLACE_BITS[1]})")),
        ("__codes", F.expr("if(n_words < 3, cast(array() as array<bigint>), sort_array(transform(slice(__words, 1, greatest(size(__words) - 2, 1)), (w, i) -> (shiftleft(shiftright(xxhash64(w, get(__words, i + 1), get(__words, i + 2)), __bits), __bits) | cast(i as bigint)))))")),
        ("__twice", F.expr(f"transform(filter(__codes, (x, i) -> {twice}), x -> {place.format('x')})")),
        ("n_repeat_words", F.expr("cast(size(array_distinct(flatten(transform(__twice, x -> array(x, x + 1, x + 2))))) as long)")),
    ]


def compiled() -> dict[str, Column]:
    """Rule name -> whether it holds; a ratio without a denominator holds."""
    out = {}
    for name, measure, low, high in RULES:
        top, bottom = measure.split(" / ")
        ratio, fits = F.try_divide(F.col(top), F.col(bottom)), F.lit(True)
        if low is not None:
            fits &= ratio >= low
        if high is not None:
            fits &= ratio <= high
        out[name] = F.coalesce(fits, F.lit(True))
    return out


def assess(docs: DataFrame, carry: list[str] = ["doc_id"]) -> DataFrame:
    """``carry`` columns, the measures, a column for each rule, base_failed and kept.

    Null text counts as empty: no words, base_failed, not kept. n_dup_lines
    counts lines with a word equal to an earlier one; n_repeat_words the words
    in 3-word windows that the text has twice or more. base_failed: fewer than
    50 words, or over half of them such. Repeated rows are judged each, nulls
    in other columns don't matter, an empty table gives no rows. Texts may be as
    long as a row can hold.
    """
    text = docs["text"]
    df = docs.select(*[docs[c] for c in carry], text.alias("__raw"))
    for name, column in _measures(F.col("__raw")):
        df = df.withColumn(name, column)
    rules = compiled()
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    for name, column in rules.items():
        df = df.withColumn(f"fits_{name}", column)
    kept = ~F.col("base_failed")
    for name in rules:
        kept &= F.col(f"fits_{name}")
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_lines", "n_stop_words"]
    # A field that isn't deterministic keeps later filters above the projection; pushed down, they would compute the measures over and over.
    whole = F.struct(*measures, "base_failed", "kept", *[f"fits_{n}" for n in rules])
    return df.withColumn("kept", kept).select(*carry, F.when(F.monotonically_increasing_id() >= 0, whole).alias("__m")).select(*carry, "__m.*")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``assess`` keeps, with their own columns."""
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = f"c{names.index('text')}"
    judged = assess(inner.withColumnRenamed(text, "text"), [c if c != text else "text" for c in inner.columns])
    return judged.where("kept").select(*[F.col(c if c != text else "text").alias(n) for c, n in zip(inner.columns, names)])
