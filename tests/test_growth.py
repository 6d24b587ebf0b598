"""Work that grows with what is different in a corpus, not with each of its tokens."""

import re

from pyspark.sql import functions as F

from plumbline.functions import sentences as N
from plumbline.functions import text as X
from plumbline.functions import tokens as K
from plumbline.plans.queries import queries


def steps(df) -> list[str]:
    """The operators of the plan that ran, from the last to the first."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [re.sub(r"^[ :+\-*(\d)]+", "", x) for x in plan.splitlines() if not re.match(r"[ :+\-]*==|AdaptiveSparkPlan", x)]


def below_counting(found: list[str]) -> list[str]:
    """What runs on every token: the steps under the first counting, which is the last in the plan."""
    return found[max(i for i, x in enumerate(found) if x.startswith("HashAggregate")) + 1 :]


def test_abbreviations_read_a_corpus_once(spark, data):
    found = steps(queries()["sentence_abbreviations"](spark, data))
    assert sum(x.startswith("FileScan") for x in found) == 1
    assert not any("RLIKE" in x or "lower(" in x for x in below_counting(found))
    texts = spark.createDataFrame([("Dr. A saw dr. B (Dr.) ... etc. 'etc.' x",), (None,), ("",)], "text string")
    got = {r.word: (r.with_point, r.without) for r in N.abbreviation_scores(texts).collect()}
    assert got == {"dr": (3, 0), "etc": (2, 0)}


def test_small_words_are_told_after_counting(spark, data):
    found = steps(queries()["sentence_small_words"](spark, data))
    assert sum(x.startswith("FileScan") for x in found) == 1
    assert not any(r"\p{Ll}" in x or "lower(" in x or r"\p{L}+" in x for x in below_counting(found))
    texts = spark.createDataFrame([(" The end. The Word word: The (The \"the\" The ",), (None,), (" \n",), ("One",)], "text string")
    got = {r.word: (r.small, r.capital) for r in N.small_words(texts).collect()}
    assert got == {"the": (1, 1), "end": (1, 0), "word": (1, 1), "one": (0, 0)}


def test_capital_words_leave_small_ones_out(spark):
    odd = ["", " \n", "a b c", "DON'T a 'TIS\n'TIS x'S X's CANNOT cannot", "A.B. C.) d　É! É,1 \U0001d400. ǅ GONna", "WE'LL\tN'T ''Q'' (A)--B...C 'S ", None]
    rows = spark.createDataFrame(list(enumerate(odd)), "i int, t string")
    whole = F.size(F.filter(K.treebank_tokens(F.col("t")), X.is_upper)).cast("long")
    assert [r.n for r in rows.select("i", X.count_capital_words(F.col("t")).alias("n")).orderBy("i").collect()] == [r.n for r in rows.select("i", whole.alias("n")).orderBy("i").collect()]
    plan = rows.select(X.count_capital_words(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan  # the rules see words with capital letters alone


def test_abbreviations_are_looked_up(spark):
    words = tuple(f"w{i}" for i in range(2_000)) + ("it's", "a\\b")
    rows = spark.createDataFrame([("w1999",), ("w",), ("it's",), ("a\\b",), (None,)], "t string").select(N.among(F.col("t"), words).alias("ok"))
    assert [r.ok for r in rows.collect()] == [True, False, True, True, None]
    assert "INSET" in rows._jdf.queryExecution().optimizedPlan().toString()  # a set, not a search through an array
