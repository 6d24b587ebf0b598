"""Queries over the driver's tables, one for each operator, and the same in DuckDB's SQL.

``documents.text`` stands in for responses, and turns of ``conversations`` for
prompts and their responses. Where the tables lack what a check looks for, the
query edits the text first, and the SQL does the same.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import language as L
from ..functions import sentences as N
from ..functions import text as X
from ..functions import tokens as K
from ..operators import checkers as C
from ..operators import evaluate as E
from ..operators import metrics as M
from ..operators import synth as S
from ..sources import jsonl as J
from ..streaming import watch as W_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add



def T() -> Column:
    return F.col("text")


def ID() -> Column:
    return F.col("doc_id")



def literal(x) -> Column:
    return F.array(*map(F.lit, x)) if isinstance(x, (list, tuple)) else F.lit(x)


CHECKS: list[tuple[str, dict, Callable[[], Column], str, str]] = []


def check(name: str, instruction_id: str, kwargs: dict, response: Callable[[], Column] | None = None, sql_text: str = "text", sql: str = "", function=None) -> None:
    """doc_id, ok of one check with fixed arguments. ``sql`` is a condition on ``t``, and on the language ``detected``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "documents").select("doc_id", (response() if response else T()).alias("t"))
        done = (function or C.REGISTRY[instruction_id])(F.col("t"), **{k: v if k == "forbidden_words" else literal(v) for k, v in kwargs.items()})
        return docs.select("doc_id", done.alias("ok"))

    if instruction_id and instruction_id not in {c[0] for c in CHECKS}:
        CHECKS.append((instruction_id, kwargs, response or T, sql_text, sql))
    given = f"with {language_sql(sql_text)} select doc_id, coalesce({sql}, false) as ok from told" if "detected" in sql else f"select doc_id, coalesce({sql}, false) as ok from (select doc_id, {sql_text} as t from documents)"
    query(f"check_{name}", given if sql else None)(run)


W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"


def has_word(word: str, t: str = "t") -> str:
    return f"regexp_matches({t}, '(?i)(^|{NW}){word}({NW}|$)')"


def count_word(word: str, t: str = "t") -> str:
    return f"len(regexp_extract_all(' ' || regexp_replace({t}, '{NW}+', '  ', 'g') || ' ', '(?i) {word} '))"


TRIM = r"regexp_replace(t, '^\s+|\s+$', '', 'g')"
def sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def sentence_tokens(t: str) -> str:
    closers = N.CLOSERS.replace("'", "''")
    return rf"list_filter(string_split_regex(regexp_replace({t}, '([{N.WIDE_MARKS}]+{closers}*)', '\1 ', 'g'), '\s+'), lambda x: x <> '')"


def stripped_token(x: str) -> str:
    closers, openers = N.CLOSERS.replace("'", "''"), N.OPENERS.replace("'", "''")
    return f"regexp_replace({x}, '^{openers}+|{closers}+$', '', 'g')"


def token_word(x: str) -> str:
    return rf"lower(regexp_replace({x}, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g'))"


def sentence_end(x: str, y: str) -> str:
    """Whether a sentence ends between the tokens ``x`` and ``y``."""
    bare, after = stripped_token(x), stripped_token(y)
    word = rf"regexp_replace(lower({bare}), '\.$', '')"
    short = quoted(N.DEFAULT.abbreviations)
    begins = rf"(regexp_matches({after}, '^\p{{Lu}}') and {token_word(y)} in ({quoted(N.DEFAULT.small)}))"
    return rf"""(regexp_matches({x}, '[.{N.MARKS}{N.WIDE_MARKS}]{N.CLOSERS.replace("'", "''")}*$') and case when regexp_matches({bare}, '[{N.MARKS}{N.WIDE_MARKS}]$') then true when not ends_with({bare}, '.') then false
      when regexp_matches({bare}, '^\p{{L}}\.$') then {begins} or not regexp_matches({after}, '^[\p{{Lu}}\p{{Ll}}]') when ends_with({bare}, '..') or {word} in ({short}) or regexp_extract({word}, '-([^-]*)$', 1) in ({short}) then {begins}
      when regexp_matches({bare}, '^[+-]?[0-9][0-9.,]*\.$') then not regexp_matches({after}, '^\p{{Ll}}') else true end)"""


SENTENCES = f"(with k as (select {sentence_tokens('t')} as a) select case when len(a) = 0 then 0 else 1 + len(list_filter(range(1, len(a)), lambda i: {sentence_end('a[i]', 'a[i + 1]')})) end from k)"
UPPER = r"(regexp_matches({0}, '\p{{Lu}}') and not regexp_matches({0}, '[\p{{Ll}}\p{{Lt}}]'))"
LOWER = r"(regexp_matches({0}, '\p{{Ll}}') and not regexp_matches({0}, '[\p{{Lu}}\p{{Lt}}]'))"


def tokens_sql(t: str) -> str:
    """The treebank's tokens; RE2 has no looking ahead, so what stands behind is taken along and put back."""
    rules = [
        (r"""["`“”«»„‘’]|\'\'""", r" \0 "), (r"([:,])([^\p{Nd}])", r" \1 \2"), (r"([:,])([^\p{Nd}])", r" \1 \2"), (r"\.{2,}|[;@#$%&?!*\[\](){}<>]|--", r" \0 "), (r"""\.([\])}>"\'»”’ ]*)(\s|$)""", r" .\1\2"),
        (r"(?i)\'([^\Wmtsdn])(\W|$)", r"\' \1\2"), (f"([^\\' ])({'|'.join(K.ENDS)}) ".replace("'", "\\'").replace("\\\\'", "\\'"), r"\1 \2 "),
    ]
    for first, second in K.TOGETHER:
        a, b = first.replace("'", r"\'"), second.replace("'", r"\'")
        rules.append((rf"(?i) ({a})({b})\b", r" \1 \2") if first == "'t" else (rf"(?i)\b({a})({b})\b", r"\1 \2"))
    out = f"(' ' || {t} || ' ')"
    for pattern, into in rules:
        out = "regexp_replace({}, '{}', '{}', 'g')".format(out, pattern.replace(r"\'", "''"), into.replace(r"\'", "''"))
    return f"list_filter(string_split_regex({out}, '\\s+'), lambda x: x <> '')"


CAPITALS = f"len(list_filter({tokens_sql('t')}, lambda x: {UPPER.format('x')}))"


def language_sql(text: str, scripts: tuple[str, ...] = ("Latin",), source: str = "documents") -> str:
    """Common tables up to ``told``: doc_id, lang, t and the language ``detected`` of ``text``, by the weights of the default model for ``scripts``."""
    model = L.default_model()
    names = {**{s: (s,) for s in L.SHARED}, **{lang: own for lang, own in L.OWN.items() if lang not in ("ja", "zh")}, "zh": ("Han", "Hiragana", "Katakana")}
    count = lambda own: f"len(regexp_extract_all(t, '[{''.join(rf'\p{{{x}}}' for x in own)}]'))"
    tops = ", ".join(f"{{'n': {count(own)}, 'script': '{name}'}}" for name, own in names.items())
    known = list(scripts)
    votes = ", ".join(f"('{s}', '{lang}', '{w}')" for s in known for lang in L.SHARED[s] for w in dict.fromkeys(L.STOP_WORDS[lang].split()))
    rows = "|".join(f"{s}~{gram}~{','.join(map(str, w))}" for s in known for gram, w in sorted(model.groups[s][1].items()))
    langs = ", ".join(f"('{s}', {k + 1}, '{lang}')" for s in known for k, lang in enumerate(model.groups[s][0]))
    return rf"""d as (select doc_id, lang, {text} as t from {source}),
    s as (select *, case when not regexp_matches(t, '[\x{{370}}-\x{{1dff}}\x{{1f00}}-\x{{1fff}}\x{{2e80}}-\x{{10ffff}}]') then {{'n': 1, 'script': case when regexp_matches(t, '\p{{L}}') then 'Latin' end}} else list_sort([{tops}], 'DESC')[1] end as top,
      {count(L.OWN['ja'])} as kana from d),
    u as (select doc_id, lang, t, case when top.n = 0 then null when top.script = 'zh' and kana * {L.KANA_SHARE} >= top.n then 'ja' else top.script end as script from s),
    stop(script, code, word) as (values {votes}),
    codes(script, k, code) as (values {langs}),
    w as (select doc_id, script, unnest(string_split_regex(lower(t), '[^\p{{L}}\p{{M}}\p{{N}}_]+')) as word from u),
    v as (select doc_id, code, count(*) as n from w join stop using (script, word) group by all),
    o as (select doc_id, list_sort(list({{'n': n, 'code': code}}), 'DESC') as l from v group by 1),
    vote as (select doc_id, l[1].code as code from o where l[1].n >= {L.VOTES} and (l[1].n - coalesce(l[2].n, 0)) ** 2 >= {L.ERRORS * L.ERRORS} * (l[1].n + coalesce(l[2].n, 0))),
    m as (select split_part(x, '~', 1) as script, split_part(x, '~', 2) as gram, string_split(split_part(x, '~', 3), ',') as ws from (select unnest(string_split('{rows}', '|')) as x)),
    p as (select doc_id, script, regexp_replace(' ' || lower(t) || ' ', '[^\p{{L}}\p{{M}}]+', ' ', 'g') as t from u where doc_id not in (select doc_id from vote)),
    g as (select distinct doc_id, script, unnest(list_concat(list_filter(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3)), lambda x: substr(x, 2, 1) <> ' '),
      list_transform(list_filter(string_split(t, ' '), lambda x: length(x) > 1), lambda x: ' ' || x || ' '), regexp_extract_all(t, '[^\x00-\x7f]'))) as gram from p),
    z as (select doc_id, code, sum(ws[k]::bigint) as n from g join m using (script, gram) join codes using (script) group by all),
    y as (select doc_id, list_sort(list({{'n': n, 'code': code}}), 'DESC') as l from z group by 1),
    best as (select doc_id, l[1].code as code from y where l[1].n - l[2].n >= {L.MARGIN}),
    told as (select u.doc_id, u.lang, u.t, case when u.script in ({", ".join(repr(x) for x in L.SHARED)}) then coalesce(vote.code, best.code) else u.script end as detected from u left join vote using (doc_id) left join best using (doc_id))"""


check("existence", "keywords:existence", {"keywords": ["the", "of"]}, sql=f"{has_word('the')} and {has_word('of')}")
check("frequency", "keywords:frequency", {"keyword": " the ", "frequency": 5, "relation": "at least"}, sql=f"{count_word('the')} >= 5")
check("frequency_around", "keywords:frequency", {"keyword": "of", "frequency": 10, "relation": "around"}, sql=f"abs({count_word('of')} - 10) <= 5")
check("forbidden_words", "keywords:forbidden_words", {"forbidden_words": ["that", "this", "that"]}, sql=f"not {has_word('that')} and not {has_word('this')}")
check("forbidden_patterns", "keywords:forbidden_words", {"forbidden_words": ["th[ai]t", "this"]}, sql=f"not {has_word('th[ai]t')} and not {has_word('this')}")
check("letter_frequency", "keywords:letter_frequency", {"letter": "E", "let_frequency": 120, "let_relation": "less than"}, sql="length(lower(t)) - length(replace(lower(t), 'e', '')) < 120")
check("response_language", "language:response_language", {"language": "fr"}, sql="detected = 'fr'")
check("number_sentences", "length_constraints:number_sentences", {"num_sentences": 20, "relation": "at least"}, sql=rf"{SENTENCES} >= 20")
check(
    "number_paragraphs", "length_constraints:number_paragraphs", {"num_paragraphs": 5}, lambda: F.replace(T(), F.lit("\n"), F.lit("\n***\n")), "replace(text, chr(10), chr(10) || '***' || chr(10))",
    r"""(with p as (select string_split_regex(t, '\s*\*\*\*\s*') as a), q as (select list_transform(a, lambda x: not regexp_matches(x, '\S')) as b, len(a) as n from p)
        select case when n > 2 and list_contains(b[2:n - 1], true) then false when n = 1 then n - b[1]::int = 5 else n - b[1]::int - b[n]::int = 5 end from q)""",
)
check("number_words", "length_constraints:number_words", {"num_words": 300, "relation": "at least"}, sql=f"len(regexp_extract_all(t, '{W}+')) >= 300")
check("number_words_around", "length_constraints:number_words", {"num_words": 100, "relation": "around"}, sql=f"abs(len(regexp_extract_all(t, '{W}+')) - 100) <= 25")
check(
    "nth_paragraph_first_word", "length_constraints:nth_paragraph_first_word", {"num_paragraphs": 3, "nth_paragraph": 2, "first_word": "the"},
    lambda: F.concat(T(), F.when(ID() % 2 == 0, "\n\n'The, end\n\n").otherwise("\n\nend\n\n"), F.substring(T(), 1, 20)), "text || chr(10) || chr(10) || case when doc_id % 2 = 0 then '''The, end' else 'end' end || chr(10) || chr(10) || substr(text, 1, 20)",
    r"""(with p as (select string_split(t, chr(10) || chr(10)) as a) select len(list_filter(a, lambda x: regexp_matches(x, '\S'))) = 3 and regexp_matches(a[2], '\S')
        and lower(regexp_extract(regexp_replace(regexp_replace(regexp_extract(a[2], '\S+'), '^''+', ''), '^"+', ''), '^[^.,?!''"]*')) = 'the' from p)""",
)
check("number_placeholders", "detectable_content:number_placeholders", {"num_placeholders": 10}, lambda: F.replace(T(), F.lit(" the "), F.lit(" [the] ")), "replace(text, ' the ', ' [the] ')", r"len(regexp_extract_all(t, '\[.*?\]')) >= 10")
check("postscript", "detectable_content:postscript", {"postscript_marker": "P.S."}, lambda: F.concat(T(), F.when(ID() % 3 == 0, "\nP. S. more").otherwise(" ps")), "text || case when doc_id % 3 = 0 then chr(10) || 'P. S. more' else ' ps' end", r"regexp_matches(lower(t), 'p\.\s?s\.')")
check("postscript_other", "detectable_content:postscript", {"postscript_marker": "PS:"}, lambda: F.concat(T(), F.when(ID() % 5 == 0, "\nps: more").otherwise(" ps")), "text || case when doc_id % 5 = 0 then chr(10) || 'ps: more' else ' ps' end", "contains(lower(t), 'ps:')")
check("number_bullet_lists", "detectable_format:number_bullet_lists", {"num_bullets": 5}, lambda: F.replace(T(), F.lit("\n"), F.lit("\n* ")), "replace(text, chr(10), chr(10) || '* ')", r"len(regexp_extract_all(t, '(?m)^\s*\*[^\*].*$')) + len(regexp_extract_all(t, '(?m)^\s*-.*$')) = 5")
check("constrained_response", "detectable_format:constrained_response", {}, lambda: F.concat(T(), F.when(ID() % 4 == 0, " My answer is no.").otherwise(" my answer is no.")), "text || case when doc_id % 4 = 0 then ' My answer is no.' else ' my answer is no.' end", "contains(t, 'My answer is yes.') or contains(t, 'My answer is no.') or contains(t, 'My answer is maybe.')")
check(
    "number_highlighted_sections", "detectable_format:number_highlighted_sections", {"num_highlights": 8}, lambda: F.replace(T(), F.lit(" of "), F.lit(" **of** ")), "replace(text, ' of ', ' **of** ')",
    r"len(list_filter(regexp_extract_all(t, '\*([^\n\*]*)\*', 1), lambda x: regexp_matches(x, '\S'))) + len(list_filter(regexp_extract_all(t, '\*\*([^\n\*]*)\*\*', 1), lambda x: regexp_matches(x, '\S'))) >= 8",
)
check("multiple_sections", "detectable_format:multiple_sections", {"section_spliter": "Section", "num_sections": 4}, lambda: F.replace(T(), F.lit("\n"), F.lit("\nSection 1 ")), "replace(text, chr(10), chr(10) || 'Section 1 ')", r"len(regexp_extract_all(t, '\s?Section\s?\S+\s?')) >= 4")
check("title", "detectable_format:title", {}, lambda: F.concat(F.when(ID() % 2 == 0, "<<A title>>\n").otherwise("<< >>\n"), T()), "case when doc_id % 2 = 0 then '<<A title>>' else '<< >>' end || chr(10) || text", r"len(list_filter(regexp_extract_all(t, '<<([^<\n][^>\n]*)>>', 1), lambda x: regexp_matches(x, '\S'))) > 0")
check(
    "two_responses", "combination:two_responses", {}, lambda: F.concat(T(), F.lit(" ****** "), F.when(ID() % 3 == 0, T()).when(ID() % 3 == 1, F.lit("")).otherwise(F.col("lang"))), "text || ' ****** ' || case when doc_id % 3 = 0 then text when doc_id % 3 = 1 then '' else lang end",
    r"(with p as (select list_transform(string_split(t, '******'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) as a), q as (select a, list_filter(a, lambda x: x <> '') as k from p) select len(k) = 2 and k[1] <> k[2] and not (len(a) > 2 and list_contains(a[2:len(a) - 1], '')) from q)",
)
check("repeat_prompt", "combination:repeat_prompt", {"prompt_to_repeat": "Write: a list!"}, lambda: F.concat(F.when(ID() % 2 == 0, " write a LIST. ").otherwise("write the list "), T()), "case when doc_id % 2 = 0 then ' write a LIST. ' else 'write the list ' end || text", rf"starts_with(regexp_replace(lower({TRIM}), '[[:punct:]]', '', 'g'), 'write a list')")
check("end_checker", "startend:end_checker", {"end_phrase": " ON. "}, lambda: F.concat(T(), F.lit('" ')), "text || '\" '", rf"""ends_with(lower(regexp_replace({TRIM}, '^"+|"+$', '', 'g')), 'on.')""")
check("quotation", "startend:quotation", {}, lambda: F.concat(F.lit(' "'), T(), F.when(ID() % 2 == 0, '" ').otherwise("")), "' \"' || text || case when doc_id % 2 = 0 then '\" ' else '' end", rf"""length({TRIM}) > 1 and starts_with({TRIM}, '"') and ends_with({TRIM}, '"')""")
check("capital_word_frequency", "change_case:capital_word_frequency", {"capital_frequency": 3, "capital_relation": "at least"}, sql=f"{CAPITALS} >= 3")
check("english_capital", "change_case:english_capital", {}, lambda: F.when(ID() % 2 == 0, F.upper(T())).otherwise(T()), "case when doc_id % 2 = 0 then upper(text) else text end", f"{UPPER.format('t')} and coalesce(detected = 'en', true)")
check("english_lowercase", "change_case:english_lowercase", {}, lambda: F.when(ID() % 2 == 0, F.lower(T())).otherwise(T()), "case when doc_id % 2 = 0 then lower(text) else text end", f"{LOWER.format('t')} and coalesce(detected = 'en', true)")
check("no_comma", "punctuation:no_comma", {}, sql="not contains(t, ',')")
check("constrained_start", "", {"starter": "The"}, sql=r"regexp_matches(t, '(?m)^\s*The')", function=C.constrained_start)


@query("check_json_format", "select event_id, json_valid(case when event_id % 3 = 0 then left(props, length(props) - 1) else props end) as ok from events")
def check_json(spark, sf_dir):
    props = F.col("props")
    damaged = F.when(F.col("event_id") % 3 == 0, F.left(props, F.length(props) - 1)).otherwise(F.concat(F.lit("```json\n"), props, F.lit("\n```")))
    return table(spark, sf_dir, "events").select("event_id", C.json_format(damaged).alias("ok"))


ALL = {
    "existence": ("keywords:existence", {"keywords": ["the", "of"]}),
    "words": ("length_constraints:number_words", {"num_words": 300, "relation": "at least"}),
    "sentences": ("length_constraints:number_sentences", {"num_sentences": 20, "relation": "at least"}),
    "paragraphs": ("length_constraints:number_paragraphs", {"num_paragraphs": 1}),
    "letters": ("keywords:letter_frequency", {"letter": "e", "let_frequency": 100, "let_relation": "at least"}),
    "capitals": ("change_case:capital_word_frequency", {"capital_frequency": 3, "capital_relation": "at least"}),
    "no_comma": ("punctuation:no_comma", {}),
    "upper": ("change_case:english_capital", {}),
}


@query(
    "all_checks",
    rf"""with {language_sql('text')} select doc_id, {has_word('the')} and {has_word('of')} as existence, len(regexp_extract_all(t, '{W}+')) >= 300 as words,
    {SENTENCES} >= 20 as sentences,
    (with p as (select string_split_regex(t, '\s*\*\*\*\s*') as a), q as (select list_transform(a, lambda x: not regexp_matches(x, '\S')) as b, len(a) as n from p)
        select case when n > 2 and list_contains(b[2:n - 1], true) then false when n = 1 then n - b[1]::int = 1 else n - b[1]::int - b[n]::int = 1 end from q) as paragraphs,
    length(lower(t)) - length(replace(lower(t), 'e', '')) >= 100 as letters, {CAPITALS} >= 3 as capitals,
    not contains(t, ',') as no_comma, {UPPER.format('t')} and coalesce(detected = 'en', true) as upper from told""",
)
def all_checks(spark, sf_dir):
    """Many checks in one scan and one projection."""
    return table(spark, sf_dir, "documents").select("doc_id", *[C.REGISTRY[i](T(), **{k: literal(v) for k, v in kw.items()}).alias(name) for name, (i, kw) in ALL.items()])


# --- text functions


@query("words_count", f"select doc_id, len(regexp_extract_all(text, '{W}+'))::bigint as n from documents")
def words_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.count_words(T()).alias("n"))


@query("sentences_count", rf"select doc_id, ({SENTENCES})::bigint as n from (select doc_id, text as t from documents)")
def sentences_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.count_sentences(T()).alias("n"))


_PAIRS = f"""d as (select {sentence_tokens('text')} as a from documents), p as (select a[i] as token, case when i > 1 then a[i - 1] end as before from (select a, unnest(range(1, len(a) + 1)) as i from d))"""


@query("sentence_abbreviations", rf"""with {_PAIRS},
    w as (select lower(regexp_replace({stripped_token('token')}, '[.,;:!?]+$', '')) as word, ends_with({stripped_token('token')}, '.') and not ends_with({stripped_token('token')}, '..') as pointed from p),
    c as (select word, count(*) filter (pointed) as x, count(*) filter (not pointed) as o from w where word <> '' group by 1),
    s as (select sum(x) / sum(x + o) as q from c),
    r as (select word, x::bigint as with_point, o::bigint as without, length(replace(word, '.', '')) as k, -2 * (x * ln(q) + case when o > 0 then o * ln(1 - q) else 0 end - x * ln({N.OFTEN}) - case when o > 0 then o * ln(1 - {N.OFTEN}) else 0 end) as ratio
      from c, s where x > 0 and regexp_matches(word, '^\p{{L}}[\p{{L}}.]*$'))
    select word, with_point, without, ratio * exp(-k) * (length(word) - k + 1) * pow(k::double, -without::double) >= {N.LEAST_SCORE} as abbreviation from r""")
def sentence_abbreviations(spark, sf_dir):
    """What a corpus' own sentence model takes for abbreviations."""
    scores = N.abbreviation_scores(table(spark, sf_dir, "documents"))
    return scores.select("word", "with_point", "without", (F.col("score") >= N.LEAST_SCORE).alias("abbreviation"))


@query("sentence_small_words", rf"""with {_PAIRS},
    w as (select {token_word(stripped_token('token'))} as word, regexp_matches({stripped_token('token')}, '^\p{{Ll}}') as small, regexp_matches({stripped_token('token')}, '^\p{{Lu}}') and before is not null
      and not regexp_matches(before, '[.{N.MARKS}{N.WIDE_MARKS}:]{N.CLOSERS.replace("'", "''")}*$') and not regexp_matches({stripped_token('token')}, '^{N.OPENERS.replace("'", "''")}') as capital from p)
    select word, count(*) filter (small) as small, count(*) filter (capital) as capital from w where regexp_matches(word, '^\p{{L}}+$') group by 1""")
def sentence_small_words(spark, sf_dir):
    return N.small_words(table(spark, sf_dir, "documents"))


def sentences_sql() -> str:
    """Each mark in a text is judged by the characters next to it; the first and the last end tell the rest."""
    opener = "regexp_matches(r, '^ (" + "|".join(X.OPENERS) + ")')"
    firms, titles = "|".join(X.FIRMS), "|".join(X.TITLES)
    return rf"""with d as (select doc_id, ' ' || replace(text, chr(10), ' ') || '  ' as t from documents),
    p as (select doc_id, t, unnest(list_filter(range(1, length(t) + 1), lambda i: t[i] in ('.', '!', '?'))) as i from d),
    m as (select doc_id, t, i, t[i] as c, t[i + 1] as q, t[greatest(i - 6, 1):i - 1] as l, t[i + 1:i + 12] as r from p),
    e as (select *, case when c <> '.' then true when q = '.' then false when right(l, 1) = '.' then true
      when (regexp_matches(l, ' ({firms})$') or regexp_matches(l, '[A-Z]\.[A-Z]$')) and {opener} then true
      else not (regexp_matches(l, '({titles})$') or regexp_matches(l, ' ({firms})$') or regexp_matches(l, ' [A-Za-z]$') or regexp_matches(l, '[A-Za-z]\.[A-Za-z]$') or ends_with(l, 'Ph.D') or (regexp_matches(l, '\s[A-Za-z]$') and starts_with(r, ' '))
        or regexp_matches(r, '^({"|".join(X.DOMAINS)})') or (regexp_matches(l, '[0-9]$') and regexp_matches(r, '^[0-9]')) or (regexp_matches(l, '[A-Za-z]$') and regexp_matches(r, '^[A-Za-z]\.')) or (ends_with(l, 'Ph') and starts_with(r, 'D.'))) end as ends from m),
    f as (select *, case when (c = '.' and right(l, 1) <> '.' and q in ('"', '”')) or (c <> '.' and q = '"') then q else '' end as moved from e where ends),
    g as (select doc_id, count(*) as n, min(i) as low, max(i + length(moved)) as high, arg_min(moved || c, i) as close from f group by 1)
    select d.doc_id, (coalesce(g.n, 0) + (trim(t[coalesce(g.high, 0) + 1:]) <> '')::int)::bigint as n, case when g.n is null then nullif(trim(t), '') else trim(t[:g.low - 1] || g.close) end as first from d left join g on d.doc_id = g.doc_id"""


@query("sentences_split", sentences_sql())
def sentences_split(spark, sf_dir):
    both = X.bound(X.split_sentences(T()), lambda p: F.struct(F.size(p).cast("long").alias("n"), F.get(p, 0).alias("first")))
    return table(spark, sf_dir, "documents").select("doc_id", both.alias("x")).select("doc_id", "x.n", "x.first")


#: Contractions, words written together and marks come into texts that have none.
_CONTRACTED = """replace(replace(replace(text, ' the ', ' DON''T (cannot) '), ' in ', ' it''s, WE''LL: U.S. '), ' and ', ' GONNA 10:30 A&B--c... ')"""


@query("treebank_tokens", f"select doc_id, len(k)::bigint as n, len(list_filter(k, lambda x: {UPPER.format('x')}))::bigint as capitals, md5(array_to_string(k, ' ')) as digest from (select doc_id, {tokens_sql('t')} as k from (select doc_id, {_CONTRACTED} as t from documents))")
def treebank_tokens(spark, sf_dir):
    text = T()
    for own, other in ((" the ", " DON'T (cannot) "), (" in ", " it's, WE'LL: U.S. "), (" and ", " GONNA 10:30 A&B--c... ")):
        text = F.replace(text, F.lit(own), F.lit(other))
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("t"))
    seen = X.bound(K.treebank_tokens(F.col("t")), lambda k: F.struct(F.size(k).cast("long").alias("n"), F.size(F.filter(k, X.is_upper)).cast("long").alias("capitals"), F.md5(F.array_join(k, " ")).alias("digest")))
    return docs.select("doc_id", seen.alias("x")).select("doc_id", "x.n", "x.capitals", "x.digest")


@query("stopword_count", f"select doc_id, len(list_filter(regexp_extract_all(lower(text), '{W}+'), lambda x: x in ({', '.join(repr(w) for w in X.ENGLISH_STOP_WORDS)})))::bigint as n from documents")
def stopword_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.count_stopwords(T()).alias("n"))


@query("language_id", f"with {language_sql('text')} select doc_id, detected from told")
def language_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.detect_language(T()).alias("detected"))


@query("language_accuracy", f"with {language_sql('text')} select lang, coalesce(detected, 'unknown') as detected, count(*)::bigint as n, sum(length(t))::bigint as characters from told group by all")
def language_accuracy(spark, sf_dir):
    """How the languages that documents are labelled with come out."""
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("lang", F.coalesce(X.detect_language(T()), F.lit("unknown")).alias("detected")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("characters"))


#: A short sentence in each language that a check may name, none of them among those that the model is fitted on.
SENTENCE_IN = {
    "ar": "أحب قراءة الكتب في المساء مع أصدقائي", "bg": "обичам да чета книги вечер с приятели", "bn": "আমি সন্ধ্যায় বই পড়তে ভালোবাসি", "de": "abends lese ich gern Bücher mit meinen Freunden",
    "en": "in the evening I like reading books with friends", "es": "por la noche me gusta leer libros con mis amigos", "fa": "شب‌ها دوست دارم با دوستانم کتاب بخوانم", "fi": "luen iltaisin mielelläni kirjoja ystävieni kanssa",
    "fr": "le soir j'aime lire des livres avec mes amis", "gu": "મને સાંજે પુસ્તકો વાંચવા ગમે છે", "he": "בערב אני אוהב לקרוא ספרים עם חברים", "hi": "मुझे शाम को दोस्तों के साथ किताबें पढ़ना पसंद है", "it": "la sera mi piace leggere libri con gli amici",
    "ja": "夜は友達と本を読むのが好きです", "kn": "ನನಗೆ ಸಂಜೆ ಪುಸ್ತಕ ಓದುವುದು ಇಷ್ಟ", "ko": "저녁에는 친구들과 책을 읽는 것을 좋아합니다", "ml": "വൈകുന്നേരം പുസ്തകം വായിക്കാൻ എനിക്കിഷ്ടമാണ്", "mr": "मला संध्याकाळी मित्रांसोबत पुस्तके वाचायला आवडते आणि",
    "ne": "मलाई साँझ साथीहरूसँग किताब पढ्न मन पर्छ र", "pa": "ਮੈਨੂੰ ਸ਼ਾਮ ਨੂੰ ਕਿਤਾਬਾਂ ਪੜ੍ਹਨਾ ਪਸੰਦ ਹੈ", "pl": "wieczorem lubię czytać książki z przyjaciółmi", "pt": "à noite gosto de ler livros com os meus amigos", "ru": "вечером я люблю читать книги с друзьями",
    "sw": "jioni napenda kusoma vitabu pamoja na marafiki zangu", "ta": "மாலையில் புத்தகம் படிப்பது எனக்குப் பிடிக்கும்", "te": "సాయంత్రం పుస్తకాలు చదవడం నాకు ఇష్టం", "th": "ตอนเย็นฉันชอบอ่านหนังสือกับเพื่อน", "uk": "увечері я люблю читати книжки з друзями",
    "ur": "مجھے شام کو دوستوں کے ساتھ کتابیں پڑھنا پسند ہے", "vi": "buổi tối tôi thích đọc sách cùng bạn bè", "zh": "晚上我喜欢和朋友一起看书",
}
#: A document's first word, which may be of another language, stands before a sentence that its id chooses.
_OWN_SENTENCE = f"split_part(text, ' ', 1) || ' ' || [{', '.join(repr(x) if chr(39) not in x else chr(39) + x.replace(chr(39), chr(39) * 2) + chr(39) for x in SENTENCE_IN.values())}][doc_id % {len(SENTENCE_IN)} + 1]"


@query("language_of_sentences", f"with {language_sql(_OWN_SENTENCE, tuple(L.SHARED))} select doc_id, detected from told")
def language_of_sentences(spark, sf_dir):
    sentence = F.get(F.array(*map(F.lit, SENTENCE_IN.values())), (ID() % len(SENTENCE_IN)).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", X.detect_language(F.concat_ws(" ", F.split_part(T(), F.lit(" "), F.lit(1)), sentence)).alias("detected"))


@query("language_model_fit", rf"""with p as (select lang, regexp_replace(' ' || lower(text) || ' ', '[^\p{{L}}\p{{M}}]+', ' ', 'g') as t from documents where lang in ({', '.join(repr(x) for x in L.SHARED['Latin'])})),
    g as (select lang, unnest(list_concat(list_filter(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3)), lambda x: substr(x, 2, 1) <> ' '),
      list_transform(list_filter(string_split(t, ' '), lambda x: length(x) > 1), lambda x: ' ' || x || ' '), regexp_extract_all(t, '[^\x00-\x7f]'))) as gram from p),
    c as (select lang, gram, count(*) as n from g group by all), k as (select gram from c group by 1 having sum(n) >= 100)
    select lang, gram, n::bigint as n from c where gram in (select gram from k)""")
def language_model_fit(spark, sf_dir):
    """The counts that a model of the documents' own languages is made of."""
    return L.counted(table(spark, sf_dir, "documents"), least=100).select("lang", "gram", "n")


@query("keyword_sample", "select doc_id, least(60, len(list_distinct(list_filter(string_split_regex(text, '[^a-z]+'), lambda x: x <> ''))))::bigint as n, true as apart from documents")
def keyword_sample(spark, sf_dir):
    words = F.filter(F.split(T(), "[^a-z]+"), lambda x: x != "")
    seen = X.bound(X.sample_words(words, 60, 1), lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(F.array_intersect(x, words)) == F.size(x)).alias("apart")))
    return table(spark, sf_dir, "documents").select("doc_id", seen.alias("x")).select("doc_id", "x.n", "x.apart")


THOUGHT = "case when doc_id % 3 = 0 then 'hm</think>' || chr(10) || chr(10) || text || '</think>' || chr(10) || chr(10) || 'x' else text end"


@query("think_strip", f"with d as (select doc_id, {THOUGHT} as t from documents) select doc_id, case when contains(t, '</think>' || chr(10) || chr(10)) then split_part(t, '</think>' || chr(10) || chr(10), 2) else t end as stripped from d")
def think_strip(spark, sf_dir):
    thought = F.when(ID() % 3 == 0, F.concat(F.lit("hm</think>\n\n"), T(), F.lit("</think>\n\nx"))).otherwise(T())
    return table(spark, sf_dir, "documents").select("doc_id", X.strip_thinking(thought).alias("stripped"))


@query(
    "loose_variants",
    r"""with d as (select doc_id, text, string_split(text, chr(10)) as a from documents),
    e as (select doc_id, [text, array_to_string(a[2:], chr(10)), array_to_string(a[:len(a) - 1], chr(10)), case when len(a) > 2 then array_to_string(a[2:len(a) - 1], chr(10)) else '' end] as v, len(a) as n from d),
    f as (select doc_id, [v[1], regexp_replace(v[2], '^\s+|\s+$', '', 'g'), case when n = 1 then '' else regexp_replace(v[3], '^\s+|\s+$', '', 'g') end, regexp_replace(v[4], '^\s+|\s+$', '', 'g')] as v from e)
    select doc_id, unnest(range(0, 8)) as i, unnest(v || list_transform(v, lambda x: replace(x, '*', ''))) as variant from f""",
)
def loose_variants(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.loose_variants(T())).alias("i", "variant")).withColumn("i", F.col("i").cast("long"))


KEY = "floor(doc_id / 10)::bigint::varchar || ':' || case when doc_id % 10 = 0 then 'original' when doc_id % 10 <= 3 then 'rephrasing' when doc_id % 10 <= 6 then 'distractor' else 'ct_alteration' end || ':' || (doc_id % 10)::varchar"


def keyed(docs: DataFrame) -> DataFrame:
    """Documents as variants of groups of ten, with a flag."""
    m = ID() % 10
    kind = F.when(m == 0, "original").when(m <= 3, "rephrasing").when(m <= 6, "distractor").otherwise("ct_alteration")
    return docs.withColumn("pos", ID()).withColumn("key", F.concat_ws(":", F.floor(ID() / 10).cast("string"), kind, m.cast("string"))).withColumn("ok", ~T().contains("ing"))


@query("key_parts", f"select doc_id, split_part({KEY}, ':', 1) as root, split_part({KEY}, ':', 2) as type from documents")
def key_parts(spark, sf_dir):
    return keyed(table(spark, sf_dir, "documents")).select("doc_id", X.key_root(F.col("key")).alias("root"), X.key_type(F.col("key")).alias("type"))


@query("sampling_id", "select doc_id, (doc_id % 7)::int as sample from documents")
def sampling(spark, sf_dir):
    prompt = F.concat(F.lit("p--kk--"), (ID() % 7).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", X.sampling_id(prompt).alias("sample"))


# --- prompts and responses

IDS = ["length_constraints:number_words", "punctuation:no_comma", "keywords:existence"]


def conversation_prompts(spark, sf_dir) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    kwargs = F.array(*[_args(own) for own in ({"num_words": 60, "relation": "at least"}, {}, {"keywords": ["the"]})])
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), F.concat_ws(":", "conv_id", F.lit("original"), "turn").alias("key"), F.col("text").alias("prompt"), F.array(*map(F.lit, IDS)).alias("instruction_id_list"), kwargs.alias("kwargs"))


def _args(own: dict) -> Column:
    return F.struct(*[(literal(own[f.name]) if f.name in own else F.lit(None)).cast(f.dataType).alias(f.name) for f in C.KWARGS])


def conversation_responses(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    user = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt"), (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"))
    return user.join(c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("response")), ["conv_id", "turn"])


def latest(spark, sf_dir) -> DataFrame:
    from ..sources.jsonl import latest_responses

    return latest_responses(conversation_responses(spark, sf_dir))


PAIRS = """prompts as (select conv_id * 1000 + turn as pos, conv_id::varchar || ':original:' || turn::varchar as key, text as prompt from conversations where role = 'user'),
responses as (select u.text as prompt, arg_max(a.text, u.conv_id * 1000 + u.turn) as response from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant' group by 1),
joined as (select p.pos, p.key, p.prompt, r.response from prompts p left join responses r on p.prompt = r.prompt)"""


def three_checks(t: str) -> str:
    return f"[regexp_matches({t}, '\\S') and len(regexp_extract_all({t}, '{W}+')) >= 60, regexp_matches({t}, '\\S') and not contains({t}, ','), regexp_matches({t}, '\\S') and {has_word('the', t)}]"


STRICT = f"with {PAIRS}, checked as (select pos, key, prompt, {three_checks('coalesce(response, chr(32))')} as f from joined)"


def strict(spark, sf_dir) -> DataFrame:
    return E.evaluate_strict(conversation_prompts(spark, sf_dir), latest(spark, sf_dir), only=IDS)


@query("prompt_response_join", f"with {PAIRS} select pos::bigint as pos, key, response from joined")
def prompt_response_join(spark, sf_dir):
    return E.join_responses(conversation_prompts(spark, sf_dir), latest(spark, sf_dir)).select("pos", "key", "response")


@query("strict_eval", f"{STRICT} select pos::bigint as pos, key, f[1] and f[2] and f[3] as follow_all, array_to_string(list_transform(f, lambda x: x::varchar), ',') as flags from checked")
def strict_eval(spark, sf_dir):
    return strict(spark, sf_dir).select("pos", "key", F.col("follow_all_instructions").alias("follow_all"), F.array_join(F.transform("follow_instruction_list", lambda x: x.cast("string")), ",").alias("flags"))


LOOSE = rf"""with {PAIRS}, d as (select pos, key, coalesce(response, '') as t, string_split(coalesce(response, ''), chr(10)) as a from joined),
e as (select pos, key, [t, array_to_string(a[2:], chr(10)), case when len(a) = 1 then '' else array_to_string(a[:len(a) - 1], chr(10)) end, case when len(a) > 2 then array_to_string(a[2:len(a) - 1], chr(10)) else '' end] as v from d),
g as (select pos, key, unnest(v || list_transform(v, lambda x: replace(x, '*', ''))) as t from e), h as (select pos, key, {three_checks('t')} as f from g),
best as (select pos, key, [bool_or(f[1]), bool_or(f[2]), bool_or(f[3])] as f from h group by pos, key)"""


@query("loose_eval", f"{LOOSE} select pos::bigint as pos, key, f[1] and f[2] and f[3] as follow_all, array_to_string(list_transform(f, lambda x: x::varchar), ',') as flags from best")
def loose_eval(spark, sf_dir):
    done = E.evaluate_loose(conversation_prompts(spark, sf_dir), latest(spark, sf_dir), mode="flag", only=IDS)
    return done.select("pos", "key", F.col("follow_all_instructions").alias("follow_all"), F.array_join(F.transform("follow_instruction_list", lambda x: x.cast("string")), ",").alias("flags"))


IDS_SQL = "[" + ", ".join(f"'{x}'" for x in IDS) + "]"
FLAGS = f"{STRICT}, flags as (select unnest({IDS_SQL}) as instruction_id, unnest(f) as ok from checked)"


@query("accuracy_prompt", f"{STRICT} select avg((f[1] and f[2] and f[3])::int)::double as accuracy from checked")
def accuracy_prompt(spark, sf_dir):
    return M.prompt_accuracy(strict(spark, sf_dir))


@query("accuracy_instruction", f"{FLAGS} select avg(ok::int)::double as accuracy from flags")
def accuracy_instruction(spark, sf_dir):
    return M.instruction_accuracy(strict(spark, sf_dir))


@query("accuracy_tier0", f"{FLAGS} select split_part(instruction_id, ':', 1) as category, avg(ok::int)::double as accuracy from flags group by 1")
def accuracy_tier0(spark, sf_dir):
    return M.category_accuracy(strict(spark, sf_dir))


@query("accuracy_tier1", f"{FLAGS} select instruction_id, avg(ok::int)::double as accuracy from flags group by 1")
def accuracy_tier1(spark, sf_dir):
    return M.id_accuracy(strict(spark, sf_dir))


# --- reliability

RELIABLE = """buckets as (select *, unnest(case when type = 'original' then ['all', 'original', 'ct_alteration', 'rephrasing', 'distractor'] else ['all', type] end) as bucket from keyed),
ranked as (select *, row_number() over (partition by {by} bucket, root order by (type <> 'original')::int, pos) as rn from buckets),
groups as (select {by} bucket, root, sum(ok::int) as s, sum(case when rn <= 2 then ok::int else 0 end) as s2, sum(case when rn <= 4 then ok::int else 0 end) as s4 from ranked group by {by} bucket, root),
found as (select {by} 'reliable_at_k_all' as metric, avg((s = 10)::int)::double as value from groups where bucket = 'all' group by all
  union all select {by} 'reliable_at_k_original', avg((s = 1)::int)::double from groups where bucket = 'original' group by all
  union all select {by} bucket || '_at_2', avg((s2 = 2)::int)::double from groups where bucket not in ('all', 'original') group by {by} bucket
  union all select {by} bucket || '_at_4', avg((s4 = 4)::int)::double from groups where bucket not in ('all', 'original') group by {by} bucket)"""
KEYED = f"keyed as (select doc_id as pos, split_part({KEY}, ':', 1) as root, split_part({KEY}, ':', 2) as type, not contains(text, 'ing') as ok from documents)"
RELIABLE_1 = f"with {KEYED}, {RELIABLE.format(by='')}"


def reliable(spark, sf_dir) -> DataFrame:
    return M.reliable_at_k(keyed(table(spark, sf_dir, "documents")))


@query("reliable_at_k", f"{RELIABLE_1} select metric, value from found")
def reliable_at_k(spark, sf_dir):
    return reliable(spark, sf_dir)


@query("relative_drop", f"{RELIABLE_1} select 1 - max(case when metric = 'reliable_at_k_all' then value end) / nullif(max(case when metric = 'reliable_at_k_original' then value end), 0) as relative_drop from found")
def relative_drop(spark, sf_dir):
    return M.relative_drop(reliable(spark, sf_dir))


def sampled(spark, sf_dir) -> DataFrame:
    """Documents as three samples of each key."""
    docs = table(spark, sf_dir, "documents")
    base = keyed(docs.withColumn("sample", ID() % 3).withColumn("pos0", ID()).withColumn("doc_id", F.floor(ID() / 3).cast("long")))
    return base.select(F.col("pos0").alias("pos"), "key", F.concat(F.lit("p--kk--"), F.col("sample").cast("string")).alias("prompt"), "ok")


SAMPLED = f"""with base as (select doc_id as pos0, doc_id % 3 as sample, floor(doc_id / 3)::bigint as doc_id, text from documents),
raw as (select pos0, {KEY} as key, not contains(text, 'ing') as ok from base), numbered as (select *, row_number() over (partition by key order by pos0) as rn from raw),
firsts as (select key, min(pos0) as pos, coalesce(min(case when ok then rn end), 1000000) as first from numbered group by key),
keyed as (select n::int as n, pos, split_part(key, ':', 1) as root, split_part(key, ':', 2) as type, first <= n as ok from firsts, range(1, 4) r(n))"""


@query("reliability_sampling", f"{SAMPLED}, {RELIABLE.format(by='n,')} select n, metric, value from found")
def reliability_sampling(spark, sf_dir):
    return M.sampled_reliability(sampled(spark, sf_dir))


# --- resuming, variants, judging


@query("resume_anti_join", "select conv_id from (select distinct conv_id from conversations) where conv_id::varchar not in (select (doc_id * 2)::varchar from labels)")
def resume_anti_join(spark, sf_dir):
    prompts = table(spark, sf_dir, "conversations").select("conv_id", F.col("conv_id").cast("string").alias("key")).distinct()
    return S.resume(prompts, table(spark, sf_dir, "labels").select((F.col("doc_id") * 2).cast("string").alias("key"))).select("conv_id")


@query("completed_keys", "select distinct (doc_id % 100)::varchar as key from documents")
def completed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select((ID() % 100).cast("string").alias("key")).distinct()


@query("variant_explode", "select item_id::varchar || ':rephrasing:' || i::varchar as key, text || ' v' || i::varchar as prompt, text as original_prompt from benchmark, range(1, 25) r(i)")
def variant_explode(spark, sf_dir):
    base = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("key"), F.col("text").alias("prompt"))
    many = base.withColumn("v", F.transform(F.sequence(F.lit(1), F.lit(24)), lambda i: F.concat("prompt", F.lit(" v"), i.cast("string"))))
    return S.keyed_variants(many, "v", "rephrasing")


def judged(spark, sf_dir) -> DataFrame:
    good = F.col("quality") == 1
    verdict = F.struct(F.when(ID() % 11 == 0, S.FAILED).otherwise("fine").alias("reasoning"), good.alias("is_valid"))
    return table(spark, sf_dir, "labels").select(F.concat_ws(":", (ID() % 10).cast("string"), F.lit("rephrasing"), ID().cast("string")).alias("key"), "doc_id", verdict.alias(S.JUDGEMENT))


@query("validity_filter", "select doc_id from labels where quality = 1 and doc_id % 11 <> 0")
def validity_filter(spark, sf_dir):
    return S.valid_rows(judged(spark, sf_dir)).select("doc_id")


@query("validity_count", "select (doc_id % 10)::varchar as root, count(*) filter (where quality = 1 and doc_id % 11 <> 0)::bigint as valid from labels group by 1")
def validity_count(spark, sf_dir):
    return S.valid_by_root(judged(spark, sf_dir))


@query("conflict_closure", "with e as (select n_nationkey as a, n_regionkey as b from nation) select a, b from e union select b, a from e union select a, a from e union select b, b from e")
def conflict_closure(spark, sf_dir):
    return S.conflict_closure(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("b")))


@query("category_projection", f"select distinct split_part(x, ':', 1) as category from (select unnest({IDS_SQL}) as x)")
def category_projection(spark, sf_dir):
    return conversation_prompts(spark, sf_dir).select(F.explode("instruction_id_list").alias("id")).select(F.split_part("id", F.lit(":"), F.lit(1)).alias("category")).distinct()


@query("chat_messages", "select item_id, 'system' as first_role, 'user' as last_role, text as content from benchmark")
def chat_messages(spark, sf_dir):
    m = S.messages(T(), "Be brief.")
    return table(spark, sf_dir, "benchmark").select("item_id", F.get(m, 0)["role"].alias("first_role"), F.get(m, 1)["role"].alias("last_role"), F.get(m, 1)["content"].alias("content"))


def benchmark_prompts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("key"), T().alias("prompt"), F.array(F.lit(IDS[1])).alias("instruction_id_list"), F.array(_args({})).alias("kwargs"))


def md5_client(requests: list[list[dict]]) -> list[str | None]:
    return [md5(r[-1]["content"].encode()).hexdigest() for r in requests]


def request_of(messages: list[dict]) -> str:
    """What stands after the last heading of a rendered request."""
    return messages[-1]["content"].rsplit("\n\nRequest:\n", 1)[-1]


def versions_client(requests: list[list[dict]]) -> list[str | None]:
    """Eight versions of each request, as an array or typed."""
    out = []
    for own in map(request_of, requests):
        text, _, batch = own.partition("\n\nBatch ")
        many = [f"{text} {batch}/{i}" for i in range(1, 9)]
        out.append(json.dumps(many if batch else {"outputs": [{"random_seed": str(i), "reasoning": "", "revised_prompt": v, "revised_instruction_id_list": [IDS[0]], "revised_kwargs": json.dumps([{"num_words": i, "relation": "at least"}])} for i, v in enumerate(many)]}))
    return out


def verdict_client(requests: list[list[dict]]) -> list[str | None]:
    """Valid where a request's length is even; no reply where it is divisible by five."""
    lengths = [len(r[-1]["content"].rsplit("\n\n", 1)[-1]) for r in requests]
    return [None if n % 5 == 0 else json.dumps({"reasoning": "by length", "is_valid": n % 2 == 0}) for n in lengths]


@query("generate_offline", "select item_id::varchar as key, text as prompt, md5(text) as response from benchmark")
def generate_offline(spark, sf_dir):
    return S.generate(benchmark_prompts(spark, sf_dir), md5_client)


@query("generate_resumed", "select item_id::varchar as key, md5(text) as response from benchmark where item_id not in (select doc_id from labels where quality = 1)")
def generate_resumed(spark, sf_dir):
    done = table(spark, sf_dir, "labels").where("quality = 1").select(ID().cast("string").alias("key"))
    return S.generate(benchmark_prompts(spark, sf_dir), md5_client, done).select("key", "response")


@query(
    "synthesis_offline",
    """with k(label, total) as (values ('rephrasing', 24), ('distractor', 8), ('ct_alteration', 8)),
    v as (select item_id, label, i, floor((i - 1) / 8)::int * 8 as batch, text from benchmark, k, range(1, 25) r(i) where i <= total)
    select item_id::varchar || ':' || label || ':' || i::varchar as key, text || ' ' || batch::varchar || '/' || (i - batch)::varchar as prompt, text as original_prompt from v""",
)
def synthesis_offline(spark, sf_dir):
    base = benchmark_prompts(spark, sf_dir)
    return S.union_variants(*[S.synthesise(base, kind, versions_client) for kind in ("rephrasing", "distractor", "task")]).select("key", "prompt", "original_prompt")


@query(
    "synthesis_fillin",
    f"select item_id::varchar || ':ct_alteration:' || i::varchar as key, text || ' /' || i::varchar as prompt, text as original_prompt, '{IDS[0]}' as instruction_id, (i - 1)::bigint as num_words, '{IDS[1]}' as original_id from benchmark, range(1, 9) r(i)",
)
def synthesis_fillin(spark, sf_dir):
    made = S.synthesise(benchmark_prompts(spark, sf_dir), "fillin", versions_client)
    return made.select("key", "prompt", "original_prompt", F.get("instruction_id_list", 0).alias("instruction_id"), F.get("kwargs", 0)["num_words"].alias("num_words"), F.get("original_instruction_id_list", 0).alias("original_id"))


@query("judge_offline", f"select item_id::varchar as key, length(text) % 5 <> 0 and length(text) % 2 = 0 as is_valid, case when length(text) % 5 = 0 then '{S.FAILED}' else 'by length' end as reasoning from benchmark")
def judge_offline(spark, sf_dir):
    return S.judge(benchmark_prompts(spark, sf_dir), verdict_client).select("key", F.col(f"`{S.JUDGEMENT}`.is_valid").alias("is_valid"), F.col(f"`{S.JUDGEMENT}`.reasoning").alias("reasoning"))


@query("rendered_requests", "select item_id, kind, true as asks, (length(text) + 1)::bigint as from_end from benchmark, (values ('rephrasing'), ('distractor'), ('task'), ('fillin')) k(kind)")
def rendered_requests(spark, sf_dir):
    """Each template says how many versions it wants, lists the constraints and ends with the request."""
    base = benchmark_prompts(spark, sf_dir)
    rows = [base.select(F.col("key").cast("long").alias("item_id"), F.lit(kind).alias("kind"), "prompt", S.render(kind, F.col("prompt"), F.col("instruction_id_list"), F.col("kwargs"), 8).alias("r")) for kind in S.KINDS]
    out = rows[0].union(rows[1]).union(rows[2]).union(rows[3])
    whole = F.col("r").contains("8 versions") & F.col("r").contains(IDS[1]) & F.endswith("r", F.concat(F.lit("\n"), "prompt"))
    return out.select("item_id", "kind", whole.alias("asks"), (F.length("r") - F.length(F.regexp_replace("r", r"(?s)(.*)\n\nRequest:\n.*", "$1")) - 10).cast("long").alias("from_end"))


# --- all ids, own checks


def every_check() -> list[tuple[str, dict, Callable[[], Column], str, str]]:
    json_text = ("detectable_format:json_format", {}, lambda: F.when(ID() % 2 == 0, F.concat(F.lit('{"a": '), ID().cast("string"), F.lit("}"))).otherwise(T()), "case when doc_id % 2 = 0 then '{\"a\": ' || doc_id::varchar || '}' else text end", "json_valid(t)")
    return [*CHECKS, json_text]


def every_sql() -> str:
    many = every_check()

    def part(k: int, name: str, text: str, sql: str) -> str:
        own = f"(select doc_id, {text} as t from documents)"
        if "detected" in sql:
            own = f"(with {language_sql(text, source=f'(select * from documents where doc_id % {len(many)} = {k})')} select doc_id, t, detected from told)"
        return f"select doc_id, '{name}' as instruction_id, coalesce({sql}, false) as ok from {own} where doc_id % {len(many)} = {k}"

    parts = [part(k, name, text, sql) for k, (name, _, _, text, sql) in enumerate(many)]
    return " union all ".join(parts)


@query("dispatch_all", every_sql())
def dispatch_all(spark, sf_dir):
    """Every registered check through its id and arguments, each on a share of the documents."""
    many = every_check()
    which = ID() % len(many)

    def choice(column: Callable[[tuple], Column]) -> Column:
        out = F.when(which == 0, column(many[0]))
        for k, own in enumerate(many[1:], 1):
            out = out.when(which == k, column(own))
        return out

    docs = table(spark, sf_dir, "documents").select("doc_id", choice(lambda c: F.lit(c[0])).alias("instruction_id"), choice(lambda c: c[2]()).alias("t"), choice(lambda c: _args(c[1])).alias("kw"))
    return docs.select("doc_id", "instruction_id", C.dispatch(F.col("t"), F.col("instruction_id"), F.col("kw")).alias("ok"))


@query("own_check", "select doc_id, length(text) - length(replace(text, 'qu', '')) >= 2 * (doc_id % 3) as ok from documents")
def own_check(spark, sf_dir):
    """A check of a user's own, with an argument of its own."""
    if "own:pairs" not in C.REGISTRY:
        from pyspark.sql import types

        C.register_checker("own:pairs", lambda v, own_pair, own_least: F.length(v) - F.length(F.replace(v, own_pair, F.lit(""))) >= F.length(own_pair) * own_least, "{own_pair} occurs {own_least} times or more.", {"own_pair": types.StringType(), "own_least": types.LongType()})
    docs = table(spark, sf_dir, "documents").select("doc_id", T().alias("t"), F.struct(F.lit("qu").alias("own_pair"), (ID() % 3).alias("own_least")).alias("kw"))
    try:
        return docs.select("doc_id", C.dispatch(F.col("t"), F.lit("own:pairs"), F.col("kw"), ["own:pairs"]).alias("ok"))
    finally:
        C.unregister_checker("own:pairs")


@query("reliable_at_k_labels", RELIABLE_1.replace("(s = 10)", "(s = 4)") + " select metric, value from found where metric not like 'distractor%'")
def reliable_at_k_labels(spark, sf_dir):
    return M.reliable_at_k(keyed(table(spark, sf_dir, "documents")), kinds=("ct_alteration", "rephrasing"), whole=4).where("metric is not null")


# --- files


def folder(spark, name: str) -> str:
    """A new folder where the session keeps what driver and executors share."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/plumbline"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table_of(spark, rows: DataFrame, name: str) -> DataFrame:
    """Rows as they are now."""
    path = folder(spark, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def written_prompts(spark, sf_dir) -> str:
    path = folder(spark, "prompts")
    J.append_lines(conversation_prompts(spark, sf_dir).drop("pos").withColumn("more", F.lit(1)), path)
    return path


def written_responses(spark, sf_dir) -> str:
    path = folder(spark, "responses")
    J.append_lines(conversation_responses(spark, sf_dir).orderBy("pos").select("prompt", "response"), path)
    return path


@query("lines_prompts", "select conv_id::varchar || ':original:' || turn::varchar as key, text as prompt, 3::bigint as n_instructions, 60::bigint as num_words from conversations where role = 'user'")
def lines_prompts(spark, sf_dir):
    """Prompts written as JSON lines and read with their schema; fields that it doesn't have are dropped."""
    back = J.read_prompts(spark, written_prompts(spark, sf_dir))
    return back.select("key", "prompt", F.size("instruction_id_list").cast("long").alias("n_instructions"), F.get("kwargs", 0)["num_words"].alias("num_words"))


@query("lines_responses", f"with {PAIRS} select prompt, response from responses")
def lines_responses(spark, sf_dir):
    """Of several responses to a prompt, the last line counts."""
    return J.read_responses(spark, written_responses(spark, sf_dir))


@query("lines_blank", "select doc_id, n_chars::bigint as n_chars from documents")
def lines_blank(spark, sf_dir):
    """Blank lines between records are skipped."""
    path = folder(spark, "blank")
    table(spark, sf_dir, "documents").select(F.concat(F.to_json(F.struct("doc_id", "n_chars")), F.when(ID() % 3 == 0, "\n\n").when(ID() % 3 == 1, "\n  ").otherwise("")).alias("value")).write.text(path)
    return J.read_lines(spark, path).select("doc_id", "n_chars")


@query("lines_completed", "select distinct (doc_id % 100)::varchar as key from documents where doc_id % 7 <> 0")
def lines_completed(spark, sf_dir):
    """Keys of the lines that parse; broken ones are left out."""
    path = folder(spark, "completed")
    whole = F.to_json(F.struct((ID() % 100).cast("string").alias("key"), F.lit("r").alias("response")))
    table(spark, sf_dir, "documents").select(F.when(ID() % 7 == 0, F.left(whole, F.length(whole) - 1)).otherwise(whole).alias("value")).write.text(path)
    return J.completed_keys(spark, path)


@query("lines_records", "select doc_id, lang, source, part from documents, (values ('a'), ('b')) p(part) where doc_id % 2 = 0 or part = 'b'")
def lines_records(spark, sf_dir):
    """Appended twice after an overwrite, read with all their fields."""
    path, docs = folder(spark, "records"), table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    J.write_variants(docs.withColumn("part", F.lit("gone")), path, "overwrite")
    J.write_variants(docs.where(ID() % 2 == 0).withColumn("part", F.lit("a")), path, "overwrite")
    J.write_variants(docs.withColumn("part", F.lit("b")), path)
    return J.read_records(spark, path).select("doc_id", "lang", "source", "part")


@query("detail_sink", f"{STRICT} select key, f[1] and f[2] and f[3] as follow_all, (f[1]::int + f[2]::int + f[3]::int)::bigint as n_followed from checked")
def detail_sink(spark, sf_dir):
    path = folder(spark, "detail")
    J.write_detail(strict(spark, sf_dir), path)
    back = J.read_records(spark, path)
    return back.select("key", F.col("follow_all_instructions").alias("follow_all"), F.size(F.filter("follow_instruction_list", lambda x: x)).cast("long").alias("n_followed"))


@query("judged_sinks", "select doc_id, place from labels, (values ('annotated'), ('valid')) p(place) where place = 'annotated' or (quality = 1 and doc_id % 11 <> 0)")
def judged_sinks(spark, sf_dir):
    paths = {name: folder(spark, name) for name in ("annotated", "valid")}
    verdict = F.col(f"`{S.JUDGEMENT}`")
    J.write_judged(judged(spark, sf_dir), *paths.values(), verdict["is_valid"] & (verdict["reasoning"] != S.FAILED))
    parts = [J.read_records(spark, path).select("doc_id", F.lit(name).alias("place")) for name, path in paths.items()]
    return parts[0].union(parts[1])


def failing_client(requests: list[list[dict]]) -> list[str | None]:
    """Fails for a third of the requests, by their length."""
    return [None if len(r[-1]["content"]) % 3 == 0 else reply for r, reply in zip(requests, md5_client(requests))]


@query("generate_failing", "select item_id::varchar as key, md5(text) as response from benchmark where length(text) % 3 <> 0")
def generate_failing(spark, sf_dir):
    """Failed requests leave no rows."""
    return S.generate(benchmark_prompts(spark, sf_dir), failing_client).select("key", "response")


@query("generate_batches", "select item_id::varchar as key, md5(text) as response, length(text) % 3 = 0 as later from benchmark")
def generate_batches(spark, sf_dir):
    """Responses kept batch by batch; what failed in one run is asked for by the next, and nothing else."""
    path = folder(spark, "responses")
    S.generate_into(benchmark_prompts(spark, sf_dir), failing_client, path, tasks=2, batch_rows=64)
    first = table_of(spark, J.completed_keys(spark, path), "first")
    S.generate_into(benchmark_prompts(spark, sf_dir), md5_client, path, tasks=2, batch_rows=64)
    back = spark.read.schema(J.RESPONSES).json(path)
    return back.join(first.select("key", F.lit(False).alias("now")), "key", "left").select("key", "response", F.coalesce("now", F.lit(True)).alias("later"))


@query("synthesised_batches", "select item_id || ':ct_alteration:' || i as key, text || ' 0/' || i as prompt, text as original_prompt from benchmark, range(1, 9) t(i)")
def synthesised_batches(spark, sf_dir):
    path = folder(spark, "variants")
    prompts = benchmark_prompts(spark, sf_dir)
    S.synthesise_into(prompts.where("length(prompt) % 2 = 0"), "task", versions_client, path, tasks=2, batch_rows=64)
    S.synthesise_into(prompts, "task", versions_client, path, keep=True, tasks=2, batch_rows=64)
    return J.read_records(spark, path).select("key", "prompt", "original_prompt")


def length_judge(requests: list[list[dict]]) -> list[str | None]:
    """Valid by the length of what stands last in a request; a seventh fails."""
    texts = [r[-1]["content"].rsplit("\n\n", 1)[-1] for r in requests]
    return [None if len(t) % 7 == 0 else json.dumps({"reasoning": "by length", "is_valid": len(t) % 2 == 0}) for t in texts]


@query("judged_batches", f"""select item_id::varchar as key, case when length(text) % 7 = 0 then '{S.FAILED}' else 'by length' end as reasoning, length(text) % 7 <> 0 and length(text) % 2 = 0 as kept from benchmark""")
def judged_batches(spark, sf_dir):
    annotated, valid = folder(spark, "annotated"), folder(spark, "valid")
    S.judge_into(benchmark_prompts(spark, sf_dir), length_judge, annotated, valid, tasks=2, batch_rows=64)
    rows = J.read_records(spark, annotated).select("key", F.col(f"`{S.JUDGEMENT}`.reasoning").alias("reasoning"))
    return rows.join(J.read_records(spark, valid).select("key", F.lit(True).alias("yes")), "key", "left").select("key", "reasoning", F.coalesce("yes", F.lit(False)).alias("kept"))


@query("judge_requests", f"select item_id, md5({sql_text(S.JUDGE)} || chr(10) || chr(10) || '- {IDS[1]} ' || {sql_text(C.DESCRIPTIONS[IDS[1]].splitlines()[0])} || ' {{}}' || chr(10) || chr(10) || text) as request from benchmark")
def judge_requests(spark, sf_dir):
    """The judge's template, to the letter."""
    request = S.judge_request(F.col("prompt"), F.col("instruction_id_list"), F.col("kwargs"))
    return benchmark_prompts(spark, sf_dir).select(F.col("key").cast("long").alias("item_id"), F.md5(request.cast("binary")).alias("request"))


@query("report_fallback", f"{RELIABLE_1} select metric, value from found")
def report_fallback(spark, sf_dir):
    """Without sampling numbers in the prompts, the report's group metrics are those of whole groups."""
    rows = keyed(table(spark, sf_dir, "documents")).select("pos", "key", T().alias("prompt"), F.array(F.lit(IDS[0])).alias("instruction_id_list"), F.col("ok").alias("follow_all_instructions"), F.array("ok").alias("follow_instruction_list"))
    log = M.report(rows, "auto")
    return spark.createDataFrame([(k, float(v)) for k, v in log["reliable_at_k"].items()], "metric string, value double")


@query("prompt_table", "select item_id::varchar as key, text as prompt from benchmark")
def prompt_table(spark, sf_dir):
    """Prompts that are kept as a table come back as they were."""
    path = folder(spark, "table")
    benchmark_prompts(spark, sf_dir).write.parquet(path)
    return J.read_prompt_table(spark, path).select("key", "prompt")


@query(
    "evaluation_run",
    f"""{STRICT}, flags as (select unnest({IDS_SQL}) as instruction_id, unnest(f) as ok from checked)
    select 'prompt' as metric, avg((f[1] and f[2] and f[3])::int)::double as value from checked union all select 'instruction', avg(ok::int)::double from flags
    union all select split_part(instruction_id, ':', 1), avg(ok::int)::double from flags group by 1 union all select instruction_id, avg(ok::int)::double from flags group by 1
    union all select 'details', count(*)::double from checked""",
)
def evaluation_run(spark, sf_dir):
    """From files to the log and the detail, as the command line does it; what the log says, and how many details there are."""
    done = E.run(spark, written_prompts(spark, sf_dir), written_responses(spark, sf_dir), folder(spark, "evaluation"), "model", groups="none")
    log = spark.read.option("multiLine", True).json(done["log"])
    values = [F.struct(F.lit(f"{k}").alias("metric"), F.col(f"{k}_level_accuracy").alias("value")) for k in ("prompt", "instruction")]
    values += [F.struct(F.lit(x).alias("metric"), F.col(f"{tier}.`{x}`").alias("value")) for tier in ("tier0", "tier1") for x in done["report"][tier]]
    count = J.read_records(spark, done["detail"]).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("details").alias("metric"), "value")
    return log.select(F.inline(F.array(*values))).union(count)


@query("loose_eval_failfast", f"{LOOSE} select pos::bigint as pos, f[1] and f[2] and f[3] as follow_all from best where key in (select key from joined where response is not null)")
def loose_eval_failfast(spark, sf_dir):
    """Prompts that have a response; one without would end the run."""
    prompts, responses = conversation_prompts(spark, sf_dir), latest(spark, sf_dir)
    some = prompts.join(responses.select("prompt"), "prompt", "left_semi").select(*prompts.columns)
    return E.evaluate_loose(some, responses, only=IDS).select("pos", F.col("follow_all_instructions").alias("follow_all"))


@query("streamed_evaluation", f"{STRICT} select key, f[1] and f[2] and f[3] as follow_all from checked")
def streamed_evaluation(spark, sf_dir):
    """Prompt files as a stream, until all that are there are evaluated."""
    out = folder(spark, "streamed")
    W_.watch_prompts(spark, written_prompts(spark, sf_dir), latest(spark, sf_dir), out, folder(spark, "progress")).awaitTermination()
    return J.read_records(spark, out).select("key", F.col("follow_all_instructions").alias("follow_all"))


@query("parsed_models", "select distinct source || case when doc_id % 2 = 0 then '-no-think' else '' end as name, source as model, doc_id % 2 = 1 as thinks from documents")
def parsed_models(spark, sf_dir):
    """Names of models, and whether they may think."""
    name = F.concat("source", F.when(ID() % 2 == 0, "-no-think").otherwise(""))
    names = table(spark, sf_dir, "documents").select(name.alias("name")).distinct()
    return names.mapInPandas(lambda batches: (b.assign(model=[S.parse_model(x)[0] for x in b["name"]], thinks=[S.parse_model(x)[1] for x in b["name"]]) for b in batches), "name string, model string, thinks boolean")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
