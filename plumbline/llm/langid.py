"""Language identification by Bayesian fusion of evidence.

Evidence of a page: the likelihood of its visible text under byte-trigram
models, the language its markup declares, and where it comes from. The last is
a prior over languages for its host, smoothed towards that of its domain, which
is smoothed towards that of its address suffix, and that towards the whole
table's; all are grouped aggregates of what the texts alone say. How far a
declaration is to be trusted is such an aggregate too.
"""

from __future__ import annotations

import math
import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Scratch, limit_batches, small_side, spans_of_bytes, text_buffers

#: The models are fitted on at most so many labelled documents, those of least hash.
FIT_ROWS = 4000
BUCKETS_LOG2 = 15
#: Strength of the smoothing towards the level above, in pages.
KAPPA = 8.0
#: A text counts as at most so many independent trigrams.
EVIDENCE = 40.0
#: Of the class without a language, whose trigrams are all alike.
UNKNOWN, UNKNOWN_PRIOR = "und", 0.01
MIN_POSTERIOR = 0.5
SALTS = 16

_HIDDEN = re.compile(r"<(script|style|nav|noscript)\b", re.I)
_CLOSED = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "nav", "noscript")}
_ROOT = re.compile(r"<html\b([^>]*)", re.I)
_DECLARED = re.compile(r"""\blang\s*=\s*["']?([a-z]{2,3})\b""", re.I)
#: Second labels under a country's that are part of the suffix.
SECOND = ("ac", "co", "com", "edu", "go", "gob", "gov", "ne", "net", "nom", "or", "org")


def visible(html: str) -> str:
    """The text of a page outside tags, comments and hidden elements, white space as single spaces.

    One pass: what isn't closed is looked for once. An element or comment that
    isn't closed hides only its tag; "<" without ">" after it is text.
    """
    parts, at, gone = [], 0, set()
    while (k := html.find("<", at)) >= 0:
        parts.append(html[at:k])
        end = -1
        if html.startswith("<!--", k):
            if "" not in gone and (end := html.find("-->", k + 4)) < 0:
                gone.add("")
            end += 3 * (end >= 0)
        elif (m := _HIDDEN.match(html, k)) and (name := m[1].lower()) not in gone:
            if close := _CLOSED[name].search(html, m.end()):
                end = close.end()
            else:
                gone.add(name)
        if end < 0:
            if (end := html.find(">", k)) < 0:
                at = k
                break
            end += 1
        at = end
    parts.append(html[at:])
    return " ".join(unescape(" ".join(parts)).split())


def declared_language(html: str) -> str | None:
    """What the first html tag declares."""
    root = _ROOT.search(html)
    found = root and _DECLARED.search(root[1])
    return found[1].lower() if found else None


def _trigrams(data: np.ndarray) -> np.ndarray:
    x = LOWER[data].astype(np.uint32)
    return ((x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS_LOG2)


def _counted(batches):
    """Trigram counts of each language in a task."""
    counts: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).fill_null("").to_pylist()):
            data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            own = counts.setdefault(lang, np.zeros(1 << BUCKETS_LOG2, np.int64))
            docs[lang] = docs.get(lang, 0) + 1
            if len(data) > 2:
                own += np.bincount(_trigrams(data), minlength=len(own))
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([docs[k] for k in counts], pa.int64()), pa.array([x.tobytes() for x in counts.values()], pa.binary())], ["lang", "docs", "counts"])


class Model:
    """Log probabilities of hashed byte trigrams in each language; the last class is UNKNOWN."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        n = 1 << BUCKETS_LOG2
        self.table = np.full((len(self.langs) + 1, n), -math.log(n), np.float32)
        for k, lang in enumerate(self.langs):
            c = counts[lang] + 0.1
            self.table[k] = np.log(c / c.sum())
        self.langs.append(UNKNOWN)

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """(texts, classes): log likelihood, at the weight of EVIDENCE trigrams at most."""
        out = np.zeros((len(offs) - 1, len(self.langs)))
        for i, j in spans_of_bytes(offs):
            base, end = int(offs[i]), int(offs[j])
            if end - base < 3:
                continue
            at = _trigrams(data[base:end])
            first = np.minimum(offs[i:j] - base, len(at))
            last = np.maximum(np.minimum(offs[i + 1 : j + 1] - base - 2, len(at)), first)
            weight = np.minimum(EVIDENCE / np.maximum(last - first, 1), 1.0)
            for k, row in enumerate(self.table):
                sums = np.concatenate([[0.0], np.cumsum(row[at], dtype=np.float64)])
                out[i:j, k] = (sums[last] - sums[first]) * weight
        return out


def fit(labelled: DataFrame, rows: int = FIT_ROWS) -> Model:
    """From ``labelled(doc_id, lang, text)``; rows of null lang or text aren't labelled."""
    labelled = labelled.where("lang is not null and text is not null and doc_id is not null")
    ids = labelled.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    some = labelled.join(F.broadcast(ids), "doc_id", "left_semi")  # ``rows`` longs at most
    counts: dict[str, np.ndarray] = {}
    for r in some.select("lang", "text").repartition(8).mapInArrow(_counted, "lang string, docs long, counts binary").toLocalIterator():
        counts[r.lang] = counts.get(r.lang, 0) + np.frombuffer(r.counts, np.int64)
    return Model(counts)


def address(url: str | None) -> tuple[str, str, str]:
    """(host, domain, suffix) of a URL, the domain a label under the suffix; empty strings where it has none."""
    host = re.sub(r"^[a-z][a-z0-9+.-]*://", "", (url or "").strip().lower())
    host = re.split(r"[/?#]", host, maxsplit=1)[0].rpartition("@")[2].split(":")[0].strip(".")
    labels = host.split(".") if host else []
    own = 2 if len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in SECOND else 1 if len(labels) > 1 else 0
    return host, ".".join(labels[-own - 1 :]), ".".join(labels[-own:]) if own else ""


def _score_pages(model):
    def run(batches):
        for batch in batches:
            html = batch.column(2).fill_null("").to_pylist()
            declared = [declared_language(x) for x in html]
            texts = pa.array([visible(x) for x in html], pa.string())
            where = [address(u) for u in batch.column(1).to_pylist()]
            yield _scored(model.value, batch.column(0), texts, declared, where)

    return run


def _score_documents(model):
    def run(batches):
        for batch in batches:
            texts, sources = batch.column(2), [x or "" for x in batch.column(1).to_pylist()]
            yield _scored(model.value, batch.column(0), texts, [None] * len(sources), [(x, x, "") for x in sources])

    return run


def _scored(model, ids, texts, declared, where):
    data, offs = text_buffers(texts)
    scores = model.score(data, offs)
    return pa.RecordBatch.from_arrays(
        [ids, *(pa.array([w[k] for w in where], pa.string()) for k in range(3)), pa.array(declared, pa.string()), pa.array(np.diff(offs)), pa.array(list(scores), pa.list_(pa.float64()))],
        ["id", "host", "domain", "suffix", "declared", "n_bytes", "loglik"],
    )


_SCORED = "id long, host string, domain string, suffix string, declared string, n_bytes long, loglik array<double>"


def _smoothed(counts, above):
    """Counts of a group and the distribution above it -> its distribution. SQL."""
    return f"zip_with({counts}, {above}, (own, up) -> (own + {KAPPA} * up) / (aggregate({counts}, 0D, (s, x) -> s + x) + {KAPPA}))"


def fuse(scored: DataFrame, langs: list[str], scratch: Scratch) -> DataFrame:
    """id, lang, posterior, text_lang, declared, host, kept of the rows that a scorer made."""
    n = len(langs)
    names = F.array(*[F.lit(x) for x in langs])
    best = F.expr("cast(array_position(loglik, array_max(loglik)) as int) - 1")
    rows = scratch.keep(scored.withColumn("text_at", F.when(F.col("n_bytes") > 2, best)), "scored")

    def counts(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.array(*[F.sum((F.col("text_at") == k).cast("double")) for k in range(n)]).alias("n"))

    told = rows.where("text_at is not null")
    hosts = scratch.keep(counts(told, "suffix", "domain", "host"), "hosts")

    def gathered(*keys: str) -> DataFrame:
        return hosts.groupBy(*keys).agg(F.array(*[F.sum(F.col("n")[k]) for k in range(n)]).alias("n"))

    whole = gathered().first()  # one row
    whole = np.array(whole["n"] if whole["n"] and whole["n"][0] is not None else [0.0] * n)
    whole = np.append((whole[:-1] + 1) / (whole[:-1].sum() + n - 1) * (1 - UNKNOWN_PRIOR), UNKNOWN_PRIOR) if n > 1 else np.ones(1)
    top = F.array(*[F.lit(float(p)) for p in whole])
    # A few thousand suffixes, one of which may hold most domains.
    suffixes = small_side(scratch.keep(gathered("suffix").withColumn("p", top).select("suffix", F.expr(_smoothed("n", "p")).alias("above")), "suffixes"))
    domains = gathered("suffix", "domain").join(suffixes, "suffix").select("suffix", "domain", F.expr(_smoothed("n", "above")).alias("above"))
    priors = hosts.join(domains, ["suffix", "domain"]).select("suffix", "domain", "host", F.expr(_smoothed("n", "above")).alias("prior"))
    priors = priors.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a host may hold a third of all rows

    # P(declared | language), smoothed towards how often it is declared at all.
    said = told.where("declared is not null")
    claims = counts(said, "declared")
    totals = claims.agg(F.array(*[F.sum(F.col("n")[k]) for k in range(n)]).alias("of")).first()["of"]  # n numbers
    claims = claims.withColumn("of", F.array(*[F.lit(float(x or 0)) for x in totals]))
    claims = claims.withColumn("share", F.expr("(aggregate(n, 0D, (s, x) -> s + x) + 1) / (aggregate(of, 0D, (s, x) -> s + x) + 2)")).select("declared", F.expr(f"zip_with(n, of, (a, b) -> ln((a + {KAPPA} * share) / (b + {KAPPA})))").alias("claim"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))

    out = rows.withColumn("salt", F.pmod(F.xxhash64("id", "n_bytes"), F.lit(SALTS)).cast("int"))
    out = out.join(priors, ["suffix", "domain", "host", "salt"], "left").join(claims, ["declared", "salt"], "left")
    out = out.withColumn("prior", F.coalesce("prior", top)).withColumn("claim", F.coalesce("claim", F.array(*[F.lit(0.0)] * n)))
    out = out.withColumn("score", F.expr("zip_with(zip_with(loglik, claim, (a, b) -> a + b), prior, (a, p) -> a + ln(p))"))
    out = out.withColumn("at", F.expr("cast(array_position(score, array_max(score)) as int) - 1"))
    out = out.withColumn("posterior", F.expr("1 / aggregate(score, 0D, (s, x) -> s + exp(x - array_max(score)))"))
    lang = F.when(F.col("text_at").isNotNull() & (F.col("posterior") >= MIN_POSTERIOR), F.get(names, F.col("at"))).otherwise(F.lit(UNKNOWN))
    return out.select("id", lang.alias("lang"), F.round("posterior", 6).alias("posterior"), F.get(names, F.col("text_at")).alias("text_lang"), "declared", "host", (lang != UNKNOWN).alias("kept"))


def _model(labelled: DataFrame):
    limit_batches(labelled.sparkSession)
    model = fit(labelled)
    return model, labelled.sparkSession.sparkContext.broadcast(model)  # a table of classes x 2**BUCKETS_LOG2


def identify_pages(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """page_id, lang, posterior, text_lang, declared, host, kept of each page.

    kept is false, and lang ``und``, where the visible text has under three
    bytes, the class without a language wins, or no language reaches
    MIN_POSTERIOR. Null html has no text, a null url an empty host; repeated
    rows count each; ties go to the first language by name. An empty table
    gives no rows. Other columns are ignored.
    """
    model, shared = _model(labelled)
    rows = pages.select(F.col("page_id").cast("long").alias("id"), F.col("url").cast("string"), F.col("html").cast("string"))
    return fuse(rows.mapInArrow(_score_pages(shared), _SCORED), model.langs, Scratch(pages.sparkSession, "langid")).withColumnRenamed("id", "page_id")


def identify_documents(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """As identify_pages for doc_id; the source is the host, and nothing is declared: ``lang`` is what models are fitted on, so it is no evidence."""
    model, shared = _model(labelled)
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), source.alias("source"), F.col("text").cast("string").alias("text"))
    return fuse(rows.mapInArrow(_score_documents(shared), _SCORED), model.langs, Scratch(docs.sparkSession, "langid")).withColumnRenamed("id", "doc_id")


def keep_identified(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is identified, with their own columns.

    Rows of one doc_id (null is one) stand or fall together: they go only if
    none of them is identified. Null, empty and very short texts aren't. An
    empty table gives no rows. Column names may be any.
    """
    found = identify_documents(docs, labelled)
    gone = found.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select(F.col("doc_id").alias("__gone"))
    gone = small_side(Scratch(docs.sparkSession, "identified").keep(gone, "gone"))
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return inner.join(gone, F.col(f"c{docs.columns.index('doc_id')}").eqNullSafe(F.col("__gone")), "left_anti").toDF(*docs.columns)
