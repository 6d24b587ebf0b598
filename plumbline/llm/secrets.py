"""Secret scan with corpus-wide ownership frequency.

Base patterns find spans in every whole text. Further candidates are long mixed
tokens. The hash of each candidate's value is counted over the corpus by
distinct owners (the source) and repositories (the source with the language),
each distinct text for one of each: values that many of both hold are copied
examples, the others look live.
The method adds the candidates that look live, and gives each base span its
verdict.
"""

from __future__ import annotations

import math
import re
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from .common import Scratch, limit_batches

KINDS = ("assign", "access", "hex", "token")
#: A value is a widely copied example if this share of all owners and of all repositories hold it, or so many; two at the least.
COPIED_SHARE, COPIED_MOST = 0.25, 10
#: Hashes are spread over so many parts when verdicts are joined back.
SALTS = 16

# Fixed patterns.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # the same as runs of 24 or more, since runs are taken whole
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's number, end, value), leftmost and non-overlapping within a kind."""
    found = []
    low = text.encode("utf-8", "surrogatepass").lower()  # bytes: only A-Z change
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"akia" in low:
        found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found)


def token_spans(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Long tokens of digits and both cases that no base span overlaps. ``taken`` is in order of its starts, and so are tokens."""
    found, k, end = [], 0, -1  # end: the furthest of the base spans that begin before the token's end
    for m in _TOKEN.finditer(text):
        while k < len(taken) and taken[k][0] < m.end():
            end = max(end, taken[k][2])
            k += 1
        x = m[0]
        if end <= m.start() and re.search("[0-9]", x) and re.search("[a-z]", x) and re.search("[A-Z]", x) and len(set(x)) >= 10:
            found.append((m.start(), 3, m.end(), x))
    return found


def _hash(value: str) -> int:
    return int.from_bytes(blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, *_ in spans)


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("hash", pa.int64())]))
_COLUMNS = "n_assign long, n_access long, n_hex long, base_sha256 string, copy long, found array<struct<start:long,kind:int,end:long,hash:long>>"


def _copy(text: str) -> int | None:
    """Hash of the text's words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, the same for its copies; None under five words, where a text is little more than the value."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return int.from_bytes(blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True) if len(words) >= 5 else None


def _scan(batches):
    """Adds counts, digest, the text's hash as a copy and spans to the other columns; the text is the last of these."""
    for batch in batches:
        counts, digests, copies, spans = [[], [], []], [], [], []
        for text in batch.column(batch.num_columns - 1).fill_null("").to_pylist():
            base = base_spans(text)
            for k in range(3):
                counts[k].append(sum(x[1] == k for x in base))
            digests.append(sha256(written(base).encode()).hexdigest())
            spans.append([{"start": s, "kind": k, "end": e, "hash": _hash(v)} for s, k, e, v in sorted(base + token_spans(text, base))])
            copies.append(_copy(text) if spans[-1] else None)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(copies, pa.int64()), pa.array(spans, _SPAN)],
            [*batch.schema.names[:-1], "n_assign", "n_access", "n_hex", "base_sha256", "copy", "found"],
        )


def ownership(spans: DataFrame) -> DataFrame:
    """hash, owners, repositories of ``spans(hash, copy, owner, repository)``; a null owner counts as one.

    Copies of one text count for the least of their owners alone; rows of null
    ``copy`` count for their own.
    """
    spans = spans.select("hash", "copy", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repository", F.lit("")).alias("repository"))
    least = spans.where("copy is not null").groupBy("hash", "copy").agg(F.min(F.struct("owner", "repository")).alias("o")).select("hash", "o.owner", "o.repository")
    spans = least.union(spans.where("copy is null").select("hash", "owner", "repository")).distinct()
    return spans.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n")).groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))


def many(total: int) -> int:
    """How many of ``total`` owners or repositories make a value a copied one."""
    return min(COPIED_MOST, max(2, math.ceil(COPIED_SHARE * total)))


def _owners(docs: DataFrame) -> tuple:
    """Columns of a row's owner and repository."""
    owner = docs["source"].cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    return owner, F.concat_ws("/", owner, docs["lang"].cast("string") if "lang" in docs.columns else F.lit(""))


def verdicts(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """hash, live, salt of the candidates in ``rows(uid, copy, owner, repository, found)``; ``owners(owner, repository)`` has all rows of the corpus."""
    spans = rows.select("copy", "owner", "repository", F.explode("found").alias("s")).select("copy", "owner", "repository", "s.hash")
    everyone = owners.select(F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repository", F.lit("")).alias("repository")).distinct()
    everyone = everyone.groupBy("owner").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    copied = (F.col("owners") >= many(everyone[0])) & (F.col("repositories") >= many(everyone[1]))
    return ownership(spans).select("hash", (~copied).alias("live"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))


def judged_spans(rows: DataFrame, told: DataFrame) -> DataFrame:
    """uid and judged: (start, kind, end, live) of a row's candidates in order. What is gathered for a uid comes from its one text."""
    spans = rows.select("uid", F.explode("found").alias("s")).select("uid", "s.*")
    spans = spans.withColumn("salt", F.pmod(F.xxhash64("uid", "start"), F.lit(SALTS)).cast("int")).join(told, ["hash", "salt"])
    return spans.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live"))).alias("judged"))


def scan(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, base counts and digest, and judged: (start, kind, end, live) of all candidates in order."""
    limit_batches(docs.sparkSession)
    owner, repository = _owners(docs)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), owner.alias("owner"), repository.alias("repository"), F.col("text").cast("string").alias("text"))
    rows = scratch.keep(rows.mapInArrow(_scan, f"uid long, doc_id long, owner string, repository string, {_COLUMNS}"), "scanned")
    some = rows.where(F.size("found") > 0)
    judged = judged_spans(some, verdicts(some, rows))
    return rows.drop("found", "copy", "owner", "repository").join(judged, "uid", "left").withColumn("judged", F.coalesce("judged", F.expr("cast(array() as array<struct<start:long,kind:int,end:long,live:boolean>>)")))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, live_spans of each row.

    spans has all base spans and the long tokens that look live, as
    kind:start:end in code points (end exclusive), by start, then in the order
    of KINDS; live_spans those whose value isn't a widely copied example, by
    owners and repositories over distinct texts (``ownership``, ``many``). Null
    and empty texts have none. Null owners are one owner. Spans of the same place and kind
    occur once; repeated rows are scanned each. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    found = scan(docs, scratch)
    names = F.array(*[F.lit(k) for k in KINDS])

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
        listed(F.filter("judged", lambda s: (s["kind"] < 3) | s["live"])).alias("spans"),
        listed(F.filter("judged", lambda s: s["live"])).alias("live_spans"),
    )


def _candidates(having: bool):
    """Rows with candidates, these added, or rows without any. The text is the last column."""

    def run(batches):
        for batch in batches:
            spans, copies = [], []
            for text in batch.column(batch.num_columns - 1).fill_null("").to_pylist():
                base = base_spans(text)
                own = sorted(base + token_spans(text, base))
                spans.append([{"start": s, "kind": k, "end": e, "hash": _hash(v)} for s, k, e, v in own])
                copies.append(_copy(text) if own and having else None)
            keep = pa.array([k for k, x in enumerate(spans) if bool(x) == having], pa.int64())
            columns = [*batch.columns, pa.array(copies, pa.int64()), pa.array(spans, _SPAN)] if having else batch.columns[:-1]
            names = [*batch.schema.names, "copy", "found"] if having else batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays(columns, names).take(keep)

    return run


def mask_live(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with the live-looking spans of its texts replaced by ``mask``, and n_chars to match.

    All rows stay. Overlapping spans are masked as one. Owners are counted over
    all rows; each row is judged by its own text's values, whatever other rows
    have its doc_id. Rows without candidates don't move. Null and empty texts
    stay as they are, and null n_chars too; repeated rows are masked each; an
    empty table gives no rows. Column names may be any.
    """
    spark, names = docs.sparkSession, docs.columns
    limit_batches(spark)
    scratch = Scratch(spark, "masking")
    owner, repository = _owners(docs)
    inner = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)], owner.alias("owner"), repository.alias("repository"), docs["text"].cast("string").alias("text"))
    fields = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)] + [T.StructField(c, T.StringType()) for c in ("owner", "repository")])
    extra = T.StructType([T.StructField("text", T.StringType()), T.StructField("copy", T.LongType()), T.StructField("found", from_arrow_type(_SPAN))])
    rest = inner.mapInArrow(_candidates(False), fields)
    some = scratch.keep(inner.mapInArrow(_candidates(True), T.StructType(fields.fields + extra.fields)).withColumn("uid", F.monotonically_increasing_id()), "some")
    judged = judged_spans(some, verdicts(some, inner)).select("uid", F.filter("judged", lambda s: s["live"]).alias("live")).where(F.size("live") > 0)

    @F.pandas_udf("string")
    def masked(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, spans):
            cuts, end = [], -1
            for s, e in sorted((x["start"], x["end"]) for x in own):
                if s <= end:
                    cuts[-1][1] = end = max(end, e)
                else:
                    cuts.append([s, e])
                    end = e
            parts, at = [], 0
            for s, e in cuts:
                parts += [text[at:s], mask]
                at = e
            out.append("".join(parts) + text[at:])
        return pd.Series(out, dtype=object)

    hit = some.join(judged, "uid").withColumn("text", masked("text", "live"))
    whole = {"text": F.col("text").cast(docs.schema["text"].dataType)}
    if "n_chars" in names:
        own = F.col(f"c{names.index('n_chars')}")
        whole["n_chars"] = F.when(own.isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))
    out = hit.select(*[whole.get(c, F.col(f"c{i}")).alias(f"c{i}") for i, c in enumerate(names)])
    out = out.union(some.join(judged, "uid", "left_anti").select(*out.columns)).union(rest.select(*out.columns))
    return out.toDF(*names)
