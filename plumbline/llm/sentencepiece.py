"""SentencePiece encoding and decoding by weighted finite-state transducers.

A model file is compiled into three machines. The normaliser is a sequential
transducer: a trie of the model's rewriting rules, the longest of which is
applied at each place, and states for white space. The pieces are a trie whose
arcs read letters; where a piece ends, an arc leads back to the start and writes
its id at its weight. Byte fallback is an arc for each character without a piece,
which writes the ids of its bytes. An input is composed with them into a lattice
of places, whose shortest path in the tropical semiring is the encoding.

In a unigram model an arc weighs the negative score. In a BPE model merges, not
scores, choose; but a sequence is the merges' result just if each pair of
neighbouring pieces is the result for the pair's own text. So the lattice's
states remember the last piece, an arc between a pair that isn't costs infinity,
others nothing, and one path is left. Words are composed apart where no piece
spans them, and those that recur are looked up.
"""

from __future__ import annotations

import contextlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import limit_batches
from .tokens import PieceCache, text_runs, tokenizer_path

MARK = "▁"
_MODELS: dict[str, "Transducer"] = {}


def _fields(data: bytes):
    """(number, value) of a protocol-buffer message's fields."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + size]
            at += size


def rewriting_rules(blob: bytes) -> dict[str, str]:
    """The rules of a compiled character map: a double array of their UTF-8 keys, then what each becomes."""
    size = int.from_bytes(blob[:4], "little")
    units, texts = np.frombuffer(blob, "<u4", size // 4, 4).tolist(), blob[4 + size :]
    out: dict[str, str] = {}

    def base(at: int) -> int:
        return at ^ (units[at] >> 10 << ((units[at] >> 9 & 1) << 3))

    stack = [(base(0), b"")]
    while stack:
        at, key = stack.pop()
        for byte in range(1, 256):
            to = at ^ byte
            if to < len(units) and units[to] & 0x800000FF == byte:
                own = base(to)
                if units[to] >> 8 & 1:
                    begin = units[own] & 0x7FFFFFFF
                    with contextlib.suppress(UnicodeDecodeError):  # keys are whole characters
                        out[(key + bytes([byte])).decode()] = texts[begin : texts.index(b"\0", begin)].decode()
                stack.append((own, key + bytes([byte])))
    return out


class Trie:
    """States and arcs of a set of strings. arcs[state << 21 | letter] is the next state, ends[state] what the string that ends there stands for, or None."""

    def __init__(self, entries: dict):
        self.arcs: dict[int, int] = {}
        self.ends: list = [None]
        for text, value in entries.items():
            state = 0
            for letter in text:
                to = self.arcs.setdefault(state << 21 | ord(letter), len(self.ends))
                if to == len(self.ends):
                    self.ends.append(None)
                state = to
            self.ends[state] = value


class Normaliser:
    """Sequential transducer of a text: rewriting rules, user symbols as they are, white space to its mark."""

    def __init__(self, rules: dict[str, str], symbols: list[str], dummy_prefix: bool, squeeze: bool):
        self.trie = Trie(rules | {s: s for s in symbols}) if rules else None
        self.dummy_prefix, self.squeeze = dummy_prefix, squeeze

    def rewritten(self, text: str):
        """What each step of the input becomes: the longest rule there, else the character itself."""
        arcs, ends, at, n = self.trie.arcs, self.trie.ends, 0, len(text)
        while at < n:
            state, end, out = 0, at + 1, text[at]
            for k in range(at, n):
                state = arcs.get(state << 21 | ord(text[k]), -1)
                if state < 0:
                    break
                if ends[state] is not None:
                    end, out = k + 1, ends[state]
            yield out
            at = end

    def __call__(self, text: str) -> str:
        """Steps that are spaces at the beginning count as no input. Squeezing drops spaces at a step's beginning after a space, and marks at the end."""
        steps = list(self.rewritten(text)) if self.trie else [text]
        if self.squeeze:
            if not self.trie:
                steps = [" ".join(x for x in text.split(" ") if x)]
            first = next((k for k, x in enumerate(steps) if x != " "), len(steps))
            out, spaced = [], True
            for step in steps[first:]:
                step = step.lstrip(" ") if spaced else step
                if step:
                    out.append(step)
                    spaced = step[-1] == " "
        else:
            first, out = 0, steps
        if first == len(steps) or not text:
            return ""
        text = (" " * self.dummy_prefix + "".join(out)).replace(" ", MARK)
        return text.rstrip(MARK) if self.squeeze else text


class Transducer(PieceCache):
    """A compiled model."""

    NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
    PAIRS = 400_000  # pairs held

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer: dict[int, object] = {}
        normal: dict[int, object] = {}
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode())
                self.scores.append(float(np.frombuffer(own[2], "<f4")[0]) if 2 in own else 0.0)
                self.kinds.append(own.get(3, self.NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normal = dict(_fields(value))
        self.bpe = trainer.get(3, 1) == 2
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == self.UNKNOWN), 0)
        rules = rewriting_rules(normal[2]) if normal.get(2) else {}
        self.dummy_prefix, self.squeeze = bool(normal.get(3, 1)), bool(normal.get(4, 1))
        self.normalise = Normaliser(rules, [p for p, k in zip(self.pieces, self.kinds) if k == self.USER], self.dummy_prefix, self.squeeze)
        self.rewrites = bool(rules)

        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (self.NORMAL, self.USER)}
        self.machine = Trie(self.ids)
        plain = [s for s, k in zip(self.scores, self.kinds) if k == self.NORMAL]
        most = max(plain, default=0.0)
        self.weights = [0.1 - len(p) * most if k == self.USER else -s for p, s, k in zip(self.pieces, self.scores, self.kinds)]
        self.fallback_weight = 10.0 - min(plain, default=0.0)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == self.BYTE}
        self.cuts = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.pairs: dict[tuple[str, str], bool] = {}
        raw = [bytes([int(p[3:5], 16)]) if k == self.BYTE else b"" if k == self.CONTROL else " ⁇ ".encode() if i == self.unknown else p.replace(MARK, " ").encode() for i, (p, k) in enumerate(zip(self.pieces, self.kinds))]
        self.raw, self.raw_length = np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw])
        self.raw_start = np.cumsum(self.raw_length) - self.raw_length
        super().__init__()

    # --- byte fallback

    def fallback(self, letter: str) -> list[int] | None:
        """What the fallback's arc for a character writes; None where the model has no bytes."""
        return [self.byte_ids[b] for b in letter.encode("utf-8", "surrogatepass")] if self.byte_ids else None

    # --- composition

    def arcs(self, text: str, at: int):
        """The lattice's arcs from a place: (place, id), and the fallback's with id -1 where no piece is the next character alone."""
        arcs, ends, state, alone = self.machine.arcs, self.machine.ends, 0, False
        for k in range(at, len(text)):
            state = arcs.get(state << 21 | ord(text[k]), -1)
            if state < 0:
                break
            if (own := ends[state]) is not None:
                alone |= k == at
                yield k + 1, own
        if not alone:
            yield at + 1, -1

    def shortest(self, text: str) -> list[tuple[int, int, int]]:
        """The path of least weight through the lattice, as (from, to, id)."""
        n = len(text)
        back: list[tuple[int, int] | None] = [None] * (n + 1)
        if not self.bpe:
            cost = [0.0] + [math.inf] * n
            for i in range(n):
                for j, own in self.arcs(text, i):
                    weight = cost[i] + (self.weights[own] if own >= 0 else self.fallback_weight)
                    if weight < cost[j]:
                        cost[j], back[j] = weight, (i, own)
        else:
            # The path of finite weight to each place, if there is one; its last piece is the state.
            pairs, last = self.pairs, [""] + [None] * n
            for i in range(n):
                left = last[i]
                if left is None:
                    continue
                for j, own in self.arcs(text, i):
                    if last[j] is None:
                        piece = text[i:j]
                        fits = pairs.get((left, piece))
                        if fits if fits is not None else self._follows(left, piece):
                            last[j], back[j] = piece, (i, own)
            if last[n] is None:  # pieces that the model's own merges don't reach: weights of pairs don't tell its path
                out, at = [], 0
                for piece in self._merged(text):
                    out.append((at, at := at + len(piece), self.ids.get(piece, -1)))
                return out
        out, j = [], n
        while j:
            i, own = back[j]
            out.append((i, j, own))
            j = i
        return out[::-1]

    def _merged(self, text: str) -> list[str]:
        """What the merges make of a text: the best adjacent pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _follows(self, left: str, right: str) -> bool:
        """Whether an arc between two pieces has a finite weight."""
        key = left, right
        if len(self.pairs) > self.PAIRS:
            self.pairs.clear()
        got = self.pairs[key] = self._merged(left + right) == ([left, right] if left else [right])
        return got

    def _word(self, word: str) -> np.ndarray:
        """What the shortest path writes; unknown characters in a row are one."""
        out: list[int] = []
        for i, j, own in self.shortest(word):
            if own >= 0:
                out.append(own)
            elif (written := self.fallback(word[i:j])) is not None:
                out += written
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return np.array(out, np.uint32)

    def encode_one(self, text: str) -> np.ndarray:
        text = self.normalise(text)
        words = self._split(text) if self.cuts else [text] if text else []
        return np.concatenate([np.zeros(0, np.uint32), *map(self._word, words)])

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [self.encode_one(x) for x in texts]

    def split(self, text: str) -> list[str] | None:
        """Words after single spaces, where each is encoded as a text of its own is."""
        if not (self.cuts and self.dummy_prefix) or self.rewrites or MARK in text:
            return None
        own = text.split(" ")
        return None if "" in own else own

    def shown(self, key: str) -> str:
        return key

    def _split(self, text: str) -> list[str]:
        """Before each run of marks: no piece spans that place."""
        parts = text.split(MARK)
        out = [parts[0]] if parts[0] else []
        marks = ""
        for p in parts[1:]:
            marks += MARK
            if p:
                out.append(marks + p)
                marks = ""
        if marks:
            out.append(marks)
        return out

    # --- the inverse

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 of each text: pieces and bytes joined, marks to spaces, the dummy prefix dropped."""
        lengths = self.raw_length[ids]
        after = np.cumsum(lengths)
        data = self.raw[np.repeat(self.raw_start[ids] - (after - lengths), lengths) + np.arange(after[-1] if len(after) else 0)].tobytes()
        ends = np.concatenate([[0], after])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [data[i + (self.dummy_prefix and data[i : i + 1] == b" ") * (i < j) : j] for i, j in zip(ends, ends[1:])]


def transducer(path: str) -> Transducer:
    if path not in _MODELS:
        with open(path, "rb") as f:
            _MODELS[path] = Transducer(f.read())
    return _MODELS[path]


def _coded(path: str, with_ids: bool):
    def run(batches):
        machine = transducer(path)
        for batch in batches:
            sizes, sums, same, blobs = [], [], [], []
            texts = batch.column(1).fill_null("").to_pylist()
            for i, j in text_runs(texts):
                ids, counts = machine.encode(texts[i:j])
                plain = not (machine.squeeze or machine.rewrites)  # then the normalised text is the text, but for marks
                for text, back in zip(texts[i:j], machine.decode(ids, counts)):
                    same.append(back == (text if plain else machine.normalise(text)[int(machine.dummy_prefix) :]).replace(MARK, " ").encode("utf-8", "surrogatepass"))
                for own in np.split(ids, np.cumsum(counts)[:-1]):
                    blob = own.astype("<u4").tobytes()
                    sizes.append(len(own))
                    sums.append(zlib.crc32(blob))
                    blobs.append(blob if with_ids else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(same, pa.bool_()), pa.array(blobs, pa.binary())], ["doc_id", "n_pieces", "ids_crc32", "round_trip", "ids"])

    return run


def encode(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of little-endian unsigned 32-bit ids), round_trip (and ids, packed) of each row.

    round_trip tells whether decoding gives the normalised text back. Null and
    empty texts have no pieces. Repeated rows are coded each, nulls elsewhere
    don't matter, an empty table gives no rows, other columns are ignored.
    """
    limit_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_coded(path or tokenizer_path("piece_bpe_32k.model"), with_ids), "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean, ids binary")
    return out if with_ids else out.drop("ids")


def _decoded(path: str):
    def run(batches):
        machine = transducer(path)
        for batch in batches:
            blobs = [b or b"" for b in batch.column(1).to_pylist()]
            counts = np.array([len(b) // 4 for b in blobs], np.int64)
            ids = np.frombuffer(b"".join(b[: 4 * n] for b, n in zip(blobs, counts.tolist())), "<u4").astype(np.int64)
            if len(ids) and ids.max() >= len(machine.pieces):
                raise ValueError("an id that the model doesn't have")
            texts = [x.decode("utf-8", "replace") for x in machine.decode(ids, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of each row of ``coded(doc_id, ids)``, ids as ``encode`` packs them.

    It is the inverse machine: pieces and bytes are joined, marks become spaces,
    the dummy prefix goes. Bytes that aren't UTF-8 become U+FFFD. Null and empty
    ids give the empty text; an id beyond the model is an error. Repeated rows are decoded
    each, an empty table gives no rows, other columns are ignored.
    """
    limit_batches(coded.sparkSession)
    rows = coded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("binary").alias("ids"))
    return rows.mapInArrow(_decoded(path or tokenizer_path("piece_bpe_32k.model")), "doc_id long, text string")
