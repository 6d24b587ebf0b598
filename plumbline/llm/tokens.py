"""Token ids of many texts, by a public tokenizer file, with a cache of pieces.

A piece is what lies between single spaces; its ids don't depend on its
neighbours, so pieces that recur are looked up. Texts with other white space
than single spaces and line feeds between words, or that hold the string of an
added token, go to the library whole.
"""

from __future__ import annotations

import itertools
import os

import numpy as np

_ENCODERS: dict[tuple[str, str], "Encoder"] = {}


def tokenizer_path(name: str) -> str:
    """The file in PLUMBLINE_TOKENIZERS, else in the installed vocabulary package."""
    if folder := os.environ.get("PLUMBLINE_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str, kind: str, most: int = 1_000_000) -> "Encoder":
    """One per Python worker, kept between tasks; ``most`` pieces are held."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = Encoder(path, kind)
    _ENCODERS[path, kind].MOST = most
    return _ENCODERS[path, kind]


class PieceCache:
    """Ids of texts from those of their pieces; the latter are held, up to MOST, then those that came up again, most used first."""

    MOST = 1_000_000

    def __init__(self):
        self.clear()

    def whole(self, texts: list[str]) -> list:
        """Ids of each text or piece."""
        raise NotImplementedError

    def split(self, text: str) -> list[str] | None:
        """Keys of a text's pieces, None where it must be encoded whole."""
        raise NotImplementedError

    def shown(self, key: str) -> str:
        """What a key stands for."""
        raise NotImplementedError

    def clear(self) -> None:
        self.cache: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.lengths, self.uses = (np.zeros(1 << 14, np.int64) for _ in range(3))

    def shrink(self) -> None:
        names, starts, lengths, flat = list(self.cache), self.starts, self.lengths, self.flat
        uses = self.uses[: len(names)]
        kept = np.flatnonzero(uses > 1)
        if len(kept) > self.MOST // 2:
            kept = np.sort(kept[np.argpartition(-uses[kept], self.MOST // 2)[: self.MOST // 2]])
        self.clear()
        size = 1 << max(14, int(len(kept)).bit_length())
        after = np.cumsum(lengths[kept])
        self.flat = flat[np.repeat(starts[kept] - (after - lengths[kept]), lengths[kept]) + np.arange(after[-1] if len(after) else 0)]
        self.used = len(self.flat)
        self.starts, self.lengths, self.uses = (np.zeros(size, np.int64) for _ in range(3))
        self.starts[: len(kept)], self.lengths[: len(kept)] = after - lengths[kept], lengths[kept]
        self.cache = dict(zip(map(names.__getitem__, kept.tolist()), range(len(kept))))

    def bulk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pieces, one after the other, and how many each has."""
        found = self.whole(texts)
        return np.concatenate([np.zeros(0, np.uint32), *found]).astype(np.uint32), np.array([len(x) for x in found], np.int64)

    def _add(self, keys: list[str]) -> None:
        ids, lengths = self.bulk([self.shown(k) for k in keys])
        k, end = len(self.cache), self.used + len(ids)
        while k + len(keys) > len(self.starts):
            self.starts, self.lengths, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths, self.uses))
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint32)])
        self.flat[self.used : end] = ids
        self.starts[k : k + len(keys)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[k : k + len(keys)] = lengths
        self.used = end
        self.cache.update(zip(keys, range(k, k + len(keys))))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each text."""
        pieces: list[str] = []
        ends = np.zeros(len(texts) + 1, np.int64)
        odd: dict[int, list[int]] = {}
        for k, text in enumerate(texts):
            if (own := self.split(text)) is not None:
                pieces += own
            else:
                odd[k] = []
            ends[k + 1] = len(pieces)
        if odd:
            odd = dict(zip(odd, self.whole([texts[k] for k in odd])))
        if len(self.cache) > self.MOST:
            self.shrink()
        at = np.fromiter(map(self.cache.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))
        if len(gone := np.flatnonzero(at < 0)):
            missed = list(map(pieces.__getitem__, gone.tolist()))
            self._add(list(dict.fromkeys(missed)))
            at[gone] = np.fromiter(map(self.cache.__getitem__, missed), np.int64, len(missed))
        self.uses += np.bincount(at, minlength=len(self.uses))
        lengths = self.lengths[at]
        after = np.cumsum(lengths)
        ids = self.flat[np.repeat(self.starts[at] - (after - lengths), lengths) + np.arange(after[-1] if len(after) else 0)]
        sums = np.concatenate([[0], after])[ends]
        counts = np.diff(sums)
        if odd:
            parts, last = [], 0
            for k, own in odd.items():
                parts += [ids[last : sums[k]], np.array(own, np.uint32)]
                last, counts[k] = sums[k], len(own)
            ids = np.concatenate([*parts, ids[last:]])
        return ids, counts


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a letter: printable ones as themselves, others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


BYTE_LETTERS = _byte_letters()


class Encoder(PieceCache):
    """kind: "byte" where a word's space belongs to it, "word" where white space is dropped."""

    def __init__(self, path: str, kind: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if kind not in ("byte", "word"):
            raise ValueError(f"unknown kind {kind!r}")
        self.library, self.kind = Tokenizer.from_file(path), kind
        # Strings of added tokens are these tokens wherever they stand, so texts that hold one go to the library whole.
        added = self.library.get_added_tokens_decoder()
        self.added = [t.content for t in added.values()]
        self.plain = not any(t.normalized for t in added.values())
        # Pieces are encoded many at a time, parted by a special token, which no normaliser or merge crosses.
        self.mark, self.mark_id = next(((t.content, i) for i, t in added.items() if t.special), (None, -1))
        self.merge = self.library.model.tokenize
        self.stops = {c: [t.id for t in self.merge(c)] for c in ",."}
        self.line = [t.id for t in self.merge(BYTE_LETTERS[10])] if kind == "byte" else []
        super().__init__()

    def bulk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Latin words, with a comma or point after them or without, go to the merges directly; others through the library's whole way."""
        merge, stops, byte = self.merge, self.stops, self.kind == "byte"
        found: list[list[int] | None] = []
        for text in texts:
            first = text[:1]
            body = text[1:] if first in " \n" else text
            stop = stops.get(body[-1:], ())
            if stop:
                body = body[:-1]
            if not byte:
                body = body.lower()
            if not body.isalpha():
                found.append(None)
                continue
            if not body.isascii():
                if max(body) >= "\u0250":
                    found.append(None)
                    continue
                body = body.encode().decode("latin-1").translate(BYTE_LETTERS)
            ids = [t.id for t in merge("\u0120" + body if byte and first == " " else body)]
            found.append([*(self.line if first == "\n" else ()), *ids, *stop])
        left = [k for k, x in enumerate(found) if x is None]
        ids, lengths = self._parted([texts[k] for k in left]) if left else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        for k, own in zip(left, np.split(ids, np.cumsum(lengths)[:-1])):
            found[k] = own.tolist()
        flat = list(itertools.chain.from_iterable(found))
        return np.array(flat, np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _parted(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = self.mark and self.mark.join(texts)
        if not self.mark or sum(map(joined.count, self.added)) != len(texts) - 1:
            return super().bulk(texts)
        ids = np.array(self.library.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.flatnonzero(ids == self.mark_id)
        return ids[ids != self.mark_id], np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def split(self, text: str) -> list[str] | None:
        if not self.plain or any(x in text for x in self.added):
            return None
        own = text.replace("\n", " \n").split(" ")
        if len(text.split()) == len(own) and "\n" not in (text[0], text[-1]) and "\0" not in text and "\n\n" not in text:
            own[0] = "\0" + own[0]
            return own
        return None

    def shown(self, key: str) -> str:
        # "\0" marks a text's first piece, "\n" a line's; others follow a space.
        return key[1:] if key[:1] == "\0" else key if key[:1] == "\n" or self.kind == "word" else " " + key


def text_runs(texts: list[str], most: int = 1 << 20):
    """Ranges of texts that hold about ``most`` characters together, a text at least."""
    i = size = 0
    for j, text in enumerate(texts):
        if j > i and size + len(text) > most:
            yield i, j
            i, size = j, 0
        size += len(text)
    if i < len(texts):
        yield i, len(texts)
