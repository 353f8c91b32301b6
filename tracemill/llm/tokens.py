"""Tokenizer files of the tokenizers library, with a memo of pieces already encoded.

Texts are cut only where the tokenizer's own pre-tokenizer always cuts, each distinct piece is encoded
by the library once, and its ids are gathered from a pool. A file whose pre-tokenizer is of
another kind is encoded text by text.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import regex

#: Unicode White_Space, fixed values of the standard.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LED = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
#: The byte-level pre-tokenizer's pattern, a fixed value.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Character by which a byte-level model names a byte: printable ones themselves, the others from 256 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_SIGNS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(_PRINTED))}
_SPACE = chr(_BYTE_SIGNS[32])


class _Signs(dict):
    """character -> the characters that name its bytes"""

    def __missing__(self, c: str) -> str:
        signs = self[c] = c.encode().decode("latin-1").translate(_BYTE_SIGNS)
        return signs


_SIGNS = _Signs()
#: Beyond these scripts, character classes and cases are left to the library.
_BEYOND = re.compile("[^\x20-\x7e\xa1-\u024f]").search
#: Pieces the memo holds before it starts again.
MEMO_PIECES = 600_000
#: And ids, so that very long pieces do not fill it.
MEMO_IDS = 8_000_000


class _Codes(dict):
    """piece -> code; an unknown piece gets the next code and waits for its ids."""

    def __init__(self) -> None:
        super().__init__()
        self.waiting: list = []

    def __missing__(self, piece):
        code = self[piece] = len(self)
        self.waiting.append(piece)
        return code


class MemoTokenizer:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            self.split = self._splitter(json.load(f))
        self._renew()

    def _splitter(self, spec: dict):
        """How texts may be cut without a change to any id, or None."""
        self.inner, self.lower = None, False
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in spec.get("added_tokens", []))
        if not plain or spec["model"].get("dropout"):
            return None
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec.get("added_tokens", [])) or "(?!)").search
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            self.inner = regex.compile(_BYTE_LEVEL)
            return _LED.findall
        parts = pre.get("pretokenizers", [])
        kinds = [n.get("type") for n in (norm or {}).get("normalizers", [])]
        if len(parts) == 2 and parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and parts[0].get("invert") and r"[^\s" in parts[0]["pattern"].get("Regex", "") and parts[1].get("type") == "ByteLevel" and not parts[1].get("use_regex") and not parts[1].get("add_prefix_space") and kinds == ["NFC", "Replace", "Lowercase"]:
            self.inner, self.lower = regex.compile(parts[0]["pattern"]["Regex"]), True
            return lambda text: text.encode("utf-8", "surrogatepass").split()
        return None

    def _renew(self) -> None:
        self.codes = _Codes()
        self.known: dict = {}
        self.pool = np.zeros(1 << 20, np.uint32)
        self.starts, self.sizes, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0

    def _words(self, piece: str):
        """What the pre-tokenizer makes of a piece; where case is folded, letters alone are one word."""
        if self.lower:
            piece = piece.lower() if piece.isascii() else unicodedata.normalize("NFC", piece).lower()
            return (piece,) if piece.isalpha() else self.inner.findall(piece)
        return self.inner.findall(piece)

    def _piece_ids(self, pieces: list[str]) -> list[list[int]]:
        """As _library, for pieces: those of plain letters go to the model alone, word by word."""
        out: list = [None] * len(pieces)
        rest = []
        known, tokenize, special, words_of, lower = self.known, self.library.model.tokenize, self.special, self._words, self.lower
        marked = special("\0".join(pieces)) is not None  # hardly ever
        for k, piece in enumerate(pieces):
            if not piece or _BEYOND(piece) or (marked and special(piece)):
                rest.append(k)
                continue
            if not lower:
                led = piece[0] == " "
                body = piece[1:] if led else piece
                if body.isalpha():  # a word that no other piece has: nothing to look up or keep
                    signs = body if body.isascii() else "".join(map(_SIGNS.__getitem__, body))
                    out[k] = [t.id for t in tokenize(_SPACE + signs if led else signs)]
                    continue
            words = words_of(piece)
            ids: list[int] = []
            for word in words:
                got = known.get(word)
                if got is None:
                    signs = word.replace(" ", _SPACE) if word.isascii() else "".join(map(_SIGNS.__getitem__, word))
                    got = known[word] = [t.id for t in tokenize(signs)]
                ids += got
            out[k] = ids
        for k, ids in zip(rest, self._library([pieces[k] for k in rest]), strict=True):
            out[k] = ids
        return out

    def _library(self, texts: list[str]) -> list[list[int]]:
        encode = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        return [e.ids for e in encode(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        waiting, first = self.codes.waiting, len(self.codes) - len(self.codes.waiting)
        for at in range(0, len(waiting), 20_000):
            some = [p.decode("utf-8", "replace") if isinstance(p, bytes) else p for p in waiting[at : at + 20_000]]
            got = self._piece_ids(some)
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            flat = np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum()))
            while self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            while first + at + len(got) > len(self.starts):
                self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
            here = slice(first + at, first + at + len(got))
            self.pool[self.used : self.used + len(flat)] = flat
            self.starts[here] = self.used + np.cumsum(sizes) - sizes
            self.sizes[here] = sizes
            self.used += len(flat)
        self.codes.waiting = []

    def _coded(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.codes) > MEMO_PIECES or self.used > MEMO_IDS:
            self._renew()
        codes = self.codes
        out = []
        for text in texts:
            pieces = self.split(text)
            out.append(np.fromiter(map(codes.__getitem__, pieces), np.int64, len(pieces)))
        self._learn()
        return out

    def _chunks(self, texts: list[str]):
        """Runs of texts of a few megabytes, so that what is held at once stays small."""
        some, size = [], 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size > 2_000_000:
                yield some
                some, size = [], 0
        if some:
            yield some

    def count(self, texts: list[str]) -> np.ndarray:
        """Number of ids of each text."""
        if self.split is None:
            return np.array([len(x) for x in self._library(texts)], np.int64)
        return np.array([int(self.sizes[c].sum()) for some in self._chunks(texts) for c in self._coded(some)], np.int64)

    def ids(self, texts: list[str]):
        """The ids of each text in turn, as uint32 arrays."""
        if self.split is None:
            for text in texts:
                yield np.array(self._library([text])[0], np.uint32)
            return
        for some in self._chunks(texts):
            for c in self._coded(some):
                sizes = self.sizes[c]
                ends = np.cumsum(sizes)
                total = int(ends[-1]) if len(ends) else 0
                yield self.pool[np.repeat(self.starts[c] - ends + sizes, sizes) + np.arange(total)]


@lru_cache(maxsize=4)
def tokenizer(path: str) -> MemoTokenizer:
    """One per Python worker and file."""
    return MemoTokenizer(path)


def version(path: str) -> str:
    """Digest that names a tokenizer file's content."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()
