"""Exact encoding with a tokenizers file, with each distinct white-space-led chunk encoded once per worker."""

from __future__ import annotations

import os
import re
from collections import ChainMap
from itertools import chain

import numpy as np

#: Unicode white space, as the pre-tokenizers' ``\s`` has it.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A chunk is a run of white space with the run of other characters after it. Pre-tokenizers that split by the usual
#: byte-level pattern, or that drop white space, never join characters across the start of such a chunk.
#: Nor do they join letters with common punctuation, so a word that such a mark follows is a chunk by itself.
_LETTERS, _MARKS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff", ".,;:!?"
_CHUNK = re.compile(f"[{_WS}]*[{_LETTERS}]+(?=[{_MARKS}{_WS}]|\\Z)|[{_WS}]*[^{_WS}]+|[{_WS}]+")
_BARE = re.compile(f"[^{_WS}]+")
#: Words of letters that no normalizer splits or composes; and a word's end, as vocabularies with word ends mark it.
_PLAIN = re.compile(f"[{_LETTERS}]+").fullmatch
_WORD_END = "</w>"
#: Such a word and the marks after it, which are a pre-token of their own; none starts with an apostrophe, as 's does.
_MARKED = re.compile(f"([{_LETTERS}]+)([{_MARKS}#$%&*]+)").fullmatch
#: Chunks that a worker's cache holds; so many take some 300 MB.
MOST = 1_400_000


def _bare_chunks(text: str) -> list[str]:
    """Chunks without white space; case does not matter to a tokenizer that lowers it, so plain ASCII is lowered first."""
    if text.isascii() and not re.search("[\x1c-\x1f]", text):
        return text.lower().split()
    return _BARE.findall(text)


class Encoder:
    """``encode(text)`` gives the little-endian unsigned 32-bit (or 16-bit) ids of a text as bytes.

    The ids equal ``Tokenizer.encode(text, add_special_tokens=False).ids`` of the file as it is loaded: where a text
    holds a special token's string, that is the token's id; such a text is encoded whole. The cache holds at most ``most`` chunks of at most ``longest`` characters, and takes no more when full (frequent
    chunks come early); the rest are encoded anew for each call.
    """

    def __init__(self, path: str, drops_space: bool = False, width: int = 4, most: int = MOST, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        most_id = self.tokenizer.get_vocab_size(with_added_tokens=True) - 1
        if most_id >= 1 << 8 * width:
            raise ValueError(f"ids up to {most_id} do not fit {width} bytes")
        #: strings that are cut out before the rest is split; in any case of letters, to be safe
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.has_added = re.compile("|".join(map(re.escape, added)), re.I).search if added else lambda text: None
        probe = self.tokenizer.encode("Ab", add_special_tokens=False).ids == self.tokenizer.encode("ab", add_special_tokens=False).ids
        self.find = (_bare_chunks if probe else _BARE.findall) if drops_space else _CHUNK.findall
        ends = [t.endswith(_WORD_END) for t, _ in sorted(self.tokenizer.get_vocab().items(), key=lambda x: x[1])]
        self.ends_word = np.array(ends) if drops_space and any(ends) else None
        self.dtype = {2: "<u2", 4: "<u4"}[width]
        self.most, self.longest = most, longest
        self.known: dict[str, bytes] = {}

    def _learn_words(self, words: list[str]) -> dict[str, bytes]:
        """Plain words, many in one text: each is one pre-token, whose last id is the only one that ends a word."""
        out, size = {}, np.dtype(self.dtype).itemsize
        for at in range(0, len(words), 1024):
            part = words[at : at + 1024]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids)
            ends = (np.flatnonzero(self.ends_word[ids]) + 1) * size
            if len(ends) != len(part):
                out.update(self._learn_each(part))
                continue
            flat, ends = ids.astype(self.dtype).tobytes(), ends.tolist()
            out.update(zip(part, map(flat.__getitem__, map(slice, [0, *ends[:-1]], ends))))
        return out

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        if self.ends_word is None:
            return self._learn_each(chunks)
        plain, marked, other = set(), [], []
        for c in chunks:
            if _PLAIN(c):
                plain.add(c)
            elif parts := _MARKED(c):
                marked.append((c, *parts.groups()))
            else:
                other.append(c)
        missing = {w for _, w, _ in marked}.difference(self.known)
        out = self._learn_words(list(plain | missing)) | self._learn_each([*other, *{x for *_, x in marked}.difference(other)])
        for c, w, x in marked:
            out[c] = (out[w] if w in out else self.known[w]) + out[x]
        return out

    def _learn_each(self, chunks: list[str]) -> dict[str, bytes]:
        out, size = {}, np.dtype(self.dtype).itemsize
        for at in range(0, len(chunks), 2048):
            part = chunks[at : at + 2048]
            ids = [x.ids for x in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            ends = np.cumsum([size * len(x) for x in ids]).tolist()
            flat = np.fromiter(chain.from_iterable(ids), self.dtype, ends[-1] // size).tobytes()
            out.update(zip(part, map(flat.__getitem__, map(slice, [0, *ends[:-1]], ends))))
        return out

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; a null text has none."""
        whole = {i for i, t in enumerate(texts) if t and self.has_added(t)}
        parts = [self.find(t) if t and i not in whole else [] for i, t in enumerate(texts)]
        known = self.known
        fresh = set(chain.from_iterable(parts)).difference(known)
        get = known.__getitem__
        if fresh:
            found = self._learn(list(fresh))
            if len(known) + len(found) <= self.most:
                known.update(found if max(map(len, found)) <= self.longest else {k: v for k, v in found.items() if len(k) <= self.longest})
            if not fresh <= known.keys():
                get = ChainMap(found, known).__getitem__ if len(fresh) < 64 else {**{k: known[k] for k in set(chain.from_iterable(parts)) - fresh}, **found}.__getitem__
        out = [b"".join(map(get, p)) for p in parts]
        for i in whole:
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, self.dtype).tobytes()
        return out


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, drops_space: bool, width: int, most: int = MOST) -> Encoder:
    """This worker's encoder of that file; kept for later tasks, as loading a vocabulary takes a moment."""
    key = (path, drops_space, width, most)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(path, drops_space, width, most)
    return _encoders[key]


def release() -> None:
    """Frees this worker's encoder: where other work follows in the same workers, its cache would stay beside that."""
    _encoders.clear()
