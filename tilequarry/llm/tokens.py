"""Token ids by the ``tokenizers`` library, with each distinct word encoded once.

A byte-level BPE file with its usual splitting pattern never joins a non-space character with a space after it, so a
text may be cut before any space that follows a non-space, and the ids of the pieces are the ids of the text. Pieces
repeat; their ids are kept in two dictionaries of ``KEEP`` entries in all (they are only a cache, of about 200 bytes an
entry). Texts with white space before a space, or with the file's special strings, are encoded in one piece.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import json
import os
import sys
from array import array
from collections import deque

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks use the cores
import numpy as np  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

KEEP = 1_400_000
GROUP = 1 << 21
MAX_PIECE = 64
_SPACES = frozenset(c for c in map(chr, range(0x3001)) if c.isspace()) | {"\u200b"}
_RARE = sorted(_SPACES - {" "})


class _Known(dict):
    """Ids of a space and a word, by the word. A word asked for in vain gets a place to be filled in later.

    Two generations: words of the older one are taken over when they are asked for again, and the rest of it goes when
    the younger one is full. So frequent words stay and those seen once do not.
    """

    def __init__(self):
        self.waiting: dict[str, bytearray] = {}
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes | bytearray:
        place = self.older.get(word)
        if place is None:
            place = self.waiting[word] = bytearray()
        self[word] = place
        return place

    def age(self) -> None:
        self.older = dict(self)
        self.clear()


class Encoder:
    """``encode_all`` gives the ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, keep: int | None = None):
        self.keep = KEEP if keep is None else keep
        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        self.special = [x["content"] for x in told.get("added_tokens") or []]
        pre = told.get("pre_tokenizer") or {}
        self.cuts = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not told.get("normalizer")
        vocabulary = self.tokenizer.get_vocab()
        self.lengths = np.zeros(1 + max(vocabulary.values()), np.int64)  # a byte-level token has a character for each byte
        for token, i in vocabulary.items():
            self.lengths[i] = len(token)
        self.known = _Known()
        self.firsts: dict[str, bytes] = {"": b""}  # of words at the start of a text

    def _fill(self) -> None:
        """Fill in what is waiting. A space begins each word, and none ends it: in a row, they are cut where they meet."""
        known, waiting = self.known, self.known.waiting
        words, places = list(waiting), list(waiting.values())
        texts = [" " + " ".join(words[i : i + 2000]) for i in range(0, len(words), 2000)]
        for at, text, e in zip(range(0, len(words), 2000), texts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            data = text.encode()
            ends = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) == 32)[1:], len(data))
            cuts = (4 * np.searchsorted(np.cumsum(self.lengths[ids]), ends, "left") + 4).tolist()
            raw = ids.tobytes()
            got = [raw[i:j] for i, j in zip([0, *cuts], cuts)]
            deque(map(bytearray.extend, places[at : at + 2000], got), maxlen=0)
            known.update(zip(words[at : at + 2000], got))
        for w in [w for w in words if len(w) > MAX_PIECE]:
            del known[w]
        waiting.clear()

    def whole(self, text: str) -> bytes:
        ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null is empty. Memory beyond the result is that of one group of about GROUP characters."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to] or "") <= GROUP):
                size += len(texts[to] or "")
                to += 1
            out += self._group(texts[at:to])
            at = to
        return out

    def _group(self, texts: list[str | None]) -> list[bytes]:
        get = self.known.__getitem__
        found: list[list[bytes] | None] = []
        for text in texts:
            if not text or not self.cuts or any(s in text for s in self.special) or any([c in text and c + " " in text for c in _RARE]) or "  " in text:
                found.append(None)
                continue
            first, *words = text.split(" ")
            last = self.whole(" " + words.pop()) if words and text[-1] in _SPACES else b""
            start = self.firsts.get(first)
            if start is None:
                start = self.firsts[first] = self.whole(first)
            found.append([start, *map(get, words), last])
        self._fill()
        out = [b"".join(f) if f else self.whole(t) if t else b"" for t, f in zip(texts, found)]
        if len(self.known) > self.keep // 2:
            self.known.age()
        if len(self.firsts) > self.keep // 32:
            self.firsts = {"": b""}
        return out


_encoders: dict[str, Encoder] = {}


def forget() -> None:
    """Give the cached words back to the system."""
    if _encoders:
        for e in _encoders.values():
            e.known.clear()
            e.known.older, e.firsts = {}, {"": b""}
        _encoders.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # only some C libraries can
            ctypes.CDLL(None).malloc_trim(0)


def encoder(path: str, keep: int | None = None) -> Encoder:
    """One encoder a Python worker and file; ``keep`` words in all are cached."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].keep = KEEP if keep is None else keep
    return _encoders[path]
