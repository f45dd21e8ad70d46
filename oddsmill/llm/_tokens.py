"""Token ids of public tokenizers, with a bounded cache of words in each Python worker."""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

_LONGEST_WORD = 64
_BLANK = np.zeros(256, bool)  # white space in ASCII, with the separators that Unicode counts as such
_BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_MAY_OPEN_BLANK = np.zeros(256, bool)  # first bytes of white space beyond ASCII
_MAY_OPEN_BLANK[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_MAY_CLOSE_BLANK = np.zeros(256, bool)  # the byte before the last of white space beyond ASCII
_MAY_CLOSE_BLANK[[0xC2, 0x80, 0x81, 0x9A]] = True
_KIND = np.zeros(256, np.uint8)  # 1: a letter in ASCII, 2: a mark that no string of a special token holds
_KIND[65:91] = _KIND[97:123] = 1
_KIND[list(b'.,!?;:*#$%&")')] = 2


def cut_places(raw: np.ndarray) -> np.ndarray:
    """Where a text (UTF-8 bytes, with two zero bytes at each end) may be cut so that its pieces give its ids.

    Before a single space, and before and after a single line feed, between characters that are no white space; and
    between a letter and a mark.
    """
    at = np.flatnonzero((raw == 32) | (raw == 10))
    before, after = raw[at - 1], raw[at + 1]
    lone = ~(_BLANK[before] | _BLANK[after] | _MAY_OPEN_BLANK[after] | (_MAY_CLOSE_BLANK[raw[at - 2]] & (before >= 0x80)))
    at = at[lone]
    kind = _KIND[raw]
    return np.concatenate([at, at[raw[at] == 10] + 1, np.flatnonzero(kind[1:] + kind[:-1] == 3) + 1])


class WordCachingEncoder:
    """Encodes texts exactly as the tokenizer does, but each distinct piece only once while it is cached.

    Byte-level tokenizers never let a token cross from a word to the single space before the next, and
    tokenizers that drop white space never cross it at all; so a text may be cut there, each piece encoded
    alone, and the ids joined. Any other tokenizer gets whole texts. ``max_words`` bounds the cache. Strings of special
    tokens inside a text are what the tokenizer's plain call makes of them.
    """

    def __init__(self, path: str, max_words: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.max_words = max_words
        self.cache: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        steps = pre.get("pretokenizers", [])
        self.glue = ""
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer"):
            self.glue = "\n"
        elif steps and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and "\\s" in str(steps[0].get("pattern")):
            self.glue = " \x01 "
        if self.glue:
            ids = self.tokenizer.encode(f"a{self.glue}b", add_special_tokens=False).ids
            if len(ids) == 3:
                self.mark = ids[1]
            else:
                self.glue = ""

    def _encoded(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece; words of letters are encoded many at once, with what stands between them cut out again."""
        out: list[bytes] = [b""] * len(pieces)
        plain, odd = [], []
        for k, w in enumerate(pieces):
            word = w[1:] if w[:1] == b" " else w
            (plain if word.isalpha() and len(w) <= _LONGEST_WORD and self.glue else odd).append(k)
        for i in range(0, len(plain), 64):
            some = plain[i : i + 64]
            ids = np.asarray(self.tokenizer.encode_batch_fast([self.glue.join([pieces[k].decode() for k in some])], add_special_tokens=False)[0].ids, "<u4")
            cuts = (np.flatnonzero(ids == self.mark) * 4).tolist()
            if len(cuts) != len(some) - 1:
                odd += some
                continue
            raw, start = ids.tobytes(), 0
            for k, end in zip(some, [*cuts, len(raw)], strict=True):
                out[k], start = raw[start:end], end + 4
        for i in range(0, len(odd), 1000):
            some = odd[i : i + 1000]
            for k, e in zip(some, self.tokenizer.encode_batch_fast([pieces[k].decode() for k in some], add_special_tokens=False), strict=True):
                out[k] = np.asarray(e.ids, "<u4").tobytes()
        return out

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of distinct pieces. The cache has two halves: what a full one held is kept until the next is full, and
        moves over when it is met again."""
        out = [*map(self.cache.get, pieces)]
        missing = [k for k, x in enumerate(out) if x is None]
        found = {}
        if self.old:
            seen = [self.old.get(pieces[k]) for k in missing]
            found = {k: x for k, x in zip(missing, seen, strict=True) if x is not None}
            missing = [k for k, x in zip(missing, seen, strict=True) if x is None]
        found.update(zip(missing, self._encoded([pieces[k] for k in missing]), strict=True))
        if len(self.cache) + len(found) > self.max_words // 2:
            self.old, self.cache = self.cache, {}
        for k, x in found.items():
            out[k] = x
            if len(pieces[k]) <= _LONGEST_WORD:
                self.cache[pieces[k]] = x
        return out

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (UTF-8) in one array, and where each text's begin, with the end of the last."""
        raw = np.frombuffer(b"".join([b"\0\0", *texts, b"\0\0"]), np.uint8)
        starts = 2 + np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        cut = np.zeros(len(raw), bool)
        if self.glue:
            cut[cut_places(raw)] = True
        cut[starts] = True
        cut[: starts[0]] = cut[starts[-1] + 1 :] = False
        at = np.flatnonzero(cut)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(raw)]).dictionary_encode()
        ids = self._ids(pieces.dictionary.to_pylist())
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = np.concatenate([[0], np.cumsum(n)])
        code = pieces.indices.to_numpy()
        n = n[code]
        ends = np.concatenate([[0], np.cumsum(n)])
        places = np.repeat(first[code] - ends[:-1], n) + np.arange(ends[-1])
        return np.frombuffer(b"".join(ids), "<u4")[places], ends[np.searchsorted(at, starts)]

    def encode_with_end(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, with ``end_id`` after each text."""
        ids, starts = self.encode(texts)
        return np.insert(ids, starts[1:], end_id), starts + np.arange(len(starts))


def binaries(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The runs of ``values`` (four bytes each) from each start to the next as binary values, without a copy."""
    return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer((starts * 4).astype(np.int64)), pa.py_buffer(values)])


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null is an empty one."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


#: Bytes of text that are encoded at once: enough to meet words more than once.
BATCH = 4_000_000

_ENCODERS: dict[str, WordCachingEncoder] = {}


def encoder(path: str) -> WordCachingEncoder:
    """One encoder for each file and Python worker; a worker outlives its tasks."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = WordCachingEncoder(path)
    return _ENCODERS[path]
