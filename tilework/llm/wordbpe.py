"""Vectorised encoder for a lower-casing word BPE file of the ``tokenizers`` format.

Pre-tokenisation runs on code-point arrays, equal words of a batch are encoded once, and the
merges run in ``tiktoken`` on the vocabulary of the file, with the end-of-word mark written as NUL.
The ids equal those of ``Tokenizer.encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer

BATCH_CHARS = 1_000_000


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE files: printable bytes for themselves, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordBpe:
    """Encodes many texts at once; see the module docstring."""

    def __init__(self, path: str):
        self.plain = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = tuple(special)
        to_byte = _byte_of_char()
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            if token not in special:
                last = token.endswith("</w>")
                ranks[bytes(to_byte[c] for c in (token[:-4] if last else token)) + b"\0" * last] = i
        self.core = tiktoken.Encoding("word", pat_str=r"[^\x00]*\x00", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.ends = np.zeros(max(ranks.values()) + 1, bool)
        self.ends[[i for t, i in ranks.items() if len(t) > 1 and t.endswith(b"\0")]] = True
        kind = {"L": 1, "N": 2}
        self.kind = np.fromiter((kind.get(unicodedata.category(chr(c))[0], 3) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        self.kind[[c for c in range(0x3001) if chr(c).isspace() and not 0x1C <= c <= 0x1F]] = 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text, as little-endian unsigned 32-bit arrays."""
        out: list[np.ndarray | None] = [None] * len(texts)
        at, size = [], 0
        for i, t in enumerate(texts):
            if "\0" in t or any(s in t for s in self.special):
                out[i] = np.array(self.plain.encode(t, add_special_tokens=False).ids, "<u4")
                continue
            at.append(i)
            size += len(t)
            if size >= BATCH_CHARS or i == len(texts) - 1:
                self._batch(texts, at, out)
                at, size = [], 0
        self._batch(texts, at, out)
        return out

    def _batch(self, texts: list[str], at: list[int], out: list) -> None:
        if not at:
            return
        low = [unicodedata.normalize("NFC", texts[i]).replace("Σ", "σ").lower() for i in at]
        cp = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le"), "<u4")
        kind = self.kind[cp]
        word = kind > 0
        start = word.copy()
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        self._contractions(cp, kind, start)
        end = word.copy()  # the last character of each word
        end[:-1] &= ~word[1:] | start[1:]
        chars = cp[word]
        wide = (1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)).astype(np.uint8)
        stops = np.cumsum(wide, dtype=np.int64)[end[word]]
        data = chars.tobytes().decode("utf-32-le").encode("utf-8")
        words = pa.Array.from_buffers(pa.large_binary(), len(stops), [None, pa.py_buffer(np.concatenate([[0], stops])), pa.py_buffer(data)]).dictionary_encode()
        codes = words.indices.to_numpy()
        ids = np.frombuffer(self.core.encode_to_tiktoken_buffer(b"\0".join([*words.dictionary.to_pylist(), b""]).decode("utf-8"), set()), "<u4")
        last = np.flatnonzero(self.ends[ids]) + 1
        first = np.concatenate([[0], last[:-1]]) if len(last) else last
        counts = (last - first)[codes]
        total = np.concatenate([[0], np.cumsum(counts)])
        every = ids[np.arange(total[-1]) + np.repeat(first[codes] - total[:-1], counts)]
        # Words that end before each text's closing line feed.
        bounds = np.cumsum([len(t) + 1 for t in low])
        words_to = np.concatenate([[0], np.cumsum(end)[bounds - 1]])
        for k, i in enumerate(at):
            out[i] = every[total[words_to[k]] : total[words_to[k + 1]]]

    @staticmethod
    def _contractions(cp: np.ndarray, kind: np.ndarray, start: np.ndarray) -> None:
        """An apostrophe that begins a word takes a following s, t, m, d, re, ve or ll with it."""
        q = np.flatnonzero((cp == 39) & start)
        q = q[q + 2 < len(cp)]
        a, b = cp[q + 1], cp[q + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        for hit, n in ((q[one], 1), (q[two & ~one], 2)):
            start[hit + 1] = False
            after = hit + 1 + n
            after = after[after < len(cp)]
            start[after] = kind[after] > 0


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)
