"""Byte-level BPE ids of whole texts, as little-endian bytes.

The vocabulary is a ``tokenizers`` JSON file, and the ids are the ones that
library gives with ``add_special_tokens=False`` and special strings taken as
ordinary text (tests hold the two against each other). Two things make it fast
enough for a corpus: the merge table is run by ``tiktoken``, and the ids of runs
between single spaces are remembered, since such a space always begins a
pre-token of this vocabulary. A text where a space touches other white space or
an edge is encoded whole.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

#: Fixed value: the pre-token pattern of this byte-level vocabulary, as published with it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs remembered by one Python worker, and the longest in characters; others are encoded each time. About 50 MB at most.
REMEMBERED, REMEMBERED_CHARS = 200_000, 24


class _Uneven(Exception):
    """A space that is not between two visible characters."""


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: visible Latin-1 stands for itself, the others follow from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Runs(dict):
    """Run of visible text -> bytes of its ids. ``lead`` is put before a run."""

    def __init__(self, encode, lead: str) -> None:
        super().__init__()
        self.encode, self.lead = encode, lead

    def __missing__(self, run: str) -> bytes:
        if not run or run[0].isspace() or run[-1].isspace():
            raise _Uneven
        value = self.encode(self.lead + run)
        if len(run) <= REMEMBERED_CHARS and len(self) < REMEMBERED:
            self[run] = value
        return value


class Tokenizer:
    """Ids of texts by one vocabulary file."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet = byte_alphabet()
        vocab = model["vocab"]
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError("the vocabulary's ids must follow the order of its merges")
        made = set(merged)
        ranks = {bytes(alphabet[c] for c in token): i for token, i in vocab.items() if i in made or len(token) == 1}
        self.size = max(vocab.values()) + 1
        self.dtype = "<u2" if self.size <= 1 << 16 else "<u4"
        self._code = "H" if self.size <= 1 << 16 else "I"
        self._plain = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._spaced, self._first = _Runs(self._whole, " "), _Runs(self._whole, "")
        self._newline = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return array(self._code, self._plain(text)).tobytes()

    def one(self, token_id: int) -> bytes:
        """The bytes of a single id."""
        return array(self._code, [token_id]).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` in order, each as ``dtype``."""
        if not text:
            return b""
        try:
            first, spaced = self._first, self._spaced
            lines = []
            for i, line in enumerate(text.split("\n")):
                runs = line.split(" ")
                lines.append(first[runs[0]] + b"".join(map(spaced.__getitem__, runs[1:])))
            return self._newline.join(lines)
        except _Uneven:
            return self._whole(text)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a vocabulary file, loaded once in each Python worker."""
    return Tokenizer(path)
