"""Token ids of whole texts from a byte-level BPE file of the ``tokenizers`` library, with remembered words.

Byte-level BPE never joins across the start of a word: where a single space stands
before a visible character, or a single line break between two, the text can be cut and
the parts' ids put together. Words repeat, so most parts are found in a bounded memory.
New parts in Latin script are encoded by ``tiktoken`` with the same vocabulary, which is
several times as fast; all others, and texts with other runs of white space, by
``tokenizers`` itself. A text that contains an added token, like ``<|endoftext|>``, goes to
``tokenizers`` whole, where the file's settings hold; ``added=False`` spells such tokens out
as ordinary text instead. Tests hold all against it on whole texts.
"""

from __future__ import annotations

import json
import re
import sys
from array import array

#: The pre-tokenisation pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LAST_LATIN = "ɏ"
MEMORY = 600_000
_UNCUTTABLE = re.compile(r" (?:\s|\Z)")


def byte_symbols() -> dict[str, int]:
    """The visible character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Encoder:
    """Ids as little-endian 32-bit numbers in bytes."""

    def __init__(self, path: str, added: bool = False) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.exact.encode_special_tokens = True
        symbols = byte_symbols()
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        special = {t["content"] for t in model["added_tokens"]}
        ranks = {bytes(symbols[c] for c in token): rank for token, rank in model["model"]["vocab"].items() if token not in special}
        self.whole = Tokenizer.from_file(path)
        self.added = re.compile("|".join(map(re.escape, sorted(special)))) if added and special else None
        self.fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.newline = self._new("\n")
        self.heads, self.words = _Memory(self, ""), _Memory(self, " ")

    def _new(self, part: str) -> bytes:
        ids = self.fast.encode_ordinary(part) if not part or max(part) <= LAST_LATIN else self.exact.encode(part, add_special_tokens=False).ids
        return packed(ids)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.added and self.added.search(text):
            return packed(self.whole.encode(text, add_special_tokens=False).ids)
        if _UNCUTTABLE.search(text):
            return self._new(text)
        first, *rest = text.split(" ")
        return (self.heads[first] if first else b"") + b"".join(map(self.words.__getitem__, rest))


class _Memory(dict):
    """Ids of parts that follow ``lead``."""

    def __init__(self, encoder: Encoder, lead: str) -> None:
        super().__init__()
        self.encoder, self.lead = encoder, lead

    def __missing__(self, part: str) -> bytes:
        if "\n" in part:
            lines = part.split("\n")
            if all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
                return self[lines[0]] + b"".join(self.encoder.newline + self.encoder.heads[x] for x in lines[1:])
            return self.encoder._new(self.lead + part)
        value = self.encoder._new(self.lead + part)
        if len(part) < 64:
            if len(self) >= MEMORY:
                self.clear()
            self[part] = value
        return value


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, once per Python process."""
    if path not in _loaded:
        _loaded[path] = Encoder(path, added=True)
    return _loaded[path]
