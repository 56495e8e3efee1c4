"""Token ids of a byte-level BPE vocabulary, for the operators that count and pack tokens.

The merges are tiktoken's.  A text is split at its spaces; a part that
neither starts nor ends with white space is tokenized alike wherever it
stands behind a space, so its ids come from a bounded cache of the worker.
Texts in which white space meets white space are tokenized as a whole.
"""

from __future__ import annotations

import json
from array import array

from .bpe import byte_alphabet
from .scratch import worker_cache

#: The pattern that splits text before the merges, a fixed value of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CACHE_PARTS = 400_000


class _Parts(dict):
    """Ids of parts, packed; a miss is encoded."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, part: str) -> bytes | None:
        """None for a part that isn't tokenized on its own."""
        if len(self) >= _CACHE_PARTS:
            self.clear()
        alone = part not in ("", " ") and not (part[part[0] == " " :][0].isspace() or part[-1].isspace())
        found = self[part] = self.encode(part) if alone else None
        return found


class ByteBpe:
    """Ids as the tokenizers library gives them for the same vocabulary, without special tokens added.

    path: the JSON file of the tokenizers library.  Special tokens' strings
    in a text become their ids if ``specials``, else they are plain text.
    """

    def __init__(self, path: str, specials: bool = True):
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        self.core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)._core_bpe
        self.special = list(special) if specials else []
        self.parts = _Parts(self._pack)

    def _pack(self, text: str) -> bytes:
        return array("I", self.core.encode_ordinary(text)).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit integers; null counts as empty."""
        if not text:
            return b""
        if any(s in text for s in self.special):
            return array("I", self.core.encode(text, set(self.special))).tobytes()
        first, *rest = text.split(" ")
        try:
            return b"".join([self.parts[first], *map(self.parts.__getitem__, map(" ".__add__, rest))])
        except TypeError:  # a part that isn't tokenized on its own
            return self._pack(text)


def byte_bpe(path: str, specials: bool = True) -> ByteBpe:
    """The tokenizer in path; workers keep it across tasks."""
    cache = worker_cache()
    key = ("bytes", path, specials)
    if key not in cache:
        cache[key] = ByteBpe(path, specials)
    return cache[key]
