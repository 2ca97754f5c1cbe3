"""Token ids of a byte-level BPE tokenizer file.

Ids are those of the ``tokenizers`` library. Texts of plain characters, on whose classes all
Unicode versions agree, go through ``tiktoken`` with ranks read from the same file, which gives the
same ids several times faster; all others go through ``tokenizers`` itself.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np

_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Whatever isn't ASCII text, Latin letters or common punctuation.
_ODD = re.compile("[^\\n\\r\\t\\x20-\\x7e¡-ɏ‐-‧‰-⁞]")
#: Half the length of a run, of white space or without any, that is too long for the fast way.
_HALF_RUN = 1000


def _has_long_run(text: str) -> bool:
    """A run of twice that length holds one of these stretches whole; a stretch of two words is none."""
    return any(len(text[k : k + _HALF_RUN].split(None, 1)) < 2 for k in range(0, len(text) - _HALF_RUN + 1, _HALF_RUN))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _bytes_of_letters() -> dict[str, int]:
    """The letters that byte-level BPE files write for bytes: printable ones stand for themselves."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in kept}
    letters.update({chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in kept)})
    return letters


class Encoder:
    """``plain``: the strings of special tokens are ordinary text, so their ids never come from a text."""

    def __init__(self, path: str, plain: bool = False) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        self.path, self.plain = path, plain
        added = {t["content"] for t in held.get("added_tokens", ())}
        letters = _bytes_of_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in held["model"]["vocab"].items() if token not in added}
        self.fast = tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.marks = re.compile("|".join(map(re.escape, sorted(added)))) if added and not plain else None

    @functools.cached_property
    def full(self):
        """The library's tokenizer, loaded when a text first needs it."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.encode_special_tokens = self.plain
        return found

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of a text without special tokens added; null: none."""
        text = text or ""
        if _ODD.search(text) or self.marks and self.marks.search(text) or _has_long_run(text):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


@functools.lru_cache(maxsize=2)
def encoder_of(path: str, plain: bool = False) -> Encoder:
    """One encoder for all tasks of a worker."""
    return Encoder(path, plain)
