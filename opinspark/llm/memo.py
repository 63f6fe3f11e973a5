"""What a worker remembers of strings it has met, so that each different word is tokenized once, and many new ones at a time."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from functools import lru_cache
from itertools import repeat

import numpy as np

#: by name: values of all strings one after another, and how many each string has; or a list with an item a string
Columns = dict[str, tuple[np.ndarray, np.ndarray] | list]


class Memo:
    """Arrays of values by string; all is forgotten past ``most`` strings or ``most_bytes`` bytes of them."""

    def __init__(self, make: Callable[[list[bytes]], Columns], most: int = 400_000, most_bytes: int = 16 << 20):
        self.make, self.most, self.most_bytes = make, most, most_bytes
        self._forget()

    def _forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.bytes, self._columns = 0, {}

    def places(self, words: list[bytes]) -> np.ndarray:
        """Where each word's values stand; they stay there until the next call."""
        if len(self.index) > self.most or self.bytes > self.most_bytes:
            self._forget()
        found = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(found < 0).tolist()
        if missing or not self._columns:
            new = list(dict.fromkeys([words[i] for i in missing]))
            for name, made in self.make(new).items():
                if isinstance(made, list):
                    self._columns.setdefault(name, []).extend(made)
                    continue
                values, sizes = made
                if name in self._columns:
                    old, ends = self._columns[name]
                    self._columns[name] = np.concatenate([old, values]), np.concatenate([ends, ends[-1] + np.cumsum(sizes)])
                else:
                    self._columns[name] = values, np.concatenate([[0], np.cumsum(sizes)])
            first = len(self.index)
            self.index.update(zip(new, range(first, first + len(new)), strict=True))
            self.bytes += sum(map(len, new))
            found[missing] = [self.index[words[i]] for i in missing]
        return found

    def of(self, name: str) -> tuple[np.ndarray, np.ndarray] | list:
        """A column: all values, and where each string's begin (with the end); or its list."""
        return self._columns[name]


def gather(values: np.ndarray, bounds: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of all places one after another, and where each place's begin (with the end)."""
    size = np.diff(bounds)[places]
    out = np.zeros(len(places) + 1, np.int64)
    np.cumsum(size, out=out[1:])
    at = np.arange(out[-1]) + np.repeat(bounds[:-1][places] - out[:-1], size)
    return values[at], out


def joined(parts: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists end to end, and their sizes."""
    sizes = np.array([len(x) for x in parts], np.int64)
    return np.fromiter((t for x in parts for t in x), np.int64, int(sizes.sum())), sizes


@lru_cache(4)
def tokenizer(path: str, plain: bool):
    """A tokenizer from its file, once a worker. ``plain`` takes special tokens' strings in a text as ordinary text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task a core already
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    if plain:
        found.encode_special_tokens = True
    return found


@lru_cache(4)
def vocabulary(path: str, ending: str = "") -> list[tuple[bytes, bool]]:
    """Bytes of each id of a byte-level vocabulary, and whether it ends with ``ending`` (left out of the bytes)."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves; the others follow from U+0100
    back = {chr(b): b for b in shown}
    back |= {chr(0x100 + n): b for n, b in enumerate(b for b in range(256) if b not in set(shown))}
    with open(path, encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    out = [(b"", False)] * (max(ids.values(), default=-1) + 1)
    for token, i in ids.items():
        last = bool(ending) and token.endswith(ending)
        body = token[: -len(ending)] if last else token
        out[i] = bytes(back[c] for c in body) if all(c in back for c in body) else body.encode(), last
    return out


@lru_cache(4)
def merger(path: str, pattern: str, ending: str = "", mark: bytes = b""):
    """The same merges for long runs of text: byte strings ranked by id, which is the order of the merges.

    ``mark`` is a byte that stands for ``ending``: it merges with the byte before it first, as the ids of marked bytes come before those of merges.
    """
    import tiktoken

    ranks = {body + (mark if last else b""): i for i, (body, last) in enumerate(vocabulary(path, ending)) if body}
    if mark:  # by itself it is only ever merged
        ranks[mark] = max(ranks.values()) + 1
    return tiktoken.Encoding("merges", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
