"""Readers of public tokenizer files; a file's place is always a parameter."""

from __future__ import annotations

import base64
import functools


@functools.lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """Rank of each byte string of a rank file (base64 and rank on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Generations:
    """A cache of at most 2 x `most` entries: when the young half is full, the old half goes.

    It only saves work: a value that is gone is computed anew."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def fill(self, keys, compute) -> dict:
        """The values of all keys; `compute` maps a list of unknown keys to their values."""
        young, old = self.young, self.old
        unknown = []
        for k in set(keys).difference(young):
            if k in old:
                young[k] = old[k]
            else:
                unknown.append(k)
        if unknown:
            young.update(zip(unknown, compute(unknown)))
        if len(young) > self.most:
            self.old, self.young = young, {}
        return young  # the dictionary that has all of them, even if it has just become the old one
