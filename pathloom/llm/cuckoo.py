"""A cuckoo filter whose inserts, look-ups and deletes work on whole numpy arrays."""

from __future__ import annotations

import numpy as np

from .common import mix64

SLOTS = 4


class CuckooFilter:
    """16-bit fingerprints in buckets of four; no false negatives, deletable.

    Keys are unsigned 64-bit hashes. A key may be inserted once for each later
    deletion. The table doubles when it gets too full; that needs all keys, so
    ``add`` then returns False and the owner rebuilds from its exact table.
    """

    def __init__(self, buckets: int, table: np.ndarray | None = None) -> None:
        self.mask = np.uint64(buckets - 1)
        self.table = np.zeros((buckets, SLOTS), dtype=np.uint16) if table is None else table.copy()

    @classmethod
    def sized(cls, keys: int, load: float = 0.8) -> CuckooFilter:
        return cls(1 << max(2, int(np.ceil(np.log2(max(1, keys) / (SLOTS * load))))))

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter of distinct keys, as small as they fit in."""
        made = cls.sized(len(keys))
        while not made.add(keys):
            made = cls(2 * len(made.table))
        return made

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        table = np.frombuffer(data, dtype="<u2").reshape(-1, SLOTS)
        return cls(len(table), table)

    def dump(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix64(keys.astype(np.uint64), 21)
        print_ = (h >> np.uint64(48)).astype(np.uint16)
        print_[print_ == 0] = 1
        return print_, (h & self.mask).astype(np.int64)

    def _other(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return bucket ^ (mix64(print_.astype(np.uint64), 22) & self.mask).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """For each key, whether it may be in; False is certain."""
        print_, bucket = self._places(keys)
        one = (self.table[bucket] == print_[:, None]).any(axis=1)
        return one | (self.table[self._other(bucket, print_)] == print_[:, None]).any(axis=1)

    @staticmethod
    def _turn(bucket: np.ndarray) -> np.ndarray:
        """Each item's place among those that want the same bucket."""
        order = np.argsort(bucket, kind="stable")
        ordered = bucket[order]
        first = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, dtype=bool)
        turn = np.empty(len(bucket), dtype=np.int64)
        turn[order] = np.arange(len(bucket)) - np.maximum.accumulate(np.where(first, np.arange(len(bucket)), 0))
        return turn

    def add(self, keys: np.ndarray, rounds: int = 500) -> bool:
        """Insert all keys; False, with the table unusable, if they don't fit."""
        print_, bucket = self._places(keys)
        tried = np.zeros(len(keys), dtype=bool)
        for r in range(rounds):
            if not len(print_):
                return True
            turn = self._turn(bucket)
            empty = self.table[bucket] == 0
            fits = turn < empty.sum(axis=1)
            if fits.any():  # the item whose turn is t takes the t-th empty slot
                at = np.argmax(np.cumsum(empty[fits], axis=1) > turn[fits, None], axis=1)
                self.table[bucket[fits], at] = print_[fits]
            stay = ~fits
            print_, bucket, tried, turn = print_[stay], bucket[stay], tried[stay], turn[stay]
            kick = tried & (turn == 0)  # one a bucket: it takes a slot and its owner moves on
            if kick.any():
                slot = r % SLOTS
                out = self.table[bucket[kick], slot].copy()
                full = out != 0
                where = np.flatnonzero(kick)[full]
                self.table[bucket[where], slot] = print_[where]
                print_[where] = out[full]
            move = ~tried | kick
            bucket = np.where(move, self._other(bucket, print_), bucket)
            tried = np.ones(len(print_), dtype=bool)
        return not len(print_)

    def remove(self, keys: np.ndarray) -> None:
        """Delete keys that were inserted before, one copy of each."""
        print_, bucket = self._places(keys)
        for _ in range(2):  # the first bucket of each key, then the other for what is left
            turn = self._turn(bucket * 65536 + print_)
            same = self.table[bucket] == print_[:, None]
            hit = turn < same.sum(axis=1)
            at = np.argmax(np.cumsum(same[hit], axis=1) > turn[hit, None], axis=1)
            self.table[bucket[hit], at] = 0
            print_ = print_[~hit]
            bucket = self._other(bucket[~hit], print_)
