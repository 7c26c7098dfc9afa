"""A cuckoo filter over live digests, each slot pointing at the stored key that verifies a hit."""

from __future__ import annotations

import random
from array import array

SLOTS, MAX_KICKS = 4, 200


class CuckooIndex:
    """Maps a digest (bytes, at least 16 of them uniformly distributed) to a value.

    The filter holds 16-bit fingerprints in two candidate buckets of four slots. Beside each fingerprint
    stands the position of the stored key; a fingerprint hit counts only if that key equals the whole digest.
    An insertion that can't find a slot doubles the buckets and places every stored key again, so nothing is
    ever lost to overflow. Deleted positions are reused.
    """

    def __init__(self, capacity: int = 256, seed: int = 7) -> None:
        self.keys: list[bytes | None] = []
        self.values: list = []
        self.free: list[int] = []
        self.live = 0
        self.resizes = 0
        self.rng = random.Random(seed)
        buckets = 1
        while buckets * SLOTS < capacity:
            buckets *= 2
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = array("H", bytes(2 * SLOTS * buckets))
        self.refs = array("q", [-1]) * (SLOTS * buckets)

    def __len__(self) -> int:
        return self.live

    @staticmethod
    def _print(digest: bytes) -> int:
        return (digest[8] | digest[9] << 8) or 1

    def _buckets(self, digest: bytes) -> tuple[int, int, int]:
        mark = self._print(digest)
        one = int.from_bytes(digest[:8], "little") & self.mask
        return mark, one, self._other(one, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def find(self, digest: bytes) -> int:
        """The position of the live key, or -1."""
        mark, one, two = self._buckets(digest)
        prints, refs, keys = self.prints, self.refs, self.keys
        for bucket in (one, two):
            at = bucket * SLOTS
            for slot in range(at, at + SLOTS):
                if prints[slot] == mark and refs[slot] >= 0 and keys[refs[slot]] == digest:
                    return refs[slot]
        return -1

    def insert(self, digest: bytes, value) -> int:
        """Add a digest that isn't live; returns its position."""
        if self.free:
            ref = self.free.pop()
            self.keys[ref], self.values[ref] = digest, value
        else:
            ref = len(self.keys)
            self.keys.append(digest)
            self.values.append(value)
        self.live += 1
        if not self._place(digest, ref):
            self._resize()
        return ref

    def delete(self, digest: bytes) -> bool:
        """Take a live digest out; False if it isn't there."""
        mark, one, two = self._buckets(digest)
        for bucket in (one, two):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                ref = self.refs[slot]
                if ref >= 0 and self.prints[slot] == mark and self.keys[ref] == digest:
                    self.prints[slot], self.refs[slot] = 0, -1
                    self.keys[ref] = self.values[ref] = None
                    self.free.append(ref)
                    self.live -= 1
                    return True
        return False

    def _put(self, bucket: int, mark: int, ref: int) -> bool:
        for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if self.refs[slot] < 0:
                self.prints[slot], self.refs[slot] = mark, ref
                return True
        return False

    def _place(self, digest: bytes, ref: int) -> bool:
        mark, one, two = self._buckets(digest)
        if self._put(one, mark, ref) or self._put(two, mark, ref):
            return True
        bucket = self.rng.choice((one, two))
        for _ in range(MAX_KICKS):
            slot = bucket * SLOTS + self.rng.randrange(SLOTS)
            mark, self.prints[slot] = self.prints[slot], mark
            ref, self.refs[slot] = self.refs[slot], ref
            bucket = self._other(bucket, mark)
            if self._put(bucket, mark, ref):
                return True
        return False

    def _resize(self) -> None:
        buckets = self.mask + 1
        while True:
            buckets *= 2
            self.resizes += 1
            self._clear(buckets)
            if all(self._place(key, ref) for ref, key in enumerate(self.keys) if key is not None):
                return

    def items(self):
        return ((key, value) for key, value in zip(self.keys, self.values) if key is not None)
