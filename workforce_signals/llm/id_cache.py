"""Token ids of pieces that have been seen, held in flat arrays."""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np

# The pieces asked for most are looked up first, in a dictionary small enough for a processor's cache; it is chosen anew
# after so many pieces.
HOT, ANEW = 20_000, 1_000_000


class _Growing:
    """An array that values are added to."""

    def __init__(self, dtype):
        self.all, self.n = np.zeros(1024, dtype), 0

    def extend(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.all):
            more = np.zeros(max(2 * len(self.all), self.n + len(values)), self.all.dtype)
            more[: self.n] = self.all[: self.n]
            self.all = more
        self.all[self.n : self.n + len(values)] = values
        self.n += len(values)

    @property
    def values(self) -> np.ndarray:
        return self.all[: self.n]


class IdCache:
    """Pieces and their ids. When it is full, the half that was asked for least goes."""

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], capacity: int):
        """``learn`` gives the ids of new pieces in a row, and how many each has."""
        self.learn, self.capacity = learn, capacity
        self._empty()

    def _empty(self) -> None:
        self.places: dict[str, int] = {}
        self.hot: dict[str, int] = {}
        self.asked = 0
        self.ends, self.counts, self.ids, self.hits = _Growing(np.int64), _Growing(np.int64), _Growing(np.int32), _Growing(np.int64)

    def _shrink(self) -> None:
        hits = self.hits.values
        kept = np.sort(np.argsort(-hits, kind="stable")[: self.capacity // 2])
        names = list(self.places)  # in the order of their places
        ids, counts = self._gather(kept)
        self._empty()
        self._add([names[k] for k in kept.tolist()], ids, counts, hits[kept] // 2)

    def _warm(self) -> None:
        names, hits = list(self.places), self.hits.values
        most = np.argpartition(-hits, HOT)[:HOT] if len(hits) > HOT else np.arange(len(hits))
        self.hot = {names[k]: k for k in most.tolist()}
        self.asked = 0

    def _add(self, names: list[str], ids: np.ndarray, counts: np.ndarray, hits: np.ndarray | None = None) -> None:
        self.places.update(zip(names, range(len(self.places), len(self.places) + len(names)), strict=True))
        self.ends.extend(self.ids.n + np.cumsum(counts))
        self.counts.extend(counts)
        self.ids.extend(ids)
        self.hits.extend(np.zeros(len(names), np.int64) if hits is None else hits)

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.counts.all[at]
        ends = np.cumsum(counts)
        step = np.arange(ends[-1] if len(ends) else 0)
        return self.ids.all[np.repeat(self.ends.all[at] - ends, counts) + step], counts

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and how many each has."""
        if len(self.places) > self.capacity:
            self._shrink()
        if self.asked > ANEW or not self.hot:
            self._warm()
        self.asked += len(pieces)
        at = np.fromiter(map(self.hot.get, pieces, repeat(-1)), np.int64, len(pieces))
        cold = np.flatnonzero(at < 0)
        if len(cold):
            some = [pieces[i] for i in cold.tolist()]
            found = np.fromiter(map(self.places.get, some, repeat(-1)), np.int64, len(some))
            missing = np.flatnonzero(found < 0)
            if len(missing):
                lacking = [some[i] for i in missing.tolist()]
                new = list(dict.fromkeys(lacking))
                self._add(new, *self.learn(new))
                found[missing] = np.fromiter(map(self.places.__getitem__, lacking), np.int64, len(lacking))
            at[cold] = found
        np.add.at(self.hits.values, at, 1)
        return self._gather(at)
