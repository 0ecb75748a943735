"""The best rows of many queries, as a task finds them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Queries whose scores or results are worked on at a time.
TILE_QUERIES = 512


class Best:
    """The k best (score, id) of each of ``m`` queries: a bounded list a query, ties to the smaller id."""

    def __init__(self, m: int, k: int) -> None:
        self.k, self.floor = k, np.full(m, -np.inf)
        self.held: list[list[tuple]] = [[] for _ in range(m)]

    def offer(self, queries: np.ndarray, scores: np.ndarray, ids: list) -> None:
        """scores: a row for each of ``queries``, a column for each of ``ids``."""
        hits = scores >= self.floor[queries][:, None]
        for row in np.flatnonzero(hits.any(1)).tolist():
            q, at = int(queries[row]), np.flatnonzero(hits[row])
            own = scores[row, at]
            if len(at) > self.k:  # of equal scores at the border all stay, and the ids decide
                least = np.partition(own, len(own) - self.k)[len(own) - self.k]
                at, own = at[own >= least], own[own >= least]
            new = [(-s, ids[i] is not None, ids[i]) for s, i in zip(own.tolist(), at.tolist(), strict=True)]
            self.held[q] = sorted(self.held[q] + new)[: self.k]
            if len(self.held[q]) == self.k:
                self.floor[q] = -self.held[q][-1][0]

    def rows(self, names: list, kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        """What is held, of TILE_QUERIES queries at a time."""
        for i in range(0, len(self.held), TILE_QUERIES):
            found = [(names[q], x[2], -x[0]) for q, held in enumerate(self.held[i : i + TILE_QUERIES], i) for x in held]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=["query_id", "page_id", "score"])
