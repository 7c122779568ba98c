"""The best few rows of each query, kept inside tasks.

A batch of queries goes to the rows, which stay where they are. A task holds no
more than a fixed number of rows of each query and passes those on, so what is
shuffled does not grow with the number of matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Queries that are sent to the rows at a time.
QUERIES = 1_024
#: Rows held before they are cut to the best of each query, and pairs of a row and a query made at a time.
HELD, PAIRS = 1 << 18, 1 << 20
#: Bytes of text that go to an output batch or are looked at together.
BYTES = 32 << 20


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Half away from zero, as SQL rounds."""
    scale = 10.0**digits
    return np.copysign(np.floor(np.abs(x) * scale + 0.5) / scale, x)


class Best:
    """The first ``k`` rows of each of ``n`` queries by ``key`` (a double), then
    by a column ``tie``; rows come in batches."""

    def __init__(self, n: int, k: int, tie: str):
        self.k, self.tie = k, tie
        self.limit = np.full(n, np.inf)  # the key of a query's last row, once it has k
        self.parts: list[pa.Table] = []
        self.size = 0

    def add(self, rows: pa.RecordBatch, at: np.ndarray, query: np.ndarray, key: np.ndarray, **more: np.ndarray) -> None:
        """Rows ``at`` of a batch, each for one query."""
        keep = np.flatnonzero(key <= self.limit[query])
        if not len(keep):
            return
        if self.k and len(keep) > 4 * self.k:  # of one batch, rows behind the kth key of a query cannot stay
            order = keep[np.lexsort((key[keep], query[keep]))]
            q = query[order]
            start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
            size = np.diff(np.r_[start, len(q)])
            last = key[order][np.minimum(start + self.k, start + size) - 1]
            keep = np.sort(order[key[order] <= np.repeat(last, size)])
        table = pa.Table.from_batches([rows.take(pa.array(at[keep]))])
        for name, column in {"_q": query.astype(np.int32), "_key": key, **more}.items():
            table = table.append_column(name, pa.array(column[keep]))
        self.parts.append(table)
        self.size += table.num_rows
        if self.size > HELD:
            self._cut()

    def _cut(self) -> pa.Table | None:
        if not self.parts:
            return None
        table = pa.concat_tables(self.parts)
        table = table.take(pc.sort_indices(table, sort_keys=[("_q", "ascending"), ("_key", "ascending"), (self.tie, "ascending")]))
        q = table.column("_q").to_numpy()
        start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        place = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
        last = np.flatnonzero(place == self.k - 1)
        self.limit[q[last]] = table.column("_key").to_numpy()[last]
        table = table.take(pa.array(np.flatnonzero(place < self.k))).combine_chunks()
        self.parts, self.size = [table], table.num_rows
        return table

    def rows(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        table = self._cut()
        if table is not None:
            yield from table.select(names).to_batches(max_chunksize=8_192)


class Asked:
    """Which queries ask for which of ``terms``: spreads rows by terms to rows by queries."""

    def __init__(self, terms: list[str], pairs: list[tuple[int, int]], n: int):
        """``pairs`` are (term, query) places."""
        self.terms, self.n = terms, n
        term, query = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        order = np.lexsort((query, term))
        self.query = query[order]
        self.many = np.bincount(term, minlength=len(terms))
        self.start = np.r_[0, np.cumsum(self.many)][:-1]

    def spread(self, row: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place among the given, row, query) of each query that asks for a row's term."""
        many = self.many[term]
        place = np.repeat(np.arange(len(row)), many)
        inside = np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many)
        return place, row[place], self.query[self.start[term[place]] + inside]

    def step(self) -> int:
        """Rows to spread at a time."""
        return max(1, PAIRS // max(1, len(self.query)))
