"""One scoring pass for many models: cases meet all item and history tables once."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Sequence

from pyspark.sql import Column, DataFrame


class SharedTables:
    """What the models of one pass know per film and per history.

    Models add tables under a key and get back the prefix that the tables' columns
    carry; a table whose key is known is not made again. ``onto`` joins the film
    tables to each other, the history tables to each other, and both to the cases.
    """

    def __init__(self, given: DataFrame, by: Sequence[str], item: str = "movieId") -> None:
        self.given, self.by, self.item = given, list(by), item
        self._tables: dict[tuple[str, ...], dict[Hashable, tuple[str, DataFrame]]] = {(item,): {}, tuple(by): {}}
        self._scores: dict[int, Column] = {}

    def items(self, key: Hashable, make: Callable[[], DataFrame]) -> str:
        """Prefix of a table with one row per film at most."""
        return self._add((self.item,), key, make)

    def histories(self, key: Hashable, make: Callable[[], DataFrame]) -> str:
        """Prefix of a table with one row per history at most."""
        return self._add(tuple(self.by), key, make)

    def _add(self, on: tuple[str, ...], key: Hashable, make: Callable[[], DataFrame]) -> str:
        tables = self._tables[on]
        if key not in tables:
            prefix = f"_{'h' if on == tuple(self.by) else 'i'}{len(tables)}_"
            frame = make()
            tables[key] = prefix, frame.withColumnsRenamed({c: prefix + c for c in frame.columns if c not in on})
        return tables[key][0]

    def score(self, model) -> Column:
        """A model's score over the joined tables, asked for once."""
        if id(model) not in self._scores:
            self._scores[id(model)] = model.joint_score(self)
        return self._scores[id(model)]

    def onto(self, cases: DataFrame) -> DataFrame:
        for on, tables in self._tables.items():
            known = None
            for _, frame in tables.values():
                known = frame if known is None else known.join(frame, list(on), "full")
            if known is not None:
                cases = cases.join(known, list(on), "left")
        return cases
