"""Feature vectors over scalar columns, packed arrays and log interactions.

The final tables of the boosted-tree flow are 1 071 features wide: five market
columns, 31 of set B, nine row statistics, 171 signals and 855 interactions.
Here a row keeps 216 numbers (scalars and one array); an interaction exists
only as an expression, ``X * ln(m)``.  A ``FeatureSpace`` lists the features in
order and builds

* the vector of all features from the blocks' whole arrays, or
* the vector of a selection, from those array positions alone: an interaction
  that is not selected is never computed.

Names travel as ML attributes of the vector column, so models and importance
tables speak of ``X7_log_x_volume`` and not of index 311.

Missing values become NaN, a NULL array a run of NaN.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowbook.functions import arrays as A
from flowbook.functions.numeric import finite_or_zero, safe_ln

NAN = float("nan")


def _number(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(NAN))


@dataclass(frozen=True)
class Scalars:
    """One feature per column."""

    columns: tuple[str, ...]

    @property
    def names(self) -> tuple[str, ...]:
        return self.columns

    def at(self, i: int) -> Column:
        return _number(F.col(self.columns[i]))

    def whole(self) -> Column:
        return F.array(*[self.at(i) for i in range(len(self.columns))])


@dataclass(frozen=True)
class Packed:
    """One feature per element of an array column."""

    column: str
    names: tuple[str, ...]

    def at(self, i: int) -> Column:
        return _number(F.get(F.col(self.column), F.lit(i)))

    def whole(self) -> Column:
        return F.coalesce(F.transform(self.column, _number), F.array_repeat(F.lit(NAN), len(self.names)))


@dataclass(frozen=True)
class LogInteractions:
    """``X * ln(m)`` for every element of an array column, 0 where not finite."""

    column: str
    elements: tuple[str, ...]
    market: str

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(f"{n}_log_x_{self.market}" for n in self.elements)

    def at(self, i: int) -> Column:
        return finite_or_zero(F.get(F.col(self.column), F.lit(i)) * safe_ln(F.col(self.market)))

    def whole(self) -> Column:
        return F.coalesce(A.log_interaction(F.col(self.column), F.col(self.market)), F.array_repeat(F.lit(0.0), len(self.elements)))


@dataclass(frozen=True)
class FeatureSpace:
    """Features in order, as blocks of columns, array elements and interactions."""

    blocks: tuple[Scalars | Packed | LogInteractions, ...]

    @staticmethod
    def of(df: DataFrame, scalars: Iterable[str] = (), packed: Iterable[str] = (), markets: Iterable[str] = ()) -> FeatureSpace:
        """The space of ``df``'s columns: ``scalars``, the elements of the
        ``packed`` arrays, and their interactions with ``markets``."""
        arrays = [(c, tuple(A.names_of(df, c))) for c in packed]
        blocks = [Scalars(tuple(scalars)), *(Packed(c, n) for c, n in arrays), *(LogInteractions(c, n, m) for c, n in arrays for m in markets if m in df.columns)]
        space = FeatureSpace(tuple(b for b in blocks if b.names))
        if len(set(space.names)) != len(space.names):
            raise ValueError("feature names repeat")
        return space

    @property
    def names(self) -> list[str]:
        return [n for b in self.blocks for n in b.names]

    def select(self, names: Sequence[str]) -> Selection:
        """The named features, in the order given."""
        self.array(names)
        return Selection(self, tuple(names))

    def needs(self, selected: Sequence[str] | None = None) -> list[str]:
        """The columns that the vector reads."""
        chosen = set(self.names if selected is None else selected)
        out: dict[str, None] = {}
        for b in self.blocks:
            used = [n for n in b.names if n in chosen]
            if isinstance(b, Scalars):
                out.update(dict.fromkeys(used))
            elif used:
                out.update(dict.fromkeys([b.column] + ([b.market] if isinstance(b, LogInteractions) else [])))
        return list(out)

    def array(self, selected: Sequence[str] | None = None) -> Column:
        """All features, or the selected ones in the order given, as one array."""
        if selected is None:
            return F.concat(*[b.whole() for b in self.blocks])
        place = {n: (b, i) for b in self.blocks for i, n in enumerate(b.names)}
        missing = [n for n in selected if n not in place]
        if missing:
            raise KeyError(f"features not found: {missing[:10]}")
        return F.array(*[place[n][0].at(place[n][1]) for n in selected])

    def vector(self, df: DataFrame, selected: Sequence[str] | None = None, out: str = "features") -> DataFrame:
        """``df`` with the vector column ``out``, its names as ML attributes."""
        names = list(self.names if selected is None else selected)
        return df.withColumn(out, array_to_vector(self.array(selected)).alias(out, metadata=attributes(names)))


@dataclass(frozen=True)
class Selection:
    """Some features of a space, in an order of their own."""

    space: FeatureSpace
    chosen: tuple[str, ...]

    @property
    def names(self) -> list[str]:
        return list(self.chosen)

    def select(self, names: Sequence[str]) -> Selection:
        return self.space.select(names)

    def needs(self) -> list[str]:
        return self.space.needs(self.chosen)

    def vector(self, df: DataFrame, out: str = "features") -> DataFrame:
        return self.space.vector(df, self.chosen, out)


#: What fits and selections take: column names, a space, or a part of one.
Features = Sequence[str] | FeatureSpace | Selection


def names_of_features(features: Features) -> list[str]:
    return features.names if isinstance(features, FeatureSpace | Selection) else list(features)


def columns_of_features(features: Features) -> list[str]:
    """The columns that the features are computed from."""
    return features.needs() if isinstance(features, FeatureSpace | Selection) else list(features)


def chosen_features(features: Features, names: Sequence[str]) -> Features:
    return features.select(names) if isinstance(features, FeatureSpace | Selection) else list(names)


def attributes(names: Sequence[str]) -> dict:
    """Field metadata that names a vector's elements."""
    return {"ml_attr": {"attrs": {"numeric": [{"idx": i, "name": n} for i, n in enumerate(names)]}, "num_attrs": len(names)}}


def names_of_vector(df: DataFrame, vector: str = "features") -> list[str]:
    """The names of a vector column's elements, by index."""
    attr = (df.schema[vector].metadata or {}).get("ml_attr", {})
    named = sorted((a["idx"], a["name"]) for group in attr.get("attrs", {}).values() for a in group if "name" in a)
    if not named or [i for i, _ in named] != list(range(attr.get("num_attrs", len(named)))):
        raise ValueError(f"vector column {vector!r} carries no names")
    return [n for _, n in named]
