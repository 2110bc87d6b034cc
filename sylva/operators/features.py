"""Where the features of a row are: in columns, or in one open map.

A Source gives a feature's value as a number (null and NaN are missing) or as a text.  A predicate on a number asks for the
number, any other one for the text.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def name(column: str) -> str:
    """The column's name, quoted."""
    return "`" + column.replace("`", "``") + "`"


def _number(value: Column, kind: T.DataType) -> Column:
    none = F.lit(None).cast("double")
    return F.nanvl(value.cast("double"), none) if isinstance(kind, T.NumericType) else none


def _text(value: Column, kind: T.DataType) -> Column:
    return F.lit(None).cast("string") if isinstance(kind, T.NumericType) else value.cast("string")


class Source(ABC):
    @abstractmethod
    def number(self, feature: str) -> Column: ...

    @abstractmethod
    def text(self, feature: str) -> Column: ...

    @abstractmethod
    def packed(self, features: Iterable[str]) -> dict[str, Column]:
        """Columns that hold the values of these features, for unpacked()."""

    @abstractmethod
    def unpacked(self, feature: str, prefix: str = "__") -> tuple[Column, Column]:
        """Number and text of the feature that the column `feature` names, from the columns of packed()."""


class Columns(Source):
    """A column for each feature, of the same name unless `columns` says another."""

    def __init__(self, rows: DataFrame, columns: Mapping[str, str] | None = None):
        self.kinds = {f.name: f.dataType for f in rows.schema.fields}
        self.columns = columns or {}

    def column(self, feature: str) -> str:
        return self.columns.get(feature, feature)

    def _value(self, feature: str) -> tuple[Column, T.DataType]:
        column = self.column(feature)
        if column not in self.kinds:
            raise ValueError(f"no column {column}")
        return F.col(name(column)), self.kinds[column]

    def number(self, feature):
        return _number(*self._value(feature))

    def text(self, feature):
        return _text(*self._value(feature))

    def packed(self, features):
        self.known = sorted(features)
        no = {"numbers": F.array().cast("array<double>"), "texts": F.array().cast("array<string>")}
        return {"numbers": F.array(*map(self.number, self.known)), "texts": F.array(*map(self.text, self.known))} if self.known else no

    def unpacked(self, feature, prefix="__"):
        at = F.array_position(F.array(*map(F.lit, self.known)) if self.known else F.array().cast("array<string>"), F.col(feature))
        at = F.when(at > 0, at.cast("int"))
        return F.element_at(F.col(prefix + "numbers"), at), F.element_at(F.col(prefix + "texts"), at)


class OpenMap(Source):
    """A map column from a feature's name to its value: a number, a text, or a struct (kind, num, str) that says by row
    which of them it is.  No list of features is needed, and there may be any number of them."""

    def __init__(self, rows: DataFrame, column: str):
        kind = rows.schema[column].dataType
        if not isinstance(kind, T.MapType) or not isinstance(kind.keyType, T.StringType):
            raise ValueError(f"{column} isn't a map from strings")
        self.map, self.value = name(column), kind.valueType
        self.tagged = isinstance(self.value, T.StructType)
        if self.tagged and {"kind", "num", "str"} - set(self.value.names):
            raise ValueError(f"a tagged value has kind, num and str, not {self.value.names}")

    def of(self, value: Column) -> tuple[Column, Column]:
        """Number and text of a value of the map."""
        if self.tagged:
            return _number(value["num"], self.value["num"].dataType), _text(value["str"], self.value["str"].dataType)
        return _number(value, self.value), _text(value, self.value)

    def number(self, feature):
        return self.of(F.try_element_at(F.col(self.map), F.lit(feature)))[0]

    def text(self, feature):
        return self.of(F.try_element_at(F.col(self.map), F.lit(feature)))[1]

    def packed(self, features):
        return {"map": F.col(self.map)}

    def unpacked(self, feature, prefix="__"):
        return self.of(F.try_element_at(F.col(prefix + "map"), F.col(feature)))
