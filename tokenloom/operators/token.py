"""The token value and its Spark schema."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import types as T

from tokenloom.functions.chars import is_placeholder


class Casing(str, Enum):
    NONE = "N"
    LOWERCASE = "L"
    UPPERCASE = "U"
    MIXED = "M"
    CAPITALIZED = "C"

    @classmethod
    def of(cls, code: str) -> Casing:
        return cls._value2member_map_.get(code, cls.NONE)


class TokenType(str, Enum):
    WORD = "WORD"
    LEADING_SUBWORD = "LEADING_SUBWORD"
    TRAILING_SUBWORD = "TRAILING_SUBWORD"


@dataclass
class Token:
    surface: str = ""
    type: TokenType = TokenType.WORD
    casing: Casing = Casing.NONE
    join_left: bool = False
    join_right: bool = False
    spacer: bool = False
    preserve: bool = False
    features: list[str] | None = field(default=None)

    def is_placeholder(self) -> bool:
        return is_placeholder(self.surface)

    def __len__(self) -> int:
        return len(self.surface)

    def __bool__(self) -> bool:
        return True

    def __hash__(self) -> int:
        return hash((*self.as_tuple()[:7], tuple(self.features or ())))

    def __repr__(self) -> str:
        said = [f"'{self.surface}'"]
        said += [f"type=TokenType.{self.type.name}"] if self.type != TokenType.WORD else []
        said += [f"{name}=True" for name in ("join_left", "join_right", "spacer", "preserve") if getattr(self, name)]
        said += [f"features={self.features}"] if self.features else []
        said += [f"casing=Casing.{self.casing.name}"] if self.casing != Casing.NONE else []
        return f"Token({', '.join(said)})"

    def as_tuple(self) -> tuple:
        return self.surface, self.type.value, self.casing.value, self.join_left, self.join_right, self.spacer, self.preserve, list(self.features) if self.features else []

    @classmethod
    def from_row(cls, row) -> Token:
        return cls(row["surface"], TokenType(row["type"]), Casing.of(row["casing"]), row["join_left"], row["join_right"], row["spacer"], row["preserve"], list(row["features"]) if row["features"] else None)


TOKEN_SCHEMA = T.StructType([
    T.StructField("surface", T.StringType()), T.StructField("type", T.StringType()), T.StructField("casing", T.StringType()), T.StructField("join_left", T.BooleanType()),
    T.StructField("join_right", T.BooleanType()), T.StructField("spacer", T.BooleanType()), T.StructField("preserve", T.BooleanType()), T.StructField("features", T.ArrayType(T.StringType())),
])
