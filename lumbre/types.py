"""Declared column types, guarded conversions and type promotion."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumbre.errors import EngineError

# Names of declared types, their Spark type, and the roles.
DECLARED = {"numerica": T.DoubleType(), "categorica": T.StringType(), "binaria": T.StringType(), "texto": T.StringType(), "fecha": T.StringType()}
SQL_TYPES = {"entero": T.LongType(), "real": T.DoubleType(), "texto": T.StringType(), "booleano": T.BooleanType()}
ROLES = ("variable", "entrada_categorica", "salida_binaria")
TRUE_WORDS = ("1", "true", "verdadero", "yes", "si")
FALSE_WORDS = ("0", "false", "falso", "no")
#: A finite decimal number, blanks and tabs around it allowed.
NUMBER = r"^[ \t]*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?[ \t]*$"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"


def safe_number(text: Column) -> Column:
    """Text as a finite double, else null. Spark's own cast also takes suffixes, infinities and NaN."""
    value = F.when(text.rlike(NUMBER), F.trim(F.translate(text, "\t", " ")).try_cast("double"))
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def iso_date(text: Column) -> Column:
    """Text of the form YYYY-MM-DD that names a day of the calendar, else null."""
    return F.when(text.rlike(ISO_DATE), F.try_to_date(text, "yyyy-MM-dd"))


def binary(text: Column) -> Column:
    """true, false, or null for the empty text and for anything else; see `binary_state`."""
    low = F.lower(text)
    return F.when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False)


def binary_state(text: Column) -> Column:
    """true, false, null or invalid, as text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low == "", "null").when(low.isin(*TRUE_WORDS), "true").when(low.isin(*FALSE_WORDS), "false").otherwise("invalid")


# Risk names, each with the spellings that it is read from.
RISKS = {
    "caida": ("caida", "caída"),
    "quimico": ("quimico", "químico"),
    "electrico": ("electrico", "eléctrico"),
    "corte": ("corte",),
    "ruido": ("ruido",),
    "ergonomico": ("ergonomico", "ergonómico"),
    "biologico": ("biologico", "biológico"),
}


def risk_name(text: Column) -> Column:
    """The risk that a label names; anything else is `desconocido`."""
    low = F.lower(text)
    out = F.lit("desconocido")
    for name, spellings in RISKS.items():
        out = F.when(low.isin(*spellings), name).otherwise(out)
    return out


@dataclass
class Schema:
    """Declared columns in order, with roles. A column without declaration is text."""

    types: dict[str, str] = field(default_factory=dict)
    roles: dict[str, str] = field(default_factory=dict)

    def declare(self, name: str, kind: str, role: str = "variable") -> Schema:
        if kind not in DECLARED:
            raise EngineError("TYPE", f"unknown type {kind}")
        if role not in ROLES:
            raise EngineError("ARGUMENT", f"unknown role {role}")
        self.types[name] = kind
        self.roles[name] = role
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        """Text columns to declared types: the empty text is null everywhere, text that is no number is null in a numeric column."""
        for name in self.types:
            if name not in df.columns:
                raise EngineError("DATA", f"declared column {name} is missing")
        out = []
        for name in df.columns:
            kind = self.types.get(name, "texto")
            text = F.nullif(F.col(f"`{name}`"), F.lit(""))
            col = safe_number(text) if kind == "numerica" else text
            out.append(col.alias(name, metadata={"tipo": kind, "rol": self.roles.get(name, "variable")}))
        return df.select(*out)


def as_text(df: DataFrame) -> DataFrame:
    """Every column as text, booleans in Spanish."""
    return df.select(*(F.when(F.col(f"`{c}`"), "verdadero").when(~F.col(f"`{c}`"), "falso").alias(c) if kind == "boolean" else F.col(f"`{c}`").cast("string").alias(c) for c, kind in df.dtypes))


# Widths of the numeric types, for promotion.
_SIGNED = {"int8": 8, "int16": 16, "int32": 32, "int64": 64}
_UNSIGNED = {"uint8": 8, "uint16": 16, "uint32": 32, "uint64": 64}
SPARK_TYPE = {"bool": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)", "float32": "float", "float64": "double", "complex64": "struct<re:float,im:float>", "complex128": "struct<re:double,im:double>"}


def promote(left: str, right: str) -> str:
    """The type that holds the values of both, by NumPy's rules; complex types take no part in arithmetic."""
    if left.startswith("complex") or right.startswith("complex"):
        raise EngineError("UNSUPPORTED", "no arithmetic on complex values")
    if left == right:
        return left
    if "bool" in (left, right):
        return right if left == "bool" else left
    if "float64" in (left, right):
        return "float64"
    if "float32" in (left, right):
        other = right if left == "float32" else left
        return "float32" if other in ("int8", "int16", "uint8", "uint16") else "float64"
    if left in _SIGNED and right in _SIGNED or left in _UNSIGNED and right in _UNSIGNED:
        widths = _SIGNED | _UNSIGNED
        return max(left, right, key=widths.__getitem__)
    signed, unsigned = (left, right) if left in _SIGNED else (right, left)
    if _SIGNED[signed] > _UNSIGNED[unsigned]:
        return signed
    return {8: "int16", 16: "int32", 32: "int64", 64: "float64"}[_UNSIGNED[unsigned]]
