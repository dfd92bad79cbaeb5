"""Database types as Spark types, with how much of a type is kept; and coercion of written values."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Mapped:
    """`fidelity` is lossless, equivalent, lossy or best effort."""

    dtype: T.DataType
    fidelity: str = "lossless"
    note: str = ""


_SIGNED = {"tinyint": T.ByteType(), "smallint": T.ShortType(), "int2": T.ShortType(), "mediumint": T.IntegerType(), "int": T.IntegerType(), "integer": T.IntegerType(), "int4": T.IntegerType(), "bigint": T.LongType(), "int8": T.LongType(), "serial": T.IntegerType(), "bigserial": T.LongType(), "year": T.ShortType()}
_UNSIGNED = {"tinyint": T.ShortType(), "smallint": T.IntegerType(), "mediumint": T.IntegerType(), "int": T.LongType(), "integer": T.LongType(), "bigint": T.DecimalType(20, 0)}
_PLAIN = {
    "float": T.FloatType(), "real": T.FloatType(), "float4": T.FloatType(), "double": T.DoubleType(), "double precision": T.DoubleType(), "float8": T.DoubleType(),
    "boolean": T.BooleanType(), "bool": T.BooleanType(), "date": T.DateType(), "datetime": T.TimestampNTZType(), "timestamptz": T.TimestampType(),
    "char": T.StringType(), "character": T.StringType(), "bpchar": T.StringType(), "varchar": T.StringType(), "character varying": T.StringType(), "text": T.StringType(), "tinytext": T.StringType(), "mediumtext": T.StringType(), "longtext": T.StringType(),
    "binary": T.BinaryType(), "varbinary": T.BinaryType(), "blob": T.BinaryType(), "tinyblob": T.BinaryType(), "mediumblob": T.BinaryType(), "longblob": T.BinaryType(), "bytea": T.BinaryType(),
}
_NEAR = {
    "uuid": (T.StringType(), "lower-case text"), "json": (T.StringType(), "text with sorted keys for hashing"), "jsonb": (T.StringType(), "text with sorted keys for hashing"),
    "enum": (T.StringType(), "values are kept in the catalog"), "set": (T.ArrayType(T.StringType()), "values are kept in the catalog"), "inet": (T.StringType(), "text"), "cidr": (T.StringType(), "text"), "macaddr": (T.StringType(), "text"),
    "bit": (T.StringType(), "zeros and ones"), "geometry": (T.BinaryType(), "well-known binary"), "point": (T.BinaryType(), "well-known binary"), "time": (T.LongType(), "microseconds of the day"), "timetz": (T.StringType(), "ISO text"),
    "interval": (T.StructType([T.StructField("months", T.IntegerType()), T.StructField("days", T.IntegerType()), T.StructField("micros", T.LongType())]), "months, days and microseconds"),
}


def spark_type(declared: str) -> Mapped:
    """The Spark type of a MySQL or PostgreSQL column type as it is declared."""
    text = re.sub(r"\s+", " ", declared.strip().lower())
    if text.endswith("[]"):
        inner = spark_type(text[:-2])
        return Mapped(T.ArrayType(inner.dtype), inner.fidelity, inner.note)
    unsigned = " unsigned" in text
    base = re.sub(r"\(.*?\)", "", text).replace(" unsigned", "").replace(" zerofill", "").replace(" auto_increment", "").strip()
    sizes = [int(n) for n in re.findall(r"\d+", (re.search(r"\(([\d, ]+)\)", text) or ["", ""])[1])]
    if base == "tinyint" and sizes == [1] and not unsigned:
        return Mapped(T.BooleanType(), "equivalent", "0 and 1")
    if base in _SIGNED:
        return Mapped(_UNSIGNED[base], "equivalent", "the next wider signed type") if unsigned and base in _UNSIGNED else Mapped(_SIGNED[base])
    if base in ("decimal", "numeric", "dec"):
        p, s = (*sizes, 0)[:2] if sizes else (38, 18)
        return Mapped(T.DecimalType(min(p, 38), min(s, 38)), "lossless" if sizes and p <= 38 else "lossy", "" if sizes and p <= 38 else "38 digits at most")
    if base.startswith("timestamp"):
        return Mapped(T.TimestampType() if "with time zone" in base or base == "timestamptz" else T.TimestampNTZType())
    if base in _PLAIN:
        return Mapped(_PLAIN[base])
    if base in _NEAR:
        dtype, note = _NEAR[base]
        return Mapped(dtype, "equivalent", note)
    return Mapped(T.StringType(), "best effort", f"{base} is not known")


#: Texts that count as true and as false.
TRUE, FALSE = ("1", "t", "true", "y", "yes", "on"), ("0", "f", "false", "n", "no", "off")


def coerced(column: Column, have: T.DataType, want: T.DataType) -> Column:
    """A value as the type of the column it is written to: booleans by their words, fractions cut, and
    null where a value can't be read."""
    if have == want:
        return column
    if isinstance(want, T.BooleanType) and isinstance(have, T.StringType):
        word = F.lower(F.trim(column))
        return F.when(word.isin(*TRUE), True).when(word.isin(*FALSE), False)
    if isinstance(want, T.IntegralType) and isinstance(have, T.StringType):
        return column.try_cast("decimal(38,18)").try_cast(want)
    if isinstance(want, T.StringType) and isinstance(have, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(column)
    return column.try_cast(want)


_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def conversion(have: T.DataType, want: T.DataType) -> dict[str, object] | None:
    """What writing a value of one type to a column of another takes: how (implicit, explicit or by a
    function), whether it is safe, and a note. None where the types are equal."""
    if have == want:
        return None
    whole, to_whole = isinstance(have, _NUMBERS), isinstance(want, _NUMBERS)
    real, to_real = isinstance(have, (T.FloatType, T.DoubleType)), isinstance(want, (T.FloatType, T.DoubleType))
    how, lost = "explicit", ""
    if whole and to_whole:
        narrower = _NUMBERS.index(type(want)) < _NUMBERS.index(type(have))
        how, lost = ("explicit", "large numbers don't fit") if narrower else ("implicit", "")
    elif whole and (to_real or isinstance(want, T.DecimalType)):
        how = "implicit"
    elif (real or isinstance(have, T.DecimalType)) and to_whole:
        lost = "fractions are cut"
    elif isinstance(have, T.DoubleType) and isinstance(want, T.FloatType):
        lost = "digits are lost"
    elif real and to_real:
        how = "implicit"
    elif isinstance(have, T.DecimalType) and isinstance(want, T.DecimalType):
        lost = "digits are lost" if want.scale < have.scale or want.precision - want.scale < have.precision - have.scale else ""
        how = "explicit" if lost else "implicit"
    elif isinstance(have, T.TimestampType) and isinstance(want, (T.TimestampNTZType, T.DateType)):
        lost = "the time zone is lost"
    elif isinstance(have, T.TimestampNTZType) and isinstance(want, T.DateType):
        lost = "the time of day is lost"
    elif isinstance(have, _TIMES) and isinstance(want, T.StringType):
        how, lost = "date_format", "a text depends on its format"
    elif isinstance(have, (T.ArrayType, T.StructType, T.MapType)) and isinstance(want, T.StringType):
        how, lost = "to_json", "a text depends on its format"
    elif isinstance(have, T.StringType) and isinstance(want, _TIMES):
        how = "to_timestamp"
    elif isinstance(have, T.BinaryType) and isinstance(want, T.StringType):
        how = "decode"
    note = f"{have.simpleString()} to {want.simpleString()}" + (f": {lost}" if lost else "")
    return {"from": have.simpleString(), "to": want.simpleString(), "how": how, "safe": not lost, "note": note}
