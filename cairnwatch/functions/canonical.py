"""Canonical JSON of rows, as Column functions, and hashes of it.

The form is that of a serialiser with sorted keys that writes ASCII only: `{"a": 1, "b": "x"}`.
Characters outside the printable ASCII ones are escapes of four lower-case digits, in pairs
above U+FFFF; floats are given by their fewest digits (subnormal ones by 15 at least), with an exponent from 1e16 on and
below 1e-4.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters with an escape of their own.
SHORT = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def _unit(code: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(code), 4, "0")))


def _escaped(ch: Column) -> Column:
    code = F.ascii(ch).cast("long")
    above = code - 0x10000
    pair = F.concat(_unit(F.shiftright(above, 10) + 0xD800), _unit(above.bitwiseAND(F.lit(0x3FF)) + 0xDC00))
    out = F.when(F.length(ch) == 0, "")
    for plain, escape in SHORT.items():
        out = out.when(ch == plain, escape)
    return out.when(code.between(0x20, 0x7E), ch).when(code > 0xFFFF, pair).otherwise(_unit(code))


def string(c: Column) -> Column:
    """A string in quotes; only texts with something to escape are looked at character by character."""
    whole = F.array_join(F.transform(F.split(c, ""), _escaped), "")
    return F.concat(F.lit('"'), F.when(c.rlike(r'[^ -~]|["\\]'), whole).otherwise(c), F.lit('"'))


def _let(c: Column, then: Callable[[Column], Column]) -> Column:
    """then(c), where c is worked out once however often `then` names it."""
    return F.transform(F.array(c), then)[0]


def _fewest(c: Column, choices: tuple[int, ...] = (14, 15, 16)) -> Column:
    """The first of these numbers of digits that reads back as the same number."""
    if not choices:
        return F.format_string("%.16e", c)
    return _let(F.format_string(f"%.{choices[0]}e", c), lambda t: F.when(t.cast("double") == c, t).otherwise(_fewest(c, choices[1:])))


def number(c: Column) -> Column:
    """A double by its fewest digits, and with a decimal point or an exponent."""
    sign = F.when(c < 0, "-").otherwise("")

    def parts(text: Column) -> Column:
        digits = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, r"^-?([\d.]+)e", 1), r"\.", ""), r"0+$", "")
        return F.struct(digits.alias("digits"), F.regexp_extract(text, r"e([+-]\d+)$", 1).cast("int").alias("power"))

    def shown(p: Column) -> Column:
        digits, power = F.when(p["digits"] == "", "0").otherwise(p["digits"]), p["power"]
        n = F.length(digits)
        after = F.concat(F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(""))
        wide = F.concat(after, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
        padded = F.rpad(digits, F.greatest(n, power + 1), F.lit("0"))
        rest = F.substring(padded, power + 2, F.length(padded))
        fixed = F.concat(F.substring(padded, F.lit(1), power + 1), F.lit("."), F.when(rest == "", "0").otherwise(rest))
        return F.when((power < -4) | (power >= 16), F.concat(sign, wide)).when(power < 0, F.concat(sign, small)).otherwise(F.concat(sign, fixed))

    finite = F.when(c == 0, F.when(F.format_string("%.1f", c).startswith("-"), "-0.0").otherwise("0.0")).otherwise(_let(_fewest(c), lambda t: _let(parts(t), shown)))
    return F.when(F.isnan(c), "NaN").when(c == float("inf"), "Infinity").when(c == float("-inf"), "-Infinity").otherwise(finite)


def value(c: Column, kind: T.DataType) -> Column:
    """A column in JSON, null as null; lists and structs of such too, other types as strings."""
    if isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: value(x, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, T.StructType):
        text = _object({f.name: (c[f.name], f.dataType) for f in kind.fields})
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = number(c.cast("double"))
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        text = c.cast("string")
    else:
        text = string(c.cast("string"))
    return F.when(c.isNull(), F.lit("null")).otherwise(text)


def _object(fields: dict[str, tuple[Column, T.DataType]]) -> Column:
    parts = []
    for i, (name, (c, kind)) in enumerate(sorted(fields.items())):
        parts += [F.lit("" if not i else ", "), string(F.lit(name)), F.lit(": "), value(c, kind)]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def json_text(df: DataFrame, names: list[str] | None = None) -> Column:
    """A JSON object of the named columns of df (all by default), keys in order."""
    names = df.columns if names is None else names
    return _object({n: (df[f"`{n}`"], df.schema[n].dataType) for n in names})


def key_hash(df: DataFrame, names: list[str] | None = None) -> Column:
    return F.md5(json_text(df, names))


def object_hash(df: DataFrame, names: list[str] | None = None) -> Column:
    return F.sha2(json_text(df, names), 256)


def with_hashes(df: DataFrame, json: str = "json") -> DataFrame:
    """df with key_hash and object_hash of its canonical JSON, which is written once for both."""
    return df.select("*", F.md5(json).alias("key_hash"), F.sha2(json, 256).alias("object_hash"))
