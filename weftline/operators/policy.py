"""Masking of fields and policy checks, as expressions the optimizer can see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

# fixed values: the digits of a token
TOKEN_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def hmac_sha256_hex(key: bytes, text: Column) -> Column:
    """HMAC-SHA256 of a string column under a key, in built-in functions."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in key))
    outer = F.lit(bytearray(b ^ 0x5C for b in key))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(text, "utf-8")), 256))), 256)


def token(key: bytes, text: Column) -> Column:
    """``tok_`` and sixteen digits made of the lowest 80 bits of the HMAC, lowest first."""
    hexed = hmac_sha256_hex(key, text)
    low, high = (F.conv(F.substring(hexed, at, 10), 16, 10).cast("bigint") for at in (55, 45))
    digit = lambda v, i: F.substring(F.lit(TOKEN_DIGITS), (F.shiftright(v, 5 * i).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
    return F.concat(F.lit("tok_"), *[digit(low, i) for i in range(8)], *[digit(high, i) for i in range(8)])


def mask(column: Column, scheme: str, key: bytes = b"") -> Column:
    """A field under a scheme: redact, suppress, generalize, one_way_hash, token; an unknown scheme redacts.  Null stays null."""
    text = column.cast("string")
    if scheme == "suppress":
        return F.lit(None).cast("string")
    if scheme == "generalize":
        out = F.concat(F.substring(text, 1, 1), F.repeat(F.lit("*"), F.greatest(F.length(text) - 1, F.lit(0))))
    elif scheme == "one_way_hash":
        out = F.concat(F.lit("sha256:"), F.substring(F.sha2(F.encode(text, "utf-8"), 256), 1, 32))
    elif scheme == "token":
        out = token(key, text)
    else:
        out = F.lit("[REDACTED]")
    return F.when(column.isNotNull(), out)


def mask_frame(df: DataFrame, fields: dict[str, str], key: bytes = b"", depth: int = 6) -> DataFrame:
    """Every field of the given names masked, at the top and in structs and arrays of structs down to ``depth``.

    The schema is walked once on the driver; the rows see only built-in expressions.
    """

    def walk(column: Column, kind: DataType, left: int) -> Column:
        if isinstance(kind, StructType) and left:
            parts = [(mask(column[f.name], fields[f.name], key) if f.name in fields else walk(column[f.name], f.dataType, left - 1)).alias(f.name) for f in kind.fields]
            return F.when(column.isNotNull(), F.struct(*parts))
        if isinstance(kind, ArrayType) and left:
            return F.transform(column, lambda x: walk(x, kind.elementType, left - 1))
        return column

    return df.select(*[(mask(F.col(f"`{f.name}`"), fields[f.name], key) if f.name in fields else walk(F.col(f"`{f.name}`"), f.dataType, depth)).alias(f.name) for f in df.schema.fields])


def forbidden_mixture(df: DataFrame, keys: list[str], topic: str, forbidden: list[set[str]]) -> DataFrame:
    """keys, verdict, mixture: deny with the first forbidden set that lies wholly within a key's topics, else allow."""
    held = df.groupBy(*keys).agg(F.collect_set(topic).alias("_t"))
    verdict = F.lit(None).cast("string")
    for topics in reversed([sorted(x) for x in forbidden]):
        names = F.array(*[F.lit(x) for x in topics])
        verdict = F.when(F.size(F.array_except(names, F.col("_t"))) == 0, F.lit(",".join(topics))).otherwise(verdict)
    return held.select(*keys, F.when(verdict.isNull(), "allow").otherwise("deny").alias("verdict"), verdict.alias("mixture"))


def reasons(rules: dict[str, Column]) -> Column:
    """Every rule that speaks against a row, in order of the rules; an empty list admits it.  A rule that is null speaks against it."""
    return F.filter(F.array(*[F.when(F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
