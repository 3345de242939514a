"""Identifiers and the normal forms they are built from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ADDRESS = r"^0x[0-9a-fA-F]{40}$"


def _require(valid: Column, value: Column, message: str) -> Column:
    return F.when(valid, value).otherwise(F.raise_error(F.lit(message)))


def normal_address(c: Column) -> Column:
    return _require(F.trim(c).rlike(ADDRESS), F.lower(F.trim(c)), "address must be 0x and 40 hex digits")


def normal_chain(c: Column) -> Column:
    return _require(F.trim(c) != "", F.lower(F.trim(c)), "chain id must not be empty")


def normal_name(c: Column) -> Column:
    return _require(F.trim(c) != "", F.trim(c), "name must not be empty")


def normal_path(c: Column) -> Column:
    """Segments without empty and ``.`` ones, lower-cased, joined by ``__``, the rest as ``_``."""
    parts = F.filter(F.split(F.translate(c, "\\", "/"), "/"), lambda s: (s != "") & (s != "."))
    return F.regexp_replace(F.array_join(F.transform(parts, lambda s: F.lower(s)), "__"), "[^a-z0-9_]", "_")


def contract_id(name: Column, source_file: Column | None = None, chain: Column | None = None, address: Column | None = None) -> Column:
    """By address if there is one, else by source file, else by name."""
    nothing = F.lit(None).cast("string")
    source_file, chain, address = (nothing if x is None else x for x in (source_file, chain, address))
    return (
        F.when(address.isNotNull(), F.concat_ws(":", F.lit("contract"), normal_chain(chain), normal_address(address)))
        .when(source_file.isNotNull(), F.concat_ws(":", F.lit("contract"), normal_path(source_file), F.lower(normal_name(name))))
        .otherwise(F.concat_ws(":", F.lit("contract"), normal_name(name)))
    )


def function_id(contract: Column, signature: Column) -> Column:
    return F.concat_ws(":", F.lit("function"), contract, signature)


def state_id(contract: Column, name: Column) -> Column:
    return F.concat_ws(":", F.lit("state"), contract, normal_name(name))


def signature(name: Column, types: Column) -> Column:
    """``name(type,type)`` with all white space taken out of the types."""
    return F.concat(name, F.lit("("), F.array_join(F.transform(types, lambda t: F.regexp_replace(t, r"\s+", "")), ","), F.lit(")"))
