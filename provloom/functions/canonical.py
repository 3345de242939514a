"""Canonical JSON and content ids: equal payloads give equal bytes and ids everywhere."""

from __future__ import annotations

import hashlib
import json
import math
import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

INDEX = re.compile("0|[1-9][0-9]{0,9}")
LONE = re.compile("[\ud800-\udfff]")
#: JSON of a VARIANT that may differ from the canonical one: numbers with exponents, of 16 signs
#: and more, below 1e-5 or with a last zero after the point; keys that are numbers; escapes by code;
#: infinite numbers.
UNLIKE = r'(?:^|[:,\[])-?(?:[0-9.]*[eE]|[0-9.]{16}|0\.0{5}|[0-9]+\.[0-9]*0(?![0-9]))|"(?:0|[1-9][0-9]*)":|"(?:-?Infinity|NaN)"|\\u'
#: Half a surrogate pair, which Spark's strings do not keep.
UNSAFE = r"\\u[dD][89a-fA-F]"


def canonical_json(**fields: Column) -> Column:
    """JSON of the fields in key order; null fields are absent, empty arrays stay.

    For strings, integers, booleans, arrays and structs built in key order; doubles,
    control characters and free-form maps go through ``canonical_metadata``.
    """
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def content_id(prefix: str, **fields: Column) -> Column:
    """``prefix:`` and the first 16 hex digits of the payload's sha256."""
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha2(canonical_json(**fields), 256), 1, 16))


def fingerprint(lines: Column, order: Column) -> Column:
    """Aggregate: sha256 of all lines joined by newlines, in the order of ``order``.

    Each row gives one line, so this is for bounded groups, one document's parts or the
    per-partition digests of ``operators.aggregate.table_fingerprint``.
    """
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), lines.alias("l"))))
    return F.sha2(F.array_join(F.transform(rows, lambda r: r["l"]), "\n"), 256)


def js_number(x: float) -> str:
    """A number as ECMAScript prints it: the shortest digits, plain from 1e-6 to 1e21."""
    if x == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(float(x))).normalize().as_tuple()
    text, k = "".join(map(str, digits)), len(digits)
    n = k + exponent
    if k <= n <= 21:
        text += "0" * (n - k)
    elif 0 < n <= 21:
        text = f"{text[:n]}.{text[n:]}"
    elif -6 < n <= 0:
        text = f"0.{'0' * -n}{text}"
    else:
        text = f"{text[0]}{'.' if k > 1 else ''}{text[1:]}e{n - 1:+d}"
    return f"-{text}" if sign else text


def _key_order(key: str):
    """Keys that are array indexes come first, by number; the others by UTF-16 code units."""
    if INDEX.fullmatch(key) and int(key) < 2**32 - 1:
        return 0, int(key), b""
    return 1, 0, key.encode("utf-16-be", "surrogatepass")


class _Done(str):
    """Text that is written already."""


def _scalar(value, nulls: bool) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(value, ensure_ascii=False))
    if isinstance(value, int):
        return str(value)
    if math.isfinite(value):
        return js_number(value)
    if nulls:
        return "null"
    raise ValueError("numbers must be finite")


def _write(value, nulls: bool) -> str:
    """Without recursion, so that depth is no matter."""
    out, todo = [], [value]
    while todo:
        v = todo.pop()
        if isinstance(v, _Done):
            out.append(v)
        elif isinstance(v, dict):
            kept = sorted((k for k in v if nulls or v[k] is not None), key=_key_order)
            pairs = [x for i, k in enumerate(kept) for x in (_Done(f"{',' if i else ''}{_scalar(k, nulls)}:"), v[k])]
            todo += [_Done("}"), *reversed(pairs), _Done("{")]
        elif isinstance(v, (list, tuple)):
            items = [x for i, item in enumerate(v) for x in ((_Done(","), item) if i else (item,))]
            todo += [_Done("]"), *reversed(items), _Done("[")]
        else:
            out.append(_scalar(v, nulls))
    return "".join(out)


def canonical_text(value) -> str:
    """The driver-side twin for single documents: sorted keys, no spaces, no absent values."""
    return _write(value, nulls=False)


def _refuse(token: str):
    raise ValueError(f"{token} is not JSON")


def canonical_of_text(text: str | None) -> str | None:
    """The canonical form of one JSON text; None for what is no JSON.  Nulls inside are values and stay.

    Numbers are doubles, as in ECMAScript; of a key that stands twice the last value counts.
    Texts nested deeper than Python's reader goes, thousands of levels, count as no JSON.
    """
    try:
        return None if text is None else _write(json.loads(text, parse_int=float, parse_constant=_refuse), nulls=True)
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(StringType())
def _canonical_texts(texts: pd.Series) -> pd.Series:
    return texts.map(canonical_of_text)


def canonical_metadata(text: Column) -> Column:
    """``canonical_of_text`` over a column of JSON texts of any shape and depth.

    VARIANT keeps the keys of objects in code-unit order at every depth, so for most texts
    its own JSON is canonical and never leaves the JVM.  Those whose JSON may be printed
    otherwise (exponents, long or tiny numbers, keys that are numbers, escapes, keys that
    stand twice) are told by a pattern that errs on the safe side and go through Arrow;
    the others are null there.
    """
    listed = F.to_json(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))))
    native = listed.substr(F.lit(2), F.length(listed) - 2)
    # VARIANT's reader stops behind the first value; what follows it can suit a list or an object, never both.
    whole = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()
    plain = listed.isNotNull() & whole & ~native.rlike(UNLIKE) & ~text.rlike(UNSAFE)
    rest = _canonical_texts(F.when(plain, F.lit(None)).otherwise(text))
    return F.when(plain, native).otherwise(rest)


def _json_value(value: Column) -> Column:
    whole = F.to_json(F.struct(value.alias("v")))
    return F.when(value.isNotNull(), whole.substr(F.lit(6), F.length(whole) - 6))


def content_id_with(prefix: str, metadata: dict[str, Column], **fields: Column) -> Column:
    """``content_id`` of fields of which some, given in ``metadata``, are JSON texts of any shape.

    A metadata text that is null or no JSON leaves its key out, as a null field does.
    """
    parts = {k: _json_value(v) for k, v in fields.items()} | {k: canonical_metadata(v) for k, v in metadata.items()}
    body = F.concat_ws(",", *[F.concat(F.lit(f"{json.dumps(k)}:"), parts[k]) for k in sorted(parts)])
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha2(F.concat(F.lit("{"), body, F.lit("}")), 256), 1, 16))


def content_id_of(prefix: str, payload) -> str:
    return f"{prefix}:{hashlib.sha256(canonical_text(payload).encode()).hexdigest()[:16]}"
