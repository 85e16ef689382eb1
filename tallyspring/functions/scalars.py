"""Scalar expressions over decoded ledger values. All are built-in Spark expressions; none needs a user function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the ledger format: memo types, success codes, operations that run contract code, asset kinds.
MEMO_TEXT, MEMO_ID, MEMO_HASH, MEMO_RETURN = 1, 2, 3, 4
SUCCESS_CODES = ("tx_success", "tx_fee_bump_inner_success")
CONTRACT_OPERATIONS = ("invoke_host_function", "extend_footprint_ttl", "restore_footprint")
ASSET_NATIVE, ASSET_ISSUED, ASSET_CONTRACT = 0, 1, 2
NATIVE_CODE = "XLM"
EVENT_CODES = {"transfer": 0, "mint": 1, "burn": 2, "clawback": 3, "fee": 4}


#: Seconds of the years 1 to 9999, outside which a time counts as unreadable.
FIRST_SECOND, LAST_SECOND = -62_135_596_800, 253_402_300_799
#: A whole RFC 3339 time: date, ``T``, time of day, and ``Z`` or an offset.
RFC_3339 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,9})?(Z|[+-][0-9]{2}:[0-9]{2})$"


def parse_time(text: Column) -> Column:
    """A timestamp from epoch seconds as text, else from RFC 3339; null when neither parses.

    The whole text has to be a number for the first form, so a date isn't read as its year, and a whole date, time and
    zone for the second, so nothing is filled in from the clock. Times outside the years 1 to 9999 are null.
    """
    written = F.try_to_timestamp(F.when(text.rlike(RFC_3339), text))
    seconds = F.unix_seconds(written)
    return F.when(text.rlike(r"^-?[0-9]+$"), epoch_time(text.try_cast("bigint"))).when(seconds.between(FIRST_SECOND, LAST_SECOND), written)


def epoch_time(seconds: Column) -> Column:
    """Null outside the years 1 to 9999."""
    return F.timestamp_seconds(F.when(seconds.between(FIRST_SECOND, LAST_SECOND), seconds))


def transaction_digest(domain: Column, payload: Column) -> Column:
    """Lower-hex SHA-256 of the payload, separated by network: the domain's own digest goes before it."""
    return F.sha2(F.concat(F.unhex(F.sha2(domain, 256)), payload), 256)


def memo_text(kind: Column, text: Column, id_: Column) -> Column:
    return F.when(kind == MEMO_TEXT, text).when(kind == MEMO_ID, id_.cast("string"))


def memo_hash(kind: Column, hash_: Column) -> Column:
    return F.when(kind.isin(MEMO_HASH, MEMO_RETURN), F.lower(F.hex(hash_)))


def status_flag(code: Column) -> Column:
    return F.coalesce(code.isin(*SUCCESS_CODES), F.lit(False)).cast("smallint")


def snake_case(name: Column) -> Column:
    """A blank ``_`` goes before each capital but the first character."""
    return F.lower(F.regexp_replace(name, r"(?<!^)([A-Z])", "_$1"))


def type_name(name: Column, code: Column, prefix: str = "OperationType") -> Column:
    short = snake_case(F.regexp_replace(name, f"^{prefix}", ""))
    return F.when(F.coalesce(short, F.lit("")) == "", F.concat(F.lit("unknown_"), code.cast("string"))).otherwise(short)


def hex_text(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def base64_text(raw: Column) -> Column:
    """On one line: the built-in breaks long results."""
    return F.regexp_replace(F.base64(raw), r"[\r\n]", "")


def prefixed_hex(raw: Column) -> Column:
    return F.concat(F.lit("0x"), hex_text(raw))


def wrapped_long(unsigned: Column) -> Column:
    """An unsigned 64-bit value as the signed one with the same bits."""
    wide = unsigned.cast("decimal(20,0)")
    number = lambda n: F.lit(str(n)).cast("decimal(20,0)")
    return F.when(wide > number(2**63 - 1), wide - number(2**64)).otherwise(wide).cast("bigint")


def trimmed_code(code: Column) -> Column:
    return F.regexp_replace(code, r"\x00+$", "")


def asset_text(kind: Column, code: Column, issuer: Column) -> Column:
    """``native``, ``CODE:ISSUER`` or ``unknown``."""
    return F.when(kind == "native", "native").when(kind == "issued", F.concat_ws(":", trimmed_code(code), issuer)).otherwise("unknown")


def asset_code(kind: Column, code: Column) -> Column:
    return F.when(kind == "native", NATIVE_CODE).when(kind == "issued", trimmed_code(code))


def asset_issuer(kind: Column, issuer: Column) -> Column:
    return F.when(kind == "issued", issuer)


def trust_line_asset(kind: Column, code: Column, issuer: Column, pool: Column) -> Column:
    return F.when(kind == "pool_share", F.concat(F.lit("liquidity_pool:"), hex_text(pool))).otherwise(asset_text(kind, code, issuer))


def balance_id(kind: Column, hash_: Column) -> Column:
    return F.concat(F.lpad(hex_text(kind), 8, "0"), hex_text(hash_))


def asset_class(kind: Column) -> Column:
    """Contract token where there is no asset, issued, else native."""
    return F.when(kind.isNull(), ASSET_CONTRACT).when(kind == "issued", ASSET_ISSUED).otherwise(ASSET_NATIVE).cast("smallint")


def price_text(n: Column, d: Column) -> Column:
    return F.concat_ws("/", n.cast("string"), d.cast("string"))


def null_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def json_string(text: Column) -> Column:
    """A text as a quoted JSON string."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def bound(value: Column, fn: Callable[[Column], Column], kind: str = "string") -> Column:
    """``fn`` of a value that is worked out once, however often ``fn`` names it. ``kind`` is the type of the result.

    A fold over one item: ``get`` of a transformed array would ask the whole of ``fn`` for its type on every row.
    """
    return F.aggregate(F.array(value), F.lit(None).cast(kind), lambda _, x: fn(x))


def predicate(value: Column, depth: int = 6) -> Column:
    """A claim predicate, held as VARIANT, as a JSON text.

    Input nodes are objects with ``kind`` (unconditional, and, or, not, abs_before, rel_before), ``of`` (operands) and
    ``at``. A Spark struct can't nest in itself, so the expression is unrolled to ``depth`` levels; deeper trees give
    null, for quarantine. A missing operand of ``not`` stays as a JSON null.
    """

    get = F.try_variant_get

    def walk(v: Column, left: int) -> Column:
        kind = get(v, "$.kind", "string")
        out = F.when(v.isNull() | F.is_variant_null(v), F.lit("null")).when(kind == "unconditional", F.lit('{"unconditional":true}'))
        out = out.when(kind.isin("abs_before", "rel_before"), F.concat(F.lit('{"'), kind, F.lit('":"'), get(v, "$.at", "string"), F.lit('"}')))
        if left:
            # one list of texts for all kinds, so the expression grows with the depth only
            operands = F.transform(get(v, "$.of", "array<variant>"), lambda x: walk(x, left - 1))
            joined = F.get(F.transform(F.array(F.struct(kind.alias("kind"), operands.alias("operands"))), lambda s: _labelled(s["kind"], s["operands"])), F.lit(0))
            out = out.when(kind.isin("and", "or", "not"), joined)
        else:
            out = out.when(kind.isin("and", "or", "not"), F.lit(None).cast("string"))
        return out.otherwise(F.lit('{"unknown":true}'))

    return walk(value, depth)


def _labelled(kind: Column, operands: Column) -> Column:
    """``{"kind":operand}`` for ``not``, ``{"kind":[operands]}`` else; null if an operand is too deep."""
    inner = F.array_join(operands, ",")
    text = F.concat(F.lit('{"'), kind, F.lit('":'), F.when(kind == "not", inner).otherwise(F.concat(F.lit("["), inner, F.lit("]"))), F.lit("}"))
    return F.when(F.exists(operands, lambda x: x.isNull()), F.lit(None).cast("string")).otherwise(text)


def display(value: Column, depth: int = 6, *, low_word: bool = False) -> Column:
    """A contract value, held as VARIANT (``type``, ``v``; wide numbers as ``hi`` and ``lo``), as a display text.

    Lists read ``[a,b]`` and maps ``{k:v,b:w}``. With more than ``depth`` levels of them, or with an item that can't be
    shown, the whole result is null, for quarantine. ``low_word`` shows only the lower 64 bits of 128-bit numbers.
    """
    text = lambda v, path, kind="string": F.try_variant_get(v, path, kind)
    wide = "decimal(38,0)"

    def walk(v: Column, left: int) -> Column:
        return bound(text(v, "$.type"), lambda kind: told(v, kind, left))

    def told(v: Column, kind: Column, left: int) -> Column:
        low, high = text(v, "$.lo").try_cast(wide), text(v, "$.hi").try_cast(wide)
        full = low if low_word else F.try_add(F.try_multiply(high, F.lit(str(2**64)).cast(wide)), low)
        out = F.when(kind.isin("symbol", "string", "address", "i64", "u64"), text(v, "$.v"))
        if left:
            items = text(v, "$.v", "array<variant>")
            sides = F.flatten(F.transform(items, lambda x: F.array(text(x, "$.key", "variant"), text(x, "$.val", "variant"))))
            # one list of texts for lists and maps, so the expression grows with the depth only
            texts = F.transform(F.when(kind == "map", sides).otherwise(items), lambda x: walk(x, left - 1))
            out = out.when(kind.isin("vec", "map"), bound(texts, lambda t: _enclosed(kind, t)))
        else:
            out = out.when(kind.isin("vec", "map"), F.lit(None).cast("string"))
        out = out.when(kind == "bool", F.when(text(v, "$.v", "boolean"), "true").otherwise("false")).when(kind == "void", "void").when(kind == "error", F.concat(F.lit("error:"), F.coalesce(text(v, "$.v"), F.lit(""))))
        out = out.when(kind.isin("i128", "u128"), full.cast("string")).when(kind == "bytes", F.concat(F.lit("0x"), text(v, "$.v")))
        return out.otherwise(F.concat(F.lit("scval_type_"), F.coalesce(text(v, "$.code"), kind)))

    return walk(value, depth)


def _enclosed(kind: Column, texts: Column) -> Column:
    """``[a,b]``, or ``{k:v,b:w}`` for a map, whose keys and values take turns; null if a text is."""
    after = F.transform(texts, lambda x, i: F.concat(F.when(i == 0, "").when((kind == "map") & (i % 2 == 1), ":").otherwise(","), x))
    inner = F.array_join(after, "")
    text = F.when(kind == "map", F.concat(F.lit("{"), inner, F.lit("}"))).otherwise(F.concat(F.lit("["), inner, F.lit("]")))
    return F.when(F.exists(texts, lambda x: x.isNull()), F.lit(None).cast("string")).otherwise(text)


def topic(topics: Column, i: int) -> Column:
    return F.get(topics, F.lit(i))


def versioned_events(version: Column, v3: Column, operations: Column) -> Column:
    """The events of a transaction: its own list in version 3, its operations' lists in a row in version 4, else none."""
    none = F.filter(v3, lambda x: F.lit(False))
    return F.when(version == 3, v3).when(version == 4, F.flatten(F.transform(operations, lambda o: o["events"]))).otherwise(none)
