"""Operation bodies: JSON details by tag, and the columns that are promoted out of them.

A body is a struct with a nullable field for whatever any tag uses. Details are one ``to_json`` of a struct in which
every field is null unless its tag has it; ``to_json`` leaves nulls out, so each tag gets its own keys.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspring.functions import scalars as S

MUXED = "struct<base:string,muxed:string,muxed_id:decimal(20,0)>"
ASSET = "struct<kind:string,code:string,issuer:string>"
PRICE = "struct<n:bigint,d:bigint>"
BODY = (
    f"struct<destination:{MUXED},amount:bigint,asset:{ASSET},starting_balance:bigint,dest_amount:bigint,dest_asset:{ASSET},"
    f"send_asset:{ASSET},send_max:bigint,send_amount:bigint,dest_min:bigint,function_type:string,contract_id:binary,limit:bigint,selling:{ASSET},"
    f"buying:{ASSET},buy_amount:bigint,price:{PRICE},offer_id:bigint,claimants:array<struct<destination:string,predicate:variant>>,"
    "balance_type:int,balance_hash:binary,sponsored_id:string,sponsorship:struct<kind:string,account_id:string,"
    f"asset:{ASSET},pool:binary,offer_id:bigint,data_name:string,balance_type:int,balance_hash:binary,key_type:string,signer_key:string>,"
    "pool_id:binary,max_amount_a:bigint,max_amount_b:bigint,min_price:"
    f"{PRICE},max_price:{PRICE},min_amount_a:bigint,min_amount_b:bigint,extend_to:bigint>"
)

# Which keys the details of each tag have, besides type.
KEYS = {
    "payment": "destination amount asset",
    "create_account": "destination starting_balance",
    "path_payment_strict_receive": "destination dest_amount dest_asset send_asset send_max",
    "path_payment_strict_send": "destination send_amount send_asset dest_asset dest_min",
    "invoke_host_function": "function_type",
    "change_trust": "limit",
    "manage_sell_offer": "selling buying amount price offer_id",
    "manage_buy_offer": "selling buying buy_amount price offer_id",
    "create_passive_sell_offer": "selling buying amount price",
    "create_claimable_balance": "asset amount claimants",
    "claim_claimable_balance": "balance_id",
    "begin_sponsoring_future_reserves": "sponsored_id",
    "end_sponsoring_future_reserves": "",
    "revoke_sponsorship": "sponsorship_type account_id trustline_asset offer_id data_name claimable_balance_id liquidity_pool_id ledger_key_type signer_account_id signer_key",
    "liquidity_pool_deposit": "liquidity_pool_id max_amount_a max_amount_b min_price max_price",
    "liquidity_pool_withdraw": "liquidity_pool_id amount min_amount_a min_amount_b",
    "extend_footprint_ttl": "extend_to",
    "restore_footprint": "",
}
# The field behind each promoted column, by tag.
PROMOTED = {
    "payment": ("destination", "amount", "asset"),
    "create_account": ("destination", "starting_balance", None),
    "path_payment_strict_receive": ("destination", "dest_amount", "dest_asset"),
    "path_payment_strict_send": ("destination", "send_amount", "send_asset"),
    "manage_sell_offer": (None, "amount", "selling"),
    "manage_buy_offer": (None, "buy_amount", "selling"),
    "create_passive_sell_offer": (None, "amount", "selling"),
    "create_claimable_balance": (None, "amount", "asset"),
    "liquidity_pool_withdraw": (None, "amount", None),
}


def full_address(account: Column) -> Column:
    return F.coalesce(account["muxed"], account["base"])


def asset(a: Column) -> Column:
    return F.when(a.isNotNull(), S.asset_text(a["kind"], a["code"], a["issuer"]))


def price(p: Column) -> Column:
    return F.when(p.isNotNull(), S.price_text(p["n"], p["d"]))


def _sponsorship(s: Column, key: str) -> Column:
    """Keys of a revoked sponsorship, by its own kind."""
    kind = s["kind"]
    known = ("account", "trustline", "offer", "data", "claimable_balance", "liquidity_pool", "signer")
    return {
        "sponsorship_type": F.when(kind.isin(*known), kind).otherwise("unknown"),
        "account_id": F.when(kind.isin("account", "trustline", "offer", "data"), s["account_id"]),
        "trustline_asset": F.when(kind == "trustline", S.trust_line_asset(s["asset"]["kind"], s["asset"]["code"], s["asset"]["issuer"], s["pool"])),
        "offer_id": F.when(kind == "offer", s["offer_id"].cast("string")),
        "data_name": F.when(kind == "data", s["data_name"]),
        "claimable_balance_id": F.when(kind == "claimable_balance", S.balance_id(s["balance_type"], s["balance_hash"])),
        "liquidity_pool_id": F.when(kind == "liquidity_pool", S.hex_text(s["pool"])),
        "ledger_key_type": F.when(~kind.isin(*known), s["key_type"]),
        "signer_account_id": F.when(kind == "signer", s["account_id"]),
        "signer_key": F.when(kind == "signer", s["signer_key"]),
    }[key]


def details(name: Column, body: Column, predicates: Column | None = None) -> Column:
    """The details of an operation as JSON; numbers are decimal texts, and each object has ``type``.

    ``predicates`` holds the claimants' predicates as JSON texts, where they were made before.
    """
    tags_of: dict[str, list[str]] = {}
    for tag, keys in KEYS.items():
        for key in keys.split():
            tags_of.setdefault(key, []).append(tag)

    def value(key: str) -> Column:
        if key == "destination":
            return full_address(body["destination"])
        if key in ("asset", "dest_asset", "send_asset", "selling", "buying"):
            return asset(body[key])
        if key in ("price", "min_price", "max_price"):
            return price(body[key])
        if key == "balance_id":
            return S.balance_id(body["balance_type"], body["balance_hash"])
        if key in ("sponsored_id", "function_type"):
            return body[key]
        return body[key].cast("string")

    fields = [name.alias("type")]
    sponsorship = KEYS["revoke_sponsorship"].split()
    for key, tags in tags_of.items():
        if key == "claimants":
            texts = F.transform(body["claimants"], lambda c: S.predicate(c["predicate"])) if predicates is None else predicates
            claimants = F.zip_with(body["claimants"], texts, lambda c, p: F.struct(c["destination"].alias("destination"), F.parse_json(p).alias("predicate")))
            fields.append(F.when(name.isin(*tags), claimants).alias(key))
            continue
        own = [t for t in tags if t != "revoke_sponsorship"]
        choice = F.lit(None).cast("string")
        if key in sponsorship:
            choice = F.when(name == "revoke_sponsorship", _sponsorship(body["sponsorship"], key)).otherwise(choice)
        if own:
            plain = S.hex_text(body["pool_id"]) if key == "liquidity_pool_id" else value(key)
            choice = F.when(name.isin(*own), plain).otherwise(choice)
        fields.append(choice.alias(key))
    return F.to_json(F.struct(*fields))


def promoted(name: Column, body: Column) -> dict[str, Column]:
    """Columns destination, destination_muxed, destination_muxed_id, amount, asset_code, asset_issuer, contract_id,
    function_name."""
    to = [t for t, (d, _, _) in PROMOTED.items() if d]
    null = F.lit(None)
    amount, code, issuer = null.cast("bigint"), null.cast("string"), null.cast("string")
    for tag, (_, number, coin) in PROMOTED.items():
        amount = F.when(name == tag, body[number]).otherwise(amount)
        if coin:
            code = F.when(name == tag, S.asset_code(body[coin]["kind"], body[coin]["code"])).otherwise(code)
            issuer = F.when(name == tag, S.asset_issuer(body[coin]["kind"], body[coin]["issuer"])).otherwise(issuer)
    return {
        "destination": F.when(name.isin(*to), body["destination"]["base"]),
        "destination_muxed": F.when(name.isin(*to), body["destination"]["muxed"]),
        "destination_muxed_id": F.when(name.isin(*to), S.wrapped_long(body["destination"]["muxed_id"])),
        "amount": amount.cast("decimal(38,7)"),
        "asset_code": code,
        "asset_issuer": issuer,
        "contract_id": F.when(name == "invoke_host_function", S.hex_text(body["contract_id"])),
        "function_name": F.when(name == "invoke_host_function", body["function_type"]),
    }
