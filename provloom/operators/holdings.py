"""Relations between assets that one contract holds, and claims on the tokens behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provloom.functions.canonical import content_id
from provloom.operators import graph, resolve
from provloom.operators.assets import FEE_PINS, REPRESENTATIONS, abi_signatures
from provloom.storage import Scratch

#: The relation of two classes held together, by the classes of its sides.
PAIR_RULES = {
    "assets_shares": (["erc20", "erc721", "erc1155"], ["share"]),
    "debt_collateral": (["debt"], ["collateral"]),
    "reserves_liquidity": (["erc20", "erc721", "erc1155"], ["lp"]),
    "rewards_eligible_stake": (["reward"], ["receipt"]),
}
#: Fixed value: what a token must offer for claims on it.
ENTITLEMENT = "balanceOf(address)"


def accounting_pairs(assets: DataFrame, accesses: DataFrame) -> DataFrame:
    """Relations (id, relation_kind, endpoints, derivation, accessors, basis) of assets in one contract.

    assets: asset_id, state_var_id, contract_id, asset_type, basis; accesses: (source, target)
    of functions and the variables they read or write.  Being held together is not enough:
    some function must access both.  Each side keeps only the classes that a rule names.
    """
    scratch = Scratch(assets.sparkSession, "pairs")
    named = sorted({t for sides in PAIR_RULES.values() for side in sides for t in side})
    held = scratch.keep(assets.where(F.col("asset_type").isin(named)).select("asset_id", F.col("state_var_id").alias("target"), "contract_id", "asset_type", "basis"), "held")
    # Rules count whose two sides are there; what is in use is met once, for both sides.
    there = {r["asset_type"] for r in held.select("asset_type").distinct().collect()}
    rules = assets.sparkSession.createDataFrame([(k, a, b) for k, (left, right) in PAIR_RULES.items() for a in left for b in right if {a, b} <= there], "relation_kind string, l_type string, r_type string")
    sides = held.drop("basis").join(F.broadcast(rules.select(F.explode(F.array("l_type", "r_type")).alias("asset_type")).distinct()), "asset_type", "left_semi")
    used = scratch.keep(accesses.select("source", "target").distinct().join(sides.hint("shuffle_hash"), "target").select("contract_id", "source", "asset_id", "asset_type"), "used")
    left, right = (used.select("contract_id", "source", F.col("asset_id").alias(f"{p}_asset"), F.col("asset_type").alias(f"{p}_type")).join(F.broadcast(rules.select("relation_kind", f"{p}_type").distinct()), f"{p}_type") for p in "lr")
    both = left.join(F.broadcast(rules.select("relation_kind", "l_type", "r_type")), ["relation_kind", "l_type"]).join(right, ["contract_id", "source", "relation_kind", "r_type"])
    pairs = both.groupBy("contract_id", "relation_kind", "l_asset", "r_asset").agg(F.array_sort(F.collect_set("source")).alias("accessors"))
    for p in "lr":
        pairs = pairs.join(held.select(F.col("asset_id").alias(f"{p}_asset"), F.col("basis").alias(f"{p}_basis")), f"{p}_asset")
    made = pairs.withColumn("endpoints", F.array_sort(F.array_distinct(F.array("l_asset", "r_asset")))).withColumn("derivation", F.lit("paired-storage"))
    basis = F.array_sort(F.array_distinct(F.concat("l_basis", "r_basis", "accessors", F.array("contract_id"))))
    return made.select(content_id("semacc", derivation=F.col("derivation"), endpoints=F.col("endpoints"), relation_kind=F.col("relation_kind")).alias("id"), "relation_kind", "endpoints", "derivation", "accessors", basis.alias("basis"))


def claims(assets: DataFrame, contracts: DataFrame, functions: DataFrame, relationships: DataFrame, uses: DataFrame) -> DataFrame:
    """Claims (id, holder_ref, claim_on, via, basis): who reads a representation holds a claim on its token.

    ``uses`` are READS of variables and CALLS of functions.  A reader reads the variable of
    the representation or calls the balance function of its class's closure; the token's
    own closure must offer that function too.
    """
    named = resolve.unique_by_name(contracts.select("id", "name"), "name").where("unique").select("name", F.col("id").alias("type_contract"))
    balance = abi_signatures(contracts, functions, relationships).where(F.col("signature") == ENTITLEMENT).select(F.col("contract").alias("type_contract"), "function").distinct()
    typed = assets.join(named, "name")
    tokens = typed.join(balance, "type_contract", "left_semi").select(F.col("asset_id").alias("claim_on"), F.col("state_var_id").alias("_token_var"), F.col("type_contract").alias("_token_type"))
    standing = typed.where(F.col("asset_type").isin(REPRESENTATIONS)).withColumnRenamed("represents_asset_id", "claim_on").join(tokens, "claim_on")
    standing = Scratch(assets.sparkSession, "claims").keep(standing.select(F.col("asset_id").alias("via"), "claim_on", "state_var_id", "type_contract", "_token_var", "_token_type"), "standing")
    reads = uses.where("type = 'READS'").select(F.col("source").alias("holder_ref"), F.col("target").alias("state_var_id")).distinct()
    # A function is called many times and lies in many closures: each caller meets only the closures of representations, once.
    callers = uses.where("type = 'CALLS'").select(F.col("source").alias("holder_ref"), F.col("target").alias("function")).distinct()
    calls = callers.join(balance.join(standing.select("type_contract").distinct(), "type_contract", "left_semi"), "function").select("holder_ref", "type_contract").distinct()
    found = standing.join(reads, "state_var_id").select(*standing.columns, "holder_ref").unionByName(standing.join(calls, "type_contract").select(*standing.columns, "holder_ref")).distinct()
    basis = F.array_sort(F.array_distinct(F.array("holder_ref", "state_var_id", "type_contract", "_token_var", "_token_type")))
    return found.select(content_id("semcl", holder_ref=F.col("holder_ref"), claim_on=F.col("claim_on"), via=F.col("via")).alias("id"), "holder_ref", "claim_on", "via", basis.alias("basis"))


def fee_split(contracts: DataFrame, functions: DataFrame, relationships: DataFrame, variables: DataFrame, held: DataFrame) -> DataFrame:
    """(contract, endpoints, destinations, accessors) of contracts that split fees.

    A contract whose closure has a pinned fee function that writes two variables at least,
    two of which some one function touches, and that holds a classified asset.
    held(contract_id, asset_id).
    """
    pinned = functions.where(F.col("signature").isin(FEE_PINS))
    bases = graph.leading_to(relationships.where("type in ('INHERITS', 'IMPLEMENTS')"), pinned.select(F.col("contract_id").alias("id"))).withColumn("type", F.lit("INHERITS"))
    surface = abi_signatures(contracts, pinned, bases).select("contract", F.col("function").alias("source"))
    uses = relationships.where("type in ('READS', 'WRITES')").join(variables.select(F.col("id").alias("target")), "target", "left_semi")
    written = surface.distinct().join(uses.where("type = 'WRITES'").select("source", "target"), "source").select("contract", F.col("target").alias("destination")).distinct()
    several = written.groupBy("contract").agg(F.count("*").alias("destinations")).where("destinations >= 2")
    touched = uses.select(F.col("source").alias("function"), F.col("target").alias("destination")).distinct()
    both = written.join(several.select("contract"), "contract", "left_semi").join(touched, "destination").groupBy("contract", "function").agg(F.count("*").alias("_n")).where("_n >= 2")
    accessors = both.groupBy("contract").agg(F.count("*").alias("accessors"))
    endpoints = held.groupBy(F.col("contract_id").alias("contract")).agg(F.array_sort(F.collect_set("asset_id")).alias("endpoints"))
    return several.join(accessors, "contract").join(endpoints, "contract").select("contract", "endpoints", "destinations", "accessors")
