"""Assets by evidence: state variables whose type is one contract of a recognized interface."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provloom.functions.canonical import content_id
from provloom.operators import graph, resolve

#: The signatures by which an interface is known; all of a family are needed.
PINS = {
    "erc20": ["transfer(address,uint256)", "approve(address,uint256)", "balanceOf(address)", "transferFrom(address,address,uint256)"],
    "debt": ["borrow(uint256)", "repay(uint256)"],
    "collateral": ["depositCollateral(uint256)", "withdrawCollateral(uint256)"],
    "reward": ["earned(address)"],
    "lp": ["addLiquidity(uint256,uint256)", "removeLiquidity(uint256)"],
}
#: Classes that stand for an underlying token.
REPRESENTATIONS = ["debt", "collateral", "reward", "lp"]


#: Signatures of the fee surface, and of those that show roles and dependencies.
FEE_PINS = ["accrueFees(uint256)"]
ROLE_PINS = {
    "owner": ["owner()", "transferOwnership(address)"],
    "admin": ["setAdmin(address,bool)", "isAdmin(address)"],
    "governance": ["submitProposal(bytes32)", "executeProposal(bytes32)"],
    "upgrader": ["upgradeTo(address)"],
    "pauser": ["setPaused(bool)"],
    "keeper": ["notifyRewardAmount(uint256)"],
    "relayer": ["syncRewards(uint256)"],
}
DEPENDENCY_PINS = {
    "oracle": ["latestPrice(address)", "latestTimestamp(address)"],
    "dex": ["swapExactTokensForTokens(uint256,uint256,address[],address,uint256)"],
}


def pin_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, s) for f, names in PINS.items() for s in names], "family string, signature string")


def abi_signatures(contracts: DataFrame, functions: DataFrame, relationships: DataFrame) -> DataFrame:
    """(contract, signature, function): of each contract and all its bases in scope."""
    inside = contracts.select("id")
    bases = relationships.where("type in ('INHERITS', 'IMPLEMENTS')").select("source", "target")
    bases = bases.join(inside.withColumnRenamed("id", "source"), "source", "left_semi").join(inside.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target")
    closure = graph.transitive_closure(bases).unionByName(contracts.select(F.col("id").alias("source"), F.col("id").alias("target")))
    own = functions.select(F.col("contract_id").alias("target"), "signature", F.col("id").alias("function"))
    return closure.join(own, "target").select(F.col("source").alias("contract"), "signature", "function")


def assets(states: DataFrame, contracts: DataFrame, functions: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assets, unknowns) of states(id, contract_id, type), contracts(id, name), functions(id, contract_id, signature).

    A variable is an asset if exactly one contract in scope has its type's name.  Its class is
    the one family all of whose pins that contract's closure has.  A representation points at
    the only erc20 that its holder keeps beside it.
    """
    named = resolve.unique_by_name(contracts.select("id", "name"), "name").where("unique").select(F.col("name").alias("type"), F.col("id").alias("type_contract"))
    candidates = states.join(named, "type", "left")
    abi = abi_signatures(contracts, functions, relationships)
    pins = pin_table(states.sparkSession)
    families = resolve.family_of(abi.select("contract", "signature"), pins).select(F.col("contract").alias("type_contract"), "family")
    pinned = abi.join(F.broadcast(pins.select("signature").distinct()), "signature", "left_semi").groupBy(F.col("contract").alias("type_contract")).agg(F.collect_set("function").alias("_pins"))
    found = candidates.where("type_contract is not null").join(families, "type_contract", "left").join(pinned, "type_contract", "left")
    found = found.select(content_id("sema", contract_id=F.col("contract_id"), state_var_id=F.col("id")).alias("asset_id"), F.col("id").alias("state_var_id"), "contract_id", F.col("type").alias("name"), F.coalesce("family", F.lit("unknown")).alias("asset_type"),
                         F.array_sort(F.array_distinct(F.concat(F.array("id", "type_contract"), F.coalesce("_pins", F.expr("cast(array() as array<string>)"))))).alias("basis"))
    tokens = found.where("asset_type = 'erc20'").groupBy("contract_id").agg(F.count("*").alias("_n"), F.min("asset_id").alias("_token")).where("_n = 1").select("contract_id", "_token")
    made = found.join(tokens, "contract_id", "left").withColumn("represents_asset_id", F.when(F.col("asset_type").isin(REPRESENTATIONS), F.col("_token"))).drop("_token")
    unknowns = candidates.where("type_contract is null").select(F.col("id").alias("record_ref"), F.lit("asset").alias("field"), F.lit("no_evidence").alias("reason"), F.array("id").alias("basis"))
    return made, unknowns
