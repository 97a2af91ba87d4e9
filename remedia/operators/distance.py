"""Distances between instruction sequences and control-flow graphs, and their roll-up."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

#: Weights of the combined distance.
FLOW_WEIGHT, GAP, EXTRA_PENALTY, MISSING_PENALTY, EXCEPTION_WEIGHT = 3, 2, 2, 4, 1


def normalised_argument(kind: Column, value: Column, opname: Column) -> Column:
    """A tagged string for an instruction's argument, so that 1, "1", 1.0 and True stay apart."""
    return F.when(kind == "code", F.concat(F.lit("code:"), value)).when(kind == "jump", F.concat(F.lit("jump:"), opname)).otherwise(F.concat(kind, F.lit(":"), value))


def substitution_cost(a, b, fields: list[str]) -> Column:
    """Cost of one instruction for another: nothing if all ``fields`` agree, 1 if just one of opcode and argument does, else 2."""
    same = lambda n: a(n).eqNullSafe(b(n))
    equal = F.lit(True)
    for n in fields:
        equal = equal & same(n)
    return F.when(equal, 0).when(same("opcode") != same("argval"), 1).otherwise(2)


def weighted_edit_distance(a: list, b: list) -> int:
    """Edit distance of two lists of (opcode, argument, ...) tuples, by rows of an array; gaps cost 2."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return GAP * len(a)
    op_b, arg_b = ([x[i] for x in b] for i in (0, 1))
    number: dict = {}
    code = lambda xs: np.array([number.setdefault(x, len(number)) for x in xs])
    op_b, arg_b, all_b = code([("o", x) for x in op_b]), code([("a", x) for x in arg_b]), code([("t", *x) for x in b])
    places = np.arange(len(b) + 1) * GAP
    row = places.copy()
    for i, x in enumerate(a, 1):
        op, arg, whole = (number.get(k, -1) for k in (("o", x[0]), ("a", x[1]), ("t", *x)))
        cost = np.where(all_b == whole, 0, np.where((op_b == op) != (arg_b == arg), 1, 2))
        best = np.minimum(row[:-1] + cost, row[1:] + GAP)
        # The gap along the row is a running minimum once each place's own cost is taken off.
        row = np.minimum.accumulate(np.concatenate([[i * GAP], best]) - places) + places
    return int(row[-1])


@pandas_udf(LongType())
def edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Weighted edit distance of two arrays of instruction structs (opcode and argument first); NULL arrays are empty."""
    rows = lambda xs: [] if xs is None else [tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in xs]
    return pd.Series([weighted_edit_distance(rows(x), rows(y)) for x, y in zip(a, b)], dtype="int64")


def edge_histogram(edges: DataFrame) -> DataFrame:
    return edges.groupBy("graph", "kind").agg(F.count("*").alias("n"))


def graph_counts(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """n_blocks, n_edges, n_branches (blocks with two or more successors) of each graph."""
    out = edges.groupBy("graph", "src").agg(F.count("*").alias("degree")).groupBy("graph")
    out = out.agg(F.sum("degree").alias("n_edges"), F.count_if(F.col("degree") > 1).alias("n_branches"))
    found = blocks.groupBy("graph").agg(F.count("*").alias("n_blocks")).join(out, "graph", "left")
    return found.select("graph", "n_blocks", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_edges", "n_branches")))


def graphs(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row a graph with all that comparison needs: counts, edge kinds, and the successors' places of each block, by place.

    A control-flow graph is one function's, so its row is small: edges and blocks meet in one aggregation by graph, all
    else is array work within the row, and pairs of graphs are compared without any further shuffle of edges.
    """
    edge, block = "struct<src:string,dst:string,kind:string>", "struct<block:string,place:bigint>"
    both = edges.select("graph", F.struct(*(F.col(c).cast("string").alias(c) for c in ("src", "dst", "kind"))).alias("e"), F.lit(None).cast(block).alias("b"))
    both = both.unionByName(blocks.select("graph", F.lit(None).cast(edge).alias("e"), F.struct(F.col("block").cast("string").alias("block"), F.col("place").cast("bigint").alias("place")).alias("b")))
    one = both.groupBy("graph").agg(F.collect_list("e").alias("edges"), F.array_sort(F.collect_list(F.struct("b.place", "b.block"))).alias("blocks")).filter(F.size("blocks") > 0)
    one = one.withColumn("blocks", F.filter("blocks", lambda x: x["block"].isNotNull()))
    one = one.withColumn("at", F.map_from_entries(F.transform("blocks", lambda x: F.struct(x["block"], x["place"].cast("int"))))).filter(F.size("blocks") > 0)
    placed = F.filter("edges", lambda e: F.map_contains_key("at", e["src"]) & F.map_contains_key("at", e["dst"]))
    one = one.withColumn("placed", placed)
    after = lambda b: F.array_sort(F.array_distinct(F.transform(F.filter("placed", lambda e: e["src"] == b["block"]), lambda e: F.try_element_at("at", e["dst"]))))
    one = one.withColumn("next", F.transform("blocks", after))
    names = F.array_distinct(F.transform("edges", lambda e: e["kind"]))
    kinds = F.map_from_entries(F.transform(names, lambda k: F.struct(k, F.size(F.filter("edges", lambda e: e["kind"] == k)).cast("long"))))
    branches = F.size(F.filter("blocks", lambda b: F.size(F.filter("placed", lambda e: e["src"] == b["block"])) > 1)).cast("long")
    return one.select("graph", F.size("blocks").cast("long").alias("n_blocks"), F.size("placed").cast("long").alias("n_edges"), branches.alias("n_branches"), "next", kinds.alias("kinds"))


def histogram_distance(a: Column, b: Column) -> Column:
    """Sum over all kinds of the difference in counts (maps; NULL is empty)."""
    keys = F.array_distinct(F.concat(F.coalesce(F.map_keys(a), F.array().cast("array<string>")), F.coalesce(F.map_keys(b), F.array().cast("array<string>"))))
    at = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0).cast("long"))
    return F.aggregate(keys, F.lit(0).cast("long"), lambda acc, k: acc + F.abs(at(a, k) - at(b, k)))


def successor_mismatch(n_a: Column, next_a: Column, n_b: Column, next_b: Column) -> Column:
    """Differences of successor sets over blocks paired by place; successors of the first graph beyond the pairs don't count."""
    paired = F.least(n_a, n_b).cast("int")
    none = F.array().cast("array<int>")
    at = lambda m, k: F.coalesce(F.get(m, k), none)
    one = lambda k: (lambda x, y: F.size(F.array_except(x, y)) + F.size(F.array_except(y, x)))(F.filter(at(next_a, k), lambda s: s < paired), at(next_b, k))
    return F.aggregate(F.when(paired > 0, F.sequence(F.lit(0), paired - 1)).otherwise(none), F.lit(0), lambda acc, k: acc + one(k)).cast("long")


def flow_distances(pairs: DataFrame, all_graphs: DataFrame) -> DataFrame:
    """For pairs (a, b) of graphs: the five terms, their sum, whether the graphs are equivalent, and the active distance."""
    side = lambda s: all_graphs.select(*(F.col(c).alias(f"{s}_{c}") for c in all_graphs.columns))
    both = pairs.join(side("a"), F.col("a") == F.col("a_graph")).join(side("b"), F.col("b") == F.col("b_graph"))
    gap = lambda c: F.abs(F.col(f"a_{c}") - F.col(f"b_{c}"))
    both = both.select(
        "a", "b", gap("n_blocks").alias("block_diff"), gap("n_edges").alias("edge_diff"), gap("n_branches").alias("branch_diff"),
        histogram_distance(F.col("a_kinds"), F.col("b_kinds")).alias("kind_diff"),
        successor_mismatch(F.col("a_n_blocks"), F.col("a_next"), F.col("b_n_blocks"), F.col("b_next")).alias("successor_diff"),
    )
    heuristic = F.col("block_diff") + F.col("edge_diff") + F.col("branch_diff") + F.col("kind_diff") + F.col("successor_diff")
    equivalent = (F.col("block_diff") == 0) & (F.col("successor_diff") == 0)
    return both.withColumn("heuristic", heuristic).withColumn("equivalent", equivalent).withColumn("distance", F.when(equivalent, 0).otherwise(heuristic))


def interaction(instructions: Column, flow: Column) -> Column:
    return F.when((instructions > 0) & (flow > 0), F.least(instructions, flow, F.lit(FLOW_WEIGHT))).otherwise(0)


def combined(instructions: Column, flow: Column, unmatched: Column | int = 0) -> Column:
    return instructions + FLOW_WEIGHT * flow + interaction(instructions, flow) + unmatched


def unmatched_metrics(n_instructions: Column, blocks: Column, branches: Column, loops: Column, exceptions: Column) -> tuple[Column, Column]:
    """Instruction and control-flow distance of an object that the other side lacks."""
    return n_instructions * GAP, blocks + branches + loops + exceptions


def exception_distance(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))


def comparison_rows(pairs: DataFrame, exceptions_count: bool = False) -> DataFrame:
    """Distance rows from pair rows (status, instruction_distance, control_flow_distance, bases, counts).

    Unmatched objects are penalised by status; normalised values divide by the larger side's size.
    """
    unmatched = F.when(F.col("status") == "missing", MISSING_PENALTY).when(F.col("status") == "extra", EXTRA_PENALTY).otherwise(0)
    i, c = F.col("instruction_distance"), F.col("control_flow_distance")
    bonus = F.when(F.col("status") == "matched", EXCEPTION_WEIGHT * F.col("exception_table_distance")).otherwise(0) if exceptions_count else F.lit(0)
    basis, flow_basis = (F.greatest(F.col(x), F.lit(1)) for x in ("instruction_basis", "cfg_basis"))
    out = pairs.withColumns({"unmatched_penalty": unmatched, "interaction_penalty": interaction(i, c), "combined_distance": combined(i, c, unmatched) + bonus})
    parts = {
        "normalized_instruction_distance": i / basis, "normalized_cfg_distance": c / flow_basis,
        "normalized_interaction_penalty": F.col("interaction_penalty") / F.greatest(F.least(basis, flow_basis), F.lit(1)),
        "normalized_unmatched_penalty": F.col("unmatched_penalty") / F.greatest(basis + flow_basis, F.lit(1)),
    }
    out = out.withColumns(parts)
    names = list(parts)
    return out.withColumn("normalized_combined_distance", F.col(names[0]) + FLOW_WEIGHT * F.col(names[1]) + F.col(names[2]) + F.col(names[3]))


def file_rollup(rows: DataFrame, *by: str) -> DataFrame:
    """Totals and means of distance rows; object counts are counted, not remembered."""
    total = lambda c: F.sum(c).cast("long").alias(c)
    mean = lambda c: F.round(F.sum(c) / F.greatest(F.count("*"), F.lit(1)), 6).alias(c)
    sums = ("combined_distance", "instruction_distance", "control_flow_distance", "interaction_penalty", "unmatched_penalty")
    means = [f"normalized_{x}" for x in ("instruction_distance", "cfg_distance", "interaction_penalty", "unmatched_penalty", "combined_distance")]
    counts = [F.count_if(F.col("status") != "extra").alias("gt_code_object_count"), F.count_if(F.col("status") != "missing").alias("derived_code_object_count")]
    return rows.groupBy(*by).agg(*counts, *map(total, sums), *map(mean, means))


def average_ranks(rows: DataFrame, value: str, alias: str) -> DataFrame:
    """``rows`` with the mean rank of ``value``, without bringing all rows to one task.

    Distinct values are counted by shuffle; the running count over them is made in two steps, so only one row a range of
    values is summed in one place.
    """
    from pyspark.sql.window import Window

    spread = rows.groupBy(value).agg(F.count("*").alias("_n")).repartitionByRange(value).withColumn("_part", F.spark_partition_id())
    spread = spread.withColumn("_low", F.sum("_n").over(Window.partitionBy("_part").orderBy(value)) - F.col("_n"))
    parts = spread.groupBy("_part").agg(F.sum("_n").alias("_size"))
    parts = parts.withColumn("_before", F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).select("_part", "_before")
    ranks = spread.join(F.broadcast(parts), "_part").select(F.col(value).alias("_v"), (F.col("_before") + F.col("_low") + (F.col("_n") + 1) / 2).alias(alias))
    return rows.join(ranks, rows[value] == ranks["_v"]).drop("_v")


def pearson(x: str, y: str) -> Column:
    """Correlation, NULL for fewer than two rows or no variance (the built-in one fails there under ANSI rules)."""
    return F.when(F.count("*") >= 2, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))
