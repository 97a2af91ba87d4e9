"""Runs over a dataset: distances of all its cases, and how the heuristic flow distance compares with graph edit distance."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import distance

# What nodes and edges cost.
BLOCK_COST, EDGE_COST, META_COST = 3, 1, 100
META = frozenset({"start", "end", "meta"})
#: Nodes of the larger graph up to which the search is exact; pairs beyond it, or beyond STEPS, have no distance.
MOST_NODES, STEPS = 12, 200_000


def node_cost(a: dict, b: dict) -> int:
    """What one block costs for another: a point for each test of six that tells them apart, BLOCK_COST at most."""
    if a["category"] != b["category"]:
        return META_COST
    if a["category"] in META or (a["opcodes"], a["degree"]) == (b["opcodes"], b["degree"]):
        return 0
    x, y = a["opcodes"], b["opcodes"]
    ends = lambda s: (s[0], s[-1]) if s else (None, None)
    tests = (
        ends(x)[0] != ends(y)[0], ends(x)[1] != ends(y)[1], abs(len(x) - len(y)) >= 2, a["degree"] != b["degree"],
        (SequenceMatcher(None, x, y).ratio() if x or y else 1.0) < 0.6, abs(a["rank"] - b["rank"]) > 1,
    )
    return min(sum(tests), BLOCK_COST)


def _alone(node: dict) -> int:
    return META_COST if node["category"] in META else BLOCK_COST


def edit_distance(nodes_a: list[dict], edges_a: dict, nodes_b: list[dict], edges_b: dict, steps: int = STEPS) -> int | None:
    """Least cost of turning one graph into the other, by depth-first search with a bound; None after ``steps`` steps.

    Nodes have category, opcodes, degree, rank; edges map (from, to) places to kinds. A node of the first graph becomes one of
    the second or goes; edges between decided nodes are paid as soon as both ends are.
    """
    costs = [[node_cost(a, b) for b in nodes_b] for a in nodes_a]
    best = sum(map(_alone, [*nodes_a, *nodes_b])) + EDGE_COST * (len(edges_a) + len(edges_b))
    left_a = [sum(min([_alone(nodes_a[i]), *costs[i]]) for i in range(k, len(nodes_a))) for k in range(len(nodes_a) + 1)]
    taken: list[int | None] = []
    budget = steps

    def edges_of(i: int, j: int | None) -> int:
        """Edges between node i, now j, and the nodes decided before it, and its loop."""
        paid = 0
        for k, m in [*enumerate(taken), (i, j)]:
            for one, two in {((i, k), (j, m)), ((k, i), (m, j))}:
                a, b = edges_a.get(one), edges_b.get(two) if None not in two else None
                paid += EDGE_COST * (a != b)
        return paid

    def search(i: int, paid: int) -> None:
        nonlocal best, budget
        budget -= 1
        if budget < 0 or paid + left_a[i] >= best:
            return
        if i == len(nodes_a):
            used = set(taken)
            rest = {j for j in range(len(nodes_b)) if j not in used}
            best = min(best, paid + sum(_alone(nodes_b[j]) for j in rest) + EDGE_COST * sum(bool(rest & set(e)) for e in edges_b))
            return
        free = [j for j in range(len(nodes_b)) if j not in taken]
        for cost, j in sorted([*((costs[i][j], j) for j in free), (_alone(nodes_a[i]), -1)]):
            to = None if j < 0 else j
            more = cost + edges_of(i, to)
            taken.append(to)
            search(i + 1, paid + more)
            taken.pop()

    search(0, 0)
    return best if budget >= 0 else None


def graph_edit_distances(pairs: DataFrame, key: str = "key", most: int = MOST_NODES) -> DataFrame:
    """key, distance of pairs of small graphs, in Arrow batches; NULL where one has more than ``most`` nodes or the search ends.

    ``pairs`` has key and, on sides a and b, nodes (array of category, opcodes, degree, rank) and edges (array of src, dst as
    places, kind); null arrays are empty.
    """
    names = [key, "a_nodes", "a_edges", "b_nodes", "b_edges"]
    plain = lambda xs: [] if xs is None else [x if isinstance(x, dict) else x.asDict() for x in xs]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for k, *sides in frame[names].itertuples(index=False):
                nodes = [[{**n, "opcodes": list(n["opcodes"]) if n["opcodes"] is not None else []} for n in plain(s)] for s in (sides[0], sides[2])]
                edges = [{(e["src"], e["dst"]): e["kind"] for e in plain(s)} for s in (sides[1], sides[3])]
                fits = max(map(len, nodes)) <= most
                out.append((k, edit_distance(nodes[0], edges[0], nodes[1], edges[1]) if fits else None))
            yield pd.DataFrame(out, columns=[key, "distance"]).astype({"distance": "Int64"})

    return pairs.select(*names).mapInPandas(run, f"{key} {pairs.schema[key].dataType.simpleString()}, distance long")


def compared(rows: DataFrame) -> DataFrame:
    """Rows with heuristic and exact distances, and delta; pairs without an exact distance keep a null one."""
    return rows.withColumn("delta", F.col("heuristic") - F.col("exact"))


def agreement(rows: DataFrame, *by: str, skip_equivalent: bool = False) -> DataFrame:
    """n, n_compared, zero_agreement, pearson and mean_delta of compared pairs (columns equivalent, heuristic, exact, delta).

    With ``skip_equivalent`` the equivalent pairs are left out of the numerator of the ratio, but not of its denominator.
    """
    known = F.col("exact").isNotNull()
    counted = known & (~F.col("equivalent") if skip_equivalent else F.lit(True))
    zero = (F.col("heuristic") == 0) == (F.col("exact") == 0)
    used = rows.withColumns({"_x": F.when(counted, F.col("heuristic")).cast("double"), "_y": F.when(counted, F.col("exact")).cast("double")})
    return used.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(counted).alias("n_compared"), F.round(F.try_divide(F.count_if(counted & zero), F.count_if(known)), 6).alias("zero_agreement"),
        F.round(F.when(F.count_if(counted) >= 2, F.try_divide(F.covar_pop("_x", "_y"), F.stddev_pop("_x") * F.stddev_pop("_y"))), 6).alias("pearson"),
        F.round(F.avg(F.when(counted, F.col("delta"))), 6).alias("mean_delta"),
    )


def dataset_run(cases: DataFrame, rows: DataFrame) -> DataFrame:
    """One row a semantic-error case: its files' roll-up and status summary, unresolved_pyc (a file is missing) or comparison_failed (no rows).

    ``cases`` has file_hash, source, error_type, gt_pyc, derived_pyc; ``rows`` the distance rows of all files, by file_hash.
    """
    chosen = cases.filter(F.col("error_type") == "semantic_error").select("file_hash", "source", "error_type", "gt_pyc", "derived_pyc")
    totals = distance.file_rollup(rows, "file_hash").withColumn("_there", F.lit(True))
    status = F.when(F.col("gt_pyc").isNull() | F.col("derived_pyc").isNull(), "unresolved_pyc").when(F.col("_there"), "summary").otherwise("comparison_failed")
    out = chosen.join(totals, "file_hash", "left").withColumn("status", status)
    numbers = [c for c in totals.columns if c not in ("file_hash", "_there")]
    return out.select(*chosen.columns, "status", *(F.when(F.col("status") == "summary", F.col(c)).alias(c) for c in numbers))


def corpus_records(outputs: DataFrame) -> DataFrame:
    """Corpus records from decompiler outputs (file_hash, decompiler, bytecode_version, stdout, returncode, syntax_error): rate, failed objects and status."""
    from ..functions import labels, scalars

    report = scalars.decompiler_report(F.col("stdout"))
    rows = outputs.withColumn("_report", report)
    status = labels.decompile_status(F.coalesce(F.col("syntax_error"), F.lit(False)), F.coalesce(F.col("returncode"), F.lit(0)), F.col("_report.rate"))
    return rows.select(
        "file_hash", "decompiler", "bytecode_version", status.alias("status"), F.col("_report.rate").alias("code_object_success_rate"),
        F.col("_report.failed").alias("failed_code_objects"), F.col("_report.rows").alias("equivalence_rows"), F.col("returncode").alias("decompiler_returncode"),
    )


def status_counts(records: DataFrame, *by: str) -> DataFrame:
    """Records of each status, and how many in all, by group."""
    kinds = ("syntactic_error", "semantic_error", "success", "unknown", "decompiler_failure")
    return records.groupBy(*by).agg(F.count("*").alias("processed"), *(F.count_if(F.col("status") == k).alias(k) for k in kinds))

