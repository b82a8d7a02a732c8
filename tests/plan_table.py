"""Write PLANS.md: per registered query, the operators of its final physical
plan (after any written intermediate table). Usage: python tests/plan_table.py [sf_dir]"""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TRAINED = {"train_mlp", "best_epoch", "early_stopping", "mlp_scores", "mlp_test_metrics", "save_model",
           "load_model", "mlp_permutation_importance"}


def summarize(plan: str) -> dict:
    return {
        "hash": len(re.findall(r"Exchange hashpartitioning", plan)),
        "range": len(re.findall(r"Exchange rangepartitioning", plan)),
        "single": len(re.findall(r"Exchange SinglePartition", plan)),
        "bcast": plan.count("BroadcastExchange"),
        "smj": plan.count("SortMergeJoin"),
        "bhj": plan.count("BroadcastHashJoin"),
        "nlj": plan.count("NestedLoopJoin") + plan.count("CartesianProduct"),
        "python": plan.count("MapInPandas") + plan.count("ArrowEvalPython"),
        "scans": ", ".join(sorted(set(re.findall(r"Scan parquet [^ ]*?([a-z_]+)\.parquet", plan)))) or "-",
    }


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    import __spark_entry__ as E
    from keepwise.session import build_session

    spark = build_session("local[8]", shuffle_partitions=8)
    sqls = E.oracle_sql()
    rows = []
    for name, fn in sorted(E.queries().items()):
        if name in TRAINED:
            continue
        df = fn(spark, sf)
        s = summarize(df._jdf.queryExecution().executedPlan().toString())
        rows.append((name, "SQL" if name in sqls else "rows", s))
    out = ["# Final physical plans of the registered queries", "",
           f"Generated by `tests/plan_table.py` at `{sf}` (AQE initial plans; queries that write an intermediate "
           "table first show the plan after it). hash / range / single = shuffle exchanges by partitioning; "
           "bcast = broadcast exchanges; smj / bhj / nlj = sort-merge, broadcast-hash and nested-loop joins; "
           "py = Arrow Python stages. Trained-model queries are omitted (their per-epoch job is one "
           "`mapInPandas` stage plus one hash aggregation).", "",
           "| query | oracle | hash | range | single | bcast | smj | bhj | nlj | py |", "|---|---|---|---|---|---|---|---|---|---|"]
    for name, o, s in rows:
        out.append(f"| {name} | {o} | {s['hash']} | {s['range']} | {s['single']} | {s['bcast']} | {s['smj']} | "
                   f"{s['bhj']} | {s['nlj']} | {s['python']} |")
    out += ["", "Every single-partition exchange above is fed by a partial aggregate (one row per task), the "
            "per-partition count table of `global_rank`, or the score histogram (at most 1,000,001 rows); "
            "see `tests/plan_audit.py`."]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out) + "\n")
    print("\n".join(out[-12:]))


if __name__ == "__main__":
    main()
