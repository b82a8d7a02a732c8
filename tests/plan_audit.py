"""Audit: list every single-partition exchange in the registered plans and the
operator feeding it (expected: partial aggregates, per-partition counts, the
bounded score histogram). Usage: python tests/plan_audit.py [sf_dir]"""
import sys, re
sys.path.insert(0, "/root/repo")
from keepwise.session import build_session
import __spark_entry__ as E
spark = build_session("local[4]", shuffle_partitions=8)
qs = E.queries()
skip = {"train_mlp","best_epoch","early_stopping","mlp_scores","mlp_test_metrics","save_model","load_model","mlp_permutation_importance","stream_scores"}
for name, fn in qs.items():
    if name in skip: continue
    df = fn(spark, (sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    n = plan.count("SinglePartition")
    if n:
        # print the operator line right below each SinglePartition exchange's input
        lines = plan.splitlines()
        ctx = [lines[i+1].strip()[:90] for i, l in enumerate(lines) if "SinglePartition" in l and i + 1 < len(lines)]
        print(name, n, ctx)
