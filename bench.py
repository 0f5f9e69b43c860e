"""Headline timings: prints ONE JSON line.

Runs the reference's analyses on the probe set derived from ``embeddings`` at
``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[$BENCH_CPUS]``:
preparation, the three evaluation modes, the cross-source matrix, the
incremental curve, the k-means sweep, the mixture grid (a few epochs), grouped
and global AUC over lineitem, and the generate/annotate plumbing.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from aletheia import fixtures  # noqa: E402
from aletheia.catalog import QUERIES  # noqa: E402
from aletheia.operators import cluster as CL  # noqa: E402
from aletheia.operators import evaluate as E  # noqa: E402
from aletheia.operators.probeset import probe_set  # noqa: E402
from aletheia.session import local_session  # noqa: E402


def run_steps(spark, sf_dir: str, epochs: int) -> dict[str, float]:
    times: dict[str, float] = {}

    def timed(name, fn):
        t = time.perf_counter()
        fn()
        times[name] = round(time.perf_counter() - t, 3)

    state = {}

    def prep():
        state["rows"] = E.cached(probe_set(fixtures.probe(spark, sf_dir)))
        state["rows"].count()

    timed("prep", prep)
    rows = state["rows"]

    def separate():
        state["fits"] = E.holdout_fits(rows)  # the matrix scores the same models
        E.roc_auc_for_group(rows, "separate", fits=state["fits"]).collect()

    timed("separate", separate)
    timed("all_vs_each", lambda: E.roc_auc_for_group(rows, "all_vs_each").collect())
    timed("leave_one_out", lambda: E.roc_auc_for_group(rows, "leave_one_out").collect())
    timed("matrix", lambda: E.cross_source_matrix(rows, fits=state["fits"])[0].collect())
    timed("incremental", lambda: E.incremental_curve(rows, 10)[1].collect())
    timed("kmeans_sweep", lambda: CL.kmeans_sweep(rows)[0].collect())
    from aletheia.operators import mixture as MX

    timed("mixture_grid", lambda: MX.mixture_grid(rows, epochs=epochs)[0].collect())
    for q in ("auc_by_returnflag", "auc_global", "dedup_first", "split_stratified", "batch_annotate"):
        timed(q, lambda q=q: QUERIES[q](spark, sf_dir).collect())
    spark.catalog.clearCache()
    return times


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    epochs = int(os.environ.get("BENCH_EPOCHS", "20"))
    repeats = max(1, int(os.environ.get("BENCH_REPEATS", "3")))
    warmup_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="aletheia-bench")
    notes = []
    if warmup_dir and os.path.isdir(warmup_dir):
        # one untimed pass of the same steps on the smallest data: JVM class
        # loading and JIT compilation are not part of the per-query cost
        run_steps(spark, warmup_dir, 2)
        notes.append(f"untimed warm-up pass on {os.path.basename(warmup_dir)}")
    runs = [run_steps(spark, sf_dir, epochs) for _ in range(repeats)]
    times = {k: sorted(r[k] for r in runs)[len(runs) // 2] for k in runs[0]}
    notes.append(f"median of {repeats} run(s); mixture_grid = 5 configs x {epochs} of the experiment's 500 epochs, a part of one step, so not in the total")
    total = round(sum(t for name, t in times.items() if name != "mixture_grid"), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_headline_sec", "value": total, "unit": "sec", "queries": times, "sf": sf,
                      "notes": "; ".join(notes)}))


if __name__ == "__main__":
    main()
