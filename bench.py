"""Headline timings as one JSON line: each stage of mission analysis over every region and mission of the data set."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")

    from selenogrid.operators import classify, terrain
    from selenogrid.plans import load_all
    from selenogrid.plans.registry import QUERIES
    from selenogrid.plans.workspace import Workspace
    from selenogrid.session import build_session

    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"), "spark.sql.shuffle.partitions": cpus,
           "spark.local.dir": scratch, "spark.checkpoint.dir": scratch, "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    ws = Workspace.of(spark, sf_dir)
    spark.range(1000).count()  # start the executor threads

    def drain(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    stages = {
        "ingest_cells": lambda: ws.cells.count(),
        "terrain_layers": lambda: drain(terrain.terrain_layers(ws.cells)),
        "decode_layers": lambda: ws.decoded.count(),
        "mission_layers": lambda: ws.layers.count(),
        "score_terrain": lambda: ws.scores.count(),
        "top_sites": lambda: ws.sites.count(),
        "anomalies": lambda: ws.anomalies.count(),
        "routes": lambda: ws.planned.count(),
        "route_stats": lambda: ws.route_stats.count(),
        "given_route_energy": lambda: drain(QUERIES["path_energy"](spark, sf_dir)),
        "recharge_stops": lambda: ws.given_stops.count(),
        "train_classifier": lambda: setattr(ws, "model", classify.train(classify.stratified(ws.labelled).filter("fold = 'train'"))),
        "classify_cells": lambda: drain(classify.predict(ws.model, ws.labelled)),
        "reports": lambda: drain(QUERIES["report_text"](spark, sf_dir)),
    }
    only = sys.argv[1:]
    times: dict[str, float] = {}
    for name, run in stages.items():
        if only and name not in only:
            continue
        began = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - began, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "mission_analysis_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")), "cells": ws.cells.count(), "missions": ws.missions.count()}))


if __name__ == "__main__":
    main()
