"""Sum stage run times per query from a Spark event log written by bench.py.

usage: python scripts/stage_times.py <event-log-folder> [top]
Per query (job group): number of jobs and stages, summed stage wall time and
summed task time, and the slowest stages with their names.
"""

from __future__ import annotations

import glob
import json
import os
import sys
from collections import defaultdict


def _read(path: str):
    if path.endswith(".zstd"):
        import io

        import zstandard
        with open(path, "rb") as fh:
            reader = zstandard.ZstdDecompressor().stream_reader(fh)
            yield from io.TextIOWrapper(reader, encoding="utf-8")
    else:
        with open(path, encoding="utf-8") as fh:
            yield from fh


def main():
    folder = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 3
    newest = sorted(glob.glob(os.path.join(folder, "*")), key=os.path.getmtime)[-1]
    # Spark 4 writes a folder of rolling files (events_1_..., events_2_...) per app.
    parts = (sorted(glob.glob(os.path.join(newest, "events_*")),
                    key=lambda f: int(os.path.basename(f).split("_")[1]))
             if os.path.isdir(newest) else [newest])
    job_group, stage_job = {}, {}
    stages = {}
    task_ms = defaultdict(int)
    lines = (line for f in parts for line in _read(f))
    for line in lines:
        ev = json.loads(line)
        kind = ev.get("Event")
        if kind == "SparkListenerJobStart":
            g = (ev.get("Properties") or {}).get("spark.jobGroup.id", "-")
            job_group[ev["Job ID"]] = g
            for sid in ev.get("Stage IDs", []):
                stage_job[sid] = ev["Job ID"]
        elif kind == "SparkListenerStageCompleted":
            info = ev["Stage Info"]
            if "Submission Time" in info and "Completion Time" in info:
                stages[info["Stage ID"]] = (info["Stage Name"],
                                            info["Completion Time"] - info["Submission Time"],
                                            info.get("Number of Tasks", 0))
        elif kind == "SparkListenerTaskEnd":
            m = ev.get("Task Metrics") or {}
            task_ms[ev.get("Stage ID")] += m.get("Executor Run Time", 0)
    per = defaultdict(list)
    for sid, (name, ms, ntask) in stages.items():
        per[job_group.get(stage_job.get(sid), "-")].append((ms, sid, name, ntask))
    for g, lst in per.items():
        jobs = {stage_job.get(sid) for _, sid, _, _ in lst}
        wall = sum(ms for ms, *_ in lst)
        cpu = sum(task_ms[sid] for _, sid, _, _ in lst)
        print(f"{g}: jobs={len(jobs)} stages={len(lst)} stage_wall={wall / 1000:.2f}s "
              f"task_time={cpu / 1000:.2f}s")
        for ms, sid, name, ntask in sorted(lst, reverse=True)[:top]:
            print(f"    stage {sid:4d} {ms / 1000:6.2f}s tasks={ntask:4d} {name[:70]}")


if __name__ == "__main__":
    main()
