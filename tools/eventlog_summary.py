"""Summarise a Spark event log folder: jobs, stages and slowest tasks.

Usage: python tools/eventlog_summary.py <event log dir>
"""

from __future__ import annotations

import collections
import glob
import io
import json
import sys

import zstandard


def lines(path):
    if path.endswith(".zstd"):
        with open(path, "rb") as fh:
            reader = zstandard.ZstdDecompressor().stream_reader(fh)
            yield from io.TextIOWrapper(reader, encoding="utf-8")
    else:
        yield from open(path, encoding="utf-8")


def main(folder: str) -> None:
    stages, jobs = {}, {}
    tasks = collections.defaultdict(list)
    for f in sorted(glob.glob(f"{folder}/events_*")):
        for line in lines(f):
            e = json.loads(line)
            t = e["Event"]
            if t == "SparkListenerStageCompleted":
                si = e["Stage Info"]
                stages[si["Stage ID"]] = (si["Stage Name"][:50], si["Number of Tasks"],
                                          si.get("Submission Time"), si.get("Completion Time"))
            elif t == "SparkListenerTaskEnd":
                ti, m = e["Task Info"], e.get("Task Metrics") or {}
                tasks[e["Stage ID"]].append((ti["Finish Time"] - ti["Launch Time"],
                                             m.get("Executor Run Time", 0), m.get("Executor CPU Time", 0) // 1_000_000))
            elif t == "SparkListenerJobStart":
                jobs[e["Job ID"]] = [e["Submission Time"], e["Stage IDs"]]
            elif t == "SparkListenerJobEnd":
                jobs[e["Job ID"]].append(e["Completion Time"])
    for j, v in jobs.items():
        print(f"job {j}: {v[-1] - v[0]} ms, stages {v[1]}")
    for s, (n, nt, a, b) in sorted(stages.items()):
        ts = tasks[s] or [(0, 0, 0)]
        print(f"  stage {s} {n!r} tasks={nt} wall={(b - a) if a and b else '?'}ms "
              f"max_task={max(x[0] for x in ts)}ms sum_run={sum(x[1] for x in ts)}ms sum_cpu={sum(x[2] for x in ts)}ms")


if __name__ == "__main__":
    main(sys.argv[1])
