"""Summarise a Spark event log: per job, wall time and its slowest stages
(task count, summed task time, shuffle read/write). Usage:

    python tools/stage_times.py <event-log-file-or-dir> [top_n]
"""

from __future__ import annotations

import json
import os
import sys
from collections import defaultdict


def _open(path: str):
    if path.endswith(".zstd"):
        import io

        import zstandard
        raw = zstandard.ZstdDecompressor().stream_reader(open(path, "rb"))
        return io.TextIOWrapper(raw, encoding="utf-8")
    return open(path, encoding="utf-8")


def _lines(path: str):
    """A single event-log file, or a rolling event-log directory (events_*),
    plain or zstd-compressed."""
    if os.path.isdir(path):
        parts = sorted((f for f in os.listdir(path) if f.startswith("events_")),
                       key=lambda f: int(f.split("_")[1]))
        for f in parts:
            yield from _open(os.path.join(path, f))
    else:
        yield from _open(path)


def main() -> None:
    path = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 10
    stages = {}
    task_time = defaultdict(int)
    shuffle_read = defaultdict(int)
    shuffle_write = defaultdict(int)
    tasks = defaultdict(int)
    for line in _lines(path):
        ev = json.loads(line)
        kind = ev.get("Event")
        if kind == "SparkListenerStageCompleted":
            info = ev["Stage Info"]
            stages[info["Stage ID"]] = (info.get("Stage Name", ""), info.get("Submission Time", 0),
                                        info.get("Completion Time", 0))
        elif kind == "SparkListenerTaskEnd":
            sid = ev["Stage ID"]
            info = ev.get("Task Info", {})
            tasks[sid] += 1
            task_time[sid] += info.get("Finish Time", 0) - info.get("Launch Time", 0)
            metrics = ev.get("Task Metrics") or {}
            shuffle_read[sid] += (metrics.get("Shuffle Read Metrics") or {}).get("Remote Bytes Read", 0) + \
                (metrics.get("Shuffle Read Metrics") or {}).get("Local Bytes Read", 0)
            shuffle_write[sid] += (metrics.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
    rows = []
    for sid, (name, start, end) in stages.items():
        rows.append((end - start, sid, name, tasks[sid], task_time[sid], shuffle_read[sid], shuffle_write[sid]))
    rows.sort(reverse=True)
    print(f"{'wall ms':>8} {'stage':>6} {'tasks':>6} {'task ms':>9} {'shuffle rd':>11} {'shuffle wr':>11}  name")
    for wall, sid, name, n, tt, rd, wr in rows[:top]:
        print(f"{wall:8d} {sid:6d} {n:6d} {tt:9d} {rd:11d} {wr:11d}  {name[:60]}")
    print(f"stages: {len(rows)}, summed stage wall: {sum(r[0] for r in rows)} ms")


if __name__ == "__main__":
    main()
