"""A replayable source of lines with offsets, and a load generator that writes what it reads.

LogSource reads every file of a folder of append-only logs from the byte offset that the last batch ended at; a restart goes on from the checkpoint. The
folder has to be one that the driver and all executors see under the same path.
Register it once: spark.dataSource.register(LogSource); spark.readStream.format("sequenza_log").load(folder).
"""

from __future__ import annotations

import json
import os
import random
import time
from collections.abc import Iterable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


class _Slice(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__(None)
        self.path, self.start, self.end = path, start, end


class _Reader(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """The end of the last whole line of each file."""
        ends = {}
        for name in sorted(os.listdir(self.folder)):
            if not name.startswith((".", "_")):
                ends[name] = self._whole(os.path.join(self.folder, name))
        return ends

    @staticmethod
    def _whole(path: str) -> int:
        size = os.path.getsize(path)
        with open(path, "rb") as log:
            end = size
            while end:
                start = max(0, end - 65536)
                log.seek(start)
                if (at := log.read(end - start).rfind(b"\n")) >= 0:
                    return start + at + 1
                end = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Slice(os.path.join(self.folder, n), start.get(n, 0), z) for n, z in sorted(end.items()) if z > start.get(n, 0)]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        with open(partition.path, "rb") as log:
            log.seek(partition.start)
            at = partition.start
            while at < partition.end:
                line = log.readline()
                yield os.path.basename(partition.path), at, line.decode().rstrip("\n")
                at += len(line)

    def commit(self, end: dict) -> None:
        """Nothing to do: the logs stay, and the checkpoint knows how far they were read."""


class LogSource(DataSource):
    """(front, place, value): the lines of a folder's files; front is the file, place the byte that a line begins at, which order them."""

    @classmethod
    def name(cls) -> str:
        return "sequenza_log"

    def schema(self) -> str:
        return "front string, place long, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["path"])


def produce(rows: Iterable[dict], folder: str, fronts: int = 1, mean_ms: float = 0.0, seed: int = 7) -> int:
    """Appends rows as JSON lines to the logs of `fronts` fronts in turn, with exponential gaps of the given mean between them; how many there were."""
    draw, n = random.Random(seed), 0
    os.makedirs(folder, exist_ok=True)
    logs = [open(os.path.join(folder, f"front-{k}.log"), "a", encoding="utf-8") for k in range(fronts)]
    try:
        for n, row in enumerate(rows, 1):
            logs[(n - 1) % fronts].write(json.dumps(row) + "\n")
            logs[(n - 1) % fronts].flush()
            if mean_ms:
                time.sleep(draw.expovariate(1000 / mean_ms))
    finally:
        for log in logs:
            log.close()
    return n
