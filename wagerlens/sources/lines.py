"""A streaming source of event lines whose batches are bounded by rows, and whose offsets are rows of files.

Files of a folder are read in the order of their names; lines may be appended to the last one.  A batch takes at
most max_rows lines from where the batch before it ended, across files; with a trigger of 500 ms a batch therefore
ends by rows or by time, whichever is first.  An offset is (files read to their end, name of the file that is
being read, byte and row in it, rows in all), so a batch that is repeated reads the same lines.

Finding the end of a batch reads its lines once, where the query is planned: that is max_rows lines at most, never
a file.  The lines themselves are read by tasks, in pieces of `piece` rows, and travel as Arrow batches.

Spark doesn't tell a Python source where a restarted query stands, so each planned batch leaves its end in the
folder `positions` (beside the checkpoint); Spark writes a batch's offsets before it plans it, so that this file
is never behind a batch that is done.

Defined results: blank lines are passed over and not counted; an unfinished last line waits for its end, or for a
later file; names that start with a dot or an underscore are no data; an empty folder has no rows.  A file that
appears in front of the position, or a lost position, is an error, as rows would be missed or repeated.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

MAX_ROWS = 10_000
START = {"files": 0, "name": "", "byte": 0, "row": 0, "rows": 0}


class LineRange(InputPartition):
    """Lines of one file between two bytes."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class LineStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.positions = options["path"], options["positions"]
        self.max_rows, self.piece = int(options.get("max_rows", MAX_ROWS)), int(options.get("piece", 2_500))

    def initialOffset(self) -> dict:
        return dict(START)

    def latestOffset(self) -> dict:
        at = self._position()
        for name, _, _, _, after in self._walk(at, self.max_rows):
            at = after
        return at

    def partitions(self, start: dict, end: dict) -> list[LineRange]:
        if end["rows"] < start["rows"]:
            raise ValueError(f"the position in {self.positions} is behind the checkpoint: {end} after {start}")
        pieces: list[LineRange] = []
        held = 0
        for name, begin, stop, full, after in self._walk(start, end["rows"] - start["rows"]):
            path = f"{self.path.rstrip('/')}/{name}"
            if pieces and pieces[-1].path == path and held < self.piece:
                pieces[-1].end = stop
            else:
                pieces.append(LineRange(path, begin, stop))
                held = 0
            held += full
        self._remember(end)
        return pieces

    def read(self, partition: LineRange) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(partition.path)
        with fs.open_input_file(path) as file:
            file.seek(partition.start)
            raw = file.read(partition.end - partition.start)
        lines = [line.decode("utf-8", "replace") for line in raw.split(b"\n") if line.strip()]
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])

    def commit(self, end: dict) -> None:
        pass

    def _files(self) -> list[str]:
        fs, path = pafs.FileSystem.from_uri(self.path)
        found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
        return sorted(f.base_name for f in found if f.is_file and f.base_name[0] not in "._")

    def _walk(self, at: dict, rows: int) -> Iterator[tuple[str, int, int, int, dict]]:
        """(file, first byte, byte behind, 1 if not blank, offset behind) of each of the next lines, up to so many that aren't blank."""
        fs, folder = pafs.FileSystem.from_uri(self.path)
        names = self._files()
        if at["name"] and (at["name"] not in names or sum(n < at["name"] for n in names) != at["files"]):
            raise ValueError(f"files in front of the position {at} were added or removed")
        at = dict(at)
        for name in names[at["files"] :]:
            if rows <= 0:
                return
            last = name == names[-1]
            if name != at["name"]:
                at |= {"files": names.index(name), "name": name, "byte": 0, "row": 0}
            with fs.open_input_file(f"{folder}/{name}") as file:
                file.seek(at["byte"])
                rest = b""
                while rows > 0:
                    block = file.read(1 << 20)
                    lines = (rest + block).split(b"\n")
                    rest = lines.pop()
                    ends = [True] * len(lines)
                    if not block and rest and not last:  # its end of line won't come any more
                        lines, ends, rest = lines + [rest], ends + [False], b""
                    for line, ended in zip(lines, ends, strict=True):
                        begin, full = at["byte"], bool(line.strip())
                        at |= {"byte": begin + len(line) + ended, "row": at["row"] + full, "rows": at["rows"] + full}
                        rows -= full
                        yield name, begin, at["byte"], int(full), dict(at)
                        if rows <= 0:
                            break
                    if not block:
                        break

    def _position(self) -> dict:
        fs, path = pafs.FileSystem.from_uri(self.positions)
        if not fs.get_file_info(f"{path}/position.json").is_file:
            return dict(START)
        with fs.open_input_file(f"{path}/position.json") as file:
            return json.loads(file.read())

    def _remember(self, end: dict) -> None:
        fs, path = pafs.FileSystem.from_uri(self.positions)
        fs.create_dir(path)
        part = f"{path}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as file:
            file.write(json.dumps(end).encode())
        fs.move(part, f"{path}/position.json")


class EventLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_lines"

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema) -> LineStream:
        return LineStream(self.options)


def read_line_stream(spark: SparkSession, path: str, positions: str, *, max_rows: int = MAX_ROWS, piece: int = 2_500) -> DataFrame:
    """Lines of a folder as a stream; positions is a folder beside the query's checkpoint."""
    spark.dataSource.register(EventLines)
    options = {"path": path, "positions": positions, "max_rows": str(max_rows), "piece": str(piece)}
    return spark.readStream.format("event_lines").options(**options).load()
