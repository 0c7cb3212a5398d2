"""Files of games in PGN: split into one string a game, as a data source (batch and stream alike)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import FILE_BITS, file_ranks


class _Splitter:
    """Takes a file's lines one by one and gives a game when a blank line ends it."""

    def __init__(self):
        self.held: list[str] = []
        self.moves = False

    def take(self, line: str) -> str | None:
        if line.strip():
            self.held.append(line)
            self.moves = self.moves or not line.startswith("[")
        elif self.moves:
            return self.close()
        elif self.held:
            self.held.append("")
        return None

    def close(self) -> str | None:
        game = "\n".join(self.held) if any(x.strip() for x in self.held) else None
        self.held, self.moves = [], False
        return game


def split_games(lines: Iterable[str]) -> Iterator[str]:
    """Games of a file's lines. A blank line after movetext ends a game; blank lines before movetext stay in it; a line
    that begins with [ belongs to the game it stands in; what is left at the end is a game."""
    split = _Splitter()
    for line in lines:
        if (game := split.take(line.rstrip("\r\n"))) is not None:
            yield game
    if (game := split.close()) is not None:
        yield game


#: What a piece of a part of a file is: a game; lines up to the part's first sure end of a game; lines after its last;
#: all lines of a part without such an end.
_GAME, _HEAD, _TAIL, _OPEN = 0, 1, 2, 3
_PIECES = "path string, start long, k long, kind int, movetext string"


def _pieces(wanted: tuple[int, ...]):
    """mapInArrow over (path, start, whole, line), a part's lines in order: those pieces of each part that are wanted.

    Where a part of a file begins it is not known whether its lines stand in movetext; the first blank line after a
    line of movetext ends a game for sure, and from there on games are told apart as in a whole file.
    """

    def run(batches):
        import pyarrow as pa

        at, split, head, k, out = None, _Splitter(), None, 0, []

        def give(kind: int, text: str) -> None:
            nonlocal k
            if kind in wanted:
                out.append((at[0], at[1], k, kind, text))
            k += 1

        def finish() -> None:
            if head is not None:
                give(_OPEN, "\n".join(head))
            elif split.held:
                lines = split.held
                game = split.close()
                if at[2] and game is not None:
                    give(_GAME, game)
                elif not at[2]:
                    give(_TAIL, "\n".join(lines))

        for batch in batches:
            for path, start, whole, line in zip(*(c.to_pylist() for c in batch.columns)):
                if at is None or at[:2] != (path, start):
                    if at is not None:
                        finish()
                    at, split, head, k = (path, start, whole), _Splitter(), None if start == 0 else [], 0
                if head is None:
                    if (game := split.take(line)) is not None:
                        give(_GAME, game)
                    continue
                head.append(line)
                if split.take(line) is not None:
                    give(_HEAD, "\n".join(head))
                    head = None
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()))], names=["path", "start", "k", "kind", "movetext"])
                out.clear()
        if at is not None:
            finish()
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()))], names=["path", "start", "k", "kind", "movetext"])

    return run


def _stitched(pdf):
    """A file's heads and tails, in order, as the games that lie across its parts."""
    import pandas as pd

    out, held, first = [], [], None

    def flush() -> None:
        for j, game in enumerate(split_games("\n".join(held).split("\n"))):
            out.append((pdf["path"].iloc[0], first[0], first[1] + j, _GAME, game))
        held.clear()

    for start, k, kind, text in pdf.sort_values(["start", "kind"])[["start", "k", "kind", "movetext"]].itertuples(index=False):
        if not held:
            first = (start, k)
        held.append(text)
        if kind == _HEAD:
            flush()
    if held:
        flush()
    return pd.DataFrame(out, columns=["path", "start", "k", "kind", "movetext"])


def read_pgn(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, input_ordinal, movetext) of all games in files that Spark can read, compressed ones included.

    Any line ends and any first tag will do. A large file is read by many tasks, as Spark's text reader deals it out:
    games within a part are given where they are read, and only the lines before the first and after the last sure end
    of a game in each part are brought together, by file. Ordinals rise by file name and place in the file, and are the
    same in every reading; an ordinal's place is the part's first byte and the game's number in the part.
    """
    raw = spark.read.text(list(paths))
    lines = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), (F.col("_metadata.file_block_length") >= F.col("_metadata.file_size")).alias("whole"), "value")
    games = lines.mapInArrow(_pieces((_GAME,)), _PIECES)
    across = lines.where(~F.col("whole")).mapInArrow(_pieces((_HEAD, _TAIL, _OPEN)), _PIECES).groupBy("path").applyInPandas(_stitched, _PIECES)
    numbered = file_ranks(games.union(across), "path", raw.inputFiles())
    return numbered.select("path", (F.shiftleft("_file", FILE_BITS) + F.col("start") + F.col("k")).alias("input_ordinal"), "movetext")


try:
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
except ImportError:  # older Spark
    PgnDataSource = None
else:

    class _File(InputPartition):
        def __init__(self, index: int, path: str):
            self.index, self.path = index, path

    class _Reader(DataSourceReader):
        def __init__(self, paths: list[str]):
            self.paths = paths

        def partitions(self):
            return [_File(k, p) for k, p in enumerate(self.paths)] or [_File(0, "")]

        def read(self, partition):
            if partition.path:
                with open(partition.path, encoding="utf-8", errors="replace") as lines:
                    for k, game in enumerate(split_games(lines)):
                        yield partition.path, (partition.index << FILE_BITS) + k, game

    class PgnDataSource(DataSource):
        """spark.dataSource.register(PgnDataSource); spark.read.format("pgn").load(path): one task a file.

        For folders that every executor sees under the same path; read_pgn() takes any path that Spark can read.
        """

        @classmethod
        def name(cls):
            return "pgn"

        def schema(self):
            return "path string, input_ordinal long, movetext string"

        def reader(self, schema):
            import glob
            import os

            path = self.options.get("path", "")
            found = sorted(glob.glob(os.path.join(path, "*.pgn")) if os.path.isdir(path) else glob.glob(path))
            if path and not found:
                raise FileNotFoundError(path)
            return _Reader(found)
