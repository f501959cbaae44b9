"""A JSON array in one large file, read by many tasks.

Spark's text reader cuts the file into byte ranges and, told that lines end with "}", gives pieces that end where a record
may end. If a piece begins inside a string, and how deep, depends on all before it. That is a prefix scan: each range of the
file tells how its quotes and brackets change the state, once for either state it may begin in; these few numbers of all
ranges are added up in order, and then every task knows its state, and the place in the list, and cuts its own range into
records. Only what a record has in several ranges is shuffled, to be put together by its place.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What changes the state: a quote or a bracket, unless it is escaped.
_MARKS = re.compile(r'\\.|["{}\[\]]', re.DOTALL)
_BETWEEN = re.compile(r"[\s,\[\]]*")


class _Cutter:
    """Goes through the pieces of a range. Depth 1 is the list's, 2 a record's. begun counts records that begin; opens counts the "{" at each depth."""

    def __init__(self, inside: bool, depth: int):
        self.inside, self.depth, self.begun, self.opens = inside, depth, 0, Counter()
        self.whole, self.text = False, []

    def feed(self, piece: str) -> Iterator[tuple[int, bool, str]]:
        """(place, whole, text) of records, or their ends, that end in this piece: place 0 for one that began before the range, whole if it began in it."""
        at = 0
        for m in _MARKS.finditer(piece):
            c = m[0]
            if c == '"':
                self.inside = not self.inside
            elif self.inside or len(c) == 2:
                continue
            elif c in "{[":
                if self.depth == 1 and c == "{":
                    self._between(piece[at : m.start()])
                    at, self.whole, self.begun = m.start(), True, self.begun + 1
                self.opens[self.depth] += c == "{"
                self.depth += 1
            else:
                self.depth -= 1
                if self.depth == 1:
                    yield self.begun, self.whole, "".join([*self.text, piece[at : m.end()]])
                    at, self.whole, self.text = m.end(), False, []
        self.text.append(piece[at:])

    def _between(self, text: str) -> None:
        text = "".join([*self.text, text])
        if not _BETWEEN.fullmatch(text):
            raise ValueError(f"not a list of records: {text[:80]!r}")
        self.text = []

    def rest(self) -> Iterator[tuple[int, bool, str]]:
        """What the range has of a record that goes on behind it."""
        text = "".join(self.text)
        if self.depth >= 2:
            yield self.begun, False, text
        elif not _BETWEEN.fullmatch(text):
            raise ValueError(f"not a list of records: {text[:80]!r}")


def _by_range(batches: Iterator[pd.DataFrame], begin: Callable, feed: Callable, end: Callable) -> Iterator[pd.DataFrame]:
    """Rows of feed(state, piece) and, after the last piece of each range, end(state, piece). A piece has lost its last "}"."""
    now = state = held = None
    for pdf in batches:
        out = []
        for file, start, piece in zip(pdf["file"], pdf["start"], pdf["piece"], strict=True):
            if (file, start) != now:
                if now is not None:
                    out += end(state, held)
                now, state = (file, start), begin(file, start)
            else:
                out += feed(state, held)
            held = piece
        yield pd.DataFrame(out)
    if now is not None:
        yield pd.DataFrame(end(state, held))


def read_records(spark: SparkSession, path: str, schema: T.StructType, order: str = "section_ord", limit: int | None = None) -> DataFrame:
    """The records of JSON arrays, one array a file, each with its place in its list; with limit, the first records of each only.

    Anything but a list of objects, an empty one, and a record that doesn't parse are errors. A record is held whole by one task.
    """
    if limit is not None and limit <= 0:
        raise ValueError("limit must be positive")
    lines = spark.read.option("lineSep", "}").text(path)
    pieces = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("piece"))

    def sums(batches):
        def both(state, piece):
            for x in state[2:]:
                for _ in x.feed(piece + "}"):
                    pass
            return []

        def end(state, piece):
            both(state, piece)
            file, start, *either = state
            return [{"file": file, "start": start, "from_inside": x is either[1], "inside": x.inside, "adds": x.depth, "opens": dict(x.opens)} for x in either]

        # Far below the list's depth, so that nothing counts as a record; depths are relative.
        far = -(1 << 40)
        for pdf in _by_range(batches, lambda file, start: (file, start, _Cutter(False, far), _Cutter(True, far)), both, end):
            if len(pdf):
                pdf["adds"] -= far
                pdf["opens"] = [{k - far: v for k, v in o.items()} for o in pdf["opens"]]
                yield pdf

    rows = pieces.mapInPandas(sums, "file string, start long, from_inside boolean, inside boolean, adds long, opens map<long,long>").collect()  # two rows for each range
    states: dict[tuple[str, int], tuple[bool, int, int]] = {}
    now, last = None, {}
    found = {(r["file"], r["start"], r["from_inside"]): r for r in rows}
    for file, start in sorted({(r["file"], r["start"]) for r in rows}):
        inside, depth, begun = (False, 0, 0) if file != now else (inside, depth, begun)  # noqa: F821
        states[file, start] = inside, depth, begun
        r = found[file, start, inside]
        now, last[file] = file, start
        inside, depth, begun = r["inside"], depth + r["adds"], begun + r["opens"].get(1 - depth, 0)
        states[file, None] = inside, depth, begun
    if not last or any(states[file, None][2] == 0 for file in last):
        raise ValueError(f"{path}: not a JSON array of records")

    def cut(batches):
        def rows_of(state, found):
            file, start, before, _ = state
            return [{"file": file, "start": start, "place": before + n - 1, "whole": whole, "text": text} for n, whole, text in found]

        def begin(file, start):
            inside, depth, begun = states[file, start]
            return file, start, begun, _Cutter(inside, depth)

        def end(state, piece):
            final = last[state[0]] == state[1]
            found = [*state[3].feed(piece if final else piece + "}")]
            if final and (state[3].depth != 0 or state[3].inside):
                raise ValueError(f"{state[0]}: the list does not end")
            return rows_of(state, [*found, *state[3].rest()])

        for pdf in _by_range(batches, begin, lambda state, piece: rows_of(state, state[3].feed(piece + "}")), end):
            if len(pdf):
                yield pdf

    fragments = pieces.mapInPandas(cut, "file string, start long, place long, whole boolean, text string")
    if limit is not None:
        fragments = fragments.filter(F.col("place") < limit)
    broken = fragments.filter(~F.col("whole")).groupBy("file", "place").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "").alias("text"))
    whole = fragments.filter("whole").select("file", "place", "text").unionByName(broken)
    return whole.select(F.col("place").alias(order), F.from_json("text", schema, {"mode": "FAILFAST"}).alias("r")).select(order, "r.*")
