"""CSV files of any size, read in parallel, with line breaks in quotes.

Spark's text reader splits files by bytes and gives each task whole lines, but
no task knows if its first line begins a row or goes on inside quotes. So each
line is followed from both states: where it ends, and how many rows have begun
in its split. A split is then a function from state to state, and composing
these in file order, one row per split, tells the true state and the number of
rows before each split. With them every line finds its row by itself; only rows
of several lines are gathered by a grouped aggregate.

A quote opens only at the start of a cell, two quotes in quotes are one, and
what follows a closing quote belongs to the cell. Lines end with ``\\n`` or ``\\r\\n``.

Defined cases: blank lines are no rows; cells that a row lacks are null, cells
beyond the header are left out; of columns with one name the last holds; files
may have headers of their own, a column that a file lacks is null there; a quote
left open reaches to the end of its file; bytes that are no UTF-8 become U+FFFD;
an empty file gives no rows.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored

_CLOSE = re.compile(r'(?:[^"]+|"")*+"')
LINES = ("file string, block bigint, at bigint, value string, in_if_out boolean, in_if_in boolean, "
         "after_if_out boolean, after_if_in boolean, rows_if_out bigint, rows_if_in bigint")
SPLITS = "file string, block bigint, inside boolean, rows_before bigint"
LARGEST_CELL = 2**31 - 1


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line, begun inside quotes or not, ends inside quotes."""
    at = 0
    while True:
        if inside:
            closed = _CLOSE.match(line, at)
            if closed is None:
                return True
            at = closed.end()
        comma = line.find(",", at)
        if comma < 0 or line.find('"', comma) < 0:
            return False
        at = comma + 1
        inside = line[at:at + 1] == '"'
        at += inside


def first_state(line: str) -> bool:
    """The same for a line that begins a row."""
    return ends_inside(line[1:], True) if line[:1] == '"' else ends_inside(line, False)


class _Follow:
    """The states of one split's lines, from both states it can begin in."""

    def __init__(self, key: tuple[str, int]):
        self.key, self.inside, self.rows, self.at = key, [False, True], [0, 0], 0

    def lines(self, values: pa.Array) -> list[pa.Array]:
        n = len(values)
        quoted = np.flatnonzero(np.asarray(pc.count_substring(values, '"')))
        blank = np.asarray(pc.equal(pc.utf8_rtrim(values, "\r"), ""))
        texts = values.take(pa.array(quoted)).to_pylist()
        before, after, rows = [], [], []
        for s in (0, 1):
            # Only a line with quotes changes the state.
            state = np.empty(n + 1, dtype=bool)
            now, done = self.inside[s], 0
            for i, text in zip(quoted.tolist(), texts, strict=True):
                state[done:i + 1] = now
                now, done = ends_inside(text, True) if now else first_state(text), i + 1
            state[done:] = now
            begun = self.rows[s] + np.cumsum(~state[:-1] & ~blank)
            self.inside[s] = now
            self.rows[s] = int(begun[-1]) if n else self.rows[s]
            before.append(pa.array(state[:-1]))
            after.append(pa.array(state[1:]))
            rows.append(pa.array(begun))
        at = pa.array(np.arange(self.at, self.at + n))
        self.at += n
        return [at, values, *before, *after, *rows]


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in LINES.split(", ")]
    now = None
    for batch in batches:
        files, blocks = batch.column(0), np.asarray(batch.column(1))
        coded = files.dictionary_encode()
        code = np.asarray(coded.indices)
        cuts = np.flatnonzero((code[1:] != code[:-1]) | (blocks[1:] != blocks[:-1])) + 1 if len(code) else []
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if lo == hi:
                continue
            key = files[lo].as_py(), int(blocks[lo])
            if now is None or now.key != key:
                now = _Follow(key)
            yield pa.RecordBatch.from_arrays(
                [files.slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), *now.lines(batch.column(2).slice(lo, hi - lo))], names=names)


def _composed(splits: pa.Table) -> pa.Table:
    """State and rows at the start of each split of one file."""
    ordered, inside, rows = splits.sort_by("block").to_pylist(), False, 0
    out = []
    for s in ordered:
        out.append((s["file"], s["block"], inside, rows))
        side = "in" if inside else "out"
        inside, rows = s[f"after_if_{side}"], rows + s[f"rows_if_{side}"]
    columns = list(zip(*out, strict=True))
    return pa.table({"file": pa.array(columns[0], pa.string()), "block": pa.array(columns[1], pa.int64()),
                     "inside": pa.array(columns[2], pa.bool_()), "rows_before": pa.array(columns[3], pa.int64())})


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    csv.field_size_limit(LARGEST_CELL)
    for batch in batches:
        cells = [next(csv.reader([text])) if "\r" not in text else _with_returns(text) for text in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.list_(pa.string()))], names=["file", "row_no", "cells"])


def _with_returns(text: str) -> list[str]:
    """A row with carriage returns, which end no row here, by a stand-in that the text doesn't have."""
    mark = next(chr(c) for c in range(0xE000, 0xF8FF) if chr(c) not in text)
    return [cell.replace(mark, "\r") for cell in next(csv.reader([text.replace("\r", mark)]))]


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """``file, row_no, cells`` of every row; the header of a file is its row 0."""
    text = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.make_valid_utf8("value").alias("value"))
    # Written once: the splits of a file may differ from one reading to the next.
    lines = stored(text.mapInArrow(_followed, LINES), "csv-lines")
    last = F.max_by(F.struct("after_if_out", "after_if_in", "rows_if_out", "rows_if_in"), "at")
    splits = lines.groupBy("file", "block").agg(last.alias("last")).select("file", "block", "last.*")
    starts = splits.groupBy("file").applyInArrow(_composed, SPLITS)

    def side(name: str) -> Column:
        return F.when(F.col("inside"), F.col(f"{name}_if_in")).otherwise(F.col(f"{name}_if_out"))

    placed = lines.join(starts, ["file", "block"]).select(
        "file", "block", "at", "value", side("in").alias("goes_on"), side("after").alias("stays_open"),
        (F.col("rows_before") + side("rows") - 1).alias("row_no"))
    ended = F.regexp_replace("value", "\r$", "")
    whole = placed.filter(~F.col("goes_on") & ~F.col("stays_open") & (ended != "")).select("file", "row_no", ended.alias("value"))
    # Rows of several lines, which may lie in several splits.
    parts = placed.filter(F.col("goes_on") | F.col("stays_open")).groupBy("file", "row_no").agg(
        F.expr("listagg(value, '\\n') WITHIN GROUP (ORDER BY block, at)").alias("value"))
    rows = whole.unionByName(parts.withColumn("value", ended))
    return rows.mapInArrow(_cells, "file string, row_no bigint, cells array<string>")
