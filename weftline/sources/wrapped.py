"""Wrapped FASTQ: records whose sequences and qualities go over several lines, read from all splits of a file at once.

Whether a line begins a record depends on all lines before it: a line that starts with @ may be part of a quality, which ends when it is
as long as its sequence.  So reading is an automaton over lines, between records, within a sequence of some length so far,
or within a quality that lacks some characters.

1. Every split is read without knowing its entry state, and gives a summary: its exit state for each possible entry state.
   Lengths before the split have no bound, but only where the open record ends counts, and records that begin at different
   lines soon run into the same ones, so a summary is a few intervals of lengths, each with an exit state.
2. The summaries of a file, a row for each split, are composed in order of position, which gives each split's entry state.
3. Every split is read again from its entry state and cuts its records.  Those that cross borders give a piece for each split,
   joined after.

So no task reads more than its splits, whatever their size.  A compressed file is one split.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.shared import written

#: States between records, within a sequence (with its length so far), within a quality (with what it lacks).
BETWEEN, SEQUENCE, QUALITY = 0, 1, 2
PIECES = "file string, owner long, block long, name string, comment string, seq string, qual string, whole boolean"


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[pa.RecordBatch]]]:
    """The batches of each split: rows of one file and block follow each other."""
    key, held = None, iter(())

    def parts() -> Iterator[tuple[tuple, pa.RecordBatch]]:
        for batch in batches:
            if not batch.num_rows:
                continue
            files, blocks = batch.column("file").dictionary_encode(), batch.column("block").to_numpy()
            code = files.indices.to_numpy()
            cuts = [0, *(np.flatnonzero((code[1:] != code[:-1]) | (blocks[1:] != blocks[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield (batch.column("file")[a].as_py(), int(blocks[a])), batch.slice(a, b - a)

    source = parts()
    following = next(source, None)

    def run() -> Iterator[pa.RecordBatch]:
        nonlocal following
        while following is not None and following[0] == key:
            yield following[1]
            following = next(source, None)

    while following is not None:
        key, held = following[0], run()
        yield key, held
        for _ in held:  # what the reader has left
            pass


def summary(lengths: np.ndarray, heads: np.ndarray, plus: np.ndarray) -> dict:
    """What a split does to any entry state.  lengths of its lines, positions of lines that start with @ and of those with +."""
    n = len(lengths)
    upto = np.concatenate([[0], np.cumsum(lengths)])
    # of each possible record: the line after its quality, or the state at the end of the split
    at = np.searchsorted(plus, heads + 1)
    has = at < len(plus)
    mark = plus[at[has]]
    seq = upto[mark] - upto[heads[has] + 1]
    goal = upto[mark + 1] + seq
    stop = np.maximum(np.searchsorted(upto, goal, "left"), mark + 1)
    ends: list[tuple[int, int] | None] = [(SEQUENCE, int(upto[n] - upto[h + 1])) for h in heads]
    follows = np.zeros(len(heads), np.int64)
    for k, e, g in zip(np.flatnonzero(has).tolist(), stop.tolist(), goal.tolist(), strict=True):
        ends[k] = None if e <= n else (QUALITY, int(g - upto[n]))
        follows[k] = e
    then = np.searchsorted(heads, follows)
    exits: list[tuple[int, int]] = [(BETWEEN, 0)] * (len(heads) + 1)
    for k in range(len(heads) - 1, -1, -1):
        exits[k] = ends[k] or exits[int(then[k])]
    numbers: dict[tuple[int, int], int] = {}
    code = np.array([numbers.setdefault(x, len(numbers)) for x in exits])
    states = list(numbers)

    def intervals(first: int, start: int) -> list:
        """[greatest length, exit] where a record ends before each line from first on, its quality beginning at start."""
        lines = np.arange(first, n + 1)
        own, most = code[np.searchsorted(heads, lines)], upto[lines] - upto[start]
        last = np.flatnonzero(np.append(own[1:] != own[:-1], True))
        return [[int(most[i]), *states[own[i]]] for i in last]

    sequence = None
    if len(plus):
        p = int(plus[0])
        before = int(upto[p])
        sequence = {"before": before, "rest": int(upto[n] - upto[p + 1]), "ends": [[most - before, *state] for most, *state in intervals(p + 1, p + 1)]}
    return {"total": int(upto[n]), "between": exits[0], "quality": intervals(1, 0), "sequence": sequence}


def after(split: dict, block: int, state: tuple[int, int, int]) -> tuple[int, int, int]:
    """(kind, length, block in which the open record begins) after a split."""
    kind, length, owner = state

    def ended(ends: list, value: int) -> tuple[int, int, int] | None:
        found = next((x for x in ends if value <= x[0]), None)
        return (*found[1:], block) if found else None

    if kind == BETWEEN:
        return (*split["between"], block)
    if kind == QUALITY:
        return ended(split["quality"], length) or (QUALITY, length - split["total"], owner)
    own = split["sequence"]
    if own is None:
        return SEQUENCE, length + split["total"], owner
    return ended(own["ends"], length) or (QUALITY, length + own["before"] - own["rest"], owner)


def _trimmed(batch: pa.RecordBatch) -> pa.Array:
    return pc.utf8_rtrim_whitespace(batch.column("value"))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (file, block), parts in _splits(batches):
        lengths, heads, plus, at = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        for batch in parts:
            text = _trimmed(batch)
            lengths.append(pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
            for mark, found in (("@", heads), ("+", plus)):
                found.append(np.flatnonzero(pc.starts_with(text, mark).to_numpy(zero_copy_only=False)) + at)
            at += batch.num_rows
        told = summary(np.concatenate(lengths), np.concatenate(heads), np.concatenate(plus))
        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([json.dumps(told)])], names=["file", "block", "told"])


def _entries(splits: pd.DataFrame) -> pd.DataFrame:
    """The entry state of each split of a file."""
    state, out = (BETWEEN, 0, -1), []
    for r in splits.sort_values("block").itertuples():
        out.append((r.file, r.block, *state))
        state = after(json.loads(r.told), r.block, state)
    return pd.DataFrame(out, columns=["file", "block", "kind", "length", "owner"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of each split, and pieces of those that cross its borders."""
    for (file, block), parts in _splits(batches):
        out: list[tuple] = []
        kind = None
        name = comment = None
        seq: list[str] = []
        qual: list[str] = []

        def closed(whole: bool) -> None:
            out.append((file, owner, block, name, comment, "".join(seq), "".join(qual), whole))

        for batch in parts:
            if kind is None:
                kind, left, owner = (batch.column(c)[0].as_py() for c in ("kind", "length", "owner"))
            for line in _trimmed(batch).to_pylist():
                if kind == BETWEEN:
                    if line.startswith("@"):
                        name, _, comment = line[1:].partition(" ")
                        comment, seq, qual, left, owner, kind = comment.strip(), [], [], 0, block, SEQUENCE
                elif kind == SEQUENCE:
                    if line.startswith("+"):
                        kind = QUALITY if left else BETWEEN
                        if not left:
                            closed(owner == block)
                    else:
                        seq.append(line)
                        left += len(line)
                else:
                    qual.append(line)
                    left -= len(line)
                    if left <= 0:
                        closed(owner == block)
                        kind = BETWEEN
                if kind == BETWEEN and owner != block:
                    owner, name, comment, seq, qual = block, None, None, [], []
            if len(out) >= 10_000:
                yield _rows(out)
                out = []
        if kind != BETWEEN:
            closed(False)
        yield _rows(out)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in PIECES.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.bool_()]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def wrapped_fastq(spark: SparkSession, path: str) -> DataFrame:
    """name, comment, seq, qual of every record; one whose quality is not as long as its sequence is an error, also where a file
    ends within it."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    told = lines.mapInArrow(_summaries, "file string, block long, told string")
    entries = written(told.groupBy("file").applyInPandas(_entries, "file string, block long, kind int, length long, owner long"), "entries")
    cut = written(lines.join(F.broadcast(entries), ["file", "block"]).mapInArrow(_cut, PIECES), "records")  # a row for each split
    pieces = F.sort_array(F.collect_list(F.struct("block", "seq", "qual")))
    crossing = cut.where(~F.col("whole")).groupBy("file", "owner").agg(F.max("name").alias("name"), F.max("comment").alias("comment"), pieces.alias("p"))
    joined = lambda c: F.array_join(F.transform("p", lambda x: x[c]), "").alias(c)
    every = cut.where("whole").select("name", "comment", "seq", "qual").unionByName(crossing.select("name", "comment", joined("seq"), joined("qual")))
    wrong = F.raise_error(F.concat(F.lit("quality and sequence differ in length: "), F.col("name")))
    return every.select("name", "comment", "seq", F.when(F.length("qual") == F.length("seq"), F.col("qual")).otherwise(wrong).alias("qual"))
