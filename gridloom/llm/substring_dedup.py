"""Substring dedup: remove words covered by a passage that occurs earlier in the corpus.

Level-wise doubling from five words over ten to twenty. The five words stand for a run of neighbouring
20-word windows: the least hashed five words inside a window are the same wherever the window stands,
so that a window that repeats has five words that repeat. Only five words that repeat are extended to
ten, and only ten that repeat to the windows of twenty; twenty is the length asked for, where it ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import words as W
from gridloom.session import cut

#: Words of the first level; the last level has BASE * 2 ** DOUBLINGS words.
BASE, DOUBLINGS = 5, 2
WINDOW = BASE * 2**DOUBLINGS
_SPAN = "doc_id long, at int, n int, anchor long, span long"
_HALF = "doc_id long, at int, n int, anchor long, half long"
_WINDOW = "doc_id long, at int, anchor long, window long"
ADDED = ("n_words", "n_removed", "kept_text")
COVERS = "__covers"


def doubled(h: np.ndarray) -> list[np.ndarray]:
    """Window hashes of each level, by position of the first word."""
    levels = [W.windows(h, BASE)]
    for k in range(DOUBLINGS):
        step = BASE * 2**k
        below = levels[-1]
        levels.append(W.combine(below[: max(0, len(below) - step)], below[step:]))
    return levels


def anchors(base: np.ndarray) -> np.ndarray:
    """For each full window the position of its least base window, the first of equal ones."""
    least, at = base, np.arange(len(base))
    reach, need = 1, WINDOW - BASE + 1
    while reach < need:
        step = min(reach, need - reach)
        right = least[step:] < least[:-step]
        at = np.where(right, at[step:], at[:-step])
        least = np.where(right, least[step:], least[:-step])
        reach += step
    return at


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring windows with one anchor as one row: first position, count, anchor hash, hash of all their words."""
    for part in W.slices(batches):
        w = W.split(part.column("text"))
        if len(w) < WINDOW:
            continue
        with np.errstate(over="ignore"):
            levels = doubled(w.hashes())
            at = anchors(levels[0])
            start = np.flatnonzero(w.ends()[: len(at)] - np.arange(len(at)) >= WINDOW)
            at = at[start]
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
            n = np.diff(np.append(first, len(at)))
            start, at = start[first], at[first]
            span = W.combine(W.combine(levels[-1][start], levels[-1][start + n - 1]), n.astype(np.uint64))
        text = np.searchsorted(w.starts, start, side="right") - 1
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id").take(pa.array(text)), pa.array((start - w.starts[text]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(W.signed(levels[0][at])), pa.array(W.signed(span))],
            ["doc_id", "at", "n", "anchor", "span"],
        )


def _lists(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Row of each entry of a list<struct> column, and the entries' fields."""
    flat = column.flatten()
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), size), {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The listed spans by the second level: ten words that start at the anchor, or end with it, inside all windows of the row."""
    wide = 2 * BASE
    for part in W.slices(batches):
        w = W.split(part.column("text"))
        row, span = _lists(part.column("spans"))
        ok = w.starts[row] + span["at"] + span["n"] + WINDOW - 1 <= w.starts[row + 1]  # not so only where rows share an id
        row, at, n, anchor = row[ok], span["at"][ok], span["n"][ok], span["anchor"][ok]
        if not len(row):
            continue
        with np.errstate(over="ignore"):
            levels = doubled(w.hashes())
            pos = anchors(levels[0])[w.starts[row] + at] - w.starts[row]
            after = np.minimum(np.maximum(at, pos - (WINDOW - wide)), at + n)  # from here on the windows hold the ten words from the anchor on
            sides = [(after, at + n - after, pos, 0), (at, after - at, pos - BASE, 1)]
            for lo, m, ten, side in sides:
                has = m > 0
                h = W.mix(levels[1][w.starts[row[has]] + ten[has]] + np.uint64(side))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row[has])), pa.array(lo[has].astype(np.int32)), pa.array(m[has].astype(np.int32)), pa.array(anchor[has]), pa.array(W.signed(h))],
                    ["doc_id", "at", "n", "anchor", "half"],
                )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The full windows of the spans listed with each text."""
    for part in W.slices(batches):
        w = W.split(part.column("text"))
        row, span = _lists(part.column("spans"))
        ok = w.starts[row] + span["at"] + span["n"] + WINDOW - 1 <= w.starts[row + 1]
        row, at, n, anchor = row[ok], span["at"][ok], span["n"][ok], span["anchor"][ok]
        if not len(row):
            continue
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at, row, anchor = np.repeat(at, n) + step, np.repeat(row, n), np.repeat(anchor, n)
        with np.errstate(over="ignore"):
            h = W.signed(doubled(w.hashes())[-1][w.starts[row] + at])
        yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array(at.astype(np.int32)), pa.array(anchor), pa.array(h)], ["doc_id", "at", "anchor", "window"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in W.slices(batches):
        w = W.split(part.column("text"))
        row, cover = _lists(part.column(COVERS))
        edge = np.zeros(len(w) + 1, np.int64)
        lo = np.minimum(w.starts[row] + cover["at"], w.starts[row + 1])
        hi = np.minimum(lo + cover["n"] + WINDOW - 1, w.starts[row + 1])
        np.add.at(edge, lo, 1)
        np.add.at(edge, hi, -1)
        keep = np.cumsum(edge)[:-1] == 0
        gone = np.concatenate([[0], np.cumsum(~keep)])
        rest = [c for c in part.schema.names if c != COVERS]
        made = [pa.array(np.diff(w.starts)), pa.array(np.diff(gone[w.starts])), w.joined(keep)]
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *made], [*rest, *ADDED])


def _listed(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Each text that has such spans, with all of them."""
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("at", "n", "anchor")).alias("spans"))
    return docs.where("doc_id is not null").select("doc_id", "text").join(spans, "doc_id").select("doc_id", "text", "spans")


def repeated(docs: DataFrame) -> DataFrame:
    """``(doc_id, at, n)``: n windows from word ``at`` on stand earlier in the corpus too."""
    place = F.struct("doc_id", "at")
    later = place != F.col("first")
    spans = docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(_spans, _SPAN)
    # five words; written, as a join of two shuffles can split a hot anchor
    level = spans.groupBy("anchor").agg(F.count("*").alias("copies"), F.min("span").alias("lo"), F.max("span").alias("hi"), F.min(place).alias("first"))
    level = cut(level.where("copies > 1").select("anchor", (F.col("lo") != F.col("hi")).alias("mixed"), "first"), "level")
    found = spans.join(level, "anchor").where(F.col("mixed") | later)
    found = cut(found.select("doc_id", "at", "n", "mixed", F.expr("if(mixed, anchor, null) anchor"), F.expr("if(mixed, span, null) span")), "spans")
    # where all words around an anchor are the same, the earliest stays; else equal spans stand for one another
    mixed = found.where("mixed").drop("mixed")
    heads = cut(mixed.groupBy("anchor", "span").agg(F.min(F.struct("doc_id", "at", "n")).alias("h")).select("anchor", "span", "h.*"), "heads")
    copies = mixed.join(heads.select("anchor", "span", F.struct("doc_id", "at").alias("first")), ["anchor", "span"]).where(later)
    # ten words
    halves = _listed(docs, heads).mapInArrow(_halves, _HALF)
    twice = halves.groupBy("anchor", "half").agg(F.count("*").alias("copies")).where("copies > 1").select("anchor", "half")
    # twenty words
    windows = _listed(docs, halves.join(twice, ["anchor", "half"])).mapInArrow(_windows, _WINDOW)
    firsts = windows.groupBy("anchor", "window").agg(F.count("*").alias("copies"), F.min(place).alias("first")).where("copies > 1").drop("copies")
    single = windows.join(firsts, ["anchor", "window"]).where(later).select("doc_id", "at", F.lit(1).alias("n"))
    return found.where("not mixed").select("doc_id", "at", "n").unionByName(copies.select("doc_id", "at", "n")).unionByName(single)


def substring_dedup(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with ``n_words``, ``n_removed`` and ``kept_text``.

    A word goes if a window of 20 words around it has the same words as one that starts earlier
    (smaller doc_id, or same document and earlier start). Windows are judged on the input. Kept words
    are joined by one space.

    Null text: no words, kept text empty. Texts under 20 words are kept. A row without doc_id is kept
    whole and compared with nothing. Rows that share a doc_id get what any of them must lose; among
    such rows equal windows at one place are not earlier than each other. Other columns pass through,
    but for one named like an added one, which is replaced. Windows are compared by two 64-bit hashes, of the window and of its anchor.
    """
    docs = docs.drop(*ADDED)
    covers = repeated(docs).groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias(COVERS))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    # both joins of the texts deal them out alike, so that Spark shuffles them once
    known = docs.where("doc_id is not null").join(covers, "doc_id", "left")
    return known.unionByName(docs.where("doc_id is null").withColumn(COVERS, F.lit(None))).mapInArrow(_kept, schema)
