"""Language ID by cross-parsing: how few phrases of a language's labelled text a text falls into.

A suffix automaton of labelled running text per language yields the longest match from each phrase start (Ziv
and Merhav, 1993); matches cross blanks. Phrases are counted for each character.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridloom.llm import words as W

#: Bound of the fit: labelled documents for each language, and characters of the text of one.
SAMPLE_DOCS, SAMPLE_CHARS = 60, 2_000
#: Letters with a code of their own, the most frequent of the sample, and codes that all others share.
LETTERS, SHARED = 96, 31
#: Characters that are parsed together: a phrase ends with its stretch, in every text alike.
STRETCH = 512
ADDED = ("lang_pred", "score")


def automaton(codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix automaton of a running text of letter codes, as steps of a cross parse.

    Returns the table and, by state, the logarithm of how often its substrings occur. The table's entry at
    ``state * width + code`` is the next state times width; where no match goes on, or at the root, it is the
    state of the phrase that the letter opens, times width and with all bits flipped.
    """
    moves: list[dict[int, int]] = [{}]
    link, length, times, last = [-1], [0], [0], 0
    for k in codes.tolist():
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        times.append(1)
        p = last
        while p >= 0 and k not in moves[p]:
            moves[p][k] = new
            p = link[p]
        if p >= 0:
            q = moves[p][k]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                times.append(0)
                link[q] = link[new] = twin
                while p >= 0 and moves[p].get(k) == q:
                    moves[p][k] = twin
                    p = link[p]
        last = new
    for state in sorted(range(1, len(moves)), key=length.__getitem__, reverse=True):
        times[link[state]] += times[state]
    root = np.zeros(width, np.int32)
    root[list(moves[0])] = list(moves[0].values())
    table = np.empty((len(moves), width), np.int32)
    table[:] = ~(root * width)
    for state, to in enumerate(moves[1:], 1):
        table[state, list(to)] = np.array(list(to.values()), np.int32) * width
    times[0] = 1
    return table.ravel(), np.log(np.array(times, np.float32))


@lru_cache(1)
def _alphabetic() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@dataclass
class Model:
    langs: list[str]
    letters: str
    tables: list[np.ndarray]
    times: list[np.ndarray]

    @property
    def width(self) -> int:
        return 1 + len(self.letters) + SHARED

    def lookup(self) -> np.ndarray:
        """The code of each code point: 0 for all but letters, which have their own or a shared one."""
        points = np.arange(0x110000)
        code = np.where(_alphabetic(), 1 + len(self.letters) + points % SHARED, 0).astype(np.int16)
        code[list(map(ord, self.letters))] = np.arange(1, 1 + len(self.letters))
        return code

    def encode(self, text: pa.Array, lookup: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Letter codes of all texts and where each starts; runs of other characters are one blank, as are both ends."""
        low = pc.utf8_lower(pc.fill_null(text.cast(pa.string()), ""))
        size = pc.utf8_length(low).to_numpy(zero_copy_only=False).astype(np.int64) + 2
        starts = np.concatenate([[0], np.cumsum(size)])
        points = np.frombuffer("".join(f" {t} " for t in low.to_pylist()).encode("utf-32-le"), np.uint32)
        codes = lookup[points]
        keep = codes != 0
        keep[1:] |= codes[:-1] != 0
        keep[starts[:-1]] = True
        return codes[keep].astype(np.int32), np.concatenate([[0], np.cumsum(keep)])[starts]

    def phrases(self, codes: np.ndarray, starts: np.ndarray, often: bool = False) -> np.ndarray:
        """Phrases of each text by language, or how often they occur in the labelled text (sum of logarithms)."""
        size = np.diff(starts)
        cuts = -(-size // STRETCH)
        owner = np.repeat(np.arange(len(size)), cuts)
        begin = starts[:-1][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * STRETCH
        long = np.minimum(starts[1:][owner] - begin, STRETCH)
        order = np.argsort(-long, kind="stable")
        owner, begin, long = owner[order], begin[order], long[order]
        live = np.searchsorted(-long, -np.arange(long.max(initial=0)))
        state, count = [np.zeros(len(owner), np.int32) for _ in self.langs], [np.zeros(len(owner), np.float32 if often else np.int32) for _ in self.langs]
        for step, n in enumerate(live):
            c = codes[begin[:n] + step]
            for table, times, at, total in zip(self.tables, self.times, state, count):
                to = table.take(at[:n] + c)
                opens = to >> 31  # all bits where a phrase opens
                if often:
                    total[:n] += times[at[:n] // self.width] * (opens != 0)
                else:
                    total[:n] -= opens
                at[:n] = to ^ opens
        if often:
            count = [total + times[at // self.width] for times, at, total in zip(self.times, state, count)]
        return np.stack([np.bincount(owner, total, len(size)) for total in count], 1)


def fit(labelled: DataFrame) -> Model:
    """Learn from (doc_id, text, lang), from whole texts of a bounded sample.

    Of each language the at most SAMPLE_DOCS documents of least hash are taken among those of at most
    SAMPLE_CHARS characters; a language that has none is learned from its shortest text. Rows with a null
    in any of the three say nothing; of rows that share doc_id and language the least text counts.
    """
    usable = labelled.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "lang", "text")
    over = F.greatest(F.char_length("text"), F.lit(SAMPLE_CHARS)).alias("size")
    sizes = usable.groupBy("doc_id", "lang").agg(F.min(over).alias("size"))
    order = Window.partitionBy("lang").orderBy("size", F.xxhash64("doc_id"), "doc_id")
    # ids first, so that no text is sorted; as many rows as languages times the bound come to the driver
    ids = sizes.withColumn("n", F.row_number().over(order)).where((F.col("n") <= SAMPLE_DOCS) & ((F.col("size") <= SAMPLE_CHARS) | (F.col("n") == 1)))
    drawn = usable.withColumn("size", over).join(F.broadcast(ids.drop("n")), ["doc_id", "lang", "size"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    texts: dict[str, list[tuple]] = {}
    for row in drawn.collect():
        texts.setdefault(row.lang, []).append((row.doc_id, row.text))
    seen = Counter(c for own in texts.values() for _, t in own for c in pc.utf8_lower(pa.scalar(t)).as_py() if c.isalpha())
    letters = "".join(c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:LETTERS])
    model = Model(sorted(texts), letters, [], [])
    lookup = model.lookup()
    for lang in model.langs:
        codes, _ = model.encode(pa.array([" ".join(t for _, t in sorted(texts[lang]))]), lookup)
        table, times = automaton(codes, model.width)
        model.tables.append(table)
        model.times.append(times)
    return model


def _predict(shared):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, names = shared.value, np.array([*shared.value.langs, "und"], object)
        lookup = model.lookup()
        for part in W.slices(batches):
            codes, starts = model.encode(part.column("text"), lookup)
            n = len(starts) - 1
            best, score = np.full(n, len(model.langs)), np.zeros(n)
            some = np.flatnonzero(np.diff(starts) > 1)  # a blank alone is a text without letters
            if model.langs and len(some):
                count = model.phrases(codes, starts)[some]
                rate = count / np.diff(starts)[some, None]
                low = count == count.min(1, keepdims=True)
                best[some] = low.argmax(1)
                score[some] = 1 / np.exp(-20 * (rate - rate.min(1, keepdims=True))).sum(1)
                ties = np.flatnonzero(low.sum(1) > 1)
                if len(ties):
                    at = some[ties]
                    own = [codes[starts[k] : starts[k + 1]] for k in at]
                    often = model.phrases(np.concatenate(own), np.cumsum([0, *map(len, own)]), often=True)
                    best[at] = np.where(low[ties], often, -np.inf).argmax(1)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names[best], pa.string()), pa.array(score)], [*part.schema.names, *ADDED])

    return task


def language_id(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score`` (0 to 1, the share of the best language).

    Reads only the text. Null text or text without a letter: ``und``, score 0; so is every text if nothing
    was learned. Equal phrase counts: the language in whose labelled text the phrases occur more often, then
    the first in order of names. Rows are treated one by one; a
    column named like an added one is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(*ADDED)
    return docs.mapInArrow(_predict(shared), T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
