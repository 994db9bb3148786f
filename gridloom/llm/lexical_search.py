"""Ranked lexical search: MaxScore over index segments, with bounds of term pairs.

Documents are indexed in segments, each a row whose postings are packed bytes, so that Spark carries a few MB for each
and nothing of what is in it. For the terms of a set of queries a segment then gets
impacts (what a term adds to a document's score) and, for pairs of terms that stand in one query, intersection lists:
the documents that hold both, with the joint impact and its maximum. No document gets more from the two terms than the
largest of the joint maximum and the maxima of either alone, which is less than the sum of both maxima. A query bounds
its terms by disjoint pairs, so that more of its terms can wait until a document has shown what it gets from the others.

All numbers of a score but the weights are whole, so that a bound never cuts off a document by rounding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm import words as W
from gridloom.session import cut, small_batches

#: Distinct (query, term) pairs of a block of queries, which is sent to all tasks.
BLOCK_TERMS = 100_000
#: Scores: impact is weight * ((SCALE * tf) div (1000 * tf + 8 * m)), m is BASE + ((SLOPE * n * N) div L).
SCALE, BASE, SLOPE = 1_000_000_000, 10, 90

_SEGMENT = "docs array<{id}>, n_terms bigint, postings binary"
#: Rows are few and long: a writer looks at its sizes after each, and what is packed is not compressed again.
_FILES = {"compression": "uncompressed", "parquet.block.size": "8388608", "parquet.page.size.row.check.min": "1", "parquet.enable.dictionary": "false"}


def _byte_table() -> bytes:
    """ASCII letters in lower case, digits and all bytes beyond ASCII as they are, other bytes as blanks."""
    return bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))


_LOWER = _byte_table()


def terms_of(text: pa.Array) -> W.Words:
    """Terms ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of each text, A-Z in lower case; a null text has none."""
    text = pa.concat_arrays([pc.fill_null(text.cast(pa.string()), "")])
    _, offsets, data = text.buffers()
    return W.split(pa.Array.from_buffers(pa.string(), len(text), [None, offsets, pa.py_buffer((data or pa.py_buffer(b"")).to_pybytes().translate(_LOWER))], offset=text.offset))


def _list(values, starts=None) -> pa.Array:
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)] if starts is None else starts, pa.int32()), values)


def _pack(row: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(row)
    return sink.getvalue().to_pybytes()


def _unpacked(batch: pa.RecordBatch, name: str) -> Iterator[tuple[pa.RecordBatch, Callable[[str], pa.Array], Callable[[str], np.ndarray]]]:
    """For each row the row itself and what is packed in its column ``name``: lists by their names, and lists of numbers."""
    for row in range(batch.num_rows):
        packed = pa.ipc.open_stream(batch.column(name)[row].as_buffer()).read_next_batch()
        col = lambda name, packed=packed: packed.column(name)[0].values
        yield batch.slice(row, 1), col, lambda name, col=col: col(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in W.slices(batches):
        found = terms_of(batch.column("text"))
        sizes = np.diff(found.starts)
        held = np.flatnonzero(sizes)  # documents without a term are in no list
        owner = np.repeat(np.arange(len(held)), sizes[held])
        key, tf = np.unique(found.codes.astype(np.int64) * max(1, len(held)) + owner, return_counts=True)
        term, at = key // max(1, len(held)), key % max(1, len(held))
        shown, first = np.unique(term, return_index=True)
        yield pa.RecordBatch.from_arrays(
            [
                _list(batch.column("doc_id").take(pa.array(held))), _list(pa.array(sizes[held], pa.int32())), _list(found.vocab.take(pa.array(shown)).cast(pa.string())),
                _list(pa.array(np.append(first, len(at)), pa.int32())), _list(pa.array(at, pa.int32())), _list(pa.array(tf, pa.int32())),
            ],
            ["docs", "sizes", "terms", "starts", "at", "tf"],
        )


def build_index(docs: DataFrame, path: str) -> DataFrame:
    """Write the inverted index of all texts of ``docs`` (doc_id, text) to the new folder ``path`` and read it.

    Each row is a segment of about ``W.SLICE_CHARS`` characters or of one longer text: its documents and how many terms
    they have, and packed their sizes in terms, the terms, and the postings of term i from ``starts[i]`` to
    ``starts[i + 1]``. Other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = _SEGMENT.format(id=kind)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _index(batches):
            n_terms = pa.array([pc.sum(found.column("sizes")[0].values).as_py() or 0], pa.int64())
            packed = pa.array([_pack(found.select(["sizes", "terms", "starts", "at", "tf"]))], pa.binary())
            yield pa.RecordBatch.from_arrays([found.column("docs"), n_terms, packed], ["docs", "n_terms", "postings"])

    docs.select("doc_id", "text").mapInArrow(task, schema).write.options(**_FILES).parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), distinct, of the texts of ``items`` (item_id, text); rows of one item_id are one item."""
    kind = items.schema["item_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            found = terms_of(batch.column("text"))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(found.starts))
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(owner)), found.vocab.take(pa.array(found.codes)).cast(pa.string())], ["item_id", "term"])

    return items.select("item_id", "text").mapInArrow(task, f"item_id {kind}, term string").distinct()


def weights(index: DataFrame, terms: DataFrame) -> tuple[DataFrame, int, int]:
    """(term, w) of the ``terms`` that some document holds, the number of documents with a term, and that of their terms."""
    n_docs, n_terms = index.agg(F.sum(F.size("docs")), F.sum("n_terms")).first()
    n_docs, n_terms = n_docs or 0, n_terms or 0

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, col, num in _unpacked(batch, "postings"):
                yield pa.RecordBatch.from_arrays([col("terms"), pa.array(np.diff(num("starts")), pa.int64())], ["term", "df"])

    posted = index.select("postings").mapInArrow(task, "term string, df bigint")
    df = posted.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    w = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    return df.select("term", w.cast("long").alias("w")), n_docs, n_terms


class Block:
    """Queries of a block as codes of its terms (those that some document holds), with the terms' weights.

    ``pairs``: of each query its terms two by two in ascending order of weight, so that a pair's terms have like bounds
    and rare terms, which seldom meet, are paired with one another.
    """

    def __init__(self, rows: list[tuple]):
        self.terms = sorted({r[1] for r in rows})
        code = {t: i for i, t in enumerate(self.terms)}
        self.w = np.zeros(len(self.terms), np.int64)
        held: dict = {}
        for item, term, w in rows:
            self.w[code[term]] = w
            held.setdefault(item, []).append(code[term])
        self.items = list(held)
        self.codes = [np.array(sorted(c, key=lambda t: (self.w[t], t)), np.int64) for c in held.values()]
        self.pairs = sorted({(min(a, b), max(a, b)) for c in self.codes for a, b in zip(c[:-1:2].tolist(), c[1::2].tolist())})


def impacts(tf: np.ndarray, size: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term of weight 1 adds to the score of a document of so many terms."""
    m = BASE + SLOPE * size * n_docs // n_terms
    return SCALE * tf // (1000 * tf + 8 * m)


_PAIR_INDEX = "docs array<{id}>, lists binary"


def pair_index(index: DataFrame, block: Block, n_docs: int, n_terms: int) -> DataFrame:
    """For each segment the postings of the block's terms with impacts, and intersection lists of its pairs, packed.

    pairs holds places in ``block.pairs``; list k is ``pair_at[pair_starts[k]:pair_starts[k + 1]]``, with joint impacts
    beside it and their maximum in ``joint_max[k]``. Pairs that no document of the segment holds have no list.
    """
    kind = index.schema["docs"].dataType.elementType.simpleString()
    spark = index.sparkSession
    sent = spark.sparkContext.broadcast((pa.array(block.terms, pa.string()), block.w, block.pairs))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, w, pairs = sent.value
        first, second = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        for batch in batches:
            for row, col, num in _unpacked(batch, "postings"):
                code = pc.fill_null(pc.index_in(col("terms"), value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                mine = np.flatnonzero(code >= 0)
                mine = mine[np.argsort(code[mine])]
                starts = num("starts")
                count = np.diff(starts)[mine]
                begin = np.concatenate([[0], np.cumsum(count)])
                posted = np.repeat(starts[mine] - begin[:-1], count) + np.arange(begin[-1])
                at = num("at")[posted]
                impact = impacts(num("tf")[posted], num("sizes")[at], n_docs, n_terms) * np.repeat(w[code[mine]], count)
                place = np.full(len(w), -1)
                place[code[mine]] = np.arange(len(mine))
                lists = []
                for k in np.flatnonzero((place[first] >= 0) & (place[second] >= 0)) if len(pairs) else []:
                    (a, b), (c, d) = ((begin[p], begin[p + 1]) for p in (place[first[k]], place[second[k]]))
                    if d - c < b - a:
                        a, b, c, d = c, d, a, b
                    seek = np.searchsorted(at[c:d], at[a:b])
                    both = np.flatnonzero((seek < d - c) & (at[np.minimum(c + seek, d - 1)] == at[a:b]))
                    if len(both):
                        lists.append((k, at[a:b][both], impact[a:b][both] + impact[c + seek[both]]))
                sizes = [len(x[1]) for x in lists]
                made = pa.RecordBatch.from_arrays(
                    [
                        _list(pa.array(code[mine], pa.int32())), _list(pa.array(begin, pa.int32())), _list(pa.array(at, pa.int32())), _list(pa.array(impact, pa.int64())),
                        _list(pa.array([x[0] for x in lists], pa.int32())), _list(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())),
                        _list(pa.array(np.concatenate([x[1] for x in lists]) if lists else [], pa.int32())),
                        _list(pa.array(np.concatenate([x[2] for x in lists]) if lists else [], pa.int64())), _list(pa.array([x[2].max() for x in lists], pa.int64())),
                    ],
                    ["terms", "starts", "at", "impact", "pairs", "pair_starts", "pair_at", "joint", "joint_max"],
                )
                yield pa.RecordBatch.from_arrays([row.column("docs"), pa.array([_pack(made)], pa.binary())], ["docs", "lists"])

    return index.mapInArrow(task, _PAIR_INDEX.format(id=kind))


class Segment:
    """A segment's postings and intersection lists of a block's terms and pairs."""

    def __init__(self, n_docs: int, terms, starts, at, impact, pairs, pair_starts, pair_at, joint, joint_max, n_terms: int):
        self.at, self.impact, self.pair_at, self.joint = at, impact, pair_at, joint
        self.n_docs, self._reached = n_docs, {}
        self.begin, self.end, self.top = np.zeros(n_terms, np.int64), np.zeros(n_terms, np.int64), np.zeros(n_terms, np.int64)
        self.begin[terms], self.end[terms] = starts[:-1], starts[1:]
        if len(terms):
            self.top[terms] = np.maximum.reduceat(impact, starts[:-1])
        self.lists = {k: (a, b, m) for k, a, b, m in zip(pairs.tolist(), pair_starts[:-1].tolist(), pair_starts[1:].tolist(), joint_max.tolist())}

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.begin[term], self.end[term]
        return self.at[a:b], self.impact[a:b]

    def reached(self, term: int, k: int) -> int:
        """What at least k documents get from the term."""
        if (term, k) not in self._reached:
            self._reached[term, k] = _least(self.of(term)[1], k)
        return self._reached[term, k]

    def joint_top(self, pair: int, x: int, y: int) -> int:
        """The most that a document gets from two terms."""
        return max(self.top[x], self.top[y], self.lists[pair][2] if pair in self.lists else 0)


def _least(best: np.ndarray, k: int) -> int:
    """The k-th largest score, 0 if there are fewer."""
    return int(np.partition(best, len(best) - k)[len(best) - k]) if len(best) >= k else 0


def best_in(segment: Segment, codes: np.ndarray, pair_of: dict, k: int, floor: int, counts: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of a segment, which hold all that are among the best k for a query and score at least ``floor``.

    ``floor`` is a score that k documents elsewhere reach. ``counts`` adds up how many documents were opened and how many
    the bounds of single terms would have opened.
    """
    codes = codes[segment.end[codes] > segment.begin[codes]]
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # disjoint pairs, and the most that a document gets from both terms
    mates, left = {}, codes.tolist()
    while left:
        x = left.pop(0)
        y = next((y for y in left if (min(x, y), max(x, y)) in pair_of), None)
        if y is not None:
            left.remove(y)
            pair = pair_of[min(x, y), max(x, y)]
            mates[x], mates[y] = (y, pair), (x, pair)
    # k documents of a term's or a pair's list reach so much from it alone
    for t in codes.tolist():
        floor = max(floor, segment.reached(t, k))
        if t in mates and mates[t][1] in segment.lists:
            floor = max(floor, _least(segment.joint[slice(*segment.lists[mates[t][1]][:2])], k))
    # terms wait as long as a document that has only such terms stays below the floor; a pair of them counts jointly
    bound_of, total = {}, 0
    for t in codes[np.argsort(segment.top[codes], kind="stable")].tolist():
        mate, pair = mates.get(t, (None, -1))
        both = mate in bound_of
        more = segment.joint_top(pair, t, mate) - bound_of[mate] if both else int(segment.top[t])
        if total + more < floor:
            total, bound_of[t] = total + more, more
    groups = []
    for t in bound_of:
        mate, pair = mates.get(t, (None, -1))
        if mate not in bound_of:
            groups.append((int(segment.top[t]), (t,)))
        elif t < mate:
            groups.append((segment.joint_top(pair, t, mate), (t, mate)))
    groups.sort(key=lambda g: g[0])
    bound = np.cumsum([g[0] for g in groups])
    score = np.zeros(segment.n_docs, np.int64)
    for t in codes.tolist():
        if t not in bound_of:
            at, impact = segment.of(t)
            score[at] += impact
    docs = np.flatnonzero(score)
    if counts is not None:
        alone = np.sort(segment.top[codes])
        skipped = int(np.searchsorted(np.cumsum(alone), floor, side="left"))
        seen = np.zeros(segment.n_docs, bool)
        for t in codes[np.argsort(segment.top[codes], kind="stable")][skipped:]:
            seen[segment.of(t)[0]] = True
        counts["opened"] = counts.get("opened", 0) + len(docs)
        counts["opened_alone"] = counts.get("opened_alone", 0) + int(seen.sum())
    for g in range(len(groups) - 1, -1, -1):
        floor = max(floor, _least(score[docs], k))
        docs = docs[score[docs] + bound[g] >= floor]
        for t in groups[g][1]:
            at, impact = segment.of(t)
            if len(at):
                seek = np.minimum(np.searchsorted(at, docs), len(at) - 1)
                score[docs] += np.where(at[seek] == docs, impact[seek], 0)
    floor = max(floor, _least(score[docs], k))
    docs = docs[score[docs] >= floor]
    return docs, score[docs]


def _search(sent, k: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, pairs, n_terms = sent.value
        pair_of = {p: i for i, p in enumerate(pairs)}
        found: list[list[tuple[pa.Array, np.ndarray]]] = [[] for _ in codes]
        floors = [0] * len(codes)
        kind = None
        for batch in batches:
            for row, _, num in _unpacked(batch, "lists"):
                docs = row.column("docs")[0].values
                kind = docs.type
                segment = Segment(len(docs), *(num(c) for c in ("terms", "starts", "at", "impact", "pairs", "pair_starts", "pair_at", "joint", "joint_max")), n_terms)
                for q, terms in enumerate(codes):
                    at, score = best_in(segment, terms, pair_of, k, floors[q])
                    if len(at):
                        found[q].append((docs.take(pa.array(at)), score))
                        ids, scores = pa.concat_arrays([f[0] for f in found[q]]), np.concatenate([f[1] for f in found[q]])
                        floors[q] = max(floors[q], _least(scores, k))
                        # of those that tie with the last the smaller doc_ids count, null ones last
                        order = pc.sort_indices(pa.table({"s": -scores, "d": ids}), sort_keys=[("s", "ascending"), ("d", "ascending")], null_placement="at_end")[:k]
                        found[q] = [(ids.take(order), scores[order.to_numpy()])]
        for q, parts in enumerate(found):
            for ids, scores in parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), q), pa.int32()), ids.cast(kind), pa.array(scores, pa.int64())], ["query", "doc_id", "score"])

    return task


def search(pairs: DataFrame, block: Block, k: int) -> DataFrame:
    """(query, doc_id, score): what each task over segments of ``pair_index`` holds for its best k; query is a place in ``block.items``."""
    kind = pairs.schema["docs"].dataType.elementType.simpleString()
    sent = pairs.sparkSession.sparkContext.broadcast((block.codes, block.pairs, len(block.terms)))
    return pairs.mapInArrow(_search(sent, k), f"query int, doc_id {kind}, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each item, equal scores by ascending doc_id.

    ``docs`` needs doc_id and text, ``items`` item_id and text; other columns are not read. Null and empty texts have no
    terms: such items have no rows, such documents are in no list. Rows of one item_id (null is one too) are one item
    with the terms of all; rows of one doc_id are documents of their own. A null doc_id comes last among equal scores.
    Empty tables give no rows. Items are asked in blocks of about ``BLOCK_TERMS`` terms, each a pass over the index.
    """
    from gridloom.session import scratch

    spark = docs.sparkSession
    index = build_index(docs, scratch(spark, "index"))
    asked = cut(query_terms(items), "queries")
    w, n_docs, n_terms = weights(index, asked)
    with small_batches(spark):
        weighed = cut(asked.join(w, "term").select("item_id", "term", "w", F.xxhash64("item_id").alias("deal")), "weights")
    blocks = max(1, -(-weighed.count() // BLOCK_TERMS))
    kind = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long")
    for b in range(blocks):
        block = Block([tuple(r) for r in weighed.where(F.expr(f"pmod(deal, {blocks}) = {b}")).select("item_id", "term", "w").collect()])
        if not block.items:
            continue
        names = spark.createDataFrame(list(enumerate(block.items)), f"query int, item_id {kind}")
        with small_batches(spark):
            best = cut(search(cut(pair_index(index, block, n_docs, n_terms), "pairs", **_FILES), block, k), "found")
        out = out.unionByName(best.join(names, "query").select("item_id", "doc_id", "score"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
