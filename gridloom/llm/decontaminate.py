"""Benchmark decontamination: passages of the corpus as queries on a BM25 index of benchmark items.

Question and answer (the last sentence) of each item are cut into segments of their own. The inverted index
of segments has posting lists in blocks with a largest score each; block-max WAND retrieves every segment
over its threshold for a passage. An item is retrieved by any of its segments, and question and answer must
both stand in the document. As both are demanded, the document's shingles are looked up first, and only
passages that may retrieve an item found so are queries.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import words as W
from gridloom.llm.byte_bpe import gather
from gridloom.session import cut

SHINGLE = 5
#: Share of the shingles of a question, and of an answer, that a document must have.
OVERLAP = 0.8
#: Share of a segment's own score from which it is retrieved.
RETRIEVE = 0.7
#: Share of a segment's own score that its rarest terms make, by which passages are told from the rest.
RARE = 0.6
#: Bits of a hash by which shingles that no item has are told at first.
SIEVE_BITS = 18
#: Words of a segment at most, and of a passage; passages overlap by half, so that any segment stands in one.
SEGMENT, PASSAGE = 48, 96
BLOCK = 32
K1, B = 1.2, 0.75
#: Characters of items in one index; more items make more indexes, used one after another.
SHARD_CHARS = 8_000_000
_PUNCT = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def _words(text: str) -> list[str]:
    return re.sub(_PUNCT, " ", pc.utf8_lower(pa.scalar(text)).as_py()).split(" ")


def tokens(text: str) -> list[str]:
    return [w for w in _words(text) if w]


def parts(text: str) -> tuple[list[str], list[str]]:
    """Question and answer of an item: all but its last sentence, and that; one sentence is both."""
    sentences = [t for t in (tokens(s) for s in re.split(r"(?<=[.!?])\s+|\n+", text)) if t]
    if len(sentences) < 2:
        return (sentences[0], sentences[0]) if sentences else ([], [])
    return [w for s in sentences[:-1] for w in s], sentences[-1]


def shingles(words: list[str]) -> np.ndarray:
    """Distinct hashes of five words; fewer words are one shingle as a whole."""
    if not words:
        return np.zeros(0, np.uint64)
    w = W.split(pa.array([" ".join(words)]))
    with np.errstate(over="ignore"):
        return np.unique(W.windows(w.hashes(), min(SHINGLE, len(w))))


def cut_parts(question: list[str], answer: list[str]) -> list[list[str]]:
    """Segments of a question and of an answer, in equal slices of at most SEGMENT words; one sentence is cut once."""
    out = []
    for part in (question,) if answer is question else (question, answer):
        n = -(-len(part) // SEGMENT)
        out += [part[k * len(part) // n : (k + 1) * len(part) // n] for k in range(n)]
    return out


class Index:
    """BM25 index of segments of items.

    known: number of segments, their words, and for each term the segments that have it, of all items; without it those of ``items``.
    """

    def __init__(self, items: list[tuple[int, str]], known: tuple[int, int, dict[str, int]] | None = None):
        self.items, segments, grams = [], [], defaultdict(list)
        for item_id, text in items:
            question, answer = parts(text)
            if not question:
                continue
            for k, x in enumerate((question, answer)):
                grams[min(SHINGLE, len(x))].append((2 * len(self.items) + k, shingles(x)))
            segments += [(len(self.items), s) for s in cut_parts(question, answer)]
            self.items.append(item_id)
        self.owner = np.array([o for o, _ in segments], np.int64)
        total, length, holds = known or (len(segments), sum(len(s) for _, s in segments), Counter(t for _, s in segments for t in set(s)))
        mean = max(1.0, length / max(1, total))
        self.terms = sorted({t for _, s in segments for t in s})
        code = {t: k for k, t in enumerate(self.terms)}
        lists: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        full = np.zeros(len(segments))
        for k, (_, s) in enumerate(segments):
            for t, f in Counter(s).items():
                idf = math.log(1 + (total - holds[t] + 0.5) / (holds[t] + 0.5))
                score = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * len(s) / mean))
                lists[code[t]].append((k, score))
                full[k] += score
        self.need = RETRIEVE * full
        self.least = float(self.need.min()) if len(segments) else math.inf
        self.docs = [np.array([k for k, _ in x], np.int64) for x in lists]
        self.scores = [np.array([s for _, s in x]) for x in lists]
        self.tops = [np.maximum.reduceat(s, np.arange(0, len(s), BLOCK)) for s in self.scores]
        self.bound = np.array([s.max() for s in self.scores])
        self.vocab = pa.array(self.terms, pa.string())
        self.segment = np.concatenate(self.docs) if self.docs else np.zeros(0, np.int64)
        self.term = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        self.weight = np.concatenate(self.scores) if self.scores else np.zeros(0)
        # parts 2k and 2k + 1 are question and answer of item k: for each length of shingles their hashes, and the parts that have each
        self.sizes = np.zeros(2 * len(self.items), np.int64)
        self.grams = {}
        for m, found in grams.items():
            part = np.repeat([p for p, _ in found], [len(g) for _, g in found])
            self.sizes += np.bincount(part, minlength=len(self.sizes))
            values, code = np.unique(np.concatenate([g for _, g in found]), return_inverse=True)
            sieve = np.zeros(1 << SIEVE_BITS, bool)
            sieve[values >> np.uint64(64 - SIEVE_BITS)] = True
            self.grams[m] = values, np.concatenate([[0], np.cumsum(np.bincount(code))]), part[np.argsort(code, kind="stable")], sieve

    def rare(self, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Postings of each segment's rarest terms, up to RARE of its own score, and what of them a passage must have.

        A passage that reaches the threshold lacks at most the rest of the segment's score, so it has that much of these.
        """
        order = np.lexsort((self.term, often[self.term], self.segment))
        segment, weight = self.segment[order], self.weight[order]
        before = np.cumsum(weight) - weight
        first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        before -= np.repeat(before[first], np.diff(np.append(first, len(segment))))
        full = self.need / RETRIEVE
        taken = before <= RARE * full[segment]
        chosen = np.zeros(len(order), bool)
        chosen[order[taken]] = True
        held = np.bincount(segment[taken], weight[taken], len(full))
        return chosen, held - (1 - RETRIEVE) * full - 1e-6

    def held(self, w: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, place of the item, question overlap, answer overlap) where a text has OVERLAP of the shingles of both."""
        h, ends, keys = w.hashes(), w.ends(), [np.zeros(0, np.int64)]
        text = np.repeat(np.arange(len(w.starts) - 1), np.diff(w.starts))
        for m, (values, runs, parts_of, sieve) in self.grams.items():
            with np.errstate(over="ignore"):
                grams = W.windows(h, m)
            at = np.flatnonzero(sieve[grams >> np.uint64(64 - SIEVE_BITS)])
            at = at[ends[at] - at >= m]
            code = np.minimum(np.searchsorted(values, grams[at]), len(values) - 1)
            same = values[code] == grams[at]
            in_text, code = np.divmod(np.unique(text[at[same]] * len(values) + code[same]), len(values))
            part, offsets = gather(parts_of, runs, code)
            keys.append(np.repeat(in_text, np.diff(offsets)) * len(self.sizes) + part)
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        share = n / self.sizes[key % len(self.sizes)]
        key, share = key[share >= OVERLAP], share[share >= OVERLAP]
        both = np.flatnonzero((key[:-1] % 2 == 0) & (key[1:] == key[:-1] + 1))
        return key[both] // len(self.sizes), key[both] % len(self.sizes) // 2, share[both], share[both + 1]

    def worth(self, term: np.ndarray, owner: np.ndarray, offset: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Passages and segments that they may retrieve. Each word with its text, its place there, and the text's first passage and their number."""
        chosen, need = self.rare(np.bincount(term, minlength=len(self.terms)))
        ends = np.cumsum(np.bincount(self.term[chosen], minlength=len(self.terms)))
        runs = np.concatenate([[0], ends])
        has = np.flatnonzero(runs[term + 1] > runs[term])
        posting, at = gather(np.flatnonzero(chosen), runs, term[has])
        word = np.repeat(has, np.diff(at))
        half = offset[word] // (PASSAGE // 2)
        keys, weights = [], []
        for back in (0, 1):
            ok = (half >= back) & (half - back < n[owner[word]])
            keys.append((first[owner[word[ok]]] + half[ok] - back) * len(need) + self.segment[posting[ok]])
            weights.append(self.weight[posting[ok]])
        key, where = np.unique(np.concatenate(keys), return_inverse=True)
        enough = np.bincount(where, np.concatenate(weights), len(key)) >= need[key % len(need)]
        return np.divmod(key[enough], len(need))

    def retrieve(self, terms: list[int], least: float | None = None) -> list[int]:
        """Segments whose score for the terms reaches their threshold, by block-max WAND; with ``least`` all those of such a threshold or more."""
        at, found = {t: 0 for t in terms}, []
        docs, scores, tops, bound = self.docs, self.scores, self.tops, self.bound
        least = self.least if least is None else least
        while True:
            live = sorted((int(docs[t][at[t]]), t) for t in at if at[t] < len(docs[t]))
            total, pivot = 0.0, None
            for d, t in live:
                total += bound[t]
                if total >= least - 1e-9:
                    pivot = d
                    break
            if pivot is None:
                return found
            upto = [t for d, t in live if d <= pivot]
            # the blocks in which the pivot would stand
            shallow = {t: at[t] + int(np.searchsorted(docs[t][at[t] :], pivot)) for t in upto}
            room = sum(tops[t][shallow[t] // BLOCK] for t in upto if shallow[t] < len(docs[t]))
            if room >= self.need[pivot] - 1e-9:
                score = sum(scores[t][shallow[t]] for t in upto if shallow[t] < len(docs[t]) and docs[t][shallow[t]] == pivot)
                if score >= self.need[pivot] - 1e-9:
                    found.append(pivot)
            for t in upto:
                p = shallow[t]
                at[t] = p + 1 if p < len(docs[t]) and docs[t][p] == pivot else p

    def matches(self, text: pa.Array) -> Iterator[tuple[int, int, float, float]]:
        """(text, item, question overlap, answer overlap) of each contaminated text."""
        low = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(text.cast(pa.string()), "")), _PUNCT, " ")
        w = W.split(low)
        if not len(w) or not len(self.terms):
            return
        texts, places, *overlaps = self.held(w)
        if not len(texts):
            return
        term = pc.fill_null(pc.index_in(w.vocab, self.vocab), -1).to_numpy(zero_copy_only=False)[w.codes]
        size = np.diff(w.starts)
        n = np.maximum(1, -(-(size - PASSAGE) // (PASSAGE // 2)) + 1) * (size > 0)
        first = np.cumsum(n) - n
        owner = np.repeat(np.arange(len(size)), n)
        lo = w.starts[owner] + (np.arange(n.sum()) - first[owner]) * (PASSAGE // 2)
        hi = np.minimum(lo + PASSAGE, w.starts[owner + 1])
        text_of = np.repeat(np.arange(len(size)), size)
        real = np.flatnonzero((term >= 0) & np.isin(text_of, texts))
        passage, segment = self.worth(term[real].astype(np.int64), text_of[real], real - w.starts[text_of[real]], first, n)
        pair = texts * len(self.items) + places
        asked = np.isin(owner[passage] * len(self.items) + self.owner[segment], pair)
        queries = defaultdict(list)
        for p, s in zip(passage[asked].tolist(), segment[asked].tolist()):
            queries[p].append(s)
        got = set()
        for p, wanted in queries.items():
            mine = int(owner[p]) * len(self.items)
            wanted = [s for s in wanted if mine + int(self.owner[s]) not in got]
            if wanted:
                found = self.retrieve(np.unique(term[lo[p] : hi[p]][term[lo[p] : hi[p]] >= 0]).tolist(), self.need[wanted].min())
                got.update((mine + self.owner[found]).tolist())
        for key, text_at, place, q, a in zip(pair.tolist(), texts.tolist(), places.tolist(), *(x.tolist() for x in overlaps)):
            if key in got:
                yield text_at, self.items[place], q, a


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each shard and term the segments that have it; with a null term all segments, and their words."""
    for batch in batches:
        n, words = Counter(), Counter()
        for shard, text in zip(batch.column("shard").to_pylist(), batch.column("text").to_pylist()):
            for s in cut_parts(*parts(text)):
                n.update((shard, t) for t in set(s))
                n[shard, None] += 1
                words[shard, None] += len(s)
        shards, terms = zip(*n) if n else ((), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(shards, pa.int64()), pa.array(terms, pa.string()), pa.array(n.values(), pa.int64()), pa.array([words[k] for k in n], pa.int64())], ["shard", "term", "n", "words"]
        )


def indexes(items: DataFrame) -> Iterator[Index]:
    """Indexes of all items, each of at most about SHARD_CHARS characters (or one longer item).

    Number and mean length of segments and the frequency of terms are those of all items; each index is sent its own terms.
    """
    usable = items.where("item_id is not null and text is not null").select("item_id", "text")
    total = usable.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_CHARS))
    usable = usable.withColumn("shard", F.pmod(F.xxhash64("item_id"), F.lit(shards)))
    counted = usable.select("shard", "text").mapInArrow(_count, "shard long, term string, n long, words long")
    counted = cut(counted.groupBy("term").agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.collect_set("shard").alias("shards")), "terms")
    everything = counted.where("term is null").first()
    for k in range(shards):
        holds = {r.term: r.n for r in counted.where(F.col("term").isNotNull() & F.array_contains("shards", k)).select("term", "n").collect()}
        rows = usable.where(F.col("shard") == k).orderBy("item_id", "text").collect()
        yield Index([(r.item_id, r.text) for r in rows], (everything.n, everything.words, holds) if everything else None)


def _match(shared):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches):
            rows = list(shared.value.matches(part.column("text")))
            if rows:
                text, item, q, a = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(text)), pa.array(item, pa.int64()), pa.array(q), pa.array(a)], ["doc_id", "item_id", "question_overlap", "answer_overlap"])

    return task


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id, question_overlap, answer_overlap)`` of each document that holds a benchmark item.

    Words are runs of a-z, 0-9 and characters beyond ASCII of the text in lower case. A document holds an
    item if a passage of it retrieves a segment of the item's question or answer (at RETRIEVE of the segment's
    own BM25 score or more) and it has OVERLAP of the distinct five-word shingles of both question and answer; a part of fewer
    words must stand there as a whole. Question and answer may stand any way apart.

    Null or empty texts hold nothing, and items without words are in no document. Rows are treated one by
    one: repeated documents or items give repeated pairs, and a document without doc_id gives null. Other
    columns are not read. No document is shuffled; the index is broadcast, in shards of bounded size.
    """
    out = None
    for index in indexes(items):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        found = docs.select("doc_id", "text").mapInArrow(_match(shared), "doc_id long, item_id long, question_overlap double, answer_overlap double")
        out = found if out is None else out.unionByName(found)
    return out


def _clean(shared):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches):
            keep = np.ones(part.num_rows, bool)
            keep[[k for k, *_ in shared.value.matches(part.column("text"))]] = False
            yield part.filter(pa.array(keep))

    return task


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, as ``contaminated`` tells it."""
    for index in indexes(items):
        docs = docs.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(index)), docs.schema)
    return docs
