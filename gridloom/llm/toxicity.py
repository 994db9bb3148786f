"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy
by tasks of Spark on all labelled rows.

A word's embedding is the sum of those of its hashed features: the word and its beginnings. Filters over
one, two and three words are pooled by their maximum over the whole text; a logistic layer scores them.
Thresholds are calibrated for each language that the text itself suggests, and map to a score of one half.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridloom.llm import words as W
from gridloom.session import cut

#: Labelled rows of a block of the fit, about, and characters after which one ends; all rows and whole texts are in one.
BLOCK_ROWS, BLOCK_CHARS = 4_000, 16_000_000
WIDTHS, FILTERS, DIM, TABLE_BITS = (1, 2, 3), 4, 8, 20
#: Lengths of the beginnings that are features beside the word.
HEADS = (3, 4, 5, 6)
#: A feature counts if so many labelled rows have it.
LEAST_DOCS = 4
#: A batch ends after so many texts or words.
EPOCHS, RATE, BATCH, BATCH_WORDS = 12, 0.05, 250, 2_000_000
#: Characters, words of a vocabulary and rows of the table that a step holds at a time; results do not depend on them.
STEP_CHARS, STEP_WORDS, STEP_ROWS = 1_000_000, 32_768, 65_536
#: Frequent words that mark a language; intervals into which one unit of the logit is cut for the thresholds.
MARKS, STEPS = 60, 1024
#: Bits that tell which doc_ids may have a label: 8 MB.
SIEVE_BITS = 26
ADDED = ("score", "predicted")


def features(vocab: pa.Array) -> np.ndarray:
    """Buckets of each word's features; -1 where a word has no such beginning."""
    word = vocab.to_numpy(zero_copy_only=False)
    size = pc.utf8_length(vocab).to_numpy(zero_copy_only=False)
    out = [pd.util.hash_array(word, categorize=False)]
    out += [pd.util.hash_array(pc.utf8_slice_codeunits(vocab, 0, n).to_numpy(zero_copy_only=False), hash_key=f"{n:016d}", categorize=False) for n in HEADS]
    codes = np.stack([(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64) for h in out], 1)
    for k, n in enumerate(HEADS):
        codes[size <= n, k + 1] = -1
    return codes


_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def _cleaned(text: pa.Array) -> pa.Array:
    """Lower case, ASCII punctuation as blanks."""
    text = pc.fill_null(text.cast(pa.string()), "")
    odd = pc.invert(pc.string_is_ascii(text))
    if pc.any(odd).as_py():
        text = pc.replace_with_mask(text, odd, pc.utf8_lower(text.filter(odd)))
    _, offsets, data = text.buffers()
    if data is None or not len(text):
        return text
    at = np.frombuffer(offsets, np.int32)[text.offset : text.offset + len(text) + 1]
    raw = data.slice(int(at[0]), int(at[-1] - at[0])).to_pybytes().translate(_PLAIN)
    return pa.StringArray.from_buffers(len(text), pa.py_buffer((at - at[0]).tobytes()), pa.py_buffer(raw))


@dataclass
class Model:
    table: np.ndarray
    kernels: dict[int, np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    base: float
    #: Most frequent words by language, and each language's threshold; "" is any other.
    marks: dict[str, set[str]] = field(default_factory=dict)
    cutoff: dict[str, float] = field(default_factory=dict)

    def embed(self, codes: np.ndarray) -> np.ndarray:
        """Embeddings of words by their features; the table's last row is that of a feature that is not there."""
        out = self.table[codes[:, 0]]
        for k in range(1, codes.shape[1]):
            out += self.table[codes[:, k]]
        return out

    def pooled(self, e: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each text, and where; blanks pad every text."""
        n, gap = len(starts) - 1, max(WIDTHS) - 1
        size = np.diff(starts) + gap + 1
        at = np.cumsum(size) - size
        wide = np.zeros((size.sum() + gap, DIM), np.float32)
        wide[np.arange(len(e)) + np.repeat(at - starts[:-1], np.diff(starts))] = e
        best, where = np.zeros((n, len(WIDTHS) * FILTERS), np.float32), np.zeros((n, len(WIDTHS) * FILTERS), np.int64)
        each = np.concatenate([self.kernels[w][j].T for w in WIDTHS for j in range(w)]) @ wide.T
        first, whole = 0, np.repeat(np.arange(n), size)
        for k, w in enumerate(WIDTHS):
            # responses by filter and place, of all words under it
            r = sum(each[first + j * FILTERS : first + (j + 1) * FILTERS, j : j + size.sum()] for j in range(w))
            first += w * FILTERS
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            best[:, cols] = np.maximum.reduceat(r, at, axis=1).T if n else 0
            if self.training:
                for f in range(FILTERS):
                    hit = np.flatnonzero(r[f] == best[whole, k * FILTERS + f])[::-1]
                    where[whole[hit], k * FILTERS + f] = hit  # of several places the first is set last
        return best, where

    training: bool = False

    def logits(self, best: np.ndarray) -> np.ndarray:
        return np.maximum(best + self.bias, 0) @ self.out + self.base

    def language(self, w: W.Words) -> np.ndarray:
        """The language whose frequent words a text has most of; "" without any."""
        names = [*sorted(self.marks), ""]
        n, owner = len(w.starts) - 1, np.repeat(np.arange(len(w.starts) - 1), np.diff(w.starts))
        votes = [np.bincount(owner, pc.is_in(w.vocab, pa.array(sorted(self.marks[x]), pa.string())).to_numpy(zero_copy_only=False)[w.codes], n) for x in names[:-1]]
        votes = np.stack([*votes, np.full(n, 0.5)], 1)
        return np.array(names, object)[votes.argmax(1)]

    def scores(self, text: pa.Array) -> np.ndarray:
        w = W.split(_cleaned(text))
        vectors = self.embed(features(w.vocab)) if len(w.vocab) else np.zeros((0, DIM), np.float32)
        best, _ = self.pooled(vectors[w.codes], w.starts)
        shift = np.array([self.cutoff.get(x, self.cutoff.get("", 0.0)) for x in self.language(w)])
        return 1 / (1 + np.exp(-np.clip(self.logits(best) - shift, -30, 30)))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, text, lang, toxic)``: every row of ``docs`` with a label. Of several labels of one doc_id the larger counts."""
    marked = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    return _sieved(docs.select("doc_id", "text", lang.alias("lang")), marked).join(marked, "doc_id")


def _sieved(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """``docs`` without most rows that have no label, so that their texts are not shuffled; the join after it is exact.

    Bits of hashed doc_ids, in bitmaps of 4 KB. All of them have 2 ** SIEVE_BITS bits, whatever the input.
    """
    if docs.schema["doc_id"].dataType != marked.schema["doc_id"].dataType:
        return docs  # equal ids of two types have two hashes
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << SIEVE_BITS)) + 1
    bits = marked.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    hit = (F.bitmap_bucket_number(place) == F.col("bucket")) & (F.getbit(byte, (at % 8).cast("int")) == 1)
    return docs.join(F.broadcast(bits), hit).select(docs.columns)


@dataclass
class Block:
    """Some labelled texts as words: those of the block, buckets of the features of each, classes and languages."""

    words: W.Words
    codes: np.ndarray
    y: np.ndarray
    lang: np.ndarray

    @classmethod
    def of(cls, text: pa.Array, y: np.ndarray, lang: np.ndarray) -> Block:
        """Words are split some texts at a time; the vocabulary has them in the order in which they come first."""
        parts = [W.split(_cleaned(part.column("text"))) for part in W.slices(iter([pa.RecordBatch.from_arrays([text], ["text"])]), chars=STEP_CHARS)]
        every = pa.concat_arrays([pa.array([], pa.string()), *[w.vocab.cast(pa.string()) for w in parts]]).dictionary_encode()
        place, at, n, codes, starts = every.indices.to_numpy(zero_copy_only=False), 0, 0, [], [np.zeros(1, np.int64)]
        for w in parts:
            codes.append(place[at : at + len(w.vocab)][w.codes])
            starts.append(w.starts[1:] + n)
            at, n = at + len(w.vocab), n + len(w.codes)
        words = W.Words(np.concatenate([np.zeros(0, np.int32), *codes]), np.concatenate(starts), every.dictionary)
        buckets = [features(every.dictionary.slice(k, STEP_WORDS)).astype(np.int32) for k in range(0, len(every.dictionary), STEP_WORDS)]
        return cls(words, np.concatenate([np.zeros((0, 1 + len(HEADS)), np.int32), *buckets]), y, lang)

    def row(self) -> pa.RecordBatch:
        w = self.words
        flat = [w.codes.astype("<u4"), w.starts.astype("<i8"), self.codes.astype("<i4"), self.y.astype("<u1")]
        codes, starts, buckets, y = (pa.array([x.tobytes()], pa.binary()) for x in flat)
        vocab = pa.ListArray.from_arrays(pa.array([0, len(w.vocab)], pa.int32()), w.vocab)
        return pa.RecordBatch.from_arrays([codes, starts, vocab, buckets, y, pa.array([self.lang.tolist()], pa.list_(pa.string()))], schema=_ARROW)

    @classmethod
    def read(cls, batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
        """Blocks as rows hold them; where words or languages were not selected, those of a block are nulls."""
        for batch in batches:
            for k in range(batch.num_rows):
                x = {n: batch.column(n)[k] for n in batch.schema.names}
                flat = {n: np.frombuffer(x[n].as_buffer(), t) for n, t in (("codes", "<u4"), ("starts", "<i8"), ("buckets", "<i4"))}
                buckets, y = flat["buckets"].reshape(-1, 1 + len(HEADS)), np.frombuffer(x["y"].as_buffer(), "<u1").astype(np.float64)
                w = W.Words(flat["codes"], flat["starts"], x["vocab"].values if "vocab" in x else pa.nulls(len(buckets)))
                yield cls(w, buckets, y, np.array(x["lang"].as_py() if "lang" in x else [None] * len(y), object))

    def batches(self) -> Iterator[tuple[int, int, slice, np.ndarray]]:
        """Some texts at a time: the first, the one after the last, their words and where each one's start."""
        starts, lo = self.words.starts, 0
        while lo < len(self.y):
            hi = min(lo + BATCH, len(self.y), max(lo + 1, int(np.searchsorted(starts, starts[lo] + BATCH_WORDS, "right")) - 1))
            yield lo, hi, slice(starts[lo], starts[hi]), starts[lo : hi + 1] - starts[lo]
            lo = hi


_BLOCKS = "codes binary, starts binary, vocab array<string>, buckets binary, y binary, lang array<string>"
_ARROW = pa.schema([("codes", pa.binary()), ("starts", pa.binary()), ("vocab", pa.list_(pa.string())), ("buckets", pa.binary()), ("y", pa.binary()), ("lang", pa.list_(pa.string()))])


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows in order: one ends with its shard, or before the text that is one too many for BLOCK_CHARS.

    Rows that repeat with one doc_id and text stand together and count once.
    """
    held, shard, chars, last = [], None, 0, None

    def flush():
        rows = pa.Table.from_batches(held).combine_chunks()
        text = rows["text"].combine_chunks() if rows["text"].num_chunks != 1 else rows["text"].chunk(0)
        block = Block.of(text, rows["toxic"].to_numpy(), np.array(rows["lang"].to_pylist(), object))
        return block.row()

    for batch in batches:
        keep = []
        for own, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            keep.append(last is None or own != last[0] or text.as_py() != last[1].as_py())
            last = own, text
        if not all(keep):
            batch = batch.filter(pa.array(keep, pa.bool_()))
        size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
        first = 0
        for k, (own, n) in enumerate(zip(batch.column("shard").to_pylist(), size)):
            if shard is not None and (own != shard or chars + n > BLOCK_CHARS):
                if k > first:
                    held.append(batch.slice(first, k - first))
                first = k
                if held:
                    yield flush()
                held, chars = [], 0
            shard, chars = own, chars + n
        if batch.num_rows > first:
            held.append(batch.slice(first))
    if held:
        yield flush()


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts have each bucket, and how many of them label 1; bucket -1 stands for all texts."""
    size = 1 << TABLE_BITS
    ones, all_, total = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(2, np.int64)
    for block in Block.read(batches):
        w, codes, y = block.words, block.codes, block.y
        total += [int(y.sum()), len(y)]
        for lo, hi, part, starts in block.batches():
            owner = np.repeat(np.arange(lo, hi), np.diff(starts))
            pair = np.unique(owner * len(w.vocab) + w.codes[part])
            seen = codes[pair % max(1, len(w.vocab))]
            pair = np.unique(((pair // max(1, len(w.vocab)) << TABLE_BITS)[:, None] + seen)[seen >= 0])
            doc, bucket = pair >> TABLE_BITS, pair & (size - 1)
            np.add.at(ones, bucket[y[doc] > 0], 1)
            np.add.at(all_, bucket, 1)
    hit = np.flatnonzero(all_)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1).astype(np.int32)), pa.array(np.append(ones[hit], total[0])), pa.array(np.append(all_[hit], total[1]))], ["bucket", "ones", "n"])


def _pack(model: Model) -> np.ndarray:
    """All parameters but the table as one run of numbers."""
    return np.concatenate([*[model.kernels[w].ravel() for w in WIDTHS], model.bias, model.out, [model.base]]).astype(np.float64)


def _unpack(model: Model, flat: np.ndarray) -> None:
    at = 0
    for w in WIDTHS:
        model.kernels[w] = flat[at : at + model.kernels[w].size].reshape(model.kernels[w].shape).astype(np.float32)
        at += model.kernels[w].size
    n = len(model.bias)
    model.bias, model.out, model.base = flat[at : at + n].astype(np.float32), flat[at + n : at + 2 * n].astype(np.float32), float(flat[-1])


def _descend(model: Model, block: Block, codes: np.ndarray, rate: float, weight: tuple[float, float]) -> np.ndarray:
    """Steps of descent over the batches of a block, in place; returns the rows of the table that moved.

    codes: rows of the model's table for each word of the block; the last row, that of no feature, stays.
    """
    w, y, none = block.words, block.y, len(model.table) - 1
    moved, seen, place_of = np.zeros(none + 1, bool), np.zeros(len(w.vocab), bool), np.zeros(len(w.vocab), np.int64)
    for lo, hi, part, starts in block.batches():
        word = w.codes[part]
        seen[:] = False
        seen[word] = True
        own = np.flatnonzero(seen)
        place_of[own] = np.arange(len(own))
        word, codes_own = place_of[word], codes[own]
        vectors = model.embed(codes_own)
        best, where = model.pooled(vectors[word], starts)
        act = np.maximum(best + model.bias, 0)
        p = 1 / (1 + np.exp(-np.clip(act @ model.out + model.base, -30, 30)))
        err = ((p - y[lo:hi]) * np.where(y[lo:hi] > 0, *weight))[:, None]
        back = err * model.out * (act > 0)
        model.out -= rate * (err * act).mean(0)
        model.base -= rate * float(err.mean())
        model.bias -= rate * back.mean(0)
        if not len(word):
            continue
        # from each largest response to the words under it
        size = np.diff(starts) + max(WIDTHS)
        at = np.cumsum(size) - size
        for k, width in enumerate(WIDTHS):
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            for j in range(width):
                place = where[:, cols] - at[:, None] + j
                ok = place < np.diff(starts)[:, None]
                token = word[np.minimum(place + starts[:-1][:, None], len(word) - 1)]
                g = back[:, cols] * ok
                model.kernels[width][j] -= rate * np.einsum("nf,nfd->df", g, vectors[token] * ok[:, :, None]).astype(np.float32) / len(starts)
                move = (g[:, :, None] * model.kernels[width][j].T[None]).reshape(-1, DIM) * (rate / len(starts))
                for c in codes_own[token.ravel()].T:
                    has = (c < none) & (g.ravel() != 0)
                    np.subtract.at(model.table, c[has], move[has].astype(np.float32))
                    moved[c[has]] = True
    return np.flatnonzero(moved)


_ROW = [f"d{k}" for k in range(DIM)]


def _epoch(shared):
    """Task function: how far each block alone would move the parameters, by its share of all texts; Spark adds them up.

    Rows of the table come under their bucket, the other parameters in rows of as many numbers under -1, -2 and so on.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of the features in use only, and one more for none
        used, given, flat, rate, total, weight = shared.value
        row_of = np.full((1 << TABLE_BITS) + 1, len(used), np.int32)
        row_of[used] = np.arange(len(used))
        model = _blank(given.copy())
        model.training = True
        for block in Block.read(batches):
            _unpack(model, flat)
            at = _descend(model, block, row_of[block.codes], rate, weight)
            share = len(block.y) / total
            other = share * (_pack(model) - _pack_of(flat))
            other = np.append(other, np.zeros(-len(other) % DIM)).reshape(-1, DIM)
            sent = [(-1 - np.arange(len(other)), other)]
            steps = ((used[own], share * (model.table[own].astype(np.float64) - given[own])) for own in np.split(at, range(STEP_ROWS, len(at), STEP_ROWS)))
            for bucket, values in itertools.chain(sent, steps):
                yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), *[pa.array(values[:, k]) for k in range(DIM)]], ["bucket", *_ROW])
            model.table[at] = given[at]

    return task


def _pack_of(flat: np.ndarray) -> np.ndarray:
    """The numbers as the model holds them: all but the last in single precision."""
    return np.append(flat[:-1].astype(np.float32).astype(np.float64), flat[-1])


def _spoken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each language's texts have each word, block by block."""
    for block in Block.read(batches):
        w = block.words
        owner = np.repeat(np.arange(len(block.y)), np.diff(w.starts))
        for lang in sorted({x for x in block.lang if x is not None}):
            n = np.bincount(w.codes[(block.lang == lang)[owner]], minlength=len(w.vocab))
            hit = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit), pa.string()), w.vocab.take(pa.array(hit)), pa.array(n[hit].astype(np.int64))], ["lang", "word", "n"])


def _margins(shared):
    """Task function: texts and those of label 1 by the language guessed and the interval of 1 / STEPS of the logit."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, out = shared.value, []
        for block in Block.read(batches):
            vectors = model.embed(block.codes)
            z = np.concatenate([model.logits(model.pooled(vectors[block.words.codes[part]], starts)[0]) for _, _, part, starts in block.batches()])
            out.append(pd.DataFrame({"guess": model.language(block.words), "at": np.floor(np.clip(z, -100, 100) * STEPS).astype(np.int64), "ones": block.y.astype(np.int64), "n": 1}))
        if out:
            rows = pd.concat(out).groupby(["guess", "at"], as_index=False).sum()
            yield pa.RecordBatch.from_pandas(rows, preserve_index=False)

    return task


def _move(model: Model, steps: pa.Table) -> None:
    """Adds the sums of an epoch to the parameters, one batch of rows at a time."""
    flat, other = _pack(model), {}
    for batch in steps.to_batches(max_chunksize=STEP_ROWS):
        at = batch.column("bucket").to_numpy()
        values = np.stack([batch.column(x).to_numpy() for x in _ROW], 1)
        other |= dict(zip(at[at < 0].tolist(), values[at < 0]))
        model.table[at[at >= 0]] += values[at >= 0].astype(np.float32)
    _unpack(model, flat + np.concatenate([other[k] for k in sorted(other, reverse=True)])[: len(flat)])


def _blank(table: np.ndarray, seed: int = 7) -> Model:
    """A model before any training, with a table."""
    rng = np.random.default_rng(seed)
    kernels = {w: rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
    for w in WIDTHS:
        kernels[w][:, 0, :] += 1.0 / w
    wide = len(WIDTHS) * FILTERS
    return Model(table, kernels, np.zeros(wide, np.float32), np.full(wide, 1.0 / wide, np.float32), -2.0)


def fit(rows: DataFrame | pd.DataFrame, seed: int = 7) -> Model:
    """Train on all rows (doc_id, text, toxic, lang), whole texts; of equal rows one counts. Without both classes every text scores under one half.

    Rows are dealt by a hash of doc_id into shards of about BLOCK_ROWS and written once as blocks of word codes. Each
    epoch every block descends from the same parameters, and the mean of where they arrive, by their numbers of rows, is
    the next start (iterative parameter mixing; McDonald et al., 2010). The driver gets sums over all rows only: numbers by
    bucket, at most 2 ** TABLE_BITS rows; frequent words by language; and margins by language and interval.
    """
    if isinstance(rows, pd.DataFrame):
        rows = SparkSession.active().createDataFrame(rows[["doc_id", "text", "toxic", "lang"]], "doc_id long, text string, toxic long, lang string")
    model = _blank(np.zeros(((1 << TABLE_BITS) + 1, DIM), np.float32), seed)
    shards = max(1, -(-rows.count() // BLOCK_ROWS))
    dealt = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"), "doc_id", "text", "toxic", "lang")
    # rows of one doc_id in an order of their own
    order = ("shard", "doc_id", F.xxhash64("text"), "lang")
    # Snappy would keep memory beside the heap as large as a block's columns, for each that was read
    blocks = cut(dealt.repartition("shard").sortWithinPartitions(*order).mapInArrow(_code, _BLOCKS), "toxicity", compression="zstd")
    # numbers only, without the words; as many tasks as run at once, as each adds up what it sends before it is shuffled
    few = blocks.select("codes", "starts", "buckets", "y").coalesce(rows.sparkSession.sparkContext.defaultParallelism)
    seen = few.mapInArrow(_seen, "bucket int, ones long, n long").groupBy("bucket").agg(F.sum("ones").alias("ones"), F.sum("n").alias("n"))
    # features too rare to tell stay at nothing
    bucket, ones, n = (x.to_numpy() for x in seen.where((F.col("n") >= LEAST_DOCS) | (F.col("bucket") < 0)).toArrow().columns)
    whole = bucket < 0
    n1, total = int(ones[whole].sum()), int(n[whole].sum())
    n0 = total - n1
    if not n1 or not n0:
        model.out[:] = 0
        return model
    # start from how much likelier a feature makes label 1
    order = np.argsort(bucket)[int(whole.sum()) :]
    used, ones, n = bucket[order].astype(np.int64), ones[order].astype(np.float64), n[order].astype(np.float64)
    model.table[used, 0] = np.log((ones + 0.5) / (n1 + 1)) - np.log((n - ones + 0.5) / (n0 + 1))
    rng = np.random.default_rng(seed + 1)
    for own in np.split(used, range(STEP_ROWS, len(used), STEP_ROWS)):
        model.table[own, 1:] = rng.normal(0, 0.05, (len(own), DIM - 1))
    # the row of no feature is the last of the table
    rows_used = np.append(used, 1 << TABLE_BITS)
    for epoch in range(EPOCHS):
        rate = RATE / (1 + 0.3 * epoch)
        shared = rows.sparkSession.sparkContext.broadcast((used, model.table[rows_used], _pack(model), rate, total, (total / 2 / n1, total / 2 / n0)))
        steps = few.mapInArrow(_epoch(shared), ", ".join(["bucket int", *[f"{x} double" for x in _ROW]])).groupBy("bucket").agg(*[F.sum(x).alias(x) for x in _ROW]).toArrow()
        shared.destroy()
        _move(model, steps)
        del steps
        pa.default_memory_pool().release_unused()
    _calibrate(model, blocks)
    return model


def _threshold(at: np.ndarray, ones: np.ndarray, n: np.ndarray) -> float:
    """The middle of the widest stretch with the fewest errors, of counts by interval of the logit."""
    order = np.argsort(at)
    at, ones, n = at[order], ones[order], n[order]
    wrong = np.concatenate([[0], np.cumsum(ones)]) + np.concatenate([[0], np.cumsum((n - ones)[::-1])])[::-1]
    low, high = np.concatenate([[at[0] - STEPS], at + 1]), np.concatenate([at, [at[-1] + 1 + STEPS]])
    k = max(np.flatnonzero(wrong == wrong.min()), key=lambda i: high[i] - low[i])
    return float((low[k] + high[k]) / 2 / STEPS)


def _calibrate(model: Model, blocks: DataFrame) -> None:
    """Each language's frequent words, and the threshold between its two classes, of all rows; few rows use that of all."""
    spoken = blocks.mapInArrow(_spoken, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    top = spoken.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("place") <= MARKS).select("lang", "word").toPandas()
    marks = {lang: set(own.word) for lang, own in top.groupby("lang")}
    both = set.intersection(*marks.values()) if len(marks) > 1 else set()
    model.marks = {lang: words - both for lang, words in marks.items()}
    shared = blocks.sparkSession.sparkContext.broadcast(model)
    rows = blocks.mapInArrow(_margins(shared), "guess string, at long, ones long, n long").groupBy("guess", "at").agg(F.sum("ones").alias("ones"), F.sum("n").alias("n")).toPandas()
    shared.destroy()
    full = rows.groupby("at", as_index=False)[["ones", "n"]].sum()
    model.cutoff[""] = _threshold(*full[["at", "ones", "n"]].to_numpy(np.int64).T)
    for lang in model.marks:
        own = rows[rows.guess == lang]
        if len(own) and min(own.ones.sum(), (own.n - own.ones).sum()) >= 20:
            model.cutoff[lang] = _threshold(*own[["at", "ones", "n"]].to_numpy(np.int64).T)


def _score(shared):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in W.slices(batches):
            s = model.scores(part.column("text"))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*part.schema.names, *ADDED])

    return task


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1, higher: likelier toxic) and ``predicted`` (1 from one half on).

    Reads only the text, all of it. Null and empty texts score as texts without words. Rows are treated one
    by one; a column named like an added one is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(*ADDED)
    return docs.mapInArrow(_score(shared), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
