"""Spelling variant grouping: near words by Gram matrices of letter counts, in blocks of adjacent lengths.

Letters that a word has more or less than another add to the squared distance of their letter counts: one replaced
letter makes two, one inserted or deleted letter makes one. So words that differ by one letter are at most two apart,
and NumPy products of blocks of counts find all such pairs; positions are compared only for these.

Blocks are made of words of one length and of equal counts over a few classes of letters. One replaced or inserted
letter changes these class counts in few ways, each of which names the block to meet: no pair is missed, and a block
meets a few others of its own and the next length instead of all of them. Large blocks are cut into tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import words as W
from gridloom.session import cut

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Classes of letters, by code point modulo this number.
CLASSES = 6
#: Characters of the words of a tile; a longer word is a tile of its own.
TILE_CHARS = 8192
#: Columns of the counts: a to z, the letters from C0 to FF, and one for any other.
_COLUMNS = 26 + 64 + 1
_PAIR = "a string, na long, b string, nb long"


def spelled(docs: DataFrame, every: int = 199) -> DataFrame:
    """(word) for each run of letters, lower-cased; where the crc32 of ``<doc_id>:<run>`` is divisible by ``every``, a letter of it is missing."""
    lower = F.translate("text", UPPER, UPPER.lower())
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(lower, F.lit("[a-zÀ-ÿ]+"), 0)).alias("run"))
    crc = F.crc32(F.encode(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")), "UTF-8"))
    hashed = runs.select("run", crc.alias("crc"))
    at = (F.col("crc") % F.char_length("run")).cast("int")
    less = F.concat(F.expr("substring(run, 1, cast(crc % char_length(run) as int))"), F.col("run").substr(at + 2, F.char_length("run")))
    return hashed.select(F.when(F.col("crc") % every == 0, less).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n) of the words of at least so many code points that occur so often."""
    return words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def _letter_counts(codes: np.ndarray) -> np.ndarray:
    """How often each word has each letter."""
    column = np.where((codes >= 97) & (codes <= 122), codes.astype(np.int64) - 97, np.where((codes >= 0xC0) & (codes <= 0xFF), codes.astype(np.int64) - 0xC0 + 26, _COLUMNS - 1))
    flat = column + np.arange(len(codes))[:, None] * _COLUMNS
    return np.bincount(flat.ravel(), minlength=len(codes) * _COLUMNS).reshape(len(codes), _COLUMNS).astype(np.float64)


def _class_counts(words: list[str]) -> np.ndarray:
    out = np.zeros((len(words), CLASSES), np.int64)
    sizes = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    np.add.at(out, (np.repeat(np.arange(len(words)), sizes), codes % CLASSES), 1)
    return out


def _key(counts: np.ndarray) -> np.ndarray:
    """A hash of class counts; that two blocks may share one only adds to what is compared."""
    out = np.full(len(counts), CLASSES, np.uint64)
    for k in range(CLASSES):
        out = W.combine(out, counts[:, k].astype(np.uint64))
    return W.signed(out)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n, length, block) of vocabulary rows."""
    for batch in W.slices(batches, "word"):
        words = batch.column("word").to_pylist()
        counts = _class_counts(words)
        yield pa.RecordBatch.from_arrays(
            [batch.column("word"), batch.column("n"), pa.array(counts.sum(1), pa.int64()), pa.array(_key(counts))], ["word", "n", "length", "block"]
        )


def _moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, length, near, near_length) of blocks: what a replaced or an inserted letter makes of their class counts.

    A letter is replaced only by one of a later class, so that of two blocks of one length one asks for the other.
    """
    step = np.eye(CLASSES, dtype=np.int64)
    moves = [np.zeros(CLASSES, np.int64)]
    moves += [step[q] - step[p] for p in range(CLASSES) for q in range(p + 1, CLASSES)]
    moves += list(step)
    for batch in batches:
        counts = _class_counts(batch.column("example").to_pylist())
        for move in moves:
            rows = np.flatnonzero((counts + move >= 0).all(1))
            at = pa.array(rows)
            length = batch.column("length").take(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column("block").take(at), length, pa.array(_key(counts[rows] + move)), pc.add(length, int(move.sum()))], ["block", "length", "near", "near_length"]
            )


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of code points differ by one replaced letter, or by one that b has besides."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    n = a.shape[1]
    head = np.logical_and.accumulate(a == b[:, :n], 1).sum(1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], 1).sum(1)
    return head + tail >= n


def near_in(one: list[str], two: list[str], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the near pairs of two tiles, each of words of one length; ``same``: both are one tile."""
    a, b = _codes(one), _codes(two)
    ca, cb = _letter_counts(a), _letter_counts(b)
    apart = (ca * ca).sum(1)[:, None] + (cb * cb).sum(1)[None, :] - 2 * (ca @ cb.T)  # whole numbers, exact in doubles
    i, j = np.nonzero(apart <= (2 if a.shape[1] == b.shape[1] else 1))
    if same:
        i, j = i[i < j], j[i < j]
    ok = np.zeros(len(i), bool)
    rows = max(1, 4_000_000 // b.shape[1])
    for lo in range(0, len(i), rows):
        part = slice(lo, lo + rows)
        ok[part] = _one_edit(a[i[part]], b[j[part]])
    return i[ok], j[ok]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            one, two = batch.column("one")[row].values, batch.column("two")[row].values
            words_a, words_b = one.field("word"), two.field("word")
            i, j = (pa.array(x) for x in near_in(words_a.to_pylist(), words_b.to_pylist(), batch.column("same")[row].as_py()))
            yield pa.RecordBatch.from_arrays([words_a.take(i), one.field("n").take(i), words_b.take(j), two.field("n").take(j)], ["a", "na", "b", "nb"])


def near_pairs(vocab: DataFrame) -> DataFrame:
    """(a, na, b, nb), once for each two words of ``vocab`` (word, n; no word twice) that differ by one code point inserted, deleted or replaced."""
    named = vocab.where("word <> ''").select("word", F.col("n").cast("long").alias("n"))
    placed = cut(named.mapInArrow(_blocks, "word string, n long, length long, block long"), "blocks")
    sizes = cut(placed.groupBy("block", "length").agg(F.count("*").alias("rows"), F.min("word").alias("example")), "sizes")
    # the words of a block are dealt to tiles by a hash, to as many as its characters ask for
    counts = sizes.select("block", "length", F.expr(f"(rows * length + {TILE_CHARS - 1}) div {TILE_CHARS} as n_tiles"))
    dealt = placed.join(counts, ["block", "length"]).withColumn("tile", F.expr("pmod(xxhash64(word), n_tiles)"))
    tiles = cut(dealt.groupBy("block", "length", "tile").agg(F.collect_list(F.struct("word", "n")).alias("rows")), "tiles")
    moves = sizes.select("block", "length", "example").mapInArrow(_moves, "block long, length long, near long, near_length long")
    asked = tiles.join(moves, ["block", "length"]).select("near", "near_length", "block", "tile", F.col("rows").alias("one"))
    other = tiles.select(F.col("block").alias("near"), F.col("length").alias("near_length"), F.col("tile").alias("near_tile"), F.col("rows").alias("two"))
    met = asked.join(other, ["near", "near_length"]).where("block <> near or tile <= near_tile")
    return met.select("one", "two", F.expr("block = near and tile = near_tile").alias("same")).mapInArrow(_pairs, _PAIR)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the links (word, form): root is where forms lead, which must not be a circle. Pointers double in each round."""
    links = cut(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        if links.join(on, "root", "left_semi").isEmpty():
            return links
        links = cut(links.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), "roots")


def variants(vocab: DataFrame, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of ``vocab`` (word, n).

    form is the near word of largest n (ties: the least in code-point order) where that n is at least ``times`` that of
    the word, which has to be 2 or more; root is the word itself where there is no form. Words that are null or empty are
    near to nothing. An empty table gives no rows.
    """
    vocab = cut(vocab.select("word", F.col("n").cast("long").alias("n")), "vocabulary")
    pairs = cut(near_pairs(vocab), "near")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("nb").alias("na"), F.col("a").alias("b"), F.col("na").alias("nb")))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("nb")).alias("less"), F.col("b").alias("form"))).alias("best"))
    near = cut(vocab.join(best.select("word", "n_near", F.col("best.form").alias("other"), (-F.col("best.less")).alias("other_n")), "word", "left"), "best")
    taken = F.col("other_n") >= times * F.col("n")
    near = near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("other")).alias("form"), F.when(taken, F.col("other_n")).alias("form_n"))
    led = near.join(roots(near.where("form is not null")), "word", "left")
    return led.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, every: int = 199, least_length: int = 6, least_count: int = 5, times: int = 5) -> DataFrame:
    """``variants`` of the vocabulary of all texts of ``docs`` (doc_id, text; other columns are not read).

    Null and empty texts have no words. A null doc_id counts as empty text in the hash that deletes letters. Rows that
    repeat count as often as they occur, so do all words of one text. An empty table gives no rows.
    """
    if times < 2:
        raise ValueError("forms of equally frequent words could lead in a circle")
    return variants(vocabulary(spelled(docs, every), least_length, least_count), times)
