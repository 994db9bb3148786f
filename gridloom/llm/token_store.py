"""Token ids in a binary store with constant-time access by document key.

A store is a folder of segments. A segment holds the ids of some thousand documents in ascending doc_id
order as one run of 16-bit or 32-bit integers, and a minimal perfect hash index (Limasset et al., 2017)
from document key to place, with a fingerprint of each key. Segments are rows of Parquet files, so that
Spark's writer commits them and any store that Spark reads can hold them.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm import words as W
from gridloom.llm.byte_bpe import gather

#: Ids after which a segment ends.
SEGMENT = 1_000_000
#: Words that a task remembers at most.
KEEP = 400_000
SCHEMA = "part int, seq int, n_docs long, n_tokens long, width int, keys binary, known binary, levels binary, bits binary, prints binary, starts binary, sizes binary, payload binary"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


class Mph:
    """Minimal perfect hash of distinct 64-bit keys: each level keeps the keys that meet no other."""

    def __init__(self, levels: np.ndarray, bits: np.ndarray):
        self.levels, self.bits = levels, bits
        self.ranks = np.concatenate([[0], np.cumsum(bits)])

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (W.mix(keys + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> Mph:
        levels, bits = [], []
        if len(np.unique(keys)) < len(keys):
            raise ValueError("equal keys have no places of their own")
        while len(keys):
            size = 2 * len(keys) + 1
            at = cls._place(keys, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(size)
            bits.append(alone)
            keys = keys[~alone[at]]
        return cls(np.array(levels, np.int64), np.concatenate(bits) if bits else np.zeros(0, bool))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key among all; -1 or any place for a key that is not there."""
        out, base = np.full(len(keys), -1, np.int64), 0
        for level, size in enumerate(self.levels.tolist()):
            at = base + self._place(keys, level, size)
            hit = (out < 0) & self.bits[at]
            out[hit] = self.ranks[at[hit]]
            base += size
        return out


def key_hashes(ids: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Hash of each key: doc_id, whether there is one, and which of the rows with it this is (they stand together)."""
    same = np.concatenate([[False], (ids[1:] == ids[:-1]) & (known[1:] == known[:-1])]) if len(ids) else np.zeros(0, bool)
    run = np.arange(len(ids))
    nth = run - np.maximum.accumulate(np.where(same, 0, run)) if len(ids) else run
    with np.errstate(over="ignore"):
        return W.combine(W.combine(W.mix(ids.view(np.uint64)), known.astype(np.uint64)), nth.astype(np.uint64))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (W.mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype("<u4")


class Segment:
    """A segment read from its row."""

    def __init__(self, row: dict):
        self.row = row
        self.mph = Mph(np.frombuffer(row["levels"], "<i8"), np.unpackbits(np.frombuffer(row["bits"], np.uint8)).astype(bool))
        self.prints, self.starts, self.sizes = (np.frombuffer(row[k], t) for k, t in (("prints", "<u4"), ("starts", "<i8"), ("sizes", "<i8")))
        self.payload = np.frombuffer(row["payload"], "<u2" if row["width"] == 2 else "<u4")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each key hash is there, and its start and size in ids."""
        if not len(self.prints) or not len(keys):
            none = np.zeros(len(keys), np.int64)
            return none.astype(bool), none, none
        at = self.mph.index(keys)
        there = (at >= 0) & (self.prints[at] == fingerprints(keys))
        return there, self.starts[at], self.sizes[at]


def _segment(part: int, seq: int, ids: np.ndarray, known: np.ndarray, tokens: np.ndarray, starts: np.ndarray) -> dict:
    keys = key_hashes(ids, known)
    mph = Mph.build(keys)
    order = np.argsort(mph.index(keys))
    width = 2 if not len(tokens) or tokens.max() < 1 << 16 else 4
    arrays = {
        "keys": ids.astype("<i8"), "known": np.packbits(known), "levels": mph.levels.astype("<i8"), "bits": np.packbits(mph.bits), "prints": fingerprints(keys)[order],
        "starts": starts[:-1][order].astype("<i8"), "sizes": np.diff(starts)[order].astype("<i8"), "payload": tokens.astype(f"<u{width}"),
    }
    return {"part": part, "seq": seq, "n_docs": len(ids), "n_tokens": len(tokens), "width": width} | {k: v.tobytes() for k, v in arrays.items()}


_TAIL = r"^(?P<stem>[^<]*[A-Za-z0-9À-ÖØ-öø-ÿ])(?P<marks>[.,;:!?]+)$"


def _parts(vocab: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words as parts that are encoded alike wherever they stand: distinct parts, their codes word by word, and where each word's begin.

    Case of A-Z is dropped, as the tokenizer drops it, and marks after a letter or digit are parts of their own. Words that
    may hold a special token stay as they are.
    """
    split = pc.extract_regex(vocab, pattern=_TAIL)
    two = pc.is_valid(split)
    stem = pc.if_else(two, pc.struct_field(split, "stem"), vocab)
    plain = pc.and_(pc.string_is_ascii(stem), pc.invert(pc.match_substring(stem, "<")))
    stem = pc.if_else(plain, pc.ascii_lower(stem), stem)
    both = pa.concat_arrays([stem, pc.filter(pc.struct_field(split, "marks"), two)]).dictionary_encode()
    codes, two = both.indices.to_numpy(zero_copy_only=False).astype(np.int64), two.to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(1 + two)])
    out = np.empty(starts[-1], np.int64)
    out[starts[:-1]] = codes[: len(vocab)]
    out[starts[1:][two] - 1] = codes[len(vocab) :]
    return both.dictionary, out, starts


#: A part of lower-case letters that no normal form changes.
_LETTERS = r"^[a-zß-öø-ÿ]+$"
#: Such parts that are encoded as one text.
_JOINED = 64


class Encoder:
    """A tokenizer of a file, and the ids of the parts it has met, at most about ``KEEP`` of them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.known: dict[str, bytes] = {}  # ids, four bytes each
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # runs of letters that neither step of the file changes or cuts go to its model as many at a time, if the last id of each shows
        spec = json.loads(self.tokenizer.to_str())
        suffix, probe = spec["model"].get("end_of_word_suffix"), "".join(map(chr, [*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100)]))
        step, pre = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        whole = spec["model"]["type"] == "BPE" and suffix and (step is None or step.normalize_str(probe) == probe) and pre is not None and len(pre.pre_tokenize_str(probe)) == 1
        plain = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = None
        if whole and pre.pre_tokenize_str(probe)[0][0] == plain.pre_tokenize_str(probe)[0][0]:
            self.letters = Tokenizer.from_str(json.dumps(spec | {"added_tokens": []}))
            self.letters.normalizer = normalizers.Sequence([])
            self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), plain])
            self.last = np.zeros(1 + max(spec["model"]["vocab"].values()), bool)
            self.last[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True

    def learn(self, parts: list[str], letters: np.ndarray) -> None:
        """Encode the parts that are not known; letters: which are runs of lower-case letters."""
        known = self.known
        if len(known) > KEEP:
            known.clear()
        new = [x for x, one in zip(parts, letters.tolist()) if not one and x not in known]
        runs = [x for x, one in zip(parts, letters.tolist()) if one and x not in known]
        if runs and not self._joined(runs):
            new += runs
        known.update((x, array("I", e.ids).tobytes()) for x, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)))

    def _joined(self, runs: list[str]) -> bool:
        """Learn runs of letters from texts of many; False if their ids cannot be told apart."""
        if self.letters is None:
            return False
        texts = [" ".join(runs[k : k + _JOINED]) for k in range(0, len(runs), _JOINED)]
        ids = list(chain.from_iterable(e.ids for e in self.letters.encode_batch_fast(texts, add_special_tokens=False)))
        ids = np.array(ids, np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(runs) or ends[-1] != len(ids):
            return False
        coded, ends = ids.tobytes(), (4 * ends).tolist()
        self.known.update((x, coded[a:b]) for x, a, b in zip(runs, [0, *ends], ends))
        return True


#: The encoder that a worker process used last, by path; a worker runs many tasks one after another.
_last: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _last:
        _last.clear()
        _last[path] = Encoder(path)
    return _last[path]


def _write(path: str, end: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def flush():
            nonlocal seq, held
            ids, has, tokens, sizes = (np.concatenate(x) for x in zip(*held))
            row = _segment(part, seq, ids, has, tokens, np.concatenate([[0], np.cumsum(sizes)]))
            seq, held = seq + 1, []
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for piece in W.slices(batches, chars=SEGMENT * 4):
            w = W.split(piece.column("text"))
            parts, part_codes, part_starts = _parts(w.vocab)
            letters = pc.match_substring_regex(parts, _LETTERS).to_numpy(zero_copy_only=False)
            parts = parts.to_pylist()
            encoder.learn(parts, letters)
            runs = [*map(encoder.known.__getitem__, parts)]
            offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, runs), np.int64, len(runs)))]) // 4
            flat = np.frombuffer(b"".join(runs), np.uint32)
            # ids of each word, and of the end as one more
            flat, at = gather(flat, offsets, part_codes)
            flat, offsets = np.append(flat, np.uint32(end)), np.append(at[part_starts], len(flat) + 1)
            # after each text's words one more, the end
            codes = np.insert(w.codes.astype(np.int64), w.starts[1:], len(w.vocab))
            tokens, at = gather(flat, offsets, codes)
            starts = at[w.starts + np.arange(len(w.starts))]
            doc = piece.column("doc_id")
            held.append((pc.fill_null(doc, 0).to_numpy(zero_copy_only=False).astype(np.int64), pc.is_valid(doc).to_numpy(zero_copy_only=False), tokens, np.diff(starts)))
            if sum(len(x[2]) for x in held) >= SEGMENT:
                yield flush()
        if held:
            yield flush()

    return task


_KIND = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
_ARROW = pa.schema([(n, _KIND[k]) for n, k in (x.split() for x in SCHEMA.split(", "))])


def write_store(docs: DataFrame, store: str, tokenizer: str, end: int) -> None:
    """Write the ids of all texts, each followed by ``end``, in ascending doc_id order to the folder ``store``.

    tokenizer: a file of the tokenizers library that drops white space and the case of letters and whose pieces
    never cross white space or join letters with marks, so that a text's ids are those of its words one after
    another; each distinct word is encoded once in a while.
    Rows without doc_id come first. Null text: only the end id. Rows that share a doc_id follow one another
    in order of their texts, and their keys count them. Other columns are not read. The folder must be new.
    """
    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    dealt.mapInArrow(_write(tokenizer, end), SCHEMA).write.option("compression", "zstd").parquet(store)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            seg = Segment(row)
            ids, known = np.frombuffer(row["keys"], "<i8"), np.unpackbits(np.frombuffer(row["known"], np.uint8))[: row["n_docs"]].astype(bool)
            there, start, size = seg.find(key_hashes(ids, known))
            if not there.all():
                raise ValueError(f"segment {row['part']}/{row['seq']} has keys without a place")
            wide = seg.payload.astype("<u4")
            crc = [zlib.crc32(wide[a : a + n]) for a, n in zip(start.tolist(), size.tolist())]
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=~known), pa.array(np.full(n, row["part"], np.int32)), pa.array(np.full(n, row["seq"], np.int32)), pa.array(start), pa.array(size), pa.array(crc, pa.int64())],
                ["doc_id", "part", "seq", "at", "n_tokens", "ids_crc32"],
            )


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)``: each key of the store looked up in its index, its ids read from the payload.

    start counts the ids of all documents before it. An empty store has no rows.
    """
    segments = spark.read.schema(SCHEMA).parquet(store)
    sizes = segments.select("part", "seq", "n_tokens")
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row per written partition meets in one task; the segments of a partition are counted beside one another
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", before(Window.orderBy("part")).alias("base"))
    inner = sizes.select("part", "seq", before(Window.partitionBy("part").orderBy("seq")).alias("inner"))
    base = inner.join(parts, "part").select("part", "seq", (F.col("base") + F.col("inner")).alias("base"))
    found = segments.mapInArrow(_read, "doc_id long, part int, seq int, at long, n_tokens long, ids_crc32 long")
    return found.join(base, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
