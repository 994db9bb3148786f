"""BPE encoding and decoding with a byte-level vocabulary, by a pair occurrence index.

The pieces of many texts stand in one array of symbols. An index maps each pair of neighbours to all its
positions; ranks with positions are applied in ascending order to all of them at once, and only the lists
of pairs that a merge makes or breaks change.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridloom.llm import words as W

# The pattern of pieces that byte-level vocabularies of this kind fix.
PIECE = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A part of a text that starts so after a space starts a piece with that space.
_PLAIN = r"^[!-~À-ɏ]"
#: A part of a text that is one piece, with or without a space before it.
_LETTERS = r"^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
ADDED = ("ids", "decoded")
#: Pieces that a task remembers at most.
KEEP = 400_000
_CHARS = 1_500_000


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def gather(flat: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the runs ``flat[offsets[c]:offsets[c + 1]]`` for c in codes; also where each begins."""
    n = np.diff(offsets)[codes]
    ends = np.cumsum(n)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[codes] - (ends - n), n)
    return flat[at], np.concatenate([[0], ends])


class Bpe:
    """A vocabulary read from the JSON of a byte-level tokenizer file."""

    def __init__(self, source: str):
        spec = json.loads(source)
        vocab = spec["model"]["vocab"]
        symbols = byte_symbols()
        self.start = np.array([vocab[s] for s in symbols], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.wide = 1 + max([*vocab.values(), *self.special.values()])
        key = np.array([vocab[a] * self.wide + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank_of = key[order], order
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        back = {s: b for b, s in enumerate(symbols)}
        texts = [b""] * self.wide
        for token, i in vocab.items():
            texts[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            texts[i] = token.encode()
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.byte_offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, or -1."""
        key = a * self.wide + b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank_of[at], -1)

    def merge(self, sym: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Apply all merges inside the pieces that begin at ``starts`` (with the total at the end)."""
        n = len(sym)
        sym = np.append(sym, -1)
        after = np.arange(1, n + 2)
        before = np.arange(-1, n)
        after[starts[1:] - 1] = n  # n stands for none
        before[starts[:-1]] = n
        alive = np.ones(n, bool)
        rank = np.full(n + 1, -1, np.int64)
        inner = np.flatnonzero(after[:n] < n)
        rank[inner] = self.ranks(sym[inner], sym[after[inner]])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(at: np.ndarray) -> None:
            r = rank[at]
            at, r = at[r >= 0], r[r >= 0]
            if not len(at):
                return
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = [0, *(np.flatnonzero(r[1:] != r[:-1]) + 1).tolist(), len(r)]
            for key, lo, hi in zip(r[cuts[:-1]].tolist(), cuts, cuts[1:]):
                where = at[lo:hi]
                if key in index:
                    index[key].append(where)
                else:
                    index[key] = [where]
                    heapq.heappush(heap, key)

        note(inner)
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[rank[at] == r]
            if not len(at):
                continue
            if len(at) > 1 and sym[at[0]] == sym[after[at[0]]]:  # equal symbols: from the left, without overlap
                free, taken = [], -1
                for p, q in zip(at.tolist(), after[at].tolist()):
                    if p != taken:
                        free.append(p)
                        taken = q
                at = np.array(free)
            gone = after[at]
            then = after[gone]
            sym[at] = self.made[r]
            alive[gone] = False
            rank[gone] = -1
            after[at] = then
            before[then] = at  # the spare place n takes what no piece needs
            before[n] = n
            left = before[at]
            left = left[left < n]
            rank[at] = np.where(then < n, self.ranks(sym[at], sym[then]), -1)
            rank[left] = self.ranks(sym[left], sym[after[left]])
            rank[n] = -1
            note(np.unique(np.concatenate([left, at])))
        total = np.concatenate([[0], np.cumsum(alive)])
        return sym[:n][alive], total[starts]

    def pieces(self, text: str) -> list[str]:
        if self.cut is None or "<" not in text:
            return PIECE.findall(text)
        out = []
        for k, part in enumerate(self.cut.split(text)):
            out += [part] if k % 2 else PIECE.findall(part)
        return out


class Encoder:
    """Encodes texts of one task; remembers the ids of pieces."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.known = bpe, {}  # ids as bytes, four each

    def _learn(self, pieces: list[str]) -> None:
        if len(self.known) > KEEP:
            self.known.clear()
        new = [p for p in dict.fromkeys(pieces) if p not in self.known]
        plain = [p for p in new if p not in self.bpe.special]
        self.known.update({p: np.array([self.bpe.special[p]], "<u4").tobytes() for p in new if p in self.bpe.special})
        raw = [p.encode() for p in plain]
        if raw:
            starts = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
            ids, at = self.bpe.merge(self.bpe.start[np.frombuffer(b"".join(raw), np.uint8)], starts)
            coded, at = ids.astype("<u4").tobytes(), (4 * at).tolist()
            self.known.update((p, coded[a:b]) for p, a, b in zip(plain, at, at[1:]))

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin."""
        text = pc.fill_null(text.cast(pa.string()), "")
        lists = pc.split_pattern(text, " ")
        coded = lists.flatten().dictionary_encode()
        code, vocab = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
        begins, letters = (pc.match_substring_regex(coded.dictionary, p).to_numpy(zero_copy_only=False) for p in (_PLAIN, _LETTERS))
        starts = lists.offsets.to_numpy().astype(np.int64)
        starts -= starts[0]
        spaced = np.ones(len(code), bool)
        spaced[starts[:-1]] = False
        odd = np.concatenate([[0], np.cumsum(spaced & ~begins[code])])[starts]
        odd = np.flatnonzero(np.diff(odd))  # texts with white space beside a space are cut by the pattern as a whole
        key = code * 2 + spaced
        distinct, key = np.unique(key, return_inverse=True)
        words = [" " + vocab[k >> 1] if k & 1 else vocab[k >> 1] for k in distinct.tolist()]
        chunks = [[x] if one else self.bpe.pieces(x) for x, one in zip(words, letters[distinct >> 1].tolist())]
        whole = text.take(pa.array(odd)).to_pylist()
        chunks += [self.bpe.pieces(t) for t in whole]
        self._learn([p for c in chunks for p in c])
        known = self.known
        runs = [known[c[0]] if len(c) == 1 else b"".join([known[p] for p in c]) for c in chunks]
        flat = np.frombuffer(b"".join(runs), "<u4").astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, runs), np.int64, len(runs)))]) // 4
        # an odd text is one chunk in place of its own
        if len(odd):
            owner = np.repeat(np.arange(len(text)), np.diff(starts))
            keep = ~np.isin(owner, odd)
            keep[starts[odd]] = True
            key[starts[odd]] = len(distinct) + np.arange(len(odd))
            key, starts = key[keep], np.concatenate([[0], np.cumsum(keep)])[starts]
        ids, at = gather(flat, offsets, key)
        return ids, at[starts]

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[str]:
        raw, at = gather(self.bpe.bytes, self.bpe.byte_offsets, ids)
        raw, at = raw.tobytes(), at[starts].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])]


#: The encoder that a worker process used last, with the text of its tokenizer; a worker runs many tasks one after another.
_last: list[tuple[str, Encoder]] = []


def _encoder(source: str) -> Encoder:
    if not _last or _last[0][0] != source:
        _last[:] = [(source, Encoder(Bpe(source)))]
    return _last[0][1]


def _run(source):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # what earlier tasks of this worker have freed goes back before this one grows
        pa.default_memory_pool().release_unused()
        for part in W.slices(batches, chars=_CHARS):
            encoder = _encoder(source.value)
            ids, starts = encoder.encode(part.column("text"))
            decoded = encoder.decode(ids, starts)
            raw, at = ids.astype("<u4").tobytes(), (4 * starts).tolist()
            made = [pa.array([raw[a:b] for a, b in zip(at, at[1:])], pa.binary()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, *ADDED])

    return task


def byte_bpe(docs: DataFrame, path: str) -> DataFrame:
    """All columns of ``docs`` with ``ids`` (little-endian unsigned 32-bit integers) and ``decoded``.

    path: a tokenizer file (JSON) with a byte-level BPE model, read on the driver. Strings of its special
    tokens in a text give that token's id, as in the file's library. Null or empty text: no ids, decoded
    empty. Rows are treated one by one, so repeated rows and null keys pass through; a column named like an
    added one is replaced.
    """
    with open(path, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())
    docs = docs.drop(*ADDED)
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    return docs.mapInArrow(_run(source), schema)
