"""Words, word hashes and word windows of Arrow text columns, vectorised."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of text that one step of a task holds as words at a time.
SLICE_CHARS = 4_000_000

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_UNIT = pa.scalar("")


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``chars`` of text, or one longer text."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // chars
        cuts = np.flatnonzero(np.diff(part)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


@dataclass
class Words:
    """Words of some texts: ``vocab[codes[starts[i]:starts[i + 1]]]`` are those of text i, in order."""

    codes: np.ndarray
    starts: np.ndarray
    vocab: pa.Array

    def __len__(self) -> int:
        return len(self.codes)

    def ends(self) -> np.ndarray:
        """For each word the end of its text, as a word position."""
        return np.repeat(self.starts[1:], np.diff(self.starts))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.vocab):
            return np.zeros(0, np.uint64)
        return pd.util.hash_array(self.vocab.to_numpy(zero_copy_only=False), categorize=False)[self.codes]

    def joined(self, keep: np.ndarray) -> pa.Array:
        """For each text its words under the mask, joined by one space."""
        total = np.concatenate([[0], np.cumsum(keep)])[self.starts]
        lists = pa.ListArray.from_arrays(pa.array(total, pa.int32()), self.vocab.take(pa.array(self.codes[keep])))
        return pc.binary_join(lists, " ")


def split(text: pa.Array) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text; a null text has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(text.cast(pa.string()), _UNIT))
    encoded = lists.flatten().dictionary_encode()
    codes, vocab = encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary
    starts = lists.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    empty = pc.index(vocab, _UNIT.cast(vocab.type)).as_py()
    if empty >= 0:
        full = codes != empty
        starts = np.concatenate([[0], np.cumsum(full)])[starts]
        codes = codes[full]
    return Words(codes, starts, vocab)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values; a bijection."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes in order."""
    return mix(a * _A + b)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive word hashes, by position of the first; across texts too."""
    m = max(0, len(h) - n + 1)
    out = np.full(m, n, np.uint64)
    for k in range(n):
        out = out * _A + h[k : k + m]
    return mix(out)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
