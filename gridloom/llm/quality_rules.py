"""Quality rules as weak supervision: rules vote or abstain, EM weighs them, a posterior decides.

Each rule looks at counts of a document and says bad, good or nothing. How often a rule says what, given the class, is
not set by hand: expectation-maximisation estimates it, and the share of good documents, from all documents. Only the
counts of vote patterns reach the driver; there are at most three to the power of the number of rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import words as W
from gridloom.session import cut

#: name: (condition for a vote of bad, condition for a vote of good); neither or null abstains.
RULES = {
    "length": ("n_words < 50", "n_words >= 100"),
    "repeated_words": ("n_repeat_words > 0.3 * n_words", "n_repeat_words < 0.1 * n_words"),
    "repeated_lines": ("n_dup_lines > 0.3 * n_lines", "n_lines > 1 and n_dup_lines < 0.1 * n_lines"),
    "symbols": ("n_symbols > 0.1 * n_words", "n_symbols < 0.02 * n_words"),
    "letters": ("n_letters < 0.75 * word_chars", "n_letters > 0.9 * word_chars"),
    "capitals": ("n_upper > 0.5 * n_letters", "n_upper < 0.2 * n_letters"),
    "word_length": ("word_chars < 2 * n_words or word_chars > 15 * n_words", "word_chars between 3 * n_words and 10 * n_words"),
    "sentences": ("n_words >= 50 and (n_ends = 0 or n_ends > 0.5 * n_words)", "n_ends between 0.01 * n_words and 0.3 * n_words"),
    "bare_marks": ("n_bare > 0.2 * n_words", "n_bare < 0.05 * n_words"),
}
MOST_RULES = 11
#: Rounds of EM, and the change of the log-likelihood of a document below which it ends.
ROUNDS, LEAST_GAIN = 200, 1e-9
#: Votes that each rule is taken to have cast beforehand for its class and against it, by votes (bad, none, good).
PRIOR = np.array([[4.0, 4.0, 2.0], [0.2, 2.0, 8.0]])

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_ends", "n_bare")
_WINDOW = 3


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars.encode("latin-1"), np.uint8)] = True
    return out


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_IS_SYMBOL, _IS_UPPER = _table("#*$%&|<>"), _table(_UPPER)
#: A letter is one of A to Z in either case, or a code point beyond ASCII (counted by its first byte).
_IS_LETTER = _table(_UPPER + _UPPER.lower()) | (np.arange(256) >= 0xC0)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of the values between consecutive starts, without a copy of them in a wider type."""
    out = np.zeros(len(starts) - 1, np.int64)
    full = np.flatnonzero(np.diff(starts))
    if len(full):
        out[full] = np.add.reduceat(values[: starts[-1]], starts[full], dtype=np.int64)
    return out


def _triples(codes: np.ndarray, size: int) -> np.ndarray:
    """A number for each three consecutive codes below ``size``; equal only for equal codes."""
    c = codes.astype(np.int64)
    if size < 1 << 21:
        return c[:-2] << 42 | c[1:-1] << 21 | c[2:]
    pairs = np.unique(c[:-1] * size + c[1:], return_inverse=True)[1].astype(np.int64)
    return pairs[:-1] * size + c[2:]


def _repeated(found: W.Words) -> np.ndarray:
    """For each word whether it is in a window of three that its text holds twice or more."""
    mask = np.zeros(len(found), bool)
    if len(found) <= _WINDOW:
        return mask
    at = np.flatnonzero(np.arange(len(found)) + _WINDOW <= found.ends())
    keys = _triples(found.codes, len(found.vocab))[at]
    order = np.argsort(keys, kind="stable")  # places ascend among equal keys, so those of one text are neighbours
    keys, at = keys[order], at[order]
    text = np.searchsorted(found.starts, at, side="right")
    same = (keys[1:] == keys[:-1]) & (text[1:] == text[:-1])
    for k in range(_WINDOW):
        mask[at[1:][same] + k] = True
        mask[at[:-1][same] + k] = True
    return mask


def _lines(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text its lines with a word, and how many of them are equal to an earlier one."""
    lists = pc.split_pattern(text, "\n")
    starts = lists.offsets.to_numpy().astype(np.int64)
    encoded = lists.flatten().dictionary_encode()
    lines, codes = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    worded = pc.match_substring_regex(lines, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)[codes]
    owner = np.repeat(np.arange(len(text)), np.diff(starts))
    total = np.bincount(owner[worded], minlength=len(text))
    distinct = np.unique(owner[worded] * max(1, len(lines)) + codes[worded]) // max(1, len(lines))
    return total, total - np.bincount(distinct, minlength=len(text))


def count_text(text: pa.Array) -> dict[str, np.ndarray]:
    """``COUNTS`` of each text; a null text counts as empty."""
    text = pa.concat_arrays([pc.fill_null(text.cast(pa.string()), "")])
    found = W.split(text)
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    by_byte = lambda table: _sums(table[raw], offsets - offsets[0])
    by_word = lambda values: _sums(values.to_numpy(zero_copy_only=False)[found.codes], found.starts)
    n_lines, n_dup_lines = _lines(text)
    return {
        "n_words": np.diff(found.starts),
        "word_chars": by_word(pc.utf8_length(found.vocab).cast(pa.int64())),
        "n_symbols": by_byte(_IS_SYMBOL),
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": _sums(_repeated(found), found.starts),
        "n_lines": n_lines,
        "n_letters": by_byte(_IS_LETTER),
        "n_upper": by_byte(_IS_UPPER),
        "n_ends": by_word(pc.match_substring_regex(found.vocab, r"[.!?]$")),
        "n_bare": by_word(pc.match_substring_regex(found.vocab, r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+$")),
    }


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in W.slices(batches):
        counts = count_text(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(counts[c], pa.int64()) for c in COUNTS)], ["doc_id", *COUNTS])


def counted(docs: DataFrame) -> DataFrame:
    """doc_id and ``COUNTS`` of every document; ``docs`` is only asked for doc_id and text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_count, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def pattern(rules: dict[str, tuple[str, str]]) -> Column:
    """The votes of a row's rules as a text of 0 (bad), 1 (none) and 2 (good)."""
    if not 0 < len(rules) <= MOST_RULES:
        raise ValueError(f"1 to {MOST_RULES} rules, not {len(rules)}: their vote patterns are collected")
    return F.concat(*(F.when(F.expr(bad), "0").when(F.expr(good), "2").otherwise("1") for bad, good in rules.values()))


class LabelModel:
    """Two classes and independent rules: ``table[k, y, v]`` is the chance that rule k votes v on class y."""

    def __init__(self, table: np.ndarray, good: float):
        self.table, self.good = table, good

    def _joint(self, votes: np.ndarray) -> np.ndarray:
        """Log chance of (class, pattern) for each pattern."""
        rule = np.arange(votes.shape[1])
        return np.log(np.array([1 - self.good, self.good])) + np.log(self.table[rule, :, votes]).sum(1)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Chance that a document with these votes is good."""
        joint = self._joint(votes)
        return 1 / (1 + np.exp(np.clip(joint[:, 0] - joint[:, 1], -700, 700)))

    def accuracies(self) -> np.ndarray:
        """Chance that a rule's vote is right where it votes, for bad and for good documents."""
        return np.stack([self.table[:, 0, 0] / (self.table[:, 0, 0] + self.table[:, 0, 2]), self.table[:, 1, 2] / (self.table[:, 1, 0] + self.table[:, 1, 2])], 1)


def fit(votes: np.ndarray, weight: np.ndarray) -> LabelModel:
    """EM over distinct vote patterns (n, rules) and how many documents show each.

    Starts from the share of bad votes among those cast. A rule may not be worse than chance: its votes of bad come at
    least as often from bad documents as from good ones, which keeps the classes from changing names. No documents:
    the prior.
    """
    said = np.eye(3)[votes]  # pattern, rule, vote
    cast = (votes != 1).sum(1)
    bad = np.where(cast > 0, (votes == 0).sum(1) / np.maximum(cast, 1), 0.0)
    good = np.where(bad > 0, np.clip(0.5 - bad, 0.02, 0.98), 0.98)
    last = -np.inf
    for _ in range(ROUNDS):
        share = np.stack([1 - good, good], 1) * weight[:, None]  # pattern, class
        table = np.einsum("py,pkv->kyv", share, said) + PRIOR
        table /= table.sum(2, keepdims=True)
        worse = table[:, 0, 0] < table[:, 1, 0]
        table[worse] = table[worse].mean(1, keepdims=True)
        model = LabelModel(table, (share[:, 1].sum() + 8) / (weight.sum() + 10))
        joint = model._joint(votes)
        gain = float((np.logaddexp(joint[:, 0], joint[:, 1]) * weight).sum() / max(1.0, weight.sum()))
        good = model.posterior(votes)
        if gain - last < LEAST_GAIN:
            break
        last = gain
    return model


def quality_rules(docs: DataFrame, rules: dict[str, tuple[str, str]] | None = None, base: str = "n_words < 50 or 100 * n_repeat_words > 50 * n_words", least: float = 0.5) -> DataFrame:
    """doc_id, ``COUNTS``, base_failed, quality (posterior chance of good), votes and kept for each row of ``docs``.

    ``docs`` needs doc_id and text; further columns, whatever their names, are not read. kept is false where the
    condition ``base`` holds, else whether quality is at least ``least``. Null and empty texts have no words: all counts
    are 0 and the base fails. Each row stands for itself: repeated rows and null or repeated doc_ids give one row each and
    weigh in the estimate as often as they occur. An empty table gives no rows.
    """
    rules = RULES if rules is None else rules
    rows = cut(counted(docs).withColumn("votes", pattern(rules)), "quality")
    shown = rows.groupBy("votes").agg(F.count("*").alias("rows")).toPandas()
    votes = np.array([[int(v) for v in p] for p in shown["votes"]], np.int64).reshape(-1, len(rules))
    model = fit(votes, shown["rows"].to_numpy(np.float64))
    # a sum over rules of log odds by vote: an expression over the pattern, without a join
    odds = np.log(model.table[:, 1, :]) - np.log(model.table[:, 0, :])
    total = F.lit(float(np.log(model.good) - np.log(1 - model.good)))
    for k, by_vote in enumerate(odds):
        vote = F.substring("votes", k + 1, 1)
        total = total + F.when(vote == "0", float(by_vote[0])).when(vote == "2", float(by_vote[2])).otherwise(float(by_vote[1]))
    out = rows.withColumn("base_failed", F.expr(base)).withColumn("quality", 1 / (1 + F.exp(-total)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))
