"""Quality rules, spelling variants and lexical search against plain versions, and on odd rows."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from brute import SPACE, lower
from compare import compare, connect
from conftest import SF

from gridloom.llm import lexical_search, quality_rules, spelling_variants
from gridloom.llm.queries import ORACLES, QUERIES
from gridloom.session import small_batches

DOCS = "doc_id long, text string, n_words string, votes int, item_id string, word string, run string"


def sentence(seed, n, letters="abcdefgh"):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9))) for _ in range(n))


TEXTS = [
    None, "", " \t\n", "one", "a b c a b c", "a b c\na b c\n\n \n\na b c", "x y\r\nx y\nx  y", "| # & % $$ <> *", "É été \x1c x y Été", "w " * 300, "x" * 50_000,
    sentence(1, 20_000), "\n".join([sentence(2, 8)] * 9), sentence(3, 120) + " " + sentence(3, 120), "THE !! END !! OF !! ALL !! " * 30,
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "clash", 7, "i", "w", None) for k, t in enumerate(TEXTS)] + [(3, "one", None, None, None, None, None), (None, "a b c d", None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def same(got, want):
    assert collections.Counter(got) == collections.Counter(want)


# quality rules

def rule_counts(text):
    w = SPACE.findall(text or "")
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_rule_counts(spark, table, request):
    docs = request.getfixturevalue(table)
    got = quality_rules.quality_rules(docs)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows = got.collect()
    want = [(d, *rule_counts(t)) for d, t in texts_of(docs)]
    same([(r.doc_id, *(r[n] for n in names)) for r in rows], want)
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.quality >= 0.5)
        assert 0 <= r.quality <= 1


def test_triples_without_packing():
    codes = np.array([0, 1, 2, 0, 1, 2, 1, 0])
    for size in (3, 1 << 22):
        k = quality_rules._triples(codes, size)
        assert [[a == b for b in k] for a in k] == [[tuple(codes[i : i + 3]) == tuple(codes[j : j + 3]) for j in range(6)] for i in range(6)]


def test_em_finds_planted_accuracies():
    rnd = np.random.default_rng(5)
    good = rnd.random(40_000) < 0.8
    right, cast = np.array([[0.95, 0.9], [0.8, 0.97], [0.6, 0.9], [0.9, 0.8], [0.7, 0.95]]), np.array([0.9, 0.7, 0.8, 0.5, 1.0])
    correct = rnd.random((len(good), 5)) < np.where(good[:, None], right[:, 1], right[:, 0])
    votes = np.where(rnd.random((len(good), 5)) < cast, np.where(correct == good[:, None], 2, 0), 1)
    shown, weight = np.unique(votes, axis=0, return_counts=True)
    model = quality_rules.fit(shown, weight.astype(float))
    assert np.abs(model.accuracies() - right).max() < 0.06
    assert abs(model.good - 0.8) < 0.05
    assert ((model.posterior(votes) > 0.5) == good).mean() > 0.93
    majority = (votes == 2).sum(1) > (votes == 0).sum(1)
    assert ((model.posterior(votes) > 0.5) == good).mean() > (majority == good).mean()


def test_quality_agrees_with_labels(spark, documents):
    """No label is used: the planted junk fails and good documents of some length stay."""
    labels = spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.01')}/labels.parquet")
    docs = spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.01')}/documents.parquet")
    rows = quality_rules.quality_rules(docs).join(labels.select("doc_id", "quality").withColumnRenamed("quality", "label"), "doc_id").where("not base_failed").collect()
    bad, good = [r.kept for r in rows if r.label == 0], [r.kept for r in rows if r.label == 1]
    assert sum(bad) <= 0.05 * len(bad) and sum(good) >= 0.97 * len(good)


def test_rules_of_the_caller(spark, odd):
    got = quality_rules.quality_rules(odd, {"long": ("n_words < 3", "n_words > 100")}, base="n_words = 0", least=0.4)
    assert {r.votes for r in got.collect()} == {"0", "1", "2"}
    with pytest.raises(ValueError):
        quality_rules.pattern({})
    assert quality_rules.quality_rules(odd.limit(0)).count() == 0


# spelling variants

def spelled(rows, every=199):
    out = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return out


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(n, times=5):
    near = {w: [x for x in n if x != w and abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in n}
    best = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: b if b is not None and n[b] >= times * n[w] else None for w, b in best.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def rows_of(df):
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]


def test_variants_of_documents(spark, documents):
    rows = texts_of(documents)
    n = {w: c for w, c in spelled(rows).items() if len(w) >= 6 and c >= 5}
    same(rows_of(spelling_variants.spelling_variants(documents)), variants(n))


def test_spelling_of_odd_rows(spark, odd):
    counts = spelled(texts_of(odd), 3)
    got = {r.word: r["count"] for r in spelling_variants.spelled(odd, 3).groupBy("word").count().collect()}
    assert got == dict(counts)
    same(rows_of(spelling_variants.spelling_variants(odd, 3, 1, 1, 2)), variants({w: c for w, c in counts.items() if w}, 2))
    assert spelling_variants.spelling_variants(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling_variants.spelling_variants(odd, times=1)


def test_variants_of_crowded_blocks(spark, monkeypatch):
    """Many words of one length and few letters, in tiles of few words; long words; chains; ties; letters beyond the table."""
    monkeypatch.setattr(spelling_variants, "TILE_CHARS", 64)
    rnd = random.Random(3)
    words = {"".join(rnd.choice("ab") for _ in range(7)) for _ in range(120)} | {"".join(rnd.choice("abgÀéß中😀") for _ in range(rnd.randint(1, 5))) for _ in range(200)}
    words |= {"q" * 30_000, "q" * 29_999 + "r", "q" * 29_999, "chain", "chains", "chainsx", "chainsxy"}
    n = {w: rnd.choice([1, 5, 25, 125]) for w in words} | {"chain": 1, "chains": 10, "chainsx": 100, "chainsxy": 1000}
    vocab = spark.createDataFrame([*n.items(), (None, 9), ("", 9)], "word string, n long")
    want = variants(n) + [(None, None, None, 9, 0, None), ("", None, "", 9, 0, None)]
    got = rows_of(spelling_variants.variants(vocab))
    same(got, want)
    assert ("chain", "chains", "chainsxy", 1, 1, 10) in got


# lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, k):
    rows = [(d, TERM.findall(lower(t))) for d, t in docs]
    rows = [(d, collections.Counter(t), len(t)) for d, t in rows if t]
    n_docs, n_terms = len(rows), sum(n for *_, n in rows)
    df = collections.Counter(t for _, c, _ in rows for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(TERM.findall(lower(text)))
    out = []
    for item, terms in asked.items():
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in terms if t in df}
        scored = []
        for d, c, n in rows:
            m = 100 - 90 + 90 * n * n_docs // n_terms
            s = sum(w[t] * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in w if t in c)
            if s > 0:
                scored.append((d, s))
        scored.sort(key=lambda x: (-x[1], x[0] is None, x[0] or 0))
        out += [(item, r + 1, d, s) for r, (d, s) in enumerate(scored[:k])]
    return out


def found(docs, items, k):
    return [(r.item_id, r["rank"], r.doc_id, r.score) for r in lexical_search.ranked_search(docs, items, k).collect()]


@pytest.mark.parametrize("slice_chars,block", [(4_000_000, 100_000), (3000, 40)])
def test_search_equals_brute_force(spark, documents, monkeypatch, slice_chars, block):
    """Also with many small segments, so that floors carry over and terms wait, and with several blocks of queries."""
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", block)
    monkeypatch.setattr(lexical_search.W.slices, "__defaults__", ("text", slice_chars))
    items = [(i, sentence(900 + i, 12, "abcd")) for i in range(6)] + [(i, t) for i, t in enumerate(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(8).collect())]
    asked = spark.createDataFrame(items, "item_id long, text string")
    same(found(documents, asked, 10), ranked(texts_of(documents), items, 10))


def test_search_of_odd_rows(spark, odd):
    items = [(None, "one w"), (1, None), (2, ""), (3, "A b c"), (3, "été!"), (4, "unknown"), (5, "w"), (6, " ".join(sentence(1, 400).split()))]
    asked = spark.createDataFrame([(i, t, 1, "c") for i, t in items], "item_id long, text string, doc_id int, score string")
    for k in (1, 3, 50):
        same(found(odd, asked, k), ranked(texts_of(odd), items, k))
    assert found(odd.limit(0), asked, 3) == [] and found(odd, asked.limit(0), 3) == []


def test_search_query_equals_sql(spark):
    assert compare(QUERIES["op13_lexical_search"](spark, SF), connect(SF), ORACLES["op13_lexical_search"]) is None


def test_pair_bounds_open_fewer_documents():
    """Two frequent terms that never meet: their joint bound is that of one, so they wait where their sum would not."""
    texts = ["often common" if k % 9 == 8 else "often" if k % 2 else "common" for k in range(400)] + ["rare often", "rare common"]
    docs = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    seg = next(lexical_search._index(iter([docs])))
    block = lexical_search.Block([(1, "often", 500), (1, "common", 500), (1, "rare", 800)])
    num = lambda c: seg.column(c)[0].values.to_numpy(zero_copy_only=False).astype(np.int64)
    terms = seg.column("terms")[0].values.to_pylist()
    code = np.array([block.terms.index(t) for t in terms])
    order = np.argsort(code)
    starts, sizes = num("starts"), num("sizes")
    at = np.concatenate([num("at")[starts[i] : starts[i + 1]] for i in order])
    tf = np.concatenate([num("tf")[starts[i] : starts[i + 1]] for i in order])
    count = np.diff(starts)[order]
    impact = lexical_search.impacts(tf, sizes[at], len(texts), int(sizes.sum())) * np.repeat(block.w[code[order]], count)
    begin = np.concatenate([[0], np.cumsum(count)])
    pair = (block.terms.index("common"), block.terms.index("often"))
    inside = {block.terms[c]: (at[begin[k] : begin[k + 1]], impact[begin[k] : begin[k + 1]]) for k, c in enumerate(code[order])}
    both, i, j = np.intersect1d(inside["common"][0], inside["often"][0], return_indices=True)
    joint = inside["common"][1][i] + inside["often"][1][j]
    segment = lexical_search.Segment(len(texts), code[order], begin, at, impact, np.array([0]), np.array([0, len(both)]), both, joint, np.array([joint.max()]), len(block.terms))
    total = np.zeros(len(texts), np.int64)
    np.add.at(total, at, impact)
    floor = int(np.sort(total)[-2])
    counts = {}
    docs_at, score = lexical_search.best_in(segment, block.codes[0], {pair: 0}, 2, floor, counts)
    assert sorted(zip(docs_at.tolist(), score.tolist())) == sorted((d, s) for d, s in enumerate(total.tolist()) if s >= floor)
    assert counts["opened"] < counts["opened_alone"]


def test_segments_are_packed_and_written_few_at_a_time(spark, documents, monkeypatch, tmp_path):
    """A task holds a few segments of many, whether it writes them, reads them or sends them to Python."""
    monkeypatch.setitem(lexical_search._FILES, "parquet.block.size", "4096")
    rows_sent = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(rows_sent)
    spark.conf.set(rows_sent, 4)  # a segment each
    try:
        index = lexical_search.build_index(documents.coalesce(1), str(tmp_path / "index"))
    finally:
        spark.conf.set(rows_sent, was)
    assert index.schema["postings"].dataType.simpleString() == "binary"
    held = pq.ParquetFile(next((tmp_path / "index").glob("*.parquet"))).metadata
    rows = [held.row_group(g).num_rows for g in range(held.num_row_groups)]
    assert sum(rows) > 20 and max(rows) <= 10
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    with small_batches(spark, "10k"):
        sizes = [r.n for r in index.mapInArrow(lambda batches: (pa.record_batch([[b.num_rows]], ["n"]) for b in batches), "n long").collect()]
    assert sum(sizes) == sum(rows) and max(sizes) <= 10
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
