"""Operators against plain versions, on the smallest tables and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import brute
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from compare import compare, connect
from conftest import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import byte_bpe, chat_format, decontaminate, jaccard_join, language_id, license_scan, substring_dedup, token_store, topk_search, toxicity
from gridloom.llm.components import components
from gridloom.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, n_words int, score string, ids string, spans string, covers string"


def sentence(seed, n):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls in any column, blanks, copies, near copies, a very long text, and columns named like added ones."""
    long = sentence(1, 30_000)
    base = sentence(2, 120).split(" ")
    near = list(base)
    near[60] = "other"
    texts = [None, "", " \t\n", "one", "a b c d", "a b c d e", "A B C D E", " ".join(base), " ".join(near), " ".join(base), long, "x" * 50_000, "w " * 300, long[:5000] + " tail", "été  là \x1c ok", " ".join(base[:70])]
    rows = [(k, t, None if k % 3 else "en", None if k % 2 else 1, "s", None, "p", "c") for k, t in enumerate(texts)]
    return rows + [(None, "a b c d e", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def by_id(df):
    return {r[0]: tuple(r[1:]) for r in df.where("doc_id is not null").collect()}


@pytest.mark.parametrize("name", [n for n in ORACLES])
def test_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) is None


# 1


def digest(done):
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256))


def test_substring_dedup(spark, documents, odd, odd_rows, empty):
    assert by_id(QUERIES["op1_substring_dedup"](spark, SF)) == brute.kept_words(pairs(documents))
    done = substring_dedup.substring_dedup(odd)
    assert by_id(digest(done)) == brute.kept_words([r[:2] for r in odd_rows if r[0] is not None])
    assert done.count() == len(odd_rows) and dict(done.dtypes)["n_words"] == "bigint"
    assert sorted(r.kept_text for r in done.where("doc_id is null").collect()) == ["", "a b c d e"]
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_substring_dedup_short_cycles(spark):
    """Windows that repeat inside one document, at many offsets, and edges of shared passages."""
    rnd = random.Random(5)
    shared = sentence(9, 40).split(" ")
    rows = []
    for k in range(60):
        cut = rnd.randint(0, 20)
        rows.append((k, " ".join([rnd.choice("xyz") for _ in range(rnd.randint(0, 60))] + shared[cut : cut + rnd.randint(15, 40)] + ["p", "q"] * rnd.randint(0, 15))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(digest(substring_dedup.substring_dedup(df))) == brute.kept_words(rows)


def test_substring_dedup_rows_of_one_id(spark):
    text = sentence(3, 40)
    rows = spark.createDataFrame([(1, text), (1, text), (2, text), (2, "short")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(rows).collect())
    assert got == [(1, 40, 0), (1, 40, 0), (2, 1, 1), (2, 40, 40)]


# 2


def test_license_scan(spark, documents, odd, odd_rows, empty):
    got = by_id(QUERIES["op2_license_scan"](spark, SF))
    for doc_id, text in pairs(documents):
        assert got[doc_id][:5] == brute.license_base(text)
        assert set(filter(None, got[doc_id][4].split(","))) <= set(filter(None, got[doc_id][5].split(","))) and 0 <= got[doc_id][6] <= 1
    texts = ["CC-BY cc BY, Cc by", "GNU General (Public) License. All rights\nreserved", "cc bKy Kcc by", "all rights all rights reserved", "cc", None, "released under the new mit license", "general public"]
    rows = list(enumerate(texts))
    done = license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string"))
    got = by_id(done)
    assert all(got[k][:5] == brute.license_base(t) for k, t in rows)
    assert got[6][5] == "mit" and got[7][5] == "" and 0 < got[7][6] < 1 and got[5][6] == 0
    assert license_scan.license_scan(odd).count() == len(odd_rows) and license_scan.license_scan(empty).count() == 0
    assert "Python" not in done._jdf.queryExecution().toString() and "MapIn" not in done._jdf.queryExecution().toString()


def test_license_spans_are_verified(spark):
    """Votes that repeat a part of a template, or stand in another order, give no label; a changed template does."""
    mit = " ".join(f"word{k % 40} and{k}" for k in range(120))
    changed = mit.split()
    del changed[50]
    changed[100:100] = ["put", "in"]
    texts = ["the public the public domain", "mit license the mit license mit license", "released into the the public domain", "x " + mit, " ".join(changed), " ".join(mit.split()[120:] + mit.split()[:120]), "tiny", None]
    docs = spark.createDataFrame([(k, t, "z") for k, t in enumerate(texts)], "doc_id long, text string, label string").repartition(3)
    own = spark.createDataFrame([("long", mit, False), ("long", mit, None), ("tiny", "tiny", True), (None, "the public", True), ("none", None, False)], "label string, text string, base boolean")
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.license_scan(docs).collect()}
    assert got[0] == ("", 0.5) and got[1] == ("", 0.5) and got[2] == ("public-domain", 1.0) and got[7] == ("", 0.0)
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.license_scan(docs, own).collect()}
    assert got[3] == ("long", 1.0) and got[4][0] == "long" and 0.97 < got[4][1] < 1 and got[5][0] == "" and 0.45 < got[5][1] < 0.55
    assert [got[k] for k in (0, 6, 7)] == [("", 0.0)] * 3
    none = license_scan.license_scan(docs, own.limit(0))
    assert none.count() == len(texts) and none.agg(F.max("score")).first()[0] == 0


# 3


def test_language_id(spark, documents, odd, odd_rows, empty):
    got = QUERIES["op3_language_id"](spark, SF).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    model = language_id.fit(documents)
    done = language_id.language_id(odd, model)
    got = {r.doc_id: r.lang_pred for r in done.where("doc_id is not null").collect()}
    assert got[0] == got[1] == got[2] == "und" and got[3] != "und" and done.count() == len(odd_rows)
    assert language_id.language_id(empty, model).count() == 0
    nothing = language_id.fit(empty)
    assert {r.lang_pred for r in language_id.language_id(odd, nothing).collect()} == {"und"}


def test_cross_parsing_counts_phrases(spark, monkeypatch):
    """Running text with matches across blanks, non-letters alike in fit and prediction, letters without a code, stretches."""
    monkeypatch.setattr(language_id, "STRETCH", 40)
    rows = [(1, "banana band, ante", "x"), (2, "l'homme été bande", "x"), (3, "ante ante tez", "y"), (4, None, "y"), (None, "zzz", "y"), (5, "q" * 3000, "y"), (6, "long " * 500, "z"), (2, "zz", "y")]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    clean = lambda t: " " + "".join(c if c.isalpha() else " " for c in t.lower()).strip() + " "
    squeeze = lambda t: re.sub(" +", " ", clean(t))
    source = {"x": squeeze("banana band, ante l'homme été bande"), "y": squeeze("zz ante ante tez"), "z": squeeze("long " * 500)}

    def plain(text, lang):
        n = 0
        for lo in range(0, len(text), 40):
            part, at = text[lo : lo + 40], 0
            while at < len(part):
                m = 1
                while at + m < len(part) and part[at : at + m + 1] in source[lang]:
                    m += 1
                at, n = at + m, n + 1
        return n

    assert model.langs == ["x", "y", "z"]
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("bandtezlhomé '-1") for _ in range(rnd.randint(1, 150))) for _ in range(200)] + ["L'HOMME", "band ante band ante"]
    codes, starts = model.encode(pa.array(texts), model.lookup())
    want = [[plain(squeeze(t), lang) if squeeze(t).strip() else 1 for lang in model.langs] for t in texts]
    got = model.phrases(codes, starts).astype(int).tolist()
    assert [g for g, t in zip(got, texts) if squeeze(t).strip()] == [w for w, t in zip(want, texts) if squeeze(t).strip()]
    # equal counts: the phrase is more frequent in y than in x
    tie = spark.createDataFrame([(1, "ante"), (2, "1-"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language_id.language_id(tie, model).collect()} == {1: "y", 2: "und", 3: "und"}


def test_language_of_few_words(spark, documents):
    """Excerpts of held-out texts, from one word up."""
    model = language_id.fit(documents.where("crc32(cast(doc_id as string)) % 3 <> 1"))
    held = documents.where("crc32(cast(doc_id as string)) % 3 = 1 and lang is not null and char_length(text) > 200").collect()
    for n, least in ((1, 0.5), (3, 0.85), (10, 0.95)):
        cut = [(k, " ".join(r.text.split()[5 : 5 + n]), r.lang) for k, r in enumerate(held)]
        done = language_id.language_id(spark.createDataFrame(cut, "doc_id long, text string, lang string"), model).collect()
        share = sum(r.lang == r.lang_pred for r in done) / len(done)
        print(n, share)
        assert share > least


# 4


def test_chats_read_back(spark, empty):
    texts = ["<|", "<||", "a<|end|>\n<|turn|>user<|text|>", "<", "|", "", None, "é<|next|>", "plain", "<|end|>\n"]
    rnd = random.Random(2)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "<|x", None]), rnd.choice(texts), 1) for c in range(40) for t in range(rnd.randint(1, 12))]
    rows += [(None, None, "user", "no id", 1), (50, 0, "assistant", "tie", 1), (50, 0, "assistant", "tie", 1)]
    chats = chat_format.read_chats(chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, formatted int")))
    want = defaultdict(list)
    for c, t, role, text, _ in rows:
        want[c].append((t, role or "", text or ""))
    got = {r.conv_id: r for r in chats.collect()}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        turns = [x[1:] for x in sorted(turns, key=lambda x: (x[0] is not None, x))]
        assert [tuple(t) for t in got[c].turns] == turns and got[c].trained == "".join(t for r, t in turns if r == "assistant")
    assert chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


# 5 and 8


def ids_of(name, texts):
    return [e.ids for e in Tokenizer.from_file(public_tokenizers.path(name)).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_store(spark, documents, odd, odd_rows, empty, tmp_path):
    rows = sorted(pairs(documents))
    got, start = by_id(QUERIES["op5_token_store"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32")), 0
    for (doc_id, _), ids in zip(rows, ids_of("word_bpe_49k.json", [t for _, t in rows])):
        assert got[doc_id] == (start, len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes()))
        start += len(ids) + 1
    for k, df in enumerate((odd, empty)):
        token_store.write_store(df, str(tmp_path / str(k)), public_tokenizers.path("word_bpe_49k.json"), 2)
    order = sorted((r[:2] for r in odd_rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    sizes = [len(x) + 1 for x in ids_of("word_bpe_49k.json", [t for _, t in order])]
    want = [(d, sum(sizes[:k]), n) for k, ((d, _), n) in enumerate(zip(order, sizes))]
    assert [tuple(r) for r in token_store.read_store(spark, str(tmp_path / "0")).select("doc_id", "start", "n_tokens").orderBy("start").collect()] == want
    assert token_store.read_store(spark, str(tmp_path / "1")).count() == 0


def test_token_store_letters_together():
    """op5: runs of letters are encoded many at a time, with the ids that each has alone; odd parts go one by one."""
    parts = ["a", "the", "été", "straße", "ÿ", "x" * 300, "don't", "İx", "a.b", "<|endoftext|>", "ﬁn", "7", "qzxv"]
    encoder = token_store.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    letters = pa.compute.match_substring_regex(pa.array(parts), token_store._LETTERS).to_numpy(zero_copy_only=False)
    assert letters.tolist() == [True] * 6 + [False] * 6 + [True] and encoder._joined([p for p, one in zip(parts, letters) if one])
    encoder.known.clear()
    encoder.learn(parts, letters)
    assert [np.frombuffer(encoder.known[p], np.uint32).tolist() for p in parts] == ids_of("word_bpe_49k.json", parts)


def test_minimal_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 20_000, dtype=np.uint64))
    mph = token_store.Mph.build(keys)
    assert np.array_equal(np.sort(mph.index(keys)), np.arange(len(keys)))
    assert len(token_store.Mph.build(keys[:0]).index(keys[:5])) == 5
    with pytest.raises(ValueError):
        token_store.Mph.build(keys[[0, 1, 0]])


def test_token_store_keys_around_null(spark, tmp_path):
    ids, known = np.array([0, -1, 0, 0]), np.array([False, True, True, True])
    assert len(np.unique(token_store.key_hashes(ids, known))) == len(ids)
    docs = spark.createDataFrame([(None, "a"), (-1, "a b"), (0, "a b c"), (None, "b")], "doc_id long, text string").coalesce(1)
    token_store.write_store(docs, str(tmp_path / "store"), public_tokenizers.path("word_bpe_49k.json"), 2)
    got = token_store.read_store(spark, str(tmp_path / "store")).orderBy("start")
    assert [(r.doc_id, r.n_tokens) for r in got.collect()] == [(None, 2), (None, 2), (-1, 3), (0, 4)]


def test_byte_bpe(spark, documents, odd, odd_rows, empty):
    got = by_id(QUERIES["op8_byte_bpe"](spark, SF))
    rows = pairs(documents)
    for (doc_id, text), ids in zip(rows, ids_of("byte_bpe_50k.json", [t for _, t in rows])):
        sha = lambda b: hashlib.sha256(b).hexdigest()
        assert got[doc_id] == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha((text or "").encode()))
    path = public_tokenizers.path("byte_bpe_50k.json")
    done = byte_bpe.byte_bpe(odd, path)
    assert done.count() == len(odd_rows) and {(r.doc_id, r.text or "") for r in done.collect()} == {(r.doc_id, r.decoded) for r in done.collect()}
    assert byte_bpe.byte_bpe(empty, path).count() == 0


def test_byte_bpe_pieces():
    rnd = random.Random(1)
    parts = [" ", "  ", "\n", " \n", "\t", "a", "the", "É", "1", "2", "!", "'s", "'ll", "<|endoftext|>", " ", "　", "日本", "é", "\x00", "🙂", "aaaaa", "==", "<", "|>"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(2000)]
    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        encoder = byte_bpe.Encoder(byte_bpe.Bpe(f.read()))
    ids, at = encoder.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == ids_of("byte_bpe_50k.json", texts)
    assert encoder.decode(ids, at) == texts


def test_byte_bpe_remembers_pieces(monkeypatch):
    """op8: words of letters are pieces without a look at the pattern, and texts of many slices do not forget them at once."""
    assert byte_bpe.KEEP >= 400_000
    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        encoder = byte_bpe.Encoder(byte_bpe.Bpe(f.read()))
    cut, real = [], encoder.bpe.pieces
    monkeypatch.setattr(encoder.bpe, "pieces", lambda t: cut.append(t) or real(t))
    texts = ["plain Words été Ωmega x2", " lead", "it's a-b", "", "naïve\u0301 end", "a  b"]
    ids, at = encoder.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == ids_of("byte_bpe_50k.json", texts)
    assert " Words" not in cut and " été" not in cut and " x2" in cut and " naïve" not in cut


# 6


def test_toxicity(spark, documents, odd, odd_rows, empty):
    rnd = random.Random(3)
    rows = []
    for k in range(600):
        words = sentence(k + 100, 60).split(" ")
        if k % 4 == 0:
            for _ in range(3):
                words[rnd.randrange(60)] = rnd.choice(["vileword", "foulish", "nastyone"])
        rows.append((k, " ".join(words), int(k % 4 == 0), "en" if k % 2 else "fr"))
    table = pd.DataFrame(rows, columns=["doc_id", "text", "toxic", "lang"])
    model = toxicity.fit(table[:400])
    s = model.scores(pa.array(table.text[400:]))
    assert ((s >= 0.5).astype(int) == table.toxic[400:]).mean() > 0.95
    done = toxicity.toxicity(odd, model)
    assert done.count() == len(odd_rows) and done.where("score is null or score < 0 or score > 1").count() == 0
    assert done.where("doc_id < 3 and predicted = 1").count() == 0 and toxicity.toxicity(empty, model).count() == 0
    blank = toxicity.fit(table[:0])
    assert (blank.scores(pa.array(["a b", None])) < 0.5).all()
    full = QUERIES["op6_toxicity"](spark, SF)
    assert full.count() == documents.count() and full.where("(score >= 0.5) <> (predicted = 1)").count() == 0


def test_toxicity_learns_from_all_rows(spark, monkeypatch):
    """of each class 1,500 rows and no text beyond 50,000 characters had a say; every labelled row counts, in blocks."""
    monkeypatch.setattr(toxicity, "BLOCK_ROWS", 300)
    word = lambda k: sentence(k, 20)
    rows = [(k, f"{word(k)} rareword {word(k + 1)}" if k % 2 and k >= 4_000 else f"{word(k)} vileword" if k % 2 else word(k)) for k in range(4_400)]
    long = [(k, "calm " * 12_000 + "hiddenword") for k in range(5_000, 5_040)]
    docs = spark.createDataFrame(rows + long, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(k, 1 if k >= 5_000 else k % 2) for k, _ in rows + long], "doc_id long, toxic int")
    taught = toxicity.labelled(docs, labels)
    assert taught.count() == 4_440
    model = toxicity.fit(taught)
    of = lambda t: model.table[toxicity.features(pa.array([t]))[0, 0], 0]
    # each of these is in label 1 only: its log-odds follow from numbers of all rows
    n1, n0 = 2_240, 2_200
    start = lambda n: np.log((n + 0.5) / (n1 + 1)) - np.log(0.5 / (n0 + 1))
    assert abs(of("rareword") - start(200)) < 1 and abs(of("hiddenword") - start(40)) < 1 and abs(of("vileword") - start(2_000)) < 1
    s = model.scores(pa.array(["some rareword here", "a hiddenword", "quite vileword", word(9_000), None]))
    assert (s >= 0.5).tolist() == [True, True, True, False, False]
    again = toxicity.fit(taught.repartition(2)).scores(pa.array([t for _, t in rows[:200]]))
    assert np.allclose(again, model.scores(pa.array([t for _, t in rows[:200]])), atol=1e-3)


def test_toxicity_of_repeated_rows(spark, monkeypatch):
    """Rows that come twice count once; another text of the same doc_id counts too."""
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    rows = [(k, sentence(k, 20) + (" vileword" if k % 2 else ""), k % 2, "en") for k in range(60)] + [(1, "second vileword", 1, "en")]
    fits = [toxicity.fit(spark.createDataFrame(x, "doc_id long, text string, toxic int, lang string").repartition(3)) for x in (rows, rows + rows)]
    assert np.allclose(fits[0].table, fits[1].table) and fits[0].cutoff == fits[1].cutoff
    n = toxicity.features(pa.array(["second"]))[0, 0], toxicity.features(pa.array(["vileword"]))[0, 0]
    assert fits[0].table[n[0], 0] == 0 and abs(fits[0].table[n[1], 0] - (np.log(31.5 / 32) - np.log(0.5 / 31))) < 0.1


def test_toxicity_fit_in_steps(spark, monkeypatch):
    """Blocks are split, hashed, sent and added some at a time, and the model is that of one step."""
    texts = [None, "", "One word, two WORDS", " \t", "été two one", *(f"{sentence(k, 30)} {'vile' if k % 3 == 0 else 'kind'}" for k in range(60))]
    rows = [(k, t, int(k % 3 == 0), "de" if k % 2 else None) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int, lang string").coalesce(1)
    none = np.array([None] * len(texts), object)
    block = lambda: toxicity.Block.of(pa.array(texts, pa.string()), np.zeros(len(texts)), none).row()
    whole, at_once = toxicity.fit(docs), block()
    for name, n in (("STEP_CHARS", 100), ("STEP_WORDS", 7), ("STEP_ROWS", 5)):
        monkeypatch.setattr(toxicity, name, n)
    assert block().equals(at_once)
    again = toxicity.fit(docs)
    assert np.array_equal(again.table != 0, whole.table != 0) and np.allclose(again.table, whole.table, atol=1e-6)
    assert np.allclose(toxicity._pack(again), toxicity._pack(whole), atol=1e-6) and again.cutoff.keys() == whole.cutoff.keys()
    # a task sends no more rows at a time than a step
    size = (1 << toxicity.TABLE_BITS) + 1
    shared = type("Shared", (), {"value": (np.arange(size - 1), np.ones((size, toxicity.DIM), np.float32), toxicity._pack(whole), 0.05, len(texts), (1.0, 1.0))})
    sent = list(toxicity._epoch(shared)(iter([at_once])))
    assert len(sent) > 2 and max(b.num_rows for b in sent) <= max(5, -(-len(toxicity._pack(whole)) // toxicity.DIM))


def test_toxicity_moves_labelled_texts_only(spark, monkeypatch):
    """Disk grew faster than the input: all texts were shuffled to meet their labels, and to each epoch with their words."""
    docs = [(k, f"{sentence(k, 30)} {'vile' if k % 20 == 0 else 'kind'}") for k in range(2_000)] + [(None, "no id"), (10, "same id"), (10, None)]
    marks = [(k, int(k % 20 == 0)) for k in range(0, 2_000, 10)] + [(20, 0), (None, 1), (30, 5), (9_999, 1)]
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    want = docs.join(labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id")
    rows = lambda df: sorted((r.doc_id, r.text or "", r.toxic) for r in df.select("doc_id", "text", "toxic").collect())
    assert rows(toxicity.labelled(docs, labels)) == rows(want) and len(rows(want)) == 202
    # ids of another type meet too
    assert rows(toxicity.labelled(docs, labels.select(F.col("doc_id").cast("int").alias("doc_id"), "toxic"))) == rows(want)
    marked = labels.where("toxic in (0, 1) and doc_id is not null")
    assert 202 <= toxicity._sieved(docs, marked).count() < 230
    # few bits let more rows through and none of the labelled out
    monkeypatch.setattr(toxicity, "SIEVE_BITS", 4)
    assert rows(toxicity.labelled(docs, labels)) == rows(want)
    # blocks are read without their words where only numbers count
    block = toxicity.Block.of(pa.array(["one two", None]), np.array([1.0, 0.0]), np.array([None, None], object)).row()
    (short,) = toxicity.Block.read(iter([block.select(["codes", "starts", "buckets", "y"])]))
    (full,) = toxicity.Block.read(iter([block]))
    assert len(short.words.vocab) == len(full.words.vocab) == 3 and (short.codes == full.codes).all() and short.lang.tolist() == [None, None]


def test_toxicity_cleaning():
    """Bytes in place of a regular expression: the same words."""
    texts = [None, "", "It's A-OK\x00\x7f now_then", "ÀÉ İx K;ß\u2028é", "caf\u00e9.Bar" * 3]
    got = toxicity._cleaned(pa.array(texts, pa.string()).slice(1))
    assert [t.split() for t in got.to_pylist()] == [re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", " ", pa.compute.utf8_lower(pa.scalar(t)).as_py()).split() for t in texts[1:]]


# 7


def test_top_k(spark):
    rnd = np.random.default_rng(4)
    rows = [(k, rnd.integers(-3, 4, 5).astype(float).tolist(), 1) for k in range(300)] + [(400 + k, [1.0, 1.0, 1.0, 1.0, 1.0], 1) for k in range(60)]
    rows += [(500, None, 1), (501, [1.0, None], 1), (502, [float("nan")] * 5, 1), (503, [float("inf")] * 5, 1), (None, [1.0] * 5, 1), (504, [2.0, 1.0], 1), (505, [], 1)]
    table = topk_search.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int"), 1.0)
    good = {i: np.array((v + [0.0] * 5)[:5]) for i, v, _ in rows[:360]} | {504: np.array([2.0, 1, 0, 0, 0]), 505: np.zeros(5)}
    queries = table.where("vec_id % 20 = 0")
    got = sorted(tuple(r) for r in topk_search.top_k(table, queries, 7).collect())
    want = []
    for q in good:
        if q % 20 == 0:
            best = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q)[:7]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert topk_search.top_k(table.where("false"), queries, 7).count() == 0
    assert topk_search.top_k(table.limit(3), table.limit(3), 7).count() == 6


# 9


def test_jaccard_groups(spark, documents, odd, odd_rows, empty):
    assert by_id(QUERIES["op9_jaccard_join"](spark, SF)) == brute.jaccard_components(pairs(documents))
    done = jaccard_join.jaccard_groups(odd)
    assert by_id(done) == brute.jaccard_components([r[:2] for r in odd_rows if r[0] is not None])
    assert done.count() == len(odd_rows) and done.where("doc_id is null and component_id is not null").count() == 0
    assert jaccard_join.jaccard_groups(empty).count() == 0


def test_jaccard_near_copies(spark):
    """Many near copies of one text around the limit, chains among them, and a line that all share."""
    rnd = random.Random(6)
    base, line, rows = sentence(20, 60).split(" "), sentence(21, 8), []
    for k in range(150):
        words = list(base) if k % 3 else sentence(k, rnd.randint(3, 60)).split(" ")
        for _ in range(rnd.randint(0, 3)):
            words[rnd.randrange(len(words))] = f"v{rnd.randint(0, 4)}"
        rows.append((k, " ".join(words[: rnd.randint(50, 60)]) + " " + line))
    got = by_id(jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute.jaccard_components(rows)


def test_jaccard_pairs_meet_at_their_first_shared_shingle(spark):
    """Groups that share many shingles meet once, not at each of them, whichever groups share the others."""
    shared = {t: range(6) for t in range(40)} | {t: [t % 6, (t + 1) % 6, (t + 3) % 6] for t in range(40, 60)} | {60: [6, 7], -5: [7, 8], -4: [6, 7, 8]}
    rows = []
    for grp in range(9):
        # shingles have the order of unsigned numbers
        own = sorted((t for t, who in shared.items() if grp in who), key=lambda t: t % (1 << 64))
        rows += [(t, False, at, grp, 900, grp) for at, t in enumerate(own)]
    keyed = spark.createDataFrame(rows, "token long, own boolean, at int, grp long, n long, component long")
    bits = spark.createDataFrame([], "grp long, " + ", ".join(f"x{k} long" for k in range(jaccard_join.BITMAP)))
    met = [(r.ca, r.cb) for r in jaccard_join._meetings(keyed, bits).collect()]
    want = {(a, b) for a in range(6) for b in range(a + 1, 6)} | {(6, 7), (6, 8), (7, 8)}
    assert set(met) == want and len(met) <= len(want) + 1


def test_jaccard_long_near_copies(spark):
    """Near copies of long texts share most of their prefixes; links between clusters are found all the same."""
    rnd, rows = random.Random(9), []
    for c in range(4):
        base = sentence(40 + c, 700).split(" ")
        for k in range(12):
            words = list(base)
            for _ in range(rnd.randint(0, 16)):
                words[rnd.randrange(len(words))] = f"v{rnd.randint(0, 999)}"
            rows.append((len(rows), " ".join(words)))
    got = by_id(jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute.jaccard_components(rows)


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(130, 129), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, **{k: 100 for k in range(100, 131)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 10


def test_decontaminate(spark, documents, odd, odd_rows, empty):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in QUERIES["op10_decontaminate"](spark, SF).collect()}
    docs, want = pairs(documents), set()
    for r in items.collect():
        question, answer = decontaminate.parts(r.text)
        for doc_id, text in docs:
            grams = {n: set(zip(*(decontaminate.tokens(text or "")[k:] for k in range(n)))) for n in range(1, 6)}
            share = [len(s & grams[n]) / len(s) for p in (question, answer) for n in [min(5, len(p))] for s in [set(zip(*(p[k:] for k in range(n))))]]
            if min(share) >= 0.8:
                want.add((doc_id, r.item_id))
    assert got == want and got
    hit = items.limit(1).collect()[0]
    extra = spark.createDataFrame([(900, "start " + hit.text.upper() + " end"), (901, hit.text[: len(hit.text) // 3])], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(extra, items).collect()} == {(900, hit.item_id)}
    assert [r.doc_id for r in decontaminate.decontaminated(extra, items).collect()] == [901]
    none = spark.createDataFrame([(None, "x"), (1, None), (2, ""), (3, "...")], "item_id long, text string")
    for i in (items, none, none.limit(0)):
        assert decontaminate.decontaminated(odd, i).count() == len(odd_rows) and decontaminate.contaminated(empty, i).count() == 0


def test_decontaminate_parts_apart(spark, monkeypatch):
    """Question and answer 200 words apart, either order, with items in one index or in several."""
    rows = [(k, " ".join(w.capitalize() for w in sentence(100 + k, 25).split(" ")) + "? " + sentence(200 + k, 1 + k % 20) + ".") for k in range(40)]
    items = spark.createDataFrame(rows, "item_id long, text string")
    texts, want = [], set()
    for k, text in rows:
        question, answer = (" ".join(x) for x in decontaminate.parts(text))
        far = sentence(300 + k, 200)
        texts += [(3 * k, f"{question} {far} {answer}"), (3 * k + 1, f"{answer} {far} {question}"), (3 * k + 2, f"{question} {far}")]
        want |= {(3 * k, k), (3 * k + 1, k)}
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = sorted(map(tuple, decontaminate.contaminated(docs, items).collect()))
    assert {r[:2] for r in found} - {r for r in want} <= {(3 * k + 2, k) for k in range(40) if k % 20 < 2} and want <= {r[:2] for r in found}
    monkeypatch.setattr(decontaminate, "SHARD_CHARS", 2_000)
    several = list(decontaminate.indexes(items))
    assert len(several) > 1 and sorted(map(tuple, decontaminate.contaminated(docs, items).collect())) == found
    one = decontaminate.Index(rows)
    assert all(np.isclose(x.scores[k].max(), one.scores[one.terms.index(t)].max()) or len(one.docs[one.terms.index(t)]) > 1 for x in several for k, t in enumerate(x.terms))


def test_block_max_wand_equals_full_scores():
    rnd = random.Random(8)
    items = [(k, " ".join(rnd.choice("abcdefghijklmnop") + str(rnd.randint(0, 6)) for _ in range(rnd.randint(3, 120)))) for k in range(150)]
    index = decontaminate.Index(items)
    for _ in range(60):
        terms = sorted(rnd.sample(range(len(index.terms)), 40))
        full = np.zeros(len(index.need))
        for t in terms:
            full[index.docs[t]] += index.scores[t]
        assert sorted(index.retrieve(terms)) == np.flatnonzero(full >= index.need - 1e-9).tolist()
