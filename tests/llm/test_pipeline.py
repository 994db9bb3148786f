"""The stages of the corpus pipeline against plain versions, each on its own input."""

import brute
import corpus_pipeline
from conftest import SF
from pyspark.sql import functions as F

from gridloom.llm import decontaminate


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert name == "bpe" or docs.columns == names
        kept[name] = before, {r.doc_id: r for r in docs.collect()}
    before, after = kept["toxicity"]
    assert 0.5 * len(before) < len(after) <= len(before)
    before, after = kept["near_duplicates"]
    assert set(after) == {d for d, (_, c) in brute.jaccard_components(list(before.items())).items() if c == d}
    before, after = kept["substring_dedup"]
    want = brute.kept_words(list(before.items()))
    assert set(after) == set(before) and all((after[d].text == before[d]) == (n == 0) for d, (_, n, _) in want.items())
    before, after = kept["decontamination"]
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    texts = spark.createDataFrame(list(before.items()), "doc_id long, text string")
    assert set(before) - set(after) == {r.doc_id for r in decontaminate.contaminated(texts, items).collect()}
    before, after = kept["bpe"]
    assert set(after) == set(before) and all(r.n_tokens > 0 for d, r in after.items() if before[d])


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).agg(F.count("*")).first()[0] > 0


def test_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None, None), (None, "a b", "en", "s", 3), (1, "", None, None, 0), (2, "w " * 500, "en", None, None), (2, "w " * 500, "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, start in enumerate((docs, docs.limit(0))):
        out = start
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, out, SF).write.parquet(str(tmp_path / f"{k}{name}"))
            out = spark.read.parquet(str(tmp_path / f"{k}{name}"))
        # of the two equal rows of doc_id 2 one stays
        assert out.count() == (0 if k else len(rows) - 1)


def test_near_duplicates_of_rows(spark):
    """Rows that repeat with one doc_id are copies; texts that share a doc_id go or stay each by its own links."""
    words = [[f"{c}{k}" for k in range(60)] for c in "abcd"]
    texts = [" ".join(w) for w in words]
    near = " ".join([*words[0][:-1], "other"])
    rows = [(1, texts[0], "en", "s", 1), (2, texts[1], "en", "s", 1), (2, texts[1], "en", "s", 1), (3, near, "en", "s", 1), (3, texts[2], "en", "s", 1)]
    rows += [(4, texts[3], "en", "b", 2), (4, texts[3], "en", "a", 3), (5, "", "en", "s", 0), (5, "", "en", "s", 0), (None, texts[0], "en", "s", 1), (None, texts[0], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    done = stage(spark, docs, SF)
    assert stage(spark, docs.limit(0), SF).count() == 0
    assert done.columns == docs.columns
    assert sorted(map(tuple, done.collect()), key=str) == sorted([rows[0], rows[1], rows[4], rows[6], *rows[7:]], key=str)


def test_columns_with_clashing_names(spark, tmp_path):
    """Columns named like added ones, and of types without an order, come out as they went in."""
    words = " ".join(f"w{k}" for k in range(60))
    added = ["near_duplicate_node", "gone", "score", "predicted", "n_removed", "kept_text", "component_id", "n_shingles", "item_id"]
    rows = [(k, t, 5, {"a": k}, *["keep"] * len(added)) for k, t in ((1, words), (1, words), (2, words), (3, "plain text here"), (4, None))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, Tags map<string,long>, " + ", ".join(f"{c} string" for c in added))
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, out, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([rows[0], rows[3], rows[4]], key=str)
