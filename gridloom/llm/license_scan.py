"""License scans by diagonal voting, with Spark expressions only.

Every word pair of a text that also stands in a template votes for the template's place in the text: the
diagonal, position in the text less position in the template. Neighbouring diagonals are merged, so that a
template with words put in or left out is found too. The merged span is then verified word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Phrases whose every place counts, and their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: Further templates, found with a word put in or left out too; a hit adds only the label.
MORE = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("released into the public domain", "public-domain"),
]
#: Share of a further template's word pairs that a verified span must have.
SHARE = 0.7
#: Diagonals this near are merged.
REACH = 2
#: Template pairs up to which the join may be a broadcast one; more of them meet the corpus in a shuffle.
BROADCAST_PAIRS = 200_000


def _low(text: Column) -> Column:
    """A-Z in lower case, other characters but a-z, 0-9 and those beyond ASCII as blanks."""
    # lower() makes a plain k of KELVIN SIGN, which is a letter beyond ASCII; any other such letter stands for it
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u03ba")))
    return F.split(F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), " ")


def _voters(words: str) -> Column:
    """Words of an array with position and next word; the last has none."""
    return F.posexplode(F.arrays_zip(F.col(words).alias("v0"), F.slice(words, F.lit(2), F.size(words)).alias("v1"))).alias("pos", "voter")


def catalogue(spark: SparkSession) -> DataFrame:
    """The built-in templates (label, text, base): three base phrases and openings of well-known licenses."""
    rows = [(label, phrase, k < len(BASE)) for k, (phrase, label) in enumerate(BASE + MORE)]
    return spark.createDataFrame(rows, "label string, text string, base boolean")


def _pairs(templates: DataFrame) -> DataFrame:
    """One row for each word pair of each template."""
    words = templates.where("label is not null").select("label", F.coalesce("base", F.lit(False)).alias("base"), _low(F.col("text")).alias("words")).distinct()
    # equal words under one label and kind are one template
    words = words.withColumn("phrase", F.md5(F.to_json(F.struct("label", "base", "words"))))
    pairs = words.select("phrase", "label", "base", (F.size("words") - 1).alias("most"), _voters("words")).where("voter.v1 is not null")
    return pairs.select("phrase", "label", "base", "most", F.col("pos").alias("at"), F.col("voter.v0").alias("w0"), F.col("voter.v1").alias("w1"))


def _chain(votes: Column) -> Column:
    """Length of the longest chain of votes (pos, -at) that ascends both in the text and in the template.

    Each vote stands for two words that are equal in both, so the chain is what the span's words and the
    template's have in common in order. tails[k] is the least end in the template of a chain of k + 1 votes.
    """

    def step(tails: Column, vote: Column) -> Column:
        at = -vote["neg"]
        k = F.size(F.filter(tails, lambda t: t < at))
        return F.concat(F.slice(tails, F.lit(1), k), F.array(at), F.slice(tails, k + 2, F.size(tails)))

    return F.size(F.aggregate(F.array_sort(votes), F.array().cast("array<int>"), step))


def license_scan(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` for each row.

    templates holds (label, text, base); without it ``catalogue`` is used. Words of texts and templates are
    runs of a-z, 0-9 and characters beyond ASCII after A-Z are lower-cased. n_base counts the places where
    all words of a base template stand one after another; first_word and last_word are the smallest and
    largest start of them (else null). labels also holds those of further templates, of whose word pairs at
    least SHARE stand in one span of the text in the template's order, each counted once, on diagonals at
    most REACH apart. score is the largest such share of any template, 0 without votes.

    Null or empty text: no words, score 0. Templates without a label or with fewer than two words take no
    part; a null base is none. Rows are told apart by their place, not by doc_id, so repeated rows and null
    keys keep their own results. Other columns are not read. Only votes are shuffled, unless there are more
    than BROADCAST_PAIRS template pairs.
    """
    pairs = _pairs(catalogue(docs.sparkSession) if templates is None else templates)
    if pairs.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS:  # a count of the templates, not of the corpus
        pairs = F.broadcast(pairs)
    words = docs.select("doc_id", _low(F.col("text")).alias("words"))
    rows = words.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.expr("cast(if(words[0] = '', 0, size(words)) as bigint) n_words"), "words")
    voters = rows.select("row", "doc_id", "n_words", _voters("words")).select("row", "doc_id", "n_words", "pos", "voter.v0", "voter.v1")
    votes = voters.join(pairs, (F.xxhash64("v0", "v1") == F.xxhash64("w0", "w1")) & (F.col("v0") == F.col("w0")) & (F.col("v1") == F.col("w1")), "left")
    # the last word, which has no pair, keeps the row of a text without votes
    votes = votes.where("phrase is not null or v1 is null")
    phrase = ["phrase", "label", "base", "most"]
    line = (F.col("pos") - F.col("at")).alias("line")
    lines = votes.groupBy("row", "doc_id", "n_words", *phrase, line).agg(F.count("phrase").alias("votes"), F.collect_list(F.struct("pos", (-F.col("at")).alias("neg"))).alias("voted"))
    near = Window.partitionBy("row", "phrase").orderBy("line").rangeBetween(0, REACH)
    merged = lines.withColumn("span", F.flatten(F.collect_list("voted").over(near))).withColumn("cast", F.sum("votes").over(near))
    # one diagonal with all votes is the template itself; on a single diagonal every vote ascends
    chain = F.when(F.col("votes") == F.col("most"), F.col("votes")).when(F.col("cast") == F.col("votes"), F.col("votes")).otherwise(_chain(F.col("span")))
    merged = merged.withColumn("share", F.when(F.col("phrase").isNull(), 0.0).otherwise(chain / F.col("most")))
    full, like = "base and votes = most", f"(base and votes = most) or (not base and share >= {SHARE})"
    joined = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(F.expr(when), F.col("label")))), ",")
    return merged.groupBy("row", "doc_id", "n_words").agg(
        F.count(F.when(F.expr(full), 1)).alias("n_base"), F.min(F.when(F.expr(full), F.col("line").cast("long"))).alias("first_word"),
        F.max(F.when(F.expr(full), F.col("line").cast("long"))).alias("last_word"), joined(full).alias("base_labels"), joined(like).alias("labels"),
        F.max("share").alias("score"),
    ).drop("row")
