"""N-gram Jaccard join: documents whose sets of five-word shingles agree to 0.8 or more, and their groups.

Grouped prefix join. Shingles have one order, rare before frequent. Two sets that are similar enough
share a shingle among the first few of each (the prefix). Documents with the same prefix and size form
one group; groups that share a prefix shingle are compared, and members of groups are verified on texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm import words as W
from gridloom.llm.components import components
from gridloom.session import cut

SHINGLE = 5
#: Similarity in hundredths.
LEAST = 80
#: log2 of the counters of shingle frequency. The order of shingles that they give decides only how many candidates
#: there are; any order finds all pairs. Their number does not grow with the data: a shingle stands out from
#: its counter's others if it makes more than about one in 2 ** COUNTER_BITS of all, at any size.
COUNTER_BITS = 18
#: Bits of a prefix entry that hold the rank; the others are of the shingle's hash.
RANK_BITS = 8
#: Longs of a set's bitmap, in which each shingle turns one bit. Sets differ by at least as many shingles as bitmaps do by bits.
BITMAP = 4
#: Shared prefix shingles just before one that a group brings along to where it meets others.
PAST = 4
_BITS = [f"x{k}" for k in range(BITMAP)]
_SET = "doc_id long, n long, s1 long, s2 long, grp long, prefix array<long>, " + ", ".join(f"{x} long" for x in _BITS)


def _words(text: pa.Array) -> tuple[W.Words, np.ndarray]:
    w = W.split(pc.ascii_lower(pc.fill_null(text.cast(pa.string()), "")))
    return w, w.hashes()


def shingle_sets(text: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w, h = _words(text)
    out = []
    with np.errstate(over="ignore"):
        grams = W.windows(h, SHINGLE)
        for lo, hi in zip(w.starts.tolist(), w.starts[1:].tolist()):
            if hi - lo >= SHINGLE:
                out.append(np.unique(grams[lo : hi - SHINGLE + 1]))
            else:
                out.append(W.windows(h[lo:hi], hi - lo) if hi > lo else np.zeros(0, np.uint64))
    return out


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common > 0 and 100 * common >= LEAST * (len(a) + len(b) - common)


def prefix_size(n: int) -> int:
    """How many of the first of n shingles hold one of any similar set's prefix."""
    return n - (n * LEAST + 99) // 100 + 1


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << COUNTER_BITS, np.int64)
    for part in W.slices(batches):
        w, h = _words(part.column("text"))
        with np.errstate(over="ignore"):
            grams = W.windows(h, SHINGLE)
        inside = w.ends()[: len(grams)] - np.arange(len(grams)) >= SHINGLE
        total += np.bincount(_bucket(grams[inside]), minlength=len(total))
    hit = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["bucket", "n"])


def frequency(docs: DataFrame) -> np.ndarray:
    """For each counter four times the binary logarithm of how often its shingles occur in all documents.

    Brings 2 ** COUNTER_BITS numbers to the driver, whatever the input.
    """
    rows = docs.select("text").mapInArrow(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    total = np.ones(1 << COUNTER_BITS)
    total[rows["bucket"].to_numpy(np.int64)] = rows["n"]
    return (4 * np.log2(np.maximum(total, 1))).astype(np.uint8)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Parity of how many hashes turn each of the bits, as signed longs."""
    turned = np.bincount((hashes % np.uint64(64 * BITMAP)).astype(np.int64), minlength=64 * BITMAP) & 1
    return np.packbits(turned.astype(bool)).view(np.int64)


def _sets(shared):
    """Task function: size, signature, group and prefix of each document's set; of an empty one only the size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = shared.value
        for part in W.slices(batches):
            rows = []
            for doc_id, s in zip(part.column("doc_id").to_pylist(), shingle_sets(part.column("text"))):
                n = len(s)
                if not n:
                    rows.append((doc_id, 0, None, None, None, None, *[None] * BITMAP))
                    continue
                with np.errstate(over="ignore"):
                    p = prefix_size(n)
                    ordered = (rarity[_bucket(s)].astype(np.uint64) << np.uint64(64 - RANK_BITS)) | (s >> np.uint64(RANK_BITS))
                    prefix = np.sort(np.partition(ordered, p - 1)[:p])
                    scrambled = W.mix(s)
                    grp = W.windows(np.append(prefix, np.uint64(n)), p + 1)[0]
                    signs = np.array([scrambled.sum(), np.bitwise_xor.reduce(W.mix(scrambled)), grp], np.uint64)
                rows.append((doc_id, n, *W.signed(signs).tolist(), W.signed(prefix), *bitmap(scrambled).tolist()))
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] + [pa.int64()] * BITMAP
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["doc_id", "n", "s1", "s2", "grp", "prefix", *_BITS])

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.slices(iter([batch]), "text_a"):
            ok = [similar(x, y) for x, y in zip(shingle_sets(part.column("text_a")), shingle_sets(part.column("text_b")))]
            yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those pairs (a, b) of doc_id whose texts are similar."""
    texts = docs.select("doc_id", "text").where("doc_id is not null")
    first = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = first.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a long, b long").distinct()


#: Least size of the common part, and whether so few common prefix shingles still allow it: of the prefix that
#: ends first no other shingle is in the other set.
_NEED = f"(((na + nb) * {LEAST} + {99 + LEAST}) div {100 + LEAST})"
_POSSIBLE = " or ".join(f"(n{x} - (n{x} * {LEAST} + 99) div 100 + 1 - common <= n{x} - {_NEED})" for x in "ab")
#: Whether the token, at place ia of a's ordered set and ib of b's, may be the first that a similar pair shares.
_FIRST = f"least(na - ia, nb - ib) >= {_NEED}"
#: Whether bitmaps leave it open that two sets share as much as they need; no bitmap leaves it open.
_DIFFER = " + ".join(f"bit_count(a{x} ^ b{x})" for x in _BITS)
_ALIKE = f"coalesce({_DIFFER} <= na + nb - 2 * {_NEED}, true)"
_SIZED = f"100 * least(na, nb) >= {LEAST} * greatest(na, nb)"


def _meetings(keyed: DataFrame, bits: DataFrame) -> DataFrame:
    """``(ga, gb, na, nb, ca, cb)``: groups of different components ca < cb at each shingle where they meet.

    keyed: (token, own, at, grp, n, component); bits: (grp, ``_BITS``). A pair is needed once, at the first shingle that
    both have. So of shingles that the same groups have (by a 128-bit signature) the first stands for all, and at the others a
    group meets only those that share none of the PAST shingles before it: whoever shares one was met there or earlier.
    """
    alike = lambda seed: F.expr(f"bit_xor(xxhash64({seed}, grp, component))")
    # places follow shingles as unsigned numbers
    unsigned = F.col("token").bitwiseXOR(F.lit(-(1 << 63)))
    who = keyed.groupBy("token", "own").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("groups"), alike(1).alias("g1"), alike(2).alias("g2"))
    first = who.where("lo <> hi").groupBy("own", "groups", "g1", "g2").agg(F.min(unsigned).bitwiseXOR(F.lit(-(1 << 63))).alias("token")).select("token", "own")
    before = Window.partitionBy("grp", "own", "component").orderBy("at").rowsBetween(-PAST, -1)
    keyed = keyed.join(first, ["token", "own"]).distinct().join(bits, "grp", "left").withColumn("past", F.collect_list("token").over(before))
    keyed = cut(keyed, "spread")
    a = keyed.select("token", "own", F.col("at").alias("ia"), F.col("grp").alias("ga"), F.col("n").alias("na"), F.col("component").alias("ca"), F.col("past").alias("pa"), *[F.col(x).alias(f"a{x}") for x in _BITS])
    b = keyed.select("token", "own", F.col("at").alias("ib"), F.col("grp").alias("gb"), F.col("n").alias("nb"), F.col("component").alias("cb"), F.col("past").alias("pb"), *[F.col(x).alias(f"b{x}") for x in _BITS])
    met = a.join(b, ["token", "own"]).where("ca < cb").where(_SIZED).where(_FIRST).where(_ALIKE).where("not arrays_overlap(pa, pb)")
    return met.select("ga", "gb", "na", "nb", "ca", "cb")


def _across(placed: DataFrame, tokens: DataFrame, heads: DataFrame, known: DataFrame, bits: DataFrame) -> DataFrame:
    """``(a, b, ca, cb)``: pairs of nodes in different components ca < cb that may be similar.

    placed: (node, grp, n, component); tokens: (token, at, grp), all groups of each prefix shingle that several groups
    have, with its place there; heads: (grp, head), one document of each; known: (doc_id, grp, prefix); bits: (grp, ``_BITS``), bitmaps of groups of one
    set. Groups meet at shingles that may be their first common one, if their bitmaps do not rule out that they are
    similar; those that met are told apart by all of their prefixes.
    """
    kinds = cut(placed.select("grp", "n", "component").distinct(), "kinds")
    # a group whose members are of several components is compared with itself: its own key stands for a shingle
    own = kinds.groupBy("grp").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    keyed = tokens.select("token", F.lit(False).alias("own"), "at", "grp").unionByName(own.select(F.col("grp").alias("token"), F.lit(True).alias("own"), F.lit(0).alias("at"), "grp"))
    met = cut(_meetings(keyed.join(kinds, "grp"), bits).distinct(), "met")
    needed = met.select(F.col("ga").alias("grp")).unionByName(met.select(F.col("gb").alias("grp"))).distinct()
    prefixes = heads.join(needed, "grp").join(known.select("grp", F.col("doc_id").alias("head"), "prefix"), ["grp", "head"])
    left, right = (prefixes.select(F.col("grp").alias(f"g{x}"), F.col("prefix").alias(f"p{x}")) for x in "ab")
    met = met.join(left, "ga").join(right, "gb").withColumn("common", F.size(F.array_intersect("pa", "pb")))
    met = met.where(f"ga = gb or {_POSSIBLE}").select("ga", "gb", "ca", "cb")
    x = placed.select(F.col("grp").alias("ga"), F.col("component").alias("ca"), F.col("node").alias("a"))
    y = placed.select(F.col("grp").alias("gb"), F.col("component").alias("cb"), F.col("node").alias("b"))
    return met.join(x, ["ga", "ca"]).join(y, ["gb", "cb"]).select("a", "b", "ca", "cb").distinct()


def jaccard_groups(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for each document.

    Two documents link when 100 * |common shingles| >= 80 * |all shingles| of the two sets; a component
    is the least doc_id that links reach. A-Z are lower-cased; with fewer than five words the whole
    sequence is the one shingle.

    First each group's least document is compared with the other members, and the group that has a prefix
    shingle earliest with the others that have it: about as many pairs as rows. That group has least beside the
    shingles that are as frequent, so it is like most of the others where a frequent passage is nearly all of a text. Pairs whose ends these
    links have joined need no look; all others that share a prefix shingle and can be similar are
    verified then. So a large group of copies costs no pairs within it and no link between components
    is lost.

    Null or blank text: no shingles, linked with nothing. A row without doc_id is its own, with null as
    component. Rows that share a doc_id count as one document with several texts: it links if one of
    them does. Equal texts are one node. Other columns are not read. Sets are compared by 64-bit
    shingle hashes, equal sets by a 128-bit signature.
    """
    docs = docs.select("doc_id", "text")
    rarity = docs.sparkSession.sparkContext.broadcast(frequency(docs))
    sets = cut(docs.mapInArrow(_sets(rarity), _SET), "sets")
    known = sets.where("doc_id is not null and n > 0")
    nodes = cut(known.groupBy("grp", "s1", "s2").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), *[F.first(x).alias(x) for x in _BITS]), "nodes")
    heads = nodes.groupBy("grp").agg(F.min("node").alias("head"), F.first("n").alias("n"))
    rows = known.select("grp", F.posexplode("prefix").alias("at", "token"))
    # written, as a join of two shuffles can split a hot shingle
    hub = F.min_by("grp", F.struct("at", "grp")).alias("hub")
    shared = cut(rows.groupBy("token").agg(hub, F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo <> hi").select("token", "hub"), "shared")
    tokens = cut(rows.join(shared, "token").select("token", "at", "hub", "grp").distinct(), "tokens")
    stars = tokens.where("grp <> hub").groupBy("hub", "grp").agg(F.count("*").alias("common"))
    a = heads.select(F.col("grp").alias("hub"), F.col("head").alias("a"), F.col("n").alias("na"))
    b = heads.select("grp", F.col("head").alias("b"), F.col("n").alias("nb"))
    between = stars.join(a, "hub").join(b, "grp").where(_SIZED).where(_POSSIBLE).select("a", "b")
    inside = nodes.join(heads.select("grp", "head"), "grp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    near = components(verified(between.unionByName(inside), docs))
    placed = cut(nodes.drop(*_BITS).join(near, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    # members of a group differ beyond its prefix: only a group of one set has a bitmap
    bits = nodes.groupBy("grp").agg(F.count("*").alias("sets"), *[F.first(x).alias(x) for x in _BITS]).where("sets = 1").drop("sets")
    rest = cut(_across(placed, tokens, heads.select("grp", "head"), known, bits), "across")
    more = verified(rest.select("a", "b"), docs).join(rest, ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    joined = components(more).select(F.col("node").alias("component"), F.col("component").alias("least"))
    ends = placed.join(joined, "component", "left").select("grp", "s1", "s2", F.coalesce("least", "component").alias("end"))
    found = known.select("doc_id", "n", "grp", "s1", "s2").join(ends, ["grp", "s1", "s2"]).select("doc_id", "n", "end")
    # one document may have several texts
    found = found.unionByName(sets.where("doc_id is null or n = 0").select("doc_id", "n", F.col("doc_id").alias("end")))
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("end").alias("component_id"))
