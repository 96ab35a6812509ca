"""Near-duplicates by ProbMinHash: probability Jaccard of five-word shingles, banding, verification.

Every shingle of a text is a Poisson process whose rate is its weight; each arrival falls into one of ``M``
registers at random, and a register keeps the shingle that arrives first.  A process stops as soon as its next
arrival is later than all registers' (early termination).  Two texts agree in a register with the probability
that is their probability Jaccard similarity.

A shingle's weight is 1 + ln of how often the text has it.  A text is a link of another if the probability Jaccard
similarity of their weighted shingles is at least ``LEAST``, or the Jaccard similarity of the sets (all weights 1) is: a line
that one copy repeats two hundred times must not hide the copy, nor must a few words that differ hide that all the rest
of two texts is the same paragraph again and again.  So a text has two signatures, by weights and by weights of 1.
Both use the same processes, so they differ for texts with a repeated shingle only, and those are in the buckets of both.

1. Exact copies: texts of equal words are one class, named by its smallest id.  Only class representatives go on.
2. ``BANDS`` bands of ``ROWS`` registers put them into buckets.  A bucket's members are paired with its leader
   alone (in one of three orders, by band), never with each other.  Pairs whose signatures agree enough are
   verified on the shingles of their whole texts, by either similarity.
3. Connected components of the links.
4. The rest, exactly: in each bucket that still holds more than one component, members of different components
   are compared on their shingles inside pairs of blocks of bounded size, which give only links that join
   components.  So no pair that shares a bucket is left out, and none inside a component is looked at again.

Defined cases: texts without a word are in a class of their own each; texts of fewer than five words have one
shingle of all their words; rows that share an id are one document; rows without an id have a null class; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH = 5
LEAST = 0.8
BANDS, ROWS = 25, 5
M = BANDS * ROWS
#: Pairs whose signatures agree in a smaller share of registers aren't verified: 0.8 less more than four standard errors.
AGREE = 0.65
#: Rows of a block of a bucket's members; a group of two blocks is what one task holds.
BLOCK = 512
#: At most so many ids go to every task; more are joined by a shuffle.
SENT_IDS = 2_000_000


def weighted(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of every text in order of text and hash: text, hash, count."""
    h, begin = common.shingle_hashes(words, first, WIDTH)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(begin))
    by = np.lexsort((h, doc))
    h, doc = h[by], doc[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def signatures(doc: np.ndarray, h: np.ndarray, count: np.ndarray, n: int, m: int = M) -> np.ndarray:
    """n x m: the shingle that comes first in each register."""
    first = np.full(n * m, np.inf)
    who = np.zeros(n * m, np.uint64)
    limit = np.full(n, np.inf)
    t, rate = np.zeros(len(h)), 1 + np.log(count)
    state = h
    while len(h):
        state = common.mix(state + np.uint64(0x9E3779B97F4A7C15))
        t = t - np.log(((state >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / rate
        live = t < limit[doc]
        doc, h, rate, t, state = doc[live], h[live], rate[live], t[live], state[live]
        at = doc * m + (common.mix(state) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, at, t)
        won = first[at] == t
        who[at[won]] = h[won]
        limit = first.reshape(n, m).max(axis=1)
    return who.reshape(n, m)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets."""
    if not len(a) or not len(b):
        return 0.0
    both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return both / (len(a) + len(b) - both)


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Of two sorted sets with weights: the sum over common elements of 1 / sum over all elements of max(a' / a, b' / b).

    In order of the ratio of the two weights, an element's maxima are those of b before it and those of a from it on.
    """
    every = np.union1d(a, b)
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a)], y[np.searchsorted(every, b)] = wa, wb
    with np.errstate(divide="ignore"):
        by = np.argsort(np.where(y > 0, x / np.maximum(y, 1e-300), np.inf), kind="stable")
    x, y = x[by], y[by]
    common_ = (x > 0) & (y > 0)
    behind = x[::-1].cumsum()[::-1]  # of a from here on
    before = y.cumsum() - y  # of b before here
    return float((1 / (behind[common_] / x[common_] + before[common_] / y[common_])).sum()) if common_.any() else 0.0


def linked_texts(a: np.ndarray, wa: np.ndarray | None, b: np.ndarray, wb: np.ndarray | None) -> bool:
    """wa, wb: weights, None for all 1."""
    if jaccard(a, b) >= LEAST:
        return True
    if (wa is None and wb is None) or not len(a) or not len(b):
        return False
    ones = lambda w, s: np.ones(len(s)) if w is None else w
    return probability_jaccard(a, ones(wa, a), b, ones(wb, b)) >= LEAST


def read_set(s: bytes, w: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    return np.frombuffer(s, "<u4"), np.frombuffer(w, "<f4") if len(w) else None


def links_between(key: int, left: dict, right: dict, same: bool) -> list[tuple[int, int]]:
    """Links that join components of one bucket's two blocks: rep, comp, s (sorted sets), w (weights or None), bands.

    Intersections with all of the right block are counted at once along its inverted lists.  A pair that shares a
    smaller key is left to that key's bucket, and only links that join what isn't joined yet are kept.
    """
    heavy = np.array([w is not None for w in right["w"]])
    sizes = np.array([len(x) for x in right["s"]])
    flat, row = np.concatenate(right["s"]), np.repeat(np.arange(len(sizes)), sizes)
    by = np.argsort(flat, kind="stable")
    flat, row = flat[by], row[by]
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.get(x, x) != x:
            x = up[x]
        return x

    out = []
    for k, mine in enumerate(left["s"]):
        lo, hi = np.searchsorted(flat, mine, "left"), np.searchsorted(flat, mine, "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(row[at], minlength=len(sizes))
        own = left["w"][k]
        linked, apart = both >= LEAST * (len(mine) + sizes - both), right["comp"] != left["comp"][k]
        if same:
            apart &= right["rep"] > left["rep"][k]
        for j in np.flatnonzero(apart & ~linked & (both > 0) & (heavy | (own is not None))).tolist():
            linked[j] = linked_texts(mine, own, right["s"][j], right["w"][j])
        found = np.flatnonzero(linked & apart)
        if not len(found):
            continue
        bands = left["bands"][k]
        found = found[~np.isin(right["bands"][found], bands[bands < key]).any(axis=1)]
        for j in found.tolist():
            x, y = top(int(left["comp"][k])), top(int(right["comp"][j]))
            if x != y:
                up[max(x, y)] = min(x, y)
                r, o = int(left["rep"][k]), int(right["rep"][j])
                out.append((min(r, o), max(r, o)))
    return out


SIGNED = "doc_id long, h1 long, h2 long, n int, bands array<long>, sig binary, heavy binary"


def band_keys(sig: np.ndarray) -> np.ndarray:
    band = np.zeros((len(sig), BANDS), np.uint64)
    for r in range(ROWS):
        band = common.mix(band * np.uint64(31) + sig[:, r::ROWS])
    return common.mix(band + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to SIGNED; n is the number of distinct shingles; heavy is the signature by weights, empty if it is sig."""

    def sign(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(rows, 1000):
            k = b.num_rows
            words, first = common.word_hashes(*common.utf8(b.column(1)))
            doc, h, count = weighted(words, first)
            n = np.bincount(doc, minlength=k)
            sig = signatures(doc, h, np.ones_like(count), k)
            repeats = np.unique(doc[count > 1])
            some = np.isin(doc, repeats)
            heavy = signatures(np.searchsorted(repeats, doc[some]), h[some], count[some], len(repeats))
            # two hashes of the sequence of words name the class of exact copies
            place = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))
            whole = []
            for seed in (1, 2):
                total = np.zeros(len(words) + 1, np.uint64)
                np.cumsum(common.mix(words + common.mix(place.astype(np.uint64) + np.uint64(seed << 40))), out=total[1:])
                whole.append(common.mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64))
            bands = [x if c else [] for x, c in zip(band_keys(sig).tolist(), n, strict=True)]
            more = [b""] * k
            for d, own, s in zip(repeats.tolist(), band_keys(heavy).tolist(), heavy.astype("<u2"), strict=True):
                bands[d] = bands[d] + [x for x, y in zip(own, bands[d], strict=True) if x != y]
                more[d] = s.tobytes()
            sigs = [s.astype("<u2").tobytes() for s in sig]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(whole[0]), pa.array(whole[1]), pa.array(n, pa.int32()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary()), pa.array(more, pa.binary())], ["doc_id", "h1", "h2", "n", "bands", "sig", "heavy"])

    common.arrow_bytes(docs.sparkSession)
    return common.save(docs.mapInArrow(sign, SIGNED), "signed")


def _agree(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs a, b whose signatures agree, those of sets (and their sizes) or those by weights."""
    sig = nodes.select("rep", "n", "sig", "heavy")
    both = pairs.join(sig.toDF("a", "na", "sa", "wa"), "a").join(sig.toDF("b", "nb", "sb", "wb"), "b")
    both = both.where((F.least("na", "nb") >= 0.7 * F.greatest("na", "nb")) | (F.length("wa") > 0) | (F.length("wb") > 0))

    def look(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(rows, 1000):
            x, y, v, w = (b.column(k).to_pylist() for k in (2, 3, 4, 5))
            of = lambda s: np.frombuffer(b"".join(s), "<u2").reshape(-1, M)
            sets = (of(x) == of(y)).mean(axis=1)
            weights = (of([p or q for p, q in zip(v, x, strict=True)]) == of([p or q for p, q in zip(w, y, strict=True)])).mean(axis=1)
            ok = pa.array(np.maximum(sets, weights) >= AGREE)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["a", "b"])

    return both.select("a", "b", "sa", "sb", "wa", "wb").mapInArrow(look, "a long, b long")


def _sets(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, s (the sorted set of 32-bit shingle hashes) and w (their weights, empty if all are 1) of the whole texts of some documents (column doc_id)."""

    def shingle(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(rows, 1000):
            doc, h, count = weighted(*common.word_hashes(*common.utf8(b.column(1))))
            low = (h >> np.uint64(32)).astype("<u4")  # in order of h, and so in order
            ends = np.searchsorted(doc, np.arange(b.num_rows + 1))
            sets, weights = [], []
            for i, j in zip(ends[:-1], ends[1:], strict=True):
                s, at = np.unique(low[i:j], return_index=True)
                sets.append(s.tobytes())
                weights.append((1 + np.log(count[i:j][at])).astype("<f4").tobytes() if (count[i:j] > 1).any() else b"")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary()), pa.array(weights, pa.binary())], ["doc_id", "s", "w"])

    common.arrow_bytes(docs.sparkSession)
    return common.save(docs.join(common.small_or_shuffled(ids, SENT_IDS), "doc_id", "left_semi").mapInArrow(shingle, "doc_id long, s binary, w binary"), "shingles")


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs a, b that are links, by the shingles of their whole texts."""

    def compare(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(rows, 1000):
            ok = pa.array([linked_texts(*read_set(x, v), *read_set(y, w)) for x, v, y, w in zip(*(b.column(k).to_pylist() for k in range(2, 6)), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["a", "b"])

    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), docs)
    both = pairs.join(sets.toDF("a", "sa", "wa"), "a").join(sets.toDF("b", "sb", "wb"), "b").select("a", "b", "sa", "wa", "sb", "wb")
    links = common.save(both.mapInArrow(compare, "a long, b long"), "links")
    common.discard(sets)
    return links


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, comp (the smallest node it is linked to, over any number of links), for nodes with links."""
    ways = common.save(links.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(links.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct(), "ways")
    label = common.save(ways.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("comp")), "labels")
    while True:
        near = ways.join(label.toDF("v", "c"), "v").groupBy(F.col("u").alias("node")).agg(F.min("c").alias("c"))
        lower = label.join(near, "node").select("node", "comp", F.least("comp", "c").alias("c"))
        # and on to what the new label's own node is labelled
        jumped = lower.join(label.toDF("c", "cc"), "c", "left").select("node", F.least("c", "cc").alias("comp"), (F.least("c", "cc") < F.col("comp")).alias("moved"))
        jumped, before = common.save(jumped, "labels"), label
        common.discard(before)  # the round before is read no more
        label = jumped.select("node", "comp")
        label.scratch_path = jumped.scratch_path
        if jumped.where("moved").limit(1).count() == 0:
            common.discard(ways)
            return label


def _rest(nodes: DataFrame, buckets: DataFrame, comp: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between different components that share a bucket, verified on whole texts; a saved table."""
    member = nodes.select("rep", F.explode("bands").alias("key")).join(buckets.select("key"), "key")
    member = member.join(comp.toDF("rep", "comp"), "rep", "left").select("key", "rep", F.coalesce("comp", "rep").alias("comp"))
    all_members = member = common.save(member, "members")
    mixed = member.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "comp")).alias("most"), F.sum("n").alias("size"), F.count("*").alias("comps")).where("comps > 1")
    # pairs inside a bucket's largest component aren't needed: its blocks (the first ones) meet those of the rest only
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = common.save(mixed.select("key", F.col("most.comp").alias("main"), blocks(F.col("most.n")).alias("mains"), blocks(F.col("size") - F.col("most.n")).alias("others")), "mixed")
    member = common.save(member.join(mixed, "key"), "mixed-members")
    sets = _sets(member.select(F.col("rep").alias("doc_id")).distinct(), docs)
    in_main = F.col("comp") == F.col("main")
    of = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    row = member.withColumn("mine", F.when(in_main, of(F.col("mains"))).otherwise(F.col("mains") + of(F.col("others"))))
    row = row.join(sets.withColumnRenamed("doc_id", "rep"), "rep").join(nodes.select("rep", "bands"), "rep")
    met = F.explode(F.sequence(F.when(in_main, F.col("mains")).otherwise(0), F.col("mains") + F.col("others") - 1))
    row = row.select("key", "rep", "comp", "s", "w", "bands", "mine", met.alias("met")).withColumn("i", F.least("mine", "met")).withColumn("j", F.greatest("mine", "met"))

    def look(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        padded = lambda x: np.concatenate([x, np.full(2 * BANDS - len(x), x[0])])
        side = lambda p: {"rep": p["rep"].to_numpy(), "comp": p["comp"].to_numpy(), "bands": np.stack([padded(x) for x in p["bands"]]), **dict(zip("sw", zip(*map(read_set, p["s"], p["w"]), strict=True), strict=True))}
        x, y = pdf[pdf["mine"] == i], pdf[pdf["mine"] == j]
        out = links_between(int(pdf["key"].iloc[0]), side(x), side(y), i == j) if len(x) and len(y) else []
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    found = common.save(row.select("key", "i", "j", "mine", "rep", "comp", "s", "w", "bands").groupBy("key", "i", "j").applyInPandas(look, "a long, b long").distinct(), "rest")
    for used in (all_members, mixed, member, sets):
        common.discard(used)
    return found


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (the smallest id of its group), n_shingles."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    table = signed(docs)
    some = table.where("n > 0 and doc_id is not null")
    nodes = common.save(some.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.first("heavy").alias("heavy")), "nodes")

    # which leader a bucket takes depends on its key, by three orders of the ids
    placed = nodes.select("rep", F.explode("bands").alias("key"))
    order = F.xxhash64(F.col("rep"), F.pmod("key", F.lit(3)))
    buckets = placed.groupBy("key").agg(F.min(F.struct(order.alias("o"), "rep")).alias("leader"), F.count("*").alias("size")).where("size > 1")
    buckets = common.save(buckets.select("key", F.col("leader.rep").alias("leader")), "buckets")
    star = placed.join(buckets, "key").where("rep <> leader").select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()
    pairs = common.save(_agree(star, nodes), "pairs")
    links = _verified(pairs, docs)
    comp = components(links)
    more = _rest(nodes, buckets, comp, docs)
    if more.limit(1).count():
        comp = components(links.unionByName(more))
    for used in (buckets, pairs, links, more):
        common.discard(used)

    whole = nodes.select("h1", "h2", "rep")
    named = table.select("doc_id", "h1", "h2", "n").join(whole, ["h1", "h2"], "left")
    named = named.join(comp.toDF("rep", "comp"), "rep", "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("comp", "rep"))
    return named.select("doc_id", own.alias("class_id"), F.col("n").cast("long").alias("n_shingles"))
