import math
import random
import re
from collections import Counter

import numpy as np
import pytest

import oracle
from scholia.llm import queries, seeded_join

SMALL = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, top=10):
    """The contract, in plain Python."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c in held:
            m = 10 + (90 * c.total() * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


def made(seed, n=300):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(200)]
    weight = [1 / (k + 1) for k in range(200)]
    text = lambda size: " ".join(rnd.choices(words, weight, k=size))
    docs = [(k, text(rnd.randrange(1, 120))) for k in range(n)]
    docs += [(1000 + k, docs[0][1].upper()) for k in range(150)]  # a third are copies
    items = [(k, text(rnd.randrange(1, 40))) for k in range(25)] + [(100, docs[0][1]), (101, "w199 W199 nowhere"), (102, "nowhere at all")]
    return docs, items


@pytest.mark.parametrize(("seed", "cells", "shard_terms"), [(1, 4 << 20, 1_000_000), (2, 500, 1_000_000), (3, 4 << 20, 100)])
def test_ranks_are_those_of_brute_force(spark, monkeypatch, seed, cells, shard_terms):
    monkeypatch.setattr(seeded_join, "SHARD_TERMS", shard_terms)
    docs, items = made(seed)
    docs += [(None, "w1 w5 w9"), (None, "w1 w5 w9"), (2000, None), (2001, ""), (2002, " !! "), (5, "w7 w7 w8"), (5, "w7 w7 w8"), (2003, "é w3 é"), (2004, "w4 " * 20000 + "x" * 100)]
    items += [(None, "w2 w3"), (7, "w1 é"), (7, "w1 é"), (8, None), (9, "")]
    got = seeded_join.rank(spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, rank int"), spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, score int"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items)


def test_join_in_small_blocks(monkeypatch):
    """The blocks of the join, without Spark: any size of the table gives the same rows."""
    rnd = np.random.default_rng(0)
    known = seeded_join.Weights(100, 5000, rnd.integers(0, 3000, 40))
    items = seeded_join.Items([1, 2, 3], np.array([0, 3, 5, 7, 9, 3, 4, 11, 12]), np.array([0, 3, 6, 9]), {})
    size = rnd.integers(0, 9, 100)
    term = np.concatenate([rnd.choice(40, k, replace=False) for k in size])
    impact = rnd.integers(1, 1000, len(term))
    most = np.zeros(40, np.int64)
    np.maximum.at(most, term, impact)
    found = []
    for cells in (1, 50, 1 << 20):
        monkeypatch.setattr(seeded_join, "CELLS", cells)
        join, best = seeded_join.Join(items, known, most, np.zeros(3, np.int64), 4), seeded_join._Best(4, np.zeros(3, np.int64))
        join._block(best, np.arange(100), np.zeros(100, bool), term, impact, size)
        found.append(sorted(zip(*(x.tolist() for x in best.all()), strict=True)))
    assert found[0] == found[1] == found[2] and len(found[0]) == 12


def test_pruned_terms_cannot_reach_the_threshold(spark):
    docs, items = made(4)
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    (own,) = seeded_join.shards_of(items)
    rows = seeded_join.counted(docs, own.place)
    known = seeded_join.weights(rows, len(own.place))
    best = seeded_join.stored(rows, known, 10).toPandas()
    each = {}
    for b in rows.toArrow().to_batches():
        for term, impact in zip(*(x.tolist() for x in known.postings(b)[:2]), strict=True):
            each.setdefault(term, []).append(impact)
    for t, own_best in best.groupby("term")["impact"]:
        assert sorted(own_best, reverse=True) == sorted(each[t], reverse=True)[:10]
    most = np.array([max(each.get(t, [0])) for t in range(len(own.place))])
    join = seeded_join.Join(own, known, most, np.full(len(own.ids), 2_000_000), 10)
    assert sum(map(len, join.pruned)) > 0
    for k, pruned in enumerate(join.pruned):
        assert join.rest[k] == most[pruned].sum() < 2_000_000


def test_long_texts_are_counted_whole(monkeypatch):
    rnd = random.Random(6)
    text = " ".join("".join(rnd.choice("aBé") for _ in range(rnd.randrange(1, 30))) for _ in range(4000))
    whole = Counter(x.encode() for x in terms(text))
    for step in (1, 7, 1000, 1 << 20):
        monkeypatch.setattr(seeded_join, "STEP_BYTES", step)
        assert seeded_join.count_terms(text) == whole


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert seeded_join.rank(docs.limit(0), items).count() == 0
    assert seeded_join.rank(docs, items.limit(0)).count() == 0
    assert seeded_join.rank(docs, items).count() == 1


def test_rows_of_the_sql(spark):
    assert oracle.differences(queries.op11_ranked_search(spark, SMALL), oracle.connect(SMALL), queries.oracle_sql()["op11_ranked_search"]) == ""
