import random

import pytest
from pyspark.sql import functions as F

from scholia.operators import simhash


def greedy(hashes, distance=3):
    kept, out = [], set()
    for i, h in hashes:
        near = [j for j, g in kept if ((h ^ g) & (2**64 - 1)).bit_count() <= distance]
        if near:
            out.add((i, near[0]))
        else:
            kept.append((i, h))
    return out


def clouds(n, seed=1):
    """Hashes around a few centres, so that many are near, many share bands and few are alike."""
    rnd = random.Random(seed)
    centres = [rnd.getrandbits(64) for _ in range(4)]
    out = {}
    for k in range(n):
        h = rnd.choice(centres)
        for _ in range(rnd.randrange(9)):
            h ^= 1 << rnd.randrange(64)
        out.setdefault(h - (1 << 64 if h >> 63 else 0), k)
    return sorted((k, h) for h, k in out.items())


@pytest.mark.parametrize("distance", [1, 3])
def test_bands_lose_no_pair(spark, distance):
    rows = clouds(500)
    want = {(i, o) for i, h in rows for o, g in rows if o < i and ((h ^ g) & (2**64 - 1)).bit_count() <= distance}
    df = spark.createDataFrame(rows, "id long, h long")
    for hot in (1000, 3):
        assert {tuple(r) for r in simhash.near_pairs(df, df, distance, hot).collect()} == want


def test_blocks_give_the_greedy_rows(spark, monkeypatch):
    rows = clouds(700, 2)
    monkeypatch.setattr(simhash, "FIRST", 60)
    monkeypatch.setattr(simhash, "hashed", lambda df, key, column: df)
    copies = [(10_000 + k, rows[k][1]) for k in range(50)] + [(3, rows[3][1])]
    got = simhash.duplicates(spark.createDataFrame(rows + copies, "id long, h long"), "id", "h").collect()
    assert {tuple(r) for r in got} == greedy(sorted({*rows, *copies})) and len(got) == len(set(got))


def mixed_pairs(n, seed, ordered):
    rnd = random.Random(seed)
    names = list(range(n))
    if not ordered:
        rnd.shuffle(names)
    pairs = {(max(names[k], names[k + 1]), min(names[k], names[k + 1])) for k in range(n - 1)}
    return sorted(pairs)


def first_independent(pairs):
    near = {}
    for i, o in pairs:
        near.setdefault(i, []).append(o)
    gone = set()
    for i in sorted(near):
        if any(o not in gone for o in near[i]):
            gone.add(i)
    return gone


@pytest.mark.parametrize(("ordered", "rounds", "most"), [(False, 20, 1000), (True, 2, 1000)])
def test_long_chains_are_decided_in_parts(spark, ordered, rounds, most):
    """By rounds where ids are in no order; in blocks of bounded size where each item hangs on the one before it."""
    pairs = mixed_pairs(4000, 5, ordered)
    df = spark.createDataFrame(pairs, "id long, o long")
    assert {r["id"] for r in simhash.dropped_of(df, rounds, most).collect()} == first_independent(pairs)


def test_a_chain_of_a_hundred_thousand(spark):
    n = 100_000
    names = F.pmod(F.col("k") * 48271 + 11, F.lit(n)).alias("a"), F.pmod((F.col("k") + 1) * 48271 + 11, F.lit(n)).alias("b")
    chain = spark.range(n - 1).withColumnRenamed("id", "k").select(*names).select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("o"))
    gone = simhash.dropped_of(chain)
    assert {r["id"] for r in gone.collect()} == first_independent([tuple(r) for r in chain.collect()])


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.duplicates(empty, "doc_id", "text").count() == 0
    odd = spark.createDataFrame([(1, None), (2, "short"), (None, "a text that is long enough"), (3, "a text that is long enough"), (3, "a text that is long enough"), (4, "A text, that is long enough"), (4, None)], "doc_id long, text string")
    assert {tuple(r) for r in simhash.duplicates(odd, "doc_id", "text").collect()} <= {(4, 3)}
