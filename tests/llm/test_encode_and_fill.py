import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import oracle
from scholia.llm import bpe_automaton, middle_fill, queries, tokens

SMALL = "/root/testdata/sf0.001"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


@pytest.fixture(scope="module")
def measure():
    return Tokenizer.from_file(tokens.default_path())


# --- BPE by automaton ---------------------------------------------------------------------------------


def ids_of(text):
    return np.frombuffer(bpe_automaton.automaton().encode(text), np.int32).tolist()


@pytest.mark.parametrize(
    "letters",
    ["abcdefghijklmnopqrstuvwxyz '", "aet hino", "0123456789 .,", "éàß日本語 \n\t ", "ab<|endoftext|> ", "\x1c\x1d\x85\xa0 　 x", "ÃÂ\x80 a", "-=_*#/\\ \n", "՘֋Ᲊ\U00010d40\U00011de0 a1 "],
)
def test_ids_are_those_of_the_library(measure, letters):
    rnd = random.Random(len(letters))
    for _ in range(600):
        t = "".join(rnd.choice(letters) for _ in range(rnd.randrange(40)))
        assert ids_of(t) == measure.encode(t, add_special_tokens=False).ids


def test_any_characters(measure):
    rnd = random.Random(5)
    for _ in range(600):
        t = "".join(chr(rnd.choice([rnd.randrange(0xD800), rnd.randrange(0xE000, 0x110000)])) for _ in range(20))
        assert ids_of(t) == measure.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 1_200_000, "x" + "\n" * 300_000, "a" * 100_000, "ab" * 50_000, "=" * 100_000, "日" * 30_000])
def test_words_of_any_length(measure, text):
    assert ids_of(text) == measure.encode(text, add_special_tokens=False).ids


def test_states_accept_what_bpe_gives_and_nothing_else():
    """On a small vocabulary: a sequence of labels is a path if and only if BPE gives it for its text."""
    merges = [("a", "a"), ("a", "b"), ("aa", "b"), ("b", "a"), ("aab", "ba"), ("ab", "a"), ("b", "b")]
    own = object.__new__(bpe_automaton.Automaton)
    texts = [bytes([k]) for k in range(256)] + [(a + b).encode() for a, b in merges]
    own.labels = texts
    at = {t: k for k, t in enumerate(texts)}
    own._compile([(at[a.encode()], at[b.encode()]) for a, b in merges], [at[(a + b).encode()] for a, b in merges])

    def bpe(raw):
        parts = [bytes([c]) for c in raw]
        for a, b in merges:
            a, b, k, out = a.encode(), b.encode(), 0, []
            while k < len(parts):
                both = parts[k] == a and parts[k + 1 : k + 2] == [b]
                out.append(a + b if both else parts[k])
                k += 2 if both else 1
            parts = out
        return [at[p] for p in parts]

    used = [at[x] for x in {b"a", b"b", *((a + b).encode() for a, b in merges)}]
    paths = [()]
    for _ in range(4):
        for path in list(paths):
            for y in used:
                state = own.state[path[-1]] if path else 0
                valid = bpe(b"".join(texts[k] for k in (*path, y))) == [*path, y]
                assert own.live(state, y) == valid, [texts[k] for k in (*path, y)]
                if valid and len(path) < 3:
                    paths.append((*path, y))
    rnd = random.Random(2)
    for _ in range(3000):
        raw = bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(1, 14)))
        assert own.word(raw) == bpe(raw)


def test_digests_of_documents(spark, measure):
    rows = {r["doc_id"]: r for r in queries.op12_bpe(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = measure.encode(d["text"] or "", add_special_tokens=False).ids
        r = rows[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(measure.decode(ids, skip_special_tokens=False)))


def test_odd_rows_and_columns_of_encoding(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "x<|endoftext|>y", None), (3, "x<|endoftext|>y", None), (None, "né", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded_ string")
    coded = bpe_automaton.encode(docs)
    assert coded.columns == ["doc_id", "text", "decoded_", "ids"]
    back = bpe_automaton.decode(coded).collect()
    assert sorted(((r["doc_id"] or 0, r["decoded"], r["decoded_"] or "") for r in back)) == sorted((i or 0, t or "", c or "") for i, t, c in rows)
    odd = spark.createDataFrame([([195],), (None,), ([],), ([64, 195, 64],)], "ids array<int>")
    measured = Tokenizer.from_file(tokens.default_path())
    assert [r["decoded"] for r in bpe_automaton.decode(odd).collect()] == [measured.decode(x, skip_special_tokens=False) for x in ([195], [], [], [64, 195, 64])]
    assert bpe_automaton.digests(docs.limit(0)).count() == 0
    assert {r["ids_sha256"] for r in bpe_automaton.digests(docs).where("doc_id < 3").collect()} == {sha("")}
    with pytest.raises(ValueError, match="already"):
        bpe_automaton.encode(docs, ids_col="text")


# --- fill in the middle -------------------------------------------------------------------------------


def filled(doc_id, text):
    """The contract, in plain Python."""
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_rows_of_the_sql(spark):
    assert oracle.differences(queries.op13_fill_in_middle(spark, SMALL), oracle.connect(SMALL), queries.oracle_sql()["op13_fill_in_middle"]) == ""


def test_filled_documents_by_hand(spark, monkeypatch):
    monkeypatch.setattr(middle_fill, "STEP_BYTES", 1000)
    rnd = random.Random(1)
    rows = [(k, "".join(rnd.choice("aB é日<>PSM\n\x00😀 ") for _ in range(rnd.randrange(60))), "x") for k in range(300)]
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, "a<M>b", None), (None, "no id", "x"), (7, "same id", "x"), (7, "same id", "x"), (1003, "word " * 40000, "x"), (1004, "." * 60000, "x"), (1005, "<P", "x"), (1006, ">" * 9, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k string")
    out = middle_fill.restore(middle_fill.transform(docs)).collect()
    assert len(out) == len(rows) and out[0].asDict().keys() == {"doc_id", "text", "k", "n", "form", "prefix_chars", "middle_chars", "output", "restored"}
    for r in out:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == filled(r["doc_id"], r["text"])
        assert r["restored"] == (r["text"] or "")
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}
    digest = middle_fill.digests(docs).where(F.col("doc_id") == 1003).first()
    assert digest["output_sha256"] == sha(filled(1003, rows[-4][1])[4]) and digest["restored_sha256"] == sha(rows[-4][1])
    assert middle_fill.digests(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="already"):
        middle_fill.transform(docs.withColumn("FORM", F.lit(1)))
