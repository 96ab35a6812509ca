import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scholia.llm import bm25_wand, common, dom, hilbert_ann, probminhash, wrapper

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


# --- near duplicates ------------------------------------------------------------------------------


def brute_classes(rows):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t))
    ids, up = sorted(sets), {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(x and y and len(x & y) >= 0.8 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((top(a), top(b)))
                up[q] = p
    return {i: top(i) for i in ids}


def planted(seed=4):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows = []
    for family in range(6):
        base = [rnd.choice(vocabulary) for _ in range(120)]
        for copy in range(40 if family == 0 else 6):
            t = list(base)
            for _ in range(rnd.randrange(0, 12)):  # from exact copies to copies below the threshold
                t[rnd.randrange(len(t))] = rnd.choice(vocabulary)
            rows.append((len(rows), " ".join(t).upper() if copy % 2 else " ".join(t)))
    for _ in range(40):
        rows.append((len(rows), " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 90)))))
    return rows


@pytest.mark.parametrize("block", [probminhash.BLOCK, 8])
def test_classes_are_those_of_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(probminhash, "BLOCK", block)
    rows = [*planted(), (None, "a b c d e f"), (900, None), (901, ""), (902, " !! "), (903, "one two"), (904, "ONE, two!"), (905, "two one"), (906, "x " * 20000), (907, "x " * 9000), (5, planted()[5][1])]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, class_id string")
    got = probminhash.classes(docs).collect()
    want = brute_classes(rows)
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None} == want
    assert [r["class_id"] for r in got if r["doc_id"] is None] == [None]
    assert want[904] == 903 and want[901] == 901 and want[907] == 906


def test_no_documents(spark):
    assert probminhash.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_copies_that_differ_in_how_often_a_line_repeats(spark):
    rows = []
    for k in range(40):
        text, line = " ".join(f"w{k}x{i}" for i in range(60)), " ".join(f"l{k}x{i}" for i in range(10))
        rows += [(2 * k, f"{text} {line}"), (2 * k + 1, f"{text} " + f"{line} " * 200)]
        assert len(shingles(rows[-2][1]) & shingles(rows[-1][1])) > 0.9 * len(shingles(rows[-2][1]) | shingles(rows[-1][1]))
    got = probminhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == {i: i - i % 2 for i, _ in rows}


def test_registers_estimate_probability_jaccard():
    rnd = np.random.default_rng(0)
    h = common.mix(np.arange(1, 400, dtype=np.uint64))
    wa, wb = rnd.integers(0, 4, 399), rnd.integers(0, 4, 399)
    pa_, pb = 1 + np.log(np.maximum(wa, 1)), 1 + np.log(np.maximum(wb, 1))
    both = np.flatnonzero((wa > 0) & (wb > 0))
    # the definition: sum over common d of 1 / sum over d' of max(a'/a, b'/b)
    a, b = np.where(wa > 0, pa_, 0), np.where(wb > 0, pb, 0)
    want = sum(1 / np.maximum(a / a[d], b / b[d]).sum() for d in both)
    ka, kb = np.flatnonzero(wa > 0), np.flatnonzero(wb > 0)
    sig = probminhash.signatures(np.concatenate([np.zeros(len(ka), int), np.ones(len(kb), int)]), np.concatenate([h[ka], h[kb]]), np.concatenate([wa[ka], wb[kb]]), 2, 4000)
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03


def probability_jaccard(a, b):
    """The definition, on counts of shingles."""
    wa, wb = ({k: 1 + np.log(v) for k, v in x.items()} for x in (a, b))
    every = wa.keys() | wb.keys()
    return sum(1 / sum(max(wa.get(e, 0) / wa[d], wb.get(e, 0) / wb[d]) for e in every) for d in wa.keys() & wb.keys())


def counted(t):
    w = words(t)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def test_probability_jaccard_is_the_definition():
    rnd = random.Random(1)
    for _ in range(50):
        a, b = (Counter({k: rnd.randrange(1, 9) for k in rnd.sample(range(30), 12)}) for _ in range(2))
        x, y = (sorted(c) for c in (a, b))
        got = probminhash.probability_jaccard(np.array(x), np.array([1 + np.log(a[k]) for k in x]), np.array(y), np.array([1 + np.log(b[k]) for k in y]))
        assert abs(got - probability_jaccard(a, b)) < 1e-9


def heavy_copies():
    """Texts that repeat the same paragraph, with words of their own beside it: alike by weights, not as sets."""
    rows = []
    for k in range(30):
        para = " ".join(f"p{k}x{i}" for i in range(40))
        for j in range(3):
            rows.append((3 * k + j, f"{para} " * 150 + " ".join(f"o{k}x{j}x{i}" for i in range(12 if j < 2 else 400))))
    return rows


@pytest.mark.parametrize("block", [probminhash.BLOCK, 2])
def test_weighted_copies(spark, monkeypatch, block):
    monkeypatch.setattr(probminhash, "BLOCK", block)
    rows = heavy_copies()
    a, b, c = (t for _, t in rows[:3])
    assert len(shingles(a) & shingles(b)) < 0.8 * len(shingles(a) | shingles(b)) and probability_jaccard(counted(a), counted(b)) > 0.8 > probability_jaccard(counted(a), counted(c))
    got = {r["doc_id"]: r["class_id"] for r in probminhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - 1 if i % 3 == 1 else i for i, _ in rows}


def test_links_of_blocks_by_either_measure():
    """Of one bucket's members, all pairs in blocks give what brute force gives, by sets or by weights."""
    rows = heavy_copies()[:12] + [(100, heavy_copies()[0][1] + " w")]
    sets = [probminhash.weighted(*common.word_hashes(*common.utf8(pa.array([t])))) for _, t in rows]
    side = {"rep": np.array([i for i, _ in rows]), "comp": np.array([i for i, _ in rows]), "bands": np.zeros((len(rows), 2), int), "s": [h for _, h, _ in sets], "w": [1 + np.log(c) for _, _, c in sets]}
    got = probminhash.links_between(0, side, side, True)
    want = {(i, o) for i, t in rows for o, u in rows if i < o and (len(shingles(t) & shingles(u)) >= 0.8 * len(shingles(t) | shingles(u)) or probability_jaccard(counted(t), counted(u)) >= 0.8)}
    assert set(got) <= want and {x for p in got for x in p} == {x for p in want for x in p}


# --- nearest neighbours -----------------------------------------------------------------------------


def test_hilbert_steps_are_single():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = hilbert_ann.hilbert(cells, 3)
    assert sorted(key.tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def brute(ids, v, top, every):
    out = {}
    for i in range(len(ids)):
        if ids[i] % every == 0:
            s = v @ v[i]
            s[ids == ids[i]] = -np.inf
            out[ids[i]] = np.lexsort((ids, -s))[: min(top, (s > -np.inf).sum())], s
    return out


def test_recall_and_exact_scores(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    t = rows.toPandas()
    ids, v = t.vec_id.to_numpy(), np.array(t.embedding.tolist(), float)
    got = hilbert_ann.search(rows).toPandas()
    hit = total = 0
    for q, (best, s) in brute(ids, v, 20, 20).items():
        g = got[got.query_id == q].sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and (g.sort_values(["score", "vec_id"], ascending=[False, True]).vec_id.tolist() == g.vec_id.tolist())
        assert np.allclose(g.score, s[[np.flatnonzero(ids == x)[0] for x in g.vec_id]], atol=1e-12)
        hit, total = hit + len(set(ids[best]) & set(g.vec_id)), total + 20
    assert hit / total >= 0.9


def test_copies_ties_and_odd_vectors(spark):
    rnd = np.random.default_rng(3)
    rows = [(k, [1.0, 2.0, 0.0, 0.5]) for k in range(60)] + [(100 + k, rnd.normal(size=4).tolist()) for k in range(45)]
    odd = [(200, None), (201, [0.0] * 4), (202, [1.0, None, 0.0, 0.0]), (203, [1.0, float("nan"), 0.0, 0.0]), (204, [float("inf"), 0.0, 0.0, 0.0]), (205, [1.0, 2.0]), (206, []), (None, [1.0, 1.0, 1.0, 1.0]), (40, [1.0, 2.0, 0.0, 0.5])]
    df = spark.createDataFrame([(*r, 7) for r in rows + odd], "vec_id long, embedding array<double>, score int")
    got = hilbert_ann.search(df, recall=1.0).toPandas()
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    for q, (best, s) in brute(ids, v, 20, 20).items():
        g = got[got.query_id == q].sort_values("rank")
        if q < 60:
            own = [k for k in range(60) if k != q][:20]
            better = [i for i in ids[best] if s[np.flatnonzero(ids == i)[0]] > v[0] @ v[0] + 1e-9]
            assert g.vec_id.tolist() == (better + own)[:20]
        assert np.allclose(np.sort(g.score)[::-1], np.sort(s[best])[::-1])
    assert not set(got.vec_id) & set(range(200, 207)) and set(got.query_id) == {i for i in ids if i % 20 == 0}


def test_few_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert hilbert_ann.search(spark.createDataFrame([], schema)).count() == 0
    assert hilbert_ann.search(spark.createDataFrame([(20, [1.0, 0.0])], schema)).count() == 0
    got = hilbert_ann.search(spark.createDataFrame([(20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], schema)).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in sorted(got)] == [(20, 1, 1, 0.5), (20, 2, 2, -1.0)]


# --- decontamination --------------------------------------------------------------------------------


def test_wand_finds_all_that_brute_force_finds():
    rnd = random.Random(5)
    vocabulary = [f"t{int(rnd.paretovariate(0.7)) % 400}" for _ in range(4000)]
    items = [(k, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 40)))) for k in range(90)]
    index = bm25_wand.Index([*items, (1000, None), (1001, " !! ")])
    assert len(index.items) == 90
    win, term, texts = [], [], []
    for w in range(60):
        near = items[rnd.randrange(90)][1].split()
        texts.append({*near[: rnd.randrange(len(near) + 1)], *(rnd.choice(vocabulary) for _ in range(30))})
        known = np.unique(np.searchsorted(index.vocabulary, np.sort(common.hash_words(sorted(texts[-1])))[np.isin(np.sort(common.hash_words(sorted(texts[-1]))), index.vocabulary)]))
        win += [w] * len(known)
        term += known.tolist()
    for dense in (bm25_wand.DENSE, 200):
        bm25_wand.DENSE, kept = dense, bm25_wand.DENSE
        got = {(int(w), index.items[i]): s for w, i, s in zip(*index.wand(np.array(win), np.array(term), 0.3), strict=True)}
        bm25_wand.DENSE = kept
        sizes = [len(t.split()) for _, t in items]
        df = {x: sum(x in t.split() for _, t in items) for x in set(vocabulary)}
        want = {}
        for w, seen in enumerate(texts):
            for (k, t), n in zip(items, sizes, strict=True):
                impact = {x: t.split().count(x) * 2.2 / (t.split().count(x) + 1.2 * (0.25 + 0.75 * n / np.mean(sizes))) * np.log(1 + (90 - df[x] + 0.5) / (df[x] + 0.5)) for x in set(t.split())}
                s = sum(v for x, v in impact.items() if x in seen) / sum(impact.values())
                if s >= 0.3:
                    want[w, k] = s
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_contamination_by_hand(spark):
    items = [(1, "What is the capital city of the northern province today? It is the old town by the river bend."), (2, "short item"), (3, None), (4, "alpha beta gamma delta epsilon zeta eta theta. Answer: iota kappa lambda mu nu xi")]
    q = words(items[0][1])
    filler = " ".join(f"f{k}" for k in range(400))
    rows = [
        (10, filler + " " + items[0][1].upper() + " " + filler), (11, " ".join(q[:10]) + " " + filler), (12, filler), (13, None), (14, ""), (15, "a SHORT, item!"), (16, "item short"),
        (17, "x " + " ".join(words(items[3][1])[:9]) + " y"), (18, items[3][1].replace("gamma", "GAMMA,\n")), (10, items[0][1]), (19, " ".join(q[:8] + ["changed"] + q[9:])),
    ]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id int")
    got = {(r["doc_id"], r["item_id"]) for r in bm25_wand.contaminated(docs, spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, score int")).collect()}
    assert got == {(10, 1), (15, 2), (18, 4), (19, 1)}
    none = spark.createDataFrame([], "item_id long, text string")
    assert bm25_wand.contaminated(docs, none).count() == 0 and bm25_wand.contaminated(docs.limit(0), none.union(spark.createDataFrame([(1, "a b")], "item_id long, text string"))).count() == 0


def test_long_quotations_of_items_without_an_answer(spark):
    """Which part is the answer isn't known: 37 of 50 words in one run are a hit, the first half alone isn't; with a mark both parts must be there."""
    item = [f"q{k}" for k in range(50)]
    filler = " ".join(f"f{k}" for k in range(300))
    items = [(1, " ".join(item)), (2, " ".join(f"m{k}" for k in range(40)) + " Answer: " + " ".join(f"a{k}" for k in range(10)))]
    rows = [(1, " ".join(item[:37])), (2, " ".join(item[13:])), (3, " ".join(item[:25])), (4, " ".join(f"m{k}" for k in range(40))), (5, items[1][1])]
    docs = spark.createDataFrame([(k, f"{filler} {t} {filler}") for k, t in rows], "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in bm25_wand.contaminated(docs, items).collect()} == {(1, 1), (2, 1), (5, 2)}
    assert sorted(r["doc_id"] for r in bm25_wand.clean(docs, items).collect()) == [3, 4]


def test_shards_give_the_same(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    a = {(r["doc_id"], r["item_id"]) for r in bm25_wand.contaminated(docs, items).collect()}
    monkeypatch.setattr(bm25_wand, "SHARD", 15)
    assert {(r["doc_id"], r["item_id"]) for r in bm25_wand.contaminated(docs, items).collect()} == a
    assert {(d["doc_id"], i["item_id"]) for d in docs.collect() for i in items.collect() if i["text"] in d["text"]} <= a


def test_a_long_item_changes_nothing_of_others(spark):
    docs, items = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    a = {(r["doc_id"], r["item_id"]): (r["question_overlap"], r["answer_overlap"]) for r in bm25_wand.contaminated(docs, items).collect()}
    text = docs.where("doc_id = 3").first()["text"]
    long = spark.createDataFrame([(10**6, " ".join(f"{text} w{k}" for k in range(400)))], "item_id long, text string")
    b = {(r["doc_id"], r["item_id"]): (r["question_overlap"], r["answer_overlap"]) for r in bm25_wand.contaminated(docs, items.select("item_id", "text").unionByName(long)).where("item_id < 1000000").collect()}
    assert a and a == b


def test_shards_score_alike(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text")
    items = items.unionByName(spark.createDataFrame([(None, "one two three four five six seven"), (None, "eight nine ten eleven twelve thirteen"), (7, None)], items.schema))
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6, "x y " * 100_000 + "eight nine ten eleven twelve thirteen " + "z " * 100_000), (None, "one two three four five six seven")], "doc_id long, text string"))
    rows = lambda: sorted(((r["doc_id"] or 0, r["item_id"] or 0, round(r["score"], 9)) for r in bm25_wand.contaminated(docs, items).collect()))
    a = rows()
    assert {(10**6, 0), (0, 0)} <= {x[:2] for x in a}
    monkeypatch.setattr(bm25_wand, "SHARD_WORDS", 300)
    assert rows() == a


# --- main text ----------------------------------------------------------------------------------------

PAGE = """<!doctype html><html><head><title>T</title><style>x{{}}</style></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div id=wrap><div class="{cls}"><h2>{title}</h2>
<p>First &amp; second&nbsp;<b>bold</b><br>line {n}.<p>Next paragraph {n} &#228; &copy<ul><li>One<li>Two {n}</ul><table><tr><td>a<td>b {n}</table></div><div>Sign up for our letter</div>
<aside>Side {n}</aside><div class="reader-comments"><p>Nice {n}!</p></div><form><input name=q><button>Go</button></form><script>var a = "</p>";</script></div><footer>&copy; us {n}</footer></body></html>"""


def test_page_by_hand(spark):
    rows = [(k, f"http://h.example/{k}", PAGE.format(cls="post-body" if k < 8 else "c17", title=f"Title {k}", n=k)) for k in range(12)]
    rows += [(50, None, None), (51, "http://h.example/51", ""), (52, "x", "plain text\n only"), (53, "http://one.example/", "<article><p>Solo<p>page</article><p>after"), (0, rows[0][1], rows[0][2]), (54, "http://big.example/", "<p>" + "long word " * 60000)]
    got = {r["page_id"]: r for r in wrapper.extract(spark.createDataFrame([(*r, 3) for r in rows], "page_id long, url string, html string, text int")).collect()}
    for k in range(12):
        want = [f"Title {k}", f"First & second bold line {k}.", f"Next paragraph {k} ä ©", "One", f"Two {k}", f"a b {k}"]
        assert got[k]["text"] == "\n\n".join(want), k
        assert got[k]["n_chars"] == len(got[k]["text"])
    assert [got[k]["text"] for k in (50, 51, 52, 53)] == ["", "", "plain text only", "Solo\n\npage"]
    assert got[54]["n_chars"] == len(("long word " * 60000).strip())
    assert wrapper.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("page, want", [
    (f"<div class=text>{'a' * 60}</div><div class=text>{'b' * 40}</div>", ["a" * 60, "b" * 40]),
    (f"<h1>T</h1><div class=post-body>{'a' * 60}</div><p>tail", ["T", "a" * 60, "tail"]),
    (f"<article>{'a' * 90}</article><article>short</article>", ["a" * 90, "short"]),
    ("<p>out<main><h1>Title</h1><article><p>one</article><p>two</main>", ["Title", "one", "two"]),
])
def test_all_content_regions_stay(page, want):
    assert wrapper.aligned(page, None)[0] == want


BODY = "<div class=post-body><p>the body</div>"


@pytest.mark.parametrize("page, want", [
    *((f'<div class="{c}">{BODY}</div>', ["the body"]) for c in ("layout has-sidebar", "no-sidebar", "search", "legal", "share", "with-header")),
    (f"<div class=post-header><h1>Title</h1></div>{BODY}", ["Title", "the body"]),
    ("<form><article><p>one</article><input></form>", ["one"]),
    ("<form id=aspnetForm><p>all of it</form>", ["all of it"]),
    ("<h2>References</h2><ul><li><a href=1>A book</a><li><a href=2>Another</a></ul>", ["References", "A book", "Another"]),
    ("<div class=notice><p>nothing but this</div>", ["nothing but this"]),
    (f"<div class=comments><div class=text>me too</div></div><div class=sidebar>side</div><form>Search</form>{BODY}<div><a href=1>More like this</a></div>", ["the body"]),
])
def test_wrappers_of_content_stay(page, want):
    assert wrapper.aligned(page, None)[0] == want


def test_blank_pages_are_no_reference(spark):
    rows = [(k, f"<div class=k1><p>Always here</div><p>Page {k}" if k < 8 else None if k % 2 else " \n", f"Page {k}" if k < 8 else "") for k in range(200)]
    pages = spark.createDataFrame([(k, f"http://hot.example/{k}", t) for k, t, _ in rows], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in wrapper.extract(pages).collect()} == {k: w for k, _, w in rows}


def test_references_may_be_joined_instead_of_sent(spark, monkeypatch):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    a = {r["page_id"]: r["text"] for r in wrapper.extract(pages).collect()}
    monkeypatch.setattr(wrapper, "SENT_HOSTS", 1)
    assert {r["page_id"]: r["text"] for r in wrapper.extract(pages).collect()} == a


PLAIN = """<body><div class=k1><ul><li><a href=1>Start</a><li><a href=2>Contact us</a></ul></div><table><tr><td class=q><h1>{t}</h1><p>{a}<p>{b}</td></tr></table>
<div class=k2>You read this because we are read by all.</div><div class=k3><a href=3>{x}</a> <a href=4>{y}</a></div><div class=k4><p>All rights are ours</div></body>"""
ERROR = "<body><center><hr><tt>Not here</tt><blockquote>{a}</blockquote><blockquote>Go back to the start.</blockquote></center></body>"


def plain_pages(spark, n=40):
    rnd = random.Random(6)
    say = lambda k: " ".join(rnd.choice(["one", "two", "three", "four", "five", "six"]) for _ in range(k))
    rows, want = [], {}
    for k in range(n):
        v = {"t": say(4), "a": say(30), "b": say(20), "x": say(3), "y": say(3)}
        if k % 3 == 0:
            rows.append((k, "http://plain.example/", ERROR.format(a=v["a"])))
            want[k] = v["a"]
        else:
            rows.append((k, "http://plain.example/", PLAIN.format(**v)))
            want[k] = "\n\n".join((v["t"], v["a"], v["b"]))
    return spark.createDataFrame(rows, "page_id long, url string, html string"), want


@pytest.mark.parametrize("sent", [True, False])
def test_the_template_decides_without_marks(spark, monkeypatch, sent):
    """No article element, no telling names, two layouts on one host: constant nodes and menus go, varying slots stay."""
    if not sent:
        monkeypatch.setattr(wrapper, "SENT_HOSTS", 0)
        monkeypatch.setattr(wrapper, "HOST_PAGES", 7)
        monkeypatch.setattr(wrapper, "SENT_TEMPLATES", 0)
    pages, want = plain_pages(spark)
    assert {r["page_id"]: r["text"] for r in wrapper.extract(pages).collect()} == want
    without = {r["page_id"]: r["text"] for r in wrapper.extract(pages, template=False).collect()}
    assert all("All rights are ours" in without[k] and "Contact us" in without[k] for k in want if k % 3)


def test_constant_lines_of_articles_need_more_pages(spark):
    page = "<article><h1>Title {k}</h1><p>Text of page {k}.<p>Written for you by our staff</article>"
    for n, gone in ((10, False), (wrapper.MARKED_PAGES + 1, True)):
        pages = spark.createDataFrame([(k, "http://a.example/", page.format(k=k)) for k in range(n)] + [(100, "http://b.example/", page.format(k=1))] * 30, "page_id long, url string, html string")
        got = wrapper.extract(pages).toPandas()
        assert (got.loc[got.page_id < 100, "text"].str.contains("staff") == (not gone)).all()
        assert got.loc[got.page_id == 100, "text"].str.contains("staff").all()  # copies tell nothing


def test_class_words_alone_take_nothing_out_of_an_article():
    page = """<nav><a href=1>Home</a></nav><article><h1>T</h1><p>Intro.</p><section class="discussion"><h2>Discussion</h2><p>We discuss.</p></section><div class="social-history"><p>The past.</p></div>
    <p class="legal">By law.</p><p class="search">A search.</p><div class="rail follow"><p>The rail.</p></div><section class="related-work"><p>Others.</p></section><div class="header"><p>Head.</p></div>
    <div class="share-bar"><a href=2>Tell a friend</a> <a href=3>Print</a></div><div class="ad">Buy now</div><div class="comments"><p>me too</p></div><p class="cookie-notice">We use some.</p><aside>Aside</aside><p>End.</p></article>"""
    assert wrapper.aligned(page, None)[0] == ["T", "Intro.", "Discussion", "We discuss.", "The past.", "By law.", "A search.", "The rail.", "Others.", "Head.", "End."]


def test_the_template_alone_changes_pages_of_the_tables_layout(spark):
    """The given pages on one host, with a line in each article that no mark tells from the others: only the template can."""
    rows = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    line = "<div>Written by our staff, all of them</div>"
    pages = spark.createDataFrame([(r["page_id"], "http://hot.example/", r["html"].replace("</h1>", "</h1>" + line)) for r in rows], "page_id long, url string, html string")
    want = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(rows)).collect()}
    assert {r["page_id"]: r["text"] for r in wrapper.extract(pages).collect()} == want
    assert all("our staff" in r["text"] for r in wrapper.extract(pages, template=False).collect())


def test_deep_and_long_pages_are_read_in_linear_time():
    import time

    for page in ('<div class="content">' * 20_000 + "x", "<article>" * 5000 + "<header>" * 5000, "<p>a<br>b</p></x>" * 20_000, "<main></main><div>" * 8000, "<ul><li>" * 8000 + "y"):
        began = time.perf_counter()
        wrapper.aligned(page, None)
        assert time.perf_counter() - began < 3


def test_articles_of_the_tables(spark):
    import html

    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in wrapper.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert got[r["page_id"]] == "\n\n".join(b for b in blocks if b)


def test_tree_matching_is_maximal():
    def tree(spec, up=None):
        n = dom.Node(spec[0], {}, up)
        for s in spec[1:]:
            n.kids.append(tree(s, n))
        return n

    def best(a, b):
        if a.label != b.label:
            return 0
        t = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
        for i, x in enumerate(a.kids):
            for j, y in enumerate(b.kids):
                t[i + 1][j + 1] = max(t[i][j + 1], t[i + 1][j], t[i][j] + best(x, y))
        return 1 + t[-1][-1]

    rnd = random.Random(8)
    grow = lambda depth: [rnd.choice("ab"), *(grow(depth - 1) for _ in range(rnd.randrange(0, 4 if depth else 1)))]
    for _ in range(200):
        a, b = tree(["r", *(grow(3) for _ in range(3))]), tree(["r", *(grow(3) for _ in range(3))])
        dom.number(a), dom.number(b)
        assert len(dom.match(a, b)) == best(a, b)
