"""Rules on literal rows, and operators against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from scholia.functions import geometry, text
from scholia.operators import graph, layout, pages, relational, retrieval, review, simhash, storage
from scholia.sources import snapshots
from scholia.streaming import rules


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "s string").select(build(F.col("s")).alias("x")).first()["x"]


def test_normalised(spark):
    assert one(spark, "AB=6，平行四边形 ABCD！\n第 3 题", text.normalised) == "AB6平行四边形ABCD第3题"
    assert one(spark, "A(-3,0)、B(1,0)", text.normalised) == "A30B10"
    assert one(spark, None, text.normalised) == ""


def test_grams(spark):
    assert one(spark, "abcd", lambda c: text.grams(c, 2)) == ["ab", "bc", "cd"]
    assert one(spark, "abcdefg", lambda c: text.grams(c, 3, 2)) == ["abc", "cde", "efg"]
    assert one(spark, "a", lambda c: text.grams(c, 2)) == []


@pytest.mark.parametrize(("count", "lapses", "result", "stages", "want"), [(0, 0, "correct", 5, (1, 0, 3)), (1, 0, "correct", 5, (2, 0, 7)), (3, 0, "correct", 5, (4, 0, 28)), (4, 0, "correct", 5, (5, 0, None)), (5, 0, "correct", 5, (5, 0, None)), (3, 1, "wrong", 5, (0, 2, 1)), (1, 0, "correct", 2, (2, 0, None))])
def test_advance(spark, count, lapses, result, stages, want):
    row = spark.range(1).select(*review.advance(F.lit(count), F.lit(lapses), F.lit(result), F.lit(stages))).first()
    assert tuple(row) == want


def test_scope():
    assert relational.scope(7) == [7, 6, 8, 5, 9]
    assert relational.scope(1) == [1, 2, 3]
    assert relational.scope(12) == [12, 11, 10]
    assert relational.scope(13) == []


def test_guarded_delete(spark):
    df = spark.range(10)
    assert relational.guarded_delete(df, F.col("id") < 3).count() == 7
    assert relational.guarded_delete(df, F.col("id") < 8).count() == 10
    assert relational.guarded_delete(df, F.col("id") < 99).count() == 10


def test_decimal_lines_are_one_object(spark):
    df = spark.createDataFrame([(1, "1.18 2.5\n2.5 3.6"), (2, "1. a\n2. b\n3. c"), (3, "")], "k int, body string")
    n = {r["k"]: r["n"] for r in retrieval.objects(df, "k", "body").groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert n == {1: 1, 2: 3}


def test_gate_reasons(spark):
    row = lambda total, hit, stem, ask, crosses, has, n: spark.range(1).select(retrieval.gate(*(F.lit(x) for x in (total, hit, stem, ask, crosses, has, n)))).first()[0]
    assert row(2, 2, 10, "same", False, True, 9) == "few_anchors"
    assert row(5, 5, 7000, "same", False, True, 9) == "too_long"
    assert row(5, 5, 10, "conflict", False, True, 9) == "ask_conflict"
    assert row(9, 3, 10, "same", False, True, 9) == "low_hits"
    assert row(7, 3, 10, "unknown", False, True, 9) == "low_hits"
    assert row(7, 3, 10, "same", True, True, 9) == "crosses_boundary"
    assert row(7, 3, 10, "same", False, True, 7) == "no_solution"
    assert row(7, 3, 10, "same", False, True, 8) == ""


def test_two_equal_objects_are_not_unique(spark):
    rows = [(1, 1, "", 3, 0.5, 9), (1, 2, "", 3, 0.5, 8), (2, 1, "", 4, 0.5, 9), (2, 2, "", 3, 0.5, 9), (3, 1, "low_hits", 1, 0.1, 0)]
    got = {r["q"]: (r["reason"], r["exact"]) for r in retrieval.unique(spark.createDataFrame(rows, "q int, object_id int, reason string, hit int, ratio double, solution_chars int"), "q").collect()}
    assert got == {1: ("not_unique", False), 2: ("", True), 3: ("low_hits", False)}


def test_replay_is_the_fold(spark):
    rnd = random.Random(1)
    log = [(i, u, rnd.choice(["correct", "correct", "wrong"])) for i in range(400) for u in [rnd.randrange(12)]]
    df = spark.createDataFrame([(u, i, i, r) for i, u, r in log], "item_id long, event_id long, ts long, result string")
    want = {}
    for _, u, r in log:
        c, l = want.get(u, (0, 0))
        want[u] = (0, l + 1) if r == "wrong" else (min(5, c + 1), l)
    assert {r["item_id"]: (r["review_count"], r["review_lapses"]) for r in review.replayed(df).collect()} == want


def test_simhash_greedy(spark):
    assert simhash.simhash("") == 0
    base = "the quick brown fox jumps over the lazy dog again and again and again"
    rows = [(1, base), (2, base), (3, base + "!"), (4, "something else entirely, of other words than those"), (5, "tiny"), (6, "tiny")]
    got = {(r["id"], r["kept_id"]) for r in simhash.duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got == {(2, 1), (3, 1)}


def test_components(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 9), (5, 6), (7, 7)], "a long, b long")
    assert {(r["node"], r["comp"]) for r in graph.components(pairs, "a", "b").collect()} == {(1, 1), (2, 1), (3, 1), (9, 1), (5, 5), (6, 5), (7, 7)}


def test_tree_closure(spark):
    got = {(r["node"], r["ancestor"], r["depth"]) for r in graph.closure(spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], "id string, parent string"), "id", "parent").collect()}
    assert got == {("a", "a", 0), ("b", "b", 0), ("c", "c", 0), ("b", "a", 1), ("c", "b", 1), ("c", "a", 2)}


def halved(spark, n):
    """A tree of n nodes by halving; its ways up are more rows than a recursive query may have."""
    return spark.range(1, n).select("id", F.expr("CASE WHEN id > 1 THEN id DIV 2 END").alias("parent"))


def test_closure_of_a_large_tree(spark):
    n = 80_000
    got = graph.closure(halved(spark, n), "id", "parent").agg(F.count("*"), F.max("depth"), F.sum((F.col("ancestor") == F.expr("shiftright(node, depth)")).cast("long"))).first()
    assert tuple(got) == (sum(k.bit_length() for k in range(1, n)), 16, got[0])


def test_closure_keeps_repeated_rows_and_ends_in_circles(spark):
    nodes = spark.createDataFrame([(1, 2), (2, 1), (3, 4), (3, 4), (4, None), (None, 4), (5, 99)], "id long, parent long")
    got = sorted(map(tuple, graph.closure(nodes.where("id > 2"), "id", "parent").collect()))
    assert got == [(3, 3, 0)] * 2 + [(3, 4, 1)] * 4 + [(4, 4, 0), (5, 5, 0), (5, 99, 1)]
    assert graph.closure(nodes, "id", "parent", 5).where("node = 1").orderBy("depth").collect() == [(1, k % 2 + 1, k) for k in range(6)]


def test_snapshot_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    snapshots.write({"x": df, "y": df}, str(tmp_path))
    assert sorted(map(tuple, snapshots.restore(spark, str(tmp_path), "x", "id: long, name: string").collect()), key=str) == [(1, "a"), (2, None)]
    with pytest.raises(ValueError, match="cycle"):
        snapshots.levels([("a", "b"), ("b", "a")])


def test_tiers(spark):
    rows = [("image", 100, 300, 10, 29), ("image", 100, 300, 10, 30), ("image", 100, None, 0, 90), ("image", 100, 300, 10, 180), ("temp", 5, None, None, 1), ("doc", 7, None, None, None), (None, 1, 2, 3, 0)]
    got = {r["tier"]: (r["objects"], r["bytes"], r["cold_objects"], r["cold_bytes"], r["archived_bytes"]) for r in storage.tier_report(spark.createDataFrame(rows, "kind string, size_bytes long, original_bytes long, thumb_bytes long, age int")).collect()}
    assert got == {"display": (5, 401, 2, 200, 0), "original": (4, 902, 2, 600, 300), "thumb": (4, 33, 0, 0, 0), "temp": (1, 5, 1, 5, 0), "doc": (1, 7, 1, 7, 0)}


def test_packed_rectangles_do_not_overlap(spark):
    rnd = random.Random(3)
    rows = [(1, k, rnd.randrange(5, 60), rnd.randrange(5, 80)) for k in range(60)]
    size = {k: (w, h) for _, k, w, h in rows}
    out = layout.packed(spark.createDataFrame(rows, "page long, id long, w long, h long"), "page", 100, 120).collect()
    assert len(out) == 60
    for a in out:
        assert a["x"] + size[a["id"]][0] <= 100 and a["y"] + size[a["id"]][1] <= 120
        for b in out:
            if a["id"] < b["id"] and a["sheet"] == b["sheet"]:
                (aw, ah), (bw, bh) = size[a["id"]], size[b["id"]]
                assert a["x"] + aw <= b["x"] or b["x"] + bw <= a["x"] or a["y"] + ah <= b["y"] or b["y"] + bh <= a["y"]


def test_iou(spark):
    box = lambda *v: [F.lit(x) for x in v]
    r = spark.range(1).select(geometry.iou_pixels(box(0, 0, 9, 9), box(0, 0, 9, 9)).alias("a"), geometry.iou(box(0, 0, 10, 10), box(10, 0, 20, 10)).alias("b")).first()
    assert (r["a"], r["b"]) == (1.0, 0.0)


@pytest.mark.parametrize("anchored", [False, True])
def test_stream_limits(spark, tmp_path, anchored):
    build = rules.anchored_rate if anchored else rules.gated_rate
    src = tmp_path / "in"
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(1).write.parquet(str(src))
    q = build(rules.read_events(spark, str(src)), 2, 6 * 3600).writeStream.format("memory").queryName(f"limits{int(anchored)}").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["event_id"]: r["accepted"] for r in spark.table(f"limits{int(anchored)}").collect()}
    events = sorted(spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("event_id", "user_id", "unix_micros(cast(ts as timestamp)) as at").collect(), key=lambda r: (r["at"], r["event_id"]))
    want, stamps, first = {}, {}, {}
    span = 6 * 3600 * 1_000_000
    for r in events:
        u, at = r["user_id"], r["at"]
        if anchored:
            if u not in first or at - first[u][0] >= span:
                first[u] = [at, 0]
            first[u][1] += 1
            want[r["event_id"]] = first[u][1] <= 2
        else:
            held = [s for s in stamps.get(u, []) if s > at - span]
            want[r["event_id"]] = len(held) < 2
            stamps[u] = held + [at] * want[r["event_id"]]
    assert got == want


def test_stream_review_is_the_batch_replay(spark, tmp_path):
    src = tmp_path / "in"
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(1).write.parquet(str(src))
    q = rules.review_state(rules.read_events(spark, str(src))).writeStream.format("memory").queryName("review").option("checkpointLocation", str(tmp_path / "cp")).outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["user_id"]: (r["review_count"], r["review_lapses"]) for r in spark.table("review").collect()}
    want = {r["item_id"]: (r["review_count"], r["review_lapses"]) for r in review.replayed(review.attempts(events)).collect()}
    assert got == want


def test_windows_and_sessions(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    assert rules.windowed(e, "1 hour").agg(F.sum("n")).first()[0] == e.count()
    assert rules.sessions(e, "30 minutes").agg(F.sum("n")).first()[0] == e.count()


def test_hierarchy(spark):
    from scholia.queries import QUERIES

    got = {(r["page"], r["place"]): r for r in QUERIES["hierarchy"](spark, "").collect()}
    up = {k: r["parent_place"] for k, r in got.items()}
    assert [up[1, k] for k in range(12)] == [None, 0, 0, None, None, 4, 4, 6, None, 8, 8, 8]
    assert [up[2, k] for k in range(4)] == [None, 0, 0, None]
    assert got[1, 7]["full"] == "四、实验题\n（1）步骤\n（2）结论" and got[1, 7]["level"] == 2


def test_reading_order_takes_columns_first(spark):
    rows = [(1, k, 0 if k < 3 else 100, (k % 3) * 20 + (1 if k == 4 else 0), 80 if k < 3 else 180, (k % 3) * 20 + 10) for k in range(6)]
    got = pages.reading_order(spark.createDataFrame(rows, "page long, id long, x0 int, y0 int, x1 int, y1 int"), "page").collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["place"])] == [0, 1, 2, 3, 4, 5]


def test_stored_before_live(spark):
    a, b = (spark.createDataFrame(x, "q int, origin string") for x in ([(1, "stored")], [(1, "live"), (2, "live")]))
    assert sorted(map(tuple, retrieval.stored_or_live(a, b, "q").collect())) == [(1, "stored"), (2, "live")]
    assert retrieval.stored_or_live(a, b, "q", strict=True).count() == 1


def test_two_sinks(spark, tmp_path):
    src = tmp_path / "in"
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(1).write.parquet(str(src))
    rules.dual_write(rules.read_events(spark, str(src)), str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "a")).count() == spark.read.parquet(str(tmp_path / "b")).count() == 1000


def test_small_sides_go_in_parts(spark):
    docs = spark.createDataFrame([(1, "ab cd"), (2, "cd ef"), (3, "")], "doc long, body string")
    keys = spark.createDataFrame([("ab",), ("cd",), ("ef",), ("zz",)], "k string")
    want = [(1, "ab"), (1, "cd"), (2, "cd"), (2, "ef")]
    for rows in (1, 3, 100):
        got = relational.join_small(docs, keys, F.expr("contains(body, k)"), rows)
        assert sorted((r["doc"], r["k"]) for r in got.collect()) == want


@pytest.mark.parametrize("question, keys, picked", [
    ("如图，在平行四边形ABCD中，AB=6，BC=10，角B为60度，点M在BC上，求三角形ABM的面积", ["平行四边形", "三角形", "在平行四", "行四边形", "边形AB", "ABCD"], ["边形ABCD", "6BC10角", "0度点M在B", "三角形ABM"]),
    ("The tsunami swept through the village quickly", ["tsunami", "swept", "through", "village", "quickly"], ["tsunami", "swept", "through", "village"]),
    ("BMDN是菱形，求证四边形BMDN的对角线互相垂直", ["菱形", "BMDN", "DN是菱", "四边形B", "形BMD", "MDN的"], ["BMDN", "BMDN是菱", "形求证四边形", "BMDN的对"]),
])
def test_search_keys_and_anchors(spark, question, keys, picked):
    topics = ["平行四边形", "三角形", "函数", "菱形"]
    assert one(spark, question, lambda c: retrieval.recall_keys(c, topics)) == keys
    assert one(spark, question, lambda c: retrieval.recall_anchors(c, retrieval.anchors(c, topics))) == picked
    assert all(one(spark, question, lambda c: retrieval.recall_keys(c, retrieval.TOPIC_WORDS))[k] in retrieval.TOPIC_WORDS for k in range(1 if "形" in question else 0))


def test_best_section_of_a_solution(spark):
    rows = [(1, "【答案】六【解析】面积等于长乘宽，移项得到"), (2, "\r解：先求长\n答案：面积等于长乘宽"), (3, "没有标记")]
    df = spark.createDataFrame(rows, "k int, s string").withColumn("wanted", F.array(F.lit("面积等于长乘"), F.lit("移项得到")))
    got = {r["k"]: (r["marker"], r["hit"]) for r in retrieval.solution_section(df, "k", "s", "wanted").collect()}
    assert got == {1: ("【解析】", 2), 2: ("答案：", 1)}


def test_rows_by_hand(spark):
    boxes = spark.createDataFrame([(1, 1, 50, 0, 60, 10), (1, 2, 0, 2, 10, 12), (1, 3, 0, 20, 10, 30), (1, 4, 20, 5, 30, 15), (2, 5, 0, 0, 5, 5)], "page long, id long, x0 long, y0 long, x1 long, y1 long")
    got = {r["id"]: (r["row"], r["place"]) for r in layout.rows_of_lines(boxes, "page").collect()}
    assert got == {2: (0, 0), 4: (0, 1), 1: (0, 2), 3: (1, 3), 5: (0, 0)}


def test_patterns_in_one_pass(spark):
    docs = spark.createDataFrame([(1, "abcabd", "x"), (2, None, "abc"), (3, "", ""), (3, "zab", None)], "k int, a string, b string")
    patterns = spark.createDataFrame([("ab",), ("abc",), ("b",), ("",), (None,), ("ab",), ("q",)], "p string")
    want = {(1, "ab", True, False), (1, "abc", True, False), (1, "b", True, False), (2, "ab", False, True), (2, "abc", False, True), (2, "b", False, True), (3, "ab", True, False), (3, "b", True, False)}
    for sent in (1, 1 << 20):
        assert {tuple(r) for r in patterns_of(docs, patterns, sent)} == want
    assert patterns_of(docs, patterns.limit(0), 10) == [] and patterns_of(docs.limit(0), patterns, 10) == []


def patterns_of(docs, wanted, sent):
    from scholia.operators import patterns

    return patterns.containing(docs, "k", ["a", "b"], wanted, "p", sent).collect()


def test_moves_of_folders(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 1), (5, 99)], "id long, parent long")
    asked = spark.createDataFrame([(1, 3), (2, 2), (4, 3), (3, None), (4, 77), (4, 5)], "id long, target long")
    assert {(r["id"], r["target"]): r["reason"] for r in graph.moves(nodes, asked, "id", "parent").collect()} == {(1, 3): "cycle", (2, 2): "self", (4, 3): "", (3, None): "", (4, 77): "missing", (4, 5): "missing"}
    left = graph.lifted(nodes, spark.createDataFrame([(2,), (1,)], "id long"), "id", "parent").collect()
    assert {r["id"]: r["parent"] for r in left} == {3: None, 4: None, 5: None}


def test_moves_in_a_large_tree(spark):
    n = 80_000
    asked = spark.range(1, n).select("id", F.expr("CASE WHEN id % 2 = 0 THEN id * 2 WHEN id % 3 = 0 THEN n ELSE 1 END".replace("n ", f"{n} ")).alias("target"))
    want = {"": 0, "cycle": 0, "missing": 0, "self": 0}
    for k in range(1, n):
        to = k * 2 if k % 2 == 0 else n if k % 3 == 0 else 1
        want["self" if to == k else "missing" if to >= n else "cycle" if k % 2 == 0 else ""] += 1
    assert {r["reason"]: r["count"] for r in graph.moves(halved(spark, n), asked, "id", "parent").groupBy("reason").count().collect()} == want


def test_lifted_in_a_large_tree(spark):
    n = 130_000
    got = graph.lifted(halved(spark, n), spark.range(1, n).where("id % 3 = 0"), "id", "parent").where("id IN (1, 4, 6, 7, 13, 97, 125000)").collect()

    def nearest(k):
        k //= 2
        return None if k < 1 else nearest(k) if k % 3 == 0 else k

    assert {r["id"]: r["parent"] for r in got} == {k: nearest(k) for k in (1, 4, 7, 13, 97, 125000)}


def test_restored_rows(spark):
    df = spark.createDataFrame([(1, "a\n\"b", None), (2, None, 1.5)], "k long, s string, v double")
    assert sorted(snapshots.restored(snapshots.lines({"x": df, "y": df.limit(1)}), "x", df.schema).collect()) == sorted(df.collect())


def test_letter_pairs_are_sets_of_bigrams(spark):
    rnd = random.Random(8)
    words = ["", "a", "ab", "zz", "az", None] + ["".join(rnd.choice("abcxyz") for _ in range(rnd.randrange(2, 60))) for _ in range(40)]
    rows = [(k, a, b) for k, (a, b) in enumerate(zip(words, words[1:] + words[:1], strict=True))]
    df = spark.createDataFrame(rows, "k long, a string, b string")
    pairs = lambda s: {s[k : k + 2] for k in range(len(s) - 1)}
    got = {r["k"]: (r["n"], r["d"]) for r in df.select("k", text.bits_in(text.letter_pairs(F.col("a"))).alias("n"), text.dice_of_pairs(text.letter_pairs(F.col("a")), text.letter_pairs(F.col("b"))).alias("d")).collect()}
    for k, a, b in rows:
        n = None if a is None else len(pairs(a))
        d = None if a is None or b is None or not pairs(a) | pairs(b) else 2 * len(pairs(a) & pairs(b)) / (len(pairs(a)) + len(pairs(b)))
        assert got[k][0] == n and got[k][1] == (d if d is None else pytest.approx(d))


def test_similar_items_of_every_row_with_the_smallest_id(spark, tmp_path):
    from scholia.queries import QUERIES

    rows = [(1, "abcdef"), (1, "abcdxy"), (2, "abcd"), (0, "x"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, QUERIES["similar_items"](spark, str(tmp_path)).collect()))
    assert got == [(1, 0.6), (1, 0.6), (1, 1.0), (1, 1.0), (2, 0.75), (2, 0.75)]


def test_lines_that_are_read_with_few_errors(spark):
    rows = [("abcd", "xxabxdxx"), ("abcd", "xxaxxdxx"), ("abcdefgh", "zabxdexghz"), ("ab", ""), ("abc", "ab"), ("abc", "abc"), ("a", "b")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [r[0] for r in df.select(text.line_read(F.col("a"), F.col("b"))).collect()] == [True, False, True, False, False, True, False]


def test_grams_are_cut_between_whole_characters(spark):
    texts = [None, "", "a", "ab\ncd", "𝔸𝔹c𝔻e\U0001f600f", "甲乙丙丁戊己庚辛"]
    got = spark.createDataFrame(list(enumerate(texts)), "k long, s string").orderBy("k").select(text.grams(F.col("s"), 2).alias("a"), text.grams(F.col("s"), 4, 3).alias("b")).collect()
    cut = lambda s, n, step: [s[i : i + n] for i in range(0, len(s or "") - n + 1, step)]
    assert [tuple(r) for r in got] == [(cut(s, 2, 1), cut(s, 4, 3)) for s in texts]
