import random
import re

from scholia.operators import graph, retrieval

NUMBERED = re.compile(r"^(?:第\s*[一二三四五六七八九十\d]{1,3}\s*(?:部分|大题|卷)|[（(]\s*(?:[一二三四五六七八九十]{1,3}|\d{1,2})\s*[）)]|[一二三四五六七八九十]{1,3}\s*[、，,．.]|[①②③④⑤⑥⑦⑧⑨⑩]|\d{1,2}\s*[、，,．.)）])")


def plain(s, confidence):
    """The rule in plain Python: blocks first, then short ones go back."""
    blocks, cur = [], ""
    for line in filter(None, (x.strip(" ") for x in re.split(r"\r?\n", s or ""))):
        m = NUMBERED.match(line)
        if m and len(line[m.end() :].strip(" ")) >= 2:
            blocks += [cur] if cur else []
            cur = line
        else:
            cur += ("\n" if cur else "") + line
    blocks += [cur] if cur else []
    items = []
    for b in blocks:
        if items and not (re.search("[一-龥]", b) and len(b) >= 6):
            items[-1] += "\n" + b
        else:
            items.append(b)
    if not items:
        return [], "empty"
    whole = "".join(items)
    han = len(re.findall("[一-龥]", whole)) / len(whole)
    return items, "short" if len(whole) / len(items) < 12 else "noise" if han < 0.15 else "confidence" if confidence is not None and confidence < 0.6 else "ok"


def test_blocks_are_those_of_the_rule(spark):
    rnd = random.Random(4)
    lines = ["1. 已知三角形的面积求高", "（2）求它的周长是多少", "②", "三、选择题部分", "plain words", "", "  第一大题 阅读  ", "12.5", "3)x", "甲乙丙丁", "A. 选项一", "x" * 40]
    rows = [(k, rnd.choice(["\n", "\r\n"]).join(rnd.choice(lines) for _ in range(rnd.randrange(12))), rnd.choice([None, 0.5, 0.9])) for k in range(150)]
    rows += [(1000, None, 0.9), (1001, "", None), (1002, "\n \n", None), (1003, "1. 题目很长很长的一行文字\n" * 3000, 0.9)]
    got = retrieval.structured(spark.createDataFrame([(*r, "clash") for r in rows], "id long, s string, c double, n string").drop("n"), "id", "s", "c").collect()
    assert {r["id"]: (r["items"], r["reason"]) for r in got} == {k: plain(s, c) for k, s, c in rows}
    assert len(got) == len(rows) and {r["reason"] for r in got} == {"ok", "empty", "short", "noise", "confidence"}


def test_crawl_by_hand(spark):
    nodes = [(1, None, True, 5), (2, 1, True, 5), (3, 1, True, 6), (4, 2, False, 1), (5, 3, True, 7), (6, 3, False, 1), (7, 5, False, 2), (8, 5, True, None), (1, 8, True, 5), (9, 8, False, 3), (10, 99, False, 1)]
    known = [(2, 5), (3, 5), (5, 7), (8, None), (1, 5)]
    df = spark.createDataFrame(nodes, "id long, parent long, is_dir boolean, mtime int")
    roots = df.where("parent IS NULL")
    go = lambda k: {(r["id"], r["depth"], r["state"]) for r in graph.crawl(df, spark.createDataFrame(k, "id long, mtime int"), roots).collect()}
    assert go(known) == {(1, 0, "listed"), (2, 1, "skipped"), (3, 1, "listed"), (5, 2, "skipped"), (6, 2, "file")}
    assert go([]) == {(1, 0, "listed"), (2, 1, "listed"), (3, 1, "listed"), (4, 2, "file"), (5, 2, "listed"), (6, 2, "file"), (7, 3, "file"), (8, 3, "listed"), (9, 4, "file")}
    assert graph.crawl(df, spark.createDataFrame([], "id long, mtime int"), roots.limit(0)).count() == 0


def test_crawl_joins_the_known_times_once(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(graph, "cut", lambda df, cut=graph.cut: (plans.append(df._jdf.queryExecution().analyzed().toString()), cut(df))[1])
    nodes = spark.range(1, 200).selectExpr("id", "CASE WHEN id > 1 THEN id DIV 2 END AS parent", "true AS is_dir", "0 AS mtime")
    known = spark.range(1, 200).selectExpr("id", "CAST(id % 40 = 39 AS int) - 1 AS mtime")
    got = {r["id"]: (r["depth"], r["state"]) for r in graph.crawl(nodes, known, nodes.where("parent IS NULL")).collect()}
    skipped = lambda k: k > 1 and k % 40 == 39
    want = {k: (k.bit_length() - 1, "skipped" if skipped(k) else "listed") for k in range(1, 200) if not any(skipped(k >> up) for up in range(1, 8))}
    assert got == want
    assert sum("LeftOuter" in p for p in plans) == 1 and all("strategy=merge" in p for p in plans if "Join" in p)
