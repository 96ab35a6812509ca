"""Retrieval: distinctive keys of a question, two-channel recall, gates, unique choice, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .patterns import containing

# Limits of the matcher.
LONG_ANCHORS, LONG_RATIO, STRICT_RATIO = 3, 0.4, 0.55
LONGEST_STEM, SHORTEST_SOLUTION = 6000, 8
ANCHOR, STEP, MOST_ANCHORS = 6, 3, 12

# Beginnings that tell nothing of a question, and common Latin words.
NOISE = ["如图", "下列", "关于", "我们", "一个", "如果", "已知", "根据", "请", "求", "计算", "的是", "正确", "错误", "说法", "选项", "设", "求证", "试"]
LATIN_STOP = [
    "with", "the", "and", "for", "that", "this", "from", "have", "been", "were",
    "what", "when", "which", "there", "their", "would", "could", "should", "about",
    "photo", "please", "choose", "following", "according",
]


# Words of topics, for the choice of search keys; none is an anchor by itself.
TOPIC_WORDS = [
    "浮力", "压强", "密度", "重力", "摩擦力", "杠杆", "滑轮", "机械效率", "机械能", "动能", "势能",
    "电流", "电压", "电阻", "欧姆定律", "电功率", "电功", "焦耳定律", "串联", "并联", "磁场", "电磁感应",
    "光的反射", "光的折射", "凸透镜", "成像", "物态变化", "熔化", "凝固", "汽化", "液化", "升华",
    "比热容", "内能", "热量", "声音", "音调", "响度", "速度", "路程", "参照物", "惯性", "二力平衡",
    "函数", "一次函数", "二次函数", "反比例函数", "方程", "方程组", "不等式", "因式分解", "分式",
    "三角形", "全等", "相似", "四边形", "平行四边形", "矩形", "菱形", "梯形", "圆", "扇形", "切线",
    "勾股定理", "锐角三角函数", "正弦", "余弦", "正切", "概率", "统计", "平均数", "中位数", "方差",
    "数列", "集合", "导数", "圆锥", "圆柱", "体积", "表面积",
    "化学式", "化学方程式", "配平", "相对分子质量", "溶液", "溶质", "溶剂", "溶解度", "酸碱盐",
    "氧化还原", "化合反应", "分解反应", "置换反应", "复分解反应", "金属活动性", "pH",
    "细胞", "光合作用", "呼吸作用", "遗传", "生态系统", "文言文", "古诗", "阅读理解", "完形填空",
]


def noise(seg: Column) -> Column:
    return (F.length(seg) < 2) | seg.rlike("^(" + "|".join(NOISE) + ")")


def anchors(question: Column, topics: list[str] = ()) -> Column:
    """Up to 12 six-character windows at every third character, then numbers with units and runs of capitals."""
    q = text.normalised(question)
    windows = text.grams(q, ANCHOR, STEP)
    topical = lambda w: F.exists(F.array(*map(F.lit, topics)), lambda x: F.contains(w, x) & (F.length(w) - F.length(x) <= 2)) if topics else F.lit(False)
    plain = F.slice(F.array_distinct(F.filter(windows, lambda w: ~noise(w) & ~w.rlike(r"^\d+$|^[A-Za-z]+$") & ~topical(w))), 1, MOST_ANCHORS)
    numbers = F.regexp_extract_all(q, F.lit(r"(\d{2,}|[A-Za-z]?\d+[A-Za-z一-龥])"), 1)
    with_numbers = F.slice(F.array_distinct(F.concat(plain, F.filter(numbers, lambda x: F.length(x) >= 2))), 1, MOST_ANCHORS + 6)
    return F.array_distinct(F.concat(with_numbers, F.regexp_extract_all(q, F.lit("([A-Z]{2,4})"), 1)))


def long_anchors(a: Column) -> Column:
    return F.filter(a, lambda x: F.length(x) >= 4)


def hits(wanted: Column, flat: Column) -> Column:
    """How many of the anchors a normalised text holds."""
    return F.size(F.filter(wanted, lambda x: F.contains(flat, x)))


def recall_keys(question: Column, topics: list[str] = (), most: int = 6) -> Column:
    """Topic words first, then runs of four characters at every second one; Latin words whole, from five letters."""
    q = F.coalesce(question, F.lit(""))
    topic = F.filter(F.array(*map(F.lit, topics)), lambda x: F.contains(q, x)) if topics else F.array().cast("array<string>")
    parts = F.filter(F.split(F.regexp_replace(q, text.KEPT + "+", " "), r"\s+"), lambda x: F.length(x) >= 2)
    stop = F.array(*map(F.lit, LATIN_STOP))
    of = lambda b: (
        F.when(b.rlike("^[0-9]+$"), F.array().cast("array<string>"))
        .when(b.rlike("^[A-Za-z]+$"), F.when((F.length(b) >= 5) & ~F.array_contains(stop, F.lower(b)), F.array(F.lower(b))).otherwise(F.array().cast("array<string>")))
        .otherwise(F.filter(text.grams(b, 4, 2), lambda x: ~noise(x)))
    )
    return F.slice(F.array_distinct(F.concat(topic, F.flatten(F.transform(parts, of)))), 1, most)


def recall_anchors(question: Column, all_anchors: Column, most: int = 4) -> Column:
    """At most two rare labels in capitals, Latin words, then Han anchors sampled evenly over the question."""
    bare = F.transform(all_anchors, lambda x: F.translate(x, "%,()", ""))
    step_one = lambda x: F.forall(F.sequence(F.lit(2), F.greatest(F.length(x), F.lit(2))), lambda i: F.ascii(F.substring(x, i, F.lit(1))) - F.ascii(F.substring(x, i - 1, F.lit(1))) == 1)
    labels = F.slice(F.filter(bare, lambda x: x.rlike("^[A-Z]{4,6}$") & ~step_one(x) & ~x.rlike(r"(.)\1")), 1, 2)
    parts = F.split(F.regexp_replace(F.coalesce(question, F.lit("")), text.KEPT + "+", " "), r"\s+")
    stop = F.array(*map(F.lit, LATIN_STOP))
    latin = F.transform(F.filter(parts, lambda x: x.rlike("^[A-Za-z]{5,}$") & ~F.array_contains(stop, F.lower(x))), F.lower)
    han = F.filter(long_anchors(all_anchors), lambda x: x.rlike("[一-龥]"))
    step = F.greatest(F.ceil(F.size(han) / most), F.lit(1))
    even = F.filter(han, lambda x, i: i % step == 0)
    return F.slice(F.array_distinct(F.concat(labels, latin, even)), 1, most)


def dictionary(df: DataFrame, key: str, column: str, terms: DataFrame, term: str, top: int = 3) -> DataFrame:
    """Terms of a dictionary in a text: longest first, then by place; the first ``top``."""
    near = containing(df, key, [column], terms.where(F.length(term) >= 2), term).select(key, term).join(df.select(key, column), key)
    near = near.withColumn("pos", F.instr(F.col(column), F.col(term)))
    w = Window.partitionBy(key).orderBy(F.desc(F.length(term)), "pos", term)
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def recall(keys: DataFrame, docs: DataFrame, name: str, flat: str, doc: str, top: int) -> DataFrame:
    """Name hits and text hits of a question's keys, merged; text counts twice.

    keys: question, k, in_name, in_text.  One pass over the documents finds all keys in both channels; what is joined and
    grouped is document and key, never a text.
    """
    found = containing(docs.select(doc, F.col(name).alias("__name"), F.col(flat).alias("__flat")), doc, ["__name", "__flat"], keys, "k").join(keys, "k")
    name_hit, text_hit = F.col("in_name") & F.col("__name"), F.col("in_text") & F.col("__flat")
    g = found.where(name_hit | text_hit).groupBy("question", doc).agg(F.count_if(name_hit).alias("name_hits"), F.count_if(text_hit).alias("text_hits"))
    sizes = keys.groupBy("question").agg(F.count_if("in_name").alias("nk"), F.count_if("in_text").alias("tk"))
    g = g.withColumn("key_hits", F.col("name_hits") + 2 * F.col("text_hits"))
    w = Window.partitionBy("question").orderBy(F.desc("key_hits"), F.desc("text_hits"), doc)
    g = g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).join(sizes, "question")
    return g.withColumn("score", F.round(F.col("key_hits") / (F.col("nk") + 2 * F.col("tk")), 3)).select("question", doc, "name_hits", "text_hits", "key_hits", "score", "rank")


def gate(total: Column, hit: Column, stem_chars: Column, ask: Column, crosses: Column, has_solution: Column, solution_chars: Column) -> Column:
    """The first of six reasons that turns an object away, or empty; ask: same, conflict or unknown."""
    ratio = F.when(total == 0, 0.0).otherwise(hit / total)
    need = F.when(ask == "same", LONG_RATIO).otherwise(STRICT_RATIO)
    return (
        F.when(total < LONG_ANCHORS, "few_anchors").when(stem_chars > LONGEST_STEM, "too_long").when(ask == "conflict", "ask_conflict").when((hit < LONG_ANCHORS) | (ratio < need), "low_hits")
        .when(crosses, "crosses_boundary").when(~has_solution | (solution_chars < SHORTEST_SOLUTION), "no_solution").otherwise("")
    )


def ask_match(a: Column, b: Column) -> Column:
    return F.when((a == "unknown") | (b == "unknown"), "unknown").when(a == b, "same").otherwise("conflict")


def confidence(link_score: Column, ask: Column) -> Column:
    return F.round(F.least(F.lit(1.0), 0.6 + F.least(F.lit(0.25), link_score * 0.05) + F.when(ask == "same", 0.15).otherwise(0.0)), 2)


def unique(judged: DataFrame, question: str) -> DataFrame:
    """One row a question: the best object that passed, unless two are equally good; else the closest with its reason."""
    w = Window.partitionBy(question).orderBy(F.when(F.col("reason") == "", 0).otherwise(1), F.desc("hit"), F.desc("ratio"), F.desc("solution_chars"), "object_id")
    nxt = F.lead(F.struct("reason", "hit", "ratio")).over(w)
    x = judged.withColumn("r", F.row_number().over(w)).withColumn("n", nxt).where("r = 1")
    tie = (F.col("reason") == "") & F.coalesce((F.col("n.reason") == "") & (F.col("n.hit") == F.col("hit")) & (F.col("n.ratio") == F.col("ratio")), F.lit(False))
    return x.withColumn("reason", F.when(tie, "not_unique").otherwise(F.col("reason"))).withColumn("exact", F.col("reason") == "").drop("r", "n")


def stored_or_live(stored: DataFrame, live: DataFrame, question: str, strict: bool = False) -> DataFrame:
    """Judgements of valid stored objects; questions that have none fall back to the live split, unless strict."""
    if strict:
        return stored
    return stored.unionByName(live.join(stored.select(question).distinct(), question, "left_anti"))


# Starts of questions and marks of solutions.
START = r"(?:^|\n)[ \t]*(?:(【\s*例\s*\d+\s*】)|(【\s*练习\s*\d+\s*】)|((?:问题|演练)\s*[一二三四五六七八九十\d]+\s*[:：.．]?)|(\d{1,3}\s*(?:[．、]|\.(?!\d))))"
MARK = r"【(?:答案|解析|详解|解答|分析|解)】|(?:^|[\n\r])\s*(?:答案|解析|详解|解答|解)\s*[:：]"
BOUNDARY = r"\n[ \t]*(?:【\s*例\s*\d+\s*】|【\s*练习\s*\d+\s*】|(?:问题|演练)\s*[一二三四五六七八九十\d]+\s*[:：.．]|\d{1,3}\s*(?:[．、]|\.(?!\d)))"
#: What joins the fields of a fingerprint.
JOINED = "\u0001"


def object_fingerprint(version: Column, *fields: Column) -> Column:
    """SHA-256 of an object's fields in order (null as empty) and of the version of the rules that cut it."""
    return F.sha2(F.concat_ws(JOINED, *(F.coalesce(f.cast("string"), F.lit("")) for f in (*fields, version))), 256)


def stored_reason(engine: Column, version: Column, status: Column, revision: Column, expected: Column, fingerprint: Column, computed: Column, stem: Column, char_start: Column, char_end: Column, stem_start: Column, stem_end: Column, has_solution: Column, solution: Column) -> Column:
    """The first of eight checks of a stored object that fails, or empty."""
    return (
        F.when(engine != version, "engine").when(status != "ok", "status").when(revision != expected, "revision").when(fingerprint != computed, "fingerprint").when(F.trim(F.coalesce(stem, F.lit(""))) == "", "stem")
        .when((char_start < 0) | (char_end <= char_start), "range").when((stem_end < stem_start) | (stem_end > char_end), "stem_range").when(has_solution & F.coalesce(solution, F.lit("")).rlike(BOUNDARY), "boundary").otherwise("")
    )


def objects(df: DataFrame, key: str, column: str) -> DataFrame:
    """A document to its questions in order: object_index, label, stem, solution.  Text before the first start is left out.

    A separator that no document holds is put before each start, and the text is cut there.
    """
    cut = F.split(F.regexp_replace(column, START, "\u0001$0"), "\u0001")
    starts = F.size(cut) > 1
    parts = F.when(starts, F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(0)))).otherwise(F.array(F.col(column)))
    x = df.where(F.trim(column) != "").select(key, F.posexplode(parts).alias("object_index", "part"))
    label = F.trim(F.concat(*(F.regexp_extract("part", "^" + START, k) for k in (1, 2, 3, 4))))
    pieces = F.split(F.regexp_replace("part", MARK, "\u0002$0"), "\u0002", 2)
    return x.select(key, "object_index", label.alias("label"), pieces[0].alias("stem"), F.coalesce(F.get(pieces, F.lit(1)), F.lit("")).alias("rest")).withColumn("solution", F.replace("rest", F.lit("\u0002"), F.lit(""))).drop("rest")


def solution_section(df: DataFrame, key: str, solution: str, wanted: str, most: int = 800) -> DataFrame:
    """The marked section that holds most anchors, explanations before answers, then the longest."""
    cut = F.filter(F.split(F.regexp_replace(solution, MARK, "\u0002$0\u0003"), "\u0002"), lambda p: F.contains(p, F.lit("\u0003")))
    x = df.select(key, wanted, F.posexplode(cut).alias("__k", "__p"))
    marker, body = F.split("__p", "\u0003")[0], F.substring(F.regexp_replace(F.split("__p", "\u0003")[1], r"^\s+|\s+$", ""), 1, most)
    x = x.select(key, "__k", F.regexp_replace(marker, r"^\s+|\s+$", "").alias("marker"), body.alias("excerpt"), hits(F.col(wanted), text.normalised(body)).alias("hit")).where("excerpt <> ''")
    w = Window.partitionBy(key).orderBy(F.desc("hit"), F.when(F.col("marker").rlike("解析|详解|解答|分析"), 0).otherwise(1), F.desc(F.length("excerpt")), "__k")
    return x.withColumn("r", F.row_number().over(w)).where("r = 1").select(key, "marker", "excerpt", "hit")


#: Grams of items that go to every task at most; more are joined by a shuffle.
SENT_GRAMS = 1_000_000


def covering(texts: DataFrame, key: str, items: DataFrame, item: str, part: int, of: int) -> DataFrame:
    """key, item, coverage: the texts that hold at least part / of of an item's grams (column grams, distinct, on both sides).

    One join on the gram: where the items' grams go to every task, a text's grams meet them in the task that reads the text, so
    all hits of a pair are counted before anything is shuffled, and no list of grams is moved.  Items without grams have no
    rows; repeated rows give repeated rows.
    """
    each = items.where(F.size("grams") > 0).select(item, F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    small = each.limit(SENT_GRAMS + 1).count() <= SENT_GRAMS
    held = texts.select(key, F.monotonically_increasing_id().alias("row"), "grams").select(key, "row", F.explode("grams").alias("gram"))
    hits = held.join(F.broadcast(each) if small else each, "gram").groupBy(key, "row", item, "n").agg(F.count("*").alias("hits"))
    return hits.where(of * F.col("hits") >= part * F.col("n")).select(key, item, (F.col("hits") / F.col("n")).alias("coverage"))


# The number at the head of a line, and what blocks and whole texts must have.
NUMBERED_LINE = rf"^(?:第\s*[{text.HAN}\d]{{1,3}}\s*(?:部分|大题|卷)|[（(]\s*[{text.HAN}]{{1,3}}\s*[）)]|[{text.HAN}]{{1,3}}\s*[、，,．.]|[{text.CIRCLED}]|[（(]\s*\d{{1,2}}\s*[）)]|\d{{1,2}}\s*[、，,．.)）])"
SHORTEST_BLOCK, LEAST_MEAN, LEAST_HAN, LEAST_CONFIDENCE = 6, 12, 0.15, 0.6


def structured(texts: DataFrame, key: str, text_col: str, confidence: str | None = None) -> DataFrame:
    """key, items (array), n, mean_length, han_share, reason (ok, empty, short, noise, confidence): texts of lines as blocks of questions.

    A block begins at a line with a number and at least two more characters; a block without Han characters or of fewer
    than six characters goes back to the one before it.  Lines are numbered within their text and summed up to blocks twice, by
    windows over (text, line), so a text of many lines needs no array of all.  Rows of one key are one text each only if the key is
    unique; null texts are empty; an empty table has no rows.
    """
    line = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\r?\n"), lambda x: F.trim(x))
    lines = texts.select(key, F.posexplode(F.filter(line, lambda x: x != "")).alias("at", "line"))
    starts = F.col("line").rlike(NUMBERED_LINE) & (F.length(F.trim(F.regexp_replace("line", NUMBERED_LINE, ""))) >= 2)
    down = Window.partitionBy(key).orderBy("at")
    joined = lambda c, at: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(at, c))), lambda x: x[c]), "\n")
    blocks = lines.withColumn("block", F.sum(starts.cast("int")).over(down)).groupBy(key, "block").agg(joined("line", "at").alias("b"))
    whole = F.col("b").rlike("[一-龥]") & (F.length("b") >= SHORTEST_BLOCK)
    order = Window.partitionBy(key).orderBy("block")
    kept = blocks.withColumn("keeps", whole | (F.row_number().over(order) == 1)).withColumn("item", F.sum(F.col("keeps").cast("int")).over(order))
    items = kept.groupBy(key, "item").agg(joined("b", "block").alias("text"))
    chars, han = F.sum(F.length("text")), F.sum(F.length(F.regexp_replace("text", "[^一-龥]", "")))
    found = items.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("item", "text"))), lambda x: x["text"]).alias("items"), F.count("*").alias("n"), (chars / F.count("*")).alias("mean_length"), (han / chars).alias("han_share"))
    out = texts.select(key, (F.col(confidence) if confidence else F.lit(None).cast("double")).alias("confidence")).join(found, key, "left")
    reason = F.when(F.col("n").isNull(), "empty").when(F.col("mean_length") < LEAST_MEAN, "short").when(F.col("han_share") < LEAST_HAN, "noise").when(F.col("confidence") < LEAST_CONFIDENCE, "confidence").otherwise("ok")
    return out.select(key, F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("n", F.lit(0)).alias("n"), "mean_length", "han_share", reason.alias("reason"))
