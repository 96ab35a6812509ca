"""Column builders over text: normalisation, keys, numbering, splitting and similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that survive normalisation, by their ranges.
KEPT = "[^一-龥A-Za-z0-9]"


def normalised(c: Column) -> Column:
    """Han, Latin letters and ASCII digits only; null is empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), KEPT, "")


def without_punctuation(c: Column) -> Column:
    """White space and the listed punctuation taken out, all else kept."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")
    return F.regexp_replace(bare, r"[，。、；：？！\"'“”‘’（）()【】\[\]{}《》·—\-–_,.;:?!/\\|+=*#~`^$@%&]", "")


def folded(c: Column) -> Column:
    """Full-width ASCII to half-width, four punctuation marks folded, white space dropped."""
    wide, narrow = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))
    return F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), wide + "，。：；", narrow + ",.:;"), r"[\s　]+", "")


def tags_stripped(c: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(c, "(?s)<!--.*?-->", " "), "(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), r"\s+", " "))


def cleaned(c: Column) -> Column:
    """A parameter as clients send it: blank, undefined, null and NaN are null."""
    x = F.trim(c)
    return F.when(F.lower(x).isin("", "undefined", "null", "nan"), F.lit(None)).otherwise(x)


def int_or_null(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("int"))


def hash_of_key(c: Column) -> Column:
    """The content hash in a storage key such as ``image/<hash>_thumb.jpg``."""
    return F.regexp_extract(c, "([0-9a-f]{32,64})(_[a-z]+)?[.][a-z]+$", 1)


def grams(c: Column, n: int, step: int = 1) -> Column:
    """All runs of n characters at every ``step``; none if the text is shorter."""
    # one pass: looks ahead at a run and goes on by ``step`` whole characters
    runs = F.regexp_extract_all(c, F.lit(rf"(?s)(?=(.{{{n}}})).{{1,{step}}}"), F.lit(1))
    return F.coalesce(runs, F.array().cast("array<string>"))


def bigrams(c: Column) -> Column:
    return F.array_distinct(grams(c, 2))


def dice(a: Column, b: Column) -> Column:
    return 2.0 * F.size(F.array_intersect(a, b)) / F.nullif(F.size(a) + F.size(b), F.lit(0))


#: Pairs of two letters, and the 64-bit words that hold a bit for each.
PAIRS, WORDS = 26 * 26, 11


def letter_pairs(c: Column) -> Column:
    """The distinct bigrams of a text of letters a to z only, as array<bigint> with a bit for each of the 676; null is null."""

    @F.pandas_udf("array<bigint>")
    def bits(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out = []
            for t in s:
                if t is None:
                    out.append(None)
                    continue
                x = np.frombuffer(t.encode(), np.uint8).astype(np.int16) - ord("a")
                has = np.zeros(WORDS * 64, bool)
                has[x[:-1] * 26 + x[1:]] = True
                out.append(np.packbits(has).view(np.int64))
            yield pd.Series(out, index=s.index, dtype=object)

    return bits(c)


def bits_in(c: Column) -> Column:
    return F.aggregate(c, F.lit(0), lambda n, x: n + F.bit_count(x))


def dice_of_pairs(a: Column, b: Column) -> Column:
    """Dice of two results of letter_pairs."""
    return 2.0 * bits_in(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))) / F.nullif(bits_in(a) + bits_in(b), F.lit(0))


def coverage(a: Column, b: Column) -> Column:
    """The share of a's grams that b has."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(a), F.lit(0)), F.lit(0.0))


def characters(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]{1,8})$", 1))


def file_name(name: Column) -> Column:
    return F.regexp_replace(name, r'[\\/:*?"<>|]', "_")


def around(c: Column, needle: Column, before: int = 60, after: int = 120) -> Column:
    """The text around the first place of the needle; empty if there is none."""
    at = F.instr(c, needle)
    lo = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substring(c, lo, at - lo + F.length(needle) + after)).otherwise(F.lit(""))


# What a question asks for, by the first of these rules that fits the last 80 characters.
ASK_RULES = [
    ("choice", "下列说法|以下说法|正确的是|错误的是|不正确|符合题意"),
    ("existence", "是否存在|是否能|能否|是否"),
    ("shape", "形状|是什么三角形|为何种图形|判断.{0,10}(?:形状|三角形|四边形)"),
    ("proof", "求证|证明|试证"),
    ("area", "面积"),
    ("angle", "度数|角度|多少度|为多少度"),
    ("range", "取值范围|最大值|最小值|范围为"),
    ("coordinate", "坐标"),
    ("ratio", "之比|比值|比为|∶"),
    ("length", "长度|的长|周长|线段.{0,6}长"),
    ("value", "的值为|为多少|是多少|等于|求.{0,10}(?:值|数)|计算|求"),
]


def ask_kind(c: Column) -> Column:
    tail = F.right(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""), F.lit(80))
    out = F.lit("unknown")
    for kind, rule in reversed(ASK_RULES):
        out = F.when(tail.rlike(rule), kind).otherwise(out)
    return out


# Han numerals and circled digits in order.
HAN = "一二三四五六七八九十"
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩"


def han_number(c: Column) -> Column:
    """Numerals up to 99, in Han or ASCII digits; null if it isn't one."""
    digit = lambda x: F.instr(F.lit(HAN[:9]), x)
    ten = F.instr(c, F.lit("十"))
    high = F.when(ten == 1, 1).otherwise(digit(F.substring(c, ten - 1, F.lit(1))))
    low = F.when(ten == F.length(c), 0).otherwise(digit(F.substring(c, ten + 1, F.lit(1))))
    plain = F.translate(c, HAN[:9], "123456789").try_cast("int")
    return F.when(c.rlike(r"^\d+$"), c.try_cast("int")).when(~c.rlike(f"^[{HAN}]+$"), F.lit(None)).when(ten > 0, high * 10 + low).otherwise(plain)


def numbering(c: Column) -> tuple[Column, Column]:
    """Kind and value of the number at the head of a question."""
    s = F.trim(F.coalesce(c, F.lit("")))
    part = F.regexp_extract(s, r"^第\s*([一二三四五六七八九十\d]{1,3})\s*(部分|大题|卷)", 1)
    paren = F.regexp_extract(s, r"^[（(]\s*([一二三四五六七八九十]{1,3})\s*[）)]", 1)
    han = F.regexp_extract(s, r"^([一二三四五六七八九十]{1,3})\s*[、，,．.]", 1)
    circled = F.instr(F.lit(CIRCLED), F.substring(s, 1, 1))
    bracketed = F.regexp_extract(s, r"^[（(]\s*(\d{1,2})\s*[）)]", 1)
    arabic = F.regexp_extract(s, r"^(\d{1,2})\s*[、，,．.)）]", 1)
    kind = F.when(part != "", "part").when(paren != "", "paren-cjk").when(han != "", "cjk").when((circled > 0) & (s != ""), "circled").when((bracketed != "") | (arabic != ""), "arabic").otherwise("none")
    value = F.when(part != "", han_number(part)).when(paren != "", han_number(paren)).when(han != "", han_number(han)).when((circled > 0) & (s != ""), circled).when(bracketed != "", bracketed.try_cast("int")).otherwise(arabic.try_cast("int"))
    return kind, value.cast("int")


# The phrasings that declare a range of sub-questions.
RANGES = [
    r"完成\s*第?\s*(\d{1,2})\s*[-–—~至到]\s*第?\s*(\d{1,2})\s*题",
    r"完成\s*第?\s*(\d{1,2})\s*[、，,]\s*第?\s*(\d{1,2})\s*题",
    r"回答\s*第?\s*(\d{1,2})\s*[-–—~至到]\s*第?\s*(\d{1,2})\s*题",
    r"第\s*(\d{1,2})\s*[-–—~至到]\s*(\d{1,2})\s*题",
]


def declared_range(c: Column) -> tuple[Column, Column]:
    lo, hi = F.lit(None).cast("int"), F.lit(None).cast("int")
    for r in reversed(RANGES):
        a, b = F.regexp_extract(c, r, 1).try_cast("int"), F.regexp_extract(c, r, 2).try_cast("int")
        ok = F.coalesce((a > 0) & (b >= a), F.lit(False))
        lo, hi = F.when(ok, a).otherwise(lo), F.when(ok, b).otherwise(hi)
    return lo, hi


# Letters that make a stem meaningful, and characters a bare fragment may have.
MEANINGFUL = "[一-龥㐀-䶿a-zA-Z]"
FRAGMENT = r"^[0-9\s.,;:+*/=^%()\[\]{}<>|_、。，．；：！？…—－×÷·~√△∵∴°℃①②③④⑤⑥⑦⑧⑨⑩\-]+$"


def meaningless(c: Column) -> Column:
    s = F.trim(F.coalesce(c, F.lit("")))
    return (s != "") & ~s.rlike(MEANINGFUL) & s.rlike(FRAGMENT)


def roman(c: Column) -> Column:
    """Loose Roman numerals up to 12 as OCR leaves them; null if it isn't one."""
    s = F.trim(c)
    up = F.replace(F.upper(s), F.lit("L"), F.lit("I"))
    value = lambda x: F.when(x == "X", 10).when(x == "V", 5).otherwise(1)
    letters = F.filter(F.split(up, ""), lambda x: x != "")
    # a smaller letter before a larger one counts against it
    total = F.aggregate(
        F.transform(letters, lambda x, i: F.when(value(x) < F.coalesce(value(F.get(letters, i + 1)) * F.when(i + 1 < F.size(letters), 1).otherwise(0), F.lit(0)), -value(x)).otherwise(value(x))), F.lit(0), lambda a, x: a + x
    )
    uni = F.aggregate(F.transform(F.filter(F.split(s, ""), lambda x: x != ""), lambda x: F.instr(F.lit("ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ"), x)), F.lit(0), lambda a, x: a + x)
    out = (
        F.when(s.rlike("^[Ⅰ-Ⅹ]+$"), uni)
        .when(s.rlike("^[ILil]{2}$") & s.rlike("[Ll]"), 3)
        .when(s.rlike("^[Ii]{2}$"), 2)
        .when(s.rlike("^1[il1]?$"), F.when(F.length(s) == 3, 3).otherwise(2))
        .when(up.rlike("^[IVX]+$"), total)
    )
    return F.when((out > 0) & (out <= 12), out).cast("int")


def sequence_spec(c: Column) -> Column:
    """``1-3,7`` to sorted distinct numbers; null if any part is wrong, beyond 300 or longer than 60."""
    parts = F.filter(F.split(F.trim(F.coalesce(c, F.lit(""))), r"[,，、;；\s]+"), lambda x: x != "")
    a = lambda x: F.regexp_extract(x, r"^(\d{1,3})", 1).try_cast("int")
    b = lambda x: F.coalesce(F.regexp_extract(x, r"^\d{1,3}\s*[-~～]\s*(\d{1,3})$", 1).try_cast("int"), a(x))
    fine = lambda x: x.rlike(r"^\d{1,3}(\s*[-~～]\s*\d{1,3})?$") & F.coalesce((a(x) >= 1) & (b(x) <= 300) & (a(x) <= b(x)) & (b(x) - a(x) < 60), F.lit(False))
    ok = (F.size(parts) > 0) & F.forall(parts, fine)
    all_ = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda x: F.when(fine(x), F.sequence(a(x), b(x))).otherwise(F.array().cast("array<int>"))))))
    return F.when(ok & (F.size(all_) <= 60), all_)


# Headings that begin a worked solution.
SOLUTION_HEADINGS = "解析|详解|解答|分析|解题过程"


def answer_parts(c: Column) -> tuple[Column, Column]:
    """Answer and solution, split at the first heading line that has text after it; else all is answer."""
    lines = F.split(F.coalesce(c, F.lit("")), "\n")
    heading = rf"^\s*([【\[]\s*({SOLUTION_HEADINGS})\s*[】\]]\s*[:：]?|({SOLUTION_HEADINGS})\s*[:：])"
    at = F.array_position(F.transform(lines, lambda x: x.rlike(heading)), True)
    rest = F.concat(F.array(F.regexp_replace(F.get(lines, (at - 1).cast("int")), heading, "")), F.slice(lines, (at + 1).cast("int"), F.greatest(F.size(lines) - at, F.lit(0)).cast("int")))
    solution = F.when(at > 0, F.regexp_replace(F.array_join(rest, "\n"), r"^\s+|\s+$", "")).otherwise("")
    before = F.regexp_replace(F.array_join(F.slice(lines, 1, F.greatest(at - 1, F.lit(0)).cast("int")), "\n"), r"^\s+|\s+$", "")
    whole = F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    return F.when(solution != "", before).otherwise(whole), solution


# Item starts, question signals and options of the input guard, and its limits.
ITEM_START = r"(?:^|\n)[ \t]*(?:[（(]\s*[）)]\s*)?(?:(?:[（(]\s*)?\d{1,3}\s*[）)]|\d{1,3}\s*[．.、]|\d{1,3}\s*[)）])[ \t]*"
ASK_HINT = "[?？]|下列|以下|正确的是|错误的是|不正确|是否|能否|求|证明|说明|多少|最小值|最大值|取值范围|周长|面积|填空|选择|选项|计算|化简|解方程"
OPTION = r"(?:^|[^\w])(?:[A-D]\s*[．.、)）])"
GUARD_LONGEST, GUARD_SHORTEST, GUARD_ITEMS = 1200, 25, 1


def input_guard(c: Column) -> Column:
    """too_long, multi_item, not_a_question or empty: the first reason that holds."""
    q = F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n")
    signal = q.rlike(ASK_HINT) | (F.regexp_count(q, F.lit(OPTION)) >= 2) | q.rlike(r"_{3,}|（\s*）|\(\s*\)")
    return F.when(F.length(q) > GUARD_LONGEST, "too_long").when(F.regexp_count(q, F.lit(ITEM_START)) > GUARD_ITEMS, "multi_item").when((F.length(q) < GUARD_SHORTEST) | ~signal, "not_a_question").otherwise("")


# Numbers of sections, and an item of a sectioned list of questions.
SECTIONS = "一二三四五六七八九十"
SECTION_MARK = r"([（(]?[一二三四五六七八九十][)）]?)\s*[、.．:：]\s*(?=\d)"
SECTION_ITEM = r"^(?:[（(]\s*([一二三四五六七八九十])\s*[)）]|[（(]?\s*([一二三四五六七八九十])\s*[、.．:：]?)\s*(\d{1,3})(?:\s*[-~～]\s*(\d{1,3}))?$"
PLAIN_ITEM = r"^(\d{1,3})(?:\s*[-~～]\s*(\d{1,3}))?$"


def sectioned_spec(c: Column) -> Column:
    """``一6,二5-7,3`` to structs (section, label) in order, section null for plain numbers; null if a part is wrong, beyond 300 or
    longer than 60, if there are more than 60, or if no part has a section."""
    bare = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), SECTION_MARK, "$1")
    parts = F.filter(F.split(bare, r"[,，、;；\s]+"), lambda x: x != "")

    def item(x: Column) -> Column:
        of = lambda pattern, k: F.regexp_extract(x, pattern, k)
        named = x.rlike(SECTION_ITEM)
        section = F.when(named, F.concat(of(SECTION_ITEM, 1), of(SECTION_ITEM, 2)))
        a = F.when(named, of(SECTION_ITEM, 3)).otherwise(of(PLAIN_ITEM, 1)).try_cast("int")
        b = F.coalesce(F.when(named, of(SECTION_ITEM, 4)).otherwise(of(PLAIN_ITEM, 2)).try_cast("int"), a)
        fine = F.coalesce((a >= 1) & (b <= 300) & (a <= b) & (b - a < 60), F.lit(False))
        return F.struct(section.alias("section"), a.alias("a"), b.alias("b"), fine.alias("fine"))

    items = F.transform(parts, item)
    labels = F.flatten(F.transform(items, lambda i: F.transform(F.when(i["fine"], F.sequence(i["a"], i["b"])).otherwise(F.array().cast("array<int>")), lambda n: F.struct(i["section"].alias("section"), n.alias("label")))))
    ok = (F.size(parts) > 0) & F.forall(items, lambda i: i["fine"]) & F.exists(items, lambda i: i["section"].isNotNull()) & (F.size(labels) <= 60)
    return F.when(ok, labels)


# Numbers of a text, and how near a window must come to a line.
NUMBER, LINE_ERROR = r"\d+(?:\.\d+)?", 0.25


def number_recall(reference: Column, read: Column) -> tuple[Column, Column]:
    """How many numbers a reference has (each place), and how many of them are in what was read."""
    numbers, flat = F.regexp_extract_all(F.coalesce(reference, F.lit("")), F.lit(NUMBER), 0), folded(read)
    return F.size(numbers), F.size(F.filter(numbers, lambda n: F.contains(flat, n)))


def line_read(line: Column, read: Column) -> Column:
    """Whether a line comes up in what was read, with a character error of at most LINE_ERROR: in any window of three quarters to 1.4 of its length."""
    n, most_edits = F.length(line), F.floor(F.length(line) * LINE_ERROR).cast("int")
    least, most = F.greatest(F.lit(1), F.floor(n * 0.75).cast("int")), F.least(F.length(read), F.ceil(n * 1.4).cast("int"))
    sizes = F.when(least <= most, F.sequence(least, most, F.greatest(F.lit(1), F.floor(n / 6).cast("int")))).otherwise(F.array().cast("array<int>"))
    # distances beyond the allowed edits aren't worked out (-1), and the first window that is near enough ends the search
    near = lambda w: F.exists(F.sequence(F.lit(1), F.length(read) - w + 1), lambda i: F.call_function("levenshtein", line, F.substring(read, i, w), most_edits) >= 0)
    return F.contains(read, line) | F.exists(sizes, near)


def line_recall(reference: Column, read: Column) -> tuple[Column, Column]:
    """How many lines a reference has, and how many come up in what was read with an error of at most LINE_ERROR."""
    lines = F.filter(F.transform(F.split(F.coalesce(reference, F.lit("")), "\n"), folded), lambda x: x != "")
    # both are bound to a variable, so that they are folded once and not for every window
    hit = F.transform(F.array(F.struct(lines.alias("lines"), folded(read).alias("read"))), lambda b: F.size(F.filter(b["lines"], lambda x: line_read(x, b["read"]))))
    return F.size(lines), F.get(hit, F.lit(0))


def similarity(plain: Column, tags_a: Column, tags_b: Column) -> Column:
    """Dice of bigrams (null: 0); where both have tags, 0.7 of it and 0.3 of the tags' Dice."""
    plain = F.coalesce(plain, F.lit(0.0))
    return F.when((F.size(tags_a) > 0) & (F.size(tags_b) > 0), 0.7 * plain + 0.3 * dice(F.array_distinct(tags_a), F.array_distinct(tags_b))).otherwise(plain)
