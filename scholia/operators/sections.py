"""Question units of a page, the tree of sections they stand in, and the repair of their number sequences.

A page is text regions (page, id, col, x0, y0, x1, y1, body).  Tokens that look like numbers of questions become units; title
lines cut the page into sections and subsections; each unit goes to a subsection by column and height; each section counts
through or anew in every subsection.  In a sequence, what is missing is looked for among regions that hold the bare number
or have lost it, a number that lost its first digit is corrected, and what comes twice goes.

All but the repair are joins and windows within pages; the repair is an ordered walk, for each page in one task.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .graph import cut

# The forms of numbers in a line; numbers of three digits and more are none.
HAN = "一二三四五六七八九十"
SMALL_CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"
FORMS = [
    rf"[（(]\s*[{HAN}]{{1,3}}\s*[）)]", rf"[{HAN}]{{1,3}}\s*[、，,．.]", "[①-⑳]", r"[Ⅰ-Ⅹ]+\s*\.", r"[（(]\s*\d{1,2}\s*[）)]", r"\d{3,}(?!\d)\s*[.、．)）]",
    r"\d{1,2}(?!\d)\s*[.、．)）](?!\d)", r"\d{1,2}(?!\d)(?=\s+[a-z]{1,5}(?![A-Za-z]))", r"^\d{1,3}(?=[A-Za-z一-龥])", r"\d{1,2}\z",
]
#: What every one of them holds.
NUMERAL = rf"[\d{HAN}①-⑳Ⅰ-Ⅹ]"
OPTION = r"(?<![（(])[A-E]\s*[.、，,．)）]"
UNIT_WORD = r"(?i)(?:unit|section|part|lesson|book|grade|class|page|line|activity|project|topic|module|step|stage)\s*\z"
YEAR_WORD = r"(?i)\b(?:in|on|at|since|by|for|before|after|during|until)\s*\z"
ABOUT_WORD = r"(?i)\b(?:about|around|nearly|almost|approximately)\s*\z"
MEASURE = r"(?i)\A\s+(?:years?|months?|weeks?|days?|hours?|minutes?|seconds?|times?|percent|dollars?|cents?|miles?|meters?|metres?|kilometers?|kilometres?|kilos?|kilograms?)\b"
CLOCK = r"(?i)\A\s*o'?clock"
SENTENCE = r"[A-Za-z一-龥]\s*[,，;；]?\s*\z"
# Lines that are titles of sections and of subsections.
TITLES = [r"^【\s*([^】\s]{1,12})\s*】$", rf"^第\s*([{HAN}\d]{{1,3}})\s*[部分编章]$", r"^([一-龥]{1,8})\s*[案卷]$"]
ROMAN_TITLE = r"^([Ⅰ-Ⅹ]{1,5}|[IVXilL]{1,5}|1[il1]?)\s*[.、．]?\s*(.+)$"
INSTRUCTION = "(根据|按照|用[^，。；;]{0,14}填空|选词|阅读|翻译|汉译英|英译汉|译成|写作|完成句子|仿写|改写|回答问题|判断|连线|匹配|仿照)"
INSTRUCTION_LATIN = "(?i)(reading|choose|choosing|cloze|fill|translat|writ|complet|match|answer|put)"
EDGE = r"[\s.、．,，:：;；]+"
ROMAN = "ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪⅫ"
CONTINUED = "前页续"
# Shares of the column that bare and lost numbers stand in, of the median height that they have at least, and
# how many numbers are looked for behind the last one.
BARE_LEFT, LOST_LEFT, LEAST_HEIGHT, BEHIND = 0.35, 0.25, 0.55, 13
LOST = re.compile(r"[.。．、]\s*[A-Za-z一-龥]|[a-z]{2,15}→")
MISREAD = re.compile(r"[A-Za-z\W_]{1,2}(\d{1,2})")


def _bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), where c is worked out once and not wherever f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def tokens(s: Column) -> Column:
    """array<at, raw, number>: what looks like numbers of questions in a text, at: characters before; null is empty."""
    s = F.coalesce(s, F.lit(""))
    split = rf"(?s)(.*?)({'|'.join(FORMS)})"

    def placed(parts: Column) -> Column:
        end = lambda i: F.aggregate(F.slice(parts, 1, i + 1), F.lit(0), lambda a, x: a + x["size"])
        return F.transform(parts, lambda r, i: F.struct((end(i) - F.length(r["raw"])).alias("at"), r["raw"].alias("raw")))

    def known(t: Column, option_end: Column) -> Column:
        raw, head = t["raw"], F.substring(s, F.lit(1), t["at"])
        rest = F.substring(s, t["at"] + F.length(raw) + 1, F.length(s))
        number, bare = F.regexp_extract(raw, r"\d+", 0).try_cast("int"), raw.rlike(r"\A\d+\z")
        glued, last = bare & (t["at"] == 0) & rest.rlike(r"\A[A-Za-z一-龥]"), bare & (rest == "")
        free = option_end.isNull() | (t["at"] < option_end)
        sentence = ~head.rlike(r"\d\z") & ~rest.rlike(CLOCK) & ~head.rlike(UNIT_WORD) & ~((number > 20) & head.rlike(YEAR_WORD)) & ~head.rlike(ABOUT_WORD) & ~rest.rlike(MEASURE)
        arabic = F.when(raw.rlike(r"\A\d{3,}\D"), False).when(raw.rlike(r"\A[（(]"), free).when(~bare, free & ~((number > 20) & rest.rlike(r"\A[A-Za-z]\z"))).when(glued, True).when(last, free & head.rlike(SENTENCE)).otherwise(free & sentence)
        return F.coalesce(~raw.rlike(r"\d") | arabic, F.lit(False))

    def numbered(t: Column) -> Column:
        raw = t["raw"]
        han, circled = F.regexp_extract(raw, f"[{HAN}]+", 0), F.instr(F.lit(SMALL_CIRCLED), raw)
        value = F.when(han != "", text.han_number(han)).when(raw.rlike("^[①-⑳]$"), circled).when(raw.rlike("^[Ⅰ-Ⅹ]"), F.when(raw.rlike(r"^[Ⅰ-Ⅹ]\s*\.$"), F.instr(F.lit(ROMAN), F.substring(raw, 1, 1))).otherwise(0)).otherwise(F.regexp_extract(raw, r"\d+", 0).try_cast("int"))
        return F.struct(t["at"].alias("at"), F.trim(raw).alias("raw"), value.cast("int").alias("number"))

    parts = F.zip_with(F.regexp_extract_all(s, F.lit(split), F.lit(1)), F.regexp_extract_all(s, F.lit(split), F.lit(2)), lambda g, r: F.struct((F.length(g) + F.length(r)).alias("size"), r.alias("raw")))
    option = _bound(F.regexp_instr(s, F.lit(OPTION)), lambda at: F.when(at > 0, at - 1 + F.length(F.regexp_substr(s, F.lit(OPTION)))))
    good = _bound(option, lambda end: F.filter(_bound(parts, placed), lambda t: known(t, end)))
    return F.when(s.rlike(NUMERAL), F.transform(good, numbered)).otherwise(F.array().cast("array<struct<at: int, raw: string, number: int>>"))


def _title(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(s, "^" + EDGE, ""), EDGE + "$", ""))


def headers(regions: DataFrame) -> DataFrame:
    """page, id, col, y0, y1, kind (section, subsection), roman, title of the lines that are titles."""
    s = F.trim(F.coalesce("body", F.lit("")))
    section = F.coalesce(*(F.nullif(F.regexp_extract(s, p, 1), F.lit("")) for p in TITLES))
    parts = F.struct(s.alias("s"), section.alias("section"), F.regexp_extract(s, ROMAN_TITLE, 1).alias("prefix"), _title(F.regexp_extract(s, ROMAN_TITLE, 2)).alias("named"))

    def read(x: Column) -> Column:
        s, prefix, named = x["s"], x["prefix"], x["named"]
        latin, han = (F.length(F.regexp_replace(named, f"[^{c}]", "")) for c in ("A-Za-z", "一-龥"))
        telling = named.rlike(INSTRUCTION)
        looks = F.when(prefix.rlike(r"^\d"), telling & (F.length(named) <= 24)).when(latin > han, named.rlike(INSTRUCTION_LATIN)).otherwise(telling | (F.length(named) <= 12))
        numeral = F.when((prefix != "") & (named != "") & looks, text.roman(prefix))
        plain = (F.length(s) <= 40) & ~s.rlike(r"^\s*[\d（(]") & s.rlike(INSTRUCTION) & (_title(s) != "") & (F.length(_title(s)) <= 36)
        return _bound(numeral, lambda numeral: kinds(x["section"], numeral, plain, named, s))

    def kinds(section: Column, numeral: Column, plain: Column, named: Column, s: Column) -> Column:
        kind = F.when(section.isNotNull(), "section").when(numeral.isNotNull() | plain, "subsection")
        own = F.when(section.isNotNull(), _title(section)).when(numeral.isNotNull(), named).otherwise(_title(s))
        return F.struct(kind.alias("kind"), F.when(section.isNull(), numeral).alias("roman"), own.alias("title"))

    # most lines are no titles by the first look at them, and are looked at no further; outer: nothing is made for a filter first
    maybe = regions.where(s.rlike("|".join([*TITLES, ROMAN_TITLE, INSTRUCTION])))
    return maybe.select("page", "id", "col", "y0", "y1", F.explode_outer(F.transform(F.array(parts), read)).alias("t")).where("t.kind IS NOT NULL").select("page", "id", "col", "y0", "y1", "t.*")


def tree(regions: DataFrame, height: float, titles: DataFrame | None = None) -> DataFrame:
    """page, sec, sub (numbers from 0), sec_title, sec_y0, title, roman, y0, y1, col (null: all columns), lead: the subsections of every page.

    A subsection ends where the next one of its column begins, or its section.  What stands above the first subsection of
    a page is a lead: the rest of a page before.  A subsection that has text in another column, where no other one runs
    beside it, goes over all columns.  A section without subsections is one row with a null sub.
    """
    pages = regions.select("page").distinct()
    by = Window.partitionBy("page").orderBy("y0", "y1", "id")
    h = (headers(regions) if titles is None else titles).withColumn("is_sec", (F.col("kind") == "section").cast("int"))
    h = h.withColumn("count", F.sum("is_sec").over(by)).withColumn("early", F.first("is_sec").over(by) == 0)
    h = h.withColumn("sec", (F.col("count") - F.when(F.col("early"), 0).otherwise(1)).cast("int"))
    own = h.where("is_sec = 1").select("page", "sec", F.col("title").alias("sec_title"), F.col("y0").alias("sec_y0"))
    bare = pages.join(h.where("NOT early").select("page").distinct(), "page", "left_anti").select("page", F.lit(0).alias("sec"), F.lit("").alias("sec_title"), F.lit(0.0).alias("sec_y0"))
    secs = own.unionByName(bare).withColumn("sec_y1", F.coalesce(F.lead("sec_y0").over(Window.partitionBy("page").orderBy("sec")), F.lit(float(height))))

    subs = h.where("is_sec = 0").join(secs.select("page", "sec", "sec_y1"), ["page", "sec"])
    next_ = F.lead("y0").over(Window.partitionBy("page", "sec", "col").orderBy("y0", "y1", "id"))
    subs = subs.withColumn("end", F.coalesce(next_, F.col("sec_y1")))
    leads = secs.where("sec = 0").select("page", "sec").join(subs.groupBy("page", "sec").agg(F.min_by(F.struct("y0", "roman"), F.struct("y0", "y1", "id")).alias("first")), ["page", "sec"], "left")
    leads = leads.select("page", "sec", F.lit(0.0).alias("y0"), F.coalesce("first.y0", F.lit(float(height))).alias("end"), F.when(F.col("first.roman") >= 2, F.col("first.roman") - 1).alias("roman")).where("end > 0")
    every = subs.select("page", "sec", "id", "y0", F.col("y1").alias("b"), "end", "roman", "title", "col", F.lit(False).alias("lead"))
    every = every.unionByName(leads.select("page", "sec", F.lit(None).cast("long").alias("id"), "y0", F.lit(0.0).alias("b"), "end", "roman", F.lit("").alias("title"), F.lit(None).cast("int").alias("col"), F.lit(True).alias("lead")))
    every = every.withColumn("sub", (F.row_number().over(Window.partitionBy("page", "sec").orderBy(F.desc("lead"), "y0", "b", "id")) - 1).cast("int"))

    tall = regions.where(F.trim("body") != "")
    mid = (F.col("y0") + F.col("y1")) / 2
    ink = tall.join(_median(regions), "page").where(F.col("y1") - F.col("y0") >= F.round(LEAST_HEIGHT * F.col("median"))).select("page", F.col("col").alias("ink_col"), mid.alias("mid"))
    away = every.where("col IS NOT NULL").select("page", "sec", "sub", "y0", "end", "col").join(ink, "page").where("mid >= y0 AND mid < end AND ink_col <> col").select("page", "sec", "sub").distinct()
    other = every.where("col IS NOT NULL").select("page", "sec", F.col("y0").alias("o0"), F.col("end").alias("o1"), F.col("col").alias("o_col"))
    beside = every.where("col IS NOT NULL").join(other, ["page", "sec"]).where("o_col <> col AND o0 <= end AND o1 >= y0").select("page", "sec", "sub").distinct()
    wide = away.join(beside, ["page", "sec", "sub"], "left_anti").withColumn("wide", F.lit(True))
    every = every.join(wide, ["page", "sec", "sub"], "left").withColumn("col", F.when(F.col("wide").isNull(), F.col("col")))
    return secs.join(every, ["page", "sec"], "left").select("page", "sec", "sub", "sec_title", "sec_y0", "title", "roman", "y0", F.col("end").alias("y1"), "col", "lead")


def _median(regions: DataFrame) -> DataFrame:
    return regions.groupBy("page").agg(F.percentile(F.col("y1") - F.col("y0"), 0.5).alias("median"))


def units(regions: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """page, id, nth, number, sig (up to two characters before the number, and it), ax, ay, col: numbers in regions that are no titles."""
    titles = headers(regions) if titles is None else titles
    found = regions.join(titles.select("page", "id"), ["page", "id"], "left_anti").select("*", F.posexplode_outer(tokens(F.col("body"))).alias("nth", "t")).where("t.number IS NOT NULL")  # outer: tokens aren't made for a filter first
    size = F.greatest(F.length("body"), F.lit(1))
    sig = F.concat(F.substring("body", F.greatest(F.col("t.at") - 1, F.lit(1)), F.least(F.col("t.at"), F.lit(2))), "t.raw")
    return found.select("page", "id", "nth", "t.number", sig.alias("sig"), (F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("t.at") / size).alias("ax"), ((F.col("y0") + F.col("y1")) / 2).alias("ay"), "col")


def placed(found: DataFrame, subs: DataFrame) -> DataFrame:
    """The units with sec and sub: the last subsection of their section that holds them in their column, else that began above in their column, else that began above at all."""
    secs = subs.select("page", "sec", "sec_y0").distinct()
    at = found.join(secs, "page").groupBy(*(found[c] for c in found.columns)).agg(F.coalesce(F.max(F.when(F.col("sec_y0") <= F.col("ay"), F.col("sec"))), F.lit(0)).alias("sec"))
    own = subs.select("page", "sec", "sub", "y0", "y1", F.col("col").alias("sub_col"))
    here = F.col("sub_col").isNull() | (F.col("sub_col") == F.col("col"))
    began = F.col("y0") <= F.col("ay")
    level = F.when(here & began & (F.col("ay") < F.col("y1")), 3).when(here & began, 2).when(began, 1).when(F.col("sub") == 0, 0)
    return at.join(own, ["page", "sec"]).groupBy(*(F.col(c) for c in [*found.columns, "sec"])).agg(F.max(F.when(level.isNotNull(), F.struct(level.alias("level"), F.col("sub").alias("sub"))))["sub"].alias("sub"))


def ordered(found: DataFrame, regions: DataFrame) -> DataFrame:
    """The units with pos, their place in reading order: by column, where a page has several; else by bands of heights and from left to right."""
    many = regions.groupBy("page").agg((F.countDistinct("col") > 1).alias("many")).join(_median(regions), "page")
    x = found.join(many, "page")
    down = Window.partitionBy("page").orderBy("ay", "ax", "id", "nth")
    step = F.col("ay") - F.lag("ay").over(down)
    x = x.withColumn("starts", F.coalesce((step > F.greatest(F.lit(8.0), 0.8 * F.col("median"))).cast("int"), F.lit(1))).withColumn("band", F.sum("starts").over(down))
    line = lambda a, b: F.when(F.col("many"), a).otherwise(b)
    order = [line(F.col("col").cast("double"), F.col("band").cast("double")), line(F.col("ay"), F.col("ax")), line(F.col("ax"), F.col("ay")), "id", "nth"]
    return x.withColumn("pos", F.row_number().over(Window.partitionBy("page").orderBy(*order))).drop("many", "median", "starts", "band")


def numbering(units_in_order: DataFrame) -> DataFrame:
    """page, sec, unified: whether a section counts through all its subsections: more of their borders go on than begin at 1."""
    ends = units_in_order.groupBy("page", "sec", "sub").agg(F.min_by("number", "pos").alias("first"), F.max_by("number", "pos").alias("last"))
    subs = Window.partitionBy("page", "sec").orderBy("sub")
    border = ends.withColumn("before", F.when(F.lag("sub").over(subs) == F.col("sub") - 1, F.lag("last").over(subs)))
    anew, on = (F.col("first") == 1) & (F.col("before") >= 1), F.col("first") == F.col("before") + 1
    return border.groupBy("page", "sec").agg(F.coalesce(F.count_if(on & ~anew) > F.count_if(anew), F.lit(False)).alias("unified"))


def _structure(regions: DataFrame, height: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Title lines, subsections and the units in order; each is used several times, so each is written once."""
    titles = cut(headers(regions))
    subs = cut(tree(regions, height, titles))
    return titles, subs, cut(ordered(placed(cut(units(regions, titles)), subs), regions))


def questions(regions: DataFrame, height: float) -> DataFrame:
    """page, id, nth, number, sec, sub, unified, label: the units of every page with the titles they stand under; sub and label are null in a section without subsections."""
    _, subs, found = _structure(regions, height)
    first = found.groupBy("page", "sec", "sub").agg(F.min_by("number", "pos").alias("first"))
    titles = subs.where("sub IS NOT NULL").join(first, ["page", "sec", "sub"], "left")
    lead = F.col("lead") & ~(F.coalesce(F.col("first"), F.lit(0)) == 1)  # what begins with 1 isn't the rest of a page before
    numeral = F.when(~F.col("lead") & F.col("roman").isNotNull(), F.concat(F.substring(F.lit(ROMAN), F.col("roman"), F.lit(1)), F.lit("."))).otherwise("")
    name = F.regexp_replace(F.concat(numeral, F.when(F.col("title") != "", F.col("title")).when(lead, CONTINUED).otherwise("")), EDGE + "$", "")
    name = F.when(F.length(name) > 12, F.concat(F.substring(name, 1, 12), F.lit("…"))).otherwise(name)
    titles = titles.select("page", "sec", "sub", F.concat_ws("·", F.nullif("sec_title", F.lit("")), F.nullif(name, F.lit(""))).alias("name"))
    out = found.join(numbering(found), ["page", "sec"]).join(titles, ["page", "sec", "sub"], "left")
    return out.select("page", "id", "nth", "number", "sec", "sub", "unified", F.concat(F.col("name"), F.lit(" "), F.col("number").cast("string")).alias("label"))


def misread(sig: str, expected: int) -> bool:
    """Whether the mark of a number is the expected one without its first digit, which became a letter or a sign."""
    m = MISREAD.match(sig)
    if expected < 10 or not m:
        return False
    got = int(m[1])
    return got < expected and got == (expected % 100 if got >= 10 else expected % 10)


def walk(rows: list, y0: float, y1: float, height: float, finds) -> dict[str, list]:
    """One sequence: rows (number, sig, ay, col, id, nth) in order; finds(number, from, to, column or None): bottom of a region that shows it, or None."""
    out: dict[str, list] = {"seq": [], "gaps": [], "duplicates": [], "injected": [], "repairs": []}
    expected, low, col = 1, y0, None
    for r in rows:
        if r.number < expected:
            if not misread(r.sig, expected):
                out["duplicates"].append(r.number)
                continue
            out["repairs"].append({"id": r.id, "nth": r.nth, "number": expected})
        else:
            back = col is not None and r.ay < low  # in the next column: what is missing stood below in the one before
            to, among = (height, col) if back else (r.ay, None)
            for missing in range(expected, r.number):
                bottom = finds(missing, low, to, among)
                out["gaps" if bottom is None else "injected"].append(missing)
                if bottom is not None:
                    out["seq"].append(missing)
                    low = bottom
            expected = r.number
        out["seq"].append(expected)
        expected, low, col = expected + 1, r.ay, r.col
    for missing in range(expected, expected + BEHIND):
        bottom = finds(missing, low, y1, None)
        if bottom is None:
            break
        out["injected"].append(missing)
        out["seq"].append(missing)
        low = bottom
    return out


def repaired(regions: DataFrame, height: float, columns: list[tuple[float, float]]) -> DataFrame:
    """page, sec, sub (null: the whole section counts through), seq, gaps, duplicates, injected, repairs: every number sequence of every page.

    columns: where each column begins and ends.  A subsection without a unit has a sequence of what is found in it.
    """
    titles, subs, found = _structure(regions, height)
    subs = subs.where("sub IS NOT NULL")
    spaces = subs.join(numbering(found), ["page", "sec"], "left").select("page", "sec", "sub", "y0", "y1", F.coalesce("unified", F.lit(False)).alias("unified"))
    titles = titles.select("page", "id", F.lit(True).alias("titled"))
    shown = regions.join(titles, ["page", "id"], "left").where("titled IS NULL").join(_median(regions), "page").where(F.col("y1") - F.col("y0") >= F.round(LEAST_HEIGHT * F.col("median")))
    stripped = F.trim("body")
    shown = shown.where(stripped.rlike(rf"^\d{{1,2}}$|^(?:{LOST.pattern})")).select("page", "id", "col", "x0", "x1", "y0", "y1", stripped.alias("body"))
    kinds = [
        found.select("page", F.lit(0).alias("kind"), "id", "nth", "number", "sig", "ay", "col", "sec", "sub", "pos"),
        shown.select("page", F.lit(1).alias("kind"), "id", "x0", "x1", "y0", "y1", "col", F.col("body").alias("sig")),
        spaces.select("page", F.lit(2).alias("kind"), "sec", "sub", "y0", "y1", "unified"),
    ]
    rows = kinds[0].unionByName(kinds[1], allowMissingColumns=True).unionByName(kinds[2], allowMissingColumns=True)

    def repair(pdf: pd.DataFrame) -> pd.DataFrame:
        page = pdf["page"].iloc[0]
        own = list(pdf[(pdf["kind"] == 0) & pdf["sub"].notna()].sort_values("pos").astype({c: int for c in ("id", "nth", "number", "sec", "sub", "col")}).itertuples())
        bare = list(pdf[pdf["kind"] == 1].sort_values("id").itertuples())
        used: set[int] = set()

        def finds(number: int, low: float, high: float, col: int | None) -> float | None:
            if number > 99:
                return None
            for lost in (False, True):
                for r in bare:
                    if r.id in used or r.y1 < low or r.y0 > high or (lost != (LOST.match(r.sig) is not None)) or not (lost or r.sig == str(number)):
                        continue
                    a, b = columns[int(r.col)]
                    at, share = (r.x0, LOST_LEFT) if lost else ((r.x0 + r.x1) / 2, BARE_LEFT)
                    if at <= a + (b - a) * share and (not lost or col is None or col == r.col):
                        used.add(r.id)
                        return r.y1
            return None

        out = []
        of_page = pdf[pdf["kind"] == 2].sort_values(["sec", "sub"])
        for sec, all_ in of_page.groupby("sec"):
            unified = bool(all_["unified"].iloc[0])
            for part in [all_] if unified else [all_.iloc[k : k + 1] for k in range(len(all_))]:
                mine = set(part["sub"].astype(int))
                got = walk([u for u in own if u.sec == sec and u.sub in mine], part["y0"].iloc[0], part["y1"].iloc[-1], height, finds)
                out.append({"page": page, "sec": int(sec), "sub": None if unified else int(part["sub"].iloc[0]), **got})
        return pd.DataFrame(out, columns=["page", "sec", "sub", "seq", "gaps", "duplicates", "injected", "repairs"])

    schema = "page long, sec int, sub int, seq array<int>, gaps array<int>, duplicates array<int>, injected array<int>, repairs array<struct<id: long, nth: int, number: int>>"
    return rows.groupBy("page").applyInPandas(repair, schema)
