"""Reading order of lines on a page, and which question is part of which."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

# Gaps in line heights that part columns and paragraphs, depth of cuts, and lines worth cutting.
COLUMN_GAP, PARAGRAPH_GAP, DEEPEST, FEWEST, ROW_SHARE = 1.5, 0.6, 6, 2, 0.6
# Phrases that announce sub-questions.
SUB_HINT = "(完成|回答|阅读下面|阅读下列|阅读下面的文字|阅读下列材料|根据材料|结合[材文]|按要求|请回答|回答下列)"


def widest_gap(lo: np.ndarray, hi: np.ndarray, least: float) -> float | None:
    """The middle of the widest stretch that no interval covers, if it is wide enough; the first of equals."""
    by = np.lexsort((hi, lo))
    reach = np.maximum.accumulate(hi[by])[:-1]
    gap = lo[by][1:] - reach
    k = int(gap.argmax()) if len(gap) else 0
    return float(reach[k] + gap[k] / 2) if len(gap) and gap[k] >= max(least, 1e-9) else None


def rows_in_order(box: np.ndarray, idx: np.ndarray, height: float) -> list[int]:
    """Lines by visual row, and by x inside a row; a row's head sets its height."""
    mid = (box[:, 1] + box[:, 3]) / 2
    rows: list[list[int]] = []
    for i in idx[np.lexsort((box[idx, 0], mid[idx]))].tolist():
        near = ROW_SHARE * min(height, max(1.0, box[i, 3] - box[i, 1]))
        if rows and abs(mid[i] - mid[rows[-1][0]]) <= near:
            rows[-1].append(i)
        else:
            rows.append([i])
    return [i for r in rows for i in sorted(r, key=lambda k: (box[k, 0], k))]


def cut_order(box: np.ndarray, idx: np.ndarray, height: float, depth: int = 0) -> list[int]:
    """Columns before paragraphs: cut at the widest gap until there is none, then row by row."""
    if len(idx) >= FEWEST and depth < DEEPEST:
        for axis, ratio in ((0, COLUMN_GAP), (1, PARAGRAPH_GAP)):
            at = widest_gap(box[idx, axis], box[idx, axis + 2], ratio * height)
            if at is not None:
                first = box[idx, axis + 2] <= at
                return cut_order(box, idx[first], height, depth + 1) + cut_order(box, idx[~first], height, depth + 1)
    return rows_in_order(box, idx, height)


def reading_order(lines: DataFrame, page: str) -> DataFrame:
    """page, id, place: boxes x0, y0, x1, y1 of each page in the order in which they are read."""

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        box = pdf[["x0", "y0", "x1", "y1"]].to_numpy(float)
        height = float(np.median(np.maximum(box[:, 3] - box[:, 1], 1)))
        ids = pdf["id"].to_numpy()[cut_order(box, np.arange(len(box)), height)]
        return pd.DataFrame({page: pdf[page].iloc[0], "id": ids, "place": np.arange(len(ids))})

    return lines.select(page, "id", "x0", "y0", "x1", "y1").groupBy(page).applyInPandas(order, f"{page} long, id long, place long")


def parents(kinds: list[str], nums: list, ranges: list, hints: list[bool]) -> list[int | None]:
    """Index of each question's parent by numbering: sections hold the numbers that run on below them."""
    major = {"cjk", "paren-cjk", "part"}
    out: list[int | None] = [None] * len(kinds)
    heads = [i for i, k in enumerate(kinds) if k in major]
    if not heads:
        head, due = None, 1
        for i, (k, n) in enumerate(zip(kinds, nums, strict=True)):
            if k == "circled" and head is not None and n == due:
                out[i], due = head, due + 1
            elif k != "none":
                head, due = i, 1
        return out
    for h, end in zip(heads, [*heads[1:], len(kinds)], strict=True):
        inside = range(h + 1, end)
        minor = [kinds[i] for i in inside if kinds[i] in ("arabic", "circled")]
        if not minor:
            for i in inside if hints[h] else ():
                out[i] = h
            continue
        span = ranges[h]
        kind = "arabic" if span else max(dict.fromkeys(minor), key=minor.count)
        holder, due = h, span[0] if span else None
        for i in inside:
            n = nums[i]
            if kinds[i] != kind or n is None:
                continue
            if span:
                if n == due and n <= span[1]:
                    out[i], due = h, n + 1
            elif due is None or n == due:
                out[i], due = holder, n + 1
            else:  # a run has ended: this one belongs to the section and holds those after it
                out[i], holder, due = h, i, None
    return out


def hierarchy(items: DataFrame, page: str, order: str, body: str) -> DataFrame:
    """page, place, parent_place (null at the top), level, full: with the bodies of all parents before the item's own."""
    kind, num = text.numbering(F.col(body))
    lo, hi = text.declared_range(F.coalesce(F.col(body), F.lit("")))
    x = items.select(page, order, F.coalesce(F.trim(body), F.lit("")).alias("body"), kind.alias("kind"), num.alias("num"), lo.alias("lo"), hi.alias("hi"), F.coalesce(F.col(body), F.lit("")).rlike(SUB_HINT).alias("hint"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order).reset_index(drop=True)
        nums = [None if pd.isna(n) else int(n) for n in pdf["num"]]
        spans = [None if pd.isna(a) else (int(a), int(b)) for a, b in zip(pdf["lo"], pdf["hi"], strict=True)]
        up = parents(pdf["kind"].tolist(), nums, spans, pdf["hint"].tolist())
        full: list[str] = []
        for i, b in enumerate(pdf["body"]):  # a parent stands before its children
            above = full[up[i]] if up[i] is not None else ""
            full.append(above if not b else b if not above or above[:200] in b else f"{above}\n{b}")
        place = pdf[order].tolist()
        return pd.DataFrame({page: pdf[page].iloc[0], "place": place, "parent_place": pd.array([None if p is None else place[p] for p in up], "Int64"), "level": [1 if p is None else 2 for p in up], "full": full})

    return x.groupBy(page).applyInPandas(fold, f"{page} long, place long, parent_place long, level long, full string")
