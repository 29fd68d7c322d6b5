"""Boxes of recognised lines: bounds, column split and reading order; the whole pages of an Arrow batch at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounds(box) -> list:
    """xmin, xmax, ymin, ymax of a polygon column."""
    x, y = F.transform(box, lambda p: p[0]), F.transform(box, lambda p: p[1])
    return [F.array_min(x).alias("xmin"), F.array_max(x).alias("xmax"), F.array_min(y).alias("ymin"), F.array_max(y).alias("ymax")]


def split_bounds(w, h) -> list:
    """Whether an image is a double page, and the column ranges of its halves."""
    mid, over = F.floor(w / 2), F.floor(w * 0.03)
    return [(w > h * 1.15).alias("is_double_page"), F.lit(0).cast("long").alias("left_from"), F.least(w, mid + over).cast("long").alias("left_to"), F.greatest(F.lit(0), mid - over).cast("long").alias("right_from"), w.cast("long").alias("right_to")]


def scaled_size(w, h, most: int = 2560) -> list:
    """Width and height after the longer side is brought down to most; 0 leaves them."""
    side = F.greatest(w, h)
    scale = F.lit(float(most)) / side
    cut = (F.lit(most) > 0) & (side > most)
    return [F.when(cut, F.floor(w * scale)).otherwise(w).cast("long").alias("width"), F.when(cut, F.floor(h * scale)).otherwise(h).cast("long").alias("height"), cut.alias("resized")]


#: Places of the gutter that are tried, between 35 and 65 % of a page's width.
GUTTERS = 30


def _splits(b: np.ndarray, page: np.ndarray, first: np.ndarray, n: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The gutter of each page of two columns: five boxes on each side and the fewest across it; nan for other pages."""
    best, gutter = np.full(len(n), np.inf), np.full(len(n), np.nan)
    for k in range(GUTTERS):
        s = 0.35 * w + k * (0.3 * w / GUTTERS)
        near = s[page] + 10
        cross = (b[:, 0] < s[page] - 10) & (b[:, 1] > near)
        crossings = np.add.reduceat(cross.astype(np.int64), first)
        lefts = np.add.reduceat((~cross & (b[:, 1] <= near)).astype(np.int64), first)
        better = (lefts >= 5) & (n - lefts - crossings >= 5) & (crossings < best)
        best[better], gutter[better] = crossings[better], s[better]
    gutter[best > np.maximum(3, 0.15 * n)] = np.nan
    return gutter


def reading_places(b: np.ndarray, page: np.ndarray) -> np.ndarray:
    """The place of each box (xmin, xmax, ymin, ymax) in its page, the pages numbered from 0 and one behind the other.

    Headers, left column, right column, footers; in each top to bottom, boxes that overlap the one before by over 0.35 of
    the lower height on one line with it, left to right. Equal ones stay in their order. Two boxes go top to bottom.
    """
    if not len(b):
        return np.empty(0, np.int64)
    first = np.flatnonzero(np.r_[True, page[1:] != page[:-1]])
    n = np.diff(np.r_[first, len(b)])
    w, h = np.maximum.reduceat(b[:, 1], first), np.maximum.reduceat(b[:, 3], first)[page]
    x0, x1, y0, y1 = b.T
    s = _splits(b, page, first, n, w)[page]
    y = (y0 + y1) / 2
    across = np.select([y < 0.25 * h, y > 0.85 * h, (x0 + x1) / 2 < s], [0, 3, 1], 2)
    part = np.where(np.isnan(s), 0, np.where((x0 < s - 15) & (x1 > s + 15), across, np.where(x1 <= s + 15, 1, 2)))
    down = np.lexsort((x0, y0, part, page))
    top, low, of = y0[down], y1[down], page[down] * 4 + part[down]
    shared = np.minimum(low[1:], low[:-1]) - np.maximum(top[1:], top[:-1])
    height = np.maximum(np.minimum(low[1:] - top[1:], low[:-1] - top[:-1]), 1)
    same = (of[1:] == of[:-1]) & (shared / height > 0.35) & (shared > 0)
    line = np.cumsum(np.r_[True, ~same])
    read = down[np.lexsort((x0[down], line))]
    few = n[page] <= 2
    if few.any():
        read = np.where(few, np.lexsort((y0, page)), read)  # a page's places are the same in both
    places = np.empty(len(b), np.int64)
    places[read] = np.arange(len(b)) - first[page]
    return places


def reading_order(b: np.ndarray) -> list[int]:
    """The order in which boxes (xmin, xmax, ymin, ymax) of one page are read."""
    return np.argsort(reading_places(np.asarray(b, float).reshape(-1, 4), np.zeros(len(b), np.int64))).tolist()


def sort_pages(lines: DataFrame) -> DataFrame:
    """lines(page_id, text, box) with their place in the reading order; a page is a task's unit, never more.

    Of lines with equal corners the one with the smaller right and lower border, then text, is first. A page's lines come
    one behind the other, and the whole pages of an Arrow batch are laid out at once.
    """
    kind = dict(lines.dtypes)["page_id"]
    corners = ["xmin", "xmax", "ymin", "ymax"]
    # Sorted, so that lines with equal corners keep one order whatever the shuffle does.
    dealt = lines.select("page_id", "text", *bounds(F.col("box"))).repartition("page_id").sortWithinPartitions("page_id", *corners, "text")

    def placed(batches):
        pages = pa.Table.from_batches(batches).combine_chunks()
        number = pages["page_id"].combine_chunks().dictionary_encode("encode").indices.to_numpy()
        b = np.column_stack([pages[c].to_numpy().astype(float) for c in corners])
        place = pa.array(reading_places(b, number), pa.int32())
        yield from pa.table({"page_id": pages["page_id"], "text": pages["text"], "place": place}).to_batches()

    def order(batches):
        held = []  # of the last page, whose lines may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            number = batch["page_id"].dictionary_encode("encode").indices.to_numpy()
            cut = int(np.searchsorted(number, number[-1]))  # numbers ascend
            if held and (cut or held[0]["page_id"][0].as_py() != batch["page_id"][0].as_py()):
                yield from placed([*held, batch.slice(0, cut)])
                held = []
            elif cut:
                yield from placed([batch.slice(0, cut)])
            held.append(batch.slice(cut))
        if held:
            yield from placed(held)

    return dealt.mapInArrow(order, f"page_id {kind}, text string, place int")
