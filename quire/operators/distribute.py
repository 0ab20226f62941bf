"""A paragraph's text over its boxes: in proportion to room and source, cut at good places.

Both ways scan a text unit by unit, which columns can't express; an Arrow function takes
the boxes of each paragraph as arrays, so paragraphs stay rows and nothing is grouped in
Python.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from quire.operators.layout import EM_PART, LEAST_SIZE, POINT_PART, WIDTHS, Counted, resolved, settle

_FORMULA = re.compile(r"((?<!\\)[$](?:[^$]|\\.)+(?<!\\)[$])")
_UNITS = re.compile(r"(?s)(?<!\\)[$](?:[^$]|\\.)+(?<!\\)[$]|\s+|[0-9A-Za-z]+(?:[/_-][0-9A-Za-z]+)*|[\u4e00-\u9fff]|.")
SENTENCE, CLAUSE = "。！？.!?", "，；：、,;:"
PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "《": "》", "“": "”", "「": "」"}
_CLOSE = {v: k for k, v in PAIRS.items()}


def capacity(width: float, height: float, size: float = 10.0, line: float = 1.35, char: float = 0.04) -> float:
    """Characters that a box holds."""
    return max(1.0, max(4.0, max(1.0, width) / max(1.0, size * 0.92 + char)) * max(1.0, max(1.0, height) / max(1.0, size * line)))


def shares(lengths: list[int], room: list[float]) -> list[float]:
    """Each box's share: 78 % by its room, 22 % by the length of its source text."""
    n, total = sum(lengths), sum(room)
    mixed = [0.78 * r / total + 0.22 * (x / n if n else 1 / len(room)) for x, r in zip(lengths, room)]
    return [m / sum(mixed) for m in mixed]


def spread(text: str, sources: list[str], room: list[float]) -> list[str]:
    """The text in as many pieces as there are boxes; formulas stay whole, joined pieces give the text again.

    A piece ends within 0.9 to 1.45 of its share, outside of brackets, where the distance
    to the share (too short weighs 1.8, too long 0.95) less a bonus for the end of a
    sentence or clause is least; 50 is added while formulas of the box's source are
    missing. Without such a place it ends at its share. A box that had text and gets none
    gets a space.
    """
    if not text:
        return [""] * len(sources)
    units = [u for k, part in enumerate(_FORMULA.split(text)) for u in ([part] if k % 2 else part)]
    out, at = [], 0
    for box, share in enumerate(shares([len(s) for s in sources], room)[:-1]):
        aim = int(len(units) * share)
        needed = _FORMULA.findall(sources[box])
        best, best_score, open_, met = -1, float("inf"), [], 0
        for n, unit in enumerate(units[at:], 1):
            if unit in PAIRS:
                open_.append(unit)
            elif open_ and _CLOSE.get(unit) == open_[-1]:
                open_.pop()
            met += unit in needed
            if n >= int(aim * 0.9) and not open_:
                score = (aim - n) * 1.8 if n < aim else (n - aim) * 0.95
                progress = n / max(1, aim)
                kind = (12, 4) if progress >= 0.94 else (6, 2) if progress >= 0.88 else (0, 0)
                score -= kind[0] if unit in SENTENCE else kind[1] if unit in CLAUSE else 0
                score += 50 if met < len(needed) else 0
                if score < best_score:
                    best, best_score = at + n, score
            if n >= int(aim * 1.45):
                break
        end = best if best >= 0 else at + min(aim, len(units) - at)
        out.append("".join(units[at:end]))
        at = end
    out.append("".join(units[at:]))
    return [" " if not piece and source else piece for piece, source in zip(out, sources)]


STOPS, PAUSES = set("。！？；：.!?;:”\""), set("，、,）)】]」』》")


def split_weight(source: str, width: float, height: float) -> int:
    """How much of a text a box's source stands for: characters, six for a formula; small boxes weigh 24 at most."""
    formulas = len(_FORMULA.findall(source))
    weight = sum(map(len, _FORMULA.sub(" ", source).split())) + formulas * 6
    return max(1, min(weight, 24) if width < 120 or height < 16 else weight)


def bridges(left: str, right: str) -> bool:
    """Whether the source runs on from one box into the next."""
    left, right = left.strip(), right.strip()
    return bool(left and right and left[-1] not in ".!?;:。！？；：" and re.match(r"[A-Za-z0-9\u4e00-\u9fff(\[\"“]", right))


class _Fitting:
    """What runs of units do in boxes.

    Where lines break doesn't depend on where a run ends, so the runs that start at one
    place share their lines; these are followed only as far as the box can hold them.
    """

    def __init__(self, units: list[str], width: list[float], height: list[float], style: tuple[float, float, float]) -> None:
        self.units, self.width, self.height, self.style = units, width, height, style
        self.size = float(resolved(np.array(style[0])))
        self.fill: dict[tuple[int, int, int], float] = {}
        self.suffix: dict[tuple[int, int], bool] = {}
        text = "".join(units)
        #: A dollar escaped before a run may open a formula in it, and newlines end lines: such runs are laid out one by one.
        self.apart = "\n" in text or "\\$" in text
        if self.apart:
            return
        counted = Counted([text])
        self.total, self.tall, self.shapes = counted.total.tolist(), counted.tall.tolist(), counted.shapes.tolist()
        self.nth = None if counted.nth is None else counted.nth.tolist()
        self.at = [0, *accumulate(1 if len(u) > 2 and u[0] == "$" else len(u) for u in units)]
        self.places = range(len(self.total) - 1)
        self.lines: dict[tuple[int, int, float], tuple[list[int], list[float]]] = {}
        self.points: dict[tuple[int, float], list[float]] = {}

    def _tallest(self, a: int, b: int, size: float, line: float) -> float:
        """The height of a line of the characters from a to b."""
        high = 1.10 * size if self.tall[b] > self.tall[a] else 1.06 * size
        if self.nth is not None:
            for _, by, h in self.shapes[self.nth[a] : self.nth[b]]:
                high = max(high, (max(size * h, size * line * 0.92, size) if by else max(size * 1.05, 1.0)) * 1.04)
        return max(high, size * line)

    def _end(self, box: int, at: int, size: float) -> int:
        """Where a line ends that starts at a character."""
        char, part, before, nth = self.style[2], size * EM_PART, self.total[at], self.nth
        room, narrow = self.width[box] + 1e-9, min(WIDTHS.values()) * size + char
        most = min(len(self.places), at + max(1, math.ceil((room + char) / narrow) + 1)) if narrow > 0 else len(self.places)
        if nth is None or nth[most] == nth[at]:
            return bisect_right(self.places, room, min(at + 1, most), most, key=lambda i: part * (self.total[i + 1] - before) + char * (i - at))
        if (box, size) not in self.points:
            widest = max(self.width[box] * 0.98, 1.0)
            self.points[box, size] = [0, *accumulate(round(min(max(size * w * by, size * 0.8) if by else max(size * 0.8, 1.0), widest) / POINT_PART) for w, by, _ in self.shapes)]
        points = self.points[box, size]
        return bisect_right(self.places, room, min(at + 1, most), most, key=lambda i: part * (self.total[i + 1] - before) + char * (i - at) + POINT_PART * (points[nth[i + 1]] - points[nth[at]]))

    def _need(self, box: int, a: int, b: int, size: float, most: float) -> float:
        """The height of the characters from a to b; infinite if it is clear that it passes `most`."""
        ends, sums = self.lines.setdefault((box, a, size), ([], []))
        line, at, high = self.style[1], ends[-1] if ends else a, sums[-1] if sums else 0.0
        while at < b and high <= most:
            end = self._end(box, at, size)
            high += self._tallest(at, end, size, line)
            ends.append(end)
            sums.append(high)
            at = end
        k = bisect_left(ends, b)
        if k == len(ends):
            return math.inf
        return (sums[k - 1] if k else 0.0) + self._tallest(ends[k - 1] if k else a, b, size, line)

    def _settled(self, box: int, a: int, b: int) -> float:
        """settle() for one run: the height that it needs at the size it is shrunk to."""
        height, size = self.height[box], self.size
        need = self._need(box, self.at[a], self.at[b], size, height if size * 0.95 <= LEAST_SIZE else math.inf)
        for _ in range(20):
            if need <= height:
                break
            size = max(LEAST_SIZE, size * (height / need) * 0.95)
            least = size <= LEAST_SIZE
            need = self._need(box, self.at[a], self.at[b], size, height if least else math.inf)
            if least:
                break
        return need

    def fits(self, box: int, a: int, b: int) -> bool:
        if (box, a, b) not in self.fill:
            self.fill[box, a, b] = self._filled(box, a, b)
        return self.fill[box, a, b] <= 1.0

    def _filled(self, box: int, a: int, b: int) -> float:
        """How full a run makes a box, blanks at its ends left out; infinite for nothing, or if it is clear that it doesn't fit."""
        while a < b and self.units[a].isspace():
            a += 1
        while a < b and self.units[b - 1].isspace():
            b -= 1
        if a >= b or not self.height[box] > 0:
            return math.inf
        if self.apart:
            return float(settle(["".join(self.units[a:b])], *(np.full(1, x) for x in (self.width[box], self.height[box], *self.style)))[1][0]) / self.height[box]
        return self._settled(box, a, b) / self.height[box]

    def longest(self, box: int, at: int, most: int) -> int | None:
        """The last end that a binary search finds to fit."""
        low, high, best = at + 1, most, None
        while low <= high:
            mid = (low + high) // 2
            if self.fits(box, at, mid):
                best, low = mid, mid + 1
            else:
                high = mid - 1
        return best

    def prefer(self, at: int, end: int) -> int:
        return next((k for k in range(end, max(at + 1, end - 24) - 1, -1) if self.units[k - 1] in STOPS), end)

    def rest_fits(self, box: int, at: int) -> bool:
        """Whether the units from `at` on fit the boxes from `box` on."""
        if (box, at) not in self.suffix:
            self.suffix[box, at] = self._rest_fits(box, at)
        return self.suffix[box, at]

    def _rest_fits(self, box: int, at: int) -> bool:
        if box == len(self.width):
            return at >= len(self.units)
        if box == len(self.width) - 1:
            return self.fits(box, at, len(self.units))
        most = len(self.units) - (len(self.width) - 1 - box)
        best = self.longest(box, at, most) if most > at else None
        if best is None:
            return False
        ends = dict.fromkeys([self.prefer(at, best), best, *range(best - 1, max(at + 1, best - 32) - 1, -1)])
        return any(self.fits(box, at, e) and self.rest_fits(box + 1, e) for e in ends if e > at)

    def score(self, box: int, at: int, end: int, bridge: bool) -> float:
        fill = self.fill[box, at, end]
        last, after = self.units[end - 1].strip(), self.units[end].strip() if end < len(self.units) else ""
        if not bridge:
            return fill + (0.06 if last in STOPS else 0.02 if last in PAUSES else 0.0)
        score = fill + (-0.18 if last in STOPS else -0.03 if last in PAUSES else 0.08)
        score += 0.0 if not after or after in STOPS else 0.01 if after in PAUSES else 0.08
        return score + min(0.08, max(0.0, fill - 0.82))


def fit(text: str, sources: list[str], width: list[float], height: list[float], size: float, line: float, char: float) -> list[str]:
    """The text in pieces that fit their boxes, in order; the last takes the rest.

    A piece may end where it fits its box, shrunk as far as styles allow, and where the
    rest can still be made to fit the boxes that follow. Looked at are the longest piece
    that fits, the one by source weight, each moved back to a stop among its last 24 units,
    and all ends between and up to 48 units below them. The one of best score is taken:
    fill, and a stop or a pause at its end, or, where the source runs on from box to box,
    the lack of one; of equal scores the longest. Where none is possible the piece is that
    by source weight. Pieces are stripped; a box that no unit is left for gets ''.
    """
    if len(sources) <= 1:
        return [text.strip() for _ in sources]
    units = _UNITS.findall(text)
    weights = [split_weight(s, w, h) for s, w, h in zip(sources, width, height)]
    boxes, out, at = _Fitting(units, width, height, (size, line, char)), [], 0
    for box in range(len(sources) - 1):
        most = len(units) - (len(sources) - box - 1)
        if most <= at:
            out.append("")
            continue
        best = boxes.longest(box, at, most) or at + 1
        share = max(1, round((most - at) * weights[box] / max(1, sum(weights[box:]))))
        aim = boxes.prefer(at, min(most, max(at + 1, at + share)))
        low, high = max(at + 1, min(best, aim) - 48), max(best, aim)
        ends = dict.fromkeys([aim, boxes.prefer(at, best), best, *range(high - 1, low - 1, -1)])
        bridge = bridges(sources[box], sources[box + 1])
        chosen, top = None, -np.inf
        for e in ends:
            if boxes.fits(box, at, e):
                score = boxes.score(box, at, e, bridge)
                better = score > top or (abs(score - top) < 1e-6 and (chosen is None or e > chosen))
                if better and boxes.rest_fits(box + 1, e):
                    chosen, top = e, score
        end = aim if chosen is None else chosen
        out.append("".join(units[at:end]).strip())
        at = end
    return [*out, "".join(units[at:]).strip()]


@F.arrow_udf(S.ArrayType(S.StringType()))
def spread_udf(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """(text, sources, widths, heights) -> pieces."""
    for rows in batches:
        yield pa.array([spread(t or "", [s or "" for s in ss], [capacity(w, h) for w, h in zip(ws, hs)]) for t, ss, ws, hs in zip(*(c.to_pylist() for c in rows))], pa.list_(pa.string()))


@F.arrow_udf(S.ArrayType(S.StringType()))
def fit_udf(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """(text, sources, widths, heights, size, line, char) -> pieces."""
    for rows in batches:
        yield pa.array([fit(t or "", [s or "" for s in ss], ws, hs, a, b, c) for t, ss, ws, hs, a, b, c in zip(*(x.to_pylist() for x in rows))], pa.list_(pa.string()))


def distribute(ordered: DataFrame, texts: DataFrame, by_fit: bool = False, size: float = 10.0, line: float = 1.35, char: float = 0.04) -> DataFrame:
    """doc_id, lid, place, idx, piece: the paragraphs' texts (doc_id, lid, new_text) over their boxes in reading order.

    ordered: blocks with place (of reading_order), text, width and height.
    """
    boxes = ordered.groupBy("doc_id", "lid").agg(F.array_sort(F.collect_list(F.struct("place", "idx", F.coalesce("text", F.lit("")).alias("text"), "width", "height"))).alias("b"))
    j = boxes.join(texts, ["doc_id", "lid"])
    args = (F.col("new_text"), F.col("b.text"), F.col("b.width"), F.col("b.height"))
    pieces = fit_udf(*args, F.lit(size), F.lit(line), F.lit(char)) if by_fit else spread_udf(*args)
    return j.withColumn("pieces", pieces).select("doc_id", "lid", F.inline(F.expr("transform(b, (x, i) -> struct(x.place as place, x.idx as idx, pieces[i] as piece))")))


def capacity_shares(blocks: DataFrame) -> DataFrame:
    """doc_id, idx, share: each box's part of the room of its paragraph (columns width, height, size)."""
    from pyspark.sql import Window

    one, size = F.lit(1.0), F.col("size")
    room = F.greatest(one, F.greatest(F.lit(4.0), F.greatest(one, F.col("width")) / F.greatest(one, size * 0.92 + 0.04)) * F.greatest(one, F.greatest(one, F.col("height")) / F.greatest(one, size * 1.35)))
    rows = blocks.where("lid is not null").withColumn("room", room)
    return rows.select("doc_id", "lid", "idx", (F.col("room") / F.sum("room").over(Window.partitionBy("doc_id", "lid"))).alias("share"))
