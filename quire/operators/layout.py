"""Layout simulation over boxes, and the searches for styles that make a text fit.

Advances come from a fixed model in ems: CJK 1.0, blanks 0.3, others 0.6; WIDTHS can be
replaced. An Arrow function breaks all texts of a batch into lines at once: a text's
characters are counted once, whatever the number of sizes and spacings it is laid out
with, and each line's end is found by binary search in those counts.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from quire.functions import latex
from quire.functions import text as T

WIDTHS = {"cjk": 1.0, "blank": 0.3, "other": 0.6}
_FORMULA = re.compile(r"(?<!\\)[$](?:[^$]|\\.)+(?<!\\)[$]")


def _characters(c: np.ndarray, size: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """Advance (NaN for newlines) and height of each character (by code), with its size."""
    cjk = (c >= 0x4E00) & (c <= 0x9FFF)
    blank = (c == 32) | ((c >= 9) & (c <= 13)) | ((c >= 28) & (c <= 31))
    rest = np.unique(c[c > 127])
    blank |= np.isin(c, [x for x in rest.tolist() if chr(x).isspace()])
    advance = np.where(cjk, WIDTHS["cjk"], np.where(blank, WIDTHS["blank"], WIDTHS["other"])) * size
    advance[c == 10] = np.nan
    return advance, np.where(cjk, 1.10, 1.02) * size


def _units(texts: list[str], width: np.ndarray, size: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Advances and heights of all texts' units in a row, and units by text. A formula is one unit. (Plain loops in tests add these up; wrapped does without.)"""
    parts: list[tuple[int, str, tuple[float, float] | None]] = []
    for k, text in enumerate(texts):
        last = 0
        for m in _FORMULA.finditer(text) if "$" in text else ():
            w, h = latex.inline_box(m.group(0).strip("$").strip(), size[k], size[k] * line[k])
            parts += [(k, text[last : m.start()], None), (k, " ", (min(w, max(width[k] * 0.98, 1.0)), h * 1.04))]
            last = m.end()
        parts.append((k, text[last:] if last else text, None))
    lengths = np.array([len(t) for _, t, _ in parts], np.int64)
    owner = np.repeat(np.array([k for k, _, _ in parts], np.int64), lengths)
    advance, high = _characters(np.frombuffer("".join(t for _, t, _ in parts).encode("utf-32-le", "surrogatepass"), np.uint32), size[owner])
    boxes = [(at, box) for at, (_, _, box) in zip((np.cumsum(lengths) - lengths).tolist(), parts) if box]
    if boxes:
        at = [x for x, _ in boxes]
        advance[at], high[at] = zip(*(box for _, box in boxes))
    return advance, high, np.bincount(owner, minlength=len(texts))


#: Ems, and points of formulas, are summed in whole parts of these sizes, so that sums over many texts stay exact.
EM_PART, POINT_PART = 1e-9, 1e-12
#: With fewer layouts still open than this, lines are found one by one.
FEW = 24


class Lines(NamedTuple):
    """Lines of layouts, in order: layout, whether one has CJK characters, its tallest formula (in sizes, 0 if none), whether it has a formula that shows nothing; bounds by layout."""

    owner: np.ndarray
    cjk: np.ndarray
    formula: np.ndarray
    empty: np.ndarray
    bounds: np.ndarray

    def heights(self, size: np.ndarray, line: np.ndarray) -> np.ndarray:
        """The height of each line's tallest unit, 1.06 sizes at least."""
        out = np.where(self.cjk, (1.10 * size)[self.owner], (1.06 * size)[self.owner])
        for k, box in ((np.flatnonzero(self.formula), lambda z, n, h: np.maximum(np.maximum(z * h, z * n * 0.92), z)), (np.flatnonzero(self.empty), lambda z, n, h: np.maximum(z * 1.05, 1.0))):
            if len(k):
                own = self.owner[k]
                out[k] = np.maximum(out[k], box(size[own], line[own], self.formula[k]) * 1.04)
        return out

    def needs(self, size: np.ndarray, line: np.ndarray) -> np.ndarray:
        """The height of each layout."""
        return np.bincount(self.owner, np.maximum(self.heights(size, line), (size * line)[self.owner]), len(self.bounds) - 1)


class Counted:
    """Running sums over all units of some texts: advances (in EM_PART), CJK characters, formulas (each one unit); places of newlines, bounds by text."""

    def __init__(self, texts: list[str]) -> None:
        shapes, places, flat, bounds, at = [], [], [], [0], 0
        for text in texts:
            last = 0
            for m in _FORMULA.finditer(text) if "$" in text else ():
                flat += [text[last : m.start()], " "]
                at += m.start() - last + 1
                places.append(at - 1)
                shapes.append(latex.box_shape(m.group(0).strip("$").strip()))
                last = m.end()
            flat.append(text[last:] if last else text)
            at += len(text) - last
            bounds.append(at)
        c = np.frombuffer("".join(flat).encode("utf-32-le", "surrogatepass"), np.uint32)
        advance, high = _characters(c, 1.0)
        ems = np.rint(np.nan_to_num(advance) / EM_PART).astype(np.int64)
        ems[places] = 0
        self.total = np.concatenate([[0], np.cumsum(ems)])
        self.tall = np.concatenate([[0], np.cumsum(high > 1.05)])
        self.breaks, self.bounds = np.flatnonzero(c == 10), np.array(bounds, np.int64)
        self.nth = np.searchsorted(places, np.arange(len(c) + 1)) if places else None
        #: Of each formula: factors of its width, height (0 if it shows nothing)
        self.shapes = np.array([s or (0.0, 0.0, 0.0) for s in shapes], float).reshape(-1, 3)


def _one_by_one(c: Counted, at: int, end: int, room: float, part: float, char: float, points: np.ndarray | None, base: int) -> np.ndarray:
    """Starts and ends of the lines of one layout from `at` on."""
    ems, begin, lines, places = (c.total[at : end + 1] - c.total[at]).tolist(), at, [], range(end - at)
    if points is not None and c.nth[end] > c.nth[at]:
        wide = points[c.nth[at : end + 1] + base]
        wide = (wide - wide[0]).tolist()
    else:
        wide = None
    breaks = c.breaks[np.searchsorted(c.breaks, at) : np.searchsorted(c.breaks, end)].tolist()
    while True:
        s = at - begin
        k = bisect_left(breaks, at)
        hard = breaks[k] if k < len(breaks) else end
        top = hard - begin
        reach = (lambda i: part * (ems[i + 1] - ems[s]) + char * (i - s)) if wide is None else (lambda i: part * (ems[i + 1] - ems[s]) + char * (i - s) + POINT_PART * (wide[i + 1] - wide[s]))
        stop = bisect_right(places, room, min(s + 1, top), top, key=reach)
        lines.append((at, begin + stop))
        ended = begin + stop == hard < end
        at = begin + stop + ended
        if at >= end:
            return np.array([*lines, (at, at)] if ended else lines)


def wrapped(texts: list[str], width: np.ndarray, size: np.ndarray, char: np.ndarray, of: np.ndarray | None = None) -> Lines:
    """Greedy wrapping of many layouts at once; `of` is the text of each, where a text has several.

    A unit goes to the next line if it isn't the line's first and would pass the width;
    each unit is followed by `char` of spacing. A newline ends a line. A text without
    characters has no line. Widths are those of a line added up from its start.
    """
    of = np.arange(len(texts)) if of is None else of
    c = Counted(texts)
    total, breaks, nth = c.total, c.breaks, c.nth
    begin, end = c.bounds[:-1][of], c.bounds[1:][of]
    part, room = size * EM_PART, width + 1e-9
    # a line holds at least as many of the widest, at most as many of the narrowest characters as fit
    widest = np.where(c.tall[end] > c.tall[begin], max(WIDTHS.values()), max(WIDTHS["blank"], WIDTHS["other"])) * size + char
    narrowest = min(WIDTHS.values()) * size + char
    least = np.where(widest > 0, np.floor((room + char) / np.where(widest > 0, widest, 1.0)) - 1, 0).clip(1, 2**40).astype(np.int64)
    most = np.where(narrowest > 0, np.ceil((room + char) / np.where(narrowest > 0, narrowest, 1.0)) + 1, 2**40).clip(1, 2**40).astype(np.int64)
    points, base = None, np.zeros(len(of), np.int64)
    if nth is not None:  # each layout has its own widths of formulas: running sums, a 0 before each
        first, n = nth[begin], nth[end] - nth[begin]
        at = np.cumsum(n) - n
        owner = np.repeat(np.arange(len(of)), n)
        wide, by, _ = c.shapes[first[owner] + np.arange(len(owner)) - at[owner]].T
        z = size[owner]
        box = np.where(by > 0, np.maximum(z * wide * by, z * 0.8), np.maximum(z * 0.8, 1.0))
        points = np.concatenate([[0], np.cumsum(np.rint(np.minimum(box, np.maximum(width[owner] * 0.98, 1.0)) / POINT_PART).astype(np.int64))])
        base = at - first
        least[n > 0] = 1
    active = np.flatnonzero(end > begin)
    at = begin[active]
    starts, stops, owners = [], [], []
    while len(active) >= FEW:
        last, z, r, gap = end[active], part[active], room[active], char[active]
        hard = np.append(breaks, len(total))[np.searchsorted(breaks, at)] if len(breaks) else np.full(len(at), len(total))
        top = np.minimum(hard, last)
        low, high = np.minimum(at + least[active], top), np.minimum(at + most[active], top)
        before = total[at]
        math = None
        if points is not None:
            math = np.flatnonzero(nth[last] > nth[at])
            b = base[active[math]]
            passed = points[nth[at[math]] + b]
        while (low < high).any():
            mid = (low + high) >> 1
            after = np.minimum(mid + 1, len(total) - 1)
            reach = z * (total[after] - before) + gap * (mid - at)
            if math is not None:
                reach[math] += POINT_PART * (points[nth[np.minimum(after[math], last[math])] + b] - passed)
            over = reach > r
            low, high = np.where(over, low, np.minimum(mid + 1, high)), np.where(over, mid, high)
        ended = (low == hard) & (hard < last)
        after = low + ended
        bare = (after >= last) & ended  # after a last newline one empty line follows
        starts += [at, after[bare]]
        stops += [low, after[bare]]
        owners += [active, active[bare]]
        more = after < last
        active, at = active[more], after[more]
    for k, a in zip(active.tolist(), at.tolist()):
        lines = _one_by_one(c, a, int(end[k]), float(room[k]), float(part[k]), float(char[k]), points, int(base[k]))
        starts.append(lines[:, 0])
        stops.append(lines[:, 1])
        owners.append(np.full(len(lines), k))
    s, e, o = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, stops, owners))
    order = np.argsort(o, kind="stable")
    s, e, o = s[order], e[order], o[order]
    formula, empty = np.zeros(len(s)), np.zeros(len(s), bool)
    if nth is not None:
        has = np.flatnonzero(nth[e] > nth[s])
        if len(has):
            runs = np.stack([nth[s[has]], nth[e[has]]], axis=1).reshape(-1)
            formula[has] = np.maximum.reduceat(np.append(c.shapes[:, 2], 0.0), runs)[::2]
            empty[has] = np.maximum.reduceat(np.append(c.shapes[:, 2] == 0, False), runs)[::2]
    return Lines(o, c.tall[e] > c.tall[s], formula, empty, np.concatenate([[0], np.cumsum(np.bincount(o, minlength=len(of)))]))


def break_lines(texts: list[str], width: np.ndarray, size: np.ndarray, line: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The height of each line's tallest unit, and bounds by text."""
    lines = wrapped(texts, width, size, char)
    return lines.heights(size, line), lines.bounds


@F.arrow_udf(S.ArrayType(S.DoubleType()))
def line_heights(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """(text, width, size, line, char) -> the height of each line's tallest unit."""
    for text, *numbers in batches:
        width, size, line, char = (np.nan_to_num(x.cast(pa.float64()).to_numpy(zero_copy_only=False)) for x in numbers)
        texts = [t or "" for t in text.to_pylist()]
        found = [break_lines(texts[c], width[c], size[c], line[c], char[c]) for c in _chunks(texts, np.ones(len(texts)), width)]
        bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *(np.diff(b) for _, b in found)]))])
        yield pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(np.concatenate([np.zeros(0), *(h for h, _ in found)])))


RESOLVED_SIZE_SQL = "case when locked then size when size < 8 then 9.5 when size > 14 then 11.5 else greatest(9.5, least(11.5, size)) end"


LEAST_SIZE, MOST_SIZE = 9.5, 11.5
#: Lines that are found at once, about.
GRID_LINES = 400_000


def resolved(size: np.ndarray) -> np.ndarray:
    """The size that is drawn for a style that isn't locked (RESOLVED_SIZE_SQL)."""
    return np.where(size < 8, LEAST_SIZE, np.where(size > 14, MOST_SIZE, np.clip(size, LEAST_SIZE, MOST_SIZE)))


def heights_of(texts: list[str], width: np.ndarray, size: np.ndarray, line: np.ndarray, char: np.ndarray) -> np.ndarray:
    """The height that each text needs."""
    return wrapped(texts, width, size, char).needs(size, line)


def _chunks(texts: list[str], layouts: np.ndarray, width: np.ndarray) -> Iterator[slice]:
    """Runs of rows whose lines and characters fit in memory together."""
    n = np.array([len(t) for t in texts], float)
    cost = np.cumsum(n / 4 + layouts * (1 + np.minimum(n, n * MOST_SIZE / np.maximum(width, 1.0))))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0.0) + GRID_LINES)))
        yield slice(at, to)
        at = to


def _styles(texts: list[str], grids: list[tuple[tuple[float, ...], ...]], numbers: np.ndarray) -> np.ndarray:
    """The style of least score of each row.

    A grid is (sizes, chars, lines). Sizes that are drawn alike are laid out once, for all lines.
    """
    groups: dict[tuple, list[int]] = {}
    for k, grid in enumerate(grids):
        groups.setdefault(grid, []).append(k)
    drawn = {g: np.unique(resolved(np.array(g[0])), return_inverse=True) for g in groups}
    most = max(len(g[2]) for g in groups)
    of = np.concatenate([np.repeat(rows, len(drawn[g][0]) * len(g[1])) for g, rows in groups.items()])
    size = np.concatenate([np.tile(np.repeat(drawn[g][0], len(g[1])), len(rows)) for g, rows in groups.items()])
    char = np.concatenate([np.tile(g[1], len(drawn[g][0]) * len(rows)) for g, rows in groups.items()])
    spacing = np.concatenate([np.tile([*g[2], *[g[2][-1]] * (most - len(g[2]))], (len(drawn[g][0]) * len(g[1]) * len(rows), 1)) for g, rows in groups.items()])
    lines = wrapped(texts, numbers[of, 0], size, char, of)
    needs = np.stack([lines.needs(size, spacing[:, j]) for j in range(most)], axis=1)
    out, at = np.zeros((len(texts), len(_STYLE))), 0
    for grid, rows in groups.items():
        values, back = drawn[grid]
        to = at + len(rows) * len(values) * len(grid[1])
        need = needs[at:to, : len(grid[2])].reshape(len(rows), len(values), len(grid[1]), len(grid[2]))[:, back].transpose(0, 1, 3, 2)
        out[rows] = _least(need, *map(np.array, grid), numbers[rows])
        at = to
    return out


_STYLE = ["size", "line", "char", "need", "score"]


@F.arrow_udf(S.StructType([S.StructField(c, S.DoubleType()) for c in _STYLE]))
def best_styles(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """(text, sizes, chars, lines, width, height, safe height, target, base size, line, char, body, wide) -> the style of least score."""
    for batch in batches:
        texts, grids = batch[0].to_pylist(), [x.to_pylist() for x in batch[1:4]]
        numbers = np.stack([np.nan_to_num(x.cast(pa.float64()).to_numpy(zero_copy_only=False)) for x in batch[4:]], axis=1)
        keys = [tuple(map(tuple, g)) for g in zip(*grids)]
        out = np.concatenate([_styles(texts[c], keys[c], numbers[c]) for c in _chunks(texts, np.array([len(k[0]) * len(k[1]) for k in keys]), numbers[:, 0])] or [np.zeros((0, len(_STYLE)))])
        yield pa.StructArray.from_arrays([pa.array(out[:, k]) for k in range(len(_STYLE))], _STYLE)


def _least(need: np.ndarray, sizes: np.ndarray, chars: np.ndarray, lines: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of each row, the first style of least score, in order of (size, line, char)."""
    _, height, safe, target, size, line, char, body, wide = (x[:, None, None, None] for x in rows.T)
    s, n, c = sizes[:, None, None], lines[None, :, None], chars[None, None, :]
    score = np.where(need > height, 1500.0, np.where(need > safe, 450.0, 0.0)) + np.abs(need / safe - target) * 120.0 + np.abs(n - line) * 35.0 + np.abs(c - char) * 400.0
    score = np.round(score + np.maximum(0.0, s - size) * np.where(body > 0, 30.0, 10.0) + np.maximum(0.0, n - line) * np.where(wide > 0, 55.0, 0.0) - s * 0.05, 4)
    best = score.reshape(len(rows), -1).argmin(axis=1)
    i, j, k = np.unravel_index(best, score.shape[1:])
    row = np.arange(len(rows))
    return np.stack([sizes[i], lines[j], chars[k], need[row, i, j, k], score[row, i, j, k]], axis=1)


def settle(texts: list[str], width: np.ndarray, height: np.ndarray, size: np.ndarray, line: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes shrunk until texts fit, as (size, height needed, steps taken); steps are 0 where the first size fits.

    Each step takes 0.95 of the proportion of room to need, but no size below LEAST_SIZE;
    it ends there, after 20 steps, or where the text fits.
    """
    size = resolved(size)
    need, steps = heights_of(texts, width, size, line, char), np.zeros(len(texts), np.int64)
    open_ = np.flatnonzero((need > height) & (need > 0))
    for _ in range(20):
        if not len(open_):
            break
        smaller = np.maximum(LEAST_SIZE, size[open_] * (height[open_] / need[open_]) * 0.95)
        size[open_], steps[open_] = smaller, steps[open_] + 1
        need[open_] = heights_of([texts[k] for k in open_], width[open_], resolved(smaller), line[open_], char[open_])
        open_ = open_[(need[open_] > height[open_]) & (smaller > LEAST_SIZE)]
    return size, need, steps


@F.arrow_udf(S.StructType([S.StructField("size", S.DoubleType()), S.StructField("need", S.DoubleType()), S.StructField("steps", S.LongType())]))
def _settled(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    for text, *numbers in batches:
        parts = settle(text.to_pylist(), *(np.nan_to_num(x.cast(pa.float64()).to_numpy(zero_copy_only=False)) for x in numbers))
        yield pa.StructArray.from_arrays([pa.array(x) for x in parts], ["size", "need", "steps"])


def accordion(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, size, action, scale, fill_ratio: texts shrunk to their boxes, never cut (columns text, width, height, size, line, char, locked).

    Actions: locked (as it is), none (it fits), scale_down, overflow_accepted (too long at
    the least size). scale is the new size over the first; boxes without room keep theirs,
    without an action.
    """
    r = rows.withColumn("_f", _settled(T.text_of("text"), *(F.col(c).cast("double") for c in ("width", "height", "size", "line", "char"))))
    solid, fits = (F.col("width") > 0) & (F.col("height") > 0), F.col("_f.need") <= F.col("height")
    action = F.when(F.col("locked"), "locked").when(~solid, None).when(F.col("_f.steps") == 0, "none").when(fits, "scale_down").otherwise("overflow_accepted")
    kept = action.isNull() | action.isin("locked", "none")
    base = F.expr(RESOLVED_SIZE_SQL).cast("double")
    return r.select(*keys, F.when(kept, F.col("size").cast("double")).otherwise(F.col("_f.size")).alias("size"), action.alias("action"), F.when(action == "scale_down", F.col("_f.size") / base).alias("scale"), F.when(solid & ~F.col("locked"), F.col("_f.need") / F.col("height")).alias("fill_ratio"))


def needed_height(heights: Column, line_height: Column) -> Column:
    return F.aggregate(heights, F.lit(0.0), lambda s, h: s + F.greatest(h, line_height))


def simulate(rows: DataFrame, text: str = "text") -> DataFrame:
    """line_count, needed_height, fill_ratio, is_overflow of a text in a box (columns width, height, size, line, char, locked).

    Boxes without width or height have NULL metrics.
    """
    solid = (F.col("width") > 0) & (F.col("height") > 0)
    r = rows.withColumn("_s", F.expr(RESOLVED_SIZE_SQL).cast("double"))
    r = r.withColumn("_h", line_heights(F.when(solid, T.text_of(text)), F.col("width"), F.col("_s"), F.col("line").cast("double"), F.col("char").cast("double")))
    need = needed_height(F.col("_h"), F.col("_s") * F.col("line"))
    out = r.withColumns({"line_count": F.when(solid, F.size("_h")), "needed_height": F.when(solid, need)})
    return out.withColumns({"fill_ratio": F.col("needed_height") / F.col("height"), "is_overflow": F.col("needed_height") > F.col("height")}).drop("_s", "_h")


def _distinct_steps(values: list[Column], step: float) -> Column:
    return F.array_sort(F.array_distinct(F.array(*(T.round_step(v, step) for v in values))))


def line_candidates(base: Column, bucket: Column, mode: Column) -> Column:
    flex = F.when(bucket.isin("title", "section_header"), 0.05).otherwise(0.1)
    low = lambda d: F.greatest(F.lit(1.1), base - d)
    common = [low(flex), low(0.05), base, base + 0.05]
    single, double = _distinct_steps([*common, low(0.15), low(0.20), base + 0.10], 0.05), _distinct_steps([*common, low(0.15), base + 0.10, base + 0.15], 0.05)
    return F.when(bucket != "body", _distinct_steps(common, 0.05)).when(mode == "single_col", single).otherwise(double)


def char_candidates(base: Column, low: float = 0.0, high: float = 0.2, delta: float = 0.035) -> Column:
    clamp = lambda d: F.least(F.lit(high), F.greatest(F.lit(low), base + d))
    return _distinct_steps([clamp(d) for d in (-delta, -delta / 2, 0.0, delta / 2, delta, delta + 0.005)], 0.005)


def size_candidates(base: Column, bucket: Column, dense: Column) -> Column:
    """Half steps from the least size of the bucket up to the base size (the base itself among them)."""
    share = F.when(bucket.isin("title", "section_header"), 0.85).when(dense, 0.65).otherwise(0.75)
    low = T.round_half(F.greatest(F.lit(6.0), base * share))
    steps = F.greatest(F.floor((base + 1e-6 - low) * 2), F.lit(-1)).cast("int")
    grid = F.when(steps >= 0, F.transform(F.sequence(F.lit(0), F.greatest(steps, F.lit(0))), lambda k: low + k * 0.5)).otherwise(F.array().cast("array<double>"))
    return F.array_sort(F.array_distinct(F.concat(grid, F.array(T.round_half(base)))))


TARGET_FILL_SQL = """case when bucket = 'body' then least(0.992, case when dense then 0.952 else 0.974 end + case when density > 0 and density <= 58.0 then 0.008 else 0 end + case when density > 0 and density <= 50.0 then 0.01 else 0 end
  + case when density > 0 and density <= 42.0 then 0.008 else 0 end + case when layout_mode = 'double_col' then 0.004 else 0 end + case when avg_length >= 320.0 then 0.004 else 0 end)
  when bucket in ('title', 'footnote') then 0.86 when bucket = 'section_header' then 0.90 when bucket = 'caption' then 0.88 when bucket in ('header', 'footer') then 0.84 else 0.978 end"""
SAFE_BOX_SQL = "case when bucket = 'body' then case when dense then 0.90 else 0.962 end when bucket in ('title', 'section_header') then 0.96 else 0.986 end"


def probe(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The style of least score for each block: keys, size, line, char, fill_ratio, overflow_px, score.

    rows: keys, bucket, text, width, height, size, line, char (the base style), dense,
    density, avg_length, layout_mode. The grid is sizes by lines by spacings; it stays in
    arrays of its row, so nothing is exploded or shuffled. Of equal scores the first in
    order of (size, line, char) wins.
    """
    r = rows.withColumns({"target": F.expr(TARGET_FILL_SQL).cast("double"), "safe_height": F.greatest(F.lit(1.0), F.col("height") * F.expr(SAFE_BOX_SQL)), "locked": F.lit(False)})
    r = r.withColumnsRenamed({"size": "b_size", "line": "b_line", "char": "b_char"})
    r = r.withColumns({"sizes": size_candidates(F.col("b_size"), F.col("bucket"), F.col("dense")), "chars": char_candidates(F.col("b_char")), "lines": line_candidates(F.col("b_line"), F.col("bucket"), F.col("layout_mode"))})
    body = F.col("bucket") == "body"
    wide = body & (F.col("layout_mode") == "single_col")
    numbers = [F.col(c).cast("double") for c in ("width", "height", "safe_height", "target", "b_size", "b_line", "b_char")]
    best = best_styles(T.text_of("text"), "sizes", "chars", "lines", *numbers, body.cast("double"), F.coalesce(wide, F.lit(False)).cast("double"))
    r = r.select(*keys, "safe_height", best.alias("b")).select(*keys, "safe_height", "b.*")
    over = F.greatest(F.lit(0.0), F.col("need") - F.col("safe_height"))
    return r.select(*keys, "size", "line", "char", F.round(F.col("need") / F.col("safe_height"), 4).alias("fill_ratio"), F.round(over, 4).alias("overflow_px"), "score")


STATUSES = ("perfect", "tuned_expand", "tuned_compact", "tuned_size_down", "overflow")


def _fill_scores(fill: np.ndarray, over: np.ndarray, target: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Fill up to the limit and nearness to the target; NaN stands for NULL, which least and greatest pass over in SQL."""
    return np.where(over | (fill > limit + 1e-6), -1e9, np.fmin(fill, limit) * 1000.0 + np.fmax(0.0, 1.0 - np.abs(target - fill) * 8.0) * 100.0)


def _tuning(texts: list[str], width: np.ndarray, height: np.ndarray, size: np.ndarray, line: np.ndarray, char: np.ndarray, locked: np.ndarray, body: np.ndarray, threshold: np.ndarray, limit: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray, shrinks: np.ndarray) -> tuple[np.ndarray, ...]:
    """status (its place in STATUSES), size, char and overflow_px of each row; only rows that need them try other styles."""

    def look(rows: np.ndarray, sizes: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Height, fill and overflow of rows x styles; NaN for boxes without room."""
        of, at = np.repeat(rows, sizes.shape[1]), sizes.reshape(-1)
        solid = np.flatnonzero((width[of] > 0) & (height[of] > 0))
        k, z, need = of[solid], np.nan_to_num(at[solid]), np.full(len(of), np.nan)
        z = np.where(locked[k] > 0, z, resolved(z))
        used, back = np.unique(k, return_inverse=True)
        need[solid] = wrapped([texts[x] for x in used], width[k], z, np.nan_to_num(chars.reshape(-1)[solid]), back).needs(z, np.nan_to_num(line[k]))
        need = need.reshape(sizes.shape)
        return need, need / np.where(height > 0, height, np.nan)[rows, None], need > height[rows, None]

    every = np.arange(len(texts))
    status, out_size, out_char, px = np.full(len(texts), STATUSES.index("overflow")), size.copy(), char.copy(), np.zeros(len(texts))
    _, fill, over = (x[:, 0] for x in look(every, size[:, None], char[:, None]))
    perfect = (fill >= threshold) & (fill <= limit) & ~over
    status[perfect] = STATUSES.index("perfect")
    rows = np.flatnonzero(~over & (fill < threshold) & ~perfect)
    if len(rows):
        k = np.arange(1, 9)
        chars = np.fmin(high[rows, None], char[rows, None] + k * np.where(body[rows] > 0, 0.004, 0.003)[:, None])
        _, f, o = look(rows, np.repeat(size[rows, None], 8, axis=1), chars)
        score = np.where((body[rows, None] > 0) | (k <= 6), _fill_scores(f, o, threshold[rows, None], limit[rows, None]), -np.inf)
        best = np.lexsort((chars, -score), axis=1)[:, 0]  # of equal scores the least spacing
        at = np.arange(len(rows))
        taken = (score[at, best] > _fill_scores(fill[rows], over[rows], threshold[rows], limit[rows]) + 1e-6) & (f[at, best] > fill[rows] + 0.001)
        status[rows[taken]], out_char[rows[taken]] = STATUSES.index("tuned_expand"), chars[at, best][taken]
    rows = np.flatnonzero(status == STATUSES.index("overflow"))
    if len(rows):
        chars = np.fmax(low[rows, None], char[rows, None] - np.arange(7) * 0.003)
        _, f, o = look(rows, np.repeat(size[rows, None], 7, axis=1), chars)
        fits = ~o & (f <= limit[rows, None])
        score = np.where(fits, _fill_scores(f, o, np.fmin(limit[rows], 0.97)[:, None], limit[rows, None]), -np.inf)
        best = np.lexsort((-chars, -score), axis=1)[:, 0]  # of equal scores the widest spacing
        taken, at = fits.any(axis=1), np.arange(len(rows))
        status[rows[taken]], out_char[rows[taken]] = STATUSES.index("tuned_compact"), chars[at, best][taken]
        rows = rows[~taken]
    small = rows[shrinks[rows] > 0]
    if len(small):
        sizes = np.fmax(np.fmax(6.0, size[small] - 1.0)[:, None], size[small, None] - np.array([0.3, 0.6, 1.0]))
        _, f, o = look(small, sizes, np.repeat(low[small, None], 3, axis=1))
        fits = ~o & (f <= limit[small, None])
        best, taken = fits.argmax(axis=1), fits.any(axis=1)
        k = small[taken]
        status[k], out_size[k], out_char[k] = STATUSES.index("tuned_size_down"), sizes[np.arange(len(small)), best][taken], low[k]
    rows = np.flatnonzero(status == STATUSES.index("overflow"))
    if len(rows):
        out_size[rows], out_char[rows] = least[rows], low[rows]
        need = look(rows, least[rows, None], low[rows, None])[0][:, 0]
        px[rows] = np.fmax(0.0, need - height[rows] * limit[rows])
    return status, out_size, out_char, px


@F.arrow_udf(S.StructType([S.StructField("status", S.StringType()), *(S.StructField(c, S.DoubleType()) for c in ("size", "char", "overflow_px"))]))
def _tuned(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    names = np.array(STATUSES)
    for text, *numbers in batches:
        texts, columns = text.to_pylist(), [x.cast(pa.float64()).to_numpy(zero_copy_only=False) for x in numbers]
        parts = [_tuning(texts[c], *(x[c] for x in columns)) for c in _chunks(texts, np.full(len(texts), 9), np.nan_to_num(columns[0]))]
        status, *rest = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), *np.zeros((3, 0)))
        yield pa.StructArray.from_arrays([pa.array(names[status].tolist(), pa.string()), *(pa.array(x, from_pandas=True) for x in rest)], ["status", "size", "char", "overflow_px"])


def tuned_style(allow_size: bool = False) -> Column:
    """struct(status, size, char, overflow_px) over the rows of micro_tune."""
    delta = F.least(F.col("size") * 0.02, F.col("max_delta"))
    low, high = F.greatest("global_min", F.col("char") - delta), F.least("global_max", F.col("char") + delta)
    body, locked = F.coalesce(F.col("font_key") == "body", F.lit(False)), F.coalesce("locked", F.lit(False))
    least = F.when(locked | F.lit(not allow_size), F.col("size")).otherwise(F.greatest(F.lit(6.0), F.col("size") - 1.0))
    shrinks = F.coalesce(F.lit(allow_size) & ~F.col("locked"), F.lit(False))
    numbers = ("width", "height", "size", "line", "char", locked, body, "threshold", "limit", low, high, least, shrinks)
    return _tuned(T.text_of("text"), *((F.col(x) if isinstance(x, str) else x).cast("double") for x in numbers))


def micro_tune(rows: DataFrame, keys: list[str], allow_size: bool = False) -> DataFrame:
    """keys, status (perfect, tuned_expand, tuned_compact, tuned_size_down or overflow), size, char, overflow_px.

    rows: keys, text, width, height, size, line, char, locked, font_key, threshold (of
    underflow), limit (of safe fill), global_min, global_max, max_delta (of spacing). The
    base style stays if its fill lies between threshold and limit. An underfilled text
    tries wider spacings (8 steps of 0.004, other than body 6 of 0.003); then, or if it
    overflows, up to 6 narrower steps of 0.003; then smaller sizes where they are allowed.
    All that happens in the row: nothing is exploded or shuffled.
    """
    return rows.select(*keys, tuned_style(allow_size).alias("_t")).select(*keys, "_t.*")
