"""Removal of repeated passages by a suffix sort whose comparisons use prefix hashes.

A passage of MIN_WORDS words that occurs twice contains, at both places, the same anchor:
a gram of half that length whose hash is least among its neighbours. So the words around
repeated anchors are all that has to be sorted. Suffixes of one anchor and offset meet in
one task, in a mergesort that compares two of them by the length of their common start,
found by binary search over differences of prefix hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import materialise, pick, trimmed
from quire.llm.text import Words, mix, powers, words

MIN_WORDS = 50
#: Texts that are hashed at once, and contexts that are sorted at once (whole groups; a larger group by itself).
TEXTS, CONTEXTS = 512, 8_000
_U = np.uint64
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_BACK = np.ones(1, _U)


def _backs(n: int) -> np.ndarray:
    """The first n powers of the multiplier's inverse modulo 2**64."""
    global _BACK
    while len(_BACK) < n:
        with np.errstate(over="ignore"):
            _BACK = np.concatenate([_BACK, _BACK * (_BACK[-1] * _INVERSE)])
    return _BACK[:n]


class PrefixHashes:
    """Polynomial hashes of all prefixes of a sequence; of any range in constant time."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        self.sums = np.zeros(len(values) + 1, _U)
        np.cumsum(values * powers(len(values) + 1)[:-1], out=self.sums[1:])
        self.back = _backs(len(values) + 1)

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.back[start]

    def common(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """How many values the suffixes at a and b share at their start, up to `most`: a binary search."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), most)
        for _ in range(int(most).bit_length()):
            mid = (low + high + 1) // 2
            same = self.of(a, mid) == self.of(b, mid)
            low = np.where(same, mid, low)
            high = np.where(same, high, mid - 1)
        return low

    def below(self, a: np.ndarray, b: np.ndarray, most: int, or_equal: np.ndarray) -> np.ndarray:
        """Whether the suffix at a comes before that at b, or with it where or_equal holds."""
        n = self.common(a, b, most)
        end = len(self.values) - 1
        less = self.values[np.minimum(a + n, end)] < self.values[np.minimum(b + n, end)]
        return np.where(n >= most, or_equal, less)


def merge_sort(hashes: PrefixHashes, start: np.ndarray, segment: np.ndarray, most: int) -> np.ndarray:
    """The order of suffixes (by their first `most` values) within each segment; segments lie in a row.

    Runs double in length; all merges of a level are done at once, each element finding
    its rank in the sibling run by binary search.
    """
    n = len(start)
    order = np.arange(n)
    heads = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]]) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[heads, n])
    head, size = np.repeat(heads, sizes), np.repeat(sizes, sizes)
    width = 1
    while len(sizes) and width < sizes.max():
        live = np.flatnonzero(size > width)
        h, local = head[live], live - head[live]
        run = local // width
        right = run % 2 == 1
        begin = np.minimum((run ^ 1) * width, size[live])
        length = np.minimum(width, size[live] - begin)
        low, high = np.zeros(len(live), np.int64), length.copy()
        mine = start[order[live]]
        for _ in range(int(width).bit_length()):
            open_ = np.flatnonzero(low < high)
            mid = (low[open_] + high[open_]) // 2
            other = start[order[h[open_] + begin[open_] + mid]]
            less = hashes.below(other, mine[open_], most, right[open_])
            low[open_] = np.where(less, mid + 1, low[open_])
            high[open_] = np.where(less, high[open_], mid)
        target = h + (run - right) * width + (local - run * width) + low
        moved = order.copy()
        moved[target] = order[live]
        order = moved
        width *= 2
    return order


def classes(w: Words, start: np.ndarray, segment: np.ndarray, most: int) -> np.ndarray:
    """For each suffix (of `most` words at least) a number that equal ones of its segment share.

    Suffixes whose `most` words have a hash of their own in their segment equal no other and
    aren't sorted; those of one hash are sorted as one. Neighbours in suffix order that share
    `most` words by hash are compared byte for byte; a segment in which hashes collided is
    told apart by the bytes alone.
    """
    hashes = PrefixHashes(w.hash)
    total = len(start)
    h = hashes.of(start, most)
    by = np.lexsort((h, segment))
    heads = np.flatnonzero(np.r_[True, (h[by][1:] != h[by][:-1]) | (segment[by][1:] != segment[by][:-1])]) if total else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[heads, total])
    heads, sizes = heads[sizes > 1], sizes[sizes > 1]
    ranked = merge_sort(hashes, start[by[heads]], segment[by[heads]], most)
    heads, sizes = heads[ranked], sizes[ranked]
    order = by[np.arange(sizes.sum()) + np.repeat(heads - np.cumsum(sizes) + sizes, sizes)]
    s, g = start[order], segment[order]
    same = np.zeros(len(order), bool)
    same[1:] = (g[1:] == g[:-1]) & (h[order][1:] == h[order][:-1])
    at = np.flatnonzero(same)
    begin, end = w.start[s], w.end[s + most - 1]
    wrong = []
    for k in range(0, len(at), 20_000):
        own = at[k : k + 20_000]
        size = end[own] - begin[own]
        bad = size != end[own - 1] - begin[own - 1]
        ok = own[~bad]
        length = size[~bad]
        inner = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        differ = w.data[inner + np.repeat(begin[ok], length)] != w.data[inner + np.repeat(begin[ok - 1], length)]
        if len(ok):
            bad[~bad] = np.add.reduceat(differ, np.cumsum(length) - length) > 0
        wrong.append(g[own[bad]])
    out = 2 * total + 1 + np.arange(total)
    out[order] = np.cumsum(~same)
    for broken in np.unique(np.concatenate(wrong)) if wrong else []:
        seen: dict[bytes, int] = {}
        for k in np.flatnonzero(segment == broken):
            text = w.data[w.start[start[k]] : w.end[start[k] + most - 1]].tobytes()
            out[k] = seen.setdefault(text, total + int(k) + 1)
    return out


def _slide(x: np.ndarray, width: int, pick_) -> np.ndarray:
    """pick_ (minimum or maximum) over each `width` values in a row: doubled spans, two of which overlap."""
    span, out = 1, x
    while span * 2 <= width:
        out = pick_(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return pick_(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(w: Words, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors as (hash, first word): grams of most // 2 words that are least in some `most` words of their text."""
    gram = most // 2
    many = most - gram + 1  # grams that begin in a passage
    n = len(w.hash)
    if n < most:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    h = mix(PrefixHashes(w.hash).of(np.arange(n - gram + 1), gram))
    least = _slide(h, many, np.minimum)  # by first word of the passage
    whole = np.zeros(n - most + 1, bool)
    for a, b in zip(w.bounds[:-1], w.bounds[1:]):
        whole[a : max(a, b - most + 1)] = True
    least = np.where(whole, least, _U(0))
    padded = np.concatenate([np.zeros(many - 1, _U), least, np.zeros(len(h) - len(least), _U)])
    at = np.flatnonzero((_slide(padded, many, np.maximum) == h) & (h > 0))
    return h[at], at


def text_hashes(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each text's sequence of words, which together tell texts apart."""
    first = PrefixHashes(w.hash)
    second = PrefixHashes(mix(w.hash ^ _U(0xA5A5A5A55A5A5A5A)))
    return tuple(mix(x.of(w.bounds[:-1], w.count())).view(np.int64) for x in (first, second))


def _anchor_rows(most: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("hashes", pa.list_(pa.int64())), ("places", pa.list_(pa.int32()))])

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(k, TEXTS)
                w = words(batch.column(1), lower=False)
                long = np.flatnonzero(w.count() >= most)
                if not len(long):
                    continue
                d1, d2 = text_hashes(w)
                h, at = anchors(w, most)
                offsets = pa.array(np.r_[np.searchsorted(at, w.bounds[:-1][long]), len(at)].astype(np.int32))
                local = (at - w.bounds[:-1][np.searchsorted(w.bounds, at, side="right") - 1]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(long)), pa.array(w.count()[long]), pa.array(d1[long]), pa.array(d2[long]), pa.ListArray.from_arrays(offsets, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(local))], schema=schema)

    return run


def _context_rows(most: int):
    """From (doc_id, text, d1, hashes, places): each anchor with the words that passages around it can hold."""
    schema = pa.schema([("hash", pa.int64()), ("rep", pa.int64()), ("d1", pa.int64()), ("pos", pa.int32()), ("left", pa.int32()), ("context", pa.string())])

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 64):
                batch = whole.slice(k, 64)
                w = words(batch.column(1), lower=False)
                d1, _ = text_hashes(w)
                size = w.end - w.start  # the words again, with one space between them
                start = np.cumsum(size + 1) - size - 1
                flat = np.full(int((size + 1).sum()), 32, np.uint8)
                inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                flat[inner + np.repeat(start, size)] = w.data[inner + np.repeat(w.start, size)]
                raw, end = flat.tobytes(), start + size
                out: tuple[list, ...] = ([], [], [], [], [], [])
                for i, (doc, want, hs, ps) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), batch.column(4))):
                    if want != d1[i]:
                        continue
                    a, b = int(w.bounds[i]), int(w.bounds[i + 1])
                    p = ps.values.to_numpy().astype(np.int64) + a
                    low, high = np.maximum(p - (most - most // 2), a), np.minimum(p + most, b)
                    out[0].extend(hs.values.to_pylist())
                    out[1].extend([doc] * len(p))
                    out[2].extend([want] * len(p))
                    out[3].extend((p - a).tolist())
                    out[4].extend((p - low).tolist())
                    out[5].extend(raw[x:y] for x, y in zip(start[low].tolist(), end[high - 1].tolist()))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) if f.name != "context" else pa.array(x, pa.binary()).cast(pa.string()) for x, f in zip(out, schema)], schema=schema)

    return run


def _judge(batch: pa.Table, most: int) -> pa.RecordBatch:
    """For whole groups of anchors, in order of (hash, rep, d1, pos): at which offsets passages repeat, and repeat an earlier one."""
    keys = [batch.column(c).to_numpy() for c in ("hash", "rep", "d1", "pos")]
    fresh = np.ones(batch.num_rows, bool)  # a repeated row gives its contexts twice
    fresh[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    batch = batch if fresh.all() else batch.filter(pa.array(fresh)).combine_chunks()
    hash_, pos, left = (batch.column(c).to_numpy() for c in ("hash", "pos", "left"))
    reach = most - most // 2
    text = batch.column("context").combine_chunks().cast(pa.large_string())
    texts = (text.chunk(0) if isinstance(text, pa.ChunkedArray) else text).dictionary_encode()  # compares the bytes
    group = np.cumsum(np.r_[False, hash_[1:] != hash_[:-1]])
    key = np.stack([group, texts.indices.to_numpy().astype(np.int64), left.astype(np.int64)], axis=1)
    _, first, back, count = np.unique(key, axis=0, return_index=True, return_inverse=True, return_counts=True)
    back = back.reshape(-1)
    w = words(text.take(pa.array(first)), lower=False)
    offset = np.arange(reach + 1)
    begin = left[first][:, None] - offset
    fits = (begin >= 0) & (begin + most <= w.count()[:, None])
    ctx, off = np.nonzero(fits)
    segment = group[first][ctx] * (reach + 1) + off
    by = np.argsort(segment, kind="stable")
    ctx, off, segment = ctx[by], off[by], segment[by]
    number = classes(w, w.bounds[:-1][ctx] + begin[ctx, off], segment, most) if len(ctx) else np.zeros(0, np.int64)
    _, number = np.unique(number, return_inverse=True)
    number = number.reshape(-1)
    times = np.bincount(number, weights=count[ctx])
    earliest = np.full(len(times), len(hash_), np.int64)
    np.minimum.at(earliest, number, first[ctx])
    table = np.full(fits.shape, -1, np.int64)
    table[ctx, off] = number
    cls = table[back]
    known = cls >= 0
    repeats = known & (times[cls] > 1)
    later = repeats & (earliest[cls] != np.arange(len(hash_))[:, None])
    bits = np.int64(1) << offset.astype(np.int64)
    return pa.RecordBatch.from_arrays([batch.column("rep").combine_chunks(), batch.column("d1").combine_chunks(), pa.array(pos.astype(np.int64)), pa.array((repeats * bits).sum(1)), pa.array((later * bits).sum(1))], names=["rep", "d1", "pos", "repeats", "later"])


def _judge_rows(most: int):
    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < CONTEXTS:
                continue
            whole = pa.Table.from_batches(held)
            h = whole.column("hash").to_numpy()
            cut = int(np.searchsorted(h, h[-1]))  # the last group may go on
            if cut:
                yield _judge(whole.slice(0, cut).combine_chunks(), most)
                rest = whole.slice(cut).combine_chunks()
                held, rows = rest.to_batches(), rest.num_rows
        if rows:
            yield _judge(pa.Table.from_batches(held).combine_chunks(), most)

    return run


def _spans(starts: np.ndarray, most: int) -> list[dict]:
    """Passages of `most` words from the sorted starts, joined where they meet, as word ranges."""
    if not len(starts):
        return []
    new = np.flatnonzero(np.r_[True, starts[1:] > starts[:-1] + most])
    return [{"first": int(starts[a]), "last": int(starts[b]) + most} for a, b in zip(new, np.r_[new[1:] - 1, len(starts) - 1])]


def _span_rows(most: int):
    span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    schema = pa.schema([("rep", pa.int64()), ("d1", pa.int64()), ("repeated", span), ("removed", span)])
    offset = np.arange(most - most // 2 + 1)

    def run(batches):
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for marks in batch.column(2):
                pos, repeats, later = (marks.values.field(c).to_numpy() for c in ("pos", "repeats", "later"))
                for column, mask in zip(out, (repeats, later)):
                    i, o = np.nonzero((mask[:, None] >> offset) & 1)
                    column.append(_spans(np.unique(pos[i] - o), most))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out[0], span), pa.array(out[1], span)], schema=schema)

    return run


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with passages of min_words words or more that occur elsewhere, in any document or in the same.

    Columns: doc_id, text_hash (tells texts under one doc_id apart), n_words, repeated and
    removed: arrays of (first, last), ranges of words. `repeated` covers every word in a
    run of min_words words that occurs twice or more; `removed` those in a run that occurs
    before, in order of (doc_id, text_hash, place). So the first occurrence of everything
    stays. Words are told apart with case and punctuation; white space doesn't matter.

    Texts that are alike word for word are searched once, as the least doc_id; the others
    are repeated, and removed, as a whole. Texts of fewer than min_words words, empty and
    NULL ones have no passages, and rows with NULL doc_id are left out. Repeats of a row
    count as one. Very long texts are searched whole. An empty table gives no rows.
    """
    if not 4 <= min_words <= 120:
        raise ValueError("min_words must lie between 4 and 120")
    most = min_words
    texts = pick(docs, doc_id=id_col, text=text_col).where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    hashed = texts.mapInArrow(trimmed(_anchor_rows(most)), "doc_id long, n_words long, d1 long, d2 long, hashes array<long>, places array<int>")
    groups = hashed.groupBy("d1", "d2", "n_words").agg(F.array_sort(F.collect_set("doc_id")).alias("ids"), F.first(F.struct("hashes", "places")).alias("f"))
    groups = materialise(groups.select(F.col("ids")[0].alias("rep"), "d1", "n_words", "ids", "f.hashes", "f.places"), "texts")
    flat = groups.select("rep", "d1", F.inline(F.arrays_zip("hashes", "places"))).toDF("rep", "d1", "hash", "pos")
    w = Window.partitionBy("hash").orderBy("rep", "d1", "pos")
    twice = flat.select("*", F.lag("pos").over(w).isNotNull().alias("p"), F.lead("pos").over(w).isNotNull().alias("q")).where("p or q")
    wanted = twice.groupBy("rep", "d1").agg(F.collect_list("hash").alias("hashes"), F.collect_list("pos").alias("places"))
    found = texts.join(wanted, texts.doc_id == wanted.rep).select("doc_id", "text", "d1", "hashes", "places").mapInArrow(trimmed(_context_rows(most)), "hash long, rep long, d1 long, pos int, left int, context string")
    sorted_ = found.repartition("hash").sortWithinPartitions("hash", "rep", "d1", "pos")
    marks = sorted_.mapInArrow(trimmed(_judge_rows(most)), "rep long, d1 long, pos long, repeats long, later long").where("repeats <> 0")
    span = "array<struct<first:bigint,last:bigint>>"
    spans = marks.groupBy("rep", "d1").agg(F.collect_list(F.struct("pos", "repeats", "later")).alias("marks")).mapInArrow(trimmed(_span_rows(most)), f"rep long, d1 long, repeated {span}, removed {span}")
    out = groups.select("rep", "d1", "n_words", "ids").join(spans, ["rep", "d1"], "left").where("repeated is not null or size(ids) > 1")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_words").alias("last")))
    nothing = F.array().cast(span)
    rows = out.select("*", F.explode("ids").alias("doc_id"))
    return rows.select("doc_id", F.col("d1").alias("text_hash"), "n_words", F.when(F.size("ids") > 1, whole).otherwise(F.col("repeated")).alias("repeated"), F.when(F.col("doc_id") != F.col("rep"), whole).otherwise(F.coalesce("removed", nothing)).alias("removed"))


def repeated_passages_sql(min_words: int = MIN_WORDS) -> str:
    """passage_rows(repeated_passages(documents)) in DuckDB, for tables with one text per doc_id."""
    m = min_words
    return rf"""
with ws as (select distinct doc_id, regexp_extract_all(text, '[^ \t\n\r\f]+') as w from documents where doc_id is not null and text is not null),
runs as (select doc_id, len(w) as n, unnest(range(0, len(w) - {m} + 1)) as i, w from ws where len(w) >= {m}),
keyed as (select doc_id, n, i, md5(array_to_string(w[i + 1:i + {m}], ' ')) as k from runs),
marked as (select *, count(*) over (partition by k) as c, row_number() over (partition by k order by doc_id, i) as nth from keyed),
hits as (select doc_id, n, i, false as removed from marked where c > 1 union all select doc_id, n, i, true from marked where nth > 1),
starts as (select *, i > coalesce(lag(i) over (partition by doc_id, removed order by i), -{m} - 1) + {m} as fresh from hits),
islands as (select *, sum(fresh::int) over (partition by doc_id, removed order by i) as g from starts)
select doc_id, cast(n as bigint) as n_words, removed, cast(min(i) as bigint) as first_word, cast(max(i) + {m} as bigint) as end_word from islands group by doc_id, n, removed, g"""


def passage_rows(passages: DataFrame) -> DataFrame:
    """One row for each passage: doc_id, n_words, removed (else it is one that is repeated somewhere), first_word, end_word (exclusive)."""
    flat = F.concat(*(F.expr(f"transform({k}, s -> struct({k == 'removed'} as removed, s.first as first_word, s.last as end_word))") for k in ("repeated", "removed")))
    return passages.select("doc_id", "n_words", F.inline(flat))


def remove_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, source, n_chars) without the removed passages; n_chars follows.

    What is left of a text keeps its white space but at the cuts, where a newline stands.
    Documents without a removed passage stay as they are; those with nothing left go.
    """
    cuts = passages.where("size(removed) > 0").groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("text_hash", "removed")).alias("_cuts"))

    def cut(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, TEXTS):
                yield without(whole.slice(k, TEXTS))

    def without(batch):
        names = batch.schema.names
        w = words(batch.column(names.index("text")), lower=False)
        d1, _ = text_hashes(w)
        texts = batch.column(names.index("text")).to_pylist()
        for i, cuts_ in enumerate(batch.column(names.index("_cuts")).to_pylist()):
            spans = next((c["removed"] for c in cuts_ if c["text_hash"] == d1[i]), [])
            if not spans:
                continue
            a, b = int(w.bounds[i]), int(w.bounds[i + 1])
            edges = [0, *(x for s in spans for x in (s["first"], s["last"])), b - a]
            pieces = [w.piece(a + x, a + y) for x, y in zip(edges[::2], edges[1::2])]
            texts[i] = "\n".join(p for p in pieces if p)
        arrays = {n: batch.column(k) for k, n in enumerate(names) if n != "_cuts"}
        arrays["text"] = pa.array(texts, pa.string())
        arrays["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
        return pa.RecordBatch.from_pydict(arrays).filter(pa.array([t != "" for t in texts]))

    joined = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long")).join(cuts, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    touched = joined.where("_cuts is not null").mapInArrow(trimmed(cut), "doc_id long, text string, lang string, source string, n_chars long")
    return joined.where("_cuts is null").drop("_cuts").unionByName(touched)
