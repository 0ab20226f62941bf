"""N-gram Jaccard join, exact: rarest grams first, inverted lists of those, overlaps from whole sets."""

from __future__ import annotations

import struct
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import materialise, pick, trimmed
from quire.llm.text import mix, ngrams, words

NGRAM, THRESHOLD = 3, 0.5
#: Sets of one list that meet at once; longer lists are cut into parts, and every two parts meet.
LIST = 2000
#: Sets of one list from which on, and columns by which, pairs are judged by matrix products.
BLOCK, COLUMNS = 64, 1024
TEXTS, PAIRS = 512, 200_000
#: Grams that are sorted into buckets at once, bytes of text for each bucket, and the least lists of a set that travel with it.
GRAMS, BUCKET, SKETCH = 2_000_000, 10_000_000, 16
#: Rare grams of a bucket; least number of those buckets; buckets of grams for each one that claims go to; messages of an Arrow batch.
RARE, LEAST, CLAIMS, ROWS = 500_000, 48, 64, 256
_U = np.uint64
_LOW = _U(2**48 - 1)


def _sets(column, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct gram hashes of each text, one after the other, and their bounds."""
    grams, bounds = ngrams(words(column), n)
    owner = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint16), np.diff(bounds))
    order = np.argsort(grams)
    order = order[np.argsort(owner[order], kind="stable")]
    g, o = grams[order], owner[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (o[1:] != o[:-1])
    g, o = g[new], o[new]
    return g, np.searchsorted(o, np.arange(len(bounds)))


def _names(g: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which texts have grams, and the name of each one's set: a hash of all its grams."""
    size = np.diff(bounds)
    has = np.flatnonzero(size)
    if not len(has):
        return has, np.zeros(0, np.int64)
    one, two = (np.add.reduceat(mix(g ^ np.uint64(salt)), bounds[:-1][has]) for salt in (0x5BD1E995, 0x27D4EB2F165667C5))
    return has, mix(one + mix(two + size[has].astype(np.uint64))).view(np.int64)


#: A message: keys (48 bits each) of several sets with a class (0 where none), to one bucket of keys or of sets.
MESSAGE = "bucket int, sids binary, sizes binary, counts binary, low binary, high binary, classes binary"
_PARTS = {"sids": np.int64, "sizes": np.int64, "counts": np.uint32, "low": np.uint32, "high": np.uint16, "classes": np.uint16}


def _messages(to: np.ndarray, sids: np.ndarray, sizes: np.ndarray, owner: np.ndarray, keys: np.ndarray, classes: np.ndarray | None = None):
    """Messages of the keys by bucket; the owners (places in sids, in order within a bucket) are written once each."""
    if not len(to):
        return
    heads = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(to)]):
        own = owner[a:b]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        part = {"sids": sids[own[first]], "sizes": sizes[own[first]], "counts": np.diff(np.r_[first, b - a]), "low": keys[a:b] & _U(2**32 - 1), "high": keys[a:b] >> _U(32), "classes": classes[a:b] if classes is not None else np.zeros(0)}
        yield int(to[a]), *(part[k].astype(kind).tobytes() for k, kind in _PARTS.items())


def _gather(cells: list) -> tuple[np.ndarray, ...]:
    """Messages put together: the sets (sids, sizes; in order of sid) and for each key its owner, the key and its class."""
    sids, sizes, counts, low, high, classes = (np.concatenate([np.frombuffer(c[k], kind) for c in cells]) for k, kind in enumerate(_PARTS.values()))
    sids, first, back = np.unique(sids, return_index=True, return_inverse=True)
    owner = np.repeat(back.reshape(-1).astype(np.int32), counts)
    return sids, sizes[first], owner, low.astype(_U) | high.astype(_U) << _U(32), classes


def _by_bucket(batches, of: int):
    """The messages of each bucket; columns of the message begin at `of`."""
    held: dict[int, list] = {}
    for batch in batches:
        columns = [batch.column(of + k) for k in range(1 + len(_PARTS))]
        for row in zip(*(c.to_pylist() for c in columns)):
            if row[0] is not None and row[1] is not None:
                held.setdefault(row[0], []).append(row[1:])
    for bucket in sorted(held):
        yield _gather(held.pop(bucket))


def _targets(sids: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(sids.view(_U)) % _U(buckets)).astype(np.uint16)


def _back(sids: np.ndarray, sizes: np.ndarray, owner: np.ndarray, keys: np.ndarray, classes: np.ndarray, buckets: int):
    """Messages to the buckets of the sets."""
    to = _targets(sids, buckets)
    rank = np.empty(len(sids), np.int64)
    rank[np.lexsort((sids, to))] = np.arange(len(sids))
    order = np.argsort(rank[owner], kind="stable")
    return _messages(to[owner[order]], sids, sizes, owner[order], keys[order], classes[order])


def _runs(owner: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, key) in order of keys, each once, of the keys that two sets or more have; and the starts of the keys' runs."""
    order = np.argsort(keys)
    k = keys[order]
    same = np.r_[k[1:] == k[:-1], False] if len(k) else np.zeros(0, bool)
    order = order[same | np.r_[False, same[:-1]]] if len(k) else order
    order = order[np.lexsort((owner[order], keys[order]))]
    o, k = owner[order], keys[order]
    for _ in range(2):  # repeats of a set go, then keys that only one set has
        new = np.r_[True, (k[1:] != k[:-1])] if len(k) else np.zeros(0, bool)
        fresh = new | np.r_[True, o[1:] != o[:-1]] if len(k) else new
        o, k = o[fresh], k[fresh]
        heads = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
        size = np.diff(np.r_[heads, len(k)])
        many = np.repeat(size > 1, size)
        o, k = o[many], k[many]
    heads = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return o, k, heads


def _arrow(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


_MESSAGE = pa.schema([("bucket", pa.int32()), *((k, pa.binary()) for k in _PARTS)])


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> _U(24)) * _U(buckets) >> _U(24)).astype(np.uint16)


def _sent(keys: np.ndarray, sids: np.ndarray, sizes: np.ndarray, owner: np.ndarray, buckets: int):
    """Messages of keys to the buckets of keys."""
    to = _bucket_of(keys, buckets)
    order = np.argsort(to, kind="stable")
    return _messages(to[order], sids, sizes, owner[order], keys[order])


def _whole(width: int) -> int:
    """Bytes of the least integer type of `width` bits."""
    return next(k for k in (1, 2, 4, 8) if 8 * k >= width)


def _bits(values: np.ndarray, width: int) -> bytes:
    """The lowest `width` bits of each value."""
    size = _whole(width)
    each = np.unpackbits(values.astype(f"<u{size}").view(np.uint8).reshape(-1, size), axis=1, count=width, bitorder="little")
    return np.packbits(each.reshape(-1), bitorder="little").tobytes()


def _values(data: np.ndarray, m: int, width: int) -> np.ndarray:
    """m values of `width` bits each."""
    size = _whole(width)
    out = np.zeros((m, size), np.uint8)
    if width:
        out[:, : -(-width // 8)] = np.packbits(np.unpackbits(data, count=m * width, bitorder="little").reshape(m, width), axis=1, bitorder="little")
    return out.view(f"<u{size}").reshape(-1).astype(_U)


_HEAD = struct.Struct("<IIQBB")


def _close(keys: np.ndarray, owner: np.ndarray, classes: np.ndarray | None = None) -> bytes:
    """Sorted keys with their owners (places in a flush) and classes, in about as few bits as they need.

    Of a key's distance from the first one, the low bits are written as they are and the
    rest, which never falls, in unary (Elias-Fano); an owner takes the bits of the largest.
    """
    m, d = len(keys), keys - keys[0]
    low = max(0, (int(d[-1]) // m).bit_length() - 1)
    high = (d >> _U(low)).astype(np.int64)
    marks = np.zeros(int(high[-1]) + m, np.uint8)
    marks[high + np.arange(m)] = 1
    wide = int(owner.max()).bit_length()
    head = _HEAD.pack(m, int(high[-1]), int(keys[0]), low, wide)
    return b"".join((head, np.packbits(marks, bitorder="little").tobytes(), _bits(d, low), _bits(owner, wide), b"" if classes is None else classes.astype(np.uint8).tobytes()))


def _open(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, owners and classes (empty if none were written) of _close()."""
    m, top, first, low, wide = _HEAD.unpack_from(body)
    data, at = np.frombuffer(body, np.uint8), _HEAD.size

    def take(bits: int) -> np.ndarray:
        nonlocal at
        at += -(-bits // 8)
        return data[at - -(-bits // 8) : at]

    high = np.flatnonzero(np.unpackbits(take(top + m), count=top + m, bitorder="little")) - np.arange(m)
    keys = (high.astype(_U) << _U(low)) + _values(take(m * low), m, low) + _U(first)
    return keys, _values(take(m * wide), m, wide).astype(np.int64), data[at:]


#: What goes to a bucket about a flush (the sets that one task sorts at once): grams to a bucket of grams and those that
#: others have back, claims of sets to a bucket of sets and back those that stand. A set is named by flush and place, so
#: that a gram's message is as short however many buckets there are.
_SENT, _SHARED, _CLAIMED, _STANDS = range(4)
FLUSHED = "bucket int, flush long, kind tinyint, body binary"
_CLAIM = np.dtype([("sid", np.int64), ("n", np.uint32), ("place", np.uint32)])


def _packets(rows, own: pa.Schema):
    """Batches of messages (bucket, flush, kind, body), the columns of texts being NULL."""
    schema = pa.schema([*own, ("bucket", pa.int32()), ("flush", pa.int64()), ("kind", pa.int8()), ("body", pa.binary())])
    rows = iter(rows)
    while some := list(islice(rows, ROWS)):
        nothing = [pa.nulls(len(some), f.type) for f in own]
        yield pa.RecordBatch.from_arrays([*nothing, *(pa.array(c, f.type) for c, f in zip(zip(*some), list(schema)[len(own) :]))], schema=schema)


def _cut(of: np.ndarray):
    """(value, from, to) of each run of equal values."""
    heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else of
    return zip(of[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(of)])


def _home(flushes: np.ndarray, buckets: int) -> np.ndarray:
    """The buckets of flushes (task << 32 | number), more evenly spread than by a hash: two irrational strides."""
    x = (flushes >> 32) * 0.6180339887498949 + (flushes & (2**32 - 1)) * 0.7548776662466927
    return (x % 1 * buckets).astype(np.int64)


def _held(batch: pa.RecordBatch, held: dict) -> pa.RecordBatch:
    """Puts the messages of a batch into held, by bucket and kind; gives the rows of texts."""
    is_text = batch.column(6).is_null()
    for bucket, flush, kind, body in zip(*(c.to_pylist() for c in batch.filter(batch.column(6).is_valid()).columns[4:])):
        held.setdefault(bucket, ([], [], [], []))[kind].append((flush, body))
    return batch.filter(is_text)


def _sign(n: int, buckets: int):
    """For (doc_id, text, h): a row for each text (sid NULL and n 0 where it has no grams), and messages of grams and sets to buckets."""

    def messages(held: list, flush: int):
        g = np.concatenate([x[0] for x in held]) & _LOW
        sids, sizes = (np.concatenate([x[k] for x in held]) for k in (1, 2))
        once = np.sort(np.unique(sids, return_index=True)[1])
        place = np.full(len(sids), -1, np.int32)
        place[once] = np.arange(len(once))
        o = np.repeat(place, sizes)
        g, o, sids, sizes = g[o >= 0], o[o >= 0], sids[once], sizes[once]
        order = np.argsort(g)
        g, o = g[order], o[order]
        same = g[1:] == g[:-1]
        many = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
        o[many] = o[many[np.lexsort((o[many], g[many]))]]
        fresh = np.r_[True, ~same | (o[1:] != o[:-1])]  # 48 bits of two grams of a set can be equal
        g, o = g[fresh], o[fresh]
        for to, a, b in _cut(_bucket_of(g, buckets)):
            yield to, flush, _SENT, _close(g[a:b], o[a:b])
        to = _targets(sids, -(-buckets // CLAIMS)).astype(np.int64) * CLAIMS
        order = np.argsort(to, kind="stable")
        claims = np.empty(len(sids), _CLAIM)
        claims["sid"], claims["n"], claims["place"] = sids[order], sizes[order], order
        for bucket, a, b in _cut(to[order]):
            yield bucket, flush, _CLAIMED, claims[a:b].tobytes()

    def run(batches):
        held, grams, flushes = [], 0, count(TaskContext.get().partitionId() << 32)
        for whole in batches:
            own = pa.schema([("doc_id", whole.schema.field(0).type), ("h", pa.int64()), ("sid", pa.int64()), ("n", pa.int64())])
            for k in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(k, TEXTS)
                g, bounds = _sets(batch.column(1), n)
                has, names = _names(g, bounds)
                size = np.diff(bounds).astype(np.int64)
                sid = np.zeros(len(size), np.int64)
                sid[has] = names
                to = pa.array((mix(batch.column(2).to_numpy(zero_copy_only=False).view(_U)) % _U(buckets)).astype(np.int32))
                columns = {"doc_id": batch.column(0), "h": batch.column(2), "sid": pa.array(sid, mask=size == 0), "n": pa.array(size), "bucket": to}
                nothing = {k: pa.nulls(len(size), kind) for k, kind in (("flush", pa.int64()), ("kind", pa.int8()), ("body", pa.binary()))}
                yield pa.RecordBatch.from_pydict(columns | nothing)
                if len(has):
                    held.append((g, names, size[has]))
                    grams += len(g)
                if grams >= GRAMS:
                    yield from _packets(messages(held, next(flushes)), own)
                    held, grams = [], 0
        if held:
            yield from _packets(messages(held, next(flushes)), own)

    return run


def _count(buckets: int):
    """Passes rows of texts on; sends back the grams of a bucket that occur twice or more, with a class that grows with their number, and of equal sets' claims the first."""

    def shared(sent: list):
        parts = [_open(body) for _, body in sent]
        keys, places = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        at = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p[0]) for p in parts])
        del parts
        order = np.argsort(keys)
        k = keys[order]
        same = k[1:] == k[:-1]
        many = np.r_[same, False] | np.r_[False, same]
        order, k = order[many], k[many]
        times = np.diff([*(a for _, a, _ in _cut(k)), len(k)])
        level = np.repeat(np.minimum(np.floor(8 * np.log2(np.maximum(times, 1))), 255).astype(np.uint8), times)
        back = np.lexsort((k, at[order]))
        order, level = order[back], level[back]
        home = _home(np.array([flush for flush, _ in sent], np.int64), buckets).tolist()
        for m, a, b in _cut(at[order]):
            yield home[m], sent[m][0], _SHARED, _close(keys[order[a:b]], places[order[a:b]], level[a:b])

    def standing(claimed: list):
        claims = np.concatenate([np.frombuffer(body, _CLAIM) for _, body in claimed])
        flush = np.repeat(np.array([f for f, _ in claimed], np.int64), [len(body) // _CLAIM.itemsize for _, body in claimed])
        order = np.lexsort((claims["place"], flush, claims["sid"]))
        sid = claims["sid"][order]
        order = order[np.r_[True, sid[1:] != sid[:-1]]]
        order = order[np.argsort(flush[order], kind="stable")]
        for f, a, b in _cut(flush[order]):
            yield int(_home(np.array([f]), buckets)[0]), f, _STANDS, claims[order[a:b]].tobytes()

    def run(batches):
        held, own = {}, None
        for batch in batches:
            own = pa.schema(list(batch.schema)[:4])
            texts = _held(batch, held)
            if texts.num_rows:
                yield texts
        for bucket in sorted(held):
            sent, _, claimed, _ = held.pop(bucket)
            if sent:
                yield from _packets(shared(sent), own)
            if claimed:
                yield from _packets(standing(claimed), own)

    return run


def _survive(t: float):
    """Passes rows of texts on; gives the sets enough of whose grams occur elsewhere: grams (those, rarest first) and rare (how many of them a partner's rarest can be among)."""

    def sets(shared: list, standing: list):
        claims = np.concatenate([np.frombuffer(body, _CLAIM) for body in standing])
        sids, sizes = claims["sid"], claims["n"].astype(np.int64)
        parts = [_open(body) for body in shared]
        keys, places, classes = (np.concatenate([p[k] for p in parts]) for k in range(3))
        at = np.full(max(int(places.max()), int(claims["place"].max())) + 1, -1, np.int64)
        at[claims["place"]] = np.arange(len(claims))
        owner = at[places]
        owner, keys, classes = (x[owner >= 0] for x in (owner, keys, classes))
        need = np.ceil(t * sizes - 1e-9).astype(np.int64)
        ok = np.bincount(owner, minlength=len(sids)) >= need
        owner, keys, classes = (x[ok[owner]] for x in (owner, keys, classes))
        order = np.lexsort((keys, classes, owner))
        keys, at = keys[order], np.flatnonzero(ok)
        bounds = np.searchsorted(owner[order], np.r_[at, len(sids)])
        for a in range(0, len(at), TEXTS):
            i = at[a : a + TEXTS]
            b = bounds[a : a + TEXTS + 1]
            grams = pa.array([keys[x:y].tobytes() for x, y in zip(b[:-1].tolist(), b[1:].tolist())], pa.binary())
            yield [pa.array(sids[i]), pa.array(sizes[i]), pa.array(np.diff(b) - need[i] + 1), grams]

    def run(batches):
        held, schema = {}, None
        for batch in batches:
            schema = pa.schema([*list(batch.schema)[:4], ("rare", pa.int64()), ("grams", pa.binary())])
            texts = _held(batch, held)
            if texts.num_rows:
                yield pa.RecordBatch.from_arrays([*texts.columns[:4], pa.nulls(texts.num_rows, pa.int64()), pa.nulls(texts.num_rows, pa.binary())], schema=schema)
        for bucket in sorted(held):
            flushes: dict[int, tuple[list, list]] = {}
            _, shared, _, standing = held.pop(bucket)
            for k, messages in enumerate((shared, standing)):
                for flush, body in messages:
                    flushes.setdefault(flush, ([], []))[k].append(body)
            for flush in sorted(flushes):
                bodies = flushes.pop(flush)
                if all(bodies):
                    for columns in sets(*bodies):
                        nothing = [pa.nulls(len(columns[0]), f.type) for f in list(schema)[:2]]
                        yield pa.RecordBatch.from_arrays([*nothing, *columns], schema=schema)

    return run


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a column of binary cells, one after the other, and how many each cell has."""
    cells = column.to_pylist()
    return np.frombuffer(b"".join(cells), _U), np.array([len(c) // 8 for c in cells], np.int64)


def _rare(buckets: int):
    """Messages of the rare grams of sets (sid, n, rare, grams) to buckets."""

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, LIST):
                sid, n, rare, grams = whole.slice(k, LIST).columns
                keys, size = _flat(grams)
                owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
                front = np.arange(len(keys)) - np.repeat(np.cumsum(size) - size, size) < rare.to_numpy()[owner]
                for row in _sent(keys[front], sid.to_numpy(), n.to_numpy(), owner[front], buckets):
                    yield _arrow([row], _MESSAGE)

    return run


def _lists(buckets: int):
    """The inverted lists of a bucket's rare grams, equal lists once, as messages to the sets; a list's key is a hash of its sets."""

    def run(batches):
        for sids, sizes, owner, keys, _ in _by_bucket(batches, 0):
            o, k, heads = _runs(owner, keys)
            if not len(k):
                continue
            hashed = mix(np.add.reduceat(mix(sids[o].view(_U) ^ _U(0x5BD1E995)), heads))
            size = np.diff(np.r_[heads, len(k)])
            alone = np.zeros(len(heads), bool)
            alone[np.unique(hashed, return_index=True)[1]] = True
            name = hashed & _U(2**32 - 1)  # two lists of one name meet as one: more candidates, none lost
            keep = np.repeat(alone, size)
            for row in _back(sids, sizes, o[keep], np.repeat(name, size)[keep], np.zeros(keep.sum()), buckets):
                yield _arrow([row], _MESSAGE)

    return run


def _postings(batches):
    """A row for each set and list: list, sid, n, sketch (the SKETCH least lists of the set)."""
    for sids, sizes, owner, keys, _ in _by_bucket(batches, 0):
        order = np.lexsort((keys, owner))
        o, k = owner[order], keys[order].astype(np.uint32)
        fresh = np.r_[True, (k[1:] != k[:-1]) | (o[1:] != o[:-1])]
        o, k = o[fresh], k[fresh]
        place = np.arange(len(o)) - np.searchsorted(o, o)
        sketch = np.full((len(sids), SKETCH), 2**32 - 1, np.uint32)
        front = place < SKETCH
        sketch[o[front], place[front]] = k[front]
        for a in range(0, len(o), 10_000):
            i = o[a : a + 10_000]
            offsets = np.arange(len(i) + 1, dtype=np.int32) * (4 * SKETCH)
            cells = pa.Array.from_buffers(pa.binary(), len(i), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(sketch[i]))])
            yield pa.RecordBatch.from_arrays([pa.array(k[a : a + 10_000].astype(np.int64)), pa.array(sids[i]), pa.array(sizes[i]), cells], names=["list", "sid", "n", "sketch"])


def _products(values: np.ndarray, owner: np.ndarray, a: slice, b: slice, m: int) -> np.ndarray:
    """How many values each two of the m sets (rows a, columns b) share, by matrix products; values of a set are distinct."""
    _, back, count = np.unique(values, return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1
    many = count[back] > 1
    column, owner = rank[back[many]], owner[many]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(range(*a.indices(m))), len(range(*b.indices(m)))), np.float32)
    for low in range(0, int(rank[-1]) + 1 if len(rank) else 0, COLUMNS):
        x, y = np.searchsorted(column, [low, low + COLUMNS])
        has = np.zeros((m, COLUMNS), np.float32)
        has[owner[x:y], column[x:y] - low] = 1
        out += has[a] @ has[b].T
    return out


def _meet(t: float, part: int, most: int):
    """Pairs of sets that have a list in common: rows (block, sid, at) of the sets of a block and (block, pairs) of places in it.

    A pair meets in all lists that both sets are in. It is taken in one if the sketches have
    no lesser list in common, so at least in the least of all; and there alone if that list
    is in both sketches. Other pairs may be taken again: they are put in blocks below 0. Lists of more than `most` sets
    meet by parts.
    """

    def small(rows: dict, left: np.ndarray, right: np.ndarray):
        n = rows["n"]
        keep = np.minimum(n[left], n[right]) >= t * np.maximum(n[left], n[right]) - 1e-9
        left, right = left[keep], right[keep]
        x, y, key = rows["sketch"][left], rows["sketch"][right], rows["list"][left]
        lesser = np.zeros(len(left), bool)
        for k in range(SKETCH):
            lesser |= (x[:, k] < key) & (y == x[:, k, None]).any(1)
        return left[~lesser], right[~lesser]

    def large(rows: dict, a: int, b: int):
        """Parts of the list in rows a to b, every two of them."""
        for i in range(a, b, part):
            for j in range(i, b, part):
                own = np.r_[np.arange(i, min(i + part, b)), np.arange(j, min(j + part, b)) if j > i else np.zeros(0, np.int64)]
                m, cut = len(own), min(part, b - i)
                rows_, columns = slice(0, cut), slice(cut, m) if j > i else slice(0, m)
                sketch = rows["sketch"][own]
                o, c = np.nonzero(sketch < rows["list"][a])
                shared = _products(sketch[o, c], o, rows_, columns, m)
                n = rows["n"][own]
                x, y = n[rows_][:, None], n[columns][None, :]
                take = (shared == 0) & (np.minimum(x, y) >= t * np.maximum(x, y) - 1e-9)
                if j == i:
                    take = np.triu(take, 1)
                x, y = np.nonzero(take)
                if len(x):
                    yield own[x], own[y + (cut if j > i else 0)]

    def settle(rows: dict):
        list_ = rows["list"]
        total = len(list_)
        heads = np.flatnonzero(np.r_[True, list_[1:] != list_[:-1]])
        size = np.diff(np.r_[heads, total])
        ends = np.repeat(heads + size, size)
        partners = np.where(np.repeat(size, size) <= most, ends - np.arange(total) - 1, 0)
        before = np.concatenate([[0], np.cumsum(partners)])
        at = 0
        while at < total:
            to = max(at + 1, int(np.searchsorted(before, before[at] + PAIRS, "right")) - 1)
            to = min(to, at + part, total)
            count = partners[at:to]
            if count.any():
                left = np.repeat(np.arange(at, to), count)
                right = left + 1 + np.arange(count.sum()) - np.repeat(before[at:to] - before[at], count)
                yield small(rows, left, right)
            at = to
        for a, b in zip(heads[size > most].tolist(), (heads + size)[size > most].tolist()):
            yield from large(rows, a, b)

    schema = pa.schema([("block", pa.int64()), ("sid", pa.int64()), ("at", pa.int32()), ("pairs", pa.binary())])

    def blocks(rows: dict, serial):
        last = rows["sketch"][:, -1]
        for left, right in settle(rows):
            again = rows["list"][left] > np.minimum(last[left], last[right])
            for below in (False, True):
                x, y = left[again == below], right[again == below]
                if not len(x):
                    continue
                block = (int(rows["list"][x[0]]) << 24) | next(serial) % 2**24
                block = -1 - block if below else block
                sids, places = np.unique(rows["sid"][np.concatenate([x, y])], return_inverse=True)
                pairs = np.sort(places.reshape(2, -1).astype(np.uint16).T, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sids), block)), pa.array(sids), pa.array(np.arange(len(sids), dtype=np.int32)), pa.nulls(len(sids), pa.binary())], schema=schema)
                yield _arrow([(block, None, None, pairs.tobytes())], schema)

    def run(batches):
        held, serial = None, count()
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {k: batch.column(i).to_numpy() for i, k in enumerate(("list", "sid", "n"))}
            rows["sketch"] = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint32).reshape(-1, SKETCH)
            if held:
                rows = {k: np.concatenate([held[k], v]) for k, v in rows.items()}
            last = int(np.searchsorted(rows["list"], rows["list"][-1]))
            held = {k: v[last:] for k, v in rows.items()}
            if last:
                yield from blocks({k: v[:last] for k, v in rows.items()}, serial)
        if held:
            yield from blocks(held, serial)

    return run


def _verify(t: float, links: bool):
    """Judges the pairs of each block on whole sets (block, pairs, at, sid, n, grams): gives (a, b, jaccard) of those that reach the threshold.

    With links: (sid, root, links) of each set, where links are the pairs that it is in and
    root is a set that they connect it with; from blocks below 0 (a, b, NULL) for each pair.
    """

    def similar(sids, n, grams, pairs):
        """Places of the pairs that reach the threshold, and their indices."""
        m = len(sids)
        if m > BLOCK and len(pairs) > 0.02 * m * m:
            flat, size = np.concatenate(grams), np.array([len(g) for g in grams])
            shared = _products(flat, np.repeat(np.arange(m), size), slice(0, m), slice(0, m), m)[pairs[:, 0], pairs[:, 1]].astype(np.int64)
        else:
            shared = np.zeros(len(pairs), np.int64)
            heads = np.flatnonzero(np.r_[True, pairs[1:, 0] != pairs[:-1, 0]])
            for x, y in zip(heads.tolist(), [*heads[1:].tolist(), len(pairs)]):
                own = np.sort(grams[pairs[x, 0]])
                theirs = [grams[k] for k in pairs[x:y, 1].tolist()]
                size = np.array([len(g) for g in theirs])
                flat = np.concatenate(theirs)
                place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                shared[x:y] = np.add.reduceat((own[place] == flat).astype(np.int64), np.cumsum(size) - size)
        union = n[pairs].sum(1) - shared
        ok = shared >= t * union - 1e-12
        return pairs[ok], shared[ok] / union[ok]

    def settle(held):
        cells = [h[1] for h in held if h[1] is not None]
        sets = sorted((h[2:] for h in held if h[1] is None), key=lambda x: x[0])
        sids, n = (np.array([s[k] for s in sets], np.int64) for k in (1, 2))
        pairs = np.frombuffer(b"".join(cells), np.uint16).astype(np.int64)
        pairs = np.unique(pairs[::2] << 16 | pairs[1::2])
        pairs, jaccard = similar(sids, n, [np.frombuffer(s[3], _U) for s in sets], np.stack([pairs >> 16, pairs & 65535], axis=1))
        return pa.RecordBatch.from_arrays([pa.array(sids[pairs[:, 0]]), pa.array(sids[pairs[:, 1]]), pa.array(jaccard)], names=["a", "b", "jaccard"])

    def linked(found: pa.RecordBatch):
        a, b = (found.column(k).to_numpy() for k in (0, 1))
        sids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = at.reshape(2, -1)
        root, before = np.arange(len(sids)), None
        while before is None or (root != before).any():
            before = root.copy()
            np.minimum.at(root, x, before[y])
            np.minimum.at(root, y, before[x])
            root = root[root]
        return pa.RecordBatch.from_arrays([pa.array(sids), pa.array(sids[root]), pa.array(np.bincount(at.reshape(-1), minlength=len(sids)))], names=["a", "b", "links"])

    def result(block: int, held: list) -> pa.RecordBatch:
        found = settle(held)
        if not links:
            return found
        return linked(found) if block >= 0 else pa.RecordBatch.from_arrays([*found.columns[:2], pa.nulls(found.num_rows, pa.int64())], names=["a", "b", "links"])

    def run(batches):
        at, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != at:
                    if held:
                        yield result(at, held)
                    at, held = row[0], []
                held.append(row)
        if held:
            yield result(at, held)

    return run


def _join(docs: DataFrame, n: int, threshold: float, id_col: str, text_col: str, links: bool, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The signatures of all texts (doc_id, h, sid, n), and of the distinct sets the pairs (a, b, jaccard) or links (a, b, links): see _verify()."""
    if not 0 < threshold <= 1 or n < 1:
        raise ValueError("threshold must lie in (0, 1] and n be positive")
    texts = pick(docs, doc_id=id_col, text=text_col).where("doc_id is not null")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(60_000, max(tasks, -(-size // BUCKET)))
    own = f"doc_id {dict(texts.dtypes)['doc_id']}, h long, sid long, n long"
    spread = lambda df, to: df.repartitionById(to, "bucket")
    if "Exchange" in texts._jdf.queryExecution().executedPlan().toString():  # a set is named by its place, which a task that runs again must find the same
        texts = materialise(texts, "texts")
    sent = texts.select("doc_id", "text", F.coalesce(F.xxhash64("text"), F.lit(0).cast("long")).alias("h")).mapInArrow(trimmed(_sign(n, buckets)), f"{own}, {FLUSHED}")
    counted = spread(sent, buckets).mapInArrow(trimmed(_count(buckets)), f"{own}, {FLUSHED}")
    searched = materialise(spread(counted, buckets).mapInArrow(trimmed(_survive(threshold)), f"{own}, rare long, grams binary"), "searched")
    sets = searched.where("rare is not null").select("sid", "n", "rare", "grams")
    later = min(60_000, max(min(tasks, LEAST), -(-(sets.agg(F.sum("rare")).first()[0] or 0) // RARE)))
    lists = spread(spread(sets.mapInArrow(trimmed(_rare(later)), MESSAGE), later).mapInArrow(trimmed(_lists(later)), MESSAGE), later)
    postings = lists.mapInArrow(trimmed(_postings), "list long, sid long, n long, sketch binary").repartition("list").sortWithinPartitions("list")
    part = min(limit or LIST, 30_000)
    found = materialise(postings.mapInArrow(trimmed(_meet(threshold, part, BLOCK)), "block long, sid long, at int, pairs binary"), "candidates")
    wanted = found.where("sid is not null").join(sets, "sid").select("block", "pairs", "at", "sid", "n", "grams")
    rows = wanted.unionByName(found.where("sid is null"), allowMissingColumns=True).repartition("block").sortWithinPartitions("block")
    near = rows.mapInArrow(trimmed(_verify(threshold, links)), "a long, b long, links long" if links else "a long, b long, jaccard double")
    return searched.where("rare is null").select("doc_id", "h", "sid", "n"), near


def ngram_jaccard_join(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", limit: int | None = None) -> DataFrame:
    """Pairs of documents whose sets of word n-grams have a Jaccard index of the threshold or more.

    Columns: doc_id_a, doc_id_b (a < b), jaccard. Documents with equal sets are a star: one
    row (jaccard 1) for each, with the least doc_id of them. Each pair of distinct sets that
    reach the threshold is one row, between the least doc_ids that have them; it holds for
    all documents of both sets, so copies by the thousand take a row each, not one for each
    two. Texts are lower-cased; a text of fewer than n words is one gram. `limit` is the
    number of sets of one list that meet at once (by default, or for 0, LIST).

    The search is exact, but for collisions of 48-bit hashes. A set takes part if other
    texts have as many of its grams as a partner must share. Its grams are put in order, rarest
    first; if o must be shared of s that others have, the rarest common gram is among the
    first s - o + 1 of both sets, so the two meet in its list. Overlaps are counted over
    whole sets.

    NULL, empty and blank texts have no grams and match nothing. Rows with NULL doc_id are
    left out; repeats of a row count once. Ids may be of any type with an order. Texts that
    share an id are sets of their own: their pairs with others are all given, those of an id
    with itself aren't. Very long texts take part whole. Equal indices need no order: every
    pair that reaches the threshold is given. Other columns of docs, whatever their names,
    aren't read. An empty table gives an empty result.
    """
    signed, near = _join(docs, n, threshold, id_col, text_col, False, limit)
    signed = signed.where("sid is not null")
    sets = signed.groupBy("sid").agg(F.min("doc_id").alias("rep"))
    stars = signed.select("sid", "doc_id").distinct().join(sets, "sid").where("doc_id <> rep").select(F.col("rep").alias("doc_id_a"), F.col("doc_id").alias("doc_id_b"), F.lit(1.0).alias("jaccard"))
    # a pair is met in two blocks at times
    near = near.dropDuplicates(["a", "b"]).join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").where("x <> y")
    return stars.unionByName(near.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"), "jaccard"))


def ngram_jaccard_join_sql(n: int = NGRAM, threshold: float = THRESHOLD) -> str:
    return rf"""
with ws as (select distinct doc_id, regexp_extract_all(lower(text), '[^ \t\n\r\f]+') as w from documents where doc_id is not null and text is not null),
gs as (select distinct doc_id, g from (select doc_id, unnest(case when len(w) >= {n} then list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' ')) else [array_to_string(w, ' ')] end) as g from ws where len(w) > 0)),
per as (select doc_id, md5(string_agg(g, chr(10) order by g)) as s, count(*) as n from gs group by doc_id),
sets as (select s, n, min(doc_id) as rep from per group by s, n),
sg as (select rep, n, g from gs join sets on doc_id = rep),
found as (select x.rep as a, y.rep as b, count(*) as o, any_value(x.n + y.n) as total from sg x join sg y on x.g = y.g and x.rep < y.rep group by all)
select rep as doc_id_a, doc_id as doc_id_b, cast(1 as double) as jaccard from per join sets using (s, n) where doc_id <> rep
union all select a, b, o / (total - o) from found where o >= {threshold} * (total - o)"""


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): the least node that it is connected with.

    Every round takes the least root among the neighbours' and then the root's root, so
    roots travel by leaps; it ends when a round changes nothing. Each round is written to
    the shared folder.
    """
    both = materialise(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct(), "edges")
    roots = materialise(both.groupBy("node").agg(F.least("node", F.min("other")).alias("root")), "roots")
    while True:
        heard = both.join(roots.toDF("other", "r"), "other").groupBy("node").agg(F.min("r").alias("r"))
        step = roots.join(heard, "node").select("node", F.col("root").alias("old"), F.least("root", "r").alias("mid"))
        leap = step.join(roots.toDF("mid", "far"), "mid").select("node", "old", F.least("mid", "far").alias("root"))
        leap = materialise(leap, "roots")
        if leap.where("root <> old").isEmpty():
            return leap.select("node", "root")
        roots = leap.select("node", "root")


def classes(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, class_id, n_links, by the join of ngram_jaccard_join().

    Documents whose sets of n-grams are equal, or are connected by pairs that reach the
    threshold, are of one class; class_id is its least doc_id. n_links counts the distinct
    other sets that reach the threshold with the document's own: copies of a text link to
    nothing by themselves, and have its links. So rows grow with the documents, however many
    pairs a crowd of similar texts has, and every pair is judged and counted.

    A document without grams (NULL, empty or blank text) is a class of its own. Rows with
    NULL doc_id are left out; repeats of a row give one. Texts that share an id are judged
    by themselves: there is a row for each of their distinct sets. Ids may be of any type
    with an order. Very long texts take part whole. Other columns of docs, whatever their
    names, aren't read. An empty table gives an empty result.
    """
    signed, near = _join(docs, n, threshold, id_col, text_col, True)
    near = materialise(near, "near")
    both = near.where("links is null").select("a", "b").distinct().select(F.explode(F.array("a", "b")).alias("sid"), F.lit(1).cast("long").alias("links"))
    links = near.where("links is not null").select(F.col("a").alias("sid"), "links").unionByName(both).groupBy("sid").agg(F.sum("links").alias("n_links"))
    roots = components(near.select("a", "b").where("a <> b")).toDF("sid", "root")
    sets = materialise(signed.select("doc_id", "sid").distinct().join(links.join(roots, "sid"), "sid", "left").select("doc_id", F.coalesce("root", "sid").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "sets")
    least = sets.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return sets.join(least, "root", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "n_links")


def classes_sql(n: int = NGRAM, threshold: float = THRESHOLD) -> str:
    """classes(documents) in DuckDB, for tables with one text per doc_id."""
    return rf"""
with recursive ws as (select distinct doc_id, regexp_extract_all(lower(text), '[^ \t\n\r\f]+') as w from documents where doc_id is not null and text is not null),
gs as (select distinct doc_id, g from (select doc_id, unnest(case when len(w) >= {n} then list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' ')) else [array_to_string(w, ' ')] end) as g from ws where len(w) > 0)),
per as (select doc_id, md5(string_agg(g, chr(10) order by g)) as s, count(*) as n from gs group by doc_id),
sets as (select s, n, min(doc_id) as rep from per group by s, n),
sg as (select rep, n, g from gs join sets on doc_id = rep),
found as (select x.rep as a, y.rep as b, count(*) as o, any_value(x.n + y.n) as total from sg x join sg y on x.g = y.g and x.rep < y.rep group by all),
near as (select a, b from found where o >= {threshold} * (total - o)),
both_ as (select a, b from near union all select b, a from near),
reach(a, b) as (select rep, rep from sets union select r.a, n.b from reach r join both_ n on r.b = n.a),
class as (select a as rep, min(b) as class_id from reach group by a),
links as (select a as rep, count(*) as c from both_ group by a)
select distinct d.doc_id, coalesce(class_id, d.doc_id) as class_id, cast(coalesce(c, 0) as bigint) as n_links
from documents d left join per using (doc_id) left join sets using (s, n) left join class using (rep) left join links using (rep) where d.doc_id is not null"""


def keep_one(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of similar texts, groups being what pairs connect.

    The row of the least id stays; of several texts of that id in the group, the one whose
    hash is least; of rows equal in both (repeats), the one whose other columns come first.
    Texts that share an id but aren't similar are told apart. Rows whose id is NULL, and
    those whose text has no grams (NULL, empty, blank), all stay. Very long texts take part
    whole. Columns are those of docs, whatever else they are called. An empty table gives an
    empty one.
    """
    signed, near = _join(docs, n, threshold, id_col, text_col, True)
    signed = signed.where("sid is not null")
    roots = components(materialise(near.select("a", "b").where("a <> b"), "near"))
    rooted = materialise(signed.select("sid", "doc_id", "h").distinct().join(roots.toDF("sid", "root"), "sid", "left").select("doc_id", "h", F.coalesce("root", "sid").alias("root")), "rooted")
    best = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "h")).alias("best"))
    fates = rooted.join(best, "root").select("doc_id", "h", (F.struct("doc_id", "h") == F.col("best")).alias("stays"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("h"))
    order = [F.col(f"row.`{c}`") for c, kind in docs.dtypes if c not in (id_col, text_col) and "map<" not in kind]
    nth = F.row_number().over(Window.partitionBy("doc_id", "h").orderBy(*order or ["h"]))
    told = rows.where("doc_id is not null").join(fates, ["doc_id", "h"], "left").withColumn("nth", nth)
    return told.where("stays is null or (stays and nth = 1)").select("row.*").unionByName(rows.where("doc_id is null").select("row.*"))
