"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as its own embedding and the scaled sum of embeddings of its byte 3-
and 5-grams, both from hashed tables. The network reads windows of WINDOW words, each of
which begins STRIDE words after the one before; the last one ends with the text. A
document scores as its worst window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import hash_key, pick
from quire.llm.text import Words, mix, powers, words

#: A span of up to WINDOW - STRIDE + 1 words lies whole in a window.
WINDOW, STRIDE = 48, 24
#: Hashed rows of the tables of words and byte n-grams, and their widths.
WORD_ROWS, GRAM_ROWS, WORD_DIM, GRAM_DIM = 8192, 16384, 6, 12
HIDDEN, ATTEND = 10, 6
#: The bounded sample that the model is fitted on: so many labelled documents of either class at most, of up to so many characters.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 800, 1600, 6_000
EPOCHS, BATCH, RATE, SEED = 10, 32, 0.01, 11
#: Windows and words that are scored at once.
CHUNK, TEXTS = 1024, 256
_F = np.float32


@dataclass
class Vocabulary:
    """Distinct words of a batch: row in the word table, and rows in the gram table with bounds."""

    word: np.ndarray
    gram: np.ndarray
    bounds: np.ndarray


def vocabulary(w: Words) -> tuple[Vocabulary, np.ndarray]:
    """The distinct words of w and, for each word of w, its place among them."""
    _, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
    start, end = w.start[first], w.end[first]
    size = end - start + 2  # a mark at either end
    at = np.zeros(len(first) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    flat = np.full(int(at[-1]) + 5, 1, np.uint64)
    inner = np.arange(int(at[-1])) - np.repeat(at[:-1], size)
    solid = (inner > 0) & (inner < np.repeat(size, size) - 1)
    flat[: len(solid)][solid] = w.data[(inner - 1 + np.repeat(start, size))[solid]].astype(np.uint64) + np.uint64(2)
    left = np.repeat(size, size) - inner
    salt = mix(powers(6))
    owner = np.repeat(np.arange(len(first)), size)
    rows, owners, total = [], [], flat[: len(solid)] * salt[0]
    for k in range(1, 5):
        total = total + flat[k : k + len(solid)] * salt[k]
        if k in (2, 4):
            fits = left > k
            rows.append((mix(total[fits] + salt[5] * np.uint64(k)) % np.uint64(GRAM_ROWS)).astype(np.int64))
            owners.append(owner[fits])
    owners_all = np.concatenate(owners)
    order = np.argsort(owners_all, kind="stable")
    bounds = np.zeros(len(first) + 1, np.int64)
    np.cumsum(np.bincount(owners_all, minlength=len(first)), out=bounds[1:])
    return Vocabulary((w.hash[first] % np.uint64(WORD_ROWS)).astype(np.int64), np.concatenate(rows)[order], bounds), inverse.reshape(-1)


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and text of every window of texts whose words lie between bounds."""
    n = np.diff(bounds)
    count = np.where(n > WINDOW, -(-(n - WINDOW) // STRIDE) + 1, (n > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(n)), count)
    before = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=before[1:])
    nth = np.arange(before[-1]) - before[owner]
    first = np.minimum(nth * STRIDE, np.maximum(n[owner] - WINDOW, 0))
    return first + bounds[:-1][owner], np.minimum(n[owner], WINDOW), owner


def new_model(seed: int = SEED) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    d, h = WORD_DIM + GRAM_DIM, HIDDEN
    g = lambda *s, k=1.0: (rng.standard_normal(s) * k).astype(_F)
    model = {"E": g(WORD_ROWS, WORD_DIM, k=0.1), "C": g(GRAM_ROWS, GRAM_DIM, k=0.3), "A": g(2 * h, ATTEND, k=0.3), "v": g(ATTEND, k=0.5), "w": g(2 * h, k=0.3), "b": np.full(1, -1.0, _F)}
    for s in "fb":
        model |= {f"W{s}": g(d, 3 * h, k=d**-0.5), f"U{s}": g(h, 3 * h, k=h**-0.5), f"c{s}": np.zeros(3 * h, _F)}
    return model


def inputs(model: dict, v: Vocabulary) -> np.ndarray:
    """The input vector of each distinct word."""
    if not len(v.word):
        return np.zeros((0, WORD_DIM + GRAM_DIM), _F)
    grams = np.add.reduceat(np.take(model["C"], v.gram, axis=0), v.bounds[:-1], axis=0) / np.sqrt(np.diff(v.bounds))[:, None].astype(_F)
    return np.concatenate([model["E"][v.word], grams], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return _F(0.5) * np.tanh(_F(0.5) * x) + _F(0.5)


def _run(model: dict, s: str, px: np.ndarray, mask: np.ndarray | None, out: np.ndarray, keep: list | None = None) -> None:
    """Hidden states of one direction into out (steps, HIDDEN, windows), from projected inputs (steps, 3 HIDDEN, windows).

    The gates are hard sigmoids. keep gets what backpropagation needs. Windows lie along the last axis throughout, so
    that numpy's inner loops are long.
    """
    h, u = HIDDEN, np.ascontiguousarray(model[f"U{s}"].T)
    state = np.zeros((h, px.shape[2]), _F)
    for t in range(len(px)) if s == "f" else range(len(px) - 1, -1, -1):
        hu = u @ state
        rz = px[t, : 2 * h] + hu[: 2 * h]
        rz *= _F(0.2)
        rz += _F(0.5)
        np.clip(rz, 0, 1, out=rz)
        r, z = rz[:h], rz[h:]
        cand = r * hu[2 * h :]
        cand += px[t, 2 * h :]
        np.tanh(cand, out=cand)
        new = out[t]
        np.subtract(state, cand, out=new)
        new *= z
        new += cand
        if mask is not None:
            new *= mask[t]
        if keep is not None:
            keep.append((t, state, r, z, cand, hu[2 * h :]))
        state = new


def _hidden(model: dict, pf: np.ndarray, pb: np.ndarray, mask: np.ndarray | None, keep: dict | None = None) -> np.ndarray:
    """States of both directions (steps, 2 HIDDEN, windows)."""
    hs = np.empty((len(pf), 2 * HIDDEN, pf.shape[2]), _F)
    _run(model, "f", pf, mask, hs[:, :HIDDEN], keep and keep["f"])
    _run(model, "b", pb, mask, hs[:, HIDDEN:], keep and keep["b"])
    return hs


def _pool(model: dict, hs: np.ndarray, mask: np.ndarray | None):
    """Attention over steps: logits, and the parts that backpropagation needs."""
    q = np.tanh(np.ascontiguousarray(model["A"].T) @ hs)
    e = model["v"] @ q
    if mask is not None:
        e = np.where(mask[:, 0] > 0, e, _F(-1e9))
    a = np.exp(e - e.max(0))
    a /= a.sum(0)
    pooled = (hs * a[:, None]).sum(0)
    return model["w"] @ pooled + model["b"][0], q, a, pooled


def _steps(first: np.ndarray, length: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """For windows: places of their words (steps, windows), and the mask if some are short."""
    steps = int(length.max())
    at = np.arange(steps)[:, None]
    inside = at < length[None, :]
    index = np.take(place, np.minimum(first[None, :] + at, len(place) - 1))
    return index, None if inside.all() else inside[:, None].astype(_F)


def logits(model: dict, x: np.ndarray, first: np.ndarray, length: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The logit of every window; short windows are scored apart from full ones."""
    out = np.empty(len(first), _F)
    pf, pb = x @ model["Wf"] + model["cf"], x @ model["Wb"] + model["cb"]
    order = np.argsort(length, kind="stable")
    for k in range(0, len(order), CHUNK):
        own = order[k : k + CHUNK]
        index, mask = _steps(first[own], length[own], place)
        turned = (np.ascontiguousarray(np.take(p, index, axis=0).transpose(0, 2, 1)) for p in (pf, pb))
        out[own] = _pool(model, _hidden(model, *turned, mask), mask)[0]
    return out


def gradients(model: dict, v: Vocabulary, x: np.ndarray, index: np.ndarray, mask: np.ndarray | None, y: np.ndarray) -> dict:
    """Gradients of the mean logistic loss over windows; those of E and C as (rows, values)."""
    h, keep = HIDDEN, {"f": [], "b": []}
    xs = np.ascontiguousarray(np.take(x, index, axis=0).transpose(0, 2, 1))
    hs = _hidden(model, *(model[f"W{s}"].T @ xs + model[f"c{s}"][:, None] for s in "fb"), mask, keep)
    z, q, a, pooled = _pool(model, hs, mask)
    dz = (_sigmoid(z) - y) / _F(len(y))
    g = {"w": pooled @ dz, "b": np.array([dz.sum()], _F)}
    dpool = model["w"][:, None] * dz
    da = np.einsum("thn,hn->tn", hs, dpool)
    de = a * (da - (a * da).sum(0))
    dq = de[:, None] * model["v"][:, None] * (1 - q * q)
    g["v"] = np.einsum("tn,tkn->k", de, q)
    g["A"] = np.einsum("thn,tkn->hk", hs, dq, optimize=True)
    dhs = a[:, None] * dpool + model["A"] @ dq
    dx = np.zeros_like(xs)
    for s, part in (("f", dhs[:, :h]), ("b", dhs[:, h:])):
        u, carry = model[f"U{s}"], np.zeros((h, len(y)), _F)
        du, dp = np.zeros_like(u), np.zeros((len(xs), 3 * h, len(y)), _F)
        for t, state, r, zt, cand, hun in reversed(keep[s]):
            d = part[t] + carry
            if mask is not None:
                d = d * mask[t]
            dc = d * (1 - zt) * (1 - cand * cand)
            dzt = d * (state - cand) * _F(0.2) * ((zt > 0) & (zt < 1))
            dr = dc * hun * _F(0.2) * ((r > 0) & (r < 1))
            dp[t] = np.concatenate([dr, dzt, dc])
            dhu = np.concatenate([dr, dzt, dc * r])
            du += state @ dhu.T
            carry = d * zt + u @ dhu
        g[f"U{s}"], g[f"c{s}"] = du, dp.sum((0, 2))
        g[f"W{s}"] = np.einsum("tdn,tkn->dk", xs, dp, optimize=True)
        dx += model[f"W{s}"] @ dp
    dx = dx.transpose(0, 2, 1)
    used, inverse = np.unique(index, return_inverse=True)
    du = np.zeros((len(used), dx.shape[2]), _F)
    np.add.at(du, inverse.reshape(-1), dx.reshape(-1, dx.shape[2]))
    n = np.diff(v.bounds)[used]
    owner = np.repeat(np.arange(len(used)), n)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    rows, back = np.unique(v.gram[inside + np.repeat(v.bounds[:-1][used], n)], return_inverse=True)
    dc = np.zeros((len(rows), GRAM_DIM), _F)
    np.add.at(dc, back.reshape(-1), (du[:, WORD_DIM:] / np.sqrt(n)[:, None].astype(_F))[owner])
    wrows, wback = np.unique(v.word[used], return_inverse=True)
    dw = np.zeros((len(wrows), WORD_DIM), _F)
    np.add.at(dw, wback.reshape(-1), du[:, :WORD_DIM])
    return g | {"C": (rows, dc), "E": (wrows, dw)}


class Adam:
    def __init__(self, model: dict, rate: float) -> None:
        self.model, self.rate, self.t = model, rate, 0
        self.m = {k: np.zeros_like(x) for k, x in model.items()}
        self.v = {k: np.zeros_like(x) for k, x in model.items()}

    def step(self, g: dict) -> None:
        """One update; rows of the tables that a batch doesn't touch stay as they are."""
        self.t += 1
        lr = _F(self.rate * (1 - 0.999**self.t) ** 0.5 / (1 - 0.9**self.t))
        for k, d in g.items():
            at = d[0] if isinstance(d, tuple) else slice(None)
            d = np.clip(d[1] if isinstance(d, tuple) else d, -1, 1)
            self.m[k][at] = _F(0.9) * self.m[k][at] + _F(0.1) * d
            self.v[k][at] = _F(0.999) * self.v[k][at] + _F(0.001) * d * d
            self.model[k][at] -= lr * self.m[k][at] / (np.sqrt(self.v[k][at]) + _F(1e-7))


def train(texts: list[str], toxic: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> dict:
    """A model with its threshold under `threshold`, fitted to labelled texts.

    An epoch trains on one window of each toxic text and two of each clean one. In the
    first two epochs they are drawn at random; later those that score highest, since
    only some windows of a toxic text are toxic, and one drawn at random of each clean
    text. The threshold is the midpoint of the widest run of scores that has the best F1
    over the texts. Without either class nothing is toxic: the threshold is infinite.
    """
    model, rng = new_model(seed), np.random.default_rng(seed)
    y = np.asarray(toxic).astype(bool)
    if not y.any() or y.all():
        return model | {"threshold": np.float64(np.inf)}
    w = words(pa.array(texts, pa.large_string()))
    v, place = vocabulary(w)
    first, length, owner = windows(w.bounds)
    has = np.unique(owner)
    opt = Adam(model, RATE)
    begin = np.searchsorted(owner, np.arange(len(texts)))
    count = np.bincount(owner, minlength=len(texts))
    for epoch in range(epochs + 1):
        worst = None
        if epoch > 1:
            z = logits(model, inputs(model, v), first, length, place)
            rank = np.lexsort((-z, owner))
            worst = rank[begin[has]]
        if epoch == epochs:
            break
        opt.rate = RATE * (1.0 if epoch < epochs * 2 // 3 else 0.3)
        drawn = begin[has] + (rng.random(len(has)) * count[has]).astype(np.int64)
        chosen = drawn if worst is None else np.concatenate([worst, drawn[~y[has]]])
        repeat = max(1, round(0.5 * (~y[owner[chosen]]).sum() / max(1, y[owner[chosen]].sum())))
        chosen = np.concatenate([chosen, *[chosen[y[owner[chosen]]]] * (repeat - 1)])
        chosen = chosen[rng.permutation(len(chosen))]
        for k in range(0, len(chosen), BATCH):
            own = chosen[k : k + BATCH]
            index, mask = _steps(first[own], length[own], place)
            used, back = np.unique(index, return_inverse=True)
            n = np.diff(v.bounds)[used]
            at = np.zeros(len(used) + 1, np.int64)
            np.cumsum(n, out=at[1:])
            grams = v.gram[np.arange(at[-1]) - np.repeat(at[:-1] - v.bounds[:-1][used], n)]
            small = Vocabulary(v.word[used], grams, at)
            opt.step(gradients(model, small, inputs(model, small), back.reshape(index.shape), mask, y[owner[own]].astype(_F)))
    score, truth = z[worst].astype(np.float64), y[has]
    order = np.argsort(-score)
    hits = np.cumsum(truth[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + truth.sum())
    gaps = np.append(score[order][:-1] - score[order][1:], 0.0)
    best = max(np.flatnonzero(f1 >= f1.max() - 1e-12), key=lambda k: gaps[k])
    below = score[order][best + 1] if best + 1 < len(order) else score[order][best] - 2.0
    return model | {"threshold": np.float64((score[order][best] + below) / 2)}


def score_texts(model: dict, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Highest logit (minus infinity without words), first word of that window, and count of windows of each text."""
    w = words(texts)
    n = len(w)
    best, at = np.full(n, -np.inf), np.zeros(n, np.int64)
    first, length, owner = windows(w.bounds)
    if len(owner):
        v, place = vocabulary(w)
        z = logits(model, inputs(model, v), first, length, place)
        order = np.lexsort((first, -z, owner))
        head = order[np.flatnonzero(np.r_[True, owner[order][1:] != owner[order][:-1]])]
        best[owner[head]] = z[head]
        at[owner[head]] = first[head] - w.bounds[:-1][owner[head]]
    return best, at, np.bincount(owner, minlength=n)


_RESULT = "n_windows bigint, worst_start bigint, score double, toxic boolean"


def scorer(model: dict):
    """A column function text -> struct<n_windows, worst_start, score, toxic>."""

    @F.arrow_udf(f"struct<{_RESULT.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>")
    def toxicity(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [score_texts(model, batch.slice(k, TEXTS)) for k in range(0, len(batch), TEXTS)]
            best, at, n = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0),) * 3
            prob = 1 / (1 + np.exp(-np.clip(best, -50, 50)))
            prob[~np.isfinite(best)] = 0.0
            yield pa.StructArray.from_arrays([pa.array(n.astype(np.int64)), pa.array(at.astype(np.int64)), pa.array(np.round(prob, 6)), pa.array(best >= model["threshold"])], ["n_windows", "worst_start", "score", "toxic"])

    return toxicity


def sample(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN, chars: int = SAMPLE_CHARS, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """The texts and labels that the model is fitted on: of either class those whose doc_id hashes lowest."""
    marks = labels.select(F.col("doc_id").alias("i"), (F.col("toxic") == 1).alias("y")).where("i is not null and y is not null").groupBy("i").agg(F.max("y").alias("y"))
    marks = marks.withColumn("k", hash_key(F.lit("toxicity"), "i"))
    texts = pick(docs, i=id_col, text=text_col).where(F.length("text").between(1, chars))
    known = texts.join(marks, "i").select("i", "k", "y")
    ids = known.where("y").orderBy("k", "i").limit(toxic).unionByName(known.where("not y").orderBy("k", "i").limit(clean))
    rows = texts.join(F.broadcast(ids), "i").orderBy("k", "i", "text").select("text", "y").toPandas()
    return rows["text"].tolist(), rows["y"].to_numpy(bool)


def fit(docs: DataFrame, labels: DataFrame, **options) -> dict:
    """A model for score(), from the bounded sample of labelled documents."""
    return train(*sample(docs, labels, **options))


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document: doc_id, n_windows, worst_start (a word's place), score (0 to 1), toxic.

    All windows of the whole text are scored. NULL, empty and blank texts have no window,
    score 0 and aren't toxic. Every input row gives one row, also if rows repeat. Nothing
    is shuffled.
    """
    return pick(docs, doc_id=id_col, text=text_col).select("doc_id", scorer(model)("text").alias("t")).select("doc_id", "t.*")


def is_toxic(model: dict, text: Column) -> Column:
    return scorer(model)(text)["toxic"]
