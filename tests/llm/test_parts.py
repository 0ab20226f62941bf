"""Parts against brute force: suffix sort, schedules, WARC round trip, gradients, fingerprints, components."""

import hashlib
import heapq
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import fingerprints, ngram_join, sharding, suffix_dedup, toxicity, warc
from quire.llm.text import words
from tests.conftest import SMALL


@pytest.mark.parametrize("seed", range(4))
def test_suffix_sort(seed):
    rng = random.Random(seed)
    w = words(pa.array([" ".join(rng.choice("ab") for _ in range(rng.randrange(8, 60))) for _ in range(6)]))
    start = np.concatenate([np.arange(a, b - 7) for a, b in zip(w.bounds[:-1], w.bounds[1:])])
    segment = np.sort(np.array([rng.randrange(3) for _ in start]))
    h = suffix_dedup.PrefixHashes(w.hash)
    order = suffix_dedup.merge_sort(h, start, segment, 8)
    key = [(segment[k], tuple(w.hash[start[k] : start[k] + 8])) for k in range(len(start))]
    assert [key[k] for k in order] == sorted(key)
    got = suffix_dedup.classes(w, start, segment, 8)
    assert len({(k, c) for k, c in zip(key, got)}) == len(set(key)) == len(set(got))


def test_collisions_are_found(monkeypatch):
    """With hashes that all collide the bytes alone tell suffixes apart."""
    w = words(pa.array(["a b c d", "a b x d", "a b c d"]))
    w.hash[:] = 7
    got = suffix_dedup.classes(w, w.bounds[:-1], np.zeros(3, np.int64), 4)
    assert got[0] == got[2] != got[1]


def test_passages_match_brute_force(spark):
    rng = random.Random(5)
    common = [f"c{rng.randrange(99)}" for _ in range(70)]
    docs = []
    for i in range(30):
        w = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(5, 90))]
        if rng.random() < 0.6:
            a = rng.randrange(0, 30)
            w[len(w) // 2 : len(w) // 2] = common[a : a + rng.randrange(8, 60)]
        docs.append((i, " ".join(w)))
    docs.append((30, "x " * 40))
    m = 12
    seen, want = {}, set()
    for i, t in docs:
        w = t.split()
        for k in range(len(w) - m + 1):
            if seen.setdefault(tuple(w[k : k + m]), (i, k)) != (i, k):
                want |= {(i, x) for x in range(k, k + m)}
    rows = suffix_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string"), m).collect()
    assert {(r.doc_id, x) for r in rows for s in r.removed for x in range(s.first, s.last)} == want


@pytest.mark.parametrize("seed", range(5))
def test_schedule(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 2, 5, 7, 100]) for _ in range(rng.randrange(1, 300))]
    shards = rng.randrange(1, 9)
    heap = [(0, k) for k in range(shards)]
    for z in sorted(sizes, reverse=True):
        load, k = heapq.heappop(heap)
        heapq.heappush(heap, (load + z, k))
    values, counts = np.unique(sizes, return_counts=True)
    plan, loads = sharding.schedule(values, counts, shards)
    assert sorted(loads) == sorted(x for x, _ in heap)
    assert (plan.to_rank - plan.from_rank).sum() == len(sizes)


@pytest.mark.parametrize("shards", [3, 64])
def test_shard_matches_a_heap(spark, shards):
    """The query end to end: groups of equal texts by falling size, each to the least loaded shard."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sizes = {}
    for r in docs.collect():
        sizes[r.text] = sizes.get(r.text, 0) + len(r.text or "")
    heap = [(0, k) for k in range(shards)]
    for z in sorted(sizes.values(), reverse=True):
        load, k = heapq.heappop(heap)
        heapq.heappush(heap, (load + z, k))
    text = {r.doc_id: r.text for r in docs.collect()}
    loads, homes = [0] * shards, {}
    for r in sharding.shard(docs, shards).collect():
        loads[r.shard] += len(text[r.doc_id] or "")
        homes.setdefault(text[r.doc_id], set()).add(r.shard)
    assert sorted(loads) == sorted(x for x, _ in heap) and all(len(x) == 1 for x in homes.values())


def test_warc_round_trip(spark, tmp_path):
    rows = [("a", "response", "http://x", "2024-01-02T00:00:00Z", None, None, "body é"), ("b", "revisit", "http://x", "2024-01-03T00:00:00Z", None, "a", None), ("c", "response", "http://y", "2024-01-01T00:00:00Z", None, None, "body é"), ("d", "revisit", "http://z", None, "sha256:gone", "q", None), ("e", "warcinfo", None, None, None, None, "software: x")]
    out = warc.resolve(spark.createDataFrame(rows, warc.SCHEMA.replace("binary", "string")))
    assert sum(r.records for r in warc.write_archive(out, str(tmp_path / "w"), 2).collect()) == 5
    back = {r.record_id: r for r in warc.read_archive(spark, str(tmp_path / "w")).collect()}
    assert back["c"].payload == "body é".encode() and back["c"].type == "response"
    assert [(back[k].type, back[k].refers_to) for k in "abd"] == [("revisit", "c"), ("revisit", "c"), ("revisit", "q")]
    assert back["e"].payload == b"software: x"


def test_binary_payloads_keep_their_bytes(spark, tmp_path):
    rows = [("a", "response", "http://x", "2024-01-02T00:00:00Z", None, None, b"\xff\x00\xfe\r\n\r\n"), ("b", "response", "http://y", "2024-01-03T00:00:00Z", None, None, b"\xff\x00\xfe\r\n\r\n")]
    warc.write_archive(warc.resolve(spark.createDataFrame(rows, warc.SCHEMA), "image/png"), str(tmp_path / "w"), 1).collect()
    back = warc.read_archive(spark, str(tmp_path / "w"))
    got = {r.record_id: r for r in back.collect()}
    assert got["a"].payload == rows[0][6] and got["b"].refers_to == "a" and got["a"].digest == got["b"].digest
    assert got["a"].digest == "sha256:" + hashlib.sha256(rows[0][6]).hexdigest()
    assert sorted((r.record_id, r.type) for r in warc.resolve(back).collect()) == [("a", "response"), ("b", "revisit")]


def test_original_has_a_payload(spark):
    rows = [("a", "response", "http://x", "2024-01-01T00:00:00Z", "sha256:d", None, None), ("b", "response", "http://x", "2024-01-02T00:00:00Z", "sha256:d", None, "body"), ("b", "response", "http://x", "2024-01-02T00:00:00Z", "sha256:d", None, None)]
    out = {r.record_id: r for r in warc.resolve(spark.createDataFrame(rows, warc.SCHEMA.replace("binary", "string"))).collect()}
    assert (out["b"].type, out["b"].payload) == ("response", "body")
    assert (out["a"].type, out["a"].refers_to) == ("revisit", "b")


def test_broken_archive():
    with pytest.raises(ValueError):
        warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort")


def test_gradients(monkeypatch):
    monkeypatch.setattr(toxicity, "_F", np.float64)
    w = words(pa.array(["a bad thing here now", "x y z bad word again and again"]))
    v, place = toxicity.vocabulary(w)
    first, length, _ = toxicity.windows(w.bounds)
    index, mask = toxicity._steps(first, length, place)
    model = {k: x.astype(np.float64) for k, x in toxicity.new_model().items()}
    y = np.array([1.0, 0.0])

    def loss():
        z = toxicity.logits(model, toxicity.inputs(model, v), first, length, place).astype(np.float64)
        return np.mean(np.logaddexp(0, z) - y * z)

    found = toxicity.gradients(model, v, toxicity.inputs(model, v), index, mask, y)
    for k, g in found.items():
        if isinstance(g, tuple):
            full = np.zeros_like(model[k])
            full[g[0]] = g[1]
            g = full
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, e = model[k][at], 1e-2
        model[k][at] = old + e
        up = loss()
        model[k][at] = old - e
        slope = (up - loss()) / 2 / e
        model[k][at] = old
        assert slope == pytest.approx(g[at], rel=0.02, abs=1e-4)


def test_toxicity_is_learnt():
    rng = random.Random(1)
    plain = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(10, 150))) for _ in range(500)]
    y = np.array([rng.random() < 0.35 for _ in plain])
    texts = []
    for t, bad in zip(plain, y):
        w = t.split()
        for _ in range(3 if bad else 0):
            w.insert(rng.randrange(len(w)), "foul" + rng.choice(["ish", "ling", "er"]))
        texts.append(" ".join(w))
    model = toxicity.train(texts[:400], y[:400])
    best, _, _ = toxicity.score_texts(model, texts[400:])
    assert ((best >= model["threshold"]) == y[400:]).mean() > 0.95


def plain_logit(m, inputs):
    """The network on one window, number by number."""
    h, ways = toxicity.HIDDEN, []
    for s, order in (("f", range(len(inputs))), ("b", range(len(inputs) - 1, -1, -1))):
        state, out = [0.0] * h, {}
        for t in order:
            px = [sum(inputs[t][i] * m[f"W{s}"][i][j] for i in range(len(inputs[t]))) + m[f"c{s}"][j] for j in range(3 * h)]
            hu = [sum(state[i] * m[f"U{s}"][i][j] for i in range(h)) for j in range(3 * h)]
            gate = [min(1.0, max(0.0, 0.2 * (px[j] + hu[j]) + 0.5)) for j in range(2 * h)]
            cand = [math.tanh(px[2 * h + j] + gate[j] * hu[2 * h + j]) for j in range(h)]
            state = [gate[h + j] * state[j] + (1 - gate[h + j]) * cand[j] for j in range(h)]
            out[t] = state
        ways.append(out)
    both = [ways[0][t] + ways[1][t] for t in range(len(inputs))]
    e = [sum(m["v"][k] * math.tanh(sum(m["A"][i][k] * x[i] for i in range(2 * h))) for k in range(toxicity.ATTEND)) for x in both]
    weight = [math.exp(x - max(e)) for x in e]
    return sum(m["w"][i] * sum(a * x[i] for a, x in zip(weight, both)) / sum(weight) for i in range(2 * h)) + m["b"][0]


def test_forward_pass_matches_plain_loops():
    """Every window of odd texts, word by word, without any batch."""
    m = {k: np.asarray(x, np.float64) for k, x in toxicity.new_model(3).items()}
    w = words(pa.array(["one bad word", "", "x " * 60 + "y", "a b"]))
    v, place = toxicity.vocabulary(w)
    first, length, _ = toxicity.windows(w.bounds)
    got = toxicity.logits(toxicity.new_model(3), toxicity.inputs(toxicity.new_model(3), v), first, length, place)
    for z, a, n in zip(got, first, length):
        inputs = []
        for k in place[a : a + n]:
            grams = v.gram[v.bounds[k] : v.bounds[k + 1]]
            inputs.append(np.concatenate([m["E"][v.word[k]], sum(m["C"][g] for g in grams) / len(grams) ** 0.5]))
        assert abs(float(z) - plain_logit(m, inputs)) < 1e-4


def test_spans_of_half_a_window_lie_in_one():
    first, length, owner = toxicity.windows(np.array([0, 500, 530, 700]))
    for text, (a, b) in enumerate([(0, 500), (500, 530), (530, 700)]):
        own = owner == text
        for size in range(1, toxicity.WINDOW // 2 + 2):
            for k in range(a, b - size + 1):
                assert ((first[own] <= k) & (first[own] + length[own] >= k + size)).any()


def test_toxicity_without_labels():
    assert toxicity.train(["a", "b"], np.array([False, False]))["threshold"] == np.inf


def test_fingerprints_are_homomorphic(spark):
    rows = [(0, "a\nb\nb"), (1, "b\na\nb"), (2, "a\nb"), (3, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "split(text, '\n') as p")
    from pyspark.sql import functions as F

    zero = F.array_repeat(F.lit(0).cast("long"), fingerprints.LANES)
    df = df.select("doc_id", F.aggregate(F.transform("p", fingerprints.paragraph_vector), zero, fingerprints.add).alias("v"))
    v = {r.doc_id: r.v for r in df.collect()}
    assert v[0] == v[1] != v[2]
    both = spark.createDataFrame([(v[2], v[3], v[0])], "a array<long>, b array<long>, c array<long>")
    r = both.select(fingerprints.add(F.col("a"), F.col("b")).alias("s"), fingerprints.subtract(F.col("c"), F.col("b")).alias("d")).first()
    assert r.s == v[0] and r.d == v[2]


def test_components(spark):
    rng = random.Random(2)
    edges = [(a, a + 1) for a in range(0, 40)] + [(rng.randrange(50, 90), rng.randrange(50, 90)) for _ in range(25)]
    roots = {x: x for e in edges for x in e}

    def root(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for a, b in edges:
        lo, hi = sorted((root(a), root(b)))
        roots[hi] = lo
    got = {r.node: r.root for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in roots}


def test_pipeline_stages(spark):
    """Each stage on its own input: what it drops is what its operator says, the rest stays as it is."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialise(stage(spark, docs, SMALL), "t")
        before, after = docs.collect(), out.collect()
        if name != "packing":
            assert out.columns == corpus_pipeline.COLUMNS
        if name == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
            bad = {r.doc_id for r in before if toxicity.score_texts(model, pa.array([r.text], pa.large_string()))[0][0] >= model["threshold"]}
            assert {r.doc_id for r in after} == {r.doc_id for r in before} - bad
        if name == "mixing sources to target weights":
            size = lambda rows: {s: sum(len(r.text.split()) for r in rows if r.source == s) for s in {r.source for r in rows}}
            has, weight = size(before), lambda s: {"src0": 6}.get(s, 1)
            assert size(after) == {s: sum(has.values()) * weight(s) // sum(map(weight, has)) for s in has}
            texts = {r.doc_id: r.text.split() for r in before}
            times, short = {}, {}
            for r in after:
                w = r.text.split()
                assert w == texts[r.doc_id][: len(w)]
                if len(w) < len(texts[r.doc_id]):
                    short[r.source] = short.get(r.source, 0) + 1
                else:
                    times.setdefault(r.source, {}).setdefault(r.doc_id, []).append(1)
            assert all(n == 1 for n in short.values())
            assert all(max(map(len, x.values())) - min(map(len, x.values())) <= 1 for x in times.values())
        if name == "n-gram Jaccard join":
            sets = {r.doc_id: {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} for r in before if (w := r.text.lower().split())}
            near = lambda a, b: len(sets[a] & sets[b]) * 2 >= len(sets[a] | sets[b])
            kept = {r.doc_id for r in after}
            assert not any(near(a, b) for a in kept for b in kept if a < b)
            assert all(any(near(a, b) for b in sets if b < a) for a in set(sets) - kept)
        if name == "suffix-array dedup":
            seen = set()
            for r in sorted(after, key=lambda r: r.doc_id):
                for line in {r.text}:
                    w = line.split("\n")
                    grams = [tuple(x[k : k + 50]) for x in (p.split() for p in w) for k in range(len(x) - 49)]
                    assert not any(g in seen for g in grams)
                    seen.update(grams)
        if name == "packing":
            count = lambda rows: sum(len(r.text.split()) for r in rows)
            assert count(after) == count(before) == sum(r.length for r in after)
        docs = out


def test_join_finds_pairs_that_share_only_common_grams(spark):
    """Overlapping passages, each in many documents, among grams of their own."""
    rng = random.Random(8)
    passages = [" ".join(f"p{rng.randrange(10**6)}" for _ in range(20)) for _ in range(40)]
    docs = []
    for place in range(33):
        for _ in range(10):
            docs.append((len(docs), " ".join([*passages[place : place + 8], *(f"u{rng.randrange(10**9)}" for _ in range(35))])))
    rng.shuffle(docs)
    docs = [(i, text) for i, (_, text) in enumerate(docs)]
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, w in ((i, t.split()) for i, t in docs)}
    want = {(a, b) for a in sets for b in sets if a < b and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for limit in (0, 160, 10**9, None):
        got = [(r.doc_id_a, r.doc_id_b) for r in ngram_join.ngram_jaccard_join(df, limit=limit).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_short_sets_in_long_lists_and_long_sets_in_short_ones(spark):
    """Short texts of few words are in long lists, long ones in short lists."""
    rng = random.Random(4)
    docs = [" ".join(f"s{rng.randrange(3)}" for _ in range(6)) for _ in range(300)]
    for _ in range(20):
        w = [f"l{rng.randrange(10**6)}" for _ in range(300)]
        docs += [" ".join(w), " ".join(w[:-20])]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, t in enumerate(docs) for w in [t.split()]}
    first = {}
    for i, x in sets.items():
        first.setdefault(frozenset(x), i)
    want = {(a, b) for a in first.values() for b in first.values() if a < b and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    want |= {(first[frozenset(x)], i) for i, x in sets.items() if first[frozenset(x)] != i}
    assert {(r.doc_id_a, r.doc_id_b) for r in ngram_join.ngram_jaccard_join(df).collect()} == want


def test_join_misses_no_pair_just_at_the_threshold(spark):
    """Texts that share 40 of 80 grams, of which none is among the 13 of least hash of the longer one."""
    docs = []
    for seed in (991, 74323, 81993, 92827, 122217, 156374):
        r = random.Random(seed)
        w = [f"w{r.randrange(10**9)}" for _ in range(82)]
        docs += [(len(docs), " ".join(w[:42])), (len(docs) + 1, " ".join(w))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = [(r.doc_id_a, r.doc_id_b, r.jaccard) for r in ngram_join.ngram_jaccard_join(df).collect()]
    assert sorted(got) == [(i, i + 1, 0.5) for i in range(0, 12, 2)]


def test_classes_count_the_links_of_crowds(spark, monkeypatch):
    """Crowds of edited texts with copies, by lists that meet whole and by parts; links as brute force has them."""
    rng = random.Random(6)
    docs = []
    for c in range(4):
        base = [f"t{c}x{rng.randrange(3000)}" for _ in range(90)]
        for _ in range(60):
            w = list(base)
            for _ in range(rng.randrange(1, 16)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(40)}"
            docs += [" ".join(w)] * rng.choice([1, 1, 2])
    docs += ["", "one two three four", "five"]
    sets = [frozenset(tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))) if w else None for w in map(str.split, docs)]
    links = {x: {y for y in sets if x and y and x != y and 2 * len(x & y) >= len(x | y)} for x in sets}
    want = []
    for i, x in enumerate(sets):
        seen, todo = {x}, [x] if x else []
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        want.append((i, min(k for k, y in enumerate(sets) if y in seen) if x else i, len(links[x])))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    for block, size in ((64, 2000), (5, 7), (10**6, 2000)):
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        monkeypatch.setattr(ngram_join, "LIST", size)
        assert sorted(tuple(r) for r in ngram_join.classes(df).collect()) == want


def test_packed_keys_come_back_as_they_were():
    rng = np.random.default_rng(3)
    cases = [[5], [0, 2**48 - 1], [7, 7, 7], np.sort(rng.integers(0, 2**48, 5000)), np.sort(rng.integers(2**40, 2**40 + 900, 2000))]
    for keys in cases:
        keys = np.array(keys, np.uint64)
        for most in (1, 2**9, 2**20):
            owner, kinds = rng.integers(0, most, len(keys)), rng.integers(0, 256, len(keys))
            for got, want in zip(ngram_join._open(ngram_join._close(keys, owner, kinds)), (keys, owner, kinds)):
                assert got.tolist() == want.tolist()
            assert not len(ngram_join._open(ngram_join._close(keys, owner))[2])
    assert len(ngram_join._close(cases[3].astype(np.uint64), rng.integers(0, 4096, 5000))) < 5000 * 6.5


def test_what_a_join_shuffles_does_not_grow_with_the_buckets(spark, monkeypatch):
    """As on a larger table, where each set has a gram or two in a bucket."""
    rng = random.Random(12)
    docs = []
    for _ in range(300):
        w = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        docs += [" ".join(w), " ".join(w[:-20])]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").coalesce(1)
    sc = spark._jsparkSession.sparkContext()

    def shuffled() -> int:
        sc.listenerBus().waitUntilEmpty(30_000)
        found = sc.statusStore().executorList(False)
        return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))

    moved = []
    for bucket in (10**9, len("".join(docs)) // 100):
        monkeypatch.setattr(ngram_join, "BUCKET", bucket)
        before = shuffled()
        got = ngram_join.ngram_jaccard_join(df).collect()
        moved.append(shuffled() - before)
        assert sorted((r.doc_id_a, r.doc_id_b) for r in got) == [(i, i + 1) for i in range(0, 600, 2)]
    assert moved[1] < 1.6 * moved[0], moved


def test_suffixes_of_one_hash_are_sorted_as_one(monkeypatch):
    """A passage in 500 texts, each with a word of its own at the end: the sort sees one suffix, not 1,000."""
    w = words([" ".join([*(f"c{k}" for k in range(50)), f"u{i}"]) for i in range(500)], lower=False)
    start = np.concatenate([w.bounds[:-1], w.bounds[:-1] + 1])
    seen, sort = [], suffix_dedup.merge_sort
    monkeypatch.setattr(suffix_dedup, "merge_sort", lambda h, s, *rest: seen.append(len(s)) or sort(h, s, *rest))
    got = suffix_dedup.classes(w, start, np.repeat([0, 1], 500), 50)
    assert seen == [1] and len(set(got[:500])) == 1 and len(set(got)) == 501


def test_workers_give_memory_back_after_the_last_batch(monkeypatch):
    from quire.llm import common

    trims = []
    monkeypatch.setattr(common.ctypes, "CDLL", lambda _: type("C", (), {"malloc_trim": staticmethod(trims.append)}))
    out = common.trimmed(lambda batches: (b + 1 for b in batches))(iter([1, 2]))
    assert next(out) == 2 and not trims and list(out) == [3] and trims == [0]
