"""NULLs in any column, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

from quire.llm import chat, fingerprints, mixing, ngram_join, packing, quality, sharding, suffix_dedup, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i % 89}" for i in range(30_000))
ROWS = [
    (1, "alpha beta gamma delta. epsilon", "en", "a", 31), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \t\n \r", "en", "b", 5),
    (None, "a text without an id, long enough", "en", "b", 33), (5, LONG, "en", "b", len(LONG)), (6, LONG + " tail", "en", None, len(LONG) + 5),
    (7, "alpha beta gamma delta. epsilon", None, "a", 31), (7, "alpha beta gamma delta. epsilon", None, "a", 31), (8, "one", "en", "c", 3), (9, "é　ü ß \U0001f600 end", "de", "c", 12),
]


@pytest.fixture
def odd(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for clash in ("rep", "token", "key", "hash", "n", "k", "start", "length", "slot", "shard", "group_key", "take_tokens", "fingerprint", "score", "toxic", "label", "d1", "words", "plan", "rejected", "_id", "_take"):
        df = df.withColumn(clash, F.lit("x"))
    return df


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


MODEL = toxicity.new_model() | {"threshold": 0.0}
OPERATORS = {
    "ngram_join": ngram_join.ngram_jaccard_join, "mixing": mixing.mix, "quality": quality.clean_lines, "sharding": lambda d: sharding.shard(d, 3), "packing": packing.pack,
    "suffix": lambda d: suffix_dedup.repeated_passages(d), "fingerprints": fingerprints.fingerprints, "toxicity": lambda d: toxicity.score(d, MODEL), "mixed_documents": mixing.mixed_documents,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, name):
    assert OPERATORS[name](empty).count() == 0


@pytest.mark.parametrize("name", ["quality", "sharding", "fingerprints", "toxicity"])
def test_one_row_each(odd, name):
    out = OPERATORS[name](odd)
    assert sorted(r.doc_id or -1 for r in out.collect()) == sorted(r[0] or -1 for r in ROWS)


def test_ngram_join(odd):
    got = sorted((r.doc_id_a, r.doc_id_b, round(r.jaccard, 2)) for r in ngram_join.ngram_jaccard_join(odd).collect())
    assert got == [(1, 7, 1.0), (5, 6, 1.0)]


def test_ngram_join_takes_any_ids(spark):
    """String ids; texts that share an id are sets of their own, and an id isn't paired with itself."""
    rows = [("b", "one two three four"), ("a", "one two three four"), ("c", "one two three four five"), ("c", "one two three four"), ("d", "x y z"), ("d", "x y z w"), ("e", " ")]
    got = sorted((r.doc_id_a, r.doc_id_b, round(r.jaccard, 2)) for r in ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id string, text string")).collect())
    assert got == [("a", "b", 1.0), ("a", "c", 0.67), ("a", "c", 1.0)]


def test_keep_one_tells_texts_of_one_id_apart(spark):
    rows = [(1, "p q r s t", "en"), (1, "p q r s t", "de"), (2, "p q r s t u", "en"), (2, "other words here now", "en"), (2, "other words here now", "en"), (3, None, "en"), (3, None, "en"), (None, "p q r s t", "en"), (None, "p q r s t", "en")]
    out = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sorted((r.doc_id or 0, r.text or "", r.lang) for r in out) == [(0, "p q r s t", "en"), (0, "p q r s t", "en"), (1, "p q r s t", "de"), (2, "other words here now", "en"), (3, "", "en"), (3, "", "en")]


def test_suffix(odd):
    got = {r.doc_id: (r.repeated, r.removed) for r in suffix_dedup.repeated_passages(odd).collect()}
    assert set(got) == {5, 6}
    assert got[6][1] == [(0, 30_000)] and got[5][0][0].first == 0


def test_mixing(odd):
    rows = mixing.mix(odd, {"b": 3}, total_tokens=1001).collect()
    took = {}
    for r in rows:
        took[r.source] = took.get(r.source, 0) + r.take_tokens
    assert took == {"a": 166, "b": 500, "c": 166, None: 166}
    again = mixing.mixed_documents(odd, weights={"b": 3}, total_tokens=1001)
    assert again.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.source: r.t for r in again.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"\S+"))).alias("t")).collect()}["b"] == 500


def test_mixture_is_exact_where_rows_repeat(spark):
    rows = [(7, "a b c d e", "en", "s", 9), (7, "a b c d e", "en", "s", 9), (8, "f g", "en", "t", 3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for budget in (7, 3, 10, 12, 27):
        out = mixing.mixed_documents(docs, weights={"t": 0}, total_tokens=budget).collect()
        assert sum(len(r.text.split()) for r in out) == budget and all(r.n_chars == len(r.text) for r in out)


def test_packing(odd):
    rows = packing.pack(odd, 1024, 4096).collect()
    by = {}
    for r in rows:
        assert len(r.text.split(" ")) == r.length and r.length & (r.length - 1) == 0
        by.setdefault((r.doc_id, r.copy), []).append((r.start, r.text))
    assert " ".join(t for _, t in sorted(by[5, 0])) == LONG
    assert {k for k in by if k[0] == 7} == {(7, 0), (7, 1)} and (None, 0) in by and not {2, 3, 4} & {k[0] for k in by}
    slots = {}
    for r in rows:
        slots.setdefault(r.length, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_quality(odd):
    got = {r.doc_id: r for r in quality.clean_lines(odd).collect()}
    assert all(got[k].rejected and got[k].text == "" for k in (2, 3, 4)) and not got[1].rejected


def test_quality_rules_hold_at_every_length(spark):
    menu, prose = " | ".join(["Home", "About us", "Contact"] * 400), "The next step, as we saw, is to look back at what they share."
    rows = [(1, "Home | Products | Contact us"), (2, menu), (3, "Click here"), (4, "Click here to see, in full, " + "the words, " * 400), (5, "Next we consider the second problem, which is harder."), (6, prose), (7, (prose + " ") * 50 + "All rights reserved."), (8, "All rights reserved. Terms of use apply."), (9, "home")]
    got = {r.doc_id: r.rejected for r in quality.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: True, 2: True, 3: True, 4: True, 5: False, 6: False, 7: False, 8: True, 9: True}


def test_fingerprints(odd):
    got = {r.doc_id: r for r in fingerprints.fingerprints(odd).collect()}
    assert got[1].fingerprint == got[7].fingerprint and got[7].first_id == 1
    assert got[2].fingerprint == got[3].fingerprint == got[4].fingerprint == "0" * 256


def test_toxicity(odd):
    got = {r.doc_id: r for r in toxicity.score(odd, MODEL).collect()}
    assert [got[k].n_windows for k in (2, 3, 4, 8)] == [0, 0, 0, 1] and not got[2].toxic
    assert got[5].n_windows == -(-(30_000 - toxicity.WINDOW) // toxicity.STRIDE) + 1


def test_sharding(odd):
    got = sharding.shard(odd, 2).collect()
    assert len({r.shard for r in got if r.doc_id in (1, 7)}) == 1
    by_source = sharding.shard(odd, 2, group_col="source").collect()
    assert len({(r.group_key, r.shard) for r in by_source}) == 4


def test_warc(spark):
    schema = "page_id long, url string, html string, header string, digest string"
    rows = [(1, "u", "<p>x</p>", "h", "d"), (2, None, "<p>x</p>", None, None), (3, "v", None, None, None), (4, "v", "", None, None), (None, "z", "y" * 100_000, None, None), (1, "u", "<p>x</p>", "h", "d")]
    got = warc.resolve(warc.captures(spark.createDataFrame(rows, schema))).collect()
    assert sorted((r.record_id, r.type, r.refers_to or "") for r in got if r.record_id[0] == "p") == [("page:1", "response", ""), ("page:2", "revisit", "page:1"), ("page:3", "response", ""), ("page:4", "revisit", "page:3"), ("page:none", "response", "")]
    assert sorted((r.record_id, r.type, r.refers_to, r.payload) for r in got if r.record_id[0] == "a") == [("again:1", "revisit", "page:1", None), ("again:2", "revisit", "page:1", None), ("again:4", "revisit", "page:3", None)]
    clash = warc.captures(spark.createDataFrame(rows, schema)).withColumns({c: F.lit("x") for c in ("k", "nth", "original", "present", "copy", "found")})
    assert sorted(map(str, warc.resolve(clash).collect())) == sorted(map(str, got))
    assert warc.resolve(warc.captures(spark.createDataFrame([], schema))).count() == 0


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, prompt string, at string"
    rows = [(1, 0, "user", "q", "", ""), (1, 1, "assistant", None, "", ""), (1, None, "system", "s", "", ""), (1, 1, "assistant", "b", "", ""), (1, 1, "assistant", "b", "", ""), (None, 0, "assistant", "lone", "", ""), (2, 0, None, "x", "", "")]
    got = chat.expand(spark.createDataFrame(rows, schema)).orderBy("conv_id", "n_context").collect()
    assert [(r.conv_id, r.n_context) for r in got] == [(None, 0), (1, 2), (1, 3), (1, 4)]
    assert got[1].prompt == "<|system|>\ns<|end|>\n<|user|>\nq<|end|>\n<|assistant|>\n" and got[1].target == "<|end|>\n"
    assert all(r.text[r.train_start : r.train_end] == r.target for r in got)
    assert chat.expand(spark.createDataFrame([], schema)).count() == 0


def joined(rows) -> set:
    """All pairs of documents that the rows stand for: stars of equal sets, and pairs of the first documents of two sets."""
    star, near = {}, []
    for r in rows:
        if r.jaccard == 1:
            star.setdefault(r.doc_id_a, {r.doc_id_a}).add(r.doc_id_b)
        else:
            near.append((r.doc_id_a, r.doc_id_b))
    groups = [(x, x) for x in star] + near
    return {tuple(sorted((x, y))) for a, b in groups for x in star.get(a, {a}) for y in star.get(b, {b}) if x != y}


def test_random_joins_match_brute_force(spark):
    rng = random.Random(3)
    base = [[f"t{rng.randrange(400)}" for _ in range(rng.choice([2, 3, 5, 9, 30, 90, 200]))] for _ in range(25)]
    docs = []
    for b in base:
        for _ in range(rng.choice([1, 2, 5])):
            w = list(b)
            for _ in range(rng.randrange(0, max(2, len(w) // 12))):
                w[rng.randrange(len(w))] = f"z{rng.randrange(1000)}"
            docs.append((len(docs), " ".join(w)))
    sets = {i: {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} for i, w in ((i, t.split()) for i, t in docs)}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) * 2 >= len(sets[a] | sets[b])}
    rows = ngram_join.ngram_jaccard_join(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert joined(rows) == want


def test_crowds_of_near_copies_are_found(spark):
    """A group all of whose grams are common: every pair that is similar is found, on either side of the boundary."""
    rng = random.Random(8)
    base = [f"t{rng.randrange(3000)}" for _ in range(120)]
    docs = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.randrange(1, 14)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10_000)}"
        docs.append((i, " ".join(w)))
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, t in docs for w in [t.split()]}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) * 2 >= len(sets[a] | sets[b])}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    middle = sorted(map(len, sets.values()))[len(sets) // 2] - 1
    for limit in (0, middle, 10**9, None):
        rows = ngram_join.ngram_jaccard_join(df, limit=limit).collect()
        assert len(rows) == len(want) and {(r.doc_id_a, r.doc_id_b) for r in rows} == want


def test_large_labels_are_cut(spark, monkeypatch):
    """Labels and lists of more sets than a block holds give the same pairs."""
    docs = [(i, " ".join(f"t{k}" for k in range(40)) + f" u{i}") for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    pairs = lambda **o: sorted((r.doc_id_a, r.doc_id_b) for r in ngram_join.ngram_jaccard_join(df, **o).collect())
    whole = pairs()
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    monkeypatch.setattr(ngram_join, "LIST", 9)
    assert pairs(limit=0) == pairs(limit=10**9) == whole and len(whole) == 435


def test_every_stage_takes_odd_and_empty_tables(spark, odd, empty):
    import corpus_pipeline
    from tests.conftest import SMALL

    ids = lambda df: sorted((r.doc_id is None, r.doc_id or 0) for r in df.collect())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SMALL)
        assert stage(spark, empty, SMALL).count() == 0
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == {1, None, 5, 6, 7, 8, 9}
            continue
        assert out.columns == corpus_pipeline.COLUMNS
        if name == "toxicity":  # nothing here is labelled, so nothing is rejected
            assert ids(out) == ids(odd)
        if name == "n-gram Jaccard join":  # 7 (twice) is like 1, 6 like 5; the row without id stays
            assert ids(out) == sorted((x is None, x or 0) for x in (1, 2, 3, 4, None, 5, 8, 9))
        if name == "suffix-array dedup":
            assert {r.doc_id: r.text for r in out.collect()}[6] == "tail"


def test_toxicity_rejects_only_toxic_documents(spark):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(400):
        w = [f"w{rng.randrange(200)}" for _ in range(rng.randrange(20, 120))]
        bad = i % 4 == 0
        for _ in range(3 if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["vile", "rotten"]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs.append((900, None))
    df, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (3, None), (999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(df, marks, toxic=60, clean=150)
    wrong = toxicity.score(df, model).where("toxic <> (doc_id % 4 = 0 and doc_id < 900)").count()
    assert wrong <= 8
