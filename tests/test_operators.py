"""Operators against hand-made rows and brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import classify, coverage, distribute, experiments, layout, model, order, reflow, spatial, state, stats
from quire.plans import block_queries, paragraph_queries  # noqa: F401
from quire.plans.catalog import QUERIES
from quire.sources import corpus
from tests.conftest import SMALL


def test_coverage_labels(spark):
    rows = [(1, 0, "text", None, "x" * 100), (1, 1, "text", None, "x" * 100), (1, 2, "text", None, "x" * 100), *((1, 2, "equation", None, "") for _ in range(4)), (1, 3, "text", None, "x" * 100), *((1, 3, "reference", None, "") for _ in range(3)), (1, 9, "text", None, "gone")]
    b = spark.createDataFrame(rows, "doc_id long, page_idx int, type string, detected_type string, translated string")
    p = spark.createDataFrame([(1, 1, "y" * 82), (1, 2, "y" * 81), (1, 3, "y" * 50), (1, 4, "y" * 55), (1, 5, " a "), (1, 6, None)], "doc_id long, page_no int, page_text string")
    got = [(r.page_no, r.label, r.ratio) for r in coverage.page_coverage(b, p).orderBy("page_no").collect()]
    assert got == [(1, "OK", 0.82), (2, "建议视觉复核", 0.81), (3, "公式页低抽取", 0.5), (4, "参考文献页低抽取", 0.55), (5, "非主文本页", 1.0), (6, "非主文本页", 0.0)]


def test_buckets(spark):
    cases = {"Text": "body", "outline": "body", "table_caption": "caption", "sub_title": "title", "page_footnote": "footnote", "x_header": "header", "": "body", None: "body"}
    df = spark.createDataFrame([(k, None) for k in cases], "type string, detected_type string")
    assert [r.b for r in df.select(classify.bucket().alias("b")).collect()] == list(cases.values())
    assert [r.p for r in df.select(classify.preserved().alias("p")).collect()] == [False, True, True, False, False, False, False, False]


def test_reference_entries(spark):
    texts = ["[1] A. Author, A paper on things, 2001", "References", "Smith, J. and Doe, A. B. Title of a work. Journal 12, 2003", "nothing of that kind in this one"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(classify.reference_entry("t").alias("e"), classify.reference_heading("t").alias("h"), classify.reference_fragment("t").alias("f")).collect()
    assert [(r.e, r.h) for r in got] == [(True, False), (False, True), (True, False), (False, False)] and got[2].f


def test_reading_order_in_columns(spark):
    rows = [(1, 0, 1, 0, 300.0, 10.0, 500.0), (1, 1, 1, 0, 50.0, 50.0, 250.0), (1, 2, 1, 0, 50.0, 10.0, 250.0), (1, 3, 1, 0, 50.0, 90.0, 500.0), (1, 4, None, 0, 0.0, 0.0, 9.0)]
    df = spark.createDataFrame(rows, "doc_id long, idx long, lid int, page_idx int, x0 double, y0 double, x1 double").withColumn("y1", F.col("y0") + 10)
    assert [r.idx for r in order.reading_order(df).orderBy("place").collect()] == [3, 2, 1, 0]


def test_series_freezing(spark):
    groups = {"a": [1.0, 1.0, 1.2], "b": [1.0, 1.0, 1.5, 2.0], "c": [1.0, 1.0, 2.0, 2.0], "d": [1.3]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "g string, v double")
    assert {r.g: round(r.v, 6) for r in stats.freeze_series(df, ["g"], "v", 0.5, "v").collect()} == {"a": 1.0, "b": 1.0, "c": 1.5, "d": 1.5}
    sizes = {"one": [9.3], "five": [8, 9, 10, 11, 12], "spread": [8, 8, 9, 10, 11, 12]}
    df = spark.createDataFrame([(k, float(v)) for k, vs in sizes.items() for v in vs], "g string, v double")
    assert {r.g: r.v for r in stats.freeze_body_size(df, ["g"], "v", "v").collect()} == {"one": 9.5, "five": 10.0, "spread": 8.0}


def test_mode_takes_the_first(spark):
    df = spark.createDataFrame([([3, 1, 1, 3, 2],)], "a array<int>")
    assert df.select(stats.mode_first(F.col("a")).alias("m")).first().m == 3


def wrap(text, width, size, char):
    lines, pen = 1 if text else 0, 0.0
    for c in text:
        if c == "\n":
            lines, pen = lines + 1, 0.0
            continue
        w = size * (1.0 if "一" <= c <= "鿿" else 0.3 if c.isspace() else 0.6)
        if pen > 0 and pen + w > width + 1e-9:
            lines, pen = lines + 1, 0.0
        pen += w + char
    return lines


@pytest.mark.parametrize("seed", range(6))
def test_breaking_lines(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("ab 中\n") for _ in range(rng.randrange(0, 60))) for _ in range(80)]
    width = np.array([rng.choice([3.0, 20.0, 50.0, 97.5]) for _ in texts])
    size, char = np.full(len(texts), 10.0), np.array([rng.choice([0.0, 0.05, 0.2]) for _ in texts])
    heights, bounds = layout.break_lines(texts, width, size, size * 0 + 1.3, char)
    assert np.diff(bounds).tolist() == [wrap(t, w, 10.0, c) for t, w, c in zip(texts, width, char)]
    for k, t in enumerate(texts):
        own = heights[bounds[k] : bounds[k + 1]]
        assert (own >= 10.6 - 1e-9).all() and ((own > 10.9).any() == ("中" in t))


def test_simulation_edges(spark):
    rows = [("中" * 10, 50.0, 13.0, 10.0, 1.3), ("a", 0.0, 10.0, 10.0, 1.3), ("", 50.0, 10.0, 10.0, 1.3), (None, 50.0, 10.0, 20.0, 1.3), ("$x$ and $\\frac{a}{b}$", 500.0, 20.0, 10.0, 1.0)]
    df = spark.createDataFrame(rows, "text string, width double, height double, size double, line double").withColumns({"char": F.lit(0.0), "locked": F.lit(True)})
    got = layout.simulate(df).collect()
    assert (got[0].line_count, got[0].needed_height, got[0].is_overflow) == (2, 26.0, True)
    assert got[1].needed_height is None and (got[2].line_count, got[3].line_count) == (0, 0) and got[4].needed_height > 14


def test_micro_tune(spark):
    base = {"width": 300.0, "size": 10.0, "line": 1.3, "char": 0.05, "locked": True, "font_key": "body", "threshold": 0.6, "limit": 0.98, "global_min": 0.0, "global_max": 0.2, "max_delta": 0.035}
    rows = [{"k": 0, "text": "a" * 90, "height": 30.0} | base, {"k": 1, "text": "a" * 400, "height": 30.0} | base, {"k": 2, "text": "a" * 50, "height": 13.3} | base | {"width": 302.0}]
    got = {r.k: r for r in layout.micro_tune(spark.createDataFrame(rows), ["k"]).collect()}
    assert got[0].status == "perfect" and got[1].status == "overflow" and got[1].overflow_px > 50
    assert got[2].status == "tuned_compact" and got[2].char < 0.05


def test_probe_prefers_what_fits(spark):
    rows = [{"k": 0, "bucket": "body", "text": "word " * 60, "width": 200.0, "height": 60.0, "size": 11.0, "line": 1.4, "char": 0.05, "dense": True, "density": 60.0, "avg_length": 100.0, "layout_mode": "single_col"}]
    r = layout.probe(spark.createDataFrame(rows), ["k"]).first()
    assert r.size <= 11.0 and 6.0 <= r.size and r.score < 3000


def test_spread_gives_the_text_again():
    rng = random.Random(7)
    for _ in range(200):
        text = "".join(rng.choice(["a", "中", "。", ",", "(", ")", "$x$", " "]) for _ in range(rng.randrange(0, 80)))
        n = rng.randrange(1, 5)
        room = [rng.uniform(5, 50) for _ in range(n)]
        pieces = distribute.spread(text, [""] * n, room)
        assert "".join(pieces) == text and len(pieces) == n
        assert all(p.count("$") % 2 == 0 for p in pieces)


def test_spread_stops_at_sentences():
    pieces = distribute.spread("a" * 18 + "。" + "b" * 20, ["s", "s"], [10.0, 10.0])
    assert pieces == ["a" * 18 + "。", "b" * 20]


def test_fit_gives_the_text_again():
    text = "one two, three four. five six seven eight nine ten"
    pieces = distribute.fit(text, ["x" * 10 + ".", "x" * 10, "x"], [200.0, 200.0, 200.0], [30.0, 30.0, 30.0], 10.0, 1.3, 0.0)
    assert "".join("".join(pieces).split()) == "".join(text.split())
    assert distribute.fit("", ["a", "b"], [50.0, 50.0], [20.0, 20.0], 10.0, 1.3, 0.0) == ["", ""]


def test_fit_leaves_what_the_next_box_can_hold():
    """The first box could take all but one word; the second has room for most, and the score fills the first."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    tight = distribute.fit(words, ["source runs", "on here"], [60.0, 60.0], [100.0, 30.0], 10.0, 1.3, 0.0)
    heights = layout.heights_of(tight, np.full(2, 60.0), np.full(2, 10.0), np.full(2, 1.3), np.zeros(2))
    assert " ".join(tight) == words and (heights <= [100.0, 30.0]).all() and tight[0]
    assert distribute.bridges("runs", "on") and not distribute.bridges("ends.", "On")


def test_fit_matches_a_search_of_all_ends():
    """Two boxes: no allowed end scores better than the one taken."""
    rng = random.Random(9)
    for _ in range(15):
        text = " ".join(rng.choice(["aa", "bbb,", "c.", "dddd", "$x^2$"]) for _ in range(rng.randrange(4, 30)))
        width, height = [rng.choice([40.0, 130.0])] * 2, [rng.choice([25.0, 60.0]), 200.0]
        source = [rng.choice(["abc.", "abc"]), "def"]
        got = distribute.fit(text, source, width, height, 10.0, 1.3, 0.0)
        units = distribute._UNITS.findall(text)
        boxes = distribute._Fitting(units, width, height, (10.0, 1.3, 0.0))
        allowed = {e: boxes.score(0, 0, e, distribute.bridges(*source)) for e in range(1, len(units)) if boxes.fits(0, 0, e) and boxes.rest_fits(1, e)}
        taken = [e for e in range(1, len(units)) if "".join(units[:e]).strip() == got[0]]
        if allowed:
            assert max(allowed.values()) - max(allowed.get(e, -9) for e in taken) < 1e-6


def plain_height(text, width, size, line, char):
    """Greedy wrapping of one text, unit by unit."""
    adv, high, _ = layout._units([text], np.array([width]), np.array([size]), np.array([line]))
    total, tallest, pen, first = 0.0, 0.0, 0.0, True
    for a, h in zip(adv, high):
        if np.isnan(a) or (not first and pen + a > width + 1e-9):
            total += max(tallest, 1.06 * size, size * line)
            tallest, pen, first = 0.0, 0.0, True
        if not np.isnan(a):
            tallest, pen, first = max(tallest, h), pen + a + char, False
    return total + max(tallest, 1.06 * size, size * line) if len(adv) else 0.0


def test_layout_with_formulas_matches_plain_loops(spark):
    """c1_formulas and c12_accordion over all blocks of the smallest tables, text by text."""
    b = block_queries.boxes(spark, SMALL)
    rows = {(r.doc_id, r.idx): r for r in b.collect() if "$" in r.text}
    got = QUERIES["c1_formulas"](spark, SMALL).collect()
    assert len(got) == len(rows) > 0
    for g in got:
        r = rows[g.doc_id, g.idx]
        assert abs(g.needed_height - plain_height(r.text, r.width, r.size, 1.35, 0.05)) < 1e-5
    for g in QUERIES["c12_accordion"](spark, SMALL).collect():
        if g.action in ("scale_down", "overflow_accepted", "none") and (g.doc_id, g.idx) in rows:
            r = rows[g.doc_id, g.idx]
            size = float(layout.resolved(np.array([g.size]))[0])
            need = plain_height(r.text, r.width, size, 1.35, 0.05)
            assert abs(g.fill_ratio * r.height - need) < 1e-5 and (need <= r.height) == (g.action != "overflow_accepted")
            assert g.action != "overflow_accepted" or g.size == layout.LEAST_SIZE


def test_probe_matches_plain_loops(spark):
    """The whole grid, text by text, for blocks with and without formulas."""
    rows = block_queries._probe_rows(spark, SMALL).where("contains(text, '$') or idx % 9 = 0")
    best = {(r.doc_id, r.idx): r for r in layout.probe(rows, ["doc_id", "idx"]).collect()}
    r0 = rows.withColumns({"sizes": layout.size_candidates(F.col("size"), F.col("bucket"), F.col("dense")), "chars": layout.char_candidates(F.col("char")), "lines": layout.line_candidates(F.col("line"), F.col("bucket"), F.col("layout_mode")), "target": F.expr(layout.TARGET_FILL_SQL).cast("double"), "safe": F.greatest(F.lit(1.0), F.col("height") * F.expr(layout.SAFE_BOX_SQL))}).limit(40).collect()
    for r in r0:
        scores = []
        for s in r.sizes:
            for c in r.chars:
                for n in r.lines:
                    need = plain_height(r.text, r.width, float(layout.resolved(np.array([s]))[0]), n, c)
                    score = (1500 if need > r.height else 450 if need > r.safe else 0) + abs(need / r.safe - r.target) * 120 + abs(n - r.line) * 35 + abs(c - r.char) * 400
                    score += max(0, s - r["size"]) * (30 if r.bucket == "body" else 10) + (max(0, n - r.line) * 55 if r.bucket == "body" and r.layout_mode == "single_col" else 0) - s * 0.05
                    scores.append(score)
        assert abs(best[r.doc_id, r.idx].score - min(scores)) < 2e-3


def test_recovery_examples_are_the_first_five(spark):
    rows = block_queries.recovered_rows(spark, SMALL).collect()
    want = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.idx)):
        if r.recovered is not None and len(want.setdefault(r.doc_id, [])) < 5:
            want[r.doc_id].append((r.page_idx + 1, r.source, r.recovered[:140]))
    got = {}
    for r in QUERIES["t3_recovery_examples"](spark, SMALL).orderBy("doc_id", "nth").collect():
        got.setdefault(r.doc_id, []).append((r.page_no, r.source, r.excerpt))
    assert got == want and got


def test_severe_underflow_by_layout(spark):
    rows = [("single_col", 0.69, True), ("single_col", 0.75, False), ("double_col", 0.73, True), ("double_col", 0.75, False), ("other", 0.67, True), ("other", 0.69, False)]
    df = spark.createDataFrame([(*r, "body", 0.5, 20.0, False) for r in rows], "layout_mode string, fill_ratio double, want boolean, font_key string, threshold double, height double, safe_prose boolean")
    assert all(r.want == r.got for r in df.withColumn("got", F.expr(classify.SEVERE_SQL)).collect())


def test_state_machine(spark):
    steps = ["TRANSLATED", "PENDING", "TRANSLATED", "OVERFLOW", "REWRITE_SCHEDULED", "PENDING", "OPTIMAL", "OVERFLOW"]
    rows = [("a", k, s, k, False) for k, s in enumerate(steps)] + [("b", 0, "PENDING", 0, True), ("c", 0, "NONSENSE", 0, False), (None, 0, "TRANSLATED", 0, False)]
    log = state.replay(spark.createDataFrame(rows, "lid string, seq int, status string, round int, force boolean"))
    assert [r.accepted for r in log.where("lid = 'a'").orderBy("seq").collect()] == [True, True, False, True, True, True, True, False]
    states = {r.lid: (r.state, r.round) for r in state.final_states(log).collect()}
    assert states == {"a": ("OPTIMAL", 6), "b": ("PENDING", 0)}
    assert [r.lid for r in state.skippable(state.final_states(log), 7).collect()] == ["a"]


def test_bottom_limits_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(1, 0, k, float(rng.randrange(0, 300)), float(rng.randrange(0, 200)), 0.0, 0.0) for k in range(40)]
    rows = [(d, p, k, x, y, x + rng.randrange(10, 200), y + rng.randrange(5, 60)) for d, p, k, x, y, _, _ in rows]
    got = {r.idx: r.bottom_limit for r in spatial.bottom_limits(spark.createDataFrame(rows, "doc_id long, page_idx int, idx long, x0 double, y0 double, x1 double, y1 double")).collect()}
    ordered = sorted(rows, key=lambda r: (r[4], r[3], r[2]))
    for i, (_, _, k, x0, y0, x1, y1) in enumerate(ordered):
        limit = y1 + 3
        for _, _, _, a0, b0, a1, b1 in ordered[i + 1 :]:
            if b0 > y1 + 27:
                break
            if max(0, min(x1, a1) - max(x0, a0)) >= max(8, min(x1 - x0, a1 - a0) * 0.18) and b0 > y0:
                limit = min(limit, max(y1, b0 - 0.8))
                break
        assert got[k] == pytest.approx(limit)


def test_merged_length(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 8), (1, 10, 12), (1, 11, 11), (2, 3, 4)], "g int, start int, end int")
    assert {r.g: (r.covered, r.stretches) for r in spatial.merged_length(df, ["g"]).collect()} == {1: (10, 2), 2: (1, 1)}


@pytest.mark.parametrize("rounds,rewrite,want", [(0, True, 2), (1, True, 2), (3, True, 3), (0, False, 1), (3, False, 1)])
def test_iterations(rounds, rewrite, want):
    assert reflow.iterations(rounds, rewrite) == want


def fitted(spark, texts):
    base = {"doc_id": 1, "width": 300.0, "height": 40.0, "size": 10.0, "line": 1.3, "char": 0.05, "locked": True, "font_key": "body", "threshold": 0.6, "limit": 0.98, "global_min": 0.0, "global_max": 0.2, "max_delta": 0.035, "layout_mode": "single_col", "safe_prose": True, "mathy": False, "can_rewrite": True}
    return spark.createDataFrame([{"idx": k, "text": t} | base for k, t in enumerate(texts)])


def test_rounds_settle(spark):
    done, log = reflow.run_rounds(fitted(spark, ["a" * 100, "a" * 900, "a" * 10]), reflow.length_rewriter, 3)
    assert {r.idx: r.state for r in done.collect()}.keys() == {0, 1, 2}
    assert log.where("round = 0 and issue <> 'OPTIMAL'").count() == 2
    done, log = reflow.run_rounds(fitted(spark, ["a" * 900]), None, 3)
    assert (done.first().state, log.count()) == ("FORCE_FIT", 1)


class Echo:
    def complete(self, prompt, temperature):
        if "fail" in prompt:
            raise OSError
        return prompt.split("\n\n", 1)[1].replace("[MATH_MASK_0]", "" if "lose" in prompt else "[ MATH_MASK_0 ]")


def test_translate(spark):
    rows = [("plain text", False), ("a $x$ b", False), ("lose $x$ it", False), ("kept", True), ("", False), ("Abstract", False)]
    got = model.translate(spark.createDataFrame(rows, "text string, keep boolean"), Echo(), direct={"Abstract": "摘要"}).collect()
    assert [(r.translated, r.mode, r.fallback_used) for r in got] == [("plain text", "direct", False), ("a $x$ b", "direct", False), ("lose $x$ it", "formula_safe_fallback", True), ("kept", "kept", False), ("", "kept", False), ("摘要", "kept", False)]


def test_ask_retries():
    waits = []
    assert model.ask(Echo(), "x\n\nfail", sleep=waits.append) == "" and waits == [2.0, 4.0]
    assert model.ask(Echo(), "x\n\nfine", sleep=waits.append) == "fine"


def test_unfinished(spark):
    rows = [("the quick brown fox jumps over it", "the quick brown fox jumps over it"), ("the quick brown fox jumps over it", "敏捷的棕色狐狸跳过了它"), ("ab", "ab"), ("the text here is long", "")]
    got = model.unfinished(spark.createDataFrame(rows, "text string, translated string")).collect()
    assert [r.unfinished for r in got] == [True, False, False, True]


class Plain:
    def render(self, doc_id, blocks):
        return "\n".join(b["text"] for b in blocks).encode()


def test_render(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 9.0, 0.0, "second"), (1, 0, 1.0, 0.0, "first"), (2, 0, 0.0, 0.0, "x")], "doc_id long, page_idx int, y0 double, x0 double, text string")
    assert {r.doc_id: r.bytes for r in model.render(df, Plain(), str(tmp_path)).collect()} == {1: 12, 2: 1}
    assert (tmp_path / "1.pdf").read_text() == "first\nsecond"


def test_overrides():
    base = {"translation": {"model": "a", "key": 1}, "other": 2}
    assert experiments.with_overrides(base, {"translation": {"model": "b"}}) == {"translation": {"model": "b", "key": 1}, "other": 2, "reflow": {}}


def test_papers(spark, tmp_path):
    for name in ("c/l/p1/hybrid_auto/p1_content_list.json", "c/l/p1/hybrid_auto/p1_origin.pdf", "c/l/p1/p1_enriched.json", "c/l/p2/p2_enriched.json", "c/l/p3/p3.pdf", "c/l/p3/p3_enriched.json", "c/l/p3/p3_content_list.json", "c/l/p3/q_translated.pdf", "c/l/p3/q_translated.json"):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("[]")
    listing = corpus.files(spark, str(tmp_path))
    got = {r.doc_id: (r.json_path.rsplit("/", 1)[1], r.pdf_path.rsplit("/", 1)[1]) for r in corpus.papers(listing).collect()}
    assert got == {"p1": ("p1_content_list.json", "p1_origin.pdf"), "p3": ("p3_enriched.json", "p3.pdf")}
    assert corpus.translated_pairs(listing).count() == 1


def test_blocks_from_json(spark, tmp_path):
    f = tmp_path / "a.json"
    f.write_text('[{"type": "text", "text": "x", "bbox": [1, 2, 3, 4], "page": 3}, {"text": "y", "bbox": [1, 2], "page_idx": 1, "logical_para_id": 7}]')
    a, b = corpus.read_blocks(spark, str(f)).orderBy("idx").collect()
    assert (a.x0, a.y1, a.page_idx, a.lid) == (1.0, 4.0, 3, None) and (b.x0, b.page_idx, b.lid) == (None, 1, 7)
    spans = spark.createDataFrame([(a.path, 3, 1.0, 2.0, 2.0, 3.0, "s", "f", 9.0, 16, 0)], "path string, page_idx int, x0 double, y0 double, x1 double, y1 double, text string, font string, size double, flags int, color int")
    first = corpus.with_spans(corpus.read_blocks(spark, str(f)), spans, ["path"]).orderBy("idx").first()
    assert [x.text for x in first.rich_spans] == ["s"]


def test_action_logs(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "p_planner.json").write_text('{"action_log": [{"lid": 1, "stage": "reflow", "applied_actions": ["CharSpacing", "CharSpacing"], "metadata": {"issue": "OVERFLOW"}}, {"lid": 2, "applied_actions": []}]}')
    got = {(r.kind, r.name): r.n for r in state.attribution(corpus.read_action_logs(spark, str(tmp_path))).collect()}
    assert got == {("stage", "reflow"): 1, ("stage", "unknown"): 1, ("action", "CharSpacing"): 1, ("issue", "OVERFLOW"): 1}


def test_settings(tmp_path, monkeypatch):
    monkeypatch.setenv("QUIRE_KEY", "k")
    f = tmp_path / "c.json"
    f.write_text('{"translation": {"api_key": "${QUIRE_KEY}", "base_url": "u", "model": "${NO_SUCH_NAME}"}, "list": ["${QUIRE_KEY}"]}')
    config = corpus.load_settings(str(f))
    assert config == {"translation": {"api_key": "k", "base_url": "u", "model": ""}, "list": ["${QUIRE_KEY}"]}
    assert corpus.missing_keys(config) == ["translation.model"]
    assert corpus.requested(["cs", "x", "cs"], ["CS", "Math"], {"cs": "CS"}) == ["CS"] and corpus.requested(["x"], ["CS", "Math"], {}) == ["CS", "Math"]


def test_streamed_attribution(spark, tmp_path):
    from quire.streaming.replay import attribution_stream

    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "stage string, actions array<string>, issue string"
    for stage in ("reflow", "render"):
        spark.createDataFrame([(stage, ["A"], None), (None, [], "OVERFLOW")], schema).write.mode("append").parquet(folder)
        attribution_stream(spark, folder, schema, out, str(tmp_path / "check")).awaitTermination()
    totals = {(r.kind, r.name): r.n for r in spark.read.parquet(out).groupBy("kind", "name").agg(F.sum("n").alias("n")).collect()}
    assert totals == {("stage", "reflow"): 1, ("stage", "render"): 1, ("stage", "unknown"): 2, ("action", "A"): 2, ("issue", "OVERFLOW"): 2}


def test_report(spark):
    cov = spark.createDataFrame([(1, 1, "OK", 5, 5), (1, 2, "建议视觉复核", 9, 1)], "doc_id long, page_no int, label string, expected_chars long, actual_chars long").withColumn("ratio", F.col("actual_chars") / F.col("expected_chars"))
    assert "| 1 | 2 | 建议视觉复核 | 9 | 1 |" in corpus.coverage_report(cov, coverage.review_first(cov))


def test_styled_words(spark):
    from quire.operators import styles

    words = spark.createDataFrame([(1, "term", True, False), (1, "--", True, False), (1, "ab", False, True), (1, "absent", True, False), (2, "aa", True, False), (2, "bb", True, False), (2, "cc", True, False), (2, "dd", True, False)], "k int, token string, bold boolean, italic boolean")
    texts = spark.createDataFrame([(1, "a term and ab ab ab term here"), (2, "aabbccdd")], "k int, translated string")
    assert [(r.k, r.token) for r in styles.sanitise_mapping(words, texts, ["k"]).collect()] == [(1, "term")]


def test_events(spark):
    rows = spark.createDataFrame([("1", ["A", "A", "B"])], "lid string, applied_actions array<string>")
    r = state.events(rows, "reflow", "evaluate").first()
    assert (r.stage, r.applied_actions, r.planned_actions, r.round) == ("reflow", ["A", "B"], [], None)
    assert state.rewrite_delta(spark.createDataFrame([("abc", None)], "before_text string, after_text string")).first().delta == -3


def test_formula_size(spark):
    from quire.operators import styles

    w, h = styles.formula_size(F.lit(100.0), F.lit(20.0), F.lit(10.0), F.lit(25.0))
    r = spark.range(1).select(w.alias("w"), h.alias("h")).first()
    assert (r.w, r.h) == (25.0, 5.0)
    w, h = styles.formula_size(F.lit(8.0), F.lit(5.0), F.lit(10.0), F.lit(25.0))
    assert tuple(spark.range(1).select(w, h).first()) == (8.0, 5.0)
