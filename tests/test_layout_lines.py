"""Line breaking: the same whatever else a batch holds."""

import numpy as np
import pyarrow as pa

from quire.functions import latex
from quire.operators import distribute, layout, reflow, stats


def test_lines_that_fit_exactly_in_a_large_batch():
    """39 letters and 10 blanks of size 9 fill 240 points exactly: one line, also after millions of other characters."""
    exact = ("a" * 4 + " ") * 9 + "aaa "
    noise = [("x" * 7 + " ") * (2_000 + k) for k in range(400)]
    texts = [t for n in noise for t in (n, exact, exact + "b")]
    assert (exact.count("a"), exact.count(" ")) == (39, 10)
    width, size = np.full(len(texts), 240.0), np.full(len(texts), 9.0)
    _, bounds = layout.break_lines(texts, width, size, size * 0 + 1.35, size * 0 + 0.05)
    assert np.diff(bounds).reshape(-1, 3)[:, 1:].tolist() == [[1, 2]] * 400


def _grid_batch(texts):
    n = len(texts)
    column = lambda x: pa.array([x] * n)
    return (pa.array(texts), column([9.5, 10.0, 10.5]), column([0.015, 0.05, 0.085]), column([1.25, 1.35, 1.45]), *(column(x) for x in (240.0, 36.0, 32.4, 0.95, 10.5, 1.35, 0.05, 1.0, 0.0)))


def test_styles_measure_a_formula_once(monkeypatch):
    """The work on formulas doesn't grow with the number of styles tried."""
    seen, normalize = [], latex.normalize
    monkeypatch.setattr(latex, "normalize", lambda t: seen.append(t) or normalize(t))
    texts = [f"as $x_{{{k}}} + once^2$ shows, $$ and $ $ too" for k in range(50)]
    list(layout.best_styles.func(iter([_grid_batch(texts)])))
    assert 0 < len(seen) <= 52


def test_styles_of_a_batch_are_those_of_its_rows():
    texts = ["", "a", "word " * 30, "中文" * 40, "see $\\frac{a}{b}$ and $x$ " * 6, "$ $", "two\nlines"] * 5
    of = lambda ts: [x for b in layout.best_styles.func(iter([_grid_batch(ts)])) for x in b.to_pylist()]
    assert of(texts) == [of([t])[0] for t in texts]


def test_freezing_reads_its_rows_once(spark):
    """The values may come from a costly step, such as the probe of styles."""
    rows = spark.range(100).selectExpr("id % 7 as g", "id % 5 as v")
    plan = stats.freeze_series(rows, ["g"], "v", 0.5, "v")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1


def _boxes(spark):
    one = {"width": 240.0, "height": 24.0, "size": 10.0, "line": 1.3, "char": 0.05, "locked": False, "font_key": "body", "threshold": 0.9, "limit": 0.98, "global_min": 0.02, "global_max": 0.08, "max_delta": 0.035}
    texts = ["a" * 3, "a b " * 40, "$x^2$ and " * 9, "", None, "a" * 39 + "b c"]
    return spark.createDataFrame([{"doc_id": 1, "idx": k, "text": t, "mode": "single_col"} | one for k, t in enumerate(texts)] + [{"doc_id": 2, "idx": 0, "text": "no room", "mode": ""} | one | {"width": 0.0}])


def test_tuning_moves_no_rows(spark):
    """Candidates of a row are tried in it: nothing is exploded, grouped or shuffled."""
    tuned = layout.micro_tune(_boxes(spark), ["doc_id", "idx"], allow_size=True)
    plan = tuned._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan
    got = {(r.doc_id, r.idx): (r.status, r.overflow_px) for r in tuned.collect()}
    assert len(got) == 7 and got[2, 0] == ("overflow", 0.0) and got[1, 1][0] == "overflow" and got[1, 1][1] > 13


def test_rounds_judge_without_a_join(spark):
    plan = reflow.evaluate(_boxes(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_fit_lays_out_no_run_twice(monkeypatch):
    """What is laid out grows with the text, not with the text times the ends that are tried."""
    laid, settle = [0], distribute.settle
    monkeypatch.setattr(distribute, "settle", lambda texts, *x: laid.__setitem__(0, laid[0] + sum(map(len, texts))) or settle(texts, *x))
    text = "some words, and $x^2$ here. " * 300
    pieces = distribute.fit(text, ["one.", "two"], [240.0, 240.0], [36.0, 36.0], 10.0, 1.35, 0.04)
    assert "".join("".join(pieces).split()) == "".join(text.split()) and laid[0] <= 20 * len(text)
