"""Scalar functions against hand-made cases and plain Python."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import latex
from quire.functions import text as T


def one(spark, column, *values):
    rows = spark.createDataFrame([(v,) for v in values], "t string").select(column.alias("r")).collect()
    return [r.r for r in rows]


def test_squeeze_is_unicode(spark):
    assert one(spark, T.squeeze("t"), "a 　 b\t", None, "") == ["a b", "", ""]


def test_low_information(spark):
    cases = {"": True, "(1) (2)": True, "i. ii.": True, "Hello, world": False, "a b c": True, "plain words here, of some length!": False, "(x)": True}
    assert one(spark, T.low_information("t"), *cases) == list(cases.values())


def test_richer(spark):
    rows = spark.createDataFrame([("(1)", "a much longer sentence indeed"), ("same", "same"), ("abc", "abcd"), ("x", "")], "a string, b string")
    assert [r.r for r in rows.select(T.richer("a", "b").alias("r")).collect()] == [True, False, False, False]


@pytest.mark.parametrize("text,masked,found", [("a $x$ b $y_1$", "a [MATH_MASK_0] b [MATH_MASK_1]", ["$x$", "$y_1$"]), (r"price \$5 only", r"price \$5 only", []), ("odd $ one", "odd $ one", []), ("x<sup>2</sup> <b>bold</b>", "x^2 bold", [])])
def test_mask(spark, text, masked, found):
    (got,) = one(spark, T.mask("t"), text)
    assert (got.text, got.formulas) == (masked, found)


def test_unmask_loose_marks(spark):
    df = spark.createDataFrame([("a [ MATH_MASK_0 ] [MATH MASK 1] [MATHASK_1] MATH_MASK_0 [MATH_MASK_7]", ["$x$", "$y$"])], "t string, f array<string>")
    assert df.select(T.unmask("t", F.col("f")).alias("r")).first().r.split() == ["a", "$x$", "$y$", "$y$$x$"]  # a mark without brackets takes the blanks before it along


def test_mask_round_trip(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", " ", "$x$", "$a_b$", "é", ".", "[1]"]) for _ in range(30)) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.mask("t", tags=False).alias("m"))
    assert df.where(T.unmask("m.text", F.col("m.formulas")) != F.col("t")).count() == 0


def test_formula_issues(spark):
    df = spark.createDataFrame([("$x$", ""), ("$x$", "y"), ("a", "a $"), ("a", r"\alpha {b} c_d [MATH_MASK_1]"), ("$x$", "$x$ ok")], "a string, b string")
    got = [r.r for r in df.select(T.formula_issues("a", "b").alias("r")).collect()]
    assert got == [["empty_translation"], ["formula_loss"], ["odd_dollar_count"], ["brace_leak", "latex_command_leak", "placeholder_residue", "script_token_leak"], []]


def test_clean_output(spark):
    got = one(spark, T.clean_output("t"), "Translation: “hello there”", "I'm sorry, no", "---\ntext stays\nNote: gone", None)
    assert got == ["hello there", "", "text stays", ""]


def test_meta_output(spark):
    assert one(spark, T.meta_output(F.lit("the text"), "t"), "请提供需要翻译的文本", "普通译文", "规则：一 要求：二") == [True, False, True]


def test_rounding_is_half_even(spark):
    r = spark.range(1).select(T.round_half(F.lit(10.25)).alias("a"), T.round_half(F.lit(10.75)).alias("b"), T.round_step(F.lit(1.33), 0.05).alias("c")).first()
    assert (r.a, r.b, round(r.c, 9)) == (10.0, 11.0, 1.35)


def test_color_and_flags(spark):
    r = spark.range(1).select(T.unpack_color(F.lit(0xFF8000)).alias("c"), T.is_bold(F.lit(16)).alias("b"), T.is_italic(F.lit(16)).alias("i")).first()
    assert (r.c.r, round(r.c.g, 3), r.c.b, r.b, r.i) == (1.0, 0.502, 0.0, True, False)


def test_candidate_text(spark):
    assert one(spark, T.candidate_text("t"), '```json\n{"text": "a b"}\n```', '{"rewrite": "c"}', '"quoted"', 'noise "text": "found" noise') == ["a b", "c", "quoted", "found"]


def test_render_units(spark):
    assert one(spark, T.render_units("t"), "ab-c $x y$ 中文!")[0] == ["ab-c", " ", "$x y$", " ", "中", "文", "!"]


@pytest.mark.parametrize("raw,want", [(r"\al pha", r"\alpha"), (r"\al pha x", r"\al pha x"), (r"\frac {a}{b}", r"\frac{a}{b}"), (r"{{a+b}}", "a+b"), (r"\alphax", r"\alpha x"), (r"\begin{array}{c} a+b \end{array}", "a+b"), (r"\begin{array}{c} a & b \end{array}", r"\begin{array}{c} a & b \end{array}"), (r"{a}{b}", r"{a}{b}"), ("", "")])
def test_normalize(raw, want):
    assert latex.normalize(raw) == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="{}ab ", max_size=12))
def test_outer_braces_keeps_content(text):
    out = latex.outer_braces(text)
    assert out.replace("{", "").replace("}", "").strip() == text.replace("{", "").replace("}", "").strip()
    assert latex.outer_braces(out) == out


def test_inline_box_grows():
    assert latex.inline_box("", 10, 13)[0] == 8.0
    assert latex.inline_box(r"\frac{a}{b}", 10, 13)[1] > latex.inline_box("a", 10, 5)[1]
