"""Scalar functions over text: columns in, columns out, all inside the JVM.

Patterns carry (?U) where white space, words or digits are meant in the Unicode sense.
NULL reads as the empty text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An inline formula: from an unescaped dollar to the next one.
FORMULA = r"(?<!\\)[$](?:[^$]|\\.)+(?<!\\)[$]"
MARKER = r"[(]?(?:[a-zA-Z]|\d+)[)]?[).]?"
#: Characters without any information: the complement of letters, digits and common signs.
NO_INFORMATION = r"""[^0-9a-zA-Z\u4e00-\u9fff#@?!&%$`"'.,;:~_^()}{\]\[|\\/*\-+<>=]"""
CJK = r"[\u4e00-\u9fff]"
WORD = "[0-9A-Za-z]+"
THEOREM = r"(?i)\b(claim|corollary|definition|example|lemma|proof|proposition|remark|theorem)\b"


def text_of(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def squeeze(c: Column | str) -> Column:
    """Every run of white space one space, none at the ends."""
    return F.trim(F.regexp_replace(text_of(c), r"(?U)\s+", " "))


def compact(c: Column | str) -> Column:
    """Without any white space."""
    return F.regexp_replace(text_of(c), r"(?U)\s+", "")


def strip_control(c: Column | str) -> Column:
    """Without control characters below U+0020 other than newline and tab."""
    return F.regexp_replace(text_of(c), r"[\x00-\x08\x0B-\x1F]", "")


def information_score(c: Column | str) -> Column:
    """How many characters carry information."""
    return information_of(squeeze(c))


def information_of(flat: Column) -> Column:
    """information_score of a squeezed text."""
    return F.length(F.regexp_replace(flat, NO_INFORMATION, ""))


def marker_count(c: Column | str) -> Column:
    """Enumeration marks in a text that consists of them alone, else 0."""
    return _markers(squeeze(c))


def _markers(flat: Column) -> Column:
    # a look for any character that no mark has comes first: it ends early
    only = (flat != "") & ~F.regexp_like(flat, F.lit("[^a-zA-Z0-9(). ]"))
    return F.when(only & (F.trim(F.regexp_replace(flat, MARKER, "")) == ""), count_of(flat, MARKER)).otherwise(0)


def low_information(c: Column | str) -> Column:
    """Empty, two marks or more and nothing else, or brackets with next to nothing around them."""
    return low_information_of(squeeze(c))


def low_information_of(flat: Column) -> Column:
    """low_information of a squeezed text."""
    rest = F.regexp_replace(flat, r"(?U)[\d\s|\\/*\-+<>:;,.\]\[}{)(]+", "")
    return (flat == "") | (_markers(flat) >= 2) | (F.contains(flat, F.lit("(")) & (F.length(rest) <= 2))


def clean_markdown(c: Column | str) -> Column:
    return squeeze(F.regexp_replace(strip_control(c), r"[*\u2022]", ""))


def richer(original: Column | str, candidate: Column | str) -> Column:
    """Whether a candidate text says clearly more than the original one."""
    base, cand = squeeze(original), squeeze(candidate)
    return richer_of(base, information_of(base), cand, information_of(cand))


def richer_of(base: Column, a: Column, cand: Column, b: Column) -> Column:
    """richer of squeezed texts and their scores of information."""
    clearly = (b >= a + 16) | ((b >= F.greatest(F.lit(8), a * 2)) & (F.length(cand) >= F.length(base) + 10))
    return (cand != "") & (cand != base) & clearly


def math_segments(c: Column | str) -> Column:
    """Pairs of dollars plus opening display brackets."""
    t = text_of(c)
    return F.floor(count_of(t, r"\$") / 2).cast("int") + count_of(t, r"\\[\[(]")


def latex_commands(c: Column | str) -> Column:
    return count_of(text_of(c), r"\\[A-Za-z]+")


def theorem_like(c: Column | str) -> Column:
    return F.regexp_like(text_of(c), F.lit(THEOREM))


def clean_html(c: Column | str) -> Column:
    """Super- and subscripts as ^ and _, any other tag dropped."""
    t = text_of(c)
    for pattern, by in ((r"(?i)<sup>([^<]{1,})</sup>", r"^$1"), (r"(?i)<sub>([^<]{1,})</sub>", r"_$1"), (r"<[^>]+>", "")):
        t = F.regexp_replace(t, pattern, by)
    return t


def formulas(c: Column | str) -> Column:
    return F.regexp_extract_all(text_of(c), F.lit(FORMULA), F.lit(0))


def without_formulas(c: Column | str) -> Column:
    return F.regexp_replace(text_of(c), FORMULA, " ")


def mask(c: Column | str, prefix: str = "MATH_MASK_", tags: bool = True) -> Column:
    """struct(text, formulas): formulas replaced by [prefix0], [prefix1], ... from left to right."""
    t = clean_html(c) if tags else text_of(c)
    found = formulas(t)
    parts = F.split(t, FORMULA, -1)
    marks = F.transform(found, lambda _, i: F.concat(F.lit(f"[{prefix}"), i.cast("string"), F.lit("]")))
    joined = F.array_join(F.flatten(F.zip_with(parts, marks, lambda p, m: F.array(p, F.coalesce(m, F.lit(""))))), "")
    return F.struct(joined.alias("text"), found.alias("formulas"))


def unmask(c: Column | str, found: Column, prefix: str = "MATH_MASK_") -> Column:
    """The formulas put back; loosely written marks count, marks without a formula become a space."""
    t = text_of(c)
    exact = rf"[{prefix}$1]"
    for loose in (rf"\[\s*{prefix}(\d+)\s*[\]]", r"[\[]\s*MATH(?:\s+MASK|ASK)[\s_]*(\d+)\s*[\]]", rf"(?<!\[)\s*{prefix}(\d+)(?!\]|\d)"):
        t = F.regexp_replace(t, loose, exact)
    pairs = F.transform(found, lambda f, i: F.struct(F.concat(F.lit(f"[{prefix}"), i.cast("string"), F.lit("]")).alias("m"), f.alias("f")))
    t = F.aggregate(pairs, t, lambda s, p: F.replace(s, p["m"], p["f"]))
    return F.regexp_replace(F.regexp_replace(t, rf"\[{prefix}\d+\]", " "), r"(?i)\[\s*MATH\s*MASK[\s_]*\d+\s*\]", " ")


def cjk_chars(c: Column | str) -> Column:
    return count_of(text_of(c), CJK)


def latin_words(c: Column | str, least: int = 3) -> Column:
    return count_of(text_of(c), rf"(?U)\b[A-Za-z]{{{least},}}\b")


def without_formula_like(c: Column | str) -> Column:
    return squeeze(F.regexp_replace(F.regexp_replace(text_of(c), r"\[MATH_MASK_\d+\]", " "), FORMULA, " "))


def signal_score(c: Column | str) -> Column:
    """CJK characters, four for each Latin word, digits and punctuation, outside of formulas."""
    t = without_formula_like(c)
    return count_of(t, CJK) + latin_words(t, 2) * 4 + count_of(t, r"\d") + count_of(t, "[，。；：,.!?;:]")


def formula_issues(source: Column | str, output: Column | str) -> Column:
    """What is unsafe about a translated text's formulas, sorted."""
    t = strip(text_of(output))
    out = without_formulas(t)
    checks = (
        ("brace_leak", F.regexp_like(out, F.lit(r"(?<!\\)[{}]"))), ("formula_loss", F.size(formulas(t)) < F.size(formulas(source))), ("latex_command_leak", F.regexp_like(out, F.lit(r"\\[A-Za-z]+"))),
        ("odd_dollar_count", count_of(t, r"\$") % 2 != 0), ("placeholder_residue", F.regexp_like(t, F.lit(r"\[MATH_MASK_\d+\]"))), ("script_token_leak", F.regexp_like(out, F.lit(r"(?<!\\)[\^_]"))),
    )
    return F.when(t == "", F.array(F.lit("empty_translation"))).otherwise(F.array_compact(F.array(*(F.when(bad, name) for name, bad in checks))))


#: Marks of leaked instructions, one a line; they are taken literally.
LEAKS = """ABSOLUTE RULES
CRITICAL RULES
EXACT format required
Here is the translation
I apologize
I cannot
I'm sorry
LENGTH CONTROL
MATH_MASK_n
MUST FOLLOW
NO chatty
NO explanations
Output ONLY
PRESERVE ALL
REQUIREMENTS:
The translation is
VIOLATION WILL FAIL
as a language model
as an AI
placeholders EXACTLY
preserve all.*placeholders
作为一个AI
作为语言模型
对不起，我不能
抱歉，我无法""".split("\n")


def clean_output(c: Column | str) -> Column:
    """A model's answer without leaked instructions, lead-ins, quotes, rules and notes."""
    raw = text_of(c)
    t = raw
    for pattern in (r"(?im)^(Answer|Original|Output|Result|Translation|Trans|原文|翻译为|翻译结果|译为|译文)[:：\s]*", r"(?im)^(This is|Here's|Here is|依据|以下是|按照|根据).*?[:：]\s*", "(?im)^[\"'\u201c\u201d\u2018\u2019]+"):
        t = strip(F.regexp_replace(t, pattern, ""))
    quotes = "[\"'\u201c\u201d\u2018\u2019`\n\r ]+"
    t = F.regexp_replace(F.regexp_replace(t, f"^{quotes}", ""), f"{quotes}$", "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: ~F.regexp_like(strip(x), F.lit(r"^(Explanation:|Note:|备注：|说明：)|^[#*=-]+$")))
    t = strip(F.array_join(lines, "\n"))
    leaked = F.exists(F.array(*map(F.lit, LEAKS)), lambda x: F.contains(raw, x))
    return F.when(leaked, "").when((F.length(t) < 5) & (F.length(raw) > 20), strip(raw)).otherwise(t)


_META = "请提供需要翻译 上一次的尝试 不添加其他文字 之前的尝试 仅输出翻译内容 本次尝试 翻译准确且自然 输出格式".split()
_PROMPTISH = r"(?i)\b(?:assistant|format|instructions?|output only|please provide|previous attempt|prompt|requirements?|rules?|system|this attempt)\b"


def meta_output(source: Column | str, output: Column | str) -> Column:
    """Whether an output talks about the task in place of the text."""
    src, out = squeeze(source), squeeze(output)
    hits = lambda marks: sum((F.contains(out, F.lit(m)).cast("int") for m in marks), F.lit(0))
    alone = (hits(_META) > 0) | (F.length(out) > 32)
    asks = F.contains(out, F.lit(_META[0])) & ~F.regexp_like(src, F.lit(r"(?i)\bplease provide\b"))
    both = asks | ((hits((*_META, "要求：", "规则：")) >= 2) & ~F.regexp_like(src, F.lit(_PROMPTISH)))
    return F.when(out == "", False).when(src == "", alone).otherwise(both)


#: Commands and the characters they stand for.
GREEK = {f"\\{name}": char for name, _, char in (pair.partition("=") for pair in (
    "alpha=α beta=β cap=∩ chi=χ colon=: coloneqq=≔ cup=∪ Delta=Δ delta=δ epsilon=ε exists=∃ forall=∀ Gamma=Γ gamma=γ geq=≥ geqslant=≥ in=∈ infty=∞ int=∫ "
    "Lambda=Λ lambda=λ ldots=… leq=≤ leqslant=≤ mid=| mu=μ neq=≠ nu=ν Omega=Ω omega=ω Phi=Φ phi=φ Pi=Π pi=π prod=∏ Psi=Ψ psi=ψ rho=ρ rightarrow=→ Sigma=Σ "
    "sigma=σ subset=⊂ sum=∑ tau=τ Theta=Θ theta=θ times=× to=→ Xi=Ξ "
).split())} | {f"\\mathbb{{{name}}}": char for name, char in zip("CNQRZ", "ℂℕℚℝℤ")}


def latex_to_unicode(c: Column | str) -> Column:
    """Known commands as their characters, longest first; other commands and dollars go."""
    t = text_of(c)
    for command in sorted(GREEK, key=len, reverse=True):
        t = F.replace(t, F.lit(command), F.lit(GREEK[command]))
    return squeeze(F.regexp_replace(F.regexp_replace(t, r"\$", ""), r"\\[A-Za-z]+", ""))


def balance_braces(c: Column | str) -> Column:
    """Closing braces added as far as they are missing."""
    t = text_of(c)
    return F.concat(t, F.repeat(F.lit("}"), F.greatest(F.lit(0), count_of(t, r"\{") - count_of(t, r"\}"))))


def segments(c: Column | str) -> Column:
    """The text in order as an array of (kind, piece): `math` for $...$, `text` for what lies between."""
    marked = F.regexp_replace(text_of(c), r"(?<!\\)\$(?:\\.|[^$])+(?<!\\)\$", "\x01m$0\x01t")
    pieces = F.filter(F.split(F.concat(F.lit("t"), marked), "\x01"), lambda p: F.length(p) > 1)
    return F.transform(pieces, lambda p: F.struct(F.when(F.substring(p, 1, 1) == "m", "math").otherwise("text").alias("kind"), F.substr(p, F.lit(2)).alias("piece")))


def render_units(c: Column | str) -> Column:
    """A text cut into formulas, white space, words, CJK characters and single other ones."""
    return F.regexp_extract_all(text_of(c), F.lit(rf"(?s){FORMULA}|(?U:\s+)|{WORD}(?:[/_-]{WORD})*|{CJK}|."), F.lit(0))


def round_half(c: Column) -> Column:
    """To the nearest half, ties to even."""
    return F.rint(c * 2) / 2


def round_step(c: Column, step: float) -> Column:
    return F.rint(c / F.lit(step)) * F.lit(step)


def unpack_color(c: Column) -> Column:
    """A packed 24-bit colour as struct(r, g, b) in 0 to 1."""
    return F.struct(*((F.shiftright(c, s).bitwiseAND(255) / 255.0).alias(n) for n, s in (("r", 16), ("g", 8), ("b", 0))))


def is_bold(flags: Column) -> Column:
    return flags.bitwiseAND(16) != 0


def is_italic(flags: Column) -> Column:
    return flags.bitwiseAND(2) != 0


def overlap_width(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def candidate_text(c: Column | str) -> Column:
    """The text in a model's answer: without fences, from JSON `text` or `rewrite` if it is such, without quotes."""
    t = strip(F.regexp_replace(text_of(c), r"(?m)^```[A-Za-z]*\s*|```\s*$", ""))
    found = F.coalesce(F.get_json_object(t, "$.text"), F.get_json_object(t, "$.rewrite"), F.nullif(F.regexp_extract(t, r'"(?:text|rewrite)"\s*:\s*"((?:[^"\\]|\\.)*)"', 1), F.lit("")), t)
    return strip(F.regexp_replace(found, "^[\"'\u201c\u201d]+|[\"'\u201c\u201d]+$", ""))
