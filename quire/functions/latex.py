"""Normalisation of inline LaTeX. Rewrites that need a callback or a loop run in one Arrow function; the rest are columns."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from functools import lru_cache
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as S

_FORMULA = re.compile(r"(?<!\\)[$](?:[^$]|\\.)+(?<!\\)[$]")
_SPLIT = re.compile(r"\\((?:[A-Za-z]+\s+)+[A-Za-z]+)")
_REPAIRS = [(re.compile(a), b) for a, b in ((r"(\\[a-zA-Z]+)\s+(?=\{)", r"\1"), (r"\\(math|col|eq)\s*(bb|oneqq|colon)", r"\\\1\2"), (r"\\(leq|geq)\s*slant", r"\\\1slant"), (r"\$\s+|\s+\$", "$"), (r"\{\s+", "{"), (r"\s+\}", "}"), (r"([\^_])\s+\{", r"\1{"))]
_ALONE = (
    "alpha backslash beta cap chi cup Delta delta epsilon exists forall Gamma gamma geq geqslant in infty int Lambda lambda ldots leftarrow leftrightarrow "
    "leq leqslant mid mu neq nu Omega omega Phi phi Pi pi prime prod Psi psi rho rightarrow Sigma sigma subset sum tau Theta theta times to Xi "
).split()
_COMMAND = re.compile(r"\\[a-zA-Z]+")
_FRACTIONS = tuple(f"\\{c}" for c in "binom dfrac frac tfrac".split())
_TALL = tuple(f"\\{c}" for c in "iiint iint int overset prod sqrt sum underset".split())
_BEFORE_LETTER = [re.compile(rf"(\\{c})(?=[0-9A-Za-z])") for c in sorted(_ALONE, key=len, reverse=True)]
_WRAPPERS = [re.compile(r"\\begin[{]ENV[}]\s*(?:[{][^{}]*[}]\s*)?(.*?)\s*\\end[{]ENV[}]".replace("ENV", e), re.DOTALL) for e in "aligned alignedat array gathered smallmatrix split".split()]


def outer_braces(text: str | None) -> str:
    """Without the pairs of braces that enclose all of it."""
    t = (text or "").strip()
    while t.startswith("{") and t.endswith("}"):
        depth, closes = 0, -1
        for k, c in enumerate(t):
            depth += (c == "{") - (c == "}")
            if c == "}" and depth == 0:
                closes = k
                break
        if closes != len(t) - 1:
            break
        t = t[1:-1].strip()
    return t


def unwrap(text: str) -> str:
    """Environments around a single line without alignment marks go, then outer braces."""
    for env in _WRAPPERS:
        text = env.sub(lambda m: m.group(0) if "&" in (inner := outer_braces(m.group(1))) or "\\\\" in inner else inner, text)
    return outer_braces(text)


@lru_cache(maxsize=65_536)
def normalize(text: str) -> str:
    """Commands that recognition broke apart joined again, blanks around braces and dollars dropped, wrappers unwrapped."""
    if not text:
        return text

    def join(m: re.Match) -> str:
        parts = m.group(1).split()
        return "\\" + (m.group(1) if any(len(p) < 2 for p in parts) else "".join(parts))

    text = _SPLIT.sub(join, text)
    for pattern, by in _REPAIRS:
        text = pattern.sub(by, text)
    for command in _BEFORE_LETTER:
        text = command.sub(r"\1 ", text)
    return unwrap(text).strip()


def sanitize(text: str | None) -> str | None:
    """Every inline formula of a text normalised."""
    return text and _FORMULA.sub(lambda m: f"${normalize(m.group(0)[1:-1])}$", text)


@lru_cache(maxsize=50_000)
def box_shape(formula: str) -> tuple[float, float, float] | None:
    """What the box of a formula takes of its size: width by two factors, height; None if it shows nothing."""
    t = normalize(formula or "")
    flat = re.sub(r"\s+", "", t)
    if not flat:
        return None
    commands = _COMMAND.findall(t)
    shown = max(1, len(_COMMAND.sub("m", flat).replace("{", "").replace("}", "")))
    fraction = any(c in t for c in _FRACTIONS)
    tall = fraction or any(c in t for c in _TALL)
    scripts = t.count("^") + t.count("_")
    return shown * 0.46 + len(commands) * 0.14 + min(scripts, 4) * 0.12, 1.18 if fraction else 1.0, max(1.04, 1.12 + min(scripts, 3) * 0.08 if scripts else 0.0, 1.42 if tall else 0.0)


def inline_box(formula: str, size: float, line_height: float) -> tuple[float, float]:
    """Width and height of an inline formula, estimated from what it shows."""
    shape = box_shape(formula)
    if shape is None:
        return max(size * 0.8, 1.0), max(size * 1.05, 1.0)
    wide, by, high = shape
    return max(size * wide * by, size * 0.8), max(size * high, line_height * 0.92, size)


def _mapped(fn, kind: pa.DataType):
    def run(batches: Iterator) -> Iterator[pa.Array]:
        for batch in batches:
            columns = batch if isinstance(batch, tuple) else (batch,)
            yield pa.array([fn(*row) for row in zip(*(c.to_pylist() for c in columns))], kind)

    return run


@F.arrow_udf(S.StringType())
def sanitize_math(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from _mapped(sanitize, pa.string())(batches)


@F.arrow_udf(S.StringType())
def normalize_latex(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from _mapped(lambda t: normalize(t) if t else t, pa.string())(batches)


def likeness(a: str | None, b: str | None) -> float:
    """difflib's ratio over the first 2,500 characters of both."""
    return difflib.SequenceMatcher(None, (a or "")[:2500], (b or "")[:2500]).ratio()


@F.arrow_udf(S.DoubleType())
def similarity(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    yield from _mapped(likeness, pa.float64())(batches)
