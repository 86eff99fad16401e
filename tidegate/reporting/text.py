"""Numbers as text, strict templates, and the check that prose quotes only computed numbers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from string import Template

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNDEFINED = "n/a"


@dataclass(frozen=True)
class Style:
    """How one kind of number is written: a factor, what stands around it, and its usual digits."""

    factor: float = 1.0
    before: str = ""
    after: str = ""
    digits: int = 0
    grouped: bool = True

    def text(self, value, digits: int | None = None) -> str:
        if value is None:
            raise ValueError("a value is missing")
        digits = self.digits if digits is None else digits
        body = f"{abs(float(value)) * self.factor:{',' if self.grouped else ''}.{digits}f}"
        minus = "-" if float(value) < 0 and body.strip("0.,") else ""
        return f"{minus}{self.before}{body}{self.after}"

    def column(self, value: Column, digits: int | None = None) -> Column:
        """``text`` over a column; a missing value stays missing."""
        digits = self.digits if digits is None else digits
        size = F.abs(value) * self.factor
        body = F.format_number(size, digits) if self.grouped else F.format_string(f"%.{digits}f", size)
        minus = F.when((value < 0) & (F.regexp_replace(body, "[0.,]", "") != ""), "-").otherwise("")
        return F.concat(minus, F.lit(self.before), body, F.lit(self.after))


STYLES = {"usd": Style(before="$"), "pct": Style(100, after="%", digits=1, grouped=False), "num": Style(digits=3), "int": Style(), "pp": Style(100, after=" pp", digits=1, grouped=False)}


def shown(value, kind: str = "num", digits: int | None = None) -> str:
    """A number in one of the ``STYLES``."""
    return STYLES[kind].text(value, digits)


def shown_column(value: Column, kind: str = "num", digits: int | None = None) -> Column:
    return STYLES[kind].column(value, digits)


def shown_interval(row: dict, kind: str = "num", digits: int | None = None) -> str:
    """'point (95% CI low to high)'; undefined without a point or an interval."""
    values = [row.get(k) for k in ("point", "ci_low", "ci_high")]
    if None in values:
        return UNDEFINED
    style = STYLES[kind]
    digits = 4 if kind == "num" and digits is None else digits
    unit = style.after if kind == "pp" else ""
    point, low, high = (style.text(v, digits).removesuffix(unit) for v in values)
    return f"{point}{unit} (95% CI {low} to {high}{unit})"


def finding(row: dict) -> str:
    """What an interval says about a difference from zero."""
    if not row.get("n_boot_valid", 1) or row.get("ci_low") is None:
        return "undefined"
    if row["excludes_zero"]:
        return "interval excludes zero" if row["point"] > 0 else "interval excludes zero, in the unfavourable direction"
    return "interval includes zero"


def render(template: str, values: dict[str, str]) -> str:
    """$name placeholders; one without a value is an error."""
    return Template(template).substitute(values)


# What counts as a number in prose, and what is not prose.
NUMBER = r"(?<![\w.\-/])-?\$?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?%?(?![\w/])"
NOT_PROSE = [r"(?s)```.*?```", r"`[^`\n]*`", r"(?<=\])\([^)]*\)", r"(?s)<!--.*?-->", r"(?m)^\s*\d+\.\s"]


def number_tokens(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row per number quoted in the prose of each text: (token, value, digits)."""
    c = F.col(text)
    for pattern in NOT_PROSE:
        c = F.regexp_replace(c, pattern, " ")
    tok = texts.withColumn("token", F.explode(F.regexp_extract_all(c, F.lit(f"({NUMBER})"), F.lit(1))))
    core = F.regexp_replace("token", r"[$%,\-]", "")
    return tok.withColumns({"value": core.cast("double"), "digits": F.length(F.regexp_extract(core, r"\.(\d+)", 1))})


def unsupported_numbers(texts: DataFrame, leaves: DataFrame, text: str = "text") -> DataFrame:
    """Quoted numbers that no result equals, as it is or times 100, at the quoted digits.

    Results are rounded to each number of digits that occurs and meet the
    quoted numbers by equality, so the check is one join.
    """
    tok = number_tokens(texts, text)
    key = lambda v, d: F.round(v * F.pow(F.lit(10.0), d)).cast("long")
    digits = tok.select("digits").distinct()
    have = leaves.select(F.explode(F.array(F.abs("value"), F.abs("value") * 100)).alias("v")).join(F.broadcast(digits))
    have = have.select("digits", key(F.col("v"), F.col("digits")).alias("k")).distinct()
    return tok.withColumn("k", key(F.col("value"), F.col("digits"))).join(have, ["digits", "k"], "left_anti").drop("k")


def computed_numbers(results) -> Iterator[float]:
    """The numbers anywhere inside nested results, also those written as text; yes and no are none."""
    open_ = [results]
    while open_:
        item = open_.pop()
        if isinstance(item, dict):
            open_.extend(item.values())
        elif isinstance(item, (list, tuple)):
            open_.extend(item)
        elif isinstance(item, (int, float)) and not isinstance(item, bool):
            yield float(item)
        elif isinstance(item, str) and re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", item.strip()):
            yield float(item)
