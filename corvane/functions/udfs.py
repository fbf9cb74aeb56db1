"""The few text functions that built-in expressions can't state, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import json
import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType, StructField, StructType


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode composed form."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity without the popular-character rule."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def fragment_ratio(query: pd.Series, text: pd.Series) -> pd.Series:
    """The best ratio of a query with any part of the text of its length to two more."""

    def best(q: str | None, t: str | None) -> float:
        if not q or not t:
            return 0.0
        if q in t:
            return 1.0
        n = len(q)
        return max((SequenceMatcher(None, q, t[i : i + w], autojunk=False).ratio() for w in range(n, n + 3) for i in range(max(1, len(t) - w + 1))), default=0.0)

    return pd.Series([best(q, t) for q, t in zip(query, text)], dtype="float64")


def recursive_parts(text: str, size: int, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ")) -> list[str]:
    """Parts of at most ``size`` characters, cut at the coarsest separator that does; joined they give the text."""
    if len(text) <= size:
        return [text] if text else []
    for i, separator in enumerate(separators):
        if separator in text:
            pieces = re.split(f"(?<={re.escape(separator)})", text)
            out, held = [], ""
            for piece in pieces:
                if len(held) + len(piece) <= size:
                    held += piece
                    continue
                if held:
                    out.append(held)
                fits = len(piece) <= size
                held = piece if fits else ""
                if not fits:
                    out += recursive_parts(piece, size, separators[i + 1 :])
            return [*out, held] if held else out
    return [text[i : i + size] for i in range(0, len(text), size)]


def recursive_split(size: int, overlap: int = 0):
    """Column function: parts of a text, each led by the end of the one before."""

    @F.pandas_udf(ArrayType(StringType()))
    def split(text: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[str]:
            parts = recursive_parts(t or "", size - overlap)
            return [(parts[i - 1][-overlap:] if overlap and i else "") + p for i, p in enumerate(parts)]

        return text.map(one)

    return split


PRICES = StructType([StructField(n, t) for n, t in (("low", DoubleType()), ("high", DoubleType()), ("low_inclusive", BooleanType()), ("high_inclusive", BooleanType()))])
#: An amount with its unit; words of ranges, bounds and money; units of sizes, which are no money.
AMOUNT = r"฿?\s*(\d[\d,]*(?:\.\d+)?)\s*(k\b|เค|พัน|หมื่น)?\s*(?:บาท|฿|baht\b)?"
TIMES = {"k": 1000, "เค": 1000, "พัน": 1000, "หมื่น": 10_000}
SIZE = r"(?:นิ้ว|inch|inches|dpi|mah|hz|khz|mhz|ghz)"
#: Rules by precedence; a part of the text that one has claimed is read by none after it. Numbers without a word of price, a unit or a sign of
#: money are names of models. kind: range, or bounds (low or high) with whether they are inclusive.
PRICE_RULES = [
    ("range", None, rf"(?:\bbetween|\bfrom|ระหว่าง|ช่วง|ตั้งแต่)\s*{AMOUNT}\s*(?:-|\bto\b|\band\b|ถึง|จนถึง)\s*{AMOUNT}"),
    ("range", None, rf"(?:\bprice|\bbudget|ราคา|งบ)\s*{AMOUNT}\s*(?:-|\bto\b|ถึง|จนถึง)\s*{AMOUNT}"),
    ("range", None, rf"(?<!\S){AMOUNT}\s*-\s*{AMOUNT}(?!\S)(?!\s*{SIZE})"),
    ("range", None, r"฿?\s*(\d[\d,]*(?:\.\d+)?)\s*(k\b|เค|พัน|หมื่น)?\s*(?:บาท)?\s*(?:-|\bto\b|ถึง)\s*(\d[\d,]*(?:\.\d+)?)\s*(k\b|เค|พัน|หมื่น)?\s*(?:บาท|฿|baht\b)"),
    ("low", True, rf"(?:>=|=>|\bat least\b|\bminimum\b|\bfrom\b|อย่างน้อย|ขั้นต่ำ|ตั้งแต่|เริ่มต้น)\s*{AMOUNT}"),
    ("low", False, rf"(?:>|\bover\b|\babove\b|\bmore than\b|มากกว่า|แพงกว่า)\s*{AMOUNT}"),
    ("low", True, rf"{AMOUNT}\s*(?:\bor more\b|ขึ้นไป|หรือมากกว่า)"),
    ("high", True, rf"(?:<=|=<|\bat most\b|\bup to\b|\bmaximum\b|\bmax\b|\bbudget\b|ไม่เกิน|งบ)\s*{AMOUNT}"),
    ("high", False, rf"(?:<|\bunder\b|\bbelow\b|\bless than\b|ต่ำกว่า|ถูกกว่า)\s*{AMOUNT}"),
    ("high", True, rf"{AMOUNT}\s*(?:\bor less\b|ลงมา|หรือต่ำกว่า)"),
    ("money", True, r"(\d[\d,]*(?:\.\d+)?)\s*(k\b|เค|พัน|หมื่น)?\s*(?:บาท|฿|baht\b)"),
]
PRICE_RULES = [(kind, inclusive, re.compile(pattern, re.I)) for kind, inclusive, pattern in PRICE_RULES]
SIZED = re.compile(rf"(?:^|\s){SIZE}\s*$", re.I)


def price_bounds(text: str | None) -> tuple:
    """low, high and whether each is inclusive. A range counts both ends in; a lone sum of money is the most that may be paid."""
    return claimed_prices(text)[:4]


def claimed_prices(text: str | None) -> tuple:
    """As ``price_bounds``, and the text with what the rules claimed as spaces."""
    low = high = low_in = high_in = None

    def value(digits: str, unit: str | None) -> float:
        return float(digits.replace(",", "")) * TIMES.get((unit or "").lower(), 1)

    text = text or ""
    for kind, inclusive, pattern in PRICE_RULES:
        if kind == "range" and high is not None or kind == "money" and high is not None:
            continue
        at = 0
        while m := pattern.search(text, at):
            at = m.end()
            if kind == "range" and SIZED.search(text[: m.start()]):
                continue
            if kind == "range":
                # "1-2k" shares its unit, "1,000-2k" doesn't
                shared = m[2] or (m[4] if value(m[1], None) <= value(m[3], None) else None)
                a, b = value(m[1], shared), value(m[3], m[4])
                low, high, low_in, high_in = min(a, b), max(a, b), True, True
            elif kind == "low" and low is None:
                low, low_in = value(m[1], m[2]), inclusive
            elif kind in ("high", "money") and high is None:
                high, high_in = value(m[1], m[2]), inclusive
            else:
                continue
            text = text[: m.start()] + "\u0000" * (m.end() - m.start()) + text[m.end() :]
            if kind in ("range", "money"):
                break
    return low, high, low_in, high_in, text.replace("\u0000", " ")


@F.pandas_udf(PRICES)
def price_range(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([price_bounds(t) for t in text], columns=["low", "high", "low_inclusive", "high_inclusive"])


@F.pandas_udf(StructType([*PRICES.fields, StructField("rest", StringType())]))
def price_claims(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([claimed_prices(t) for t in text], columns=["low", "high", "low_inclusive", "high_inclusive", "rest"])


@F.pandas_udf(StringType())
def source_quote(quote: pd.Series, text: pd.Series) -> pd.Series:
    """The part of a text that equals a quote but for white space; null if there is none."""

    def find(q: str | None, t: str | None) -> str | None:
        letters = [re.escape(c) for c in q or "" if not c.isspace()]
        m = re.search(r"\s*".join(letters), t or "") if letters else None
        return m[0] if m else None

    return pd.Series([find(q, t) for q, t in zip(quote, text)], dtype="object")


@F.pandas_udf(ArrayType(StringType()))
def rich_text(value: pd.Series) -> pd.Series:
    """Texts of a nested JSON document, in order."""

    def parts(node: object) -> list[str]:
        if isinstance(node, dict):
            own = [node["value"]] if isinstance(node.get("value"), str) and node["value"].strip() else []
            return own + [x for v in (node.get("content") or []) for x in parts(v)]
        return [x for v in node for x in parts(v)] if isinstance(node, list) else []

    def one(v: str | None) -> list[str]:
        try:
            return parts(json.loads(v)) if v else []
        except ValueError:
            return []

    return value.map(one)


def soft_parts(text: str | None, limit: int, share: float = 0.6) -> list[str]:
    """Parts of at most ``limit`` characters that end at a line feed if there is one in the last part of the limit."""
    out, rest = [], (text or "").strip()
    while len(rest) > limit:
        at = rest.rfind("\n", 0, limit)
        at = at if at >= limit * share else limit
        out.append(rest[:at].rstrip())
        rest = rest[at:].lstrip()
    return [*out, rest] if rest else out
