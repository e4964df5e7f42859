"""Rules written as sentences, compiled to conditions that Spark pushes to the scan, and evaluated together in one pass."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What number words multiply by.
UNITS = {"ribu": 1e3, "ratus": 1e2, "juta": 1e6, "miliar": 1e9, "milyar": 1e9, "triliun": 1e12}
#: Patterns of amounts, shares and plain numbers, and of thresholds and rates.
DIGITS = r"([\d.,]+)"
SHARE = rf"{DIGITS}\s*(?:persen|%)"
MONEY = rf"rp\s*{DIGITS}\s*(juta|miliar|milyar|triliun)?"
AMOUNT = rf"{DIGITS}\s*(juta|miliar|milyar|triliun|ribu|ratus)"
VALUE = r"([\d.,]+\s*(?:juta|miliar|milyar|triliun|ribu)?)"
THRESHOLDS = (
    (rf"penghasilan\s+(?:di atas|lebih dari|>\s*)\s*{VALUE}", ">"),
    (rf"pkp\s+(?:di atas|lebih dari|>\s*)\s*{VALUE}", ">"),
    (rf"di atas\s+{VALUE}", ">"),
    (rf"di bawah\s+{VALUE}", "<"),
)
RATES = (r"tarif\s+([\d.,]+)\s*(?:persen|%)", r"dikenakan\s+.*?([\d.,]+)\s*(?:persen|%)")


def _digits(text: str) -> float | None:
    """Points group thousands, a comma is the decimal point."""
    try:
        return float(text.replace(".", "").replace(",", "."))
    except ValueError:
        return None


def extract_number(text: str) -> float | None:
    """The number of a text: a share (by a hundred), else money, else an amount with a unit, else the first digits."""
    for pattern, divide in ((SHARE, 100.0), (MONEY, 1.0), (AMOUNT, 1.0), (DIGITS, 1.0)):
        found = re.search(pattern, text, re.IGNORECASE)
        if found and (value := _digits(found[1])) is not None:
            unit = (found[2] or "").lower() if found.re.groups > 1 else ""
            return value / divide * UNITS.get(unit, 1)
    return None


def parse_condition(text: str) -> tuple[str, float] | None:
    """Comparison and threshold of an antecedent: after a phrase that says which, else above its greatest amount; None if it has neither, which always holds."""
    for pattern, sign in THRESHOLDS:
        found = re.search(pattern, text, re.IGNORECASE)
        if found and (value := extract_number(found[1].strip())) is not None:
            return sign, value
    amounts = [v * UNITS.get((unit or "").lower(), 1) for pattern in (MONEY, AMOUNT) for digits, unit in re.findall(pattern, text, re.IGNORECASE) if (v := _digits(digits)) is not None]
    return (">", max(amounts)) if amounts else None


def parse_consequence(text: str) -> float | None:
    """The rate that a consequent sets, as a share."""
    for pattern in RATES:
        if found := re.search(pattern, text, re.IGNORECASE):
            try:
                return float(found[1].replace(",", ".")) / 100
            except ValueError:
                return None
    return None


@dataclass(frozen=True)
class Rule:
    name: str
    antecedent: str
    consequent: str = ""

    def condition(self, value: Column) -> Column:
        parsed = parse_condition(self.antecedent)
        if parsed is None:
            return F.lit(True)
        return value > parsed[1] if parsed[0] == ">" else value < parsed[1]


def evaluate(rows: DataFrame, key: list[str], value: str, rules: list[Rule]) -> DataFrame:
    """key, rule, value, rate and charge: the rules whose condition a row's value meets, and what their rate makes of it.

    All rules are told in one pass. Rows that meet none are left out by one condition on the value, which reaches the scan.
    """
    v = F.col(value)
    met = F.lit(False)
    for rule in rules:
        met = met | rule.condition(v)
    told = [F.when(rule.condition(v), F.struct(F.lit(rule.name).alias("rule"), F.lit(parse_consequence(rule.consequent)).cast("double").alias("rate"))) for rule in rules]
    flat = rows.where(met).select(*key, v.alias("value"), F.inline(F.array_compact(F.array(*told))))
    return flat.withColumn("charge", F.round(F.col("value") * F.col("rate"), 4))
