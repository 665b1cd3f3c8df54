"""Fallacy detection: a pluggable detector over batches of texts, and the rule-based one used offline."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a detector gives for a text: (type, segment, confidence) of each fallacy.
Detector = Callable[[str], list[tuple[str, str, float]]]
# Fixed values of the offline rules.
RULES = {
    "ad hominem": r"\b(?:idiot|stupid|liar|fool)\w*",
    "hasty generalization": r"\b(?:everyone|nobody|always|never)\b",
    "false dilemma": r"\beither\b.{1,80}?\bor\b",
    "appeal to authority": r"\bexperts? (?:say|agree)\b",
    "slippery slope": r"\bwill (?:inevitably )?lead to\b",
}


def by_rules(text: str) -> list[tuple[str, str, float]]:
    return [(kind, m.group(), 0.5) for kind, p in RULES.items() for m in re.finditer(p, text, re.I | re.S)]


def detect(contributions: DataFrame, detector: Detector = by_rules) -> DataFrame:
    """contribution, type, segment, confidence. Empty texts have none; a text at which the detector fails has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, text in zip(b["id"], b["text"], strict=True):
                if isinstance(text, str) and text.strip():
                    try:
                        rows += [(key, *x) for x in detector(text)]
                    except Exception:  # noqa: BLE001  one bad answer must not end the job
                        continue
            yield pd.DataFrame(rows, columns=["contribution", "type", "segment", "confidence"])

    return contributions.select(F.col("id").cast("string").alias("id"), "text").mapInPandas(run, "contribution string, type string, segment string, confidence double")
