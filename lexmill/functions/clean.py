"""The cleaner: order-dependent line rules, in Arrow batches."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx
from .text import tidy, unify_space

_NOISE = re.compile(rf"^\s*(?:{'|'.join(f'(?:{p})' for p in lx.NOISE_LINES)})\s*$", re.I)
_PROTECTED = re.compile(lx.PROTECTED_LINE, re.I)


def keep_lines(text: str, longest: int = 140, least: int = 8, share: int = 15, run: int = 2) -> str:
    """Stripped lines without noise, without those of at most `longest` characters that stand max(least, lines // share) times or more,
    and with at most `run` equal non-blank lines in a row; protected lines stay. Blank lines restart a run's count, not what it is counted against."""
    lines = [line.strip() for line in text.split("\n")]
    counts = Counter(line for line in lines if line and len(line) <= longest)
    limit = max(least, len(lines) // share)
    out, last, n = [], "", 0
    for line in lines:
        if not line:
            n = 0
            out.append(line)
            continue
        protected = bool(_PROTECTED.search(line))
        if not protected and (_NOISE.match(line) or counts.get(line, 0) >= limit):
            continue
        n = n + 1 if line == last else 1
        if n > run and not protected:
            continue
        last = line
        out.append(line)
    return "\n".join(out)


def clean(text: Column) -> Column:
    """Cleaned text; null stays null."""
    @F.pandas_udf("string")
    def kept(texts: pd.Series) -> pd.Series:
        return texts.map(keep_lines, na_action="ignore")

    return tidy(kept(unify_space(text)))
