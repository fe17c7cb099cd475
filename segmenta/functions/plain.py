"""Python forms of the normalisations, for constants on the driver and for tests."""

from __future__ import annotations

import re
import unicodedata

from . import lexicon, text


def normalise(s: str) -> str:
    s = re.sub(f"[{text.MARKS}]", "", unicodedata.normalize("NFC", s or ""))
    return " ".join(re.sub(f"[{text.PUNCTUATION}]", " ", s.translate(str.maketrans(text.VARIANTS, text.PLAIN))).split())


def canonical(s: str) -> str:
    return normalise((s or "").translate(str.maketrans(text.CROSS, text.CROSS_PLAIN)))


def formulas() -> dict[str, str]:
    """Canonical formulas and labels; of two with one canonical form the later label counts, at the earlier place."""
    return {canonical(k): v for k, v in lexicon.FORMULAS}


def spurious() -> list[str]:
    return sorted({normalise(p) for p in lexicon.SPURIOUS_PHRASES})


def spurious_queries() -> list[str]:
    return sorted({*spurious(), *(canonical(p) for p in spurious())})
