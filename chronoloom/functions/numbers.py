"""Number words."""

from __future__ import annotations

import re

SMALL = {w: k for k, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
TENS = {w: 10 * k for k, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
LARGE = {"hundred": 100, "thousand": 1000, "million": 10**6, "billion": 10**9, "trillion": 10**12}
ORDINAL = {w: k for k, w in enumerate("first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth".split(), 1)} | {"twentieth": 20, "thirtieth": 30, "fortieth": 40, "fiftieth": 50, "sixtieth": 60, "seventieth": 70, "eightieth": 80, "ninetieth": 90, "hundredth": 100, "thousandth": 1000}
WORD = "(?:" + "|".join(sorted([*SMALL, *TENS, *LARGE], key=len, reverse=True)) + ")"
PHRASE = rf"(?:\d[\d,]*(?:\.\d+)?|an?|{WORD}(?:[- ](?:and )?{WORD})*)"


def value(text: str) -> int | float | None:
    """The number that words or digits stand for; None if they don't."""
    t = text.lower().replace(",", "").strip()
    if re.fullmatch(r"\d+", t):
        return int(t)
    if re.fullmatch(r"\d+\.\d+", t):
        return float(t)
    if m := re.fullmatch(r"(\d+)(?:st|nd|rd|th)", t):
        return int(m[1])
    if t in ("a", "an"):
        return 1
    total, part, seen = 0, 0, False
    for w in re.split(r"[\s-]+", t):
        if w in ("and", "a", "an"):
            continue
        if w in SMALL or w in TENS or w in ORDINAL:
            part += SMALL.get(w, TENS.get(w, ORDINAL.get(w, 0)))
        elif w == "hundred":
            part = max(part, 1) * 100
        elif w in LARGE:
            total, part = total + max(part, 1) * LARGE[w], 0
        else:
            return None
        seen = True
    return total + part if seen else None
