"""Time expressions of a text: where they are, their type and their value relative to a reference date.

An ordered table of patterns is matched over the text; a place that an earlier or
longer expression holds is not tagged again. Values are partial dates (`1998`,
`199801`, `19980108T1430`, `1998W02`, `1998SU`, `199`, `PXX`...): strings, not dates.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date, timedelta
from functools import lru_cache

from .numbers import ORDINAL, PHRASE, value

MONTHS = {m: k for k, m in enumerate("january february march april may june july august september october november december".split(), 1)}
SHORT = {m[:3]: k for m, k in MONTHS.items()} | {"sept": 9}
DAYS = {d: k for k, d in enumerate("sunday monday tuesday wednesday thursday friday saturday".split())}
SEASONS = {"spring": "SP", "summer": "SU", "fall": "FA", "autumn": "FA", "winter": "WI"}
PARTS = {"morning": "TMO", "afternoon": "TAF", "evening": "TEV", "night": "TNI"}
FIXED = {"christmas": (12, 25), "christmas eve": (12, 24), "new year's day": (1, 1), "new year's eve": (12, 31), "halloween": (10, 31), "independence day": (7, 4), "valentine's day": (2, 14), "st. patrick's day": (3, 17), "april fool's day": (4, 1), "veterans day": (11, 11), "boxing day": (12, 26), "may day": (5, 1)}
FLOATING = {"thanksgiving": (11, 4, 4), "labor day": (9, 1, 1), "memorial day": (5, 1, -1), "mother's day": (5, 0, 2), "father's day": (6, 0, 3), "columbus day": (10, 1, 2), "presidents day": (2, 1, 3), "martin luther king day": (1, 1, 3)}
UNITS = "second|minute|hour|day|week|fortnight|month|quarter|year|decade|century|centurie"
LETTER = {"second": "S", "minute": "M", "hour": "H", "day": "D", "week": "W", "fortnight": "F", "month": "M", "quarter": "Q", "year": "Y", "decade": "E", "century": "C"}
_MONTH = r"(?:january|february|march|april|may|june|july|august|september|october|november|december|(?:jan|feb|mar|apr|jun|jul|aug|sept?|oct|nov|dec)\b\.?)"
_DAY = "(?:sunday|monday|tuesday|wednesday|thursday|friday|saturday)"
_SEASON = "(?:spring|summer|fall|autumn|winter)"
_PART = "(?:morning|afternoon|evening|night)"
_ORD = r"(?:\d{1,2}(?:st|nd|rd|th)|" + "|".join(sorted((k for k, v in ORDINAL.items() if v < 32), key=len, reverse=True)) + ")"
_YEAR = r"(?:1[6-9]\d\d|20\d\d)"
_HOLIDAY = "(?:" + "|".join(sorted(map(re.escape, [*FIXED, *FLOATING, "easter", "good friday"]), key=len, reverse=True)) + ")"
_UNIT = f"(?:{UNITS})s?"


@dataclass
class Timex:
    begin: int
    end: int
    text: str
    type: str
    value: str | None
    attrs: dict[str, str] = field(default_factory=dict)


def _unit(word: str) -> str:
    w = word.lower().rstrip("s") if not word.lower().endswith("centuries") else "century"
    return {"centurie": "century", "centur": "century"}.get(w, w)


def month_length(y: int, m: int) -> int:
    return (date(y + m // 12, m % 12 + 1, 1) - timedelta(1)).day


def week_value(d: date) -> str:
    y, w, _ = d.isocalendar()
    return f"{d.year}W53" if y > d.year else f"{y}W{w:02d}"


def easter(y: int) -> date:
    a, b, c = y % 19, y // 100, y % 100
    h = (19 * a + b - b // 4 - (8 * b + 13) // 25 + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    m = (a + 11 * h + 19 * k) // 433
    n = h + k - 7 * m
    month = (n + 90) // 25
    return date(y, month, (n + 33 * month + 19) % 32)


def holiday(name: str, y: int) -> date:
    if name in FIXED:
        return date(y, *FIXED[name])
    if name in ("easter", "good friday"):
        return easter(y) - timedelta(2 * (name != "easter"))
    m, dow, n = FLOATING[name]
    if n > 0:
        first = date(y, m, 1)
        return first + timedelta((dow - first.isoweekday()) % 7 + 7 * (n - 1))
    last = date(y, m, month_length(y, m))
    return last - timedelta((last.isoweekday() - dow) % 7)


def _shift(ref: date, n: int, unit: str) -> str:
    """The value n units from the reference, as fine as the unit."""
    if unit == "day":
        return (ref + timedelta(n)).strftime("%Y%m%d")
    if unit in ("week", "fortnight"):
        return week_value(ref + timedelta(7 * n * (1 + (unit == "fortnight"))))
    if unit in ("month", "quarter"):
        k = ref.year * 12 + ref.month - 1 + n * (3 if unit == "quarter" else 1)
        return f"{k // 12}Q{k % 12 // 3 + 1}" if unit == "quarter" else f"{k // 12}{k % 12 + 1:02d}"
    if unit == "decade":
        return str(ref.year // 10 + n)
    if unit == "century":
        return str(ref.year // 100 + n)
    return f"{ref.year + n:04d}"


def _duration(n: float | int | None, unit: str) -> str:
    letter, times = LETTER[unit], 1
    letter, times = {"W": ("D", 7), "F": ("D", 14), "E": ("Y", 10), "C": ("Y", 100), "Q": ("M", 3)}.get(letter, (letter, 1))
    if letter == "D" and unit == "day":
        times = 1
    number = "X" if n is None else f"{n * times:g}"
    return f"P{'T' if unit in ('second', 'minute', 'hour') else ''}{number}{letter}"


def _year_near(month: int, ref: date, way: str | None) -> int:
    """The year of a bare month: the nearest one, or that before or after the reference."""
    if way == "past":
        return ref.year if month <= ref.month else ref.year - 1
    if way == "future":
        return ref.year if month >= ref.month else ref.year + 1
    gap = month - ref.month
    return ref.year - 1 if gap >= 11 else ref.year + 1 if gap <= -11 else ref.year


def _day_near(dow: int, ref: date, way: str | None) -> date:
    ahead = (dow - ref.isoweekday() % 7) % 7
    if way == "future":
        return ref + timedelta(ahead or 7)
    if way == "past":
        return ref - timedelta((-ahead) % 7 or 7)
    return ref + timedelta(ahead if ahead <= 3 else ahead - 7)


_RULES: list[tuple[str, str, re.Pattern]] = []


def _rule(name: str, kind: str, pattern: str) -> None:
    """A pattern over a text in small letters, which may begin with the letters that it can begin with, as that is soon decided; that of isotime is over the text as it is."""
    _RULES.append((name, kind, re.compile(rf"(?<![\w]){pattern}(?![\w])")))


_rule("iso", "DATE", rf"(?P<y>{_YEAR})-(?P<m>\d\d)-(?P<d>\d\d)(?:[t ](?P<h>\d\d):?(?P<n>\d\d)(?::?\d\d)?)?")
_rule("iso8", "DATE", rf"(?P<y>{_YEAR})(?P<m>0[1-9]|1[0-2])(?P<d>[0-3]\d)")
_rule("isotime", "TIME", r"T(?P<h>\d\d):?(?P<n>\d\d)")
_rule("slash", "DATE", r"(?P<a>\d{1,2})/(?P<b>\d{1,2})/(?P<y>\d{4}|\d{2})")
_rule("euro", "DATE", r"(?P<b>\d{1,2})\.(?P<a>\d{1,2})\.(?P<y>\d{4}|\d{2})")
_rule("span", "DURATION", rf"(?P<y>{_YEAR})-to-(?P<z>{_YEAR})")
_rule("weekof", "DATE", rf"(?:the )?week(?:end)? of (?P<month>{_MONTH}) (?P<d>\d{{1,2}})(?:, (?P<y>\d{{4}}))?")
_rule("dated", "DATE", rf"(?=[adfjmnostw])(?:{_DAY},? )?(?P<month>{_MONTH}) (?P<d>{_ORD}|\d{{1,2}})(?!\d)(?:,? (?P<y>{_YEAR}))?")
_rule("daymonth", "DATE", rf"(?=[efnst\d])(?:the )?(?P<d>{_ORD}|\d{{1,2}})(?: day)?(?: of)? (?P<month>{_MONTH})(?:,? (?P<y>{_YEAR}))?")
_rule("monthyear", "DATE", rf"(?=[adefjlmnos])(?:(?P<mod>early|late|mid)[ -])?(?P<month>{_MONTH}),?(?: of)? (?P<y>{_YEAR})")
_rule("ides", "DATE", rf"(?:the )?(?P<k>ides|nones) of (?P<month>{_MONTH})")
_rule("holiday", "DATE", rf"(?P<hol>{_HOLIDAY})(?:,? (?P<y>{_YEAR}))?")
_rule("seasonyear", "DATE", rf"(?:the )?(?P<season>{_SEASON})(?: of)? (?P<y>{_YEAR})")
_rule("quarter", "DATE", rf"(?:the )?(?P<q>first|second|third|fourth) quarter(?:(?: of)? (?P<y>{_YEAR}))?")
_rule("clock", "TIME", r"(?P<h>\d{1,2})(?::(?P<n>\d\d))?\s?(?P<ap>[ap])\.?m\.?")
_rule("clock24", "TIME", r"(?P<h>[01]?\d|2[0-3])[:h](?P<n>[0-5]\d)(?: (?P<z>gmt|utc|zulu|est|edt|cst|pst))?")
_rule("hours", "TIME", r"(?P<h>[0-2]\d)(?P<n>[0-5]\d) (?:hours|hrs)")
_rule("past", "TIME", rf"(?P<c>{PHRASE}|half|quarter)(?: minutes?)? (?P<side>past|to|after|before) (?P<hw>{PHRASE})(?: o'clock)?(?P<need> (?:in the (?:morning|afternoon|evening)|o'clock|[ap]\.m\.))")
_rule("oclock", "TIME", rf"(?P<hw>{PHRASE}) o'clock(?: in the (?P<part>morning|afternoon|evening))?")
_rule("noon", "TIME", r"(?P<w>noon|midnight|midday)")
_rule("relday2", "DATE", r"the day (?P<w>before yesterday|after tomorrow)")
_rule("relday", "DATE", rf"(?P<w>yesterday|today|tomorrow|tonight|tonite)(?: (?P<part>{_PART}))?")
_rule("thispart", "DATE", rf"(?P<which>this|last|early this|late this) (?P<part>{_PART})")
_rule("ago", "DATE", rf"(?:(?P<vague>about|some|a few|several|a couple of|many)\s)?(?:(?P<exact>exactly) )?(?:(?P<c>{PHRASE})\s)?(?P<u>{_UNIT})\s(?P<side>ago|hence|from now|from today|earlier|later)")
_rule("beforelast", "DATE", rf"(?:the )?(?P<u>day|week|month|year|weekend) (?P<side>before last|after next)")
_rule("dowrel", "DATE", rf"(?P<side>next|last|this|coming|this coming|this past) (?P<dow>{_DAY})(?: (?P<part>{_PART}))?")
_rule("every", "SET", rf"(?P<q>each|every|alternate) (?:(?P<ord>other|second|third) )?(?P<w>{_DAY}|{_UNIT}|{_MONTH}|{_SEASON}|{_PART})")
_rule("adverb", "SET", r"(?P<w>hourly|daily|nightly|weekly|monthly|quarterly|yearly|annually)")
_rule("relmonth", "DATE", rf"(?P<side>next|last|this|coming) (?P<month>{_MONTH})")
_rule("lastn", "DURATION", rf"the (?P<side>past|last|next|previous|coming|first|final|initial) (?P<c>{PHRASE}|few|couple of|several) (?P<u>{_UNIT})")
_rule("relunit", "DATE", rf"(?:the )?(?P<side>next|last|this|coming|previous|past|following|same) (?P<u>week|month|quarter|year|decade|century|fortnight)")
_rule("relweekend", "DATE", rf"(?P<side>next|last|this|coming) weekend")
_rule("relseason", "DATE", rf"(?P<side>next|last|this|coming) (?P<season>{_SEASON})")
_rule("dow", "DATE", rf"(?P<dow>{_DAY})(?: (?P<part>{_PART}))?")
_rule("hyphen", "DURATION", rf"(?P<c>{PHRASE})-(?P<u>{UNITS})(?:-old)?")
_rule("bound", "DURATION", rf"(?P<mod>more than|no more than|less than|at least|about|nearly|almost) (?P<c>{PHRASE}) (?P<u>{_UNIT})")
_rule("another", "DURATION", rf"another (?:(?P<c>{PHRASE}|few) )?(?P<u>{_UNIT})")
_rule("straight", "DURATION", rf"the (?P<o>{_ORD}) (?:straight|consecutive) (?P<u>day|week|month|quarter|year)(?: in a row)?")
_rule("few", "DURATION", rf"a (?:few|couple(?: of)?) (?P<u>{_UNIT})|several (?P<u2>{_UNIT})")
_rule("count", "DURATION", rf"(?=[abefhmnostz\d])(?P<c>{PHRASE}) (?P<u>{_UNIT})")
_rule("decade", "DATE", r"(?:the )?(?:early |late |mid-)?(?:(?P<y>1[6-9]\d|20\d)0s|'(?P<s>\d)0s|(?P<w>twenties|thirties|forties|fifties|sixties|seventies|eighties|nineties))")
_rule("century", "DATE", rf"(?:the )?(?P<o>\d{{1,2}}(?:st|nd|rd|th)|{_ORD}) century")
_rule("apos", "DATE", r"(?<!\w)'(?P<s>\d\d)")
_rule("ref", "DATE", r"(?P<w>the future|the past|currently|now|nowadays|once upon a time|formerly|medieval)")
_rule("month", "DATE", rf"(?=[adefjlmnos])(?:(?P<mod>early|late|mid)[ -])?(?P<month>{_MONTH})")
_rule("season", "DATE", rf"(?:the |in )?(?P<season>{_SEASON})")
_rule("year", "DATE", rf"(?=[elm\d])(?:(?P<mod>mid|early|late)[- ])?(?P<y>{_YEAR})(?! (?:daylight|standard) time)")


def _month(word: str) -> int:
    w = word.lower().rstrip(".")
    return MONTHS.get(w) or SHORT[w[:4] if w[:4] == "sept" and w != "september" else w[:3]]


def _direction(text: str, begin: int, end: int) -> str | None:
    """Whether the nearest verb (left in the sentence, else right) speaks of the past or the future."""
    left = max(text.rfind(c, 0, begin) for c in ".?!") + 1
    stop = _STOP.search(text, end)
    before, behind = text[left:begin], text[end : stop.start() if stop else len(text)]
    return (_verbs_say if len(before) + len(behind) > 200 else _verbs_say_short)(before, behind)


_STOP = re.compile("[.?!]")


def _verbs_say(before: str, behind: str) -> str | None:
    from .english import tag, tokenize

    if re.search(r"\bsince\W*$", before, re.I):
        return "past"
    if re.search(r"\buntil\W*$", before, re.I):
        return "future"
    for part, nearest in ((before, -1), (behind, 0)):
        found = []
        tokens = tag(tokenize(part))
        for k, t in enumerate(tokens):
            word = t.text.lower()
            if t.pos == "VBD":
                found.append("past")
            elif word in ("will", "'ll", "shall") or (word == "going" and tokens[k + 1 : k + 2] and tokens[k + 1].pos == "TO"):
                found.append("future")
            elif t.pos == "MD":
                found.append("past" if any(x.lemma == "have" for x in tokens[k + 1 : k + 3]) else "future")
        if found:
            return found[nearest]
    return None


_verbs_say_short = lru_cache(1 << 12)(_verbs_say)


def _resolve(name: str, m: re.Match, ref: date, way) -> tuple[str | None, dict[str, str]]:  # noqa: ANN001, C901, PLR0911, PLR0912
    g = {k: v for k, v in m.groupdict().items() if v}
    low = {k: v.lower() for k, v in g.items()}
    mod = {"early": "EARLY", "late": "LATE", "mid": "MID", "more than": "MORE_THAN", "no more than": "EQUAL_OR_LESS", "less than": "LESS_THAN", "at least": "EQUAL_OR_MORE", "about": "APPROX", "nearly": "APPROX", "almost": "APPROX"}.get(low.get("mod", ""))
    attrs = {"MOD": mod} if mod else {}
    ymd = lambda y, mo, d: date(y, mo, d).strftime("%Y%m%d")
    part = PARTS.get(low.get("part", ""), "")
    if name in ("iso", "iso8"):
        return ymd(int(g["y"]), int(g["m"]), int(g["d"])) + (f"T{g['h']}{g['n']}" if "h" in g else ""), attrs
    if name == "isotime":
        return f"T{g['h']}{g['n']}", attrs
    if name in ("slash", "euro"):
        a, b, y = int(g["a"]), int(g["b"]), int(g["y"])
        y += 0 if len(g["y"]) == 4 else 2000 if y < 39 else 1900
        return ymd(y, *((b, a) if a > 12 else (a, b))), attrs
    if name == "span":
        return f"P{int(g['z']) - int(g['y'])}Y", attrs | {"beginPoint": g["y"], "endPoint": g["z"]}
    if name in ("dated", "daymonth", "weekof"):
        mo, d = _month(g["month"]), int(value(g["d"]) or 0)
        y = int(g["y"]) if "y" in g else _year_near(mo, ref, way())
        return (week_value(date(y, mo, d)) if name == "weekof" else ymd(y, mo, d)), attrs
    if name == "ides":
        mo = _month(g["month"])
        long = mo in (3, 5, 7, 10)
        return ymd(_year_near(mo, ref, way()), mo, (15 if long else 13) - (8 if low["k"] == "nones" else 0)), attrs
    if name == "monthyear":
        return f"{g['y']}{_month(g['month']):02d}", attrs
    if name == "month":
        mo = _month(g["month"])
        return f"{_year_near(mo, ref, way())}{mo:02d}", attrs
    if name == "holiday":
        return holiday(low["hol"], int(g.get("y", ref.year))).strftime("%Y%m%d"), attrs
    if name == "seasonyear":
        return g["y"] + SEASONS[low["season"]], attrs
    if name == "quarter":
        return f"{g.get('y', ref.year)}Q{ORDINAL[low['q']]}", attrs
    if name == "clock":
        h = int(g["h"]) % 12 + 12 * (low["ap"] == "p")
        return f"{ref:%Y%m%d}T{h:02d}{g.get('n', '00')}" if int(g["h"]) <= 12 else None, attrs
    if name in ("clock24", "hours"):
        zone = {"gmt": "Z", "utc": "Z", "zulu": "Z"}.get(low.get("z", ""), "")
        return f"{ref:%Y%m%d}T{int(g['h']):02d}{g['n']}{zone}", attrs
    if name == "past":
        c = {"half": 30, "quarter": 15}.get(low["c"]) or value(g["c"])
        h = value(g["hw"])
        if c is None or h is None or not 0 < h <= 12:
            return None, attrs
        total = (int(h) * 60 + (c if low["side"] in ("past", "after") else -c) + (720 if "afternoon" in low["need"] or "evening" in low["need"] or "p.m" in low["need"] else 0)) % 1440
        return f"{ref:%Y%m%d}T{int(total) // 60:02d}{int(total) % 60:02d}", attrs
    if name == "oclock":
        h = value(g["hw"])
        if h is None or not 0 < h <= 24:
            return None, attrs
        return f"{ref:%Y%m%d}T{int(h) + 12 * (low.get('part') in ('afternoon', 'evening') and h < 12):02d}", attrs
    if name == "noon":
        return f"{ref:%Y%m%d}T{'24' if low['w'] == 'midnight' else '12'}00", attrs
    if name == "relday2":
        return _shift(ref, -2 if low["w"] == "before yesterday" else 2, "day"), attrs
    if name == "relday":
        n = {"yesterday": -1, "tomorrow": 1}.get(low["w"], 0)
        return _shift(ref, n, "day") + (part or ("TNI" if low["w"] in ("tonight", "tonite") else "")), attrs
    if name == "thispart":
        return _shift(ref, -1 if low["which"] == "last" else 0, "day") + part, attrs
    if name == "ago":
        sign = -1 if low["side"] in ("ago", "earlier") else 1
        n = value(g["c"]) if "c" in g else None
        u = _unit(g["u"])
        if n is None:
            return "PAST_REF" if sign < 0 else "FUTURE_REF", attrs
        if u in ("second", "minute", "hour"):
            return f"{ref:%Y%m%d}", attrs
        if "exact" in g and u in ("week", "fortnight"):
            return _shift(ref, sign * int(n) * (7 if u == "week" else 14), "day"), attrs
        return _shift(ref, sign * int(n), u), attrs | ({"MOD": "APPROX"} if "vague" in g else {})
    if name == "beforelast":
        n = -2 if low["side"] == "before last" else 2
        return (week_value(ref + timedelta(7 * n)) + "WE" if low["u"] == "weekend" else _shift(ref, n, low["u"])), attrs
    if name in ("dowrel", "dow"):
        dow = DAYS[low["dow"]]
        side = low.get("side", "")
        w = "future" if side in ("next", "coming", "this coming") else "past" if side in ("last", "this past") else way() if name == "dow" else None
        return _day_near(dow, ref, w).strftime("%Y%m%d") + part, attrs
    if name == "every":
        w = low["w"]
        if w in DAYS:
            return f"XXXXWXX-{DAYS[w] or 7}", attrs | {"SET": "YES"}
        u = _unit(w)
        if u in LETTER:
            return None, attrs | {"SET": "YES", "PERIODICITY": {"decade": "F1E", "century": "F1C"}.get(u, "F" + str({"other": 2, "second": 2, "third": 3}.get(low.get("ord", ""), 1)) + LETTER[u])}
        return None, attrs | {"SET": "YES", "PERIODICITY": "F1D" if w in PARTS else "F1Y"}
    if name == "adverb":
        unit = {"hourly": "H", "daily": "D", "nightly": "D", "weekly": "W", "monthly": "M", "quarterly": "Q", "yearly": "Y", "annually": "Y"}[low["w"]]
        return None, attrs | {"SET": "YES", "PERIODICITY": "F1" + unit}
    if name == "relmonth":
        mo = _month(g["month"])
        y = ref.year + (1 if low["side"] in ("next", "coming") and mo <= ref.month else -1 if low["side"] == "last" and mo >= ref.month else 0)
        return f"{y}{mo:02d}", attrs
    if name == "lastn":
        n = None if low["c"] in ("few", "several") or low["c"].startswith("couple") else value(g["c"])
        u = _unit(g["u"])
        out = _duration(n, u)
        if low["side"] in ("past", "last", "previous"):
            attrs = attrs | {"endPoint": f"{ref:%Y%m%d}"}
        elif low["side"] in ("next", "coming"):
            attrs = attrs | {"beginPoint": f"{ref:%Y%m%d}"}
        return out, attrs
    if name == "relunit":
        n = {"next": 1, "coming": 1, "following": 1, "this": 0, "same": 0}.get(low["side"], -1)
        return _shift(ref, n, low["u"]), attrs
    if name == "relweekend":
        n = {"next": 1, "coming": 1, "last": -1}.get(low["side"], 0)
        return week_value(ref + timedelta(7 * n)) + "WE", attrs
    if name == "relseason":
        n = {"next": 1, "coming": 1, "last": -1}.get(low["side"], 0)
        return f"{ref.year + n}{SEASONS[low['season']]}", attrs
    if name == "season":
        return f"{ref.year}{SEASONS[low['season']]}", attrs
    if name in ("hyphen", "bound", "count"):
        n = value(g["c"])
        return (_duration(n, _unit(g["u"])) if n is not None else None), attrs
    if name == "another":
        return _duration(None if low.get("c") == "few" else value(g["c"]) if "c" in g else 1, _unit(g["u"])), attrs
    if name == "straight":
        return _duration(value(low["o"]), _unit(g["u"])), attrs
    if name == "few":
        return _duration(None, _unit(g.get("u") or g["u2"])), attrs
    if name == "decade":
        if "y" in g:
            return g["y"], attrs
        return f"19{g['s']}" if "s" in g else f"19{'twenties thirties forties fifties sixties seventies eighties nineties'.split().index(low['w']) + 2}", attrs
    if name == "century":
        n = value(low["o"])
        return (f"{int(n) - 1:02d}" if n else None), attrs
    if name == "apos":
        s = int(g["s"])
        return str(s + (2000 if s < 39 else 1900)), attrs
    if name == "ref":
        return {"the future": "FUTURE_REF", "now": "PRESENT_REF", "currently": "PRESENT_REF", "nowadays": "PRESENT_REF"}.get(low["w"], "PAST_REF"), attrs
    return g["y"], attrs


_ANY = re.compile("|".join(["\\d", *MONTHS, *DAYS, *SEASONS, *PARTS, "day", "morrow", "ly\\b", "second", "minute", "hour", "week", "month", "quarter", "year", "decade", "centur", "noon", "midnight", "now", "future", "past", "current", "christmas", "easter", "thanksgiving", "eve\\b", "halloween", "tonite", "medieval", "once", "formerly", "o'clock", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "oct", "nov", "dec", "ties"]))
_LOWER_MONTHS = re.compile(r"^(may|march|mar|august)$")
_AFTER_COUNT = re.compile(r"\s+(?:since|after|following|later|earlier|before|prior to)\b", re.I)


_DAY_NAMES, _SEASON_NAMES, _PART_NAMES, _HOLIDAY_NAMES = tuple(DAYS), tuple(SEASONS), tuple(PARTS), (*FIXED, *FLOATING, "easter", "good friday")
_MONTH_CUES, _UNIT_CUES, _SIDE_CUES = tuple(m[:3] for m in MONTHS), tuple(UNITS.split("|")[:10]) + ("centur",), ("next", "last", "this", "coming", "previous", "past", "following", "same")
_DIGITS, _TIMES, _DOTTED = re.compile(r"\d+"), re.compile(r"\d[:h]\d"), re.compile(r"\d\.\d")
#: Letters beyond ASCII that patterns take for ASCII ones when case doesn't count, and that are no part of any: the sign in their place is none either.
_ODD_CASE = str.maketrans("\u017f\u0131\u0130\u212a", "\xdf" * 4)
#: For the rules, what a text must hold for one to fit: a name from _GROUPS or of a look at its digits, or one of these words in small letters.
_NEEDS: dict[str, tuple] = {
    "iso": ("digit4", ("-",)), "iso8": ("digit8",), "isotime": ("digit", ("t",)), "slash": ("digit", ("/",)), "euro": ("dotted",), "span": ("digit4", ("-to-",)), "weekof": ("month", ("week",)),
    "dated": ("month",), "daymonth": ("month",), "monthyear": ("month", "digit4"), "ides": ("month", ("ides", "nones")), "holiday": (_HOLIDAY_NAMES,), "seasonyear": ("season", "digit4"), "quarter": (("quarter",),),
    "clock": ("digit", ("am", "a.m", "pm", "p.m")), "clock24": ("times",), "hours": ("digit4", ("hours", "hrs")), "past": (("in the ", "o'clock", ".m."), ("past", "to", "after", "before")), "oclock": (("o'clock",),),
    "noon": (("noon", "midnight", "midday"),), "relday2": (("the day ",),), "relday": (("yesterday", "today", "tomorrow", "tonight", "tonite"),), "thispart": ("part", ("this", "last")),
    "ago": ("unit", ("ago", "hence", "from now", "from today", "earlier", "later")), "beforelast": (("before last", "after next"),), "dowrel": ("dow", "side"), "every": (("each", "every", "alternate"),), "adverb": (("ly",),),
    "relmonth": ("month", "side"), "lastn": ("unit", ("the ",)), "relunit": ("unit", "side"), "relweekend": (("weekend",),), "relseason": ("season", "side"), "dow": ("dow",), "hyphen": ("unit", ("-",)),
    "bound": ("unit", ("than", "least", "about", "nearly", "almost")), "another": ("unit", ("another",)), "straight": ("unit", ("straight", "consecutive")), "few": ("unit", ("few", "couple", "several")), "count": ("unit",),
    "decade": (("0s", "ties"),), "century": (("century",),), "apos": ("digit", ("'",)), "ref": (("the future", "the past", "currently", "now", "once upon", "formerly", "medieval"),), "month": ("month",), "season": ("season",), "year": ("digit4",),
}
_GROUPS = {"month": _MONTH_CUES, "unit": _UNIT_CUES, "dow": _DAY_NAMES, "season": _SEASON_NAMES, "part": _PART_NAMES, "side": _SIDE_CUES}


_CUES = tuple(dict.fromkeys(w for needs in [*_NEEDS.values(), tuple(_GROUPS.values())] for x in needs if not isinstance(x, str) for w in x))


@lru_cache(1 << 12)
def _allowed(cues: tuple[str, ...]) -> list[tuple[str, str, re.Pattern]]:
    """The rules that these cues leave possible."""
    groups = {k: not set(v).isdisjoint(cues) for k, v in _GROUPS.items()}
    met = lambda x: (groups[x] if x in groups else x in cues) if isinstance(x, str) else not set(x).isdisjoint(cues)
    return [r for r in _RULES if all(map(met, _NEEDS.get(r[0], ())))]


def _fitting(low: str) -> list[tuple[str, str, re.Pattern]]:
    """The rules, without those whose words or digits a text in small letters has not."""
    cues = [w for w in _CUES if w in low]
    if digits := _DIGITS.findall(low):
        cues.append("digit")
        most = max(map(len, digits))
        cues += ["digit4"] * (most >= 4) + ["digit8"] * (most >= 8) + ["times"] * bool(_TIMES.search(low)) + ["dotted"] * bool(_DOTTED.search(low))
    return _allowed(tuple(cues))


def find(text: str | None, dct: date | None) -> list[Timex]:
    """Time expressions in text order; those whose value can't be (a 30th of February, say) are dropped."""
    return list(_found_short(text, dct)) if text and len(text) <= 120 else _found(text, dct)


def _found(text: str | None, dct: date | None) -> list[Timex]:
    if not text:
        return []
    shown, text = text, text if text.isascii() else text.translate(_ODD_CASE)
    ref = dct or date(1970, 1, 1)
    held = bytearray(len(text) + 1)
    out: list[Timex] = []
    low = text.lower()
    rules = _fitting(low)
    if not rules or (any(r[0] == "past" for r in rules) and not _ANY.search(low)):  # no other rule fits without a word of these
        return []
    for name, kind, pattern in rules:
        for m in pattern.finditer(low if name != "isotime" else text):
            s, e = m.span()
            if 1 in held[s:e]:
                continue
            if name == "month" and _LOWER_MONTHS.match(text[m.start("month") : m.end("month")]):
                continue
            if name == "season" and m["season"].lower() in ("fall", "spring") and not text[s:e].lower().startswith(("the ", "in ")):
                continue
            if name == "season":
                s = m.start("season")
            if name == "count" and _AFTER_COUNT.match(text, e) and not re.search(r"\b(?:the|for|in)\s+$", text[:s], re.I):
                continue
            try:
                v, attrs = _resolve(name, m, ref, lambda: _direction(text, s, e))  # noqa: B023
            except (ValueError, OverflowError):
                continue
            if v is None and "SET" not in attrs:
                continue
            held[s:e] = b"\x01" * (e - s)
            out.append(Timex(s, e, shown[s:e], "DATE" if kind == "SET" else kind, v, attrs))
    return sorted(out, key=lambda t: t.begin)


_found_short = lru_cache(1 << 13)(_found)
