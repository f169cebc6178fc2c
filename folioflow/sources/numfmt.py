"""Number formats of spreadsheets: values as their cells show them."""

from __future__ import annotations

import math
import re
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction
from functools import lru_cache

_PIECE = re.compile(
    r'"(?P<quoted>[^"]*)"|\\(?P<escaped>.)|\[(?P<bracket>[^\]]*)\]|_(?P<space>.)|\*(?P<fill>.)|(?P<general>General)|(?P<half>AM/PM|A/P)'
    r"|(?P<date>y+|m+|d+|h+|s+)|(?P<exp>E[+-])|(?P<digit>[0#?])|(?P<mark>[.,%/@])|(?P<other>.)",
    re.I | re.S,
)
_MONTHS = "January February March April May June July August September October November December".split()
_DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
_TESTS = {"<": lambda a, b: a < b, ">": lambda a, b: a > b, "=": lambda a, b: a == b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "<>": lambda a, b: a != b}


@lru_cache(maxsize=4096)
def sections(code: str) -> tuple[tuple[tuple[str, str], ...], ...]:
    """The pieces (kind, text) of each section of a format code."""
    out, now = [], []
    for m in _PIECE.finditer(code):
        kind, text = m.lastgroup, m[m.lastgroup]
        if kind == "other" and text == ";":
            out.append(tuple(now))
            now = []
        else:
            now.append((kind, text.lower() if kind == "date" else text))
    return tuple([*out, tuple(now)])


def is_date(code: str) -> bool:
    return any(k == "date" or (k == "bracket" and re.fullmatch("h+|m+|s+", t, re.I)) for k, t in sections(code)[0])


def general(x: float) -> str:
    """A number in up to eleven places, with an exponent where that says too little."""
    if x == int(x) and abs(x) < 1e11:
        return str(int(x))
    size = math.floor(math.log10(abs(x)))
    if -5 < size < 11:
        text = f"{x:.{max(0, 9 - max(size, 0))}f}" if size >= 0 else f"{x:.9f}"
        return text.rstrip("0").rstrip(".") if "." in text else text
    mantissa, _, power = f"{x:.5E}".partition("E")
    return f"{mantissa.rstrip('0').rstrip('.')}E{power[0]}{power[1:].zfill(2)}"


def _rounded(x: float, places: int) -> str:
    return format(Decimal(repr(x)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP), "f")


def _literal(kind: str, text: str) -> str | None:
    if kind in ("quoted", "escaped"):
        return text
    if kind == "space":
        return " "
    if kind == "fill":
        return ""
    if kind == "bracket":  # a currency, or a colour or a condition, which show nothing
        return text[1:].partition("-")[0] if text.startswith("$") else ""
    return None


def _number(x: float, pieces) -> str:
    """A number, not negative, by digit places."""
    digits = [i for i, (k, _) in enumerate(pieces) if k == "digit"]
    point = next((i for i, p in enumerate(pieces) if p == ("mark", ".")), len(pieces))
    exp = next((i for i, (k, _) in enumerate(pieces) if k == "exp"), len(pieces))
    x *= 100 ** sum(p == ("mark", "%") for p in pieces)
    whole = [i for i in digits if i < min(point, exp)]
    part = [i for i in digits if point < i < exp]
    commas = [i for i, p in enumerate(pieces) if p == ("mark", ",")]
    grouped = any(whole and whole[0] < i < whole[-1] for i in commas)
    last = max(whole + part, default=-1)
    scaled = [i for i in commas if (whole and whole[-1] < i < min(point, exp) or last >= 0 and i > last) and not any(j > i for j in whole)]
    x /= 1000 ** len(scaled)
    power = 0
    if exp < len(pieces) and x:
        step = max(1, len(whole))
        power = math.floor(math.log10(x))
        power = power - power % step if step > 1 else power
        x /= 10.0**power
        if float(_rounded(x, len(part))) >= 10**step:
            x, power = x / 10**step, power + step
    slash = next((i for i, p in enumerate(pieces) if p == ("mark", "/")), None)
    if slash is not None:
        return _fraction(x, pieces, slash)
    front, _, back = _rounded(x, len(part)).partition(".")
    front = front.lstrip("0")
    out, shown = [], {}
    # digits of the whole part go to places from the right; the first place takes the rest
    for n, i in enumerate(reversed(whole)):
        take = front[: len(front) - n] if n == len(whole) - 1 else front[len(front) - n - 1 : len(front) - n] if n < len(front) else ""
        shown[i] = take or {"0": "0", "?": " "}.get(pieces[i][1], "")
    if grouped:
        text = "".join(shown[i] for i in whole)
        plain = text.lstrip()
        for i in whole:
            shown[i] = ""
        shown[whole[0]] = f"{int(plain):,}".zfill(len(plain)) if plain.isdigit() else plain
    trimmed = back.rstrip("0")
    for n, i in enumerate(part):
        shown[i] = back[n] if n < len(trimmed) or pieces[i][1] == "0" else {"?": " "}.get(pieces[i][1], "")
    for i, (kind, text) in enumerate(pieces):
        if kind == "digit" and i < exp:
            out.append(shown[i])
        elif kind == "exp":
            places = sum(k == "digit" for k, _ in pieces[i:])
            sign = "-" if power < 0 else "+" if text[1] == "+" else ""
            out.append("E" + sign + str(abs(power)).zfill(places))
        elif kind == "digit" or (kind, text) == ("mark", ","):
            continue
        elif kind == "general":
            out.append(general(x))
        else:
            literal = _literal(kind, text)
            out.append(text if literal is None else literal)
    return "".join(out)


def _fraction(x: float, pieces, slash: int) -> str:
    under = "".join(t for k, t in pieces[slash + 1 :] if k in ("digit", "other") and t.strip())
    over = slash
    while over and pieces[over - 1][0] == "digit":
        over -= 1
    mixed = any(k == "digit" for k, _ in pieces[:over])
    whole = int(x) if mixed else 0
    rest = Fraction(repr(x)) - whole
    if under.isdigit() and int(under):
        low = int(under)
        high = int(rest * low + Fraction(1, 2))
    else:
        near = rest.limit_denominator(10 ** max(1, len(under)) - 1)
        high, low = near.numerator, near.denominator
    if mixed and high == low:
        whole, high = whole + 1, 0
    wide = slash - over
    tail = f"{str(high).rjust(wide)}/{str(low).ljust(len(under))}" if high or not mixed else " " * (wide + 1 + len(under))
    return (f"{whole or ('' if high else 0)} {tail}" if mixed else tail).rstrip() if mixed and not high else (f"{whole or ''} {tail}" if mixed else tail)


def _date(x: float, pieces, since_1904: bool) -> str | None:
    """A date and time by its pieces; null where the number is no date."""
    if x < 0 or x >= 2958466:
        return None
    parts = [len(t) for k, t in pieces if k == "digit"]
    tenths = next((sum(k == "digit" for k, _ in pieces[i + 1 :]) for i, p in enumerate(pieces) if p == ("mark", ".") and parts), 0)
    unit = 86400 * 10**tenths
    ticks = int(Decimal(repr(x)) * unit + Decimal("0.5"))
    day, second = divmod(ticks, unit)
    second, part = divmod(second, 10**tenths)
    if since_1904:
        when = datetime(1904, 1, 1) + timedelta(days=day)
    else:  # the format counts a 29 February 1900, which there wasn't
        when = datetime(1899, 12, 31) + timedelta(days=day if day < 60 else day - 1)
    leap = not since_1904 and day == 60
    month, date, week = (2, 29, 2) if leap else (when.month, when.day, when.weekday())
    half = any(k == "half" for k, _ in pieces)
    hour, minute, second = second // 3600, second // 60 % 60, second % 60
    clock = [i for i, (k, t) in enumerate(pieces) if k == "date" or (k == "bracket" and re.fullmatch("h+|m+|s+", t, re.I))]
    out, after_point = [], False
    for i, (kind, text) in enumerate(pieces):
        if kind == "date":
            near = [pieces[j][1].lower() for j in (*[j for j in clock if j < i][-1:], *[j for j in clock if j > i][:1])]
            before = [j for j in clock if j < i]
            is_minute = text[0] == "m" and len(text) < 3 and ((before and pieces[before[-1]][1][0].lower() == "h") or (len(near) > (1 if before else 0) and near[-1][0] == "s" and [j for j in clock if j > i]))
            n = len(text)
            if text[0] == "y":
                out.append(f"{1900 if leap else when.year}" if n > 2 else f"{(1900 if leap else when.year) % 100:02d}")
            elif is_minute:
                out.append(f"{minute:0{n}d}")
            elif text[0] == "m":
                name = _MONTHS[month - 1]
                out.append({1: str(month), 2: f"{month:02d}", 3: name[:3], 5: name[0]}.get(n, name))
            elif text[0] == "d":
                out.append({1: str(date), 2: f"{date:02d}", 3: _DAYS[week][:3]}.get(n, _DAYS[week]))
            elif text[0] == "h":
                shown = (hour % 12 or 12) if half else hour
                out.append(f"{shown:0{min(n, 2)}d}")
            else:
                out.append(f"{second:0{min(n, 2)}d}")
        elif kind == "half":
            out.append(("AM" if hour < 12 else "PM")[: len(text) // 2 if len(text) == 5 else 1])
        elif kind == "bracket" and i in clock:
            total = {"h": day * 24 + hour, "m": (day * 24 + hour) * 60 + minute, "s": ((day * 24 + hour) * 60 + minute) * 60 + second}[text[0].lower()]
            out.append(f"{total:0{len(text)}d}")
        elif kind == "digit":
            if not after_point:
                out.append(f"{part:0{tenths}d}" if tenths else "0")
            after_point = True
        else:
            literal = _literal(kind, text)
            out.append(text if literal is None else literal)
    return "".join(out)


def shown(x: float, code: str, since_1904: bool = False) -> str:
    """A number as a format code shows it: up to three sections for numbers above, below and at 0, or those with a
    condition, and a fourth for texts."""
    parts = sections(code or "General")
    chosen, negative = parts[0], x < 0
    conditions = [next((m for k, t in p if k == "bracket" and (m := re.fullmatch(r"(<=|>=|<>|<|>|=)\s*(-?[\d.]+)", t))), None) for p in parts[:3]]
    if any(conditions):
        found = next((i for i, c in enumerate(conditions) if c and _TESTS[c[1]](x, float(c[2]))), next((i for i, c in enumerate(conditions) if not c), None))
        if found is None:
            return "#" * 8
        chosen, signed = parts[found], negative
    elif len(parts) > 1 and x < 0:
        chosen, signed = parts[1], False
    elif len(parts) > 2 and x == 0:
        chosen, signed = parts[2], False
    else:
        signed = negative
    if any(k == "date" or (k == "bracket" and re.fullmatch("h+|m+|s+", t, re.I)) for k, t in chosen):
        text = _date(x, chosen, since_1904)
        return "#" * 8 if text is None else text
    if not any(k in ("digit", "general") for k, _ in chosen):
        text = "".join(general(abs(x)) if (k, t) == ("mark", "@") else t if (lit := _literal(k, t)) is None else lit for k, t in chosen)
        return ("-" if signed and text else "") + text
    text = _number(abs(x), chosen)
    zero = not re.search("[1-9]", text)
    return ("-" if signed and not zero else "") + text


def shown_text(s: str, code: str) -> str:
    """A text by the fourth section, or the only one with an @."""
    parts = sections(code or "General")
    chosen = parts[3] if len(parts) > 3 else parts[-1] if any(p == ("mark", "@") for p in parts[-1]) else None
    if chosen is None:
        return s
    return "".join(s if (k, t) == ("mark", "@") else t if (lit := _literal(k, t)) is None else lit for k, t in chosen)
