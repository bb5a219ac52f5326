"""Reference-time layouts ("2006-01-02 15:04:05") as Spark datetime patterns."""

from __future__ import annotations

import re

# Layout element -> Spark pattern.
LAYOUT_ELEMENTS = {
    "January": "MMMM", "Jan": "MMM", "01": "MM", "1": "M",
    "Monday": "EEEE", "Mon": "EEE",
    "002": "DDD", "02": "dd", "_2": "ppd", "2": "d",
    "2006": "yyyy", "06": "yy",
    "15": "HH", "03": "hh", "3": "h", "PM": "a",
    "04": "mm", "4": "m", "05": "ss", "5": "s",
    "MST": "z", "-0700": "xx", "-07:00": "xxx", "Z0700": "XX", "Z07:00": "XXX",
}

_ELEMENT = re.compile("|".join(re.escape(e) for e in sorted(LAYOUT_ELEMENTS, key=len, reverse=True)) + r"|\.0+")
_SPARK_ONLY = re.compile(r"yy|MM|dd|HH|hh|mm|ss|EEE")


def _literal(text: str) -> str:
    if not text:
        return ""
    if re.search(r"[A-Za-z\[\]{}#']", text):
        return "'" + text.replace("'", "''") + "'"
    return text


def layout_to_pattern(layout: str, parsing: bool = False) -> str:
    """Translate a layout; a Spark pattern such as `yyyy-MM-dd` is returned unchanged.

    When parsing, a fraction of a second is accepted after the seconds even if
    the layout does not mention one.
    """
    if _SPARK_ONLY.search(layout) and not re.search(r"\d", layout):
        return layout
    out, last = [], 0
    found = list(_ELEMENT.finditer(layout))
    if not found:
        raise ValueError(f"no date element in layout {layout!r}")
    for i, m in enumerate(found):
        out.append(_literal(layout[last:m.start()]))
        text = m.group()
        if text.startswith(".0"):
            out.append("." + "S" * (len(text) - 1))
        else:
            out.append(LAYOUT_ELEMENTS[text])
            fraction_follows = i + 1 < len(found) and found[i + 1].group().startswith(".0")
            if parsing and text in ("05", "5") and not fraction_follows:
                out.append("[.SSSSSS]")
        last = m.end()
    out.append(_literal(layout[last:]))
    return "".join(out)
