"""Regular expressions written for a linear-time (RE2 style) engine, for Java's engine.

The differences handled: named groups, POSIX classes, what `\\s`, `.` and `$`
cover, `[` and `&` inside a class, script names, and the replacement template.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# POSIX class -> Java class; blanks that \s stands for.
POSIX_CLASSES = {
    "alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}", "blank": r"\p{Blank}",
    "cntrl": r"\p{Cntrl}", "digit": r"\p{Digit}", "graph": r"\p{Graph}", "lower": r"\p{Lower}",
    "print": r"\p{Print}", "punct": r"\p{Punct}", "space": r"\s", "upper": r"\p{Upper}",
    "word": r"\w", "xdigit": r"\p{XDigit}",
}
BLANKS = r"\t\n\f\r "
NOT_BLANKS_IN_CLASS = r"\x{0}-\x{8}\x{b}\x{e}-\x{1f}!-\x{10ffff}"

_TOKEN = re.compile(
    r"\\Q(?P<plain>.*?)(?:\\E|\Z)"
    r"|\\[pP]\{(?P<script>\^?\w+)\}"
    r"|\\(?P<escaped>.)"
    r"|\[:(?P<negposix>\^?)(?P<posix>[a-z]+):\]"
    r"|\(\?P?<(?P<name>\w+)>"
    r"|\(\?(?P<flags>[a-zA-Z-]+)(?P<flagend>[:)])"
    r"|(?P<char>.)",
    re.S,
)


@dataclass(frozen=True)
class Pattern:
    java: str
    groups: int
    names: tuple[str | None, ...]


def _java_name(name: str) -> str:
    return name.replace("_", "U5F")


def translate(pattern: str) -> Pattern:
    """The pattern for Spark's functions, with its group count and names."""
    out: list[str] = []
    group_names: list[str | None] = []
    in_class = False
    class_start = -1
    multi_line = False
    for m in _TOKEN.finditer(pattern):
        text = m.group()
        if m.group("plain") is not None:
            out.append(re.sub(r"[^\w\s]", lambda c: "\\" + c.group(), m.group("plain"), flags=re.ASCII) if m.group("plain").isascii()
                       else "".join(f"\\x{{{ord(c):x}}}" for c in m.group("plain")))
        elif m.group("script") is not None:
            name = m.group("script")
            negate = (text[1] == "P") != name.startswith("^")
            name = name.lstrip("^")
            out.append(("\\P{" if negate else "\\p{") + ("Is" if len(name) > 2 else "") + name + "}")
        elif m.group("escaped") is not None:
            char = m.group("escaped")
            if char == "s":
                out.append(BLANKS if in_class else f"[{BLANKS}]")
            elif char == "S":
                out.append(NOT_BLANKS_IN_CLASS if in_class else f"[^{BLANKS}]")
            elif char == "C":
                raise ValueError(f"\\C is not supported: {pattern!r}")
            else:
                out.append(text)
        elif m.group("posix") is not None and in_class:
            name = m.group("posix")
            if name not in POSIX_CLASSES:
                raise ValueError(f"unknown character class {text} in {pattern!r}")
            java = POSIX_CLASSES[name]
            if m.group("negposix"):
                java = {r"\s": r"\S", r"\w": r"\W"}.get(java, java.replace(r"\p", r"\P"))
            out.append(java)
        elif m.group("name") is not None and not in_class:
            group_names.append(m.group("name"))
            out.append(f"(?<{_java_name(m.group('name'))}>")
        elif m.group("flags") is not None and not in_class:
            flags = m.group("flags")
            if "U" in flags:
                raise ValueError(f"the flag U (ungreedy) has another meaning here: {pattern!r}")
            multi_line = multi_line or "m" in flags.split("-")[0]
            out.append(text)
        elif in_class:
            if text == "]" and m.start() > class_start:
                in_class = False
                out.append(text)
            elif text == "^" and m.start() == class_start:
                class_start += 1
                out.append(text)
            else:
                out.append(text if text not in "[]&" else "\\" + text)
        elif text.startswith("["):
            in_class = True
            class_start = m.start() + 1
            out.append("[")
            if text != "[":  # "[:alpha:]" outside a class is an ordinary class of letters
                raise ValueError(f"write [[:name:]] for a named class: {pattern!r}")
        elif text == "(":
            if not pattern.startswith("(?", m.start()):
                group_names.append(None)
            out.append(text)
        elif text == "$" and not multi_line:
            out.append(r"\z")
        else:
            out.append(text)
    if in_class:
        raise ValueError(f"missing ] in {pattern!r}")
    return Pattern("(?d)" + "".join(out), len(group_names), tuple(group_names))


_TEMPLATE = re.compile(r"\$\$|\$\{(\w+)\}|\$(\w+)|[^$]+|\$", re.S)


def template(text: str, pattern: Pattern) -> str:
    """A replacement template: `$1`, `${1}`, `$name`, `$$`; an unknown group is empty."""
    out: list[str] = []
    for m in _TEMPLATE.finditer(text):
        name = m.group(1) or m.group(2)
        if name is None:
            plain = "$" if m.group() in ("$", "$$") else m.group()
            if out and out[-1].startswith("$") and out[-1][-1].isdigit() and plain[0].isdigit():
                plain = "\\" + plain[0] + plain[1:].replace("\\", "\\\\").replace("$", "\\$")
                out.append(plain)
            else:
                out.append(plain.replace("\\", "\\\\").replace("$", "\\$"))
        elif name.isdigit():
            if int(name) <= pattern.groups:
                out.append(f"${int(name)}")
        elif name in pattern.names:
            out.append("${" + _java_name(name) + "}")
    return "".join(out)
