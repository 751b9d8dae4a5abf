"""Selectors that sources give as hints about their markup: parsed once, matched against a page's elements."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import Protocol


class Element(Protocol):
    """What a selector looks at."""

    tag: str
    attrs: dict[str, str]
    parent: Element | None


_NAME = r"[A-Za-z0-9_\-\u0080-\U0010ffff]+"
_ATTRIBUTE = re.compile(rf"\[\s*({_NAME})\s*(?:([*^$~|]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|({_NAME}))\s*([iIsS])?\s*)?\]")
_SIMPLE = re.compile(rf"({_NAME}|\*)|\.({_NAME})|#({_NAME})")
_JOINT = re.compile(r"\s*(>)\s*|\s+")

#: Tests of an element: tag, class, id, or an attribute with a sign, a value and whether cases count.
Test = tuple[str, ...]


def _compound(text: str, at: int) -> tuple[tuple[Test, ...], int]:
    """The tests of one element that begin at a place, and where they end."""
    tests: list[Test] = []
    while at < len(text):
        if found := _ATTRIBUTE.match(text, at):
            name, sign, *values, flag = found.groups()
            tests.append(("attr", name.lower(), sign or "", next((v for v in values if v is not None), ""), (flag or "s").lower()))
        elif found := _SIMPLE.match(text, at):
            tag, klass, ident = found.groups()
            if tag and tests:
                raise ValueError(text)
            tests.append(("tag", tag.lower()) if tag else ("class", klass) if klass else ("id", ident))
        else:
            break
        at = found.end()
    if not tests:
        raise ValueError(text)
    return tuple(tests), at


@lru_cache(1024)
def parse(selector: str) -> tuple[tuple[tuple[str, tuple[Test, ...]], ...], ...]:
    """The alternatives of a selector, each a chain of (joint, tests) from the outermost element to the one that is looked for; joints are a blank (anywhere inside) or > (directly inside).

    Tags, classes, ids, attributes and these two joints are understood; a selector with anything else is a ValueError.
    """
    out = []
    for part in re.split(r",(?![^\[]*\])", selector):
        text, at, joint, chain = part.strip(), 0, " ", []
        while True:
            tests, at = _compound(text, at)
            chain.append((joint, tests))
            if at == len(text):
                break
            step = _JOINT.match(text, at)
            if step is None:
                raise ValueError(selector)
            joint, at = step[1] or " ", step.end()
        out.append(tuple(chain))
    return tuple(out)


def _passes(x: Element, test: Test) -> bool:
    kind, name, *rest = test
    if kind == "tag":
        return name in ("*", x.tag) and x.tag != ""
    if kind == "id":
        return x.attrs.get("id") == name
    if kind == "class":
        return name in x.attrs.get("class", "").split()
    if name not in x.attrs:
        return False
    sign, wanted, flag = rest
    given = x.attrs[name]
    if flag == "i":
        given, wanted = given.lower(), wanted.lower()
    if sign == "":
        return True
    if sign == "=":
        return given == wanted
    if sign == "~=":
        return wanted in given.split()
    if sign == "|=":
        return given == wanted or given.startswith(f"{wanted}-")
    return wanted != "" and {"*=": given.__contains__, "^=": given.startswith, "$=": given.endswith}[sign](wanted)


def _ends(x: Element, chain: tuple, last: int) -> bool:
    """Whether x is what the chain up to `last` leads to."""
    joint, tests = chain[last]
    if not all(_passes(x, t) for t in tests):
        return False
    if last == 0:
        return True
    above = x.parent
    while above is not None and above.tag:
        if _ends(above, chain, last - 1):
            return True
        if joint == ">":
            return False
        above = above.parent
    return False


def matches(x: Element, selector: str) -> bool:
    """Whether a selector finds an element; what can't be read as a selector finds none."""
    try:
        return any(_ends(x, chain, len(chain) - 1) for chain in parse(selector))
    except ValueError:
        return False
