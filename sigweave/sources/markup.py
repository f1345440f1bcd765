"""A small element finder for Arrow batches of pages, on the standard library's HTML tokenizer.

Used only where nested elements defeat a regular expression, and only for pages that the JVM side
has found to contain the wanted markup.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence
from html.parser import HTMLParser
from typing import NamedTuple

from pyspark import cloudpickle

# Elements that never have content, and elements that a sibling of the same kind closes.
_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_SELF_CLOSING_SIBLINGS = frozenset("p li option tr td th dt dd a".split())


class Element:
    __slots__ = ("tag", "attrs", "parent", "text")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.text: list[str] = []

    def content(self) -> str:
        return "".join(self.text)


Test = Callable[[Element], bool]


class Selector(NamedTuple):
    """Elements that pass ``test``, optionally only below one that passes ``below``."""

    test: Test
    below: Test | None = None

    def accepts(self, element: Element) -> bool:
        if not self.test(element):
            return False
        if self.below is None:
            return True
        node = element.parent
        while node is not None:
            if self.below(node):
                return True
            node = node.parent
        return False


class _Finder(HTMLParser):
    def __init__(self, wanted: Sequence[Selector]) -> None:
        super().__init__(convert_charrefs=True)
        self.wanted = wanted
        self.open: list[Element] = []
        self.found: list[list[Element]] = [[] for _ in wanted]
        self.collecting: list[Element] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SELF_CLOSING_SIBLINGS and self.open and self.open[-1].tag == tag:
            self._close(len(self.open) - 1)
        element = Element(
            tag, {k: v or "" for k, v in attrs}, self.open[-1] if self.open else None
        )
        hit = False
        for selector, found in zip(self.wanted, self.found):
            if selector.accepts(element):
                found.append(element)
                hit = True
        if tag not in _VOID:
            self.open.append(element)
            if hit:
                self.collecting.append(element)

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth].tag == tag:
                self._close(depth)
                return

    def _close(self, depth: int) -> None:
        if self.collecting:
            closed = self.open[depth:]
            self.collecting = [e for e in self.collecting if e not in closed]
        del self.open[depth:]

    def handle_data(self, data: str) -> None:
        for element in self.collecting:
            element.text.append(data)


def find(html: str, *wanted: Selector) -> list[list[Element]]:
    """For each selector its elements in document order, with the text of all their descendants.

    The page is read once, however many selectors there are.
    """
    finder = _Finder(wanted)
    finder.feed(html)
    finder.close()
    return finder.found


def attr_is(name: str, value: str) -> Test:
    return lambda e: e.attrs.get(name) == value


def attr_contains(name: str, part: str, tag: str | None = None) -> Test:
    return lambda e: (tag is None or e.tag == tag) and part in e.attrs.get(name, "")


def has_class(name: str) -> Test:
    return lambda e: name in e.attrs.get("class", "").split()


def is_tag(tag: str) -> Test:
    return lambda e: e.tag == tag


def any_of(*tests: Test) -> Test:
    return lambda e: any(t(e) for t in tests)


# Tasks may run where this package is not installed; ship the code with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
