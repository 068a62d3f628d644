"""Elements of an HTML page, found by a small part of CSS.

Known are tag, ``#id``, ``.class``, ``[attr]``, ``[attr=v]``, ``[attr^=v]``, ``[attr*=v]``, the
descendant blank and the comma; below a given element also ``:scope > `` at the beginning of an
alternative, for its children. An element's text is what stands between its two ends,
with runs of white space as one blank.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache

_PART = re.compile(r"""([\w-]+)|\#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:([\^*]?=)["']?([^"'\]]*)["']?)?\]""")
_TESTS = {"=": str.__eq__, "^=": str.startswith, "*=": str.__contains__}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SCOPE = (("", "scope", ""),)  # what stands next is a child of the given element
_ENDS_PARAGRAPH = {"p", "div", "section", "ul", "ol", "table", "h1", "h2", "h3", "h4", "figure"}
_ENDS_ITSELF = {"li", "tr", "td", "th", "option"}


@cache
def parse_selector(css: str) -> tuple[tuple[tuple, ...], ...]:
    """Alternatives, each a path of compounds; a compound is a tuple of (attribute, test, value)."""
    out = []
    for alternative in css.split(","):
        path = []
        words = alternative.split()
        if words[:2] == [":scope", ">"]:
            path, words = [SCOPE], words[2:]
        for word in words:
            tests, at = [], 0
            while at < len(word):
                m = _PART.match(word, at)
                if not m:
                    raise ValueError(f"selector not understood: {css!r}")
                tag, name, kind, attribute, how, value = m.groups()
                if tag:
                    tests.append(("", "=", tag.lower()))
                elif name:
                    tests.append(("id", "=", name))
                elif kind:
                    tests.append(("class", "word", kind))
                else:
                    tests.append((attribute.lower(), how or "", value))
                at = m.end()
            path.append(tuple(tests))
        out.append(tuple(path))
    return tuple(out)


class Tree:
    """Elements in document order; fed by a parser's events."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.attributes: list[dict] = []
        self.parents: list[int] = []
        self.starts: list[int] = []
        self.ends: dict[int, int] = {}
        self.lasts: dict[int, int] = {}  # one past the last element below
        self.pieces: list[str] = []
        self._open: list[int] = []
        self._count: Counter = Counter()  # open elements by tag: a stray end costs no search

    def start(self, tag: str, attributes: dict) -> None:
        if self._open:
            last = self.tags[self._open[-1]]
            if (last == "p" and tag in _ENDS_PARAGRAPH) or (last == tag and tag in _ENDS_ITSELF):
                self._pop()
        self.parents.append(self._open[-1] if self._open else -1)
        self.tags.append(tag)
        self.attributes.append(attributes)
        self.starts.append(len(self.pieces))
        if tag in _VOID:
            self.ends[len(self.tags) - 1] = len(self.pieces)
            self.lasts[len(self.tags) - 1] = len(self.tags)
        else:
            self._open.append(len(self.tags) - 1)
            self._count[tag] += 1

    def end(self, tag: str) -> None:
        if self._count[tag]:
            while self._pop() != tag:
                pass

    def data(self, text: str) -> None:
        self.pieces.append(text)

    def _pop(self) -> str:
        element = self._open.pop()
        self.ends[element] = len(self.pieces)
        self.lasts[element] = len(self.tags)
        self._count[self.tags[element]] -= 1
        return self.tags[element]

    def text(self, element: int) -> str:
        return " ".join("".join(self.pieces[self.starts[element] : self.ends.get(element, len(self.pieces))]).split())

    def _fits(self, element: int, tests: tuple) -> bool:
        for attribute, how, value in tests:
            found = self.tags[element] if not attribute else self.attributes[element].get(attribute)
            if attribute and attribute not in self.attributes[element]:
                return False
            if how == "word":
                if value not in (found or "").split():
                    return False
            elif how and not _TESTS[how](found or "", value):
                return False
        return True

    def _on_path(self, element: int, path: tuple, root: int | None = None) -> bool:
        if not self._fits(element, path[-1]):
            return False
        left, at = len(path) - 1, self.parents[element]
        if left and path[0] == SCOPE:
            left, below = left - 1, element
            while left and at != root and at >= 0:
                left, below = left - self._fits(at, path[left]), at
                at = self.parents[at]
            return not left and root is not None and self.parents[below] == root
        while left and at >= 0:
            left -= self._fits(at, path[left - 1])
            at = self.parents[at]
        return not left

    def select(self, css: str, root: int | None = None) -> list[int]:
        """Elements in document order, of the whole page or below one; a path's beginning may lie above that one."""
        paths = parse_selector(css)
        every = range(len(self.tags)) if root is None else range(root + 1, self.lasts.get(root, len(self.tags)))
        return [e for e in every if any(self._on_path(e, p, root) for p in paths)]

    def closest(self, element: int, css: str) -> int | None:
        """The nearest of an element and those above it that a selector fits."""
        paths = parse_selector(css)
        while element >= 0:
            if any(self._on_path(element, p) for p in paths):
                return element
            element = self.parents[element]
        return None

    def children(self, element: int) -> list[int]:
        out, at = [], element + 1
        while at < self.lasts.get(element, len(self.tags)):
            out.append(at)
            at = self.lasts.get(at, len(self.tags))
        return out

    def sibling(self, element: int) -> int | None:
        """The element that follows under the same one."""
        at = self.lasts.get(element, len(self.tags))
        return at if at < len(self.tags) and self.parents[at] == self.parents[element] else None

    def within(self, element: int, above: int) -> bool:
        return above <= element < self.lasts.get(above, len(self.tags))

    def values(self, step: str) -> list[str]:
        """Texts of what a selector finds, or with ``selector@attr`` the attribute's values; empty ones are left out."""
        css, _, attribute = step.partition("@")
        found = self.select(css)
        out = [" ".join((self.attributes[e].get(attribute) or "").split()) for e in found] if attribute else [self.text(e) for e in found]
        return [v for v in out if v]
