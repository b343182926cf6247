"""A small tolerant markup reader: elements, text, comments and instructions, fed in pieces cut anywhere.

Closing names are not compared, entities are the five named ones and single-byte numbers,
others vanish. What is left open at the end is closed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

#: Fixed values.
_ENTITIES = {"lt": "<", "gt": ">", "amp": "&", "apos": "'", "quot": '"'}
_REFERENCE = re.compile(r"&([^;&<\s]*);")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")


class Node:
    """``kind`` is element, text, comment or instruction; elements have ``name``, ``attrs`` and ``children``, others ``text``."""

    def __init__(self, name: str = "", attrs: dict[str, str] | None = None, kind: str = "element", text: str = "") -> None:
        self.name, self.attrs, self.kind, self.text = name, dict(attrs or {}), kind, text
        self.children: list[Node] = []
        self.parent: Node | None = None

    def append(self, child: Node) -> Node:
        return self.insert(len(self.children), child)

    def prepend(self, child: Node) -> Node:
        return self.insert(0, child)

    def insert(self, at: int, child: Node) -> Node:
        child.unlink()
        child.parent = self
        self.children.insert(at, child)
        return child

    def unlink(self) -> Node:
        if self.parent is not None:
            self.parent.children.remove(self)
            self.parent = None
        return self

    def replace(self, new: Node) -> Node:
        parent, at = self.parent, self.parent.children.index(self)
        self.unlink()
        return parent.insert(at, new)

    def clone(self) -> Node:
        out = Node(self.name, self.attrs, self.kind, self.text)
        for c in self.children:
            out.append(c.clone())
        return out

    def elements(self, name: str | None = None, attr: str | None = None, value: str | None = None) -> Iterator[Node]:
        """Child elements, of a name, with an attribute, with a value of it."""
        for c in self.children:
            if c.kind == "element" and (name is None or c.name == name) and (attr is None or attr in c.attrs and (value is None or c.attrs[attr] == value)):
                yield c

    def walk(self) -> Iterator[Node]:
        """This node and all below it, in document order."""
        yield self
        for c in self.children:
            yield from c.walk()

    def find(self, name: str, attr: str | None = None, value: str | None = None) -> Node | None:
        return next((n for n in self.walk() if n is not self and n.kind == "element" and n.name == name and (attr is None or (attr in n.attrs and value in (None, n.attrs[attr])))), None)

    def first_text(self) -> str:
        return next((c.text for c in self.children if c.kind == "text"), "")

    def __repr__(self) -> str:
        return f"Node({self.to_xml(-1)})"

    def to_xml(self, indent: int = 0) -> str:
        """As markup, indented by depth but for what has text in it; -1 for none."""
        close = "\n" if indent >= 0 else ""
        if self.kind == "text":
            return _quoted(self.text)
        if self.kind != "element":
            return f"<{self.text}>{close}"
        pad = " " * max(indent, 0)
        tag = pad + f"<{self.name}" + "".join(f' {k}="{_quoted(v, True)}"' for k, v in self.attrs.items())
        if not self.children:
            return f"{tag}/>{close}"
        flat = indent < 0 or any(c.kind == "text" for c in self.children)
        inside = "".join(c.to_xml(-1 if flat else indent + 1) for c in self.children)
        return f"{tag}>{inside}</{self.name}>{close}" if flat else f"{tag}>\n{inside}{pad}</{self.name}>{close}"


def _quoted(text: str, attribute: bool = False) -> str:
    text = text.replace("&", "&amp;").replace("<", "&lt;")
    return text.replace('"', "&quot;") if attribute else text


def resolve(text: str) -> str:
    """With entities replaced."""

    def one(m: re.Match) -> str:
        name = m[1]
        if name in _ENTITIES:
            return _ENTITIES[name]
        try:
            code = int(name[2:], 16) if name[:2] == "#x" else int(name[1:]) if name[:1] == "#" else -1
        except ValueError:
            return ""
        return chr(code) if 0 <= code <= 255 else ""

    return _REFERENCE.sub(one, text)


class Parser:
    """Feed text; ``on_close(node)`` is called for each node at depth ``level`` when it is complete."""

    def __init__(self, on_close: Callable[[Node], None] | None = None, level: int = 1) -> None:
        self.root = Node("")
        self.open = [self.root]
        self.rest = ""
        self.on_close, self.level = on_close, level

    def feed(self, text: str) -> Parser:
        text = self.rest + text
        at = 0
        while True:
            start = text.find("<", at)
            if start < 0:
                break
            end = self._end(text, start)
            if end < 0:
                break
            if start > at:
                self._text(text[at:start])
            self._tag(text[start + 1 : end])
            at = end + 1
        self.rest = text[at:]
        return self

    @staticmethod
    def _end(text: str, start: int) -> int:
        if text.startswith("<!--", start):
            end = text.find("-->", start + 4)
            return end + 2 if end >= 0 else -1
        if "<!--".startswith(text[start : start + 4]) and len(text) < start + 4:
            return -1
        quote = ""
        for at in range(start + 1, len(text)):
            c = text[at]
            if quote:
                quote = "" if c == quote else quote
            elif c in "\"'" and text[start + 1] not in "!?":
                quote = c
            elif c == ">":
                return at
        return -1

    def _text(self, text: str) -> None:
        if len(self.open) > 1:
            self._close(self.open[-1].append(Node(kind="text", text=resolve(text))))

    def _tag(self, inner: str) -> None:
        if inner[:1] in ("!", "?"):
            self._close(self.open[-1].append(Node(kind="comment" if inner[0] == "!" else "instruction", text=inner)))
        elif inner[:1] == "/":
            if len(self.open) > 1:
                self._close(self.open.pop())
        else:
            empty = inner.endswith("/")
            head = re.match(r"\s*([^\s/]+)", inner)
            name, attrs = (head[1], inner[head.end() :]) if head else ("", "")
            node = self.open[-1].append(Node(name, {m[1]: resolve(m[2] if m[2] is not None else m[3]) for m in _ATTRIBUTE.finditer(attrs)}))
            if empty:
                self._close(node)
            else:
                self.open.append(node)

    def _close(self, node: Node) -> None:
        if self.on_close and len(self.open) - 1 == self.level:
            self.on_close(node)

    def finish(self) -> Node:
        """The root of all; what is open is closed."""
        if self.rest.strip() and len(self.open) > 1 and "<" not in self.rest:
            self._text(self.rest)
        self.rest = ""
        while len(self.open) > 1:
            self._close(self.open.pop())
        return self.root


def parse(text: str) -> Node:
    """The first element of a document."""
    root = Parser().feed(text).finish()
    return next(root.elements(), root)
