"""A recording's metadata: merged definitions, and the tests, channels, dimensions, tags and decoders in them.

Definitions come as a stream of elements in which later ones add to earlier ones: channels,
tests and decoders of one id merge, dimensions of one index too, tags of one id and data,
transforms and units replace, all else is appended. ``mode`` settles where readers and the
written specification differ: ``reference`` keeps inherited dimensions as the base has them
and the first of several tags, ``spec`` lets what is derived override both.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from blockstrata.errors import InvalidData
from blockstrata.plans.program import Program, compile_decoder
from blockstrata.sources.xml import Node, Parser

#: Fixed values of the format: old names of elements, what merges by which attribute, what is replaced.
LEGACY = {"channel": "ch", "dimension": "dim", "transform": "xform"}
MERGED = {"ch": "id", "test": "id", "decoder": "id", "dim": "index"}
REPLACED = ("data", "xform", "units")
MAX_DEPTH = 100


def _same(a: Node, b: Node) -> bool:
    if a.kind != "element" or a.name != b.name:
        return False
    key = MERGED.get(a.name) or ("id" if a.name == "tag" else None)
    return a.name in REPLACED or key is not None and key in a.attrs and a.attrs[key] == b.attrs.get(key)


def merge_into(parent: Node, patch: Node) -> Node:
    """Add an element to its parent by the rules above; returns what it became."""
    base = next((c for c in parent.children if _same(c, patch)), None)
    if base is None or patch.name not in MERGED:
        new = patch.clone()
        if patch.name in MERGED:
            new.children = []
            for c in patch.children:
                merge_into(new, c)
        return base.replace(new) if base is not None else parent.append(new)
    merge_elements(base, patch)
    return base


def merge_elements(base: Node, patch: Node) -> Node:
    base.attrs |= patch.attrs
    for c in patch.children:
        if c.kind == "element":
            merge_into(base, c)
        elif not any(x.kind == c.kind and x.text == c.text for x in base.children):
            base.append(c.clone())
    return base


def normalised(node: Node) -> Node:
    """With today's names, and with path attributes unfolded into the elements that they stand for."""
    out = node.clone()
    for n in out.walk():
        n.name = LEGACY.get(n.name, n.name)
    path = [(outer, key, out.attrs.pop(outer)) for outer, key in (("dim", "index"), ("ch", "id"), ("test", "id")) if outer in out.attrs]
    for outer, key, value in path:
        wrapper = Node(outer, {key: value})
        wrapper.append(out)
        out = wrapper
    return out


class Definitions:
    """The merged document; feed it text as it comes."""

    def __init__(self) -> None:
        self.root = Node("sie")
        self.parser = Parser(self._complete, 1)

    def feed(self, text: str) -> Definitions:
        self.parser.feed(text)
        return self

    def _complete(self, node: Node) -> None:
        if node.kind == "element" and node.parent is not None and node.parent.name == "sie":
            self._merge(normalised(node))
            node.unlink()

    def _merge(self, node: Node) -> None:
        # a channel, test or decoder that is known merges where it stands, even inside a test
        known = self._known(node.name, node.attrs.get("id")) if node.name in ("ch", "test", "decoder") else None
        if known is not None:
            merge_elements(known, node)
        else:
            merge_into(self.root, node)

    def _known(self, name: str, ident: str | None) -> Node | None:
        return next((n for n in self.root.elements(name, "id", ident) if ident is not None), None)

    def definition(self, name: str, ident: str | int) -> Node | None:
        """A channel, test or decoder by id; top-level ones first."""
        found = self._known(name, str(ident))
        return found if found is not None else self.root.find(name, "id", str(ident))

    def expanded(self, name: str, ident: str | int, depth: int = 0) -> Node:
        """A definition merged onto its base, and that onto its own."""
        if depth > MAX_DEPTH:
            raise InvalidData(f"{name} {ident} is based on itself")
        node = self.definition(name, ident)
        if node is None:
            raise InvalidData(f"no {name} {ident}")
        if "base" not in node.attrs:
            return node.clone()
        base = self.expanded(name, node.attrs["base"], depth + 1)
        base.attrs.pop("private", None)
        return merge_elements(base, node)


@dataclass
class Tag:
    key: str
    value: str
    group: int | None = None
    format: str | None = None


@dataclass
class Transform:
    """``kind`` is none, linear (x * scale + offset), map (table lookup) or index (of another channel's dimension)."""

    kind: str = "none"
    scale: float = 1.0
    offset: float = 0.0
    table: list[float] = field(default_factory=list)
    index_channel: int | None = None
    index_dim: int | None = None

    def of(self, x: float) -> float:
        """One number transformed; none and index leave it."""
        if self.kind == "linear":
            return x * self.scale + self.offset
        if self.kind == "map" and x == x:
            at = int(max(0.0, min(x, len(self.table))))
            return self.table[at] if at < len(self.table) else x
        return x


@dataclass
class Dimension:
    index: int
    decoder: int | None
    v: int | None
    transform: Transform
    group: int | None = None
    tags: list[Tag] = field(default_factory=list)


@dataclass
class Channel:
    id: int
    name: str
    test: int | None
    group: int | None
    base: int | None
    dims: list[Dimension] = field(default_factory=list)
    tags: list[Tag] = field(default_factory=list)

    def dim(self, index: int) -> Dimension | None:
        return next((d for d in self.dims if d.index == index), None)


@dataclass
class Test:
    __test__ = False  # not one of pytest's

    id: int
    name: str
    channels: list[Channel] = field(default_factory=list)
    tags: list[Tag] = field(default_factory=list)


def find_tag(tags: Iterable[Tag], key: str, mode: str = "reference") -> Tag | None:
    """The first tag of a key, or in ``spec`` mode the last."""
    found = [t for t in tags if t.key == key]
    return (found[0] if mode == "reference" else found[-1]) if found else None


def _int(text: str | None) -> int | None:
    try:
        return int(text) if text is not None else None
    except ValueError:
        return None


def _float(text: str | None, default: float) -> float:
    try:
        return float(text) if text is not None else default
    except ValueError:
        return default


def _transform(node: Node | None, mode: str) -> Transform:
    if node is None:
        return Transform()
    a = node.attrs
    if "scale" in a:
        return Transform("linear", _float(a["scale"], 1.0), _float(a.get("offset"), 0.0))
    if mode == "spec" and "index_ch" in a:
        return Transform("index", index_channel=_int(a["index_ch"]), index_dim=_int(a.get("index_dim")) or 0)
    if "map" in a and a["map"] != "index":
        return Transform("map", table=map_table(a["map"]))
    if mode == "spec" and a.get("map") == "index":
        return Transform("index", index_channel=_int(a.get("channel")), index_dim=_int(a.get("dimension")) or 0)
    return Transform()


def map_table(text: str) -> list[float]:
    """Numbers between spaces; what is none is skipped."""
    out = []
    for part in text.split(" "):
        try:
            out.append(float(part))
        except ValueError:
            continue
    return out


def _tag(node: Node) -> Tag:
    return Tag(node.attrs.get("id", ""), node.first_text(), _int(node.attrs.get("group")), node.attrs.get("format"))


class Catalog:
    """``tests``, ``channels`` (by way of tests), ``tags`` of the file, ``decoders`` and those that ``failed`` to compile."""

    def __init__(self, definitions: Definitions, mode: str = "reference") -> None:
        if mode not in ("reference", "spec"):
            raise ValueError(f"mode {mode!r}")
        self.definitions, self.mode = definitions, mode
        self.tests: list[Test] = []
        self.decoders: dict[int, Program] = {}
        self.failed: dict[int, str] = {}
        self.tags = [_tag(n) for n in definitions.root.elements("tag") if "id" in n.attrs]
        for node in definitions.root.elements("decoder"):
            if (ident := _int(node.attrs.get("id"))) is not None:
                try:
                    self.decoders[ident] = compile_decoder(node)
                except InvalidData as e:
                    self.failed[ident] = str(e)
        for node in definitions.root.elements("test"):
            if "private" not in node.attrs and (ident := _int(node.attrs.get("id"))) is not None:
                self._test(ident, node)

    @staticmethod
    def of(payloads: Iterable[bytes], mode: str = "reference") -> Catalog:
        """From the XML payloads in file order."""
        definitions = Definitions().feed(b"".join(payloads).decode("utf-8", "replace"))
        definitions.parser.finish()
        return Catalog(definitions, mode)

    @property
    def channels(self) -> list[Channel]:
        return [c for t in self.tests for c in t.channels]

    def test(self, ident: int) -> Test | None:
        return next((t for t in self.tests if t.id == ident), None)

    def channel(self, ident: int) -> Channel | None:
        return next((c for c in self.channels if c.id == ident), None)

    def containing_test(self, channel: Channel) -> Test | None:
        return self.test(channel.test) if channel.test is not None else None

    def _test(self, ident: int, node: Node) -> None:
        test = self.test(ident)
        if test is None:
            test = Test(ident, node.attrs.get("name", ""))
            self.tests.append(test)
        for n in node.elements():
            if n.name == "tag":
                test.tags.append(_tag(n))
            elif n.name == "ch" and "private" not in n.attrs and (channel := _int(n.attrs.get("id"))) is not None:
                known = next((c for c in test.channels if c.id == channel), None)
                if known is not None:
                    known.tags += [_tag(t) for t in n.elements("tag")]
                else:
                    test.channels.append(self._channel(channel, n, ident))

    def _channel(self, ident: int, node: Node, test: int) -> Channel:
        base = _int(node.attrs.get("base"))
        try:
            whole = self.definitions.expanded("ch", base if base is not None else ident)
        except InvalidData:
            whole = node
        if self.mode == "spec":
            whole = merge_elements(whole.clone(), node)
            parts = [whole]
        else:
            parts = [whole] if base is None and self.definitions._known("ch", str(ident)) is None else [whole, node]
        group = _int(node.attrs.get("group", whole.attrs.get("group")))
        channel = Channel(ident, node.attrs.get("name") or whole.attrs.get("name", ""), test, group, base)
        for part in parts:
            for n in part.elements():
                if n.name == "tag":
                    channel.tags.append(_tag(n))
                elif n.name == "dim" and (dim := self._dimension(n)) is not None and channel.dim(dim.index) is None:
                    channel.dims.append(dim)
        channel.dims.sort(key=lambda d: d.index)
        return channel

    def _dimension(self, node: Node) -> Dimension | None:
        index = _int(node.attrs.get("index"))
        if index is None:
            return None
        data = next(node.elements("data"), None)
        decoder, v = (_int(data.attrs.get("decoder")), _int(data.attrs.get("v"))) if data is not None else (None, None)
        return Dimension(index, decoder, v, _transform(next(node.elements("xform"), None), self.mode), _int(node.attrs.get("group")), [_tag(t) for t in node.elements("tag")])

    def binding(self, channel: Channel) -> tuple[int, Program, list[int | None]]:
        """What a channel's rows come from: its group, its program, and the column of each dimension."""
        if channel.group is None or not channel.dims or channel.dims[0].decoder is None:
            raise InvalidData(f"channel {channel.id} has no data")
        if self.mode == "spec" and len({(d.decoder, d.group) for d in channel.dims if d.v is not None}) > 1:
            raise InvalidData(f"dimensions of channel {channel.id} disagree on where their data are")
        program = self.decoders.get(channel.dims[0].decoder)
        if program is None:
            raise InvalidData(f"decoder {channel.dims[0].decoder}: {self.failed.get(channel.dims[0].decoder, 'missing')}")
        return channel.group, program, [d.v if d.v is not None and 0 <= d.v < program.columns else None for d in channel.dims]
