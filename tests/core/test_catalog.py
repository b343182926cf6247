import pytest

from blockstrata.errors import InvalidData
from blockstrata.sources.catalog import Catalog, Definitions, find_tag, map_table
from blockstrata.sources.writer import header
from blockstrata.sources.xml import Node, Parser, parse

XML = """<?xml version="1.0"?><!-- c --><sie version="1.0">
<decoder id="2"><loop var="v0"><read var="v1" type="int" bits="16" endian="little"/><sample/></loop></decoder>
<decoder id="3"><nonsense/></decoder>
<tag id="file_tag">A &amp; B &#65;&#x42;&unknown;</tag>
<ch id="0" private="1" name="base"><tag id="core:units">volts</tag><dim index="0"><data decoder="2" v="0"/><xform scale="0.02"/></dim><dim index="1"><data decoder="2" v="1"/></dim></ch>
<test id="0" name="run"><tag id="start">now</tag>
 <channel id="1" base="0" group="4" name="one"><tag id="core:units">amps</tag><dimension index="1"><transform scale="3" offset="1"/></dimension></channel>
</test>
<channel test="0" id="2" base="0" group="5"><tag id="own">x</tag></channel>
<tag test="0" id="late">y</tag>
<test id="0"><ch id="1"><tag id="more">z</tag></ch></test>
<ch id="9" base="9"/>
"""


def test_parser_takes_any_cut():
    whole = Parser().feed(XML).finish().to_xml()
    for n in (1, 3, 7, 50):
        parser = Parser()
        for i in range(0, len(XML), n):
            parser.feed(XML[i : i + n])
        assert parser.finish().to_xml() == whole


def test_entities_quotes_and_tolerance():
    node = parse("<a x='1>2' y=\"&lt;&quot;\"><b>t&gt;</wrong><c/>tail")
    assert node.attrs == {"x": "1>2", "y": '<"'} and node.find("b").first_text() == "t>" and node.find("c") is not None
    assert parse(node.to_xml()).to_xml() == node.to_xml()
    assert Node("a", {"k": '"&<'}).to_xml() == '<a k="&quot;&amp;&lt;"/>\n'


def test_node_editing_and_search():
    root = parse('<r><a id="1"/><b id="1"/><a id="2"><c/></a></r>')
    assert [n.attrs["id"] for n in root.elements("a")] == ["1", "2"] and [n.name for n in root.elements(None, "id", "1")] == ["a", "b"]
    assert root.find("c").parent.attrs["id"] == "2" and [n.name for n in root.walk()] == ["r", "a", "b", "a", "c"]
    copy = root.clone()
    copy.prepend(Node("z"))
    copy.find("b").unlink()
    assert [n.name for n in copy.children] == ["z", "a", "a"] and [n.name for n in root.children] == ["a", "b", "a"]


def test_reference_and_spec_modes():
    a, b = Catalog.of([XML.encode()]), Catalog.of([XML.encode()], "spec")
    assert [(t.id, t.name) for t in a.tests] == [(0, "run")] and [c.id for c in a.channels] == [1, 2]
    assert [t.key for t in a.tests[0].tags] == ["start", "late"] and a.tags[0].value == "A & B AB"
    one, spec = a.channel(1), b.channel(1)
    assert (one.group, one.name, a.channel(2).group, a.containing_test(one).id) == (4, "one", 5, 0)
    assert one.dim(1).transform.kind == "none" and (spec.dim(1).transform.scale, spec.dim(1).transform.offset) == (3, 1)
    assert find_tag(one.tags, "core:units").value == "volts" and find_tag(spec.tags, "core:units", "spec").value == "amps"
    assert one.dim(0).transform.scale == 0.02 and find_tag(one.tags, "more").value == "z"
    assert list(a.decoders) == [2] and 3 in a.failed
    group, program, columns = a.binding(one)
    assert (group, columns) == (4, [0, 1]) and program.columns == 2
    with pytest.raises(InvalidData):
        a.definitions.expanded("ch", 9)
    with pytest.raises(ValueError):
        Catalog(Definitions(), "other")


def test_merge_rules():
    d = Definitions()
    for text in ("<sie><ch id='42' name='a'><tag id='x'>1</tag></ch>", "<ch id='42'><tag id='y'>2</tag></ch><tag ch='42' dim='3' test='1' id='deep'>t</tag>", "<ch id='42' name='b'><tag id='x'>3</tag></ch>"):
        d.feed(text)
    ch = d.definition("ch", 42)
    assert ch.attrs["name"] == "b" and [(t.attrs["id"], t.first_text()) for t in ch.elements("tag")] == [("x", "3"), ("y", "2")]
    deep = d.root.find("test", "id", "1").find("dim", "index", "3")
    assert deep.parent.attrs["id"] == "42" and deep.find("tag").first_text() == "t"


def test_header_describes_itself():
    c = Catalog.of([header().encode()])
    assert set(c.decoders) == {0, 1} and {t.key: t.group for t in c.tags} == {"sie:xml_metadata": 0, "sie:block_index": 1}
    assert c.decoders[1].rows(bytes([0] * 7 + [9, 0, 0, 0, 5])) == [(9.0, 5.0)]
    assert map_table("1 2.5 x 3") == [1.0, 2.5, 3.0]
