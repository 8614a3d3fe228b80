"""Formats: values, failures with positions, round trips."""

import datetime as dt
import json as std

import pytest
from hypothesis import given
from hypothesis import strategies as st

from loomtext.formats import common, csv, json, proto, toml, xml, xpath, yaml
from loomtext.machine import parse

texts = st.text(alphabet=st.characters(blacklist_categories=["Cs"]), max_size=12)


def test_csv():
    assert csv.parse_csv("").value == [[""]] and csv.parse_csv(",,").value == [["", "", ""]] and csv.parse_csv(",a,b").value == [["", "a", "b"]]
    assert csv.parse_csv("a,b\r\nc,d\re").value == [["a", "b"], ["c", "d"], ["e"]]
    assert csv.parse_csv('x,"a ""b""\nc"').value == [["x", 'a "b"\nc']]
    assert csv.parse_csv('ab"c').status == "failure" and csv.parse_csv('"a"b').status == "failure"
    assert csv.parse_csv("a\tb", csv.TSV).value == [["a", "b"]] and csv.parse_csv(" a , b", csv.Csv(trim=True)).value == [["a", "b"]]
    assert csv.parse_csv("a\n\nb\n", csv.Csv(skip_empty=True)).value == [["a"], ["b"]]
    assert csv.parse_strict("a,b\nc").errors[0].message == "Inconsistent columns: expected 2, found 1 at row 2"
    assert csv.parse_maps("n,e,n\nA,1,B\nC").value == [{"n": "B", "e": "1"}, {"n": "C"}]


@given(st.lists(st.lists(texts, min_size=1, max_size=4), min_size=1, max_size=4))
def test_csv_round_trip(rows):
    assert csv.parse_csv(csv.format_csv(rows)).value == rows


values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | texts, lambda x: st.lists(x, max_size=3) | st.dictionaries(texts, x, max_size=3), max_leaves=8)


@given(values, st.sampled_from([None, 2]))
def test_json_agrees_and_keeps_the_source(v, indent):
    text = std.dumps(v, indent=indent)
    assert json.plain(json.parse_json(text).value) == v
    assert json.parse_lossless(text).value.source() == text


@pytest.mark.parametrize("bad", ["00", "[1,]", "NaN", '"a\nb"', "{'a':1}", '{"a":1} x', "", "[1", '"\\x"', "+1", "1.", "tru"])
def test_json_rejects(bad):
    assert json.parse_json(bad).status == "failure"
    assert json.parse_lossless(bad).status == "failure"


def test_json_values():
    assert json.parse_json("1.5E+3").value == json.Number(1500.0, "1.5e+3")
    assert json.parse_json('"\\ud83d\\ude00\\u0041"').value == "😀A" and json.plain(json.parse_json('{"a":1,"a":2}').value) == {"a": 2}
    assert json.parse_as('{"a": 1}', lambda v: v["a"].value).value == 1 and json.parse_as("[]", lambda v: v["a"]).errors[0].message == "Type mismatch"
    assert json.parse_json("[" * 3000 + "]" * 3000).status == "success"


def test_toml():
    r = toml.parse_toml('t = "a\\u0041" # c\n[s]\nn = 1_000\nh = 0xff\nf = -1.5e3\nd = 2024-02-03\nz = 2024-02-03T04:05:06.25+01:00\nc = 04:05:06\nok = true\na = [1, # x\n 2,]\ni = {x = 1, y.z = "q"}\nm = """\nl1\nl2"""\nl = \'c:\\d\'\n')
    s = r.value.subtables["s"][0].pairs
    assert r.value.pairs == {"t": "aA"} and (s["n"], s["h"], s["f"], s["ok"], s["a"], s["i"]) == (1000, 255, -1500.0, True, [1, 2], {"x": 1, "y.z": "q"})
    assert s["d"] == dt.date(2024, 2, 3) and s["z"].microsecond == 250_000 and s["c"] == dt.time(4, 5, 6) and s["m"] == "l1\nl2" and s["l"] == "c:\\d"
    items = toml.parse_toml("[[i]]\nx=1\n[[i]]\nx=2\n[i.s]\ny=3").value.subtables["i"]
    assert [t.pairs["x"] for t in items] == [1, 2] and items[1].subtables["s"][0].pairs == {"y": 3}
    assert toml.parse_toml("a.b = 1").value.pairs == {"a.b": 1}
    assert toml.parse_toml("[a.b]\n[a]\nx=1").status == "success"
    for bad in ("[a]\nx=1\n\n[a]", "[[a]]\n[a]", "[a]\n[[a]]", "x = 1\nx = 2", "x = bare", "x =", "[a", "x = 01"):
        assert toml.parse_toml(bad).status == "failure", bad
    assert toml.parse_toml("[a]\nx=1\n\n[a]").errors[0].offset == 9


@pytest.mark.parametrize("bad", ["2024-02-30", "2023-02-29T10:00:00Z", "25:61:00", "2024-01-01T10:00:00+99:99", "99999999999999999999", "-9223372036854775809", "0xffffffffffffffffff"])
def test_toml_rejects_what_does_not_exist(bad):
    for text in (f"a = {bad}", f"x = 1\na = [1, {bad}]"):
        r = toml.parse_toml(text)
        assert r.status == "failure" and r.errors[0].offset == text.index(bad) and r.errors[0].message.endswith(bad), r
    assert toml.parse_toml("a = 9223372036854775807\nb = -9223372036854775808").value.pairs == {"a": 2**63 - 1, "b": -(2**63)}


def test_xml_expansion_limit():
    text = "<!DOCTYPE r [<!ENTITY a 'xxxxxxxxxx'>]><r>&a;&a;</r>"
    assert xml.parse_xml(text, xml.Config(most_expanded=19)).status == "failure" and xml.parse_xml(text, xml.Config(most_expanded=20)).status == "success"
    many = "<!DOCTYPE r [<!ENTITY a '" + "x" * 1000 + "'>]><r>" + "&a;" * 1100 + "</r>"
    assert xml.parse_xml(many).status == "failure" and len(xml.parse_xml(many, xml.Config(most_expanded=None)).value.root.children[0].text) == 1_100_000


def test_csv_problems():
    assert csv.problem(csv.parse_csv("a")) is None and csv.problem(csv.parse_strict("a,b\nc")) == csv.Problem.COLUMNS
    assert csv.problem(csv.parse_csv('"a"b')) == csv.Problem.FIELD and csv.problem(csv.parse_csv('x,"a')) == csv.Problem.QUOTE


def test_yaml():
    cases = {
        "[1, 2, 3]": [1, 2, 3],
        "- item1\n- item2\n": ["item1", "item2"],
        "name: Alice\nage: 30\n": {"name": "Alice", "age": 30},
        "{name: Alice, age: 30}": {"name": "Alice", "age": 30},
        "a: yes\nb: ~\nc: 1.5\nd: 'it''s'\ne: none": {"a": True, "b": None, "c": 1.5, "d": "it's", "e": "none"},
        "tags:\n  - a\n  - b: 1\n    c: 2\nn:\n  k: v # note\n": {"tags": ["a", {"b": 1, "c": 2}], "n": {"k": "v"}},
        "---\n- x\n...\n": ["x"],
        "a:\n- 1\n- 2\nb: 3": {"a": [1, 2], "b": 3},
    }
    for text, want in cases.items():
        r = yaml.parse_yaml(text)
        assert r.status == "success" and r.value == want, (text, r)
    for bad in ("[1, 2", "a: b: c: [", "- a\n b"):
        assert yaml.parse_yaml(bad).status == "failure", bad


def test_xml():
    d = xml.parse_xml('<?xml version="1.0" encoding="utf-8"?><!-- c --><a x="1" n:y=\'&lt;2\'> hi <b/><![CDATA[<x>]]><?p q?>&#x1F600;</a>').value
    assert (d.version, d.root.attributes) == ("1.0", [("x", "1"), ("n:y", "<2")])
    assert d.root.children == [xml.Text("hi"), xml.Element("b"), xml.CData("<x>"), xml.Instruction("p", "q"), xml.Text("😀")]
    dtd = '<!DOCTYPE r [<!ENTITY w "hello"><!ENTITY v "&w;!"><!ENTITY w "late">]>'
    assert xml.parse_xml(dtd + "<r><m>&v;</m></r>").value.root.children[0].children == [xml.Text("hello!")]
    assert xml.parse_xml('<!DOCTYPE r SYSTEM "x"><r>&maybe;</r>').value.root.children == [xml.Text("&maybe;")]
    assert xml.parse_xml("<a> x </a>", xml.Config(preserve_whitespace=True)).value.root.children == [xml.Text(" x ")]
    wrong = {
        "<root></other>": "mismatched end tag",
        "<r>&u;</r>": "undeclared entity: &u;",
        '<!DOCTYPE r [<!ENTITY a "&b;"><!ENTITY b "&a;">]><r>&a;</r>': "circular entity reference: a",
        '<!DOCTYPE r [<!ENTITY p SYSTEM "f" NDATA gif>]><r>&p;</r>': "reference to unparsed entity: &p;",
        '<!DOCTYPE r [<!ENTITY e SYSTEM "f">]><r a="&e;"/>': "external entity in attribute: &e;",
        '<!DOCTYPE r [<!ENTITY e "x<y">]><r a="&e;"/>': "< in entity replacement text used in attribute",
    }
    for text, message in wrong.items():
        r = xml.parse_xml(text)
        assert r.status == "failure" and message in r.errors[0].message, (text, r)
    bomb = "<!DOCTYPE r [<!ENTITY a0 'xxxxxxxxxx'>" + "".join(f"<!ENTITY a{i + 1} '{f'&a{i};' * 10}'>" for i in range(9)) + "]><r>&a9;</r>"
    assert xml.parse_xml(bomb).errors[0].message == "entity expansion is too large"
    assert xml.parse_xml("<root></other>").errors[0].offset >= 6 and xml.parse_xml("<a/><b/>").status == "failure"


def test_proto():
    f = proto.parse_proto('syntax = "proto3";\npackage a.b;\nimport "x.proto";\noption java_package = "j";\nmessage U { string name = 1; repeated int32 ids = 2; map<string, int64> m = 3; oneof o { bool b = 4; } stringX y = 5; enum E { A = 0; B = -1; } }\n/* c */ service S { rpc Get (Req) returns (stream U); rpc P(stream A) returns (B) {} }').value
    u = f.messages[0]
    assert (f.package, f.imports, f.options) == ("a.b", ["x.proto"], [("java_package", "j")])
    assert [(x.name, x.type, x.label, x.number) for x in u.fields] == [("name", "string", "", 1), ("ids", "int32", "repeated", 2), ("m", "int64", "map", 3), ("b", "bool", "oneof", 4), ("y", "stringX", "", 5)]
    assert u.nested[0].values == [("A", 0), ("B", -1)] and [(m.client_streaming, m.server_streaming) for m in f.services[0].methods] == [(False, True), (True, False)]
    assert proto.parse_proto("message A { string a = ; }").status == "failure"


XPATHS = ["/", "//a", "a//b", "/a/b[1]/@c", "../x", ".//y", "self::node()", "ancestor-or-self::*", "a | b", "1 + 2 * 3", "(1 + 2) * 3", "a - b - c", "a - (b - c)", "-a", "--a", "a = b != c", "a or b and c", "(a or b) and c", "$v", "$n:v[1]/z", "f()", "f(a, 'b', 2.5)", "text()", "comment()", "processing-instruction('p')", "n:*", "n:a", "div div div", "* * *", "(a | b)[1]//c", "a[b][c = 'd']", "count(//x[position() < 3]) > .5", "'it''s'[0]" if False else '"it\'s"', "-(a + b)", "a mod -b"]


@pytest.mark.parametrize("source", XPATHS)
def test_xpath_prints_what_parses_alike(source):
    r = xpath.parse_xpath(source)
    assert r.status == "success", r
    again = xpath.parse_xpath(xpath.print_xpath(r.value))
    assert again.value == r.value and xpath.print_xpath(again.value) == xpath.print_xpath(r.value)


@pytest.mark.parametrize("bad", ["//", "a[", "f(", "1 +", "@", "a b", "a]", "a[1", "$", "a ::b", "'x", "a or", "a/"])
def test_xpath_rejects_with_a_position(bad):
    r = xpath.parse_xpath(bad)
    assert r.status == "failure" and r.furthest > 0


def test_common_lexers():
    assert parse(common.signed_int, "-12x").value == -12 and parse(common.floating_point, "1.5e2").value == 150.0
    assert parse(common.double_quoted_string, '"a\\n\\u0041\\""').value == 'a\nA"' and parse(common.block_comment("/*", "*/"), "/* a * b */x").value == " a * b "
    assert parse(common.identifier, "_a1-").value == "_a1" and parse(common.line_comment("//"), "//x\ny").consumed == 3
