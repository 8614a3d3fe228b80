"""Combinators, recovery, recursion and precedence."""

import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from loomtext import derive
from loomtext.charclass import is_digit, is_letter, is_whitespace
from loomtext.grammar import Op, Ref, any_char, c_family, char, choice, defer, digit, eof, fail, first_char_choice, keywords, letter, none_of, offset, one_of, pratt, spaces, string, string_in, succeed, symbol, token, tree_of, whitespace
from loomtext.lower import NotRegular, is_regular, lower
from loomtext.machine import parse

number = digit.many1().capture().map(int)


def value(p, text):
    r = parse(p, text)
    assert r.status != "failure", r
    return r.value


def test_choice_and_errors():
    r = parse(string("hello").or_else(string("help")), "help")
    assert (r.status, r.value, r.consumed) == ("success", "help", 4)
    r = parse(string("hello") | string("help"), "hex")
    assert r.status == "failure" and {e.expected for e in r.errors} == {('"hello"',), ('"help"',)} and r.errors[0].found == "hex"
    assert parse(digit, "").errors[0].kind == "EndOfInput"
    assert value(choice(string("a"), string("ab"), string("abc")), "abcd") == "abc"
    assert value(string("a") | string("ab"), "ab") == "a"
    with pytest.raises(ValueError):
        choice()


def test_string_in_takes_the_longest():
    assert value(string_in("a", "", "abc", "ab"), "abd") == "ab"
    assert value(keywords({"in": 1, "int": 2}), "int x") == 2
    with pytest.raises(ValueError):
        string_in("")


def test_dispatch():
    p = first_char_choice(("ab", any_char.as_(1)), ("c", any_char.as_(2)), fallback=succeed(0))
    assert [value(p, t) for t in ("b", "c", "x", "")] == [1, 2, 0, 0]
    assert parse(first_char_choice(("ab", any_char)), "x").errors[0].expected == ('one of "ab"',)
    for cases in ((), (("", any_char),), (("a", any_char), ("ba", any_char))):
        with pytest.raises(ValueError):
            first_char_choice(*cases)


def test_repetition():
    assert value(number.sep_by(char(",")), "1,2,3") == [1, 2, 3] and value(number.sep_by(char(",")), "") == []
    assert parse(number.sep_by1(char(",")), "1,2,").consumed == 3
    assert value(number.end_by(char(";")), "1;2;3") == [1, 2]
    assert value(digit.count(2), "123") == ["1", "2"] and value(digit.count(0), "1") == [] and parse(digit.count(3), "12").status == "failure"
    assert parse(digit.at_least(2), "1").status == "failure"
    assert parse(succeed(1).many(), "x").status == "success"
    assert parse(spaces.many1(), " x").consumed == 1


def test_chains():
    minus, power = char("-").as_(lambda a, b: a - b), char("^").as_(lambda a, b: a**b)
    assert value(number.chain_left1(minus), "5-3-1") == 1 and value(number.chain_right1(power), "2^3^2") == 512
    assert value(number.chain_left(minus, 0), "x") == 0 and value(number.chain_right(power, 7), "") == 7


def test_zero_width():
    assert parse(digit.look_ahead(), "1").consumed == 0 and parse(digit.not_followed_by(), "a").consumed == 0
    assert parse(digit.not_followed_by(), "1").errors[0].message == "Unexpected success"
    assert value((char("a") >> offset) << eof, "a") == 1
    assert parse(char("a") << eof, "ab").errors[0].message == "Expected end of input"


def test_recovery():
    r = parse(number.recover(succeed(0)), "abc")
    assert (r.status, r.value, r.consumed) == ("partial", 0, 0) and r.errors
    assert value(number.recover_value(lambda e: e.expected), "x") == ("digit",)
    assert value(number.recover_with(lambda e: letter), "x") == "x"
    r = parse(number.attempt(), "12")
    assert r.value.value == 12 and r.consumed == 2 and parse(number.attempt(), "x").value.status == "failure"
    assert "num" in parse(number.named("num"), "x").errors[0].expected
    assert parse(number.expect("want a number"), "x").errors[0].message == "want a number"
    assert parse(fail("no"), "x").errors[0].message == "no"


def test_sync_and_missing():
    r = parse(number.sync_until(";") << char(";"), "oops;")
    assert r.status == "partial" and r.value.cls == "unexpected" and r.value.source() == "oops" and r.consumed == 5
    assert r.errors[-1].message == "Unexpected input: 'oops'"
    call = tree_of("Call", token("Open", char("(")), token("Num", digit), token("Close", char(")")).expect_token("Close"))
    r = parse(call, "(1")
    assert r.status == "partial" and r.value.children[-1].cls == "missing" and r.value.source() == "(1"


def test_precedence():
    tree = lambda s: lambda a, b: f"({a}{s}{b})"
    p = pratt(digit, Op("left", char("+"), 1, tree("+")), Op("right", char("^"), 3, tree("^")), Op("prefix", char("-"), 2, lambda a: f"-{a}"), Op("postfix", char("!"), 4, lambda a: f"{a}!"))
    assert [value(p, t) for t in ("1+2^3+4", "2+3!", "-5!", "2^3^4")] == ["((1+(2^3))+4)", "(2+3!)", "-5!", "(2^(3^4))"]
    assert parse(p, "1+").status == "failure"
    cases = {"1+2*3": 7, "10-3-2": 5, "1+2<4": 1, "2<3==1": 1, "1==1&&2==3": 0, "0||1==1": 1, "-2*3": -6, "!0==1": 1, "1<2<=2": 1, "7/2": 3, "-7/2": -3, "-7%2": -1}
    assert {t: value(c_family(number) << eof, t) for t in cases} == cases


def test_left_recursion():
    e = Ref()
    e.set((((e << char("-")) & number).map(lambda x: x[0] - x[1]) | number).rule())
    assert value(e << eof, "10-3-2") == 5 and value(e << eof, "-".join(["1"] * 3000)) == 1 - 2999
    # Indirect, through two rules.
    a, b = Ref(), Ref()
    a.set((((b << char("x")).map(lambda v: v + "x")) | char("a")).rule("a"))
    b.set((((a << char("y")).map(lambda v: v + "y")) | char("b")).rule("b"))
    assert value(a << eof, "ayxyx") == "ayxyx" and value(a << eof, "bx") == "bx"


def test_depth_takes_no_stack():
    deep = Ref()
    deep.set((char("(") >> deep << char(")")).map(lambda n: n + 1) | succeed(0))
    assert value(deep, "(" * 50_000 + ")" * 50_000) == 50_000
    nested = defer(lambda: choice((char("[") >> nested.memoize() << char("]")), string("x")))
    assert value(nested, "[[x]]") == "x"


def test_partial_errors_of_a_failed_branch_go():
    p = (number.recover(succeed(0)) >> char("!")) | string("abc")
    assert parse(p, "abc").status == "success"


def test_classes_follow_the_jvm():
    assert is_digit("٣") and not is_digit("½") and is_letter("é") and not is_letter("_")
    assert not is_whitespace("\u00a0") and is_whitespace("\u2003") and parse(whitespace, "\u00a0").status == "failure"


REGULAR = [string("ab"), one_of("ab").many(), none_of("a").many1(), letter.many1() >> digit.optional(), (string("a") | string("ab")) >> char("c"), letter.count(2), char("a").not_followed_by() >> letter, digit.many1().sep_by1(char(",")), symbol("ab") >> eof, string_in("ab", "a", "abc")]


@pytest.mark.parametrize("p", REGULAR)
@given(text=st.text(alphabet="abc1, \n٣é", max_size=8))
def test_pattern_and_interpreter_agree(p, text):
    m, r = re.match(lower(p, java=False), text), parse(p, text)
    assert (m is not None) == (r.status == "success") and (m is None or m.end() == r.consumed)


def test_what_is_not_regular():
    assert is_regular(string("a").many()) and not is_regular(succeed(1).flat_map(succeed)) and not is_regular(spaces.many())
    with pytest.raises(NotRegular):
        lower(Ref().set(char("a")))
    assert re.match(lower((string("a") | string("ab")) >> char("c"), java=False), "abc") is None


def test_derivation():
    import dataclasses

    @dataclasses.dataclass
    class Person:
        name: str
        age: int

    @dataclasses.dataclass
    class Team:
        lead: Person
        size: float
        tags: list[str]
        note: str | None

    derive.typing.get_type_hints  # noqa: B018
    p = derive.derived(Person)
    assert value(p, "Person(Alice,30)") == Person("Alice", 30)
    assert parse(p, "Person(Alice, 30)").status == "failure"
    assert value(derive.derived(list[int]), "List(1,-2)") == [1, -2] and value(derive.derived(bool | None), "None") is None
    assert parse(derive.derived(float), "1").status == "failure"
    assert parse(derive.derived(derive.T.ByteType()), "300").status == "failure"
    assert value(derive.character, "'x'") == "x"
