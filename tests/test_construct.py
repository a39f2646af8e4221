import pytest

from seqloom.construct import Const, Construct, Rand, parse_segment


@pytest.mark.parametrize("text", ["const:ATCGATCG", "const:atcg", "rand:35-45", "rand:5-5", "const:RYMKSWBDHVN"])
def test_accepts(text):
    parse_segment(text)


@pytest.mark.parametrize("text", ["rand:45-35", "foo:bar", "constATCG", "const:", "const:ATCGX", "rand:5", "rand:a-b", "Const:A", "rand:-1-2"])
def test_rejects(text):
    with pytest.raises(ValueError):
        parse_segment(text)


def test_upper_case_and_order():
    assert parse_segment("const:atcg") == Const("ATCG")
    c = Construct.parse("rand:0-5", "const:AT", "rand:3-4")
    assert c.consts == ("AT",) and c.rands == ((0, Rand(0, 5)), (1, Rand(3, 4))) and c.starts_open and c.ends_open
    assert c.all_pass == 0b111 and c.bit_names() == ["const_0", "rand_0", "rand_1"]


@pytest.mark.parametrize("texts", [[], ["rand:1-2"], ["const:A", "rand:1-2", "rand:1-2"]])
def test_bad_constructs(texts):
    with pytest.raises(ValueError):
        Construct.parse(*texts)


def test_adjacent_constants_are_fine():
    Construct.parse("const:A", "const:T")
