import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import rows
from sylvan.operators.packed import BRACKETS, DELIMITERS, explode_packed, parse_packed


@pytest.mark.parametrize(
    ("text", "values", "flags"),
    [
        ("A, B;C|D/E&F+G\tH\nI", list("ABCDEFGHI"), ""),
        ("A and B and C", ["A", "B", "C"], ""),
        ("Band, android and x", ["Band", "android", "x"], ""),
        ("Map<String, u32>, Fold(A, B) | Generic[T, U]", ["Map<String, u32>", "Fold(A, B)", "Generic[T, U]"], ""),
        ("Store<Key, List<Row>>", ["Store<Key, List<Row>>"], ""),
        ("\"Handler, legacy\"; 'a/b' `c|d`", ["Handler, legacy", "'a/b' `c|d`"], ""),
        ('"Odd ""Name"", kept", x', ['Odd "Name", kept', "x"], ""),
        ("[A, 'B, C']", ["A", "B, C"], ""),
        ("(A, B)", ["A", "B"], ""),
        ("[A], [B]", ["[A]", "[B]"], ""),
        (", A, , B,;", ["A", "B"], ""),
        ("A, A", ["A", "A"], ""),
        ("'A, B", ["'A", "B"], "bad_quote"),
        ('"A"b, c', ['"A"b', "c"], "bad_quote"),
        ("a < b, Map<K, V>", ["a < b", "Map<K, V>"], "bad_bracket"),
        ("a], b", ["a]", "b"], ""),
        ("  A\r\n  B ", ["A", "B"], ""),
        ("std::error::Error", ["std::error::Error"], ""),
        ("'  '", [], ""),
        ("", [], ""),
        (None, [], ""),
    ],
)
def test_values(text, values, flags):
    assert parse_packed(text) == (tuple(values), flags)


VALUE = st.text(st.sampled_from("ab <>()[]{}\"'`,;|/&+\t é"), max_size=8).map(str.strip).filter(bool)


@settings(max_examples=300, deadline=None)
@given(st.lists(VALUE, max_size=6), st.sampled_from([",", ", ", ";", " | ", "\n", " and "]))
def test_quoted_round_trip(values, sep):
    assert list(parse_packed(sep.join('"' + v.replace('"', '""') + '"' for v in values))[0]) == values


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab<>()[]{}\"'`,; \n"), max_size=40))
def test_anything_is_parsed(text):
    values, _ = parse_packed(text)
    assert all(v == v.strip() and v for v in values)


def test_long_fields_take_linear_time():
    for text in ("<" * 200_000, "'a," * 100_000, '"' * 200_000, '"' * 200_001, "x '" * 99_999, "(" * 100_000 + ")" * 100_000, "a," * 200_000):
        parse_packed.__wrapped__(text)


def test_table(spark):
    df = spark.createDataFrame([("f", 1, "A, B", 7), ("f", 1, "A, B", 7), ("g", 2, None, 8), (None, None, "'x", 9), ("h", 3, " , ", 9)], "file string, line long, packed string, pos long")
    assert rows(explode_packed(df, "packed", ["file", "line"])) == [("f", 1, 1, "A", ""), ("f", 1, 1, "A", ""), ("f", 1, 2, "B", ""), ("f", 1, 2, "B", ""), (None, None, 1, "'x", "bad_quote")]
    assert explode_packed(df.limit(0), "packed", ["file"]).collect() == []


def test_random_bare_values(spark):
    rng = random.Random(5)
    for _ in range(200):
        values = ["".join(rng.choice("abcXYZ.:=_") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(5))]
        sep = rng.choice([c for c in DELIMITERS if c != "\r"])
        assert list(parse_packed(sep.join(values))[0]) == values
    assert set(BRACKETS) == set("<([{")
