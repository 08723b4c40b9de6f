import datetime as dt

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tessera.plans.query import Query, dispatch, filters, parse, parse_date, tokenize

UTC = dt.timezone.utc


@pytest.mark.parametrize(
    ("text", "want"),
    [("a b", ["a", "b"]), ('"a b" c', ["a b", "c"]), ('x"a b"y', ["xa by"]), ('open "to the end', ["open", "to the end"]), ('"" ', []), ("  ", [])],
)
def test_tokenize(text, want):
    assert tokenize(text) == want


def test_parse():
    q = parse('moca IN:notes after:2024 before:2024-03 like:#12 "two words" in:')
    assert q == Query(["moca", "two words", "in:"], "notes", dt.datetime(2024, 1, 1, tzinfo=UTC), dt.datetime(2024, 3, 1, tzinfo=UTC), 12)
    assert parse("after:soon like:x").terms == ["after:soon", "like:x"]
    assert parse("in:a in:b").source == "b"
    assert parse("  ~cat").visual_only and parse("  ~cat").terms == ["cat"]


def test_dates_are_local():
    assert parse_date("2024-07-01", "Europe/Berlin") == dt.datetime(2024, 6, 30, 22, tzinfo=UTC)
    assert parse_date("2024-13") is None and parse_date("24") is None


def test_filters():
    assert filters('moca in:"my notes" after:2024 like:3 before:x') == "in:my notes after:2024"


def test_dispatch():
    assert dispatch(parse("~like:3")) == "like"
    assert dispatch(parse("~")) == "none" and dispatch(parse("~a"), has_visual=False) == "none" and dispatch(parse("~a")) == "visual"
    assert dispatch(parse("")) == "text" and dispatch(parse("a"), False, False) == "text" and dispatch(parse("a")) == "hybrid"


@given(st.text())
def test_parse_takes_anything(text):
    q = parse(text)
    assert all(q.terms) and len(q.long_terms) + len(q.short_terms) == len(q.terms)
