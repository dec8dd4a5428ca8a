"""Tables, records and requested values of lines: golden rows, and no cell is lost."""

from collections import Counter

import pytest
from docloom.operators import extract, fixed
from docloom.operators import layout as L
from hypothesis import given, settings
from hypothesis import strategies as st


def tables(text):
    return list(L.tables_of(L.lines_of(text.split("\n"))))


def rows(text):
    return [(t, n, values) for t, n, _, values in tables(text)]


def test_a_row_wider_than_its_header_has_columns_of_its_own():
    assert rows("Item\tQty\nbolt\t1\textra\nnut\t2\tmore\n") == [(1, 1, {"Item": "bolt", "Qty": "1", "column_3": "extra"}), (1, 2, {"Item": "nut", "Qty": "2", "column_3": "more"})]
    assert rows("Item\titem\t\nbolt\t1\t2\textra") == [(1, 1, {"Item": "bolt", "item_2": "1", "column_3": "2", "column_4": "extra"})]


def test_a_last_row_that_lost_its_tabs_is_kept():
    assert rows("Item\tQty\nbolt\t1\nnut") == [(1, 1, {"Item": "bolt", "Qty": "1"}), (1, 2, {"Item": "nut", "Qty": ""})]
    # not a word alone, not a table with a header, not tabs: the run ends
    assert rows("Item\tQty\nbolt\t1\nSee below.") == [(1, 1, {"Item": "bolt", "Qty": "1"})]
    assert [n for _, n, _ in rows("red\tblue\nbolt\tnail\nnut")] == [1, 2]
    assert [n for _, n, _ in rows("Item;Qty\nbolt;1\nnut")] == [1]


def test_a_table_without_rows_has_no_number():
    assert rows("Item\tQty\n---\t---\n\nName\tCity\nAnn\tOslo") == [(1, 1, {"Name": "Ann", "City": "Oslo"})]


def test_rules_repeated_headers_and_another_header():
    text = "Item | Qty\n--- | ---\nbolt | 1\nitem | QTY\nnut | 2\nName | City\nAnn | Oslo"
    assert rows(text) == [(1, 1, {"Item": "bolt", "Qty": "1"}), (1, 2, {"Item": "nut", "Qty": "2"}), (2, 1, {"Name": "Ann", "City": "Oslo"})]


def test_frames_quotes_and_boundaries():
    assert rows('| Item | Note |\n| bolt | |\n| nut | yy |') == [(1, 1, {"Item": "bolt", "Note": ""}), (1, 2, {"Item": "nut", "Note": "yy"})]
    assert rows('Item,Note\nbolt,"a, b"\nnut, "c"') == [(1, 1, {"Item": "bolt", "Note": "a, b"}), (1, 2, {"Item": "nut", "Note": "c"})]
    assert rows("Item\tQty\nbolt\t1\n[STRUCTURED TABLE]\nName\tCity\nAnn\tOslo\n[/STRUCTURED TABLE]")[-1] == (2, 1, {"Name": "Ann", "City": "Oslo"})
    assert L.line_of(1, "[STRUCTURED x: y]").ends and L.line_of(1, " \t").ends


def test_prose_and_numbers_are_no_tables():
    assert rows("Well, that was it.\nNow, we go on with this, too.") == [] and rows("1,234\n5,678") == [] and rows("a,b,c\nd,e") == []
    assert rows("one;two\nthree;four") == [(1, 1, {"column_1": "one", "column_2": "two"}), (1, 2, {"column_1": "three", "column_2": "four"})]


@pytest.mark.parametrize("cells, yes", [(("Item", "Qty"), True), (("Ship_date", "who"), True), (("", "Total"), True), (("Item 1", "Qty"), False), (("Item", "a.b"), False), (("Item", "one two three four five six"), False), (("Item", "one two three four five"), True), (("", ""), False), (("_id", "x"), True), (("foo", "bar"), False)])
def test_headers(cells, yes):
    line = L.Line(1, "", mark="\t", cells=cells)
    assert line.header is yes


def test_records():
    records = lambda text: L.repeated_records(L.lines_of(text.split("\n")))
    assert records("Name: A\nname: B\nRole: x") == [{"Name": "A"}, {"name": "B", "Role": "x"}]
    assert records("Full Name: A\nfull-name: B") == [{"Full Name": "A"}, {"full-name": "B"}]
    assert records("a: 1\n[STRUCTURED PAGE]\nb: 2") == [{"a": "1"}, {"b": "2"}]
    assert records("a: 1\nSECTION TWO\nb: 2") == [{"a": "1"}, {"b": "2"}] and records("a: 1\nSECTION. TWO\nb: 2") == [] and records("a: 1\nÄRGER\nb: 2") == []
    assert records("a: 1\nsome words\nb: 2") == []


def test_requested_values():
    found = lambda text, *names: list(L.requested_values(L.lines_of(text.split("\n")), names, ["due_date"]))
    assert found("Delivery Site\nDock 4", "Delivery Site") == [("Delivery Site", "Dock 4", 1)]
    assert found("Delivery Site\nDue Date\nDelivery Site\nDock 5", "Delivery Site") == [("Delivery Site", "Dock 5", 3)]
    assert found("Delivery Site\nOther: x\ndelivery  site Dock 6", "Delivery Site") == [("Delivery Site", "Dock 6", 3)]
    assert found("Site\n\nSite A\nSite B", "Site") == [("Site", "A", 3)] and found("Site\n[STRUCTURED x]", "Site") == []
    assert found("email address\nnone\nemail address a@b.co", "email_address") == [("email_address", "a@b.co", 3)]
    assert found("Phone 12\nPhone +1 (555) 123-456", "Phone") == [("Phone", "+1 (555) 123-456", 2)]


CELL = st.text("abXY1 é", min_size=1, max_size=5).map(lambda s: " ".join(s.split()) or "q")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(CELL, min_size=1, max_size=5), min_size=1, max_size=8), st.sampled_from(["\t", "|", ";"]))
def test_every_cell_of_a_group_comes_out_once(body, mark):
    """Below a header, whatever the widths: each cell is in one row, in its place."""
    width = max(2, *map(len, body))
    body = [r if len(r) > 1 else [*r, "zz"] for r in body]
    text = "\n".join([mark.join(["Item", "Qty"]), *(mark.join(r) for r in body)])
    got = tables(text)
    kept = [r for r in body if list(map(L.normal_name_py, r)) != ["item", "qty"]]
    if any(L.line_of(1, mark.join(r)).header for r in kept):
        return
    assert Counter(v for *_, values in got for v in values.values() if v) == Counter(c for r in kept for c in r)
    assert [[v for v in values.values()][: len(r)] for (*_, values), r in zip(got, kept)] == kept and {t for t, *_ in got} == {1} and max(len(v) for *_, v in got) == width


def test_operators_return_them(spark):
    docs = spark.createDataFrame([(1, "Item\tQty\nbolt\t1\textra\nnut"), (2, None), (3, ""), (4, "Name: A\nname: B")], "doc_id long, text string")
    got = sorted(map(tuple, extract.tables(docs).collect()))
    assert got == [(1, 1, 1, 2, {"Item": "bolt", "Qty": "1", "column_3": "extra"}), (1, 1, 2, 3, {"Item": "nut", "Qty": "", "column_3": ""})]
    assert sorted(map(tuple, extract.records(docs).collect())) == [(4, 1, {"Name": "A"}), (4, 2, {"name": "B"})]


def test_fixed_values_are_plain():
    assert all(isinstance(x, str) for x in fixed.HEADER_WORDS) and all(isinstance(v, list) for v in fixed.EXTERNAL_TYPES.values()) and len(fixed.PRIVACY_TYPES) == 30
