"""Lines are read as seldom as can be, and give what the plain patterns give."""

import re
from collections import Counter

from docloom.operators import extract as X
from docloom.operators import layout as L
from docloom.operators import names as N
from docloom.operators.fixed import BOUNDARIES, KEY_VALUE, NO_KEY_VALUE
from docloom.plans import catalog
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def plain_key_value(line):
    m = re.match(KEY_VALUE, line)
    if not m or re.match(NO_KEY_VALUE, line.strip()) or line.strip().startswith(BOUNDARIES):
        return None
    key, value = " ".join(m[1].strip().strip(":-–—|").split()), " ".join(m[2].split())
    return (key, value) if value and any(map(str.isalnum, key)) and len(key) <= 70 and key.count(" ") <= 10 else None


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "Ab", "0a", ":", "|", "–", "—", " - ", "-", " ", "\t", "\r", "\n", "\u2028", "://", "c:\\", "é", "x" * 40]), max_size=14).map("".join))
def test_keys_and_values_are_those_of_the_pattern(line):
    assert N.parse_key_value(line) == plain_key_value(line)


def test_lines_with_a_mark_or_none_are_not_searched_for_a_key(monkeypatch):
    asked = []
    monkeypatch.setattr(L, "parse_key_value", lambda line: asked.append(line))
    assert [line.mark for line in L.lines_of(["Total: $5", "some prose", "Item\tQty", "bolt|1", "x: a;b"])] == [None, None, "\t", "|", ";"]
    assert asked == ["x: a;b"]


def test_labels_are_normalised_once(monkeypatch):
    labels, asked = sorted({f for fields in X.CLASS_FIELDS.values() for f in fields}), []
    plain = L.normal_name_py
    monkeypatch.setattr(L, "normal_name_py", lambda name: asked.append(name) or plain(name))
    L._wanted.cache_clear()
    L._usual.cache_clear()
    for i in range(50):
        assert list(L.requested_values(L.lines_of(["Site", f"Dock {i}"]), ["Site"], labels)) == [("Site", f"Dock {i}", 1)]
    assert len(asked) < len(labels) + 50 * 4


def test_texts_are_made_where_their_rows_are_dealt_to(spark, sf):
    plan = catalog.queries()["x6_detect_delimiter"](spark, sf)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(i for i, x in enumerate(plan) if "Repartition" in x)
    assert any("Invoice No" in x for x in plan[:at]) and not any("Invoice No" in x for x in plan[at:])


def test_sources_of_merges_are_read_once(spark, sf):
    for name, scans in (("x18_bag_merge_rows", 2), ("x19_derive_records", 2)):
        plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == scans and "Join" not in plan


def test_bags_and_records_with_nulls(spark):
    made = lambda rows: spark.createDataFrame([(d, n, dict(zip(("item", "qty"), v))) for d, n, v in rows], "doc_id long, line_number int, values map<string,string>")
    table = made([(1, 1, ("a", "1")), (1, 2, ("a", "1")), (None, 1, ("a", "1")), (1, 5, ("", "2"))])
    special = made([(1, 7, ("a", "1")), (1, 8, ("A ", "1")), (1, 9, ("a", "1")), (2, 1, ("a", "1")), (None, 3, ("a", "1")), (1, 6, ("", "2"))])
    assert Counter((r["doc_id"], r["line_number"]) for r in X.bag_merge(table, special).collect()) == Counter([(1, 9), (2, 1), (None, 3), (1, 6)])
    docs = spark.createDataFrame([(1,), (2,), (3,), (4,), (4,), (None,)], "doc_id long")
    fields = spark.createDataFrame([(i, "b", "x") for i in (1, 2, 3)] + [(3, "a", "y")], "doc_id long, norm string, value string")
    got = X.derive_records(docs, table.where("line_number < 3"), special.withColumn("record_type", F.lit("line_item")), fields).collect()
    assert Counter((r["doc_id"], r["record_type"], len(r["values"])) for r in got) == Counter(
        [(1, "table", 2)] * 2 + [(None, "table", 2), (None, "line_item", 2), (2, "line_item", 2), (3, "fields", 2), (4, "empty", 0), (4, "empty", 0), (None, "empty", 0)])
