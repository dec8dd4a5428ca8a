"""Queries of structured extraction over documents and order records, with SQL where it can find the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators import extract as X
from docloom.operators import layout as L
from docloom.plans.registry import Group

G = Group()
LINES = "SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line_number, unnest(string_split(text, chr(10))) AS line FROM record_text"


def text_of(c: Column) -> Column:
    """A map as text, entries by key."""
    return F.array_join(F.transform(F.sort_array(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def text() -> Column:
    return text_of(F.col("values"))


def lines(d: DataFrame) -> DataFrame:
    return X.explode_lines(d)


def fields(d: DataFrame) -> DataFrame:
    return X.document_fields(d, "invoice")


G.add("x1_explode_lines", "documents", lambda d: lines(d).groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("line") * F.col("line_number")).alias("check")),
      r"SELECT doc_id, count(*) AS lines, CAST(sum(length(trim(line, ' ')) * n) AS BIGINT) AS check FROM (SELECT doc_id, generate_subscripts(l, 1) AS n, unnest(l) AS line FROM (SELECT doc_id, string_split(regexp_replace(text, '\n\z', ''), chr(10)) AS l FROM documents)) GROUP BY 1")
G.add("x2_key_value_fields", "record_text", lambda d: X.key_values(d).select("doc_id", "name", "value", "line_number"),
      f"SELECT doc_id, name, value, CAST(min(line_number) AS INTEGER) AS line_number FROM (SELECT doc_id, line_number, trim(split_part(line, ':', 1)) AS name, first_value(trim(split_part(line, ':', 2))) OVER (PARTITION BY doc_id, split_part(line, ':', 1) ORDER BY line_number) AS value FROM ({LINES}) WHERE contains(line, ':')) GROUP BY 1, 2, 3")
G.add("x2_review_values", "record_text", lambda d: X.key_values(d, all_values=True).select("doc_id", "name", "value"),
      f"SELECT DISTINCT doc_id, trim(split_part(line, ':', 1)) AS name, trim(split_part(line, ':', 2)) AS value FROM ({LINES}) WHERE contains(line, ':')")
G.add("x3_normalize_field_name", "pages", lambda p: p.select("page_id", X.normal_name(F.col("url")).alias("name")), r"SELECT page_id, trim(regexp_replace(lower(trim(url)), '[^\w]+', '_', 'g'), '_') AS name FROM pages")
G.add("x4_repeated_records", "record_text", lambda d: X.records(d, text=True),
      f"""SELECT doc_id, CAST(g AS INTEGER) AS record_index, string_agg(trim(split_part(line, ':', 1)) || '=' || trim(split_part(line, ':', 2)), ';' ORDER BY trim(split_part(line, ':', 1))) AS record FROM (
      SELECT doc_id, line, CASE WHEN line_number <= 4 THEN 1 WHEN line_number <= 14 THEN 2 WHEN line_number <= 16 THEN 3 ELSE 4 END AS g FROM ({LINES}) WHERE contains(line, ':')) GROUP BY 1, 2""")
G.add("x5_requested_across_lines", "record_text", lambda d: X.requested(d, ["Delivery Site", "Widget"]).select("doc_id", "name", "value"),
      f"SELECT doc_id, 'Delivery Site' AS name, line AS value FROM ({LINES}) WHERE line LIKE 'Dock %' UNION ALL SELECT doc_id, 'Widget', substr(line, 8) FROM ({LINES}) WHERE line LIKE 'Widget %'")


def delimiters(d: DataFrame) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in {"\t": "tab", "|": "pipe", ";": "semicolon", ",": "comma"}.items() for x in kv])
    return X.delimiters(d).groupBy(F.coalesce(names[F.col("mark")], F.lit("none")).alias("delimiter")).agg(F.sum("lines").alias("lines"))


G.add("x6_detect_delimiter", "record_text", delimiters, f"SELECT CASE WHEN contains(line, chr(9)) THEN 'tab' ELSE 'none' END AS delimiter, count(*) AS lines FROM ({LINES}) GROUP BY 1")
G.add("x7_tabular_groups", "documents", lambda d: X.per_document(d, lambda ls: ((run[0].number, len(run)) for run in L.runs(L.run_lines(ls))), "first_line int, n int"))
G.add("x8_extract_tables", "record_text", lambda d: X.tables(d, text=True).select("doc_id", "table_index", "row_index", "record"),
      f"SELECT doc_id, 1 AS table_index, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_number) AS INTEGER) AS row_index, 'Amount=' || split_part(line, chr(9), 3) || ';Item=' || split_part(line, chr(9), 1) || ';Quantity=' || split_part(line, chr(9), 2) AS record FROM ({LINES}) WHERE contains(line, chr(9)) AND line NOT LIKE 'Item%'")
G.add("x9_class_fields", "record_text", lambda d: X.class_fields(d, "invoice").select("doc_id", "name", "value"),
      f"SELECT doc_id, 'invoice_number' AS name, substr(line, 13) AS value FROM ({LINES}) WHERE line LIKE 'Invoice No%' UNION ALL SELECT doc_id, 'invoice_date', substr(line, 7) FROM ({LINES}) WHERE line LIKE 'Date:%' UNION ALL SELECT doc_id, 'total', substr(min_by(line, line_number), 8) FROM ({LINES}) WHERE line LIKE 'Total:%' GROUP BY doc_id")
for cls in ("receipt", "bank_statement", "kyc_document", "procurement_document", "hr_record", "ticket", "memo"):
    G.add(f"x9_{cls}", "record_text forms", lambda r, f, cls=cls: X.class_fields(r.unionByName(f).withColumn("text", F.concat("text", F.lit("\nStatus: open\nPriority: high"))), cls))
ITEM = r"'^(Widget.*?)\s+(\d+)\s+([0-9.]+)\s+([0-9.]+)$'"
G.add("x10_line_items", "record_text", lambda d: X.typed_rows(lines(d), "line_item").select("doc_id", "line_number", text().alias("record")),
      f"SELECT doc_id, line_number, 'amount=' || regexp_extract(line, {ITEM}, 4) || ';description=' || regexp_extract(line, {ITEM}, 1) || ';quantity=' || regexp_extract(line, {ITEM}, 2) || ';unit_price=' || regexp_extract(line, {ITEM}, 3) AS record FROM ({LINES}) WHERE regexp_matches(line, {ITEM})")
G.add("x11_transactions", "record_text", lambda d: X.typed_rows(lines(d), "transaction").select("doc_id", F.col("values")["amount"].alias("amount"), F.col("values")["balance"].alias("balance")),
      f"SELECT doc_id, split_part(line, ' ', 4) AS amount, split_part(line, ' ', 5) AS balance FROM ({LINES}) WHERE line LIKE '03/04/2024%'")
G.add("x12_clauses", "record_text", lambda d: X.typed_rows(lines(d), "clause").select("doc_id", F.col("values")["section"].alias("section"), F.col("values")["title"].alias("title")), f"SELECT doc_id, split_part(line, ' ', 1) AS section, 'Scope of work' AS title FROM ({LINES}) WHERE line LIKE '1._ Scope%'")
G.add("x13_table_fields", "record_text", lambda d: X.table_fields(d, ["amount", "Quantity"]).select("doc_id", "name", "value"),
      f"SELECT doc_id, unnest(['Amount', 'Quantity']) AS name, unnest([split_part(line, chr(9), 3), split_part(line, chr(9), 2)]) AS value FROM ({LINES}) WHERE line LIKE 'bolt%'")
KEYS = f"SELECT doc_id, line_number, lower(replace(trim(split_part(line, ':', 1)), ' ', '_')) AS norm, trim(split_part(line, ':', 1)) AS name, trim(split_part(line, ':', 2)) AS value FROM ({LINES}) WHERE contains(line, ':')"
G.add("x14_merge_fields", "record_text", lambda d: fields(d).select("doc_id", "norm", "value", "confidence"),
      f"""SELECT doc_id, 'invoice_number' AS norm, substr(line, 13) AS value, 0.92::DOUBLE AS confidence FROM ({LINES}) WHERE line LIKE 'Invoice No%' UNION ALL SELECT doc_id, 'invoice_date', substr(line, 7), 0.92 FROM ({LINES}) WHERE line LIKE 'Date:%'
      UNION ALL SELECT doc_id, norm, min_by(value, line_number), CASE WHEN norm = 'total' THEN 0.92 ELSE 0.88 END FROM ({KEYS}) GROUP BY 1, 2""")
REVIEW = f"SELECT doc_id, norm, CASE WHEN count(DISTINCT value) > 1 THEN 'needs_review' ELSE 'found' END AS status, CASE WHEN count(DISTINCT value) = 1 THEN min(value) ELSE '' END AS value, string_agg(DISTINCT value, '|' ORDER BY value) AS candidates FROM ({KEYS}) GROUP BY 1, 2"
G.add("x15_field_review_status", "record_text", X.document_review, REVIEW)


def best(d: DataFrame) -> DataFrame:
    wanted = d.sparkSession.createDataFrame([("customer",), ("total",), ("absent",)], "norm string")
    return X.best_status(X.review_status(X.key_values(d, all_values=True)), wanted)


G.add("x16_best_field_status", "record_text", best,
      f"""SELECT w.norm, coalesce(b.status, 'not_found') AS status, coalesce(b.value, '') AS value FROM (VALUES ('customer'), ('total'), ('absent')) w(norm)
      LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY value = '', doc_id) AS n FROM ({REVIEW})) b ON b.norm = w.norm AND b.n = 1""")
CELLS = f"SELECT doc_id, line_number, CASE WHEN line LIKE 'bolt%' THEN 1 ELSE 2 END AS row_index, split_part(line, chr(9), 1) AS item, split_part(line, chr(9), 2) AS quantity, split_part(line, chr(9), 3) AS amount FROM ({LINES}) WHERE contains(line, chr(9)) AND line NOT LIKE 'Item%'"
RECORD = "'Amount=' || amount || ';Item=' || item || ';Quantity=' || quantity"
G.add("x17_row_fingerprint", "record_text", lambda d: X.tables(d).select("doc_id", "row_index", X.fingerprint(F.col("values")).alias("fp")),
      f"""SELECT doc_id, row_index, sha256('[{{"k":"amount","v":"' || amount || '"}},{{"k":"description","v":"' || item || '"}},{{"k":"quantity","v":"' || quantity || '"}}]') AS fp FROM ({CELLS})""")


def bags(d: DataFrame) -> DataFrame:
    """Line items and the tables' own rows, first rows twice, beside the tables: what is left over one for one."""
    rows = X.tables(d)
    own = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(F.col("row_index") == 1, 2).otherwise(1)))).select("doc_id", "line_number", "values")
    return X.bag_merge(rows, X.typed_rows(lines(d), "line_item").drop("record_type").unionByName(own))


LINE_ITEMS = f"SELECT doc_id, line_number, regexp_extract(line, {ITEM}, 1) AS description, regexp_extract(line, {ITEM}, 2) AS quantity, regexp_extract(line, {ITEM}, 3) AS unit_price, regexp_extract(line, {ITEM}, 4) AS amount FROM ({LINES}) WHERE regexp_matches(line, {ITEM})"
G.add("x18_bag_merge_rows", "record_text", lambda d: bags(d).select("doc_id", "line_number", text().alias("record")),
      f"SELECT doc_id, line_number, 'amount=' || amount || ';description=' || description || ';quantity=' || quantity || ';unit_price=' || unit_price AS record FROM ({LINE_ITEMS}) UNION ALL SELECT doc_id, line_number, {RECORD} FROM ({CELLS}) WHERE row_index = 1")
G.add("x19_derive_records", "record_text documents", lambda r, d: X.derive_records(r.unionByName(d.select("doc_id", "text").withColumn("doc_id", -F.col("doc_id") - 1)), X.tables(r.where("doc_id % 3 = 0")), X.typed_rows(lines(r.where("doc_id % 3 = 1")), "line_item"), fields(r)).groupBy("record_type").agg(F.count("*").alias("n")),
      "SELECT CASE WHEN doc_id < 0 THEN 'empty' WHEN doc_id % 3 = 0 THEN 'table' WHEN doc_id % 3 = 1 THEN 'line_item' ELSE 'fields' END AS record_type, sum(CASE WHEN doc_id >= 0 AND doc_id % 3 = 0 THEN 2 ELSE 1 END)::BIGINT AS n FROM (SELECT doc_id FROM record_text UNION ALL SELECT -doc_id - 1 FROM documents) GROUP BY 1")
G.add("x20_attach_provenance", "record_text", lambda d: X.table_cells(X.with_provenance(d), [], "filename", "checksum").drop("table_index"), "SELECT doc_id, unnest([1, 2]) AS row_index, 'doc-' || doc_id || '.txt' AS filename, sha256(text) AS checksum FROM record_text")
G.add("x21_reserved_column_rename", "orders", lambda o: o.select("o_orderkey", text_of(X.rename_reserved(F.create_map(F.lit("Line Number"), F.col("o_orderstatus"), F.lit("price"), F.lit("1")))).alias("record")), "SELECT o_orderkey, 'field_Line Number=' || o_orderstatus || ';price=1' AS record FROM orders")
G.add("x22_project_records", "record_text", lambda d: X.project_records(d, ["ITEM", "amount"], text=True).select("doc_id", "row_index", "record"),
      f"SELECT doc_id, CASE WHEN line LIKE 'bolt%' THEN 1 ELSE 2 END AS row_index, 'Amount=' || split_part(line, chr(9), 3) || ';Item=' || split_part(line, chr(9), 1) AS record FROM ({LINES}) WHERE line LIKE 'bolt%' OR line LIKE 'nut%'")
G.add("x23_with_document_fields", "record_text", lambda d: X.records_with_fields(d, ["customer", "total"], text=True).select("doc_id", "row_index", "record"),
      f"SELECT doc_id, row_index, {RECORD} || ';customer=' || c || ';total=' || t AS record FROM ({CELLS}) JOIN (SELECT doc_id, min_by(value, line_number) FILTER (norm = 'customer') AS c, min_by(value, line_number) FILTER (norm = 'total') AS t FROM ({KEYS}) GROUP BY 1) USING (doc_id)")
G.add("x24_shape_output", "record_text", lambda d: X.pivot_fields(fields(d), ["invoice_number", "customer", "total"]),
      f"SELECT doc_id, max(CASE WHEN line LIKE 'Invoice%' THEN substr(line, 13) END) AS invoice_number, max(CASE WHEN line LIKE 'Customer%' THEN substr(line, 11) END) AS customer, substr(min_by(line, line_number) FILTER (line LIKE 'Total%'), 8) AS total FROM ({LINES}) GROUP BY 1")
G.add("x25_corpus_totals", "record_text", lambda d: X.table_sizes(d).agg(F.count_distinct("doc_id").alias("documents"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.sum("cells").alias("cells")), "SELECT count(*) AS documents, count(*) * 2 AS rows, count(*) * 6 AS cells FROM record_text")
G.add("x26_quality_summary", "record_text", lambda d: X.review_status(X.key_values(d, all_values=True)).groupBy("doc_id").agg(F.round(F.count_if(F.col("value") != "") / F.count("*"), 4).alias("populated"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("status") != "found", F.col("norm")))), ",").alias("attention")),
      f"SELECT doc_id, round(count(*) FILTER (value <> '') / count(*), 4) AS populated, coalesce(string_agg(norm, ',' ORDER BY norm) FILTER (status <> 'found'), '') AS attention FROM ({REVIEW}) GROUP BY 1")
G.add("x27_project_fields", "record_text", lambda d: X.attach_provenance(X.pivot_fields(fields(d), ["customer", "name", "role"]), d).drop("checksum"), "SELECT doc_id, 'C' || regexp_extract(text, 'Customer: C(\\d+)', 1) AS customer, 'Ann' AS name, 'clerk' AS role, 'doc-' || doc_id || '.txt' AS filename FROM record_text")
G.add("x28_project_record_table", "record_text", lambda d: X.typed_rows(lines(d), "line_item").select("doc_id", *[F.col("values")[n].alias(n) for n in X.ROWS["line_item"][1]]), f"SELECT doc_id, description, quantity, unit_price, amount FROM ({LINE_ITEMS})")
G.add("x29_project_source_table", "record_text", lambda d: X.table_cells(d, ["Item", "Amount"]).where("table_index = 1").select("doc_id", "row_index", F.col("Item").alias("item"), F.col("Amount").alias("amount")),
      f"SELECT doc_id, CASE WHEN line LIKE 'bolt%' THEN 1 ELSE 2 END AS row_index, split_part(line, chr(9), 1) AS item, split_part(line, chr(9), 3) AS amount FROM ({LINES}) WHERE line LIKE 'bolt%' OR line LIKE 'nut%'")


def typed(o: DataFrame) -> DataFrame:
    raw = F.element_at(F.array(F.concat(F.col("o_custkey").cast("string"), F.lit(",000.5")), F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit("n/a")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    t = X.typed_value(raw)
    return o.select("o_orderkey", t["number"].alias("number"), t["day"].cast("string").alias("day"))


G.add("x30_typed_values", "orders", typed,
      """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey * 1000 + 0.5::DOUBLE END AS number, CASE WHEN o_orderkey % 4 = 1 OR (o_orderkey % 4 = 2 AND (day(o_orderdate) > 12 OR day(o_orderdate) = month(o_orderdate))) THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
G.add("x31_bounded_preview", "documents", lambda d: X.bounded_preview(d, 200, 150_000, "n_chars", "doc_id").select("doc_id", "shortened"),
      "SELECT doc_id, count(*) OVER () < (SELECT least(count(*), 201) FROM documents) AS shortened FROM (SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id) AS b, row_number() OVER (ORDER BY doc_id) AS n FROM documents) WHERE n <= 200 AND b <= 150000")
G.add("x32_complete_export_rows", "record_text", lambda d: X.tables(d, text=True).select("doc_id", F.lit("table").alias("kind"), "row_index", "record").unionByName(X.key_values(d).select("doc_id", F.lit("field").alias("kind"), F.concat_ws("=", "name", "value").alias("record"), "confidence"), allowMissingColumns=True),
      f"SELECT doc_id, 'table' AS kind, row_index, {RECORD} AS record, NULL::DOUBLE AS confidence FROM ({CELLS}) UNION ALL SELECT doc_id, 'field', NULL, min_by(name, line_number) || '=' || min_by(value, line_number), 0.88 FROM ({KEYS}) GROUP BY doc_id, norm")
G.add("x33_review_summary", "record_text", lambda d: X.review_status(X.key_values(d, all_values=True)).groupBy("norm", "status").agg(F.count("*").alias("n")), f"SELECT norm, status, count(*) AS n FROM ({REVIEW}) GROUP BY 1, 2")
G.add("s12_neutralize_formula", "record_text", lambda d: X.table_cells(d, ["Amount"]).select("doc_id", "row_index", X.neutral_cell(F.col("Amount")).alias("cell")),
      f"SELECT doc_id, CASE WHEN line LIKE 'bolt%' THEN 1 ELSE 2 END AS row_index, CASE WHEN line LIKE 'bolt%' THEN '''=5' ELSE split_part(line, chr(9), 3) END AS cell FROM ({LINES}) WHERE line LIKE 'bolt%' OR line LIKE 'nut%'")


def classes_sql(most: int = 2) -> str:
    """SQL: the same signals, counted and ranked."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    rows = []
    for rank, (name, (signals, alone)) in enumerate(X.SIGNALS.items()):
        score = " + ".join(f"CASE WHEN regexp_matches(t, {quoted(p)}) THEN 1 ELSE 0 END" for p in signals)
        rows.append(f"SELECT k, {rank} AS rank, '{name}' AS name, {score} AS score, {f'regexp_matches(t, {quoted(alone)})' if alone else 'false'} AS alone FROM n")
    return f"""SELECT * FROM (WITH n AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, lower(text) AS t FROM (SELECT doc_id, text FROM record_text UNION ALL SELECT doc_id, text FROM forms UNION ALL SELECT doc_id, text FROM documents)),
    r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, rank) AS place FROM ({' UNION ALL '.join(rows)}) WHERE score >= 2 OR alone)
    SELECT n.doc_id, coalesce(string_agg(r.name, ',' ORDER BY place), 'form') AS classes FROM n LEFT JOIN r ON r.k = n.k AND r.place <= {most} GROUP BY n.k, n.doc_id)"""


G.add("c3_infer_extraction_class", "record_text forms documents", lambda r, f, d: X.infer_classes(r.unionByName(f).unionByName(d.select("doc_id", "text"))).select("doc_id", F.array_join("classes", ",").alias("classes")), classes_sql())
