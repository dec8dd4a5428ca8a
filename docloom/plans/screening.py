"""Queries that screen documents by source against a small rule table, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import rules as R
from docloom.frames import map_frames
from docloom.plans.registry import Group
from docloom.sources import text as T
from docloom.sources.scratch import folder

G = Group()


def _rule(i, strategy, required=(), optional=(), prohibited=(), **k):
    base = {"search_mode": "substring", "case_sensitive": False, "excerpt_window": 60, "max_matches": 3, "min_count": None, "on_missing": None, "on_partial": None, "on_prohibited": None, "domain": None, "actions": []} | k
    return (f"R{i:02d}", "1", f"Rule {i}", base["domain"], strategy, base["search_mode"], base["case_sensitive"], base["excerpt_window"], base["max_matches"], base["min_count"], base["on_missing"], base["on_partial"], base["on_prohibited"], list(required), list(optional), list(prohibited), base["actions"])


RULES = [
    _rule(1, "any_signal_presence", ["Apache License", " apache license "], domain="license"),
    _rule(2, "all_signal_presence", ["license", "version"], on_missing="missing", domain="license"),
    _rule(3, "absent_signals", [], [], ["password"], on_prohibited="failed"),
    _rule(4, "min_signal_count", ["the", "and"], ["is"], min_count=2),
    _rule(5, "any_signal_presence", ["nowhere to be found"], on_missing="review_required"),
    _rule(6, "all_signal_presence", ["the", "nowhere"], on_partial="warning", actions=["Find nowhere."]),
    _rule(7, "any_signal_presence", ["der"], [], ["api_key"], on_prohibited="warning", domain="privacy"),
    _rule(8, "min_signal_count", ["que", "los", "las"], min_count=3, on_partial="warning"),
    _rule(9, "any_signal_presence", ["example.com"], domain="privacy"),
    _rule(10, "all_signal_presence", ["la"], [], ["idiot"]),
    _rule(11, "absent_signals", [], [], ["nowhere to be found"]),
    _rule(12, "any_signal_presence", ["mit license"], domain="license"),
]
EXTRA = [
    _rule(20, "any_signal_presence", ["the  and"], search_mode="exact_phrase"),
    _rule(21, "any_signal_presence", ["of"], search_mode="word"),
    _rule(22, "any_signal_presence", [r"[a-z]{2,10}@example\.com"], search_mode="regex"),
]



def table(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(RULES if rows is None else rows, R.RULE)


def sets(d: DataFrame) -> DataFrame:
    return d.select(F.col("source").alias("doc_set"), "doc_id", F.lit(None).cast("int").alias("page_number"), "text", (F.col("doc_id") % 5 == 0).alias("ocr_used"))


def complete(d: DataFrame) -> DataFrame:
    return d.groupBy(F.col("source").alias("doc_set")).agg((F.count_if(F.col("lang") == "xx") == 0).alias("c"), F.min("source").alias("s")).select("doc_set", (F.substring("s", -1, 1) != "3").alias("complete"))


def results(d: DataFrame) -> DataFrame:
    rules = table(d.sparkSession)
    return R.evaluate(rules, R.signal_hits(sets(d), rules), complete(d))


def _list(x):
    return "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in dict.fromkeys(v.strip().lower() for v in x)) + "]::VARCHAR[]"


def _word(x, default):
    return f"'{R.ALIASES.get(x or default, x or default)}'"


RULES_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{r[0]}', '{r[2]}', '{r[4]}', {_list(r[13])}, {_list(r[14])}, {_list(r[15])}, {r[9] if r[9] is not None else max(1, len(dict.fromkeys(v.strip().lower() for v in r[13])))}, {_word(r[10], 'evidence_missing')}, {_word(r[11], 'requires_review')}, {_word(r[12], 'risk_detected')})" for r in RULES
) + ") t(rule_id, title, strategy, required, optional, prohibited, min_count, on_missing, on_partial, on_prohibited)"
HITS_SQL = f"SELECT DISTINCT d.source AS doc_set, s.signal FROM documents d JOIN (SELECT DISTINCT unnest(list_concat(list_concat(required, optional), prohibited)) AS signal FROM ({RULES_SQL})) s ON contains(lower(d.text), s.signal)"
RESULTS_SQL = f"""SELECT doc_set, rule_id, title, m, missing, found_prohibited, CASE WHEN st = 'evidence_missing' AND doc_set LIKE '%3' THEN 'requires_review' ELSE st END AS status FROM (SELECT *, CASE WHEN p > 0 THEN on_prohibited
WHEN strategy = 'any_signal_presence' THEN CASE WHEN r > 0 THEN 'evidence_found' ELSE on_missing END
WHEN strategy = 'all_signal_presence' THEN CASE WHEN r = len(required) THEN 'evidence_found' WHEN r > 0 THEN on_partial ELSE on_missing END
WHEN strategy = 'absent_signals' THEN 'requires_review' ELSE CASE WHEN r + o >= min_count THEN 'evidence_found' WHEN r + o > 0 THEN on_partial ELSE on_missing END END AS st FROM (
SELECT s.doc_set, t.*, len(list_filter(required, lambda x: list_contains(h, x))) AS r, len(list_filter(optional, lambda x: list_contains(h, x))) AS o, len(list_filter(prohibited, lambda x: list_contains(h, x))) AS p, len(list_filter(required, lambda x: NOT list_contains(h, x))) AS m,
list_filter(required, lambda x: NOT list_contains(h, x)) AS missing, list_sort(list_filter(prohibited, lambda x: list_contains(h, x))) AS found_prohibited
FROM (SELECT DISTINCT source AS doc_set FROM documents) s LEFT JOIN (SELECT doc_set, list(signal) AS h FROM ({HITS_SQL}) GROUP BY 1) q ON q.doc_set = s.doc_set CROSS JOIN ({RULES_SQL}) t))"""
COUNTS_SQL = "SELECT doc_set, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in R.STATUSES) + f" FROM ({RESULTS_SQL}) GROUP BY 1"

ACTIONS_SQL = f"""SELECT doc_set, rule_id, status, list_concat(CASE WHEN rule_id = 'R06' THEN ['Find nowhere.'] WHEN status = 'risk_detected' THEN list_transform(found_prohibited[1:3], lambda x: 'Review or remove: ' || x)
WHEN status IN ('evidence_missing', 'requires_review', 'warning') THEN list_transform(missing[1:3], lambda x: 'Add evidence of: ' || x) ELSE []::VARCHAR[] END, CASE WHEN status = 'evidence_found' THEN []::VARCHAR[] ELSE ['Run the check again after the change.'] END) AS actions FROM ({RESULTS_SQL})"""
STEPS_SQL = f"""WITH a AS (SELECT doc_set, rule_id, list_position({list(R.STATUSES)}, status) AS rank, unnest(actions) AS action, generate_subscripts(actions, 1) AS pos FROM ({ACTIONS_SQL}) WHERE status <> 'evidence_found'),
f AS (SELECT doc_set, action, min((rank, rule_id, pos)) AS place FROM a GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY doc_set ORDER BY place) AS n FROM f)
SELECT d.doc_set, concat_ws(chr(10), string_agg(action, chr(10) ORDER BY n), '{R.FINAL_ACTION}') AS steps FROM (SELECT DISTINCT source AS doc_set FROM documents) d LEFT JOIN k ON k.doc_set = d.doc_set AND k.n <= 8 GROUP BY 1"""


def packs(o: DataFrame) -> DataFrame:
    return o.select(F.col("o_orderpriority").alias("jurisdiction"), F.col("o_orderstatus").alias("sector"), F.date_format("o_orderdate", "'v'yyyy_MM").alias("pack_version"))


PACKS_SQL = "SELECT o_orderpriority AS jurisdiction, o_orderstatus AS sector, strftime(o_orderdate, 'v%Y_%m') AS pack_version FROM orders"
G.add("s3_latest_pack_version", "orders", lambda o: R.latest_versions(packs(o)), f"SELECT jurisdiction, sector, max(pack_version) AS pack_version FROM ({PACKS_SQL}) GROUP BY 1, 2")


def written_packs(o: DataFrame) -> DataFrame:
    """Packs made of orders, written as files and read again: a rule per year of a jurisdiction and sector."""
    spark, root = o.sparkSession, folder(o.sparkSession, "packs")
    named = o.select(F.regexp_replace("o_orderpriority", "[^A-Z]", "").alias("j"), F.col("o_orderstatus").alias("s"), F.date_format("o_orderdate", "'v'yyyy_MM").alias("v"), F.year("o_orderdate").alias("y"))
    rules = named.groupBy("j", "s", "y").agg(F.max("v").alias("v"), F.count("*").alias("n"))
    rule = F.struct(F.concat(F.lit("Y"), F.col("y").cast("string")).alias("rule_id"), F.lit("1").alias("version"), F.concat(F.lit("Orders "), F.col("n").cast("string")).alias("title"), F.struct(F.lit("min_signal_count").alias("strategy"), F.array(F.lower("j"), F.col("s")).alias("required_signals"), (F.col("n") % 5).cast("int").alias("min_count")).alias("evaluation"))
    pack = rules.groupBy("j", "s").agg(F.max("v").alias("v"), F.sort_array(F.collect_list(rule)).alias("rules"))
    files = pack.select(F.concat_ws("/", "j", "s", F.concat("v", F.lit(".json"))).alias("path"), F.to_json(F.struct(F.col("v").alias("version"), F.col("rules"))).alias("content"))
    T.write_named(files, root).count()
    loaded = R.load_rule_packs(spark, root)
    return loaded.select("jurisdiction", "sector", "pack_version", "rule_id", "title", "strategy", "search_mode", "min_count", F.array_join("required", "|").alias("required"))


G.add("s2_load_rule_packs", "orders", written_packs,
      """SELECT j AS jurisdiction, s AS sector, max(v) OVER (PARTITION BY j, s) AS pack_version, 'Y' || y AS rule_id, 'Orders ' || n AS title, 'min_signal_count' AS strategy, 'substring' AS search_mode, CAST(n % 5 AS INTEGER) AS min_count, lower(j) || '|' || s AS required
      FROM (SELECT regexp_replace(o_orderpriority, '[^A-Z]', '', 'g') AS j, o_orderstatus AS s, year(o_orderdate) AS y, max(strftime(o_orderdate, 'v%Y_%m')) AS v, count(*) AS n FROM orders GROUP BY 1, 2, 3)""")
G.add("s4_list_packs", "orders", lambda o: packs(o).distinct().orderBy("jurisdiction", "sector", "pack_version"), f"SELECT DISTINCT jurisdiction, sector, pack_version FROM ({PACKS_SQL})")


def odd_rules(e: DataFrame) -> DataFrame:
    """Rules made of events, some of them wrong."""
    pick = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (F.col("event_id") % n + 1).cast("int"))
    arr = lambda c: F.when(c, F.array("event_type")).otherwise(F.array().cast("array<string>"))
    i = F.col("event_id")
    return e.select(
        F.concat(F.lit("E"), F.greatest(i, F.lit(3)).cast("string")).alias("rule_id"), F.lit("1").alias("version"), F.lit("t").alias("title"), pick(3, "license", None, "Privacy").alias("regulatory_domain"), pick(5, *R.STRATEGIES, "guess").alias("strategy"),
        pick(4, "substring", "word", "regex", "fuzzy").alias("search_mode"), F.lit(False).alias("case_sensitive"), F.lit(5000).alias("excerpt_window"), F.lit(0).alias("max_matches"), pick(3, 1, None, 9).alias("min_count"), pick(4, "missing", None, "nonsense", "warning").alias("on_missing"),
        F.lit(None).cast("string").alias("on_partial"), pick(6, "failed", "missing", None, "warning", "pass", "fail").alias("on_prohibited"), arr(i % 7 != 0).alias("required"), arr(i % 2 == 0).alias("optional"), arr(i % 3 == 0).alias("prohibited"), F.array().cast("array<string>").alias("actions"), F.when(i % 10 == 0, R.CORE_PACK).otherwise("media").alias("sector"),
    )


G.add("r1_validate_rules", "events", lambda e: R.rule_issues(odd_rules(e)).groupBy(F.array_join("issues", ",").alias("issues")).agg(F.count("*").alias("n")),
      """SELECT issues, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN i % 5 = 4 THEN 'strategy' END, CASE WHEN i % 4 = 3 THEN 'search_mode' END, CASE WHEN i % 4 = 2 THEN 'on_missing' END, CASE WHEN i % 6 IN (1, 4) THEN 'on_prohibited' END,
      CASE WHEN CASE WHEN i % 5 = 2 THEN i % 3 <> 0 ELSE i % 7 = 0 AND i % 2 <> 0 END THEN 'no_signals' END,
      CASE WHEN i % 5 = 3 AND NOT (CASE i % 3 WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 9 END BETWEEN 1 AND (CASE WHEN i % 7 <> 0 THEN 1 ELSE 0 END + CASE WHEN i % 2 = 0 THEN 1 ELSE 0 END)) THEN 'min_count' END, CASE WHEN i <= 3 THEN 'duplicate_id' END) AS issues FROM (SELECT event_id AS i FROM events)) GROUP BY 1""")


def probes(e: DataFrame) -> DataFrame:
    shapes = ["{}+", "(?<={})x", "({}+)+", "{}|", r"({})\1", "(a|{})*", ".*.*{}"]

    def run(batches):
        for b in batches:
            yield [(i, R.safe_regex(shapes[i % len(shapes)].format(t))) for i, t in zip(b["event_id"], b["event_type"])]

    return map_frames(e.select("event_id", "event_type"), run, "event_id long, safe boolean")


G.add("r2_safe_regex_check", "events", probes, "SELECT event_id, event_id % 7 = 0 AS safe FROM events")
G.add("r3_filter_rules_by_domain", "events", lambda e: R.filter_domains(odd_rules(e), ["privacy"]).groupBy("sector").agg(F.count("*").alias("n")), "SELECT CASE WHEN event_id % 10 = 0 THEN 'core_control_library' ELSE 'media' END AS sector, count(*) AS n FROM events WHERE event_id % 3 <> 0 OR event_id % 10 = 0 GROUP BY 1")


def reviews(o: DataFrame) -> DataFrame:
    review = F.struct(F.when(F.col("o_orderkey") % 4 != 0, "approved").otherwise("draft").alias("status"), F.when(F.col("o_orderkey") % 5 != 0, "Ann").otherwise(" ").alias("reviewed_by"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("reviewed_at"), F.date_format(F.col("o_orderdate") + F.expr("interval 400 days"), "yyyy-MM-dd HH:mm:ss").alias("review_due_at"))
    return o.select("o_orderkey", R.legal_review_valid(review, F.array(F.lit("act")), F.to_timestamp(F.lit("1996-01-01 00:00:00"))).alias("valid"))


G.add("r4_legal_review_valid", "orders", reviews, "SELECT o_orderkey, o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0 AND date_trunc('second', o_orderdate) <= TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-01-01' < date_trunc('second', o_orderdate) + INTERVAL 400 DAY AS valid FROM orders")
G.add("r5_normalize_signals", "conversations", lambda c: c.select("conv_id", "turn", F.array_join(R.fold_signals(F.split("text", "[,.]"), F.col("turn") % 2 == 0), "|").alias("signals")),
      "SELECT conv_id, turn, array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda p: list_position(w, p[1]) = p[2]), lambda p: p[1]), '|') AS signals FROM (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '[,.]'), lambda x: CASE WHEN turn % 2 = 0 THEN trim(x, ' ') ELSE lower(trim(x, ' ')) END), lambda x: x <> '') AS w FROM conversations)")
G.add("r6_search_signal", "documents", lambda d: R.signal_hits(sets(d), table(d.sparkSession)), HITS_SQL)
G.add("r7_phrase_and_word", "documents", lambda d: R.search(sets(d), table(d.sparkSession, EXTRA[:2])).select("doc_id", "signal").distinct(),
      r"SELECT doc_id, s AS signal FROM documents, (VALUES ('the  and', '(?i)the\s+and'), ('of', '(?i)(^|[^\p{L}\p{N}_])of($|[^\p{L}\p{N}_])')) t(s, p) WHERE regexp_matches(text, p)")
G.add("r8_regex_signal", "documents", lambda d: R.search(sets(d), table(d.sparkSession, EXTRA[2:])).groupBy("doc_id").agg(F.count("*").alias("n")), r"SELECT doc_id, least(3, len(regexp_extract_all(text, '(?i)[a-z]{2,10}@example\.com'))) AS n FROM documents WHERE regexp_matches(text, '(?i)[a-z]{2,10}@example\.com')")


#: Characters of a page, into which documents are cut without loss.
PAGE = 2000


def pages_of(d: DataFrame) -> DataFrame:
    last = F.greatest(F.ceil(F.length("text") / PAGE).cast("int") - 1, F.lit(0))
    cut = sets(d).withColumn("k", F.explode(F.sequence(F.lit(0), F.coalesce(last, F.lit(0)))))
    return cut.withColumns({"page_number": F.col("k") + 1, "text": F.substring("text", F.col("k") * PAGE + 1, F.lit(PAGE))}).drop("k")


def paged(d: DataFrame) -> DataFrame:
    rules = table(d.sparkSession, RULES[3:4])
    return R.page_then_document(R.search(pages_of(d), rules), R.search(sets(d), rules)).select("doc_id", "signal", "page_number").distinct()


G.add("r9_page_then_document", "documents", paged,
      f"""WITH p AS (SELECT doc_id, CAST(k + 1 AS INTEGER) AS page_number, lower(substr(text, k * {PAGE} + 1, {PAGE})) AS t FROM (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil(length(text) / {PAGE}.0) AS BIGINT)))) AS k FROM documents)),
      h AS (SELECT doc_id, s AS signal, page_number FROM p, (VALUES ('the'), ('and'), ('is')) t(s) WHERE contains(p.t, s))
      SELECT * FROM h UNION ALL SELECT doc_id, s, NULL FROM documents, (VALUES ('the'), ('and'), ('is')) t(s) WHERE contains(lower(text), s) AND (doc_id, s) NOT IN (SELECT doc_id, signal FROM h)""")


def occurrences(signals: list[str], most: int = 3) -> str:
    """SQL: the first places (doc_set, doc_id, signal, s) of signals in texts."""
    values = ", ".join(f"('{x}')" for x in signals)
    return f"""SELECT doc_set, doc_id, text, signal, CAST(list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * length(signal) AS INTEGER) AS s FROM (
      SELECT source AS doc_set, doc_id, text, signal, parts, unnest(range(1, least({most}, len(parts) - 1) + 1)) AS k FROM (SELECT source, doc_id, text, v.signal, string_split(lower(text), v.signal) AS parts FROM documents, (VALUES {values}) v(signal)))"""


G.add("r10_cap_matches", "documents", lambda d: R.cap_matches(R.search(sets(d), table(d.sparkSession, RULES[8:9])), 2).select("doc_set", "doc_id", "start"),
      f"SELECT doc_set, doc_id, s AS start FROM (SELECT *, row_number() OVER (PARTITION BY doc_set ORDER BY doc_id, s) AS n FROM ({occurrences(['example.com'])})) WHERE n <= 2")
G.add("r11_excerpt", "documents", lambda d: R.search(sets(d), table(d.sparkSession, RULES[:2])).select("doc_id", "signal", "excerpt"),
      rf"SELECT doc_id, signal, trim(regexp_replace(substr(text, greatest(0, s - 60) + 1, s + length(signal) + 60 - greatest(0, s - 60)), '\s+', ' ', 'g')) AS excerpt FROM ({occurrences(['apache license', 'license', 'version'])})")
ALL_SIGNALS = sorted({x.strip().lower() for r in RULES for x in [*r[13], *r[14], *r[15]]})
G.add("r6_signal_spans", "documents", lambda d: R.search(sets(d), table(d.sparkSession)).select("doc_id", "signal", "start", "end"), f"SELECT doc_id, signal, s AS start, CAST(s + length(signal) AS INTEGER) AS \"end\" FROM ({occurrences(ALL_SIGNALS)})")
WORDS_IN = "list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> '')"
HEADING = f"length(x) <= 120 AND (x LIKE '%:' OR (regexp_matches(x, '\\p{{Lu}}') AND NOT regexp_matches(x, '\\p{{Ll}}') AND length(x) <= 80) OR (len({WORDS_IN}) <= 10 AND len(list_filter({WORDS_IN}, lambda w: regexp_matches(w, '^\\p{{Lu}}'))) >= greatest(1, len({WORDS_IN}) // 2)))"
G.add("r12_section_label", "documents", lambda d: R.search(sets(d), table(d.sparkSession, RULES[:2])).select("doc_id", "signal", "start", "section"),
      f"SELECT doc_id, signal, s AS start, left(list_filter(list_reverse(list_filter(list_transform(string_split(left(text, s), chr(10)), lambda x: trim(x)), lambda x: x <> '')[-8:]), lambda x: {HEADING})[1], 200) AS section FROM ({occurrences(['apache license', 'license', 'version'])})")


def references(l: DataFrame) -> DataFrame:
    """Order lines as hits of rules, of which many tell of the same place."""
    section = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linestatus"))
    hits = l.select(F.col("l_returnflag").alias("doc_set"), (F.col("l_orderkey") % 500).alias("doc_id"), F.when(F.col("l_linenumber") > 2, F.col("l_linenumber").cast("int")).alias("page_number"), F.concat(F.lit("S"), (F.col("l_partkey") % 7).cast("string")).alias("signal"), F.col("l_suppkey").cast("int").alias("start"), F.concat(F.lit("L"), (F.col("l_suppkey") % 3).cast("string")).alias("locator"), F.lit("x").alias("excerpt"), section.alias("section"))
    return R.dedupe_references(hits).select("doc_set", "doc_id", "page_number", "section", "locator", "signal", "start")


G.add("r13_dedupe_references", "lineitem", references,
      """SELECT doc_set, doc_id, page_number, section, locator, signal, start FROM (SELECT *, row_number() OVER (PARTITION BY doc_set, doc_id, page_number, section, locator ORDER BY signal, start) AS n FROM (
      SELECT l_returnflag AS doc_set, l_orderkey % 500 AS doc_id, CASE WHEN l_linenumber > 2 THEN CAST(l_linenumber AS INTEGER) END AS page_number, 'S' || l_partkey % 7 AS signal, CAST(l_suppkey AS INTEGER) AS start, 'L' || l_suppkey % 3 AS locator, CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus END AS section FROM lineitem)) WHERE n = 1""")
for n, (name, strategy) in enumerate((("rule_any", "any_signal_presence"), ("rule_all", "all_signal_presence"), ("rule_absent", "absent_signals"), ("rule_min_count", "min_signal_count")), 14):
    ids = [r[0] for r in RULES if r[4] == strategy]
    listed = ", ".join(f"'{i}'" for i in ids)
    G.add(f"r{n}_{name}", "documents", lambda d, ids=ids: results(d).where(F.col("rule_id").isin(ids)).select("doc_set", "rule_id", "status"), f"SELECT doc_set, rule_id, status FROM ({RESULTS_SQL}) WHERE rule_id IN ({listed})")
G.add("r18_rule_overrides", "documents", lambda d: results(d).select("doc_set", "rule_id", "status", F.array_join("m_prohibited", ",").alias("prohibited")),
      f"SELECT doc_set, rule_id, status, array_to_string(found_prohibited, ',') AS prohibited FROM ({RESULTS_SQL})")
G.add("r19_rule_results", "documents", lambda d: results(d).select("doc_set", "rule_id", "status", F.size("missing").cast("long").alias("missing")), f"SELECT doc_set, rule_id, status, m AS missing FROM ({RESULTS_SQL})")
G.add("r20_status_counts", "documents", lambda d: R.status_counts(results(d)), COUNTS_SQL)


def overall(d: DataFrame) -> DataFrame:
    return R.overall(R.status_counts(results(d)), F.lit(True), F.lit(False))


G.add("r21_overall_status", "documents", lambda d: overall(d).select("doc_set", "overall"), f"SELECT doc_set, CASE WHEN risk_detected + warning + evidence_missing > 0 THEN 'changes_recommended' ELSE 'manual_review_needed' END AS overall FROM ({COUNTS_SQL})")
G.add("r22_next_steps", "documents", lambda d: R.next_steps(R.recommended_actions(results(d))), STEPS_SQL)
G.add("r23_recommended_actions", "documents", lambda d: R.recommended_actions(results(d)).select("doc_set", "rule_id", F.array_join("recommended", "|").alias("actions")), f"SELECT doc_set, rule_id, array_to_string(actions, '|') AS actions FROM ({ACTIONS_SQL})")
G.add("r24_quality_warnings", "documents", lambda d: R.quality_warnings(sets(d)),
      "SELECT source AS doc_set, concat_ws('; ', CASE WHEN count(*) FILTER (length(text) < 100) > 0 THEN count(*) FILTER (length(text) < 100) || ' documents have little text' END, CASE WHEN count(*) FILTER (doc_id % 5 = 0) > 0 THEN 'recognised text may have errors' END) AS warnings FROM documents GROUP BY 1")
G.add("r25_report_id", "documents", lambda d: R.report_id(sets(d), F.lit("packs-1"), F.lit("20240101T000000Z")),
      """SELECT doc_set, 'cmp_20240101T000000Z_' || left(sha256(string_agg(p, '|' ORDER BY k) || '|packs-1|20240101T000000Z'), 20) AS report_id FROM (
      SELECT doc_set, left(d, 3) AS k, sha256(string_agg(d || '*' || n, '|' ORDER BY d)) AS p FROM (SELECT source AS doc_set, sha256(text) AS d, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1, 2) GROUP BY 1""")
G.add("r26_screening_limits", "documents", lambda d: R.within_limits(sets(d), table(d.sparkSession)).select("doc_set", "characters", "fits"), "SELECT source AS doc_set, CAST(sum(length(text)) AS BIGINT) AS characters, sum(length(text)) <= 25000000 AS fits FROM documents GROUP BY 1")
G.add("r27_report_rows", "documents", lambda d: R.report_rows(results(d), overall(d)),
      f"""SELECT doc_set, concat_ws(chr(10), 'Screening of ' || doc_set, 'Overall: ' || CASE WHEN risk_detected + warning + evidence_missing > 0 THEN 'changes_recommended' ELSE 'manual_review_needed' END, {" || ', ' || ".join(f"'{x}: ' || {x}" for x in R.STATUSES)}, checks) AS preview
      FROM ({COUNTS_SQL}) JOIN (SELECT doc_set, string_agg(concat_ws(' - ', rule_id, status, title), chr(10) ORDER BY concat_ws(' - ', rule_id, status, title)) AS checks FROM ({RESULTS_SQL}) GROUP BY 1) USING (doc_set)""")
