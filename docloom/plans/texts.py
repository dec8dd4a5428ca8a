"""Queries of chunking, gates, classification, timed words and text sources, with SQL where it can find the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators import classify as C
from docloom.operators import quality as Q
from docloom.operators import words as W
from docloom.plans.registry import Group
from docloom.sources import text as S
from docloom.sources.scratch import folder

G = Group()
LOWER = "abcdefghijklmnopqrstuvwxyz"
NUMBER = r"\d+(?:[.,:/-]\d+)*"


def changed(c: str = "text") -> Column:
    """A text as a careless model returns it, by the id of its document."""
    i = F.col("doc_id") % 4
    return F.when(i == 0, F.col(c)).when(i == 1, F.regexp_replace(c, r"\d", "")).when(i == 2, F.left(c, (F.length(c) / 2).cast("int"))).otherwise(F.translate(c, LOWER, LOWER.upper()))


CHANGED = "CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN regexp_replace(text, '\\d', '', 'g') WHEN 2 THEN left(text, length(text) // 2) ELSE translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') END"


def pairs(d: DataFrame) -> DataFrame:
    return d.select("doc_id", F.col("text").alias("source"), changed().alias("output"))


def whole(pieces: DataFrame, words: int, chars: int) -> DataFrame:
    """The digest of a document's pieces put together again, and whether each is within its bounds."""
    parts = F.array_sort(F.collect_list(F.struct("n", "piece")))
    fits = F.max((Q.words_of(F.col("piece")) > words) | (F.length("piece") > chars))
    return pieces.groupBy("doc_id").agg(F.sha2(F.array_join(F.transform(parts, lambda x: x["piece"]), ""), 256).alias("digest"), (~fits).alias("bounded"))


G.add("q1_source_units", "documents", lambda d: whole(Q.pieces(d, Q.source_units), Q.UNIT_WORDS, Q.UNIT_CHARS), "SELECT doc_id, sha256(text) AS digest, true AS bounded FROM documents WHERE text <> ''")
G.add("q2_pack_units", "documents", lambda d: Q.pack_units(Q.pieces(d, lambda t: Q.source_units(t, 60, 400)), 200, 1_500))
G.add("q3_partition_exact", "documents", lambda d: whole(Q.pieces(d, lambda t: Q.partition_exact(t, 500)), 500, 500), "SELECT doc_id, sha256(text) AS digest, true AS bounded FROM documents")
G.add("q4_protected_values", "documents", lambda d: Q.protected_values(d, "doc_id", "text"),
      rf"SELECT doc_id, regexp_replace(v, '[.,;]+$', '') AS value, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{Q.PROTECTED[1:-1]}')) AS v FROM documents) GROUP BY 1, 2")
G.add("q5_grammar_gate", "documents", lambda d: Q.grammar_gate(pairs(d)),
      rf"""SELECT doc_id, CASE WHEN trim(o) = '' THEN 'empty' WHEN contains(o, '```') AND NOT contains(text, '```') THEN 'fence' WHEN list_sort(v) <> list_sort(w) THEN 'protected' WHEN n > 25 AND m < n * 0.65 THEN 'omitted' END AS reason FROM (SELECT doc_id, text, o, list_transform(regexp_extract_all(text, '{Q.PROTECTED}', 1), lambda x: regexp_replace(x, '[.,;]+$', '')) AS v, list_transform(regexp_extract_all(o, '{Q.PROTECTED}', 1), lambda x: regexp_replace(x, '[.,;]+$', '')) AS w,
      len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n, len(list_filter(regexp_split_to_array(o, '\s+'), lambda x: x <> '')) AS m FROM (SELECT *, {CHANGED} AS o FROM documents))""")
G.add("q6_summary_gate", "documents", lambda d: pairs(d).select("doc_id", Q.summary_gate(F.col("source"), F.col("output")).alias("fine")), f"SELECT doc_id, NOT (length(text) > 400 AND length({CHANGED}) >= length(text) * 0.95) AS fine FROM documents")
G.add("q7_protected_tokens_missing", "documents", lambda d: Q.per_pair(pairs(d), Q.missing_tokens, "missing int"))
G.add("q8_target_script_gate", "documents", lambda d: Q.per_pair(pairs(d), lambda s, o: Q.script_gate(s, o, "ru"), "reason string"))
G.add("q9_chinese_orthography_gate", "documents", lambda d: d.select("doc_id", Q.orthography_gate(F.concat("text", F.when(F.col("doc_id") % 3 == 0, "們這國").otherwise("们")), "zh-Hans").alias("fine")), "SELECT doc_id, doc_id % 3 <> 0 AS fine FROM documents")


def questions(c: DataFrame) -> DataFrame:
    rows = c.withColumn("q", F.concat(F.when(F.col("conv_id") % 5 != 0, (F.col("turn") + 1).cast("string")).otherwise("2"), F.lit(". Calculate the total cost of "), "text", F.lit(" 12?")))
    ordered = F.sort_array(F.collect_list(F.struct("turn", F.regexp_replace("q", r"\n", " ").alias("q"))))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["q"]), "\n").alias("questions"))


G.add("q10_numbered_sections", "conversations", lambda c: Q.numbered_sections(questions(c), "conv_id", "questions").select("conv_id", "number"), "SELECT conv_id, CAST(CASE WHEN conv_id % 5 <> 0 THEN turn + 1 ELSE 2 END AS INTEGER) AS number FROM conversations")
G.add("q11_question_list_gate", "conversations", lambda c: Q.question_list_gate(Q.numbered_sections(questions(c), "conv_id", "questions"), "conv_id", 1, 1000),
      r"SELECT conv_id, CASE WHEN conv_id % 5 = 0 THEN 'order' WHEN count(DISTINCT lower(regexp_replace('Calculate the total cost of ' || text || ' 12?', '\s+', ' ', 'g'))) < count(*) THEN 'duplicate' END AS reason FROM conversations GROUP BY 1")


def answers(c: DataFrame) -> DataFrame:
    q = Q.numbered_sections(questions(c), "conv_id", "questions")
    a = q.where("number % 7 <> 0").withColumn("body", F.when(F.col("number") % 3 == 0, "12").when(F.col("number") % 3 == 1, "Step: 3 x 4 = 12").otherwise("3 x 4 = 12\nAnswer: 12"))
    return Q.answer_list_gate(q, a, "conv_id")


G.add("q12_answer_list_gate", "conversations", answers,
      """SELECT conv_id, CAST(turn + 1 AS INTEGER) AS number, CASE WHEN (turn + 1) % 7 = 0 THEN 'numbers' WHEN (turn + 1) % 3 = 0 THEN 'working' WHEN (turn + 1) % 3 = 1 THEN 'final' END AS reason FROM conversations WHERE conv_id % 5 <> 0
      UNION ALL SELECT a.conv_id, 2, NULL FROM conversations a JOIN conversations b USING (conv_id) WHERE conv_id % 5 = 0""")


def tokens_sql(text: str) -> str:
    """SQL: the tokens of a text; a mark between thousands goes, in several passes as each takes every other one."""
    plain = f"lower({text})"
    for _ in range(4):
        plain = rf"regexp_replace({plain}, '(\d)[, ](\d\d\d)(\D|$)', '\1\2\3', 'g')"
    return rf"list_filter(regexp_split_to_array({plain}, '[^\p{{L}}\p{{N}}]+'), lambda x: length(x) >= 3)"


def coverage_sql(output: str) -> str:
    counts = lambda c: f"SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest({tokens_sql(c)}) AS t FROM (SELECT doc_id, text, {output} AS o FROM documents)) GROUP BY 1, 2"
    return f"SELECT d.doc_id, CAST(coalesce(sum(least(a.n, coalesce(b.n, 0))), 0) AS BIGINT) AS matched, CAST(coalesce(sum(a.n), 0) AS BIGINT) AS total FROM documents d LEFT JOIN ({counts('text')}) a ON a.doc_id = d.doc_id LEFT JOIN ({counts('o')}) b ON b.doc_id = a.doc_id AND b.t = a.t GROUP BY 1"


G.add("q13_token_coverage", "documents", lambda d: Q.token_coverage(pairs(d)).select("doc_id", F.round("coverage", 9).alias("coverage")), f"SELECT doc_id, round(CASE WHEN total < 5 THEN 1.0::DOUBLE ELSE matched / total END, 9) AS coverage FROM ({coverage_sql(CHANGED)})")
HALF = "left(text, length(text) // 2)"
G.add("q13_token_coverage_halved", "documents", lambda d: Q.token_coverage(d.select("doc_id", F.col("text").alias("source"), F.left("text", (F.length("text") / 2).cast("int")).alias("output"))).select("doc_id", "matched", "total"), coverage_sql(HALF))


def kept_cells(l: DataFrame) -> DataFrame:
    """Cells of orders, each once or twice as its line number is even or odd, and outputs that lack those of third lines."""
    cells = l.select(F.col("l_orderkey").alias("doc_id"), F.explode(F.array_repeat(F.concat(F.lit("k"), F.col("l_linenumber").cast("string"), F.lit("x"), F.col("l_returnflag")), (F.col("l_linenumber") % 2 + 1).cast("int"))).alias("cell"))
    shown = F.when(F.col("l_linenumber") % 3 != 0, F.concat(F.lit("K-"), F.col("l_linenumber").cast("string"), F.lit("X "), F.lower("l_returnflag")))
    outputs = l.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.sort_array(F.collect_list(shown)), " | ").alias("output"))
    return Q.cell_retention(cells, outputs).select("doc_id", F.round("by_count", 9).alias("by_count"), F.round("by_characters", 9).alias("by_characters"))


G.add("q14_cell_retention", "lineitem", kept_cells,
      """SELECT doc_id, round(sum(least(n, had)) / sum(n), 9) AS by_count, round(sum(least(n, had) * 4) / sum(n * 4), 9) AS by_characters FROM (
      SELECT l_orderkey AS doc_id, l_linenumber, l_returnflag, count(*) * (l_linenumber % 2 + 1) AS n, count(*) FILTER (l_linenumber % 3 <> 0) AS had FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1""")
WORDS4 = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: length(x) >= 4))"
G.add("q15_source_anchor", "documents", lambda d: pairs(d).select("doc_id", Q.source_anchor(F.col("source"), F.concat(F.lit("zzzz "), F.when(F.col("doc_id") % 3 != 0, F.col("output")).otherwise(F.regexp_replace("output", r"[A-Za-z]{4}", "q")))).alias("anchored")),
      f"SELECT doc_id, len({WORDS4.format('text')}) < 8 OR list_has_any({WORDS4.format('text')}, {WORDS4.format('o')}) AS anchored FROM (SELECT doc_id, text, 'zzzz ' || CASE WHEN doc_id % 3 <> 0 THEN {CHANGED} ELSE regexp_replace({CHANGED}, '[A-Za-z][A-Za-z][A-Za-z][A-Za-z]', 'q', 'g') END AS o FROM documents)")
G.add("q16_apply_text_model", "documents", lambda d: Q.apply_text_model(d, lambda t: t[: max(1, len(t) * 2 // 3)], lambda s, o: len(o) * 2 <= len(s) + 2).select("doc_id", F.length("output").alias("n"), "tries"),
      "SELECT doc_id, CAST(CASE WHEN a * 2 <= n + 2 THEN a WHEN b * 2 <= n + 2 THEN b END AS INTEGER) AS n, CASE WHEN a * 2 <= n + 2 THEN 1 ELSE 2 END AS tries FROM (SELECT *, least(a, greatest(1, a * 2 // 3)) AS b FROM (SELECT doc_id, length(text) AS n, least(length(text), greatest(1, length(text) * 2 // 3)) AS a FROM documents))")
G.add("q17_latin_target_gate", "documents", lambda d: d.select("doc_id", Q.latin_target_ok(F.length(F.regexp_replace("text", r"[^\p{L}]", "")), Q.words_of(F.col("text")), (F.col("doc_id") % 10) / 10, F.lit(0.5)).alias("fine")),
      r"SELECT doc_id, NOT (length(regexp_replace(text, '[^\p{L}]', '', 'g')) >= 120 AND len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) >= 20 AND doc_id % 10 >= 8) AS fine FROM documents")
G.add("q18_citation_coverage", "lineitem", lambda l: Q.citation_coverage(l.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("unit_id")), l.where("l_linenumber % 3 <> 0").select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_linenumber") == 5, 99).otherwise(F.col("l_linenumber")).alias("unit_id"))),
      "SELECT doc_id, CAST(sum(m) AS BIGINT) AS missing, CAST(sum(i) AS BIGINT) AS invented FROM (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS u, 1 AS m, 0 AS i FROM lineitem WHERE l_linenumber % 3 = 0 OR l_linenumber = 5 UNION ALL SELECT DISTINCT l_orderkey, 99, 0, 1 FROM lineitem WHERE l_linenumber = 5) GROUP BY 1")
SQUEEZED = r"' ' || trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' '"
G.add("q19_missing_paragraphs", "documents", lambda d: Q.missing_paragraphs(pairs(d)).select("doc_id", "pos", F.sha2("paragraph", 256).alias("digest")),
      f"""SELECT doc_id, CAST(pos AS INTEGER) AS pos, sha256(p) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, w ORDER BY pos) AS n FROM (SELECT doc_id, o, p, pos, {SQUEEZED.format('p')} AS w FROM (
      SELECT doc_id, o, unnest(l) AS p, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, {SQUEEZED.format(CHANGED)} AS o, regexp_split_to_array(text, '\\n+') AS l FROM documents))) WHERE trim(w) <> '' AND NOT contains(o, w)) WHERE n = 1""")


# Classification


def named(d: DataFrame) -> DataFrame:
    return d.select("doc_id", "text", F.concat("source", F.lit("_license.txt")).alias("filename"))


def _phrases(text: str, phrases: list[str]) -> str:
    return f"len(list_filter([{', '.join(repr(f' {p} ') for p in phrases)}], lambda p: contains({text}, p)))"


def privacy_sql() -> str:
    """SQL: the same scores over the same table of phrases, on texts whose letters fold alike in both engines."""
    found = []
    for rank, (name, strong, support) in enumerate(C.PRIVACY_TYPES):
        s, p, f = _phrases("plain", strong), _phrases("plain", support), _phrases("name", [name.replace("_", " "), *strong])
        open_ = "s > 0 OR p >= 2" if name == "correspondence" else "s > 0"
        if name == "academic_certificate":
            open_ += " OR (" + " AND ".join(f"{_phrases('plain', x)} > 0" for x in C.CERTIFICATE) + ")"
        veto = f" AND {_phrases('plain', C.VETOES[name])} = 0" if name in C.VETOES else ""
        found.append(f"SELECT k, doc_id, {rank} AS rank, '{name}' AS type, CASE WHEN ok THEN 6.0 * least(s, 4) + 1.75 * least(p, 7) + least(f, 2) ELSE 0 END AS score, CASE WHEN ok THEN s + p + f ELSE 0 END AS signals FROM (SELECT *, ({open_}){veto} AS ok FROM (SELECT *, {s} AS s, {p} AS p, {f} AS f FROM n))")
    folded = lambda c: f"' ' || trim(regexp_replace(lower(strip_accents({c})), '[^a-z0-9]+', ' ', 'g')) || ' '"
    return f"""SELECT * FROM (WITH n AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, {folded('text')} AS plain, {folded('filename')} AS name FROM (SELECT doc_id, text, source || '_license.txt' AS filename FROM documents UNION ALL SELECT doc_id, text, 'id.txt' FROM forms)),
    a AS ({' UNION ALL '.join(found)}), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, signals DESC, rank) AS place FROM a)
    SELECT t.doc_id, CASE WHEN t.score < 4 OR (u.score >= 4 AND t.score - u.score < 1.5) THEN 'general_document' ELSE t.type END AS document_type,
    round(CASE WHEN t.score <= 0 THEN 0.2 ELSE least(0.99, 0.48 + 0.30 * least(1.0, t.score / 20) + 0.17 * greatest(0.0, least(1.0, (t.score - u.score) / greatest(t.score, 1.0))) + 0.05 * least(1.0, t.signals / 5)) END::DOUBLE, 6) AS confidence
    FROM r t JOIN r u ON u.k = t.k AND u.place = 2 WHERE t.place = 1)"""


G.add("c1_classify_privacy_type", "documents forms", lambda d, f: C.privacy_type(named(d).unionByName(f.select("doc_id", "text", F.lit("id.txt").alias("filename")))).withColumn("confidence", F.round("confidence", 6)), privacy_sql())
G.add("c2_classification_confidence", "lineitem", lambda l: l.select("l_orderkey", "l_linenumber", C.confidence(F.col("l_quantity"), F.col("l_quantity") * F.col("l_discount") * 5, F.col("l_linenumber")).alias("confidence")),
      "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 0 THEN 0.2 ELSE least(0.99, 0.48 + 0.30 * least(1.0, l_quantity / 20) + 0.17 * greatest(0.0, least(1.0, (l_quantity - l_quantity * l_discount * 5) / greatest(l_quantity, 1.0))) + 0.05 * least(1.0, l_linenumber / 5)) END AS confidence FROM lineitem")
WORDS_SQL = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))"
G.add("c4_question_scale", "documents", C.question_scale, f"SELECT doc_id, CAST(w AS INTEGER) AS words, CASE WHEN w <= 500 THEN 'small' WHEN w <= 2000 THEN 'medium' ELSE 'large' END AS scale, CASE WHEN w <= 500 THEN 5 WHEN w <= 2000 THEN 10 ELSE 20 END AS least, CASE WHEN w <= 500 THEN 10 WHEN w <= 2000 THEN 20 ELSE 40 END AS most FROM (SELECT doc_id, {WORDS_SQL} AS w FROM documents)")
G.add("j10_range_band", "documents", lambda d: C.question_scale(d).groupBy("scale").agg(F.count("*").alias("n")), f"SELECT CASE WHEN w <= 500 THEN 'small' WHEN w <= 2000 THEN 'medium' ELSE 'large' END AS scale, count(*) AS n FROM (SELECT {WORDS_SQL} AS w FROM documents) GROUP BY 1")
G.add("c5_observed_scripts", "documents", lambda d: d.select("doc_id", F.array_join(C.observed_scripts(F.concat("text", F.when(F.col("doc_id") % 3 == 0, " слово").otherwise(" о"))), ",").alias("scripts")),
      r"SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, '\p{Latin}') THEN 'Latin' END, CASE WHEN doc_id % 3 = 0 THEN 'Cyrillic' END, CASE WHEN regexp_matches(text, '\p{Greek}') THEN 'Greek' END, CASE WHEN regexp_matches(text, '\p{Han}') THEN 'Han' END) AS scripts FROM documents")


def by_letters(section: str) -> dict[str, float]:
    marks = {"fr": "éèêçà", "de": "äöüß", "es": "ñóíá"}
    n = {k: sum(section.count(c) for c in v) for k, v in marks.items()}
    total = sum(n.values())
    return {k: v / total for k, v in n.items() if v} if total >= 3 else {"en": 0.9}


G.add("c6_section_languages", "documents", lambda d: C.section_languages(d, by_letters).select("doc_id", F.array_join("languages", ",").alias("languages")))
G.add("c7_is_calculation_question", "conversations", lambda c: c.select("conv_id", "turn", Q.is_calculation(F.concat("text", F.when(F.col("turn") % 2 == 0, " 5 kg").otherwise(" how"))).alias("calculation")), "SELECT conv_id, turn, turn % 2 = 0 AS calculation FROM conversations")

# Timed words


def payloads(c: DataFrame) -> DataFrame:
    word = F.transform(F.split(F.regexp_replace("text", r"\s+", " "), " "), lambda w, i: F.struct(w.alias("word"), (i * 0.4 + F.floor(i / 20)).alias("start"), (i * 0.4 + F.floor(i / 20) + 0.3).alias("end"), (F.col("turn") % 2).cast("int").alias("speaker")))
    made = F.to_json(F.struct(F.struct(F.array(F.struct(F.array(F.struct(F.col("text").alias("transcript"), word.alias("words"))).alias("alternatives"))).alias("channels")).alias("results")))
    return c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("media_id"), made.alias("payload"))


def media_words(c: DataFrame) -> DataFrame:
    return W.explode_words(payloads(c))


G.add("w1_explode_words", "conversations", lambda c: media_words(c).groupBy("media_id").agg(F.count("*").alias("words"), F.round(F.max("end_s"), 3).alias("end_s")),
      r"SELECT conv_id || '-' || turn AS media_id, count(*) AS words, round(max((n - 1) * 0.4 + floor((n - 1) / 20) + 0.3), 3) AS end_s FROM (SELECT conv_id, turn, generate_subscripts(w, 1) AS n, unnest(w) AS x FROM (SELECT conv_id, turn, string_split(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS w FROM conversations)) WHERE x <> '' GROUP BY 1")


def by_conversation(c: DataFrame) -> DataFrame:
    turn = F.element_at(F.split("media_id", "-"), 2).cast("int")
    return media_words(c).withColumn("start_s", F.col("start_s") + turn * 1000).withColumn("end_s", F.col("end_s") + turn * 1000).withColumn("media_id", F.element_at(F.split("media_id", "-"), 1))


G.add("w2_speaker_blocks", "conversations", lambda c: W.speaker_blocks(by_conversation(c)).groupBy("media_id").agg(F.count("*").alias("blocks")),
      "SELECT CAST(conv_id AS VARCHAR) AS media_id, CAST(sum(c) AS BIGINT) AS blocks FROM (SELECT conv_id, CASE WHEN turn % 2 = lag(turn % 2) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS c FROM conversations) GROUP BY 1")
G.add("w3_choose_transcript", "conversations", lambda c: c.select("conv_id", "turn", F.length(W.choose_transcript(F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Speaker: "), "text")), F.col("text"), F.when(F.col("turn") % 3 == 1, F.col("text")))).alias("n")),
      "SELECT conv_id, turn, length(text) + CASE WHEN turn % 3 = 0 THEN 9 ELSE 0 END AS n FROM conversations")
G.add("w4_subtitle_cues", "conversations", lambda c: W.subtitle_cues(media_words(c)))

# Sources

G.add("s5_html_visible_text", "pages", lambda p: S.html_visible_text(p))


def tokens(d: DataFrame) -> DataFrame:
    """Words of documents as recognised tokens, ten a line."""
    words = d.select("doc_id", F.posexplode(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")).alias("i", "text"))
    n = F.col("i") % 10
    return words.select("doc_id", (F.floor(F.col("i") / 200) + 1).cast("int").alias("page"), F.lit(1).alias("block"), F.floor(F.col("i") / 10).cast("int").alias("line"), F.col("i").alias("n"), "text", (n * 60.0 + F.when(n >= 5, 200.0).otherwise(0.0)).alias("left"), (F.floor(F.col("i") / 10) * 20.0).alias("top"), F.lit(50.0).alias("width"), F.lit(12.0).alias("height"), (F.col("i") % 2).cast("int").alias("pass"), (F.length("text") * 3.0 % 97).alias("conf"))


G.add("s6_ocr_tokens_to_text", "documents", lambda d: S.tokens_to_text(tokens(d)).select("doc_id", F.sha2("text", 256).alias("digest")),
      r"SELECT doc_id, sha256(string_agg(l, chr(10) ORDER BY k)) AS digest FROM (SELECT doc_id, (n - 1) // 10 AS k, string_agg(w, ' ' ORDER BY n) AS l FROM (SELECT doc_id, generate_subscripts(a, 1) AS n, unnest(a) AS w FROM (SELECT doc_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS a FROM documents)) WHERE w <> '' GROUP BY 1, 2) GROUP BY 1")
G.add("s7_ocr_tokens_to_grid", "documents", lambda d: S.tokens_to_grid(tokens(d)))
G.add("s8_ocr_pass_quality", "documents", lambda d: S.best_pass(tokens(d)).select("doc_id", F.round("score", 3).alias("score")),
      r"SELECT doc_id, round(max(s), 3) AS score FROM (SELECT doc_id, n % 2 AS p, sum(c * a) / greatest(sum(a), 1) * ln(1 + sum(a)) AS s FROM (SELECT doc_id, n, length(regexp_replace(w, '[^\p{L}\p{N}]', '', 'g')) AS a, length(w) * 3 % 97 AS c FROM (SELECT doc_id, generate_subscripts(x, 1) - 1 AS n, unnest(x) AS w FROM (SELECT doc_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS x FROM documents))) GROUP BY 1, 2) GROUP BY 1")


def read_back(b: DataFrame) -> DataFrame:
    """The passages written as text files, one each, and read as a corpus."""
    root = folder(b.sparkSession, "corpus")
    S.write_text_corpus(b, root, "item_id", "text")
    rows = S.read_text_corpus(b.sparkSession, f"{root}/*/*.txt")
    return rows.select(F.regexp_extract("path", r"item_id=(\d+)", 1).cast("long").alias("item_id"), F.sha2("text", 256).alias("digest"), "checksum", "words")


G.add("s1_read_text_corpus", "benchmark", read_back,
      r"SELECT item_id, sha256(regexp_replace(regexp_replace(coalesce(text, ''), '^\s+', ''), '\s+$', '')) AS digest, sha256(coalesce(text, '') || chr(10)) AS checksum, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> ''))::INTEGER AS words FROM benchmark")


def exported(o: DataFrame) -> DataFrame:
    """Orders exported as csv and read again: cells that a spreadsheet would run are told."""
    root = folder(o.sparkSession, "export")
    cell = F.element_at(F.array(F.concat(F.lit("=1+"), F.col("o_orderkey").cast("string")), F.lit(' +x, "y"'), F.col("o_orderpriority"), F.lit("@sum")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    S.write_business_table(o.select("o_orderkey", cell.alias("cell"), "o_totalprice"), root, "csv")
    return o.sparkSession.read.schema("o_orderkey long, cell string, o_totalprice double").option("header", True).csv(root)


G.add("s11_write_business_csv", "orders", exported,
      """SELECT o_orderkey, [chr(39) || '=1+' || o_orderkey, chr(39) || ' +x, "y"', o_orderpriority, chr(39) || '@sum'][o_orderkey % 4 + 1] AS cell, o_totalprice FROM orders""")
G.add("s9_table_scan", "orders", lambda o: o.where("o_orderstatus = 'F' and o_totalprice > 100000").select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
G.add("s10_json_payload", "events", lambda e: e.select("event_id", *S.json_fields(F.col("props"), {"k": "string"})), "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
