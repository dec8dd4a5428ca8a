"""Versioned rule packs and the screening of documents against them, with evidence."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.frames import map_frames
from docloom.operators.phrases import Phrases

RULE = """rule_id string, version string, title string, regulatory_domain string, strategy string, search_mode string, case_sensitive boolean, excerpt_window int,
max_matches int, min_count int, on_missing string, on_partial string, on_prohibited string, required array<string>, optional array<string>, prohibited array<string>, actions array<string>"""
# Status words and their aliases, strategies, search modes, order of severity, limits.
ALIASES = {"passed": "evidence_found", "pass": "evidence_found", "failed": "risk_detected", "fail": "risk_detected", "missing": "evidence_missing", "review_required": "requires_review"}
STATUSES = ("risk_detected", "evidence_missing", "warning", "requires_review", "evidence_found")
STRATEGIES = ("any_signal_presence", "all_signal_presence", "absent_signals", "min_signal_count")
MODES = ("substring", "exact_phrase", "word", "regex")
MOST_SIGNALS, MOST_RULES, MOST_RUN_SIGNALS, MOST_CHARS = 100, 5_000, 50_000, 25_000_000
CORE_PACK = "core_control_library"
FINAL_ACTION = "After making changes, have a qualified person validate the document and supporting evidence for the selected jurisdiction."
PACK_SCHEMA = (
    "pack_id string, version string, metadata struct<legal_review:struct<status:string,reviewed_by:string,reviewed_at:string,review_due_at:string>,legal_sources:array<string>>, "
    "rules array<struct<rule_id:string,version:string,title:string,summary:string,regulatory_domain:string,evaluation:struct<strategy:string,search_mode:string,case_sensitive:boolean,excerpt_window:int,"
    "max_matches_per_signal:int,min_count:int,on_missing:string,on_partial:string,on_prohibited_match:string,required_signals:array<string>,optional_signals:array<string>,prohibited_signals:array<string>,signals:array<string>>,"
    "metadata:struct<recommended_actions:array<string>>>>"
)


def load_rule_packs(spark: SparkSession, path: str) -> DataFrame:
    """A row per rule of the JSON packs under <path>/<jurisdiction>/<sector>/vYYYY_MM.json."""
    packs = spark.read.schema(PACK_SCHEMA).option("multiLine", True).json(f"{path}/*/*/*.json").withColumn("file", F.input_file_name())
    part = lambda n: F.element_at(F.split("file", "/"), n)
    rows = packs.select(part(-3).alias("jurisdiction"), part(-2).alias("sector"), F.regexp_replace(part(-1), r"\.json$", "").alias("pack_version"), F.col("metadata").alias("pack_metadata"), F.explode("rules").alias("r"))
    e = F.col("r.evaluation")
    return rows.select(
        "jurisdiction", "sector", "pack_version", "pack_metadata", "r.rule_id", "r.version", "r.title", "r.regulatory_domain", e["strategy"].alias("strategy"), F.coalesce(e["search_mode"], F.lit("substring")).alias("search_mode"),
        F.coalesce(e["case_sensitive"], F.lit(False)).alias("case_sensitive"), F.coalesce(e["excerpt_window"], F.lit(160)).alias("excerpt_window"), F.coalesce(e["max_matches_per_signal"], F.lit(5)).alias("max_matches"), e["min_count"].alias("min_count"),
        e["on_missing"].alias("on_missing"), e["on_partial"].alias("on_partial"), e["on_prohibited_match"].alias("on_prohibited"), F.coalesce(e["required_signals"], e["signals"], F.array()).alias("required"),
        F.coalesce(e["optional_signals"], F.array()).alias("optional"), F.coalesce(e["prohibited_signals"], F.array()).alias("prohibited"), F.coalesce("r.metadata.recommended_actions", F.array()).alias("actions"),
    )


def latest_versions(packs: DataFrame, version: str | None = None) -> DataFrame:
    """The newest version of each pack (jurisdiction, sector, pack_version), or a given one."""
    rows = packs.select("jurisdiction", "sector", "pack_version").distinct()
    if version is not None:
        return rows.where(F.col("pack_version") == version)
    return rows.groupBy("jurisdiction", "sector").agg(F.max("pack_version").alias("pack_version"))


def canonical_status(c: Column, default: str) -> Column:
    """A status word with its aliases resolved; none is the default."""
    key = F.lower(F.trim(c))
    alias = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return F.when(F.coalesce(key, F.lit("")) == "", default).otherwise(F.coalesce(alias[key], key))


def fold_signals(signals: Column, keep_case: Column) -> Column:
    """Signals trimmed, empty ones dropped, in lower case unless case counts, the first of equals kept."""
    trimmed = F.filter(F.transform(signals, lambda s: F.trim(s)), lambda s: s != "")
    return F.array_distinct(F.transform(trimmed, lambda s: F.when(keep_case, s).otherwise(F.lower(s))))


def normal_rules(rules: DataFrame) -> DataFrame:
    """Rules with folded signals, canonical statuses and bounded numbers."""
    keep = F.col("case_sensitive") | (F.col("search_mode") == "regex")
    rows = rules.withColumns({c: fold_signals(F.col(c), keep) for c in ("required", "optional", "prohibited")})
    rows = rows.withColumns({"on_missing": canonical_status(F.col("on_missing"), "evidence_missing"), "on_partial": canonical_status(F.col("on_partial"), "requires_review"), "on_prohibited": canonical_status(F.col("on_prohibited"), "risk_detected")})
    return rows.withColumns({"excerpt_window": F.greatest(F.lit(40), F.least(F.col("excerpt_window"), F.lit(1000))), "max_matches": F.greatest(F.lit(1), F.least(F.col("max_matches"), F.lit(25))), "min_count": F.coalesce("min_count", F.greatest(F.size("required"), F.lit(1)))})


def rule_issues(rules: DataFrame) -> DataFrame:
    """Issues of each rule (rule_id, issues), an empty array if it is fine."""
    r = normal_rules(rules).withColumn("n_id", F.count("*").over(Window.partitionBy("rule_id")))
    n = F.size("required") + F.size("optional")
    known = lambda c: F.col(c).isin("risk_detected", "warning", "evidence_missing", "requires_review")
    tests = {
        "strategy": ~F.col("strategy").isin(*STRATEGIES),
        "search_mode": ~F.col("search_mode").isin(*MODES),
        "on_missing": ~known("on_missing"),
        "on_partial": ~known("on_partial"),
        "on_prohibited": ~known("on_prohibited") | (F.col("on_prohibited") == "evidence_missing"),
        "too_many_signals": F.greatest(F.size("required"), F.size("optional"), F.size("prohibited")) > MOST_SIGNALS,
        "no_signals": F.when(F.col("strategy") == "absent_signals", F.size("prohibited") == 0).otherwise(n == 0),
        "min_count": (F.col("strategy") == "min_signal_count") & ~F.col("min_count").between(1, F.greatest(n, F.lit(0))),
        "id": ~F.coalesce(F.col("rule_id").rlike(r"^[A-Za-z0-9][A-Za-z0-9_.-]{0,127}$"), F.lit(False)),
        "duplicate_id": F.col("n_id") > 1,
    }
    return r.select("rule_id", F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()])).alias("issues"))


def safe_regex(pattern: str) -> bool:
    """Whether a pattern has no lookbehind, reference or condition, no nested or repeated broad quantifier, and no empty match."""
    if "\x00" in pattern or any(x in pattern for x in ("(?<=", "(?<!", "(?P=", "\\g<", "(?(")) or re.search(r"\\[1-9]", pattern):
        return False
    if re.search(r"\([^)]*(?:[+*]|\{\d[^}]*\})[^)]*\)(?:[+*]|\{)", pattern) or re.search(r"(?:\.\*|\.\+){2,}", pattern) or re.search(r"\([^)]*\|[^)]*\)[+*{]", pattern):
        return False
    try:
        compiled = regex.compile(pattern)
        return not any((m := compiled.search(p, timeout=0.05)) and not m[0] for p in ("", "A", "0", " ", "privacy policy", "test@example.com"))
    except (regex.error, TimeoutError):
        return False


def filter_domains(rules: DataFrame, domains: list[str]) -> DataFrame:
    """Rules of the wanted domains, those of no domain, and the core pack's."""
    return rules.where(F.col("regulatory_domain").isNull() | F.lower("regulatory_domain").isin(domains) | (F.col("sector") == CORE_PACK))


def legal_review_valid(review: Column, sources: Column, now: Column) -> Column:
    """Approved by a named person on sources, in time and not overdue."""
    at, due = F.try_to_timestamp(review["reviewed_at"]), F.try_to_timestamp(review["review_due_at"])
    named = F.trim(F.coalesce(review["reviewed_by"], F.lit(""))) != ""
    sourced = (F.size(sources) > 0) & ~F.exists(sources, lambda s: F.trim(s) == "")
    return F.coalesce((review["status"] == "approved") & named & sourced & (at <= now) & (now < due) & (at < due), F.lit(False))


def expression(signal: str, mode: str) -> str:
    if mode == "regex":
        return signal
    body = r"\s+".join(map(regex.escape, signal.split())) if mode in ("exact_phrase", "word") else regex.escape(signal)
    return rf"(?<!\w){body}(?!\w)" if mode == "word" else body


def excerpt(text: str, start: int, end: int, window: int) -> str:
    cut = " ".join(text[max(0, start - window) : end + window].split())
    return cut if len(cut) <= 400 else cut[:397] + "..."


def heading_like(line: str) -> bool:
    line = " ".join(line.split())
    words = line.split()
    if not line or len(line) > 120:
        return False
    return line.endswith(":") or line.isupper() and len(line) <= 80 or len(words) <= 10 and sum(w[0].isupper() for w in words) >= max(1, len(words) // 2)


class Sections:
    """The lines of a text that aren't blank, indexed once for all matches in it."""

    BACK, LONGEST = 8, 200

    def __init__(self, text: str):
        self.text, self.starts, self.lines, at = text, [], [], 0
        for line in text.splitlines(keepends=True):
            if line.strip():
                self.starts.append(at)
                self.lines.append(line.strip())
            at += len(line)
        self.headings: dict[str, bool] = {}

    def _heading(self, line: str) -> bool:
        if line not in self.headings:
            self.headings[line] = heading_like(line)
        return self.headings[line]

    def label(self, at: int) -> str | None:
        """The nearest heading among the last lines before a place, of which the last may be the beginning of a line."""
        n = bisect_left(self.starts, at)
        open_ = self.text[self.starts[n - 1] : at].splitlines()[:1] if n else []
        last = [open_[0].strip()] if open_ and open_[0].strip() else []
        back = [*last, *reversed(self.lines[max(0, n - 1 - self.BACK) : max(0, n - 1)])][: self.BACK]
        return next((x[: self.LONGEST] for x in back if self._heading(x)), None)


def section_label(text: str, at: int) -> str | None:
    """The nearest heading among the last eight lines that aren't blank."""
    return Sections(text).label(at)


MATCH = "doc_set string, doc_id long, page_number int, signal string, start int, end int, locator string, excerpt string, section string"


def _signal_list(rules: DataFrame) -> list[tuple]:
    """The distinct searches of rules, whose number the limits bound."""
    r = normal_rules(rules).select("search_mode", "case_sensitive", "excerpt_window", "max_matches", F.explode(F.concat("required", "optional", "prohibited")).alias("signal"))
    rows = r.groupBy("signal", "search_mode", "case_sensitive").agg(F.max("excerpt_window").alias("w"), F.max("max_matches").alias("m")).limit(MOST_RUN_SIGNALS + 1).collect()
    if len(rows) > MOST_RUN_SIGNALS:
        raise ValueError("too many signals")
    return [(x["signal"], x["search_mode"], x["case_sensitive"], x["w"], x["m"]) for x in sorted(rows, key=str)]


class Search:
    """The distinct searches of a run, ready for texts: phrases and words in one pass, expressions one by one.

    ``matches`` gives, for each signal, its first matches that don't overlap, as a search of it alone would.
    """

    def __init__(self, signals: list[tuple], timeout: float):
        self.signals, self.timeout = signals, timeout
        compiled = [regex.compile(expression(s, mode), 0 if case else regex.IGNORECASE) for s, mode, case, _, _ in signals]
        self.patterns = {i: p for i, p in enumerate(compiled) if signals[i][1] == "regex"}
        self.together = [i for i in range(len(signals)) if i not in self.patterns]
        self.phrases = Phrases([(signals[i][0], compiled[i]) for i in self.together])

    def matches(self, text: str) -> Iterator[tuple[int, int, int]]:
        """Rows (number of the signal, start, end)."""
        hits = sorted((self.together[i], start, end) for start, end, i in self.phrases.find(text))
        for i, pattern in self.patterns.items():
            hits += ((i, *m.span()) for m in islice(pattern.finditer(text, timeout=self.timeout), self.signals[i][4]))
        signal, n, reach = None, 0, 0
        for i, start, end in hits:
            if i != signal:
                signal, n, reach = i, 0, 0
            if start >= reach and n < self.signals[i][4]:
                n, reach = n + 1, end
                yield i, start, end


def search(pages: DataFrame, rules: DataFrame, timeout: float = 0.2) -> DataFrame:
    """Matches of all signals in rows (doc_set, doc_id, page_number, text), the first of each signal in a page.

    Signals go to the tasks as a bounded list; a text isn't joined with them, and is read once for all
    signals but expressions. A search that takes longer than its time fails the run.
    """
    signals = _signal_list(rules)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
        found = Search(signals, timeout)
        for b in batches:
            rows = []
            for doc_set, doc, page, text in zip(b["doc_set"], b["doc_id"], b["page_number"], b["text"]):
                hits = list(found.matches(text)) if text else []
                sections = Sections(text) if hits else None
                for i, start, end in hits:
                    signal, window, quote = signals[i][0], signals[i][3], text[start:end].strip()
                    if not quote:
                        raise ValueError(f"signal {signal!r} matches nothing")
                    rows.append((doc_set, doc, page, signal, start, end, quote, excerpt(text, start, end, window), sections.label(start)))
            yield rows

    return map_frames(pages.select("doc_set", "doc_id", "page_number", "text"), run, MATCH)


def page_then_document(page_hits: DataFrame, document_hits: DataFrame) -> DataFrame:
    """Hits of pages, and hits of whole documents for signals without one on the document's pages."""
    return page_hits.unionByName(document_hits.join(page_hits.select("doc_id", "signal").distinct(), ["doc_id", "signal"], "left_anti"))


def cap_matches(hits: DataFrame, most: int) -> DataFrame:
    """The first matches of each signal of a set, by document, page and place."""
    w = Window.partitionBy("doc_set", "signal").orderBy("doc_id", F.col("page_number").asc_nulls_last(), "start")
    return hits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max(1, min(most, 25))).drop("_n")


def dedupe_references(hits: DataFrame) -> DataFrame:
    keys = ["doc_set", "doc_id", "page_number", "section", "locator", "excerpt"]
    w = Window.partitionBy(*keys).orderBy("signal", "start")
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def signal_hits(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (doc_set, signal) of substring signals that occur in a set: one pass of an automaton over each text, folded once where it is read."""
    signals = [s for s, mode, case, _, _ in _signal_list(rules) if mode == "substring"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
        found = ahocorasick.Automaton()
        for s in signals:
            found.add_word(s, s)
        if signals:
            found.make_automaton()
        for b in batches:
            yield list({(doc_set, s) for doc_set, text in zip(b["doc_set"], b["low"]) if signals for _, s in found.iter(text or "")})

    return map_frames(docs.select("doc_set", F.lower("text").alias("low")), run, "doc_set string, signal string").distinct()


def _kind(name: str) -> Column:
    return F.transform(name, lambda s: F.struct(F.lit(name).alias("kind"), s.alias("signal")))


def evaluate(rules: DataFrame, hits: DataFrame, sets: DataFrame) -> DataFrame:
    """A row per set and rule: status, matched and missing signals.

    ``hits`` has (doc_set, signal), ``sets`` (doc_set, complete): whether all content could be read.
    Every set meets every rule, as the result has a row for each; a run has MOST_RULES rules at most,
    which bounds what is broadcast. The texts' hits are joined.
    """
    if rules.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError("too many rules")
    r = normal_rules(rules)
    each = r.select("rule_id", F.explode(F.concat(*[_kind(k) for k in ("required", "optional", "prohibited")])).alias("s")).select("rule_id", "s.kind", "s.signal")
    got = hits.select("doc_set", "signal").distinct().join(F.broadcast(each), "signal").groupBy("doc_set", "rule_id")
    of = lambda k: F.sort_array(F.collect_set(F.when(F.col("kind") == k, F.col("signal"))))
    got = got.agg(of("required").alias("m_required"), of("optional").alias("m_optional"), of("prohibited").alias("m_prohibited"))
    rows = sets.crossJoin(F.broadcast(r)).join(got, ["doc_set", "rule_id"], "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("m_required", "m_optional", "m_prohibited")})
    n, need = F.size("m_required"), F.size("required")
    distinct = F.size(F.array_union("m_required", "m_optional"))
    partial = lambda k: F.when(k > 0, F.col("on_partial")).otherwise(F.col("on_missing"))
    status = (
        F.when(F.size("m_prohibited") > 0, F.col("on_prohibited"))
        .when(F.col("strategy") == "any_signal_presence", F.when(n > 0, "evidence_found").otherwise(F.col("on_missing")))
        .when(F.col("strategy") == "all_signal_presence", F.when((need > 0) & (n == need), "evidence_found").otherwise(partial(n)))
        .when(F.col("strategy") == "absent_signals", "requires_review")
        .when(F.col("strategy") == "min_signal_count", F.when(distinct >= F.col("min_count"), "evidence_found").otherwise(partial(distinct)))
    )
    status = F.when((status == "evidence_missing") & ~F.col("complete"), "requires_review").otherwise(status)
    return rows.select("doc_set", "rule_id", status.alias("status"), "m_required", "m_optional", "m_prohibited", F.array_except("required", "m_required").alias("missing"), "actions", "title")


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("doc_set").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def overall(counts: DataFrame, complete: Column, approved: Column) -> DataFrame:
    """What a set needs; a set that is ready is set back if content or approval is lacking."""
    changes = (F.col("risk_detected") + F.col("warning") + F.col("evidence_missing")) > 0
    ready = F.when(complete & approved, "ready_for_final_review").otherwise("manual_review_needed")
    return counts.withColumn("overall", F.when(changes, "changes_recommended").when(F.col("requires_review") > 0, "manual_review_needed").otherwise(ready))


def recommended_actions(results: DataFrame, most: int = 3) -> DataFrame:
    """Actions of each result: those of its rule, else made from its first signals, and a last one to check again."""
    made = (
        F.when(F.col("status") == "risk_detected", F.transform(F.slice("m_prohibited", 1, most), lambda s: F.concat(F.lit("Review or remove: "), s)))
        .when(F.col("status").isin("evidence_missing", "requires_review", "warning"), F.transform(F.slice("missing", 1, most), lambda s: F.concat(F.lit("Add evidence of: "), s)))
        .otherwise(F.array().cast("array<string>"))
    )
    own = F.when(F.size("actions") > 0, F.col("actions")).otherwise(made)
    again = F.when(F.col("status") == "evidence_found", F.array().cast("array<string>")).otherwise(F.array(F.lit("Run the check again after the change.")))
    return results.withColumn("recommended", F.array_distinct(F.concat(own, again)))


def next_steps(results: DataFrame, most: int = 8) -> DataFrame:
    """The first different actions of a set by severity of their results, and a last one."""
    rank = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
    rows = results.where("status <> 'evidence_found'").select("doc_set", rank.alias("rank"), "rule_id", F.posexplode("recommended").alias("pos", "action"))
    first = rows.groupBy("doc_set", "action").agg(F.min(F.struct("rank", "rule_id", "pos")).alias("at"))
    kept = first.withColumn("n", F.row_number().over(Window.partitionBy("doc_set").orderBy("at"))).where(F.col("n") <= most)
    steps = kept.groupBy("doc_set").agg(F.sort_array(F.collect_list(F.struct("n", "action"))).alias("s"))
    return results.select("doc_set").distinct().join(steps, "doc_set", "left").select("doc_set", F.array_join(F.concat(F.coalesce(F.transform("s", lambda x: x["action"]), F.array().cast("array<string>")), F.array(F.lit(FINAL_ACTION))), "\n").alias("steps"))


def quality_warnings(docs: DataFrame) -> DataFrame:
    """Warnings of each set: little text, and texts that look scanned."""
    return docs.groupBy("doc_set").agg(F.count_if(F.length("text") < 100).alias("short"), F.count_if(F.col("ocr_used")).alias("scanned")).select(
        "doc_set", F.array_join(F.array_compact(F.array(F.when(F.col("short") > 0, F.concat(F.col("short").cast("string"), F.lit(" documents have little text"))), F.when(F.col("scanned") > 0, F.lit("recognised text may have errors")))), "; ").alias("warnings")
    )


def report_id(documents: DataFrame, packs: Column, at: Column) -> DataFrame:
    """An id of each set's report from its documents' digests, the packs and the time.

    Equal digests are counted first; those that begin alike are hashed in order to a part, and the
    parts, 4,096 at most, to the id, so no set is gathered whole.
    """
    each = documents.select("doc_set", F.sha2("text", 256).alias("d")).groupBy("doc_set", "d").agg(F.count("*").alias("n"))
    part = F.array_join(F.sort_array(F.collect_list(F.concat_ws("*", "d", "n"))), "|")
    parts = each.groupBy("doc_set", F.left("d", F.lit(3)).alias("at")).agg(F.sha2(part, 256).alias("d"))
    sums = parts.groupBy("doc_set").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "d"))), lambda x: x["d"]), "|").alias("sums"))
    digest = F.sha2(F.concat_ws("|", "sums", packs, at), 256)
    return sums.select("doc_set", F.concat(F.lit("cmp_"), at, F.lit("_"), F.left(digest, F.lit(20))).alias("report_id"))


def within_limits(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules, signals and characters of a run and whether it may start."""
    n = rules.agg(F.count("*").alias("rules"), F.sum(F.size("required") + F.size("optional") + F.size("prohibited")).alias("signals"))
    c = docs.groupBy("doc_set").agg(F.sum(F.length("text")).alias("characters"))
    return c.crossJoin(F.broadcast(n)).withColumn("fits", (F.col("rules") <= MOST_RULES) & (F.col("signals") <= MOST_RUN_SIGNALS) & (F.col("characters") <= MOST_CHARS))


def report_rows(results: DataFrame, status: DataFrame) -> DataFrame:
    """A short text for each set: its state, counts and checks in order."""
    line = F.concat_ws(" - ", "rule_id", "status", "title")
    checks = results.groupBy("doc_set").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("checks"))
    head = F.concat_ws(", ", *[F.concat(F.lit(f"{s}: "), F.col(s).cast("string")) for s in STATUSES])
    return status.join(checks, "doc_set").select("doc_set", F.concat_ws("\n", F.concat(F.lit("Screening of "), "doc_set"), F.concat(F.lit("Overall: "), "overall"), head, "checks").alias("preview"))
