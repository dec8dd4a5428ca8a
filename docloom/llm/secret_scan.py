"""Secrets in texts, and who owns them: patterns give candidates, their spread over repositories and owners a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, pick, table, with_key_value

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: The same matches as [0-9a-f]+ of 24 and more, as a run has no other start.
HEX = r"[0-9a-f]{24,}"
#: A loose credential: a long run of key characters that holds a digit.
LOOSE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+"
KINDS = ("assign", "access", "hex", "live")
#: A value of so many distinct owners is a copied example, and so is one of several owners in so many distinct repositories; one owner's is live, however many repositories it is in.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 4


def _found(text: Column, pattern: str, kind: str, value_group: int = 0, least: int = 0) -> Column:
    """Spans of all matches, in code points: the gaps between the matches give their places."""

    def spans(t: Column) -> Column:
        zipped = F.arrays_zip(F.split(t, pattern, -1).alias("gap"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("hit"), F.regexp_extract_all(t, F.lit(pattern), F.lit(value_group)).alias("value"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            begin = acc["at"] + F.length(x["gap"])
            end = begin + F.length(x["hit"])
            span = F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), F.xxhash64(x["value"]).alias("value"))
            keep = F.length(x["value"]) >= least
            return F.struct(F.coalesce(end, acc["at"]).alias("at"), F.when(keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(zipped, start, step, lambda acc: acc["out"])

    return F.when(text.rlike(pattern), spans(text)).otherwise(F.array().cast(SPANS))


SPANS = "array<struct<start:int,rank:int,end:int,value:bigint>>"


def candidates(text: Column) -> Column:
    """Struct (base, loose) of the spans of a text. Null text: none."""
    text = F.coalesce(text, F.lit(""))
    assign, access, hexes = _found(text, ASSIGN, "assign", 1, 6), F.filter(_found(text, ACCESS, "access"), lambda s: s["end"] - s["start"] >= 20), _found(text, HEX, "hex")
    return F.struct(assign.alias("assign"), access.alias("access"), hexes.alias("hex"), _found(text, LOOSE, "live").alias("loose"))


def _apart(spans: str, others: str) -> Column:
    return F.filter(spans, lambda s: ~F.exists(others, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"])))


def scan(rows: DataFrame) -> DataFrame:
    """Spans of rows (.., text): n_assign, n_access, n_hex, base and loose replace the text."""
    found = rows.withColumn("_f", candidates(F.col("text"))).drop("text")
    counts = [F.size(f"_f.{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    others = [F.col(c) for c in found.columns if c != "_f"]
    found = found.select(*others, *counts, F.array_sort(F.concat("_f.assign", "_f.access", "_f.hex")).alias("base"), F.col("_f.loose").alias("loose"))
    return found.withColumn("loose", _apart("loose", "base"))


def repository(owner: Column, lang: Column) -> Column:
    """The repository of a document: an owner keeps one per language."""
    return F.concat_ws("/", F.coalesce(owner, F.lit("")), F.coalesce(lang, F.lit("")))


def ownership(found: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """Rows (row, span, n_owners, n_repos, live) for all spans of rows (row, repo, owner, base, loose).

    Values are hashed and counted by distinct repositories and owners over the whole corpus:
    first per value, owner and repository, which removes the copies, then per value. A value is a
    copied example if it has ``example_owners`` owners, or several and ``example_repos``
    repositories; else it is live. Null owners count as one owner. A value that a third of the
    rows hold is counted and handed back in salted parts.
    """
    each = found.select("row", "repo", "owner", F.explode(F.concat("base", "loose")).alias("span")).withColumn("value", F.col("span.value"))
    known = each.groupBy("value", F.coalesce(F.concat(F.lit("o"), "owner"), F.lit("")).alias("owner"), F.coalesce(F.concat(F.lit("r"), "repo"), F.lit("")).alias("repo")).agg(F.count("*").alias("n"))
    owners = known.groupBy("value", "owner").agg(F.count("*").alias("repos"))
    spread = owners.groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"))
    salt = F.pmod(F.xxhash64("row"), F.lit(64)).cast("int")
    carried = each.groupBy("value", salt.alias("salt")).agg(F.count("*").alias("n")).join(spread, "value").select("value", "salt", "n_owners", "n_repos")
    out = each.withColumn("salt", salt).join(carried, ["value", "salt"])
    copied = (F.col("n_owners") >= example_owners) | ((F.col("n_owners") > 1) & (F.col("n_repos") >= example_repos))
    return out.select("row", "span", "n_owners", "n_repos", (~copied).alias("live"))


def _digest(spans: Column) -> Column:
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: base spans and verdicts of all documents; the owner of a document is its source, with a repository per language.

    ``spans`` has the base spans and, as kind live, loose credentials of few owners that touch no
    base span. n_live and n_example count base and loose values by verdict. Repeated rows are
    scanned and returned each; a null text has no span.
    """
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text", owner="source", lang="lang").withColumn("repo", repository(F.col("owner"), F.col("lang"))).drop("lang")
    found = Scratch(spark, "op4").write(scan(docs).withColumn("row", F.monotonically_increasing_id()), "found")
    told = ownership(found).groupBy("row").agg(
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_example"),
        F.collect_list(F.when(F.col("live") & (F.col("span.rank") == KINDS.index("live")), F.col("span"))).alias("more"),
    )
    out = found.join(told, "row", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(SPANS))))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_digest(F.col("base")), 256).alias("base_sha256"), _digest(spans).alias("spans"), zero("n_live"), zero("n_example"))


def redact_live(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """Documents with every live secret replaced by ``mark``; copied examples stay, and so do all rows and columns.

    Only documents with a candidate are joined with the verdicts; the others pass by. A key of id
    and text joins them, so repeated rows fare alike.
    """
    spark, names = docs.sparkSession, docs.columns
    rows = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    at = {n: F.col(f"_c{names.index(n)}") for n in ("doc_id", "text", "source", "lang")}
    rows = rows.withColumn("_key", F.xxhash64(F.coalesce(at["doc_id"].cast("string"), F.lit("")), at["text"]))
    text = F.coalesce(at["text"], F.lit(""))
    suspect = text.rlike(ASSIGN) | text.rlike(ACCESS) | text.rlike(HEX) | text.rlike(LOOSE)
    few = rows.where(suspect)
    found = scan(few.select(F.col("_key").alias("row"), repository(at["source"], at["lang"]).alias("repo"), at["source"].alias("owner"), text.alias("text")))
    found = Scratch(spark, "secrets").write(found.select("row", "repo", "owner", "base", "loose"), "found")
    live = ownership(found).where("live").groupBy("row").agg(F.array_sort(F.collect_set("span")).alias("cuts"))
    changed = few.join(live, few["_key"] == live["row"], "left")
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, piece).otherwise(acc["out"]).alias("out"))

    cleaned = F.aggregate("cuts", begin, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.lit(2**31 - 1))))
    cleaned = F.when(F.col("cuts").isNull(), at["text"]).otherwise(cleaned)
    columns = [(cleaned if n == names.index("text") else F.col(f"_c{n}")).alias(f"_c{n}") for n in range(len(names))]
    return rows.where(~suspect).drop("_key").unionByName(changed.select(*columns)).toDF(*names)
