"""Fill-in-middle: a document is cut at two ranks of its units and its parts change places between marks.

The ranks count units (lines), the cuts are made at code points. An indexable skip list carries
both widths: every lane's step says how many units and how many code points it goes past, so a
descent from the express lane by accumulated units reaches a rank and knows its code point.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.frames import small_batches
from docloom.llm.common import pick, table

#: Marks of the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")


def line_widths(text: str) -> list[int]:
    """Code points of each line with its end."""
    widths = [len(x) + 1 for x in text.split("\n")]
    widths[-1] -= 1
    return widths if widths[-1] else widths[:-1]


def word_widths(text: str) -> list[int]:
    """Code points of each word with the blanks behind it; blanks before the first word are a unit."""
    return [len(x) for x in re.findall(r"\S+\s*|\s+", text)]


def character_widths(text: str) -> list[int]:
    return [1] * len(text)


UNITS: dict[str, Callable[[str], list[int]]] = {"line": line_widths, "word": word_widths, "character": character_widths}


class Lanes:
    """An indexable skip list of units: lane 0 has a step per unit, and about every fourth node of a lane is on the next.

    A lane holds, for each of its nodes, the step to the node behind it as (units, code points), and
    where the node stands on the lane below. A node's height is a fixed hash of its place, so equal
    texts have equal lanes.
    """

    EVERY = 4

    def __init__(self, widths: Iterable[int]):
        widths = np.fromiter(widths, np.int64)
        ends = np.concatenate(([0], np.cumsum(widths)))
        self.n, self.code_points = len(widths), int(ends[-1])
        coins = (np.arange(self.n + 1, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        coins = (coins ^ (coins >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)
        #: From the express lane down: units of each step, its code points, and the node's place on the lane below.
        self.lanes: list[tuple[list[int], list[int], list[int]]] = []
        nodes, below, share = np.arange(self.n), np.zeros(0, np.int64), 1
        while len(nodes):
            bounds = np.append(nodes, self.n)
            self.lanes.insert(0, (np.diff(bounds).tolist(), np.diff(ends[bounds]).tolist(), below.tolist()))
            share *= self.EVERY
            up = (coins[nodes] % np.uint64(share)) == 0
            up[0] = True  # the head is on every lane
            below = np.flatnonzero(up)
            nodes = nodes[below] if len(below) < len(nodes) else nodes[:0]

    def reach(self, rank: int) -> tuple[int, int, int]:
        """The units and code points before a rank, and the steps that it took to get there."""
        units = points = at = steps = 0
        for of_units, of_points, below in self.lanes:
            while at < len(of_units) and units + of_units[at] <= rank:
                units, points, at, steps = units + of_units[at], points + of_points[at], at + 1, steps + 1
            if units == rank:
                break
            at = below[at] if below else at
        return units, points, steps


def cuts(text: str, h1: int, h2: int, widths: Callable[[str], list[int]] = line_widths) -> tuple[int, int, int]:
    """The number of units and the code points of both cuts, whose ranks are the hashes modulo one more than that."""
    lanes = Lanes(widths(text))
    ranks = sorted((h1 % (lanes.n + 1), h2 % (lanes.n + 1)))
    return lanes.n, lanes.reach(ranks[0])[1], lanes.reach(ranks[1])[1]


def check_marks(marks: tuple[str, str, str]) -> None:
    """Marks must differ and none may begin with the end of another, else a text could form a mark with one."""
    ends = {m[-k:] for m in marks for k in range(1, len(m))}
    if len(set(marks)) < 3 or not all(marks) or any(m[:k] in ends for m in marks for k in range(1, len(m))) or any(a != b and a in b for a in marks for b in marks):
        raise ValueError(f"marks {marks} can be confused")


def hashes(key: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 of a key, from the digest of ``seed:key``; a null key counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def infill(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, unit: str = "line", marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Rows (doc_id, n, form, prefix_chars, middle_chars, output), one per row of documents.

    ``rate`` per cent of the texts are transformed, ``spm`` per cent of these with the suffix before
    the prefix. The parts may be empty. Null and empty texts, and texts that hold a mark, stay plain
    (a null text is an empty one), with null widths. Rows alike in id and text give rows alike; a null id is
    hashed as an empty string. Only the cuts are found in Python; texts stay where they are.
    """
    check_marks(marks)
    small_batches(docs.sparkSession)
    widths = UNITS[unit]

    @F.pandas_udf("n long, first long, second long")
    def cut(text: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([cuts(*x, widths) for x in zip(text, h1, h2)], columns=["n", "first", "second"]).astype("int64")

    h1, h2, h3, h4 = hashes(F.col("doc_id"), seed)
    rows = pick(docs, doc_id="doc_id", text="text").withColumn("text", F.coalesce("text", F.lit("")))
    text = F.col("text")
    plain = (text == "") | text.contains(marks[0]) | text.contains(marks[1]) | text.contains(marks[2]) | (h3 % 100 >= rate)
    form = F.when(plain, "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", form.alias("form"), cut("text", h1, h2).alias("c"))
    rows = rows.select("doc_id", "text", "form", F.col("c.n").alias("n"), F.col("c.first").alias("a"), F.col("c.second").alias("b"))
    part = lambda start, end: text.substr((start + 1).cast("int"), (end - start).cast("int"))
    prefix, middle, suffix = part(F.lit(0), F.col("a")), part(F.col("a"), F.col("b")), part(F.col("b"), F.length(text))
    p, s, m = map(F.lit, marks)
    output = F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    shown = F.col("form") != "plain"
    return rows.select("doc_id", "n", "form", F.when(shown, F.col("a")).alias("prefix_chars"), F.when(shown, F.col("b") - F.col("a")).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text of an output: its parts between the marks, put back in order."""
    check_marks(marks)
    p, s, m = map(F.lit, marks)
    behind = lambda x, mark: F.substr(x, F.position(mark, x) + F.length(mark))
    before = lambda x, mark: F.left(x, F.position(mark, x) - 1)
    rest = behind(output, m)
    psm = F.concat(before(behind(output, p), s), rest, before(behind(output, s), m))
    spm = F.concat(before(behind(output, p), m), rest, before(behind(output, s), p))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digests(made: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Outputs as digests, with that of the text rebuilt from each."""
    again = restore(F.col("output"), F.col("form"), marks)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(infill(table(spark, sf_dir, "documents")))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS l, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, CAST(len(l) AS BIGINT) AS n, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS a, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS b FROM u),
p AS (SELECT *, coalesce(array_to_string(list_slice(l, 1, a), ''), '') AS pre, coalesce(array_to_string(list_slice(l, a + 1, b), ''), '') AS mid, coalesce(array_to_string(list_slice(l, b + 1, len(l)), ''), '') AS suf,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
