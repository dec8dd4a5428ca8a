"""Text corpora, HTML, recognised tokens and exports."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.frames import map_frames, plain_rows
from docloom.sources.files import arrow_uri, opened


def read_text_corpus(spark: SparkSession, path: str, drop_mark: bool = False) -> DataFrame:
    """Files as rows (path, text, checksum, words); a file that isn't UTF-8 fails the read."""
    raw = spark.read.format("binaryFile").load(path)
    text = F.decode("content", "UTF-8")
    text = F.regexp_replace(text, "^﻿", "") if drop_mark else text
    rows = raw.select("path", F.trim(F.regexp_replace(text, r"^\s+|\s+$", "")).alias("text"), F.sha2("content", 256).alias("checksum"), F.encode(F.decode("content", "UTF-8"), "UTF-8").alias("_again"), "content")
    strict = F.when(F.col("_again") == F.col("content"), F.col("text")).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), "path")))
    return rows.withColumn("text", strict).select("path", "text", "checksum", F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("words"))


def write_text_corpus(rows: DataFrame, path: str, key: str, text: str) -> None:
    """A folder <key>=<value> with a text file for each row; the file ends with a line's end."""
    rows.select(key, F.coalesce(F.col(text), F.lit("")).alias("value")).repartition(key).write.partitionBy(key).text(path)


def write_named(files: DataFrame, root: str) -> DataFrame:
    """Write rows (path, content) to files under a root and list them (path, bytes); a file is replaced whole if a task runs again."""

    arrow_uri(root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = opened(root)
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                system.create_dir(f"{base}/{path}".rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(f"{base}/{path}") as out:
                    out.write(content.encode())
            yield pd.DataFrame({"path": b["path"], "bytes": [len(c.encode()) for c in b["content"]]})

    return map_frames(files.select("path", "content"), run, "path string, bytes long")


class _Visible(HTMLParser):
    SKIPPED = {"script", "style", "head", "template", "noscript"}
    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []
        self.parts: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.VOID:
            return
        a = dict(attrs)
        style = (a.get("style") or "").replace(" ", "").lower()
        hidden = tag in self.SKIPPED or "hidden" in a or "display:none" in style or "visibility:hidden" in style
        self.open.append((tag, hidden))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        if data.strip() and not any(h for _, h in self.open):
            self.parts.append(" ".join(data.split()))


def visible_text(html: str | None) -> str:
    p = _Visible()
    p.feed(html or "")
    p.close()
    return "\n".join(p.parts)


def html_visible_text(pages: DataFrame) -> DataFrame:
    """Rows (page_id, text) of pages: what a reader sees."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"page_id": b["page_id"], "text": [visible_text(h) for h in b["html"]]})

    return map_frames(pages.select("page_id", "html"), run, "page_id long, text string")


def tokens_to_text(tokens: DataFrame) -> DataFrame:
    """Recognised tokens (doc_id, page, block, line, n, text) as text; another page, block or line breaks the line."""
    # gathered once by document: a task has the tokens of a document on end, so few rows are shuffled
    whole = F.sort_array(F.collect_list(F.struct("page", "block", "line", "n", "text")))
    docs = tokens.where("trim(text) <> ''").groupBy("doc_id").agg(whole.alias("_all"))
    place = lambda x: F.struct(x["page"], x["block"], x["line"])
    parts = F.transform("_all", lambda x, i: F.concat(F.when(i == 0, "").when(place(F.get("_all", i - 1)).eqNullSafe(place(x)), " ").otherwise("\n"), x["text"]))
    return docs.select("doc_id", F.array_join(parts, "").alias("text"))


Token = namedtuple("Token", "left top width height text")


def grid_of(tokens: list[Token]) -> list[str]:
    """Lines of tab-separated cells: tokens of one baseline are a line, a wide gap parts cells, and cells stand under anchors."""
    rows: list[list] = []
    for t in sorted(tokens, key=lambda t: (t.top, t.left)):
        middle = t.top + t.height / 2
        row = next((r for r in rows if abs(r[0] - middle) <= t.height * 0.6), None)
        if row is None:
            rows.append([middle, [t]])
        else:
            row[1].append(t)
    widths = [t.width / len(t.text) for t in tokens if t.text]
    gap = max(18.0, 3.5 * sorted(widths)[len(widths) // 2]) if widths else 18.0
    cells = []
    for _, row in sorted(rows, key=lambda r: r[0]):
        line: list[list] = []
        for t in sorted(row, key=lambda t: t.left):
            if line and t.left - line[-1][1] < gap:
                line[-1][1], line[-1][2] = t.left + t.width, f"{line[-1][2]} {t.text}"
            else:
                line.append([t.left, t.left + t.width, t.text])
        cells.append(line)
    anchors: list[float] = []
    for x in sorted(c[0] for line in cells if len(line) > 1 for c in line):
        if not anchors or x - anchors[-1] > gap:
            anchors.append(x)
    out = []
    for line in cells:
        if len(line) < 2 or not anchors:
            out.append("\t".join(c[2] for c in line))
            continue
        slots = [""] * len(anchors)
        for left, _, text in line:
            at = min(range(len(anchors)), key=lambda k: abs(anchors[k] - left))
            slots[at] = f"{slots[at]} {text}".strip()
        out.append("\t".join(slots).rstrip("\t"))
    return out


def tokens_to_grid(tokens: DataFrame) -> DataFrame:
    """Rows (doc_id, page, row, text) of the tokens of a page, laid out as a grid; a task holds the tokens of one page."""

    names = ["top", "left", "text", "width", "height"]
    pages = tokens.where("text is not null").groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("_all"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
        for b in batches:
            for doc, page, top, left, text, width, height in plain_rows(b):
                found = [Token(*t) for t in zip(left, top, width, height, text) if t[4].strip()]
                yield [(doc, page, n, line) for n, line in enumerate(grid_of(found), 1)]

    rows = pages.select("doc_id", "page", *[F.col(f"_all.{name}") for name in names])
    return map_frames(rows, run, "doc_id long, page int, row int, text string")


def best_pass(tokens: DataFrame) -> DataFrame:
    """The best recognition pass (doc_id, pass): confidence weighted by letters, times the logarithm of their number."""
    letters = F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", ""))
    scores = tokens.where("conf >= 0").groupBy("doc_id", "pass").agg((F.sum(F.col("conf") * letters) / F.greatest(F.sum(letters), F.lit(1)) * F.log1p(F.sum(letters))).alias("score"))
    return scores.groupBy("doc_id").agg(F.max_by("pass", "score").alias("pass"), F.round(F.max("score"), 6).alias("score"))


def json_fields(payload: Column, fields: dict[str, str]) -> list[Column]:
    """Typed fields of a JSON column."""
    parsed = F.from_json(payload, ", ".join(f"{k} {v}" for k, v in fields.items()))
    return [parsed[k].alias(k) for k in fields]


def write_business_table(rows: DataFrame, path: str, kind: str) -> None:
    """Export as csv, with cells that no spreadsheet runs, or as json."""
    from docloom.operators.extract import neutral_cell

    if kind == "csv":
        rows = rows.select(*[(neutral_cell(F.col(c)).alias(c) if t == "string" else F.col(c)) for c, t in rows.dtypes])
        rows.write.option("header", True).mode("overwrite").csv(path)
    else:
        rows.write.mode("overwrite").json(path)


