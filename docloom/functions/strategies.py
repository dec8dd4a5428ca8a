"""Extraction strategies by the user: fields, rows and warnings of a text, as a table function with a declared schema."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

FOUND = "kind string, name string, value string, confidence double, line_number int, row_index int, record map<string,string>, warning string"


@dataclass
class Extraction:
    """What a strategy finds: fields (name, value, confidence, line number), rows (line number, values) and warnings."""

    fields: list[tuple[str, str, float, int]] = field(default_factory=list)
    rows: list[tuple[int, dict[str, str]]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


#: A strategy is a function of the text, its lines, and the names of the fields that are asked for (none: all).
Strategy = Callable[[str, list[str], frozenset[str]], Extraction]
STRATEGIES: dict[str, Strategy] = {}


def register_strategy(name: str, strategy: Strategy) -> None:
    """Make a strategy known under a name of letters, digits and underscores."""
    if not name.isidentifier():
        raise ValueError(f"{name!r} can't name a strategy")
    STRATEGIES[name] = strategy


def rows_of(found: Extraction, wanted: frozenset[str]) -> Iterator[tuple]:
    """An extraction as rows of the declared schema; fields that nobody asked for are left out."""
    for name, value, confidence, line in found.fields:
        if not wanted or name in wanted:
            yield "field", name, value, float(confidence), line, None, None, None
    for n, (line, record) in enumerate(found.rows, 1):
        yield "row", None, None, None, line, n, {str(k): None if v is None else str(v) for k, v in record.items()}, None
    for warning in found.warnings:
        yield "warning", None, None, None, None, None, None, warning


def as_table_function(spark: SparkSession, name: str, wanted: Iterable[str] = ()) -> str:
    """Register a strategy as the table function ``extract_<name>(text)`` for SQL, and give its name."""
    strategy, asked = STRATEGIES[name], frozenset(wanted)

    class Extract:
        def eval(self, text: str) -> Iterator[tuple]:
            text = text or ""
            yield from rows_of(strategy(text, text.splitlines(), asked), asked)

    spark.udtf.register(f"extract_{name}", udtf(Extract, returnType=FOUND))
    return f"extract_{name}"


def extract_with(docs: DataFrame, name: str, wanted: Iterable[str] = ()) -> DataFrame:
    """Rows (doc_id, kind, name, value, confidence, line_number, row_index, record, warning) that a strategy gives for each text.

    ``kind`` is field, row or warning. A null text is an empty one; a text for which the strategy has nothing gives no row.
    """
    function = as_table_function(docs.sparkSession, name, wanted)
    return docs.sparkSession.sql(f"SELECT d.doc_id, f.* FROM {{docs}} d, LATERAL {function}(d.text) f", docs=docs.select("doc_id", "text"))
