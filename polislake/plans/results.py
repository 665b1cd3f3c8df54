"""Result shapes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from . import compile as C
from .parser import parse


def binding(t: Column) -> Column:
    """{type, value, datatype?, xml:lang?} of an encoded term; null for unbound."""
    kind = F.when(t.startswith("<"), "uri").when(t.startswith("_"), "bnode").otherwise("literal")
    dt = F.when(T.tag(t).startswith("^"), T.datatype(t))
    cell = F.struct(kind.alias("type"), T.lexical(t).alias("value"), dt.alias("datatype"), F.nullif(T.language(t), F.lit("")).alias("xml:lang"))
    return F.when(t.isNotNull(), cell)


def bindings(solutions: DataFrame) -> DataFrame:
    """A row a solution: `json`, without unbound variables."""
    return solutions.select(F.to_json(F.struct(*[binding(F.col(f"`{v}`")).alias(v) for v in solutions.columns])).alias("json"))


def sparql_json(solutions: DataFrame) -> str:
    """The SPARQL results document; head.vars is there even without rows."""
    rows = [json.loads(r["json"]) for r in bindings(solutions).collect()] if solutions.columns else []
    return json.dumps({"head": {"vars": list(solutions.columns)}, "results": {"bindings": rows}}, ensure_ascii=False)


def values(solutions: DataFrame) -> DataFrame:
    """Lexical forms in place of encoded terms."""
    return solutions.select(*[T.lexical(F.col(f"`{v}`")).alias(v) for v in solutions.columns])


def sparql(triples: DataFrame, text: str, bindings: dict[str, str] | None = None, quads: bool = False) -> DataFrame | bool:
    """The answer to a query: solutions for SELECT, a truth value for ASK, triples for CONSTRUCT and DESCRIBE.

    GRAPH and FROM tell triples apart by `src`. quads: `triples` holds a triple once a source (terms.quads), and patterns outside GRAPH see it once."""
    q = parse(text)
    if q.form == "SELECT":
        return C.select(triples, q, bindings, quads)
    return {"ASK": C.ask, "CONSTRUCT": C.construct, "DESCRIBE": C.describe}[q.form](triples, q, quads)
