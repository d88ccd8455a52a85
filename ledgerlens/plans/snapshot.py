"""The per-company document: all sections, the quality verdict, facts and hashes."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions import values as V
from ledgerlens.operators import jsonwalk, quality
from ledgerlens.plans import company as C

SECTIONS = ("stock_info", "market", "annual", "quarterly", "balance", "indicators", "audit",
            "industry", "forecast")


def macro_section(macro: DataFrame | None) -> Column:
    """Newest reading of every macro series by its name, the same for all companies.

    One row with one entry per series.  No frame (a historical as-of must not see current readings) and a
    frame without readings both count as not available.
    """
    if macro is None:
        none = F.lit(None).cast("map<string,struct<period:string,value:double,yoy_pct:double>>")
        return F.struct(F.lit(False).alias("available"), none.alias("series"))
    latest = C.macro_latest(macro).where("value is not null")
    entry = F.struct("indicator", F.struct("period", "value", "yoy_pct"))
    held = latest.agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("series"))
    return held.select(F.struct((F.size("series") > 0).alias("available"), "series")).scalar()


def company_sections(t: C.Tables, as_of: date | str | Column, macro: DataFrame | None = None) -> DataFrame:
    """One row per company with one struct column per section; an absent section is NULL.

    ``macro`` holds current readings (indicator, period, value, yoy_pct) and is left out for a historical as-of.

    All sections are one row per company and already hashed by company, so the
    joins reuse that layout.
    """
    on = C.day(as_of)
    parts = {
        "stock_info": C.stock_info(t),
        "market": C.market(t, on),
        "annual": C.annual(t, on),
        "quarterly": C.quarterly(t, on),
        "balance": C.balance(t, on),
        "indicators": C.indicators(t, on),
        "audit": C.audit(t, on),
        "industry": C.industry(t, on),
        "forecast": C.forecast(t, on),
    }
    out = None
    for name, frame in parts.items():
        packed = frame.select("ts_code", F.struct(*frame.columns).alias(name))
        out = packed if out is None else out.join(packed, "ts_code", "left")
    return out.withColumns(
        {
            "macro": macro_section(macro),
            "meta": F.struct(V.ymd(on).alias("analysis_date"), F.lit(False).alias("cross_validated")),
        }
    )


def company_document(t: C.Tables, as_of: date | str | Column, macro: DataFrame | None = None) -> DataFrame:
    """Sections plus the quality verdict, ready to be written as one JSON line per company."""
    sections = company_sections(t, as_of, macro)
    return quality.with_verdict(sections, C.day(as_of))


# --- facts -----------------------------------------------------------------------


def _leaves(node: Column, kind: T.DataType, path: Column, containers: bool) -> list[Column]:
    """Array expressions of (path, value) for everything below ``node``; built from the schema alone."""
    numeric = isinstance(kind, (T.NumericType,))
    here = F.struct(path.alias("path"), (node.cast("double") if numeric else F.lit(None).cast("double")).alias("value"))
    out: list[Column] = []
    empty = F.array().cast("array<struct<path:string,value:double>>")
    if containers or numeric:
        out.append(F.when(node.isNotNull(), F.array(here)).otherwise(empty))
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            out += _leaves(node[f.name], f.dataType, F.concat(path, F.lit("." + f.name)), containers)
    elif isinstance(kind, T.ArrayType):
        def element(x: Column, i: Column) -> Column:
            return F.concat(*_leaves(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), containers))
        out.append(F.coalesce(F.flatten(F.transform(node, element)), empty))
    elif isinstance(kind, T.MapType):
        def entry(e: Column) -> Column:
            return F.concat(*_leaves(e["value"], kind.valueType, F.concat(path, F.lit("."), e["key"]), containers))
        out.append(F.coalesce(F.flatten(F.transform(F.map_entries(node), entry)), empty))
    return out


def _nodes(documents: DataFrame, sections: list[str], containers: bool) -> Column:
    parts: list[Column] = []
    for name in sections:
        parts += _leaves(F.col(name), documents.schema[name].dataType, F.lit(name), containers)
    return F.concat(*parts)


def facts(documents: DataFrame, keys: tuple[str, ...] = ("ts_code",), sections: list[str] | None = None) -> DataFrame:
    """Every finite number of the document as a row: path, value, unit and position."""
    names = sections or [c for c in documents.columns if c not in keys]
    rows = documents.select(*keys, F.posexplode(_nodes(documents, names, containers=False)).alias("ord", "f"))
    return rows.select(*keys, "ord", "f.path", V.finite("f.value").alias("value")).filter(
        "value is not null"
    ).withColumn("unit", V.infer_unit("path"))


def paths(documents: DataFrame, keys: tuple[str, ...] = ("ts_code",), sections: list[str] | None = None) -> DataFrame:
    """Every node of the document, containers and text included."""
    names = sections or [c for c in documents.columns if c not in keys]
    rows = documents.select(*keys, F.explode(_nodes(documents, names, containers=True)).alias("f"))
    return rows.select(*keys, "f.path").distinct()


def json_facts(documents: DataFrame, keys: tuple[str, ...], text: str = "json") -> DataFrame:
    """The same for a document that arrives as JSON text of any depth; no schema needed, no job runs beforehand."""
    numbers = jsonwalk.nodes(documents, keys, text, ("number",))
    return numbers.select(*keys, "ord", "path", V.finite("value").alias("value")).filter("value is not null").withColumn(
        "unit", V.infer_unit("path"))


def json_paths(documents: DataFrame, keys: tuple[str, ...], text: str = "json") -> DataFrame:
    """Every node of a JSON text below the outermost one, containers and text included; repeated keys count once."""
    return jsonwalk.paths(documents, keys, text)
