"""JSON text to dotted keys, long rows and columns."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER = "^(BIGINT|DOUBLE|FLOAT|DECIMAL)"


def is_json_text(c: Column) -> Column:
    """Whether the text is a JSON object or list."""
    text = F.trim(c.cast("string"))
    return F.coalesce(text.rlike(r"^[\{\[]") & F.try_parse_json(text).isNotNull(), F.lit(False))


def json_columns(df: DataFrame) -> list[str]:
    """Text columns in which some row holds JSON; one aggregate over all rows."""
    text = [f.name for f in df.schema if f.dataType.typeName() == "string"]
    if not text:
        return []
    row = df.select(*text).agg(*[F.max(is_json_text(F.col(f"`{c}`")).cast("int")).alias(f"c{i}") for i, c in enumerate(text)]).first()
    return [c for i, c in enumerate(text) if row[f"c{i}"]]


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


# What is shown of a list, by form and by what it holds: its length (n), its items (i), its objects walked on (o), mean and deviation
# (m), these and the extremes (x), or one JSON text (j).
SHOWN = {
    "report": {"empty": "n", "numbers": "nm", "numbers and null": "n", "scalars": "n", "objects": "n", "mixed": "n"},
    "dashboard": {"empty": "n", "numbers": "nix", "numbers and null": "nix", "scalars": "ni", "objects": "no", "mixed": "nj"},
}
KINDS = {type(None): "VOID", bool: "BOOLEAN", int: "BIGINT", float: "DOUBLE", str: "STRING"}


def _text(value) -> str | None:
    """A scalar as JSON writes it, strings without quotes."""
    return value if value is None or isinstance(value, str) else repr(value) if isinstance(value, float) else json.dumps(value)


def _holds(items: list) -> str:
    kinds = {type(x) for x in items}
    if not kinds:
        return "empty"
    if kinds & {dict, list}:
        return "objects" if kinds == {dict} else "mixed"
    known = kinds - {type(None)}
    if known and known <= {bool, int, float}:
        return "numbers" if known == kinds else "numbers and null"
    return "scalars"


def _summary(numbers: list, extremes: bool):
    middle = math.fsum(numbers) / len(numbers)
    yield "__mean__", middle
    yield "__std__", math.sqrt(math.fsum((x - middle) ** 2 for x in numbers) / len(numbers))
    if extremes:
        yield "__min__", float(min(numbers))
        yield "__max__", float(max(numbers))


def entries(document, prefix: str, form: str, depth: float, most: int | None, longest: int | None) -> list[tuple[str, str | None, str]]:
    """(key, text, kind) of every scalar and every list summary of a document, in its order.

    Nodes wait on a stack with their path and the levels left below them. Objects put their values there; what becomes of a list
    is looked up in ``SHOWN``. The dashboard form shows the first ``most`` items, statistics of lists up to ``longest``, and one
    JSON text for what lies too deep.
    """
    out, waiting = [], [(prefix, document, depth)]

    def add(key: str, value) -> None:
        out.append((key, _text(value), KINDS[type(value)]))

    def whole(key: str, value) -> None:
        add(f"{key}.__json__", json.dumps(value, sort_keys=True, ensure_ascii=False))

    while waiting:
        path, node, levels = waiting.pop()
        kind = type(node)
        if kind is not dict and kind is not list:
            add(path, node)
        elif levels < 0 and (kind is dict or form == "dashboard"):
            whole(path, node)
        elif kind is dict:
            waiting += [(f"{path}.{name}", value, levels - 1) for name, value in reversed(node.items())]
        else:
            shown = SHOWN[form][_holds(node)]
            add(f"{path}.__len__", len(node))
            if "i" in shown:
                for place, item in enumerate(node[:most]):
                    add(f"{path}[{place}]", item)
            if "m" in shown or ("x" in shown and (longest is None or len(node) <= longest)):
                for name, value in _summary([x for x in node if x is not None], "x" in shown):
                    add(f"{path}.{name}", value)
            if "o" in shown:
                waiting += [(f"{path}[{place}]", item, levels - 1) for place, item in reversed(list(enumerate(node[:most])))]
            if "j" in shown:
                whole(path, node)
            elif form == "dashboard" and most is not None and len(node) > most:
                add(f"{path}.__truncated__", True)
    return out


def _documents(texts, form: str):
    """(position, parsed document) of the texts that hold an object (or, for the dashboard form, a list)."""
    wanted = dict if form == "report" else (dict, list)
    for i, raw in enumerate(texts):
        try:
            doc = json.loads(raw) if raw is not None else None
        except ValueError:
            continue
        if isinstance(doc, wanted):
            yield i, doc


def flatten_json(df: DataFrame, ids: Sequence[str], column: str, prefix: str, form: str = "report", max_depth: int | None = None, most: int | None = None, longest: int | None = None) -> DataFrame:
    """(ids, key, value, kind) rows, one per scalar leaf, list statistic or list item.

    The nesting is open-ended, which column expressions can only follow by rebuilding the remaining document at every
    level; parsing each text once in an Arrow batch is several times faster. Rows stay where they are: no exchange.
    """
    depth = math.inf if max_depth is None else max_depth
    keep = list(ids)

    def expand(batches):
        for pdf in batches:
            at, keys, texts, kinds = [], [], [], []
            for i, doc in _documents(pdf["_json"], form):
                for key, value, kind in entries(doc, prefix, form, depth, most, longest):
                    at.append(i)
                    keys.append(key)
                    texts.append(value)
                    kinds.append(kind)
            if not at:
                continue
            out = pdf[keep].iloc[at].reset_index(drop=True)
            out["key"], out["value"], out["kind"] = keys, texts, kinds
            yield out

    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema]
    text = F.trim(F.col(column).cast("string"))
    rows = df.select(*keep, text.alias("_json")).where(F.substr(text, F.lit(1), F.lit(1)).isin("{", "["))
    return rows.mapInPandas(expand, ", ".join([*types, "key string, value string, kind string"]))


def flatten_map(column: str, prefix: str, form: str = "report", max_depth: int | None = None, most: int | None = None, longest: int | None = None) -> Column:
    """The flattened entries of a JSON text as one map, so that the row keeps its place and no regrouping is needed."""
    depth = math.inf if max_depth is None else max_depth

    @F.pandas_udf("map<string,string>")
    def build(texts: pd.Series) -> pd.Series:
        out: list[dict] = [{} for _ in range(len(texts))]
        for i, doc in _documents(texts, form):
            out[i] = {k: v for k, v, _ in entries(doc, prefix, form, depth, most, longest)}
        return pd.Series(out, index=texts.index)

    return build(F.trim(F.col(f"`{column}`").cast("string")))


def flattened_columns(df: DataFrame, columns: Mapping[str, str], form: str = "dashboard", most_keys: int | None = None, **kw) -> DataFrame:
    """The frame with one text column per flattened key; with ``most_keys`` only for that many of the most frequent ones."""
    out = df
    for column, prefix in columns.items():
        held = flatten_map(column, prefix, form, **kw)
        top = df.select(F.explode(F.map_keys(held)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "key")
        keys = [r["key"] for r in (top.limit(most_keys) if most_keys else top).collect()]  # column names
        if keys:
            out = out.withColumn("_kv", held).withColumns({k: F.try_element_at("_kv", F.lit(k)) for k in keys}).drop("_kv")
    return out


def field(column: str, *paths: str) -> Column:
    """The first of several JSON paths that holds a value, as text."""
    return F.coalesce(*[F.get_json_object(F.col(column), p) for p in paths])


def number_map(column: str) -> Column:
    """Top-level numeric entries of a JSON object as a map."""
    v = F.try_parse_json(F.col(column))
    entries = F.map_entries(v.try_cast("map<string,variant>"))
    kept = F.filter(entries, lambda e: _kind(e["value"]).rlike(_NUMBER + "|^BOOLEAN$"))
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"], _as_number(e["value"]))))


def _as_number(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", "boolean").cast("double"))


def metric_rows(df: DataFrame, ids: Sequence[str], column: str = "metrics_json") -> DataFrame:
    """(ids, metric, value) rows of the numeric entries."""
    return df.select(*ids, F.explode(number_map(column)).alias("metric", "value"))


def analysis_columns(df: DataFrame, metrics: Sequence[str], params: Sequence[str], metrics_col: str = "metrics_json", params_col: str = "params_json") -> DataFrame:
    """``metric.<name>`` and ``param.<name>`` columns for the given names, numbers only."""
    held = df.withColumns({"_m": number_map(metrics_col), "_p": number_map(params_col)})
    cols = {f"metric.{m}": F.try_element_at("_m", F.lit(m)) for m in metrics} | {f"param.{p}": F.try_element_at("_p", F.lit(p)) for p in params}
    return held.withColumns(cols).drop("_m", "_p")
