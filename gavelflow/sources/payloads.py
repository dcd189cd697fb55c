"""Nested listing payloads: field search at any depth, coercion to a listing row, redaction.

Python turns a payload into entries (depth, object, position, name, value) for the names asked for;
which entry serves a field, and what it means, is decided in columns.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelflow import lexicon as lx
from gavelflow.functions import money

TEXT_FIELDS = ["title", "description", "category", "brand", "model", "upc", "condition", "condition_notes", "location", "zip"]
RAW_FIELDS = ["retail", "current_bid", "bid_count", "premium", "open_at", "close_at", "closed", "final"]
ENTRIES = "array<struct<depth:int,object:int,position:int,name:string,value:string>>"


def folded(name: str) -> str:
    """Field names are compared without case and underscores."""
    return name.replace("_", "").casefold()


def _json(text: str | None) -> object:
    """The JSON value a text starts with; None where there is none."""
    try:
        return json.JSONDecoder().raw_decode((text or "").lstrip())[0]
    except (ValueError, RecursionError):
        return None


def _objects(root: object) -> Iterator[tuple[int, dict]]:
    """Every object with its depth, level by level."""
    level, depth = [root], 0
    while level:
        below: list[object] = []
        for node in level:
            if isinstance(node, dict):
                yield depth, node
                below += node.values()
            elif isinstance(node, list):
                below += node
        level, depth = below, depth + 1


def _entries(root: object, names: set[str]) -> list[dict]:
    """The filled fields of those names, in the order in which they are met."""
    return [
        {"depth": depth, "object": i, "position": j, "name": folded(k), "value": json.dumps(v)}
        for i, (depth, node) in enumerate(_objects(root))
        for j, (k, v) in enumerate(node.items()) if v is not None and v != "" and folded(k) in names]


def entries(json_column: str, names: Iterable[str]) -> Column:
    """Entries of one payload per row."""
    wanted = {folded(n) for n in names}

    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([_entries(_json(t), wanted) for t in texts], dtype=object)

    return F.pandas_udf(search, ENTRIES)(json_column)


def lot_objects(json_column: str, names: Iterable[str]) -> Column:
    """Every lot-shaped object of a payload: which shape, its place, its text and its entries."""
    wanted = {folded(n) for n in names}
    shapes = [{folded(k) for k in shape} for shape in lx.LOT_SHAPES]

    def of(text: str | None) -> list[dict]:
        out = []
        for i, (_, node) in enumerate(_objects(_json(text))):
            have = set(map(folded, node))
            fits = [s for s, shape in enumerate(shapes) if shape <= have]
            if fits:
                out.append({"shape": fits[0], "node": i, "raw": json.dumps(node), "entries": _entries(node, wanted)})
        return out

    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([of(t) for t in texts], dtype=object)

    return F.pandas_udf(search, f"array<struct<shape:int,node:int,raw:string,entries:{ENTRIES}>>")(json_column)


def nearest(found: Column, names: Iterable[str]) -> Column:
    """Value of the entry of those names that is nearest to the root, then first."""
    named = F.filter(found, lambda e: e["name"].isin(sorted({folded(n) for n in names})))
    return F.array_min(F.transform(named, lambda e: F.struct(e["depth"], e["object"], e["position"], e["value"].alias("value"))))["value"]


def json_text(value: Column) -> Column:
    """A JSON value as text: an object by its name, a list by its items, a scalar as it is."""
    def of(v: Column) -> Column:
        named = F.coalesce(*[F.get_json_object(v, f"$.{k}") for k in ("name", "title", "value", "text")])
        return F.when(v.startswith("{"), named).otherwise(v)

    listed = F.array_join(F.filter(F.transform(F.from_json(value, "array<string>"), of), lambda t: F.trim(t) != ""), ", ")
    whole = F.when(value.startswith("{"), of(value)).when(value.startswith("["), listed).otherwise(json_scalar(value))
    return F.nullif(F.trim(whole), F.lit(""))


def json_urls(value: Column) -> Column:
    """Addresses in a JSON list of texts or of objects."""
    def of(v: Column) -> Column:
        return F.when(v.startswith("{"), F.coalesce(*[F.get_json_object(v, f"$.{k}") for k in ("url", "src", "fullPath")])).otherwise(v)

    listed = F.filter(F.transform(F.from_json(value, "array<string>"), of), lambda u: u.isNotNull())
    return F.when(value.startswith("["), F.coalesce(listed, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))


def find_listings(payloads: DataFrame, json_column: str, keys: list[str], nested: bool = False) -> DataFrame:
    """Field values of the payload, or with ``nested`` of every lot-shaped object inside it.

    Keeps the key columns. ``shape`` and ``node`` give the order in which objects count as found.
    """
    names = [a for aliases in lx.ALIASES.values() for a in aliases]
    if nested:
        rows = payloads.select(*keys, F.explode(lot_objects(json_column, names)).alias("_o")).select(
            *keys, "_o.shape", "_o.node", "_o.raw", F.col("_o.entries").alias("_e"))
    else:
        made = payloads.select(*keys, F.col(json_column).alias("raw"), entries(json_column, names).alias("_e"))
        rows = made.select(*keys, F.lit(0).alias("shape"), F.lit(0).alias("node"), "raw", "_e")
    values = rows.select(*keys, "shape", "node", "raw", F.explode(F.array(F.struct(*[
        nearest(F.col("_e"), aliases).alias(field) for field, aliases in lx.ALIASES.items()]))).alias("_f"))
    texts = [json_text(F.col(f"_f.{t}")).alias(t) for t in TEXT_FIELDS]
    found = values.select(
        *keys, "shape", "node", json_scalar(F.col("_f.id")).alias("lot_id"), *texts, *[F.col(f"_f.{r}").alias(r) for r in RAW_FIELDS],
        json_urls(F.col("_f.images")).alias("images"), "raw")
    return found.where(F.col("lot_id").isNotNull() & F.col("title").isNotNull())


# --- coercion ------------------------------------------------------------------------------------
def json_scalar(c: Column) -> Column:
    """Text of a JSON scalar without its quotes."""
    return F.get_json_object(F.concat(F.lit('{"v":'), c, F.lit("}")), "$.v")


def json_money(c: Column) -> Column:
    """Money from a number, a text, or an object with amount, value, price or cents."""
    def of(text: Column) -> Column:
        return F.coalesce(text.try_cast("double"), money.parse_money(text))

    inside = F.coalesce(
        *[of(F.get_json_object(c, f"$.{k}")) for k in ("amount", "value", "price")], of(F.get_json_object(c, "$.cents")) / 100)
    number = F.when(c.startswith("{"), inside).when(c.startswith('"'), money.parse_money(json_scalar(c)))
    return number.when(~c.isin("true", "false") & ~c.startswith("["), c.try_cast("double"))


def json_rate(c: Column) -> Column:
    raw = json_money(c)
    rate = F.when(raw > 1.0, raw / 100.0).otherwise(raw)
    return F.when((rate >= 0) & (rate < 1), rate)


def to_listings(found: DataFrame, base_url: str, keys: list[str]) -> DataFrame:
    """Found fields as listing rows."""
    base = F.lit(base_url.rstrip("/") + "/p/")
    final = json_money(F.col("final"))
    flagged = F.col("closed").isNotNull() & ~F.col("closed").isin("false", "0", "0.0", '""', "[]", "{}")
    return found.select(
        *keys, "lot_id", F.concat(base, F.col("lot_id")).alias("url"), "title", "description", "category", "brand", "model", "upc",
        F.col("condition").alias("condition_name"), "condition_notes", json_money(F.col("retail")).alias("retail_price"),
        F.coalesce(json_money(F.col("current_bid")), F.lit(0.0)).alias("current_bid"),
        F.coalesce(json_money(F.col("bid_count")).cast("int"), F.lit(0)).alias("bid_count"),
        json_rate(F.col("premium")).alias("buyers_premium_rate"), "location", F.col("zip").alias("location_zip"),
        money.parse_when(json_scalar(F.col("open_at"))).alias("open_at"), money.parse_when(json_scalar(F.col("close_at"))).alias("close_at"),
        "images", (flagged | final.isNotNull()).alias("is_closed"), final.alias("final_price"), "raw")


def listings(payloads: DataFrame, base_url: str, json_column: str = "value", keys: tuple[str, ...] = ()) -> DataFrame:
    """One listing per payload; payloads that are no JSON, or without id or title, give none."""
    return to_listings(find_listings(payloads, json_column, list(keys)), base_url, list(keys))


def deep_find(payloads: DataFrame, json_column: str, names: list[str], out: str = "found") -> DataFrame:
    """Adds the nearest non-empty value of any of the names, at any depth, as JSON text."""
    return payloads.withColumn(out, nearest(entries(json_column, names), names))


# --- redaction ------------------------------------------------------------------------------------
REDACTED = "<redacted>"


def _redacted(text: str | None) -> dict:
    """Values are replaced while the objects are read, so depth plays no part."""
    secret = {folded(k) for k in lx.SENSITIVE_KEYS}

    def clean(pairs: list[tuple[str, object]]) -> dict:
        return {k: REDACTED if folded(k) in secret else v for k, v in pairs}

    if text is None:
        return {"value": None, "error": None}
    try:
        return {"value": json.dumps(json.loads(text, object_pairs_hook=clean)), "error": None}
    except (ValueError, RecursionError) as exc:
        return {"value": None, "error": f"{type(exc).__name__}: not readable as JSON"}


def redact(payloads: DataFrame, json_column: str, error_column: str = "redaction_error") -> DataFrame:
    """Credential-like values replaced at any depth. A text that is no JSON becomes null, with the
    reason in ``error_column``; it is never passed on as it was."""
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([_redacted(t) for t in texts], columns=["value", "error"], dtype=object)

    made = payloads.withColumn("_clean", F.pandas_udf(search, "value string, error string")(json_column))
    return made.withColumns({json_column: F.col("_clean.value"), error_column: F.col("_clean.error")}).drop("_clean")
