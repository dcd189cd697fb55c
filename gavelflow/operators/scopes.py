"""Comp lookups without a limit: what an item may draw on is a scope, and scopes are valued, not listed.

A lookup reads the comps of a key, of a family or of a brand. Listing them per item would pair every thin
item of a brand with every comp of the brand, so an item only gets the name of its scope. The comps of
a scope are put into classes of equal title; an item meets the classes whose title is similar enough (an
equi-join, see ``similar_titles``), and its trimmed weighted median is worked out from sums over classes:

* An item whose classes hold few comps meets them one by one, in windows.
* Items with many, whose scope fits a task (``Params.heavy_rows``), are valued there: the task reads the classes of
  its items once and puts the comps of each item in order in memory.
* Of what is left, an item with over ``Params.packed_points`` comps descends. Sums per value bin show in which bin each rank lies; sums per value inside that
  bin show the value; only comps of that very value are then put in order one by one. The weights of
  what was kept are found the same way: whole bins between the ends, values in the bins of the ends,
  single comps at the ends. Sums merge over classes, and no step moves more than the bins of a class,
  however many comps it holds.

Comps of an item's own key count as the item itself (similarity 1) whatever their title; in a wider
scope there are fewer than five of them, and they enter the sums one by one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gavelflow import lexicon as lx
from gavelflow.functions import money, text
from gavelflow.operators import comps as oc
from gavelflow.operators import gathered
from gavelflow.operators.splitting import pin, positions, split_heavy
from gavelflow.params import Params
from gavelflow.session import ship_package, written

KEY, FAMILY, BRAND, STORED = "k|", "f|", "b|", "s|"
ASK = ["item_key", "title"]
ONE = "*"  # the one class of an exact key
UNTITLED = 0.6
FEW_CLASSES = 64  # an ask is compared with all classes of a scope of as many
RANKED = 256  # an ask with as many comps is valued by windows
TASK_WORK = 50_000_000  # comps of all asks that one task values


def _scoped(kind: str, value: str) -> Column:
    return F.concat(F.lit(kind), F.col(value))


def _brand() -> Column:
    return F.split("query_key", ":")[1]


def key_counts(comps: DataFrame, sources: Sequence[str] = tuple(lx.STORED_SOURCES)) -> DataFrame:
    """``query_key, n, stored``: own comps and outside comps per key."""
    return comps.groupBy("query_key").agg(
        F.count_if(F.col("source") == "house").alias("n"), F.count_if(F.col("source").isin(list(sources))).alias("stored"))


def lookup_scopes(queries: DataFrame, comps: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """``item_key, tier, scope, comps`` of the own closing sales: exact key, then family, then brand, each
    widening replacing the one before. ``queries`` has item_key, family, brand_key; ``counts`` are the
    ``key_counts`` of ``comps`` where they are known."""
    asked = queries.select("item_key", "family", "brand_key").distinct()
    if counts is None:
        per_key = comps.where("source = 'house'").groupBy("query_key").agg(F.count(F.lit(1)).alias("n"))
    else:
        per_key = counts.where("n > 0").select("query_key", "n")
    asked = asked.join(per_key.select(F.col("query_key").alias("item_key"), F.col("n").alias("_n1")), "item_key", "left")
    n1 = F.coalesce("_n1", F.lit(0))
    asked = asked.withColumn("_wide", (n1 < 5) & (F.col("family") != F.col("item_key")))
    families = oc.family_matches(asked.where("_wide"), per_key).join(per_key, "query_key").groupBy(F.col("family").alias("_f")).agg(F.sum("n").alias("_n2"))
    asked = asked.join(families, oc._unless(F.col("_wide"), "family", "item_key") == F.col("_f"), "left")
    now = F.when(F.col("_wide"), F.coalesce("_n2", F.lit(0))).otherwise(n1)
    asked = asked.withColumn("_thin", (now < 3) & F.col("brand_key").isNotNull()).withColumn("_now", now)
    brands = per_key.where(F.col("query_key").startswith("bm:")).groupBy(_brand().alias("_b")).agg(F.sum("n").alias("_n3"))
    asked = asked.join(brands, oc._unless(F.col("_thin"), "brand_key", "item_key") == F.col("_b"), "left")
    return asked.select(
        "item_key", F.when(F.col("_thin"), 3).when(F.col("_wide"), 2).otherwise(1).alias("tier"),
        F.when(F.col("_thin"), _scoped(BRAND, "brand_key")).when(F.col("_wide"), _scoped(FAMILY, "family")).otherwise(_scoped(KEY, "item_key")).alias("scope"),
        F.when(F.col("_thin"), F.coalesce("_n3", F.lit(0))).otherwise(F.col("_now")).alias("comps"))


def house_scopes(scopes: DataFrame, keys: DataFrame) -> DataFrame:
    """``query_key, scope`` of each of ``keys`` (distinct) and each scope asked for that holds it; few per key."""
    asked = scopes.select("scope").distinct()
    families = asked.where(F.col("scope").startswith(FAMILY)).select(F.substring("scope", 3, 1 << 30).alias("family"))
    named = [
        keys.select("query_key", _scoped(KEY, "query_key").alias("scope")),
        keys.where(F.col("query_key").startswith("bm:")).select("query_key", F.concat(F.lit(BRAND), _brand()).alias("scope")),
        oc.family_matches(families, keys).select("query_key", _scoped(FAMILY, "family").alias("scope"))]
    return reduce(DataFrame.unionByName, named).join(asked, "scope", "left_semi")


def house_members(scopes: DataFrame, comps: DataFrame) -> DataFrame:
    """The own comps of every scope asked for, with ``scope``."""
    house = comps.where("source = 'house'").select(*oc.COMP_COLUMNS)
    return house.join(house_scopes(scopes, house.select("query_key").distinct()), "query_key")


def stored_members(queries: DataFrame, comps: DataFrame, sources: Sequence[str] = tuple(lx.STORED_SOURCES)) -> DataFrame:
    """The outside comps of every family asked for, with ``scope``."""
    stored = comps.where(F.col("source").isin(list(sources))).select(*oc.COMP_COLUMNS)
    named = oc.family_matches(queries, stored).select("query_key", _scoped(STORED, "family").alias("scope"))
    return stored.join(named, "query_key")


def scopes_and_members(queries: DataFrame, comps: DataFrame, dedupe: bool = True) -> tuple[DataFrame, DataFrame]:
    """``item_key, scope`` (two per item) and the comps of every scope; a listing counts once per scope."""
    counts = written(key_counts(comps), "keys")
    house = written(lookup_scopes(queries, comps, counts).select("item_key", "scope"), "scopes")
    both = house.unionByName(queries.select("item_key", _scoped(STORED, "family").alias("scope")).distinct())
    own = house_scopes(house, counts.where("n > 0").select("query_key")).withColumn("_own", F.lit(True))
    families = oc.family_matches(queries, counts.where("stored > 0")).select("query_key", _scoped(STORED, "family").alias("scope"), F.lit(False).alias("_own"))
    named = own.unionByName(families).withColumnRenamed("query_key", "_k")
    # comps are read once for both
    kept = comps.where(F.col("source").isin(["house", *lx.STORED_SOURCES])).select(*oc.COMP_COLUMNS)
    rows = kept.join(named, (F.col("query_key") == F.col("_k")) & ((F.col("source") == "house") == F.col("_own"))).drop("_k", "_own")
    rows = rows.withColumn("sold_at", F.coalesce("sold_at", "observed_at"))
    return both, oc.union_comps([rows], dedupe, ["scope"])


def _bin(c: str) -> Column:
    """A sixteenth of an octave."""
    return F.floor(F.log2(c) * 16).cast("int")


def scope_points(rows: DataFrame, as_of: Column, params: Params) -> DataFrame:
    """Usable comps with class, bins and the weight they have at similarity 1."""
    cutoff = as_of - F.expr(f"INTERVAL {params.max_age_days} DAYS")
    exact = F.col("scope").startswith(KEY)
    wide = F.col("scope").startswith(FAMILY) | F.col("scope").startswith(BRAND)
    points = rows.where((F.col("sold_at").isNull() | (F.col("sold_at") >= cutoff)) & (oc.total() > 0)).select(
        "scope", F.when(exact, F.lit(ONE)).otherwise(F.coalesce("title", F.lit(""))).alias("t"),
        F.when(wide, F.col("query_key")).alias("own"), "comp_id", "source", "price", "shipping", "is_sold", "sold_at",
        oc.total().alias("total"), (oc.total() * F.when(F.col("is_sold"), 1.0).otherwise(lx.ASKING_HAIRCUT)).alias("adjusted"),
        F.floor(money.days_between(as_of, F.col("sold_at"))).alias("age"),
        (money.source_weight(F.col("source")) * money.recency_weight(F.col("sold_at"), as_of, params.half_life_days)).alias("raw"))
    points = points.withColumn("w", F.col("raw").cast("decimal(18,9)"))
    return points.select(F.md5(F.concat_ws("\x1f", "scope", "t")).alias("cls"), "*").drop("price", "shipping", "is_sold")


def class_pairs(asks: DataFrame, classes: DataFrame, params: Params) -> DataFrame:
    """``item_key, title, cls, similarity``: the classes an ask (item_key, title, scope) draws on."""
    exact = asks.join(classes.where(F.col("t") == ONE).select("scope", "cls"), "scope").select(*ASK, "cls", F.lit(1.0).alias("similarity"))
    open_ = asks.where(~F.col("scope").startswith(KEY))
    titled = classes.where((F.col("t") != "") & ~F.col("scope").startswith(KEY))
    # in a scope of few classes an ask meets them all
    sizes = titled.groupBy("scope").agg(F.count(F.lit(1)).alias("_classes"))
    titled = titled.join(sizes, "scope")
    few, many = titled.where(F.col("_classes") <= FEW_CLASSES), titled.where(F.col("_classes") > FEW_CLASSES)
    met = pin(open_, _a=text.title_features("title")).join(pin(few.select("scope", "t", "cls"), _b=text.title_features("t")), "scope")
    met = met.withColumn("similarity", text.feature_similarity(F.col("_a"), F.col("_b"))).where(F.col("similarity") >= params.min_similarity)
    open_ = open_.join(sizes.where(F.col("_classes") > FEW_CLASSES).select("scope"), "scope", "left_semi")
    near = oc.similar_titles(
        open_.select("scope", "title"), many.select("scope", F.col("t").alias("title")), params.min_similarity, within=["scope"])
    near = open_.join(near.withColumnRenamed("a", "title"), ["scope", "title"]).join(many.select("scope", F.col("t").alias("b"), "cls"), ["scope", "b"])
    near = near.select(*ASK, "cls", "similarity").unionByName(met.select(*ASK, "cls", "similarity"))
    out = exact.unionByName(near.select(*ASK, "cls", "similarity"))
    if params.min_similarity <= UNTITLED:
        blank = asks.where(~F.col("scope").startswith(KEY)).join(classes.where((F.col("t") == "") & ~F.col("scope").startswith(KEY)).select("scope", "cls"), "scope")
        out = out.unionByName(blank.select(*ASK, "cls", F.lit(UNTITLED).alias("similarity")))
    return out


def comp_values(
    queries: DataFrame, comps: DataFrame, as_of: Column, params: Params = Params(), dedupe: bool = True,
) -> DataFrame:
    """Trimmed weighted median, count, spread, age and sources per distinct (item_key, title)."""
    scopes, rows = scopes_and_members(queries, comps, dedupe)
    points = written(scope_points(rows, as_of, params), "points")
    asks = written(queries.select(*ASK).distinct().join(scopes, "item_key"), "asks")
    classes = points.groupBy("scope", "t", "cls").agg(F.count(F.lit(1)).alias("n"))
    pairs = written(class_pairs(asks, classes, params), "pairs")
    own = asks.join(points.where("own is not null").withColumnRenamed("scope", "_s"), (F.col("scope") == F.col("_s")) & (F.col("item_key") == F.col("own")))
    own = own.drop("scope", "_s")
    sizes = written(pairs.join(classes.select("cls", "n"), "cls").groupBy(*ASK).agg(F.sum("n").alias("n")).where(F.col("n") > min(RANKED, params.packed_points)), "sizes")
    if sizes.isEmpty():
        return ranked_values(pairs, points, own, params)
    dealt = written(_dealt(sizes, asks, pairs, classes, params), "dealt")
    many = written(sizes.where(F.col("n") > params.packed_points).join(dealt, ASK, "left_anti").select(*ASK), "many")
    rest = lambda df, some: df.join(some.select(*ASK), ASK, "left_semi")
    few = lambda df: df.join(many.unionByName(dealt.select(*ASK)), ASK, "left_anti")
    out = ranked_values(few(pairs), points, few(own), params)
    if not dealt.isEmpty():
        out = out.unionByName(gathered_values(dealt, rest(pairs, dealt), points, rest(own, dealt), params))
    if not many.isEmpty():
        out = out.unionByName(descended_values(written(rest(pairs, many), "pairs"), points, written(rest(own, many), "own"), as_of, params))
    return out


def _dealt(sizes: DataFrame, asks: DataFrame, pairs: DataFrame, classes: DataFrame, params: Params) -> DataFrame:
    """``item_key, title, part``: the asks of ``sizes`` whose comps, with those of the other asks of their scope, fit
    one task; a scope with much to do is dealt to several."""
    wide = asks.where(~F.col("scope").startswith(STORED)).join(sizes, ASK).groupBy(*ASK).agg(F.min("scope").alias("scope"), F.max("n").alias("n"))
    work = wide.groupBy("scope").agg(F.ceil(F.sum("n") / TASK_WORK).alias("_parts"))
    parts = wide.join(work, "scope").select(*ASK, F.concat_ws("\x1f", "scope", F.pmod(F.xxhash64(*ASK), F.col("_parts"))).alias("part"))
    parts = written(parts, "parts")
    loads = parts.join(pairs.select(*ASK, "cls"), ASK).select("part", "cls").distinct().join(classes.select("cls", "n"), "cls")
    fits = loads.groupBy("part").agg(F.sum("n").alias("_load")).where(F.col("_load") < params.heavy_rows)
    return parts.join(fits.select("part"), "part", "left_semi").select(*ASK, "part")


def _met(pairs: DataFrame, points: DataFrame, own: DataFrame) -> DataFrame:
    """One row per ask and comp."""
    fields = [c for c in points.columns if c not in ("scope", "cls", "t", "own")]
    by_class = pairs.join(points, "cls").where(F.col("own").isNull() | (F.col("own") != F.col("item_key"))).select(*ASK, "similarity", *fields)
    return by_class.unionByName(own.select(*ASK, F.lit(1.0).alias("similarity"), *fields))


def ranked_values(pairs: DataFrame, points: DataFrame, own: DataFrame, params: Params) -> DataFrame:
    """All comps of an ask put in order by windows that share one shuffle."""
    met = _met(pairs, points, own)
    weight = (F.col("raw") * F.greatest(F.lit(0.1), F.col("similarity"))).cast("decimal(18,9)")
    kept = met.select(
        *ASK, "comp_id", "source", "sold_at", "total", "adjusted", F.col("age").alias("age_days"),
        (weight * F.lit(10**9).cast("decimal(10,0)")).cast("long").alias("weight"))
    kept = kept.repartition(*ASK).withColumn("_h", F.xxhash64(*ASK))  # numbers sort faster than texts
    return oc._ranked_aggregate(kept, ["_h", *ASK], params.trim_fraction, False).drop("_h")


def gathered_values(dealt: DataFrame, pairs: DataFrame, points: DataFrame, own: DataFrame, params: Params) -> DataFrame:
    """The same aggregate for asks with many comps of which other asks have many too: ``dealt`` (item_key, title,
    part) says which task values an ask; a task reads a class once, however many of its asks draw on it."""
    spark = pairs.sparkSession
    ship_package(spark)
    asked = pairs.join(dealt, ASK).select("part", *ASK, "cls", F.col("similarity").cast("double"))
    fields = ["comp_id", "source", "sold_at", "total", "adjusted", "age", "raw"]
    fields = [F.unix_micros("sold_at").alias("sold_at") if c == "sold_at" else c for c in fields]
    ask = F.concat_ws("\x1f", *ASK)
    none = F.lit(None).cast("string")
    loads = asked.select("part", "cls").distinct().join(points, "cls").select("part", "cls", "own", none.alias("ask"), *fields).unionByName(
        own.join(dealt, ASK).select("part", none.alias("cls"), "own", ask.alias("ask"), *fields))
    trim = params.trim_fraction

    def values(a, p):
        return gathered.values(a, p.rename(columns={"_cls": "cls"}), trim)

    out = "item_key string, title string, comp_value double, comp_count long, spread double, median_age_days double, sources array<string>"
    loads = loads.select(F.col("part").alias("_part"), F.col("cls").alias("_cls"), "own", "ask", *[c for c in loads.columns if c not in ("part", "cls", "own", "ask")])
    return asked.groupBy("part").cogroup(loads.groupBy("_part")).applyInPandas(values, out)


def _running(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Adds ``before`` and ``upto``, running sums of ``value``; ``df`` has a row per key and ``order``."""
    w = W.partitionBy(*keys).orderBy(order)
    upto = F.sum(value).over(w.rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col(value))


def descended_values(pairs: DataFrame, points: DataFrame, own: DataFrame, as_of: Column, params: Params) -> DataFrame:
    """The same aggregate from sums per class; see the head of this module."""
    bins = {"b": _bin("total"), "a": _bin("adjusted")}
    points, own = points.withColumns(bins), own.withColumns(bins)
    asks = pairs.select(*ASK).distinct()
    used = points.join(pairs.select("cls").distinct(), "cls", "left_semi")
    grain = ["b", "a", "total", "adjusted", "age", "source"]
    cells = written(used.groupBy("cls", *grain).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w")), "cells")
    # comps of the item's own key: out of their class, in by themselves
    mine = own.join(pairs.select(*ASK, "cls", F.col("similarity").alias("_sim")), [*ASK, "cls"], "left")
    moved = mine.select(*ASK, *grain, F.lit(1).cast("long").alias("n"), F.col("w"), F.lit(1.0).alias("similarity")).unionByName(
        mine.where("_sim is not null").select(*ASK, *grain, F.lit(-1).cast("long").alias("n"), (-F.col("w")).alias("w"), F.col("_sim").alias("similarity")))
    moved = written(moved, "moved")

    def gathered(cols: Sequence[str], where: Column | None = None, ends: DataFrame | None = None) -> DataFrame:
        """Counts and weights per ask and ``cols``; ``where`` may use columns of ``ends`` (one row per ask)."""
        own_cols = sorted({*cols} | ({"b", "a"} if ends is not None else set()), key=grain.index)
        summed = cells.groupBy("cls", *own_cols).agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
        rows = pairs.join(summed, "cls").select(*ASK, *own_cols, "n", "w", "similarity").unionByName(
            moved.select(*ASK, *own_cols, "n", "w", "similarity"))
        if ends is not None:
            rows = rows.join(ends, ASK).where(where)
        weight = F.col("w") * F.greatest(F.lit(0.1), F.col("similarity")).cast("decimal(10,9)")
        return rows.groupBy(*ASK, *cols).agg(F.sum("n").alias("n"), F.sum(weight).cast("decimal(38,18)").alias("w"))

    # the ranks that matter, first by bin, then by value
    bins = written(gathered(["b"]), "bins")
    sizes = bins.groupBy(*ASK).agg(F.sum("n").alias("n0")).where("n0 > 0")
    trim = F.when(F.col("n0") >= 8, F.greatest(F.lit(1), F.floor(F.col("n0") * F.lit(params.trim_fraction)))).otherwise(F.lit(0)).cast("long")
    sizes = written(sizes.withColumn("trim", trim).withColumn("kept", F.col("n0") - 2 * F.col("trim")), "sizes")
    wanted = F.array(*[F.struct(F.lit(k).alias("which"), r.cast("long").alias("rank")) for k, r in (
        ("lo", F.col("trim") + 1), ("hi", F.col("n0") - F.col("trim")), ("q1", F.expr("trim + kept div 4 + 1")),
        ("q3", F.expr("trim + (3 * kept) div 4 + 1")))])
    ranks = sizes.select(*ASK, F.inline(wanted))
    inside = (F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("upto"))
    at_bin = ranks.join(_running(bins, ASK, "b", "n"), ASK).where(inside).select(*ASK, "which", "rank", "b", "before")
    at_bin = written(at_bin, "at_bin")
    some = at_bin.select(*ASK, F.col("b").alias("_b"), F.col("before").alias("_start")).distinct()
    values = cells_in(pairs, cells, moved, some, ASK)
    values = _running(values, [*ASK, "b"], "total", "n")
    values = values.withColumn("before", F.col("before") + F.col("_start")).withColumn("upto", F.col("upto") + F.col("_start"))
    at = at_bin.drop("before").join(values.select(*ASK, "b", "total", "before", "upto"), [*ASK, "b"]).where(inside)
    at = at.groupBy(*ASK).agg(*[F.max(F.when(F.col("which") == k, F.col(c))).alias(f"{k}_{c}") for k in ("lo", "hi", "q1", "q3") for c in ("b", "total", "before")])
    ends = written(at.join(sizes, ASK), "ends")

    # comps at the very values of both ends, one by one
    runs = ends.select(*ASK, F.explode(F.array_distinct(F.array(
        F.struct(F.col("lo_total").alias("_t"), F.col("lo_before").alias("_start")), F.struct(F.col("hi_total").alias("_t"), F.col("hi_before").alias("_start"))))).alias("_r"))
    runs = runs.select(*ASK, "_r._t", "_r._start")
    edge = _at_values(pairs, used, own, runs)
    slices = [F.to_date("sold_at"), F.substring(F.col("comp_id").cast("string"), 1, 6)]
    run = [*ASK, "_start"]  # names the value: no two start at the same rank
    ranked = split_heavy(edge, run, params.heavy_rows, lambda rows, split: positions(
        rows, run, "total", ["sold_at", "comp_id"], slices=slices, split=split))
    place = F.col("pos") + F.col("_start")
    ranked = ranked.join(sizes.select(*ASK, "n0", "trim"), ASK).where((place > F.col("trim")) & (place <= F.col("n0") - F.col("trim")))
    weight = F.col("w") * F.greatest(F.lit(0.1), F.col("similarity")).cast("decimal(10,9)")
    single = written(ranked.select(*ASK, "a", "adjusted", "age", "source", F.lit(1).cast("long").alias("n"), weight.cast("decimal(38,18)").alias("w")), "single")

    # everything kept: whole bins, values in the bins of the ends, single comps
    bounds = ends.select(*ASK, "lo_b", "hi_b", "lo_total", "hi_total")
    whole = (F.col("b") > F.col("lo_b")) & (F.col("b") < F.col("hi_b"))
    border = F.col("b").isin(F.col("lo_b"), F.col("hi_b")) & (F.col("total") > F.col("lo_total")) & (F.col("total") < F.col("hi_total"))
    fine = written(gathered(["a", "adjusted", "age", "source", "b", "total"], border, bounds).select(*ASK, "a", "adjusted", "age", "source", "n", "w"), "fine")

    def kept(cols: Sequence[str]) -> DataFrame:
        parts = [gathered(cols, whole, bounds), *[x.groupBy(*ASK, *cols).agg(F.sum("n").alias("n"), F.sum("w").cast("decimal(38,18)").alias("w")) for x in (fine, single)]]
        return reduce(DataFrame.unionByName, parts).groupBy(*ASK, *cols).agg(F.sum("n").alias("n"), F.sum("w").cast("decimal(38,18)").alias("w")).where("n > 0")

    by_bin = written(kept(["a"]), "by_bin")
    all_ = by_bin.groupBy(*ASK).agg(F.sum("w").cast("decimal(38,18)").alias("all_w"))
    half = 2 * F.col("upto") >= F.col("all_w")
    target = _running(by_bin, ASK, "a", "w").join(all_, ASK).where(half).groupBy(*ASK).agg(
        F.min(F.struct("a", "before", "all_w")).alias("_m")).select(*ASK, F.col("_m.a").alias("_a"), F.col("_m.before").alias("_w0"), F.col("_m.all_w").alias("all_w"))
    target = written(target, "target")
    in_bin = gathered(["adjusted", "a"], whole & (F.col("a") == F.col("_a")), bounds.join(target.select(*ASK, "_a"), ASK)).select(*ASK, "adjusted", "w")
    for x in (fine, single):
        in_bin = in_bin.unionByName(x.join(target.select(*ASK, "_a"), ASK).where("a = _a").select(*ASK, "adjusted", "w"))
    in_bin = in_bin.groupBy(*ASK, "adjusted").agg(F.sum("w").cast("decimal(38,18)").alias("w"))
    value = _running(in_bin, ASK, "adjusted", "w").join(target, ASK).where(2 * (F.col("upto") + F.col("_w0")) >= F.col("all_w")).groupBy(*ASK).agg(
        F.min("adjusted").alias("comp_value"))

    ages = kept(["age"]).where("age is not null")
    counted = _running(ages, ASK, "age", "n").join(ages.groupBy(*ASK).agg(F.sum("n").alias("_m")), ASK)
    holds = lambda r: (r > F.col("before")) & (r <= F.col("upto"))
    low, high = F.floor((F.col("_m") + 1) / 2), F.floor(F.col("_m") / 2) + 1
    median = counted.groupBy(*ASK).agg(((F.max(F.when(holds(low), F.col("age"))) + F.max(F.when(holds(high), F.col("age")))) / 2.0).alias("median_age_days"))
    sources = kept(["source"]).groupBy(*ASK).agg(F.array_sort(F.collect_set("source")).alias("sources"))
    out = asks.join(ends, ASK).join(value, ASK, "left").join(median, ASK, "left").join(sources, ASK)
    spread = (F.col("q3_total") - F.col("q1_total")) / F.col("comp_value")
    return out.select(
        *ASK, "comp_value", F.col("kept").alias("comp_count"),
        F.when((F.col("kept") >= 4) & (F.col("comp_value") != 0), spread).alias("spread"), "median_age_days", "sources")


def cells_in(pairs: DataFrame, cells: DataFrame, moved: DataFrame, some: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts per ask, bin and value in the bins ``some`` (ask, _b, _start)."""
    summed = cells.groupBy("cls", "b", "total").agg(F.sum("n").alias("n"))
    asked = pairs.select(*keys, "cls").join(some, list(keys))
    rows = asked.join(summed, (asked["cls"] == summed["cls"]) & (asked["_b"] == summed["b"])).select(*keys, "b", "total", "n", "_start")
    more = moved.select(*keys, "b", "total", "n").join(some, list(keys)).where("b = _b").select(*keys, "b", "total", "n", "_start")
    return rows.unionByName(more).groupBy(*keys, "b", "total", "_start").agg(F.sum("n").alias("n"))


def _at_values(pairs: DataFrame, points: DataFrame, own: DataFrame, runs: DataFrame) -> DataFrame:
    """Comps of an ask at the values ``runs`` (ask, _t, _start)."""
    fields = ["comp_id", "source", "sold_at", "total", "adjusted", "age", "w", "a"]
    asked = pairs.join(runs, ASK)
    met = asked.join(points.withColumnRenamed("cls", "_c"), (F.col("cls") == F.col("_c")) & (F.col("_t") == F.col("total")))
    met = met.where(F.col("own").isNull() | (F.col("own") != F.col("item_key"))).select(*ASK, "similarity", "_start", *fields)
    mine = own.join(runs, ASK).where("_t = total").select(*ASK, F.lit(1.0).alias("similarity"), "_start", *fields)
    return met.unionByName(mine)
