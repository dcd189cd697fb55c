"""Comparable sales: lookup tiers, fuzzy title match, union and robust aggregate."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelflow import lexicon as lx
from gavelflow.functions import money, text
from gavelflow.operators.splitting import pin, positions, same_keys, split_heavy, top_per_group
from gavelflow.params import Params
from gavelflow.session import durable, written

COMP_COLUMNS = [
    "comp_id", "source", "query_key", "title", "price", "shipping",
    "condition", "is_sold", "sold_at", "observed_at", "url",
]


def with_identity(lots: DataFrame) -> DataFrame:
    """Adds item key, family and the brand part of the key, unless they are stored already."""
    if {"item_key", "family", "brand_key"} <= set(lots.columns):
        return lots
    keyed = pin(lots, item_key=text.normalize_item_key("title", "brand", "model", "upc"))
    brand = F.when(F.col("item_key").startswith("bm:"), F.split("item_key", ":")[1])
    return pin(keyed, family=text.key_family("item_key"), brand_key=brand)


def total(price: str = "price", shipping: str = "shipping") -> Column:
    return F.col(price) + F.coalesce(F.col(shipping), F.lit(0.0))


def family_matches(families: DataFrame, keys: DataFrame) -> DataFrame:
    """(family, query_key) pairs where the key starts with the family.

    A prefix test is no equality, so each distinct key is expanded into the few prefixes that can
    be a family and the join is an ordinary equi-join on the prefix.
    """
    distinct = keys.select("query_key").distinct()
    grown = distinct.select(
        "query_key",
        F.explode(F.sequence(F.greatest(F.least(text.key_stem_length("query_key"), F.length("query_key")), F.lit(1)), F.greatest(F.length("query_key"), F.lit(1)))).alias("_n"))
    grown = grown.select("query_key", F.expr("substring(query_key, 1, _n)").alias("family"))
    return families.select("family").distinct().join(grown, "family")


def _packed(rows: DataFrame, key: str, name: str) -> DataFrame:
    """One row per key with its comps as an array; rows were capped per key before."""
    return rows.groupBy(key).agg(F.collect_list(F.struct(*COMP_COLUMNS, "features")).alias(name))


def _with_features(rows: DataFrame) -> DataFrame:
    """Title features worked out once per comp, after the cut and before any join."""
    return rows.withColumn("features", text.title_features("title"))


def _unless(cond: Column, key: str, other: str) -> Column:
    """The join key when it is wanted, else a value that matches nothing and spreads evenly."""
    return F.when(cond, F.col(key)).otherwise(F.concat(F.lit("-"), F.col(other)))


def _newest_by_family(asked: DataFrame, key_pack: DataFrame, order: list[Column], limit: int, name: str) -> DataFrame:
    pairs = family_matches(asked, key_pack)
    rows = pairs.join(key_pack.withColumnRenamed("query_key", "_k"), F.col("query_key") == F.col("_k")).select(
        "family", F.inline("exact_rows"))
    return _packed(top_per_group(rows, ["family"], order, limit), "family", name)


def _given_limit(params: Params) -> int:
    if params.comps_limit is None:
        raise ValueError("packing comps into a row needs comps_limit")
    return params.comps_limit


def house_pack(queries: DataFrame, comps: DataFrame, params: Params = Params()) -> DataFrame:
    """The newest own closing sales per item key as an array: exact key, then family, then brand.

    ``queries`` has item_key, family, brand_key. Each widening replaces the rows. The newest rows
    per key, family and brand are cut out before any join, so no lot key meets a whole hot key. A pack
    needs ``params.comps_limit``; lookups without a limit are in ``scopes``.
    """
    limit = _given_limit(params)
    order = [F.col("sold_at").desc(), F.col("comp_id")]
    house = comps.where(F.col("source") == "house").select(*COMP_COLUMNS)
    asked = queries.select("item_key", "family", "brand_key").distinct()
    key_pack = _packed(_with_features(top_per_group(house, ["query_key"], order, limit)), "query_key", "exact_rows")
    asked = asked.join(key_pack.withColumnRenamed("query_key", "item_key"), "item_key", "left")
    n_exact = F.coalesce(F.size("exact_rows"), F.lit(0))
    asked = asked.withColumn("widens", (n_exact < 5) & (F.col("family") != F.col("item_key")))
    wide = queries.where(F.col("family") != F.col("item_key"))
    by_family = _newest_by_family(wide, key_pack, order, limit, "family_rows")
    asked = asked.withColumn("_fam", _unless(F.col("widens"), "family", "item_key")).join(
        by_family.withColumnRenamed("family", "_fam"), "_fam", "left")
    rows = F.when(F.col("widens"), F.col("family_rows")).otherwise(F.col("exact_rows"))
    thin = (F.coalesce(F.size(rows), F.lit(0)) < 3) & F.col("brand_key").isNotNull()
    branded = house.where(F.col("query_key").startswith("bm:")).withColumn("_brand", F.split("query_key", ":")[1])
    by_brand = _packed(_with_features(top_per_group(branded, ["_brand"], order, limit * 3)), "_brand", "brand_rows")
    asked = asked.withColumn("thin", thin).withColumn("_brand", _unless(F.col("thin"), "brand_key", "item_key"))
    asked = asked.join(by_brand, "_brand", "left")
    tier = F.when(F.col("thin"), 3).when(F.col("widens"), 2).otherwise(1)
    picked = F.when(F.col("thin"), F.col("brand_rows")).otherwise(rows)
    return asked.select("item_key", tier.alias("tier"), picked.alias("rows"))


def stored_pack(
    queries: DataFrame, comps: DataFrame, params: Params = Params(), sources: Sequence[str] = tuple(lx.STORED_SOURCES),
) -> DataFrame:
    """Cached outside comps whose key starts with the item family, newest observed first."""
    order = [F.col("observed_at").desc(), F.col("comp_id")]
    stored = comps.where(F.col("source").isin(list(sources))).select(*COMP_COLUMNS)
    limit = _given_limit(params)
    newest = _with_features(top_per_group(stored, ["query_key"], order, limit))
    key_pack = _packed(newest, "query_key", "exact_rows")
    by_family = _newest_by_family(queries, key_pack, order, limit, "rows")
    asked = queries.select("item_key", "family").distinct()
    return asked.join(by_family, "family").select("item_key", F.lit(0).alias("tier"), "rows")


def unpack(pack: DataFrame) -> DataFrame:
    """Packed comps as rows; the sale time falls back to the time it was observed."""
    rows = pack.select("item_key", "tier", F.inline("rows"))
    return rows.withColumn("sold_at", F.coalesce("sold_at", "observed_at"))


def house_comps(queries: DataFrame, comps: DataFrame, params: Params = Params()) -> DataFrame:
    """Own closing sales listed per item. Without a limit a brand's comps are listed for each of its thin
    items; ``scopes`` says the same in a row per item and a row per comp."""
    if params.comps_limit is not None:
        return unpack(house_pack(queries, comps, params))
    from gavelflow.operators import scopes

    asked = scopes.lookup_scopes(queries, comps).select("item_key", "tier", "scope")
    rows = asked.join(scopes.house_members(asked, comps), "scope").drop("scope")
    return rows.withColumn("sold_at", F.coalesce("sold_at", "observed_at"))


def stored_comps(queries: DataFrame, comps: DataFrame, params: Params = Params()) -> DataFrame:
    if params.comps_limit is not None:
        return unpack(stored_pack(queries, comps, params))
    from gavelflow.operators import scopes

    asked = queries.select("item_key", F.concat(F.lit(scopes.STORED), F.col("family")).alias("scope"), F.lit(0).alias("tier")).distinct()
    rows = asked.join(scopes.stored_members(queries, comps), "scope").drop("scope")
    return rows.withColumn("sold_at", F.coalesce("sold_at", "observed_at"))


def scored_pack(queries: DataFrame, packs: Sequence[DataFrame], dedupe: bool = True) -> DataFrame:
    """One row per (item_key, title) with its comps as an array, each with its similarity.

    The comps of a key are joined to the distinct titles that ask for the key, still packed, so
    the join moves one row per title and its heavy side can be cut anywhere.
    """
    merged = reduce(DataFrame.unionByName, packs).groupBy("item_key").agg(
        F.flatten(F.collect_list("rows")).alias("rows"))
    rows = merged.select("item_key", F.inline("rows")).withColumn("sold_at", F.coalesce("sold_at", "observed_at"))
    per_key = union_comps([rows], dedupe).groupBy("item_key").agg(
        F.collect_list(F.struct(*COMP_COLUMNS, "features")).alias("rows"))
    asked = pin(queries.select("item_key", F.col("title").alias("asked_title")).distinct(),
                asked_features=text.title_features("asked_title"))

    def scored(r: Column) -> Column:
        house_exact = (r["source"] == "house") & (r["query_key"] == F.col("item_key"))
        untitled = F.coalesce(r["title"], F.lit("")) == ""
        similarity = F.when(house_exact, F.lit(1.0)).when(untitled, F.lit(0.6)).otherwise(
            text.feature_similarity(F.col("asked_features"), r["features"]))
        return r.dropFields("features").withField("similarity", similarity)

    return asked.join(per_key, "item_key").select("item_key", "asked_title", F.transform("rows", scored).alias("rows"))


def scored_points(queries: DataFrame, packs: Sequence[DataFrame], dedupe: bool = True) -> DataFrame:
    """One row per (item_key, title, comp) with its similarity to the lot title."""
    return scored_pack(queries, packs, dedupe).select("item_key", "asked_title", F.inline("rows"))


def union_comps(parts: Sequence[DataFrame], dedupe: bool = True, keys: Sequence[str] = ("item_key",)) -> DataFrame:
    """All providers' comps. A listing seen live and stored counts once unless ``dedupe`` is off;
    its lowest comp id stands for it, so the choice does not depend on row order."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if not dedupe:
        return rows
    listing = F.coalesce(F.nullif(F.col("url"), F.lit("")), F.concat(F.lit("#"), F.col("comp_id")))
    named = [*keys, "source", "_listing"]
    rows = rows.withColumn("_listing", listing).withColumn("_h", F.xxhash64(*named))  # numbers sort faster than texts
    return top_per_group(rows, ["_h", *named], [F.col("comp_id")], 1).drop("_listing", "_h")


def new_comps(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of the batch worth appending: (source, url) not stored yet; rows without url always."""
    return _unseen(batch, stored, ["source", "url"])


def _unseen(batch: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    blank = F.coalesce(F.col("url"), F.lit("")) == ""
    # of rows that repeat a key the first stays: earliest seen, then by all other columns
    rest = [c for c in batch.columns if c not in keys]
    order = [F.col("observed_at").asc_nulls_last()] if "observed_at" in rest else []
    linked = top_per_group(batch.where(~blank), keys, [*order, F.to_json(F.struct(*rest))], 1)
    fresh = linked.join(stored.select(*keys).distinct(), keys, "left_anti")
    return fresh.unionByName(batch.where(blank))


# --- fuzzy titles -------------------------------------------------------------------------------
def similar_titles(left: DataFrame, right: DataFrame, threshold: float, within: Sequence[str] = ()) -> DataFrame:
    """Pairs of distinct titles (a, b) whose similarity reaches the threshold, with the similarity; with
    ``within``, pairs that agree on those columns.

    Exact: two titles that both have a model number are alike by that number only and join on it. Any other two
    can only share words that the other side has; titles that agree on those words and on their number of words are
    one form, and forms are compared: by the rarest of their words, as many as two forms of this Jaccard
    similarity must share at least one of.
    """
    on = list(within)
    a = pin(left.select(*on, F.col("title").alias("a")).distinct(), _f=text.title_features("a"))
    b = pin(right.select(*on, F.col("title").alias("b")).distinct(), _f=text.title_features("b"))
    a, b = written(a, "titles"), written(b, "titles")
    by_model = a.select(*on, "a", F.explode("_f.models").alias("k")).join(
        b.select(*on, "b", F.explode("_f.models").alias("k")), [*on, "k"]).select(*on, "a", "b").distinct()

    def with_words(side: DataFrame, name: str) -> DataFrame:
        words = F.col("_f.words")
        return side.select(*on, name, (F.size("_f.models") > 0).alias("_m"), F.size(words).alias("_n"), F.explode(words).alias("w"))

    wa, wb = with_words(a, "a"), with_words(b, "b")
    counts = wa.select(*on, "w", "_m", F.lit("a").alias("_s")).unionByName(wb.select(*on, "w", "_m", F.lit("b").alias("_s")))
    freq = counts.groupBy(*on, "w").agg(
        F.count(F.lit(1)).alias("df"), *[F.count_if(F.col("_s") == s).alias(f"_{s}") for s in "ab"],
        *[F.count_if((F.col("_s") == s) & ~F.col("_m")).alias(f"_{s}_plain") for s in "ab"]).where("_a > 0 and _b > 0")

    def formed(side: DataFrame, name: str, other: str) -> tuple[DataFrame, DataFrame]:
        # the words of a title that a title of the other side has with which it may be compared by words
        known = side.join(freq, [*on, "w"]).where(F.when(F.col("_m"), F.col(f"_{other}_plain")).otherwise(F.col(f"_{other}")) > 0)
        titles = known.groupBy(*on, name, "_m", "_n").agg(F.transform(F.sort_array(F.collect_list(F.struct("df", "w"))), lambda s: s["w"]).alias("_ws"))
        # as many words as any other title must share
        need = F.greatest(F.ceil(F.col("_n") * F.lit(threshold) - F.lit(1e-9)).cast("int"), F.lit(1))
        titles = written(titles.where(F.size("_ws") >= need), "forms")
        forms = titles.select(*on, "_m", "_n", "_ws").distinct()
        return titles, forms.select(*on, "_m", "_n", "_ws", F.explode(F.slice("_ws", 1, F.size("_ws") - need + 1)).alias("k"))

    titles_a, fa = formed(wa, "a", "b")
    titles_b, fb = formed(wb, "b", "a")
    form = ["_m", "_n", "_ws"]
    fa = fa.select(*on, "k", *[F.col(c).alias(f"{c}a") for c in form])
    fb = fb.select(*on, "k", *[F.col(c).alias(f"{c}b") for c in form])
    shared = F.size(F.array_intersect("_wsa", "_wsb")).cast("double")
    met = fa.join(fb, [*on, "k"]).where(~(F.col("_ma") & F.col("_mb"))).drop("k").distinct()
    near = met.withColumn("similarity", shared / (F.col("_na") + F.col("_nb") - shared)).where(F.col("similarity") >= threshold)
    of = lambda df, s: df.select(*on, s, *[F.col(c).alias(f"{c}{s}") for c in form])
    by_words = near.join(of(titles_a, "a"), [*on, *[f"{c}a" for c in form]]).join(of(titles_b, "b"), [*on, *[f"{c}b" for c in form]])
    return by_model.select(*on, "a", "b", F.lit(1.0).alias("similarity")).unionByName(by_words.select(*on, "a", "b", "similarity"))


def _sheet_titles(titles: DataFrame) -> DataFrame:
    """``row_family, title`` of the distinct titles of a sheet."""
    keyed = pin(titles.select("title").distinct(), row_key=text.normalize_item_key("title"))
    return written(pin(keyed, row_family=text.key_family("row_key")).select("row_family", "title"), "sheet")


def sheet_comps(queries: DataFrame, sheet: DataFrame, params: Params = Params()) -> DataFrame:
    """Price-sheet rows for each (item_key, family, title): same family or similar title.

    Sheet rows carry title, price, shipping, condition, sold_at, url and ``comp_id`` in file order;
    with ``params.comps_limit`` the first rows in that order win: of a family or an asked title they hold the first
    of every item that has it, so an item meets a limit of rows of each. Without a limit ``sheet_totals`` says
    what they come to in a row per item.
    """
    n = params.comps_limit
    asked = queries.select("item_key", "family", F.col("title").alias("asked_title")).distinct()
    order = [F.col("comp_id")]
    first = lambda df, keys: df if n is None else top_per_group(df, keys, order, n)
    titles = _sheet_titles(sheet)
    similar = similar_titles(asked.select(F.col("asked_title").alias("title")), titles, params.min_similarity)
    groups = titles.select(F.concat(F.lit("f|"), F.col("row_family")).alias("_g"), F.coalesce("title", F.lit("")).alias("_t"), F.col("title").isNull().alias("_none")).unionByName(
        similar.select(F.concat(F.lit("a|"), F.col("a")).alias("_g"), F.col("b").alias("_t"), F.lit(False).alias("_none")))
    named = sheet.withColumn("_t", F.coalesce("title", F.lit(""))).withColumn("_none", F.col("title").isNull())
    members = first(named, ["_none", "_t"]).join(groups, ["_t", "_none"]).drop("_t", "_none").dropDuplicates(["_g", "comp_id"])
    both = F.explode(F.array(F.concat(F.lit("f|"), F.col("family")), F.concat(F.lit("a|"), F.col("asked_title")))).alias("_g")
    hits = asked.select("item_key", "asked_title", both).join(first(members, ["_g"]), "_g").drop("_g").dropDuplicates(["item_key", "asked_title", "comp_id"])
    return first(hits, ["item_key", "asked_title"]).withColumn("similarity", text.score_similarity("asked_title", "title"))


def sheet_totals(queries: DataFrame, sheet: DataFrame, params: Params = Params()) -> DataFrame:
    """``item_key, asked_title, comps, first_comp, price_sum`` over all sheet rows of the item's family or
    of a similar title. Rows are summed per title first, so an item meets a row per title."""
    asked = queries.select("item_key", "family", F.col("title").alias("asked_title")).distinct()
    by_title = written(sheet.groupBy("title").agg(
        F.count(F.lit(1)).alias("comps"), F.min("comp_id").alias("first_comp"), F.sum(F.col("price").cast("decimal(18,4)")).alias("price_sum")), "sums")
    cols = ["comps", "first_comp", "price_sum"]
    titles = _sheet_titles(by_title)
    classes = by_title.join(titles.withColumnRenamed("title", "_t"), same_keys([("title", "_t")])).drop("_t")
    similar = written(similar_titles(asked.select(F.col("asked_title").alias("title")), titles, params.min_similarity).select("a", "b"), "similar")
    sums = [F.sum("comps").alias("comps"), F.min("first_comp").alias("first_comp"), F.sum("price_sum").alias("price_sum")]
    close = similar.join(by_title, F.col("b") == F.col("title")).groupBy("a").agg(*sums)
    near = asked.join(close, F.col("asked_title") == F.col("a")).select("item_key", "asked_title", *cols)
    # of the item's own family only the titles that were not counted as similar
    own = asked.join(classes, F.col("family") == F.col("row_family"))
    again = similar.select(F.col("a").alias("_a"), F.col("b").alias("_b"))
    own = own.join(again, (F.col("asked_title") == F.col("_a")) & (F.col("title") == F.col("_b")), "left_anti").select("item_key", "asked_title", *cols)
    return near.unionByName(own).groupBy("item_key", "asked_title").agg(*sums)


# --- aggregate ----------------------------------------------------------------------------------
def aggregate_comps(
    points: DataFrame, keys: Sequence[str], as_of: Column, params: Params = Params(),
) -> DataFrame:
    """Trimmed, recency- and source-weighted median per group with spread, age and sources.

    ``points`` has comp_id, source, price, shipping, is_sold, sold_at, similarity. Groups may be of
    any size; heavy ones are ranked in bins.
    """
    keys = list(keys)
    cutoff = as_of - F.expr(f"INTERVAL {params.max_age_days} DAYS")
    kept = points.where(
        (F.col("similarity") >= params.min_similarity)
        & (F.col("sold_at").isNull() | (F.col("sold_at") >= cutoff)) & (total() > 0)
    ).select(
        *keys, "comp_id", "source", "sold_at", total().alias("total"),
        (total() * F.when(F.col("is_sold"), 1.0).otherwise(lx.ASKING_HAIRCUT)).alias("adjusted"),
        F.floor(money.days_between(as_of, F.col("sold_at"))).alias("age_days"),
        (money.source_weight(F.col("source")) * money.recency_weight(F.col("sold_at"), as_of, params.half_life_days)
         * F.greatest(F.lit(0.1), F.col("similarity"))).cast("decimal(18,9)").alias("weight"),
    )
    def rank(rows: DataFrame, split: bool) -> DataFrame:
        return _ranked_aggregate(rows, keys, params.trim_fraction, split)

    return split_heavy(kept, keys, params.heavy_rows, rank)


def _ranked_aggregate(kept: DataFrame, keys: list[str], trim_fraction: float, split: bool) -> DataFrame:
    """Both rankings (raw total for trim and spread, adjusted price for the median), then one
    aggregate. Without ``split`` all of it runs on a single shuffle by key."""
    slices = [F.to_date("sold_at"), F.substring(F.col("comp_id").cast("string"), 1, 6)]
    ties = ["sold_at", "comp_id"]
    ranked = positions(kept, keys, "total", ties, slices=slices, split=split)
    trim = F.when(
        F.col("group_n") >= 8, F.greatest(F.lit(1), F.floor(F.col("group_n") * F.lit(trim_fraction)))
    ).otherwise(F.lit(0))
    inner = (
        ranked.withColumn("_trim", trim)
        .where((F.col("pos") > F.col("_trim")) & (F.col("pos") <= F.col("group_n") - F.col("_trim")))
        .withColumn("n", F.col("group_n") - 2 * F.col("_trim"))
        .withColumn("idx", F.col("pos") - F.col("_trim") - 1)
        .drop("pos", "group_n", "_trim")
    )
    inner = durable(inner) if split else inner
    weighed = positions(inner, keys, "adjusted", ties, "weight", slices, split)
    half = F.col("cum") * 2 >= F.col("cum_total")
    middle = F.abs(2 * F.col("pos") - F.col("group_n") - 1) <= 1
    out = weighed.groupBy(*keys).agg(
        F.min(F.when(half, F.col("adjusted"))).alias("weighted"),
        F.max("cum_total").alias("_tot"),
        F.avg(F.when(middle, F.col("adjusted"))).alias("_plain"),
        F.max("n").alias("comp_count"),
        F.max(F.when(F.col("idx") == F.expr("n div 4"), F.col("total"))).alias("q1"),
        F.max(F.when(F.col("idx") == F.expr("(3 * n) div 4"), F.col("total"))).alias("q3"),
        # whole days within the age limit, so few distinct values
        F.median("age_days").alias("median_age_days"),
        F.array_sort(F.collect_set("source")).alias("sources"),
    )
    value = F.when(F.col("_tot") > 0, F.col("weighted")).otherwise(F.col("_plain"))
    return out.withColumn("comp_value", value).withColumn(
        "spread", F.when((F.col("comp_count") >= 4) & (F.col("comp_value") != 0),
                         (F.col("q3") - F.col("q1")) / F.col("comp_value"))
    ).select(*keys, "comp_value", "comp_count", "spread", "median_age_days", "sources")


def aggregate_packed(pack: DataFrame, as_of: Column, params: Params = Params()) -> DataFrame:
    """The same aggregate for packed points: a lookup gives an item a capped number of comps, so
    they fit in the row and neither a shuffle nor a window is needed."""
    cutoff = as_of - F.expr(f"INTERVAL {params.max_age_days} DAYS")

    def usable(r: Column) -> Column:
        fresh = r["sold_at"].isNull() | (r["sold_at"] >= cutoff)
        return (r["similarity"] >= params.min_similarity) & fresh & (_row_total(r) > 0)

    def point(r: Column) -> Column:
        weight = (
            money.source_weight(r["source"]) * money.recency_weight(r["sold_at"], as_of, params.half_life_days)
            * F.greatest(F.lit(0.1), r["similarity"])).cast("decimal(18,9)")
        return F.struct(
            _row_total(r).alias("total"), r["sold_at"].alias("sold_at"), r["comp_id"].alias("comp_id"),
            (_row_total(r) * F.when(r["is_sold"], 1.0).otherwise(lx.ASKING_HAIRCUT)).alias("adjusted"),
            weight.alias("weight"), F.floor(money.days_between(as_of, r["sold_at"])).alias("age"), r["source"].alias("source"))

    rows = pin(pack, _p=F.array_sort(F.transform(F.filter("rows", usable), point))).where(F.size("_p") > 0)
    n0 = F.size("_p")
    trim = F.when(n0 >= 8, F.greatest(F.lit(1), F.floor(n0 * F.lit(params.trim_fraction)).cast("int"))).otherwise(F.lit(0))
    rows = pin(rows, _k=F.slice("_p", trim + 1, n0 - 2 * trim))
    by_price = F.array_sort(F.transform(
        "_k", lambda p: F.struct(p["adjusted"], p["sold_at"], p["comp_id"], p["weight"])))
    rows = pin(
        rows, _a=by_price,
        _tot=F.aggregate("_k", F.lit(0).cast("decimal(38,9)"), lambda acc, p: (acc + p["weight"]).cast("decimal(38,9)")),
        _ages=F.array_sort(F.array_compact(F.transform("_k", lambda p: p["age"]))))
    start = F.struct(F.lit(0).cast("decimal(38,9)").alias("cum"), F.lit(None).cast("double").alias("hit"))

    def step(acc: Column, p: Column) -> Column:
        cum = (acc["cum"] + p["weight"]).cast("decimal(38,9)")
        return F.struct(cum.alias("cum"), F.coalesce(acc["hit"], F.when(cum * 2 >= F.col("_tot"), p["adjusted"])).alias("hit"))

    n = F.size("_k")

    def at(arr: str, index: Column) -> Column:
        return F.get(F.col(arr), index.cast("int"))

    def middle(arr: str, field: str | None = None) -> Column:
        size = F.size(arr)
        low, high = at(arr, F.floor((size - 1) / 2)), at(arr, F.floor(size / 2))
        return ((low[field] + high[field]) if field else (low + high)) / F.lit(2.0)

    value = F.when(F.col("_tot") > 0, F.aggregate("_a", start, step)["hit"]).otherwise(middle("_a", "adjusted"))
    rows = pin(rows, comp_value=value)
    spread = (at("_k", F.floor(3 * n / 4))["total"] - at("_k", F.floor(n / 4))["total"]) / F.col("comp_value")
    return rows.select(
        *[c for c in pack.columns if c != "rows"], "comp_value", n.cast("long").alias("comp_count"),
        F.when((n >= 4) & (F.col("comp_value") != 0), spread).alias("spread"),
        F.when(F.size("_ages") > 0, middle("_ages")).alias("median_age_days"),
        F.array_sort(F.array_distinct(F.transform("_k", lambda p: p["source"]))).alias("sources"))


def _row_total(r: Column) -> Column:
    return r["price"] + F.coalesce(r["shipping"], F.lit(0.0))


def weighted_median(
    df: DataFrame, keys: Sequence[str], value: str, weight: str, ties: Sequence[str], params: Params = Params(),
    slices: Sequence[Column] = (),
) -> DataFrame:
    """Lowest value whose running weight reaches half the total; plain median without weight."""
    rows = df.withColumn("_w", F.col(weight).cast("decimal(18,9)"))
    middle = F.abs(2 * F.col("pos") - F.col("group_n") - 1) <= 1

    def rank(part: DataFrame, split: bool) -> DataFrame:
        ranked = positions(part, keys, value, ties, "_w", slices, split)
        return ranked.groupBy(*keys).agg(
            F.min(F.when(F.col("cum") * 2 >= F.col("cum_total"), F.col(value))).alias("_m"),
            F.max("cum_total").alias("_t"), F.avg(F.when(middle, F.col(value))).alias("_p"), F.count(F.lit(1)).alias("n"),
        )

    out = split_heavy(rows, keys, params.heavy_rows, rank)
    return out.select(*keys, F.when(F.col("_t") > 0, F.col("_m")).otherwise(F.col("_p")).alias("weighted_median"), "n")


def comps_by_source(comps: DataFrame, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct("query_key") if approximate else F.countDistinct("query_key")
    return comps.groupBy("source").agg(F.count(F.lit(1)).alias("comps"), distinct.alias("distinct_items"))

