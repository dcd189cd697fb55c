"""Outside prices: card classification, market view per lot, price ceiling, price-check candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gavelflow import lexicon as lx
from gavelflow.functions import alerts, money, text
from gavelflow.operators.comps import _unseen, family_matches, total
from gavelflow.operators.splitting import pin, positions, split_heavy
from gavelflow.params import Params

EXACT_KINDS = ["exact_new", "exact_used"]
SUBSTITUTE_KINDS = ["sub_new", "sub_used"]


def is_fresh(as_of: Column, params: Params = Params()) -> Column:
    cutoff = as_of - F.expr(f"INTERVAL {params.fresh_days} DAYS")
    return (F.col("observed_at") >= cutoff) & F.col("in_stock") & (total() > 0)


def qualifies(params: Params = Params()) -> Column:
    return F.coalesce(
        (F.col("rating") >= params.min_rating) & (F.col("review_count") >= params.min_reviews), F.lit(False))


# --- search cards -----------------------------------------------------------------------------
def classify_cards(cards: DataFrame) -> DataFrame:
    """Adds kind, unit price, similarity and reject reason to search-result cards.

    Cards carry title, price (text), condition, shipping, url, in_stock, rating, review_count,
    brand, and lot_title, lot_brand, lot_model of the lot that was looked up.
    """
    title = F.trim(F.coalesce("title", F.lit("")))
    price = F.col("price").cast("string").try_cast("double")
    lowered = F.lower(title)
    word = F.regexp_extract(lowered, lx.ACCESSORY_WORDS, 0)
    accessory = (word != "") & ~F.contains(F.lower(F.coalesce("lot_title", F.lit(""))), F.split(word, r"\s+")[0])
    reference = F.concat_ws(" ", F.nullif("lot_brand", F.lit("")), F.nullif("lot_model", F.lit("")), F.nullif("lot_title", F.lit("")))
    rows = pin(cards, _ref=text.title_features(reference), _card=text.title_features(title))
    rows = pin(rows, similarity=text.feature_similarity(F.col("_ref"), F.col("_card")))
    shared = F.arrays_overlap("_ref.models", "_card.models") & (F.size("_ref.models") > 0)
    looks_exact = (F.col("similarity") >= lx.EXACT_SIMILARITY) | shared
    reject = (
        F.when((title == "") | lowered.rlike(lx.JUNK_TITLE), "no usable title")
        .when(price.isNull(), "no parseable price")
        .when(price <= 0, "non-positive price")
        .when(accessory, "accessory or replacement part, not the item")
        .when(~looks_exact & (F.col("similarity") < lx.SUBSTITUTE_SIMILARITY),
              F.format_string("different product class (similarity %.2f)", F.col("similarity")))
    )
    brand_token = F.coalesce(F.get(text.significant_tokens("lot_brand", 1), F.lit(0)), F.lit(""))
    exact = looks_exact & ((brand_token == "") | F.contains(lowered, brand_token))
    badge = F.lower(F.concat_ws(" ", F.coalesce("condition", F.lit("")), title))
    used = badge.rlike(lx.USED_WORDS)
    pack = text.multipack_count(title)
    kind = (
        F.when(exact & ~used, "exact_new").when(exact, "exact_used")
        .when(~used, "sub_new").otherwise("sub_used")
    )
    rows = pin(rows, reject_reason=reject)
    ok = F.col("reject_reason").isNull()
    return rows.select(
        *[c for c in cards.columns if c not in ("title", "price", "shipping", "rating", "review_count", "in_stock", "brand")],
        title.alias("title"),
        F.when(ok, kind).alias("kind"),
        F.when(ok, money.half_up(price / pack)).alias("price"),
        F.coalesce(F.col("shipping").cast("string").try_cast("double"), F.lit(0.0)).alias("shipping"),
        F.coalesce("in_stock", F.lit(True)).alias("in_stock"),
        F.col("rating").cast("string").try_cast("double").alias("rating"),
        F.col("review_count").cast("string").try_cast("double").cast("int").alias("review_count"),
        F.coalesce(F.nullif("brand", F.lit("")), F.col("lot_brand")).alias("brand"),
        F.when(ok, money.half_up(F.col("similarity"), 3)).alias("similarity"),
        pack.alias("pack"), "reject_reason",
    )


def classify_pages(cards: DataFrame) -> DataFrame:
    """Cards classified after they were brought together by job, so the page windows that follow
    reuse that shuffle and the text work is spread over its tasks."""
    return classify_cards(cards.repartition("job_id"))


def page_results(classified: DataFrame, params: Params = Params()) -> DataFrame:
    """Marks the cards of each job: ``kept_rank`` of the usable ones in page order with repeat urls
    dropped, ``reject_rank`` of the others. All windows share the shuffle by job."""
    good = F.col("reject_reason").isNull()
    link = F.coalesce(F.nullif(F.col("url"), F.lit("")), F.concat(F.lit("#"), F.col("position").cast("string")))
    rows = classified.withColumn("_good", good).withColumn("_link", link)
    first = F.row_number().over(W.partitionBy("job_id", "_good", "_link").orderBy("position")) == 1
    rows = rows.withColumn("_first", first)
    kept = F.row_number().over(W.partitionBy("job_id", F.col("_good") & F.col("_first")).orderBy("position"))
    rejected = F.row_number().over(W.partitionBy("job_id", "_good").orderBy("position"))
    return rows.withColumn("kept_rank", F.when(F.col("_good") & F.col("_first"), kept)).withColumn(
        "reject_rank", F.when(~F.col("_good"), rejected)).drop("_good", "_link", "_first")


def _recorded(params: Params) -> Column:
    limit = params.results_per_search
    return F.col("kept_rank").isNotNull() if limit is None else F.col("kept_rank") <= limit


def keep_page(classified: DataFrame, params: Params = Params()) -> DataFrame:
    """Usable cards of each job in page order, repeat urls dropped; all, or the first
    ``results_per_search``."""
    kept = page_results(classified, params).where(_recorded(params))
    return kept.withColumn("source", F.col("site")).drop("reject_reason", "kept_rank", "reject_rank")


def page_summary(classified: DataFrame, params: Params = Params()) -> DataFrame:
    """Per job: results, kept rows, the reject lines in page order, and the status."""
    line = F.concat(F.when(F.col("title") == "", F.lit("?")).otherwise(F.col("title")), F.lit(": "), F.col("reject_reason"))
    out = page_results(classified, params).groupBy("job_id").agg(
        F.count(F.lit(1)).alias("results"), F.count_if(_recorded(params)).alias("recorded"),
        F.array_sort(F.collect_list(F.when(F.col("reject_rank").isNotNull(), F.struct("position", line.alias("line"))))).alias("_l"))
    return out.select(
        "job_id", "results", "recorded", F.transform("_l", lambda s: s["line"]).alias("rejects"),
        F.when(F.col("recorded") > 0, "done").otherwise("empty").alias("status"))


def new_prices(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows to append: positive price, (url, query_key) unseen; rows without url always pass."""
    ready = batch.where(F.col("price") > 0).select(
        *[c for c in batch.columns if c not in ("kind", "in_stock", "similarity", "title", "shipping")],
        F.coalesce("kind", F.lit("exact_new")).alias("kind"), F.coalesce("in_stock", F.lit(True)).alias("in_stock"),
        money.positive_or(F.col("similarity"), 1.0).alias("similarity"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("shipping", F.lit(0.0)).alias("shipping"),
    )
    return _unseen(ready, stored, ["url", "query_key"])


# --- market view -------------------------------------------------------------------------------
def verify_retail(street: Column, stated: Column, listings: Column) -> Column:
    """Struct of street price, status and note."""
    none_found = F.coalesce(listings, F.lit(0)) == 0
    ratio = F.when(stated > 0, street / stated).otherwise(F.lit(0.0))
    status = (
        F.when(none_found | stated.isNull(), "unverified")
        .when(ratio >= 1 + lx.RETAIL_TOLERANCE, "understated")
        .when(ratio >= 1 - lx.RETAIL_TOLERANCE, "verified").otherwise("overstated")
    )
    seen = F.concat(money.dollars(street), F.lit(" in "), listings.cast("string"), F.lit(" new listings"))
    claim = F.concat(F.lit("stated retail $"), F.format_number(stated, 0))
    note = (
        F.when(none_found & (F.coalesce(stated, F.lit(0.0)) != 0), F.concat(claim, F.lit(": unchecked, not listed new")))
        .when(none_found, F.lit("neither stated nor listed"))
        .when(stated.isNull(), F.concat(F.lit("not stated; "), seen))
        .otherwise(F.concat(claim, F.lit(": "), status, F.lit(", "), seen))
    )
    return F.struct(
        F.when(~none_found, street).alias("verified_retail"), status.alias("verification"), note.alias("note"))


def street_prices(exact_new: DataFrame, keys: Sequence[str], params: Params = Params()) -> DataFrame:
    """Upper middle of the exact-new totals per group, with their number and minimum."""
    slices = [F.substring(F.col("price_id").cast("string"), 1, 6)]

    def rank(rows: DataFrame, split: bool) -> DataFrame:
        ranked = positions(rows, keys, "total", ["price_id"], slices=slices, split=split)
        return ranked.groupBy(*keys).agg(
            F.max(F.when(F.col("pos") == F.expr("group_n div 2") + 1, F.col("total"))).alias("street"),
            F.max("group_n").alias("exact_listings"), F.min("total").alias("exact_new_price"),
        )

    return split_heavy(exact_new, keys, params.heavy_rows, rank)


def _option() -> Column:
    """Sortable description of one way to buy; the cheapest wins, then the lowest price id."""
    return F.struct("total", "price_id", "source", "kind", "rating", "review_count")


def market_by_family(families: DataFrame, prices: DataFrame, as_of: Column, params: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """Fresh prices per family, already summed up: exact listings, and substitutes per title."""
    fresh = prices.where(is_fresh(as_of, params)).withColumn("total", total())
    rows = family_matches(families, fresh).join(fresh, "query_key")
    exact = rows.where(F.col("kind").isin(EXACT_KINDS))
    street = street_prices(exact.where("kind = 'exact_new'"), ["family"], params)
    best = exact.groupBy("family").agg(F.min(_option()).alias("exact_best"), F.count(F.lit(1)).alias("exact_count"))
    good = qualifies(params)
    subs = rows.where(F.col("kind").isin(SUBSTITUTE_KINDS)).groupBy("family", F.col("title").alias("sub_title")).agg(
        F.min(F.when(good, _option())).alias("sub_best"),
        F.count_if(good).alias("sub_count"), F.count_if(~good).alias("sub_rejected"),
    )
    return best.join(street, "family", "left"), subs


def market_prices_for(lots: DataFrame, prices: DataFrame) -> DataFrame:
    """Every stored price relevant to a lot: exact kinds, and substitutes with a related title."""
    asked = pin(lots.select("lot_id", "family", "title"), _a=text.title_features("title")).drop("title")
    rows = family_matches(lots, prices).join(pin(prices, _b=text.title_features("title")), "query_key")
    near = text.feature_similarity(F.col("_a"), F.col("_b")) >= lx.TERRITORY_SIMILARITY
    return asked.join(rows, "family").where(F.col("kind").isin(EXACT_KINDS) | near).drop("_a", "_b")


def market_view(lots: DataFrame, prices: DataFrame, as_of: Column, params: Params = Params()) -> DataFrame:
    """One row per lot: street price, verification, cheapest alternative, ceiling, counts, notes.

    Prices are summed per family (and per substitute title) first, and each distinct lot title is
    compared once, so popular items do not multiply lots by prices.
    """
    exact, subs = market_by_family(lots, prices, as_of, params)
    titles = lots.select("family", "title").distinct()
    near = text.feature_similarity(F.col("_a"), F.col("_b")) >= lx.TERRITORY_SIMILARITY
    known = pin(subs, _b=text.title_features("sub_title"))
    related = pin(titles, _a=text.title_features("title")).join(known, "family").where(near).groupBy("family", "title").agg(
        F.min("sub_best").alias("sub_best"), F.sum("sub_count").alias("sub_count"), F.sum("sub_rejected").alias("sub_rejected"))
    by_title = titles.join(exact, "family", "left").join(related, ["family", "title"], "left")
    best = F.least("exact_best", "sub_best")
    view = lots.select("lot_id", "family", "title", "retail_price").join(by_title, ["family", "title"], "left")
    view = view.withColumn("best", best).withColumn(
        "check", verify_retail(F.col("street"), F.col("retail_price"), F.col("exact_listings")))
    is_new = F.col("best.kind").isin("exact_new", "sub_new")
    rejected = F.coalesce("sub_rejected", F.lit(0))
    described = describe_option(F.col("best"))
    notes = F.array_compact(F.array(
        F.col("check.note"),
        F.when(F.col("best.kind").isin(SUBSTITUTE_KINDS),
               F.concat(F.lit("best offer is of a substitute: "), described)),
        F.when(rejected > 0, F.concat(
            F.lit(f"offers under {params.min_rating} stars or {params.min_reviews} reviews: "), rejected.cast("string"))),
    ))
    return view.select(
        "lot_id", F.col("check.verified_retail").alias("verified_retail"), F.col("check.verification").alias("verification"),
        "exact_new_price", F.col("best.total").alias("best_alternative_price"), described.alias("best_alternative_note"),
        F.when(is_new, F.col("best.total") * (1 - lx.NEW_DISCOUNT)).otherwise(F.col("best.total")).alias("opportunity_ceiling"),
        (F.coalesce("exact_count", F.lit(0)) + F.coalesce("sub_count", F.lit(0))).alias("alternatives_considered"),
        rejected.alias("rejected_for_quality"), notes.alias("market_notes"),
    )


def describe_option(best: Column) -> Column:
    quality = F.when(
        (best["rating"] != 0) & (best["review_count"] != 0),
        F.concat(F.lit(", "), F.format_string("%.1f", best["rating"]), F.lit("★ from "),
                 F.format_number(best["review_count"], 0), F.lit(" reviews")),
    ).otherwise(F.lit(""))
    state = F.when(best["kind"].isin("exact_new", "sub_new"), "new").otherwise("used")
    return F.concat(money.dollars(best["total"]), F.lit(" "), state, F.lit(" at "), best["source"], quality)


def ceiling_decision(landed: Column, price: Column, ceiling: Column, described: Column) -> Column:
    """Struct allowed, ceiling, reason and its code: a bid must stay below what the item costs elsewhere."""
    over_price, over_ceiling = landed > price, landed > ceiling
    code = F.when(ceiling.isNull(), "unknown").when(over_price, "dearer").when(over_ceiling, "too close").otherwise("cheaper")
    offer = F.concat(F.lit("in all "), money.dollars(landed), F.lit(", elsewhere "), described)
    reason = (
        F.when(code == "unknown", F.lit("no offer elsewhere to compare with"))
        .when(code == "too close", F.concat(offer, F.lit(f": saves less than {lx.NEW_DISCOUNT:.0%}, limit "), money.dollars(ceiling)))
        .otherwise(offer)
    )
    allowed = F.coalesce(~(over_price | over_ceiling), F.lit(True))
    return F.struct(allowed.alias("allowed"), ceiling.alias("ceiling"), reason.alias("reason"), code.alias("code"))


# --- price checks --------------------------------------------------------------------------------
def lookup_priority(as_of: Column) -> Column:
    stake = F.greatest(F.coalesce("current_bid", F.lit(0.0)), F.coalesce("retail_price", F.lit(0.0)) * 0.25, F.lit(10.0))
    minutes = alerts.minutes_to_close(F.col("close_at"), as_of)
    return (
        F.when(minutes.isNull(), stake).when(minutes <= 0, F.lit(0.0)).when(minutes <= 60, stake * 4.0)
        .when(minutes <= 360, stake * 2.0).otherwise(stake)
    )


def lookup_candidates(
    lots: DataFrame, prices: DataFrame, jobs: DataFrame, as_of: Column, params: Params = Params(), force: bool = False,
) -> DataFrame:
    """Price checks to request: lots without a recent price, once per site not already under way."""
    asked = lots.withColumn("query", text.search_query("title", "brand", "model")).where(F.trim("query") != "")
    if not force:
        recent = prices.where(F.col("observed_at") >= as_of - F.expr(f"INTERVAL {params.fresh_days} DAYS"))
        priced = family_matches(asked, recent).select("family").distinct()
        asked = asked.join(priced, "family", "left_anti")
    sites = F.explode(F.array(*[F.lit(s) for s in params.lookup_sites])).alias("site")
    wanted = asked.select("lot_id", F.col("item_key").alias("query_key"), "query", lookup_priority(as_of).alias("priority"), sites)
    under_way = jobs.where(F.col("status").isin("pending", "leased")).select("query_key", "site").distinct()
    return wanted.join(under_way, ["query_key", "site"], "left_anti") if params.lookup_enabled else wanted.limit(0)


def queue_status(jobs: DataFrame) -> DataFrame:
    """Jobs per status, zeros kept."""
    spark = jobs.sparkSession
    names = spark.createDataFrame([(s, i) for i, s in enumerate(lx.LOOKUP_STATUSES)], "status string, ord int")
    counts = jobs.groupBy("status").agg(F.count(F.lit(1)).alias("jobs"))
    return F.broadcast(names).join(counts, "status", "left").select("status", F.coalesce("jobs", F.lit(0)).alias("jobs"))


def site_status(jobs: DataFrame, as_of: Column, params: Params = Params()) -> DataFrame:
    """Per site: last search, searches in 24 hours, and until when it is left alone."""
    blocked = F.max(F.when(F.col("status") == "blocked", F.col("finished_at")))
    until = blocked + F.expr(f"INTERVAL {params.block_cooldown_minutes} MINUTES")
    return jobs.groupBy("site").agg(
        F.max("leased_at").alias("last_search"),
        F.count_if(F.col("leased_at") >= as_of - F.expr("INTERVAL 1 DAY")).alias("searches_24h"),
        F.when(until > as_of, until).alias("blocked_until"),
    ).withColumn("enabled", F.col("site").isin(list(params.lookup_sites)))


