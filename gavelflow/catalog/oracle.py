"""Shared pieces of the oracle SQL (DuckDB). Written from the rules, not from the Spark code."""

from __future__ import annotations

import unicodedata

from gavelflow import lexicon as lx
from gavelflow.catalog.given import LOTS_AS_OF
from gavelflow.params import Params

P = Params()
# the given sales span seven years, so most queries look back further than the default
LONG = Params(max_age_days=2600, half_life_days=975.0, fresh_days=2600)
# what a lookup with a limit is tested with
NEWEST = 40
AS_OF = f"timestamp '{LOTS_AS_OF}'"


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def r2(expr: str, digits: int = 2) -> str:
    n = 10**digits
    return f"(floor(({expr}) * {n} + 0.5) / {n})"


def fold(expr: str) -> str:
    """Latin letters to ASCII, the rest dropped, lower case."""
    src, dst = [], []
    for cp in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00)]:
        flat = unicodedata.normalize("NFKD", chr(cp)).encode("ascii", "ignore").decode()
        if len(flat) == 1 and flat not in "' ":
            src.append(chr(cp))
            dst.append(flat)
    table = f"translate(coalesce({expr}, ''), '{''.join(src)}', '{''.join(dst)}')"
    spaced = f"replace(replace({table}, chr(160), ' '), '…', '...')"
    return f"lower(regexp_replace({spaced}, '[^\\x00-\\x7F]', '', 'g'))"


def tokens(folded: str) -> str:
    return f"regexp_extract_all({folded}, '[\\w\\-]+')"


def sig(toks: str, n: int | None) -> str:
    some = f"list_filter({toks}, lambda t: len(t) > 1 and t not in ({quoted(lx.STOPWORDS)}))"
    return some if n is None else f"{some}[1:{n}]"


def models(toks: str) -> str:
    unit = lx.MEASURE
    return (
        f"list_distinct(list_filter({toks}, lambda t: regexp_matches(t, '[0-9]') and regexp_full_match(t, '[a-z0-9][a-z0-9-]{{2,}}')"
        f" and not regexp_full_match(t, '(19|20)[0-9][0-9]') and not regexp_full_match(t, '{unit}')))"
    )


def sorted_models(m: str) -> str:
    return f"list_transform(list_sort(list_transform({m}, lambda t: concat(lpad(cast(1000 - len(t) as varchar), 4, '0'), t))), lambda t: t[5:])"


def family(key: str) -> str:
    p = "'^(.+:)([a-z]*[0-9][a-z0-9]*?)[a-z]{1,2}$'"
    return (
        f"case when not starts_with({key}, 'upc:') and len(regexp_extract({key}, {p}, 2)) >= 4"
        f" then concat(regexp_extract({key}, {p}, 1), regexp_extract({key}, {p}, 2)) else {key} end"
    )


def similarity(am: str, aw: str, bm: str, bw: str) -> str:
    """From model lists and distinct word lists."""
    inter = f"len(list_intersect({aw}, {bw}))"
    return (
        f"case when len({am}) > 0 and len({bm}) > 0 then case when list_has_any({am}, {bm}) then 1.0 else 0.15 end"
        f" when len({aw}) = 0 or len({bw}) = 0 then 0.0"
        f" else cast({inter} as double) / (len({aw}) + len({bw}) - {inter}) end"
    )


def title_parts(expr: str, prefix: str) -> str:
    """Two columns: <prefix>m and <prefix>w."""
    t = tokens(fold_plain(expr))
    return f"{models(t)} as {prefix}m, list_distinct({sig(t, 12)}) as {prefix}w"


def fold_plain(expr: str) -> str:
    """For texts known to be ASCII."""
    return f"lower(coalesce({expr}, ''))"


def any_of(patterns: list[str]) -> str:
    return lit("|".join(patterns))


def term_regex(terms: list[str]) -> str:
    return lit(r"\b(?:" + "|".join(terms) + r")\b")


def first_term(text: str, terms: list[str]) -> str:
    whens = ", ".join(f"case when regexp_matches({text}, {term_regex([t])}) then {lit(t)} end" for t in sorted(terms))
    return f"coalesce({whens})"


def increment(x: str) -> str:
    return f"case when {x} < 100 then 1.0 when {x} < 500 then 5.0 when {x} < 1000 then 10.0 else 25.0 end"


def snap(x: str) -> str:
    return f"case when {x} <= 0 then 0.0 else floor({x} / ({increment(x)})) * ({increment(x)}) end"


def landed(h: str, bp: str, tax: float = P.tax_rate) -> str:
    return f"({h} + {h} * {bp} + ({h} + {h} * {bp}) * {tax})"


def max_bid(net: str, margin: str, bp: str, tax: float = P.tax_rate) -> str:
    budget = f"({net} * (1.0 - {margin}))"
    raw = f"({budget} / ((1.0 + {bp}) * {1 + tax}))"
    return f"case when {net} <= 0 or {budget} <= 0 then 0.0 else {snap(raw)} end"


def bp_rate(col: str = "buyers_premium_rate") -> str:
    return f"coalesce(nullif({col}, 0), {P.premium_rate})"


def channel(col: str, index: int) -> str:
    whens = " ".join(f"when '{k}' then {v[index]}" for k, v in lx.CHANNELS.items())
    return f"case lower(coalesce({col}, 'ebay')) {whens} else {lx.CHANNELS['ebay'][index]} end"


def shipping(weight: str, category: str) -> str:
    return (
        f"case when {weight} is null then case when lower(trim({category})) in ({quoted(lx.HEAVY_CATEGORIES)}) then 18.0 else 9.5 end"
        f" when {weight} <= 1 then 5.0 when {weight} <= 5 then 9.5 when {weight} <= 10 then 14.0 when {weight} <= 20 then 22.0"
        f" when {weight} <= 50 then 38.0 else 65.0 end"
    )


def age_days(then: str, as_of: str = AS_OF) -> str:
    return f"((epoch_us({as_of}) - epoch_us({then})) / 86400000000.0)"


def recency(then: str, half: float, as_of: str = AS_OF) -> str:
    return f"case when {then} is null then 0.5 else pow(0.5, greatest(0.0, {age_days(then, as_of)}) / {half}) end"


def source_weight(col: str) -> str:
    whens = " ".join(f"when '{k}' then {v}" for k, v in lx.SOURCE_WEIGHTS.items())
    return f"case {col} {whens} else {lx.OTHER_SOURCE_WEIGHT} end"


def comp_aggregate(points: str, keys: str, p: Params) -> str:
    """SELECT of the robust aggregate over a relation of comps with similarity."""
    return f"""
      select {keys}, min(case when cum * 2 >= tot then adj end) as comp_value, max(n) as comp_count,
        case when max(n) >= 4 then (max(case when idx = n // 4 then total end) - max(case when idx = (3 * n) // 4 then total end)) * -1
          / min(case when cum * 2 >= tot then adj end) end as spread,
        median(age) as median_age_days, array_to_string(list_sort(list_distinct(list(source))), ',') as sources
      from (select *, sum(w) over (partition by {keys} order by adj, sold_at nulls first, comp_id) as cum, sum(w) over (partition by {keys}) as tot
        from (select *, pos - trim0 - 1 as idx, gn - 2 * trim0 as n
          from (select *, case when gn >= 8 then greatest(1, cast(floor(gn * {p.trim_fraction}) as bigint)) else 0 end as trim0
            from (select *, row_number() over (partition by {keys} order by total, sold_at nulls first, comp_id) as pos, count(*) over (partition by {keys}) as gn
              from (select *, price + coalesce(shipping, 0) as total,
                  (price + coalesce(shipping, 0)) * case when is_sold then 1.0 else {lx.ASKING_HAIRCUT} end as adj,
                  floor({age_days('sold_at')}) as age,
                  cast({source_weight('source')} * ({recency('sold_at', p.half_life_days)}) * greatest(0.1, similarity) as decimal(18, 9)) as w
                from {points}
                where similarity >= {p.min_similarity} and (sold_at is null or sold_at >= {AS_OF} - to_days({p.max_age_days}))
                  and price + coalesce(shipping, 0) > 0)))
          where pos > trim0 and pos <= gn - trim0))
      group by {keys}"""


def confidence(value: str, n: str, spread: str, age: str, sources: str) -> dict[str, str]:
    """Column expressions score, level, bump."""
    sold = f"list_has_any(string_split({sources}, ','), ['house', 'csv', 'ebay_sold'])"
    sample = f"case when {n} >= 12 then 1.0 when {n} >= 6 then 0.75 when {n} >= {P.min_sample} then 0.5 else 0.25 end"
    disp = f"case when {spread} is null then 0.6 when {spread} <= 0.25 then 1.0 when {spread} <= 0.5 then 0.75 when {spread} <= 0.9 then 0.45 else 0.2 end"
    fresh = f"case when {age} is null then 0.5 when {age} <= 30 then 1.0 when {age} <= 60 then 0.8 when {age} <= 90 then 0.6 else 0.35 end"
    agree = f"case when {sold} and len(string_split({sources}, ',')) > 1 then 1.0 when {sold} then 0.85 else 0.45 end"
    score = (
        f"case when {value} is null or {n} = 0 then 0.0 else round(0.40::double * ({sample}) + 0.25::double * ({disp})"
        f" + 0.20::double * ({fresh}) + 0.15::double * ({agree}), 9) end"
    )
    none = f"({value} is null or {n} = 0)"
    level = f"case when {none} then 'none' when ({score}) >= 0.78 then 'high' when ({score}) >= 0.55 then 'medium' else 'low' end"
    bump = f"case when {none} then {P.low_bump * 2} when ({score}) >= 0.78 then 0.0 when ({score}) >= 0.55 then {P.med_bump} else {P.low_bump} end"
    return {"score": score, "level": level, "bump": bump, "sold": sold}


def lookup_views(x: str, n: int | None) -> dict[str, str]:
    """Views ``<x>_house_rows`` and ``<x>_stored_rows`` of the lookup, with the newest ``n`` comps or all."""
    cols = "comp_id, source, query_key, title, price, shipping, condition, is_sold, coalesce(sold_at, observed_at) as sold_at, observed_at, url"

    def newest(keys: str, order: str, rows: int | None) -> str:
        return "" if rows is None else f"qualify row_number() over (partition by {keys} order by {order}, comp_id) <= {rows}"

    sold, seen, brand = "sold_at desc nulls last", "observed_at desc", "string_split(query_key, ':')[2]"
    v = {}
    v[f"{x}_by_key"] = f"select * from o_house {newest('query_key', sold, n)}"
    v[f"{x}_by_family"] = f"""
      select f.family, c.* from (select distinct family from o_asked) f
      join (select distinct query_key as k from o_house) on starts_with(k, f.family) join o_house c on c.query_key = k
      {newest('f.family', sold, n)}"""
    v[f"{x}_by_brand"] = f"""
      select {brand} as brand_key, c.* from o_house c where starts_with(query_key, 'bm:') {newest(brand, sold, n and 3 * n)}"""
    v[f"{x}_tiers"] = f"""
      select item_key, family, brand_key,
        case when case when n1 < 5 and family <> item_key then n2 else n1 end < 3 and brand_key is not null then 3
          when n1 < 5 and family <> item_key then 2 else 1 end as tier
      from (select a.*, (select count(*) from {x}_by_key k where k.query_key = a.item_key) as n1,
        (select count(*) from {x}_by_family f where f.family = a.family) as n2 from o_asked a)"""
    v[f"{x}_house_rows"] = f"""
      select item_key, tier, {cols} from {x}_tiers join {x}_by_key c on c.query_key = item_key where tier = 1
      union all select t.item_key, tier, {cols} from {x}_tiers t join {x}_by_family c on c.family = t.family where tier = 2
      union all select t.item_key, tier, {cols} from {x}_tiers t join {x}_by_brand c on c.brand_key = t.brand_key where tier = 3"""
    v[f"{x}_stored"] = f"""
      select f.family, c.* from (select distinct family from o_asked) f
      join (select distinct query_key as k from v_comps where source <> 'house') on starts_with(k, f.family)
      join v_comps c on c.query_key = k and c.source <> 'house'
      {newest('f.family', seen, n)}"""
    v[f"{x}_stored_rows"] = f"select item_key, 0 as tier, {cols} from o_asked a join {x}_stored c on c.family = a.family"
    return v


def oracle_views() -> dict[str, str]:
    v: dict[str, str] = {}
    bt, mt, tt = (tokens(fold_plain(c)) for c in ("brand", "model", "title"))
    # item identity of the lots
    v["o_lots"] = f"""
      select *, {family('item_key')} as family, case when starts_with(item_key, 'bm:') then string_split(item_key, ':')[2] end as brand_key
      from (select *, case when len(digits) >= 8 then 'upc:' || digits
            when mtok is not null and btok <> '' then 'bm:' || btok || ':' || mtok when mtok is not null then 'm:' || mtok
            when len(tw) > 0 then 't:' || array_to_string(list_sort(tw), '-') else 't:unknown' end as item_key
        from (select *, case when btok <> '' and not list_contains(words, btok) then list_concat([btok], words)[1:5] else words end as tw
          from (select *, coalesce({sig(bt, 1)}[1], '') as btok,
              coalesce({sorted_models(models(mt))}[1], {sig(mt, 1)}[1], {sorted_models(models(tt))}[1]) as mtok,
              regexp_replace(coalesce(upc, ''), '[^0-9]', '', 'g') as digits, {sig(tt, 5)} as words
            from v_lots)))"""
    v["o_titles"] = f"select distinct title as t, {title_parts('title', 't')} from (select title from v_lots union select title from v_comps union select title from v_prices)"
    v["o_asked"] = "select distinct item_key, family, brand_key from o_lots"
    v["o_house"] = "select * from v_comps where source = 'house'"
    v |= lookup_views("o", None) | lookup_views("n", NEWEST)
    v["o_hits"] = f"""
      select l.lot_id, l.title as asked_title, r.*,
        case when source = 'house' and query_key = r.item_key then 1.0 else {similarity('a.tm', 'a.tw', 'b.tm', 'b.tw')} end as similarity
      from (select * from o_house_rows union all select * from o_stored_rows) r join o_lots l on l.item_key = r.item_key
      join o_titles a on a.t = l.title join o_titles b on b.t = r.title"""
    # one row per listing and lot when (source, url) repeats; the lowest comp id stands for it
    v["o_points"] = """
      select * from o_hits where url is null union all
      select * from o_hits where url is not null qualify row_number() over (partition by lot_id, source, url order by comp_id) = 1"""
    v["o_values"] = comp_aggregate("o_points", "lot_id", LONG)
    v["o_market_rows"] = f"""
      select l.lot_id, p.*, price + coalesce(p.shipping, 0) as total, coalesce(rating >= 4.0 and review_count >= 25, false) as good
      from o_lots l join (select distinct query_key as k from v_prices) on starts_with(k, l.family) join v_prices p on p.query_key = k
      join o_titles a on a.t = l.title join o_titles b on b.t = p.title
      where kind in ('exact_new', 'exact_used') or {similarity('a.tm', 'a.tw', 'b.tm', 'b.tw')} >= 0.2"""
    v["o_view"] = f"""
      select lot_id, retail_price, street, exact_new_price, best.total as best_price, best.kind in ('exact_new', 'sub_new') as best_new,
        case when best.kind in ('exact_new', 'sub_new') then best.total * 0.7::double else best.total end as ceiling, considered, rejected,
        case when street is null or retail_price is null then 'unverified' when ratio >= 1.25 then 'understated' when ratio >= 0.75 then 'verified' else 'overstated' end as verification
      from (select *, case when retail_price > 0 then street / retail_price else 0.0 end as ratio
        from (select l.lot_id, any_value(l.retail_price) as retail_price,
            max(case when kind = 'exact_new' and pos = n // 2 + 1 then total end) as street, min(case when kind = 'exact_new' then total end) as exact_new_price,
            arg_min({{'total': total, 'kind': kind}}, {{'t': total, 'i': price_id}}) filter (where kind like 'exact%' or good) as best,
            count(price_id) filter (where kind like 'exact%' or good) as considered, count(price_id) filter (where kind like 'sub%' and not good) as rejected
          from v_lots l left join (select *, row_number() over (partition by lot_id, kind order by total, price_id) as pos, count(*) over (partition by lot_id, kind) as n
            from o_market_rows where observed_at >= {AS_OF} - to_days({LONG.fresh_days}) and in_stock and total > 0) m on m.lot_id = l.lot_id
          group by l.lot_id))"""
    v["o_live"] = "select * from v_commit where status in ('leading', 'outbid')"
    v["o_overlap"] = f"""
      select a.lot_id, b.lot_id as other from v_lots a join (select distinct l.lot_id, l.close_at from o_live join v_lots l using (lot_id) where not is_closed) b
      on a.lot_id <> b.lot_id and abs(epoch_us(a.close_at) - epoch_us(b.close_at)) <= {P.overlap_minutes * 60_000_000}"""
    return v


def exposure_sql(source: str, landed_col: str, p: Params) -> str:
    """source columns plus worst, cat_worst, overlaps, allowed, block."""
    return f"""
      select *, worst <= {p.max_total_exposure} and (held or cnt + 1 <= {p.max_open_lots}) and cat_worst <= {p.max_category_exposure} as allowed,
        case when worst > {p.max_total_exposure} then 'total' when not held and cnt + 1 > {p.max_open_lots} then 'lots'
          when cat_worst > {p.max_category_exposure} then 'category' when n_over > 0 then 'overlap' end as why
      from (select s.*, own.landed_at_max is not null as held, cnt, tot - coalesce(own.landed_at_max, 0) + {landed_col} as worst,
          coalesce(ct, 0) - case when own.landed_at_max is not null and lower(coalesce(own.category, 'uncategorized')) = lower(coalesce(s.category, 'uncategorized'))
            then own.landed_at_max else 0 end + {landed_col} as cat_worst,
          (select count(*) from o_overlap v where v.lot_id = s.lot_id) as n_over
        from {source} s cross join (select coalesce(sum(landed_at_max), 0) as tot, count(*) as cnt from o_live)
        left join v_commit own on own.lot_id = s.lot_id
        left join (select lower(coalesce(category, 'uncategorized')) as cat, sum(landed_at_max) as ct from o_live group by 1)
          on cat = lower(coalesce(s.category, 'uncategorized')))"""
