"""Savings reference and purpose guess columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gavelflow import lexicon as lx
from gavelflow.functions.money import whole
from gavelflow.functions.text import any_term, as_col, first_term


def choose_reference(retail: Column, comp_value: Column, comp_count: Column) -> Column:
    comps = (comp_value > 0) & (F.coalesce(comp_count, F.lit(0)) >= 3)
    comps = F.coalesce(comps, F.lit(False))
    stated = F.coalesce(retail != 0, F.lit(False))
    credible = stated & (retail <= comp_value * lx.RETAIL_CREDIBLE_RATIO)
    basis = (
        F.when(comps & credible, "retail_verified").when(comps, "comps")
        .when(F.coalesce(retail > 0, F.lit(False)), "retail_stated").otherwise("none")
    )
    value = F.when(comps, comp_value).when(retail > 0, retail * lx.STATED_RETAIL_CUT)
    n = comp_count.cast("string")
    note = (
        F.when(comps & credible, F.concat(n, F.lit(" comparable sales, consistent with the $"), whole(retail), F.lit(" retail claim")))
        .when(comps & stated, F.concat(F.lit("stated retail $"), whole(retail), F.lit(" looks inflated against "), n,
                                       F.lit(" comparable sales — measured against comps instead")))
        .when(comps, F.concat(n, F.lit(" comparable sales")))
        .when(retail > 0, F.concat(F.lit("no comps yet — using 70% of the stated $"), whole(retail), F.lit(" retail, which is unverified")))
        .otherwise(F.lit("no retail price and no comps — savings can't be claimed"))
    )
    return F.struct(value.alias("reference_value"), basis.alias("basis"), note.alias("note"))


def savings(reference: Column, landed: Column, repair: Column) -> Column:
    spent = landed + F.coalesce(repair, F.lit(0.0))
    gain = reference - spent
    return F.struct(
        spent.alias("spent"), gain.alias("savings"),
        F.when(reference > 0, gain / reference).alias("savings_pct"),
    )


def categorise(title, category=None, description=None, profit: Column | None = None, matched_want: Column | None = None) -> Column:
    """Struct of purpose, sub-category, confidence and reason."""
    parts = [F.nullif(F.lower(as_col(c)), F.lit("")) for c in (title, category, description) if c is not None]
    text = F.concat_ws(" ", *parts)
    profit = F.lit(None).cast("double") if profit is None else profit
    want = F.lit(False) if matched_want is None else F.coalesce(matched_want, F.lit(False))
    toy = any_term(text, lx.TOY_TERMS)
    child = text.rlike(lx.CHILD_WORDING) & ~any_term(text, lx.OFFICE_TERMS)
    fixture, office, supply, bulk = (
        any_term(text, t) for t in (lx.FIXTURE_TERMS, lx.OFFICE_TERMS, lx.SUPPLY_TERMS, lx.BULK_TERMS)
    )

    def pick(toy_v, child_v, fixture_v, office_v, supply_v, want_v, profit_v, bulk_v, none_v) -> Column:
        return (
            F.when(toy, toy_v).when(child, child_v).when(fixture, fixture_v).when(office, office_v)
            .when(supply, supply_v).when(want, want_v).when(profit > 0, profit_v)
            .when(bulk, bulk_v).otherwise(none_v)
        )

    none = F.lit(None).cast("string")
    org = F.lit("org_expense")

    def said(label: str, terms: list[str]) -> Column:
        return F.concat(F.lit(label + " ("), first_term(text, terms), F.lit(")"))

    return F.struct(
        pick(org, org, org, org, org, F.lit("personal"), F.lit("resell"), F.lit("resell"), F.lit("undecided")).alias("purpose"),
        pick(F.lit("inventory_toys"), F.lit("inventory_toys"), F.lit("fixtures"), F.lit("office"), F.lit("supplies"),
             none, none, none, none).alias("sub_category"),
        pick(*[F.lit(x) for x in (0.9, 0.65, 0.7, 0.7, 0.7, 0.8, 0.75, 0.5, 0.0)]).alias("confidence"),
        pick(
            said("reads as toy-library stock", lx.TOY_TERMS),
            F.lit("reads as toy-library stock (child-directed wording)"),
            said("storage/room fit-out", lx.FIXTURE_TERMS), said("office or admin equipment", lx.OFFICE_TERMS),
            said("operating supplies", lx.SUPPLY_TERMS),
            F.lit("matched something on your want list"),
            F.concat(F.lit("resale engine projected $"), F.format_number(profit, 2), F.lit(" profit")),
            F.lit("bulk/assorted wording suggests a flip"),
            F.lit("no clear signal — needs categorising by hand"),
        ).alias("reason"),
    )
