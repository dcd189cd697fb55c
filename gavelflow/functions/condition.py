"""Condition reading and repair economics from listing text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gavelflow import lexicon as lx
from gavelflow.functions.text import as_col


def _strict(pattern: str) -> str:
    return rf"\b(?:{pattern})\b" if not pattern.endswith(r"\b") else rf"\b(?:{pattern})"


def listing_text(title, condition_name=None, condition_notes=None, description=None) -> Column:
    parts = [as_col(c) for c in (title, condition_name, condition_notes, description) if c is not None]
    return F.lower(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]))


_PATTERNS = [(kind, severity, p) for kind, severity, patterns in lx.SIGNAL_FAMILIES for p in patterns]


def _let(value: Column, fn) -> Column:
    """``fn(value)`` with the value worked out once per row."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _phrases(text: Column, strict: bool) -> Column:
    """First phrase of every pattern, empty where it does not occur. Plain words are looked up
    without the regular-expression engine."""
    def phrase(p: str) -> Column:
        if not strict and p.replace(" ", "").isalpha():
            return F.when(F.contains(text, F.lit(p)), F.lit(p)).otherwise(F.lit(""))
        return F.trim(F.regexp_extract(text, _strict(p) if strict else p, 0))

    return F.array(*[phrase(p) for _, _, p in _PATTERNS])


def _signals(phrases: Column) -> Column:
    kinds, severities = (F.array(*[F.lit(x[i]) for x in _PATTERNS]) for i in (0, 1))
    rows = F.transform(phrases, lambda p, i: F.struct(
        F.get(kinds, i).alias("kind"), p.alias("phrase"), F.get(severities, i).alias("severity")))
    return F.filter(rows, lambda r: r["phrase"] != "")


def damage_signals(text: Column, strict: bool = False) -> Column:
    """One entry per pattern that hits: kind, first phrase found, severity."""
    return _signals(_phrases(text, strict))


def _seen(phrases: Column, kind: str) -> Column:
    at = [i for i, (k, _, _) in enumerate(_PATTERNS) if k == kind]
    return F.exists(F.slice(phrases, at[0] + 1, len(at)), lambda p: p != "")


def has_signal(text: Column, kind: str, strict: bool = False) -> Column:
    patterns = next(p for k, _, p in lx.SIGNAL_FAMILIES if k == kind)
    return text.rlike("|".join(_strict(p) if strict else p for p in patterns))


def missing_phrases(text: Column) -> Column:
    """Part names after missing/no/without, known parts preferred, in text order."""
    ordered = sorted(lx.PART_PRICES, key=lambda p: -len(p))
    known = F.array(*[F.lit(p) for p in ordered])

    def tidy(raw: Column) -> Column:
        phrase = F.regexp_replace(F.trim(F.lower(raw)), r"\s+", " ")
        phrase = F.trim(F.regexp_replace(phrase, lx.PHRASE_TAIL, ""))
        phrase = F.regexp_replace(phrase, r"[.,;:/\- ]+$", "")
        part = F.get(F.filter(known, lambda p: F.contains(phrase, p)), F.lit(0))
        usable = F.length(phrase).between(3, 24) & (F.size(F.split(phrase, " ")) <= 3)
        return F.coalesce(part, F.when(usable, phrase))

    found = F.regexp_extract_all(text, F.lit(lx.MISSING_PHRASE), 1)
    return F.array_distinct(F.array_compact(F.transform(found, tidy)))


def missing_parts(title, condition_name=None, condition_notes=None, description=None, strict: bool = False) -> Column:
    """Missing parts of a listing that reads as incomplete; otherwise none."""
    text = listing_text(title, condition_name, condition_notes, description)
    empty = F.array().cast("array<string>")
    return F.when(has_signal(text, "incomplete", strict), missing_phrases(text)).otherwise(empty)


def analyze_condition(title, condition_name=None, condition_notes=None, description=None, strict: bool = False) -> Column:
    """Struct of multiplier, signals, missing parts and the fatal/untested/incomplete/cosmetic flags."""
    name = F.lit("") if condition_name is None else F.coalesce(as_col(condition_name), F.lit(""))
    grade_text = F.lower(F.concat(name, F.lit(" "), F.coalesce(as_col(title), F.lit(""))))
    grade = None
    for pattern, value in lx.GRADES:
        hit = grade_text.rlike(pattern)
        grade = F.when(hit, F.lit(value)) if grade is None else grade.when(hit, F.lit(value))
    grade = grade.otherwise(F.lit(lx.DEFAULT_GRADE))
    empty = F.array().cast("array<string>")

    def report(read: Column) -> Column:
        fatal, untested, incomplete, cosmetic = (read[k] for k in ("fatal", "untested", "incomplete", "cosmetic"))
        worn = (
            read["grade"] * F.when(untested, F.lit(0.88)).otherwise(F.lit(1.0))
            * F.when(cosmetic, F.lit(0.94)).otherwise(F.lit(1.0))
        )
        multiplier = F.when(fatal, F.least(read["grade"], F.lit(0.25))).otherwise(worn)
        clamped = F.greatest(F.lit(0.05), F.least(F.lit(1.0), multiplier))
        return F.struct(
            F.round(clamped, 4).alias("multiplier"), _signals(read["phrases"]).alias("signals"),
            F.when(incomplete, missing_phrases(read["text"])).otherwise(empty).alias("missing_parts"),
            fatal.alias("is_fatal"), untested.alias("is_untested"),
            incomplete.alias("is_incomplete"), cosmetic.alias("is_cosmetic"),
        )

    def flags(read: Column) -> Column:
        kinds = [k for k, _, _ in lx.SIGNAL_FAMILIES]
        return F.struct(
            read["text"].alias("text"), read["phrases"].alias("phrases"), grade.alias("grade"),
            *[_seen(read["phrases"], k).alias(k) for k in kinds])

    def phrases(text: Column) -> Column:
        found = F.struct(text.alias("text"), _phrases(text, strict).alias("phrases"))
        return _let(found, lambda read: _let(flags(read), report))

    return _let(listing_text(title, condition_name, condition_notes, description), phrases)


def condition_summary(report: Column | dict[str, Column]) -> Column:
    """One line about a report given as a struct or as its columns by name."""
    parts = F.array_compact(F.array(
        F.when(F.size(report["missing_parts"]) > 0,
               F.concat(F.lit("missing "), F.array_join(F.slice(report["missing_parts"], 1, 4), ", "))),
        F.when(report["is_untested"], F.lit("untested")),
        F.when(report["is_cosmetic"], F.lit("cosmetic wear")),
    ))
    return (
        F.when(report["is_fatal"], F.lit("Likely non-functional — treat as parts value only"))
        .when(F.size(parts) > 0, F.array_join(parts, "; "))
        .otherwise(F.lit("No damage signals detected"))
    )


def labor_hours(part: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in lx.LABOR_HOURS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(part))), F.lit(lx.DEFAULT_LABOR))


def assess_repair(
    value: Column, multiplier: Column, parts_cost: Column, priced_hours: Column,
    unpriced: Column, is_fatal: Column, labor_rate: float, max_repair_cost: Column | None = None,
) -> Column:
    """Struct deciding whether making the item whole pays. ``unpriced`` is an array of part names."""
    hours = priced_hours + F.lit(lx.DEFAULT_LABOR) * F.size(unpriced)
    labor = hours * F.lit(labor_rate)
    as_is = value * multiplier
    repaired = value * F.lit(0.94) - parts_cost - labor
    uplift = repaired - as_is
    total = parts_cost + labor
    score = F.when(~is_fatal & (total > 0.5), uplift / total)
    within = F.lit(True) if max_repair_cost is None else (max_repair_cost.isNull() | (parts_cost <= max_repair_cost))
    worth = ~is_fatal & (uplift > 0) & within
    note = (
        F.when(is_fatal, F.lit("Fatal damage detected — priced as parts/scrap, no repair path assumed."))
        .when(F.size(unpriced) > 0, F.concat(
            F.lit("Could not price: "), F.array_join(unpriced, ", "),
            F.lit(". Estimate assumes these are cheap — verify before bidding.")))
        .when(worth & (score >= 2.0), F.format_string(
            "Easy fix: $%.2f in parts + %.1fh recovers $%.2f of value.", parts_cost, hours, uplift))
        .when(worth, F.format_string("Repair is marginally profitable (+$%.2f).", uplift))
        .otherwise(F.lit("Repair does not pay — value it as-is."))
    )
    return F.struct(
        parts_cost.alias("parts_cost"), hours.alias("labor_hours"),
        F.when(worth, F.greatest(as_is, repaired)).otherwise(as_is).alias("repaired_value"),
        as_is.alias("as_is_value"),
        F.when(is_fatal, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), uplift)).alias("value_uplift"),
        score.alias("easy_fix_score"), worth.alias("worth"), note.alias("notes"),
    )
