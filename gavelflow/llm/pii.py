"""Personal data by pattern, and the words around it that give it away.

Patterns find email addresses, IP addresses, card and phone numbers. Each value is a protected
entity. For the words near its mentions, co-occurrence over the whole corpus tells how much of the
entity's information they carry: with n documents, n_e of them with the entity, n_t with the word
and n_te with the word near the entity, the share of the word's documents that name the entity is
shrunk toward the share of all documents that do,

    p = (n_te + c n_e / n) / (n_t + c)

and disclosure is the pointwise mutual information as a share of the entity's own information,

    log2(p n / n_e) / log2(n / n_e)

which nears 1 where the word never stands without the entity. The prior weighs as much as ``prior``
different texts: c is ``prior`` times the documents per different text with the word near the entity,
so exact copies add no evidence. A word near an entity named in one text is judged too: it discloses
as much as it is rare in the corpus. From ``remove_at`` on, a word is removed from the documents of
that entity; from ``generalise_at`` on, it is replaced by a class mark.

All of it is column functions and SQL aggregates. Positions are code points, ends exclusive.

Defined cases: a missing text is empty and has no spans; values of one kind never overlap, those of
different kinds may and are all reported; a replacement covers overlapping spans once, the leftmost
(then longest) first; repeated rows count each as documents, and get the same spans; an empty table
gives an empty result; a very long text is searched whole, in one row; result columns replace input columns
of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelflow.llm.common import DOC_KEY, doc_key, let, on_doc, packed_rows, stored, whole, with_columns_replaced

# The stated patterns. A match starts where a run of its characters starts, or where the last match
# ended (\G), and quantifiers are possessive: the same matches, without quadratic search.
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
KINDS = ["email", "ip", "card", "phone"]
NEAR = 100
TERM = r"(?U)\p{L}{4,}"


def found(text: Column, pattern: Column | str) -> Column:
    """``array<struct<start, end, value>>`` of all matches, from the lengths of matches and gaps."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern

    def placed(both: Column) -> Column:
        size = F.transform(both["m"], lambda v, i: F.length(v) + F.length(F.get(both["g"], i)))
        return let(F.struct(both["m"].alias("m"), size.alias("n")), lambda x: F.transform(x["m"], lambda v, i: let(
            F.aggregate(F.slice(x["n"], F.lit(1), i + 1), F.lit(0), lambda a, b: a + b),
            lambda end: F.struct((end - F.length(v)).cast("long").alias("start"), end.cast("long").alias("end"), v.alias("value")))))

    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    return let(matches, lambda m: F.when(F.size(m) == 0, none).otherwise(let(
        F.struct(m.alias("m"), F.split(text, pattern).alias("g")), placed)))


def _lower(text: Column) -> Column:
    """Lower case of the same length: the only letter that would grow is replaced before."""
    return F.lower(F.translate(text, "\u0130", "i"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def worth(i: Column) -> Column:  # i counts from the right
        d = F.substr(digits, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), worth), F.lit(0), lambda a, b: a + b)
    return total % 10 == 0


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), lambda p: let(
        F.ltrim(p, F.lit("0")), lambda q: (F.length(q) <= 3) & (F.coalesce(q.try_cast("int"), F.lit(0)) <= 255))),
    "card": lambda v: let(_digits(v), lambda d: F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False)),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}
NAME = {"email": F.lower, "ip": lambda v: v, "card": _digits, "phone": _digits}


def base_spans(text: Column) -> Column:
    """One struct with an array of valid spans per kind."""
    out = []
    for kind in KINDS:
        valid = VALID[kind]
        spans = let(found(text, PATTERNS[kind]), lambda a: F.filter(a, lambda s: valid(s["value"])))
        if NEEDS[kind]:
            spans = F.when(F.instr(text, NEEDS[kind]) > 0, spans).otherwise(
                F.array().cast("array<struct<start:bigint,end:bigint,value:string>>"))
        out.append(spans.alias(kind))
    return F.struct(*out)


def _near(text: Column, s: Column) -> Column:
    """Different words within ``NEAR`` characters of a span, those cut by the border left out."""
    at = F.greatest(s["start"] - NEAR, F.lit(0))
    left = F.substr(text, (at + 1).cast("int"), (s["start"] - at).cast("int"))
    right = F.substr(text, (s["end"] + 1).cast("int"), F.lit(NEAR))
    left = F.when(at > 0, F.regexp_replace(left, r"^\p{L}+", "")).otherwise(left)
    right = F.when(F.length(right) == NEAR, F.regexp_replace(right, r"\p{L}+$", "")).otherwise(right)
    return F.array_distinct(F.regexp_extract_all(_lower(F.concat(left, F.lit(" "), right)), F.lit(TERM), F.lit(0)))


def mentions(docs: DataFrame) -> DataFrame:
    """Key, spans per kind and ``near``: entities with the words near them. Written once, small."""
    rows = docs.select(*doc_key(), whole().alias("_text"))
    spans = rows.select(*DOC_KEY, "_text", F.explode(F.array(base_spans(F.col("_text")))).alias("s"))

    def of(kind: str) -> Column:
        return F.transform(F.col("s")[kind], lambda m: F.struct(
            F.concat(F.lit(kind + ":"), NAME[kind](m["value"])).alias("entity"), _near(F.col("_text"), m).alias("terms")))

    bare = [F.transform(F.col("s")[k], lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))).alias(k) for k in KINDS]
    return stored(spans.select(*DOC_KEY, *bare, F.concat(*[of(k) for k in KINDS]).alias("near")), "mentions")


def disclosing_terms(docs: DataFrame, known: DataFrame, generalise_at: float = 0.8, remove_at: float = 0.95, prior: float = 1.0) -> DataFrame:
    """``entity, term, disclosure, removed`` of the words that give an entity away."""
    pairs = known.select("_gf_hash", F.explode("near").alias("x")).select("_gf_hash", "x.entity", F.explode("x.terms").alias("term"))
    # a text may name an entity twice, and stand in several rows
    rows = known.where(F.size("near") > 0).groupBy("_gf_hash").agg(F.count(F.lit(1)).alias("copies"))
    joint = pairs.distinct().join(rows, "_gf_hash").groupBy("entity", "term").agg(
        F.count(F.lit(1)).alias("texts"), F.sum("copies").alias("n_te"))
    holders = known.select(F.explode(F.array_distinct(F.transform("near", lambda x: x["entity"]))).alias("entity"))
    n_e = holders.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    everywhere = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(_lower(whole()), F.lit(TERM), F.lit(0)))).alias("term"))
    n_t = everywhere.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    total = docs.agg(F.count(F.lit(1)).alias("n"))
    both = joint.join(n_e, "entity").join(n_t, "term").crossJoin(F.broadcast(total))  # one row
    weight = F.lit(prior) * F.col("n_te") / F.col("texts")
    shrunk = (F.col("n_te") + weight * F.col("n_e") / F.col("n")) / (F.col("n_t") + weight)
    told = F.log2(shrunk * F.col("n") / F.col("n_e"))
    share = F.try_divide(told, F.log2(F.col("n") / F.col("n_e")))
    out = both.select("entity", "term", share.alias("disclosure")).where(F.col("disclosure") >= generalise_at)
    return out.withColumn("removed", F.col("disclosure") >= remove_at)


def term_spans(docs: DataFrame, known: DataFrame, terms: DataFrame) -> DataFrame:
    """Key and ``term``: the spans of disclosing words in the documents that hold their entity, with
    ``removed``. Words inside base spans are covered already."""
    per_entity = terms.groupBy("entity").agg(F.collect_set(F.struct("term", "removed")).alias("own"))
    held = known.select(*DOC_KEY, F.explode(F.array_distinct(F.transform("near", lambda x: x["entity"]))).alias("entity"))
    per_doc = held.join(per_entity, "entity").select(*DOC_KEY, F.explode("own").alias("x")).groupBy(*DOC_KEY).agg(
        F.collect_set(F.when(F.col("x.removed"), F.col("x.term"))).alias("gone"), F.collect_set("x.term").alias("all"))
    base = known.select(*DOC_KEY, F.flatten(F.array(*[F.col(k) for k in KINDS])).alias("base")).dropDuplicates(list(DOC_KEY))
    rows = docs.select(*doc_key(), whole().alias("_text"))
    rows = on_doc(rows, on_doc(per_doc, base, "inner"), "inner")
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(F.array_sort("all"), "|"), F.lit(r")(?!\p{L})"))
    hits = F.filter(found(_lower(F.col("_text")), pattern), lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    spans = F.transform(hits, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.array_contains("gone", s["value"]).alias("removed")))
    return rows.select(*DOC_KEY, spans.alias("term")).dropDuplicates(list(DOC_KEY))


def find_personal_data(docs: DataFrame, **thresholds) -> DataFrame:
    """Key, base spans per kind, and ``term`` spans, of every row."""
    known = mentions(docs)
    more = term_spans(docs, known, disclosing_terms(docs, known, **thresholds))
    none = F.array().cast("array<struct<start:bigint,end:bigint,removed:boolean>>")
    return on_doc(known, more).select(*DOC_KEY, *KINDS, F.coalesce("term", none).alias("term"))


def listed(kinds: list[str]) -> Column:
    """``kind:start:end``, comma-joined, kind by kind and by start."""
    def of(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    return F.array_join(F.concat(*[of(k) for k in kinds]), ",")


def sanitise(docs: DataFrame, **thresholds) -> DataFrame:
    """The rows of ``docs`` with personal data replaced by its kind in brackets, disclosing words
    removed or replaced by ``[TERM]``, and the number of spans in ``n_spans``."""
    spans = find_personal_data(docs, **thresholds).dropDuplicates(list(DOC_KEY))

    def part(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(
            s["start"].alias("start"), (-s["end"]).alias("back"),
            (F.when(s["removed"], F.lit("")).otherwise(F.lit("[TERM]")) if kind == "term" else F.lit(f"[{kind.upper()}]")).alias("mark")))

    marks = [part(k) for k in [*KINDS, "term"]]
    spans = spans.select(*DOC_KEY, F.array_sort(F.concat(*marks)).alias("marks"))
    rows = packed_rows(docs)
    joined = on_doc(rows, spans).select("_gf_row", "marks")
    text = F.coalesce(F.col("_gf_row.text").cast("string"), F.lit(""))

    def step(a: Column, m: Column) -> Column:
        gap = F.substr(text, (a["at"] + 1).cast("int"), (m["start"] - a["at"]).cast("int"))
        return F.when(m["start"] < a["at"], F.struct(F.greatest(a["at"], -m["back"]).alias("at"), a["out"].alias("out"))).otherwise(
            F.struct((-m["back"]).alias("at"), F.concat(a["out"], gap, m["mark"]).alias("out")))

    clean = F.aggregate("marks", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(
        a["out"], F.substr(text, (a["at"] + 1).cast("int"))))
    return joined.select(*with_columns_replaced("_gf_row", docs.columns, {
        "text": F.when(F.size("marks") > 0, clean).otherwise(F.col("_gf_row.text")), "n_spans": F.size("marks").cast("long")}))
