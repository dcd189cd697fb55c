"""Listings out of web pages: embedded JSON first, page cards where there is none."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelflow import lexicon as lx
from gavelflow.operators.splitting import top_per_group
from gavelflow.session import durable
from gavelflow.sources import payloads

JSON_PRIORITY, CARD_PRIORITY = 10, 30
RICH = ["retail_price", "close_at", "description", "condition_name", "category"]


def json_bodies(pages: DataFrame) -> DataFrame:
    """(page_id, requested_id, blob, body) of every JSON text in a page."""
    bodies = F.concat(F.regexp_extract_all("html", F.lit(lx.PAGE_GLOBAL), 1), F.regexp_extract_all("html", F.lit(lx.PAGE_SCRIPT), 1))
    return pages.select("page_id", "requested_id", F.posexplode(bodies).alias("blob", "body"))


def richest(found: DataFrame) -> DataFrame:
    """Per page and lot the record with most key fields filled; the first found wins a tie."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in RICH[1:]), F.col(RICH[0]).isNotNull().cast("int"))
    order = [filled.desc(), F.col("blob"), F.col("shape"), F.col("node")]
    return top_per_group(found, ["page_id", "lot_id"], order, 1)


def embedded_listings(pages: DataFrame, base_url: str) -> DataFrame:
    """Lots from the JSON a page carries."""
    found = payloads.find_listings(json_bodies(pages), "body", ["page_id", "requested_id", "blob"], nested=True)
    rows = payloads.to_listings(found, base_url, ["page_id", "requested_id", "blob", "shape", "node"])
    return richest(rows)


# --- cards --------------------------------------------------------------------------------------
_EMPTY_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Tags that end an open one of their kind.
_SIBLINGS = {"p", "li", "option", "dt", "dd", "tr", "td", "th"}
_HEADS = ("h1", "h2", "h3", "h4")
_LABELS = (("retail", re.compile(lx.RETAIL_LABEL, re.I)), ("bid", re.compile(lx.BID_LABEL, re.I)))
CARD = "page_id long, requested_id string, pos int, lot_id string, title string, current_bid double, retail_price double, image string, error string"


class _Outline(HTMLParser):
    """A page as flat lists. An element is a row of ``tag, attrs, parent``; what it holds is the range
    of elements and texts from its own place to ``last``, so nothing here recurses."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.attrs, self.parent, self.last, self.first_text, self.last_text = [], [], [], [], [], []
        self.texts: list[str] = []
        self.open: list[int] = []
        self.feed(html)
        self.close()
        self._end(0)

    def _end(self, depth: int) -> None:
        for i in self.open[depth:]:
            self.last[i], self.last_text[i] = len(self.tag), len(self.texts)
        del self.open[depth:]

    def handle_starttag(self, tag, attrs):
        if tag in _SIBLINGS and self.open and self.tag[self.open[-1]] == tag:
            self._end(len(self.open) - 1)
        self.tag.append(tag)
        self.attrs.append(dict(attrs))
        self.parent.append(self.open[-1] if self.open else None)
        self.last.append(len(self.tag))
        self.first_text.append(len(self.texts))
        self.last_text.append(len(self.texts))
        if tag not in _EMPTY_TAGS:
            self.open.append(len(self.tag) - 1)

    def handle_endtag(self, tag):
        depth = next((d for d in range(len(self.open) - 1, -1, -1) if self.tag[self.open[d]] == tag), None)
        if depth is not None:
            self._end(depth)

    def handle_data(self, data):
        if data.strip() and not (self.open and self.tag[self.open[-1]] in ("script", "style")):
            self.texts.append(data.strip())

    def inside(self, i: int) -> list[str]:
        return self.texts[self.first_text[i]:self.last_text[i]]

    def places(self, *tags: str, attr: str | None = None) -> list[int]:
        return [i for i, t in enumerate(self.tag) if t in tags and (attr is None or attr in self.attrs[i])]


def _within(places: list[int], page: _Outline, i: int) -> int | None:
    """First of the sorted places that lies in element ``i``."""
    k = bisect_left(places, i)
    return places[k] if k < len(places) and places[k] < page.last[i] else None


def _label_of(text: str, at: int) -> str | None:
    """The label that ends nearest before ``at``; retail where two are as near."""
    before = text[max(0, at - lx.LABEL_REACH):at]
    ends = [(max((h.end() for h in p.finditer(before)), default=-1), name) for name, p in _LABELS]
    nearest = max(end for end, _ in ends)
    return None if nearest < 0 else next(name for end, name in ends if end == nearest)


def _amounts(text: str) -> tuple[float | None, float | None]:
    """(bid, retail) of a card: labelled amounts first; of the others the least is the bid and the
    most the retail price."""
    money = [(float(m.group(1).replace(",", "")), _label_of(text, m.start())) for m in re.finditer(lx.CARD_MONEY, text)]
    bid = next((v for v, label in money if label == "bid"), None)
    retail = next((v for v, label in money if label == "retail"), None)
    values = sorted(v for v, _ in money)
    if bid is None:
        others = [v for v in values if retail is None or v != retail]
        bid = others[0] if others else None
    if retail is None:
        others = [v for v in values if bid is not None and v > bid]
        retail = others[-1] if others else None
    return bid, retail


def _cards(html: str, requested: str | None) -> Iterator[tuple]:
    """``(lot_id, title, bid, retail, image)`` of each lot that a page links to; where the asked lot is
    not among them, the page itself is its card."""
    page = _Outline(html)
    links = [(i, m.group(1)) for i in page.places("a", attr="href") if (m := re.search(lx.LOT_LINK, page.attrs[i]["href"] or ""))]
    alts, sources, heads = page.places("img", attr="alt"), page.places("img", attr="src"), {h: page.places(h) for h in _HEADS}
    done = set()
    for link, lot in links:
        if lot in done:
            continue
        card = link
        for _ in range(lx.CARD_PARENTS):
            above = page.parent[card]
            if above is not None and page.tag[above] not in ("body", "html"):
                card = above
        named = [("".join(page.inside(link))), *[page.attrs[i]["alt"] or "" for i in [_within(alts, page, card)] if i is not None]]
        named += ["".join(page.inside(i)) for h in _HEADS for i in [_within(heads[h], page, card)] if i is not None]
        title = next((t.strip() for t in named if len(t.strip()) > lx.TITLE_OVER), None)
        if title is None:
            continue
        done.add(lot)
        shown = next((page.attrs[i]["src"] for i in sources[bisect_left(sources, card):bisect_left(sources, page.last[card])] if page.attrs[i]["src"]), None)
        bid, retail = _amounts(" ".join(page.inside(card)))
        yield lot, title, bid or 0.0, retail, shown
    body = next(iter(page.places("body")), None)
    head = next(iter(page.places("h1") or page.places("title")), None)
    if requested and requested not in done and body is not None and head is not None and page.inside(head):
        bid, retail = _amounts(" ".join(page.inside(body)))
        yield requested, "".join(page.inside(head)), bid or 0.0, retail, None


def _rows(page_id, html: str | None, requested: str | None) -> list[tuple]:
    try:
        return [(page_id, requested, pos, *card, None) for pos, card in enumerate(_cards(html or "", requested))]
    except (AssertionError, ValueError) as exc:  # markup the parser refuses
        return [(page_id, requested, 0, None, None, None, None, None, f"{type(exc).__name__}: {exc}")]


def page_cards(pages: DataFrame, base_url: str, errors: bool = False) -> DataFrame:
    """Lots from the visible cards of a page; first link per lot wins. ``errors`` gives the pages that
    could not be read instead, with the reason in ``error``."""
    columns = [part.split()[0] for part in CARD.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [row for p, r, h in zip(batch["page_id"].tolist(), batch["requested_id"].tolist(), batch["html"].tolist(), strict=True) for row in _rows(p, h, r)]
            yield pd.DataFrame(rows, columns=columns, dtype=object)

    found = pages.select("page_id", "requested_id", "html").mapInPandas(parse, CARD)
    if errors:
        return found.where(F.col("error").isNotNull()).select("page_id", "requested_id", "error")
    images = F.when(F.col("image").isNotNull(), F.array("image")).otherwise(F.array().cast("array<string>"))
    url = F.concat(F.lit(base_url.rstrip("/") + "/p/"), F.col("lot_id"))
    return found.where(F.col("error").isNull()).withColumn("images", images).withColumn("url", url).drop("image", "error")


# --- strategies -----------------------------------------------------------------------------------
def extract(pages: DataFrame, base_url: str) -> DataFrame:
    """Listings of each page by the first strategy that finds any: embedded JSON, then cards. Cards are
    looked for only in pages whose JSON gave nothing."""
    by_json = durable(embedded_listings(pages, base_url).withColumn("priority", F.lit(JSON_PRIORITY)).withColumn("strategy", F.lit("embedded-json")))
    rest = pages.join(by_json.select("page_id").distinct(), "page_id", "left_anti")
    by_card = page_cards(rest, base_url).withColumn("priority", F.lit(CARD_PRIORITY)).withColumn("strategy", F.lit("html-dom"))
    return by_json.unionByName(by_card, allowMissingColumns=True)


def detail(pages: DataFrame, base_url: str) -> DataFrame:
    """One listing per requested detail page: the record with the asked id, else the first one."""
    rows = extract(pages.where(F.col("requested_id").isNotNull()), base_url)
    order = [(F.col("lot_id") == F.col("requested_id")).desc(), F.col("blob"), F.col("shape"), F.col("node"), F.col("pos")]
    return top_per_group(rows, ["page_id"], order, 1)


CRITICAL = ["lot_id", "title", "retail_price", "current_bid", "close_at", "condition_name", "category", "brand", "buyers_premium_rate", "description"]


def coverage(rows: DataFrame) -> DataFrame:
    """Per strategy: rows found and, for its best row, which critical fields resolve."""
    def filled(name: str):
        c = F.col(name)
        return c.isNotNull() & (c.cast("string") != "") & (F.coalesce(c.try_cast("double"), F.lit(1.0)) != 0.0 if name in ("retail_price", "current_bid", "buyers_premium_rate") else F.lit(True))

    resolved = F.array_compact(F.array(*[F.when(filled(c), F.lit(c)) for c in CRITICAL]))
    missing = F.array_compact(F.array(*[F.when(~filled(c) | F.col(c).isNull(), F.lit(c)) for c in CRITICAL]))
    best = F.struct("lot_id", resolved.alias("resolved"), missing.alias("missing"))
    tagged = rows.withColumn("_best", best)
    return tagged.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("lots_found"),
        F.max_by("_best", F.struct(F.size("_best.resolved").alias("n"), F.col("lot_id"))).alias("b"),
    ).select("strategy", "lots_found", F.col("b.lot_id").alias("sample_id"), F.col("b.resolved").alias("resolved"), F.col("b.missing").alias("missing"))
