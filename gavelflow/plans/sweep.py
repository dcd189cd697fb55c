"""Batch jobs over landed observations: watch sweep, refresh and harvest, daily digest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelflow.operators import lots as ol
from gavelflow.operators import reports, risk, watch
from gavelflow.params import Params
from gavelflow.plans import valuation


@dataclass
class Sweep:
    lots: DataFrame
    snapshots: DataFrame
    links: DataFrame
    valuations: DataFrame
    queue: DataFrame
    report: DataFrame


@dataclass
class Harvest:
    due: DataFrame
    lots: DataFrame
    snapshots: DataFrame
    comps: DataFrame


def snapshots_from(observations: DataFrame) -> DataFrame:
    """Bid history rows worth keeping: the bid and count the lot showed, changes only."""
    return ol.change_only(ol.ratcheted(observations))


def sweep_watches(
    observations: DataFrame, known_lots: DataFrame, watches: DataFrame, links: DataFrame, queue: DataFrame,
    comps: DataFrame, prices: DataFrame, commitments: DataFrame, as_of: Column, params: Params = Params(),
) -> Sweep:
    """Fold new observations, match saved searches, value the matches, refresh the queue, report."""
    state = ol.fold_observations(observations, known_lots)
    batch = state.join(observations.select("lot_id").distinct(), "lot_id", "left_semi")
    active = watches.where(F.col("enabled"))
    matched = watch.match_watches(batch, active, as_of, params=params)
    new_links = matched.join(links.select("watch_id", "lot_id"), ["watch_id", "lot_id"], "left_anti")
    asked = batch.join(matched.select("lot_id").distinct(), "lot_id", "left_semi")
    runs = valuation.value_lots(asked, comps, prices, commitments, as_of, params, all_lots=state, runs=matched)
    new_queue = watch.upsert_queue(queue, watch.last_run(runs), as_of)
    report = watch.sweep_report(runs, active, batch, queue)
    return Sweep(state, snapshots_from(observations), new_links.select("watch_id", "lot_id"), runs, new_queue, report)


def refresh_and_harvest(
    lots: DataFrame, observations: DataFrame, comps: DataFrame, as_of: Column, params: Params = Params(), limit: int | None = None,
) -> Harvest:
    """Lots due for another read; state after the reads that came in; comps from every new close."""
    due = ol.due_for_refresh(lots, as_of, params, limit)
    state = ol.fold_observations(observations, lots)
    expired = ol.sweep_expired(state, as_of, params)
    current = state.join(expired.select("lot_id"), "lot_id", "left_anti").unionByName(expired)
    confirmed = ol.closed_to_comps(state, comps)
    inferred = ol.closed_to_comps(expired, comps.select("source", "query_key", "url").unionByName(
        confirmed.select("source", "query_key", "url")), inferred=True)
    return Harvest(due, current, snapshots_from(observations), confirmed.unionByName(inferred))


def daily_digest(
    valuations: DataFrame, lots: DataFrame, comps: DataFrame, prices: DataFrame, commitments: DataFrame,
    ledger: DataFrame, as_of: Column, params: Params = Params(), newest: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(rows to announce with their text, one-row summary) of the last day's recommendations."""
    picks = reports.digest_picks(valuations, as_of, newest)
    live = lots.where(~F.col("is_closed")).join(picks.select("lot_id"), "lot_id", "left_semi")
    valued = valuation.value_lots(live, comps, prices, commitments, as_of, params, all_lots=lots)
    deals = reports.alert_bodies(reports.deal_alerts(valued, ledger, params))
    summary = reports.digest_summary(deals, risk.exposure_totals(commitments, params))
    return deals.orderBy(F.desc("projected_profit"), "lot_id"), summary
