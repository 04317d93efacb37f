"""Attributes as known at event time.

The state of a record at an instant T is the replay of its changes that both happened and were recorded strictly
before T. Each change becomes versions (a payload that holds over an interval of known-time); events and versions
are co-grouped by record, and the version that applies is found by vectorised binary search.

Versions without an end (nearly all) go through a segmented running maximum of replay order and one
``searchsorted``; versions with an end (later voided or corrected) are laid over the stretch of events they cover in a
tree of maxima, all versions of a group at once. Whether a value was ever held asks only for the furthest end among the
versions begun by then: a running maximum and one ``searchsorted``.

Long records are cut into slices of time. A slice holds the versions that begin or end in it, plus one carried row
per field (of the field whose values are gathered, one per value) for everything that holds throughout it, so no group
grows with a record's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordweave.operators.feed import DATA_KINDS, JSON_MAP, first_recordings, readable, undated_places, voids_and_corrections
from recordweave.runtime import materialise, ship

#: A record with more versions than this is cut into slices of about half as many.
LONG_RECORD = 20_000
#: Versions and events per co-group, on average.
GROUP_ROWS = 60_000
END = 2**62

VERSION = "entity_id string, field string, value string, rank_a int, rank_b long, rank_c long, from_us long, to_us long"


def versions(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """The versions of ``fields`` (and of the pseudo-field ``+``: the created event) of readable feed rows.

    (rank_a, rank_b, rank_c) is the place in replay order; the version holds for T with from_us < T <= to_us.
    Undated events take the place of the latest known time recorded before them; as a change is recorded after
    it happened, all of those are known once the undated event is.
    """
    ship(rows.sparkSession)
    voids, corrections = voids_and_corrections(rows)
    known = F.greatest("at_us", F.coalesce("rec_us", "at_us"))
    fixes = corrections.groupBy("entity_id", "target").agg(F.sort_array(F.collect_list(F.struct("seq", "known_us", F.coalesce("void_us", F.lit(END)).alias("void_us"), "payload"))).alias("fixes"))
    nothing = F.lit(None).cast("array<struct<seq:bigint,known_us:bigint,void_us:bigint,payload:string>>")
    no = F.lit(None).cast("long")
    notes = (
        fixes.select(F.col("target").alias("id"), "entity_id", "fixes", no.alias("void_us"), no.alias("place"))
        .unionByName(voids.select(F.col("target").alias("id"), "entity_id", nothing.alias("fixes"), F.col("known_us").alias("void_us"), no.alias("place")))
        .unionByName(undated_places(rows).select("id", "entity_id", nothing.alias("fixes"), no.alias("void_us"), F.col("place_us").alias("place")))
        .groupBy("id", "entity_id").agg(F.first("fixes", True).alias("fixes"), F.min("void_us").alias("void_us"), F.max("place").alias("place"))
    )
    data = first_recordings(rows.where(F.col("kind").isin(*DATA_KINDS)), "kind", "payload", "at_us", "rec_us")
    slots = data.join(notes, ["id", "entity_id"], "left").select(
        "entity_id", "kind", "payload", (F.col("kind") != "created").cast("int").alias("rank_a"), F.coalesce("place", "at_us").alias("rank_b"), F.col("seq").alias("rank_c"),
        known.alias("from_us"), F.coalesce("void_us", F.lit(END)).alias("to_us"), "fixes",
    )
    plain = slots.where("fixes is null").drop("fixes")
    pieces = slots.where("fixes is not null").mapInPandas(_pieces, plain.schema)
    held = plain.unionByName(pieces).where("from_us < to_us")
    parsed = F.from_json("payload", JSON_MAP)
    parsed = F.when(F.col("kind") == "status_changed", F.create_map(F.lit("status"), parsed["to"])).otherwise(parsed)
    wanted = F.map_filter(F.coalesce(parsed, F.create_map().cast(JSON_MAP)), lambda k, v: k.isin(*fields))
    marked = F.when(F.col("rank_a") == 0, F.map_concat(wanted, F.create_map(F.lit("+"), F.lit("")))).otherwise(wanted)
    return held.select("entity_id", F.explode(marked).alias("field", "value"), "rank_a", "rank_b", "rank_c", "from_us", "to_us")


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cuts each corrected event into the stretches over which one payload holds: at any time the known,
    non-voided correction of highest seq, else the event's own payload."""
    for pdf in batches:
        out = []
        for row in pdf.to_dict("records"):
            fixes = [f.asDict() if hasattr(f, "asDict") else dict(f) for f in row.pop("fixes")]
            cuts = sorted({row["from_us"], row["to_us"], *(c for f in fixes for c in (f["known_us"], f["void_us"]) if row["from_us"] < c < row["to_us"])})
            for a, b in zip(cuts, cuts[1:]):
                live = [f for f in fixes if f["known_us"] <= a and f["void_us"] >= b]
                payload = max(live, key=lambda f: f["seq"])["payload"] if live else row["payload"]
                out.append(row | {"payload": payload, "from_us": a, "to_us": b})
        yield pd.DataFrame(out, columns=[c for c in pdf.columns if c != "fixes"])


def sliced(held: DataFrame, asked: DataFrame, reached: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Adds ``slice`` to versions and events, and the carried rows that stand for what holds all through a slice."""
    sizes = held.groupBy("entity_id").agg(F.count("*").alias("n"), F.min("from_us").alias("low"), F.max("from_us").alias("high"))
    long = sizes.where(F.col("n") > LONG_RECORD).select("entity_id", "low", ((F.col("high") - F.col("low")) / F.ceil(F.col("n") / (LONG_RECORD / 2)) + 1).cast("long").alias("width"))
    n_long = long.count()
    if not n_long:
        zero = F.lit(0).cast("long")
        return held.withColumn("slice", zero), asked.withColumn("slice", zero)
    long = F.broadcast(long) if n_long <= 100_000 else long  # 100,000 rows of about 60 bytes
    at = lambda c: F.coalesce(F.greatest(F.lit(0), F.expr(f"({c} - low) div width")), F.lit(0)).cast("long")
    cut = held.join(long, "entity_id", "left")
    # an event at the very start of a slice belongs to it, and sees what held before
    begins = cut.withColumn("slice", at("from_us")).withColumn("last", F.when(F.col("to_us") < END, at("to_us")))
    own = begins.drop("low", "width", "last")
    ends = begins.where("last > slice").withColumn("slice", F.col("last")).drop("low", "width", "last")
    through = begins.where("width is not null")
    best = F.max_by(F.struct("value", "rank_a", "rank_b", "rank_c", "from_us"), F.struct("rank_a", "rank_b", "rank_c"))
    # the field that is gathered needs every value, so its values are carried one by one; of any other the newest stands
    through = through.withColumn("own", F.when(F.col("field") == F.lit(reached), F.col("value")))
    key = ["entity_id", "field", "own"]
    closed = through.where("last > slice + 1").withColumn("slice", F.explode(F.sequence(F.col("slice") + 1, F.col("last") - 1))).groupBy(*key, "value", "slice").agg(best.alias("b"))
    opened = through.where("last is null").groupBy(*key, "slice").agg(best.alias("b"))
    spans = through.groupBy("entity_id").agg(F.max(at("from_us")).alias("top"))
    top = spans.select("entity_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("top") + 1)).alias("slice"))
    heads = opened.groupBy(*key).agg(F.min("slice").alias("first"))
    grid = heads.join(top, "entity_id").where("slice > first").select(*key, "slice", F.lit(None).cast(opened.schema["b"].dataType).alias("b"))
    before = W.partitionBy(*key).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    both = opened.unionByName(grid).groupBy(*key, "slice").agg(F.first("b", True).alias("b"))
    order = F.when(F.col("b").isNotNull(), F.struct("b.rank_a", "b.rank_b", "b.rank_c"))
    carried = both.select(*key, "slice", F.max_by("b", order).over(before).alias("b")).where("b is not null")
    rows = [own, ends] + [
        df.select("entity_id", "field", "b.value", "b.rank_a", "b.rank_b", "b.rank_c", F.col("b.from_us").alias("from_us"), F.lit(END).cast("long").alias("to_us"), "slice") for df in (closed, carried)
    ]
    whole = rows[0]
    for r in rows[1:]:
        whole = whole.unionByName(r)
    top_of = F.broadcast(spans) if n_long <= 100_000 else spans
    slots = asked.join(long, "entity_id", "left").join(top_of, "entity_id", "left")
    slots = slots.withColumn("slice", F.least(at("at_us"), F.coalesce(F.col("top") + 1, F.lit(0)))).drop("low", "width", "top")
    return whole, slots


def as_known(asked: DataFrame, held: DataFrame, fields: tuple[str, ...], reached: str | None = None) -> DataFrame:
    """Per row of ``asked`` (event_id, entity_id, at_us): event_id, ``known`` (a created event was known), each field's
    value ("" where absent) and, for the field named by ``reached``, all values it has had, sorted and joined by ",".

    Repeated events, equal ranks and records without versions are handled; everything is "" if nothing was known.
    """
    ship(asked.sparkSession)
    held, asked = sliced(held, asked, reached)
    total = held.count()
    groups = max(1, -(-total // GROUP_ROWS))
    key = lambda df: df.withColumn("g", F.pmod(F.xxhash64("entity_id", "slice"), F.lit(groups)))
    schema = "event_id string, known boolean, reached string, " + ", ".join(f"`{f}` string" for f in fields)

    def search(events: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
        return _search(events, changes, fields, reached)

    return key(asked).groupBy("g").cogroup(key(held).groupBy("g")).applyInPandas(search, schema)


def _search(events: pd.DataFrame, changes: pd.DataFrame, fields: tuple[str, ...], reached: str | None) -> pd.DataFrame:
    n = len(events)
    out = pd.DataFrame({"event_id": events["event_id"].to_numpy(), "known": np.zeros(n, bool), "reached": np.full(n, "", object)} | {f: np.full(n, "", object) for f in fields})
    if not n or not len(changes):
        return out
    both = pd.MultiIndex.from_frame(pd.concat([changes[["entity_id", "slice"]], events[["entity_id", "slice"]]]))
    code = pd.factorize(both)[0]
    of_change, of_event = code[: len(changes)], code[len(changes) :]
    order = np.lexsort((changes["rank_c"], changes["rank_b"], changes["rank_a"]))
    rank = np.empty(len(changes), np.int64)
    rank[order] = np.arange(len(changes))
    start, end, asked = changes["from_us"].to_numpy(np.int64), changes["to_us"].to_numpy(np.int64), events["at_us"].to_numpy(np.int64)
    values, names = changes["value"].to_numpy(object), changes["field"].to_numpy(object)
    closed = np.zeros(code.max() + 1, bool)
    closed[of_change[end < END]] = True

    for f in ("+", *fields):
        mine = np.flatnonzero(names == f)
        best = np.full(n, -1, np.int64)
        open_ = mine[~closed[of_change[mine]]]
        if len(open_):
            best = _latest(of_change[open_], start[open_], rank[open_], of_event, asked)
        ended = mine[closed[of_change[mine]]]
        if len(ended):
            painted = _covering(of_change[ended], start[ended], end[ended], rank[ended], of_event, asked)
            best = np.maximum(best, painted)
        hit = best >= 0
        if f == "+":
            out["known"] = hit
        else:
            got = values[order[best[hit]]]
            col = out[f].to_numpy(object).copy()
            col[hit] = ["" if v is None or v is pd.NA or v != v else v for v in got]
            out[f] = col
    if reached is not None:
        out["reached"] = _reached(names == reached, values, of_change, start, end, of_event, asked, n)
    known = out["known"].to_numpy()
    for c in ("reached", *fields):
        col = out[c].to_numpy(object).copy()
        col[~known] = ""
        out[c] = col
    return out


def _latest(code: np.ndarray, start: np.ndarray, rank: np.ndarray, ecode: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The highest rank among versions of the event's record that began strictly before it, else -1."""
    ticks, order = np.unique(np.concatenate([start, asked])), np.unique(rank)
    width = len(ticks) + 1
    at = code * width + np.searchsorted(ticks, start)
    by = np.argsort(at, kind="stable")
    top = np.maximum.accumulate(code[by] * len(order) + np.searchsorted(order, rank[by]))
    place = np.searchsorted(at[by], ecode * width + np.searchsorted(ticks, asked), side="left") - 1
    found = (place >= 0) & (code[by][np.maximum(place, 0)] == ecode)
    return np.where(found, order[top[np.maximum(place, 0)] % len(order)], -1)


def _covering(code: np.ndarray, start: np.ndarray, end: np.ndarray, rank: np.ndarray, ecode: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """As _latest for versions with ends. Events in order are the leaves of a tree; a version marks the few nodes that make
    up the stretch of events it covers, and an event takes the highest rank on its way to the root."""
    by = np.lexsort((asked, ecode))
    ticks = np.unique(np.concatenate([start, end, asked]))
    width = len(ticks) + 1
    at = ecode[by].astype(np.int64) * width + np.searchsorted(ticks, asked[by])
    size = len(at)
    low = np.searchsorted(at, code * width + np.searchsorted(ticks, start), side="right") + size
    high = np.searchsorted(at, code * width + np.searchsorted(ticks, end), side="right") + size
    tree = np.full(2 * size, -1, np.int64)
    while (open_ := low < high).any():
        odd = open_ & (low & 1 == 1)
        np.maximum.at(tree, low[odd], rank[odd])
        low = low + odd
        odd = open_ & (high & 1 == 1) & (low < high)
        high = high - odd
        np.maximum.at(tree, high[odd], rank[odd])
        low, high = low >> 1, high >> 1
    node, top = np.arange(size) + size, np.full(size, -1, np.int64)
    while node.any():
        top = np.maximum(top, tree[node])
        node = node >> 1
    best = np.empty(size, np.int64)
    best[by] = top
    return best


def _reached(mine: np.ndarray, values: np.ndarray, code: np.ndarray, start: np.ndarray, end: np.ndarray, ecode: np.ndarray, asked: np.ndarray, n: int) -> np.ndarray:
    """Per event the values of which some version begun before it had not ended by it, sorted and joined."""
    idx = np.flatnonzero(mine & np.array([isinstance(v, str) for v in values], bool))
    kinds, kind = np.unique(values[idx].astype(str), return_inverse=True) if len(idx) else (np.zeros(0, str), np.zeros(0, int))
    sets = np.full(n, "", object)
    for k, value in enumerate(kinds):
        own = idx[kind == k]
        ends = _latest(code[own], start[own], end[own], ecode, asked)
        had = ends >= asked
        sets[had] = [f"{s},{value}" if s else str(value) for s in sets[had]]
    return sets


def p5_found(events: DataFrame) -> DataFrame:
    """event_id, status, expected_rate, reached as known at each outcome (passed or rejected) of an application."""
    rows = readable(events)
    outcome = F.from_json("payload", JSON_MAP)["to"].isin("passed", "rejected")
    asked = first_recordings(rows.where("kind = 'status_changed' and at_precision = 'time'").where(outcome), "at_us").select(F.col("id").alias("event_id"), "entity_id", "at_us")
    asked = materialise(asked, "asked")
    of_interest = materialise(rows.join(asked.select("entity_id").distinct(), "entity_id", "left_semi"), "of-interest")  # read by every step below
    fields = ("status", "expected_rate")
    held = materialise(versions(of_interest, fields), "versions")
    return as_known(asked, held, fields, "status").select("event_id", "status", "expected_rate", "reached")
