"""A plain replay of a change feed, one record at a time, as the yardstick for the relational operators."""

import json
import random
from datetime import datetime, timedelta, timezone

COLUMNS = "seq long, id string, entity_id string, entity_type string, kind string, payload string, at string, at_utc string, recorded_at string, recorded_by string, evidence string, schema_version int, target_event_id string, at_precision string"
START = datetime(2025, 1, 1, tzinfo=timezone.utc)


def iso(moment, hours=9):
    return moment.astimezone(timezone(timedelta(hours=hours))).isoformat()


def row(seq, id, entity, kind, payload, at, recorded, target=None, precision="time"):
    return (seq, id, entity, "application", kind, payload if isinstance(payload, str) or payload is None else json.dumps(payload), iso(at), None, iso(recorded, 0), "a", None, 1, target, precision)


def random_feed(seed, entities=12, per=9):
    """Histories with late, undated, corrected, voided and repeated changes; the first entity is longer than all others."""
    rng = random.Random(seed)
    made = []
    for e in range(entities):
        name, ids = f"e{e}", []
        for k in range(per * (12 if e == 0 else 1)):
            at = START + timedelta(hours=rng.randint(0, 2000))
            recorded = at + timedelta(hours=rng.choice([0, 0, 1, 30, 300]), seconds=rng.randint(0, 5))
            kind = "created" if k == 0 else rng.choice(["updated", "updated", "status_changed", "status_changed", "migrated", "corrected", "retracted"])
            precision = rng.choice(["time", "time", "time", "date", "unknown"])
            if precision == "unknown":
                at = recorded
            target = None
            if kind == "created":
                payload = {"status": "applied", "expected_rate": rng.choice([5, "half", None])}
            elif kind in ("updated", "migrated"):
                payload = {rng.choice(["expected_rate", "memo"]): rng.choice([1, 2.5, "x", None, True])}
            elif kind == "status_changed":
                payload = {"to": rng.choice(["viewed", "passed", "rejected"])}
            elif kind == "corrected" and len(ids) > 1:
                target = rng.choice(ids[1:] + ["nowhere"])
                payload = {"target": target, "payload": {"to": "viewed"} if made and any(m[1] == target and m[3] == "status_changed" for m in made) else {"expected_rate": rng.randint(1, 9)}}
            elif kind == "retracted" and len(ids) > 1 and rng.random() < 0.9:
                target = rng.choice(ids[1:] + ["e0-3"])
                payload = {"target": target}
            elif kind == "retracted" and e % 3 == 2:
                payload = {}
            else:
                continue
            ids.append(f"{name}-{k}")
            made.append((recorded, ids[-1], name, kind, payload, at, target, precision))
    made.sort(key=lambda m: m[0])
    rows = []
    for recorded, id, name, kind, payload, at, target, precision in made:
        rows.append(row(len(rows) + 1, id, name, kind, payload, at, recorded, target, precision))
        if rng.random() < 0.15:  # delivered again, later
            rows.append(row(len(rows) + 1, id, name, kind, payload, at, recorded, target, precision))
        if rng.random() < 0.05:
            rows.append(rows[-1])  # stands twice
    rng.shuffle(rows)
    return rows


def events_of(rows):
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    first = {}
    for r in sorted(rows, key=lambda r: r[0]):
        first.setdefault(r[1], dict(zip(names, r)))
    out = list(first.values())
    for e in out:
        e["t"], e["rec"], e["body"] = datetime.fromisoformat(e["at"]), datetime.fromisoformat(e["recorded_at"]), json.loads(e["payload"])
    return out


def replayed(events):
    """(doc, last event id, statuses) of one record's first recordings in order of seq; doc is None without a created event."""
    void = {e["target_event_id"] for e in events if e["kind"] == "retracted" and e["target_event_id"]}
    fixed, latest, place = {}, None, {}
    for e in events:
        if e["kind"] == "corrected" and e["id"] not in void:
            fixed[e["target_event_id"]] = e["body"]["payload"]
        if e["at_precision"] == "unknown":
            place[e["id"]] = latest or datetime.min.replace(tzinfo=timezone.utc)
        else:
            place[e["id"]] = e["t"]
            latest = max(latest or e["t"], e["t"])
    data = sorted((e for e in events if e["kind"] not in ("corrected", "retracted") and e["id"] not in void), key=lambda e: (e["kind"] != "created", place[e["id"]], e["seq"]))
    if not data or data[0]["kind"] != "created":
        return None, None, []
    doc, had = {}, []
    for e in data:
        body = fixed.get(e["id"], e["body"])
        for k, v in ({"status": body.get("to")} if e["kind"] == "status_changed" else body).items():
            doc[k] = v
            if k == "status" and v is not None and v not in had:
                had.append(v)
    return doc, data[-1]["id"], had


def text(v):
    return "" if v is None else json.dumps(v) if isinstance(v, bool) else str(v)
