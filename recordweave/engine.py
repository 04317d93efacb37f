"""One door to a record book in a folder: asking, writing, loading series, taking text in, and looking up.

An ``Engine`` reads the newest committed state for every call and writes by commits (see ``sources.store``). Answers and
tables are DataFrames; what is put into words is bounded.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from dataclasses import dataclass, field
from typing import Any
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordweave.functions.names import candidates, identify
from recordweave.functions.times import instant_us
from recordweave.operators import ingest, profile, querylog, recording, series, text
from recordweave.operators.changefeed import apply_changes  # noqa: F401 - part of the engine's surface
from recordweave.plans import answering, dictionary, proposals, selection
from recordweave.plans.planner import AskBack, Answer, Book, Planner
from recordweave.plans.question import PlanCache, Words, interpreted, slots
from recordweave.plans.spec import QuerySpec, SpecError, TypeDef, parse
from recordweave.runtime import materialise
from recordweave.sources.store import Commit, Store
from recordweave.sources.tables import read_schema_files, read_text_folder
from recordweave.sources.views import write_views

FEED = "id string, entity_id string, entity_type string, kind string, payload string, at string, recorded_at string, recorded_by string, evidence string, target_event_id string, at_precision string"
ENTITIES = "id string, type string, doc string, retracted boolean, created_at string, updated_at string, last_event_seq long, reached array<string>"
BATCHES = "id string, type string, at string, recorded_by string, source string, inserted long, updated long, unchanged long, reverted_at string"
_SPARK = {"integer": "bigint", "number": "double", "boolean": "boolean", "array": "array<string>"}


@dataclass
class Reply:
    """What came of a request: ``status`` (answered, recorded, clarify, rejected, unsupported), a message, and what belongs to it."""

    status: str
    message: str = ""
    text: str = ""
    spec: QuerySpec | None = None
    answer: Answer | None = None
    seen: answering.Shown | None = None
    options: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    questions: list[str] = field(default_factory=list)
    id: str | None = None


def found_data(spec: QuerySpec) -> dict[str, Any]:
    """A specification as plain data, without what is unset."""
    plain = json.loads(json.dumps(spec.__dict__, default=lambda o: o.__dict__))

    def kept(x: Any) -> Any:
        if isinstance(x, dict):
            return {k: kept(v) for k, v in x.items() if v not in (None, [], {})}
        return [kept(v) for v in x] if isinstance(x, list) else x

    return kept(plain)


class Engine:
    """A record book under ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, zone: str = "Asia/Seoul", now: dt.datetime | None = None, words: Words | None = None, adapter: Any = None) -> None:
        self.spark, self.store, self.zone, self._now = spark, Store(spark, folder), zone, now
        self.words, self.adapter, self.cache = words or Words(), adapter or (lambda question, types, errors: None), PlanCache()
        self.registry = dictionary.Registry()
        for r in self._rows("schemas", "name string, version int, definition string, created_at string").select("name", "version", "definition").distinct().orderBy("name", "version").collect():  # a dictionary
            self.registry.register(dictionary.read_type(json.loads(r.definition)), may_skip=True)

    # time and tables

    @property
    def now(self) -> dt.datetime:
        return self._now or dt.datetime.now(dt.timezone.utc)

    def stamp(self) -> str:
        return self.now.astimezone(ZoneInfo(self.zone)).isoformat()

    def _rows(self, name: str, schema: str) -> DataFrame:
        found = self.store.table(name)
        return self.spark.createDataFrame([], schema) if found is None else found

    @property
    def events(self) -> DataFrame:
        return self._rows("events", f"{FEED}, seq long, schema_version int")

    @property
    def entities(self) -> DataFrame:
        return self._rows("entities", ENTITIES)

    @property
    def types(self) -> dict[str, TypeDef]:
        return self.registry.types

    # dictionary

    def register(self, definition: dict[str, Any] | TypeDef, may_skip: bool = False) -> bool:
        """Registers a version of a type; False if it is registered already."""
        t = definition if isinstance(definition, TypeDef) else dictionary.read_type(definition)
        if not self.registry.register(t, may_skip):
            return False
        row = self.spark.createDataFrame([(t.name, t.version, json.dumps(dictionary.written_type(t), ensure_ascii=False), self.stamp())], "name string, version int, definition string, created_at string")
        self.store.commit(Commit(appended={"schemas": row}), self.store.state())
        return True

    def register_folder(self, folder: str) -> list[str]:
        """Registers every definition of a folder of JSON files; the names of what was new."""
        return [d["name"] for d in read_schema_files(folder) if self.register(d, may_skip=True)]

    def list_schemas(self) -> str:
        return selection.described(list(self.types.values()), self.observed())

    def observed(self) -> dict[tuple[str, str], list[str]]:
        """Values of plain text fields that have few: (type, field) -> values, commonest first."""
        found: dict[tuple[str, str], list[str]] = {}
        for t in self.types.values():
            plain = [f for f, d in t.fields.items() if d.type == "string" and not d.enum and not d.ref and not d.format]
            if t.kind == "entity" and plain:
                for r in profile.all_observed_values(self.typed(t).select(*plain)).orderBy(F.desc("n"), "value").collect():  # at most MAX_OBSERVED a field
                    found.setdefault((t.name, r.field), []).append(r.value)
        return found

    def propose_schema(self) -> list[proposals.Proposal]:
        """Proposals for everything stored that is not registered."""
        drafts = profile.draft_fields(self.entities, self.events, self.types)
        kinds = self._draft_kinds()
        rows = [r.asDict() | {"type": kinds.get((r.entity_type, r.field), "string")} for r in drafts.collect()]  # one row per unregistered field
        return proposals.proposed(self.types, rows, [r.asDict() for r in profile.stray_values(self.entities, self.types).limit(1_000).collect()])

    def _draft_kinds(self) -> dict[tuple[str, str], str]:
        rows = self.entities.where("not retracted").select(F.col("type").alias("entity_type"), F.explode(F.from_json("doc", "map<string,string>")).alias("field", "value")).where("value is not null")
        return {(r.entity_type, r.field): r.type for r in profile.inferred_fields(rows, ["entity_type", "field"], "value").collect()}

    def apply_schema_proposal(self, proposal_id: str, approved_by: str) -> Reply:
        p = next((p for p in self.propose_schema() if p.id == proposal_id), None)
        if p is None:
            return Reply("rejected", f"there is no proposal {proposal_id}")
        try:
            t = proposals.applied(p, self.types[p.entity_type], approved_by)
        except ValueError as e:
            return Reply("rejected", str(e))
        if t != self.types[p.entity_type]:
            self.register(t)
        if p.action == "merge_fields":
            return self.write(proposals.moves(p, self.entities, self.stamp(), approved_by))
        return Reply("recorded", f"{t.name} is at version {t.version}")

    def add_value_group(self, kind: str, field_name: str, phrase: str, values: list[str]) -> Reply:
        try:
            t = dictionary.with_group(self.types[kind], field_name, phrase, values)
        except (KeyError, ValueError) as e:
            return Reply("rejected", str(e))
        self.register(t)
        return Reply("recorded", f"{phrase!r} means any of {', '.join(t.fields[field_name].groups[phrase.strip().lower()])}")

    # writing

    def write(self, changes: DataFrame | list[dict[str, Any]]) -> Reply:
        """Appends changes to the feed and brings the records they touch up to date, in one commit. Changes that break a rule or
        their record are refused and named in ``errors``; the others are written."""
        state = self.store.state()
        if isinstance(changes, list):
            names = [c.split(" ")[0] for c in FEED.split(", ")]
            changes = self.spark.createDataFrame([tuple(json.dumps(v, ensure_ascii=False) if isinstance(v, dict) else v for v in (c.get(n) for n in names)) for c in changes], FEED)
        changes = materialise(changes.select(*[c.split(" ")[0] for c in FEED.split(", ")]), "changes")  # judged in several steps
        history = self._of(state, "events", f"{FEED}, seq long, schema_version int")
        marked = recording.reviewed(history, changes).persist()
        try:
            errors = [f"{r.id}: {r.problem}" for r in marked.where("problem not in ('', 'repeated')").select("id", "problem").orderBy("id").limit(100).collect()]
            good = marked.where("problem = ''").drop("problem")
            start = (history.agg(F.max("seq")).first()[0] or 0) + 1
            versions = F.lit(None).cast("int")
            for t in self.types.values():
                versions = F.when(F.col("entity_type") == t.name, t.version).otherwise(versions)
            born = self._of(state, "entities", ENTITIES).select(F.col("id").alias("entity_id"), F.col("type").alias("_type"))
            typed = good.join(born, "entity_id", "left").withColumn("entity_type", F.coalesce("entity_type", "_type")).drop("_type").withColumn("_order", F.struct("recorded_at", F.when(F.col("kind") == "created", 0).otherwise(1), "at", "id"))
            rows = recording.numbered(typed, "_order", start).drop("_order").withColumn("schema_version", versions)
            records, refused = recording.replayed(history, rows, self.types)
            refused = refused.select("id", "entity_id", "problem").persist()
            errors += [f"{r.id}: {r.problem}" for r in refused.orderBy("id").limit(100).collect()]
            accepted = rows.join(refused.select("id"), "id", "left_anti")
            if accepted.isEmpty():
                return Reply("rejected" if errors else "recorded", "nothing was stored", errors=errors)
            self.store.commit(Commit(appended={"events": accepted}, put={"entities": (["id"], records)}), state)
            return Reply("recorded", errors=errors)
        finally:
            marked.unpersist()

    def _of(self, state: Any, name: str, schema: str) -> DataFrame:
        found = self.store.table(name, state)
        return self.spark.createDataFrame([], schema) if found is None else found

    def record(self, request: dict[str, Any], by: str, evidence: str | None = None) -> Reply:
        """A structured request: entity_type, kind, payload, and entity_id or ``match`` (fields that name the record); at and
        at_precision are optional. Names in reference fields become ids where one record is certainly meant; anything
        uncertain is asked back, and nothing is stored then."""
        kind, of = request.get("kind", "created"), request.get("entity_type")
        t = self.types.get(of)
        if t is None:
            near = profile.similar_names(str(of), list(self.types))
            return Reply("clarify" if near else "rejected", f"there is no type {of!r}", options=near)
        payload, match = dict(request.get("payload") or {}), dict(request.get("match") or {})
        if unknown := [f for f in match if f not in t.fields]:
            return Reply("rejected", f"a record is not found by fields that are not registered: {', '.join(unknown)}")
        for values in (payload, match):
            for f, v in list(values.items()):
                d = t.fields.get(f)
                if d is None or not d.ref or not isinstance(v, str) or self.get_entity(v) is not None:
                    continue
                status, ids, near = self.resolve(d.ref, v)
                if status == "match":
                    values[f] = ids[0]
                else:
                    return Reply("clarify", f"{v!r} {'names several records' if status == 'ambiguous' else 'names no record'} of type {d.ref}", options=ids or near)
        if kind == "created":
            entity_id = request.get("entity_id") or f"{of}_{uuid.uuid4().hex[:10]}"
            if twin := self._twin(t, payload):
                return Reply("clarify", f"this may be {twin}, which is recorded", options=[twin], id=twin)
        else:
            entity_id = request.get("entity_id")
            if entity_id is None:
                if not match:
                    return Reply("rejected", "name the record by entity_id or match")
                found = [r.id for r in self.find(of, match).limit(11).collect()]
                if len(found) != 1:
                    return Reply("clarify", f"{len(found)} records match", options=found[:10])
                entity_id = found[0]
        change = {
            "id": f"evt_{uuid.uuid4().hex}", "entity_id": entity_id, "entity_type": of, "kind": kind, "payload": payload, "at": request.get("at") or self.stamp(), "recorded_at": self.stamp(), "recorded_by": by,
            "evidence": evidence, "target_event_id": payload.get("target") if kind in ("corrected", "retracted") else None, "at_precision": request.get("at_precision", "time"),
        }
        reply = self.write([change])
        reply.id = entity_id
        contradiction = [e for e in reply.errors if "status is" in e]
        if contradiction:
            return Reply("clarify", f"this contradicts the record: {contradiction[0]}", options=["leave out 'from'", "correct the earlier change"], id=entity_id)
        if reply.status == "recorded":
            strays = [f for f in payload if f not in t.fields and kind in ("created", "updated")]
            for f in strays:
                near = profile.similar_names(f, list(t.fields))
                reply.questions.append(f"{f} is not registered" + (f"; is it {near[0]}?" if near else ""))
            if kind in ("corrected", "retracted"):
                spans = self.events.where((F.col("entity_id") == entity_id) & F.col("evidence").startswith("ingest_")).select("evidence").limit(10).collect()
                others = sorted({r.entity_id for s in spans for r in self.events.where(F.col("evidence") == s.evidence).select("entity_id").limit(100).collect()} - {entity_id})
                if others:
                    reply.questions.append(f"{', '.join(others)} came from the same text; should they be {kind} too?")
        return reply

    def _twin(self, t: TypeDef, payload: dict[str, Any]) -> str | None:
        """The record of a type with names that a new document would repeat."""
        if "name" not in t.fields:
            return None
        marks = [f for f, d in t.fields.items() if d.identifier]
        for probe in [payload.get(f) for f in (*marks, "name")]:
            if probe:
                status, ids, _ = self.resolve(t.name, str(probe))
                if status == "match":
                    return ids[0]
        return None

    def resolve(self, kind: str, name: str) -> tuple[str, list[str], list[str]]:
        """(match, ambiguous or none; ids; candidates) of a name or identifier."""
        t = self.types[kind]
        known = self.typed(t)
        asked = self.spark.createDataFrame([(0, name)], "query_id int, query string")
        label = "name" if "name" in t.fields else None
        if label is None:
            plain = [f for f, d in t.fields.items() if d.indexed and d.type == "string" and not d.enum and not d.format]
            known = known.withColumn("labels", F.array_compact(F.array(*[F.col(f) for f in plain])) if plain else F.array().cast("array<string>"))
        marks = [f for f, d in t.fields.items() if d.identifier]
        hit = identify(asked, known, marks[0] if marks else None, label).first()
        ids = [i for i in hit.ids.split(",") if i]
        near = [r.id for r in candidates(asked, known, 5).orderBy(F.desc("score"), "id").collect()] if hit.status == "none" and label else []
        return hit.status, ids, near

    # looking up

    def typed(self, t: TypeDef, retracted: bool = False) -> DataFrame:
        """The records of a type with one typed column per field; ``extras`` has the whole document as variants."""
        rows = self.entities.where(F.col("type") == t.name)
        rows = rows if retracted else rows.where("not retracted")
        doc = rows.withColumn("extras", F.from_json("doc", "map<string,variant>"))
        cast = lambda f, d: F.expr(f"try_variant_get(extras['{f}'], '$', '{'date' if d.format == 'date' else _SPARK.get(d.type, 'string')}')").alias(f)
        return doc.select("id", "retracted", "created_at", "updated_at", "reached", *[cast(f, d) for f, d in t.fields.items()], "extras")

    def get_entity(self, entity_id: str) -> dict[str, Any] | None:
        r = self.entities.where(F.col("id") == entity_id).first()
        return None if r is None else r.asDict() | {"doc": json.loads(r.doc or "{}")}

    def get_event(self, event_id: str) -> dict[str, Any] | None:
        r = self.events.where(F.col("id") == event_id).orderBy("seq").first()
        return None if r is None else r.asDict()

    def get_batch(self, batch_id: str) -> dict[str, Any] | None:
        r = self._rows("batches", BATCHES).where(F.col("id") == batch_id).first()
        return None if r is None else r.asDict()

    def get_schema(self, name: str, version: int | None = None) -> TypeDef | None:
        known = self.registry.versions.get(name, {})
        return known.get(version) if version else self.registry.latest(name)

    def get_point(self, kind: str, key: dict[str, Any], time: str) -> dict[str, Any] | None:
        points = self._points(self.types[kind])
        for k, v in key.items():
            points = points.where(F.col(k).eqNullSafe(F.lit(v)))
        r = points.where(F.col(self.types[kind].time).cast("string") == time).first()
        return None if r is None else r.asDict()

    def find(self, kind: str, fields: dict[str, Any], include_retracted: bool = False) -> DataFrame:
        """The records of a type whose fields equal the given ones (None: absent), by id. An unknown field raises KeyError."""
        t = self.types[kind]
        if unknown := [f for f in fields if f not in t.fields]:
            raise KeyError(f"{kind} has no field {', '.join(unknown)}")
        rows = self.typed(t, include_retracted)
        for f, v in fields.items():
            rows = rows.where(F.col(f).cast("string").eqNullSafe(F.lit(v).cast("string")) if t.fields[f].type != "array" else F.col(f).eqNullSafe(F.lit(v)))
        return rows.orderBy("id")

    def count(self, kind: str, fields: dict[str, Any] | None = None) -> int:
        return self.find(kind, fields or {}).count()

    def history(self, entity_id: str) -> DataFrame:
        """The changes of a record in the order of recording."""
        return self.events.where(F.col("entity_id") == entity_id).orderBy("seq")

    def ids_with_events(self) -> DataFrame:
        """entity_id, first_seq of every record with changes, in the order of their first."""
        return self.events.groupBy("entity_id").agg(F.min("seq").alias("first_seq")).orderBy("first_seq")

    def sql(self, query: str, **args: Any) -> DataFrame:
        """A query (SELECT, WITH or EXPLAIN) over the tables events, entities and one per type; named arguments stand as :name."""
        if query.lstrip().split(None, 1)[0].upper() not in ("SELECT", "WITH", "EXPLAIN"):
            raise ValueError("only SELECT, WITH and EXPLAIN")
        for name, df in {"events": self.events, "entities": self.entities, **{t.name: self.typed(t) if t.kind == "entity" else self._points(t) for t in self.types.values()}}.items():
            df.createOrReplaceTempView(name)
        return self.spark.sql(query, args=args or None)

    def explain(self, spec: QuerySpec | dict[str, Any]) -> str:
        """The physical plan of a specification."""
        return Planner(self.book(), spec).answer().rows._jdf.queryExecution().toString()

    def catalogue(self) -> list[tuple[str, str, int]]:
        return self.store.catalogue()

    def rebuild(self) -> None:
        """Replays the whole feed into the projection."""
        state = self.store.state()
        history = self._of(state, "events", f"{FEED}, seq long, schema_version int")
        records, _ = recording.replayed(history.limit(0), history, {})
        self.store.commit(Commit(replaced={"entities": records}), state)

    # asking

    def book(self, drafts: bool = False) -> Book:
        """What can be asked; with ``drafts`` also fields and values that are stored but not registered yet."""
        types = dict(self.types)
        if drafts:
            stored = [r.asDict() for r in profile.draft_fields(self.entities, self.events, types).collect()]  # one row per unregistered field
            stray = [r.asDict() for r in profile.stray_values(self.entities, types).limit(1_000).collect()]
            types = {n: proposals.with_drafts(t, stored, stray) if t.kind == "entity" else t for n, t in types.items()}
        entity_types = [t for t in types.values() if t.kind == "entity"]
        events = self.events
        applied = F.lit(True)
        voids = events.where("kind = 'retracted' and target_event_id is not null").select(F.col("target_event_id").alias("id"), F.lit(True).alias("_void")).distinct()
        log = events.join(voids, "id", "left").select(
            "id", "seq", "entity_id", "entity_type", "kind", "payload", "at", "recorded_at", F.get_json_object("payload", "$.to").alias("to"), F.get_json_object("payload", "$.from").alias("from"), instant_us(F.col("at")).alias("at_us"),
            F.substring("at", 1, 10).try_cast("date").alias("local_day"), F.col("recorded_by").alias("by"), "evidence", "target_event_id", F.coalesce("at_precision", F.lit("time")).alias("at_precision"), (applied & F.col("_void").isNull()).alias("applied"),
        )
        return Book(
            types, {t.name: self.typed(t, True) for t in entity_types}, log, {t.name: self._points(t) for t in self.types.values() if t.kind == "series"}, self.now, self.zone,
            {t.name: "name" if "name" in t.fields else "title" for t in entity_types if "name" in t.fields or "title" in t.fields},
        )

    def query(self, question: str = "", spec: dict[str, Any] | QuerySpec | None = None, by: str | None = None, drafts: bool = False) -> Reply:
        """Answers a question, or a specification without reading the question; every call is logged."""
        began = dt.datetime.now()
        reply, path = self._asked(question, spec, drafts)
        took = (dt.datetime.now() - began).total_seconds() * 1000
        self._log(question, path, reply, by, took)
        return reply

    def _asked(self, question: str, spec: dict[str, Any] | QuerySpec | None, drafts: bool) -> tuple[Reply, str]:
        if spec is None and question.strip() and (found := self.get_entity(question.strip())):
            return Reply("answered", text=json.dumps(found["doc"], ensure_ascii=False), id=found["id"]), "entity"
        book, path = self.book(drafts), "structured"
        try:
            if spec is None:
                certain = lambda kind, phrase: kind in book.entities and self.resolve(kind, phrase)[0] == "match"
                path, found = interpreted(question, book.types, self.words, book.today, self.adapter, self.cache, certain)
                if found is None:
                    return Reply("unsupported", "this cannot be read as a question about the records"), path
                spec = found
            planner = Planner(book, parse(spec) if isinstance(spec, dict) else spec)
            answer = planner.answer()
        except AskBack as e:
            return Reply("clarify", str(e), options=list(map(str, e.options))), path
        except SpecError as e:
            return Reply("rejected", str(e), errors=e.problems), path
        seen = answering.shown(answer, planner.spec)
        if planner.spec.source == "entities":
            seen.labels = answering.reference_labels(book, planner.spec.entity_type, seen)
        if path == "interpreter" and seen.total:  # a plan that found nothing may be what is wrong
            pattern, values = slots(question, book.today)
            self.cache.put(PlanCache.key(pattern, book.types, type(self.adapter).__name__), found_data(planner.spec), values, seen.total)
        seen.notes = answering.notes(book, planner.spec, answer, seen, planner, self.store.table("coverage"))
        return Reply("answered", text=answering.text(planner.spec, seen, book.types.get(planner.spec.entity_type)), spec=planner.spec, answer=answer, seen=seen), path

    def _log(self, question: str, path: str, reply: Reply, by: str | None, ms: float) -> None:
        total = reply.seen.total if reply.seen else None
        plan = json.dumps(reply.spec.__dict__, default=lambda o: o.__dict__, sort_keys=True, ensure_ascii=False) if reply.spec else None
        row = (uuid.uuid4().hex, self.stamp(), by, question, " ".join(question.lower().split()) or None, path, reply.status, plan, total, reply.seen.notes if reply.seen else [], "; ".join(reply.errors) or None, ms, len(question) + len(plan or "") + len(reply.text))
        schema = "id string, asked_at string, caller string, question string, question_norm string, path string, status string, sql string, result_total long, warnings array<string>, error string, ms double, size long"
        self.store.commit(Commit(appended={"log": self.spark.createDataFrame([row], schema)}), self.store.state())

    def query_log(self, view: str = "recent", n: int = 20, since: str | None = None, path: str | None = None) -> DataFrame | None:
        log = self.store.table("log")
        if log is None:
            return None
        moved = querylog.readings(log).where("plans > 1").select("question_norm", F.lit(True).alias("diverging"))
        log = log.join(F.broadcast(moved.limit(10_000)), "question_norm", "left").withColumn("diverging", F.coalesce("diverging", F.lit(False)))
        log = log.where(instant_us(F.col("asked_at")) >= instant_us(F.lit(since))) if since else log
        return querylog.view(log.where(F.col("path") == path) if path else log, view, n)

    def purge_query_log(self, before: str | None = None) -> int:
        state = self.store.state()
        log = self.store.table("log", state)
        if log is None:
            return 0
        kept = querylog.purged(log, before)
        gone = log.count() - kept.count()
        self.store.commit(Commit(replaced={"log": kept}), state)
        return gone

    # views

    def write_views(self, folder: str) -> None:
        """The readable tables of the book, replaced as a whole (see ``sources.views``)."""
        write_views(self.book(), folder, self.events, self.stamp())

    # series

    def _points(self, t: TypeDef) -> DataFrame:
        found = self.store.table(f"series_{t.name}")
        if found is not None:
            return found
        kinds = ", ".join(f"`{f}` {'date' if d.format == 'date' else _SPARK.get(d.type, 'string')}" for f, d in t.fields.items())
        return self.spark.createDataFrame([], f"{kinds}, batch_id string")

    def record_series(self, kind: str, rows: DataFrame, by: str, source: str = "") -> Reply:
        """Loads points; a batch with a fault (a key or time missing, a point twice, no measure, a wrong value) is refused whole."""
        t = self.types[kind]
        keys = [*t.key, t.time]
        state, batch_id = self.store.state(), f"batch_{uuid.uuid4().hex[:12]}"
        current = self._points(t)
        cast = [F.col(f).cast(current.schema[f].dataType).alias(f) if f in rows.columns else F.lit(None).cast(current.schema[f].dataType).alias(f) for f in t.fields]
        lost = rows.where(" OR ".join(f"(`{f}` IS NOT NULL AND try_cast(`{f}` AS {current.schema[f].dataType.simpleString()}) IS NULL)" for f in t.fields if f in rows.columns))
        if stray := [c for c in rows.columns if c not in t.fields]:
            return Reply("rejected", f"{', '.join(stray)} are not registered")
        if not lost.isEmpty():
            return Reply("rejected", "a value does not fit its field")
        changes = series.classify(current, rows.select(*cast), keys).persist()
        try:
            counts = {r.action: r.n for r in changes.groupBy("action").agg(F.count("*").alias("n")).collect()}  # four actions
            if counts.get("rejected"):
                return Reply("rejected", f"{counts['rejected']} point(s) have no key, no time or no measure, or are given twice")
            new = changes.where("action in ('inserted', 'updated')")
            points = new.select(*keys, "after.*", F.lit(batch_id).alias("batch_id"))
            before = new.select(F.lit(batch_id).alias("id"), F.to_json(F.struct(*keys)).alias("point"), "action", F.to_json("before").alias("before"), "before_batch")
            batch = self.spark.createDataFrame([(batch_id, kind, self.stamp(), by, source, counts.get("inserted", 0), counts.get("updated", 0), counts.get("unchanged", 0), None)], BATCHES)
            self.store.commit(Commit(appended={"batch_changes": before}, put={f"series_{kind}": (keys, points), "batches": (["id"], batch)}), state)
        finally:
            changes.unpersist()
        return Reply("recorded", f"{counts.get('inserted', 0)} new, {counts.get('updated', 0)} changed, {counts.get('unchanged', 0)} unchanged", id=batch_id)

    def revert_series_batch(self, batch_id: str) -> Reply:
        """Restores the points before a batch; refused if a later batch has touched one of them."""
        state, batch = self.store.state(), self.get_batch(batch_id)
        if batch is None or batch["reverted_at"]:
            return Reply("rejected", f"there is no batch {batch_id} to revert")
        t = self.types[batch["type"]]
        keys = [*t.key, t.time]
        current = self._points(t)
        said = self.store.table("batch_changes", state).where(F.col("id") == batch_id)
        types = lambda cs: ", ".join(f"`{c}` {current.schema[c].dataType.simpleString()}" for c in cs)
        measures = [c for c in current.columns if c not in (*keys, "batch_id")]
        touched = said.select(F.from_json("point", types(keys)).alias("k"), "action", F.from_json("before", types(measures)).alias("before"), "before_batch").select("k.*", "action", "before", "before_batch")
        if not current.join(touched.select(*keys), keys, "left_semi").where(F.col("batch_id") != batch_id).isEmpty():
            return Reply("rejected", "a later batch has changed its points")
        back = touched.where("action = 'updated'").select(*keys, "before.*", F.col("before_batch").alias("batch_id")).select(*current.columns)
        gone = touched.where("action = 'inserted'").select(*keys)
        done = self.spark.createDataFrame([tuple(batch[c.split(" ")[0]] for c in BATCHES.split(", ")[:-1]) + (self.stamp(),)], BATCHES)
        self.store.commit(Commit(put={f"series_{t.name}": (keys, back), "batches": (["id"], done)}, deleted={f"series_{t.name}": (keys, gone)}), state)
        return Reply("recorded", f"{batch_id} is reverted", id=batch_id)

    # text

    def ingest_preview(self, source: str | DataFrame, facts: Any, identity: dict[str, list[str]], exclude: tuple[str, ...] = ()) -> dict[str, Any]:
        """What a folder of notes (or rows name, text) would record. ``facts`` is a function from chunks to facts. Result: the run's
        id and the tables chunks, facts (with problems), and records (with outcomes)."""
        notes = read_text_folder(self.spark, source, exclude) if isinstance(source, str) else source
        chunks = text.split_documents(notes, "name", "text")
        held = ingest.held_against_quotes(facts(chunks), chunks, self.types)
        live = {t.name: self.typed(t) for t in self.types.values() if t.kind == "entity"}
        certain = ingest.with_references(held, self.types, live, {n: "name" for n, t in self.types.items() if "name" in t.fields})
        records = ingest.against_the_book(ingest.merged_records(certain, identity), self.entities.where("not retracted"), identity)
        return {"run": ingest.run_id(source if isinstance(source, str) else "rows", self.stamp()), "chunks": chunks, "facts": certain, "records": records}

    def ingest_apply(self, preview: dict[str, Any], by: str, consent: bool) -> Reply:
        """Records exactly what a preview shows as new or added; only with consent."""
        if not consent:
            return Reply("rejected", "nothing is recorded without consent")
        reply = self.write(ingest.changes_of(preview["records"], self.types, self.stamp(), by, preview["run"]))
        reply.id = preview["run"]
        return reply

    def ingest_revert(self, run: str, by: str) -> Reply:
        """Takes a run back by retractions."""
        return self.write(ingest.reversal_of(self.events, run, self.stamp(), by))
