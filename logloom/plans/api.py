"""The tools of the engine behind one declaration each: parameters, validation and the call."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.functions.query import parse_since
from logloom.functions.scalar import rendered, truncated
from logloom.operators import graph, search, sessions, topics
from logloom.operators import vectors as vector_ops
from logloom.sources import transcripts
from logloom.sources.scratch import written
from logloom.sources.store import Store

COUNTS = ("files_scanned", "files_new", "files_changed", "files_skipped", "files_failed")


class Refused(ValueError):
    """The arguments do not fit the declaration, or name nothing that is there."""


@dataclass(frozen=True)
class Param:
    name: str
    kind: type = str
    required: bool = False
    default: Any = None
    choices: tuple[str, ...] = ()
    least: int | None = None
    most: int | None = None

    def check(self, value: Any) -> Any:
        if self.kind is int and isinstance(value, str) and value.lstrip("-").isdigit():
            value = int(value)
        if self.kind is bool and value in ("true", "false"):
            value = value == "true"
        if not isinstance(value, self.kind) or (self.kind is int and isinstance(value, bool)):
            raise Refused(f"{self.name} must be of type {self.kind.__name__}")
        if self.choices and value not in self.choices:
            raise Refused(f"{self.name} must be one of {', '.join(self.choices)}")
        if self.kind is int and (self.least is not None and value < self.least or self.most is not None and value > self.most):
            raise Refused(f"{self.name} must be from {self.least} to {self.most}")
        return value

    def json_schema(self) -> dict:
        out: dict = {"type": {str: "string", int: "integer", bool: "boolean", list: "array"}[self.kind]}
        if self.choices:
            out["enum"] = list(self.choices)
        if self.least is not None:
            out["minimum"] = self.least
        if self.most is not None:
            out["maximum"] = self.most
        return out


@dataclass(frozen=True)
class Command:
    name: str
    help: str
    params: tuple[Param, ...] = ()
    origin: str = "built-in"

    def validate(self, args: dict[str, Any]) -> dict[str, Any]:
        known = {p.name: p for p in self.params}
        if unknown := sorted(set(args) - set(known)):
            raise Refused(f"unknown argument {unknown[0]!r}; known: {', '.join(sorted(known)) or 'none'}")
        if missing := [p.name for p in self.params if p.required and args.get(p.name) is None]:
            raise Refused(f"{missing[0]} is required")
        return {p.name: p.default if args.get(p.name) is None else p.check(args[p.name]) for p in self.params}

    def json_schema(self) -> dict:
        return {"type": "object", "properties": {p.name: p.json_schema() for p in self.params}, "required": [p.name for p in self.params if p.required]}

    def cost(self) -> int:
        """About how many tokens a listing of this tool takes."""
        return max(40, (len(self.name) + len(self.help) + len(str(self.json_schema()))) // 4)


_LIMIT = Param("limit", int, default=20, least=1, most=5000)
#: A session is named by its uuid's beginning, which may be all digits, or by its id.
_ID = Param("id", int, least=-(1 << 63), most=(1 << 63) - 1)
COMMANDS = {
    c.name: c
    for c in (
        Command("search_sessions", "Ranked text search.", (Param("query", required=True), Param("project"), Param("tier", choices=("session", "subagent", "workflow_agent")), Param("since"), Param("until"), _LIMIT)),
        Command("read_session", "Lines of a session from a number on.", (Param("session"), _ID, Param("from", int, default=0, least=0, most=1 << 40), Param("limit", int, default=30, least=1, most=5000))),
        Command("read_context", "Lines around one line.", (Param("session"), _ID, Param("seq", int, required=True, least=0, most=1 << 40), Param("before", int, default=4, least=0, most=1000), Param("after", int, default=6, least=0, most=1000))),
        Command("semantic_search", "Search by meaning.", (Param("query", required=True), _LIMIT)),
        Command("index_status", "What the index holds."),
        Command("list_sessions", "Sessions in an order.", (Param("sort", default="updated", choices=tuple(sessions.SORT_KEYS)), Param("dir", choices=("asc", "desc")), Param("tier", choices=("session", "subagent", "workflow_agent")), Param("since"), Param("limit", int, default=40, least=1, most=5000))),
        Command("trace_topic", "Run and remember a query over sources.", (Param("name", required=True), Param("query", required=True), Param("engine", default="text", choices=("text", "vector")), Param("description"), Param("sources", list))),
        Command("dig_topic", "A topic's hits, its sources in turn.", (Param("name", required=True), Param("refresh", bool, default=True), _LIMIT)),
        Command("promote_topic", "Make a topic a tool of its own.", (Param("name", required=True),)),
        Command("demote_topic", "Take a topic's own tool away.", (Param("name", required=True),)),
        Command("forget_topic", "Delete a topic and its hits.", (Param("name", required=True),)),
        Command("list_topics", "All topics."),
        Command("describe_tool", "A tool's parameters.", (Param("name", required=True),)),
        Command("session_graph", "A transcript as beats, tools and targets.", (Param("path", required=True), Param("kind", default="nodes", choices=("nodes", "edges")))),
        Command("import_index", "Bring the index up to date.", (Param("corpus", default="all"), Param("since"), Param("force", bool, default=False))),
    )
}


@dataclass
class Engine:
    """Tables and the calls over them. Calls give DataFrames; nothing runs until they are used."""

    spark: SparkSession
    sessions: DataFrame
    projects: DataFrame
    events: DataFrame
    vectors: DataFrame | None = None
    topics: DataFrame | None = None
    topic_hits: DataFrame | None = None
    provider: Callable = vector_ops.hashing_provider
    sources: dict[str, Callable[[str], DataFrame]] = field(default_factory=dict)
    store: Store | None = None
    roots: dict[str, str] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)  # of the last trace, by source

    @classmethod
    def of(cls, store: Store, **more: Any) -> Engine:
        """Over the tables of a store."""
        read = store.read
        return cls(store.spark, read("sessions"), read("projects"), read("events"), read("event_vectors"), read("topics"), read("topic_hits"), store=store, **more)

    def call(self, name: str, args: dict[str, Any] | None = None) -> DataFrame:
        if name.startswith("dig_") and name not in COMMANDS:
            if name not in {c.name for c in self.tools()}:
                raise Refused(f"no promoted topic {name[4:]!r}")
            return self.dig_topic(name=name[4:], **{k: v for k, v in COMMANDS["dig_topic"].validate({"name": name[4:], **(args or {})}).items() if k != "name"})
        if name not in COMMANDS:
            raise Refused(f"unknown tool {name!r}")
        own = COMMANDS[name].validate(args or {})
        return getattr(self, name)(**{("start" if k == "from" else k): v for k, v in own.items()})

    def _resolve(self, session: str | None, id: int | None) -> int:
        """The id, or the one behind a uuid's beginning; refuses none and several."""
        if (session is None) == (id is None):
            raise Refused("either session, a uuid's beginning, or id is required")
        if id is not None:
            return id
        rows = sessions.resolve_distinct(sessions.by_uuid_prefix(self.sessions, session)).select("id").limit(2).collect()
        if len(rows) != 1:
            raise Refused(f"{'no' if not rows else 'more than one'} session begins with {session!r}")
        return rows[0]["id"]

    def search_sessions(self, query: str, limit: int = 20, engine: str | None = None, **filters: str | None) -> DataFrame:
        """The hits, with a snippet each; from the index where one is kept. A store's log gets a row about the search."""
        began = time.time()
        if self.store is not None and self.store.has_index():
            hits = self.store.search(query, limit, engine, **filters)
        else:
            hits = search.search_filtered(self.events, sessions.with_projects(self.sessions, self.projects), query, limit, engine, **filters)
        patterns = search.hit_patterns(search.compile_query(query, engine))
        shown = hits.withColumn("snippet", F.coalesce(search.best_fragment(F.col("text"), patterns), F.substring("text", 1, search.FRAGMENT)) if patterns else F.lit(None).cast("string"))
        if self.store is not None:
            shown = shown.persist()  # limit rows: counted for the log, then given out
            row = search.score_summary(shown).first()
            stamp = datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
            self.store.log_search(int(began * 1000), stamp, query, "text", row["hits"], int((time.time() - began) * 1000), row["top"], row["spread"])
        return shown

    def read_session(self, session: str | None = None, id: int | None = None, start: int = 0, limit: int = 30) -> DataFrame:
        """The lines, rendered, and whether more follow: the one line beyond the page tells."""
        own = self._resolve(session, id)
        page = sessions.read_page(self._events_of(own), own, start, limit + 1)
        more = F.count("*").over(Window.partitionBy(F.lit(0))) > limit  # a page of rows
        numbered = page.select("*", more.alias("more"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("seq")).alias("n"))
        return _rendered(numbered.where(F.col("n") <= limit).drop("n"))

    def read_context(self, seq: int, session: str | None = None, id: int | None = None, before: int = 4, after: int = 6) -> DataFrame:
        own = self._resolve(session, id)
        return _rendered(sessions.read_context(self._events_of(own), own, seq, before, after))

    def _events_of(self, session: int) -> DataFrame:
        """What holds a session's events: its files alone, where there is a store."""
        return self.events if self.store is None else self.store.session_events(session)

    def semantic_search(self, query: str, limit: int = 20) -> DataFrame:
        if self.vectors is None:
            raise Refused("nothing is embedded")
        import pandas as pd

        text = self.spark.createDataFrame([(query,)], "q string").select(vector_ops.script_model(F.col("q")).alias("m")).first()["m"]
        mean = self.store.vector_mean(text) if self.store is not None else None
        hits = vector_ops.semantic_search(self.vectors, [float(x) for x in self.provider(pd.Series([query]))[0]], text, limit, mean)
        found = vector_ops.with_sessions(hits, self.sessions, self.projects)
        return found.orderBy(F.col("score").desc(), "session_id", "seq", "chunk_index")

    def session_graph(self, path: str, kind: str = "nodes") -> DataFrame:
        return graph.session_graph(graph.graph_lines(self.spark, path))[kind == "edges"]

    def import_index(self, corpus: str = "all", since: str | None = None, force: bool = False) -> DataFrame:
        """A run below each of the named roots; the counts of each."""
        if self.store is None:
            raise Refused("there is no store to import into")
        named = self.roots if corpus == "all" else {k: v for k, v in self.roots.items() if k == corpus}
        if not named:
            raise Refused(f"unknown corpus {corpus!r}; known: {', '.join(sorted(self.roots)) or 'none'}")
        now, cutoff = datetime.now(timezone.utc), self._cutoff(since)
        counts = self.store.sync(named, now.strftime("%Y-%m-%d %H:%M:%S"), int(now.timestamp() * 1000), since=cutoff, force=force)
        self.sessions, self.projects, self.events = (self.store.read(t) for t in ("sessions", "projects", "events"))
        return self.spark.createDataFrame([(k, *(v[c] for c in COUNTS)) for k, v in sorted(counts.items())], f"corpus string, {', '.join(f'{c} long' for c in COUNTS)}")

    def index_status(self) -> DataFrame:
        """The overview, how many chat events are embedded, when the last import ended, what the roots hold that is not
        indexed, and files and bytes by tier. One row."""
        one = sessions.overview(self.sessions, self.projects)
        embedded = self.vectors if self.vectors is not None else self.spark.createDataFrame([], "session_id long, seq long")
        one = one.join(F.broadcast(vector_ops.chat_coverage(self.events, embedded).select(F.col("events").alias("chat_events"), F.col("embedded").alias("embedded_events"))))
        if self.store is not None:
            one = one.join(F.broadcast(self.store.read("import_runs").agg(F.max("finished_at").alias("last_import"))))
            pending = [sessions.scan_states(self.sessions, transcripts.discover_files(self.spark, root)).select("state") for root in self.roots.values()]
            if pending:
                found = reduce(DataFrame.unionByName, pending)
                one = one.join(F.broadcast(found.agg(*(F.count_if(F.col("state") == s).alias(f"pending_{s}") for s in ("new", "changed")))))
        tiers = sessions.count_and_size(self.sessions, "file_tier")  # a row a tier
        return one.join(F.broadcast(tiers.agg(F.sort_array(F.collect_list(F.struct("file_tier", "files", "bytes"))).alias("tiers"))))

    def list_sessions(self, sort: str = "updated", dir: str | None = None, tier: str | None = None, since: str | None = None, limit: int = 40) -> DataFrame:
        return sessions.list_sessions(self.sessions, self.projects, sort, None if dir is None else dir == "desc", tier, self._cutoff(since), limit)

    def _cutoff(self, since: str | None) -> int | None:
        """Epoch seconds of a window's begin; refuses a text that is none."""
        cutoff = parse_since(since, datetime.now(timezone.utc)) if since else None
        if since and since.strip().lower() != "all" and cutoff is None:
            raise Refused(f"{since!r} is no window of time: all, today, 90m, 12h, 7d or yyyy-MM-dd")
        return cutoff

    def _topics(self) -> tuple[DataFrame, DataFrame]:
        from logloom import schemas

        if self.topics is None:
            self.topics, self.topic_hits = self.spark.createDataFrame([], schemas.TOPICS), self.spark.createDataFrame([], schemas.TOPIC_HITS)
        return self.topics, self.topic_hits

    def trace_topic(self, name: str, query: str, engine: str = "text", description: str | None = None, sources: list[str] | None = None, at: str = "") -> DataFrame:
        from logloom import schemas

        stored, kept = self._topics()
        named = sources or ["sessions"]
        if unknown := [s for s in named if s != "sessions" and s not in self.sources]:
            raise Refused(f"unknown source {unknown[0]!r}")

        def own() -> DataFrame:
            hits = self.search_sessions(query, 200) if engine == "text" else self.semantic_search(query, 200)
            uuid = F.col("session_uuid") if "session_uuid" in hits.columns else F.lit(None).cast("string")
            role = F.col("role") if "role" in hits.columns else F.lit(None).cast("string")
            return hits.select("session_id", uuid.alias("uuid"), role.alias("role"), F.lit(None).cast("string").alias("ts"), "score", (F.col("snippet") if "snippet" in hits.columns else F.substring("text", 1, 300)).alias("snippet"))

        hits, self.errors = topics.trace(name, {s: own if s == "sessions" else (lambda s=s: self.sources[s](query)) for s in named}, at, self._written)
        if hits is None:
            raise Refused(f"no source answered: {self.errors}")
        new = self.spark.createDataFrame([(name, query, engine, description, at, at, 0, None, False, named)], schemas.TOPICS)
        self._keep(topic_hits=topics.replace_hits(kept, name, hits))
        own_hits = self.topic_hits.where(F.col("topic") == name)
        self._keep(topics=topics.finish_run(topics.upsert_topic(stored, new), name, own_hits.count(), at))
        return own_hits

    def _written(self, hits: DataFrame) -> DataFrame:
        """The rows of a source as they are now, whatever it gives later."""
        return written(hits)

    def _keep(self, **tables: DataFrame) -> None:
        """Topics and their hits as they are now: in the store, else as local rows, so that no plan grows with each call."""
        for name, rows in tables.items():
            if self.store is not None:
                self.store.replace(name, rows)
                setattr(self, name, self.store.read(name))
            else:
                setattr(self, name, self.spark.createDataFrame(rows.collect(), rows.schema))

    def dig_topic(self, name: str, refresh: bool = True, limit: int = 20) -> DataFrame:
        stored, _ = self._topics()
        row = stored.where(F.col("name") == name).first()
        if row is None:
            raise Refused(f"unknown topic {name!r}")
        if refresh:
            self.trace_topic(name, row["query"], row["engine"], row["description"], list(row["sources"]))
        return topics.dig(self.topic_hits, name, limit)

    def promote_topic(self, name: str, promoted: bool = True) -> DataFrame:
        if self._topics()[0].where(F.col("name") == name).isEmpty():
            raise Refused(f"unknown topic {name!r}")
        self._keep(topics=topics.set_promoted(self.topics, name, promoted))
        return self.topics

    def demote_topic(self, name: str) -> DataFrame:
        return self.promote_topic(name, False)

    def forget_topic(self, name: str) -> DataFrame:
        kept, hits = topics.forget(*self._topics(), name)
        self._keep(topics=kept, topic_hits=hits)
        return self.topics

    def tools(self) -> list[Command]:
        """The built-in tools, then one for each promoted topic."""
        names = [r["name"] for r in self._topics()[0].where("promoted").orderBy("name").select("name").toLocalIterator()]
        params = tuple(p for p in COMMANDS["dig_topic"].params if p.name != "name")
        return [*COMMANDS.values(), *(Command(f"dig_{n}", f"The hits of topic {n}.", params, "topic") for n in names)]

    def list_topics(self) -> DataFrame:
        return self._topics()[0].orderBy("name")

    def describe_tool(self, name: str) -> DataFrame:
        known = {c.name: c for c in self.tools()}
        if name not in known:
            raise Refused(f"unknown tool {name!r}")
        rows = [(p.name, p.kind.__name__, p.required, None if p.default is None else str(p.default)) for p in known[name].params]
        return self.spark.createDataFrame(rows, "name string, type string, required boolean, default string")


def _rendered(events: DataFrame) -> DataFrame:
    """events with their text cut for a reader, and shown: number, role, stamp and text."""
    ts = F.col("ts") if "ts" in events.columns else F.lit(None).cast("string")
    return events.withColumn("shown", rendered(F.col("seq"), F.col("role"), ts, F.col("text"))).withColumn("text", truncated(F.col("text")))


def surface(commands: Iterable[Command] | None = None) -> list[tuple[str, str, int]]:
    """(tool, origin, tokens) of everything that is offered, the dearest first."""
    return sorted(((c.name, c.origin, c.cost()) for c in commands or COMMANDS.values()), key=lambda x: (-x[2], x[0]))


#: Numbers of tools from which clients are known to choose worse, and to drop tools.
BUDGET = ((20, "within every known limit"), (30, "below where choices begin to get worse"), (40, "at the number beyond which some clients drop tools"))


def budget_note(n: int) -> str:
    """How a number of tools stands to what clients are known to bear."""
    return f"{n} tools: " + next((note for most, note in BUDGET if n <= most), "beyond what some clients keep, and choices get worse")


def surface_totals(commands: Iterable[Command]) -> list[tuple[str, int, int]]:
    """(origin, tools, tokens), and all of them together last."""
    rows = surface(commands)
    origins = sorted({origin for _, origin, _ in rows})
    told = [(o, sum(x[1] == o for x in rows), sum(x[2] for x in rows if x[1] == o)) for o in origins]
    return [*told, ("all", len(rows), sum(x[2] for x in rows))]


def arguments_of(command: Command, argv: list[str]) -> dict[str, Any]:
    """A tool's arguments from a command line, whose flags are those of its declaration."""
    import argparse

    p = argparse.ArgumentParser(prog=command.name, description=command.help, allow_abbrev=False, exit_on_error=False)
    for x in command.params:
        more = {"nargs": "*"} if x.kind is list else {}
        p.add_argument(f"--{x.name}", dest=x.name, type=str, default=argparse.SUPPRESS, required=x.required, choices=x.choices or None, **more)
    try:
        found, unknown = p.parse_known_args(argv)
    except argparse.ArgumentError as error:
        raise Refused(str(error)) from None
    if unknown:
        raise Refused(f"unknown argument {unknown[0]!r}; known: {', '.join('--' + x.name for x in command.params) or 'none'}")
    return vars(found)
