"""python -m logloom VERB: the engine's commands over an index folder."""

from __future__ import annotations

import argparse
import json
import sys
import tempfile
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from logloom.functions.query import parse_since
from logloom.functions.scalar import one_line, utc_stamp
from logloom.operators import evaluate, graph, search, sessions, vectors
from logloom.plans import reports
from logloom.plans.api import Engine, Refused, arguments_of, budget_note, surface, surface_totals
from logloom.sources import transcripts
from logloom.sources.store import Store
from logloom.streaming import live

VERBS = {
    "import": "index new and changed transcripts (--since, --force)",
    "sync": "import below every root of --roots (a JSON object of names and folders)",
    "diff": "what an import would do; nothing is written",
    "rollouts": "index rollout files below --root",
    "scan": "files on disk by project",
    "list": "indexed sessions (--sort, --dir, --tier, --limit)",
    "status": "what the index holds",
    "runs": "the import log",
    "search": "full-text search (--query)",
    "searches": "the search log",
    "graph": "a transcript's graph (--path)",
    "embed": "embed what has no vector yet, or --dump it as JSON lines to a folder",
    "load": "load vectors made elsewhere (--path, --model, --class)",
    "eval": "text search against semantic search (--path: queries)",
    "live": "who is writing right now (--window seconds)",
    "tail": "follow files (--path: a glob, --for seconds, --start begin or end, --raw, --checkpoint)",
    "tools": "the tools offered and what they cost",
    "call": "one of the tools (--tool NAME -- and the flags that it declares)",
}


def _fleet(spark: SparkSession, root: str, store: Store, now: int, window: int):
    found = transcripts.rollout_files(spark, root)
    rollouts = found.join(transcripts.probe_headers(sessions.recent(found, now, window)), "file_path")
    return live.fleet(transcripts.discover_files(spark, root), rollouts, store.read("projects"), now, window)


def run(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    """The lines that a verb prints."""
    store, now = Store(spark, a.index), datetime.now(timezone.utc)
    stamp, run_id = now.strftime("%Y-%m-%d %H:%M:%S"), int(now.timestamp() * 1000)
    since = parse_since(a.since, now) if a.since else None
    store.init()
    own, projects, events = store.read("sessions"), store.read("projects"), store.read("events")
    told = lambda counts: [json.dumps(counts)]
    match a.verb:
        case "import":
            return told(store.import_transcripts(a.root, stamp, run_id, since=since, force=a.force))
        case "sync":
            return told(store.sync(json.loads(a.roots), stamp, run_id, since=since, force=a.force))
        case "rollouts":
            return told(store.import_rollouts(a.root, stamp))
        case "diff":
            return reports.diff(own, transcripts.discover_files(spark, a.root), a.root)
        case "scan":
            files = transcripts.discover_files(spark, a.root)
            return reports.scan(sessions.scan_states(own, files))
        case "list":
            return reports.listing(own, projects, a.sort, None if a.dir is None else a.dir == "desc", a.tier, a.limit or 40)
        case "status":
            return reports.status(own, projects)
        case "runs":
            return reports.runs(store.runs("import_runs"), a.limit or 20)
        case "searches":
            return reports.searches(store.read("search_log"), a.limit or 50)
        case "search":
            hits = Engine.of(store).call("search_sessions", {"query": a.query, "limit": a.limit or 40})
            return reports.table(hits.select("session_uuid", "seq", "role", F.round("score", 3).alias("score"), one_line(F.col("snippet"), 120).alias("snippet")), a.limit or 40)
        case "graph":
            lines = graph.graph_lines(spark, a.path)
            cut = not lines.where("truncated").limit(1).isEmpty()
            return graph.report(*graph.session_graph(lines), cut).split("\n")
        case "embed" if a.dump:
            vectors.dump_chunks(events, store.read("event_vectors"), [a.model], a.dump)
            return [f"wrote chunks to {a.dump}"]
        case "embed":
            return told(store.build_embeddings([a.model], stamp, run_id, limit=a.limit))
        case "load":
            return told(dict(zip(("stored", "refused"), store.load_vectors(a.path, a.model, a.vector_class, stamp, run_id))))
        case "eval":
            import pandas as pd

            asked = evaluate.load_queries(spark, a.path)
            asked = spark.createDataFrame([(k, *r) for k, r in enumerate(asked.collect())], "query_id int, query string, mode string, expect string, ids array<string>")
            embed = lambda text: (a.model, [float(x) for x in vectors.hashing_provider(pd.Series([text]))[0]])
            rows = evaluate.harness(asked, events, store.read("event_vectors"), embed)
            return [*reports.table(rows.drop("query_id")), "", *reports.table(evaluate.mode_means(rows))]
        case "live":
            rows = _fleet(spark, a.root, store, int(now.timestamp()), a.window)
            return reports.table(rows.select("heat", "seconds", "project", "session_uuid", "file_tier", "agent_id", utc_stamp(F.col("file_mtime")).alias("at")), a.limit or 40)
        case "tail":
            return _follow(spark, a)
        case "tools":
            offered = Engine.of(store).tools()
            totals = [f"{tokens:>6}  {origin:<9} {n} tools" for origin, n, tokens in surface_totals(offered)]
            return [*totals, budget_note(len(offered)), "", *(f"{cost:>6}  {origin:<9} {name}" for name, origin, cost in surface(offered))]
        case "call":
            engine = Engine.of(store)
            known = {c.name: c for c in engine.tools()}
            if a.tool not in known:
                raise Refused(f"unknown tool {a.tool!r}; known: {', '.join(sorted(known))}")
            return reports.table(engine.call(a.tool, arguments_of(known[a.tool], a.rest)), a.rows)
    raise Refused(f"unknown verb {a.verb!r}")


def _follow(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    """What is new, once or for some seconds, and what was counted. --raw: the lines as they are."""
    checkpoint = a.checkpoint or tempfile.mkdtemp(prefix="logloom-tail-")  # of a driver that follows local files
    lines = live.counted(live.to_events(live.tail(spark, a.path, start=a.start, windowSeconds=str(a.window if a.seconds else 0), checkpoint=checkpoint)))
    shown = ["path", "offset", F.col("line").alias("text")] if a.raw else ["path", "offset", "role", one_line(F.col("text"), 100).alias("text")]
    out: list[str] = []
    query = live.watch(lines, checkpoint, lambda batch, _: out.extend(reports.table(batch.orderBy("path", "offset").select(*shown), a.limit or 1000)[0 if not out else 1 :]), once=not a.seconds)
    query.awaitTermination(*([a.seconds] if a.seconds else []))
    if a.seconds:
        query.processAllAvailable()
        query.stop()
    counters = live.Counters()
    counters.add(query)
    return [*out, counters.line()]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="logloom", formatter_class=argparse.RawDescriptionHelpFormatter, epilog="\n".join(f"{k:<9} {v}" for k, v in VERBS.items()))
    p.add_argument("verb", choices=tuple(VERBS))
    p.add_argument("--index", required=True, help="the folder of the index, shared with the executors")
    for name, kind, default in (
        ("root", str, "."), ("roots", str, "{}"), ("since", str, None), ("sort", str, "updated"), ("dir", str, None), ("tier", str, None), ("limit", int, None), ("query", str, ""),
        ("path", str, ""), ("model", str, "hash/en/r1/64"), ("dump", str, None), ("window", int, 300), ("start", str, "end"), ("for", int, 0), ("checkpoint", str, None),
    ):
        p.add_argument(f"--{name}", type=kind, default=default, **({"dest": "seconds"} if name == "for" else {}))
    p.add_argument("--class", dest="vector_class", default="chat", choices=("chat", "tools"))
    p.add_argument("--force", action="store_true")
    p.add_argument("--raw", action="store_true")
    p.add_argument("--tool", default="", help="the tool that call calls")
    p.add_argument("--rows", type=int, default=200, help="rows that call shows at most")
    return p


def parse(argv: list[str]) -> argparse.Namespace:
    """What stands behind -- are the called tool's own flags."""
    at = argv.index("--") if "--" in argv else len(argv)
    a = parser().parse_args(argv[:at])
    a.rest = argv[at + 1 :]
    return a


def main(argv: list[str] | None = None) -> int:
    a = parse(sys.argv[1:] if argv is None else argv)
    try:
        print("\n".join(run(SparkSession.builder.getOrCreate(), a)))
    except ValueError as error:
        print(error, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
