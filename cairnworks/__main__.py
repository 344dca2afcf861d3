"""python -m cairnworks INDEX COMMAND ...: the index from a shell."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cairnworks.index import Index
from cairnworks.operators.diagnostics import drives_by_label
from cairnworks.sources.chat import ChatServer, choose_backend, server_base, server_key


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="cairnworks")
    parser.add_argument("index", help="folder of the index")
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("ingest")
    p.add_argument("root")
    p.add_argument("--label")
    p.add_argument("--prune", action="store_true")
    p = commands.add_parser("reconcile")
    p.add_argument("--drive")
    p.add_argument("--dry-run", action="store_true")
    commands.add_parser("stats")
    commands.add_parser("overview")
    p = commands.add_parser("dups")
    p.add_argument("--limit", type=int, default=20)
    p.add_argument("--min-size", type=int, default=1)
    p = commands.add_parser("cluster")
    p.add_argument("--reset-near", action="store_true")
    p = commands.add_parser("topics")
    p.add_argument("--limit", type=int)
    p.add_argument("--backend", choices=("auto", "heading", "server"), default="heading")
    p.add_argument("--llm-url", help="host, host:port or URL of a chat server")
    p.add_argument("--model", default="default")
    p.add_argument("--per-second", type=float, help="requests of all tasks together")
    p.add_argument("--at-once", type=int, default=4)
    commands.add_parser("queue")
    p = commands.add_parser("search")
    p.add_argument("pattern")
    p = commands.add_parser("keep")
    p.add_argument("cluster")
    p.add_argument("path_id", type=int)
    p = commands.add_parser("restore")
    p.add_argument("path_id", type=int)
    commands.add_parser("undo")
    commands.add_parser("plan")
    p = commands.add_parser("process")
    p.add_argument("--apply", action="store_true", help="move files; without it only the plan is shown")
    p.add_argument("--no-verify", action="store_true")
    commands.add_parser("undo-process")
    commands.add_parser("drives")
    p = commands.add_parser("as-of")
    p.add_argument("decision", type=int)
    p = commands.add_parser("compact")
    p.add_argument("--vacuum", action="store_true", help="also delete versions that no pointer needs")
    p = commands.add_parser("config")
    p.add_argument("key")
    p.add_argument("value", nargs="?")
    a = parser.parse_args(argv)

    index = Index(SparkSession.builder.appName("cairnworks").getOrCreate(), a.index)
    show = lambda df: [print(row) for row in df.toJSON().collect()]  # noqa: E731  reports of limited length
    if a.command == "ingest":
        print(json.dumps(index.ingest(a.root, a.label, a.prune)))
    elif a.command == "reconcile":
        show(index.reconcile(a.drive, a.dry_run))
    elif a.command == "dups":
        show(index.duplicates(a.min_size).orderBy(F.desc("reclaimable"), "hash").limit(a.limit))
    elif a.command == "cluster":
        print(json.dumps(index.cluster(a.reset_near)))
    elif a.command == "topics":
        if choose_backend(a.backend, a.llm_url) == "server":
            server = ChatServer(server_base(a.llm_url), a.model, server_key())
            print(json.dumps(index.topics(limit=a.limit, server=server, at_once=a.at_once, per_second=a.per_second)))
        else:
            print(json.dumps(index.topics(limit=a.limit)))
    elif a.command == "search":
        show(index.search(a.pattern))
    elif a.command == "keep":
        index.keep(a.cluster, a.path_id)
    elif a.command == "restore":
        index.restore(a.path_id)
    elif a.command == "undo":
        print(json.dumps(index.undo()))
    elif a.command == "plan":
        show(index.plan_moves())
    elif a.command == "process":
        show(index.process(dry_run=not a.apply, verify=not a.no_verify))
    elif a.command == "undo-process":
        print(json.dumps(index.undo_process()))
    elif a.command == "as-of":
        show(index.clusters_as_of(a.decision).orderBy("id"))
    elif a.command == "compact":
        print(json.dumps(index.compact(a.vacuum)))
    elif a.command == "drives":
        show(drives_by_label(index.drives))
    elif a.command == "config":
        if a.value is not None:
            index.set_setting(a.key, json.loads(a.value))
        print(json.dumps(index.get_setting(a.key)))
    else:
        show(getattr(index, a.command)())


if __name__ == "__main__":
    main()
