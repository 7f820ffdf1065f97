"""Commands: index, query, status, extract, config, doctor."""

from __future__ import annotations

import argparse
import json


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="spanrank", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *folders: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for f in folders:
            p.add_argument(f)
        p.add_argument("--endpoint")
        p.add_argument("--model")
        p.add_argument("--max-chars", type=int)
        p.add_argument("--allow-insecure", action="store_true")
        return p

    command("index", "root", "index").add_argument("--rebuild", action="store_true")
    q = command("query", "index", "text")
    q.add_argument("--other", action="append", default=[], help="another index to answer from")
    q.add_argument("--where", action="append", default=[])
    q.add_argument("--exclude-pointed-by", action="append", default=[])
    q.add_argument("--identity", default="id")
    q.add_argument("-l", "--limit", type=int, default=5)
    q.add_argument("--paths-only", action="store_true")
    command("status", "index").add_argument("--truncated", action="store_true")
    command("extract", "index", "prefix", "into", "destination")
    command("doctor", "root")
    c = sub.add_parser("config")
    c.add_argument("root")
    c.add_argument("key", nargs="?")
    c.add_argument("value", nargs="?")
    c.add_argument("--project", action="store_true")
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    from spanrank.plans import config

    if a.command == "config":
        if a.key:
            print(config.write(a.root, a.key, a.value, a.project))
        else:
            settings, rest = config.load(a.root)
            print(json.dumps(vars(settings) | {k: v for k, v in rest.items() if k != config.SECRET}, indent=1))
        return 0
    from pyspark.sql import SparkSession

    from spanrank.functions.embed import HashEmbedder, HttpEmbedder
    from spanrank.plans.index import Index, blamed, query

    settings, rest = config.load(getattr(a, "root", "."), {"max_chars": a.max_chars, "endpoint": a.endpoint, "model": a.model})
    embedder = HttpEmbedder(rest["endpoint"], rest["model"] or "", rest["api_key"], a.allow_insecure) if rest["endpoint"] else HashEmbedder()
    spark = SparkSession.builder.appName("spanrank").getOrCreate()
    open_ = lambda place: Index(spark, place, embedder, settings)
    if a.command == "index":
        print(json.dumps(open_(a.index).update(a.root, a.rebuild)))
    elif a.command == "query":
        first = open_(a.index)
        rows = query([first, *map(open_, a.other)], a.text, a.where, a.exclude_pointed_by, a.identity, a.limit).collect()
        for r in rows:
            print(r["path"] if a.paths_only else f"{r['score']:.3f}  {r['path']}:{r['start']}-{r['end']}  {r['trail']}")
        if not rows and a.where:
            for r in blamed(first, a.where).collect():
                print(f"no record meets {r['predicate']}")
    elif a.command == "status":
        index = open_(a.index)
        (index.truncated() if a.truncated else index.status()).show(truncate=False)
        if not a.truncated:
            print("keys:", ", ".join(r["key"] for r in index.keys().collect()))
    elif a.command == "extract":
        open_(a.index).extract(a.prefix, a.into, a.destination)
    elif a.command == "doctor":
        print(json.dumps(Index(spark, a.root, embedder, settings).doctor()))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
