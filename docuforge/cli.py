"""Command line: init, index, search, retrieve, status, doctor, remove and config.

    python -m docuforge.cli --root PROJECT index
    python -m docuforge.cli --root PROJECT search "words" --mode keyword --jsonl
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from docuforge import config as C

CONFIG, LOCAL, STATE = ".docuforge.toml", ".docuforge.local.toml", ".docuforge"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docuforge")
    p.add_argument("--root", default=".")
    p.add_argument("--master", default="local[*]")
    sub = p.add_subparsers(dest="command", required=True)
    init = sub.add_parser("init")
    init.add_argument("--preset", choices=sorted(C.PRESETS))
    init.add_argument("--force", action="store_true")
    i = sub.add_parser("index")
    i.add_argument("target", nargs="?", default=".")
    for flag in ("--dry-run", "--no-embed", "--reembed"):
        i.add_argument(flag, action="store_true")
    for name in ("search", "retrieve"):
        s = sub.add_parser(name)
        s.add_argument("query")
        s.add_argument("--mode", choices=C.CHOICES["search", "mode"])
        s.add_argument("--level", choices=C.CHOICES["search", "level"])
        s.add_argument("--kind", choices=("all", "text", "image"), default="all")
        s.add_argument("--limit", type=int)
        s.add_argument("--filetype", action="append", default=[])
        s.add_argument("--path", action="append", default=[])
        for flag in ("--json", "--jsonl", "--compact", "--explain"):
            s.add_argument(flag, action="store_true")
    for name in ("status", "doctor"):
        sub.add_parser(name)
    sub.add_parser("remove").add_argument("path")
    c = sub.add_parser("config")
    c.add_argument("action", choices=("show", "validate"))
    return p


def provider(c: C.Config):
    from docuforge.providers import HashingProvider, HttpProvider, Profile

    e = c.embedding
    if e.provider == "native":
        return HashingProvider(e.dimensions, e.model)
    url = e.endpoint or "https://api.openai.com/v1/embeddings"
    return HttpProvider(Profile(C.model_name(e.model, e.provider), e.dimensions, e.document_prefix, e.query_prefix), url, "ollama" if e.provider == "ollama" else "openai", e.api_key_env)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    root = os.path.realpath(a.root)
    path = os.path.join(root, CONFIG)
    if a.command == "init":
        if os.path.exists(path) and not a.force:
            print(f"{path} exists; use --force", file=sys.stderr)
            return 1
        with open(path, "w", encoding="utf-8") as f:
            f.write(C.dumped(C.overlay(C.Config(), C.PRESETS.get(a.preset or "", {}))))
        return 0
    c = C.load(path, os.path.join(root, LOCAL))
    if a.command == "config":
        print(C.dumped(c) if a.action == "show" else "ok")
        return 0

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from docuforge.plans import indexing, reports
    from docuforge.plans.search import Index, Search, search
    from docuforge.shipping import ship
    from docuforge.sources.files import discover, extract_text, scan_binary
    from docuforge.sources.globs import glob_pattern
    from docuforge.sources.store import Store

    spark = SparkSession.builder.master(a.master).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    store, p = Store(spark, os.path.join(root, STATE, "index")), provider(c)

    if a.command == "index":
        found = discover(spark, root, a.target, list(c.text.include), list(c.image.include), list(c.text.exclude)).where("kind = 'text'")
        texts = extract_text(scan_binary(spark, root).join(F.broadcast(found.select("path")), "path"))
        scope = "" if a.target in (".", "./") else a.target.removeprefix("./").rstrip("/")
        o = indexing.Options(c.index.chunking, c.index.store_full_files, c.index.store_chunks, scope, c.index.target_tokens, c.index.max_tokens, c.index.overlap_tokens, c.index.min_chunk_chars)
        if a.dry_run:
            print(json.dumps(indexing.dry_run(store, indexing.as_files(texts.where("text is not null")), o)))
            return 0
        out = indexing.index(store, texts, o)
        if a.reembed:
            store.write({"embeddings": store.read("embeddings").where(F.col("profile_hash") != p.profile.hash)})
        out["embedded"] = 0 if a.no_embed else indexing.embed_missing(store, p, c.embedding.batch_size)
        print(json.dumps(out))
        return 0
    if not store.exists("files"):
        print("nothing is indexed yet", file=sys.stderr)
        return 1
    mine = store.read("embeddings").where(F.col("profile_hash") == p.profile.hash)
    if a.command in ("status", "doctor"):
        counts = reports.index_counts(store.read("files"), store.read("chunks"), mine).first().asDict()
        ok = counts["missing_active_profile_embeddings"] == 0
        print(json.dumps({"ok": ok, "profile": p.profile.hash, "counts": counts} if a.command == "doctor" else {"profile": p.profile.hash, "counts": counts}))
        return 0 if ok or a.command == "status" else 1
    if a.command == "remove":
        print(json.dumps({"removed": indexing.remove(store, a.path)}))
        return 0
    mode, w = a.mode or c.search.mode, c.search.weights
    s = Search(
        a.query, mode, a.level or c.search.level, a.kind, a.limit or c.search.limit, (w.vector, w.keyword, w.metadata), c.search.max_chunks_per_file, c.search.snippet_chars,
        a.filetype, glob_pattern(a.path) if a.path else None, None if mode == "keyword" else p.query(a.query),
    )
    rows, warnings = search(Index(*(store.read(t) for t in ("files", "chunks", "postings", "stats")), mine, profile_hash=p.profile.hash), s)
    for x in warnings:
        print(f"warning: {x}", file=sys.stderr)
    if a.explain:
        for r in reports.explained(rows).collect():
            print(f"{r.score:.3f}  {r.path}  {r.reason}")
    elif a.jsonl:
        for r in reports.result_json(rows, root).collect():
            print(r["json"])
    elif a.json or a.command == "retrieve":
        results = [json.loads(r["json"]) for r in reports.result_json(rows, root).collect()]
        print(json.dumps({"schema_version": 1, "query": a.query, "mode": s.mode, "level": s.level, "profile": p.profile.hash, "warnings": warnings, "results": results}, indent=2, ensure_ascii=False))
    else:
        print(reports.rendered(rows.collect(), a.compact))
    return 0


if __name__ == "__main__":
    sys.exit(main())
