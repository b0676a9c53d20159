"""Command line: one subcommand for each command of a workspace."""

from __future__ import annotations

import argparse
from importlib import import_module

from pyspark.sql import DataFrame

from murmur.functions.rules import PARAGRAPH_GAP_S, SENTENCE_SIMILARITY
from murmur.session import build_session
from murmur.sources.feed import read_feeds
from murmur.workspace import Show, Tools, Workspace, check_options, recognise_file


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="murmur", description=__doc__)
    p.add_argument("--root", help="folder of the tables")
    p.add_argument("--show", default="show", help="slug of the show")
    p.add_argument("--feeds", action="append", help="a feed file; repeat for more, in order")
    p.add_argument("--feed-url", action="append", help="a feed to download when its copy is not fresh; repeat for more, in order")
    p.add_argument("--backend", "--recogniser", default="default", help="label of the speech recogniser")
    p.add_argument("--tools", help="module:attribute of a Tools object")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("episodes", help="list episodes with their status")
    for name in ("sync", "recognise", "diarize"):
        c = sub.add_parser(name)
        if name != "sync":
            c.add_argument("number", type=int)
        if name == "recognise":
            c.add_argument("--redo", action="store_true", help="forget cached results first")
        if name == "sync":
            c.add_argument("--dry-run", action="store_true")
            c.add_argument("--download-only", action="store_true")
        if name != "diarize":
            c.add_argument("--diarize", action="store_true")
        c.add_argument("--gap", type=float, default=PARAGRAPH_GAP_S)
        c.add_argument("--speakers", help="names in order of appearance, with commas between")
        c.add_argument("--learn", action="store_true")
        c.add_argument("--strip-fillers", action="store_true")
    c = sub.add_parser("file", help="recognise one audio file without a show")
    c.add_argument("audio")
    c.add_argument("output")
    c.add_argument("--diarize", action="store_true")
    for name in ("denoise", "denoise2", "extract", "distill"):
        c = sub.add_parser(name)
        c.add_argument("number", type=int, nargs="?")
        if name == "denoise2":
            c.add_argument("--similarity-threshold", type=float, default=SENTENCE_SIMILARITY)
        if name in ("extract", "distill"):
            c.add_argument("--model", default="small")
        if name == "distill":
            c.add_argument("--extractor", default="small")
    return p


def _print(table: DataFrame) -> None:
    """All rows, a partition at a time."""
    print("\t".join(table.columns))
    for r in table.toLocalIterator():
        print("\t".join("" if x is None else str(x) for x in r))


def main(argv: list[str] | None = None) -> None:
    p = parser()
    a = p.parse_args(argv)
    if a.command != "file" and not (a.root and (a.feeds or a.feed_url)):
        p.error("name --root, and --feeds or --feed-url")
    speakers = [s.strip() for s in a.speakers.split(",")] if getattr(a, "speakers", None) else None
    diarize = a.command == "diarize" or getattr(a, "diarize", False)
    try:
        check_options(a.command, getattr(a, "learn", False), speakers, diarize)
    except ValueError as e:
        p.error(str(e))
    tools = Tools()
    if a.tools:
        module, _, name = a.tools.partition(":")
        tools = getattr(import_module(module), name)
    spark = build_session()
    if a.command == "file":
        print(f"{recognise_file(spark, tools, a.audio, a.output, a.diarize)} segments")
        return
    w = Workspace(spark, a.root, Show(a.show, a.show, a.feed_url or []), a.backend, tools)
    episodes = w.episodes(read_feeds(spark, a.feeds)) if a.feeds else w.load_episodes()
    if a.command == "episodes":
        _print(w.status(episodes).select("number", "status", "slug", "title").orderBy("number"))
    elif a.command in ("sync", "recognise", "diarize"):
        extra = {"redo": getattr(a, "redo", False), "dry_run": getattr(a, "dry_run", False), "download_only": getattr(a, "download_only", False)}
        done = w.produce(episodes, getattr(a, "number", None), diarize=diarize, speakers=speakers, learn=a.learn, gap=a.gap, strip_fillers=a.strip_fillers, **extra)
        print(", ".join(f"{k} {n}" for k, n in done.items()))
    elif a.command == "denoise":
        w.denoise(episodes, a.number)
        _print(w.savings("denoised").orderBy("slug"))
    elif a.command == "denoise2":
        w.denoise2(episodes, a.number, a.similarity_threshold)
        _print(w.savings("denoised2").orderBy("slug"))
    elif a.command == "extract":
        w.extract(episodes, a.number, a.model)
    else:
        w.distill(episodes, a.number, a.extractor, a.model)


if __name__ == "__main__":
    main()
