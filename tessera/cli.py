"""python -m tessera.cli VERB ROOT ...: a thin command line over the engine; --help lists the verbs."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import functions as F

from tessera.engine import Engine
from tessera.evaluate import encoder_agreement, evaluate, latencies
from tessera.functions.encoders import ClipTokens, hash_projection
from tessera.functions.text import CLOSE, OPEN
from tessera.operators import outline, reporting, vector_search
from tessera.pipeline import embed_pass, forget, index_pass
from tessera.session import session
from tessera.sources.config import eval_queries
from tessera.sources.folder import FolderSource
from tessera.sources.reader import read_beside, read_files, there
from tessera.sources.snapshots import Snapshots

VERBS = {
    "index": "FOLDER ...: list, read texts beside the files, store",
    "embed": "vectors for what lacks them",
    "search": "QUERY ...",
    "stats": "counts by source",
    "sources": "names and numbers of files",
    "ocr": "FILE ...: the text that indexing would store",
    "outline": "ID TERM ...: places of the words that a search marks",
    "model": "FOLDER: bytes of a model's files",
    "tokens": "VOCAB.json MERGES.txt TEXT ...: ids of the image model's tokenizer",
    "meaning-check": "TEXTS.json: the smallest cosine between vectors made together and alone",
    "eval": "QUERIES.json [WINDOW ...]: relevance, also by other windows under the best meaning score",
    "bench": "QUERY ...: latencies",
    "vacuum": "delete files of old versions",
    "compact": "merge the segments of all tables",
    "check": "read all files and name the damaged ones",
}


def marked(images, id_: int, terms: list[str]):
    """line, marked: words of a stored page that the terms mark, with their boxes as they are drawn."""
    lines = images.where(F.col("id") == id_).select("id", F.posexplode(outline.from_json(F.col("ocr_json"))).alias("line", "_l"))
    words = lines.select("id", "line", F.transform("_l.words", lambda w: w["text"]).alias("words"), outline.padded(F.col("_l.words")).alias("boxes"))
    found = outline.outline_words(words, terms, ["id", "line", "boxes"])
    return found.select("line", "marked", F.transform("marked", lambda i: F.get("boxes", i)).alias("boxes")).orderBy("line")


def clip_tokens(vocab: str, merges: str) -> ClipTokens:
    """The tokenizer from its public files: a JSON vocabulary and a list of merges."""
    with open(vocab, encoding="utf-8") as f:
        ids = json.load(f)
    with open(merges, encoding="utf-8") as f:
        pairs = [tuple(line.split()) for line in f if not line.startswith("#") and len(line.split()) == 2]
    return ClipTokens(ids, {p: i for i, p in enumerate(pairs)}, ids["<|startoftext|>"], ids["<|endoftext|>"])


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tessera", epilog="; ".join(f"{k} {v}" for k, v in VERBS.items()))
    p.add_argument("verb", choices=list(VERBS))
    p.add_argument("root")
    p.add_argument("rest", nargs="*")
    p.add_argument("--limit", type=int, default=20)
    args = p.parse_args(argv)
    if args.verb == "model":
        print(reporting.model_bytes(args.root))
        return
    if args.verb == "tokens":
        coder = clip_tokens(args.root, args.rest[0])
        ids = coder.encode(" ".join(args.rest[1:]))
        print(ids[: sum(coder.mask(ids))])
        return
    if args.verb == "ocr":
        for path in (args.root, *args.rest):
            print(read_beside(path))
        return
    if args.verb == "meaning-check":
        with open(args.root, encoding="utf-8") as f:
            print(encoder_agreement(hash_projection, json.load(f)))
        return
    spark = session()
    store = Snapshots(spark, args.root)
    if args.verb == "index":
        spark.dataSource.register(FolderSource)
        reader = spark.read.format("folder")
        for i, path in enumerate(args.rest, 1):
            reader = reader.option("path" if i == 1 else f"path{i}", path)
        names = [os.path.basename(path) for path in args.rest]
        print(index_pass(store, reader.load(), read_files(F.col("path")), sources=names))
    elif args.verb == "embed":
        print(embed_pass(store, "hash-projection"))
    elif args.verb == "vacuum":
        print(store.vacuum())
    elif args.verb == "compact":
        for name in store.state["tables"]:
            store.compact(name, whole=True)
    elif args.verb == "check":
        print("\n".join(store.damaged()) or "all files are as they were written")
    elif args.verb == "stats":
        reporting.stats_totals(store.table("images"), store.table("embeddings"), store.table("text_embeddings")).show()
        reporting.stats_by_source(store.table("images")).show()
    elif args.verb == "sources":
        reporting.stats_by_source(store.table("images")).show(truncate=False)
    elif args.verb == "outline":
        marked(store.table("images"), int(args.rest[0]), args.rest[1:]).show(truncate=False)
    else:
        images = store.table("images")
        meaning = vector_search.load_embeddings(images, store.table("text_embeddings"), "hash-projection")
        index = store.text_index()
        engine = Engine(images, None, meaning, None, hash_projection, present=there, forget=lambda ids: forget(store, ids), index=index)
        if args.verb == "eval":
            queries = [(r["q"], r["a"]) for r in eval_queries(spark, args.rest[0]).collect()]
            engines = {"text": Engine(images, index=index), "text and meaning": engine}
            for w in args.rest[1:]:
                engines[f"window {w}"] = Engine(images, None, meaning, None, hash_projection, meaning_window=float(w), index=index)
            evaluate(engines, queries).show()
        elif args.verb == "bench":
            print(latencies(engine, args.rest))
        else:
            for r in engine.search(" ".join(args.rest), args.limit).collect():
                print(r["pos"], r["path"], render(r["snippet"]), sep="\t")


def render(snippet: str, begin: str = "[", end: str = "]") -> str:
    """A snippet as one line, its marks shown."""
    return " ".join(snippet.replace(OPEN, begin).replace(CLOSE, end).split())


if __name__ == "__main__":
    main()
