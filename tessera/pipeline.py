"""An index pass: list, diff, read, embed, commit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.diagnostics import Errors
from tessera.functions import text as T
from tessera.functions.encoders import Encoder, encode_column, hash_projection
from tessera.operators import ingest, mutations
from tessera.sources.config import Config, Source, differs
from tessera.sources.reader import on_disk
from tessera.sources.snapshots import Snapshots


VECTORS = ("embeddings", "text_embeddings")


def read_entries(files: DataFrame, read_text: Column) -> DataFrame:
    """Entries of the images table for listed files; ``read_text`` is a file's text, or a struct of :data:`tessera.sources.reader.READ`.

    A file that could not be read has status ``error`` and the reason; its text is empty.
    """
    found = files.withColumn("_read", read_text)
    kind = found.schema["_read"].dataType
    of = lambda name, cast: F.col(f"_read.{name}") if hasattr(kind, "fieldNames") else F.lit(None).cast(cast)
    text = F.col("_read.text") if hasattr(kind, "fieldNames") else F.col("_read")
    done = found.withColumns({"text": F.coalesce(text, F.lit("")), "error": of("error", "string"), "ocr_json": of("ocr_json", "string"), "width": of("width", "int"), "height": of("height", "int")})
    done = done.withColumns({"name": T.file_stem(F.col("path")), "indexed_at": F.current_timestamp(), "status": F.when(F.col("error").isNull(), "ok").otherwise("error")})
    return done.drop("_read")


def _store(store: Snapshots, images: DataFrame, entries: DataFrame, gone: DataFrame) -> None:
    """Commit entries and forget ``gone`` ids; files that were read anew lose their vectors.  Writes what changes, not the tables."""
    left = mutations.remove_many(images, gone)
    stale = mutations.changed_ids(left, entries).unionByName(gone)
    store.change(images=(mutations.upserted(left, entries), gone), **dict.fromkeys(VECTORS, (None, stale)))


def index_pass(store: Snapshots, listing: DataFrame, read_text: Column, hydrate: bool = False, sources: list[str] | None = None, on_disk: Callable[[Column], Column] | None = on_disk) -> dict:
    """Bring the images table in line with a listing (path, source, source_ord, size, mtime, attributes); ``read_text`` recognises a file's text.

    Returns the counters.  Only ``sources`` (default: those listed) are compared: what others hold stays.  A
    known file goes if it is neither listed nor ``on_disk``.  Placeholders in a cloud are scanned and
    skipped.  Changed files lose their vectors; unreadable ones are kept with status ``error`` and counted as failed.
    """
    claimed = ingest.claim_first_source(listing)
    names = sorted({r["source"] for r in claimed.select("source").distinct().collect()} if sources is None else set(sources))
    images = store.table("images")
    diff = ingest.ingest_diff(claimed, images, names, F.lit(False) if hydrate else ingest.cloud_only(F.col("attributes")), on_disk).cache()
    work = claimed.join(diff.where(F.col("status").isin("new", "changed")).select("path"), "path", "left_semi")
    done = read_entries(work, read_text).cache()
    gone = images.join(diff.where("status = 'gone'").select("path"), "path", "left_semi").select("id")
    report = ingest.ingest_report(diff, done.where("status = 'error'").count()).first().asDict()
    _store(store, images, done, gone)
    done.unpersist()
    diff.unpersist()
    return report


def index_files(store: Snapshots, files: DataFrame, read_text: Column) -> int:
    """Index listed files, whatever is known of them; returns how many could be read."""
    done = read_entries(files, read_text).cache()
    good = done.where("status = 'ok'").count()
    images = store.table("images")
    _store(store, images, done, images.limit(0).select("id"))
    done.unpersist()
    return good


def forget(store: Snapshots, ids: list[int]) -> None:
    """Remove images and their vectors."""
    rows = store.spark.createDataFrame([(i,) for i in ids], "id long")
    store.change(**dict.fromkeys(("images", *VECTORS), (None, rows)))


def embed_pass(store: Snapshots, model: str, table: str = "text_embeddings", encoder: Encoder = hash_projection, errors: Errors | None = None) -> int:
    """Vectors for images that lack one of this model; returns how many were made.  Why texts failed goes to ``errors``.

    Failures are kept as empty vectors and not tried again, unless nothing worked: then nothing is kept.
    """
    missing = ingest.missing_meaning if table == "text_embeddings" else ingest.missing_embedding
    work = missing(store.table("images"), store.table(table), model)
    new = work.select(F.col("id").alias("image_id"), F.lit(model).alias("model"), encode_column(T.doc_prompt(F.col("text")), encoder, errors=errors).alias("vec"))
    new = new.cache()
    made = new.where(F.size("vec") > 0).count()
    if made:
        store.change(**{table: (mutations.one_vector(new), None)})
    new.unpersist()
    return made


def apply_config(store: Snapshots, previous: list[Source], following: list[Source]) -> list[str]:
    """Forget sources that are gone or point elsewhere; returns their names.  A renamed source is removed and added."""
    spark = store.spark
    rows = lambda sources: spark.createDataFrame([(s.name, s.path) for s in sources], "name string, path string")
    gone = [r["name"] for r in mutations.removed_sources(rows(previous), rows(following)).collect()]
    if gone:
        ids = store.table("images").where(F.col("source").isin(*gone)).select("id")
        store.change(**dict.fromkeys(("images", *VECTORS), (None, ids)))
    return sorted(gone)


def follow_config(store: Snapshots, previous: Config, following: Config, listing: Callable[[Config], DataFrame], read_text: Column, encoders: dict[str, Encoder]) -> dict:
    """Bring the index in line with a new configuration; returns what was done.

    Sources that are gone or point elsewhere leave the index.  If sources (their order counts, as the first claims a
    path), extensions or placeholders changed, ``listing`` of the new configuration is indexed; if a model changed, or a search
    was switched on, images without its vectors get them by ``encoders``.  What did not change is left alone.
    """
    todo = differs(previous, following)
    done: dict = {**todo, "forgotten": apply_config(store, previous.sources, following.sources)}
    if todo["indexing"]:
        done["report"] = index_pass(store, listing(following), read_text, following.hydrate_cloud_files, [s.name for s in following.sources])
    for kind, table, on, model in (("visual", "embeddings", following.visual_search, following.visual_model), ("meaning", "text_embeddings", following.meaning_search, following.meaning_model)):
        if on and model in encoders and (todo[kind] or todo["indexing"]):
            done[f"{kind}_vectors"] = embed_pass(store, model, table, encoders[model])
    return done
