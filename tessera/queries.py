"""The engine's operators as queries on the shared tables, each with SQL that gives the same rows.

``documents`` plays the corpus (source is also its name column, n_chars its recency), ``embeddings`` both
vector sets, ``events`` the event stream.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import encoders
from tessera.functions import text as T
from tessera.functions.vectors import l2_normalize
from tessera.engine import Engine
from tessera.operators import batch, fusion, ingest, mutations, outline, postings, relevance, reporting, text_search, vector_search
from tessera.plans.query import Query, parse
from tessera.plans.together import together
from tessera.sources.shared import shared_folder, until_end
from tessera.sources.snapshots import Snapshots
from tessera.streaming import bursts, watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
LIMIT = 120
TERMS = Query(["under", "the"])
FLOOR, WINDOW, VISUAL_ID, MEANING_ID = 0.2, 0.2, 7, 11


def query(sql: str | None = None):
    """Register a query and its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("name"), "source", F.col("n_chars").alias("mtime"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors whose id is a document's, as the engine joins vectors to images."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit("m").alias("model"), F.col("embedding").alias("vec"))
    return vector_search.load_embeddings(corpus(spark, sf_dir), e, "m")


_kept: dict[tuple[str, str], Snapshots] = {}


def kept(spark: SparkSession, sf_dir: str) -> Snapshots:
    """The documents as an index on disk, made once for an application: what a search reads is there before it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _kept:
        _kept[key] = new_store(spark, sf_dir)
    return _kept[key]


def new_store(spark: SparkSession, sf_dir: str) -> Snapshots:
    store = empty_store(spark)
    store.commit(images=entries(corpus(spark, sf_dir)))
    return store


def empty_store(spark: SparkSession) -> Snapshots:
    """An index that goes when the application ends."""
    store = Snapshots(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    until_end(spark, store.root)
    return store


def entries(rows: DataFrame) -> DataFrame:
    """Rows of a corpus as the images of an index; times are seconds."""
    of = {"path": F.concat(F.lit("/Lib/"), "source", F.lit("/"), F.col("id").cast("string"), F.lit(".PNG")), "size": F.col("mtime"), "mtime": F.timestamp_seconds("mtime"), "indexed_at": F.timestamp_seconds(F.lit(0)), "status": F.lit("ok")}
    none = {"width": "int", "height": "int", "error": "string", "ocr_json": "string"}
    return rows.withColumns({**of, **{c: F.lit(None).cast(t) for c, t in none.items()}})


def seconds(rows: DataFrame) -> DataFrame:
    return rows.withColumn("mtime", F.unix_timestamp("mtime"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).withColumn("status", F.lit("ok"))


def made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors made so far: those of labels below 5 by model m1, the others by an older one."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.when(F.col("label") < 5, "m1").otherwise("m0").alias("model"), F.col("embedding").alias("vec"))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later listing of the documents as files: the French ones are gone, a source changed, copies of the German ones are new."""
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/Lib/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".PNG"))
    old = d.where("lang <> 'fr'").select(F.upper(path).alias("path"), "source", (F.col("n_chars") + (F.col("source") == "src1").cast("long")).alias("size"), F.col("doc_id").alias("mtime"))
    new = d.where("lang = 'de'").select(F.concat(path, F.lit(".new.png")).alias("path"), "source", F.col("n_chars").alias("size"), F.col("doc_id").alias("mtime"))
    return old.unionByName(new)


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/Lib/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".PNG"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), path.alias("path"), "source", F.col("n_chars").alias("size"), F.col("doc_id").alias("mtime"))


# --- text ---------------------------------------------------------------------------------------

_STATS = """
    base AS (SELECT doc_id AS id, source, n_chars AS mtime, text, lower(text) AS t, lower(source) AS n,
             greatest(length(text) - 2, 0) + greatest(length(source) - 2, 0) AS dl FROM documents),
    corp AS (SELECT count(*) AS cnt, avg(dl) AS av FROM base)"""


def _occ(word: str) -> str:
    n = len(word)
    return f"((length(t) - length(replace(t, '{word}', ''))) // {n} + (length(n) - length(replace(n, '{word}', ''))) // {n})"


def _text_sql(words: list[str], tag: str = "hits", stats: bool = True) -> str:
    """CTEs that end in ``tag``: pos, id, source, mtime, score, text."""
    f = [f"f{tag}{i}" for i in range(len(words))]
    df = ", ".join(f"count(*) FILTER (WHERE contains(t, '{w}') OR contains(n, '{w}')) AS d{i}" for i, w in enumerate(words))
    idf = [f"(CASE WHEN ln((cnt - d{i} + 0.5) / (d{i} + 0.5)) > 0 THEN ln((cnt - d{i} + 0.5) / (d{i} + 0.5)) ELSE 1e-6 END)" for i in range(len(words))]
    score = " + ".join(f"({idf[i]} * {f[i]} * 2.2 / ({f[i]} + 1.2 * (0.25 + 0.75 * dl / av)))" for i in range(len(words)))
    occ = ", ".join(f"{_occ(w)} AS {f[i]}" for i, w in enumerate(words))
    match = " AND ".join(f"(contains(t, '{w}') OR contains(n, '{w}'))" for w in words)
    return (_STATS + "," if stats else "") + f"""
    df_{tag} AS (SELECT {df} FROM base),
    sc_{tag} AS (SELECT id, source, mtime, text, round(-({score}), 9) AS score
                 FROM (SELECT *, {occ} FROM base WHERE {match}) q, corp, df_{tag}),
    {tag} AS (SELECT row_number() OVER (ORDER BY score, mtime DESC, id) AS pos, * FROM sc_{tag}
              QUALIFY row_number() OVER (ORDER BY score, mtime DESC, id) <= {LIMIT})"""


_TEXT = _text_sql(["under", "the"])
_PHRASE = _text_sql(["under the"], "ph", stats=False)
_SPLIT = f"WITH {_TEXT}, {_PHRASE}, ex AS (SELECT * FROM hits WHERE id IN (SELECT id FROM ph)), lo AS (SELECT * FROM hits WHERE id NOT IN (SELECT id FROM ph))"
_HIT = ("pos", "id", "source", "mtime", "score", "matched_text")


@query(f"WITH {_TEXT} SELECT pos, id, source, mtime, score, true AS matched_text FROM hits")
def text_search_(spark, sf_dir):
    return text_search.text_search(corpus(spark, sf_dir), TERMS, LIMIT).select(*_HIT)


@query(f"WITH {_TEXT} SELECT pos, id, source, mtime, score, true AS matched_text FROM hits")
def text_search_postings(spark, sf_dir):
    """The same from a kept index, which reads no text."""
    store = kept(spark, sf_dir)
    return seconds(postings.indexed_hits(store.table("images"), store.text_index(), TERMS, LIMIT, exact=False)[0]).select(*_HIT)


@query(f"{_SPLIT} SELECT pos, id, source, mtime, score, true AS matched_text FROM ex")
def exact_hits_postings(spark, sf_dir):
    store = kept(spark, sf_dir)
    return seconds(postings.indexed_hits(store.table("images"), store.text_index(), TERMS, LIMIT)[1]).select(*_HIT)


@query("SELECT doc_id AS id, doc_id AS pos FROM documents WHERE false")
def text_search_no_limit(spark, sf_dir):
    return text_search.text_search(corpus(spark, sf_dir), TERMS, 0).select("id", F.col("pos").cast("long").alias("pos"))


@query(f"WITH {_TEXT} SELECT n AS lim, pos, id, source, mtime, score, true AS matched_text FROM hits, (VALUES (-1), (0), (1), (7), (50)) l(n) WHERE pos <= n")
def text_limits(spark, sf_dir):
    """The same search under several limits; none and fewer than none give no hits."""
    rows = [text_search.text_search(corpus(spark, sf_dir), TERMS, n).select(F.lit(n).alias("lim"), *_HIT).withColumn("pos", F.col("pos").cast("long")) for n in (-1, 0, 1, 7, 50)]
    return reduce(DataFrame.unionByName, rows)


@query(f"{_SPLIT} SELECT pos, id, source, mtime, score, true AS matched_text FROM ex")
def exact_hits(spark, sf_dir):
    return text_search.exact_hits(corpus(spark, sf_dir), TERMS, LIMIT).select(*_HIT)


@query(f"{_SPLIT} SELECT pos, id, source, mtime, score, true AS matched_text FROM lo")
def loose_hits(spark, sf_dir):
    return text_search.loose_hits(corpus(spark, sf_dir), TERMS, LIMIT).select(*_HIT)


@query("""SELECT doc_id AS id, source FROM documents WHERE (contains(lower(text), 'license') OR contains(lower(source), 'license'))
          AND (contains(lower(text), 'version') OR contains(lower(source), 'version'))""")
def text_filter(spark, sf_dir):
    return corpus(spark, sf_dir).where(text_search.term_filter(Query(["License", "version"]))).select("id", "source")


@query("""SELECT doc_id AS id, source FROM documents WHERE (contains(lower(text), 'license') OR contains(lower(source), 'license'))
          AND (contains(lower(text), 'version') OR contains(lower(source), 'version'))""")
def postings_filter(spark, sf_dir):
    store = kept(spark, sf_dir)
    return postings.matching(store.table("images"), store.text_index(), Query(["License", "version"])).select("id", "source")


@query("""SELECT doc_id AS id FROM documents WHERE translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%é_%'
          OR translate(source, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%é_%'""")
def short_term_filter(spark, sf_dir):
    return corpus(spark, sf_dir).where(text_search.term_filter(Query(["é_"]))).select("id")


@query("SELECT doc_id AS id, source FROM documents WHERE lower(source) LIKE 'src1%'")
def source_prefix(spark, sf_dir):
    return corpus(spark, sf_dir).where(text_search.source_like("SRC1")).select("id", "source")


@query(f"SELECT row_number() OVER (ORDER BY n_chars DESC, doc_id) AS pos, doc_id AS id, n_chars AS mtime, false AS matched_text FROM documents QUALIFY pos <= {LIMIT}")
def recent(spark, sf_dir):
    return text_search.text_search(corpus(spark, sf_dir), parse(""), LIMIT).select("pos", "id", "mtime", "matched_text")


@query("SELECT doc_id AS id, text FROM documents WHERE doc_id IN (3, 17, 42)")
def get_texts(spark, sf_dir):
    return text_search.get_texts(corpus(spark, sf_dir), [3, 17, 42])


@query("SELECT doc_id AS id, n_chars AS mtime FROM documents WHERE source = 'src3'")
def scan_source(spark, sf_dir):
    return corpus(spark, sf_dir).where(F.col("source") == "src3").select("id", "mtime")


@query("SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-02-01'")
def date_range(spark, sf_dir):
    q = parse("after:2024-01-02 before:2024-02")
    events = table(spark, sf_dir, "events").withColumn("mtime", F.col("ts").cast("timestamp"))
    return events.where(text_search.date_filter(q)).select("event_id", "user_id")


@query("""WITH d AS (SELECT doc_id AS id, text, instr(lower(text), 'license') AS p, length(text) AS n FROM documents),
          w AS (SELECT *, greatest(1, least(p - 29, n - 65)) AS b FROM d)
          SELECT id, CASE WHEN p = 0 OR length(lower(text)) <> n THEN substr(text, 1, 160) ELSE
            (CASE WHEN b > 1 THEN '…' ELSE '' END) || substr(text, b, p - b) || chr(1) || substr(text, p, 7) || chr(2)
            || substr(text, p + 7, greatest(0, b + 66 - (p + 7))) || (CASE WHEN b + 65 < n THEN '…' ELSE '' END) END AS snippet FROM w""")
def snippet(spark, sf_dir):
    return corpus(spark, sf_dir).select("id", T.snippet(F.col("text"), "license").alias("snippet"))


@query(r"""SELECT doc_id AS id, trim(regexp_replace(text, '[ \n\r\t]+', ' ', 'g')) AS clean FROM documents""")
def clean_text(spark, sf_dir):
    return corpus(spark, sf_dir).select("id", T.clean_text(F.col("text")).alias("clean"))


@query(r"""SELECT doc_id AS id, 'title: none | text: ' || trim(regexp_replace(text, '[ \n\r\t]+', ' ', 'g')) AS prompt FROM documents""")
def doc_prompt(spark, sf_dir):
    return corpus(spark, sf_dir).select("id", T.doc_prompt(F.col("text")).alias("prompt"))


@query(r"""SELECT doc_id AS id, lower(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS flat FROM documents""")
def collapse(spark, sf_dir):
    return corpus(spark, sf_dir).select("id", T.collapse(F.col("text")).alias("flat"))


@query(r"""SELECT page_id AS id, regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '\.[^.]*$', '') AS stem FROM pages""")
def file_stem(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), T.file_stem(F.col("url")).alias("stem"))


@query("SELECT doc_id AS id, len(string_split(text, chr(10))) AS lines FROM documents")
def line_counts(spark, sf_dir):
    return corpus(spark, sf_dir).select("id", T.line_count(F.col("text")).cast("long").alias("lines"))


@query("SELECT doc_id AS id, CASE WHEN length(text) > 60 THEN substr(text, 1, 57) || '…' ELSE text END AS title FROM documents")
def clip_title(spark, sf_dir):
    return corpus(spark, sf_dir).select("id", T.clip_title(F.col("text")).alias("title"))


@query(r"""SELECT doc_id AS id, trim(regexp_replace(text, '\r\n|[\r\n\f]', ' ', 'g')) AS clean FROM documents""")
def clean_snippet(spark, sf_dir):
    return corpus(spark, sf_dir).select("id", T.clean_snippet(F.concat(F.lit(T.OPEN), "text", F.lit(T.CLOSE))).alias("clean"))


@query(r"""SELECT page_id AS id, regexp_replace(regexp_replace(lower(trim(url)), '[^\p{L}\p{Nd}]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages""")
def source_slug(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), T.source_slug(F.col("url")).alias("slug"))


@query("SELECT doc_id AS id, upper(sha1(lower(source) || '|' || n_chars || '|' || doc_id)) AS key FROM documents")
def thumb_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.thumb_key(F.col("source"), F.col("n_chars"), F.col("doc_id")).alias("key"))


@query("""WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
          w AS (SELECT id, line_no, unnest(string_split(line, ' ')) AS word, generate_subscripts(string_split(line, ' '), 1) - 1 AS i FROM l)
          SELECT id, line_no, list(i ORDER BY i)::VARCHAR AS marked FROM w WHERE contains(lower(word), 'license') GROUP BY id, line_no""")
def outline_words(spark, sf_dir):
    lines = corpus(spark, sf_dir).select("id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    rows = lines.select("id", F.col("line_no").cast("long").alias("line_no"), F.split("line", " ", -1).alias("words"))
    return outline.outline_words(rows, ["license"], ["id", "line_no"]).select("id", "line_no", F.col("marked").cast("string").alias("marked"))


# --- vectors ------------------------------------------------------------------------------------

_VECTORS = "vecs AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, source, n_chars AS mtime FROM embeddings JOIN documents ON doc_id = vec_id)"


def _near_sql(tag: str, id_: int, window: float = WINDOW, floor: float = FLOOR) -> str:
    return f"""
    s_{tag} AS (SELECT id, list_dot_product(v, (SELECT v FROM vecs WHERE id = {id_})) AS s FROM vecs WHERE id <> {id_}),
    {tag} AS (SELECT row_number() OVER (ORDER BY s DESC, id) AS pos, id, s AS score FROM s_{tag}
              WHERE s >= {floor} AND s >= (SELECT max(s) FROM s_{tag}) - {window} QUALIFY pos <= {LIMIT})"""


def _near(spark, sf_dir, id_: int, window: float = WINDOW, v: DataFrame | None = None) -> DataFrame:
    v = vectors(spark, sf_dir) if v is None else v
    return vector_search.vector_topk(v, vector_search.vector_of(v, id_), LIMIT, FLOOR, window, exclude=(id_,))


@query(f"WITH {_VECTORS}, {_near_sql('v', VISUAL_ID, 2.0)} SELECT pos, id, round(score, 6) AS score FROM v")
def vector_topk(spark, sf_dir):
    return _near(spark, sf_dir, VISUAL_ID, 2.0).withColumn("score", F.round("score", 6))


@query(f"WITH {_VECTORS}, {_near_sql('v', VISUAL_ID, 0.07)} SELECT pos, id, round(score, 6) AS score FROM v")
def vector_window(spark, sf_dir):
    return _near(spark, sf_dir, VISUAL_ID, 0.07).withColumn("score", F.round("score", 6))


_SEVERAL = (7, 11, 42, 99, 150)


@query(f"""WITH {_VECTORS}, s AS (SELECT a.id AS item, v.id, list_dot_product(v.v, a.v) AS s FROM vecs a, vecs v WHERE a.id IN {_SEVERAL}),
           r AS (SELECT item, id, s, row_number() OVER (PARTITION BY item ORDER BY s DESC, id) AS pos FROM s WHERE s >= 0.1 QUALIFY pos <= 30 AND s >= max(s) OVER (PARTITION BY item) - 0.8)
           SELECT item, pos, id, round(s, 6) AS score FROM r""")
def vector_batch(spark, sf_dir):
    """Several vectors searched in one pass, each with its own best rows and window."""
    v = vectors(spark, sf_dir)
    own = {r["id"]: list(r["vec"]) for r in v.where(F.col("id").isin(*_SEVERAL)).select("id", "vec").collect()}
    return batch.vector_hits(v, own, 30, 0.1, 0.8, spark).withColumn("score", F.round("score", 6))


@query(f"""WITH {_VECTORS}, s AS (SELECT id, list_dot_product(v, (SELECT v FROM vecs WHERE id = {VISUAL_ID})) AS s FROM vecs WHERE starts_with(lower(source), 'src1') AND mtime >= 500)
           SELECT row_number() OVER (ORDER BY s DESC, id) AS pos, id, round(s, 6) AS score FROM s WHERE s >= 0 QUALIFY pos <= {LIMIT}""")
def vector_in_source(spark, sf_dir):
    """A source and a date narrow the vectors before they are ranked."""
    v = vectors(spark, sf_dir)
    q = Query(["x"], source="SRC1", after=500)
    return vector_search.vector_topk(v, vector_search.vector_of(v, VISUAL_ID), LIMIT, 0.0, 2.0, q).withColumn("score", F.round("score", 6))


@query(f"WITH {_VECTORS}, {_near_sql('v', VISUAL_ID, 1.0)} SELECT pos, id, round(score, 6) AS score FROM v UNION ALL SELECT 0, id, 1.0 FROM vecs WHERE id = {VISUAL_ID}")
def more_like_this(spark, sf_dir):
    return vector_search.more_like_this(vectors(spark, sf_dir), VISUAL_ID, LIMIT, floor=FLOOR).withColumn("score", F.round("score", 6))


@query("""SELECT vec_id, round(list_sum(list_transform(v, lambda x: (x / n) * (x / n))), 9) AS squares, round(v[1] / n, 6) AS first FROM
          (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)""")
def l2_normalize_(spark, sf_dir):
    unit = table(spark, sf_dir, "embeddings").select("vec_id", l2_normalize(F.transform("embedding", lambda x: x.cast("double") * 3)).alias("v"))
    return unit.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 9).alias("squares"), F.round(F.col("v")[0], 6).alias("first"))


@query(f"WITH {_VECTORS} SELECT id, source, mtime, len(v) AS dim FROM vecs")
def load_embeddings(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", "source", "mtime", F.size("vec").cast("long").alias("dim"))


@query(f"WITH {_VECTORS}, {_near_sql('v', VISUAL_ID, 2.0)} SELECT v.pos, v.id, source, n_chars AS mtime, substr(text, 1, 160) AS snippet, round(score, 6) AS visual_score, false AS matched_text FROM v JOIN documents ON doc_id = v.id")
def get_hits(spark, sf_dir):
    return text_search.get_hits(corpus(spark, sf_dir), _near(spark, sf_dir, VISUAL_ID, 2.0)).withColumn("visual_score", F.round("visual_score", 6))


# --- fusion -------------------------------------------------------------------------------------

_FUSED = f"""{_SPLIT}, {_VECTORS}, {_near_sql("v", VISUAL_ID)}, {_near_sql("m", MEANING_ID)},
    ranks AS (SELECT id, row_number() OVER (ORDER BY pos) - 1 AS r, 0 AS l FROM hits WHERE id NOT IN (SELECT id FROM ex)
      UNION ALL SELECT id, row_number() OVER (ORDER BY pos) - 1, 1 FROM m WHERE id NOT IN (SELECT id FROM ex)
      UNION ALL SELECT id, row_number() OVER (ORDER BY pos) - 1, 2 FROM v WHERE id NOT IN (SELECT id FROM ex)),
    fused AS (SELECT id, round(sum(1.0::DOUBLE / (10 + r)), 9) AS score, min(r) FILTER (WHERE l = 0) AS text_rank, min(l) AS list, arg_min(r, l * 1000000 + r) AS rank FROM ranks GROUP BY id),
    alls AS (SELECT id, 0 AS block, NULL::DOUBLE AS score, pos AS a, 0 AS b, 0 AS c FROM ex
      UNION ALL SELECT id, 1, score, coalesce(text_rank, 2000000000), list, rank FROM fused),
    placed AS (SELECT row_number() OVER (ORDER BY block, score DESC NULLS FIRST, a, b, c, id) AS pos, id, block, score FROM alls QUALIFY pos <= {LIMIT}),
    hybrid AS (SELECT p.pos, p.id, p.block, p.score, h.id IS NOT NULL AS matched_text, round(v.score, 6) AS visual_score, round(m.score, 6) AS meaning_score
      FROM placed p LEFT JOIN hits h ON h.id = p.id LEFT JOIN v ON v.id = p.id LEFT JOIN m ON m.id = p.id)"""


def _parts(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    near = lambda i: lambda: text_search.settle(_near(spark, sf_dir, i))
    found, meant, seen = together(spark, lambda: text_search.hits_and_exact(corpus(spark, sf_dir), TERMS, LIMIT), near(MEANING_ID), near(VISUAL_ID))
    return *found, meant, seen


@query(f"{_FUSED} SELECT id, score, text_rank, list, rank FROM fused")
def rrf_fusion(spark, sf_dir):
    return fusion.rrf_fusion(*_parts(spark, sf_dir))


@query(f"""{_FUSED}, w AS (SELECT h.*, d.source, d.n_chars AS mtime, d.text, instr(lower(d.text), 'under') AS p, length(d.text) AS n FROM hybrid h JOIN documents d ON d.doc_id = h.id),
           b AS (SELECT *, greatest(1, least(p - 30, n - 65)) AS b FROM w)
           SELECT pos, id, block, score, matched_text, visual_score, meaning_score, source, source AS name, mtime,
             CASE WHEN NOT matched_text OR p = 0 OR length(lower(text)) <> n THEN substr(text, 1, 160) ELSE (CASE WHEN b > 1 THEN '…' ELSE '' END) || substr(text, b, p - b) || chr(1) || substr(text, p, 5) || chr(2)
             || substr(text, p + 5, greatest(0, b + 66 - (p + 5))) || (CASE WHEN b + 65 < n THEN '…' ELSE '' END) END AS snippet FROM b""")
def hybrid_snippets(spark, sf_dir):
    """What the engine returns for the fused hits: attributes and snippets."""
    return Engine(corpus(spark, sf_dir))._described(text_search.settle(hybrid_search(spark, sf_dir)), TERMS, "hybrid")


@query(f"{_FUSED} SELECT * FROM hybrid")
def hybrid_search(spark, sf_dir):
    return fusion.fuse(*_parts(spark, sf_dir), LIMIT)


@query(f"""{_FUSED} SELECT id, CASE WHEN matched_text THEN '' WHEN meaning_score IS NOT NULL THEN '≈ related text' WHEN visual_score IS NOT NULL THEN '≈ looks like' ELSE '' END AS badge,
           CASE WHEN matched_text AND visual_score IS NOT NULL THEN 'text, and looks like' WHEN matched_text THEN 'text' WHEN meaning_score IS NOT NULL THEN 'related text'
           WHEN visual_score IS NOT NULL THEN 'looks like' ELSE 'recent' END AS kind FROM hybrid""")
def match_badge(spark, sf_dir):
    return fusion.match_badge(hybrid_search(spark, sf_dir)).select("id", "badge", "kind")


# --- index maintenance --------------------------------------------------------------------------

_MADE = "made AS (SELECT vec_id AS image_id, CASE WHEN label < 5 THEN 'm1' ELSE 'm0' END AS model FROM embeddings)"
_PATH = "'/Lib/' || source || '/' || doc_id || '.PNG'"
_LISTS = f"""listed AS (SELECT upper({_PATH}) AS path, source, n_chars + (source = 'src1')::BIGINT AS size, doc_id AS mtime FROM documents WHERE lang <> 'fr'
      UNION ALL SELECT {_PATH} || '.new.png', source, n_chars, doc_id FROM documents WHERE lang = 'de'),
    known AS (SELECT doc_id AS id, {_PATH} AS path, source, n_chars AS size, doc_id AS mtime FROM documents),
    diff AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'new' WHEN a.path IS NULL THEN 'gone'
      WHEN a.size = b.size AND a.mtime = b.mtime THEN 'unchanged' ELSE 'changed' END AS status
      FROM listed a FULL OUTER JOIN known b ON lower(a.path) = lower(b.path))"""


@query(f"WITH {_MADE} SELECT doc_id AS id, n_chars AS mtime FROM documents WHERE doc_id NOT IN (SELECT image_id FROM made WHERE model = 'm1')")
def missing_embedding(spark, sf_dir):
    return ingest.missing_embedding(images(spark, sf_dir), made(spark, sf_dir), "m1").select("id", "mtime")


@query(f"WITH {_MADE} SELECT doc_id AS id FROM documents WHERE length(text) > 0 AND doc_id NOT IN (SELECT image_id FROM made WHERE model = 'm1')")
def missing_meaning(spark, sf_dir):
    return ingest.missing_meaning(images(spark, sf_dir), made(spark, sf_dir), "m1").select("id")


@query(f"WITH {_MADE} SELECT image_id, 'm0' AS model FROM made WHERE image_id NOT IN (SELECT doc_id FROM documents) AND model = 'm0' UNION ALL SELECT image_id, 'm1' FROM made WHERE model = 'm1' UNION ALL SELECT doc_id, 'm1' FROM documents WHERE doc_id NOT IN (SELECT image_id FROM made WHERE model = 'm1')")
def save_embeddings(spark, sf_dir):
    old = made(spark, sf_dir)
    new = ingest.missing_embedding(images(spark, sf_dir), old, "m1").select(F.col("id").alias("image_id"), F.lit("m1").alias("model"), F.array().cast("array<float>").alias("vec"))
    return mutations.save_embeddings(old, new).select("image_id", "model")


@query(f"WITH {_LISTS} SELECT * FROM diff")
def ingest_diff(spark, sf_dir):
    return ingest.ingest_diff(listing(spark, sf_dir), known(spark, sf_dir))


@query(f"""WITH {_LISTS} SELECT count(*) FILTER (WHERE status <> 'gone') AS scanned, count(*) FILTER (WHERE status IN ('new', 'changed')) AS indexed, count(*) FILTER (WHERE status = 'unchanged') AS unchanged,
           count(*) FILTER (WHERE status = 'gone') AS removed, 0::BIGINT AS failed, 0::BIGINT AS skipped FROM diff""")
def ingest_report(spark, sf_dir):
    return ingest.ingest_report(ingest_diff(spark, sf_dir))


_SCOPED = f"""{_LISTS}, mine AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN CASE WHEN b.mtime % 3 = 0 THEN 'elsewhere' ELSE 'gone' END WHEN a.mtime % 5 = 0 THEN 'cloud'
      WHEN b.path IS NULL THEN 'new' WHEN a.size = b.size AND a.mtime = b.mtime THEN 'unchanged' ELSE 'changed' END AS status
      FROM (SELECT * FROM listed WHERE source IN ('src1', 'src2')) a FULL OUTER JOIN (SELECT * FROM known WHERE source IN ('src1', 'src2')) b ON lower(a.path) = lower(b.path))"""


@query(f"WITH {_SCOPED} SELECT * FROM mine")
def gone_by_source(spark, sf_dir):
    """A listing of two sources: others are left alone, placeholders skipped, what is still on disk (a third, here) stays."""
    on_disk = lambda path: F.regexp_extract(path, "(\\d+)[.]PNG$", 1).cast("long") % 3 == 0
    own = listing(spark, sf_dir).where(F.col("source").isin("src1", "src2"))
    return ingest.ingest_diff(own, known(spark, sf_dir), ["src1", "src2"], F.col("mtime") % 5 == 0, on_disk)


@query(f"""WITH {_SCOPED} SELECT count(*) FILTER (WHERE status NOT IN ('gone', 'elsewhere')) AS scanned, count(*) FILTER (WHERE status IN ('new', 'changed')) - 2 AS indexed, count(*) FILTER (WHERE status = 'unchanged') AS unchanged,
           count(*) FILTER (WHERE status = 'gone') AS removed, 2::BIGINT AS failed, count(*) FILTER (WHERE status = 'cloud') AS skipped FROM mine""")
def ingest_counters(spark, sf_dir):
    return ingest.ingest_report(gone_by_source(spark, sf_dir), failed=2)


@query(f"""WITH {_LISTS}, up AS (SELECT path, source FROM listed), old AS (SELECT id, path, source FROM known),
           kept AS (SELECT o.id, u.path, u.source FROM up u JOIN old o ON lower(u.path) = lower(o.path)),
           rest AS (SELECT * FROM old WHERE lower(path) NOT IN (SELECT lower(path) FROM up))
           SELECT id, path, source FROM kept UNION ALL SELECT * FROM rest""")
def upsert(spark, sf_dir):
    """Entries replace rows of the same path; new ones get ids after the largest, left out here as their order is free."""
    entries = listing(spark, sf_dir).select("path", "source", F.lit(0).alias("indexed_at"))
    top = known(spark, sf_dir).agg(F.max("id")).first()[0]
    return mutations.upsert(known(spark, sf_dir).select("id", "path", "source"), entries).where(F.col("id") <= top).select("id", "path", "source")


# An index on disk as a first segment and what changed since; SQL sees the documents as they are then.
_CHANGED = """later AS (SELECT doc_id, lang, source, n_chars, CASE WHEN source = 'src2' THEN text || ' under the' ELSE text END AS text FROM documents WHERE source <> 'src1')"""


def changed_store(spark, sf_dir) -> Snapshots:
    """A store in which the images of one source went and those of another have new texts, as two changes."""
    store = new_store(spark, sf_dir)
    store.change(images=(None, store.table("images").where("source = 'src1'").select("id")))
    store.change(images=(store.table("images").where("source = 'src2'").withColumn("text", F.concat("text", F.lit(" under the"))), None))
    return store


def _found(store: Snapshots) -> DataFrame:
    return seconds(postings.indexed_hits(store.table("images"), store.text_index(), TERMS, LIMIT, exact=False)[0]).select(*_HIT)


_LATER = f"WITH {_CHANGED}, {_TEXT.replace('FROM documents', 'FROM later')} SELECT pos, id, source, mtime, score, true AS matched_text FROM hits"


@query(_LATER)
def segment_search(spark, sf_dir):
    """Text search on the kept index over a first segment and two changes."""
    return _found(changed_store(spark, sf_dir))


@query(_LATER)
def segment_search_compacted(spark, sf_dir):
    """The same after the changes were merged."""
    store = changed_store(spark, sf_dir)
    store.compact("images")
    return _found(store)


@query(f"WITH {_CHANGED} SELECT doc_id AS id, source, text FROM later")
def segment_merged(spark, sf_dir):
    """The table that readers see over a first segment and two changes, merged in full afterwards."""
    store = changed_store(spark, sf_dir)
    store.compact("images", whole=True)
    return store.table("images").select("id", "source", "text")


@query(f"""WITH {_LISTS}, up AS (SELECT path, source FROM listed), old AS (SELECT id, path, source FROM known),
           kept AS (SELECT o.id, u.path, u.source FROM up u JOIN old o ON lower(u.path) = lower(o.path)),
           rest AS (SELECT * FROM old WHERE lower(path) NOT IN (SELECT lower(path) FROM up)),
           fresh AS (SELECT path, source FROM up WHERE lower(path) NOT IN (SELECT lower(path) FROM old))
           SELECT id, path, source FROM kept UNION ALL SELECT * FROM rest UNION ALL SELECT NULL, path, source FROM fresh""")
def segment_upsert(spark, sf_dir):
    """Entries as a change: known paths keep their ids, new ones (whose ids are free) come with theirs left out."""
    store = new_store(spark, sf_dir)
    images_, top = store.table("images"), known(spark, sf_dir).agg(F.max("id")).first()[0]
    files = listing(spark, sf_dir).select("path", "source", F.col("size").alias("mtime"), F.lit("").alias("text"), F.lit("").alias("name"), F.lit(0).alias("id"))
    new = entries(files.withColumnRenamed("path", "_p")).withColumn("path", F.col("_p")).drop("_p", "id")
    store.change(images=(mutations.upserted(images_, new), None))
    return store.table("images").select(F.when(F.col("id") <= top, F.col("id")).alias("id"), "path", "source")


@query("SELECT doc_id AS id, source FROM documents WHERE lower(source) <> 'src3'")
def segment_remove_path(spark, sf_dir):
    """A folder that went, as a change."""
    store = new_store(spark, sf_dir)
    rows = store.table("images")
    store.change(images=(None, rows.join(mutations.remove_path(rows, "/lib/SRC3"), "id", "left_anti").select("id")))
    return store.table("images").select("id", "source")


@query(f"WITH {_MADE} SELECT image_id, 'm0' AS model FROM made WHERE image_id NOT IN (SELECT doc_id FROM documents) AND model = 'm0' UNION ALL SELECT image_id, 'm1' FROM made WHERE model = 'm1' UNION ALL SELECT doc_id, 'm1' FROM documents WHERE doc_id NOT IN (SELECT image_id FROM made WHERE model = 'm1')")
def segment_save_embeddings(spark, sf_dir):
    """Vectors of a new model as a change, merged with those before."""
    store = empty_store(spark)
    store.commit(embeddings=made(spark, sf_dir))
    new = ingest.missing_embedding(images(spark, sf_dir), store.table("embeddings"), "m1").select(F.col("id").alias("image_id"), F.lit("m1").alias("model"), F.array().cast("array<float>").alias("vec"))
    store.change(embeddings=(mutations.one_vector(new), None))
    store.compact("embeddings")
    return store.table("embeddings").select("image_id", "model")


@query(f"WITH {_LISTS} SELECT id, path FROM known WHERE lower(path) IN (SELECT lower(path) FROM listed)")
def drop_missing(spark, sf_dir):
    return ingest.drop_missing(known(spark, sf_dir), listing(spark, sf_dir)).select("id", "path")


@query("""WITH l AS (SELECT lang || '/' || n_chars AS path, source, row_number() OVER (ORDER BY doc_id) AS source_ord FROM documents)
          SELECT path, arg_min(source, source_ord) AS source FROM l GROUP BY path""")
def claim_first_source(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", F.col("n_chars").cast("string")).alias("path"), "source", F.col("doc_id").alias("source_ord"))
    return ingest.claim_first_source(rows).select("path", "source")


@query("SELECT page_id, url FROM pages WHERE NOT (lower(url) = 'https:' OR starts_with(lower(url), 'https:/'))")
def remove_path(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"))
    return mutations.remove_path(p, "HTTPS:").select("page_id", F.col("path").alias("url"))


@query("SELECT doc_id AS id, source FROM documents WHERE source <> 'src3'")
def remove_source(spark, sf_dir):
    return mutations.remove_source(corpus(spark, sf_dir), "src3").select("id", "source")


@query("""SELECT page_id, CASE WHEN starts_with(url, 'https:/') THEN 'moved' || substr(url, 7) ELSE url END AS url,
          CASE WHEN starts_with(url, 'https:/') THEN 'moved' ELSE 'web' END AS source FROM pages""")
def move_folder(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"), F.lit("web").alias("source"))
    moved, _ = mutations.move_path(p, "https:", "moved", "moved")
    return moved.select("page_id", F.col("path").alias("url"), "source")


@query("""WITH p AS (SELECT DISTINCT source AS name, lang AS path FROM documents), n AS (SELECT DISTINCT source AS name, lang AS path FROM documents WHERE lang <> 'fr')
          SELECT * FROM p EXCEPT SELECT * FROM n""")
def config_diff(spark, sf_dir):
    p = table(spark, sf_dir, "documents").select(F.col("source").alias("name"), F.col("lang").alias("path")).distinct()
    return mutations.removed_sources(p, p.where("path <> 'fr'"))


# --- reports ------------------------------------------------------------------------------------


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def stats_by_source(spark, sf_dir):
    return reporting.stats_by_source(corpus(spark, sf_dir))


@query("SELECT sum(n_chars) / 1024.0::DOUBLE / count(*) AS kb_per_image FROM documents")
def kb_per_image(spark, sf_dir):
    return reporting.kb_per_image(known(spark, sf_dir))


@query("SELECT least(count(*), 150) AS files FROM documents")
def capped_count(spark, sf_dir):
    return spark.createDataFrame([(reporting.capped_count(known(spark, sf_dir), 150),)], "files long")


@query("""SELECT count(*) AS images, count(*) FILTER (WHERE length(text) > 0) AS with_text, count(*) FILTER (WHERE doc_id % 7 = 0) AS errors, (SELECT count(*) FROM embeddings) AS embedded,
          (SELECT count(*) FROM embeddings WHERE label < 5) AS meaning_embedded FROM documents""")
def stats_totals(spark, sf_dir):
    m = made(spark, sf_dir)
    seen = images(spark, sf_dir).withColumn("status", F.when(F.col("id") % 7 == 0, "error").otherwise("ok"))
    return reporting.stats_totals(seen, m, m.where("model = 'm1'"))


@query("SELECT count(*) AS files, sum(n_chars)::BIGINT AS bytes FROM documents")
def file_count_bytes(spark, sf_dir):
    return reporting.file_count_bytes(known(spark, sf_dir))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
          SELECT event_type, n, max(value) FILTER (WHERE i = n // 2) AS median, max(value) FILTER (WHERE i = floor(n * 0.95)::BIGINT) AS p95 FROM r GROUP BY event_type, n""")
def latency_percentiles(spark, sf_dir):
    return reporting.latency_percentiles(table(spark, sf_dir, "events"))


_EVAL = """
    pairs AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY n_chars DESC, doc_id) AS pos, contains(d.text, b.text) AS answer
              FROM benchmark b JOIN documents d ON split_part(b.text, ' ', 1) = split_part(trim(d.text), ' ', 1)),
    ranks AS (SELECT item_id, min(pos) FILTER (WHERE answer) AS rank FROM pairs GROUP BY item_id)"""


def _results(spark, sf_dir) -> DataFrame:
    """Results to evaluate: for each item the documents that begin with its first word, longest first; answers hold its whole text."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("q"), F.split_part("text", F.lit(" "), F.lit(1)).alias("w"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars", F.split_part(F.trim("text"), F.lit(" "), F.lit(1)).alias("w"))
    pos = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("n_chars"), "doc_id"))
    return b.join(d, "w").select("item_id", "doc_id", pos.alias("pos"), F.contains("text", "q").alias("answer"))


@query(f"WITH {_EVAL} SELECT 'all' AS engine, count(*) AS queries, count(*) FILTER (WHERE rank = 1) AS hit1, count(*) FILTER (WHERE rank <= 5) AS hit5, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 9) AS mrr FROM ranks")
def eval_metrics(spark, sf_dir):
    ranks = reporting.first_answer(_results(spark, sf_dir), F.col("answer"), ["item_id"]).withColumn("engine", F.lit("all"))
    return reporting.eval_metrics(ranks, ["engine"])


_ASKED = "(VALUES (3), (7), (11), (42), (99)) AS a(q)"


@query(f"""WITH {_VECTORS}, l AS (SELECT vec_id AS id, label FROM embeddings),
           s AS (SELECT q, v.id, l.label = k.label AND v.id <> q AS answer, round(list_dot_product(v.v, w.v), 9) AS s FROM {_ASKED} JOIN vecs w ON w.id = q JOIN l k ON k.id = q CROSS JOIN vecs v JOIN l ON l.id = v.id),
           r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, id) AS pos FROM s)
           SELECT q, min(pos) FILTER (WHERE answer) AS rank, round(max(s) FILTER (WHERE answer), 6) AS answer, round(max(s) FILTER (WHERE pos = 1), 6) AS best, round(max(s) FILTER (WHERE pos = 10), 6) AS tenth FROM r GROUP BY q""")
def eval_raw_scores(spark, sf_dir):
    """Five vectors as queries; other vectors of the same label are their answers."""
    v = vectors(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id")
    asked = {r["id"]: (list(r["vec"]), r["label"]) for r in v.where(F.col("id").isin(3, 7, 11, 42, 99)).collect()}
    kin = spark.createDataFrame([(q, label) for q, (_, label) in asked.items()], "item long, label int")
    answers = v.select("id", "label").join(F.broadcast(kin), "label").where("id <> item").select("item", "id")  # five rows
    found = relevance.vector_ranks(v, {q: str(q) for q in asked}, lambda texts: np.array([asked[int(t)][0] for t in texts]), answers)
    return found.select(F.col("item").alias("q"), "rank", F.round("score", 6).alias("answer"), F.round("best", 6).alias("best"), F.round("tenth", 6).alias("tenth"))


def _benchmark(spark, sf_dir) -> dict[int, str]:
    """The items: a short list, searched together."""
    return {r["item_id"]: r["text"] for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()}


_ITEMS = r"""items AS (SELECT item_id AS item, text AS answer, list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda x: x <> '') AS terms FROM benchmark),
    q AS (SELECT item, answer, lower(array_to_string(terms, ' ')) AS phrase, list_transform(list_filter(terms, lambda x: length(x) >= 3), lambda x: lower(x)) AS long, list_transform(list_filter(terms, lambda x: length(x) < 3), lambda x: lower(x)) AS short FROM items)"""


def _count_sql(t: str, needle: str) -> str:
    """Occurrences, overlaps included: where the needle can overlap itself, every place is looked at."""
    plain = f"((length({t}) - length(replace({t}, {needle}, ''))) // length({needle}))"
    border = f"len(list_filter(range(1, length({needle})), lambda k: {needle}[:k] = {needle}[-k:])) > 0"
    return f"(CASE WHEN {border} THEN len(list_filter(range(1, length({t}) + 1), lambda i: substr({t}, i, length({needle})) = {needle})) ELSE {plain} END)"


_WEIGH = "ln((cnt - d + 0.5) / (d + 0.5))"
_TEXTS = f"""{_STATS}, {_ITEMS},
    found AS (SELECT item, id, phrase, long, t, n, dl, mtime, source FROM q JOIN base ON len(list_filter(long, lambda x: contains(t, x) OR contains(n, x))) = len(long) AND len(list_filter(short, lambda x: contains(t, x) OR contains(n, x))) = len(short)),
    words AS (SELECT DISTINCT unnest(long) AS w FROM q UNION SELECT phrase FROM q),
    df AS (SELECT w, (SELECT count(*) FROM base WHERE contains(t, w) OR contains(n, w)) AS d FROM words),
    per AS (SELECT item, id, mtime, dl, t, n, unnest(long) AS w, generate_subscripts(long, 1) AS k FROM found),
    parts AS (SELECT item, id, mtime, k, CASE WHEN {_WEIGH} > 0 THEN {_WEIGH} ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / av)) AS part
      FROM (SELECT per.*, {_count_sql('t', 'w')} + {_count_sql('n', 'w')} AS f, d FROM per JOIN df USING (w)), corp),
    scored AS (SELECT item, id, mtime, round(-sum(part ORDER BY k), 9) AS score FROM parts GROUP BY item, id, mtime),
    hits AS (SELECT item, id, score, row_number() OVER (PARTITION BY item ORDER BY score, mtime DESC, id) AS pos FROM scored QUALIFY pos <= {LIMIT}),
    ph AS (SELECT item, id, mtime, round(-(CASE WHEN {_WEIGH} > 0 THEN {_WEIGH} ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / av))), 9) AS score
      FROM (SELECT found.*, {_count_sql('t', 'phrase')} + {_count_sql('n', 'phrase')} AS f, d FROM found JOIN df ON w = phrase WHERE contains(t, phrase) OR contains(n, phrase)), corp),
    ex AS (SELECT item, id FROM ph QUALIFY row_number() OVER (PARTITION BY item ORDER BY score, mtime DESC, id) <= {LIMIT})"""


@query(f"""WITH {_TEXTS}, placed AS (SELECT h.item, h.id, row_number() OVER (PARTITION BY h.item ORDER BY (ex.id IS NULL)::INT, h.pos) AS pos FROM hits h LEFT JOIN ex ON ex.item = h.item AND ex.id = h.id),
    first AS (SELECT p.item, min(pos) AS rank FROM placed p JOIN q USING (item) JOIN documents d ON d.doc_id = p.id WHERE contains(d.text, q.answer) GROUP BY p.item)
    SELECT 'text' AS engine, count(*) AS queries, count(*) FILTER (WHERE rank = 1) AS hit1, count(*) FILTER (WHERE rank <= 5) AS hit5, round(coalesce(sum(1.0::DOUBLE / rank), 0) / count(*), 9) AS mrr FROM q LEFT JOIN first USING (item)""")
def eval_search_metrics(spark, sf_dir):
    """Every item searched as text in all documents; an answer holds the item's whole text."""
    items = _benchmark(spark, sf_dir)
    store = kept(spark, sf_dir)
    ranks = relevance.search_ranks(store.table("images"), store.text_index(), {k: parse(t) for k, t in items.items()}, items, LIMIT)
    return reporting.eval_metrics(ranks.withColumn("engine", F.lit("text")), ["engine"])


def _near_items(tag: str, shift: int, window: float) -> str:
    return f"""s_{tag} AS (SELECT item, v.id, list_dot_product(v.v, e.v) AS s FROM q JOIN vecs e ON e.id = (item + {shift}) % (SELECT count(*) FROM q), vecs v),
    {tag} AS (SELECT item, id, s, row_number() OVER (PARTITION BY item ORDER BY s DESC, id) AS pos FROM s_{tag} WHERE s >= {FLOOR} QUALIFY s >= max(s) OVER (PARTITION BY item) - {window} AND pos <= {LIMIT})"""


@query(f"""WITH {_TEXTS}, {_VECTORS}, {_near_items("seen", 0, 0.07)}, {_near_items("meant", 1, 0.03)},
    lists AS (SELECT item, id, pos, 0 AS l FROM hits UNION ALL SELECT item, id, pos, 1 FROM meant UNION ALL SELECT item, id, pos, 2 FROM seen),
    engines(engine, l) AS (VALUES ('text', 0), ('text and images', 0), ('text and images', 2), ('text and meaning', 0), ('text and meaning', 1), ('all', 0), ('all', 1), ('all', 2)),
    exact AS (SELECT DISTINCT engine, h.item, h.id, h.pos FROM engines, hits h JOIN ex USING (item, id)),
    ranks AS (SELECT engine, item, id, l, row_number() OVER (PARTITION BY engine, item, l ORDER BY pos) - 1 AS r FROM lists JOIN engines USING (l) WHERE (engine, item, id) NOT IN (SELECT engine, item, id FROM exact)),
    fused AS (SELECT engine, item, id, round(sum(1.0::DOUBLE / (10 + r)), 9) AS score, min(r) FILTER (WHERE l = 0) AS text_rank, min(l) AS list, arg_min(r, l * 1000000 + r) AS rank FROM ranks GROUP BY ALL),
    alls AS (SELECT engine, item, id, 0 AS block, NULL::DOUBLE AS score, pos AS a, 0 AS b, 0 AS c FROM exact UNION ALL SELECT engine, item, id, 1, score, coalesce(text_rank, 2000000000), list, rank FROM fused),
    placed AS (SELECT engine, item, id, row_number() OVER (PARTITION BY engine, item ORDER BY block, score DESC NULLS FIRST, a, b, c, id) AS pos FROM alls QUALIFY pos <= {LIMIT}),
    first AS (SELECT engine, p.item, min(pos) AS rank FROM placed p JOIN q USING (item) JOIN documents d ON d.doc_id = p.id WHERE contains(d.text, q.answer) GROUP BY ALL)
    SELECT e.engine, count(*) AS queries, count(*) FILTER (WHERE rank = 1) AS hit1, count(*) FILTER (WHERE rank <= 5) AS hit5, round(coalesce(sum(1.0::DOUBLE / rank), 0) / count(*), 6) AS mrr FROM (SELECT DISTINCT engine FROM engines) e CROSS JOIN q LEFT JOIN first f ON f.engine = e.engine AND f.item = q.item GROUP BY e.engine""")
def eval_engines(spark, sf_dir):
    """Every item searched by text, with images, with meaning and with both; an item's number names the vectors it looks like."""
    items = _benchmark(spark, sf_dir)
    store, v = kept(spark, sf_dir), vectors(spark, sf_dir)
    own = {r["id"]: list(r["vec"]) for r in v.where(F.col("id") < len(items)).select("id", "vec").collect()}
    of = lambda shift: {k: own[(k + shift) % len(items)] for k in items if (k + shift) % len(items) in own}
    ranks = relevance.engine_ranks(store.table("images"), store.text_index(), v, v, {k: parse(t) for k, t in items.items()}, of(0), of(1), items, LIMIT, floors=(FLOOR, FLOOR))
    return reporting.eval_metrics(ranks, ["engine"]).withColumn("mrr", F.round("mrr", 6))


@query()
def eval_vector_ranks(spark, sf_dir):
    """Every item against all vectors: the best answer's score and rank, the best and the tenth score."""
    items = _benchmark(spark, sf_dir)
    store = kept(spark, sf_dir)
    answers = relevance.holders(store.table("images"), store.text_index(), items)
    return relevance.vector_ranks(vectors(spark, sf_dir), items, encoders.hash_projection, answers).withColumnRenamed("item", "item_id")


@query(f"""SELECT doc_id AS id, ends_with(lower({_PATH}), (doc_id % 7) || '.png') OR ends_with(lower({_PATH}), 'c1/' || (doc_id % 50) || '.png') AS answer FROM documents""")
def eval_answer(spark, sf_dir):
    """A hit answers a query if its path ends with one of the answers, in any case."""
    answers = F.array(F.concat((F.col("id") % 7).cast("string"), F.lit(".Png")), F.concat(F.lit("C1/"), (F.col("id") % 50).cast("string"), F.lit(".png")))
    return known(spark, sf_dir).select("id", reporting.is_answer(F.col("path"), answers).alias("answer"))


@query(f"""WITH {_VECTORS}, {_near_sql("v", VISUAL_ID, 2.0)}, w AS (SELECT unnest([0.01, 0.03, 0.07, 0.2])::DOUBLE AS width)
           SELECT width, count(*) AS hits FROM w, v WHERE score >= (SELECT max(score) FROM v) - width GROUP BY width""")
def eval_window_sweep(spark, sf_dir):
    near = _near(spark, sf_dir, VISUAL_ID, 2.0)
    best = near.select(F.max("score").alias("best"))
    swept = near.withColumn("width", F.explode(F.array(*[F.lit(x) for x in (0.01, 0.03, 0.07, 0.2)])))
    return swept.join(F.broadcast(best), F.col("score") >= F.col("best") - F.col("width")).groupBy("width").agg(F.count(F.lit(1)).alias("hits"))


# --- events -------------------------------------------------------------------------------------


@query("""WITH g AS (SELECT event_type, ts, ts > lag(ts) OVER w + INTERVAL 10 MINUTE OR lag(ts) OVER w IS NULL AS starts FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
          s AS (SELECT event_type, ts, sum(starts::INT) OVER (PARTITION BY event_type ORDER BY ts) AS k FROM g)
          SELECT event_type, min(ts)::VARCHAR AS first, max(ts)::VARCHAR AS last, count(*) AS n FROM s GROUP BY event_type, k""")
def watch_debounce(spark, sf_dir):
    bursts = watch.debounce(table(spark, sf_dir, "events"), "10 minutes", ["event_type"])
    return bursts.select("event_type", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"), "n")


_EVENTS = """ev AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'created' WHEN 1 THEN 'changed' WHEN 2 THEN 'renamed' ELSE 'deleted' END AS op,
    '/a/' || event_id || CASE event_id % 3 WHEN 0 THEN '.PNG' WHEN 1 THEN '.txt' ELSE '' END AS path, '/a/old' || CASE user_id % 2 WHEN 0 THEN '.jpg' ELSE '.md' END AS old_path, event_type = 'click' AS indexed,
    event_id % 3 = 0 AS image, user_id % 2 = 0 AS was FROM events)"""


def _events(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    pick = lambda c, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (c % len(xs) + 1).cast("int"))
    path = F.concat(F.lit("/a/"), F.col("event_id").cast("string"), pick(F.col("event_id"), ".PNG", ".txt", ""))
    return e.select("event_id", pick(F.col("event_id"), "created", "changed", "renamed", "deleted").alias("op"), path.alias("path"), F.concat(F.lit("/a/old"), pick(F.col("user_id"), ".jpg", ".md")).alias("old_path"), (F.col("event_type") == "click").alias("indexed"))


@query(f"""WITH {_EVENTS} SELECT event_id, CASE WHEN op = 'renamed' THEN CASE WHEN NOT image AND NOT was THEN CASE WHEN indexed THEN 'move' ELSE 'ignore' END WHEN NOT image THEN 'forget' WHEN indexed THEN 'move' ELSE 'index' END
           WHEN op = 'deleted' THEN CASE WHEN image OR event_id % 3 = 2 THEN 'forget' ELSE 'ignore' END WHEN image THEN 'index' ELSE 'ignore' END AS action FROM ev""")
def watch_rename_action(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.select("event_id", bursts.rename_action(F.col("op"), F.col("path"), F.col("old_path"), F.col("indexed")).alias("action"))


@query(f"WITH {_EVENTS} SELECT event_id, path FROM ev WHERE image")
def ext_filter(spark, sf_dir):
    return ingest.extension_filter(_events(spark, sf_dir)).select("event_id", "path")


@query(r"""WITH p AS (SELECT doc_id AS id, '  ' || lower('title: none | text: ' || trim(regexp_replace(text, '[ \n\r\t]+', ' ', 'g'))) || ' ' AS t FROM documents),
           r AS (SELECT id, substr(t, unnest(range(1, length(t) - 1)), 3) AS run FROM p), h AS (SELECT id, run, md5(run) AS m, count(*) AS n FROM r GROUP BY id, run),
           d AS (SELECT id, ('0x' || substr(m, 1, 2))::INT % 64 AS axis, sum(CASE WHEN ('0x' || substr(m, 3, 2))::INT % 2 = 1 THEN n ELSE -n END)::DOUBLE AS x FROM h GROUP BY id, axis),
           l AS (SELECT id, sqrt(sum(x * x)) AS l FROM d GROUP BY id)
           SELECT id, count(*) FILTER (WHERE x <> 0) AS axes, round(max(x / l), 4) AS largest, round(sum(axis * x / l), 3) AS moment FROM d JOIN l USING (id) GROUP BY id""")
def encoder_stub(spark, sf_dir):
    """Vectors of the stub encoder, as a few numbers each."""
    vec = corpus(spark, sf_dir).select("id", encoders.encode_column(T.doc_prompt(F.col("text"))).alias("vec"))
    axes = F.size(F.filter("vec", lambda x: x != 0)).cast("long")
    moment = F.aggregate(F.transform("vec", lambda x, i: x.cast("double") * i), F.lit(0.0), lambda s, x: s + x)
    return vec.select("id", axes.alias("axes"), F.round(F.array_max("vec").cast("double"), 4).alias("largest"), F.round(moment, 3).alias("moment"))


@query("""WITH e AS (SELECT *, CASE event_id % 4 WHEN 0 THEN 'created' WHEN 1 THEN 'changed' WHEN 2 THEN 'renamed' ELSE 'deleted' END AS op, '/a/' || event_id % 211 || CASE event_id % 3 WHEN 0 THEN '.txt' ELSE '.PNG' END AS path, '/a/' || user_id % 211 || '.PNG' AS old_path FROM events),
          m AS (SELECT path, event_type AS source, event_id * 4 + event_id % 4 AS place, true AS here FROM e WHERE op <> 'deleted' AND path LIKE '%.PNG'
            UNION ALL SELECT path, event_type, event_id * 4 + 3, false FROM e WHERE op = 'deleted' UNION ALL SELECT old_path, event_type, event_id * 4 + 2, false FROM e WHERE op = 'renamed')
          SELECT path, arg_max(source, place) AS source FROM m GROUP BY path HAVING arg_max(here, place)""")
def watch_plan(spark, sf_dir):
    """What is left to index after a burst.  An event that renames a file to itself doesn't occur here."""
    e = _events(spark, sf_dir).drop("path", "old_path").join(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", F.col("event_type").alias("source")), "event_id")
    path = F.concat(F.lit("/a/"), (F.col("event_id") % 211).cast("string"), F.when(F.col("event_id") % 3 == 0, ".txt").otherwise(".PNG"))
    return watch.still_pending(e.withColumns({"path": path, "old_path": F.concat(F.lit("/a/"), (F.col("user_id") % 211).cast("string"), F.lit(".PNG"))}))


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS g, min(CASE WHEN event_id % 397 = 0 THEN ts END) OVER (PARTITION BY user_id) AS cut FROM events),
          l AS (SELECT user_id, max(g) FILTER (WHERE cut IS NULL OR ts < cut) AS g, any_value(cut) IS NOT NULL AS gone, arg_max(event_type, ts) FILTER (WHERE cut IS NULL OR ts < cut) AS source FROM e GROUP BY user_id)
          SELECT user_id AS id, CASE WHEN NOT gone THEN '/a/u' || user_id || '-' || g || '.png' END AS path, CASE WHEN NOT gone THEN source END AS source, gone FROM l""")
def burst_resolved(spark, sf_dir):
    """Every event renames a user's file to the next number, some delete it: long chains of renames, resolved as tables."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("source"))
    g = F.row_number().over(Window.partitionBy("user_id").orderBy("ts"))
    name = lambda n: F.concat(F.lit("/a/u"), F.col("user_id").cast("string"), F.lit("-"), n.cast("string"), F.lit(".png"))
    e = e.withColumn("_g", g)
    dies = F.col("event_id") % 397 == 0
    events = e.select("ts", F.when(dies, "deleted").otherwise("renamed").alias("op"), F.when(dies, name(F.col("_g") - 1)).otherwise(name(F.col("_g"))).alias("path"), F.when(~dies, name(F.col("_g") - 1)).alias("old_path"), "source")
    users = e.select("user_id").distinct().select(F.col("user_id").cast("long").alias("id"), name(F.lit(0)).alias("path"), F.lit("first").alias("source"))
    ends, _ = bursts.resolve(users, bursts.numbered(events))
    return ends.select("id", F.when(~F.col("gone"), F.col("path")).alias("path"), F.when(~F.col("gone"), F.col("source")).alias("source"), "gone")


@query("SELECT user_id::VARCHAR AS path, arg_max(event_type, event_id) AS source FROM events GROUP BY user_id")
def watch_pending(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("source"), "ts")
    return watch.pending(e).select("path", "source")


for _name in ("text_search_", "l2_normalize_"):
    QUERIES[_name[:-1]], ORACLES[_name[:-1]] = QUERIES.pop(_name), ORACLES.pop(_name)
