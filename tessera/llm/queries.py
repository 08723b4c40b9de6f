"""The queries on the operators of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, collocations, exact, licenses, mixing, ngram_join, packing, pii, pivots, quality, shards, substrings, urls


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, sf_dir, "documents"))[0].select("doc_id", "size", "source_size", "target", "taken", "source")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), added=True).drop("ids")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(_read(spark, sf_dir, "embeddings"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard(_read(spark, sf_dir, "documents"), width=3, percent=90)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summarise(pii.find_personal_data(_read(spark, sf_dir, "documents")))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicate_groups(_read(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(_read(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_dedup(_read(spark, sf_dir, "documents"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_read(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(_read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_url_filter, op2_mixing, op3_packing, op4_quality, op5_near_vectors, op6_ngram_join, op7_pii, op8_exact_dedup, op9_sharding, op10_substring_dedup, op11_license_scan, op12_collocations, op13_centroids)
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Smallest id reachable by links: needs CTEs nodes (id) and links (a, b), both directions.
_REACH = """reach AS (SELECT id, id AS r FROM nodes UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r),
        roots AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)"""

_RULES = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in urls.RULES)
_QUOTED = {k: v.replace("'", "''") for k, v in (("link", urls.LINK), ("base", urls.BASE), ("relative", urls.RELATIVE))}
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TEMPLATES = ", ".join(f"({k}, '{t.label}', {str(t.phrase).lower()}, string_split('{t.text}', ' '), {licenses.slack_of(t)}, {licenses.votes_needed(t, licenses.LEAST)})" for k, t in enumerate(licenses.TEMPLATES))
_FAR = "list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"


def _lloyd(rounds: int) -> str:
    """CTEs c0, a0, c1, a1 ...: centroids and the vectors they get, round by round."""
    out = [f"a0 AS MATERIALIZED (SELECT i, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.i, c.c, {_FAR} AS d FROM v, c0 c) GROUP BY i)"]
    for r in range(1, rounds + 1):
        sums = f"SELECT c, generate_subscripts(v.v, 1) AS k, unnest(v.v) AS x FROM a{r - 1} a JOIN v USING (i)"
        moved = "SELECT c, list_transform(list_sort(list({'k': k, 's': s, 'n': n})), lambda x: ((x.s - ((x.s % x.n) + x.n) % x.n) // x.n)::BIGINT) AS v FROM (SELECT c, k, sum(x) AS s, count(*) AS n FROM (" + sums + ") GROUP BY c, k) GROUP BY c"
        out.append(f"c{r} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{r - 1} o LEFT JOIN ({moved}) m USING (c))")
        out.append(f"a{r} AS MATERIALIZED (SELECT i, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.i, c.c, {_FAR} AS d FROM v, c{r} c) GROUP BY i)")
    return ", ".join(out)


ORACLES: dict[str, str] = {
    "op11_license_scan": rf"""
        WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        t(k, label, phrase, t, slack, need) AS (VALUES {_TEMPLATES}),
        tg AS (SELECT k, slack, need, unnest(range(1, len(t) - 1)) AS p, array_to_string(t[p:p + 2], ' ') AS g FROM t),
        dg AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, array_to_string(w[i:i + 2], ' ') AS g FROM w),
        hits AS (SELECT doc_id, k, slack, need, i - p AS d, p FROM dg JOIN tg USING (g)),
        lines AS (SELECT DISTINCT doc_id, k, slack, d FROM hits),
        cuts AS (SELECT *, coalesce(d - lag(d) OVER (PARTITION BY doc_id, k ORDER BY d) > slack, false)::INT AS cut FROM lines),
        spans AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id, k ORDER BY d) AS s FROM cuts),
        voted AS (SELECT doc_id, k, s FROM hits JOIN spans USING (doc_id, k, d) GROUP BY doc_id, k, s, need HAVING count(DISTINCT p) >= need),
        places AS (SELECT k, label, phrase, len(t) AS n, unnest(range(1, len(t) + 1)) AS p, t[p] AS word FROM t),
        held AS (SELECT doc_id, k, s, label, phrase, n, count(DISTINCT p) AS m, min(d + p) - 1 AS first FROM voted JOIN spans USING (doc_id, k, s) JOIN places USING (k) JOIN w USING (doc_id) WHERE d + p >= 1 AND w[d + p] = word GROUP BY ALL),
        good AS (SELECT * FROM held WHERE m >= n * CASE WHEN phrase THEN 1 ELSE {licenses.LEAST} END - 1e-9)
        SELECT w.doc_id, any_value(len(w)) AS n_words, count(*) FILTER (WHERE phrase) AS n_base, min(first) FILTER (WHERE phrase) AS first_word, max(first) FILTER (WHERE phrase) AS last_word,
            coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE phrase)), ','), '') AS base_labels, coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE label IS NOT NULL)), ','), '') AS labels,
            round(coalesce(max(m::DOUBLE / n), 0), 6) AS score FROM w LEFT JOIN good USING (doc_id) GROUP BY w.doc_id""",
    "op12_collocations": rf"""
        WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, 'und') AS lang, {_LOWER.format("coalesce(text, '')")} AS t FROM documents),
        p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS t FROM d),
        w AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM p),
        n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
        g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM w, (VALUES (1), (2), (3)) ks(k)),
        f AS (SELECT lang, k, s, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= {collocations.LEAST}),
        cuts AS (SELECT lang, k, s, a, unnest(range(1, k)) AS cut, string_split(s, ' ') AS l FROM f WHERE k > 1),
        scored AS (SELECT c.lang, c.k, c.s, c.a, cut, x.a AS l, y.a AS r, ((1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a))::BIGINT AS score FROM cuts c
            JOIN f x ON x.lang = c.lang AND x.s = array_to_string(c.l[:cut], ' ') JOIN f y ON y.lang = c.lang AND y.s = array_to_string(c.l[cut + 1:], ' ')),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, s ORDER BY score, cut) = 1),
        inner_ AS (SELECT lang, s, max(a) AS a FROM (SELECT lang, a, unnest([array_to_string(string_split(s, ' ')[:2], ' '), array_to_string(string_split(s, ' ')[2:], ' ')]) AS s FROM f WHERE k = 3) GROUP BY ALL),
        left_ AS (SELECT b.* FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.s = b.s WHERE i.a IS NULL OR 100 * i.a < {collocations.INSIDE} * b.a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, s) AS rank, s AS phrase, a, l, r, n, score FROM left_ JOIN n USING (lang) QUALIFY rank <= {collocations.TOP}""",
    "op13_centroids": f"""
        WITH v AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v FROM v ORDER BY sha256('3:' || vec_id) LIMIT 8),
        {_lloyd(centroids.ROUNDS)}, own AS (SELECT c, sum(d)::BIGINT AS s FROM a{centroids.ROUNDS} GROUP BY c)
        SELECT vec_id, c::INT AS cluster, d AS distance, own.s AS cluster_inertia, (SELECT sum(s)::BIGINT FROM own) AS inertia, sha256(array_to_string(o.v, ',')) AS centroid_sha256
        FROM a{centroids.ROUNDS} JOIN v USING (i) JOIN own USING (c) JOIN c{centroids.ROUNDS} o USING (c)""",
    "op1_url_filter": f"""
        WITH RECURSIVE u AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, html, {_LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        rules(v, rule, name, begins) AS (VALUES {_RULES}),
        ruled AS (SELECT page_id, host, path, arg_max(v, length(rule)) AS v, arg_max(rule, length(rule)) AS rule FROM p LEFT JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, begins) GROUP BY page_id, host, path),
        hosts AS (SELECT host AS h, avg((coalesce(v, '') = 'allow')::INT) AS good, avg((coalesce(v, '') = 'block')::INT) AS bad FROM ruled WHERE host <> '' GROUP BY host),
        based AS (SELECT host, {_LOWER.format(f"regexp_extract(html, '{_QUOTED['base']}', 1)")} AS base, len(regexp_extract_all(html, '{_QUOTED['relative']}', 1)) AS n FROM p WHERE html IS NOT NULL),
        labels_ AS (SELECT string_split(h, '.') AS l FROM hosts WHERE length(h) <= 253 AND regexp_matches(h, '\\.[a-z][a-z0-9-]*$')),
        steps AS (SELECT l, unnest(range(1, len(l) - 1)) AS i FROM labels_ WHERE len(l) > 2),
        kin AS (SELECT DISTINCT array_to_string(l[i:], '.') AS c, array_to_string(l[i + 1:], '.') AS p FROM steps),
        named AS (SELECT host AS src, {_LOWER.format(f"unnest(regexp_extract_all(html, '{_QUOTED['link']}', 1))")} AS dst, 1 AS n FROM p WHERE html IS NOT NULL
            UNION ALL SELECT host, base, n FROM based WHERE base <> '' AND n > 0 UNION ALL SELECT c, p, 1 FROM kin UNION ALL SELECT p, c, 1 FROM kin),
        links AS (SELECT src, dst, sum(n)::DOUBLE AS n FROM named WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY src, dst),
        nodes AS (SELECT h, sum(good) AS good, sum(bad) AS bad FROM (SELECT * FROM hosts UNION ALL SELECT src, 0, 0 FROM links UNION ALL SELECT dst, 0, 0 FROM links) GROUP BY h),
        all_ AS (SELECT count(*)::DOUBLE AS n, sum(good) AS good, sum(bad) AS bad FROM nodes),
        seeds AS (SELECT h, CASE WHEN a.good > 0 THEN nodes.good * a.n / a.good * 0.15 ELSE 0 END::DOUBLE AS t, CASE WHEN a.bad > 0 THEN nodes.bad * a.n / a.bad * 0.15 ELSE 0 END::DOUBLE AS d FROM nodes, all_ a),
        edges AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS g, 0::DOUBLE AS b FROM links UNION ALL SELECT dst, src, 0, n / sum(n) OVER (PARTITION BY dst) FROM links UNION ALL SELECT h, h, 0, 0 FROM nodes),
        turns AS (SELECT 0 AS i, h, t, d FROM seeds UNION ALL
            SELECT turns.i + 1, e.dst, any_value(s.t) + 0.85 * sum(turns.t * e.g), any_value(s.d) + 0.85 * sum(turns.d * e.b) FROM turns JOIN edges e ON e.src = turns.h JOIN seeds s ON s.h = e.dst WHERE turns.i < {urls.rounds_for(0.85, 0.01)} GROUP BY turns.i + 1, e.dst),
        last AS (SELECT h, t, d FROM turns WHERE i = {urls.rounds_for(0.85, 0.01)}),
        scores AS (SELECT h, CASE WHEN a.t > 0 THEN last.t * a.n / a.t ELSE 0 END AS t, CASE WHEN a.d > 0 THEN last.d * a.n / a.d ELSE 0 END AS d FROM last, (SELECT sum(t) AS t, sum(d) AS d, count(*) AS n FROM last) a)
        SELECT page_id, host, path, rule, coalesce(v, CASE WHEN d >= {urls.THRESHOLD} AND d > t THEN 'block' ELSE 'allow' END) AS verdict FROM ruled LEFT JOIN scores ON scores.h = ruled.host""",
    "op5_near_vectors": f"""
        WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
        nodes AS (SELECT id FROM v),
        links AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id <> b.id AND list_dot_product(a.v, b.v) >= 0.95 * a.n * b.n),
        {_REACH}
        SELECT r.id AS vec_id, (SELECT count(*) FROM links WHERE a = r.id) AS n_links, component_id, component_id = r.id AS kept FROM roots r""",
    "op6_ngram_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id AS id, {_WORDS.replace("coalesce(text, '')", _FOLD.format("coalesce(text, '')"))} AS w FROM documents),
        s AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
        n AS (SELECT w.id, count(s.s) AS n FROM w LEFT JOIN s ON s.id = w.id GROUP BY w.id),
        both_ AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.id <> b.id GROUP BY a.id, b.id),
        nodes AS (SELECT id FROM n),
        links AS (SELECT a, b FROM both_ JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
        {_REACH}
        SELECT n.id AS doc_id, n.n AS n_shingles, component_id FROM n JOIN roots ON roots.id = n.id""",
    "op10_substring_dedup": f"""
        WITH w AS (SELECT doc_id AS id, {_WORDS} AS w FROM documents),
        starts AS (SELECT id, unnest(range(1, len(w) - 48)) AS i, w FROM w WHERE len(w) >= 50),
        win AS (SELECT id, i, array_to_string(w[i:i + 49], ' ') AS t FROM starts),
        least AS (SELECT id, i, min(id) OVER (PARTITION BY t) AS first FROM win),
        gone AS (SELECT DISTINCT id, unnest(range(i, i + 50)) AS i FROM least WHERE first < id),
        words AS (SELECT id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
        kept AS (SELECT words.id, count(gone.i) AS n_removed, string_agg(word, ' ' ORDER BY words.i) FILTER (WHERE gone.i IS NULL) AS t FROM words LEFT JOIN gone USING (id, i) GROUP BY words.id)
        SELECT w.id AS doc_id, len(w.w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.id = w.id""",
    "op8_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
        g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.body) AS text_sha256
        FROM t JOIN g ON t.body = g.body""",
}
