"""URL verdicts: rules on hosts and paths, and trust that spreads over links between hosts.  DataFrame operations only."""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import park

#: (verdict, rule): a host with all its subdomains, and the beginning of a path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST_PATH = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Hosts that a page names, the host of its base, and its relative links.
LINK = r"(?i)(?:\b[a-z][a-z0-9+.-]*:|\b(?:href|src|action)\s*=\s*[\"']?)//([^/?#\s\"'<>]+)"
BASE = r"(?i)<base\s[^>]*?\bhref\s*=\s*[\"']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#\s\"'<>]+)"
RELATIVE = r"(?i)\b(?:href|src|action)\s*=\s*[\"']?(/?[^/#:?\s\"'<>][^:\s\"'<>]*)[\s\"'>]"
#: Distrust from which a host is blocked, as a multiple of the mean; edges of a host that stay together.
THRESHOLD, HUB = 2.0, 10_000
#: Edges of a partition, where the session's number of partitions allows so few.
EDGES = 200_000


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, HOST_PATH, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, HOST_PATH, 2), F.lit(""))


def _fits(rule: str, host: Column, path: Column) -> Column:
    name, slash, rest = rule.partition("/")
    return ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)


def match_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (verdict, rule) of the longest rule that fits, else null; of equally long ones the first listed."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        out = F.when(_fits(rule, host, path), F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """(_src, _dst, _n): links between different hosts, summed before anything is joined; ``pages`` has _host and _html.

    A link is what names a host after ``scheme://`` anywhere in the page (attributes, canonical links, plain
    addresses in text) or after ``//`` at the beginning of an attribute's value.  Relative links stay on
    their host and are no edges, unless the page has a base on another host, which each of them then counts for.
    """
    named = F.transform(F.regexp_extract_all("_html", F.lit(LINK), F.lit(1)), lambda x: F.translate(x, UPPER, LOWER))
    base = F.translate(F.regexp_extract("_html", BASE, 1), UPPER, LOWER)
    seen = pages.select("_host", named.alias("_to"), F.when(base != "", base).alias("_base"), F.when(base != "", F.size(F.regexp_extract_all("_html", F.lit(RELATIVE), F.lit(1)))).alias("_many"))
    one = seen.select(F.col("_host").alias("_src"), F.explode("_to").alias("_dst"), F.lit(1).cast("long").alias("_n"))
    based = seen.where("_base IS NOT NULL").select(F.col("_host").alias("_src"), F.col("_base").alias("_dst"), F.col("_many").cast("long").alias("_n"))
    links = one.unionByName(based)
    return links.where((F.col("_src") != F.col("_dst")) & (F.col("_src") != "") & (F.col("_dst") != "") & (F.col("_n") > 0)).groupBy("_src", "_dst").agg(F.sum("_n").alias("_n"))


def kinship(hosts: DataFrame) -> DataFrame:
    """(_src, _dst, _n): a host and its parent domain (the name without its first label, while two remain) link to each other once.

    ``hosts`` has _h.  Parents have parents in turn.  Only names as the name system allows have kin: 253
    characters at most, the last label beginning with a letter, so addresses in digits have none.
    """
    named = hosts.where((F.length("_h") <= 253) & F.col("_h").rlike(r"\.[a-z][a-z0-9-]*$")).select(F.split("_h", r"\.").alias("_l"))
    steps = named.where(F.size("_l") > 2).select("_l", F.explode(F.sequence(F.lit(1), F.size("_l") - 2)).alias("_i"))
    name = lambda i: F.array_join(F.slice("_l", i, F.size("_l")), ".")
    kin = steps.select(name(F.col("_i")).alias("_c"), name(F.col("_i") + 1).alias("_p")).distinct()
    one = F.lit(1).cast("long").alias("_n")
    return kin.select(F.col("_c").alias("_src"), F.col("_p").alias("_dst"), one).union(kin.select(F.col("_p").alias("_src"), F.col("_c").alias("_dst"), one))


def rounds_for(damping: float, tolerance: float) -> int:
    """Rounds after which less than ``tolerance`` of the seeds' mass is still under way, on any graph: each leaves ``damping`` of it."""
    return max(1, math.ceil(math.log(tolerance) / math.log(damping)))


def spread(hosts: DataFrame, links: DataFrame, damping: float = 0.85, tolerance: float = 0.01, hub: int = HUB, stride: int = 5) -> DataFrame:
    """(_h, _trust, _distrust) of every host: personalised PageRank from trusted seeds along links, and from blocked seeds against them.

    ``hosts`` has _h, _good and _bad, the seeds' weights (0 where none).  Scores are multiples of the mean:
    each vector is normalised to a sum of the number of hosts, so a threshold means the same on a graph of any
    size.  The number of rounds follows from ``damping`` and ``tolerance`` alone: what is not spread by then is less than
    ``tolerance`` of all.  Edges are dealt out once, by host, a host with more than ``hub`` edges in parts; a round
    shuffles only scores and sums.  Scores are parked every ``stride`` rounds, so lineage stays short and a lost
    executor costs some rounds.
    """
    # Parked, so that a hub's edges meet its sum in a plain join, which Spark can split.
    out = park(links.groupBy(F.col("_src").alias("_k")).agg(F.sum("_n").alias("_all")))
    into = park(links.groupBy(F.col("_dst").alias("_k")).agg(F.sum("_n").alias("_all")))
    along = links.join(out, F.col("_src") == F.col("_k")).select(F.col("_src").alias("_from"), F.col("_dst").alias("_to"), (F.col("_n") / F.col("_all")).alias("_good_w"), F.lit(0.0).alias("_bad_w"))
    back = links.join(into, F.col("_dst") == F.col("_k")).select(F.col("_dst").alias("_from"), F.col("_src").alias("_to"), F.lit(0.0).alias("_good_w"), (F.col("_n") / F.col("_all")).alias("_bad_w"))
    summed = park(along.unionByName(back).groupBy("_from", "_to").agg(F.sum("_good_w").alias("_good_w"), F.sum("_bad_w").alias("_bad_w")))
    ends = summed.select(F.col("_to").alias("_h"), F.lit(0.0).alias("_good"), F.lit(0.0).alias("_bad"), F.lit(0).cast("long").alias("_edges"))
    starts = summed.select(F.col("_from").alias("_h"), F.lit(0.0).alias("_good"), F.lit(0.0).alias("_bad"), F.lit(1).cast("long").alias("_edges"))
    own = hosts.select("_h", "_good", "_bad", F.lit(0).cast("long").alias("_edges"))
    nodes = own.unionByName(ends).unionByName(starts).groupBy("_h").agg(F.sum("_good").alias("_good"), F.sum("_bad").alias("_bad"), F.greatest(F.lit(1), F.ceil(F.sum("_edges") / hub)).cast("long").alias("_cuts"))
    nodes = park(nodes)
    good, bad, n = nodes.agg(F.sum("_good"), F.sum("_bad"), F.count(F.lit(1))).first()
    per = lambda c, total: (F.col(c) * (float(n) / total if total else 0.0) * (1 - damping)).alias("_trust" if c == "_good" else "_distrust")
    start = nodes.select("_h", per("_good", good), per("_bad", bad), "_cuts")
    edges = summed.join(nodes.select(F.col("_h").alias("_k"), "_cuts"), F.col("_from") == F.col("_k")).select("_from", F.pmod(F.xxhash64("_to"), F.col("_cuts")).alias("_part"), "_to", (F.col("_good_w") * damping).alias("_good_w"), (F.col("_bad_w") * damping).alias("_bad_w"))
    most = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = edges.repartition(max(1, min(most, -(-summed.count() // EDGES))), "_from", "_part").persist(StorageLevel.DISK_ONLY)
    now = start
    rounds = rounds_for(damping, tolerance)
    for turn in range(rounds):
        sent = now.select(F.col("_h").alias("_from"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_cuts") - 1)).alias("_part"), "_trust", "_distrust")
        sent = edges.join(sent, ["_from", "_part"]).select(F.col("_to").alias("_h"), (F.col("_trust") * F.col("_good_w")).alias("_trust"), (F.col("_distrust") * F.col("_bad_w")).alias("_distrust"), F.lit(0).cast("long").alias("_cuts"))
        now = sent.unionByName(start).groupBy("_h").agg(F.sum("_trust").alias("_trust"), F.sum("_distrust").alias("_distrust"), F.max("_cuts").alias("_cuts"))
        if (turn + 1) % stride == 0 or turn + 1 == rounds:
            now = park(now)
    edges.unpersist()
    # A host without links gives its mass to no one: what is lost so is made up by the sum.
    trust, distrust = now.agg(F.sum("_trust"), F.sum("_distrust")).first()
    return now.select("_h", (F.col("_trust") * (float(n) / trust if trust else 0.0)).alias("_trust"), (F.col("_distrust") * (float(n) / distrust if distrust else 0.0)).alias("_distrust"))


def judge_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url: str = "url", html: str = "html", damping: float = 0.85, threshold: float = THRESHOLD, hub: int = HUB) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, trust, distrust.

    A rule decides where one fits.  Else the page's host is blocked if its distrust is at least
    ``threshold`` times the mean of all hosts and above its trust, and allowed otherwise.  A host's seeds
    are the shares of its pages that rules allow and block; edges are links between hosts and kinship (a
    host and its parent domain).  A null url, or one without ``://``, has empty host and path and is
    allowed unless a rule fits; null html has no links, and very long html is searched whole.  Repeated
    rows are judged alike; an empty table gives none.  Hosts of any size are summed before joining.
    """
    read = pages.select(F.col(id_col).alias("_page"), F.col(url).cast("string").alias("_url"), F.col(html).cast("string").alias("_html"))
    named = read.select("_page", host_of(F.col("_url")).alias("_host"), path_of(F.col("_url")).alias("_path"), "_html")
    ruled = named.select("_page", "_host", "_path", match_rule(F.col("_host"), F.col("_path"), rules).alias("_hit"))
    share = lambda verdict: F.avg(F.when(F.col("_hit.verdict") == verdict, 1.0).otherwise(0.0))
    hosts = park(ruled.where("_host != ''").groupBy(F.col("_host").alias("_h")).agg(share("allow").alias("_good"), share("block").alias("_bad")))
    links = park(host_links(named).unionByName(kinship(hosts)).groupBy("_src", "_dst").agg(F.sum("_n").alias("_n")))
    # Parked, the scores have a known size: few hosts are broadcast, many are merged.
    scores = park(spread(hosts, links, damping, hub=hub))
    joined = ruled.join(scores, F.col("_host") == F.col("_h"), "left")
    trust, distrust = F.coalesce("_trust", F.lit(0.0)), F.coalesce("_distrust", F.lit(0.0))
    by_method = F.when((distrust >= threshold) & (distrust > trust), F.lit("block")).otherwise(F.lit("allow"))
    return joined.select(F.col("_page").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_hit.rule").alias("rule"), F.coalesce(F.col("_hit.verdict"), by_method).alias("verdict"), F.round(trust, 9).alias("trust"), F.round(distrust, 9).alias("distrust"))
