"""URL filters: expressions of host suffixes and path prefixes, joined to rules by hash prefix.

Native: DataFrame functions only.

* ``expand`` turns a URL into (host suffix, path prefix) expressions: the suffixes of the host
  that have as many labels as some rule's host, and the path prefixes whose lengths occur among the rules.
* Expressions and rules meet in an equi-join on the first four bytes of SHA-256; the full digest
  is confirmed afterwards.  The rule table is broadcast only if its counted size is small.
* The longest rule wins (longer host, then longer path, then ``block``), else the default.

Defined cases: a null or empty URL or one without ``://`` has an empty host and path and gets the default
verdict; rows that repeat are judged once and come back as often as they came; rows of one page_id with different URLs are judged
each; a null page_id stays null; very long URLs are judged whole (host and path are expanded only at the depths and lengths that rules have); of equally long rules the one of the longer host counts, then block; other columns are
ignored; an empty table gives no rows; an empty rule table leaves the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm.common import maybe_broadcast, table

#: (action, host, path)
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
DEFAULT_VERDICT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path), 256)


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    df = spark.createDataFrame([tuple(r) for r in rules], "action string, rhost string, rpath string").distinct()
    d = _digest(F.col("rhost"), F.col("rpath"))
    return df.select(
        "action", "rhost", "rpath", d.alias("rdigest"), F.substring(d, 1, 8).alias("short"),
        F.concat("rhost", "rpath").alias("rule"),
    )


def expand(urls: DataFrame, lengths: list[int], depths: list[int]) -> DataFrame:
    """Adds one row for each expression: columns xhost, xpath, digest, short; depths: numbers of labels of rules' hosts."""
    urls = urls.withColumn("_labels", F.split("host", r"\.", -1))
    labels, n = F.col("_labels"), F.size("_labels")
    deep = F.filter(F.array(*[F.lit(k) for k in depths]).cast("array<int>"), lambda k: k <= n)
    hosts = F.transform(deep, lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))
    fit = F.filter(F.array(*[F.lit(k) for k in lengths]).cast("array<int>"), lambda k: k <= F.length("path"))
    exprs = F.flatten(
        F.transform(hosts, lambda h: F.transform(fit, lambda k: F.struct(h.alias("xhost"), F.substring(F.col("path"), F.lit(1), k).alias("xpath"))))
    )
    out = urls.withColumn("x", F.explode_outer(exprs)).select("*", "x.xhost", "x.xpath").drop("x", "_labels")
    d = _digest(F.col("xhost"), F.col("xpath"))
    return out.withColumn("digest", d).withColumn("short", F.substring(d, 1, 8))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages (page_id, url)."""
    stats = rules.agg(F.count("*"), F.collect_set(F.length("rpath")), F.collect_set(F.size(F.split("rhost", r"\.", -1)))).first()
    n_rules, lengths, depths = stats[0], sorted(stats[1]), sorted(stats[2])
    # A fixed number of tasks: by their bytes alone the rows would be gathered into few, but each becomes many expressions.
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    urls = pages.groupBy("page_id", "url").agg(F.count("*").alias("copies")).repartition(tasks, "page_id", "url")
    urls = urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    x = expand(urls, lengths, depths)
    r = maybe_broadcast(rules, n_rules, 512)
    hit = x.join(r, "short", "left")
    same = (F.col("digest") == F.col("rdigest")) & (F.col("xhost") == F.col("rhost")) & (F.col("xpath") == F.col("rpath"))
    best = F.max(
        F.when(same, F.struct(F.length("rule"), F.length("rhost"), (F.col("action") == "block").alias("b"), F.col("rule").alias("rule"), F.col("action").alias("action")))
    ).alias("best")
    judged = hit.groupBy("page_id", "url", "copies", "host", "path").agg(best)
    return judged.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"),
    ).drop("_copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules_frame(spark))


ORACLE = r"""
with u as (
  select page_id, case when position('://' in coalesce(url, '')) = 0 then ''
                       else substr(url, position('://' in url) + 3) end as rest
  from pages
), p as (
  select page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path,
         row_number() over () as rid
  from u
), rules(action, rhost, rpath) as (
  values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), hits as (
  select p.rid, action, rhost || rpath as rule,
         row_number() over (partition by p.rid order by length(rhost || rpath) desc, length(rhost) desc, action desc) as rn
  from p join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
)
select p.page_id, p.host, p.path, h.rule, coalesce(h.action, 'allow') as verdict
from p left join hits h on h.rid = p.rid and h.rn = 1
"""
