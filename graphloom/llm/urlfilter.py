"""URL filtering against dated lists, with DataFrame functions only.

List entries are events: on a date, a list adds or removes a pattern. A window over each pattern turns them into validity
intervals (``starts`` inclusive, ``ends`` exclusive). A capture is looked up under the keys it can match - its address, its
host, and each domain above it - by an equi-join on the key whose residual keeps the entries active at its fetch time: an
as-of join. Where the list is small enough by Spark's own size estimate it is broadcast; otherwise both sides are shuffled
by key, and a host with a third of all captures is a skewed key that adaptive execution splits.

Kinds of pattern: ``url`` (host and path, without scheme, port, query and fragment), ``host`` (that host only), ``domain``
(the host and all below it).

Defined results
---------------
* null or unparsable URL, or a null fetch time: matches nothing, is not blocked;
* entries with a null field or an unknown action are ignored; on one date a removal comes before an addition; an addition
  of what is already listed, or a removal of what is not, changes nothing;
* captures that are equal in id, URL and fetch time are reported once; an empty table gives an empty result;
* other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm import common

#: Scheme, user, host, port, path.
URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?([^?#]*)"
FOREVER = "9999-12-31"


def host_of(url: Column) -> Column:
    return F.nullif(F.rtrim(F.lower(F.regexp_extract(url, URL, 1)), F.lit(".")), F.lit(""))


def address_of(url: Column) -> Column:
    return F.concat(host_of(url), F.regexp_replace(F.regexp_extract(url, URL, 2), "/+$", ""))


def intervals(entries: DataFrame) -> DataFrame:
    """``list, kind, pattern, starts, ends`` from entries ``list, kind, pattern, action, dated``."""
    known = entries.filter("action in ('add', 'remove')").dropna(subset=["list", "kind", "pattern", "dated"])
    days = known.groupBy("list", "kind", "pattern", "dated").agg(F.max((F.col("action") == "add").cast("int")).alias("_on"))
    order = Window.partitionBy("list", "kind", "pattern").orderBy("dated")
    turns = days.withColumn("_was", F.lag("_on", 1, 0).over(order)).filter("_on <> _was")
    turns = turns.withColumn("ends", F.lead("dated").over(order)).filter("_on = 1")
    return turns.select("list", "kind", "pattern", F.col("dated").alias("starts"), F.coalesce("ends", F.lit(FOREVER).cast("date")).alias("ends"))


def keys_of(url: Column) -> Column:
    """The ``(kind, pattern)`` pairs under which a URL may be listed."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    own = F.array(F.struct(F.lit("url").alias("kind"), address_of(url).alias("pattern")), F.struct(F.lit("host").alias("kind"), host.alias("pattern")))
    return F.when(host.isNotNull(), F.concat(own, above))


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``page_id, url, fetched, host, n_active, lists, blocked`` of each capture ``page_id, url, fetched``."""
    captures = captures.select("page_id", "url", "fetched")
    rows = captures.select("*", F.explode(keys_of(F.col("url"))).alias("_key")).select("page_id", "url", "fetched", "_key.kind", "_key.pattern")
    active = (F.col("fetched") >= F.col("starts")) & (F.col("fetched") < F.col("ends"))
    listed = intervals(entries).withColumnsRenamed({"kind": "_kind", "pattern": "_pattern"})
    hits = rows.join(listed, (F.col("kind") == F.col("_kind")) & (F.col("pattern") == F.col("_pattern")) & active)
    hits = hits.select("page_id", "url", "fetched", "list")
    # Only hits meet their captures again; null lists stand for the captures themselves, of which repeats become one.
    found = hits.union(captures.withColumn("list", F.lit(None).cast("string"))).groupBy("page_id", "url", "fetched")
    found = found.agg(F.count("list").alias("n_active"), F.array_join(F.sort_array(F.collect_set("list")), ",").alias("lists"))
    return found.select("page_id", "url", "fetched", host_of(F.col("url")).alias("host"), "n_active", "lists", (F.col("n_active") > 0).alias("blocked"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have neither fetch times nor lists, so both follow from the pages by rule: see ``ORACLE``."""
    common.prepare(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")))
    hosts = pages.select(host_of(F.col("url")).alias("pattern")).filter("pattern is not null").distinct()
    hosts = hosts.withColumn("h", F.conv(F.substring(F.md5(F.col("pattern").cast("binary")), 1, 2), 16, 10).cast("int"))

    def entry(rows: DataFrame, name: str, kind: str, action: str, dated: str) -> DataFrame:
        return rows.select(F.lit(name).alias("list"), F.lit(kind).alias("kind"), "pattern", F.lit(action).alias("action"), F.lit(dated).cast("date").alias("dated"))

    entries = entry(hosts.filter("h % 4 = 0"), "spam", "host", "add", "2024-02-01").union(entry(hosts.filter("h % 4 = 0"), "spam", "host", "remove", "2024-06-01"))
    entries = entries.union(entry(hosts.filter("h % 8 = 0"), "spam", "host", "add", "2024-09-01")).union(entry(hosts.filter("h % 5 = 0"), "adult", "domain", "add", "2024-03-15"))
    taken = pages.filter("page_id % 97 = 0").select(
        F.lit("takedown").alias("list"), F.lit("url").alias("kind"), address_of(F.col("url")).alias("pattern"), F.lit("add").alias("action"),
        F.date_add(F.lit("2024-01-10").cast("date"), F.pmod("page_id", F.lit(200)).cast("int")).alias("dated"),
    )
    return filter_captures(captures, entries.union(taken)).withColumn("fetched", F.col("fetched").cast("string"))


ORACLE = rf"""
with p as (
  select page_id, url, nullif(rtrim(lower(regexp_extract(url, '{URL}', 1)), '.'), '') as host, regexp_replace(regexp_extract(url, '{URL}', 2), '/+$', '') as path,
    (date '2024-01-01' + (page_id % 366)::int)::date as fetched
  from pages),
h as (select distinct host, ('0x' || substr(md5(host), 1, 2))::int as h from p where host is not null),
e as (
  select 'spam' as list, 'host' as kind, host as pattern, 1 as act, date '2024-02-01' as dated from h where h % 4 = 0
  union select 'spam', 'host', host, 0, date '2024-06-01' from h where h % 4 = 0
  union select 'spam', 'host', host, 1, date '2024-09-01' from h where h % 8 = 0
  union select 'adult', 'domain', host, 1, date '2024-03-15' from h where h % 5 = 0
  union select 'takedown', 'url', host || path, 1, (date '2024-01-10' + (page_id % 200)::int)::date from p where page_id % 97 = 0 and host is not null),
d as (select list, kind, pattern, dated, max(act) as act from e group by all),
f as (select *, lag(act, 1, 0) over (partition by list, kind, pattern order by dated) as was from d),
g as (select *, lead(dated) over (partition by list, kind, pattern order by dated) as ends from f where act <> was),
v as (select list, kind, pattern, dated as starts, coalesce(ends, date '9999-12-31') as ends from g where act = 1),
k as (
  select page_id, url, fetched, 'url' as kind, host || path as pattern from p
  union all select page_id, url, fetched, 'host', host from p
  union all select page_id, url, fetched, 'domain', array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.')
    from (select *, unnest(range(1, len(string_split(host, '.')) + 1)) as i from p)),
m as (
  select k.page_id, k.url, k.fetched, v.list from k join v on k.kind = v.kind and k.pattern = v.pattern and k.fetched >= v.starts and k.fetched < v.ends),
n as (select page_id, url, fetched, count(*) as n_active, array_to_string(list_sort(list_distinct(list(list))), ',') as lists from m group by all)
select distinct p.page_id, p.url, p.fetched::varchar as fetched, p.host, coalesce(n.n_active, 0) as n_active, coalesce(n.lists, '') as lists, coalesce(n.n_active, 0) > 0 as blocked
from p left join n on p.page_id = n.page_id and p.url = n.url and p.fetched = n.fetched"""
