"""Mixing sources to target weights by hierarchical budgeting.

The rows form a tree: domain, language, source. The token budget of the root is divided among the domains in proportion to
their weights, each domain's part among its languages, each language's among its sources. A child that cannot use its part
(its tokens times ``max_epochs`` are fewer) is filled and the rest goes to its siblings; only what all siblings together
cannot take is missing from the parent, whose own siblings have then taken it before. This is one closed form a level: the
siblings in order of capacity per weight, running sums, and the first that is not filled sets the level of all after it.

A leaf's budget is spent on seeded epochs: whole epochs first, then the prefix of one more, in the order of
``md5(seed:epoch:doc_id)``, that still fits. The prefix ends at a digest, the leaf's *cutoff*, so only the small leaf table
meets the documents and no text is shuffled. Running sums go over 4096 ranges of digests first, so that a leaf with a third
of all rows is never sorted in one task.

All arithmetic is on integers; weights are integers. Tokens are words (runs of other than space and ``\\x09-\\x0D``).

Defined results
---------------
* null text: no tokens, selected with the prefix its digest falls into; null language or source: the leaf named ``?``;
* rows with one ``doc_id`` (or null) in a leaf are selected together; an empty table gives an empty result;
* a weight of 0 gives a node and all below it nothing, and its siblings what it would have had; a node that is not listed
  has the weight ``default``;
* :func:`mix` returns the input's columns as they are, a row for each selected epoch.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm import common

#: Without a table of domains, sources are dealt to four of them by a digest of their name.
DOMAIN = "concat('d', cast((instr('0123456789abcdef', substr(md5(_source), 1, 1)) - 1) % 4 as string))"
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Targets:
    domain: dict[str, int] = field(default_factory=lambda: {"d0": 4, "d1": 3, "d2": 2, "d3": 1})
    lang: dict[str, int] = field(default_factory=lambda: {"en": 50, "de": 20, "fr": 20, "es": 10})
    source: dict[str, int] = field(default_factory=dict)
    default: int = 1
    #: Of the tokens there are, in percent.
    budget_percent: int = 80
    max_epochs: int = 2
    seed: str = "mix-1"


TARGETS = Targets()
_TREE = ["_domain", "_lang", "_source"]


def _weight(column: str, weights: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, w in weights.items():
        out = F.when(F.col(column) == name, F.lit(w)).otherwise(out)
    return out.cast("decimal(9,0)")


def divide(children: DataFrame, parent: list[str], key: str) -> DataFrame:
    """``children`` (``parent`` columns, ``key``, ``w``, ``cap``, the parent's ``budget``) with ``part``: what each gets."""
    group = Window.partitionBy(*parent)
    order = group.orderBy(F.when(F.col("w") > 0, F.col("cap").cast("double") / F.col("w").cast("double")).otherwise(F.lit(float("inf"))), key)
    rows = (
        children.withColumn("_rn", F.row_number().over(order))
        .withColumn("_room", (F.col("budget") - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("decimal(20,0)"))
        .withColumn("_suffix", F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)).cast("decimal(12,0)"))
        .withColumn("_full", (F.col("w") > 0) & (F.col("cap") * F.col("_suffix") <= F.col("w") * F.col("_room")))
    )
    lead = group.orderBy("_full", "_rn")
    rows = rows.withColumn("_room", F.first("_room").over(lead)).withColumn("_suffix", F.first("_suffix").over(lead))
    share = F.expr("case when _full then cap when _suffix > 0 then cast((w * _room) div _suffix as decimal(20,0)) else 0 end")
    return rows.withColumn("part", F.least(F.col("cap"), share).cast("decimal(20,0)")).drop("_rn", "_room", "_suffix", "_full")


def _keyed(documents: DataFrame) -> DataFrame:
    """``row``, a document with all its columns, ``doc_id`` and the keys and tokens of its leaf."""
    named = documents.select(common.whole_row(documents).alias("row"), "doc_id", F.col("text").alias("_x"), F.coalesce("lang", F.lit("?")).alias("_lang"), F.coalesce("source", F.lit("?")).alias("_source"))
    return named.select("row", "doc_id", F.expr(DOMAIN).alias("_domain"), "_lang", "_source", F.coalesce(F.regexp_count("_x", F.lit(WORD)), F.lit(0)).cast("long").alias("_tokens"))


def _digest(seed: str, epoch: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(epoch).cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def budgets(tokens: DataFrame, t: Targets) -> DataFrame:
    """The leaf table: ``_domain, _lang, _source, _leaf_tokens, _part`` from the rows' keys and ``_tokens``.

    A node can use what its children can use; one of weight 0 can use nothing, so nothing is set aside for it.
    """
    leaf = common.stage(tokens.groupBy(*_TREE).agg(F.sum("_tokens").alias("_leaf_tokens")), "leaves", narrow=True)

    def weighed(rows: DataFrame, column: str, weights: dict[str, int]) -> DataFrame:
        usable = F.when(F.col("w") > 0, F.col("cap")).otherwise(F.lit(0)).cast("decimal(20,0)")
        return rows.withColumn("w", _weight(column, weights, t.default)).withColumn("cap", usable)

    leaf = weighed(leaf.withColumn("cap", F.col("_leaf_tokens") * t.max_epochs), "_source", t.source)
    lang = weighed(leaf.groupBy("_domain", "_lang").agg(F.sum("cap").alias("cap")), "_lang", t.lang)
    domain = weighed(lang.groupBy("_domain").agg(F.sum("cap").alias("cap")), "_domain", t.domain)
    total = F.expr(f"cast((sum(_leaf_tokens) * {t.budget_percent}) div 100 as decimal(20,0))")
    root = leaf.agg(F.coalesce(total, F.lit(0)).cast("decimal(20,0)").alias("budget"))
    domain = divide(domain.crossJoin(F.broadcast(root)).withColumn("_root", F.lit(0)), ["_root"], "_domain").select("_domain", F.col("part").alias("budget"))
    lang = divide(lang.join(domain, "_domain"), ["_domain"], "_lang").select("_domain", "_lang", F.col("part").alias("budget"))
    return divide(leaf.join(lang, ["_domain", "_lang"]), ["_domain", "_lang"], "_source").select(*_TREE, "_leaf_tokens", F.col("part").cast("long").alias("_part"))


def cutoffs(tokens: DataFrame, t: Targets) -> DataFrame:
    """The leaf table with ``_whole`` epochs and the ``_cutoff`` digest of the epoch after them (null: nothing of it)."""
    leaf = budgets(tokens, t)
    whole = F.expr(f"case when _leaf_tokens > 0 then least(_part div _leaf_tokens, {t.max_epochs}) else 0 end")
    leaf = leaf.withColumn("_whole", whole.cast("int"))
    rest = F.when(F.col("_whole") < t.max_epochs, F.col("_part") - F.col("_whole") * F.col("_leaf_tokens")).otherwise(0)
    leaf = common.stage(leaf.withColumn("_rest", rest.cast("long")), "parts", narrow=True)
    rows = tokens.join(leaf.select(*_TREE, "_whole", "_rest").filter("_rest > 0"), _TREE).withColumn("_digest", _digest(t.seed, "_whole"))
    rows = rows.select(*_TREE, "_rest", "_digest", "_tokens", F.substring("_digest", 1, 3).alias("_range"))
    ranges = rows.groupBy(*_TREE, "_range", "_rest").agg(F.sum("_tokens").alias("_n"))
    before = Window.partitionBy(*_TREE).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    ranges = common.stage(ranges.filter("_before <= _rest").select(*_TREE, "_range", "_before"), "ranges", narrow=True)
    inside = Window.partitionBy(*_TREE, "_range").orderBy("_digest").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(ranges, [*_TREE, "_range"]).withColumn("_sum", F.col("_before") + F.sum("_tokens").over(inside))
    cut = rows.filter("_sum <= _rest").groupBy(*_TREE).agg(F.max("_digest").alias("_cutoff"))
    return common.stage(leaf.join(cut, _TREE, "left").select(*_TREE, "_whole", "_cutoff"), "cutoffs", narrow=True)


def _chosen(rows: DataFrame, tokens: DataFrame, t: Targets) -> DataFrame:
    """``rows`` (with ``doc_id`` and the keys of the tree) as often as they are taken, with ``_epoch``."""
    rows = rows.join(cutoffs(tokens, t), _TREE)
    copies = F.col("_whole") + F.coalesce((_digest(t.seed, "_whole") <= F.col("_cutoff")).cast("int"), F.lit(0))
    rows = rows.withColumn("_copies", copies).filter("_copies > 0")
    return rows.withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))


def _tokens(documents: DataFrame) -> DataFrame:
    common.prepare(documents.sparkSession)
    return common.stage(_keyed(documents.select("doc_id", "text", "lang", "source")).select("doc_id", *_TREE, "_tokens"), "tokens")


def select(documents: DataFrame, t: Targets = TARGETS) -> DataFrame:
    """``row``, a document with all its columns, ``domain``, ``lang``, ``source`` and ``epoch``: a row for each epoch it is taken in."""
    tokens = _tokens(documents)
    return _chosen(_keyed(documents).drop("_tokens"), tokens, t).select("row", *[F.col(f"_{c}").alias(c) for c in ("domain", "lang", "source", "epoch")])


def mix(documents: DataFrame, t: Targets = TARGETS) -> DataFrame:
    """The selected rows of ``documents``, columns as they are."""
    return select(documents, t).select("row.*")


def schedule(documents: DataFrame, t: Targets = TARGETS) -> DataFrame:
    """``doc_id, domain, lang, source, n_tokens, epoch`` of what :func:`select` takes; texts are read once."""
    tokens = _tokens(documents)
    names = {"_domain": "domain", "_lang": "lang", "_source": "source", "_tokens": "n_tokens", "_epoch": "epoch"}
    return _chosen(tokens, tokens, t).select("doc_id", *[F.col(a).alias(b) for a, b in names.items()])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))


def _cases(column: str, weights: dict[str, int], default: int) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then {v}" for k, v in weights.items()) + f" else {default} end" if weights else str(default)


def _fill_sql(name: str, children: str) -> str:
    """CTEs that give ``pk, key, part``: round by round, children whose capacity is within their share are filled and leave."""
    return f"""
{name}_in as ({children}),
{name}_round as (
  select pk, key, w, cap, budget::hugeint as room, false as done, 0 as it from {name}_in where w > 0
  union all
  select pk, key, w, cap, room - taken, now_done, it + 1 from (
    select *, sum(case when now_done then cap else 0 end) over (partition by pk) as taken, bool_or(now_done) over (partition by pk) as moved
    from (select pk, key, w, cap, room, it, cap * (sum(w) over (partition by pk)) <= w * room as now_done from {name}_round where not done))
  where moved),
{name}_last as (select *, max(it) over (partition by pk, key) as final from {name}_round),
{name} as (
  select c.pk, c.key, case when c.w = 0 then 0 when l.done then l.cap else (l.w * l.room) // l.open_w end as part
  from {name}_in c left join (
    select pk, key, w, cap, room, done, sum(case when done then 0 else w end) over (partition by pk, it) as open_w from {name}_last where it = final) l using (pk, key))"""


def oracle(t: Targets = TARGETS) -> str:
    return f"""
with recursive tok as (
  select doc_id, coalesce(lang, '?') as lang, coalesce(source, '?') as source,
    'd' || ((instr('0123456789abcdef', substr(md5(coalesce(source, '?')), 1, 1)) - 1) % 4)::varchar as domain,
    coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as n_tokens
  from documents),
leaf0 as (select domain, lang, source, sum(n_tokens)::hugeint as leaf_tokens, ({_cases('source', t.source, t.default)})::hugeint as w from tok group by 1, 2, 3),
leaf1 as (select *, case when w > 0 then leaf_tokens * {t.max_epochs} else 0 end as cap from leaf0),
lang1 as (select domain, lang, ({_cases('lang', t.lang, t.default)})::hugeint as w, case when ({_cases('lang', t.lang, t.default)}) > 0 then sum(cap) else 0 end::hugeint as cap from leaf1 group by domain, lang),
dom1 as (select domain, ({_cases('domain', t.domain, t.default)})::hugeint as w, case when ({_cases('domain', t.domain, t.default)}) > 0 then sum(cap) else 0 end::hugeint as cap from lang1 group by domain),
{_fill_sql('dom', f"select 'all' as pk, domain as key, w, cap, (select (sum(leaf_tokens)::hugeint * {t.budget_percent}) // 100 from leaf0) as budget from dom1")},
{_fill_sql('lng', "select l.domain as pk, l.lang as key, l.w, l.cap, d.part as budget from lang1 l join dom d on d.key = l.domain")},
{_fill_sql('src', "select f.domain || ':' || f.lang as pk, f.source as key, f.w, f.cap, g.part as budget from leaf1 f join lng g on g.pk = f.domain and g.key = f.lang")},
leaf as (select domain, lang, source, leaf_tokens, part from leaf1 join src on src.pk = domain || ':' || lang and src.key = source),
parts as (select *, case when leaf_tokens > 0 then least(part // leaf_tokens, {t.max_epochs}) else 0 end::int as whole from leaf),
rests as (select *, case when whole < {t.max_epochs} then part - whole * leaf_tokens else 0 end as rest from parts),
keyed as (select t.*, whole, rest, md5('{t.seed}:' || whole::varchar || ':' || coalesce(doc_id::varchar, '')) as digest from tok t join rests using (domain, lang, source)),
summed as (select *, sum(n_tokens) over (partition by domain, lang, source order by digest range between unbounded preceding and current row) as running from keyed),
taken as (select *, whole + (case when rest > 0 and running <= rest then 1 else 0 end) as copies from summed)
select doc_id, domain, lang, source, n_tokens, unnest(range(copies))::int as epoch from taken where copies > 0"""
