"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

1. One Python pass over the whole texts gives each document the digest of its shingle set, the set's size and its band keys.
   Documents with equal sets form a class; only the class's least ``doc_id`` goes on.
2. Rows that share a band key are candidates. Buckets give star edges to their least id, never pairs; connected components
   of these edges are the *clusters* outside which no document can have a link (but for the stated miss of banding, 1e-7 a
   pair).
3. Texts are fetched for clusters of two or more only. A cluster that fits a block (``BLOCK`` documents, ``BLOCK_CHARS``
   code points) is compared whole in one task. A larger one is first compared block by block, each with a few seeded
   centres, and what hangs together so far is a *part*. Only documents that share a bucket with another part can have a
   link that is still unknown. They meet again, either pair of blocks by pair of blocks or bucket by bucket, whichever of
   the two ships fewer rows for that cluster; there all but the largest part meet everything.
   All comparisons are exact intersections of the full sets. A task compares a document with all others at once, and only
   until all but its largest part have been compared, so a dense task costs little more than its size.
4. Connected components of the links give each class, and through it each document, the least reachable ``doc_id``.

Sketches and classes see 64-bit hashes of the words' bytes; what is compared in step 3 are the words themselves, numbered within
the task. No step collects anything of corpus size on the driver, and no bucket or cluster has a cap. What stays quadratic, in blocks, is a bucket that holds far more than a block of documents which agree in
its band and yet are not linked.

Defined results
---------------
* null or empty text, or a text without words: no shingles, linked with nothing, its own group;
* null ``doc_id``: takes no part in linking, ``component_id`` null, kept;
* repeated rows: each row has the component of its own text; rows equal in ``doc_id`` and text stay or go together, and
  only one of them, however many there are, is ever fetched for a comparison;
* an empty table gives an empty result; other columns are carried by :func:`deduplicate` and ignored by :func:`groups`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from graphloom.llm import common, sketch

#: Documents compared at once in a task, and code points of their texts.
BLOCK = 4096
BLOCK_CHARS = 4 << 20
#: Centres of a cluster that is larger than a block.
CENTRES = 8


def shingles(text: str | None, width: int) -> np.ndarray:
    """The hashed shingle set of a whole text, A-Z lower-cased."""
    return sketch.shingle_set(common.word_hashes(text or "", lower=True), width)


def exact_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The shingle sets of some texts as sorted numbers, equal exactly where the shingles' words are equal."""
    known: dict[bytes, int] = {}
    parts = []
    for t in texts:
        own = [np.fromiter((known.setdefault(w, len(known)) for w in some), np.int64, len(some)) for some in common.words_of(t or "", lower=True)]
        parts.append(np.concatenate(own) if own else np.zeros(0, np.int64))
    size = np.array([len(p) for p in parts], np.int64)
    word = np.concatenate([*parts, np.zeros(width, np.int64)])
    rank = word
    for i in range(1, width):  # the number of what begins here, one word longer each time
        rank = np.unique(rank[:-1] * len(known) + word[i:], return_inverse=True)[1]
    short: dict[bytes, int] = {}
    out, at = [], 0
    for p, n in zip(parts, size.tolist(), strict=True):
        if n >= width:
            out.append(np.unique(rank[at : at + n - width + 1]))
        else:  # fewer words than a shingle are one of their own kind
            out.append(np.array([-1 - short.setdefault(p.tobytes(), len(short))] if n else [], np.int64))
        at += n
    return out


def _signatures(documents: DataFrame, width: int, percent: int) -> DataFrame:
    """``doc_id, text_hash, chars, digest, n_shingles, bands``; the digest and bands of an empty set are null."""
    rows, bands = sketch.choose_bands(percent / 100)

    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out, known = [], {}
            for t in texts:
                s = shingles(t if isinstance(t, str) else None, width)
                if not len(s):
                    out.append((None, 0, None))
                    continue
                digest = hashlib.md5(s.tobytes()).digest()
                if digest not in known:
                    known[digest] = sketch.band_keys(sketch.sketch(s, rows * bands), rows, bands).view(np.int64)
                out.append((digest, len(s), known[digest]))
            yield pd.DataFrame(out, columns=["digest", "n_shingles", "bands"])

    signed = pandas_udf(sign, "digest binary, n_shingles long, bands array<long>")(F.col("_x"))
    rows = documents.select("doc_id", F.col("text").alias("_x"))
    rows = rows.select("doc_id", F.xxhash64("_x").alias("text_hash"), F.char_length("_x").cast("long").alias("chars"), signed.alias("_s"))
    return rows.select("doc_id", "text_hash", "chars", "_s.*")


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` of every end of the edges ``a, b``: the least id reachable, by alternating star contractions."""

    def signature(e: DataFrame) -> tuple:
        r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        return r[0], r[1]

    e = common.stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", narrow=True)
    now = signature(e)
    while n := now[0]:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = common.stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least", 2 * n)
        large = common.stage(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large", n)
        least = common.stage(large.groupBy("a").agg(F.min("b").alias("m")), "least", n)
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = common.stage(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "small", n)
        before, now = now, signature(e)
        if before == now:
            break
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(e.select("b", "b").distinct())


def connect(sets: list[np.ndarray], known: list, percent: int) -> list[tuple[int, int]]:
    """Links ``(i, j)`` that join the known parts of some sets to what all links together connect.

    A set is compared with all others at once. Sets of the part that is largest just then wait; in the end all sets outside
    the largest part have met every other set, so no link between two parts is missed.
    """
    size = np.array([len(s) for s in sets])
    part = np.unique(np.array(known), return_inverse=True)[1]
    row = np.repeat(np.arange(len(sets)), size)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    on = count[column] > 1
    row, column = row[on], column[on]
    bound = np.searchsorted(row, np.arange(len(sets) + 1))
    mark, waiting, out = np.zeros(len(count), bool), size > 0, []
    while True:
        largest = np.bincount(part).argmax()
        left = waiting & (part != largest)
        i = int(left.argmax())
        if not left[i]:
            return out
        waiting[i] = False
        own = column[bound[i] : bound[i + 1]]
        mark[own] = True
        common_ = np.bincount(row[mark[column]], minlength=len(sets))
        mark[own] = False
        linked = (size > 0) & (100 * common_ >= percent * (size[i] + size - common_)) & (part != part[i])
        for j in np.flatnonzero(linked):
            if part[j] != part[i]:
                out.append((i, int(j)))
                part[part == part[j]] = part[i]


def _links(width: int, percent: int):
    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        """The links of one task between different known parts, enough of them to connect all that is connected."""
        rows = rows.sort_values("id", kind="stable")
        ids, out = rows["id"].to_list(), []
        if len(ids) > 1:
            out = [(ids[i], ids[j]) for i, j in connect(exact_sets(rows["_x"].to_list(), width), rows["part"].to_list(), percent)]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return compare


def _blocks(n: Column, chars: Column) -> Column:
    return F.ceil(F.greatest(n / BLOCK, chars / BLOCK_CHARS))


def _unsettled(placed: DataFrame, heads: DataFrame) -> DataFrame:
    """``cluster, area, id, part, chars``: what must meet again, one area a cluster, or one a bucket where that is fewer rows.

    ``placed`` has ``cluster, id, chars, part``; ``heads`` has ``id, bands``. Buckets within one part are settled.
    """
    rows = heads.join(placed, "id").select("cluster", F.explode("bands").alias("bucket"), "id", "part", "chars")
    rows = common.stage(rows.distinct(), "met", narrow=True)
    mixed = rows.groupBy("cluster", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo <> hi")
    mixed = common.stage(mixed.select("cluster", "bucket", "n"), "mixed", narrow=True)
    rows = common.stage(rows.join(mixed.select("cluster", "bucket"), ["cluster", "bucket"], "left_semi"), "open", narrow=True)
    once = rows.select("cluster", F.lit(0).cast("long").alias("area"), "id", "part", "chars").distinct()
    by_bucket = mixed.groupBy("cluster").agg(F.sum("n").alias("bucket_rows"))
    main = _main(once).groupBy("cluster").agg(F.max(F.expr("s * w + (s + g) * loose")).alias("block_rows"))
    mode = common.stage(by_bucket.join(main, "cluster").select("cluster", (F.col("bucket_rows") < F.col("block_rows")).alias("apart")), "mode", narrow=True)
    whole = once.join(mode.filter("not apart"), "cluster", "left_semi")
    apart = rows.join(mode.filter("apart"), "cluster", "left_semi")
    return whole.union(apart.select("cluster", F.col("bucket").alias("area"), "id", "part", "chars"))


def _main(rows: DataFrame) -> DataFrame:
    """``cluster, area, main, w, loose, g, s``: each area's largest part, its size, that of the rest, and the blocks of both."""
    weight = rows.groupBy("cluster", "area", "part").agg(F.count(F.lit(1)).alias("w"), F.sum("chars").alias("c"))
    best = F.max(F.struct("w", "part", "c")).alias("m")
    main = weight.groupBy("cluster", "area").agg(best, F.sum("w").alias("all_w"), F.sum("c").alias("all_c"))
    loose, chars = F.col("all_w") - F.col("m.w"), F.col("all_c") - F.col("m.c")
    return main.select("cluster", "area", F.col("m.part").alias("main"), F.col("m.w").alias("w"), loose.alias("loose"), _blocks(F.col("m.w"), F.col("m.c")).alias("g"), _blocks(loose, chars).alias("s")).filter("loose > 0")


def _dealt(rows: DataFrame) -> DataFrame:
    """``cluster, area, i, j, id, part``: loose block ``i`` meets loose blocks ``j`` and, as ``(i, s + k)``, blocks ``k`` of the main part."""
    main = common.stage(_main(rows), "main", narrow=True)
    rows = rows.join(main, ["cluster", "area"]).withColumn("loose", F.col("part") != F.col("main"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit("rest")), F.when(F.col("loose"), F.col("s")).otherwise(F.col("g"))))
    tasks = F.when(
        F.col("loose"),
        F.concat(
            F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j"))),
            F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda k: F.struct(F.col("block").alias("i"), (F.col("s") + k).alias("j"))),
        ),
    ).otherwise(F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda i: F.struct(i.alias("i"), (F.col("s") + F.col("block")).alias("j"))))
    return rows.select("cluster", "area", "id", "part", F.explode(tasks).alias("task")).select("cluster", "area", "id", "part", "task.i", "task.j")


def _verified(texts: DataFrame, members: DataFrame, heads: DataFrame, width: int, percent: int) -> DataFrame:
    """Links ``a, b`` between the members ``cluster, id, text_hash, chars``, enough of them to connect all that is connected."""
    compare = _links(width, percent)

    def compared(rows: DataFrame) -> DataFrame:
        """Tables of ids grow with the corpus, so texts and ids are merged, never broadcast, at every size."""
        met = texts.join(rows.hint("merge"), ["id", "text_hash"])
        return met.groupBy("cluster", "area", "i", "j").applyInPandas(compare, "a long, b long")

    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))
    sizes = common.stage(sizes.select("cluster", "n", _blocks(F.col("n"), F.col("chars")).alias("blocks")), "sizes", narrow=True)
    rows = members.join(sizes, "cluster").withColumn("i", F.pmod(F.xxhash64("id", F.lit("block")), "blocks"))

    # Centres, one bounded list a cluster, go to each block of their cluster.
    rank = Window.partitionBy("cluster").orderBy(F.xxhash64("id", F.lit("centre")), "id")
    first = rows.filter("blocks > 1").filter(F.pmod(F.xxhash64("id", F.lit("pick")), F.greatest(F.lit(1), F.floor(F.col("n") / (8 * CENTRES)))) == 0)
    centres = first.withColumn("k", F.row_number().over(rank)).filter(F.col("k") <= CENTRES)
    centres = centres.withColumn("own", F.col("i")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("i <> own")
    keys = ["cluster", F.lit(0).cast("long").alias("area"), "i", F.col("i").alias("j"), "id", "text_hash", F.col("id").alias("part")]
    near = common.stage(compared(rows.select(*keys).union(centres.select(*keys))), "near", narrow=True)
    large = rows.filter("blocks > 1")
    if sizes.filter("blocks > 1").isEmpty():
        return near

    placed = large.select("cluster", "id", "chars").join(components(near), "id", "left")
    placed = common.stage(placed.select("cluster", "id", "chars", F.coalesce("component", "id").alias("part")), "placed", narrow=True)
    dealt = common.stage(_dealt(common.stage(_unsettled(placed, heads), "unsettled", narrow=True)), "dealt", narrow=True)
    if dealt.isEmpty():
        return near
    return near.union(compared(dealt.join(members.select("id", "text_hash"), "id")))


def groups(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id, kept`` of each row: links join sets with ``100 * common >= percent * union``."""
    common.prepare(documents.sparkSession)
    signed = common.stage(_signatures(documents, width, percent), "signatures")
    live = signed.filter("doc_id is not null and digest is not null")
    # One row stands for a class, however many rows it has: of the least id, the text with the least hash.
    least = F.struct(F.col("doc_id").alias("id"), "text_hash", "chars")
    heads = common.stage(live.groupBy("digest").agg(F.min(least).alias("h"), F.first("bands").alias("bands")).select("digest", "h.*", "bands"), "heads")
    classes = heads.select("digest", "id")
    rows = heads.select("id", F.explode("bands").alias("bucket"))
    least = rows.groupBy("bucket").agg(F.min("id").alias("b"), F.max("id").alias("most")).filter("b < most")
    stars = rows.join(least.select("bucket", "b"), "bucket").filter("id <> b").select(F.col("id").alias("a"), "b")
    clusters = components(stars).withColumnRenamed("component", "cluster")
    members = heads.select("id", "text_hash", "chars").join(clusters, "id").select("cluster", "id", "text_hash", "chars")
    members = common.stage(members, "members", narrow=True)
    texts = documents.select(F.col("doc_id").alias("id"), F.col("text").alias("_x")).filter("id is not null").withColumn("text_hash", F.xxhash64("_x"))
    if not live.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        texts = texts.groupBy("id", "text_hash").agg(F.first("_x").alias("_x"))  # repeated rows shrink within each task first
    found = components(_verified(texts, members, heads.select("id", "bands"), width, percent))
    named = classes.join(found, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    named = common.stage(named, "named", narrow=True)
    out = signed.select("doc_id", "text_hash", "digest", "n_shingles").join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``documents`` that stay: one document of each group, all columns as they are."""
    gone = groups(documents.select("doc_id", "text"), width, percent).filter("not kept")
    gone = common.stage(gone.select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_gone_hash")).distinct(), "gone", narrow=True)
    return documents.join(gone.hint("merge"), (documents["doc_id"] == gone["_gone"]) & (F.xxhash64(documents["text"]) == gone["_gone_hash"]), "left_anti")


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return groups(docs, width=3, percent=85).drop("text_hash")
