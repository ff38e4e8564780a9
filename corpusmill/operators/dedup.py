"""Exact, keyed and greedy deduplication."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import tokens
from corpusmill.runtime import block_join, salted_join, salts_for, settle


def first_by_key(rows: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key in an explicit order.

    A struct minimum per key instead of a window: it combines before the
    shuffle, so a key that holds a third of all rows costs no more than others.
    """
    body = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.struct(*rows.columns).alias("row"))
    return rows.groupBy(key.alias("_key")).agg(F.min(body).alias("m")).select("m.row.*")


def keep_per_key(rows: DataFrame, key: Column, order: list[Column], m: int) -> DataFrame:
    """At most m rows per key; rows with an empty key all stay."""
    w = Window.partitionBy(key).orderBy(*order)
    # The plain bound on the rank lets the planner cut every key to m rows before the shuffle.
    first = rows.where(key.isNull() | (key != "")).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= m).drop("_n")
    return first.unionByName(rows.where(key == ""))


def not_in(rows: DataFrame, gold: DataFrame, key: Column, gold_key: Column) -> DataFrame:
    """Rows whose key no gold row has; a null key stays."""
    return rows.withColumn("_k", key).join(gold.select(gold_key.alias("_k")).distinct(), "_k", "left_anti").drop("_k")


def over_frequency(rows: DataFrame, key: Column, least: int) -> DataFrame:
    """(key, n) of keys with more than ``least`` rows."""
    return rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)


def _dot_blocks(threshold: float):
    """Similar pairs of two blocks of vectors, which come as one group of bounded size."""
    schema = pa.schema([("id_a", pa.int64()), ("id_b", pa.int64()), ("sim", pa.float64())])

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        v = np.array(table.column("v").to_pylist(), float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        left = np.flatnonzero(table.column("blk").to_numpy() == table.column("x").to_numpy())
        right = np.flatnonzero(table.column("blk").to_numpy() == table.column("y").to_numpy())
        sim = v[left] @ v[right].T
        same = table.column("x")[0].as_py() == table.column("y")[0].as_py()
        ok = sim > threshold
        if same:
            ok &= ids[left][:, None] < ids[right][None, :]
        i, j = np.nonzero(ok)
        a, b = ids[left][i], ids[right][j]
        return pa.table([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(sim[i, j])], schema=schema)

    return run


def similar_pairs(vectors: DataFrame, id_col: str, vec_col: str, threshold: float, block: int = 2048) -> DataFrame:
    """(id_a < id_b, sim) of all pairs over a cosine threshold, exactly.

    Vectors fall into blocks by hash; every pair of blocks meets in one task of
    about block x block products.  The work is quadratic by definition; memory
    per task isn't.  Null vectors match nothing, zero vectors have cosine 0.
    """
    blocks = max(1, -(-vectors.count() // block))
    tagged = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("blk"))
    met = tagged.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = met.select("id", "v", "blk", F.least("blk", "other").alias("x"), F.greatest("blk", "other").alias("y"))
    return met.groupBy("x", "y").applyInArrow(_dot_blocks(threshold), "id_a long, id_b long, sim double")


def greedy_keep(ids: DataFrame, pairs: DataFrame, id_col: str = "id") -> DataFrame:
    """Ids a sequential pass would keep: a row goes iff an earlier kept row is similar.

    The lexicographically first maximal independent set by fixpoint: each round
    keeps the undecided rows with no undecided earlier neighbour and drops the
    neighbours of what is kept.  Rounds are bounded by the longest chain.
    """
    undecided = settle(pairs.select(F.col("id_b").alias("id")).distinct(), "greedy-open")
    edges = settle(pairs.select("id_a", "id_b"), "greedy-edges")
    dropped = None
    sure = edges.select(F.col("id_a").alias("id")).distinct().join(undecided, "id", "left_anti")
    while True:
        hit = edges.join(sure.select(F.col("id").alias("id_a")), "id_a", "left_semi").select(F.col("id_b").alias("id")).distinct().join(undecided, "id", "left_semi")
        hit = settle(hit, "greedy-dropped")
        dropped = hit if dropped is None else dropped.unionByName(hit)
        undecided = settle(undecided.join(hit, "id", "left_anti"), "greedy-open")
        # Edges out of dropped rows no longer count; those into them neither.
        gone = hit.select(F.col("id").alias("g"))
        edges = edges.join(gone, edges["id_a"] == F.col("g"), "left_anti").join(gone, edges["id_b"] == F.col("g"), "left_anti")
        edges = settle(edges, "greedy-edges")
        waiting = edges.join(undecided.select(F.col("id").alias("id_a")), "id_a", "left_semi").select(F.col("id_b").alias("id")).distinct()
        sure = settle(undecided.join(waiting, "id", "left_anti"), "greedy-sure")
        undecided = settle(undecided.join(sure, "id", "left_anti"), "greedy-open")
        if not sure.limit(1).count():
            break
    return ids.select(F.col(id_col).alias("id")).join(dropped, "id", "left_anti")


def far_from_gold(vectors: DataFrame, gold: DataFrame, id_col: str, vec_col: str, threshold: float, block: int = 2048) -> DataFrame:
    """``vectors`` without those whose cosine with any gold vector is over ``threshold``.

    Gold vectors go in blocks of ``block`` (hash of the id) and each block is one pass of bounded memory in every task; null and
    zero vectors are like nothing and stay.  Ids of the two sides are apart.
    """
    n = max(1, -(-gold.count() // block))
    golden = gold.where(F.col(vec_col).isNotNull()).groupBy(F.pmod(F.xxhash64(id_col), F.lit(n)).alias("_b")).agg(F.collect_list(F.col(vec_col).cast("array<double>")).alias("_g"))  # about ``block`` vectors each
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("v is not null")
    met = rows.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).join(golden, "_b")

    def run(batches):
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        for b in batches:
            if not b.num_rows:
                continue
            v, blocks = unit(np.array(b.column("v").to_pylist(), float)), b.column("_b").to_numpy()
            near = np.zeros(len(v), bool)
            for x in np.unique(blocks):
                at = np.flatnonzero(blocks == x)
                near[at] = (v[at] @ unit(np.array(b.column("_g")[int(at[0])].as_py(), float)).T > threshold).any(axis=1)
            yield b.select(["id"]).filter(pa.array(near))

    kind = vectors.schema[id_col].dataType.simpleString()
    like = met.select("id", "v", "_b", "_g").mapInArrow(run, f"id {kind}").distinct()
    return vectors.join(like.select(F.col("id").alias(id_col)), id_col, "left_anti")


def near_texts(docs: DataFrame, id_col: str, text: str, similar: float = 0.8, size: int = 5) -> tuple[DataFrame, DataFrame]:
    """(members(id, cls), links(cls_a < cls_b, similarity)): near-duplicates by Jaccard over ``size``-word shingles, exactly.

    Texts of equal shingle sets are one class, named by its smallest id; only classes meet.  Of a class's n shingles the
    n - ceil(similar n) + 1 rarest hold one in common with any class that is similar enough, so classes meet on
    those alone, in blocks where a shingle is frequent.  Shingles are 64-bit hashes.  Texts of fewer words than ``size`` (null ones too) are
    left out of both.
    """
    words = tokens(F.col(text))
    grams = F.transform(F.sequence(F.lit(0), F.size("w") - size), lambda i: F.xxhash64(F.array_join(F.slice("w", i + 1, size), " ")))
    sets = docs.select(F.col(id_col).alias("id"), words.alias("w")).where(F.size("w") >= size).select("id", F.array_sort(F.array_distinct(grams)).alias("s"))
    sets = settle(sets.withColumn("k", F.md5(F.array_join("s", ",")).substr(1, 32)), "near-sets")
    classes = settle(sets.groupBy("k").agg(F.min("id").alias("cls")), "near-classes")
    members = sets.select("id", "k").join(classes, "k").select("id", "cls")
    alone = settle(sets.join(classes.select(F.col("cls").alias("id")), "id", "left_semi").select(F.col("id").alias("cls"), F.size("s").alias("n"), "s"), "near-alone")
    each = alone.select("cls", "n", F.explode("s").alias("g"))
    often = each.groupBy("g").agg(F.count(F.lit(1)).alias("df")).where("df > 1")  # a shingle of one class joins nothing
    place = F.row_number().over(Window.partitionBy("cls").orderBy("df", "g"))
    # Shingles that only this class has come first in the order; they are n less those that are shared.
    shared = each.join(often, "g").withColumn("left", F.count(F.lit(1)).over(Window.partitionBy("cls"))).withColumn("at", place + F.col("n") - F.col("left"))
    keys = settle(shared.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * similar - 1e-9) + 1).select("cls", "n", "g"), "near-keys")
    a, b = keys.select(F.col("cls").alias("a"), F.col("n").alias("na"), "g"), keys.select(F.col("cls").alias("b"), F.col("n").alias("nb"), "g")
    met = block_join(a, b, ["g"], F.col("a"), F.col("b")).where(F.col("a") < F.col("b")).where(F.least("na", "nb") >= similar * F.greatest("na", "nb") - 1e-9).select("a", "b").distinct()
    both = met.join(alone.select(F.col("cls").alias("a"), F.col("s").alias("sa")), "a").join(alone.select(F.col("cls").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    links = both.select(F.col("a").alias("cls_a"), F.col("b").alias("cls_b"), (common / (F.size("sa") + F.size("sb") - common)).alias("similarity")).where(F.col("similarity") >= similar - 1e-9)
    return members, links


def link_counts(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, cls, n_links): how many other texts each one is like, those of its own class included."""
    sizes = members.groupBy("cls").agg(F.count(F.lit(1)).alias("size"))
    ways = links.select(F.col("cls_a").alias("cls"), F.col("cls_b").alias("other")).unionByName(links.select(F.col("cls_b").alias("cls"), F.col("cls_a").alias("other")))
    more = ways.join(sizes.select(F.col("cls").alias("other"), "size"), "other").groupBy("cls").agg(F.sum("size").alias("more"))
    per = sizes.join(more, "cls", "left").select("cls", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), salts_for(F.col("size")).alias("n_salts"))
    return salted_join(members, settle(per, "near-links"), ["cls"], F.col("id")).select("id", "cls", "n_links")
