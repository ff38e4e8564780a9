"""BM25, vector search, rank fusion and evidence sufficiency."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import tokens
from corpusmill.runtime import settle

#: Cells of a query matrix (terms or dimensions x queries) that is broadcast, 8 bytes each; beyond, BM25 is a join on terms.
MATRIX_CELLS = 8_000_000
#: Documents scored at a time within a task.
ROWS = 512


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double; 0 for empty, unequal or zero vectors."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    ok = (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(ok, F.coalesce(F.try_divide(dot(a, b), na * nb), F.lit(0.0))).otherwise(0.0)


def postings(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings(id, term, tf), lengths(id, dl), terms(term, df)) of a BM25 index."""
    t = docs.select(F.col(id_col).alias("id"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    lengths = t.select("id", F.size("w").alias("dl"))
    post = t.select("id", F.explode("w").alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    return post, lengths, post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def bm25(docs: DataFrame, queries: DataFrame, id_col: str, text: str, k1: float = 1.5, b: float = 0.75, eps: float = 0.25) -> DataFrame:
    """(query_id, id, score > 0) for queries(query_id, text).

    Negative idf counts as eps times the mean idf.  Only postings of query terms
    are scored; a term's documents are joined on the term, so frequent terms are
    split by AQE rather than collected.
    """
    post, lengths, df = postings(docs, id_col, text)
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))  # one row
    raw = df.select("term", "df", stats.select("n").scalar().alias("n"), stats.select("avgdl").scalar().alias("avgdl"))
    raw = raw.withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("idf")).scalar()
    idf = raw.select("term", "n", "avgdl", F.when(F.col("idf") < 0, eps * mean).otherwise(F.col("idf")).alias("idf"))
    # Each posting is weighed once; the join with the query terms then only sums.
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    known = idf.join(asked.select("term").distinct(), "term", "left_semi")
    weighed = post.join(known, "term").join(lengths, "id").select("id", "term", weight.alias("weight"))
    return asked.join(weighed, "term").groupBy("query_id", "id").agg(F.sum(F.col("times") * F.col("weight")).alias("score")).where("score > 0")


def _keep_best(k: int, n_queries: int):
    """A running store of the k best (id, score) per query, ties by id: ``add(ids, scores)`` and ``rows()``."""
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * n_queries

    def add(ids: np.ndarray, scores: np.ndarray) -> None:  # scores: rows x queries; -inf leaves a row out
        top = scores.max(axis=0, initial=-np.inf)
        for j in np.flatnonzero(top > -np.inf):
            have_ids, have = best[j]
            if len(have) == k and top[j] < have[-1]:
                continue
            at = np.flatnonzero(scores[:, j] >= (have[-1] if len(have) == k else -np.inf))
            at = at[scores[at, j] > -np.inf]
            i, s = np.concatenate([have_ids, ids[at]]), np.concatenate([have, scores[at, j]])
            order = np.lexsort((i, -s))[:k]
            best[j] = i[order], s[order]

    def rows():
        at = np.repeat(np.arange(n_queries), [len(i) for i, _ in best])
        return at, np.concatenate([i for i, _ in best]), np.concatenate([s for _, s in best])

    return add, rows


_BEST = "at int, id long, score double"


def _best_batch(at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(ids), pa.array(scores)], ["at", "id", "score"])


def _named(best: DataFrame, query_ids: list, k: int) -> DataFrame:
    """The k best per query of all tasks' bests, with the queries' own ids."""
    names = best.sparkSession.createDataFrame(list(enumerate(query_ids)), "at int, query_id string")
    return top_per_query(best.join(F.broadcast(names), "at").select("query_id", "id", "score"), k)


def bm25_top(docs: DataFrame, queries: DataFrame, id_col: str, text: str, k: int, k1: float = 1.5, b: float = 0.75, eps: float = 0.25) -> DataFrame:
    """(query_id, id, score > 0, rank <= k) as ``bm25`` with ``top_per_query`` gives, without a row per document and query.

    Document frequencies are one aggregate; the queries' term weights then go to all tasks as a
    matrix of at most MATRIX_CELLS cells, and each task keeps k documents per query.  More queries take ``bm25``'s join.
    Scores are rounded to 9 digits, so that ranks don't depend on the order of sums.
    """
    spark = docs.sparkSession
    asked = settle(queries.select(F.col("query_id").cast("string").alias("query_id"), F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times")), "asked")
    n_terms, n_queries = asked.agg(F.count_distinct("term"), F.count_distinct("query_id")).first()
    if n_terms * n_queries > MATRIX_CELLS:
        scored = bm25(docs, queries.select(F.col("query_id").cast("string").alias("query_id"), "text"), id_col, text, k1, b, eps)
        return top_per_query(scored.withColumn("score", F.round("score", 9)), k)
    t = docs.select(F.col(id_col).cast("long").alias("id"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    # One pass: the frequencies of all terms, and under the empty term the number of documents and of their words.
    seen = t.select(F.size("w").alias("dl"), F.explode(F.array_append(F.array_distinct("w"), F.lit(""))).alias("term"))
    seen = settle(seen.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("term") == "", F.col("dl"))).alias("words")), "terms")
    n, words = (seen.where("term = ''").select("df", "words").first() or (0, 0))
    if not n or not n_terms:
        return spark.createDataFrame([], "query_id string, id long, score double, rank int")
    idf = F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    raw = seen.where("term <> ''").select("term", idf.alias("idf"))
    mean = raw.agg(F.avg("idf")).first()[0] or 0.0
    known = asked.join(raw, "term").select("query_id", "term", "times", F.when(F.col("idf") < 0, eps * mean).otherwise(F.col("idf")).alias("idf")).collect()  # MATRIX_CELLS at most
    terms = {x: i for i, x in enumerate(sorted({r["term"] for r in known}))}
    ids = sorted({r["query_id"] for r in known})
    place = {x: i for i, x in enumerate(ids)}
    matrix = np.zeros((len(terms), len(ids)))
    for r in known:
        matrix[terms[r["term"]], place[r["query_id"]]] = r["times"] * r["idf"] * (k1 + 1)
    shared = spark.sparkContext.broadcast((terms, matrix, words / n))

    def run(batches):
        terms, matrix, mean_length = shared.value
        add, rows = _keep_best(k, matrix.shape[1])
        for batch in batches:
            lists = batch.column("w")
            held = lists.value_lengths().to_numpy()
            coded = lists.flatten().dictionary_encode()
            column = np.array([terms.get(x, -1) for x in coded.dictionary.to_pylist()] or [-1])[coded.indices.to_numpy()] if len(coded) else np.zeros(0, int)
            row = np.repeat(np.arange(len(held)), held)
            row, column = row[column >= 0], column[column >= 0]
            for s in range(0, batch.num_rows, ROWS):
                e = min(s + ROWS, batch.num_rows)
                lo, hi = np.searchsorted(row, [s, e])
                tf = np.bincount((row[lo:hi] - s) * len(terms) + column[lo:hi], minlength=(e - s) * len(terms)).reshape(e - s, -1).astype(float)
                scores = np.round((tf / (tf + k1 * (1 - b + b * held[s:e, None] / mean_length))) @ matrix, 9)
                add(batch.column("id").to_numpy()[s:e], np.where(scores > 0, scores, -np.inf))
        yield _best_batch(*rows())

    return _named(t.mapInArrow(run, _BEST), ids, k)


def hashed_words(texts: list[str | None], size: int = 256) -> np.ndarray:
    """Bag-of-words vectors: each word counts in the place its md5 names."""
    known: dict[str, int] = {}
    out = np.zeros((len(texts), size))
    for i, x in enumerate(texts):
        for w in re.findall(r"[^\W]+", x.lower()) if x else ():
            at = known.get(w)
            if at is None:
                at = known[w] = int(hashlib.md5(w.encode()).hexdigest()[:2], 16) % size
            out[i, at] += 1
    return out


def dense_top(docs: DataFrame, queries: DataFrame, id_col: str, text: str, k: int, embed: Callable[[list], np.ndarray] = hashed_words) -> DataFrame:
    """(query_id, id, score, rank <= k) by cosine of ``embed``'s vectors; texts without a vector match nothing.

    The queries are the stated set, embedded once on the driver (MATRIX_CELLS bound them); documents are embedded where they are read.
    """
    spark = docs.sparkSession
    got = queries.select(F.col("query_id").cast("string").alias("query_id"), "text").limit(MATRIX_CELLS // 256 + 1).collect()
    if len(got) > MATRIX_CELLS // 256:
        raise ValueError("too many queries for one block; split the query set")
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    shared = spark.sparkContext.broadcast(unit(embed([r["text"] for r in got])) if got else np.zeros((0, 1)))

    def run(batches):
        q = shared.value
        add, rows = _keep_best(k, len(q))
        for batch in batches:
            for s in range(0, batch.num_rows, ROWS):
                part = batch.slice(s, ROWS)
                v = unit(embed(part.column("text").to_pylist()))
                scores = np.round(v @ q.T, 9)
                add(part.column("id").to_numpy(), np.where(v.any(axis=1)[:, None] & q.any(axis=1)[None, :], scores, -np.inf))
        yield _best_batch(*rows())

    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, _BEST)
    return _named(kept, [r["query_id"] for r in got], k)


#: Languages to fall back to, in order, when a query's own has nothing to offer (fixed values).
FALLBACK = {"en": ["en"], "ru": ["ru", "en"], "kk": ["kk", "ru", "en"]}


def hybrid(queries: DataFrame, docs: DataFrame, k: int = 3, rrf_k: int = 60, min_cosine: float = 0.30, books_weight: float = 1.0, embed: Callable[[list], np.ndarray] = hashed_words) -> DataFrame:
    """(query_id, id, score, rank <= k): passages for queries(query_id, text, lang, phase) out of docs(id, text, lang, phase, book).

    Three streams of max(8 k, 20) each (cosine over dialogues, BM25 over dialogues, BM25 over books) add up 1 / (rrf_k + rank).
    A passage must be in the query language's fallback chain; one that only cosine found must reach ``min_cosine``.
    The same phase gains 1 / rrf_k (books have none), each step down the chain costs half of that.  Of passages that
    agree in their first 80 characters the best stays.  A stream without documents just adds nothing.
    """
    pool = max(8 * k, 20)
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), "text", F.lower(F.trim("lang")).alias("q_lang"), F.col("phase").alias("q_phase"))
    talk, books = docs.where("not book"), docs.where("book")
    part = lambda df, w, cosine: df.select("query_id", "id", (F.lit(w) / (rrf_k + F.col("rank"))).alias("part"), cosine.alias("cosine"))
    none = F.lit(None).cast("double")
    streams = part(dense_top(talk, asked, "id", "text", pool, embed), 1.0, F.col("score")).unionByName(part(bm25_top(talk, asked, "id", "text", pool), 1.0, none)).unionByName(part(bm25_top(books, asked, "id", "text", pool), books_weight, none))
    fused = settle(streams.groupBy("query_id", "id").agg(F.sum("part").alias("rrf"), F.max("cosine").alias("cosine"), F.bool_or(F.col("cosine").isNull()).alias("by_words")), "fused")  # three pools a query
    chain = F.create_map(*[x for q, langs in FALLBACK.items() for x in (F.lit(q), F.array(*map(F.lit, langs)))])
    steps = F.array_position(F.coalesce(F.element_at(chain, F.col("q_lang")), F.array(F.col("q_lang"), F.lit("en"))), F.coalesce(F.lower(F.trim("lang")), F.lit("en"))) - 1
    passage = docs.select("id", F.col("text").alias("passage"), "lang", F.when(~F.col("book"), F.col("phase")).alias("phase"))
    t = passage.join(F.broadcast(fused), "id").join(F.broadcast(asked.select("query_id", "q_lang", "q_phase")), "query_id").withColumn("steps", steps)
    t = t.where((F.col("steps") >= 0) & (F.col("by_words") | (F.col("cosine") >= min_cosine)))
    score = F.col("rrf") + F.when(F.col("phase") == F.col("q_phase"), 1.0 / rrf_k).otherwise(0.0) - F.col("steps") * (0.5 / rrf_k)
    said = F.regexp_replace("passage", r"^\s+|\s+$", "")
    t = t.select("query_id", "id", F.round(score, 9).alias("score"), F.substring(F.lower(said), 1, 80).alias("start")).where("start <> ''")
    first = F.row_number().over(Window.partitionBy("query_id", "start").orderBy(F.desc("score"), "id"))
    return top_per_query(t.withColumn("_n", first).where("_n = 1").select("query_id", "id", "score"), k)


class Index:
    """A BM25 index kept in a folder: postings by term with the documents' lengths, terms with their idf, and the statistics."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def build(cls, docs: DataFrame, folder: str, id_col: str, text: str, eps: float = 0.25) -> Index:
        """Write the index; postings lie in files by ranges of terms, so that a query reads few of them."""
        made = cls(docs.sparkSession, folder)
        post, lengths, df = postings(docs, id_col, text)
        lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).write.mode("overwrite").parquet(f"{made.folder}/stats")
        post.join(lengths, "id").repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{made.folder}/postings")
        n = made.read("stats").select("n").scalar()
        raw = df.withColumn("raw", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        mean = raw.agg(F.avg("raw")).scalar()
        raw.select("term", "df", F.when(F.col("raw") < 0, eps * mean).otherwise(F.col("raw")).alias("idf")).write.mode("overwrite").parquet(f"{made.folder}/terms")
        return made

    def read(self, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{part}")

    def top(self, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """(query_id, id, score > 0, rank <= k) for queries(query_id, text); only the postings of their terms are read."""
        asked = settle(queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times")), "asked")
        terms = asked.join(self.read("terms"), "term").select("query_id", "term", (F.col("times") * F.col("idf") * (k1 + 1)).alias("weight"))
        few = asked.count() <= 100_000  # rows of about 100 bytes
        avgdl = self.read("stats").select("avgdl").scalar()
        share = F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
        post = self.read("postings").select("id", "term", share.alias("share"))
        scored = post.join(F.broadcast(terms) if few else terms, "term").groupBy("query_id", "id").agg(F.round(F.sum(F.col("weight") * F.col("share")), 9).alias("score"))
        return top_per_query(scored.where("score > 0"), k)


def top_per_query(scored: DataFrame, k: int) -> DataFrame:
    """The k best per query, ties by id; rank from 1."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse(streams: list[DataFrame], weights: list[float] | None = None, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (query_id, id, rank) streams; missing streams just aren't there."""
    parts = [s.select("query_id", "id", (F.lit(w) / (k + F.col("rank"))).alias("part")) for s, w in zip(streams, weights or [1.0] * len(streams), strict=True)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("query_id", "id").agg(F.sum("part").alias("score"))


def sufficiency(scored: DataFrame, fully: float, partially: float) -> DataFrame:
    """Per query: state of the evidence by its best score, with counts and the mean of what counts.

    ``scored`` has (query_id, score, consented, recent) per entry; queries with
    no consented or no recent entry say so.
    """
    usable = F.col("consented") & F.col("recent")
    g = scored.groupBy("query_id").agg(
        F.count_if("consented").alias("n_consented"), F.count_if(usable).alias("n_usable"), F.max(F.when(usable, F.col("score"))).alias("best"),
        F.count_if(usable & (F.col("score") >= fully)).alias("n_fully"), F.count_if(usable & (F.col("score") >= partially)).alias("n_partially"),
        F.avg(F.when(usable & (F.col("score") >= fully), F.col("score"))).alias("mean_fully"), F.avg(F.when(usable & (F.col("score") >= partially), F.col("score"))).alias("mean_partially"),
    )
    state = (
        F.when(F.col("n_consented") == 0, "data_excluded_by_consent").when(F.col("n_usable") == 0, "no_data_in_window").when(F.col("best") < partially, "below_threshold")
        .when(F.col("best") >= fully, "fully").otherwise("partially")
    )
    return g.select("query_id", state.alias("state"), F.when(state == "fully", F.col("n_fully")).when(state == "partially", F.col("n_partially")).otherwise(0).alias("n_evidence"), F.when(state == "fully", F.col("mean_fully")).when(state == "partially", F.col("mean_partially")).alias("similarity"))


def consensus(samples: DataFrame, group: str, id_col: str, vec_col: str) -> DataFrame:
    """(group, consensus, chosen): mean pairwise cosine of each group and its most central sample.

    With u the unit vectors and S their sum, the mean over pairs is
    (S.S - n) / (n (n - 1)) and a sample's mean against the others
    (u.S - 1) / (n - 1): two passes over rows, no pairs.  Groups of one sample
    have no consensus (null); ties of centrality go to the smaller id.
    """
    v = F.col(vec_col).cast("array<double>")
    norm = F.sqrt(dot(v, v))
    unit = samples.select(group, F.col(id_col).alias("id"), F.transform(v, lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0))).alias("u"))
    parts = unit.select(group, F.posexplode("u").alias("i", "x")).groupBy(group, "i").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    total = parts.groupBy(group).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda p: p["s"]).alias("S"))  # one entry per dimension
    pairs = F.col("n") * (F.col("n") - 1)
    central = F.round(F.try_divide(dot(F.col("u"), F.col("S")) - 1, F.col("n") - 1), 9)
    best = unit.join(total, group).groupBy(group).agg(F.max_by("id", F.struct(central, -F.col("id"))).alias("chosen"))
    return total.select(group, F.try_divide(dot(F.col("S"), F.col("S")) - F.col("n"), pairs).alias("consensus")).join(best, group)
