"""The pN_ queries over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.form_duplicates import collapse, form_duplicates
from corpusmill.llm import language, leakage, mixing, pairs, quota_sample, residue, split_overlap, tokens, truncation
from corpusmill.runtime import load, scratch

Query = Callable[[SparkSession, str], DataFrame]


def _residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_messages(residue.all_messages(load(spark, sf_dir, "v12_ru_dialogues"), load(spark, sf_dir, "endpoint_baseline")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _residue(spark, sf_dir).select("tbl", "row_key", "msg_idx")


def p1_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residue messages by table and kind."""
    return _residue(spark, sf_dir).groupBy("tbl", "residue").count()


def p1_clean_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.without_residue(load(spark, sf_dir, "v12_ru_dialogues"), load(spark, sf_dir, "endpoint_baseline"))[1].select("resp_id", "response")


def p1_clean_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.without_residue(load(spark, sf_dir, "v12_ru_dialogues"), load(spark, sf_dir, "endpoint_baseline"))[0].select("rec_id", "messages")


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.corpus_units(*(load(spark, sf_dir, t) for t in ("val", "documents", "v13_shape_synth", "sources")))


_TOKEN_DIMS = ["tbl", "source", "lang", "domain"]


def _ledger(spark: SparkSession, sf_dir: str) -> tokens.TokenLedger:
    """A ledger of two updates: what had arrived by the start of the last month, then everything."""
    units = _units(spark, sf_dir)
    book = tokens.TokenLedger(spark, f"{scratch(spark, 'token-ledger')}", ["tbl", "row_key"], _TOKEN_DIMS)
    until = units.agg(F.date_trunc("month", F.max("arrived"))).scalar()
    book.update(units.where(F.col("arrived").isNull() | (F.col("arrived") < until)))
    book.update(units)
    return book


def p2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each row of val, documents and v13_shape_synth, from the ledger."""
    return _ledger(spark, sf_dir).snapshot().drop("content_hash")


def p2_token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, language and domain and all coarser slices, from the ledger's cube."""
    return tokens.rollups(_ledger(spark, sf_dir).cube(), _TOKEN_DIMS)


def p2_slice_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each slice of the ledger's cube."""
    return _ledger(spark, sf_dir).cube().select(*_TOKEN_DIMS, "n_rows")


def p2_repeats_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each slice loses once repeated contents are taken out: the signed deltas of a third update."""
    book = _ledger(spark, sf_dir)
    book.remove(tokens.repeated(book.snapshot().select("content_hash", F.struct("tbl", "row_key").alias("_id"))))
    return book.changes()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return form_duplicates(load(spark, sf_dir, "v12_ru_dialogues"))


def p3_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(load(spark, sf_dir, "v12_ru_dialogues")).withColumnRenamed("id", "rec_id")


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_overlap.overlaps(load(spark, sf_dir, "val"), load(spark, sf_dir, "train"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlaps(spark, sf_dir).select(F.least("held_id", "train_id").alias("row_id_a"), F.greatest("held_id", "train_id").alias("row_id_b"))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps per split and source: pairs, held-out rows touched, exact pairs."""
    val = load(spark, sf_dir, "val").select(F.col("row_id").alias("held_id"), "split_name", "source")
    t = _overlaps(spark, sf_dir).groupBy("held_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("share") == 1.0).alias("n_exact")).join(val, "held_id")
    return t.groupBy("split_name", "source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_pairs").alias("n_pairs"), F.sum("n_exact").alias("n_exact"))


def _defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defects(load(spark, sf_dir, "v12_ru_dialogues"), load(spark, sf_dir, "endpoint_baseline"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.single(_defects(spark, sf_dir))


def p5_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All defects of each pair with their posteriors."""
    return pairs.labels(_defects(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.mislabelled(load(spark, sf_dir, "v13_shape_synth"))


def p6_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of every record with confidences."""
    t = language.relabel(load(spark, sf_dir, "v13_shape_synth"))
    return t.select("rec_id", "given", F.explode_outer("langs").alias("l")).select("rec_id", "given", "l.lang", "l.words", "l.confidence")


def p6_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of the records that hold several languages."""
    synth = load(spark, sf_dir, "v13_shape_synth")
    model = language.synth_model(synth)
    mixed = language.relabel(synth, model).where("size(langs) > 1").select("rec_id")
    return language.segment_rows(synth.join(mixed, "rec_id", "left_semi"), "rec_id", language.contents(), model).withColumnRenamed("id", "rec_id")


def _fields() -> dict:
    return {k: F.col(f"meta.{k}") for k in ("locale", "state", "persona")}


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that the drawn sample doesn't meet though it took every row of the category."""
    rows, targets = load(spark, sf_dir, "v13_shape_synth"), load(spark, sf_dir, "sample_targets")
    drawn = quota_sample.sample(rows, targets, _fields(), F.col("shape"), "rec_id")
    return quota_sample.report(rows, targets, _fields(), drawn).where("short").select("field_name", "category")


def p7_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, targets = load(spark, sf_dir, "v13_shape_synth"), load(spark, sf_dir, "sample_targets")
    return quota_sample.sample(rows, targets, _fields(), F.col("shape"), "rec_id").withColumnRenamed("id", "rec_id")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, targets = load(spark, sf_dir, "v13_shape_synth"), load(spark, sf_dir, "sample_targets")
    drawn = quota_sample.sample(rows, targets, _fields(), F.col("shape"), "rec_id")
    return quota_sample.report(rows, targets, _fields(), drawn)


def p7_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each category's rows in the sample are what is needed and available, rounded down or up."""
    goal = F.least("needed", F.col("available").cast("double"))
    return p7_shares(spark, sf_dir).select("field_name", "category", "available", F.col("drawn").between(F.floor(goal), F.ceil(goal)).alias("kept"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "cross_topic_regression"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).where("exact").select("doc_id", "item_id")


def p8_reparameterised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item's passage with other numbers, names or units put in consistently."""
    return _leaks(spark, sf_dir).where("not exact and reparameterised").select("doc_id", "item_id", "n_windows")


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that leaked and into how many documents."""
    return _leaks(spark, sf_dir).where("exact").groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs, targets = load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets")
    return docs, mixing.rates(mixing.source_tokens(docs, targets), targets)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1].where("short").select("source")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(*_mix(spark, sf_dir))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(*_mix(spark, sf_dir))


def p9_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source, and whether the mix uses each floor(rate) times or once more, within max_repeats."""
    docs, rates = _mix(spark, sf_dir)
    used = mixing.mix(docs, rates).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    all_ = docs.select("doc_id", "source").join(rates.select("source", "rate", "cap"), "source").join(used, "doc_id", "left").fillna(0, ["n"])
    within = F.col("n").between(F.floor("rate"), F.floor("rate") + 1) & (F.col("n") <= F.col("cap"))
    return all_.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.every(within).alias("within"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(load(spark, sf_dir, "documents")).select("doc_id")


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source truncates."""
    docs = load(spark, sf_dir, "documents")
    cut = truncation.truncated(docs).select("doc_id", F.lit(1).alias("cut"))
    t = docs.select("doc_id", "source").join(cut, "doc_id", "left")
    return t.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count("cut").alias("n_cut"), F.avg(F.coalesce("cut", F.lit(0))).alias("rate"))


def queries() -> dict[str, Query]:
    found = {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit() and callable(v)}
    return dict(sorted(found.items(), key=lambda kv: (int(kv[0][1:].split("_")[0]), kv[0])))


def oracle_sql() -> dict[str, str]:
    from corpusmill.llm import oracles

    return oracles.oracle_sql()
