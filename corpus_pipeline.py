"""A training corpus from raw documents: filter, deduplicate, cut repeats, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet before the next stage starts:
a stage removes the scratch tables of the one before and has executors drop their garbage, the end of the application
removes what is left. All but the last return the columns of ``documents``. Each stage takes nulls, repeated ids and empty
tables as its operator does.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.llm import common, mixing, packing, signature, substring, toxicity

_OF_STAGES: list[str] = []


def _stage(work):
    def run(spark, docs, sf_dir):
        common.ready(spark)
        common.release(spark, _OF_STAGES)
        common.rested(spark)
        before = len(common.opened())
        try:
            return work(spark, docs, sf_dir)
        finally:
            _OF_STAGES.extend(common.opened()[before:])
            del common.opened()[before:]

    return run


def drop_toxic(spark, docs, sf_dir):
    """Documents that the model, learned from the labels of documents at hand, calls toxic go."""
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=True).where("score < 0.5").select("row.*")


def drop_near_duplicates(spark, docs, sf_dir):
    """Of documents connected by a Jaccard similarity of 0.8 of five-word shingles, the smallest id stays; of rows that
    repeat an id and a text, one: the least by its other columns. Rows without an id stay."""
    found = common.stored(signature.jaccard_components(docs, k=5, num=4, den=5).where("doc_id IS NOT NULL"), "found")
    gone = common.stored(found.where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    repeated = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    # most rows stay where they are: a filter tells which may have to go or be one of several
    slots = common.stored(common.slots_of(gone.union(repeated), "doc_id"), "slots")
    known = docs.where(F.col("doc_id").isNotNull())
    doubtful = common.maybe_in(known, F.col("doc_id"), slots).join(gone, "doc_id", "left_anti").select(*docs.columns)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = doubtful.groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("x")) if rest else doubtful.distinct()
    one = one.select("doc_id", "text", "x.*").select(*docs.columns) if rest else one
    return common.not_in(known, F.col("doc_id"), slots).union(one).union(docs.where(F.col("doc_id").isNull()))


def cut_repeats(spark, docs, sf_dir):
    """Passages that a document of smaller id has are cut; documents of which nothing is left go."""
    return substring.cut(docs)


def mix_sources(spark, docs, sf_dir):
    """Sources come to their target weights: whole copies of documents, and the cut one."""
    return mixing.copies(mixing.mix(docs, keep=True), docs.columns)


def pack_sequences(spark, docs, sf_dir):
    """Pieces of documents in sequences of at most 4096 tokens."""
    import public_tokenizers

    items = common.stored(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")), "pieces")
    return packing.pack(items).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", _stage(drop_toxic)),
    ("near_duplicates", _stage(drop_near_duplicates)),
    ("substring_dedup", _stage(cut_repeats)),
    ("mixing", _stage(mix_sources)),
    ("packing", _stage(pack_sequences)),
]

#: The learned toxicity model and the tokenizer are beyond SQL; tests/llm/test_pipeline.py checks the stages.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages on ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    root = common.scratch(spark, "pipeline")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{root}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{root}/{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
