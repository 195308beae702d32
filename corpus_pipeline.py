"""From raw documents to a mixed, encoded training corpus.

Each stage takes (spark, docs, sf_dir), with docs the whole output of the stage before, and returns a DataFrame; all but
the last return the columns of documents. ``run`` writes every stage as Parquet to the shared folder and reads it
again, so lineage stays short and each stage survives lost executors.

1. language: documents without a recognisable language go.
2. near_duplicates: one document of each group of near copies stays.
3. personal_data: spans of personal data are replaced by their kind.
4. mix: sources are mixed to target weights; rows of small sources repeat, the table is written in the order of the mix.
5. pieces: texts become arrays of SentencePiece ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm import langid, minhash, mix, pieces, pii
from sievewright.llm.queries import PIECES, shuffled, vocabulary_path
from sievewright.session import stage

#: A document whose largest language explains less than this share of it has no recognisable language.
LEAST_SHARE = 0.35


def _renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Documents with column names that clash with none of an operator's, and the new name of each column."""
    names = {c: f"column{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _as_before(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(new).alias(old) for old, new in names.items()])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled documents; drop those that are `und` or spread over many languages.

    NULL and letterless texts are `und`. Without any labelled text nothing can be recognised, so nothing is judged
    and all documents with letters stay.
    """
    model = langid.train(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    safe, names = _renamed(docs)
    judged = langid.predict(safe, model, names["text"])
    kept = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SHARE)
    return _as_before(judged.filter(kept), names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of every component, once.

    Where rows of that id have different texts, each text stays once.
    Texts without words have no copies. Documents without an id are never linked and stay.
    """
    kept = minhash.near_duplicates(docs).filter("kept and doc_id is not null").select("doc_id").distinct()
    # rows of one id with different texts are different documents; of equal texts one stays
    texts = [F.xxhash64(F.lit(seed), F.coalesce("text", F.lit(""))) for seed in (0, 1)]
    safe, names = _renamed(docs.join(kept, "doc_id", "left_semi").select(*docs.columns, *[t.alias(f"__t{i}") for i, t in enumerate(texts)]))
    one = _as_before(safe.dropDuplicates([names["doc_id"], names["__t0"], names["__t1"]]), {c: names[c] for c in docs.columns})
    return one.unionByName(docs.filter("doc_id is null")).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data; every document stays, and n_chars follows the new text (NULL text: as it was)."""
    clean = pii.redact(docs)
    n = F.coalesce(F.length("text").cast("long"), F.col("n_chars"))
    return clean.withColumn("n_chars", n).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, small sources more often, in the order of the mix.

    NULL is a source like any other; rows of one id follow each other in no stated order; an empty table stays empty.
    """
    safe, names = _renamed(docs)
    ordered = mix.mix_rows(safe, shuffled(names["doc_id"]), names["source"])
    return _as_before(ordered.repartitionByRange("position").sortWithinPartitions("position"), names)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_pieces, ids) of every row; NULL and empty texts have no ids."""
    vocabulary = pieces.load(vocabulary_path(PIECES))
    ids = pieces.encode(docs, vocabulary, keep=["doc_id", "source"])
    return ids.select("doc_id", "source", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data),
    ("mix", mixed), ("pieces", encoded),
]

#: Language models, arithmetic on suffix arrays and Pfair schedules have no statement in SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
