"""From raw documents to piece ids: toxic documents go, copies and near copies go, sources are mixed, texts encoded.

The rows of run() in order of their position are the mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
Between stages the rows are written as Parquet and read again. A document is a row, whatever its id: rows are told
apart by id and text, so rows that share an id, or have none, are judged each by its own text, and of rows that agree in
both exactly one stays once copies are dropped. Rows that lose their text to no decision are never dropped.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haggle.llm.common import clear, mark, staged, table
from haggle.llm.exact_dedup import exact_dedup
from haggle.llm.mixing import mix
from haggle.llm.near_copies import near_copies
from haggle.llm.pieces import encode
from haggle.llm.toxicity import fit, toxicity

#: A document goes if its worst window is at least so likely toxic.
TOXIC = 0.5
#: The column of the result whose order is that of the mixture; it has gaps.
POSITION = "position"


def _only_kept(docs: DataFrame, verdict: DataFrame) -> DataFrame:
    """docs by a verdict (doc_id, text_sha256, kept, copies): what is not kept goes, and of rows that agree in id and text one stays.

    Verdicts grow with the corpus, so the joins are sorted ones at every size; their keys are shared by repeated rows only.
    """
    own = [F.col(c) for c in docs.columns]
    by_text = docs.select(F.struct(*own).alias("row"), F.col("doc_id").alias("own_id"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("own_sha"))
    told = verdict.select("doc_id", "text_sha256", "kept", "copies")
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_sha") == F.col("text_sha256"))
    out = by_text.join(told.where("not kept or copies > 1").hint("merge"), same, "left_anti").select("row.*")
    repeated = told.where("kept and copies > 1")
    if repeated.isEmpty():
        return out
    one = by_text.join(repeated.hint("merge"), same, "left_semi").groupBy("own_id", "own_sha").agg(F.any_value("row").alias("row"))
    return out.unionByName(one.select("row.*"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC."""
    scored = toxicity(docs, fit(docs, table(spark, sf_dir, "labels")), score_col="toxicity_of_text")
    return scored.where(F.col("toxicity_of_text") < TOXIC).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    verdict = exact_dedup(docs).groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("copies"))
    return _only_kept(docs, staged(verdict.where("not kept or copies > 1"), "verdict"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document with the smallest id.

    SimHash gives the candidates, and five-word shingles decide (Jaccard 0.8 or more); MinHash bands add those that differ in more than three bits.
    """
    return _only_kept(docs, staged(near_copies(docs), "verdict"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture: files, and rows in them, follow its slots."""
    mixed = mix(docs, carry=docs.columns).select("slot", "place", "row")
    return mixed.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select("row.*")


def _with_position(docs: DataFrame) -> DataFrame:
    """docs with POSITION. Of documents read from Parquet it grows with the number of the part file, then the row in it; else with the row."""
    try:
        part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)-", 1).cast("long")
        return docs.select("*", (F.shiftleft(part, 40) + F.col("_metadata.row_index")).alias("_position"))
    except AnalysisException:  # not a table of files
        return docs.withColumn("_position", F.monotonically_increasing_id())


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, whether they decode to it, and its position in the mixture."""
    placed = _with_position(docs).select("doc_id", "lang", "source", F.col("_position").alias(POSITION), F.coalesce("text", F.lit("")).alias("text"))
    encoded = encode(placed, decoded_col="decoded")
    return encoded.select("doc_id", "lang", "source", POSITION, F.size("ids").alias("n_pieces"), "ids", (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("sentencepiece", to_pieces),
]

#: A trained network and XXH64 fingerprints can't be written in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = table(spark, sf_dir, "documents"), mark()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, "stage")
            clear(spark, since, keep=docs)  # what the stage has written on its way, and its input
    return docs
