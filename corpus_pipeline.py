"""From raw documents to encoded training text, in five stages over what the stage before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
documents. Between stages the rows are written and read again, so no stage computes another's work twice.

Cases, for every stage: an empty table gives an empty result; columns other than those a stage names pass
untouched, whatever they are called; rows are judged one by one or by their groups, never by their order. What a
stage does with nulls, blank texts and repeated rows is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import exact_dedup, minhash, mixing, quality, sentence_pieces
from corpusloom.llm.common import read, release_stashes, stash, stashes_made
from corpusloom.llm.queries import PIECES


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Reads text, and doc_id to find labels. A null text is judged as an empty one, a null doc_id has no label; equal
    texts are all kept or all rejected; without any label every document stays.
    """
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts.

    Reads text and doc_id. Null and blank texts are one group; the longest original stays, then the smallest doc_id,
    null last; of rows that are equal in both exactly one stays.
    """
    return exact_dedup.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    Reads text and doc_id. Documents without any word are near nothing and all stay; a text of fewer than five words
    is near its equals only; the smallest doc_id of a group stays, with all rows that have it; of a group of null ids only
    the text of the least digest stays, with all rows equal to it.
    """
    return minhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Reads text, source and doc_id. A null source is a source, the last one; documents without words have size 0 and
    go with the words around them; rows that are equal in doc_id are taken together.
    """
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, round_trip: a row for every document.

    Reads doc_id and text. A null text counts as empty and has no tokens; round_trip is true where decoding gives the text back.
    """
    return sentence_pieces.encode(docs, PIECES)


STAGES = [
    ("quality_classifier", quality_filter),
    ("exact_dedup", exact_copies),
    ("minhash_near_dedup", near_copies),
    ("source_mixing", mix_sources),
    ("sentence_pieces", encode_pieces),
]

#: The first stage is a fitted model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what a stage has stashed goes once its own rows are written."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        first = stashes_made()
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs, name)
            release_stashes(first, stashes_made() - 1)
    return docs
