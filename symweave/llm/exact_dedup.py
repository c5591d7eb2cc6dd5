"""Exact deduplication by content-defined chunk recipes, with DataFrame functions only.

A text is cut where its own content says so: after at least MIN_CHARS characters, behind the next white space that
follows one of a fixed set of letter pairs, and after MAX_CHARS at the latest. Each chunk gets an identifier (xxhash64)
and its SHA-256; a dictionary over all chunks verifies that no identifier stands for two digests. A text's recipe is the
ordered list of its chunks' identifiers. As cutting is deterministic and identifiers are verified, two texts are equal
exactly if their recipes are. Texts are cut once and never shuffled, nor are chunks: the dictionary moves an identifier and a digest for each
different chunk of a task, and only recipes (8 bytes for some 600 characters) are then grouped and joined.

If the dictionary finds two chunks under one identifier, all recipes are built again with the next, wider kind of
identifier (xxhash64 with SHA-256) and verified again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, scratch, stored, without

MIN_CHARS, MAX_CHARS = 512, 8192
CUT = r"(?<=[dhlptx][aeimnrsuy]\s)"

Identifier = Callable[[Column], Column]
IDENTIFIERS: tuple[Identifier, ...] = (
    F.xxhash64,
    lambda chunk: F.concat(F.hex(F.xxhash64(chunk)), F.sha2(chunk, 256)),
)


def chunks(text: Column, least: int = MIN_CHARS, most: int = MAX_CHARS) -> Column:
    """Array of a text's chunks; joined, they are the text. An empty text has none."""
    pattern = f"(?s).{{{least},{most}}}?{CUT}|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def recipes(docs: DataFrame, identifier: Identifier, least: int = MIN_CHARS, most: int = MAX_CHARS) -> DataFrame:
    """doc_id, text_sha256, recipe, digests (of the recipe's chunks) for each row of docs."""
    text = F.coalesce("text", F.lit(""))
    cut = docs.select(F.col("doc_id"), F.sha2(text, 256).alias("text_sha256"), chunks(text, least, most).alias("chunks"))
    digests = F.transform("chunks", lambda chunk: F.unhex(F.sha2(chunk, 256)))
    return cut.select("doc_id", "text_sha256", F.transform("chunks", lambda chunk: identifier(chunk)).alias("recipe"), digests.alias("digests"))


def clashes(recipes: DataFrame) -> bool:
    """Whether two different chunks of the corpus have the same identifier."""
    dictionary = recipes.select(F.explode(F.arrays_zip("recipe", "digests")).alias("chunk")).select("chunk.recipe", "chunk.digests").distinct()
    return not dictionary.groupBy("recipe").count().filter("count > 1").isEmpty()


def verified_recipes(docs: DataFrame, identifiers: Sequence[Identifier] = IDENTIFIERS, least: int = MIN_CHARS, most: int = MAX_CHARS) -> DataFrame:
    """doc_id, text_sha256, recipe, digests: a row for each row of docs."""
    for identifier in identifiers:
        found = stored(recipes(docs, identifier, least, most), "recipes")
        if not clashes(found):
            return found
    raise ValueError("every kind of identifier has two chunks under one value")


def exact_dedup(docs: DataFrame, identifiers: Sequence[Identifier] = IDENTIFIERS, least: int = MIN_CHARS, most: int = MAX_CHARS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chunks for each row of docs (which needs doc_id and text).

    Null texts count as empty, and all empty texts are equal. The row with the largest doc_id stays; rows that repeat a
    doc_id with an equal text are one document, stay or go together and each count in group_size. A null doc_id is less than
    any other: it stays only where its whole group has none. Columns beyond doc_id and text are ignored, whatever
    their names; an empty table gives an empty result. A third of all rows in one group is pre-aggregated in each task,
    and the join back to the stored groups is a plain equi-join whose hot partitions adaptive execution splits.
    """
    found = verified_recipes(docs, identifiers, least, most)
    groups = stored(found.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    return found.drop("digests").join(groups, "recipe").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", F.size("recipe").cast("long").alias("n_chunks")
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts, that of the largest doc_id; all columns as they were.

    A row is told by its doc_id and text: a doc_id that repeats with another text is another document. Of rows that repeat both one stays,
    and of a group without any doc_id, too. Null and empty texts are equal. An empty table stays empty.
    """
    with scratch(docs.sparkSession):
        found = exact_dedup(docs).filter("group_size > 1").select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex("text_sha256").alias("text_key"), "kept")
        keys = stored(found.groupBy("doc_id", "text_key", "kept").count(), "copies")
        gone = stored(keys.filter("NOT kept").select("doc_id", "text_key"), "gone", keep=True)
        return without(docs, gone, stored(keys.filter("kept AND count > 1").select("doc_id", "text_key"), "repeated", keep=True))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).drop("n_chunks")


OP3_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
     g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.text) AS text_sha256
FROM t JOIN g ON t.text = g.text
"""
