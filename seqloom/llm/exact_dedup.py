"""Exact deduplication by content-defined chunk recipes, in DataFrame operations only.

A text is cut where its own characters say so: a chunk ends behind the first pair of characters, after LEAST of them, of which
one is in ENDS and the other in STARTS. An insertion therefore moves the cuts near it only, and texts that share passages share
chunks. Chunks are deduplicated once: one row for each digest and content moves, however many documents have it (map-side
combining leaves one a task). A digest that stands for one content is a verified identifier of the chunk. A text's recipe is the
ordered list of its identifiers, about two hundredths of its bytes, and texts are equal when their recipes are; nothing after
the chunk table moves a text again.

Should a digest stand for several contents, chunks under it are identified by their content instead: it is put into the recipe
of the documents that have it. With 128 bits nobody will see this; the tests do, with digests of two bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.store import columns, discard, materialize

#: Characters of a chunk. The end is looked for between the two; a text without one is cut at the most.
LEAST, MOST = 512, 8192
#: A chunk ends with one of the first and one of the second (or with a full stop of CJK writing), about once in 120 characters of prose.
ENDS, STARTS, STOPS = r"[\s,.;:!?\-]", r"[acgmqvxzACGMQVXZ0369à-ïа-з؀-دऀ-ठ]", r"[。，！？]"
CHUNK = rf"(?s).{{{LEAST},{MOST - 2}}}?(?:{ENDS}{STARTS}|{STOPS})|.{{1,{MOST}}}"
#: Ambiguous digests that are broadcast to find the chunks under them; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
RESULTS = ("keep_id", "group_size", "kept", "text_sha256")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """The text with A-Z lowered; a null is empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)


def chunks_of(text: Column) -> Column:
    """The chunks of a text in order; put together they are the text. An empty text has none."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def _digests(chunk: Column, bits: int) -> tuple[Column, Column]:
    """The two halves of a chunk's digest."""
    if bits >= 128:
        return F.xxhash64(chunk), F.xxhash64(F.lit(1), chunk)
    return F.xxhash64(chunk).bitwiseAND(F.lit((1 << min(bits, 63)) - 1)), F.lit(0).cast("long")


def _recipe(chunks: Column, bits: int) -> Column:
    """First halves of the chunks' digests in order, then second halves."""
    return F.concat(F.transform(chunks, lambda c: _digests(c, bits)[0]), F.transform(chunks, lambda c: _digests(c, bits)[1]))


def chunk_table(docs: DataFrame, text_col: str = "text", digest_bits: int = 128) -> DataFrame:
    """(d1, d2, chunk) of every different chunk of the texts."""
    each = docs.select(F.explode(chunks_of(normalised(F.col(f"`{text_col}`")))).alias("chunk"))
    d1, d2 = _digests(F.col("chunk"), digest_bits)
    return each.select(d1.alias("d1"), d2.alias("d2"), "chunk").distinct()


def _contents(rows: DataFrame, ambiguous: DataFrame, few: bool, bits: int) -> DataFrame:
    """(_of, _contents) of the rows that have chunks under an ambiguous digest: these chunks' places and contents, in order."""
    each = rows.select("_row", F.posexplode(chunks_of(F.col("_text"))).alias("at", "chunk"))
    d1, d2 = _digests(F.col("chunk"), bits)
    under = each.withColumns({"d1": d1, "d2": d2}).join(F.broadcast(ambiguous) if few else ambiguous, ["d1", "d2"], "left_semi")
    return under.groupBy(F.col("_row").alias("_of")).agg(F.array_sort(F.collect_list(F.struct("at", "chunk"))).alias("_contents"))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), digest_bits: int = 128, results: tuple[str, ...] = RESULTS
) -> DataFrame:
    """Find rows whose texts are identical after lowering A-Z.

    Returns one row for each row of `docs`: the columns in `carry` as they are, keep_id (the largest id among the rows of equal
    text), group_size (their number), kept, and text_sha256 of the normalised text. One row of each group is kept: the one with
    the largest id; of rows that repeat that id too, exactly one of them, no matter which, as they are alike. A null id is smaller
    than any other. Null texts count as empty, and all empty texts are equal. A text of any length is one recipe in one row;
    an empty table gives none. Other columns are ignored, whatever their names; of carried columns with the names above the
    results win, unless `results` gives others to these four.
    """
    own = columns(carry)
    text = normalised(F.col(f"`{text_col}`"))
    rows = docs.select(*[c.alias(f"_c{i}") for i, c in enumerate(own.values())], F.col(f"`{id_col}`").alias("_id"), F.monotonically_increasing_id().alias("_row"), text.alias("_text"))
    several = chunk_table(docs, text_col, digest_bits).groupBy("d1", "d2").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("d1", "d2")
    ambiguous = materialize(several, "chunk-ambiguous")
    found = ambiguous.limit(BROADCAST_ROWS + 1).count()
    if found:
        rows = materialize(rows, "chunk-texts")  # numbers of rows must not change while contents are put to them
    recipes = rows.select(*[c for c in rows.columns if c != "_text"], _recipe(chunks_of(F.col("_text")), digest_bits).alias("_recipe"), F.sha2("_text", 256).alias("_sha"))
    if found:
        recipes = recipes.join(_contents(rows, ambiguous, found <= BROADCAST_ROWS, digest_bits), F.col("_row") == F.col("_of"), "left").drop("_of")
    recipes = materialize(recipes, "chunk-recipes")
    discard(ambiguous)
    if found:
        discard(rows)

    by = ["_recipe", "_contents"] if found else ["_recipe"]
    groups = recipes.groupBy(*[F.col(c).alias(f"_of{c}") for c in by]).agg(F.count("*").alias("_size"), F.max(F.struct("_id", "_row")).alias("_last")).where(F.col("_size") > 1)
    # Written first, so that the join has an exchange on either side and adaptive execution can split a hot recipe.
    groups = materialize(groups, "chunk-groups")
    same = F.col("_recipe") == F.col("_of_recipe")
    if found:
        same &= F.col("_contents").eqNullSafe(F.col("_of_contents"))
    out = recipes.join(groups, same, "left")
    alone = F.col("_size").isNull()
    values = [F.when(alone, F.col("_id")).otherwise(F.col("_last._id")), F.coalesce("_size", F.lit(1)), alone | (F.col("_row") == F.col("_last._row")), F.col("_sha")]
    taken = {x.lower() for x in results}
    kept = [F.col(f"_c{i}").alias(c) for i, c in enumerate(own) if c.lower() not in taken]
    return out.select(*kept, *[c.alias(name) for c, name in zip(values, results, strict=True)])


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts among all of `documents`."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = {
    "op11_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents)
        WINDOW same AS (PARTITION BY t)
    """
}
QUERIES = {"op11_exact_dedup": op11_exact_dedup}
