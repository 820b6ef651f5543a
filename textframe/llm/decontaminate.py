"""Benchmark decontamination: which documents hold which test items.

Words are lower-cased runs of letters and digits, shingles are five words. An item of fewer
words is one shingle of so many words, and is looked for among all runs of that many words
(at most four more widths, and only those that occur among the items). A document holds an
item if it has at least `threshold` (0.8) of the item's distinct shingles.

Candidates come from a size-partitioned MinHash sketch. Items are put into classes by
size (powers of two). An item's sketch is its `k` smallest shingle hashes, with k set by
the largest size of its class: one more than the shingles that may be missing. A document
that holds an item of s shingles lacks at most floor(s (1 - threshold)) of them, so it has
at least k less that many of its sketch: fewer is no candidate, and the search misses
nothing. Unlike the resemblance of whole sets, whether a sketched hash occurs in the
document does not depend on the document's length. Documents with too few shingles for the
class are left out. Candidates are then verified by counting exact shingles, as text: the
item's shingles are laid out for each candidate pair, and met by document and shingle, so
no shingle, however common, is a key of its own.

DataFrame functions only. What is made from the test items is broadcast while its measured
bytes are few, and joined by shuffling otherwise, where Spark splits skewed partitions.

Null or empty texts have no shingle: such items are held by nothing, such documents hold
nothing. Very long texts are read whole, as an array of words. Equal items are each found. Rows
with one id count as one document (or item); repeated rows change nothing; a null id is
an id like any other. Other columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textframe.llm._common import near, stored

WORDS = 5
THRESHOLD = 0.8


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _places(table: DataFrame, id_col: str, text_col: str, widths: Column) -> DataFrame:
    """A row for each shingle's place: (id, words, width, at, n), for each of a text's widths that it has enough words for."""
    words = table.select(F.col(id_col).alias("id"), _words(F.col(text_col)).alias("words")).filter(F.size("words") > 0)
    wide = words.select("id", "words", F.explode(widths).alias("width")).filter(F.size("words") >= F.col("width"))
    n = F.size("words") - F.col("width") + 1
    return wide.select("id", "words", "width", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("at"))


def _hash() -> Column:
    return F.xxhash64(*(F.when(F.col("width") > i, F.get("words", F.col("at") + i)) for i in range(WORDS)))


def _shingle() -> Column:
    return F.array_join(F.slice("words", F.col("at") + 1, F.col("width")), " ")


def shingles(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct (id, width, shingle, hash) of test items."""
    own = F.array(F.least(F.size("words"), F.lit(WORDS)))
    return _places(items, id_col, text_col, own).select("id", "width", _shingle().alias("shingle"), _hash().alias("hash")).distinct()


def sketches(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item, size, least, hash): the sketch of each item of `shingles`; least is the fewest shingles that hold one of its class.

    The items' shingles are ranked in an array sorted by hash, one array for each item.
    """
    sets = items.groupBy("id").agg(F.array_sort(F.collect_set("hash")).alias("hashes"), F.count(F.lit(1)).alias("size"))
    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.floor(F.log2("size")).cast("int"))
    k = F.floor((low * 2 - 1) * (1 - threshold) + 1e-9).cast("int") + 1
    must = F.least(k, F.size("hashes")) - F.floor(F.col("size") * (1 - threshold) + 1e-9)
    return sets.select(F.col("id").alias("item"), "size", F.ceil(low * threshold - 1e-9).alias("least"), F.greatest(must, F.lit(1)).alias("must"), F.explode(F.slice("hashes", 1, k)).alias("hash"))


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment) for each document that holds an item."""
    item_shingles = stored(shingles(items, item_id, text_col), "item-shingles")
    widths = F.array(*(F.lit(x) for (x,) in item_shingles.select("width").distinct().orderBy("width").collect()))  # five at most
    sketch = stored(sketches(item_shingles, threshold), "sketches")
    places = _places(docs, doc_id, text_col, widths.cast("array<int>"))
    met = places.select("id", "n", _hash().alias("hash")).join(near(sketch), "hash").filter(F.col("n") >= F.col("least"))
    # within a task first: a shingle that a document repeats, or many documents share, is few rows before the shuffle
    met = met.select("id", "item", "size", "must", "hash").distinct().groupBy("id", "item", "size", "must").agg(F.count(F.lit(1)).alias("met"))
    pairs = stored(met.filter("met >= must").select("id", "item", "size"), "candidates")
    wanted = stored(pairs.select(F.col("id").alias("wanted")).distinct(), "wanted")
    some = docs.select(F.col(doc_id).alias("id"), F.col(text_col).alias("text"))
    some = some.join(near(wanted), F.col("id").eqNullSafe(F.col("wanted")), "left_semi")
    held = _places(some, "id", "text", widths.cast("array<int>")).select(F.col("id").alias("of"), _shingle().alias("held")).distinct()
    theirs = near(pairs).join(item_shingles.select(F.col("id").alias("part"), "shingle"), F.col("item").eqNullSafe(F.col("part")))
    shared = theirs.join(held, F.col("id").eqNullSafe(F.col("of")) & (F.col("shingle") == F.col("held")))
    counts = shared.groupBy("id", "item", "size").agg(F.count(F.lit(1)).alias("n_shared"))
    share = F.col("n_shared") / F.col("size")
    return counts.filter(share >= threshold - 1e-9).select(F.col("id").alias(doc_id), F.col("item").alias(item_id), "n_shared", F.col("size").alias("n_shingles"), share.alias("containment"))


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """docs without those that hold an item; columns stay."""
    found = stored(contained(docs, items, doc_id=doc_id).select(F.col(doc_id).alias("_held")).distinct(), "held")
    return docs.join(near(found), docs[doc_id].eqNullSafe(found["_held"]), "left_anti")


SQL = r"""
WITH v AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS words FROM benchmark),
i AS (SELECT DISTINCT item_id, array_to_string(words[pos:pos + 4], ' ') AS shingle
      FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS pos FROM v WHERE len(words) > 0)),
k AS (SELECT DISTINCT least(len(words), 5) AS width FROM v WHERE len(words) > 0),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS words FROM documents),
d AS (SELECT DISTINCT doc_id, array_to_string(words[pos:pos + width - 1], ' ') AS shingle
      FROM (SELECT doc_id, words, width, unnest(range(1, len(words) - width + 2)) AS pos FROM w, k WHERE len(words) >= width)),
n AS (SELECT item_id, count(*) AS n_shingles FROM i GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, max(n_shingles) AS n_shingles, count(*) / max(n_shingles) AS containment
FROM d JOIN i USING (shingle) JOIN n USING (item_id)
GROUP BY doc_id, item_id
HAVING count(*) >= 0.8 * max(n_shingles)
"""
