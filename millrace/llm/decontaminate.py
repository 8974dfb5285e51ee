"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations alone.

The question is which short items lie in long documents: at least `threshold` of an item's distinct five-word shingles
occur in the document. Plain MinHash cannot tell (the Jaccard similarity of a sentence and a book is near 0), so the
sketch is one-sided. Items are partitioned by their number of shingles; an item of n shingles is sketched by its
k = n - ceil(threshold * n) + 1 least hashes, k being largest for the partition's upper bound. A document that holds
threshold * n of the shingles misses at most n - ceil(threshold * n) of them, so it holds one of the sketch: the search
has no false negatives. Documents probe all their shingles' hashes against the sketches; the pairs found are
verified by exact containment of the shingles themselves.

Words are cut at white space, unchanged. Defined cases: a null text is empty; a text of fewer words than a shingle is
one shingle of all its words, and one without words has none and is in no pair; null ids are kept in no pair; rows of one
id count as one, which holds what any of them holds; very long texts are searched whole; a containment of exactly the
threshold counts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_digest

WORDS, THRESHOLD = 5, 0.8
#: Sketch rows up to which they are sent to every executor (16 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Item sizes grow by this factor from partition to partition.
STEP = 1.25


def _words(text):
    return F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")


def _plain(text):
    """Lower case, without the punctuation at the edges of words."""
    return F.regexp_replace(F.lower(text), r"(?<![^ \t-\r])[^\p{L}\p{M}\p{N} \t-\r]+|[^\p{L}\p{M}\p{N} \t-\r]+(?![^ \t-\r])", "")


def _shingle_strings(words, n: int):
    """The distinct shingles as strings; words hold no white space, so joining by spaces is one to one.

    `words` is the name of a column made by an earlier select: an expression would be evaluated anew for each shingle."""
    words = F.col(words)
    last = F.greatest(F.size(words) - (n - 1), F.lit(1))
    made = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) > 0, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


def _shingle_hashes(words, n: int):
    """Hashes of all shingles, an array; fewer words than n: one of all. `words` as above."""
    from functools import reduce

    words = F.col(words)
    many = F.transform(F.slice(words, 1, F.greatest(F.size(words) - (n - 1), F.lit(0))), lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, n)]))
    few = reduce(lambda a, m: F.when(F.size(words) == m, F.array(F.xxhash64(*[F.get(words, F.lit(k)) for k in range(m)]))).otherwise(a), range(1, n), F.array().cast("array<long>"))
    return F.when(F.size(words) >= n, many).otherwise(few)


def sketches(items: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(h, item_id, n, part): the items' sketches, stored."""
    w = items.select(F.col(id_col).cast("long").alias("item_id"), _words(F.coalesce(text_col, F.lit(""))).alias("w")).where("item_id is not null")
    h = w.select("item_id", F.array_sort(F.array_distinct(_shingle_hashes("w", words))).alias("h")).withColumn("n", F.size("h")).where("n > 0")
    part = F.floor(F.log(F.col("n")) / F.log(F.lit(STEP))).cast("int")
    upper = F.floor(F.pow(F.lit(STEP), F.col("part") + 1))
    k = F.least(F.col("n"), (upper - F.ceil(upper * threshold - 1e-9) + 1).cast("int"))
    return stored(h.withColumn("part", part).select("item_id", "n", "part", F.explode(F.slice("h", 1, k)).alias("h")), "sketches")


def search(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of every pair at the threshold or above."""
    index = sketches(items, threshold, words, item_id, item_text)
    rows = index.count()
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    probes = source.select("doc_id", _words(F.col("text")).alias("w")).select("doc_id", F.explode(_shingle_hashes("w", words)).alias("h"))
    keys = index.select("h", "item_id")
    if rows <= BROADCAST_ROWS:
        met = probes.join(F.broadcast(keys), "h")
    else:
        met = probes.distinct().join(keys, "h")  # hashes of frequent shingles come once a document
    candidates = stored(met.groupBy("doc_id").agg(F.collect_set("item_id").alias("items")), "candidates")
    # Exact containment, inside the row: no pair is expanded into its shingles.
    shingled = items.select(F.col(item_id).cast("long").alias("item_id"), _words(F.coalesce(item_text, F.lit(""))).alias("w")).where("item_id is not null").select("item_id", _shingle_strings("w", words).alias("s")).groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("s"))
    shingled = stored(shingled.withColumn("n_item", F.size("s")), "item-shingles")
    own = source.join(candidates.select(F.col("doc_id").alias("_d"), "items"), F.col("doc_id") == F.col("_d")).select("doc_id", "items", _words(F.col("text")).alias("w")).select("doc_id", "items", _shingle_strings("w", words).alias("d"))
    pairs = own.select("doc_id", F.explode("items").alias("item_id"), "d")
    small = F.broadcast(shingled) if rows <= BROADCAST_ROWS // 8 else shingled
    checked = pairs.join(small, "item_id").select("doc_id", "item_id", F.size(F.array_intersect("s", "d")).alias("n_shared"), "n_item")
    kept = checked.where(F.col("n_shared") >= F.col("n_item") * threshold - 1e-9)
    return kept.groupBy("doc_id", "item_id").agg(F.max("n_shared").cast("long").alias("n_shared"), F.max("n_item").cast("long").alias("n_item"), F.max(F.col("n_shared") / F.col("n_item")).alias("containment"))


def keep_uncontaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the documents that hold an item; all columns stay.

    An item is held if `search` finds it in the words as they are, or in lower case without punctuation at their edges.
    Each row is judged by its own text, also where rows with different texts have one id. Rows with a null id are outside
    the search and stay."""
    plain = lambda df, i, t: df.select(F.col(i), _plain(F.col(t).cast("string")).alias(t))

    def holders(rows: DataFrame, key: str, text: str) -> DataFrame:
        raw = search(rows, items, threshold, words, key, text)
        return raw.select("doc_id").union(search(plain(rows, key, text), plain(items, "item_id", "text"), threshold, words, key, text).select("doc_id")).distinct()

    found = stored(holders(docs, id_col, text_col).withColumnRenamed("doc_id", "found"), "leaking-ids")
    signed = docs.select(docs[id_col].cast("long").alias("lost_id"), text_digest(docs[text_col]).alias("lost_digest"))
    lost = stored(signed.join(found, F.col("lost_id") == F.col("found"), "left_semi").distinct(), "leaks")
    several = stored(lost.groupBy("lost_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("lost_id").alias("several")), "several-texts")
    if not several.isEmpty():
        again = docs.select(docs[id_col].cast("long").alias("i"), text_digest(docs[text_col]).alias("g"), docs[text_col].cast("string").alias("t")).join(several, F.col("i") == F.col("several"), "left_semi").dropDuplicates(["i", "g"])
        again = stored(again.withColumn("k", F.monotonically_increasing_id()), "texts-of-one-id")
        kept = again.join(holders(again, "k", "t"), F.col("k") == F.col("doc_id"), "left_anti").select("i", "g")
        lost = stored(lost.join(kept, (F.col("lost_id") == F.col("i")) & (F.col("lost_digest") == F.col("g")), "left_anti"), "leaks")
    same = (docs[id_col].cast("long") == lost["lost_id"]) & (text_digest(docs[text_col]) == lost["lost_digest"])
    return docs.join(lost.hint("shuffle_hash"), same, "left_anti")
