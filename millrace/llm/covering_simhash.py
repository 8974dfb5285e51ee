"""SimHash near-duplicates by covering locality-sensitive hashing.

Each of the 64 bit places gets a vector of RADIUS + 1 bits; table v, for each of the 2**(RADIUS + 1) - 1 vectors v but
zero, keeps the places whose vector has an odd product with v. For any RADIUS places there is a v whose products with
all their vectors are even, so two fingerprints that differ there only agree on all that table v keeps: every pair
within the radius meets in some table, and no other recall argument is needed.

A bucket's members are compared inside the bucket, and only a spanning forest of its links leaves it. A bucket larger
than LARGE is dealt out again, by the same masks over the places that its table left free; after three levels only eight
places are free, so such a bucket has at most 256 members whatever the input. Components follow from the links by
rounds of joins.

Defined cases: a null text is empty and has fingerprint 0, as any text without words; null ids are kept and count as
the smallest; repeated rows have equal fingerprints and so one component; very long texts are hashed whole, 65,536
shingles at a time; a bit that exactly half of the shingles set is 0; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import prefix_join
from .common import chunks, lean, release, shards, stored, text_digest, texts
from .windows import mix

RADIUS, LARGE = 3, 512


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", distinct: bool = False, count: int = 1) -> DataFrame:
    """doc_id, fp (64 bits as a signed long) of all shingles, or of the distinct ones; further fingerprints fp1, fp2, ...
    are of other hashes and independent of it."""
    return _signed_texts(texts(docs, id_col, text_col), shingle, distinct, count)


def _signed_texts(source: DataFrame, shingle: int, distinct: bool, count: int, around=lambda work: work) -> DataFrame:
    """The fingerprints in the place of the column text; other columns stay. `around` is put around what workers do."""
    carried = [c for c in source.columns if c != "text"]
    names = ["fp", *(f"fp{k}" for k in range(1, count))]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        h64 = partial(xxhash.xxh64_intdigest, seed=42)
        for c in chunks(batches):
            out = np.zeros((count, c.n), np.uint64)
            for i, (a, b) in enumerate(zip(c.starts[:-1].tolist(), c.starts[1:].tolist())):
                words = c.data[a:b].tobytes().lower().split()  # on bytes, both know ASCII only
                n = len(words) - shingle + 1
                if n < 1:
                    whole = np.array([h64(b" ".join(words))] if words else [0], np.uint64)
                    out[:, i] = [int(mix(whole, 61 + k)[0]) if k and words else int(whole[0]) for k in range(count)]
                    continue
                if distinct:
                    words = list(dict.fromkeys(words if shingle == 1 else map(b" ".join, zip(*(words[k:] for k in range(shingle))))))
                    n, size = len(words), 1
                else:
                    size = shingle
                ones = np.zeros((count, 64), np.int64)
                for at in range(0, n, 1 << 16):
                    m = min(1 << 16, n - at)
                    parts = [words[at + k : at + k + m] for k in range(size)]
                    hashes = np.fromiter(map(h64, map(b" ".join, zip(*parts))), np.uint64, m)
                    for k in range(count):
                        h = mix(hashes, 61 + k) if k else hashes
                        ones[k] += np.unpackbits(h.view(np.uint8).reshape(m, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
                out[:, i] = np.packbits(2 * ones > n, axis=1, bitorder="little").view(np.uint64)[:, 0]
            yield pa.RecordBatch.from_arrays([*map(c.column, carried), *(pa.array(x.view(np.int64)) for x in out)], [*carried, *names])

    schema = source.select(*carried, *[F.lit(0).cast("long").alias(n) for n in names]).schema
    return source.mapInArrow(around(sign), schema)


def masks(places: int, radius: int = RADIUS) -> list[int]:
    """For each table the places it keeps, as bits 0 to `places` - 1; place i has vector 1 + i mod (2**(radius+1) - 1).

    Where places are too few for these to use every bit, unit vectors come first: they span all, so no table is empty."""
    vectors = [1 + i % ((1 << radius + 1) - 1) for i in range(places)]
    if places < 1 << radius:
        vectors = sorted(range(1, 1 << radius + 1), key=lambda v: (v.bit_count() > 1, v))[:places]
    return [sum(1 << i for i, a in enumerate(vectors) if (a & v).bit_count() & 1) for v in range(1, 1 << radius + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _spread(mask: int, places: list[int]) -> int:
    return sum(1 << p for i, p in enumerate(places) if mask >> i & 1)


def tables(kept: int = 0, radius: int = RADIUS) -> list[int]:
    """Masks of the next level's tables: what is kept already, and a covering of the places still free."""
    free = [p for p in range(64) if not kept >> p & 1]
    return sorted({kept | _spread(m, free) for m in masks(len(free), radius)} - {kept})


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints of one bucket, row by row."""
    n = len(fps)
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i in range(n - 1):
        for j in (np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius) + i + 1).tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


def links(distinct: DataFrame, radius: int = RADIUS, large: int = LARGE) -> DataFrame:
    """(a, b): links between distinct fingerprints `fp` whose components are those of all pairs within the radius."""
    keyed = distinct.withColumn("kept", F.explode(F.array(*[F.lit(_signed(m)) for m in tables(0, radius)])))
    made = None
    for level in range(3):
        keyed = keyed.withColumn("bucket", F.col("fp").bitwiseAND(F.col("kept")))
        # Sizes first: counts combine before the shuffle, so a bucket with very many members costs no task more.
        sizes = keyed.groupBy("kept", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sizes = stored(sizes, f"buckets-{level}")
        hot = sizes.where(F.col("n") > large) if level < 2 else sizes.limit(0)
        small = sizes.where(F.col("n") <= large) if level < 2 else sizes
        members = keyed.join(small.select("kept", "bucket").hint("merge"), ["kept", "bucket"]).groupBy("kept", "bucket").agg(F.collect_list("fp").alias("fps"))

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                col = batch.column("fps")
                flat, ends = col.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum([len(x) for x in col])])
                sizes = np.diff(ends)
                a, b = [], []
                two = ends[:-1][sizes == 2]  # most buckets
                near = np.bitwise_count(flat[two] ^ flat[two + 1]) <= radius
                a.append(flat[two][near]), b.append(flat[two + 1][near])
                for s, e in zip(ends[:-1][sizes > 2].tolist(), ends[1:][sizes > 2].tolist()):
                    fps = flat[s:e]
                    pairs = np.array(_forest(fps, radius), np.int64).reshape(-1, 2)
                    a.append(fps[pairs[:, 0]]), b.append(fps[pairs[:, 1]])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

        found = members.select("fps").mapInArrow(compare, "a long, b long")
        made = found if made is None else made.unionByName(found)
        if level == 2 or hot.isEmpty():
            break
        again = keyed.join(hot.select("kept", "bucket"), ["kept", "bucket"]).select("fp", "kept")
        kinds = [r["kept"] for r in hot.select("kept").distinct().collect()]  # at most the tables of a level
        nexts = F.create_map(*[x for k in kinds for x in (F.lit(k), F.array(*[F.lit(_signed(m)) for m in tables(k & (1 << 64) - 1, radius)]))])
        keyed = stored(again.withColumn("kept", F.explode(nexts[F.col("kept")])).distinct(), f"again-{level + 1}")
    return made.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label): for each node of the links a, b the least node of its component.

    Alternates large-star and small-star rounds, each written to the shared folder, until a round changes nothing."""
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    count = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = count(e)
    while before[0]:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        e = stored(small, name)
        after = count(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", large: int = LARGE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (least id in reach)."""
    signed = stored(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    classes = stored(signed.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id")).alias("least")), "classes")
    labels = components(links(classes.select("fp"), radius, large))
    grouped = classes.join(labels, classes["fp"] == labels["node"], "left").select("fp", F.coalesce("label", "fp").alias("label"), "least")
    roots = stored(grouped.groupBy("label").agg(F.min("least").alias("root")), "roots")
    ids = stored(grouped.join(roots, "label").select("fp", F.col("root.doc_id").alias("component_id")), "component-ids")
    out = signed.join(ids, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _shingle_sets(source: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, s), stored: the distinct shingles of the texts of `nodes`, by their doc_id and digest."""
    from .decontaminate import _shingle_hashes, _words

    nodes = nodes.select("node", F.col("doc_id").alias("_i"), F.col("digest").alias("_g"))
    sets = source.join(nodes.hint("shuffle_hash"), (F.col("doc_id") == F.col("_i")) & (F.col("digest") == F.col("_g"))).select("node", _words(F.lower("text")).alias("w")).select("node", F.array_distinct(_shingle_hashes("w", words)).alias("s"))
    return stored(sets.groupBy("node").agg(F.first("s").alias("s")), "shingle-sets")  # a repeated row is one text


def _verified(source: DataFrame, unique: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b), stored: the pairs x, y of nodes whose texts share `similarity` of their distinct shingles."""
    ends = pairs.select(F.col("x").alias("_n")).union(pairs.select("y")).distinct()
    nodes = stored(unique.join(ends, F.col("node") == F.col("_n")).select("node", "doc_id", "digest"), "nodes")
    sets = _shingle_sets(source, nodes, words)
    side = lambda n: sets.select(F.col("node").alias(n), F.col("s").alias(f"s{n}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y").withColumn("n", F.size(F.array_intersect("sx", "sy")))
    out = stored(both.where(F.col("n") >= similarity * (F.size("sx") + F.size("sy") - F.col("n")) - 1e-9).select(F.col("x").alias("a"), F.col("y").alias("b")), "near-pairs")
    release(nodes, sets)
    return out


def _linked(source: DataFrame, nodes: DataFrame, joined: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b), stored: links that join what all pairs at the threshold join in each group of labels that `joined` makes."""
    groups = components(joined, "label-groups").select(F.col("node").alias("_l"), F.col("label").alias("grp"))
    nodes = stored(nodes.join(groups, F.col("label") == F.col("_l")).select("doc_id", "digest", "node", "label", "grp"), "grouped-nodes")
    sets = _shingle_sets(source, nodes, words)
    own = stored(sets.join(nodes.select(F.col("node").alias("_n"), "label", "grp"), F.col("node") == F.col("_n")).select("node", "label", "grp", "s"), "grouped-sets")
    out = stored(prefix_join.linked(own, similarity, shards(source)), "linked")
    release(nodes, sets, own)
    return out


def near_pairs(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 4, count: int = 3, id_col: str = "doc_id", text_col: str = "text", frequent: int = prefix_join.HOT, small: int = prefix_join.SMALL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, texts, links). rows: doc_id and digest of each row with an id; texts: digest, least doc_id and node of each
    different text; links: pairs (a, b) of nodes with that similarity of their distinct shingles (Jaccard), lower-cased.

    The links join what all pairs at the threshold would join, though not each such pair is among them. Candidates come
    first from `count` fingerprints of the distinct words, of which an edit changes one and not `words`: links between
    fingerprints within `radius` bits, and each text's to the first of its own fingerprint. These join most copies by few
    comparisons. Then every pair that they leave apart and that can reach the threshold is compared, by the exact prefixes
    of `prefix_join`; pairs under a shingle of many texts in groups, of which only links that join more leave a task. So whatever the fingerprints miss or their reduction drops is found."""
    source = texts(docs, id_col, text_col).where("doc_id is not null").withColumn("digest", text_digest(F.col("text")))
    names = ["fp", *(f"fp{k}" for k in range(1, count))]
    signed = stored(_signed_texts(source, 1, True, count, lean).distinct(), "signed")
    unique = stored(signed.groupBy("digest", *names).agg(F.min("doc_id").alias("doc_id")).withColumn("node", F.monotonically_increasing_id()), "unique-texts")
    edges = None
    for fp in names:
        heads = stored(unique.groupBy(F.col(fp).alias("fp")).agg(F.min("node").alias("head")), "heads")
        pairs = stored(links(heads.select("fp"), radius), "pairs")
        across = pairs.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b").select("x", "y")
        inside = unique.select(F.col(fp).alias("fp"), "node").join(heads, "fp").where("node <> head").select(F.col("head").alias("x"), F.col("node").alias("y"))
        found = across.unionByName(inside)
        edges = found if edges is None else edges.unionByName(found)
    edges = stored(edges.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "candidate-pairs")
    real = _verified(source, unique, edges, words, similarity)
    labels = stored(components(real), "near-labels")
    nodes = unique.join(labels.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("doc_id", "digest", "node", F.coalesce("label", "node").alias("label"))
    lower = source.withColumn("text", F.lower("text"))
    nodes = stored(nodes, "labelled")
    more, joined = prefix_join.candidates(lower, nodes, words, similarity, frequent, small=small)
    found = _verified(source, unique, more, words, similarity).unionByName(_linked(source, nodes, joined, words, similarity))
    return signed.select("doc_id", "digest"), unique.select("digest", "doc_id", "node"), real.unionByName(found)


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 4, count: int = 3, id_col: str = "doc_id", text_col: str = "text", frequent: int = prefix_join.HOT, small: int = prefix_join.SMALL) -> DataFrame:
    """`docs` without all but the least id of each group of near copies (`near_pairs`, and copies of copies); all columns stay.

    Each row is judged by its own text: of rows with one id and different texts one may stay and the other go, the
    smaller digest being the first. Equal rows are one document and stay or go together. Rows with a null id are outside:
    they stay, and nothing goes for their sake. Texts without words are copies of each other."""
    signed, unique, edges = near_pairs(docs, words, similarity, radius, count, id_col, text_col, frequent, small)
    labels = stored(components(edges), "labels")
    group = stored(unique.join(labels.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("doc_id", "digest", F.coalesce("label", "node").alias("label")), "grouped")
    first = group.groupBy("label").agg(F.min(F.struct("doc_id", "digest")).alias("first"))
    kept = stored(group.join(first, "label").select("digest", F.col("first.doc_id").alias("first_id"), F.col("first.digest").alias("first_digest")), "groups")
    lost = stored(signed.join(kept, "digest").where("doc_id <> first_id or digest <> first_digest").select(F.col("doc_id").alias("lost_id"), F.col("digest").alias("lost_digest")), "near-copies")
    same = (docs[id_col].cast("long") == lost["lost_id"]) & (text_digest(docs[text_col]) == lost["lost_digest"])
    return docs.join(lost.hint("shuffle_hash"), same, "left_anti")
