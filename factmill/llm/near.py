"""Near duplicates by MinHash signatures and a multi-index Hamming join.

Every text becomes its set of distinct two-word shingles. Texts with equal sets are one class from the start. The
signature of a class has SYMBOLS values of b bits, cut into CHUNKS chunks. If two signatures differ in at most
CHUNKS * (ERRORS + 1) - 1 places, the pigeonhole principle leaves a chunk with at most ERRORS differing places, so
indexing each chunk with every choice of ERRORS places left out finds the pair in some bucket. With 13 chunks of 5 and
one error this guarantees all pairs that differ in up to 25 of 65 places; a pair of similarity 0.8 differs in 13 on
average, and one that differs in more places still meets with high probability (a miss has about 3 in 10^8, and one of
more than FAR places 1 in 10^8).

Buckets are never expanded into pairs. Their members are joined to the bucket's smallest id, its head. A sketch of 64 bits
that travels with every key tells whether some member is far from the head; in such a bucket (of at most BUCKET members;
larger ones keep their joins) all signatures are compared, and only what differs in at most FAR places is joined, so
chance meetings don't chain unlike texts together. That gives candidate components, within which full shingle sets are
compared as matrix products. A component of more than a block is dealt to blocks; each is compared with itself and with
some members of all blocks, which joins the copies of one text to one cluster, and only members outside the largest
cluster then meet all other blocks. Each comparison returns at most one link per row (a spanning set), so a group of n
near copies makes about n rows and n / BLOCK_ROWS tasks, not n^2. Links are confirmed exactly: 100 * intersection >= 80 *
union. Connected components of the links give the classes.

Defined results: a text without words (null, empty, blank) has no shingles and is a component of its own; a text of one
word is its one shingle; rows that repeat a doc_id stay rows, and those with equal texts are in the same component;
ties cannot occur (the smallest id leads); an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill.llm.common import cut, id_filter, map_batches, read, slot, texts_of
from factmill.llm.graph import components

CHUNKS, PLACES, ERRORS = 13, 5, 1
SYMBOLS = CHUNKS * PLACES
#: Rows and shingles of a block of full sets; a comparison holds two blocks.
BLOCK_ROWS, BLOCK_SHINGLES = 2048, 600_000
#: Members of a large component, on average, that meet all its blocks.
PIVOTS = 64
#: Places in which the signatures of joined texts may differ, where a bucket is compared, and bits of sketches that tell
#: which buckets need it; buckets of more members are never compared.
FAR, FAR_BITS, BUCKET = 33, 16, 128
TABLE_ROWS = 300_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of MurmurHash3)."""
    s = np.uint64(33)
    x = (x ^ (x >> s)) * _M1
    x = (x ^ (x >> s)) * _M2
    return x ^ (x >> s)


def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(n, dtype=np.uint64)
    return mix(at * np.uint64(2) + np.uint64(1)) | np.uint64(1), mix(at * np.uint64(2) + np.uint64(1 << 40))


class Shingler:
    """Shingle sets as sorted distinct 64-bit hashes; words are hashed once per task table."""

    def __init__(self, size: int = 2, table_rows: int = TABLE_ROWS):
        self.size, self.table, self.table_rows = size, {}, table_rows

    def shingles(self, text: str) -> np.ndarray:
        words = text.encode().translate(_LOWER).split()
        table = self.table
        if len(table) > self.table_rows:
            table.clear()
        for w in {w for w in words if w not in table}:
            table[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
        if len(h) == 0:
            return h
        n = min(self.size, len(h))
        out = mix(h[: len(h) - n + 1] + np.uint64(n))
        for i in range(1, n):
            out = mix(out * np.uint64(31) + h[i : len(h) - n + 1 + i])
        return np.unique(out)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The low 16 bits of the smallest value of each hash function."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        low = np.minimum(low, (shingles[at : at + 4096, None] * a + b).min(0))
    return mix(low).astype(np.uint16)


def signatures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2) -> DataFrame:
    """doc, n (shingles), digest (of the set; null if it is empty), sig (packed 16-bit values), text_hash (of the text)."""

    def prepare():
        shingler, (a, b) = Shingler(size), multipliers(SYMBOLS)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, digest, sig = [], [], []
            for text in texts_of(batch, "t"):
                s = shingler.shingles(text)
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig.append(signature(s, a, b).tobytes() if len(s) else None)
            return pa.RecordBatch.from_arrays(
                [batch.column("k"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), batch.column("h")],
                ["doc", "n", "digest", "sig", "text_hash"],
            )

        return step

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("k"), F.col(f"`{text_col}`").alias("t"), text_hash(text_col).alias("h"))
    return map_batches(rows, "doc long, n long, digest binary, sig binary, text_hash long", prepare)


def text_hash(text_col: str) -> F.Column:
    """Tells rows apart that share an id."""
    return F.xxhash64(F.col(f"`{text_col}`"))


def bucket_keys(classes: DataFrame) -> DataFrame:
    """rep, key and sketch (the lowest bits of 64 values), one row for each chunk and each choice of places left out of it."""
    masks = [np.array([p for p in range(PLACES) if p not in out]) for out in combinations(range(PLACES), ERRORS)]

    def prepare():
        def step(batch: pa.RecordBatch):
            rep = batch.column("rep").to_numpy(zero_copy_only=False)
            if not len(rep):
                return None
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(len(rep), SYMBOLS)
            sketch = np.packbits(sig[:, :64].astype(np.uint8) & 1, axis=1).view(np.int64).ravel()
            sig = sig.astype(np.uint64)
            keys = []
            for c in range(CHUNKS):
                for m, places in enumerate(masks):
                    key = np.full(len(rep), c * len(masks) + m + 1, np.uint64)
                    for p in places:
                        key = mix(key * np.uint64(1 << 16) + sig[:, c * PLACES + p])
                    keys.append(key)
            n, keys = len(keys), np.concatenate(keys).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.tile(rep, n)), pa.array(keys), pa.array(np.tile(sketch, n))], ["rep", "key", "sketch"])

        return step

    return map_batches(classes.select("rep", "sig"), "rep long, key long, sketch long", prepare)


def _close(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """Links a, b that connect, in each group of reps, what signatures that differ in at most FAR places connect."""
    members = groups.select(F.xxhash64("reps").alias("g"), F.explode("reps").alias("rep")).join(classes.select("rep", "sig"), "rep")
    members = members.groupBy("g").agg(F.collect_list(F.struct("rep", "sig")).alias("m")).select("m")

    def prepare():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple[int, int]] = []
            for m in batch.column("m").to_pylist():
                ids = np.array([x["rep"] for x in m])
                sig = np.frombuffer(b"".join(x["sig"] for x in m), np.uint16).reshape(len(m), SYMBOLS)
                far = np.zeros((len(m), len(m)), np.int16)
                for p in range(SYMBOLS):
                    far += sig[:, p, None] != sig[None, :, p]
                out += _spanning(ids, *np.nonzero(far <= FAR))
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], ["a", "b"])

        return step

    return map_batches(members, "a long, b long", prepare)


def candidate_links(classes: DataFrame) -> DataFrame:
    """Links a, b of classes that share a bucket, through its head or, where some member is far from that, as _close() does."""
    keys = bucket_keys(classes)
    heads = keys.groupBy("key").agg(F.min("rep").alias("head"), F.count("*").alias("members")).filter("members > 1")
    # Arrays of about BUCKET members at most; those of a larger bucket are parted by hash and share its head.
    part = F.when(F.col("members") > BUCKET, F.pmod(F.xxhash64("rep"), F.ceil(F.col("members") / BUCKET))).otherwise(0)
    groups = keys.join(heads, "key").groupBy("key", part.alias("part")).agg(
        F.first("head").alias("head"), F.first("members").alias("members"), F.array_sort(F.collect_list(F.struct("rep", "sketch"))).alias("m")
    )
    top = F.col("m")[0]["sketch"]
    far = (F.col("members") <= BUCKET) & F.exists("m", lambda x: F.bit_count(x["sketch"].bitwiseXOR(top)) > FAR_BITS)
    groups = groups.select(F.col("m.rep").alias("reps"), "head", far.alias("far"))
    groups = cut(groups.groupBy("reps", "head").agg(F.max("far").alias("far")))  # many buckets of copies hold the same
    stars = groups.filter("not far").select(F.explode("reps").alias("rep"), "head").filter("rep <> head")
    # A class has at most one head for each of its keys; joined through the smallest of them, its links are few.
    own = stars.groupBy("rep").agg(F.min("head").alias("low"), F.collect_set("head").alias("others"))
    through = own.select(F.explode("others").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
    return own.select(F.col("rep").alias("a"), F.col("low").alias("b")).union(through).union(_close(groups.filter("far"), classes))


def full_sets(df: DataFrame, ids: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """id, comp, n and set of the texts whose id is among ids (id, comp). Texts go through no shuffle: a filter of fixed
    size, which may let others pass, keeps most texts out, and the join with ids drops the rest."""
    spark = df.sparkSession
    bits = spark.sparkContext.broadcast(id_filter(ids, "id"))

    def prepare():
        shingler, own = Shingler(size), np.frombuffer(bits.value, np.uint8)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            s = batch.column("s").to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(own[s >> 3] >> (s & 7).astype(np.uint8) & 1)
            part = batch.take(pa.array(hit))
            sets = [shingler.shingles(t) for t in texts_of(part, "t")]
            return pa.RecordBatch.from_arrays(
                [part.column("k"), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["id", "n", "set"]
            )

        return step

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("k"), F.col(f"`{text_col}`").alias("t")).filter("k is not null").withColumn("s", slot("k"))
    return map_batches(rows, "id long, n long, set binary", prepare).filter("n > 0").join(ids, "id")


def _compare(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of sets have 100 * intersection >= percent * union, by products of incidence matrices."""
    values, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    rows = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    count = np.bincount(at, minlength=len(values))
    keep = count[at] > 1
    rows, at = rows[keep], (np.cumsum(count > 1) - 1)[at[keep]]
    width, both = int((count > 1).sum()), np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(at, kind="stable")
    rows, at = rows[order], at[order]
    step = max(1, (1 << 23) // (len(left) + len(right)))
    for a in range(0, width, step):
        i, j = np.searchsorted(at, [a, a + step])
        m = np.zeros((len(left) + len(right), min(step, width - a)), np.float32)
        m[rows[i:j], at[i:j] - a] = 1
        both += m[: len(left)] @ m[len(left) :].T
    total = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None]
    inter = np.rint(both).astype(np.int64)
    return 100 * inter >= percent * (total - inter)


def _spanning(ids: np.ndarray, own: np.ndarray, other: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect all that the linked pairs of places connect, one for each row at most, to the smallest id."""
    place = np.argsort(np.argsort(ids, kind="stable"), kind="stable")  # of each row by rising id
    own, other = place[own], place[other]
    label = np.arange(len(ids))
    while True:
        low = label.copy()
        np.minimum.at(low, own, label[other])
        np.minimum.at(low, other, label[own])
        low = np.minimum(low, low[low])
        if (low == label).all():
            break
        label = low
    ranked = np.sort(ids)
    return [(int(ranked[i]), int(ranked[j])) for i, j in enumerate(label) if i != j]


def _compared(rows: DataFrame, percent: int) -> DataFrame:
    """Links a, b of rows (pack, i, j, comp, id, set, left, right): a task for each pack, i and j, in which the left sets of
    each comp are compared with its right ones."""

    def compare(table: pa.Table) -> pa.Table:
        own = table.to_pydict()
        groups: dict[int, list[int]] = {}
        for r, c in enumerate(own["comp"]):
            groups.setdefault(c, []).append(r)
        out: list[tuple[int, int]] = []
        for rows in groups.values():
            first, second = [r for r in rows if own["left"][r]], [r for r in rows if own["right"][r]]
            if len(rows) < 2 or not first or not second:
                continue
            sets = {r: np.frombuffer(own["set"][r], np.uint64) for r in rows}
            same = first == second
            x, y = np.nonzero(_compare([sets[r] for r in first], [sets[r] for r in second], percent))
            ids = np.array([own["id"][r] for r in (first if same else [*first, *second])])
            out += _spanning(ids, x, y if same else y + len(first))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return rows.groupBy("pack", "i", "j").applyInArrow(compare, "a long, b long").filter("a <> b")


def links(sets: DataFrame, percent: int = 80) -> DataFrame:
    """Confirmed links a, b that connect, in each candidate component, what all its links connect.

    Components of at most a block are packed together by hash. A larger one is dealt to blocks by hash, of bounded rows and
    shingles. First each block is compared with itself and with the component's pivots, members of smallest hash. What
    then isn't in the largest cluster of its component, the rest, is compared with all its blocks. Two members of the largest
    cluster are connected already, so no pair that could connect anything is left out.
    """
    parts_of = lambda: F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.lit(1)).cast("int")
    both = [F.lit(True).alias("left"), F.lit(True).alias("right")]
    weight = sets.groupBy("comp").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    weight = cut(weight.withColumn("parts", parts_of()))
    total = weight.filter("parts = 1").agg(F.sum("shingles"), F.sum("rows")).first()
    packs = max(1, int((total[0] or 0) // BLOCK_SHINGLES), int((total[1] or 0) // BLOCK_ROWS))
    rows = sets.join(weight.select("comp", "rows", "parts"), "comp")
    small = rows.filter("parts = 1").select(F.pmod(F.xxhash64("comp"), F.lit(packs)).alias("pack"), F.lit(0).alias("i"), F.lit(0).alias("j"), "comp", "id", "set", *both)
    if weight.filter("parts > 1").isEmpty():
        return _compared(small, percent)
    large = rows.filter("parts > 1").withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int"))
    pivot = F.pmod(F.xxhash64("id", F.lit(2)), F.col("rows")) < PIVOTS
    own = F.array(F.col("block"))
    first = large.withColumn("i", F.explode(F.when(pivot, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(own)))
    found = cut(_compared(small.union(first.select(F.col("comp").alias("pack"), "i", F.lit(-1).alias("j"), "comp", "id", "set", *both)), percent))
    # Clusters of large components, by ids alone.
    narrow = cut(large.select("comp", "id", "n", "block", "parts"))
    linked = narrow.select("id").join(found.withColumnRenamed("a", "id"), "id").select(F.col("id").alias("a"), "b")
    label = narrow.join(components(linked).withColumnRenamed("comp", "cluster"), "id", "left").withColumn("cluster", F.coalesce("cluster", "id"))
    sizes = label.groupBy("comp", "cluster").agg(F.count("*").alias("m"))
    most = sizes.groupBy("comp").agg(F.max_by("cluster", F.struct("m", "cluster")).alias("top"))
    rest = cut(label.join(most, "comp").filter("cluster <> top").select("comp", "id", "n", "parts"))
    if rest.isEmpty():
        return found
    weight = rest.groupBy("comp").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles")).select("comp", parts_of().alias("pieces"))
    mine = rest.select("comp", "id").join(sets.select("id", "set"), "id").join(weight, "comp").join(narrow.select("id", "parts"), "id")
    mine = mine.withColumn("i", F.pmod(F.xxhash64("id", F.lit(3)), F.col("pieces")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    theirs = large.join(weight, "comp").withColumn("j", F.col("block")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    side = lambda df, left: df.select(F.col("comp").alias("pack"), "i", "j", "comp", "id", "set", F.lit(left).alias("left"), F.lit(not left).alias("right"))
    return found.union(_compared(side(mine, True).union(side(theirs, False)), percent))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and text_hash (see text_hash()) for every row."""
    spark = df.sparkSession
    sigs = cut(signatures(df, id_col, text_col, size))
    classes = sigs.filter("digest is not null and doc is not null").groupBy("digest").agg(F.min("doc").alias("rep"), F.first("sig").alias("sig"), F.count("*").alias("copies"))
    classes = cut(classes)
    candidates = components(candidate_links(classes))
    sets = cut(full_sets(df, candidates, id_col, text_col, size))
    found = components(cut(links(sets, percent)))
    copies = classes.filter("copies > 1").select("digest", "rep")
    out = sigs.select("doc", "n", "digest", "text_hash").join(copies, "digest", "left").withColumn("id", F.coalesce("rep", F.when(F.col("n") > 0, F.col("doc"))))
    out = out.join(found, "id", "left")
    top = F.coalesce("comp", "id", "doc")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), top.alias("component_id"), (F.col("doc") == top).alias("kept"), "text_hash")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(read(spark, sf_dir, "documents")).drop("text_hash")


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2, percent: int = 80) -> DataFrame:
    """The rows of df of which each component keeps one, that of its smallest id. Only what goes is joined, by id and text
    hash; of rows that are equal in both that of the smallest digest of all its columns stays, and rows without an id stay.
    Columns travel under internal names, so none of df's own can clash with those that are added here."""
    names = {f"c{i}": c for i, c in enumerate(df.columns)}
    rows = df.toDF(*names) if names else df
    k, t = (next(n for n, c in names.items() if c == x) for x in (id_col, text_col))
    found = near_duplicates(rows, k, t, size, percent)
    found = cut(found.filter("doc_id is not null").select(F.col("doc_id").alias("key"), F.col("text_hash").alias("hash"), "kept"))
    rows = rows.withColumn("key", F.col(k).cast("long")).withColumn("hash", text_hash(t))
    left = rows.join(found.filter("not kept").select("key", "hash").distinct(), ["key", "hash"], "left_anti")
    again = found.filter("kept").groupBy("key", "hash").count().filter("count > 1").select("key", "hash")
    if not again.isEmpty():
        again = cut(again)
        whole = F.struct(*names)
        one = left.join(again, ["key", "hash"], "left_semi").groupBy("key", "hash").agg(F.min_by(whole, F.sha2(F.to_json(whole, {"ignoreNullFields": "false"}), 256)).alias("r")).select("r.*")
        left = left.join(again, ["key", "hash"], "left_anti").select(*names).union(one)
    return left.select(*[F.col(n).alias(c) for n, c in names.items()])
