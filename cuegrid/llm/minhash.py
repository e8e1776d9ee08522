"""MinHash near-dedup by fast similarity sketching, banding and exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuegrid.llm.common import discard, rows_left, small, stored
from cuegrid.llm.components import components
from cuegrid.llm.textnum import Words, freed, mix64, pieces

BINS, BAND_ROWS = 256, 8
#: Members of a pivot's group for each salt over which their comparisons are dealt.
GROUP = 512
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, first): the sorted distinct hashes of the word shingles of each text, one text after another, and where each text begins.

    With fewer words than ``width`` the whole sequence is the one shingle; without words there is none.
    """
    words = Words(col)
    h, first = words.hashes(), words.first
    n_words = np.diff(first)
    acc = np.zeros(len(h), np.uint64)
    for k in range(width):
        shifted = np.zeros(len(h), np.uint64)
        shifted[: max(0, len(h) - k)] = h[k:]
        acc = mix64(acc * np.uint64(0x9FB21C651E98DF25) + shifted)
    sets, begins = [], [0]
    for i, n in enumerate(n_words):
        if n >= width:
            own = np.unique(acc[first[i] : first[i + 1] - width + 1])
        elif n:
            own = np.array([n], np.uint64)
            for x in h[first[i] : first[i + 1]]:
                own = mix64(own * np.uint64(0xD6E8FEB86659FD93) + x)
        else:
            own = np.zeros(0, np.uint64)
        sets.append(own)
        begins.append(begins[-1] + len(own))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.array(begins)


def sketches(values: np.ndarray, first: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Fast similarity sketch of each set: (sets, bins) values; equal positions of two sketches agree with the sets' Jaccard probability.

    In round i < bins each element is hashed to a bin and a value that is greater than all of earlier rounds; in round
    bins + j all elements go to bin j, so every bin of a non-empty set fills. A set leaves when its bins are full.
    """
    n = len(first) - 1
    out = np.full((n, bins), _EMPTY)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(n), np.diff(first))
    live = np.diff(first) > 0
    for i in range(2 * bins):
        if not live.any():
            break
        take = live[owner]
        own, x = owner[take], mix64(values[take] + np.uint64((i * 0xA0761D6478BD642F + 0xE7037ED1A0B428DB) & 0xFFFFFFFFFFFFFFFF))
        bin_ = (x >> np.uint64(54)).astype(np.int64) % bins if i < bins else np.full(len(x), i - bins)
        np.minimum.at(flat, own * bins + bin_, np.uint64(i << 44) | (x & np.uint64((1 << 44) - 1)))
        live &= (out == _EMPTY).any(axis=1)
    return out


def bands(sketch: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` sketch values; the band's number goes in."""
    parts = sketch.reshape(len(sketch), -1, rows)
    key = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64) + np.uint64(1), parts.shape[:2]).copy()
    for k in range(rows):
        key = mix64(key * np.uint64(0x9FB21C651E98DF25) + parts[:, :, k])
    return key.view(np.int64)


def _digests(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """A digest of each set, null for an empty one."""
    return pa.array([hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(first, first[1:], strict=False)], pa.binary())


def _sketched(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                values, first = shingle_sets(piece.column("text"), width)
                keys = bands(sketches(values, first))
                count = np.diff(first)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(count, pa.int64()), _digests(values, first), lists], ["id", "n", "digest", "bands"])
        freed()

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, n long, digest binary, bands array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                values, first = shingle_sets(piece.column("text"), width)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([_digests(values, first), lists], ["digest", "shingles"])
        freed()

    return docs.mapInArrow(run, "digest binary, shingles array<long>")


def _linked(common: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether sets of n and m elements with so many in common are similar enough."""
    return common * (100 + percent) >= percent * (n + m)


def _placed(members: DataFrame, parts: DataFrame) -> DataFrame:
    """members (pivot, node, ...) with the components of both."""
    own = members.join(parts.select("node", F.col("component").alias("of")), "node", "left").withColumn("of", F.coalesce("of", "node"))
    return own.join(parts.select(F.col("node").alias("pivot"), F.col("component").alias("main")), "pivot", "left").withColumn("main", F.coalesce("main", "pivot"))


def _rest(verified: DataFrame, sets: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of a pivot's group that are not in one component yet.

    A member is told by what it has beyond its pivot and what it lacks of it. From the sizes of these two lists and what
    two members have in common in them follows the intersection of their whole sets, exactly; so the condition of the
    join confirms a link, and only links leave it. Where the lists' sizes rule a link out, the lists are not compared.
    The members to place are dealt to salts by the group's size, and the group stands at each salt, so no task meets all
    comparisons of a large group.
    """
    placed = stored(_placed(verified.select("pivot", "node", "n", "np"), parts))
    torn = placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("k"), F.bool_or(F.col("of") != F.col("main")).alias("open")).where("open AND k > 1").select("pivot", F.ceil(F.col("k") / GROUP).cast("int").alias("salts"))
    some = stored(placed.join(torn, "pivot"))
    if some.isEmpty():
        return some.select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    told = some.join(sets.select("node", F.col("shingles").alias("s")), "node").join(sets.select(F.col("node").alias("pivot"), F.col("shingles").alias("p")), "pivot")
    told = stored(told.select("pivot", "node", "n", "of", "main", "salts", F.array_except("s", "p").alias("more"), F.array_except("p", "s").alias("less")))
    salt = F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt")
    one = told.where("of <> main").select("pivot", salt, *[F.col(c).alias(f"x_{c}") for c in ("node", "n", "of", "more", "less")])
    two = told.select("*", (F.col("of") == F.col("main")).alias("inner"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    lists = F.size("x_more") + F.size("x_less") + F.size("more") + F.size("less")
    common = lambda shared: (F.col("x_n") + F.col("n") - lists + 2 * shared) / 2
    most = F.least(F.size("x_more"), F.size("more")) + F.least(F.size("x_less"), F.size("less"))
    shared = F.size(F.array_intersect("x_more", "more")) + F.size(F.array_intersect("x_less", "less"))
    apart = (F.col("x_of") != F.col("of")) & (F.col("inner") | (F.col("x_node") < F.col("node")))
    same = (one["pivot"] == two["pivot"]) & (one["salt"] == two["salt"])
    met = one.join(two, same & apart & _linked(common(most), F.col("x_n"), F.col("n"), percent) & _linked(common(shared), F.col("x_n"), F.col("n"), percent))
    return met.select(F.least("x_node", "node").alias("a"), F.greatest("x_node", "node").alias("b"))


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of docs; documents are linked where 100 * intersection >= percent * union of their shingle sets.

    Equal sets are one class from the start, found by the set's digest and then known by a number. Each class's sketch is cut into bands; a
    bucket holds the classes that share a band. A bucket's pivot is the member whose buckets hold most members: in a
    group of near copies the text that they were made from. Every member is compared with its pivots on whole sets, and
    links are joined to components. Members that are not in their pivot's component are then compared with all others of
    the pivot's group, so no pair of a bucket goes unseen unless it is in one component already. With 32 bands of 8 a
    pair at 0.85 shares no bucket once in 25,000, at 0.8 once in 360; ``width`` and ``percent`` are the caller's.

    A null id, or a null, empty or wordless text, links with nothing; such a row is its own component. Rows that share
    an id but not a text are documents of their own: each row's component follows from its own text. Repeated rows stay
    as rows. An empty table gives none. Only the two named columns are read, so others cannot clash.
    """
    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    sketched = stored(_sketched(named, width))
    full = sketched.where("n > 0 and id is not null")
    classes = full.groupBy("digest").agg(F.min(F.struct("id", "bands")).alias("c"), F.count(F.lit(1)).alias("copies"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("node"), "digest", "copies", "c.*"))
    keys = classes.select("node", F.explode("bands").alias("bucket"))
    shared = stored(keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("first"), F.max("node").alias("last")).where("first < last").select("bucket", "size"))
    members = stored(keys.join(small(shared), "bucket"))
    nodes = stored(members.groupBy("node").agg(F.sum("size").alias("near")))
    few = small(nodes)
    pivots = members.join(few, "node").groupBy("bucket").agg(F.min(F.struct((-F.col("near")).alias("x"), "node")).alias("p")).select("bucket", F.col("p.node").alias("pivot"))
    pairs = stored(members.join(pivots, "bucket").where("node <> pivot").select("pivot", "node").distinct())
    discard(shared, members)
    chosen = stored(classes.join(few, "node", "left_semi").select("node", "digest", "id"))
    own = _sets(named.join(small(chosen.select("id").distinct()), "id", "left_semi"), width)
    sets = stored(own.join(small(chosen.select("node", "digest")), "digest").select("node", "shingles").dropDuplicates(["node"]))
    both = pairs.join(sets.select("node", F.col("shingles").alias("s")), "node").join(sets.select(F.col("node").alias("pivot"), F.col("shingles").alias("p")), "pivot")
    verified = stored(both.select("pivot", "node", F.size("s").alias("n"), F.size("p").alias("np"), F.size(F.array_intersect("s", "p")).alias("common")))
    discard(pairs, chosen, nodes)
    links = verified.where(_linked(F.col("common"), F.col("n"), F.col("np"), percent)).select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    parts = components(links)
    rest = stored(_rest(verified, sets, parts, percent))
    if not rest.isEmpty():
        parts = components(links.unionByName(rest))
    discard(sets, verified, rest)
    top = stored(classes.join(parts, "node", "left").where("copies > 1 or component is not null").select("digest", "id", F.coalesce("component", "node").alias("component")))
    least = top.groupBy("component").agg(F.min("id").alias("component_id"))
    out = sketched.select("id", "n", "digest").join(top.drop("id").join(least, "component").select("digest", "component_id"), "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def keep(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component: the columns of docs, nothing else.

    Rows are told apart by id and text, so one id may have several texts. Of a component the least id stays; of rows
    that repeat both id and text the one of least hash over all its columns. A row with a null id stays.
    """
    id_, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = F.when(id_.isNotNull(), F.struct(id_.alias("id"), F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("hash")))
    found = stored(near_duplicates(docs.select(key.alias("key"), F.col(f"`{text_col}`").alias("text")), width=width, percent=percent, id_col="key").select(F.col("id").alias("key"), "kept"))
    gone = stored(found.where("not kept and key is not null").select("key").distinct())
    twice = stored(found.where("kept and key is not null").groupBy("key").count().where("count > 1").select("key"))
    return rows_left(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), key.alias("key")), ["key"], gone, twice)


def op8_minhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, percent=85)
    return out.withColumnRenamed("id", "doc_id")
