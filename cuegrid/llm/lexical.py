"""Ranked lexical search as a blocked sparse product of item-term counts and term-document impacts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from cuegrid.llm.common import discard, shared_dir, stored
from cuegrid.llm.textnum import SIGNS, Words, freed, pieces

#: Items are searched for in blocks of about so many bytes of text, which bounds what every task is sent.
ITEM_BYTES = 8 << 20
#: Bytes of text taken apart at once, and documents of a block of the product.
PART_BYTES, BLOCK_ROWS = 2 << 20, 4096
_ONE = 1_000_000_000


@dataclass
class Items:
    """Items as rows of a sparse matrix: ``terms[first[i]:first[i + 1]]`` and ``times`` are the terms of item i and how often it holds each; a term's number is its place among the sorted ``hashes``."""

    ids: list
    first: np.ndarray
    terms: np.ndarray
    times: np.ndarray
    hashes: np.ndarray
    data: np.ndarray  # the terms' bytes
    starts: np.ndarray
    sizes: np.ndarray


def item_matrix(rows: list[tuple]) -> Items:
    """The matrix of (id, text) rows."""
    words = Words(pa.array([t for _, t in rows], pa.string()), SIGNS)
    hashes, at = np.unique(words.hashes(), return_index=True)
    seen = [bytes(words.data[s:e]) for s, e in zip(words.starts, words.ends, strict=True)]
    if len(set(seen)) != len(hashes):
        raise ValueError("two terms of a block of items share a 64-bit hash: change ITEM_BYTES")
    number = {seen[a]: k for k, a in enumerate(at.tolist())}
    first, terms, times = [0], [], []
    for i in range(len(rows)):
        own = Counter(number[w] for w in seen[words.first[i] : words.first[i + 1]])
        terms += own.keys()
        times += own.values()
        first.append(len(terms))
    sizes = (words.ends - words.starts)[at]
    data = np.frombuffer(b"".join(seen[a] for a in at.tolist()), np.uint8)
    return Items([i for i, _ in rows], np.array(first), np.array(terms, np.int64), np.array(times, np.int64), hashes, data, np.cumsum(sizes) - sizes, sizes)


def _known(words: Words, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(places among the words, terms) of the words that are terms of the items; equal hashes are compared byte by byte."""
    hashes = words.hashes()
    term = np.minimum(np.searchsorted(items.hashes, hashes), len(items.hashes) - 1)
    place = np.flatnonzero(items.hashes[term] == hashes)
    term = term[place]
    begin, size = words.starts[place], (words.ends - words.starts)[place]
    same = size == items.sizes[term]
    place, term, begin, size = place[same], term[same], begin[same], size[same]
    offset = np.cumsum(size) - size
    step = np.arange(int(size.sum()))
    differs = words.data[np.repeat(begin - offset, size) + step] != items.data[np.repeat(items.starts[term] - offset, size) + step]
    wrong = np.zeros(len(place), bool)
    wrong[np.searchsorted(offset, np.flatnonzero(differs), "right") - 1] = True
    return place[~wrong], term[~wrong]


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(values.astype(np.int32)))


def _postings(piece: pa.RecordBatch, items: Items) -> pa.RecordBatch:
    """(id, n, terms, times) of the piece's texts that have a term at all: the terms of the items that a text holds."""
    words = Words(piece.column("text"), SIGNS)
    n = np.diff(words.first)
    place, term = _known(words, items)
    key, times = np.unique(words.row[place] * len(items.hashes) + term, return_counts=True)
    row = key // len(items.hashes)
    ends = np.searchsorted(row, np.arange(len(n)), "right")
    out = pa.RecordBatch.from_arrays([piece.column("id"), pa.array(n), _lists(key % len(items.hashes), ends), _lists(times, ends)], ["id", "n", "terms", "times"])
    return out.filter(pa.array(n > 0))


def _best(scores: np.ndarray, ids: np.ndarray, unnamed: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, equal ones by id, no id last."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], unnamed[some], -scores[some]))[:k]]


class Ranking:
    """The k best documents of each item among the blocks so far."""

    def __init__(self, items: Items, weights: np.ndarray, documents: int, words: int, k: int):
        self.items, self.weights, self.documents, self.words, self.k = items, weights, documents, words, k
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in items.ids]

    def impacts(self, block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The block's matrix by terms: (first place of each term, document of each place, 64-bit impact of each place)."""
        lists = block.column("terms")
        of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        term, times = (block.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "times"))
        m = 75 + (25 * block.column("n").to_numpy() * self.documents) // self.words
        value = self.weights[term] * ((_ONE * times) // (1000 * times + 12 * m[of]))
        order = np.argsort(term, kind="stable")
        return np.searchsorted(term[order], np.arange(len(self.weights) + 1)), of[order], value[order]

    def add(self, block: pa.RecordBatch) -> None:
        first, of, value = self.impacts(block)
        ids = np.asarray(block.column("id").fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        unnamed = np.asarray(block.column("id").is_null().to_numpy(zero_copy_only=False), bool)
        row = np.zeros(block.num_rows, np.int64)
        for i in range(len(self.items.ids)):
            # Gustavson: an item's row of the product is the sum of the matrix rows of its terms, each times its count.
            for q in range(self.items.first[i], self.items.first[i + 1]):
                t = self.items.terms[q]
                some = slice(first[t], first[t + 1])
                row[of[some]] += self.items.times[q] * value[some]
            hit = np.flatnonzero(row)
            if len(hit):
                scores, named, none = self.best[i]
                if len(scores) == self.k:
                    hit = hit[row[hit] >= scores[-1]]
                scores, named, none = np.concatenate((scores, row[hit])), np.concatenate((named, ids[hit])), np.concatenate((none, unnamed[hit]))
                top = _best(scores, named, none, self.k)
                self.best[i] = scores[top], named[top], none[top]
                row[:] = 0

    def rows(self) -> pa.RecordBatch:
        item = np.repeat(np.arange(len(self.best)), [len(x[0]) for x in self.best])
        scores, ids, none = (np.concatenate([x[k] for x in self.best]) for k in range(3))
        return pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=none), pa.array(scores)], ["item", "id", "score"])


def _blocks(items: DataFrame, limit: int) -> Iterator[list[Row]]:
    """Rows of the items in blocks of about so many bytes of text."""
    held, size = [], 0
    for r in items.toLocalIterator():
        held.append(r)
        size += len((r.text or "").encode()) + 64
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _searched(docs: DataFrame, rows: list[Row], k: int) -> DataFrame | None:
    """(item_id, item, id, score): at most k rows of an item from each task; item is its place in the block."""
    spark = docs.sparkSession
    items = item_matrix([(r.id, r.text) for r in rows])
    if not len(items.hashes):
        return None
    sent = spark.sparkContext.broadcast(items)  # of a block of items

    def taken_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (x for batch in batches for x in pieces(batch, "text", PART_BYTES)):
            yield _postings(piece, sent.value)
        freed()

    postings = stored(docs.mapInArrow(taken_apart, "id long, n long, terms array<int>, times array<int>"))
    total = postings.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("words")).first()
    if not total.documents:
        discard(postings)
        return None
    df = F.col("df").cast("double")
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0 * total.documents + 2.0)) / (2 * df + 1))).cast("long")
    weights = np.zeros(len(items.hashes), np.int64)
    for r in postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", weight.alias("w")).toLocalIterator():
        weights[r.term] = r.w  # of the block's terms
    weighed = spark.sparkContext.broadcast(weights)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranking = Ranking(sent.value, weighed.value, total.documents, total.words, k)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                ranking.add(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in batch.slice(at, BLOCK_ROWS).columns], batch.schema.names))
        yield ranking.rows()
        freed()

    best = stored(postings.mapInArrow(ranked, "item long, id long, score long"))
    discard(postings)
    sent.unpersist()
    weighed.unpersist()
    names = spark.createDataFrame([(k, r.id) for k, r in enumerate(rows)], f"item long, item_id {docs.item_type}")
    return best.join(F.broadcast(names), "item")  # as many rows as the block has items


def search(docs: DataFrame, items: DataFrame, k: int = 20, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, id, score): the k documents of highest score above 0 for each row of items, equal scores by id.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. A document's score for
    an item is the product of the item's term counts and the terms' impacts on the document, in 64-bit integers: rarer
    terms weigh more, and an impact grows less and less with the term's occurrences and falls with the document's length.

    Items go through in blocks of bounded size. For each block the documents are taken apart into the counts of the
    block's terms, which are kept in the shared folder; from them come the numbers of documents of each term, then the
    product, block of documents by block of documents, each of which hands on the k best of each item only. So a task
    sends at most k rows an item, and these are ranked once more.

    Ids of documents are whole numbers. Null texts have no terms. Rows that repeat an id, of documents or of items, are
    rows of their own; a null id of a document comes last among equals. Empty tables and items without terms give no
    rows. Only the named columns are read, so others cannot clash.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    asked = items.select(F.col(f"`{item_id_col}`").alias("id"), F.col(f"`{item_text_col}`").alias("text"))
    named.item_type = asked.schema["id"].dataType.simpleString()
    found = spark.createDataFrame([], f"item long, id long, score long, item_id {named.item_type}, block int")
    for b, rows in enumerate(_blocks(asked, item_bytes)):
        if (one := _searched(named, rows, k)) is not None:
            found = found.unionByName(one.withColumn("block", F.lit(b)))
    order = Window.partitionBy("block", "item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "id", "score")


def op11_lexical(spark, sf_dir: str) -> DataFrame:
    found = search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumnRenamed("id", "doc_id")


OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_words FROM d WHERE len(w) > 0),
t AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d) GROUP BY ALL),
g AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * df + 1)))::BIGINT AS weight
      FROM (SELECT term, count(*) AS df FROM t GROUP BY term), s),
q AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
r AS (SELECT item_id, doc_id,
             sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_words))))::BIGINT AS score
      FROM q JOIN t USING (term) JOIN g USING (term), s GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 20
"""
