"""Benchmark decontamination by winnowing, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuegrid.llm.common import small, stored

#: Words of a window that counts as a passage, and of the grams whose least hash stands for it.
SPAN, GRAM = 10, 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BETWEEN), "")


def _first(items: Column, less: int) -> Column:
    return F.slice(items, F.lit(1), F.greatest(F.size(items) - less, F.lit(0)))


def _grams(words_: Column, gram: int) -> Column:
    """The hash of each run of ``gram`` words."""
    return F.transform(_first(words_, gram - 1), lambda w, i: F.xxhash64(w, *[F.get(words_, i + k) for k in range(1, gram)]))


def _minima(grams: Column, wide: int) -> Column:
    """The least of each ``wide`` hashes in a row."""
    if wide == 1:
        return grams
    return F.transform(_first(grams, wide - 1), lambda h, i: F.least(h, *[F.get(grams, i + k) for k in range(1, wide)]))


def _changes(minima: Column) -> Column:
    """Where a least hash differs from the one before it."""
    places = F.filter(F.sequence(F.lit(0), F.size(minima) - 1), lambda i: (i == 0) | (F.get(minima, i) != F.get(minima, i - 1)))
    return F.when(F.size(minima) > 0, places).otherwise(F.array().cast("array<int>"))


def _runs(minima: Column, changes: Column, span: int) -> Column:
    """Windows in a row with one least hash: first, end, span and that hash."""
    return F.transform(changes, lambda c, j: F.struct(c.alias("first"), F.coalesce(F.get(changes, j + 1), F.size(minima)).alias("end"), F.lit(span).alias("span"), F.get(minima, c).alias("print")))


def fingerprints(df: DataFrame, spans: list[int], gram: int) -> DataFrame:
    """df, which has ``words``, with ``runs``: the fingerprints of its windows of each of the spans.

    A window's fingerprint is the least hash of its grams; windows in a row with one fingerprint are one run. A window
    shorter than two grams in a row has itself as its only gram.
    """
    own = []
    for span in spans:
        k = gram if span > gram else span
        # Each step is a column of its own, so that no step is worked out again for each element of the next.
        df = df.withColumn(f"grams{span}", _grams(F.col("words"), k))
        df = df.withColumn(f"least{span}", _minima(F.col(f"grams{span}"), span - k + 1))
        df = df.withColumn(f"changes{span}", _changes(F.col(f"least{span}")))
        own.append(_runs(F.col(f"least{span}"), F.col(f"changes{span}"), span))
    return df.withColumn("runs", F.concat(*own)).drop(*[f"{c}{s}" for c in ("grams", "least", "changes") for s in spans])


def _text_key(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def item_windows(items: DataFrame, span: int, *, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, list[int]]:
    """(windows, of, spans): the distinct windows (window_id, window, span), the items of each (window_id, item), and the windows' lengths in words.

    An item of fewer words than ``span`` is one window; one without words has none. A null id counts as the empty id.
    """
    named = items.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("item"), words(F.col(f"`{text_col}`")).alias("words")).where(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(span))
    starts = named.select("item", "words", size.alias("span"), F.explode(F.sequence(F.lit(1), F.size("words") - size + 1)).alias("at"))
    cut = stored(starts.select("item", "span", F.array_join(F.slice("words", F.col("at"), F.col("span")), " ").alias("window")).distinct())
    windows = stored(cut.select("window", "span").distinct().select(F.monotonically_increasing_id().alias("window_id"), "window", "span"))
    spans = sorted(r.span for r in windows.select("span").distinct().collect())  # at most ``span`` numbers
    return windows, cut.join(windows, ["window", "span"]).select("window_id", "item"), spans


def contaminated(docs: DataFrame, items: DataFrame, *, span: int = SPAN, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) of each row of docs.

    A window is ``span`` consecutive words of an item, or the whole of a shorter one. Documents and windows are reduced
    to fingerprints: of each window the least hash of its grams. Equal windows have equal fingerprints, so a join of the
    fingerprints misses no shared window. Each hit is extended to the windows that its run stands for, whose whole
    words are then compared; overlapping ones add up to spans of hit words.

    Texts are known by their SHA-256, so what copies hit is worked out in one group whose rows Spark combines before the
    shuffle. Only texts that share a fingerprint are read again. The items found depend on the set of windows alone and
    are looked up once for each set. Sides of joins are broadcast only if they are counted and small.

    Null and empty texts have no words. Repeated rows are rows of their own. An empty table gives none; without items
    nothing is hit. Only the named columns are read, so others cannot clash.
    """
    windows, of, spans = item_windows(items, span)
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    read = docs.select(id_.alias("id"), _text_key(text).alias("key"), words(text).alias("words"))
    if not spans:
        rows = read.select("id", F.size("words").cast("long").alias("n_words"))
        none = F.sha2(F.lit(""), 256)
        return rows.select("*", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), none.alias("items_sha256"), F.lit(False).alias("contaminated"))
    rows = stored(fingerprints(read, spans, gram).select("id", "key", F.size("words").cast("long").alias("n_words"), "runs"))
    prints = fingerprints(windows.withColumn("words", F.split("window", " ")), spans, gram).select(F.explode("runs").alias("r"), "span")
    prints = stored(prints.where("r.span = span").select("span", F.col("r.print").alias("print")).distinct())
    runs = rows.select("key", F.explode("runs").alias("r")).select("key", "r.first", "r.end", "r.span", "r.print")
    shared = stored(runs.join(small(prints), ["span", "print"], "left_semi").groupBy("key").agg(F.collect_set(F.struct("first", "end", "span")).alias("runs")))
    # A text has fewer runs than words, so they fit beside it.
    texts = docs.select(_text_key(text).alias("key"), text.alias("text")).join(small(shared), "key").select("key", words(F.col("text")).alias("words"), F.explode("runs").alias("r"))
    opened = texts.select("key", "words", "r.span", F.explode(F.sequence(F.col("r.first"), F.col("r.end") - 1)).alias("at"))
    cut = opened.select("key", "at", "span", F.array_join(F.slice("words", F.col("at") + 1, F.col("span")), " ").alias("window"))
    hits = stored(cut.join(small(windows), ["window", "span"]).groupBy("key").agg(F.collect_set(F.struct("at", (F.col("at") + F.col("span")).alias("end"))).alias("spans"), F.sort_array(F.collect_set("window_id")).alias("found")))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    joined = F.aggregate(F.array_sort("spans"), start, lambda s, x: F.struct((s["n"] + F.greatest(x["end"] - F.greatest(x["at"], s["to"]), F.lit(0))).alias("n"), F.greatest(x["end"], s["to"]).alias("to")))
    sets = hits.select("found").distinct().select("found", F.explode("found").alias("window_id")).join(small(of), "window_id")
    named = sets.groupBy("found").agg(F.sort_array(F.collect_set("item")).alias("items"))
    named = named.select("found", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    result = stored(hits.select("key", "found", joined["n"].cast("long").alias("n_hit")).join(named, "found").select("key", "n_hit", "n_items", "items_sha256"))
    whole = rows.select("id", "key", "n_words").join(small(result), "key", "left")
    zero = F.lit(0).cast("long")
    return whole.select(
        "id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def op13_winnowing(spark, sf_dir: str) -> DataFrame:
    found = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumnRenamed("id", "doc_id")


OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
x AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0),
y AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM x),
z AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM y) WHERE len(w) >= n),
h AS (SELECT doc_id, i, n, item_id FROM z JOIN y USING (n) WHERE array_to_string(w[i:i + n - 1], ' ') = win),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
q AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)
"""
