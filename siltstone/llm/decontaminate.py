"""Benchmark decontamination with DataFrame functions only: a constant hash set of test n-grams, window hashes, exact verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, located, table, written

#: Fixed values of the contract: what a word is (in texts whose A-Z aren't lowered yet) and the letters that are lowered.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many distinct windows the benchmark's are constants of the plan, a broadcast set of proven size; beyond it they
#: are a table that window hashes are joined to. Both give the same rows.
MOST_CONSTANTS = 200_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _lowered(word: Column) -> Column:
    """lower() changes letters beyond A-Z, so only words of ASCII letters go through it."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def bench_windows(bench: DataFrame, n: int = 10) -> DataFrame:
    """(item_id, text) -> distinct (window, size, item_id): runs of n words, or all words of an item of fewer."""
    w = bench.select(F.col("item_id").cast("string").alias("item_id"), F.transform(words(F.col("text")), _lowered).alias("w")).where("size(w) > 0")
    cut = w.select("item_id", F.explode(F.expr(f"transform(sequence(1, greatest(1, size(w) - {n - 1})), i -> slice(w, i, {n}))")).alias("x"))
    return cut.select(F.array_join("x", " ").alias("window"), F.size("x").alias("size"), "item_id").distinct()


def _window_hashes(df: DataFrame, base: str, sizes: list[int]) -> tuple[DataFrame, dict[int, str]]:
    """Columns with the hash of the window of each size that starts at each word. A window's hash is put together from
    those of halves: 10 = 8 + 2, 8 = 4 + 4, and so on, so it takes a few steps a word, whatever the size. base: column of words' hashes."""
    have = {1: base}

    def add(n: int) -> None:
        nonlocal df
        if n in have:
            return
        big = 1 << (n - 1).bit_length() - 1
        for part in (big, n - big):
            add(part)
        (name,) = fresh(df, f"h{n}")
        df = df.withColumn(name, F.expr(f"zip_with(`{have[big]}`, slice(`{have[n - big]}`, {big + 1}, size(`{have[n - big]}`)), (a, b) -> xxhash64(a, b))"))
        have[n] = name

    for n in sizes:
        add(n)
    return df, have


def _gram_hash(window: Column, n: int) -> Column:
    """The same hash for one window of n words, from its text."""
    parts = {1: [F.xxhash64(F.element_at(F.split(window, " "), k + 1)) for k in range(n)]}

    def of(at: int, size: int) -> Column:
        if size == 1:
            return parts[1][at]
        big = 1 << (size - 1).bit_length() - 1
        return F.xxhash64(of(at, big), of(at + big, size - big))

    return of(0, n)


class Benchmark:
    """The windows of a benchmark, counted first: small ones become constants."""

    def __init__(self, bench: DataFrame, n: int = 10, most: int = MOST_CONSTANTS):
        self.table = written(bench_windows(bench, n), "windows")
        self.sizes = sorted(r.size for r in self.table.select("size").distinct().collect())  # n of them at most
        self.constant = self.table.count() <= most
        if self.constant:
            self.by_size = {s: [tuple(r) for r in self.table.where(F.col("size") == s).select("window", _gram_hash(F.col("window"), s)).distinct().collect()] for s in self.sizes}


def with_hits(docs: DataFrame, text: str, bench: Benchmark, hits: str, count: str) -> DataFrame:
    """docs with the column count, its number of words, and hits: array of (at, size, window), each a benchmark window
    in the text, verified by its words. at counts from 1. Only where the benchmark's windows are constants."""
    w, h = fresh(docs, "word_list", "word_hashes")
    df = docs.withColumn(w, words(F.col(text)))
    df = df.withColumn(h, F.transform(F.col(w), lambda x: F.xxhash64(_lowered(x))))
    df, have = _window_hashes(df, h, bench.sizes)
    def of_size(s: int) -> Column:
        own, (grams, hashes) = F.col(have[s]), map(list, zip(*bench.by_size[s], strict=True))
        # the hashes are an argument: within a lambda's body they would be made anew for each word
        at = F.filter(F.transform(own, lambda x, i: F.when(x.isin(hashes) & (i <= F.size(w) - s), i + 1)), lambda i: i.isNotNull())
        cut = F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(s).alias("size"), F.array_join(F.transform(F.slice(F.col(w), i, F.lit(s)), _lowered), " ").alias("window")))
        return F.filter(cut, lambda x: x["window"].isin(grams))

    none = F.expr("cast(array() as array<struct<at:int,size:int,window:string>>)")
    found = F.concat(none, *map(of_size, bench.sizes))
    return df.withColumn(count, F.size(w).cast("long")).withColumn(hits, found).select(*docs.columns, count, hits)


def _joined_hits(docs: DataFrame, key: str, text: str, bench: Benchmark) -> DataFrame:
    """(key, hit) as in with_hits, for benchmarks of any size: window hashes meet the benchmark's in a join, with the
    place and nothing of the text. Only documents with a hash in common are read again, to compare the words."""
    df = docs.select(key, F.transform(words(F.col(text)), lambda x: F.xxhash64(_lowered(x))).alias("h1"))
    df, have = _window_hashes(df, "h1", bench.sizes)
    met = None
    for s in bench.sizes:
        mine = bench.table.where(F.col("size") == s).select(_gram_hash(F.col("window"), s).alias("g")).distinct()
        cut = df.where(F.size("h1") >= s).select(key, F.posexplode(F.slice(have[s], F.lit(1), F.size("h1") - (s - 1))).alias("i", "g"))
        cut = cut.join(mine, "g", "left_semi").select(key, F.struct((F.col("i") + 1).alias("at"), F.lit(s).alias("size")).alias("x"))
        met = cut if met is None else met.union(cut)
    per = met.groupBy(F.col(key).alias("of")).agg(F.collect_list("x").alias("found"))
    # the words are an argument: within a lambda's body they would be made anew for each hit
    hit = lambda w: F.transform("found", lambda x: F.struct(x["at"].alias("at"), x["size"].alias("size"), F.array_join(F.transform(F.slice(w, x["at"], x["size"]), _lowered), " ").alias("window")))
    again = docs.select(key, text).join(per, F.col(key) == F.col("of")).select(key, F.explode(F.transform(F.array(words(F.col(text))), hit)[0]).alias("hit"))
    return again.join(bench.table.select("window").distinct(), F.col("hit.window") == F.col("window"), "left_semi")


def _spans(hits: DataFrame) -> DataFrame:
    """(rid, hit) -> (rid, spans, n_hit): the words that hits cover, touching ones merged, in one walk in order of place."""
    by = W.partitionBy("rid").orderBy("a", "b")  # one document
    at = hits.select("rid", (F.col("hit.at") - 1).alias("a"), (F.col("hit.at") - 1 + F.col("hit.size")).alias("b")).distinct()
    at = at.withColumn("new", F.coalesce(F.col("a") > F.max("b").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(True)))
    at = at.withColumn("span", F.sum(F.col("new").cast("int")).over(by.rowsBetween(W.unboundedPreceding, 0)))
    merged = at.groupBy("rid", "span").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return merged.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"), F.sum(F.col("b") - F.col("a")).alias("n_hit"))


def contamination(docs: DataFrame, bench: DataFrame, n: int = 10, most: int = MOST_CONSTANTS) -> DataFrame:
    """docs (doc_id, text), bench (item_id, text) -> doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    spans: the word ranges (from, to), to exclusive and counted from 0, that hit windows cover; overlaps are merged.
    Null or empty text has no words and no hits. Items without words have no windows. Rows with equal or null doc_id
    stay rows. An empty benchmark contaminates nothing. Other columns are ignored.
    """
    known = Benchmark(bench, n, most)
    docs = docs.select("doc_id", "text")
    if known.constant:
        base = written(with_hits(docs, "text", known, "hits", "n_words").select(F.monotonically_increasing_id().alias("rid"), "doc_id", "n_words", "hits"), "hits")
        hits = base.select("rid", F.explode("hits").alias("hit"))
    else:
        placed = written(docs.select(F.monotonically_increasing_id().alias("rid"), "*"), "docs")
        base = placed.select("rid", "doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"))
        hits = _joined_hits(placed, "rid", "text", known)
    # a window's items come as one list, so a window of many items doesn't multiply the documents that hold it
    listed = known.table.groupBy("window").agg(F.collect_set("item_id").alias("items"))
    per = hits.select("rid", F.col("hit.window").alias("window")).distinct().join(listed, "window").groupBy("rid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    none = F.expr("cast(array() as array<string>)")
    out = base.join(per, "rid", "left").join(_spans(hits).withColumnRenamed("n_hit", "covered"), "rid", "left")
    covered = F.coalesce("covered", F.lit(0))
    return out.select(
        "doc_id",
        "n_words",
        covered.cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
        (covered > 0).alias("contaminated"),
        F.coalesce("spans", F.expr("cast(array() as array<struct<a:int,b:int>>)")).alias("spans"),
    )


def uncontaminated(docs: DataFrame, bench: DataFrame, n: int = 10, most: int = MOST_CONSTANTS) -> DataFrame:
    """docs without the documents that hold a benchmark window; all columns are kept. No shuffle where the windows are constants."""
    known = Benchmark(bench, n, most)
    if known.constant:
        hits, count, once = fresh(docs, "hits", "n_words", "once")
        # a filter goes below a projection and would make its columns anew, each hash many times; not below this one
        found = with_hits(docs, "text", known, hits, count).withColumn(once, F.monotonically_increasing_id())
        return found.where((F.size(hits) == 0) & (F.col(once) >= 0)).select(*docs.columns)
    file, row = fresh(docs, "at_file", "at_row")
    placed = located(docs, file, row)
    bad = _joined_hits(placed.select(F.struct(file, row).alias("rid"), "text"), "rid", "text", known).select(F.col(f"rid.{file}"), F.col(f"rid.{row}")).distinct()
    return placed.join(bad, [file, row], "left_anti").select(*docs.columns)


#: The items' windows and the documents' by exact text; spans of covered words are counted by position.
ORACLE = """
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bg AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
       FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bg),
dg AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, dg.n, i, item_id FROM dg JOIN bg ON dg.g = bg.g AND dg.n = bg.n),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")
