"""Benchmark decontamination by winnowing, with DataFrame functions only.

A text's words (A-Z lower-cased) give hashes of K-word grams; every window of `WINDOW` words keeps the least hash in it. Equal
windows keep equal hashes, so joining texts and items on kept hashes misses no shared window. Documents that hit are
extended to the windows themselves, which are compared word by word with those of the items. Items of fewer words than a
window are windows of their own length and are met by the hash of all their words.

Defined cases: null texts have no words; items without words, without text or without an id count for nothing; repeated
items count once; repeated rows of documents give a row each; null document ids are kept and compared as equal; extra columns
are ignored; with an empty benchmark nothing is hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, K = 10, 5
WORDS = r"[a-z0-9\x80-\x{10FFFF}]++"  # as [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, with the likeliest range tried first
EITHER_CASE = r"[a-zA-Z0-9\x80-\x{10FFFF}]++"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of benchmark fingerprints (16 bytes each) or windows (about 100 bytes) up to which they are broadcast; beyond, the joins shuffle.
BROADCAST_ROWS = 100_000


def words(text: Column) -> Column:
    """The words of a text. lower() is the fast way; where it would also change letters beyond A-Z, translate() stands in."""
    text = F.coalesce(text, F.lit(""))
    beyond = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    low = F.when(F.lower(beyond) == beyond, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(low, F.lit(WORDS), F.lit(0))


def _grams(n: int) -> str:
    """SQL: hashes of all n-word grams of w."""
    each = ", ".join(f"w[i + {j}]" if j else "w[i]" for j in range(n))
    return f"CASE WHEN size(w) >= {n} THEN transform(sequence(0, size(w) - {n}), i -> xxhash64({each})) ELSE CAST(array() AS array<bigint>) END"


def fingerprints(words_column: str, short: list[int]) -> Column:
    """The distinct kept hashes of a text, and the hashes of its grams of each length in `short`."""
    span = WINDOW - K + 1
    least = ", ".join(f"h[s + {j}]" if j else "h[s]" for j in range(span))
    kept = f"transform(array({_grams(K)}), h -> CASE WHEN size(h) >= {span} THEN transform(sequence(0, size(h) - {span}), s -> least({least})) ELSE CAST(array() AS array<bigint>) END)[0]"
    every = f"concat({', '.join([kept, *[_grams(n) for n in short]])})" if short else kept
    # transform over an array of one binds the words once, so that Catalyst can't copy their expression into the inner lambdas
    return F.expr(f"transform(array({words_column}), w -> array_distinct({every}))[0]")


def windows(words_column: str, short: list[int]) -> Column:
    """Struct (start, length, window) of every window of each length."""
    each = [f"CASE WHEN size(w) >= {n} THEN transform(sequence(0, size(w) - {n}), s -> named_struct('start', s, 'length', {n}, 'window', array_join(slice(w, s + 1, {n}), ' '))) ELSE CAST(array() AS array<struct<start:int,length:int,window:string>>) END" for n in [WINDOW, *short]]
    return F.expr(f"transform(array({words_column}), w -> {'concat(' + ', '.join(each) + ')' if short else each[0]})[0]")


def contamination(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs, and text_hash (of the text)."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    items = benchmark.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).filter(F.size("w") > 0).distinct()
    short = sorted(r["n"] for r in items.select(F.size("w").alias("n")).filter(F.col("n") < WINDOW).distinct().collect())  # nine lengths at most
    own = F.when(F.size("w") >= WINDOW, F.lit(WINDOW)).otherwise(F.size("w"))
    of_items = items.select("item", own.alias("n"), F.explode(windows("w", short)).alias("x")).filter(F.col("x.length") == F.col("n"))
    by_window = of_items.groupBy(F.col("x.window").alias("window"), F.col("x.length").alias("length")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    by_window = by_window.withColumn("set_id", F.sha2(F.to_json("items"), 256))
    prints = items.select(F.explode(F.when(F.size("w") >= WINDOW, fingerprints("w", [])).otherwise(F.array(_whole(short)))).alias("fp")).distinct()
    n_prints, n_windows = prints.count(), by_window.count()
    near = lambda df, n: F.broadcast(df) if n <= broadcast_rows else df

    listed = docs.select("doc_id", "text_hash", words(F.col("text")).alias("w"))
    hashes = listed.select("doc_id", "text_hash", F.explode(fingerprints("w", short)).alias("fp"))
    met = hashes.join(near(prints, n_prints), "fp", "left_semi").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    met = met.select(F.col("doc_id").alias("m_id"), F.col("text_hash").alias("m_hash"))
    # extend: all windows of the documents that were hit, compared as texts
    again = docs.join(met, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("text_hash") == F.col("m_hash")), "left_semi").dropDuplicates(["doc_id", "text_hash"])
    spans = again.select("doc_id", "text_hash", words(F.col("text")).alias("w")).select("doc_id", "text_hash", F.explode(windows("w", short)).alias("x"))
    spans = spans.select("doc_id", "text_hash", "x.start", "x.length", "x.window")
    hit = spans.join(near(by_window.select("window", "length", "set_id"), n_windows), ["window", "length"])
    per = hit.groupBy("doc_id", "text_hash").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1))))).cast("long").alias("n_hit"),
        F.collect_set("set_id").alias("sets"),
    )
    whole = per.select("doc_id", "text_hash", F.explode("sets").alias("set_id")).join(by_window.select("set_id", "items").dropDuplicates(["set_id"]), "set_id")
    named = whole.select("doc_id", "text_hash", F.explode("items").alias("item")).groupBy("doc_id", "text_hash").agg(F.collect_set("item").alias("items"))
    both = per.select("doc_id", "text_hash", "n_hit").join(named.select(F.col("doc_id").alias("n_id"), F.col("text_hash").alias("t2"), "items"), F.col("doc_id").eqNullSafe(F.col("n_id")) & (F.col("text_hash") == F.col("t2")))
    both = both.select(F.col("doc_id").alias("h_id"), F.col("text_hash").alias("h_hash"), "n_hit", "items")
    out = docs.select("doc_id", "text_hash", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(EITHER_CASE)).cast("long").alias("n_words"))
    out = out.join(both, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("text_hash") == F.col("h_hash")), "left")
    none = F.coalesce("items", F.expr("CAST(array() AS array<string>)"))
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(none).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(none), ",").cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), "text_hash",
    )


def _whole(short: list[int]) -> Column:
    """The hash of all words of a short item, as _grams() has it."""
    out = F.lit(None).cast("long")
    for n in short:
        out = F.when(F.size("w") == n, F.xxhash64(*[F.col("w")[j] for j in range(n)])).otherwise(out)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that no benchmark window hits, with their columns."""
    bad = contamination(docs, benchmark).filter("contaminated").select(F.col("doc_id").alias("bad_id"), "text_hash").distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["text_hash"]), "left_anti")
