"""Benchmark decontamination with DataFrame functions alone.

A benchmark item's windows are its runs of WINDOW consecutive normalised words (one shorter window for a shorter
item). The distinct windows form a hash set that is broadcast, filed under each window's longest word: every
word of a training text probes the set once, and a window found there is verified word for word at the place
that its longest word has in it. Splitting, generating, probing and verifying run in one code-generated stage;
only hits are shuffled. The set is broadcast if the benchmark's texts have at most BROADCAST_BYTES bytes. Beyond that
the hash of every run of a document's words that is as long as some window goes through a shuffle, with its place but
without any text, and meets the windows' hashes there; hashes that meet are verified word for word with the
documents that they came from. A hot window's rows may be split by adaptive execution.

Words: A-Z lower-cased, then maximal runs of digits, a-z and anything outside ASCII. Null and empty texts have
no words; items without words or without an id have no windows. Repeated documents rows are judged each by
their doc_id, repeated items count once. Empty tables give no rows, or clean ones. Extra columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, BROADCAST_BYTES = 10, 4 << 20

#: Applied before lower-casing, so A-Z are no separators.
SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, in their own case."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPLIT), "")


def folded(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: gram, length (words), anchor (its longest word), place (the anchor's in it), items."""
    item = benchmark.where("item_id is not null").select("item_id", words(folded(F.col("text"))).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - window, F.lit(0))
    cut = item.select("item_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("at")).select("item_id", F.slice("w", F.col("at") + 1, window).alias("g"))
    grams = cut.groupBy("g").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    longest = F.array_max(F.transform("g", lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("at"), x.alias("x"))))
    return grams.select(
        F.array_join("g", " ").alias("gram"), F.size("g").alias("length"), longest["x"].alias("anchor"), (-longest["at"]).alias("place"), "items"
    )


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, start and stop (word places, stop excluded), items: every occurrence of a window."""
    known = windows(benchmark, window)
    size = benchmark.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    if size > BROADCAST_BYTES:
        return _hits_by_hash(docs, known)
    known = F.broadcast(known)
    each = docs.select(F.col("doc_id"), words(F.col("text")).alias("w")).select("doc_id", "w", F.posexplode("w").alias("at", "word"))
    begin = F.col("at") - F.col("place")
    same = folded(F.array_join(F.slice("w", F.greatest(begin, F.lit(0)) + 1, F.col("length")), " ")) == F.col("gram")
    found = each.join(known, F.lower("word") == F.lower("anchor")).where((begin >= 0) & same)
    return found.select("doc_id", begin.alias("start"), (begin + F.col("length")).alias("stop"), "items")


def _runs(w: Column, length: int) -> Column:
    """(at, length, hash) of every run of so many words."""
    places = F.when(F.size(w) >= length, F.sequence(F.lit(0), F.size(w) - length)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(i.alias("at"), F.lit(length).alias("length"), F.xxhash64(F.array_join(F.slice(w, i + 1, length), " ")).alias("hash")))


def _hits_by_hash(docs: DataFrame, known: DataFrame) -> DataFrame:
    """hits for a set too large to broadcast."""
    known = known.select("gram", "length", "items", F.xxhash64("gram").alias("hash"))
    lengths = sorted(r.length for r in known.select("length").distinct().collect())  # at most the window's length of them
    each = docs.select(F.col("doc_id"), words(folded(F.col("text"))).alias("w"))
    if not lengths:
        return each.where("false").select("doc_id", F.lit(0).alias("start"), F.lit(0).alias("stop"), F.array().cast("array<string>").alias("items"))
    runs = each.select("doc_id", F.explode(F.concat(*[_runs(F.col("w"), n) for n in lengths])).alias("r")).select("doc_id", "r.*")
    met = runs.join(known.hint("merge"), ["hash", "length"]).select(F.col("doc_id").alias("met_doc"), "at", "length", "gram", "items")
    by_doc = met.groupBy("met_doc").agg(F.collect_set(F.struct("at", "length", "gram", "items")).alias("met"))
    both = each.join(by_doc, F.col("doc_id").eqNullSafe(F.col("met_doc"))).select("doc_id", "w", F.explode("met").alias("m"))
    proven = both.where(F.array_join(F.slice("w", F.col("m.at") + 1, F.col("m.length")), " ") == F.col("m.gram"))
    return proven.select("doc_id", F.col("m.at").alias("start"), (F.col("m.at") + F.col("m.length")).alias("stop"), F.col("m.items").alias("items"))


def found_in(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document with a hit: doc_id, n_hit, items (sorted strings), spans (sorted start and stop)."""
    by_doc = hits(docs, benchmark, window).groupBy("doc_id").agg(
        F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    covered = F.aggregate(
        "spans",
        none,
        lambda seen, s: F.struct(
            (seen["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(seen["upto"], s["start"]))).alias("n"), F.greatest(seen["upto"], s["stop"]).alias("upto")
        ),
        lambda seen: seen["n"],
    )
    return by_doc.select("doc_id", covered.cast("long").alias("n_hit"), "items", "spans")


def judge(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of docs."""
    found = found_in(docs, benchmark, window).select(F.col("doc_id").alias("hit_doc"), "n_hit", "items")
    every = docs.select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    joined = every.join(found, F.col("doc_id").eqNullSafe(F.col("hit_doc")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without every document in which a window occurs; columns unchanged."""
    bad = hits(docs, benchmark, window).select(F.col("doc_id").alias("_hit_doc")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_hit_doc"]), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the hit words and the separators between neighbouring hit words taken out of their texts."""
    found = found_in(docs, benchmark, window).select(F.col("doc_id").alias("_hit_doc"), F.col("spans").alias("_hit_spans"))
    joined = docs.join(found, docs["doc_id"].eqNullSafe(found["_hit_doc"]), "left")
    text = docs["text"]
    pieces = F.regexp_extract_all(text, F.lit(f"({SPLIT}|{SPLIT.replace('[', '[^', 1)})"), F.lit(1))
    first = F.when(F.regexp_like(text, F.lit(f"^{SPLIT}")), 1).otherwise(0)

    def stays(piece, i):
        number = F.floor((i - first) / 2)  # of the word, or of the word before a separator
        word = (i - first) % 2 == 0
        return ~F.exists(found["_hit_spans"], lambda s: (s["start"] <= number) & (number < s["stop"] - F.when(word, 0).otherwise(1)))

    cleaned = F.when(found["_hit_doc"].isNotNull(), F.array_join(F.filter(pieces, stays), "")).otherwise(text)
    return joined.select(*[cleaned.alias("text") if c == "text" else docs[c] for c in docs.columns])
