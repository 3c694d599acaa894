"""Benchmark decontamination with a broadcast hash set of test n-grams.

Main path: DataFrame functions only.  Every window of ``window`` words of a
document is reduced to a 64-bit probe made of five of its words, and the
probes are looked up in the broadcast table of benchmark windows.  The few
that meet one go back to their document, where all words of the window are
compared, so a reported hit is exact.  The windows' bytes are summed before
they are broadcast; beyond ``max_broadcast_bytes`` the same join is a shuffled
one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Word characters after A-Z are lower-cased: digits, a-z and all beyond ASCII.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]++"
ANY_CASE_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]++"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, the value computed once: what a lambda only captures is computed again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def probe(words: Column, start: Column, length: int) -> Column:
    """64 bits from up to five words spread over the window at ``start`` (from 0)."""
    offsets = sorted({round(j * (length - 1) / 4) for j in range(5)})
    return F.xxhash64(F.lit(length), *[words[start + F.lit(o)] for o in offsets])


def benchmark_windows(benchmark: DataFrame, window: int = 13) -> DataFrame:
    """Distinct windows: ``w_words, w_len, w_items`` (item ids as sorted strings).

    An item of fewer words than ``window``, but not none, is one window.
    Null or wordless items have none; repeated items count once.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("ws"))
    n = F.size("ws")
    length = F.least(F.lit(window), n)
    starts = (
        items.where(n > 0)
        .select("item", "ws", length.alias("w_len"), F.explode(F.sequence(F.lit(0), n - length)).alias("s"))
        .select("item", "w_len", F.slice("ws", F.col("s") + 1, F.col("w_len")).alias("w_words"))
    )
    return starts.groupBy("w_words", "w_len").agg(F.array_sort(F.collect_set("item")).alias("w_items"))


def _with_probe(windows: DataFrame, lengths: list[int]) -> DataFrame:
    key = F.lit(None).cast("long")
    for n in lengths:
        key = F.when(F.col("w_len") == n, probe(F.col("w_words"), F.lit(0), n)).otherwise(key)
    return windows.withColumn("w_key", key)


def find_hits(documents: DataFrame, benchmark: DataFrame, *, window: int = 13, max_broadcast_bytes: int = 64 << 20) -> DataFrame:
    """One row per document row: ``doc_id, text_hash, n_words, spans, items``.

    ``spans`` holds the verified windows as (start word, length); ``items`` the
    ids of items with an occurring window, as sorted distinct strings.  Rows
    that repeat both id and text give equal rows.  A null text has no words;
    a null id stays null.  An empty benchmark hits nothing.
    """
    windows = benchmark_windows(benchmark, window)
    size = F.octet_length(F.concat_ws(" ", "w_words")) + F.octet_length(F.concat_ws(" ", "w_items")) + 16 * (F.size("w_words") + F.size("w_items")) + 64
    known = windows.groupBy("w_len").agg(F.sum(size).alias("bytes")).collect()  # at most `window` rows
    lengths = sorted(r["w_len"] for r in known)
    table = _with_probe(windows, lengths)
    small = sum(r["bytes"] for r in known) <= max_broadcast_bytes
    table = F.broadcast(table) if small else table.hint("shuffle_hash")

    texts = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    nothing = F.array().cast("array<struct<at:int,len:int,key:bigint>>")

    def scan(n: int) -> Column:
        one = lambda i: F.struct(i.alias("at"), F.lit(n).alias("len"), probe(F.col("ws"), i, n).alias("key"))
        return F.when(F.size("ws") >= n, F.transform(F.sequence(F.lit(0), F.size("ws") - F.lit(n)), one)).otherwise(nothing)

    # Probes travel without the words; those that meet a window go back to their text to be verified.
    scans = F.concat(*[scan(n) for n in lengths], nothing)
    probes = texts.select("doc_id", "text_hash", words_of(F.col("text")).alias("ws")).select("doc_id", "text_hash", F.inline(scans))
    same = (F.col("key") == F.col("w_key")) & (F.col("len") == F.col("w_len"))
    met = probes.join(table, same).groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_set(F.struct("at", "len", "w_words", "w_items")).alias("met"))
    own = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    joined = texts.join(met, own, "left").withColumn("ws", F.when(F.col("met").isNotNull(), words_of(F.col("text"))))
    # Transformed, so that a slice takes its words only and doesn't unpack the row's whole array.
    hits = _let(F.transform("ws", lambda w: w), lambda ws: F.filter("met", lambda m: F.slice(ws, m["at"] + 1, m["len"]) == m["w_words"]))
    verified = joined.withColumn("hits", F.coalesce(hits, F.array().cast(met.schema["met"].dataType)))
    n_words = F.coalesce(F.when(F.col("ws").isNotNull(), F.size("ws")).otherwise(F.regexp_count("text", F.lit(ANY_CASE_WORD))), F.lit(0))
    spans = F.transform("hits", lambda m: F.struct(m["at"].alias("at"), m["len"].alias("len")))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda m: m["w_items"]))))
    return verified.select("doc_id", "text_hash", n_words.alias("n_words"), spans.alias("spans"), items.alias("items"))


def hit_words(spans: Column) -> Column:
    """Numbers of the words inside the spans, sorted, each once."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["at"], s["at"] + s["len"] - 1)))))


def digest(hits: DataFrame, *, one_in: int = 20, whole_window: int | None = None) -> DataFrame:
    """Counts and verdict: contaminated if at least one word in ``one_in`` is hit or, where it is given, a window of ``whole_window`` words."""
    any_window = F.lit(False) if whole_window is None else F.exists("spans", lambda s: s["len"] >= whole_window)
    n_hit = F.size(hit_words(F.col("spans"))).cast("long")
    return hits.select(
        "doc_id",
        "text_hash",
        "spans",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & ((F.col("n_hit") * one_in >= F.col("n_words")) | any_window))


def without_spans(text: Column, spans: Column) -> Column:
    """``text`` without the words that lie inside a span and the gap before each.  Work is linear in the text."""
    words = F.concat(F.regexp_extract_all(text, F.lit(ANY_CASE_WORD), F.lit(0)), F.array(F.lit("")))
    pieces = F.zip_with(F.split(text, ANY_CASE_WORD), words, lambda gap, word: F.concat(gap, word))
    first = lambda hit: F.filter(hit, lambda p, i: (i == 0) | (F.get(hit, i - 1) != p - 1))
    last = lambda hit: F.filter(hit, lambda p, i: (i == F.size(hit) - 1) | (F.get(hit, i + 1) != p + 1))
    # What stays: from after each run of hit words to the next.
    starts = lambda hit: F.concat(F.array(F.lit(0)), F.transform(last(hit), lambda p: p + 1))
    ends = lambda hit: F.concat(first(hit), F.array(F.lit(1 << 30)))
    kept = _let(pieces, lambda all_: _let(hit_words(spans), lambda hit: F.zip_with(starts(hit), ends(hit), lambda a, b: F.array_join(F.slice(all_, a + 1, b - a), ""))))
    return F.when(F.size(spans) > 0, F.array_join(kept, "")).otherwise(text)


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, remove: str = "documents", window: int = 13, one_in: int = 20, any_window: bool = False) -> DataFrame:
    """The documents without benchmark text, all columns kept.

    Contaminated is a document with at least one hit word in ``one_in`` and,
    with ``any_window``, one that has any whole window, however long it is; an
    item shorter than a window, which may be a common phrase, doesn't do that.

    ``remove="documents"`` drops contaminated documents and leaves the others
    as they are; ``"spans"`` cuts the hit words out of every document;
    ``"both"`` drops the contaminated and cuts spans from the rest.
    """
    if remove not in ("documents", "spans", "both"):
        raise ValueError(f"remove: {remove}")
    found = digest(find_hits(documents, benchmark, window=window), one_in=one_in, whole_window=window if any_window else None).where("n_hit > 0")
    found = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("spans").alias("_spans"), F.col("contaminated").alias("_bad")).distinct()
    joined = documents.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), "left")
    if remove in ("documents", "both"):
        joined = joined.where(~F.coalesce("_bad", F.lit(False)))
    if remove in ("spans", "both"):
        empty = F.array().cast("array<struct<at:int,len:int>>")
        joined = joined.withColumn("text", without_spans(F.col("text"), F.coalesce("_spans", empty)))
    return joined.select(documents.columns)
