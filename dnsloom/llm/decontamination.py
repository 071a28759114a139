"""Benchmark decontamination by a prefix-filtered set join of word shingles, in SQL functions only.

A window is ten consecutive words of a benchmark item (all of them, if it has fewer), and the set
of its shingles, runs of three words. A document holds the window only if it holds all of them, so
for containment the necessary prefix of a window, in order of rarity, is its rarest shingle:

1. the occurrences of each benchmark shingle are counted over all documents;
2. each window keeps its rarest shingle and where it stands; one that never occurs ends it;
3. the documents' shingles are joined with these prefix shingles alone;
4. where the window would stand follows from the place of the shingle: it must lie inside the
   document (length and position bounds);
5. the words of the stretch, as long as the window, are compared with those of the window.

The words of a document are matched once and stored, joined by spaces, for the passes over them.
Benchmark tables are broadcast in blocks of a checked size, the documents are never shuffled by
shingle, and a document's words travel in stretches of a few dozen. What is shuffled are the
windows found, by document.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dnsloom.operators.staging import stage

# Fixed by the definition of a word: A-Z are lower-cased first.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A row of a broadcast table besides its texts, with what a hash table adds.
_ROW_BYTES = 150


@dataclass(frozen=True)
class ContaminationSettings:
    """window_words: words of a window. shingle_words: words of a shingle.
    stretch: windows that a stretch of a document's words has room for.
    block_bytes: most bytes of a benchmark table that are broadcast at once."""

    window_words: int = 10
    shingle_words: int = 3
    stretch: int = 24
    block_bytes: int = 64 << 20


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.regexp_extract_all(F.coalesce(lowered, F.lit("")), F.lit(WORD), F.lit(0))


def _stored_words(docs: DataFrame, doc_col: str, text_col: str) -> DataFrame:
    """doc_col, key, key2, n_words, joined: a document's words once, with a space between them
    (no word has one)."""
    text = F.col(text_col)
    matched = docs.select(
        F.col(doc_col),
        F.xxhash64(F.col(doc_col), text).alias("key"),
        F.xxhash64(F.lit(1), F.col(doc_col), text).alias("key2"),
        words_of(text).alias("words"),
    )
    counted = F.size("words").cast("long").alias("n_words")
    return stage(
        matched.select(doc_col, "key", "key2", counted, F.array_join("words", " ").alias("joined")), "document-words"
    ).df


def _words_again() -> Column:
    """The words of a row of `_stored_words`."""
    return F.when(F.col("n_words") > 0, F.split("joined", " ")).otherwise(F.array().cast("array<string>"))


def windows_of(items: DataFrame, s: ContaminationSettings, item_col: str, text_col: str) -> DataFrame:
    """Distinct windows: passage, words, size, and the items (as texts, sorted) that have it.

    Rows with the same id are one item; a null id is listed as an empty text.
    """
    named = items.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
        words_of(F.col(text_col)).alias("all_words"),
    ).where(F.size("all_words") > 0)
    last = F.greatest(F.size("all_words") - s.window_words + 1, F.lit(1))
    starts = named.select("item", "all_words", F.explode(F.sequence(F.lit(1), last)).alias("at"))
    cut = starts.select("item", F.slice("all_words", F.col("at"), F.lit(s.window_words)).alias("words"))
    return cut.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items")).select(
        F.array_join("words", " ").alias("passage"),
        "words",
        F.size("words").alias("size"),
        "items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("item_set"),
    )


def _shingle(words: list[Column]) -> Column:
    """The key of a shingle; places beyond the end are null and do not count."""
    return F.xxhash64(*words)


def shingles_of(windows: DataFrame, s: ContaminationSettings) -> DataFrame:
    """(passage, offset, shingle) of every window; one of fewer words is its own shingle."""
    last = F.greatest(F.col("size") - s.shingle_words, F.lit(0))
    placed = windows.select("passage", "words", F.explode(F.sequence(F.lit(0), last)).alias("offset"))
    parts = [F.get("words", F.col("offset") + i) for i in range(s.shingle_words)]
    return placed.select("passage", "offset", _shingle(parts).alias("shingle"))


def _placed_shingles(rows: DataFrame, sizes: list[int], s: ContaminationSettings, most: Column) -> DataFrame:
    """The shingles that begin at the first `most` words of column `words`, at `at` from 0."""
    shifted = [F.slice("words", F.lit(1), most)] + [
        F.slice("words", F.lit(i + 1), most) for i in range(1, s.shingle_words)
    ]
    zipped = F.arrays_zip(*[c.alias(f"w{i}") for i, c in enumerate(shifted)])
    others = [c for c in rows.columns if c != "words"]
    placed = rows.select(*others, F.posexplode(zipped).alias("at", "w"))
    words = [F.col(f"w.w{i}") for i in range(s.shingle_words)]
    keys = [_shingle(words[:n]) for n in sizes]
    key = keys[0] if len(keys) == 1 else F.explode(F.array(*keys))
    return placed.select(*others, "at", key.alias("shingle"))


def _in_blocks(table: DataFrame, key: str, text: Column | None, most: int) -> list[DataFrame]:
    """`table` in blocks of about `most` bytes at most, dealt by a hash of `key`."""
    width = F.lit(_ROW_BYTES) if text is None else F.octet_length(text) + _ROW_BYTES
    blocks = 1 + (table.agg(F.sum(width.cast("long")).alias("n")).head()["n"] or 0) // most
    if blocks == 1:
        return [table]
    part = F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(blocks))
    return [table.where(part == i) for i in range(blocks)]


def rarities(words: DataFrame, shingles: DataFrame, sizes: list[int], s: ContaminationSettings) -> DataFrame:
    """(shingle, times): occurrences in all documents' `words` of the shingles that occur at all."""
    placed = _placed_shingles(words, sizes, s, F.size("words"))
    wanted = stage(shingles.select("shingle").distinct(), "benchmark-shingles").df
    counts = [
        placed.join(F.broadcast(block), "shingle", "left_semi").groupBy("shingle").agg(F.count(F.lit(1)).alias("times"))
        for block in _in_blocks(wanted, "shingle", None, s.block_bytes)
    ]
    return reduce(DataFrame.unionAll, counts)


def prefixes(windows: DataFrame, shingles: DataFrame, counts: DataFrame) -> DataFrame:
    """Each window with its rarest shingle; windows with a shingle that never occurs are left out."""
    rated = shingles.join(counts, "shingle", "left").groupBy("passage").agg(
        F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "shingle", "offset")).alias("rarest")
    )
    found = rated.where("rarest.times > 0").join(windows, "passage")
    return found.select("rarest.shingle", "rarest.offset", "passage", "size", "item_set")


def _occurrences(rows: DataFrame, prefix: DataFrame, sizes: list[int], s: ContaminationSettings) -> DataFrame:
    """(key, key2, begin, end, item_set) of all windows found in the rows' `words`."""
    n = F.size("words")
    reach = s.stretch + s.window_words - 1
    # A stretch begins so far before the shingles it is asked for as a window may begin before them.
    back = s.window_words - 1
    starts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(s.stretch))).otherwise(F.array().cast("array<int>"))
    cut = rows.select("key", "key2", "words", n.alias("n_words"), F.explode(starts).alias("start"))
    first = F.greatest(F.col("start") - back, F.lit(1))
    stretches = cut.select(
        "key",
        "key2",
        "n_words",
        "start",
        first.alias("first"),
        F.slice("words", F.col("start"), F.lit(s.stretch + s.shingle_words - 1)).alias("words"),
        F.array_join(F.slice("words", first, F.col("start") - first + reach), " ").alias("passages"),
    )
    placed = _placed_shingles(stretches, sizes, s, F.lit(s.stretch))
    begin = F.col("start") + F.col("at") - F.col("offset")
    found = []
    for block in _in_blocks(prefix, "shingle", F.col("passage"), s.block_bytes):
        joined = placed.join(F.broadcast(block), "shingle").select(
            "*", begin.alias("begin"), (begin + F.col("size") - 1).alias("end")
        )
        inside = joined.where((F.col("begin") >= 1) & (F.col("end") <= F.col("n_words")))
        here = F.slice(F.split("passages", " "), F.col("begin") - F.col("first") + 1, F.col("size"))
        same = inside.where(F.array_join(here, " ") == F.col("passage"))
        found.append(same.select("key", "key2", "begin", "end", "item_set"))
    return reduce(DataFrame.unionAll, found)


def contamination(
    docs: DataFrame,
    items: DataFrame,
    settings: ContaminationSettings | None = None,
    doc_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Per document: doc_col, n_words, n_hit, n_items, items (texts, sorted), contaminated.

    n_hit: words that lie inside an occurrence of a window. One row per row of `docs`; a null or
    empty text has no words, a null id is kept, repeated rows have equal results, an empty
    benchmark leaves all clean. Other columns of either table are not looked at.
    """
    s = settings or ContaminationSettings()
    windows = stage(windows_of(items, s, item_col, item_text_col), "windows").df
    shingles = stage(shingles_of(windows, s), "shingles").df
    smallest = F.least("size", F.lit(s.shingle_words)).alias("n")
    sizes = sorted(r["n"] for r in windows.select(smallest).distinct().collect()) or [s.shingle_words]

    named = _stored_words(docs, doc_col, text_col)
    counts = rarities(named.select(_words_again().alias("words")), shingles, sizes, s)
    prefix = stage(prefixes(windows, shingles, counts), "prefixes").df
    rows = named.select("key", "key2", _words_again().alias("words"))
    # Repeated rows repeat their windows: the same stretch again adds no word and no item.
    before = Window.partitionBy("key", "key2").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("end").over(before), F.lit(0))
    fresh = F.greatest(F.col("end") - F.greatest(reached, F.col("begin") - 1), F.lit(0))
    found = _occurrences(rows, prefix, sizes, s).select("key", "key2", "item_set", fresh.alias("fresh"))
    hit = found.groupBy("key", "key2").agg(
        F.sum("fresh").alias("n_hit"), F.collect_set("item_set").alias("item_sets")
    )
    hit = stage(hit, "contaminated").df
    sets = windows.groupBy("item_set").agg(F.first("items").alias("items"))
    listed = (
        hit.select("key", "key2", F.explode("item_sets").alias("item_set"))
        .join(sets, "item_set")
        .groupBy("key", "key2")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    )
    whole = hit.select("key", "key2", "n_hit").join(listed, ["key", "key2"])
    sized = named.select(doc_col, "key", "key2", "n_words")
    items_found = F.coalesce("items", F.array().cast("array<string>"))
    return sized.join(whole, ["key", "key2"], "left").select(
        doc_col,
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items_found).cast("long").alias("n_items"),
        items_found.alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
