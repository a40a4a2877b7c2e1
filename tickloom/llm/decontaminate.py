r"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is ``width`` consecutive words of an item (all words of a shorter
one). A document contains a window only if it contains every shingle of it,
so one shingle is a necessary prefix; the rarest in the documents joins the
fewest rows. Shingles are therefore counted, each window keeps its rarest one
and its offset, document shingles join it, the offset gives the one place
where the window may start (positional bound), words on both sides must
suffice (length bound), and the words there are compared with the window's.

Only built-in functions are used. Long texts are cut into overlapping chunks
of positions, so that no row carries a whole text through the explosion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.scratch import Scratch, ascii_lower, row_key, same_row

WIDTH, SHINGLE, STEP = 13, 3, 64
#: Item windows are broadcast up to this many (some 200 bytes each); beyond it the join shuffles.
BROADCAST_WINDOWS = 100_000
#: What stands between words, after folding.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN, -1), "")


def _shingle(array: Column, at: Column, size: int) -> Column:
    """Hash of ``size`` words from ``at`` (0-based); null words do not occur inside the bounds that callers check."""
    return F.xxhash64(*[F.get(array, at + i) for i in range(size)], F.lit(size))


def _pieces(docs: DataFrame, width: int) -> DataFrame:
    """Each text's words in chunks of STEP starts, every chunk with the words that windows from there reach into."""
    base = docs.select("doc_id", row_key(F.col("text")).alias("row_key"), words(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.size("words") - 1, F.lit(STEP))
    cut = F.transform(starts, lambda s: F.struct(s.alias("first"), F.slice(F.col("words"), s + 1, STEP + width - 1).alias("chunk")))
    return base.select("doc_id", "row_key", F.inline(cut))


def _shingles(pieces: DataFrame, sizes: list[int], starts_only: bool) -> DataFrame:
    """One row per position of a chunk and shingle size, with the chunk; ``starts_only`` leaves the overlap out."""
    last = F.size("chunk") - 1
    at = F.explode(F.sequence(F.lit(0), F.least(last, F.lit(STEP - 1)) if starts_only else last)).alias("at")
    placed = pieces.select("doc_id", "row_key", "first", "chunk", at)
    each = [placed.where(F.col("at") + size <= F.size("chunk")).withColumn("shingle", _shingle(F.col("chunk"), F.col("at"), size)) for size in sizes]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out


def item_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """item_id, window (array of words): all distinct windows of every item; items without words have none."""
    base = benchmark.select("item_id", words(F.col("text")).alias("words")).where("item_id IS NOT NULL AND size(words) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - width, F.lit(0)))
    return base.select("item_id", F.explode(F.transform(starts, lambda s: F.slice(F.col("words"), s + 1, width))).alias("window")).distinct()


def find(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, shingle: int = SHINGLE, scratch: Scratch | None = None) -> DataFrame:
    """Every occurrence of an item window: doc_id, row_key, start (0-based word), length, item_id."""
    scratch = scratch or Scratch(docs.sparkSession, "decontaminate")
    windows = scratch.keep(item_windows(benchmark, width), "windows")
    bound = windows.agg(F.count("*"), F.collect_set(F.least(F.size("window"), F.lit(shingle)))).first()  # at most ``shingle`` sizes
    sizes, small = sorted(bound[1]) or [shingle], bound[0] <= BROADCAST_WINDOWS

    def sized(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    size = F.least(F.size("window"), F.lit(shingle))

    def all_shingles(s: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size("window") - s), lambda at: _shingle(F.col("window"), at, s))

    hashed = F.lit(None).cast("array<bigint>")
    for s in sizes:
        hashed = F.when(size == s, all_shingles(s)).otherwise(hashed)
    parts = windows.select("item_id", "window", F.posexplode(hashed).alias("offset", "shingle"))
    # rarity in the documents; only shingles that items have are counted
    pieces = _pieces(docs, width)
    vocabulary = parts.select("shingle").distinct()
    rarity = scratch.keep(
        _shingles(pieces, sizes, starts_only=True).select("shingle").join(sized(vocabulary), "shingle").groupBy("shingle").agg(F.count("*").alias("n")), "rarity"
    )
    # a window with a shingle that no document has cannot occur
    ranked = parts.join(rarity, "shingle", "left").groupBy("window", "item_id").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")).alias("rarest")
    ).where("rarest.n > 0").select("item_id", "window", "rarest.shingle", "rarest.offset")
    prefixes = scratch.keep(ranked, "prefixes")
    start = F.col("at") - F.col("offset")
    return (
        _shingles(pieces, sizes, starts_only=False).join(sized(prefixes), "shingle")
        .where((start >= 0) & (start < STEP) & (start + F.size("window") <= F.size("chunk")))
        .where(F.slice(F.col("chunk"), start + 1, F.size("window")) == F.col("window"))
        .select("doc_id", "row_key", (F.col("first") + start).alias("start"), F.size("window").alias("length"), "item_id")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, shingle: int = SHINGLE) -> DataFrame:
    """Contamination of every row of ``docs`` (doc_id, text) by ``benchmark`` (item_id, text).

    Returns doc_id, row_key, n_words, n_hit, n_items, items (ids as strings,
    sorted) and contaminated (n_hit > 0 and 20 * n_hit >= n_words).

    Null and empty texts have no words and are not contaminated. Items without
    words, or with a null id, have no windows. Repeated rows give repeated
    results; repeated items count once. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    hits = scratch.keep(find(docs, benchmark, width, shingle, scratch).distinct(), "hits")
    covered = (
        hits.select("doc_id", "row_key", F.explode(F.expr("sequence(start, start + length - 1)")).alias("word")).distinct()
        .groupBy("doc_id", "row_key").agg(F.count("*").alias("n_hit"))
    )
    items = (
        hits.select("doc_id", "row_key", F.col("item_id").cast("string").alias("item_id")).distinct()
        .groupBy("doc_id", "row_key").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    )
    judged = same_row(covered, items, "inner")
    texts = docs.select("doc_id", row_key(F.col("text")).alias("row_key"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return same_row(texts, judged).select(
        "doc_id", "row_key", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``docs`` without the contaminated rows; all columns stay."""
    bad = decontaminate(docs, benchmark, **how).where("contaminated").select(F.col("doc_id").alias("_doc_id"), F.col("row_key").alias("_row_key")).distinct()
    on = docs["doc_id"].eqNullSafe(bad["_doc_id"]) & (row_key(docs["text"]) == bad["_row_key"])
    return docs.join(bad, on, "left_anti")
