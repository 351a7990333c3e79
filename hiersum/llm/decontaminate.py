"""Benchmark decontamination by winnowing, in DataFrame operations only.

A window is 10 consecutive words of an item.  Texts are reduced to
fingerprints: hash every 5-gram, and of every 6 consecutive hashes keep the
smallest.  Any 10 words that two texts share contain the same 6 hashes, so
both keep the same minimum there: the join of fingerprints misses no shared
window.  A hit is then extended to the windows that cover it, and those are
compared word by word with the items' windows, so no wrong hit stays.  An item
of fewer words is one short window; for each such length that occurs, every
n-gram of that length is a fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, bind, checkpoint

WINDOW, GRAM = 10, 5
SPAN = WINDOW - GRAM + 1  # hashes that a window holds
#: Words are what is left without \x00-\x2F, \x3A-\x60 and \x7B-\x7F; named by what they hold, which matches faster.
WORD = r"[a-z0-9\x{80}-\x{10FFFF}]++"
#: The same words before A-Z are lower-cased.
WORD_ANY_CASE = r"[a-zA-Z0-9\x{80}-\x{10FFFF}]++"
#: The items' fingerprints and windows are broadcast up to this many rows, and joined by a shuffle beyond.
BROADCAST_ROWS = 500_000
POSITION_BITS = 31


def words_of(text: Column) -> Column:
    """Words of a text; null and empty texts have none."""
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _grams(hashes: Column, n: int, length: int) -> Column:
    """A long for each n-gram: 32 bits of its hash, then its position.  ``length`` sets kinds of fingerprints apart."""
    at = F.sequence(F.lit(0), F.size(hashes) - n)
    packed = lambda i: F.shiftleft(F.xxhash64(F.lit(length), *(F.get(hashes, i + k) for k in range(n))).bitwiseAND(F.lit(0xFFFFFFFF)), POSITION_BITS).bitwiseOR(i.cast("bigint"))
    return F.when(F.size(hashes) >= n, F.transform(at, packed)).otherwise(F.array().cast("array<bigint>"))


def _short_gram(words: Column, n: int) -> Column:
    """The n-gram of an item of n words."""
    return bind(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _grams(h, n, n))


def fingerprints(words: Column, short: list[int]) -> Column:
    """array<bigint>: what winnowing keeps of a text, each with its position.

    Packing the position below the hash makes the minimum of 6 longs the
    leftmost smallest hash.  ``short`` lists the lengths of short items.
    """

    def kept(hashes: Column) -> Column:
        def winnow(grams: Column) -> Column:
            at = F.sequence(F.lit(0), F.size(grams) - SPAN)
            return F.when(F.size(grams) >= SPAN, F.array_distinct(F.transform(at, lambda i: F.least(*(F.get(grams, i + k) for k in range(SPAN)))))).otherwise(F.array().cast("array<bigint>"))

        parts = [bind(_grams(hashes, GRAM, WINDOW), winnow), *(_grams(hashes, n, n) for n in short)]
        return F.concat(*parts) if len(parts) > 1 else parts[0]

    return bind(F.transform(words, lambda w: F.xxhash64(w)), kept)


def _hash(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, POSITION_BITS)


def _sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint, if the checked size allows it."""
    return F.broadcast(df) if df.count() <= most else df


def _windows(words: Column) -> Column:
    """The distinct windows of an item, each as its words joined by spaces."""
    whole = lambda i: F.array_join(F.slice(words, i + 1, F.lit(WINDOW)), " ")
    return F.when(F.size(words) >= WINDOW, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), whole))).when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))


def find(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, item_ids, contaminated: one row per doc_id and distinct text.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are
    ignored.  Null, empty and wordless texts have no words and no windows;
    item_ids are strings in string order (a null item_id is left out).  A
    repeated row gives one result; a doc_id with several texts gives one row
    for each.  Empty tables give an empty result, or no hits.
    """
    item = checkpoint(items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words")).where("size(words) > 0"))
    short = sorted(r[0] for r in item.select(F.size("words").alias("n")).where(F.col("n") < WINDOW).distinct().collect())  # 9 values at most
    length = F.least(F.size("words"), F.lit(WINDOW))
    # The fingerprints of an item: windows of 10 winnow, a short item gives its one n-gram.
    own = F.when(F.size("words") >= WINDOW, fingerprints(F.col("words"), []))
    for n in short:
        own = F.when(F.size("words") == n, _short_gram(F.col("words"), n)).otherwise(own)
    item_prints = _sized(checkpoint(item.select(F.explode(own).alias("p"), length.alias("length")).select(_hash(F.col("p")).alias("h"), "length").distinct()))
    held = checkpoint(item.select("item_id", F.explode(_windows(F.col("words"))).alias("window")).distinct())
    windows = _sized(checkpoint(held.select("window").distinct()))

    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = base.select("doc_id", F.explode(fingerprints(words_of(F.col("text")), short)).alias("p"))
    hits = prints.select("doc_id", _hash(F.col("p")).alias("h"), F.col("p").bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int").alias("at")).join(item_prints, "h")
    anchors = checkpoint(hits.groupBy(F.col("doc_id").alias("hit_id")).agg(F.collect_set(F.struct("length", "at")).alias("anchors")))
    if (anchors.agg(F.sum(F.size("anchors") + 4)).first()[0] or 0) <= BROADCAST_ROWS:
        anchors = F.broadcast(anchors)  # then no text is shuffled

    # Extension: the windows that cover an anchor, then the comparison of words.
    def covering(words: Column, anchors: Column) -> Column:
        starts = F.flatten(F.transform(anchors, lambda a: F.when(a["length"] == WINDOW, F.transform(F.sequence(a["at"] - (SPAN - 1), a["at"]), lambda s: F.struct(s.alias("s"), a["length"].alias("n")))).otherwise(F.array(F.struct(a["at"].alias("s"), a["length"].alias("n"))))))
        inside = F.filter(F.array_distinct(starts), lambda x: (x["s"] >= 0) & (x["s"] + x["n"] <= F.size(words)))
        return F.transform(inside, lambda x: F.struct(x["s"].alias("s"), x["n"].alias("n"), F.array_join(F.slice(words, x["s"] + 1, x["n"]), " ").alias("window")))

    hashed = base.withColumn("text_hash", F.xxhash64("text"))
    anchored = hashed.join(anchors, F.col("doc_id").eqNullSafe(F.col("hit_id")))
    candidates = anchored.select("doc_id", "text_hash", bind(words_of(F.col("text")), lambda words: covering(words, F.col("anchors"))).alias("c"))
    # What was found is little; items are looked up for it, one row for each window of a document and item that holds it.
    found = checkpoint(candidates.select("doc_id", "text_hash", F.inline("c")).join(windows, "window", "left_semi"))
    key = ["doc_id", "text_hash"]
    hit = found.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("s", "n"))).alias("found"))
    ids = found.select(*key, "window").distinct().join(_sized(held), "window").where("item_id IS NOT NULL").select(*key, "item_id").distinct().groupBy(*key).agg(F.array_sort(F.collect_list("item_id")).alias("ids"))
    hits = hit.join(ids, hit["doc_id"].eqNullSafe(ids["doc_id"]) & hit["text_hash"].eqNullSafe(ids["text_hash"]), "left").select(hit["doc_id"].alias("hit_id"), hit["text_hash"].alias("hit_hash"), "found", "ids")
    n_words = F.coalesce(F.regexp_count("text", F.lit(WORD_ANY_CASE)), F.lit(0)).cast("bigint")
    everyone = hashed.select("doc_id", "text_hash", n_words.alias("n_words")).distinct()
    rows = everyone.join(checkpoint(hits), F.col("doc_id").eqNullSafe(F.col("hit_id")) & F.col("text_hash").eqNullSafe(F.col("hit_hash")), "left")
    none = F.array().cast("array<string>")
    n_hit = F.when(F.col("found").isNotNull(), _covered(F.col("found"))).otherwise(F.lit(0).cast("bigint"))
    rows = rows.select("doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.coalesce("ids", none).alias("item_ids"))
    return rows.select("doc_id", "text_hash", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), "item_ids", (F.col("n_hit") > 0).alias("contaminated"))


def _covered(spans: Column) -> Column:
    """Positions covered by spans (s, n) that are sorted by s."""
    start = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n"))

    def step(acc: Column, x: Column) -> Column:
        end = (x["s"] + x["n"]).cast("bigint")
        fresh = F.greatest(end - F.greatest(acc["end"], x["s"].cast("bigint")), F.lit(0).cast("bigint"))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + fresh).alias("n"))

    return F.aggregate(spans, start, step, lambda acc: acc["n"])
