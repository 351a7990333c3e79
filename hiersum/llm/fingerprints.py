"""Document fingerprints: a homomorphic multiset hash of paragraphs, in DataFrame operations only.

A paragraph (a run between line breaks) is hashed to a wide vector, and a
text's fingerprint is the sum of its paragraphs' vectors, lane by lane modulo
2**32.  The order of paragraphs is lost and nothing else: a paragraph is
inserted or deleted by adding or subtracting its vector, and the fingerprint of
two texts one after the other is the sum of theirs.

The vector has two parts.  ``IDENTITY`` lanes come from a hash of the whole
paragraph: two multisets of paragraphs agree there, up to chance, only if they
are the same.  ``CONTENT`` lanes count the words of the paragraph, each hashed
with the word before it, whose bit for the lane is set; a last lane counts the
words.  Twice such a count minus the number of words is a sum of random signs,
so the mean product of two fingerprints' lanes estimates the inner product of
their word pairs, and its cosine the likeness of the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import bind, checkpoint

#: Lanes that tell multisets of paragraphs apart, and lanes that show how near two are (the bits of a hash).
IDENTITY, CONTENT = 16, 64
SIZE = IDENTITY + CONTENT + 1
MODULUS = 1 << 32
#: Words whose bits are counted at once, eight counters of a byte in a long, which stays positive.
CHUNK, BYTES = 127, 0x0101010101010101
BREAKS, SPACES = r"[\n\x0B\f\r\x{85}\x{2028}\x{2029}]+", r"[\x20\x09-\x0D]+"
KEY = ("doc_id", "h1", "h2")


def _long(v: int) -> Column:
    return F.lit(v).cast("bigint")


def _wrap(v: Column) -> Column:
    """Modulo 2**32."""
    return v.bitwiseAND(_long(MODULUS - 1))


def _each(n: int, lane) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lane)


def _paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, BREAKS, -1), lambda p: p != "")


def _pairs(paragraph: Column) -> Column:
    """A hash for each word of a paragraph, with the word before it."""
    words = F.filter(F.split(paragraph, SPACES, -1), lambda w: w != "")
    return bind(words, lambda w: F.transform(w, lambda x, i: F.xxhash64(F.get(w, i - 1), x)))


def _identity(paragraphs: Column) -> Column:
    lane = lambda d, k: F.aggregate(d, _long(0), lambda s, x: _wrap(s + _wrap(F.xxhash64(k, x))))
    return bind(F.transform(paragraphs, lambda p: F.sha2(p, 256)), lambda d: _each(IDENTITY, lambda k: lane(d, k)))


def _content(hashes: Column) -> Column:
    """How many hashes have each bit, and how many there are."""
    bits = lambda part: F.array(*(F.aggregate(part, _long(0), lambda s, h: s + F.shiftright(h, k).bitwiseAND(_long(BYTES))) for k in range(8)))
    chunks = lambda u: F.transform(F.sequence(F.lit(0), F.floor(F.size(u) / CHUNK).cast("int")), lambda c: bind(F.slice(u, c * CHUNK + 1, F.lit(CHUNK)), bits))
    byte = lambda part, i: F.call_function("shiftright", F.get(part, i % 8), i - i % 8).bitwiseAND(_long(255))
    counted = lambda parts: _each(CONTENT, lambda i: _wrap(F.aggregate(parts, _long(0), lambda s, part: s + byte(part, i))))
    return bind(hashes, lambda u: F.concat(bind(chunks(u), counted), F.array(_wrap(F.size(u).cast("bigint")))))


def fingerprint(text: Column) -> Column:
    """array<bigint> of ``SIZE`` lanes: the sum over the paragraphs of a text.  Null is empty, and of no paragraph all lanes are zero."""
    return bind(_paragraphs(F.coalesce(text, F.lit(""))), lambda p: F.concat(_identity(p), _content(F.flatten(F.transform(p, _pairs)))))


def insert(v: Column, text: Column) -> Column:
    """The fingerprint ``v`` after the paragraphs of ``text`` came in, wherever."""
    return F.zip_with(v, fingerprint(text), lambda x, y: _wrap(x + y))


def delete(v: Column, text: Column) -> Column:
    """The fingerprint ``v`` after the paragraphs of ``text`` went."""
    return F.zip_with(v, fingerprint(text), lambda x, y: _wrap(x - y))


def _signed(v: Column) -> Column:
    """The content lanes as sums of signs, array<double>: twice the count minus the number of words."""
    n, half = F.get(v, F.lit(SIZE - 1)), MODULUS // 2
    return F.transform(F.slice(v, IDENTITY + 1, CONTENT), lambda c: (_wrap(2 * c - n + half) - half).cast("double"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def likeness(v: Column, w: Column) -> Column:
    """0 to 1: the estimated cosine between two fingerprints' word pairs; 1 for equal ones, 0 if one has no words."""

    def measured(s: Column) -> Column:
        scale = F.sqrt(_dot(s["a"], s["a"]) * _dot(s["b"], s["b"]))
        return bind(scale, lambda m: F.when(m > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), _dot(s["a"], s["b"]) / m))).otherwise(F.lit(0.0)))

    both = bind(F.struct(v.alias("v"), w.alias("w")), lambda x: F.struct(_signed(x["v"]).alias("a"), _signed(x["w"]).alias("b")))
    return F.when(v == w, F.lit(1.0)).otherwise(bind(both, measured))


def encoded(v: Column) -> Column:
    """Lanes as lowercase hex, eight digits each."""
    return F.array_join(F.transform(v, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def decoded(s: Column) -> Column:
    """The lanes of an encoded fingerprint."""
    return _each(SIZE, lambda i: F.conv(F.substring(s, i * 8 + 1, F.lit(8)), 16, 10).cast("bigint"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, h1, h2, text (null: empty).  Two hashes stand for the text wherever only its identity matters."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    return slim.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")


def successors(keys: DataFrame) -> DataFrame:
    """Rows of distinct ``KEY`` and n_chars with the key of the next document (``to_``), by descending doc_id and in a circle.

    Rows are dealt to ranges; the first key of each range (one row) goes to
    the driver and comes back as the end of the range before.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("h1"), F.col("h2")]
    ranged = checkpoint(keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    within = Window.partitionBy("part").orderBy(*order)
    linked = ranged.withColumn("to", F.lead(F.struct(*KEY)).over(within)).withColumn("at", F.row_number().over(within))
    linked = checkpoint(linked)
    firsts = sorted((r["part"], *(r[c] for c in KEY)) for r in linked.where("at = 1").select("part", *KEY).collect())
    ends = [(firsts[k - 1][0], tuple(firsts[k][1:])) for k in range(len(firsts))]  # the first range follows the last
    starts = F.broadcast(keys.sparkSession.createDataFrame(ends, "part int, head struct<doc_id:bigint,h1:bigint,h2:bigint>"))
    to = linked.join(starts, "part").withColumn("to", F.coalesce("to", "head"))
    return to.select(*KEY, "n_chars", "n_rows", *(F.col("to")[c].alias(f"to_{c}") for c in KEY))


def _same(left: str, right: str) -> Column:
    return F.col(f"{left}doc_id").eqNullSafe(F.col(f"{right}doc_id")) & (F.col(f"{left}h1") == F.col(f"{right}h1")) & (F.col(f"{left}h2") == F.col(f"{right}h2"))


def edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited, fingerprint, edited_fingerprint, next_fingerprint: one row per row of ``docs``.

    ``edited`` is the text whose last half (rounded down) gave way to as many
    code points of the next document's start, or all it has.  Next is by
    descending doc_id, texts of one doc_id by their hashes and null ids last,
    and the first document follows the last.  A null text is empty.  Rows that
    agree in doc_id and text are one document and repeat its result; a single
    document follows itself.  Other columns are ignored.  An empty table gives
    an empty result.

    Only keys are sorted.  A text is dealt by its key once, with its
    fingerprint, and half of it goes on to the document before.
    """
    own = keyed(docs)
    links = checkpoint(successors(checkpoint(own.groupBy(*KEY, F.char_length("text").alias("n_chars")).agg(F.count(F.lit(1)).alias("n_rows")))))
    told = own.withColumn("fingerprint", fingerprint(F.col("text")))  # both joins read the same columns of it, so it is dealt once
    wanted = links.select(*(F.col(c).alias(f"by_{c}") for c in KEY), F.floor(F.col("n_chars") / 2).cast("int").alias("half"), *(f"to_{c}" for c in KEY))
    given = told.join(wanted, _same("", "to_")).select(*(f"by_{c}" for c in KEY), F.substring(F.col("text"), F.lit(1), F.col("half")).alias("start"), F.col("fingerprint").alias("next_fingerprint"))
    if not links.where("n_rows > 1").isEmpty():  # a repeated document would be given by each of its rows
        given = given.groupBy(*(f"by_{c}" for c in KEY)).agg(F.first("start").alias("start"), F.first("next_fingerprint").alias("next_fingerprint"))
    both = told.join(given, _same("", "by_"))
    n_chars = F.char_length("text")
    kept = F.substring(F.col("text"), F.lit(1), n_chars - F.floor(n_chars / 2).cast("int"))
    changed = both.select("doc_id", n_chars.cast("bigint").alias("n_chars"), F.concat(kept, F.col("start")).alias("edited"), "fingerprint", "next_fingerprint")
    return changed.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
