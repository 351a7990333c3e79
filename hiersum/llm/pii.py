"""Personal data: base patterns and information-theoretic sanitisation, in DataFrame operations only.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers.
A pattern's matches and the gaps between them, from one ``split`` and one
``regexp_extract_all``, give every position by running sums, so a text is
scanned in time linear in its length and nothing leaves the row.

The method asks which other words give a protected entity away.  Over the
whole corpus it counts, in documents, how often a term stands in one text with
an entity and how often it occurs at all.  Given the term, the entity is uncertain by
-log2 p(entity | term) bits; where that is at most ``MAX_BITS`` and the pair
was seen in ``SUPPORT`` documents, the term discloses the entity.  In every
document that holds the term, with the entity or without, it is generalised to
a placeholder, or removed where hardly any uncertainty is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import bind, checkpoint, small, unused

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Bits of uncertainty about an entity that a term must leave, and at or below which it is removed.
MAX_BITS, REMOVE_BITS = 0.5, 0.1
#: Documents that must show a term and an entity.
SUPPORT = 5
#: Entities or terms that are broadcast, at most.
BROADCAST = 500_000

# A run is tried from its start only, or from where the last match ended: any
# other start in it would meet the same next character.  Possessive loops cannot
# backtrack into what the next part can never match.  Both keep long runs linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Words of letters that are no part of an address.
TERM_PATTERN = r"(?<![A-Za-z0-9._%+@\x80-\x{10FFFF}-])[A-Za-z\x{80}-\x{10FFFF}]{3,}+(?![0-9@_%+-]|\.[A-Za-z0-9._%+@-])"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"


def _has(kind: str, text: Column) -> Column:
    """A cheap necessary condition."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    return F.rlike(text, F.lit(r"[0-9]\.[0-9]" if kind == "ip" else r"[0-9][\x20-]?[0-9]"))


def _luhn(digits: Column) -> Column:
    """Check sum of a digit string of at most 19."""
    reverse = F.transform(F.split(F.reverse(digits), ""), lambda d: F.ascii(d) - 48)
    weighed = F.transform(reverse, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(weighed, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.rlike(match, F.lit(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "card":
        return F.when(F.char_length(digits).between(12, 19), bind(digits, _luhn)).otherwise(False)
    return F.char_length(digits).between(9, 15)


def running_sums(lengths: Column) -> Column:
    """Sums of the elements before each one: blocks of about the root of their number, then within a block."""
    size = F.greatest(F.ceil(F.sqrt(F.size(lengths))), F.lit(1)).cast("int")
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, v: s + v)

    def sums(x: Column) -> Column:
        blocks = F.when(F.size(x["v"]) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(x["v"]) - 1) / x["b"]).cast("int")), lambda k: total(F.slice(x["v"], k * x["b"] + 1, x["b"])))).otherwise(F.array().cast("array<bigint>"))

        def inner(y: Column) -> Column:
            starts = F.transform(y, lambda _, k: total(F.slice(y, F.lit(1), k)))
            return bind(starts, lambda s: F.transform(x["v"], lambda _, i: F.get(s, F.floor(i / x["b"]).cast("int")) + total(F.slice(x["v"], F.floor(i / x["b"]).cast("int") * x["b"] + 1, i % x["b"]))))

        return bind(blocks, inner)

    return bind(F.struct(lengths.alias("v"), size.alias("b")), sums)


SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint,value:string,left:string,right:string>>"


def _located(text: Column, pattern: str, rank: int, kind: str, valid, present: Column, near: int = 0) -> Column:
    """Spans of a pattern's valid matches, with some text around each."""

    def build(x: Column) -> Column:
        gaps, matches = x["gaps"], x["matches"]
        steps = F.transform(matches, lambda m, i: (F.char_length(F.get(gaps, i)) + F.char_length(m)).cast("bigint"))

        def span(before: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                start = F.get(before, i) + F.char_length(F.get(gaps, i))
                around = (F.right(F.get(gaps, i), F.lit(near)), F.left(F.get(gaps, i + 1), F.lit(near))) if near else (F.lit(""), F.lit(""))
                return F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (start + F.char_length(m)).alias("end"), m.alias("value"), around[0].alias("left"), around[1].alias("right"))

            return F.filter(F.transform(matches, one), lambda s: valid(s["value"]))

        return bind(running_sums(steps), span)

    cut = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"))
    none = F.array().cast(SPAN)
    return F.when(present, bind(cut, lambda x: F.when(F.size(x["matches"]) > 0, build(x)).otherwise(none))).otherwise(none)


def base_spans(text: Column, near: int = 0) -> Column:
    """The base spans of a text, by kind and start: array of SPAN.  Null: none."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(*(_located(text, PATTERNS[k], i, k, lambda m, k=k: _valid(k, m), _has(k, text), near) for i, k in enumerate(KINDS)))


def terms_of(text: Column) -> Column:
    """The distinct lower-cased terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM_PATTERN), F.lit(0)), lambda w: F.lower(w)))


def _entity(span: Column) -> Column:
    return F.concat(span["kind"], F.lit(":"), F.lower(span["value"]))


def _small(rows: DataFrame) -> DataFrame:
    """Computed once, and broadcast only under a checked count."""
    return small(rows, BROADCAST)


def _signature() -> list[Column]:
    """Aggregates that are equal for things that stand in the same rows: their number and two sums of hashes of doc_id."""
    low = lambda k: F.xxhash64(F.lit(k), "doc_id").bitwiseAND(F.lit((1 << 40) - 1))
    return [F.count(F.lit(1)).alias("n"), F.sum(low(1)).alias("s1"), F.sum(low(2)).alias("s2")]


CLASS = ("n", "s1", "s2")


def disclosing(docs: DataFrame, max_bits: float = MAX_BITS, support: int = SUPPORT) -> DataFrame:
    """entity, term, bits: the pairs above the disclosure threshold, estimated over all of ``docs`` (doc_id, text).

    Entities of the same documents are one class, and so are terms, and only
    classes are paired: a list of addresses that always stands whole counts
    once, whatever its length.  A term of n rows discloses nothing that stands in
    less than n / 2**max_bits documents, so only terms of ``support`` rows, and
    of no more than an entity allows, meet it.
    """
    known = docs.where("doc_id IS NOT NULL")
    entities = F.array_distinct(F.transform(base_spans(F.col("text")), _entity))
    held = checkpoint(known.select("doc_id", F.explode(entities).alias("entity")).distinct())
    shared = checkpoint(held.groupBy("entity").agg(*_signature()).where(F.col("n") >= support))
    most = shared.agg(F.max("n")).first()[0]
    if most is None:
        return docs.sparkSession.createDataFrame([], "entity string, term string, bits double")
    allowed = 2.0**max_bits
    by_term = docs.select("doc_id", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(*_signature())
    by_term = _small(by_term.where(F.col("n").between(support, most * allowed)))
    # texts are read again for documents with such an entity only
    by_doc = held.join(_small(shared), "entity").select(F.col("doc_id").alias("held_id"), F.struct(*CLASS).alias("entity_class")).distinct()
    by_doc = _small(by_doc.groupBy("held_id").agg(F.collect_list("entity_class").alias("entity_classes")))
    terms = known.join(by_doc, F.col("doc_id") == F.col("held_id")).select("doc_id", "entity_classes", F.explode(terms_of(F.col("text"))).alias("term"))
    classes = terms.join(by_term, "term").select("doc_id", "entity_classes", F.struct(*CLASS).alias("term_class")).distinct()
    met = classes.select("term_class", F.explode("entity_classes").alias("entity_class")).where(F.col("term_class.n") <= F.col("entity_class.n") * allowed)
    counted = met.groupBy("term_class", "entity_class").agg(F.count(F.lit(1)).alias("n_both")).where(F.col("n_both") >= support)
    bits = F.log2(F.greatest(F.col("term_class.n"), F.col("n_both")) / F.col("n_both"))
    found = checkpoint(counted.withColumn("bits", bits).where(F.col("bits") <= max_bits).select("term_class", "entity_class", "bits"))
    named = found.join(by_term.select(F.struct(*CLASS).alias("term_class"), "term"), "term_class")
    return named.join(shared.select(F.struct(*CLASS).alias("entity_class"), "entity"), "entity_class").select("entity", "term", "bits")


def _term_spans(text: Column, flagged: Column) -> Column:
    """Spans of the flagged terms (map term -> bits) of a text."""
    return _located(text, TERM_PATTERN, len(KINDS), TERM, lambda m: F.map_contains_key(flagged, F.lower(m)), F.lit(True))


def find(docs: DataFrame, max_bits: float = MAX_BITS, support: int = SUPPORT) -> DataFrame:
    """All columns of ``docs`` and ``base``, ``added`` (arrays of spans) and ``flagged`` (map term -> bits).

    Needs doc_id and text.  Columns of ``docs`` with one of those three names give way to the results.  Null and empty texts have no spans.  Rows that
    share a doc_id count as one document when terms are counted with an entity
    and share what is flagged; each keeps a row of its own.  A null doc_id has
    its base spans but takes no part in the counting.  An empty table gives an
    empty result.
    """
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    terms = _small(disclosing(slim, max_bits, support).groupBy("term").agg(F.min("bits").alias("bits")))
    held = slim.where("doc_id IS NOT NULL").select("doc_id", F.explode(terms_of(F.col("text"))).alias("term"))
    flagged = held.join(terms, "term").groupBy("doc_id", "term").agg(F.min("bits").alias("bits"))
    own, key = docs.drop("base", "added", "flagged"), unused(docs, "flag_id")
    flagged = checkpoint(flagged)
    few = flagged.count() <= BROADCAST  # then no text is shuffled
    by_doc = flagged.groupBy(F.col("doc_id").alias(key)).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("term", "bits")))).alias("flagged"))
    based = own.withColumn("base", base_spans(F.col("text").cast("string")))
    joined = based.join(F.broadcast(by_doc) if few else by_doc, F.col("doc_id").cast("bigint") == F.col(key), "left").drop(key)
    return joined.withColumn("added", F.when(F.col("flagged").isNotNull(), _term_spans(F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("flagged"))).otherwise(F.array().cast(SPAN)))


def joined_spans(spans: Column) -> Column:
    """kind:start:end, comma-joined, by start and then kind."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised(text: Column, base: Column, added: Column, flagged: Column) -> Column:
    """The text with base spans replaced by their kind, and disclosing terms generalised or removed.

    Overlapping spans are cut out as one.  The text is cut by characters.
    """
    everything = F.concat(
        F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("by"))),
        F.transform(added, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(F.element_at(flagged, F.lower(s["value"])) <= REMOVE_BITS, "").otherwise("<TERM>").alias("by"))),
    )
    chars = F.split(text, "")

    def rebuild(x: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

        def step(acc: Column, s: Column) -> Column:
            fresh = s["start"] >= acc["at"]
            piece = F.array_join(F.slice(x["chars"], (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int")), "")
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.when(fresh, F.array(piece, s["by"])).otherwise(F.array().cast("array<string>"))).alias("out"))

        end = lambda acc: F.concat(F.array_join(acc["out"], ""), F.array_join(F.slice(x["chars"], (acc["at"] + 1).cast("int"), F.size(x["chars"])), ""))
        return F.aggregate(x["spans"], start, step, end)

    return F.when(F.size(base) + F.size(added) == 0, text).otherwise(bind(F.struct(chars.alias("chars"), F.array_sort(everything).alias("spans")), rebuild))
