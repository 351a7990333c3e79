"""Nearness of small sources, clashing names, skewed entities, models against naive scoring, and tables that go."""

import collections
import itertools
import math
import os
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import hiersum.llm
from hiersum.llm import chat, decontaminate, fingerprints, language, mixing, neardup, neighbours, pii, quality, ranking, repair, secrets, tokens
from hiersum.llm.common import checkpoint, scratch, shared_dir, table
from hiersum.llm.q01_tokens import PATTERN, TOKENIZERS, VOCABULARY
from hiersum.llm.q03_mixing import WITHIN, op3_source_mix


def _by_source(df, sf, spark):
    rows = df.join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").collect()
    out = collections.defaultdict(list)
    for r in rows:
        out[r["source"]].append(r)
    return out


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_small_sources_end_near_their_targets(spark, scale):
    """Within a hundredth of the target, or as near as any choice of floor and ceiling comes."""
    sf = f"/root/testdata/{scale}"
    for rows in _by_source(op3_source_mix(spark, sf), sf, spark).values():
        taken, target = sum(r["taken"] for r in rows), rows[0]["target"]
        sizes = [r["size"] for r in rows if r["size"]]
        rate = target / rows[0]["source_size"]
        if abs(taken - target) > max(WITHIN * target, 0.5):
            assert len(sizes) <= mixing.LEVERS
            base = math.floor(rate) * sum(sizes)
            best = min(abs(base + sum(s) - target) for n in range(len(sizes) + 1) for s in itertools.combinations(sizes, n))
            assert abs(taken - target) <= best + 1e-6
        assert all(r["taken"] in (math.floor(rate) * r["size"], math.ceil(rate) * r["size"]) for r in rows)


def test_a_document_that_outweighs_its_source(spark):
    """It gives way to the target; without ``within`` it keeps its expectation."""
    sizes = [300, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41]
    rows = spark.range(60 * len(sizes)).select(F.col("id").alias("doc_id"), F.format_string("s%03d", F.floor(F.col("id") / len(sizes))).alias("source"), F.repeat(F.lit("w "), F.element_at(F.array(*map(F.lit, sizes)), (F.col("id") % len(sizes) + 1).cast("int"))).alias("text"))
    off = lambda **more: max(abs(r["taken"] - r["target"]) / r["target"] for r in mixing.mix(rows, **more).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect())
    assert off(within=WITHIN) <= WITHIN < off()
    once, again = (sorted(map(tuple, mixing.mix(rows.repartition(n), within=WITHIN).select("doc_id", "copies").collect())) for n in (2, 5))
    assert once == again


# Names


def _inner_names():
    """Every name that the subpackage writes as a string: columns, aliases, fields."""
    names = set()
    for path in Path(hiersum.llm.__file__).parent.glob("*.py"):
        names |= set(re.findall(r'"([a-z_][a-z0-9_]{0,25})"', path.read_text()))
    return sorted(names)


def _clashing(df, needed):
    return df.select(*needed, *(F.lit("clash").alias(n) for n in _inner_names() if n not in needed))


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(k, f"Text number {k} of the river bank, mail a{k % 2}@b.cc today. " * 3, ("en", "fr")[k % 2], f"s{k % 2}", 9) for k in range(12)]
    df = _clashing(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), ("doc_id", "text", "lang", "source", "n_chars"))
    return checkpoint(df)


def _items(spark):
    return _clashing(spark.createDataFrame([(1, "the river bank"), (2, "mail today number of text river bank of text number mail today")], "item_id bigint, text string"), ("item_id", "text"))


@pytest.mark.parametrize(
    "run",
    [
        lambda s, d: tokens.count_tokens(d, f"{TOKENIZERS}/{VOCABULARY}", PATTERN),
        lambda s, d: decontaminate.find(d, _items(s)),
        lambda s, d: mixing.mix(d, within=0.01),
        lambda s, d: quality.score(d, quality.train(d, _clashing(s.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int"), ("doc_id", "quality")))),
        lambda s, d: pii.find(d, support=2),
        lambda s, d: neardup.find(d),
        lambda s, d: language.predict(d, language.train(d)),
        lambda s, d: secrets.scan(d),
        lambda s, d: fingerprints.edits(d),
        lambda s, d: ranking.search(d, _items(s)),
    ],
)
def test_columns_with_any_name_that_is_used_inside(spark, clashing, run):
    assert len(clashing.columns) > 100
    plain = clashing.select("doc_id", "text", "lang", "source", "n_chars")
    got, want = run(spark, clashing), run(spark, plain)
    columns = [c for c in want.columns if c not in plain.columns or c == "doc_id"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def test_vectors_and_turns_with_any_name(spark):
    vectors = spark.createDataFrame([(k, [float(k), 1.0, 2.0]) for k in range(30)], "vec_id bigint, embedding array<float>")
    got = neighbours.search(_clashing(vectors, ("vec_id", "embedding")), F.col("vec_id") % 10 == 0, k=3)
    assert got.count() == 9
    turns = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Ho.")], "conv_id bigint, turn bigint, role string, text string")
    parts = turns.withColumn("parts", F.array(chat.text_part(F.col("text"))))
    assert chat.format_conversations(_clashing(parts, ("conv_id", "turn", "role", "parts"))).count() == 1
    assert repair.repair(_clashing(turns, ("conv_id", "turn", "role", "text"))).first()["audit"] == "KK"


def test_results_replace_columns_of_their_name(spark):
    docs = spark.createDataFrame([(1, "a@b.cc", "x", "y", "z", "w")], "doc_id bigint, text string, base string, added string, flagged string, flag_id string")
    row = pii.find(docs).first()
    assert [s["value"] for s in row["base"]] == ["a@b.cc"] and row["added"] == [] and row["flagged"] is None and row["flag_id"] == "w"


# Personal data


def _disclosing(docs, support, max_bits):
    """Brute force: every entity and term of every document."""
    word = re.compile(r"(?<![A-Za-z0-9._%+@\x80-\U0010FFFF-])[A-Za-z\x80-\U0010FFFF]{3,}(?![A-Za-z\x80-\U0010FFFF0-9@_%+-]|\.[A-Za-z0-9._%+@-])")
    both, alone = collections.Counter(), collections.Counter()
    for text in docs:
        mails = {f"email:{m.lower()}" for m in re.findall(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text)}
        terms = {w.lower() for w in word.findall(text)}
        alone.update(terms)
        both.update((e, t) for e in mails for t in terms)
    return {(e, t): math.log2(alone[t] / n) for (e, t), n in both.items() if n >= support and math.log2(alone[t] / n) <= max_bits}


def test_disclosing_terms_by_brute_force(spark):
    """A footer's address in every document, and a list of addresses that always stands whole."""
    rng = np.random.default_rng(4)
    names = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(400)]
    contacts = " ".join(f"{n}@list.example.com" for n in names[:150]) + " " + " ".join(names[150:300])
    texts = [" ".join(rng.choice(names[300:], 12)) + " office@footer.example.com" for _ in range(60)] + [f"{contacts} office@footer.example.com"] * 6
    texts += ["boss secretword", "boss@x.yy secretword alpha"] + ["boss@x.yy secretword"] * 5
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    for bits in (0.5, 1.2):
        got = {(r["entity"], r["term"]): r["bits"] for r in pii.disclosing(rows, max_bits=bits, support=5).collect()}
        assert got == pytest.approx(_disclosing(texts, 5, bits))
    assert pii.disclosing(rows.limit(0)).count() == 0


# Models


def test_quality_scores_are_sums_over_tables_and_trees():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(quality.FEATURES)))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(scale=0.3, size=400) > 0).astype(float)
    model = quality.fit(x, y)
    assert model.pairs
    for row, got in zip(x[:50], model.score(x[:50]), strict=True):
        total = model.intercept
        for j, lookup in enumerate(model.tables):
            total += lookup[sum(v >= e for v, e in zip([row[j]] * len(model.edges[j]), model.edges[j], strict=True))]
        for (a, b), lookup in zip(model.pairs, model.pair_tables, strict=True):
            total += lookup[sum(row[a] >= e for e in model.pair_edges[a]), sum(row[b] >= e for e in model.pair_edges[b])]
        assert got == pytest.approx(1 / (1 + math.exp(-total)))


def test_languages_are_decoded_to_the_nearest_codeword():
    rng = np.random.default_rng(2)
    languages = [f"l{k}" for k in range(6)]
    centres = rng.normal(size=(6, language.BUCKETS)).astype(np.float32)
    x = (centres[rng.integers(0, 6, 90)] + rng.normal(scale=3, size=(90, language.BUCKETS))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels = [languages[k] for k in (x @ centres.T).argmax(1)]
    model = language.fit(x, labels)
    best, share, close = model.score(x)
    for v, b, s, c in zip(x, best, share, close, strict=True):
        losses = []
        for word in model.code:
            losses.append(sum(w * math.log1p(math.exp(-m * bit)) for w, m, bit in zip(model.bit_weight, v @ model.weights + model.bias, word, strict=True)))
        shares = [math.exp(-k) for k in losses]
        top = sorted((k / sum(shares) for k in shares), reverse=True)
        assert b == int(np.argmin(losses)) and s == pytest.approx(top[0], rel=1e-4) and bool(c) == (top[0] - top[1] < language.AMBIGUOUS_LEAD)


# Tables


def test_nothing_stays_but_the_result(spark, sf):
    """Tables on the way go with their scope, and the pipeline leaves its mix alone."""
    import corpus_pipeline

    where = shared_dir(spark).removeprefix("file:")
    held = lambda: set(os.listdir(where))
    before = held()
    docs = table(spark, sf, "documents")
    with scratch(spark):
        for made in (mixing.mix(docs, within=WITHIN), pii.find(docs), decontaminate.find(docs, table(spark, sf, "benchmark")), ranking.search(docs, table(spark, sf, "benchmark"))):
            assert made.count() > 0
        assert held() > before
    assert held() == before
    mixed = corpus_pipeline.run(spark, sf)
    assert mixed.count() > 0 and len(held() - before) == 1
    with scratch(spark):
        corpus_pipeline.run(spark, sf).count()
    assert len(held() - before) == 1
