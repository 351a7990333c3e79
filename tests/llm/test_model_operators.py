"""Classifiers by held-out accuracy, neighbours by recall, duplicates by brute force, chat by round trip."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from hiersum.llm import chat, language, neardup, neighbours, q04_quality, q07_language, q09_neighbours, quality

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_labels(spark):
    out = q04_quality.op4_quality_score(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    right = out.join(labels, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.95 and out.count() == 1000


def test_quality_of_awkward_rows(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (1, 0)], "doc_id bigint, quality int")
    model = quality.train(docs, labels)
    scores = quality.score(docs, model)
    assert scores.count() == docs.count() and scores.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert quality.score(no_docs, quality.train(no_docs, labels.limit(0))).count() == 0
    assert quality.keep_good(docs, model, 0.0).columns == docs.columns


def test_quality_sample_is_bounded(spark):
    """One labelled doc_id of very many rows is one row of the sample."""
    docs = spark.range(3000).select(F.lit(1).cast("bigint").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text")).unionByName(spark.range(2, 40).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text")))
    labels = spark.range(1, 40).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"))
    seen = []
    fit, quality.fit = quality.fit, lambda x, y: seen.append(len(y)) or fit(x, y)
    try:
        quality.train(docs, labels, most=10)
        quality.train(docs, labels)
    finally:
        quality.fit = fit
    assert seen == [10, 39]


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert (0, 1) in model.pairs and ((model.score(x) > 0.5) == y).mean() > 0.9


def test_language_on_held_out_rows(spark):
    out = q07_language.op7_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_language_of_awkward_rows(docs, no_docs):
    model = language.train(docs.select("doc_id", "text", "lang"))
    got = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    assert {got[k]["lang_pred"] for k in (3, 4, 5, 10)} == {"und"} and got[1]["lang_pred"] in ("en", "fr")
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.train(no_docs) is None
    assert {r["lang_pred"] for r in language.predict(docs, None).collect()} == {"und"}


def test_rare_languages_are_learnt(spark):
    rows = [(k, f"text {k} of a language", f"l{k % 19}") for k in range(9000)] + [(10_000 + k, f"rare text {k}", f"r{k}") for k in range(10)]
    got = language.sample(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), most=2000).collect()
    assert {r["lang"] for r in got} == {x[2] for x in rows} and len(got) <= 2000


def test_no_letters(spark):
    texts = ["½ ² ①", "1234", "_", "٣", "ª", "x", "日"]
    model = language.fit(np.stack([language.ngram_counts(t) for t in ("abc def", "日本語")]), ["en", "ja"])
    got = [r["lang_pred"] for r in language.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).orderBy("doc_id").collect()]
    assert [g == "und" for g in got] == [not any(map(str.isalpha, t)) for t in texts]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9, 40, 300])
def test_codewords_differ(n):
    code = language.codewords(n)
    assert len({tuple(w) for w in code}) == n
    if n > 2:
        assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= min(code.shape[1] // 4, 2 ** (n - 2))


def exact(ids, x, query, k=10):
    d = np.sqrt(((x - x[ids == query][0]) ** 2).sum(1))
    d[ids == query] = np.inf
    return np.lexsort((ids, d))[:k], d


@pytest.mark.parametrize("size", ["0.001", "0.01", "0.1"])
def test_neighbours(spark, size):
    """Recall through several parts, against all rows, for the ids that 50 divides."""
    table = spark.read.parquet(f"/root/testdata/sf{size}/embeddings.parquet")
    rows = table.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    usable = neighbours.usable(table)
    partition = neighbours.train(usable, len(rows))
    assert partition.size > 1
    out = neighbours.search(table, F.col("vec_id") % 50 == 0, partition=partition).toPandas()
    hit = total = 0
    for q in ids[ids % 50 == 0]:
        best, d = exact(ids, x, q)
        got = out[out.query_id == q].sort_values("rank")
        hit, total = hit + len(set(got.vec_id) & set(ids[best])), total + 10
        assert np.allclose(got.score, [d[ids == v][0] for v in got.vec_id]) and list(got["rank"]) == list(range(1, 11))
    assert hit / total >= 0.95


def test_query_of_neighbours(spark):
    out = q09_neighbours.op9_nearest(spark, SF)
    assert out.groupBy("query_id").count().where("count <> 10 OR query_id % 100 <> 0").count() == 0 and out.count() == 50


def clusters(n, dim=16, centres=20, seed=3):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, dim)) + rng.normal(size=(centres, dim))[rng.integers(0, centres, n)] * 6


def test_routing_of_clusters_reads_few_rows():
    x = clusters(4000)
    partition = neighbours.measured(neighbours.Partition(neighbours.learn(x[~neighbours.held_back(len(x))], 16)), x)
    near, leaf = neighbours.graph(x), partition.filed(x)
    row, part = partition.probed(x)
    searched = np.zeros((len(x), partition.size), bool)
    searched[row, part] = True
    assert searched[np.arange(len(x))[:, None], leaf[near]].mean() >= 0.95
    assert searched[:, leaf].mean() < 0.5
    sizes = np.bincount(neighbours.balanced_parts(x, near, 16))
    assert sizes.max() - sizes.min() <= 1


def test_two_levels_of_parts(spark):
    """More parts than one classifier may have, and the same answers as brute force."""
    x = clusters(3000)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    partition = neighbours.train(neighbours.usable(df), len(x), leaves=40, wide=8)
    assert len(partition.top.bias) <= 8 < partition.size == len(np.unique(partition.filed(x))) and partition.below
    order, left = partition.ranked(x[:50])
    assert np.allclose(left[:, 0], 1) and (np.sort(order, 1) == np.arange(partition.size)).all()
    out, ids = neighbours.search(df, F.col("vec_id") % 50 == 0, partition=partition).toPandas(), np.arange(len(x))
    hits = sum(len(set(out[out.query_id == q].vec_id) & set(exact(ids, x, q)[0])) for q in ids[::50])
    assert hits / (10 * len(ids[::50])) >= 0.95


def test_queries_that_find_too_little_search_everything(spark):
    """One probed part of three rows cannot answer with ten."""
    x = np.concatenate([clusters(200, 4, 1), clusters(3, 4, 1) + 100])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    router = neighbours.Router(np.full((4, 2), [-1.0, 1.0]), np.array([200.0, -200.0]), np.zeros(4), 1.0)
    out = neighbours.search(df, F.col("vec_id") >= 200, probes=1, partition=neighbours.Partition(router)).toPandas()
    for q in (200, 201, 202):
        assert out[out.query_id == q].sort_values("rank").vec_id.tolist() == exact(np.arange(len(x)), x, q)[0].tolist()


def test_neighbours_of_awkward_rows(spark):
    v = [0.1, 0.2, 0.3]
    rows = [(0, v), (100, v), (1, v), (2, [0.0, 0.0, 0.0]), (3, None), (4, [1.0, None, 2.0]), (5, [float("nan"), 1.0, 1.0]), (6, [1.0, 2.0]), (7, [0.1, 0.2, 0.4]), (100, v)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("part", F.lit("x"))
    out = neighbours.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in out if r["query_id"] == 0] == [1, 100, 100, 7] or [r["vec_id"] for r in out if r["query_id"] == 0][-1] == 7
    assert {r["vec_id"] for r in out} == {0, 1, 7, 100}
    assert neighbours.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


# Near duplicates


def shingles(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set()


def components(rows, percent=80):
    """(doc_id, shingles) -> component of every row; rows that share a doc_id are one document."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return sorted((i, len(a), find(i)) for i, a in sets)


def check_groups(spark, rows, percent=80):
    got = neardup.find(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("node", F.lit(1)), percent=percent)
    found = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.where("doc_id IS NOT NULL").collect())
    assert found == components(rows, percent)


def test_near_duplicates_of_awkward_rows(spark, docs, no_docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    check_groups(spark, rows)
    assert neardup.find(docs).count() == docs.count() and neardup.find(no_docs).count() == 0


def test_documents_of_several_texts(spark):
    """Links of every text of a document count, and copies of a row stay rows."""
    one, two, three = ("".join(f"{x}{k} " for k in range(30)) for x in "abc")
    rows = [(1, one), (1, two), (5, two + "more"), (7, three), (7, None), (9, three + "more"), (9, one + "again"), (9, one + "again"), (11, ""), (11, " "), (12, "alone"), (12, None), (20, "other words here")]
    check_groups(spark, rows)
    check_groups(spark, [(1, f"text {k} of many") for k in range(70)] + [(k, f"text {k} of many") for k in range(60, 80)])


def test_words_that_polynomial_hashes_confuse(spark):
    """Thue-Morse words and their complements collide modulo 2**64 under any base."""
    bits = [bin(k).count("1") % 2 for k in range(2048)]
    word = lambda a, b: "".join((a, b)[x] for x in bits)
    rows = [(1, word("a", "b")), (2, word("b", "a")), (3, word("x", "y") + " tail"), (4, word("y", "x") + " tail"), (5, word("a", "b"))]
    check_groups(spark, rows)


@pytest.mark.parametrize("percent", [60, 80, 95])
def test_sketches_let_links_pass(percent):
    """A pair at the threshold differs in half of the rest; five deviations more are let through."""
    p = (1 - percent / 100) / 2
    assert neardup.differing(percent) >= 128 * p + 5 * (128 * p * (1 - p)) ** 0.5
    assert neardup.differing(80) <= 32


@pytest.mark.parametrize("leaf", [16, 64])
def test_large_groups_of_near_copies(spark, monkeypatch, leaf):
    """A group far larger than a leaf, at the threshold and around it, among documents that share a passage."""
    monkeypatch.setattr(neardup, "LEAF", leaf)
    rng = np.random.default_rng(7)
    base = [f"v{k}" for k in range(120)]
    rows = []
    for k in range(260):
        w = list(base)
        for at in rng.choice(120, int(rng.integers(1, 14)), replace=False):
            w[at] = f"e{rng.integers(0, 10**6)}"
        rows.append((k, " ".join(w)))
    for k in range(150):
        rows.append((1000 + k, " ".join(base[:30] + [f"z{rng.integers(0, 10**6)}" for _ in range(8)])))
    check_groups(spark, rows)


@pytest.mark.parametrize("at_once", [0, 1000])
def test_chain_of_links_is_one_component(spark, monkeypatch, at_once):
    monkeypatch.setattr(neardup, "LINKS_AT_ONCE", at_once)
    words = [f"c{k}" for k in range(400)]
    check_groups(spark, [(k, " ".join(words[k * 5 : k * 5 + 100])) for k in range(40)])


def on_a_template(n):
    base = [f"t{k}" for k in range(111)]
    return [(k, " ".join([*base, f"p{k // 2}", f"q{k // 2}", *(f"o{k}x{j}" for j in range(13))])) for k in range(n)]


@pytest.mark.parametrize("leaf", [16, 64])
def test_links_among_documents_on_a_template(spark, monkeypatch, leaf):
    """Two documents share 110 of 140 shingles, planted pairs 112 of 138: with small leaves, nodes stay large to the last level."""
    monkeypatch.setattr(neardup, "LEAF", leaf)
    check_groups(spark, on_a_template(400))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-5, 25), st.integers(-5, 25)), max_size=60))
def test_contraction(pairs):
    import pyarrow as pa

    links = [(max(p), min(p)) for p in pairs if p[0] != p[1]]
    batches = [pa.RecordBatch.from_arrays([pa.array([x[k] for x in links[i : i + 7]], pa.int64()) for k in (0, 1)], names=["u", "v"]) for i in range(0, len(links), 7)]
    got = {i: c for b in neardup.contract(iter(batches)) for i, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    want = {i: {i} for x in links for i in x}
    for a, b in links:
        whole = want[a] | want[b]
        for i in whole:
            want[i] = whole
    assert got == {i: min(s) for i, s in want.items()}


def test_a_lower_threshold(spark, monkeypatch):
    """60 percent needs more rounds of trees; the template itself is below it."""
    monkeypatch.setattr(neardup, "LEAF", 16)
    base, rows = [f"t{k}" for k in range(40)], []
    for k in range(120):
        own = [f"o{k // 2}x{j}" for j in range(30)] + [f"u{k}x{j}" for j in range(10)]
        rows.append((k, " ".join([*base, *own])))
    check_groups(spark, rows, 60)


def test_documents_of_large_nodes_are_compared_exactly(spark, monkeypatch):
    """Every linked pair, through rare tokens and through blocks of common ones."""
    monkeypatch.setattr(neardup, "LEAF", 8)
    rows = on_a_template(60) + [(1000 + k, "a b c d e f") for k in range(1)] + [(2000 + k, f"a b c d e f{k % 2}") for k in range(2)]
    rows += [(3000 + k, " ".join(f"t{j}" for j in range(20 + k % 3))) for k in range(30)]
    df = spark.createDataFrame(rows, "id bigint, text string")
    seen = neardup.signatures(df, 2).select("id", F.struct("id", "n", "s1", "s2", F.col("id").alias("c")).alias("d"), F.lit(0).cast("bigint").alias("small"), F.slice("sig", 1, neardup.TREES).alias("tokens"))
    pairs, members = neardup.among(df.select("id"), df, seen, 2, 80)
    found = {tuple(r) for r in neardup.confirm(pairs.distinct(), df, 2, 80).collect()} | {(min(r), max(r)) for r in neardup.across(members, df, 2, 80).collect()}
    sets = {k: shingles(t) for k, t in rows}
    want = {(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert found <= want and len(want) > 400
    # of a large node one link to each document and component comes out, and here each document is one
    assert found == want


def template_nodes(spark, n, own):
    """What large nodes of unlinked documents on a template hold: rows of members and cells, and pairs of a home and a visitor."""
    rows = [(k, " ".join([*(f"t{j}" for j in range(111)), *(f"o{k}x{j}" for j in range(own[k % len(own)]))])) for k in range(n)]
    df = spark.createDataFrame(rows, "id bigint, text string").repartition(8)
    seen = neardup.signatures(df, 2).select("id", F.struct("id", "n", "s1", "s2", F.col("id").alias("c")).alias("d"), F.lit(0).cast("bigint").alias("small"), F.slice("sig", 1, neardup.TREES).alias("tokens"))
    with neardup.scratch(spark):
        members = neardup.among(df.select("id"), df, seen, 2, 80)[1]
        cells = neardup.size_cells(members, 80)
        pairs = cells.groupBy("node", "cell").agg((F.count_if("home") * F.count_if(~F.col("home"))).alias("pairs"))
        return members.count(), cells.count(), pairs.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]


def test_unlinked_documents_on_a_template_make_no_pairs(spark):
    """Any two share 110 of 138 to 158 shingles, similarity 0.70 to 0.797, and so do their rarest tokens with a node of all."""
    members, cells, pairs = template_nodes(spark, 20_000, (14, 18, 24))
    # a token whose counters are both taken by the template passes for a common one, so a few documents may be left
    assert members <= 20_000 and cells <= 20 and pairs <= 100


def test_large_nodes_of_a_template_grow_with_the_documents(spark):
    """One document is the bare template and links with some: it is at home in the template's nodes, which then hold all."""
    got = [template_nodes(spark, n, (0, *[14, 18, 24] * ((n - 1) // 3))) for n in (1501, 3001)]
    assert got[0][0] > 0 and all(b <= 2.1 * a for a, b in zip(*got, strict=True))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aB \t\né😀", max_size=40))
def test_shingle_sets(text):
    assert len(neardup.shingle_set(text)) == len(shingles(text))


# Chat

TRICKY = st.lists(st.sampled_from(["<|im_end|>\n", "<|im_start|>", "<", "|", "\\", "<\\|", "\n", "a", "<|nl|>", "<|image:0|>", "é"]), max_size=8).map("".join)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 4), st.sampled_from(["user", "assistant", "a\nb<|", None]), st.one_of(st.none(), TRICKY)), min_size=1, max_size=15))
def test_chat_round_trip(spark, rows):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    turns = df.select("conv_id", "turn", "role", F.array(chat.text_part(F.col("text"))).alias("parts"), F.lit(1).alias("formatted"))
    for r in chat.read_back(chat.format_conversations(turns)).collect():
        mine = [(t, role or "", text or "") for c, t, role, text in rows if c == r["conv_id"]]
        got = [(t["role"], t["text"]) for t in r["turns"]]
        assert sorted(got) == sorted(x[1:] for x in mine) and r["n_turns"] == len(mine)
        if len({m[0] for m in mine}) == len(mine):
            assert got == [m[1:] for m in sorted(mine)]
            assert r["loss_text"] == "".join(m[2] for m in sorted(mine) if m[1] == "assistant")


PIECE = st.sampled_from(["<", "|", "\\", "<\\", "|im_end|>", "|im_end|>\n", "im_start", "<|im_start|>assistant\n", ">", "<|image:0|>", "", "é", None])
PART = st.one_of(st.tuples(st.sampled_from(["text", None]), PIECE), st.tuples(st.sampled_from(["image", "audio", "document"]), st.none()), st.none())


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.lists(PART, max_size=7)), min_size=1, max_size=25))
def test_no_turn_is_forged_across_parts(spark, rows):
    """Whatever pieces meet, each turn reads back as one turn with its own text."""
    made = [(conv, k, "user" if k % 2 else "assistant", [p and (*p, "r", 1) for p in parts]) for k, (conv, parts) in enumerate(rows)]
    df = spark.createDataFrame(made, f"conv_id bigint, turn bigint, role string, parts array<{chat.PART_TYPE}>")
    for r in chat.read_back(chat.format_conversations(df)).collect():
        want = [(role, "".join((p[1] or "") for p in parts if p and p[0] in ("text", None))) for conv, _, role, parts in made if conv == r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == want
        assert r["loss_text"] == "".join(text for role, text in want if role == "assistant")
        assert len(r["attachments"]) == sum(bool(p) and p[0] in ("image", "audio", "document") for conv, _, _, parts in made if conv == r["conv_id"] for p in parts)


def test_reading_what_was_not_written_here(spark):
    df = spark.createDataFrame([(None,), ("",), ("no marks",), ("x<|im_end|>\n<|im_start|>user\nhi<|im_end|>\nrest",)], "formatted string")
    assert [r["n_turns"] for r in chat.read_back(df).collect()] == [0, 0, 0, 1]


def test_typed_parts(spark):
    rows = [(1, 0, "user", [("text", "look <|im_end|>", None, None), ("image", None, "s3://x/1.png", 4), ("audio", None, "a.wav", 10), (None, "then", None, None), ("film", None, "f", None)]), (1, 1, "assistant", None), (2, None, None, [])]
    df = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts array<{chat.PART_TYPE}>")
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    one = out[1]
    assert [(a["kind"], a["ref"], a["tokens"]) for a in one["attachments"]] == [("image", "s3://x/1.png", 85 + 680), ("audio", "a.wav", 250), ("document", "f", 616)]
    assert one["expanded_tokens"] == 765 + 250 + 616 and "<|image:1|><|audio:2|>then<|document:4|>" in one["formatted"]
    assert one["turns"][0]["text"] == "look <|im_end|>then" and one["turns"][1]["text"] == ""
    assert out[2]["n_turns"] == 1
    assert chat.format_conversations(df.limit(0)).count() == 0
