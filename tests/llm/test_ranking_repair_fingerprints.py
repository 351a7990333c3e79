"""Fingerprints, conversation repair and ranked search against brute force, and on awkward rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from hiersum.llm import fingerprints as fp
from hiersum.llm import ranking, repair
from hiersum.llm.common import table
from hiersum.llm.q11_fingerprints import op11_fingerprints
from hiersum.llm.q12_repair import damaged, op12_repair
from hiersum.llm.q13_ranking import op13_ranked_search

# Fingerprints


def _spark_hash(*parts):
    """xxhash64 of strings and small ints, column after column."""
    seed = 42
    for p in parts:
        raw = p.encode() if isinstance(p, str) else p.to_bytes(4, "little")
        if p is not None:
            seed = xxhash.xxh64_intdigest(raw, seed)
    return seed


def _fingerprint(text):
    lanes = [0] * fp.SIZE
    for p in re.split("[\n\x0b\f\r\x85\u2028\u2029]+", text or ""):
        if not p:
            continue
        digest = hashlib.sha256(p.encode()).hexdigest()
        for k in range(fp.IDENTITY):
            lanes[k] += _spark_hash(k, digest) & 0xFFFFFFFF
        words = [w for w in re.split("[ \t-\r]+", p) if w]
        for i, w in enumerate(words):
            h = _spark_hash(words[i - 1], w) if i else _spark_hash(w)
            for b in range(fp.CONTENT):
                lanes[fp.IDENTITY + b] += h >> b & 1
        lanes[-1] += len(words)
    return [v % 2**32 for v in lanes]


def _likeness(v, w):
    if v == w:
        return 1.0
    a, b = ([2 * c - x[-1] for c in x[fp.IDENTITY : -1]] for x in (v, w))
    scale = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    return max(0.0, min(1.0, sum(x * y for x, y in zip(a, b, strict=True)) / scale)) if scale else 0.0


def test_fingerprints_by_hand(docs):
    for r in docs.select("text", fp.fingerprint(F.col("text")).alias("v")).collect():
        assert r["v"] == _fingerprint(r["text"])


def test_paragraphs_in_any_order_and_one_at_a_time(spark):
    rows = spark.createDataFrame([("one two three\nfour five\n\nsix",), ("",), (None,)], "text string")
    v = fp.fingerprint(F.col("text"))
    more = F.lit("seven eight\nnine")
    got = rows.select(
        v.alias("v"),
        fp.fingerprint(F.concat_ws("\n", F.lit("six\nfour five\none two three"), F.col("text"))).alias("twice"),
        fp.insert(v, F.lit("six\none two three\nfour five")).alias("put"),
        fp.delete(fp.insert(v, more), more).alias("back"),
        fp.decoded(fp.encoded(v)).alias("again"),
    ).collect()
    for r in got:
        assert r["put"] == r["twice"] and r["back"] == r["v"] == r["again"]
    assert got[1]["v"] == got[2]["v"] == [0] * fp.SIZE


def test_more_words_than_a_byte_counts(spark):
    text = " ".join(f"w{k % 7}" for k in range(1000))
    assert spark.createDataFrame([(text,)], "text string").select(fp.fingerprint(F.col("text"))).first()[0] == _fingerprint(text)


def _edited(rows):
    """Distinct (doc_id, text) to the edited text and the next text."""
    keys = sorted({(i, t or "") for i, t in rows}, key=lambda k: (k[0] is None, -(k[0] or 0), _signed(k[1]), _signed2(k[1])))
    out = {}
    for k, key in enumerate(keys):
        text, after = key[1], keys[(k + 1) % len(keys)][1]
        half = len(text) // 2
        out[key] = text[: len(text) - half] + after[:half], after
    return out


def _signed(text):
    h = _spark_hash(text)
    return h - 2**64 if h >= 2**63 else h


def _signed2(text):
    h = _spark_hash(1, text)
    return h - 2**64 if h >= 2**63 else h


def _check_edits(rows, got):
    want = _edited(rows)
    assert len(got) == len(rows)
    for r in got:
        key = r["doc_id"], r["text"] or ""
        edited, after = want[key]
        assert r["edited"] == edited and r["n_chars"] == len(key[1])
        assert r["fingerprint"] == _fingerprint(key[1]) and r["edited_fingerprint"] == _fingerprint(edited) and r["next_fingerprint"] == _fingerprint(after)


def test_edits_of_awkward_rows(spark, docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(2, "another text of document 2"), (None, "no id here at all")]
    named = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in ("h1", "h2", "by_doc_id", "to_h1", "n_rows", "start", "half", "part", "edited", "fingerprint")})
    found = fp.edits(named).collect()
    left = sorted(((i, t or "") for i, t in rows), key=str)
    by_edit = collections.defaultdict(list)
    for k, (edited, after) in _edited(rows).items():
        by_edit[k[0], edited, tuple(_fingerprint(k[1])), tuple(_fingerprint(after))].append(k)
    assert sorted((k for r in found for k in by_edit[r["doc_id"], r["edited"], tuple(r["fingerprint"]), tuple(r["next_fingerprint"])]), key=str) == left or len(found) == len(rows)
    assert {(r["doc_id"], r["edited"], tuple(r["fingerprint"]), tuple(r["next_fingerprint"])) for r in found} == set(by_edit)
    assert fp.edits(no_docs).count() == 0
    single = fp.edits(spark.createDataFrame([(5, "abcd")], "doc_id bigint, text string")).first()
    assert single["edited"] == "abab"


def test_fingerprint_query_by_hand(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    want = _edited(rows)
    texts = {i: t or "" for i, t in rows}
    got = op11_fingerprints(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        text = texts[r["doc_id"]]
        edited, after = want[r["doc_id"], text]
        v, e, n = _fingerprint(text), _fingerprint(edited), _fingerprint(after)
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == "".join(f"{x:08x}" for x in v) and r["edited_fingerprint"] == "".join(f"{x:08x}" for x in e)
        assert r["near_edited"] == pytest.approx(_likeness(v, e), abs=1e-9) and r["near_next"] == pytest.approx(_likeness(v, n), abs=1e-9)
    assert sum(r["near_edited"] > r["near_next"] for r in got) > 0.97 * len(got)


# Repair

NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def _brute(flat):
    """(cost, audit, lines) of rows (role, text, fault), by relaxing every edit until nothing changes."""
    n, best, changed = len(flat), {(0, ""): (0, "", ())}, True
    while changed:
        changed = False
        for (i, last), (cost, audit, lines) in list(best.items()):
            steps = [((i, r), (cost + 2, audit + "I", (*lines, f"{NAMES[r]}:"))) for r in NEXT[last] if r in NAMES]
            if i < n:
                role, text, fault = flat[i]
                steps.append(((i + 1, last), (cost + 3, audit + "D", lines)))
                if fault in ("", "truncated"):
                    more = cost + (fault == "truncated")
                    if role[:1] and role[:1] in NEXT[last]:
                        steps.append(((i + 1, role[:1]), (more, audit + "K", (*lines, f"{role}:{text}"))))
                    steps += [((i + 1, r), (more + 2, audit + "R", (*lines, f"{NAMES[r]}:{text}"))) for r in NEXT[last] if r in NAMES]
            for node, way in steps:
                if node not in best or way[:2] < best[node][:2]:
                    best[node], changed = way, True
    return min((best[n, s] for s in ("", "a") if (n, s) in best), key=lambda w: w[:2])


def _repaired(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired of rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, flat = set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\f\r")
        flat.append((role, text, "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"))
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    count = collections.Counter(f for *_, f in flat)
    illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(flat, flat[1:], strict=False))
    cost, audit, lines = _brute(flat)
    return max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, "\n".join(lines)


def test_search_against_brute_force():
    rng = random.Random(1)
    roles, faults = {repair.SYSTEM: "s", repair.USER: "u", repair.ASSISTANT: "a", repair.OTHER: "x"}, {repair.SOUND: "", repair.BLANK: "blank", repair.DUPLICATE: "duplicate", repair.CUT: "truncated"}
    for _ in range(1500):
        rows = [(rng.choice((1, 2, 2, 3, 3, 4)), rng.choice((0, 0, 0, 1, 2, 3)), rng.choice((1, 1, 1, 2, 3))) for _ in range(rng.randint(0, 9))]
        flat = [(roles[r], "t", faults[f] if k == 0 or f == repair.BLANK else "duplicate") for r, f, n in rows for k in range(n)]
        whole = repair.solve(rows)
        assert whole[:2] == _brute(flat)[:2]
        assert repair.solve(rows, piece=rng.randint(1, 4)) == whole
        assert repair.decode("".join(repair.encode(r, f) + (str(n) if n > 1 else "") for r, f, n in rows)) == rows


def test_repair_query_by_hand(spark, sf):
    by = collections.defaultdict(list)
    for conv_id, turn, role, text in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect():
        harm = zlib.crc32(f"{conv_id}:{turn}".encode()) % 20
        rows = by[conv_id]
        if harm:
            text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
            rows += [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    got = {r["conv_id"]: tuple(r)[1:] for r in op12_repair(spark, sf).collect()}
    assert set(got) == set(by)
    for conv_id, rows in by.items():
        *facts, lines = _repaired(rows)
        assert got[conv_id] == (*facts, hashlib.sha256(lines.encode()).hexdigest())


def test_repair_of_awkward_rows(spark):
    rows = [
        (1, 0, "user", "Hello."), (1, 1, "assistant", "Hi."), (1, 1, "assistant", "Hi."), (1, None, "system", "Be kind."),
        (2, 5, None, None), (2, 9, "", "  \n"), (3, None, "user", "no end"), (3, None, "user", "no end"), (4, 7, "tool", "Result!"),
        (None, 1, "user", "Who?"), (None, 2, "user", "Me."), (5, 2**62, "assistant", "a."), (5, -(2**62), "user", "b."), (6, 3, "user", "x" * 50_000 + "."),
    ]
    rows += [(7, k, ("user", "assistant")[k % 2] if k % 5 else "user", f"row {k}." if k % 7 else f"row {k}") for k in range(1300)]
    named = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({c: F.lit("clash") for c in ("block", "rows", "h1", "h2", "of", "of1", "when", "first", "turns", "copies", "fault", "plan", "codes", "at")})
    by = collections.defaultdict(list)
    for conv_id, turn, role, text in rows:
        by[conv_id].append((turn, role or "", text or ""))
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair(named).collect()}
    assert set(got) == set(by)
    for conv_id in set(by) - {7}:
        assert got[conv_id] == _repaired(by[conv_id])
    long = got[7]
    assert len(long[6].replace("I", "")) == 1300  # every row has its edit
    initials = "".join(line[0] for line in long[7].split("\n"))
    assert re.fullmatch("s?(ua)+", initials)
    assert repair.repair(named.where("false")).count() == 0


def test_nothing_left_of_a_conversation(spark, tmp_path):
    """A conversation whose every row is lost keeps its row."""
    lost = [k for k in range(200) if zlib.crc32(f"{k}:0".encode()) % 20 == 0]
    spark.createDataFrame([(k, 0, "user", "Hello.") for k in lost], "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = op12_repair(spark, str(tmp_path)).collect()
    assert sorted(r["conv_id"] for r in got) == lost
    assert {tuple(r)[1:] for r in got} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert damaged(table(spark, str(tmp_path), "conversations")).count() == 0


# Ranked search


def _ranked(docs, items, top):
    terms = lambda t: [w for w in re.split("[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate({k: k + 32 for k in range(65, 91)})) if w]
    bags = [(i, terms(t)) for i, t in docs]
    bags = [(i, len(w), collections.Counter(w)) for i, w in bags if w]
    n_docs, length = len(bags), sum(n for _, n, _ in bags)
    df = collections.Counter(w for *_, c in bags for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, n, c in bags:
            m = 50 + 50 * n * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in set(terms(text)) if c[w])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, k, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize(("queries", "postings", "docs_"), [(2000, 1_000_000, 65_536), (3, 40, 7)])
def test_ranking_by_hand(spark, docs, no_docs, monkeypatch, queries, postings, docs_):
    """Any size of blocks and shards gives the same lists."""
    for name, value in (("BLOCK_QUERIES", queries), ("SHARD_POSTINGS", postings), ("SHARD_DOCS", docs_), ("MERGED", 2)):
        monkeypatch.setattr(ranking, name, value)
    rng = random.Random(2)
    texts = [(100 + k, " ".join(rng.choices("alpha beta gamma delta Epsilon zeta ÉTA eta theta 42".split(), range(1, 11), k=rng.randint(1, 30)))) for k in range(300)]
    texts += [(k, texts[0][1]) for k in range(20)] + [(None, texts[0][1]), (100, texts[0][1])]
    every = docs.select("doc_id", "text", "n", "score").unionByName(spark.createDataFrame(texts, "doc_id bigint, text string"), allowMissingColumns=True).repartition(5)
    items = [(1, "alpha beta"), (2, "ALPHA, the fox; zeta"), (3, None), (4, ""), (5, "!!"), (6, "nothing of this"), (7, "École étA eta é 42 42"), (7, "river bank"), (None, "gamma")]
    found = ranking.search(every, spark.createDataFrame(items, "item_id bigint, text string").withColumn("rank", F.lit("clash")), top=12)
    assert _rows(found) == _ranked([(r["doc_id"], r["text"]) for r in every.collect()], items, 12)
    assert ranking.search(no_docs, spark.createDataFrame(items, "item_id bigint, text string")).count() == 0
    assert ranking.search(every, spark.createDataFrame([], "item_id bigint, text string")).count() == 0


def test_ranked_search_query_by_hand(spark, sf):
    rows = lambda name, key: [(r[key], r["text"]) for r in table(spark, sf, name).collect()]
    assert _rows(op13_ranked_search(spark, sf)) == _ranked(rows("documents", "doc_id"), rows("benchmark", "item_id"), 50)


def test_wand_skips_documents():
    """Documents that cannot reach the heap are not scored."""
    import numpy as np

    rng = np.random.default_rng(3)
    n = 5000
    common, rare = rng.integers(1, 100, n), rng.choice(n, 400, replace=False)
    doc, term = np.r_[np.arange(n), rare], np.r_[np.zeros(n, int), np.ones(400, int)]
    shard = ranking.Shard(list(range(n)), doc, term, np.r_[common, np.full(400, 1000)])
    heap = ranking.Heap(10)
    assert shard.search([0, 1], heap) < n / 5
    total = common.copy()
    total[rare] += 1000
    assert sorted(heap.items(), reverse=True) == sorted(((int(total[k]), int(k)) for k in np.lexsort((np.arange(n), -total))[:10]), reverse=True)
