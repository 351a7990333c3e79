"""Query op12: damaged conversations, and their cheapest repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import repair
from .common import table

FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damaged(turns: DataFrame) -> DataFrame:
    """Rows lost, emptied, stripped of sentence ends, doubled or given to the user, by a hash of conv_id and turn.  Nulls are one space."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = turns.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), (F.crc32(F.concat_ws(":", *named).cast("binary")) % 20).alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("harm") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.where("harm <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    found = repair.repair(damaged(turns)).withColumnRenamed("conv_id", "of")
    every = turns.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    rows = every.join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    return rows.select(
        "conv_id",
        *(F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in FACTS),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.sha2(F.coalesce("repaired", F.lit("")).cast("binary"), 256).alias("repaired_sha256"),
    )


# The SQL knows no search: it folds the rows of a conversation, in order, into the best way to each last role.  A way is
# one string, its cost in nine digits, its audit, and behind a separator its lines; so the least string is the best way.

_SEP = "chr(1)"


def _step(way: str, cost: str, letter: str, line: str) -> str:
    """A way with one more edit."""
    audit, lines = (f"split_part(substr({way}, 10), {_SEP}, {k})" for k in (1, 2))
    return f"printf('%09d', substr({way}, 1, 9)::INTEGER + {cost}) || {audit} || {letter} || {_SEP} || {lines} || {line}"


_NONE, _SYSTEM, _USER, _ASSISTANT = (f"w.way[{k}]" for k in (1, 2, 3, 4))
_LINE = {r: f"'{r}:' || x.text || chr(10)" for r in ("user", "assistant")}
_INSERT = lambda way, role: _step(way, "2", "'I'", f"'{role}:' || chr(10)")
_STAYS = "CASE WHEN x.fault = 'truncated' THEN 1 ELSE 0 END"
_LOST = "'900000000' || chr(1)"


def _kept(way: str, initial: str) -> str:
    return f"CASE WHEN x.fault IN ('', 'truncated') AND left(x.role, 1) = '{initial}' THEN {_step(way, _STAYS, chr(39) + 'K' + chr(39), 'x.role || chr(58) || x.text || chr(10)')} ELSE {_LOST} END"


def _changed(way: str, role: str) -> str:
    return f"CASE WHEN x.fault IN ('', 'truncated') THEN {_step(way, '2 + ' + _STAYS, chr(39) + 'R' + chr(39), _LINE[role])} ELSE {_LOST} END"


_DELETED = lambda way: _step(way, "3", "'D'", "''")
_TO_USER = (_NONE, _SYSTEM, _ASSISTANT)
#: What a fold does at each kind of step: insert a user, an assistant, a user again, and then edit the row.
_AFTER = {
    1: (_NONE, _SYSTEM, f"least({', '.join([_USER, *(_INSERT(w, 'user') for w in _TO_USER)])})", _ASSISTANT),
    2: (_NONE, _SYSTEM, _USER, f"least({_ASSISTANT}, {_INSERT(_USER, 'assistant')})"),
    3: (_NONE, _SYSTEM, f"least({_USER}, {_INSERT(_ASSISTANT, 'user')})", _ASSISTANT),
    4: (
        _DELETED(_NONE),
        f"least({_DELETED(_SYSTEM)}, {_kept(_NONE, 's')})",
        f"least({', '.join([_DELETED(_USER), *(_kept(w, 'u') for w in _TO_USER), *(_changed(w, 'user') for w in _TO_USER)])})",
        f"least({_DELETED(_ASSISTANT)}, {_kept(_USER, 'a')}, {_changed(_USER, 'assistant')})",
    ),
}
_FOLD = "CASE x.kind " + " ".join(f"WHEN {k} THEN [{', '.join(v)}]" for k, v in _AFTER.items()) + " END"
_CRC = "xor(list_reduce(list_concat([4294967295], list_transform(string_split({s}, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: list_reduce([xor(h, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384))), 4294967295)"

SQL = f"""
WITH named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format(s="coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS harm FROM conversations
), harmed AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role, CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM named, range(0, 2) AS c(copy) WHERE harm <> 0 AND (copy = 0 OR harm = 3)
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM harmed
), judged AS (
  SELECT *, left(lag(role) OVER (PARTITION BY conv_id ORDER BY k), 1) || left(role, 1) AS pair,
    CASE WHEN regexp_matches(text, '^[\x20\x09-\x0D]*$') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
  FROM ordered
), steps AS (
  SELECT conv_id, list({{way: CASE WHEN false THEN [''] END, kind: kind, role: role, text: text, fault: fault}} ORDER BY k, kind) AS steps
  FROM (SELECT conv_id, k, kind, role, text, fault FROM judged, range(1, 5) AS s(kind) UNION ALL SELECT conv_id, 9223372036854775807, kind, '', '', '' FROM (SELECT DISTINCT conv_id FROM judged), range(1, 4) AS s(kind)) GROUP BY conv_id
), solved AS (
  SELECT conv_id, list_reduce(list_concat([{{way: ['000000000' || chr(1), {_LOST}, {_LOST}, {_LOST}], kind: 0::BIGINT, role: '', text: '', fault: ''}}], steps),
    lambda w, x: {{way: {_FOLD}, kind: 0::BIGINT, role: '', text: '', fault: ''}}).way AS way FROM steps
), best AS (SELECT conv_id, least(way[1], way[4]) AS way FROM solved),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(substr(way, 1, 9)::BIGINT, 0)::BIGINT AS cost, coalesce(split_part(substr(way, 10), {_SEP}, 1), '') AS audit, sha256(coalesce(left(split_part(substr(way, 10), {_SEP}, 2), -1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM e.conv_id
"""

QUERIES = {"op12_repair": op12_repair}
ORACLES = {"op12_repair": SQL}
