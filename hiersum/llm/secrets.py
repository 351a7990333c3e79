"""Secret scan with structural confirmation.

Base spans come from three patterns.  The method then looks at long base64,
base64url and hex candidates, decodes each, and reports it only when the
bytes parse as something that carries a key: a DER key encoding whose nested
lengths add up, an SSH wire-format key, or a signed token with a JSON header.

Lines are joined first, over line breaks and over written-out ones (\\n), and a
key may start anywhere in what is joined.  Its own lengths say where it ends,
and there the run must end too, so parts of certificates are not reported.
Base64 of a PEM text is decoded again.  A span covers all lines of its key.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "der", "ssh", "jwt")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_HINT = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
# A failing run is never tried again, and a run is failing or passing as a whole, so the length moves into the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
# What may stand between two lines of one key: line breaks, also written out, and spaces after a long piece.
BREAK = r"(?:(?:[ \t]*+(?:\r\n?|\n|\\++(?:[nr]|(?=[\r\n]))))++[ \t]*+|(?<=[A-Za-z0-9+/_-]{16})[ \t]++)"
BREAKS = re.compile(BREAK)
# How base64 of a SEQUENCE, of a short length, of the container's name and of PEM dashes before BEGIN (three alignments) can start.
STARTS = r"M[A-I]|AAAA[B-P]|b3BlbnNzaC1rZXktdjEA|LS0tLS1CRUdJTi|LS0tQkVHSU4g|LS0tLUJFR0lO"
PEM_END = re.compile(r"-{1,5}END [^-]*-{1,5}\s*")
SSH_TYPE = re.compile(rb"(ssh-(rsa|dss|ed25519)|ecdsa-sha2-nistp\d+)$")
CIPHER = re.compile(rb"[a-z0-9@.-]{2,64}")
CONTAINER = b"openssh-key-v1\0"
INTEGER, BITS, OCTETS, OID, SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30
#: Tags that key encodings use, and those of them that hold further elements.
DER_TAGS = frozenset((0x01, INTEGER, BITS, OCTETS, 0x05, OID, 0x0C, 0x13, 0x16, 0x17, 0x18, SEQUENCE, 0x31, 0x80, 0x81, 0xA0, 0xA1))
DER_NESTED = frozenset((SEQUENCE, 0x31, 0xA0, 0xA1))
#: Characters of an encoded key, at least.
LEAST = {6: 24, 4: 32}
JWT = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*(?![A-Za-z0-9_-])")

Span = tuple[int, int, int]


Item = tuple[int, int, int]


def der_items(data: bytes, at: int, end: int) -> list[Item] | None:
    """(tag, start, end) of the elements that fill a stretch; None if the lengths do not add up."""
    out: list[Item] = []
    while at < end:
        if end - at < 2:
            return None
        tag, n, body = data[at], data[at + 1], at + 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or body + k > end:
                return None
            n, body = int.from_bytes(data[body : body + k]), body + k
        if body + n > end or tag not in DER_TAGS or (tag == INTEGER and n == 0):
            return None
        out.append((tag, body, body + n))
        at = body + n
    return out


def der_ok(data: bytes) -> bool:
    """A SEQUENCE that fills ``data``, all nested lengths consistent, whose elements have the order of a key.

    That is a version and at least two more INTEGERs (RSA, DSA); a modulus and a small odd exponent
    (RSA public); a version, then an algorithm or an OCTET STRING (PKCS#8, PKCS#12, EC); or an algorithm, then
    a BIT or OCTET STRING (public, encrypted).  Two INTEGERs of one size are a
    signature.  Walks with an explicit stack, so nesting costs no recursion.
    """
    whole = der_items(data, 0, len(data)) if len(data) >= 16 else None
    if not whole or len(whole) != 1 or whole[0][0] != SEQUENCE:
        return False
    top = der_items(data, *whole[0][1:])
    stack = list(top or ())
    if not stack:
        return False
    while stack:
        tag, at, end = stack.pop()
        if tag in DER_NESTED:
            inside = der_items(data, at, end)
            if inside is None:
                return False
            stack += inside
    tags, value = [t for t, _, _ in top], lambda k: data[top[k][1] : top[k][2]]
    algorithm = lambda k: data[top[k][1]] == OID if top[k][2] > top[k][1] else False
    if tags[0] == INTEGER:
        version = len(value(0)) == 1 and value(0)[0] <= 3
        if set(tags) == {INTEGER}:
            return (version and len(tags) >= 3) or (len(tags) == 2 and len(value(0)) >= 64 and len(value(1)) <= 8 and value(1)[-1] % 2 == 1)
        return version and len(tags) >= 2 and ((tags[1] == SEQUENCE and algorithm(1)) or (tags[1] == OCTETS and len(value(1)) >= 16))
    return tags[0] == SEQUENCE and len(tags) == 2 and tags[1] in (BITS, OCTETS) and algorithm(0)


def unbase64(token: str) -> bytes | None:
    body = token.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def jwt_ok(token: str) -> bool:
    """header.payload.signature: both JSON objects, the header names an algorithm."""
    parts = token.split(".")
    if len(parts) != 3:
        return False
    try:
        header, payload = (json.loads(unbase64(p) or b"") for p in parts[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(payload, dict) and isinstance(header.get("alg"), str) and (bool(parts[2]) or header["alg"].lower() == "none")


def base_spans(text: str) -> list[Span]:
    """(start, end, kind index) of the three base kinds, in code points."""
    out: list[Span] = []
    if ASSIGN_HINT.search(text):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return out


class Run:
    """Joined lines of one alphabet, of 6 or 4 bits a character, with their places in the text."""

    def __init__(self, text: str, start: int, end: int, bits: int):
        self.text, self.bits, pieces, at = text, bits, [], start
        for m in BREAKS.finditer(text, start, end):
            pieces.append((at, m.start()))
            at = m.end()
        pieces.append((at, end))
        self.chars = "".join(text[a:b] for a, b in pieces)
        self.pieces, self.offsets = pieces, [0]
        for a, b in pieces:
            self.offsets.append(self.offsets[-1] + b - a)

    def place(self, k: int) -> int:
        """Where character ``k`` stands in the text."""
        i = bisect_right(self.offsets, k) - 1
        return self.pieces[i][0] + k - self.offsets[i]

    def size(self, n: int) -> int:
        """Characters of ``n`` bytes."""
        return -(-n * 8 // self.bits)

    def held(self, s: int) -> int:
        """Whole bytes from character ``s`` to the end."""
        return (len(self.chars) - s) * self.bits // 8

    def take(self, s: int, at: int, n: int) -> bytes:
        """``n`` bytes, or what there is, from byte ``at`` of what starts at character ``s``."""
        n = max(0, min(n, self.held(s) - at))
        if self.bits == 4:
            return bytes.fromhex(self.chars[s + 2 * at : s + 2 * (at + n)])
        return (unbase64(self.chars[s + at // 3 * 4 : s + self.size(at + n)]) or b"")[at % 3 : at % 3 + n]

    def end(self, s: int, n: int, anywhere: bool = False) -> int | None:
        """Where ``n`` bytes from character ``s`` end in the text, with padding; None if the run goes on, unless ``anywhere``."""
        k = s + self.size(n)
        if k > len(self.chars):
            return None
        at = self.place(k - 1) + 1
        if self.bits == 4:
            return None if k < len(self.chars) and k not in self.offsets else at
        for _ in range(-n % 3):
            if pad := re.compile(f"{BREAK}?=").match(self.text, at):
                at = pad.end()
        after = self.text[at : at + 1]
        if anywhere or not re.match("[A-Za-z0-9+/_=-]", after):
            return at
        # A character of the other base64 alphabet does not belong to the key.
        return at if after in "+/-_" and after in ("+/" if re.search("[-_]", self.chars[s:k]) else "-_") else None


def der_end(run: Run, s: int) -> int | None:
    head = run.take(s, 0, 6)
    if len(head) < 6 or head[0] != 0x30:
        return None
    k = head[1] & 0x7F if head[1] & 0x80 else 0
    if k > 4:
        return None
    n = 2 + k + (int.from_bytes(head[2 : 2 + k]) if k else head[1])
    if run.size(n) < LEAST[run.bits] or n > run.held(s):
        return None
    end = run.end(s, n)
    return end if end is not None and der_ok(run.take(s, 0, n)) else None


def ssh_end(run: Run, s: int) -> int | None:
    """The end of the last field with which the run can end, or of the private container."""

    def field(at: int) -> int | None:
        head = run.take(s, at, 4)
        after = at + 4 + int.from_bytes(head)
        return after if len(head) == 4 and after <= run.held(s) else None

    def value(at: int) -> bytes:
        return run.take(s, at + 4, (field(at) or at + 4) - at - 4)

    if run.take(s, 0, len(CONTAINER)) == CONTAINER:
        # cipher, derivation, its options, number of keys, that many public keys, the private part in whole blocks
        at: int | None = len(CONTAINER)
        for name in (True, True, False):
            if at is None or field(at) is None or (name and not CIPHER.fullmatch(value(at))):
                return None
            at = field(at)
        keys, at = int.from_bytes(run.take(s, at, 4)), at + 4
        while keys > 0 and at is not None:
            inner = value(at)
            if not SSH_TYPE.match(inner[4 : 4 + int.from_bytes(inner[:4])]):
                return None
            at, keys = field(at), keys - 1
        after = field(at) if at is not None else None
        return run.end(s, after, anywhere=True) if after and after - at - 4 >= 16 and (after - at - 4) % 8 == 0 else None
    at = field(0)
    if at is None or at > 64 or not SSH_TYPE.match(run.take(s, 4, at - 4)):
        return None
    best = None
    while (at := field(at)) is not None:
        end = run.end(s, at)
        best = end if end is not None and run.size(at) >= LEAST[run.bits] else best
    return best


def pem_end(run: Run, s: int) -> tuple[int, int] | None:
    """(end, kind index) of base64 of a PEM text that holds a key."""
    inner = run.take(s, 0, run.held(s)).decode("latin-1")
    keys = sorted((b, k) for _, b, k in confirmed_spans(inner) if k != 5)
    if not keys:
        return None
    last = keys[-1][0]
    mark = PEM_END.search(inner, last)
    return run.end(s, mark.end() if mark else last, anywhere=True), keys[0][1]


def _searcher(alphabet: str, starts: str) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """Patterns of a start in a text, where a line may end in it, of a run, and of a start in a joined run."""
    loose = "|".join(f"{BREAK}?".join(re.findall(r"\[.*?\]|\w", one)) for one in starts.split("|"))
    return re.compile(loose), re.compile(rf"[{alphabet}]++(?:{BREAK}[{alphabet}]++)*+"), re.compile(starts)


SEARCH = {6: _searcher("A-Za-z0-9+/_-", STARTS), 4: _searcher("0-9A-Fa-f", "30|000000")}


def encoded_spans(text: str, bits: int) -> Iterator[Span]:
    """Keys in base64 (6 bits a character) or hex (4)."""
    loose, whole, strict = SEARCH[bits]
    at = 0
    while m := loose.search(text, at):
        at = whole.match(text, m.start()).end()
        if at - m.start() < LEAST[bits]:
            continue
        run, k, tried = Run(text, m.start(), at, bits), 0, set()
        while len(run.chars) - k >= LEAST[bits] and (start := strict.search(run.chars, k)):
            s = k = start.start()
            end, kind = None, 3
            if start[0].startswith("LS0t"):
                # What failed once from an alignment holds no key further on either.
                if s % 4 not in tried and (found := pem_end(run, s)):
                    end, kind = found
                tried.add(s % 4)
            elif start[0] == "30" or start[0][0] == "M":
                end = der_end(run, s)
            else:
                end, kind = ssh_end(run, s), 4
            if end is None:
                k += 1
                continue
            yield run.place(s), end, kind
            tried.clear()
            while k < len(run.chars) and run.place(k) < end:
                k += 1


def confirmed_spans(text: str) -> list[Span]:
    """Candidates that decode to a key or signed token."""
    out: list[Span] = [*encoded_spans(text, 6), *encoded_spans(text, 4)]
    if "eyJ" in text or ".ey" in text:
        out += [(m.start(), m.end(), 5) for m in JWT.finditer(text) if jwt_ok(m[0])]
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def scan_text(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans and confirmed spans of one text; null and empty have none."""
    text = text or ""
    return base_spans(text), confirmed_spans(text)


SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_confirmed bigint"


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts, digest of the base spans, and all spans.

    No shuffle and no state between rows.  A null doc_id stays null, repeated
    rows give repeated results, and other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                base, more = scan_text(text.as_py())
                counts = [sum(k == j for _, _, k in base) for j in range(3)]
                rows.append((doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)))
            columns = zip(*rows, strict=True) if rows else [()] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"])

    return docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text").mapInArrow(run, SCHEMA)
