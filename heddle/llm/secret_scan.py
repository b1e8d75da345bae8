"""Secret scan with structural confirmation (operator 11).

Three base rules find assignments of passwords and tokens, access ids and long lower-case hexadecimal runs. The method adds
what only its structure gives away: runs of base64 (either alphabet, wrapped lines included) or hexadecimal digits are
decoded and reported as `key` only if the bytes parse, to the last nested length, as a private key - PKCS#1, PKCS#8 (plain or
encrypted), SEC1, DSA or PKCS#12 in DER, an OpenSSH key blob, OpenPGP secret-key packets, or a JSON web key with its secret
part; dotted triples and quintuples are reported as `token` only if their header is a JSON object whose algorithm fits the
length of the signature (or names a content cipher). Armoured blocks are taken from their first to their last dash. Bytes
that are text again are decoded once more, up to DEPTH times. Public keys, certificates and mere digests are not reported.

Scale. Map only: each text is looked at where it is read, in parts of a batch, and leaves an array of spans. Every rule moves
forward through the text: a candidate costs as much as its own length.

Defined cases: a null or empty text has no spans. Null ids, repeated rows and further columns (of any name) stay as they are;
the column `spans` is added, in place of one of that name. An empty table gives no rows. Case is folded for ASCII letters alone.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from heddle.llm.common import read, text_slices, tidy

#: Kinds of spans in the order in which those of one start are listed (fixed values); the first three are the base rules.
KINDS = ["assign", "access", "hex", "key", "token"]
#: The base rules, fixed values.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more is found whole, shorter ones are dropped
LEAST_SECRET, LEAST_ACCESS = 6, 20
_NAMES = ("passw", "secret", "token", "apikey", "api_key")

#: Candidates: shorter ones hold no private key. Encodings within encodings are followed DEPTH times.
DEPTH, LEAST_RUN = 3, 40
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")  # LEAST_RUN characters, hexadecimal digits likewise
_HEX_BYTES = re.compile(r"(?<![0-9A-Za-z])(?:0[xX])?((?:[0-9a-fA-F]{2}){20,})(?![0-9A-Za-z])")
_DOTTED = re.compile(r"(?<![A-Za-z0-9_.-])ey[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]*){2,4}(?![A-Za-z0-9_-])")
_ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9]+(?: [A-Z0-9]+)*)-----")
_LINE_END = re.compile(r"(?:\r?\n|\\r\\n|\\n)[ \t]*")
_URL_TO_PLAIN = str.maketrans("-_", "+/")
#: Bytes of a signature by algorithm (fixed values); RSA signatures have the size of their modulus.
SIGNATURE_BYTES = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES256K": 64, "ES384": 96, "ES512": 132, "EdDSA": 64, "Ed25519": 64}
RSA_SIGNATURES = {"RS256", "RS384", "RS512", "PS256", "PS384", "PS512"}
RSA_BYTES = range(128, 2049)

_INTEGER, _OCTETS, _OID, _SEQUENCE = 0x02, 0x04, 0x06, 0x30
#: OID of PKCS#7 data and signed data, with which the content of PKCS#12 begins (fixed values).
_PKCS7 = (bytes.fromhex("2a864886f70d010701"), bytes.fromhex("2a864886f70d010702"))


def der_length(b: bytes) -> int:
    """Size of the element that b begins with, header included; 0 if b begins with none that has a minimal, definite length of at most two bytes."""
    if len(b) < 2:
        return 0
    if b[1] < 0x80:
        return 2 + b[1]
    if b[1] == 0x81 and len(b) > 2 and b[2] >= 0x80:
        return 3 + b[2]
    if b[1] == 0x82 and len(b) > 3 and b[2]:
        return 4 + (b[2] << 8 | b[3])
    return 0


def der_parts(b: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents of the elements that b consists of; None if they do not tile it."""
    out, at = [], 0
    while at < len(b):
        size = der_length(b[at : at + 4])
        if not size or at + size > len(b):
            return None
        head = 2 if b[at + 1] < 0x80 else 2 + (b[at + 1] & 0x7F)
        out.append((b[at], b[at + head : at + size]))
        at += size
    return out


def _algorithm(content: bytes) -> bool:
    parts = der_parts(content)
    return bool(parts) and parts[0][0] == _OID and 3 <= len(parts[0][1]) <= 16 and len(parts) <= 2


def der_private_key(b: bytes) -> bool:
    """Whether b is one DER element and a private key."""
    if not b or b[0] != _SEQUENCE or der_length(b[:4]) != len(b):
        return False
    parts = (der_parts(b) or [(0, b"")])[0][1]
    parts = der_parts(parts)
    if not parts:
        return False
    tags = [t for t, _ in parts]
    if tags == [_SEQUENCE, _OCTETS]:
        return _algorithm(parts[0][1]) and len(parts[1][1]) >= 16
    if tags[0] != _INTEGER or len(parts[0][1]) != 1:
        return False
    version = parts[0][1][0]
    if tags[:9] == [_INTEGER] * 9:
        return version in (0, 1) and len(tags) == 9 + version and len(parts[1][1]) >= 32 and len(parts[3][1]) >= 16
    if tags == [_INTEGER] * 6:
        return version == 0 and all(len(x) >= 8 for _, x in parts[1:])
    if tags[:3] == [_INTEGER, _SEQUENCE, _OCTETS]:
        return version in (0, 1) and _algorithm(parts[1][1]) and all(t in (0xA0, 0x81, 0xA1) for t in tags[3:]) and len(parts[2][1]) >= 16
    if tags[:2] == [_INTEGER, _OCTETS]:
        return version == 1 and 16 <= len(parts[1][1]) <= 80 and all(t in (0xA0, 0xA1) and der_parts(x) for t, x in parts[2:])
    if tags[:2] == [_INTEGER, _SEQUENCE] and version == 3:
        inner = der_parts(parts[1][1])
        return bool(inner) and inner[0][0] == _OID and inner[0][1] in _PKCS7 and tags[2:] in ([], [_SEQUENCE])
    return False


_OPENSSH = b"openssh-key-v1\0"


def openssh_private_key(b: bytes) -> bool:
    """Whether b is an OpenSSH key file: nested strings behind four-byte lengths, to the last byte."""
    at = len(_OPENSSH)
    if not b.startswith(_OPENSSH):
        return False

    def string() -> bytes | None:
        nonlocal at
        size = int.from_bytes(b[at : at + 4], "big")
        at += 4 + size
        return b[at - size : at] if at <= len(b) else None

    if not string() or not string() or string() is None:
        return False
    keys = int.from_bytes(b[at : at + 4], "big")
    at += 4
    for _ in range(keys if 0 < keys < 17 else 0):
        public = string()
        if not public or len(public) < 4 or 4 + int.from_bytes(public[:4], "big") > len(public):
            return False
    return 0 < keys < 17 and bool(string()) and at == len(b)


def pgp_secret_key(b: bytes) -> bool:
    """Whether b is a row of OpenPGP packets that tile it and begin with a secret key."""
    at, first = 0, None
    while at < len(b):
        head = b[at]
        if head < 0x80 or at + 2 > len(b):
            return False
        if head & 0x40:
            tag, n = head & 0x3F, b[at + 1]
            if n < 192:
                size, skip = n, 2
            elif n < 224 and at + 2 < len(b):
                size, skip = (n - 192 << 8) + b[at + 2] + 192, 3
            elif n == 255:
                size, skip = int.from_bytes(b[at + 2 : at + 6], "big"), 6
            else:
                return False
        else:
            tag, kind = head >> 2 & 0xF, head & 3
            if kind == 3:
                return False
            skip = 1 + (1 << kind)
            size = int.from_bytes(b[at + 1 : at + skip], "big")
        if first is None:
            first = tag
            body = b[at + skip : at + skip + 1]
            if tag != 5 or body not in (b"\x03", b"\x04", b"\x05", b"\x06"):
                return False
        at += skip + size
    return first == 5 and at == len(b)


def json_secret(b: bytes) -> bool:
    """Whether b is a JSON web key with its secret part, or a set of them."""
    if b[:1] != b"{":
        return False
    try:
        found = json.loads(b)
    except (ValueError, RecursionError):
        return False
    keys = found.get("keys") if isinstance(found.get("keys"), list) else [found]
    secret = {"RSA": "d", "EC": "d", "OKP": "d", "oct": "k"}
    return any(isinstance(k, dict) and isinstance(k.get("kty"), str) and isinstance(k.get(secret.get(k["kty"], "")), str) for k in keys)


def from_base64(run: str) -> bytes | None:
    """Bytes of a run in either alphabet, with or without padding."""
    plain = run.rstrip("=").translate(_URL_TO_PLAIN)
    if len(plain) % 4 == 1:
        return None
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except binascii.Error:
        return None


def holds_key(b: bytes | None, depth: int = DEPTH) -> bool:
    """Whether bytes are a private key, or text in which one is found."""
    if not b:
        return False
    if der_private_key(b) or openssh_private_key(b) or pgp_secret_key(b) or json_secret(b):
        return True
    return depth > 0 and len(b) >= 24 and b.isascii() and any(k in ("key", "token") for k, _, _ in confirmed(b.decode("ascii"), depth - 1))


def _object(part: str) -> dict | None:
    raw = from_base64(part)
    if not raw or raw[:1] != b"{":
        return None
    try:
        found = json.loads(raw)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def signed_token(run: str) -> bool:
    """Whether dotted parts are a signed or encrypted web token: its header names an algorithm that fits the other parts."""
    parts = run.split(".")
    head = _object(parts[0])
    if not head or not isinstance(head.get("alg"), str):
        return False
    if len(parts) == 5:
        return isinstance(head.get("enc"), str) and all(from_base64(p) for p in parts[2:])
    if len(parts) != 3 or (head.get("b64") is not False and _object(parts[1]) is None):
        return False
    sealed = from_base64(parts[2])
    return bool(sealed) and (len(sealed) in RSA_BYTES if head["alg"] in RSA_SIGNATURES else len(sealed) == SIGNATURE_BYTES.get(head["alg"]))


def _armoured(text: str) -> Iterator[tuple[int, int]]:
    """Armoured private keys: label, headers, base64 that holds a key, and the same label."""
    for m in _ARMOUR.finditer(text):
        tail = f"-----END {m[1]}-----"
        stop = text.find("-----", m.end())
        if "PRIVATE KEY" not in m[1] or stop < 0 or not text.startswith(tail, stop):
            continue
        lines = [x.strip() for x in _LINE_END.split(text[m.end() : stop])]
        body = [x for x in lines if x and ":" not in x]
        sealed = any(x.startswith("Proc-Type:") and "ENCRYPTED" in x for x in lines)
        if m[1].startswith("PGP"):
            body = [x for x in body if not x.startswith("=")]  # its checksum
        raw = from_base64("".join(body))
        if raw and (holds_key(raw, 0) or (sealed and len(raw) >= 16 and len(raw) % 8 == 0)):
            yield m.start(), stop + len(tail)


def _unwrapped(text: str, m: re.Match) -> tuple[str, int]:
    """A base64 run and its end; if its first bytes are a DER header that asks for more, with the lines that follow."""
    run, stop = m[0], m.end()
    size = der_length(from_base64(run[:8]) or b"") if run[0] == "M" else 0
    want = -(-size * 4 // 3)
    while size and len(run) < want and (gap := _LINE_END.match(text, stop)) and (more := _LINE.match(text, gap.end())):
        run, stop = run + more[0], more.end()
    return run, stop


_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")


def confirmed(text: str, depth: int = DEPTH) -> list[tuple[str, int, int]]:
    """Spans whose structure shows a private key or a signed token."""
    out = [("key", a, b) for a, b in _armoured(text)] if "-----BEGIN " in text else []
    if "ey" in text:
        out += [("token", m.start(), m.end()) for m in _DOTTED.finditer(text) if signed_token(m[0])]
    covered = sorted((a, b) for _, a, b in out)
    inside = lambda at: (k := bisect(covered, (at, len(text)))) > 0 and covered[k - 1][1] > at
    done = 0
    for m in _BASE64.finditer(text):
        if m.start() >= done and not inside(m.start()):
            run, stop = _unwrapped(text, m)
            if holds_key(from_base64(run), depth):
                out.append(("key", m.start(), stop))
                done = stop
    found = {a for _, a, _ in out}
    out += [("key", m.start(), m.end()) for m in _HEX_BYTES.finditer(text) if m.start() not in found and not inside(m.start()) and holds_key(bytes.fromhex(m[1]), depth)]
    return out


def base_spans(text: str, longest: int) -> list[tuple[str, int, int]]:
    """Spans of the base rules. longest: length of the text's longest word, so that rules which need a longer one are left out."""
    folded, out = text.lower(), []
    if any(x in folded for x in _NAMES):
        out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_SECRET]
    if longest >= LEAST_ACCESS:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
        out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def spans_of(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) in code points, end exclusive, by start and then by kind."""
    if not text:
        return []
    longest = max(map(len, text.split()), default=0)
    found = base_spans(text, longest)
    if longest >= LEAST_RUN or "-----BEGIN " in text:
        found += confirmed(text)
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


SPAN_TYPE = "array<struct<kind:string,start:long,end:long>>"


def without_spans(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """The text with `mark` in place of its spans; those that overlap or touch give one mark."""
    out, at, last = [], 0, -1
    for _, a, b in spans:
        if a > last:
            out += [text[at:a], mark]
        at = last = max(last, b)
    return "".join(out) + text[at:]


def find_secrets(docs: DataFrame, text_col: str = "text", mark: str | None = None) -> DataFrame:
    """docs with `spans`: array of (kind, start, end). A column of that name in docs gives way.
    mark: the text comes back with this in place of each span; the spans are those of the text as it was."""
    kept = docs.drop("spans")
    schema = StructType([*kept.schema.fields, StructField("spans", _parse_datatype_string(SPAN_TYPE))])
    at = kept.columns.index(text_col)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, batch.column(at)):
                texts, columns = part.column(at).to_pylist(), list(part.columns)
                found = [spans_of(x) for x in texts]
                if mark is not None:
                    columns[at] = pa.array([without_spans(x, s, mark) if s else x for x, s in zip(texts, found, strict=True)], columns[at].type)
                rows = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in found], kind)
                yield pa.RecordBatch.from_arrays([*columns, rows], names=schema.names)

    return kept.mapInArrow(tidy(scan), schema)


def _listed(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op11_structural_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(KINDS[:3]))
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), n("key"), n("token"))
