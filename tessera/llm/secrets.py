"""Secret scanning with structural confirmation.

Plain patterns give the base spans (assignments, access ids, long hex runs). On top of them, runs of base64
or hex are decoded and reported only when what they hold parses: DER private keys, plain or encrypted, whose nested
lengths fit to the byte; OpenSSH private keys with their length-prefixed fields; armoured keys around either, or
around a body that header lines say is encrypted, with a fitting length; keys wrapped over lines without armour; signed
tokens whose header and payload are JSON objects; encrypted tokens whose five parts have the lengths that their header
asks for; and encoded text that itself holds any of these, an assignment or an access id, however often it was encoded
(each time, it is shorter by a quarter at least).

Offsets are code points, ends exclusive. Null and empty texts have no spans. Spans of different kinds may
overlap; repeated rows are scanned each for itself; other columns are kept.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .arrow import map_columns, quoted

BASE = ("assign", "access", "hex")
#: All kinds in the order in which spans that start together are listed.
KINDS = (*BASE, "armoured_key", "der_key", "openssh_key", "signed_token", "encrypted_token", "encoded_secret")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
WORDS = ("passw", "secret", "token", "key")

#: A header that begins with a brace, then two or four more parts.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(e[yw][A-Za-z0-9_-]++)\.([A-Za-z0-9_-]*+)\.([A-Za-z0-9_-]*+)(?:\.([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]++))?")
EDGE = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*PRIVATE KEY)-----")
#: Line ends, also as they are written in strings.
LINE_END = re.compile(r"(?:\\[rn]|[\r\n])+[ \t]*")
HEADER_LINE = re.compile(r"([A-Za-z][A-Za-z0-9-]*): *(.*)")
RUN = re.compile(r"[A-Za-z0-9+/_-]{24,}+={0,2}+")
HEX_RUN = re.compile(r"[0-9A-Fa-f]+")
BASE64 = re.compile(r"[A-Za-z0-9+/]+={0,2}")
#: How the base64 of a DER sequence and of an OpenSSH key begins, and the shortest line of a wrapped one.
KEY_START = re.compile(r"M[A-P]|b3BlbnNzaC1rZXktdjE")
LEAST_LINE = 32
#: The shortest encoded key or text that can be confirmed, in bytes.
LEAST = 16


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def decoded(run: str) -> bytes | None:
    """What a run of hex or of either base64 alphabet stands for."""
    if len(run) % 2 == 0 and HEX_RUN.fullmatch(run):
        return bytes.fromhex(run)
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the contents of the DER element at a place, if it fits before ``end``."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n >= 128:
        width = n & 127
        if not 1 <= width <= 4 or at + width > end:
            return None
        n = int.from_bytes(data[at : at + width], "big")
        at += width
        if n < 128:
            return None
    return (tag, at, at + n) if at + n <= end else None


def elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill a stretch exactly."""
    out = []
    while at < end:
        one = element(data, at, end)
        if one is None:
            return None
        out.append(one)
        at = one[2]
    return out


INTEGER, OCTETS, OBJECT_ID, SEQUENCE = 0x02, 0x04, 0x06, 0x30
#: Object ids of password-based encryption begin so (fixed values of PKCS 5 and 12).
PASSWORD_BASED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def is_der_key(data: bytes) -> bool:
    """RSA, EC, wrapped or encrypted private keys, told by the elements of the outer sequence."""
    outer = element(data, 0, len(data))
    if outer is None or outer[0] != SEQUENCE or outer[2] != len(data):
        return False
    parts = elements(data, outer[1], outer[2])
    if parts and [x[0] for x in parts] == [SEQUENCE, OCTETS]:
        inside = elements(data, parts[0][1], parts[0][2])
        return bool(inside) and inside[0][0] == OBJECT_ID and data[inside[0][1] : inside[0][2]].startswith(PASSWORD_BASED) and parts[1][2] - parts[1][1] >= LEAST
    if not parts or parts[0][0] != INTEGER or parts[0][2] - parts[0][1] != 1:
        return False
    version, tags = data[parts[0][1]], [x[0] for x in parts]
    if tags[1:] == [INTEGER] * 8 and version == 0:
        numbers = [int.from_bytes(data[a:b], "big") for _, a, b in parts[1:]]
        return numbers[0] == numbers[3] * numbers[4] > 0
    if tags[1:2] == [OCTETS] and version == 1:
        return parts[1][2] - parts[1][1] >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:])
    if tags[1:3] == [SEQUENCE, OCTETS] and version in (0, 1):
        inside = elements(data, parts[1][1], parts[1][2])
        return bool(inside) and inside[0][0] == OBJECT_ID
    return False


MAGIC = b"openssh-key-v1\0"


def is_openssh_key(data: bytes) -> bool:
    """The magic, then cipher, key derivation, its options, a count, public keys and the private part, to the last byte."""
    if not data.startswith(MAGIC):
        return False
    at = len(MAGIC)

    def string() -> bytes | None:
        nonlocal at
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n : at]

    if any(string() is None for _ in range(3)) or at + 4 > len(data):
        return False
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    return 1 <= keys <= 64 and all(string() is not None for _ in range(keys + 1)) and at == len(data)


def json_object(part: str) -> dict | None:
    data = decoded(part) if not HEX_RUN.fullmatch(part) else None
    try:
        value = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def url_decoded(part: str) -> bytes | None:
    try:
        return base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)) if len(part) % 4 != 1 else None
    except (binascii.Error, ValueError):
        return None


def token_parts(parts: tuple[str | None, ...]) -> int:
    """Of how many parts a token consists: three where it is signed, five where it is encrypted, none where it is no token."""
    head = json_object(parts[0])
    if head is None or not isinstance(head.get("alg"), str):
        return 0
    if "enc" in head:
        # An encrypted key, unless the key is agreed on otherwise; a nonce, the text, and a tag.
        key, nonce, text, tag = (None if x is None else url_decoded(x) for x in parts[1:])
        keyed = key is not None and (len(key) >= 16 or not key and head["alg"] in ("dir", "ECDH-ES"))
        whole = isinstance(head["enc"], str) and keyed and nonce is not None and len(nonce) in (12, 16) and bool(text) and tag is not None and len(tag) in (16, 24, 32)
        return 5 if whole else 0
    signed = bool(parts[2]) and url_decoded(parts[2]) is not None or head["alg"].lower() == "none"
    return 3 if parts[1] and json_object(parts[1]) is not None and signed else 0


def is_printable(s: str) -> bool:
    return s.isprintable() or all(" " <= c <= "~" or c in "\t\r\n" for c in s)


def encoded_kind(run: str) -> str | None:
    """What a run is confirmed to be."""
    data = decoded(run)
    if data is None or len(data) < LEAST:
        return None
    if data[0] == SEQUENCE and is_der_key(data):
        return "der_key"
    if is_openssh_key(data):
        return "openssh_key"
    if not data.isascii():
        return None
    inner = data.decode("ascii")
    if is_printable(inner) and (any(kind != "hex" for kind, _, _ in base_spans(inner)) or structural_spans(inner)):
        return "encoded_secret"
    return None


def is_armoured_key(body: str) -> bool:
    """Whether the text between the lines of an armour is a key: header lines, if any, and base64."""
    lines = [x.strip().strip("\"'") for x in LINE_END.split(body)]
    headers = {m[1].lower(): m[2] for x in lines if (m := HEADER_LINE.fullmatch(x))}
    joined = "".join("".join(x.split()) for x in lines if not HEADER_LINE.fullmatch(x))
    data = decoded(joined) if BASE64.fullmatch(joined) else None
    if data is None:
        return False
    cipher, _, start = headers.get("dek-info", "").partition(",")
    if "encrypted" in headers.get("proc-type", "").lower() and cipher:
        # The start value is as long as a block, and the body is whole blocks.
        block = len(start.strip()) // 2
        return bool(HEX_RUN.fullmatch(start.strip())) and block in (8, 16) and len(data) >= LEAST and len(data) % block == 0
    return is_der_key(data) or is_openssh_key(data)


def armoured_spans(text: str) -> list[tuple[str, int, int]]:
    out, begun = [], None
    for m in EDGE.finditer(text):
        if m[1] == "BEGIN":
            begun = m
        elif begun and begun[2] == m[2] and is_armoured_key(text[begun.end() : m.start()]):
            out.append(("armoured_key", begun.start(), m.end()))
            begun = None
    return out


def wrapped_key(text: str, runs: list[re.Match], k: int) -> tuple[str, int, int] | None:
    """(kind, end, runs used) of a key that begins with a run and goes on over lines of equal length, the last one excepted.

    A DER key says itself how long it is; an OpenSSH key is tried with all such lines.
    """
    first = runs[k]
    width, need = len(first[0]), 0
    if width < LEAST_LINE or width % 4 or not KEY_START.match(first[0]):
        return None
    if first[0][0] == "M":
        outer = element(decoded(first[0][:16]) + bytes(4), 0, 1 << 40)
        need = -(-outer[2] // 3) * 4 if outer else 0
        if need <= width:
            return None
    parts, at, end = [first[0]], first.end(), first.end()
    size, used = width, 1
    while len(parts[-1]) == width and (not need or size < need) and (m := LINE_END.match(text, at)):
        line = BASE64.match(text, m.end())
        if not line or len(line[0]) > width:
            break
        parts.append(line[0])
        size, at = size + len(line[0]), line.end()
        end = at
        while k + used < len(runs) and runs[k + used].start() < end:
            used += 1
    data = decoded("".join(parts)) if len(parts) > 1 and (not need or size == need) else None
    if data is None:
        return None
    kind = "der_key" if is_der_key(data) else "openssh_key" if is_openssh_key(data) else None
    return (kind, end, used) if kind else None


def structural_spans(text: str) -> list[tuple[str, int, int]]:
    found = armoured_spans(text) if "PRIVATE KEY-----" in text else []
    at = 0
    while m := TOKEN.search(text, at):
        n = token_parts(m.groups())
        if n:
            found.append(("signed_token" if n == 3 else "encrypted_token", m.start(), m.end(n)))
        at = m.end(n) if n else m.end(1)
    taken = sorted((a, b) for _, a, b in found)
    runs = list(RUN.finditer(text))
    passed, k = 0, 0
    while k < len(runs):
        m, used = runs[k], 1
        while passed < len(taken) and taken[passed][1] <= m.start():
            passed += 1
        if passed == len(taken) or taken[passed][0] >= m.end():
            if got := wrapped_key(text, runs, k):
                found.append((got[0], m.start(), got[1]))
                used = got[2]
            elif kind := encoded_kind(m[0]):
                found.append((kind, m.start(), m.end()))
        k += used
    return found


def secret_spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans by start, then kind."""
    if not text:
        return []
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(base_spans(text) + structural_spans(text), key=lambda x: (x[1], order[x[0]], x[2]))


SPAN = StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])


def span_rows(spans: list[tuple[str, int, int]]) -> list[dict]:
    return [{"kind": k, "start": a, "end": b} for k, a, b in spans]


def find_secrets(df: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """Adds an array of (kind, start, end)."""
    return map_columns(df, [text], StructType([StructField(out, ArrayType(SPAN))]), lambda _, texts: [(span_rows(secret_spans(x)),) for x in texts])


#: What stands in place of a secret.
MASK = "[secret]"


def masked(text: str | None) -> str | None:
    """The text with each stretch that spans cover, however many, replaced by one mask; null stays null."""
    out, at = [], 0
    for _, a, b in sorted(secret_spans(text), key=lambda x: x[1:]):
        if a >= at:
            out += [text[at:a], MASK]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def mask_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """Replaces the text column by the masked text."""
    return map_columns(df, [text], StructType([StructField(text, StringType())]), lambda _, texts: [(masked(x),) for x in texts])


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def with_digests(df: DataFrame, spans: str, base: tuple[str, ...]) -> DataFrame:
    """Replaces spans, which are sorted, by counts of the base kinds, their digest, all spans spelled out and their number.

    These replace columns of their names.
    """
    c = quoted(df, spans)

    def count(kind: str) -> Column:
        return F.size(F.filter(c, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    digest = F.sha2(spelled(F.filter(c, lambda s: s["kind"].isin(*base))).cast("binary"), 256)
    made = [*map(count, base), digest.alias("base_sha256"), spelled(c).alias("spans"), F.size(c).cast("long").alias("n_spans")]
    taken = {spans.lower(), "base_sha256", "spans", "n_spans", *(f"n_{kind}" for kind in base)}
    return df.select(*[quoted(df, x) for x in df.columns if x.lower() not in taken], *made)
