"""Secrets in texts: patterns, and candidates confirmed by decoding and parsing them."""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base kinds in their order, their patterns and least lengths.
BASE_KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 18
HEX = re.compile(r"[0-9a-f]{16,}")  # a longest run of 16 or more is a longest run that isn't too short
#: Kinds that are reported only once their structure has been parsed.
PARSED_KINDS = ("jwt", "rsa_key", "pkcs8_key", "ec_key", "openssh_key", "dsa_key", "encrypted_key")
#: How the identifiers of password-based encryption begin: those of PKCS #5 and of PKCS #12.
ENCRYPTION = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
#: A run of base64 and, after line breaks, its further lines.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{24,}(?:(?:\r?\n|\\n)[A-Za-z0-9+/_-]+)*")
#: One stretch of base64, what may part two stretches of one key (blanks, line breaks, also escaped
#: ones, and the backslash of an escaped slash), and what mustn't follow on a key.
STRETCH = re.compile(r"[A-Za-z0-9+/_-]+")
BREAK = re.compile(r"(?:\s|\\+[rn]|\\+(?=/))+")
GOES_ON = re.compile(r"-?[A-Za-z0-9+/_]")
PADDING = re.compile(r"={0,2}")
#: How a key begins in base64, wherever it stands: tag 0x30, a short or long length and a version of
#: 0 or 1, or the algorithm of an encrypted key; or the magic of an OpenSSH container.
KEY_START = re.compile(
    r"M(?:[A-H]~CAQ[AE]|I(?:[GH]~AgE[AB]|[I-L]~~[AQgw]IBA|[M-P]~~~~CAQ[AE]|[Q-T]~~~~~AgE[AB]"
    r"|[GH]~M[A-H]~GC[Si]qGSIb3DQE|[I-L]~~[DTjz][AB]~Bg[ko]qhkiG9w0B|[M-P]~~~~w~[AQgw]Y[JK]KoZIhvcNAQ))"
    r"|b3BlbnNzaC1rZXktdjEA".replace("~", r"(?:[A-Za-z0-9+_-]|\\*/)")
)
HEX_ANY = re.compile(r"(?:[0-9a-f]{2}){24,}|(?:[0-9A-F]{2}){24,}")
TOKEN = re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
OPENSSH = b"openssh-key-v1\0"
MARK = "[secret]"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, order of kind, end) of the base kinds, leftmost and without overlap in a kind."""
    spans = []
    if ("=" in text or ":" in text) and any(w in low for low in (text.lower(),) for w in ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the content of the DER element at ``at``; None if it doesn't fit."""
    if at + 2 > end:
        return None
    tag, size, start = data[at], data[at + 1], at + 2
    if size & 0x80:
        width = size & 0x7F
        if not 1 <= width <= 4 or start + width > end or data[start] == 0:
            return None
        size, start = int.from_bytes(data[start : start + width], "big"), start + width
        if size < 0x80:  # the short form was due
            return None
    return (tag, start, start + size) if start + size <= end else None


def elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """All elements between ``at`` and ``end``, which they must fill exactly."""
    out = []
    while at < end:
        found = element(data, at, end)
        if found is None:
            return None
        out.append(found)
        at = found[2]
    return out


def der_key(data: bytes) -> str | None:
    """Kind of a private key in DER: an outer sequence whose nested lengths all fit."""
    outer = element(data, 0, len(data))
    if outer is None or outer[0] != 0x30 or outer[2] != len(data):
        return None
    parts = elements(data, outer[1], outer[2])
    if not parts:
        return None
    if [p[0] for p in parts] == [0x30, 0x04]:
        algorithm = elements(data, parts[0][1], parts[0][2])
        known = algorithm and algorithm[0][0] == 0x06 and data[algorithm[0][1] : algorithm[0][2]].startswith(ENCRYPTION)
        return "encrypted_key" if known else None  # algorithm of the encryption, encrypted key
    if parts[0][0] != 0x02 or parts[0][2] - parts[0][1] != 1:
        return None
    version, tags = data[parts[0][1]], [p[0] for p in parts]
    if version in (0, 1) and len(parts) >= 9 and set(tags[:9]) == {0x02}:
        return "rsa_key"  # version, modulus, exponents, primes, and what follows from them
    if version == 0 and tags == [0x02] * 6:
        return "dsa_key"  # version, prime, order, generator, public and private number
    if version == 1 and tags[1:2] == [0x04] and set(tags[2:]) <= {0xA0, 0xA1}:
        return "ec_key"  # version, scalar, then curve and public point
    if version in (0, 1) and tags[1:3] == [0x30, 0x04]:
        algorithm = elements(data, parts[1][1], parts[1][2])
        if algorithm and algorithm[0][0] == 0x06:
            return "pkcs8_key"  # version, algorithm identifier, wrapped key
    return None


def openssh_key(data: bytes) -> str | None:
    """A private key container: magic, then length-prefixed fields that fit."""
    if not data.startswith(OPENSSH):
        return None
    at = len(OPENSSH)
    for _ in range(3):  # cipher, key derivation and its options
        if at + 4 > len(data):
            return None
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    if at + 4 > len(data) or not 1 <= int.from_bytes(data[at : at + 4], "big") <= 16:
        return None
    return "openssh_key"


def unwrapped(text: str, at: int, size: int) -> tuple[bytes, int]:
    """The first ``size`` bytes, or fewer, of the base64 that starts at ``at``, and where they end."""
    chars, parts = -(-size * 4 // 3), []
    while m := STRETCH.match(text, at, at + chars):
        parts.append(m[0])
        at, chars = m.end(), chars - len(m[0])
        gap = BREAK.match(text, at) if chars else None
        if gap is None or not STRETCH.match(text, gap.end()):
            break
        at = gap.end()
    plain = "".join(parts)
    return (decoded(plain[: len(plain) - (len(plain) % 4 == 1)]) or b"")[:size], at


def wrapped_der_key(text: str, at: int) -> tuple[str, int] | None:
    """Kind and end of the DER key in base64 at ``at``: as long as its outer length says, and no more."""
    head, _ = unwrapped(text, at, 16)
    width = head[1] & 0x7F if len(head) > 1 and head[1] & 0x80 else 0
    size = 2 + width + (int.from_bytes(head[2 : 2 + width], "big") if width else head[1] if len(head) > 1 else 0)
    version = 2 + width
    if len(head) < version + 4 or (head[version] != 0x30 and head[version + 3] not in (0x02, 0x04, 0x30)) or size > len(text) - at:
        return None
    data, end = unwrapped(text, at, size)
    kind = der_key(data) if len(data) == size else None
    if kind is None or GOES_ON.match(text, end):
        return None
    return kind, PADDING.match(text, end).end()


def wrapped_openssh_key(text: str, at: int) -> tuple[str, int] | None:
    """Kind and end of the OpenSSH container in base64 at ``at``; one that is cut off ends with its lines."""
    size, fields, seen = len(OPENSSH), 3, 0
    while seen < fields:
        data, _ = unwrapped(text, at, size + 4)
        if len(data) < size + 4 or size > len(text) - at:
            break
        number = int.from_bytes(data[size:], "big")
        size, seen = size + 4, seen + 1
        if fields == 3 and seen == 3:  # the options are followed by the number of public keys
            size += number
            data, _ = unwrapped(text, at, size + 4) if size < len(text) - at else (b"", at)
            if len(data) < size + 4 or not 1 <= int.from_bytes(data[size:], "big") <= 16:
                return None
            fields += int.from_bytes(data[size:], "big") + 1  # public keys, then the private part
            size += 4
        else:
            size += number
    if fields == 3:
        return None
    if seen == fields and size <= len(text) - at:
        data, end = unwrapped(text, at, size)
        if len(data) == size:
            return "openssh_key", PADDING.match(text, end).end()
    closing = text.find("-----", at)
    run = BASE64.match(text, at, closing if closing >= 0 else len(text))
    return ("openssh_key", PADDING.match(text, run.end()).end()) if run else None


def decoded(candidate: str) -> bytes | None:
    """Bytes of base64 in either alphabet, with or without line breaks and padding."""
    plain = re.sub(r"\r?\n|\\n|=", "", candidate).replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def signed_token(candidate: str) -> bool:
    """Header and claims of a signed token are JSON objects and the header names an algorithm."""
    header, claims, _ = candidate.split(".")
    parsed = []
    for part in (header, claims):
        try:
            parsed.append(json.loads((decoded(part) or b"").decode()))
        except (UnicodeDecodeError, ValueError, RecursionError):
            return False
    return all(isinstance(p, dict) for p in parsed) and isinstance(parsed[0].get("alg"), str)


def parsed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, order of kind, end) of candidates whose decoded bytes have the structure of a secret.

    Keys in base64 start anywhere, also after an escaped line break, may be broken into lines, and
    end where their own lengths say, so it doesn't matter what follows or whether they are padded.
    """
    spans, first = [], len(BASE_KINDS)
    if "eyJ" in text:
        for m in TOKEN.finditer(text):
            if signed_token(m[0]):
                spans.append((m.start(), first, m.end()))
    at = 0
    while m := KEY_START.search(text, at):
        found = (wrapped_der_key if m[0][0] == "M" else wrapped_openssh_key)(text, m.start())
        at = found[1] if found else m.start() + 1
        if found:
            spans.append((m.start(), first + PARSED_KINDS.index(found[0]), at))
    for m in HEX_ANY.finditer(text):
        if m[0].startswith(("30", "6f")):
            kind = der_key(bytes.fromhex(m[0])) or openssh_key(bytes.fromhex(m[0]))
            if kind:
                spans.append((m.start(), first + PARSED_KINDS.index(kind), m.end()))
    return spans


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = BASE_KINDS + PARSED_KINDS
    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            spans = sorted(base_spans(text) + parsed_spans(text)) if text else []
            rows.append([{"kind": kinds[k], "start": s, "end": e} for s, k, e in spans])
        columns = [batch.column(c) for c in batch.schema.names]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, shape)], [*batch.schema.names, "spans"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """Find secrets in every text.

    The columns of ``docs`` (with text) come back and spans array<struct<kind, start, end>>, which
    ``docs`` must not have, in code points, by start and then in the order of the kinds.  Base kinds: assignments to names like ``token``, access ids, runs of
    hex digits.  Further kinds come only from candidates that parse: base64 or hex is decoded, the
    nested lengths of key encodings must fit exactly, signed tokens need JSON headers.

    A null text has no spans; rows may repeat; an empty table gives no rows.  Each text is scanned
    whole by the task that reads it; nothing is shuffled.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(
        scan_batches, f"{fields}, spans array<struct<kind: string, start: long, end: long>>"
    )


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def is_base(span: Column) -> Column:
    return span["kind"].isin(*BASE_KINDS)


def covered(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every stretch covered by ``spans``, in order, replaced by one mark."""
    parts, at = [], 0
    for start, _, end in spans:
        if start >= at:
            parts += [text[at:start], MARK]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def mask_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t and covered(t, sorted(base_spans(t) + parsed_spans(t))) for t in batch.column("text").to_pylist()]
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, "text", pa.array(texts, batch.schema.field(at).type))


def mask_secrets(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, in which the secrets of ``find_secrets`` are masked in ``text``.

    Every row and column comes back; null and empty texts stay as they are; rows may repeat; an
    empty table gives no rows.  The work of a text grows with its length, however many spans it has.
    """
    return docs.mapInArrow(mask_batches, docs.schema)
