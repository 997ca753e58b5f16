"""Secrets in texts: pattern kinds, and candidates confirmed by their structure.

Pattern kinds are reported as they match. Structural kinds are reported only after decoding: a base64 or hex candidate
must hold a complete key encoding whose nested lengths add up (DER, SSH), a PEM block must decode to one, and a signed
token must begin with a JSON header that names an algorithm. A key's own length says how many characters of base64 belong to
it, so it is found behind a path, before other text and wrapped into lines; a PEM block is also found inside base64.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenloom.llm.scan import pieces

KINDS = ["assign", "access", "hex", "jwt", "pem", "der", "ssh"]

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]*+){2,}+")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,40})-----([A-Za-z0-9+/=\s\\]*)-----END \1-----")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
_RUN = re.compile(r"[A-Za-z0-9+/_-]*")
_BREAK = re.compile(r"""[\x20\t"']*(?:\r?\n|\\r\\n|\\n)[\x20\t"']*(?=[A-Za-z0-9+/_-])""")
# Where base64 of a DER sequence can begin: its tag and length fix the first two characters. Also behind a path or a mark.
_DER_START = re.compile(r"(?<![A-Za-z0-9])(?=M[A-P][A-Za-z0-9+/_-]{14})")
_SSH_START = re.compile(r"b3BlbnNzaC1rZXktdjEA")
_PEM_START = re.compile(r"LS0tLS1CRUdJTi")
_HEX_ANY = re.compile(r"(?<![0-9A-Za-z])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Za-z])")
# Texts without any of these hold nothing: one pass of a linear-time matcher over a whole batch.
_MAYBE = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{12}|[0-9a-f]{32}|"""
    r"""[0-9A-Fa-f]{64}|e[wy][A-Za-z0-9_-]+\.|-----BEGIN|M[A-P][A-Za-z0-9+/_-]{14}|[A-Za-z0-9+/_-]{40}"""
)
KEY_BYTES = 1 << 16  # no key encoding is longer
_SSH_NAMES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-", b"sk-ssh-", b"sk-ecdsa-")


def _der_items(data: bytes, at: int, end: int, depth: int = 0) -> list[tuple[int, int, int]] | None:
    """(tag, begin, end) of the values that fill ``data[at:end]`` exactly, checking nested ones; None if they don't."""
    items = []
    while at < end:
        if at + 2 > end or depth > 12:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            count = size & 0x7F
            if not 1 <= count <= 4 or at + count > end:
                return None
            size = int.from_bytes(data[at : at + count], "big")
            at += count
        if at + size > end:
            return None
        if tag & 0x20 and _der_items(data, at, at + size, depth + 1) is None:
            return None
        items.append((tag, at, at + size))
        at += size
    return items


def is_der_key(data: bytes) -> bool:
    """A sequence that is a private key (leading version number) or a public key (algorithm and bit string)."""
    outer = _der_items(data, 0, len(data)) if data[:1] == b"\x30" else None
    if not outer or len(outer) != 1:
        return False
    inner = _der_items(data, outer[0][1], outer[0][2]) or []
    tags, sizes = [t for t, _, _ in inner], [end - begin for _, begin, end in inner]
    private = len(tags) >= 3 and tags[0] == 0x02 and tags[1] in (0x02, 0x04, 0x30)
    modulus = tags == [0x02, 0x02] and sizes[0] >= 64 and sizes[1] <= 8  # two numbers alike are a signature
    return private or modulus or tags == [0x30, 0x03]


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private key, or a public key blob whose length-prefixed parts fill it."""
    magic = b"openssh-key-v1\0"
    private = data.startswith(magic)
    at, parts = (len(magic), []) if private else (0, [])
    while at + 4 <= len(data) and len(parts) < (3 if private else 64):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return False
        parts.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    if private:
        return len(parts) == 3 and at + 4 <= len(data) and 1 <= int.from_bytes(data[at : at + 4], "big") <= 64
    return at == len(data) and len(parts) >= 2 and parts[0].startswith(_SSH_NAMES)


def _base64(text: str) -> bytes:
    plain = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(plain) % 4 == 1:
        return b""
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except binascii.Error:
        return b""


def _json_object(text: str) -> dict | None:
    try:
        value = json.loads(_base64(text))
    except (ValueError, RecursionError):  # also of bytes that are no text, and of nesting beyond any real header
        return None
    return value if isinstance(value, dict) else None


def is_signed_token(text: str) -> bool:
    """Header and payload are JSON objects, and the header names an algorithm."""
    header, payload = (_json_object(part) for part in text.split(".")[:2])
    return header is not None and isinstance(header.get("alg"), str) and payload is not None


def _signed_tokens(text: str) -> Iterator[tuple[str, int, int]]:
    """Three parts in a row of a dotted run; a header may follow a mark or letters that belong to no token. Each part is
    decoded a fixed number of times, so the search is linear."""
    for m in _DOTTED.finditer(text):
        ends, at = [], m.start()
        for part in m[0].split("."):
            ends.append((at, at + len(part)))
            at += len(part) + 1
        k = 0
        while k + 2 < len(ends):
            (begin, end), (_, close), (_, last) = ends[k : k + 3]
            mark = max(text.rfind("-", begin, end), text.rfind("_", begin, end)) + 1
            starts = {begin, text.find("eyJ", begin, end), max(mark, begin)}
            good = [s for s in sorted(starts) if s >= begin and text[s : s + 2] in ("ey", "ew") and is_signed_token(text[s:close])]
            if good:
                yield "jwt", good[0], last
            k += 3 if good else 1


def _gather(text: str, at: int, most: int) -> tuple[str, int]:
    """Up to ``most`` base64 characters from ``at`` on, over line breaks, and where they end."""
    parts, size = [], 0
    while True:
        end = _RUN.match(text, at, at + most - size).end()
        parts.append(text[at:end])
        size += end - at
        further = _BREAK.match(text, end) if size < most else None
        if further is None:
            return "".join(parts), end
        at = further.end()


def _key_span(text: str, at: int, size: int | None, check: Callable[[bytes], bool]) -> tuple[int, int] | None:
    """The span of ``size`` encoded bytes from ``at`` on if ``check`` accepts them, with the marks that fill them up."""
    if size is None or not 24 <= size <= KEY_BYTES:
        return None
    need = -(-size * 4 // 3)
    body, end = _gather(text, at, need)
    if len(body) < need or not check(_base64(body)[:size]):
        return None
    return at, _filled(text, end)


def _filled(text: str, end: int) -> int:
    """The end of base64 with the marks that fill up its last group."""
    return end + len(text[end : end + 2]) - len(text[end : end + 2].lstrip("="))


def _der_size(data: bytes) -> int | None:
    """Bytes of the sequence that begins here, by its own length."""
    if len(data) < 6 or data[0] != 0x30:
        return None
    if data[1] < 0x80:
        return 2 + data[1]
    count = data[1] & 0x7F
    return 2 + count + int.from_bytes(data[2 : 2 + count], "big") if 1 <= count <= 4 else None


def _ssh_size(text: str, start: int) -> int | None:
    """Bytes of the OpenSSH private key that begins at ``start``: three names, a count, as many public keys, the private
    part. No more is decoded than the lengths read so far ask for."""
    at, left, count = 15, 3, None
    data = b""
    while left or count is None:
        if at + 4 > KEY_BYTES:
            return None
        if at + 4 > len(data):
            need = -(-(at + 4) // 3) * 4 + 256
            body = _gather(text, start, need)[0]
            data = _base64(body[: len(body) - (len(body) % 4 == 1)])
            if at + 4 > len(data):
                return None
        size = int.from_bytes(data[at : at + 4], "big")
        if left:
            at, left = at + 4 + size, left - 1
        elif size > 64:
            return None
        else:
            count, left, at = size, size + 1, at + 4
    return at


def _pem_blocks(text: str, pattern: re.Pattern = _PEM) -> Iterator[tuple[int, int]]:
    for m in pattern.finditer(text):
        if _key_kind(_base64(re.sub(r"\\[nr]|\s", "", m[2]))):
            yield m.span()


def _encoded_pem(text: str) -> Iterator[tuple[int, int]]:
    """Base64 of a text with a key between PEM marks. Characters are decoded once for each of four alignments at most."""
    until, tried = -1, set()
    for m in _PEM_START.finditer(text):
        if m.start() >= until:
            body, until = _gather(text, m.start(), len(text))
            tried = set()
        elif m.start() % 4 in tried:
            continue
        else:
            body, _ = _gather(text, m.start(), len(text))
        tried.add(m.start() % 4)
        whole = _base64(body[: len(body) // 4 * 4 + (0 if len(body) % 4 == 1 else len(body) % 4)])
        if next(_pem_blocks(whole.decode("latin-1")), None):
            yield m.start(), _filled(text, until)


def _key_kind(data: bytes) -> str | None:
    return "der" if is_der_key(data) else "ssh" if is_ssh_key(data) else None


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, begin, end) in code points, by begin and then by the order of ``KINDS``."""
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", *m.span()) for m in _HEX.finditer(text) if m.end() - m.start() >= 32]
    found += _signed_tokens(text)
    found += [("pem", *span) for span in (*_pem_blocks(text), *_encoded_pem(text))]
    for m in _DER_START.finditer(text):
        if span := _key_span(text, m.start(), _der_size(_base64(text[m.start() : m.start() + 8])), is_der_key):
            found.append(("der", *span))
    for m in _SSH_START.finditer(text):
        if span := _key_span(text, m.start(), _ssh_size(text, m.start()), is_ssh_key):
            found.append(("ssh", *span))
    for m in _BASE64.finditer(text):
        if not m[0].startswith(_SSH_START.pattern) and is_ssh_key(_base64(m[0])):
            found.append(("ssh", *m.span()))
    for m in _HEX_ANY.finditer(text):
        if kind := _key_kind(bytes.fromhex(m[0])):
            found.append((kind, *m.span()))
    return sorted(set(found), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base = set(KINDS[:3])
    for batch in batches:
        for piece in pieces(batch, "text"):
            texts = pc.fill_null(piece.column("text"), "")
            maybe = pc.match_substring_regex(texts, _MAYBE).to_numpy(zero_copy_only=False)
            spans = [find(texts[i].as_py()) if hit else [] for i, hit in enumerate(maybe.tolist())]
            own = [[s for s in some if s[0] in base] for some in spans]
            counts = {f"n_{k}": pa.array([sum(s[0] == k for s in some) for some in spans], pa.int64()) for k in KINDS}
            digest = [hashlib.sha256(_joined(some).encode()).hexdigest() for some in own]
            columns = {"doc_id": piece.column("doc_id"), **counts, "base_sha256": pa.array(digest, pa.string())}
            columns["spans"] = pa.array(list(map(_joined, spans)), pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, a count per kind (n_assign ...), base_sha256 (of the pattern kinds' spans), spans.

    Spans are ``kind:begin:end`` in code points, ordered by begin and then by kind; equal spans count once. A null or empty
    text has none. Rows are judged one by one, so repeated rows and ids give repeated results; an empty table gives
    an empty result; other columns are ignored. The job has no shuffle.
    """
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(_scan, f"doc_id {kind}, {counts}, base_sha256 string, spans string")
