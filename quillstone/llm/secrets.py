"""Secret scan with structural confirmation.

Base kinds are plain patterns. The method adds kinds that are reported only
after a decoded candidate parses: PEM blocks, structures that begin at any digit
of a run of base64 or hex digits, be it DER whose lengths nest exactly or SSH
keys of length-prefixed fields, and signed tokens whose header is a JSON object
that names an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quillstone.llm.common import Out

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "pem", "ssh", "jwt", "der")

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,64})-----")
PEM_FIELD = re.compile(r"[A-Za-z][A-Za-z0-9-]*:")
PEM_BODY = re.compile(r"[A-Za-z0-9+/=\s]{16,}")
BLOB = re.compile(r"[A-Za-z0-9+/_-]{32,}={0,2}")
#: A further line of a wrapped run, and what may stand between lines: a line break, written out or escaped, with marks of a quotation or a comment.
LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
BREAK = re.compile(r"(?:\r?\n|(?:\\+r)?\\+n)[\x20\t>#|*]{0,16}")
ESCAPED_BREAK = re.compile(r"(?:\\+r)?\\+n")
#: What is no part of a line of armour at its ends: quotation marks, marks of comments and of strings in source code.
AROUND = " \t\r>#|*;\"',\\"
HEX_BLOB = re.compile(r"[0-9A-Fa-f]{48,}")
#: Where in a run a structure may begin: a SEQUENCE of short or long form, an SSH field's length, the name of an OpenSSH key.
BLOB_STARTS = re.compile(r"(?=M[A-H]|MI[E-T]|AAAA|b3BlbnNzaC1rZXktdjEA)")
HEX_STARTS = re.compile(r"(?=30|000000|6[Ff]70656[Ee]7373682[Dd]6[Bb]65792[Dd]763100)")
#: Least bytes of a structure within a run.
LEAST = 24
#: A header that begins with "{" and then a quote, a blank or a line break, or a byte 0 in UTF-16, begins with ey or ew.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(e[yw][A-Za-z0-9_-]{6,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
SSH_NAMES = (b"ssh-", b"ecdsa-", b"sk-ssh-", b"sk-ecdsa-")


def decode64(text: str) -> bytes | None:
    """Standard or URL-safe base64 with or without padding; None if it is neither."""
    body = re.sub(r"\s", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the value of the DER element at ``at``."""
    if end - at < 2 or data[at] & 0x1F == 0x1F:
        return None
    size, at_value = data[at + 1], at + 2
    if size >= 0x80:
        width = size & 0x7F
        if not 1 <= width <= 4 or at_value + width > end:
            return None
        size = int.from_bytes(data[at_value : at_value + width], "big")
        at_value += width
        if size < 0x80 or size >> (8 * (width - 1)) == 0:
            return None
    return (data[at], at_value, at_value + size) if at_value + size <= end else None


def is_der(data: bytes) -> bool:
    """One SEQUENCE that fills the data, whose nested lengths all fit and that holds two elements or more."""
    top = _tlv(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    todo, found = [(top[1], top[2], 1)], 0
    while todo:
        at, end, depth = todo.pop()
        while at < end:
            element = _tlv(data, at, end)
            if element is None or element[0] == 0 or depth > 32:
                return False
            found += 1
            if element[0] & 0x20:
                todo.append((element[1], element[2], depth + 1))
            at = element[2]
    return found >= 2


def der_size(head: bytes) -> int:
    """Bytes of the SEQUENCE that begins with ``head``, by its own length; 0 if it is none."""
    if len(head) < 2 or head[0] != 0x30:
        return 0
    if head[1] < 0x80:
        return 2 + head[1]
    width = head[1] & 0x7F
    return 2 + width + int.from_bytes(head[2 : 2 + width], "big") if 1 <= width <= 4 and len(head) >= 2 + width else 0


def begins_as_key(data: bytes) -> bool:
    """Whether the first element of the SEQUENCE is a version or a SEQUENCE, as in every key and certificate."""
    top = _tlv(data, 0, len(data))
    return top is not None and data[top[1] : top[1] + 1] in (b"\x02", b"\x30")


def is_ssh(data: bytes) -> bool:
    """An OpenSSH private key, or a public key: length-prefixed fields after a known name, two at least."""
    if data.startswith(b"openssh-key-v1\0"):
        at = 15
    elif data[4:].startswith(SSH_NAMES):
        at = 0
    else:
        return False
    for _ in range(2):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data) or len(data) < at + 4:
            return False
        at += 4 + size
    return True


def is_token(header: str) -> bool:
    data = decode64(header)
    try:
        parsed = json.loads(data) if data and data[:1] == b"{" else None
    except (ValueError, RecursionError):
        return False
    return isinstance(parsed, dict) and isinstance(parsed.get("alg"), str)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


class _Taken:
    """Spans that do not overlap."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def take(self, start: int, end: int) -> bool:
        """Keep the span if it touches no other."""
        at = bisect.bisect_left(self.starts, end)
        if at and self.ends[at - 1] > start:
            return False
        self.starts.insert(at, start)
        self.ends.insert(at, end)
        return True


def _pem_spans(text: str) -> Iterator[tuple[int, int]]:
    """Blocks from BEGIN to END of one label, with none begun between, whose body decodes and parses.

    Header lines may stand before the body, with a blank line behind them; the
    body of an encrypted key is blocks of its cipher. Line breaks may be escaped,
    as in JSON, and lines be quoted, commented out or strings of source code.
    """
    begins = list(PEM.finditer(text))
    for m, following in zip(begins, [*begins[1:], None], strict=True):
        limit = following.start() if following else len(text)
        mark = f"-----END {m[1]}-----"
        end = text.find(mark, m.end(), limit)
        if end < 0:
            continue
        lines = ESCAPED_BREAK.sub("\n", text[m.end() : end]).split("\n")
        body, encrypted = "\n".join(x.strip(AROUND) for x in lines).strip(), False
        if PEM_FIELD.match(body):
            head, body = (re.split(r"\n[\x20\t\r]*\n", body, maxsplit=1) + [""])[:2]
            encrypted = "ENCRYPTED" in head and "DEK-Info:" in head
        data = decode64(body) if PEM_BODY.fullmatch(body) else None
        if data is not None and (is_der(data) or is_ssh(data) or encrypted and len(data) % 8 == 0):
            yield m.start(), end + len(mark)


def _decoded64(run: str, at: int, size: int) -> bytes:
    part = run[at : at + -(-4 * size // 3)].rstrip("=")
    part = part[: len(part) - (len(part) % 4 == 1)].replace("-", "+").replace("_", "/")
    return base64.b64decode(part + "=" * (-len(part) % 4))


def _decoded_hex(run: str, at: int, size: int) -> bytes:
    part = run[at : at + 2 * size]
    return bytes.fromhex(part[: len(part) // 2 * 2])


def _wrapped(text: str, m: re.Match) -> tuple[str, int, int]:
    """The digits of a run and of the lines on which it goes on, the digits of a line, and the characters between lines.

    Lines are as long as the first; a shorter one ends the run, if it makes whole
    groups of four digits.
    """
    first, at = m[0], m.end()
    between = BREAK.match(text, at) if not first.endswith("=") else None
    if between is None:
        return first, len(first), 0
    size, mark, lines, total = len(first), between[0], [first], len(first)
    while text.startswith(mark, at) and (line := LINE.match(text, at + len(mark))) and len(line[0]) <= size:
        last = len(line[0]) < size or line[0].endswith("=")
        if last and (total + len(line[0])) % 4:
            break
        lines.append(line[0])
        total, at = total + len(line[0]), line.end()
        if last:
            break
    return "".join(lines), size, len(mark)


def _structures(run: str, starts: re.Pattern, decoded, bits: int) -> Iterator[tuple[int, int, int]]:
    """(start, kind, end) of structures in a run of digits worth ``bits`` each: a few bytes of each candidate are decoded, all of it once its length fits."""
    digits = len(run.rstrip("="))
    at = 0
    for m in starts.finditer(run):
        k = m.start()
        if k < at:
            continue
        left = (digits - k) * bits // 8
        head = decoded(run, k, 24)
        if head.startswith(b"openssh-key-v1\0") or head[4:].startswith(SSH_NAMES):
            if is_ssh(decoded(run, k, left)):
                yield k, 4, len(run)
                return
        size = der_size(head)
        if LEAST <= size <= left:
            data = decoded(run, k, size)[:size]
            if is_der(data) and (k == 0 and size == left or begins_as_key(data)):
                at = k + -(-8 * size // bits)
                at = len(run) if at >= digits else at
                yield k, 6, at


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what decodes and parses."""
    spans, taken = [], _Taken()

    def add(start: int, kind: int, end: int) -> None:
        if taken.take(start, end):
            spans.append((start, kind, end))

    if "-----BEGIN " in text:
        for start, end in _pem_spans(text):
            add(start, 3, end)
    at = 0
    while m := TOKEN.search(text, at):
        at = m.end(1)  # a token may begin behind a header that is none
        if is_token(m[1]):
            at = m.end()
            add(m.start(), 5, m.end())
    at = 0
    while m := BLOB.search(text, at):
        run, size, between = _wrapped(text, m)
        place = lambda k, m=m, size=size, between=between: m.start() + k + k // size * between
        found = list(_structures(run, BLOB_STARTS, _decoded64, 6))
        for start, kind, end in found:
            add(place(start), kind, place(end - 1) + 1)
        if not found and between:  # a line may be all of a structure
            for k in range(0, len(run), size):
                for start, kind, end in _structures(run[k : k + size], BLOB_STARTS, _decoded64, 6):
                    add(place(k + start), kind, place(k + end - 1) + 1)
        at = place(len(run) - 1) + 1
    for m in HEX_BLOB.finditer(text):
        for start, kind, end in _structures(m[0], HEX_STARTS, _decoded_hex, 4):
            add(m.start() + start, kind, m.start() + end)
    return sorted(spans)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, base_sha256, spans, and findings with each span's kind and text.

    Null and empty texts give no spans, texts of any length are read whole.
    Confirmed spans do not overlap: blocks go before tokens, those before base64
    and that before hex, and of one kind the first. Repeated rows give a row each,
    an empty table none; columns besides the two named are ignored.
    """
    id_field = docs.select(id_column).schema[0]
    schema = f"`{id_column}` {id_field.dataType.simpleString()}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, findings array<struct<kind:string,start:bigint,end:bigint,found:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            if out is None:
                found = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("found", pa.string())]))
                out = Out(pa.schema([(id_column, batch.schema.field(0).type), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("findings", found)]))
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                base = base_spans(text)
                spans = sorted(base + confirmed_spans(text))
                count = [0, 0, 0]
                for _, kind, _ in base:
                    count[kind] += 1
                findings = [{"kind": KINDS[k], "start": a, "end": b, "found": text[a:b]} for a, k, b in spans]
                yield from out.add(i, *count, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), findings)
        if out is not None:
            yield out.flush()

    return docs.select(id_column, text_column).mapInArrow(run, schema)
