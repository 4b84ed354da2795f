"""Secrets in text: patterns, and candidates confirmed by their structure.

Base patterns report assignments, access keys and long hex runs. Structural confirmation
looks at base64 and hex candidates: they are decoded and reported only when the bytes are a
private key in DER (every nested length must fit exactly), an OpenSSH key file, or when the
text is a signed token whose header and payload parse as JSON with an algorithm. Base64 may
start anywhere in a run and be wrapped by real or escaped line ends: the key's own lengths
tell where it stops.
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
from pyspark.sql import types as T

from viewtide.llm.scratch import map_text

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 8, 16, 32
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(rf"[0-9a-f]{{{HEX_MIN},}}")  # maximal runs, as with [0-9a-f]+ and a length test
KINDS = ("assign", "access", "hex", "pem", "der", "openssh", "token")

# What may stand between two characters of one base64 value: line ends, written out or as
# an escape of a string literal, with blanks; the backslash of an escaped slash.
GAP = r"(?>(?:[\x20\t]*+(?:\\*+(?:\r\n?|\n)|\\++(?:[nrt]|u000[9aAdD])))++[\x20\t]*+|\\++(?=/))"
_PIECE = re.compile(rf"([A-Za-z0-9+/_-]+)|{GAP}")
_PAD = re.compile(rf"(?:{GAP})?=(?:(?:{GAP})?=)?")
# The first bytes of a DER sequence (0x30 and a length of at most four bytes), or of a key file.
DER_START = re.compile(r"M(?=[A-I])")
SSH_START = re.compile(r"b3BlbnNzaC1rZXktdjEA")
_HEAD, _LEAST = 16, 40  # characters that tell whether a key may start; least of a candidate
ANY_HEX = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{14,}+)(?=\.([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]*+))")
_OBJECT = re.compile(rb"[\x20\t\r\n]*\{[\x20\t\r\n]*(?:\"|$)|[\x20\t\r\n]+$")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY-----((?:(?!-----)[\s\S])*+)-----END \1PRIVATE KEY-----")
_LINE_END = re.compile(r"\\++(?:[nrt]|u000[9aAdD]|(?=[\r\n]))")
_HEADER = re.compile(r"([A-Za-z0-9-]+):(.*)")
# Password-based encryption of PKCS#5 and PKCS#12.
_PBE = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
_OPENSSH = b"openssh-key-v1\0"
#: Values of a key lie a few levels deep; a sequence nested deeper than this is none.
_MAX_DEPTH = 32


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, content start, content end) of the DER value at ``at``; None if it does not fit."""
    if end - at < 2:
        return None
    tag, first = data[at], data[at + 1]
    at += 2
    if first < 0x80:
        size = first
    else:
        n = first & 0x7F
        if n == 0 or n > 4 or end - at < n or data[at] == 0:
            return None
        size = int.from_bytes(data[at: at + n], "big")
        at += n
        if size < 0x80:
            return None  # DER writes short lengths in one byte
    return (tag, at, at + size) if at + size <= end else None


def _children(data: bytes, at: int, end: int, depth: int = 0) -> list[tuple[int, int, int]] | None:
    """The values that fill ``data[at:end]`` exactly, nested ones checked too."""
    out = []
    while at < end:
        value = _tlv(data, at, end)
        if value is None or depth > _MAX_DEPTH:
            return None
        if value[0] & 0x20 and _children(data, value[1], value[2], depth + 1) is None:
            return None
        out.append(value)
        at = value[2]
    return out


def is_private_key(data: bytes) -> bool:
    """A DER sequence shaped like a private key: PKCS#8 (encrypted too), PKCS#1, DSA or SEC1."""
    outer = _tlv(data, 0, len(data))
    if outer is None or outer[0] != 0x30 or outer[2] != len(data):
        return False
    inside = _children(data, outer[1], outer[2])
    if inside and [t for t, _, _ in inside] == [0x30, 0x04]:  # encrypted PKCS#8: algorithm, octets
        named = _children(data, inside[0][1], inside[0][2])
        return bool(named) and named[0][0] == 0x06 and data[named[0][1]: named[0][2]].startswith(_PBE) \
            and inside[1][2] > inside[1][1]
    if not inside or inside[0][0] != 0x02 or inside[0][2] - inside[0][1] != 1:
        return False
    version, tags = data[inside[0][1]], [t for t, _, _ in inside]
    if tags[1:3] == [0x30, 0x04]:  # PKCS#8: version, algorithm, key octets
        named = _children(data, inside[1][1], inside[1][2])
        return version in (0, 1) and bool(named) and named[0][0] == 0x06
    if len(tags) in (6, 9, 10) and tags[:6] == [0x02] * 6:  # DSA or PKCS#1 integers
        return version in (0, 1)
    return version == 1 and tags[1:2] == [0x04]  # SEC1


def is_openssh_key(data: bytes) -> bool:
    """An OpenSSH key file: cipher, kdf, options, key count, then length-prefixed parts."""
    if not data.startswith(_OPENSSH):
        return False
    at, fields = len(_OPENSSH), 0
    while at + 4 <= len(data):
        size = int.from_bytes(data[at: at + 4], "big")
        at += 4
        fields += 1
        if fields == 4:  # the number of keys, not a length
            if not 0 < size < 100:
                return False
            continue
        if at + size > len(data):
            return False
        at += size
    return fields >= 6 and at == len(data)


def _der_size(head: bytes) -> int | None:
    """Bytes of the private key that may start with ``head``: a sequence that begins with
    a version or with the sequence of an algorithm."""
    if len(head) < 12 or head[0] != 0x30:
        return None
    n = head[1] & 0x7F if head[1] & 0x80 else 0
    if n > 4 or head[1] == 0x80:
        return None
    size = int.from_bytes(head[2: 2 + n], "big") if n else head[1]
    inner = head[2 + n:]
    return 2 + n + size if inner[:2] == b"\x02\x01" and inner[2] < 2 or inner[0] == 0x30 else None


class _Run:
    """Base64 characters from one place of a text up to where they end, gaps left out. The
    pieces are found once; any of the bytes they stand for is then read without the others."""

    def __init__(self, text: str, at: int):
        self.text, self.starts, self.counts = text, [], [0]
        while m := _PIECE.match(text, at):
            at = m.end()
            if m[1]:
                self.starts.append(m.start())
                self.counts.append(self.counts[-1] + len(m[1]))
        self.end = self.starts[-1] + self.counts[-1] - self.counts[-2]

    def place(self, at: int) -> int:
        """Characters of the run before text position ``at``, one of its own."""
        k = bisect_right(self.starts, at) - 1
        return self.counts[k] + at - self.starts[k]

    def chars(self, lo: int, hi: int) -> tuple[str, int]:
        """Characters ``lo..hi`` of the run, and where in the text they end."""
        hi, parts, end = min(hi, self.counts[-1]), [], 0
        k = bisect_right(self.counts, lo) - 1
        while k < len(self.starts) and self.counts[k] < hi:
            first, last = self.starts[k] + max(lo - self.counts[k], 0), self.starts[k] + min(hi, self.counts[k + 1]) - self.counts[k]
            parts.append(self.text[first:last])
            k, end = k + 1, last
        return "".join(parts), end

    def read(self, base: int, at: int, n: int) -> bytes:
        """Bytes ``at..at + n`` of what starts at character ``base``; fewer if it ends."""
        lo = at // 3 * 4
        return _decoded(self.chars(base + lo, base + -(-(at + n) // 3) * 4)[0])[at % 3: at % 3 + n]


def _openssh_size(run: _Run, base: int) -> int | None:
    """Bytes of the OpenSSH key file that starts there, by its length fields alone."""
    at, fields, count, most = len(_OPENSSH), 0, 0, (run.counts[-1] - base) * 3 // 4
    while fields < 4 or fields < 5 + count:
        size = run.read(base, at, 4)
        if len(size) < 4:
            return None
        at, size, fields = at + 4, int.from_bytes(size, "big"), fields + 1
        if fields == 4:
            count = size
            if not 0 < count < 100:
                return None
        elif (at := at + size) > most:
            return None
    return at


def _fits(run: _Run, base: int, size: int) -> bool:
    """Whether the outer DER sequence of ``size`` bytes is filled by a key's few values."""
    head = run.read(base, 0, 6)
    at, values = 2 + (head[1] & 0x7F if head[1] & 0x80 else 0), 0
    while at < size and values < 16:
        head = run.read(base, at, 6)
        n = head[1] & 0x7F if len(head) == 6 and head[1] & 0x80 else 0
        if len(head) < 2 or n > 4 or head[1] == 0x80:
            return False
        at += 2 + n + (int.from_bytes(head[2: 2 + n], "big") if n else head[1])
        values += 1
    return at == size


def _base64_keys(text: str, taken: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Keys whose base64 starts anywhere outside ``taken`` (spans in order, apart).

    Lengths are read before anything else is decoded, so a place where no key starts costs
    a few bytes, however long the run goes on after it."""
    out, done, run = [], 0, None
    starts = sorted([m.start() for m in DER_START.finditer(text)] + [m.start() for m in SSH_START.finditer(text)])
    firsts = [s for s, _ in taken]
    for at in starts:
        k = bisect_right(firsts, at) - 1
        if at < done or k >= 0 and at < taken[k][1]:
            continue
        if run is None or at >= run.end:
            run = _Run(text, at)
        base = run.place(at)
        size = _der_size(run.read(base, 0, _HEAD * 3 // 4)) if text[at] == "M" else _openssh_size(run, base)
        if size is None:
            continue
        need = (8 * size + 5) // 6
        if not _LEAST <= need <= run.counts[-1] - base or text[at] == "M" and not _fits(run, base, size):
            continue
        chars, end = run.chars(base, base + need)
        if kind := _kind(_decoded(chars)):
            pad = _PAD.match(text, end) if need % 4 else None
            done = pad.end() if pad else end
            out.append((kind, at, done))
    return out


def _is_pem(body: str) -> bool:
    """A key by its structure, or one whose headers say that it is encrypted."""
    lines = [x.strip() for x in _LINE_END.sub("\n", body).replace("\\", "").splitlines()]
    headers = {m[1].lower(): m[2] for m in map(_HEADER.fullmatch, lines) if m}
    data = _decoded("".join("".join(x.split()) for x in lines if not _HEADER.fullmatch(x)))
    if "ENCRYPTED" in headers.get("proc-type", "") and "dek-info" in headers:
        return len(data) >= 16 and len(data) % 8 == 0  # cipher blocks
    return _kind(data) is not None


def _tokens(text: str) -> list[tuple[str, int, int]]:
    """Signed tokens: a header may follow a separator or an escape inside its run."""
    out = []
    for m in TOKEN.finditer(text):
        run, at = m[1], m.start()
        starts = [0, *[i + 1 for i, c in enumerate(run) if c in "-_"]]
        if at and text[at - 1] == "\\" and run[0] in "nrt":
            starts.insert(1, 1)
        for i in starts:
            # A JSON object starts with a brace, maybe after white space.
            if len(run) - i < 14 or run[i] not in "eICD" or not _OBJECT.match(_decoded(run[i: i + 12])):
                continue
            header = _header(run, i)
            if isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(_json(m[2]), dict):
                out.append(("token", at + i, m.end(3)))
                break
    return out


def _decoded(text: str) -> bytes:
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def _kind(data: bytes) -> str | None:
    return "openssh" if is_openssh_key(data) else "der" if is_private_key(data) else None


def _json(part: str):
    try:
        return json.loads(_decoded(part))
    except (ValueError, RecursionError):
        return None


def _header(run: str, at: int):
    """The JSON that fills the run from ``at`` on, read no further than it can be JSON."""
    size = 256
    while at + size < len(run):
        data = _decoded(run[at: at + size])
        try:
            text = data.decode()
        except UnicodeDecodeError as e:
            if e.start < len(data) - 3:
                return None
            text = data[: e.start].decode()
        try:
            _, end = json.JSONDecoder().raw_decode(text, len(text) - len(text.lstrip()))
            if text[end:].strip():
                return None  # the object is closed and something follows
        except RecursionError:
            return None
        except ValueError as e:
            if not e.msg.startswith("Unterminated string") and e.pos < len(text) - 8:
                return None
        size *= 4
    return _json(run[at:])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out, low = [], text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_MIN]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """Candidates whose decoded structure is that of a key or a signed token."""
    out = []
    if "PRIVATE KEY-----" in text:
        out += [("pem", *m.span()) for m in PEM.finditer(text) if _is_pem(m[2])]
    out += _base64_keys(text, [(s, e) for _, s, e in out])
    for m in ANY_HEX.finditer(text):
        if m[0][:2] in ("30", "6f", "6F") and (kind := _kind(bytes.fromhex(m[0]))):
            out.append((kind, *m.span()))
    return out + _tokens(text)


def _line(spans: list[tuple[str, int, int]]) -> str:
    ordered = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{k}:{s}:{e}" for k, s, e in ordered)


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by one mark."""
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: (s[1], s[2])):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


RESULTS = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed", "redacted")


def scan_secrets(docs: DataFrame, text: str = "text", redacted: bool = False,
                 carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns of ``docs`` (all by default) plus ``n_assign, n_access, n_hex, base_sha256, spans,
    n_confirmed`` and, if asked for, ``redacted``: the text with its secrets masked.

    ``spans`` is ``kind:start:end`` of all spans by start, then kind, in code points with an
    exclusive end; ``base_sha256`` hashes the same line of base spans alone. One row in,
    one row out, no shuffle. A null or empty text has no spans; a null text stays null when
    redacted. Columns of ``docs`` named like a result (in any case) are replaced by it.
    """
    columns = [c for c in carry or docs.columns if c.lower() not in RESULTS]
    passed = columns if text in columns else [*columns, text]
    names = [*RESULTS[:-1], *(["redacted"] if redacted else [])]
    result = T._parse_datatype_string("n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, "
                                      "spans string, n_confirmed bigint" + ", redacted string" * redacted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(text):
                found = value.as_py()
                base, more = base_spans(found or ""), confirmed_spans(found or "")
                count = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
                rows.append((*count, hashlib.sha256(_line(base).encode()).hexdigest(), _line(base + more), len(more),
                             *([None if found is None else redact(found, base + more)] if redacted else [])))
            made = [pa.array([r[i] for r in rows], pa.int64() if names[i].startswith("n_") else pa.string())
                    for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *made], names=[*columns, *names])

    schema = T.StructType([*docs.select(*columns).schema.fields, *result.fields])
    return map_text(docs.select(*passed), run, schema)
