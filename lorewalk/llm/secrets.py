"""Secret scans: plain patterns, and candidates confirmed by their structure.

Patterns give the kinds ``assign`` (a named value), ``access`` (an access key
id) and ``hex``.  Beyond these, long runs of base64 or hex letters are decoded,
and only what parses is reported: ``pem`` and ``der`` (ASN.1 keys whose nested
lengths fill the data exactly), ``ssh`` (length-prefixed key blobs) and ``jwt``
(signed tokens with a JSON header that names an algorithm).

Runs are found for whole batches of texts in numpy; patterns run only over
texts that hold one of their words.  One scan, no shuffle.

Defined results: null text counts as empty and has no spans; texts of any
length are scanned whole; positions are code points, end exclusive; spans are
ordered by start, then by kind in the order of KINDS; repeated rows are rows of their
own; an empty table gives an empty result.  Input columns stay; one named as the new
column, whatever the case, gives way to it.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewalk.llm import blocks
from lorewalk.llm.shared import without

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "pem", "der", "ssh", "jwt")
_ORDER = {k: i for i, k in enumerate(KINDS)}

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40})-----((?:[A-Za-z0-9+/=\s]|\\[nrt])*)-----END \1-----")
_ESCAPED = re.compile(r"\\[nrt]")
#: Chains of dotted parts, each tried from its beginning alone; a token begins at a head inside one of the parts.
_DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]*+){2,}+")
_JWT_HEADS = ("eyJ", "ewo", "eyA", "ew0")
_JWT_HEAD = re.compile("|".join(_JWT_HEADS))
#: How keys begin in base64 and hex, and what stands between the lines of a wrapped one.
_DER_HEAD = re.compile(rb"M[A-P]")
_HEX_HEAD = re.compile(rb"30(?:8[1-4]|[1-7][0-9A-Fa-f])")
_SSH_HEAD = re.compile(rb"AAAA[A-Z]|b3BlbnNzaC1rZXktdjEA")
_LETTERS = re.compile(rb"[A-Za-z0-9+/_-]*")
_HEX_LETTERS = re.compile(rb"[A-Fa-f0-9]*")
_WRAP = re.compile(rb"[ \t]*(?:\r?\n|\\r\\n|\\n)[ \t]*")

#: Lower-case words without which _ASSIGN has no match.
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Shortest run that is decoded: 24 letters hold 18 bytes, less than any key.
SHORTEST = 24

#: Key names at the head of length-prefixed blobs, and the magic of whole key files.
_SSH_NAMES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-", b"sk-ssh-", b"sk-ecdsa-")
_SSH_MAGIC = b"openssh-key-v1\0"


def _classes(letters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(letters, np.uint8)] = True
    return out


_DIGITS, _LOW, _UP = b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HEX = _classes(_DIGITS + b"abcdef")
_CODED = _classes(_DIGITS + _LOW + _UP + b"+/_-")


def _runs(mask: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs in a text that are long enough."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(mask) + 1, bool)
    edge[offsets] = True
    off = ~mask
    starts = np.flatnonzero(mask & (np.r_[True, off[:-1]] | edge[:-1]))
    ends = np.flatnonzero(mask & (np.r_[off[1:], True] | edge[1:])) + 1
    long = ends - starts >= least
    return starts[long], ends[long]


def _element(data: bytes, at: int, stop: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the content of the ASN.1 element at a place, if it ends by stop."""
    if at + 2 > stop:
        return None
    tag, length = data[at], data[at + 1]
    at += 2
    if length & 0x80:
        n = length & 0x7F
        if not 1 <= n <= 4 or at + n > stop:
            return None
        length = int.from_bytes(data[at : at + n], "big")
        at += n
    return (tag, at, at + length) if at + length <= stop else None


def _fills(data: bytes, at: int, stop: int, depth: int = 0) -> list[int] | None:
    """Tags of the elements that fill a range exactly, each constructed one filled in turn; None if they don't."""
    tags = []
    while at < stop:
        x = _element(data, at, stop)
        if x is None or depth > 16:
            return None
        tags.append(x[0])
        if x[0] & 0x20 and _fills(data, x[1], x[2], depth + 1) is None:
            return None
        at = x[2]
    return tags


def is_der(data: bytes) -> bool:
    """A sequence that fills the data and begins as keys do: an integer, or an algorithm with its object identifier."""
    if len(data) < 16 or data[0] != 0x30:
        return False
    x = _element(data, 0, len(data))
    if x is None or x[2] != len(data):
        return False
    tags = _fills(data, x[1], x[2])
    if not tags or len(tags) < 2:
        return False
    if tags[0] == 0x30:  # a public key: algorithm, then a bit string
        inner = _element(data, x[1], x[2])
        return tags[1] == 0x03 and data[inner[1]] == 0x06 if inner[1] < inner[2] else False
    return tags[0] == 0x02 and (tags[1] in (0x30, 0x04) or tags.count(0x02) >= 2)


def is_ssh(data: bytes) -> bool:
    """Length-prefixed fields that fill the data, the first of them a key's name; or a key file's magic with four such fields."""
    if data.startswith(_SSH_MAGIC):
        return _fields(data, len(_SSH_MAGIC), 3) is not None
    names = _fields(data, 0, None)
    return bool(names) and len(names) >= 2 and names[0].startswith(_SSH_NAMES)


def _fields(data: bytes, at: int, most: int | None) -> list[bytes] | None:
    out: list[bytes] = []
    while at < len(data) and (most is None or len(out) < most):
        if at + 4 > len(data) or len(out) > 64:
            return None
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def unbase64(run: str | bytes) -> bytes | None:
    """The bytes of plain or URL-safe base64, padded or not."""
    if isinstance(run, str):
        run = run.encode("ascii", "ignore")
    run = run.translate(None, b" \t\r\n\f\v=").replace(b"-", b"+").replace(b"_", b"/")
    try:
        return base64.b64decode(run + b"=" * (-len(run) % 4), validate=True)
    except binascii.Error:
        return None


def _is_object(part: str) -> bool:
    """Whether a part is a JSON object in base64."""
    try:
        return isinstance(json.loads(unbase64(part) or b""), dict)
    except (ValueError, RecursionError):
        return False


def is_jwt(token: str) -> bool:
    """Three parts; the first is a JSON object naming an algorithm, the second a JSON object, the third there unless the algorithm is none."""
    head, body, mark = token.split(".")[:3]
    try:
        h, b = (json.loads(unbase64(x) or b"") for x in (head, body))
    except (ValueError, RecursionError):
        return False
    return isinstance(h, dict) and isinstance(h.get("alg"), str) and isinstance(b, dict) and (len(mark) >= 16 or h["alg"].lower() == "none")


def _decoded_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    return "der" if is_der(data) else "ssh" if is_ssh(data) else None


def _lines(whole: bytes, at: int, stop: int, letters: re.Pattern, most: int | None) -> Iterator[tuple[bytes, int]]:
    """The letters from a place on, and where they end: line after line, so many letters at most."""
    got = b""
    while at < stop:
        end = letters.match(whole, at, stop).end()
        if most is not None and end - at > most - len(got):
            end = at + most - len(got)
        if end == at:
            return
        got += whole[at:end]
        yield got, end
        gap = _WRAP.match(whole, end, stop)
        if gap is None or len(got) == most:
            return
        at = gap.end()


def _length(head: bytes) -> int | None:
    """Bytes of the ASN.1 sequence that begins so, if it can be a key."""
    if len(head) < 16 or head[0] != 0x30:
        return None
    n = head[1] & 0x7F if head[1] & 0x80 else 0
    if n > 4 or head[1] == 0x80 or head[2 + n] not in (0x02, 0x30):
        return None
    return 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1])


def _inside(whole: bytes, a: int, b: int, stop: int) -> Iterator[tuple[str, int, int]]:
    """Keys that begin inside a run and end there, or lines after it."""
    heads = {m.start(): (kind, m.start()) for kind, head in (("hex", _HEX_HEAD), ("der", _DER_HEAD), ("ssh", _SSH_HEAD)) for m in head.finditer(whole, a, b)}
    done = a
    for at in sorted(heads):
        if at < done:
            continue
        kind = heads[at][0]
        if kind == "ssh":
            for got, end in _lines(whole, at, stop, _LETTERS, None):
                if is_ssh(unbase64(got) or b""):
                    done, pad = end, -len(got) % 4
        else:
            letters, per, decode = (_HEX_LETTERS, 2, binascii.unhexlify) if kind == "hex" else (_LETTERS, 4 / 3, unbase64)
            first = b""
            for first, _ in _lines(whole, at, stop, letters, 32):
                pass
            size = _length(decode(first) or b"") if len(first) == 32 else None
            if size is None or size * per > stop - at:
                continue
            want = 2 * size if kind == "hex" else -(-4 * size // 3)
            for got, end in _lines(whole, at, stop, letters, want):
                if len(got) == want and is_der(decode(got) or b""):
                    done, pad = end, 0 if kind == "hex" else -len(got) % 4
        if done > at:
            while pad and done < stop and whole[done] == 0x3D:
                done, pad = done + 1, pad - 1
            yield "ssh" if kind == "ssh" else "der", at, done


def find(texts: pa.Array) -> list[list[tuple[str, int, int]]]:
    """The spans of each text."""
    data, offsets = blocks.buffers(texts)
    whole = data.tobytes()
    found: list[list[tuple[str, int, int]]] = [[] for _ in range(len(offsets) - 1)]

    def owners(words: tuple[bytes, ...], among: bytes) -> list[int]:
        """Texts that hold a word; the next search begins after the text that is known."""
        out = set()
        for w in words:
            at = among.find(w)
            while at >= 0:
                k = int(np.searchsorted(offsets, at, "right")) - 1
                if at + len(w) <= offsets[k + 1]:
                    out.add(k)
                    at = among.find(w, int(offsets[k + 1]))
                else:
                    at = among.find(w, at + 1)
        return sorted(out)

    def text(k: int) -> str:
        return whole[offsets[k] : offsets[k + 1]].decode()

    for k in owners(_NAMES, whole.lower()):
        found[k] += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text(k)) if len(m[1]) >= 8]
    for k in owners((b"AKIA",), whole):
        found[k] += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text(k)) if m.end() - m.start() >= 16]
    for k in owners((b"-----BEGIN ",), whole):
        found[k] += [("pem", m.start(), m.end()) for m in _PEM.finditer(text(k)) if _decoded_kind(unbase64(_ESCAPED.sub("", m[2])))]
    for k in owners(tuple(h.encode() for h in _JWT_HEADS), whole):  # how a JSON object begins
        for chain in _DOTTED.finditer(text(k)):
            at, parts = chain.start(), chain[0].split(".")
            for i in range(len(parts) - 2):
                for m in _JWT_HEAD.finditer(parts[i]) if _is_object(parts[i + 1]) else ():
                    token = ".".join((parts[i][m.start() :], parts[i + 1], parts[i + 2]))
                    if is_jwt(token):
                        found[k].append(("jwt", at + m.start(), at + m.start() + len(token)))
                        break
                at += len(parts[i]) + 1

    places: list[tuple[str, int, int]] = []
    places += [("hex", a, b) for a, b in zip(*(x.tolist() for x in _runs(_HEX[data], offsets, 32)), strict=True)]
    for a, b in zip(*(x.tolist() for x in _runs(_CODED[data], offsets, SHORTEST)), strict=True):
        run = whole[a:b]
        try:
            kind = _decoded_kind(binascii.unhexlify(run))
        except binascii.Error:
            kind = None
        kind = kind or _decoded_kind(unbase64(run))
        if kind:
            while b < len(whole) and b - a < (len(run) + 3) // 4 * 4 and whole[b] == 0x3D and b not in offsets:
                b += 1
            places.append((kind, a, b))
        else:
            places += _inside(whole, a, b, int(offsets[np.searchsorted(offsets, a, "right")]))
    if places:
        points = blocks.code_points(data)
        for kind, a, b in places:
            k = int(np.searchsorted(offsets, a, "right")) - 1
            found[k].append((kind, int(points[a] - points[offsets[k]]), int(points[b] - points[offsets[k]])))
    for x in found:
        armour = [(a, b) for kind, a, b in x if kind == "pem"]
        keys: list[tuple[int, int]] = []  # a wrapped key's later lines, and what stands in armour, are reported once
        for kind, a, b in sorted([s for s in x if s[0] in ("der", "ssh")], key=lambda s: (s[1], -s[2])):
            if any(p <= a and b <= q for p, q in armour) or (keys and b <= keys[-1][1]):
                x.remove((kind, a, b))
            else:
                keys.append((a, b))
        x.sort(key=lambda s: (s[1], _ORDER[s[0]], s[2]))
    return found


def scan(docs: DataFrame, *, text: str = "text", secrets: str = "secrets", keep_text: bool = True) -> DataFrame:
    """Every row with its spans, array<struct<kind, start, end>>; without the text if it isn't kept. An input column named as the new one is replaced."""
    kept = [c for c in without(docs.columns, [secrets]) if keep_text or c != text]
    source = docs.select(*[f"`{c}`" for c in dict.fromkeys([*kept, text])])
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([f for f in source.schema.fields if f.name in kept] + [T.StructField(secrets, T.ArrayType(span))])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks.pieces(batch, text):
                spans = [[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in find(part.column(text))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in schema.names[:-1]), pa.array(spans, arrow)], names=schema.names)

    return source.mapInArrow(run, schema)


def spans_text(secrets: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, secrets: Column, instead: str = "[SECRET]") -> Column:
    """The text with every span replaced; spans that touch or overlap become one."""
    merged = F.aggregate(
        secrets,
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    done = F.aggregate(
        merged,
        F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")),
        lambda acc, s: F.struct(
            F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(instead)).alias("out"),
            s["end"].alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))),
    )
    return F.when(F.size(secrets) > 0, done).otherwise(text)
