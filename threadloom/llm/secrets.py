"""Secrets: exact base patterns, and a worklist that unwraps nested encodings and scans every layer.

Layers are escapes (URL, Unicode and HTML, decoded together), base64 (plain or URL-safe, wrapped over lines or not, at
all four alignments, since a run may go on from a path or a word) and compressed data (gzip, zlib, zstd; all members and
frames, wherever they begin) inside base64. Each layer is a work item with its origin, which maps a character back to
the original text, so a secret found deep inside has its span. A layer already seen at the same place isn't opened
again; the same blob elsewhere is. Bytes are read as Latin-1, one character each: the patterns are ASCII, and
what is no text matches none of them.

Every decoding shortens its text, so the list runs dry. Base64 shrinks geometrically; escapes are rescanned layer by layer for
``ROUNDS`` layers, and what is nested deeper goes to its fixpoint in one linear pass, which is scanned too. Inflated data of
any length is scanned in pieces of about ``PIECE`` bytes, cut where no pattern or encoding can run across.

A null text counts as empty. Rows are independent of one another: repeated rows, null ids and other
columns make no difference.
"""

from __future__ import annotations

import binascii
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
PIECE = 1 << 23
ROUNDS = 8

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_KEYWORD = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ESCAPE = re.compile(r"(?P<url>(?:%[0-9A-Fa-f]{2})+)|(?P<unicode>(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|(?:\\x[0-9A-Fa-f]{2})+)|(?P<html>&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)")
_TAIL = re.compile(r"(?:%[0-7][0-9A-Fa-f]|\\x[0-7][0-9A-Fa-f]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)\Z")
_ENDS = frozenset("0123456789ABCDEFabcdef;")
_BLOB = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[A-Za-z0-9+/_-]+(?=[\r\n=\"'<]|\Z))*")
_BREAK = re.compile(r"[\r\n]")
_MAGIC = re.compile(rb"\x1f\x8b\x08|\x28\xb5\x2f\xfd|\x78[\x01\x5e\x9c\xda]")
_SAFE = re.compile(r"""[^A-Za-z0-9+/_.=:%&#;\\"'\s-]""")
_URL_SAFE = str.maketrans("-_", "+/")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base matches of one text or layer: leftmost and non-overlapping for each kind."""
    found = []
    if ":" in text or "=" in text:
        lower = text.lower()
        if any(k in lower for k in _KEYWORD):
            found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


#: Maps the number of a character to the first and last character of the text that it came from; None: is itself.
Origin = Callable[[int], tuple[int, int]] | None


def _at(origin: Origin, i: int) -> tuple[int, int]:
    return (i, i) if origin is None else origin(i)


def _units(match: re.Match) -> list[tuple[str, int]] | None:
    """Decoded characters of a run of escapes and the width of each in the run; None if they are none."""
    run, kind = match[0], match.lastgroup
    try:
        if kind == "html":
            return [(chr(int(run[3:-1], 16) if run[2] in "xX" else int(run[2:-1])), len(run))]
        if run[1] == "U":
            return [(chr(int(run[2:], 16)), 10)]
        if run[1] == "u":
            plain = bytes.fromhex(run.replace("\\u", "")).decode("utf-16-be", "replace")
            return [(c, 12 if ord(c) > 0xFFFF else 6) for c in plain]
        step = 3 if kind == "url" else 4
        raw = bytes.fromhex(run.replace("%" if kind == "url" else "\\x", ""))
        try:
            return [(c, step * len(c.encode())) for c in raw.decode()]
        except UnicodeDecodeError:
            return [(chr(b), step) for b in raw]
    except (ValueError, OverflowError):
        return None


def _unescaped(text: str, origin: Origin) -> tuple[str, Origin, str] | None:
    """The text with every escape decoded once, its origin, and the names of the encodings; None if nothing decodes."""
    parts, names, last, size = [], set(), 0, 0
    starts, sources, widths = [0], [0], [None]  # from starts[k] on: characters as they are, or of the given widths
    for m in _ESCAPE.finditer(text):
        if (units := _units(m)) is None:
            continue
        parts += [text[last : m.start()], "".join(c for c, _ in units)]
        size += m.start() - last
        edge = [m.start()]
        for _, w in units:
            edge.append(edge[-1] + w)
        starts += [size, size + len(units)]
        sources += [m.start(), m.end()]
        widths += [edge, None]
        size += len(units)
        last = m.end()
        names.add(m.lastgroup)
    if not names:
        return None

    def back(i: int) -> tuple[int, int]:
        k = bisect_right(starts, i) - 1
        edge, off = widths[k], i - starts[k]
        lo, hi = (sources[k] + off,) * 2 if edge is None else (edge[off], edge[off + 1] - 1)
        return _at(origin, lo)[0], _at(origin, hi)[1]

    return "".join([*parts, text[last:]]), back, "+".join(n for n in ("url", "unicode", "html") if n in names)


def _fixpoint(text: str, origin: Origin) -> tuple[str, Origin]:
    """The text with all escapes of single characters reduced until none is left: one pass with a stack."""
    out: list[str] = []
    left: list[int] = []
    right: list[int] = []
    for i, c in enumerate(text):
        lo = hi = i
        while True:
            out.append(c)
            left.append(lo)
            right.append(hi)
            if c not in _ENDS or (m := _TAIL.search("".join(out[-10:]))) is None:
                break
            run = m[0]
            try:
                code = int(run[3:-1], 16) if run[:3] in ("&#x", "&#X") else int(run[2:-1]) if run[0] == "&" else int(run[1:] if run[0] == "%" else run[2:], 16)
                c = chr(code)
            except (ValueError, OverflowError):
                break
            lo = left[-len(run)]
            del out[-len(run) :], left[-len(run) :], right[-len(run) :]
    return "".join(out), lambda k: (_at(origin, left[k])[0], _at(origin, right[k])[1])


def _streams(data: bytes) -> Iterator[bytes]:
    """Output of every compressed stream in the data, in bounded chunks; of a broken one what comes before the fault."""
    at = 0
    while m := _MAGIC.search(data, at):
        at = m.start() + 1
        zipped = data[m.start()] != 0x28
        tool = zlib.decompressobj(47) if zipped else zstandard.ZstdDecompressor().decompressobj()
        step, pos, given = (1 << 16 if zipped else 1 << 10), m.start(), False
        try:
            while pos < len(data):
                chunk = data[pos : pos + step]
                pos += len(chunk)
                plain = tool.decompress(chunk, PIECE) if zipped else tool.decompress(chunk)
                while plain:
                    given = True
                    yield plain
                    plain = tool.decompress(tool.unconsumed_tail, PIECE) if zipped and tool.unconsumed_tail else b""
                if tool.eof:
                    at = pos - len(tool.unused_data)
                    break
            else:
                at = len(data) if given else at
        except (zlib.error, zstandard.ZstdError):
            at = max(at, pos - step) if given else at


def _pieces(data: bytes) -> Iterator[str]:
    """All inflated text in pieces: of a piece that is full, what follows the last character that nothing runs across goes to the next."""
    held: list[str] = []
    size, due = 0, PIECE
    for plain in _streams(data):
        held.append(plain.decode("latin-1"))
        size += len(plain)
        if size >= due:
            text = "".join(held)
            cut = max((m.end() for m in _SAFE.finditer(text, max(0, size - (1 << 16)))), default=0)
            cut = cut or max((m.end() for m in _SAFE.finditer(text)), default=0)
            if cut:
                yield text[:cut]
                text = text[cut:]
            held, size = [text], len(text)
            due = PIECE if cut else 2 * size
    if size:
        yield "".join(held)


def _decoded(text: str, origin: Origin) -> Iterator[tuple[str, Origin, str]]:
    """Layers of the base64 runs of a text: each decoded from its first four characters on, and inflated where it can be."""
    for m in _BLOB.finditer(text):
        run, s = m[0], m.start()
        kept = None
        if "\n" in run:  # wrapped: numbers of the characters that count
            kept = [i for i, c in enumerate(run) if c not in "\r\n"]
            run = _BREAK.sub("", run)
        run = run.translate(_URL_SAFE)
        place = (lambda i, s=s: s + i) if kept is None else (lambda i, s=s, kept=kept: s + kept[i])
        for k in range(4):
            n = len(run) - k
            n -= n % 4 == 1
            if n < 8:
                break
            data = binascii.a2b_base64(run[k : k + n] + "=" * (-n % 4))
            span = (_at(origin, place(0 if len(run) - n <= 3 else k))[0], _at(origin, place(len(run) - 1))[1])
            for plain in _pieces(data):
                yield plain, (lambda i, span=span: span), "base64/inflate"

            def back(i: int, k=k, n=n, place=place) -> tuple[int, int]:
                lo, hi = k + i * 4 // 3, min(k + (i * 4 + 4) // 3, k + n - 1)
                return _at(origin, place(lo))[0], _at(origin, place(hi))[1]

            yield data.decode("latin-1"), back, "base64"


def _worth(layer: str) -> bool:
    """Whether a decoded layer can hold a secret or a further layer; what is no text hardly does."""
    return bool(_HEX.search(layer) or _BLOB.search(layer) or _ESCAPE.search(layer) or "AKIA" in layer or ((":" in layer or "=" in layer) and any(k in layer.lower() for k in _KEYWORD)))


def layered(text: str) -> list[tuple[str, int, int, str]]:
    """Secrets of the layers below the text, as ``(kind, start, end, path)``."""
    found, seen = set(), set()
    work: list[tuple[str, Origin, str, int]] = [(text, None, "", 0)]
    while work:
        layer, origin, path, escapes = work.pop()
        if origin is not None:
            found.update((k, origin(s)[0], origin(e - 1)[1] + 1, path[1:]) for k, s, e in base_spans(layer))
        new = []
        if ("%" in layer or "\\" in layer or "&#" in layer) and (got := _unescaped(layer, origin)) is not None:
            if escapes >= ROUNDS:
                got = (*_fixpoint(got[0], got[1]), got[2])
            new.append((got[0], got[1], f"{path}/{got[2]}", escapes + 1))
        for plain, back, name in _decoded(layer, origin):
            if plain and _worth(plain):
                new.append((plain, back, f"{path}/{name}", 0))
        for item in new:
            if item[0]:
                key = (hashlib.blake2b(item[0].encode("utf-8", "surrogatepass"), digest_size=16).digest(), item[1](0)[0], item[1](len(item[0]) - 1)[1])
                if key not in seen:
                    seen.add(key)
                    work.append(item)
    return sorted(found, key=lambda d: (d[1], d[0], d[2], d[3]))


def _beyond(deep: list, base: list) -> list:
    """Those of ``deep`` that lie in no base span of their kind; base spans of a kind don't overlap."""
    spans = {k: sorted(b[1:] for b in base if b[0] == k) for k in KINDS}
    starts = {k: [s for s, _ in v] for k, v in spans.items()}
    inside = lambda k, s, e: (at := bisect_right(starts[k], s)) > 0 and spans[k][at - 1][1] >= e
    return [d for d in deep if not inside(*d[:3])]


def joined(spans) -> str:
    """``kind:start:end`` by start, then kind as listed."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, decoded string"


def _scan(batches):
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            text = text or ""
            base = base_spans(text)
            deep = layered(text)
            deep = _beyond(deep, base) if deep else deep
            listed = joined(base)
            every = joined({*base, *(d[:3] for d in deep)}) if deep else listed
            count = [sum(k == b[0] for b in base) for k in KINDS]
            rows.append((*count, hashlib.sha256(listed.encode()).hexdigest(), every, ",".join(f"{k}:{s}:{e}:{p}" for k, s, e, p in deep)))
        cols = list(zip(*rows)) if rows else [[]] * 6
        kinds = [pa.int64()] * 3 + [pa.string()] * 3
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "decoded"])


def secrets(docs: DataFrame) -> DataFrame:
    """One row for each of ``docs(doc_id, text)``: base counts and digest, all spans, and those of deeper layers with their path."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, OUT)


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    return secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
