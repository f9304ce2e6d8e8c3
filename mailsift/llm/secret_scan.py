"""Secret scans: a worklist of layers, each the decoded form of a part of an earlier one.

The text is the first layer. Each layer is searched for secrets and for encoded parts: percent
escapes and Unicode escapes (the layer is taken over with the escapes replaced), base64 runs (the
decoded part is a layer of its own), and compressed data under base64 or under percent or byte
escapes. Compressed data is unpacked again while a header matches, with all members that follow each
other in a stream. An escape that is itself escaped many times over (``%252525...41``) is undone down to
the last but one level at once. A layer that was already met at the same place of the text is not
taken again, so the work ends also where a part decodes to itself. A base64 run is decoded in all
four alignments and over the breaks of wrapped lines; decoded bytes need not be text, and a
compressed stream may begin anywhere in them. A run begins with 16 characters in a line at least.
Spans of every layer are mapped to code points of the text; each layer knows the places of its
characters in the text, so a map is not followed through the layers above.

Defined results: a null text is empty and holds no secret; equal rows give equal rows; other
columns are neither read nor returned by ``scan_secrets`` and are kept as they are by
``redact_secrets``. Whole texts are searched, and all of a compressed part: one that unpacks to more than
``WINDOW`` bytes is searched in windows that overlap by ``OVERLAP``, of which one is held at a time. Such
parts are counted in ``n_cut`` (a stream inside one may be cut by a window's end), and
``redact_secrets`` replaces their whole run.
"""

from __future__ import annotations

import base64
import bz2
import html
import lzma
import re
import zlib
from collections.abc import Iterator
from hashlib import blake2b
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import map_batches, map_stream, texts_of

# The three kinds of secret, in this order, and their patterns.
KINDS = ["assign", "access", "hex"]
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the maximal runs of 24 or more
ASSIGN_VALUE, ACCESS_LENGTH = 6, 20

# The first alternatives are escapes of the sign that begins an escape, any number of times.
PERCENT = re.compile(r"%(?:25)+(?=[0-9A-Fa-f]{2})|(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(
    r"\\(?:x5[cC])+(?=x[0-9A-Fa-f]{2})|\\(?:u005[cC])+(?=u[0-9A-Fa-f]{4})|&(?:#(?:38|[xX]26);)+(?=#)"
    r"|(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|(?:\\x[0-9A-Fa-f]{2})+"
    r"|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});"
)
BASE64 = re.compile(r"([A-Za-z0-9+/_-]{16,})={0,2}")
# A further line of a base64 run: a break, real or escaped, and characters up to the line's end.
LINE = re.compile(
    r"[ \t]*(?:\r\n?|\n|\\r\\n|\\n)[ \t>]*([A-Za-z0-9+/_-]+)"
    r"(?:={1,2}|(?=[ \t]*(?:[\r\n]|\\[rn]|\Z)|[\"'<>()\[\]{},;.]))"
)
#: Bytes written as escapes, as languages print them.
BYTE_ESCAPE = re.compile(r"\\x[0-9A-Fa-f]{2}|\\[abtnvfr0\\'\"]")
PERCENT_BYTE = re.compile(r"%[0-9A-Fa-f]{2}")
UNPRINTED = re.compile(r"(?:%|\\x)(?:[01]|[89A-Fa-f])[0-9A-Fa-f]")
LEAST_UNPRINTED = 4  # escapes of bytes that are no ASCII characters, without which nothing is packed
NEAR = 16  # bytes of a stream among which one is escaped
WINDOW = 1 << 26  # unpacked bytes that are searched at once
OVERLAP = 1 << 16
MASK = "[SECRET]"

Span = tuple[str, int, int]


def find_in(text: str) -> list[Span]:
    """Secrets as they stand in a text: kind, start, end in code points."""
    found = [
        ("assign", m.start(), m.end())
        for m in ASSIGN.finditer(text)
        if m.end(2) - m.start(2) >= ASSIGN_VALUE
    ]
    if "AKIA" in text:
        found += [
            ("access", m.start(), m.end())
            for m in ACCESS.finditer(text)
            if m.end() - m.start() >= ACCESS_LENGTH
        ]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


class Layer:
    """A decoded text and where each of its characters stands in the text of the row.

    ``lo`` and ``hi`` are arrays of first positions and ends, or two numbers where all characters
    stand for the same part. In the text of the row itself they are None.
    """

    def __init__(self, text: str, lo=None, hi=None):
        self.text, self.lo, self.hi = text, lo, hi

    def to_row(self, start: int, end: int) -> tuple[int, int]:
        if self.lo is None:
            return start, end
        if isinstance(self.lo, int):
            return self.lo, self.hi
        return int(self.lo[start]), int(self.hi[max(start, end - 1)])

    def places(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """First positions and ends of a range of characters."""
        if self.lo is None:
            return np.arange(start, end), np.arange(start + 1, end + 1)
        if isinstance(self.lo, int):
            return np.full(end - start, self.lo), np.full(end - start, self.hi)
        return self.lo[start:end], self.hi[start:end]


class Run:
    """Places of the characters of a base64 run, worked out when a decoded part needs them."""

    def __init__(self, layer: Layer, lines: list[tuple[int, int]]):
        self.layer, self.lines, self.found = layer, lines, None

    def part(self, skip: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of bytes ``a`` to ``b`` of what is decoded from character ``skip`` on: those of
        the characters that hold their bits."""
        if self.found is None:
            own = [self.layer.places(*line) for line in self.lines]
            self.found = np.concatenate([x for x, _ in own]), np.concatenate([x for _, x in own])
        lo, hi = self.found
        first = skip + np.arange(a, b) * 8 // 6
        last = skip - (-np.arange(a + 1, b + 1) * 8 // 6) - 1
        return lo[first], hi[np.minimum(np.maximum(last, first), len(hi) - 1)]


def percent_chars(run: str) -> list[tuple[str, int]]:
    """Characters of a run of percent escapes and the length of the escapes of each."""
    if len(run) > 3 and run.count("%") == 1:
        return [("%", len(run))]
    raw = bytes.fromhex(run.replace("%", ""))
    return [(c, 3 * size) for c, size in utf8_chars(raw)]


def utf8_chars(raw: bytes) -> list[tuple[str, int]]:
    """Characters of bytes with their sizes; a byte that is no UTF-8 counts as Latin-1."""
    try:
        return [(c, len(c.encode())) for c in raw.decode()]
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    out.append((raw[at : at + size].decode(), size))
                    break
                except UnicodeDecodeError:
                    continue
            else:
                size = 1
                out.append((chr(raw[at]), 1))
            at += size
        return out


def valid(code: int) -> str:
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"


def escape_chars(run: str) -> list[tuple[str, int]]:
    """Characters of a run of Unicode escapes and the length of the escapes of each."""
    if run.count("#") > 1 or (run.count("\\") == 1 and len(run) > (6 if run[1] == "u" else 4) and run[1:4] in ("x5c", "x5C", "u00")):
        return [(run[0], len(run))]
    if run.startswith("&"):
        return [(html.unescape(run), len(run))]
    if run.startswith("\\u{"):
        return [(valid(int(run[3:-1], 16)), len(run))]
    if run.startswith("\\U"):
        return [(valid(int(run[2:], 16)), len(run))]
    if run.startswith("\\x"):
        return [(c, 4 * size) for c, size in utf8_chars(bytes.fromhex(run.replace("\\x", "")))]
    units = [int(u, 16) for u in run.split("\\u")[1:]]
    out, at = [], 0
    while at < len(units):
        high, low = units[at], units[at + 1] if at + 1 < len(units) else 0
        if 0xD800 <= high < 0xDC00 <= low < 0xE000:
            out.append((chr(0x10000 + ((high - 0xD800) << 10) + low - 0xDC00), 12))
            at += 2
        else:
            out.append((valid(high), 6))
            at += 1
    return out


def replaced(layer: Layer, pattern: re.Pattern, chars) -> Layer | None:
    """The layer with all escapes of a pattern replaced; None where there are none."""
    text, out, los, his = layer.text, [], [], []
    fixed = isinstance(layer.lo, int)
    end = 0
    found: tuple[list[int], list[int]] = ([], [])

    def flush() -> None:
        if found[0]:
            los.append(np.array(found[0]))
            his.append(np.array(found[1]))
            found[0].clear()
            found[1].clear()

    for m in pattern.finditer(text):
        if m.start() > end:
            out.append(text[end : m.start()])
            if not fixed:
                flush()
                lo, hi = layer.places(end, m.start())
                los.append(lo)
                his.append(hi)
        at = m.start()
        for c, width in chars(m[0]):
            out.append(c)
            if not fixed:
                lo, hi = layer.to_row(at, at + width)
                found[0].extend([lo] * len(c))
                found[1].extend([hi] * len(c))
            at += width
        end = m.end()
    if not end:
        return None
    out.append(text[end:])
    if fixed:
        return Layer("".join(out), layer.lo, layer.hi)
    flush()
    lo, hi = layer.places(end, len(text))
    return Layer("".join(out), np.concatenate([*los, lo]), np.concatenate([*his, hi]))


def opener(raw: bytes, at: int):
    """A decompressor for the stream that begins there, by its header; None if none begins."""
    head = raw[at : at + 6]
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(lzma.FORMAT_XZ)
    if head[:4] == ZSTD:
        return zstandard.ZstdDecompressor().decompressobj()
    if len(head) > 1 and head[0] & 143 == 8 and (head[0] << 8 | head[1]) % 31 == 0:
        return zlib.decompressobj(15)
    return None


class Stream:
    """The stream that begins at a byte, all members that follow each other included.

    After :meth:`windows` ``end`` is where it ends and ``broken`` whether it broke off. A stream that
    breaks off or fails later on gives what stands before; under the two bytes of a zlib header,
    which texts have by chance too, one that fails gives nothing.
    """

    def __init__(self, raw: bytes, at: int):
        self.raw, self.end, self.broken = raw, at, False

    def windows(self) -> Iterator[bytes]:
        """The unpacked bytes, at most about ``WINDOW`` at a time; none if no stream begins there."""
        raw, view, held, at = self.raw, memoryview(self.raw), bytearray(), self.end
        fresh = 0  # bytes held that no window had yet
        while (tool := opener(raw, at)) is not None:
            is_zstd = raw[at : at + 4] == ZSTD
            weak = not is_zstd and raw[at] & 143 == 8
            end, step, own, before = at, FEED_ZSTD if is_zstd else FEED, 0, len(held)
            try:
                while not tool.eof and end < len(raw):
                    given = view[end : end + step]
                    end += len(given)
                    while True:
                        got = tool.decompress(given) if is_zstd else tool.decompress(given, PIECE)
                        held += got
                        own, fresh = own + len(got), fresh + len(got)
                        if len(held) >= WINDOW:
                            yield bytes(held)
                            del held[: -min(OVERLAP, len(held) // 2)]
                            fresh, before = 0, -1
                        given = getattr(tool, "unconsumed_tail", b"")
                        if tool.eof or not (given or (got and not is_zstd)):
                            break
            except FAILURES:
                if before >= 0 and (weak or not own):
                    fresh -= len(held) - before
                    del held[before:]
                    break
            if not (own or tool.eof):
                break
            self.broken = not tool.eof
            at = self.end = len(raw) if self.broken else end - len(tool.unused_data)
        if fresh > 0:
            yield bytes(held)


Part = tuple[str, tuple[int, int], bytes]


def _streams(part: bytes, place: tuple[int, int] | None, begins) -> Iterator[Part]:
    """What bytes hold: ``below`` unpacked bytes of streams, ``cut`` streams of several windows, and
    ``bytes`` what stands between streams, each with its place."""
    at = plain = 0
    while (m := HEADER.search(part, at)) is not None:
        at = m.start() + 1
        if not begins(m.start()):
            continue
        stream = Stream(part, m.start())
        windows = stream.windows()
        ahead = [w for w in (next(windows, None), next(windows, None)) if w is not None]
        if not ahead:
            continue
        several = len(ahead) > 1
        own = place or (m.start(), len(part) if several else stream.end)
        if several:
            yield "cut", own, b""
        for window in chain(ahead, windows):
            yield "below", own, window
        if not stream.broken:
            if plain < m.start():
                yield "bytes", place or (plain, m.start()), part[plain : m.start()]
            plain = at = stream.end
    if plain < len(part):
        yield "bytes", place or (plain, len(part)), part[plain:]


def opened(raw: bytes, begins=lambda at: True) -> Iterator[tuple[str, tuple[int, int], bytes]]:
    """The parts of bytes, unpacked until no header matches: ``bytes`` as they stand, ``packed`` from
    streams, and ``cut`` places. Streams may begin anywhere that ``begins`` allows; those that break off
    are taken as plain bytes too. Bytes that were met at a place are not taken again there."""
    work, met = [_streams(raw, None, begins)], set()
    while work:
        found = next(work[-1], None)
        if found is None:
            work.pop()
            continue
        kind, place, part = found
        if kind == "below":
            if (key := (place, blake2b(part).digest())) not in met:
                met.add(key)
                work.append(_streams(part, place, lambda at: True))
        elif kind == "bytes" and len(work) > 1:
            yield "packed", place, part
        else:
            yield found


def _zlib_headers() -> bytes:
    """A pattern for the two bytes of every zlib header without a preset dictionary."""
    pairs = [
        bytes([a]) + bytes([b])
        for a in range(8, 128, 16)
        for b in range(256)
        if (a << 8 | b) % 31 == 0 and not b & 32
    ]
    return b"|".join(map(re.escape, pairs))


HEADER = re.compile(
    rb"\x1f\x8b\x08|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\x00|\x28\xb5\x2f\xfd|" + _zlib_headers(),
    re.DOTALL,
)
FAILURES = (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError, ValueError)
ZSTD = b"\x28\xb5\x2f\xfd"
FEED, FEED_ZSTD, PIECE = 1 << 16, 1 << 8, 1 << 20  # zstd has no bound on what a call returns


def starts_line(text: str, at: int) -> bool:
    while at and text[at - 1] in " \t>":
        at -= 1
    return not at or text[at - 1] in "\r\n" or text[max(0, at - 2) : at] in ("\\n", "\\r")


def base64_runs(text: str):
    """The base64 runs of a text, each as the spans of its lines and its end with the padding.

    Lines that follow each other and hold nothing else are one run: all of the first one's width,
    but for the last one, which may be shorter, and the first one, where other text stands before.
    """
    at = 0
    while (m := BASE64.search(text, at)) is not None:
        start, end, padded = m.start(), m.end(1), m.end()
        if text[start - 1 : start] == "\\" and text[start] in "nr":
            start += 1
        lines = [(start, end)]
        width = end - start if starts_line(text, start) else None
        while padded == end and (n := LINE.match(text, end)) is not None:
            size = n.end(1) - n.start(1)
            if width is not None and size > width:
                break
            lines.append(n.span(1))
            end, padded = n.end(1), n.end()
            if width is not None and size < width:
                break
            width = size
        yield lines, padded
        at = padded


def base64_layers(layer: Layer) -> Iterator[Layer | tuple[int, int]]:
    """Layers under the base64 runs of a layer, and the places of parts of several windows.

    What stands before a run may belong to its alphabet, so each run is decoded from each of its
    first four characters. Bytes are read as Latin-1: all that is searched for is ASCII, and a
    position is a byte then, whatever the bytes around it are.
    """
    for lines, end in base64_runs(layer.text):
        text = "".join([layer.text[a:b] for a, b in lines]).translate(URL_SAFE)
        run = Run(layer, lines)
        _, stop = layer.to_row(max(0, end - 1), end)
        for skip in range(4):
            size = len(text) - skip
            size -= size % 4 == 1
            raw = base64.b64decode(text[skip : skip + size] + "=" * (-size % 4))
            for kind, (a, b), part in opened(raw):
                if kind == "bytes":
                    yield Layer(part.decode("latin-1"), *run.part(skip, a, b))
                    continue
                lo, hi = run.part(skip, a, b)
                first, last = int(lo[0]), stop if b == len(raw) else int(hi[-1])
                yield (first, stop) if kind == "cut" else Layer(part.decode("latin-1"), first, last)


def escaped_streams(layer: Layer, pattern: re.Pattern) -> Iterator[Layer | tuple[int, int]]:
    """Layers of compressed data whose bytes are written as escapes, other characters as themselves."""
    text, raw, firsts, at = layer.text, bytearray(), [], 0
    for m in pattern.finditer(text):
        raw += text[at : m.start()].encode("latin-1", "replace")
        firsts.extend(range(at, m.start()))
        raw.append(_byte(m[0]))
        firsts.append(m.start())
        at = m.end()
    raw += text[at:].encode("latin-1", "replace")
    firsts.extend(range(at, len(text) + 1))

    def begins(at: int) -> bool:
        to = min(at + NEAR, len(raw))
        return firsts[to] - firsts[at] > to - at

    for kind, (a, b), part in opened(bytes(raw), begins):
        if kind != "bytes":
            place = layer.to_row(firsts[a], firsts[b])
            yield place if kind == "cut" else Layer(part.decode("latin-1"), *place)


_ESCAPED = dict(zip("abtnvfr0", b"\a\b\t\n\v\f\r\0"))


def _byte(escape: str) -> int:
    if len(escape) > 2:
        return int(escape[-2:], 16)
    return _ESCAPED.get(escape[1], ord(escape[1]))


def layers_below(layer: Layer) -> Iterator[Layer | tuple[int, int]]:
    """All layers directly under a layer, and the places of parts of several windows."""
    yield from base64_layers(layer)
    percent, back = "%" in layer.text, "\\" in layer.text
    if (percent or back) and sum(1 for _ in islice(UNPRINTED.finditer(layer.text), LEAST_UNPRINTED)) == LEAST_UNPRINTED:
        if percent:
            yield from escaped_streams(layer, PERCENT_BYTE)
        if back:
            yield from escaped_streams(layer, BYTE_ESCAPE)
    if percent and (child := replaced(layer, PERCENT, percent_chars)) is not None:
        yield child
    if (back or "&#" in layer.text) and (child := replaced(layer, ESCAPE, escape_chars)) is not None:
        yield child


URL_SAFE = str.maketrans("-_", "+/")


def all_spans(text: str) -> tuple[list[Span], list[Span], int]:
    """Base secrets, secrets of all layers (base ones included), number of parts of several windows."""
    base, spans, cuts = scanned(text)
    return base, spans, len(cuts)


def scanned(text: str) -> tuple[list[Span], list[Span], list[tuple[int, int]]]:
    """As ``all_spans``, with the places of the parts of several windows."""
    base = sorted_spans(find_in(text))
    spans, all_cuts = set(base), []
    # One path of layers is held at a time: a layer's own layers come before the next one beside it.
    work, met = [layers_below(Layer(text))], {(blake2b(text.encode("utf-8", "surrogatepass")).digest(), 0, len(text))}
    while work:
        child = next(work[-1], None)
        if child is None:
            work.pop()
        elif isinstance(child, tuple):
            all_cuts.append(child)
        else:
            name = blake2b(child.text.encode("utf-8", "surrogatepass")).digest()
            if not child.text or (key := (name, *child.to_row(0, len(child.text)))) in met:
                continue
            met.add(key)
            spans.update((k, *child.to_row(a, b)) for k, a, b in find_in(child.text))
            work.append(layers_below(child))
    return base, sorted_spans(spans), all_cuts


def sorted_spans(spans) -> list[Span]:
    """By start, then kind as listed, then end."""
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def masked(text: str, spans: list[Span], mask: str = MASK) -> str:
    """The text with every span replaced; spans that touch or overlap count as one."""
    out, end, open_until = [], 0, -1
    for _, a, b in spans:
        if a > open_until:
            out += [text[end:a], mask]
        open_until = end = max(open_until, b)
    return "".join([*out, text[end:]])


_SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
_SPAN_TYPE = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
)


def _records(spans: list[Span]) -> list[dict]:
    return [{"kind": k, "start": a, "end": b} for k, a, b in spans]


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, base, spans, n_cut``: spans as stated in the text, and of all layers."""

    def setup():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [all_spans(t) for t in texts_of(batch.column(1))]
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([_records(f[0]) for f in found], _SPAN_TYPE),
                    pa.array([_records(f[1]) for f in found], _SPAN_TYPE),
                    pa.array([f[2] for f in found], pa.int64()),
                ],
                [id_col, "base", "spans", "n_cut"],
            )

        return work

    chosen = df.select(id_col, text_col)
    kind = chosen.schema[0].dataType.simpleString()
    return map_batches(
        chosen, setup, f"`{id_col}` {kind}, base {_SPANS}, spans {_SPANS}, n_cut bigint"
    )


def redacted(text: str, mask: str = MASK) -> str:
    """The text without secrets, and without packed parts of several windows."""
    _, spans, cuts = scanned(text)
    return masked(text, sorted([*spans, *[("cut", a, b) for a, b in cuts]], key=lambda s: s[1]), mask)


def redact_secrets(df: DataFrame, text_col: str = "text", mask: str = MASK) -> DataFrame:
    """All rows and columns of ``df``; every span in the text is replaced. A null stays null."""
    position = df.columns.index(text_col)

    def setup():
        def clean(text: str | None) -> str | None:
            if not text:
                return text
            return redacted(text, mask)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = list(batch.columns)
            texts = columns[position].to_pylist()
            columns[position] = pa.array([clean(t) for t in texts], columns[position].type)
            return pa.RecordBatch.from_arrays(columns, batch.schema.names)

        return work

    def run(batches):
        work = setup()
        for batch in batches:
            yield work(batch)

    return map_stream(df, run, df.schema)


def span_list(spans: str):
    """Spans as ``kind:start:end`` joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
