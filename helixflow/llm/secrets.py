"""Secret scans with a recursive decoding worklist.

A text is layer 0. Each layer is scanned for the three kinds of secrets and for encoded parts: percent-encoded
bytes, Unicode, octal and HTML escapes (all decoded in place, so that what stands around them stays), and base64 runs,
those of a line as well as those wrapped over several lines (indented or not), whose content, unpacked where it is compressed (gzip, zlib, zstd, bzip2, xz; all members of a stream), is a layer of
its own. A run is decoded at each of its first four characters, so text glued to its front does not hide it. Bytes that
are no UTF-8 are passed over one by one; the text around them stays. New layers go on the worklist until none is left.
A layer whose content was seen before at the same place is skipped, so a cycle (a compressed file that unpacks to
itself) ends. Each layer keeps, for each of its characters, the range of the original text that it comes from; spans
found in it are reported as that range (of a base64 run: the whole run).

Bombs: what is unpacked from one run of the original text, over all layers, is read up to `expansion` times the run's
length and 1 MB more; None reads everything. The default is above what deflate can reach in one layer (1,032), so only
runs packed several times over, or by the other formats far beyond any text, are cut. Such a run is counted in n_cut;
other runs, and layers that are only encoded, are never cut.

Defined results: null text is empty and has no spans; empty tables give empty results; rows are independent, so
repeated rows give repeated results; texts of any length are scanned whole; columns of these names are replaced.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterator
from html.entities import html5
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import strings, with_arrays, with_schema

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_HINTS = ("passw", "secret", "token", "key")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\[uU]([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});|\\([0-3][0-7]{2})|&([A-Za-z][A-Za-z0-9]{1,30};)")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[ \t]*[A-Za-z0-9+/_-]++)+={0,2}")
_BREAK = re.compile(r"\r?\n[ \t]*")
#: The shortest stretch of bytes that can hold a secret or an encoded one.
_STRETCH = re.compile(rb"[\x20-\x7e]{12,}")
_ESCAPE_HINT = re.compile(r"\\[uUx0-3][0-9A-Fa-f{]|&[#A-Za-z]")
EXPANSION = 1040
_MEGABYTE = 1 << 20
_NO_LIMIT = 1 << 62


class Span(NamedTuple):
    start: int
    kind: int
    end: int


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that are long enough, by start, then kind."""
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [Span(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [Span(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [Span(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


class Layer(NamedTuple):
    """Decoded text; character i comes from original[from_[i]:to[i]], or all of it from one range (of the original: from_ is None)."""

    text: str
    from_: np.ndarray | int | None
    to: np.ndarray | int | None

    def place(self, start: int, end: int) -> tuple[int, int]:
        if self.from_ is None:
            return start, end
        if isinstance(self.from_, int):
            return self.from_, self.to
        return int(self.from_[start]), int(self.to[end - 1])


def _in_place(layer: Layer, starts: np.ndarray, ends: np.ndarray, new: np.ndarray) -> Layer:
    """layer with each part (starts .. ends) replaced by one character of the codes new."""
    codes = np.frombuffer(layer.text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    codes[starts] = new
    edges = np.zeros(len(codes) + 1, np.int64)
    edges[starts + 1] += 1
    edges[ends] -= 1
    keep = np.cumsum(edges[:-1]) == 0
    text = codes[keep].tobytes().decode("utf-32-le", "surrogatepass")
    if isinstance(layer.from_, int):
        return Layer(text, layer.from_, layer.to)
    from_ = np.arange(len(codes)) if layer.from_ is None else layer.from_
    to = np.arange(1, len(codes) + 1) if layer.to is None else layer.to.copy()
    to[starts] = to[ends - 1]
    return Layer(text, from_[keep], to[keep])


def _percent(layer: Layer) -> Layer | None:
    """Runs of encoded bytes are decoded where they are UTF-8; other bytes stay as they are."""
    starts, ends, new = [], [], []
    for m in _PERCENT.finditer(layer.text):
        found = bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape")
        codes = np.frombuffer(found.encode("utf-32-le", "surrogatepass"), np.uint32)
        good = (codes < 0xD800) | (codes > 0xDFFF)
        size = 3 * np.where(good, 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF), 1).astype(np.int64)
        stop = m.start() + np.cumsum(size)
        starts.append((stop - size)[good])
        ends.append(stop[good])
        new.append(codes[good])
    if not sum(map(len, new)):
        return None
    return _in_place(layer, np.concatenate(starts), np.concatenate(ends), np.concatenate(new))


def _escapes(layer: Layer) -> Layer | None:
    parts = []
    for m in _ESCAPE.finditer(layer.text):
        if m[7]:
            name = html5.get(m[7], "")
            code = ord(name) if len(name) == 1 else 0x110000
        else:
            code = int(m[5]) if m[5] else int(m[6], 8) if m[6] else int(m[1] or m[2] or m[3] or m[4], 16)
        if code < 0x110000 and not 0xD800 <= code < 0xE000:
            parts.append((m.start(), m.end(), code))
    return _in_place(layer, *(np.array(x) for x in zip(*parts))) if parts else None


#: First bytes of compressed streams, and what makes a decompressor of one member.
PACKED: tuple[tuple[bytes, Callable], ...] = (
    (b"\x1f\x8b", lambda: zlib.decompressobj(31)),
    (b"\x28\xb5\x2f\xfd", lambda: zstandard.ZstdDecompressor().decompressobj()),
    (b"BZh", bz2.BZ2Decompressor),
    (b"\xfd7zXZ\x00", lzma.LZMADecompressor),
)


def _unpacker(raw: bytes) -> Callable | None:
    for magic, make in PACKED:
        if raw.startswith(magic):
            return make
    if len(raw) > 2 and raw[0] == 0x78 and (raw[0] * 256 + raw[1]) % 31 == 0:
        return zlib.decompressobj
    return None


def _unpack(raw: bytes, limit: int) -> tuple[bytes, bool] | None:
    """(content of compressed bytes up to limit, whether there was more); None: not compressed, or broken from the start.

    All members are read; of a broken stream, what came before the fault.
    """
    make = _unpacker(raw)
    if make is None:
        return None
    out, n = [], 0
    while raw and make is not None:
        d = make()
        for at in range(0, len(raw), 1 << 12):
            try:
                # what a few KB unpack to fits into memory for each of these formats
                part = d.decompress(raw[at : at + (1 << 12)])
            except (zlib.error, zstandard.ZstdError, OSError, EOFError, lzma.LZMAError):
                return (b"".join(out), False) if n else None
            out.append(part[: max(0, limit - n)])
            n += len(part)
            if n > limit:
                return b"".join(out), True
            if d.eof:
                raw = d.unused_data + raw[at + (1 << 12) :]
                break
        else:
            break
        make = _unpacker(raw)
    return b"".join(out), False


class _Room:
    """How much may still be unpacked from each range of the original."""

    def __init__(self, expansion: int | None) -> None:
        self.expansion = expansion
        self.left: dict[tuple[int, int], int] = {}
        self.cut: set[tuple[int, int]] = set()

    def unpacked(self, raw: bytes, place: tuple[int, int]) -> bytes:
        """raw, unpacked as often as it is compressed."""
        seen = set()
        while True:
            most = _NO_LIMIT if self.expansion is None else self.expansion * (place[1] - place[0]) + _MEGABYTE
            left = self.left.setdefault(place, most)
            found = _unpack(raw, left)
            if found is None:
                return raw
            raw, more = found
            self.left[place] = left - len(raw)
            if more:
                self.cut.add(place)
            key = hashlib.sha256(raw).digest()
            if more or key in seen:
                return raw
            seen.add(key)


def _runs(layer: Layer, room: _Room) -> Iterator[Layer]:
    runs = [(m[0], m.span()) for m in _BASE64.finditer(layer.text)]
    if "\n" in layer.text:
        runs += [(_BREAK.sub("", m[0]), m.span()) for m in _WRAPPED.finditer(layer.text)]
    for run, span in runs:
        body = run.rstrip("=").replace("-", "+").replace("_", "/")
        place = layer.place(*span)
        for skip in range(4):
            part = body[skip:]
            part = part[: len(part) - (len(part) % 4 == 1)]
            raw = room.unpacked(base64.b64decode(part + "=" * (-len(part) % 4)), place)
            if _STRETCH.search(raw):
                yield Layer(raw.decode("utf-8", "replace"), *place)


def scan(text: str, expansion: int | None = EXPANSION) -> tuple[list[Span], list[Span], int, int]:
    """(base spans, all spans, number of layers, ranges whose content was not read to its end) of a text."""
    base = base_spans(text)
    work, seen, every, layers, room = [Layer(text, None, None)], set(), set(base), 0, _Room(expansion)
    while work:
        layer = work.pop()
        layers += 1
        if layer.from_ is not None:
            for s in base_spans(layer.text):
                a, b = layer.place(s.start, s.end)
                every.add(Span(a, s.kind, b))
        new = []
        if "%" in layer.text and (x := _percent(layer)):
            new.append(x)
        if _ESCAPE_HINT.search(layer.text) and (x := _escapes(layer)):
            new.append(x)
        for x in (*new, *_runs(layer, room)):
            key = (hashlib.sha256(x.text.encode("utf-8", "surrogatepass")).digest(), x.place(0, 1)) if x.text else None
            if key and key not in seen:
                seen.add(key)
                work.append(x)
    return base, sorted(every), layers, len(room.cut)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


RESULT = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_layers bigint, n_cut bigint"


def find_secrets(docs: DataFrame, text_col: str = "text", expansion: int | None = EXPANSION) -> DataFrame:
    """docs with n_assign, n_access, n_hex (base spans of each kind), base_sha256, spans, n_layers and n_cut.

    Columns of docs with these names are replaced.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for text in strings(batch.column(text_col)):
                base, every, layers, cut = scan(text, expansion)
                kinds = [s.kind for s in base]
                row = (kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), layers, cut)
                for c, v in zip(cols, row):
                    c.append(v)
            types = (pa.int64(),) * 3 + (pa.string(), pa.string(), pa.int64(), pa.int64())
            names = [x.split()[0] for x in RESULT.split(", ")]
            yield with_arrays(batch, {n: pa.array(c, t) for n, c, t in zip(names, cols, types)})

    return docs.mapInArrow(run, with_schema(docs, RESULT))


def masked(docs: DataFrame, text_col: str = "text", mask: str = "*", expansion: int | None = EXPANSION) -> DataFrame:
    """docs with each character of a secret span in text_col replaced by mask; nothing else changes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(text_col).to_pylist():
                if text:
                    every = scan(text, expansion)[1]
                    parts, at = [], 0
                    for s in every:
                        if s.end > at:
                            parts += [text[at : max(at, s.start)], mask * (s.end - max(at, s.start))]
                            at = s.end
                    text = "".join([*parts, text[at:]])
                out.append(text)
            i = batch.schema.get_field_index(text_col)
            yield batch.set_column(i, batch.schema.field(i), pa.array(out, batch.schema.field(i).type))

    return docs.mapInArrow(run, docs.schema)
