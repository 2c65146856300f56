"""Secret scans through nested encodings.

Three patterns are run over a text, then over every layer that can be unwrapped from it: the text with its URL
escapes decoded, the text with its Unicode and character escapes decoded, the content of each base64 run and of each
gzip, zlib, bzip2 or xz stream, which may start anywhere, have several members or be cut. A base64 run is read over
line breaks, and line by line, and between '/', '-' and '_', each from its first four characters on, as what stands
before it may look like a part of it; so a span may come up cut at such a place beside the whole one. Layers go to a worklist until it is empty. A layer that came up
before with the same content at the same place isn't taken up again, so data that unpack to themselves end too.
Decoded bytes are taken as one character each: all patterns are of ASCII characters, which look the same in UTF-8,
Latin-1 and between binary data. Stretches of UTF-16 and UTF-32 are layers too. Only bytes in which nothing can
match, as no 16 ASCII characters follow each other, are left.
Each layer carries, for each character, where in the outermost text it comes from, and spans are mapped back.

Streams unpack step by step, of any of zlib's window sizes, and in streams too. What one unpacks to is a layer of its own up to
WINDOW bytes. More is read in windows that overlap by OVERLAP, as often as needed, so a text that expands a thousandfold takes
the memory of a few windows. All of it stands for the same span, so it only matters whether a kind matches in it. What starts
in a window and goes on beyond it, as a stream, a base64 run or a stretch of UTF-16 in a stream, is read to its end from
the content itself, once, and later windows go on behind it.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Kinds in their order, their patterns, and how long a match must be to count.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE = 12

URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
#: A line break in base64, also one written as an escape, with the blanks around it.
BREAK = re.compile(r"[ \t]*(?:\r\n?|\n|\\r\\n|\\n)[ \t]*")
#: Base64 in lines of any length, LEAST_RUN characters or more if it's one line only.
LEAST_RUN = 16
BASE64 = re.compile(rf"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{{{LEAST_RUN},}}+|[A-Za-z0-9+/_-]++(?={BREAK.pattern}[A-Za-z0-9+/_-]))(?:{BREAK.pattern}[A-Za-z0-9+/_-]++)*={{0,2}}")
PIECE = re.compile(rf"[A-Za-z0-9+]{{{LEAST_RUN},}}")
#: A zlib stream starts with its window's size and a second byte that makes both divisible by 31; none that need a dictionary.
ZLIB = b"|".join(b"%b[%b]" % (re.escape(bytes([a])), b"".join(b"\\x%02x" % b for b in range(256) if (a * 256 + b) % 31 == 0 and not b & 32)) for a in range(0x08, 0x80, 0x10))
STREAM = re.compile(rb"(?P<gzip>\x1f\x8b\x08)|(?P<zlib>%b)|(?P<bzip2>BZh[1-9])|(?P<xz>\xfd7zXZ\0)" % ZLIB)
STREAM_START = re.compile(re.sub(rb"\(\?P<\w+>(\\\(|[^)])*?\)", lambda m: m[0][m[0].index(b">") + 1 : -1], STREAM.pattern))  # without groups, so faster to search
STREAM_TEXT = re.compile(STREAM_START.pattern.decode("latin-1"))
#: The longest of these starts. Members of two kinds may be padded.
START, PADDED, ZEROS = 6, ("gzip", "xz"), re.compile(rb"\0*")
OPEN = {"gzip": lambda: zlib.decompressobj(31), "zlib": zlib.decompressobj, "bzip2": bz2.BZ2Decompressor, "xz": lambda: lzma.LZMADecompressor(lzma.FORMAT_XZ)}
#: Bytes given to a decompressor and taken from it at once; of a window of a stream's content, and what two of these share.
STEP, TAKEN, WINDOW, OVERLAP = 1 << 12, 1 << 20, 1 << 22, 1 << 18
BROKEN = (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError)
#: The shortest match, or encoding of one, has 16 characters of ASCII in a row, which in UTF-16 and UTF-32 stand between NULs.
ASCII = r"[\t\n\r\x20-\x7e]"
WIDE = [(name, zeros, re.compile(rf"(?:\0{{{zeros}}})?(?:{ASCII}\0{{{zeros}}}){{15,}}{ASCII}?")) for name, zeros in (("utf16", 1), ("utf32", 3))]
LIVE = re.compile(rf"{ASCII}{{16}}|(?:{ASCII}\0){{15}}|(?:{ASCII}\0\0\0){{15}}".encode())
LIVE_TEXT = re.compile(LIVE.pattern.decode())
#: Of base64 in a long content: what starts a run over lines, a line and a part of one, how each goes on, and what may come yet to a break.
RUNS = {
    "run": (BASE64, re.compile(rf"[A-Za-z0-9+/_-]*+(?:{BREAK.pattern}[A-Za-z0-9+/_-]++)*")),
    "line": (re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST_RUN},}}"), re.compile(r"[A-Za-z0-9+/_-]*")),
    "piece": (PIECE, re.compile(r"[A-Za-z0-9+]*")),
}
UNDONE = re.compile(r"[ \t]*(?:\\(?:r\\?)?|(?:\r\n?|\n|\\r\\n|\\n)[ \t]*)?\Z")
#: Blanks beyond BLANKS in a row, which patterns take any number of; the longest start of a match with fewer that says nothing yet.
BLANKS, UNTOLD = 64, 256
MANY = re.compile(rf"\x20{{{BLANKS + 1},}}")

Span = tuple[int, int, int]
Parts = Callable[[], Iterable]


class Layer:
    """A text and, for each of its characters, the span of the outermost text that it stands for (None: itself)."""

    __slots__ = ("hi", "lo", "path", "stop", "text")

    def __init__(self, text: str, lo: np.ndarray | None = None, hi: np.ndarray | None = None, path: str = "", stop: int | None = None):
        self.text, self.lo, self.hi, self.path = text, lo, hi, path
        self.stop = stop  # where the layer's run ends in the outermost text, if padding stands behind its last character

    def place(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.lo is None else (int(self.lo[start]), int(self.hi[end - 1]))

    def key(self) -> tuple:
        return hashlib.sha256(self.text.encode("utf-8", "surrogatepass")).digest(), self.place(0, len(self.text))

    def spans(self) -> Iterator[Span]:
        for start, kind, end in matches(self.text):
            a, b = self.place(start, end)
            yield a, kind, b


class Long:
    """A content of more than WINDOW characters, read in parts of text from its start whenever it's asked for; all of it stands for one span."""

    __slots__ = ("hi", "kinds", "lo", "parts", "path")

    def __init__(self, parts: Parts, lo: int, hi: int, path: str):
        self.parts, self.lo, self.hi, self.path = parts, lo, hi, path

    def key(self) -> tuple:
        """As of a layer; finds out on the way which kinds match."""
        digest, self.kinds, tail, at = hashlib.sha256(), set(), "", 0
        for x in self.parts():
            digest.update(x.encode("utf-8", "surrogatepass"))
            text, again = MANY.sub(" " * BLANKS, tail + x), 0
            if LIVE_TEXT.search(text):
                self.kinds.update(kind for kind, pattern in ((1, ACCESS), (2, HEX)) if kind not in self.kinds and pattern.search(text))
                for m in () if 0 in self.kinds else ASSIGN.finditer(text, at):
                    if m.end(2) - m.start(2) >= LEAST_VALUE:
                        self.kinds.add(0)
                        break
                    again = m.end() if m.end() < len(text) else m.start()
            again = max(again, at)
            tail = text[-UNTOLD:]
            at = max(0, again - len(text) + len(tail))
        return digest.digest(), (self.lo, self.hi)

    def spans(self) -> Iterator[Span]:
        return ((self.lo, kind, self.hi) for kind in sorted(self.kinds))


def matches(text: str) -> Iterator[Span]:
    """(start, kind's number, end) of what counts: per kind leftmost, not overlapping, long enough."""
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= LEAST_VALUE:
            yield m.start(), 0, m.end()
    for kind, pattern in ((1, ACCESS), (2, HEX)):  # their runs are maximal, so the least length can be in the pattern
        for m in pattern.finditer(text):
            yield m.start(), kind, m.end()


def _replaced(layer: Layer, found: list[tuple[int, int, list[tuple[str, int, int]]]], path: str) -> Layer:
    """The layer with spans replaced by characters, each given with its own span."""
    n = len(layer.text)
    lo = layer.lo if layer.lo is not None else np.arange(n)
    hi = layer.hi if layer.hi is not None else np.arange(1, n + 1)
    texts, los, his, at = [], [], [], 0
    for start, end, chars in found:
        texts += [layer.text[at:start], "".join(c for c, _, _ in chars)]
        los += [lo[at:start], np.array([lo[a] for _, a, _ in chars], np.int64)]
        his += [hi[at:start], np.array([hi[b - 1] for _, _, b in chars], np.int64)]
        at = end
    return Layer("".join([*texts, layer.text[at:]]), np.concatenate([*los, lo[at:]]), np.concatenate([*his, hi[at:]]), f"{layer.path}>{path}")


def _bytes_meant(m: re.Match) -> str:
    return bytes.fromhex(m[0].replace("%", "")).decode("latin-1")


def _character_meant(m: re.Match) -> str:
    """The character that an escape stands for, itself if for none."""
    number = int(m[m.lastindex], 10 if m.lastindex == 6 else 16)
    return chr(number) if number < 0x110000 and not 0xD800 <= number < 0xE000 else m[0]


def _url(layer: Layer) -> Iterator[Layer]:
    found = []
    for m in URL.finditer(layer.text):
        found.append((m.start(), m.end(), [(c, at, at + 3) for c, at in zip(_bytes_meant(m), range(m.start(), m.end(), 3), strict=True)]))
    if found:
        yield _replaced(layer, found, "url")


def _unicode(layer: Layer) -> Iterator[Layer]:
    found = []
    for m in ESCAPE.finditer(layer.text):
        if (c := _character_meant(m)) != m[0]:
            found.append((m.start(), m.end(), [(c, m.start(), m.end())]))
    if found:
        yield _replaced(layer, found, "unicode")


def _wide(layer: Layer) -> Iterator[Layer]:
    """Stretches of ASCII characters in UTF-16 or UTF-32 of either byte order, wherever they start."""
    if "\0" not in layer.text:
        return
    for name, zeros, pattern in WIDE:
        for m in pattern.finditer(layer.text):
            at = np.arange(m.start() + zeros * (m[0][0] == "\0"), m.end(), zeros + 1)
            # A character at both ends: the last is half of another one (low byte first), or the first is (high byte first).
            for mine in (at[:-1], at[1:]) if m[0][0] != "\0" != m[0][-1] else (at,):
                lo, hi = np.maximum(mine - zeros * (m[0][0] == "\0"), m.start()), mine + 1 + zeros * (m[0][0] != "\0")
                hi = np.minimum(hi, m.end())
                if layer.lo is not None:
                    lo, hi = layer.lo[lo], layer.hi[hi - 1]
                yield Layer("".join(layer.text[i] for i in mine), lo, hi, f"{layer.path}>{name}")


def _between(parts: Iterable, start: int, end: int | None = None) -> Iterator:
    """The parts of a content from one place of it to another."""
    at = 0
    for x in parts:
        if end is not None and at >= end:
            return
        if at + len(x) > start and len(x):
            yield x[max(0, start - at) : None if end is None else end - at]
        at += len(x)


def _held(parts: Iterable, join: bytes | str) -> bytes | str | None:
    """The parts joined, None if they are too long; they're read to the end anyway."""
    held, n = [], 0
    for x in parts:
        n += len(x)
        if n > WINDOW:
            held.clear()
        else:
            held.append(x)
    return join.join(held) if n <= WINDOW else None


def _as_bytes(parts: Parts) -> Iterator[bytes]:
    return (x.encode("latin-1", "replace") for x in parts())


def _as_text(parts: Parts) -> Iterator[str]:
    return (x.decode("latin-1") for x in parts())


def _fed(stream, data: bytes | memoryview, taken: int | None = None) -> Iterator[bytes]:
    """What comes out of a decompressor for some bytes, a bounded piece at a time."""
    part = data
    while True:
        out = stream.decompress(part, taken or TAKEN)
        if out:
            yield out
        part = getattr(stream, "unconsumed_tail", b"")
        if stream.eof or not (out or part):  # bzip2 may give less than it could
            return


def _readable(kind: str, parts: Parts, start: int, bad: int, given: int) -> Iterator[bytes]:
    """Of a stream in which the STEP from bad on can't be read, what comes out behind the first given bytes. Returns where it breaks.

    A call that fails gives nothing of what came out before, so it's read byte by byte, then the output of the last byte is.
    """
    for taken in (TAKEN, 1 << 10, 1):
        stream, n = OPEN[kind](), 0
        for x in _between(parts(), start, bad):
            for at in range(0, len(x), STEP):
                for out in _fed(stream, x[at : at + STEP]):
                    n += len(out)
        try:
            for x in _between(parts(), bad, bad + STEP):
                for at in range(len(x)):
                    for out in _fed(stream, x[at : at + 1], taken):
                        if n + len(out) > given:
                            yield out[max(0, given - n) :]
                        n += len(out)
                        given = max(given, n)
                    bad += 1
        except BROKEN:
            pass
    return bad


def _unpacked(kind: str, parts: Parts, start: int, ends: list | None = None) -> Iterator[bytes]:
    """The content of the streams that follow each other from a place on, as far as it can be read.

    Ends gets where they end, whether all are whole, and whether more bytes behind the last part could go on with them.
    """
    source, at, held = _between(parts(), start), start, memoryview(b"")
    ends = [] if ends is None else ends
    ends[:] = start, False, False
    while True:
        out_of = False
        while len(held) < START and not out_of:
            x = next(source, None)
            out_of, held = x is None, held if x is None else memoryview(bytes(held) + x) if held else memoryview(x)
        if not ((m := STREAM.match(held)) and m.lastgroup == kind):
            ends[2] = out_of
            return
        stream, begin, given = OPEN[kind](), at, 0
        while True:
            used = 0
            while used < len(held) and not stream.eof:
                step = held[used : used + STEP]
                try:
                    for out in _fed(stream, step):
                        given += len(out)
                        yield out
                except BROKEN:
                    good = yield from _readable(kind, parts, begin, at + used, given)
                    ends[:] = good, False, False
                    return
                used += len(step)
            if stream.eof:
                used -= len(stream.unused_data)
            at, held = at + used, held[used:]
            if stream.eof:
                break
            if (x := next(source, None)) is None:
                ends[:] = at, False, True
                return
            held = memoryview(x)
        ends[:] = at, True, False
        while kind in PADDED:
            n = ZEROS.match(held).end()
            at, held = at + n, held[n:]
            if held or (x := next(source, None)) is None:
                break
            held = memoryview(x)


def _streams(data: bytes, begin: int, limit: int, beyond: Parts | None = None, offset: int = 0) -> Iterator[tuple[str, int, int, bool, bytes | None, Parts]]:
    """The compressed streams that start in data before limit, wherever they do; members that follow each other are one.

    Given as kind, start, end, whether to go on behind it, the content if it isn't long, and the content's parts. One that goes on
    beyond the data is read there, if they are a part of something longer: from offset on, of which beyond gives all.
    """
    view = memoryview(data)
    while (m := STREAM_START.search(data, begin)) and m.start() < limit:
        ends: list = []
        m = STREAM.match(data, m.start())
        parts = partial(_unpacked, m.lastgroup, partial(iter, [view]), m.start())
        content = _held(parts(ends), b"")
        if ends[2] and beyond is not None:
            start = offset + m.start()
            parts = partial(_unpacked, m.lastgroup, beyond, start)
            content = _held(parts(ends), b"")
            if ends[0] - start <= 4 * WINDOW:  # kept, so that streams in streams aren't read again and again
                parts = partial(_unpacked, m.lastgroup, partial(iter, [b"".join(_between(beyond(), start, ends[0]))]), 0)
            ends[0] -= offset
        begin = max(ends[0], m.start() + 1) if ends[1] else m.start() + 1
        yield m.lastgroup, m.start(), max(ends[0], m.start() + 1), begin, content, parts


def _constant(text: str, lo: int, hi: int, path: str, stop: int | None = None) -> Iterator[Layer]:
    """A layer that stands for one span, if anything can be found in it."""
    if LIVE_TEXT.search(text) or STREAM_TEXT.search(text):
        yield Layer(text, np.broadcast_to(lo, len(text)), np.broadcast_to(hi, len(text)), path, stop)


def _packed(layer: Layer) -> Iterator[Layer | Long]:
    """The contents of compressed streams."""
    if not STREAM_TEXT.search(layer.text):
        return
    data = layer.text.encode("latin-1", "replace")
    for kind, start, end, _, content, parts in _streams(data, 0, len(data)):
        lo, hi = layer.place(start, end)  # a compressed byte depends on all others
        hi = layer.stop if end == len(data) and layer.stop is not None else hi
        if content is None:
            yield Long(partial(_as_text, parts), lo, hi, f"{layer.path}>{kind}")
        else:
            yield from _constant(content.decode("latin-1"), lo, hi, f"{layer.path}>{kind}", hi)


def _runs(layer: Layer) -> Iterator[tuple[str, np.ndarray, int]]:
    """Base64 characters, where in the layer each stands, and where the run ends with its padding."""
    for m in BASE64.finditer(layer.text):
        end = m.start() + len(m[0].rstrip("="))
        lines, at = [], m.start()
        for x in BREAK.finditer(layer.text, m.start(), end):
            lines.append((at, x.start()))
            at = x.end()
        lines.append((at, end))
        if len(lines) > 1:
            run = "".join(layer.text[a:b] for a, b in lines)
            if len(run) >= LEAST_RUN:
                yield run, np.concatenate([np.arange(a, b) for a, b in lines]), m.end()
        for a, b in lines:
            if b - a >= LEAST_RUN:
                yield layer.text[a:b], np.arange(a, b), m.end() if b == end else b
                for x in PIECE.finditer(layer.text, a, b):
                    if x.span() != (a, b):
                        yield x[0], np.arange(x.start(), x.end()), m.end() if x.end() == end else x.end()


def _decoded(run: str) -> bytes:
    return base64.b64decode(run[: len(run) - (len(run) % 4 == 1)] + "=" * (-len(run) % 4 % 3))


def _base64(layer: Layer) -> Iterator[Layer]:
    for run, index, end in _runs(layer):
        run = run.replace("-", "+").replace("_", "/")
        for phase in range(4):
            data = _decoded(run[phase:])
            if not LIVE.search(data) and not STREAM_START.search(data):
                continue
            at = np.arange(len(data))
            lo, hi = index[phase + at * 4 // 3], index[phase + (at * 4 + 6) // 3 - 1] + 1
            if layer.lo is not None:
                lo, hi = layer.lo[lo], layer.hi[hi - 1]
            yield Layer(data.decode("latin-1"), lo, hi, f"{layer.path}>base64", layer.place(end - 1, end)[1])


def _until(parts: Parts, start: int, more: re.Pattern, open_at: Callable[[str, int], bool]) -> int:
    """Where what goes on by a pattern from a place of a content on ends."""
    at, held, blanks = start, "", 0
    for x in _between(parts(), start):
        held += x
        n = more.match(held).end()
        at += n + (blanks if n else 0)
        if not open_at(held, n):
            return at
        held, blanks = held[n:], 0 if n else blanks
        short = MANY.sub(" " * BLANKS, held)
        held, blanks = short, blanks + len(held) - len(short)
    return at


def _meant(parts: Parts, pattern: re.Pattern, meant: Callable[[re.Match], str]) -> Iterator[str]:
    """The parts with escapes replaced, which are of up to 10 characters."""
    held = ""
    for x in parts():
        held += x
        m = re.compile(r"[%\\&]").search(held, max(0, len(held) - 10))
        cut = m.start() if m else len(held)
        yield pattern.sub(meant, held[:cut])
        held = held[cut:]
    yield pattern.sub(meant, held)


def _run_parts(parts: Parts, start: int, end: int, phase: int) -> Iterator[str]:
    """What a base64 run of a content decodes to from one of its first four characters on."""
    held, run, skip = "", "", phase
    for x in _between(parts(), start, end):
        held = re.sub(r"[ \t\r\n]", "", held + x)
        m = re.search(r"(?:\\(?:r\\?)?)?\Z", held)
        chars, held = re.sub(r"\\r\\n|\\n", "", held[: m.start()]), held[m.start() :]
        run += chars[skip:].replace("-", "+").replace("_", "/")
        skip = max(0, skip - len(chars))
        n = len(run) // 4 * 4
        yield _decoded(run[:n]).decode("latin-1")
        run = run[n:]
    yield _decoded(run).decode("latin-1")


def _every(parts: Parts, start: int, end: int, step: int) -> Iterator[str]:
    at = start
    for x in _between(parts(), start, end):
        yield x[(start - at) % step :: step]
        at += len(x)


def _windows(parts: Iterable[str]) -> Iterator[tuple[str, int, bool]]:
    """The parts joined in windows, where each starts, and whether it's the last."""
    held, n, at = [], 0, 0
    for x in parts:
        if n >= WINDOW:
            whole = "".join(held)
            yield whole, at, False
            held = [whole[-OVERLAP:]]
            at += n - OVERLAP
            n = OVERLAP
        held.append(x)
        n += len(x)
    yield "".join(held), at, True


def _inside(long: Long) -> Iterator[Layer | Long]:
    """All layers of a long content. What starts in a window's last OVERLAP is left to the next one, which has more of it."""
    escapes, begin = {}, dict.fromkeys(["packed", *(name for name, _, _ in WIDE), *RUNS], 0)

    def inner(parts: Parts, path: str) -> Iterator[Layer | Long]:
        text = _held(parts(), "")
        if text is None:
            yield Long(parts, long.lo, long.hi, f"{long.path}>{path}")
        else:
            yield from _constant(text, long.lo, long.hi, f"{long.path}>{path}")

    for text, at, last in _windows(long.parts()):
        limit = len(text) if last else len(text) - OVERLAP
        first = lambda name: max(0, begin[name] - at)  # noqa: B023, E731
        if STREAM_TEXT.search(text, first("packed")):
            for kind, _, _, behind, content, parts in _streams(text.encode("latin-1", "replace"), first("packed"), limit, None if last else partial(_as_bytes, long.parts), at):
                begin["packed"] = at + behind
                if content is None:
                    yield Long(partial(_as_text, parts), long.lo, long.hi, f"{long.path}>{kind}")
                else:
                    yield from _constant(content.decode("latin-1"), long.lo, long.hi, f"{long.path}>{kind}")
        for name, pattern, meant in (("url", URL, _bytes_meant), ("unicode", ESCAPE, _character_meant)):
            if name not in escapes and any(meant(m) != m[0] for m in pattern.finditer(text)):
                escapes[name] = partial(_meant, long.parts, pattern, meant)
        if not LIVE_TEXT.search(text):
            continue
        for name, zeros, pattern in WIDE if "\0" in text else ():
            while (m := pattern.search(text, first(name))) and m.start() < limit:
                start, low = at + m.start() + zeros * (m[0][0] == "\0"), m[0][0] != "\0"
                end = at + m.end()
                if not last and m.end() + zeros >= len(text):
                    units = re.compile(rf"(?:{ASCII}\0{{{zeros}}})*+")
                    end = _until(long.parts, start, units, lambda held, n, zeros=zeros: len(held) - n <= zeros)
                    end += bool(re.match(ASCII, "".join(_between(long.parts(), end, end + 1))))
                begin[name] = end
                odd = low and (end - start) % (zeros + 1) == 1  # a character at both ends, as above
                for a, b in ((start, end - 1), (start + zeros + 1, end)) if odd else ((start, end),):
                    if end <= at + len(text):
                        yield from _constant(text[a - at : b - at : zeros + 1], long.lo, long.hi, f"{long.path}>{name}")
                    else:
                        yield from inner(partial(_every, long.parts, a, b, zeros + 1), name)
        for name, (pattern, more) in RUNS.items():
            while (m := pattern.search(text, first(name))) and m.start() < limit:
                start, n = at + m.start(), m.start() + len(m[0].rstrip("="))
                open_at = (lambda held, n: bool(UNDONE.match(held, n))) if name == "run" else (lambda held, n: n == len(held))
                if not last and open_at(text, n):
                    end = _until(long.parts, start, more, open_at)
                    begin[name] = max(end, start + 1)
                    for phase in range(4):
                        yield from inner(partial(_run_parts, long.parts, start, end, phase), "base64")
                    continue
                begin[name] = at + m.end()
                run = text[m.start() : n]
                if name == "run":
                    if run == (run := BREAK.sub("", run)) or len(run) < LEAST_RUN:
                        continue
                elif name == "piece" and not {text[m.start() - 1 : m.start()] if m.start() else "/", text[n : n + 1]} & set("/_-"):
                    continue
                run = run.replace("-", "+").replace("_", "/")
                for phase in range(4):
                    yield from _constant(_decoded(run[phase:]).decode("latin-1"), long.lo, long.hi, f"{long.path}>base64")
    for name, parts in escapes.items():
        yield from inner(parts, name)


def _search(top: Layer | Long, found: dict[Span, str], seen: set[tuple]) -> None:
    """Add the spans of the layers in top."""
    work = deque([top])
    while work:
        layer = work.popleft()
        long = isinstance(layer, Long)
        for inner in _inside(layer) if long else (x for unwrap in (_url, _unicode, _wide, _packed, _base64) for x in unwrap(layer)):
            if long and all((layer.lo, kind, layer.hi) in found for kind in range(len(KINDS))):
                break  # there is no other span in it
            if (key := inner.key()) in seen:
                continue
            seen.add(key)
            for span in inner.spans():
                found.setdefault(span, inner.path[1:])
            if long:  # not kept for later, as there may be very many
                _search(inner, found, seen)
            else:
                work.append(inner)


def scan(text: str) -> tuple[list[Span], dict[Span, str]]:
    """Spans of the text itself, and all spans with the way to the layer that first showed them."""
    top = Layer(text)
    base = sorted(matches(text))
    found = dict.fromkeys(base, "")
    _search(top, found, {top.key()})
    return base, found


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("path", T.StringType())]))


@F.arrow_udf(T.StructType([T.StructField("base", _SPANS), T.StructField("spans", _SPANS)]))
def _scan_all(text: pa.Array) -> pa.Array:
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("path", pa.string())])
    rows = []
    for x in text.to_pylist():
        base, found = scan(x or "")
        show = lambda s, path: {"kind": KINDS[s[1]], "start": s[0], "end": s[2], "path": path}
        rows.append({"base": [show(s, "") for s in base], "spans": [show(s, found[s]) for s in sorted(found)]})
    return pa.array(rows, pa.struct([("base", pa.list_(kind)), ("spans", pa.list_(kind))]))


def secret_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input rows and columns with _secrets: base (spans of the text) and spans (of all layers, base ones too).

    Spans are in code points of the whole text, end exclusive, sorted by start, then kind as listed, then end;
    path says through which layers a span was reached. Null is as empty, which has none. Rows are independent;
    repeated rows, nulls elsewhere and further columns pass through; no rows give no rows.
    """
    return docs.withColumn("_secrets", _scan_all(F.coalesce(docs[text], F.lit(""))))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base, spans = F.col("_secrets.base"), F.col("_secrets.spans")
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return secret_spans(docs).select("doc_id", *map(count, KINDS), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"))
