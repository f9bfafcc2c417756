"""Secret scans with a recursive decoding worklist.

A text is scanned as it stands and then layer by layer: URL escapes, Unicode escapes, base64 runs and compressed data
inside either are unwrapped until nothing new appears; nothing is cut unless the caller sets ``most``. Every layer knows, for each of its characters, the stretch of the
original text it came from, so a find in any layer is reported as a span of the original. A layer whose content and
place were seen before is not opened again, so nested or self-reproducing encodings come to an end.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import mmap
import re
import tempfile
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

KINDS = ("assign", "access", "hex")
#: A layer beyond this size waits in a file instead of memory, and is read and written in pieces of STEP bytes.
IN_MEMORY = 8 << 20
STEP = 1 << 20
SHORTEST = 12                      # characters in the shortest secret

_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")          # the longest run is taken, so this is "20 or more"
_HEX = re.compile(r"[0-9a-f]{24,}")

_VALUE = rb"[A-Za-z0-9+/_.=-]"
#: The same kinds in bytes, and a word that each needs.
_INNER = (("assign", re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""" + _VALUE + rb"{6,}"), None),
          ("access", re.compile(rb"AKIA[A-Z0-9]{16,}"), b"AKIA"), ("hex", re.compile(rb"[0-9a-f]{24,}"), None))

_URL = re.compile(rb"%([0-9A-Fa-f]{2})")
_UNICODE = re.compile(rb"\\(?:u([0-9A-Fa-f]{4})|u\{([0-9A-Fa-f]{1,6})\}|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2}))")
#: The shortest secret has 12 characters, so 16 in base64. A run that ends a line may go on in the next one, at any width.
_BASE64 = re.compile(rb"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}+(?:\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)*+|[A-Za-z0-9+/_-]++(?:\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)++)={0,2}")
_PLAIN = bytes.maketrans(b"-_", b"+/")
_STRETCH = re.compile(rb"[\t\n\r\x20-\x7e]{12,}")
#: The same in UTF-16 and UTF-32.
_WIDE = re.compile(rb"(?:[\t\n\r\x20-\x7e]\0){12,}|(?:\0[\t\n\r\x20-\x7e]){12,}|(?:[\t\n\r\x20-\x7e]\0{3}){12,}|(?:\0{3}[\t\n\r\x20-\x7e]){12,}")
_PACKED = re.compile(rb"(?P<gzip>\x1f\x8b\x08)|(?P<zlib>\x78[\x01\x5e\x9c\xda])|(?P<bz2>BZh[1-9](?:1AY&SY|\x17rE8P\x90))|(?P<xz>\xfd7zXZ\0)|(?P<zstd>\x28\xb5\x2f\xfd)")
_MAGIC = (b"\x1f\x8b\x08", b"x\x01", b"x\x5e", b"x\x9c", b"x\xda", b"BZh", b"\xfd7zXZ\0", b"\x28\xb5\x2f\xfd")
_PADDING = re.compile(rb"\0+")
_BREAKS = dict.fromkeys(b"\t\n\r")


class Runs:
    """Where the bytes of a rewritten layer came from, run by run: byte ``i`` of a run came from ``[begin + i, begin + i + width)``.

    Text between two escapes is one run and every escape one more, so room is needed for escapes and not for characters.
    """

    __slots__ = ("start", "begin", "width", "size")

    def __init__(self):
        self.start, self.begin, self.width, self.size = array("q"), array("q"), array("q"), 0

    def add(self, n: int, begin: int, width: int) -> None:
        if n <= 0:
            return
        goes_on = self.size and width == self.width[-1] == 1 and self.begin[-1] + self.size - self.start[-1] == begin
        if not goes_on:
            self.start.append(self.size)
            self.begin.append(begin)
            self.width.append(width)
        self.size += n

    def origin(self, i: int) -> tuple[int, int]:
        r = bisect_right(self.start, i) - 1
        at = self.begin[r] + i - self.start[r]
        return at, at + self.width[r]

    def part(self, a: int, b: int) -> Iterator[tuple[int, int, int]]:
        """The runs in ``[a, b)`` as ``add`` takes them."""
        r = bisect_right(self.start, a) - 1
        while a < b:
            last = min(b, self.start[r + 1] if r + 1 < len(self.start) else self.size)
            yield last - a, self.begin[r] + a - self.start[r], self.width[r]
            a, r = last, r + 1


class Layer:
    """Bytes unwrapped from a text.

    All patterns are ASCII, so other characters of the text stand as ``?``. ``begin`` is None for the text itself, the
    ``Runs`` its bytes came from, or a number where all bytes came from the same stretch, ``[begin, end)``.
    """

    __slots__ = ("data", "begin", "end")

    def __init__(self, data, begin=None, end=None):
        self.data, self.begin, self.end = data, begin, end

    @property
    def mapped(self) -> bool:
        return not isinstance(self.begin, int)

    def span(self, a: int, b: int) -> tuple[int, int]:
        if self.begin is None:
            return a, b
        return (self.begin.origin(a)[0], self.begin.origin(b - 1)[1]) if self.mapped else (self.begin, self.end)

    def finds(self) -> set[tuple[int, str, int]]:
        found = set()
        for kind, pattern, word in _INNER:
            if word is None or self.data.find(word) >= 0 or kind == "assign":
                for m in pattern.finditer(self.data):
                    a, b = self.span(m.start(), m.end())
                    found.add((a, kind, b))
                    if not self.mapped:
                        break
        return found


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """``(start, kind, end)`` of the three base kinds, leftmost and not overlapping within a kind."""
    found = []
    if ("=" in text or ":" in text):
        found += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


class _Spool:
    """Collects bytes, in an unnamed file once they are many; ``done`` gives them as bytes or as a memory map."""

    def __init__(self):
        self.head, self.file, self.size = bytearray(), None, 0

    def write(self, piece: bytes) -> None:
        self.size += len(piece)
        if self.file is None and self.size > IN_MEMORY:
            self.file = tempfile.TemporaryFile()
            self.file.write(self.head)
        (self.head.extend if self.file is None else self.file.write)(piece)

    def copy(self, data, a: int, b: int) -> None:
        for at in range(a, b, STEP):
            self.write(data[at:min(at + STEP, b)])

    def done(self):
        if self.file is None:
            return bytes(self.head)
        self.file.flush()
        return mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)


def _rewritten(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every escape decoded in place to one byte; None if there is none."""
    data, at, out, runs = layer.data, 0, _Spool(), Runs()

    def keep(a: int, b: int) -> None:
        out.copy(data, a, b)
        if layer.begin is None:
            runs.add(b - a, a, 1)
        elif layer.mapped:
            for run in layer.begin.part(a, b):
                runs.add(*run)

    for m in pattern.finditer(data):
        keep(at, m.start())
        out.write(decode(m))
        if layer.mapped:
            first, last = layer.span(m.start(), m.end())
            runs.add(1, first, last - first)
        at = m.end()
    if not at:
        return None
    keep(at, len(data))
    return Layer(out.done(), runs) if layer.mapped else Layer(out.done(), layer.begin, layer.end)


def _url(m: re.Match) -> bytes:
    return bytes((int(m[1], 16),))


def _unicode(m: re.Match) -> bytes:
    code = int(m[1] or m[2] or m[3] or m[4], 16)
    return bytes((code,)) if code < 256 else b"?"


def _inflate(data, at: int, most: int | None):
    """What the compressed streams from ``at`` on hold, back to back; where they end; whether cut at ``most`` bytes.

    The end is None when the last stream breaks off or is damaged: what came before is kept.
    """
    out, cut = _Spool(), False
    while not cut and (m := _PACKED.match(data, at)):
        kind = m.lastgroup
        if kind == "zlib" and (data[at] << 8 | data[at + 1]) % 31:
            break
        unfold = {"gzip": lambda: zlib.decompressobj(wbits=31), "zlib": zlib.decompressobj, "bz2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor,
                  "zstd": lambda: zstandard.ZstdDecompressor(max_window_size=1 << 31).decompressobj()}[kind]()
        step, pos, chunk = (1 << 10 if kind == "zstd" else 1 << 16), at, b""
        try:
            while not unfold.eof and not cut:
                if not chunk and getattr(unfold, "needs_input", True):
                    chunk = data[pos:pos + step]
                    pos += len(chunk)
                    if not chunk:
                        break
                piece = unfold.decompress(chunk) if kind == "zstd" else unfold.decompress(chunk, STEP)
                chunk = unfold.unconsumed_tail if kind in ("gzip", "zlib") else b""
                if most is not None and out.size + len(piece) > most:
                    piece, cut = piece[:most - out.size], True
                out.write(piece)
            if kind in ("gzip", "zlib") and not unfold.eof and not cut:
                out.write(unfold.flush())
        except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError):
            return out.done(), None, cut
        if not unfold.eof:
            return out.done(), None, cut
        at = pos - len(unfold.unused_data)
        if m := _PADDING.match(data, at):              # zeros may fill up between streams
            at = m.end() if _PACKED.match(data, m.end()) else at
    return out.done(), at, cut


def _unpacked(data, most: int | None):
    """``(start, end, content, cut)`` of compressed data anywhere in ``data``."""
    at = 0 if any(data.find(w) >= 0 for w in _MAGIC) else len(data)
    while m := _PACKED.search(data, at):
        content, end, cut = _inflate(data, m.start(), most)
        if len(content) >= SHORTEST:
            yield m.start(), end or len(data), content, cut
        at = m.start() + 1 if end is None else max(end, m.start() + 1)


def _wide(data) -> Iterator[re.Match]:
    """Stretches of two or four bytes a character."""
    if data.find(b"\0") >= 0:
        yield from _WIDE.finditer(data)


def _decoded(chars: bytes) -> bytes:
    chars = chars[:-1] if len(chars) % 4 == 1 else chars
    return binascii.a2b_base64(chars + b"=" * (-len(chars) % 4))


def _joined(data, a: int, b: int, skip: int):
    """The base64 characters in ``[a, b)`` decoded from the ``skip``-th on, line ends left out."""
    out, rest = _Spool(), b""
    for at in range(a, b, STEP):
        rest += data[at:min(at + STEP, b)].translate(_PLAIN, b" \t\r\n=")
        if skip:
            rest, skip = rest[skip:], max(0, skip - len(rest))
        whole = len(rest) // 4 * 4
        out.write(binascii.a2b_base64(rest[:whole]))
        rest = rest[whole:]
    out.write(_decoded(rest))
    return out.done()


def _is_text(data: bytes) -> bool:
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    plain = text.translate(_BREAKS)
    odd = 0 if plain.isprintable() else sum(not c.isprintable() for c in plain)
    return bool(text) and odd * 10 <= len(text)


def _good(data: bytes) -> int:
    """How many of the bytes are UTF-8, a last character that is not whole included."""
    try:
        data.decode("utf-8")
    except UnicodeDecodeError as e:
        return len(data) if e.reason == "unexpected end of data" else e.start
    return len(data)


def _readings(chars: bytes, starts: list[int]) -> Iterator[tuple[int, int, bytes]]:
    """Lines, or as many lines in a row as go together, that decode to text: ``(start, end, text)`` in ``chars``."""
    ends, i = [*starts[1:], len(chars)], 0
    while i < len(starts):
        j, more = i, 1
        while True:                                    # twice as many lines each time, until one is no text
            last = min(i + more, len(starts)) - 1
            good = starts[i] + (_good(_decoded(chars[starts[i]:ends[last]])) * 4 + 3) // 3
            j = bisect_right(ends, good, i, last + 1) - 1
            if j < last or last == len(starts) - 1:
                break
            more *= 2
        if j > i and (ends[j] - starts[i]) % 4 == 1:  # no base64 has that length
            j -= 1
        if j >= i and ends[j] - starts[i] >= 16 and _is_text(text := _decoded(chars[starts[i]:ends[j]])):
            yield starts[i], ends[j], text
        i = max(i, j) + 1


def _blobs(layer: Layer, most: int | None) -> Iterator[tuple[Layer, bool]]:
    """What base64 holds, compressed or not; every byte maps to the run, or stretch of the run, that holds it.

    A run may be glued to its neighbours ('/', '_' and '-' are in the alphabet) and to a word of the next line. Decoded
    from each of four offsets, every part of it appears whole in one of the results, between bytes without meaning.
    """
    for m in _BASE64.finditer(layer.data):
        if m.end() - m.start() < 16:
            continue
        if not layer.mapped:
            for skip in range(4):
                got = _joined(layer.data, *m.span(), skip)
                if _STRETCH.search(got) or next(_wide(got), None) or any(got.find(w) >= 0 for w in _MAGIC):
                    yield Layer(got, layer.begin, layer.end), False
            continue
        run = m.group().rstrip(b"=")
        place = [m.start() + i for i, c in enumerate(run) if c not in b" \t\r\n"]
        chars = run.translate(_PLAIN, b" \t\r\n")
        if len(chars) < 16:
            continue
        starts = [0, *(i for i in range(1, len(place)) if place[i] > place[i - 1] + 1)]

        def stretch(a: int, b: int) -> tuple[int, int]:
            return layer.span(place[a], m.end() if b >= len(chars) else place[b - 1] + 1)

        taken: list[list[tuple[int, int]]] = [[] for _ in range(4)]
        for a, b, text in _readings(chars, starts):
            taken[a % 4].append((a, b))
            yield Layer(text, *stretch(a, b)), False
        for skip in range(4):
            got = _decoded(chars[skip:])

            def held(x: int, y: int, skip=skip) -> tuple[int, int]:
                return skip + x * 4 // 3, min(len(chars), skip - (-y * 4 // 3))

            for x, y, content, cut in _unpacked(got, most):
                yield Layer(content, *stretch(*held(x, y))), cut
            for pattern, found in ((_STRETCH, _STRETCH.finditer(got)), (_WIDE, _wide(got))):
                for s in found:
                    a, b = held(*s.span())
                    k = bisect_right(taken[skip], (a, len(chars) + 1)) - 1
                    if pattern is _STRETCH and k >= 0 and b <= taken[skip][k][1]:
                        continue
                    edge = skip - (skip - a) // 4 * 4         # a few bytes of the neighbour before '/', '_' or '-' are no part of it
                    if a < edge and edge < b and m.group()[place[edge - 1] - m.start()] in b"/_-" and place[a] > m.start():
                        a = edge
                    x = (a - skip) * 3 // 4 if a == edge else s.start()
                    part = got[x:s.end()]
                    if k >= 0 and a < taken[skip][k][1] < b <= taken[skip][k][1] + 4:
                        line = taken[skip][k][1]              # letters of the next line's word that happen to decode are no part of it
                        if len(base_spans(part.decode("latin-1"))) == len(base_spans(part[:(line - a) * 3 // 4].decode("latin-1"))):
                            b = line
                    yield Layer(part.replace(b"\0", b"") if pattern is _WIDE else part, *stretch(a, b)), False


def _unwrapped(layer: Layer, most: int | None) -> Iterator[tuple[Layer, bool]]:
    """The layers one step below."""
    data = layer.data
    for mark, pattern, decode in ((b"%", _URL, _url), (b"\\", _UNICODE, _unicode)):
        if data.find(mark) >= 0 and (got := _rewritten(layer, pattern, decode)):
            yield got, False
    if data.find(b"%") >= 0 and data.find(b"+") >= 0:   # in forms '+' is a space; this matters to compressed bytes only
        form = _Spool()
        for at in range(0, len(data), STEP):
            form.write(data[at:min(at + STEP, len(data))].replace(b"+", b" "))
        if got := _rewritten(Layer(form.done(), layer.begin, layer.end), _URL, _url):
            for a, b, content, cut in _unpacked(got.data, most):
                yield Layer(content, *got.span(a, b)), cut
    yield from _blobs(layer, most)
    if layer.begin is not None:                       # bytes, not characters
        for a, b, content, cut in _unpacked(data, most):
            yield Layer(content, *layer.span(a, b)), cut
        for m in _wide(data):
            yield Layer(m.group().replace(b"\0", b""), *layer.span(*m.span())), False


def scan(text: str, most: int | None = None) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]], int, int]:
    """Base spans, all spans, number of decoded layers, number of layers cut at ``most`` bytes (None: nothing is cut)."""
    base = base_spans(text)
    every, work, seen, layers, cuts = set(base), [_unwrapped(Layer(text.encode("ascii", "replace")), most)], set(), 0, 0
    while work:                                       # depth first: of each depth one layer is held
        got, cut = next(work[-1], (None, False))
        if got is None:
            work.pop()
            continue
        cuts += cut
        if not len(got.data):
            continue
        mark = (hashlib.blake2b(got.data, digest_size=16).digest(), got.span(0, len(got.data)))
        if mark in seen:
            continue
        seen.add(mark)
        layers += 1
        every |= got.finds()
        work.append(_unwrapped(got, most))
    return base, sorted(every, key=lambda s: (s[0], KINDS.index(s[1]), s[2])), layers, cuts


def written_spans(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, cut_layers long"


def find(docs: DataFrame, most: int | None = None) -> DataFrame:
    """One row per document: base counts, digest of the base spans, all spans as ``kind:start:end``, layers opened.

    Positions count code points, ends are exclusive. A span found in several layers is listed once. Null text is an empty
    text (no spans); repeated rows, null ids and ties are rows like any other; no rows give no rows; further columns are
    ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(7)]
            for text in batch.column(1):
                base, every, layers, cuts = scan(text.as_py() or "", most)
                kinds = [s[1] for s in base]
                row = [*(kinds.count(k) for k in KINDS), hashlib.sha256(written_spans(base).encode()).hexdigest(), written_spans(every), layers, cuts]
                for column, value in zip(out, row):
                    column.append(value)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, type=t) for c, t in zip(out, kinds))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers", "cut_layers"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, {FOUND}")


def masked(text: str, most: int | None = None) -> str:
    """The text with every span, overlapping ones joined, replaced by ``[kind]`` of its first kind."""
    every = scan(text, most)[1]
    out, at, i = [], 0, 0
    while i < len(every):
        a, kind, b = every[i]
        i += 1
        while i < len(every) and every[i][0] < b:
            b = max(b, every[i][2])
            i += 1
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, most: int | None = None) -> DataFrame:
    """``docs`` with secrets masked in ``text`` and ``n_chars`` (if there is one) counted anew; all rows and columns stay.

    Null texts stay null and keep their ``n_chars``.
    """
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t.as_py() is None else masked(t.as_py(), most) for t in batch.column(place)]
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, type=batch.column(place).type))

    clean = docs.mapInArrow(run, docs.schema)
    if "n_chars" not in docs.columns:
        return clean
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(kind)))
