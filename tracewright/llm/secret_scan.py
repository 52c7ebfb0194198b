"""Secret scans with a recursive decoding worklist.

Every text is scanned for the base kinds. Then all URL escapes of it, all unicode escapes,
and each encoded region (base64, and gzip, zlib, bzip2 or raw deflate bytes inside base64 or
written as escapes) are unwrapped one after another from a worklist; each decoded layer is scanned again in full and may add further ones.
A layer that was already seen at the same place of its document is not visited twice, so
the worklist ends; the same encoded text at another place is a finding of its own. Findings of a layer are mapped back to code points of the original text.

Defined results: null text is empty (no spans); null ids are kept; rows that repeat a
document fare alike, each with a row of its own; empty tables give empty results; other
columns, whatever their names, are ignored; spans found twice at one place count once. A
very long text is scanned to its end. Bytes that are no text are scanned for their readable
stretches. Compressed bytes are unpacked to their end, all members and all layers inside one
another, in overlapping windows. A secret that is longer than the overlap is found in the
window of its keyword, and all findings there have the region's place. Inside compressed bytes
one run of more than ``HOLD`` base64 characters is decoded in overlapping parts: text in it is
found, a compressed member that crosses parts only as far as its first one. Levels of which
``ALIKE`` begin with the same 4,096 bytes hold themselves and are given up. Raw deflate has no
header: it is looked for where a run begins, and after each of its ``/``, ``_``, ``-`` and ``+``,
of spelled-out bytes after each quote, ``=`` and ``:``.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import re
import zlib
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

from tracewright.llm._common import id_text, map_batches

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: A line end, or one that is spelled out (any number of times).
_NEXT_LINE = re.compile(r"(?:[ \t]*\r?\n[ \t]*|(?:\\+r)?\\+n)([A-Za-z0-9+/_-]+={0,2})")
_SIGN = re.compile(r"[+/]")
_STANDARD = str.maketrans("-_", "+/")
#: gzip, bzip2, and zlib with any window: its second byte makes the first two divisible by 31, and asks for no dictionary.
_ZLIB = [bytes((16 * w + 8, f)) for w in range(8) for f in range(256) if (256 * (16 * w + 8) + f) % 31 == 0 and not f & 32]
_HEADER = re.compile(b"|".join([rb"\x1f\x8b\x08", rb"BZh[1-9]1AY&SY", *map(re.escape, _ZLIB)]), re.DOTALL)
#: The shortest secret ("token=" and six more) has 12 characters; secrets and encoded regions are ASCII.
_STRETCH = re.compile(rb"[\t\n\r\x20-\x7e]{12,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"[\\%]u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\u\{0*([0-9A-Fa-f]{1,6})\}|\\U(00[01][0-9A-Fa-f]{5})")
#: Bytes written as text: escapes among printable characters that stand for themselves.
_URL_BYTES, _URL_BYTE = re.compile("[!-~]+"), re.compile("%([0-9A-Fa-f]{2})()")
_C_BYTES, _C_BYTE = re.compile("[ -~]+"), re.compile(r"""\\(?:x([0-9A-Fa-f]{2})|u00([0-9A-Fa-f]{2})|[abfnrtv0\\'"/])""")
_C_NAMED = dict(zip("abfnrtv0\\'\"/", "\a\b\f\n\r\t\v\0\\'\"/", strict=True))
_OPENED = re.compile(rb"[\"'=:]")
#: Spaces in a row that are kept of decompressed bytes: between a keyword and its value any number may stand.
_SPACES = re.compile(rb" {512,}")
#: Levels of compressed bytes that may begin alike.
ALIKE = 8
#: Decompressed bytes scanned at once, how far windows of them overlap, and how long a run of base64 characters may make one.
PART, OVERLAP, HOLD = 1 << 20, 1 << 16, 1 << 24
_RUN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=\r\n"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base kinds, leftmost non-overlapping per kind."""
    found = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


class _Places:
    """Where the characters of a decoded layer stand in the layer that it was decoded from."""

    def __init__(self) -> None:
        self.at: list[int] = []  # where each piece begins in the decoded layer,
        self.begin: list[int] = []  # where in the other one,
        self.end: list[int] = []  # and where it ends there; -1: copied as it is
        self.text: list[str] = []
        self.size = 0

    def add(self, text: str, begin: int, end: int = -1) -> None:
        if text:
            self.at.append(self.size)
            self.begin.append(begin)
            self.end.append(end)
            self.text.append(text)
            self.size += len(text)

    def span(self, start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        return (
            self.begin[i] + (start - self.at[i] if self.end[i] < 0 else 0),
            self.begin[j] + end - self.at[j] if self.end[j] < 0 else self.end[j],
        )

    def done(self) -> tuple[str, _Places]:
        text, self.text = "".join(self.text), []
        return text, self


def _percent(layer: str) -> tuple[str, _Places]:
    """The layer with all its URL escapes decoded, and where its characters were."""
    out, last = _Places(), 0
    for m in _PERCENT.finditer(layer):
        out.add(layer[last : m.start()], last)
        at = m.start()
        for c in bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape"):
            size = 3 if "\udc80" <= c <= "\udcff" else 3 * len(c.encode("utf-8"))
            out.add(c, at, at + size)
            at += size
        last = m.end()
    out.add(layer[last:], last)
    return out.done()


def _unescape(layer: str) -> tuple[str, _Places]:
    """The same for Unicode escapes."""
    out, last = _Places(), 0
    for m in _UNICODE.finditer(layer):
        out.add(layer[last : m.start()], last)
        code = int(m[1] or m[2] or m[3] or m[4], 16)
        out.add(chr(code) if code < 0x110000 else m[0], m.start(), m.end())
        last = m.end()
    out.add(layer[last:], last)
    return out.done()


class _Bzip2:
    """A bzip2 decompressor with the methods of one of zlib."""

    unconsumed_tail = b""

    def __init__(self) -> None:
        self.own = bz2.BZ2Decompressor()

    def decompress(self, data: bytes, most: int) -> bytes:
        try:
            return self.own.decompress(data, most)
        except OSError as e:
            raise zlib.error(str(e)) from e

    @property
    def eof(self) -> bool:
        return self.own.eof

    @property
    def unused_data(self) -> bytes:
        return self.own.unused_data


def _machine(head: bytes):
    return _Bzip2() if head.startswith(b"BZh") else zlib.decompressobj(47)


def _contents(raw: memoryview, used: list[int], bare: bool = False):
    """Parts of what the compressed members that begin ``raw`` hold, one after another; compressed contents are unpacked as well.

    ``bare``: a raw deflate stream comes first. ``used[0]`` becomes the number of bytes of ``raw`` in whole members. Each level hands
    on at most ``PART`` bytes before it goes on, so memory is bounded by the levels.
    """
    # of each level; None: what begins here is not known yet, False: not compressed
    machines: list = [zlib.decompressobj(-15)] if bare else []
    heads: list[bytes] = [b""] if bare else []  # first bytes of each level: kept for cycles, and where they turn out not to be compressed
    for at in range(0, len(raw), 1 << 16):
        work = [(0, bytes(raw[at : at + (1 << 16)]))]
        fed = at + len(work[0][1])
        while work:
            k, data = work.pop()
            if k == len(machines):
                machines.append(None)
                heads.append(b"")
            if machines[k] is None:
                heads[k] = data = heads[k] + data
                if len(data) < 10 and not (k == 0 and fed == len(raw)):
                    continue
                packed = _HEADER.match(data)
                if packed and (k > len(raw) or sum(h[:4096] == data[:4096] for h in heads[:k]) >= ALIKE):
                    return  # it holds itself, or goes on without end
                machines[k] = _machine(data) if packed else False
            if machines[k] is False:
                if k == 0:
                    return
                yield data
                continue
            machine = machines[k]
            try:
                out = machine.decompress(data, PART)
            except zlib.error:
                if k == 0:
                    return
                yield from [data] if data is heads[k] else [heads[k], data]
                machines[k] = False
                continue
            rest = machine.unconsumed_tail
            if machine.eof:
                rest = machine.unused_data.lstrip(b"\0")  # another member may follow
                machines[k], heads[k] = None, b""
                if k == 0:
                    used[0] = fed - len(rest)
            if rest or len(out) == PART:
                work.append((k, rest))
            if out:
                work.append((k + 1, out))
    used[0] = len(raw)
    for machine, head in zip(machines[1:], heads[1:], strict=True):
        if machine is not False:
            yield head


def _windows(parts):
    """Texts of the parts, which overlap; a run of base64 characters is not cut below ``HOLD``."""
    held, fresh = b"", False
    for part in parts:
        held, fresh = _SPACES.sub(b" " * 512, held + part), True
        if len(held) < PART or len(held) < HOLD and not held[-OVERLAP:].rstrip(_RUN):
            continue
        yield _texts(held)
        held, fresh = held[-OVERLAP:], False
    if fresh:
        yield _texts(held)


def _texts(raw: bytes) -> str:
    return "\ufffd".join(m[0].decode("ascii") for m in _STRETCH.finditer(raw))


def _unpacked(raw: bytes, region, exact: bool = False):
    """(start, end, text) of all that compressed members in ``raw`` hold, window by window.

    ``exact``: a region ends with its members, which are read once before for it, else with ``raw``.
    """
    at = 0
    while m := _HEADER.search(raw, at):
        used, end = [0], len(raw)
        if exact:
            for _ in _contents(memoryview(raw)[m.start() :], used):
                pass
            end = m.start() + used[0] if used[0] else end
        for text in _windows(_contents(memoryview(raw)[m.start() :], used)):
            yield *region(m.start(), end), text
        at = m.start() + max(1, used[0])


def _opens(raw: bytes, at: int, bits: int) -> bool:
    """Whether what begins there unpacks, as far as its first bytes tell."""
    try:
        return len(zlib.decompressobj(bits).decompress(raw[at : at + 4096], 4096)) >= 12
    except zlib.error:
        return False


def _ends(raw: bytes, at: int) -> bool:
    """Whether a raw deflate stream goes from there to the end of ``raw``."""
    machine, view = zlib.decompressobj(-15), memoryview(raw)
    try:
        for lo in range(at, len(raw), 1 << 14):
            rest = view[lo : lo + (1 << 14)]
            while not machine.eof and (machine.decompress(rest, PART) or machine.unconsumed_tail):
                rest = machine.unconsumed_tail
            if machine.eof:
                return len(raw) - lo - (1 << 14) + len(machine.unused_data) <= 2 if lo + (1 << 14) < len(raw) else len(machine.unused_data) <= 2
    except zlib.error:
        return False
    return False


def _inflated(raw: bytes, at: int, region):
    for text in _windows(_contents(memoryview(raw)[at:], [0], bare=True)):
        yield *region(at, len(raw)), text


def _printable(raw: bytes) -> str:
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return ""
    return text if sum(c.isprintable() or c in "\r\n\t" for c in text) >= 0.95 * len(text) else ""


def _blocks(text: str):
    """(characters, places, end) of each run of base64 characters; lines that go on at the same width are joined."""
    at = 0
    while m := _BASE64.search(text, at):
        at, body, out, width = m.end(), m[0].rstrip("="), _Places(), 0
        out.add(body, m.start())
        last = len(body) < len(m[0])
        while not last and (n := _NEXT_LINE.match(text, at)):
            if not width:
                line = text.rfind("\n", 0, at) + 1
                alone = not text[line : m.start()].strip()  # else the first line holds other text before its run
                most, width = (len(body), len(body)) if alone else (at - line, len(n[1].rstrip("=")))
            body = n[1].rstrip("=")
            if len(body) > most:
                break
            out.add(body, n.start(1))
            at, last = n.end(), len(body) < len(n[1]) or len(body) < width  # padded or short
            most = width
        yield *out.done(), at


def _unwrapped(body: str, places: _Places, end: int):
    """(start, end, decoded text) of what a run of base64 characters holds, at whatever character it begins;
    of compressed bytes, an iterator of the same.

    A group of four decodes alone, so the four alignments hold every text that is encoded
    in a part of the run, after a path, a dash or an underscore, in either alphabet.
    """
    body = body.translate(_STANDARD)
    kept = []
    for shift in range(4):
        chars = body[shift : len(body) - ((len(body) - shift) % 4 == 1)]
        raw = binascii.a2b_base64(chars + "=" * (-len(chars) % 4))

        def region(first: int, last: int, shift: int = shift) -> tuple[int, int]:
            start, stop = shift + first // 3 * 4, min(shift + -(-last // 3) * 4, len(body))
            start, stop = places.span(start, stop)[0], end if stop == len(body) else places.span(start, stop)[1]
            return start, stop

        if shift == 0 and len(body) % 4 != 1 and (text := _printable(raw)):
            yield *region(0, len(raw)), text
        else:
            for m in _STRETCH.finditer(raw):
                yield *region(m.start(), m.end()), m[0].decode("ascii")
        if _HEADER.search(raw):
            yield _unpacked(raw, region)
        kept.append((raw, region))
    for c in (0, *(m.end() for m in _SIGN.finditer(body))):
        raw, region = kept[c % 4]
        at = c // 4 * 3
        if _HEADER.match(raw, at) and _opens(raw, at, 47):
            break
        if _opens(raw, at, -15) and _ends(raw, at):
            yield _inflated(raw, at, region)
            break


def _spelled(text: str):
    """(bytes, region) of each stretch of ``text`` that spells bytes out, by URL escapes or as in a program."""
    for stretches, escape in ((_URL_BYTES, _URL_BYTE), (_C_BYTES, _C_BYTE)):
        for m in stretches.finditer(text) if escape.search(text) else ():
            if not escape.search(text, m.start(), m.end()):
                continue
            out, last = _Places(), m.start()
            for e in escape.finditer(text, m.start(), m.end()):
                out.add(text[last : e.start()], last)
                code = e[1] or e[2]
                out.add(chr(int(code, 16)) if code else _C_NAMED[e[0][1]], e.start(), e.end())
                last = e.end()
            out.add(text[last : m.end()], last)
            plain, places = out.done()
            yield plain.encode("latin-1"), places.span


def _packed(text: str):
    """An iterator of (start, end, decoded text) for each stretch of spelled-out bytes that holds compressed ones."""
    for raw, region in _spelled(text):
        if _HEADER.search(raw):
            yield _unpacked(raw, region, exact=True)
        for at in (0, *(m.end() for m in _OPENED.finditer(raw))):
            if not _HEADER.match(raw, at) and _opens(raw, at, -15) and _ends(raw, at):
                yield _inflated(raw, at, region)
                break


def _layers(text: str):
    """(start, end, decoded text, places or None) of each encoded region of one layer, or an iterator of the same.

    Escapes are decoded in the whole layer at once: what stands around them counts.
    """
    if "%" in text and _PERCENT.search(text):
        yield 0, len(text), *_percent(text)
    if ("\\" in text or "%u" in text) and _UNICODE.search(text):
        yield 0, len(text), *_unescape(text)
    for x in _packed(text):
        yield ((*y, None) for y in x)
    for block in _blocks(text):
        for x in _unwrapped(*block):
            yield (*x, None) if isinstance(x, tuple) else ((*y, None) for y in x)


def _decoded_spans(text: str) -> list[tuple[int, int, int]]:
    """``base_spans``, and those that begin inside a match with too short a value."""
    found, at = [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)] if "AKIA" in text else [], -1
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    for m in _ASSIGN.finditer(text):
        if m.end(1) - m.start(1) >= 6:
            found.append((m.start(), m.end(), 0))
        elif at < 0:
            at = m.start(1)
    while at >= 0 and (m := _ASSIGN.search(text, at)):
        long = m.end(1) - m.start(1) >= 6
        if long:
            found.append((m.start(), m.end(), 0))
        at = m.end() if long else m.start(1)
    return found


def _outside(chain: tuple | None, start: int, end: int) -> tuple[int, int]:
    while chain:
        start, end = chain[0].span(start, end)
        chain = chain[1]
    return start, end


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """Base spans, all spans (both sorted by start, then kind), and the number of decoded layers."""
    base = base_spans(text)
    found, layers = set(base), 0
    seen: set[tuple[int, int, bytes]] = set()
    counted: set[tuple[int, int]] = set()
    # encoded regions still to come, the chain of places of their layer and, where none of them has
    # a meaning outside, its region; windows of compressed bytes come one at a time
    work: list[tuple] = [(_layers(text), None, None, False)]
    while work:
        regions, chain, whole, packed = work.pop()
        for x in regions:
            if not isinstance(x, tuple):
                work.append((x, chain, whole, True))
                continue
            start, end, decoded, places = x
            if not decoded or decoded == text:
                continue
            region = whole or _outside(chain, start, end)
            key = (*region, hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).digest())
            if key in seen:
                continue
            seen.add(key)
            layers += not packed or region not in counted  # all windows are one layer
            if packed:
                counted.add(region)
            inner = (places, chain) if places is not None and whole is None else None
            for s, e, kind in _decoded_spans(decoded):
                found.add((*(_outside(inner, s, e) if inner else region), kind))
            below = (_layers(decoded), inner, None if inner else region, False)
            if packed:
                work += [(regions, chain, whole, True), below]
                break
            work.append(below)
    return base, sorted(found, key=lambda s: (s[0], s[2], s[1])), layers


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def _scan_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    cols: list[list] = [[], [], [], [], [], [], []]
    for text in batch.column("text").to_pylist():
        base, every, layers = scan(text)
        for kind in range(3):
            cols[kind].append(sum(k == kind for _, _, k in base))
        cols[3].append(hashlib.sha256(spell(base).encode()).hexdigest())
        cols[4].append(spell(every))
        cols[5].append(len(every) - len(base))
        cols[6].append(layers)
    arrays = [batch.column("doc_id"), *(pa.array(cols[i], pa.int64()) for i in range(3)), pa.array(cols[3]), pa.array(cols[4]), *(pa.array(cols[i], pa.int64()) for i in (5, 6))]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_decoded", "n_layers"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of base spans, their digest, and all spans as text."""
    return map_batches(id_text(docs, id_col, text_col), _scan_batch, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_decoded long, n_layers long")


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """``text`` with every span (overlapping ones as one) replaced by ``mark``."""
    out, last = [], 0
    for s, e, _ in spans:
        if s >= last:
            out += [text[last:s], mark]
        last = max(last, e)
    return "".join([*out, text[last:]])


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with the secrets of ``text_col`` replaced; null texts stay null, other columns stay as they are."""

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index(text_col)
        texts = [t and redact(t, scan(t)[1], mark) for t in batch.column(at).to_pylist()]
        arrays = [pa.array(texts, batch.schema.field(i).type) if i == at else batch.column(i) for i in range(batch.num_columns)]
        return pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return map_batches(docs, clean, docs.schema)
