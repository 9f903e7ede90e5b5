"""Secret scans with a recursive decoding worklist.

Layer 0 is the text. The worklist unwraps a layer's URL and Unicode escapes
(which gives the whole layer with them replaced) and each of its base64 runs
(which gives the decoded bytes as text, decompressed first where they are zlib or gzip).
A run goes on over line breaks. As it may begin with something else, a letter of an escape, a
``+`` or a folder's name, all four alignments are decoded, and packed bytes may
begin wherever their first two stand.
New layers join the worklist, and it runs until nothing new comes out; a layer
whose text and place were seen before is not entered again, so cycles end. Every
layer is scanned by the base patterns, and spans are mapped back, code point by
code point, to the text itself.

Texts are scanned whole where they are read; there is no shuffle.

Defined results: null and empty texts have no spans; matches of one kind don't
overlap within a layer; a span that a base span of its kind covers is not
reported again; decoded bytes that aren't UTF-8 are read as Latin-1, as all patterns
are ASCII; compressed runs are unpacked in windows of ``WINDOW`` bytes over all their members. The next window
begins ``OVERLAP`` before the run that the last one ends in, so no run is cut, however long, and memory
grows with the longest run; repeated rows repeat their result; all other columns are kept.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import refuse_clash, small_batches, text_of

# The kinds in their order, with the least length of what they find.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_VALUE = 12

#: Runs of escapes of one kind. An escape of the character that begins escapes may be
#: nested any number of times (%2541, %252541, ...): such a chain is one escape.
PERCENT = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
UNICODE = re.compile(r"\\(?:u005[cC])*u([0-9A-Fa-f]{4})")
BYTE = re.compile(r"\\(?:x5[cC])*x([0-9A-Fa-f]{2})")
DECIMAL = re.compile(r"&(?:#0{0,5}38;)*#([0-9]{1,7});")
HEXADECIMAL = re.compile(r"&(?:#[xX]0{0,4}26;)*#[xX]([0-9A-Fa-f]{1,6});")
ESCAPE = re.compile("|".join(f"(?:{x.pattern.replace('(', '(?:').replace('(?:?:', '(?:')})+" for x in (PERCENT, UNICODE, BYTE, DECIMAL, HEXADECIMAL)))
#: 16 hex digits are the shortest secret; in base64 they take 22 characters.
LEAST_RUN = 22
BASE64 = re.compile(r"(?:[A-Za-z0-9+/_-]++(?:\r?\n[ \t]*+(?=[A-Za-z0-9+/_-]))?+)++")
NOT_BASE64 = re.compile(r"[\r\n \t]+")
#: What no run of base64, escapes or a value goes on over: other characters, and blanks but for those that begin a line.
RUN_ENDS = re.compile(rb"[^A-Za-z0-9+/_.=%&#;\\{}\r\n \t-]|(?<=[^\n \t])[ \t]")
WINDOW, OVERLAP, PIECE = 32 << 20, 4 << 20, 1 << 20
SPAN = "array<struct<kind:string,start:int,end:int,layer:string>>"

#: Characters of base64 that are read at first where packed bytes may begin.
PROBE = 1400
Layer = tuple[str, "np.ndarray | None", "np.ndarray | None", str]  # text, starts, ends, path


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind."""
    out = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_VALUE]
    return sorted(out)


def _unescaped(run: str) -> list[tuple[str, int]]:
    """Decoded characters of one run of escapes, with the length of each one's escape."""
    of = PERCENT if run[0] == "%" else UNICODE if run[:2] == "\\u" else BYTE if run[0] == "\\" else HEXADECIMAL if HEXADECIMAL.match(run) else DECIMAL
    codes, sizes = zip(*((int(m[1], 10 if of is DECIMAL else 16), m.end() - m.start()) for m in of.finditer(run)))
    if of is PERCENT:
        try:
            text = bytes(codes).decode()
        except UnicodeDecodeError:
            return list(zip(map(chr, codes), sizes))
        out, k = [], 0
        for c in text:
            n = len(c.encode())
            out.append((c, sum(sizes[k : k + n])))
            k += n
        return out
    out, k = [], 0
    while k < len(codes):
        if 0xD800 <= codes[k] < 0xDC00 and k + 1 < len(codes) and 0xDC00 <= codes[k + 1] < 0xE000:
            out.append((chr(0x10000 + ((codes[k] - 0xD800) << 10) + codes[k + 1] - 0xDC00), sizes[k] + sizes[k + 1]))
            k += 2
            continue
        out.append((chr(codes[k]) if codes[k] < 0x110000 and not 0xD800 <= codes[k] < 0xE000 else "�", sizes[k]))
        k += 1
    return out


def without_escapes(layer: Layer) -> Layer | None:
    """The layer with its URL and Unicode escapes replaced; those of no character give U+FFFD."""
    text, starts, ends, path = layer
    parts, firsts, lasts, at = [], [], [], 0
    for m in ESCAPE.finditer(text):
        if chars := _unescaped(m.group()):
            parts += [text[at : m.start()], "".join(c for c, _ in chars)]
            sizes = np.asarray([n for _, n in chars])
            stop = m.start() + np.cumsum(sizes)
            firsts += [np.arange(at, m.start()), stop - sizes]
            lasts += [np.arange(at, m.start()), stop - 1]
            at = m.end()
    if not parts:
        return None
    tail = np.arange(at, len(text))
    first, last = np.concatenate([*firsts, tail]), np.concatenate([*lasts, tail])
    return (
        "".join([*parts, text[at:]]),
        first if starts is None else starts[first],
        last + 1 if ends is None else ends[last],
        f"{path}>escapes",
    )


def _is_packed(raw: bytes) -> bool:
    return raw[:2] == b"\x1f\x8b" or len(raw) > 1 and raw[0] & 15 == 8 and raw[0] < 128 and (raw[0] << 8 | raw[1]) % 31 == 0


def _packed_begin() -> str:
    """The base64 of the two bytes that packed data begin with: two characters, and what the third may be."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    firsts = [x for x in (bytes([a, b]) for a in range(128) for b in range(256)) if _is_packed(x)]
    begin = ((base64.b64encode(x).decode(), 4 * (x[1] & 15)) for x in firsts)
    return "|".join(re.escape(t[:2]) + "[" + re.escape(letters[k : k + 4]) + "]" for t, k in begin)


PACKED = re.compile(f"(?={_packed_begin()})")


def _unpacks(raw: bytes) -> bool:
    """Whether the first bytes of what may be packed data are read without an error."""
    try:
        zlib.decompressobj(47).decompress(raw, 1 << 16)
    except zlib.error:
        return False
    return True


def _open_run(window: bytes) -> int:
    """How many bytes at the end of ``window`` a run has that may go on behind it."""
    size = 1 << 12
    while True:
        last = None
        for last in RUN_ENDS.finditer(window, max(0, len(window) - size)):
            pass
        if last or size >= len(window):
            return len(window) - last.end() if last else len(window)
        size *= 16


def _members(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """What zlib or gzip members hold, in pieces; bytes behind the last one come as they are, and a broken member ends it."""
    member, plain, left = None, False, b""
    for chunk in chunks:
        chunk, left = left + chunk, b""
        while chunk:
            if plain:
                yield chunk
                break
            if member is None:
                if len(chunk) < 2:
                    left = chunk
                    break
                if not _is_packed(chunk):
                    plain = True
                    continue
                member = zlib.decompressobj(47)
            try:
                out = member.decompress(chunk, PIECE)
                yield out
                while len(out) == PIECE and not member.unconsumed_tail and not member.eof:
                    out = member.decompress(b"", PIECE)
                    yield out
            except zlib.error:
                return
            chunk, member = (member.unused_data, None) if member.eof else (member.unconsumed_tail, member)


def _packed_end(raw: bytes) -> int:
    """Where the members at the start of ``raw`` end; 0 if there is none."""
    at = 0
    while _is_packed(raw[at : at + 2]):
        member, chunk = zlib.decompressobj(47), raw[at:]
        try:
            while chunk and not member.eof:
                got = member.decompress(chunk, PIECE)
                if not got and member.unconsumed_tail == chunk:
                    break
                chunk = member.unconsumed_tail
        except zlib.error:
            return len(raw) if next(filter(None, _members([raw[at:]])), b"") else at
        if not member.eof:
            return len(raw)
        at = len(raw) - len(member.unused_data)
    return at


def _windows(raw: bytes) -> Iterator[tuple[bytes, str]]:
    """Overlapping windows over what ``raw`` unpacks to, while it is zlib or gzip, and how it was packed."""
    chunks, path, first = iter([raw]), "", raw
    while _is_packed(first):
        try:
            zlib.decompressobj(47).decompress(first, 1)
        except zlib.error:  # two bytes that only look so
            break
        unpacked = filter(None, _members(chunks))
        start = next(unpacked, b"")
        while len(start) < 2 and (more := next(unpacked, b"")):
            start += more
        if start == first:  # a quine
            break
        chunks, path, first = chain([start], unpacked), f"{path}>compressed", start
    held: list[bytes] = []
    size, most = 0, WINDOW
    for chunk in chunks:
        held.append(chunk)
        size += len(chunk)
        if size >= most:
            window = b"".join(held)
            yield window, path
            size = min(len(window), OVERLAP + _open_run(window))
            held, most = [window[len(window) - size :]], max(WINDOW, 2 * size)
    if size:
        yield b"".join(held), path


def _text(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def from_base64(layer: Layer) -> Iterator[Layer]:
    """Layers for each base64 run: each alignment decoded, and what its packed bytes hold."""
    text, starts, ends, path = layer

    def place(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return first if starts is None else starts[first], last + 1 if ends is None else ends[last]

    for m in BASE64.finditer(text):
        if m.end() - m.start() < LEAST_RUN:
            continue
        whole = m.group()
        run, at = whole, None
        if "\n" in whole:
            at = np.flatnonzero(~np.isin(np.frombuffer(whole.encode(), np.uint8), list(b"\r\n \t"))) + m.start()
            run = NOT_BASE64.sub("", whole)
        if len(run) < LEAST_RUN:
            continue
        run = run.replace("-", "+").replace("_", "/")
        of = (lambda k: k + m.start()) if at is None else at.__getitem__  # noqa: E731, B023

        def decoded(start: int, stop: int | None = None) -> bytes:
            part = run[start:stop]  # noqa: B023
            part = part[:-1] if len(part) % 4 == 1 else part
            return base64.b64decode(part + "=" * (-len(part) % 4))

        for begin in PACKED.finditer(run):
            start = begin.start()
            if len(run) - start >= 8 and _unpacks(decoded(start, start + PROBE)) and (stop := _packed_end(raw := decoded(start))):
                last = min(start + (stop * 4 + 2) // 3, len(run)) - 1
                for window, how in _windows(raw[:stop]):
                    if how:
                        found = _text(window)
                        first, end = place(np.asarray([of(start)]), np.asarray([of(last)]))
                        yield found, np.broadcast_to(first, len(found)), np.broadcast_to(end, len(found)), f"{path}>base64{how}"
        for start in range(4):
            raw = decoded(start)
            found = _text(raw)
            sizes = np.ones(len(found), np.int64) if len(found) == len(raw) else np.fromiter((len(c.encode()) for c in found), np.int64, len(found))
            stop = np.cumsum(sizes)
            first, last = start + (stop - sizes) * 4 // 3, np.minimum(start + (stop * 4 + 2) // 3, len(run)) - 1
            yield found, *place(of(first), of(last)), f"{path}>base64"


def _unwrapped(layer: Layer) -> Iterator[Layer]:
    if (plain := without_escapes(layer)) is not None:
        yield plain
    yield from from_base64(layer)


def find(text: str) -> list[tuple[str, int, int, str]]:
    """All spans (kind, start, end, layer) by start, then kind; layer is empty for those of the text itself."""
    base = base_spans(text)
    found: dict[tuple[int, int, int], str] = {s: "" for s in base}
    mark = lambda x: xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass"))
    covers = [[(a, b) for a, k, b in base if k == kind] for kind in range(len(KINDS))]
    work = [_unwrapped((text, None, None, ""))]  # depth first: one window of each depth is held
    seen = {(mark(text), 0)}
    while work:
        if (x := next(work[-1], None)) is None:
            work.pop()
            continue
        if x[0] and (key := (mark(x[0]), int(x[1][0]))) not in seen:
            seen.add(key)
            work.append(_unwrapped(x))
            for s, kind, e in base_spans(x[0]):
                span = (int(x[1][s]), kind, int(x[2][e - 1]))
                # Base spans of a kind don't overlap: only the last one that begins no later can cover this one.
                k = bisect_right(covers[kind], (span[0], len(text) + 1)) - 1
                if k < 0 or covers[kind][k][1] < span[2]:
                    found.setdefault(span, x[3][1:])
    return [(KINDS[k], s, e, where) for (s, k, e), where in sorted(found.items())]


def scan(docs: DataFrame, text_col: str = "text", out_col: str = "_secrets") -> DataFrame:
    """Adds ``out_col``, a name that no column may have: the spans (code points, end exclusive) with the layers that held them."""
    refuse_clash(docs, out_col)
    small_batches(docs.sparkSession)

    @F.pandas_udf(SPAN)
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("kind", "start", "end", "layer"), x)) for x in find(t)] for t in texts], dtype=object)

    return docs.withColumn(out_col, of(text_of(text_col)))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """The documents, each span in their texts replaced by ``mark``; texts without spans, null ones too, stay as they are."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            parts, at = [], 0
            for _, start, end, _ in find(text) if text else []:
                if start >= at:
                    parts += [text[at:start], mark]
                at = max(at, end)
            out.append("".join([*parts, text[at:]]) if parts else text)
        return pd.Series(out, dtype=object)

    return docs.withColumn(text_col, of(F.col(text_col)))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
