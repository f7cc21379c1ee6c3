"""Secret scans through nested encodings.

Each text is the first layer of a worklist. A layer is scanned for secrets and then decoded: URL escapes, Unicode
escapes and character references as a whole, every run of base64 on its own, and compressed bytes wherever decoding
yields them. Each new layer joins the worklist until no decoder finds anything new; a layer that was there before for the
same span of the text is not entered again, so encodings that lead back to themselves end. Every layer knows which span of its parent each of its
spans comes from, so a finding in any depth is told by its place in the text. What decompresses to more than PIECE bytes
is scanned as a stream of pieces that are cut at white space, or overlap where there is none.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quillon.llm._batch import small_batches

PIECE, OVERLAP = 1 << 24, 1 << 16  # decompressed bytes that are held at once; what two pieces have in common at a hard cut
MASK = "[SECRET]"

#: (rule, strings of which a lower-case text must hold one, pattern; its group 1, if any, is the value that is_secret sees)
RULES: list[tuple[str, tuple[str, ...], re.Pattern]] = [
    ("aws_access_key", ("akia", "asia"), re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])")),
    ("github_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"), re.compile(r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,})")),
    ("slack_token", ("xox",), re.compile(r"(?<![A-Za-z0-9])xox[abeoprs]-[A-Za-z0-9-]{10,}")),
    ("google_api_key", ("aiza",), re.compile(r"(?<![A-Za-z0-9])AIza[0-9A-Za-z_-]{35}")),
    ("payment_key", ("k_live_", "k_test_"), re.compile(r"(?<![A-Za-z0-9])[rs]k_(?:live|test)_[0-9A-Za-z]{16,}")),
    ("service_key", ("sk-",), re.compile(r"(?<![A-Za-z0-9])sk-[A-Za-z0-9_-]{20,}")),
    # the lookahead sees once whether a run is a token's head, so that not every "eyJ" of a long run tries
    ("json_web_token", (".eyj",), re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8})(?:[A-Za-z0-9_-]*?[_-])??eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}")),
    ("private_key", ("private key",), re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY(?: BLOCK)?-----(?:(?:[^-]++|-(?!----))*+-----END (?:[A-Z]+ )*PRIVATE KEY(?: BLOCK)?-----)?")),
    ("url_password", ("://",), re.compile(r"(?<=[A-Za-z0-9+.-])://[^\s:/@]++:([^\s:/@]{3,}+)@")),
    (
        "assigned_secret",
        ("key", "secret", "token", "passw", "pwd"),
        re.compile(r"""(?i)(?<![a-z0-9])(?:api_?-?key|access_?-?key|secret_?-?key|private_?-?key|secret|token|passwo?r?d|pwd)["']?\s*+(?::=|=>|[:=])\s*+("[^"\s]{8,}"|'[^'\s]{8,}'|[A-Za-z0-9+/_.~-]{12,}={0,2})"""),
    ),
]


def is_secret(rule: str, value: str) -> bool:
    """Whether the value of an assignment is a secret rather than a word: quoted or not, it has a digit and a letter."""
    return rule != "assigned_secret" or (any(c.isdigit() for c in value) and any(c.isalpha() for c in value))


@dataclass
class Layer:
    """A decoded text; pieces are (start, source start, source end, whether each unit has one unit as source)."""

    text: str
    path: tuple[str, ...] = ()
    parent: "Layer | None" = None
    pieces: list[tuple[int, int, int, bool]] = field(default_factory=list)
    _starts: list[int] | None = None

    def origin(self, start: int, end: int) -> tuple[int, int]:
        """The span of the first layer that a span of this one comes from."""
        if self.parent is None:
            return start, end
        if self._starts is None:
            self._starts = [p[0] for p in self.pieces]
        at, low, high, exact = self.pieces[bisect_right(self._starts, start) - 1]
        first = low + start - at if exact else low
        at, low, high, exact = self.pieces[bisect_right(self._starts, max(start, end - 1)) - 1]
        return self.parent.origin(first, max(first, low + end - at if exact else high))


_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+")
_UNIT = re.compile(r"\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]+)\}|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#([0-9]+);|&#[xX]([0-9A-Fa-f]+);")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:(?:[A-Za-z0-9+/]{60,76}\r?\n)+[A-Za-z0-9+/]{1,76}(?![A-Za-z0-9+/_-])|[A-Za-z0-9+/_-]{16,}+)(?:(?:%3[Dd]){1,2}|={1,2})?")
_SIGN = re.compile(r"[/_-]")
_COMPRESSED = (b"\x1f\x8b", b"BZh", b"\xfd7zXZ\x00", b"\x28\xb5\x2f\xfd", b"x\x01", b"x\x5e", b"x\x9c", b"x\xda")
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_TO_STANDARD = str.maketrans("-_", "+/", "\r\n")


def _url(run: str) -> str:
    data = bytes.fromhex(run.replace("%", ""))
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _unicode(run: str) -> str | None:
    units = []
    for m in _UNIT.finditer(run):
        code = int(m[5]) if m[5] else int(next(g for g in m.groups() if g), 16)
        if code > 0x10FFFF:
            return None
        units.append(chr(code))
    try:
        return "".join(units).encode("utf-16-le", "surrogatepass").decode("utf-16-le")
    except UnicodeDecodeError:
        return None


def _runs(layer: Layer, name: str, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every run of pattern decoded, or None if none is."""
    out, pieces, at, size = [], [], 0, 0
    for m in pattern.finditer(layer.text):
        new = decode(m[0])
        if new is None:
            continue
        if m.start() > at:
            pieces.append((size, at, m.start(), True))
            out.append(layer.text[at : m.start()])
            size += m.start() - at
        if new:
            pieces.append((size, m.start(), m.end(), False))
            out.append(new)
            size += len(new)
        at = m.end()
    if not at:
        return None
    if at < len(layer.text):
        pieces.append((size, at, len(layer.text), True))
        out.append(layer.text[at:])
    return Layer("".join(out), (*layer.path, name), layer, pieces or [(0, 0, len(layer.text), False)])


def _method(data: bytes) -> str | None:
    """How data seems to be compressed, by its first bytes."""
    for magic, name in ((b"\x1f\x8b", "gzip"), (b"BZh", "bzip2"), (b"\xfd7zXZ\x00", "xz"), (b"\x28\xb5\x2f\xfd", "zstd")):
        if data.startswith(magic):
            return name
    return "zlib" if len(data) > 2 and data[0] & 15 == 8 and int.from_bytes(data[:2]) % 31 == 0 else None


def _inflate(data: bytes) -> tuple[str, Iterator[bytes]] | None:
    """(method, bytes in chunks) of compressed data, all its members; None if data is not compressed."""
    match name := _method(data):
        case "gzip":
            chunks = _members(lambda: zlib.decompressobj(31), data, b"\x1f\x8b")
        case "bzip2":
            chunks = _members(bz2.BZ2Decompressor, data, b"BZh")
        case "xz":
            chunks = _members(lzma.LZMADecompressor, data, b"\xfd7zXZ\x00")
        case "zlib":
            chunks = _members(zlib.decompressobj, data, data[:1])
        case "zstd":
            chunks = _zstd(data)
        case _:
            return None
    first = next(chunks, None)
    return None if first is None else (name, chain([first], chunks))


def _members(machine, data: bytes, magic: bytes) -> Iterator[bytes]:
    """The members of data one after the other, then what follows them as it is; nothing if not even one can be read."""
    some = False
    while data.startswith(magic):
        m, rest = machine(), data
        try:
            while not m.eof:
                if chunk := m.decompress(rest, PIECE):
                    yield chunk
                elif not rest:
                    return  # cut short
                some = True
                rest = getattr(m, "unconsumed_tail", b"")  # the others keep what they have not read
        except (zlib.error, OSError, EOFError, lzma.LZMAError):
            break
        data = m.unused_data.lstrip(b"\0")
    if some and data:
        yield data


def _zstd(data: bytes) -> Iterator[bytes]:
    with zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True) as reader:
        try:
            while part := reader.read(1 << 16):
                yield part
        except zstandard.ZstdError:
            pass


def _pieces(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """chunks as pieces of some PIECE bytes, cut after the last white space or NUL of their second half if there is any."""
    held, size = [], 0
    for chunk in chunks:
        held.append(chunk)
        size += len(chunk)
        while size > PIECE:
            data = b"".join(held)
            cut = max(data.rfind(x, PIECE // 2, PIECE) for x in (b" ", b"\n", b"\0")) + 1
            yield data[: cut or PIECE]
            held = [data[cut or PIECE - OVERLAP :]]
            size = len(held[0])
    if size:
        yield b"".join(held)


def _as_texts(data: bytes) -> Iterator[str]:
    """data as text: UTF-8, or a character a byte where it is none, and UTF-16 as well where it looks so."""
    try:
        yield data.decode()
    except UnicodeDecodeError:
        yield data.decode("latin-1")
    half = len(data) // 2
    for order, mark, high in (("le", b"\xff\xfe", 1), ("be", b"\xfe\xff", 0)):
        if half and (data.startswith(mark) or data[high::2].count(0) * 4 > half > data[1 - high :: 2].count(0) * 8):
            yield data.decode(f"utf-16-{order}", "replace").removeprefix("\ufeff")


#: a run that may hold compressed bytes by escapes, and its units
_ESCAPED = re.compile(r"""(?:%1[Ff]%8[Bb]|\\x1[Ff]\\x8[Bb]|\\u001[Ff]\\u008[Bb]|&#31;&#139;|&#[xX]1[Ff];&#[xX]8[Bb];|(?:B|%42|\\x42|\\u0042|&#66;)(?:Z|%5[Aa]|\\x5[Aa]|\\u005[Aa]|&#90;)(?:h|%68|\\x68|\\u0068|&#104;)|%[Ff][Dd](?:7|%37)|\\x[Ff][Dd](?:7|\\x37)|\\u00[Ff][Dd](?:7|\\u0037)|&#253;|(?:\(|%28|\\x28|\\u0028|&#40;)(?:%[Bb]5|\\x[Bb]5|\\u00[Bb]5|&#181;)|(?:x|%78|\\x78|\\u0078|&#120;)(?:[\^]|%01|%5[Ee]|%9[Cc]|%[Dd][Aa]|\\x01|\\x5[Ee]|\\x9[Cc]|\\x[Dd][Aa]|\\u0001|\\u005[Ee]|\\u009[Cc]|\\u00[Dd][Aa]|&#1;|&#94;|&#156;|&#218;))[^\s"'<>]+""")
_BYTE = re.compile(r"%([0-9A-Fa-f]{2})|\\x([0-9A-Fa-f]{2})|\\u00([0-9A-Fa-f]{2})|\\u\{0*([0-9A-Fa-f]{1,2})\}|&#([0-9]{1,3});|&#[xX]0*([0-9A-Fa-f]{1,2});|\\([nrt\\])|(.)", re.S)
_LETTER = {"n": 10, "r": 13, "t": 9, "\\": 92}


def _escaped(layer: Layer) -> Iterator[Layer]:
    """The layers of compressed bytes that URL, Unicode and \\x escapes or character references hold."""
    for m in _ESCAPED.finditer(layer.text):
        name = "url" if "%" in m[0][:6] else "unicode"
        units = []
        for u in _BYTE.finditer(m[0]):
            if u[5]:
                units.append(int(u[5]))
            elif u[7]:
                units.append(_LETTER[u[7]])
            elif u[8]:
                units.append(ord(u[8]))
            else:
                units.append(int(u[1] or u[2] or u[3] or u[4] or u[6], 16))
        data = bytes(x for x in units if x < 256)
        yield from _opened(layer, name, data, m.start(), m.end(), False)


def _opened(layer: Layer, name: str, data: bytes, start: int, end: int, plain: bool = True) -> Iterator[Layer]:
    """The layers of a run's bytes, inflated as often as they are compressed; unless plain, only if they are."""

    def opened(data: bytes, path: tuple[str, ...], met: tuple[bytes, ...]) -> Iterator[Layer]:
        found = _inflate(data) if data not in met else None
        if found:
            path, met = (*path, found[0]), (*met, data)
            first = next(found[1])
            if _method(first):  # compressed again, and held whole in that form
                yield from opened(first + b"".join(found[1]), path, met)
                return
            pieces = _pieces(chain([first], found[1]))
        else:
            pieces = iter([data] if data and (plain or met) else [])
        for piece in pieces:
            for text in _as_texts(piece):
                yield Layer(text, path, layer, [(0, start, end, False)])

    yield from opened(data, (*layer.path, name), ())


def _decoded(run: str) -> bytes:
    run = run.translate(_TO_STANDARD)
    run = run[: len(run) - (len(run) % 4 == 1)]
    return base64.b64decode(run + "=" * (-len(run) % 4))


def _clean(data: bytes) -> int:
    """How many bytes from the first on are UTF-8 without control characters."""
    try:
        text = data.decode()
    except UnicodeDecodeError as e:
        text = data[: e.start].decode()
    m = _CONTROL.search(text)
    return len((text[: m.start()] if m else text).encode())


def _parts(run: str) -> Iterator[tuple[int, int]]:
    """Where base64 may begin and end within a run that its signs / - _ join to a path or a name."""
    starts = [0, *(m.end() for m in _SIGN.finditer(run))]
    ends = [*(x - 1 for x in starts[1:]), len(run)]
    done = 0
    for start in starts:
        if start < done or len(run) - start < 16:
            continue
        head = _decoded(run[start : start + 12])
        if head.startswith(_COMPRESSED) or head[:2] in (b"\xff\xfe", b"\xfe\xff") or head[1::2] == bytes(4) or head[::2] == bytes(5):
            yield start, len(run)
            if start == 0:
                return
        elif _clean(head) >= 7:
            size = 64
            while (clean := _clean(_decoded(run[start : start + size]))) > size // 4 * 3 - 4 and start + size < len(run):
                size *= 2
            i = bisect_right(ends, start + (clean * 4 + 3) // 3)
            end = ends[i - 1] if i else start
            if end - start < 16:
                end = len(run)
            else:
                done = end
            yield start, end


def _base64(layer: Layer) -> Iterator[Layer]:
    """The layers that the base64 runs of layer hold."""
    for m in _BASE64.finditer(layer.text):
        run = m[0].partition("%")[0].rstrip("=")
        places = [(0, len(run))]
        if "\n" not in run and _SIGN.search(run) and _clean(whole := _decoded(run)) < len(whole):
            places = [p for p in _parts(run) if p != places[0]] + places
        for first, last in places:
            yield from _opened(layer, "base64", _decoded(run[first:last]), m.start() + first, m.end() if last == len(run) else m.start() + last)


def _children(layer: Layer) -> Iterator[Layer]:
    """What the decoders make of a layer."""
    text = layer.text
    if "%" in text and (new := _runs(layer, "url", _URL, _url)):
        yield new
    if ("\\" in text or "&#" in text) and (new := _runs(layer, "unicode", _UNICODE, _unicode)):
        yield new
    yield from _base64(layer)
    if any(x in text for x in ("%", "\\", "&#")):
        yield from _escaped(layer)


def scan(text: str) -> list[tuple[str, int, int, int, str, str]]:
    """(rule, start, end, depth, path, hash of the secret) of each secret, sorted by place; path names the decoders."""
    found: dict[tuple[str, str], dict[tuple[int, int], tuple[int, str]]] = {}
    met: dict[tuple[bytes, int, int], int] = {}  # the least depth of each layer by its content and span

    def new(layers: Iterator[Layer]) -> Iterator[Layer]:
        for x in layers:
            key = (hashlib.blake2b(x.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), *x.origin(0, len(x.text)))
            if len(x.path) < met.get(key, len(x.path) + 1):
                met[key] = len(x.path)
                yield x

    work = [new(iter([Layer(text)]))]  # a layer's children are made one by one, so that a stream of pieces isn't held
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        lower = layer.text.lower()
        for rule, anchors, pattern in RULES:
            if any(a in lower for a in anchors):
                for m in pattern.finditer(layer.text):
                    if is_secret(rule, m[1] if m.re.groups else m[0]):
                        digest = hashlib.sha256(m[0].encode("utf-8", "surrogatepass")).hexdigest()[:16]
                        spans, at = found.setdefault((rule, digest), {}), layer.origin(m.start(), m.end())
                        spans[at] = min(spans.get(at, (1 << 30, "")), (len(layer.path), ">".join(layer.path)))
        work.append(new(_children(layer)))
    # a run that is decoded from its parts and as a whole gives a secret by the closest spans
    return sorted((rule, *at, *how, digest) for (rule, digest), spans in found.items() for at, how in closest(spans).items())


def closest(spans: dict[tuple[int, int], tuple[int, str]]) -> dict[tuple[int, int], tuple[int, str]]:
    """spans without those that hold another."""
    out: dict[tuple[int, int], tuple[int, str]] = {}
    least = None  # the least end of those that begin later
    for start, end in sorted(spans, key=lambda x: (-x[0], x[1])):
        if least is None or end < least:
            out[start, end] = spans[start, end]
            least = end
    return out


def redact(text: str) -> str:
    """text with every span that holds a secret replaced by [SECRET]; spans that overlap are replaced as one."""
    out, at = [], 0
    spans = sorted((s, e) for _, s, e, *_ in scan(text))
    i = 0
    while i < len(spans):
        start, end = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < end:
            i += 1
            end = max(end, spans[i][1])
        out += [text[at:start], MASK]
        at = end
        i += 1
    return "".join([*out, text[at:]])


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rule, start, end, depth, path, secret_hash), a row for every finding.

    start and end are the characters of the text that hold the secret, encoded or not; depth is the number of decoders
    and path names them from the outside, so "" is plain text. secret_hash is the head of the SHA-256 of the match: the
    result itself holds no secret. A secret is told once for a rule and span, from the outermost layer. Texts and layers of
    any length are scanned whole. Null and empty texts have no findings; repeated rows have their findings again. Other
    columns are not read, and an empty table gives an empty result.
    """
    source = small_batches(docs).select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1)):
                for found in scan(text.as_py() or ""):
                    at.append(i)
                    rows.append(found)
            rule, start, end, depth, path, digest = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(rule, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(depth, pa.int32()), pa.array(path, pa.string()), pa.array(digest, pa.string())],
                names=["doc_id", "rule", "start", "end", "depth", "path", "secret_hash"],
            )

    text, long = T.StringType(), T.LongType()
    columns = [("rule", text), ("start", long), ("end", long), ("depth", T.IntegerType()), ("path", text), ("secret_hash", text)]
    return source.mapInArrow(run, T.StructType([source.schema["doc_id"], *(T.StructField(n, t) for n, t in columns)]))


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with the secrets of every text replaced, and length_col, if there is such a column, set to the new length.

    All rows and columns stay; a null text stays null with its length as it was, and an empty one or one without secrets
    is as it was. Repeated rows are treated alike; an empty table gives an empty one.
    """
    at = docs.columns.index(text_col)
    length = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            old = columns[at].to_pylist()
            new = [t and redact(t) for t in old]
            columns[at] = pa.array(new, columns[at].type)
            if length is not None:
                sizes = columns[length].to_pylist()
                columns[length] = pa.array([n if a == b else len(b) for n, a, b in zip(sizes, old, new)], columns[length].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return small_batches(docs).mapInArrow(run, docs.schema)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
