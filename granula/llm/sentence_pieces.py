"""Exact encoding and decoding of merge-type SentencePiece models by backtracking.

The model file is read here; its library is not used on the main path. A text is cut where
no piece can span two neighbouring characters, so each chunk (usually one word with its
space mark) is encoded alone and its result kept in a bounded table.

A chunk: longest matches come from an Aho-Corasick automaton over the pieces. The tokens of
the true encoding are found left to right: the longest match is tried first, a token is
accepted after its neighbour if merging the two again gives the same two tokens, and
otherwise the next shorter prefix is tried. Positions from which no ending was found are
marked in a bit field, so no position fails twice. Chunks in which pieces of equal score
compete (runs of space marks) are merged directly.

Defined results: a null text is empty and has no tokens; characters outside the vocabulary
fall back to their UTF-8 bytes where the model has them and else to the unknown piece;
control pieces are never produced from a text. Other columns pass through; columns named
like a result column are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granula.llm.base import drop_clashes, slices, table

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
CACHE = 400_000


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol-buffer message; fixed and length-delimited values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}[kind] if kind != 2 else varint()
        yield key >> 3, data[at : at + n]
        at += n


class Model:
    """Pieces, scores and kinds of a model file, and its text normalisation flags."""

    def __init__(self, data: bytes):
        self.pieces, self.scores, self.kinds = [], [], []
        self.dummy_prefix, self.squeeze, self.escape, self.bpe = True, True, True, False
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for k, v in _fields(value):
                    if k == 1:
                        piece = v.decode()
                    elif k == 2:
                        score = struct.unpack("<f", v)[0]
                    elif k == 3:
                        kind = v
                self.pieces.append(piece), self.scores.append(score), self.kinds.append(kind)
            elif number == 2:
                self.bpe = dict(_fields(value)).get(3, 1) == 2
            elif number == 3:
                spec = dict(_fields(value))
                self.dummy_prefix, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
                if spec.get(2):
                    raise ValueError("models with a character map are not supported")
        if not self.bpe or USER in self.kinds or self.squeeze:
            raise ValueError("only merge-type models without user pieces and with spaces kept are supported")
        self.unknown = self.kinds.index(UNKNOWN)
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}


class Pieces:
    """Encoder and decoder of one model."""

    def __init__(self, model: Model):
        self.model = model
        self.ids = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k in (NORMAL, UNUSED)}
        self.text = [p if k == NORMAL else "" for p, k in zip(model.pieces, model.kinds, strict=True)]
        byte_of = {i: b for b, i in model.byte.items()}
        self.raw = [bytes([byte_of[i]]) if i in byte_of else p.replace(MARK, " ").encode() for i, p in enumerate(self.text)]
        self.raw[model.unknown] = " ⁇ ".encode()  # fixed surface of the unknown piece
        count: dict[float, int] = {}
        for p, i in self.ids.items():
            if len(p) > 1:
                count[model.scores[i]] = count.get(model.scores[i], 0) + 1
        self.tied = [p for p, i in self.ids.items() if len(p) > 1 and count[model.scores[i]] > 1]
        self._automaton()
        self._cuts()
        # pieces of equal score that a chunk with one space mark can hold, and the characters that are pieces
        self.tied = [p for p in self.tied if p.count(MARK) < 2]
        self.single = frozenset(p for p in self.ids if len(p) == 1)
        self.known: dict[str, tuple[int, bytes, bytes]] = {}
        self.older: dict[str, tuple[int, bytes, bytes]] = {}
        self.fits: dict[tuple[str, str], bool] = {}

    def _automaton(self) -> None:
        """Aho-Corasick automaton over the pieces, and for each piece the next shorter one that is its prefix."""
        import ahocorasick

        self.find = ahocorasick.Automaton()
        self.shorter: dict[str, str | None] = {}
        for p in self.ids:
            self.find.add_word(p, len(p))
        self.find.make_automaton()
        for p in self.ids:
            self.shorter[p] = next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.ids), None)

    def _cuts(self) -> None:
        """A text may be cut between two characters that no piece holds side by side."""
        inner = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        used = {c for pair in inner for c in pair}
        self.by_word = not any(pair[1] == MARK and pair[0] != MARK for pair in inner)
        # white space and control characters that take part in no piece of two characters stand alone
        alone = "".join(re.escape(chr(c)) for c in range(32) if chr(c) not in used)
        self.chunk = re.compile(rf"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (rf"|[{alone}]" if alone else ""))

    def merged(self, chunk: str) -> list[str]:
        """The tokens by merging: the best score first, the leftmost of equals."""
        ids, scores = self.ids, self.model.scores
        part: list[str | None] = list(chunk)
        left, right = list(range(-1, len(part) - 1)), list(range(1, len(part) + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(a: int) -> None:
            b = right[a]
            if a >= 0 and b < len(part) and (i := ids.get(both := part[a] + part[b])) is not None:
                heapq.heappush(heap, (-scores[i], a, both))

        for a in range(len(part) - 1):
            offer(a)
        while heap:
            _, a, both = heapq.heappop(heap)
            if part[a] is None or (b := right[a]) >= len(part) or part[a] + part[b] != both:
                continue
            part[a], part[b], right[a] = both, None, right[b]
            if right[b] < len(part):
                left[right[b]] = a
            offer(left[a])
            offer(a)
        return [p for p in part if p is not None]

    def _fit(self, a: str, b: str) -> bool:
        """Whether merging the two tokens' characters again gives the two tokens."""
        fit = self.fits.get((a, b))
        if fit is None:
            if len(self.fits) > CACHE:
                self.fits.clear()
            fit = self.fits[a, b] = self.merged(a + b) == [a, b]
        return fit

    def backtracked(self, chunk: str) -> list[str] | None:
        """The tokens of a chunk whose characters are all pieces, or None if no compatible row of tokens exists."""
        longest = [1] * len(chunk)
        for end, n in self.find.iter(chunk):
            if n > longest[end - n + 1]:
                longest[end - n + 1] = n
        failed, out, at = bytearray(len(chunk) // 8 + 1), [], 0  # a bit for each position
        token: str | None = chunk[: longest[0]]
        while True:
            while token is not None:
                end = at + len(token)
                if not failed[end >> 3] >> (end & 7) & 1 and (not out or self._fit(out[-1], token)):
                    out.append(token)
                    if end == len(chunk):
                        return out
                    at = end
                    token = chunk[at : at + longest[at]]
                else:
                    token = self.shorter[token]
            failed[at >> 3] |= 1 << (at & 7)
            if not out:
                return None
            token = out.pop()
            at -= len(token)
            token = self.shorter[token]

    def tokens(self, chunk: str) -> list[str]:
        if chunk.count(MARK) > 1 or any(p in chunk for p in self.tied) or not self.single.issuperset(chunk):
            return self.merged(chunk)
        found = self.backtracked(chunk)
        return self.merged(chunk) if found is None else found

    def chunk_ids(self, chunk: str) -> list[int]:
        out: list[int] = []
        unknown = False
        for t in self.tokens(chunk):
            i = self.ids.get(t)
            if i is not None and self.model.kinds[i] != UNUSED:
                out.append(i)
                unknown = False
            elif self.model.byte:
                out += [self.model.byte[b] for b in t.encode()]
            elif not unknown:  # neighbouring unknown characters are one piece
                out.append(self.model.unknown)
                unknown = True
        return out

    def _normal(self, text: str) -> str:
        if not text:
            return ""
        if self.model.dummy_prefix:
            text = " " + text
        return text.replace(" ", MARK) if self.model.escape else text

    def chunks(self, text: str) -> list[str]:
        text = self._normal(text)
        return self.chunk.findall(text) if self.by_word else [text] * bool(text)

    def encode(self, text: str) -> list[int]:
        return [i for c in self.chunks(text) for i in self.chunk_ids(c)]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; bytes that are not UTF-8 become U+FFFD each."""
        data = b"".join([self.raw[i] for i in ids])
        if self.model.dummy_prefix and ids and self.text[ids[0]].startswith(MARK):
            data = data[1:]
        return _utf8(data)

    def joined(self, text: str) -> tuple[int, bytes, bytes]:
        """(tokens, decimal ids joined by commas, UTF-8 of the decoded text), by the table of chunks."""
        if len(self.known) > CACHE:  # two generations: what is still in use moves on
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        parts = self.chunks(text)
        for c in set(parts).difference(known):
            row = older.get(c)
            if row is None:
                ids = self.chunk_ids(c)
                row = len(ids), ",".join(map(str, ids)).encode(), b"".join([self.raw[i] for i in ids])
            known[c] = row
        rows = list(map(known.__getitem__, parts))
        data = b"".join([r[2] for r in rows])
        if self.model.dummy_prefix and parts and data[:1] == b" ":
            data = data[1:]
        return sum([r[0] for r in rows]), b",".join([r[1] for r in rows]), _utf8(data).encode()

    def digests(self, text: str) -> tuple[int, str, str]:
        """joined() with the SHA-256 of its ids and its text."""
        n, ids, data = self.joined(text)
        return n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(data).hexdigest()


def _utf8(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode(errors="replace")


#: Texts whose ids a worker holds at once.
HELD = 256
_loaded: dict[bytes, Pieces] = {}


def pieces(data: bytes) -> Pieces:
    """One encoder per process and model."""
    key = hashlib.sha256(data).digest()
    if key not in _loaded:
        _loaded[key] = Pieces(Model(data))
    return _loaded[key]


def model_bytes(path: str | None = None) -> bytes:
    """The model file; by default the public 32k model. The file (under 1 MB) travels with the tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def encoded(df: DataFrame, model: bytes, text: str = "text", ids: bool = True) -> DataFrame:
    """``df`` with n_tokens, ids_sha256, decoded_sha256 and, if asked for, token_ids and decoded."""
    names = ["n_tokens", "ids_sha256", "decoded_sha256", *["token_ids", "decoded"] * ids]
    rows = drop_clashes(df, [n for n in names if n.lower() != text.lower()])
    columns = rows.columns
    at = columns.index(text)
    sent = df.sparkSession.sparkContext.broadcast(model)  # one model file, under 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pieces(sent.value)
        for batch in slices(batches, HELD):
            found = [encoder.joined(t or "") for t in batch.column(at).to_pylist()]
            out = [pa.array([f[0] for f in found], pa.int64()), *(pa.array([hashlib.sha256(f[k]).hexdigest() for f in found], pa.string()) for k in (1, 2))]
            if ids:
                lists = pc.cast(pc.split_pattern(pa.array([f[1] for f in found], pa.string()), ","), pa.list_(pa.string()))
                numbers = pc.cast(pc.if_else(pc.equal(lists.flatten(), ""), None, lists.flatten()), pa.int32())
                empty = pa.array([not f[0] for f in found])
                whole = pa.ListArray.from_arrays(lists.offsets, numbers)
                out += [pc.if_else(empty, pa.scalar([], pa.list_(pa.int32())), whole), pa.array([f[2].decode() for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*columns, *names])

    from pyspark.sql import types as T

    kinds = [T.LongType(), T.StringType(), T.StringType(), T.ArrayType(T.IntegerType()), T.StringType()]
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds, strict=False))])
    return rows.mapInArrow(run, schema)


def op6_sentence_pieces(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return encoded(docs, model_bytes(), ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
