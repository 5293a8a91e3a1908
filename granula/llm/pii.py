"""Personal data with offset-preserving deobfuscation.

Base patterns run on the text as it is. Disguised identifiers are found in a normalised
copy: transducers map homoglyphs, full-width forms and decimal digits of any script to
ASCII, drop zero-width characters, turn "[at]", "(dot)" and "jo dot doe at host dot com"
into their signs, and runs of spelled or dotted numbers into digits. Every character of the
copy keeps the source offsets it came from, so a span found in the copy is mapped back to
source characters. Spans that contain a rewritten part are added unless a base span holds
them; an added span may contain a base one, which stays.

Defined results: a null or empty text has no spans; offsets are code points, end exclusive;
repeated rows and null ids are kept; an empty table gives an empty result; a column of the
result's name is replaced. Every scan is anchored at a sign or a word that it reads onwards
from, or goes over tokens once, so its cost is linear in the text and very long texts are
safe.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granula.llm.base import drop_clashes, slices, table

KINDS = ("email", "ip", "card", "phone")
#: Rows whose texts are Python objects at once.
HELD = 256

#: Fixed look-alikes (Cyrillic and Greek) of ASCII letters, source and target in the same place.
LOOKALIKE = "АВЕКМНОРСТХУаеорсухіјѕһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανι"
LOOKS_LIKE = "ABEKMHOPCTXYaeopcyxijshdqwABEZHIKMNOPTYXoavi"
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
SPELLED = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")

_DIGITS = {chr(c): str(unicodedata.decimal(chr(c))) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"}
_CHARS = _DIGITS | dict(zip(LOOKALIKE, LOOKS_LIKE, strict=True)) | {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | dict.fromkeys(ZERO_WIDTH, "")
_ODD = re.compile(f"[{''.join(map(re.escape, _CHARS))}]")
_TABLE = str.maketrans(_CHARS)
_ODD_CODES = np.array(sorted(map(ord, _CHARS)), np.uint32)
_GONE_CODES = np.array(sorted(map(ord, ZERO_WIDTH)), np.uint32)
_DIGIT = re.compile("[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SIGN = re.compile(r"(?i)[\[({<]\s*(?:(at|arroba|@)|(dot|punto|punkt|point|\.))\s*[\])}>]")
_DOT = re.compile(r"(?i)(?<![A-Za-z0-9])dot(?![A-Za-z0-9])")
_THREE = re.compile("(?<![a-z0-9])" + r"[\s,-]+".join(["(?:" + "|".join(SPELLED) + ")"] * 3))
_NUMBER = re.compile(r"(?i)(?<![A-Za-z0-9])(?:(plus)|(dot|point)|(" + "|".join(SPELLED) + r")|([0-9]++))(?![A-Za-z0-9])")
_BETWEEN = re.compile(r"[\s,-]+")
_TOKEN = re.compile(r"\S+")
_WHOLE = re.compile(r"[A-Za-z0-9._%+-]+")
_TAIL = re.compile(r"[A-Za-z0-9._%+-]+$")
_HEAD = re.compile(r"[A-Za-z0-9-]+")
_MAIL = re.compile(r"[A-Za-z0-9._%+-]@[A-Za-z0-9.-]+$")
#: Kinds of tokens: W all local characters, S such an end, E such a start, B both, M an end with an @, d and a the words, x others.
_SAID = re.compile(r"(?:(?<!d)W|[SB])(?:dW)*a(?:Wd)+[WEB]|Md(?:Wd)*[WEB]")
_VALUE = {w: str(i) for i, w in enumerate(SPELLED)}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each @: the longest run of local characters before it, as far as the last match allows, and a domain after it."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        free = at + 1 if start == at else free
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind and start."""
    out = []
    if "@" in text:
        out += [(0, a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(g.lstrip("0")) < 4 and int(g.lstrip("0") or 0) < 256 for g in m.groups())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m.group().replace(" ", "").replace("-", "")
                if len(digits) <= 19 and len(digits) >= 16 and luhn(digits):
                    out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m.group())) <= 15]
    return out


class Copy:
    """A rewritten text: character k came from the source characters start[k] to end[k]."""

    def __init__(self, text: str):
        n = len(text)
        self.text, self.start, self.end, self.changed = text, np.arange(n), np.arange(1, n + 1), np.zeros(n, bool)

    def fold(self) -> None:
        """Map odd characters one by one; those that map to nothing go and mark their neighbours."""
        codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        odd, gone = np.isin(codes, _ODD_CODES), np.isin(codes, _GONE_CODES)
        mark = odd | np.append(gone[1:], False) | np.append(False, gone[:-1])
        self.text = self.text.translate(_TABLE)
        self.start, self.end, self.changed = self.start[~gone], self.end[~gone], mark[~gone]

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace ranges by texts that are not empty; edits are sorted and do not overlap."""
        if not edits:
            return
        a, b, size = (np.array(x) for x in zip(*[(a, b, len(new)) for a, b, new in edits], strict=True))
        text, at = [], 0
        for x, y, new in edits:
            text += [self.text[at:x], new]
            at = y
        text.append(self.text[at:])
        inside = np.zeros(len(self.text) + 1, np.int64)
        inside[a] += 1
        np.add.at(inside, b, -1)
        kept = np.flatnonzero(np.cumsum(inside[:-1]) == 0)
        owner = np.repeat(np.arange(len(a)), size)
        order = np.argsort(np.concatenate([kept, a[owner]]), kind="stable")  # an edit stands where its range began
        self.start, self.end, self.changed = (
            np.concatenate([old[kept], new[owner]])[order]
            for old, new in ((self.start, self.start[a]), (self.end, self.end[b - 1]), (self.changed, np.ones(len(a), bool)))
        )
        self.text = "".join(text)


def disguised(text: str) -> bool:
    """Whether any transducer can rewrite something; cheap on plain texts."""
    if not text.isascii() and _ODD.search(text):
        return True
    if any(c in text for c in "[({<") and _SIGN.search(text):
        return True
    low = text.lower()
    return "dot" in low and bool(_DOT.search(text)) or low.count("point") > 2 or bool(_THREE.search(low))


def _signs(text: str) -> list[tuple[int, int, str]]:
    """Bracketed at and dot with the white space around them; each white space is looked at by its two neighbours at most."""
    edits, free = [], 0
    for m in _SIGN.finditer(text):
        a, b = m.span()
        while a > free and text[a - 1].isspace():
            a -= 1
        while b < len(text) and text[b].isspace():
            b += 1
        edits.append((a, b, "@" if m.group(1) else "."))
        free = b
    return edits


def _token_kind(token: str) -> str:
    low = token.lower()
    if low in ("at", "dot"):
        return low[0]
    if _WHOLE.fullmatch(token):
        return "W"
    last, first = token[-1] in _LOCAL, token[0].isascii() and (token[0].isalnum() or token[0] == "-")
    if last and "@" in token and _MAIL.search(token[-320:]):
        return "M"
    return "B" if last and first else "S" if last else "E" if first else "x"


def _said(text: str) -> list[tuple[int, int, str]]:
    """The words at and dot between the parts of an address, with the white space around them."""
    if not _DOT.search(text):
        return []
    tokens = list(_TOKEN.finditer(text))
    kinds = "".join([_token_kind(t.group()) for t in tokens])
    edits = []
    for m in _SAID.finditer(kinds):
        for k in range(m.start() + 1, m.end(), 2):
            edits.append((tokens[k - 1].end(), tokens[k + 1].start(), "@" if kinds[k] == "a" else "."))
    return edits


def _numbers(text: str) -> list[tuple[int, int, str]]:
    """Runs of spelled digits and numbers, with plus before and dot or point between them; each item takes the separators after it.

    A run counts if it has three spelled digits, or three dots between numbers.
    """
    edits: list[tuple[int, int, str]] = []
    run: list[re.Match] = []

    def close() -> None:
        while run and run[-1].group(2):
            run.pop()
        while run and run[0].group(2):
            run.pop(0)
        spelled, dots = sum(1 for m in run if m.group(3)), sum(1 for m in run if m.group(2))
        if len(run) > 3 and (spelled > 2 or dots > 2):
            for k, m in enumerate(run):
                new = "+" if m.group(1) else "." if m.group(2) else _VALUE.get(m.group().lower(), m.group())
                edits.append((m.start(), run[k + 1].start() if k + 1 < len(run) else m.end(), new))
        run.clear()

    for m in _NUMBER.finditer(text):
        if run and (m.group(1) or not _BETWEEN.fullmatch(text, run[-1].end(), m.start())):
            close()
        run.append(m)
    close()
    return edits


def normalised(text: str) -> Copy:
    copy = Copy(text)
    if not text.isascii():
        copy.fold()
    for transducer in (_signs, _said, _numbers):
        copy.rewrite(transducer(copy.text))
    return copy


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and base and added spans; both by kind and start."""
    base = base_spans(text)
    if not disguised(text):
        return base, base
    copy = normalised(text)
    added = set()
    for kind, a, b in base_spans(copy.text):
        if copy.changed[a:b].any():
            start, end = int(copy.start[a]), int(copy.end[b - 1])
            while end > start and text[end - 1].isspace():
                end -= 1
            while start < end and text[start].isspace():
                start += 1
            added.add((start, -end, kind))
    # a sweep by start: the greatest end of the base spans that start no later decides whether one holds the added span
    free, k, reach = [], 0, 0
    taken = sorted((a, b) for _, a, b in base)
    for start, end, kind in sorted(added):
        while k < len(taken) and taken[k][0] <= start:
            reach = max(reach, taken[k][1])
            k += 1
        if reach < -end:
            free.append((kind, start, -end))
    return base, sorted([*base, *free])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for k, a, b in spans])


def pii_spans(df: DataFrame, text: str = "text", name: str = "pii") -> DataFrame:
    """``df`` with an array of (kind, start, end, base) sorted by start, the longer first."""
    rows = drop_clashes(df, [name])
    columns = rows.columns
    at = columns.index(text)
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def one(value: str | None) -> list[dict]:
        base, spans = all_spans(value or "")
        known = set(base)
        return [{"kind": KINDS[k], "start": a, "end": b, "base": (k, a, b) in known} for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, HELD):
            found = pa.array([one(t) for t in batch.column(at).to_pylist()], arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*columns, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, kind)]))


def mask(text: str, spans: list[dict]) -> str:
    """Spans (sorted by start) replaced by their kind in brackets; overlapping ones become one, named by the first."""
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def masked(df: DataFrame, text: str = "text", name: str = "pii") -> DataFrame:
    """``df`` of pii_spans() with its spans masked in the text; a null text stays null."""
    columns = df.columns
    at, of = columns.index(text), columns.index(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, HELD):
            found = [t if t is None or not s else mask(t, s) for t, s in zip(batch.column(at).to_pylist(), batch.column(of).to_pylist(), strict=True)]
            arrays = list(batch.columns)
            arrays[at] = pa.array(found, arrays[at].type)
            yield pa.RecordBatch.from_arrays(arrays, columns)

    return df.mapInArrow(run, df.schema)


def op5_pii(spark, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans and all spans of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, HELD):
            found = [all_spans(t or "") for t in batch.column(1).to_pylist()]
            counts = [[sum(s[0] == k for s in base) for base, _ in found] for k in range(len(KINDS))]
            digests = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array([joined(s) for _, s in found], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
