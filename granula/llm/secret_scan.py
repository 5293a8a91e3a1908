"""Secret scan with multipart credential linking, in DataFrame functions only.

Strong patterns (assignments, access identifiers, long hexadecimal runs) are reported as
they stand. Weak candidates (long base-64 runs, temporary identifiers, endpoints) are only
reported where complementary parts lie within LINK_CHARS of each other in the same
document: an identifier with a secret, an endpoint with both. The interval join runs
inside each row: parts are sorted by position and running maxima and minima give each part
its nearest partner, so it neither shuffles nor compares all pairs.

Defined results: a null or empty text has no spans; null doc_ids and repeated rows are
kept; an empty table gives an empty result; input columns named like a result column are
replaced. Offsets are code points, end exclusive; spans carry their byte offsets, too, so
that redaction cuts a long text without counting its characters again for each span. All
steps are running sums, maxima and minima over sorted parts: n log n in the parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granula.llm.base import drop_clashes, let, scan, table, text_of

#: Fixed patterns of the scan.
ASSIGN = r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
WEAK_SECRET = r"[A-Za-z0-9+/]{40,}={0,2}"
WEAK_IDENT = r"(?:ASIA|AROA|AIDA)[A-Z0-9]{12,}"
ENDPOINT = r"(?:https?|s3|gs)://[A-Za-z0-9._~:/?#@!$&'()*+,;=%-]+"
LINK_CHARS = 200
#: In the order of ties; the role says which part of a credential a span is.
KINDS = (("assign", "secret"), ("access", "ident"), ("hex", "secret"), ("weak_secret", "secret"), ("weak_ident", "ident"), ("endpoint", "endpoint"))
BASE = ("assign", "access", "hex")
SPAN = "array<struct<start:bigint,end:bigint,rank:int,from:bigint,to:bigint>>"


def spans(text: Column, pattern: str, rank: int, group_min: int = 0) -> Column:
    """Start and end of the leftmost non-overlapping matches, as code points, and from and to, as bytes.

    The pieces between matches and the matches alternate, so running sums of their lengths
    are the offsets. ``group_min``: matches whose group 1 is shorter are dropped afterwards.
    """
    P = F.lit(pattern)
    gaps, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, P, F.lit(0))
    size = F.transform(F.regexp_extract_all(text, P, F.lit(1)), lambda g: F.length(g)) if group_min else F.transform(whole, lambda m: F.lit(0))

    def located(found: Column) -> Column:
        # split and the matches come from the same search, so gap k precedes match k
        def ends(measure) -> Column:
            length = F.zip_with(F.slice(found["gaps"], F.lit(1), F.size(found["whole"])), found["whole"], lambda g, m: (measure(g) + measure(m)).cast("long"))
            return let(length, lambda x: scan(x, lambda a, b: a + b, F.lit(0).cast("long")))

        rows = F.arrays_zip(ends(F.length).alias("end"), ends(F.octet_length).alias("to"), found["whole"].alias("m"), found["size"].alias("size"))
        ok = F.filter(rows, lambda t: t["size"] >= group_min)
        return F.transform(
            ok, lambda t: F.struct((t["end"] - F.length(t["m"])).alias("start"), t["end"].alias("end"), F.lit(rank).alias("rank"), (t["to"] - F.octet_length(t["m"])).alias("from"), t["to"].alias("to"))
        )

    found = F.struct(gaps.alias("gaps"), whole.alias("whole"), size.alias("size"))
    return F.when(text.rlike(pattern), let(found, located)).otherwise(F.array().cast(SPAN)).cast(SPAN)


def around(parts: Column, chosen) -> tuple[Column, Column]:
    """Of the sorted parts that are ``chosen``: the greatest end up to each part, and the least start from it on."""
    low, high = F.lit(-(1 << 60)).cast("long"), F.lit(1 << 60).cast("long")
    before = scan(F.transform(parts, lambda p: F.when(chosen(p), p["end"]).otherwise(low)), lambda a, b: F.greatest(a, b), low)
    after = F.reverse(scan(F.reverse(F.transform(parts, lambda p: F.when(chosen(p), p["start"]).otherwise(high))), lambda a, b: F.least(a, b), high))
    return before, after


def clear(parts: Column) -> Column:
    """Sorted parts without the weak ones that overlap a strong one."""
    strong = lambda p: p["rank"] < len(BASE)

    def kept(all_parts: Column) -> Column:
        before, after = around(all_parts, strong)
        rows = F.arrays_zip(all_parts.alias("p"), before.alias("b"), after.alias("a"))
        return F.transform(F.filter(rows, lambda x: strong(x["p"]) | ((x["b"] <= x["p"]["start"]) & (x["a"] >= x["p"]["end"]))), lambda x: x["p"])

    return let(parts, kept)


def linked(parts: Column, reach: int = LINK_CHARS) -> Column:
    """Of all parts sorted by position, the strong ones and the weak ones with partners in reach.

    Needs: an identifier needs a secret, a secret an identifier, an endpoint both.
    """
    role_of = F.array(*[F.lit(role) for _, role in KINDS])
    has = lambda p, role: F.get(role_of, p["rank"]) == role

    def near(all_parts: Column, role: str) -> Column:
        before, after = around(all_parts, lambda p: has(p, role))
        both = F.arrays_zip(all_parts.alias("p"), before.alias("b"), after.alias("a"))
        return F.transform(both, lambda x: (x["b"] >= x["p"]["start"] - reach) | (x["a"] <= x["p"]["end"] + reach))

    def judged(all_parts: Column) -> Column:
        rows = F.arrays_zip(all_parts.alias("p"), near(all_parts, "ident").alias("ident"), near(all_parts, "secret").alias("secret"))
        keep = lambda x: (
            (x["p"]["rank"] < len(BASE))
            | (has(x["p"], "secret") & x["ident"])
            | (has(x["p"], "ident") & x["secret"])
            | (has(x["p"], "endpoint") & x["ident"] & x["secret"])
        )
        return F.transform(F.filter(rows, keep), lambda x: x["p"])

    return let(clear(parts), lambda rest: let(rest, judged))


def scanned(df: DataFrame, text: str = "text", reach: int = LINK_CHARS) -> DataFrame:
    """``df`` with ``secret_spans``: array of (start, end, rank into KINDS, from, to) sorted by start, then rank.

    Weak candidates that overlap a strong span are parts of it and not reported again.
    """
    body = text_of(text)
    strong = {
        "__assign": spans(body, ASSIGN, 0, group_min=6),
        "__access": spans(body, ACCESS, 1),
        "__hex": spans(body, HEX, 2),
    }
    out = drop_clashes(df, ["secret_spans", *strong, "__weak", "__parts"]).withColumns(strong)
    ident = (F.size("__access") > 0) | body.rlike(WEAK_IDENT)
    # without an identifier no weak candidate can be completed
    weak = F.when(ident, F.concat(spans(body, WEAK_SECRET, 3), spans(body, WEAK_IDENT, 4), spans(body, ENDPOINT, 5))).otherwise(F.array().cast(SPAN))
    ordered = F.sort_array(F.transform(F.concat("__assign", "__access", "__hex", "__weak"), lambda p: F.struct(*[p[k].alias(k) for k in ("start", "rank", "end", "from", "to")])))
    found = F.when(F.size("__weak") > 0, linked(F.col("__parts"), reach)).otherwise(F.col("__parts"))
    return out.withColumn("__weak", weak).withColumn("__parts", ordered).withColumn("secret_spans", found).drop(*strong, "__weak", "__parts")


def redacted(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` (of scanned()) with every span in its text replaced by ``mark``; overlapping spans count as one.

    A mark stands where a span starts at or after the greatest end before it; what lies
    between is cut from the bytes of the text.
    """
    zero = F.lit(0).cast("long")

    def cut(x: Column) -> Column:
        before = F.concat(F.array(zero), x["ends"])  # one more than there are spans
        heads = F.filter(F.arrays_zip(x["spans"].alias("p"), F.slice(before, F.lit(1), F.size(x["spans"])).alias("b")), lambda r: r["p"]["from"] >= r["b"])
        piece = lambda at, size: F.decode(F.substr(x["bytes"], (at + 1).cast("int"), size.cast("int")), "UTF-8")
        out = F.transform(heads, lambda r: F.concat(piece(r["b"], r["p"]["from"] - r["b"]), F.lit(mark)))
        last = F.element_at(x["ends"], -1)
        return F.concat(F.array_join(out, ""), piece(last, F.octet_length(x["bytes"]) - last))

    ends = let(F.transform("secret_spans", lambda p: p["to"]), lambda x: scan(x, lambda a, b: F.greatest(a, b), zero))
    whole = F.struct(F.encode(text_of(text), "UTF-8").alias("bytes"), F.col("secret_spans").alias("spans"), ends.alias("ends"))
    return df.withColumn(text, F.when(F.size("secret_spans") > 0, let(whole, cut)).otherwise(F.col(text)))


def digest(parts: Column) -> Column:
    names = F.array(*[F.lit(k) for k, _ in KINDS])
    return F.array_join(F.transform(parts, lambda p: F.concat_ws(":", F.get(names, p["rank"]), p["start"].cast("string"), p["end"].cast("string"))), ",")


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Base counts, the digest of the base spans and all spans of every document."""
    rows = scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda rank: F.size(F.filter("secret_spans", lambda p: p["rank"] == rank)).cast("long")
    base = F.filter("secret_spans", lambda p: p["rank"] < len(BASE))
    return rows.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("secret_spans")).alias("spans"),
    )


def _sql_spans(rank: int, pattern: str, group: str) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT rid, unnest(list_zip(string_split_regex(t, '{p}')[:len(regexp_extract_all(t, '{p}'))], regexp_extract_all(t, '{p}'), {group.format(p=p)}, range(1, len(regexp_extract_all(t, '{p}')) + 1))) AS z, {rank} AS rank FROM d WHERE regexp_matches(t, '{p}')"""


#: The same patterns; links by a plain theta join within each document.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
z AS ({" UNION ALL ".join(_sql_spans(k, p, "regexp_extract_all(t, '{p}', 1)" if not k else "regexp_extract_all(t, '{p}')") for k, p in enumerate((ASSIGN, ACCESS, HEX, WEAK_SECRET, WEAK_IDENT, ENDPOINT)))}),
s AS (SELECT rid, rank, e - length(m) AS a, e AS b FROM (
  SELECT rid, rank, z[2] AS m, z[3] AS g, sum(length(z[1]) + length(z[2])) OVER (PARTITION BY rid, rank ORDER BY z[4]) AS e FROM z)
  WHERE rank > 0 OR length(g) >= 6),
p AS (SELECT * FROM s WHERE rank < 3 OR NOT EXISTS (SELECT 1 FROM s q WHERE q.rid = s.rid AND q.rank < 3 AND q.a < s.b AND s.a < q.b)),
k AS (SELECT *,
  EXISTS (SELECT 1 FROM p q WHERE q.rid = p.rid AND q.rank IN (1, 4) AND q.b >= p.a - {LINK_CHARS} AND q.a <= p.b + {LINK_CHARS}) AS ident,
  EXISTS (SELECT 1 FROM p q WHERE q.rid = p.rid AND q.rank IN (0, 2, 3) AND q.b >= p.a - {LINK_CHARS} AND q.a <= p.b + {LINK_CHARS}) AS secret FROM p),
f AS (SELECT rid, rank, a, ['assign', 'access', 'hex', 'weak_secret', 'weak_ident', 'endpoint'][rank + 1] || ':' || a::BIGINT || ':' || b::BIGINT AS s FROM k
  WHERE rank < 3 OR (rank = 3 AND ident) OR (rank = 4 AND secret) OR (rank = 5 AND ident AND secret)),
g AS (SELECT rid, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  string_agg(s, ',' ORDER BY a, rank) FILTER (rank < 3) AS base, string_agg(s, ',' ORDER BY a, rank) AS spans FROM f GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""
