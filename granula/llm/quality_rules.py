"""Rule bitmask ledger for document quality, in DataFrame functions only.

Every rule is evaluated once per document. The ledger keeps the measurements and one
integer of failure bits; a policy is a versioned mask over those bits, so a new policy or
an ablation never reads a text again.

Defined results: a null or empty text has no words and all measurements 0 (it fails
``few_words``); a null doc_id is kept as it is; repeated rows give repeated results; an
empty table gives an empty ledger; columns of the input that share a name with a ledger
column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granula.llm.base import SPACE, drop_clashes, let, table, text_of, words_of

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs")


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``sql`` over the measurements is true; its bit never changes meaning."""

    bit: int
    name: str
    sql: str


#: Integer arithmetic only, so any engine evaluates the rules alike.
RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 10 * word_chars"),
    Rule(3, "repeated_lines", "n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "exclamations", "100 * n_bangs > 10 * word_chars"),
    Rule(5, "upper_case", "100 * n_upper > 50 * word_chars"),
    Rule(6, "long_words", "word_chars > 25 * n_words AND n_words > 0"),
)
#: Versioned policies: a document is rejected where failure bits and mask share a bit.
POLICIES = {"base": 0b0000011, "v1": 0b1111111}


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words covered by windows of ``window`` (a power of two) words found twice or more in the array."""

    def doubled(hashes: Column, width: int) -> Column:
        if width == window:
            return F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (window - 1), F.lit(0)))
        pairs = lambda h: F.zip_with(h, F.slice(h, width + 1, F.greatest(F.size(h), F.lit(1))), lambda a, b: F.xxhash64(a, b))
        return let(hashes, lambda h: doubled(pairs(h), 2 * width))

    def covered(hashes: Column) -> Column:
        rows = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        twice = let(rows, lambda s: F.filter(s, lambda x, j: same(s, x, j - 1) | same(s, x, j + 1)))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        none = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
        add = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(window), i - a["last"])).alias("n"))
        return F.aggregate(starts, none, add, lambda a: a["n"])

    hashed = doubled(F.transform(words, lambda w: F.xxhash64(w)), 1)
    return let(hashed, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the columns of MEASURES, all long."""
    body = text_of(text)
    only = lambda keep: F.length(F.regexp_replace(body, keep, ""))
    lines = let(
        F.filter(F.split(body, "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]")),
        lambda s: F.struct(F.size(s).alias("n"), (F.size(s) - F.size(F.array_distinct(s))).alias("dup")),
    )
    words = let(words_of(body), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("again")))
    found = df.withColumns({"__words": words, "__lines": lines})
    values = {
        "n_words": F.col("__words.n"),
        "word_chars": only(SPACE),
        "n_symbols": only(r"[^#*$%&|<>]+"),
        "n_dup_lines": F.col("__lines.dup"),
        "n_repeat_words": F.col("__words.again"),
        "n_lines": F.col("__lines.n"),
        "n_upper": only("[^A-Z]+"),
        "n_bangs": F.length(body) - F.length(F.replace(body, F.lit("!"), F.lit(""))),
    }
    kept = [c for c in df.columns if c.lower() not in {m.lower() for m in MEASURES}]
    return found.select(*[F.col(f"`{c}`") for c in kept], *[v.cast("long").alias(k) for k, v in values.items()])


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with its measurements and ``fail_bits``: bit k is set where rule k fails."""
    bits = sum((F.when(F.expr(r.sql), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in RULES), F.lit(0))
    return measured(drop_clashes(df, ["fail_bits"]), text).withColumn("fail_bits", bits.cast("long"))


def rejected(policy: str = "v1") -> Column:
    """True where the policy rejects the ledger row."""
    return F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy])) != 0


def ablation(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of the policy: documents it fails, and those that only it rejects.

    One aggregation by failure bits (at most 2 ** len(RULES) groups, combined before the
    shuffle); the rest runs on those groups.
    """
    mask = POLICIES[policy]
    groups = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = [r for r in RULES if mask >> r.bit & 1]
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules]))
    count = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0)))
    hit = F.col("r.bit").bitwiseAND(F.col("bits")) != 0
    return (
        groups.withColumn("r", each)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(count(hit).alias("failed"), count(F.col("bits") == F.col("r.bit")).alias("only_this"))
    )


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The ledger of every document with the base rules and the verdict of policy v1."""
    rows = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("fail_bits").bitwiseAND(F.lit(POLICIES["base"])) != 0
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~rejected("v1")).alias("kept"), "fail_bits",
    )


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i+{WINDOW - 1}], ' ') AS s FROM w, unnest(range(1, greatest(len(ws) - {WINDOW - 2}, 1))) AS u(i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, sum(least({WINDOW}, i - prev)) AS n FROM (SELECT rid, i, lag(i, 1, -{WINDOW}) OVER (PARTITION BY rid ORDER BY i) AS prev FROM twice) GROUP BY rid),
ln AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
    length(regexp_replace(t, '[^A-Z]+', '', 'g'))::BIGINT AS n_upper,
    (length(t) - length(replace(t, '!', '')))::BIGINT AS n_bangs
  FROM d JOIN w USING (rid) JOIN ln USING (rid) LEFT JOIN rep USING (rid)),
b AS (SELECT *, ({" + ".join(f"CASE WHEN {r.sql} THEN {1 << r.bit} ELSE 0 END" for r in RULES)})::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (fail_bits & {POLICIES["base"]}) <> 0 AS base_failed, (fail_bits & {POLICIES["v1"]}) = 0 AS kept, fail_bits FROM b
"""
