"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger keeps what was measured and one
whole number whose bit i says that rule i failed. What to keep is decided afterwards: a
policy is a named, versioned mask of rules, and a document is kept if no masked bit is
set. So another policy, or another version of one, reads the ledger and no text.

Ablations come from the same bits. Rows are first counted by their bits; a policy loses to
rule i alone those rows whose masked bits are exactly bit i. What is counted
is as many rows as there are patterns of failure, however many documents there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from meridian.llm.text import append_columns

#: Words of a window that is looked for again in the same text.
WINDOW = 5

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words", "n_short_words", "longest_word"]

_SPACE = " \t\n\v\f\r"
_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A rule fails where `fails`, a condition on the measures, holds; `bit` never changes its meaning."""

    bit: int
    name: str
    fails: str


RULES = [
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule(4, "short_mean_word", "word_chars < 2 * n_words"),
    Rule(5, "long_mean_word", "word_chars > 14 * n_words"),
    Rule(6, "few_letter_words", "10 * n_letter_words < 6 * n_words"),
    Rule(7, "single_characters", "2 * n_short_words > n_words"),
    Rule(8, "endless_word", "longest_word > 1000"),
]


@dataclass(frozen=True)
class Policy:
    """The rules that remove a document, by name, in one version of a policy."""

    name: str
    version: int
    rules: tuple[str, ...]

    def mask(self, rules: list[Rule] = RULES) -> int:
        bits = {r.name: r.bit for r in rules}
        return sum(1 << bits[n] for n in set(self.rules))


POLICIES = [
    Policy("base", 1, ("few_words", "repeated_words")),
    Policy("web", 1, ("few_words", "repeated_words", "symbols", "repeated_lines", "few_letter_words")),
    Policy("web", 2, tuple(r.name for r in RULES)),
]


def measure(text: str | None) -> list[int]:
    """The measures of a whole text, in the order of MEASURES; a null text has none of anything.

    Words are runs of characters other than ASCII white space. Windows are compared as runs of word numbers, not of
    hashes, in time n log n.
    """
    text = text or ""
    lines = text.split("\n")
    parts = [_words(line) for line in lines]
    words = [w for p in parts for w in p]
    with_words = [line for line, p in zip(lines, parts) if p]
    lengths = list(map(len, words))
    return [
        len(words), sum(lengths), sum(map(text.count, _SYMBOLS)), len(with_words) - len(set(with_words)), _repeated(words), len(with_words),
        sum(any(map(str.isalpha, w)) for w in words), sum(n == 1 for n in lengths), max(lengths, default=0),
    ]


def _words(line: str) -> list[str]:
    if line.isascii() and not any(c in line for c in "\x1c\x1d\x1e\x1f"):
        return line.split()
    for c in _SPACE[1:]:
        line = line.replace(c, " ")
    return [w for w in line.split(" ") if w]


def _repeated(words: list[str], size: int = WINDOW) -> int:
    """Words in windows of `size` words that occur twice or more."""
    if len(words) <= size:
        return 0
    number: dict[str, int] = {}
    one = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    run = one
    for i in range(1, size):
        n = len(words) - i
        run = np.unique(run[:n] * len(number) + one[i:], return_inverse=True)[1]
    again = np.bincount(run)[run] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    edges[: len(run)] += again
    edges[size:] -= again
    return int((np.cumsum(edges[:-1]) > 0).sum())


def ledger(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """`docs` less its text, with the measures and failures (long), whose bit i is set if rule i fails.

    A null text is measured like an empty one, which fails few_words. Repeated rows get equal rows.
    Columns named like a measure or `failures` are replaced, others pass through. An empty table gives an empty one.
    """
    added = ", ".join(f"{m} long" for m in MEASURES)
    measured = append_columns(docs.drop("failures").withColumnRenamed("text", "__text"), ["__text"], lambda texts: dict(zip(MEASURES, zip(*map(measure, texts)))) if texts else dict.fromkeys(MEASURES, []), added)
    return measured.withColumn("failures", failures(rules))


def failures(rules: list[Rule] = RULES) -> Column:
    """The failure bits of measured rows."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(0) for r in rules]
    out = F.lit(0)
    for b in bits:
        out = out.bitwiseOR(b)
    return out.cast("long")


def kept(policy: Policy, rules: list[Rule] = RULES) -> Column:
    """Whether the policy keeps a row of the ledger."""
    return F.col("failures").bitwiseAND(policy.mask(rules)) == 0


def apply_policies(rows: DataFrame, policies: list[Policy], rules: list[Rule] = RULES) -> DataFrame:
    """The ledger with policies (long): bit i is set if policies[i] keeps the row."""
    bits = F.lit(0).cast("long")
    for i, p in enumerate(policies):
        bits = bits.bitwiseOR(F.when(kept(p, rules), F.lit(1 << i)).otherwise(0))
    return rows.withColumn("policies", bits)


def ablations(rows: DataFrame, policies: list[Policy], rules: list[Rule] = RULES, by: list[str] | None = None) -> DataFrame:
    """What each rule does in each policy, for each group of `by`.

    Returns by, policy, version, rule, n_docs, n_kept, n_failed (fail the rule), n_alone (only this rule of the
    policy removes them, so they come back without it), n_shared (it and another do), and together, the bits of all rules of the policy
    that fail in some row with this one. Rules outside a policy have no row. Null group values are a group.
    """
    by = by or []
    patterns = rows.groupBy(*by, "failures").agg(F.count("*").alias("n"))
    bits = {r.name: 1 << r.bit for r in rules}
    cases = [F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(n).alias("rule"), F.lit(bits[n]).cast("long").alias("bit"), F.lit(p.mask(rules)).cast("long").alias("mask")) for p in policies for n in dict.fromkeys(p.rules)]
    each = patterns.select(*by, "failures", "n", F.inline(F.array(*cases))).withColumn("masked", F.col("failures").bitwiseAND(F.col("mask")))
    fails = F.col("masked").bitwiseAND(F.col("bit")) != 0
    alone = F.col("masked") == F.col("bit")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return each.groupBy(*by, "policy", "version", "rule").agg(
        F.sum("n").alias("n_docs"), count(F.col("masked") == 0).alias("n_kept"), count(fails).alias("n_failed"), count(alone).alias("n_alone"),
        count(fails & ~alone).alias("n_shared"), F.coalesce(F.bit_or(F.when(fails, F.col("masked"))), F.lit(0)).alias("together"),
    )


SQL = r"""
WITH cut AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
line AS (SELECT doc_id, unnest(l) AS line FROM cut),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS again FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM (SELECT doc_id, i, w[i:i + 4] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM cut))),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM win, (VALUES (0), (1), (2), (3), (4)) AS t(o) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT c.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(lines.again, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(lines.n, 0) AS n_lines,
             len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS n_letter_words, len(list_filter(w, lambda x: length(x) = 1)) AS n_short_words,
             coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS longest_word
      FROM cut c LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (10 * n_dup_lines > 3 * n_lines)::BIGINT
             + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 14 * n_words)::BIGINT + 64 * (10 * n_letter_words < 6 * n_words)::BIGINT
             + 128 * (2 * n_short_words > n_words)::BIGINT + 256 * (longest_word > 1000)::BIGINT AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures,
       (failures & 3 = 0)::BIGINT + 2 * (failures & 79 = 0)::BIGINT + 4 * (failures = 0)::BIGINT AS policies
FROM f
"""
