"""The prefix trie, the rule ledger and the Merkle manifest against brute force, and their results for odd rows."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from meridian.llm import conversations, merkle, rules
from meridian.llm.queries import LLM
from meridian.operators.ranking import running_within

TURNS = "conv_id long, turn long, role string, text string"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
crc = lambda n: zlib.crc32(str(n).encode())


# --- prefix trie


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    full = {c: tuple(own.get(c - c % 100, [])[: crc(c) % 6] + v[crc(c) % 6 :]) for c, v in own.items()}
    members = defaultdict(list)
    for c, turns in sorted(full.items()):
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1]) if k else 0)
    parent = lambda k: members[k[:-1]][0] if k else None
    ends = lambda k, m: sha(",".join(str(c) for c in m if len(full[c]) == len(k)))
    return sorted((len(k), m[0], parent(k), len(m), kids[k], leaves[k], saved[k], ends(k, m)) for k, m in members.items())


def trie_rows(df):
    return sorted((r["depth"], r["conv_id"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in conversations.prefix_trie(df).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_against_brute_force(spark, seed):
    rng, rows = random.Random(seed), []
    for c in [*range(0, 40), *range(107, 130), *range(250, 260)]:
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "née", "", None])))
    rows += [(300, t, "user", str(t % 3)) for t in range(70)]  # one deep conversation
    rows += [(c, t, "user", "same") for c in range(400, 440) for t in range(3)]  # a crowd of equal ones
    rng.shuffle(rows)
    assert trie_rows(spark.createDataFrame(rows, TURNS)) == brute_trie(rows)


def test_trie_of_odd_rows(spark):
    rows = [(1, None, "user", "first"), (1, 0, None, None), (1, 5, "user", "x" * 50_000), (None, 0, "user", "lost"), (2, 0, "user", "first"), (201, 0, "user", "a")]
    assert zlib.crc32(b"201") % 6 > 1  # its own turn is not used, and it has no base: no turns
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("mine") for c in ("a", "depth", "n_convs", "p", "digest")})
    assert trie_rows(df) == brute_trie(rows)
    assert conversations.prefix_trie(df.limit(0)).count() == 0
    again = rows + [(2, 0, "user", "first")]  # a repeated row is a repeated turn
    assert trie_rows(spark.createDataFrame(again, TURNS)) == brute_trie(again)


def test_trie_takes_logarithmic_rounds(spark, monkeypatch):
    rounds, write = [], conversations.Scratch.write
    monkeypatch.setattr(conversations.Scratch, "write", lambda self, df: rounds.append(df.columns) or write(self, df))
    rows = [(300, t, "user", str(t)) for t in range(400)]
    out = conversations.prefix_trie(spark.createDataFrame(rows, TURNS))
    assert out.agg(F.max("depth")).head()[0] == 400
    assert sum(c == ["a", "b", "n_children", "n_leaves", "saved"] for c in rounds) == 9


def test_running_within(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aaaaaaab"), i, rng.randrange(100)) for i in range(500)] + [("c", 0, 7)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    got = running_within(df, "k", [F.col("i")], {"s": F.col("v")}, "r").collect()
    expected, sums, n = {}, Counter(), Counter()
    for k, i, v in sorted(rows):
        sums[k] += v
        n[k] += 1
        expected[k, i] = (sums[k], n[k])
    assert {(r["k"], r["i"]): (r["s"], r["r"]) for r in got} == expected
    assert running_within(df.limit(0), "k", [F.col("i")], {"s": F.col("v")}, "r").count() == 0


# --- rule ledger


def brute_measures(text):
    text = text or ""
    word = lambda s: re.findall(r"[^\x20\x09-\x0D]+", s)
    w = word(text)
    lines = [x for x in text.split("\n") if word(x)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeated = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return [
        len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), len(lines),
        sum(any(c.isalpha() for c in x) for x in w), sum(len(x) == 1 for x in w), max(map(len, w), default=0),
    ]


def test_measures_against_brute_force():
    rng = random.Random(5)
    cases = ["", None, "a", "a b c d e", "a b c d e a b c d e", "x\x1cy\x1dz \x1e", "\x0b\x0c\r", "a b c", "né né\n\nné né\n# *", "﻿　"]
    for _ in range(300):
        cases.append("".join(rng.choice(["a", "b", "c ", " ", "\n", "é", "#", "\x1f", "\t", " "]) for _ in range(rng.randrange(200))))
    for t in cases:
        assert rules.measure(t) == brute_measures(t), repr(t)


def test_long_texts_are_measured_in_line_with_their_length():
    start = time.time()
    assert rules.measure("a" * 10**6)[0] == 1
    assert rules.measure("w " * 10**6)[4] == 10**6
    assert rules.measure(" ".join(map(str, range(300_000))))[4] == 0
    assert time.time() - start < 8


def test_op12_rows(spark):
    docs = pd.read_parquet(f"{DATA}/documents.parquet")
    got = {r["doc_id"]: r for r in LLM.queries["op12_rule_ledger"](spark, DATA).collect()}
    for i, t in zip(docs.doc_id, docs.text):
        m = dict(zip(rules.MEASURES, brute_measures(t)))
        bits = sum(1 << r.bit for r in rules.RULES if eval(r.fails, {}, m))
        base = m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"]
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failures")) == (*[m[c] for c in rules.MEASURES[:5]], base, bits == 0, bits)
    assert len(got) == len(docs)


def test_rules_keep_clean_documents_and_find_bad_ones(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rates = LLM.queries["op12_rule_ledger"](spark, d).where("n_words >= 10").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    rates = dict(map(tuple, rates))
    assert rates[1] > 0.98 and rates[0] < 0.1


def test_ablations_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["x", "y", None]), rng.randrange(1 << len(rules.RULES)) & rng.randrange(1 << len(rules.RULES))) for _ in range(400)]
    df = spark.createDataFrame(rows, "source string, failures long")
    policies = [rules.Policy("p", 1, ("few_words", "symbols")), rules.Policy("p", 2, ("few_words", "symbols", "endless_word", "symbols"))]
    got = {(r["source"], r["version"], r["rule"]): tuple(r)[4:] for r in rules.ablations(df, policies, by=["source"]).collect()}
    expected = {}
    for s in ("x", "y", None):
        for p in policies:
            mask = p.mask()
            mine = [f & mask for x, f in rows if x == s]
            for n in set(p.rules):
                bit = next(1 << r.bit for r in rules.RULES if r.name == n)
                fail = [f for f in mine if f & bit]
                together = 0
                for f in fail:
                    together |= f
                expected[s, p.version, n] = (len(mine), sum(f == 0 for f in mine), len(fail), fail.count(bit), len(fail) - fail.count(bit), together)
    assert got == expected
    kept = rules.apply_policies(df, policies).collect()
    assert all(r["policies"] == sum(1 << i for i, p in enumerate(policies) if not r["failures"] & p.mask()) for r in kept)


def test_ledger_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "word " * 30_000), (3, "word " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("failures", "n_words", "x")})
    out = rules.ledger(df)
    got = out.collect()
    assert len(got) == 5 and {r["x"] for r in got} == {"mine"} and "text" not in out.columns
    assert {r["doc_id"]: (r["n_words"], r["failures"] & 3) for r in got} == {1: (0, 1), 2: (0, 1), None: (2, 1), 3: (30_000, 2)}
    assert rules.ledger(df.limit(0)).count() == 0 and rules.ablations(rules.ledger(df.limit(0)), rules.POLICIES).count() == 0


# --- Merkle manifest


def runs(nodes):
    return [nodes[i : i + 8] for i in range(0, len(nodes), 8)]


def brute_manifest(rows):
    """rows: (group, order, leaf, changed); by walking up one level after another."""
    text = lambda g: (g is not None, (g or "").encode())
    first = lambda k: (k is not None, k or 0)
    groups = defaultdict(list)
    for i, (g, k, d, _) in enumerate(rows):
        groups[g].append((first(k), d, i))
    siblings, at, tops = defaultdict(list), {}, []

    def climb(nodes):  # nodes: (digest, rows below)
        while len(nodes) > 1:
            up = []
            for run in runs(nodes):
                for j, (_, below) in enumerate(run):
                    for i in below:
                        siblings[i].append(("".join(x for x, _ in run[:j]), "".join(x for x, _ in run[j + 1 :])))
                up.append((sha("".join(x for x, _ in run)), [i for _, below in run for i in below]))
            nodes = up
        return nodes[0]

    for g in sorted(groups, key=text):
        top = climb([(d, [i]) for _, d, i in sorted(groups[g])])
        tops.append(top)
        at |= dict.fromkeys(top[1], top[0])
    root = climb(tops)[0]
    out = []
    for i, (g, k, d, changed) in enumerate(rows):
        folded = changed or d
        for a, b in siblings[i]:
            folded = sha(a + folded + b)
        out.append((g, k, d, at[i], root, sha("".join(a + b for a, b in siblings[i])), folded, folded == root))
    return out


def manifest_rows(seed, n, groups, one=0.3):
    rng, out = random.Random(seed), []
    for i in range(n):
        g = "big" if rng.random() < one else rng.choice(groups)
        out.append((g, i, sha(f"{seed} {i}"), sha(f"other {i}") if i % 3 == 0 else None))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("n, groups, top", [(1, ["a"], 4096), (60, ["a", None, "é", "Z"], 4096), (2100, ["a", None], 4096), (2100, ["a", None], 2), (1500, [str(i) for i in range(700)], 4), (1200, [f"g{i}" for i in range(40)], 3)])
def test_manifest_against_brute_force(spark, n, groups, top):
    rows = manifest_rows(n, n, groups)
    df = spark.createDataFrame(rows, "lang string, id long, leaf string, changed string")
    out = merkle.manifest(df, "lang", "id", "leaf", "changed", top=top)
    key = lambda r: r[1]
    got = out.withColumn("again", merkle.folded("leaf", "proof")).collect()
    assert sorted((tuple(r)[:8] for r in got), key=key) == sorted(brute_manifest(rows), key=key)
    assert all(r["again"] == r["root"] for r in got)
    assert {r["verified"] for r in got} == ({False} if n == 1 else {True, False})


@pytest.mark.parametrize("n", [1, 7, 8, 9, 64, 65, 700])
def test_paths_fold_to_the_root(n):
    tree = merkle.levels([sha(str(i)) for i in range(n)])
    for i in {0, n // 2, n - 1}:
        assert merkle.fold(tree[0][i], merkle.path(tree, i)) == tree[-1][0]


def test_manifest_of_odd_rows(spark):
    empty = spark.createDataFrame([], "lang string, id long, leaf string")
    assert merkle.manifest(empty, "lang", "id", "leaf").count() == 0
    docs = spark.createDataFrame([(None, None, "x" * 10**6), (1, "en", None), (1, "en", ""), (1, "en", ""), (2, "en", "né")], "doc_id long, lang string, text string")
    rows = docs.select("lang", "doc_id", merkle.leaf(["doc_id", "lang", "text"]).alias("leaf"), F.lit("mine").alias("root"))
    got = merkle.manifest(rows, "lang", "doc_id", "leaf").collect()
    assert len(got) == 5 and all(r["verified"] for r in got) and len({r["root"] for r in got}) == 1
    leaves = sorted(r["leaf"] for r in got)
    assert leaves == sorted(map(sha, ["--1000000:" + "x" * 10**6, "1:12:en-", "1:12:en0:", "1:12:en0:", "1:22:en3:né"]))
    key = lambda r: (r[1] is None, r[1] or 0, r[2], r[5])
    expected = brute_manifest([(r["lang"], r["doc_id"], r["leaf"], None) for r in got])
    assert sorted((tuple(r)[:8] for r in got), key=key) == sorted(expected, key=key)


def test_op13_rows(spark):
    docs = pd.read_parquet(f"{DATA}/documents.parquet")
    part = lambda v: "-" if v is None or v != v else f"{len(str(v).encode())}:{v}"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = []
    for i, s, lang, n, t in docs[["doc_id", "source", "lang", "n_chars", "text"]].itertuples(index=False, name=None):
        head = part(i) + part(s) + part(lang) + part(n)
        rows.append((lang, i, sha(head + part(t)), sha(head + part(t and t.translate(lower))) if crc(i) % 3 == 0 else None))
    got = LLM.queries["op13_merkle"](spark, DATA).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, got)) == sorted(r[1:] for r in brute_manifest(rows))
