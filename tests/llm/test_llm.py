"""The training-data operators against brute force, and their defined results for odd rows."""

import hashlib
import io
import random
import struct
import time
import wave
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh64_intdigest

import corpus_pipeline
from conftest import DATA, same_as_sql
from meridian.llm import embeddings, langid, lines, media, near, packing, pieces, quality, simhash, substring, warc
from meridian.llm.queries import LLM
from meridian.llm.text import local_components, window_minima

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

ODD = [
    (1, "one two three\nfour five six\nseven\neight", "en", "s", 1),
    (2, None, None, None, None),
    (3, "", "en", "s", 0),
    (4, "one two three\nfour five six\nseven\nother", "en", "s", 1),
    (5, "word " * 30_000, "en", "s", 150_000),
    (6, "\n\n\n\n", "en", "s", 4),
    (7, "é ü 日本 \U0001f389 \x00", "fr", "s", 7),
    (8, "one two three\nfour five six\nseven\neight", "en", "s", 1),
    (8, "one two three\nfour five six\nseven\neight", "en", "s", 1),
    (None, "one two three\nfour five six\nseven\neight", "en", "s", 1),
]
CLASHING = "removed n_words n_removed kept n_lines score rejected lang_pred media type ids fp key unit n".split()


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, DOCS)
    return df.withColumns({c: F.lit("mine") for c in CLASHING})


def texts(seed, n=60, vocabulary=12, longest=60):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghijklmnop"[:vocabulary]) * rng.randint(1, 3) for _ in range(rng.randint(0, longest))] for _ in range(n)]
    for _ in range(n // 2):
        a, b = rng.randrange(n), rng.randrange(n)
        at = rng.randint(0, len(base[b]))
        base[b][at:at] = base[a][: rng.randint(0, 45)]
    return [(i, " ".join(w)) for i, w in enumerate(base)]


# --- line dedup


def brute_lines(rows, k=3, words=8):
    seen, out = set(), {}
    for i, t in sorted((r[0], r[1]) for r in rows if r[0] is not None and r[1] is not None):
        part = t.split("\n")
        gone = set()
        windows = [("some", s, k) for s in range(len(part) - k + 1)] + [("one", s, 1) for s, x in enumerate(part) if len(x.split()) >= words]
        if len(part) < k and t.strip():
            windows.append(("all", 0, len(part)))
        for kind, s, n in windows:
            key = (kind, *part[s : s + n])
            if key in seen:
                gone |= set(range(s, s + n))
            seen.add(key)
        out[i] = "\n".join(x for j, x in enumerate(part) if j not in gone)
    return out


def test_lines_against_brute_force(spark):
    rng = random.Random(4)
    long = [" ".join(rng.choice("abc") for _ in range(7 + n)) for n in (0, 1, 1, 2)]
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", *long]) for _ in range(rng.randint(0, 12)))) for i in range(80)]
    rows += [(80 + i, t) for i, t in enumerate(["x", "x", "x\ny", "y", "x\ny", " ", " ", *long, *long])]
    got = {r["doc_id"]: r["text"] for r in lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows)


def test_lines_of_one_id_with_other_texts(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "p\nq\nr\ns"), (2, "a\nb\nc\ne"), (2, "p\nq\nr\ns")]
    got = lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"], r["n_removed"]) for r in got) == [(1, "a\nb\nc\nd", 0), (2, "e", 3), (2, "p\nq\nr\ns", 0), (2, "p\nq\nr\ns", 0)]


def test_lines_of_odd_rows(spark, odd):
    out = lines.line_dedup(odd)
    got = {r["doc_id"]: r for r in out.collect() if r["doc_id"] not in (8, None)}
    assert got[4]["text"] == "other" and got[4]["n_removed"] == 3
    assert got[2]["text"] is None and got[2]["n_lines"] == 0
    assert got[3]["text"] == "" and got[3]["n_lines"] == 1
    assert got[6]["text"] == "" and got[6]["n_lines"] == 5
    assert [r["text"] for r in out.where("doc_id = 8").collect()] == ["", ""]
    assert out.where("doc_id is null").first()["text"].startswith("one")
    assert lines.line_dedup(odd.limit(0)).count() == 0


def test_line_dedup_stays_native(spark, odd):
    plan = lines.line_dedup(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_window_minima():
    rng = np.random.default_rng(0)
    for w in (1, 2, 3, 7, 16):
        g = rng.integers(0, 5, 40).astype(np.uint64)
        assert window_minima(g, w).tolist() == [max(j for j in range(i, i + w) if g[j] == g[i : i + w].min()) for i in range(40 - w + 1)]
        assert len(window_minima(g[: w - 1], w)) == 0


# --- media

PNG = bytes.fromhex("89504e470d0a1a0a0000000d49484452000000010000000108060000001f15c4890000000a49444154789c63000100000500010d0a2db40000000049454e44ae426082")
GIF = b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"


def bmp(w, h):
    row = (w * 24 + 31) // 32 * 4
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + row * h, 0, 54, 40, w, h, 1, 24, 0, row * h, 0, 0, 0, 0) + bytes(row * h)


JPEG = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x04ab\xff\xda\0\x04ab\x12\xff\0\x34\xff\xd9"


def ogg_page(flags, body):
    page = b"OggS\0" + bytes([flags]) + bytes(20) + bytes([len(body)]) + body
    page = page[:26] + bytes([1, len(body)]) + body
    crc = 0
    for x in page:  # bit by bit, most significant first
        crc ^= x << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
    return page[:22] + struct.pack("<I", crc) + page[26:]


OGG = ogg_page(2, b"abc") + ogg_page(4, b"")
PDF = b"%PDF-1.4 x startxref 0 %%EOF"


@pytest.mark.parametrize(("data", "kind"), [(PNG, "image/png"), (GIF, "image/gif"), (bmp(3, 2), "image/bmp"), (JPEG, "image/jpeg"), (OGG, "audio/ogg"), (PDF, "application/pdf"), (media.store(b"abc"), "audio/wav")])
def test_formats(data, kind):
    assert media.sniff(data) == [(0, len(data), kind)]
    assert media.sniff(b"text BM RIFF " + data + b" GIF87a \xff\xd8\xff") == [(13, len(data), kind)]
    for cut in range(1, len(data)):
        assert (0, len(data), kind) not in media.sniff(data[:cut])


def test_files_as_they_are_found():
    page = b"%PDF-1.7\n1 0 obj\n<< >>\nendobj\nxref\n0 1\ntrailer\n<< >>\nstartxref\n9\n%%EOF\n"
    updated = page + b"2 0 obj\n<< >>\nendobj\nxref\nstartxref\n99\n%%EOF\r\n"
    for data in (page, updated):
        assert media.sniff(data) == [(0, len(data), "application/pdf")]
        assert media.sniff(data + page) == [(0, len(data), "application/pdf"), (len(data), len(page), "application/pdf")]
    filled = JPEG.replace(b"\xff\xc0", b"\xff\xff\xff\xc0").replace(b"\xff\xd9", b"\xff\xff\xd9")
    assert media.sniff(filled) == [(0, len(filled), "image/jpeg")]
    assert media.sniff(JPEG[:-2] + JPEG) == [(len(JPEG) - 2, len(JPEG), "image/jpeg")]
    assert media.sniff(OGG[:30] + b"\x01" + OGG[31:]) == []
    start = time.process_time()
    for mark in (b"%PDF-1.4 ", b"%PDF-1.4 startxref ", JPEG[:-2], b"GIF89a", b"OggS\0\x02"):
        assert media.sniff(mark * (500_000 // len(mark))) == []
    assert time.process_time() - start < 10


def test_features_tell_texts_apart(spark):
    out = media.stored_digests(spark.read.parquet(f"{DATA}/documents.parquet").select("text"))
    assert out.select("feature").distinct().count() >= 0.99 * out.select("payload_sha256").distinct().count()
    assert out.groupBy("text").agg(F.countDistinct("feature").alias("n")).where("n > 1").count() == 0
    x = np.frombuffer(b"ab" * 32, np.uint8)
    assert media.heard(b"ab" * 32)[:3] == ["64", str(int(x.mean() * 1000)), "63"]


def test_sniffing_corrects_and_carves(spark):
    rows = [(1, bytearray(PNG), "image/gif"), (2, bytearray(b"xx" + GIF + PNG), "image/png"), (3, None, "a/b"), (4, bytearray(), None)]
    df = spark.createDataFrame(rows, "id int, media binary, declared string").withColumn("carved", F.lit(1))
    got = {r["id"]: r for r in media.sniff_media(df, declared="declared").collect()}
    assert (got[1]["type"], got[1]["corrected"], got[1]["carved"]) == ("image/png", True, [])
    assert [tuple(c) for c in got[2]["carved"]] == [(2, len(GIF), "image/gif"), (2 + len(GIF), len(PNG), "image/png")]
    assert got[3]["type"] == got[4]["type"] == "application/octet-stream"
    assert (got[3]["corrected"], got[4]["corrected"]) == (True, False)


def test_stored_texts_come_back(spark, odd):
    out = media.stored_digests(odd).collect()
    assert len(out) == len(ODD)
    for r in out:
        b = (r["text"] or "").encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        s = media.store(p)
        assert (r["media_bytes"], r["media_sha256"]) == (len(s), hashlib.sha256(s).hexdigest())
        assert r["feature"].startswith("audio/wav|corrected")
    assert media.stored_digests(odd.limit(0)).count() == 0
    stored = media.store_texts(odd.select("doc_id", "text")).collect()
    assert all(media.samples(bytes(r["media"]))[: r["n_bytes"]] == (r["text"] or "").encode() for r in stored)


# --- packing


def check_packing(rows, docs, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    want = Counter()
    for text in docs:
        want[tuple([*t.encode(text or "", add_special_tokens=False).ids, 1])] += 1
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        by_doc.setdefault(r["doc_id"], []).append(r)
        assert len(r["ids"]) == r["length"]
    for pieces_ in by_sequence.values():
        at = 0
        for r in sorted(pieces_, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return want, by_doc, by_sequence


def test_packing_holds_every_id_once(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["Hello,", "world.", "a", "the", "Ünïcode!", "x1 2y", "<|endoftext|>", "<|ENDOFTEXT|>", "it's", "..."]) for _ in range(rng.randint(0, 120)))) for i in range(150)]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), WORDS, capacity=64).collect()
    want, by_doc, by_sequence = check_packing(rows, [t for _, t in docs], 64)
    got = Counter(tuple(x for r in sorted(v, key=lambda r: r["start"]) for x in r["ids"]) for v in by_doc.values())
    assert got == want
    assert all(r["doc_tokens"] == sum(p["length"] for p in by_doc[r["doc_id"]]) for r in rows)
    assert sum(r["length"] for r in rows) / (64 * len(by_sequence)) > 0.95


def test_packing_odd_rows(spark, odd):
    rows = packing.pack(odd, WORDS).collect()
    want, by_doc, _ = check_packing(rows, [t for _, t, *_ in ODD], 2048)
    assert [tuple(r["ids"]) for r in by_doc[2]] == [(1,)] == [tuple(r["ids"]) for r in by_doc[3]]
    assert Counter(r["doc_id"] for r in rows)[None] == 1 and sum(r["length"] for r in rows) == sum(len(k) * n for k, n in want.items())
    digests = packing.pack(odd, WORDS, digest=True).collect()
    same = lambda rs, f: sorted((str(r["doc_id"]), r["start"], f(r)) for r in rs)
    assert same(digests, lambda r: r["ids_crc32"]) == same(rows, lambda r: zlib.crc32(np.array(r["ids"], "<u4").tobytes()))
    assert packing.pack(odd.limit(0), WORDS).count() == 0


def test_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    rng = random.Random(9)
    odd = ["<|", "<|endoftext|>", "<|EndOfText|>", "\x1c", "\x1f", "\x85", "\u2028", "\u00a0", " ", "\n", "a", "B.", "İ", "e\u0301", "'s", "9", "!?", "日本", "can't"]
    samples = ["a<|b\x1cc"] + ["".join(rng.choice(odd) for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    for path in (WORDS, public_tokenizers.path("byte_bpe_50k.json")):
        lib, enc = Tokenizer.from_file(path), packing.WordEncoder(path)
        assert enc.by_word == (path == WORDS)
        for t, ids in zip(samples, enc.encode(samples)):
            assert np.frombuffer(ids, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_fill_is_the_best_subset():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randint(1, 12): rng.randint(1, 3) for _ in range(rng.randint(0, 4))}
        room = rng.randint(1, 40)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1)}
        got = packing.fill(counts, room)
        assert sum(k * n for k, n in got) == max(s for s in sums if s <= room)
        assert all(n <= counts[k] for k, n in got)


# --- SimHash


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps, radius=4):
    ids = sorted(fps)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if label[b] != label[a] and bin(fps[a] ^ fps[b]).count("1") <= radius:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_simhash_against_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for i in range(60):
        if i % 3 and rows:
            w = rng.choice(rows)[1].split()
            if w and rng.random() < 0.7:
                w[rng.randrange(len(w))] = "changed"
            rows.append((i, " ".join(w)))
        else:
            rows.append((i, " ".join(rng.choice(["Ab", "c", "dé", "E"]) + str(rng.randint(0, 99)) for _ in range(rng.randint(0, 300)))))
    got = simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    fps = {i: brute_fingerprint(t) for i, t in rows}
    assert {r["doc_id"]: r["fp"] & (2**64 - 1) for r in got} == fps
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(fps)


@pytest.mark.parametrize(("chunk", "blocks"), [(3, 5), (2048, None), (2048, 6), (8, 7)])
def test_links_of_crowded_shards(spark, chunk, blocks):
    rng = random.Random(3)
    fps = {}
    for i in range(150):
        f = 0x0123456789ABCDEF if i % 3 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 9)):
            f ^= 1 << rng.randrange(64)
        if f not in fps.values():
            fps[i] = f
    df = spark.createDataFrame([(i, f - (f >> 63 << 64)) for i, f in fps.items()], "node long, fp long")
    edges = simhash.fingerprint_links(df, chunk=chunk, blocks=blocks).collect()
    ids = sorted(fps)
    place = {n: k for k, n in enumerate(ids)}
    label = local_components(len(ids), np.array([place[r["src"]] for r in edges]), np.array([place[r["dst"]] for r in edges]))
    assert {n: ids[label[place[n]]] for n in ids} == brute_components(fps)


def test_shards_stay_small_as_fingerprints_grow():
    assert [simhash.blocks_for(n, 4, 2048) for n in (0, 10**6, 10**8, 10**12)] == [5, 5, 6, 7]
    for n in (10**6, 10**8, 10**10):
        blocks = simhash.blocks_for(n, 4, 2048)
        assert n / 2 ** (64 * (blocks - 4) // blocks) <= 512


def test_bk_search_equals_a_scan():
    rng = np.random.default_rng(5)
    shard = np.sort(rng.integers(0, 5, 400))
    fps = rng.integers(0, 2**12, 400).astype(np.uint64) << np.uint64(20)
    forest = simhash.BKForest(shard, fps)
    first = {s: int(np.argmax(shard == s)) for s in set(shard.tolist())}
    q, item = forest.search(fps, np.array([first[s] for s in shard]), 3)
    expected = {(i, j) for i in range(400) for j in range(400) if shard[i] == shard[j] and bin(int(fps[i] ^ fps[j])).count("1") <= 3}
    assert set(zip(q.tolist(), item.tolist())) == expected and len(q) == len(expected)


def test_simhash_odd_rows(spark, odd):
    got = simhash.simhash_components(odd).collect()
    zero = [r for r in got if r["doc_id"] in (2, 3, 6)]
    assert {r["fp"] for r in zero} == {0} and {r["component_id"] for r in zero} == {2}
    assert len(got) == len(ODD) and [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert simhash.simhash_components(odd.limit(0)).count() == 0
    kept = simhash.near_dedup(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} >= {1, 2, None}
    assert kept.where("doc_id in (3, 6, 8)").count() == 0


# --- near duplicates by shared shingles


def brute_near(rows, k=5):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().encode().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))}
    label = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and label[a] != label[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {i: new if x == old else x for i, x in label.items()}
    return label


def near_rows():
    """Copies around the bar of 0.8, a crowd of near copies, and unlike texts that share most of what they say."""
    rng = random.Random(11)
    word = lambda: "w" + str(rng.randrange(10**6))
    rows = []
    for n in (12, 40, 150, 300):
        base = [word() for _ in range(n)]
        for changes in (0, 0, 1, 2, 3, 4, 6, 8):
            w = list(base)
            for _ in range(changes * n // 150 + bool(changes)):
                w[rng.randrange(n)] = word()
            rows.append(" ".join(w))
    crowd = [word() for _ in range(200)]
    for i in range(40):
        w = list(crowd)
        w[rng.randrange(200)] = word()
        rows.append(" ".join(w))
    half = [word() for _ in range(60)]
    rows += [" ".join(half + [word() for _ in range(20 + i % 3)]) for i in range(40)]
    rows += ["", None, "Ab c", "ab C", "ab c d"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_near_against_brute_force(spark):
    rows = near_rows()
    got = near.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_near(rows)


def test_chunks_of_a_shard_meet_each_other(spark, monkeypatch):
    monkeypatch.setattr(near, "CHUNK", 5)
    rows = near_rows()
    got = near.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_near(rows)


def test_pages_of_one_template_are_dealt_to_many_units(spark):
    rows = [(1, i, i, bytes(64), 10, i, 3000) for i in range(3000)]
    units = near._units(spark.createDataFrame(rows, "g long, id long, fp long, odd binary, n long, part long, m long"), 5000)
    sizes = [r["count"] for r in units.groupBy("unit").count().collect()]
    assert len(sizes) == 21 and max(sizes) < 3 * near.CHUNK
    assert units.where("in_tree").groupBy("unit").count().agg(F.max("count")).head()[0] < 2 * near.CHUNK


def test_near_stage_takes_all_copies_and_no_others(spark):
    rows = near_rows()
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), DATA).collect()
    assert {r["doc_id"] for r in kept} == set(brute_near(rows).values())


def test_near_odd_rows(spark, odd):
    kept = near.near_dedup(odd)
    assert kept.columns == odd.columns
    got = kept.collect()
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == [1, 2, 4, 5, 7]
    assert sum(r["doc_id"] is None for r in got) == 1
    assert near.near_components(odd.limit(0)).count() == 0


# --- merge-dropout


def brute_pieces(c, word, skipped):
    """The parts of a word: the best pair comes up again and again, a skipped pair never again while it is the same."""
    parts, off, came = [(i, x) for i, x in enumerate(word)], set(), 0
    while True:
        pairs = [(-c.score[a + b], i, k) for k, ((i, a), (_, b)) in enumerate(zip(parts, parts[1:])) if a + b in c.score and (i, a, b) not in off]
        if not pairs:
            return [x for _, x in parts]
        _, i, k = min(pairs)
        came += 1
        if skipped(came - 1):
            off.add((i, parts[k][1], parts[k + 1][1]))
        else:
            parts[k : k + 2] = [(i, parts[k][1] + parts[k + 1][1])]


def brute_encode(c, text, seed, dropout, doc):
    out = []
    start = xxh3_64_intdigest(f"{seed}\0{doc}".encode())
    for k, w in enumerate(c.words.findall((" " + text).replace(pieces.SPACE, pieces.MARK).replace(" ", pieces.SPACE)) if text else []):
        place = pieces.mix(np.array([((k + 1) * 0x9E3779B97F4A7C15 + start) % 2**64], np.uint64))
        for p in brute_pieces(c, w, lambda n: pieces._skipped(place, n, dropout)[0]):
            known = c.ids.get(p)
            spelled = (pieces.SPACE if p == pieces.MARK else p).encode()
            out += [c.byte_ids[x] for x in spelled] if known is None else [known]
    return out


def test_pieces_equal_the_library_and_decode():
    import sentencepiece

    c, lib = pieces.PieceCodec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    samples = ["", " ", "  a  b ", "Hello, world.", "\n\nx\ty.\r\n", "日本語 \U0001f389 é", "a" * 200, "<s> </s> <0x41>", *[t for _, t in texts(1, 20)]]
    samples += pd.read_parquet(f"{DATA}/documents.parquet").text.tolist()[:50]
    for t, ids in zip(samples, c.encode_all(samples)):
        assert ids.tolist() == lib.encode(t)
        for seed in (1, -2):
            assert c.decode(c.encode(t, seed, 0.3, "7")) == t
    for t in ("▁", "a▁b ▁▁ c▁", " ▁"):
        assert all(c.decode(c.encode(t, 1, p)) == t for p in (0, 0.5))
    long = " ".join(samples)
    assert len({tuple(c.encode(long, s, 0.3, "7").tolist()) for s in range(4)}) == 4


@pytest.mark.parametrize("dropout", [0, 0.1, 0.5, 1])
def test_agendas_against_brute_force(monkeypatch, dropout):
    c = pieces.PieceCodec(PIECES)
    samples = ["", "internationalization of misunderstandings, a▁b", "aaaa aaaaa", "日本語\n\né ", "x" * 40 + " y"]
    samples += [t[:600] for t in pd.read_parquet(f"{DATA}/documents.parquet").text.tolist()[:25]]
    docs = list(map(str, range(len(samples))))
    expected = [brute_encode(c, t, 5, dropout, d) for t, d in zip(samples, docs)]
    assert [x.tolist() for x in c.encode_all(samples, 5, dropout, docs)] == expected
    for limits in ({"LONG": 3}, {"BLOCK": 7}, {"BATCH": 50}, {"CACHE": 10}):
        with monkeypatch.context() as m:
            for k, v in limits.items():
                m.setattr(pieces, k, v)
            assert [x.tolist() for x in c.encode_all(samples, 5, dropout, docs)] == expected, limits


def test_frequent_words_get_many_segmentations():
    c, rng, n = pieces.PieceCodec(PIECES), np.random.default_rng(1), 3000
    for word in ("government", "misunderstanding"):
        whole, own = pieces.SPACE + word, Counter()
        for _ in range(n):
            toss = rng.random(200) < 0.1
            own["|".join(brute_pieces(c, whole, lambda k: toss[k]))] += 1
        plain = "|".join(brute_pieces(c, whole, lambda k: False))
        for k in (0, 3):  # whichever place the word has
            text, forms = " ".join(["and"] * k + [word, "or"]), Counter()
            for ids in c.encode_all([text] * n, 1, 0.1, list(map(str, range(n)))):
                spelled, ends = [c.pieces[i] for i in ids], np.cumsum([len(c.pieces[i]) for i in ids])
                forms["|".join(x for x, e in zip(spelled, ends) if 4 * k < e <= 4 * k + len(whole))] += 1
            assert {x.replace("|", "") for x in forms} == {whole}
            assert len(forms) > 0.7 * len(own) > 5 and abs(forms[plain] - own[plain]) < 0.05 * n


def test_pieces_of_odd_rows(spark, odd):
    out = pieces.decode_ids(pieces.encode_texts(odd.drop("ids"), PIECES, seed=3, dropout=0.2), PIECES).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in out)
    assert pieces.decode_ids(pieces.encode_texts(odd.limit(0), PIECES), PIECES).count() == 0
    assert pieces.encode_texts(odd.limit(0), PIECES).count() == 0
    got = pieces.segment_digests(odd, PIECES, 3, 0.2).collect()
    key = lambda r: (str(r["doc_id"]), str(r["text"]))
    assert {key(r): r["ids_crc32"] for r in got} == {key(r): zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in out}


# --- WARC


RECORD = "record_id long, url string, time long, kind string, etag string, last_modified string, headers map<string,string>"


def test_canonical_urls(spark):
    same = ["http://WWW.Example.com:80/a/?b=2&a=1&utm_source=x#top", "https://m.example.com/a?a=1&b=2", "https://u:p@example.com/a/?a=1&b=2"]
    df = spark.createDataFrame([(u,) for u in [*same, "http://example.com", "http://example.com/A"]], "u string").select(warc.canonical_url(F.col("u")))
    assert [r[0] for r in df.collect()] == ["example.com/a?a=1&b=2"] * 3 + ["example.com", "example.com/A"]
    assert spark.range(1).select(warc.canonical_url(F.lit("http://m.H/a/"), ""), warc.canonical_url(F.lit(None).cast("string"))).first()[:] == ("m.h/a", None)


def test_revisit_headers_and_clashing_names(spark):
    rows = [
        (1, "http://h/a", 1, "response", "e", None, {"Date": "1", "date": "2", "DATE": "3", "Content-Type": "t"}),
        (2, "http://h/a", 2, "revisit", "e", None, {"X": "a", "x": "b", "content-type": "u"}),
        (3, "http://m.h/a", 3, "response", "other", None, None),
        (4, "http://h/a", 4, "revisit", "e", None, None),
        (5, "http://h/b", 5, "revisit", "e", None, {}),
    ]
    names = "carried status refers_to canonical_url headers_merged slice last found __x page".split()
    df = spark.createDataFrame(rows, RECORD).withColumns({c: F.lit("mine") for c in names})
    out = warc.resolve_revisits(df)
    assert sorted(out.columns) == sorted(df.columns)
    got = {r["record_id"]: r for r in out.collect()}
    assert (got[2]["status"], got[2]["headers_merged"]) == ("resolved", {"date": "2", "content-type": "t", "x": "b"})
    assert (got[4]["status"], got[5]["status"]) == ("mismatch", "missing") and {r["carried"] for r in got.values()} == {"mine"}
    apart = {r["record_id"]: r["status"] for r in warc.resolve_revisits(df, prefix="").collect()}
    assert apart == {2: "resolved", 4: "resolved", 5: "missing"}


def test_page_records_give_every_status(spark):
    out = warc.resolve_revisits(warc.page_records(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")))
    assert {r["status"] for r in out.select("status").distinct().collect()} == {"resolved", "mismatch", "missing", "unchecked"}


@pytest.mark.parametrize("ranges", [1, 7, None])
def test_revisits_against_brute_force(spark, ranges):
    rng = random.Random(11)
    rows = []
    for i in range(300):
        kind = rng.choice(["response", "revisit", "revisit", "metadata"])
        etag = rng.choice(["a", "b", None])
        rows.append((i, f"http://h/{rng.choice('xyz')}", rng.choice([None, *range(40)]), kind, etag, rng.choice(["m", "n", None]), {"Content-Type": f"t{i}", "Date": f"d{i}"}))
    rows.append((900, None, 5, "revisit", "a", None, None))
    df = spark.createDataFrame(rows, RECORD).withColumn("low", F.lit(1))
    got = {r["record_id"]: r for r in warc.resolve_revisits(df, ranges).collect()}
    key = lambda r: (-(2**62) if r[2] is None else r[2], r[0])
    for r in rows:
        if r[3] != "revisit":
            continue
        before = [x for x in rows if x[3] == "response" and x[1] == r[1] and r[1] and key(x) < key(r)]
        if not before:
            assert (got[r[0]]["status"], got[r[0]]["refers_to"]) == ("missing", None)
            continue
        last = max(before, key=key)
        ok = r[4] == last[4] if r[4] else r[5] == last[5] if r[5] else None
        assert (got[r[0]]["status"], got[r[0]]["refers_to"]) == ({True: "resolved", False: "mismatch", None: "unchecked"}[ok], last[0])
        assert got[r[0]]["headers_merged"] == ({"content-type": f"t{last[0]}", "date": f"d{r[0]}"} if ok else None)
    assert len(got) == sum(r[3] == "revisit" for r in rows)
    assert warc.resolve_revisits(df.limit(0), ranges).count() == 0


# --- substring dedup


def brute_substrings(rows, k=20):
    seen, out = {}, {}
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - k + 1):
            key = tuple(w[s : s + k])
            if key in seen:
                gone[s : s + k] = [True] * k
            seen.setdefault(key, (i, s))
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


@pytest.mark.parametrize("most", [1, substring.SHARD])
@pytest.mark.parametrize("vocabulary", [2, 12])
def test_substrings_against_brute_force(spark, most, vocabulary):
    rows = texts(9, 50, vocabulary)
    out = substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), most=most)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in out.collect()}
    assert got == brute_substrings(rows)
    assert sum(v[1] for v in got.values()) > 0


def test_fm_index_counts_every_pattern():
    rng = np.random.default_rng(6)
    text = rng.integers(0, 4, 300)
    text[-1] = 0
    index = substring.FMIndex(text, 12)
    for n in (1, 3, 8):
        for s in range(0, 280, 7):
            p = text[s : s + n]
            if (p == 0).any():
                continue
            lo, hi = np.zeros(1, np.int64), np.full(1, len(text))
            for c in p[::-1]:
                lo, hi = index.extend(np.array([c]), lo, hi)
            where = sorted(index.sa[lo[0] : hi[0]].tolist())
            assert where == [i for i in range(300 - n + 1) if (text[i : i + n] == p).all()]


def test_matching_statistics():
    rng = np.random.default_rng(7)
    text = rng.integers(0, 3, 200)
    text[-1] = 0
    index = substring.FMIndex(text, 9)
    ends = np.array([e for e in range(8, 200) if (text[e - 7 : e + 1] > 0).all()])
    stat, lo, hi = substring.matching_statistics(index, text, ends, 8)
    for e, n, a, b in zip(ends, stat, lo, hi):
        many = [sum((text[i : i + k] == text[e - k + 1 : e + 1]).all() for i in range(200 - k + 1)) for k in range(1, 9)]
        assert n == max([k for k, m in enumerate(many, 1) if m > 1], default=0)
        assert b - a == (many[7] if n == 8 else 0)


def test_substrings_of_one_id_with_other_texts(spark):
    word = iter(range(10**6))
    new = lambda n: [f"w{next(word)}" for _ in range(n)]
    a, b, c = new(30), new(25), new(30)
    rows = [(1, a + b), (2, c), (2, new(5) + a), (2, c), (3, c + b)]
    rows = [(i, " ".join(w)) for i, w in rows]
    got = substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = [(1, rows[0][1]), (2, rows[1][1]), (2, " ".join(rows[2][1].split()[:5])), (2, rows[1][1]), (3, "")]
    assert sorted((r["doc_id"], r["kept"]) for r in got) == sorted(expected)


def test_substrings_of_odd_rows(spark, odd):
    out = substring.substring_dedup(odd).collect()
    got = {r["doc_id"]: r for r in out}
    assert len(out) == len(ODD)
    assert (got[2]["n_words"], got[2]["kept"], got[3]["n_words"]) == (0, "", 0)
    assert (got[5]["n_words"], got[5]["n_removed"], got[5]["removed"]) == (30_000, 29_999, [[1, 30_000]])
    assert got[None]["n_removed"] == 0
    assert substring.substring_dedup(odd.limit(0)).count() == 0


# --- embeddings


@pytest.mark.parametrize("tile", [16 * 64 * 8, embeddings.TILE])
def test_embeddings_against_brute_force(spark, tile):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 64))
    x[40:80] = x[:40] + rng.normal(size=(40, 64)) * rng.uniform(0, 0.6, (40, 1))
    x[80:90] = x[5] * np.arange(1, 11)[:, None]
    x[90:95] = x[7]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(200, None), (201, [0.0] * 64), (202, [float("nan")] * 64), (203, [1.0, None] * 32), (204, [1.0]), (205, []), (206, [float("inf")] * 64)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumns({"v": F.lit(1), "node": F.lit(2)})
    got = {r["vec_id"]: tuple(r)[1:] for r in embeddings.embedding_components(df, tile=tile).collect()}
    cos = x @ x.T / np.linalg.norm(x, axis=1) / np.linalg.norm(x, axis=1)[:, None]
    a, b = np.nonzero((cos >= 0.95) & ~np.eye(120, dtype=bool))
    label = local_components(120, a, b)
    assert {i: got[i] for i in range(120)} == {i: (int((a == i).sum()), int(label[i]), bool(label[i] == i)) for i in range(120)}
    assert {got[i] for i, _ in bad} == {(0, i, True) for i, _ in bad} and len(got) == 127
    assert embeddings.embedding_components(df.limit(0)).count() == 0
    assert embeddings.embedding_components(df.where("vec_id >= 200 and vec_id <> 204")).count() == 6


def test_long_vectors_keep_their_own_axes(spark, monkeypatch):
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet")
    expected = sorted(map(tuple, embeddings.embedding_components(vectors, tile=20_000).collect()))
    monkeypatch.setattr(embeddings, "LONGEST", 8)
    assert embeddings.principal_axes(vectors.limit(1).selectExpr("1 as n", "array(1d) as v"), [16]) == {}
    assert sorted(map(tuple, embeddings.embedding_components(vectors, tile=20_000).collect())) == expected


def test_embeddings_of_any_scale_length_and_id(spark):
    tiny = 5e-324
    rows = [(1, [1e-200] * 4), (2, [1e200] * 4), (3, [tiny] * 4), (4, [1e300, -1e300, 0.0, 0.0]), (5, [tiny, -tiny, 0.0, 0.0]), (6, [1.0, 2.0]), (7, [2.0, 4.0]), (8, [1.0, 2.0])]
    rows += [(9, [1.0, 0.0, 0.0]), (9, [0.0, 1.0, 0.0]), (10, [0.0, 2.0, 0.0]), (None, [1.0, 2.0]), (12, [3.0]), (13, [-3.0]), (14, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((tuple(r) for r in embeddings.embedding_components(df).collect()), key=repr)
    expected = [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 1, 4, True), (5, 1, 4, False), (6, 2, 6, True), (7, 2, 6, False), (8, 2, 6, False)]
    expected += [(9, 0, 9, True), (9, 1, 9, True), (10, 1, 9, False), (None, 0, None, True), (12, 1, 12, True), (13, 0, 13, True), (14, 1, 12, False)]
    assert got == sorted(expected, key=repr)


# --- quality


def test_quality_learns_interactions():
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 1, (4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.fit(x[:3000], y[:3000])
    assert (0, 1) in m.pairs
    assert ((m.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95


def brute_score(m, x):
    """An additive model's score of one row of features, table by table."""
    at = [int(np.searchsorted(c, v, side="right")) for c, v in zip(m.cuts, x)]
    total = m.base + sum(t[i] for t, i in zip(m.tables, at)) + sum(t[at[a]][at[b]] for (a, b), t in zip(m.pairs, m.pair_tables))
    return 1 / (1 + np.exp(-total))


def brute_nearest(m, text):
    """The language of the centroid with the largest cosine to the TF-IDF of a text's letter n-grams, one by one."""
    t = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    t = " " + " ".join(t.split()) + " "
    count = Counter()
    for n in (1, 2, 3):
        for i in range(len(t) - n + 1):
            key = 0
            for c in t[i : i + n]:
                key = key << 21 | ord(c)
            count[(key * 0x9E3779B97F4A7C15 % 2**64) >> 51] += 1
    v = {k: np.log1p(n) * m.idf[k] for k, n in count.items()}
    cos = [sum(row[k] * x for k, x in v.items()) / np.sqrt(sum(x * x for x in v.values())) for row in m.matrix]
    return m.langs[m.of[int(np.argmax(cos))]], max(cos)


def test_quality_on_held_out_documents(spark):
    labels = pd.read_parquet("/root/testdata/sf0.1/labels.parquet")
    docs = pd.read_parquet("/root/testdata/sf0.1/documents.parquet").merge(labels, on="doc_id")
    held = np.array([zlib.crc32(str(i).encode()) % 4 == 2 for i in docs.doc_id])
    x = np.array([quality.features(t) for t in docs.text])
    m = quality.fit(x[~held], docs.quality.to_numpy(float)[~held])
    assert ((m.score(x[held]) >= 0.7) == docs.quality[held]).mean() > 0.97
    assert m.score(x[:50]).tolist() == pytest.approx([brute_score(m, r) for r in x[:50]])


def test_long_words_take_time_in_line_with_their_length():
    start = time.time()
    got = quality.features("a" * 10**6 + " # " + "b" * 10**6)
    assert time.time() - start < 2 and got[quality.FEATURES.index("odd_words")] == pytest.approx(1 / 3)


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (5, 0), (5, 0), (None, 1), (3, None)], "doc_id long, label int")
    out = quality.score(odd, quality.train(odd, labels)).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    none = quality.train(odd.limit(0), labels.limit(0))
    assert {r["score"] for r in quality.score(odd, none).collect()} == {0.5}
    assert quality.score(odd.limit(0), none).count() == 0


# --- language ID


def test_languages_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    m = langid.train(docs.where(~held))
    out = langid.identify(docs.where(held), m)
    assert out.where("lang = lang_pred").count() / out.count() > 0.97
    assert out.where("rejected").count() <= 0.01 * out.count()
    for r in out.orderBy(F.length("text")).limit(30).collect():
        lang, cos = brute_nearest(m, r["text"]) if any(map(str.isalpha, r["text"] or "")) else ("und", 0.0)
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(cos)


def test_rejection(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = langid.train(docs)
    strange = [" ".join("ж щ ю ъ ѣ э".split()[i % 6] * 3 for i in range(n)) for n in (200, 400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*strange, None, "", "123 !!"])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.identify(df, m).collect()}
    assert all(r["rejected"] for r in got.values())
    assert [got[i]["lang_pred"] for i in (2, 3, 4)] == ["und"] * 3


def test_languages_of_odd_rows(spark, odd):
    out = langid.identify(odd, langid.train(odd))
    assert out.count() == len(ODD) and out.where("doc_id = 2").first()["lang_pred"] == "und"
    none = langid.train(odd.limit(0))
    assert {r["lang_pred"] for r in langid.identify(odd, none).collect()} == {"und"}


# --- queries and pipeline


@pytest.mark.parametrize("name", sorted(LLM.sql))
def test_query_sql(spark, duck, name):
    same_as_sql(spark, duck, LLM.queries[name], LLM.sql[name])


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_op2_rows(spark):
    docs = pd.read_parquet(f"{DATA}/documents.parquet")
    got = by_id(LLM.queries["op2_media"](spark, DATA))
    for i, t in zip(docs.doc_id, docs.text):
        b, r = (t or "").encode(), got[i]
        p = b + bytes(-len(b) % 64 if b else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        file = io.BytesIO()
        with wave.open(file, "wb") as w:
            w.setparams((1, 1, 8000, len(p), "NONE", ""))
            w.writeframes(p)
        assert (r["media_bytes"], r["media_sha256"]) == (len(file.getvalue()), hashlib.sha256(file.getvalue()).hexdigest())
        kind, said, carved, within, n, mean, crossings, histogram = r["feature"].split("|")
        above = [x * len(p) > sum(p) for x in p]
        counts = Counter(p)
        assert (kind, said, carved, within) == ("audio/wav", "corrected", "", "") and (int(n), int(mean)) == (len(p), 1000 * sum(p) // len(p))
        assert int(crossings) == sum(a != b for a, b in zip(above, above[1:])) and histogram == f"{zlib.crc32(struct.pack('<256q', *[counts[i] for i in range(256)])):08x}"
    assert len(got) == len(docs)


def test_op3_rows(spark):
    from tokenizers import Tokenizer

    docs, t = pd.read_parquet(f"{DATA}/documents.parquet"), Tokenizer.from_file(WORDS)
    rows = LLM.queries["op3_packing"](spark, DATA).toPandas()
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for i, x in zip(docs.doc_id, docs.text)}
    assert rows.groupby("doc_id").length.sum().to_dict() == {i: len(x) for i, x in ids.items()}
    for r in rows.itertuples():
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 2048
    assert rows.length.sum() / (2048 * rows.sequence_id.nunique()) > 0.9


def test_op4_rows(spark):
    docs = pd.read_parquet(f"{DATA}/documents.parquet")
    fps = {i: brute_fingerprint(t) for i, t in zip(docs.doc_id, docs.text)}
    got = by_id(LLM.queries["op4_simhash"](spark, DATA))
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(fps)


def test_op5_rows(spark):
    docs, c = pd.read_parquet(f"{DATA}/documents.parquet"), pieces.PieceCodec(PIECES)
    got = by_id(LLM.queries["op5_merge_dropout"](spark, DATA))
    for i, t in list(zip(docs.doc_id, docs.text)):
        ids, sha = c.encode(t or "", 1, pieces.DROPOUT, str(i)), hashlib.sha256((t or "").encode()).hexdigest()
        assert tuple(got[i])[1:] == (len(ids), zlib.crc32(ids.tobytes()), sha, sha)
    assert len(got) == len(docs)


def test_op7_rows(spark):
    docs = pd.read_parquet(f"{DATA}/documents.parquet")
    expected = brute_substrings(list(zip(docs.doc_id, docs.text)))
    got = by_id(LLM.queries["op7_substring"](spark, DATA))
    assert {i: tuple(r)[1:] for i, r in got.items()} == {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, (n, gone, kept) in expected.items()}


def test_op8_rows(spark):
    vectors = pd.read_parquet(f"{DATA}/embeddings.parquet")
    x = np.stack(vectors.embedding).astype(float)
    cos = x @ x.T / np.linalg.norm(x, axis=1) / np.linalg.norm(x, axis=1)[:, None]
    a, b = np.nonzero((cos >= 0.95) & ~np.eye(len(x), dtype=bool))
    label, ids = local_components(len(x), a, b), vectors.vec_id.to_numpy()
    got = by_id(LLM.queries["op8_embeddings"](spark, DATA), "vec_id")
    assert {i: tuple(r)[1:] for i, r in got.items()} == {int(i): (int((a == k).sum()), int(ids[label[k]]), bool(label[k] == k)) for k, i in enumerate(ids)}


def test_op9_and_op10_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = pd.read_parquet(f"{d}/documents.parquet"), pd.read_parquet(f"{d}/labels.parquet")
    nine = LLM.queries["op9_quality"](spark, d).toPandas().set_index("doc_id")
    assert len(nine) == len(docs) and nine.score.between(0, 1).all()
    assert (nine.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in nine.index]).all() and (nine.predicted == (nine.score >= 0.7)).all()
    known = labels.join(nine, "doc_id")
    assert (known.predicted == known.quality)[known.held_out].mean() > 0.95
    ten = LLM.queries["op10_language"](spark, d).toPandas().set_index("doc_id")
    assert len(ten) == len(docs) and ten.score.between(0, 1).all()
    assert (ten.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in ten.index]).all()
    both = docs.join(ten, "doc_id")
    assert (both.lang == both.lang_pred)[both.held_out].mean() > 0.95 and set(ten.lang_pred) <= {*docs.lang.dropna(), "und"}


def test_op9_and_op10_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    crc = lambda n: F.crc32(F.col("doc_id").cast("string").cast("binary")) % n
    m = quality.train(docs, labels.where(crc(4) != 2))
    got = by_id(LLM.queries["op9_quality"](spark, DATA))
    ten, langs = by_id(LLM.queries["op10_language"](spark, DATA)), langid.train(docs.where(crc(5) != 0))
    for r in docs.collect():
        assert got[r["doc_id"]]["score"] == pytest.approx(brute_score(m, quality.features(r["text"])))
        if any(map(str.isalpha, r["text"] or "")):
            lang, cos = brute_nearest(langs, r["text"])
            assert ten[r["doc_id"]]["lang_pred"] == lang and ten[r["doc_id"]]["score"] == pytest.approx(cos)
        else:
            assert ten[r["doc_id"]]["lang_pred"] == "und"


@pytest.mark.parametrize("n", [2, 3])
def test_documents_left_with_white_space_go(spark, n):
    line = "a line of some eight words or so here"
    docs = spark.createDataFrame([(1, f"{line}\nmore of it", "en", "s", 1), (2, f"{line}\n" * (n - 1), "en", "s", 1), (3, "\n", "en", "s", 1)], DOCS)
    kept = corpus_pipeline.line_dedup(spark, docs, DATA).collect()
    assert {r["doc_id"] for r in kept} == {1, 3}  # what was blank from the start lost nothing


def test_pipeline_with_an_empty_table_and_clashing_names(spark, odd):
    for docs in (odd.limit(0), odd):
        for name, stage in corpus_pipeline.STAGES:
            columns, docs = docs.columns, stage(spark, docs, DATA)
            assert name == "pack" or docs.columns == columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").unionByName(spark.createDataFrame([(10**6, None, None, "x", None), (10**6 + 1, "12 34", "en", "x", 5)], DOCS))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.toPandas()
        assert name == "pack" or docs.columns == columns
    first = kept["language"]
    assert not {10**6, 10**6 + 1} & set(first.doc_id) and len(first) >= 199
    expected = brute_lines(list(zip(first.doc_id, first.text)))
    lined = kept["line_dedup"]
    assert dict(zip(lined.doc_id, lined.text)) == {i: t for i, t in expected.items() if t.strip() or t == dict(zip(first.doc_id, first.text))[i]}
    label = brute_near(list(zip(lined.doc_id, lined.text)))
    near = kept["near_dedup"]
    assert set(near.doc_id) == set(label.values())
    cut = brute_substrings(list(zip(near.doc_id, near.text)))
    last = kept["substring_dedup"]
    assert {i: t.split() for i, t in zip(last.doc_id, last.text)} == {i: v[2].split() for i, v in cut.items() if v[2] or not v[1]}
    assert set(kept["pack"].doc_id) == set(last.doc_id)
    assert (last.n_chars == last.text.str.len()).all()
