"""Archives: round trips, revisits, damage; spelling variants and hard negatives beside plain versions."""

import base64
import glob
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tickloom.llm import gnat, spelling, warc

PAGES = [(5, "http://a/x y\r\nEvil: 1", "<p>one</p>"), (3, "http://a", "<p>one</p>"), (9, None, "<p>one</p>"), (1, "", None), (2, "u", ""), (7, "u", "ßé" * 200_000),
         (None, "u", "only without id"), (None, "u", "<p>one</p>"), (8, "u", "\r\n\r\nWARC/1.1\r\n"), (8, "u", "\r\n\r\nWARC/1.1\r\n"), (10, "u", "P*M\x18\0\0\0\0")]


def plain_records(pages, least=0):
    groups = defaultdict(list)
    for i, _, t in pages:
        groups[t or ""].append(i)
    out = []
    for i, _, t in pages:
        b, ids = (t or "").encode(), [x for x in groups[t or ""] if x is not None]
        first = min(ids) if ids and len(b) >= least else None
        refers = None if first is None or i == first else first
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


@pytest.mark.parametrize("least,size", [(0, 1 << 20), (12, 1 << 20), (0, 600)])
def test_archives_round_trip(spark, tmp_path, least, size):
    table = spark.createDataFrame([(*p, "d", 4, "s") for p in PAGES], "page_id long, url string, html string, digest string, size int, same string")
    warc.write_archives(table.repartition(2), f"{tmp_path}/w", least_bytes=least, archive_bytes=size)
    rows = warc.page_records(spark, f"{tmp_path}/w").collect()
    assert sorted(map(tuple, rows), key=str) == plain_records(PAGES, least)
    full = warc.read_archives(spark, f"{tmp_path}/w").collect()
    assert {r.payload.decode() for r in full if r.record_type == "response"} == {t or "" for *_, t in PAGES}
    assert all(r.problem is None for r in full) and not any("\n" in (r.target_uri or "") for r in full)
    files = glob.glob(f"{tmp_path}/w/part-*")
    assert all(open(f, "rb").read(4) == warc.DICTIONARY_FRAME for f in files) and (size > 600 or len(files) > 3)


def test_archives_repeat_many(spark, tmp_path, monkeypatch):
    """More repeated payloads than may be broadcast: the Bloom bitmap and the hot join give the same."""
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 3)
    pages = [(i, "u", f"page {i % 40}" if i % 3 else "hot") for i in range(300)]
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), f"{tmp_path}/w")
    assert sorted(map(tuple, warc.page_records(spark, f"{tmp_path}/w").collect()), key=str) == plain_records(pages)


def test_no_pages(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/w")
    assert warc.page_records(spark, f"{tmp_path}/w").count() == 0


def test_damaged_archives():
    date, digest = "2024-01-01T00:00:00Z", lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    made = [(f"urn:x-page:{i}", "u", b"body %d " % i * 50, digest(b"body %d " % i * 50), None) for i in range(20)]
    whole = next(warc._archives(iter(made), date, 1 << 20))
    good = [r for _, r in warc.records(whole)]
    assert [r["payload"] for r in good] == [m[2] for m in made] and not any(r.get("problem") for r in good)
    ends, at = [], 0
    while at < len(whole):
        ends.append(at := warc.frame_end(memoryview(whole), at))
    cut = [r for _, r in warc.records(whole[:ends[5] - 3])]
    assert len(cut) == 5 and "cut off" in cut[-1]["problem"]
    broken = bytearray(whole)
    broken[ends[3] - 6] ^= 255  # inside the third record's frame
    got = [r.get("problem") is not None for _, r in warc.records(bytes(broken))]
    assert len(got) == 20 and got == [i == 2 for i in range(20)]
    assert all(r["problem"] for _, r in list(warc.records(whole[ends[0]:]))[:1])  # without its dictionary
    plain = zstandard.ZstdCompressor()
    stream = plain.compressobj()
    streamed = stream.compress(warc.record(*made[0][:2], date, *made[0][2:])) + stream.flush()  # a frame that doesn't tell its size
    short = warc.record(*made[0][:2], date, *made[0][2:]).replace(b"Content-Length: 4", b"Content-Length: 5", 1)
    lies = warc.record("urn:x", "u", date, b"x", digest(b"y"), None)
    got = [r.get("problem") for _, r in warc.records(b"".join([streamed, b"\x53\x2a\x4d\x18\x02\0\0\0zz", *(plain.compress(x) for x in (short, lies, b"no record", b""))]))]
    assert got[0] is None and len(got) == 5 and "length" in got[1] and "digest" in got[2] and all(got[3:])
    packed = warc.leading_frame(plain.compress(b"some raw dictionary content"))
    made_with = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(b"some raw dictionary content", dict_type=zstandard.DICT_TYPE_RAWCONTENT))
    assert [r["record_type"] for _, r in warc.records(packed + made_with.compress(warc.record(*made[0][:2], date, *made[0][2:])))] == ["response"]


def plain_variants(rows):
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            w = w[:h % len(w)] + w[h % len(w) + 1:] if h % 97 == 0 else w
            n[w] += len(w) >= 5
    n = {w: k for w, k in n.items() if k >= 3}
    gaps = defaultdict(set)
    for w in n:
        for p in range(len(w)):
            gaps[p, w[:p] + w[p + 1:], 0].add(w)
            gaps[w[:p] + w[p + 1:]].add(w)
    near = defaultdict(set)
    for key, ws in gaps.items():
        if isinstance(key, tuple):
            for w in ws:
                near[w] |= ws - {w}
        elif key in n:
            for w in ws:
                near[w].add(key)
                near[key].add(w)
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            form[w] = best if n[best] >= 2 * n[w] else None

    def root(w):
        while form.get(w):
            w = form[w]
        return w
    return sorted((w, form.get(w), root(w), k, len(near[w]), n.get(form.get(w))) for w, k in n.items())


def test_spelling_variants(docs, sample, empty, spark, monkeypatch):
    monkeypatch.setattr(spelling, "SUBTREE", 64)  # several levels, blocks and parts even for few words
    for table in (sample, docs):
        rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
        assert sorted(map(tuple, spelling.variants(table).collect())) == plain_variants(rows)
    assert spelling.variants(empty).count() == 0
    words = spelling.pin(spelling.counted_words(sample))
    wide = {tuple(r)[:3] for r in spelling.near_words(words).collect()}
    assert wide == {tuple(r)[:3] for r in spelling.near_words(words, block=50, queries=90).collect()}


def test_spelling_of_long_and_odd_words(spark):
    """A run of 40,000 letters and its neighbours, runs over the matrix width, signs between the letters, one letter many times."""
    long = "abcdefghij" * 4000
    texts = [long, long[1:], "x" * 33, "x" * 34, "x" * 35, "×÷×÷×", "×÷×÷÷", "Éclair", "éclair", "ÉCLAIR", "hello-world_hellos", "hell0 helloo"]
    rows = [(i, t) for i, t in enumerate(t for t in texts for _ in range(4))] + [(None, "hello hello hello"), (None, None), (7, ""), (7, "a " * 300_000 + "hello")]
    got = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == plain_variants(rows)


def plain_negatives(rows, every=100, move=True):
    e = [(i, (label + 1) % 10 if i % 7 == 0 and move else label, [int(np.floor(np.float64(x) * 256)) for x in v]) for i, v, label in rows
         if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    common = Counter(len(v) for *_, v in e)
    e = [r for r in e if len(r[2]) == max(common, key=lambda d: (common[d], d))] if e else []
    out = []
    for n, (i, label, v) in enumerate(e):
        if i % every == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, lab) for m, (j, lab, w) in enumerate(e) if m != n)
            for p, j, _ in [x for x in s if x[2] == label][:5]:
                fit = [x for x in s if x[2] != label and 30 * -p <= 100 * -x[0] <= 90 * -p][:10]
                out += [(i, j, k + 1, x[1], -p, -x[0]) for k, x in enumerate(fit)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int, v string, uid int, part string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "v", 1, "p") for r in rows], VECTORS).repartition(3)


def test_hard_negatives(spark, sf, monkeypatch):
    """Several blocks, groups and levels; a hot vector, ties, repeated ids, odd rows."""
    for name, value in (("BLOCK", 150), ("WINDOWS", 20), ("LEAF", 8)):
        monkeypatch.setattr(gnat, name, value)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((6, 8))
    rows = [(i, [float(x) for x in (centres[i % 6] + 0.4 * rng.standard_normal(8))], int(rng.integers(0, 4))) for i in range(500)]
    rows += [(i, [0.5] * 8, i % 3) for i in range(500, 800)] + rows[100:102] + [(100, [1.0] * 8, 2)]
    rows += [(None, [1.0] * 8, 1), (1000, None, 1), (1001, [1.0] * 8, None), (1100, [1.0] * 7 + [None], 1), (1200, [float("nan")] * 8, 1), (1300, [float("inf")] * 8, 1),
             (1400, [1.0] * 3, 1), (1500, [0.0] * 8, 1), (1600, [], 1)]
    assert sorted(map(tuple, gnat.mine(vectors(spark, rows), every=50).collect())) == plain_negatives(rows, 50)
    assert gnat.mine(vectors(spark, rows[:0])).count() == 0 and gnat.mine(vectors(spark, rows[-1:])).count() == 0


def test_hard_negatives_of_huge_components(spark):
    """Beyond the exact range of doubles the scores are whole numbers without a tree."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(4) * 1e6], i % 3) for i in range(200)]
    assert sorted(map(tuple, gnat.mine(vectors(spark, rows), every=20).collect())) == plain_negatives(rows, 20)


def test_tree_rules_out_but_never_loses():
    """Windows of clustered rows: the walk reads few rows and still all that fit."""
    rng = np.random.default_rng(5)
    x = np.floor(rng.standard_normal((20, 16))[rng.integers(0, 20, 4000)] * 900 + rng.standard_normal((4000, 16)) * 40)
    space = gnat.Space(float((x * x).sum(axis=1).max()))
    a = x[:50]
    s = a @ x.T
    low, high = np.sort(s, axis=1)[:, -60], np.sort(s, axis=1)[:, -20]
    near, far = space.annulus(a, low, high)
    read, found = np.zeros(50), [set() for _ in range(50)]
    for who, rows in gnat.Tree(space.lift(x), space, 64).leaves(a, near, far):
        read[who] += len(rows)
        for w in who:
            found[w] |= set(rows.tolist())
    assert all(set(np.flatnonzero((s[i] >= low[i]) & (s[i] <= high[i])).tolist()) <= found[i] for i in range(50))
    assert read.mean() < 0.5 * len(x)


def test_archive_query_rows(spark, sf):
    want = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    got = entry.queries()["op11_warc"](spark, sf)
    assert sorted(map(tuple, got.collect()), key=str) == plain_records(want) and got.filter(F.col("payload_bytes").isNull()).count() == 0
