"""Hard negatives, lexical search and web archives against brute force."""

import base64
import gzip
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from barwise.llm import hard_negatives, lexical_search, warc
from barwise.session import materialize, new_path
from tests.llm.cases import documents, lower, rows

VECTORS = "vec_id long, embedding array<float>, label int, row string, id string, label0 int, score string"


def vectors(seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(3, 20))
    out = []
    for i in range(400):
        label = int(rng.integers(0, 4))
        out.append((i, (centers[i % 3] + rng.normal(size=20) * rng.choice([0.05, 1.0])).astype(np.float32).tolist(), label))
    out += [(400, out[1][1], 0), (401, out[1][1], 1), (402, out[1][1], 0), (300, out[300][1], out[300][2])]  # ties, a repeated anchor
    out += [(None, out[5][1], 1), (None, out[5][1], 2), (500, None, 1), (501, out[7][1], None), (502, [], 1)]
    out += [(503, [1.0, None, *[0.5] * 18], 1), (504, [float("nan")] * 20, 2), (505, [float("inf")] * 20, 2), (506, [3e38] * 20, 2)]
    out += [(600, [0.0] * 20, 1), (700, rng.normal(size=5).tolist(), 1), (701, rng.normal(size=5).tolist(), 1), (702, rng.normal(size=5).tolist(), 2)]
    out += [(703, rng.normal(size=5).tolist(), 3)]
    return out


def brute_negatives(data, scale, n_positives=5, n_negatives=10):
    fine = []
    for i, v, label in data:
        if label is not None and v and all(x is not None and math.isfinite(x) and abs(x) < 1e6 for x in v):
            fine.append((i, [math.floor(scale * float(np.float32(x))) for x in v], label))
    out = Counter()
    for a, (i, v, label) in enumerate(fine):
        if i is None or i % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), j is None, j or 0, m) for b, (j, w, m) in enumerate(fine) if b != a and len(w) == len(v)]
        scored.sort()
        for s, missing, j, m in [x for x in scored if x[3] == label][:n_positives]:
            hard = [x for x in scored if x[3] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:n_negatives]
            for rank, (t, gone, k, _) in enumerate(hard, 1):
                out[i, None if missing else j, rank, None if gone else k, -s, -t] += 1
    return out


@pytest.mark.parametrize("block_bytes", [1 << 24, 500])
def test_hard_negatives_match_brute_force(spark, block_bytes):
    data = vectors()
    table = spark.createDataFrame([(*r, "x", "y", 7, "z") for r in data], VECTORS).repartition(3)
    got = hard_negatives.mine(table, F.col("vec_id") % 100 == 0, scale=256.0, block_bytes=block_bytes)
    found = Counter(tuple(r) for r in got.collect())
    assert found == brute_negatives(data, 256.0)
    assert len(found) > 100


def test_hard_negatives_without_rows_or_anchors(spark):
    table = spark.createDataFrame(vectors()[:50], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(table.limit(0), F.lit(True)).collect() == []
    assert hard_negatives.mine(table, F.lit(False)).collect() == []
    assert hard_negatives.mine(table, F.lit(None).cast("boolean")).columns[0] == "anchor_id"


@pytest.mark.parametrize("dim", [1, 3, 64, 100, 200])
def test_intervals_hold_the_scores(dim):
    rng = np.random.default_rng(dim)
    values = np.floor(rng.normal(size=(300, dim)) * rng.choice([1, 50, 1e4], (300, 1)))
    values[:3] = [[0.0] * dim, [1.0] * dim, [-7.0] * dim]
    queries = hard_negatives.Queries(values[:40])
    codes, aligned, rest, coded = hard_negatives.encode(values)
    low, high = queries.intervals(slice(0, 40), codes, aligned, rest, coded)
    exact = values[:40] @ values.T
    assert (low <= exact).all() and (exact <= high).all()
    lengths = np.linalg.norm(values, axis=1)
    assert ((high - low) / 2 <= 0.7 * lengths[:40, None] * lengths[None, :] + 1e-3).all()
    np.testing.assert_allclose(np.linalg.norm(hard_negatives.rotated(values), axis=1), lengths, rtol=1e-12)


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))


def brute_search(data, items, k):
    counted = [(i, Counter(terms(t))) for i, t, *_ in data]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_all = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = Counter()
    for item, text in items:
        scored = []
        for i, c in counted:
            m = 100 - 50 + 50 * sum(c.values()) * n_docs // n_all
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        for rank, (s, missing, i) in enumerate(sorted(scored)[:k], 1):
            out[item, rank, None if missing else i, -s] += 1
    return out


QUERIES = [(1, "the river under old stone3"), (2, "Boats, 7 boats! quiet4 MORNING light1"), (2, "one TWO"), (3, None), (4, ""), (5, "?! --"), (6, "nowhere"), (None, "changed"), (7, "日本語 À é x")]


@pytest.mark.parametrize("k", [3, 50])
@pytest.mark.parametrize("entries", [lexical_search.SHARD_ENTRIES, 40])
def test_search_matches_brute_force(spark, monkeypatch, k, entries):
    monkeypatch.setattr(lexical_search, "SHARD_ENTRIES", entries)
    monkeypatch.setattr(lexical_search, "FIRST_STEP", 2)
    items = spark.createDataFrame([(*q, "x", "y") for q in QUERIES], "item_id long, text string, row string, terms string")
    # Groups of a few terms take more than one pass.
    got = lexical_search.search(documents(spark), items, k, group_terms=8 if entries == 40 else 10**6)
    found = Counter(tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect())
    assert found == brute_search(rows(), QUERIES, k)


def test_search_without_rows(spark):
    items = spark.createDataFrame(QUERIES, "item_id long, text string")
    assert lexical_search.search(documents(spark).limit(0), items).collect() == []
    assert lexical_search.search(documents(spark), items.limit(0)).collect() == []


def test_lists_leave_reading_early():
    """A later shard without good documents is left before its lists end, and loses nothing."""
    rng = random.Random(5)
    docs = [{"doc_id": i, "n": 50, "terms": [0, 1], "counts": [rng.randint(1, 3), 1]} for i in range(5000)]
    batch = pa.RecordBatch.from_pylist(docs, pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))]))
    lists = lexical_search.Lists([batch], np.array([10, 20]), 5000, 250_000)
    docs_found, scores = lists.best(np.array([0, 1]), 5, 1)
    assert list(lists.ids[docs_found]) == [d["doc_id"] for d in sorted(docs, key=lambda d: (-d["counts"][0], d["doc_id"]))[:5]]
    assert len(lists.best(np.array([0, 1]), 5, int(scores[0]) + 1)[0]) == 0


PAGES = [
    (1, "http://a/1", "one"), (2, "http://a/2", "one"), (3, "http://a/3", "two"), (4, "http://a/4", None), (5, None, ""), (6, "http://a/ b\r\nc", "é 🙂\r\n\r\nx"),
    (7, "http://a/7", "x" * 200_000), (8, "u", "x" * 200_000), (None, "n", "one"), (None, None, "none"), (None, "m", "none"), (9, "z", "tie"), (9, "y", "tie"),
    (10, "r", "same"), (10, "r", "same"), (10, "r", "same"), (3, "http://a/3", "one"), (3, "http://a/3", "one"), (11, "s", "small"), (11, "s", "small"),
]


def brute_archive(data, least):
    groups = defaultdict(list)
    for i, u, t in data:
        groups[t or ""].append(((i is not None, i or 0, u is not None, u or ""), i))
    out = Counter()
    for t, members in groups.items():
        body = t.encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        members.sort(key=lambda x: x[0], reverse=True)
        for place, (_, i) in enumerate(members):
            revisit = place > 0 and len(body) >= least
            out[i, len(body), digest, "revisit" if revisit else "response", members[0][1] if revisit else None] += 1
    return out


@pytest.mark.parametrize("least,file_bytes", [(0, 1 << 28), (4, 900)])
def test_archives_come_back(spark, least, file_bytes):
    pages = spark.createDataFrame([(*p, "a", 1, "b") for p in PAGES], "page_id long, url string, html string, digest string, copies int, repeated string")
    folder = new_path(spark, "test-archives")
    files = warc.write(pages.repartition(3), folder, least_bytes=least, file_bytes=file_bytes)
    records = materialize(warc.read(files, folder), "test-records")
    got = warc.resolved(records)
    found = Counter(tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    assert found == brute_archive(PAGES, least)
    ids = [r.record_id for r in records.select("record_id").collect()]
    assert len(set(ids)) == len(ids) == len(PAGES)
    listed = files.collect()
    assert sum(f.n_records for f in listed) == len(PAGES)
    # Any reader of the format sees the same records, and payloads only in responses.
    whole = b"".join(gzip.open(f.path).read() for f in listed)
    assert whole.count(b"WARC/1.1\r\n") == len(PAGES)
    assert whole.count(b"WARC-Type: response\r\n") == sum(f.n_responses for f in listed)
    assert whole.count(b"x" * 200_000) == 1
    assert all(len(line.split(b": ", 1)) == 2 for line in re.findall(rb"(?m)^WARC-Target-URI[^\r]*", whole))


def test_archives_of_an_empty_table(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").limit(0)
    folder = new_path(spark, "test-archives")
    files = warc.write(pages, folder)
    assert files.collect() == []
    assert warc.resolved(materialize(warc.read(files, folder), "test-records")).collect() == []


def test_broken_archives_are_noticed():
    good = warc.page_record(1, "u", b"abc", 3, warc.base32(hashlib.sha1(b"abc").digest()), 0, None, None, "1970-01-01T00:00:00Z")
    assert warc._read_page(good)[1] == 3
    for bad in (good.replace(b"abc", b"abd"), good[:-1], b"x" + good):
        with pytest.raises(ValueError):
            warc._read_page(bad)
    with pytest.raises(ValueError):
        list(warc.read_members(pa.BufferReader(gzip.compress(good)[:-9])))


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_lexical_search", "op13_warc"])
def test_queries_name_their_columns(spark, name):
    folder = "/root/testdata/sf0.001"
    assert entry.queries()[name](spark, folder).count() > 0
    assert name in entry.oracle_sql()
