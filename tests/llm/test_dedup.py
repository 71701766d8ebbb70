"""Exact dedup, n-gram join, line and paragraph dedup against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from barwise.llm import exact_dedup, line_dedup, links, paragraph_dedup, set_join
from tests.llm.cases import documents, lower, rows, sentence, words


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("hashed", [exact_dedup.content_hash, lambda norm: F.char_length(norm).cast("string")], ids=["md5", "colliding"])
def test_exact_groups(spark, keep, hashed):
    got = exact_dedup.groups(documents(spark), keep, hashed=hashed).collect()
    groups = defaultdict(list)
    for i, t, *_ in rows():
        groups[lower(t or "")].append(i)
    assert len(got) == len(rows())
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = Counter()
    for r in got:
        ids = by_sha[r.text_sha256]
        known = [i for i in ids if i is not None]
        best = (min if keep == "smallest" else max)(known) if known else None
        assert (r.keep_id, r.group_size) == (best, len(ids))
        if r.kept:
            kept[r.text_sha256] += 1
            assert r.doc_id == best
    assert kept == Counter(by_sha.keys())


def test_exact_dedup_keeps_whole_rows(spark):
    docs = documents(spark)
    out = exact_dedup.dedup(docs, "largest")
    assert out.columns == docs.columns
    texts = [lower(r.text or "") for r in out.collect()]
    assert sorted(texts) == sorted({lower(t or "") for _, t, *_ in rows()})
    assert exact_dedup.dedup(docs.limit(0)).count() == 0


def brute_components(data, n=3, percent=90):
    sets = []
    for _, t, *_ in data:
        w = words(t)
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    parent = list(range(len(data)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    lowest = {}
    for i, (doc, *_) in enumerate(data):
        if doc is not None:
            lowest[root(i)] = min(lowest.get(root(i), doc), doc)
    return sorted((str(doc), len(sets[i]), str(lowest.get(root(i)) if sets[i] else doc)) for i, (doc, *_) in enumerate(data))


def crowded(seed):
    """Near copies that differ pairwise, documents that share a long passage, and unrelated ones."""
    rng = random.Random(seed)
    passage, base = sentence(rng, 60).split(), sentence(rng, 150).split()
    data = []
    for k in range(40):
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(len(copy))] = f"w{rng.randrange(1000)}"
        data.append((100 + k, " ".join(copy), "en", "s"))
    for k in range(40):
        own = sentence(rng, rng.randrange(3, 200)).split()
        at = rng.randrange(len(own))
        data.append((200 + k, " ".join(own[:at] + passage + own[at:]), "en", "s"))
    return data + [(300 + k, sentence(rng, rng.randrange(1, 30)), "en", "s") for k in range(20)]


@pytest.mark.parametrize(("percent", "spare"), [(90, 64), (90, 0), (80, 5)])
def test_set_join_matches_brute_force(spark, monkeypatch, percent, spare):
    monkeypatch.setattr(set_join, "FREQUENT", 5)
    monkeypatch.setattr(set_join, "SPARE", spare)
    data = rows() + crowded(3)
    got = set_join.join(documents(spark, data), percent=percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(data, percent=percent)


@pytest.mark.parametrize("at", [0, 10**9], ids=["lists", "subsets"])
@pytest.mark.parametrize(("percent", "size"), [(90, 9), (80, 4)])
def test_set_join_links_a_set_with_one_element_more(spark, monkeypatch, percent, size, at):
    """Sizes n and n + 1 at exactly the threshold, and one size less, which does not reach it."""
    monkeypatch.setattr(set_join, "boundary", lambda costs, percent: at)
    data = []
    for k in range(size - 1, size + 1):
        text = " ".join(f"w{k}x{i}" for i in range(k + 2))
        data += [(10 * k, text, "en", "s"), (10 * k + 1, f"{text} more", "en", "s"), (10 * k + 2, f"more {text}", "en", "s")]
    got = {r.doc_id: r.component_id for r in set_join.join(documents(spark, data), percent=percent).collect()}
    assert got == {i: 10 * size if i >= 10 * size else i for i, *_ in data}
    assert sorted((str(i), str(c)) for i, c in got.items()) == [(i, c) for i, _, c in brute_components(data, percent=percent)]


def brute_links(data, n=3, percent=90):
    """Per row the number of other distinct sets that link with its own."""
    sets = []
    for _, t, *_ in data:
        w = words(t)
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    kinds = set(sets)
    return sorted((str(doc), sum(bool(s) and s != x and 100 * len(s & x) >= percent * len(s | x) for x in kinds)) for (doc, *_), s in zip(data, sets, strict=True))


@pytest.mark.parametrize(("nodes", "tokens", "columns"), [(256, 10**6, 4096), (7, 10**6, 50), (256, 900, 4096)])
def test_set_join_counts_all_links(spark, monkeypatch, nodes, tokens, columns):
    monkeypatch.setattr(links, "CHUNK_NODES", nodes)
    monkeypatch.setattr(links, "CHUNK_TOKENS", tokens)
    monkeypatch.setattr(links, "CHUNK_COLUMNS", columns)
    data = rows() + crowded(6)
    got = set_join.join(documents(spark, data)).collect()
    want = brute_links(data)
    assert max(k for _, k in want) > 5 and sorted((str(r.doc_id), r.n_links) for r in got) == want


@pytest.mark.parametrize("at", [0, 10**9], ids=["lists", "subsets"])
def test_set_join_boundary_changes_nothing(spark, monkeypatch, at):
    monkeypatch.setattr(set_join, "boundary", lambda costs, percent: at)
    data = crowded(4)
    got = set_join.join(documents(spark, data)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(data)


def test_boundary_is_the_cheapest_size():
    costs = [(10, 1000, 10.0), (50, 1000, 500_000.0), (300, 1000, 100.0)]
    assert set_join.boundary(costs, 90) in range(50, 300)
    assert set_join.boundary([], 90) == 0


def test_set_join_dedup(spark):
    data = rows() + crowded(5)
    docs = documents(spark, data)
    out = set_join.dedup(docs)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    wanted = {i for i, _, c in brute_components(data) if i == c}
    assert {str(i) for i in kept} == wanted
    assert set_join.dedup(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000, 1000 + k) for k in range(1, 50)] + [(k, k + 1) for k in range(2000, 2040)]
    got = {r.node: r.component for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    for node in got:
        seen, todo = {node}, [node]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x), todo.append(x)
        assert got[node] == min(seen)
    assert set(got) == {x for e in edges if e[0] != e[1] for x in e}


def test_line_dedup_edges(spark):
    data = [(i, f"http://Host.example/{i}", f"<p>menu<p>own {i}<br>menu") for i in range(10)]
    data += [(20, None, "<p>menu"), (21, "no address", None), (22, "http://alone.example", "<div>menu</div>"), (9, "http://host.example/9", "<p>menu<p>own 9<br>menu")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("lines", F.lit(1)).withColumn("host", F.lit("x"))
    got = line_dedup.drop_boilerplate(pages, line_dedup.lines_of_html(F.col("html")), line_dedup.host_of(F.col("url")), ratio=0.3).collect()
    assert len(got) == len(data)
    by_id = {r.page_id: r for r in got}
    assert (by_id[3].text, by_id[3].n_lines, by_id[3].n_dropped, by_id[3].host_pages) == ("own 3", 3, 2, 11)
    assert (by_id[20].text, by_id[20].host_pages) == ("menu", None)
    assert (by_id[21].text, by_id[21].n_lines) == ("", 0)
    assert by_id[22].text == "menu"


def test_paragraph_selection_is_guaranteed():
    rng = np.random.default_rng(5)
    n = paragraph_dedup.LEAST
    for _ in range(30):
        shared = rng.integers(0, 1 << 63, 2 * n - 1).astype(np.uint64)
        picked = []
        for _ in range(2):
            whole = np.concatenate([rng.integers(0, 1 << 63, rng.integers(0, 90)).astype(np.uint64), shared, rng.integers(0, 1 << 63, 40).astype(np.uint64)])
            a, _ = paragraph_dedup._fold(whole)
            picked.append(set(a[paragraph_dedup.chosen(a)].tolist()))
        assert picked[0] & picked[1]


def test_bands_reach_the_recall():
    bands, per_band = paragraph_dedup.tune(80, 0.995)
    assert 1 - (1 - 0.8**per_band) ** bands >= 0.995
    assert per_band > 1


def test_paragraph_repeats(spark):
    rng = random.Random(9)
    passage = sentence(rng, 55)
    near = sentence(rng, 80).split()
    own = [sentence(rng, 70) for _ in range(8)]
    other = list(near)
    other[40] = "changed"
    data = [(1, f"{own[0]} {passage} {own[1]}", "", ""), (2, f"{own[2]}\n{passage} {own[3]}", "", ""), (3, f"{own[4]}\n{' '.join(near)}", "", "")]
    data += [(4, f"{' '.join(other)}\n{own[5]}", "", ""), (5, own[6], "", ""), (6, own[7], "", ""), (7, None, "", ""), (8, "", "", ""), (None, passage, "", "")]
    docs = documents(spark, data)
    got = paragraph_dedup.repeats(docs).collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 4, None}
    assert {r.doc_id for r in got if r.removed} == {2, 4, None}
    assert all(r.kept_in in (1, 3) and r.n_words == r.end_word - r.start_word >= paragraph_dedup.LEAST for r in got)
    for r in got:
        if r.doc_id == 2:
            assert 70 <= r.start_word and r.end_word <= 125
    cleaned = {r.doc_id: r.text for r in paragraph_dedup.cut(docs, spark.createDataFrame(got)).collect()}
    assert cleaned[4] == f"\n{own[5]}" and cleaned[5] == own[6] and cleaned[7] is None and cleaned[1] == data[0][1]
    assert own[2] in cleaned[2] and own[3] in cleaned[2] and passage not in cleaned[2]
    assert paragraph_dedup.repeats(docs.limit(0)).count() == 0


def test_every_dealt_query_is_registered():
    names = entry.queries()
    assert all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 11)) and "pipeline" in names


def test_wide_maps_lose_no_link_and_reject_large_sets():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (1, 64, 256, 257, 5000)]
    assert [len(m) for m in links.wide_parities(sets).to_pylist()] == [4, 4, 4, 8, 128]
    halves = np.array(links.wide_parities([sets[4]])[0].as_py()).reshape(2, -1)
    place = (sets[4] >> np.uint64(8) & np.uint64(64 * 64 - 1)).astype(int)
    bits = np.unpackbits((halves[0] ^ halves[1]).view(np.uint8), bitorder="little")
    assert (bits == np.bincount(place, minlength=64 * 64) % 2).all()


def test_near_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 1100, dtype=np.uint64)
    # 0 to 3 are links of each other at .8, with maps of two lengths; 4 and 5 share a tenth with them.
    sets = [base[:1000], base[:1030], base[20:1040], base[:1020]] + [np.concatenate([base[:100], rng.integers(0, 1 << 63, 950, dtype=np.uint64)]) for _ in range(2)]
    rows = [(i, len(s), m) for i, (s, m) in enumerate(zip(sets, links.wide_parities(sets).to_pylist(), strict=True))]
    maps = spark.createDataFrame(rows, "node long, n int, wide array<long>")
    pairs = spark.createDataFrame([(a, b) for b in range(6) for a in range(b)], "a long, b long")
    got = {(r.a, r.b) for r in links.near(pairs, maps, 80).collect()}
    assert {len(m) for _, _, m in rows} == {16, 32}
    assert got == {(a, b) for b in range(4) for a in range(b)}


def test_large_sets_that_share_a_passage_are_not_read_as_a_whole(spark, monkeypatch):
    rng = random.Random(9)
    passage = sentence(rng, 40)
    data = [(k, f"{passage} " + " ".join(f"a{k}b{i}" for i in range(1500)), "en", "s") for k in range(4)]
    read, whole = [], set_join._whole
    monkeypatch.setattr(set_join, "boundary", lambda costs, percent: 0)
    monkeypatch.setattr(set_join, "_whole", lambda *a: read.append(out := whole(*a)) or out)
    docs = documents(spark, data)
    assert {r.component_id for r in set_join.join(docs, percent=80, count_links=False).collect()} == {0, 1, 2, 3}
    assert not any("tokens" in t.columns for t in read)


def test_dedups_shuffle_no_texts(spark):
    from barwise.session import setting

    docs = documents(spark, rows())
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        for out in (exact_dedup.dedup(docs), set_join.dedup(docs)):
            assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
