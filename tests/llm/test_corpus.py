"""The corpus operators against brute force, on small tables full of odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
import zstandard
from compare import TABLES, differences

import corpus_pipeline
from sqlgauge.llm import (
    components, embedding_dedup, exact_dedup, mixing, packing, quality, queries, simhash, substring_dedup, suffix_dedup,
    tokens, url_filter, windows,
)

SF = "/root/testdata/sf0.001"
# columns whose names the operators use inside
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, _part int, fp string, v int"


def corpus():
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma,", "delta.", "e", "zeta", "été", "theta|", "42"]
    said = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = said(70), said(120)
    texts = [None, "", " ", "\n\t", "one", "One", " one ", base, base, base.replace(" ", "  ", 3), base.upper(),
             said(3000), "a " * 200, "a " * 199, said(40) + " " + passage + " " + said(30), passage, passage,
             said(5) + "\n\n" + passage[10:], "x" * 120, "x" * 51 + "y" * 60, passage + passage, "日本 語" * 40]
    texts += [said(rng.randint(1, 90)) for _ in range(30)]
    near = base.split()
    for k in range(6):
        texts.append(" ".join([*near[:k], "changed", *near[k + 1:]]))
    rows = [(i * 3 % 101, t, "en", rng.choice(["s1", "s1", "s1", "s2", None, ""]), None, 7, 1, "x", 2)
            for i, t in enumerate(texts)]
    rows += [rows[7], rows[14], (None, base, None, None, 1, 1, 1, None, None), (None, passage, None, "s2", 1, 1, 1, None, None)]
    return rows


ROWS = corpus()
TEXTS = [(r[0], (r[1] or "").encode()) for r in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(df, want):
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, want))


def reach(ids, linked):
    """Smallest identifier (none last) that links reach, per row; ``linked`` are pairs of rows."""
    group = list(range(len(ids)))
    for a, b in linked:
        x, y = group[a], group[b]
        group = [x if g == y else g for g in group]
    least = defaultdict(list)
    for g, i in zip(group, ids):
        least[g].append(i)
    return [min((i for i in least[g] if i is not None), default=None) for g in group]


def test_exact(docs, empty):
    norm = [(i, re.sub(rb"[ \t-\r]+", b" ", t)) for i, t in TEXTS]
    want = [(i, min((j for j, u in norm if u == t and j is not None), default=None), sum(u == t for _, u in norm),
             hashlib.sha256(t).hexdigest()) for i, t in norm]
    got = exact_dedup.exact_dedup(docs, fan_in=2)
    same(got.drop("kept"), want)
    kept = [r["text_sha256"] for r in got.where("kept").collect()]
    assert len(kept) == len(set(kept)) == len({w[3] for w in want})
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and left.count() == len(kept)
    assert exact_dedup.exact_dedup(empty).count() == exact_dedup.drop_copies(empty).count() == 0


def test_mixing(docs, empty):
    rows = mixing.curriculum(mixing.measured(docs), docs.count()).collect()
    size = {s: sum(r["size"] for r in rows if r["_doc"]["source"] == s) for s in ("", "s1", "s2", None)}
    weight, total, target, free = dict(zip(size, (5, 2, 1, 5))), sum(size.values()), {}, list(size)
    while True:
        rest = total - sum(target.values())
        over = [s for s in free if rest * weight[s] / sum(weight[t] for t in free) > 3 * size[s]]
        if not over:
            break
        target |= {s: 3 * size[s] for s in over}
        free = [s for s in free if s not in over]
    target |= {s: rest * weight[s] / sum(weight[t] for t in free) for s in free}
    for s in size:
        mine = [r for r in rows if r["_doc"]["source"] == s]
        assert all(abs(r["target"] - target[s]) < 1e-6 and r["source_size"] == size[s] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= 0.5
    assert all(0 <= r["taken"] <= 3 * r["size"] == 3 * len((r["_doc"]["text"] or "").encode().split()) for r in rows)
    assert all(0 <= u["position"] <= 1 for r in rows for u in r["occurrences"])
    order = mixing.training_order(docs)
    assert order.columns == docs.columns
    assert sum(len(r["text"].split()) for r in order.collect()) == sum(r["taken"] for r in rows)
    assert mixing.training_order(empty).count() == 0


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(i, k % 2) for k, (i, _) in enumerate(TEXTS)], "doc_id long, quality int")
    features = quality.vectors(docs)
    got = quality.scored(features, quality.fit(features, labels)).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    nothing = labels.limit(0)
    assert {r["score"] for r in quality.scored(features, quality.fit(features, nothing)).collect()} == {0.5}
    assert quality.keep_good(docs, nothing).count() == len(ROWS) and quality.keep_good(empty, labels).count() == 0


def test_quality_held_out(spark):
    got = {r["doc_id"]: r for r in quality.op1_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    known = [(got[r["doc_id"]], r["quality"]) for r in labels if got[r["doc_id"]]["held_out"]]
    good, bad = [g["score"] for g, q in known if q], [g["score"] for g, q in known if not q]
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    assert np.mean([g["predicted"] == q for g, q in known]) > 0.95


def test_urls(spark):
    urls = [None, "", "a.com/x", "http://A.COM/x?y", "http://com/", "http://com", "http://xcom/", "http://www.example.com/en/1",
            "http://b.www.example.com/en/", "http://m.example.com/en/?q", "http://example.com/en", "x://y://net/fr/", "http://a.net/fr/#",
            "http://net/es/", "http://net#/es/", "http://日本.net/es/語", "://", "http:///en/"] * 2
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, keys string")

    def judge(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match("[^/?#]*", rest).group()
        path = re.match("[^?#]*", rest[len(host):]).group()
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES
                if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[1:] if fits else (None, "allow")))

    same(url_filter.judged(pages), [(i, *judge(u)) for i, u in enumerate(urls)])
    same(url_filter.judged(pages, rules=()), [(i, *judge(u)[:2], None, "allow") for i, u in enumerate(urls)])
    assert url_filter.judged(pages.limit(0)).count() == 0


def test_cascade_is_exact(spark):
    keys = [f"k{i}" for i in range(3000)]
    listed, others = (spark.createDataFrame([(k,) for k in ks], "key string") for ks in (keys[:900], keys[900:]))
    filters = url_filter.cascade(listed, 900, others, 2100)
    assert len(filters) > 1
    cols = [c for level in range(len(filters)) for c in url_filter._hashes("key", level)]
    got = listed.union(others).select(*cols).collect()
    pairs = [tuple(np.array([r[2 * k + j] for r in got]).view(np.uint64) for j in (0, 1)) for k in range(len(filters))]
    assert url_filter.member(filters, pairs).tolist() == [True] * 900 + [False] * 2100


def test_packing(docs, empty):
    got = packing.pack(docs, limit=64).collect()
    coder = tokens.encoder(tokens.default_tokenizer()).tokenizer
    want = []
    for i, t in TEXTS:
        ids = np.array([*coder.encode(t.decode(), add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % 64 or 64, len(ids), 64), len(ids)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(map(repr, (tuple(r)[:5] for r in got))) == sorted(map(repr, want))
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= 64
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_sweep_is_best_fit(seed):
    rng = random.Random(seed)
    lengths = sorted((rng.randint(1, 100) for _ in range(400)), reverse=True)
    gaps = []
    for n in lengths:  # one document at a time
        fit = [k for k in range(len(gaps)) if gaps[k] >= n]
        if fit:
            gaps[min(fit, key=lambda k: gaps[k])] -= n
        else:
            gaps.append(100 - n)
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.sweep(counts, 100)
    assert 1 + max(p[2] for p in plan) <= len(gaps) + 1 and len(gaps) <= 1.1 * sum(lengths) / 100 + 2


def test_token_counts(docs, empty):
    lengths = tokens.token_lengths(docs)
    n = [r["n_tokens"] for r in lengths.collect()]
    got = {r["length"]: r for r in tokens.length_histogram(lengths).collect()}
    assert set(got) == set(n)
    for size, r in got.items():
        assert r["n_docs"] == n.count(size) and r["docs_up_to"] == sum(x <= size for x in n)
        assert r["tokens_up_to"] == sum(x for x in n if x <= size) and r["truncated_total"] == sum(min(x, size) for x in n)
    assert tokens.length_histogram(tokens.token_lengths(empty)).count() == 0


def test_encoder_equals_whole_encoding():
    rng, e = random.Random(1), tokens.Encoder(tokens.default_tokenizer())
    odd = ["".join(rng.choice(["a", "b", " ", "\n", ",", ".", "é", "1", "'s", " ", "!", "\t", "<|endoftext|>"])
                   for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    odd += [f"a{c}b 1{c}2 .{c}. {c}{c} x" for c in map(chr, range(0x30000)) if not 0xD800 <= ord(c) < 0xE000]
    odd += [" " * 1_000_000 + "x", "\n" * 1_000_000, "a" * 50_000]
    whole = [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(odd, add_special_tokens=False)]
    assert e.encode(odd) == whole


def plain_fingerprint(t):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in t).split()
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("crowd", [simhash.CROWD, 2])
def test_simhash(docs, empty, crowd):
    fps = [plain_fingerprint(t) for _, t in TEXTS]
    pairs = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2]
    comp = reach([i for i, _ in TEXTS], pairs)
    same(simhash.near_duplicates(docs, crowd=crowd), [(i, format(f, "016x"), c) for (i, _), f, c in zip(TEXTS, fps, comp)])
    left = simhash.keep_one(docs)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == set(comp)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("parts", [None, [(list(range(32)), 1), (list(range(32, 64)), 0)], [(list(range(64)), 2)]])
def test_simhash_links(spark, parts):
    rng, fps = random.Random(3), []
    for _ in range(40):
        f = rng.getrandbits(64)
        fps += [f, f ^ 1 << rng.randrange(64), f ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64), f ^ rng.getrandbits(64)]
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    want = {(a, b) for a in fps for b in fps if a > b and ((a ^ b) % (1 << 64)).bit_count() <= 2}
    got = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), parts=parts)
    assert {tuple(r) for r in got.collect()} == want


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(50, 60), (60, 55), (70, 70)]
    got = {tuple(r) for r in components.components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert got == {(k, 0) for k in range(31)} | {(50, 50), (60, 50), (55, 50)}


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    vectors = [rng.standard_normal(8).tolist() for _ in range(60)]
    vectors += [(np.array(vectors[k % 3]) + 0.05 * rng.standard_normal(8)).tolist() for k in range(40)]
    vectors += [vectors[0]] * 5 + [(2 * np.array(vectors[1])).tolist(), None, [], [0.0] * 8, [float("nan")] * 8,
                                   [None] + [1.0] * 7, [float("inf")] + [0.0] * 7, [1.0, 0.0], [1.0, 0.01]]
    rows = [(i, v, "x") for i, v in enumerate(vectors)]

    def unit(v):
        ok = v and None not in v and np.isfinite(v).all() and any(v)
        return np.array(v) / np.linalg.norm(v) if ok else None

    u = [unit(v) for v in vectors]
    pairs = [(a, b) for a in range(len(u)) for b in range(len(u)) if a != b and u[a] is not None and u[b] is not None
             and len(u[a]) == len(u[b]) and u[a] @ u[b] >= 0.95]
    comp = reach(list(range(len(u))), pairs)
    want = [(i, sum(a == i for a, _ in pairs), comp[i], comp[i] == i) for i in range(len(u))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, u string")
    same(embedding_dedup.near_duplicates(df, length=4, tile=16), want)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def brute_force_links(vectors):
    """n_links, component and kept of each vector, all of one length."""
    u = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    comp = reach(list(range(len(u))), list(zip(*map(list, np.nonzero(near)))))
    return [(i, int(near[i].sum()), comp[i], comp[i] == i) for i in range(len(u))]


def test_embeddings_in_two_tight_groups(spark):
    """Groups larger than a list, with links between them that no list has room for."""
    rng = np.random.default_rng(7)
    a, b = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
    b = 0.96 * a + (1 - 0.96 ** 2) ** 0.5 * b
    vectors = [c + 0.001 * rng.standard_normal(64) for c in (a, b) for _ in range(40)]
    vectors += list(rng.standard_normal((200, 64)))
    want = brute_force_links(vectors)
    assert want[0][1] == 79
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    same(embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), want)


def test_embeddings_with_rare_links(spark):
    """Isolated near pairs among unrelated vectors; first lists and audit must find them."""
    rng = np.random.default_rng(9)
    vectors = list(rng.standard_normal((3000, 64)))
    for k in range(12):
        side = rng.standard_normal(64)
        vectors.append(vectors[k] / np.linalg.norm(vectors[k]) + 0.3 * side / np.linalg.norm(side))
    want = brute_force_links(vectors)
    assert sum(w[1] for w in want) >= 20
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    points = embedding_dedup.nodes(df)[1]
    assert embedding_dedup.true_links(points, 0.95, 100)[1] == sum(w[1] for w in want)  # not those of 100 nodes only
    same(embedding_dedup.near_duplicates(df), want)


def test_embedding_orders_follow_the_size():
    few, many = (embedding_dedup.orders_for(n, 0.95) for n in (5_000, 5_000_000))
    assert many[0] > few[0] + 8 and many[1] > few[1]


def test_embeddings_fail_when_recall_stays_short(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "_recall", lambda *a: 0.5)
    monkeypatch.setattr(embedding_dedup, "ATTEMPTS", 1)
    df = spark.createDataFrame([(i, [1.0, 0.01 * i]) for i in range(5)], "vec_id long, embedding array<double>")
    with pytest.raises(RuntimeError, match="recall"):
        embedding_dedup.near_duplicates(df)


def removed(units_of, hide):
    """Brute force: units covered by a window that starts in a row with a smaller identifier."""
    first, out = {}, []
    for i, t in TEXTS:
        u = units_of(t)
        for k in range(len(u) - 49 if i is not None else 0):
            key = tuple(u[k:k + 50])
            first[key] = min(first.get(key, i), i)
    for i, t in TEXTS:
        u = units_of(t)
        gone = [False] * len(u)
        for k in range(len(u) - 49 if i is not None else 0):
            if first[tuple(u[k:k + 50])] < i:
                gone[k:k + 50] = [True] * 50
        out.append(hide(i, u, gone))
    return out


def test_substrings(docs, empty):
    want = removed(bytes.split, lambda i, u, g: (i, len(u), sum(g), hashlib.sha256(
        b" ".join(w for w, x in zip(u, g) if not x)).hexdigest()))
    assert sum(w[2] for w in want) > 200
    same(substring_dedup.substring_dedup(docs), want)
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_suffixes(docs, empty):
    want = removed(bytes, lambda i, u, g: (i, len(u), sum(g), sum(a and not b for a, b in zip(g, [False, *g])),
                                           hashlib.sha256(bytes(c for c, x in zip(u, g) if not x)).hexdigest()))
    same(suffix_dedup.suffix_dedup(docs), want)
    assert suffix_dedup.suffix_dedup(empty).count() == 0


@pytest.mark.parametrize("hot", [1, 40])
def test_suffixes_of_a_frequent_anchor(spark, docs, monkeypatch, hot):
    """Runs of frequent anchors are taken apart: no key but a few rows for each task, and the same result."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "SAMPLE", 1)
    test_suffixes(docs, docs.limit(0))
    rng = random.Random(4)
    noise = lambda: "".join(rng.choice("abcdefgh") for _ in range(30))
    line = "one line of more than fifty bytes that many documents have, " * 2
    texts = [noise() + line + noise() for _ in range(300)]
    many = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sent = []

    def spread(df):
        rows = [suffix_dedup._unpack(zstandard.ZstdDecompressor(), r["packed"]) for r in df.where("not known").collect()]
        sent.append(np.unique(np.concatenate([columns[0] for columns, _ in rows]), return_counts=True)[1].max())

    frame = type(many)
    plain = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, *a: (spread(self) if "packed" in self.columns else None, plain(self, *a))[1])
    first, want = {}, {}
    for i, t in enumerate(texts):
        lost = [first.setdefault(t[k:k + 50], i) < i for k in range(len(t) - 49)]
        gone = [any(lost[max(0, c - 49):c + 1]) for c in range(len(t))]
        want[i] = sum(gone)
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.suffix_dedup(many).collect()}
    assert got == want
    assert max(sent) <= 30


def test_many_buckets_and_groups(docs, monkeypatch):
    """Sizes that follow the texts: the same results with as many buckets as there are lines of text."""
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 1 << 9)
    monkeypatch.setattr(windows, "GROUP_BYTES", 1 << 6)
    assert windows.dealt_bits(1 << 16) == 10 and windows.dealt_bits(0) == windows.DEALT
    test_suffixes(docs, docs.limit(0))
    test_substrings(docs, docs.limit(0))


def test_suffix_order():
    rng = random.Random(2)
    raw = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 50))) for _ in range(300)]
    b, n = np.frombuffer(b"".join(raw) + b"z", np.uint8), np.array([len(r) for r in raw])
    group = np.sort(np.array([rng.randrange(9) for _ in raw]))
    s = suffix_dedup.Suffixes(b, np.cumsum(n) - n, n, suffix_dedup._powers(suffix_dedup._BASE, len(b)))
    for order in (s.order(group), s.verified(np.argsort(group, kind="stable"), group)):  # the second is mended
        assert [(group[k], raw[k]) for k in order] == sorted((g, r) for g, r in zip(group, raw))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r["doc_id"]: r["text"] for r in corpus_pipeline.good_documents(spark, docs, SF).collect()}
    firsts = {}
    for i in sorted(good):
        firsts.setdefault(re.sub(r"[ \t-\r]+", " ", good[i]), i)
    one = sorted(firsts.values())
    fps = [plain_fingerprint(good[i].encode()) for i in one]
    comp = reach(one, [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])
    left = {i for i, c in zip(one, comp) if i == c}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} <= left
    kept = docs.where(docs.doc_id.isin(list(left)))
    mix = mixing.training_order(kept)
    coder = tokens.encoder(tokens.default_tokenizer()).tokenizer
    assert sum(r["length"] for r in got) == sum(len(coder.encode(r["text"]).ids) + 1 for r in mix.collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    assert differences(spark, con, queries.QUERIES[name], queries.ORACLES[name], SF)[0] == ""
