"""Brute-force comparisons and odd inputs for the operators of the llm subpackage."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tabsieve.llm import ann, bpe, chat_format, exact_dedup, langid, license_scan, packing, simhash, toxicity, warc
from tabsieve.llm import queries as q

from ..conftest import SF
from ..duck import rows_equal

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, fingerprint string, _gone int"
ODD = [
    (1, "a b  c\td", "en", "s", 1, "x", "y", 1),
    (2, "a b c d", "en", "s", 1, "x", "y", 1),
    (2, "a b c d", "en", "s", 1, "x", "y", 1),
    (3, None, None, None, None, None, None, None),
    (4, "", "de", "s", 1, "x", "y", 1),
    (5, " \n ", "de", "s", 1, "x", "y", 1),
    (None, "a b c d", "en", "s", 1, "x", "y", 1),
    (6, "word " * 30_000, "en", "s", 1, "x", "y", 1),
    (7, "123 !!", "en", "s", 1, "x", "y", 1),
    (8, "İΣ\x00é", "fr", "s", 1, "x", "y", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", [n for n in q.SQL])
def test_equals_sql(spark, name):
    rows_equal(spark, q.QUERIES[name], q.SQL[name], SF)


# exact dedup


def test_exact_groups(spark, odd, none):
    got = exact_dedup.exact_groups(odd.repartition(5), fan_in=2).collect()
    by: dict = {}
    for r in ODD:
        by.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), []).append(r[0])
    assert len(got) == len(ODD)
    for norm, ids in by.items():
        rows = [r for r in got if r.text_sha256 == hashlib.sha256(norm.encode()).hexdigest()]
        least = min(i for i in ids if i is not None)
        assert len(rows) == len(ids) and all(r.keep_id == least and r.group_size == len(ids) for r in rows)
        assert sum(r.kept for r in rows) == 1 and next(r.doc_id for r in rows if r.kept) == least
    assert exact_dedup.exact_groups(none).count() == 0
    kept = exact_dedup.deduplicate(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 6, 7, 8]
    assert sorted(r.doc_id for r in exact_dedup.deduplicate(odd.filter("doc_id = 2")).collect()) == [2]


@pytest.mark.parametrize("parts,fan_in", [(1, 4), (7, 2), (13, 4), (32, 16)])
def test_exact_groups_of_many_runs(spark, parts, fan_in):
    rng = random.Random(parts)
    rows = [(rng.randrange(500), rng.choice(["hot", *[f"t{i} x" for i in range(60)], f"single{i}"]).replace(" ", rng.choice([" ", "\n"]))) for i in range(600)]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), fan_in=fan_in).collect()
    by: dict = {}
    for d, t in rows:
        by.setdefault(hashlib.sha256(t.replace("\n", " ").encode()).hexdigest(), []).append(d)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == sorted((d, min(ids), len(ids), h) for h, ids in by.items() for d in ids)
    kept = [(r.doc_id, r.text_sha256) for r in got if r.kept]
    assert sorted(kept) == sorted((min(ids), h) for h, ids in by.items())


def test_exact_rounds_exchange_sorted_runs(spark):
    """A round is one exchange by run number, and the merge needs no other."""
    e = spark.createDataFrame([(0, b"1", 1, 1, (False, 1, 1), 1)], "run int, digest binary, n_bytes long, check long, head struct<no_id:boolean,doc_id:long,row:long>, size long")
    plan = exact_dedup.merge(exact_dedup.exchange(e, 8, F.col("run").bitwiseAND(3)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1 and "SortAggregate" in plan


# SimHash


def brute_fingerprint(text):
    toks = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not toks:
        return 0
    grams = [b" ".join(toks[i : i + 3]) for i in range(max(1, len(toks) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius=2):
    up = list(range(len(ids)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            up[top(i)] = top(j)
    least = {}
    for i, d in enumerate(ids):
        least[top(i)] = min(least.get(top(i), d), d)
    return [least[top(i)] for i in range(len(ids))]


def test_simhash_documents(spark, odd, none):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_groups(odd).collect()}
    for r in ODD:
        assert (r[0], f"{brute_fingerprint(r[1]):016x}") in got
    assert got[(5, "0" * 16)] == 3
    assert simhash.near_groups(none).count() == 0
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns and 3 in [r.doc_id for r in kept.collect()] and 5 not in [r.doc_id for r in kept.collect()]


def test_simhash_dedup_is_by_row(spark):
    rng = random.Random(8)
    base = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 5) for _ in range(60)) for _ in range(5)]
    near = [b.replace(" ", "  ", 3) for b in base]  # another text, the same fingerprint
    a, b, c, d, e = range(5)
    rows = [(5, base[a]), (5, base[b]), (3, near[b]), (1, base[c]), (1, near[c]), (None, base[d]), (None, near[d]), (None, base[e]), (9, near[e]), (7, "x y"), (7, "x y")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, _gid int")
    got = simhash.deduplicate(df.repartition(3))
    found = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    dig = lambda t: hashlib.sha256(t.encode()).digest()
    want = [(5, base[a]), (3, near[b]), (1, min(base[c], near[c], key=dig)), (None, min(base[d], near[d], key=dig)), (9, near[e]), (7, "x y")]
    assert got.columns == df.columns and found == sorted(want, key=str)


def brute_similar(texts, radius=8, similarity=0.8):
    """The number of each text's group: components of the pairs within the radius whose 5-word shingles are similar."""
    fps = [brute_fingerprint(t) for t in texts]
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    up = list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
            a, b = sorted((top(i), top(j)))
            up[b] = a
    return [top(i) for i in range(len(texts))]


@pytest.mark.parametrize("max_shard,block", [(1024, 2048), (4, 3)])
def test_near_dedup_against_brute_force(spark, max_shard, block):
    rng = random.Random(max_shard)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 6))) for _ in range(300)]
    rows = []
    for g in range(14):
        base = [rng.choice(words) for _ in range(rng.choice([3, 40, 150, 400]))]
        for _ in range(rng.choice([1, 2, 5, 14])):
            t = list(base)
            for _ in range(rng.randrange(0, 1 + len(t) // 40)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((rng.randrange(60), rng.choice([" ", "  "]).join(t)))
    rows += [(None, rows[0][1]), (None, None), (2, ""), (3, " "), (4, "x"), (4, "x"), (5, "X")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, node int")
    group = brute_similar([t for _, t in rows])
    order = lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).digest())
    want = [min((r for r, h in zip(rows, group) if h == g), key=order) for g in set(group)]
    got = simhash.deduplicate(df.repartition(5), max_shard=max_shard, block=block)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text or "") for r in got.collect()), key=str) == sorted(((d, t or "") for d, t in want), key=str)
    assert len(want) < len(rows) - 20


def test_forest_finds_all_earlier_neighbours():
    rng = np.random.default_rng(0)
    for radius in (0, 2, 8):
        sizes = rng.integers(1, 60, 30)
        starts = np.cumsum(sizes) - sizes
        v = rng.integers(0, 2**63, 5).astype(np.uint64)[rng.integers(0, 5, sizes.sum())]
        for _ in range(6):
            v = v ^ (np.uint64(1) << rng.integers(0, 64, len(v)).astype(np.uint64))
        v[3] = v[2]
        got = {x for part in simhash.Forest(v, starts).earlier(radius) for x in zip(*(p.tolist() for p in part))}
        pairs = [(i, j, int(np.bitwise_count(v[i] ^ v[j]))) for s, n in zip(starts.tolist(), sizes.tolist()) for i in range(s, s + n) for j in range(s, i)]
        assert got == {p for p in pairs if p[2] <= radius}


def test_simhash_query(spark):
    import duckdb

    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    fps = [brute_fingerprint(t) for _, t in docs]
    want = {(d, f"{f:016x}", c) for (d, _), f, c in zip(docs, fps, brute_components([d for d, _ in docs], fps))}
    assert {tuple(r) for r in q.QUERIES["op10_simhash"](spark, SF).select("doc_id", "fingerprint", "component_id").collect()} == want


@pytest.mark.parametrize("max_shard", [16, 1024])
def test_simhash_search_loses_no_link(spark, max_shard):
    rng = random.Random(max_shard)
    fps = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(40):
            x = base
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    dealt = simhash.shards(nodes, max_shard=max_shard).repartition(3, "mask", "val").sortWithinPartitions("mask", "val", "fp")
    star = {r.u: r.v for r in simhash.components(dealt.mapInPandas(simhash._link_shards, "u long, v long")).collect()}
    ids = [simhash._signed(f) for f in fps]
    assert [star.get(i, i) for i in ids] == brute_components(ids, fps)


# packing


def test_packing(spark, odd, none):
    rng = random.Random(5)
    rows = [(i, "w " * rng.choice([0, 1, 3, 7, 19, 45, 120]) + str(i % 40), "en", "hot" if i % 3 == 0 else f"s{i % 7}", 0, "", "", 0) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS)
    got = packing.pack(docs, capacity=50, block=200).collect()
    source = {r[0]: r[3] for r in rows}
    text = {r[0]: r[1] for r in rows}
    by_doc, by_bin = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.bin_id, []).append(r)
    assert set(by_doc) == set(source)
    for d, ps in by_doc.items():
        ps.sort(key=lambda p: p.piece)
        assert sum(p.piece_tokens for p in ps) == ps[0].n_tokens == len(text[d].split())
        assert [p.piece_start for p in ps] == [50 * i for i in range(len(ps))]
    for ps in by_bin.values():
        assert sum(p.piece_tokens for p in ps) == ps[0].bin_tokens <= 50
        assert len({source[p.doc_id] for p in ps}) == len(ps) == len({text[p.doc_id] for p in ps})
    assert sorted(map(tuple, packing.pack(docs.repartition(7), capacity=50, block=200).collect())) == sorted(map(tuple, got))
    assert {r.doc_id for r in packing.pack(odd).collect()} == {r[0] for r in ODD}
    assert packing.pack(none).count() == 0


def brute_pack(rows, capacity):
    """One block, by the rule as it is worded: (doc_id, piece, start, tokens, bin tokens) and which share a bin."""
    often = {}
    for _, _, s, c in rows:
        often[s], often[c] = often.get(s, 0) + 1, often.get(c, 0) + 1
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3], r[2]))
    bins, out = [], []
    for d, n, s, c in sorted(rows, key=lambda r: -(r[1] % capacity)):
        for p in range(n // capacity):
            out.append((d, p, p * capacity, capacity, len(bins)))
            bins.append([0, {s, c}])
        if n % capacity or n == 0:
            fits = [(b[0], i) for i, b in enumerate(bins) if b[0] >= n % capacity and s not in b[1] and c not in b[1] and i in {o[4] for o in out if o[3] < capacity}]
            i = min(fits)[1] if fits else len(bins)
            if not fits:
                bins.append([capacity, set()])
            bins[i][0] -= n % capacity
            bins[i][1] |= {s, c}
            out.append((d, n // capacity, n // capacity * capacity, n % capacity, i))
    full = {}
    for o in out:
        full.setdefault(o[4], []).append(o)
    return sorted((sum(o[3] for o in os), sorted((o[0], *o[1:4]) for o in os)) for os in full.values())


def test_packing_query_against_brute_force(spark):
    """The registered query over a table that one block holds."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert docs.count() < packing.BLOCK
    keys = docs.select("doc_id", packing.word_count(F.col("text")).alias("n"), F.xxhash64(F.coalesce("source", F.lit("\0"))).alias("s"), packing.text_cluster(F.col("text")).alias("c"))
    want = brute_pack([tuple(r) for r in keys.collect()], packing.CAPACITY)
    by_bin = {}
    for r in q.QUERIES["op2_best_fit_packing"](spark, SF).collect():
        by_bin.setdefault(r.bin_id, []).append(r)
    got = sorted((rs[0].bin_tokens, sorted((r.doc_id, r.piece, r.piece_start, r.piece_tokens) for r in rs)) for rs in by_bin.values())
    assert got == want


@pytest.mark.parametrize("hot", [7, None])
def test_packing_spreads_a_hot_id(spark, hot):
    """Rows of one id, and rows equal in everything, come to all blocks alike."""
    rows = [(hot, "a b c", "s") for _ in range(900)] + [(hot, f"x{i}", "s") for i in range(900)] + [(i, "q", "t") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", F.lit(1).alias("block"), F.lit(2).alias("copies"), F.lit("x").alias("n_tokens"), F.lit("x").alias("cluster"))
    got = packing.pack(docs.repartition(3), block=250).collect()
    sizes = {}
    for r in got:
        sizes[r.bin_id >> 40] = sizes.get(r.bin_id >> 40, 0) + 1
    assert len(sizes) == 8 and max(sizes.values()) < 350 and len(got) == len(rows)


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = random.Random(2)
    pieces = sorted(((rng.randrange(1, 60), rng.randrange(-1, 6), rng.randrange(-1, 9)) for _ in range(400)), reverse=True)
    bins: list = []
    want = []
    for t, s, c in pieces:
        fits = [(b[0], i) for i, b in enumerate(bins) if b[0] >= t and (s < 0 or s not in b[1]) and (c < 0 or c not in b[2])]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([100, set(), set()])
        bins[i][0] -= t
        bins[i][1].add(s)
        bins[i][2].add(c)
        want.append(i)
    assert packing.best_fit(pieces, 100) == want


# WARC


def _ids(folder):
    import gzip
    import pathlib

    raw = b"".join(gzip.decompress(p.read_bytes()) for p in pathlib.Path(folder).iterdir())
    return re.findall(rb"WARC-Record-ID: (\S+)", raw), re.findall(rb"WARC-Refers-To: (\S+)", raw)


@pytest.mark.parametrize("from_parquet", [True, False])
def test_warc(spark, tmp_path, from_parquet):
    dup, short, long = "é" * 60, "s" * 99, "l" * 100
    pages = [(3, "http://a/\r\nx", dup, 1), (1, None, dup, 1), (2, "u", "", 1), (4, "u", None, 1), (None, "u", dup, 1), (9, "u", "x" * 300_000, 1), (1, None, dup, 1)]
    pages += [(20 + i, "u", t, 1) for i, t in enumerate((short, short, long, long))] + [(None, "n", "only without an id " * 9, 1)] * 3
    df = spark.createDataFrame(pages, "page_id long, url string, html string, file int").repartition(4)
    if from_parquet:
        df.write.parquet(str(tmp_path / "pages"))
        df = spark.read.parquet(str(tmp_path / "pages"))
    folder = str(tmp_path / "w")
    index = warc.write_archives(df, folder)
    got = warc.read_records(index, folder, with_payload=True).collect()
    assert len(got) == len(pages) and index.count() == len(pages)
    dig = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    found = sorted((r.page_id or 0, r.payload_digest, r.payload_bytes, r.record_type, r.refers_to or 0, r.payload or "") for r in got)
    first, want = {}, []
    for p, _, t, _ in sorted(pages, key=lambda r: (r[0] is None, r[0] or 0)):
        t = t or ""
        again = len(t.encode()) >= 100 and t in first
        want.append((p or 0, dig(t), len(t.encode()), "revisit" if again else "response", first[t] or 0 if again else 0, "" if again else t))
        first.setdefault(t, p)
    assert found == sorted(want)
    assert next(r.url for r in got if r.page_id == 3) == "http://a/%0D%0Ax"
    some = warc.read_records(index.filter("page_id in (2, 9)"), folder)
    assert sorted(r.page_id for r in some.collect()) == [2, 9]
    ids, refers = _ids(folder)
    assert len(set(ids)) == len(ids) == len(pages) and set(refers) <= set(ids) and len(refers) == 6
    assert warc.archive_and_read(spark, df.limit(0)).count() == 0


def test_warc_shuffles_no_payload(spark, tmp_path):
    plan = warc._placed(spark.read.parquet(f"{SF}/pages.parquet")).mapInPandas(warc._writer("x", "y"), warc.INDEX)._jdf.queryExecution().toString()
    assert "Exchange" not in plan


def test_warc_ranges():
    assert warc.ranges([0, 10, 50, 200], [10, 10, 10, 5], most=60, gap=30) == [(0, 3, 0, 60), (3, 4, 200, 5)]
    assert warc.ranges([], []) == []
    with pytest.raises(ValueError):
        warc.parse(warc.record(1, "u", b"abc", "0" * 64, "f#0"))


# language


def test_forward_backward():
    rng = np.random.default_rng(0)
    for k in (1, 2, 4):
        sizes = rng.integers(1, 80, 6)
        e, a = rng.normal(size=(sizes.sum(), k)) * 2, rng.normal(size=(k, k))
        got, at = langid.marginals(e, sizes, a, chunk=7), 0
        for n in sizes:
            x, m = np.exp(e[at : at + n]), np.exp(a)
            f, b = [x[0]], [np.ones(k)]
            for t in range(1, n):
                f.append((f[-1] / f[-1].sum() @ m) * x[t])
            for t in range(n - 1, 0, -1):
                b.append(m @ (b[-1] / b[-1].sum() * x[t]))
            p = np.array(f) * np.array(b[::-1])
            assert np.allclose(got[at : at + n], p / p.sum(axis=1, keepdims=True))
            at += n


def test_language_held_out(spark):
    sf = SF.replace("0.001", "0.01")
    got = q.QUERIES["op4_language_id"](spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in got.collect())


def test_language_switches_within_a_text():
    model = langid.train([("the of and with this " * 20 + str(i), "en") for i in range(9)] + [("der die und nicht ist " * 20 + str(i), "de") for i in range(9)])
    p = langid.Labeller(model).words([langid.words_of("the of and with this der die und nicht ist")])[0]
    assert model["labels"] == ["de", "en"]
    assert p.argmax(axis=1).tolist() == [1] * 5 + [0] * 5


def test_language_keeps_texts_that_switch(spark):
    text = {"en": "the of and with this", "de": "der die und nicht ist", "fr": "le la et dans pour", "da": "det som og ikke har"}
    rows = [(i, f"{text[y]} " * 20, y) for i, y in enumerate(list(text) * 15)]
    rows += [(1000, " ".join(f"{t} " * 9 for t in text.values()), None), (1001, "", None), (1002, "12 ?", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    score = {r.doc_id: r.score for r in langid.identify(docs).collect()}
    assert score[1000] < 0.4
    assert {r.doc_id for r in langid.keep_identified(docs).collect()} == {i for i, *_ in rows} - {1001, 1002}


def test_language_odd(spark, odd, none):
    got = {r.doc_id: r for r in langid.identify(odd).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (3, 4, 5, 7))
    assert 0 <= got[6].score <= 1 and got[6].lang_pred != "und" and got[None].held_out is False
    assert langid.identify(none).count() == 0
    assert langid.keep_identified(odd).columns == odd.columns
    assert {r.lang_pred for r in langid.identify(odd.filter("lang is null")).collect()} == {"und"}


def test_language_with_a_label_without_words(spark):
    text = {"en": "the of and with this", "de": "der die und nicht ist", "fr": "le la et dans pour", "zxx": "12 345 -- 6"}
    rows = [(i, f"{text[y]} " * 20, y) for i, y in enumerate(list(text) * 15)]
    rows.append((1001, "7 " * 30_000 + "det som og ikke har " * 4, "da"))  # most windows hold no letter
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert all(got[i].lang_pred == ("und" if y == "zxx" else y) for i, _, y in rows)
    assert {r.doc_id for r in langid.keep_identified(docs).collect()} == {i for i, _, y in rows if y != "zxx"}


# toxicity


def test_toxicity_held_out(spark):
    """The registered query, on rows that were not learned from."""
    sf = SF.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = q.QUERIES["op7_toxicity"](spark, sf).join(labels, "doc_id").filter("held_out").collect()
    pos, neg = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert np.mean([a > b for a in pos for b in neg]) > 0.93
    caught = sum(x >= 0.5 for x in pos)
    assert caught / len(pos) > 0.75 and caught / (caught + sum(x >= 0.5 for x in neg)) > 0.75


def test_toxicity_score_is_the_mean_of_vectors_through_a_softmax():
    """Scores by numbers per word equal the definition: mean of the words' mean vectors, then a linear layer."""
    rng = np.random.default_rng(3)
    table, bias = rng.normal(size=toxicity.BUCKETS), 0.3
    texts = ["One two two THREE", "a é 中文 b", "", "42", "x" * 500]
    want = []
    for t in texts:
        words = [w for w in re.findall(r"[^\W\d_]+", t.lower())]
        means = [np.mean([table[b] for b in toxicity.subwords([w])[0]]) for w in words]
        want.append(1 / (1 + np.exp(-((np.mean(means) if means else 0.0) + bias))))
    assert np.allclose(toxicity.Scorer({"table": table, "bias": bias, "const": None}).scores(texts), want)


def test_samples_are_bounded_where_ids_repeat(spark):
    hot = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5)
    docs = spark.createDataFrame([(hot, f"word{i} of the text", "en") for i in range(900)] + [(i, "der die und", "de") for i in range(1000, 1040)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(hot, 1), (hot, 0), *[(i, 0) for i in range(1000, 1040)]], "doc_id long, toxic int")
    seen = {}
    for name, fit, module in (("lang", lambda: langid.fit(docs), langid), ("toxic", lambda: toxicity.fit(docs, labels), toxicity)):
        train = module.train
        module.train = lambda rows, name=name: seen.setdefault(name, rows)
        try:
            fit()
        finally:
            module.train = train
    assert sorted(y for _, y in seen["lang"]) == sorted(["de"] * sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(1000, 1040)) + ["en"])
    assert sum(y for _, y in seen["toxic"]) == 1


def test_toxicity_of_a_misspelling():
    rows = [(f"good day to all of you friend {w}", 0) for w in "abcdefghij" for _ in range(20)] + [(f"good day to all of you moron {w}", 1) for w in "abcdefghij" for _ in range(20)]
    s = toxicity.Scorer(toxicity.train(rows, steps=200)).scores(["good day to all of you moronn", "good day to all of you friend", "", None])
    assert s[0] > 0.5 > s[1] and s[2] == s[3]


def test_toxicity_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    for d in (odd, none):
        got = toxicity.rate(d, labels).collect()
        assert len(got) == d.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert {r.score for r in toxicity.rate(odd, labels.limit(0)).collect()} == {0.0}
    assert toxicity.keep_clean(odd, labels.limit(0)).columns == odd.columns


# BPE


def test_bpe_equals_the_library(spark, odd, none):
    from tokenizers import Tokenizer

    file = bpe.public_file("word_bpe_49k.json")
    t, e, rng = Tokenizer.from_str(file), bpe.Encoder(file), random.Random(3)
    letters = list("abcdefghijklmnopqrstuvwxyz" * 2 + "aaabb  \n'’.,!0123ÀÉßΣσςİ½²中文👩‍́\x1c\x85՘Ᲊ<|>")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(4000)]
    texts += ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 40))) for _ in range(500)]
    texts += ["<|endoftext|>", "a<|endoftext|>b<|startoftext|>", "", "aaaa" * 3000, "I'LL they're"]
    for text, ids in zip(texts, e.encode_batch(texts)):
        want = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert e.decode(ids).decode() == t.decode(want, skip_special_tokens=False)
    some = [rng.randrange(49_000) for _ in range(500)]  # ids that no text gave
    assert e.decode(np.array(some, "<u4").tobytes()).decode() == t.decode(some, skip_special_tokens=False)
    got = {r.doc_id: r for r in bpe.encode(odd, file).collect()}
    assert got[3].n_tokens == 0 and got[3].ids_sha256 == got[3].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    for r in ODD:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        assert got[r[0]].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert bpe.encode(none, file).count() == 0


def test_bpe_query_against_the_library(spark):
    """The registered query; and the decoded digest follows the ids, not the text."""
    from tokenizers import Tokenizer

    file = bpe.public_file("word_bpe_49k.json")
    t = Tokenizer.from_str(file)
    t.no_truncation()
    t.no_padding()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = {tuple(r) for r in q.QUERIES["op5_bpe"](spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want.add((r.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False).encode())))
    assert got == want
    e, text = bpe.Encoder(file), "what is said follows the ids"
    (ids,) = e.encode_batch([text])
    other = np.frombuffer(ids, "<u4")[::-1].tobytes()
    assert e.decode(other) != e.decode(ids) and e.decode(other).decode() == t.decode(np.frombuffer(other, "<u4").tolist(), skip_special_tokens=False)


def test_bpe_lower_rank_made_by_a_merge():
    import json

    merges = [("b", "c"), ("x", "y"), ("abc", "d</w>"), ("a", "bc")]
    chars = bpe.byte_characters()
    names = [*chars, *[c + "</w>" for c in chars], *[a + b for a, b in merges]]
    spec = {
        "model": {"type": "BPE", "end_of_word_suffix": "</w>", "vocab": {n: i for i, n in enumerate(names)}, "merges": [list(m) for m in merges]},
        "normalizer": {"normalizers": [{"type": "NFC"}, {"type": "Replace"}, {"type": "Lowercase"}]},
        "pre_tokenizer": {"pretokenizers": [{"type": "Split", "pattern": {"Regex": r"\S+"}}, {"type": "ByteLevel"}]},
        "decoder": None,
        "added_tokens": [],
    }
    voc = bpe.Vocabulary(json.dumps(spec))
    words = ["abcd", "abcabcd", "xyabcd", "abc", "d"]
    ids, count = bpe.merge_words(voc, words)
    want = [bpe.merge_one(voc, w.encode()) for w in words]
    assert [p.tolist() for p in np.split(ids, np.cumsum(count)[:-1])] == want and [names[i] for i in want[0]] == ["abcd</w>"]


# neighbours


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[100:160] = x[50]  # ties
    rows = [(i, [float(v) for v in x[i]], 0, 0.0) for i in range(300)]
    rows += [(1000, None, 0, 0.0), (1050, [0.0] * 16, 0, 0.0), (1100, [1.0, None] * 8, 0, 0.0), (1150, [float("nan")] * 16, 0, 0.0), (1200, [1.0, 2.0], 0, 0.0), (None, rows[0][1], 0, 0.0), rows[50]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score double")
    got = {}
    for r in ann.nearest(df, query_block=3, candidate_block=40).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 300, 50))
    for qid, found in got.items():
        s = ann.cosines(np.repeat(x[qid : qid + 1], 300, axis=0).astype(float), x.astype(float))
        want = sorted((-s[j], j) for j in range(300) if j != qid)[:5]
        assert sorted(found) == [(k + 1, j, -c) for k, (c, j) in enumerate(want)]
    assert ann.nearest(df.limit(0)).count() == 0


# chat and licences


def test_chat(spark):
    turns = [(1, 0, "u", "a"), (2, 0, "u", "a"), (2, 1, "b", "c"), (3, 0, "u", "a"), (3, 1, "b", "c"), (4, 0, "u", "a"), (4, 1, "b", "d"), (5, None, None, None), (None, 0, "u", "z"), (6, 0, "u", "a"), (6, 0, "u", "a")]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, part int")
    for block in (1, 2, 1024):
        got = chat_format.collapse_and_render(df, block).collect()
        assert {r.conv_id for r in got} == {2, 3, 4, 5, 6}
        text = "".join(r.text for r in sorted(got, key=lambda r: r.part) if r.conv_id == 4)
        assert text == "<|u|>\na<|end|>\n<|b|>\nd<|end|>\n"
    assert chat_format.collapse_and_render(df.limit(0)).count() == 0


def chat_in_sql(turns):
    import duckdb

    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", turns)
    return sorted(con.execute(q.SQL["op1_chat_format"]).fetchall())


@pytest.mark.parametrize("turn", [0, None])
def test_chat_repeated_turns(spark, turn):
    texts = ["a", "b", "cc", "d é", "Z", "", "中"]
    turns = [(10 * i + j, turn, "u", t) for i in range(len(texts)) for j in range(len(texts)) if i != j for t in (texts[i], texts[j])]
    turns += [(1000 + i, turn, "u", t) for i, t in enumerate(texts)]
    got = chat_format.collapse_and_render(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    assert sorted(map(tuple, got.collect())) == chat_in_sql(turns)


def test_chat_random_prefixes(spark):
    rng = random.Random(6)
    turns = []
    for c in range(150):
        n = rng.randrange(1, 6)
        turns += [(c, rng.choice([k, k // 2]), rng.choice("uu a".split()), rng.choice(["x", "y", "x y " * 200])) for k in range(n)]
    turns += [(None, 0, "u", "x"), (900, None, None, None), (901, None, None, None), (901, 0, "u", "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, chat_format.collapse_and_render(df.repartition(4)).collect())) == chat_in_sql(turns)


@pytest.mark.parametrize("numbered", [True, False])
def test_chat_cuts_a_hot_conversation(spark, numbered):
    """Most rows in one conversation, with and without turn numbers, one turn repeated a thousand times."""
    turns = [(7, k if numbered else None, "u", f"text {k}") for k in range(4000)] + [(7, 5 if numbered else None, "u", "again")] * 1000
    turns += [(8, k if numbered else None, "u", f"text {k}") for k in range(3)] + [(9, 1, "u", "other")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = sorted(map(tuple, chat_format.collapse_and_render(df.repartition(4)).collect()))
    assert got == chat_in_sql(turns) and max(r[2] for r in got) <= chat_format.BLOCK
    assert chat_format.runs(chat_format._turns(df)).filter("conv_id = 7").count() == 4001
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else small partitions are joined again
    try:
        found = chat_format._turns(df).groupBy(*chat_format.ORDER).count().repartitionByRange(*chat_format.ORDER).filter("conv_id = 7")
        assert found.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 2000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""


def test_licences(spark, odd, none):
    texts = ["x\nReleased under the MIT Licence.\ny", MIT, "Licensed under CC BY-NC 4.0. All rights reserved.", "no licence", None, "See the GNU General Public License for more details."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    assert [got[i].licenses for i in range(6)] == ["MIT", "MIT", "All-rights-reserved,CC-BY-NC-4.0", None, None, None]
    assert got[5].unmatched == "gpl-details" and got[3].n_known == got[4].n_known == 0
    assert license_scan.scan(odd).count() == len(ODD) and license_scan.scan(none).count() == 0


BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

{0}Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

{1}Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_NAMES = """
{2}Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""


def test_licences_as_they_are_printed(spark):
    marks = [("1. ", "2. ", "3. "), ("* ", "* ", "* "), ("- ", "- ", "- "), ("", "", ""), ("(1) ", "(2) ", "(3) "), ("a) ", "b) ", "c) "), ("i. ", "ii. ", "iii. ")]
    want = [(BSD.format(*m), "BSD-2-Clause") for m in marks] + [((BSD + BSD_NAMES).format(*m), "BSD-3-Clause") for m in marks]
    want += [(MPL, "MPL-2.0"), (APACHE, "Apache-2.0"), ("This Source Code Form is subject to the terms of the Mozilla Public License, v.\n2.0.", "MPL-2.0")]
    want += [("\n".join(f"{c} {line}" for line in t.split("\n")), x) for c in (" *", "#", "//") for t, x in want]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(want)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    for i, (t, x) in enumerate(want):
        assert (got[i].licenses, got[i].unmatched) == (x, None), t


# Licences as their files print them.
FILES = {
    "ISC": """ISC License

Copyright (c) 2020, A. Person

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES.
""",
    "BSD-3-Clause": """BSD 3-Clause License

Copyright (c) 2020, A. Person
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
""",
    "Apache-2.0": """Copyright 2020 A. Person

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
""",
    "GPL-2.0-or-later": """Prog does things
Copyright (C) 2020 A. Person

This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License along
with this program; if not, write to the Free Software Foundation, Inc.,
51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.
""",
}
FILES["MIT"] = """The MIT License (MIT)

Copyright (c) 2020 A. Person

""" + MIT + " IN NO EVENT SHALL THE\nAUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER\nLIABILITY.\n"
FILES["BSD-2-Clause"] = re.sub(r"3\. Neither.*?permission\.\n\n", "", FILES["BSD-3-Clause"], flags=re.S)
FILES["GPL-3.0-or-later"] = FILES["GPL-2.0-or-later"].replace("free software;", "free software:").replace("Foundation; either version 2", "Foundation, either version 3")
FILES["MPL-2.0"] = MPL


def test_licence_files_in_operator_and_sql(spark):
    """Whole notices, with copyright lines and comment marks: the expected licence, from the operator and from the SQL."""
    import duckdb

    want = {}
    for name, t in FILES.items():
        tight = re.sub(r"(?m)^(Copyright[^\n]*)\n\n", r"\1\n", t)  # no blank line after the copyright line
        for text in (t, tight, t.replace("\n", "\r\n"), "x = 1\n\n" + t + "\nMore text. And more.", *["\n".join(p + line for line in t.split("\n")) for p in ("// ", "# ", " * ", "-- ", ";; ")]):
            want[len(want)] = (text, name)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in want.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    for i, (t, name) in want.items():
        assert (got[i].licenses, got[i].unmatched) == (name, None), t
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [(i, t) for i, (t, _) in want.items()])
    rows = con.execute(license_scan.oracle()).fetchall()
    assert sorted(map(str, rows)) == sorted(str(tuple(r)) for r in license_scan.scan(docs).collect())


def test_every_licence_rule_fires(spark):
    text = {}
    for i, s in license_scan.SENTENCES:
        text.setdefault(i, s.replace(" ", "\n", 1))
    df = spark.createDataFrame([(n, ".\n\n".join(text[i] for i in ids) + ".") for n, (_, ids) in enumerate(license_scan.RULES)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    for n, (name, _) in enumerate(license_scan.RULES):
        assert (got[n].licenses, got[n].unmatched) == (name, None)


# pipeline


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, kept, SF)
        assert out.columns == docs.columns, name
        before, kept = kept, spark.createDataFrame(out.collect(), docs.schema)
        assert kept.exceptAll(before).count() == 0
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text) for r in kept.collect()]
    assert len(set(texts)) == len(texts)
    assert len(set(brute_similar(texts))) == len(texts)
    packed = p.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in kept.collect()}
