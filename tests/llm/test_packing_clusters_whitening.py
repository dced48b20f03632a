"""Packing, clustering and whitening against the library, brute force, exact fractions and SQL."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from memloom.llm import clusters, packing, queries_clusters, queries_packing, queries_whitening, whitening
from memloom.llm.tokenlines import LineEncoder

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PACK = "doc_id long, text string, length long, TASK string, node int, `rank` long"
VECTORS = "vec_id long, embedding array<float>, block string, V string, cluster int"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(VOCABULARY)
    t.no_truncation()
    t.no_padding()
    return t


def check_packing(rows, texts, library, capacity=1024):
    """Every contract of a packing; returns the number of sequences."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == {k for k, _ in texts}
    for key, text in texts:
        ids, at = library.encode(text or "", add_special_tokens=False).ids + [2], 0
        same = [k for k, _ in texts].count(key)
        mine = sorted(by_doc[key], key=lambda r: r["piece"])[::same]
        for n, r in enumerate(mine):
            assert (r["piece"], r["start"]) == (n, at) and (r["length"] == capacity or n == 0)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for rs in by_sequence.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_sequence)


def test_ids_of_lines_equal_the_library(library):
    e = LineEncoder(open(VOCABULARY, encoding="utf-8").read())
    rng = random.Random(3)
    signs = list("aZ0 _'\n\t.-éß²½ \x85\xa0\x1c日̀ٱ’😀Ⅷst\x01 　") + ["<|endoftext|>", "  ", " it's"]
    texts = ["", " ", "  a  b", "a\n\n b\t c", "<|endoftext|> x <|endoftext|>", "word " * 500]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 30))) for _ in range(4000)]
    got = e.encode_texts(pa.array(texts, pa.large_string())).to_pylist()
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_of_the_documents(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries_packing.op11_best_fit_packing(spark, SF).collect()
    used = check_packing(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], library)
    count = np.bincount([r["length"] for r in rows], minlength=1025)
    assert used <= packing.lower_bound(count, 1024) + 1


def test_packing_of_odd_rows_over_many_tasks(spark, library):
    texts = [(1, None), (2, ""), (3, "x" * 30000), (4, "same words " * 20), (5, "same words " * 20), (5, "same words " * 20), (None, "no id"), (7, " \n "), (8, "a b c d " * 600)]
    texts += [(n, "word " * (n % 700)) for n in range(10, 300)]
    rows = [(k, t, k, "t", 1, 2) for k, t in texts]
    df = spark.createDataFrame(rows, PACK).repartition(24)
    made = packing.pack(df, VOCABULARY, with_ids=True)
    got = made.collect()
    used = check_packing(got, texts, library)
    count = np.bincount([r["length"] for r in got], minlength=1025)
    assert used <= packing.lower_bound(count, 1024) + 1
    whole = packing.sequences(made).collect()
    assert len(whole) == used
    length_of = {r["sequence_id"]: len(r["ids"]) // 4 for r in whole}
    for q, n in length_of.items():
        assert n == sum(r["length"] for r in got if r["sequence_id"] == q)
    assert sum(len(r["documents"]) for r in whole) == len(got)
    assert packing.pack(df.limit(0), VOCABULARY).count() == 0


def test_full_pieces_only(spark, library):
    text = "a" + " a" * 1022  # 1023 tokens and the end
    assert len(library.encode(text).ids) == 1023
    rows = packing.pack(spark.createDataFrame([(1, text), (2, text), (3, text * 2)], "doc_id long, text string"), VOCABULARY).collect()
    check_packing(rows, [(1, text), (2, text), (3, text * 2)], library)


@pytest.mark.parametrize("capacity,most", [(20, 20), (20, 12), (50, 25), (12, 6)])
def test_bins_hold_all_items_and_bounds_hold(capacity, most):
    rng = random.Random(capacity + most)
    for _ in range(60):
        items = [rng.randint(1, most) for _ in range(rng.randint(0, 60))]
        count = np.bincount(items, minlength=capacity + 1)
        bound = packing.lower_bound(count, capacity)
        for groups in (packing.best_fit_decreasing(count, capacity), packing.exact_fill(count, capacity)):
            put = np.zeros(capacity + 1, int)
            for number, holds in groups:
                assert sum(s * n for s, n in holds) <= capacity
                for s, n in holds:
                    put[s] += number * n
            assert (put == count).all() and sum(n for n, _ in groups) >= bound


def test_best_fit_decreasing_equals_one_item_at_a_time():
    rng = random.Random(5)
    for _ in range(80):
        items = sorted((rng.randint(1, 30) for _ in range(rng.randint(1, 80))), reverse=True)
        rooms: list[int] = []
        for s in items:
            fits = [r for r in rooms if r >= s]
            room = min(fits) if fits else 30
            if fits:
                rooms.remove(room)
            rooms.append(room - s)
        groups = packing.best_fit_decreasing(np.bincount(items, minlength=31), 30)
        left = sorted(30 - sum(s * n for s, n in holds) for number, holds in groups for _ in range(number))
        assert left == sorted(rooms)


def test_lower_bound_is_never_above_the_optimum():
    def optimum(items, capacity):
        best = len(items)

        def go(k, rooms):
            nonlocal best
            if len(rooms) >= best:
                return
            if k == len(items):
                best = len(rooms)
                return
            for i in {r: i for i, r in enumerate(rooms) if r >= items[k]}.values():
                go(k + 1, rooms[:i] + [rooms[i] - items[k]] + rooms[i + 1 :])
            go(k + 1, [*rooms, capacity - items[k]])

        go(0, [])
        return best

    rng = random.Random(9)
    for _ in range(60):
        items = sorted((rng.randint(1, 12) for _ in range(rng.randint(1, 9))), reverse=True)
        assert packing.lower_bound(np.bincount(items, minlength=13), 12) <= optimum(items, 12)


def brute_clusters(rows, k=8, rounds=10):
    ids = [r[0] for r in rows]
    x = np.floor(1024 * np.array([r[1] for r in rows], np.float64)).astype(np.int64)
    key = [(i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "", x[n].tolist()) for n, i in enumerate(ids)]
    c = x[sorted(range(len(ids)), key=key.__getitem__)[:k]].copy()

    def assigned():
        d = ((x[:, None, :] - c[None]) ** 2).sum(2)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        at, _ = assigned()
        for j in range(len(c)):
            if (at == j).any():
                c[j] = x[at == j].sum(0) // int((at == j).sum())
    at, d = assigned()
    sha = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]
    return sorted((str(i), int(a), int(e), int(d[at == a].sum()), int(d.sum()), sha[a]) for i, a, e in zip(ids, at, d, strict=True))


def plain_clusters(df):
    return sorted((str(r[0]), *tuple(r)[1:]) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


def test_clusters_equal_sql_and_brute_force(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    got = queries_clusters.op12_exponion_clusters(spark, SF)
    want = con.execute(queries_clusters.ORACLES["op12_exponion_clusters"])
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
    assert plain_clusters(got) == brute_clusters([(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()])


def test_clusters_of_odd_rows_and_ties(spark):
    rng = random.Random(4)
    rows = [(n, [float(rng.randint(-2, 2)) / 1024 for _ in range(3)]) for n in range(400)]  # many ties and copies
    rows += [(n, [0.5, 0.5, 0.5]) for n in range(400, 600)] + [(5, [1.0, 2.0, 3.0]), (None, [0.0, 0.0, 0.25])]
    bad = [(700, None), (701, [1.0, None, 2.0]), (702, [1.0, float("nan"), 0.0]), (703, [float("inf"), 0.0, 0.0]), (704, [1.0, 2.0]), (705, [])]
    df = spark.createDataFrame([(i, v, "b", "v", 3) for i, v in rows + bad], VECTORS).repartition(5)
    for k in (1, 2, 8):
        assert plain_clusters(clusters.cluster(df, k=k, width=3)) == brute_clusters(rows, k)
    few = spark.createDataFrame([(i, v, "b", "v", 3) for i, v in rows[:3]], VECTORS)
    assert plain_clusters(clusters.cluster(few, k=8, width=3)) == brute_clusters(rows[:3], 8)
    assert clusters.cluster(df.limit(0), width=3).count() == 0


def test_clusters_of_large_numbers(spark):
    rng = random.Random(6)
    rows = [(n, [float(np.float32(rng.uniform(-1, 1) * 2.0**18)) for _ in range(3)]) for n in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert plain_clusters(clusters.cluster(df, k=4, width=3)) == brute_clusters(rows, 4)


def test_exponion_scans_fewer_than_all(monkeypatch):
    rng = np.random.default_rng(0)
    home = rng.integers(-3000, 3000, (16, 8))
    x = home[rng.integers(0, 16, 5000)] + rng.integers(-60, 60, (5000, 8))
    was = clusters.Centroids(home, np.zeros(16))
    at, upper, lower = clusters.first_search(x, was)
    moved = home + rng.integers(-40, 40, home.shape)
    now = clusters.Centroids(moved, np.sqrt(((moved - home) ** 2).sum(1)))
    seen, scan = [0], clusters._scan
    monkeypatch.setattr(clusters, "_scan", lambda x, c, numbers: seen.__setitem__(0, seen[0] + len(x) * len(numbers)) or scan(x, c, numbers))
    got = clusters.exponion_search(x, at, upper, lower, now)[0]
    assert (got == ((x[:, None] - moved[None]) ** 2).sum(2).argmin(1)).all()
    assert seen[0] < 5000 * 16 / 4


def brute_whitening(rows, components):
    x = np.array([[int(v) for v in np.floor(256 * np.array(v, np.float64))] for _, v in rows], dtype=object)
    fit = sorted({tuple(r) for r in x.tolist()})
    n, d = len(fit), len(fit[0])
    sums = [sum(r[j] for r in fit) for j in range(d)]
    cov = [[float(Fraction(n * sum(r[i] * r[j] for r in fit) - sums[i] * sums[j], n * n)) for j in range(d)] for i in range(d)]
    values, axes = np.linalg.eigh(np.array(cov))
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x.tolist()]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(r, sums, strict=True)] for r in x.tolist()])
    return n, deviation, centred, values[::-1][:components], axes[:, ::-1][:, :components], float(np.trace(np.array(cov)))


def check_whitening(got, rows, components=4, skip=()):
    n, deviation, centred, values, axes, trace = brute_whitening(rows, components)
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    assert len(got) == len(rows) * len(values)
    for c in range(len(values)):
        want = centred @ axes[:, c] / np.sqrt(values[c]) if values[c] > 0 else centred[:, 0] * 0
        mine = np.array([by[i, c + 1][0]["whitened"] for i, _ in rows])
        if c not in skip:
            assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-9
        for k, (i, _) in enumerate(rows):
            r = by[i, c + 1][0]
            assert r["n"] == n and r["deviation_exact"] == str(deviation[k]) and r["deviation"] == (deviation[k] if deviation[k] < 1 << 63 else None)
            assert abs(r["explained"] - values[c] / trace) <= 1e-9 * abs(values[c] / trace) + 1e-15
            assert r["identity_error"] < 1e-6


def test_whitening_of_the_embeddings(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(queries_whitening.op13_embedding_whitening(spark, SF).collect(), rows)


def test_whitening_of_odd_rows(spark):
    rng = random.Random(8)
    rows = [(n, [rng.gauss(0, s) for s in (9, 5, 3, 2, 1)]) for n in range(200)]
    rows += [(n, [7.0, 7.0, 7.0, 7.0, 7.0]) for n in range(200, 320)] + [(900, [-0.0, 0.001, -0.001, 0.0, 3e4])]
    short = [(901, [1.0, 2.0]), (902, [])]
    bad = [(903, None), (904, [1.0, None, 2.0]), (905, [float("nan")]), (906, [float("-inf"), 0.0])]
    df = spark.createDataFrame([(i, v, "b", "v", 3) for i, v in rows + short + bad], VECTORS).repartition(7)
    rows = [(i, list(map(float, np.array(v, np.float32)))) for i, v in rows]
    check_whitening(whitening.whiten(df).collect(), rows + [(901, [1.0, 2.0, 0, 0, 0]), (902, [0.0] * 5)])
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [])], "vec_id long, embedding array<float>")).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<float>")).collect()
    assert len(one) == 4 and all(r["whitened"] == 0 and r["deviation"] == 0 and r["n"] == 1 and r["identity_error"] == 0 for r in one)


def test_whitening_of_numbers_beyond_64_bits(spark):
    rng = random.Random(2)
    rows = [(n, [float(np.float32(rng.uniform(-1, 1) * 2.0**k)) for k in (50, 49, 48)]) for n in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    check_whitening(whitening.whiten(df).collect(), rows)


def test_residues_give_whole_numbers():
    rng = np.random.default_rng(1)
    x = rng.integers(-(2**40), 2**40, (9000, 3))
    chosen = whitening.primes(9000 * 2**80)
    assert len(chosen) > 3 and all(p % q for p in chosen for q in range(3, int(p**0.5) + 1, 2))
    got = whitening.reconstructed({p: whitening.scatter_residues(x, p).tolist() for p in chosen})
    y = np.concatenate([np.ones((9000, 1), np.int64), x], axis=1).astype(object)
    assert got.tolist() == (y.T @ y)[np.triu_indices(4)].tolist()

