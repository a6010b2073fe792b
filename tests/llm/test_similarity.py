import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stratalog.llm import embed_dedup, packing, queries, simhash, topk
from stratalog.llm.common import components


def _roots(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_of_chains_stars_and_nulls(spark):
    links = [(i, i + 1) for i in range(10, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (5, 3), (3, 5), (5, 3), (None, 4)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 10 for i in range(10, 61)} | {100 + i: 100 for i in range(40)} | {3: 3, 5: 3}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _fingerprint(text):
    w = (text or "").encode().lower().split()
    runs = [b" ".join(w)] if 0 < len(w) < 3 else [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


@pytest.fixture(scope="module")
def docs(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from here to there every single day of the week"
    rows = [(9, base), (4, base.upper()), (5, base + " again"), (1, None), (2, ""), (3, " \n\t"), (6, "one"), (7, "one two"), (8, "One  two"), (8, "One  two"), (None, "one"), (10, "x " * 50_000)]
    return spark.createDataFrame([(i, t, "en", 1, "k", "f") for i, t in rows], "doc_id long, text string, lang string, k int, fp string, component string"), rows


def test_simhash_by_brute_force(spark, docs):
    df, rows = docs
    prints = [_fingerprint(t) for _, t in rows]
    root = _roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    smallest = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    want = sorted(((rows[i][0], prints[i], smallest[root[i]]) for i in range(len(rows))), key=str)
    got = sorted(((r.id, r.fp % (1 << 64), r.component) for r in simhash.simhash_groups(df).collect()), key=str)
    assert got == want
    assert simhash.simhash_groups(df.limit(0)).count() == 0


def test_keep_one_names_rows_by_id_and_text(spark):
    rows = [(5, "one two three four"), (3, "one two three four"), (5, "another text altogether"), (5, "another text altogether"), (None, "lone words"), (None, "lone words"), (None, "one two three four")]
    df = spark.createDataFrame([(i, t, 0, 1) for i, t in rows], "doc_id long, text string, _row int, _KEPT int")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted([(3, "one two three four", 0, 1), (5, "another text altogether", 0, 1), (None, "lone words", 0, 1)], key=str)


@pytest.mark.parametrize("group, radius", [(2048, 3), (8, 3), (2048, 6), (8, 6)])
def test_balls_meet_within_the_radius(spark, monkeypatch, group, radius):
    monkeypatch.setattr(simhash, "GROUP", group)  # 8: crowded keys are compared in blocks
    rnd = np.random.default_rng(1)
    fps = set()
    for centre in rnd.integers(0, 1 << 63, 6).tolist():
        for _ in range(40):
            fps.add(centre ^ sum(1 << int(b) for b in rnd.choice(64, rnd.integers(0, radius + 2), replace=False)))
    fps = sorted(x - (1 << 64) if x >= 1 << 63 else x for x in (f % (1 << 64) for f in fps))
    links = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), radius)
    at = {f: i for i, f in enumerate(fps)}
    got = _roots(len(fps), [(at[r.a], at[r.b]) for r in links.collect()])
    want = _roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if ((fps[i] ^ fps[j]) % (1 << 64)).bit_count() <= radius])
    assert got == want


def test_forests_of_least_distances():
    rnd = np.random.default_rng(2)
    for _ in range(50):
        n = 12
        i, j = np.triu_indices(n, 1)
        some = rnd.random(len(i)) < 0.3
        i, j = i[some], j[some]
        d = rnd.integers(0, 5, len(i)).astype(np.uint8)
        got = simhash.forest(n, i, j, d, 4)
        root, weight = list(range(n)), 0
        for e in np.argsort(d, kind="stable"):
            a, b = root[i[e]], root[j[e]]
            if a != b:
                root, weight = [a if r == b else r for r in root], weight + int(d[e])
        assert int(d[got].sum()) == weight and len(got) == n - len(set(root))
        assert _roots(n, list(zip(i[got].tolist(), j[got].tolist()))) == _roots(n, list(zip(i.tolist(), j.tolist())))


@pytest.fixture(scope="module")
def vectors(spark):
    rnd = np.random.default_rng(3)
    base = rnd.standard_normal((60, 16))
    rows = [(i, base[i].tolist()) for i in range(60)]
    for i in range(60, 160):
        rows.append((i, (base[i % 7] + rnd.standard_normal(16) * rnd.choice([0.0, 0.05, 0.2])).tolist()))
    rows += [(200, None), (201, [0.0] * 16), (202, [float("nan")] * 16), (203, [1.0, None]), (204, [3.0, 4.0]), (205, [6.0, 8.0]), (206, []), (0, rows[0][1])]
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, id string"), rows


@pytest.mark.parametrize("cell, block", [(400, 1024), (20, 8)])
def test_embedding_links_by_brute_force(spark, vectors, monkeypatch, cell, block):
    monkeypatch.setattr(embed_dedup, "CELL", cell)
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    df, rows = vectors
    ok = [bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]

    def cos(i, j):
        a, b = np.array(rows[i][1]), np.array(rows[j][1])
        return len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95

    links = [(i, j) for i in range(len(rows)) for j in range(i) if ok[i] and ok[j] and cos(i, j)]
    n = np.bincount([x for p in links for x in p], minlength=len(rows))
    root = _roots(len(rows), links)
    got = embed_dedup.embedding_links(df, miss=1e-6).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.id, []).append(r)
    for i, (k, _) in enumerate(rows):
        assert {x.n_links for x in by_id[k]} == {n[i]}
        assert by_id[k][0].component == min(rows[j][0] for j in range(len(rows)) if root[j] == root[i])
    assert embed_dedup.embedding_links(df.limit(0)).count() == 0


def test_embedding_rows_that_repeat_an_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, None), (3, [1.0, 0.01]), (4, [1.0, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, id int, `V` int")
    got = sorted(((r.id, r.n_links, r.component) for r in embed_dedup.embedding_links(df).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3), (3, 2, 1), (4, 2, 1), (None, 0, None)], key=str)


def test_embedding_recall_at_the_shipped_miss(spark):
    """50,000 vectors with planted groups about the linking cosine: few links are missed, none made up."""
    rnd = np.random.default_rng(9)
    x = rnd.standard_normal((50_000, 64))
    heads, size = 2000, 4
    for k in range(1, size):
        x[k * heads : (k + 1) * heads] = x[:heads] + rnd.standard_normal((heads, 64)) * rnd.uniform(0.05, 0.35, (heads, 1))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    group = x[: heads * size].reshape(size, heads, 64)
    links = np.zeros((size, heads), int)
    for a in range(size):
        for b in range(size):
            if a != b:
                links[a] += (group[a] * group[b]).sum(axis=1) >= 0.95
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {r.id: r.n_links for r in embed_dedup.embedding_links(df).select("id", "n_links").collect()}
    want = links.ravel()
    have = np.array([got[i] for i in range(50_000)])
    assert (have[: heads * size] <= want).all() and not have[heads * size :].any()
    assert have.sum() >= 0.998 * want.sum() > 5000


def test_collisions_by_brute_force():
    rnd = np.random.default_rng(4)
    for n, m in ((1, 1), (70, 130), (64, 64), (5, 200)):
        a, b = (rnd.integers(-127, 128, (k, embed_dedup.LINES)).astype(np.int8) // 4 for k in (n, m))
        near = np.abs(a[:, None].astype(int) - b[None]) <= embed_dedup.STEPS + 1
        few, all_ = near[..., : embed_dedup.FIRST].sum(axis=2), near.sum(axis=2)
        for first, count in ((1, 1), (10, 22), (13, 20), (20, 45), (32, 64)):
            i, j = embed_dedup.collide(a, b, first, count)
            assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero((few >= first) & (all_ >= count)))))


def test_top_k_by_brute_force(spark, vectors, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 4)
    monkeypatch.setattr(topk, "CANDIDATES", 16)
    df, rows = vectors
    ints = [(k, np.floor(64 * np.array(v)).astype(int)) for k, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for n, (q, x) in enumerate(ints):
        if q % 20 == 0:
            s = sorted((-int(x @ y), c) for m, (c, y) in enumerate(ints) if m != n and len(y) == len(x))[:5]
            want += [(q, i + 1, c, -v) for i, (v, c) in enumerate(s)]
    got = [tuple(r) for r in topk.top_k(df, "vec_id % 20 = 0", k=5).collect()]
    assert sorted(got) == sorted(want)
    assert topk.top_k(df.limit(0), "vec_id % 20 = 0").count() == 0


def test_top_k_with_many_ties(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50)], "vec_id long, embedding array<float>")
    got = topk.top_k(df, F.col("vec_id") == 20, k=7).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 3, 4, 5, 6]


def test_top_k_takes_rows_that_repeat_an_id_and_huge_components(spark):
    rows = [(5, [1.0]), (5, [2.0]), (20, [1.0]), (20, [3.0]), (7, [1e18]), (8, [-1e18]), (9, [1e308]), (10, [4e9])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, row int")
    got = sorted(tuple(r) for r in topk.top_k(df, "vec_id = 20", k=6).collect())
    top = topk.LIMIT
    one = [(7, min(64 * 64 * 10**18, top)), (10, 64 * 64 * 4 * 10**9), (20, 64 * 192), (5, 64 * 128), (5, 64 * 64), (8, -min(64 * 64 * 10**18, top))]
    two = [(7, top), (10, 192 * 64 * 4 * 10**9), (5, 192 * 128), (5, 192 * 64), (20, 192 * 64), (8, -top)]
    assert got == sorted((20, n + 1, c, s) for part in (one, two) for n, (c, s) in enumerate(part))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{sf_dir}/embeddings.parquet')")
    df = queries.queries()[name](spark, sf_dir)
    found = con.execute(queries.ORACLES[name])
    names = [c[0] for c in found.description]
    assert names == df.columns
    assert sorted(tuple(r) for r in df.collect()) == sorted(found.fetchall())


def test_local_search_never_adds_bins():
    rnd = np.random.default_rng(5)
    for _ in range(20):
        sizes = rnd.integers(1, 100, 200).tolist()
        worst = [[i] for i in range(200)]
        out = packing.local_search(worst, sizes, 100)
        assert sorted(i for b in out for i in b) == list(range(200))
        assert all(sum(sizes[i] for i in b) <= 100 for b in out)
        assert len(out) <= -(-sum(sizes) // 100) * 1.1
        assert len(packing.local_search(packing.best_fit(sizes, 100), sizes, 100)) <= len(packing.best_fit(sizes, 100))


def test_local_search_empties_bins_that_best_fit_leaves():
    rnd = np.random.default_rng(1)
    fewer = 0
    for _ in range(100):
        sizes = rnd.integers(15, 60, rnd.integers(10, 60)).tolist()
        start = packing.best_fit(sizes, 100)
        for width in (256, None):
            out = packing.local_search([list(b) for b in start], sizes, 100, width)
            assert sorted(i for b in out for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 100 for b in out)
            assert -(-sum(sizes) // 100) <= len(out) <= len(start)
        fewer += len(out) < len(start)
    assert fewer >= 10


def test_groups_pass_on_what_does_not_fill_bins(spark, monkeypatch):
    """Lengths that never fill a bin exactly, and lengths that do, over several levels of groups."""
    monkeypatch.setattr(packing, "GROUP", 20)
    texts = ["a b" for _ in range(150)] + ["a b c d e f g h i" for _ in range(70)] + ["x"] * 61
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.pack(df, queries.tokenizer_path(), end=2, limit=16).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 16
    assert len(used) <= len(packing.local_search(packing.best_fit([r.length for r in rows], 16), [r.length for r in rows], 16)) + 3


def test_packing_encodes_white_space_of_any_length(spark):
    from tokenizers import Tokenizer

    texts = ["\n" * 1_000_000, "a" + " " * 1_000_000 + "b", " \t" * 200_000, "word " * 200_000, "x" * 300_000]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), queries.tokenizer_path(), end=2, with_ids=True).collect()
    tok = Tokenizer.from_file(queries.tokenizer_path())
    for i, t in enumerate(texts):
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert b"".join(bytes(r.ids) for r in mine) == np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()


def test_packing(spark, monkeypatch):
    import zlib

    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "GROUP", 10)
    texts = ["a word " * n for n in (1, 5, 40, 300)] + ["", None, "end <|endoftext|> here", "tab\t x  two\n\n three ", "it's l'été, naïve— ok 12,5", " lead", "漢字 и кириллица"] * 4
    df = spark.createDataFrame([(i if i != 3 else None, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, row int")
    rows = packing.pack(df, queries.tokenizer_path(), end=2, limit=64, with_ids=True).collect()
    tok = Tokenizer.from_file(queries.tokenizer_path())
    for i, t in enumerate(texts):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
        mine = sorted((r for r in rows if r.doc_id == (i if i != 3 else None)), key=lambda r: r.piece)
        assert b"".join(bytes(r.ids) for r in mine) == ids
        assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.length * 4 == len(r.ids) for r in mine)
        assert [r.start for r in mine] == [sum(x.length for x in mine[:k]) for k in range(len(mine))]
        assert all(r.length == 64 for r in mine[1:])
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 64
    assert len(seqs) <= -(-sum(r.length for r in rows) // 64) + 2
    assert packing.pack(df.limit(0), queries.tokenizer_path(), end=2).count() == 0
