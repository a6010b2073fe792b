import random

import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from stratalog.llm import pii, queries, simhash, toxicity
from stratalog.llm.common import read


def test_stages_keep_columns_and_only_drop_what_they_find(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert 0.75 * n <= out.count() <= n
        docs = out.persist()
        n = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == n


def test_empty_documents(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir) if "text" in docs.columns else docs
    assert docs.count() == 0


def _shingles(t, width=5):
    w = (t or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def _prints(shingles):
    """The whole fingerprint and the short ones, bit by bit."""
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    out = []
    for mix in [None, *simhash._MIXES.tolist()]:
        g = h
        if mix:
            g = [x * mix[0] % 2**64 for x in h]
            g = [(x ^ x >> 32) * mix[1] % 2**64 for x in g]
            g = [x ^ x >> 29 for x in g]
        out.append(sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in g) > len(g)))
    return out, [f >> at & (1 << 28) - 1 for f in out for at in (0, 28)]


def _meet(a, b):
    return (a[0][0] ^ b[0][0]).bit_count() <= 24 and sum((x ^ y).bit_count() for x, y in zip(a[0], b[0])) <= 74 and any((x ^ y).bit_count() <= 2 for x, y in zip(a[1], b[1]))


def _kept(rows):
    """doc_ids that stay, and the number of rows that stay, by comparing all pairs."""
    s = [_shingles(t) for _, t in rows]
    prints = [_prints(x) for x in s]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and (s[i] == s[j] or len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]) and _meet(prints[i], prints[j])):
                group = [group[j] if g == group[i] else g for g in group]
    first = {}
    for g, (i, t) in zip(group, rows):
        first[g] = min(first.get(g, (True, 1 << 62, "")), (i is None, i or 0, t or ""))
    return sorted(i for nil, i, _ in first.values() if not nil), len(first)


def test_near_copies_by_brute_force(spark, sf_dir):
    """Five-word shingles, short fingerprints, Jaccard 0.8: chains of edited words, copies, rows without words or ids."""
    rnd = random.Random(3)
    words = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(500)]
    texts = []
    for n in (6, 30, 120, 300):
        for _ in range(4):
            t = rnd.choices(words, k=n)
            for _ in range(12):
                texts.append(" ".join(t))
                t = list(t)
                for _ in range(rnd.choice([0, 1, 1, 2, n // 20])):
                    t[rnd.randrange(n)] = rnd.choice(words)
    texts += ["", None, " \n", "one two", "One  two", "three"]
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir).collect()
    ids, n = _kept(rows)
    assert len(kept) == n < 0.6 * len(rows)
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == ids


def test_run_by_brute_force(spark, sf_dir):
    """The whole pipeline on the small tables: which documents go at each stage, and what the last one packs."""
    spark.conf.set(pii.KEY_CONF, "test")
    docs = read(spark, sf_dir, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    chain = toxicity.fit(docs, queries.low_quality_and_toxic(read(spark, sf_dir, "labels")), queries.CATEGORIES)
    p = chain.predict([(t or "").encode() for t in texts.values()])[:, 1]
    clean = [(i, t) for (i, t), x in zip(texts.items(), p) if x < 0.5]
    labelled = {r.doc_id: r.toxic for r in read(spark, sf_dir, "labels").collect()}
    assert sum(labelled.get(i) == 0 for i, _ in clean) >= 0.99 * sum(x == 0 for x in labelled.values())
    ids, _ = _kept(clean)
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted({r.doc_id for r in packed}) == ids
    surrogates = {r.doc_id: r.text for r in pii.replace(docs, "test").collect()}
    tok = Tokenizer.from_file(queries.tokenizer_path())
    for i in ids:
        n = len(tok.encode(surrogates[i] or "", add_special_tokens=False).ids) + 1
        assert sum(r.length for r in packed if r.doc_id == i) == n
    used = {}
    for r in packed:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 1024


def test_run_meets_hard_texts(spark, sf_dir, tmp_path):
    """Long addresses, long white space, nulls and extra columns through every stage."""
    texts = ["a@b" + ".c" * 20_000, "\n" * 300_000, "a" + " " * 300_000 + "b", None, "", "plain words that are here for the sake of it", "plain words that are here for the sake of it"]
    rows = [(i if i != 5 else None, t, "en", "s", len(t or ""), 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `_ROW` int").write.parquet(str(tmp_path / "documents.parquet"))
    read(spark, sf_dir, "labels").write.parquet(str(tmp_path / "labels.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # white space alone, null and empty are one group; of the two equal texts the one with an id stays
    assert {r.doc_id for r in packed} == {0, 1, 2, 6}
