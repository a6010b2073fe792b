"""The figures of the README beyond the check tool's: python tests/llm/measure.py SF_DIR NAME...

toxicity    held-out decisions, over folds of documents; near copies share a fold
perplexity  of held-out texts, by items and classes
copies      near copies (five-word shingles, similarity 0.8) that the pipeline's stage keeps apart
pieces      ids against the library's own encoding
pages       differencing without structure, on pages whose frames are made plain divisions
"""

from __future__ import annotations

import re
import sys
import time
from collections import Counter, defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[2]))

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from stratalog.llm import brown, html, queries, simhash, spm, toxicity
from stratalog.llm.common import read


def toxicity_(spark, sf):
    """Folds by the smallest checksum of a text's words, which near copies
    share; the seed is not one that any feature was chosen with."""
    docs = read(spark, sf, "documents").select("doc_id", "text")
    labels = queries.low_quality_and_toxic(read(spark, sf, "labels")).dropna()
    held = docs.join(labels, "doc_id").toPandas()
    fold = np.array([min((hash_(w) for w in (t or "").lower().split()), default=0) % 5 for t in held.text])
    found = Counter()
    for f in range(5):
        ids = spark.createDataFrame([(int(i),) for i in held.doc_id[fold != f]], "doc_id long")
        chain = toxicity.fit(docs, labels.join(F.broadcast(ids), "doc_id"), queries.CATEGORIES)
        mine = held[fold == f]
        p = chain.predict([(t or "").encode() for t in mine.text])[:, 1]
        for y, x in zip(mine.toxic, p >= 0.5):
            found[int(y), bool(x)] += 1
    print("toxicity: of", found[1, True] + found[1, False], "labelled toxic found", found[1, True], "; of", found[0, True] + found[0, False], "clean rejected", found[0, True])


def hash_(w: str) -> int:
    import zlib

    return zlib.crc32(b"measure" + w.encode())


def perplexity(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    for items, classes, rounds in ((1024, 64, 1), (1024, 48, 1), (256, 48, 1), (1024, 16, 1), (1024, 128, 1), (1024, 48, 0), (1024, 48, 3)):
        began = time.time()
        scored, model, v = brown.fit_and_score(docs, held_out, items=items, classes=classes, rounds=rounds)
        n, b, s = scored.filter("held_out").agg(F.sum("n_tokens"), F.sum("base_score"), F.sum("score")).first()
        print(f"perplexity: items {items}, classes {classes}, rounds {rounds} (words clustered {v.distinct - 1 if rounds else min(items, len(v.words) - 1)}): {10 ** (-s / n):.0f}, unigram base {10 ** (-b / n):.0f}; {time.time() - began:.0f} s", flush=True)


def copies(spark, sf):
    """All pairs that share a rare shingle are compared exactly."""
    docs = read(spark, sf, "documents").select("doc_id", "text")
    kept = {r.doc_id for r in simhash.keep_one(docs).select("doc_id").collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    sets = {i: frozenset(simhash.shingle_hashes(t, 5).tolist()) for i, t in texts.items()}
    by_set = defaultdict(list)
    for i, s in sets.items():
        by_set[s].append(i)
    where = defaultdict(list)
    for s in by_set:
        for h in s:
            where[h].append(s)
    pairs, near = Counter(), []
    for group in where.values():
        for n, a in enumerate(group):
            for b in group[:n]:
                pairs[id(a), id(b)] += 1
    named = {id(s): s for s in by_set}
    for (a, b), both in pairs.items():
        a, b = named[a], named[b]
        if both >= 0.8 * (len(a) + len(b) - both):
            near.append((min(by_set[a]), min(by_set[b]), both / (len(a) + len(b) - both)))
    stay = [j for a, b, j in near if a in kept and b in kept]
    exact = sum(len(x) - 1 for x in by_set.values())
    spared = sum(sum(i in kept for i in x) - 1 for x in by_set.values() if sum(i in kept for i in x) > 1)
    print(f"copies: {len(kept)} of {len(texts)} kept; {len(near)} pairs of different sets at 0.8 or more, {len(stay)} of them both kept ({[sum(lo <= j < lo + 0.05 for j in stay) for lo in (0.8, 0.85, 0.9, 0.95)]} of {[sum(lo <= j < lo + 0.05 for _, _, j in near) for lo in (0.8, 0.85, 0.9, 0.95)]} by similarity from 0.80, 0.85, 0.90, 0.95); {spared} of {exact} rows of an equal set kept")


def pieces(spark, sf):
    import sentencepiece

    path = queries.piece_model_path()
    model, sp = spm.Model(path), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [r.text or "" for r in read(spark, sf, "documents").orderBy("doc_id").limit(1000).collect()]
    own, theirs = [model.encode(t).tolist() for t in texts], [sp.encode(t) for t in texts]
    print("pieces:", sum(map(len, own)), "ids against the library's", sum(map(len, theirs)), "; equal texts", sum(a == b for a, b in zip(own, theirs)), "of", len(texts), "; exact round trips", sum(model.decode(a) == t for a, t in zip(own, texts)))


def bare(page: str, host: str) -> str:
    page = re.sub(r"<(/?)(?:nav|footer|article|ul|li)\b[^>]*>", r"<\1div>", re.sub(r'<div class="ad">.*?</div>', "", page, flags=re.S))
    page = re.sub(r"<div>(?:(?!</?b|<h1).)*?<a .*?(?=<!--)", f"<div>{host} menu</div>", page, count=1, flags=re.S)
    return re.sub(r"&copy;[^<]*", f"&copy; {host}", page)


def pages(spark, sf):
    rows = read(spark, sf, "pages").collect()
    want = {r.page_id: r.text for r in queries.op7_html(spark, sf).collect()}
    df = spark.createDataFrame([(r.page_id, r.url, bare(r.html, r.url.split("/")[2])) for r in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    free = sum("menu" not in t and "©" not in t for t in got.values())
    print(f"pages: by differencing alone {free} of {len(got)} are free of menu and footer, {sum(got[i] == want[i] for i in got)} equal the article")


def main() -> None:
    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for name in sys.argv[2:]:
        {"toxicity": toxicity_, "perplexity": perplexity, "copies": copies, "pieces": pieces, "pages": pages}[name](spark, sys.argv[1])


if __name__ == "__main__":
    main()
