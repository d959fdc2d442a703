import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from cases import edited, odd_docs, odd_texts, prose
from pyspark.sql import functions as F

from quillon.llm import classifier, exact_topk, near_dedup, packing, text_arrays
from quillon.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.01"
SMALL = {c: c + 32 for c in range(65, 91)}
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


# ---- 4 packing ----


def test_bounds_and_best_fit():
    rng = np.random.default_rng(4)
    for n in (1, 5, 50, 3000):
        lengths = np.minimum(rng.lognormal(6, 1.2, n).astype(np.int64) + 1, 4096)
        bins, offsets, fills = packing.best_fit_decreasing(lengths)
        assert fills.max() <= 4096 and len(fills) >= packing.lower_bound(lengths)
        for b in range(len(fills)):
            at = sorted((o, l) for o, l in zip(offsets[bins == b], lengths[bins == b]))
            assert [o for o, _ in at] == list(np.cumsum([0, *[l for _, l in at]])[:-1])
    assert packing.lower_bound(np.array([2049] * 10)) == 10  # the sum alone gives 6
    assert packing.lower_bound(np.array([1366] * 9)) == 5  # three don't fit
    assert packing.lower_bound(np.array([4096, 1])) == 2


def check_packing(got, rows, path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    expected = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            part = ids[a : a + 4096]
            expected[i, k, a, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == list(np.cumsum([0, *[n for _, n in s]])[:-1]) and sum(n for _, n in s) <= 4096
    return len(sequences)


def test_packing_odd_rows(spark):
    path = tokenizer_path("word_bpe_49k.json")
    check_packing(packing.pack_documents(odd_docs(spark), path, 1).collect(), odd_texts(), path)
    assert packing.pack_documents(odd_docs(spark, []), path, 1).count() == 0


def test_repacking_meets_the_bound(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 40)
    lengths = [int(x) for x in np.minimum(np.random.default_rng(1).lognormal(6, 1, 600) + 1, 4096)]
    pieces = spark.createDataFrame([(i, i, 0, 0, n, i) for i, n in enumerate(lengths)], packing.PIECE)
    rows = packing.pack(pieces).collect()
    assert len(rows) == 600
    used, bound = len({r["sequence_id"] for r in rows}), packing.lower_bound(np.array(lengths))
    alone = sum(len(packing.best_fit_decreasing(np.array(lengths[a : a + 40]))[2]) for a in range(0, 600, 40))
    assert bound <= used < alone and used <= bound + 2
    assert {(r["sequences"], r["bound"]) for r in rows} == {(used, bound)}


def test_equal_pieces_are_dealt_evenly(spark):
    pieces = spark.range(60_000).selectExpr("id AS row", "7L AS doc_id", "0 AS piece", "0L AS start", "100L AS length", "1L AS ids_crc32")
    parts = [r["count"] for r in packing._pack(pieces, 3, 0, 4096).groupBy("part").count().collect()]
    assert len(parts) == 3 and max(parts) < 21_000


# ---- 6 top-k ----


def topk_by_hand(rows, k):
    sound = [(i, np.floor(64 * np.array(v, np.float32).astype(float))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    asked = {}
    for i, v in sound:
        if i % 20 == 0:
            asked[i] = min(asked.get(i, v.tolist()), v.tolist())
    for q, v in asked.items():
        hits = sorted((-int(sum(a * b for a, b in zip(v, w))), j) for j, w in sound if j != q)[:k]
        out += [(q, r + 1, j, -s) for r, (s, j) in enumerate(hits)]
    return sorted(out)


@pytest.mark.parametrize("n,k", [(0, 20), (3, 20), (90, 5), (300, 20)])
def test_topk_against_brute_force(spark, monkeypatch, n, k):
    monkeypatch.setattr(exact_topk, "CANDIDATE_TILE", 16)
    monkeypatch.setattr(exact_topk, "QUERY_TILE", 4)
    monkeypatch.setattr(exact_topk, "FAN_IN", 2)
    monkeypatch.setattr(exact_topk, "CHUNK_BYTES", 16_000_000 if n == 1 else 500)
    rng = np.random.default_rng(n)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 2]) for i in range(n)]  # many ties
    if n > 50:
        rows += [(None, [1.0] * 4), (1000, None), (1001, [1.0, None, 0.0, 0.0]), (1002, [float("nan")] * 4), (1003, [float("inf")] * 4), (1004, []), (1005, [1.0, 1.0]), rows[3], (40, [0.5] * 4)]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, block string")
    got = exact_topk.search(frame, F.col("vec_id") % 20 == 0, k)
    assert sorted(map(tuple, got.collect())) == topk_by_hand(rows, k)


def test_topk_refuses_scores_that_are_not_exact(spark):
    frame = spark.createDataFrame([(0, [1e9, 1e9]), (1, [1e9, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError):
        exact_topk.search(frame, F.col("vec_id") == 0)


# ---- 2 near-duplicates ----


def shingle_weights(rows):
    """Plain Python: weights of five-word shingles of each distinct text, by true document frequencies."""
    words = {t: [w.translate(SMALL) for w in re.split("[\\x20\\x09-\\x0d]+", t) if w] for _, t in rows if t is not None}
    shingles = {t: Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter() for t, w in words.items()}
    n, df = 0, Counter()
    for _, t in rows:
        if t is not None and shingles[t]:
            n += 1
            df.update(shingles[t].keys())
    floor = max(2, math.ceil(near_dedup.COMMON * n))
    factor = {s: 1 + near_dedup.IDF_SHARE * min(1, math.log(n / (k if k >= floor else 1)) / math.log(1 / near_dedup.COMMON)) for s, k in df.items()}
    return {t: {s: k * factor[s] for s, k in c.items()} for t, c in shingles.items()}


def links_by_hand(sets):
    """Pairs (places of texts) of weighted Jaccard similarity 0.8 or more, of all that share a shingle."""
    texts, where = list(sets), defaultdict(list)
    sums = [sum(sets[t].values()) for t in texts]
    for k, t in enumerate(texts):
        for h in sets[t]:
            where[h].append(k)
    pairs = {(a, b) for ks in where.values() for i, a in enumerate(ks) for b in ks[i + 1 :] if min(sums[a], sums[b]) >= 0.8 * max(sums[a], sums[b])}
    for a, b in pairs:
        x, y = sets[texts[a]], sets[texts[b]]
        shared = sum(min(w, y[s]) for s, w in x.items() if s in y)
        if shared >= 0.8 * (sums[a] + sums[b] - shared):
            yield a, b


def classes_by_hand(rows):
    sets = shingle_weights(rows)
    texts = {t: k for k, t in enumerate(sets)}
    parent = list(range(len(texts)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in links_by_hand(sets):
        parent[find(a)] = find(b)
    lowest = {}
    for i, t in rows:
        if t is not None and i is not None:
            c = find(texts[t])
            lowest[c] = min(i, lowest.get(c, i))
    return Counter((i, i if t is None else lowest.get(find(texts[t]))) for i, t in rows)


def test_icws_collides_like_weighted_jaccard():
    rng = np.random.default_rng(8)
    share, truth = [], []
    for _ in range(150):
        a = np.sort(rng.choice(1 << 40, 300, replace=False).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        keep = rng.random(300) < 0.9
        b = np.sort(np.concatenate([a[keep], rng.integers(0, 1 << 63, int((~keep).sum()), dtype=np.uint64)]))
        wa, wb = 1 + (a % np.uint64(3)).astype(float), 1 + (b % np.uint64(3)).astype(float)
        share.append((near_dedup.icws(a, wa) == near_dedup.icws(b, wb)).mean())
        truth.append(near_dedup.weighted_jaccard((a, wa), (b, wb)))
    assert abs(np.mean(share) - np.mean(truth)) < 0.02


def test_near_dedup_odd_rows(spark):
    rows = odd_texts()
    got = near_dedup.classes_of(odd_docs(spark)).collect()
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["class_id"], r["kept"]))
    assert len(got) == len(rows)
    assert by[1] == {(1, True)} and by[2] == {(1, False)} and by[3] == {(1, False)}
    assert by[4] == {(4, True)} and by[5] == {(5, True)} and by[6] == {(5, False)} and by[7] == {(7, True)}
    assert by[8] == {(8, True)} and by[9] == {(8, False)}
    assert by[10] == {(10, True)} and by[11] == {(10, False)}
    assert by[None] == {(None, True), (1, False)} and by[16] == {(16, True), (16, False)}
    links = {r["doc_id"]: r["n_links"] for r in got}
    assert links[1] == links[2] == links[3] == 1 and links[8] == links[9] == 1 and links[4] == links[15] == links[16] == 0
    kept = near_dedup.keep_one(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 4, 5, 7, 8, 10, 12, 13, 14, 15, 16, 17, None], key=str)
    assert near_dedup.classes_of(odd_docs(spark, [])).count() == 0


@needs_data
def test_near_dedup_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    counts, n = near_dedup.frequencies(docs)
    assert n == sum(1 for _, t in rows if t.split()) and counts.sum() > 0
    got = Counter((r["doc_id"], r["class_id"]) for r in near_dedup.classes_of(docs).collect())
    assert got == classes_by_hand(rows)


def test_one_row_of_each_class_stays(spark):
    a, b, c = prose(501, 90), prose(502, 70), prose(503, 60)
    rows = [(1, a), (2, a), (2, b), (3, edited(b, [40])), (3, c), (3, c), (None, c), (None, edited(a, [50])), (None, prose(504, 50)), (None, prose(504, 50)), (4, None), (4, None), (None, None), (1, "")]
    got = near_dedup.classes_of(odd_docs(spark, rows)).collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == 8  # a, b, c, the unnamed text, the empty one, three null texts
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == classes_by_hand(rows)
    left = [(r["doc_id"], r["text"]) for r in near_dedup.keep_one(odd_docs(spark, rows)).collect()]
    assert Counter(left) == Counter([(1, a), (2, b), (3, c), (None, prose(504, 50)), (4, None), (4, None), (None, None), (1, "")])


def test_long_texts_go_through_in_pieces(monkeypatch):
    texts = [prose(91, 3000), "\n " * 3000 + prose(92, 900) + " " * 4000, "y" * 9000 + " a b c " + "z" * 9000, "x" * 20_000, prose(93, 4), "", None]
    whole = [h.tolist() for h in text_arrays.text_windows(pa.array(texts), 5)]
    monkeypatch.setattr(text_arrays, "PIECE", 512)
    assert [h.tolist() for h in text_arrays.text_windows(pa.array(texts), 5)] == whole
    assert [len(h) for h in whole] == [2996, 896, 1, 1, 1, 0, 0]


def test_features_of_long_texts_add_up_over_pieces(monkeypatch):
    texts = [prose(91, 3000) + " again" * 500, "# |" * 3000, "y" * 9000 + " a a a\n" + "z" * 9000, ""]
    whole = [classifier.features(pa.array([t])) for t in texts]
    monkeypatch.setattr(classifier, "PIECE", 512)
    monkeypatch.setattr(text_arrays, "PIECE", 512)
    assert all(np.allclose(classifier.features(pa.array([t])), f) for t, f in zip(texts, whole, strict=True))


def test_large_keys_join_like_any_other(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LARGE", 3)
    monkeypatch.setattr(near_dedup, "TEXT_BLOCK", 3)
    base = prose(601, 150)
    rows = [(i, edited(base, [(3 * i) % 140])) for i in range(40)] + [(100 + i % 5, base) for i in range(30)] + [(200 + i, prose(700 + i, 60)) for i in range(30)]
    got = near_dedup.classes_of(odd_docs(spark, rows)).collect()
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == classes_by_hand(rows) and sum(r["kept"] for r in got) == 31
    assert near_dedup.keep_one(odd_docs(spark, rows)).count() == 31


def test_chains_and_large_groups(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SALT", 8)
    monkeypatch.setattr(near_dedup, "TILE", 5)
    monkeypatch.setattr(near_dedup, "BUCKET_TILE", 4)
    rows, base = [], prose(77, 200)
    for i in range(60):  # around one text
        rows.append((i, edited(base, [(7 * i) % 190, (11 * i + 5) % 190, (3 * i + 50) % 190])))
    chain = prose(78, 150)
    for i in range(30):  # each close to the next alone
        rows.append((100 + i, chain))
        chain = edited(chain, [(5 * i) % 150, (5 * i + 75) % 150])
    rows += [(300 + i, prose(79, 100) + " " + prose(400 + i, 150)) for i in range(20)]  # share a passage
    docs = odd_docs(spark, rows)
    got = Counter((r["doc_id"], r["class_id"]) for r in near_dedup.classes_of(docs).collect())
    assert got == classes_by_hand(rows)
