"""Each operator against a plain version, and on odd rows: nulls, empty and long texts, ties, repeated rows, no rows, extra columns."""

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from xxhash import xxh64_intdigest

from fleetlens.llm import decontamination, license_scans, lm_scoring, mixing, quality_rules, simhash_dedup, substring_dedup, suffix_dedup, token_counts, url_filters
from fleetlens.llm.queries import oracle_sql, queries, tokenizer_path

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({c: c.lower() for c in map(chr, range(65, 91))})
LONG = " ".join(f"w{i % 977}x{i % 331}" for i in range(30_000))
ODD = [(1, None, "a"), (2, "", None), (3, "one two", "b"), (3, "one two", "b"), (4, LONG, "a"), (5, LONG + " end", None), (None, LONG[:5000], "b"), (6, "é ü　ß\x00 " * 30, "b"), (7, "ha " * 400, "a"), (8, "é" * 200, "a"), (9, "é" * 200, "a")]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(ODD, SCHEMA).withColumn("size", F.lit(1)).withColumn("n_words", F.lit("x")).withColumn("kept", F.lit(0))


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark", "conversations", "embeddings"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries()[name](spark, SF), c.sql(oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    text = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x)
    rows = lambda found, columns: sorted([text(x[columns.index(k)]) for k in sorted(columns)] for x in found)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)


def sha(b):
    return hashlib.sha256(b).hexdigest()


def plain_words(rows, w=20):
    rows = [(-1 if i is None else i, (t or "").encode().split()) for i, t in rows]
    seen = {}
    for i, x in sorted(rows):
        for s in range(len(x) - w + 1):
            seen.setdefault(tuple(x[s : s + w]), (i, s))
    for i, x in rows:
        gone = [False] * len(x)
        for s in range(len(x) - w + 1):
            if seen[tuple(x[s : s + w])] != (i, s):
                gone[s : s + w] = [True] * w
        yield i, len(x), sum(gone), sha(b" ".join(a for a, g in zip(x, gone) if not g))


def plain_bytes(rows, w=50):
    rows = [(-1 if i is None else i, (t or "").encode()) for i, t in rows]
    seen = {}
    for i, x in sorted(rows):
        for s in range(len(x) - w + 1):
            seen.setdefault(x[s : s + w], i)
    for i, x in rows:
        gone = bytearray(len(x))
        for s in range(len(x) - w + 1):
            if seen[x[s : s + w]] < i:
                gone[s : s + w] = b"\1" * w
        yield i, len(x), sum(gone), sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1])), sha(bytes(a for a, g in zip(x, gone) if not g))


def without_bytes(rows, w=50):
    """The texts by doc_id without the bytes that ``plain_bytes`` counts."""
    raw = {i: (t or "").encode() for i, t in rows}
    seen = {}
    for i, x in sorted(raw.items()):
        for s in range(len(x) - w + 1):
            seen.setdefault(x[s : s + w], i)
    out = {}
    for i, t in rows:
        x, gone = raw[i], bytearray(len(raw[i]))
        for s in range(len(x) - w + 1):
            if seen[x[s : s + w]] < i:
                gone[s : s + w] = b"\1" * w
        out[i] = None if t is None else bytes(c for c, g in zip(x, gone) if not g).decode("utf-8", "ignore")
    return out


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 1 << 15, "chunk_bytes": 1 << 16}])
def test_repeated_windows(spark, documents, odd, sizes):
    for df, rows in ((spark.read.parquet(f"{SF}/documents.parquet"), [tuple(r) for r in documents]), (odd, [r[:2] for r in ODD])):
        a = substring_dedup.remove_repeated_windows(df.select("doc_id", "text"), **sizes).collect()
        assert sorted((-1 if r[0] is None else r[0], r["n_words"], r["n_removed"], sha(bytes(r["kept"]))) for r in a) == sorted(plain_words(rows))
        b = suffix_dedup.remove_repeated_bytes(df.select("doc_id", "text"), **sizes).collect()
        assert sorted((-1 if r[0] is None else r[0], r["n_bytes"], r["n_removed"], r["n_spans"], sha(bytes(r["kept"]))) for r in b) == sorted(plain_bytes(rows))


def test_fm_index_counts():
    codes = np.concatenate([np.random.default_rng(1).integers(1, 4, 500), [0]]).astype(np.uint8)
    low, high = substring_dedup.FMIndex(codes).search(codes, np.arange(480), 20)
    text = codes.tobytes()
    assert (high - low).tolist() == [sum(text.startswith(text[i : i + 20], j) for j in range(501)) for i in range(480)]


def test_suffix_order():
    text = np.random.default_rng(2).integers(97, 99, 600).astype(np.uint8)
    at = np.arange(550)
    ordered = suffix_dedup.merge_sorted(suffix_dedup.PrefixHashes(text, 50), at)
    assert ordered.tolist() == sorted(at.tolist(), key=lambda i: (text[i : i + 50].tobytes(), i))


def test_near_duplicates(spark, documents):
    fp = {}
    for i, t in documents:
        w = t.translate(LOWER).encode().split()
        h = [xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        fp[i] = sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))
    label = {i: i for i in fp}
    for _ in fp:
        new = {i: min(label[j] for j in fp if (fp[i] ^ fp[j]).bit_count() <= 3) for i in fp}
        if new == label:
            break
        label = new
    for length in (None, 5, 3):
        got = simhash_dedup.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet"), block_length=length).collect()
        assert {(r[0], r[1], r[2]) for r in got} == {(i, f"{fp[i]:016x}", label[i]) for i in fp}


def test_every_link_meets_at_the_nearest_anchor():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    y = x.copy()
    for _ in range(3):
        y ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    for length in (3, 5, 7):
        code = simhash_dedup.CoveringCode(length, 3)
        anchor, i, _ = code.replicas(y)
        assert set(enumerate(code.anchors(x)[0].tolist())) <= set(zip(i.tolist(), anchor.tolist()))


def test_token_counts_equal_the_library(spark, odd):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    texts = [t for _, t, _ in ODD] + ["<s> </s> <unk> <0x41>", "  a\n\n b \t▁▁c", "\U0001f600漢字 zß", "a" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in token_counts.token_counts(df, tokenizer_path("piece_bpe_32k.model")).collect()}
    for i, t in enumerate(texts):
        n = len(sp.encode(t or ""))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 4096)


def plain_scores(rows, weight=0.7):
    words = {i: (t or "").translate(LOWER).encode().split() + [b"\n"] for i, t in rows}
    train = [i for i in words if zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for i in train for w in words[i])
    pairs = Counter(p for i in train for p in zip([b" ", *words[i]], words[i]))
    c[b" "] = len(train)
    n, v = sum(x for w, x in c.items() if w != b" "), len(c) - 1
    for i, x in words.items():
        one = [(c[w] + 0.1) / (n + 0.1 * (v + 1)) for w in x]
        two = [weight * pairs[h, w] / c[h] + (1 - weight) * p if c[h] else p for h, w, p in zip([b" ", *x], x, one)]
        yield i, (zlib.crc32(str(i).encode()) % 10 == 0, len(x), sum(c[w] > 0 for w in x), n, sum(map(math.log10, one)), sum(map(math.log10, two)))


def test_scores(spark, documents):
    want = dict(plain_scores([tuple(r) for r in documents]))
    for sizes in ({}, {"shard_bytes": 1 << 15, "chunk_bytes": 1 << 16}):
        for r in lm_scoring.score(spark.read.parquet(f"{SF}/documents.parquet"), **sizes).collect():
            w = want[r["doc_id"]]
            assert tuple(r)[1:5] == w[:4]
            assert r["base_score"] == pytest.approx(w[4])
            assert r["score"] == pytest.approx(w[5], rel=0.02, abs=0.02 * w[1])  # half a step of quantising a token


def test_elias_fano():
    for values in ([], [0], [5, 5, 9, 1000], sorted(np.random.default_rng(4).integers(0, 1 << 40, 3000).tolist())):
        a = np.array(values, np.uint64)
        header, lows, bits = lm_scoring.EliasFano.encode(a, 1 << 40)
        if len(a):
            ef = lm_scoring.EliasFano(lows, bits, int(header[1]), len(a))
            x = np.unique(np.concatenate([a, a + np.uint64(1), [np.uint64(0)]]))
            at, found = ef.successor(x)
            assert at.tolist() == np.searchsorted(a, x).tolist()
            assert found.tolist() == np.isin(x, a).tolist()


def test_quality_counts(spark, documents):
    rows = [tuple(r) for r in documents] + [(1000 + i, t) for i, (_, t, _) in enumerate(ODD)]
    got = {r["doc_id"]: r for r in quality_rules.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        words = (t or "").encode().split()
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        inside = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
        want = (len(words), sum(len(w.decode()) for w in words), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside))
        assert tuple(got[i])[1:6] == want
        assert got[i]["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (got[i]["kept"] and got[i]["base_failed"])


def test_bands_keep_prose_and_reject_noise_and_repeats(spark, documents):
    rng = np.random.default_rng(5)
    noise = " ".join("".join(chr(33 + c) for c in rng.integers(0, 90, 12)) for _ in range(300))
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality(spark.createDataFrame([(0, documents[1][1]), (1, noise), (2, "\n".join(f"buy now {i} buy cheap" for i in range(900)))], "doc_id long, text string")).collect()}
    assert got == {0: True, 1: False, 2: False}


def test_mix_takes_targets(spark, odd):
    sizes = odd.select("source", mixing.word_count(odd["text"]).alias("size"))
    total = sum(len((t or "").encode().split()) for _, t, _ in ODD)
    targets = mixing.source_targets(sizes).collect()
    assert sum(r["target"] for r in targets) == pytest.approx(total)
    rows = mixing.taken_by_document(mixing.mix(odd)).collect()
    assert len(rows) == len(ODD) and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    taken = Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
    assert all(taken[r["source"]] == round(r["target"]) for r in targets)


def test_leaks(spark, odd):
    bench = spark.createDataFrame([("q1", "One, TWO"), ("q2", LONG[300:400]), ("q3", None), (None, "ha"), ("q4", "--")], "item_id string, text string")
    got = {(r["doc_id"], r["n_words"]): r["items"] for r in decontamination.find_hits(odd, bench).collect()}
    assert got[3, 2] == ["q1"] and got[4, 30_000] == ["q2"] and got[7, 400] == []
    blocks = decontamination.find_hits(odd.dropDuplicates(["doc_id"]), bench, block_bytes=1).collect()
    assert {(r["doc_id"], tuple(r["items"]), r["n_hit"]) for r in blocks} == {(r["doc_id"], tuple(r["items"]), r["n_hit"]) for r in decontamination.find_hits(odd.dropDuplicates(["doc_id"]), bench).collect()}
    left = decontamination.remove_contaminated(odd, bench)
    assert left.columns == odd.columns and {r["doc_id"] for r in left.collect()} == {1, 2, None, 6, 7, 8, 9} - ({None} if got[None, len(LONG[:5000].split())] else set())
    spans = decontamination.remove_contaminated(spark.createDataFrame([(1, "a one two, b")], "doc_id long, text string"), bench, "spans")
    assert spans.first()["text"] == "a , b"


def test_urls(spark):
    rows = [(1, "http://A.Org"), (2, "https://a.org/x"), (3, "http://b.example.org/es/1?q"), (4, "http://example.org/en/12"), (5, None), (6, "no scheme"), (7, "http://x.com/fr/"), (8, "http://x.com/de/#a"), (9, "http://xorg/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, good int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.filter_urls(pages, none).collect()}
    assert got == {1: ("a.org", "", None, "allow"), 2: ("a.org", "/x", "org/", "allow"), 3: ("b.example.org", "/es/1", "example.org/es/", "block"), 4: ("example.org", "/en/12", "example.org/en/1", "block"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("x.com", "/fr/", "com/fr/", "allow"), 8: ("x.com", "/de/", "com/de/", "block"), 9: ("xorg", "/", None, "allow")}
    bad = spark.createDataFrame([(i, f"http://{'bad' if i < 40 else 'good'}.net/{i}") for i in range(80)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i >= 40)) for i in range(80)] + [(None, 1), (3, None)], "page_id long, good int")
    assert {(r["host"], r["verdict"]) for r in url_filters.filter_urls(bad, labels).collect()} == {("bad.net", "block"), ("good.net", "allow")}


def test_licenses(spark):
    rows = [(1, "Code.\nReleased under the MIT License."), (2, None), (3, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; hello. either version 3 of the License, or (at your option) any later version."), (4, "either version 3 of the License, or (at your option) any later version.")]
    got = {r["doc_id"]: r["license"] for r in license_scans.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "MIT", 2: None, 3: "GPL-3.0-or-later", 4: None}


def test_odd_and_empty_tables(spark, odd):
    bench = spark.createDataFrame([], "item_id string, text string")
    model = tokenizer_path("piece_bpe_32k.model")
    plain = odd.select("doc_id", "text")
    for df, n in ((odd, len(ODD)), (odd.limit(0), 0)):
        for f in (quality_rules.quality, license_scans.scan_licenses, simhash_dedup.near_duplicates, lm_scoring.score, lambda d: decontamination.find_hits(d, bench), lambda d: token_counts.token_counts(d, model), lambda d: mixing.taken_by_document(mixing.mix(d))):
            assert f(df).count() == n
        cut = plain.limit(n)
        assert substring_dedup.remove_repeated_windows(cut).count() == suffix_dedup.remove_repeated_bytes(cut).count() == n


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, SF)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    one = corpus_pipeline.near_duplicates(spark, kept, SF)
    near = simhash_dedup.near_duplicates(kept).collect()
    assert sorted(r["doc_id"] for r in one.collect()) == sorted({r["component_id"] for r in near})
    cut = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, one, SF).collect()}
    assert cut == without_bytes([(r["doc_id"], r["text"]) for r in one.collect()])
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("window", [5, 20, 28, 45])
def test_repeated_windows_of_other_lengths(spark, window):
    rng = np.random.default_rng(window)
    passage = [" ".join(f"w{x}" for x in rng.integers(0, 3000, 60)) for _ in range(20)]
    rows = [(i, " ".join(passage[j] for j in rng.integers(0, 20, 3)) + f" u{i} v{i}") for i in range(60)] + [(60 + i, " ".join(rng.choice(list("abc"), 60))) for i in range(8)]
    got = substring_dedup.remove_repeated_windows(spark.createDataFrame(rows, "doc_id long, text string"), window=window).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], sha(bytes(r["kept"]))) for r in got) == sorted(plain_words(rows, window))


def test_matching_statistics():
    codes = np.concatenate([np.random.default_rng(6).integers(1, 8, 3000), [0]]).astype(np.uint8)
    at = np.arange(0, 2970, 7)
    length, low, high = substring_dedup.FMIndex(codes, 30).match(codes, at, 30)
    text = codes.tobytes()

    def twice(p):
        return text.find(p, text.find(p) + 1) >= 0

    assert length.tolist() == [max(n for n in range(31) if twice(text[i + 30 - n : i + 30])) for i in at.tolist()]


def test_columns_of_any_name_pass_the_repeat_removers(spark):
    from pyspark.sql import functions as F

    clash = ["row", "N_Words", "kept", "_id", "_key", "_chunk", "_text", "_new", "new", "chunk", "cuts", "n_bytes", "odd.name"]
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string").select("doc_id", "text", *[F.lit(f"old {c}").alias(c) for c in clash])
    words = substring_dedup.remove_repeated_windows(df)
    assert words.columns == ["doc_id", "text", *[c for c in clash if c not in ("N_Words", "kept")], "n_words", "n_removed", "kept"]
    assert sorted((r["doc_id"], r["n_words"], r["_text"], r["odd.name"]) for r in words.collect()) == [(1, 2, "old _text", "old odd.name"), (2, 0, "old _text", "old odd.name")]
    assert suffix_dedup.remove_repeated_bytes(df).count() == 2
    kept = suffix_dedup.keep_unrepeated(df)
    assert kept.columns == df.columns and sorted(map(str, kept.collect())) == sorted(map(str, df.collect()))


def test_schedule_has_low_discrepancy(spark):
    targets = [1000.0, 2500.0, 500.0, 6000.0]
    df = spark.createDataFrame(list(enumerate(targets, 1)), "source_no int, target double")
    slots = 1 << 12
    rows = sorted((r["slot"], r["source_no"], r["rank"]) for r in mixing.schedule(df, slots).collect())
    total, count = sum(targets), Counter()
    n_slots = math.ceil(total / math.ceil(total / slots))
    for n, (slot, source, rank) in enumerate(r for r in rows if r[0] < n_slots):
        assert rank == count[source]
        count[source] += 1
        for i, t in enumerate(targets, 1):
            assert abs(count[i] - (slot + 1) * t / total) <= 4
    assert sum(r[0] >= n_slots for r in rows) <= 2 * len(targets)  # blocks that the points left over


def test_trie_between_pointers():
    rng = np.random.default_rng(8)
    words = np.sort(rng.integers(0, 1 << 64, 400, np.uint64))
    pairs = sorted({(int(c), int(k)) for c, k in zip(rng.integers(0, 400, 5000), rng.integers(0, 1 << 45, 5000))})
    counts = rng.integers(1, 1 << 40, 400)
    context, keys = np.array([c for c, _ in pairs]), np.array([k for _, k in pairs], np.uint64)
    trie = lm_scoring.Trie(lm_scoring.Trie.build(words, counts, context, keys, rng.integers(1, 9, len(pairs)), 0.7))
    got, at = trie.count(np.concatenate([words, words + np.uint64(1)]))
    assert got.tolist() == [*counts.tolist(), *[0] * 400] and at.tolist() == [*range(400), *[-1] * 400]
    assert trie.first.access(np.arange(401)).tolist() == np.searchsorted(context, np.arange(401)).tolist()
    assert (trie.code(context, keys) > 0).all() and not trie.code((context + 1) % 400, keys).any() and not trie.code(np.full(9, -1), keys[:9]).any()
    assert trie.followers.lows.strides[0] < 8


def test_a_stored_model_scores_alike(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id % 3 < 2")  # a small fixture
    sizes = {"shard_bytes": 1 << 16, "chunk_bytes": 1 << 17}
    lm_scoring.train(docs, str(tmp_path / "model"), **sizes)
    want = {r["doc_id"]: tuple(r) for r in lm_scoring.score(docs, **sizes).collect()}
    got = {r["doc_id"]: tuple(r) for r in lm_scoring.score_with(docs, str(tmp_path / "model"), chunk_bytes=1 << 16).collect()}
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert got[i][1:5] == w[1:5] and got[i][5:] == pytest.approx(w[5:])
    other = lm_scoring.score_with(spark.createDataFrame([(1, "never seen words zzzq"), (None, None)], "doc_id long, text string"), str(tmp_path / "model")).collect()
    assert sorted(r["n_tokens"] for r in other) == [1, 5]


def test_token_counts_of_all_documents_equal_the_library(spark, documents):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r["n_tokens"] for r in queries()["op8_token_counts"](spark, SF).collect()}
    assert got == {i: len(sp.encode(t or "")) for i, t in documents}


def plain_verdict(text):
    import zstandard

    t = (text or "").encode()
    words = t.split()
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    inside = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
    if len(words) < 10 or 100 * len(inside) > 20 * len(words):
        return False
    squeeze = lambda x: len(x) / len(zstandard.ZstdCompressor(level=3).compress(x))
    band = lambda bands, n: [(lo, hi) for upto, lo, hi in bands if n <= upto][0]
    lo, hi = band(quality_rules.BANDS, len(t))
    if not lo <= squeeze(t) <= hi:
        return False
    outside = 0
    for k in range(-(-len(t) // 1024)):
        piece = t[1024 * k : 1024 * k + 1024]
        lo, hi = band(quality_rules.CHUNK_BANDS, len(piece))
        outside += 0 if lo <= squeeze(piece) <= hi else len(piece)
    return outside <= 0.1 * len(t)


def test_quality_verdicts(spark, documents):
    got = {r["doc_id"]: r["kept"] for r in queries()["op4_quality_rules"](spark, SF).collect()}
    assert got == {i: plain_verdict(t) for i, t in documents} and 0 < sum(got.values()) < len(got)


def test_pipeline_against_a_plain_version(spark):
    import re

    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    left = {i: t for i, t in left.items() if plain_verdict(t)}

    def five(t):
        w = (t or "").translate(LOWER).encode().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    sets, label = {i: five(t) for i, t in left.items()}, {i: i for i in left}
    links = [(i, j) for i in sets for j in sets if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for _ in sets:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    left = without_bytes([(i, t) for i, t in left.items() if label[i] == i])
    words = lambda t: re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", (t or "").translate(LOWER))
    items = [words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + min(10, len(w))]) for w in items if w for k in range(len(w) - min(10, len(w)) + 1)}
    sizes = {len(w) for w in windows}
    left = {i: t for i, t in left.items() if not any(tuple(w[k : k + n]) in windows for w in [words(t)] for n in sizes for k in range(len(w) - n + 1))}
    now = docs
    for name in ("quality rules", "near duplicates", "repeated passages", "benchmark leaks"):
        now = stages[name](spark, now, SF)
        assert now.columns == docs.columns
    rows = now.collect()
    assert {r["doc_id"]: r["text"] for r in rows} == left and len(rows) == len(left)
    mixed = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in mixed} <= set(left)
    taken, target = Counter(), {}
    for r in mixed:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 < r["taken"] <= 3 * r["size"] == 3 * len((left[r["doc_id"]] or "").encode().split())
    assert all(taken[x] == round(t) for x, t in target.items())
