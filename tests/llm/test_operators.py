"""Each operator against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skycast.llm import bpe, knn, labelled, packing, quality, sharding, simhash, spotsigs, substrings, toxicity, warc

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon the of and to in".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + (f"{rng.randint(0, 99)}" if rng.random() < 0.4 else "") for _ in range(n))


def odd_texts():
    return [None, "", " \n\t ", "a", "one two three", prose(1, 3000), prose(2, 40), prose(2, 40), "Ünï çødé 日本語 👍🏽 text", "x" * 5000, "a b\x1cc  d\r\n e"]


def documents(spark, texts, extra=True):
    rows = [(i, t, "en", "src0", len(t or ""), i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score long")
    return df if extra else df.drop("score")


EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


# --- sharding ---------------------------------------------------------------------------------


def test_rendezvous_moves_keys_only_into_the_new_shard(spark):
    df = spark.range(3000).select(F.col("id").alias("key"), F.lit("x").alias("shard"), F.lit(1).alias("sub"), F.lit(1).alias("FIRST"))
    rows = sharding.rendezvous(df, "key", [1, 1, 2], added=[1]).collect()
    assert len(rows) == 3000 and set(rows[0].asDict()) == {"key", "shard", "slot", "grown_shard", "sub", "FIRST"}
    sizes = Counter(r.shard for r in rows)
    assert 0.45 < sizes[2] / 3000 < 0.55
    for s, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    assert {r.grown_shard for r in rows if r.grown_shard != r.shard} == {3}


def test_rendezvous_of_nulls_repeats_and_nothing(spark):
    df = spark.createDataFrame([(None,), (None,), (5,), (5,)], "key long")
    rows = sharding.rendezvous(df, "key", [1.0] * 4).collect()
    assert len({r.shard for r in rows if r.key is None}) == 1 == len({r.shard for r in rows if r.key == 5})
    assert len({(r.shard, r.slot) for r in rows}) == 4 and {r.grown_shard for r in rows} == {None}
    assert sharding.rendezvous(df.limit(0), "key", [1.0]).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("key"), [1, 0])


# --- packing --------------------------------------------------------------------------------------


def test_packing_holds_the_librarys_ids_without_gaps(spark):
    from tokenizers import Tokenizer

    texts = [*odd_texts(), "It's 12,3 ... we'LL\nΣΊΣΥΦΟΣ, ΣΑΣ. İstanbul K é ﬁ ß <|endoftext|>, x!! (y) z###", prose(5, 700)]
    texts += ["hello <|endoftext|> world", "a<|startoftext|>B <|endoftext|><|endoftext|>.", "<|ENDOFTEXT|> <|endoftext| >", "<|endoftext|>\u0301 e\u0301"]
    rows = packing.pack_documents(documents(spark, texts), capacity=256, keep_ids=True).collect()
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        own = sorted(by_doc[i], key=lambda r: r.piece)
        want = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        assert np.frombuffer(b"".join(bytes(r.ids) for r in own), "<u4").tolist() == want
        assert all(r.length == 256 for r in own[:-1]) and [r.start for r in own] == [256 * k for k in range(len(own))]
        assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) for r in own)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert packing.pack_documents(spark.createDataFrame([], EMPTY)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once_and_tightly(seed):
    rng = random.Random(seed)
    capacity = 100
    counts = {n: rng.randint(0, 400) for n in rng.sample(range(1, capacity + 1), rng.randint(1, 60))}
    used = defaultdict(list)
    seen = Counter()
    for size, first, n, sequence, per, offset in packing.plan(counts, capacity):
        assert first == seen[size]
        seen[size] += n
        for i in range(n):
            used[sequence + i // per].append((offset + i % per * size, size))
    assert seen == Counter({k: v for k, v in counts.items() if v})
    for own in used.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= capacity and sum(3 * size > capacity for _, size in own) <= 2
    # first-fit decreasing one by one as the yardstick
    bins: list[int] = []
    for size in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):
        k = next((k for k, gap in enumerate(bins) if gap >= size), None)
        if k is None:
            bins.append(capacity - size)
        else:
            bins[k] -= size
    assert len(used) <= len(bins) * 1.02 + 1


# --- classifiers -----------------------------------------------------------------------------


def test_toxicity_learns_words_and_scores_any_text(spark):
    texts = [prose(i, 60) + (" you stupid clown" if i % 3 == 0 else "") for i in range(300)]
    rows = spark.createDataFrame([(t, int(i % 3 == 0)) for i, t in enumerate(texts)] + [(None, 0), ("", None)], "text string, y int")
    model = toxicity.fit(rows)
    unseen = [prose(1000 + i, 80) + (" What a CLOWN, stupid" if i % 2 else "") for i in range(40)]
    got = {r.doc_id: r.score for r in toxicity.score(documents(spark, unseen), model).collect()}
    assert min(v for i, v in got.items() if i % 2) > 10 * max(v for i, v in got.items() if i % 2 == 0)
    odd = toxicity.score(documents(spark, odd_texts()), model).collect()
    assert len(odd) == 11 and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score(spark.createDataFrame([], EMPTY), model).count() == 0


def test_toxicity_without_both_classes_is_the_share(spark):
    one = toxicity.fit(spark.createDataFrame([("a b", 1), ("c", 1)], "text string, y int"))
    assert not len(one.weights) or not one.weights.any()
    none = toxicity.fit(spark.createDataFrame([], "text string, y int"))
    got = toxicity.score(documents(spark, ["a"]), none).first()
    assert 0 <= got.score <= 1


def test_cells_of_a_long_text_are_those_of_its_blocks(monkeypatch):
    text = prose(3, 400)
    whole = toxicity.cells(text)
    monkeypatch.setattr(toxicity, "BLOCK", 97)
    assert (toxicity.cells(text) == whole).all()


def test_quality_rules_separate_junk_and_compile_to_columns(spark):
    rng = random.Random(0)
    good = [prose(i, rng.randint(20, 200)).capitalize() + "." for i in range(200)]
    bad = [" ".join(w + "###" for w in prose(i, 50).split()) if i % 2 else " ".join([rng.choice(WORDS)] * 60) for i in range(200)]
    docs = documents(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(400)] + [(None, 1), (3, None), (10**6, 1)], "doc_id long, quality int")
    rules = quality.fitted(docs, labels)
    assert 0 < len(rules.rules) < 200
    got = {r.doc_id: r.score for r in quality.score(docs, rules).collect()}
    assert sum((got[i] >= 0.7) == (i < 200) for i in range(400)) >= 392
    x = np.array([quality.statistics(t) for t in good + bad])
    z = rules.intercept + sum(w * quality._holds(x, r) for r, w in zip(rules.rules, rules.weights))
    assert np.allclose([got[i] for i in range(400)], 1 / (1 + np.exp(-z)))
    odd = quality.score(documents(spark, odd_texts()), rules)
    assert odd.columns[-1] == "score" and all(0 <= r.score <= 1 for r in odd.collect())
    assert quality.score(spark.createDataFrame([], EMPTY), rules).count() == 0
    assert quality.fitted(spark.createDataFrame([], EMPTY), labels.limit(0)).rules == []


def test_rows_of_a_tree_are_a_parameter(monkeypatch):
    x = np.random.default_rng(0).random((300, len(quality.STATISTICS)))
    y = (x[:, 0] > 0.5).astype(float)
    assert quality._paths(x, y, np.random.default_rng(0))
    monkeypatch.setattr(quality, "TREE_ROWS", 2 * quality.LEAST - 1)
    assert not quality._paths(x, y, np.random.default_rng(0))


def test_sample_is_bounded_and_keeps_out_the_held_out_fold(spark):
    docs = documents(spark, [prose(i, 5) for i in range(500)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(500)], "doc_id long, toxic int")
    got = labelled.sample(docs, labels, "toxic", labelled.fold("doc_id", 5) != 0, most=100).collect()
    assert 60 < len(got) < 140 and all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in got)


# --- top-k ----------------------------------------------------------------------------------------


def vectors(spark, n=400, d=8, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[: n // 3] = x[0]  # a third of all rows are one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(n, None), (n + 1, [float("nan")] + [0.0] * (d - 1)), (n + 2, [None] + [0.0] * (d - 1)), (n + 3, [float("inf")] * d), (None, [0.0] * d)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>"), np.floor(1024 * x.astype(float))


def test_top_k_is_exact_with_ties_to_the_smaller_id(spark):
    df, x = vectors(spark)
    whole = knn.whole_vectors(df)
    got = defaultdict(list)
    for r in knn.top_k(whole, whole.where("vec_id % 20 = 0"), k=7, pivots=12).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q in range(0, 400, 20):
        s = (x @ x[q]).astype(int)
        want = sorted(((-s[i], i) for i in range(400) if i != q))[:7]
        assert got[q] == [(i, -v) for v, i in want]


def test_top_k_with_few_or_no_rows(spark):
    df, _ = vectors(spark, n=3)
    whole = knn.whole_vectors(df)
    assert knn.top_k(whole, whole, k=10).groupBy("query_id").count().collect() and knn.top_k(whole, whole, k=10).count() == 6
    assert knn.top_k(whole, whole.limit(0)).count() == 0 == knn.top_k(whole.limit(0), whole).count()
    same = spark.createDataFrame([(i, [0.0, 0.0]) for i in range(5)], "vec_id long, embedding array<float>")
    assert knn.top_k(knn.whole_vectors(same), knn.whole_vectors(same), k=2).count() == 10


def test_voronoi_bounds_replicate_only_some_data(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 4)) * 40
    rows = [(i, (centres[i % 12] + rng.normal(size=4) * 0.2).tolist()) for i in range(600)]
    whole = knn.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    pivots = knn.pick_pivots(whole, 12)
    data = knn._grouped(whole, pivots)
    plan = knn.join_plan(data, data.where("vec_id % 50 = 0"), pivots, pivots, 5)
    assert 0 < sum(map(len, plan.values())) < 12 * 12 / 2


# --- SimHash ----------------------------------------------------------------------------------


def slow_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    if not words:
        return 0
    hashes = [xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_are_those_of_the_definition():
    for t in [*odd_texts(), "A b C d e", "ÄÖ ab cd x y z"]:
        assert simhash.fingerprint(t or "") == slow_fingerprint(t)


@pytest.mark.parametrize("bits", [8, 12])
def test_ball_hashing_finds_every_link_of_up_to_four_bits(bits):
    rng = random.Random(bits)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for f in fps[:30]:
        for d in (1, 2, 3, 4, 5, 6):
            fps.append(f ^ sum(1 << b for b in rng.sample(range(64), d)))
    fps = np.unique(np.array(fps, np.uint64))
    want = {(int(a), int(b)) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin(int(a) ^ int(b)).count("1") <= 4}
    got = np.concatenate([simhash.collide(fps[simhash._ones((fps >> np.uint64(64 - bits)) ^ np.uint64(p)) <= 2], p, bits) for p in range(1 << bits)])
    assert roots(want) == roots((int(a), int(b)) for a, b in got)


def roots(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in list(parent)}


def test_rounds_lose_no_link(monkeypatch):
    rng = random.Random(3)
    base = rng.getrandbits(56)
    fps = np.unique(np.array([base ^ (1 << b) ^ (1 << (b + 7) % 56) for b in range(50)], np.uint64))
    whole = roots((int(a), int(b)) for a, b in simhash.collide(fps, 0, 8))
    monkeypatch.setattr(simhash, "AT_ONCE", 5_000)
    assert roots((int(a), int(b)) for a, b in simhash.collide(fps, 0, 8)) == whole


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(8, 40)] + [(3, 3), (40, 7)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {k: v for k, v in roots(links).items() if k != v}
    assert got == want


def test_each_group_keeps_a_row_if_an_id_has_different_texts(spark):
    a, b, c = prose(1, 200), prose(2, 200), prose(3, 200)
    rows = [(1, a), (1, b), (1, b), (2, a), (3, b), (0, c), (1, c), (4, c), (None, a), (None, prose(5, 200)), (None, prose(5, 200))]
    out = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, out.collect()), key=key) == sorted([(1, a), (1, b), (0, c), (None, prose(5, 200)), (None, prose(5, 200))], key=key)


def test_groups_take_the_smallest_id_and_keep_one(spark):
    t = prose(9, 400)
    texts = [prose(1, 50), t, t + " ", t.upper(), None, "", " ", prose(2, 50)]
    groups = {r.doc_id: r.component_id for r in simhash.near_groups(documents(spark, texts)).collect()}
    assert groups == {0: 0, 1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 7}
    kept = simhash.keep_one(documents(spark, texts).union(documents(spark, texts)))
    assert kept.columns == documents(spark, texts).columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 4, 7]
    null = spark.createDataFrame([(None, t), (5, t)], "doc_id long, text string")
    assert {r.component_id for r in simhash.near_groups(null).collect()} == {5}
    assert simhash.near_groups(spark.createDataFrame([], EMPTY)).count() == 0 == simhash.keep_one(spark.createDataFrame([], EMPTY)).count()


# --- SpotSigs -----------------------------------------------------------------------------------


def slow_signatures(text):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    content = [w for w in words if w not in spotsigs.ANCHORS]
    chains, k = {("", *content[:3])}, 0
    for w in words:
        if w in spotsigs.ANCHORS:
            if content[k:]:
                chains.add((w, *content[k : k + 3]))
        else:
            k += 1
    return chains


def test_signatures_match_the_definition_and_next_wraps_round(spark):
    texts = [prose(i, 30 + i) for i in range(20)]
    rows = spotsigs.with_signatures(documents(spark, texts), "text", "signatures").collect()
    for a in rows:
        assert len(a.signatures) == len(slow_signatures(a.text)) and a.signatures == sorted(a.signatures)
    a, b = rows[0].signatures, rows[1].signatures
    sa, sb = slow_signatures(texts[0]), slow_signatures(texts[1])
    assert len(set(a) & set(b)) == len(sa & sb)
    for ranges in (1, 4, 128):
        got = {r.doc_id: r.next_text for r in spotsigs.with_next(documents(spark, texts), ["text"], ranges).collect()}
        assert got == {i: texts[i - 1] for i in range(20)}


def test_signatures_and_next_of_odd_rows(spark):
    docs = documents(spark, [*odd_texts(), "the of and", "the of", "!!!", "???"])
    rows = {r.doc_id: r for r in spotsigs.with_signatures(docs.withColumn("spot_words", F.lit(1)), "text", "signatures").collect()}
    assert rows[0].signatures == rows[1].signatures == [] and all(rows[i].signatures for i in range(2, 15))
    assert rows[6].signatures == rows[7].signatures and rows[11].signatures != rows[12].signatures and rows[13].signatures != rows[14].signatures
    with_null = docs.union(docs.where("doc_id = 3")).union(docs.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    assert spotsigs.with_next(with_null, ["text"], 4).count() == 17
    one = spotsigs.with_next(docs.where("doc_id = 3"), ["text"]).first()
    assert one.next_text == one.text
    assert spotsigs.with_next(docs.limit(0), ["text"]).count() == 0
    pair = spark.createDataFrame([([], []), ([], [1]), ([1, 2, 3], [2, 3, 4])], "a array<long>, b array<long>")
    assert [r.x for r in pair.select(spotsigs.likeness(F.col("a"), F.col("b")).alias("x")).collect()] == [1.0, 0.0, 0.5]


def test_near_pairs_are_all_pairs_over_the_limit(spark):
    rng = random.Random(4)
    base = [prose(i, 120).split() for i in range(12)]
    texts = []
    for w in base:
        for cut in (0, 1, 2, 6, 20):
            v = list(w)
            for _ in range(cut):
                v[rng.randrange(len(v))] = "changed" + str(rng.random())
            texts.append(" ".join(v))
    texts += texts[:3]
    members, pairs = spotsigs.near_pairs(documents(spark, texts), least=0.6)
    class_of = {r.doc_id: r.class_id for r in members.collect()}
    assert len(class_of) == 63 and class_of[60] == 0
    s = [slow_signatures(t) for t in texts[:60]]
    assert all((class_of[i] == class_of[k]) == (s[i] == s[k]) for i in range(60) for k in range(60))
    alike = {(i, k) for i in range(60) for k in range(i + 1, 60) if len(s[i] & s[k]) / len(s[i] | s[k]) >= 0.6}
    want = {tuple(sorted((class_of[i], class_of[k]))) for i, k in alike if class_of[i] != class_of[k]}
    assert {(r.a_id, r.b_id) for r in pairs.collect()} == want


# --- BPE --------------------------------------------------------------------------------------------


def test_ids_and_bytes_are_the_librarys(spark):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    assert bpe.read_ranks(public_tokenizers.path(bpe.RANKS)) == ranks
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = [*odd_texts(), "it's  Don't a,b.  \n\n x\n y \t z ", "a ", "\n x", "<|endoftext|> Ⅷ ½ ² ʰ", "ab" * 400, "".join(rng.choice("abcdefgh") for _ in range(3000))]
    texts += ["".join(rng.choice(" \n\ta.'sé1,\xa0") for _ in range(rng.randint(1, 30))) for _ in range(200)]
    docs = documents(spark, texts)
    got = {r.doc_id: r for r in bpe.encode(docs, ranks, public_tokenizers.PATTERN).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i].ids == own.encode_ordinary(t or "") and bytes(got[i].decoded) == (t or "").encode()
    ids = bpe.encode(docs.where("doc_id < 8"), ranks, public_tokenizers.PATTERN).drop("decoded")
    assert all(bytes(r.decoded) == (texts[r.doc_id] or "").encode() for r in bpe.decode(ids, ranks).collect())
    d = {r.doc_id: r for r in bpe.digests(docs.where("doc_id < 4"), ranks, public_tokenizers.PATTERN).collect()}
    assert d[0].n_tokens == 0 and d[0].ids_sha256 == hashlib.sha256(b"").hexdigest() == d[1].decoded_sha256
    assert bpe.encode(spark.createDataFrame([], EMPTY), ranks, public_tokenizers.PATTERN).count() == 0


def test_a_full_dictionary_starts_again(spark, monkeypatch):
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path(bpe.RANKS))
    docs = documents(spark, [prose(i, 60) for i in range(30)]).coalesce(1)
    whole = bpe.digests(docs, ranks, public_tokenizers.PATTERN).orderBy("doc_id").collect()

    class Now:
        value = ranks

    monkeypatch.setattr(bpe, "DICTIONARY", 50)
    import pyarrow as pa
    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "text": prose(i, 60)} for i in range(30)])
    rows = [r for b in bpe._referred(public_tokenizers.PATTERN, Now)(iter([batch])) for r in b.to_pylist()]
    assert sum(r["starts"] for r in rows) > 3
    for k, r in enumerate(rows):
        r["ids"] = None if r["word"] is None else bpe.merged_long(r["word"].encode("latin-1"), ranks)
        r["back"] = r["word"]
    table = pa.table({"starts": [r["starts"] for r in rows], "doc_id": [r["doc_id"] for r in rows], "refs": pa.array([r["refs"] for r in rows], pa.binary()), "ids": pa.array([r["ids"] for r in rows], pa.list_(pa.int32())), "back": pa.array([r["back"] for r in rows], pa.string())})
    finish = lambda d, ids, back: (d, hashlib.sha256(ids).hexdigest())
    out = [r for b in bpe._joined(finish, ["doc_id", "h"], [pa.int64(), pa.string()])(iter(table.to_batches())) for r in b.to_pylist()]
    assert [r["h"] for r in out] == [r.ids_sha256 for r in whole]


# --- WARC ---------------------------------------------------------------------------------------


def test_derivatives_link_to_their_source_and_each_other(spark, tmp_path):
    html = "<html><head><title> A &amp; B </title><style>x{}</style></head><body><p>Hi&nbsp;there</p><script>var a='<p>';</script><!-- c --><a href='u'>link</a><br>end &lt;1&gt;</body></html>"
    pages = spark.createDataFrame([(1, "http://a/", html), (2, None, None), (1, "http://a/", html), (3, "http://b/", ""), (None, "u", "plain")], "page_id long, url string, html string").withColumn("payload", F.lit(1))
    records = warc.responses(pages)
    rows = warc.derive(records).collect()
    assert len(rows) == 8 and len({r.record_id for r in rows}) == 8
    by = {(r.refers_to, r.warc_type): r for r in rows}
    sources = {r.record_id: r for r in records.collect()}
    for (source, kind), r in by.items():
        other = by[source, "metadata" if kind == "conversion" else "conversion"]
        assert r.concurrent_to == other.record_id and r.target_uri == sources[source].target_uri and r.source_headers == sources[source].headers
        assert r.block_digest == "sha256:" + hashlib.sha256(r.content.encode()).hexdigest()
        assert r.payload_digest == "sha256:" + hashlib.sha256(sources[source].payload.encode()).hexdigest()
    first = next(r for r in rows if r.target_uri == "http://a/" and r.warc_type == "conversion")
    assert first.content == "Hi there\nlink\nend <1>"
    meta = by[first.refers_to, "metadata"].content.split("\r\n")
    assert meta[:2] == ["title: A & B", "outlinks: 1"]
    warc.write(warc.derive(records), str(tmp_path / "out"), compression="none")
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    seen = 0
    while raw:
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        n = int(fields["Content-Length"])
        assert head.startswith(b"WARC/1.1\r\n") and rest[n : n + 4] == b"\r\n\r\n"
        assert fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(rest[:n]).hexdigest()
        raw, seen = rest[n + 4 :], seen + 1
    assert seen == 8
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


# --- substrings ------------------------------------------------------------------------------


def slow_spans(rows, window=13):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


def repeating_rows():
    rng = random.Random(7)
    passages = [prose(100 + i, rng.randint(13, 80)) for i in range(12)]
    rows = []
    for i in range(120):
        parts = [prose(i, rng.randint(0, 40)), rng.choice(passages), prose(500 + i, rng.randint(0, 30))]
        if i % 7 == 0:
            parts.append("the the the " * rng.randint(1, 20))
        rows.append((i, rng.choice(["\n", " ", "\t "]).join(parts)))
    rows += [(200 + i, t) for i, t in enumerate(odd_texts())]
    return [*rows, (5, rows[5][1]), (5, rows[9][1]), (None, rows[3][1]), (None, None)]


def test_removed_words_are_those_of_the_definition(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 3_000)
    rows = repeating_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substrings.spans(docs, shard_words=2_000).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(slow_spans(rows), key=key)
    assert sum(r.n_removed for r in got) > 1000
    assert substrings.spans(docs.limit(0)).count() == 0


def test_a_line_in_many_documents_loads_no_shard(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 3_000)
    line, passage = "sharedline0 sharedline1 sharedline2 sharedline3 sharedline4 sharedline5", prose(77, 40)
    rows = [(i, f"{prose(1000 + i, 30)} {line} {passage + ' ' if i % 20 == 0 else ''}{prose(3000 + i, 30)}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substrings.spans(docs, shard_words=4_000, key_windows=200).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(slow_spans(rows))
    assert sum(r.n_removed for r in got) > 500
    _, found, routes = substrings.repeated(docs, shard_words=4_000, key_windows=200)
    windows = {r["shard"]: r["n"] / 8 for r in found.groupBy("shard").agg(F.sum(F.length("mins")).alias("n")).collect() if r["n"]}
    assert max(windows.values()) < 400 and any(s >= routes.keys for s in windows)  # the line alone has about 2,000


def test_text_keeps_what_is_not_repeated(spark):
    rows = [(i, t, len(t or "")) for i, t in repeating_rows()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumn("spans", F.lit("own"))
    out = substrings.without_repeats(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) == len(rows) and {r.spans for r in got} == {"own"}
    want = Counter((i, h) for i, _, _, h in slow_spans([r[:2] for r in rows]))
    assert Counter((r.doc_id, hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) for r in got) == want
    assert all(r.n_chars == len(r.text) for r in got if r.text is not None)


def test_index_finds_windows_of_texts_that_it_does_not_hold():
    texts = [prose(1, 40).encode(), prose(2, 60).encode(), prose(1, 20).encode()]
    asked = [b" ".join(prose(1, 40).encode().split()[3:30]), b"unknown " * 20 + prose(2, 15).encode(), prose(9, 30).encode()]
    asked = [b" ".join(a.split()) for a in asked]
    got = substrings.match(texts, [5, 3, 9], asked)
    none = np.iinfo(np.int64).max
    for a, found in zip(asked, got):
        w = a.split(b" ")
        for k, v in enumerate(found.tolist()):
            part = b" " + b" ".join(w[k : k + 13]) + b" "
            assert v == min((d for t, d in zip(texts, [5, 3, 9]) if part in b" " + t + b" "), default=none)


def test_index_tries_a_word_again_with_a_shorter_pattern():
    a = " ".join(f"a{k}" for k in range(1, 14))
    none = np.iinfo(np.int64).max
    assert [x.tolist() for x in substrings.match([a.encode(), b"z"], [4, 2], [f"{a} z".encode()])] == [[4, none]]
    rng = random.Random(3)
    make = lambda n: [rng.choice("abc") for _ in range(n)]
    texts, asked = [make(rng.randint(1, 60)) for _ in range(12)], [make(rng.randint(4, 60)) for _ in range(40)]
    asked += [texts[k][5:25] + ["z"] + texts[k][:9] for k in range(12) if len(texts[k]) > 20]
    got = substrings.match([" ".join(t).encode() for t in texts], list(range(12)), [" ".join(q).encode() for q in asked], 4)
    for q, found in zip(asked, got):
        want = [min((i for i, t in enumerate(texts) if any(t[j : j + 4] == q[k : k + 4] for j in range(len(t)))), default=none) for k in range(len(q) - 3)]
        assert found.tolist() == want
