"""Collocations, byte-level BPE and centroid clustering against brute force and the tokenizer's own library."""

import hashlib
import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from textloom.llm import byte_bpe, collocations, drake, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def brute_collocations(rows, max_n=3, min_count=10, covered=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, max_n + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, own in f.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= min_count}
        kept = []
        for p, a in candidates.items():
            inside = any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items())
            if not inside:
                score, _, l, r = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), l, r))
        out |= {(lang, k, p.decode(), -a, l, r, n[lang], -score) for k, (score, a, p, l, r) in enumerate(sorted(kept)[:top], 1)}
    return out


def sentences(rng, n, pool):
    return "".join(rng.choice(pool) + rng.choice([" ", " ", " ", "\t ", ", ", ". ", "\n", "\x0b"]) for _ in range(n))


@pytest.fixture(scope="module")
def phrases():
    rng = random.Random(5)
    pool = ["New", "york", "city", "the", "a", "ß", "ÄRGER", "É", "x" * 50, " ", "日本", "it's", "$1", "\x1f"]
    rows = [(rng.choice(["en", "de", None, "en", "en"]), sentences(rng, rng.randrange(60), pool)) for _ in range(150)]
    return [*rows, *[("en", "big apple pie")] * 12, ("en", None), ("fr", ""), ("fr", " .,; "), ("it", sentences(rng, 20_000, pool[:6])), ("few", "one two")]


@pytest.mark.parametrize("max_n, top", [(3, 2000), (4, 2000), (2, 7)])
def test_collocations(spark, phrases, max_n, top):
    got = collocations.collocations(spark.createDataFrame(phrases, "lang string, text string"), max_n=max_n, top=top).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute_collocations(phrases, max_n, top=top)


def test_collocations_with_joined_hashes_extra_columns_and_no_rows(spark, phrases, monkeypatch):
    docs = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in phrases], "lang string, text string, h int, f int, phrase string, `size` int")
    monkeypatch.setattr(collocations.phrase_counts, "__defaults__", (0,))
    assert {tuple(r) for r in collocations.collocations(docs).collect()} == brute_collocations(phrases)
    assert not collocations.collocations(docs.limit(0)).collect()


def test_grams_of_more_words_than_a_key_holds():
    rng = random.Random(3)
    text = sentences(rng, 3000, [f"W{i}" for i in range(200)] + ["w1", "ü"] * 60).encode()
    want = defaultdict(Counter)
    for piece in re.split(rb"[.,;:!?\x0A-\x0D]", text.lower()):
        w = re.findall(rb"[^\x20\x09]+", piece)
        for k in range(1, 12):
            want[k].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for n, (columns, count, hashes) in enumerate(collocations._grams("en", text, 11), 1):
        words = [[x.encode() for x in names.take(c).to_pylist()] for names, c in columns]
        assert dict(zip(zip(*words), count.tolist())) == want[n] and len(set(hashes.tolist())) == len(want[n])


def test_rare_phrases_are_not_given_to_the_shuffle(spark, phrases, monkeypatch):
    """Of the phrases that occur less often than asked, tasks give none but those that share the bits of frequent ones."""
    given, settle = [], collocations.settle
    monkeypatch.setattr(collocations, "settle", lambda df, name: given.append(df) or settle(df, name))
    rows = spark.createDataFrame([("en", " ".join(f"v{i}x{j}" for j in range(50)) + " big apple pie") for i in range(40)], "lang string, text string").repartition(4)
    made = collocations.phrase_counts(rows, 3, 10)
    assert {(r.phrase, r.f) for r in made.collect()} == {(p, 40) for p in ("big", "apple", "pie", "big apple", "apple pie", "big apple pie")} | {("", 40 * 53)}
    plan = given[-1]._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan and "Generate" not in plan


def test_scores_beyond_64_bits(spark):
    a = 3_000_000_000
    rows = [("en", "a b", 2, a), ("en", "a", 1, a + 1), ("en", "b", 1, 2 * a)]
    (got,) = collocations.best_cuts(spark.createDataFrame(rows, "lang string, phrase string, size int, f long")).collect()
    assert (got.score, got.l, got.r) == (1_000_000 * a * a // ((a + 1) * 2 * a), a + 1, 2 * a)


def test_ranks_of_a_language_in_parts(spark):
    rows = spark.range(5000).selectExpr("case when id < 4000 then 'en' else 'de' end lang", "cast(id as string) phrase", "id % 7 score")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = [(r.lang, r.rank, r.phrase) for r in collocations.first_by_lang(rows, [rows["score"].desc(), rows["phrase"].asc()], 30, together=3).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    want = []
    for lang, ids in (("en", range(4000)), ("de", range(4000, 5000))):
        want += [(lang, k, p) for k, (_, p) in enumerate(sorted((-(i % 7), str(i)) for i in ids)[:30], 1)]
    assert sorted(got) == sorted(want)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


def odd_texts():
    rng = random.Random(7)
    alphabets = ["ab", "aab ", "abcdefghij", "the cat's 123 ñé\n\t", "日本語漢字かな", "́e😀x", "".join(map(chr, range(0x20, 0x250)))]
    out = ["".join(rng.choice(a) for _ in range(rng.choice([1, 3, 10, 50, 300]))) for a in alphabets for _ in range(60)]
    out += ["".join(c for c in map(chr, (rng.randrange(0x20, 0xD800) for _ in range(60))) if unicodedata.category(c) != "Cn") for _ in range(60)]
    return [*out, "", " ", "<|endoftext|>", "a" * 100_000, " " * 100_000, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000))]


def test_bpe_is_the_librarys(spark, library):
    texts = [*odd_texts(), None, "twice", "twice"]
    rows = spark.createDataFrame([(i, t, "x", b"old") for i, t in enumerate(texts)], "doc_id long, text string, `a b` string, tokens binary")
    made = byte_bpe.encode(rows, PATH, public_tokenizers.PATTERN)
    assert made.columns == ["doc_id", "a b", "tokens"]
    got = made.select("doc_id", byte_bpe.unpacked(made["tokens"]).alias("ids"), byte_bpe.decoded(made["tokens"], PATH).alias("back")).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id] or ""
        assert r.ids == library.encode_ordinary(text) and bytes(r.back) == text.encode()
    assert not byte_bpe.encode(rows.limit(0), PATH, public_tokenizers.PATTERN).collect()


def merged(piece, ranks):
    """The merges themselves, one at a time."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def learnt(rng, merges=25):
    """Ranks of merges learnt from random texts."""
    ranks = {bytes([b]): b for b in range(256)}
    texts = [[bytes([rng.choice(b"abc")]) for _ in range(30)] for _ in range(30)]
    for _ in range(merges):
        counts = Counter(p for t in texts for p in zip(t, t[1:]) if p[0] + p[1] not in ranks)
        if not counts:
            break
        (a, b), _ = counts.most_common(1)[0]
        ranks[a + b] = len(ranks)
        for t in texts:
            for i in range(len(t) - 1):
                if t[i : i + 2] == [a, b]:
                    t[i : i + 2] = [a + b]
    return ranks


def test_walk_gives_the_merges():
    rng = random.Random(11)
    for _ in range(60):
        ranks = learnt(rng)
        ranks.setdefault(b"abcabcabcabcaac", 999)  # most likely no merges lead to it
        own = byte_bpe.ByteBpe(ranks, most_pairs=20)
        for _ in range(40):
            piece = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 40)))
            assert own.walk(piece) == merged(piece, ranks)


def test_bpe_query(spark, sf, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op12_byte_bpe(spark, sf).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def brute_clusters(vectors, k, rounds, scale=64, seed=1):
    v = [[int(scale * x // 1) for x in e] for _, e in vectors]
    order = sorted(range(len(v)), key=lambda i: (vectors[i][0] is None, hashlib.sha256(f"{seed}:{vectors[i][0]}".encode()).hexdigest(), vectors[i][1]))
    c = [v[i] for i in order[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [near(x)[1] for x in v]
        mine = {j: [x for x, o in zip(v, own) if o == j] for j in set(own)}
        c = [[sum(col) // len(mine[j]) for col in zip(*mine[j])] if j in mine else m for j, m in enumerate(c)]
    found = [near(x) for x in v]
    total = Counter()
    for d, j in found:
        total[j] += d
    fit = lambda x: x if x < 2**63 else None
    whole = all(fit(d) is not None for d, _ in found)
    bad = {j for d, j in found if fit(d) is None}
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((i, j, fit(d), None if j in bad else fit(total[j]), fit(sum(total.values())) if whole else None, sha[j]) for (i, _), (d, j) in zip(vectors, found)), key=str)


def grouped(rng, n, size, spread, groups=9):
    middles = rng.normal(0, 1, (groups, size))
    return [(i, (middles[i % groups] + rng.normal(0, spread, size)).astype(np.float32).astype(float).tolist()) for i in range(n)]


@pytest.mark.parametrize("spread, size, k, rounds, named", [(0.1, 8, 16, 3, 4), (0.5, 8, 16, 6, 3), (1.0, 3, 7, 5, 2), (0.2, 4, 1, 2, 4), (0.3, 4, 5, 8, 1)])
def test_clusters(spark, spread, size, k, rounds, named):
    vectors = grouped(np.random.default_rng(3), 240, size, spread)
    vectors += [*vectors[:5], (7, vectors[9][1]), (None, vectors[3][1]), (1000, [0.0] * size), (1001, [0.0] * size)]
    odd = [(2000, None), (2001, [1.0] * (size - 1)), (2002, [float("nan")] * size), (2003, [float("inf")] * size), (2004, [None] + [0.0] * (size - 1)), (2005, [])]
    rows = spark.createDataFrame([(i, e, 1, 2) for i, e in vectors + odd], "vec_id long, embedding array<double>, cluster int, rest int")
    got = drake.clusters(rows, k=k, rounds=rounds, size=size, named=named).drop("measured").collect()
    assert sorted(map(tuple, got), key=str) == brute_clusters(vectors, k, rounds)


def test_clusters_measure_fewer_distances(spark):
    vectors = grouped(np.random.default_rng(4), 600, 16, 0.15, 16)
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = drake.clusters(rows, k=16, rounds=6, size=16).collect()
    assert sum(r.measured for r in got) < 0.5 * 7 * 16 * len(vectors)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == sorted(x[:3] for x in brute_clusters(vectors, 16, 6))


def test_clusters_of_large_components_few_vectors_and_none(spark):
    kind = "vec_id long, embedding array<double>"
    large = [(1, [1e6, -3e7]), (2, [2e6, 5.0]), (3, [-1e12, 1e12]), (4, [1e300, 0.1]), (5, [-1.5, 2.5]), (6, [1.7e308, -1.7e308])]
    got = drake.clusters(spark.createDataFrame(large, kind), k=3, size=2).drop("measured").collect()
    assert sorted(map(tuple, got), key=str) == brute_clusters(large_exact(large), 3, 3)
    few = [(1, [0.1, 0.2]), (2, [0.3, 0.4])]
    got = drake.clusters(spark.createDataFrame(few, kind), size=2).drop("measured").collect()
    assert sorted(map(tuple, got), key=str) == brute_clusters(few, 16, 3)
    assert not drake.clusters(spark.createDataFrame([], kind), size=2).collect()


def large_exact(vectors):
    """Components whose product with the scale is no double become whole numbers, which Python multiplies exactly."""
    return [(i, [int(x) if abs(x) > 2**53 else x for x in e]) for i, e in vectors]
