"""Core operators against brute force on small tables."""

import difflib
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from charterloom.config import Config, parse_bigram_rules, parse_phonetic_rules
from charterloom.functions import text as T
from charterloom.operators import align, autotune, bpe, chunks, encode, features, normalize, reports, similarity, threshold, vocab
from charterloom.plans import materialize as M
from charterloom.plans import pipeline
from charterloom.sources import files, tables
from charterloom.streaming.matches import match_arrivals


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()[0]


# configuration


def test_rule_strings():
    assert parse_phonetic_rules("a>b, x ,a>bc,c>d,a>e,") == {"a": "e", "c": "d"}
    assert parse_bigram_rules("ss>s,x>y,ss>ss, ie>i ,>") == {"ss": "s", "ie": "i"}
    assert len(Config.keys()) == 29


@pytest.mark.parametrize("bad", [{"ngram": 3, "n_out": 3}, {"vocab_size": "many"}, {"char_norm_alphabet": "aab"}, {"auto_threshold_method": "x"}, {"char_norm_strategy": "x"}, {"similarity_threshold": "x"}])
def test_bad_settings(bad):
    with pytest.raises(ValueError):
        Config(**bad)


# text


def test_whitespace(spark):
    every = [chr(c) for c in range(0x10000) if chr(c).isspace()]
    rows = spark.createDataFrame([(k, f" a{c}{c}b{c}") for k, c in enumerate(every)], "k int, x string")
    assert {r[0] for r in rows.select(T.collapse_whitespace(F.col("x"))).collect()} == {"a b"}
    assert one(spark, T.collapse_whitespace, None) is None


def test_letters(spark):
    assert one(spark, T.fold_ligatures, "Straße ŒUVRE ﬁﬄ ÆþÐ") == "strasse oeuvre fiffl aethdh"
    assert one(spark, lambda c: T.replace_in_order(c, {"ss": "s"}), "sssss") == "sss"
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    mapping = {chr(0xE9): "e"} | T.SINGLE_LETTERS
    assert one(spark, lambda c: T.apply_alphabet(c, alphabet, mapping), chr(0xE9) + " e" + chr(0x301) + " ſ1" + chr(0x1D41A) + "x") == "e e  s   x"
    assert one(spark, lambda c: T.apply_alphabet(c, "abc", {"x": "z", "b": "c"}), "abxzq") == "acz  "
    rules = parse_phonetic_rules("q>k,z>s,k>x,b>h")
    assert one(spark, lambda c: T.reduce_phonetics(c, "aksx", rules), "qzkabh") == "ksxa  "
    assert one(spark, lambda c: T.reduce_phonetics(c, " ", rules), "qz") == "qz"
    assert one(spark, lambda c: T.encoding_loss(c, "ab", {}), "abC ") == 0.25
    assert one(spark, lambda c: T.encoding_loss(c, "ab", {}), "") == 0.0
    assert one(spark, T.alphabet_of, "hello") == ["e", "h", "l", "o"]


@pytest.mark.parametrize("name,year", [("a_1396", 1396), ("x12345", 9999), ("none", 9999), ("1210_1300", 1210), ("a3000b2999", 2999), ("", 9999)])
def test_year(spark, name, year):
    assert one(spark, T.year_of, name) == year


def test_alnum(spark):
    tokens = ["a", "a-b", "½", "Ⅷ", "_", "é", "12", ".", ""]
    kept = [t for t in tokens if t.isalnum()]
    assert one(spark, T.alnum_tokens, tokens, "array<string>") == kept
    assert one(spark, T.alnum_positions, tokens, "array<string>") == [k for k, t in enumerate(tokens) if t.isalnum()]


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_fuzzy_ratio(spark):
    r = random.Random(1)
    pairs = [("".join(r.choice("abc") for _ in range(r.randint(0, 7))), "".join(r.choice("abc") for _ in range(r.randint(0, 7)))) for _ in range(80)]
    rows = spark.createDataFrame(pairs, "a string, b string")
    for row in rows.select("a", "b", T.fuzzy_ratio(F.col("a"), F.col("b")).alias("r"), align.indel_ratio_udf("a", "b").alias("u")).collect():
        expected = 2 * lcs(row["a"], row["b"]) / (len(row["a"]) + len(row["b"])) if row["a"] + row["b"] else 1.0
        assert abs(row["r"] - expected) < 1e-12 and abs(row["u"] - expected) < 1e-12


@given(st.text(max_size=12), st.text(max_size=12))
@settings(max_examples=60, deadline=None)
def test_ratio_is_symmetric(a, b):
    assert align.indel_ratio(a, b) == align.indel_ratio(b, a) and 0 <= align.indel_ratio(a, b) <= 1


# sources


def test_directory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b 1+2.txt").write_text(" one \n two " * 3, encoding="utf-8")
    (tmp_path / "sub" / "a.txt").write_text("three " * 9, encoding="utf-8")
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe bad")
    (tmp_path / "d.md").write_text("other")
    (tmp_path / "short.txt").write_text("x")
    docs, two = files.load_corpora(spark, str(tmp_path), str(tmp_path / "missing"), min_length=10)
    got = {r["name"]: r["text"] for r in docs.collect()}
    assert got == {"b 1+2.txt": "one two one two one two", "a.txt": " ".join(["three"] * 9)} and not two
    assert sorted(r["doc_idx"] for r in docs.collect()) == [0, 1]
    assert files.load_corpora(spark, str(tmp_path), str(tmp_path / "sub"), min_length=10)[1]
    assert files.load_corpora(spark, str(tmp_path), min_length=10, keep=1)[0].count() == 1
    with pytest.raises(ValueError):
        files.load_corpora(spark, str(tmp_path / "missing"))


def test_latest_rows(spark):
    rows = [(1, "2020-01-01", "a", 9), (1, "2021-01-01", "b", 9), (1, None, "c", 9), (2, None, None, 9), (None, None, "d", 9)]
    df = spark.createDataFrame(rows, "k bigint, at string, v string, _best int")
    assert {tuple(r) for r in tables.latest_rows(df, "k", "at", ["v"]).collect()} == {(1, "b"), (2, None)}


def test_materialize(spark):
    df = M.materialize(spark.range(5), "five")
    assert df.count() == 5
    M.discard(df)
    M.discard(None)


# normalisation and vocabulary


def test_learned_letters(spark):
    docs = spark.createDataFrame([("ÀÉé ø 1 ⁿ ª ﬀ",), (None,), ("",)], "text string")
    got = {r["src"]: (r["dst"], r["freq"]) for r in normalize.learned_rules(docs).collect()}
    assert got == {"à": ("a", 1), "é": ("e", 2), "ⁿ": ("n", 1), "ª": ("a", 1), "ﬀ": ("f", 1)}
    assert [r[0] for r in normalize.normalize_texts(docs).select("norm_text").collect()] == ["aee     n a f", None, ""]
    assert normalize.learn_characters(docs, Config(char_norm_min_freq=2)) == {"é": "e"} | T.SINGLE_LETTERS


def common(a, b):
    return len(list(itertools.takewhile(lambda p: p[0] == p[1], zip(a, b, strict=False))))


def brute_affixes(counts):
    out = Counter()
    for turn in (lambda w: w, lambda w: w[::-1]):
        ordered = sorted((turn(w), c) for w, c in counts.items())
        for (a, x), (b, y) in itertools.pairwise(ordered):
            if 2 <= (n := common(a, b)) <= 6:
                out[turn(a[:n])] += x + y
    return out


def test_vocabulary_size(spark):
    r = random.Random(2)
    counts = {"".join(r.choice("ab") for _ in range(r.randint(1, 9))): r.randint(1, 20) for _ in range(200)}
    df = spark.createDataFrame(list(counts.items()), "word string, freq bigint")
    frequent = {w: c for w, c in counts.items() if c >= 5 and len(w) > 1}
    expected = brute_affixes(frequent)
    assert {r["affix"]: r["c"] for r in vocab.affix_counts(vocab.frequent_words(df, 5)).collect()} == expected
    for share in (0.3, 0.85, 1.0):
        total, run, k = sum(expected.values()), 0, 0
        for _, c in expected.most_common():
            if run >= share * total:
                break
            run, k = run + c, k + 1
        assert vocab.suggest_size(df, 5, share) == k + 256
    assert vocab.suggest_size(df.limit(0)) == 2000
    assert vocab.capped_size(df, 10**9) == len(counts) + 256


def test_subwords_equal_a_public_trainer(spark):
    tk = pytest.importorskip("tokenizers")
    r = random.Random(3)
    words = ["".join(r.choice("abcde") for _ in range(r.randint(1, 8))) for _ in range(120)]
    text = " ".join(r.choices(words, k=3000))
    model = tk.Tokenizer(tk.models.BPE(unk_token="[UNK]"))
    model.pre_tokenizer = tk.pre_tokenizers.Whitespace()
    model.train_from_iterator([text], tk.trainers.BpeTrainer(vocab_size=150, special_tokens=["[UNK]", "[CLS]", "[SEP]", "[PAD]", "[MASK]"], show_progress=False))
    merges = bpe.learn_merges(dict(Counter(text.split())), 150)
    for w in words:
        assert merges.segment(w) == model.encode(w).tokens
    norm = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_idx bigint, norm_text string")
    got = {x["doc_idx"]: x["tokens"] for x in bpe.tokenize(norm, merges, ["doc_idx"]).collect()}
    assert got == {1: model.encode(text).tokens, 2: [], 3: []}


@pytest.mark.parametrize("letters,size", [("abc", 40), ("abcdefgh", 60)])
def test_merges_come_from_all_words_at_any_size(spark, letters, size):
    r = random.Random(12)
    counts = {"".join(r.choice(letters) for _ in range(r.randint(1, 9))): r.randint(1, 4) for _ in range(150)}
    df = M.materialize(spark.createDataFrame(list(counts.items()), "word string, freq bigint"), "words")
    expected = bpe.learn_merges(counts, size).pairs
    assert bpe.learn(df, size).pairs == expected and bpe.learn(df, size, most=20).pairs == expected
    if letters == "abc":
        assert bpe.learn_in_rounds(df, 14, most_pairs=2).pairs == expected[:6]
    assert bpe.learn_in_rounds(df.limit(0), size).pairs == []


def test_certain_merges_are_those_of_a_full_recount():
    r = random.Random(13)
    for _ in range(150):
        counts = {"".join(r.choice("abcd") for _ in range(r.randint(1, 9))): r.randint(1, 9) for _ in range(40)}
        alphabet, size, most = sorted({c for w in counts for c in w}), r.randint(9, 70), r.choice([1, 5, 999])
        ids, merges = {c: bpe.SPECIAL + k for k, c in enumerate(alphabet)}, []
        words, first = [([ids[c] for c in w], n) for w, n in counts.items()], bpe.SPECIAL + len(alphabet)
        while first + len(merges) < size:
            total = Counter()
            for parts, n in words:
                for pair in itertools.pairwise(parts):
                    total[pair] += n
            rows = sorted(((a, b, n) for (a, b), n in total.items()), key=lambda x: (-x[2], x[0], x[1]))[:most]
            if not rows:
                break
            steps = bpe.certain_merges(rows, len(rows) < most, ids, merges, first, size - first - len(merges))
            words = [(bpe._merged(parts, steps, {s[:2] for s in steps}), n) for parts, n in words]
        assert merges == bpe.learn_merges(counts, size).pairs


def test_merges_keep(tmp_path):
    merges = bpe.learn_merges({"abab": 3, "ab": 2}, 9)
    merges.save(tmp_path / "m.json")
    assert bpe.Merges.load(tmp_path / "m.json").pairs == merges.pairs and merges.segment("abab") == ["abab"]
    assert bpe.learn_merges({"abab": 3}, 7).pairs == []


# encoding, features, similarity


def docs_of(seed, n=25, v=8, size=30):
    r = random.Random(seed)
    return [(k, 1 if k % 4 else 2, [f"t{r.randrange(v)}" for _ in range(r.randint(0, size))]) for k in range(n)]


def encoded(spark, rows):
    df = spark.createDataFrame(rows, "doc_idx bigint, corpus int, tokens array<string>")
    dictionary = encode.token_dictionary(df)
    return encode.encode(df, dictionary, ["doc_idx", "corpus"]), {r["token"]: r["token_id"] for r in dictionary.collect()}


def test_dictionary_and_ids(spark):
    rows = [*docs_of(4, v=30), (99, 1, ["", None, "zz", "zz"]), (100, 2, None)]
    ids, dictionary = encoded(spark, rows)
    words = sorted({t for _, _, ts in rows for t in ts or [] if t})
    assert dictionary == {w: k for k, w in enumerate(words)}
    assert {(r["doc_idx"], r["corpus"]): r["ids"] for r in ids.collect()} == {(k, c): [dictionary[t] for t in ts or [] if t] for k, c, ts in rows}


@pytest.mark.parametrize("ngram,n_out,base", [(4, 0, 9), (5, 1, 2_000_003), (6, 2, 7), (3, 2, 2**31 - 1), (6, 1, 265_053)])
def test_feature_hash_is_exact(spark, ngram, n_out, base):
    r = random.Random(5)
    rows = [(k, [r.randrange(min(base, 2**31 - 1)) for _ in range(r.choice([0, ngram - 1, ngram, 12]))]) for k in range(8)]
    df = spark.createDataFrame(rows, "doc_idx bigint, ids array<int>")
    keep = list(itertools.combinations(range(ngram), ngram - n_out))
    expected = Counter()
    for k, ids in rows:
        for p in range(len(ids) - ngram + 1):
            for mask in keep:
                expected[k, sum(ids[p + c] * base**q for q, c in enumerate(mask)) % features.MODULUS] += 1
    got = {(x["doc_idx"], x["feature"]): x["tf"] for x in features.feature_counts(df, base, ["doc_idx"], ngram, n_out).collect()}
    assert got == expected
    assert sum(got.values()) == sum(math.comb(ngram, n_out) * max(0, len(ids) - ngram + 1) for _, ids in rows)


def test_no_features(spark):
    df = spark.createDataFrame([(1, [1, 2, 3])], "doc_idx bigint, ids array<int>")
    assert features.lno_hashes(df, 0, ["doc_idx"]).collect() == [] and features.keep_masks(3, 3) == [] and features.keep_masks(3, -1) == []


def brute_cosines(bags, n):
    df = Counter(f for bag in bags.values() for f in bag)
    unit = {}
    for k, bag in bags.items():
        w = {f: c * (math.log((1 + n) / (1 + df[f])) + 1) for f, c in bag.items()}
        norm = math.sqrt(sum(x * x for x in w.values())) or 1
        unit[k] = {f: x / norm for f, x in w.items()}
    dot = lambda a, b: sum(x * unit[b].get(f, 0) for f, x in unit[a].items())
    return unit, {(a, b): dot(a, b) for a in bags for b in bags if a[0] < b[0] and unit[a].keys() & unit[b].keys()}


@pytest.mark.parametrize("n_out", [0, 1])
def test_cosines(spark, n_out):
    rows = docs_of(6, n=40, v=4)
    rows += [(90, 1, rows[1][2]), (91, 1, [])]
    ids, dictionary = encoded(spark, rows)
    postings = M.materialize(features.feature_counts(ids, len(dictionary), ["doc_idx", "corpus"], 4, n_out), "postings")
    bags = {(k, c): Counter() for k, c, _ in rows}
    for x in postings.collect():
        bags[x["doc_idx"], x["corpus"]][x["feature"]] = x["tf"]
    unit, cosines = brute_cosines(bags, len(rows))
    weights = M.materialize(similarity.shared_weights(postings, len(rows)), "weights")
    full = {(x["doc_idx"], x["feature"]): x["w"] for x in similarity.tfidf_weights(postings, len(rows)).collect()}
    assert all(abs(full[k[0], f] - w) < 1e-12 for k, u in unit.items() for f, w in u.items()) and len(full) == sum(map(len, unit.values()))
    intra = {(x["i"], x["j"]): x["score"] for x in similarity.cosine_intra(weights).collect()}
    wanted = {(a[0], b[0]): s for (a, b), s in cosines.items() if a[1] == b[1] == 1}
    assert intra.keys() == wanted.keys() and all(abs(intra[k] - wanted[k]) < 1e-9 for k in intra)
    inter = {(x["i"], x["j"]): x["score"] for x in similarity.cosine_inter(weights).collect()}
    both = {tuple(sorted((a, b), key=lambda x: x[1])): s for (a, b), s in cosines.items() if a[1] != b[1]}
    assert inter.keys() == {(a[0], b[0]) for a, b in both} and all(abs(inter[a[0], b[0]] - s) < 1e-9 for (a, b), s in both.items())
    for t in (0.2, 0.6, 0.95):
        above = {(x["i"], x["j"]) for x in similarity.cosine_above(weights, t).collect()}
        assert above == {k for k, s in wanted.items() if s >= t}
    classes = {x["doc_idx"]: x["class_id"] for x in similarity.copy_classes(spark.createDataFrame(rows, "doc_idx bigint, corpus int, tokens array<string>")).collect()}
    assert classes[90] == classes[1] == min(k for k, _, t in rows if t == rows[1][2])


def test_no_pairs(spark):
    ids, dictionary = encoded(spark, [(1, 1, ["a"]), (2, 1, None)])
    postings = features.feature_counts(ids, len(dictionary), ["doc_idx", "corpus"])
    weights = similarity.shared_weights(postings, 2)
    pairs = similarity.cosine_intra(weights)
    assert pairs.collect() == [] and similarity.cosine_above(weights, 0.5).collect() == []
    assert threshold.choose(threshold.weighted_scores(pairs)) == 0.01
    assert threshold.choose(threshold.weighted_scores(pairs), "auto", "percentile") == 0.01


def test_dense(spark):
    ids = spark.createDataFrame([(k,) for k in range(3)], "i bigint")
    pairs = spark.createDataFrame([(0, 2, 0.5)], "i bigint, j bigint, score double")
    got = {(r["i"], r["j"]): r["score"] for r in similarity.dense_matrix(pairs, ids, ids.withColumnRenamed("i", "j"), ids.where("i < 2")).collect()}
    assert got == {(a, b): float(a < 2) if a == b else 0.5 if {a, b} == {0, 2} else 0.0 for a in range(3) for b in range(3)}
    with pytest.raises(ValueError):
        similarity.dense_matrix(pairs, ids, ids.withColumnRenamed("i", "j"), ids, limit=3)


def test_dense_rows(spark):
    rows = spark.createDataFrame([(k,) for k in range(5)], "i bigint")
    columns = spark.createDataFrame([(7,), (8,), (2,)], "j bigint")
    pairs = spark.createDataFrame([(0, 7, 0.5), (3, 8, 0.25), (0, 1, 0.9), (7, 8, 0.8), (2, 4, 0.3)], "i bigint, j bigint, score double")
    got = {(r["i"], r["j"]): r["score"] for r in similarity.dense_rows(pairs, rows, columns, limit=4).collect()}
    assert got == {(a, b): {(0, 7): 0.5, (3, 8): 0.25, (4, 2): 0.3}.get((a, b), 0.0) for a in range(5) for b in (7, 8, 2)}
    with pytest.raises(ValueError):
        similarity.dense_rows(pairs, rows, columns, limit=3)


# thresholds


def brute_otsu(values):
    lo, hi = min(values), max(values)
    counts, edges = np.histogram(values, 256, (lo, hi))
    centre = (edges[1:] + edges[:-1]) / 2
    best, at = -1.0, None
    for k in range(255):
        w1, w2 = counts[: k + 1].sum(), counts[k + 1 :].sum()
        if w1 and w2:
            v = w1 * w2 * ((counts[: k + 1] @ centre[: k + 1]) / w1 - (counts[k + 1 :] @ centre[k + 1 :]) / w2) ** 2
            if v > best + 1e-9:
                best, at = v, centre[k]
    return at


def test_thresholds(spark):
    r = random.Random(7)
    scores = [min(1, abs(r.gauss(0.2, 0.08))) for _ in range(300)] + [min(1.0, r.gauss(0.8, 0.05)) for _ in range(60)]
    pairs = spark.createDataFrame([(k, k + 1000, s) for k, s in enumerate(scores)], "i bigint, j bigint, score double")
    weighted = threshold.weighted_scores(pairs, 50)
    full = [s for s in scores for _ in range(2)] + [1.0] * 50
    assert abs(threshold.otsu(weighted).first()[0] - brute_otsu(full)) < 1e-9
    assert abs(threshold.choose(weighted, "auto", "percentile") - np.percentile(full, 99)) < 1e-12
    assert threshold.choose(weighted, "0.4") == 0.4
    constant = spark.createDataFrame([(0.3, 2)] * 3, "score double, weight bigint")
    assert threshold.choose(constant) == 0.3
    with pytest.raises(ValueError):
        threshold.choose(weighted, "auto", "other")


def test_stored_pairs(spark):
    rows = [(1, 2, 0.5, None), (2, 1, 0.7, None), (1, 1, 1.0, None), (None, 1, 0.5, None), (1, 3, float("nan"), None), (1, 4, None, None)]
    df = spark.createDataFrame(rows, "i bigint, j bigint, score float, scored_at timestamp")
    assert {(r["i"], r["j"], round(r["score"], 4)) for r in threshold.stored_pairs(df).collect()} == {(1, 2, 0.7), (1, 1, 1.0)}


# tuning


def test_tuning(spark):
    rows = [(k, [random.Random(k).randrange(50) for _ in range(60)]) for k in range(6)]
    df = spark.createDataFrame(rows, "doc_idx bigint, ids array<int>")
    grid = autotune.autotune_grid(df, 5).collect()
    assert [tuple(r)[1:3] for r in grid] == list(autotune.GRID)
    noisy = autotune.perturb([t for _, t in rows[:5]])
    assert noisy == autotune.perturb([t for _, t in rows[:5]]) and all(len(a) <= len(t) for a, (_, t) in zip(noisy, rows, strict=False))
    for r in grid:
        assert 0 <= r["noise"] <= 1 and 0 < r["signal"] <= 1 and abs(r["snr"] - (r["signal"] - r["noise"])) < 1e-12
    best = autotune.best_setting([tuple(r) for r in grid], (6, 1))
    assert best == max(((r["snr"], -r["grid_pos"], (r["ngram"], r["n_out"])) for r in grid))[2]
    assert autotune.tune([[1, 2]]) == [] and autotune.best_setting([], (6, 1)) == (6, 1)


# alignment and reports

DOCS = [
    (0, 1, "b_1300", "p0", "In nomine sancte et individue trinitatis, amen. Ego Petrus dono."),
    (1, 1, "a_1250", "p1", "In nomine sancte et indiuidue trinitatis amen! Ego Paulus do <b> totum."),
    (2, 1, None, "p2", "Nihil commune hic habetur"),
    (3, 1, "d", "p3", None),
    (4, 1, "e", "p4", "... !!"),
]


def doc_table(spark):
    return spark.createDataFrame(DOCS, "doc_idx bigint, corpus int, name string, path string, text string")


def pair_table(spark, rows=((0, 1, 0.9), (0, 2, 0.7), (0, 3, 0.9), (1, 4, 0.9))):
    return spark.createDataFrame(list(rows), "i bigint, j bigint, score double")


def low(text):
    return [w.lower() for w in align.display_tokens(text) if w.isalnum()]


def test_blocks_gaps_and_variants(spark):
    aligned = align.align(pair_table(spark), doc_table(spark))
    expected = {}
    for i, j, _ in ((0, 1, 0), (0, 2, 0)):
        blocks = [tuple(m) for m in difflib.SequenceMatcher(None, low(DOCS[i][4]), low(DOCS[j][4]), autojunk=False).get_matching_blocks()]
        expected |= {(i, j, q): b for q, b in enumerate(blocks)}
    got = {(r["i"], r["j"], r["seq"]): (r["a"], r["b"], r["size"]) for r in align.matching_blocks(aligned).collect()}
    assert got == expected
    gaps = {(r["i"], r["j"], r["seq"]): (r["gap1"], r["gap2"]) for r in align.gaps(aligned).collect()}
    wanted = {}
    for (i, j), rows in itertools.groupby(sorted(expected.items()), key=lambda x: x[0][:2]):
        a = b = 0
        for (_, _, q), (x, y, n) in rows:
            if n:
                wanted[i, j, q] = (low(DOCS[i][4])[a:x], low(DOCS[j][4])[b:y])
            a, b = x + n, y + n
    assert gaps == wanted
    variants = sorted((r["seq"], r["pos"], r["variation_type"], r["token_1"], r["token_2"]) for r in align.variations(align.gaps(aligned)).where("j = 1").collect())
    assert variants == [(1, 0, align.SIMILAR, "individue", "indiuidue")]
    uneven = spark.createDataFrame([(0, 1, 0, ["a", "b"], ["c"]), (0, 1, 1, ["a"], ["b"] * 9), (0, 1, 2, ["a"] * 6, ["b"] * 6)], "i bigint, j bigint, seq int, gap1 array<string>, gap2 array<string>")
    got = [tuple(r)[2:] for r in align.variations(uneven).orderBy("seq", "pos").collect()]
    assert got[:3] == [(0, 0, align.DIFFERENT, "a", "-"), (0, 1, align.DIFFERENT, "b", "-"), (0, 2, align.DIFFERENT, "-", "c")] and len(got) == 3 + 10


def test_golden_alignment_shape():
    a, b = low(DOCS[0][4]), low(DOCS[1][4])
    assert align.blocks_of(a, b)[-1] == (len(a), len(b), 0)


def test_segments_order_and_markup(spark):
    docs, pairs = doc_table(spark), pair_table(spark)
    segments = {(r["doc_idx"], r["segment"]) for r in align.long_segments(pairs, spark.createDataFrame([(0, "a b c d e f. x"), (1, "q a b c d e f! x"), (2, "a b c d z"), (3, None), (4, "")], "doc_idx bigint, text string")).collect()}
    assert segments == {(0, "a b c d e f")}
    order = {(r["i"], r["j"]): (r["first"], r["second"]) for r in align.chronological(pairs, docs).collect()}
    assert order == {(0, 1): (1, 0), (0, 2): (0, 2), (0, 3): (0, 3), (1, 4): (1, 4)}
    rows = {(r["i"], r["j"]): r for r in align.highlighted_pairs(pairs, docs).collect()}
    row = rows[0, 1]
    assert row["name1"] == "a_1250" and "&lt;" in row["html1"] and "<b>" not in row["html1"]
    assert 'data-match-id="0"' in row["html1"] and 'data-fuzz="' in row["html1"] and row["n_matches"] >= 2
    assert rows[0, 3]["n_matches"] == 0


def test_reports(spark, tmp_path):
    docs, pairs = doc_table(spark), pair_table(spark)
    related = {r["doc_idx"]: (r["n_related"], r["related"]) for r in reports.related_documents(pairs, docs, 0.8).collect()}
    assert related == {0: (2, "a_1250, d"), 1: (2, "b_1300, e"), 2: (0, "None"), 3: (1, "b_1300"), 4: (1, "a_1250")}
    assert {r["doc_idx"]: r["n_related"] for r in reports.related_documents(pair_table(spark, [(0, 0, 0.9)]), docs, 0.8, inter=True, compat=True).collect()}[0] == 0
    written = reports.write_summary_tsv(pairs, docs, 0.8, str(tmp_path / "s.tsv"))
    lines = open(written, encoding="utf-8").read().splitlines()
    assert lines[0].split("\t")[0] == "DocumentFilename" and len(lines) == 6
    lines = open(reports.write_variations_tsv(pairs, docs, 0.8, str(tmp_path / "v.tsv")), encoding="utf-8").read().splitlines()
    assert lines[0] == "File_1\tFile_2\tVariation_Type\tToken_1\tToken_2" and len(lines) == 2
    folder = reports.write_summary_tsv(pairs, docs, 0.8, str(tmp_path / "parts"), single=False)
    parts = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(folder)
    assert parts.columns[0] == "DocumentFilename" and parts.count() == 5
    pages = reports.write_comparison_html(pairs, docs, 0.8, str(tmp_path), most=10)
    assert len(pages) == 3 and pages[1].endswith("text_comparisons_02.html")
    assert reports.write_comparison_html(pairs, docs, 0.99, str(tmp_path)) == []
    assert reports.write_heatmap(pairs, docs, str(tmp_path / "h.html"), docs.select("doc_idx")) and reports.write_heatmap(pairs, docs, "", docs.select("doc_idx"), limit=5) is None
    assert list(reports.split_pages(iter(["aa", "b", "cccc"]), 3)) == [["aa", "b"], ["cccc"]]


@pytest.mark.parametrize("two", [False, True])
def test_pipeline(spark, tmp_path, two):
    r = random.Random(9)
    words = ["".join(r.choice("abcdeioru") for _ in range(6)) for _ in range(80)]
    formula = " ".join(r.choices(words, k=25))
    for folder in ("one", "two"):
        (tmp_path / folder).mkdir()
        for k in range(6):
            own = " ".join(r.choices(words, k=40))
            (tmp_path / folder / f"{folder}_{1200 + k}.txt").write_text(f"{own} {formula if k < 3 else ''} {own[:40]}", encoding="utf-8")
    config = Config(input_path=str(tmp_path / "one"), input_path2=str(tmp_path / "two") if two else "", min_text_length=20, vocab_min_word_freq=2, auto_tune=not two)
    result = pipeline.run_folders(spark, config, str(tmp_path / "out"))
    assert result.inter == two and 0 < result.threshold <= 1
    best = [x["score"] for x in result.pairs.orderBy(F.desc("score")).limit(3).collect()]
    assert best and best[0] > 0.1
    names = {f.rsplit("/", 1)[1] for f in result.files}
    assert {"dist_mat.parquet", "similarity_heatmap.html", "similarity_summary.tsv", "linguistic_variations.tsv", "subword_merges.json"} <= names
    assert bpe.Merges.load(next(f for f in result.files if f.endswith(".json"))).pairs
    with pytest.raises(ValueError):
        pipeline.run_folders(spark, Config(), "x")


def test_threshold_counts_documents_that_share_nothing(spark):
    rows = [(k, 1, f"n{k}", f"p{k}", " ".join(chr(97 + (5 * k + q) % 26) * 3 for q in range(4))) for k in range(5)]
    rows += [(k, 1, f"n{k}", f"p{k}", "uvu wvw xyx zyz" + " uwu" * (k - 8)) for k in (8, 9)]
    docs = spark.createDataFrame(rows, "doc_idx bigint, corpus int, name string, path string, text string")
    for method in ("otsu", "percentile"):
        result = pipeline.run(docs, Config(ngram=3, n_out=0, auto_threshold_method=method))
        scores = [x["score"] for x in result.pairs.collect()]
        tokens = {x["doc_idx"]: x["tokens"] for x in result.tokens.collect()}
        assert len(scores) == 1 and all(len(t) >= 3 for t in tokens.values())
        full = scores * 2 + [1.0] * len(rows)
        expected = brute_otsu(full) if method == "otsu" else np.percentile(full, 99)
        assert abs(result.threshold - expected) < 1e-9
    alone = pipeline.run(docs.where("doc_idx < 5"), Config(ngram=3, n_out=0))
    assert alone.pairs.count() == 0 and alone.threshold == 1.0


def test_arrivals(spark, tmp_path):
    ids, dictionary = encoded(spark, docs_of(11, v=4))
    known = M.materialize(similarity.shared_weights(features.feature_counts(ids, len(dictionary), ["doc_idx", "corpus"], 3, 0), 25), "known")
    new = ids.where("doc_idx < 3").select("doc_idx", "ids")
    got = match_arrivals(new, known, len(dictionary), 25, 3, 0).collect()
    own = {r["doc_idx"]: r["score"] for r in got if r["doc_idx"] == r["j"]}
    assert got and all(0 < r["score"] <= 1 + 1e-9 for r in got) and all(s > 0.5 for s in own.values())
    from charterloom.streaming.matches import start

    new.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(new.schema).parquet(str(tmp_path / "in"))
    q = start(stream, known, len(dictionary), 25, str(tmp_path / "out"), str(tmp_path / "cp"), 3, 0)
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(got)


def test_arrival_equal_to_a_text_that_shares_nothing(spark):
    rows = [(0, 1, list("abcdefgh")), (1, 1, list("ijklmnop")), (2, 1, list("qrstuvwx")), (3, 1, list("qrstuvyz"))]
    ids, dictionary = encoded(spark, rows)
    postings = M.materialize(features.feature_counts(ids, len(dictionary), ["doc_idx", "corpus"]), "postings")
    weights = M.materialize(similarity.corpus_weights(postings, len(rows)), "weights")
    assert weights.columns == ["doc_idx", "corpus", "feature", "df", "w"] and weights.count() == postings.count()
    got = {(r["doc_idx"], r["j"]): r["score"] for r in match_arrivals(ids.select("doc_idx", "ids"), weights, len(dictionary), len(rows)).collect()}
    assert got.keys() == {(k, k) for k in range(4)} | {(2, 3), (3, 2)}
    assert all(abs(got[k, k] - 1) < 1e-9 for k in range(4)) and 0 < got[2, 3] < 1


def test_command_line():
    from charterloom.__main__ import parse

    config, output = parse(["--input_path", "x", "--ngram", "5", "--auto_tune", "true", "--output", "y"])
    assert (config.ngram, config.auto_tune, output) == (5, True, "y")


def test_large_dictionaries_join_by_shuffle_with_the_frequent_tokens_apart(spark, monkeypatch):
    rows = [(k, 1, ["hot"] * 30 + [f"t{k % 7}", "x", None, ""]) for k in range(50)] + [(99, 1, None)]
    plain = sorted((r["doc_idx"], tuple(r["ids"])) for r in encoded(spark, rows)[0].collect())
    monkeypatch.setattr(encode, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(encode, "HEAVY_PART", 3)
    assert sorted((r["doc_idx"], tuple(r["ids"])) for r in encoded(spark, rows)[0].collect()) == plain


def test_pairs_of_a_hot_document(spark, monkeypatch):
    monkeypatch.setattr(align, "HOT_PART", 4)
    pairs = spark.createDataFrame([(1, k, 0.5) for k in range(2, 60)] + [(2, 3, 0.4), (2, 3, 0.4)], "i bigint, j bigint, score double")
    docs = spark.createDataFrame([(k, f"t{k}", "clash") for k in range(58)], "doc_idx bigint, text string, _salt string")
    got = sorted(tuple(r) for r in align.pair_documents(pairs, docs, ["text"]).select("i", "j", "score", "text1", "text2").collect())
    assert got == sorted([(1, k, 0.5, "t1", f"t{k}") for k in range(2, 58)] + [(2, 3, 0.4, "t2", "t3")] * 2)


def test_batches_are_bounded():
    import pyarrow as pa

    from charterloom.functions.batches import MOST_ROWS, by_bytes

    batch = pa.RecordBatch.from_arrays([pa.array(["x"] * 5000 + ["y" * 100_000] * 20)], names=["t"])
    parts = list(by_bytes(iter([batch]), most=300_000))
    assert sum(([*p.column(0).to_pylist()] for p in parts), []) == batch.column(0).to_pylist()
    assert max(p.num_rows for p in parts) <= MOST_ROWS and max(p.nbytes for p in parts) <= 1_000_000
    assert list(by_bytes(iter([batch.slice(0, 0)]))) == []


def test_features_of_many_documents_in_blocks(spark, monkeypatch):
    rows = [(k, 1 + k % 2, f % 3 if f < 3 else 100 + f * k % 40, 40, 0.1 + f / 50) for k in range(40) for f in range(9)]
    weights = spark.createDataFrame(list({(a, b, c): (a, b, c, d, e) for a, b, c, d, e in rows}.values()), "doc_idx bigint, corpus int, feature bigint, df bigint, w double")
    read = lambda f: sorted((r["i"], r["j"], round(r["score"], 9)) for r in f(weights).collect())
    plain = [read(similarity.cosine_intra), read(similarity.cosine_inter)]
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 3)
    assert [read(similarity.cosine_intra), read(similarity.cosine_inter)] == plain and all(plain)


def test_rules_of_another_shape_are_told():
    from charterloom.config import parse_phonetic_rules

    with pytest.warns(UserWarning, match="'ab>c'"):
        assert parse_phonetic_rules("a>b, ab>c,") == {"a": "b"}


@pytest.mark.parametrize("n_out, slice_postings", [(0, 40), (1, 10**9), (1, 300)])
def test_weights_and_pairs_of_chunks(spark, monkeypatch, n_out, slice_postings):
    monkeypatch.setattr(chunks, "CHUNK_TOKENS", 60)
    monkeypatch.setattr(chunks, "SLICE_POSTINGS", slice_postings)
    rows = docs_of(6, n=40, v=4)
    rows += [(90, 1, rows[1][2]), (91, 1, []), (92, 1, ["only"] * 9)]
    tokens = spark.createDataFrame([(k, c, [x for x in t or [] if x]) for k, c, t in rows], "doc_idx bigint, corpus int, tokens array<string>").repartition(3)
    ids, dictionary = encoded(spark, rows)
    bags = {(k, c): Counter() for k, c, _ in rows}
    for x in features.feature_counts(ids, len(dictionary), ["doc_idx", "corpus"], 4, n_out).collect():
        bags[x["doc_idx"], x["corpus"]][x["feature"]] = x["tf"]
    unit, cosines = brute_cosines(bags, len(rows))
    weights = chunks.Weights(*chunks.encoded_chunks(tokens), 4, n_out)
    assert weights.told.count() > 3
    full = {((x["doc_idx"], x["corpus"]), x["feature"]): x["w"] for x in chunks.tfidf_weights(weights).collect()}
    wanted = {(k, f): w for k, u in unit.items() for f, w in u.items()}
    assert full.keys() == wanted.keys() and all(abs(full[k] - wanted[k]) < 1e-12 for k in full)
    assert sorted(r["doc_idx"] for r in chunks.featureful(weights).collect()) == sorted(k for (k, _), bag in bags.items() if bag)
    wanted = {(a[0], b[0]): s for (a, b), s in cosines.items() if a[1] == b[1] == 1}
    blocks = chunks.blocks(weights)
    pairs = [tuple(r) for r in chunks.all_pairs(blocks).collect()]
    assert len(pairs) == len(wanted) and all(abs(wanted[i, j] - s) < 1e-9 for i, j, s in pairs)
    for t in (0.2, 0.6, 0.95):
        above = [(r["i"], r["j"]) for r in chunks.pairs_above(weights, t).collect()]
        assert len(above) == len(set(above)) and set(above) == {k for k, s in wanted.items() if s >= t}
    counts = chunks.score_counts(blocks, 7, 256).collect()
    assert sum(r["n"] for r in counts) == len(wanted)
    scores = spark.createDataFrame([(r["score"], 2 * r["n"]) for r in counts] + [(1.0, 7)], "score double, weight bigint")
    every = spark.createDataFrame([(s, 2) for _, _, s in pairs] + [(1.0, 7)], "score double, weight bigint")
    cutoff = threshold.choose(scores)
    assert cutoff == threshold.choose(every) and sum(r["n"] for r in counts if r["score"] >= cutoff) == sum(s >= cutoff for _, _, s in pairs)


def test_no_chunks(spark):
    for rows in ([], [(1, 1, ["a"]), (2, 1, [])]):
        weights = chunks.Weights(*chunks.encoded_chunks(spark.createDataFrame(rows, "doc_idx bigint, corpus int, tokens array<string>")), 6, 1)
        blocks = chunks.blocks(weights)
        assert weights.n == len(rows) and chunks.tfidf_weights(weights).collect() == chunks.all_pairs(blocks).collect() == chunks.pairs_above(weights, 0.5).collect() == chunks.score_counts(blocks, 0, 256).collect() == []
