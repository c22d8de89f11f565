"""The training-data operators against brute force, on small tables with nulls, ties, copies and clashing columns."""

import math
import random
import unicodedata
from collections import Counter, defaultdict

import pytest

from charterloom.llm import distinctive, frequency, groups, mixing, spans, tokenizer, visible
from charterloom.sources import tables

TOKENIZED = "doc_idx bigint, corpus int, tokens array<string>, tokenized_at timestamp, rec bigint, h string"


def tokenized(spark, rows):
    return spark.createDataFrame([(k, 1, t, None, 7, "x") for k, t in rows], TOKENIZED)


def words(seed, n, size, vocabulary=40):
    r = random.Random(seed)
    return [[f"w{min(int(r.expovariate(0.15)), vocabulary)}" for _ in range(r.randint(0, size))] for _ in range(n)]


# problem 4 and 3


def records(rows):
    """Last row by position among equal keys is as good as any: equal keys have equal tokens here."""
    return {k: t for k, t in rows if k is not None}


def test_frequencies_match_counting(spark):
    rows = [(k, t) for k, t in enumerate(words(1, 60, 30))]
    rows += [(3, rows[3][1]), (100, None), (101, []), (102, ["a", None, "", "a", "b"]), (None, ["zz"])]
    got = {r["token"]: (r["n_occurrences"], r["n_records"], r["mark"]) for r in frequency.term_frequencies(tokenized(spark, rows)).collect()}
    own, occurrences, held = records(rows), Counter(), Counter()
    for t in own.values():
        clean = [x for x in t or [] if x]
        occurrences.update(clean)
        held.update(set(clean))
    mark = lambda x: "rare" if occurrences[x] <= 2 else "common" if held[x] > len(own) / 4 else None
    assert got == {x: (occurrences[x], held[x], mark(x)) for x in occurrences}


def test_frequencies_of_nothing(spark):
    assert frequency.term_frequencies(tokenized(spark, [])).collect() == []
    assert frequency.term_frequencies(tokenized(spark, [(1, None), (2, [])])).collect() == []


def test_value_frequencies(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "a", None), (2, "a", None), (3, None, None), (4, "", None)], "doc_idx bigint, name string, loaded_at timestamp")
    assert [(r["token"], r["n_records"], r["mark"]) for r in frequency.value_frequencies(df, "doc_idx", "name", "loaded_at").collect()] == [("a", 2, "rare")]


def test_distinctive_scores_and_cases(spark):
    rows = [(k, t) for k, t in enumerate(words(2, 150, 12, 200))] + [(5, words(2, 150, 12, 200)[5]), (900, None), (901, ["q", "", None])]
    own = {k: [x for x in t or [] if x] for k, t in records(rows).items()}
    n, held, cf = len(own), Counter(), Counter()
    for t in own.values():
        held.update(set(t))
        cf.update(t)
    mean = sum(map(len, own.values())) / n
    expected, cases = {}, set()
    for k, t in own.items():
        w = {x: c * (math.log((1 + n) / (1 + held[x])) + 1) for x, c in Counter(t).items()}
        norm = math.sqrt(sum(v * v for v in w.values()))
        for x, c in Counter(t).items():
            rate, tfn = cf[x] / n, c * math.log2(1 + mean / len(t))
            expected[k, x] = (math.log2(1 + rate) - tfn * math.log2(rate / (1 + rate))) / (tfn + 1)
            if w[x] / norm >= 0.3 and 40 * held[x] <= n:
                cases.add((k, x))
    df = tokenized(spark, rows)
    got = {(r["doc_idx"], r["token"]): r["score"] for r in distinctive.scored_terms(df).collect()}
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)
    found = [tuple(r) for r in distinctive.weighty_terms(df).collect()]
    assert set(found) == cases and len(found) == len(cases)
    assert distinctive.weighty_terms(tokenized(spark, [])).collect() == []


# problem 2


def brute_spans(own, reference, m=20):
    where = defaultdict(set)
    texts = {("c", k): t for k, t in own.items()} | {("r", k): t for k, t in reference.items()}
    for rec, t in texts.items():
        for p in range(len(t or []) - m + 1):
            if all(t[p : p + m]):
                where[tuple(t[p : p + m])].add(rec)
    out = set()
    for k, t in own.items():
        hit = [False] * len(t or [])
        for p in range(len(hit) - m + 1):
            if all(t[p : p + m]) and len(where[tuple(t[p : p + m])]) > 1:
                hit[p : p + m] = [True] * m
        p = 0
        while p < len(hit):
            if hit[p]:
                q = p
                while q < len(hit) and hit[q]:
                    q += 1
                out.add((k, p, q - p))
                p = q
            p += 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_spans_match_brute_force(spark, seed, monkeypatch):
    if seed == 2:  # joins by shuffle, heavy windows apart
        monkeypatch.setattr(tables, "BROADCAST_KEYS", 0)
        monkeypatch.setattr(spans, "HEAVY_PART", 50)
    r = random.Random(seed)
    base = [f"t{r.randrange(60)}" for _ in range(600)]
    own = {}
    for k in range(60):
        parts = []
        for _ in range(r.randint(0, 4)):
            a = r.randrange(500)
            parts += base[a : a + r.choice([5, 19, 20, 21, 45, 90])] if r.random() < 0.5 else [f"t{r.randrange(60)}" for _ in range(r.randint(0, 60))]
        own[k] = parts
    for k in range(60, 70):  # copies, with holes
        own[k] = list(own[r.randrange(60)])
        if own[k] and k % 2:
            own[k][r.randrange(len(own[k]))] = r.choice([None, ""])
    own |= {80: None, 81: [], 82: ["a"] * 50, 83: [None] * 40, 84: ["a"] * 19}
    reference = {1: base[100:160], 2: base[:10], 3: None}
    rows = [(k, t) for k, t in own.items()] + [(5, own[5])]
    second = spark.createDataFrame([(k, 2, t) for k, t in reference.items()], "doc_idx bigint, corpus int, tokens array<string>")
    expected = brute_spans(own, reference)
    got = spans.shared_spans(tokenized(spark, rows), second).collect()
    assert {(x["doc_idx"], x["start_pos"], x["n_tokens"]) for x in got} == expected and len(got) == len(expected)
    assert all(20 <= x["repeated_len"] <= x["n_tokens"] for x in got)
    short = spans.shared_spans(tokenized(spark, rows), second)
    assert {tuple(x)[:3] for x in short.collect()} == expected
    shares = {x["doc_idx"]: (x["n_tokens"], x["n_shared"]) for x in spans.shared_share(tokenized(spark, rows), short).collect()}
    assert shares == {k: (len(t or []), sum(n for d, _, n in expected if d == k)) for k, t in own.items()}


def test_spans_doubling_finds_the_length(spark):
    long = [f"x{k}" for k in range(100)]
    got = spans.shared_spans(tokenized(spark, [(1, ["a", *long]), (2, [*long, "b"]), (3, long[:30])])).collect()
    assert {(x["doc_idx"], x["start_pos"], x["n_tokens"], x["repeated_len"]) for x in got} == {(1, 1, 100, 80), (2, 0, 100, 80), (3, 0, 30, 20)}
    assert spans.shared_spans(tokenized(spark, [])).collect() == []


# problem 5


def brute_groups(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {v: root(v) for v in list(parent)}


def dist(spark, rows):
    return spark.createDataFrame(rows, "i bigint, j bigint, score float, scored_at timestamp, u bigint, v string")


@pytest.mark.parametrize(("share", "broadcast"), [(0.01, True), (2.0, True), (0.01, False), (2.0, False)])
def test_groups_match_union_find(spark, share, broadcast, monkeypatch):
    if not broadcast:  # hubs and large groups by the way for tables of any size
        monkeypatch.setattr(tables, "BROADCAST_KEYS", 0)
        monkeypatch.setattr(groups, "HEAVY_PART", 20)
    r = random.Random(4)
    edges = [(r.randrange(400), 1000 + r.randrange(400)) for _ in range(260)]
    edges += [(5000 + k, 5001 + k) for k in range(300)]  # a long chain
    edges += [(9000, 9001 + k) for k in range(200)]  # a hub
    edges += [(9150, 9900), (9900, 5100)]  # the hub's group has a long tail
    rows = [(a, b, 0.9, None, 1, "x") for a, b in edges] + [(b, a, 0.7, None, 1, "x") for a, b in edges[:50]]
    rows += [(1, 1, 1.0, None, 1, "x"), (None, 2, 0.9, None, 1, "x"), (3, None, 0.9, None, 1, "x"), (1, 5000, None, None, 1, "x"), (2, 5000, float("nan"), None, 1, "x"), (3, 5000, 0.59, None, 1, "x")]
    got = groups.connected_groups(groups.links(dist(spark, rows)), share).collect()
    assert {x["doc_idx"]: x["group_id"] for x in got} == brute_groups(edges) and len(got) == len(brute_groups(edges))


def test_groups_of_nothing_and_of_one(spark):
    assert groups.match_groups(dist(spark, [])).collect() == []
    assert {tuple(x) for x in groups.match_groups(dist(spark, [(7, 3, 0.6, None, 1, "x")])).collect()} == {(7, 3), (3, 3)}


# problem 6


def test_encoding_equals_the_public_encoder(spark):
    from tokenizers import Tokenizer

    public = Tokenizer.from_file(tokenizer.DEFAULT_VOCABULARY)
    public.encode_special_tokens = True
    r = random.Random(3)
    alphabet = "abc THE the  \n\t.,'s't12éßжд漢字กา🌾️" + chr(0x3000) + chr(0xA0)
    texts = ["", " ", "a", "<|endoftext|> x", "don't they'll", "x" * 5000, "ก" * 2000, "  \n\n  a  ", chr(0x1C) + " " + chr(0x85)]
    texts += ["".join(r.choice(alphabet) for _ in range(r.randint(0, 200))) for _ in range(200)]
    df = spark.createDataFrame([(k, t, "clash", 1) for k, t in enumerate(texts)] + [(9999, None, None, None)], "doc_id bigint, text string, ids string, _text int")
    got = {x["doc_id"]: x["ids"] for x in tokenizer.encode_texts(df).collect()}
    assert got == {k: public.encode(t, add_special_tokens=False).ids for k, t in enumerate(texts)} | {9999: []}
    counts = {x["doc_id"]: x["n_tokens"] for x in tokenizer.count_tokens(df, ["doc_id"]).collect()}
    assert counts == {k: len(v) for k, v in got.items()}
    assert tokenizer.encode_texts(df.where("doc_id < 0")).collect() == []


def test_every_entry_is_one_token_and_the_hash_is_perfect():
    bpe = tokenizer.load().prepare()
    assert sorted(bpe.hash.values) == sorted(set(bpe.hash.values)) and len(bpe.hash.keys) == bpe.hash.n
    for key, value in zip(bpe.hash.keys, bpe.hash.values, strict=True):
        assert bpe.hash.get(key) == value
        assert bpe.merged(key) == (value,)
    assert bpe.hash.get(b"no such entry of the vocabulary") == -1


def test_memo_starts_anew(monkeypatch):
    monkeypatch.setattr(tokenizer, "_MEMO_LIMIT", 3)
    memo = tokenizer.Memo(lambda t: (len(t),))
    assert [memo["x" * k] for k in range(1, 9)] == [(k,) for k in range(1, 9)] and len(memo) <= 4


# problem 7


def test_fit_budget_is_near_and_bounded():
    r = random.Random(5)
    for _ in range(60):
        lengths = sorted(r.sample(range(1, 400), r.randint(1, 40)))
        counts = [r.randint(1, 30) for _ in lengths]
        total = sum(n * c for n, c in zip(lengths, counts, strict=True))
        budget = r.randint(0, int(total * 1.2))
        take = mixing.fit_budget(lengths, counts, budget, seed=1)
        assert all(0 <= t <= c for t, c in zip(take, counts, strict=True))
        size = sum(n * t for n, t in zip(lengths, take, strict=True))
        assert size <= budget
        # exact optimum by the plain table
        bits = 1
        for n, c in zip(lengths, counts, strict=True):
            for _ in range(c):
                bits |= bits << n
        best = (bits & ((1 << (budget + 1)) - 1)).bit_length() - 1
        assert size == best


def best_sum(lengths, counts, budget):
    bits, mask = 1, (1 << (budget + 1)) - 1
    for n, c in zip(lengths, counts, strict=True):
        for _ in range(c):
            bits = (bits | bits << n) & mask
    return bits.bit_length() - 1


def test_fit_budget_of_long_documents_is_the_optimum():
    r = random.Random(9)
    for _ in range(25):
        lengths = sorted(r.sample(range(8_500, 60_000), r.randint(1, 12)))
        counts = [r.randint(1, 4) for _ in lengths]
        budget = r.randint(0, sum(n * c for n, c in zip(lengths, counts, strict=True)))
        size = sum(n * t for n, t in zip(lengths, mixing.fit_budget(lengths, counts, budget), strict=True))
        assert size == best_sum(lengths, counts, budget)


def test_fit_budget_beyond_the_window():
    lengths, counts = [3, 700, 90_000], [10, 500, 40]
    for budget in (5, 100_000, 1_234_567, 3_000_000):
        size = sum(n * t for n, t in zip(lengths, mixing.fit_budget(lengths, counts, budget), strict=True))
        assert size == best_sum(lengths, counts, budget)
    lengths, counts = list(range(1000, 20_000, 10)), [30] * 1900  # units of ten, half a billion tokens
    size = sum(n * t for n, t in zip(lengths, mixing.fit_budget(lengths, counts, 300_000_007), strict=True))
    assert size == 300_000_000


def test_mixture(spark):
    r = random.Random(6)
    rows = [(k, r.choice(["a", "a", "a", "b", "c", None]), "word " * r.randint(0, 60), "clash") for k in range(300)]
    rows += [(1000, "a", None, "x"), (1001, "d", "", "x"), (1002, "b", "", "x"), (1003, "e", "one two", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, budget string")
    targets = spark.createDataFrame([("a", 0.3, 2), ("b", 0.4, 1), ("c", 0.2, None), ("d", 0.05, 3), ("none", 0.05, 9), (None, 0.5, 1), ("zero", 0.0, 1)], "source string, target_share double, max_repeats int")
    bpe = tokenizer.load().prepare()
    size = {k: bpe.count(t) for k, _, t, _ in rows}
    total = sum(size.values())
    per = defaultdict(int)
    for k, s, *_ in rows:
        per[s] += size[k]
    sized = mixing.sized_documents(docs)
    plan, report = mixing.plan_mixture(sized, targets, total)
    used = mixing.draw(sized, plan).collect()
    report = {x["source"]: x for x in report.collect()}
    assert report.keys() == {"a", "b", "c", "d", "none", "zero"}
    most = {"a": 2, "b": 1, "c": 1, "d": 3, "none": 9, "zero": 1}
    share = {"a": 0.3, "b": 0.4, "c": 0.2, "d": 0.05, "none": 0.05, "zero": 0.0}
    assert len({x["doc_id"] for x in used}) == len(used)
    reached = defaultdict(int)
    for x in used:
        assert 1 <= x["repeats"] <= most[x["source"]] and size[x["doc_id"]] == x["n_tokens"] > 0
        reached[x["source"]] += x["repeats"] * x["n_tokens"]
    for s, x in report.items():
        assert x["planned_tokens"] == reached[s] and x["source_tokens"] == per[s]
        assert x["reachable"] == (not per[s] * most[s] < share[s] * total)
        assert reached[s] == per[s] * most[s] if not x["reachable"] else share[s] * total - 3 <= reached[s] <= share[s] * total
        assert abs(x["actual_share"] - reached[s] / sum(reached.values())) < 1e-9 and abs(x["shortfall_tokens"] - (share[s] * total - reached[s])) < 1e-6
    found = {x["source"] for x in mixing.unreachable(docs, targets).collect()}
    assert found == {s for s in most if per[s] * most[s] < share[s] * total}
    assert {tuple(x) for x in mixing.draw(sized, plan).collect()} == {tuple(x) for x in used}  # seeded


def test_mixture_keeps_the_shares(spark):
    r = random.Random(16)
    lengths = [(s, r.randint(1, 300)) for s, n in (("a", 4000), ("b", 300), ("c", 900)) for _ in range(n)]
    sized = spark.createDataFrame([(s, k, n) for k, (s, n) in enumerate(lengths)] + [("x", 9000, 50), (None, 9001, 9)], "source string, doc_id bigint, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.5, 3), ("c", 0.3, 2)], "source string, target_share double, max_repeats int")
    held = {s: sum(n for x, n in lengths if x == s) for s in "abc"}
    total = min(held[s] * most / share for s, share, most in (("a", 0.2, 1), ("b", 0.5, 3), ("c", 0.3, 2)))
    for x in mixing.plan_mixture(sized, targets)[1].collect():
        assert abs(x["budget_tokens"] - x["target_share"] * total) <= 1
        assert abs(x["planned_tokens"] - x["target_share"] * total) <= 2 and abs(x["actual_share"] - x["target_share"]) < 1e-4 and x["shortfall_tokens"] < 2


def test_mixture_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("a", 0.5, 2)], "source string, target_share double, max_repeats int")
    assert mixing.unreachable(docs, targets).collect() == []  # nothing is wanted of nothing
    assert mixing.unreachable(docs, targets.limit(0)).collect() == []


def test_draw_from_a_hot_length(spark):
    sized = spark.createDataFrame([("s", k, 10) for k in range(5000)], "source string, doc_id bigint, n_tokens bigint")
    plan = spark.createDataFrame([("s", 10, 5000, 1, 1234)], "source string, n_tokens bigint, n_docs bigint, base_repeats bigint, n_extra bigint")
    got = Counter(x["repeats"] for x in mixing.draw(sized, plan).collect())
    assert got == {2: 1234, 1: 5000 - 1234}


# problem 1

SAME = [
    ("Anno domini", "Аnnо dоmіnі"), ("fidei", "ﬁdei"), ("office", "oﬃce"), ("a b", "a \n\t b "), ("a b", "　a ​b "), ("naïve", "naïve"),
    ("abc", "a‍b­c﻿"), ("ABC 12", "ＡＢＣ　１２"), ("ä", "ａ̈"), ("ǭ", "ǭ"), ("XII mi", "Ⅻ ⅿⅰ"), ("a:b;c", "a∶b;c"), ("K", "K"),
    ("ό", "ό"), ("ё", "ё"), ("é", "e‍́"), ("لا", "ﻻ"), ("가", "가"), ("ijs", "ĳs"), ("ｶﾞ", "ガ"),
]
DIFFERENT = [("sine", "ſine"), ("x2", "x²"), ("ad", "AD"), ("e", "é"), ("vvit", "uuit"), ("ae", "œ"), ("10", "1O"), ("a b", "ab"), ("ss", "ß"), ("α", "a"), ("o", "ø")]


def test_forms():
    form = visible.visible_form()
    for a, b in SAME:
        assert form(a) == form(b), (a, b)
    for a, b in DIFFERENT:
        assert form(a) != form(b), (a, b)
    for a, b in SAME + DIFFERENT:
        assert form(form(a)) == form(a) and form(form(b)) == form(b)
    assert form(None) is None and form(" ​﻿\n") == ""


def test_form_is_stable_on_random_text():
    r, form = random.Random(7), visible.visible_form()
    pool = "aeo \n" + "".join(chr(c) for c in (0x300, 0x301, 0x308, 0x328, 0x200B, 0x200D, 0xFB01, 0xFF41, 0x430, 0x3BF, 0xE9, 0x17F, 0x2170, 0x3000, 0xAD, 0x1100, 0x1161))
    for _ in range(3000):
        text = "".join(r.choice(pool) for _ in range(r.randint(0, 12)))
        once = form(text)
        assert form(once) == once, ascii(text)


def test_form_is_stable_on_all_scripts(spark):
    r, form = random.Random(11), visible.visible_form(visible.confusable_letters(spark))
    every = [c for c in map(chr, (*range(1, 0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20))) if unicodedata.category(c) != "Cn"]
    marks = [c for c in every if unicodedata.category(c) in ("Mn", "Mc")]
    composed = [c for c in every if unicodedata.decomposition(c)]
    for _ in range(20_000):
        text = "".join(r.choice(r.choice((every, marks, composed, marks))) for _ in range(r.randint(1, 6)))
        once = form(text)
        assert form(once) == once, ascii(text)
        assert form(unicodedata.normalize("NFC", text)) == once == form(unicodedata.normalize("NFD", text)), ascii(text)


def test_letters_drawn_like_latin_ones(spark):
    letters = visible.confusable_letters(spark)
    form = visible.visible_form(letters)
    assert len(letters) > 100
    assert form("\u13aa\ua4ee A") == "AA A" and form("\ua4f3\u13d9\u2c92") == form("OVI")
    for a, b in DIFFERENT:
        assert form(a) != form(b), (a, b)


def test_conflicts_are_found(monkeypatch):
    monkeypatch.setattr(visible, "LOOK_ALIKES", "a:а b:а")
    with pytest.raises(visible.Conflict):
        visible.look_alikes()
    monkeypatch.setattr(visible, "LOOK_ALIKES", "a:b b:a")
    with pytest.raises(visible.Conflict):
        visible.build_mapping()


def test_pairs_that_look_the_same(spark, monkeypatch):
    texts = {1: "Anno domini", 2: "Аnno  domini", 3: "anno domini", 4: None, 5: "", 6: " ​", 7: "Anno domini", 8: "Anno\ndomini", 9: "ſola", 10: "sola", 11: "x" * 50_000, 12: "х" + "x" * 49_999}
    rows = [(k, 1, "n", "p", t, None, "clash", b"f") for k, t in texts.items()]
    rows += [rows[0], (None, 1, "n", "p", "Anno domini", None, "y", b"f")]
    df = spark.createDataFrame(rows, "doc_idx bigint, corpus int, name string, path string, text string, loaded_at timestamp, stored string, form binary")
    form = visible.visible_form()
    expected = {(a, b) for a in texts for b in texts if a < b and form(texts[a]) and form(texts[a]) == form(texts[b] or "") and texts[a] != texts[b]}
    got = [tuple(x) for x in visible.look_same_pairs(df).collect()]
    assert set(got) == expected and len(got) == len(expected)
    assert (1, 2) in expected and (11, 12) in expected and (1, 7) not in expected
    forms = visible.normalize_visible(df).collect()
    assert len(forms) == len(rows) and all(x["text"] == form(texts.get(x["doc_idx"], "Anno domini")) for x in forms)
    assert visible.look_same_pairs(df.limit(0)).collect() == []
    monkeypatch.setattr(visible, "BLOCK_ROWS", 2)
    assert {tuple(x) for x in visible.look_same_pairs(df).collect()} == expected
    members = {x["doc_idx"]: (x["class_id"], x["group_id"]) for x in visible.look_same_members(df).collect()}
    assert members == {1: (1, 1), 2: (2, 1), 7: (1, 1), 8: (8, 1), 11: (11, 11), 12: (12, 11)}


def test_canonically_equal_spellings_have_one_form():
    form = visible.visible_form()
    other = [c for c in map(chr, (*range(0xC0, 0xD800), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20))) if unicodedata.normalize("NFD", c) != c]
    assert [hex(ord(c)) for c in other if form(f"x{c}y") != form(f"x{unicodedata.normalize('NFD', c)}y")] == []
    for parts in ((0x9C7, 0x9BE), (0xBC6, 0xBBE), (0xD46, 0xD3E), (0xCC6, 0xCC2, 0xCD5), (0xDD9, 0xDCF, 0xDCA)):
        spelled = "".join(map(chr, parts))
        assert form(spelled) == unicodedata.normalize("NFC", spelled) == form(form(spelled))
    assert form(chr(0x2F800)) == chr(0x4E3D)
