"""Sentence boundaries: one case a line, sentences parted by a bar."""

import random
import time

import pytest

from charterloom.llm.sentences import _EDGE, Candidates, best_spans, joint_score, pair_quotes, segment, sentences

CASES = [
    "Ego Petrus donavi.| Nos damus!| Quid est?",
    "Terra apud St. Gallum venit.| Dr. Berg kam z. B. am 17.8.1179 nach Wien.",
    "Census 8.10 den. 89 et vol. 3 cap. 12 est.| Item 82,2 dat.",
    "Chaque .xix. bourg rente.| Le .xx. moulin vend etc.| De la forêt garde.",
    "Ohne acker usw.| Nun löst der bürge.",
    "See kartular.example/f.223?p=2.20 there.| We go.",
    "Pro... montus dedit.| Per agros!",
    "Ego […] et Petrus donat.| Nos damus.",
    "Et finis…| De monte venit.",
    "He said: “We buy. We sell!”| Then he left.",
    "“Who comes?” asked Anna and left.| We stay.",
    "«Inter vias portavit!» rogavit Petrus et tacuit.| Item dat.",
    "Er sagte: « Der kauf gilt! » und ging.| Wir bleiben.",
    "(Ich bleibe hier.)| Nun kommt er.",
    "The lord (cf. fol. 236v.) grants it.| So it is.",
    "Charta 35|\n\nEgo dono.",
    "§ 6|\n\nQuia datur.",
    "Omnes veniunt.|\n- Anna bei Wien|\n- Berta bei Graz|\n9. Carl|\nVor Gott und allen zeugen bekennt der graf.",
    "Devant le juge et le seigneur qui tient la\ntémoin vend le blé.| Aussi il part.",
    "Wir kommen.Die andern gehen.".replace(".D", ".|D"),
    "anno 1272.| Per pontum venit.",
    "Vapunebach IV. von Wien kommt.| Er geht.",
    "Вов деб зуву… кымук.| Няс им. падыба в 1395 г. гат т. е. деб.| — Мяк «Тябы?» — дузыпы.",
    "Νάδην πάτηδυ π.χ. συμι;| Κυγα χάγ· σώγα.| Ναι.",
    "Քոտ՞ նոթա։| Տիմ շիձ։",
    "Քոտ նոթա:| Տիմ շիձ: բեմ։",
    "§ 5|\n(From the heir she owns a rent.)| If the garden is his.",
    "Vici. 73 (De donatio confirmavimus.)| (Fontus sana est.)| Item dat.".replace("Vici.", "Vici.|"),
    "बोज जन ।|डनहर डॉ. बेच 18.2 सेहोल?| के डुह॥",
    "שלח «צלח!» לחצ עמ׳ 12 כן.| מתן.",
    "كيور «هيبن!» كلمر 25.6 هنق؟| سنل.",
    "جور ، گاگ۔| چیلی؟",
    "ገደ፡ሀዘ።|ተለሰ፡ገደ፧| መረ።",
    "賣遠6.5月！|曰：「賣。買？」而人賣。|曰：「等賣。」|界且大界．|小買｡|東",
    "「寺月。人」と言いて渡。|「川！」と言いては……年川。|　畑",
    "กมกีนะ| ยีปขม|\nตาพ",
    "ცევ ფებო 33.0 ჩუტი.|ვარი ლინაფ?| ბერა.",
    "﻿ Wir Anna und Berta kommen!!!| Wer da?!",
]


@pytest.mark.parametrize("case", CASES)
def test_case(case):
    text = case.replace("|", "")
    expected = [p.strip(_EDGE) for p in case.split("|")]
    assert [text[a:b] for a, b in segment(text)] == expected


@pytest.mark.parametrize("case", [
    "तो घरी गेला.| मी आलो.| डॉ. जोशी आले.",
    "वि. वा. जोशी आले.| ते गेले.",
    "जन डनह. बेच गया।| के डुह।",
    "તે ઘર ગયો.| હું આવ્યો.",
    "அவன் வந்தான்.| ஒரு படம.| நான் போனேன்.",
    "అతను వచ్చాడు.| ఇది మన ఇల.| నేను వెళ్ళాను.",
])
def test_indic_scripts_that_close_with_a_period(case):
    text = case.replace("|", "")
    assert [text[a:b] for a, b in segment(text)] == [p.strip(_EDGE) for p in case.split("|")]


def every_segmentation(c):
    """Scores of all choices of boundaries, by brute force."""
    n, best = len(c.stops), None
    for choice in range(1 << n):
        cuts = [k for k in range(n) if choice >> k & 1]
        total, first = 0.0, 0
        for k in [*cuts, n]:
            total += joint_score(c, first, k) + (c.closing[k] + c.opening[k + 1] if k < n else 0.0)
            first = k + 1
        if best is None or total > best[0] + 1e-9 or abs(total - best[0]) < 1e-9 and len(cuts) < best[1]:
            best = total, len(cuts)
    return best


def test_no_segmentation_scores_more():
    r = random.Random(3)
    pool = ["Wort ", "wort ", "St. ", "3. ", ". ", "! ", ".\n", "Anna\n", "- ", '"Ja. ', '"', "« ", "! »", "(", ".) ", "。", "「", "」", "… ", "wort " * 90]
    for _ in range(400):
        text = "Wort " + "".join(r.choice(pool) for _ in range(r.randint(0, 14))) + "ende"
        c = Candidates(text, 0, len(text))
        if len(c.stops) > 10:
            continue
        spans = best_spans(c)
        ends = [c.stops.index(b) for _, b in spans[:-1]]
        total, first = 0.0, 0
        for k in [*ends, len(c.stops)]:
            total += joint_score(c, first, k) + (c.closing[k] + c.opening[k + 1] if k < len(c.stops) else 0.0)
            first = k + 1
        assert abs(total - every_segmentation(c)[0]) < 1e-9


def test_whole_spans_decide():
    """What the signs of single boundaries would cut, the score of the spans keeps together, or the other way round."""
    for case in ("Omnes dant.|\n9. Carl venit.", "Terra venit apud montem et silvam et pratum de villa domini\nPetri qui donat.", "The lord (cf. fol. 236v.) Redadedorf grants it.", "He said: “We buy. We sell!”| Then he left."):
        text = case.replace("|", "")
        c = Candidates(text, 0, len(text))
        own = {b for _, b in segment(text)[:-1]}
        signs = {c.stops[k] for k in range(len(c.stops)) if c.closing[k] + c.opening[k + 1] > 0}
        assert [text[a:b] for a, b in segment(text)] == [p.strip() for p in case.split("|")]
        assert own != signs or "“" in text


def test_long_texts_of_any_kind_stay_fast():
    for text in ("« " + "Terra venit apud montem. " * 2000 + "»", "(" * 5000 + ")" * 5000, ". " * 10_000, "a\n" * 10_000, "«" + '"A. ' * 3000 + "»", "- a\n" * 5000, "Terra venit. " * 5000):
        start = time.perf_counter()
        segment(text)
        assert time.perf_counter() - start < 5


def test_spans_are_ordered_and_cover_all_but_space():
    r = random.Random(8)
    pool = ["Wort ", "wort", ". ", "! ", "\n", "\n\n", '"', "«", "»", "(", ")", "'", "etc. ", "1272. ", "- ", "漢", "。", "ก ", "…", "St. ", " ", "﻿"]
    for _ in range(2000):
        text = "".join(r.choice(pool) for _ in range(r.randint(0, 40)))
        at = 0
        for a, b in segment(text):
            assert at <= a < b and text[a] not in _EDGE and text[b - 1] not in _EDGE
            assert not text[at:a].strip(_EDGE)
            at = b
        assert not text[at:].strip(_EDGE)


def test_quotes_pair():
    assert pair_quotes('a "b" c') == {4: 2}
    assert pair_quotes("„a“ “b” »c« ‹d›") == {2: 0, 6: 4, 10: 8, 14: 12}
    assert pair_quotes("it's l'an") == {}
    assert pair_quotes("(a\n\nb)") == {}


def test_table(spark):
    rows = [(1, "A word. Next one here.", 5), (1, "A word. Next one here.", 5), (2, None, 1), (3, "", 1), (4, " \n﻿", 1), (5, "Wort " * 20_000 + ".", None), (None, "So it is.", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, start_pos int")
    got = sorted(((x["doc_id"] is None, x["doc_id"], x["start_pos"], x["end_pos"]) for x in sentences(df).collect()), key=str)
    assert sorted(g[1:] for g in got if not g[0]) == [(1, 0, 7), (1, 0, 7), (1, 8, 22), (1, 8, 22), (5, 0, 100_001)]
    assert sentences(df.limit(0)).collect() == []
