"""Recall and precision on cases planted here, not on forms taken from the code."""

import random

import pytest

from scriptorium.llm import defects, language, scans, sentences

NOUNS = "mortar levy gantry scaffold penstock culvert embankment warranty handover drawing payroll tender hoist parapet girder retention".split()
VERBS = "approved measured withheld inspected recorded extended certified replaced rejected deposited".split()
WHO = "the contractor,the employer,the tribunal,the surveyor,the executive engineer,the labour officer".split(",")


def sentence(rng):
    return f"{rng.choice(WHO).capitalize()} {rng.choice(VERBS)} the {rng.choice(NOUNS)} of the {rng.choice(NOUNS)} within {rng.randint(2, 90)} days after the {rng.choice(NOUNS)} was {rng.choice(VERBS)}."


def test_scans_recall(spark):
    rng = random.Random(1)
    titles = spark.createDataFrame([("gcw", "General Conditions of Works"), ("arb", "Award Review Reports")], "doc_id string, doc_title string")
    rows, want = [("chunk", f"clean{i}", 0, " ".join(sentence(rng) for _ in range(5))) for i in range(300)], set()
    for i in range(300):
        words = " ".join(sentence(rng) for _ in range(6)).split()
        kinds = {k for k in ("broken_word", "misread", "header", "page_number") if rng.random() < 0.4}
        if "misread" in kinds:
            at = rng.choice([k for k, w in enumerate(words) if w.isalpha() and w.islower() and len(w) > 5 and "o" in w or "l" in w[1:] and w.isalpha() and len(w) > 5])
            words[at] = words[at].replace("o", "0", 1) if "o" in words[at] else words[at][0] + words[at][1:].replace("l", "1", 1)
        lines = [" ".join(words[k : k + 9]) for k in range(0, len(words), 9)]
        if "broken_word" in kinds:
            k = rng.randrange(len(lines) - 1)
            first, _, rest = lines[k + 1].partition(" ")
            whole = rng.choice([w for w in ("contractor", "embankment", "scaffold", "withheld")])
            lines[k], lines[k + 1] = f"{lines[k]} {whole[:4]}-", f"{whole[4:]} {first} {rest}"
        if "header" in kinds:
            lines.insert(rng.randrange(1, len(lines)), rng.choice(["GENERAL CONDITIONS OF WORKS", "Award Review Reports 17", "General Conditions of Works | 9"]))
        if "page_number" in kinds:
            lines.insert(rng.randrange(1, len(lines)), rng.choice(["Page 12", "- 34 -", "56", "[7]", "p. 8 of 90"]))
        rows.append(("chunk", f"n{i}", 0, "\n".join(lines)))
        want |= {(f"n{i}", k) for k in kinds}
    got = {(r.record_id, k) for r in scans.repair(spark.createDataFrame(rows, "src string, record_id string, para_no int, text string"), titles).collect() for k in r.kinds}
    assert len(got & want) >= 0.97 * len(want) and len(got & want) >= 0.97 * len(got), (sorted(want - got)[:5], sorted(got - want)[:5])


ELSEWHERE = {
    "de": "Der Auftragnehmer muss die Frist nach dem Vertrag einhalten und wird bei der Prüfung nicht entlastet.", "fr": "Le tribunal a jugé que la retenue est due et que le délai ne peut être prolongé.",
    "es": "El contratista debe devolver la garantía cuando la obra no se ha entregado en el plazo.", "zh": "承包人应当在十五天内提交竣工报告，否则不予支付。", "hi": "ठेकेदार को समय पर भुगतान नहीं किया गया था।",
}


def test_defects_recall(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for i in range(600):
        q = f"Who bears the cost of the {rng.choice(NOUNS)} if {rng.choice(WHO)} {rng.choice(VERBS)} the {rng.choice(NOUNS)} during the {rng.choice(NOUNS)} of the {rng.choice(NOUNS)} on {rng.randint(1, 28)} March {rng.randint(1995, 2024)}?"
        good = " ".join(sentence(rng) for _ in range(rng.randint(1, 3)))
        kind = rng.choice(["", "", "empty", "truncated", "refusal", "copies_question", "other_language"])
        if kind == "empty":
            a = rng.choice([None, "", "  ", "[S1]", "- [S2]", "..."])
        elif kind == "truncated":
            words = good.split()
            a = " ".join(words[: rng.randint(4, len(words) - 2)]).rstrip(".")
            kind = kind if not a.endswith(".") else ""
        elif kind == "refusal":
            a = rng.choice(["I'm sorry, but I can't help with that.", "As an assistant I am not able to answer this question.", "I cannot give an opinion on this matter.", "The documents do not mention this.", "No answer could be found in the sources."])
        elif kind == "copies_question":
            a = rng.choice([q, q + " [S1]", "The question was: " + q, q.lower(), q + "\n" + q, q.replace("during", "in the course of")])
        elif kind == "other_language":
            a = rng.choice(list(ELSEWHERE.values())) + " [S1]"
        else:
            a = good + rng.choice(["", " [S1]", " [S1][S2]"])
        rows.append((i, q, a, True))
        want[i] = kind
    got = {r.result_id: r.defect for r in defects.flag(spark.createDataFrame(rows, "result_id long, question string, answer string, answerable boolean")).collect()}
    wrong = [(want[i], got.get(i, ""), rows[i][2]) for i in want if got.get(i, "") != want[i]]
    assert len(wrong) <= 0.03 * len(rows), wrong[:8]


def test_sentence_recall():
    rng = random.Random(3)
    parts = {
        "en": ["Cl. 4.2 holds as printed.", "See Fig. 3 and Table 2 for 1.5 m.", "He asked why?", "The rate of Rs. 45.5 lakh stands!", 'The letter said: "It is due. It stands." and he relied on it.', "M/s. Karan Pvt. Ltd. signed it.", "The Dy. Engr. approved it."],
        "de": ["Die Frist nach Ziff. 4 ist nicht offen.", "Das gilt z. B. für den Turm.", "Am 3. März wurde es geprüft.", "Warum bleibt das offen?"],
        "fr": ["L'art. 5 ne vaut pas pour la tour.", "M. Dupont a signé.", "Pourquoi est-ce dû ?"], "es": ["El art. 4 no vale para la obra.", "¿Quién paga la obra?", "La pág. 7 lo dice."],
        "zh": ["承包人应当提交报告。", "为什么不付？", "来函写道：“不再支付。照常计算。”双方没有异议。"], "hi": ["ठेकेदार को भुगतान किया गया।", "डॉ. शर्मा ने जाँच की।"],
    }
    hit = n = made = 0
    for lang, own in parts.items():
        for _ in range(60):
            chosen = [rng.choice(own) for _ in range(rng.randint(2, 6))]
            text, ends = "", []
            for s in chosen:
                text += s + rng.choice(["", " [S1]"]) if lang != "zh" else s
                ends.append(len(text))
                text += "" if lang == "zh" else rng.choice([" ", "\n", "  "])
            got = sentences.sentence_ends(text)
            hit, n, made = hit + len(set(got) & set(ends)), n + len(ends), made + len(got)
    assert hit >= 0.97 * n and hit >= 0.97 * made, (hit, n, made)


TOLD = {
    "en": "the contractor shall pay the employer within thirty days of the notice and the award is final where both parties have signed it", "de": "der auftragnehmer muss die frist innerhalb von zehn tagen schriftlich einhalten und die prüfung wird nicht wiederholt wenn beide seiten zustimmen",
    "fr": "le tribunal a jugé que la pénalité ne pouvait être confondue avec la garantie et que le délai reste ouvert pour les deux parties", "es": "el contratista debe devolver la garantía cuando la obra no se presenta a tiempo y el plazo queda abierto para ambas partes",
    "pt": "o empreiteiro deve devolver a garantia quando a obra não for entregue no prazo e o tribunal ainda não decidiu sobre a multa", "hi": "ठेकेदार को समय पर भुगतान नहीं किया गया क्योंकि माप पुस्तिका पूरी नहीं हुई थी और निरीक्षण बाकी था",
}


@pytest.mark.parametrize("seed", [4])
def test_language_recall(spark, seed):
    rng = random.Random(seed)

    def line(lang):
        words = TOLD[lang].split()
        return " ".join(rng.choice(words) for _ in range(12))

    rows, want = [], set()
    for i in range(400):
        own = rng.choice(list(TOLD))
        lines = [line(own) for _ in range(6)]
        label = own
        if rng.random() < 0.3:
            other, at = rng.choice([x for x in TOLD if x != own]), rng.randrange(6)
            lines[at] = line(other)
            want.add((i, at + 1, other))
        if rng.random() < 0.1:
            label = rng.choice([x for x in TOLD if x != own])
            want = {w for w in want if w[0] != i} | {(i, k + 1, own) for k, t in enumerate(lines) if all(w in TOLD[own].split() for w in t.split())}
        rows.append((i, "\n".join(lines), label))
    found = language.label_lines(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = {(r.doc_id, r.line_no, r.lang) for r in found.filter("label <> lang AND n_letters >= 20").collect()}
    assert len(got & want) >= 0.97 * len(want) and len(want) > 150, sorted(want - got)[:5]
