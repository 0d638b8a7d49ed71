import itertools
import random

from quillon.llm import boilerplate as B
from quillon.llm import subjects as S


def test_min_cut_is_the_least():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randrange(1, 8)
        costs = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]

        def cost(ls):
            return sum(c for c, x in zip(costs, ls) if c > 0 and not x) + sum(-c for c, x in zip(costs, ls) if c < 0 and x) + sum(w for a, b, w in edges if ls[a] != ls[b])

        best = min(cost(ls) for ls in itertools.product([False, True], repeat=n))
        assert abs(cost(B.min_cut(costs, edges)) - best) < 1e-6


PAGE = """Home | World | Sport | Shop

Home | World | Storm hits the northern harbour
Storm hits the northern harbour
The storm reached the northern harbour on Monday and damaged the old quay.
Advertisement
Officials said the quay would stay closed for the rest of the month.
Terms of use were rewritten twice, the filing shows.
Share this article
Most read
12. Another match for Quarry
Comments (12)
Privacy policy
© 2024 Daily"""


def test_boilerplate(spark):
    rows = [(f"p{i}", f"https://daily{i % 3}.example/{i}", PAGE.replace("Monday", f"day {i}")) for i in range(30)]
    rows += [("n", "https://x.example", None), ("e", None, ""), ("b", "", " \n\n "), ("u", None, "Just one line of prose that says something about the quay.")]
    df = spark.createDataFrame(rows, "entity_id string, url string, text string")
    got = {}
    for r in B.boilerplate_lines(df).collect():
        got.setdefault(r.entity_id, set()).add(r.line_no)
    assert got["p3"] == {1, 3, 6, 9, 10, 11, 12, 13, 14}
    assert not {"n", "e", "b"} & set(got) and "u" not in got
    assert B.boilerplate_lines(df.limit(0)).count() == 0


def test_sentences():
    assert [len(x) for x in S.sentences("One two three. sha1: 926b1d2eed79ead5bdd1bce5274048b8eb4c52c4\nif (a >= 5) {\nFour five six!")] == [3, 3]
    assert S.sentences(None) == [] == S.sentences("  ")
    assert S.language_of("der Hafen und die Stadt") == 1 and S.language_of("порт и город") == 6 and S.language_of(None) == 0


def test_language_of_a_text_with_a_long_beginning():
    german = "Der Hafen und die Stadt sind nicht mit dem Schiff verbunden. " * 20
    assert S.language_of("0x3f2a == 1;\n" * 400 + german) == 1
    assert S.language_of("The harbour was not for the town. " * 5 + "lorem " * 1000 + german) == 1


def test_subjects(spark):
    rng = random.Random(2)
    words = {
        "sport": "goalkeeper tournament penalty league", "law": "verdict tribunal appeal statute", "sea": "tanker harbour anchor cargo",
        "war": "siege truce trench garrison", "money": "dividend bond coupon lender", "code": "compiler parser refactoring changelog",
    }
    names = list(words)
    docs, labels = [], []
    for i in range(360):
        s = names[i % 6]
        ws = words[s].split()
        docs.append((i, " ".join(f"Nobody had expected the {rng.choice(ws)} near the {rng.choice(ws)} this much." for _ in range(4))))
        if i < 120:
            labels.append((i, s))
    docs += [(900, None), (901, ""), (902, "Nothing more was said of it today."), (903, "Nobody had expected the verdict of the tribunal this much. They spoke of the penalty and the league that day."), (1, docs[1][1])]
    labels += [(1, "unknown"), (5555, "law")]
    a = spark.createDataFrame([(n, n) for n in names], "subject string, title string")
    d, l = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, subject string")
    got = {}
    for r in S.document_subjects(d, l, a).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert sum(got.get(i) == {names[i % 6]} for i in range(360)) >= 350
    assert got[903] == {"sport", "law"} and not {900, 901, 902} & set(got)
    assert S.document_subjects(d.limit(0), l, a).count() == 0 and S.document_subjects(d, l.limit(0), a).count() == 0
