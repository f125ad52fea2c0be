import random

from brindle.llm.subjects import Settings, Terms, hashed_sentences, subject_areas

TOPICS = {
    "physics": "neutron photon magnet beam detector plasma laser muon wavefront spin".split(),
    "law": "contract consent copyright licence liability patent privacy court statute clause".split(),
    "sport": "sprint muscle rowing recovery nutrition balance marathon swimming gait stamina".split(),
}
PLAIN = ["The room is open from nine.", "Please bring a laptop and a pen.", "The fee is due on the first day.", "Slides are shared after the last session.", "Lunch is not included in the fee."]
SETTINGS = Settings(rank=12, rounds=2, passes=2)


def sentence(rnd, subject):
    a, b = rnd.sample(TOPICS[subject], 2)
    return rnd.choice([f"We read about the {a} and then the {b}.", f"This part of the course is on {a} with {b}.", f"Why the {a} fails without the {b} is explained."])


def corpus(n=240):
    rnd = random.Random(5)
    docs, truth = [], {}
    for d in range(n):
        first, second = rnd.sample(sorted(TOPICS), 2)
        own = [sentence(rnd, first) for _ in range(5)] if d % 8 else []
        if d % 3 == 1 and own:
            own += [sentence(rnd, second) for _ in range(4)]
        if d % 3 == 2:
            own += [sentence(rnd, second)]
        truth[d] = ({first} if d % 8 else set()) | ({second} if d % 3 == 1 and d % 8 else set())
        rest = rnd.sample(PLAIN, 3)
        mixed = own + rest
        rnd.shuffle(mixed)
        docs.append((d, " ".join(mixed), "clash"))
    return docs, truth


def test_held_out(spark):
    docs, truth = corpus()
    labels = [(d, f" {next(iter(truth[d]))}".upper()) for d in range(0, 90) if len(truth[d]) == 1] + [(5, "no such"), (None, "law"), (9999, "law"), (3, None)]
    df = spark.createDataFrame([*docs, docs[0], (500, None, ""), (501, "", ""), (None, "x y", ""), (502, "ab " * 50_000, "")], "doc_id long, text string, subject string")
    areas = spark.createDataFrame([(s, s, " ".join(w[:2])) for s, w in TOPICS.items()], "subject string, name string, description string")
    found = subject_areas(df, areas, spark.createDataFrame(labels, "doc_id long, subject string"), settings=SETTINGS)
    got = {(r.doc_id, r.subject) for r in found.collect()}
    want = {(d, s) for d in truth for s in truth[d] if d >= 90}
    held = {(d, s) for d, s in got if d >= 90}
    assert len(held & want) / len(want) > 0.9 and len(held & want) / len(held) > 0.9
    assert not [d for d, _ in got if d is None or d >= 500]


def test_labelled_seeds_stay_without_plain_documents(spark):
    """No document is plain: the labelled ones stay seeds in the rounds after the first, though the descriptions say nothing."""
    docs, truth = corpus(160)
    labels = [(d, next(iter(truth[d]))) for d in range(90) if len(truth[d]) == 1]
    areas = spark.createDataFrame([(s, "", "A part of the course.") for s in TOPICS], "subject string, name string, description string")
    df = spark.createDataFrame(docs, "doc_id long, text string, subject string")
    found = subject_areas(df, areas, spark.createDataFrame(labels, "doc_id long, subject string"), settings=Settings(rank=12, rounds=2, passes=2, plain=1.1))
    held = {(r.doc_id, r.subject) for r in found.collect() if r.doc_id >= 90}
    want = {(d, s) for d in truth for s in truth[d] if d >= 90}
    assert len(held & want) / len(want) > 0.9 and len(held & want) / len(held) > 0.9


def test_empty(spark):
    areas = spark.createDataFrame([("law", "Law", "courts")], "subject string, name string, description string")
    labels = spark.createDataFrame([], "doc_id long, subject string")
    none = spark.createDataFrame([], "doc_id long, text string")
    assert subject_areas(none, areas, labels, settings=SETTINGS).count() == 0
    assert subject_areas(spark.createDataFrame([(1, "a text of words")], "doc_id long, text string"), areas.limit(0), labels, settings=SETTINGS).count() == 0
    subject_areas(spark.createDataFrame([(1, "a text of words")], "doc_id long, text string"), areas, labels, settings=SETTINGS).count()


def test_terms():
    terms = Terms(1 << 16, kept=3)
    got = hashed_sentences("One two. Zwei über!\nÉtude नमस्ते a 12 — x3y", terms)
    want = [["one", "two"], ["zwei", "über"], ["étude", "नमस्ते"]]
    assert got == [[terms[w] for w in ws] for ws in want] and hashed_sentences(None, terms) == hashed_sentences(" .\n!", terms) == []
    assert hashed_sentences("über", terms) == [[terms["über"]]] and len(terms) <= 3
