import random

from brindle.llm.minhash import clusters
from brindle.llm.pairs import copied_share, defects, even, is_empty, is_wrong_language, opening_sentence, values_in

PROMPT = "Write short notes on every piece of metadata you can see in the page. Keep names exactly as they are written. Leave a field out rather than guess it."
GERMAN = '{"name": "Oral history", "description": "Die Aufzeichnung bleibt 9 Tage lang abrufbar und wird nicht verschickt."}'


def test_empty():
    for t in (None, "", " \n", "N/A", "```json\n```", "```json\n{}\n```", "[]", "null", '""', '{"description": ""}', '{"a": [], "b": {"c": null}}', "..."):
        assert is_empty(t), t
    assert [values_in(t) for t in ("a b", "a\n\nb", '{"error": "a b"}', '{"a": "b", "c": [1]}', '{"a": "b", "c": [1', 'So: {"a": 1}', '```json\n{"a": "b"}\n```')] == [1, 2, 1, 2, 2, 2, 1]
    for t in ('{"relevant": false}', "0", "No courses were found.", '{"items": [], "relevant": true}', "{broken", "[" * 3000):
        assert not is_empty(t), t


def test_long_shells_and_openings():
    for t in ('{"items": [' + ", ".join(['{"name": "", "url": null}'] * 400) + "]}", "{" + " " * 3000 + '"a": ""' + "}", "```json\n[" + '"", ' * 900 + '""]\n```'):
        assert len(t) > 2000 and is_empty(t)
    assert not is_empty('{"items": [' + ", ".join(['{"name": ""}'] * 400) + ', {"name": "A course"}]}')
    assert even("one " * 60 + "a 12") == "one " * 60 + "a 0"


def test_language():
    assert is_wrong_language(PROMPT, GERMAN)
    assert not is_wrong_language(PROMPT + " Write every description in German.", GERMAN)
    assert is_wrong_language(PROMPT + " Write every description in French.", GERMAN)
    assert not is_wrong_language(PROMPT, '{"name": "Droit d\'auteur et les autres", "description": "The fee is the same for all of the members."}')
    assert not is_wrong_language(PROMPT, None) and not is_wrong_language(None, GERMAN)


def test_copy():
    assert copied_share(PROMPT, "> " + PROMPT.upper()) == 1.0
    assert copied_share(PROMPT, PROMPT + ' {"a": "' + "other words " * 20 + '"}') < 0.5
    assert copied_share(PROMPT, "Keep names exactly as they are written. " + "Another sentence of the answer follows here. " * 2) == 0.0
    assert copied_share(None, "x") == 0.0 and copied_share("a", "") == 0.0


def test_opening():
    assert even(opening_sentence('```json\n{"@type": "Event", "reason": "I can\'t do 12 of it. More."}\n```')) == "i cant do 0 of it"
    assert opening_sentence("Here is it:\n**Title of it**\n- First one stands. Second.") == "First one stands."
    assert opening_sentence("{") == ""


def test_clusters(spark):
    a = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty t1 t2 t3 t4"
    near, far = a + " t5", a[:40] + " quite another text it is"
    df = spark.createDataFrame([(t,) for t in (a, a, near, far, "", "short text", None)], "text string")
    got = {r.text: r.cluster for r in clusters(df).collect()}
    assert got[a] == got[near] and len(set(got.values())) == 4 and len(got) == 5
    assert clusters(df.limit(0)).count() == 0


def test_all_near_texts_are_linked(spark):
    """Random texts with a few words replaced: the clusters equal those of all pairs, also where shingles are dealt in blocks."""
    rnd = random.Random(3)
    texts = []
    for _ in range(6):
        words = [f"w{rnd.randrange(500)}" for _ in range(40)]
        for _ in range(25):
            words = list(words)
            words[rnd.choice([0, 0, 1, 38, 39, 39, 20])] = f"w{rnd.randrange(500)}"
            texts.append(" ".join(words))
    texts = sorted(set(texts))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(36)} for t in texts]
    want = {t: t for t in texts}
    for i, a in enumerate(texts):
        for j in range(i):
            b, both = texts[j], len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) and want[a] != want[b]:
                old, new = max(want[a], want[b]), min(want[a], want[b])
                want = {t: new if c == old else c for t, c in want.items()}
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r.text: r.cluster for r in clusters(df).collect()} == want
    assert {r.text: r.cluster for r in clusters(df, block=4).collect()} == want


def test_pairs_at_the_least_similarity_are_linked(spark):
    """400 pairs of similarity 0.8 exactly: each is a cluster of two."""
    rnd = random.Random(4)
    firsts = [[f"w{rnd.randrange(10**6)}" for _ in range(40)] for _ in range(400)]
    df = spark.createDataFrame([(" ".join(w),) for a in firsts for w in (a, [*a[:3], "other", *a[4:]])], "text string")
    assert [r["count"] for r in clusters(df).groupBy("cluster").count().collect()] == [2] * 400


OTHER = ["List all the courses with their dates and places.", "Which people teach here, and on what days do they do it?", "Sum up this text in a few short words for a newsletter.", "Say whether the fragment holds any training at all."]
SCHEMA = "run_id string, id int, source string, task string, prompt_preview string, response_preview string"


def test_defects(spark):
    rows = [("r", i, "s", f"t{i % 2}", OTHER[i], "I am unable to process this page. It is private.") for i in range(3)]
    rows += [("r", 3, "s", "t0", PROMPT, '{"error": "I am unable to process this page."}'), ("r", 10, "s", "t0", PROMPT, "The archive refuses files without a checksum. It is so."), ("r", 11, "s", "t0", PROMPT, "[]"), ("r", 12, "s", "t0", PROMPT, PROMPT)]
    rows += [("r", 13, "s", "t0", PROMPT, GERMAN), ("r", 14, "s", "t0", PROMPT, GERMAN[:-20]), ("r", 14, "s", "t0", PROMPT, GERMAN[:-20]), ("r", 15, None, None, None, None)]
    rows += [("r", 16, "s", "t1", PROMPT, "The notes say much. I can't see a date in this text, sorry; the rest is filled in.")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA + ", defect string")
    got = {(r.id, r.defect) for r in defects(df).collect()}
    assert got == {*[(i, "refusal") for i in range(4)], (11, "empty"), (12, "copy"), (13, "wrong_language"), (14, "wrong_language"), (14, "truncated"), (15, "empty")}
    assert defects(df.limit(0)).count() == 0


def test_recurrence_decides(spark):
    """One and the same text is a refusal where it recurs bare under unrelated prompts and tasks, in a language nobody listed; no other one is."""
    text = "Olen pahoillani mutta en voi auttaa tässä asiassa nyt enkä myöhemmin."
    whole = '{{"name": "Course {}", "description": "Coffee and lunch are included in the fee; travel is not.", "url": "https://a.example/{}"}}'

    def found(rows, **more):
        df = spark.createDataFrame([("r", i, "s", *r) for i, r in enumerate(rows)], SCHEMA)
        return {r.id for r in defects(df, **more).where("defect = 'refusal'").collect()}

    bare = [(f"t{i % 2}", p, text) for i, p in enumerate(OTHER)]
    answers = [(f"t{i % 2}", p, whole.format(i, i)) for i, p in enumerate(OTHER)]
    assert found(bare + answers) == {0, 1, 2, 3}
    assert found(bare[:2] + answers) == set() and found(bare[:2] + answers, recurring=1) == {0, 1}
    assert found([("t0", p, r) for _, p, r in bare]) == set()  # the answer of one task
    related = [(f"t{i}", f"{PROMPT} Number {i}. URL: https://a.example/{'xyz'[i]}", text) for i in range(3)]
    assert found(related) == set() and found([*related[:1] * 5, *related]) == set()
