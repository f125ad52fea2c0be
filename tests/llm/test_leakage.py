import random

from brindle.llm.leakage import leaks, stretch
from brindle.llm.words import split_words

STOCK = "Answer with one number only."
RND = random.Random(4)
VOCABULARY = [a + b for a in ("ka", "lo", "mi", "ne", "pu") for b in ("bra", "dil", "fos", "gun", "het", "jar", "kim")]
ITEMS = {i: " ".join(RND.choice(VOCABULARY) + str(RND.randrange(30)) for _ in range(45)) + ". " + STOCK for i in range(6)}


def leaked(i, start, n, alter=()):
    w = ITEMS[i].split()[start : start + n]
    for a in alter:
        w[a] = "zzz"
    return w


def test_stretch():
    item = ITEMS[0].split()[:45]
    assert stretch(["x", *item, "y"], item, 20, 12) == (0, 45, 0)
    assert stretch(item[5:24], item, 20, 12) is None
    assert stretch(item[5:25], item, 20, 12) == (5, 20, 0)
    for change, want in ((lambda w: w[:9] + ["z"] + w[10:], 1), (lambda w: w[:9] + w[10:], 1), (lambda w: w[:9] + ["z"] + w[9:], 1)):
        assert stretch(change(item[5:30]), item, 20, 12)[2] == want
    assert stretch([w if k % 6 else "z" for k, w in enumerate(item)], item, 20, 12) is None
    assert stretch(item[20:] + item[:20], item, 20, 12)[1] == 25
    assert stretch([], item, 20, 12) is None and stretch(["the"] * 5000, item, 20, 12) is None


def test_words():
    long_tag = '<a href="' + "x" * 3000 + '">'
    assert split_words(f"The E-mail of {long_tag}caf&eacute;</a><br/>the caf\u00e9 &amp; cafe\u0301\\n2nd") == ["the", "email", "of", "caf\u00e9", "the", "caf\u00e9", "caf\u00e9", "2nd"]
    assert split_words(None) == split_words("") == split_words("<p> !</p>") == []
    assert len(split_words("<" * 20_000 + "a")) == 1


def test_common_words_and_brute_force(spark):
    """A corpus of few words, one of them a third of all: the search equals the alignment of every document with every item."""
    rnd = random.Random(9)
    common = ["the"] * 14 + [f"w{i}" for i in range(28)]
    items = {i: [rnd.choice(common) for _ in range(36)] for i in range(8)}
    docs = {}
    for d in range(60):
        body = [rnd.choice(common) for _ in range(80)]
        if d % 2:
            i, a, n = rnd.randrange(8), rnd.randrange(10), rnd.randrange(18, 27)
            piece = items[i][a : a + n]
            for k in range(rnd.randrange(3)):
                piece[rnd.randrange(len(piece))] = rnd.choice(["the", "zz"])
            body[30:30] = piece
        docs[d] = body
    want = {(d, i): s for d, b in docs.items() for i, w in items.items() if (s := stretch(b, w, 20, 12))}
    found = leaks(
        spark.createDataFrame([(d, " ".join(b)) for d, b in docs.items()], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    )
    assert {(r.doc_id, r.item_id): (r.item_start, r.n_words, r.altered) for r in found.collect()} == want and len(want) >= 15


def test_leaks(spark):
    texts = {
        1: "Intro. " + " ".join(leaked(0, 3, 30)) + " end",
        2: "> " + " \n> ".join(f"<b>{w.upper()}</b>," for w in leaked(1, 0, 22, [11])),
        3: " ".join(leaked(2, 0, 19)),
        4: " ".join(leaked(3, 0, 40, range(5, 40, 6))),
        5: STOCK * 9,
        6: None,
        7: "",
        8: " ".join(leaked(4, 10, 24, [8, 16])) + " and " + " ".join(leaked(5, 0, 45)),
        9: "word " * 60_000 + " ".join(leaked(0, 20, 25)) + " word" * 60_000,
    }
    docs = spark.createDataFrame([(d, t, "x") for d, t in texts.items()] + [(1, texts[1], "x"), (None, texts[1], "x")], "doc_id long, text string, words string")
    items = spark.createDataFrame([*ITEMS.items(), (77, None), (None, "x"), (78, STOCK)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_words, r.altered) for r in leaks(docs, items).collect()}
    assert got == {(1, 0): (30, 0), (2, 1): (22, 1), (8, 4): (24, 2), (8, 5): (45, 0), (9, 0): (25, 0)}
    assert {(r.doc_id, r.item_id): (r.n_words, r.altered) for r in leaks(docs, items, block=60).collect()} == got  # in blocks of items
    assert leaks(docs.limit(0), items).count() == 0
    assert leaks(docs, items.limit(0)).count() == 0
