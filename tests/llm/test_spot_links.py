"""Similar fingerprints against all pairs, signatures against a plain version, long lists, odd rows."""

import random
import re

import pytest

from denseblocks.llm import spotsigs


def plain(text):
    """Chains of an anchor and the next content words, as tuples of words; all words where there is none."""
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    anchors = set(spotsigs.ANCHORS)
    out = set()
    for i, x in enumerate(w):
        chain = [y for y in w[i + 1 :] if y not in anchors][: spotsigs.CHAIN]
        if x in anchors and len(chain) == spotsigs.CHAIN:
            out.add((x, *chain))
    return out or ({tuple(w)} if w else set())


def documents():
    rng = random.Random(8)
    word = lambda: rng.choice(spotsigs.ANCHORS[:20]) if rng.random() < 0.4 else f"w{rng.randint(0, 3000)}"
    base = [word() for _ in range(160)]
    out = []
    for i in range(90):  # near copies, some of them equal
        t = list(base)
        for j in range(rng.randint(0, 9)):
            t[rng.randrange(160)] = f"x{i}-{j}"
        out.append(" ".join(t))
    out += [" ".join(base[: 130 + i]) for i in range(30)] + [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(60)]
    out += [out[0].upper().replace("W", "w")] * 3 + ["only words here", "only words here", "The of and"]
    return [(i * 3, t) for i, t in enumerate(out)] + [(0, out[0]), (None, out[5]), (None, "a text of its own without an id in the table"), (5, ""), (7, None), (8, " \n")]


def test_signatures_are_those_of_a_plain_version():
    docs = [t for _, t in documents()]
    sizes = [len(s) for s in spotsigs.signatures([t.encode() if t is not None else None for t in docs])]
    assert sizes == [len(plain(t)) for t in docs]
    likes = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    coded = spotsigs.signatures([(t or "").encode() for t in docs])
    for i in range(0, len(docs), 7):
        for j in range(0, len(docs), 5):
            assert abs(spotsigs.likeness(coded[i], coded[j]) - likes(plain(docs[i]), plain(docs[j]))) < 1e-12


@pytest.mark.parametrize("cell", [1024, 5])
def test_links_and_pairs(spark, cell, monkeypatch):
    monkeypatch.setattr(spotsigs, "CELL", cell)
    docs = documents()
    sets = [frozenset(plain(t)) for _, t in docs]
    alike = lambda a, b: bool(a) and bool(b) and len(a & b) >= 0.8 * len(a | b)
    ids = {}
    for (d, _), s in zip(docs, sets):
        ids.setdefault(s, []).append(d)
    name = {s: min((d for d in x if d is not None), default=None) for s, x in ids.items()}
    key = lambda r: tuple((x is None, x) for x in r)
    want = sorted(((d, name[s], len(ids[s]), sum(alike(s, o) for o in sets) - 1) if s else (d, d, 1, 0) for (d, _), s in zip(docs, sets)), key=key)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, sigs string").repartition(5)
    assert sorted(map(tuple, spotsigs.links(df).collect()), key=key) == want and max(r[3] for r in want) > 40
    some = [s for s in ids if s]
    pairs = {tuple(sorted((name[a], name[b]), key=lambda x: (x is not None, x))) for i, a in enumerate(some) for b in some[:i] if alike(a, b)}
    got = [(r.a, r.b) for r in spotsigs.similar(df).collect()]
    assert set(got) == pairs and len(got) == len(pairs)
    assert spotsigs.links(df.limit(0)).count() == 0 and spotsigs.similar(df.limit(0)).count() == 0


def test_many_ranges(spark, monkeypatch):
    """The same rows whatever the number of ranges of ids."""
    df = spark.createDataFrame(documents(), "doc_id long, text string").repartition(3)
    want = sorted(map(repr, spotsigs.fingerprints(df).collect()))
    monkeypatch.setattr(spotsigs, "TASK_BYTES", 400)
    assert sorted(map(repr, spotsigs.fingerprints(df).collect())) == want
