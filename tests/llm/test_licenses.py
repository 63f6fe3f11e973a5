import random

from helpers import alnum, documents, rows

from opinspark.llm.licenses import PHRASES, TEMPLATES, scan_licenses


def test_phrases_match_brute_force(spark):
    pieces = ["GNU General Public License", "the Apache License", "cc by cc BY", "MIT License", "cc-by", "gnu general", "mit licenses"]
    pieces += ["Licensed under the Apache License, Version 2.0.", TEMPLATES["mit"][0], TEMPLATES["bsd"][0]]
    docs = rows(4, 200, pieces=pieces) + [(900, "cc", "", "", 0, 0, "", 0), (900, "MIT license", "", "", 0, 0, "", 0)]
    got = scan_licenses(documents(spark, docs)).collect()
    expected = []
    for doc, text, *_ in docs:
        words, places = alnum(text), []
        for phrase, label in PHRASES.items():
            p = phrase.split()
            places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
        expected.append((doc, len(words), tuple(sorted(places))))
    assert sorted((r.doc_id, r.n_words, tuple(map(tuple, r.places))) for r in got) == sorted(expected)
    assert any(r.places for r in got)


def test_templates_with_edits(spark):
    words = alnum(TEMPLATES["mit"][0])
    edited = " ".join(words[:8] + ["really"] + words[8:14] + words[15:])  # one word put in, one lost
    docs = [(1, f"intro {edited} outro", "", "", 0, 0, "", 0), (2, "free of charge to anyone", "", "", 0, 0, "", 0), (None, TEMPLATES["bsd"][0], "", "", 0, 0, "", 0)]
    got = {r.doc_id: r for r in scan_licenses(documents(spark, docs)).collect()}
    assert [(s.label, s.first, s.end) for s in got[1].spans] == [("mit", 1, 1 + len(words))]
    assert not got[2].spans and [s.label for s in got[None].spans] == ["bsd"]
    assert scan_licenses(documents(spark, [])).count() == 0


def brute_spans(text, slack=3, least=0.6):
    """Votes of all 4-grams, word by word."""
    words, out = alnum(text), set()
    for label, texts in TEMPLATES.items():
        for t in map(alnum, texts):
            votes = {}
            for i in range(len(words) - 3):
                for j in range(len(t) - 3):
                    if words[i : i + 4] == t[j : j + 4]:
                        votes.setdefault(i - j, []).append((i, j))
            runs = []
            for d in sorted(votes):
                if runs and d - runs[-1][-1] <= slack:
                    runs[-1].append(d)
                else:
                    runs.append([d])
            for run in runs:
                own = [v for d in run for v in votes[d]]
                if len({j for _, j in own}) / (len(t) - 3) >= least:
                    out.add((label, min(i for i, _ in own), max(i for i, _ in own) + 4))
    return out


def test_spans_match_brute_force_on_damaged_texts(spark):
    rng = random.Random(8)
    docs, truth = [], []
    for i in range(120):
        label = rng.choice(sorted(TEMPLATES))
        words = " ".join(TEMPLATES[label]).split()
        damage = rng.choice([0, 0, 1, 3, 6, len(words) // 4])
        for _ in range(damage):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], ["xx"], [words[at], "yy"]])
        docs.append((i, "/* Copyright 2020 somebody\n * " + "\n * ".join([" ".join(words[k : k + 9]) for k in range(0, len(words), 9)]) + " */ code here", "", "", 0, 0, "", 0))
        truth.append((label, damage))
    docs += [(500 + i, " ".join(rng.choice("the software license is of and to any copy".split()) for _ in range(300)), "", "", 0, 0, "", 0) for i in range(20)]
    got = {r.doc_id: {(s.label, s.first, s.end) for s in r.spans} for r in scan_licenses(documents(spark, docs)).collect()}
    assert got == {d[0]: brute_spans(d[1]) for d in docs}
    light = [(i, label) for i, (label, damage) in enumerate(truth) if damage <= 3]
    assert sum(any(s[0] == label for s in got[i]) for i, label in light) / len(light) >= 0.95
    assert not any(got[500 + i] for i in range(20))
