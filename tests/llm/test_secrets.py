import random
import re
import time

import numpy as np
from helpers import documents, rows

from opinspark.llm import secrets as S

KINDS = {
    "assign": (r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12),
    "access": (r"AKIA[A-Z0-9]+", 18),
    "hex": (r"[0-9a-f]+", 16),
}


def brute(text):
    out = []
    for k, (kind, (pattern, least)) in enumerate(KINDS.items()):
        pattern = pattern.replace("(password|passwd|secret|token|api_?key)", "((?i:password|passwd|secret|token|api_?key))")
        for m in re.finditer(pattern, text, re.ASCII):
            if len(m[2] if kind == "assign" else m[0]) >= least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_matches_plain_patterns():
    rng = random.Random(1)
    bits = ["password", "PassWD", "secret", "token", "api_key", "APIkey", " = ", ": ", '"', "'", "AKIA", "AKIAAKIA", "0123456789abcdef", "deadbeef", "Z9", "ABCDEFGHIJKLMNOP", "\n", "é", "ſecret", "==", "x" * 12]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert S.base_spans(text) == brute(text)


def test_held_out_lines(spark):
    docs = documents(spark, rows(3, 200))
    model = S.train(docs, most_lines=1500)
    rng = random.Random(99)
    plain = ["the quick brown fox jumps over it", "see it there", "a line of words and more words"] * 150
    hit = miss = wrong = 0
    for line, spans in S.examples(plain, rng):
        got = S.crf_spans(line, model)
        hit += sum(s in got for s in spans)
        miss += sum(s not in got for s in spans)
        wrong += sum(not any(a < e and s < b for a, b in spans) for s, e in got)
    assert hit / (hit + miss) >= 0.9
    assert wrong < 0.05 * hit


def test_stretches_decode_as_the_whole_line():
    rng = random.Random(5)
    model = S.fit(list(S.examples(["some plain words stand here today"] * 400, rng)), steps=60)
    for line, _ in S.examples(["one two three four five six seven eight"] * 200, rng):
        line = line + " " + S._make_secret(rng) + '="' + S._make_plain(rng) + '"'
        tokens = [(t.start(), t[0]) for t in S.TOKEN.finditer(line)]
        may = [S.allowed(tokens, k) for k in range(len(tokens))]
        file = S.file_features(line)
        tags = S.viterbi([m if any(a) else [0, -1e9, -1e9] for m, a in zip([model.scores(S.features(tokens, k, file)) for k in range(len(tokens))], may)], may, model.moves)
        whole = []
        for (s, t), tag in zip(tokens, tags):
            if tag == S.B:
                whole.append((s, s + len(t)))
            elif tag == S.I:
                whole[-1] = (whole[-1][0], s + len(t))
        assert S.crf_spans(line, model) == whole


def test_rows(spark):
    model = S.Model({}, np.zeros((3, 3)))
    docs = documents(spark, [(1, 'é token = "0123456789abcdef"', "", "", 0, 0, "", 0), (1, None, "", "", 0, 0, "", 0), (None, "", "", "", 0, 0, "", 0)])
    got = [[tuple(s) for s in r.spans if s.kind != "crf"] for r in S.scan_secrets(docs, model).collect()]
    assert got == [[(2, 27, "assign"), (11, 27, "hex")], [], []]
    assert S.scan_secrets(docs.limit(0), model).count() == 0
    assert S.train(docs.limit(0), most_lines=50).weights is not None


def test_long_texts_without_white_space_take_linear_time():
    model = S.fit(list(S.examples(["some plain words stand here today"] * 300, random.Random(1))), steps=40)
    rng, parts = random.Random(2), []
    while sum(map(len, parts)) < 400_000:
        parts.append(rng.choice(['"a1b2c3d4{}":1', "token={}aB3", "{}", "key:{}", "x{}/y", "Z9{}"]).format(rng.randrange(10**9)))
    text = ",".join(parts)
    began = time.process_time()
    got = S.crf_spans(text, model)
    assert time.process_time() - began < 60 and len(got) > 0
    short = ",".join(parts[:150])
    tokens = [(t.start(), t[0]) for t in S.TOKEN.finditer(short)]
    file = S.file_features(short)
    spans, done = [], 0
    for k, (start, _) in enumerate(tokens):  # the whole line cut into tokens beforehand
        if k < done or not S.allowed(tokens, k)[0]:
            continue
        stop = k + 1
        while stop < len(tokens) and any(S.allowed(tokens, stop)):
            stop += 1
        tags = S.viterbi([model.scores(S.features(tokens, i, file)) for i in range(k, stop)], [S.allowed(tokens, i) for i in range(k, stop)], model.moves)
        done = stop
        for i, tag in enumerate(tags):
            s, t = tokens[k + i]
            if tag == S.B:
                spans.append((s, s + len(t)))
            elif tag == S.I and spans:
                spans[-1] = (spans[-1][0], s + len(t))
    assert S.crf_spans(short, model) == spans
