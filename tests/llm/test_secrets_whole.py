"""Secrets of texts of several lines, and those without digits."""

import base64
import random
import string
import uuid

import pytest
from helpers import documents, rows

from opinspark.llm import secrets as S


@pytest.fixture(scope="module")
def model(spark):
    return S.train(documents(spark, rows(3, 200)), most_lines=3000)


def test_file_features_of_whole_texts_are_learned(model):
    assert sum(f.startswith("file:lines=") for f in model.weights) > 1


@pytest.mark.parametrize("before", ["", "one line of words\nand another line here\n", "a\n" * 40])
@pytest.mark.parametrize("cue,secret", [("pwd: ", "CorrectHorseBattery"), ("Authorization: Bearer ", "qWeRtYuIoPaSdFgHjKlZxCvBnM"), ("token = ", "kVbQzXwPfLmRtYcGhJdNsAeU")])
def test_secrets_without_digits(model, before, cue, secret):
    text = f"{before}the {cue}{secret} is set"
    at = text.index(secret)
    assert (at, at + len(secret)) in S.crf_spans(text, model)


def test_words_after_a_cue_are_none(model):
    assert S.crf_spans("the author of the password described\nsomething important", model) == []


LETTERS = string.ascii_letters + string.digits
LINES = [
    "export {c}={x}", "{c}: {x}", '"{c}": "{x}",', 'set {c} "{x}"', 'curl -H "{c}: {x}" https://host/api', "the {c} for staging is {x} please rotate", "{c} => '{x}'", "-- {c} {x}",
]
CUES = ["GITHUB_TOKEN", "SLACK_AUTH", "db_pwd", "ACCESS_KEY", "private-token", "X-Api-Key", "credential", "passphrase", "session_secret"]
PLAIN = [
    "the quick brown fox jumps over it at 2021-03-04T05:06:07", "commit 1.2.3-beta4 of package foo_bar_baz2 is out", "see https://example.com/a/b/c123/def?x=12345 for it",
    "internationalization and telecommunications departments", "call +44-20-7946-0958 or mail first.last01@mail7.example.org", "/var/lib/docker/overlay2/merged/usr/share/doc",
    "order 100000234567 shipped on 12.05.2023 09:30", "ISBN 978-3-16-148410-0 and 192.168.100.200", "the secretary of the keynote authored passages",
    "function computeTotalAmount2(values) { return 0 }", "Straßenverkehrsordnung Bundesausbildungsförderungsgesetz", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa ------------------------------",
]


def shapes(rng):
    """Secrets whose shapes and lines the training examples don't have."""
    pick = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    b64 = lambda n: base64.urlsafe_b64encode(rng.randbytes(n)).decode().rstrip("=")
    return {
        "ghp": lambda: "ghp_" + pick(LETTERS, 36),
        "xoxb": lambda: f"xoxb-{pick(string.digits, 11)}-{pick(string.digits, 12)}-{pick(LETTERS, 24)}",
        "jwt": lambda: f"eyJ{b64(24)}.eyJ{b64(40)}.{b64(32)}",
        "AIza": lambda: "AIza" + pick(LETTERS + "-_", 35),
        "SG": lambda: f"SG.{b64(16)}.{b64(32)}",
        "40": lambda: pick(LETTERS + "+/", 40),
        "word": lambda: pick(string.ascii_lowercase, 5).capitalize() + pick(string.digits, 4) + rng.choice("_-") + pick(string.ascii_lowercase, 4),
        "HEX": lambda: pick("0123456789ABCDEF", 32),
        "uuid": lambda: str(uuid.UUID(int=rng.getrandbits(128))).upper(),
    }


def test_recall_on_unseen_shapes(model):
    rng, found, total = random.Random(1234), 0, 0
    for make in shapes(rng).values():
        for line in LINES * 12:
            secret = make()
            text = rng.choice(["", "one\ntwo\n"]) + line.format(c=rng.choice(CUES), x=secret) + rng.choice(["", "\nmore words here"])
            at = text.index(secret)
            spans = S.crf_spans(text, model)
            found += any(a <= at and e >= at + len(secret) for a, e in spans) or any(a <= at and e >= at + len(secret) for a, _, e in S.base_spans(text))
            total += 1
    assert found / total >= 0.9
    assert sum(len(S.crf_spans(line, model)) for line in PLAIN) <= 1


def test_overlaps_and_a_very_long_text(model, spark):
    long = "word " * 200_000 + "pwd: CorrectHorseBattery" + " word" * 10
    rows_ = [(1, long, "", "", 0, 0, "", 0), (2, 'token="deadbeefdeadbeefdeadbeef"', "", "", 0, 0, "", 0)]
    got = {r.doc.doc_id: [tuple(s) for s in r.spans] for r in S.scan_secrets(documents(spark, rows_), model).collect()}
    assert (1_000_005, 1_000_024, "crf") in got[1]
    assert got[2] == [(0, 31, "assign"), (7, 31, "hex")]  # spans of the field never cross base spans
