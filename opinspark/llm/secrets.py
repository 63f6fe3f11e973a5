"""Secret scans: a linear-chain conditional random field over tokens, beside fixed patterns.

Tokens are tagged O(utside), B(egin) or I(nside). Features of a token: its shape, length, character mix and
entropy, the words and signs around it, and what the whole file looks like. A secret can only begin at a token of
eight or more characters that has a digit in it, is long or comes soon after a word like "password", and go on over
tokens that touch; these rules are part of the lattice, so wherever no token may begin a secret, Viterbi's best path is O throughout, and
only the stretches around such tokens need decoding.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kind, pattern, group whose length counts, least length.
BASE = [
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
]
KINDS = [kind for kind, *_ in BASE] + ["crf"]
_RULES = [(kind, re.compile(pattern, re.ASCII), group, least) for kind, pattern, group, least in BASE if kind != "hex"]
# runs of 16 or more are the only matches of the hex pattern that are long enough
_HEX = re.compile(r"[0-9a-f]{16,}")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")

TOKEN = re.compile(r"[A-Za-z0-9+/_.\-]+|[^\sA-Za-z0-9+/_.\-]")
# a token that may begin a secret: eight or more characters, with a digit, or LONG, or after a cue
OPEN = re.compile(r"[A-Za-z0-9+/_.\-]{8,}")
DIGIT = re.compile("[0-9]")
LONG = 20
CUE = re.compile("pass|pwd|secret|token|key|auth|bearer|credential|private", re.IGNORECASE | re.ASCII)
CUED = 4  # tokens
O, B, I = 0, 1, 2  # noqa: E741
AROUND = 3


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all base matches, as whole matches, in order."""
    found = []
    low = text.lower()
    for number, (kind, rule, group, least) in enumerate(_RULES):
        if "AKIA" in text if kind == "access" else any(w in low for w in _ASSIGN_WORDS):
            found += [(m.start(), number, m.end()) for m in rule.finditer(text) if len(m[group]) >= least]
    found += [(m.start(), KINDS.index("hex"), m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _entropy(token: str) -> float:
    return -sum(c / len(token) * math.log2(c / len(token)) for c in Counter(token).values())


def _shape(token: str) -> str:
    out = re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"[0-9]+", "0", token)))
    return out if len(out) <= 6 else "mixed"


def file_features(text: str) -> list[str]:
    return counted_features(text.count("\n") + 1, assigns_of(text))


def assigns_of(text: str) -> int:
    return text.count("=") + text.count(": ")


def counted_features(lines: int, assigns: int) -> list[str]:
    return [f"file:assigns={min(3, assigns * 4 // lines)}", f"file:lines={min(6, lines.bit_length())}"]


def features(tokens: list[tuple[int, str]], at: int, file: list[str]) -> list[str]:
    word = tokens[at][1]
    digits, letters = sum(c.isdigit() for c in word), sum(c.isalpha() for c in word)
    upper = sum(c.isupper() for c in word)
    out = [
        "bias",
        f"shape={_shape(word)}",
        f"length={min(12, len(word) // 4)}",
        f"digits={4 * digits // len(word)}",
        f"upper={4 * upper // len(word)}",
        f"letters={4 * letters // len(word)}",
        f"entropy={min(10, int(2 * _entropy(word)))}",
        f"hex={bool(re.fullmatch('[0-9a-f]+', word))}&digits={4 * digits // len(word)}",
        f"dots={min(3, word.count('.'))}",
        f"dashes={min(3, word.count('-'))}",
    ]
    for d in range(-AROUND, AROUND + 1):
        if d:
            near = tokens[at + d][1].lower() if 0 <= at + d < len(tokens) else "<edge>"
            out.append(f"{d}:{near if len(near) <= 16 and near.isalpha() or len(near) == 1 else '<long>'}")
    if at:
        out.append(f"touches={tokens[at - 1][0] + len(tokens[at - 1][1]) == tokens[at][0]}")
    if cued(tokens, at):
        out.append("cue")
    return out + file


def cued(tokens: list[tuple[int, str]], at: int) -> bool:
    return any(CUE.search(t) for _, t in tokens[max(0, at - CUED) : at])


def allowed(tokens: list[tuple[int, str]], at: int) -> tuple[bool, bool]:
    """May the token begin a secret; may it go on from the token before."""
    word = tokens[at][1]
    begin = bool(OPEN.fullmatch(word)) and (len(word) >= LONG or bool(DIGIT.search(word)) or cued(tokens, at))
    follows = at > 0 and tokens[at - 1][0] + len(tokens[at - 1][1]) == tokens[at][0]
    return begin, follows and tokens[at][1] not in "\"'`<>()[]{},;"


@dataclass(frozen=True)
class Model:
    weights: dict[str, tuple[float, float, float]]
    moves: np.ndarray  # 3 x 3, from and to

    def scores(self, found: list[str]) -> list[float]:
        out = [0.0, 0.0, 0.0]
        for f in found:
            if w := self.weights.get(f):
                out = [x + y for x, y in zip(out, w, strict=True)]
        return out


def viterbi(scores: list[list[float]], may: list[tuple[bool, bool]], moves: np.ndarray) -> list[int]:
    """Best tags of a stretch between outside tokens."""
    low = -1e9
    best, back = [0.0, low, low], []
    for score, (begin, go_on) in zip(scores, may, strict=True):
        new, come = [], []
        for tag in (O, B, I):
            options = [best[p] + moves[p, tag] for p in (O, B, I)]
            if tag == I:
                options[O] = low
            p = max((O, B, I), key=options.__getitem__)
            shut = (tag == B and not begin) or (tag == I and not go_on)
            new.append(low if shut else options[p] + score[tag])
            come.append(p)
        best = new
        back.append(come)
    last = max((O, B, I), key=lambda t: best[t] + moves[t, O])
    tags = [last]
    for come in reversed(back[1:]):
        tags.append(come[tags[-1]])
    return tags[::-1]


def crf_spans(text: str, model: Model) -> list[tuple[int, int]]:
    """Spans that the field tags as secrets, over the whole text."""
    out: list[tuple[int, int]] = []
    file, done = None, 0
    cues = [m.start() for m in CUE.finditer(text)]
    begin = end = left = right = 0  # of the line, and of what is cut into tokens: each part of a line is cut once
    tokens: list[tuple[int, str]] = []
    starts: list[int] = []
    for m in OPEN.finditer(text):
        if m.start() < done:
            continue
        if m.start() >= end:
            begin, end = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.start())
            end = len(text) if end < 0 else end
            left = right = begin
        plain = m.end() - m.start() < LONG and not DIGIT.search(m[0])
        if plain and not (cues and cues[0] < m.start()):
            continue
        if plain and bisect_left(cues, begin) == bisect_left(cues, m.start()):
            continue
        at = bisect_right(starts, m.start()) - 1
        if m.start() >= right or (at <= max(AROUND, CUED) and left > begin):
            left = _back(text, begin, m.start())
            if plain and not cued(own := [(0, t[0]) for t in TOKEN.finditer(text[left : m.start()])], len(own)):
                right = left
                continue
            right = _ahead(text, m.end(), end)
            tokens = [(left + t.start(), t[0]) for t in TOKEN.finditer(text[left:right])]
            starts = [s for s, _ in tokens]
            at = bisect_right(starts, m.start()) - 1
        elif plain and not cued(tokens, at):
            continue
        file = file_features(text) if file is None else file
        may, stop = [allowed(tokens, at)], at + 1
        while True:
            while stop < len(tokens):
                b, go_on = allowed(tokens, stop)
                if not (b or go_on):
                    break
                may.append((b, go_on))
                stop += 1
            # a stretch that nears the end of what was read may go on behind it
            if right >= end or stop + AROUND < len(tokens):
                break
            before, right = right, _ahead(text, right, end)
            more = [(before + t.start(), t[0]) for t in TOKEN.finditer(text[before:right])]
            tokens, starts = tokens + more, starts + [s for s, _ in more]
        tags = viterbi([model.scores(features(tokens, k, file)) for k in range(at, stop)], may, model.moves)
        done = tokens[stop - 1][0] + len(tokens[stop - 1][1])
        for k, tag in enumerate(tags):
            s, t = tokens[at + k]
            if tag == B:
                out.append((s, s + len(t)))
            elif tag == I and out:
                out[-1] = (out[-1][0], s + len(t))
    return out


def _back(text: str, begin: int, at: int) -> int:
    """Where to start reading so that AROUND + 1 tokens before ``at`` are whole; within the line."""
    step = 128
    while True:
        left = max(begin, at - step)
        if left == begin:
            return begin
        found = list(TOKEN.finditer(text[left:at]))
        if len(found) > AROUND + 2:
            return left + found[1].start()
        step *= 2


def _ahead(text: str, at: int, end: int) -> int:
    """Where to stop reading: the stretch of touching tokens after ``at`` and AROUND + 1 more; within the line."""
    gap = re.compile(r"\s").search(text, at, end)
    at = gap.start() if gap else end
    step = 128
    while True:
        right = min(end, at + step)
        if right == end:
            return end
        found = list(TOKEN.finditer(text[at:right]))
        # the next stretch may itself be open: read on until a plain token parts it off
        if len(found) > AROUND + 2:
            return at + found[-2].end()
        step *= 2


def _word(rng: random.Random) -> str:
    return "".join(rng.choice("bcdfghjklmnprstvw") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) + rng.choice("nrstlm")


def _make_secret(rng: random.Random) -> str:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    pick = lambda s, n: "".join(rng.choice(s) for _ in range(n))
    return rng.choice(
        [
            lambda: pick("0123456789abcdef", rng.choice([32, 40, 64])),
            lambda: "AKIA" + pick(letters[:26] + letters[-10:], 16),
            lambda: pick(letters, rng.randint(20, 48)) + str(rng.randint(0, 9)),
            lambda: pick(letters + "+/", rng.randint(24, 60)) + "1" + "=" * rng.randint(0, 2),
            lambda: "sk_live_" + pick(letters, 24) + "7",
            lambda: pick(letters, 8) + str(rng.randint(10, 99)) + rng.choice("_-.") + pick(letters, 8),
            lambda: pick(letters[:52], rng.randint(20, 48)),
            lambda: "".join(_word(rng).capitalize() for _ in range(rng.randint(2, 4))),
        ]
    )()


def _make_plain(rng: random.Random) -> str:
    pick = lambda s, n: "".join(rng.choice(s) for _ in range(n))
    low = "abcdefghijklmnopqrstuvwxyz"
    return rng.choice(
        [
            lambda: pick("0123456789", rng.randint(8, 19)),
            lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
            lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}",
            lambda: f"{pick(low, 6)}.{rng.randint(1, 99):02}@{pick(low, 4)}{rng.randint(0, 9)}.example.com",
            lambda: f"version-{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}",
            lambda: f"{pick(low, 6)}_{pick(low, 4)}_{rng.randint(1, 20)}",
            lambda: f"/usr/lib/{pick(low, 5)}{rng.randint(1, 9)}/{pick(low, 6)}",
            lambda: f"+{rng.randint(1, 99)}-{pick('0123456789', 3)}-{pick('0123456789', 7)}",
            lambda: "".join(_word(rng) for _ in range(rng.randint(2, 3))),
            lambda: "_".join(_word(rng) for _ in range(rng.randint(3, 5))),
            lambda: f"/usr/{_word(rng)}/{_word(rng)}/{_word(rng)}.{pick(low, 3)}",
            lambda: rng.choice("-._/") * rng.randint(8, 60),
            lambda: f"https://{_word(rng)}.{pick(low, 3)}/{_word(rng)}/{pick(low, 1)}{rng.randint(1, 999)}/{_word(rng)}?{pick(low, 1)}={rng.randint(1, 99999)}",
        ]
    )()


_CUES = ["password", "passwd", "secret", "token", "api_key", "apikey", "auth", "pwd", "client_secret", "private_key", "Authorization: Bearer"]
_TALK = ["password", "secret", "token", "key", "author", "authority", "passed", "passage", "private", "bearer", "credential", "keyboard"]
_JOINS = [" = ", ": ", "=", ' = "', ": '", " ", " => ", " is "]


def examples(lines: list[str], rng: random.Random) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Lines with the spans of secrets in them: drawn ones put in, and those the base patterns find."""
    for line in lines:
        spans = [(m.start(2), m.end(2)) for m in _RULES[0][1].finditer(line) if len(m[2]) >= 12]
        spans += [m.span() for m in _RULES[1][1].finditer(line) if len(m[0]) >= 18]
        kind = rng.random()
        at = line.find(" ", rng.randrange(len(line))) if line else -1
        at = len(line) if at < 0 else at
        if kind < 0.35:
            cue, join, secret = rng.choice(_CUES), rng.choice(_JOINS), _make_secret(rng)
            tail = join[-1] if join[-1] in "\"'" else ""
            put = f" {cue}{join}"
            spans = [(s, e) if e <= at else (s + len(put + secret + tail), e + len(put + secret + tail)) for s, e in spans]
            spans.append((at + len(put), at + len(put) + len(secret)))
            line = line[:at] + put + secret + tail + line[at:]
        elif kind < 0.75:
            put = f" {rng.choice(['', '', 'at ', 'id ', 'key '])}{_make_plain(rng)}"
            spans = [(s, e) if e <= at else (s + len(put), e + len(put)) for s, e in spans]
            line = line[:at] + put + line[at:]
        elif kind < 0.9:
            # words that follow a cue in plain text
            put = f" {rng.choice(_TALK)} {rng.choice(['', '', 'of the ', 'was ', 'is ', 'and ', 'for '])}{_word(rng)}{_word(rng)}{rng.choice(['', 'ed', 'ing', 'tion'])}"
            spans = [(s, e) if e <= at else (s + len(put), e + len(put)) for s, e in spans]
            line = line[:at] + put + line[at:]
        yield line, sorted(spans)


def fit(
    lines: list[tuple[str, list[tuple[int, int]]]], steps: int = 150, l2: float = 1e-3, files: list[list[str]] | None = None
) -> Model:
    """Maximum likelihood, by Adam over batched forward-backward passes on stretches that may hold a secret.

    ``files`` has the file features of each line; without it each line is a file.
    """
    names: dict[str, int] = {}
    stretches = []
    for place, (line, spans) in enumerate(lines):
        tokens = [(t.start(), t[0]) for t in TOKEN.finditer(line)]
        may = [allowed(tokens, k) for k in range(len(tokens))]
        file, k = files[place] if files else file_features(line), 0
        while k < len(tokens):
            if not may[k][0]:
                k += 1
                continue
            stop = k + 1
            while stop < len(tokens) and any(may[stop]):
                stop += 1
            ids, tags = [], []
            for j in range(k, stop):
                s, t = tokens[j]
                inside = next(((a, b) for a, b in spans if a <= s < b), None)
                tag = O
                if inside:
                    tag = I if tags and tags[-1] != O and may[j][1] else (B if may[j][0] else O)
                tags.append(tag)
                ids.append([names.setdefault(f, len(names)) for f in features(tokens, j, file)])
            stretches.append((ids, tags, may[k:stop]))
            k = stop
    if not stretches:
        return Model({}, np.zeros((3, 3)))
    n, length = len(stretches), max(len(t) for _, t, _ in stretches)
    real, gold = np.zeros((n, length), bool), np.zeros((n, length), np.int64)
    shut = np.full((n, length, 3), -1e9)
    shut[..., O] = 0
    rows, cols = [], []
    for i, (ids, tags, may) in enumerate(stretches):
        real[i, : len(tags)], gold[i, : len(tags)] = True, tags
        for j, (b, go_on) in enumerate(may):
            shut[i, j, B], shut[i, j, I] = (0 if b else -1e9), (0 if go_on and j else -1e9)
            rows += [i * length + j] * len(ids[j])
            cols += ids[j]
    rows, cols = np.array(rows), np.array(cols)
    bar = np.zeros((3, 3))
    bar[O, I] = -1e9
    params = np.zeros(len(names) * 3 + 9)
    m, v = np.zeros_like(params), np.zeros_like(params)
    lse = lambda x, axis: np.log(np.exp(x - x.max(axis, keepdims=True)).sum(axis)) + x.max(axis)
    onehot = np.eye(3)[gold] * real[..., None]
    for step in range(1, steps + 1):
        w, moves = params[:-9].reshape(-1, 3), params[-9:].reshape(3, 3)
        score = np.stack([np.bincount(rows, w[cols, t], n * length) for t in range(3)], 1).reshape(n, length, 3) + shut
        step_to = moves + bar
        alpha, beta = np.zeros((n, length, 3)), np.zeros((n, length, 3))
        alpha[:, 0] = score[:, 0] + step_to[O]
        for j in range(1, length):
            alpha[:, j] = score[:, j] + lse(alpha[:, j - 1, :, None] + step_to, 1)
        final = moves[:, O]
        ends = real.sum(1) - 1
        for j in range(length - 1, -1, -1):
            beta[:, j] = final
            if j + 1 < length:
                on = lse(step_to + (score[:, j + 1] + beta[:, j + 1])[:, None, :], 2)
                beta[:, j] = np.where((ends > j)[:, None], on, final)
        z = lse(alpha[np.arange(n), ends] + final, 1)
        p = np.exp(alpha + beta - z[:, None, None]) * real[..., None]
        gap = (p - onehot) / n
        g_w = np.stack([np.bincount(cols, gap.reshape(-1, 3)[rows, t], len(names)) for t in range(3)], 1)
        g_m = np.zeros((3, 3))
        g_m[O] += gap[:, 0].sum(0)
        for j in range(1, length):
            here = real[:, j]
            pair = alpha[here, j - 1, :, None] + step_to + (score[here, j] + beta[here, j])[:, None, :] - z[here, None, None]
            g_m += np.exp(pair).sum(0) / n - onehot[here, j - 1].T @ onehot[here, j] / n
        g_m[:, O] += gap[np.arange(n), ends].sum(0)
        gradient = np.concatenate((g_w.ravel(), g_m.ravel())) + l2 * params
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        params = params - 0.08 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w = params[:-9].reshape(-1, 3)
    moves = params[-9:].reshape(3, 3).copy()
    return Model({f: tuple(map(float, w[i])) for f, i in names.items()}, moves)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most_lines: int = 3_000, most_chars: int = 400, seed: int = 7) -> Model:
    """Fit on at most ``most_lines`` lines of at most ``most_chars`` characters, chosen by hash, into which drawn secrets
    and look-alikes are put; what the base patterns find there counts as secret as well. The bound holds for fitting only.
    Lines are drawn by a threshold on their hash, set from the number of all lines, so that a bounded number leaves the tasks.
    """
    count = lambda sign: F.length(text) - F.length(F.replace(F.col(text), F.lit(sign), F.lit("")))
    split = F.split(F.col(text), "\n")
    assigns = count("=") + (count(": ") / 2).cast("int")
    files = docs.select(split.alias("split"), (F.size(split) * F.lit(2**32) + assigns).alias("file"))
    lines = files.select("file", F.explode("split").alias("line")).filter(F.length("line").between(1, most_chars))
    total = docs.agg(F.sum(F.size(split))).first()[0] or 0
    most = min(2**63 - 1, int(min(1.0, 16 * most_lines / max(total, 1)) * 2**64) - 2**63)
    lines = lines.filter(F.xxhash64("line") <= F.lit(most).cast("long"))
    # of the files that hold a line, one by hash
    file = F.min_by("file", F.xxhash64("line", "file"))
    rows = lines.groupBy("line").agg(F.xxhash64("line").alias("h"), file.alias("file")).orderBy("h", "line").limit(most_lines).collect()
    rng = random.Random(seed)
    found = [(r.line, r.file >> 32, r.file % 2**32) for r in rows] or [("", 1, 0)]
    dealt = [found[i % len(found)] for i in range(most_lines)]
    more = list(examples([line for line, _, _ in dealt], rng))
    # each second one as a file of its own, so that short files are known too
    files = [
        file_features(new) if i % 2 else counted_features(n, assigns + assigns_of(new) - assigns_of(old))
        for i, ((old, n, assigns), (new, _)) in enumerate(zip(dealt, more, strict=True))
    ]
    return fit(more, files=files)


def scan_secrets(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``doc`` (a struct of all columns) and ``spans``: (start, end, kind), in code points, end exclusive, by start, then kind.

    Only the whole texts go to Python, and spans come back; no shuffle. Base spans are whole matches of the fixed patterns; spans of the
    field that lie within or across a base span aren't repeated. Null and empty texts have none; repeated rows get
    equal results. Other columns are carried, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for batch in batches:
            out = []
            for value in batch:
                body = value.as_py() or ""
                spans = base_spans(body)
                base = [(s, e) for s, _, e in spans]
                for s, e in crf_spans(body, model):
                    if not any(a < e and s < b for a, b in base):
                        spans.append((s, len(KINDS) - 1, e))
                out.append([{"start": s, "end": e, "kind": KINDS[k]} for s, k, e in sorted(spans)])
            yield pa.array(out, arrow)

    # declared nondeterministic so that it isn't run once more for a filter on its result
    scan = F.arrow_udf(run, "array<struct<start:long,end:long,kind:string>>").asNondeterministic()
    return docs.select(F.struct("*").alias("doc"), scan(F.col(text)).alias("spans"))
