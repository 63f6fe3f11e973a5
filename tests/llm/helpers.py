"""Random documents with the awkward cases in them, and plain tokenizers."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, doc string, _part long"
LOWER = {i: i + 32 for i in range(65, 91)}


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def solid(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rows(seed, n=60, vocabulary=30, longest=80, pieces=()):
    """Random word salad with copies, near copies, nulls, empty and long texts; extra columns clash on purpose."""
    rng = random.Random(seed)
    words = [rng.choice(["é", "ß", "A", "b", "日", "z9"]) + str(i) for i in range(vocabulary)]
    salad = lambda k: [rng.choice(words) for _ in range(k)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.05:
            texts.append(None)
        elif kind < 0.1:
            texts.append(rng.choice(["", " \n", "...", "x"]))
        elif kind < 0.3 and texts:
            texts.append(rng.choice(texts))
        elif kind < 0.5 and any(texts):
            old = solid(rng.choice([t for t in texts if t]))
            for _ in range(rng.randint(1, 3)):
                if old:
                    old[rng.randrange(len(old))] = rng.choice(words)
            texts.append(" ".join(old))
        else:
            out = salad(rng.randint(1, longest))
            if pieces and rng.random() < 0.5:
                at = rng.randint(0, len(out))
                out[at:at] = [rng.choice(pieces)]
            texts.append(rng.choice([" ", "\n", "  ", ", "]).join(out))
    texts.append(" ".join(salad(3000)))
    sources = [None, "b", "a", "é", "B"]
    out = [(i, t, "en", rng.choice(sources), None, 5, "x", 7) for i, t in enumerate(texts)]
    rng.shuffle(out)
    return out


def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)
