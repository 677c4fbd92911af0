"""Documents with the awkward cases, and plain definitions to compare with."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def words_of(text):
    return WORD.findall(text or "")


def shingles_of(text, width):
    w = WORD.findall(lowered(text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)}


def documents(seed=5, n=60):
    """Rows of doc_id, text, source: random texts, copies, near copies, and the odd ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"Word{i}" for i in range(300)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 90))) for _ in range(n)]
    for t in texts[:10]:
        w = t.split(" ")
        for _ in range(3):
            v = list(w)
            v[rng.randrange(len(v))] = rng.choice(vocabulary)
            texts.append(" ".join(v))
        texts.append(t)
    passage = " ".join(rng.choices(vocabulary, k=60))
    texts += [f"{t}\n{passage}\n{t[::-1]}" for t in texts[:8]]
    texts += [
        None, "", " ", "\n\n", "one", "one two", "one two three four", "a\tb\x0bc\x0cd\re",
        "x " * 3000, "same line of five words\nsame line of five words\n", " nbsp  　wide",
        "# $ % & | < >", "日本語 テスト", "😀 😀 😀 😀", "y" * 30000,
    ]
    rows = [(i * 3, t, rng.choice(["a", "b", None, "ü"])) for i, t in enumerate(texts)]
    return rows + [rows[3]]  # a repeated row


SCHEMA = "doc_id bigint, text string, source string"


def with_extras(df):
    """Columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    names = ["n", "line", "n_words", "node", "component", "kind", "start", "row", "size", "base", "shard"]
    return df.withColumns({c: F.lit("x") for c in names})
