"""Small corpora with copies, near copies, shared passages, nulls, empty and long texts."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, block int, rid string, gid string, tags string, shard int"
EDGE = [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one"), (1004, "one"), (1005, "One  two three four five"), (1006, "one two\nthree four FIVE"), (1007, "é ß　x"), (1008, "\U0001f600 a"), (1009, "a a a a a a a a a a a a a a a a a a")]


def corpus(n=60, seed=0):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    passage = " ".join(rng.choice(vocab) for _ in range(70))
    docs = []
    for i in range(n):
        kind = rng.random()
        if docs and kind < 0.15:
            text = docs[rng.randrange(len(docs))][1]
        elif docs and kind < 0.4:
            words = docs[rng.randrange(len(docs))][1].split(" ")
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            text = " ".join(words)
        else:
            text = " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 160)))
            if kind > 0.8:
                text = f"{text}\n{passage} {text}"
        docs.append((i, text))
    rng.shuffle(docs)
    return docs


def frame(spark, docs, parts=3):
    rows = [(i, t, ("en", "de", None)[(i or 0) % 3], "s", None if t is None else len(t), 7, "r", "g", "t", 1) for i, t in docs]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)
