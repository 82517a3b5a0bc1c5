"""Small texts with what goes wrong at scale: copies, near copies, shared passages, odd rows."""

import random


def texts(n=120, seed=3):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rnd.randrange(1, 9))) for _ in range(400)]
    words = lambda k: [rnd.choice(vocabulary) for _ in range(k)]
    passage = [" ".join(words(14)) for _ in range(6)]
    out = []
    for _ in range(n):
        kind = rnd.random()
        if out and kind < 0.15:
            out.append(rnd.choice(out))
        elif out and kind < 0.4:
            w = (rnd.choice(out) or "").split(" ")
            for _ in range(max(1, len(w) // 60)):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            out.append(" ".join(w))
        else:
            lines = [" ".join(words(rnd.randrange(1, 25))) for _ in range(rnd.randrange(1, 9))]
            if kind < 0.7:
                lines[rnd.randrange(len(lines)) :] = passage[: rnd.randrange(2, 7)]
            out.append("\n".join(lines))
    out += ["", None, "one", "two words", "One", "a b c d", "a b c d", "x" * 700, "x" * 350, "ab" * 400, " \n\t ", "é" * 150, "line\n" * 60, "THE END", "the\tend"]
    return out


def frame(spark, rows):
    """documents with a clashing extra column."""
    data = [(i, t, "en", f"src{(i or 0) % 3}", None if t is None else len(t), "node") for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, node string")
