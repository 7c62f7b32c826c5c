"""Small documents with every hard case: nulls, empty and long texts, copies,
near copies, repeated rows, clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n string, c string, key string"
EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed):
    r = random.Random(seed)
    syllables = ["ka", "to", "mi", "ren", "sol", "ve", "du", "pra", "nix", "lo"]
    return ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n)]


def edited(base, share, seed):
    r = random.Random(seed)
    return [f"x{seed}y{i}" if r.random() < share else w for i, w in enumerate(base)]


def texts():
    base = words(120, 1)
    passage = " ".join(words(60, 2)) + "."
    out = [" ".join(base)]
    out += [" ".join(base)] * 3  # exact copies
    out += [" ".join(edited(base, 0.01 * k, k)) for k in range(1, 9)]  # near copies, some too far
    out += [" ".join(words(40, 50 + k)) + " " + passage + " " + " ".join(words(40, 70 + k)) for k in range(12)]  # one passage
    out += ["Idem Ipse Dixit.\n" + " ".join(words(30, 90 + k)) for k in range(3)]
    out += [None, "", " ", "\n\t", "one", "One  TWO", "one two", "a b c d e", "A B C D E", "naïve café 日本", "x" * 300]
    out += [" ".join(words(4000, 7))]  # very long
    return out


def documents(spark, extra=True):
    rows = [(i, t, ["en", "de", None][i % 3], f"s{i % 4}", len(t or ""), 0.5, "n", "c", "k") for i, t in enumerate(texts())]
    rows.append(rows[0])  # a repeated row
    rows.append((None, rows[2][1], "en", "s", 1, None, None, None, None))
    rows = rows if extra else [r[:5] for r in rows]
    return spark.createDataFrame(rows, SCHEMA if extra else EMPTY).repartition(3)


def empty(spark):
    return spark.createDataFrame([], EMPTY)
