"""Documents with everything odd: nulls, blanks, ties, repeated rows, a very long text, columns of clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t string, fp long, size long, score double, w string, label string, content string, part int, id string"


def words(r, n):
    return " ".join("".join(r.choice("abcdeghilmnorst") for _ in range(r.randint(2, 9))) for _ in range(n))


def rows(seed=1, n=60):
    r = random.Random(seed)
    base = words(r, 120)
    texts = [None, "", "  \n\t ", "one", "one two three", "a b c d", "A B C D", "é" * 50, "日本語 テキスト", "!!! ??? ###", base, base, base.upper(), words(r, 30000)]
    for _ in range(12):  # near copies
        w = base.split()
        w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [words(r, r.randint(1, 300)) for _ in range(n)]
    out = [(i, t, r.choice(["en", "de", None]), r.choice(["src0", "src0", "src1", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    out += [out[10], out[10], (None, "null id " + base, "en", "src0", 1), (7, "same id, other text", "en", "src2", 2)]
    return out


def frame(spark, data=None):
    extra = ("x", 7, 9, 0.5, "y", "z", "c", 3, "i")
    return spark.createDataFrame([(*x, *extra) for x in (rows() if data is None else data)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
