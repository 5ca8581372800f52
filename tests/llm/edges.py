"""Documents that every operator must take: nulls, empty and very long texts, ties, repeats, clashing columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, predicted int, pii string, host string, idx int, lang_pred string"


def prose(n, seed=0):
    words = "river stone winter garden letter market silver window orange morning teacher kitchen music planet forest yellow story number".split()
    state, out = seed * 7919 + 13, []
    for _ in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append(words[state >> 16 & 15] + str(state >> 20 & 255))
    return " ".join(out)


def rows(texts):
    return [(i, t, None if t is None else "en", "s", len(t or ""), 0.5, True, 1, "x", "h", 3, "zz") for i, t in texts]


def docs(spark, texts):
    return spark.createDataFrame(rows(texts), SCHEMA)


EDGES = [(1, None), (2, ""), (3, "   \n\t"), (4, "word"), (5, "two words"), (6, prose(60_000, 9)), (7, "."), (None, prose(50, 3)), (8, prose(50, 4)), (8, prose(50, 4)), (9, "İstanbul ß 你好 🙂 " * 20)]
