"""Small inputs and reference computations shared by the tests."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """rows: (doc_id, text, lang, source)."""
    return spark.createDataFrame([(i, t, l, s, None if t is None else len(t))
                                  for i, t, l, s in rows], DOCS)


def clashing(df):
    """The same rows with extra columns named like results and internals."""
    from pyspark.sql import functions as F
    for name in ("kept", "component_id", "fp", "bucket", "digest", "key", "label", "node", "n",
                 "size", "target", "_size", "_key", "lines", "score", "lang_pred", "window",
                 "shard", "ids", "start", "length", "u", "sig", "formatted"):
        df = df.withColumn(name, F.lit("x"))
    return df


def components(nodes, links):
    """node -> smallest node reachable."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def words(rng: random.Random, n: int, vocabulary: int = 500) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


_SYLLABLES = {"fr": ["eau", "ou", "ière", "ment", "que", "les", "pa", "vi", "é"],
              "de": ["sch", "ung", "ein", "ver", "keit", "ü", "ber", "ach", "zu"]}


def made_up_text(rng: random.Random, lang: str, n: int) -> str:
    """n made-up words of a language."""
    return " ".join("".join(rng.choice(_SYLLABLES[lang]) for _ in range(rng.randint(1, 4)))
                    for _ in range(n))
