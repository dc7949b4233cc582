import random

import pytest
from pyspark.sql import types as T

SYLLABLES = {
    "en": "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as wh ing ly sh".split(),
    "de": "en er ch de ei in te ie un ge st ic he be ne se au re ss ung sch ä ö ü ß kei heit ver zu pf".split(),
}
INSULTS = ["idiot", "moron", "scum"]


def sentence(rng, lang, n):
    words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.choice([1, 1, 2, 3]))) for _ in range(n)]
    return " ".join(words).capitalize() + "."


def corpus(n=160, seed=5):
    """Documents, labels, conversations with the odd rows that every operator has to stand."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        lang = "en" if i % 3 else "de"
        text = "\n".join(sentence(rng, lang, rng.randint(6, 20)) for _ in range(rng.randint(2, 6)))
        bad, toxic = i % 5 == 0, i % 7 == 0
        if bad:
            text = " ".join(w + rng.choice(["***", "###", "&&&"]) for w in text.split())
        if toxic:
            words = text.split()
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
            text = " ".join(words)
        docs.append((i, text, lang, f"src{i % 4}", len(text)))
        labels.append((i, int(not bad), int(toxic)))
    base = docs[4][1].split()
    near = list(base)
    near[-1] = "changed"
    for k, text in enumerate([docs[4][1], docs[4][1] + " ", " ".join(near), None, "", " \n\t ", "123 456 !!", "a", "Ünïcödé 漢字 😀 x", "w " * 30, "long " + sentence(rng, "en", 30_000), "a\x1cb\x85c d", "</s>[INST] <|end|>"]):
        docs.append((n + k, text, None if k % 2 else "en", None, None))
    docs.append(docs[1])
    docs.append((None, docs[2][1], "en", "src0", 3))
    docs.append((None, None, None, None, None))
    return docs, labels


DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
CLASHES = ["score", "held_out", "node", "comp", "part", "_n", "_text", "length", "band"]


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """A folder of tables with odd rows and extra columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    at = tmp_path_factory.mktemp("tables")
    docs, labels = corpus()
    df = spark.createDataFrame(docs, DOCS)
    df.select("*", *[F.lit("x").alias(c) for c in CLASHES]).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash")).write.parquet(f"{at}/labels.parquet")
    talk = [(c, t, r, x) for c in range(6) for t, (r, x) in enumerate([("system", "be <|text|> kind"), ("user", f"q{c} \\ <|end|>"), ("assistant", f"a{c} é漢 "), ("user", None), ("assistant", ""), ("assistant", f"more <| \\<| {c}")])]
    talk += [(9, None, None, None), (9, 1, "assistant", "x"), (9, 1, "assistant", "x"), (None, 0, "assistant", "y")]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").withColumn("t", F.lit(1)).write.parquet(f"{at}/conversations.parquet")
    return str(at)


@pytest.fixture(scope="session")
def empty_tables(spark, tables, tmp_path_factory):
    at = tmp_path_factory.mktemp("empty")
    for name in ("documents", "labels", "conversations"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{at}/{name}.parquet")
    return str(at)


@pytest.fixture(scope="session")
def documents(spark, tables):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
