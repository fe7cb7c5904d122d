import random

import pytest

#: Column names that the operators use inside; input tables may have them too.
CLASHING = ("size", "score", "cls", "key", "k", "hash", "bin", "start", "at", "n", "pass", "target", "text_hash", "node", "label", "id", "vec", "taken", "position", "w", "s")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` int" for c in CLASHING)


def make_docs(spark, rows):
    """Documents from (doc_id, text, source), with extra columns whose names clash."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *range(len(CLASHING))) for i, t, s in rows], SCHEMA)


def prose(rng, n):
    vocabulary = ["the", "of", "and", "to", "in"] + ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="session", autouse=True)
def few_partitions(spark):
    """Small tables: few partitions, so that a job is quick."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="session")
def tricky_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, copies."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(3, 200)) for _ in range(30)]
    rows = [(i, t, f"src{i % 4}" if i % 7 else None) for i, t in enumerate(base)]
    rows += [(100, None, "src0"), (101, "", "src1"), (102, " \t\n ", None), (103, "word", "src9"), (None, "an id is missing here " + prose(rng, 30), "src2"),
             (None, None, None), (104, prose(rng, 30_000), "src3"), (105, "x" * 50_000, "src3"), (106, "Naïve Σίσυφος 你好 ½   é <|endoftext|>", "src1")]
    rows += [rows[3], rows[3], (3, "another text with the same id", "src1"), (200, base[5], "src0"), (201, base[5].upper(), "src0"), (202, base[5] + " tail", "src0")]
    return rows


@pytest.fixture(scope="session")
def tricky(spark, tricky_rows):
    return make_docs(spark, tricky_rows).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return make_docs(spark, []).cache()
