import pytest


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """A folder of the tables that the queries read, with the odd cases in it."""
    import random

    random.seed(11)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(random.randrange(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    docs, labels = [], []
    for i in range(240):
        good, toxic = i % 5 != 0, i % 4 == 0
        text = ". ".join(prose(8) for _ in range(6)) + "."
        if toxic:
            text = text.replace(". ", f". what a {random.choice(['blasted', 'blastedly', 'wretched'])} {word()}. ", 1)
        if not good:
            text = " ".join(f"{w}###" for w in text.split()) if i % 2 else (word() + " ") * 80
        docs.append((i, text, "en", f"s{i % 3}" if i % 7 else None, len(text), "clash", 5))
        labels.append((i, int(good), int(toxic)))
    base = docs[3][1]
    docs += [
        (300, None, "en", "s0", None, "x", 1), (301, "", "en", None, 0, "x", 1), (302, base, "de", "s1", 1, "x", 1), (303, base.replace(" ", "\n "), "de", "s1", 1, "x", 1), (303, base.replace(" ", "\n "), "de", "s1", 1, "x", 1),
        (304, base.replace("a", "b", 1), None, "s2", 1, None, None), (None, "a row without an id", "en", "s0", 1, "x", 1), (305, prose(20000), "en", "s0", 1, "x", 1), (306, "é中😀 <|endoftext|>  \x0b\x1c ՘x's 12", "en", "s0", 1, "x", 1), (307, " \t\n", "en", "s0", 1, "x", 1),
    ]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, row string, size int").repartition(5).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels + [(999, None, None), (1000, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.fixture(scope="session")
def empty(spark, tables, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels"):
        spark.read.parquet(f"{tables}/{name}.parquet").where("false").write.parquet(f"{folder}/{name}.parquet")
    return folder
