"""Planted cases go, clean documents stay, and the tokens give the texts back."""

import random

import pytest
import tiktoken

import corpus_pipeline
from lifeframe.llm import bpe


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(17)
    vocabulary = ["".join(rng.choice("aeioustrnlmd") for _ in range(rng.randrange(2, 9))) for _ in range(1500)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    clean = [(i, "\n".join(prose(40) for _ in range(4))) for i in range(40)]
    item = prose(30)
    line = "this very line stands in several of the documents"
    rows = list(clean)
    rows += [(100, clean[3][1])]  # an exact copy; of three, line dedup would empty two
    words = clean[5][1].split(" ")
    words[20] = "changed"
    rows += [(102, " ".join(words))]  # a near copy
    rows += [(103, prose(60) + " " + item + " " + prose(60))]  # a passage of the benchmark
    rows += [(104, "too short"), (105, "again and again and again and " * 30), (106, None), (107, "")]
    rows += [(110 + k, prose(50) + "\n" + line + "\n" + prose(50)) for k in range(4)]  # a repeated line
    return rows, clean, item, line


def test_pipeline(spark, planted, documents, tmp_path):
    rows, clean, item, line = planted
    folder = str(tmp_path)
    documents(rows, extra=("_id", "ids", "kept")).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in clean], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(got) == {i for i, _ in clean} | {110, 111, 112, 113}
    library = tiktoken.Encoding(
        "own", pat_str=corpus_pipeline.public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary(corpus_pipeline.VOCABULARY), special_tokens={}
    )
    texts = dict(rows)
    for i, row in got.items():
        text = texts[i] if i < 110 or i == 113 else texts[i].replace(line + "\n", "")
        assert row["text"] == text and row["ids"] == library.encode_ordinary(text)


def test_stages_keep_the_columns(spark, planted, documents, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = documents([])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() == 0, name
