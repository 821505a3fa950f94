"""The pipeline's stages against plain Python, on a small folder of tables."""

import random

import brute
import pytest

import corpus_pipeline
from pageloom.llm import decontamination, simhash
from pageloom.llm.queries import tokeniser_path

WORDS = {"en": "the of and to in is that it was for on are as with his they at be this from".split(), "fr": "le de un être et à il avoir ne je son que se qui ce dans en du elle au".split()}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)

    def prose(lang, n):
        return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", ".", "x", "q", "zz"]) for _ in range(n))

    passage = prose("en", 60)
    item = " ".join(f"item{i}" for i in range(20))
    rows = [(i, prose(("en", "fr")[i % 2], 80), ("en", "fr")[i % 2], "s", 0) for i in range(60)]
    rows += [(100, rows[0][1], "en", "s", 0), (101, rows[0][1] + " end", "en", "s", 0), (102, "1 2 3", "en", "s", 0), (103, None, "en", None, None), (104, "", None, "s", 0)]
    rows += [(i, f"{prose('en', 40)} {passage} {prose('en', 40)}", "en", "s", 0) for i in (110, 111, 112)]
    rows += [(120, f"{prose('en', 50)} {item} {prose('en', 20)}", "en", "s", 0), (121, item, "en", "s", 0)]
    root = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, [(r["doc_id"], r["text"]) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == columns
        got = sorted((r["doc_id"], r["text"]) for r in docs.collect())
        if name == "language_id":
            want = [(i, t) for i, t in kept if t and any(map(str.isalpha, t))]
        elif name == "simhash_near_dedup":
            want = [(i, t) for i, t in kept if i in {c for _, _, c in brute.near(kept)}]
        elif name == "substring_dedup":
            gone = {d: n for d, _, n, _ in brute.substring(kept)}
            assert {i for i, t in got if t != dict(kept)[i]} == {d for d, n in gone.items() if n and d in dict(got)}
            assert all(len(brute.PLAIN.findall(t)) == len(brute.PLAIN.findall(dict(kept)[i])) - gone[i] for i, t in got)
            want = got
        else:
            hits = {r[0]: r[2] for r in brute.decontamination(kept, [(1, " ".join(f"item{i}" for i in range(20)))])}
            assert all(len(brute.words(t)) == len(brute.words(dict(kept)[i])) - hits[i] for i, t in got)
            want = [(i, t) for i, t in got]
            assert 121 not in dict(got) and 120 in dict(got)
        assert sorted(want) == got
        kept = got


def test_run(spark, folder):
    from tokenizers import Tokenizer

    got = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in got} >= {0, 1, 110} and not {100, 102, 103, 104, 121} & {r["doc_id"] for r in got}
    assert Tokenizer.from_file(tokeniser_path()) and sum(r["offset"] == 0 for r in got) == len({r["sequence_id"] for r in got})


def test_run_returns_whole_sequences(spark, folder):
    """Each piece has the ids of its document's kept text, and nothing that a stage wrote for itself is left."""
    import os

    from tokenizers import Tokenizer

    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    got = corpus_pipeline.run(spark, folder).collect()
    left = set(os.listdir(shared)) - before
    assert len(left) == 1 and next(iter(left)).endswith("best_fit_packing")
    whole, texts = Tokenizer.from_file(tokeniser_path()), {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    own = {r["doc_id"]: list(r["ids"]) for r in got}
    assert own[1] == [*whole.encode(texts[1], add_special_tokens=False).ids, 0] and all(len(r["ids"]) == r["length"] for r in got)


def test_empty_table_and_other_columns(spark, folder, tmp_path):
    """Names of helpers beside the given columns, null and repeated ids, and a table without rows."""
    import shutil

    shutil.copytree(f"{folder}/benchmark.parquet", tmp_path / "benchmark.parquet")
    names = ["_row", "_w", "_fp", "doc", "row", "w", "fp", "score", "lang_pred", "ambiguous", "covered", "items", "chunk", "rows"]
    text = [" ".join(f"{a}{i}of" for i in range(30)) for a in ("the", "and", "for")]
    rows = [(i, t, "en", "s", 1, *names) for i, t in ((1, text[0]), (None, text[1]), (None, text[2]), (1, text[0]), (2, "7 8"), (3, None))]
    rows += [(10 + i, f"le un de et la que {i}", "fr", "s", 1, *names) for i in range(9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names)
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for _, stage in corpus_pipeline.STAGES[:4]:
            columns = docs.columns
            docs = stage(spark, docs, str(tmp_path)).cache()
            assert docs.columns == columns and all(r[c] == c for r in docs.collect() for c in names)
        kept = [(r["doc_id"], r["text"]) for r in docs.collect() if r["lang"] == "en"]
        assert sorted(kept, key=str) == sorted(((1, text[0]), (None, text[1]), (None, text[2])) if given else [], key=str)
        assert corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]
    assert decontamination.WINDOW == 10 and simhash.LIMIT == 4
