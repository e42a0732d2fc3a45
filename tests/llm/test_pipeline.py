"""The pipeline's stages against brute force, and on nulls, empty tables, repeated rows and clashing columns."""

import os
import re
import shutil
import sys

import pytest
from pyspark.sql import functions as F
from twinfold.llm import crf_langid, toxicity
from twinfold.llm.common import bound_batches

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline as pipeline  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = ("t", "fp", "d", "key", "rep", "label", "id", "gone_id", "bucket", "score", "places", "cut_doc", "y", "lane", "queue")
ODD = [(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, " \n\t ", None, "s", 4), (10**6 + 3, "12 !? 3", "en", None, 7), (10**6 + 4, "word " * 40_000, "en", "s", 200_000), (None, "a text without an id that has some words", "en", "s", 40), (10**6 + 5, "x" * 100_000, "en", "s", 100_000)]


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """documents with odd, repeated and clashing ones, and the given labels."""
    out = str(tmp_path_factory.mktemp("pipeline"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    base = [r for r in docs.where("length(text) > 900").orderBy("doc_id").limit(6).collect()]
    near = [(2 * 10**6 + k, r.text.replace(r.text.split()[40], "changed", 1) + " end", r.lang, r.source, r.n_chars) for k, r in enumerate(base)]
    more = spark.createDataFrame(ODD + near, docs.schema)
    whole = docs.unionByName(more).unionByName(docs.where("doc_id in (3, 4)"))
    whole.withColumns({c: F.lit(f"{c} stays") for c in CLASH}).write.parquet(f"{out}/documents.parquet")
    shutil.copy(f"{sf}/labels.parquet", f"{out}/labels.parquet")
    return out


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_toxicity_and_language_stages_drop_what_their_operators_reject(spark, docs, folder):
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    keep = {(r.doc_id, r.predicted) for r in toxicity.score(docs, model).collect()}
    got = pipeline.drop_toxic(spark, docs, folder)
    assert got.columns == docs.columns and rows(got) == rows(docs.where(~F.col("doc_id").isin([i for i, p in keep if p and i is not None]) | F.col("doc_id").isNull()))
    model = crf_langid.fit(docs)
    bad = [r.doc_id for r in crf_langid.identify(docs, model).collect() if r.lang_pred == "und" or r.score < pipeline.LEAST_LANGUAGE]
    got = pipeline.drop_unknown_language(spark, docs, folder)
    assert {10**6, 10**6 + 1, 10**6 + 2, 10**6 + 3} <= set(bad) and got.columns == docs.columns
    assert rows(got) == rows(docs.where(~F.col("doc_id").isin([i for i in bad if i is not None]) | F.col("doc_id").isNull()))


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_copies_stage_against_brute_force(spark, docs, folder):
    texts = {r.doc_id: shingles(r.text) for r in docs.where("doc_id is not null").collect()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(texts[a] & texts[b])
            if n and n >= 0.8 * (len(texts[a]) + len(texts[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = pipeline.keep_one_of_copies(spark, docs, folder)
    gone = [i for i in ids if find(i) != i]
    assert len(gone) > 10 and got.columns == docs.columns and rows(got) == rows(docs.where(~F.col("doc_id").isin(gone) | F.col("doc_id").isNull()))


def cut(docs):
    """Kept words by id, of all rows that have one."""
    words, first = [(i, WORD.findall(t or "")) for i, t in docs], {}
    for i, w in words:
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            first[key] = min(first.get(key, (i, s)), (i, s))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            if first[tuple(w[s : s + 20])] < (i, s):
                gone[s : s + 20] = [True] * 20
        out.append((i, [x for x, g in zip(w, gone, strict=True) if not g]))
    return sorted(out)


def test_repeats_stage_against_brute_force(spark, docs, folder):
    got = pipeline.cut_repeats(spark, docs, folder)
    assert got.columns == docs.columns and got.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    kept = got.collect()
    assert sorted((r.doc_id, WORD.findall(r.text or "")) for r in kept if r.doc_id is not None) == cut([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None])
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in kept) and [r.text for r in kept if r.doc_id is None] == [ODD[5][1]]
    assert all(r.key == "key stays" and r.places == "places stays" for r in kept)


def test_packing_stage_keeps_every_token(spark, docs, folder):
    from tokenizers import Tokenizer
    from twinfold.llm.queries import vocabulary

    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    got = pipeline.pack(spark, docs, folder).toPandas()
    want = sorted(len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert got.length.sum() == sum(want) and set(got.doc_tokens) == set(want) and got.doc_id.isna().sum() >= 1
    assert got.groupby("sequence_id").length.sum().iloc[:-1].eq(4096).all()


def test_run_is_its_stages(spark, docs, folder):
    """Each stage on the rows that its predecessor kept; and the whole again from the start."""
    own = docs
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, own, folder)
        assert after.columns == docs.columns, name
        path = f"{folder}/{name}"
        after.write.parquet(path)
        own = spark.read.parquet(path)
    assert 0 < own.count() < docs.count()
    assert rows(pipeline.run(spark, folder).select("doc_id", "start", "length", "ids_crc32")) != [] and pipeline.run(spark, folder).agg(F.sum("length")).first()[0] == pipeline.pack(spark, own, folder).agg(F.sum("length")).first()[0]


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stages_on_empty_and_null_tables(spark, docs, folder, name):
    stage = dict(pipeline.STAGES)[name]
    assert stage(spark, docs.limit(0), folder).count() == 0
    nothing = docs.limit(3).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema.fields))
    out = stage(spark, nothing, folder)
    assert out.count() == {"language": 0}.get(name, 3)


def test_workers_let_go_of_packed_words(spark, folder):
    """Workers live on: what packing keeps from task to task must not stay beside the next stage's data."""

    def words_kept(batches):
        import pyarrow as pa
        from pyspark.core.broadcast import _broadcastRegistry
        from twinfold.llm import packing

        found, todo, seen = 0, [vars(packing), *(vars(b) for b in _broadcastRegistry.values())], set()
        while todo:
            x = todo.pop()
            if id(x) not in seen:
                seen.add(id(x))
                found += isinstance(x, dict) and b"zyxquartz" in x
                inner = x.values() if isinstance(x, dict) else x if isinstance(x, tuple | list) else vars(x).values() if type(x).__module__.startswith("twinfold") and hasattr(x, "__dict__") else ()
                todo += [y for y in inner if not isinstance(y, bytes | str | int)]
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([found] * batch.num_rows, pa.int64())], names=["n"])

    docs = spark.createDataFrame([(i, "zyxquartz words here", "en", "s", 20) for i in range(8)], "doc_id long, text string, lang string, source string, n_chars int").repartition(8)
    assert pipeline.pack(spark, docs, folder).count() == 8
    assert spark.range(0, 800, 1, 8).mapInArrow(words_kept, "n long").agg(F.sum("n")).first()[0] == 0


def test_batches_of_readers_and_workers_are_bounded(spark):
    """Smaller than Spark's own, unless the session has set them."""
    own, names = spark.newSession(), ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxBytesPerBatch")
    bound_batches(own)
    assert [own.conf.get(n) for n in names] == ["512", f"{8 << 20}b"]
    for n, x in zip(names, ("100", "1000000b"), strict=True):
        own.conf.set(n, x)
    bound_batches(own)
    assert [own.conf.get(n) for n in names] == ["100", "1000000b"]
