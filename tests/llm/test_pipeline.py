"""The pipeline's stages, each against its operator's plain version on its own input."""

import brute
import corpus_pipeline
import sentencepiece
from pyspark.sql import functions as F

from tessera.llm import quality_gam, queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "sentencepiece"]
    rows = lambda d: {r["doc_id"]: r["text"] for r in d.collect()}
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frames[-1], SF)
        if name != "sentencepiece":
            assert set(out.columns) == set(docs.columns)
        frames.append(spark.createDataFrame(out.collect(), out.schema))
    texts = [rows(f) for f in frames[:-1]]
    model = quality_gam.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {i: model.score(quality_gam.features_of([t.encode()]))[0] for i, t in texts[0].items()}
    assert set(texts[1]) == {i for i, s in scores.items() if s >= 0.5}
    assert texts[2] == {i: x[2] for i, x in brute.line_dedup(sorted(texts[1].items())).items()}
    assert set(texts[3]) == {i for i, (_, top) in brute.groups(sorted(texts[2].items()), 80).items() if top == i}
    bad = {i for i, (n, hit, _) in brute.contamination(texts[3].items(), bench).items() if hit and 20 * hit >= n}
    assert set(texts[4]) == set(texts[3]) - bad
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    for r in frames[-1].collect():
        assert list(r["ids"]) == [1, *sp.encode(texts[4][r["doc_id"]]), 2] and r["round_trip"]


def test_run(spark, tmp_path):
    """run() gives the rows of its stages applied one after the other, and leaves one folder."""
    import glob

    out = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, docs, SF)
        docs = spark.createDataFrame(frame.collect(), frame.schema)
    assert out == {r["doc_id"]: list(r["ids"]) for r in docs.collect()} and len(out) > 50
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert len(glob.glob(f"{base}/pipeline-*")) == 1


def test_stages_on_odd_rows(spark):
    """Nulls in any column, empty, very long and repeated texts, clashing names: rows and columns stay as they are where nothing speaks against them."""
    from test_operators import EDGE, LONG

    rows = [(i, t, None, None, None if t is None else len(t), 5, "n") for i, t in EDGE]
    docs = spark.createDataFrame(rows + rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, n_lines int, n_removed string").repartition(3)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name == "sentencepiece":
            # a marker that stands in a text itself decodes to a blank
            marked = docs.where("text like '%▁%'").count()
            assert out.count() == docs.count() and out.where("not round_trip").count() == marked
            continue
        assert out.columns == docs.columns
        out = spark.createDataFrame(out.collect(), out.schema)
        assert out.where("n_lines <> 5 or n_removed <> 'n'").count() == 0
        if name == "line_dedup":
            assert out.count() == docs.count() and out.where("doc_id = 10").first()["text"] == LONG
        docs = out


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0


def test_workers_keep_no_table(spark):
    """A Python worker serves later stages too: what the encoder learned of texts goes with its task."""
    import public_tokenizers
    import pyarrow as pa

    from tessera.llm import pieces

    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(8)
    out = pieces.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))
    assert pieces.decode_pieces(out.select("ids", F.col("decoded").alias("was")), public_tokenizers.path("piece_bpe_32k.model")).where("decoded <> was").count() == 0

    def held(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"models": [len(pieces._tables)], "entries": [sum(len(t.table) + len(t.texts) for t in pieces._tables.values())]})

    left = spark.range(0, 64, 1, 16).mapInArrow(held, "models bigint, entries bigint").agg(F.max("models"), F.max("entries")).first()
    assert left[0] == 1 and left[1] == 0


def test_near_duplicates_in_few_jobs(spark, monkeypatch):
    """The driver keeps something of every job and task: a long chain of links takes no round each time it halves, and who goes is found out once."""
    import random
    from itertools import count

    from tessera.llm import near_dups

    links = [(b"%04d" % i, b"%04d" % (i + 1)) for i in range(0, 600) if i % 200]
    links += [(b, a) for a, b in links[::3]] + links[:50]
    random.Random(1).shuffle(links)
    table = near_dups.cut(spark.createDataFrame(links, "a binary, b binary").repartition(8))
    numbers = count()

    def run(make):
        group = f"few jobs {next(numbers)}"
        spark.sparkContext.setJobGroup(group, group)
        out = make()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    want = {b"%04d" % i: b"%04d" % (i - (i - 1) % 200) for i in range(1, 601)}
    got, jobs = run(lambda: near_dups._components(table).collect())
    assert {bytes(r["node"]): bytes(r["comp"]) for r in got} == want and len(got) == len(want) and jobs <= 4
    for n in (7, 150):  # several tasks, and several turns in one
        monkeypatch.setattr(near_dups, "LINKS", n)
        got = near_dups._components(table).collect()
        assert {bytes(r["node"]): bytes(r["comp"]) for r in got} == want and len(got) == len(want)
    monkeypatch.undo()
    assert near_dups._components(near_dups.cut(table.limit(0))).count() == 0

    docs = spark.createDataFrame([(i, f"one two three four five six seven eight nine {i // 2}") for i in range(40)], "doc_id bigint, text string")
    kept = near_dups.drop_near_duplicates(docs, 80)
    rest, jobs = run(kept.collect)
    assert {r["doc_id"] for r in rest} == set(range(0, 40, 2)) and jobs <= 3
